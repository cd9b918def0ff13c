"""Unseen elements that don't end where they should must not take the text after them."""

import time

import pytest

from ledgerline.llm import html_crf


def texts(page):
    return [b[0] for b in html_crf.blocks(page)]


@pytest.mark.parametrize("start", ["<svg class='icon'/>", '<svg viewBox="0 0 1 1"/>', "<svg/>", "<math display='block' />", "<svg class=icon/>", "<svg>", "<button>", "<select><option>", "<object data=x>", "<canvas id=c>", "<video src=v>", "<map name=m>", "<audio>"])
@pytest.mark.parametrize("later", ["", "<svg><path d='M0'/></svg>", "<button>Go</button>", "<canvas>x</canvas>"])
def test_text_after_an_unclosed_unseen_element_stays(start, later):
    page = f"<body><nav>{start}</nav><article><p>One {start} two</p>{later}<p>Three</p></article><p>Four</p></body>"
    assert texts(page) == ["One two", "Three", "Four"]


def test_end_tags_outside_the_parent_are_not_the_elements_own():
    assert texts("<nav><button>Menu</nav><article><p>One</p></button><p>Two</p></article>") == ["Menu", "One", "Two"]
    assert texts("<div><select><option>a</div><p>One</p><div><select></select></div></select><p>Two") == ["a", "One", "Two"]


def test_closed_unseen_elements_give_no_text():
    page = "<p>a<svg><title>t</title><svg/><style/><g><svg><text>x</text></svg></g><foreignObject><div>y</div></foreignObject></svg>b<video><video>z</video><p>w</p></video>c<button><p>q</button>d"
    assert "".join(texts(page)).replace(" ", "") == "abcd"
    assert texts("<svg><title>Icon</svg><p>One</p><title>t</title>") == ["One"]


def test_head_without_its_end():
    for head in ("<head>", "<head class='menu'>", "<html><head><script>if (a</b) '<body>'</script>"):
        for body in ("<body>", "", "<body class=x>"):
            assert texts(f"{head}<title>T</title><meta charset=utf-8><style>p{{}}</style><link href=x>{body}<article><p>One</p></article>") == ["One"]
    page = "<html><head><title>T</title><body><article><h1>Title words</h1><p>" + "Some long main text of the page. " * 20 + "</p></article></body></html>"
    assert "Some long main text" in html_crf.default_model().extract(page)


def test_raw_text_without_its_end():
    assert texts("<head><title>T</head><body><p>One</p>") == ["One"]
    assert texts("<head><style>p{}<body><p>One</p>") == ["One"]
    assert texts("<article><p>One</p><script>var a = '<p>';</article><p>Two</p>") == ["One", "Two"]
    assert texts("<article><p>One</p><script>var a = '<p>';") == ["One"]
    assert texts("<div><textarea></div><p>One</p>") == ["One"]
    assert texts("<noscript>n</noscript><iframe src=x><p>One</p>") == ["One"]


def test_many_unclosed_elements_take_linear_time():
    at = time.monotonic()
    for tag in ("button", "textarea", "svg", "title"):
        assert texts(f"<nav>{f'<{tag}>' * 20000}</nav>{f'</{tag}>' * 20000}<p>One")[-1:] == (["One"] if tag != "title" else ["One"])
    assert time.monotonic() - at < 20
