"""The packed ids are those of the tokenizers library, on whatever path they come."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from ledgerline.llm import packing

TEXTS = [
    "Plain words, it's 'll don't we've 12345 x1y2  two  spaces ", "tab\tand\nline\r\n\n end\n", "", " ", "\n", "a b  c \x1c d \x0b e\u0085f", "naïve Ärger größer Straße ñandú", "привет мир ελληνικά",
    "漢字 かな हिन्दी עברית العربية", "é combining ‍​ zero", "😀 👩‍👩‍👧 emoji", "<|endoftext|> special <|endoftext|>", "a <|endoftext|> b  <|endoftext|>c<|endoftext|", " ".join(["word"] * 5000 + ["<|endoftext|>"]), "!!! ??? --- ... $$$ €5", "x" * 3000, " ".join(f"w{i}q{i * 7919}" for i in range(3000)), "퟿ \U0010ffff", "'S 'T 'RE it'S",
]


def test_ids_are_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = Tokenizer.from_file(path)
    want = [made.encode(t, add_special_tokens=False).ids for t in TEXTS]
    encoder = packing._library_encoder(path)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in packing.whole_texts(TEXTS, encoder)] == want
    assert any(50256 in w for w in want)  # the added token's own id
    for step in (1, 4, 1000):
        got = packing._documents(pa.array([*TEXTS, None, *TEXTS], pa.string()), encoder, step)
        assert [np.frombuffer(d, "<u4").tolist() for d in got] == [*want, [], *want]
    assert list(packing._documents(pa.array([], pa.string()), encoder)) == []
    assert list(packing._documents(pa.array([None, ""], pa.string()), encoder)) == [b"", b""]
    assert packing._rank_encoding(path, made) is not None
    other = Tokenizer.from_file(path)
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    assert packing._rank_encoding(path, other) is None  # the probes tell another pattern


def test_other_models_take_the_library(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing._rank_encoding(path, Tokenizer.from_file(path)) is None
