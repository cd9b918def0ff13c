"""Sequence packing: first-fit decreasing on a tournament tree of bin capacities.

A document is its token ids and a closing id. It is cut every ``capacity`` ids, so all pieces but
its last are full sequences of their own and are never split further. Documents are dealt at random, each with
all its pieces, over groups of ``group`` documents on average; in each group, first-fit decreasing puts every piece
into the first open bin that holds it. A tournament tree over the bins keeps the largest free capacity of each
subtree, so the first fitting bin is found in log2(bins) steps.

The deal is a hash of the document's scan task and place, not of its content, so copies and repeated ids spread
evenly; more documents give more groups, never larger ones. Padding: sequences that end below
``capacity`` are padded to it unless their length is a power of two.

Defined cases: null and empty texts are one piece holding the closing id only; documents of any length
are cut as above; repeated ids give separate pieces; an empty table gives no piece; extra columns are
ignored. Added tokens of the tokenizer file are read as its library reads them by default: their strings give their ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.bpe import Encoder, shared_encoder, words_of

GROUP, CACHE = 4096, 100_000


class TournamentTree:
    """First-fit over bins: leaves are free capacities, inner nodes the larger of their two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """The first bin with ``size`` free, which it then takes."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        free[at] -= size
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    order = np.argsort(-sizes, kind="stable")
    tree, bins, offsets = TournamentTree(len(sizes), capacity), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        size = int(sizes[i])
        b = tree.put(size)
        bins[i] = b
        offsets[i] = capacity - tree.free[tree.leaves + b] - size
    return bins, offsets


#: One run of characters below U+0530 that no library counts as white space, with at most one space before it.
_COMMON = re.compile(r" ?[^\s\u0530-\U0010ffff]+\Z").match


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Texts on which the file's own pattern and the ranks' must agree: contractions, digits, signs, white space, other scripts.
PROBES = (
    "It's we'll DON'T 'tis I'Ve 12345 3rd x1y2 _a_ snake_case a-b a/b e.g. (x) [y] {z} \"q\" 50% $5.00 #tag @me a+b=c <b> &amp; ~^|\\`",
    " one  two   three\tfour\n five\r\n\r\n  six \x0b\x0c seven \u00a0 eight\u2003nine ", "Ärger ñandú Straße İstanbul ŒUVRE ¿qué? «x» „y“ ½ ² №", "привет, мир! Ελληνικά 漢字かな中文 한국어 हिन्दी עברית العربية ไทย", "😀👩‍👩‍👧 e\u0301 \u200b\ufeff",
)


def _rank_encoding(path: str, library):
    """The tokenizer file as ranks for the tiktoken library, which gives the same ids in a quarter of the time; None unless it is a
    plain byte-level BPE whose merges stand in the order of their ids and both give the same ids of ``PROBES``."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, split = made["model"], made["pre_tokenizer"] or {}
    pairs = [m if isinstance(m, str) else "".join(m) for m in model.get("merges", [])]
    order = [model["vocab"].get(p.replace(" ", ""), -1) for p in pairs]
    level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = made.get("normalizer") or made.get("post_processor") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not level or odd or order != sorted(set(order)) or -1 in order:
        return None
    special, of = {t["content"] for t in made["added_tokens"]}, byte_characters()
    ranks = {bytes(of[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    found = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return found if all(found.encode(t) == library.encode(t, add_special_tokens=False).ids for t in PROBES) else None


def _library_encoder(path: str) -> Encoder:
    """Piece ids as the tokenizers library gives them, as little-endian bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    line = made.encode("\n", add_special_tokens=False).ids
    ranked = _rank_encoding(path, made) if len(line) == 1 else None

    def library(some: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in made.encode_batch_fast(some, add_special_tokens=False)]

    def encode(fresh: list[str]) -> list[bytes]:
        # Common pieces go in one text, a line feed after each: no token can join across it.
        common = [p for p in fresh if _COMMON(p)] if ranked else []
        ids = ranked.encode_to_numpy("\n".join([*common, ""]), disallowed_special=()).astype("<u4", copy=False) if common else np.zeros(0, "<u4")
        ends = np.flatnonzero(ids == line[0]) if common else ids
        if len(ends) != len(common):
            return library(fresh)
        data, at, out = ids.tobytes(), 0, []
        for end in (4 * ends).tolist():
            out.append(data[at:end])
            at = end + 4
        if len(common) == len(fresh):
            return out
        known = dict(zip(common, out, strict=True))
        rest = [p for p in fresh if p not in known]
        known.update(zip(rest, library(rest), strict=True))
        return [known[p] for p in fresh]

    out = Encoder(encode, lambda data: data, CACHE)
    added = [t.content for t in made.get_added_tokens_decoder().values()]
    out.added = re.compile("|".join(map(re.escape, added))) if added else None
    out.whole = lambda text: library([text])[0]
    return out


def whole_texts(texts: list[str | None], encoder: Encoder) -> Iterator[bytes]:
    """The ids of texts by the encoder's pieces; those that hold an added token's string go to the library whole."""
    plain = encoder([None if t and encoder.added and encoder.added.search(t) else t for t in texts])
    for text, parts in zip(texts, plain, strict=True):
        yield encoder.whole(text) if text and encoder.added and encoder.added.search(text) else b"".join(parts)


def batch_ids(texts: pa.Array, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, and where each text begins and ends in it.

    Words of texts whose every space is a single one are told apart once a batch and encoded once; ids are then gathered. The
    other texts go through the encoder's own pieces."""
    every, words = texts.to_pylist(), words_of(texts, encoder.added)
    plain, codes, bounds = words.plain, words.codes, words.bounds
    made = encoder.encode(words.distinct) if words.distinct else []
    rest = list(whole_texts([t for t, ok in zip(every, plain, strict=True) if not ok], encoder))
    table = np.frombuffer(b"".join([*made, *rest]), "<u4")
    sizes = np.array([len(m) for m in (*made, *rest)], np.int64) // 4
    # One entry for each word of a plain text and one for each other text, in the order of the texts.
    entries = np.ones(len(every), np.int64)
    entries[plain] = np.diff(bounds)
    last = np.cumsum(entries)
    order = np.empty(int(last[-1]) if len(last) else 0, np.int64)
    other = np.ones(len(order), bool)
    whole = last[~plain] - 1
    other[whole] = False
    order[other], order[whole] = codes, len(made) + np.arange(len(whole))
    length = sizes[order]
    ends = np.cumsum(length)
    ids = table[np.repeat((np.cumsum(sizes) - sizes)[order] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return ids, np.concatenate([[0], ends[last - 1]]) if len(last) else np.zeros(1, np.int64)


def _documents(texts: pa.Array, encoder: Encoder, step: int = 1024) -> Iterator[bytes]:
    for at in range(0, len(texts), step):
        ids, bounds = batch_ids(texts.slice(at, step), encoder)
        data = ids.tobytes()
        yield from (data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def tokenised(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, closing: int = 0, groups: int = 1) -> DataFrame:
    """Pieces: _id, start, length, ids_crc32, doc_tokens and the group that their document is dealt to."""
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, made = shared_encoder(("library", path), lambda: _library_encoder(path)), TaskContext.get().partitionId(), 0
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, data in enumerate(_documents(batch.column(1), encoder)):
                data += end
                n = len(data) // 4
                for at in range(0, n, capacity):
                    size = min(capacity, n - at)
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    total.append(n)
            place = np.arange(made, made + batch.num_rows, dtype=np.uint64) + (np.uint64(task) << np.uint64(40))
            made += batch.num_rows
            mixed = (place ^ (place >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            group = ((mixed >> np.uint64(16)) % np.uint64(groups)).astype(np.int64)[np.array(row, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(group)], names=["_id", "start", "length", "ids_crc32", "doc_tokens", "group"])

    kept = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string"))
    return kept.mapInArrow(run, f"_id {kept.dtypes[0][1]}, start long, length long, ids_crc32 long, doc_tokens long, group long")


def pack(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, closing: int = 0, group: int = GROUP) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The number of groups follows the number of documents (a count that Parquet answers from its footers)."""
    groups = max(1, -(-docs.count() // group))
    pieces = tokenised(docs, path=path, id_col=id_col, text_col=text_col, capacity=capacity, closing=closing, groups=groups)

    def fill(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("length", "ids_crc32", "start", "_id")])
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), capacity)
        sequence = (part["group"].to_numpy() << 32) + bins
        return part.drop_columns("group").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    kind = docs.schema[id_col].dataType.simpleString()
    packed = pieces.groupBy("group").applyInArrow(fill, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("_id", id_col)
