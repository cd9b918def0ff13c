"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

A text is cut at single spaces where that can't change what the pattern matches (both
sides are non-space characters), and only pieces not seen before in this worker go through
the pattern and the merges. Pieces of a text's pattern matches that are whole tokens are looked up; the rest are
bucketed by length into padded matrices of ids. Each round looks all adjacent pairs
up in an open-addressing hash table of merges, merges every row's leftmost pair of minimum rank and
closes the gap; rows without a pair left are done and the matrix is compacted. Ids then
match what the rank file's own library gives.

A match of over ``LONG`` bytes is cut into rows of ``PART`` bytes. Ids are those of the whole match if and only if every
two neighbours t, u stay apart when the bytes of t and u are merged by themselves: as long as no merge has crossed a seam,
the merges between two neighbours are those of their bytes alone, in the same order, so a first merge across a seam
would be one there, too. Where a seam fails, the tokens about it are merged anew over a window that doubles until
its ends hold, so a match takes time in proportion to its length unless its ids depend on text far away.

The piece cache holds at most ``CACHE`` pieces and is emptied when full, so memory is bounded; results
don't depend on it. Defined cases: null is the empty text (no id); lone surrogates cannot occur in
Spark strings; strings of special tokens are ordinary text; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE, LONGEST_CACHED, LONG, PART = 500_000, 64, 512, 256
_NONE = np.int64(1) << 40
WIDE = 1 << 27
#: One run of non-space characters, with at most the one space before it.
PLAIN = re.compile(r" ?\S+\Z").match
_UNSAFE = re.compile(r" (?:\s|\Z)")


class Ranks:
    """A rank file: token bytes to id, and the hashed table of merges (left id, right id) -> id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        left, right, rank = [], [], []
        get = self.ids.get
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(i)
        self._build(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int64))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _build(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.values = np.full(size + 64, -1, np.int64), np.full(size + 64, _NONE, np.int64)
        keys = (left << 32) | right
        slots, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):  # round p places what finds its p-th slot free
            at = slots[todo] + self.probes
            if at.max() >= len(self.keys):
                self.keys, self.values = np.append(self.keys, np.full(64, -1)), np.append(self.values, np.full(64, _NONE))
            free = self.keys[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], rank[todo[put]]
            todo = todo[~put]
            self.probes += 1

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id each pair merges into, or a number above all ids."""
        keys = (left << 32) | right
        at = self._slot(np.where(right < 0, 0, keys))
        out = np.where(self.keys[at] == keys, self.values[at], _NONE)
        for p in range(1, self.probes):
            hit = self.keys[at + p] == keys
            if hit.any():
                out = np.where(hit, self.values[at + p], out)
        return np.where((left < 0) | (right < 0), _NONE, out)

    def merge_rows(self, ids: np.ndarray) -> list[list[int]]:
        """Ids of each row of a matrix padded with -1, after all merges."""
        done: list[list[int]] = [[]] * len(ids)
        where = np.arange(len(ids))
        pairs = self.merged(ids[:, :-1], ids[:, 1:])
        while len(where):
            best = pairs.argmin(1) if pairs.shape[1] else np.zeros(len(where), int)
            rank = pairs[np.arange(len(where)), best] if pairs.shape[1] else np.full(len(where), _NONE)
            ended = rank >= _NONE
            if ended.any():
                sizes = (ids[ended] >= 0).sum(1).tolist()
                for w, row, size in zip(where[ended].tolist(), ids[ended].tolist(), sizes, strict=True):
                    done[w] = row[:size]
                live = ~ended
                where, ids, pairs, best, rank = where[live], ids[live], pairs[live], best[live], rank[live]
                if not len(where):
                    break
            rows, width = np.arange(len(where)), ids.shape[1]
            ids[rows, best] = rank
            gap = np.arange(width - 1)[None, :]
            ids = np.take_along_axis(ids, gap + (gap > best[:, None]), 1)
            gap = gap[:, : width - 2]
            pairs = np.take_along_axis(pairs, gap + (gap > best[:, None]), 1)  # drops the pair after the merged one
            for side in (-1, 0):
                at = best + side
                fits = (at >= 0) & (at < width - 2)
                pairs[rows[fits], at[fits]] = self.merged(ids[rows[fits], at[fits]], ids[rows[fits], at[fits] + 1])
            used = int((ids >= 0).sum(1).max())
            ids, pairs = ids[:, :used], pairs[:, : max(0, used - 1)]
        return done

    def encode_matches(self, matches: list[bytes]) -> list[list[int]]:
        """Ids of each match."""
        if max(map(len, matches), default=0) <= LONG:
            return self._encode_rows(matches)
        parts = [[m] if len(m) <= LONG else [m[a : a + PART] for a in range(0, len(m), PART)] for m in matches]
        rows = iter(self._encode_rows([p for ps in parts for p in ps]))
        return [self._joined([next(rows) for _ in ps]) for ps in parts]

    def _joined(self, rows: list[list[int]]) -> list[int]:
        """The ids of a match from those of its parts."""
        ids = rows[0] if len(rows) == 1 else [i for r in rows for i in r]
        seams = set(np.cumsum([len(r) for r in rows[:-1]]).tolist())  # places in ``ids`` not yet known to hold
        reach = 4
        while seams:
            at = sorted(seams)
            pairs = self._encode_rows([self.bytes[ids[s - 1]] + self.bytes[ids[s]] for s in at])
            failed = [s for s, got in zip(at, pairs, strict=True) if got != [ids[s - 1], ids[s]]]
            if not failed:
                break
            spans: list[list[int]] = []
            for s in failed:
                a, b = max(0, s - reach), min(len(ids), s + reach)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            fresh = self._encode_rows([self.decode(ids[a:b]) for a, b in spans])
            made: list[int] = []
            seams, last = set(), 0
            for (a, b), new in zip(spans, fresh, strict=True):
                made += ids[last:a]
                seams |= {len(made), len(made) + len(new)}
                made += new
                last = b
            ids = made + ids[last:]
            seams -= {0, len(ids)}
            reach *= 2
        return ids

    def _encode_rows(self, matches: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(matches)
        buckets: dict[int, list[int]] = {}
        for i, m in enumerate(matches):
            if (known := self.ids.get(m)) is not None:
                out[i] = [known]
            else:
                buckets.setdefault(len(m) if len(m) <= 16 else 1 << (len(m) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                some = [matches[i] for i in part]
                sizes = np.fromiter(map(len, some), np.int64, len(some))
                padded = b"".join(some if width <= 16 else [m.ljust(width, b"\0") for m in some])
                matrix = self.single[np.frombuffer(padded, np.uint8).reshape(-1, width)]
                if width > 16:
                    matrix[np.arange(width) >= sizes[:, None]] = -1
                for i, ids in zip(part, self.merge_rows(matrix), strict=True):
                    out[i] = ids
        return out

    def encode_pieces(self, fresh: list[str]) -> list[list[int]]:
        """Ids of each piece; all pieces' distinct matches are merged together.

        Plain pieces are matched in one call, joined by line feeds: none can join a match across."""
        plain = [p for p in fresh if PLAIN(p)]
        matches: dict[str, list[str]] = {}
        joined = self.pattern.findall("\n".join([*plain, ""]))
        at = 0
        for p in plain:
            end = joined.index("\n", at)
            matches[p] = joined[at:end]
            at = end + 1
        for p in fresh:
            if p not in matches:
                matches[p] = self.pattern.findall(p)
        distinct = list({m for ms in matches.values() for m in ms})
        ids = dict(zip(distinct, self.encode_matches([m.encode() for m in distinct]), strict=True))
        return [ids[ms[0]] if len(ms) == 1 else [i for m in ms for i in ids[m]] for ms in map(matches.__getitem__, fresh)]

    def decode(self, ids: Iterator[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def pieces(text: str) -> list[str]:
    """The text in pieces (all but the first begin with a space) whose matches are the whole text's."""
    if _UNSAFE.search(text):
        # White space runs around these spaces stay inside one piece.
        cuts = [m.start() for m in re.finditer(r"(?<=\S) (?=\S)", text)]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    first, *rest = text.split(" ")
    return [first, *(" " + r for r in rest)]


class Encoder:
    """Encodes texts in batches; ``render`` turns a piece's ids into what is cached for it."""

    def __init__(self, encode, render, most: int):
        self.encode, self.render, self.most, self.known = encode, render, most, {}

    def look_up(self, distinct: list[str]) -> list:
        """What is known of each piece; new ones are encoded together."""
        if len(self.known) > self.most:
            self.known.clear()
        found = list(map(self.known.get, distinct))
        fresh = [p for p, v in zip(distinct, found, strict=True) if v is None]
        if fresh:
            made = dict(zip(fresh, map(self.render, self.encode(fresh)), strict=True))
            found = [made[p] if v is None else v for p, v in zip(distinct, found, strict=True)]
            self.known.update((p, v) for p, v in made.items() if len(p) <= LONGEST_CACHED)
        return found

    def __call__(self, texts: list[str | None]) -> Iterator[list]:
        for at in range(0, len(texts), 256):
            cut = [pieces(t) if t else [] for t in texts[at : at + 256]]
            if len(self.known) > self.most:
                self.known.clear()
            get = self.known.get
            found = [list(map(get, ps)) for ps in cut]
            fresh = list({p for ps, vs in zip(cut, found, strict=True) if None in vs for p, v in zip(ps, vs, strict=True) if v is None})
            if fresh:
                self.known.update(zip(fresh, map(self.render, self.encode(fresh)), strict=True))
            for ps, vs in zip(cut, found, strict=True):
                yield list(map(get, ps)) if None in vs else vs
            for p in fresh:
                if len(p) > LONGEST_CACHED:
                    del self.known[p]


#: One encoder per rank file and use, kept while the Python worker lives.
_ENCODERS: dict[tuple, Encoder] = {}


def shared_encoder(key: tuple, make) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = make()
    return _ENCODERS[key]


@dataclass
class Words:
    """The pieces of the texts in which every space is a single one: ``distinct`` pieces, their ``codes`` in the order of
    the texts, and where each text begins and ends in them."""

    plain: np.ndarray
    distinct: list[str]
    codes: np.ndarray
    bounds: np.ndarray


def words_of(texts: pa.Array, skip: re.Pattern | None = None) -> Words:
    """Words are told apart by Arrow, once a batch. Null, empty and other texts, and those that hold ``skip``, are not ``plain``."""
    every = texts.to_pylist()
    plain = np.array([bool(t) and not _UNSAFE.search(t) and not (skip and skip.search(t)) for t in every], bool)
    lists = pc.split_pattern(texts.filter(pa.array(plain, pa.bool_())).cast(pa.large_string()), " ")
    words = lists.flatten()
    if not len(words):
        return Words(plain, [], np.zeros(0, np.int64), np.zeros(1, np.int64))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # A text's first word has no space before it.
    known, starts = coded.dictionary.to_pylist(), bounds[:-1]
    firsts = words.take(pa.array(starts)).dictionary_encode()
    codes[starts] = len(known) + firsts.indices.to_numpy()
    return Words(plain, [*(" " + w for w in known), *firsts.dictionary.to_pylist()], codes, bounds)


@lru_cache(maxsize=4)
def load_ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def digests(texts: pa.Array, encoder: Encoder) -> tuple[list[int], list[str], list[str]]:
    """Number of ids, digest of the ids and digest of the decoded bytes of each text. ``encoder`` renders a piece as (n, ids as
    decimal text, bytes)."""
    # Arrow joins within 32-bit offsets; a batch with a text near that size is joined piece by piece.
    words = words_of(texts if texts.nbytes < WIDE else pa.nulls(len(texts), pa.string()))
    made = encoder.look_up(words.distinct)
    sizes = np.array([m[0] for m in made], np.int64)[words.codes] if made else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))[words.bounds]
    joined = []
    for i, mark in ((1, b","), (2, b"")):
        parts = pa.array([m[i] for m in made], pa.binary()).take(pa.array(words.codes))
        joined.append(iter(pc.binary_join(pa.ListArray.from_arrays(pa.array(words.bounds, pa.int32()), parts), pa.scalar(mark, pa.binary())).to_pylist()))
    counts = iter(np.diff(ends).tolist())
    others = encoder([t for t, ok in zip(texts.to_pylist(), words.plain.tolist(), strict=True) if not ok])
    n, ids, data = [], [], []
    for ok in words.plain.tolist():
        if ok:
            n.append(next(counts))
            # Only a text's first piece can be empty; it leaves a comma.
            text, decoded = next(joined[0]).removeprefix(b","), next(joined[1])
        else:
            parts = next(others)
            n.append(sum(p[0] for p in parts))
            text, decoded = b",".join([p[1] for p in parts if p[0]]), b"".join([p[2] for p in parts])
        ids.append(hashlib.sha256(text).hexdigest())
        data.append(hashlib.sha256(decoded).hexdigest())
    return n, ids, data


def round_trip(docs: DataFrame, *, path: str, pattern: str, id_cols: list[str], text_col: str = "text", step: int = 512) -> DataFrame:
    """``id_cols``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path, pattern)
        encoder = shared_encoder(("digest", path, pattern), lambda: Encoder(ranks.encode_pieces, lambda ids: (len(ids), ",".join(map(str, ids)).encode(), ranks.decode(ids)), CACHE))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            parts = [digests(texts.slice(at, step), encoder) for at in range(0, len(texts), step)]
            made = [[x for p in parts for x in p[i]] for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(m, t) for m, t in zip(made, (pa.int64(), pa.string(), pa.string()), strict=True))], names=[*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(*id_cols, F.col(text_col).cast("string").alias("_text"))
    fields = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1])
    return kept.mapInArrow(run, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, *, path: str, pattern: str, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and ``ids`` (array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path, pattern)
        encoder = shared_encoder(("ids", path, pattern), lambda: Encoder(ranks.encode_pieces, tuple, CACHE))
        for batch in batches:
            ids = [[i for part in p for i in part] for p in encoder(batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "ids"])

    kept = docs.select(*id_cols, F.col(text_col).cast("string").alias("_text"))
    fields = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1])
    return kept.mapInArrow(run, f"{fields}, ids array<int>")


def decode(encoded: DataFrame, *, path: str, pattern: str, id_cols: list[str], ids_col: str = "ids") -> DataFrame:
    """``id_cols`` and ``data`` (binary) of every row of ids; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path, pattern)
        for batch in batches:
            data = [ranks.decode(ids or []) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(data, pa.binary())], names=[*batch.schema.names[:-1], "data"])

    kept = encoded.select(*id_cols, F.col(ids_col).alias("_ids"))
    fields = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1])
    return kept.mapInArrow(run, f"{fields}, data binary")
