"""Whole-corpus encoding with a public byte-level BPE vocabulary, by contiguous rank arrays."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's public pattern, fixed by its makers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same classes listed: white space as Unicode defines it, and letters and numbers of text that has only the Latin
#: blocks and common signs, where the plain engine will do and is several times faster.
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_L, _N = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_ANY = regex.compile(PATTERN.replace(r"\s\p", f"{_S}\\p").replace(r"\S", f"[^{_S}]").replace(r"\s", f"[{_S}]"))
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf\\ufffd]")
#: A space beside other white space, with which the pattern may take it as one word.
_BESIDE = re.compile(f" [{_S}]|[{_S}] ")
#: Words up to so many bytes are merged on the flat array; longer ones through a heap. The memo is emptied at its bound.
SHORT, MEMO = 200, 400_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Contiguous rank array: part boundaries and the rank of each adjacent pair; the least pair loses its boundary."""
    never = len(ranks) + (1 << 30)
    edge = list(range(len(word) + 1))
    pair = [ranks.get(word[i : i + 2], never) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == never:
            break
        i = pair.index(least)
        del edge[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[edge[i] : edge[i + 2]], never)
        if i:
            pair[i - 1] = ranks.get(word[edge[i - 1] : edge[i + 1]], never)
    return [ranks[word[a:b]] for a, b in zip(edge, edge[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in the same order for a word too long to scan again and again: a heap over linked parts."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop or not alive[j]:
            continue
        alive[j], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def split_words(text: str) -> list[str]:
    """The vocabulary's own split of a text into words."""
    return (_ANY if _OTHER.search(text) else _LATIN).findall(text)


class _Words(dict):
    """Word -> its ids, packed as 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        got = [whole] if whole is not None else (merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks)
        self[word] = packed = np.array(got, np.int32).tobytes()
        return packed


class _Units(dict):
    """What stands between two single spaces -> the packed ids of it and the space before it."""

    def __init__(self, words: _Words):
        self.words = words

    def __missing__(self, unit: str) -> bytes:
        got = b"".join(map(self.words.__getitem__, split_words(" " + unit)))
        if len(unit) <= SHORT:
            self[unit] = got
        return got


class Encoder:
    """Encodes texts, each word once.

    No word of the pattern goes on over a space with no white space beside it: one begins there. So a text all of whose spaces
    stand so, and none at its ends, falls apart at them, and the parts are looked up whole; any other text is split by the pattern.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.words = _Words(ranks)
        self.units = _Units(self.words)

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        for memo in (self.words, self.units):
            if len(memo) > MEMO:
                memo.clear()
        units = text.split(" ")
        if not units[0] or not units[-1] or _BESIDE.search(text):
            return b"".join(map(self.words.__getitem__, split_words(text)))
        first = b"".join(map(self.words.__getitem__, split_words(units.pop(0))))
        return first + b"".join(map(self.units.__getitem__, units))

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


_encoders: dict[int, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; its memo outlives the batch."""
    got = _encoders.get(shared.id)
    if got is None:
        got = _encoders[shared.id] = Encoder(shared.broadcast.value)
    return got


class _Shared:
    """A broadcast and its number: 50 thousand ranks, whatever the corpus."""

    def __init__(self, spark, path: str):
        self.broadcast = spark.sparkContext.broadcast(load_ranks(path))
        self.id = f"{path}:{spark.sparkContext.applicationId}"


def encode(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of each document, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text; repeated rows give
    repeated rows; an empty table gives none; other columns are ignored. No shuffle: one pass over the texts.
    """
    shared = _Shared(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder_of(shared)
        for batch in batches:
            packed = [one.packed(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int64)
            np.cumsum([len(p) >> 2 for p in packed], out=offsets[1:])
            flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, keep..., n_tokens): the length of each text in tokens; 0 for null and empty texts."""
    shared = _Shared(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder_of(shared)
        for batch in batches:
            n = [len(one.packed(t)) >> 2 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int32())], names=[*batch.schema.names[1:], "n_tokens"])

    kinds = dict(documents.dtypes)
    schema = ", ".join(f"{c} {'long' if c == 'doc_id' else kinds[c]}" for c in ("doc_id", *keep)) + ", n_tokens int"
    return documents.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *keep).mapInArrow(run, schema)
