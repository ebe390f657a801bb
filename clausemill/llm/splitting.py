"""Splitting oversized texts at natural boundaries, by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
#: Ends of a word, a sentence, a line and a paragraph, with the white space after them; the strength of a boundary is the last that matches.
_ENDS = (re.compile(r"\s+"), re.compile(r"[.!?;:][”’\"')\]]*\s+"), re.compile(r"[ \t\r\f\v]*\n[ \t\r\f\v]*"), re.compile(r"[ \t\r\f\v]*\n[ \t\r\f\v]*(?:\n[ \t\r\f\v]*)+"))
_OUT = "chunk_id string, part int, num_parts int, start_char int, end_char int, boundary string, text string"
KINDS = ("cut", "word", "sentence", "line", "paragraph")


def atoms(text: str, most: int) -> list[tuple[int, int]]:
    """(end, strength of the boundary there) of the atomic segments: sentences, lines and paragraphs, and of a longer one its words.

    A word longer than `most` is cut into segments of it, of strength 0.
    """
    strong: dict[int, int] = {}
    for k in (2, 3, 4):
        for m in _ENDS[k - 1].finditer(text):
            strong[m.end()] = k
    strong[len(text)] = 4
    out, at = [], 0
    for end in sorted(strong):
        if end == 0:
            continue
        if end - at > most:
            cuts = [at + m.end() for m in _ENDS[0].finditer(text[at:end]) if at + m.end() < end]
            low = at
            for c in [*cuts, end]:
                while c - low > most:
                    low += most
                    out.append((low, 0))
                if c < end and c > low:
                    out.append((c, 1))
                    low = c
        out.append((end, strong[end]))
        at = end
    return out


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of the pieces; each but the first starts `overlap` before the end of the one before.

    Adjacent segments lie in a heap by the strength of the boundary between them; the weakest is merged first, and
    among equals the smaller pair, while the merged size and the overlap fit. Sizes only grow, so a pair that does not fit is final.
    """
    if len(text) <= limit:
        return [(0, len(text), 4)]
    most = limit - overlap
    ends = atoms(text, most)
    n = len(ends)
    start = [0] + [e for e, _ in ends[:-1]]
    stop, strength = [e for e, _ in ends], [s for _, s in ends]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strength[i], stop[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not alive[i] or not alive[j] or after[i] != j or stop[j] - start[i] != size or size > (most if start[i] else limit):
            continue
        alive[j] = False
        stop[i], strength[i], after[i] = stop[j], strength[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (strength[i], stop[after[i]] - start[i], i, after[i]))
        if before[i] >= 0:
            b = before[i]
            heapq.heappush(heap, (strength[b], stop[i] - start[b], b, i))
    out, i = [], 0
    while i < n:
        out.append((max(0, start[i] - overlap), stop[i], strength[i]))
        i = after[i]
    return out


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each text longer than `limit` characters, numbered anew; a chunk_id delivered again counts once.

    Every piece has at most `limit` characters (code points), repeats the last `overlap` characters of the one before, and ends
    at a paragraph, line, sentence or word end where there is one; leaving out the repeats gives the text back. Null,
    short and empty texts and rows without chunk_id give no rows; an empty table gives none. The JVM drops short texts
    before anything is sent to Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = cut(text, limit, overlap)
                rows += [(chunk_id, k, len(got), a, b, KINDS[s], text[a:b]) for k, (a, b, s) in enumerate(got, 1)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])

    long = chunks.select("chunk_id", "text").where(F.col("chunk_id").isNotNull() & (F.char_length("text") > limit))
    return long.groupBy("chunk_id").agg(F.min("text").alias("text")).mapInArrow(run, _OUT)


def rejoined(parts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, text_md5, sound): each text put together again from its pieces without their repeats, and whether the pieces keep the rules:
    at most `limit` characters, numbered 1 to num_parts, each the stretch it says it is, and the repeat of `overlap` characters (of all there are) equal."""
    rows = parts.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("part", "num_parts", "start_char", "end_char", "text"))).alias("ps"))
    whole = F.aggregate("ps", F.lit(""), lambda acc, p: F.concat(acc, F.substr(p["text"], F.char_length(acc) - p["start_char"] + 1)))
    following = F.zip_with(F.slice("ps", F.lit(1), F.size("ps") - 1), F.slice("ps", F.lit(2), F.greatest(F.size("ps") - 1, F.lit(0))), lambda a, b: (b["part"] == a["part"] + 1) & (a["end_char"] - b["start_char"] == F.least(F.lit(overlap), a["end_char"])) & F.endswith(a["text"], F.substr(b["text"], F.lit(1), a["end_char"] - b["start_char"])))
    each = F.forall("ps", lambda p: (F.char_length(p["text"]) <= limit) & (F.char_length(p["text"]) == p["end_char"] - p["start_char"]) & (p["num_parts"] == F.size("ps")))
    return rows.select("chunk_id", F.md5(whole.cast("binary")).alias("text_md5"), (each & F.forall(following, lambda x: x) & (F.element_at("ps", 1)["part"] == 1)).alias("sound"))
