"""Search: BM25 over an inverted index, exact dense top-k in blocks, rank fusion, reranking, and their combination."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators.ranking import top_k
from clausemill.sources.tables import staged

#: Fixed values of the ranking function, and the sizes of the result lists.
K1, B, EPSILON = 1.5, 0.75, 0.25
TOP_N, TOP_K, RRF_K = 40, 6, 60
#: Query vectors that go to all workers at once; more are taken in turns.
QUERY_BLOCK = 20_000
#: Pairs of a question and a document that a task scores at once, and that it keeps, at least, before it cuts them to the best of each question;
#: scores of a term in a document that it holds at once, rows of a batch that it gives.
PAIRS_AT_ONCE, PAIRS, TABLE, ROWS = 250_000, 500_000, 1_000_000, 10_000


# --- BM25 ---------------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, length): one row per document and distinct term. Documents without a token have none."""
    split = docs.select(F.col(key).alias("key"), T.tokens(text).alias("tokens"))
    return split.select("key", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def corpus_statistics(docs: DataFrame, post: DataFrame, key: str, text: Column) -> DataFrame:
    """One row: documents, mean length, distinct terms, mean raw IDF. All documents count, those without tokens too."""
    sizes = docs.select(F.size(T.tokens(text)).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return df.join(F.broadcast(sizes)).groupBy("n", "mean_length").agg(F.count("*").alias("terms"), F.avg(raw).alias("mean_idf"))


def inverse_frequencies(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): log-odds; a negative one becomes EPSILON times the mean."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return df.join(F.broadcast(stats)).select("term", "df", F.when(raw < 0, EPSILON * F.col("mean_idf")).otherwise(raw).alias("idf"), "mean_length")


class _Best:
    """The k best (score, key) of each question so far: rows that reach a question's k-th score are kept, and cut now and then.

    Documents are known by number, and their keys are compared only where rows are cut.
    """

    def __init__(self, questions: int, k: int):
        self.k, self.floor, self.held, self.rows = k, np.full(questions, -np.inf), [], 0
        self.keys, self.known, self.most = [np.zeros(0, object)], 0, max(PAIRS, 3 * k * questions // 2)

    def documents(self, keys: list[str]) -> int:
        """The number of the first of these documents."""
        if self.known > self.most:
            q, score, doc = self.cut()
            used, doc = np.unique(doc, return_inverse=True)
            self.keys, self.known, self.held = [np.concatenate(self.keys)[used]], len(used), [(q, score, doc.astype(np.int32))]
        self.keys.append(np.array(keys, object))
        self.known += len(keys)
        return self.known - len(keys)

    def add(self, q: np.ndarray, scores: np.ndarray, doc: np.ndarray, least: float = -np.inf) -> None:
        """The scores, above `least`, of questions (rows) and documents (columns)."""
        low = self.floor[q]
        new = ~np.isfinite(low)
        if scores.shape[1] >= self.k and new.any():
            low[new] = np.partition(scores[new], -self.k, axis=1)[:, -self.k]
            low = np.where(low > least, np.round(low, 9), -np.inf)
            self.floor[q] = low
        rows, cols = np.nonzero(scores >= np.maximum(low - 2e-9, np.nextafter(least, np.inf))[:, None])
        score = np.round(scores[rows, cols], 9)
        ok = score >= low[rows]  # ties may still have the smaller key
        self.held.append((q[rows[ok]].astype(np.int32), score[ok], doc[cols[ok]].astype(np.int32)))
        self.rows += int(ok.sum())
        if self.rows > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, score, doc = (np.concatenate(c) for c in zip(*self.held)) if self.held else (np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32))
        used, place = np.unique(doc, return_inverse=True)
        by_key = np.empty(len(used), np.int32)
        by_key[np.argsort(np.concatenate(self.keys)[used], kind="stable")] = np.arange(len(used))
        order = np.lexsort((by_key[place], -score, q))
        q, score, doc = q[order], score[order], doc[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = place == self.k - 1
        self.floor[q[last]] = score[last]
        keep = place < self.k
        self.held, self.rows = [(q[keep], score[keep], doc[keep])], int(keep.sum())
        return self.held[0]

    def batches(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, score, doc = self.cut()
        keys = np.concatenate(self.keys)
        for i in range(0, len(q), ROWS):
            some = slice(i, i + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(names[q[some]], pa.string()), pa.array(keys[doc[some]], pa.string()), pa.array(score[some], pa.float64())], names=["query_id", "key", "score"])


class _Sides:
    """Which questions meet which documents: those without a group all of them, the others those of their group."""

    def __init__(self, groups: list[str | None], order: np.ndarray):
        self.free, self.of = order[[groups[q] is None for q in order]] if len(order) else order, {}
        for q in order:
            if groups[q] is not None:
                self.of.setdefault(groups[q], []).append(q)

    def of_block(self, own: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(questions, places of their documents in the block, None for all of them), at most PAIRS_AT_ONCE pairs at a time."""
        places: dict[str, list[int]] = {}
        for i, g in enumerate(own if self.of else []):
            if g in self.of:
                places.setdefault(g, []).append(i)
        for q, at in [(self.free, None), *((np.array(self.of[g]), np.array(at)) for g, at in places.items())]:
            step = max(1, PAIRS_AT_ONCE // (len(own) if at is None else len(at)))
            for i in range(0, len(q), step):
                yield q[i : i + step], at


def _spread(rows: DataFrame) -> DataFrame:
    """As many tasks as there are cores, at most, since each of them gives the best of every question."""
    return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def _bm25_block(asked: list[tuple[str, dict[str, int], str | None]], idf: dict[str, float], mean_length: float, held: DataFrame, k: int) -> DataFrame:
    terms = {t: i for i, t in enumerate(sorted(idf))}
    # The terms of each question side by side, filled up with one that no document has and that weighs nothing.
    mine = [[(terms[t], n * idf[t]) for t, n in times.items() if t in terms] for _, times, _ in asked]
    sizes = np.array([len(m) for m in mine])
    slots = np.full((len(asked), max(1, int(sizes.max()))), len(terms), np.int32)
    weights = np.zeros(slots.shape)
    for i, m in enumerate(mine):
        if m:
            slots[i, : len(m)], weights[i, : len(m)] = zip(*m)
    order = np.argsort(sizes, kind="stable")
    sides = _Sides([g for _, _, g in asked], order[sizes[order] > 0])
    names = np.array([q for q, _, _ in asked], object)
    shared = held.sparkSession.sparkContext.broadcast((list(terms), slots, weights, sizes, names, sides, min(idf.values(), default=1.0) > 0))

    def sums(table: np.ndarray, slot: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.take(table, slot[:, 0], axis=0)
        out *= weight[:, :1]
        part = np.empty_like(out)
        for j in range(1, slot.shape[1]):
            np.take(table, slot[:, j], axis=0, out=part, mode="clip")
            part *= weight[:, j : j + 1]
            out += part
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, slots, weights, sizes, names, sides, positive = shared.value
        best, known = _Best(len(names), k), pa.array(terms, pa.string())
        size = min(2048, max(1, TABLE // (len(terms) + 1)))
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                docs, tokens = part.num_rows, part.column(2)
                lengths = np.nan_to_num(pc.list_value_length(tokens).to_numpy(zero_copy_only=False)).astype(np.int64)
                of = np.repeat(np.arange(docs), lengths)
                term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                found = term >= 0
                if not found.any():
                    continue
                times = np.bincount(term[found] * docs + of[found], minlength=(len(terms) + 1) * docs).reshape(len(terms) + 1, docs).astype(np.float64)
                held = None if positive else times > 0
                table = times * (K1 + 1)
                table /= times + K1 * (1 - B + B * lengths / mean_length)
                del times
                first = best.documents(part.column(0).to_pylist())
                for q, at in sides.of_block(part.column(1).to_pylist()):
                    wide = int(sizes[q].max())
                    slot, weight = slots[q, :wide], weights[q, :wide]
                    columns = np.arange(docs) if at is None else at
                    scores = sums(table if at is None else table[:, at], slot, weight)
                    if not positive:  # then a score does not tell whether the two share a token
                        both = sums((held if at is None else held[:, at]).astype(np.float64), slot, np.ones(slot.shape))
                        scores[both == 0] = -np.inf
                    best.add(q, scores, first + columns, 0.0 if positive else -np.inf)
        yield from best.batches(names)

    return _spread(held).mapInArrow(run, "query_id string, key string, score double")


@dataclass
class Tokenized:
    """Texts by tokens, staged: held (key, own, tokens), df (term, df), and stats (n, mean_length, mean_idf), None without a token."""

    held: DataFrame
    df: DataFrame
    stats: Row | None


def tokenized(docs: DataFrame, key: str, text: Column, group: Column | None = None) -> Tokenized:
    """What `bm25` needs of the documents, for several searches."""
    held = staged(docs.select(F.col(key).cast("string").alias("key"), (F.lit(None).cast("string") if group is None else group).alias("own"), T.tokens(text).alias("tokens")).where("key is not null"), "bm25_tokens")
    size = held.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean_length"))
    df = staged(held.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "bm25_terms")
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return Tokenized(held, df, df.join(F.broadcast(size)).groupBy("n", "mean_length").agg(F.avg(raw).alias("mean_idf")).first())


def bm25(questions: DataFrame, docs: DataFrame, key: str, text: Column, k: int = TOP_N, group: Column | None = None, ready: Tokenized | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each question that share a token with it.

    questions has query_id and raw_query; a token repeated in the question counts as often. With `group`, a value of each document,
    a question whose doc_id is not null is only answered from the documents of that group. Scores are rounded to nine
    decimals before they are ranked and ties go to the smaller key, so the result does not depend on the order of
    sums. Null and empty texts count in the statistics and are never found.

    Texts are tokenized once, or before (`ready`, from `tokenized` with the same arguments). Each task goes over its documents with a block of questions,
    scores them against each other some at a time, and keeps the k best of each question, so the shuffle carries at most k rows a task and question;
    QUERY_BLOCK bounds the block.
    """
    ready = ready or tokenized(docs, key, text, group)
    held, df, stats = ready.held, ready.df, ready.stats
    columns = "query_id string, key string, score double"
    parts = None
    if stats is not None:
        restricted = group is not None and "doc_id" in questions.columns
        asked = questions.where("query_id is not null").select("query_id", T.tokens(F.col("raw_query")).alias("tokens"), (F.col("doc_id") if restricted else F.lit(None).cast("string")).alias("of"))
        block: list[tuple[str, dict[str, int], str | None]] = []
        rows = asked.toLocalIterator()
        while True:
            row = next(rows, None)
            if row is not None:
                block.append((row["query_id"], dict(Counter(row["tokens"])), row["of"]))
            if block and (row is None or len(block) == QUERY_BLOCK):
                wanted = held.sparkSession.createDataFrame([(t,) for t in sorted({t for _, ts, _ in block for t in ts})] or [("",)], "term string")
                found = df.join(F.broadcast(wanted), "term").collect()  # at most the tokens of a block of questions
                idf = {}
                for r in found:
                    x = math.log(stats["n"] - r["df"] + 0.5) - math.log(r["df"] + 0.5)
                    idf[r["term"]] = EPSILON * stats["mean_idf"] if x < 0 else x
                one = _bm25_block(block, idf, stats["mean_length"], held, k)
                parts, block = one if parts is None else parts.unionByName(one), []
            if row is None:
                break
    if parts is None:
        parts = docs.sparkSession.createDataFrame([], columns)
    return top_k(parts, ["query_id"], [F.col("score").desc(), F.col("key")], k)


# --- dense --------------------------------------------------------------------------------------------------------


def _dense_block(ids: np.ndarray, matrix: np.ndarray, groups: np.ndarray | None, rows: DataFrame, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, qgroup = shared.value
        best_s, best_v = np.full((len(qid), k), -np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
        for batch in batches:
            vec, group = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)
            norm = np.sqrt((v * v).sum(axis=1))
            for i in range(0, len(vec), 2048):
                s = np.round(q @ v[i : i + 2048].T / np.where(norm[i : i + 2048] > 0, norm[i : i + 2048], 1.0), 9)
                if qgroup is not None:
                    s[qgroup[:, None] != group[None, i : i + 2048]] = -np.inf
                every = np.concatenate([best_s, s], axis=1)
                keys = np.concatenate([best_v, np.broadcast_to(vec[i : i + 2048], s.shape)], axis=1)
                order = np.lexsort((keys, -every), axis=1)[:, :k]
                best_s, best_v = np.take_along_axis(every, order, 1), np.take_along_axis(keys, order, 1)
        real = np.isfinite(best_s)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, real.sum(axis=1))), pa.array(best_v[real]), pa.array(best_s[real])], names=["query_vec", "vec_id", "score"])

    return rows.mapInArrow(run, "query_vec long, vec_id long, score double")


def dense(vectors: DataFrame, queries: DataFrame, k: int = TOP_N, same_group: bool = False) -> DataFrame:
    """(query_vec, vec_id, score, rank): the k nearest vectors of each query by cosine, exactly.

    Both have vec_id, embedding and label. Each task multiplies its rows with a block of queries and keeps k a query, so the shuffle
    carries k rows a task and query; queries beyond QUERY_BLOCK are taken block by block. With same_group only
    vectors of the query's label are searched. Null vectors are left out; a zero vector has similarity 0 to all.
    """
    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("label").cast("long"), F.lit(-1)).alias("label"), "embedding")
    numbered_queries = queries.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("label").cast("long"), F.lit(-1)).alias("label"), "embedding")
    parts, block = None, []

    def flush() -> None:
        nonlocal parts, block
        if block:
            m = np.array([r["embedding"] for r in block], np.float64)
            n = np.sqrt((m * m).sum(axis=1, keepdims=True))
            one = _dense_block(np.array([r["vec_id"] for r in block], np.int64), m / np.where(n > 0, n, 1.0), np.array([r["label"] for r in block]) if same_group else None, rows, k)
            parts, block = one if parts is None else parts.unionByName(one), []

    for row in numbered_queries.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            flush()
    flush()
    if parts is None:
        return rows.sparkSession.createDataFrame([], "query_vec long, vec_id long, score double, rank int")
    return top_k(parts, ["query_vec"], [F.col("score").desc(), F.col("vec_id")], k)


def dense_texts(questions: DataFrame, vectors: DataFrame, embedder: Callable[[list[str], str], np.ndarray], k: int = TOP_N) -> DataFrame:
    """(query_id, key, rank): the k nearest texts of each question (query_id, raw_query, doc_id) by the embedder, in the agreement doc_id where it is not null.

    vectors has key, own (the agreement) and embedding. Questions are embedded on the driver in blocks of QUERY_BLOCK; each task keeps k a question.
    """

    def block(asked: list) -> DataFrame:
        q = np.asarray(embedder([r["raw_query"] or "" for r in asked], "query"), np.float64)
        sides = _Sides([r["doc_id"] for r in asked], np.arange(len(asked)))
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in asked], object), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12), sides))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, unit, sides = shared.value
            best = _Best(len(names), k)
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    v = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    first = best.documents(part.column(0).to_pylist())
                    for rows, at in sides.of_block(part.column(1).to_pylist()):
                        columns = np.arange(len(v)) if at is None else at
                        best.add(rows, unit[rows] @ v[columns].T, first + columns)
            yield from best.batches(names)

        return _spread(vectors.where("embedding is not null").select("key", "own", "embedding")).mapInArrow(run, "query_id string, key string, score double")

    parts, held = vectors.sparkSession.createDataFrame([], "query_id string, key string, score double"), []
    for row in questions.where("query_id is not null").select("query_id", "raw_query", "doc_id").toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            parts, held = parts.unionByName(block(held)), []
    parts = parts.unionByName(block(held)) if held else parts
    return top_k(parts, ["query_id"], [F.col("score").desc(), F.col("key")], k).select("query_id", "key", "rank")


# --- fusion and reranking -----------------------------------------------------------------------------------------


def reciprocal_ranks(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Fuse (query_id, key, retriever, rank): score, ranks by retriever, and place.

    The union of the lists, not their meeting. A retriever without a weight counts 1. Order: score, best single rank, key.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("retriever") == name, F.lit(float(w))).otherwise(weight)
    best = lists.groupBy("query_id", "key", "retriever").agg(F.min("rank").alias("rank"))
    fused = best.groupBy("query_id", "key").agg(
        F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", "rank")))).alias("ranks")
    )
    return top_k(fused, ["query_id"], [F.col("score").desc(), F.col("best_rank"), F.col("key")], 2**31 - 1, "place")


Reranker = Callable[[DataFrame], Column]


def no_rerank(candidates: DataFrame) -> Column:
    """Keeps the order: 1, 1/2, 1/3, ..."""
    return 1.0 / F.col("place")


def overlap_rerank(candidates: DataFrame) -> Column:
    """An offline stand-in for a cross-encoder: the part of the question's tokens that the text has. A heuristic, no model."""
    asked, held = F.array_distinct(T.tokens(F.col("raw_query"))), T.tokens(F.col("text"))
    return F.coalesce(F.size(F.array_intersect(asked, held)) / F.greatest(F.size(asked), F.lit(1)), F.lit(0.0))


RERANKERS: dict[str, Reranker] = {"none": no_rerank, "overlap": overlap_rerank}


def reranker(name: str) -> Reranker:
    """A reranker by name; hosted ones can be added to RERANKERS."""
    if name not in RERANKERS:
        raise ValueError(f"no reranker {name!r}; there are {sorted(RERANKERS)}")
    return RERANKERS[name]


def hybrid(questions: DataFrame, dense_list: DataFrame, chunks: DataFrame, use_dense: bool = True, use_sparse: bool = True, rerank: str = "none", top_n: int = TOP_N, top_n_k: int = TOP_K, weights: dict[str, float] | None = None, group: Column | None = None, ready: Tokenized | None = None) -> DataFrame:
    """(query_id, key, fused_score, best_rank, place, rerank_score, final): dense and BM25 lists fused, cut to top_n, reranked, cut to top_n_k.

    dense_list has query_id, key and rank. With `group`, questions that have a doc_id are searched in that group only, and `ready` has the tokens (see `bm25`). Switching both
    retrievers off is an error.
    """
    if not (use_dense or use_sparse):
        raise ValueError("at least one retriever must be on")
    lists = []
    if use_dense:
        lists.append(dense_list.where(F.col("rank") <= top_n).select("query_id", "key", F.lit("dense").alias("retriever"), "rank"))
    if use_sparse:
        lists.append(bm25(questions, chunks, "chunk_id", T.indexed_text(), top_n, group, ready).select("query_id", "key", F.lit("sparse").alias("retriever"), "rank"))
    both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    fused = reciprocal_ranks(both, weights).where(F.col("place") <= top_n)
    held = fused.join(chunks.select(F.col("chunk_id").alias("key"), "text"), "key", "left").join(questions.select("query_id", "raw_query"), "query_id", "left")
    scored = held.withColumn("rerank_score", reranker(rerank)(held))
    final = top_k(scored, ["query_id"], [F.col("rerank_score").desc(), F.col("place")], top_n_k, "final")
    return final.select("query_id", "key", F.col("score").alias("fused_score"), "best_rank", "place", "rerank_score", "final")


def recall(found: DataFrame, judgments: DataFrame, grade: int = 2) -> DataFrame:
    """(query_id, relevant, hits): judged chunks of at least `grade`, and how many of them were found. Of two grades the better counts."""
    good = judgments.groupBy("query_id", F.col("chunk_id").alias("key")).agg(F.max("grade").alias("grade")).where(F.col("grade") >= grade)
    hit = found.select("query_id", "key").distinct().withColumn("hit", F.lit(1))
    return good.join(hit, ["query_id", "key"], "left").groupBy("query_id").agg(F.count("*").alias("relevant"), F.count("hit").alias("hits"))


def for_display(found: DataFrame) -> DataFrame:
    """Scores as they are shown: four decimals, five for fused scores; the text as its first 300 characters."""
    decimals = {"score": 4, "fused_score": 5, "rerank_score": 4}
    shown = found.withColumns({c: F.round(c, n) for c, n in decimals.items() if c in found.columns})
    return shown.withColumn("excerpt", F.substring("text", 1, 300)).drop("text") if "text" in found.columns else shown
