"""The chunk index as a table: what to embed, what is stale, upserts, deletions, batches."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.functions import structure as S
from clausemill.functions import text as T
from clausemill.operators.ranking import numbered

MODEL = "hashing-64"
#: Texts are batched inside blocks of so many in reading order, so that no task holds a whole corpus.
BLOCK, BATCH_TOKENS, BATCH_ITEMS = 1000, 8000, 128
DIMENSIONS = 64


def hashes(chunks: DataFrame, model: str = MODEL) -> DataFrame:
    """(chunk_id, content_hash, tokens): what each chunk's embedding depends on; changing the model changes every hash."""
    text = T.embedding_text()
    return chunks.select("chunk_id", T.content_hash(text, model).alias("content_hash"), T.estimated_tokens(text).alias("tokens"))


def plan(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """(chunk_id, action, tokens): embed (new or changed), keep, or delete (no longer there)."""
    old = indexed.select("chunk_id", F.col("content_hash").alias("old"))
    both = now.select("chunk_id", F.col("content_hash").alias("new"), "tokens").join(old, "chunk_id", "full")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("embed")
    return both.select("chunk_id", action.alias("action"), F.when(action == "embed", F.col("tokens")).otherwise(0).alias("tokens"))


def plan_summary(planned: DataFrame, tokens_per_minute: int = 10_000) -> DataFrame:
    return planned.groupBy("action").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / tokens_per_minute, 6).alias("minutes"))


def upsert(old: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The table after new rows replace old ones of the same chunk_id and `gone` ids are taken out. Doing it again changes nothing."""
    kept = old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new.dropDuplicates(["chunk_id"]))
    return kept if gone is None else kept.join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")


def state(chunks: DataFrame, deletions: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, deliveries, first_at, last_at): the index after all deliveries and deletions in order of time."""
    gone = deletions.groupBy("chunk_id").agg(F.max("deleted_at").alias("deleted_at"))
    held = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("deliveries"), F.min("indexed_at").alias("first_at"), F.max("indexed_at").alias("last_at"))
    return held.join(gone, "chunk_id", "left").where("deleted_at is null or last_at > deleted_at").drop("deleted_at")


def token_batches(chunks: DataFrame, most: int = BATCH_TOKENS, items: int = BATCH_ITEMS, block: int = BLOCK) -> DataFrame:
    """(chunk_id, block, batch, tokens): greedy batches in order of chunk_id, inside blocks of `block` texts; a text over `most` is a batch of its own."""
    costs = chunks.select(F.lit(1).alias("all"), "chunk_id", T.estimated_tokens(T.embedding_text()).alias("tokens"))
    placed = numbered(costs, ["all"], [F.col("chunk_id")], "no").select("chunk_id", "tokens", "no", F.floor((F.col("no") - 1) / block).cast("long").alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no").reset_index(drop=True)
        batch = np.zeros(len(pdf), np.int32)
        for k, at in enumerate(S.batches_by_size(pdf["tokens"].tolist(), most, items), 1):
            batch[at] = k
        return pd.DataFrame({"chunk_id": pdf["chunk_id"], "block": pdf["block"], "batch": batch, "tokens": pdf["tokens"]})

    return placed.groupBy("block").applyInPandas(run, "chunk_id string, block long, batch int, tokens int")


def packed_parts(chunks: DataFrame, limit: int = S.CHUNK_CHARS) -> DataFrame:
    """(chunk_id, part, num_parts, text): texts over the limit as packed paragraphs. One paragraph over it stays whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, k, len(ps), p) for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for ps in [S.packed(t, limit)] for k, p in enumerate(ps, 1)]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["chunk_id", "part", "num_parts", "text"])

    return chunks.where(F.char_length("text") > limit).select("chunk_id", "text").mapInArrow(run, "chunk_id string, part int, num_parts int, text string")


# --- embedders ----------------------------------------------------------------------------------------------------

#: Takes texts and says what they are for, "document" or "query"; models that tell the two apart embed them differently.
Embedder = Callable[[list[str], str], np.ndarray]


class _Places(dict):
    """Word -> twice its dimension, plus one where it counts negative."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        if len(self) > 150_000:
            self.clear()
        self[word] = place = h % DIMENSIONS * 2 + (not h & 0x10000)
        return place


_places, _TOKEN = _Places(), re.compile(T.TOKEN)


def hashing_embedder(texts: list[str], mode: str = "document") -> np.ndarray:
    """An offline embedder: signed hashing of words into DIMENSIONS, unit length, the same for documents and queries. Deterministic; it stands in for a hosted model."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        n = np.bincount(list(map(_places.__getitem__, _TOKEN.findall(t.lower()))) or [0, 1], minlength=2 * DIMENSIONS)
        out[i] = n[::2] - n[1::2]
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1.0)


EMBEDDERS: dict[str, Embedder] = {MODEL: hashing_embedder}


def embedder(model: str) -> Embedder:
    """An embedder by name; hosted ones can be added to EMBEDDERS."""
    if model not in EMBEDDERS:
        raise ValueError(f"no embedder {model!r}; there are {sorted(EMBEDDERS)}")
    return EMBEDDERS[model]


def request_tokens(tokens_per_minute: int, requests_per_minute: int) -> int:
    """Tokens of one request, so that a minute's requests use nine tenths of a minute's tokens; at least 1,000."""
    return max(1000, tokens_per_minute * 9 // (10 * max(1, requests_per_minute)))


class Pace:
    """Keeps the calls of one process under so many requests and tokens in any 60 seconds: `wait` sleeps until a call of some tokens fits.

    A call with more tokens than a minute allows goes alone, once the minute before it is empty. The windows of a whole log are `traces.rate`.
    """

    def __init__(self, requests: int, tokens: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most = np.array([requests, tokens], np.int64)
        self.clock, self.sleep = clock, sleep
        self.at, self.cost = np.zeros(0), np.zeros((0, 2), np.int64)

    def wait(self, tokens: int) -> float:
        """Seconds slept."""
        now = self.clock()
        recent = self.at > now - 60
        self.at, self.cost = self.at[recent], self.cost[recent]
        call = np.minimum([1, tokens], self.most)
        # What the window still holds after the first k calls have left it; the call starts when it fits.
        left = self.cost.sum(axis=0) - np.vstack([np.zeros((1, 2), np.int64), self.cost.cumsum(axis=0)])
        k = int(np.argmax((left + call <= self.most).all(axis=1)))
        pause = float(self.at[k - 1] + 60 - now) if k else 0.0
        if pause > 0:
            self.sleep(pause)
        self.at, self.cost = np.append(self.at, now + max(0.0, pause)), np.vstack([self.cost, [1, tokens]])
        return max(0.0, pause)


def embed(texts: DataFrame, key: str, text: str, model: str = MODEL, mode: str = "document") -> DataFrame:
    """(key, embedding): vectors in Arrow batches by the named embedder."""
    one = embedder(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = one([t or "" for t in batch.column(1).to_pylist()], mode)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(got), pa.list_(pa.float32()))], names=["key", "embedding"])

    return texts.select(F.col(key).cast("string").alias("key"), text).mapInArrow(run, "key string, embedding array<float>")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The vector table that `current.txt` under `path` names, or None if there is none yet."""
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current.txt")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/current.txt').first()[0]}")


def usable(table: DataFrame | None, dimensions: int) -> bool:
    """Whether a stored table can be kept: there is one and its vectors have the wanted dimension. An empty table fits any."""
    if table is None:
        return False
    row = table.select(F.size("embedding").alias("n")).where("n >= 0").first()
    return row is None or row["n"] == dimensions


def build(spark: SparkSession, chunks: DataFrame, path: str, model: str = MODEL, rebuild: bool = False) -> DataFrame:
    """Bring the vector table under `path` up to date and return the plan that was carried out.

    Only new and changed chunks are embedded. The new state is written beside the old one and then named in `current.txt`, so that a reader
    never sees half a table; a rebuild drops what is no longer there, and a table whose vectors have another dimension is made anew.
    """
    import uuid

    old = None if rebuild else stored(spark, path)
    if not usable(old, len(embedder(model)([""], "document")[0])):
        old = None
    now = hashes(chunks, model)
    planned = plan(now, old if old is not None else now.limit(0))
    todo = planned.where("action = 'embed'").select("chunk_id")
    fresh = embed(chunks.withColumn("_text", T.embedding_text()).join(todo, "chunk_id", "left_semi"), "chunk_id", "_text", model).withColumnRenamed("key", "chunk_id").join(now.select("chunk_id", "content_hash"), "chunk_id")
    fresh = fresh.select("chunk_id", "content_hash", "embedding")
    table = fresh if old is None else upsert(old, fresh, planned.where("action = 'delete'"))
    name = f"v-{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{name}")
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current.txt")
    out = pointer.getFileSystem(spark._jsc.hadoopConfiguration()).create(pointer, True)
    out.write(bytearray((name + "\n").encode()))
    out.close()
    return planned
