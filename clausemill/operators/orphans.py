"""References to records that do not exist: range-partitioned sorted parents, probed by binary search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.sources.tables import staged

#: Rows of parents in one range, at most so many ranges (larger ones beyond), and references in one batch of a range.
RANGE_ROWS, MOST_RANGES, BATCH_ROWS = 100_000, 20_000, 200_000
LISTS = ("cross_references", "cross_reference_ids", "definition_ids")
_OUT = "chunk_id string, ref_field string, target string, first_at timestamp_ntz, reason string"


def label_key(label: Column) -> Column:
    """A section label without case, blanks at the ends and full stops at the end."""
    return F.regexp_replace(F.lower(label), r"^\s+|[\s.]+$", "")


def chunk_times(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id: earliest and latest indexed_at over all its deliveries."""
    return chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.min("indexed_at").alias("first_at"), F.max("indexed_at").alias("last_at"))


def parents(chunks: DataFrame, sections: DataFrame, deletions: DataFrame) -> DataFrame:
    """Every key a reference can name: (key, first_at, deleted).

    Keys are `C` and the chunk_id, or `S`, the agreement and the section label. A deleted chunk whose rows are gone is
    kept as a key without first_at.
    """
    gone = deletions.where("chunk_id is not null").groupBy("chunk_id").agg(F.max("deleted_at").alias("deleted_at"))
    of_chunks = chunk_times(chunks).join(gone, "chunk_id", "full").select(
        F.concat(F.lit("C\x1f"), "chunk_id").alias("key"),
        "first_at",
        (F.col("deleted_at").isNotNull() & ~F.coalesce(F.col("last_at") > F.col("deleted_at"), F.lit(False))).alias("deleted"),
    )
    of_sections = (
        sections.select(F.concat(F.lit("S\x1f"), "doc_id", F.lit("\x1f"), label_key(F.col("section_id"))).alias("key"), "parsed_at")
        .where("key is not null")
        .groupBy("key")
        .agg(F.min("parsed_at").alias("first_at"))
        .withColumn("deleted", F.lit(False))
    )
    return of_chunks.unionByName(of_sections)


def _named(name: str) -> Column:
    return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.struct(F.lit(name).alias("ref_field"), x.alias("target")))


def references(chunks: DataFrame) -> DataFrame:
    """One row per chunk, list and distinct element as stored: (chunk_id, ref_field, target, key, first_at).

    Null and blank elements are no references. first_at is the chunk's earliest indexed_at.
    """
    lists = F.concat(*[_named(c) for c in LISTS])
    rows = (
        chunks.where("chunk_id is not null")
        .select("chunk_id", "doc_id", F.explode(lists).alias("e"))
        .select("chunk_id", "doc_id", "e.ref_field", "e.target")
        .where(F.length(F.regexp_replace("target", r"^\s+|\s+$", "")) > 0)
        .groupBy("chunk_id", "ref_field", "target")
        .agg(F.min("doc_id").alias("doc_id"))
    )
    key = F.when(F.col("ref_field") == "cross_references", F.concat(F.lit("S\x1f"), F.coalesce("doc_id", F.lit("")), F.lit("\x1f"), label_key(F.col("target")))).otherwise(F.concat(F.lit("C\x1f"), "target"))
    return rows.join(chunk_times(chunks).select("chunk_id", "first_at"), "chunk_id").select("chunk_id", "ref_field", "target", key.alias("key"), "first_at")


_RANGE = "low string, keys array<string>, times array<long>, deleted array<boolean>"
#: The time of a parent without one.
_NEVER = np.iinfo(np.int64).min


def ranges(keyed: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(low, keys, times, deleted): the parents, cut into ranges of their keys of about equal size, each one row of sorted arrays."""
    rows = keyed.count()
    wanted = max(1, -(-rows // max(range_rows, -(-rows // MOST_RANGES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            keys = t["key"].to_pylist()
            cols = [pa.array([v], k) for v, k in zip((keys[0], keys, t["at"].to_pylist(), t["deleted"].to_pylist()), (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.bool_())))]
            yield pa.RecordBatch.from_arrays(cols, names=["low", "keys", "times", "deleted"])

    at = F.coalesce(F.unix_micros(F.col("first_at").cast("timestamp")), F.lit(_NEVER))
    return keyed.select("key", at.alias("at"), "deleted").repartitionByRange(wanted, "key").sortWithinPartitions("key").mapInArrow(run, _RANGE)


def probe(refs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """One batch against the sorted parent array of its range: the misses, with their reason."""
    keys, times, gone = (np.asarray(known[c].iloc[0]) if len(known) else np.zeros(0, kind) for c, kind in (("keys", object), ("times", np.int64), ("deleted", bool)))
    wanted = refs["key"].to_numpy(object)
    if len(keys):
        near = np.minimum(np.searchsorted(keys.astype(object), wanted), len(keys) - 1)
        hit = keys[near] == wanted
        first, deleted = times[near].astype(np.int64), hit & gone[near].astype(bool)
    else:
        hit = deleted = np.zeros(len(wanted), bool)
        first = np.full(len(wanted), _NEVER)
    own = refs["first_at"].to_numpy("datetime64[us]")
    late = hit & (first != _NEVER) & ~np.isnat(own) & (first > own.astype(np.int64))
    reason = np.select([deleted, ~hit, late], ["deleted", "missing", "late"], "")
    return refs[["chunk_id", "ref_field", "target", "first_at"]].assign(reason=reason)[reason != ""]


def orphans(chunks: DataFrame, sections: DataFrame, deletions: DataFrame, range_rows: int = RANGE_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """References that name no record, or one deleted or later than the reference.

    Parents are cut into ranges of their keys and stored as one row of sorted arrays each; the references of a range are probed by binary search
    in batches of about `batch_rows`. A hot range (a key named by a third of all references) is split into several batches, each of which gets
    the range's arrays. Broadcast are the least keys of the ranges and their numbers of batches: at most MOST_RANGES of each.
    Nulls: rows without chunk_id and null or blank elements give nothing; a chunk without times is never `late`.
    Repeated rows count once; empty tables give no rows; extra columns are ignored.
    """
    refs = staged(references(chunks), "p1_refs")
    stored = staged(ranges(staged(parents(chunks, sections, deletions), "p1_parents"), range_rows), "p1_ranges")
    lows = sorted(r["low"] for r in stored.select("low").collect())
    shared = refs.sparkSession.sparkContext.broadcast(np.array(lows, object))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(shared.value, keys.to_numpy(object), side="right") - 1, 0) if len(shared.value) else np.zeros(len(keys)), dtype="int32")

    placed = staged(refs.withColumn("range_no", range_of("key")), "p1_placed")
    batches = placed.groupBy("range_no").agg(F.ceil(F.count("*") / F.lit(batch_rows)).cast("int").alias("batches"))
    left = placed.join(F.broadcast(batches), "range_no").withColumn("batch_no", F.pmod(F.xxhash64("chunk_id", "ref_field", "target"), F.col("batches")).cast("int"))
    right = stored.withColumn("range_no", range_of("low")).join(F.broadcast(batches), "range_no").withColumn("batch_no", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    left = left.select("range_no", "batch_no", "chunk_id", "ref_field", "target", "key", "first_at")
    right = right.select("range_no", "batch_no", "keys", "times", "deleted")
    return left.groupBy("range_no", "batch_no").cogroup(right.groupBy("range_no", "batch_no")).applyInPandas(probe, _OUT)


def orphan_report(found: DataFrame) -> DataFrame:
    """Misses per list, target table and month of the referring chunk's time."""
    return (
        found.withColumn("target_table", F.when(F.col("ref_field") == "cross_references", "sections").otherwise("chunks"))
        .withColumn("month", F.date_format("first_at", "yyyy-MM"))
        .groupBy("ref_field", "target_table", "month", "reason")
        .agg(F.count("*").alias("orphans"), F.countDistinct("chunk_id").alias("referring_chunks"))
    )
