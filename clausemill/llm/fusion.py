"""One ranking from several differently scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.sources.tables import staged

#: Score column -> whether small is good.
SCORES = {"dense_rank": True, "sparse_rank": True, "rerank_score": False, "fused_score": False}
K = 60


def candidates(retrieved: DataFrame) -> DataFrame:
    """One row per query and chunk; of repeated rows each score keeps its best value, a NaN counting as missing."""
    best = [(F.min if low else F.max)(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c) for c, low in SCORES.items()]
    return retrieved.where("query_id is not null and chunk_id is not null").groupBy("query_id", "chunk_id").agg(*best)


def ranks(items: DataFrame) -> DataFrame:
    """(query_id, score, chunk_id, rank): 1 + the number of strictly better values of the query in that score.

    The values are range-partitioned by query, score and value, so that the candidates of a hot query lie in many
    partitions; each ranks its own slice, and the sizes of the slices before it are added. A missing value has no row.
    """
    better = F.array(*[F.struct(F.lit(c).alias("score"), (F.col(c) if low else -F.col(c)).alias("cost")) for c, low in SCORES.items()])
    long = items.select("query_id", "chunk_id", F.explode(better).alias("s")).select("query_id", "chunk_id", "s.score", "s.cost").where("cost is not null")
    sliced = staged(long.repartitionByRange("query_id", "score", "cost").withColumn("slice", F.spark_partition_id()), "p6_slices")
    local = sliced.withColumn("rank", F.rank().over(W.partitionBy("slice", "query_id", "score").orderBy("cost")))
    sizes = sliced.groupBy("query_id", "score", "slice").agg(F.count("*").alias("n"))
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("query_id", "score").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return local.join(ahead, ["query_id", "score", "slice"]).select("query_id", "score", "chunk_id", (F.col("rank") + F.col("ahead")).alias("rank"))


def fuse(retrieved: DataFrame, k: int = K) -> DataFrame:
    """One row per query and distinct chunk: its rank in each score, the fused score and its place.

    fused = sum of 1 / (k + rank) over the scores it has: only ranks count, so no score weighs more for its range,
    and a missing score adds nothing. Ties go to the smaller chunk_id. Rows without query_id or chunk_id are left out;
    a chunk without any score comes last with 0; an empty table gives no rows; other columns are ignored.
    """
    items = staged(candidates(retrieved), "p6_items")
    by = ranks(items).groupBy("query_id", "chunk_id").agg(*[F.max(F.when(F.col("score") == c, F.col("rank"))).alias(f"r_{c}") for c in SCORES])
    total = sum((F.coalesce(1.0 / (k + F.col(f"r_{c}")), F.lit(0.0)) for c in list(SCORES)[1:]), F.coalesce(1.0 / (k + F.col(f"r_{next(iter(SCORES))}")), F.lit(0.0)))
    # Twelve decimals: the same order whichever way the sum was made.
    scored = items.select("query_id", "chunk_id").join(by, ["query_id", "chunk_id"], "left").withColumn("rrf", F.round(total, 12))
    sliced = staged(scored.repartitionByRange("query_id", F.col("rrf").desc(), "chunk_id").withColumn("slice", F.spark_partition_id()), "p6_fused")
    local = sliced.withColumn("place", F.row_number().over(W.partitionBy("slice", "query_id").orderBy(F.col("rrf").desc(), "chunk_id")))
    ahead = sliced.groupBy("query_id", "slice").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("query_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return local.join(ahead, ["query_id", "slice"]).select("query_id", "chunk_id", *[F.col(f"r_{c}").cast("long").alias(f"r_{c}") for c in SCORES], "rrf", (F.col("place") + F.col("ahead")).cast("long").alias("place"))


def winners(retrieved: DataFrame) -> DataFrame:
    """The chunk that is first in the fused ranking and, strictly, alone first in each of the four scores."""
    fused = fuse(retrieved)
    firsts = [F.col(f"r_{c}") == 1 for c in SCORES]
    one = fused.groupBy("query_id").agg(*[F.sum(F.when(x, 1).otherwise(0)).alias(f"n{i}") for i, x in enumerate(firsts)])
    alone = one.where(" and ".join(f"n{i} = 1" for i in range(len(firsts)))).select("query_id")
    top = fused.where("place = 1")
    for x in firsts:
        top = top.where(x)
    return top.join(alone, "query_id", "left_semi").select("query_id", "chunk_id")
