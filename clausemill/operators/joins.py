"""Joins that stand hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Join `many` with `one`, which has one small row a key: each key's rows in `many` are spread over `salts` tasks by a hash of `spread`.

    `one` is repeated `salts` times. Null keys match nothing.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def sifted(rows: DataFrame, wanted: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The rows whose key is in `wanted`, and hardly any others, so that the rest need not be shuffled; all rows where `wanted` has more than `most` keys.

    Numbers of the keys are broadcast, eight bytes each; a join with `wanted` must follow.
    """
    numbers = wanted.select(F.xxhash64(key).alias("_number")).distinct()
    if numbers.count() > most:
        return rows
    return rows.withColumn("_number", F.xxhash64(key)).join(F.broadcast(numbers), "_number", "left_semi").drop("_number")
