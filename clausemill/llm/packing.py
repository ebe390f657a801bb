"""Filling fixed-capacity containers: deficit round-robin over source queues, with deficits carried along."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.bpe import VOCABULARY, token_counts
from clausemill.operators.ranking import running
from clausemill.sources.tables import staged

CAPACITY, GROUP_ROWS = 2048, 5000
_OUT = "doc_id long, piece int, start_token int, n_tokens int, source string, container_id long, at_token int"


def fill(items: list[tuple[int, str]], capacity: int, share: dict[str, float], carry: dict[str, float]) -> list[tuple[int, int, int]]:
    """Place items (size, source) in windows: (item, window, offset) of each, windows numbered from 0.

    Every source is a queue ordered by size. A window gives each source its share of the capacity as credit; the source
    with the largest credit places its largest item that still fits and pays for it, and the window closes when no
    queue has one. Credits, paid too much or not spent, go on to the next window, and come in from earlier groups.
    """
    queues: dict[str, list[tuple[int, int]]] = {}
    for i, (size, source) in enumerate(items):
        queues.setdefault(source, []).append((size, i))
    for q in queues.values():
        q.sort()
    credit = {s: carry.get(s, 0.0) for s in queues}
    placed, window = [], 0
    while queues:
        for s in queues:
            credit[s] += share.get(s, 0.0) * capacity
        room, at = capacity, 0
        order = sorted((-credit[s], s) for s in queues)
        while order:
            for k, (_, s) in enumerate(order):
                q = queues[s]
                j = bisect_right(q, (room, len(items))) - 1
                if j >= 0:
                    size, i = q.pop(j)
                    placed.append((i, window, at))
                    room, at = room - size, at + size
                    credit[s] -= size
                    del order[k]
                    if q:
                        insort(order, (-credit[s], s))
                    else:
                        del queues[s]
                    break
            else:
                break
        window += 1
    return placed


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Texts longer than the capacity become pieces of it and a rest; any other text stays whole (piece 0)."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    return (
        sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("start_token", F.col("piece") * capacity)
        .withColumn("n_tokens", F.least(F.lit(capacity), F.col("n_tokens") - F.col("start_token")))
    )


def pack(documents: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The container and the place in it of every document, measured in tokens.

    Documents are dealt by a hash to groups of about `group_rows`, so a hot source is spread over all of them; each
    group fills its own windows. The target proportions are the sources' shares of all tokens, and a group starts with
    the credits that the groups before it leave, known from their token sums. A text is split only if it alone is
    longer than the capacity. Null and empty texts have 0 tokens and are placed too; a null source is a source of its
    own (''); repeated rows are placed once each; an empty table gives no rows; other columns are ignored.
    """
    sized = staged(
        pieces(token_counts(documents.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit(""))), ("source",), vocabulary), capacity),
        "p8_sizes",
    )
    groups = max(1, -(-sized.count() // group_rows))
    sized = sized.withColumn("group_no", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    sums = staged(sized.groupBy("group_no", "source").agg(F.sum("n_tokens").alias("tokens")), "p8_sums")
    total = sums.groupBy().agg(F.sum("tokens").alias("all_tokens"))
    shares = sums.groupBy("source").agg(F.sum("tokens").alias("source_tokens")).join(F.broadcast(total)).select("source", (F.col("source_tokens") / F.greatest(F.col("all_tokens"), F.lit(1))).alias("share"))
    # What the groups before have placed, in all and of each source: running sums in slices, less the group's own.
    ahead = running(sums.groupBy("group_no").agg(F.sum("tokens").alias("t")), "group_no", ["t"]).select("group_no", (F.col("sum_t") - F.col("t")).alias("ahead"))
    carried = (
        running(sums, "group_no", ["tokens"], "source")
        .withColumn("own", F.col("sum_tokens") - F.col("tokens"))
        .join(shares, "source")
        .join(ahead, "group_no")
        .select("group_no", "source", "share", (F.col("share") * F.col("ahead") - F.col("own")).alias("carry"))
    )

    def run(key: tuple, docs: pd.DataFrame, mix: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        placed = fill(list(zip(docs["n_tokens"].tolist(), docs["source"].tolist())), capacity, dict(zip(mix["source"], mix["share"])), dict(zip(mix["source"], mix["carry"])))
        at = np.array(placed, np.int64).reshape(-1, 3)
        out = docs.iloc[at[:, 0]][["doc_id", "piece", "start_token", "n_tokens", "source"]]
        return out.assign(container_id=(int(key[0]) << 32) + at[:, 1], at_token=at[:, 2].astype(np.int32))

    sized = sized.select("group_no", "doc_id", "piece", "start_token", "n_tokens", "source")
    return sized.groupBy("group_no").cogroup(carried.groupBy("group_no")).applyInPandas(run, _OUT)


def mixture(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(source, target, containers, mean_gap, within_tenth): how near the containers come to the target proportions.

    target is the source's share of all tokens; mean_gap is the mean difference of its share of a container from it, over all
    containers, in parts of the capacity; within_tenth is the part of the containers where that is at most 0.1.
    """
    packed = staged(packed, "p8_packed")
    held = packed.groupBy("container_id", "source").agg(F.sum("n_tokens").alias("n"))
    size = packed.agg(F.sum("n_tokens").alias("all_tokens"), F.countDistinct("container_id").alias("containers"))
    share = packed.groupBy("source").agg(F.sum("n_tokens").alias("n_all")).join(F.broadcast(size)).select("source", "containers", (F.col("n_all") / F.greatest(F.col("all_tokens"), F.lit(1))).alias("target"))
    gap = F.abs(F.col("n") / capacity - F.col("target"))
    met = held.join(share, "source").groupBy("source", "target", "containers").agg(F.count("*").alias("with"), F.sum(gap).alias("gaps"), F.sum(F.when(gap <= 0.1, 1).otherwise(0)).alias("near"))
    without = F.col("containers") - F.col("with")  # containers that hold nothing of the source
    return met.select("source", F.round("target", 6).alias("target"), "containers", F.round((F.col("gaps") + without * F.col("target")) / F.col("containers"), 6).alias("mean_gap"), F.round((F.col("near") + F.when(F.col("target") <= 0.1, without).otherwise(0)) / F.col("containers"), 6).alias("within_tenth"))
