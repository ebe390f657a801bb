"""Sessions, traces and usage: append-only logs and the views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.operators.ranking import running, top_k

#: The keys of a trace that an update may set.
KEYS = (
    "query_type", "needs_retrieval", "sub_queries", "planner_reasoning", "iteration", "iterations", "sufficient", "missing_info", "sections_needed", "terms_needed",
    "refine_strategy", "summary", "final_answer", "citations", "unverified_citations", "faithfulness", "low_confidence", "confidence", "latency_ms", "token_usage", "error",
)
UPDATE = "query_id string, seq long, node string, key string, value string"
HISTORY, WINDOW_MICROS = 50, 60_000_000


# --- writing --------------------------------------------------------------------------------------------------------


def updates_of(results: DataFrame, node: str, seq: Column | int = 0) -> DataFrame:
    """(query_id, seq, node, key, value): the trace updates that a step's result gives, one row per allowed column that has a value.

    Structs, lists and maps are written as JSON, other values as they print; columns that are no trace key stay out.
    """
    kinds = dict(results.dtypes)
    written = [F.struct(F.lit(c).alias("key"), (F.to_json(c) if kinds[c].startswith(("struct", "array", "map")) else F.col(c).cast("string")).alias("value")) for c in results.columns if c in KEYS]
    if not written:
        return results.sparkSession.createDataFrame([], UPDATE)
    seq = F.lit(seq) if isinstance(seq, int) else seq
    rows = results.select("query_id", seq.cast("long").alias("seq"), F.lit(node).alias("node"), F.explode(F.array(*written)).alias("w"))
    return rows.select("query_id", "seq", "node", "w.key", "w.value").where("value is not null")


def started(questions: DataFrame, at: Column | None = None) -> DataFrame:
    """The first row of each trace: status running, with session_id, raw_query and doc_id of the question."""
    return questions.select("query_id", "session_id", "raw_query", "doc_id", (F.current_timestamp() if at is None else at).alias("created_at"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"))


def ended(traces: DataFrame, errors: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """The last row of each started trace: complete, or failed with its message where `errors` (query_id, error) has one."""
    rows = traces.drop("error", "completed_at")
    rows = rows.withColumn("error", F.lit(None).cast("string")) if errors is None else rows.join(errors.groupBy("query_id").agg(F.min("error").alias("error")), "query_id", "left")
    done = F.col("error").isNull()
    return rows.withColumn("status", F.when(done, "complete").otherwise("failed")).withColumn("completed_at", F.when(done, F.current_timestamp() if at is None else at))


def save(rows: DataFrame, path: str) -> None:
    """Append trace rows to the log, in folders by day and sorted by session, so that a session or a time is read from few files."""
    day = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("none"))
    rows.withColumn("day", day).repartition("day", F.pmod(F.xxhash64("session_id"), F.lit(8))).sortWithinPartitions("day", "session_id").write.mode("append").partitionBy("day").parquet(path)


def public_state(results: DataFrame) -> DataFrame:
    """What a step's result shows outside: its context as a size, all else as it is."""
    return results.withColumn("context_size", F.size("context")).drop("context") if "context" in results.columns else results


# --- reading --------------------------------------------------------------------------------------------------------


def latest(traces: DataFrame) -> DataFrame:
    """One row per question: its last state; a finished state beats a running one, then the later one counts."""
    return top_k(traces.where("query_id is not null"), ["query_id"], [(F.col("status") == "running").asc(), F.col("created_at").desc(), F.col("iteration").desc(), F.col("last_node")], 1, "_n").drop("_n")


def merged(updates: DataFrame) -> DataFrame:
    """(query_id, fields, last_node) from updates (query_id, seq, node, key, value): the last write of each allowed key wins."""
    known = updates.where(F.col("key").isin(*KEYS)).dropDuplicates(["query_id", "seq", "key"])
    last = known.groupBy("query_id", "key").agg(F.max_by("value", "seq").alias("value"))
    fields = last.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"))
    return fields.join(updates.groupBy("query_id").agg(F.max_by("node", "seq").alias("last_node")), "query_id", "full")


def history(traces: DataFrame, most: int = HISTORY) -> DataFrame:
    """(session_id, place, query_id, raw_query, status, created_at): the last questions of each session, the newest first."""
    rows = latest(traces).where("session_id is not null")
    return top_k(rows, ["session_id"], [F.col("created_at").desc(), F.col("query_id")], most, "place").select("session_id", "place", "query_id", "raw_query", "status", "created_at")


def sessions(traces: DataFrame) -> DataFrame:
    """(session_id, created_at, queries): the session begins with its first row; its questions count once."""
    return traces.where("session_id is not null").groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.countDistinct("query_id").alias("queries"))


def session_queries(traces: DataFrame) -> DataFrame:
    """(session_id, query_id): the questions of each session, each once."""
    return traces.where("session_id is not null and query_id is not null").select("session_id", "query_id").distinct()


def latency(log: DataFrame) -> DataFrame:
    """(query_id, node, latency_ms): the time that each question spent in each node, added up over its rounds; log has one row a call."""
    return log.where("query_id is not null").groupBy("query_id", "node").agg(F.round(F.sum("latency_ms"), 4).alias("latency_ms"))


def token_totals(log: DataFrame) -> DataFrame:
    """(query_id, input_tokens, output_tokens) over all calls of a question; a missing count is 0."""
    return log.where("query_id is not null").groupBy("query_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")])


def usage(events: DataFrame) -> DataFrame:
    """(event_type, calls, total, mean): sums per node over the event log."""
    return events.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


def rate(events: DataFrame) -> DataFrame:
    """(event_id, requests, tokens): how many events and how much value the 60 seconds up to each event hold, one exactly 60 seconds old left out.

    An event adds itself at its time and takes itself out 60 seconds later, so a running sum over both is the window's sum. The running sum is made
    in slices of equal size (see `ranking.running`), so a busy minute is many tasks. Values are added as decimals, without rounding.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    value = F.coalesce(F.col("value"), F.lit(0)).cast("decimal(38,10)")
    timed = events.where("ts is not null").select("event_id", F.lit(1).cast("long").alias("one"), value.alias("value"), (at * 2 + 1).alias("moment"))
    out = timed.select(F.lit(None).cast(dict(events.dtypes)["event_id"]).alias("event_id"), (-F.col("one")).alias("one"), (-F.col("value")).cast("decimal(38,10)").alias("value"), (F.col("moment") - 1 + 2 * WINDOW_MICROS).alias("moment"))
    summed = running(timed.withColumn("own", F.lit(True)).unionByName(out.withColumn("own", F.lit(False))), "moment", ["one", "value"])
    return summed.where("own").select("event_id", F.col("sum_one").alias("requests"), F.round(F.col("sum_value").cast("double"), 4).alias("tokens"))


ITERATIONS = "array<struct<trigger:string,sufficiency:struct<sufficient:boolean>>>"


def replay(traces: DataFrame) -> DataFrame:
    """(query_id, step, node): the steps that a stored trace went through, in order, told from its last state without running it again.

    With a column `iterations` (JSON, as `updates_of` writes it) each of them is a retrieval, or a refinement if edges triggered it, and a check if it
    was judged; without it every iteration is a retrieval and a check. The planner shows if there is a query_type, the
    last steps if there are columns final_answer and faithfulness, or if the trace is complete.
    """
    none = F.array().cast("array<string>")
    state = latest(traces)
    if "iterations" in traces.columns:
        kept = F.from_json("iterations", F.lit(ITERATIONS))
        rounds = F.flatten(F.transform(F.coalesce(kept, F.array().cast(ITERATIONS)), lambda i: F.concat(F.array(F.when(i["trigger"] == "graph_traversal", "refine").otherwise("retrieve")), F.when(i["sufficiency"].isNotNull(), F.array(F.lit("sufficiency"))).otherwise(none))))
    else:
        n = F.when(F.coalesce("needs_retrieval", F.lit(True)), F.coalesce("iteration", F.lit(0))).otherwise(0)
        rounds = F.flatten(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.array(F.lit("retrieve"), F.lit("sufficiency"))))
    finished = F.coalesce(F.col("status") == "complete", F.lit(False))

    def shown(column: str, node: str, otherwise: Column) -> Column:
        there = F.col(column).isNotNull() if column in traces.columns else otherwise
        return F.when(there, F.array(F.lit(node))).otherwise(none)

    steps = F.concat(shown("query_type", "planner", F.lit(True)), rounds, shown("final_answer", "generate", finished), shown("faithfulness", "faithfulness", finished))
    return state.select("query_id", F.posexplode(steps).alias("step", "node"))
