"""One function per route and script: each takes a session and a folder of tables and returns rows."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import agent, graph, index, parsing, roster, traces
from clausemill.sources import corpus
from clausemill.sources.tables import table

MOST_CHARS = 2000


class NotFound(LookupError):
    pass


class Service:
    """The tables under one folder, asked as the routes do."""

    def __init__(self, spark: SparkSession, tables: str):
        self.spark, self.tables = spark, tables
        self.chunks = graph.current(table(spark, tables, "chunks"))
        self.traces = table(spark, tables, "traces")
        self.roster = roster.roster(table(spark, tables, "manifest"))

    def query(self, questions: DataFrame, tell: Callable[[DataFrame], None] | None = None) -> agent.Answered:
        """Answer questions (query_id, raw_query) of 1 to 2000 characters."""
        if not questions.where(~F.char_length(F.coalesce("raw_query", F.lit(""))).between(1, MOST_CHARS)).isEmpty():
            raise ValueError(f"a question has 1 to {MOST_CHARS} characters")
        return agent.answer(questions, self.chunks, self.roster, tell=tell)

    def stream(self, questions: DataFrame, log: str | None = None) -> Iterator[dict]:
        """start, then the steps of each question round by round while the loop goes on, then an answer each, then done; or error.

        With `log`, steps and answers are written there as trace updates before they are given out.
        """
        told: queue.Queue = queue.Queue()

        def run() -> None:
            try:
                told.put(("answers", self.query(questions, lambda steps: told.put(("steps", steps))).answers))
            except Exception as error:  # the stream tells of it instead of breaking off
                told.put(("error", error))

        yield {"event": "start"}
        worker = threading.Thread(target=run, daemon=True)
        worker.start()
        seq, kind = 0, "steps"
        try:
            while kind == "steps":
                kind, rows = told.get()
                if kind == "error":
                    raise rows
                seq += 1
                if kind == "steps":
                    rows = rows.orderBy("at", "query_id")
                    updates = traces.updates_of(rows.select("query_id", "iteration", F.col("strategy").alias("refine_strategy")), "loop", seq)
                else:
                    rows = rows.orderBy("query_id")
                    updates = traces.updates_of(rows.select("query_id", "summary", F.col("answer").alias("final_answer"), "confidence", "unverified_citations"), "generate", seq)
                if log:
                    updates.write.mode("append").parquet(log)
                for row in rows.toLocalIterator():
                    yield {"event": "node" if kind == "steps" else "answer", **row.asDict()}
            yield {"event": "done"}
        except Exception as error:
            yield {"event": "error", "error": str(error)}
        worker.join()

    def documents(self) -> DataFrame:
        counts = self.chunks.groupBy("doc_id").agg(F.count("*").alias("num_chunks"))
        return counts.join(self.roster, "doc_id", "left").orderBy("doc_id")

    def document(self, doc_id: str, section_id: str | None = None, natural: bool = False) -> DataFrame:
        """Chunks of an agreement, by section id as text, or by number with `natural`; NotFound if there are none."""
        rows = self.chunks.where(F.col("doc_id") == doc_id)
        if section_id is not None:
            rows = rows.where(F.col("section_id") == section_id)
        if rows.isEmpty():
            raise NotFound(f"{doc_id} {section_id or ''}".strip())
        number = F.transform(F.regexp_extract_all("section_id", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
        return rows.orderBy(number, "section_id") if natural else rows.orderBy("section_id")

    def history(self, session_id: str) -> DataFrame:
        return traces.history(self.traces.where(F.col("session_id") == session_id))

    def trace(self, query_id: str) -> dict | None:
        row = traces.latest(self.traces.where(F.col("query_id") == query_id)).first()
        return None if row is None else row.asDict()

    def health(self) -> dict:
        return {"status": "ok", "chunks": self.chunks.count()}


def select_filings(documents: DataFrame, most: int = 15, least: int = 12_000, largest: int = 260_000, headings: int = 10) -> DataFrame:
    """The densest filings of a readable size; ties go to the smaller id. The limit is the feature."""
    counted = T.density()
    rows = documents.where(F.char_length("text").between(least, largest)).select("*", *[c.alias(n) for n, c in counted.items()])
    return rows.where(F.col("headings") >= headings).orderBy(F.desc("score"), "doc_id").limit(most)


def build_chunks(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Parse a folder of texts into chunk lines with edges under `out`; the report on them is one row (see `graph.corpus_report`), with the dangling edges counted."""
    corpus.write_chunks(parsing.build_chunks(corpus.texts(spark, folder)), out)
    chunks = corpus.read_chunks(spark, out)
    ids = chunks.select("doc_id", F.col("chunk_id").alias("src"), F.explode(F.concat("cross_reference_ids", "definition_ids")).alias("dst"))
    return graph.corpus_report(chunks).crossJoin(F.broadcast(graph.dangling(ids, chunks).agg(F.count("*").alias("dangling"))))


def build_index(spark: SparkSession, tables: str, path: str, dry_run: bool = False, rebuild: bool = False) -> DataFrame:
    """Bring the vectors under `path` up to date; with dry_run only say what would be done."""
    chunks = graph.current(table(spark, tables, "chunks"))
    if dry_run:
        now, old = index.hashes(chunks), None if rebuild else index.stored(spark, path)
        return index.plan_summary(index.plan(now, now.limit(0) if old is None else old))
    return index.plan_summary(index.build(spark, chunks, path, rebuild=rebuild))


def format_trace(row: dict) -> str:
    """A stored trace for reading: what was asked, how it went, and the answer, each under its heading; empty values are left out."""
    parts = {
        "Question": ("raw_query", "query_type", "doc_id", "sub_queries"), "Course": ("status", "last_node", "iteration", "sufficient", "missing_info", "refine_strategy", "latency_ms", "token_usage", "error"),
        "Answer": ("summary", "final_answer", "citations", "unverified_citations", "confidence", "faithfulness"),
    }
    known = {k for keys in parts.values() for k in keys}
    parts["Other"] = tuple(k for k in row if k not in known)
    lines = []
    for heading, keys in parts.items():
        held = [f"  {k}: {row[k]}" for k in keys if row.get(k) not in (None, "", [], {})]
        lines += [heading, *held] if held else []
    return "\n".join(lines)
