"""The model behind the steps of the question loop: rules, a script for tests, and any hosted model by a function from prompt to text.

Every step takes rows of many questions and gives rows for those it has an answer to; a question without a row is one the model failed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import prompts

#: Kinds of questions.
QUERY_TYPES = ("factual", "definition", "multi_hop", "overview", "out_of_scope")


class Model(Protocol):
    def plans(self, asked: DataFrame) -> DataFrame:
        """(query_id, raw_query) -> (query_id, query_type, needs_retrieval, sub_queries), and doc_id if it can name agreements."""

    def judges(self, asked: DataFrame, offered: DataFrame) -> DataFrame:
        """(query_id, raw_query, prompt) and labels (query_id, label, text) -> (query_id, sufficient, missing_info, wanted)."""

    def rewrites(self, asked: DataFrame) -> DataFrame:
        """(query_id, raw_query, previous, missing_info) -> (query_id, rewritten)."""

    def answers(self, asked: DataFrame, shown: DataFrame) -> DataFrame:
        """(query_id, raw_query, missing_info, prompt) and clauses (query_id, place, doc_id, section_id, text) -> (query_id, summary, answer, confidence)."""

    def checks(self, claims: DataFrame) -> DataFrame:
        """(query_id, claim_no, claim, evidence) -> (query_id, claim_no, supported)."""


class Rules:
    """Offline rules, stand-ins and not the equal of a language model.

    Greetings are out of scope; parts joined by "and also" or a semicolon are searched apart; a candidate is wanted if a word of its label, or a third of the
    question's words in its text, meets the question; a rewrite adds what is missing; an answer is the first sentence of each clause with its citation; a claim is
    supported if at least half of its words are in what it cites.
    """

    def plans(self, asked: DataFrame) -> DataFrame:
        q = F.lower(F.coalesce("raw_query", F.lit("")))
        kind = (
            F.when(q.rlike(r"^\s*(?:hi|hello|hey|thanks|thank you)\b"), "out_of_scope")
            .when(q.rlike(r"\b(?:define|definition|meaning|mean)\b"), "definition")
            .when(q.rlike(r"\b(?:summar|overview|all of)"), "overview")
            .when(q.rlike(r"\b(?:and|both|compare)\b.*\bsection|\bsection.*\band\b"), "multi_hop")
            .otherwise("factual")
        )
        parts = F.filter(F.split("raw_query", r"(?i)\s*;\s*|\s+and also\s+"), lambda x: F.trim(x) != "")
        return asked.select("query_id", kind.alias("query_type"), (kind != "out_of_scope").alias("needs_retrieval"), parts.alias("sub_queries"))

    def judges(self, asked: DataFrame, offered: DataFrame) -> DataFrame:
        met = offered.join(asked.select("query_id", F.array_distinct(T.tokens(F.col("raw_query"))).alias("q")), "query_id")
        shared = F.size(F.array_intersect("q", T.tokens(F.col("text")))) * 3 >= F.size("q")
        wanted = met.where((F.size("q") > 0) & (F.arrays_overlap("q", T.tokens(F.lower("label"))) | shared)).groupBy("query_id").agg(F.array_sort(F.collect_set("label")).alias("wanted"))
        none = F.array().cast("array<string>")
        return asked.select("query_id").join(wanted, "query_id", "left").select("query_id", F.col("wanted").isNull().alias("sufficient"), F.array_join(F.coalesce("wanted", none), ", ").alias("missing_info"), F.coalesce("wanted", none).alias("wanted"))

    def rewrites(self, asked: DataFrame) -> DataFrame:
        return asked.select("query_id", F.concat_ws(" ", "raw_query", F.nullif("missing_info", F.lit(""))).alias("rewritten"))

    def answers(self, asked: DataFrame, shown: DataFrame) -> DataFrame:
        sentence = F.regexp_extract(F.coalesce("text", F.lit("")), r"^(?s)(.+?[.;:](?=\s|$)|.+)", 1)
        line = F.concat(F.lit("- "), F.regexp_replace(sentence, r"\s+", " "), F.lit(" "), T.citation(F.col("doc_id"), F.col("section_id")))
        rows = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("ls"))
        said = F.transform("ls", lambda x: x["line"])
        return rows.select("query_id", F.regexp_replace(F.element_at(said, 1), "^- ", "").alias("summary"), F.array_join(said, "\n").alias("answer"), F.lit("medium").alias("confidence"))

    def checks(self, claims: DataFrame) -> DataFrame:
        words = F.array_distinct(T.tokens(F.regexp_replace("claim", T.CITATION, " ")))
        held = F.size(F.array_intersect(words, T.tokens(F.col("evidence")))) * 2 >= F.size(words)
        return claims.select("query_id", "claim_no", held.alias("supported"))


class Scripted:
    """A model that answers from given functions, for tests: each step not given falls back on the rules."""

    def __init__(self, **steps: Callable[..., DataFrame]):
        self.steps, self.rules = steps, Rules()

    def __getattr__(self, name: str) -> Callable[..., DataFrame]:
        if name not in ("plans", "judges", "rewrites", "answers", "checks"):
            raise AttributeError(name)
        return self.steps.get(name) or getattr(self.rules, name)


class Prompted:
    """A hosted model: `complete(system, user)` gives its text, and is called in the executors' Python workers, once a row.

    The text must hold one JSON object of the step's shape; where it does not, or the call fails, the row is left out, which the loop takes as a failure.
    """

    def __init__(self, complete: Callable[[str, str], str]):
        self.complete = complete

    def _ask(self, rows: DataFrame, step: str, user: Column, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
        complete, system = self.complete, prompts.SYSTEM[step] + f" Answer with one JSON object: {prompts.SHAPES[step]}."
        kinds = {"query_id": "string", "claim_no": "int"}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for prompt in batch.column(len(keys)).to_pylist():
                    try:
                        text = complete(system, prompt or "")
                        out.append(text[text.index("{") : text.rindex("}") + 1])
                    except Exception:  # one failed call must not end the others
                        out.append(None)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.string())], names=[*keys, "said"])

        said = rows.select(*keys, user.alias("user")).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", said string")
        shape = prompts.SHAPES[step]
        first = shape.split()[0]
        return said.select(*keys, F.from_json("said", F.lit(shape)).alias("s")).where(F.col("s").isNotNull() & F.col(f"s.{first}").isNotNull()).select(*keys, "s.*")

    def plans(self, asked: DataFrame) -> DataFrame:
        return self._ask(asked, "plan", prompts.said(question=F.col("raw_query")))

    def judges(self, asked: DataFrame, offered: DataFrame) -> DataFrame:
        labels = offered.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
        return self._ask(asked.join(labels, "query_id", "left"), "judge", prompts.said(question=F.col("raw_query"), clauses=F.col("prompt"), labels_offered=F.col("labels")))

    def rewrites(self, asked: DataFrame) -> DataFrame:
        return self._ask(asked, "rewrite", prompts.said(question=F.col("raw_query"), search_that_failed=F.col("previous"), missing=F.col("missing_info")))

    def answers(self, asked: DataFrame, shown: DataFrame) -> DataFrame:
        return self._ask(asked, "answer", prompts.said(question=F.col("raw_query"), clauses=F.col("prompt"), not_found=F.col("missing_info")))

    def checks(self, claims: DataFrame) -> DataFrame:
        return self._ask(claims, "check", prompts.said(claim=F.col("claim"), cited=F.col("evidence")), ("query_id", "claim_no"))
