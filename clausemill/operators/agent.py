"""The bounded question-answering loop over many questions at once.

State is rows keyed by query_id; each round is a few joins, and its result is written to the shared folder, so that lineage stays
flat and a lost executor costs one round. The model behind the steps is a protocol (see `models`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import context as C
from clausemill.operators import index, retrieval, roster
from clausemill.operators.joins import sifted
from clausemill.operators.models import Model, Rules
from clausemill.operators.ranking import top_k
from clausemill.sources.tables import staged

#: Fixed value: rounds at most.
ROUNDS = 3
_NOTHING = "no clauses were retrieved for this question"


class Answered:
    """What the loop gives; what is not asked for is not worked out.

    questions: one row each with its outcome; context: what each gathered; answers: of the three kinds of questions; checks: citations, and whether they hold by
    what was shown; claims, with whether what they cite supports them; log: one row a step.
    """

    def __init__(self, asked: DataFrame, ended: DataFrame, gathered: DataFrame, chunks: DataFrame, entries: DataFrame, model: Model, steps: DataFrame):
        self._asked, self._ended, self._chunks, self._entries, self._model = asked, ended, chunks, entries, model
        self.context, self.log = gathered, steps

    @cached_property
    def _texts(self) -> DataFrame:
        return sifted(self._chunks, self.context, "chunk_id")

    @cached_property
    def _shown(self) -> DataFrame:
        return staged(C.prioritized(self.context).join(self._texts.select("chunk_id", "doc_id", "section_id", "section_title", "path", "text"), "chunk_id"), "agent_shown")

    @cached_property
    def _state(self) -> DataFrame:
        state = self._asked.join(self._ended, "query_id", "left").join(self._shown.select("query_id").distinct().withColumn("some", F.lit(True)), "query_id", "left")
        low = F.col("needs_retrieval") & (~F.coalesce("sufficient", F.lit(False)) | F.col("some").isNull())
        return staged(state.withColumn("low", low), "agent_state")

    @cached_property
    def _said(self) -> DataFrame:
        normal = self._state.where("needs_retrieval and some")
        prompt = C.prompt(self._shown, self._texts)
        said = self._model.answers(normal.select("query_id", "raw_query", F.when(F.col("low"), F.col("missing_info")).alias("missing_info")).join(prompt, "query_id"), self._shown)
        kept = self._state.join(said, "query_id", "left")
        failed = F.col("needs_retrieval") & F.col("some").isNotNull() & F.col("answer").isNull()
        answer_ = (
            F.when(~F.col("needs_retrieval"), F.lit(None).cast("string"))
            .when(F.col("some").isNull(), F.lit("Nothing in the agreements was found for this. Name the company, the section or the term that the clause would use."))
            .otherwise(F.coalesce("answer", F.lit("No answer could be made from the clauses.")))
        )
        summary = F.when(~F.col("needs_retrieval"), "Only what the agreements say can be answered here.").when(F.col("some").isNull(), "No clause was found for this question.").otherwise(F.coalesce("summary", F.lit("")))
        confidence = F.when(~F.col("needs_retrieval"), "high").when(F.col("low") | failed, "low").otherwise(F.coalesce("confidence", F.lit("low")))
        return staged(kept.select("query_id", summary.alias("summary"), (~F.col("needs_retrieval")).alias("listed"), answer_.alias("answer"), confidence.alias("confidence"), failed.alias("failed")), "agent_answers")

    @property
    def _listed(self) -> DataFrame:
        """With the list of all agreements as the answer to questions that need none: it is long, and stored once and not a question."""
        # Every agreement on one line, once for all questions that need none.
        lines = top_k(roster.listing(self._entries).withColumn("all", F.lit(1)), ["all"], [F.col("doc_id")], 2**31 - 1, "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("lines"))
        every = F.concat(F.lit("The library holds these agreements:\n\n"), F.coalesce("lines", F.lit("")), F.lit("\n\nAsk what one of them says about a duty, a term, an end, a payment or a reference."))
        return self._said.crossJoin(F.broadcast(lines)).withColumn("answer", F.when(F.col("listed"), every).otherwise(F.col("answer"))).drop("lines", "listed")

    @cached_property
    def _whole(self) -> DataFrame:
        return self._listed.select("query_id", F.concat_ws("\n", F.nullif("summary", F.lit("")), "answer").alias("answer"))

    @cached_property
    def checks(self) -> DataFrame:
        return staged(C.verify_citations(self._whole, self._shown), "agent_checks")

    @cached_property
    def answers(self) -> DataFrame:
        unsound = self.checks.where("not verified").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", T.citation(F.col("doc_id"), F.col("section_id")).alias("tag")))).alias("u"))
        warning = F.concat(F.lit("\n\nThese citations name no clause that was found, and could not be checked: "), F.array_join(F.transform("u", lambda x: x["tag"]), ", "))
        return self._listed.join(unsound, "query_id", "left").select("query_id", "summary", F.concat("answer", F.coalesce(warning, F.lit(""))).alias("answer"), "confidence", F.transform(F.coalesce("u", F.array().cast("array<struct<place:int,tag:string>>")), lambda x: x["tag"]).alias("unverified_citations"))

    @cached_property
    def claims(self) -> DataFrame:
        claims = C.claim_evidence(self._whole, self._shown)
        cited = claims.join(self._texts.select("chunk_id", F.col("text").alias("evidence")), "chunk_id").groupBy("query_id", "claim_no", "claim").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence"))), lambda x: x["evidence"]), "\n\n").alias("evidence"))
        return claims.join(self._model.checks(cited), ["query_id", "claim_no"], "left")

    @cached_property
    def questions(self) -> DataFrame:
        return self._state.join(self._said.select("query_id", "confidence", "failed"), "query_id").select(
            "query_id", "query_type", "needs_retrieval", "doc_id", F.coalesce("iteration", F.lit(0)).alias("iteration"), F.nullif("strategy", F.lit("")).alias("strategy"), "sufficient", (F.col("low") | F.col("failed")).alias("low_confidence"), "confidence",
        )


def plan(questions: DataFrame, entries: DataFrame, model: Model) -> DataFrame:
    """(query_id, raw_query, query_type, needs_retrieval, doc_id, sections, sub_queries): a named agreement or section forces retrieval.

    A question that the model has no plan for, and one without searches, is searched as it is.
    """
    plans = model.plans(questions)
    named = questions.select("query_id", "raw_query").join(roster.resolve(questions, entries).select("query_id", "doc_id"), "query_id", "left")
    if "doc_id" in plans.columns:  # an agreement that the model names counts where the question names none, and only if there is such a one
        proposed = plans.join(entries.select("doc_id").distinct(), "doc_id", "left_semi").select("query_id", F.col("doc_id").alias("proposed"))
        named = named.join(proposed, "query_id", "left").select("query_id", "raw_query", F.coalesce("doc_id", "proposed").alias("doc_id"))
    typed = named.join(plans.select("query_id", "query_type", "needs_retrieval", "sub_queries"), "query_id", "left").withColumn("sections", T.named_sections(F.coalesce("raw_query", F.lit(""))))
    forced = F.col("doc_id").isNotNull() | (F.size("sections") > 0)
    kind = F.coalesce("query_type", F.lit("factual"))
    searches = F.when(F.size(F.coalesce("sub_queries", F.array())) > 0, F.col("sub_queries")).otherwise(F.array("raw_query"))
    return typed.select(
        "query_id", "raw_query", F.when(forced & (kind == "out_of_scope"), "overview").otherwise(kind).alias("query_type"),
        (forced | F.coalesce("needs_retrieval", F.lit(True))).alias("needs_retrieval"), "doc_id", "sections", searches.alias("sub_queries"),
    )


def route(sufficient: Column, iteration: Column, pulled: Column, strategy: Column, error: Column | None = None, cap: int = ROUNDS) -> Column:
    """The next step after a sufficiency check, the first that holds: error, enough, cap reached, nothing to pull after a rewrite, else refine."""
    stop = sufficient | (iteration >= cap) | (~pulled & (strategy == "query_rewrite"))
    stop = stop if error is None else error.isNotNull() | stop
    return F.when(F.coalesce(stop, F.lit(False)), "generate").otherwise("refine")


def search(active: DataFrame, chunks: DataFrame, vectors: DataFrame, words: retrieval.Tokenized) -> DataFrame:
    """(query_id, pos, final, chunk_id): the hybrid search of each (query_id, pos, sub_query, doc_id): dense and BM25, fused and cut, in the named agreement where there is one.

    The same words about the same agreement are searched once.
    """
    name = F.concat_ws("\x1f", "query_id", F.col("pos").cast("string"))
    each = staged(active.groupBy(F.col("sub_query").alias("raw_query"), "doc_id").agg(F.min(name).alias("query_id")), "agent_searches")
    near = retrieval.dense_texts(each, vectors, index.embedder(index.MODEL))
    found = retrieval.hybrid(each, near, chunks, group=F.col("doc_id"), ready=words).select("query_id", "final", F.col("key").alias("chunk_id"))
    hits = each.select(F.col("raw_query").alias("_words"), F.col("doc_id").alias("_of"), F.col("query_id").alias("_name")).join(found.withColumnRenamed("query_id", "_name"), "_name")
    return active.join(hits, F.col("sub_query").eqNullSafe(F.col("_words")) & F.col("doc_id").eqNullSafe(F.col("_of"))).select("query_id", "pos", "final", "chunk_id")


def _judged(status: DataFrame, gathered: DataFrame, chunks: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """The checked questions (with sufficient and missing_info), and what they want and lack: (query_id, chunk_id, kind, place)."""
    held = gathered.join(status.select("query_id"), "query_id", "left_semi")
    refs = C.referenced_absent(held, chunks).withColumn("kind", F.lit(1))
    defs = C.definitions_absent(held, chunks).withColumn("kind", F.lit(2))
    offered = staged(refs.unionByName(defs), "agent_offered")
    asked = status.select("query_id", "raw_query").join(C.prompt(C.prioritized(held), chunks), "query_id")
    verdict = staged(model.judges(asked, offered.join(sifted(chunks.select("chunk_id", "text"), offered, "chunk_id"), "chunk_id", "left").select("query_id", "label", "text")), "agent_verdict")
    chosen = verdict.select("query_id", F.explode("wanted").alias("label")).distinct()
    known = status.drop("sufficient", "missing_info").join(asked.select("query_id", F.lit(True).alias("some")), "query_id", "left").join(verdict.select("query_id", "sufficient", "missing_info"), "query_id", "left")
    # Without clauses, or without a verdict, the loop goes on to the answer.
    missing = F.when(F.col("some").isNull(), _NOTHING).otherwise(F.coalesce("missing_info", F.lit("the sufficiency check failed")))
    return known.withColumn("missing_info", F.when(F.col("sufficient").isNull(), missing).otherwise(F.coalesce("missing_info", F.lit("")))).withColumn("sufficient", F.coalesce("sufficient", F.lit(True))).drop("some"), C.wanted(chosen, offered)


def answer(questions: DataFrame, chunks: DataFrame, entries: DataFrame, model: Model | None = None, rounds: int = ROUNDS, tell: Callable[[DataFrame], None] | None = None) -> Answered:
    """Answer all questions (query_id, raw_query), in at most `rounds` rounds.

    Each round searches for those that are to be searched, checks what all open ones have, and either follows edges of the clause graph, or
    has the question worded anew, or ends; `tell` gets the steps of each round when they are done. Repeated query_ids count once; null questions are answered from nothing; empty tables
    give empty results.
    """
    model = model or Rules()
    asked = staged(plan(questions.where("query_id is not null").groupBy("query_id").agg(F.min("raw_query").alias("raw_query")), entries, model), "agent_plan")
    columns = {"section_title": "string", "path": "string"}
    chunks = staged(chunks.select("*", *[F.lit(None).cast(k).alias(c) for c, k in columns.items() if c not in chunks.columns]), "agent_chunks")
    vectors = staged(index.embed(chunks.withColumn("_text", T.embedding_text()), "chunk_id", "_text").join(chunks.select(F.col("chunk_id").alias("key"), F.col("doc_id").alias("own")), "key"), "agent_vectors")
    words = retrieval.tokenized(chunks, "chunk_id", T.indexed_text(), F.col("doc_id"))
    needed = asked.where("needs_retrieval")
    active = needed.select("query_id", "doc_id", F.posexplode("sub_queries").alias("pos", "sub_query"))
    # First round: sections named in a question about a known agreement are looked up, before what the search finds.
    direct = needed.where("doc_id is not null").select("query_id", "doc_id", F.posexplode("sections").alias("pos", "section_id"))
    base = chunks.select("doc_id", "chunk_id", F.regexp_replace("section_id", r"__p\d+$", "").alias("section_id"), F.coalesce("part", F.lit(1)).alias("part"))
    looked = direct.join(base, ["doc_id", "section_id"]).groupBy("query_id", "pos").agg(F.min_by("chunk_id", "part").alias("chunk_id"))
    gathered = looked.select("query_id", F.col("pos").cast("long").alias("seq"), "chunk_id", F.lit("direct_lookup").alias("source"))
    status = needed.select("query_id", "raw_query", "doc_id", F.lit(0).alias("iteration"), F.lit("").alias("strategy"), F.lit(None).cast("boolean").alias("sufficient"), F.lit("").alias("missing_info"), F.lit("search").alias("state"))
    closed, log = None, []
    for n in range(1, 2 * rounds + 1):
        found = search(active, chunks, vectors, words).select("query_id", (n * 1_000_000 + F.col("pos") * 1000 + F.col("final")).cast("long").alias("seq"), "chunk_id", F.lit("search").alias("source"))
        gathered = staged(C.merge(gathered.unionByName(found)), "agent_context")
        status = status.withColumn("iteration", F.col("iteration") + F.when(F.col("state") == "search", 1).otherwise(0))
        log.append(status.where("state = 'search'").select("query_id", "iteration", F.lit(4 * n).alias("at"), F.lit("retrieve").alias("step"), "strategy"))
        judged, pull = _judged(status, gathered, chunks, model)
        pull = staged(pull.join(gathered.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"), "agent_wanted")
        judged = judged.join(pull.select("query_id").distinct().withColumn("pulled", F.lit(True)), "query_id", "left").withColumn("pulled", F.coalesce("pulled", F.lit(False)))
        judged = staged(judged.withColumn("step", route(F.col("sufficient"), F.col("iteration"), F.col("pulled"), F.col("strategy"), cap=rounds)), "agent_judged")
        log.append(judged.select("query_id", "iteration", F.lit(4 * n + 1).alias("at"), F.lit("sufficiency").alias("step"), "strategy"))
        over = judged.where("step = 'generate'").select("query_id", "iteration", "strategy", "sufficient", "missing_info")
        closed = over if closed is None else closed.unionByName(over)
        more = judged.where("step = 'refine'")
        if tell:
            tell(log[-2].unionByName(log[-1]))
        if more.isEmpty():
            break
        later = pull.join(more.select("query_id"), "query_id", "left_semi")
        later = later.select("query_id", (n * 1_000_000 + 500_000 + F.col("kind") * 1000 + F.col("place")).cast("long").alias("seq"), "chunk_id", F.lit("graph_traversal").alias("source"))
        gathered = gathered.unionByName(later)
        # Edges first; a question that has none to follow is worded anew and searched again.
        before = active.groupBy("query_id").agg(F.min_by("sub_query", "pos").alias("previous"))
        again = more.where("not pulled").join(before, "query_id", "left").select("query_id", "raw_query", F.coalesce("previous", "raw_query").alias("previous"), "missing_info", "doc_id")
        worded = again.join(model.rewrites(again), "query_id", "left")
        active = staged(worded.select("query_id", "doc_id", F.lit(0).alias("pos"), F.coalesce(F.nullif(F.trim("rewritten"), F.lit("")), F.concat_ws(" ", "raw_query", "missing_info")).alias("sub_query")), "agent_active")
        strategy = F.when(F.col("pulled"), "graph_traversal").otherwise("query_rewrite")
        log.append(more.select("query_id", "iteration", F.lit(4 * n + 2).alias("at"), F.lit("refine").alias("step"), strategy.alias("strategy")))
        status = staged(more.select("query_id", "raw_query", "doc_id", (F.col("iteration") + F.col("pulled").cast("int")).alias("iteration"), strategy.alias("strategy"), "sufficient", "missing_info", F.when(F.col("pulled"), "judge").otherwise("search").alias("state")), "agent_status")
    ended = staged(closed, "agent_ended")
    steps = log[0]
    for x in log[1:]:
        steps = steps.unionByName(x)
    return Answered(asked, ended, gathered, chunks, entries, model, steps)
