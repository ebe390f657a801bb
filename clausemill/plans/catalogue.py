"""Every named query of the core, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import agent, context, graph, index, models, orphans, parsing, retrieval, roster, traces
from clausemill.operators.ranking import numbered, top_k
from clausemill.plans import contracts
from clausemill.sources.tables import staged, table

_HASHED = ("path", "section_title", "text")
_TEXT, _LISTS = ("section_id", "section_title", "text"), ("cross_reference_ids", "defined_terms_used", "definition_ids")
Query = Callable[[SparkSession, str], DataFrame]


def _orphans(s: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(table(s, d, "chunks"), table(s, d, "sections"), table(s, d, "chunk_deletions"))


def _chunks(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return graph.current(table(s, d, "chunks"), *columns)


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "traces").where("query_id is not null").groupBy("query_id").agg(F.min("raw_query").alias("raw_query"), F.min("doc_id").alias("doc_id"))


def _bm25(s: SparkSession, d: str, k: int, **more) -> DataFrame:
    return retrieval.bm25(_questions(s, d), _chunks(s, d, *_TEXT), "chunk_id", T.indexed_text(), k, **more)


def _hits(s: SparkSession, d: str, k: int = 10) -> DataFrame:
    return _bm25(s, d, k).select("query_id", F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")


def _after_cut(s: SparkSession, d: str) -> DataFrame:
    """The document of a question restricts only what the cut has left."""
    asked = _questions(s, d).select("query_id", F.col("doc_id").alias("of"))
    best = _bm25(s, d, 40).drop("rank").join(asked, "query_id").where(F.col("of").isNull() | (F.substring_index("key", "__sec_", 1) == F.col("of")))
    return top_k(best, ["query_id"], [F.col("score").desc(), F.col("key")], 40).select("query_id", F.col("key").alias("chunk_id"), "rank")


def _postings(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(s, d, *_TEXT)
    post = staged(retrieval.postings(chunks, "chunk_id", T.indexed_text()), "postings")
    return post, retrieval.corpus_statistics(chunks, post, "chunk_id", T.indexed_text())


def _term_counts(s: SparkSession, d: str) -> DataFrame:
    return _postings(s, d)[0].groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("uses"))


def _statistics(s: SparkSession, d: str) -> DataFrame:
    return _postings(s, d)[1].select("n", F.round("mean_length", 6).alias("mean_length"), "terms", F.round("mean_idf", 6).alias("mean_idf"))


def _idf(s: SparkSession, d: str) -> DataFrame:
    post, stats = _postings(s, d)
    return retrieval.inverse_frequencies(post, stats).select("term", "df", F.round("idf", 6).alias("idf"))


def _nearest(s: SparkSession, d: str, same: bool) -> DataFrame:
    vectors = table(s, d, "embeddings")
    found = retrieval.dense(vectors, vectors.where("vec_id % 100 = 0"), 10, same)
    return found.select("query_vec", "vec_id", F.round("score", 6).alias("score"), "rank")


def _lists(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "retrieved").where("query_id is not null and chunk_id is not null")
    dense = rows.where("dense_rank is not null").select("query_id", F.col("chunk_id").alias("key"), F.lit("dense").alias("retriever"), F.col("dense_rank").alias("rank"))
    sparse = rows.where("sparse_rank is not null").select("query_id", F.col("chunk_id").alias("key"), F.lit("sparse").alias("retriever"), F.col("sparse_rank").alias("rank"))
    return dense.unionByName(sparse)


def _fused(s: SparkSession, d: str) -> DataFrame:
    return retrieval.reciprocal_ranks(_lists(s, d)).select("query_id", F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"), "best_rank", "place")


def _dense_list(s: SparkSession, d: str) -> DataFrame:
    return _lists(s, d).where("retriever = 'dense'").groupBy("query_id", "key").agg(F.min("rank").alias("rank"))


def _hybrid(s: SparkSession, d: str, **switches) -> DataFrame:
    return retrieval.hybrid(_questions(s, d), _dense_list(s, d), _chunks(s, d, *_TEXT), **switches)


def _ablation(s: SparkSession, d: str) -> DataFrame:
    out = None
    for mode, switches in {"dense": {"use_sparse": False}, "sparse": {"use_dense": False}, "both": {}}.items():
        one = retrieval.recall(_hybrid(s, d, **switches), table(s, d, "judgments")).agg(F.sum("relevant").alias("relevant"), F.sum("hits").alias("hits")).select(F.lit(mode).alias("mode"), "relevant", "hits")
        out = one if out is None else out.unionByName(one)
    return out


def _plan(s: SparkSession, d: str) -> DataFrame:
    """From the index as first delivered to what the last deliveries and the deletions ask for, by the stored hashes."""
    rows = table(s, d, "chunks").where("chunk_id is not null")
    first = rows.groupBy("chunk_id").agg(F.min_by("content_hash", F.struct("indexed_at", "section_id")).alias("content_hash"))
    last = rows.groupBy("chunk_id").agg(F.max_by("content_hash", F.struct("indexed_at", "section_id")).alias("content_hash"))
    alive = index.state(table(s, d, "chunks"), table(s, d, "chunk_deletions")).select("chunk_id")
    now = last.join(alive, "chunk_id", "left_semi").join(index.hashes(_chunks(s, d, *_HASHED)).select("chunk_id", "tokens"), "chunk_id")
    return index.plan(now.where("content_hash is not null"), first.where("content_hash is not null"))


def _context(s: SparkSession, d: str) -> DataFrame:
    """What the recorded questions gathered: candidates in order of their best recorded place, each chunk once."""
    rows = table(s, d, "retrieved").where("query_id is not null and chunk_id is not null")
    seq = F.least(F.coalesce("dense_rank", F.lit(100_000)), F.coalesce("sparse_rank", F.lit(100_000))).cast("long")
    return context.merge(rows.select("query_id", seq.alias("seq"), "chunk_id", "doc_id", "section_id", "source"))


def _shown(s: SparkSession, d: str) -> DataFrame:
    return context.prioritized(_context(s, d)).select("query_id", "place", "chunk_id", "source")


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Answers that cite the first three clauses of each context and one that is in none."""
    tag = T.citation(F.col("doc_id"), F.col("section_id"))
    three = top_k(_context(s, d), ["query_id"], [F.col("seq"), F.col("chunk_id")], 3, "place")
    line = F.concat(F.lit("- **Point** It follows from "), tag, F.lit(". See also [none §9.9] and "), tag, F.lit("."))
    return three.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))).alias("ls")).select("query_id", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("answer"))


def _wanted(s: SparkSession, d: str) -> DataFrame:
    held, chunks = staged(_context(s, d), "context"), _chunks(s, d, *_LISTS)
    refs = context.referenced_absent(held, chunks).withColumn("kind", F.lit(1))
    defs = context.definitions_absent(held, chunks).withColumn("kind", F.lit(2))
    offered = staged(refs.unionByName(defs), "offered")
    return context.wanted(offered.where("place <= 5").select("query_id", "label").distinct(), offered).select("query_id", "chunk_id", "kind", "place")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select(F.col("doc_id"), F.posexplode(T.normal_lines(F.col("text"))).alias("line_no", "line"))


def _density(s: SparkSession, d: str) -> DataFrame:
    counted = T.density()
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.char_length("text").alias("chars"), *[c.cast("long").alias(n) for n, c in counted.items()])
    return rows


def _references(s: SparkSession, d: str) -> DataFrame:
    return parsing.extract_references(_chunks(s, d, "text"))


def _view_chunks(s: SparkSession, d: str) -> DataFrame:
    return parsing.build_chunks(contracts.texts(s, d))


def _view_references(s: SparkSession, d: str) -> DataFrame:
    split = parsing.split_chunks(contracts.texts(s, d))
    return parsing.extract_references(split.select(T.chunk_id(F.col("doc_id"), F.col("section_id")).alias("chunk_id"), "text"))


def _view_terms(s: SparkSession, d: str) -> DataFrame:
    used = F.arrays_zip("defined_terms_used", "definition_ids")
    return _view_chunks(s, d).select("chunk_id", F.explode(used).alias("u")).select("chunk_id", F.col("u.defined_terms_used").alias("term"), F.col("u.definition_ids").alias("dst"))


def _view_sections(s: SparkSession, d: str) -> DataFrame:
    rows = parsing.parse_sections(contracts.texts(s, d, True))
    return rows.select("doc_id", "section_id", "kind", "level", "title", "parent_id", F.array_join("children", " ").alias("children"))


def _built(s: SparkSession, d: str) -> DataFrame:
    lists = [F.array_join(F.array_sort(c), " | ").alias(c) for c in ("cross_reference_ids", "defines_terms", "defined_terms_used", "definition_ids")]
    return _view_chunks(s, d).select("chunk_id", "section_id", "parent_section_id", "section_title", "text", "kind", "level", "path", "part", "num_parts", *lists)


def _terms(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d, "text").where("text is not null").select("chunk_id", F.explode(T.defined_terms(F.col("text"))).alias("term"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return graph.resolve(_chunks(s, d, "doc_id", "section_id", "part", "cross_references"), table(s, d, "sections"))


def _sections(s: SparkSession, d: str) -> DataFrame:
    one = table(s, d, "sections").where("doc_id is not null and section_id is not null").groupBy("doc_id", "section_id").agg(F.min_by("kind", "parsed_at").alias("kind"), F.min("level").alias("level"))
    return numbered(one, ["doc_id"], [F.col("section_id")], "place").select("doc_id", "place", "section_id", "kind", "level")


def _agent(s: SparkSession, d: str, model: models.Model | None = None) -> agent.Answered:
    chunks = _chunks(s, d, "doc_id", "part", "path", *_TEXT, *_LISTS)
    return agent.answer(_questions(s, d).select("query_id", "raw_query"), chunks, roster.roster(table(s, d, "manifest")), model)


def _script() -> models.Scripted:
    """A model for the loop alone: questions with an even last digit need no search; nothing is ever enough, and nothing offered is wanted."""
    needs = ~F.substring("query_id", -1, 1).isin("0", "2", "4", "6", "8")
    return models.Scripted(
        plans=lambda q: q.select("query_id", F.when(needs, "factual").otherwise("out_of_scope").alias("query_type"), needs.alias("needs_retrieval"), F.array("raw_query").alias("sub_queries")),
        judges=lambda q, offered: q.select("query_id", F.lit(False).alias("sufficient"), F.lit("the rest").alias("missing_info"), F.array(F.lit("invented §9.9")).alias("wanted")),
    )


def _roster(s: SparkSession, d: str) -> DataFrame:
    return roster.roster(table(s, d, "manifest"))


def _resolved_names(s: SparkSession, d: str) -> DataFrame:
    """The recorded questions, which name no agreement, and one about each agreement by its id in capitals."""
    entries = _roster(s, d)
    made = entries.select(F.concat(F.lit("id:"), "doc_id").alias("query_id"), F.format_string("What does %s say of fees?", F.upper("doc_id")).alias("raw_query"))
    return roster.resolve(_questions(s, d).select("query_id", "raw_query").unionByName(made), entries)


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: _orphans(s, d).select("chunk_id", "ref_field", "target", "reason"),
        "p1_report": lambda s, d: orphans.orphan_report(_orphans(s, d)),
        "q01_tokenize_counts": _term_counts,
        "q02_bm25_corpus_stats": _statistics,
        "q03_bm25_idf_floor": _idf,
        "q04_bm25_topk": _hits,
        "q05_bm25_docfilter_after": _after_cut,
        "q05_bm25_docfilter_before": lambda s, d: _bm25(s, d, 10, group=F.substring_index("chunk_id", "__sec_", 1)).select("query_id", F.col("key").alias("chunk_id"), "rank"),
        "q06_dense_topk": lambda s, d: _nearest(s, d, False),
        "q07_dense_topk_filtered": lambda s, d: _nearest(s, d, True),
        "q08_rrf_fuse": _fused,
        "q09_hybrid_noop_rerank": lambda s, d: _hybrid(s, d).select("query_id", F.col("key").alias("chunk_id"), F.round("fused_score", 6).alias("fused_score"), F.col("final").alias("place")),
        "q09_hybrid_overlap_rerank": lambda s, d: _hybrid(s, d, rerank="overlap").select("query_id", F.col("key").alias("chunk_id"), F.round("rerank_score", 6).alias("rerank_score"), F.col("final").alias("place")),
        "q10_recall_ablation": _ablation,
        "q11_embedding_text_hash": lambda s, d: index.hashes(_chunks(s, d, *_HASHED)),
        "q12_index_plan": _plan,
        "q12_index_plan_summary": lambda s, d: index.plan_summary(_plan(s, d)),
        "q13_index_state": lambda s, d: index.state(table(s, d, "chunks"), table(s, d, "chunk_deletions")),
        "q14_token_batches": lambda s, d: index.token_batches(_chunks(s, d, *_HASHED)),
        "q15_split_oversized": lambda s, d: index.packed_parts(_chunks(s, d, "text")),
        "q16_keyed_fetch_ordered": lambda s, d: context.fetch(_wanted(s, d), _chunks(s, d, "doc_id", "section_id", "text")).select("query_id", "kind", "place", "chunk_id", "doc_id", "section_id", "score"),
        "q17_extract_references": lambda s, d: _view_references(s, d).select("chunk_id", "raw", "target", "relation", "kind"),
        "q17_chunk_references": lambda s, d: _references(s, d).drop("pos"),
        "q18_expand_ranges": lambda s, d: _view_references(s, d).where("relation = 'under'").select("chunk_id", "target"),
        "q18_reference_targets": lambda s, d: _references(s, d).groupBy("target", "relation", "kind").agg(F.count("*").alias("chunks")),
        "q19_extract_terms": _terms,
        "q20_resolve_edges": _resolved,
        "q21_definition_edges": lambda s, d: graph.definition_edges(_chunks(s, d, "doc_id", "section_id", "part", "defines_terms", "defined_terms_used")),
        "q21_view_terms": _view_terms,
        "q21_term_uses": lambda s, d: parsing.term_uses(_chunks(s, d, "doc_id", "text")),
        "q22_dangling_edges": lambda s, d: graph.dangling(graph.reference_edges(table(s, d, "chunks")), table(s, d, "chunks")).select("src", "dst"),
        "q23_corpus_report": lambda s, d: graph.corpus_report(_chunks(s, d, "doc_id", "text", "cross_reference_ids", "definition_ids", "defines_terms")),
        "q24_edge_fanout_topk": lambda s, d: graph.fan_out(graph.reference_edges(_chunks(s, d, "doc_id", "cross_reference_ids"))),
        "q24_edge_sample": lambda s, d: graph.inspect(graph.reference_edges(_chunks(s, d, "doc_id", "cross_reference_ids")), _chunks(s, d, "text")),
        "q25_normalize_lines": _lines,
        "q20_view_edges": lambda s, d: _view_chunks(s, d).select(F.col("chunk_id").alias("src"), F.explode("cross_reference_ids").alias("dst")),
        "q26_parse_sections": _view_sections,
        "q26_build_chunks": _built,
        "q26_document_sections": lambda s, d: parsing.parse_sections(table(s, d, "documents")),
        "q27_toc_span": lambda s, d: parsing.contents_spans(contracts.texts(s, d, True)),
        "q28_referenced_absent": lambda s, d: context.referenced_absent(_context(s, d), _chunks(s, d, *_LISTS)),
        "q29_definitions_absent": lambda s, d: context.definitions_absent(_context(s, d), _chunks(s, d, *_LISTS)),
        "q30_merge_context": _context,
        "q31_prioritized_context": _shown,
        "q31_prompt": lambda s, d: context.prompt(_shown(s, d), _chunks(s, d, "doc_id", "section_id", "section_title", "path", "text")),
        "q32_named_sections": lambda s, d: _questions(s, d).select("query_id", F.posexplode(T.named_sections(F.col("raw_query"))).alias("pos", "section_id")),
        "q33_verify_citations": lambda s, d: context.verify_citations(_answers(s, d), _context(s, d)),
        "q34_claim_evidence": lambda s, d: context.claim_evidence(_answers(s, d), _context(s, d)),
        "q35_wanted_ids": _wanted,
        "q36_list_documents": lambda s, d: _chunks(s, d, "doc_id").groupBy("doc_id").agg(F.count("*").alias("num_chunks")),
        "q37_document_sections": _sections,
        "q38_roster": _roster,
        "q38_roster_resolve": _resolved_names,
        "q39_density": _density,
        "q39_density_select": lambda s, d: _density(s, d).where("chars between 1200 and 260000 and headings >= 1").orderBy(F.desc("score"), "doc_id").limit(15),
        "q40_session_history": lambda s, d: traces.history(table(s, d, "traces")),
        "q40_sessions": lambda s, d: traces.sessions(table(s, d, "traces")),
        "q41_trace_latest_state": lambda s, d: traces.latest(table(s, d, "traces")).select("query_id", "status", "last_node", "iteration", "created_at"),
        "q40_session_queries": lambda s, d: traces.session_queries(table(s, d, "traces")),
        "q41_trace_replay": lambda s, d: traces.replay(table(s, d, "traces")),
        "q42_usage_rollup": lambda s, d: traces.usage(table(s, d, "events")),
        "q42_latency_by_node": lambda s, d: traces.latency(table(s, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("node"), F.col("value").alias("latency_ms"))),
        "q43_rate_window": lambda s, d: traces.rate(table(s, d, "events")),
        "q44_agent_outcomes": lambda s, d: _agent(s, d).questions,
        "q44_agent_context": lambda s, d: _agent(s, d).context,
        "q44_scripted_outcomes": lambda s, d: _agent(s, d, _script()).questions.select("query_id", "query_type", "needs_retrieval", "iteration", "strategy", "sufficient", "low_confidence", "confidence"),
        "q44_scripted_log": lambda s, d: _agent(s, d, _script()).log.select("query_id", "iteration", "step", "strategy"),
    }
