"""Core operators on small rows: formulas, ties, nulls, repeats, empty tables."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import agent, context, graph, index, models, orphans, ranking, retrieval, roster, traces
from clausemill.operators.joins import salted_join

DAY = datetime(2024, 1, 1)
ORPHANS = "chunk_id string, doc_id string, cross_references array<string>, cross_reference_ids array<string>, definition_ids array<string>, indexed_at timestamp_ntz, target string, range_no int"


def at(n):
    return DAY + timedelta(days=n)


def orphan_tables(spark):
    chunks = [
        ("a", "d", [" 1.1. ", "9.9", None, "", "ART-1"], ["b", "gone", "late", "never", "back"], ["b", "b"], at(5), "x", 1),
        ("a", "d", [" 1.1. ", "9.9", None, "", "ART-1"], ["b", "gone", "late", "never", "back"], ["b", "b"], at(9), "x", 1),
        ("b", "d", None, [], None, at(1), "x", 1), ("gone", "d", [], [], [], at(1), "x", 1), ("late", "d", ["2.2"], [], [], at(8), "x", 1), ("back", "d", [], [], [], at(1), "x", 1),
        ("back", "d", [], [], [], at(7), "x", 1), (None, "d", ["7"], ["zz"], [], at(1), "x", 1), ("nodoc", None, ["1.1"], [], [], None, "x", 1),
    ]
    sections = [("d", "1.1", at(1)), ("d", "1.1", at(9)), ("d", "art-1", at(6)), ("d", "2.2", None), ("e", "9.9", at(1))]
    deletions = [("gone", at(3)), ("gone", at(2)), ("back", at(4)), ("never2", at(1))]
    return spark.createDataFrame(chunks, ORPHANS), spark.createDataFrame(sections, "doc_id string, section_id string, parsed_at timestamp_ntz"), spark.createDataFrame(deletions, "chunk_id string, deleted_at timestamp_ntz")


@pytest.mark.parametrize("range_rows, batch_rows", [(100_000, 200_000), (1, 1)])
def test_orphans(spark, range_rows, batch_rows):
    got = {(r.chunk_id, r.ref_field, r.target, r.reason) for r in orphans.orphans(*orphan_tables(spark), range_rows, batch_rows).collect()}
    assert got == {
        ("a", "cross_references", "9.9", "missing"), ("a", "cross_references", "ART-1", "late"), ("a", "cross_reference_ids", "gone", "deleted"), ("a", "cross_reference_ids", "late", "late"),
        ("a", "cross_reference_ids", "never", "missing"), ("nodoc", "cross_references", "1.1", "missing"),
    }


def test_orphans_of_empty_tables(spark):
    c, s, d = orphan_tables(spark)
    assert orphans.orphans(c.limit(0), s.limit(0), d.limit(0)).collect() == []
    got = orphans.orphans(c, s.limit(0), d.limit(0))
    assert got.where("ref_field = 'cross_references' and reason <> 'missing'").collect() == []


def test_numbering_across_slices(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), i) for i in rng.sample(range(10_000), 600)]
    got = {(r.g, r.v): r.no for r in ranking.numbered(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.col("v").desc()], "no").collect()}
    for g in {g for g, _ in rows}:
        for no, v in enumerate(sorted((v for h, v in rows if h == g), reverse=True), 1):
            assert got[g, v] == no


def test_salted_join(spark):
    many = spark.createDataFrame([("k", i) for i in range(50)] + [(None, 1), ("z", 2)], "key string, i int")
    one = spark.createDataFrame([("k", "v"), (None, "n")], "key string, v string")
    assert salted_join(many, one, "key", "i").count() == 50


def test_running_sums_over_slices(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 60), rng.randint(-5, 5)) for _ in range(500)]
    got = ranking.running(spark.createDataFrame(rows, "at int, v long"), "at", ["v"]).collect()
    assert len(got) == 500 and all(r.sum_v == sum(v for x, v in rows if x <= r["at"]) for r in got)


def test_bm25_keeps_the_best_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRS", 7)
    rng = random.Random(4)
    docs = [(f"d{k:03}", " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(1, 5)))) for k in range(90)]
    df = spark.createDataFrame(docs, "chunk_id string, text string")
    q = spark.createDataFrame([("q1", "alpha"), ("q2", "beta gamma gamma")], "query_id string, raw_query string")
    every = {(r.query_id, r.key): (r.score, r["rank"]) for r in retrieval.bm25(q, df, "chunk_id", F.col("text"), 90).collect()}
    few = {(r.query_id, r.key): (r.score, r["rank"]) for r in retrieval.bm25(q, df, "chunk_id", F.col("text"), 4).collect()}
    assert few == {k: v for k, v in every.items() if v[1] <= 4} and len(few) == 8


def test_bm25_by_formula(spark):
    docs = {"a": "alpha beta beta", "b": "alpha gamma", "c": "delta", "d": None, "e": "the of"}
    df = spark.createDataFrame(list(docs.items()), "chunk_id string, text string")
    questions = spark.createDataFrame([("q1", "Beta beta ALPHA"), ("q2", "the"), ("q3", None)], "query_id string, raw_query string")
    got = {(r.query_id, r.key): (r.score, r.rank) for r in retrieval.bm25(questions, df, "chunk_id", F.col("text"), 5).collect()}
    n, lengths = 5, {"a": 3, "b": 2, "c": 1}
    mean = 6 / 5
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in {"alpha": 2, "beta": 1, "gamma": 1, "delta": 1}.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / 4 for t, v in raw.items()}

    def part(t, tf, d):
        return idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lengths[d] / mean))

    assert got == {("q1", "a"): (pytest.approx(2 * part("beta", 2, "a") + part("alpha", 1, "a")), 1), ("q1", "b"): (pytest.approx(part("alpha", 1, "b")), 2)}
    assert retrieval.bm25(questions, df.limit(0), "chunk_id", F.col("text")).collect() == []


def test_two_documents_tie_at_nothing(spark):
    df = spark.createDataFrame([("x", "alpha"), ("y", "beta")], "chunk_id string, text string")
    q = spark.createDataFrame([("q", "beta alpha")], "query_id string, raw_query string")
    assert [(r.key, r.score) for r in retrieval.bm25(q, df, "chunk_id", F.col("text")).orderBy("rank").collect()] == [("x", 0.0), ("y", 0.0)]


def test_dense_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(120, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)] + [(500, None, 0), (501, [0.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for same in (False, True):
        got = {(r.query_vec, r["rank"]): r.vec_id for r in retrieval.dense(df, df.where("vec_id < 5"), 4, same).collect()}
        for q in range(5):
            s = [(-round(float(unit[q] @ unit[i]), 9), i) for i in range(120) if not same or i % 3 == q % 3]
            assert [got[q, k] for k in range(1, 5)] == [i for _, i in sorted(s)[:4]]
    assert retrieval.dense(df.limit(0), df.limit(0)).collect() == []


def test_rank_fusion(spark):
    lists = spark.createDataFrame([("q", "a", "dense", 1), ("q", "a", "sparse", 1), ("q", "b", "dense", 2), ("q", "c", "sparse", 2), ("q", "c", "sparse", 9)], "query_id string, key string, retriever string, rank int")
    got = {r.key: (r.score, r.place, r.ranks) for r in retrieval.reciprocal_ranks(lists).collect()}
    assert got["a"] == (pytest.approx(2 / 61), 1, {"dense": 1, "sparse": 1}) and got["b"][1] == 2 and got["c"][1] == 3
    assert {r.key: r.place for r in retrieval.reciprocal_ranks(lists, {"sparse": 3.0}).collect()}["c"] == 2
    with pytest.raises(ValueError):
        retrieval.hybrid(lists, lists, lists, False, False)
    with pytest.raises(ValueError):
        retrieval.reranker("hosted")


GRAPH = "chunk_id string, doc_id string, section_id string, part int, cross_references array<string>, cross_reference_ids array<string>, defines_terms array<string>, defined_terms_used array<string>, definition_ids array<string>, text string, indexed_at timestamp_ntz"


def graph_tables(spark):
    rows = [
        ("d__sec_1.1", "d", "1.1", 1, ["4.2(a)(i)", "ART-9", "1.1", "7"], [], ["Fee"], ["Fee", "Term"], [], "one", at(1)),
        ("d__sec_4.2__p1", "d", "4.2__p1", 1, [], ["d__sec_1.1", None, ""], ["Term"], [], [], "two", at(1)), ("d__sec_4.2__p2", "d", "4.2__p2", 2, ["4.2"], ["nowhere"], [], ["Fee"], [], "three", at(1)),
        ("d__sec_9.1", "d", "9.1", 1, [], [], None, None, None, None, at(1)), ("d__sec_9.2", "d", "9.2", 1, None, None, [], [], [], "", at(1)), ("d__sec_9.2", "d", "9.2", 1, None, None, [], [], [], "", at(2)),
    ]
    return spark.createDataFrame(rows, GRAPH), spark.createDataFrame([("d", "ART-9", ["9.1", "9.2"]), ("d", "4.2", None)], "doc_id string, section_id string, children array<string>")


def test_graph(spark):
    chunks, sections = graph_tables(spark)
    now = graph.current(chunks)
    assert now.count() == 5
    got = {tuple(r) for r in graph.resolve(now, sections).collect()}
    assert got == {("d__sec_1.1", "4.2(a)(i)", "d__sec_4.2__p1", "ancestor"), ("d__sec_1.1", "art-9", "d__sec_9.1", "below"), ("d__sec_1.1", "art-9", "d__sec_9.2", "below")}
    assert {tuple(r) for r in graph.definition_edges(now).collect()} == {("d", "d__sec_1.1", "Term", "d__sec_4.2__p1"), ("d", "d__sec_4.2__p2", "Fee", "d__sec_1.1")}
    edges = graph.reference_edges(now)
    assert {(r.src, r.dst) for r in edges.collect()} == {("d__sec_4.2__p1", "d__sec_1.1"), ("d__sec_4.2__p2", "nowhere")}
    assert [r.dst for r in graph.dangling(edges, now).collect()] == ["nowhere"]
    report = graph.corpus_report(now).first()
    assert (report.documents, report.chunks, report.terms, report.median_length, report.p95_length) == (1, 5, 2, 3, 5)
    assert graph.resolve(now.limit(0), sections.limit(0)).collect() == []


def test_ancestors(spark):
    got = spark.createDataFrame([("4.2(a)(i)",), ("4.2.1",), ("ART-9",), ("7",)], "s string").select("s", T.ancestors(F.col("s")).alias("a")).collect()
    assert {r.s: r.a for r in got} == {"4.2(a)(i)": ["4.2(a)(i)", "4.2(a)", "4.2", "4"], "4.2.1": ["4.2.1", "4.2", "4"], "ART-9": ["ART-9"], "7": ["7"]}


def test_context(spark):
    rows = spark.createDataFrame([("q", 2, "a", "search"), ("q", 1, "b", "search"), ("q", 3, "b", "graph_traversal"), ("q", 9, "c", "direct_lookup")], "query_id string, seq long, chunk_id string, source string")
    merged = context.merge(rows)
    assert {(r.chunk_id, r.source) for r in merged.collect()} == {("a", "search"), ("b", "search"), ("c", "direct_lookup")}
    assert [r.chunk_id for r in context.prioritized(merged, 2).orderBy("place").collect()] == ["c", "b"]
    chunks = spark.createDataFrame(
        [("a", ["x__sec_1", "b", "y__sec_2"], ["T", "U"], ["x__sec_1", "x__sec_1"]), ("b", ["y__sec_2"], ["T"], []), ("c", None, None, None)],
        "chunk_id string, cross_reference_ids array<string>, defined_terms_used array<string>, definition_ids array<string>",
    )
    refs = context.referenced_absent(merged, chunks)
    assert [(r.label, r.chunk_id) for r in refs.orderBy("place").collect()] == [("y §2", "y__sec_2"), ("x §1", "x__sec_1")]
    assert context.referenced_absent(merged, chunks, 1).count() == 1
    defs = context.definitions_absent(merged, chunks)
    assert [r.label for r in defs.orderBy("place").collect()] == ['x "T"', 'x "U"']
    offered = refs.withColumn("kind", F.lit(1)).unionByName(defs.withColumn("kind", F.lit(2)))
    chosen = spark.createDataFrame([("q", 'x "U"'), ("q", 'x "T"'), ("q", "invented")], "query_id string, label string")
    assert [r.chunk_id for r in context.wanted(chosen, offered).collect()] == ["x__sec_1"]


def test_citations_and_claims(spark):
    answer = '- **Fee** The fee is due [d §1.1]. It follows "too" [d § 1.1][e §9(a)].\nNo source here.\n* Bad [x §0]'
    a = spark.createDataFrame([("q", answer), ("r", None)], "query_id string, answer string")
    held = spark.createDataFrame([("q", "d", "1.1", "d1"), ("q", "e", "9(a)", "e9")], "query_id string, doc_id string, section_id string, chunk_id string")
    assert [(r.doc_id, r.section_id, r.verified) for r in context.verify_citations(a, held).orderBy("place").collect()] == [("d", "1.1", True), ("e", "9(a)", True), ("x", "0", False)]
    got = [(r.claim_no, r.claim, r.chunk_id) for r in context.claim_evidence(a, held).orderBy("claim_no", "place").collect()]
    assert [(n, c) for n, _, c in got] == [(0, "d1"), (1, "d1"), (1, "e9")] and got[0][1] == "Fee The fee is due [d §1.1]."


@pytest.mark.parametrize("text, want", [("What does section 2.2.2 say?", ["2.2.2"]), ("§ 4.2(a) and 4.2(a), clause 3.1", ["4.2(a)", "3.1"]), ("in 30 days", []), (None, None)])
def test_named_sections(spark, text, want):
    assert spark.createDataFrame([(text,)], "q string").select(T.named_sections(F.col("q"))).first()[0] == want


def test_index_plan_and_upsert(spark):
    now = spark.createDataFrame([("a", "h1", 5), ("b", "h2", 6), ("c", "h3", 7)], "chunk_id string, content_hash string, tokens int")
    old = spark.createDataFrame([("a", "h1"), ("b", "x"), ("z", "h9")], "chunk_id string, content_hash string")
    assert {(r.chunk_id, r.action, r.tokens) for r in index.plan(now, old).collect()} == {("a", "keep", 0), ("b", "embed", 6), ("c", "embed", 7), ("z", "delete", 0)}
    new = now.select("chunk_id", "content_hash")
    once = index.upsert(old, new, spark.createDataFrame([("z",)], "chunk_id string"))
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in index.upsert(once, new).collect()} == {("a", "h1"), ("b", "h2"), ("c", "h3")}


def test_index_is_built_and_kept(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "p", "t", "text one"), ("b", None, "", None)], "chunk_id string, path string, section_title string, text string")
    assert index.build(spark, chunks, str(tmp_path)).where("action = 'embed'").count() == 2
    changed = spark.createDataFrame([("a", "p", "t", "text two")], chunks.schema)
    assert {(r.chunk_id, r.action) for r in index.build(spark, changed, str(tmp_path)).collect()} == {("a", "embed"), ("b", "delete")}
    name = (tmp_path / "current.txt").read_text().strip()
    held = spark.read.parquet(str(tmp_path / name)).collect()
    assert [r.chunk_id for r in held] == ["a"] and len(held[0].embedding) == index.DIMENSIONS


def test_an_index_of_another_dimension_is_made_anew(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([("a", "p", "t", "text one"), ("b", None, "", "two")], "chunk_id string, path string, section_title string, text string")
    index.build(spark, chunks, str(tmp_path))
    assert index.build(spark, chunks, str(tmp_path)).where("action = 'embed'").count() == 0
    assert index.usable(index.stored(spark, str(tmp_path)), index.DIMENSIONS) and not index.usable(index.stored(spark, str(tmp_path)), 8) and not index.usable(None, 8)
    monkeypatch.setitem(index.EMBEDDERS, index.MODEL, lambda texts, mode: np.ones((len(texts), 8), np.float32))
    assert index.build(spark, chunks, str(tmp_path)).where("action = 'embed'").count() == 2
    assert {len(r.embedding) for r in index.stored(spark, str(tmp_path)).collect()} == {8}


def test_pace():
    now, slept = [100.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = index.Pace(2, 100, lambda: now[0], sleep)
    assert pace.wait(40) == 0 and pace.wait(50) == 0
    now[0] = 110.0
    assert pace.wait(10) == pytest.approx(50) and now[0] == 160  # the third request of the minute
    now[0] = 161.0
    assert pace.wait(95) == pytest.approx(59)  # too many tokens until the last call has left
    now[0] = 400.0
    assert pace.wait(5000) == 0 and pace.wait(1) == pytest.approx(60)
    assert index.request_tokens(10_000, 3) == 3000 and index.request_tokens(100, 60) == 1000
    with pytest.raises(ValueError):
        index.embedder("hosted")


def test_point_ids_and_display(spark):
    import uuid

    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    ids = ["d__sec_1.1", "é §", ""]
    got = spark.createDataFrame([(i,) for i in ids], "c string").select(T.point_id(F.col("c"), space)).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.UUID(space), i)) for i in ids]
    row = retrieval.for_display(spark.createDataFrame([("q", 0.123456, 0.0312345678, "x" * 400)], "q string, score double, fused_score double, text string")).first()
    assert (row.score, row.fused_score, len(row.excerpt)) == (0.1235, 0.03123, 300)
    assert spark.createDataFrame([("a\nb",)], "t string").select(T.on_one_line(F.col("t"))).first()[0] == "a b"


def test_token_batches_cover_all(spark):
    rows = [(f"c{k:03}", None, None, "x" * (4 * (k % 50))) for k in range(230)]
    df = spark.createDataFrame(rows, "chunk_id string, path string, section_title string, text string")
    got = index.token_batches(df, 100, 5, 60).collect()
    assert len(got) == 230
    sums = {}
    for r in got:
        sums.setdefault((r.block, r.batch), []).append(r.tokens)
    assert all(sum(v) <= 100 or len(v) == 1 for v in sums.values()) and all(len(v) <= 5 for v in sums.values()) and len({b for b, _ in sums}) == 4


def test_references_reach_below_containers(spark):
    rows = [("d__sec_1", "d", "1", 1, ["ART-5"], [], [], [], [], "one", at(1)), *[(f"d__sec_{x}", "d", x, 1, [], [], [], [], [], "x", at(1)) for x in ("5.2", "5.1.1", "5.3.1.1")]]
    tree = [("d", "ART-5", ["5.1", "5.2", "5.3"]), ("d", "5.1", ["5.1.1", "ART-5"]), ("d", "5.3", ["5.3.1"]), ("d", "5.3.1", ["5.3.1.1"])]
    sections = spark.createDataFrame(tree, "doc_id string, section_id string, children array<string>")
    got = {(r.dst, r.how) for r in graph.resolve(spark.createDataFrame(rows, GRAPH), sections).collect()}
    assert got == {("d__sec_5.2", "below"), ("d__sec_5.1.1", "below"), ("d__sec_5.3.1.1", "below")}


def test_roster(spark):
    names = {"NORTHPHARMACEUTICALSINC": "North Pharmaceuticals INC", "BrightTherapeuticsInc": "Bright Therapeutics INC", "ACMEWORKS,LLC": "Acmeworks, LLC", "_a-": "A", "": "", "GROUP": "Group"}
    got = spark.createDataFrame(list(names.items()), "n string, w string").select("w", roster.clean_company(F.col("n")).alias("c")).collect()
    assert [r.c for r in got] == [r.w for r in got]
    m = spark.createDataFrame([("doc_1", "NORTHPHARMACEUTICALSINC_10-K_Supply Agreement.txt", "t"), ("doc_2", "acmeworks-Development And Option Agreement.txt", "t"), (None, "x.txt", "t"), ("doc_1", "NORTHPHARMACEUTICALSINC_10-K_Supply Agreement.txt", "t")], "doc_id string, source_file string, title string")
    r = roster.roster(m)
    assert {(x.doc_id, x.kind) for x in r.collect()} == {("doc_1", "Supply Agreement"), ("doc_2", "Development And Option Agreement")}
    q = spark.createDataFrame([("a", "What of DOC_2?"), ("b", "the North Pharmaceuticals deal"), ("c", "is Acmeworks bound"), ("d", "making things"), ("e", None)], "query_id string, raw_query string")
    assert {(x.query_id, x.doc_id) for x in roster.resolve(q, r).collect()} == {("a", "doc_2"), ("b", "doc_1"), ("c", "doc_2")}


def test_names_of_many_words(spark):
    e = spark.createDataFrame([("d1", "The Bank Of New York Mellon Trust Company", "Agreement", "t"), ("d0", "Mellon Foods", "Agreement", "t")], "doc_id string, company string, kind string, title string")
    q = spark.createDataFrame([("a", "What does The Bank of New York Mellon Trust Company owe?"), ("b", "Mellon Foods")], "query_id string, raw_query string")
    assert {(x.query_id, x.doc_id, x.rule) for x in roster.resolve(q, e).collect()} == {("a", "d1", 2), ("b", "d0", 2)}


def test_traces(spark):
    u = spark.createDataFrame([("q", 2, "b", "confidence", "high"), ("q", 1, "a", "confidence", "low"), ("q", 3, "c", "secret", "x"), ("q", 2, "b", "confidence", "high"), ("r", 1, "a", "error", None)], "query_id string, seq long, node string, key string, value string")
    got = {r.query_id: (r.fields, r.last_node) for r in traces.merged(u).collect()}
    assert got == {"q": ({"confidence": "high"}, "c"), "r": ({"error": None}, "a")}


def test_rate_window(spark):
    at_s = [0, 10, 59.999999, 60, 60.000001, 3599, 3600, 3658, 3658]
    rows = [(i, DAY + timedelta(seconds=s), float(i)) for i, s in enumerate(at_s)] + [(99, None, 1.0)]
    got = {r.event_id: (r.requests, r.tokens) for r in traces.rate(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double")).collect()}
    assert got == {i: (sum(1 for x in at_s if s - 60 < x <= s), float(sum(k for k, x in enumerate(at_s) if s - 60 < x <= s))) for i, s in enumerate(at_s)}
    assert traces.rate(spark.createDataFrame([], "event_id long, ts timestamp_ntz, value double")).collect() == []


def test_traces_are_written_and_read(spark, tmp_path):
    q = spark.createDataFrame([("q", "s", "Why?", "d"), ("r", "s", "How?", None)], "query_id string, session_id string, raw_query string, doc_id string")
    begun = traces.started(q, F.lit(DAY))
    over = traces.ended(begun, spark.createDataFrame([("r", "no model")], "query_id string, error string"), F.lit(at(1)))
    assert {(r.query_id, r.status, r.error, r.completed_at) for r in over.collect()} == {("q", "complete", None, at(1)), ("r", "failed", "no model", None)}
    traces.save(begun, str(tmp_path / "log"))
    traces.save(over.drop("completed_at"), str(tmp_path / "log"))
    held = spark.read.parquet(str(tmp_path / "log")).withColumn("iteration", F.lit(1)).withColumn("last_node", F.lit("generate"))
    assert {(r.query_id, r.status) for r in traces.latest(held).collect()} == {("q", "complete"), ("r", "failed")}
    assert {(r.session_id, r.query_id) for r in traces.session_queries(held).collect()} == {("s", "q"), ("s", "r")}
    step = spark.createDataFrame([("q", True, ["a", "b"], "x", ["c1", "c2"])], "query_id string, sufficient boolean, sections_needed array<string>, secret string, context array<string>")
    assert {(r.key, r.value) for r in traces.updates_of(step, "sufficiency", 3).collect()} == {("sufficient", "true"), ("sections_needed", '["a","b"]')}
    assert traces.public_state(step).first().context_size == 2 and "context" not in traces.public_state(step).columns


def test_replay_tells_the_stored_rounds(spark):
    rounds = '[{"trigger":"initial","sufficiency":{"sufficient":false}},{"trigger":"graph_traversal","sufficiency":{"sufficient":true}},{"trigger":"query_rewrite"}]'
    t = spark.createDataFrame([("q", "complete", DAY, 2, "n", "factual", rounds, "said", None), ("r", "running", DAY, 0, "n", None, None, None, None)], "query_id string, status string, created_at timestamp_ntz, iteration int, last_node string, query_type string, iterations string, final_answer string, faithfulness string")
    got = {}
    for r in traces.replay(t).orderBy("query_id", "step").collect():
        got.setdefault(r.query_id, []).append(r.node)
    assert got == {"q": ["planner", "retrieve", "sufficiency", "refine", "sufficiency", "retrieve", "generate"]}


def test_usage(spark):
    log = spark.createDataFrame([("q", "planner", 5.0, 10, None), ("q", "retrieve", 2.0, None, 1), ("q", "retrieve", 3.0, 4, 2), (None, "x", 1.0, 1, 1)], "query_id string, node string, latency_ms double, input_tokens long, output_tokens long")
    assert {tuple(r) for r in traces.latency(log).collect()} == {("q", "planner", 5.0), ("q", "retrieve", 5.0)}
    assert [tuple(r) for r in traces.token_totals(log).collect()] == [("q", 14, 3)]


def test_trace_stream(spark, tmp_path):
    from clausemill.streaming import trace_state

    source = tmp_path / "in"
    for k in range(2):
        spark.createDataFrame([("q", k, f"n{k}", "confidence", str(k))], trace_state.UPDATES).write.mode("append").json(str(source))
        trace_state.persist(trace_state.read_updates(spark, str(source)), str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    row = trace_state.view(spark, str(tmp_path / "log")).first()
    assert row.fields == {"confidence": "1"} and row.last_node == "n1"


@pytest.mark.parametrize(
    "sufficient, iteration, pulled, strategy, error, want",
    [(False, 1, True, "", "x", "generate"), (True, 1, True, "", None, "generate"), (False, 3, True, "", None, "generate"), (False, 1, False, "query_rewrite", None, "generate"), (False, 1, False, "", None, "refine"), (False, 2, True, "query_rewrite", None, "refine")],
)
def test_routing(spark, sufficient, iteration, pulled, strategy, error, want):
    df = spark.createDataFrame([(sufficient, iteration, pulled, strategy, error)], "s boolean, i int, p boolean, st string, e string")
    assert df.select(agent.route(F.col("s"), F.col("i"), F.col("p"), F.col("st"), F.col("e"))).first()[0] == want


def test_agent_follows_edges(spark):
    rows = [
        ("d__sec_1.1", "d", "1.1", "Payment", "The fee is paid under the schedule of charges.", 1, ["d__sec_2.1"], [], []), ("d__sec_2.1", "d", "2.1", "Charges", "Charges for the fee are listed here.", 1, [], [], []),
        ("d__sec_3.1", "d", "3.1", "Law", "English law applies.", 1, [], [], []),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, section_id string, section_title string, text string, part int, cross_reference_ids array<string>, defined_terms_used array<string>, definition_ids array<string>")
    entries = spark.createDataFrame([("d", "Acmeworks INC", "Agreement", "t")], "doc_id string, company string, kind string, title string")
    q = spark.createDataFrame([("q1", "When is Acmeworks payment due?"), ("q2", "hello"), ("q3", "hello, what is in section 3.1 of Acmeworks?"), ("q1", "When is Acmeworks payment due?")], "query_id string, raw_query string")
    got = agent.answer(q, chunks, entries)
    outcome = {r.query_id: r for r in got.questions.collect()}
    assert not outcome["q2"].needs_retrieval and outcome["q3"].needs_retrieval and outcome["q3"].query_type == "overview"
    held = {(r.query_id, r.chunk_id): r.source for r in got.context.collect()}
    assert held["q3", "d__sec_3.1"] == "direct_lookup" and ("q1", "d__sec_1.1") in held
    assert all(r.verified for r in got.checks.collect()) and got.claims.count() > 0
    assert max(r.iteration for r in got.log.collect()) <= agent.ROUNDS
    assert agent.answer(q.limit(0), chunks, entries).questions.collect() == []


CLAUSES = "chunk_id string, doc_id string, section_id string, section_title string, text string, part int, cross_reference_ids array<string>, defined_terms_used array<string>, definition_ids array<string>"


def clauses(spark):
    rows = [(f"d__sec_{k}", "d", str(k), "Payment", f"Clause {k}: the fee number {k} is due.", 1, ["d__sec_9"] if k == 1 else [], [], []) for k in range(1, 10)]
    entries = spark.createDataFrame([("d", "Acmeworks INC", "Agreement", "t")], "doc_id string, company string, kind string, title string")
    return spark.createDataFrame(rows, CLAUSES), entries


def test_a_hosted_model_and_its_failures(spark):
    import json

    asked = []

    def complete(system, user):
        if "what kind of question" in system:
            return json.dumps({"query_type": "factual", "needs_retrieval": "hello" not in user, "sub_queries": ["fee number 1", "fee number 2"]}) if "broken" not in user else "no JSON at all"
        if "Decide whether" in system:
            assert "[d §" in user
            return 'Sure: {"sufficient": false, "missing_info": "clause 9", "wanted": ["d §9", "made up"]}' if "Labels offered" in user else '{"sufficient": true, "wanted": []}'
        if "Word it anew" in system:
            return '{"rewritten": "due fee"}'
        if "Answer from the clauses" in system:
            if "broken" in user:
                raise RuntimeError("no model")
            return json.dumps({"summary": "The fee is due [d §1].", "answer": "- Fee 1 is due [d §1].\n- Fee 77 is due [d §77].", "confidence": "high"})
        return json.dumps({"supported": "77" not in user})

    chunks, entries = clauses(spark)
    q = spark.createDataFrame([("q1", "Which fee?"), ("q2", "hello"), ("q3", "broken fee number 1")], "query_id string, raw_query string")
    proposed = models.Scripted(plans=lambda q: q.select("query_id", F.lit("factual").alias("query_type"), F.lit(True).alias("needs_retrieval"), F.array("raw_query").alias("sub_queries"), F.when(F.col("query_id") == "q1", "d").otherwise("invented").alias("doc_id")))
    assert {(r.query_id, r.doc_id) for r in agent.plan(q, entries, proposed).collect()} == {("q1", "d"), ("q2", None), ("q3", None)}
    got = agent.answer(q, chunks, entries, models.Prompted(complete))
    outcome = {r.query_id: r for r in got.questions.collect()}
    said = {r.query_id: r for r in got.answers.collect()}
    assert outcome["q1"].needs_retrieval and not outcome["q2"].needs_retrieval and outcome["q3"].needs_retrieval and asked == []
    assert said["q2"].confidence == "high" and "Acmeworks INC" in said["q2"].answer and outcome["q2"].iteration == 0
    assert said["q1"].unverified_citations == ["[d §77]"] and said["q1"].answer.endswith("could not be checked: [d §77]")
    assert said["q3"].confidence == "low" and outcome["q3"].low_confidence and "No answer" in said["q3"].answer
    assert {r.supported for r in got.claims.where("query_id = 'q1'").collect()} == {True}
    assert ("q1", "d__sec_9") in {(r.query_id, r.chunk_id) for r in got.context.collect()}


def test_a_question_is_worded_anew_and_ends(spark):
    chunks, entries = clauses(spark)
    script = models.Scripted(
        judges=lambda q, offered: q.select("query_id", F.lit(False).alias("sufficient"), F.lit("rest").alias("missing_info"), F.array().cast("array<string>").alias("wanted")),
        rewrites=lambda q: q.select("query_id", F.lit("fee number 7").alias("rewritten")).limit(0),
    )
    q = spark.createDataFrame([("q1", "clause 3"), ("q2", None)], "query_id string, raw_query string")
    got = agent.answer(q, chunks, entries, script)
    steps = [(r.step, r.iteration, r.strategy) for r in got.log.where("query_id = 'q1'").orderBy("at").collect()]
    assert steps == [("retrieve", 1, ""), ("sufficiency", 1, ""), ("refine", 1, "query_rewrite"), ("retrieve", 2, "query_rewrite"), ("sufficiency", 2, "query_rewrite")]
    one = got.questions.where("query_id = 'q1'").first()
    assert one.low_confidence and one.confidence == "low" and not one.sufficient
    empty = agent.answer(q, chunks.limit(0), entries)
    assert {(r.confidence, r.low_confidence) for r in empty.questions.collect()} == {("low", True)} and all("Nothing" in r.answer for r in empty.answers.collect())
    assert agent.answer(q.limit(0), chunks, entries).answers.collect() == []


def test_rules_check_claims(spark):
    rows = [("q", 0, "The fee is due [d §1].", "a fee is due"), ("q", 1, "The moon is made of cheese [d §1].", "a fee is due")]
    got = models.Rules().checks(spark.createDataFrame(rows, "query_id string, claim_no int, claim string, evidence string")).collect()
    assert {(r.claim_no, r.supported) for r in got} == {(0, True), (1, False)}
    long = "x" * 500 + ". More."
    shown = spark.createDataFrame([("q", 1, "d", "1", long)], "query_id string, place int, doc_id string, section_id string, text string")
    assert models.Rules().answers(shown, shown).first().answer == f"- {'x' * 500}. [d §1]"
    plans = models.Rules().plans(spark.createDataFrame([("q", "What is due; who pays?")], "query_id string, raw_query string")).first()
    assert plans.sub_queries == ["What is due", "who pays?"]


def test_agent_searches_the_named_agreement(spark):
    rows = [(f"{d}__sec_{k}", d, str(k), "Payment", "When is payment due? Payment is due now." if d == "e" else "A fee for payment.", 1, [], [], []) for d in ("d", "e") for k in range(1, 9)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, section_id string, section_title string, text string, part int, cross_reference_ids array<string>, defined_terms_used array<string>, definition_ids array<string>")
    entries = spark.createDataFrame([("d", "Acmeworks INC", "Agreement", "t")], "doc_id string, company string, kind string, title string")
    q = spark.createDataFrame([("q1", "When is Acmeworks payment due?")], "query_id string, raw_query string")
    assert {r.chunk_id[0] for r in agent.answer(q, chunks, entries).context.collect()} == {"d"}


def test_formats(spark):
    row = spark.createDataFrame([("p", "t", "b"), (None, "", "b"), ("p", None, None)], "path string, section_title string, text string").select(T.embedding_text().alias("e")).collect()
    assert [r.e for r in row] == ["p t\n\nb", "b", "p\n\n"]
    import hashlib

    h = spark.createDataFrame([("héllo",)], "t string").select(T.content_hash(F.col("t"), "m")).first()[0]
    assert h == hashlib.sha256("m\x00héllo".encode()).hexdigest()[:32]
    assert spark.createDataFrame([("d__sec_9.1",), ("plain",)], "c string").select(T.label(F.col("c"))).collect()[0][0] == "d §9.1"
    d = spark.createDataFrame([('“Working Day” means a day (the "Seller") and "Big  Term" shall mean x.',), ('("X") is none, "No" means short',)], "t string").select(T.defined_terms(F.col("t"))).collect()
    assert d[0][0] == ["Working Day", "Big Term", "Seller"] and d[1][0] == []


def test_many_questions_are_searched_in_little_memory(spark, monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n, m = np.random.default_rng(5), 6000, 4096
    asked = rng.standard_normal((n, 64))
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    held = rng.standard_normal((m, 64))
    held[m // 2 :] = held[: m // 2]  # every vector twice
    keys = [f"k{i:05d}" for i in rng.permutation(m)]
    tasks = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: tasks.append(f) or spark.createDataFrame([], schema))
    questions = spark.range(n).select(F.format_string("%05d", "id").alias("query_id"), F.lit("x").alias("raw_query"), F.when(F.col("id") % 1000 == 0, "b").alias("doc_id")).coalesce(1)
    vectors = spark.createDataFrame([], "key string, own string, embedding array<float>")
    retrieval.dense_texts(questions, vectors, lambda texts, mode: asked)
    own = ["b" if i % 100 == 0 else "a" for i in range(m)]
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own), pa.array(list(held))], names=["key", "own", "embedding"])
    tracemalloc.start()
    rows = [r for b in tasks[0](iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((-r["score"], r["key"]))
    unit = held / np.linalg.norm(held, axis=1, keepdims=True)
    for i in [*range(0, n, 1000), *range(7, n, 500)]:
        every = sorted((-s, k) for s, k, o in zip(np.round(unit @ asked[i], 9), keys, own) if i % 1000 or o == "b")
        assert sorted(got[f"{i:05d}"]) == every[: retrieval.TOP_N]
    assert peak < 300 << 20


def test_weights_below_zero_and_groups_are_scored(spark):
    """Against sums pair by pair: words in most texts, where a corpus is small, have weights of zero and below."""
    import math
    from collections import Counter

    texts = [("a1", "a", "fee fee due"), ("a2", "a", "fee law"), ("b1", "b", "fee due law law"), ("b2", "b", "rent"), ("b3", "b", None), ("a3", "a", "fee due rent")]
    docs = spark.createDataFrame(texts, "key string, own string, text string")
    asked = {"q1": ("fee", None), "q2": ("fee fee rent", "b"), "q3": ("due law nothing", "a"), "q4": ("nothing", None), "q5": (None, None), "q6": ("law", "c")}
    questions = spark.createDataFrame([(q, *x) for q, x in asked.items()], "query_id string, raw_query string, doc_id string")
    split = {k: (t or "").split() for k, _, t in texts}
    df = Counter(w for ws in split.values() for w in set(ws))
    raw = {w: math.log(6 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else retrieval.EPSILON * sum(raw.values()) / len(raw) for w, x in raw.items()}
    mean, want = sum(map(len, split.values())) / 6, set()
    for q, (text, of) in asked.items():
        for k, own, _ in texts:
            shared = [w for w in (text or "").split() if w in split[k]]
            if shared and of in (None, own):
                size = retrieval.K1 * (1 - retrieval.B + retrieval.B * len(split[k]) / mean)
                want.add((q, k, round(sum(idf[w] * split[k].count(w) * (retrieval.K1 + 1) / (split[k].count(w) + size) for w in shared), 9)))
    assert min(idf.values()) <= 0 and {(r.query_id, r.key, r.score) for r in retrieval.bm25(questions, docs, "key", F.col("text"), group=F.col("own")).collect()} == want


def test_the_same_words_are_searched_once(spark):
    rows = [(f"d__sec_{k}", "d", str(k), "Payment", f"Clause {k}: the fee number {k} is due.", None, [], [], []) for k in range(1, 10)]
    chunks = spark.createDataFrame(rows, CLAUSES)
    words = retrieval.tokenized(chunks, "chunk_id", T.indexed_text(), F.col("doc_id"))
    vectors = agent.index.embed(chunks, "chunk_id", "text").withColumn("own", F.lit("d"))
    active = spark.createDataFrame([(f"q{i}", p, w, d) for i in range(4) for p, w, d in ((0, "fee number", None), (1, "fee number", "d"), (2, None, None))], "query_id string, pos int, sub_query string, doc_id string")
    searched, block = [], retrieval.dense_texts
    try:
        retrieval.dense_texts = lambda q, *more: searched.append(q.count()) or block(q, *more)
        got = agent.search(active, chunks, vectors, words).collect()
    finally:
        retrieval.dense_texts = block
    assert searched == [3] and {(r.query_id, r.pos) for r in got} == {(f"q{i}", p) for i in range(4) for p in range(3)}
    lists = {}
    for r in got:
        lists.setdefault((r.query_id, r.pos), set()).add((r.final, r.chunk_id))
    assert all(lists[f"q{i}", p] == lists["q0", 0] and len(lists["q0", 0]) == retrieval.TOP_K for i in range(4) for p in (0, 1))


def test_outcomes_store_no_list_of_agreements(spark):
    """Nor what is not asked for: the list of all agreements is the answer to every question that needs none."""
    chunks, entries = clauses(spark)
    many = entries.unionByName(spark.range(3000).select(F.format_string("e%06d", "id").alias("doc_id"), F.format_string("Makers %d", "id").alias("company"), F.lit("Agreement").alias("kind"), F.lit("t").alias("title")))
    q = spark.createDataFrame([("q1", "hello"), ("q2", "fee number 3")], "query_id string, raw_query string")
    kept, stage = [], agent.staged
    try:
        agent.staged = lambda df, label: kept.append((label, out := stage(df, label))) or out
        got = agent.answer(q, chunks, many)
        assert got.log.count() and not {"agent_answers", "agent_checks"} & {x for x, _ in kept}
        assert {(r.query_id, r.confidence) for r in got.questions.collect()} == {("q1", "high"), ("q2", "medium")}
    finally:
        agent.staged = stage
    assert max(r.n or 0 for label, df in kept if label == "agent_answers" for r in df.select(F.length("answer").alias("n")).collect()) < 5000
    answers = {r.query_id: r.answer for r in got.answers.collect()}
    assert answers["q1"].count("\n- e00") == 3000 and "[d §3]" in answers["q2"]
