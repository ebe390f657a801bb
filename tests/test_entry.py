"""The driver's contract, the files, and the service functions over the smallest test data."""

from __future__ import annotations

import os
import re
import zipfile

import pytest

import __spark_entry__ as entry
from clausemill import api
from clausemill.sources import corpus

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p1_found", "p1_report", "q04_bm25_topk"} <= set(queries)


def test_the_core_does_not_import_the_training_part():
    root = os.path.join(os.path.dirname(entry.__file__), "clausemill")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert not re.search(r"clausemill\.llm|import llm", open(os.path.join(folder, name), encoding="utf-8").read())


@here
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "score", "rank"] and df.count() > 0


@here
@pytest.mark.parametrize("name", ["p1_found", "q08_rrf_fuse", "q20_resolve_edges", "q25_normalize_lines", "q29_definitions_absent", "q37_document_sections", "q43_rate_window"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"create view {file[:-8]} as select * from '{SMALL}/{file}'")
    df = entry.queries()[name](spark, SMALL)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))


@here
def test_service(spark):
    service = api.Service(spark, SMALL)
    documents = service.documents().collect()
    assert documents and service.health()["chunks"] > 0
    assert service.document(documents[0].doc_id).count() == documents[0].num_chunks
    with pytest.raises(api.NotFound):
        service.document("nobody")
    assert service.trace("nobody") is None
    with pytest.raises(ValueError):
        service.query(spark.createDataFrame([("q", "")], "query_id string, raw_query string"))
    events = [e["event"] for e in service.stream(spark.createDataFrame([("q", "What does Section 1.1 say?")], "query_id string, raw_query string"))]
    assert events[0] == "start" and events[-1] == "done" and "node" in events


def test_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.txt").write_bytes("1.1 Scope. A text long enough to be kept as a chunk of its own.".encode() + b"\xff")
    (tmp_path / "raw" / "skip.md").write_text("x")
    assert [(r.doc_id, r.text[-4:]) for r in corpus.texts(spark, str(tmp_path / "raw")).collect()] == [("one", "own.")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/full_contract_txt/b.txt", "body")
        z.writestr("x/other/c.txt", "no")
    assert [tuple(r) for r in corpus.archive(spark, str(tmp_path / "a.zip")).collect()] == [("b", "body")]
    (tmp_path / "manifest.json").write_text('[{"doc_id": "d", "source_file": "f"}, {"source_file": "g"}]')
    assert corpus.read_manifest(spark, str(tmp_path / "manifest.json")).count() == 1 and corpus.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    report = api.build_chunks(spark, str(tmp_path / "raw"), str(tmp_path / "chunks")).first()
    assert (report.documents, report.chunks, report.reference_edges, report.dangling) == (1, 1, 0, 0)
    assert [r.chunk_id for r in corpus.read_chunks(spark, str(tmp_path / "chunks")).collect()] == ["one__sec_1.1"]
    assert corpus.read_chunks(spark, str(tmp_path / "chunks")).first().section_title == "Scope"
