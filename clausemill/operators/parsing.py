"""Structure operators over whole texts: one Arrow pass each, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions import structure as S
from clausemill.functions import text as T
from clausemill.operators import graph
from clausemill.sources.tables import staged

_ARROW = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def _per_text(df: DataFrame, key: str, text: str, schema: str, rows_of: Callable[[str], list[tuple]]) -> DataFrame:
    """One pass: `rows_of` gives the rows of each text, which follow its key. Null texts give none; the key keeps its type."""
    kind = dict(df.dtypes)[key]
    schema = f"{key} {kind}, {schema}"
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rows_of(t)]
            cols = list(zip(*rows)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(cols, fields)], names=[n for n, _ in fields])

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)


def outlines(documents: DataFrame) -> DataFrame:
    """One row per node of each document's tree, with the texts of the chunks that it makes, each document read once."""

    def rows(text: str) -> list[tuple]:
        t = S.parse(text)
        names = t.section_id
        return [
            (k, names[k], t.kind[k], t.level[k], t.title[k], t.parent_id(k), [names[c] for c in t.children[k]], t.body[k], t.line_start[k], path, texts)
            for k, (path, texts) in enumerate(zip(t.paths(), S.chunk_texts(t)))
        ]

    return _per_text(documents, "doc_id", "text", "place int, section_id string, kind string, level int, title string, parent_id string, children array<string>, body array<string>, line_start int, path string, texts array<string>", rows)


def parse_sections(documents: DataFrame) -> DataFrame:
    """(doc_id, section_id, kind, level, title, parent_id, children, body, line_start) of each document's tree."""
    return outlines(documents).drop("place", "path", "texts")


def _chunks_of(nodes: DataFrame) -> DataFrame:
    parts = nodes.select("*", F.size("texts").alias("num_parts"), F.posexplode("texts").alias("at", "text")).withColumn("part", F.col("at") + 1)
    name = F.when(F.col("num_parts") > 1, F.concat("section_id", F.lit("__p"), F.col("part").cast("string"))).otherwise(F.col("section_id"))
    return parts.select("doc_id", "place", name.alias("section_id"), F.col("parent_id").alias("parent_section_id"), F.col("title").alias("section_title"), "text", "kind", "level", "path", "part", "num_parts")


def split_chunks(documents: DataFrame) -> DataFrame:
    """(doc_id, section_id, parent_section_id, section_title, text, kind, level, path, part, num_parts): the chunks of each document, without edges."""
    return _chunks_of(outlines(documents)).drop("place")


def build_chunks(documents: DataFrame) -> DataFrame:
    """Texts to chunks with their edges: references resolved to chunk ids, terms defined and used, and the chunks that define them.

    documents has doc_id and text; a doc_id given again counts once, with its smaller text. Texts are read once, in one pass; definitions,
    term uses and references are joined by agreement. A term is defined by the first chunk of the document that does so; a term of
    up to three characters is none that can be used; lists are in order of the text (terms used: of the term) and name
    each target once; what names no chunk is left out. Null and empty texts give no chunks.
    """
    one = documents.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.min("text").alias("text"))
    nodes = staged(outlines(one), "outlines")
    chunks = _chunks_of(nodes).withColumn("chunk_id", T.chunk_id(F.col("doc_id"), F.col("section_id")))
    chunks = staged(chunks.withColumn("defines_terms", T.defined_terms(F.col("text"))), "chunks")
    base = F.regexp_replace("section_id", r"__p\d+$", "")
    found = extract_references(chunks).join(chunks.select("chunk_id", "doc_id", base.alias("own")), "chunk_id")
    asked = found.select("doc_id", F.col("chunk_id").alias("src"), "own", "target", F.lower("target").alias("label"), "pos")
    edges = graph.resolve_labels(asked.select("doc_id", "src", F.lower("own").alias("own"), "label").distinct(), chunks, nodes)
    placed = asked.withColumn("own", F.lower("own")).join(edges.withColumnRenamed("target", "label"), ["doc_id", "src", "label"])
    once = placed.groupBy("src", "dst").agg(F.min(F.struct("pos", "n", "target")).alias("at"))
    refs = once.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("at.pos", "at.n", "at.target", "dst"))).alias("r"))
    refs = refs.select(F.col("src").alias("chunk_id"), F.array_distinct(F.transform("r", lambda x: x["target"])).alias("cross_references"), F.transform("r", lambda x: x["dst"]).alias("cross_reference_ids"))
    definers = chunks.select("doc_id", "chunk_id", "place", "part", F.explode("defines_terms").alias("term")).groupBy("doc_id", "term").agg(F.min_by("chunk_id", F.struct("place", "part")).alias("dst"))
    used = term_uses(chunks).join(definers, ["doc_id", "term"])
    other = F.filter(F.transform("u", lambda x: F.struct(x["term"].alias("term"), F.when(x["dst"] != F.col("chunk_id"), x["dst"]).alias("dst"))), lambda x: x["dst"].isNotNull())
    terms = used.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", "dst"))).alias("u"))
    terms = terms.select("chunk_id", F.transform("u", lambda x: x["term"]).alias("defined_terms_used"), F.transform(other, lambda x: x["dst"]).alias("definition_ids"))
    none = F.array().cast("array<string>")
    whole = chunks.join(refs, "chunk_id", "left").join(terms, "chunk_id", "left")
    lists = {c: F.coalesce(c, none) for c in ("cross_references", "cross_reference_ids", "defines_terms", "defined_terms_used", "definition_ids")}
    return whole.select("chunk_id", "doc_id", "section_id", "parent_section_id", "section_title", "text", *[x.alias(c) for c, x in lists.items()], "kind", "level", "path", "part", "num_parts")


def contents_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, first_line, last_line) of the documents that have a table of contents."""

    def rows(text: str) -> list[tuple]:
        span = S.contents_span(S.normal_lines(text))
        return [span] if span else []

    return _per_text(documents, "doc_id", "text", "first_line int, last_line int", rows)


def extract_references(chunks: DataFrame) -> DataFrame:
    """(chunk_id, pos, raw, target, relation, kind): every reference of each text, once a target and relation, in order."""
    return _per_text(chunks, "chunk_id", "text", "pos int, raw string, target string, relation string, kind string", lambda text: [(k, *r) for k, r in enumerate(S.references(text))])


def term_uses(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, term): uses of the terms that the agreement defines, longest first, without a chunk's own definitions.

    The terms of an agreement go to its chunks as one list (a few hundred short strings); each distinct list is compiled once a worker.
    """
    defined = chunks.select("doc_id", F.explode(T.defined_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    held = chunks.where("text is not null").join(defined, "doc_id").select("chunk_id", "doc_id", "text", "terms", T.defined_terms(F.col("text")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[tuple[str, ...], object] = {}
        for batch in batches:
            out = []
            for chunk, doc, text, terms, own in zip(*(batch.column(i).to_pylist() for i in range(5))):
                key = tuple(terms)
                if key not in compiled:
                    if len(compiled) > 200:
                        compiled.clear()
                    compiled[key] = S.terms_pattern(terms)
                if compiled[key] is not None:
                    used = {" ".join(m.split()) for m in compiled[key].findall(text)}
                    out += [(chunk, doc, t) for t in sorted(used - set(own))]
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["chunk_id", "doc_id", "term"])

    return held.mapInArrow(run, "chunk_id string, doc_id string, term string")
