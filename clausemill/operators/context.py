"""What a question has gathered so far: merging, ordering, what is missing from it, and checks of citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators.ranking import top_k

#: Sizes of prompts and of lists of candidates, and the sources that were fetched on purpose.
CONTEXT, CANDIDATES, EVIDENCE = 12, 40, 3
DELIBERATE = ("graph_traversal", "direct_lookup")


def merge(rows: DataFrame) -> DataFrame:
    """(query_id, seq, chunk_id, source, ...): the first row of each question and chunk by seq; later finds do not overwrite it."""
    return top_k(rows, ["query_id", "chunk_id"], [F.col("seq"), F.col("source")], 1, "_n").drop("_n")


def prioritized(context: DataFrame, limit: int = CONTEXT) -> DataFrame:
    """The rows to show, deliberate fetches first, each part in its order; place from 1."""
    return top_k(context, ["query_id"], [F.col("source").isin(*DELIBERATE).desc(), F.col("seq"), F.col("chunk_id")], limit, "place")


def referenced_absent(context: DataFrame, chunks: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(query_id, label, chunk_id, place): chunks that the context refers to and does not hold, in order of context and edge."""
    edges = chunks.select(F.col("chunk_id").alias("src"), F.posexplode("cross_reference_ids").alias("pos", "dst")).where("dst is not null")
    seen = context.select("query_id", "seq", F.col("chunk_id").alias("src")).join(edges, "src")
    first = seen.groupBy("query_id", "dst").agg(F.min(F.struct("seq", "pos")).alias("at"))
    absent = first.join(context.select("query_id", F.col("chunk_id").alias("dst")), ["query_id", "dst"], "left_anti")
    kept = top_k(absent, ["query_id"], [F.col("at.seq"), F.col("at.pos"), F.col("dst")], limit, "place")
    return kept.select("query_id", T.label(F.col("dst")).alias("label"), F.col("dst").alias("chunk_id"), "place")


def definitions_absent(context: DataFrame, chunks: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(query_id, label, chunk_id, place): defining chunks that the context lacks, one a document and term; a chunk whose two
    lists differ in length is not used."""
    pairs = chunks.where(F.size("defined_terms_used") == F.size("definition_ids")).select(F.col("chunk_id").alias("src"), F.posexplode(F.arrays_zip("defined_terms_used", "definition_ids")).alias("pos", "p"))
    pairs = pairs.select("src", "pos", F.col("p.defined_terms_used").alias("term"), F.col("p.definition_ids").alias("dst")).where("term is not null and dst is not null")
    seen = context.select("query_id", "seq", F.col("chunk_id").alias("src")).join(pairs, "src")
    absent = seen.join(context.select("query_id", F.col("chunk_id").alias("dst")), ["query_id", "dst"], "left_anti")
    labelled = absent.withColumn("label", F.concat(F.substring_index("dst", "__sec_", 1), F.lit(' "'), "term", F.lit('"')))
    first = labelled.groupBy("query_id", "label").agg(F.min(F.struct("seq", "pos", "dst")).alias("at"))
    return top_k(first, ["query_id"], [F.col("at.seq"), F.col("at.pos"), F.col("label")], limit, "place").select("query_id", "label", F.col("at.dst").alias("chunk_id"), "place")


def wanted(chosen: DataFrame, offered: DataFrame) -> DataFrame:
    """(query_id, chunk_id): chosen labels among those offered (kind, place order), as chunk ids, each once. Labels not offered are dropped."""
    met = chosen.join(offered, ["query_id", "label"])
    return met.groupBy("query_id", "chunk_id").agg(F.min(F.struct("kind", "place")).alias("at")).select("query_id", "chunk_id", F.col("at.kind").alias("kind"), F.col("at.place").alias("place"))


def verify_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, doc_id, section_id, place, verified): each citation of an answer once, and whether the context holds its clause."""
    cited = answers.select("query_id", F.posexplode(T.citations(F.col("answer"))).alias("pos", "c")).select("query_id", "c.doc_id", "c.section_id", (F.col("pos") + 1).alias("place"))
    held = context.select("query_id", "doc_id", "section_id").distinct().withColumn("held", F.lit(True))
    return cited.join(held, ["query_id", "doc_id", "section_id"], "left").select("query_id", "doc_id", "section_id", "place", F.coalesce("held", F.lit(False)).alias("verified"))


def claim_evidence(answers: DataFrame, context: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """(query_id, claim_no, claim, chunk_id, place): for each sentence that cites, the clauses of the context it cites, at most `most`, in the order written."""
    claims = answers.select("query_id", F.posexplode(T.sentences(F.col("answer"))).alias("claim_no", "claim"))
    cited = claims.select("query_id", "claim_no", "claim", F.posexplode(T.citations(F.col("claim"))).alias("pos", "c"))
    held = context.select("query_id", "doc_id", "section_id", "chunk_id").distinct()
    met = cited.select("query_id", "claim_no", "claim", "pos", "c.doc_id", "c.section_id").join(held, ["query_id", "doc_id", "section_id"])
    return top_k(met, ["query_id", "claim_no"], [F.col("pos"), F.col("chunk_id")], most, "place").select("query_id", "claim_no", F.trim("claim").alias("claim"), "chunk_id", "place")


def fetch(wanted_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks by id in the order asked for, with score 1; ids that are not there are left out."""
    return wanted_ids.join(chunks.select("chunk_id", "doc_id", "section_id", "text"), "chunk_id").withColumn("score", F.lit(1.0))


def prompt(context: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, prompt): the clauses as a prompt shows them, each under its citation tag, title and path."""
    shown = context.select("query_id", "place", "chunk_id").join(chunks.select("chunk_id", "doc_id", "section_id", "section_title", "path", "text"), "chunk_id")
    title = F.coalesce(F.nullif("section_title", F.lit("")), F.lit("(untitled)"))
    head = F.concat(T.citation(F.col("doc_id"), F.col("section_id")), F.lit(" "), title)
    path = F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit("\n("), "path", F.lit(")"))).otherwise("")
    block = F.concat(head, path, F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("b"))
    return rows.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("prompt"))
