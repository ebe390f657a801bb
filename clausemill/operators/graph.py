"""The clause graph: reference and definition edges as rows, their resolution and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators.orphans import label_key
from clausemill.operators.ranking import top_k
from clausemill.sources.tables import staged

#: A container stands for at most so many of the chunks below it.
FAN_OUT = 8


def current(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk_id, the first delivery, with `columns` (all if none is named); the deliveries of a chunk have the same content.

    Name the columns that are needed: the rows are shuffled by chunk_id, and texts weigh most.
    """
    wanted = [c for c in columns or chunks.columns if c != "chunk_id"]
    first = F.min_by(F.struct(*wanted), F.struct("indexed_at", "section_id"))
    return chunks.where("chunk_id is not null").groupBy("chunk_id").agg(first.alias("c")).select("chunk_id", *[F.col(f"c.{c}").alias(c) for c in wanted])


def place_of(section: Column) -> Column:
    """What sorts section labels by their numbers, 2.1 before 10.1."""
    return F.transform(F.regexp_extract_all(section, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("long"))


def reference_edges(chunks: DataFrame) -> DataFrame:
    """(doc_id, src, dst): resolved reference edges, one row each; null and blank ids are none."""
    return chunks.select("doc_id", F.col("chunk_id").alias("src"), F.explode("cross_reference_ids").alias("dst")).where(F.trim("dst") != "").distinct()


def definition_edges(chunks: DataFrame) -> DataFrame:
    """(doc_id, src, term, dst): a use of a term and the first chunk of the agreement, by its numbers, that defines it, its own definitions left out."""
    defined = chunks.select("doc_id", "chunk_id", "section_id", "part", F.explode("defines_terms").alias("term")).where(F.trim("term") != "")
    first = defined.groupBy("doc_id", "term").agg(F.min_by("chunk_id", F.struct(place_of(F.col("section_id")), "part", "chunk_id")).alias("dst"))
    used = chunks.select("doc_id", F.col("chunk_id").alias("src"), "defines_terms", F.explode("defined_terms_used").alias("term"))
    own = F.coalesce(F.array_contains("defines_terms", F.col("term")), F.lit(False))
    return used.where(~own & (F.trim("term") != "")).select("doc_id", "src", "term").distinct().join(first, ["doc_id", "term"]).where("src <> dst").select("doc_id", "src", "term", "dst")


def resolve(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(src, target, dst, how): every reference label resolved to a chunk; see `resolve_labels`."""
    asked = chunks.select("doc_id", F.col("chunk_id").alias("src"), _own().alias("own"), F.explode("cross_references").alias("label")).withColumn("label", label_key(F.col("label")))
    return resolve_labels(asked.where("label <> ''").distinct(), chunks, sections).select("src", "target", "dst", "how").distinct()


def _own() -> Column:
    return label_key(F.regexp_replace("section_id", r"__p\d+$", ""))


def resolve_labels(asked: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, src, target, dst, how, n): each asked label (doc_id, src, own, label) as a chunk: itself, else its nearest ancestor, else up
    to FAN_OUT chunks below it, level by level, n being their order.

    A label of a section that was split means its first part; references of a chunk to itself vanish; labels are
    compared without case, blanks at the ends and full stops at the end.
    """
    held = chunks.select("doc_id", _own().alias("label"), "chunk_id", "part").groupBy("doc_id", "label").agg(F.min_by("chunk_id", F.struct("part", "chunk_id")).alias("dst"))
    tried = asked.select("doc_id", "src", "own", F.col("label").alias("target"), F.posexplode(T.ancestors(F.col("label"))).alias("step", "label"))
    up = tried.join(held, ["doc_id", "label"]).groupBy("doc_id", "src", "own", "target").agg(F.min_by(F.struct("label", "dst", "step"), "step").alias("hit"))
    above = up.select("doc_id", "src", "own", "target", F.col("hit.label").alias("label"), F.col("hit.dst").alias("dst"), F.when(F.col("hit.step") == 0, "exact").otherwise("ancestor").alias("how"), F.lit(1).alias("n"))
    rest = asked.withColumnRenamed("label", "target").join(up.select("doc_id", "src", "target"), ["doc_id", "src", "target"], "left_anti")
    tree = sections.select("doc_id", label_key(F.col("section_id")).alias("target"), F.posexplode("children").alias("at", "child")).select("doc_id", "target", "at", label_key(F.col("child")).alias("label"))
    tree = tree.groupBy("doc_id", "target", "label").agg(F.min("at").alias("at"))
    # Breadth first: a child that is no chunk gives way to its own children, in order of depth and position.
    front = rest.select("doc_id", "target").distinct().select("doc_id", "target", F.col("target").alias("node"), F.array().cast("array<int>").alias("path"), F.array("target").alias("passed"))
    met = None
    while True:
        step = front.join(tree.select("doc_id", F.col("target").alias("node"), "at", "label"), ["doc_id", "node"]).where(~F.array_contains("passed", F.col("label")))
        step = step.join(held, ["doc_id", "label"], "left").select("doc_id", "target", "label", "dst", F.array_append("path", F.col("at")).alias("path"), F.array_append("passed", F.col("label")).alias("passed"))
        step = staged(step, "graph_below")
        met = step.where("dst is not null") if met is None else met.unionByName(step.where("dst is not null"))
        front = step.where("dst is null").select("doc_id", "target", F.col("label").alias("node"), "path", "passed")
        if front.isEmpty():
            break
    met = met.groupBy("doc_id", "target", "label", "dst").agg(F.min(F.struct(F.size("path").alias("depth"), "path")).alias("at"))
    below = rest.join(top_k(met, ["doc_id", "target"], [F.col("at"), F.col("label")], FAN_OUT, "n"), ["doc_id", "target"])
    down = below.select("doc_id", "src", "own", "target", "label", "dst", F.lit("below").alias("how"), "n")
    return above.unionByName(down).where("label <> own and dst <> src").select("doc_id", "src", "target", "dst", "how", "n").distinct()


def dangling(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges whose target is no chunk."""
    return edges.join(chunks.select(F.col("chunk_id").alias("dst")).distinct(), "dst", "left_anti")


def corpus_report(chunks: DataFrame) -> DataFrame:
    """One row: agreements, chunks, edges, chunks with edges, distinct terms, and upper median and 95th percentile of the text length."""
    refs, defs = F.size(F.coalesce("cross_reference_ids", F.array())), F.size(F.coalesce("definition_ids", F.array()))
    sums = chunks.agg(
        F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum(refs).alias("reference_edges"), F.sum(defs).alias("definition_edges"), F.count(F.when(refs > 0, 1)).alias("with_references")
    )
    terms = chunks.select("doc_id", F.explode("defines_terms").alias("term")).where("term is not null").agg(F.countDistinct("term").alias("terms"))
    # The element at n // 2 and at int(0.95 n) of the sorted lengths: counts of each length and a running sum, not one long list.
    sizes = chunks.where("text is not null").groupBy(F.char_length("text").alias("length")).agg(F.count("*").alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(W.orderBy("length"))).withColumn("all", F.sum("n").over(W.partitionBy()))
    marks = upto.agg(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("length"))).alias("median_length"), F.min(F.when(F.col("upto") > F.floor(F.col("all") * 0.95), F.col("length"))).alias("p95_length"))
    return sums.join(F.broadcast(terms)).join(F.broadcast(marks))


def fan_out(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k chunks with most outgoing edges."""
    return edges.groupBy("src").agg(F.count("*").alias("edges")).orderBy(F.desc("edges"), "src").limit(k)


def inspect(edges: DataFrame, chunks: DataFrame, n: int = 20, seed: int = 7) -> DataFrame:
    """A seeded sample of edges with the beginnings of both texts, for reading by a person. The sample is the feature."""
    some = edges.select("src", "dst").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(n)
    head = chunks.select("chunk_id", F.substring("text", 1, 260).alias("excerpt"))
    return some.join(head.toDF("src", "src_excerpt"), "src", "left").join(head.toDF("dst", "dst_excerpt"), "dst", "left")
