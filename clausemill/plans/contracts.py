"""Numbered agreements made from the documents table by arithmetic, so that every edge in them is known without reading them.

Each source is an agreement; its documents, in order, are its sections `a.b`, five an article. Section r refers to section (7 r mod n) + 1;
some also refer to that one's article, to a sub-clause of it, or to a range; every fifth defines a term, the others use one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators.ranking import numbered
from clausemill.sources.tables import table

#: Characters of a document that its section shows.
SHOWN = 200


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, r, n, a, b, c, d, sentence): one row per section, with what it says."""
    words = F.trim(F.regexp_replace(F.substring("text", 1, SHOWN), "[^a-z]+", " "))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("no"), words.alias("words")).where("doc_id is not null and words <> ''")
    placed = numbered(rows, ["doc_id"], [F.col("no")], "r").select("doc_id", "words", "r")
    sized = placed.join(placed.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    at = sized.withColumn("t", F.col("r") * 7 % F.col("n") + 1).withColumn("m", F.floor(F.col("n") / 5))
    for name, of in (("a", "r"), ("c", "t")):
        at = at.withColumn(name, F.floor((F.col(of) - 1) / 5) + 1)
    at = at.withColumn("b", (F.col("r") - 1) % 5 + 1).withColumn("d", (F.col("t") - 1) % 5 + 1)
    term = F.when(F.col("b") == 5, F.format_string(' "Term A%d" means the matter of this part.', "a")).when(F.col("m") > 0, F.format_string(" It uses Term A%d.", F.col("r") * 11 % F.when(F.col("m") > 0, F.col("m")) + 1)).otherwise("")
    said = F.concat(
        "words", F.format_string(" subject to Section %d.%d.", "c", "d"),
        F.when(F.col("r") % 3 == 0, F.format_string(" It is made pursuant to Article %d.", "c")).otherwise(""),
        F.when(F.col("r") % 4 == 0, F.format_string(" See Section %d.%d(a)(ii).", "c", "d")).otherwise(""),
        F.when(F.col("b") == 2, F.format_string(" It binds under Sections %d.1 through %d.3.", "a", "a")).otherwise(""), term,
    )
    return at.select("doc_id", "r", "n", "a", "b", "c", "d", said.alias("sentence"))


def texts(spark: SparkSession, sf_dir: str, contents: bool = False) -> DataFrame:
    """(doc_id, text): the agreements as texts, with a table of contents before them if asked."""
    rows = sections(spark, sf_dir)
    head = F.when(F.col("b") == 1, F.format_string("ARTICLE %d Part\n\n", "a")).otherwise("")
    body = F.concat(head, F.format_string("%d.%d Matter. ", "a", "b"), "sentence", F.lit("\n\n"))
    entry = F.format_string("%d.%d Matter %d\n", "a", "b", F.col("r") % 900 + 1)
    parts = F.array_sort(F.collect_list(F.struct("r", body.alias("body"), entry.alias("entry"))))
    whole = F.array_join(F.transform("p", lambda x: x["body"]), "")
    listed = F.concat(F.lit("General terms.\nTABLE OF CONTENTS\n\n"), F.array_join(F.transform("p", lambda x: x["entry"]), ""), F.lit("\n"))
    return rows.groupBy("doc_id").agg(parts.alias("p")).select("doc_id", (F.concat(listed, whole) if contents else whole).alias("text"))
