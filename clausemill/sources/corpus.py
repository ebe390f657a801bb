"""Corpus files: archives, text folders, manifests, chunk lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from clausemill.functions import text as T

#: Fixed value: the folder of an archive that holds the contract texts.
MEMBERS = "full_contract_txt/"
_STRINGS = K.ArrayType(K.StringType())
CHUNK = K.StructType(
    [
        K.StructField(name, kind)
        for name, kind in (
            ("chunk_id", K.StringType()), ("doc_id", K.StringType()), ("section_id", K.StringType()), ("parent_section_id", K.StringType()),
            ("section_title", K.StringType()), ("text", K.StringType()), ("cross_references", _STRINGS), ("cross_reference_ids", _STRINGS),
            ("defines_terms", _STRINGS), ("defined_terms_used", _STRINGS), ("definition_ids", _STRINGS), ("kind", K.StringType()),
            ("level", K.IntegerType()), ("path", K.StringType()), ("part", K.IntegerType()), ("num_parts", K.IntegerType()),
        )
    ]
)
MANIFEST = "doc_id string, source_file string, title string, chars long, density_score long, refs long, definitions long, headings long"


def archive(spark: SparkSession, path: str, folder: str = MEMBERS) -> DataFrame:
    """(doc_id, text) of the .txt members of zip archives; undecodable bytes are dropped. One archive is read by one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if folder in n and n.lower().endswith(".txt")]
                    rows += [(n.rsplit("/", 1)[-1][:-4], z.read(n).decode("utf-8", "ignore")) for n in names]
            yield pd.DataFrame(rows, columns=["doc_id", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "doc_id string, text string")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of the .txt files of a folder, the file's stem being the id; undecodable bytes are dropped."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": [bytes(c).decode("utf-8", "ignore") for c in part["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\.txt$", 1).alias("doc_id"), "content").mapInPandas(run, "doc_id string, text string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, a JSON array; empty if there is none, and without rows that lack a doc_id."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(path, multiLine=True).where("doc_id is not null")


def manifest_of(filings: DataFrame) -> DataFrame:
    """Manifest rows of filings (doc_id, source_file, title, text): their lengths, and what counts towards their density."""
    counted = T.density()
    score = counted.pop("score").cast("long").alias("density_score")
    return filings.select("doc_id", "source_file", "title", F.char_length("text").cast("long").alias("chars"), score, *[c.cast("long").alias(n) for n, c in counted.items()])


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest as one JSON array; one row per agreement, a few hundred bytes each, so it is put together on the driver row by row."""
    spark = manifest.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    opened = "["
    for row in manifest.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        out.write(bytearray((opened + row["j"]).encode()))
        opened = ",\n"
    out.write(bytearray((opened if opened == "[" else "").encode() + b"]\n"))
    out.close()


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object a line, characters as they are."""
    chunks.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines with the fixed schema; empty lines are skipped."""
    return spark.read.schema(CHUNK).json(path).where("chunk_id is not null")


def save_collection(df: DataFrame, name: str, buckets: int = 0, key: str = "doc_id") -> None:
    """A managed table, bucketed by `key` if asked, so that later joins on it need no shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.bucketBy(buckets, key).sortBy(key) if buckets else writer).saveAsTable(name)
