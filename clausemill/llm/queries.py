"""The training-text queries (problems 2 to 9) over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm import bpe, fusion, language, lookalikes, neardup, packing, scanned, splitting
from clausemill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p2_found": lambda s, d: scanned.found(table(s, d, "chunks"), table(s, d, "sections")),
        "p2_repaired": lambda s, d: scanned.repaired_texts(table(s, d, "chunks"), table(s, d, "sections")),
        "p3_found": lambda s, d: neardup.pairs(table(s, d, "chunks")),
        "p3_groups": lambda s, d: neardup.groups(table(s, d, "chunks")),
        "p3_copies": lambda s, d: neardup.copies_of(table(s, d, "chunks")),
        "p4_found": lambda s, d: lookalikes.found(table(s, d, "chunks")),
        "p4_rewrites": lambda s, d: lookalikes.rewrites(table(s, d, "chunks")),
        "p4_unified": lambda s, d: lookalikes.unified(table(s, d, "chunks")),
        "p5_found": lambda s, d: splitting.split_oversized(table(s, d, "chunks")).where("num_parts > 1").select("chunk_id").distinct(),
        "p5_parts": lambda s, d: splitting.split_oversized(table(s, d, "chunks")),
        "p5_rejoined": lambda s, d: splitting.rejoined(splitting.split_oversized(table(s, d, "chunks"))),
        "p6_found": lambda s, d: fusion.winners(table(s, d, "retrieved")),
        "p6_ranking": lambda s, d: fusion.fuse(table(s, d, "retrieved")),
        "p7_ids": lambda s, d: bpe.encode(table(s, d, "documents")),
        "p8_pack": lambda s, d: packing.pack(table(s, d, "documents")),
        "p8_mixture": lambda s, d: packing.mixture(packing.pack(table(s, d, "documents"))),
        "p9_found": lambda s, d: language.wrong_labels(table(s, d, "documents"), table(s, d, "languages")),
        "p9_segments": lambda s, d: language.segments(table(s, d, "documents"), table(s, d, "languages")),
    }


def _ranked() -> str:
    one = """
    SELECT query_id, chunk_id, '{c}' AS score, rank() OVER (PARTITION BY query_id ORDER BY {c} {way}) AS r
    FROM items WHERE {c} IS NOT NULL"""
    parts = " UNION ALL ".join(one.format(c=c, way="ASC" if low else "DESC") for c, low in fusion.SCORES.items())
    best = ", ".join(f"{'min' if low else 'max'}({c}) AS {c}" for c, low in fusion.SCORES.items())
    shown = ", ".join(f"max(CASE WHEN score = '{c}' THEN r END) AS r_{c}" for c in fusion.SCORES)
    total = " + ".join(f"coalesce(1.0::DOUBLE / ({fusion.K} + r_{c}), 0.0::DOUBLE)" for c in fusion.SCORES)
    return f"""
WITH items AS (SELECT query_id, chunk_id, {best} FROM retrieved WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
ranks AS ({parts}),
wide AS (SELECT i.query_id, i.chunk_id, {shown} FROM items i LEFT JOIN ranks USING (query_id, chunk_id) GROUP BY ALL),
scored AS (SELECT *, round({total}, 12) AS rrf FROM wide),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS place FROM scored)"""


#: Letters that Cyrillic and Greek share with Latin by their shape, as one reads them; written for the SQL alone.
_SHAPES = "АаВЕеЅѕІіЈјКМНОоРрСсТуУХхԁԛԝһӀԌԚԜΑΒΕΖΗΙΚΜΝΟοΡΤΥΧϲɡɑı"


def _alike() -> str:
    """Detection of problem 4 in words of SQL: Unicode classes and composition as the database knows them, no collation, classes or members."""
    odd = r"\p{Cf}\p{Zl}\p{Zp}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180D}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{FF00}-\x{FFEF}\x{FB00}-\x{FB06}\x{1D400}-\x{1D7FF}\x{2150}-\x{217F}\x{2460}-\x{24FF}\x{2070}-\x{209C}"
    run = rf"(^|[^\p{{L}}\p{{M}}])[\p{{Latin}}{_SHAPES}]*[{_SHAPES}][\p{{Latin}}{_SHAPES}]*($|[^\p{{L}}\p{{M}}])"
    return f"""
WITH f AS (SELECT chunk_id, 'text' AS text_field, text AS value FROM chunks
  UNION ALL SELECT chunk_id, 'defines_terms', unnest(defines_terms) FROM chunks)
SELECT DISTINCT chunk_id, text_field FROM f WHERE chunk_id IS NOT NULL AND value IS NOT NULL
  AND (regexp_matches(value, '[{odd}]') OR regexp_matches(replace(value, ' ', ''), '\\p{{Zs}}') OR nfc_normalize(value) <> value OR regexp_matches(value, '{run}'))"""


def oracle_sql() -> dict[str, str]:
    first = " AND ".join(f"r_{c} = 1" for c in fusion.SCORES)
    alone = " AND ".join(f"count(*) FILTER (r_{c} = 1) = 1" for c in fusion.SCORES)
    return {
        "p4_found": _alike(),
        "p5_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND length(text) > {splitting.LIMIT}",
        "p5_rejoined": f"SELECT chunk_id, md5(min(text)) AS text_md5, TRUE AS sound FROM chunks WHERE chunk_id IS NOT NULL AND length(text) > {splitting.LIMIT} GROUP BY 1",
        "p6_ranking": _ranked() + f" SELECT query_id, chunk_id, {', '.join('r_' + c for c in fusion.SCORES)}, rrf, place FROM fused",
        "p6_found": _ranked() + f" SELECT query_id, chunk_id FROM fused WHERE {first} AND query_id IN (SELECT query_id FROM fused GROUP BY query_id HAVING {alone})",
    }
