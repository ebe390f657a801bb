"""The same queries in plain SQL, for comparison on the same tables."""

from __future__ import annotations

from clausemill.functions import structure as S
from clausemill.functions import text as T
from clausemill.operators import context, graph, index, retrieval, traces

_ORPHANS = r"""
WITH times AS (SELECT chunk_id, min(indexed_at) AS first_at, max(indexed_at) AS last_at FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
gone AS (SELECT chunk_id, max(deleted_at) AS deleted_at FROM chunk_deletions GROUP BY 1),
secs AS (SELECT doc_id, regexp_replace(lower(section_id), '^\s+|[\s.]+$', '', 'g') AS label, min(parsed_at) AS first_at FROM sections GROUP BY 1, 2),
refs AS (
  SELECT DISTINCT chunk_id, doc_id, ref_field, target FROM (
    SELECT chunk_id, doc_id, 'cross_references' AS ref_field, unnest(cross_references) AS target FROM chunks
    UNION ALL SELECT chunk_id, doc_id, 'cross_reference_ids', unnest(cross_reference_ids) FROM chunks
    UNION ALL SELECT chunk_id, doc_id, 'definition_ids', unnest(definition_ids) FROM chunks)
  WHERE chunk_id IS NOT NULL AND target IS NOT NULL AND regexp_replace(target, '\s', '', 'g') <> ''),
judged AS (
  SELECT r.chunk_id, r.ref_field, r.target, me.first_at,
    CASE WHEN r.ref_field = 'cross_references' THEN CASE WHEN s.label IS NULL THEN 'missing' WHEN s.first_at > me.first_at THEN 'late' END
      WHEN g.chunk_id IS NOT NULL AND NOT coalesce(t.last_at > g.deleted_at, FALSE) THEN 'deleted'
      WHEN t.chunk_id IS NULL THEN 'missing' WHEN t.first_at > me.first_at THEN 'late' END AS reason
  FROM refs r JOIN times me ON me.chunk_id = r.chunk_id
  LEFT JOIN secs s ON r.ref_field = 'cross_references' AND s.doc_id = r.doc_id AND s.label = regexp_replace(lower(r.target), '^\s+|[\s.]+$', '', 'g')
  LEFT JOIN times t ON r.ref_field <> 'cross_references' AND t.chunk_id = r.target
  LEFT JOIN gone g ON r.ref_field <> 'cross_references' AND g.chunk_id = r.target)
"""



_CURRENT = "SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at, section_id) = 1"
#: The agreements of `contracts` by arithmetic alone: what each section says, and which edges follow from it. No text is read.
_VIEW = """
secs AS (SELECT doc_id, words, r, n, t, m, (r - 1) // 5 + 1 AS a, (r - 1) % 5 + 1 AS b, (t - 1) // 5 + 1 AS c, (t - 1) % 5 + 1 AS d, r * 11 % nullif(m, 0) + 1 AS k FROM (
  SELECT *, r * 7 % n + 1 AS t, n // 5 AS m FROM (SELECT source AS doc_id, words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT source, doc_id, trim(regexp_replace(substr(text, 1, 200), '[^a-z]+', ' ', 'g')) AS words FROM documents) WHERE source IS NOT NULL AND words <> ''))),
v AS (SELECT *, doc_id || '__sec_' || a || '.' || b AS id, c || '.' || d AS cd FROM secs),
named AS (SELECT id, doc_id, 1 AS o, cd AS raw, cd AS target, 'subject_to' AS relation, 'section' AS kind FROM v
  UNION ALL SELECT id, doc_id, 2, c::VARCHAR, 'ART-' || c, 'pursuant_to', 'article' FROM v WHERE r % 3 = 0
  UNION ALL SELECT id, doc_id, 3, cd || '(a)(ii)', cd || '(a)(ii)', 'see', 'section' FROM v WHERE r % 4 = 0
  UNION ALL SELECT id, doc_id, 4, CASE x WHEN 1 THEN a || '.1' ELSE a || '.3' END, a || '.' || x, 'under', 'section' FROM v, (SELECT unnest([1, 2, 3]) AS x) WHERE b = 2),
hits AS (SELECT id, doc_id || '__sec_' || cd AS dst FROM v
  UNION SELECT v.id, w.id FROM v JOIN v w ON w.doc_id = v.doc_id AND w.a = v.c WHERE v.r % 3 = 0
  UNION SELECT v.id, w.id FROM v JOIN v w ON w.doc_id = v.doc_id AND w.a = v.a AND w.b <= 3 WHERE v.b = 2),
edges AS (SELECT id AS src, dst FROM hits WHERE id <> dst),
used AS (SELECT id, 'Term A' || k AS term, doc_id || '__sec_' || k || '.5' AS dst FROM v WHERE b < 5 AND k IS NOT NULL)"""
_VIEW_TEXT = """words || ' subject to Section ' || cd || '.' || CASE WHEN r % 3 = 0 THEN ' It is made pursuant to Article ' || c || '.' ELSE '' END || CASE WHEN r % 4 = 0 THEN ' See Section ' || cd || '(a)(ii).' ELSE '' END
  || CASE WHEN b = 2 THEN ' It binds under Sections ' || a || '.1 through ' || a || '.3.' ELSE '' END || CASE WHEN b = 5 THEN ' "Term A' || a || '" means the matter of this part.' WHEN k IS NOT NULL THEN ' It uses Term A' || k || '.' ELSE '' END"""
_QUESTIONS = "SELECT query_id, min(raw_query) AS raw_query, min(doc_id) AS doc_id FROM traces WHERE query_id IS NOT NULL GROUP BY 1"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{T.TOKEN}'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


_INDEXED = "concat_ws(' ', nullif(section_id, ''), nullif(section_title, ''), nullif(text, ''))"
_BM25 = f"""
cur AS ({_CURRENT}), qs AS ({_QUESTIONS}),
toks AS (SELECT chunk_id, {_tokens(_INDEXED)} AS ts FROM cur),
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT chunk_id, len(ts) AS len, unnest(ts) AS term FROM toks) GROUP BY 1, 2),
size AS (SELECT count(*) AS n, avg(len(ts)) AS mean_length FROM toks),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw, n, mean_length FROM dfs, size),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN {retrieval.EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf, mean_length FROM raw)"""
_SCORED = _BM25 + f""",
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_tokens('raw_query')}) AS term FROM qs) GROUP BY 1, 2),
scored AS (SELECT query_id, p.chunk_id, round(sum(times * idf * tf * {retrieval.K1 + 1} / (tf + {retrieval.K1} * (1 - {retrieval.B} + {retrieval.B} * len / mean_length))), 9) AS score
  FROM asked JOIN post p USING (term) JOIN idfs USING (term) GROUP BY 1, 2)"""
_INSIDE = "(SELECT s.* FROM {rows} s JOIN qs USING (query_id) WHERE qs.doc_id IS NULL OR split_part(s.chunk_id, '__sec_', 1) = qs.doc_id)"


def _top(rows: str, k: int, name: str = "rank") -> str:
    return f"SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS {name} FROM {rows} QUALIFY {name} <= {k}"


_LISTS = """
lists AS (SELECT query_id, chunk_id, 'dense' AS retriever, min(dense_rank) AS rank FROM retrieved WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND dense_rank IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT query_id, chunk_id, 'sparse', min(sparse_rank) FROM retrieved WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND sparse_rank IS NOT NULL GROUP BY 1, 2)"""


def _fuse(lists: str, top: int | None = None) -> str:
    cut = f" QUALIFY place <= {top}" if top else ""
    return f"""SELECT query_id, chunk_id, score, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, chunk_id) AS place
  FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / ({retrieval.RRF_K} + rank)), 9) AS score, min(rank) AS best_rank FROM {lists} GROUP BY 1, 2){cut}"""


def _hybrid_lists(dense: bool = True, sparse: bool = True) -> str:
    parts = []
    if dense:
        parts.append(f"SELECT query_id, chunk_id, rank FROM lists WHERE retriever = 'dense' AND rank <= {retrieval.TOP_N}")
    if sparse:
        parts.append(f"SELECT query_id, chunk_id, rank FROM ({_top('scored', retrieval.TOP_N)})")
    return "(" + " UNION ALL ".join(parts) + ")"


def _ablation(mode: str, dense: bool, sparse: bool) -> str:
    return f"""SELECT '{mode}' AS mode, count(*) AS relevant, count(f.chunk_id) AS hits FROM good g
  LEFT JOIN (SELECT query_id, chunk_id FROM ({_fuse(_hybrid_lists(dense, sparse))}) WHERE place <= {retrieval.TOP_K}) f USING (query_id, chunk_id)"""


_EMBEDDED = "CASE WHEN concat_ws(' ', nullif(path, ''), nullif(section_title, '')) <> '' THEN concat_ws(' ', nullif(path, ''), nullif(section_title, '')) || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END"
_HASHED = f"""cur AS ({_CURRENT}),
now AS (SELECT chunk_id, substr(sha256('{index.MODEL}' || chr(0) || {_EMBEDDED}), 1, 32) AS content_hash, greatest(1, length({_EMBEDDED}) // 4 + 1) AS tokens FROM cur)"""
_CONTEXT = """ctx AS (SELECT query_id, seq, chunk_id, doc_id, section_id, source FROM (
  SELECT query_id, chunk_id, doc_id, section_id, source, least(coalesce(dense_rank, 100000), coalesce(sparse_rank, 100000)) AS seq FROM retrieved WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY seq, source) = 1)"""
_REFS_ABSENT = f"""refs_absent AS (
  SELECT query_id, CASE WHEN contains(dst, '__sec_') THEN split_part(dst, '__sec_', 1) || ' §' || substr(dst, instr(dst, '__sec_') + 6) ELSE dst END AS label, dst AS chunk_id,
    row_number() OVER (PARTITION BY query_id ORDER BY seq, pos, dst) AS place
  FROM (SELECT query_id, dst, min((seq, pos))[1] AS seq, min((seq, pos))[2] AS pos
    FROM ctx JOIN (SELECT chunk_id, unnest(cross_reference_ids) AS dst, unnest(range(len(cross_reference_ids))) AS pos FROM cur) e USING (chunk_id) WHERE dst IS NOT NULL GROUP BY 1, 2) f
  WHERE NOT EXISTS (SELECT 1 FROM ctx c WHERE c.query_id = f.query_id AND c.chunk_id = f.dst) QUALIFY place <= {context.CANDIDATES})"""
_DEFS_ABSENT = f"""defs_absent AS (
  SELECT query_id, label, dst AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY seq, pos, label) AS place
  FROM (SELECT query_id, split_part(dst, '__sec_', 1) || ' "' || term || '"' AS label, min((seq, pos, dst))[1] AS seq, min((seq, pos, dst))[2] AS pos, min((seq, pos, dst))[3] AS dst
    FROM ctx JOIN (SELECT chunk_id, unnest(defined_terms_used) AS term, unnest(definition_ids) AS dst, unnest(range(len(definition_ids))) AS pos FROM cur WHERE len(defined_terms_used) = len(definition_ids)) e USING (chunk_id)
    WHERE term IS NOT NULL AND dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ctx c WHERE c.query_id = ctx.query_id AND c.chunk_id = e.dst) GROUP BY 1, 2)
  QUALIFY place <= {context.CANDIDATES})"""
_WANTED = f"""offered AS (SELECT *, 1 AS kind FROM refs_absent UNION ALL SELECT *, 2 FROM defs_absent),
wanted AS (SELECT query_id, chunk_id, min((kind, place))[1] AS kind, min((kind, place))[2] AS place FROM offered
  WHERE (query_id, label) IN (SELECT query_id, label FROM offered WHERE place <= 5) GROUP BY 1, 2)"""
_CITED = """three AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq, chunk_id) AS place FROM ctx QUALIFY place <= 3)"""
_LATEST = "latest AS (SELECT * FROM traces WHERE query_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (status = 'running'), created_at DESC, iteration DESC, last_node) = 1)"
_RESOLVED = r"""
cur AS (""" + _CURRENT + r"""),
lab AS (SELECT *, regexp_replace(lower(regexp_replace(section_id, '__p\d+$', '')), '^\s+|[\s.]+$', '', 'g') AS own FROM cur),
held AS (SELECT doc_id, own AS label, min((part, chunk_id))[2] AS dst FROM lab GROUP BY 1, 2),
asked AS (SELECT DISTINCT doc_id, src, own, target FROM (SELECT doc_id, chunk_id AS src, own, regexp_replace(lower(unnest(cross_references)), '^\s+|[\s.]+$', '', 'g') AS target FROM lab) WHERE target <> ''),
steps AS (
  WITH RECURSIVE up(doc_id, src, own, target, label, step) AS (
    SELECT doc_id, src, own, target, target, 0 FROM asked
    UNION ALL SELECT doc_id, src, own, target, CASE WHEN regexp_matches(label, '\([A-Za-z0-9]{1,4}\)$') THEN regexp_replace(label, '\([A-Za-z0-9]{1,4}\)$', '') ELSE regexp_replace(label, '\.[^.]*$', '') END, step + 1
      FROM up WHERE regexp_matches(label, '\([A-Za-z0-9]{1,4}\)$') OR contains(label, '.')) SELECT * FROM up),
above AS (SELECT doc_id, src, own, target, label, dst, step FROM steps JOIN held USING (doc_id, label) QUALIFY row_number() OVER (PARTITION BY doc_id, src, target ORDER BY step) = 1),
tree AS (SELECT doc_id, target, label, min(ord) AS ord FROM (SELECT doc_id, regexp_replace(lower(section_id), '^\s+|[\s.]+$', '', 'g') AS target, regexp_replace(lower(unnest(children)), '^\s+|[\s.]+$', '', 'g') AS label, unnest(range(len(children))) AS ord FROM sections) GROUP BY 1, 2, 3),
rest AS (SELECT * FROM asked r WHERE NOT EXISTS (SELECT 1 FROM above a WHERE a.doc_id = r.doc_id AND a.src = r.src AND a.target = r.target)),
down AS (
  WITH RECURSIVE go(doc_id, target, label, dst, path, passed) AS (
    SELECT DISTINCT r.doc_id, r.target, t.label, h.dst, [t.ord], [r.target, t.label] FROM rest r JOIN tree t USING (doc_id, target) LEFT JOIN held h ON h.doc_id = r.doc_id AND h.label = t.label WHERE t.label <> r.target
    UNION ALL SELECT g.doc_id, g.target, t.label, h.dst, list_append(g.path, t.ord), list_append(g.passed, t.label) FROM go g JOIN tree t ON t.doc_id = g.doc_id AND t.target = g.label
      LEFT JOIN held h ON h.doc_id = g.doc_id AND h.label = t.label WHERE g.dst IS NULL AND NOT list_contains(g.passed, t.label)) SELECT * FROM go),
near AS (SELECT doc_id, target, label, dst, min((len(path), path)) AS spot FROM down WHERE dst IS NOT NULL GROUP BY ALL),
few AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY doc_id, target ORDER BY spot, label) <= """ + str(graph.FAN_OUT) + r"""),
below AS (SELECT r.doc_id, src, own, target, label, dst FROM rest r JOIN few USING (doc_id, target))
SELECT DISTINCT src, target, dst, how FROM (SELECT src, own, target, label, dst, CASE WHEN step = 0 THEN 'exact' ELSE 'ancestor' END AS how FROM above UNION ALL SELECT src, own, target, label, dst, 'below' FROM below) WHERE label <> own AND dst <> src"""


def _plain(pattern: str) -> str:
    return pattern.replace("'", "''")


def oracle_sql() -> dict[str, str]:
    judged = _ORPHANS + """SELECT ref_field, CASE WHEN ref_field = 'cross_references' THEN 'sections' ELSE 'chunks' END AS target_table,
  strftime(first_at, '%Y-%m') AS month, reason, count(*) AS orphans, count(DISTINCT chunk_id) AS referring_chunks
  FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4"""
    part = "(WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT q.vec_id AS query_vec, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 9) AS s FROM v q JOIN v ON q.vec_id % 100 = 0{same})"
    near = "SELECT query_vec, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_vec ORDER BY s DESC, vec_id) AS rank FROM " + part + " QUALIFY rank <= 10"
    term = f"SELECT chunk_id, unnest(list_concat(regexp_extract_all(text, '{_plain(T.MEANS)}', 1), regexp_extract_all(text, '{_plain(T.BRACKETED)}', 1))) AS raw FROM cur WHERE text IS NOT NULL"
    counted = ", ".join(f"len(regexp_extract_all(text, '{_plain(p)}')) AS {n}" for n, (p, _) in T.COUNTED.items())
    density = f"SELECT doc_id, chars, refs, definitions, headings, {' + '.join(f'{n} * {w}' for n, (_, w) in T.COUNTED.items())} AS score FROM (SELECT doc_id, length(text) AS chars, {counted} FROM documents WHERE text IS NOT NULL)"
    every = {
        "p1_found": _ORPHANS + "SELECT chunk_id, ref_field, target, reason FROM judged WHERE reason IS NOT NULL",
        "p1_report": judged,
        "q01_tokenize_counts": f"WITH {_BM25} SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS uses FROM post GROUP BY 1",
        "q02_bm25_corpus_stats": f"WITH {_BM25} SELECT n, round(mean_length, 6) AS mean_length, count(*) AS terms, round(avg(raw), 6) AS mean_idf FROM raw GROUP BY n, mean_length",
        "q03_bm25_idf_floor": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idfs",
        "q04_bm25_topk": f"WITH {_SCORED} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_top('scored', 10)})",
        "q05_bm25_docfilter_after": f"WITH {_SCORED}, best AS ({_top('scored', 40)}) SELECT query_id, chunk_id, rank FROM ({_top(_INSIDE.format(rows='(SELECT query_id, chunk_id, score FROM best)'), 40)})",
        "q05_bm25_docfilter_before": f"WITH {_SCORED} SELECT query_id, chunk_id, rank FROM ({_top(_INSIDE.format(rows='scored'), 10)})",
        "q06_dense_topk": near.format(same=""),
        "q07_dense_topk_filtered": near.format(same=" AND q.label IS NOT DISTINCT FROM v.label"),
        "q08_rrf_fuse": f"WITH {_LISTS} SELECT query_id, chunk_id, round(score, 6) AS score, best_rank, place FROM ({_fuse('lists')})",
        "q09_hybrid_noop_rerank": f"WITH {_SCORED}, {_LISTS} SELECT query_id, chunk_id, round(score, 6) AS fused_score, place FROM ({_fuse(_hybrid_lists())}) WHERE place <= {retrieval.TOP_K}",
        "q10_recall_ablation": f"WITH {_SCORED}, {_LISTS}, good AS (SELECT query_id, chunk_id FROM judgments GROUP BY 1, 2 HAVING max(grade) >= 2) " + " UNION ALL ".join(_ablation(*x) for x in (("dense", True, False), ("sparse", False, True), ("both", True, True))),
        "q11_embedding_text_hash": f"WITH {_HASHED} SELECT chunk_id, content_hash, tokens FROM now",
        "q12_index_plan": f"""WITH {_HASHED}, gone AS (SELECT chunk_id, max(deleted_at) AS deleted_at FROM chunk_deletions GROUP BY 1),
a AS (SELECT chunk_id, content_hash AS old FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at, section_id) = 1),
z AS (SELECT c.chunk_id, content_hash AS new FROM chunks c LEFT JOIN gone g ON g.chunk_id = c.chunk_id WHERE c.chunk_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY c.chunk_id ORDER BY indexed_at DESC, section_id DESC) = 1 AND (deleted_at IS NULL OR indexed_at > deleted_at)),
b AS (SELECT coalesce(a.chunk_id, z.chunk_id) AS chunk_id, CASE WHEN new IS NULL THEN 'delete' WHEN old = new THEN 'keep' ELSE 'embed' END AS action
  FROM (SELECT * FROM a WHERE old IS NOT NULL) a FULL JOIN (SELECT * FROM z WHERE new IS NOT NULL) z ON a.chunk_id = z.chunk_id)
SELECT b.chunk_id, action, CASE WHEN action = 'embed' THEN tokens ELSE 0 END AS tokens FROM b LEFT JOIN now ON now.chunk_id = b.chunk_id""",
        "q13_index_state": """WITH gone AS (SELECT chunk_id, max(deleted_at) AS deleted_at FROM chunk_deletions GROUP BY 1)
SELECT c.chunk_id, min(c.doc_id) AS doc_id, count(*) AS deliveries, min(indexed_at) AS first_at, max(indexed_at) AS last_at FROM chunks c LEFT JOIN gone g ON g.chunk_id = c.chunk_id
WHERE c.chunk_id IS NOT NULL GROUP BY c.chunk_id, g.deleted_at HAVING g.deleted_at IS NULL OR max(indexed_at) > g.deleted_at""",
        "q16_keyed_fetch_ordered": f"WITH cur AS ({_CURRENT}), {_CONTEXT}, {_REFS_ABSENT}, {_DEFS_ABSENT}, {_WANTED} SELECT query_id, wanted.kind, place, chunk_id, doc_id, section_id, 1.0::DOUBLE AS score FROM wanted JOIN cur USING (chunk_id)",
        "q12_index_plan_summary": "",
        "q14_token_batches": f"""WITH RECURSIVE {_HASHED}, placed AS (SELECT chunk_id, tokens, row_number() OVER (ORDER BY chunk_id) AS no FROM now),
cut AS (SELECT *, (no - 1) // {index.BLOCK} AS block, (no - 1) % {index.BLOCK} AS i FROM placed),
go AS (SELECT chunk_id, block, i, 1 AS batch, tokens, tokens::BIGINT AS filled, 1 AS items FROM cut WHERE i = 0
  UNION ALL SELECT c.chunk_id, c.block, c.i, CASE WHEN g.items >= {index.BATCH_ITEMS} OR g.filled + c.tokens > {index.BATCH_TOKENS} THEN g.batch + 1 ELSE g.batch END, c.tokens,
    CASE WHEN g.items >= {index.BATCH_ITEMS} OR g.filled + c.tokens > {index.BATCH_TOKENS} THEN c.tokens ELSE g.filled + c.tokens END,
    CASE WHEN g.items >= {index.BATCH_ITEMS} OR g.filled + c.tokens > {index.BATCH_TOKENS} THEN 1 ELSE g.items + 1 END FROM go g JOIN cut c ON c.block = g.block AND c.i = g.i + 1)
SELECT chunk_id, block, batch, tokens FROM go""",
        "q15_split_oversized": f"""WITH RECURSIVE cur AS ({_CURRENT}), long AS (SELECT chunk_id, regexp_split_to_array(text, '\\n\\s*\\n') AS ps FROM cur WHERE length(text) > {S.CHUNK_CHARS}),
rows AS (SELECT chunk_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM long),
go AS (SELECT chunk_id, i, 1 AS g, p AS acc FROM rows WHERE i = 0
  UNION ALL SELECT r.chunk_id, r.i, CASE WHEN length(g.acc) + length(r.p) + 2 <= {S.CHUNK_CHARS} THEN g.g ELSE g.g + 1 END, CASE WHEN length(g.acc) + length(r.p) + 2 <= {S.CHUNK_CHARS} THEN g.acc || chr(10) || chr(10) || r.p ELSE r.p END
    FROM go g JOIN rows r ON r.chunk_id = g.chunk_id AND r.i = g.i + 1),
parts AS (SELECT chunk_id, g, regexp_replace(arg_max(acc, i), '^\\s+|\\s+$', '', 'g') AS text FROM go GROUP BY 1, 2),
kept AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY g) AS part, count(*) OVER (PARTITION BY chunk_id) AS num_parts FROM parts WHERE text <> '')
SELECT chunk_id, part, num_parts, text FROM kept""",
        "q17_extract_references": f"WITH {_VIEW} SELECT DISTINCT id AS chunk_id, raw, target, relation, kind FROM named",
        "q18_expand_ranges": f"WITH {_VIEW} SELECT id AS chunk_id, a || '.' || x AS target FROM v, (SELECT unnest([1, 2, 3]) AS x) WHERE b = 2",
        "q20_view_edges": f"WITH {_VIEW} SELECT src, dst FROM edges",
        "q21_view_terms": f"WITH {_VIEW} SELECT id AS chunk_id, term, dst FROM used",
        "q26_parse_sections": f"""WITH {_VIEW} SELECT doc_id, a || '.' || b AS section_id, 'section' AS kind, 2 AS level, 'Matter' AS title, 'ART-' || a AS parent_id, '' AS children FROM v
UNION ALL SELECT doc_id, 'ART-' || a, 'article', 1, 'Part', NULL, string_agg(a || '.' || b, ' ' ORDER BY b) FROM v GROUP BY doc_id, a
UNION ALL SELECT DISTINCT doc_id, 'preamble', 'preamble', 1, 'Preamble', NULL, '' FROM v""",
        "q26_build_chunks": f"""WITH {_VIEW}, refs AS (SELECT src, string_agg(dst, ' | ' ORDER BY dst) AS ids FROM edges GROUP BY 1)
SELECT v.id AS chunk_id, a || '.' || b AS section_id, 'ART-' || a AS parent_section_id, 'Matter' AS section_title, {_VIEW_TEXT} AS text, 'section' AS kind, 2 AS level,
  'ARTICLE ' || a || ' Part > ' || a || '.' || b || ' Matter' AS path, 1 AS part, 1 AS num_parts, coalesce(ids, '') AS cross_reference_ids, CASE WHEN b = 5 THEN 'Term A' || a ELSE '' END AS defines_terms,
  coalesce(u.term, '') AS defined_terms_used, coalesce(u.dst, '') AS definition_ids FROM v LEFT JOIN refs ON refs.src = v.id LEFT JOIN used u ON u.id = v.id""",
        "q27_toc_span": f"WITH {_VIEW} SELECT doc_id, 1 AS first_line, n + 2 AS last_line FROM v GROUP BY doc_id, n HAVING n >= 3",
        "q31_prompt": f"""WITH cur AS ({_CURRENT}), {_CONTEXT}, shown AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY (source IN ('graph_traversal', 'direct_lookup')) DESC, seq, chunk_id) AS place, chunk_id FROM ctx QUALIFY place <= {context.CONTEXT})
SELECT query_id, string_agg('[' || doc_id || ' §' || section_id || '] ' || coalesce(nullif(section_title, ''), '(untitled)') || CASE WHEN coalesce(path, '') <> '' THEN chr(10) || '(' || path || ')' ELSE '' END || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS prompt
FROM shown JOIN cur USING (chunk_id) GROUP BY 1""",
        "q19_extract_terms": f"WITH cur AS ({_CURRENT}) SELECT DISTINCT chunk_id, term FROM (SELECT chunk_id, regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g') AS term FROM ({term})) WHERE length(term) > 2",
        "q20_resolve_edges": "WITH " + _RESOLVED,
        "q21_definition_edges": f"""WITH cur AS ({_CURRENT}), first AS (SELECT doc_id, term, arg_min(chunk_id, (list_transform(regexp_extract_all(section_id, '\\d+'), lambda x: TRY_CAST(x AS BIGINT)), part, chunk_id)) AS dst FROM (SELECT doc_id, chunk_id, section_id, part, unnest(defines_terms) AS term FROM cur) WHERE trim(term) <> '' GROUP BY 1, 2)
SELECT DISTINCT doc_id, src, term, dst FROM (SELECT doc_id, chunk_id AS src, unnest(defined_terms_used) AS term, defines_terms FROM cur) u JOIN first USING (doc_id, term) WHERE NOT coalesce(list_contains(defines_terms, term), FALSE) AND src <> dst""",
        "q22_dangling_edges": """SELECT DISTINCT src, dst FROM (SELECT chunk_id AS src, unnest(cross_reference_ids) AS dst FROM chunks) WHERE trim(dst) <> '' AND dst NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)""",
        "q23_corpus_report": f"""WITH cur AS ({_CURRENT}), lens AS (SELECT length(text) AS l, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM cur WHERE text IS NOT NULL)
SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, sum(len(coalesce(cross_reference_ids, [])))::BIGINT AS reference_edges, sum(len(coalesce(definition_ids, [])))::BIGINT AS definition_edges,
  count(*) FILTER (len(cross_reference_ids) > 0) AS with_references, (SELECT count(DISTINCT t) FROM (SELECT unnest(defines_terms) AS t FROM cur)) AS terms,
  (SELECT l FROM lens WHERE i = n // 2) AS median_length, (SELECT l FROM lens WHERE i = floor(n * 0.95)) AS p95_length FROM cur""",
        "q24_edge_fanout_topk": f"WITH cur AS ({_CURRENT}) SELECT src, count(*) AS edges FROM (SELECT DISTINCT chunk_id AS src, unnest(cross_reference_ids) AS dst FROM cur) WHERE trim(dst) <> '' GROUP BY 1 ORDER BY edges DESC, src LIMIT 10",
        "q25_normalize_lines": f"""SELECT doc_id, unnest(range(len(ls)))::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, list_transform(list_filter(string_split(replace(regexp_replace(text, '\\r\\n|\\r|\\f', chr(10), 'g'), chr(160), ' '), chr(10)),
  lambda x: NOT regexp_matches(x, '{_plain(T.FURNITURE)}')), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '\\s+$', '')) AS ls FROM documents WHERE text IS NOT NULL)""",
        "q28_referenced_absent": f"WITH cur AS ({_CURRENT}), {_CONTEXT}, {_REFS_ABSENT} SELECT query_id, label, chunk_id, place FROM refs_absent",
        "q29_definitions_absent": f"WITH cur AS ({_CURRENT}), {_CONTEXT}, {_DEFS_ABSENT} SELECT query_id, label, chunk_id, place FROM defs_absent",
        "q30_merge_context": f"WITH {_CONTEXT} SELECT query_id, seq, chunk_id, doc_id, section_id, source FROM ctx",
        "q31_prioritized_context": f"WITH {_CONTEXT} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY (source IN ('graph_traversal', 'direct_lookup')) DESC, seq, chunk_id) AS place, chunk_id, source FROM ctx QUALIFY place <= {context.CONTEXT}",
        "q32_named_sections": f"""WITH qs AS ({_QUESTIONS}), f AS (SELECT query_id, regexp_extract_all(raw_query, '{T.NAMED_SECTION}', 1) AS l FROM qs),
u AS (SELECT query_id, unnest(l) AS section_id, unnest(range(len(l))) AS i FROM f)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY min(i)) - 1)::INT AS pos, section_id FROM u GROUP BY query_id, section_id""",
        "q33_verify_citations": f"""WITH {_CONTEXT}, {_CITED}, seen AS (SELECT query_id, doc_id, section_id, min(place * 3) AS ord, TRUE AS verified FROM three GROUP BY 1, 2, 3
  UNION ALL SELECT query_id, 'none', '9.9', min(place * 3) + 1, FALSE FROM three GROUP BY 1) SELECT query_id, doc_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS place, verified FROM seen""",
        "q34_claim_evidence": f"""WITH {_CONTEXT}, {_CITED}, parts AS (SELECT *, unnest([0, 1]) AS half FROM three)
SELECT query_id, ((place - 1) * 2 + half)::INT AS claim_no, CASE half WHEN 0 THEN 'Point It follows from [' || doc_id || ' §' || section_id || '].' ELSE 'See also [none §9.9] and [' || doc_id || ' §' || section_id || '].' END AS claim, c.chunk_id, row_number() OVER (PARTITION BY query_id, p.place, half ORDER BY c.chunk_id) AS place
FROM parts p JOIN (SELECT DISTINCT query_id, doc_id, section_id, chunk_id FROM ctx) c USING (query_id, doc_id, section_id)""",
        "q35_wanted_ids": f"WITH cur AS ({_CURRENT}), {_CONTEXT}, {_REFS_ABSENT}, {_DEFS_ABSENT}, {_WANTED} SELECT query_id, chunk_id, kind, place FROM wanted",
        "q36_list_documents": f"SELECT doc_id, count(*) AS num_chunks FROM ({_CURRENT}) GROUP BY 1",
        "q37_document_sections": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_id) AS place, section_id, kind, level FROM (SELECT doc_id, section_id, arg_min(kind, parsed_at) AS kind, min(level) AS level FROM sections WHERE doc_id IS NOT NULL AND section_id IS NOT NULL GROUP BY 1, 2)",
        "q38_roster_resolve": "SELECT DISTINCT 'id:' || doc_id AS query_id, doc_id, 1 AS rule FROM manifest WHERE doc_id IS NOT NULL",
        "q39_density": density,
        "q39_density_select": f"SELECT * FROM ({density}) WHERE chars BETWEEN 1200 AND 260000 AND headings >= 1 ORDER BY score DESC, doc_id LIMIT 15",
        "q40_session_history": f"WITH {_LATEST} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, query_id) AS place, query_id, raw_query, status, created_at FROM latest WHERE session_id IS NOT NULL QUALIFY place <= {traces.HISTORY}",
        "q40_sessions": "SELECT session_id, min(created_at) AS created_at, count(DISTINCT query_id) AS queries FROM traces WHERE session_id IS NOT NULL GROUP BY 1",
        "q41_trace_latest_state": f"WITH {_LATEST} SELECT query_id, status, last_node, iteration, created_at FROM latest",
        "q40_session_queries": "SELECT DISTINCT session_id, query_id FROM traces WHERE session_id IS NOT NULL AND query_id IS NOT NULL",
        "q41_trace_replay": f"""WITH {_LATEST}, steps AS (SELECT query_id, list_concat(CASE WHEN query_type IS NULL THEN [] ELSE ['planner'] END,
  flatten(list_transform(range(CASE WHEN coalesce(needs_retrieval, TRUE) THEN coalesce(iteration, 0) ELSE 0 END), lambda i: ['retrieve', 'sufficiency'])),
  CASE WHEN status = 'complete' THEN ['generate', 'faithfulness'] ELSE [] END) AS ns FROM latest)
SELECT query_id, unnest(range(len(ns)))::INT AS step, unnest(ns) AS node FROM steps""",
        "q42_latency_by_node": "SELECT user_id AS query_id, event_type AS node, round(sum(value), 4) AS latency_ms FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2",
        "q42_usage_rollup": "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1",
        "q43_rate_window": "SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens FROM events WHERE ts IS NOT NULL WINDOW w AS (ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)",
    }
    named = f"WITH qs AS ({_QUESTIONS}), s AS (SELECT query_id, len(regexp_extract_all(coalesce(raw_query, ''), '{T.NAMED_SECTION}')) > 0 AS named, right(query_id, 1) NOT IN ('0', '2', '4', '6', '8') AS odd FROM qs)"
    every["q44_scripted_outcomes"] = named + """ SELECT query_id, CASE WHEN odd THEN 'factual' WHEN named THEN 'overview' ELSE 'out_of_scope' END AS query_type, odd OR named AS needs_retrieval, CASE WHEN odd OR named THEN 2 ELSE 0 END AS iteration,
  CASE WHEN odd OR named THEN 'query_rewrite' END AS strategy, CASE WHEN odd OR named THEN FALSE END AS sufficient, odd OR named AS low_confidence, CASE WHEN odd OR named THEN 'low' ELSE 'high' END AS confidence FROM s"""
    every["q44_scripted_log"] = named + """ SELECT query_id, n AS iteration, step, CASE WHEN n = 1 AND step <> 'refine' THEN '' ELSE 'query_rewrite' END AS strategy FROM s,
  (VALUES (1, 'retrieve'), (1, 'sufficiency'), (1, 'refine'), (2, 'retrieve'), (2, 'sufficiency')) AS t(n, step) WHERE odd OR named"""
    every["q12_index_plan_summary"] = f"SELECT action, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / 10000.0::DOUBLE, 6) AS minutes FROM ({every['q12_index_plan']}) GROUP BY 1"
    return every
