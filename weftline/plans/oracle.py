"""DuckDB SQL for the registered queries. It is written against the tables alone, not against the Spark code."""

from __future__ import annotations

from .queries import MAJORITY, MINORITY

_DOCS = "SELECT doc_id AS id, 'doc_' || doc_id || '.pdf' AS name, text AS content, md5(text) AS hash, lang, source, n_chars FROM documents"
_SLICES = "SELECT doc_id AS id, 'doc_' || (doc_id // 4) || '.pdf' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '_' || (doc_id % 4) END AS name, 'doc_' || (doc_id // 4) || '.pdf' AS source_name FROM documents"
_JUDGED = """SELECT d.doc_id, d.lang, d.source, d.doc_id % 3 + 1 AS hop,
  CASE quality WHEN 1 THEN '正确' WHEN 0 THEN '错误' END AS verdict, CASE toxic WHEN 1 THEN '正确' WHEN 0 THEN '错误' END AS base_verdict
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
_SCORED = """SELECT event_id, event_type, greatest(0, least(3, round_even(value / 10, 0)::int)) AS score FROM events"""


def _distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"


def _hits(k: int, where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id AS id, {_distance('e.embedding', 'q.embedding')} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND {where})) WHERE rank <= {k}"""


_SIM = "greatest(0.0, least(1.0, 1 - distance * distance / 2))"
_UNITS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([。！？.!?])\s*', '\1' || chr(1), 'g'), '\x01|\n+'), lambda u: regexp_replace(u, '^\s+|\s+$', '', 'g')), lambda u: u <> '')"
_CHUNKS = "SELECT doc_id AS id, doc_id // 4 AS doc_id, CASE WHEN doc_id % 4 = 0 THEN 'head' ELSE 'body_' || (doc_id % 4) END AS name, doc_id % 4 AS place, text AS content FROM documents"


def _count(words: list[str]) -> str:
    return " + ".join(f"contains(lower(content), '{w}')::int" for w in words)


_KEYWORD = f"""SELECT *, 10.0 * n_minority + n_majority AS score FROM (SELECT id AS chunk_id, doc_id, {_count(MINORITY)} AS n_minority, {_count(MAJORITY)} AS n_majority FROM ({_CHUNKS}))
  WHERE n_minority + n_majority > 0 ORDER BY n_minority > 0 DESC, n_minority DESC, n_majority DESC, score DESC, chunk_id LIMIT 50"""
_DUAL = f"""SELECT query_id, chunk_id, greatest(a, b) AS score, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'chunk+node' WHEN a IS NOT NULL THEN 'chunk' ELSE 'node' END AS match_type FROM (
  SELECT coalesce(c.query_id, n.query_id) AS query_id, coalesce(c.chunk_id, n.chunk_id) AS chunk_id, a, b FROM
  (SELECT query_id, id AS chunk_id, {_SIM} AS a FROM ({_hits(30)})) c FULL JOIN
  (SELECT query_id, id + id % 2 AS chunk_id, max({_SIM}) AS b FROM ({_hits(20)}) GROUP BY ALL) n ON c.query_id = n.query_id AND c.chunk_id = n.chunk_id)"""
_WORDS = """SELECT vec_id AS query_id, CASE vec_id // 100 % 3 WHEN 0 THEN ['blehe', 'thinhe', 'eringed'] WHEN 1 THEN ['blehe'] ELSE []::varchar[] END AS minority,
  CASE vec_id // 100 % 3 WHEN 0 THEN ['tion', 'the', 'edand', 'oner'] WHEN 1 THEN ['tion', 'oner'] ELSE ['edand', 'the'] END AS majority FROM embeddings WHERE vec_id % 100 = 0"""
_POOL = f"""SELECT *, 10.0 * n_minority + n_majority AS score FROM (SELECT query_id, id AS chunk_id, doc_id, len(list_filter(minority, lambda w: contains(lower(content), w))) AS n_minority,
    len(list_filter(majority, lambda w: contains(lower(content), w))) AS n_majority FROM ({_CHUNKS}) c, ({_WORDS}) w) WHERE n_minority + n_majority > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n_minority > 0 DESC, n_minority DESC, n_majority DESC, chunk_id) <= 50"""
_RELEVANCE = "((doc_id * 37 + query_id) % 101) / 101.0"
_PATH = f"""SELECT p.query_id, p.chunk_id, p.doc_id, p.score FROM ({_POOL}) p JOIN (SELECT query_id, doc_id FROM (SELECT DISTINCT query_id, doc_id FROM ({_POOL}))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_RELEVANCE} DESC, doc_id) <= 10) d ON p.query_id = d.query_id AND p.doc_id = d.doc_id"""
_UNION = f"""SELECT coalesce(d.query_id, k.query_id) AS query_id, coalesce(d.chunk_id, k.chunk_id) AS chunk_id, greatest(d.score, k.score) AS score,
  CASE WHEN k.chunk_id IS NULL THEN match_type WHEN d.chunk_id IS NULL THEN 'keyword' ELSE match_type || '+keyword' END AS match_type
  FROM ({_DUAL}) d FULL JOIN ({_PATH}) k ON d.query_id = k.query_id AND d.chunk_id = k.chunk_id"""


def _materials(full: bool) -> str:
    keep = "place <> 0 OR bodies = 0" if full else "place = 0 OR match_type IS NOT NULL"
    return f"""WITH u AS ({_UNION}), c AS ({_CHUNKS}),
    d AS (SELECT query_id, doc_id, max(score) AS best, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, doc_id) AS material_id FROM u JOIN c ON u.chunk_id = c.id GROUP BY query_id, doc_id)
    SELECT query_id, material_id, doc_id, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY place, id) AS position, id AS chunk_id,
      coalesce(match_type, '{'full_body_expand' if full else 'head'}') AS match_type, round(coalesce(score, best), 4) AS score
    FROM (SELECT d.query_id, d.material_id, d.doc_id, d.best, c.id, c.place, u.match_type, u.score, count(*) FILTER (c.place <> 0) OVER (PARTITION BY d.query_id, d.doc_id) AS bodies
      FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN u ON u.chunk_id = c.id AND u.query_id = d.query_id) WHERE {keep}"""


def _pick(column: str, values: list) -> str:
    """The value at the column's place in a list, over and over."""
    said = ", ".join("NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{said}])[1 + {column} % {len(values)}]"


_RIGHT, _WRONG, _PARTLY = "正确", "错误", "部分正确"
#: By hand, for queries.JUDGED_TEXTS: the verdict with two labels, and with three.
_OF_TWO = [_RIGHT, _WRONG, _RIGHT, _WRONG, _RIGHT, _WRONG, _WRONG, _RIGHT, _RIGHT, _WRONG, _RIGHT, None, _RIGHT, _WRONG, None, None, _WRONG, None]
_OF_THREE = [_RIGHT, None, None, _WRONG, _PARTLY, _WRONG, None, _RIGHT, None, _RIGHT, _PARTLY, None, _RIGHT, None, None, None, _WRONG, _PARTLY]
#: By hand, for queries.WINNER_TEXTS: the side, and the system that is called by its name.
_STATED = ["A", "B", "A", "A", "tie", "tie", None, "B", "tie", "A", "B", "tie", None, None, None, None, None, "B", None, "A"]
_CALLED = [None] * 12 + ["hypergraph", "llm_only", None, None, None, None, "llm_only", None]
_SWAPPED = "substr(md5(event_id::varchar), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f')"
_JUDGE = f"""SELECT event_id, stated, CASE WHEN stated = 'tie' THEN 'tie' WHEN stated IS NOT NULL THEN CASE WHEN (stated = 'A') <> swapped THEN 'hypergraph' ELSE 'llm_only' END ELSE called END AS judge
  FROM (SELECT event_id, {_pick('event_id', _STATED)} AS stated, {_pick('event_id', _CALLED)} AS called, {_SWAPPED} AS swapped FROM events)"""
#: By hand, for queries.JUDGE_ANSWERS: verdict and score of both sides, A's reason, B's dimensions, the named system's verdict, the winner.
_JUDGED_SIDES = [
    (_RIGHT, 3, "good", _WRONG, 0, "x=0,y=0", None, "A"), (_WRONG, 0, "", _RIGHT, 2, "x=2,y=2", None, "B"), (_RIGHT, 1, "", _WRONG, 0, "x=0,y=0", None, "tie"), (_WRONG, 0, "", _PARTLY, 1, "x=1,y=1", None, "B"),
    (_PARTLY, 1, "", _RIGHT, 3, "d1=3", None, None), (None,) * 8, (None,) * 7 + ("A",), (None,) * 6 + (_WRONG, None),
]
_SIDE_COLUMNS = ["a_verdict", "a_score", "a_reason", "b_verdict", "b_score", "b_dimensions", "named_verdict", "better"]
_STAGE_DOCS = f"SELECT id, content, {_pick('id', ['new', 'summary', 'chunk', 'new', 'build'])} AS status FROM ({_DOCS})"
_STAGE_CHUNKS = f"""SELECT doc_id AS id, {_pick('doc_id', [' Head', 'body_1', 'body_2', None, 'body_3'])} AS name, {_pick('doc_id', ['flag', 'role', 'index', 'no', 'broken', None, 'false'])} AS kind, {_pick('doc_id', ['new', 'extract', 'build'])} AS status FROM documents"""
_EDGES = f"SELECT id * 2 AS id, id AS doc_id, CASE WHEN id % 2 = 0 THEN id END AS chunk_id, md5('old ' || hash) AS content_md5 FROM ({_DOCS}) WHERE id % 3 <> 2 UNION ALL SELECT id * 2 + 1, id, NULL, md5('old ' || hash) FROM ({_DOCS}) WHERE id % 9 = 0"


def _block(shift: int, verdict: str) -> str:
    n = f"(d.doc_id + {shift})"
    return f"""struct_pack(answer := CASE WHEN {n} % 6 <> 0 THEN ' a' || d.doc_id || ' ' ELSE '' END, raw_answer := CASE WHEN {n} % 4 <> 0 THEN 'raw' || d.doc_id END, query_status := ({n} % 11 <> 0)::bigint, query_error := CASE WHEN {n} % 13 = 0 THEN 'timeout' END,
      llm_acc := CASE {verdict} WHEN 1 THEN '正确' WHEN 0 THEN '错误' END, score := {n} % 4, judge_error := CASE WHEN {n} % 17 = 0 THEN 'bad' END, latency := CASE WHEN {n} % 5 = 0 THEN 0.5 END)"""


_RESULTS = f"""SELECT d.doc_id, d.doc_id % 19 <> 0 AND text <> '' AS question, d.lang, d.source, CASE WHEN d.doc_id % 3 <> 0 THEN {_block(0, 'quality')} END AS hg, CASE WHEN d.doc_id % 7 <> 0 THEN {_block(1, 'toxic')} END AS lo, {_block(2, 'toxic')} AS old
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
_SYSTEMS = f"""SELECT doc_id, lang, source, 'hypergraph' AS system, coalesce(hg, old) AS b FROM ({_RESULTS}) UNION ALL SELECT doc_id, lang, source, 'llm_only', lo FROM ({_RESULTS})"""


def _answer(b: str) -> str:
    return f"trim(coalesce(nullif({b}.answer, ''), {b}.raw_answer, ''))"


def _lost(b: str) -> str:
    return f"({b}.query_error IS NOT NULL OR coalesce({b}.query_status = 0, false) OR {b}.judge_error IS NOT NULL)"


_ENTITIES = "SELECT DISTINCT conv_id, turn, text, entity FROM (SELECT conv_id, turn, text, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS entity FROM conversations) WHERE length(entity) >= 4"
_BUILT = """SELECT doc_id, turn, chunk_id, unnest([one, two]) AS name, unnest([role, CASE WHEN length(b) > length(a) THEN b ELSE a END]) AS content FROM (
  SELECT conv_id AS doc_id, turn, conv_id * 1000 + turn AS chunk_id, role, coalesce(w[1], 'none1') AS one, coalesce(w[2], 'none2') AS two, substr(text, 1, 20) AS a, substr(text, 1, 15 + 3 * turn) AS b
  FROM (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 4) AS raw, list_transform(list_filter(list_zip(raw, range(1, len(raw) + 1)), lambda p: list_position(raw, p[1]) = p[2]), lambda p: p[1]) AS w FROM conversations))"""
_PLAN = """SELECT plan_id, position, id, CASE WHEN turn = 0 OR turn - 1 > top THEN '' ELSE (turn - 1)::varchar END AS deps, turn FROM (
  SELECT conv_id AS plan_id, turn, turn::varchar AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, max(turn) OVER (PARTITION BY conv_id) AS top
  FROM conversations WHERE trim(text) <> '') WHERE position <= 6"""


def _verdicts(rows: str, keys: str, verdict: str = "verdict") -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}count(*) AS n, coalesce(sum(({verdict} = '正确')::int), 0)::bigint AS n_right, coalesce(sum(({verdict} = '错误')::int), 0)::bigint AS n_wrong,
      sum(({verdict} IS NULL)::int)::bigint AS n_unknown,
      coalesce(sum(({verdict} = '正确')::int), 0)::double / nullif(count({verdict}), 0) AS accuracy FROM ({rows}) {group}"""


SQL = {
    "doc_insert_dedup": f"SELECT min(id) AS doc_id, 'doc_' || min(id) || '.pdf' AS name, hash FROM ({_DOCS}) GROUP BY hash",
    "doc_name_antijoin": "SELECT doc_id, 'doc_' || doc_id || '.pdf' AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "search_eq": "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_custkey = 7",
    "count_by": "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'",
    "keyset_page": "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity, 4) AS l_quantity FROM lineitem WHERE l_returnflag = 'R' AND (l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber > 2)) ORDER BY l_orderkey, l_linenumber LIMIT 50",
    "in_list_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "partial_update_last_wins": "SELECT c_custkey, c_name, round(coalesce(p, c_acctbal), 4) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
    "cascade_delete": """WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c))
      SELECT 'customer' AS tbl, count(*) AS deleted FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (FROM o)""",
    "family_base": f"SELECT id AS doc_id, name, source_name AS base, id % 4 AS slice_index FROM ({_SLICES})",
    "family_closure": f"""WITH RECURSIVE s AS (SELECT id, name, regexp_replace(name, '_[0-9]+$', '') AS b0, source_name AS base, CASE WHEN id % 16 = 3 THEN 'doc_' || ((id + 4) // 4) || '.pdf' END AS src FROM ({_SLICES})),
      link AS (SELECT id, name AS r FROM s UNION SELECT id, base FROM s UNION SELECT id, src FROM s WHERE src IS NOT NULL),
      reach AS (SELECT name AS r FROM s WHERE id % 100 = 0 UNION SELECT base FROM s WHERE id % 100 = 0
        UNION SELECT b.r FROM reach JOIN link a ON a.r = reach.r JOIN link b ON b.id = a.id)
      SELECT id AS doc_id, name FROM s WHERE id IN (SELECT link.id FROM link JOIN reach ON link.r = reach.r)""",
    "slice_plan": """SELECT 'doc_' || doc_id || '.pdf' AS base, 'doc_' || doc_id || '.pdf' || CASE WHEN i = 0 THEN '' ELSE '_' || i END AS doc_name, i * 12 AS page_start, least(pages, (i + 1) * 12) AS page_end, i AS slice_index, pages AS total_pages, n AS n_slices
      FROM (SELECT doc_id, pages, n, unnest(range(n)) AS i FROM (SELECT doc_id, n_chars // 200 AS pages, greatest(1, (n_chars // 200 + 11) // 12) AS n FROM documents))""",
    "object_key": r"""SELECT page_id, k AS key, nullif(regexp_replace(regexp_extract(regexp_replace(k, '[?#].*$', ''), '[^/]*$'), '[\\/:*?"<>|]', '_', 'g'), '') AS file
      FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '^/+', '') AS k FROM pages)""",
    "download_plan": r"""WITH k AS (SELECT page_id AS id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^/+', '') AS key FROM pages),
      f AS (SELECT id, key, nullif(regexp_extract(regexp_replace(key, '[?#].*$', ''), '[^/]*$'), '') AS file FROM k),
      a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS nk FROM f),
      b AS (SELECT *, row_number() OVER (PARTITION BY file, nk = 1 ORDER BY id) AS nf FROM a)
      SELECT CASE WHEN file IS NULL THEN 'skipped_invalid' WHEN nk > 1 OR nf > 1 THEN 'skipped_duplicate' ELSE 'download' END AS state, count(*) AS n FROM b GROUP BY 1""",
    "file_dedup_pref": f"""WITH f AS (SELECT id, hash, CASE id % 3 WHEN 0 THEN hash || '.pdf' WHEN 1 THEN 'f_' || id || '.pdf' ELSE 'n' || id || 'x.pdf' END AS name FROM ({_DOCS})),
      p AS (SELECT *, first_value(name) OVER (PARTITION BY hash ORDER BY CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE id % 3 WHEN 1 THEN id ELSE 0 END, name) AS kept_name FROM f)
      SELECT name, hash, kept_name, name = kept_name AS keep FROM p""",
    "sentence_split": f"SELECT doc_id, i - 1 AS pos, u[i] AS unit FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT doc_id, {_UNITS} AS u FROM documents))",
    "join_units": f"""SELECT doc_id, len(u)::bigint AS n_units, md5(CASE WHEN len(u) = 0 THEN '' ELSE list_reduce(u, lambda a, x: a || CASE WHEN regexp_matches(a, '[A-Za-z0-9]$') AND regexp_matches(x, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || x) END) AS joined_md5
      FROM (SELECT doc_id, {_UNITS} AS u FROM documents)""",
    "head_body_order": """SELECT conv_id AS doc_id, conv_id * 100 + 99 - turn AS id, CASE WHEN turn = 0 THEN 'head' ELSE 'body_' || turn END AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations""",
    "prior_slices": "SELECT conv_id, turn, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS prior_md5 FROM conversations",
    "entity_longest": f"SELECT conv_id, entity, md5(text) AS description_md5, first_at FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, entity) AS first_at, row_number() OVER (PARTITION BY conv_id, entity ORDER BY length(text) DESC, turn) AS n FROM ({_ENTITIES})) WHERE n = 1",
    "entity_degree": f"SELECT entity, count(DISTINCT conv_id) AS degree, count(*) AS n_nodes FROM ({_ENTITIES}) GROUP BY entity",
    "llm_json_sum": "SELECT event_type, sum((props->>'$.k')::bigint)::bigint AS k_sum FROM events GROUP BY event_type",
    "vector_topk_l2": f"SELECT query_id, id AS vec_id, round(distance, 4) AS distance, rank FROM ({_hits(10)})",
    "vector_similarity": f"SELECT query_id, id AS vec_id, round({_SIM}, 4) AS score FROM ({_hits(10)})",
    "vector_topk_all_cells": f"SELECT query_id, id AS vec_id, round(distance, 4) AS distance, rank FROM ({_hits(10)})",
    "vector_topk_half": f"SELECT query_id, id AS vec_id, round(distance, 4) AS distance, rank FROM ({_hits(10)})",
    "vector_topk_bytes": f"SELECT query_id, id AS vec_id, round(distance, 4) AS distance, rank FROM ({_hits(10, where='e.vec_id % 7 <> 0')})",
    "vector_topk_tombstoned": f"SELECT query_id, id AS vec_id, rank FROM ({_hits(10, where='e.vec_id % 7 <> 0')})",
    "vector_dedupe_hits": f"SELECT query_id, id, round(distance, 4) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT query_id, id % 50 AS id, min(distance) AS distance FROM ({_hits(20)}) GROUP BY ALL)) WHERE rank <= 5",
    "vector_compact": "SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0",
    "deleted_stats": "SELECT vec_id // 100 AS shard, count(*) AS total, sum((vec_id % 7 = 0)::int)::bigint AS deleted, round(avg((vec_id % 7 = 0)::int), 4) AS deleted_ratio FROM embeddings GROUP BY 1",
    "node_hits_to_chunk": f"SELECT query_id, chunk_id, round(score, 4) AS score, node_id FROM (SELECT query_id, label::bigint AS chunk_id, score, id AS node_id, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS n FROM (SELECT h.query_id, h.id, {_SIM} AS score, e.label FROM ({_hits(20)}) h JOIN embeddings e ON e.vec_id = h.id)) WHERE n = 1",
    "keyword_match": f"SELECT chunk_id, n_minority::bigint AS n_minority, n_majority::bigint AS n_majority, score::double AS score FROM ({_KEYWORD})",
    "merge_hits": f"SELECT query_id, chunk_id, round(score, 4) AS score, match_type FROM ({_DUAL})",
    "build_materials": _materials(False),
    "build_materials_full_body": _materials(True),
    "rerank_fallback": "SELECT row_number() OVER (ORDER BY s DESC, doc_id) AS material_id, doc_id, s AS material_score, true AS fallback FROM (SELECT doc_id // 4 AS doc_id, max(n_chars)::double AS s FROM documents GROUP BY 1) ORDER BY s DESC, doc_id LIMIT 4",
    "plan_normalize": f"SELECT plan_id, position, id, deps FROM ({_PLAN})",
    "ready_steps": f"""WITH p AS ({_PLAN}), done AS (SELECT plan_id, id FROM p WHERE position <= plan_id % 3)
      SELECT plan_id, id FROM p WHERE (plan_id, id) NOT IN (SELECT (plan_id, id) FROM done) AND (deps = '' OR (plan_id, deps) IN (SELECT (plan_id, id) FROM done) )""",
    "sources_distinct": "SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY f, role) AS place FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL)",
    "usage_sum": "SELECT user_id, sum(CASE WHEN event_type <> 'error' THEN (props->>'$.k')::bigint END)::bigint AS tokens FROM events GROUP BY user_id",
    "doc_recall": "SELECT d.doc_id % 50 AS question_id, count(*) AS n_expected, count(l.doc_id) AS n_hit, count(*) - count(l.doc_id) AS n_miss, round(count(l.doc_id)::double / count(*), 4) AS recall FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1",
    "verdict_summary": f"SELECT n, n_right, n_wrong, n_unknown, round(accuracy, 4) AS accuracy FROM ({_verdicts(_JUDGED, '')})",
    "verdict_by_hop": f"SELECT hop, n, n_right, n_wrong, n_unknown, round(accuracy, 4) AS accuracy FROM ({_verdicts(_JUDGED, 'hop')})",
    "recall_vs_accuracy": f"""SELECT coalesce(bucket, 'total') AS bucket, coalesce(v, 'total') AS verdict, count(*) AS n FROM (
      SELECT coalesce(verdict, '未知') AS v, CASE doc_id % 5 WHEN 4 THEN 'unknown' WHEN 3 THEN 'hit' WHEN 0 THEN 'miss' ELSE 'partial' END AS bucket FROM ({_JUDGED})) GROUP BY CUBE (bucket, v)""",
    "system_comparison": f"""SELECT n_pairs, graph_wins, base_wins, ties, round(graph_wins::double / n_pairs, 4) AS graph_win_rate FROM (
      SELECT count(*) AS n_pairs, coalesce(sum((verdict = '正确' AND base_verdict = '错误')::int), 0)::bigint AS graph_wins, coalesce(sum((verdict = '错误' AND base_verdict = '正确')::int), 0)::bigint AS base_wins, coalesce(sum((verdict = base_verdict)::int), 0)::bigint AS ties
      FROM ({_JUDGED}) WHERE verdict IS NOT NULL AND base_verdict IS NOT NULL)""",
    "crosstab": f"SELECT coalesce(verdict, '未知') AS verdict, coalesce(base_verdict, '未知') AS base_verdict, count(*) AS n FROM ({_JUDGED}) GROUP BY ALL",
    "group_metrics": f"""SELECT event_type, count(*) AS n, sum((score >= 2)::int)::bigint AS n_right, sum((score = 1)::int)::bigint AS n_partly, sum((score = 0)::int)::bigint AS n_wrong, round(avg(score), 4) AS score_mean,
      round(avg((score >= 2)::int), 4) AS accuracy, round(avg((score >= 1)::int), 4) AS lenient_accuracy, round(avg(score) / 3, 4) AS score_share FROM ({_SCORED}) GROUP BY event_type""",
    "score_hist": f"SELECT i AS score, coalesce(n, 0)::bigint AS n FROM range(4) r(i) LEFT JOIN (SELECT score, count(*) AS n FROM ({_SCORED}) GROUP BY score) ON score = i",
    "category_coverage": f"""SELECT label, n, declared, round(n::double / declared, 4) AS coverage FROM (SELECT source AS label, count(*) AS n FROM ({_JUDGED}) WHERE verdict IS NOT NULL GROUP BY source)
      LEFT JOIN (SELECT source AS l, count(*) AS declared FROM documents WHERE source <> 'src3' GROUP BY source) ON l = label""",
    "category_distribution": """SELECT field, label, n, round(n / sum(n) OVER (PARTITION BY field), 4)::double AS ratio FROM (
      SELECT 'lang' AS field, coalesce(nullif(trim(lang), ''), 'NA') AS label, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(nullif(trim(source), ''), 'NA'), count(*) FROM documents GROUP BY ALL)""",
    "category_compare_outer": f"""SELECT coalesce(x.source, y.source) AS source, round(x.accuracy, 4) AS a, round(y.accuracy, 4) AS b, round(x.accuracy - y.accuracy, 4) AS delta
      FROM ({_verdicts(f"SELECT * FROM ({_JUDGED}) WHERE source <> 'src1'", 'source')}) x FULL JOIN ({_verdicts(f"SELECT * FROM ({_JUDGED}) WHERE source <> 'src2'", 'source', 'base_verdict')}) y ON x.source = y.source""",
    "pairwise_order": "SELECT item_id, substr(md5(item_id::varchar), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS swapped FROM benchmark",
    "normalize_score": "SELECT event_id, greatest(0, least(3, round_even(round(value / 5, 1), 0)))::bigint AS score FROM events",
    "stage_metrics": """SELECT event_type AS stage, sum((kind = 'real')::int)::bigint AS n_real, sum((kind = 'cached')::int)::bigint AS n_cached, sum((kind = 'skipped')::int)::bigint AS n_skipped,
      round(coalesce(sum(CASE WHEN kind = 'real' THEN value END), 0), 4) AS seconds, coalesce(sum(CASE WHEN kind = 'real' THEN (props->>'$.k')::bigint END), 0)::bigint AS tokens
      FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'cached' WHEN event_id % 7 = 0 THEN 'skipped' ELSE 'real' END AS kind FROM events) GROUP BY event_type""",
    "model_cache_join": """WITH d AS (SELECT doc_id, md5(text || chr(31) || '') AS key FROM documents)
      SELECT doc_id, key, 1::bigint AS status, key IN (SELECT key FROM d WHERE doc_id % 3 = 0) AS cache_hit FROM d""",
    "eval_failures": "SELECT event_id FROM events WHERE event_type = 'error' OR event_id % 11 = 0 OR event_id % 13 = 0 OR props IS NULL",
    "eval_remaining": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)",
    "latency_long": """SELECT event_type, metric, count(v) AS n, round(avg(v), 4) AS mean, round(sum(v), 4) AS total FROM (
      SELECT event_type, 'value' AS metric, value AS v FROM events UNION ALL SELECT event_type, 'tokens', (props->>'$.k')::double FROM events) GROUP BY ALL""",
    "metric_table": f"""WITH m AS (SELECT event_type, count(*)::double AS questions, avg(score) AS score, max(score)::double AS best FROM ({_SCORED}) GROUP BY event_type),
      l AS (SELECT event_type, 'questions' AS metric, questions AS v FROM m UNION ALL SELECT event_type, 'score', score FROM m UNION ALL SELECT event_type, 'best', best FROM m)
      SELECT metric, round(max(v) FILTER (event_type = 'click'), 4) AS a, round(max(v) FILTER (event_type = 'view'), 4) AS b, round(max(v) FILTER (event_type = 'click') - max(v) FILTER (event_type = 'view'), 4) AS delta FROM l GROUP BY metric""",
    "dimension_counts": "SELECT dimension, count(*) AS n FROM (SELECT lang AS dimension FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT 'hop' || (doc_id % 3) FROM documents) GROUP BY 1",
    "sample_docs": "SELECT doc_id, lang FROM documents ORDER BY md5('44/' || doc_id), doc_id LIMIT 20",
    "metric_lines": "SELECT event_type AS name, count(*) AS n, sum(event_id % 100)::double AS total FROM events WHERE event_id % 10 > 1 GROUP BY 1",
    "error_kinds": "SELECT substr('failed after <n> s at <hex>: ' || regexp_replace(regexp_replace(url, '[0-9]+', '<n>', 'g'), '\\s+', ' ', 'g'), 1, 160) AS kind, count(*) AS n FROM pages GROUP BY 1",
    "union_hits": f"SELECT query_id, chunk_id, round(score, 4) AS score, match_type FROM ({_UNION})",
    "context_text": f"""SELECT query_id, material_id, md5('----- Material ' || material_id || ' | source: doc_' || m.doc_id || '.pdf -----' || chr(10) || string_agg(
        CASE WHEN chunk_id % 4 = 0 THEN '### Head' ELSE '### Index block ' || position || ' (match=' || match_type || ')' END || chr(10) || text, chr(10) ORDER BY position)) AS text_md5
      FROM ({_materials(False)}) m JOIN documents d ON d.doc_id = chunk_id WHERE material_id <= 4 GROUP BY query_id, material_id, m.doc_id""",
    "answered_questions": f"""WITH m AS ({_materials(False)}),
      t AS (SELECT query_id, material_id, m.doc_id, '----- Material ' || material_id || ' | source: doc_' || m.doc_id || '.pdf -----' || chr(10) || string_agg(
        CASE WHEN chunk_id % 4 = 0 THEN '### Head' ELSE '### Index block ' || position || ' (match=' || match_type || ')' END || chr(10) || text, chr(10) ORDER BY position) AS text
        FROM m JOIN documents d ON d.doc_id = chunk_id WHERE material_id <= 4 GROUP BY query_id, material_id, m.doc_id),
      w AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY material_id) AS context, string_agg('doc_' || doc_id || '.pdf', ',' ORDER BY material_id) AS sources, string_agg(doc_id::varchar, ',' ORDER BY material_id) AS doc_ids FROM t GROUP BY 1),
      p AS (SELECT vec_id AS query_id, coalesce(context, '(no relevant product materials retrieved)' || chr(10)) || chr(10) || '.Question: question ' || vec_id AS prompt, sources, doc_ids FROM embeddings LEFT JOIN w ON query_id = vec_id WHERE vec_id % 100 = 0)
      SELECT query_id, length(prompt) || ' characters' AS thought, md5(prompt) AS answer, 1 AS status, sources, doc_ids FROM p""",
    "reranked_by_model": f"""WITH h AS (SELECT u.query_id, u.chunk_id, u.score, c.doc_id, substr(c.content, 1, 200) AS part FROM ({_UNION}) u JOIN ({_CHUNKS}) c ON c.id = u.chunk_id),
      d AS (SELECT query_id, doc_id, max(score) AS best, 1.0 / (1 + length(string_agg(part, chr(10) ORDER BY chunk_id))) AS relevance FROM h GROUP BY ALL),
      r AS (SELECT query_id, doc_id, query_id::varchar LIKE '2%' AS fallback, CASE WHEN query_id::varchar LIKE '2%' THEN best ELSE relevance END AS worth FROM d)
      SELECT query_id, material_id, doc_id, fallback FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY worth DESC, doc_id) AS material_id FROM r) WHERE material_id <= 4""",
    "thought_answer": """SELECT conv_id, turn, md5(CASE turn % 5 WHEN 0 THEN role WHEN 1 THEN role || chr(10) || ' 回答： ' || said WHEN 3 THEN trim(said) ELSE '' END) AS thought_md5,
      md5(CASE turn % 5 WHEN 1 THEN role WHEN 2 THEN trim(role || ' Answer: ' || said) WHEN 3 THEN '' ELSE trim(said) END) AS answer_md5
      FROM (SELECT conv_id, turn, role, regexp_replace(text, '\\s+', ' ', 'g') AS said FROM conversations)""",
    "question_ids": """SELECT doc_id, CASE doc_id % 6 WHEN 2 THEN lang || doc_id WHEN 0 THEN 'Q' || n0 WHEN 1 THEN 'Q' || n0 WHEN 3 THEN 'Q' || n0 ELSE 'Q' || n1 END AS question_id
      FROM (SELECT doc_id, lang, repeat('0', greatest(0, 4 - length(doc_id::varchar))::bigint) || doc_id AS n0, repeat('0', greatest(0, 4 - length((doc_id + 1)::varchar))::bigint) || (doc_id + 1) AS n1 FROM documents)""",
    "error_fingerprints": """SELECT CASE WHEN page_id % 4 = 0 THEN 'ValueError' ELSE 'TimeoutError' END || '|' || substr('Timeout for ' || CASE WHEN page_id % 2 = 0 THEN '<file>.pdf' ELSE url || '.txt' END || ' attempt ?/? pages=? code ' || page_id % 3, 1, 160) AS fingerprint, count(*) AS n FROM pages GROUP BY 1""",
    "build_nodes": f"""SELECT doc_id, chunk_id, doc_id * 2 AS hyperedge_id, name, md5(content) AS content_md5, md5(trim(name || chr(10) || content, chr(10) || chr(13) || chr(9) || ' ')) AS embedding_md5 FROM ({_BUILT})
      WHERE content <> '' AND turn % 4 <> 3 AND doc_id % 3 <> 2""",
    "build_hyperedges": f"""SELECT e.id, e.doc_id, h.head_id AS chunk_id, CASE WHEN h.head_id IS NOT NULL THEN CASE WHEN e.doc_id % 2 = 0 THEN 'given' ELSE 'summary' END WHEN e.doc_id % 2 = 0 THEN 'given' END AS source, h.head_id, h.n AS n_entities
      FROM (SELECT DISTINCT conv_id * 2 + k AS id, conv_id AS doc_id, k FROM conversations, (SELECT unnest([0, 1]) AS k) WHERE conv_id % 3 <> 2) e
      LEFT JOIN (SELECT doc_id, min(chunk_id) AS head_id, count(*) FILTER (content <> '' AND first) AS n FROM (SELECT *, chunk_id = min(chunk_id) OVER (PARTITION BY doc_id) AS first FROM ({_BUILT}) WHERE turn % 4 <> 3) GROUP BY 1) h ON h.doc_id = e.doc_id AND e.k = 0""",
    "build_statuses": """SELECT CASE WHEN turn % 4 = 3 THEN 'new' WHEN conv_id % 3 = 2 THEN 'extract' ELSE 'build' END AS status, count(*) AS n, sum(conv_id * 1000 + turn)::bigint AS ids FROM conversations GROUP BY 1""",
    "slice_prior": """WITH d AS (SELECT doc_id, doc_id // 4 AS fam, doc_id % 4 AS i, CASE WHEN doc_id % 13 = 6 THEN '  ' ELSE text END AS content,
        'doc_' || (doc_id // 4) || '.pdf' || CASE WHEN doc_id % 4 > 0 THEN '_' || (doc_id % 4) ELSE '' END AS name,
        CASE WHEN doc_id % 3 = 0 THEN '，源页约 ' || ((doc_id % 4) * 12 + 1) || '-' || ((doc_id % 4) * 12 + 12) ELSE '' END AS pages FROM documents WHERE doc_id % 11 <> 5),
      p AS (SELECT b.doc_id, count(a.doc_id) AS n, coalesce(string_agg('【前文第 ' || (a.i + 1) || ' 段 / ' || a.name || a.pages || '】' || chr(10) || regexp_replace(a.content, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY a.i), '') AS prior
        FROM d b LEFT JOIN d a ON a.fam = b.fam AND a.i < b.i AND regexp_replace(a.content, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY 1)
      SELECT doc_id, n AS n_prior, md5(prior) AS prior_md5, md5(CASE WHEN prior = '' THEN content ELSE (i + 1) || '/' || (i + 1) || chr(10) || prior || chr(10) || content END) AS prompt_md5 FROM d JOIN p USING (doc_id)""",
    "question_sheets": """WITH d AS (SELECT source AS file, doc_id, lang, ascii(right(source, 1)) % 3 AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n,
        CASE WHEN doc_id % 9 = 4 THEN '' ELSE trim(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g')) END AS q, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'r' || doc_id END AS r,
        CASE WHEN doc_id % 5 = 0 THEN row_number() OVER (PARTITION BY source ORDER BY doc_id) ELSE doc_id END AS number FROM documents WHERE source IS NOT NULL)
      SELECT file, (n + 1)::int AS row, CASE k WHEN 0 THEN 'set2' WHEN 1 THEN 'set1' ELSE 'generic' END AS kind, 'Q' || repeat('0', greatest(0, 4 - length(number::varchar))::bigint) || number AS question_id,
        md5(q || '|' || CASE k WHEN 2 THEN r ELSE '' END || '|' || CASE k WHEN 0 THEN r ELSE '' END || '|' || CASE WHEN doc_id % 2 = 0 THEN 'd1/d2/d3' ELSE '' END) AS said_md5,
        CASE k WHEN 0 THEN '难度等级=' || coalesce(nullif(lang, ''), 'NA') WHEN 1 THEN '应用场景=' || coalesce(nullif(lang, ''), 'NA') || ',note=' || coalesce(nullif(r, ''), 'NA') ELSE 'lang=' || coalesce(nullif(lang, ''), 'NA') END AS categories
      FROM d WHERE q <> ''""",
    "shard_assign": """SELECT shard, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, (3 + (row_number() OVER (ORDER BY doc_id) - 1 + 75) // 150)::int AS shard FROM documents) GROUP BY 1""",
    "vectorize_stage": """SELECT doc_id, CASE WHEN said = '' THEN 'undone' ELSE 'done' END AS embedding_status, CASE WHEN said <> '' THEN 16 END AS n,
      CASE WHEN said <> '' THEN round((16 * (strpos('0123456789abcdef', substr(sha256(said), 1, 1)) - 1) + strpos('0123456789abcdef', substr(sha256(said), 2, 1)) - 1) / 255.0, 4) END AS first
      FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'e' || doc_id ELSE text END AS said FROM documents)""",
    "lifetime_metrics": """SELECT event_type AS stage, count(*) AS sessions, sum(n0)::bigint AS n_real, sum(n1)::bigint AS n_cached, sum(n2)::bigint AS n_skipped, sum(tokens)::bigint AS tokens, round(sum(seconds), 2) AS seconds
      FROM (SELECT event_type, user_id, count(*) FILTER (event_id % 3 = 0) AS n0, count(*) FILTER (event_id % 3 = 1) AS n1, count(*) FILTER (event_id % 3 = 2) AS n2, sum(event_id) AS tokens, round(sum(value), 2) AS seconds FROM events GROUP BY ALL) GROUP BY ALL""",
    "keyword_index_hits": f"SELECT query_id, chunk_id, n_minority::bigint AS n_minority, n_majority::bigint AS n_majority, score::double AS score FROM ({_POOL})",
    "keyword_containing": """SELECT word, count(*) AS n, sum(doc_id)::bigint AS ids FROM documents d JOIN
      (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿ]+')) AS word FROM benchmark) WHERE length(word) >= 6) w ON contains(lower(d.text), word) GROUP BY word""",
    "keyword_hits": f"SELECT query_id, chunk_id, n_minority::bigint AS n_minority, n_majority::bigint AS n_majority, score::double AS score FROM ({_POOL})",
    "keyword_path": f"SELECT query_id, chunk_id, doc_id, score::double AS score FROM ({_PATH})",
    "rerank_by_question": f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {_RELEVANCE} DESC, doc_id) AS material_id, doc_id, round({_RELEVANCE}, 4)::double AS material_score, false AS fallback
      FROM (SELECT DISTINCT query_id, c.doc_id FROM ({_UNION}) u JOIN ({_CHUNKS}) c ON c.id = u.chunk_id) QUALIFY material_id <= 4""",
    "rerank_parse": """SELECT event_id, place, "at", score::double AS score FROM (SELECT event_id, unnest([0, 1, 2]) AS place, unnest([1, 0, 2]) AS "at", unnest([0.75, 0.5, 0.5]) AS score FROM events WHERE event_id % 4 = 0
      UNION ALL SELECT event_id, unnest([0, 1]), unnest([1, 3]), unnest([2.5, 1.0]) FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, 0, 7, 0.25 FROM events WHERE event_id % 4 = 2)""",
    "llm_json_entities": """WITH p AS (SELECT event_id, 'type' AS name, event_type AS content FROM events WHERE event_id % 9 <= 2 UNION ALL SELECT event_id, 'user', user_id::varchar FROM events WHERE event_id % 9 <= 2)
      FROM p UNION ALL SELECT event_id, 'more', 'x' FROM events WHERE event_id % 9 = 2 UNION ALL SELECT event_id, 'one', 'a: 1, b' FROM events WHERE event_id % 9 = 8""",
    "ratio_parse": f"""SELECT event_id, round(CASE WHEN event_id % 10 IN (5, 9) THEN event_id % 7 / 8.0 ELSE {_pick('event_id', [0.294, 0.294, 0.294, 0.294, 12.34, None, None, -0.5, 1.0, None])}::double END, 6) AS ratio FROM events""",
    "normalize_judgment": f"""SELECT event_id, {_pick('event_id', _OF_TWO)} AS of_two, {_pick('event_id', _OF_THREE)} AS of_three,
      coalesce({_pick('event_id', _OF_THREE)}, CASE event_id % 5 WHEN 0 THEN '错误' WHEN 1 THEN '部分正确' WHEN 2 THEN '正确' WHEN 3 THEN '正确' END) AS with_score FROM events""",
    "pairwise_winner": f"""SELECT event_id, stated, judge, coalesce(judge, CASE WHEN event_id % 5 > event_id % 3 THEN 'hypergraph' WHEN event_id % 5 < event_id % 3 THEN 'llm_only' ELSE 'tie' END) AS winner FROM ({_JUDGE})""",
    "judge_answers": f"""SELECT event_id, {", ".join(f"{_pick('event_id', [x[i] for x in _JUDGED_SIDES])}{'::bigint' if c.endswith('score') else '::varchar'} AS {c}" for i, c in enumerate(_SIDE_COLUMNS))} FROM events""",
    "plan_parse": """SELECT event_id, p.place::bigint AS place, p.id, p.question, p.deps FROM events JOIN (VALUES (0, 0, 's1', 'one?', ''), (0, 1, '2', 'two?', 's1'), (0, 2, '3', 'three?', 's1,2'), (1, 0, '7', 'seven', ''), (2, 0, '1', 'only', '')) p(n, place, id, question, deps) ON event_id % 6 = n""",
    "stage_pending": f"""SELECT 'summary' AS stage, count(*) AS n, sum(id)::bigint AS ids FROM ({_STAGE_DOCS}) WHERE status = 'new' UNION ALL SELECT 'chunk', count(*), sum(id)::bigint FROM ({_STAGE_DOCS}) WHERE status = 'summary'
      UNION ALL SELECT 'chunk all', count(*), sum(id)::bigint FROM ({_STAGE_DOCS}) WHERE id IN (SELECT doc_id FROM ({_EDGES})) UNION ALL SELECT 'extract', count(*), sum(id)::bigint FROM ({_STAGE_CHUNKS}) WHERE status = 'new'
      UNION ALL SELECT 'extract all', count(*), sum(id)::bigint FROM ({_STAGE_CHUNKS}) UNION ALL SELECT 'build', count(*), sum(id)::bigint FROM ({_STAGE_CHUNKS}) WHERE status = 'extract'""",
    "stage_clear": f"""SELECT stage, status, count(*) AS n, sum(id)::bigint AS ids FROM (SELECT 'chunk' AS stage, id, CASE WHEN id IN (SELECT doc_id FROM ({_EDGES})) THEN 'summary' ELSE 'new' END AS status FROM ({_STAGE_DOCS})
      UNION ALL SELECT 'summary', id, CASE WHEN status = 'build' THEN 'build' ELSE 'new' END FROM ({_STAGE_DOCS}) UNION ALL SELECT 'extract', id, 'new' FROM ({_STAGE_CHUNKS}) UNION ALL SELECT 'build', id, 'extract' FROM ({_STAGE_CHUNKS})) GROUP BY ALL""",
    "stage_summary": f"""WITH d AS ({_STAGE_DOCS}), old AS (SELECT doc_id, count(*) AS n, min(id) AS id, min(content_md5) AS least_md5 FROM ({_EDGES}) GROUP BY doc_id)
      SELECT d.id AS doc_id, CASE WHEN status = 'new' THEN 'summary' ELSE status END AS status, CASE WHEN status = 'new' THEN 1 ELSE n END AS n, old.id AS id,
        CASE WHEN status = 'new' THEN md5(split_part(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), chr(10), 1)) ELSE least_md5 END AS least_md5 FROM d LEFT JOIN old ON d.id = old.doc_id""",
    "head_chunks": f"""SELECT id, coalesce(trim(lower(name)) = 'head', false) OR coalesce(kind IN ('flag', 'role'), false) OR id IN (SELECT chunk_id FROM ({_EDGES}) WHERE chunk_id IS NOT NULL) AS bound,
      coalesce(trim(lower(name)) = 'head', false) OR coalesce(kind IN ('flag', 'role', 'index'), false) AS built FROM ({_STAGE_CHUNKS})""",
    "summary_order": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS turn FROM documents",
    "load_documents": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'doc_' || doc_id END AS name, md5(text) AS md5 FROM documents WHERE doc_id % 4 > 1 AND trim(text, ' ' || chr(10) || chr(9)) <> ''",
    "resolve_ids": "SELECT * FROM (VALUES (5::bigint, 1::bigint), (3, 2), (9, 3), (0, 4)) t(doc_id, place)",
    "sub_graph_export": f"""WITH c AS (SELECT doc_id, string_agg(name, ',' ORDER BY id) AS names, md5(string_agg(content, chr(10) ORDER BY id)) AS chunk_md5 FROM ({_CHUNKS}) GROUP BY doc_id),
      n AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS names FROM conversations GROUP BY conv_id), h AS (SELECT doc_id, count(*) AS n FROM ({_EDGES}) GROUP BY doc_id)
      SELECT d.id // 4 AS doc_id, md5(content) AS doc_md5, coalesce(h.n, 0) AS n_hyperedges, coalesce(c.names, '') AS chunk_names, coalesce(n.names, '') AS node_names, coalesce(chunk_md5, md5('')) AS chunk_md5
      FROM ({_DOCS}) d LEFT JOIN c ON c.doc_id = d.id // 4 LEFT JOIN n ON n.conv_id = d.id // 4 LEFT JOIN h ON h.doc_id = d.id // 4 WHERE d.id % 4 = 0""",
    "stats_sheet": """SELECT lang AS sheet, '来源' AS field, source AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6)::double AS ratio FROM documents GROUP BY lang, source
      UNION ALL SELECT lang, '难度', l, n, r FROM (SELECT DISTINCT lang FROM documents), (VALUES ('hard', 3, 0.75), ('easy', 1, 0.25)) v(l, n, r)""",
    "design_sheet": "SELECT role AS key, conv_id::varchar AS value FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY turn * 100000 + conv_id DESC) = 1",
    "cache_deletes": "SELECT page_id FROM pages WHERE page_id % 10 <> 3 AND page_id % 7 <> 0",
    "throughput": """WITH s AS (SELECT event_type, epoch(date_trunc('second', ts))::bigint AS sec, max(event_id)::double AS tokens, max(user_id)::double AS running FROM events GROUP BY ALL),
      e AS (SELECT event_type, (max(sec) - min(sec))::double AS dt, arg_max(tokens, sec) - arg_min(tokens, sec) AS tokens_d, (arg_max(running, sec) + arg_min(running, sec)) / 2 AS running_avg FROM s GROUP BY event_type)
      SELECT event_type, dt, tokens_d, round(tokens_d / dt, 6) AS tokens_ps, running_avg FROM e""",
    "counters_by_label": "SELECT CASE WHEN event_id % 3 = 0 THEN 'total' ELSE event_type END AS finished_reason, max(event_id) AS value FROM events GROUP BY 1",
    "sum_and_count": """SELECT event_type, round(sum(value), 2) AS sum, CASE WHEN event_type <> 'error' THEN count(*) ELSE 0 END::double AS count, CASE WHEN event_type <> 'error' THEN round(round(sum(value), 2) / count(*), 4) END AS mean FROM events GROUP BY event_type""",
    "system_rows": f"SELECT doc_id, system, b.answer, b.query_status, b.query_error, b.llm_acc, b.score FROM ({_SYSTEMS})",
    "detail_rows": f"""SELECT doc_id, hg.llm_acc AS hypergraph_verdict, hg.score AS hypergraph_score, {_answer('hg')} AS hypergraph_answer, lo.llm_acc AS llm_only_verdict, lo.score AS llm_only_score, {_answer('lo')} AS llm_only_answer,
      hg.score - lo.score AS score_delta, hg.llm_acc IS NOT DISTINCT FROM lo.llm_acc AS same_verdict FROM ({_RESULTS})""",
    "item_failures": f"""SELECT doc_id, NOT question OR hg IS NULL OR {_lost('hg')} OR lo IS NULL OR {_lost('lo')} AS failed, NOT question OR hg IS NULL OR {_lost('hg')} AS first_failed,
      hg IS NOT NULL AND ({_answer('hg')} <> '' OR hg.query_error IS NOT NULL OR hg.query_status = 1 OR hg.latency IS NOT NULL) AS attempted,
      CASE WHEN {_answer('hg')} <> '' AND {_answer('lo')} <> '' THEN 'pair' WHEN {_answer('hg')} <> '' THEN 'first' WHEN {_answer('lo')} <> '' THEN 'second' ELSE 'skip' END AS mode FROM ({_RESULTS})""",
    "report_summary": f"""SELECT system, field, label, count(*) AS n, sum({_lost('b')}::int)::bigint AS n_failed, count(*) FILTER (b.llm_acc = '正确') AS n_right, 0::bigint AS n_partly, count(*) FILTER (b.llm_acc = '错误') AS n_wrong,
      round(avg(b.score), 4) AS score_mean, round((count(*) FILTER (b.llm_acc = '正确'))::double / nullif(count(b.llm_acc), 0), 4) AS accuracy FROM (
      SELECT system, b, 'all' AS field, 'all' AS label FROM ({_SYSTEMS}) UNION ALL SELECT system, b, 'lang', coalesce(nullif(trim(lang), ''), 'NA') FROM ({_SYSTEMS}) UNION ALL SELECT system, b, 'source', coalesce(nullif(trim(source), ''), 'NA') FROM ({_SYSTEMS})) GROUP BY ALL""",
    "question_tasks": """SELECT task, place, doc_id FROM (SELECT task, n, doc_id, row_number() OVER (PARTITION BY task ORDER BY md5('44/' || task || '/' || doc_id), doc_id) AS place
      FROM documents, (VALUES ('1/0', 1), ('1/1', 1), ('1/2', 1), ('2/0', 2), ('2/1', 2), ('3/0', 3), ('3/1', 3), ('3/2', 3), ('3/3', 3)) t(task, n)) WHERE place <= n""",
    "sample_padded": """WITH p AS (SELECT task, n, n_nationkey, row_number() OVER (PARTITION BY task ORDER BY md5('44/' || task || '/' || n_nationkey), n_nationkey) AS rank, count(*) OVER (PARTITION BY task) AS held
        FROM nation, (VALUES ('all', 60), ('few', 3)) t(task, n) WHERE n_regionkey = 1), q AS (SELECT * FROM p WHERE rank <= n)
      SELECT q.task, i AS place, n_nationkey FROM q JOIN range(1, 61) r(i) ON i <= n AND (i - 1) % least(held, n) + 1 = rank""",
    "retrieve": f"SELECT * FROM ({_materials(False)}) WHERE material_id <= 4",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
