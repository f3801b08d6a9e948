"""DuckDB statements equivalent to the registered queries.

The shared CTEs restate the derived graph of `derived.py` in SQL.
"""

from __future__ import annotations

from graphloom.functions.identifiers import NODE_GROUPS, STOP_WORDS
from graphloom.functions.signatures import FNV_OFFSET, FNV_PRIME, LANE_A_PREFIX, LANE_B_PREFIX, LANES

_PATH = "p_brand || '/' || lower(p_type) || CASE WHEN p_partkey % 97 = 0 THEN '/bin/part_' ELSE '/part_' END || p_partkey || '.py'"
_GROUP = "CASE WHEN p_type = 'PROMO' THEN 'test' ELSE lower(p_type) END"
_LABEL = (
    "list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') || '_' || p_partkey"
)

FILES = f"""files AS (
  SELECT CAST(p_partkey AS BIGINT) AS ord, 'part_' || p_partkey AS id, {_LABEL} AS label, 'file' AS type,
    {_PATH} AS file, {_GROUP} AS grp, string_split(p_name, ' ')[-1] AS noun FROM part)"""
KEYS = """keys AS (
  SELECT *, l_orderkey * 64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS ord FROM (
    SELECT l_orderkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL))"""
CALLABLES = f"""callables AS (
  SELECT ord + (CAST(1 AS BIGINT) << 50) AS ord, 'fn_' || l_orderkey || '_' || l_partkey AS id,
    'getOrder' || l_orderkey || 'Part' || l_partkey AS label,
    CASE WHEN l_orderkey % 3 = 0 THEN 'method' ELSE 'function' END AS type, {_PATH} AS file, {_GROUP} AS grp,
    CAST(l_orderkey % 400 + 1 AS INT) AS line,
    CAST(1 + floor(qty / 10) AS INT) AS complexity, CAST(floor(qty / 7) AS INT) AS cognitive_complexity
  FROM keys JOIN part ON l_partkey = p_partkey)"""
DEFINES = """defines AS (
  SELECT ord, 'part_' || l_partkey AS source, 'fn_' || l_orderkey || '_' || l_partkey AS target, 'defines' AS relation FROM keys)"""
CALLS = """calls AS (
  SELECT ord + (CAST(1 AS BIGINT) << 61) AS ord, 'fn_' || l_orderkey || '_' || l_partkey AS source, 'fn_' || l_orderkey || '_' || b AS target,
    'calls' AS relation
  FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS b FROM keys) WHERE b IS NOT NULL)"""


def pairs(keep: str = "true", name: str = "pairs") -> str:
    return f"""{name} AS (
  SELECT l_orderkey * 64 + rn + (CAST(1 AS BIGINT) << 60) AS ord,
    'part_' || CASE WHEN (a + b) % 2 = 0 THEN a ELSE b END AS source,
    'part_' || CASE WHEN (a + b) % 2 = 0 THEN b ELSE a END AS target, 'imports' AS relation
  FROM (SELECT l_orderkey, l_partkey AS a, lead(l_partkey) OVER w AS b, row_number() OVER w AS rn
        FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE {keep})
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey)) WHERE b IS NOT NULL)"""


def imports(keep: str = "true", name: str = "imports") -> str:
    return pairs(keep, f"{name}_pairs") + f""",
{name} AS (SELECT min(ord) AS ord, source, target, 'imports' AS relation FROM {name}_pairs GROUP BY source, target)"""


NODES = """nodes AS (
  SELECT ord, id, label, type, file, grp, NULL AS line, NULL AS complexity, NULL AS cognitive_complexity FROM files
  UNION ALL SELECT ord, id, label, type, file, grp, line, complexity, cognitive_complexity FROM callables)"""
EDGES = """edges AS (SELECT * FROM defines UNION ALL SELECT * FROM imports UNION ALL SELECT * FROM calls)"""


def graph() -> str:
    return ",\n".join([FILES, KEYS, CALLABLES, DEFINES, CALLS, imports(), NODES, EDGES])


def sql(ctes: list[str], body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + body


def _group_case(path: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({path}), '(^|/)({'|'.join(dirs)})/') THEN '{g}'" for g, dirs in NODE_GROUPS.items()
    )
    return f"CASE {whens} ELSE 'other' END"


TOKENIZE = (
    "list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
    "'([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"
)


def tokenize(c: str) -> str:
    return TOKENIZE.format(c)


ENTRY = "regexp_matches(file, '(?i)^(?:[^/]+/)*(?:index|main|app|server|cli|bin)\\.[^/]*(?:/|$)|^(?:[^/]+/)*bin/.+|^(?:[^/]+/)*[^/]*\\.config\\.[^/]*(?:/|$)')"
RULES = "rules(rule_ord, rule_from, rule_to) AS (VALUES (0, 'economy', 'standard'), (1, 'large', '*'), (2, '*', 'test'), (3, 'small', 'medium'))"
GROUPED = """grouped AS (
  SELECT i.ord, i.source, i.target, s.file AS source_file, t.file AS target_file, s.grp AS from_group, t.grp AS to_group
  FROM imports i JOIN files s ON i.source = s.id JOIN files t ON i.target = t.id)"""
REACH = """reach AS (
  SELECT origin, source AS node_id, 1 AS d FROM origins JOIN imports ON target = origin
  UNION
  SELECT origin, i.source, d + 1 FROM reach JOIN imports i ON i.target = node_id WHERE d < {depth})"""
CLOSURE = """closure AS (
  SELECT target AS origin, source AS node_id FROM imports
  UNION SELECT origin, i.source FROM closure JOIN imports i ON i.target = node_id)"""
SCC = "scc AS (SELECT a.origin AS node_id, min(a.node_id) AS scc_id FROM closure a JOIN closure b ON a.origin = b.node_id AND a.node_id = b.origin GROUP BY a.origin)"

ORACLES: dict[str, str] = {}


def _add(name: str, ctes: list[str], body: str, recursive: bool = False) -> None:
    ORACLES[name] = sql(ctes, body, recursive)


_add("graph_stats", [graph()], """SELECT count(*) FILTER (type = 'file') AS files, count(*) FILTER (type = 'function') AS functions,
  count(*) FILTER (type = 'class') AS classes, count(*) FILTER (type = 'interface') AS interfaces,
  count(*) FILTER (type = 'struct') AS structs, count(*) FILTER (type = 'enum') AS enums,
  count(*) FILTER (type = 'protocol') AS protocols, count(*) FILTER (type = 'extension') AS extensions,
  (SELECT count(*) FROM edges) AS edges FROM nodes""")
_add("raw_dump_lines", [graph()], """SELECT 0 AS part, 0 AS ord, 'Project: derived' AS line UNION ALL SELECT 1 AS part, ord, id || ' | ' || label || ' (' || type || ') | ' || file AS line FROM nodes
  UNION ALL SELECT 2, ord, source || ' -> ' || target || ' (' || relation || ')' FROM edges""")
_add("raw_dump_tokens", [graph()], """SELECT CAST(ceil((sum(length(line)) + count(*) - 1) / 4.0) AS BIGINT) AS raw_dump_approx_tokens FROM (
  SELECT 'Project: derived' AS line UNION ALL SELECT id || ' | ' || label || ' (' || type || ') | ' || file FROM nodes
  UNION ALL SELECT source || ' -> ' || target || ' (' || relation || ')' FROM edges)""")
_add("fan_in", [graph()], "SELECT target AS id, count(*) AS fan_in FROM edges GROUP BY target")
_add("node_degree", [graph()], """SELECT id, count(*) AS degree FROM (
  SELECT source AS id FROM edges UNION ALL SELECT target FROM edges WHERE target <> source) GROUP BY id""")
_add("node_size", [graph()], """, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)
  SELECT id, degree, round(4.0 + sqrt(degree / (SELECT max(degree) FROM d)) * 12.0, 9) AS size FROM d""")
_add("edge_dedup", [pairs()], "SELECT min(ord) AS ord, source, target, relation FROM pairs GROUP BY ALL")
_add("first_definition", [FILES], """SELECT min_by(id, ord) AS id, min(ord) AS ord, min_by(file, ord) AS file, noun AS label FROM files GROUP BY noun""")
_add("node_ids", ["x AS (SELECT 1)"], """SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g')) AS file_id,
  lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g')) || '__page_link' AS symbol_id FROM pages""")
_add("node_group", ["x AS (SELECT doc_id, source || '/' || CASE doc_id % 9 " + " ".join(
    f"WHEN {i} THEN '{d}'" for i, d in enumerate(["ui", "API", "models", "db", "lib", "di", "__tests__", "hooks"])) + " ELSE 'misc' END || '/' || lang || '.ts' AS path FROM documents)"],
    f"SELECT doc_id, {_group_case('path')} AS node_group FROM x")
_add("tokenize_identifier", [FILES, KEYS, CALLABLES], f"""SELECT id, array_to_string({tokenize('label')}, ' ') AS words FROM (
  SELECT id, label FROM files UNION ALL SELECT id, label FROM callables)""")
_add("query_keywords", ["x AS (SELECT 1)"], f"""SELECT item_id, array_to_string(list_filter(string_split_regex(lower(text), '[\\s\\-_./]+'),
  lambda w: length(w) > 1 AND NOT list_contains([{', '.join(repr(w) for w in STOP_WORDS)}], w)), ' ') AS keywords FROM benchmark""")

_add("complexity_rank", [FILES, KEYS, CALLABLES], """SELECT ord, id AS node_id, label, type, file, complexity, cognitive_complexity FROM callables WHERE complexity >= 4""")
_add("cognitive_rank", [FILES, KEYS, CALLABLES], """SELECT ord, id AS node_id, label, type, file, complexity, cognitive_complexity FROM callables WHERE cognitive_complexity >= 6""")
_add("complexity_top", [FILES, KEYS, CALLABLES], """SELECT ord, id AS node_id, complexity FROM callables ORDER BY complexity DESC, ord LIMIT 20""")
_add("max_complexity_per_file", [KEYS, CALLABLES], "SELECT file, max(complexity) AS max_complexity FROM callables GROUP BY file")
_add("layer_summary", [FILES, KEYS, CALLABLES], """SELECT f.grp AS "group", count(*) AS files, CAST(coalesce(sum(m), 0) AS BIGINT) AS members
  FROM files f LEFT JOIN (SELECT file, count(*) AS m FROM callables GROUP BY file) USING (file) GROUP BY f.grp""")
_add("layer_dependencies", [FILES, imports(), GROUPED], "SELECT from_group, to_group, count(*) AS imports FROM grouped GROUP BY ALL")
_add("arch_violations", [FILES, imports(), GROUPED, RULES], """SELECT ord, source, target, source_file, target_file, from_group, to_group, rule_from, rule_to
  FROM grouped JOIN rules ON (rule_from = '*' OR rule_from = from_group) AND (rule_to = '*' OR rule_to = to_group)
  QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY rule_ord) = 1""")
_add("unreachable_files", [FILES, imports()], f"""SELECT ord, id AS node_id, file FROM files f
  WHERE grp <> 'test' AND NOT {ENTRY} AND NOT EXISTS (SELECT 1 FROM imports WHERE target = f.id)
    AND NOT EXISTS (SELECT 1 FROM files g WHERE g.file <> f.file AND g.noun = f.noun
      AND regexp_replace(g.file, '/[^/]*$', '') = regexp_replace(f.file, '/[^/]*$', ''))""")

_add("trace_impact", [FILES, imports(), "origins AS (SELECT 'part_14' AS origin)", REACH.format(depth=200)],
     "SELECT node_id, file, CAST(min(d) AS INT) AS distance FROM reach JOIN files ON id = node_id WHERE node_id <> origin GROUP BY ALL", True)
_add("trace_impact_depth2", [FILES, imports(), "origins AS (SELECT 'part_1012' AS origin)", REACH.format(depth=2)],
     "SELECT node_id, file, CAST(min(d) AS INT) AS distance FROM reach JOIN files ON id = node_id WHERE node_id <> origin GROUP BY ALL", True)
_add("all_impact", [imports(), "origins AS (SELECT 'part_' || p_partkey AS origin FROM part)", REACH.format(depth=30)],
     "SELECT origin, node_id, CAST(min(d) AS INT) AS distance FROM reach WHERE node_id <> origin GROUP BY ALL", True)
_add("all_impact_counts", [imports(), CLOSURE], "SELECT origin AS node_id, count(*) AS dependent_count FROM closure WHERE node_id <> origin GROUP BY origin", True)
_BOTTLENECKS = """scored AS (
  SELECT f.ord, f.id AS node_id, f.file, max(c.complexity) AS max_complexity, coalesce(any_value(dependent_count), 0) AS dependent_count
  FROM files f JOIN callables c USING (file) LEFT JOIN (
    SELECT origin, count(*) AS dependent_count FROM closure WHERE node_id <> origin GROUP BY origin) ON origin = f.id GROUP BY ALL),
bottlenecks AS (SELECT *, CAST(max_complexity * (1 + dependent_count) AS BIGINT) AS score,
  CASE WHEN max_complexity >= 10 AND dependent_count > 0 THEN 'high' WHEN dependent_count > 0 THEN 'foundational'
       WHEN max_complexity >= 10 THEN 'complex' ELSE 'low' END AS risk FROM scored)"""
_add("bottlenecks", [FILES, KEYS, CALLABLES, imports(), CLOSURE, _BOTTLENECKS], "SELECT * FROM bottlenecks", True)
_add("bottlenecks_top", [FILES, KEYS, CALLABLES, imports(), CLOSURE, _BOTTLENECKS], "SELECT * FROM bottlenecks ORDER BY score DESC, ord LIMIT 15", True)
_add("cycles_members", [imports(), CLOSURE, SCC], "SELECT scc_id, node_id FROM scc", True)
CYCLES = """inside AS (SELECT a.scc_id, i.source, i.target FROM imports i JOIN scc a ON i.source = a.node_id JOIN scc b ON i.target = b.node_id AND a.scc_id = b.scc_id),
hops AS (
  SELECT DISTINCT scc_id, scc_id AS node, 0 AS d FROM scc
  UNION SELECT h.scc_id, i.target, d + 1 FROM hops h JOIN inside i ON i.scc_id = h.scc_id AND i.source = h.node WHERE d < 30),
tree AS (SELECT scc_id, node, min(d) AS d FROM hops GROUP BY ALL),
parents AS (SELECT t.scc_id, t.node, t.d, min(i.source) AS parent FROM tree t JOIN inside i ON i.scc_id = t.scc_id AND i.target = t.node
  JOIN tree s ON s.scc_id = t.scc_id AND s.node = i.source AND s.d = t.d - 1 GROUP BY ALL),
lasts AS (SELECT t.scc_id, t.node, t.d FROM tree t JOIN inside i ON i.scc_id = t.scc_id AND i.source = t.node AND i.target = t.scc_id
  QUALIFY row_number() OVER (PARTITION BY t.scc_id ORDER BY t.d, t.node) = 1),
walk AS (
  SELECT scc_id, node, d AS pos FROM lasts
  UNION SELECT w.scc_id, p.parent, w.pos - 1 FROM walk w JOIN parents p ON p.scc_id = w.scc_id AND p.node = w.node),
cycle_rows AS (SELECT w.scc_id, pos, node AS node_id, coalesce(f.file, node) AS file FROM walk w LEFT JOIN files f ON f.id = w.node)"""
_add("cycles", [FILES, imports(), CLOSURE, SCC, CYCLES], "SELECT * FROM cycle_rows", True)
ORACLES["node_size"] = ORACLES["node_size"].replace("\n, d AS", ",\nd AS")

WORDS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: lower(w))"
DOC_HASH = f"""doc_nodes AS (
  SELECT doc_id AS ord, 'doc_' || doc_id AS node_id, 'doc' || doc_id AS label, source || '/' || lang || '/doc_' || doc_id || '.txt' AS file,
    CASE WHEN len(w) >= 20 THEN sha256(array_to_string(w, '|')) END AS duplicate_hash
  FROM (SELECT *, {WORDS} AS w FROM documents))"""
DOC_CALLS = """doc_calls AS (
  SELECT 'doc_' || doc_id AS source, 'helper_' || doc_id % 4 AS target FROM documents
  UNION ALL SELECT 'doc_' || doc_id, 'helper_9' FROM documents WHERE doc_id % 5 = 0)"""
DUP_SIZES = """sizes AS (SELECT duplicate_hash, count(*) AS group_size, min(ord) AS group_ord FROM doc_nodes
  WHERE duplicate_hash IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)"""
DUP_OUT = "SELECT duplicate_hash, group_ord, group_size, ord, node_id, label, file FROM doc_nodes JOIN sizes USING (duplicate_hash)"
_COMMON = """common AS (SELECT duplicate_hash FROM doc_nodes JOIN doc_calls ON source = node_id JOIN sizes USING (duplicate_hash)
  GROUP BY duplicate_hash, target, group_size HAVING count(DISTINCT node_id) = group_size)"""
_add("duplicate_groups", [DOC_HASH, DUP_SIZES], DUP_OUT)
_add("duplicate_groups_no_shared_helper", [DOC_HASH, DOC_CALLS, DUP_SIZES, _COMMON],
     DUP_OUT + " WHERE duplicate_hash NOT IN (SELECT duplicate_hash FROM common)")
_add("shape_hash", ["x AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}_][\\p{L}\\p{N}_]*|\\p{N}+|[^\\s\\p{L}\\p{N}_]'), "
     "lambda w: CASE WHEN regexp_matches(w, '^[\\p{L}_]') THEN 'ID' WHEN regexp_matches(w, '^\\p{N}') THEN 'LIT' ELSE w END) AS t FROM documents)"],
     "SELECT doc_id, CASE WHEN len(t) >= 20 THEN sha256(array_to_string(t, '|')) END AS shape_hash FROM x")


def _fnv(s: str) -> str:
    return (f"list_reduce(list_transform(string_split({s}, ''), lambda c: CAST(unicode(c) AS BIGINT)), "
            f"lambda h, c: (xor(h, c) * {FNV_PRIME}) % 4294967296, CAST({FNV_OFFSET} AS BIGINT))")


SIGNATURES = f"""words AS (SELECT doc_id, {WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], '') AS s FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 40)),
hashed AS (SELECT doc_id, {_fnv('s')} AS h FROM shingles),
lane_consts AS (SELECT lane, {_fnv(f"'{LANE_A_PREFIX}' || lane")} | 1 AS a, {_fnv(f"'{LANE_B_PREFIX}' || lane")} AS b FROM range({LANES}) r(lane)),
lanes AS (SELECT doc_id, lane, CAST(min((CAST(a AS HUGEINT) * h + b) % 4294967296) AS BIGINT) >> 16 AS v FROM hashed, lane_consts GROUP BY ALL),
signatures AS (SELECT doc_id, string_agg(lpad(printf('%x', v), 4, '0'), '' ORDER BY lane) AS signature FROM lanes GROUP BY doc_id)"""
_add("minhash_signature", [SIGNATURES], "SELECT doc_id, signature FROM documents LEFT JOIN signatures USING (doc_id)")
_add("similar_code", [SIGNATURES, DOC_HASH, DOC_CALLS, DUP_SIZES, _COMMON,
  """exact AS (SELECT b.node_id, b.file, 1.0 AS similarity, 'exact' AS kind FROM doc_nodes a JOIN doc_nodes b USING (duplicate_hash)
     WHERE a.node_id = 'doc_17' AND b.node_id <> 'doc_17' AND duplicate_hash NOT IN (SELECT duplicate_hash FROM common)),
fuzzy AS (SELECT n.node_id, any_value(n.file) AS file, count(*) FILTER (a.v = b.v) / 32.0 AS similarity, 'fuzzy' AS kind
     FROM lanes a JOIN lanes b USING (lane) JOIN doc_nodes n ON n.ord = b.doc_id
     WHERE a.doc_id = 17 AND b.doc_id <> 17 GROUP BY n.node_id)"""],
  """SELECT node_id, file, CAST(similarity AS DOUBLE) AS similarity, kind FROM (SELECT * FROM exact UNION ALL
     SELECT * FROM fuzzy WHERE similarity >= 0.05 AND node_id NOT IN (SELECT node_id FROM exact))
     ORDER BY similarity DESC, node_id COLLATE icu_noaccent, node_id LIMIT 50""")

# --- retrieval -----------------------------------------------------------

SMALL_QUERY = ["small", "ring", "part", "get", "order", "7?"]
TYPE_QUERY = ["promo", "function", "getorder1", "standard"]


def keyword_ctes(kws: list[str], type_filter: str | None, limit: int) -> list[str]:
    uniq = list(dict.fromkeys(kws))
    freq = ", ".join(f"count(*) FILTER (list_contains(terms, '{k}')) AS d{i}" for i, k in enumerate(uniq))
    terms = []
    for k in kws:
        d = f"d{uniq.index(k)}"
        w = f"CASE WHEN {d} = 0 THEN 1.0::DOUBLE ELSE greatest(ln(n / (1.0::DOUBLE + {d})), 0.1::DOUBLE) END"
        terms.append(f"""CASE WHEN ll = '{k}' THEN 10.0::DOUBLE ELSE 0 END
          + CASE WHEN list_contains(terms, '{k}') THEN greatest(5.0::DOUBLE * {w}, 2.5::DOUBLE) WHEN contains(ll, '{k}') THEN 2.0::DOUBLE ELSE 0 END
          + CASE WHEN contains(lower(file), '{k}') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN type = '{k}' THEN 3.0::DOUBLE ELSE 0 END""")
    where = f"WHERE type = '{type_filter}'" if type_filter else ""
    return [
        f"tn AS (SELECT *, {tokenize('label')} AS terms, lower(label) AS ll FROM nodes)",
        f"freq AS (SELECT count(*) AS n, {freq} FROM tn)",
        f"kw AS (SELECT ord, id, {' + '.join(terms)} AS score FROM tn, freq {where})",
        f"top AS (SELECT id, CAST(row_number() OVER (ORDER BY score DESC, ord) AS INT) AS rank, score FROM kw WHERE score > 0 QUALIFY rank <= {limit})",
    ]


_add("term_idf", [graph(), f"p AS (SELECT id, unnest(list_distinct({tokenize('label')})) AS term FROM nodes)"],
     "SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM nodes) / (1.0::DOUBLE + count(*))), 9) AS idf FROM p GROUP BY term")
_add("keyword_topk", [graph(), *keyword_ctes(SMALL_QUERY, None, 50)], "SELECT id, rank, round(score, 9) AS score FROM top")
_add("keyword_topk_typed", [graph(), *keyword_ctes(TYPE_QUERY, "function", 40)], "SELECT id, rank, round(score, 9) AS score FROM top")

_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def _cos(a: str, b: str) -> str:
    return f"{_DOT.format(a=a, b=b)} / (sqrt({_DOT.format(a=a, b=a)}) * sqrt({_DOT.format(a=b, b=b)}))"


VEC = "v AS (SELECT vec_id AS ord, 'vec_' || vec_id AS id, embedding AS e, 'vecLabel' || label AS label, 'vectors/label_' || label || '.py' AS file, 'function' AS type FROM embeddings)"
QV = "q AS (SELECT e AS qe FROM v ORDER BY ord LIMIT 1)"


def sem(k: int) -> str:
    return f"sem AS (SELECT id, ord, s, CAST(row_number() OVER (ORDER BY s DESC, ord) AS INT) AS rank FROM (SELECT id, ord, {_cos('qe', 'e')} AS s FROM v, q) QUALIFY rank <= {k})"


_add("cosine_topk", [VEC, QV, sem(100)], "SELECT id, rank, round(s, 9) AS semantic_score FROM sem")
_add("rrf_fusion", [VEC, QV, sem(80), "nodes AS (SELECT * FROM v)", *keyword_ctes(["label3", "label4", "vec"], None, 80),
  """fused AS (SELECT id, sum(c) AS f FROM (SELECT id, 0.4::DOUBLE / (60 + rank) AS c FROM top UNION ALL SELECT id, 0.6::DOUBLE / (60 + rank) FROM sem) GROUP BY id)"""],
  """SELECT id, CAST(row_number() OVER (ORDER BY f DESC, t.rank NULLS LAST, s.rank NULLS LAST) AS INT) AS rank, round(f, 12) AS final_score
     FROM fused LEFT JOIN top t USING (id) LEFT JOIN sem s USING (id) ORDER BY f DESC, t.rank NULLS LAST, s.rank NULLS LAST LIMIT 25""")
_add("mean_embedding", ["x AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings)"],
     "SELECT label, CAST(p AS INT) AS p, round(avg(CAST(v AS DOUBLE)), 9) AS m FROM x GROUP BY label, p")
_add("semantic_neighbors", [VEC, QV, sem(5),
  """m AS (SELECT list(a ORDER BY p) AS me FROM (SELECT p, avg(x) AS a FROM (SELECT unnest(range(len(e))) AS p, CAST(unnest(e) AS DOUBLE) AS x FROM v WHERE id IN (SELECT id FROM sem)) GROUP BY p))""",
  f"n AS (SELECT id, row_number() OVER (ORDER BY {_cos('me', 'e')} DESC, ord) AS r FROM v, m WHERE id NOT IN (SELECT id FROM sem))"],
  "SELECT id, rank FROM sem UNION ALL SELECT id, CAST(r + 5 AS INT) FROM n WHERE r <= 20")
EXPAND = """marks AS (
  SELECT id, rank AS sr, 0 AS phase, 0 AS n FROM top
  UNION ALL SELECT target, rank, 1, row_number() OVER (PARTITION BY t.id ORDER BY e.ord) AS n FROM top t JOIN edges e ON e.source = t.id
    WHERE target IN (SELECT id FROM nodes) QUALIFY n <= 10
  UNION ALL SELECT source, rank, 2, row_number() OVER (PARTITION BY t.id ORDER BY e.ord) AS n FROM top t JOIN edges e ON e.target = t.id
    WHERE source IN (SELECT id FROM nodes) QUALIFY n <= 10),
rel AS (SELECT id, CAST(row_number() OVER (ORDER BY place, id) AS INT) AS pos FROM (
  SELECT id, min(row(sr, phase, n)) AS place FROM marks GROUP BY id) QUALIFY pos <= 150)"""
_add("expand_context", [graph(), *keyword_ctes(SMALL_QUERY, None, 20), EXPAND], "SELECT id, pos FROM rel")
_SECTION_CTES = [graph(), *keyword_ctes(SMALL_QUERY, None, 20), EXPAND,
  """outs AS (SELECT source AS id, string_agg(label, ', ' ORDER BY n) AS o FROM (SELECT e.source, label, row_number() OVER (PARTITION BY e.source ORDER BY e.ord) AS n
       FROM edges e JOIN rel ON rel.id = e.source JOIN nodes t ON t.id = e.target QUALIFY n <= 3) GROUP BY source),
ins AS (SELECT target AS id, string_agg(label, ', ' ORDER BY n) AS i FROM (SELECT e.target, label, row_number() OVER (PARTITION BY e.target ORDER BY e.ord) AS n
       FROM edges e JOIN rel ON rel.id = e.target JOIN nodes s ON s.id = e.source QUALIFY n <= 2) GROUP BY target),
lines AS (SELECT pos, file, CASE WHEN type = 'file' THEN '- ' ELSE '  - ' END || type || ' ' || label || coalesce('; needs ' || o, '') || coalesce('; needed by ' || i, '') AS line
       FROM rel JOIN nodes USING (id) LEFT JOIN outs USING (id) LEFT JOIN ins USING (id))""",
  """sections AS (SELECT min(pos) AS section_ord, file AS section_key, 'file' AS kind, count(*) AS node_count,
     'in ' || file || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text FROM lines GROUP BY file)"""]
_add("context_sections", _SECTION_CTES, "SELECT * FROM sections")
_add("budget_fill", _SECTION_CTES, """SELECT section_ord, section_key, CAST(ceil(length(text) / 4.0) + 2 AS BIGINT) AS cost, CAST(sum(ceil(length(text) / 4.0) + 2) OVER w AS BIGINT) AS used,
   sum(ceil(length(text) / 4.0) + 2) OVER w <= 200 OR row_number() OVER w = 1 AS included FROM sections WINDOW w AS (ORDER BY section_ord)""")
_add("embedding_text", [graph(),
  """outs AS (SELECT source AS id, string_agg(label, ', ' ORDER BY n) AS o FROM (SELECT e.source, label, row_number() OVER (PARTITION BY e.source ORDER BY e.ord) AS n
       FROM edges e JOIN nodes t ON t.id = e.target QUALIFY n <= 5) GROUP BY source),
ins AS (SELECT target AS id, string_agg(label, ', ' ORDER BY n) AS i FROM (SELECT e.target, label, row_number() OVER (PARTITION BY e.target ORDER BY e.ord) AS n
       FROM edges e JOIN nodes s ON s.id = e.source QUALIFY n <= 5) GROUP BY target)"""],
  f"""SELECT id, array_to_string({tokenize('label')}, ' ') || ' — ' || type || ' in ' || string_split(file, '/')[-1] || chr(10) || 'layer: ' || grp
      || coalesce(chr(10) || 'calls: ' || o, '') || coalesce(chr(10) || 'used by: ' || i, '') AS text
      FROM nodes LEFT JOIN outs USING (id) LEFT JOIN ins USING (id) WHERE type <> 'file'""")
_add("node_neighbors", [graph()], """SELECT e.ord, relation, 'outgoing' AS direction, target AS other, label, type, file FROM edges e JOIN nodes n ON n.id = target WHERE source = 'part_14'
  UNION ALL SELECT e.ord, relation, 'incoming', source, label, type, file FROM edges e JOIN nodes n ON n.id = source WHERE target = 'part_14'""")

# --- clusters, diff, incremental -----------------------------------------

CLUSTERS = """fc AS (SELECT 0 AS phase, file AS key, count(*) AS node_count, min(ord) AS o FROM callables GROUP BY file HAVING count(*) > 3),
lefts AS (SELECT * FROM callables WHERE file NOT IN (SELECT key FROM fc)),
tc AS (SELECT 1 AS phase, type AS key, count(*) AS node_count, min(ord) AS o FROM lefts GROUP BY type HAVING count(*) > 5),
heads AS (SELECT *, 'cluster_' || (row_number() OVER (ORDER BY phase, o) - 1) AS cluster_id FROM (SELECT * FROM fc UNION ALL SELECT * FROM tc)),
mem AS (SELECT c.*, cluster_id FROM callables c JOIN heads ON phase = 0 AND key = file
        UNION ALL SELECT l.*, cluster_id FROM lefts l JOIN heads ON phase = 1 AND key = type),
ce AS (SELECT e.*, s.cluster_id AS source_cluster, t.cluster_id AS target_cluster FROM edges e LEFT JOIN mem s ON s.id = e.source LEFT JOIN mem t ON t.id = e.target
       WHERE s.cluster_id IS NOT NULL OR t.cluster_id IS NOT NULL)"""
_add("clusters", [graph(), CLUSTERS,
  """ty AS (SELECT cluster_id, string_agg(type, ',' ORDER BY o) AS types FROM (SELECT cluster_id, type, min(ord) AS o FROM mem GROUP BY ALL) GROUP BY cluster_id),
pu AS (SELECT cluster_id, string_agg(lower(label), ', ' ORDER BY ord) AS purposes FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ord) AS rn FROM mem QUALIFY rn <= 2) GROUP BY cluster_id),
it AS (SELECT source_cluster AS cluster_id, count(*) AS n FROM ce WHERE source_cluster = target_cluster GROUP BY ALL),
ex AS (SELECT cluster_id, string_agg(target, ',' ORDER BY rn) AS d FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY o, target) AS rn FROM (
   SELECT source_cluster AS cluster_id, target, min(ord) AS o FROM ce WHERE source_cluster IS NOT NULL AND source_cluster IS DISTINCT FROM target_cluster GROUP BY ALL) QUALIFY rn <= 5) GROUP BY cluster_id)"""],
  """SELECT cluster_id, CASE WHEN phase = 0 THEN regexp_replace(string_split(key, '/')[-1], '\\.[^/.]+$', '') ELSE key || 's' END AS label, node_count, types,
     node_count || ' ' || replace(types, ',', ', ') || 's including ' || purposes || CASE WHEN n > 0 THEN ', ' || n || ' internal connections' ELSE '' END AS summary,
     coalesce(d, '') AS external_deps FROM heads JOIN ty USING (cluster_id) JOIN pu USING (cluster_id) LEFT JOIN it USING (cluster_id) LEFT JOIN ex USING (cluster_id)""")
_add("node_to_cluster", [graph(), CLUSTERS], "SELECT id AS node_id, cluster_id FROM mem")
_add("cluster_edge_counts", [graph(), CLUSTERS], "SELECT source_cluster, target_cluster, count(*) AS edges FROM ce GROUP BY ALL")
_add("cluster_incoming", [graph(), CLUSTERS], """SELECT cluster_id, string_agg(source, ',' ORDER BY rn) AS incoming_deps FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY o, source) AS rn FROM (
   SELECT target_cluster AS cluster_id, source, min(ord) AS o FROM ce WHERE target_cluster IS NOT NULL AND source_cluster IS DISTINCT FROM target_cluster GROUP BY ALL) QUALIFY rn <= 5) GROUP BY cluster_id""")


def snapshot(name: str, keep: str, moved: bool) -> str:
    grp = "CASE WHEN ord % 13 = 0 THEN 'moved' ELSE grp END" if moved else "grp"
    line = "CASE WHEN line % 7 = 0 THEN line + 1 ELSE line END" if moved else "line"
    keys = f"(l_orderkey, l_partkey) IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE {keep})"
    return ",\n".join([
        imports(keep, f"imports_{name}"),
        f"""nodes_{name} AS (SELECT id, label, type, file, {grp} AS grp, NULL AS line FROM files
  UNION ALL SELECT id, label, type, file, grp, {line} FROM callables WHERE {keep.replace('l_orderkey', "CAST(string_split(id, '_')[2] AS BIGINT)")})""",
        f"""edges_{name} AS (SELECT source, target, relation FROM imports_{name}
  UNION ALL SELECT source, target, relation FROM defines WHERE {keep.replace('l_orderkey', "CAST(string_split(target, '_')[2] AS BIGINT)")})""",
    ])


_SNAPS = [FILES, KEYS, CALLABLES, DEFINES, snapshot("a", "l_orderkey % 10 <> 0", False), snapshot("b", "l_orderkey % 10 <> 1", True)]
_fields = ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{n}' END" for c, n in
                    [("label", "label"), ("type", "type"), ("file", "file"), ("grp", "group"), ("line", "line")])
_add("graph_diff_nodes", _SNAPS, f"""SELECT * FROM (SELECT coalesce(a.id, b.id) AS id,
  CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS status,
  CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE array_to_string(list_filter([{_fields}], lambda x: x IS NOT NULL), ',') END AS changed_fields
  FROM nodes_a a FULL JOIN nodes_b b ON a.id = b.id) WHERE status <> 'changed' OR changed_fields <> ''""")
_add("graph_diff_edges", _SNAPS, """SELECT source, target, relation, 'removed' AS status FROM (SELECT * FROM edges_a EXCEPT SELECT * FROM edges_b)
  UNION ALL SELECT source, target, relation, 'added' FROM (SELECT * FROM edges_b EXCEPT SELECT * FROM edges_a)""")
_add("stats_delta", _SNAPS, "SELECT " + ", ".join(
    f"(SELECT count(*) FROM nodes_b WHERE type = '{t}') - (SELECT count(*) FROM nodes_a WHERE type = '{t}') AS {n}" for n, t in
    {"files": "file", "functions": "function", "classes": "class", "interfaces": "interface", "structs": "struct", "enums": "enum", "protocols": "protocol", "extensions": "extension"}.items())
    + ", (SELECT count(*) FROM edges_b) - (SELECT count(*) FROM edges_a) AS edges")
_add("manifest_diff", ["l AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, sha256(text) AS hash, n_chars * 1000 AS m, n_chars AS size FROM documents)",
  "p AS (SELECT path, CASE WHEN doc_id % 22 = 0 THEN 'other' ELSE hash END AS hash, CASE WHEN doc_id % 11 = 0 THEN m - 1 ELSE m END AS m, size FROM l WHERE doc_id % 7 <> 0)",
  "c AS (SELECT * FROM l WHERE doc_id % 5 <> 0)"],
  """SELECT coalesce(p.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN p.path IS NULL THEN 'changed'
     WHEN p.m = c.m AND p.size = c.size THEN 'unchanged' WHEN p.hash = c.hash THEN 'refreshed' ELSE 'changed' END AS status
     FROM p FULL JOIN c ON p.path = c.path""")
_INCR = """touched AS (SELECT file FROM files WHERE ord % 17 = 0),
kept AS (SELECT * FROM nodes WHERE file NOT IN (SELECT file FROM touched)),
fresh AS (SELECT * FROM nodes WHERE file IN (SELECT file FROM touched) AND (type = 'file' OR line % 2 = 0)),
nn AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)"""
_add("incremental_edges", [graph(), _INCR], """SELECT min(ord) AS ord, source, target, relation FROM (
  SELECT * FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM nn)
  UNION ALL SELECT * FROM defines WHERE target IN (SELECT id FROM fresh)) GROUP BY source, target, relation""")
_add("incremental_nodes", [graph(), _INCR], "SELECT ord, id, label, type, file FROM nn")

# --- telemetry, sessions, evaluation -------------------------------------

_add("tool_metrics", ["c AS (SELECT event_type AS tool, value AS d, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)",
  """m AS (SELECT tool, d, event_type_ok AS ok, CASE WHEN k % 3 <> 0 THEN k END AS t, CASE WHEN tool = 'view' THEN k % 2 = 0 END AS h,
        CASE WHEN tool IN ('view', 'click') THEN k > 50 END AS tr FROM (SELECT *, tool <> 'error' AS event_type_ok FROM c))""",
  "l AS (SELECT tool, list(d ORDER BY d) AS ds FROM m GROUP BY tool)"],
  """SELECT tool, count(*) AS calls, round(avg(CAST(ok AS INT)), 9) AS success_rate,
     any_value(ds[CAST(least(len(ds) - 1, floor(0.5 * len(ds))) AS INT) + 1]) AS p50_duration_ms,
     any_value(ds[CAST(least(len(ds) - 1, floor(0.95 * len(ds))) AS INT) + 1]) AS p95_duration_ms,
     round(avg(t), 9) AS mean_approx_tokens, round(avg(CAST(h AS INT)), 9) AS cache_hit_rate, round(avg(CAST(tr AS INT)), 9) AS truncation_rate
     FROM m JOIN l USING (tool) GROUP BY tool""")
_add("debounce_batches", ["g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))",
  "s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)"],
  "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, session")
_KW = "list_filter(string_split_regex(lower(text), '[\\s\\-_./]+'), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(repr(w) for w in STOP_WORDS) + "], w))"
TURNS = f"turns AS (SELECT conv_id, turn, turn * turn * 60 AS at_s, {_KW} AS kw, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user' AND len({_KW}) > 0)"
_OVER = "len(list_filter({a}, lambda k: list_contains({b}, k))) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE)"
_add("session_cache", [TURNS, f"""fold AS (
  SELECT conv_id, turn, at_s, rn, kw, false AS cache_hit FROM turns WHERE rn = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.at_s, t.rn, CASE WHEN {_OVER.format(a='t.kw', b='f.kw')} >= 0.5 AND t.at_s - f.at_s <= 300 THEN f.kw ELSE t.kw END,
    {_OVER.format(a='t.kw', b='f.kw')} >= 0.5 AND t.at_s - f.at_s <= 300
  FROM fold f JOIN turns t ON t.conv_id = f.conv_id AND t.rn = f.rn + 1)"""], "SELECT conv_id, turn, cache_hit FROM fold", True)
_add("keyword_overlap_sessions", [f"t AS (SELECT conv_id, turn, {_KW} AS kw FROM conversations WHERE role = 'user')"],
  f"""SELECT a.conv_id, a.turn, round(CASE WHEN len(a.kw) = 0 OR len(b.kw) = 0 THEN 0.0 ELSE {_OVER.format(a='b.kw', b='a.kw')} END, 9) AS overlap
      FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2""")
_IR = """lines AS (SELECT l_orderkey AS query_id, l_partkey AS id, max(l_returnflag) = 'R' AS rel,
   row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_orderkey, l_partkey),
q AS (SELECT query_id, count(*) FILTER (rel) AS nr, count(*) FILTER (rel AND rank <= 2) AS h2, count(*) FILTER (rel AND rank <= 5) AS h5,
   count(*) FILTER (rank <= 2) AS n2, count(*) FILTER (rank <= 5) AS n5, min(rank) FILTER (rel) AS f,
   sum(CASE WHEN rel AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM lines GROUP BY query_id),
m AS (SELECT query_id, CASE WHEN nr = 0 THEN 1 ELSE h2 / nr END AS recall_at_2, CASE WHEN nr = 0 THEN 1 ELSE h5 / nr END AS recall_at_5,
   h2 / n2 AS precision_at_2, h5 / n5 AS precision_at_5, coalesce(1.0::DOUBLE / f, 0) AS reciprocal_rank,
   CASE WHEN nr = 0 THEN 1 ELSE dcg / list_sum(list_transform(range(1, least(nr, 5) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_at_5 FROM q)"""
_IRC = ["recall_at_2", "recall_at_5", "precision_at_2", "precision_at_5", "reciprocal_rank", "ndcg_at_5"]
_add("ir_metrics", [_IR], "SELECT query_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in _IRC) + " FROM m")
_add("ir_means", [_IR], "SELECT " + ", ".join(f"round(avg({c}), 7) AS {c}" for c in _IRC) + " FROM m")
_ACC = """sc AS (SELECT doc_id, source, lang, (CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'the of') AS INT)
   + CAST(regexp_matches(text, '(?i)\\band\\b') AS INT) + CAST(regexp_matches(text, '(?i)\\bque\\b') AS INT)) / 4.0::DOUBLE AS r,
   least(1.0, 600 / CAST(greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')), 1) AS DOUBLE)) AS p FROM documents),
acc AS (SELECT doc_id, source, lang, CASE WHEN r + p = 0 THEN 0 ELSE 2 * r * p / (r + p) END * 100 AS a FROM sc)"""
_add("accuracy_scores", [_ACC], "SELECT doc_id, round(a, 9) AS accuracy FROM acc")
_add("accuracy_stderr", [_ACC], "SELECT source, lang, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(a) / sqrt(count(*)) END, 6) AS std_err FROM acc GROUP BY source, lang")
_add("benchmark_summary", ["r AS (SELECT (n_chars % 200 - 100) / 100.0::DOUBLE AS tr, quality * 10.0::DOUBLE AS g, n_chars AS b, n_chars - n_chars % 37 AS w, (quality * 50.0::DOUBLE + 25) / 100 AS c, toxic * 0.5::DOUBLE AS e FROM documents JOIN labels USING (doc_id))"],
  """SELECT count(*) AS questions_run, round(avg(tr), 6) AS avg_token_reduction, round(avg(g), 6) AS avg_accuracy_gain, CAST(sum(b) AS BIGINT) AS total_baseline_tokens,
     CAST(sum(w) AS BIGINT) AS total_with_graph_tokens, CAST(sum(b) - sum(w) AS BIGINT) AS tokens_saved, count(*) FILTER (tr > 0.1) AS helped,
     count(*) FILTER (tr <= 0.1 AND tr > -0.1) AS neutral, count(*) FILTER (tr <= -0.1) AS hurt, round(sum(w) / sum(c), 6) AS tokens_per_correct_answer,
     round(sqrt(sum(pow(w * e, 2))) * sum(w) / pow(sum(c), 2), 6) AS tokens_per_correct_std_err FROM r""")
_add("version_order", ["v AS (SELECT DISTINCT (o_custkey % 3) || '.' || (o_orderkey % 17) || '.' || (o_orderkey % 5) AS version FROM orders)"],
  "SELECT version, lag(version) OVER (ORDER BY list_transform(string_split(version, '.'), lambda p: CAST(p AS INT))) AS previous FROM v")

# --- paths, positions ----------------------------------------------------

TREE = """tree AS (SELECT p_partkey AS k, p_partkey % 5 AS lang, lower(replace(p_brand, '#', '')) AS br, lower(p_type) AS ty FROM part),
tid AS (SELECT k, lang, br, ty, regexp_replace(lower(regexp_replace(CASE lang
  WHEN 0 THEN 'app/src/main/java/com/acme/' || br || '/' || ty || '/Part' || k || CASE WHEN k % 2 = 0 THEN '.java' ELSE '.kt' END
  WHEN 1 THEN 'py/acme/' || br || '/' || ty || '/part' || k || CASE WHEN k % 10 = 1 THEN '.py' ELSE '/__init__.py' END
  WHEN 2 THEN 'web/' || br || '/' || ty || '/part' || k || CASE WHEN k % 10 = 2 THEN '/index.ts' ELSE '.tsx' END
  WHEN 3 THEN 'go/' || br || '/' || ty || '/part' || k || '.go'
  ELSE 'ios/' || br || '/' || ty || '/Part' || k || CASE WHEN k % 10 = 4 THEN '.h' ELSE '.swift' END END, '[^a-zA-Z0-9_]', '_', 'g')), '_+', '_', 'g') AS id FROM tree)"""
_add("resolve_imports", [TREE], """SELECT DISTINCT a.id AS source, t.id AS target FROM tid a JOIN tid b ON b.k = a.k + 5 JOIN tid t ON
  CASE WHEN a.lang = 3 OR (a.lang = 0 AND a.k % 50 = 0) THEN t.lang = a.lang AND t.br = b.br AND t.ty = b.ty ELSE t.k = b.k END WHERE a.id <> t.id""")
_add("source_sets", ["x AS (SELECT 1)"], """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN ['commonMain', 'iosMain', 'jvmTest'][p_partkey % 3 + 1] END AS source_set,
  CASE WHEN p_partkey % 4 <> 0 THEN p_brand || '/core' END AS module FROM part""")
_add("expect_actual_pairs", ["""d AS (SELECT p_partkey AS k, p_partkey // 6 AS b, CASE WHEN (p_partkey // 6) % 5 <> 0 THEN 'mod' || p_partkey // 60 END AS module,
  CASE p_partkey % 3 WHEN 0 THEN 'commonMain' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'iosMain' ELSE 'androidMain' END ELSE 'jvmTest' END AS ss FROM part)"""],
  """SELECT 'n_' || a.k AS source, 'n_' || e.k AS target FROM d a JOIN d e ON a.b = e.b AND a.module IS NOT DISTINCT FROM e.module
     WHERE a.k % 3 <> 0 AND e.k % 3 = 0 AND (a.ss = e.ss OR a.ss IN ('iosMain', 'androidMain') AND e.ss = 'commonMain')""")
_add("nearest_declaration", [FILES, KEYS, CALLABLES, "probes AS (SELECT DISTINCT file, l_linenumber * 57 AS line FROM lineitem JOIN files ON id = 'part_' || l_partkey)"],
  """SELECT p.file, CAST(p.line AS INT) AS line, coalesce(arg_max(c.id, row(c.line, -c.ord)) FILTER (c.line - 1 <= p.line), any_value(f.id)) AS node_id
     FROM probes p LEFT JOIN callables c ON c.file = p.file JOIN files f ON f.file = p.file GROUP BY p.file, p.line""")
_add("code_lenses", [graph()], """SELECT c.id, c.file, c.line - 1 AS line, coalesce(n, 0) || CASE WHEN coalesce(n, 0) = 1 THEN ' dependent' ELSE ' dependents' END || ' · complexity ' || complexity AS title
  FROM callables c LEFT JOIN (SELECT target, count(*) AS n FROM edges GROUP BY target) ON target = c.id""")
_add("workspace_symbols", [KEYS, CALLABLES], "SELECT ord, id, label, type, file FROM callables WHERE contains(lower(label), 'part12') ORDER BY ord LIMIT 100")
_add("viewer_search", [graph()], "SELECT ord, id, label, type, file FROM nodes WHERE contains(lower(label), 'ring') OR contains(lower(file), 'ring') ORDER BY ord LIMIT 20")
_add("document_symbols", [FILES, KEYS, CALLABLES], "SELECT c.id, c.label, CASE c.type WHEN 'method' THEN 6 ELSE 12 END AS kind, c.line - 1 AS line FROM callables c JOIN files f ON f.file = c.file WHERE f.id = 'part_14'")
_add("graph_diagnostics", [FILES, imports(), GROUPED, RULES, CLOSURE, SCC, CYCLES], f"""SELECT source AS node_id, source_file AS file, 'violation' AS kind,
    'layer rule broken: ' || source_file || ' [' || from_group || '] depends on ' || target_file || ' [' || to_group || ']' AS message
  FROM grouped WHERE EXISTS (SELECT 1 FROM rules WHERE (rule_from = '*' OR rule_from = from_group) AND (rule_to = '*' OR rule_to = to_group))
  UNION ALL SELECT node_id, file, 'cycle', 'import cycle through ' || string_agg(file, ' → ' ORDER BY pos) OVER (PARTITION BY scc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) FROM cycle_rows
  UNION ALL SELECT id, file, 'unreachable', 'nothing imports ' || file FROM files f
  WHERE grp <> 'test' AND NOT {ENTRY} AND NOT EXISTS (SELECT 1 FROM imports WHERE target = f.id)
    AND NOT EXISTS (SELECT 1 FROM files g WHERE g.file <> f.file AND g.noun = f.noun
      AND regexp_replace(g.file, '/[^/]*$', '') = regexp_replace(f.file, '/[^/]*$', ''))""", True)

# --- parsing -------------------------------------------------------------

PARSED = """p AS (SELECT l_orderkey AS o, l_partkey AS k, max(l_linenumber) AS n,
    ['py', 'go', 'ts', 'js', 'kt', 'swift', 'java', 'm'][l_orderkey % 8 + 1] AS ext FROM lineitem GROUP BY ALL),
q AS (SELECT *, 'orders_o' || o || '_' || ext AS fid, 'orders_o' || o || '_' || ext || CASE WHEN ext = 'java' THEN '__order_fn' ELSE '__fn' END || k AS id,
    lag(k) OVER (PARTITION BY o ORDER BY k) AS prev FROM p)"""
_add("parsed_callables", [PARSED], """SELECT id, 'fn' || k AS label, CASE WHEN ext = 'java' THEN 'method' ELSE 'function' END AS type, 'orders/o' || o || '.' || ext AS file,
  CAST(1 + n AS INT) AS complexity, CAST(n AS INT) AS cognitive_complexity FROM q""")
_add("parsed_edges", [PARSED], """SELECT CASE WHEN ext = 'java' THEN fid || '__order' ELSE fid END AS source, id AS target, 'defines' AS relation FROM q
  UNION ALL SELECT DISTINCT fid, fid || '__order', 'defines' FROM q WHERE ext = 'java'
  UNION ALL SELECT q.id, r.id, 'calls' FROM q JOIN q r ON q.o = r.o AND q.prev = r.k""")
_add("parsed_imports", [PARSED], """SELECT DISTINCT 'orders/o' || o || '.' || ext AS file_path, unnest(CASE ext WHEN 'py' THEN ['os', 'sys'] WHEN 'go' THEN [] WHEN 'ts' THEN ['./x'] WHEN 'js' THEN ['./y']
  WHEN 'kt' THEN ['com.acme.Thing'] WHEN 'swift' THEN ['UIKit'] WHEN 'java' THEN ['java.util.List'] ELSE ['Thing.h'] END) AS specifier FROM q""")
_add("suggestions_by_kind", [FILES, KEYS, CALLABLES, imports(), GROUPED, RULES, CLOSURE, SCC, DOC_HASH, DOC_CALLS, DUP_SIZES, _COMMON], f"""SELECT * FROM (
  SELECT 'duplication' AS kind, count(*) AS suggestions FROM sizes WHERE duplicate_hash NOT IN (SELECT duplicate_hash FROM common) UNION ALL
  SELECT 'cycle' AS kind, count(DISTINCT scc_id) AS suggestions FROM scc
  UNION ALL SELECT 'architecture-violation', count(*) FROM grouped WHERE EXISTS (SELECT 1 FROM rules WHERE (rule_from = '*' OR rule_from = from_group) AND (rule_to = '*' OR rule_to = to_group))
  UNION ALL SELECT 'high-complexity', count(*) FROM callables WHERE complexity >= 4
  UNION ALL SELECT 'dead-code', count(*) FROM files f WHERE grp <> 'test' AND NOT {ENTRY} AND NOT EXISTS (SELECT 1 FROM imports WHERE target = f.id)
    AND NOT EXISTS (SELECT 1 FROM files g WHERE g.file <> f.file AND g.noun = f.noun
      AND regexp_replace(g.file, '/[^/]*$', '') = regexp_replace(f.file, '/[^/]*$', ''))) WHERE suggestions > 0""", True)

# --- graph views, exports ------------------------------------------------

_ONE = "one AS (SELECT file FROM files WHERE id = 'part_14')"
_add("file_members", [graph(), _ONE], "SELECT ord, id, label, type FROM nodes JOIN one USING (file) WHERE type <> 'file'")
_add("file_external_edges", [graph(), _ONE], """SELECT e.ord, t.label AS target_label, s.label AS source_label FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target
  WHERE s.file = (SELECT file FROM one) AND t.file <> s.file""")
_add("dependencies_by_type", [graph()], """SELECT type, count(*) AS total, min(ord) AS first, string_agg(label || ' by ' || relation, '; ' ORDER BY ord) FILTER (rn <= 5) AS shown FROM (
  SELECT e.ord, relation, type, label, row_number() OVER (PARTITION BY type ORDER BY e.ord) AS rn FROM edges e JOIN nodes n ON n.id = e.source WHERE target = 'part_14') GROUP BY type""")
_add("impact_by_distance", [FILES, imports(), "origins AS (SELECT 'part_14' AS origin)", REACH.format(depth=200)],
     "SELECT distance, count(*) AS files FROM (SELECT node_id, CAST(min(d) AS INT) AS distance FROM reach JOIN files ON id = node_id WHERE node_id <> origin GROUP BY ALL) GROUP BY distance", True)
_add("viewer_links", [graph()], "SELECT source, target, relation FROM edges WHERE source <> target AND source <> '' AND target <> ''")
_add("references", [graph(), _ONE], """SELECT n.id, n.file, greatest(coalesce(n.line, 1) - 1, 0) AS line FROM nodes n WHERE n.id IN (SELECT source FROM edges WHERE target = coalesce(
  (SELECT id FROM callables WHERE file = (SELECT file FROM one) AND line = 1 ORDER BY ord LIMIT 1), 'part_14'))""")
_add("export_json", [graph()], """SELECT ord, '{"source":"' || source || '","target":"' || target || '","relation":"' || relation || '"}' AS value FROM edges""")
_CSV = "CASE WHEN regexp_matches({0}, '[\",\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
_add("export_csv", [graph()], """SELECT ord, id || ',' || label || ',' || type || ',' || file || ',' || grp || ',' || coalesce(CAST(line AS VARCHAR), '') || ',' AS value FROM nodes
  UNION ALL SELECT ord, source || ',' || target || ',' || relation FROM edges""")
_XML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_add("escaped_labels", ["x AS (SELECT doc_id, coalesce(text, '') AS t, text FROM documents)"],
     f"SELECT doc_id, sha256({_CSV.format('t')}) AS csv_sha256, sha256({_XML.format('text')}) AS xml_sha256 FROM x")
