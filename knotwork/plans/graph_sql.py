"""SQL of the graph queries, written apart from the operators, for comparison in another engine."""

from __future__ import annotations

from knotwork.functions.text import SIDE_PATH, STOPWORDS, TEST_PATH
from knotwork.operators.link import COMMON

# Weights, labels and limits, written out once more so that a wrong one in the operators shows.
FLOW = {"calls": 1.0, "inherits": 1.0, "references": 0.5, "imports": 0.3}
NEARNESS = {"calls": 1.0, "inherits": 0.9, "memory_about": 1.0, "tested_by": 0.7, "documented_by": 0.6, "contains": 0.6, "references": 0.6, "imports": 0.4}
LABELS_OUT = {"calls": "CALLS", "inherits": "INHERITS", "imports": "IMPORTS", "references": "REFERENCES", "tested_by": "TESTED BY", "documented_by": "DOCUMENTED BY", "contains": "CONTAINS"}
LABELS_IN = {"calls": "CALLED BY", "inherits": "SUBCLASSES", "imports": "IMPORTED BY", "references": "REFERENCED BY", "contains": "CONTAINED IN", "memory_about": "MEMORIES"}
ITERATIONS, HITS, RANKED = 40, 40, 60
NODE_FIELDS = {"name": 6.0, "idents": 4.0, "file_path": 1.5, "summary": 2.0, "docstring": 1.0}
NOTE_FIELDS = {"topic": 2.0, "content": 1.0}


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


def _case(column: str, table: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, (int, float)) else repr(v)}" for k, v in table.items()) + f" ELSE {other} END"


def _split(x: str) -> str:
    return rf"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: t != '')"


def _once(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def _idents(*names: str) -> str:
    lists = ", ".join(f"CASE WHEN length(coalesce({n}, '')) > 0 THEN list_concat([lower({n})], {_split(n)}) ELSE [] END" for n in names)
    return f"array_to_string({_once(f'flatten([{lists}])')}, ' ')"


def _terms(x: str) -> str:
    words = f"regexp_extract_all(coalesce({x}, ''), '[A-Za-z][A-Za-z0-9]*')"
    return f"list_distinct(list_filter(flatten(list_transform({words}, lambda w: list_concat([lower(w)], {_split('w')}))), lambda z: length(z) > 1 AND NOT list_contains([{_list(STOPWORDS)}], z)))"


def _sentence(x: str, n: int) -> str:
    flat = rf"trim(regexp_replace(string_split(regexp_replace({x}, '^\s+|\s+$', '', 'g'), chr(10) || chr(10))[1], '\s+', ' ', 'g'))"
    one = f"CASE WHEN regexp_matches({flat}, '[.!?] ') THEN regexp_extract({flat}, '^(.*?[.!?]) ', 1) ELSE {flat} END"
    return f"CASE WHEN length({one}) > {n} THEN rtrim(substr({one}, 1, {n - 1})) || '…' ELSE {one} END"


_PARTS = "string_split(qualname, '.')"
_OWNER = f"CASE WHEN len({_PARTS}) >= 2 THEN {_PARTS}[-2] END"
_CAPITAL = f"coalesce(regexp_matches({_OWNER}, '^\\p{{Lu}}'), false)"
_LABEL = f"CASE WHEN type IN ('method', 'test') AND {_CAPITAL} THEN {_OWNER} || '.' || {_PARTS}[-1] ELSE name END"
_SHORT = f"CASE WHEN type IN ('method', 'test') AND {_OWNER} IS NOT NULL THEN CASE WHEN type = 'method' OR {_CAPITAL} THEN {_OWNER} || '.' || {_PARTS}[-1] ELSE {_PARTS}[-1] END WHEN type = 'documentation' THEN name || ' (' || file_path || ')' WHEN type = 'module' THEN qualname ELSE name END"
_SPAN = "CASE WHEN start_line IS NULL OR end_line IS NULL OR start_line = end_line THEN concat_ws(':', file_path, CAST(start_line AS VARCHAR)) ELSE concat_ws(':', file_path, CAST(start_line AS VARCHAR)) || '-' || end_line END"

N = "n AS (SELECT DISTINCT ON (id) id, node_key AS key, * EXCLUDE (id, node_key) FROM nodes WHERE id IS NOT NULL AND node_key IS NOT NULL)"
E = """e AS (SELECT source_id AS source, target_id AS target, relation, CASE min(CASE WHEN confidence = 'high' THEN 0 WHEN confidence IS NULL THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 2 THEN 'low' END AS confidence
 FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id != target_id AND source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) GROUP BY ALL)"""
NE = f"WITH {N}, {E}"
BOTH = "b AS (SELECT source AS node, target AS other, relation, '→' AS arrow, confidence FROM e UNION ALL SELECT target, source, relation, '←', confidence FROM e)"
_TEST = f"regexp_matches(coalesce({{}}, ''), '{TEST_PATH}')"
_TOKENS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t != '')"


def _questions(questions) -> str:
    rows = ", ".join(f"('{q}', '{t}')" for q, t in questions)
    return f"q(query_id, text) AS (VALUES {rows}), asked AS (SELECT DISTINCT query_id, unnest({_terms('text')}) AS term FROM q)"


def _bm25(docs: str, fields: dict[str, float], name: str = "", k: int = HITS) -> str:
    """CTEs up to hits{name}(query_id, doc, score, rank); docs selects doc and the fields."""
    words = " UNION ALL ".join(f"SELECT doc, unnest({_TOKENS.format(f)}) AS term, {w} AS w FROM d{name}" for f, w in fields.items())
    return f"""d{name} AS ({docs}), w{name} AS ({words}), p{name} AS (SELECT doc, term, sum(w) AS tf, count(*) AS k FROM w{name} GROUP BY ALL), l{name} AS (SELECT doc, sum(k) AS len FROM p{name} GROUP BY doc),
size{name} AS (SELECT (SELECT count(*) FROM d{name}) AS n, (SELECT sum(len) FROM l{name}) / (SELECT count(*) FROM d{name}) AS mean),
f{name} AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM (SELECT term, count(*) AS df FROM p{name} GROUP BY term), size{name}),
s{name} AS (SELECT query_id, p.doc, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM asked JOIN p{name} p USING (term) JOIN f{name} USING (term) JOIN l{name} l ON l.doc = p.doc, size{name} GROUP BY ALL),
hits{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s{name} QUALIFY rank <= {k})"""


def _members(name: str, pairs: str, most: int) -> str:
    """CTE name(owner, names) of pairs(owner, label, w, tie): the most important labels, each once, and how many are left out."""
    return f"""{name}_p AS (SELECT owner, label, max(w) AS w, arg_min(tie, (-w, tie)) AS tie FROM ({pairs}) GROUP BY ALL),
 {name}_r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY w DESC, tie, label) AS k, count(*) OVER (PARTITION BY owner) AS total FROM {name}_p),
 {name} AS (SELECT owner, string_agg(label, ', ' ORDER BY k) || CASE WHEN any_value(total) > {most} THEN ' (+' || (any_value(total) - {most}) || ')' ELSE '' END AS names FROM {name}_r WHERE k <= {most} GROUP BY owner)"""


def _summaries(path: str = "file_path") -> str:
    """CTEs from n on, the last of them summed(key, summary)."""
    down = "SELECT s.key AS owner, l.label, l.w, l.key AS tie FROM pairs p JOIN l ON l.id = p.target JOIN n s ON s.id = p.source WHERE "
    held = "p.relation = 'contains' AND coalesce(l.is_public, false) AND "
    doc = f"nullif({_sentence('docstring', 200)}, '')"
    sig = "coalesce(nullif(signature, ''), name)"
    part = lambda head, t: f"CASE WHEN {t}.names IS NOT NULL THEN '{head}' || {t}.names || '.' END"
    return f"""l AS (SELECT id, key, type, name, is_public, {_LABEL} AS label, coalesce(importance, 0) AS w FROM n), pairs AS (SELECT DISTINCT source, target, relation FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)),
 {_members('defines', down + held + "l.type IN ('class', 'function')", 8)}, {_members('methods', down + held + "l.type IN ('method', 'function', 'test') AND NOT starts_with(l.name, '__')", 8)},
 {_members('called', down + "p.relation = 'calls'", 5)}, {_members('callers', "SELECT t.key AS owner, l.label, l.w, l.key AS tie FROM pairs p JOIN l ON l.id = p.source JOIN n t ON t.id = p.target WHERE p.relation = 'calls'", 4)},
 x AS (SELECT n.key, CASE n.type WHEN 'memory' THEN coalesce(docstring, '') WHEN 'module' THEN concat_ws(' ', 'Module ' || qualname || '.', {doc}, {part('Defines: ', 'defines')})
  WHEN 'class' THEN concat_ws(' ', coalesce(nullif(signature, ''), 'class ' || name) || '.', {doc}, {part('Methods: ', 'methods')}, {part('Used by: ', 'callers')})
  WHEN 'documentation' THEN concat_ws(' ', 'Docs ' || chr(39) || name || chr(39) || ' (' || {path} || ').', CASE WHEN length(docstring) > 0 THEN {_sentence('docstring', 240)} END)
  ELSE CASE WHEN n.type IN ('function', 'method', 'test') THEN concat_ws(' ', CASE WHEN ends_with({sig}, '.') THEN {sig} ELSE {sig} || '.' END, {doc}, {part('Calls: ', 'called')}, {part('Called by: ', 'callers')}) ELSE concat_ws(' ', name, {doc}) END END AS t
  FROM n LEFT JOIN defines ON defines.owner = n.key LEFT JOIN methods ON methods.owner = n.key LEFT JOIN called ON called.owner = n.key LEFT JOIN callers ON callers.owner = n.key),
 summed AS (SELECT key, CASE WHEN length(t) > 300 THEN substr(t, 1, 299) || '…' ELSE t END AS summary FROM x)"""


def _retrieval(asked: str, fold: str, about: str) -> str:
    docs = f"SELECT n.key AS doc, name, {_idents('name', 'qualname')} AS idents, concat_ws('/', repo, file_path) AS file_path, s.summary, coalesce(docstring, '') AS docstring FROM n JOIN summed s ON s.key = n.key"
    notes = "SELECT uid AS doc, topic, content FROM kept"
    near = f"near AS (SELECT node, other, relation || ' ' || arrow AS how, {_case('relation', NEARNESS, '0.3')} AS weight FROM bk JOIN n ON n.key = bk.other QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, coalesce(n.importance, 0) DESC, other, relation, arrow) <= 20)"
    best = "QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY p DESC, hop, via, how) = 1"
    return f"""{NE}, {_summaries("concat_ws('/', repo, file_path)")}, {fold.replace('folded AS', 'folded0 AS')}, folded AS (SELECT * FROM folded0 WHERE content IS NOT NULL), kept AS (SELECT * FROM folded), {about}, {asked},
 {_bm25(docs, NODE_FIELDS, 'h')}, {_bm25(notes, NOTE_FIELDS, 'm', 10)},
 rel AS (SELECT query_id, doc, (1.0::DOUBLE / (20 + rank)) / max(1.0::DOUBLE / (20 + rank)) OVER (PARTITION BY query_id) AS rel FROM hitsh),
 s0 AS (SELECT query_id, doc AS node, rel AS p, 0 AS hop, NULL::VARCHAR AS via, NULL::VARCHAR AS how FROM rel QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc) <= 15),
 ek AS (SELECT a.key AS source, b.key AS target, relation FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target), bk AS (SELECT source AS node, target AS other, relation, '→' AS arrow FROM ek UNION ALL SELECT target, source, relation, '←' FROM ek), {near},
 one_ AS (SELECT * FROM (SELECT * FROM s0 UNION ALL SELECT query_id, other, p * weight, 1, node, near.how FROM s0 JOIN near USING (node)) {best}),
 two_ AS (SELECT * FROM (SELECT * FROM one_ UNION ALL SELECT query_id, other, p * weight * 0.5, 2, node, near.how FROM one_ JOIN near USING (node) WHERE hop = 1) {best}),
 reach AS (SELECT t.* FROM two_ t LEFT JOIN s0 ON s0.query_id = t.query_id AND s0.node = t.node QUALIFY s0.node IS NOT NULL OR row_number() OVER (PARTITION BY t.query_id, s0.node IS NOT NULL ORDER BY t.p DESC, t.node) <= 50),
 said AS (SELECT query_id, doc AS uid, 0.8 * score / CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1 END AS score FROM hitsm),
 boost AS (SELECT query_id, key AS doc, max(score) AS memory, arg_max(s.uid, (score, s.uid)) AS uid FROM said s JOIN about_ a ON a.uid = s.uid GROUP BY ALL),
 placed AS (SELECT coalesce(r.query_id, b.query_id) AS query_id, coalesce(r.node, b.doc) AS key, coalesce(r.p, 0.5 * b.memory) AS p, CASE WHEN r.p IS NULL THEN 'memory_about ← memory ' || b.uid ELSE r.how END AS how, r.via, b.memory FROM reach r FULL JOIN boost b ON b.query_id = r.query_id AND b.doc = r.node),
 z AS (SELECT p.query_id, p.key, coalesce(rel.rel, 0) AS relevance, (0.55 * coalesce(rel.rel, 0) + 0.25 * coalesce(p.p, 0) + 0.10 * coalesce(n.importance, 0) + 0.10 * coalesce(p.memory, 0)) * CASE n.type WHEN 'test' THEN 0.75 WHEN 'file' THEN 0.6 WHEN 'module' THEN 0.9 ELSE 1.0 END
  * CASE WHEN coalesce(n.type, '') IN ('test', 'documentation') THEN 1.0 WHEN {_TEST.format("concat_ws('/', n.repo, n.file_path)")} THEN 0.7 WHEN regexp_matches(concat_ws('/', n.repo, n.file_path), '{SIDE_PATH}') THEN 0.8 ELSE 1.0 END AS score, concat_ws(' ', p.how, coalesce(v.name, p.via)) AS via
  FROM placed p LEFT JOIN rel ON rel.query_id = p.query_id AND rel.doc = p.key JOIN n ON n.key = p.key LEFT JOIN n v ON v.key = p.via WHERE n.type IS NULL OR n.type != 'memory')
 SELECT query_id, key, round(score, 5) AS score, round(relevance, 5) AS relevance, via FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) <= {RANKED}"""


def _pagerank() -> str:
    steps = [f"r0 AS MATERIALIZED (SELECT id AS node, 1.0 / (SELECT count(*) FROM n) AS rank FROM n)"]  # noqa: F541
    for i in range(ITERATIONS):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT r.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(g.got, 0) + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT source FROM t)) / (SELECT count(*) FROM n) AS rank"
            f" FROM r{i} r LEFT JOIN (SELECT target, sum(rank * share) AS got FROM links JOIN r{i} ON node = source GROUP BY target) g ON g.target = r.node)"
        )
    return f"""{NE}, f AS (SELECT source, target, sum({_case('relation', FLOW, 'NULL')}) AS w FROM e WHERE relation IN ({_list(FLOW)}) AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) GROUP BY ALL), t AS MATERIALIZED (SELECT source, sum(w) AS total FROM f GROUP BY source),
links AS MATERIALIZED (SELECT source, target, w / total AS share FROM f JOIN t USING (source)), {", ".join(steps)} SELECT node, round(rank / (SELECT max(rank) FROM r{ITERATIONS}), 7) AS importance FROM r{ITERATIONS}"""


def statements(questions) -> dict[str, str]:
    asked = _questions(questions)
    nodes_docs = f"SELECT id AS doc, name, {_idents('name', 'qualname')} AS idents, file_path, '' AS summary, coalesce(docstring, '') AS docstring FROM n"
    texts = "SELECT doc_id AS doc, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id"
    near = f"near AS (SELECT node, other, {_case('relation', NEARNESS, '0.3')} AS weight FROM b JOIN n ON n.id = b.other QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, coalesce(n.importance, 0) DESC, CAST(other AS VARCHAR), relation, arrow) <= 20)"
    dot = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
    cosine = lambda k: f"c AS (SELECT a.vec_id AS query_id, b.vec_id, {dot} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= {k})"
    fold = """log AS (SELECT * FROM memories WHERE uid IS NOT NULL AND uid != ''),
marks AS (SELECT uid, max(CASE WHEN deleted THEN log_pos END) AS cut, max(log_pos) AS pos FROM log GROUP BY uid),
place AS (SELECT m.uid, m.pos, min(l.log_pos) AS place FROM marks m JOIN log l ON l.uid = m.uid AND coalesce(l.deleted, false) = false AND (m.cut IS NULL OR l.log_pos > m.cut) WHERE m.cut IS NULL OR m.cut < m.pos GROUP BY ALL),
folded AS (SELECT l.*, p.place FROM place p JOIN log l ON l.uid = p.uid AND l.log_pos = p.pos)"""
    costs = "c AS (SELECT repo, doc_id, cost, row_number() OVER (PARTITION BY repo ORDER BY cost DESC, doc_id) AS rank FROM (SELECT DISTINCT ON (doc_id) repo, doc_id, CAST(ceil(length(text) / 3.3) AS BIGINT) AS cost FROM documents WHERE repo IS NOT NULL AND length(text) > 0))"
    users = "u AS (SELECT DISTINCT ON (c.source, k.source) c.source AS node, k.source AS other, k.confidence FROM e c JOIN n ON n.id = c.source AND n.type = 'class' JOIN e k ON k.target = c.target AND k.relation = 'calls' WHERE c.relation = 'contains' AND k.source != c.source AND (c.source, k.source) NOT IN (SELECT (source, target) FROM e WHERE relation = 'contains') ORDER BY c.source, k.source, c.target)"
    keyed = f"{NE}, x AS (SELECT a.repo, a.key AS source_key, b.key AS target_key, e.relation, a.file_path AS from_path, b.file_path AS to_path, b.repo AS to_repo, b.parent_id FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target)"
    linkable = "('module', 'class', 'function', 'method', 'test')"
    modules = "m AS (SELECT repo, file_path, min(key) AS module_key FROM n WHERE type IN ('module', 'file') GROUP BY ALL)"
    about = f"""ln AS (SELECT key, qualname, name, {_PARTS} AS a FROM n WHERE type IN {linkable}),
 named AS (SELECT 0 AS tier, qualname AS s, key, qualname FROM ln UNION ALL SELECT 1, array_to_string(a[i:], '.'), key, qualname FROM (SELECT *, unnest(range(2, len(a))) AS i FROM ln) UNION ALL SELECT 2, name, key, qualname FROM ln),
 best AS (SELECT * FROM named QUALIFY tier = min(tier) OVER (PARTITION BY s)), one AS (SELECT s, arg_min(key, (length(qualname), key)) AS key FROM best GROUP BY s HAVING min(tier) < 2 OR count(*) = 1),
 listed AS (SELECT uid, unnest(symbols) AS s FROM folded), w AS (SELECT uid, unnest(files) AS f, regexp_extract_all(concat_ws(' ', content, topic), '[A-Za-z_][A-Za-z0-9_]{{3,}}') AS words FROM folded),
 here AS (SELECT w.uid, w.f, n.key, n.type IN ('module', 'file') AS whole, list_contains(words, n.name) AS said FROM w JOIN n ON n.file_path = w.f WHERE n.type IS NOT NULL), inside AS (SELECT * FROM here WHERE NOT whole AND said),
 about_ AS (SELECT uid, one.key FROM listed JOIN one USING (s) UNION SELECT uid, key FROM inside UNION SELECT uid, key FROM here h WHERE whole AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.uid = h.uid AND i.f = h.f))"""
    return {
        "file_manifest": r"""SELECT file_id, sha1(content) AS content_hash, CAST(ceil(length(content) / 3.3) AS INTEGER) AS n_tokens, CASE lower(regexp_extract(path, '[^/](\.[^./]*)$', 1)) WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.mdx' THEN 'markdown' END AS language,
 regexp_matches(path, '(^|/)(node_modules|\.git|\.venv|venv|env|__pycache__|dist|build|\.mypy_cache|\.pytest_cache|\.ruff_cache|\.tox|\.next|coverage|site-packages)/|_pb2\.py$|_pb2_grpc\.py$') AS ignored FROM (SELECT DISTINCT ON (file_id) * FROM files WHERE content IS NOT NULL)""",
        "manifest_changes": """WITH a AS (SELECT concat_ws('/', repo, file_path) AS path, min(content_hash) AS h FROM nodes WHERE type IN ('module', 'file') GROUP BY 1), b AS (SELECT concat_ws('/', repo, path) AS path, min(content_hash) AS h FROM files GROUP BY 1)
 SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path""",
        "path_flags": f"""WITH p AS (SELECT DISTINCT file_path, list_filter(string_split(regexp_replace(file_path, '\\.py$', ''), '/'), lambda x: x != '') AS a FROM nodes WHERE file_path IS NOT NULL), o AS (SELECT file_path, CASE WHEN a[-1] = '__init__' THEN a[1:len(a) - 1] ELSE a END AS a FROM p), r AS (SELECT file_path, CASE WHEN len(a) > 1 AND a[1] = 'src' THEN a[2:] ELSE a END AS a FROM o)
 SELECT file_path, {_TEST.format('file_path')} AS is_test, regexp_matches(file_path, '{SIDE_PATH}') AS is_side, CASE WHEN len(a) = 0 THEN '__root__' ELSE array_to_string(a, '.') END AS module FROM r""",
        "identifiers": f"""WITH {N} SELECT id, array_to_string({_split('name')}, ' ') AS parts, {_idents('name', 'qualname')} AS idents, name NOT LIKE '\\_%' ESCAPE '\\' OR (starts_with(name, '__') AND ends_with(name, '__')) AS public_name,
 coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug FROM n""",
        "question_terms": f"SELECT DISTINCT item_id, array_to_string(list_sort({_terms('text')}), ' ') AS terms FROM eval_items",
        "sentences": f"WITH {N} SELECT id, {_sentence('docstring', 60)} AS first, CASE WHEN length(docstring) > 40 THEN substr(docstring, 1, 39) || '…' ELSE docstring END AS cut, CAST(ceil(length(docstring) / 3.3) AS INTEGER) AS n_tokens FROM n WHERE length(docstring) > 0",
        "labels": f"WITH {N} SELECT id, {_SHORT} AS short, {_LABEL} AS label, {_SPAN} AS span FROM n",
        "embedding_texts": rf"""WITH {N}, k AS (SELECT *, coalesce(length(docstring), 0) = 0 AS bare FROM n WHERE type IN ('module', 'class', 'function', 'method', 'documentation', 'memory'))
 SELECT id, sha1(CASE WHEN type = 'documentation' THEN concat_ws(chr(10), 'documentation ' || name, coalesce(file_path, ''), coalesce(docstring, '')) ELSE regexp_replace(concat_ws(chr(10), type || ' ' || qualname, coalesce(file_path, ''), coalesce(signature, ''), coalesce(docstring, '')), '^\s+|\s+$', '', 'g') END) AS text_hash
 FROM k WHERE NOT (starts_with(name, '__') AND ends_with(name, '__') AND type = 'method' AND bare) AND NOT (type IN ('function', 'method') AND NOT coalesce(is_public, true) AND bare AND coalesce(end_line, 0) - coalesce(start_line, 0) < 8)""",
        "find_by_suffix": f"WITH {N}, s AS (SELECT id, type, importance, array_to_string({_PARTS}[-2:], '.') AS suffix FROM n WHERE len({_PARTS}) >= 2) SELECT suffix, count(*) AS n_nodes, arg_min(id, (-coalesce(importance, 0), id)) AS best_id FROM s WHERE suffix IN (SELECT suffix FROM s WHERE type = 'method') GROUP BY suffix",
        "find_symbols": rf"""WITH {N}, asked AS (SELECT DISTINCT trim(s) AS symbol FROM (SELECT unnest(symbols) AS s FROM memories UNION ALL SELECT array_to_string({_PARTS}[-2:], '.') FROM n WHERE type = 'class' UNION ALL SELECT file_path || ':' || start_line FROM n WHERE type = 'method' AND start_line IS NOT NULL) WHERE trim(s) != ''),
 hit AS (SELECT a.symbol, n.id, 0 AS tier, n.end_line - n.start_line AS size FROM (SELECT symbol, regexp_extract(symbol, '^(.+):(\d{{1,9}})$', 1) AS path, TRY_CAST(regexp_extract(symbol, '^(.+):(\d{{1,9}})$', 2) AS INTEGER) AS line FROM asked) a JOIN n ON n.file_path = a.path AND a.line BETWEEN n.start_line AND n.end_line
  UNION ALL SELECT a.symbol, n.id, 1, 0 FROM asked a JOIN n ON n.qualname = a.symbol UNION ALL SELECT a.symbol, n.id, 2, 0 FROM asked a JOIN n ON n.name = a.symbol UNION ALL SELECT a.symbol, n.id, 3, 0 FROM asked a JOIN n ON ends_with(n.qualname, '.' || a.symbol)),
 each_ AS (SELECT symbol, id, min(tier) AS tier, min(size) AS size FROM hit GROUP BY ALL), first AS (SELECT * FROM each_ QUALIFY tier = min(tier) OVER (PARTITION BY symbol))
 SELECT f.symbol, n.key, f.tier, count(*) OVER (PARTITION BY f.symbol) AS n FROM first f JOIN n ON n.id = f.id WHERE coalesce(n.type, '') != 'memory' QUALIFY row_number() OVER (PARTITION BY f.symbol ORDER BY f.size, coalesce(n.type = 'test', false), coalesce(n.type = 'module', false) AND NOT contains(f.symbol, '.'), coalesce(n.importance, 0) DESC, n.key) = 1""",
        "inherited_methods": f"""WITH RECURSIVE {N}, {E}, k AS (SELECT id, coalesce(repo, '') AS repo FROM n WHERE type = 'class'), up AS (SELECT k.repo, e.source AS c, e.target AS b, row_number() OVER (PARTITION BY e.source ORDER BY CAST(e.target AS VARCHAR)) AS place FROM e JOIN k ON k.id = e.source JOIN k kb ON kb.id = e.target WHERE relation = 'inherits'),
 line AS (SELECT repo, id AS c, id AS x, [0] AS path FROM k UNION ALL SELECT l.repo, l.c, up.b, list_append(l.path, CAST(up.place AS INTEGER)) FROM line l JOIN up ON up.c = l.x AND up.repo = l.repo WHERE len(l.path) <= 5),
 child AS (SELECT coalesce(repo, '') AS repo, parent_id AS x, name, id FROM n WHERE type IN {linkable} AND parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY coalesce(repo, ''), parent_id, name ORDER BY start_line DESC NULLS LAST, CAST(id AS VARCHAR) DESC) = 1)
 SELECT l.c AS class_id, h.name, h.id AS method_id FROM line l JOIN child h ON h.repo = l.repo AND h.x = l.x QUALIFY row_number() OVER (PARTITION BY l.c, h.name ORDER BY l.path, CAST(h.id AS VARCHAR)) = 1""",
        "semantic_ranking": f"""WITH {N}, v AS (SELECT n.id, model, min(vector) AS v FROM node_embeddings JOIN n ON n.key = node_key WHERE vector IS NOT NULL AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x != 0)) > 0 GROUP BY ALL), w AS (SELECT id, model, CAST(v AS DOUBLE[]) AS v FROM v),
 near AS (SELECT a.id AS q, b.id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s, row_number() OVER (PARTITION BY a.id ORDER BY s DESC, b.id) AS rank FROM w a JOIN w b ON a.model = b.model AND len(a.v) = len(b.v) WHERE a.id % 50 = 0 QUALIFY rank <= {HITS}),
 beside AS (SELECT DISTINCT a.id AS q, b.id, b.importance FROM w JOIN n a ON a.id = w.id JOIN n b ON b.repo = a.repo AND b.file_path = a.file_path WHERE a.id % 50 = 0), text AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY coalesce(importance, 0) DESC, id) AS rank FROM beside QUALIFY rank <= {HITS}),
 fused AS (SELECT q, id, sum(1.0::DOUBLE / (20 + rank)) AS s FROM (SELECT q, id, rank FROM near UNION ALL SELECT q, id, rank FROM text) GROUP BY ALL), rel AS (SELECT q, id, s / max(s) OVER (PARTITION BY q) AS rel FROM fused),
 sim AS (SELECT q, id, (s - min(s) OVER w) / coalesce(nullif(max(s) OVER w - min(s) OVER w, 0), 1) AS sim FROM near WINDOW w AS (PARTITION BY q)),
 z AS (SELECT r.q, r.id, (0.55 * (0.6 * rel + 0.4 * coalesce(sim, 0)) + 0.25 * rel + 0.10 * coalesce(importance, 0)) * CASE type WHEN 'test' THEN 0.75 WHEN 'file' THEN 0.6 WHEN 'module' THEN 0.9 ELSE 1.0 END
  * CASE WHEN coalesce(type, '') IN ('test', 'documentation') THEN 1.0 WHEN {_TEST.format('file_path')} THEN 0.7 WHEN regexp_matches(coalesce(file_path, ''), '{SIDE_PATH}') THEN 0.8 ELSE 1.0 END AS score FROM rel r LEFT JOIN sim USING (q, id) JOIN n ON n.id = r.id)
 SELECT q AS query_id, id, round(score, 4) AS score FROM z QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= {RANKED}""",
        "note_targets": f"WITH {N}, {fold}, {about} SELECT uid, key FROM about_",
        "node_summaries": f"{NE}, {_summaries()} SELECT key, summary FROM summed",
        "retrieval_plain": _retrieval(asked, fold, about),
        "edges_tidy": f"WITH {E} SELECT * FROM e",
        "adjacency": f"WITH {E}, {BOTH} SELECT node, arrow, relation, count(*) AS n, count(*) FILTER (confidence = 'low') AS n_low FROM b GROUP BY ALL",
        "label_groups": f"""{NE}, {BOTH}, {users}, g AS (SELECT node, other, CASE WHEN arrow = '→' THEN {_case('relation', LABELS_OUT, 'NULL')} ELSE {_case('relation', LABELS_IN, 'NULL')} END AS label, CASE WHEN confidence = 'low' THEN '~' ELSE '' END AS mark FROM b UNION ALL SELECT node, other, 'USED BY (via methods)', CASE WHEN confidence = 'low' THEN '~' ELSE '' END FROM u)
 SELECT node, label, other, mark, row_number() OVER w AS n, greatest(count(*) OVER (PARTITION BY node, label) - 12, 0) AS more FROM g JOIN n ON n.id = g.other WHERE label IS NOT NULL WINDOW w AS (PARTITION BY node, label ORDER BY coalesce(importance, 0) DESC, qualname, other) QUALIFY row_number() OVER w <= 12""",
        "contains_parents": f"WITH {N} SELECT b.id AS source, a.id AS target FROM n a JOIN n b ON b.id = a.parent_id WHERE a.id != b.id",
        "unique_names": f"WITH {N} SELECT coalesce(repo, '') AS repo, name, min(id) AS id FROM n WHERE type IN ('class', 'function', 'method') AND length(name) >= 4 AND name NOT IN ({_list(COMMON)}) AND NOT starts_with(name, '__') GROUP BY 1, 2 HAVING count(*) = 1",
        "pick_candidates": f"""WITH {N}, l AS (SELECT id, coalesce(repo, '') AS repo, type, qualname, file_path, {_PARTS} AS a FROM n WHERE type IN {linkable}), s AS (SELECT repo, id, qualname, file_path, a, unnest(range(1, len(a) + 1)) AS i FROM l),
 names AS (SELECT repo, id, qualname, file_path, a, array_to_string(a[i:], '.') AS of, i = 1 AS exact FROM s WHERE i = 1 OR i < len(a)), best AS (SELECT * FROM names QUALIFY exact = bool_or(exact) OVER (PARTITION BY repo, of)),
 q AS (SELECT id, repo, file_path, array_to_string(a[-2:], '.') AS of FROM l WHERE type = 'method' AND len(a) > 2), mods AS (SELECT coalesce(repo, '') AS repo, file_path, arg_min(CASE WHEN type = 'module' THEN qualname END, CAST(id AS VARCHAR)) AS modname FROM n WHERE type IN ('module', 'file') GROUP BY ALL),
 c AS (SELECT q.id, b.id AS target_id, b.qualname, b.file_path = q.file_path AS here, count(*) OVER (PARTITION BY q.id) AS k, count(*) FILTER (b.file_path = q.file_path) OVER (PARTITION BY q.id) AS k_here, b.a, string_split(coalesce(modname, ''), '.') AS m FROM q JOIN best b ON b.repo = q.repo AND b.of = q.of LEFT JOIN mods ON mods.repo = q.repo AND mods.file_path = q.file_path),
 r AS (SELECT *, k = 1 OR (here AND k_here = 1) AS sure, coalesce(list_position(list_transform(range(1, least(len(a), len(m)) + 1), lambda i: a[i] = m[i]), false) - 1, least(len(a), len(m))) AS shared FROM c)
 SELECT id, target_id, CASE WHEN sure THEN 'high' ELSE 'low' END AS confidence FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY sure DESC, shared DESC, length(qualname), CAST(target_id AS VARCHAR)) = 1""",
        "path_suffixes": f"""WITH {N}, {modules}, s AS (SELECT repo, file_path, module_key, string_split(file_path, '/') AS a FROM m), q AS (SELECT DISTINCT repo, array_to_string(a[-2:], '/') AS asked FROM s WHERE len(a) >= 2),
 h AS (SELECT q.repo, q.asked, s.module_key, s.file_path = q.asked AS exact FROM q JOIN s ON s.repo = q.repo AND (s.file_path = q.asked OR ends_with(s.file_path, '/' || q.asked)))
 SELECT repo, asked, coalesce(min(module_key) FILTER (exact), CASE WHEN count(*) FILTER (NOT exact) = 1 THEN min(module_key) FILTER (NOT exact) END) AS target_key FROM h GROUP BY ALL HAVING target_key IS NOT NULL""",
        "derived_tests": f"""{keyed}, c AS (SELECT * FROM x WHERE relation = 'calls' AND repo = to_repo AND {_TEST.format('from_path')} AND NOT {_TEST.format('to_path')})
 SELECT DISTINCT repo, target_key AS source_key, source_key AS target_key FROM c UNION SELECT c.repo, p.key, c.source_key FROM c JOIN n p ON p.id = c.parent_id AND p.repo = c.repo AND p.type != 'module'""",
        "tests_by_name": rf"""WITH {N}, mo AS (SELECT repo, key, name, file_path FROM n WHERE type = 'module'), p AS (SELECT repo, name AS stem, min(key) AS source_key FROM mo WHERE NOT {_TEST.format('file_path')} GROUP BY ALL HAVING count(*) = 1)
 SELECT t.repo, p.source_key, t.key AS target_key FROM mo t JOIN p ON p.repo = t.repo AND p.stem = regexp_replace(regexp_replace(regexp_replace(string_split(t.file_path, '/')[-1], '\.py$', ''), '^test_', ''), '_test$', '') WHERE {_TEST.format('t.file_path')}""",
        "counts": f"{NE}, c AS (SELECT 'node' AS part, coalesce(type, '') AS name, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', coalesce(relation, ''), count(*) FROM e GROUP BY ALL) SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY part), 4) AS percent FROM c",
        "neighbour_names": f"""{NE}, l AS (SELECT id, {_LABEL} AS label, coalesce(importance, 0) AS w FROM n), p AS (SELECT e.source AS owner, label, max(w) AS w, arg_min(l.id, (-w, l.id)) AS tie FROM e JOIN l ON l.id = e.target WHERE e.relation = 'calls' GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY w DESC, tie, label) AS k, count(*) OVER (PARTITION BY owner) AS total FROM p)
 SELECT owner, string_agg(label, ', ' ORDER BY k) || CASE WHEN any_value(total) > 5 THEN ' (+' || (any_value(total) - 5) || ')' ELSE '' END AS names FROM r WHERE k <= 5 GROUP BY owner""",
        "module_centrality": f"""{NE}, k AS (SELECT e.source, coalesce(n.importance, 0) AS w FROM e JOIN n ON n.id = e.target WHERE e.relation = 'contains' QUALIFY row_number() OVER (PARTITION BY e.source ORDER BY w DESC, e.target) <= 5)
 SELECT n.id AS node, round(coalesce(n.importance, 0) + coalesce((SELECT sum(w) FROM k WHERE k.source = n.id), 0), 9) AS centrality FROM n WHERE type = 'module'""",
        "pagerank": _pagerank(),
        "expand_two_hops": f"""{NE}, {BOTH}, {near}, seed AS (SELECT repo AS query_id, id AS node, 1.0 / row_number() OVER w AS p FROM n WHERE repo IS NOT NULL WINDOW w AS (PARTITION BY repo ORDER BY coalesce(importance, 0) DESC, id) QUALIFY row_number() OVER w <= 3),
 one AS (SELECT query_id, other AS node, max(p * weight) AS p FROM seed JOIN near USING (node) GROUP BY ALL), two AS (SELECT query_id, other AS node, p * weight * 0.5 AS p FROM one JOIN near USING (node))
 SELECT query_id, node, round(max(p), 9) AS proximity FROM (SELECT * FROM seed UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL""",
        "expand_best_first": f"""{NE}, {BOTH}, near AS (SELECT node, other, relation || ' ' || arrow AS how, {_case('relation', NEARNESS, '0.3')} AS weight FROM b JOIN n ON n.id = b.other QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, coalesce(n.importance, 0) DESC, CAST(other AS VARCHAR), relation, arrow) <= 20),
 s AS (SELECT repo AS query_id, id AS node, 1.0::DOUBLE / row_number() OVER w AS p, 0 AS hop, NULL AS via, NULL AS how FROM n WHERE repo IS NOT NULL WINDOW w AS (PARTITION BY repo ORDER BY coalesce(importance, 0) DESC, id) QUALIFY row_number() OVER w <= 3),
 one AS (SELECT * FROM (SELECT * FROM s UNION ALL SELECT query_id, other, p * weight, 1, node, near.how FROM s JOIN near USING (node)) QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY p DESC, hop, CAST(via AS VARCHAR), how) = 1),
 two AS (SELECT * FROM (SELECT * FROM one UNION ALL SELECT query_id, other, p * weight * 0.5, 2, node, near.how FROM one JOIN near USING (node) WHERE hop = 1) QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY p DESC, hop, CAST(via AS VARCHAR), how) = 1),
 r AS (SELECT t.*, s.node IS NOT NULL AS seed, row_number() OVER (PARTITION BY t.query_id, s.node IS NOT NULL ORDER BY t.p DESC, CAST(t.node AS VARCHAR)) AS k FROM two t LEFT JOIN s ON s.query_id = t.query_id AND s.node = t.node)
 SELECT query_id, node, round(p, 9) AS proximity, how, via FROM r WHERE seed OR k <= 50""",
        "bm25_documents": f"WITH {asked}, {_bm25(texts, {'text': 1.0})} SELECT query_id, doc AS doc_id, round(score, 6) AS score FROM hits",
        "bm25_nodes": f"WITH {N}, {asked}, {_bm25(nodes_docs, NODE_FIELDS)} SELECT query_id, doc AS id, round(score, 6) AS score FROM hits",
        "cosine_top": f"WITH {cosine(10)} SELECT query_id, vec_id, round(score, 5) AS score FROM c",
        "cosine_spread": f"WITH {cosine(20)} SELECT query_id, vec_id, round((score - min(score) OVER w) / coalesce(nullif(max(score) OVER w - min(score) OVER w, 0), 1), 4) AS score FROM c WINDOW w AS (PARTITION BY query_id)",
        "fused_search": f"""WITH {asked}, {_bm25(texts, {'text': 1.0}, 'a')}, {_bm25(f"SELECT doc, string_split(text, chr(10))[1] AS text FROM ({texts})", {'text': 1.0}, 'b')},
 t AS (SELECT query_id, doc, sum(1.0 / (20 + rank)) AS s FROM (SELECT query_id, doc, rank FROM hitsa UNION ALL SELECT query_id, doc, rank FROM hitsb) GROUP BY ALL) SELECT query_id, doc AS doc_id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS relevance FROM t""",
        "hybrid_ranking": f"""WITH {N}, {asked}, {_bm25(nodes_docs, NODE_FIELDS)}, t AS (SELECT query_id, doc, (1.0 / (20 + rank)) / max(1.0 / (20 + rank)) OVER (PARTITION BY query_id) AS rel FROM hits),
 z AS (SELECT query_id, doc AS id, (0.55 * rel + 0.25 * rel + 0.10 * coalesce(importance, 0)) * CASE type WHEN 'test' THEN 0.75 WHEN 'file' THEN 0.6 WHEN 'module' THEN 0.9 ELSE 1.0 END
 * CASE WHEN coalesce(type, '') IN ('test', 'documentation') THEN 1.0 WHEN {_TEST.format('file_path')} THEN 0.7 WHEN regexp_matches(coalesce(file_path, ''), '{SIDE_PATH}') THEN 0.8 ELSE 1.0 END AS score FROM t JOIN n ON n.id = t.doc)
 SELECT query_id, id, round(score, 6) AS score FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {RANKED}""",
        "note_log": f"WITH {fold} SELECT uid, log_pos AS pos, place, topic FROM folded",
        "stream_note_log": f"WITH {fold} SELECT uid, log_pos, topic FROM folded",
        "note_stale": f"""WITH {N}, {fold}, h AS (SELECT key, max(content_hash) AS now FROM n GROUP BY key), x AS (SELECT uid, unnest(map_entries(anchors)) AS a FROM folded), bad AS (SELECT uid, bool_or(now IS NULL OR now IS DISTINCT FROM a.value) AS stale FROM x LEFT JOIN h ON h.key = a.key GROUP BY uid)
 SELECT f.uid, coalesce(bad.stale, false) AS stale FROM folded f LEFT JOIN bad ON bad.uid = f.uid""",
        "pack_prefix": f"WITH {costs} SELECT repo, doc_id, CAST(sum(cost) OVER w AS BIGINT) AS used FROM c WINDOW w AS (PARTITION BY repo ORDER BY rank) QUALIFY sum(cost) OVER w <= 3000",
        "pack_first_fit": f"""WITH RECURSIVE {costs}, f AS (SELECT repo, doc_id, rank, CASE WHEN cost <= 3000 THEN cost ELSE 0 END AS used, cost <= 3000 AS kept FROM c WHERE rank = 1
 UNION ALL SELECT c.repo, c.doc_id, c.rank, CASE WHEN f.used + c.cost <= 3000 THEN f.used + c.cost ELSE f.used END, f.used + c.cost <= 3000 FROM f JOIN c ON c.repo = f.repo AND c.rank = f.rank + 1)
 SELECT repo, doc_id, used FROM f WHERE kept""",
    }
