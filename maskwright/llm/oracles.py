"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

from maskwright.llm.mixing import MOST_EPOCHS, WEIGHTS
from maskwright.llm.ownership import KINDS, LEAST_ASSIGNED, PATTERNS, SHARED_BY, SPREAD_OVER

# The first occurrence of a window is the smallest (doc_id, position), as in the operator.
LINE_WINDOWS = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(l) - 1)) AS i, l FROM lines WHERE len(l) >= 3),
keyed AS (
  SELECT doc_id, i, [l[i], l[i + 1], l[i + 2]] AS k FROM win
  WHERE regexp_matches(l[i], '[^ \\t\\n\\v\\f\\r]') OR regexp_matches(l[i + 1], '[^ \\t\\n\\v\\f\\r]')
     OR regexp_matches(l[i + 2], '[^ \\t\\n\\v\\f\\r]')),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM keyed) WHERE n > 1),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM later) GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(d.l) END::BIGINT AS n_lines,
  coalesce(len(g), 0)::BIGINT AS n_removed,
  CASE WHEN g IS NULL THEN d.text ELSE
    coalesce(list_aggregate(list_filter(d.l, lambda x, i: NOT list_contains(g, i)), 'string_agg', chr(10)), '') END AS text
FROM lines d LEFT JOIN gone USING (doc_id)
"""

# One sort of each source by its keys, instead of sums over buckets first.
MIXING = f"""
WITH named AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - (length(text) - length(translate(text, '#*$%&|<>!', '')))::DOUBLE / greatest(length(text), 1)), 0.05::DOUBLE) AS key
  FROM documents),
sized AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM named GROUP BY source),
ranked AS (
  SELECT *, {list(WEIGHTS)}[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)})::INT + 1]::DOUBLE AS w, source_size * {MOST_EPOCHS} AS cap FROM sized),
level AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left, coalesce(sum(cap) OVER before, 0) AS cap_before
  FROM ranked WINDOW before AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
  SELECT *, (total - cap_before)::DOUBLE / w_left AS water FROM level),
aims AS (
  SELECT source, source_size, CASE WHEN water * w >= cap OR final IS NULL THEN cap::DOUBLE ELSE final * w END AS target
  FROM (SELECT *, (min(CASE WHEN water * w < cap THEN {{'c': cap_before, 'water': water}} END) OVER ()).water AS final FROM filled)),
goals AS (
  SELECT *, target - epochs * source_size AS rest FROM (
    SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {MOST_EPOCHS}) ELSE 0 END::BIGINT AS epochs FROM aims)),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM named)
SELECT p.doc_id, p.size, g.source_size, g.target,
  ((g.epochs + CASE WHEN g.rest > 0 AND p.at + p.size / 2 <= g.rest THEN 1 ELSE 0 END) * p.size)::BIGINT AS taken
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source
"""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(kind: int) -> str:
    """Spans of one kind: matches and gaps alternate, so their lengths add up to places."""
    p = _quoted(PATTERNS[KINDS[kind]])
    value = f"regexp_extract(v[i], {p}, 2)" if kind == 0 else "v[i]"
    valid = {0: f"length({value}) >= {LEAST_ASSIGNED}", 3: "regexp_matches(v[i], '[a-z]') AND regexp_matches(v[i], '[A-Z]') AND regexp_matches(v[i], '[0-9]')"}
    return (
        f"SELECT row, source, doc_id, {kind} AS kind, s, s + length(v[i]) AS e, {value} AS secret FROM (SELECT *, "
        "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS s "
        f"FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM (SELECT row, source, doc_id, regexp_extract_all(text, {p}) AS v, regexp_split_to_array(text, {p}) AS g "
        f"FROM docs WHERE regexp_matches(text, {p})))) WHERE {valid.get(kind, 'true')}"
    )


_LISTED = "coalesce(string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind, e){only}, '')"
OWNERSHIP = f"""
WITH docs AS (
  SELECT *, row_number() OVER () AS row FROM documents),
found AS ({' UNION ALL '.join(_spans(k) for k in range(len(KINDS)))}),
owned AS (
  SELECT secret, count(DISTINCT coalesce(source, chr(0))) AS n_owners, count(DISTINCT {{'s': source, 'd': doc_id}}) AS n_repositories FROM found GROUP BY secret),
known AS (
  SELECT f.*, {KINDS}[kind + 1] AS name, n_owners, n_repositories, n_owners < {SHARED_BY} AND n_repositories < {SPREAD_OVER} AS live
  FROM found f JOIN owned o USING (secret) WHERE kind < 3 OR (n_owners < {SHARED_BY} AND n_repositories < {SPREAD_OVER}))
SELECT any_value(d.doc_id) AS doc_id, {', '.join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(KINDS[:3]))},
  sha256({_LISTED.format(only=' FILTER (WHERE kind < 3)')}) AS base_sha256, {_LISTED.format(only=' FILTER (WHERE kind IS NOT NULL)')} AS spans,
  count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied,
  coalesce(max(n_owners), 0)::BIGINT AS most_owners, coalesce(max(n_repositories), 0)::BIGINT AS most_repositories
FROM docs d LEFT JOIN known k ON k.row = d.row GROUP BY d.row
"""


# Equal sets are compared once; then all pairs that share a shingle, and what is reached over the links.
NEAR_COPIES = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) < 2 THEN coalesce(w, []) ELSE
    list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words),
nodes AS (
  SELECT s, len(s) AS n, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (
  SELECT node, n, unnest(s) AS x FROM nodes),
links AS (
  SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.x = b.x AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a),
named AS (
  SELECT a AS node, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id,
  coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN named m ON m.node = n.node
"""

# Every group against every kept term of its language.
DIVERGENCE = """
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
terms AS (
  SELECT row, lang, source, unnest(w) AS term FROM docs),
kept AS (
  SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT DISTINCT lang, source FROM docs),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
  SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
own AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM dense),
langs AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM whole),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
valued AS (
  SELECT lang, source, part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN summed USING (lang, source, item)
  UNION ALL SELECT o.lang, o.source, 'term', o.term, (p - q) * (p - q) // q FROM own o JOIN langs USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM valued)
WHERE part = 'pair' OR rank <= 200
"""
