"""DuckDB SQL for the training-data queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op2_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k,
  2.0 * source_size / w AS ratio FROM o),
l AS (SELECT *,
  (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT coalesce(min(k) FILTER (WHERE level < ratio), 1e9) AS k, min_by(level, k) FILTER (WHERE level < ratio) AS level FROM l),
t AS (SELECT source, source_size, round(CASE WHEN l.k >= f.k THEN f.level * w ELSE 2.0 * source_size END, 6)::DOUBLE AS target FROM l, f),
g AS (SELECT *, least(floor(target + 0.5), 2 * source_size)::BIGINT AS goal FROM t),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.goal,
    CASE WHEN g.source_size > 0 THEN g.goal // g.source_size ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (whole * size + least(greatest(goal - whole * source_size - before, 0), size))::BIGINT AS taken
FROM p
"""

_CONTROLS = r"(<)(s>|/s>|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>)|(\[)(INST\]|/INST\])"

ORACLES["op9_chat"] = rf"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS r0, role, coalesce(text, '') AS text, 0 AS probe FROM conversations
  UNION ALL SELECT -1, 0, 'user', 'user', '</s>[INST] ok [/INST]', 1
  UNION ALL SELECT -1, 1, 'assistant', 'assistant', '</s>[INST] ok [/INST]', 1),
e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '{_CONTROLS}', '\1\3\\\2\4', 'g')) AS n_text,
    length(replace(regexp_replace(replace(r0, '\', '\\'), '{_CONTROLS}', '\1\3\\\2\4', 'g'), chr(10), '\' || chr(10))) AS n_role
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r0 || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE r0 = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (WHERE r0 = 'assistant'), '')) AS loss_sha256,
  sum(n_text + CASE r0 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 ELSE n_role + 20 END)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(CASE r0 WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'system' THEN 's' ELSE '?' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text), 's?(ua)+') AS valid
FROM e GROUP BY conv_id, probe
"""


def _licenses() -> str:
    from framewright.llm.licenses import BASE, NOTICES, TEMPLATES, THRESHOLD

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in BASE.items())
    templates = ", ".join(f"({sorted(set(t.split()))!r}, '{label}', {notice})" for table, notice in ((TEMPLATES, "false"), (NOTICES, "true")) for label, t in table.items())
    blank = r"\n[\x20\x09\x0B-\x0D]*\n"
    return rf"""
WITH d AS (SELECT doc_id, {low} AS t, regexp_extract_all({low}, '{word}') AS w FROM documents),
p(p, label) AS (VALUES {phrases}),
m(tokens, label, notice) AS (VALUES {templates}),
b AS (
  SELECT doc_id, label, i - 1 AS pos FROM (SELECT doc_id, w, label, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, p WHERE list_has_all(w, p))
  WHERE w[i : i + len(p) - 1] = p),
g AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, string_agg(label || '@' || pos, ',' ORDER BY pos) AS spans FROM b GROUP BY doc_id),
l AS (SELECT DISTINCT doc_id, list_distinct(regexp_extract_all(line, '{word}')) AS ws, false AS paragraph FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  UNION ALL SELECT DISTINCT doc_id, list_distinct(regexp_extract_all(line, '{word}')), true FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '{blank}')) AS line FROM d)),
c AS (SELECT doc_id, label, max(len(list_intersect(ws, tokens)) / len(tokens)) AS c FROM l, m
  WHERE len(ws) >= {THRESHOLD} * len(tokens) AND (notice OR NOT paragraph) GROUP BY ALL),
k AS (SELECT doc_id, list(label) AS labels, max(c) AS c FROM c WHERE c >= {THRESHOLD} - 1e-9 GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(string_split(base_labels, ','), []), coalesce(labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(k.c, 0.0) END::DOUBLE AS score, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


ORACLES["op5_licenses"] = _licenses()

ORACLES["op8_neardup"] = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM d UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(low) FROM r WHERE r.node = d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
