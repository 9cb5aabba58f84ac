"""The queries' results in SQL, where SQL can express them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({WORDS}), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
-- Sources in the order in which they fill up; the level is settled by the first that does not.
f AS (
  SELECT *, coalesce(sum(2.0 * source_size) OVER before, 0) AS filled, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w,
         1.5 * sum(source_size) OVER () AS budget, 2.0 * source_size / w AS full_at
  FROM s WINDOW before AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((budget - filled) / open_w, full_at) AS level FROM f WHERE (budget - filled) / open_w <= full_at),
t AS (
  SELECT source, source_size, least(2.0 * source_size, w * level)::DOUBLE AS target,
         CASE WHEN source_size > 0 THEN least(2, floor(least(2.0 * source_size, w * level) / source_size)) ELSE 0 END::BIGINT AS passes
  FROM f, l),
g AS (
  SELECT d.*, t.source_size, t.target, t.passes, t.target - t.passes * t.source_size AS extra,
         sum(size) OVER (PARTITION BY d.source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, k) AS same
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * least(2, passes + CASE WHEN extra > 0 AND (upto <= extra OR (upto - same <= extra AND upto - extra < extra - (upto - same)))
                                 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM g
"""

_RULES = {
    "few_words": "n_words < 20",
    "repeated": "100 * n_repeat_words > 30 * n_words",
    "symbols": "n_symbols > 0.1::DOUBLE * n_words",
    "dup_lines": "n_dup_lines > 0.3::DOUBLE * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}


def _rate(rule: str) -> str:
    return f"""
  SELECT host, (x + m * strength) / (n + strength) > 0.02 AS bad FROM (
    SELECT host, n, x, m, CASE WHEN v - m * (1 - m) * i > 0 THEN greatest(m * (1 - m) / (v - m * (1 - m) * i) - 1, 1) ELSE mn END AS strength
    FROM (SELECT host, n, {rule} AS x, sum({rule}) OVER () / sum(n) OVER () AS m, var_pop({rule} / n) OVER () AS v,
                 avg(1 / n) OVER () AS i, avg(n) OVER () AS mn FROM h))"""


HOST_RULES = rf"""
WITH r AS (SELECT row_number() OVER () AS id, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT id, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM r),
p AS (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM b WHERE len(words) >= 8),
q AS (SELECT id, i, count(*) OVER (PARTITION BY id, array_to_string(words[i:i + 7], ' ')) AS n FROM p),
c AS (SELECT id, count(DISTINCT i + j) AS n_repeat_words FROM q, range(8) o(j) WHERE n > 1 GROUP BY id),
m AS (
  SELECT b.id, doc_id, host, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM b LEFT JOIN c USING (id)),
h AS (
  SELECT host, count(*)::DOUBLE AS n, {", ".join(f"(count(*) FILTER (WHERE {rule}))::DOUBLE AS {name}" for name, rule in _RULES.items())}
  FROM m GROUP BY host),
{", ".join(f"v_{name} AS ({_rate(name)})" for name in _RULES)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_RULES["few_words"]}) OR ({_RULES["repeated"]}) AS base_failed,
       NOT (({_RULES["few_words"]}) OR ({_RULES["repeated"]})
            OR {" OR ".join(f"(({rule}) AND v_{name}.bad)" for name, rule in _RULES.items())}) AS kept
FROM m {" ".join(f"JOIN v_{name} ON v_{name}.host IS NOT DISTINCT FROM m.host" for name in _RULES)}
"""

TOP_INNER = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER best::INTEGER AS rank, vec_id, score FROM s
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 5
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS n, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key),
g AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone
      FROM k LEFT JOIN s ON s.key = k.key AND s.n >= 5)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY id
"""

AUDIT = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
          'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)} AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (
  SELECT part, good, toxic, concat(CASE WHEN fails.A THEN 'A' END, CASE WHEN fails.B THEN 'B' END, CASE WHEN fails.C THEN 'C' END,
                                   CASE WHEN fails.D THEN 'D' END, CASE WHEN fails.E THEN 'E' END) AS failed, count(*) AS n
  FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL
      SELECT filter_order || c FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
      FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
c AS (
  SELECT part, filter_order, step::INTEGER AS step, f, n, good, toxic, contains(failed, f) AS fails, failed = f AS only_this,
         translate(failed, earlier, '') <> failed AS gone
  FROM s, m),
t AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE only_this), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (WHERE NOT gone AND fails AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (WHERE NOT gone AND fails AND toxic), 0)::BIGINT AS toxic_lost
  FROM c GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM t
"""

ORACLE_SQL = {
    "op11_filter_audit": AUDIT,
    "op1_mix_sources": MIX, "op7_host_rules": HOST_RULES, "op8_top_inner": TOP_INNER,
    "op12_drop_shared_lines": LINES,
}
