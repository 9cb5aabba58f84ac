"""The named queries in SQL for DuckDB, written independently of the Spark plans.

Windows over raw rows, weighted sums and list folds for the averages, joins of
all pairs: plain statements of what the result is, for checking on small data.
"""

from __future__ import annotations

OPEN = "DATE '9999-12-31'"
LINE_DESC = (
    "l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, "
    "l_quantity DESC, l_discount DESC, l_tax DESC"
)
# White space as the sentence splitter understands it.
WS = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

REQUESTS = """
requests AS (
  SELECT 'S' || s_suppkey AS ticker, as_of FROM supplier,
    (VALUES (DATE '1997-06-30'), (DATE '1999-03-01'), (DATE '2001-06-30')) v(as_of))"""

COMPANY = """
company AS (
  SELECT 'S' || s_suppkey AS ticker, s_name AS name, n_name AS sector, r_name AS exchange
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

PRICE_LOG = """
price_log AS (
  SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS trade_date,
    CAST(l_extendedprice AS DECIMAL(18,4)) AS close,
    CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS high,
    CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS low,
    CAST(l_quantity AS BIGINT) AS volume,
    CAST(l_shipdate AS DATE) + CAST(30 * (l_linenumber - 1) AS INTEGER) AS observed_on,
    lineitem.*
  FROM lineitem)"""

FACT_LOG = """
fact_log AS (
  SELECT 'S' || l_suppkey AS ticker,
    CASE l_returnflag WHEN 'A' THEN 'revenue' WHEN 'N' THEN 'net_income' ELSE 'eps' END AS metric,
    CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period_start,
    CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
    CAST(l_extendedprice AS DECIMAL(28,4)) AS value, 'USD' AS currency, 'order ' || l_orderkey AS source,
    period_end + 45 + CAST(CAST(l_shipdate AS DATE) - period_start AS INTEGER) AS observed_on,
    lineitem.*
  FROM lineitem)"""

PRICE_KEYS, FACT_KEYS = "ticker, trade_date", "ticker, metric, period_end"


def _versions(name: str, log: str, keys: str, value: str, first: str, where: str = "TRUE") -> str:
    return f"""
{name}_daily AS (
  SELECT * FROM {log} WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY {keys}, observed_on ORDER BY {LINE_DESC}) = 1),
{name}_marked AS (
  SELECT *, lag(observed_on) OVER w IS NULL AS is_first, lag({value}) OVER w AS value_before
  FROM {name}_daily WINDOW w AS (PARTITION BY {keys} ORDER BY observed_on)),
{name}_kept AS (
  SELECT *, CASE WHEN is_first THEN {first} ELSE greatest(observed_on, {first}) END AS known_from
  FROM {name}_marked WHERE is_first OR value_before IS DISTINCT FROM {value}),
{name} AS (
  SELECT *, coalesce(lead(known_from) OVER (PARTITION BY {keys} ORDER BY observed_on), {OPEN}) AS known_until
  FROM {name}_kept)"""


PRICE_BAR = PRICE_LOG + "," + _versions("price_bar", "price_log", PRICE_KEYS, "close", "trade_date")
FACTS = FACT_LOG + "," + _versions("fact", "fact_log", FACT_KEYS, "value", "period_end + 45")

TRIMMED = f"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"
SENTENCES = (
    f"array_to_string(list_slice(string_split(regexp_replace({TRIMMED}, '([.!?]){WS}+', "
    f"'\\1' || chr(57344), 'g'), chr(57344)), 1, 2), ' ')"
)
PUBLISHED = "DATE '1999-01-01' + CAST((doc_id * 7) % 365 AS INTEGER)"
DOC_TICKER = "'S' || (doc_id % (SELECT count(*) FROM supplier))"

NEWS = f"""
news_item AS (
  SELECT {DOC_TICKER} AS ticker, split_part(text, chr(10), 1) AS headline, source,
    {PUBLISHED} AS published_at, 'doc:' || doc_id AS url, {SENTENCES} AS summary
  FROM documents)"""

NEWS_TOP = """
news_top AS (
  SELECT r.ticker, r.as_of, n.* EXCLUDE (ticker),
    row_number() OVER (PARTITION BY r.ticker, r.as_of ORDER BY published_at DESC, headline, source, url) AS position
  FROM requests r JOIN news_item n ON n.ticker = r.ticker AND n.published_at <= r.as_of
  QUALIFY position <= 8)"""

# The date text of a feed entry, and the date that is read from a text: its first ten characters, if they are one.
PUB_DATE = f"""
CASE WHEN doc_id % 50 = 49 THEN ['soon', '1999-02-30T10:00:00Z', '', NULL, '1999/03/01', '1999-03-01', '31.12.1998',
    '1999-04-05 noon'][(doc_id // 50) % 8 + 1]
  ELSE CAST({PUBLISHED} AS VARCHAR) || 'T23:30:00-05:00' END"""
READ_DATE = """
CASE WHEN regexp_full_match(left(pub_date, 10), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(left(pub_date, 10) AS DATE) END"""

FEED = f"""
feed AS (
  SELECT {DOC_TICKER} AS ticker, doc_id AS feed_pos, {READ_DATE.replace("pub_date", f"({PUB_DATE})")} AS published_at,
    split_part(text, chr(10), 1) AS headline,
    CASE WHEN doc_id % 3 <> 0 THEN source ELSE 'Yahoo Finance' END AS source,
    CASE WHEN doc_id % 4 <> 0 THEN 'doc:' || doc_id ELSE '' END AS url,
    {SENTENCES} AS summary, lang
  FROM documents)"""

NEW_ITEMS = """
new_items AS (
  SELECT f.* FROM (
    SELECT * FROM feed WHERE published_at <= DATE '1999-09-30'
    QUALIFY row_number() OVER (PARTITION BY ticker, headline, published_at ORDER BY feed_pos) = 1) f
  WHERE NOT EXISTS (
    SELECT 1 FROM feed s WHERE s.lang = 'en' AND s.published_at IS NOT NULL
      AND s.ticker = f.ticker AND s.headline = f.headline AND s.published_at = f.published_at)
  QUALIFY row_number() OVER (PARTITION BY f.ticker ORDER BY f.feed_pos) <= 8)"""

RUN = """
run AS (
  SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id, 'S' || ((conv_id // 2) % 10) AS ticker,
    DATE '1999-03-01' + CAST(conv_id // 20 AS INTEGER) AS as_of_date,
    CASE WHEN conv_id % 2 = 0 THEN 'baseline' ELSE 'multi_agent' END AS mode,
    CASE WHEN conv_id % 7 = 6 THEN 'failed' ELSE 'completed' END AS status
  FROM conversations)"""

MESSAGE = """
agent_message AS (
  SELECT CAST(conv_id AS VARCHAR) AS run_id, role AS agent_name, 'derived' AS model,
    CAST((turn // 2) % 3 + 1 AS INTEGER) AS attempt,
    CASE WHEN role IN ('user', 'system') THEN length(text) END AS prompt_tokens,
    CASE WHEN role = 'assistant' THEN length(text) END AS completion_tokens,
    CAST(length(text) / 1000.0 AS DECIMAL(8,3)) AS latency_s,
    text AS payload, (conv_id + turn) % 5 <> 0 AS success,
    make_timestamp((1700000000 + (conv_id * 1000 + turn) * 60) * 1000000) AS created_at
  FROM conversations)"""

VERDICT = """
verdict AS (
  SELECT CAST(conv_id AS VARCHAR) AS run_id,
    CASE conv_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'hold' ELSE 'sell' END AS recommendation,
    max(text) AS reasoning, min(text) AS strongest_counterpoint,
    CASE conv_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence
  FROM conversations WHERE conv_id % 7 <> 6 GROUP BY conv_id)"""

METRICS = RUN + "," + MESSAGE + "," + VERDICT + """,
spent AS (
  SELECT run_id, count(*) AS calls, list_sum(list(coalesce(prompt_tokens, 0))) AS asked,
    list_sum(list(coalesce(completion_tokens, 0))) AS answered, sum(latency_s) AS waited
  FROM agent_message GROUP BY run_id),
metrics AS (
  SELECT id, ticker, as_of_date, mode, recommendation, confidence,
    coalesce(asked, 0)::BIGINT AS total_prompt_tokens, coalesce(answered, 0)::BIGINT AS total_completion_tokens,
    coalesce(waited, 0)::DECIMAL(18,3) AS total_latency_s, coalesce(calls, 0) AS message_count
  FROM (SELECT * FROM run WHERE status = 'completed') JOIN verdict ON run_id = id
    LEFT JOIN spent ON spent.run_id = id)"""

# Both modes of a ticker and date as lists, every entry of one against every entry of the other.
PAIRS = METRICS + """,
sides AS (
  SELECT ticker, as_of_date, list(x) FILTER (mode = 'baseline') AS base, list(x) FILTER (mode = 'multi_agent') AS multi
  FROM (SELECT ticker, as_of_date, mode, {'rec': recommendation, 'conf': confidence, 'waited': total_latency_s,
      'tokens': total_prompt_tokens + total_completion_tokens, 'calls': message_count} AS x FROM metrics)
  GROUP BY ticker, as_of_date),
half AS (SELECT ticker, as_of_date, unnest(base) AS b, multi FROM sides),
whole AS (SELECT ticker, as_of_date, b, unnest(multi) AS m FROM half),
pairs AS (
  SELECT ticker, as_of_date, b.rec AS bl_rec, b.conf AS bl_conf, b.tokens AS bl_tokens, b.waited AS bl_latency,
    m.rec AS ma_rec, m.conf AS ma_conf, m.tokens AS ma_tokens, m.waited AS ma_latency, m.calls AS ma_messages,
    b.rec = m.rec AS agreement
  FROM whole)"""

IN_VIEW = """r.ticker = b.ticker AND b.trade_date <= r.as_of
    AND b.known_from <= r.as_of AND b.known_until > r.as_of"""


def _bars(days: int, name: str = "bars") -> str:
    return f"""
{name} AS (
  SELECT r.ticker, r.as_of, b.trade_date, CAST(b.close AS DOUBLE) AS c,
    row_number() OVER (PARTITION BY r.ticker, r.as_of ORDER BY b.trade_date) AS rn,
    count(*) OVER (PARTITION BY r.ticker, r.as_of) AS n
  FROM requests r JOIN price_bar b ON {IN_VIEW} AND b.trade_date > r.as_of - {days}),
{name}_chg AS (
  SELECT *, c - lag(c) OVER (PARTITION BY ticker, as_of ORDER BY rn) AS d FROM {name})"""


# Averages of gains and losses as weighted sums: each later move weighs 1/14 and fades by 13/14 a bar,
# the moves before it share one weight between them.
_FADE = "pow(13.0::DOUBLE / 14, n - greatest(rn, {first}))"


def _averages(name: str, first: int, share: str) -> str:
    """``up`` and ``down`` per request with at least 14 moves; moves up to row ``first`` weigh ``share``."""
    weight = f"{_FADE.format(first=first)} * CASE WHEN rn <= {first} THEN {share} ELSE 1.0::DOUBLE / 14 END"
    return f"""
{name} AS (
  SELECT ticker, as_of, sum(greatest(d, 0.0::DOUBLE) * {weight}) AS up, sum(greatest(-d, 0.0::DOUBLE) * {weight}) AS down
  FROM bars_chg WHERE rn > 1 AND n > 14 GROUP BY ticker, as_of)"""


# The three exponential averages as one fold over a request's closes.
_FAST, _SLOW = "(a.f * 11 / 13 + x.f * 2 / 13)", "(a.s * 25 / 27 + x.s * 2 / 27)"
INDICATORS = _bars(365) + "," + _averages("moves", 15, "1.0::DOUBLE / 14") + f""",
folded AS (
  SELECT ticker, as_of, count(*) AS n, list_reduce(
    list({{'f': c, 's': c, 'sig': 0.0::DOUBLE}} ORDER BY rn),
    lambda a, x: {{'f': {_FAST}, 's': {_SLOW}, 'sig': a.sig * 0.8::DOUBLE + ({_FAST} - {_SLOW}) * 0.2::DOUBLE}}) AS e
  FROM bars GROUP BY ticker, as_of),
indicator AS (
  SELECT q.ticker, q.as_of, coalesce(n, 0) AS n_bars,
    round((CASE WHEN down = 0 THEN 100 WHEN up = 0 THEN 0 ELSE 100 * up / (up + down) END)::DOUBLE, 2) + 0.0 AS rsi_14,
    e.f AS raw_fast, e.s AS raw_slow, e.sig AS raw_signal,
    CASE WHEN n >= 15 THEN round(e.f - e.s, 4) + 0.0 END AS macd,
    CASE WHEN n >= 15 THEN round(e.sig, 4) + 0.0 END AS macd_signal,
    CASE WHEN n >= 15 THEN round(e.f - e.s - e.sig, 4) + 0.0 END AS macd_histogram
  FROM requests q LEFT JOIN folded USING (ticker, as_of) LEFT JOIN moves USING (ticker, as_of))"""


def _pct(n: int) -> str:
    return f"round((max(c) FILTER (rn = n) / max(c) FILTER (rn = n - {n}) - 1) * 100, 2) + 0.0 AS pct_change_{n}d"


SNAPSHOT = _bars(180, "recent") + f""",
snapshot AS (
  SELECT q.ticker, q.as_of, count(b.rn) AS n_bars, round(max(c) FILTER (rn = n), 2) AS last_close,
    {_pct(1)}, {_pct(5)}, {_pct(21)}
  FROM requests q LEFT JOIN recent b ON b.ticker = q.ticker AND b.as_of = q.as_of
  GROUP BY q.ticker, q.as_of)"""

PANEL = ",".join([REQUESTS, PRICE_BAR, NEWS, NEWS_TOP, INDICATORS, SNAPSHOT]) + """,
news_list AS (
  SELECT ticker, as_of, count(*) AS n_news,
    string_agg(published_at || ' ' || headline, ' | ' ORDER BY position) AS headlines,
    string_agg('  [' || published_at || '] (' || coalesce(nullif(source, ''), 'Unknown') || ') '
      || headline || ' — ' || summary, chr(10) ORDER BY position) AS lines,
    list({'date': CAST(published_at AS VARCHAR), 'headline': headline, 'summary': summary} ORDER BY position) AS items
  FROM news_top GROUP BY ALL),
panel AS (
  SELECT s.*, i.rsi_14, i.macd, i.macd_signal, i.macd_histogram, n.n_news, n.headlines, n.lines, n.items
  FROM snapshot s JOIN indicator i ON i.ticker = s.ticker AND i.as_of = s.as_of
    LEFT JOIN news_list n ON n.ticker = s.ticker AND n.as_of = s.as_of)"""

QUARTERLY = """
quarterly AS (
  SELECT 'S' || l_suppkey AS ticker,
    CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
    sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'A') AS revenue,
    sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'N') AS net_income,
    sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'R') AS eps
  FROM lineitem GROUP BY ALL),
figures AS (
  UNPIVOT (SELECT ticker, period_end, CAST(revenue AS DOUBLE) AS revenue, CAST(net_income AS DOUBLE) AS net_income,
      CAST(eps AS DOUBLE) AS eps FROM quarterly)
  ON revenue, net_income, eps INTO NAME metric VALUE value)"""


def _applied(log: str, keys: str, value: str, first: str, batch: str | None = None, to: str = "applied") -> str:
    """State from line numbers up to 4, batch from the others, or as given."""
    state = _versions(f"{to}_state", log, keys, value, first, "l_linenumber <= 4")
    on = " AND ".join(f"o.{k} = b.{k}" for k in keys.split(", "))
    batch = batch or f"""SELECT * FROM {log} WHERE l_linenumber > 4
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {LINE_DESC}) = 1"""
    return state + f""",
{to}_batch AS ({batch}),
{to}_met AS (
  SELECT o, b, o.ticker IS NOT NULL AS has_old, b.ticker IS NOT NULL AS has_new,
    o.{value} IS DISTINCT FROM b.{value} AS differs
  FROM (SELECT * FROM {to}_state WHERE known_until = {OPEN}) o FULL JOIN {to}_batch b ON {on}),
{to} AS (
  SELECT *, 'untouched' AS action FROM {to}_state WHERE known_until <> {OPEN}
  UNION ALL BY NAME
  SELECT unnest(o), CASE WHEN NOT has_new THEN 'untouched' ELSE 'unchanged' END AS action
  FROM {to}_met WHERE has_old AND (NOT has_new OR NOT differs)
  UNION ALL BY NAME
  SELECT * REPLACE (greatest(DATE '2002-06-30', known_from) AS known_until), 'closed' AS action
  FROM (SELECT unnest(o) FROM {to}_met WHERE has_old AND has_new AND differs)
  UNION ALL BY NAME
  SELECT *, {OPEN} AS known_until, 'opened' AS action FROM (
    SELECT unnest(b), greatest(DATE '2002-06-30', o.known_from) AS known_from
    FROM {to}_met WHERE has_old AND has_new AND differs)
  UNION ALL BY NAME
  SELECT *, {first} AS known_from, {OPEN} AS known_until, 'opened' AS action
  FROM (SELECT unnest(b) FROM {to}_met WHERE NOT has_old))"""


def _text(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)


def _double(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


PRICE_COLUMNS = (
    "ticker, " + _text("trade_date") + ", CAST(close AS DOUBLE) AS open, " + _double("high", "low", "close")
    + ", volume, CAST(close AS DOUBLE) AS adj_close, " + _text("known_from", "known_until")
)
PRICE_ROW = PRICE_COLUMNS
# The version table keeps the measures in this order and the compared price last.
FACT_ROW = (
    "ticker, metric, " + _text("period_end", "period_start") + ", " + _double("value")
    + ", currency, source, " + _text("known_from", "known_until")
)


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


FACTS_SEEN = """
seen AS (
  SELECT r.as_of, f.* FROM fact f JOIN requests r ON r.ticker = f.ticker
  WHERE f.period_end <= r.as_of AND f.known_from <= r.as_of AND f.known_until > r.as_of)"""

LEAKS = ",".join([REQUESTS, FACTS, FACTS_SEEN]) + f""",
newest AS (
  SELECT * FROM fact QUALIFY row_number() OVER (PARTITION BY {FACT_KEYS} ORDER BY known_from DESC, known_until DESC) = 1),
leaks AS (
  SELECT r.ticker, r.as_of, n.metric, n.period_end,
    n.value AS naive_value, n.known_from AS naive_known_from, n.source AS naive_source,
    s.value AS asof_value, s.known_from AS asof_known_from, s.source AS asof_source,
    n.value IS DISTINCT FROM s.value AS leaked, greatest(n.known_from - r.as_of, 0) AS days_ahead
  FROM requests r JOIN newest n ON n.ticker = r.ticker AND n.period_end <= r.as_of
    LEFT JOIN seen s ON s.ticker = r.ticker AND s.as_of = r.as_of AND s.metric = n.metric AND s.period_end = n.period_end)"""

STORED = ",".join([REQUESTS, PRICE_BAR]) + """,
stored AS (
  SELECT r.ticker, r.as_of, count(b.ticker) AS n_rows
  FROM requests r LEFT JOIN price_bar b ON b.ticker = r.ticker AND b.trade_date <= r.as_of GROUP BY ALL)"""

STATUS = RUN + """,
ended AS (
  SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY ALL),
statuses AS (
  SELECT r.id, r.ticker, r.as_of_date, r.mode,
    CASE WHEN e.conv_id IS NULL THEN 'running' WHEN e.conv_id % 11 = 10 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN e.conv_id % 11 <> 10 THEN
      make_timestamp((1700000000 + e.conv_id * 60000 + e.turn * 60) * 1000000) END AS completed_at
  FROM run r LEFT JOIN ended e ON CAST(e.conv_id AS VARCHAR) = r.id AND e.role = 'assistant')"""

ESCAPED = r"replace(replace(replace(replace(x, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"
QUOTED = (
    "CASE WHEN contains(x, '''') AND NOT contains(x, '\"') THEN '\"' || " + ESCAPED + " || '\"' "
    "ELSE '''' || replace(" + ESCAPED + ", '''', '\\''') || '''' END"
)
ARGUMENTS = f"""
argument AS (
  SELECT CAST(conv_id AS VARCHAR) AS run_id, CAST(turn // 2 + 1 AS BIGINT) AS round,
    CASE WHEN role = 'user' THEN 'bull' ELSE 'bear' END AS stance,
    string_split(text, chr(10)) AS claims,
    CASE WHEN turn > 0 THEN [string_split(text, chr(10))[-1]] ELSE CAST([] AS VARCHAR[]) END AS rebuttal_to
  FROM conversations WHERE role <> 'system'),
debate AS (
  SELECT run_id, round, CASE stance WHEN 'bull' THEN 1 ELSE 2 END AS speaker,
    'Round ' || round || ' ' || upper(stance)
    || ': Claims: [' || array_to_string(list_transform(claims, lambda x: {QUOTED}), ', ')
    || ']. Rebuttals: [' || array_to_string(list_transform(rebuttal_to, lambda x: {QUOTED}), ', ') || ']' AS line
  FROM argument)"""


REPORTS = f"""
report AS (
  SELECT CAST(conv_id AS VARCHAR) AS run_id,
    'Key Points: [' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: {QUOTED}), ', ') || ']' || chr(10)
    || 'Prices: {{''last_close'': ' || CAST(length(text) / 4.0::DOUBLE AS VARCHAR)
    || ', ''pct_change_1d'': ' || CAST(0.0 - conv_id / 8.0::DOUBLE AS VARCHAR) || '}}' || chr(10)
    || 'Indicators: {{''rsi_14'': ' || CAST(conv_id + 0.25::DOUBLE AS VARCHAR) || '}}' || chr(10)
    || 'News: [' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: {QUOTED}), ', ') || ']' || chr(10)
    AS report_text
  FROM conversations WHERE turn = 0),
sound AS (
  SELECT *, CASE WHEN run_id::BIGINT % 10 = 9 THEN 'no report'
    WHEN run_id::BIGINT % 9 = 8 THEN 'not valid JSON for the schema' END AS problem
  FROM report)"""


def _json_numbers(*columns: str) -> str:
    return "'{' || " + " || ', ' || ".join(f"'\"{c}\": ' || coalesce({c}::VARCHAR, 'null')" for c in columns) + " || '}'"


def _json_text(x: str) -> str:
    """Character by character: quotes and backslashes escaped, all but printable ASCII as code units."""
    high, low = "55296 + ((u - 65536) // 1024)", "56320 + (u - 65536) % 1024"
    letter = (
        "CASE WHEN c IN ('\"', '\\') THEN '\\' || c WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t' "
        "WHEN c = chr(12) THEN '\\f' WHEN c = chr(8) THEN '\\b' WHEN unicode(c) BETWEEN 32 AND 126 THEN c "
        "WHEN unicode(c) < 65536 THEN '\\u' || format('{:04x}', unicode(c)) "
        f"ELSE '\\u' || format('{{:04x}}', {high}) || '\\u' || format('{{:04x}}', {low}) END"
    ).replace("(u - ", "(unicode(c) - ")
    return f"coalesce('\"' || array_to_string(list_transform(string_split({x}, ''), lambda c: {letter}), '') || '\"', 'null')"


def _rule(table: str, rule: str, count: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(({count}) AS BIGINT) AS violations"


def _key_rule(table: str, keys: str) -> str:
    return _rule(table, f"primary key ({keys})", f"SELECT (SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {table}))")


def _parent_rule(table: str, key: str, parent: str, parent_key: str) -> str:
    return _rule(table, f"{key} references {parent}",
                 f"SELECT count(*) FROM {table} WHERE {key} NOT IN (SELECT {parent_key} FROM {parent})")


def _null_rules(table: str, columns: str) -> list[str]:
    return [_rule(table, f"{c} not null", f"SELECT count(*) FROM {table} WHERE {c} IS NULL") for c in columns.split()]


def _value_rule(table: str, column: str, values: str) -> str:
    quoted = ", ".join(f"'{v}'" for v in values.split(", "))
    return _rule(table, f"{column} in ({values})", f"SELECT count(*) FROM {table} WHERE {column} NOT IN ({quoted})")


_RULES = [
    _key_rule("company", "ticker"), _key_rule("run", "id"), _key_rule("verdict", "run_id"),
    _key_rule("price_bar", "ticker, trade_date, known_from"),
    _key_rule("fundamental_fact", "ticker, metric, period_end, known_from"),
    _key_rule("news_item", "ticker, headline, published_at"),
    _key_rule("lineitem", "l_orderkey, l_linenumber"),
    *[_parent_rule(t, "ticker", "company", "ticker") for t in ("price_bar", "fundamental_fact", "news_item", "run")],
    _parent_rule("agent_message", "run_id", "run", "id"),
    _parent_rule("verdict", "run_id", "run", "id"),
    _parent_rule("agent_message", "run_id", "verdict", "run_id"),
    *_null_rules("company", "name"),
    *_null_rules("price_bar", "ticker trade_date known_from known_until"),
    *_null_rules("fundamental_fact", "ticker metric period_start period_end known_from known_until"),
    *_null_rules("news_item", "ticker headline published_at"),
    *_null_rules("agent_message", "agent_name model attempt prompt_tokens payload success"),
    *_null_rules("verdict", "recommendation reasoning strongest_counterpoint confidence"),
    _value_rule("run", "mode", "baseline, multi_agent"),
    _value_rule("run", "status", "running, completed, failed"),
    _value_rule("verdict", "recommendation", "buy, hold, sell"),
    _value_rule("verdict", "confidence", "low, medium, high"),
    _value_rule("agent_message", "agent_name", "user, assistant"),
]

_FEED_FACTS = QUARTERLY + """,
feed_facts AS (
  SELECT ticker, metric, period_end - 90 AS period_start, period_end, CAST(value AS DECIMAL(28,4)) AS value,
    'USD' AS currency, 'yfinance' AS source
  FROM figures)"""

_FIRST_SEED = _bars(365) + "," + _averages("walk", 2, "1.0::DOUBLE")


ASKED = """
asked AS (
  SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1999-09-30' ELSE DATE '1998-06-30' END AS as_of
  FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 4 = 1)"""

ASKED_ITEMS = """
asked_items AS (
  SELECT f.* FROM (
    SELECT feed.* FROM feed JOIN asked USING (ticker) WHERE published_at <= as_of
    QUALIFY row_number() OVER (PARTITION BY ticker, headline, published_at ORDER BY feed_pos) = 1) f
  WHERE NOT EXISTS (
    SELECT 1 FROM feed s WHERE s.lang = 'en' AND s.published_at IS NOT NULL
      AND s.ticker = f.ticker AND s.headline = f.headline AND s.published_at = f.published_at)
  QUALIFY row_number() OVER (PARTITION BY f.ticker ORDER BY f.feed_pos) <= 8)"""


def _content(table: str, action: str, source: str, columns: str) -> str:
    """Columns in the order of their names; a semicolon stands for a comma within one."""
    shown = ", ".join(f"coalesce(({c})::VARCHAR, '-')" for c in columns.split(", ")).replace(";", ",")
    return f"SELECT '{table}' AS table_name, {action} AS action, concat_ws('|', {shown}) AS content FROM {source}"


_PANEL_ROWS = _with(REQUESTS, PRICE_BAR, INDICATORS) + f"""
SELECT ticker, {_text('as_of')}, n_bars, rsi_14, macd, macd_signal, macd_histogram FROM indicator"""

ORACLE_SQL: dict[str, str] = {
    "indicators_mapped": _PANEL_ROWS,

    "late_price_delta": _with(
        PRICE_LOG, _versions("old", "price_log", PRICE_KEYS, "close", "trade_date", "l_returnflag <> 'R'"),
        _versions("whole", "price_log", PRICE_KEYS, "close", "trade_date"),
        """
late AS (SELECT DISTINCT ticker, trade_date FROM price_log WHERE l_returnflag = 'R'),
counted AS (
  SELECT ticker, trade_date, close, known_from, known_until, count(*) FILTER (WHERE s = 0) AS n_old, count(*) FILTER (WHERE s = 1) AS n_new
  FROM (SELECT 0 AS s, ticker, trade_date, close, known_from, known_until FROM old
        UNION ALL SELECT 1, ticker, trade_date, close, known_from, known_until FROM whole)
  SEMI JOIN late USING (ticker, trade_date) GROUP BY ALL)""") + f"""
SELECT ticker, {_text('trade_date', 'known_from', 'known_until')}, CAST(close AS DOUBLE) AS close,
  CAST(close AS DOUBLE) AS adj_close, change
FROM counted, unnest(list_concat(CASE WHEN n_old > 0 THEN ['withdrawn'] ELSE [] END, list_transform(range(n_new), lambda x: 'added'))) AS u(change)
WHERE n_old <> n_new""",

    "late_price_versions": _with(PRICE_BAR) + f"""
SELECT ticker, {_text('trade_date', 'known_from', 'known_until')}, CAST(close AS DOUBLE) AS close,
  CAST(close AS DOUBLE) AS adj_close FROM price_bar""",

    "trailing_closes": _with(PRICE_BAR, "requests AS (SELECT DISTINCT ticker, trade_date AS as_of FROM price_log)") + f"""
SELECT r.ticker, CAST(r.as_of AS VARCHAR) AS as_of, count(*) AS n_bars, CAST(min(close) AS DOUBLE) AS lowest,
  CAST(max(close) AS DOUBLE) AS highest, CAST(sum(close) AS DOUBLE) / count(*) AS mean
FROM requests r JOIN price_bar b ON {IN_VIEW} AND b.trade_date > r.as_of - 30
GROUP BY r.ticker, r.as_of""",

    "indicators_panel": _PANEL_ROWS,

    "indicators_early": _with(REQUESTS.replace("(DATE '1997-06-30'), (DATE '1999-03-01'), (DATE '2001-06-30')",
                                               "(DATE '1995-01-20'), (DATE '1995-03-10')"), PRICE_BAR, INDICATORS) + f"""
SELECT ticker, {_text('as_of')}, n_bars, rsi_14, macd, macd_signal, macd_histogram FROM indicator""",

    "price_history": _with(REQUESTS, PRICE_BAR) + f"""
SELECT r.ticker, CAST(r.as_of AS VARCHAR) AS as_of, {_text('trade_date')}, CAST(close AS DOUBLE) AS open,
  {_double('high', 'low', 'close', 'volume')}
FROM requests r JOIN price_bar b ON {IN_VIEW} AND b.trade_date > r.as_of - 180""",

    "stored_price_history": _with(REQUESTS, PRICE_BAR) + f"""
SELECT r.ticker, CAST(r.as_of AS VARCHAR) AS as_of, {_text('trade_date')}, CAST(close AS DOUBLE) AS open,
  {_double('high', 'low', 'close', 'volume')}
FROM requests r JOIN price_bar b ON {IN_VIEW} AND b.trade_date > r.as_of - 180""",
    "stored_facts_as_of": _with(REQUESTS, FACTS, FACTS_SEEN) + f"SELECT {_text('as_of')}, {FACT_ROW} FROM seen",

    "price_snapshot": _with(REQUESTS, PRICE_BAR, SNAPSHOT) + f"""
SELECT ticker, {_text('as_of')}, n_bars, last_close, pct_change_1d, pct_change_5d, pct_change_21d FROM snapshot""",

    "daily_changes": _with(REQUESTS, PRICE_BAR, _bars(180)) + f"""
SELECT ticker, {_text('as_of', 'trade_date')}, rn, c AS close, d AS change FROM bars_chg""",

    "prices_known_on": _with(PRICE_BAR) + f"""
SELECT {PRICE_ROW} FROM price_bar
WHERE known_from <= DATE '1999-03-01' AND known_until > DATE '1999-03-01'""",

    "facts_as_of": _with(REQUESTS, FACTS, FACTS_SEEN) + f"SELECT {_text('as_of')}, {FACT_ROW} FROM seen",
    "facts_of_metric": _with(REQUESTS, FACTS, FACTS_SEEN) + f"""
SELECT {_text('as_of')}, {FACT_ROW} FROM seen WHERE metric = 'net_income'""",
    "facts_exact_period": _with(REQUESTS, FACTS, FACTS_SEEN) + f"""
SELECT {_text('as_of')}, {FACT_ROW} FROM seen WHERE period_end = DATE '1998-12-31'""",
    "facts_naive_latest": _with(FACTS) + f"""
SELECT {FACT_ROW} FROM fact
QUALIFY row_number() OVER (PARTITION BY {FACT_KEYS} ORDER BY known_from DESC, known_until DESC) = 1""",

    "news_top_k": _with(REQUESTS, NEWS, NEWS_TOP) + f"""
SELECT ticker, {_text('as_of')}, position, headline, coalesce(nullif(source, ''), 'Unknown') AS source,
  CAST(published_at AS VARCHAR) AS published, coalesce(summary, '') AS summary FROM news_top""",
    "news_visible": _with(NEWS) + f"""
SELECT ticker, headline, source, {_text('published_at')}, url, summary FROM news_item
WHERE published_at <= DATE '1999-03-01'""",

    "build_versions": _with(PRICE_BAR) + f"SELECT {PRICE_ROW} FROM price_bar",
    "build_fact_versions": _with(FACTS) + f"SELECT {FACT_ROW} FROM fact",
    "open_versions": _with(PRICE_BAR) + f"SELECT {PRICE_ROW} FROM price_bar WHERE known_until = {OPEN}",
    "apply_batch_prices": _with(PRICE_LOG, _applied("price_log", PRICE_KEYS, "close", "trade_date")) + f"""
SELECT {PRICE_ROW}, action FROM applied""",
    "apply_batch_facts": _with(FACT_LOG, _applied("fact_log", FACT_KEYS, "value", "period_end + 45")) + f"""
SELECT {FACT_ROW}, action FROM applied""",
    "batch_action_counts": _with(PRICE_LOG, _applied("price_log", PRICE_KEYS, "close", "trade_date", batch=f"""
  SELECT * FROM price_log QUALIFY row_number() OVER (PARTITION BY {PRICE_KEYS} ORDER BY {LINE_DESC}) = 1""")) + """
SELECT action, count(*) AS n_rows FROM applied GROUP BY action""",
    "version_invariants": _with(PRICE_BAR, FACTS) + f""", broken AS (
  SELECT * REPLACE (CASE WHEN day(trade_date) = 17 THEN {OPEN}
    WHEN day(trade_date) = 13 AND known_until <> {OPEN} THEN known_from - 1 ELSE known_until END AS known_until)
  FROM price_bar)
""" + "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS table_name, rule, CAST(violations AS BIGINT) AS violations FROM (
  SELECT 'reversed_window' AS rule, count(*) AS violations FROM {table} WHERE known_until < known_from
  UNION ALL SELECT 'overlap', count(*) FROM (
    SELECT 1 FROM {table} QUALIFY known_until > known_from AND max(known_until) OVER (
      PARTITION BY {keys} ORDER BY known_from, known_until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > known_from)
  UNION ALL SELECT 'many_open', coalesce(sum(n - 1), 0) FROM (
    SELECT count(*) AS n FROM {table} WHERE known_until = {OPEN} GROUP BY {keys}))"""
        for name, table, keys in (("price_bar", "broken", PRICE_KEYS), ("fundamental_fact", "fact", FACT_KEYS))
    ),
    "reseed_facts": _with(FACTS) + f"""
SELECT {FACT_ROW} FROM fact
QUALIFY metric <> 'eps'
  OR row_number() OVER (PARTITION BY {FACT_KEYS} ORDER BY known_from DESC, known_until DESC) = 1""",

    "ingest_prices_clean": f"""
SELECT 'S' || l_suppkey AS ticker, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS trade_date,
  l_extendedprice AS open, l_extendedprice AS high, l_extendedprice AS low, l_extendedprice AS close,
  CAST(l_quantity AS BIGINT) AS volume, l_extendedprice AS adj_close
FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1999-03-01' - 180 AND DATE '1999-03-01'""",
    "ingest_facts_unpivot": _with(QUARTERLY) + f"""
SELECT ticker, {_text('period_end')}, metric, value FROM figures""",
    "ingest_facts_clean": _with(_FEED_FACTS) + f"""
SELECT ticker, metric, {_text('period_start', 'period_end')}, {_double('value')}, currency, source FROM feed_facts""",
    "ingest_news_dedup": _with(FEED, NEW_ITEMS) + f"""
SELECT ticker, headline, source, {_text('published_at')}, url, summary, feed_pos, '2002-06-30 12:00:00' AS ingested_at
FROM new_items""",
    "landed_news": f"""
SELECT doc_id AS feed_pos, CASE WHEN doc_id % 10 NOT IN (3, 5, 7) THEN {DOC_TICKER} END AS ticker,
  CASE WHEN doc_id % 10 NOT IN (3, 5, 7) THEN string_split(text, chr(10))[1] END AS title,
  CASE WHEN doc_id % 10 IN (5, 7) THEN 'unreadable' WHEN doc_id % 10 = 3 THEN 'missing ticker' ELSE 'accepted' END AS outcome
FROM documents""",
    "news_undated": f"""
SELECT * FROM (SELECT {DOC_TICKER} AS ticker, doc_id AS feed_pos, {PUB_DATE} AS pub_date FROM documents)
WHERE pub_date <> '' AND {READ_DATE} IS NULL""",
    "truncate_sentences": f"SELECT doc_id, {SENTENCES} AS summary FROM documents",
    "company_upsert": _with(COMPANY) + """
SELECT 'S' || s_suppkey AS ticker,
  CASE s_suppkey % 3 WHEN 0 THEN s_name || ' Holding' WHEN 1 THEN s_name ELSE 'S' || s_suppkey END AS name,
  CASE WHEN s_nationkey % 2 = 0 THEN 'RENAMED' END AS sector, 'NEW' AS exchange
FROM supplier WHERE s_acctbal > 0
UNION ALL
SELECT c.* FROM company c JOIN supplier ON ticker = 'S' || s_suppkey WHERE NOT s_acctbal > 0""",
    "ingest_all_counts": _with(
        COMPANY, PRICE_LOG, FACT_LOG, FEED, NEW_ITEMS, _FEED_FACTS,
        _versions("price", "price_log", PRICE_KEYS, "close", "trade_date", "l_linenumber <= 4"),
        _versions("fact", "fact_log", FACT_KEYS, "value", "period_end + 45", "l_linenumber <= 4"),
    ) + f"""
, price_in AS (
  SELECT * FROM price_log WHERE l_linenumber > 4 AND trade_date BETWEEN DATE '1999-09-30' - 180 AND DATE '1999-09-30'
  QUALIFY row_number() OVER (
    PARTITION BY ticker, trade_date ORDER BY close DESC, volume DESC) = 1),
price_met AS (
  SELECT o.ticker IS NOT NULL AS has_old, b.ticker IS NOT NULL AS has_new, o.close IS DISTINCT FROM b.close AS differs
  FROM (SELECT * FROM price WHERE known_until = {OPEN}) o FULL JOIN price_in b USING (ticker, trade_date)),
fact_met AS (
  SELECT o.ticker IS NOT NULL AS has_old, b.ticker IS NOT NULL AS has_new, o.value IS DISTINCT FROM b.value AS differs
  FROM (SELECT * FROM fact WHERE known_until = {OPEN}) o FULL JOIN feed_facts b USING (ticker, metric, period_end)),
counted AS (
  SELECT 'company' AS table_name, 'written' AS action, count(*) AS n_rows FROM company
  UNION ALL SELECT 'news_item', 'written', count(*) FROM new_items
  UNION ALL SELECT 'price_bar', 'untouched', (SELECT count(*) FROM price WHERE known_until <> {OPEN}) + count(*) FILTER (NOT has_new) FROM price_met
  UNION ALL SELECT 'price_bar', 'unchanged', count(*) FROM price_met WHERE has_old AND has_new AND NOT differs
  UNION ALL SELECT 'price_bar', 'closed', count(*) FROM price_met WHERE has_old AND has_new AND differs
  UNION ALL SELECT 'price_bar', 'opened', count(*) FROM price_met WHERE has_new AND (NOT has_old OR differs)
  UNION ALL SELECT 'fundamental_fact', 'untouched', (SELECT count(*) FROM fact WHERE known_until <> {OPEN}) + count(*) FILTER (NOT has_new) FROM fact_met
  UNION ALL SELECT 'fundamental_fact', 'unchanged', count(*) FROM fact_met WHERE has_old AND has_new AND NOT differs
  UNION ALL SELECT 'fundamental_fact', 'closed', count(*) FROM fact_met WHERE has_old AND has_new AND differs
  UNION ALL SELECT 'fundamental_fact', 'opened', count(*) FROM fact_met WHERE has_new AND (NOT has_old OR differs))
SELECT table_name, action, n_rows FROM counted WHERE n_rows > 0""",

    "ingest_all_rows": _with(
        COMPANY, PRICE_LOG, FACT_LOG, FEED, _FEED_FACTS, ASKED, ASKED_ITEMS,
        _applied("price_log", PRICE_KEYS, "close", "trade_date", to="price", batch="""
  SELECT p.* FROM price_log p JOIN asked USING (ticker) WHERE trade_date BETWEEN as_of - 180 AND as_of
  QUALIFY row_number() OVER (PARTITION BY ticker, trade_date ORDER BY close DESC, high DESC, low DESC, volume DESC) = 1"""),
        _applied("fact_log", FACT_KEYS, "value", "period_end + 45", to="fact", batch="""
  SELECT feed_facts.* FROM feed_facts JOIN asked USING (ticker)"""),
    ) + "\n" + "\nUNION ALL\n".join([
        _content("company", "'written'", "company", "exchange, name, sector, ticker"),
        _content("price_bar", "action", "price", "close, close, high, known_from, known_until, low, close, ticker, trade_date, volume"),
        _content("fundamental_fact", "action", "fact", "currency, known_from, known_until, metric, period_end, period_start, source, ticker, value"),
        _content("news_item", "'written'", "asked_items", "headline, '2002-06-30 12:00:00', published_at, source, summary, ticker, url"),
    ]),
    "lookahead_leaks": _with(LEAKS) + f"""
SELECT ticker, {_text('as_of')}, metric, {_text('period_end')}, {_double('naive_value')}, {_text('naive_known_from')},
  naive_source, {_double('asof_value')}, {_text('asof_known_from')}, asof_source, leaked,
  CAST(days_ahead AS BIGINT) AS days_ahead
FROM leaks""",
    "leak_summary": _with(LEAKS) + f"""
SELECT {_text('as_of')}, count(*) AS n_keys, count(*) FILTER (leaked) AS n_leaked,
  CAST(max(days_ahead) FILTER (leaked) AS BIGINT) AS max_days_ahead
FROM leaks GROUP BY leaks.as_of""",
    "asof_bound_check": _with(REQUESTS, PRICE_BAR, NEWS, NEWS_TOP, _bars(180)) + """
, bar_count AS (SELECT ticker, as_of, count(*) AS n, count(*) FILTER (trade_date > as_of) AS late FROM bars GROUP BY ALL),
news_count AS (SELECT ticker, as_of, count(*) AS n, count(*) FILTER (published_at > as_of) AS late FROM news_top GROUP BY ALL)
SELECT r.ticker, CAST(r.as_of AS VARCHAR) AS as_of, coalesce(b.n, 0) AS n_bars, coalesce(b.late, 0) AS n_late_bars,
  coalesce(w.n, 0) AS n_news, coalesce(w.late, 0) AS n_late_news,
  coalesce(b.late, 0) = 0 AND coalesce(w.late, 0) = 0 AND coalesce(w.n, 0) <= 8 AS holds
FROM requests r LEFT JOIN bar_count b USING (ticker, as_of) LEFT JOIN news_count w USING (ticker, as_of)""",
    "constraint_violations": _with(COMPANY, PRICE_BAR, FACTS, NEWS, RUN, MESSAGE, VERDICT)
    + ", fundamental_fact AS (SELECT * FROM fact)\n" + "\nUNION ALL\n".join(_RULES),
    "violations_while_writing": _with(REQUESTS, PRICE_BAR, NEWS, NEWS_TOP, RUN, MESSAGE, VERDICT) + f""",
broken AS (
  SELECT * REPLACE (CASE WHEN day(trade_date) = 17 THEN {OPEN}
    WHEN day(trade_date) = 13 AND known_until <> {OPEN} THEN known_from - 1 ELSE known_until END AS known_until)
  FROM price_bar),
history AS (
  SELECT r.as_of, trade_date FROM requests r JOIN price_bar b ON {IN_VIEW} AND b.trade_date > r.as_of - 180)
""" + "\nUNION ALL\n".join([
        *[f"SELECT '{name}' AS table_name, 'rows' AS rule, count(*) AS violations FROM {table}" for name, table in (
            ("price_bar", "broken"), ("price_history", "history"), ("news_top_k", "news_top"), ("run", "run"),
            ("agent_message", "agent_message"), ("verdict", "verdict"))],
        "SELECT 'price_bar', 'known_from up to known_until', count(*) FROM broken WHERE known_from > known_until",
        "SELECT 'price_history', 'trade_date up to as_of', count(*) FROM history WHERE trade_date > as_of",
        "SELECT 'news_top_k', 'published up to as_of', count(*) FROM news_top WHERE published_at > as_of",
        *_null_rules("price_bar", "ticker trade_date known_from"),
        *_null_rules("agent_message", "agent_name prompt_tokens payload"),
        *_null_rules("verdict", "reasoning"),
        _value_rule("run", "mode", "baseline, multi_agent"),
        _value_rule("run", "status", "running, completed, failed"),
        _value_rule("verdict", "recommendation", "buy, hold, sell"),
        _value_rule("verdict", "confidence", "low, medium, high"),
        _value_rule("agent_message", "agent_name", "user, assistant"),
    ]),
    "coverage_gaps": _with(STORED) + f"SELECT ticker, {_text('as_of')}, n_rows FROM stored WHERE n_rows < 300",
    "stored_rows": _with(STORED) + f"SELECT ticker, {_text('as_of')}, n_rows FROM stored",
    "run_status": _with(STATUS) + f"""
SELECT id, ticker, {_text('as_of_date')}, mode, status,
  strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed_at FROM statuses""",
    "orphan_runs": _with(STATUS, VERDICT) + """
SELECT id, 'left running' AS problem FROM statuses WHERE status = 'running'
UNION ALL
SELECT id, 'completed without verdict' FROM statuses
WHERE status = 'completed' AND id NOT IN (SELECT run_id FROM verdict)""",

    "run_metrics": _with(METRICS) + f"""
SELECT id, ticker, {_text('as_of_date')}, mode, recommendation, confidence, total_prompt_tokens,
  total_completion_tokens, {_double('total_latency_s')}, message_count FROM metrics""",
    "compare_runs": _with(PAIRS) + f"""
SELECT ticker, {_text('as_of_date')}, bl_rec, bl_conf, bl_tokens, {_double('bl_latency')}, ma_rec, ma_conf, ma_tokens,
  {_double('ma_latency')}, ma_messages, agreement FROM pairs ORDER BY pairs.ticker, pairs.as_of_date DESC""",
    "comparison_report": _with(PAIRS) + f"""
SELECT ticker, {_text('as_of_date')}, upper(bl_rec) || ' (' || bl_conf || ')' AS baseline,
  upper(ma_rec) || ' (' || ma_conf || ')' AS multi_agent,
  CASE WHEN agreement THEN 'MATCH' ELSE 'DIVERGED' END AS status,
  format('{{:,}}', bl_tokens) || ' / ' || format('{{:,}}', ma_tokens) AS tokens,
  CAST(round(bl_latency, 1) AS DECIMAL(18,1)) || 's / ' || CAST(round(ma_latency, 1) AS DECIMAL(18,1)) || 's' AS latency
FROM pairs""",
    "comparison_summary": _with(PAIRS) + """
SELECT count(*) AS pairs, count(*) FILTER (agreement) AS agreements,
  round(count(*) FILTER (agreement) * 100.0 / count(*), 4) AS agreement_pct,
  CAST(sum(bl_tokens) AS BIGINT) AS bl_tokens, CAST(sum(ma_tokens) AS BIGINT) AS ma_tokens,
  CAST(sum(bl_latency) AS DOUBLE) AS bl_latency, CAST(sum(ma_latency) AS DOUBLE) AS ma_latency,
  round(CAST(sum(ma_tokens) AS DOUBLE) / sum(bl_tokens), 4) AS token_multiplier,
  round(CAST(sum(ma_latency) AS DOUBLE) / CAST(sum(bl_latency) AS DOUBLE), 4) AS latency_multiplier,
  round(avg(CAST(ma_tokens AS DOUBLE) / bl_tokens), 4) AS mean_token_ratio
FROM pairs""",
    "confidence_shift": _with(PAIRS) + """
SELECT bl_conf, ma_conf,
  CAST(list_position(['low', 'medium', 'high'], ma_conf) - list_position(['low', 'medium', 'high'], bl_conf) AS BIGINT) AS shift,
  count(*) AS pairs
FROM pairs GROUP BY bl_conf, ma_conf""",
    "verdict_distribution": _with(RUN, VERDICT) + """
SELECT recommendation, mode, count(*) AS n_verdicts FROM verdict JOIN run ON id = run_id GROUP BY ALL""",
    "attempt_counts": _with(MESSAGE) + """
SELECT run_id, agent_name, CAST(max(attempt) AS BIGINT) AS max_attempt, count(*) FILTER (NOT success) AS n_failed,
  count(*) AS n_messages FROM agent_message GROUP BY run_id, agent_name""",
    "agent_messages": _with(MESSAGE) + f"""
SELECT run_id, agent_name, model, CAST(attempt AS BIGINT) AS attempt, CAST(prompt_tokens AS BIGINT) AS prompt_tokens,
  CAST(completion_tokens AS BIGINT) AS completion_tokens, {_double('latency_s')}, payload, success,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM agent_message WHERE agent_name = 'assistant'""",
    "confident_verdicts": _with(VERDICT) + "SELECT * FROM verdict WHERE confidence = 'high'",
    "experiment_grid": _with(REQUESTS) + f"""
SELECT ticker, {_text('as_of')}, mode FROM requests, (VALUES ('baseline'), ('multi_agent')) v(mode)""",
    "purge_runs": _with(RUN, MESSAGE, VERDICT) + ", doomed AS (SELECT id FROM run WHERE status = 'failed')\n" + "\nUNION ALL\n".join(
        f"SELECT table_name, content FROM ({_content(table, 'NULL', source, columns)})" for table, source, columns in (
            ("run", "run ANTI JOIN doomed USING (id)", "as_of_date, id, mode, status, ticker"),
            ("verdict", "verdict ANTI JOIN doomed ON id = run_id", "confidence, reasoning, recommendation, run_id, strongest_counterpoint"),
            ("agent_message", "agent_message ANTI JOIN doomed ON id = run_id", "agent_name, attempt, completion_tokens, strftime(created_at; '%Y-%m-%d %H:%M:%S'), latency_s::DOUBLE, model, payload, prompt_tokens, run_id, success"),
        )
    ),

    "research_panel": _with(PANEL) + f"""
SELECT ticker, {_text('as_of')}, n_bars, last_close, pct_change_1d, pct_change_5d, pct_change_21d,
  rsi_14, macd, macd_signal, macd_histogram, coalesce(n_news, 0) AS n_news, coalesce(headlines, '') AS headlines
FROM panel""",
    "baseline_prompts": _with(PANEL) + f"""
SELECT ticker, {_text('as_of')}, array_to_string([
  'Ticker: ' || ticker, 'As of date: ' || as_of, '', 'Price snapshot:',
  '  last_close: ' || coalesce(last_close::VARCHAR, 'None'),
  '  pct_change_1d: ' || coalesce(pct_change_1d::VARCHAR, 'None'),
  '  pct_change_5d: ' || coalesce(pct_change_5d::VARCHAR, 'None'),
  '  pct_change_21d: ' || coalesce(pct_change_21d::VARCHAR, 'None'), '', 'Technical indicators:',
  '  rsi_14: ' || coalesce(rsi_14::VARCHAR, 'None'),
  '  macd: ' || coalesce(macd::VARCHAR, 'None'),
  '  macd_signal: ' || coalesce(macd_signal::VARCHAR, 'None'),
  '  macd_histogram: ' || coalesce(macd_histogram::VARCHAR, 'None'), '', 'Recent news:',
  coalesce(lines, '  (no recent news available)'), '',
  'Based only on the data above, decide buy, hold, or sell.'], chr(10)) AS prompt
FROM panel""",
    "analyst_inputs": _with(PANEL) + f""",
sections AS (
  SELECT ticker, CAST(as_of AS VARCHAR) AS as_of,
    {_json_numbers('last_close', 'pct_change_1d', 'pct_change_5d', 'pct_change_21d')} AS snapshot_json,
    {_json_numbers('rsi_14', 'macd', 'macd_signal', 'macd_histogram')} AS indicators_json,
    '[' || coalesce(array_to_string(list_transform(items, lambda n: '{{"date": "' || n.date || '", "headline": ' || {_json_text('n.headline')}
      || ', "summary": ' || {_json_text('n.summary')} || '}}'), ', '), '') || ']' AS news_json
  FROM panel)
SELECT *, array_to_string(['Price Snapshot: ' || snapshot_json, 'Technical Indicators: ' || indicators_json,
  'News Items: ' || news_json, '', 'Generate your AnalystReport based on this data.'], chr(10)) AS prompt
FROM sections""",
    "debate_lines": _with(ARGUMENTS) + "SELECT run_id, round, CAST(speaker AS BIGINT) AS speaker, line FROM debate",
    "debate_transcripts": _with(ARGUMENTS) + """
SELECT run_id, count(*) AS n_arguments, string_agg(line, chr(10) ORDER BY round, speaker, line) AS transcript
FROM debate GROUP BY run_id""",
    "debater_inputs": _with(ARGUMENTS, REPORTS) + """,
spoken AS (
  SELECT *, coalesce(string_agg(line, chr(10)) OVER (
      PARTITION BY run_id ORDER BY round, speaker, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'None') AS earlier
  FROM debate)
SELECT d.run_id, d.round, CASE d.speaker WHEN 1 THEN 'bull' ELSE 'bear' END AS stance,
  CASE WHEN r.run_id IS NULL THEN 'no report' ELSE r.problem END AS problem,
  CASE WHEN r.problem IS NULL THEN '--- Analyst Report ---' || chr(10) || r.report_text || chr(10) || chr(10)
    || '--- Debate History ---' || chr(10) || earlier
    || chr(10) || chr(10) || 'Generate your Round ' || d.round || ' argument.' END AS prompt
FROM spoken d LEFT JOIN sound r ON r.run_id = d.run_id""",
    "judge_inputs": _with(ARGUMENTS, REPORTS) + """,
heard AS (SELECT run_id, string_agg(line, chr(10) ORDER BY round, speaker, line) AS transcript FROM debate GROUP BY run_id)
SELECT coalesce(r.run_id, h.run_id) AS run_id, CASE WHEN r.run_id IS NULL THEN 'no report' ELSE r.problem END AS problem,
  CASE WHEN r.problem IS NULL THEN '--- Analyst Report ---' || chr(10) || r.report_text || chr(10) || chr(10)
    || '--- Debate Transcript ---' || chr(10) || coalesce(transcript, '')
    || chr(10) || chr(10) || 'Deliver your final JudgeVerdict.' END AS prompt
FROM (SELECT * FROM sound WHERE run_id::BIGINT % 10 <> 9) r FULL JOIN heard h ON h.run_id = r.run_id""",
    "parse_verdicts": """
WITH made AS (
  SELECT conv_id || '-' || turn AS run_id, role, text, (conv_id + turn) % 6 AS kind FROM conversations)
SELECT run_id,
  CASE WHEN kind IN (0, 4) THEN 'buy' END AS recommendation,
  CASE WHEN kind IN (0, 4) THEN text END AS reasoning,
  CASE WHEN kind IN (0, 4) THEN role END AS strongest_counterpoint,
  CASE WHEN kind IN (0, 4) THEN 'high' END AS confidence,
  CASE kind WHEN 1 THEN 'recommendation not allowed' WHEN 2 THEN 'missing confidence'
    WHEN 3 THEN 'not valid JSON for the schema' WHEN 5 THEN 'missing recommendation' END AS problem
FROM made""",
    "verdicts_as_variant": """
WITH made AS (
  SELECT conv_id || '-' || turn AS run_id, turn, role, text, (conv_id + turn) % 6 AS kind FROM conversations)
SELECT run_id,
  CASE WHEN kind IN (0, 4) THEN 'buy' END AS recommendation,
  CASE WHEN kind IN (0, 4) THEN text END AS reasoning,
  CASE WHEN kind IN (0, 4) THEN role END AS strongest_counterpoint,
  CASE WHEN kind IN (0, 4) THEN 'high' END AS confidence,
  CASE kind WHEN 1 THEN 'recommendation not allowed' WHEN 2 THEN 'missing confidence'
    WHEN 3 THEN 'not valid JSON for the schema' WHEN 5 THEN 'missing recommendation' END AS problem,
  CASE WHEN kind = 5 AND turn % 4 = 1 THEN '{"error":"no reply","turn_no":' || turn || '}'
    WHEN kind = 5 THEN '{"error":"no reply"}' WHEN kind <> 3 AND turn % 4 = 1 THEN '{"turn_no":' || turn || '}' END AS extra
FROM made""",
    "parse_arguments": _with(ARGUMENTS) + """,
made AS (SELECT *, (run_id::BIGINT + round) % 7 AS kind FROM argument)
SELECT run_id, CASE WHEN kind NOT IN (1, 2, 3) THEN stance END AS stance, CASE WHEN kind NOT IN (1, 2, 3) THEN round END AS round,
  CASE kind WHEN 1 THEN 'stance not allowed' WHEN 2 THEN 'missing claims' WHEN 3 THEN 'not valid JSON for the schema' END AS problem,
  CASE WHEN kind NOT IN (1, 2, 3) THEN len(claims) END AS n_claims,
  CASE WHEN kind NOT IN (1, 2, 3) THEN array_to_string(claims, chr(10)) END AS claims,
  CASE WHEN kind NOT IN (1, 2, 3) THEN len(rebuttal_to) END AS n_rebuttals FROM made""",
    "final_attempts": _with(MESSAGE) + """,
numbered AS (
  SELECT *, sum(CASE WHEN attempt = 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY run_id, agent_name ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS call_no
  FROM agent_message)
SELECT run_id, agent_name, CAST(call_no AS BIGINT) AS call_no, count(*) AS n_attempts,
  count(*) FILTER (NOT success) AS n_failed, CAST(max(attempt) FILTER (success) AS BIGINT) AS final_attempt,
  arg_max(payload, (attempt, created_at)) FILTER (success) AS payload, bool_or(success) AS succeeded
FROM numbered GROUP BY run_id, agent_name, call_no""",
    "normalise_messages": """
SELECT CAST(conv_id AS VARCHAR) AS run_id, role AS agent_name, 'derived' AS model, CAST(1 AS BIGINT) AS attempt,
  length(text) AS prompt_tokens, CAST(NULL AS BIGINT) AS completion_tokens,
  CAST(round(length(text) / 7.0::DOUBLE, 3) AS DOUBLE) AS latency_s, TRUE AS success,
  '2024-03-15 09:00:0' || (turn % 10) AS created_at, text
FROM conversations""",

    "rsi_first_seed": _with(REQUESTS, PRICE_BAR, _FIRST_SEED) + """
SELECT q.ticker, CAST(q.as_of AS VARCHAR) AS as_of,
  CASE WHEN down = 0 AND up = 0 THEN 'nan'::DOUBLE WHEN down = 0 THEN 100.0 ELSE round(100 * up / (up + down), 2) END AS rsi_14
FROM requests q LEFT JOIN walk USING (ticker, as_of)""",
    "macd_short": _with(REQUESTS, PRICE_BAR, INDICATORS) + f"""
SELECT ticker, {_text('as_of')},
  CASE WHEN n_bars > 26 THEN round(raw_fast - raw_slow, 2) + 0.0 END AS macd,
  CASE WHEN n_bars > 26 THEN round(raw_signal, 2) + 0.0 END AS macd_signal,
  CASE WHEN n_bars > 26 THEN round(raw_fast - raw_slow - raw_signal, 2) + 0.0 END AS macd_histogram
FROM indicator""",
}
