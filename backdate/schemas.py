"""Table schemas (Spark DDL) and the default parameters of the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T


# ---------------------------------------------------------------------------
# Defaults of the data model, needed for equal results.
# ---------------------------------------------------------------------------
OPEN_END = dt.date(9999, 12, 31)          # known_until of a version still believed
NEWS_CAP = 8                              # headlines per request, new headlines per ingest
SUMMARY_SENTENCES = 2
INDICATOR_LOOKBACK_DAYS = 365
HISTORY_LOOKBACK_DAYS = 180
INGEST_LOOKBACK_DAYS = 180
RSI_PERIOD = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
PCT_CHANGE_BARS = (1, 5, 21)
FACT_LAG_DAYS = 45                        # period end -> first publication
FACT_PERIOD_DAYS = 90                     # period start -> period end
COVERAGE_MIN_ROWS = 10
DEBATE_ROUNDS = 1
MODES = ("baseline", "multi_agent")
STATUSES = ("running", "completed", "failed")
RECOMMENDATIONS = ("buy", "hold", "sell")
CONFIDENCES = ("low", "medium", "high")
STANCES = ("bull", "bear")
FACT_CURRENCY = "USD"
FACT_SOURCE = "yfinance"
NEWS_SOURCE_WHEN_ABSENT = "Yahoo Finance"  # feed entry without a provider
NEWS_SOURCE_WHEN_EMPTY = "Unknown"         # stored row without a source
METRIC_OF_LINE_ITEM = {
    "Total Revenue": "revenue",
    "Net Income": "net_income",
    "Basic EPS": "eps",
    "Diluted EPS": "eps_diluted",
}

PRICE = T.DecimalType(18, 4)
FACT_VALUE = T.DecimalType(28, 4)
LATENCY = T.DecimalType(8, 3)

# ---------------------------------------------------------------------------
# The engine's tables, needed for equal results.
# ---------------------------------------------------------------------------
COMPANY = "ticker string not null, name string not null, sector string, exchange string"

PRICE_BAR = (
    "ticker string not null, trade_date date not null, open decimal(18,4), high decimal(18,4), "
    "low decimal(18,4), close decimal(18,4), volume bigint, adj_close decimal(18,4), "
    "known_from date not null, known_until date not null"
)

FUNDAMENTAL_FACT = (
    "ticker string not null, metric string not null, period_start date not null, "
    "period_end date not null, value decimal(28,4), currency string, source string, "
    "known_from date not null, known_until date not null"
)

NEWS_ITEM = (
    "ticker string not null, headline string not null, source string, published_at date not null, "
    "url string, summary string, ingested_at timestamp"
)

RUN = (
    "id string not null, ticker string not null, as_of_date date not null, mode string not null, "
    "analyst_model string, debater_model string, judge_model string, debate_rounds int, "
    "started_at timestamp, completed_at timestamp, status string not null"
)

AGENT_MESSAGE = (
    "run_id string not null, agent_name string not null, model string not null, attempt int not null, "
    "prompt_tokens int, completion_tokens int, latency_s decimal(8,3), payload string not null, "
    "success boolean not null, created_at timestamp"
)

VERDICT = (
    "run_id string not null, recommendation string not null, reasoning string not null, "
    "strongest_counterpoint string not null, confidence string not null, created_at timestamp"
)

REQUESTS = "ticker string not null, as_of date not null"

TABLES = {
    "company": COMPANY,
    "price_bar": PRICE_BAR,
    "fundamental_fact": FUNDAMENTAL_FACT,
    "news_item": NEWS_ITEM,
    "run": RUN,
    "agent_message": AGENT_MESSAGE,
    "verdict": VERDICT,
}

# What a row says where its writer says nothing.
DEFAULTS = {
    "run": {"status": "running", "debate_rounds": DEBATE_ROUNDS},
    "agent_message": {"attempt": 1, "success": True},
}

PRICE_KEYS = ["ticker", "trade_date"]
FACT_KEYS = ["ticker", "metric", "period_end"]
NEWS_KEYS = ["ticker", "headline", "published_at"]

# ---------------------------------------------------------------------------
# Landing feeds and payloads, needed to read the same inputs.
# ---------------------------------------------------------------------------
PRICE_FEED = (
    "ticker string, trade_date date, open double, high double, low double, close double, volume bigint"
)

NEWS_FEED = (
    "ticker string, feed_pos bigint, content struct<pubDate:string, title:string, "
    "provider:struct<displayName:string>, canonicalUrl:struct<url:string>, "
    "summary:string, description:string>"
)

COMPANY_FEED = (
    "ticker string, longName string, shortName string, sector string, exchange string"
)

VERDICT_PAYLOAD = (
    "recommendation string, reasoning string, strongest_counterpoint string, confidence string"
)
ARGUMENT_PAYLOAD = (
    "stance string, round int, claims array<string>, rebuttal_to array<string>"
)
ANALYST_PAYLOAD = (
    "price_snapshot map<string,double>, indicators map<string,double>, "
    "news array<struct<headline:string, source:string, published:date, summary:string>>, "
    "key_points array<string>"
)
FAILURE_PAYLOAD = "error string"
