"""The engine's tables, derived by Spark from a TPC-H-like star schema.

Supplier plays the company, a line item one observation of a price or figure,
a document a news item, a conversation an experiment run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backdate.functions.text import first_sentences
from backdate.operators.versions import build_versions
from backdate.schemas import FACT_KEYS, FACT_LAG_DAYS, MODES, PRICE_KEYS, SUMMARY_SENTENCES

REQUEST_DATES = ("1997-06-30", "1999-03-01", "2001-06-30")

# A total order over repeated line items of one key and day.
LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
]


# The source files' schemas; declared, so that opening a table starts no job.
SOURCES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _ticker(key: Column) -> Column:
    return F.concat(F.lit("S"), key.cast("string"))


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, nations, regions = (source(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _ticker(F.col("s_suppkey")).alias("ticker"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("sector"),
            F.col("r_name").alias("exchange"),
        )
    )


def requests(spark: SparkSession, sf_dir: str, dates: Sequence[str] = REQUEST_DATES) -> DataFrame:
    """Every supplier on some dates."""
    return source(spark, sf_dir, "supplier").select(
        _ticker(F.col("s_suppkey")).alias("ticker"),
        F.explode(F.array(*[F.lit(d).cast("date") for d in dates])).alias("as_of"),
    )


def _compared(keys: Sequence[str], needed: Sequence[str]) -> list[str]:
    """The columns that order repeats of a key and day, up to the last one that is needed: what follows changes nothing."""
    order = [c for c in LINE_ORDER if c not in keys]
    return order[: 1 + max(order.index(c) for c in needed if c in order)]


def _lines(
    spark: SparkSession, sf_dir: str, where: str | None = None, asked: DataFrame | None = None, lookback_days: int | None = None
) -> DataFrame:
    """Line items; ``where`` is on their own columns, so that it reaches the scan.

    ``asked`` are requests: lines shipped after the last of them, or longer ago
    than the look-back of the first, are left out, also in the scan.
    """
    lines = source(spark, sf_dir, "lineitem")
    if where is not None:
        lines = lines.where(where)
    if asked is not None:
        after = asked.agg(F.date_add(F.max("as_of"), 1).cast("timestamp_ntz")).scalar()
        lines = lines.where(F.col("l_shipdate") < after)
        if lookback_days is not None:
            first = asked.agg(F.min("as_of").alias("first")).where(F.col("first").isNotNull())
            oldest = first.select(F.date_sub("first", lookback_days).cast("timestamp_ntz")).scalar()
            lines = lines.where(F.col("l_shipdate") >= oldest)
    return lines


PRICE_MEASURES = ("open", "high", "low", "close", "volume")


def price_observations(
    spark: SparkSession, sf_dir: str, measures: Sequence[str] = PRICE_MEASURES,
    where: str | None = None, carry: Sequence[str] = (), asked: DataFrame | None = None, lookback_days: int | None = None,
) -> DataFrame:
    """The price log: supplier, ship day and the day observed, 30 days later per line number.

    Only the ``measures`` a query needs go along with the compared ``adj_close``,
    and the raw columns to ``carry``. Several lines of a day and number are as
    many observations.
    """
    raw, price, day = F.col, F.col("l_extendedprice").cast("decimal(18,4)"), F.to_date("l_shipdate")

    def share(rate: Column) -> Column:
        """The price in cents times an exact rate."""
        return (raw("l_extendedprice").cast("decimal(14,2)") * rate).cast("decimal(18,4)")

    made = {
        "open": lambda: price,
        "high": lambda: share(1 + raw("l_tax").cast("decimal(4,2)")),
        "low": lambda: share(1 - raw("l_discount").cast("decimal(4,2)")),
        "close": lambda: price,
        "volume": lambda: raw("l_quantity").cast("long"),
    }
    return _lines(spark, sf_dir, where, asked, lookback_days).select(
        _ticker(F.col("l_suppkey")).alias("ticker"),
        day.alias("trade_date"),
        *[made[m]().alias(m) for m in measures],
        price.alias("adj_close"),
        F.date_add(day, 30 * (F.col("l_linenumber") - 1)).alias("observed_on"),
        *carry,
    )


RAW_OF_MEASURE = {
    "open": "l_extendedprice", "high": "l_tax", "low": "l_discount", "close": "l_extendedprice", "volume": "l_quantity",
}


def price_bar(
    spark: SparkSession, sf_dir: str, measures: Sequence[str] = PRICE_MEASURES, where: str | None = None,
    asked: DataFrame | None = None, lookback_days: int | None = None,
) -> DataFrame:
    """Versions of daily prices; with ``asked``, of the days those requests can see."""
    order = _compared(["l_linenumber"], ["l_extendedprice", *[RAW_OF_MEASURE[m] for m in measures]])
    log = price_observations(spark, sf_dir, measures, where, order, asked, lookback_days)
    return build_versions(log, PRICE_KEYS, ["adj_close"], order, F.col("trade_date"))


def fact_observations(
    spark: SparkSession, sf_dir: str, where: str | None = None, carry: Sequence[str] = (), asked: DataFrame | None = None
) -> DataFrame:
    """The figure log: supplier, metric and quarter, observed later the later in the quarter it shipped."""
    shipped = F.to_date("l_shipdate")
    start = F.to_date(F.trunc(shipped, "quarter"))
    end = F.date_sub(F.add_months(start, 3), 1)
    metric = F.when(F.col("l_returnflag") == "A", "revenue").when(
        F.col("l_returnflag") == "N", "net_income"
    ).otherwise("eps")
    return _lines(spark, sf_dir, where, asked).select(
        _ticker(F.col("l_suppkey")).alias("ticker"),
        metric.alias("metric"),
        end.alias("period_end"),
        start.alias("period_start"),
        F.col("l_extendedprice").cast("decimal(28,4)").alias("value"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("source"),
        F.date_add(end, FACT_LAG_DAYS + F.datediff(shipped, start)).alias("observed_on"),
        *carry,
    )


def fundamental_fact(
    spark: SparkSession, sf_dir: str, where: str | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """Versions of quarterly figures; with ``asked``, complete for quarters that were over on those dates."""
    order = _compared([], ["l_orderkey", "l_extendedprice"])
    log = fact_observations(spark, sf_dir, where, order, asked)
    return build_versions(log, FACT_KEYS, ["value"], order, F.date_add("period_end", FACT_LAG_DAYS))


def news_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents spread over the suppliers; first line as headline, summary from the whole text."""
    documents = source(spark, sf_dir, "documents")
    suppliers = source(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    published = F.date_add(F.lit("1999-01-01").cast("date"), ((F.col("doc_id") * 7) % 365).cast("int"))
    return documents.select(
        _ticker(F.col("doc_id") % suppliers).alias("ticker"),
        F.element_at(F.split("text", "\n"), 1).alias("headline"),
        "source",
        published.alias("published_at"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"),
        first_sentences(F.col("text"), SUMMARY_SENTENCES).alias("summary"),
    )


def _experiment(conv_id: Column) -> dict[str, Column]:
    return {
        "id": conv_id.cast("string"),
        "ticker": _ticker(F.floor(conv_id / 2) % 10),
        "as_of_date": F.date_add(F.lit("1999-03-01").cast("date"), F.floor(conv_id / 20).cast("int")),
        "mode": F.when(conv_id % 2 == 0, MODES[0]).otherwise(MODES[1]),
        "status": F.when(conv_id % 7 == 6, "failed").otherwise("completed"),
    }


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = source(spark, sf_dir, "conversations").select("conv_id").distinct()
    return conversations.select(*[c.alias(n) for n, c in _experiment(F.col("conv_id")).items()])


def agent_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per turn; attempts 1, 2, 3 repeat along an agent's turns."""
    conv, turn, size = F.col("conv_id"), F.col("turn"), F.length("text")
    asked, answered = F.col("role").isin("user", "system"), F.col("role") == "assistant"
    minutes = (conv * 1000 + turn).cast("long")
    return source(spark, sf_dir, "conversations").select(
        conv.cast("string").alias("run_id"),
        F.col("role").alias("agent_name"),
        F.lit("derived").alias("model"),
        (F.floor(turn / 2) % 3 + 1).cast("int").alias("attempt"),
        F.when(asked, size).alias("prompt_tokens"),
        F.when(answered, size).alias("completion_tokens"),
        (size.cast("decimal(10,0)") / 1000).cast("decimal(8,3)").alias("latency_s"),
        F.col("text").alias("payload"),
        ((conv + turn) % 5 != 0).alias("success"),
        F.timestamp_seconds(F.lit(1_700_000_000) + minutes * 60).alias("created_at"),
    )


def _decision(conv: Column) -> tuple[Column, Column]:
    recommendation = F.when(conv % 3 == 0, "buy").when(conv % 3 == 1, "hold").otherwise("sell")
    confidence = F.when(conv % 4 == 0, "low").when(conv % 4 == 1, "medium").otherwise("high")
    return recommendation, confidence


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed conversations only; reasoning and counterpoint are the last and first of its turns in text order."""
    conv = F.col("conv_id")
    recommendation, confidence = _decision(conv)
    texts = (
        source(spark, sf_dir, "conversations").where(conv % 7 != 6).groupBy("conv_id")
        .agg(F.max("text").alias("reasoning"), F.min("text").alias("strongest_counterpoint"))
    )
    return texts.select(
        conv.cast("string").alias("run_id"),
        recommendation.alias("recommendation"),
        "reasoning",
        "strongest_counterpoint",
        confidence.alias("confidence"),
    )
