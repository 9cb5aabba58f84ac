"""Reads shuffle what is asked for, not the whole table."""

from __future__ import annotations

import pytest
import seed
from pyspark.sql import functions as F

from backdate.operators.indicators import indicators
from backdate.operators.news import news_top_k

TICKERS, DAYS = 1_000, 20
ASKED = [("T7", "2024-01-20"), ("T500", "2024-01-15"), ("T999", "2024-01-20")]


def shuffled(df):
    """Rows that each exchange wrote when ``df`` ran."""
    df.collect()
    found, seen, todo = [], set(), [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "ShuffleExchangeExec" and node.id() not in seen:
            seen.add(node.id())
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars") / "t")
    spark.range(TICKERS * DAYS, numPartitions=4).selectExpr(
        "concat('T', id % 1000) AS ticker", "date_add(DATE'2024-01-01', CAST(id DIV 1000 AS INT)) AS trade_date",
        "CAST(100 + (id * 7919) % 13 AS DOUBLE) AS close", "DATE'2024-01-01' AS known_from", "DATE'9999-12-31' AS known_until",
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("news") / "t")
    spark.range(TICKERS * DAYS, numPartitions=4).selectExpr(
        "concat('T', id % 1000) AS ticker", "concat('h', id) AS headline", "'s' AS source", "'u' AS url", "'m' AS summary",
        "date_add(DATE'2024-01-01', CAST(id DIV 1000 AS INT)) AS published_at",
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    """Stored, so that Spark knows how few they are."""
    path = str(tmp_path_factory.mktemp("requests") / "t")
    seed.requests(spark, *ASKED).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("broadcast", [True, False])
def test_only_bars_of_asked_tickers_are_shuffled(spark, bars, asked, broadcast):
    whole = {(r.ticker, r.n_bars, r.rsi_14) for r in indicators(asked, bars.where("ticker IN ('T7', 'T500', 'T999')")).collect()}
    with no_broadcast(spark, broadcast):
        df = indicators(asked, bars)
        written = shuffled(df)
        assert {(r.ticker, r.n_bars, r.rsi_14) for r in df.collect()} == whole
    assert {(t, n) for t, n, _ in whole} == {("T7", 20), ("T500", 15), ("T999", 20)}
    if broadcast:
        assert written and max(written) <= 3 * DAYS


@pytest.mark.parametrize("broadcast", [True, False])
def test_only_news_of_asked_tickers_are_ranked(spark, items, asked, broadcast):
    with no_broadcast(spark, broadcast):
        df = news_top_k(asked, items, 3)
        written = shuffled(df)
        rows = df.collect()
    newest = {(r.ticker, r.position, int(r.headline[1:]) // 1000) for r in rows}
    assert newest == {(t, k, last - k) for t, last in (("T7", 20), ("T500", 15), ("T999", 20)) for k in (1, 2, 3)}
    if broadcast:
        # The distinct tickers stand once per salt on the side that is broadcast.
        assert written and max(written) <= 3 * DAYS


class no_broadcast:
    def __init__(self, spark, broadcast):
        self.spark, self.broadcast = spark, broadcast

    def __enter__(self):
        if not self.broadcast:
            self.old = self.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
            self.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)

    def __exit__(self, *_):
        if not self.broadcast:
            self.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", self.old)
