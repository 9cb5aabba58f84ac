"""Checks: nothing from after the date, leaks of the naive read, declared constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backdate.operators.pointintime import believed_on, distinct_requests, within_envelope
from backdate.schemas import COVERAGE_MIN_ROWS, NEWS_CAP


def late_rows(rows: DataFrame, date_col: str) -> DataFrame:
    """Per request the number of rows, how many are dated after it, and the newest date."""
    return rows.groupBy("ticker", "as_of").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(date_col) > F.col("as_of")).alias("n_late"),
        F.max(date_col).alias("newest"),
    )


def asof_bound_check(requests: DataFrame, history: DataFrame, news: DataFrame, cap: int = NEWS_CAP) -> DataFrame:
    """Per request: bars and news read, rows dated after it, and whether all bounds hold."""
    counts = (
        distinct_requests(requests).select("ticker", "as_of", F.lit("request").alias("kind"), F.lit(None).cast("date").alias("day"))
        .unionByName(history.select("ticker", "as_of", F.lit("bar").alias("kind"), F.col("trade_date").alias("day")))
        .unionByName(news.select("ticker", "as_of", F.lit("news").alias("kind"), F.col("published").alias("day")))
        .groupBy("ticker", "as_of")
        .agg(
            F.count_if(F.col("kind") == "bar").alias("n_bars"),
            F.count_if((F.col("kind") == "bar") & (F.col("day") > F.col("as_of"))).alias("n_late_bars"),
            F.count_if(F.col("kind") == "news").alias("n_news"),
            F.count_if((F.col("kind") == "news") & (F.col("day") > F.col("as_of"))).alias("n_late_news"),
        )
    )
    holds = (F.col("n_late_bars") == 0) & (F.col("n_late_news") == 0) & (F.col("n_news") <= cap)
    return counts.withColumn("holds", holds)


def lookahead_leaks(
    versions: DataFrame, requests: DataFrame, keys: Sequence[str], value: str = "value",
    date_col: str = "period_end", salts: int = 16,
) -> DataFrame:
    """Naive against point-in-time value for every key a request can see.

    ``naive_*`` is the newest version whatever the date, ``asof_*`` the one
    believed on the date (NULL when nothing was believed yet). ``days_ahead``
    tells how far in the future the naive version was learned.

    The newest version is a window over the key (one row per day at most), so
    the table is shuffled once for it; only the matched rows are grouped again.
    """
    rest = [k for k in keys if k != "ticker"]
    newest = Window.partitionBy(*keys).orderBy(F.desc("known_from"), F.desc("known_until"))
    offered = within_envelope(versions, requests, date_col, None).select(
        *keys, value, "source", "known_from", "known_until",
        F.row_number().over(newest).alias("_rn"),
        F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int").alias("_salt"),
    )
    wanted = distinct_requests(requests).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Of a key only two versions matter to a request: the newest and the believed one.
    latest, believed = F.col("_rn") == 1, believed_on(F.col("as_of"))
    seen = offered.join(wanted, ["ticker", "_salt"]).where(
        (F.col(date_col) <= F.col("as_of")) & (latest | believed)
    )

    def pick(column: str, condition: Column) -> Column:
        return F.max(F.when(condition, F.col(column)))

    paired = seen.groupBy("ticker", "as_of", *rest).agg(
        pick(value, latest).alias("naive_value"),
        pick("known_from", latest).alias("naive_known_from"),
        pick("source", latest).alias("naive_source"),
        pick(value, believed).alias("asof_value"),
        pick("known_from", believed).alias("asof_known_from"),
        pick("source", believed).alias("asof_source"),
    )
    return paired.withColumns({
        "leaked": ~F.col("naive_value").eqNullSafe(F.col("asof_value")),
        "days_ahead": F.greatest(F.datediff("naive_known_from", "as_of"), F.lit(0)),
    })


def leak_summary(leaks: DataFrame) -> DataFrame:
    """Per request date: keys compared, keys whose naive read leaks, furthest look-ahead."""
    return leaks.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if("leaked").alias("n_leaked"),
        F.max(F.when(F.col("leaked"), F.col("days_ahead"))).alias("max_days_ahead"),
    )


def stored_rows(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """Per request the number of stored rows up to its date, all versions counted.

    Rows are first counted per ticker and day; a running sum over those days and
    the request dates then answers every request without pairing rows.
    """
    per_day = within_envelope(bars, requests, "trade_date", None).groupBy(
        "ticker", F.col("trade_date").alias("day")
    ).agg(F.count(F.lit(1)).alias("_n"))
    asked = distinct_requests(requests).select(
        "ticker", F.col("as_of").alias("day"), F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_asked")
    )
    up_to = Window.partitionBy("ticker").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    return (
        per_day.withColumn("_asked", F.lit(False)).unionByName(asked)
        .withColumn("n_rows", F.sum("_n").over(up_to))
        .where("_asked")
        .select("ticker", F.col("day").alias("as_of"), "n_rows")
    )


def coverage_gaps(requests: DataFrame, bars: DataFrame, min_rows: int = COVERAGE_MIN_ROWS) -> DataFrame:
    """Requests with too little stored history; these need an ingest."""
    return stored_rows(requests, bars).where(F.col("n_rows") < min_rows)


# -- declared constraints ---------------------------------------------------

def _counts(totals: DataFrame, names: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row of totals as one row per rule; ``names`` are (column, table, rule)."""
    return totals.select(F.inline(F.array(*[
        F.struct(
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
            F.coalesce(F.col(column), F.lit(0)).cast("long").alias("violations"),
        ) for column, table, rule in names
    ])))


def _table_rules(df: DataFrame, table: str, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """The key's surplus rows and all per-row rules of a table, in one pass: per key first, so a hot key is one row."""
    broken = {f"_r{i}": (rule, condition) for i, (rule, condition) in enumerate(rules.items())}
    counted = [F.count_if(condition).alias(c) for c, (_, condition) in broken.items()]
    names = [(c, table, rule) for c, (rule, _) in broken.items()]
    if not key:
        return _counts(df.agg(*counted), names)
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *counted)
    totals = per_key.agg(F.sum(F.col("_n") - 1).alias("_surplus"), *[F.sum(c).alias(c) for c in broken])
    return _counts(totals, [("_surplus", table, f"primary key ({', '.join(key)})"), *names])


def _references(tables: Mapping[str, DataFrame], foreign_keys: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Child rows without a parent for all foreign keys at once.

    Each table gives its values as a child and as a parent in one pass; they
    meet by value, counted before the shuffle.
    """
    held = -1
    parts = []
    for name, df in tables.items():
        roles = [
            F.struct(F.lit(f"{p}.{pk}").alias("domain"), F.col(ck).cast("string").alias("value"), F.lit(i).alias("rule"))
            for i, (c, ck, p, pk) in enumerate(foreign_keys) if c == name
        ] + [
            F.struct(F.lit(f"{name}.{pk}").alias("domain"), F.col(pk).cast("string").alias("value"), F.lit(held).alias("rule"))
            for pk in sorted({pk for _, _, p, pk in foreign_keys if p == name})
        ]
        if roles:
            parts.append(df.select(F.inline(F.array(*roles))))
    met = reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull()).groupBy("domain", "value").agg(
        F.max(F.col("rule") == held).alias("_held"),
        *[F.count_if(F.col("rule") == i).alias(f"_f{i}") for i in range(len(foreign_keys))],
    )
    totals = met.where(~F.col("_held")).agg(*[F.sum(f"_f{i}").alias(f"_f{i}") for i in range(len(foreign_keys))])
    return _counts(totals, [(f"_f{i}", c, f"{ck} references {p}") for i, (c, ck, p, _) in enumerate(foreign_keys)])


def row_rules(not_null: Sequence[str] = (), allowed: Mapping[str, Sequence[str]] | None = None) -> dict[str, Column]:
    """What breaks a table's declared rules that a row decides on its own, by rule; NULL is an allowed value."""
    rules = {f"{c} not null": F.col(c).isNull() for c in not_null}
    for column, values in (allowed or {}).items():
        rules[f"{column} in ({', '.join(values)})"] = F.col(column).isNotNull() & ~F.col(column).isin(*values)
    return rules


def bound_rules(date_col: str) -> dict[str, Column]:
    """What breaks the bound of rows read for requests: none may be dated after its request."""
    return {f"{date_col} up to as_of": F.col(date_col) > F.col("as_of")}


def version_rules() -> dict[str, Column]:
    """What breaks a version on its own: a belief that ends before it begins."""
    return {"known_from up to known_until": F.col("known_from") > F.col("known_until")}


def constraint_violations(
    tables: Mapping[str, DataFrame],
    primary_keys: Mapping[str, Sequence[str]],
    foreign_keys: Sequence[tuple[str, str, str, str]] = (),
    not_null: Mapping[str, Sequence[str]] | None = None,
    allowed: Mapping[tuple[str, str], Sequence[str]] | None = None,
) -> DataFrame:
    """One row per declared rule with its number of violations.

    ``foreign_keys`` are (child table, column, parent table, column); ``allowed``
    maps (table, column) to its permitted values. NULL passes an ``allowed`` and a
    foreign key rule. A table is read once for its own rules and once for all
    foreign keys it takes part in.
    """
    per_row: dict[str, dict[str, Column]] = {t: {} for t in primary_keys}
    for table, columns in (not_null or {}).items():
        per_row.setdefault(table, {}).update(row_rules(columns))
    for (table, column), values in (allowed or {}).items():
        per_row.setdefault(table, {}).update(row_rules(allowed={column: values}))
    reports = [_table_rules(tables[t], t, primary_keys.get(t, ()), rules) for t, rules in per_row.items()]
    if foreign_keys:
        reports.append(_references(tables, foreign_keys))
    return reduce(DataFrame.unionByName, reports)


def unfinished_runs(run: DataFrame, verdict: DataFrame) -> DataFrame:
    """Runs left ``running``, and completed runs without a verdict."""
    running = run.where(F.col("status") == "running").select("id", F.lit("left running").alias("problem"))
    completed = run.where(F.col("status") == "completed").select("id")
    silent = completed.join(verdict.select(F.col("run_id").alias("id")), "id", "left_anti")
    return running.unionByName(silent.select("id", F.lit("completed without verdict").alias("problem")))
