"""Paired comparison of experiment runs.

Totals over pairs are sums of products of per-group counts and sums, so the
summaries never build the pairs; only :func:`compare_runs`, whose result is the
pair list, joins the two modes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backdate.schemas import CONFIDENCES, MODES

BASELINE, MULTI_AGENT = MODES


def message_totals(message: DataFrame) -> DataFrame:
    """Tokens, latency and message count per run; failed attempts count, NULL tokens do not add."""
    return message.groupBy("run_id").agg(
        *[F.sum(c).alias(f"total_{c}") for c in ("prompt_tokens", "completion_tokens", "latency_s")],
        F.count(F.lit(1)).alias("message_count"),
    )


def run_metrics(run: DataFrame, verdict: DataFrame, message: DataFrame) -> DataFrame:
    """Completed runs that have a verdict, with their message totals (0 without messages)."""
    judged = (
        run.where(F.col("status") == "completed")
        .select("id", "ticker", "as_of_date", "mode")
        .join(verdict.select(F.col("run_id").alias("id"), "recommendation", "confidence"), "id")
    )
    totals = message_totals(message).withColumnRenamed("run_id", "id")
    zero = F.lit(0)
    return judged.join(totals, "id", "left").select(
        *judged.columns,
        F.coalesce("total_prompt_tokens", zero).alias("total_prompt_tokens"),
        F.coalesce("total_completion_tokens", zero).alias("total_completion_tokens"),
        F.coalesce("total_latency_s", zero.cast("decimal(18,3)")).alias("total_latency_s"),
        F.coalesce("message_count", zero).alias("message_count"),
    )


def _tokens() -> Column:
    return F.col("total_prompt_tokens") + F.col("total_completion_tokens")


def compare_runs(runs: DataFrame, verdict: DataFrame, message: DataFrame) -> DataFrame:
    """Every baseline run beside every multi-agent run of the same ticker and date.

    Both sides come from one pass over the runs of a ticker and date, so the
    messages are summed once.
    """
    run = F.struct(
        F.col("recommendation").alias("rec"), F.col("confidence").alias("conf"), _tokens().alias("tokens"),
        F.col("total_latency_s").alias("latency"), F.col("message_count").alias("messages"),
    )

    def side(mode: str) -> Column:
        return F.collect_list(F.when(F.col("mode") == mode, run))

    shared = ["ticker", "as_of_date"]
    sides = run_metrics(runs, verdict, message).groupBy(*shared).agg(
        side(BASELINE).alias("_bl"), side(MULTI_AGENT).alias("_ma")
    )
    pairs = sides.select(*shared, F.explode("_bl").alias("bl"), "_ma").select(*shared, "bl", F.explode("_ma").alias("ma"))
    fields = [*((s, f) for s in ("bl", "ma") for f in ("rec", "conf", "tokens", "latency")), ("ma", "messages")]
    return pairs.select(
        *shared, *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s, f in fields],
        (F.col("bl.rec") == F.col("ma.rec")).alias("agreement"),
    )


def in_report_order(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("ticker", F.desc("as_of_date"))


def comparison_report(pairs: DataFrame) -> DataFrame:
    """The pair list as display text."""

    def decision(side: str) -> Column:
        return F.concat(F.upper(f"{side}_rec"), F.lit(" ("), F.col(f"{side}_conf"), F.lit(")"))

    def latency(side: str) -> Column:
        return F.concat(F.format_string("%.1f", F.col(f"{side}_latency").cast("double")), F.lit("s"))

    # The report's labels.
    return pairs.select(
        "ticker", "as_of_date",
        decision("bl").alias("baseline"),
        decision("ma").alias("multi_agent"),
        F.when(F.col("agreement"), "MATCH").otherwise("DIVERGED").alias("status"),
        F.concat_ws(" / ", F.format_number("bl_tokens", 0), F.format_number("ma_tokens", 0)).alias("tokens"),
        F.concat_ws(" / ", latency("bl"), latency("ma")).alias("latency"),
    )


def comparison_summary(metrics: DataFrame) -> DataFrame:
    """Totals over all pairs, from :func:`run_metrics`; one row, ``pairs = 0`` when there are none.

    The multipliers are ratios of totals, 0 when the baseline total is 0;
    ``mean_token_ratio`` is the mean over pairs whose baseline used tokens.
    """
    is_b, is_m = F.col("mode") == BASELINE, F.col("mode") == MULTI_AGENT
    tokens, latency = _tokens(), F.col("total_latency_s")
    per_answer = metrics.groupBy("ticker", "as_of_date", "recommendation").agg(
        F.count_if(is_b).alias("nb"), F.count_if(is_m).alias("nm"),
        F.sum(F.when(is_b, tokens).otherwise(0)).alias("tb"), F.sum(F.when(is_m, tokens).otherwise(0)).alias("tm"),
        F.sum(F.when(is_b, latency).otherwise(0)).alias("lb"), F.sum(F.when(is_m, latency).otherwise(0)).alias("lm"),
        F.count_if(is_b & (tokens > 0)).alias("nb_used"),
        F.sum(F.when(is_b & (tokens > 0), F.lit(1.0) / tokens).otherwise(0.0)).alias("inverse_tb"),
    )
    groups = per_answer.groupBy("ticker", "as_of_date").agg(
        F.sum(F.col("nb") * F.col("nm")).alias("agreed"),
        *[F.sum(c).alias(c) for c in ("nb", "nm", "tb", "tm", "lb", "lm", "nb_used", "inverse_tb")],
    )

    def total(left: str, right: str) -> Column:
        return F.coalesce(F.sum(F.col(left) * F.col(right)), F.lit(0))

    totals = groups.agg(
        total("nb", "nm").alias("pairs"),
        F.coalesce(F.sum(F.when(F.col("nm") * F.col("nb") > 0, F.col("agreed"))), F.lit(0)).alias("agreements"),
        total("tb", "nm").alias("bl_tokens"),
        total("tm", "nb").alias("ma_tokens"),
        total("lb", "nm").cast("double").alias("bl_latency"),
        total("lm", "nb").cast("double").alias("ma_latency"),
        F.try_divide(F.sum(F.col("tm") * F.col("inverse_tb")), F.sum(F.col("nb_used") * F.col("nm"))).alias("mean_ratio"),
    )

    def multiplier(over: str, under: str) -> Column:
        ratio = F.when(F.col(under) > 0, F.round(F.col(over) / F.col(under), 4)).otherwise(0.0)
        return F.when(F.col("pairs") > 0, ratio)

    return totals.select(
        "pairs", "agreements",
        F.when(F.col("pairs") > 0, F.round(F.col("agreements") * 100.0 / F.col("pairs"), 4)).alias("agreement_pct"),
        "bl_tokens", "ma_tokens", "bl_latency", "ma_latency",
        multiplier("ma_tokens", "bl_tokens").alias("token_multiplier"),
        multiplier("ma_latency", "bl_latency").alias("latency_multiplier"),
        F.round("mean_ratio", 4).alias("mean_token_ratio"),
    )


def confidence_shift(metrics: DataFrame) -> DataFrame:
    """Pairs per (baseline, multi-agent) confidence and the step between them (low 1, high 3)."""

    def runs(mode: str, level: str) -> Column:
        return F.count_if((F.col("mode") == mode) & (F.col("confidence") == level))

    per_group = metrics.groupBy("ticker", "as_of_date").agg(
        *[runs(BASELINE, level).alias(f"b_{level}") for level in CONFIDENCES],
        *[runs(MULTI_AGENT, level).alias(f"m_{level}") for level in CONFIDENCES],
    )
    cells = F.array(*[
        F.struct(
            F.lit(b).alias("bl_conf"), F.lit(m).alias("ma_conf"),
            F.lit(CONFIDENCES.index(m) - CONFIDENCES.index(b)).alias("shift"),
            (F.col(f"b_{b}") * F.col(f"m_{m}")).alias("n"),
        )
        for b in CONFIDENCES for m in CONFIDENCES
    ])
    return (
        per_group.select(F.inline(cells)).groupBy("bl_conf", "ma_conf", "shift")
        .agg(F.sum("n").alias("pairs")).where(F.col("pairs") > 0)
    )


def verdict_distribution(run: DataFrame, verdict: DataFrame) -> DataFrame:
    judged = verdict.select(F.col("run_id").alias("id"), "recommendation").join(run.select("id", "mode"), "id")
    return judged.groupBy("recommendation", "mode").agg(F.count(F.lit(1)).alias("n_verdicts"))


def attempt_counts(message: DataFrame) -> DataFrame:
    """Attempts and failures per run and agent."""
    return message.groupBy("run_id", "agent_name").agg(
        F.max("attempt").alias("max_attempt"),
        F.count_if(~F.col("success")).alias("n_failed"),
        F.count(F.lit(1)).alias("n_messages"),
    )


def messages_of(message: DataFrame, agent_name: str) -> DataFrame:
    return message.where(F.col("agent_name") == agent_name)


def verdicts_with(verdict: DataFrame, confidence: str) -> DataFrame:
    return verdict.where(F.col("confidence") == confidence)


def experiment_grid(requests: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """Every scenario once per mode."""
    return requests.select("ticker", "as_of", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
