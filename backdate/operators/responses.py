"""Message logs: normalising, validating payloads, final attempts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backdate.schemas import (
    ANALYST_PAYLOAD,
    ARGUMENT_PAYLOAD,
    CONFIDENCES,
    FAILURE_PAYLOAD,
    LATENCY,
    RECOMMENDATIONS,
    STANCES,
    VERDICT_PAYLOAD,
)


def normalise_messages(calls: DataFrame, run_id: str | Column) -> DataFrame:
    """Call log rows in the columns of the message table; payload as JSON text."""
    run = run_id if isinstance(run_id, Column) else F.lit(run_id)
    payload = F.col("payload")
    if not isinstance(calls.schema["payload"].dataType, T.StringType):
        payload = F.to_json(payload)
    return calls.select(
        run.alias("run_id"),
        F.col("agent").alias("agent_name"),
        "model", "attempt", "prompt_tokens", "completion_tokens",
        F.round("latency_s", 3).cast(LATENCY).alias("latency_s"),
        payload.alias("payload"),
        "success",
        F.col("timestamp").cast("timestamp").alias("created_at"),
    )


def _parse(
    messages: DataFrame, ddl: str, required: Sequence[str], allowed: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Payload fields plus ``problem``: NULL when valid, else the first reason found."""
    parsed = messages.withColumn("_p", F.from_json(
        "payload", f"{ddl}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}
    ))
    problems = [(F.col("_p").isNull() | F.col("_p._corrupt").isNotNull(), "not valid JSON for the schema")]
    problems += [(F.col(f"_p.{f}").isNull(), f"missing {f}") for f in required]
    problems += [(~F.col(f"_p.{f}").isin(*values), f"{f} not allowed") for f, values in allowed.items()]
    first, *rest = problems
    problem = reduce(lambda c, p: c.when(*p), rest, F.when(*first))
    return parsed.withColumn("problem", problem)


def parse_verdicts(messages: DataFrame) -> DataFrame:
    """Verdict payloads as columns; invalid ones keep their row, NULL fields and a ``problem``."""
    fields = ["recommendation", "reasoning", "strongest_counterpoint", "confidence"]
    checked = _parse(
        messages, VERDICT_PAYLOAD, fields, {"recommendation": RECOMMENDATIONS, "confidence": CONFIDENCES}
    )
    return checked.select(
        "run_id", *[F.when(F.col("problem").isNull(), F.col(f"_p.{f}")).alias(f) for f in fields], "problem"
    )


def parse_arguments(messages: DataFrame) -> DataFrame:
    """Argument payloads as columns; no rebuttals when the field is absent."""
    checked = _parse(messages, ARGUMENT_PAYLOAD, ["stance", "round", "claims"], {"stance": STANCES})
    valid = F.col("problem").isNull()
    rebuttals = F.coalesce("_p.rebuttal_to", F.array().cast("array<string>"))
    return checked.select(
        "run_id",
        *[F.when(valid, F.col(f"_p.{f}")).alias(f) for f in ("stance", "round", "claims")],
        F.when(valid, rebuttals).alias("rebuttal_to"),
        "problem",
    )


def parse_reports(messages: DataFrame) -> DataFrame:
    """Analyst report payloads as columns."""
    fields = ["price_snapshot", "indicators", "news", "key_points"]
    checked = _parse(messages, ANALYST_PAYLOAD, fields, {})
    valid = F.col("problem").isNull()
    return checked.select("run_id", *[F.when(valid, F.col(f"_p.{f}")).alias(f) for f in fields], "problem")


def payloads_as_variant(messages: DataFrame) -> DataFrame:
    """Messages with their payload as VARIANT, parsed once; NULL where the text is no JSON.

    Stored so, a payload keeps every field it came with, and a query reads the
    fields it names without parsing the text again.
    """
    return messages.withColumn("payload", F.try_parse_json("payload"))


def verdicts_of_variants(messages: DataFrame) -> DataFrame:
    """:func:`parse_verdicts` over VARIANT payloads; ``extra`` keeps the fields that no verdict has, as JSON.

    ``extra`` is NULL where there are none and where the payload is no object. A
    field that is an object or a list is taken as its JSON text.
    """
    fields = ["recommendation", "reasoning", "strongest_counterpoint", "confidence"]
    parts = F.try_variant_get("payload", "$", "map<string,variant>")
    extra = F.map_filter("_parts", lambda name, _: ~name.isin(*fields))
    read = messages.withColumn("_parts", parts).withColumns({
        **{f"_{f}": F.try_variant_get("payload", f"$.{f}", "string") for f in fields},
        "extra": F.when(F.size(F.map_keys(extra)) > 0, F.to_json(extra)),
    })
    allowed = {"recommendation": RECOMMENDATIONS, "confidence": CONFIDENCES}
    problem = F.when(F.col("_parts").isNull(), "not valid JSON for the schema")
    for f in fields:
        problem = problem.when(F.col(f"_{f}").isNull(), f"missing {f}")
    for f, values in allowed.items():
        problem = problem.when(~F.col(f"_{f}").isin(*values), f"{f} not allowed")
    return read.withColumn("problem", problem).select(
        "run_id", *[F.when(F.col("problem").isNull(), F.col(f"_{f}")).alias(f) for f in fields], "problem", "extra"
    )


def failure_reason() -> Column:
    """The error text of a failed attempt's payload."""
    return F.from_json("payload", FAILURE_PAYLOAD)["error"]


def numbered_calls(messages: DataFrame) -> DataFrame:
    """Add ``call_no`` per run and agent: a new call starts at each attempt 1.

    A running count over time, taken in two steps so that one long run does not
    end in one task: starts per minute are summed up first, then counted on
    within the minute.
    """
    agent = ["run_id", "agent_name"]
    timed = messages.withColumn("_minute", F.date_trunc("minute", "created_at"))
    starts = (F.col("attempt") == 1).cast("long")
    before = Window.partitionBy(*agent).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        timed.groupBy(*agent, "_minute").agg(F.sum(starts).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy(*agent, "_minute").orderBy("created_at", "attempt")
    counted = timed.withColumn("_within", F.sum(starts).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.join(offsets, [*agent, "_minute"]).withColumn(
        "call_no", F.col("_before") + F.col("_within")
    ).drop("_minute", "_before", "_within")


def final_attempts(messages: DataFrame) -> DataFrame:
    """Per call its last successful attempt (NULLs if none), attempts made and failures."""
    success = F.struct("attempt", "created_at", "model", "payload")
    calls = numbered_calls(messages).groupBy("run_id", "agent_name", "call_no").agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if(~F.col("success")).alias("n_failed"),
        F.max(F.when(F.col("success"), success)).alias("_final"),
    )
    return calls.select(
        "run_id", "agent_name", "call_no", "n_attempts", "n_failed",
        F.col("_final.attempt").alias("final_attempt"),
        F.col("_final.payload").alias("payload"),
        F.col("_final").isNotNull().alias("succeeded"),
    )
