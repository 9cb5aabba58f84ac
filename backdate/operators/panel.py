"""One row per request with all it could know, and the texts made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backdate.functions.text import json_number, json_string, plain_number, quoted_list, quoted_map
from backdate.operators.indicators import (
    close_arrays,
    indicator_columns,
    prices_of,
    snapshot_columns,
)
from backdate.operators.news import news_top_k
from backdate.schemas import (
    HISTORY_LOOKBACK_DAYS,
    INDICATOR_LOOKBACK_DAYS,
    NEWS_CAP,
    PCT_CHANGE_BARS,
    STANCES,
)

# ---------------------------------------------------------------------------
# Wording of the prompt sections, needed for equal texts.
# ---------------------------------------------------------------------------
TICKER_LINE = "Ticker: "
DATE_LINE = "As of date: "
SNAPSHOT_HEADING = "Price snapshot:"
INDICATORS_HEADING = "Technical indicators:"
NEWS_HEADING = "Recent news:"
NO_NEWS_LINE = "  (no recent news available)"
CLOSING_LINE = "Based only on the data above, decide buy, hold, or sell."
ANALYST_SNAPSHOT = "Price Snapshot: "
ANALYST_INDICATORS = "Technical Indicators: "
ANALYST_NEWS = "News Items: "
ANALYST_CLOSING = "Generate your AnalystReport based on this data."
REPORT_HEADING = "--- Analyst Report ---"
HISTORY_HEADING = "--- Debate History ---"
TRANSCRIPT_HEADING = "--- Debate Transcript ---"
NO_HISTORY = "None"
DEBATER_CLOSING = "Generate your Round {} argument."
JUDGE_CLOSING = "Deliver your final JudgeVerdict."

SNAPSHOT_FIELDS = ("last_close", *(f"pct_change_{n}d" for n in PCT_CHANGE_BARS))
INDICATOR_FIELDS = ("rsi_14", "macd", "macd_signal", "macd_histogram")


def news_lists(requests: DataFrame, news: DataFrame, k: int = NEWS_CAP) -> DataFrame:
    """The top-k news of each request as one array, newest first (k items at most)."""
    item = F.struct("position", "published", "headline", "source", "summary")
    return news_top_k(requests, news, k).groupBy("ticker", "as_of").agg(
        F.array_sort(F.collect_list(item)).alias("news")
    )


def research_panel(
    requests: DataFrame, bars: DataFrame, news: DataFrame,
    indicator_days: int = INDICATOR_LOOKBACK_DAYS, history_days: int = HISTORY_LOOKBACK_DAYS, k: int = NEWS_CAP,
) -> DataFrame:
    """Price snapshot, indicators and news per request, all as known on its date.

    Snapshot and indicators share one pass over the bars: the array covers the
    longer look-back and each of them takes its own part.
    """
    arrays = close_arrays(requests, bars, max(indicator_days, history_days))

    def closes_since(days: int) -> Column:
        return prices_of(f"filter(bars, b -> b.trade_date > date_sub(as_of, {days}))")

    parts = arrays.select(
        "ticker", "as_of",
        closes_since(indicator_days).alias("_indicator_closes"),
        closes_since(history_days).alias("_history_closes"),
    ).select(
        "ticker", "as_of", "_indicator_closes",
        F.size("_history_closes").cast("long").alias("n_bars"),
        *snapshot_columns("_history_closes"),
    )
    measured = indicator_columns(parts, "_indicator_closes")
    panel = measured.join(news_lists(requests, news, k), ["ticker", "as_of"], "left")
    none = F.array().cast(panel.schema["news"].dataType)
    return panel.select(
        "ticker", "as_of", "n_bars", *SNAPSHOT_FIELDS, *INDICATOR_FIELDS,
        F.coalesce("news", none).alias("news"),
    )


def _field_lines(fields: tuple[str, ...], digits: int) -> list[Column]:
    return [F.concat(F.lit(f"  {f}: "), plain_number(F.col(f), digits)) for f in fields]


def _news_lines() -> Column:
    def line(n: Column) -> Column:
        return F.concat(
            F.lit("  ["), n["published"].cast("string"), F.lit("] ("), n["source"], F.lit(") "),
            n["headline"], F.lit(" — "), n["summary"],
        )

    listed = F.array_join(F.transform("news", line), "\n")
    return F.when(F.size("news") == 0, NO_NEWS_LINE).otherwise(listed)


def baseline_prompts(panel: DataFrame) -> DataFrame:
    """The request text for a single-model decision, one per panel row."""
    lines = [
        F.concat(F.lit(TICKER_LINE), F.col("ticker")),
        F.concat(F.lit(DATE_LINE), F.col("as_of").cast("string")),
        F.lit(""),
        F.lit(SNAPSHOT_HEADING), *_field_lines(SNAPSHOT_FIELDS, 2),
        F.lit(""),
        F.lit(INDICATORS_HEADING), *_field_lines(INDICATOR_FIELDS, 4),
        F.lit(""),
        F.lit(NEWS_HEADING), _news_lines(),
        F.lit(""),
        F.lit(CLOSING_LINE),
    ]
    return panel.select("ticker", "as_of", F.concat_ws("\n", *lines).alias("prompt"))


def _json_object(names: tuple[str, ...]) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array(*[
        F.concat(F.lit(f'"{n}": '), json_number(F.col(n))) for n in names
    ]), ", "), F.lit("}"))


def analyst_inputs(panel: DataFrame) -> DataFrame:
    """The three data sections as JSON and the request text made of them.

    The JSON has a blank after ``:`` and ``,``, numbers in shortest plain form
    and everything beyond ASCII escaped.
    """
    def item(n: Column) -> Column:
        fields = {"date": n["published"].cast("string"), "headline": n["headline"], "summary": n["summary"]}
        return F.concat(F.lit("{"), F.array_join(F.array(*[
            F.concat(F.lit(f'"{k}": '), json_string(v)) for k, v in fields.items()
        ]), ", "), F.lit("}"))

    sections = panel.select(
        "ticker", "as_of",
        _json_object(SNAPSHOT_FIELDS).alias("snapshot_json"),
        _json_object(INDICATOR_FIELDS).alias("indicators_json"),
        F.concat(F.lit("["), F.array_join(F.transform("news", item), ", "), F.lit("]")).alias("news_json"),
    )
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit(ANALYST_SNAPSHOT), F.col("snapshot_json")),
        F.concat(F.lit(ANALYST_INDICATORS), F.col("indicators_json")),
        F.concat(F.lit(ANALYST_NEWS), F.col("news_json")),
        F.lit(""),
        F.lit(ANALYST_CLOSING),
    )
    return sections.withColumn("prompt", prompt)


def debate_lines(arguments: DataFrame) -> DataFrame:
    """One line of text per argument, with its place in the debate."""
    speaker = F.array_position(F.array(*[F.lit(s) for s in STANCES]), F.col("stance"))
    text = F.concat(
        F.lit("Round "), F.col("round").cast("string"), F.lit(" "), F.upper("stance"),
        F.lit(": Claims: "), quoted_list(F.col("claims")),
        F.lit(". Rebuttals: "), quoted_list(F.coalesce("rebuttal_to", F.array().cast("array<string>"))),
    )
    return arguments.select("run_id", "round", speaker.cast("int").alias("speaker"), text.alias("line"))


def debate_transcripts(arguments: DataFrame) -> DataFrame:
    """The debate of a run as one text: by round, bull before bear.

    A transcript is a single prompt, so a run has only as many arguments as a
    model can read at once; :func:`debate_lines` is the form without that bound.
    """
    spoken = F.array_sort(F.collect_list(F.struct("round", "speaker", "line")))
    return debate_lines(arguments).groupBy("run_id").agg(spoken.alias("debate")).select(
        "run_id",
        F.size("debate").cast("long").alias("n_arguments"),
        F.array_join("debate.line", "\n").alias("transcript"),
    )


def _report_text() -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Key Points: "), quoted_list(F.col("key_points"))),
        F.concat(F.lit("Prices: "), quoted_map(F.col("price_snapshot"))),
        F.concat(F.lit("Indicators: "), quoted_map(F.col("indicators"))),
        F.concat(F.lit("News: "), quoted_list(F.col("news.headline"))),
        F.lit(""),
    )


def _sections(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _or_problem(prompt: Column) -> list[Column]:
    """The prompt, or why there is none: a report that is missing or failed its checks."""
    problem = F.when(F.col("_has_report").isNull(), "no report").otherwise(F.col("problem"))
    return [F.when(problem.isNull(), prompt).alias("prompt"), problem.alias("problem")]


def _checked(reports: DataFrame) -> DataFrame:
    """Reports with their ``problem``; those that have no such column have none."""
    if "problem" not in reports.columns:
        reports = reports.withColumn("problem", F.lit(None).cast("string"))
    return reports.withColumn("_has_report", F.lit(True))


def debater_inputs(reports: DataFrame, arguments: DataFrame) -> DataFrame:
    """The request text behind each argument: the report and the debate before it.

    Every argument has a row; one of a run without a sound report has the reason
    in ``problem`` instead of a text. An argument carries the lines before it and
    not the whole debate.
    """
    so_far = Window.partitionBy("run_id").orderBy("round", "speaker", "line").rowsBetween(Window.unboundedPreceding, -1)
    turns = debate_lines(arguments).withColumn("_earlier", F.collect_list("line").over(so_far))
    earlier = F.when(F.size("_earlier") == 0, NO_HISTORY).otherwise(F.array_join("_earlier", "\n"))
    opening, closing = DEBATER_CLOSING.split("{}")
    prompt = _sections(
        F.lit(REPORT_HEADING), _report_text(), F.lit(""), F.lit(HISTORY_HEADING), earlier, F.lit(""),
        F.concat(F.lit(opening), F.col("round").cast("string"), F.lit(closing)),
    )
    return turns.join(_checked(reports), "run_id", "left").select(
        "run_id", "round",
        F.element_at(F.array(*[F.lit(s) for s in STANCES]), F.col("speaker")).alias("stance"),
        *_or_problem(prompt),
    )


def judge_inputs(reports: DataFrame, arguments: DataFrame) -> DataFrame:
    """The request text for the decision after a debate: the report and the whole debate.

    Every run with a report or an argument has a row; without a sound report the
    reason is in ``problem``.
    """
    prompt = _sections(
        F.lit(REPORT_HEADING), _report_text(), F.lit(""), F.lit(TRANSCRIPT_HEADING),
        F.coalesce("transcript", F.lit("")), F.lit(""), F.lit(JUDGE_CLOSING),
    )
    return _checked(reports).join(debate_transcripts(arguments), "run_id", "full_outer").select("run_id", *_or_problem(prompt))
