"""Run comparison, panel texts, response parsing."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
import seed
from pyspark.sql import functions as F

from backdate.functions.text import json_number, json_string, plain_number, quoted_list
from backdate.operators import evaluate, panel, responses


def test_one_pair_with_known_overheads(spark):
    run, verdict, message = seed.experiments(spark)
    (pair,) = evaluate.compare_runs(run, verdict, message).collect()
    assert (pair.bl_rec, pair.bl_conf, pair.bl_tokens, float(pair.bl_latency)) == ("hold", "medium", 699, 3.241)
    assert (pair.ma_rec, pair.ma_conf, pair.ma_tokens, float(pair.ma_latency), pair.ma_messages) == ("buy", "high", 4305, 17.621, 5)
    assert pair.agreement is False
    summary = evaluate.comparison_summary(evaluate.run_metrics(run, verdict, message)).first()
    assert (summary.pairs, summary.agreements, summary.agreement_pct) == (1, 0, 0.0)
    assert (round(summary.token_multiplier, 1), round(summary.latency_multiplier, 1)) == (6.2, 5.4)
    line = evaluate.comparison_report(evaluate.compare_runs(run, verdict, message)).first()
    assert (line.baseline, line.multi_agent, line.status) == ("HOLD (medium)", "BUY (high)", "DIVERGED")
    assert (line.tokens, line.latency) == ("699 / 4,305", "3.2s / 17.6s")
    shift = evaluate.confidence_shift(evaluate.run_metrics(run, verdict, message)).collect()
    assert [tuple(r) for r in shift] == [("medium", "high", 1, 1)]


def many_runs(spark):
    """Two baseline runs beside two multi-agent runs, one without messages; and lonely runs."""
    rows = [
        ("b1", "X", "2024-01-01", "baseline", "completed", "buy", "low"),
        ("b2", "X", "2024-01-01", "baseline", "completed", "sell", "high"),
        ("m1", "X", "2024-01-01", "multi_agent", "completed", "buy", "high"),
        ("m2", "X", "2024-01-01", "multi_agent", "completed", "buy", "medium"),
        ("b3", "Y", "2024-01-01", "baseline", "completed", "buy", "low"),
        ("m3", "Y", "2024-01-02", "multi_agent", "completed", "buy", "low"),
        ("b4", "Z", "2024-01-01", "baseline", "completed", None, None),
        ("m4", "Z", "2024-01-01", "multi_agent", "completed", "buy", "low"),
    ]
    run = spark.createDataFrame([(i, t, seed.day(d), m, s) for i, t, d, m, s, _, _ in rows],
                                "id string, ticker string, as_of_date date, mode string, status string")
    verdict = spark.createDataFrame([(i, r, c) for i, _, _, _, _, r, c in rows if r], "run_id string, recommendation string, confidence string")
    message = spark.createDataFrame(
        [("b1", 10, None, Decimal("1.000")), ("b1", None, 5, Decimal("0.500")), ("b2", 20, 0, Decimal("2.000")),
         ("m1", 100, 50, Decimal("9.000"))],
        "run_id string, prompt_tokens int, completion_tokens int, latency_s decimal(8,3)",
    )
    return run, verdict, message


def test_repeated_modes_multiply_and_summary_equals_the_pairs(spark):
    run, verdict, message = many_runs(spark)
    pairs = evaluate.compare_runs(run, verdict, message)
    rows = pairs.collect()
    assert len(rows) == 4 and {r.ma_messages for r in rows} == {0, 1}
    summary = evaluate.comparison_summary(evaluate.run_metrics(run, verdict, message)).first()
    bl, ma = sum(r.bl_tokens for r in rows), sum(r.ma_tokens for r in rows)
    assert (summary.pairs, summary.agreements) == (4, sum(r.agreement for r in rows))
    assert (summary.bl_tokens, summary.ma_tokens) == (bl, ma)
    assert summary.token_multiplier == pytest.approx(ma / bl, abs=1e-4)
    assert summary.latency_multiplier == pytest.approx(
        float(sum(r.ma_latency for r in rows) / sum(r.bl_latency for r in rows)), abs=1e-4)
    assert summary.mean_token_ratio == pytest.approx(sum(r.ma_tokens / r.bl_tokens for r in rows) / 4, abs=1e-4)
    shift = {(r.bl_conf, r.ma_conf): r.pairs for r in evaluate.confidence_shift(evaluate.run_metrics(run, verdict, message)).collect()}
    assert shift == {("low", "high"): 1, ("low", "medium"): 1, ("high", "high"): 1, ("high", "medium"): 1}


def test_no_pairs(spark):
    run, verdict, message = many_runs(spark)
    only = evaluate.run_metrics(run.where("mode = 'baseline'"), verdict, message)
    row = evaluate.comparison_summary(only).first()
    assert row.pairs == 0 and row.agreement_pct is None and row.token_multiplier is None
    assert evaluate.comparison_summary(only.where("false")).first().pairs == 0
    assert evaluate.confidence_shift(only).count() == 0


def test_zero_baseline_tokens_give_multiplier_zero(spark):
    run, verdict, message = many_runs(spark)
    row = evaluate.comparison_summary(evaluate.run_metrics(run, verdict, message.where("run_id like 'm%'"))).first()
    assert row.pairs == 4 and row.token_multiplier == 0.0 and row.mean_token_ratio is None


def test_distribution_attempts_and_filters(spark):
    run, verdict, message = seed.experiments(spark)
    assert {tuple(r) for r in evaluate.verdict_distribution(run, verdict).collect()} == {("hold", "baseline", 1), ("buy", "multi_agent", 1)}
    bear = evaluate.attempt_counts(message).where("agent_name = 'bear'").first()
    assert (bear.max_attempt, bear.n_failed, bear.n_messages) == (2, 1, 2)
    assert evaluate.messages_of(message, "bear").count() == 2
    assert [r.run_id for r in evaluate.verdicts_with(verdict, "high").collect()] == ["run-ma"]
    grid = evaluate.experiment_grid(seed.requests(spark, ("AAPL", "2024-01-15"), ("AAPL", "2024-03-01")))
    assert grid.count() == 4


def test_panel_prompt_and_analyst_input(spark):
    asked = seed.requests(spark, ("AAPL", "2024-03-01"), ("AAPL", "2024-01-05"))
    rows = panel.research_panel(asked, seed.bars(spark), seed.news(spark))
    one = {str(r.as_of): r for r in rows.collect()}
    assert one["2024-03-01"].rsi_14 == 39.70 and len(one["2024-03-01"].news) == 5
    assert one["2024-01-05"].news == [] and one["2024-01-05"].rsi_14 is None
    prompts = {str(r.as_of): r.prompt for r in panel.baseline_prompts(rows).collect()}
    assert prompts["2024-01-05"].split("\n") == [
        "Ticker: AAPL", "As of date: 2024-01-05", "", "Price snapshot:", "  last_close: 181.18",
        "  pct_change_1d: -0.4", "  pct_change_5d: None", "  pct_change_21d: None", "", "Technical indicators:",
        "  rsi_14: None", "  macd: None", "  macd_signal: None", "  macd_histogram: None", "", "Recent news:",
        "  (no recent news available)", "", "Based only on the data above, decide buy, hold, or sell.",
    ]
    assert "  [2024-02-08] (Market Courier) Fewer phones shipped in the east — The third quarter in a row." in prompts["2024-03-01"]
    given = {str(r.as_of): r for r in panel.analyst_inputs(rows).collect()}
    assert json.loads(given["2024-01-05"].indicators_json) == {"rsi_14": None, "macd": None, "macd_signal": None, "macd_histogram": None}
    assert json.loads(given["2024-03-01"].news_json)[0]["date"] == "2024-02-08"
    assert json.loads(given["2024-03-01"].snapshot_json)["last_close"] == 180.75
    for r in given.values():
        for text in (r.snapshot_json, r.indicators_json, r.news_json):
            assert text == json.dumps(json.loads(text))


def test_json_is_written_as_python_writes_it(spark):
    numbers = [0.0, -0.0, 12345678.5, 0.00012, -0.00095, 1e16, 1.5e-05, 123456789012345.6, 1e15, 180.75, 100.0, 3e17, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(json_number(F.col("x"))).collect()] == [json.dumps(x) for x in numbers]
    texts = ["", "plain", 'say "x" \\ y', "a\nb\tc\rd\fe\bf", "ö—é", "😀 astral", "\x00\x1f\x7f", "\u2028", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(json_string(F.col("x"))).collect()] == [json.dumps(x) for x in texts]


def test_texts_read_like_python_literals(spark):
    lists = [[], ["a"], ["it's", 'say "x"', "both ' and \""], ["line\nbreak", "tab\t", "back\\slash"], ["é—"],
             ["\x00\x1b\x7f", "soft\xadhyphen", "no\xa0break", "\u200b\u2028", "😀\U000e0001"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>")
    got = [r[0] for r in df.orderBy("i").select(quoted_list(F.col("x"))).collect()]
    assert got == [repr(x) for x in lists]
    numbers = [0.0, 100.0, 12.5, -0.37, 12345678.9, 0.0001, 180.75, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(plain_number(F.col("x"), 4)).collect()]
    assert got == ["0.0", "100.0", "12.5", "-0.37", "12345678.9", "0.0001", "180.75", "None"]


def test_transcript_order(spark):
    rows = [("r", 2, "bear", ["d"], []), ("r", 1, "bear", ["b"], ["a"]), ("r", 2, "bull", ["c"], None), ("r", 1, "bull", ["a"], [])]
    df = spark.createDataFrame(rows, "run_id string, round int, stance string, claims array<string>, rebuttal_to array<string>")
    row = panel.debate_transcripts(df).first()
    assert row.n_arguments == 4 and row.transcript.split("\n") == [
        "Round 1 BULL: Claims: ['a']. Rebuttals: []", "Round 1 BEAR: Claims: ['b']. Rebuttals: ['a']",
        "Round 2 BULL: Claims: ['c']. Rebuttals: []", "Round 2 BEAR: Claims: ['d']. Rebuttals: []",
    ]


def test_debate_prompts(spark):
    arguments = spark.createDataFrame(
        [("r", 1, "bear", ["b"], ["a"]), ("r", 1, "bull", ["a"], [])],
        "run_id string, round int, stance string, claims array<string>, rebuttal_to array<string>",
    )
    payload = {
        "price_snapshot": {"last_close": 180.75, "pct_change_21d": None}, "indicators": {"rsi_14": 39.7},
        "news": [{"headline": "It's up", "source": "s", "published": "2024-02-01", "summary": ""}], "key_points": ["k"],
    }
    messages = spark.createDataFrame([("r", json.dumps(payload)), ("quiet", json.dumps(payload))], "run_id string, payload string")
    reports = responses.parse_reports(messages)
    report = (
        f"Key Points: {payload['key_points']}\nPrices: {payload['price_snapshot']}\n"
        f"Indicators: {payload['indicators']}\nNews: {[n['headline'] for n in payload['news']]}\n"
    )
    first = "Round 1 BULL: Claims: ['a']. Rebuttals: []"
    second = "Round 1 BEAR: Claims: ['b']. Rebuttals: ['a']"
    asked = {r.stance: r.prompt for r in panel.debater_inputs(reports, arguments).collect()}
    head = f"--- Analyst Report ---\n{report}\n\n"
    assert asked["bull"] == head + "--- Debate History ---\nNone\n\nGenerate your Round 1 argument."
    assert asked["bear"] == head + f"--- Debate History ---\n{first}\n\nGenerate your Round 1 argument."
    judged = {r.run_id: r.prompt for r in panel.judge_inputs(reports, arguments).collect()}
    assert judged["r"] == head + f"--- Debate Transcript ---\n{first}\n{second}\n\nDeliver your final JudgeVerdict."
    assert judged["quiet"] == head + "--- Debate Transcript ---\n\n\nDeliver your final JudgeVerdict."


def test_payloads_are_validated(spark):
    good = {"recommendation": "buy", "reasoning": "r", "strongest_counterpoint": "s", "confidence": "low"}
    cases = {
        "ok": json.dumps(good), "enum": json.dumps({**good, "confidence": "sure"}),
        "missing": json.dumps({k: v for k, v in good.items() if k != "reasoning"}),
        "broken": json.dumps(good)[:-1], "text": "no json", "error": json.dumps({"error": "x"}),
    }
    df = spark.createDataFrame(list(cases.items()), "run_id string, payload string")
    got = {r.run_id: r for r in responses.parse_verdicts(df).collect()}
    assert got["ok"].problem is None and got["ok"].recommendation == "buy"
    assert got["enum"].problem == "confidence not allowed" and got["enum"].recommendation is None
    assert got["missing"].problem == "missing reasoning"
    assert got["broken"].problem == got["text"].problem == "not valid JSON for the schema"
    assert got["error"].problem == "missing recommendation"
    assert [r[0] for r in df.where("run_id = 'error'").select(responses.failure_reason()).collect()] == ["x"]
    args = spark.createDataFrame([
        ("a", json.dumps({"stance": "bull", "round": 1, "claims": ["c"]})), ("b", json.dumps({"stance": "calf", "round": 1, "claims": []})),
    ], "run_id string, payload string")
    parsed = {r.run_id: r for r in responses.parse_arguments(args).collect()}
    assert parsed["a"].rebuttal_to == [] and parsed["a"].claims == ["c"] and parsed["b"].problem == "stance not allowed"


def test_calls_are_numbered_across_and_within_minutes(spark):
    t0 = dt.datetime(2024, 3, 15, 9, 50)
    attempts = [1, 2, 1, 1, 2, 3, 1]
    success = [False, True, True, False, False, False, True]
    rows = [("r", "bull", a, ok, f"p{i}", "m", t0 + dt.timedelta(seconds=40 * i)) for i, (a, ok) in enumerate(zip(attempts, success))]
    df = spark.createDataFrame(rows, "run_id string, agent_name string, attempt int, success boolean, payload string, model string, created_at timestamp")
    got = [tuple(r) for r in responses.final_attempts(df).orderBy("call_no").select(
        "call_no", "n_attempts", "n_failed", "final_attempt", "payload", "succeeded").collect()]
    assert got == [(1, 2, 1, 2, "p1", True), (2, 1, 0, 1, "p2", True), (3, 3, 3, None, None, False), (4, 1, 0, 1, "p6", True)]


def test_messages_are_normalised(spark):
    calls = spark.createDataFrame(
        [("bull", "m", 1, 5, None, 1.23456, {"a": "b"}, "2024-03-15T09:00:00+00:00", True)],
        "agent string, model string, attempt int, prompt_tokens int, completion_tokens int, latency_s double, "
        "payload map<string,string>, timestamp string, success boolean",
    )
    row = responses.normalise_messages(calls, "r1").first()
    assert (row.run_id, row.agent_name, row.latency_s, json.loads(row.payload)) == ("r1", "bull", Decimal("1.235"), {"a": "b"})
