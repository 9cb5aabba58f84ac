"""Quality rules judged by host.

Each document is measured by rules. Their failures are counted by host, a
host's rate is drawn towards a beta prior fitted to the rates of all hosts, and
a host whose rate stays too high is distrusted on that rule. A document goes if
it fails a base rule, or fails a rule on which its host is distrusted: single
failures on a sound host are forgiven, a document that fails no rule is never
dropped. Only column expressions are used.

Defined results: a NULL or empty text has no words and fails the base rule;
NULL is a host of its own; repeated rows are judged alike and each counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backdate.llm.common import SPACES, WORD, stored

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # of 100 words
MOST_SYMBOLS = 0.1  # a word
MOST_DUP_LINES = 0.3  # of all lines with a word
WORD_LENGTH = (3.0, 12.0)
TRUSTED_RATE = 0.02


def _repeated(words: DataFrame) -> DataFrame:
    """Replace ``words`` by its number and the words lying in windows of 8 that occur twice or more in the text.

    Windows are compared by 64-bit hash. Most texts repeat none, which the
    number of different hashes tells; only the others are sorted. Each step is a
    column of its own, so that none is worked out twice.
    """
    last = F.size("words") - WINDOW
    hashed = words.withColumn("hashes", F.when(
        last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    )).withColumn("n_words", F.size("words").cast("long")).drop("words")
    placed = hashed.withColumn("placed", F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )).drop("hashes")
    at = lambda i: F.get("placed", i)["h"]
    # Starts of windows with a twin beside them; past the ends, get() is NULL.
    twins = F.filter(F.transform("placed", lambda r, i: F.when((at(i - 1) == r["h"]) | (at(i + 1) == r["h"]), r["i"])),
                     lambda p: p.isNotNull())
    # Windows are equally long, so each adds what lies beyond the one before.
    covered = F.aggregate(
        F.array_sort(twins),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["at"])).cast("long").alias("n"), p.alias("at")),
        lambda s: s["n"],
    )
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("placed")


def measures(docs: DataFrame, keep: str | None = None) -> DataFrame:
    """``doc_id``, host and the base measures of every document; ``keep`` names a struct to hold its whole row."""
    row = [F.struct(*docs.columns).alias(keep)] if keep else []
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        *row, F.col("doc_id"), F.col("source").alias("host"), text.alias("text"),
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    text = F.col("text")
    return _repeated(split.select(
        *[keep] * bool(keep), "doc_id", "host", "words",
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ))


RULES = {
    "few_words": lambda c: c("n_words") < LEAST_WORDS,
    "repeated": lambda c: 100 * c("n_repeat_words") > MOST_REPEATED * c("n_words"),
    "symbols": lambda c: c("n_symbols") > MOST_SYMBOLS * c("n_words"),
    "dup_lines": lambda c: c("n_dup_lines") > MOST_DUP_LINES * c("n_lines"),
    "word_length": lambda c: (c("word_chars") < WORD_LENGTH[0] * c("n_words")) | (c("word_chars") > WORD_LENGTH[1] * c("n_words")),
}
BASE_RULES = ("few_words", "repeated")


def host_verdicts(failed: DataFrame, trusted_rate: float = TRUSTED_RATE) -> DataFrame:
    """``host`` and, per rule, whether it is distrusted, from ``failed (host, one boolean per rule)``.

    The prior of a rule is the beta distribution with the mean and, beyond what
    chance explains, the variance of the hosts' rates. Where hosts differ no more
    than chance, it is as strong as the mean number of documents of a host.
    """
    counts = failed.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r)).alias(r) for r in RULES]
    )
    counts = stored(counts)
    rate = lambda r: F.col(r) / F.col("n")
    # One row of numbers, whatever the number of hosts.
    moments = counts.agg(
        F.avg("n").alias("mean_n"), F.avg(1 / F.col("n")).alias("inv_n"),
        *[(F.sum(r) / F.sum("n")).alias(f"{r}_mean") for r in RULES],
        *[F.var_pop(rate(r)).alias(f"{r}_var") for r in RULES],
    ).first()

    def posterior(r: str) -> Column:
        m, v = F.lit(moments[f"{r}_mean"]).cast("double"), F.lit(moments[f"{r}_var"]).cast("double")
        beyond = v - m * (1 - m) * F.lit(moments["inv_n"]).cast("double")
        strength = F.when(beyond > 0, F.greatest(m * (1 - m) / beyond - 1, F.lit(1.0))).otherwise(
            F.lit(moments["mean_n"]).cast("double")
        )
        return (F.col(r) + m * strength) / (F.col("n") + strength)

    return counts.select(
        "host", F.col("n").alias("host_docs"),
        *[posterior(r).alias(f"{r}_rate") for r in RULES],
        *[(posterior(r) > trusted_rate).alias(f"{r}_distrusted") for r in RULES],
    )


def _failures() -> list[Column]:
    return [rule(F.col).alias(name) for name, rule in RULES.items()]


def _verdict(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    verdicts = verdicts.select(F.col("host").alias("v_host"), *[f"{r}_distrusted" for r in RULES])
    base, rejects = F.lit(False), F.lit(False)
    for r in BASE_RULES:
        base = base | F.col(r)
    for r in RULES:
        rejects = rejects | (F.col(r) & F.col(f"{r}_distrusted"))
    joined = measured.join(verdicts, measured["host"].eqNullSafe(verdicts["v_host"]))
    return joined.withColumns({"base_failed": base, "host_rejects": rejects, "kept": ~base & ~rejects})


def judge(docs: DataFrame, trusted_rate: float = TRUSTED_RATE) -> DataFrame:
    """Measures, ``base_failed``, ``host_rejects`` and ``kept`` of every row of ``docs (doc_id, source, text)``."""
    measured = stored(measures(docs).select("*", *_failures()))
    verdicts = stored(host_verdicts(measured.select("host", *RULES), trusted_rate))
    return _verdict(measured, verdicts).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_rejects", "kept",
    )


def kept_documents(docs: DataFrame, trusted_rate: float = TRUSTED_RATE) -> DataFrame:
    """The documents that stay, with their own columns.

    Rows are measured and stored whole, so that a row keeps its own verdict even
    if its id isn't its own.
    """
    measured = stored(measures(docs, keep="row").select("row", "host", *_failures()))
    verdicts = stored(host_verdicts(measured.select("host", *RULES), trusted_rate))
    return _verdict(measured, verdicts).where("kept").select("row.*")
