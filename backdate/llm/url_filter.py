"""URL rules, and gradient-boosted trees on lexical features for what no rule decides.

The trees learn from the urls that the rules label, each once however often it
stands. The block rates that a training url is given come from urls of other
hosts, so its own label is not among its features. Everything runs as column
expressions and Spark's own tree learner; only the url is read.

A host's suffix is its last label, or the last two where a country's label
follows one of SECOND_LEVELS (``co.uk``).

Defined results: a url that is NULL or has no ``://`` has an empty host and
path, fits no rule and is judged by its features like any other; with no
labelled url, or all of one kind, there is nothing to learn and the verdict is
that kind, else allow.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backdate.llm.common import stored

RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
TRAIN_ROWS = 20_000  # bound of the labelled sample that the trees are fitted on
SUFFIX_BUCKETS = 4096  # bound of the suffix table
PRIOR_WEIGHT = 20.0
FOLDS = 5
SECOND_LEVELS = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "n_params",
    "query_length", "n_hyphens", "has_fragment", "secure", "suffix_rate", "section_rate",
)


def split_url(pages: DataFrame, *more: str) -> DataFrame:
    """``page_id, url, host, path, rest`` (what follows the path), and the columns ``more``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    split = pages.select("page_id", "url", *more, rest.alias("rest"))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    split = split.select("page_id", "url", *more, host.alias("raw"), F.substr("rest", F.length(host) + 1).alias("rest"))
    path = F.regexp_extract("rest", r"^[^?#]*", 0)
    return split.select(
        "page_id", "url", *more, F.translate("raw", UPPER, LOWER).alias("host"), path.alias("path"),
        F.substr("rest", F.length(path) + 1).alias("rest"),
    )


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; NULL if none does."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    bits = F.aggregate(letters, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Features of the url alone, and the buckets of its host suffix and of suffix with first path segment."""
    url, host, path, rest = F.coalesce("url", F.lit("")), F.col("host"), F.col("path"), F.col("rest")
    n = F.length(url)
    two = host.rlike(rf"\.({'|'.join(SECOND_LEVELS)})\.[a-z]{{2}}$")
    suffix = F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    section = F.split_part(path, F.lit("/"), F.lit(2))
    query = F.substring_index(rest, "#", 1)
    number = lambda c: c.cast("double")
    return urls.select(
        "*",
        number(n).alias("url_length"), number(F.length(host)).alias("host_length"), number(F.length(path)).alias("path_length"),
        number(F.regexp_count(path, F.lit("/[^/]+"))).alias("depth"),
        number(F.regexp_count(host, F.lit("[^.]+"))).alias("host_labels"),
        F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0).alias("digit_ratio"),
        _entropy(url).alias("entropy"),
        number(F.regexp_count(query, F.lit("[^?&]+"))).alias("n_params"),
        number(F.length(query)).alias("query_length"),
        number(F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).alias("n_hyphens"),
        number(F.contains(rest, F.lit("#")).cast("int")).alias("has_fragment"),
        number(F.startswith(url, F.lit("https")).cast("int")).alias("secure"),
        F.pmod(F.xxhash64(suffix), F.lit(SUFFIX_BUCKETS)).cast("int").alias("suffix"),
        F.pmod(F.xxhash64(section), F.lit(SUFFIX_BUCKETS)).cast("int").alias("section"),
    )


def _fold() -> Column:
    return F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")


def _bucket_stats(labelled: DataFrame, bucket: str) -> DataFrame:
    """Labelled and blocked urls of each bucket by fold of the host: at most SUFFIX_BUCKETS rows."""
    each = lambda f: F.array(*[f(_fold() == k) for k in range(FOLDS)])
    return labelled.groupBy(bucket).agg(
        each(F.count_if).alias(f"{bucket}_n"), each(lambda mine: F.count_if(mine & (F.col("label") == 1.0))).alias(f"{bucket}_blocked")
    )


def _with_rates(rows: DataFrame, others_only: bool) -> DataFrame:
    """Block rates of the buckets, drawn towards one half where they hold few labelled urls.

    With ``others_only`` from the folds that the row's host isn't in.
    """
    for bucket in ("suffix", "section"):
        def total(name: str) -> Column:
            counts = F.col(f"{bucket}_{name}")  # noqa: B023
            whole = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
            return F.coalesce(whole - F.element_at(counts, _fold() + 1) if others_only else whole, F.lit(0))

        rows = rows.withColumn(f"{bucket}_rate", (total("blocked") + PRIOR_WEIGHT / 2) / (total("n") + PRIOR_WEIGHT))
    return rows


def url_scorer(labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 12, depth: int = 4) -> Callable[[DataFrame], DataFrame]:
    """Learn from ``labelled (url, label)``, 1.0 for block; the result adds ``block_score`` to rows of :func:`lexical`.

    Rows of one url count once, with one label. The rates count every url; the trees
    are fitted on the ``train_rows`` urls of least hash.
    """
    once = labelled.groupBy("url").agg(F.max("label").alias("label"))
    known = lexical(split_url(once.withColumn("page_id", F.lit(None)), "label"))
    known = stored(known.select("url", "host", *[f for f in FEATURES if not f.endswith("_rate")], "suffix", "section", "label"))
    stats = {b: stored(_bucket_stats(known, b)) for b in ("suffix", "section")}

    def joined(some: DataFrame) -> DataFrame:
        for bucket, table in stats.items():
            some = some.join(F.broadcast(table), bucket, "left")
        return some

    order = F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(1 << 20))
    # Half as many again as are needed meet in the last step of the limit, whatever the size of the table.
    near = known.where(order < min(1 << 20, (train_rows * 3 << 19) // max(1, known.count()) + 1))
    picked = near.orderBy(order, "url").limit(train_rows)
    train = stored(_with_rates(joined(picked), True).select(*FEATURES, "label").coalesce(1))
    n, blocked = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    model = None
    if n and blocked not in (0.0, float(n)):
        gather = VectorAssembler(inputCols=list(FEATURES), outputCol="gathered", handleInvalid="keep")
        model = GBTClassifier(
            featuresCol="gathered", labelCol="label", predictionCol="tree_prediction",
            maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7,
        ).setProbabilityCol("tree_probability").setRawPredictionCol("tree_raw").fit(gather.transform(train))

    def score(rows: DataFrame) -> DataFrame:
        scored = _with_rates(joined(rows), False)
        if model is None:
            return scored.withColumn("block_score", F.lit(1.0 if n and blocked else 0.0))
        return model.transform(gather.transform(scored)).withColumn("block_score", F.element_at(vector_to_array("tree_probability"), 2))

    return score


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, train_rows: int = TRAIN_ROWS, trees: int = 12, depth: int = 4
) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of every row of ``pages (page_id, url)``."""
    urls = split_url(pages.select("page_id", "url"))
    urls = urls.withColumn("decided", rule_of(F.col("host"), F.col("path"), rules))
    label = (F.col("decided.verdict") == "block").cast("double")
    labelled = urls.where(F.col("decided").isNotNull()).select("url", label.alias("label"))
    scored = url_scorer(labelled, train_rows, trees, depth)(lexical(urls))
    verdict = F.coalesce("decided.verdict", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("decided.rule").alias("rule"), verdict.alias("verdict"), "block_score")
