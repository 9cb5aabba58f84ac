"""Reading and writing the engine's tables, and publishing several at once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backdate.schemas import DEFAULTS, TABLES


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table with its declared schema; columns and filters are pruned by the scan."""
    return spark.read.schema(TABLES[table]).parquet(path)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Declared columns, order and types; absent columns take the table's default, else NULL.

    A column declared ``not null`` that is absent and has no default raises here,
    a NULL in one when the rows are written.
    """
    fields = T.StructType.fromDDL(TABLES[table]).fields
    defaults = DEFAULTS.get(table, {})
    lacking = [f.name for f in fields if not f.nullable and f.name not in df.columns and f.name not in defaults]
    if lacking:
        raise ValueError(f"{table} needs {', '.join(lacking)}")

    def column(f: T.StructField) -> Column:
        default = F.lit(defaults.get(f.name))
        value = F.col(f.name) if f.name in df.columns else default
        if f.name in df.columns and f.name in defaults:
            value = F.coalesce(value, default)
        value = value.cast(f.dataType)
        if not f.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"NULL in {table}.{f.name}"))).otherwise(value)
        return value.alias(f.name)

    return df.select(*[column(f) for f in fields])


def begin_runs(requests: DataFrame, mode: str, started_at: dt.datetime | str, **models: str) -> DataFrame:
    """Run rows for requests: ``running`` since the caller's clock, named by a hash of what makes a run."""
    start = F.lit(str(started_at)).cast("timestamp")
    columns = {name: F.lit(value) for name, value in models.items()}
    return conform(
        requests.select("ticker", F.col("as_of").alias("as_of_date"), F.lit(mode).alias("mode"), start.alias("started_at")).withColumns({
            "id": F.substring(F.sha2(F.concat_ws("|", "ticker", "as_of_date", "mode", "started_at"), 256), 1, 32), **columns,
        }), "run",
    )


def append_rows(df: DataFrame, path: str, table: str) -> None:
    """Append run, message, verdict or observation rows. No rows, no files."""
    conform(df, table).write.mode("append").parquet(path)


def write_versions(df: DataFrame, path: str, key_date: str, keys: Sequence[str], files_per_year: int) -> None:
    """Replace the touched years of a versioned table.

    Partitioned by year of its valid time; a year's rows are dealt to
    ``files_per_year`` files by a hash of the whole key, so a hot ticker is in
    all of them, and sorted by ticker and date inside, so that both prune. Rows
    go to tasks by number, not by a hash of year and file: each file of a year
    has a task that none of the year's other files shares, and years that meet
    in a task are written to a file each.
    """
    file = F.pmod(F.xxhash64(*keys), F.lit(files_per_year)).cast("int")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, -(-tasks // files_per_year))  # years side by side
    year = F.coalesce(F.year(key_date), F.lit(0))
    (
        df.withColumn("valid_year", F.year(key_date))
        .withColumn("_task", (year % rounds * files_per_year + file).cast("int"))
        .repartitionById(rounds * files_per_year, "_task")
        .sortWithinPartitions("valid_year", "ticker", key_date)
        .drop("_task")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("valid_year")
        .parquet(path)
    )


def touched_years(rows: DataFrame, key_date: str) -> list[int]:
    """The years of valid time that rows fall in; as few numbers as there are years."""
    years = rows.select(F.year(key_date).alias("y")).where("y IS NOT NULL").distinct().collect()
    return sorted(r["y"] for r in years)


def read_years(spark: SparkSession, path: str, table: str, years: Sequence[int]) -> DataFrame:
    """Those years of a table that :func:`write_versions` stores; no other directory is listed in the scan."""
    stored = spark.read.schema(f"{TABLES[table]}, valid_year int").parquet(path)
    return stored.where(F.col("valid_year").isin(*years)).drop("valid_year")


def read_asked(
    spark: SparkSession, path: str, table: str, requests: DataFrame, lookback_days: int | None = None
) -> DataFrame:
    """The years of a stored versioned table that some request can see, found while the query runs.

    With a look-back, the years between a request's oldest and its own day; the
    scan lists only those directories (dynamic partition pruning), also where
    requests lie decades apart. They are one number a year from 1 to 9999, hence
    at most 9,999 rows to broadcast. Without one, every year up to the newest
    request. No action runs here. Rows without a year are seen by no request.
    """
    stored = spark.read.schema(f"{TABLES[table]}, valid_year int").parquet(path)
    if lookback_days is None:
        newest = requests.agg(F.year(F.max("as_of"))).scalar()
        return stored.where(F.col("valid_year") <= newest).drop("valid_year")
    oldest = F.date_sub("as_of", lookback_days - 1)
    years = (
        requests.where(F.col("as_of").isNotNull())
        .select(F.explode(F.sequence(F.year(oldest), F.year("as_of"))).alias("valid_year"))
        .where(F.col("valid_year").between(1, 9999)).distinct()
    )
    return stored.join(F.broadcast(years), "valid_year", "left_semi").drop("valid_year")


def write_observed(
    df: DataFrame, rules: Mapping[str, Column], write: Callable[[DataFrame], None]
) -> dict[str, int]:
    """Write rows and count, in the same pass, how many break each rule; also ``rows``, how many there were.

    ``write`` gets the rows and must write them as they come: the counts belong to
    the writing tasks, of which each partition's successful one counts once. A
    shuffle behind the counts could count a task's rows again when an executor is lost.
    """
    seen = Observation()
    counts = [F.count_if(broken).alias(f"r{i}") for i, broken in enumerate(rules.values())]
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts))
    found = seen.get
    return {"rows": found["rows"], **{rule: found[f"r{i}"] for i, rule in enumerate(rules)}}


def update_years(
    change: DataFrame, path: str, table: str, key_date: str, keys: Sequence[str], files_per_year: int,
    apply: Callable[[DataFrame, DataFrame], DataFrame],
) -> list[int]:
    """Apply a batch or a delta to a stored versioned table, reading and rewriting only the years it touches.

    ``apply(current, change)`` gets the rows of those years and returns all that is
    to stand there; a row moves to no other year, since its date is part of its key.
    The new files replace a year's old ones when the job commits, so a failed write
    leaves the table as it was. Years that lose all rows keep their old files: a
    versioned table never forgets a key. Rows without a date are refused. Returns the years.
    """
    spark = change.sparkSession
    if change.where(F.col(key_date).isNull()).limit(1).count():
        raise ValueError(f"rows without {key_date} belong to no year")
    years = touched_years(change, key_date)
    if years:
        write_versions(apply(read_years(spark, path, table, years), change), path, key_date, keys, files_per_year)
    return years


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str) -> None:
    """Save as a catalog table at ``path``, bucketed and sorted by its whole key.

    Per-key windows and joins on that key then read it without a shuffle. The
    whole key spreads evenly; the ticker alone would put a hot one in one bucket.
    """
    (
        df.repartition(buckets, *keys)
        .write.mode("overwrite").format("parquet")
        .bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
        .saveAsTable(name)
    )


def dump(df: DataFrame, path: str, order_by: Sequence[str], fmt: str = "json") -> None:
    """A full, globally ordered copy of a table for inspection (range-partitioned sort)."""
    df.orderBy(*order_by).write.mode("overwrite").format(fmt).save(path)


MANIFEST = "version long, tables array<string>, writer string, batch long"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per publish; empty before the first."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/_manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def publish(
    tables: Mapping[str, DataFrame], root: str, version: int | None = None, batch: tuple[str, int] | None = None
) -> int:
    """Write a set of tables under a new version, then name it in one manifest row; returns the version.

    Readers see the old set until the manifest commits, and the whole new set
    after. The version is the next one, or a higher one that the caller gives;
    one that is already published raises. ``batch`` names a writer and its batch:
    the same batch again publishes nothing and returns what it had published.
    """
    spark = next(iter(tables.values())).sparkSession
    known = manifest(spark, root)
    if batch is not None:
        done = known.where((F.col("writer") == batch[0]) & (F.col("batch") == batch[1])).first()
        if done is not None:
            return done["version"]
    newest = known.agg(F.max("version")).first()[0] or 0
    version = newest + 1 if version is None else version
    if version <= newest:
        raise ValueError(f"version {version} is not above the published {newest} under {root}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/version={version}")
    writer, number = batch or (None, None)
    row = spark.createDataFrame([(version, sorted(tables), writer, number)], MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{root}/_manifest")
    return version


def published_version(spark: SparkSession, root: str) -> int | None:
    """Newest version named in the manifest."""
    return manifest(spark, root).agg(F.max("version")).first()[0]


def read_published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table as of the newest version that has it."""
    found = manifest(spark, root).where(F.array_contains("tables", table)).agg(F.max("version")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no {table} published under {root}")
    return spark.read.parquet(f"{root}/{table}/version={found}")
