"""What the operators share: the word rule, tables, and tables stored on the way."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="backdate-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine without it, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


def stored(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back.

    It cuts lineage, survives lost executors and gives Spark the table's real
    size for choosing joins. The folder's owner cleans it.
    """
    path = f"{shared_folder(df.sparkSession)}/backdate-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    """Where a file of the installed public tokenizers lies, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)
