"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in the "blank" tokenisation.
BLANKS = r"[\x20\x09-\x0D]+"
#: Everything in ASCII that is no letter or digit, for the "alphanumeric" tokenisation.
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII text takes the fast built-in path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blank_words(text: Column) -> Column:
    """Words between ASCII blanks; null and blank text give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), "")


def alnum_words(text: Column) -> Column:
    """Runs of [0-9a-z] and non-ASCII characters after ASCII lower-casing; null gives an empty array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_ALNUM, -1), "")


def joined_hashes(left: Column, right: Column, shift: int) -> Column:
    """Hash of left[i] and right[i + shift] for each i at which both exist; an array of longs.

    Chained, it turns hashes of words into hashes of windows with few lambda calls: 1 -> 2 -> 4 -> 5 words.
    ``left`` and ``right`` have to be columns of the frame, as they are used more than once.
    """
    n = F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(shift + 1), n), lambda a, b: F.xxhash64(a, b))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no recomputation of its lineage.

    The folder is that of ``spark.checkpoint.dir``; where it is unset, one under the warehouse, which executors share too.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver drop the shuffle files of frames that are gone; else they stay on disk until it happens to collect."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rounded(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits)


def worker_state() -> dict:
    """What a Python worker keeps from task to task, such as loaded models and their caches."""
    import types

    return vars(sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state")))


def by_value(module: str) -> None:
    """Send this module's functions to Python workers as code, so that workers need not find the package themselves."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)
