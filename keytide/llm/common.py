"""What several operators share: text columns, and cutting lineage in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keytide.functions.folders import remove, scratch
from keytide.functions.workers import ship

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates alphanumeric words (fixed value): every ASCII character but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null becomes empty. Several times faster where all is ASCII."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, AZ, AZ.lower()))


def alnum_words(text: Column) -> Column:
    """The array of words of digits, letters and non-ASCII characters, A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def row_key(text: Column) -> Column:
    """Beside the id, tells apart rows that repeat an id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(text))


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: whatever is computed from it afterwards
    survives the loss of any executor without running what came before, and sees the same rows."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*dfs: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "cut_path", None):
            remove(df.sparkSession, path)


def join_counted(left: DataFrame, right: DataFrame, on: str, count: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has one row for each key and in ``count`` how many rows of ``left`` have it. Keys that
    hold more than one in ``share`` of the rows, of which there are fewer than ``share``, are joined by broadcast, so that no task gathers them."""
    total = right.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = F.col(count) * share > F.lit(total)
    hot = F.broadcast(right.filter(often).drop(count))
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.filter(~often).drop(count), on, how)
    return left.join(hot, on).unionByName(rest)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Get Python workers ready: ship the package, and bound what Arrow hands to a worker at once, as texts may be very long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def chunks(texts: list, most: int = 1 << 20) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters, to bound what is made of them at once."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
