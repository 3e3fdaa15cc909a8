"""The changelog schema: one row per version of a key.

``key`` is STRING or BINARY (both order bytewise), ``seq`` a 56-bit positive LONG, ``op`` is
``PUT`` or ``DELETE``; ``value`` is NULL exactly when the row is a tombstone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

PUT, DELETE = 1, 2
MAX_SEQ = (1 << 56) - 1
N_LEVELS = 7


class KeyNotFound(KeyError):
    """The key is absent or its newest visible version is a tombstone."""


class InvalidRecord(ValueError):
    """An empty key, an empty batch, an unknown op or a sequence number out of range."""


def changelog_schema(kind: str = "string") -> T.StructType:
    of = {"string": T.StringType(), "binary": T.BinaryType()}[kind]
    return T.StructType([T.StructField("key", of, False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.ByteType(), False), T.StructField("value", of)])


def check_key(key) -> None:
    if key is None or len(key) == 0:
        raise InvalidRecord("empty key")


def normalise(log: DataFrame) -> DataFrame:
    """The four changelog columns with the rules enforced on the executors: a put of NULL becomes an
    empty value, a delete never carries one, and a bad row fails the job instead of passing through."""
    kind = log.schema["value"].dataType
    op = F.col("op").cast("byte")
    bad = F.coalesce((F.length("key") == 0) | ~op.isin(PUT, DELETE) | (F.col("seq") < 1) | (F.col("seq") > MAX_SEQ), F.lit(True))
    return log.select(
        F.when(bad, F.raise_error(F.lit("invalid changelog row"))).otherwise(F.col("key")).alias("key"),
        F.col("seq").cast("long").alias("seq"),
        op.alias("op"),
        F.when(op == DELETE, F.lit(None)).otherwise(F.coalesce(F.col("value"), F.lit("").cast(kind))).alias("value"),
    )
