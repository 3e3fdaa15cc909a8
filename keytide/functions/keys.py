"""Predicates on the key column in a form that reaches the Parquet scan.

A prefix becomes the half-open range ``[p, successor(p))``: range comparisons are pushed down for
BINARY and STRING keys alike, whereas ``startswith`` on BINARY is not.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_bytes(key) -> bytes | None:
    return key.encode() if isinstance(key, str) else None if key is None else bytes(key)


def successor(prefix):
    """The smallest key above every key with this prefix, None if there is none.

    For a string, the last code point below U+10FFFF is raised (skipping the surrogates); UTF-8 byte
    order equals code point order, so the range is exact. For bytes, the last byte below 0xff is.
    """
    if isinstance(prefix, str):
        cut = prefix.rstrip("\U0010ffff")
        if not cut:
            return None
        up = ord(cut[-1]) + 1
        return cut[:-1] + chr(0xE000 if 0xD800 <= up <= 0xDFFF else up)
    cut = bytes(prefix).rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def literal(key) -> Column:
    return F.lit(bytearray(key) if isinstance(key, bytes) else key)


def in_range(start=None, end=None) -> Column:
    """start <= key < end; a None bound is open."""
    out = F.lit(True)
    if start is not None:
        out = F.col("key") >= literal(start)
    if end is not None:
        out = out & (F.col("key") < literal(end)) if start is not None else F.col("key") < literal(end)
    return out


def has_prefix(prefix) -> Column:
    return in_range(prefix if len(prefix) else None, successor(prefix) if len(prefix) else None)
