"""Placement scores and block digests, under two profiles.

blake2s is the one that stores use; neither Spark nor DuckDB has it, so it is a vectorised function. sha256
has the same plans made of built-in functions, so that SQL can check them; it makes no claim about blake2s.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NODE, INSTANCE = "N", "D"


@F.pandas_udf(StringType())
def _blake2s_64(data: pd.Series) -> pd.Series:
    return data.map(lambda x: hashlib.blake2s(x, digest_size=32).hexdigest()[:16], na_action="ignore")


@F.pandas_udf(StringType())
def _blake2s_256(data: pd.Series) -> pd.Series:
    return data.map(lambda x: hashlib.blake2s(x, digest_size=32).hexdigest(), na_action="ignore")


@F.pandas_udf(StringType())
def _blake2s_128(data: pd.Series) -> pd.Series:
    return data.map(lambda x: hashlib.blake2s(x, digest_size=16).hexdigest(), na_action="ignore")


def blocks_blake2s(content: Column, size: int) -> Column:
    """The digest of the ordered digests of a content's blocks; nothing has no blocks."""

    def one(data: bytes | None) -> str:
        parts = (hashlib.blake2s(data[k : k + size], digest_size=16).digest() for k in range(0, len(data or b""), size))
        return hashlib.blake2s(b"".join(parts), digest_size=32).hexdigest()

    return F.pandas_udf(lambda data: data.map(one), StringType())(content)


def score(oid: Column, domain: str, name: Column, profile: str = "blake2s") -> Column:
    """16 lower-case hex digits, which order as the unsigned 64-bit score does."""
    data = F.concat(oid, F.lit("\0" + domain), name)
    return _blake2s_64(data.cast("binary")) if profile == "blake2s" else F.substring(F.sha2(data, 256), 1, 16)


def block_digest(data: Column, profile: str = "blake2s") -> Column:
    return _blake2s_128(data) if profile == "blake2s" else F.sha2(data, 256)


def digest_of_digests(digests: Column, profile: str = "blake2s") -> Column:
    """Of an ordered array of hex digests; that of no blocks is the digest of nothing."""
    data = F.unhex(F.array_join(digests, ""))
    return _blake2s_256(data) if profile == "blake2s" else F.sha2(data, 256)
