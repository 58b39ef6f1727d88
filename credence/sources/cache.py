"""The summary cache: a table keyed by a hash of everything a file's facts depend on."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Raised whenever facts gain or change a column, so that older rows no longer match.
SCHEMA_VERSION = "2"


def cache_key(module: Column, source: Column, policy: str) -> Column:
    """Each part goes with its length, so that no two different parts give the same bytes."""
    parts = [module, F.sha2(source.cast("binary"), 256), F.lit(SCHEMA_VERSION), F.lit(policy)]
    sized = [F.concat(F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]
    return F.sha2(F.concat(*sized), 256)


def split_by_cache(files: DataFrame, cached: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the cache that still hold, files to analyse); only keys are compared."""
    keyed = files.withColumn("cache_key", cache_key(F.col("path"), F.col("source"), policy))
    keys = keyed.select("cache_key")
    return cached.join(keys, "cache_key", "left_semi"), keyed.join(cached.select("cache_key"), "cache_key", "left_anti")


def _tags(secret: bytes):
    """A column function: the HMAC-SHA256 of a digest.  Only digests go to Python, and the secret is in no plan."""

    @F.pandas_udf("string")
    def tag(digests: pd.Series) -> pd.Series:
        return digests.map(lambda d: hmac.new(secret, d.encode(), hashlib.sha256).hexdigest())

    return tag


def _content(df: DataFrame) -> Column:
    """A digest of all columns of a row but its MAC, each with its name and length."""
    texts = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(c for c in df.columns if c != "mac")]
    return F.sha2(F.concat(*[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)


def signed(rows: DataFrame, secret: bytes) -> DataFrame:
    """``rows`` of a cache with a MAC of each."""
    return rows.withColumn("mac", _tags(secret)(_content(rows)))


def verified(rows: DataFrame, secret: bytes) -> DataFrame:
    """The rows of a cache whose MAC is right; what was changed since is analysed again, as if it weren't there."""
    return rows.filter(F.col("mac") == _tags(secret)(_content(rows)))


def policy_hash(policy: dict) -> str:
    """A hash of the settings that change results."""
    from credence.sources.sinks import canonical_json

    return hashlib.sha256(canonical_json(policy)).hexdigest()
