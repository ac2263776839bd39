"""Three-way comparison of a local and a remote copy with their last common state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprints import sha256_record


def three_way_reconcile(
    base: DataFrame, local: DataFrame, remote: DataFrame, key: Sequence[str]
) -> DataFrame:
    """One decision per key; nothing is ever overwritten silently.

    A change on the local side only is reported as blocked, because the remote copy must
    be replaced deliberately.
    """
    keys = list(key)

    def hashed(df: DataFrame, name: str) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in keys)
        return df.select(*keys, sha256_record(*[F.col(c) for c in rest]).alias(name))

    every = (
        hashed(local, "local").join(hashed(remote, "remote"), keys, "full").join(hashed(base, "base"), keys, "full")
    )
    differs = lambda side: ~F.col(side).eqNullSafe(F.col("base"))
    status = (
        F.when(F.col("remote").isNull() & F.col("base").isNull(), "first_upload")
        .when(F.col("local").eqNullSafe(F.col("remote")), "up_to_date")
        .when(F.col("base").isNull(), "first_choice")
        .when(differs("local") & differs("remote"), "conflict")
        .when(differs("remote"), "pull")
        .otherwise("local_blocked")
    )
    return every.select(*keys, status.alias("status"))
