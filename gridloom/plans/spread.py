"""Lookups that a hot key doesn't gather in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_lookup(rows: DataFrame, key: str, table: DataFrame, salts: int = 64, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (one row for each ``key``) without gathering a hot key in one task.

    Rows get a random-looking salt; the keys in use are found for each salt by partial
    aggregation, so a hot key has ``salts`` rows at most there. Those are joined to the table,
    and the rows then join on key and salt. ``how`` is inner or left.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[rows[c] for c in rows.columns]), F.lit(salts)).cast("int"))
    used = salted.groupBy(key, "__salt").agg(F.lit(1).alias("__used")).drop("__used")
    found = used.join(table, key)
    return salted.join(found, [key, "__salt"], how).drop("__salt")
