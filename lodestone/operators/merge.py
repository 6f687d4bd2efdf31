"""State changes as functions of the old state and a delta: a new table is written, none is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a column of an upsert takes the delta's value.
POLICIES = ("filled", "given", "kept", "greatest")


def last_filled(delta: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """One row a key: each column's last value that is neither null nor empty."""
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    at = F.struct(F.col(seq), *[F.col(c).cast("string") for c in sorted(columns)])  # rows of one seq have an order too
    pick = [F.max_by(F.col(c), F.when(filled(c).isNotNull(), at)).alias(c) for c in columns]
    pick += [F.max_by(F.struct(c), at).alias(f"__last_{c}") for c in columns]
    return delta.groupBy(key).agg(*pick, F.count("*").alias("__n"))


def upsert(old: DataFrame, delta: DataFrame, key: str, seq: str, policies: dict[str, str], counter: str | None = None) -> DataFrame:
    """Full outer join of old and the folded delta.

    filled: the delta's last value that is neither null nor empty, else the old one. given: the delta's last value wherever the
    key is in it, be it empty. kept: the old value where there is one. greatest: the larger one. counter: old value plus the key's rows in the delta.
    """
    names = list(policies)
    new = last_filled(delta, key, seq, names).select(key, *[F.col(c).alias(f"__{c}") for c in names], *[f"__last_{c}" for c in names], "__n")
    rows = old.select(key, *names, *([counter] if counter else [])).join(new, key, "full")

    def value(c: str, policy: str) -> Column:
        o, n = F.col(c), F.col(f"__{c}")
        return {"filled": F.coalesce(n, o), "given": F.when(F.col("__n").isNotNull(), F.col(f"__last_{c}")[c]).otherwise(o), "kept": F.coalesce(o, n), "greatest": F.greatest(o, n)}[policy]

    out = [value(c, p).alias(c) for c, p in policies.items()]
    if counter:
        out.append((F.coalesce(counter, F.lit(0)) + F.coalesce("__n", F.lit(0))).alias(counter))
    return rows.select(key, *out)


def _order(rows: DataFrame, seq: str | list[str]) -> list[Column]:
    """seq, then all other columns that have an order, so that equal seq gives one result."""
    first = [seq] if isinstance(seq, str) else seq
    return [F.col(c) for c in first] + [F.col(c) for c, kind in rows.dtypes if c not in first and not kind.startswith("map")]


def first_wins(rows: DataFrame, key: list[str], seq: str | list[str]) -> DataFrame:
    """Insert or ignore: the key's first row."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*_order(rows, seq)))).where("__rn = 1").drop("__rn")


def last_wins(rows: DataFrame, key: list[str], seq: str | list[str]) -> DataFrame:
    """Insert or replace: the key's last row."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc() for c in _order(rows, seq)]))).where("__rn = 1").drop("__rn")
