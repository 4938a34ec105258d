"""Table operations that procedural scripts are made of."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.operators.keyed import join_unique


def count_where(df: DataFrame, cond: Column, count_as: str = "n") -> DataFrame:
    """One row with the number of matching rows."""
    return df.filter(cond).agg(F.count("*").alias(count_as))


def resolve(df: DataFrame, name: str) -> str:
    """The column of `df` that Spark means by `name`; raises if there is none or several."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    found = [c for c in df.columns if c == name or not exact and c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"column {name!r} is {'not' if not found else 'more than once'} in {df.columns}")
    return found[0]


def update_where(df: DataFrame, cond: Column, set_: Mapping[str, Column]) -> DataFrame:
    """Set columns where `cond` is true; NULL counts as no match. All new values are
    worked out from the old row, and a column keeps its type. Names are found as Spark
    finds them; a name that is no column raises."""
    types = dict(df.dtypes)
    new = {resolve(df, c): value for c, value in set_.items()}
    if len(new) < len(set_):
        raise ValueError(f"a column is set twice in {list(set_)}")
    return df.select(
        *[
            F.when(cond, new[c].cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c)
            if c in new
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def update_if(
    df: DataFrame, guard: Column, cond: Column, set_: Mapping[str, Column],
    guard_df: DataFrame | None = None,
) -> DataFrame:
    """`update_where`, but only if some row of `guard_df` (default: `df`) meets `guard`.

    The guard is a subquery of the plan: it stops at the first match and nothing is
    collected or cross joined.
    """
    met = (df if guard_df is None else guard_df).filter(guard).exists()
    return update_where(df, met & cond, set_)


def lookup(
    df: DataFrame, ref: DataFrame, key: str, value: str, *, ref_key: str | None = None,
    row_id: str, out_col: str | None = None, strict: bool = False,
) -> DataFrame:
    """Fetch one value by key: `status` says whether exactly one row, none or several
    matched, and only OK rows have a value. `strict=True` raises instead.

    `ref` is reduced to one row per key before the join, so a key with many rows costs
    map-side work only; hot keys of `df` are spread by `row_id`.
    """
    out_col = out_col or value
    found = ref.groupBy(F.col(ref_key or key).alias(key)).agg(
        F.count("*").alias("_matches"), F.min(value).alias("_value")
    )
    matches = F.coalesce(F.col("_matches"), F.lit(0))
    status = (
        F.when(matches == 1, "OK").when(matches == 0, "NO_DATA_FOUND").otherwise("TOO_MANY_ROWS")
    )
    if strict:
        status = F.when(matches == 1, status).otherwise(
            F.raise_error(F.concat(status, F.lit(f" for {key} "), F.col(key).cast("string")))
        )
    joined = join_unique(df, found, [key], "left", [row_id])
    return joined.select(
        *df.columns, F.when(matches == 1, F.col("_value")).alias(out_col), status.alias("status")
    )
