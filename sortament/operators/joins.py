"""Joins that hold when one key has a large part of all rows, and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortament.session import is_table, materialise, shuffle_width


#: Rows and bytes up to which a side is broadcast.
MAX_ROWS, MAX_BYTES = 100_000, 32 << 20


def measured(df: DataFrame, max_rows: int) -> tuple[int, int]:
    """Rows and bytes (as text) of ``df``, counted no further than one row more than the bound."""
    one = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(one.cast("long"))).first()
    return row[0], row[1] or 0


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows of ``max_bytes`` in
    all, else without, so that the join shuffles. What isn't a written table yet is
    written first, so that measuring doesn't run it a second time."""
    table = df if is_table(df) else materialise(df)
    rows, size = measured(table, max_rows)
    return F.broadcast(table) if rows <= max_rows and size <= max_bytes else table


#: A key with fewer rows than this is never treated as hot.
LEAST_HOT = 100_000


def hot_key_join(left: DataFrame, right: DataFrame, key: str, *, share: int | None = None, least_hot: int = LEAST_HOT) -> DataFrame:
    """Left join on ``key`` where ``right`` has at most one row a key.

    Keys with more than 1/``share`` of the rows of ``left`` (4 x the shuffle's width by
    default), and more than ``least_hot``, are joined by a broadcast of their rows of
    ``right``: there can be at most ``share`` such keys, so what is broadcast is bounded
    whatever the data. All other rows shuffle. Rows per key are counted, combined before
    they are shuffled, unless a written table is too small to have a hot key at all. A
    null key matches nothing and its rows are kept.
    """
    share = share or 4 * shuffle_width(left.sparkSession)
    if is_table(left) and left.count() <= least_hot:  # the number of rows stands in the files' footers
        return left.join(right, key, "left")
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    bound = max((total or 0) // share, least_hot)
    if (most or 0) <= bound:
        return left.join(right, key, "left")
    hot = [r[0] for r in counts.where(F.col("_n") > bound).select(key).collect()]  # at most ``share``
    is_hot = F.col(key).isin(hot)
    few = F.broadcast(right.where(is_hot))
    cold = left.where(~is_hot | F.col(key).isNull()).join(right.where(~is_hot), key, "left")
    return left.where(is_hot).join(few, key, "left").select(*cold.columns).unionByName(cold)
