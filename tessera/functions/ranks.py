"""Ranks and running values over a whole table, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Tables of so many rows are sorted in one task per group.
SMALL = 200_000
#: Positions in a range of an axis.
RANGE = 1 << 20

_JOIN: dict[str, Callable[[Column, Column], Column]] = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest}


def along(df: DataFrame, order: list[str | Column], values: dict[str, tuple[str, str | Column]] | None = None, *, by: tuple[str, ...] = (), number: str = "rank", small: int = SMALL) -> DataFrame:
    """``df`` with its row number in ``order`` and running values ``{name: ("sum" | "min" | "max", column)}``.

    The order must be total, within groups if ``by`` names some. A larger table is cut into key
    ranges; rows are ranked within their range, and what earlier ranges add is one row a range.
    """
    values = values or {}
    df = stored(df.withColumns({f"_of_{n}": F.col(c) if isinstance(c, str) else c for n, (_, c) in values.items()}))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    first = Window.unboundedPreceding
    if df.count() <= small:
        w = whole.orderBy(*order)
        out = df.withColumns({number: F.row_number().over(w).cast("long"), **{n: getattr(F, f)(f"_of_{n}").over(w.rowsBetween(first, 0)) for n, (f, _) in values.items()}})
        return out.drop(*[f"_of_{n}" for n in values])
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = stored(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*by, "_part").orderBy(*order)
    local = placed.withColumns({number: F.row_number().over(w).cast("long"), **{n: getattr(F, f)(f"_of_{n}").over(w.rowsBetween(first, 0)) for n, (f, _) in values.items()}})
    ends = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), *[getattr(F, f)(f"_of_{n}").alias(f"_end_{n}") for n, (f, _) in values.items()])
    earlier = whole.orderBy("_part").rowsBetween(first, -1)
    heads = ends.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_before"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *[getattr(F, f)(f"_end_{n}").over(earlier).alias(f"_head_{n}") for n, (f, _) in values.items()],
    )
    same = F.col("_part") == F.col("_before")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    both = local.join(heads, same)
    return both.withColumns({number: F.col(number) + F.col("_n0"), **{n: _JOIN[f](F.col(f"_head_{n}"), F.col(n)) for n, (f, _) in values.items()}}).select(
        *[c for c in df.columns if not c.startswith("_of_")], number, *values
    )


def over_ranges(df: DataFrame, keys: tuple[str, ...], pos: str, *, sums: dict[str, str | Column] | None = None, before: dict[str, str] | None = None, after: dict[str, str] | None = None, size: int | None = None) -> DataFrame:
    """``df`` with running sums along ``pos`` and values of the rows before and after, per ``keys``.

    The axis is cut into ranges of ``size`` positions, each sorted by itself; a range takes the sums of
    those before it, the last value of the range before and the first of the range after from a table
    with a row a range. Positions are unique within keys and values non-null; null stands where there is no row.
    """
    size, sums, before, after = size or RANGE, sums or {}, before or {}, after or {}
    df = stored(df.withColumn("_range", F.floor(F.col(pos) / size)))
    of = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    w = Window.partitionBy(*keys, "_range").orderBy(pos)
    local = df.withColumns(
        {**{n: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n, c in of.items()}, **{n: F.lag(c).over(w) for n, c in before.items()}, **{n: F.lead(c).over(w) for n, c in after.items()}}
    )
    ends = df.groupBy(*keys, "_range").agg(
        *[F.sum(c).alias(f"_sum_{n}") for n, c in of.items()], *[F.max_by(c, pos).alias(f"_last_{n}") for n, c in before.items()], *[F.min_by(c, pos).alias(f"_first_{n}") for n, c in after.items()], F.count(F.lit(1)).alias("_n")
    )
    along_axis = Window.partitionBy(*keys).orderBy("_range")
    earlier = along_axis.rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_sum_{n}") for n in of],
        *[F.lag(f"_last_{n}").over(along_axis).alias(f"_last_{n}") for n in before], *[F.lead(f"_first_{n}").over(along_axis).alias(f"_first_{n}") for n in after],
    )
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    both = local.join(heads, same)
    both = both.withColumns({**{n: F.col(n) + F.col(f"_sum_{n}") for n in of}, **{n: F.coalesce(n, f"_last_{n}") for n in before}, **{n: F.coalesce(n, f"_first_{n}") for n in after}})
    return both.select(*[c for c in df.columns if c != "_range"], *of, *before, *after)
