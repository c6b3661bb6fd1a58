"""Totals, neighbours and dense numbers over a global order, without a single-task window.

Rows are dealt to ``n`` ranges of the order key whose bounds are quantiles (a bounded number of
values on the driver).  Windows then run within ranges, and what must cross ranges is carried by
a table of one row per range, which is at most ``n`` rows however large the input is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "__range"
STOP = "__stop"
CUTS = 512  # quantiles held on the driver and in the plan


def ranges(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """``df`` with the number of each row's range of a numeric key; nulls go to a range before all.

    Up to CUTS ranges lie between quantiles; for more, each gap between quantiles is divided evenly.
    """
    n = max(1, n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    coarse = min(n, CUTS)
    c = F.col(f"`{key}`").cast("double")
    least, cuts = df.select(F.min(c), F.percentile_approx(c, [i / coarse for i in range(1, coarse + 1)], 20 * coarse)).first()
    if least is None:
        return df.withColumn(RANGE, F.lit(0).cast("long"))
    cuts = sorted({least, *cuts})
    gap = F.size(F.filter(F.lit(cuts), lambda x: x < c)).cast("long")  # 0 for the least value
    fine = -(-n // coarse)
    if fine > 1:
        low, high = F.get(F.lit(cuts), (gap - 1).cast("int")), F.get(F.lit(cuts), gap.cast("int"))
        inner = F.coalesce(F.floor((c - low) / (high - low) * (fine - 1)), F.lit(0))
        gap = gap * fine + F.least(F.greatest(inner, F.lit(0)), F.lit(fine - 1)).cast("long")
    return df.withColumn(RANGE, F.when(c.isNull(), F.lit(-1).cast("long")).otherwise(gap))


def _carry(per_range: DataFrame, columns: list[Column]) -> DataFrame:
    return F.broadcast(per_range.select(RANGE, *columns))


def _edge(*cols: str) -> Window:
    return Window.orderBy(*cols)  # over a table of one row per range


def walk(df: DataFrame, key: str, sums: dict[str, str] | None = None, previous: dict[str, str] | None = None, n: int | None = None, *, inclusive: bool = False, stop: Callable[[dict[str, Column]], Column] | None = None) -> DataFrame:
    """Several things along one order (``key``, unique), from one set of ranges and one table of their edges.

    ``sums``: name of the sum of a column over all rows before; ``previous``: name of a column's value in the row
    before (null in the first).  ``stop``: a condition on a row, given the ``previous`` ones; column STOP has the
    least key for which it holds in any row, null for none.
    """
    sums, previous = sums or {}, previous or {}
    dealt = ranges(df, key, n)
    inside = Window.partitionBy(RANGE).orderBy(key)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = {f"__own_{c}": F.coalesce(F.sum(v).over(upto), F.lit(0)) for c, v in sums.items()} | {f"__own_{c}": F.lag(v).over(inside) for c, v in previous.items()}
    dealt = dealt.withColumns(own | {"__first": F.row_number().over(inside) == 1})
    # one row per range
    parts = [F.sum(v).alias(f"__sum_{c}") for c, v in sums.items()] + [F.max_by(v, key).alias(f"__last_{c}") for c, v in previous.items()]
    if stop:
        parts += [F.min(F.when(~F.col("__first") & stop({c: F.col(f"__own_{c}") for c in previous}), F.col(key))).alias("__inner"), F.min_by(F.struct("*"), key).alias("__head")]
    edges = dealt.groupBy(RANGE).agg(*(parts or [F.count("*").alias("__count")]))
    over = Window.orderBy(RANGE)
    before = {f"__before_{c}": F.coalesce(F.sum(f"__sum_{c}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums} | {f"__before_{c}": F.lag(f"__last_{c}").over(over) for c in previous}
    edges = edges.withColumns(before)
    if stop:
        head = edges.select("*", *[F.col(f"__head.`{c}`").alias(c) for c in dealt.columns if c != RANGE])
        hit = F.when(stop({c: F.col(f"__before_{c}") for c in previous}), F.col(key))
        edges = head.withColumn(STOP, F.min(F.least(F.col("__inner"), hit)).over(Window.partitionBy()))
    edges = F.broadcast(edges.select(RANGE, *before, *([STOP] if stop else [])))
    out = dealt.join(edges, RANGE)
    made = {c: F.col(f"__before_{c}") + F.col(f"__own_{c}") for c in sums} | {c: F.when(F.col("__first"), F.col(f"__before_{c}")).otherwise(F.col(f"__own_{c}")) for c in previous}
    return out.withColumns(made).drop(RANGE, "__first", *own, *before)


def running_sum(df: DataFrame, key: str, value: str, name: str, n: int | None = None, *, inclusive: bool = False) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before each row by ``key`` (unique)."""
    return walk(df, key, {name: value}, n=n, inclusive=inclusive)


def previous(df: DataFrame, key: str, value: str, name: str, n: int | None = None) -> DataFrame:
    """``name``: ``value`` of the row before by ``key`` (unique); null for the first row."""
    return walk(df, key, previous={name: value}, n=n)


def dense_numbers(df: DataFrame, key: str, name: str, start: int = 1, n: int | None = None) -> DataFrame:
    """``name``: start, start + 1, ... in the order of ``key`` (unique)."""
    dealt = ranges(df, key, n)
    counts = dealt.groupBy(RANGE).agg(F.count("*").alias("__count"))
    before = F.coalesce(F.sum("__count").over(_edge(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    own = F.row_number().over(Window.partitionBy(RANGE).orderBy(key))
    return dealt.withColumn("__own", own).join(_carry(counts, [before]), RANGE).withColumn(name, (F.lit(start - 1) + F.col("__before") + F.col("__own")).cast("long")).drop(RANGE, "__own", "__before")
