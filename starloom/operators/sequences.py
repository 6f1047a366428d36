"""lag, lead, running counts and totals of long sequences, over slices with carried edges.

A key's rows are cut into slices of its first order column. Windows run within slices; each slice's
first and last row and its number of rows (one row a slice, aggregated before it is shuffled) say what lies
beyond its edges. So a key that holds a third of all rows is as many tasks as it has slices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIRST, _LAST = -(1 << 62), 1 << 62


def slice_of(value: Column, width: float) -> Column:
    """Slices keep the order of the values: null before all, NaN behind all, both infinities at the ends."""
    v = value.cast("double")
    bounded = F.greatest(F.lit(float(_FIRST // 2)), F.least(F.lit(float(_LAST // 2)), v / width))
    return F.when(v.isNull(), _FIRST).when(F.isnan(v), _LAST).otherwise(F.floor(bounded).cast("long"))


@dataclass
class Sliced:
    """Rows with `before` and `after` (struct<item> of the neighbours, null at the ends), `leader` (struct<item> of the key's first row), `place` from 1 and `total`."""

    rows: DataFrame
    keys: list[str]
    columns: list[str]

    def select(self, **new: Column) -> DataFrame:
        return self.rows.withColumns(new).select(*(F.col(f"`{c}`") for c in self.columns if c not in new), *new)


def sliced(rows: DataFrame, keys: list[str], order: list[str], item: str, width: float | None = None) -> Sliced:
    """order: columns that order a key's rows, the first numeric; width: of a slice in its unit (None: one slice a key). Null keys are keys like others."""
    names = [f"__k{i}" for i in range(len(keys))]
    cut = rows.withColumns({n: F.col(k) for n, k in zip(names, keys, strict=True)}).withColumn("__slice", slice_of(F.col(order[0]), width) if width else F.lit(0).cast("long"))
    w = Window.partitionBy(*names, "__slice").orderBy(*order)
    one = F.struct(F.col(item).alias("item"))
    own = cut.withColumns({"__before": F.lag(one).over(w), "__after": F.lead(one).over(w), "__place": F.row_number().over(w).cast("long")})
    at = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    # min_by and max_by skip null orders only; a struct is never null
    ends = cut.groupBy(*names, "__slice").agg(F.min_by(one, at).alias("__head"), F.max_by(one, at).alias("__tail"), F.count("*").alias("__n"))
    key = Window.partitionBy(*names).orderBy("__slice")
    edges = ends.select(
        *(F.col(n).alias(f"{n}e") for n in [*names, "__slice"]),
        F.lag("__tail").over(key).alias("__left"), F.lead("__head").over(key).alias("__right"), F.first("__head").over(key).alias("__leader"),
        F.coalesce(F.sum("__n").over(key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"), F.sum("__n").over(Window.partitionBy(*names)).alias("__total"),
    )
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"{n}e"))
    both = own.join(edges, same & (F.col("__slice") == F.col("__slicee")))
    out = both.withColumns({"__before": F.coalesce("__before", "__left"), "__after": F.coalesce("__after", "__right"), "__place": F.col("__place") + F.col("__offset")})
    return Sliced(out, keys, rows.columns)
