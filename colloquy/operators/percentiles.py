"""Exact percentiles of groups of any size, by ranks of a range partitioning instead of a buffer of all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.sample import group_rank


def _same(groups: Sequence[str]) -> Column:
    out = F.lit(True)
    for g in groups:
        out &= F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return out


def exact_percentiles(df: DataFrame, groups: Sequence[str], wanted: dict[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """``groups`` and a struct per name of ``wanted`` with fields ``p<percent>``: linear interpolation between neighbours in order.

    NULL and NaN values are left out; a group without any value has no struct. Each
    value of the group has its rank from a range partitioning, so a group that holds
    a third of all rows is spread over many tasks; only the rows next to the wanted
    ranks are aggregated.
    """
    named = [(name, value, tuple(ps)) for name, (value, ps) in wanted.items()]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), value.cast("double").alias("v")) for i, (_, value, _) in enumerate(named))))
    values = df.select(*groups, each.alias("_e")).select(*groups, F.col("_e.i").alias("_i"), F.col("_e.v").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    keys = [*groups, "_i"]
    ranked = group_rank(values, keys, ["_v"], "_rank")
    sizes = ranked.groupBy(*keys).agg(F.max("_rank").alias("_n"))
    joined = ranked.alias("a").join(sizes.alias("b"), _same(keys)).select(*(F.col(f"a.{k}") for k in keys), "_v", (F.col("_rank") - 1).alias("_at"), F.col("_n"))
    out = []
    for i, (name, _, ps) in enumerate(named):
        fields = []
        for p in ps:
            place = (F.col("_n") - 1) * F.lit(float(p))
            mine = F.col("_i") == i
            low, high = (F.max(F.when(mine & (F.col("_at") == edge), F.col("_v"))) for edge in (F.floor(place), F.ceil(place)))
            at = F.max(F.when(mine, place))
            fields.append(F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(f"p{round(100 * p)}"))
        out.append(F.struct(*fields).alias(name))
    return joined.groupBy(*groups).agg(*out)


def with_percentiles(rollup: DataFrame, df: DataFrame, groups: Sequence[str], wanted: dict[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """``rollup`` with columns ``<name>_p<percent>`` of ``df``; groups without values have NULL."""
    found = exact_percentiles(df, groups, wanted)
    columns = [F.col(f"b.{name}.p{round(100 * p)}").alias(f"{name}_p{round(100 * p)}") for name, (_, ps) in wanted.items() for p in ps]
    return rollup.alias("a").join(found.alias("b"), _same(groups), "left").select("a.*", *columns)
