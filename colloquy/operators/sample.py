"""Deterministic samples and splits.

Every choice orders rows by a seeded hash of their key, so results depend on the
seed and the keys alone, not on partitions or input order. Quotas are exact.
Stratum tables are small (one row per stratum). Ranks within strata come from a
range partitioning by stratum and order, so a stratum that holds a third of all
rows is spread over as many tasks as its size asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import durable


#: Strata whose sizes may be brought to the driver.
STRATA_LIMIT = 100_000


def group_rank(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds the rank (from 1) of each row in its group; ``order`` must be unique within the group.

    Rows are range-partitioned by group and order and ranked in their partition;
    the number of rows of the group in earlier partitions is added.
    """
    group = F.xxhash64(*groups) if groups else F.lit(0).cast("bigint")
    parted = durable(df.withColumn("_g", group).repartitionByRange("_g", *order).withColumn("_pid", F.spark_partition_id()))
    counts = parted.groupBy("_g", "_pid").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_g", "_pid", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_pid", "_g").orderBy(*order))
    return parted.withColumn("_local", local).join(offsets, ["_g", "_pid"]).withColumn(name, F.col("_local") + F.col("_before")).drop("_g", "_pid", "_local", "_before")


def draw(seed: int, label: Column | str, key: Column | str) -> Column:
    """The seeded order of rows: a hex hash of seed, label and key."""
    as_text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(as_text(label), F.lit("")), as_text(key)), 256)


def quotas(sizes: DataFrame, stratum: str, count: str, total: int) -> DataFrame:
    """Largest-remainder shares of ``total``: ``stratum, count, quota``. Ties go to the smaller stratum name.

    If there are no more rows than ``total``, all are taken.
    """
    everything = F.sum(count).over(Window.partitionBy(F.lit(0)))
    exact = F.col(count) * F.lit(total) / everything
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), stratum)
    out = sizes.withColumn("all", everything).withColumn("base", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy(F.lit(0)))
    extra = (F.row_number().over(order) <= left).cast("bigint")
    return out.withColumn("quota", F.when(F.col("all") <= total, F.col(count)).otherwise(F.col("base") + extra)).select(stratum, count, "quota")


def cut_points(df: DataFrame, group: str, key: str, upto: DataFrame, *names: str) -> DataFrame:
    """``_l`` and, for each name, the (``_draw``, key) at the rank that ``upto`` (``_l``, names) wants in each group; NULL for rank 0.

    Only group, draw and key are ranked: whole rows stay where they are and are
    compared with the cut points of their group.
    """
    ranked = group_rank(df.select(F.col(group).alias("_l"), "_draw", F.col(key).alias("_k")), ["_l"], ["_draw", "_k"], "_rank")
    own = ranked.alias("a").join(upto.alias("b"), F.col("a._l").eqNullSafe(F.col("b._l"))).select("a.*", *(F.col(f"b.{n}") for n in names))
    return own.groupBy("_l").agg(*(F.max(F.when(F.col("_rank") == F.col(n), F.struct("_draw", "_k"))).alias(f"{n}_cut") for n in names))


def upto_cut(cut: str, key: str) -> Column:
    return F.coalesce(F.struct(F.col("_draw"), F.col(key).alias("_k")) <= F.col(cut), F.lit(False))


def quota_sample(df: DataFrame, stratum: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """A proportional sample of exactly ``total`` rows (or all)."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    share = quotas(sizes, stratum, "size", total).select(F.col(stratum).alias("_l"), F.col("quota").alias("_q"))
    drawn = df.withColumn("_draw", draw(seed, stratum, key))
    cuts = cut_points(drawn, stratum, key, share, "_q")
    return drawn.join(cuts, F.col(stratum).eqNullSafe(F.col("_l"))).where(upto_cut("_q_cut", key)).drop("_draw", "_l", "_q_cut")


def downsample(df: DataFrame, key: str, real: Column, high_value: Column, keyword: Column, ratio: float, seed: int = 42) -> DataFrame:
    """Keeps synthetic rows, real rows of value (either flag), and as many other real rows as reach ``ratio`` times the synthetic ones.

    Adds ``kept`` and ``why`` (synthetic, label_only, keyword_only, both, filled,
    dropped). A ratio of 0 drops all real rows. Where the rows of value already
    reach the target nothing is filled; a negative need counts as none.
    """
    df = df.withColumn("_real", real).withColumn("_high", high_value).withColumn("_word", keyword)
    valued = F.col("_real") & (F.col("_high") | F.col("_word"))
    counts = df.agg(F.count_if(~F.col("_real")).alias("m2"), F.count_if(valued).alias("union"))
    need = counts.select(F.greatest(F.bround(F.col("m2") * F.lit(ratio), 0) - F.col("union"), F.lit(0.0)).alias("need"))
    pool = F.coalesce(F.col("_real") & ~valued, F.lit(False))
    drawn = df.withColumn("_pool", pool).withColumn("_draw", draw(seed, F.lit("pool"), key))
    in_pool = drawn.where("_pool").select("_pool", "_draw", key)
    wanted = in_pool.agg(F.count("*").alias("_n")).join(F.broadcast(need)).select(F.lit(True).alias("_l"), F.least("_n", F.col("need").cast("bigint")).alias("_q"))
    cut = cut_points(in_pool, "_pool", key, wanted, "_q").select("_q_cut")
    why = (
        F.when(~F.col("_real"), "synthetic").when(F.lit(ratio) == 0, "dropped").when(F.col("_high") & F.col("_word"), "both")
        .when(F.col("_high"), "label_only").when(F.col("_word"), "keyword_only").when(F.col("_pool") & upto_cut("_q_cut", key), "filled").otherwise("dropped")
    )
    # One row, the cut point, joins everything; there is none without a pool.
    one = df.sparkSession.range(1).drop("id").join(cut, how="left")
    out = drawn.join(F.broadcast(one)).withColumn("why", why)
    return out.withColumn("kept", F.col("why") != "dropped").drop("_real", "_high", "_word", "_pool", "_draw", "_q_cut")


def group_ids(counts: Sequence[int], least: int) -> list[int]:
    """Group of each count when neighbours are joined until they hold ``least``; a rest joins the last full group, or is -1 without one."""
    ids, held, group = [], 0, 0
    for count in counts:
        ids.append(group)
        held += count
        if held >= least:
            group, held = group + 1, 0
    return [min(i, group - 1) for i in ids]


def merge_small_strata(sizes: Sequence[tuple[str, str, int]], least: int, order: Sequence[str] = ("short", "mid", "long")) -> dict[tuple[str, str], str]:
    """Which label each (scenario, bucket) gets, for the driver: one entry per stratum.

    Neighbouring buckets of a scenario are joined (see ``group_ids``); unknown buckets
    come last, by name. What belongs to no group is pooled to ``misc|all``, or
    joins the largest label (the first by name of equal ones) if the pool is too small.
    """
    places = {bucket: place for place, bucket in enumerate(order)}
    rows = pd.DataFrame(sorted(sizes, key=lambda r: (r[0], places.get(r[1], len(places)), r[1])), columns=["scenario", "bucket", "n"])
    if rows.empty:
        return {}
    rows["part"] = [i for _, own in rows.groupby("scenario", sort=True) for i in group_ids(own["n"].tolist(), least)]
    whole = rows[rows["part"] >= 0].groupby(["scenario", "part"], sort=True).agg(label=("bucket", "+".join), n=("n", "sum")).reset_index()
    whole["label"] = whole["scenario"] + "|" + whole["label"]
    pooled = rows[rows["part"] < 0]
    rest = "misc|all" if whole.empty or pooled["n"].sum() >= least else whole["label"][whole["n"].idxmax()]
    named = rows.merge(whole, on=["scenario", "part"], how="left")["label"].fillna(rest)
    return dict(zip(zip(rows["scenario"], rows["bucket"]), named))


def with_strata(df: DataFrame, scenario: str, bucket: str, least: int = 20) -> DataFrame:
    """Adds ``stratum``; only the sizes of the strata reach the driver."""
    sizes = [(r[0], r[1], r[2]) for r in df.where(F.col(scenario).isNotNull() & F.col(bucket).isNotNull()).groupBy(scenario, bucket).count().limit(STRATA_LIMIT + 1).collect()]
    if len(sizes) > STRATA_LIMIT:
        raise ValueError(f"more than {STRATA_LIMIT} strata")
    labels = merge_small_strata(sizes, least)
    mapping = df.sparkSession.createDataFrame([(s, b, x) for (s, b), x in labels.items()] or [("", "", "")], "_s string, _b string, stratum string")
    return df.join(F.broadcast(mapping), (F.col(scenario) == F.col("_s")) & (F.col(bucket) == F.col("_b")), "left").drop("_s", "_b")


def stratified_split(df: DataFrame, stratum: Column | str, key: str, ratios: tuple[float, float, float] = (0.9, 0.05, 0.05), seed: int = 42) -> DataFrame:
    """Adds ``split``: per stratum a seeded order cut at the half-even rounded cumulative ratios."""
    label = F.col(stratum) if isinstance(stratum, str) else stratum
    drawn = df.withColumn("_label", label).withColumn("_draw", draw(seed, "_label", key))
    size = F.count("*")
    sizes = drawn.groupBy(F.col("_label").alias("_l")).agg(F.bround(size * F.lit(ratios[0]), 0).alias("_a"), F.bround(size * F.lit(ratios[0] + ratios[1]), 0).alias("_b"))
    cuts = cut_points(drawn, "_label", key, sizes, "_a", "_b")
    split = F.when(upto_cut("_a_cut", key), "train").when(upto_cut("_b_cut", key), "val").otherwise("test")
    return drawn.join(cuts, F.col("_label").eqNullSafe(F.col("_l"))).withColumn("split", split).drop("_label", "_l", "_draw", "_a_cut", "_b_cut")


def distribution_warnings(df: DataFrame, split: str, stratum: str, points: float = 3.0) -> DataFrame:
    """Strata whose share in a split is more than ``points`` percentage points off their share overall; absent strata have share 0."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("overall", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).drop("n")
    inside = df.groupBy(split, stratum).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split))).drop("n")
    # Splits times strata: both are small aggregates.
    grid = inside.select(split).distinct().crossJoin(sizes)
    joined = grid.join(inside, [split, stratum], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return joined.where(F.abs(F.col("share") - F.col("overall")) > points / 100)


def length_buckets(df: DataFrame, length: Column, order: str, buckets: int = 3) -> DataFrame:
    """Adds ``bucket`` and ``position``: near-equal buckets by length, then one of each in turn."""
    ranked = group_rank(df.withColumn("_len", length), [], ["_len", order], "_rank")
    total = ranked.agg(F.count("*").alias("_all"))
    out = ranked.join(F.broadcast(total))
    # The first buckets are one larger where the rows don't divide evenly.
    size, extra, place = F.floor(F.col("_all") / buckets), F.pmod("_all", F.lit(buckets)), F.col("_rank") - 1
    inside = place < extra * (size + 1)
    bucket = F.when(inside, F.floor(place / (size + 1))).otherwise(extra + F.floor((place - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    turn = F.when(inside, F.pmod(place, size + 1)).otherwise(F.pmod(place - extra * (size + 1), F.greatest(size, F.lit(1))))
    # Rows of earlier turns, then the rows of this turn in earlier buckets; only the larger buckets have a last turn.
    position = turn * F.least(F.col("_all"), F.lit(buckets)) + bucket + 1
    return out.withColumn("bucket", (bucket + 1).cast("int")).withColumn("position", position.cast("bigint")).drop("_len", "_rank", "_all")


def every_kth(df: DataFrame, order: str, count: int) -> DataFrame:
    """``count`` rows at even strides of the order."""
    ranked = group_rank(df, [], [order], "_rank")
    out = ranked.join(F.broadcast(ranked.agg(F.count("*").alias("_all"))))
    stride = F.greatest(F.floor(F.col("_all") / count), F.lit(1))
    return out.where((F.pmod(F.col("_rank") - 1, stride) == 0) & ((F.col("_rank") - 1) / stride < count)).drop("_rank", "_all")


def common_ids(df: DataFrame, key: str, tag: str) -> DataFrame:
    """Ids that occur under every tag."""
    tags = df.agg(F.count_distinct(tag).alias("tags"))
    return df.groupBy(key).agg(F.count_distinct(tag).alias("own")).join(F.broadcast(tags)).where("own = tags").select(key)


def judge_samples(df: DataFrame, key: str, tag: str, scenario: str, total: int | None = None, seed: int = 42) -> DataFrame:
    """The rows of every tag for the same ids: those that occur under all tags, or a proportional sample of ``total`` of them by scenario.

    An id's scenario is its smallest, over all tags. Rows without an id, or no common id, raise.
    """
    own = df.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"a row without {key}")).cast(df.schema[key].dataType)))
    ids = durable(own.join(common_ids(own, key, tag), key, "left_semi").groupBy(key).agg(F.min(scenario).alias("_scenario")))
    if ids.isEmpty():
        raise ValueError("no common ids")
    chosen = ids if total is None else quota_sample(ids, "_scenario", key, total, seed)
    return own.join(chosen.select(key), key, "left_semi")
