"""Samples with target category proportions, by swap repair (problem 3).

Records are grouped by signature, the set of targets of a plan that they fit. A
random sample that satisfies the floors is drawn as counts per signature; then
signature counts are exchanged as long as an exchange lowers the deviation from
the targets, in halving steps; at last each count is materialised as the rows
with the smallest seeded hashes. A signature is a cell of the plan's scenarios and
turn ranges: with S scenarios and T ranges a plan has at most (S + 1) (2 T + 2), so only
their counts per plan reach the driver. Rows are
never gathered by signature: a histogram of the hashes finds the cut, and only
the rows of the cut bucket are ranked.

The report has a reason for each target that the draw misses: ``scarce`` where fewer
rows fit than it needs, ``competing`` where enough fit but other shares and floors of the plan
leave too little (or too much) room after repair, NULL where it is met. Each distinct
id counts once, by its lowest ``rec_id`` (NULL is one id); a NULL ``n_turns``
fits no range; a NULL scenario fits only targets of any scenario. Targets with
NULL share or floor want none. Empty tables give empty results.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from math import floor

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

TARGET_LIMIT, BUCKETS = 10_000, 4096


@dataclass(frozen=True)
class Target:
    target_id: int
    scenario: str | None
    low: int | None
    high: int | None
    share: float
    floor: int
    size: int

    @property
    def wanted(self) -> int:
        return floor(self.size * self.share + 0.5)

    def fits(self, scenario: Column, turns: Column) -> Column:
        fit = turns.isNotNull()
        if self.low is not None:
            fit &= turns >= self.low
        if self.high is not None:
            fit &= turns <= self.high
        if self.scenario is not None:
            fit &= scenario == self.scenario
        return F.coalesce(fit, F.lit(False))


def scenario_key(column: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(column)), "[- ]", "_")


def read_plans(targets: DataFrame) -> dict[int, list[Target]]:
    """The plans; a target table is small by nature, which is checked."""
    rows = targets.select("plan_id", "target_id", scenario_key(F.col("scenario")).alias("scenario"), "turns_min", "turns_max", "target_share", "min_rows", "sample_size").limit(TARGET_LIMIT + 1).collect()
    if len(rows) > TARGET_LIMIT:
        raise ValueError(f"more than {TARGET_LIMIT} targets")
    plans: dict[int, list[Target]] = {}
    for r in sorted(rows, key=lambda r: (r.plan_id, r.target_id)):
        plans.setdefault(r.plan_id, []).append(Target(r.target_id, r.scenario, r.turns_min, r.turns_max, r.target_share or 0.0, r.min_rows or 0, r.sample_size or 0))
    return plans


def distinct_records(dialogues: DataFrame) -> DataFrame:
    """Each id once, by its lowest rec_id; aggregated before the shuffle."""
    return dialogues.groupBy("id").agg(F.min(F.struct("rec_id", scenario_key(F.col("scenario")).alias("scenario"), "n_turns")).alias("r")).select("id", "r.*")


def signature(targets: Sequence[Target]) -> Column:
    fits = [F.when(t.fits(F.col("scenario"), F.col("n_turns")), F.lit(str(t.target_id))) for t in targets]
    return F.concat_ws(",", *fits)


def repair(available: dict[str, int], targets: Sequence[Target], seed: int) -> dict[str, int]:
    """Rows to draw of each signature."""
    size = min(max((t.size for t in targets), default=0), sum(available.values()))
    chance = random.Random(seed)
    of = {s: frozenset(map(int, s.split(","))) if s else frozenset() for s in available}
    taken = dict.fromkeys(available, 0)
    names = sorted(available)

    def take(pool: list[str], count: int) -> None:
        """Spread ``count`` rows over a pool as a random draw of rows would."""
        left = {s: available[s] - taken[s] for s in pool}
        total = sum(left.values())
        count = min(count, total, size - sum(taken.values()))
        for s in sorted(pool, key=lambda s: (chance.random(), s)):
            if total <= 0 or count <= 0:
                return
            share = min(left[s], count, floor(count * left[s] / total + chance.random()))
            share = max(share, count - (total - left[s]))
            taken[s] += share
            count, total = count - share, total - left[s]

    for t in sorted(targets, key=lambda t: sum(n for s, n in available.items() if t.target_id in of[s])):
        pool = [s for s in names if t.target_id in of[s]]
        take(pool, t.floor - sum(taken[s] for s in pool))
    take(names, size - sum(taken.values()))

    return exchange(np.array([taken[n] for n in names]), np.array([available[n] for n in names]), names, targets)


def exchange(taken: np.ndarray, available: np.ndarray, names: list[str], targets: Sequence[Target]) -> dict[str, int]:
    """Moves rows between signatures as long as that lowers the deviation, in halving steps; of equal exchanges the first by name."""
    if not len(names) or not targets:
        return dict(zip(names, taken.tolist()))
    member = np.array([[str(t.target_id) in n.split(",") for t in targets] for n in names], np.int64)
    wanted, floors = np.array([t.wanted for t in targets]), np.array([t.floor for t in targets])
    distance = lambda drawn: (np.abs(drawn - wanted) + 1000 * np.maximum(0, floors - drawn)).sum(axis=-1)
    drawn = taken @ member
    now, step = distance(drawn), max(1, int(taken.sum()) // 2)
    while step:
        best = None
        for a in np.flatnonzero(taken):
            moved = np.minimum(np.minimum(step, taken[a]), available - taken)  # to each signature
            moved[(member == member[a]).all(axis=1)] = 0
            then = np.where(moved > 0, distance(drawn + moved[:, None] * (member - member[a])), now)
            b = int(then.argmin())
            if then[b] < now and (best is None or then[b] < best[0]):
                best = (then[b], a, b, int(moved[b]))
        if best is None:
            step //= 2
            continue
        now, a, b, count = best
        taken[a] -= count
        taken[b] += count
        drawn = taken @ member
    return dict(zip(names, taken.tolist()))


@dataclass
class Draw:
    """A plan's targets with what is available and what is drawn."""

    plan_id: int
    targets: list[Target]
    available: dict[str, int]
    taken: dict[str, int]

    def of(self, counts: dict[str, int], target: Target) -> int:
        return sum(n for s, n in counts.items() if s and str(target.target_id) in s.split(","))

    def report(self) -> list[Row]:
        size = sum(self.taken.values())
        rows = []
        for t in self.targets:
            there, got = self.of(self.available, t), self.of(self.taken, t)
            need = max(t.wanted, t.floor)
            missed = got != need
            reason = "scarce" if there < need else "competing" if missed else None
            rows.append((self.plan_id, t.target_id, t.size, t.share, t.floor, there, need, got, got / size if size else None, reason == "scarce", got >= min(t.floor, there), reason))
        return rows


REPORT = "plan_id bigint, target_id bigint, sample_size int, target_share double, min_rows int, available bigint, needed bigint, drawn bigint, drawn_share double, cannot_be_met boolean, floor_kept boolean, reason string"


def plan_draws(dialogues: DataFrame, targets: DataFrame, seed: int = 42) -> list[Draw]:
    """Counts per signature of every plan, in one pass over the records, and the repaired draws."""
    plans = read_plans(targets)
    if not plans:
        return []
    counts = signature_counts(dialogues, plans)
    return [Draw(plan, own, counts.get(plan, {}), repair(counts.get(plan, {}), own, seed)) for plan, own in plans.items()]


def signature_counts(dialogues: DataFrame, plans: dict[int, list[Target]]) -> dict[int, dict[str, int]]:
    """Records per plan and signature; a plan's cells bound their number (see above), which is checked."""
    each = F.explode(F.array(*(F.struct(F.lit(plan).cast("bigint").alias("plan_id"), signature(own).alias("signature")) for plan, own in plans.items())))
    bound = sum((len({t.scenario for t in own}) + 1) * (2 * len({(t.low, t.high) for t in own}) + 2) for own in plans.values())
    rows = distinct_records(dialogues).select(each.alias("p")).groupBy("p.plan_id", "p.signature").count().limit(bound + 1).collect()
    if len(rows) > bound:
        raise RuntimeError("more signatures than cells")
    out: dict[int, dict[str, int]] = {}
    for r in rows:
        out.setdefault(r.plan_id, {})[r.signature] = r["count"]
    return out


def target_report(dialogues: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    rows = [row for draw in plan_draws(dialogues, targets, seed) for row in draw.report()]
    return dialogues.sparkSession.createDataFrame(rows, REPORT)


def draw_samples(dialogues: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``plan_id, rec_id, id, scenario, n_turns, signature`` of the drawn rows of all plans."""
    spark = dialogues.sparkSession
    draws = plan_draws(dialogues, targets, seed)
    quota = spark.createDataFrame([(d.plan_id, s, n) for d in draws for s, n in d.taken.items() if n > 0], "plan_id bigint, signature string, quota bigint")
    if not draws:
        return spark.createDataFrame([], "plan_id bigint, rec_id bigint, id string, scenario string, n_turns int, signature string")
    each = F.explode(F.array(*(F.struct(F.lit(d.plan_id).cast("bigint").alias("plan_id"), signature(d.targets).alias("signature")) for d in draws)))
    records = distinct_records(dialogues).withColumn("p", each).select("p.*", "rec_id", "id", "scenario", "n_turns")
    records = records.withColumn("hash", F.xxhash64(F.lit(seed), "plan_id", "rec_id", "id")).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
    histogram = records.groupBy("plan_id", "signature", "bucket").count()
    upto = Window.partitionBy("plan_id", "signature").orderBy("bucket")
    cuts = (
        histogram.withColumn("before", F.sum("count").over(upto) - F.col("count"))
        .join(F.broadcast(quota), ["plan_id", "signature"])  # as many rows as signatures, a fixed number
        .where("before < quota")
        .select("plan_id", "signature", "bucket", (F.col("quota") - F.col("before")).alias("room"), "count")
    )
    kept = records.join(cuts, ["plan_id", "signature", "bucket"])
    whole = kept.where("room >= count")
    rank = F.row_number().over(Window.partitionBy("plan_id", "signature").orderBy("hash", "rec_id"))
    partly = kept.where("room < count").withColumn("rank", rank).where("rank <= room").drop("rank")
    return whole.unionByName(partly).select("plan_id", "rec_id", "id", "scenario", "n_turns", "signature")


def unmet_targets(dialogues: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    return target_report(dialogues, targets, seed).where("cannot_be_met").select("plan_id", "target_id")


def drawn_counts(dialogues: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``plan_id, n_rows, n_ids, floors_kept, within_plan``: the drawn rows counted anew, against the plan's size and floors."""
    rows = draw_samples(dialogues, targets, seed)
    sizes = rows.groupBy("plan_id").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"))
    each = rows.select("plan_id", F.explode(F.split("signature", ",")).alias("t")).where("t <> ''").groupBy("plan_id", F.col("t").cast("bigint").alias("target_id")).agg(F.count("*").alias("got"))
    report = target_report(dialogues, targets, seed)
    joined = report.join(each, ["plan_id", "target_id"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    kept = joined.groupBy("plan_id").agg(F.bool_and(F.col("got") >= F.least("min_rows", "available")).alias("floors_kept"), F.bool_and(F.col("got") == F.col("drawn")).alias("as_reported"))
    return sizes.join(kept, "plan_id").select("plan_id", "n_rows", "n_ids", "floors_kept", "as_reported")
