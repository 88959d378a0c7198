"""First-in-first-out deletes, and the repair of samples after them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.sampling import draw_numbers, md5_number, numbers_frame
from tributary.operators.tables import arrival, keep, rid
from tributary.operators.unrank import prepare, unrank
from tributary.operators.windows import with_frames
from tributary.plans.planner import plan
from tributary.plans.spec import QueryError, SampleSpec, Spec, Stream


def without_oldest(df: DataFrame, order: str, n: int) -> DataFrame:
    """df without its n first rows by a whole-number column whose values are unique; all of them, if fewer."""
    return arrival(df, [], order).filter(F.col("_idx") >= n).drop("_idx") if n else df


def after_deletes(spec: Spec, orders: dict[str, str], counts: dict[str, int]) -> Spec:
    """The query after the n oldest rows of streams have gone. orders: the column of each stream's arrival order."""

    def change(s: Stream) -> DataFrame:
        n = counts.get(s.name, 0)
        if n < 0:
            raise QueryError("a delete is of 0 rows or more")
        return without_oldest(s.frame, orders[s.name], n) if n else s.frame

    return with_frames(spec, change)


def survivors(sample: DataFrame, spec: Spec) -> DataFrame:
    """The rows of a sample (draw, <stream>_rid...) all of whose members are still there."""
    left = sample
    for s in spec.streams.values():
        left = left.join(s.frame.select(rid(s).alias(f"{s.name}_rid")), f"{s.name}_rid", "left_semi")
    return left


def state_seed(seed: object, size: int, left: int, nth: int) -> int:
    """A seed for the draws of one repair: by the join's size, what the sample still holds, and the repair's number."""
    return md5_number(f"{seed}|repair|{nth}|{size}", left)


def repaired(spec: Spec, sample: DataFrame, sampling: SampleSpec, use_keys: bool = True, nth: int = 0) -> DataFrame:
    """The sample after rows have gone from spec's tables: (draw, <stream>_rid...).

    Bernoulli: what survives. Without replacement: survivors, filled up with fresh results that are not among them.
    With replacement: a fresh draw in each slot that lost its result. Each is again a uniform sample of what is left.
    Fresh draws depend on the state, so repairs that follow each other draw independently.
    """
    spark, rids = sample.sparkSession, [f"{s}_rid" for s in spec.streams]
    alive = keep(survivors(sample, spec).select("draw", *rids), "survivors")
    if sampling.kind == "bernoulli":
        return alive
    k = int(sampling.amount)
    ready = prepare(spec, plan(spec, use_keys))
    kept = [r["draw"] for r in alive.select("draw").collect()]  # at most the sample's size
    seed = state_seed(sampling.seed, ready.size, len(kept), nth)
    if sampling.kind == "swr":
        lost = sorted(set(range(k)) - set(kept)) if ready.size else []
        if not lost:
            return alive
        spare = draw_numbers(SampleSpec("swr", len(lost), seed, sampling.deterministic), ready.size)
        fresh = unrank(ready, numbers_frame(spark, spare, draws=lost))
        return alive.unionByName(fresh.select("draw", *rids))
    want = min(k, ready.size) - len(kept)
    if want <= 0:
        return alive
    # Survivors fill at most len(kept) of the drawn results, so these and as many more hold enough others.
    spare = draw_numbers(SampleSpec("swor", want + len(kept), seed, sampling.deterministic), ready.size)
    fresh = unrank(ready, numbers_frame(spark, spare, first=1 + max([*kept, k])))
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in rids])
    new = fresh.alias("a").join(alive.alias("b"), same, "left_anti").orderBy("draw").limit(want)
    return alive.unionByName(new.select("draw", *rids))
