"""Keeping a join's size and sample up to date while rows arrive in batches.

The results that a batch adds are split by the first stream, in the order of the streams, that contributes a new row: of
term i, streams before i take part with all their rows, stream i with its new ones, and streams after i with their old ones.
Each term is a join like the whole, so its size comes from weights and its results have numbers. No old result
is counted or drawn again. The join tree of a term has its new rows at the root, and other tables only keep
rows whose keys are asked for on the way from there; so what is grouped and shuffled goes with the batch.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.sampling import bernoulli_numbers, draw_numbers, numbers_frame
from tributary.operators.tables import keep
from tributary.operators.unrank import prepare, unrank
from tributary.operators.weights import total
from tributary.plans.planner import Node, plan
from tributary.plans.spec import SampleSpec, Spec


@dataclass
class Term:
    """A part of the added results: a query whose stream `first` has new rows only."""

    spec: Spec
    first: str
    use_keys: bool = True

    def tree(self) -> Node:
        return plan(self.spec, self.use_keys, root=self.first)

    def size(self) -> int:
        return int(total(self.spec, self.tree(), near=True).agg(F.sum("n_seen")).first()[0] or 0)

    def draw(self, numbers: DataFrame) -> DataFrame:
        """Results by number: (draw, <stream>_rid...)."""
        return unrank(prepare(self.spec, self.tree(), near=True), numbers)


def terms(spec: Spec, new: dict[str, DataFrame], use_keys: bool = True) -> list[Term]:
    """The query split as above. spec: over the old rows; new: the rows that streams get."""
    out, order = [], list(spec.streams)
    for i, name in enumerate(order):
        if name not in new:
            continue
        frames = {other: spec.streams[other].frame.unionByName(new[other]) for other in order[:i] if other in new}
        out.append(Term(spec.over({**frames, name: new[name]}), name, use_keys))
    return out


def grown(spec: Spec, new: dict[str, DataFrame]) -> Spec:
    """The query over old and new rows."""
    return spec.over({n: spec.streams[n].frame.unionByName(df) for n, df in new.items()})


def size(spec: Spec, use_keys: bool = True) -> int:
    return int(total(spec, plan(spec, use_keys)).first()["n_seen"])


def added(spec: Spec, new: dict[str, DataFrame], use_keys: bool = True) -> list[tuple[Term, int]]:
    """Each term with the number of results that it adds."""
    return [(t, t.size()) for t in terms(spec, new, use_keys)]


def by_numbers(parts: list[tuple[Term, int]], numbers: list[tuple[int, int]]) -> DataFrame | None:
    """Added results by number over all terms; numbers: (draw, number)."""
    out, before = None, 0
    for term, n in parts:
        own = [(d, j - before) for d, j in numbers if before <= j < before + n]
        before += n
        if own:
            spark = next(iter(term.spec.streams.values())).frame.sparkSession
            drawn = term.draw(numbers_frame(spark, [j for _, j in own], draws=[d for d, _ in own]))
            out = drawn if out is None else out.unionByName(drawn)
    return out


def absorbed(spec: Spec, sample: DataFrame, new: dict[str, DataFrame], use_keys: bool = True) -> DataFrame:
    """The sample (draw, <stream>_rid...) of the old results, made one of old and added results.

    Without replacement: how many of the k are added results is hypergeometric; they take the place of as many random
    ones. With replacement: each slot takes an added result with the probability of their share. Bernoulli: added
    results join with the same probability. draw numbers only tell rows apart.
    """
    how = spec.sampling
    parts = added(spec, new, use_keys)
    more = sum(n for _, n in parts)
    rids = [f"{s}_rid" for s in spec.streams]
    spark = next(iter(spec.streams.values())).frame.sparkSession
    held = keep(sample.select("draw", *rids), "sample")
    if not more:
        return held
    seed = how.seed + 1 + more
    if how.kind == "bernoulli":
        for term, n in parts:
            if n:
                numbers = keep(bernoulli_numbers(spark, SampleSpec("bernoulli", how.amount, seed), n), "numbers")
                held = held.unionByName(term.draw(numbers).select("draw", *rids))
                seed += 1
        return held
    k, old = int(how.amount), size(spec, use_keys)
    draws = [r["draw"] for r in held.select("draw").orderBy("draw").collect()]  # at most k
    if how.kind == "swr":
        generator = random.Random(seed)
        slots = list(range(k))
        taken = [d for d in slots if not old or generator.randrange(old + more) < more]
        picks = draw_numbers(SampleSpec("swr", len(taken), seed), more) if taken else []
    else:
        want = min(k, old + more)
        n = want if not old else int(np.random.default_rng(seed).hypergeometric(more, old, want)) if old + more < 10**9 else _hypergeometric(seed, more, old, want)
        n = max(n, want - len(draws))
        stay = set(random.Random(seed).sample(draws, want - n)) if want > n else set()
        picks = draw_numbers(SampleSpec("swor", n, seed), more) if n else []
        top = max(draws, default=-1) + 1
        taken = [d for d in draws if d not in stay]
        taken = (taken + list(range(top, top + n)))[:n]
        gone = [d for d in draws if d not in stay]
        held = held if not gone else held.join(spark.createDataFrame([(d,) for d in gone], "draw long"), "draw", "left_anti")
    if not picks:
        return held
    if how.kind == "swr":
        held = held.join(spark.createDataFrame([(d,) for d in taken], "draw long"), "draw", "left_anti")
    fresh = by_numbers(parts, list(zip(taken, picks)))
    return held.select("draw", *rids).unionByName(fresh.select("draw", *rids))


def _hypergeometric(seed: int, good: int, bad: int, n: int) -> int:
    """For sizes beyond the library's: n draws one by one."""
    generator, got = random.Random(seed), 0
    for _ in range(n):
        if generator.randrange(good + bad) < good:
            good, got = good - 1, got + 1
        else:
            bad -= 1
    return got
