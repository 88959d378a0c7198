"""Uniform samples of a join: by result numbers, without making the join, or by hashing made results."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.plans.spec import SampleSpec

#: Up to so many times the sample size, drawing distinct numbers one by one gives way to a shuffle of all numbers.
REBUILD = 2


def md5_number(seed: object, i: int) -> int:
    return int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:15], 16)


def draw_numbers(sampling: SampleSpec, size: int, avoid: set[int] = frozenset()) -> list[int]:
    """Result numbers in [0, size) for "swr" and "swor": as many as the sample has, whatever the join's size.

    Deterministic: "swr" takes number i from MD5 of seed and i, "swor" the first distinct ones of these, or, where
    the join has at most twice as many results, those of least MD5. avoid: numbers that "swor" must not draw.
    """
    if size <= 0:
        return []
    k, fixed = int(sampling.amount), sampling.deterministic
    generator = random.Random(sampling.seed)
    if sampling.kind == "swr":
        return [md5_number(sampling.seed, i) % size if fixed else generator.randrange(size) for i in range(k)]
    free = size - len(avoid)
    if free <= REBUILD * k:
        order = [j for j in range(size) if j not in avoid]  # at most REBUILD times the sample and what it avoids
        if free <= k:
            return order
        return sorted(order, key=lambda j: (md5_number(sampling.seed, j), j))[:k] if fixed else generator.sample(order, k)
    seen, out, i = set(avoid), [], 0
    while len(out) < k:
        j = md5_number(sampling.seed, i) % size if fixed else generator.randrange(size)
        i += 1
        if j not in seen:
            seen.add(j)
            out.append(j)
    return out


def fixed_gap(seed: str, i: int, rate: float) -> int:
    """A geometric number, 1 or more, by inversion of a uniform one in (0, 1)."""
    return fixed_gaps(seed, range(i, i + 1), rate)[0]


def fixed_gaps(seed: str, numbers: range, rate: float) -> list[int]:
    """A gap for each number, from MD5 as md5_number() has it."""
    start, less, log, whole = hashlib.md5(f"{seed}|".encode()), math.log(1 - rate), math.log, int.from_bytes
    out = []
    for i in numbers:
        h = start.copy()
        h.update(b"%d" % i)
        out.append(1 + math.floor(log(((whole(h.digest()[:8]) >> 4) + 0.5) / 2**60) / less))
    return out


def bernoulli_numbers(spark: SparkSession, sampling: SampleSpec, size: int, each: int = 50_000) -> DataFrame:
    """(draw, _j): each number in [0, size) with a probability of the rate, by geometric gaps.

    A Bernoulli sample grows with the join, so tasks make it: one for each block of numbers with about `each` in it.
    Gaps have no memory, so blocks are independent. Each block's generator is seeded by the seed and the block; a deterministic
    sample takes the i-th gap of block b from MD5 of "seed|b|i", which SQL elsewhere can repeat.
    """
    rate, seed, fixed = sampling.amount, sampling.seed, sampling.deterministic
    blocks = max(1, int(size * rate / each))
    step = -(-size // blocks)
    kind = "long" if size < 1 << 62 else "string"  # larger numbers travel as text

    def run(it):
        import pandas as pd

        for part in it:
            for b in part["id"].tolist():
                generator, at, end, out, done = np.random.default_rng([seed, b]), b * step - 1, min(size, (b + 1) * step), [], 0
                while at < end:
                    gaps = fixed_gaps(f"{seed}|{b}", range(done, done + 1024), rate) if fixed else generator.geometric(rate, 1024).tolist()
                    done += 1024
                    for gap in gaps:
                        at += gap
                        if at >= end:
                            break
                        out.append(at)
                yield pd.DataFrame({"draw": [b * (1 << 32) + i for i in range(len(out))], "j": out if kind == "long" else list(map(str, out))}, dtype=None if kind == "string" else "int64")

    made = spark.range(0, blocks, 1, min(blocks, 10_000)).mapInPandas(run, f"draw long, j {kind}")
    return made.select("draw", F.col("j").cast("decimal(38,0)").alias("_j"))


def numbers_frame(spark: SparkSession, numbers: list[int], first: int = 0, draws: list[int] | None = None) -> DataFrame:
    """(draw, _j), draws counting from `first` unless they are given; numbers may exceed a long, so they travel as text."""
    own = draws if draws is not None else range(first, first + len(numbers))
    rows = spark.createDataFrame([(d, str(j)) for d, j in zip(own, numbers)], "draw long, j string")
    return rows.select("draw", F.col("j").cast("decimal(38,0)").alias("_j"))


def result_hash(results: DataFrame, rids: list[str], seed: object) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c) for c in rids]))


def bernoulli_of(results: DataFrame, rids: list[str], rate: float, seed: object) -> DataFrame:
    """Each made result with a probability of rate, by its hash; the same ones whenever it is run."""
    return results.filter(F.substring(result_hash(results, rids, seed), 1, 8) < F.lit(f"{int(rate * 2**32):08x}"))


def bottom_k(results: DataFrame, rids: list[str], k: int, seed: object) -> DataFrame:
    """k made results of least hash: a sample without replacement; each task keeps k."""
    return results.withColumn("_h", result_hash(results, rids, seed)).orderBy("_h", *rids).limit(k).drop("_h")


def with_replacement(sample: DataFrame, rids: list[str], size: int, k: int, seed: object) -> DataFrame:
    """k independent uniform picks, (draw, rids...), out of a sample without replacement of min(k, size).

    Slot by slot, a pick repeats one of the d results picked so far with a probability of d / size, and else is the next
    of the sample, in the order of its hashes. Only slot numbers are drawn here.
    """
    if size <= 0:
        return sample.limit(0).select(F.lit(0).cast("long").alias("draw"), *rids)
    generator, picks, d = random.Random(str(seed)), [], 0
    for _ in range(k):
        at = generator.randrange(size)
        picks.append(at if at < d else d)
        d += at >= d
    order = Window.orderBy(result_hash(sample, rids, seed), *rids)
    numbered = sample.withColumn("_i", F.row_number().over(order) - 1)
    return sample.sparkSession.createDataFrame(list(enumerate(picks)), "draw long, _i int").join(numbered, "_i").select("draw", *rids)
