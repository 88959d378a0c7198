"""Mixing sources to target weights, by hash-threshold histograms.

Sources share `share` times all words by their weights; none may exceed `cap` times its own words,
and what it would have had beyond is shared by weight among the others until none is above. A
source takes whole passes over its documents, and of one more pass the documents whose hash
is at most the source's threshold. Thresholds are nested: a larger budget keeps what a smaller one
took. A threshold comes from sums of words by source and hash bucket; only the bucket that the budget
ends in is refined, twice by 4096, then document by document. Nothing is sorted but these sums, and
one filter on the hash makes the choice. The document at the end is in if that comes nearer the budget.

Defined results: null text has size 0; null sources are one source, the last. A document is
hashed by its id (by its text if that is null), so repeated rows are taken together. A source
without words has target 0. Shares are of words, whole documents only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.common import settle

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, STEP_BITS = 60, 12
#: Above as many sources the table of thresholds isn't broadcast on our word; the planner decides.
BROADCAST_SOURCES = 100_000


def hash60(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """(skey, source_size, target), from (skey, source_size); one row a source, so one task is enough."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    nth = sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(W.orderBy("skey")) - 1) % len(weights)) + 1))
    by_room = W.orderBy(F.col("_cap") / F.col("_w"), "skey")
    past, rest = by_room.rowsBetween(W.unboundedPreceding, -1), by_room.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    leveled = (
        nth.withColumn("_cap", F.col("source_size") * F.lit(cap))
        .withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(past), F.lit(0.0))) / F.sum("_w").over(rest))
        # The first source, by room, that its share doesn't fill sets the level for all; later ones' figures are lower.
        .withColumn("_final", F.max(F.when(F.col("_cap") > F.col("_w") * F.col("_level"), F.col("_level"))).over(everything))
    )
    return leveled.select("skey", "source_size", F.least("_cap", F.coalesce(F.col("_w") * F.col("_final"), F.col("_cap"))).alias("target"))


def thresholds(slim: DataFrame, targets: DataFrame, small) -> DataFrame:
    """Targets with columns passes and upto: the largest hash of the last, partial pass (-1: none)."""
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * size)
    ahead = plan.select("skey", "budget", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"))
    found = []
    shift = HASH_BITS
    for _ in range(2):
        shift -= STEP_BITS
        bucket = F.shiftright("h", shift)
        sums = (
            slim.withColumn("b", bucket)
            .join(small(ahead), ["skey"])
            .filter(F.shiftright("b", STEP_BITS) == F.col("at"))
            .groupBy("skey", "b").agg(F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("before").alias("before"))
        )
        run = sums.withColumn("to", F.col("before") + F.sum("n").over(W.partitionBy("skey").orderBy("b").rowsBetween(W.unboundedPreceding, 0)))
        run = settle(run.withColumn("from", F.col("to") - F.col("n")), "mix_histogram")
        found.append(run.filter(F.col("to") <= F.col("budget")).groupBy("skey").agg((F.shiftleft(F.max("b") + 1, shift) - 1).alias("upto")))
        ahead = run.filter((F.col("from") < F.col("budget")) & (F.col("to") > F.col("budget"))).select("skey", "budget", F.col("b").alias("at"), F.col("from").alias("before"))
    last = (
        slim.join(small(ahead), ["skey"]).filter(F.shiftright("h", shift) == F.col("at"))
        .groupBy("skey", "h").agg(F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("before").alias("before"))
        .withColumn("to", F.col("before") + F.sum("n").over(W.partitionBy("skey").orderBy("h").rowsBetween(W.unboundedPreceding, 0)))
    )
    found.append(last.filter(2 * F.col("to") - F.col("n") <= 2 * F.col("budget")).groupBy("skey").agg(F.max("h").alias("upto")))
    best = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("skey").agg(F.max("upto").alias("upto"))
    return plan.join(best, "skey", "left").withColumn("upto", F.when(F.col("budget") > 0, F.coalesce("upto", F.lit(-1))).otherwise(F.lit(-1)).cast("long"))


def _keyed(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column, Column]:
    """Of a document: its source as a key in the order of code points, null last; its hash; its words."""
    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))
    h = hash60(F.concat(F.lit(f"{seed}|"), F.coalesce(own, F.concat(F.lit("text|"), F.md5(text)), F.lit("null"))))
    return key, h, F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _planned(slim: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """A row a source, broadcast if sources are few: skey, source_size, target, passes, upto."""
    sizes = settle(slim.groupBy("skey").agg(F.sum("size").alias("source_size")), "mix_sources")
    small = F.broadcast if sizes.count() <= BROADCAST_SOURCES else (lambda df: df)
    return small(settle(thresholds(slim, source_targets(sizes, weights, share, cap), small), "mix_thresholds"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Rows (id, source, size, source_size, target, taken, copies), one for each row of docs.

    Texts are read once; sizes and hashes, some tens of bytes a row, are kept for the later passes.
    """
    key, h, size = _keyed(docs, seed, id_col, text_col, source_col)
    slim = settle(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("skey"), h.alias("h"), size.alias("size")), "mix_sizes")
    plan = _planned(slim, weights, share, cap)
    copies = F.col("passes") + (F.col("h") <= F.col("upto")).cast("long")
    return slim.join(plan, "skey").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")
    )


def repeat(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with the columns of docs.

    The thresholds, a row a source, meet the documents where they are; texts are not shuffled.
    """
    key, h, size = _keyed(docs, seed, id_col, text_col, source_col)
    slim = settle(docs.select(key.alias("skey"), h.alias("h"), size.alias("size")), "mix_sizes")
    plan = _planned(slim, weights, share, cap).select("skey", "passes", "upto")
    met = docs.select(F.struct("*").alias("row"), key.alias("skey"), h.alias("h")).join(plan, "skey")
    copies = (F.col("passes") + (F.col("h") <= F.col("upto")).cast("long")).cast("int")
    return met.select("row", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")
