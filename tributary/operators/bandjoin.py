"""Band joins |l - r| <= d by bins, so that they are equi-joins with a remainder.

A bin is 2d + 1 wide; a left key's band touches two bins at most, a right key lies in one. So each matching pair
meets exactly once, and the planner's hash or sort-merge join does the work, spread by bin.

Sums over bands need no pairs: they are differences of running sums within a bin, so a key costs two rows however wide
its band is and however many keys lie in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.operators.tables import floor_div


def bin_of(key: Column, width: int) -> Column:
    """floor(key / width) in whole numbers."""
    return floor_div(key, width) if width > 1 else key.cast("long")


def band_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, width: int, also: list[tuple[str, str]] = ()) -> DataFrame:
    """All columns of both sides for pairs in the band; also: pairs of columns that must be equal."""
    same = [left[a] == right[b] for a, b in also]
    if width == 0:
        return left.join(right, [left[left_key] == right[right_key], *same])
    size = 2 * width + 1
    key = F.col(left_key).cast("long")
    binned = left.withColumn("_lbin", F.explode(F.array_distinct(F.array(bin_of(key - width, size), bin_of(key + width, size)))))
    other = right.withColumn("_rbin", bin_of(F.col(right_key), size))
    on = (F.col("_lbin") == F.col("_rbin")) & other[right_key].cast("long").between(binned[left_key].cast("long") - width, binned[left_key].cast("long") + width)
    for a, b in also:
        on = on & (binned[a] == other[b])
    return binned.join(other, on).drop("_lbin", "_rbin")


def band_sums(keys: DataFrame, key: str, told: DataFrame, told_key: str, width: int, also: list[tuple[str, str]] = ()) -> DataFrame:
    """For distinct keys, the sum _m of told (told_key, _m), a row a key, over keys in the band; keys without any go.

    also: pairs of columns that must be equal. A band [k - d, k + d] reaches into two bins at most: of the first it takes what
    lies at or above its lower end, of the second what lies at or below its upper end. So it is a bin's sum less, or just, a running sum
    at the band's end, which comes from one pass over a bin's keys and band ends in order. A bin holds at most
    2 (2d + 1) of these, and what a bin sums to is added up before.
    """
    mine, theirs = [a for a, _ in also], [b for _, b in also]
    kind = told.schema["_m"].dataType
    told = told.withColumnsRenamed(dict(zip(theirs, mine)))
    if width == 0:
        return keys.join(told.withColumnRenamed(told_key, key), [key, *mine]).select(key, *mine, "_m")
    size = 2 * width + 1
    k = F.col(key).cast("long")
    ends = keys.select(key, *mine, F.explode(F.array(F.struct((k - width).alias("at"), F.lit(True).alias("low")), F.struct((k + width).alias("at"), F.lit(False).alias("low")))).alias("_e"))
    ends = ends.select(key, *mine, F.col("_e.at").alias("_at"), F.col("_e.low").alias("_low"), bin_of(F.col("_e.at"), size).alias("_bin"), F.lit(0).cast(kind).alias("_v"))
    own = told.select(F.lit(None).cast(keys.schema[key].dataType).alias(key), *mine, F.col(told_key).cast("long").alias("_at"), F.lit(None).cast("boolean").alias("_low"), bin_of(F.col(told_key), size).alias("_bin"), F.col("_m").alias("_v"))
    # At one place: a lower end stands before the key there, an upper end after it.
    place = F.when(F.col("_low"), 0).when(F.col("_low").isNull(), 1).otherwise(2)
    both = ends.unionByName(own).withColumn("_place", place)
    so_far = F.sum("_v").over(W.partitionBy("_bin", *mine).orderBy("_at", "_place").rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum("_v").over(W.partitionBy("_bin", *mine))
    first = bin_of(F.col(key).cast("long") - width, size)
    last = bin_of(F.col(key).cast("long") + width, size)
    met = both.withColumns({"_so_far": so_far, "_whole": whole}).filter("_low IS NOT NULL")
    # Both ends in one bin: upper less lower; else the rest of the first bin and the beginning of the second.
    part = F.when(~F.col("_low"), F.col("_so_far")).when(first == last, -F.col("_so_far")).otherwise(F.col("_whole") - F.col("_so_far"))
    return met.groupBy(key, *mine).agg(F.sum(part).cast(kind).alias("_m")).filter("_m != 0")
