"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Each document's distinct word shingles are hashed once. The top bits of a hash choose its bin, and a bin keeps its
least hash; an empty bin takes the value of another, found by a fixed random walk over bins that is the
same for all documents. Bands of bins are bucket keys. In each bucket every document is paired with one centre, so a
bucket gives as many candidate pairs as members, not their square. The centre is the member that meets most others
in all its buckets: of a document and its many altered copies that is the document, which is nearer to each copy than
they are to each other. Candidates are confirmed on full shingle sets, and confirmed pairs joined to components.

A star can miss a link between two members that are both unlike the centre. So buckets whose members
lie in different components after the stars are looked at again: pairs across components are confirmed too, if
their sizes allow the similarity and their parity sketches do. A parity sketch has a bit for each of 2048 classes
of hashes, set if the set has an odd number of that class; two sketches differ in at most as many bits as the
sets in elements. So the bound is exact: it drops only pairs that can't be similar. Such pairs are compared within the
join and not made; pairs within a component are not even compared.

With 32 bands of 4 bins a pair at 0.75 shares no bucket with probability 5e-6, at 0.8 with 4e-8.

Documents with equal shingle sets become one row before any of this, combined before the shuffle, so a
group of exact copies of any size costs one row a task. Shingles are compared as 64-bit hashes.

Defined results: a document without words, or null, has an empty set and links with nothing. A null id has a null
component and is kept unless it has a set that a row with an id shares: rows without id are linked by equal sets only.
Repeated rows get equal results. Ids may be of any ordered type.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import SPACE_WORDS, arrow_type, batches, columns_of, discard, id_filter, settle, small_batches, split_by, words_of
from tributary.llm.components import components

BINS, BAND = 128, 4
#: Words whose hashes a worker remembers at most, and bytes of such a word.
REMEMBERED, LONGEST = 200_000, 64
#: Bits of a parity sketch, in words of 64.
SKETCH = 2048
#: Slots of a walk over bins; the walk of a bin repeats after them, and then the nearest full bin is taken.
WALK = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


def shingle_set(words: list[bytes], hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(k, len(own))
    n = len(own) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def walks(bins: int = BINS) -> np.ndarray:
    """For each empty bin the bins to try, in order."""
    steps = mixed(np.arange(bins * WALK, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return (steps % np.uint64(bins)).astype(np.int64).reshape(bins, WALK)


def signature(own: np.ndarray, walk: np.ndarray) -> np.ndarray:
    """The densified bins of a sorted, non-empty set: 32-bit values."""
    bins = len(walk)
    at = (own >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])  # the set is sorted, so a bin's first is its least
    full = np.zeros(bins, bool)
    full[at[first]] = True
    out = np.zeros(bins, np.uint32)
    out[at[first]] = (mixed(own[first]) >> np.uint64(32)).astype(np.uint32)
    empty = np.flatnonzero(~full)
    if len(empty):
        tries, step = walk[empty], 32
        source, left = np.full(len(empty), -1), np.arange(len(empty))
        for k in range(0, WALK, step):
            hit = full[tries[left, k : k + step]]
            some = hit.any(axis=1)
            source[left[some]] = tries[left[some], k + hit[some].argmax(axis=1)]
            left = left[~some]
            if not len(left):
                break
        source[left] = at[first[0]]
        out[empty] = out[source]
    return out


def band_keys(bins: np.ndarray) -> np.ndarray:
    """A 64-bit key for each BAND bins, by their values and place."""
    rows = bins.reshape(-1, BAND).astype(np.uint64)
    key = np.arange(len(rows), dtype=np.uint64)
    for i in range(BAND):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def parity(own: np.ndarray) -> np.ndarray:
    """The parity sketch of a set of hashes: SKETCH // 64 whole numbers."""
    odd = np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str, with_sets: bool, by_text: bool = False) -> DataFrame:
    """Rows (id, n, node, bands, odd) of all docs, or (id, n, node, sh) with the hashes of their shingles.

    node: a 64-bit hash of the set, which names it; bands: the bucket keys; odd: the parity sketch; by_text: text_hash too.
    """
    import pyarrow as pa
    import xxhash

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), *([F.xxhash64(text_col).alias("text_hash")] if by_text else []))
    kind, own_type, slim_columns = slim.schema["id"].dataType.simpleString(), arrow_type(slim, "id"), slim.columns

    def run(it):
        hashes, walk = WordHashes(), walks()
        for rows in batches(columns_of(it, *slim_columns), lambda r: len(r[1] or b"") + 1000, 4 << 20):
            ids, sets = [r[0] for r in rows], [shingle_set(words_of(r[1], SPACE_WORDS), hashes, words) for r in rows]
            n = pa.array([len(s) for s in sets], pa.int64())
            node = pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
            if with_sets:
                flat = np.concatenate(sets).view(np.int64)
                cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, own_type), n, node, pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=["id", "n", "node", "sh"])
            else:
                bands = pa.array([band_keys(signature(s, walk)) if len(s) else None for s in sets], pa.list_(pa.int64()))
                odd = pa.array([parity(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids, own_type), n, node, bands, odd, *([pa.array([r[2] for r in rows], pa.int64())] if by_text else [])], names=["id", "n", "node", "bands", "odd", *slim_columns[2:]])

    return slim.mapInArrow(run, f"id {kind}, n long, node long, sh array<long>" if with_sets else f"id {kind}, n long, node long, bands array<long>, odd binary" + (", text_hash long" if by_text else ""))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose full sets are similar. Shingles are made anew, for one document of each such node."""
    wanted = settle(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "id"), "node"), "candidates")
    bits = settle(id_filter(wanted, "id"), "candidate_bits")
    texts, _ = split_by(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", bits)
    # Some texts are not asked for, and an id may come with several; only the sets asked for stay, each once.
    sets = settle(sketches(texts, words, "id", "text", True).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]).select("node", "n", "sh"), "candidate_sets")
    one, two = sets.toDF("a", "na", "sa"), sets.toDF("b", "nb", "sb")
    same = F.size(F.array_intersect("sa", "sb"))
    links = settle(pairs.join(one, "a").join(two, "b").filter(100 * same >= threshold * (F.col("na") + F.col("nb") - same)).select("a", "b"), "links")
    discard(wanted, bits, sets)
    return links


def near_duplicates(docs: DataFrame, threshold: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text", by_text: bool = False) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for each row of docs.

    threshold: the least similarity, in hundredths. component_id: the least id of those that links reach.
    by_text: with text_hash, xxhash64 of the text, as rows that share an id may differ in text and so in kept.
    """
    own_hash = ["text_hash"] if by_text else []
    full = settle(sketches(docs, words, id_col, text_col, False, by_text), "sketches")
    grouped = full.filter("n > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    nodes, own = settle(grouped, "sets"), settle(full.select("id", "n", "node", *own_hash), "documents")
    discard(full)

    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    placed = settle(members.join(shared, "key"), "placed")
    crowd = placed.groupBy("node").agg(F.sum("m").alias("met"))
    crowded = placed.join(crowd, "node")
    centres = crowded.groupBy("key").agg(F.max(F.struct("met", "node", "n")).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("n2"))
    possible = F.least("n", "n2") * 100 >= threshold * F.greatest("n", "n2")
    stars = placed.join(centres, "key").filter(F.col("node") != F.col("centre")).filter(possible)
    stars = settle(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "stars")
    links = confirmed(stars, nodes, docs, threshold, words, id_col, text_col)
    roots = settle(components(links), "roots")

    # What the stars leave: buckets with members of several components.
    rooted = placed.select("key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
    left = rooted.join(several, "key", "left_semi").join(nodes.select("node", "odd"), "node")
    left = settle(left.select("key", "node", "n", "root", *words_of_sketch("odd")), "left")
    one = left.withColumnsRenamed({"node": "a", "root": "ra"})
    two = left.toDF("key2", "b", "n2", "rb", *[f"{c}_2" for c in SKETCH_COLUMNS])
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_2"))) for c in SKETCH_COLUMNS[1:]), F.bit_count(F.col(SKETCH_COLUMNS[0]).bitwiseXOR(F.col(f"{SKETCH_COLUMNS[0]}_2"))))
    # Of sets with n and n2 elements that are similar enough, at most this share differs.
    near = (100 + threshold) * apart <= (100 - threshold) * (F.col("n") + F.col("n2"))
    met = one.join(two, (F.col("key") == F.col("key2")) & (F.col("ra") < F.col("rb")) & possible & near)
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = settle(met.join(stars, ["a", "b"], "left_anti"), "across")
    if tried.limit(1).count():
        more = confirmed(tried, nodes, docs, threshold, words, id_col, text_col)
        if more.limit(1).count():
            roots = settle(components(links.unionByName(more)), "all_roots")

    discard(placed, stars, left, tried)
    rooted = nodes.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    known = rooted.join(least, "root").select("node", "component_id")
    out = own.select("id", "n", *own_hash, F.when(F.col("n") > 0, F.col("node")).alias("node")).join(known, "node", "left")
    whole = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), whole.alias("component_id"), whole.eqNullSafe(F.col("id")).alias("kept"), *own_hash)


SKETCH_COLUMNS = [f"w{i}" for i in range(SKETCH // 64)]


def words_of_sketch(column: str) -> list[Column]:
    """A sketch as whole numbers, so that comparing two is compiled code."""
    half = lambda i: F.conv(F.hex(F.substring(F.col(column), 8 * i + 1, 8)), 16, -10).cast("long")
    return [half(i).alias(c) for i, c in enumerate(SKETCH_COLUMNS)]
