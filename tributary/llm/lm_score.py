"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training documents' bigrams are counted over the whole corpus. Counts are quantised to levels that grow
by a quarter; a bigram of level q is put into the filter q times, with 1, 2, ... q beside it. A count is read back by
membership probes for 1, 2, ... until one fails, so errors are one-sided and rare. The filter consists of
segments, chosen by hash, of about a million bigrams each.

p(w|h) = (c(hw) + t(h) p0(w)) / (c(h) + t(h)): Witten-Bell smoothing, with p0 the base model (words, exact counts, half a
count added) and t(h) = c(h)^b for the number of words that follow h. b is such that these sum to the number of distinct
bigrams. A count read from the filter is lowered to c(h) and c(w), which it can't exceed.

Plan. Texts are read once and kept as batches: word numbers, and the hashes of each batch's own vocabulary. Word
counts are summed by hash segment and each batch gets back the counts of its vocabulary, so no task and no worker needs the
corpus' vocabulary. The filter is broadcast while it has at most `max_broadcast` bytes; beyond, each batch's distinct
bigrams are sent to the segments and their levels come back, with the same results.

Words are known by 64-bit hashes, bigrams in a segment by 40 further bits.

Defined results: null text is empty: one token, the end. A null id counts as empty text for the split. Rows come back one for
one. Without training documents N and V are 0 and all scores 0.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import SPACE_WORDS, arrow_type, batches, columns_of, discard, settle, small_batches, words_of
from tributary.llm.near_dedup import mixed

BATCH_BYTES = 10 << 20
#: Entries of a segment of word counts, and bigrams of a segment of the filter, about.
SEGMENT_WORDS, SEGMENT_PAIRS = 500_000, 1_000_000
HASHES, BITS_PER_ENTRY = 6, 9
#: Tokens that are scored at once, about; a document's stay together.
PART_TOKENS = 1 << 18
MAX_BROADCAST = 128 << 20
END = b" "
START_HASH = np.uint64(0x9AE16A3B2F90404F)


def thresholds(growth: float = 1.25, levels: int = 120) -> np.ndarray:
    """The least count of each level; small counts are levels of their own."""
    out = [1]
    while len(out) < levels:
        out.append(max(out[-1] + 1, round(out[-1] * growth)))
    return np.array(out, np.int64)


LEAST = thresholds()
#: The count that a level stands for: the middle of its range; level 0 is none.
MEANT = np.concatenate([[0], (LEAST + np.concatenate([LEAST[1:] - 1, LEAST[-1:]])) / 2])


def places(pairs: np.ndarray, level: int, bits: int | np.ndarray):
    """Bit numbers, HASHES times one for each pair, by double hashing; bits: of the segment, or of each pair's."""
    a = mixed(pairs + np.uint64(0x9E3779B97F4A7C15 * level % 2**64))
    b = mixed(a ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    bits = np.asarray(bits, np.uint64)
    for _ in range(HASHES):
        yield a % bits
        a = a + b


def build_filter(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits of a segment, for pairs with their counts (1 at least)."""
    level = np.searchsorted(LEAST, counts, side="right")
    bits = max(64, -(-int(level.sum()) * BITS_PER_ENTRY // 8) * 8)
    own = np.zeros(bits, np.uint8)
    live = np.arange(len(pairs))
    step = 0
    while len(live):
        step += 1
        for at in places(pairs[live], step, bits):
            own[at] = 1
        live = live[level[live] > step]
    return np.packbits(own, bitorder="little").tobytes()


def read_levels(own: np.ndarray, pairs: np.ndarray, bits: int | np.ndarray, start: int | np.ndarray = 0) -> np.ndarray:
    """Levels by probes for 1, 2, ... until a bit is missing.

    own: the bytes of a segment, or of several; bits and start: the segment's size and first byte, or each pair's.
    """
    out, live, step = np.zeros(len(pairs), np.uint8), np.arange(len(pairs)), 0
    bits, start = (np.broadcast_to(np.asarray(x, np.int64), len(pairs)) for x in (bits, start))
    while len(live) and step < len(LEAST):
        step += 1
        found = np.ones(len(live), bool)
        first = start[live]
        for at in places(pairs[live], step, bits[live]):
            at = at.astype(np.int64)
            found &= (own[first + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
        live = live[found]
        out[live] = step
    return out


class Filter:
    """All segments in one array."""

    def __init__(self, segments: list[tuple[int, bytes]], count: int):
        self.bytes = np.frombuffer(b"".join(b for _, b in segments), np.uint8)
        self.bits, self.start = np.zeros(count, np.int64), np.zeros(count, np.int64)
        at = 0
        for s, b in segments:
            self.bits[s], self.start[s] = 8 * len(b), at
            at += len(b)

    def levels(self, pairs: np.ndarray, segment_bits: int) -> np.ndarray:
        """pairs: sorted, so those of a segment follow each other and its bytes stay at hand."""
        segment, out = segment_of(pairs, segment_bits), np.zeros(len(pairs), np.uint8)
        there = np.flatnonzero(self.bits[segment])
        segment = segment[there]
        out[there] = read_levels(self.bytes, within(pairs[there], segment_bits), self.bits[segment], self.start[segment])
        return out


def segment_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def within(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits after those of the segment."""
    return (hashes << np.uint64(bits)) >> np.uint64(24)


def pack40(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").copy()


def cuts(segments: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment, from, to) of a sorted array."""
    if not len(segments):
        return []
    at = np.concatenate([[0], np.flatnonzero(segments[1:] != segments[:-1]) + 1, [len(segments)]]).tolist()
    return [(int(segments[a]), a, b) for a, b in zip(at, at[1:])]


def segment_bits(entries: int, each: int) -> int:
    return max(0, (-(-entries // each) - 1).bit_length())


def held_out(doc) -> bool:
    """Whether a document is kept from training."""
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 1


def text_batches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (batch, ids, held, n, tokens, vocab, trained), of about BATCH_BYTES of text each.

    tokens: numbers in vocab, packed; words are numbered as they come, so frequent ones have small numbers.
    vocab: the words' hashes; trained: each word's count in training documents.
    """
    import pyarrow as pa
    import xxhash

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind, own_type = slim.schema["id"].dataType.simpleString(), arrow_type(slim, "id")

    def run(it):
        for rows in batches(((i, t) for i, t in columns_of(it, "id", "text")), lambda r: len(r[1] or b"") + 100, BATCH_BYTES):
            known: dict[bytes, int] = {END: 0}
            number = known.setdefault
            parts = [np.array([*(number(w, len(known)) for w in words_of(t, SPACE_WORDS)), 0], np.int32) for _, t in rows]
            held = np.array([held_out(i) for i, _ in rows], bool)
            n = np.array([len(p) for p in parts], np.int32)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            tokens = np.concatenate(parts)
            trained = np.bincount(tokens[~np.repeat(held, n)], minlength=len(hashes)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(np.random.default_rng().bytes(8), np.int64)), pa.array([[i for i, _ in rows]], pa.list_(own_type)), pa.array([held.tolist()], pa.list_(pa.bool_())),
                    pa.array([n.tolist()], pa.list_(pa.int32())), *[pa.array([x], pa.binary()) for x in (pack_tokens(tokens), hashes.tobytes(), trained.tobytes())],
                ],
                names=["batch", "ids", "held", "n", "tokens", "vocab", "trained"],
            )

    return slim.mapInArrow(run, f"batch long, ids array<{kind}>, held array<boolean>, n array<int>, tokens binary, vocab binary, trained binary")


def pack_tokens(tokens: np.ndarray) -> bytes:
    """32-bit numbers, their bytes by significance, compressed."""
    import zstandard

    return zstandard.compress(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_tokens(data) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


def numbers(batch, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in batch.column(name)]


def word_counts(held: DataFrame, bits: int) -> DataFrame:
    """Rows (seg, batch, counts) with the corpus' counts of each batch's words in a segment, by hash; and a row
    a segment without batch: distinct and total words, and how many words have each count.
    """
    import pyarrow as pa

    def split(it):
        for b in it:
            for batch, vocab, trained in zip(b.column("batch").to_pylist(), numbers(b, "vocab", np.uint64), numbers(b, "trained", np.uint32)):
                order = np.argsort(vocab)
                vocab, trained = vocab[order], trained[order]
                own = cuts(segment_of(vocab, bits))
                for k in range(0, len(own), 4096):
                    some = own[k : k + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s for s, _, _ in some], pa.int64()), pa.array([batch] * len(some), pa.int64()), pa.array([vocab[x:y].tobytes() for _, x, y in some], pa.binary()), pa.array([trained[x:y].tobytes() for _, x, y in some], pa.binary())],
                        names=["seg", "batch", "vocab", "trained"],
                    )

    def total(table):
        vocab, trained = numbers(table, "vocab", np.uint64), numbers(table, "trained", np.uint32)
        words, place = np.unique(np.concatenate(vocab), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate(trained), minlength=len(words)).astype(np.int64)
        own = np.split(counts[place], np.cumsum([len(v) for v in vocab])[:-1])
        seen, times = np.unique(counts[counts > 0], return_counts=True)
        n = len(own)
        return pa.table({
            "seg": pa.array([table.column("seg")[0].as_py()] * (n + 1), pa.int64()), "batch": pa.array([*table.column("batch").to_pylist(), None], pa.int64()),
            "counts": pa.array([*(c.tobytes() for c in own), None], pa.binary()), "seen": pa.array([*[None] * n, seen.tolist()], pa.list_(pa.int64())), "times": pa.array([*[None] * n, times.tolist()], pa.list_(pa.int64())),
        })

    parts = held.select("batch", "vocab", "trained").mapInArrow(split, "seg long, batch long, vocab binary, trained binary")
    return parts.groupBy("seg").applyInArrow(total, "seg long, batch long, counts binary, seen array<long>, times array<long>")


def pair_hashes(tokens: np.ndarray, n: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """A hash for each token and the word before it, the start for a first one."""
    own = vocab[tokens]
    before = np.concatenate([[START_HASH], own[:-1]])
    before[np.cumsum(n) - n] = START_HASH
    return mixed(before * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(own))


def filter_segments(held: DataFrame, bits: int) -> DataFrame:
    """Rows (seg, bits, pairs): the filter, and how many distinct training bigrams a segment holds."""
    import pyarrow as pa

    def split(it):
        for b in it:
            for flags, n, tokens, vocab in zip(b.column("held").to_pylist(), b.column("n").to_pylist(), map(unpack_tokens, (x.as_buffer() for x in b.column("tokens"))), numbers(b, "vocab", np.uint64)):
                train = ~np.repeat(np.array(flags, bool), n)
                pairs, counts = np.unique(pair_hashes(tokens, np.array(n), vocab)[train], return_counts=True)
                own, code = cuts(segment_of(pairs, bits)), within(pairs, bits)
                for k in range(0, len(own), 4096):
                    out: list[list] = [[], [], [], []]
                    for s, x, y in own[k : k + 4096]:
                        once = counts[x:y] == 1
                        for to, v in zip(out, (s, pack40(code[x:y][once]), pack40(code[x:y][~once]), counts[x:y][~once].astype(np.uint32).tobytes())):
                            to.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=["seg", "once", "often", "counts"])

    def build(table):
        once, often = [unpack40(x.as_py()) for x in table.column("once")], [unpack40(x.as_py()) for x in table.column("often")]
        counts = numbers(table, "counts", np.uint32)
        every = np.concatenate([*once, *often])
        weights = np.concatenate([np.ones(sum(map(len, once))), *counts])
        order = np.argsort(every, kind="stable")
        every, weights = every[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        pairs, totals = every[first], np.add.reduceat(weights, first).astype(np.int64)
        return pa.table({"seg": [table.column("seg")[0].as_py()], "bits": pa.array([build_filter(pairs, totals)], pa.binary()), "pairs": [len(pairs)]})

    parts = held.select("held", "n", "tokens", "vocab").mapInArrow(split, "seg long, once binary, often binary, counts binary")
    return parts.groupBy("seg").applyInArrow(build, "seg long, bits binary, pairs long")


def sent_levels(held: DataFrame, segments: DataFrame, bits: int) -> DataFrame:
    """Rows (seg, batch, levels) for each batch's distinct bigrams, read where the segments are."""
    import pyarrow as pa

    def split(it):
        for b in it:
            for batch, n, tokens, vocab in zip(b.column("batch").to_pylist(), b.column("n").to_pylist(), map(unpack_tokens, (x.as_buffer() for x in b.column("tokens"))), numbers(b, "vocab", np.uint64)):
                pairs = np.unique(pair_hashes(tokens, np.array(n), vocab))
                code = within(pairs, bits)
                own = cuts(segment_of(pairs, bits))
                for k in range(0, len(own), 4096):
                    some = own[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in some], pa.int64()), pa.array([batch] * len(some), pa.int64()), pa.array([pack40(code[x:y]) for _, x, y in some], pa.binary())], names=["seg", "batch", "pairs"])

    def read(asked, filters):
        own = np.frombuffer(filters.column("bits")[0].as_py(), np.uint8) if filters.num_rows else None
        levels = [bytes(len(p)) if own is None else read_levels(own, p, 8 * len(own)).tobytes() for p in (unpack40(x.as_py()) for x in asked.column("pairs"))]
        return pa.table({"seg": asked.column("seg"), "batch": asked.column("batch"), "levels": pa.array(levels, pa.binary())})

    parts = held.select("batch", "n", "tokens", "vocab").mapInArrow(split, "seg long, batch long, pairs binary")
    return parts.groupBy("seg").cogroup(segments.select("seg", "bits").groupBy("seg")).applyInArrow(read, "seg long, batch long, levels binary")


def followers_power(seen: np.ndarray, times: np.ndarray, pairs: int) -> float:
    """b such that the sum over words of count ** b is the number of distinct bigrams."""
    low, high = 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if (times * seen.astype(np.float64) ** middle).sum() < pairs else (low, middle)
    return (low + high) / 2


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs."""
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    held = settle(text_batches(docs, id_col, text_col), "lm_batches", "zstd")
    trained = F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + F.when(h, 0).otherwise(1).cast("long"))
    sizes = held.agg(F.sum(F.length("vocab") / 8).cast("long").alias("words"), F.sum(trained).alias("docs")).first()
    counts = settle(word_counts(held, segment_bits(sizes["words"] or 0, SEGMENT_WORDS)), "lm_counts", "zstd")
    # How many words have each count: as many rows as there are different counts, below the square root of twice the tokens.
    shape = counts.filter("batch IS NULL").select(F.explode(F.map_from_arrays("seen", "times")).alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect()
    seen, times = np.array([r["c"] for r in shape], np.int64), np.array([r["n"] for r in shape], np.int64)
    total, distinct, starts = int((seen * times).sum()), int(times.sum()), int(sizes["docs"] or 0)
    pair_bits = segment_bits(total, SEGMENT_PAIRS)
    segments = settle(filter_segments(held, pair_bits), "lm_filter", "zstd")
    found = segments.agg(F.sum("pairs").alias("pairs"), F.sum(F.length("bits")).alias("bytes")).first()
    power = followers_power(seen, times, found["pairs"] or 0)

    answers = counts.filter("batch IS NOT NULL").select("batch", "seg", "counts", F.lit(None).cast("binary").alias("levels"))
    sent = None
    if (found["bytes"] or 0) <= max_broadcast:
        sent = docs.sparkSession.sparkContext.broadcast(Filter([(r["seg"], bytes(r["bits"])) for r in segments.toLocalIterator()], 1 << pair_bits))
        discard(segments)
    else:
        answers = answers.unionByName(sent_levels(held, segments, pair_bits).select("batch", "seg", F.lit(None).cast("binary").alias("counts"), "levels"))

    def levels_of(pairs: np.ndarray, told: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Levels of sorted distinct bigrams; told: all of the batch, if the filter isn't here, with theirs."""
        if told:
            return told[1][np.searchsorted(told[0], pairs)]
        return sent.value.levels(pairs, pair_bits)

    def score(batch, told):
        told = sorted(told.select(["seg", "counts", "levels"]).to_pylist(), key=lambda r: r["seg"])
        ids, flags, sizes = (batch.column(c)[0].as_py() for c in ("ids", "held", "n"))
        tokens, (vocab,) = unpack_tokens(batch.column("tokens")[0].as_buffer()), numbers(batch, "vocab", np.uint64)
        by_word = np.empty(len(vocab))
        by_word[np.argsort(vocab)] = np.frombuffer(b"".join(r["counts"] for r in told if r["counts"] is not None), np.int64)
        sizes = np.array(sizes, np.int64)
        every = (np.unique(pair_hashes(tokens, sizes, vocab)), np.frombuffer(b"".join(r["levels"] for r in told if r["levels"] is not None), np.uint8)) if sent is None else None
        known, base, full = [], [], []
        ends = np.cumsum(sizes)
        parts = np.flatnonzero(np.diff(ends // PART_TOKENS, prepend=-1))  # documents at which parts of the batch begin
        for a, b in zip(parts.tolist(), [*parts[1:].tolist(), len(sizes)]):
            own, n = tokens[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b]
            first = np.cumsum(n) - n
            word = by_word[own]
            p0 = (word + 0.5) / (total + 0.5 * (distinct + 1))
            before = np.concatenate([[0.0], word[:-1]])
            before[first] = starts
            pairs, place = np.unique(pair_hashes(own, n, vocab), return_inverse=True)
            pair = np.minimum(MEANT[levels_of(pairs, every)][place], np.minimum(before, word))
            others = np.maximum(before, 1e-300) ** power
            p = np.where(before > 0, (pair + others * p0) / (before + others), p0)
            for to, x in ((known, (word > 0).astype(np.int64)), (base, np.log10(p0)), (full, np.log10(p))):
                to.append(np.add.reduceat(x, first))
        return pa.table(
            [batch.column("ids")[0].values, pa.array(flags, pa.bool_()), pa.array(sizes), pa.array(np.concatenate(known)), pa.array(np.full(len(sizes), total)), pa.array(np.concatenate(base)), pa.array(np.concatenate(full))],
            names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return held.select("batch", "ids", "held", "n", "tokens", "vocab").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema)
