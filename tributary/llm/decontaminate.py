"""Benchmark decontamination with an FM-index for each shard of training documents.

A phrase is any window of `window` consecutive words of a benchmark item (all of a shorter item). Each shard of
documents is indexed: its words become symbols, its suffix array gives the Burrows-Wheeler transform, held in a
wavelet matrix whose ranks drive the backward search of all phrases at once; suffix positions
sampled at every 8th place locate each occurrence. Spans that overlap or touch are merged.

The alphabet is the vocabulary of the phrases. A word outside it can be in no phrase, so it ends a run; runs shorter
than the shortest phrase are not indexed, and equal runs of a shard are indexed once and
stand for all their places. No occurrence is lost by either.

Nothing is shuffled. Phrases reach the workers in blocks of at most `block_bytes` of item text, each its own broadcast;
a larger benchmark takes more blocks, one in memory at a time. A shard is about `shard_words` words.

Defined results: null text has no words; a null item has no phrase. Rows come back one for one.
An item with a null id counts under the empty string.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import MARK_WORDS, small_batches, words_of

SHARD_WORDS = 1 << 19
BLOCK_BYTES = 4 << 20
SAMPLE = 8
HITS = "n_words long, n_hit long, items array<string>, spans array<struct<first: int, past: int>>, cut string"


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before a place."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)


class WaveletMatrix:
    """Ranks and access over symbols, a bit vector for each bit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma - 1).bit_length())
        for k in reversed(range(self.depth)):
            bits = (symbols >> k) & 1 == 1
            self.levels.append(Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        every = np.arange(sigma)
        self.start = self.down(every, np.zeros(sigma, np.int64))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often a symbol stands before a place."""
        return self.down(symbol, at) - self.start[symbol]

    def at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place, and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(at), bits.rank(at)
            symbol = 2 * symbol + one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.start[symbol]


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """By prefix doubling; the first round already compares as many symbols as an integer holds."""
    n, bits = len(text), max(1, int(sigma).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        if k < n:
            key[: n - k] += text[k:] + 1
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        key = rank * (n + 1)
        if step < n:
            key[: n - step] += rank[step:] + 1
        step *= 2


class FMIndex:
    """Of a text over symbols 1..sigma-1; 0 closes it."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.concatenate([text, [0]]).astype(np.int64)
        self.n = len(text)
        order = suffix_array(text, sigma)
        self.matrix = WaveletMatrix(text[order - 1], sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        kept = order % sample == 0
        self.marks, self.places = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length, searched backward together."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            c = phrases[live, k]
            low[live] = self.less[c] + self.matrix.rank(c, low[live])
            high[live] = self.less[c] + self.matrix.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text places of rows: back, symbol by symbol, to a sampled place."""
        rows, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.marks.get(rows[live])
            there = live[done]
            out[there] = self.places[self.marks.rank(rows[there])] + walked[there]
            live = live[~done]
            symbol, seen = self.matrix.at(rows[live])
            rows[live] = self.less[symbol] + seen
            walked[live] += 1
        return out


class Vocabulary(dict):
    """Symbols of words; 0 for others."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Phrases:
    """The phrases of a block of items: symbol 1 ends a run, words are 2 and up."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.vocabulary = Vocabulary()
        found: dict[tuple, set[str]] = defaultdict(set)
        for item, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text, MARK_WORDS)]
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if own else 0):
                found[tuple(own[i : i + size])].add(item)
        self.sigma = len(self.vocabulary) + 2
        by_length = defaultdict(list)
        for phrase, owners in found.items():
            by_length[len(phrase)].append((phrase, sorted(owners)))
        self.groups = [(k, np.array([p for p, _ in own], np.int64), [o for _, o in own]) for k, own in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)

    def hits(self, ids: np.ndarray):
        """(first word, words, owners) of each occurrence in symbols of words, 0 for other words."""
        if not self.groups or not len(ids):
            return
        inside = np.concatenate([[False], ids > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return
        places: dict[bytes, list[int]] = defaultdict(list)
        for a, b in zip(starts.tolist(), ends.tolist()):
            places[ids[a:b].tobytes()].append(a)
        runs = [np.frombuffer(r, ids.dtype) for r in places]
        at = list(places.values())
        sizes = np.array([len(r) + 1 for r in runs])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        text = np.ones(begins[-1], np.int64)
        for b, r in zip(begins.tolist(), runs):
            text[b : b + len(r)] = r
        index = FMIndex(text, self.sigma)
        for size, phrases, owners in self.groups:
            low, high = index.search(phrases)
            met = np.flatnonzero(high > low)
            n = high[met] - low[met]
            which = np.repeat(met, n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[met], n)
            spots = index.locate(rows)
            run = np.searchsorted(begins, spots, side="right") - 1
            for w, r, off in zip(which.tolist(), run.tolist(), (spots - begins[run]).tolist()):
                for a in at[r]:
                    yield a + off, size, owners[w]


def shard_hits(texts: list[bytes | None], blocks) -> list[tuple]:
    """(n_words, n_hit, items, spans) of each text; blocks gives Phrases, one after the other."""
    split = [words_of(t, MARK_WORDS) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1  # a place after each text keeps texts apart
    change = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
    owned: list[set[str]] = [set() for _ in texts]
    for phrases in blocks:
        ids = np.zeros(len(change), np.int32)
        for b, words in zip(begin.tolist(), split):
            ids[b : b + len(words)] = np.fromiter(map(phrases.vocabulary.__getitem__, words), np.int32, len(words))
        firsts, found = [], []
        for first, size, owners in phrases.hits(ids):
            change[first] += 1
            change[first + size] -= 1
            firsts.append(first)
            found.append(owners)
        if firsts:
            for doc, owners in zip((np.searchsorted(begin, firsts, side="right") - 1).tolist(), found):
                owned[doc].update(owners)
    hit = np.cumsum(change) > 0
    out = []
    for b, n, items in zip(begin.tolist(), sizes.tolist(), owned):
        spans = []
        if items:
            own = np.concatenate([[False], hit[b : b + n], [False]])
            edges = np.flatnonzero(own[1:] != own[:-1]).tolist()
            spans = list(zip(edges[::2], edges[1::2]))
        out.append((n, sum(y - x for x, y in spans), sorted(items), spans))
    return out


def item_blocks(items: DataFrame, window: int, block_bytes: int, id_col: str, text_col: str) -> list:
    """Broadcasts of Phrases; each is of items with about block_bytes of text at most, or of one item."""
    slim = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text"))
    total = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + 2 * (total // block_bytes)
    share = lambda k: slim.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else slim
    context = items.sparkSession.sparkContext
    out = []
    for k in range(n):
        own = Phrases([(r["id"], None if r["text"] is None else bytes(r["text"])) for r in share(k).toLocalIterator()], window)
        if own.groups:
            out.append(context.broadcast(own))
    return out


def find_hits(
    docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES,
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", keep: Sequence[str] | None = None, cut: bool = False,
) -> DataFrame:
    """Rows (row, hits): each row of docs, as a struct of the columns in keep (default: all), and a struct of
    n_words, n_hit, items and merged word spans; with cut, also of the text without spans, where it has any.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)

    blocks = item_blocks(items, window, block_bytes, item_id_col, item_text_col)
    wide = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col(text_col).cast("binary").alias("text"))
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))), ("cut", pa.string())
    ])

    def each_block():
        for b in blocks:
            yield b.value
            if len(blocks) > 1:
                del b._value  # else a worker would hold every block

    def answer(held):
        whole = pa.Table.from_batches(held)
        texts = whole.column("text").to_pylist()
        got = shard_hits(texts, each_block())
        clean = [cut_text(t, d) if cut and d else None for t, (_, _, _, d) in zip(texts, got)]
        hits = pa.array([{"n_words": a, "n_hit": b, "items": c, "spans": [{"first": x, "past": y} for x, y in d], "cut": t} for (a, b, c, d), t in zip(got, clean)], kind)
        rows, at = whole.select(["row"]).combine_chunks(), 0
        for part in rows.to_batches(max_chunksize=1024):
            yield pa.RecordBatch.from_arrays([part.column(0), hits.slice(at, part.num_rows)], names=["row", "hits"])
            at += part.num_rows

    def run(it):
        held, total = [], 0
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                total += sum(len(x) for x in part.column(1).to_pylist() if x) // 6
                if total >= shard_words:
                    yield from answer(held)
                    held, total = [], 0
        if held:
            yield from answer(held)

    schema = T.StructType([wide.schema["row"], T.StructField("hits", T._parse_datatype_string(HITS))])
    return wide.mapInArrow(run, schema)


def cut_text(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """UTF-8 text without the words of spans and what stands between them; a blank closes the gap."""
    marks = [m.span() for m in re.finditer(rb"[^\x20]+", raw.translate(MARK_WORDS))]
    parts, at = [], 0
    for first, past in spans:
        parts.append(raw[at : marks[first][0]])
        at = marks[past - 1][1]
    parts.append(raw[at:])
    return b" ".join(parts).decode()


def cleaned(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of find_hits(cut=True) with the cut texts, and hits; clean rows are as they were."""
    own = lambda c: F.coalesce("hits.cut", f"row.{c}") if c == text_col else F.col("row").getField(c)
    return found.select(*[own(c).alias(c) for c in found.schema["row"].dataType.names], "hits")
