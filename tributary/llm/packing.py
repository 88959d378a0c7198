"""Best-fit-decreasing packing of token sequences into rows of one length.

Documents become ids of a public byte-level BPE, each closed by an end id. One longer than a row is
split into whole rows and a rest, so nothing is lost. Pieces, longest first, go to the row with the least
room that holds them; a segment tree over capacities finds it in log(length) steps. Each row
carries its id matrix line, cumulative segment lengths and positions that begin again at each segment.

Shards of about `shard_tokens` tokens are packed alone, each by the task that reads its documents: memory is
bounded, nothing is shuffled, and a lost task is simply run again. Each shard's last rows may stay
partly empty; at a million tokens that is below 1 % of the ids.

Defined results: null and empty texts are one end id. Rows come as they are, so repeated rows
are packed repeatedly. An empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import arrow_type, columns_of, small_batches

SCHEMA = "ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{kind}>, doc_starts array<long>, n_tokens int"


class CapacityTree:
    """Counts of open rows by room left; first(n) is the least room >= n that some row has, or -1."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, room: int, by: int) -> None:
        at = room + self.base
        while at:
            self.count[at] += by
            at >>= 1

    def first(self, least: int) -> int:
        count, at = self.count, least + self.base
        if not count[at]:
            # Up to the first ancestor with something to the right, then down to its leftmost row.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return -1
            at += 1
            while at < self.base:
                at = 2 * at if count[2 * at] else 2 * at + 1
        return at - self.base


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers; no piece is longer than length, none is empty."""
    rows: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(length + 1)]
    tree = CapacityTree(length)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.first(n)
        if room < 0:
            rows.append([i])
            at, room = len(rows) - 1, length
        else:
            at = open_at[room].pop()
            tree.add(room, -1)
            rows[at].append(i)
        if room > n:
            open_at[room - n].append(at)
            tree.add(room - n, 1)
    return rows


_encoders: dict[tuple, object] = {}


def encoder(ranks_file: str, pattern: str):
    """The worker's own encoder of a rank file."""
    import tiktoken

    if (ranks_file, pattern) not in _encoders:
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[ranks_file, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_file, pattern]


def pack(
    docs: DataFrame, ranks_file: str, pattern: str, length: int = 2048, end_id: int = 50256, pad_id: int = 50256, shard_tokens: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Packed rows. ids, positions: little-endian int32, length of each; cu_seqlens: from 0 to n_tokens;
    doc_ids and doc_starts: of each segment, its document and its first token's place there.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, own_type = slim.schema["id"].dataType.simpleString(), arrow_type(slim, "id")
    schema = SCHEMA.format(kind=kind)

    def shards(it):
        encode, held, total = encoder(ranks_file, pattern).encode_ordinary, [], 0
        for doc, text in columns_of(it, "id", "text"):
            ids = np.array([*(encode(text) if text else ()), end_id], dtype="<i4")
            held.append((doc, ids))
            total += len(ids)
            if total >= shard_tokens:
                yield held
                held, total = [], 0
        if held:
            yield held

    def run(it):
        for shard in shards(it):
            pieces = [(doc, at, ids[at : at + length]) for doc, ids in shard for at in range(0, len(ids), length)]
            rows = best_fit_decreasing(np.array([len(p[2]) for p in pieces]), length)
            for k in range(0, len(rows), 256):
                out: list[list] = [[] for _ in range(6)]
                for row in rows[k : k + 256]:
                    own = [pieces[i] for i in row]
                    cuts = np.concatenate([[0], np.cumsum([len(p[2]) for p in own])])
                    ids, positions = np.full(length, pad_id, "<i4"), np.zeros(length, "<i4")
                    ids[: cuts[-1]] = np.concatenate([p[2] for p in own])
                    for a, b in zip(cuts, cuts[1:]):
                        positions[a:b] = np.arange(b - a)
                    for to, x in zip(out, (ids.tobytes(), positions.tobytes(), cuts.tolist(), [p[0] for p in own], [p[1] for p in own], int(cuts[-1]))):
                        to.append(x)
                kinds = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(own_type), pa.list_(pa.int64()), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["ids", "positions", "cu_seqlens", "doc_ids", "doc_starts", "n_tokens"])

    return slim.mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrices as Parquet; a row of the file is a row of the matrix."""
    packed.write.mode("overwrite").parquet(path)


def unpacked(packed: DataFrame, length: int = 2048) -> DataFrame:
    """Rows (doc_id, start, ids array) of all segments: the way back."""
    number = "concat(substr(h, 8 * i + 7, 2), substr(h, 8 * i + 5, 2), substr(h, 8 * i + 3, 2), substr(h, 8 * i + 1, 2))"
    ids = F.expr(f"transform(sequence(0, {length - 1}), i -> cast(conv({number}, 16, 10) as int))")
    packed = packed.withColumn("h", F.hex("ids"))
    parts = packed.select(ids.alias("all"), "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "doc_starts")).alias("k", "s"))
    return parts.select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_starts").alias("start"),
        F.expr("slice(all, cu_seqlens[k] + 1, cu_seqlens[k + 1] - cu_seqlens[k])").alias("ids"),
    )
