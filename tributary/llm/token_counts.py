"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made.

A text's count is the number of its initial symbols less the merges made on them. Symbols are
characters; one that the vocabulary lacks falls back to its UTF-8 bytes, each a token. A heap
gives the adjacent pair of lowest rank, leftmost first; a linked list joins neighbours.

Merges never cross a place where no piece of the vocabulary can: between a character and a
following word mark, and around characters that occur in no longer piece. The text is cut there,
and counts of units are kept in a table of bounded bytes, so a frequent word is merged once a worker. Long units, such
as texts without blanks, are counted but not kept.

Defined results: a null or empty text has 0 bytes and 0 tokens. Rows come back one for one, null
ids included. There is no shuffle, and texts of any length count whole.
"""

from __future__ import annotations

import heapq
import re
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import columns_of, small_batches

MARK = "▁"
#: Bytes of the table of counted units that a worker keeps at most, and characters of a unit that enters it.
REMEMBERED_BYTES, LONGEST = 48 << 20, 64


class PieceCounter(dict):
    """Counts of units by a sentencepiece BPE model; as a dict it remembers the units it has counted."""

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        self.held = 0
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.normalize = model.normalize
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        #: Rank of a piece; the lowest merges first, and pieces of one score tie.
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.fallback = any(model.is_byte(i) for i in range(model.get_piece_size()))
        longer = [p for p in self.rank if len(p) > 1]
        within = set("".join(longer))
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in within)
        if any(MARK in p.lstrip(MARK) for p in longer):
            self.units = re.compile(rf"[^{alone}]+|[{alone}]" if alone else r"(?s).+").findall
        else:
            self.units = re.compile(rf"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (rf"|[{alone}]" if alone else "")).findall

    def symbols(self, char: str) -> int:
        return 1 if char in self.rank or not self.fallback else len(char.encode())

    def __missing__(self, unit: str) -> int:
        n = self.merged(unit)
        if len(unit) <= LONGEST:
            # A text object, its entry in the table and the free part of the table.
            size = sys.getsizeof(unit) + 120
            if self.held + size > REMEMBERED_BYTES:
                self.clear()
                self.held = 0
            self.held += size
            self[unit] = n
        return n

    def merged(self, unit: str) -> int:
        """Initial symbols less merges, for one unit."""
        rank, part = self.rank, list(unit)
        count = sum(map(self.symbols, part))
        end = len(part)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i, 2) for i in range(end - 1) if (r := rank.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, size = heapq.heappop(heap)
            right = after[left]
            # An entry is stale if either symbol has changed since; the joined length tells.
            if not part[left] or right == end or len(part[left]) + len(part[right]) != size:
                continue
            part[left] += part[right]
            part[right] = ""
            count -= 1
            after[left] = nxt = after[right]
            if nxt != end:
                before[nxt] = left
                if (r := rank.get(both := part[left] + part[nxt])) is not None:
                    heapq.heappush(heap, (r, left, len(both)))
            if (prev := before[left]) >= 0 and (r := rank.get(both := part[prev] + part[left])) is not None:
                heapq.heappush(heap, (r, prev, len(both)))
        return count

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.units(self.normalize(text)))) if text else 0


_counters: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    """The worker's own counter for a model; it outlives a task."""
    if model_file not in _counters:
        _counters[model_file] = PieceCounter(model_file)
    return _counters[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of docs."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(it):
        own = counter(model_file)
        for batch in it:
            got = [(0 if t is None else len(t.encode()), own.count(t)) for (t,) in columns_of([batch], "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64()), pa.array([b > limit for _, b in got], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
