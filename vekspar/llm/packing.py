"""Cost-balanced packing of tokenised documents into sequences of a fixed capacity.

The cost of a piece of n tokens is linear * n + quadratic * n * n. Each task packs its
documents in groups of bounded size, in one pass and without a shuffle: whole sequences are
cut off documents longer than a sequence; the rest, by descending cost, goes to the sequence
of lowest cost that has room for it; what fits nowhere is cut at the room that there is. A
group fills its sequences, and what is left opens the next group. At the end of a task the
remaining tokens become sequences of powers of two, which need no padding.

Sequence ids hold the task's partition in their upper bits. They depend on how the input is
split into partitions; a task that runs again makes the same ones.

Ids are those of the library's encode() with add_special_tokens=False and nothing else set: a
text that spells a special token, such as <|endoftext|>, gets that token's id.

Defined results: a null text is empty and has the end id alone; repeated rows are documents
of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import mapped, pick, slices
from .tokens import WordEncoder, encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def assign(lengths: list[int], capacities: list[int], linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Pieces (item, start, length, sequence) that fill the capacities, as far as the items go."""
    heap = [(0.0, s) for s in range(len(capacities))]
    room = list(capacities)
    waiting = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    out = []
    while waiting and heap:
        negative, i, start = heapq.heappop(waiting)
        n, passed = -negative, []
        while heap and room[heap[0][1]] < n:
            passed.append(heapq.heappop(heap))
        if heap:
            cost, s = heapq.heappop(heap)
        else:  # no sequence has room for it: it is cut for the one of lowest cost
            cost, s = passed.pop(0)
        take = min(n, room[s])
        out.append((i, start, take, s))
        room[s] -= take
        for entry in passed:
            heapq.heappush(heap, entry)
        if room[s]:
            heapq.heappush(heap, (cost + linear * take + quadratic * take * take, s))
        if take < n:
            heapq.heappush(waiting, (take - n, i, start + take))
    return out


def powers(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class Packer:
    """Packs documents (id, ids) as they come; add() and finish() give pieces."""

    def __init__(self, first: int, capacity: int, group_tokens: int, linear: float, quadratic: float) -> None:
        self.sequence, self.capacity, self.group = first, capacity, group_tokens
        self.linear, self.quadratic = linear, quadratic
        self.items: list[tuple[object, np.ndarray, int, int]] = []  # id, the ids that are left, where they start, the document's tokens
        self.tokens = 0

    def _piece(self, item: tuple, start: int, length: int, sequence: int, offset: int) -> tuple:
        doc, ids, at, total = item
        return doc, at + start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), total, sequence, offset

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        full = len(ids) - len(ids) % self.capacity
        item = (doc, ids, 0, len(ids))
        for start in range(0, full, self.capacity):
            yield self._piece(item, start, self.capacity, self.sequence, 0)
            self.sequence += 1
        if full < len(ids):
            self.items.append((doc, ids[full:], full, len(ids)))
            self.tokens += len(ids) - full
            if self.tokens >= self.group:
                yield from self._pack([self.capacity] * (self.tokens // self.capacity))

    def _pack(self, capacities: list[int]) -> Iterator[tuple]:
        used, offset = [0] * len(self.items), [0] * len(capacities)
        for i, start, length, s in assign([len(x[1]) for x in self.items], capacities, self.linear, self.quadratic):
            yield self._piece(self.items[i], start, length, self.sequence + s, offset[s])
            offset[s] += length
            used[i] = start + length
        self.sequence += len(capacities)
        self.items = [(doc, ids[n:], at + n, total) for (doc, ids, at, total), n in zip(self.items, used, strict=True) if n < len(ids)]
        self.tokens = sum(len(x[1]) for x in self.items)

    def finish(self) -> Iterator[tuple]:
        if self.tokens >= self.capacity:
            yield from self._pack([self.capacity] * (self.tokens // self.capacity))
        if self.tokens:
            yield from self._pack(powers(self.tokens))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 2,
    vocabulary: str = VOCABULARY,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    group_tokens: int = 1 << 20,
) -> DataFrame:
    """Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row for each piece."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    d = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(WordEncoder, vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, group_tokens, linear, quadratic)
        end, kind = np.array([end_id], "<u2"), None  # ids below 65,536 take 16 bits each

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            return pa.record_batch([pa.array(c, kind if k == 0 else pa.int64()) for k, c in enumerate(columns)], names)

        for batch in (part for whole in batches for part in slices(whole, size=2_000_000)):
            kind = batch.schema.field("doc_id").type
            pieces = [p for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True) for p in packer.add(doc, np.concatenate((ids, end)))]
            packer.items = [(doc, ids.copy(), *rest) for doc, ids, *rest in packer.items]  # so that the batch can go
            if pieces:
                yield rows(pieces)
        if pieces := list(packer.finish()):
            yield rows(pieces)

    return mapped(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
