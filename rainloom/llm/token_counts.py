"""Token counts by byte-pair merging with a heap and a linked list.

A piece starts as one symbol a byte, in a doubly linked list.  The heap holds the adjacent pairs
that can merge, by rank and then place; the lowest is popped, skipped if one of its symbols has
changed, and merged.  The count of a piece is its bytes less the merges.  No ids are emitted.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_parts
from .vocabulary import Memo, Vocabulary, pieces, vocabulary

LIMIT = 512


class Counter:
    def __init__(self, words: Vocabulary) -> None:
        self.words = words
        self.count_of = Memo(lambda piece: self.count_piece(piece.encode()), longest=64)

    def count_piece(self, piece: bytes) -> int:
        merges, n = self.words.merges, len(piece)
        symbol = [self.words.byte_ids[b] for b in piece]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(made[0], i, made[1], symbol[i], symbol[i + 1]) for i in range(n - 1) if (made := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, becomes, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            merged += 1
            symbol[i], symbol[j] = becomes, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if made := merges.get((becomes, symbol[k])):
                    heapq.heappush(heap, (made[0], i, made[1], becomes, symbol[k]))
            h = before[i]
            if h >= 0 and (made := merges.get((symbol[h], becomes))):
                heapq.heappush(heap, (made[0], h, made[1], symbol[h], becomes))
        return n - merged

    def count(self, text: str) -> int:
        count_of = self.count_of
        return sum(sum(map(count_of.__getitem__, pieces(part))) if special is None else 1 for part, special in self.words.split(text))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit; one pass, no shuffle.

    Special strings of the vocabulary inside a text are one token each.  A null text is empty.
    Repeated rows are counted again; other columns are ignored; empty in, empty out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in small_parts(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = [tokens.count(x) for x in texts]
            sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text")
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
