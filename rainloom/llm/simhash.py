"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits.  Two fingerprints that differ in
at most 2 bits have, by the pigeonhole principle, a segment i in which they agree and whose
successor j (in a circle) differs in at most one bit.  The perfect binary Golay code (23, 12) maps
every 23-bit word to the one codeword within distance 3.  All words within one bit of a segment
decode to at most six codewords, and the sets of two words at distance 2 or less have one in
common.  So each fingerprint gets the keys (exact segment i, codeword of segment j), some sixteen
of 33 bits, and every link is inside the bucket of a key.

Only distinct fingerprints have keys.  Buckets are read in the order of keys; a bucket of up to
BUCKET fingerprints is verified in memory, by blocks, and gives a spanning forest of its links, not
all its pairs.  A larger bucket, of any size, is not gathered: its fingerprints pass on to keys of
48 exact bits (all but two of eight bytes, again by pigeonhole), whose buckets have at most 65,536
values of the 16 free bits and are linked by a table of those.  No link is lost at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_parts, with_group
from .components import components, forest
from .scratch import keep

WORDS = 3
SEED = 42
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Largest bucket that is verified in memory.
BUCKET = 2048
#: The generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Decoding by syndrome: the remainder of a word gives its one error of up to three bits."""

    def __init__(self) -> None:
        ones = [_remainder(1 << b) for b in range(23)]
        self.error = np.zeros(2048, np.int64)
        for n in (1, 2, 3):
            for bits in combinations(range(23), n):
                syndrome = 0
                for b in bits:
                    syndrome ^= ones[b]
                self.error[syndrome] = sum(1 << b for b in bits)
        self.tables = []
        for low, size in ((0, 8), (8, 8), (16, 7)):
            table = np.zeros(1 << size, np.int64)
            for value in range(1 << size):
                for b in range(size):
                    if value >> b & 1:
                        table[value] ^= ones[low + b]
            self.tables.append(table)

    def decode(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the nearest codeword of each word."""
        a, b, c = self.tables
        return (words ^ self.error[a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16]]) >> 11

    def near(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Codeword indices of all words within one of the low ``bits`` bits, a row for each word."""
        flips = np.array([0, *(1 << b for b in range(bits))], np.int64)
        found = np.sort(self.decode(words[:, None] ^ flips[None, :]), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


GOLAY = Golay()


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The fingerprint of a text, as a signed 64-bit number.

    A-Z are lower-cased; shingles of ``words`` words count as often as they occur; a bit is 1 if
    it is set in over half of their XXH64.  Fewer words are one shingle; no word gives 0.
    """
    parts = text.encode().lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(b" ".join(parts), SEED)]
    else:
        joined = b" ".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        n = len(parts) - words + 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of unsigned 64-bit values, as a signed number."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 14):
        part = values[at : at + (1 << 14)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (doc_id, fp), one for each row of ``docs``; a null text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x or "", words) for x in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    rows = docs.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text")
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def golay_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the value) of unsigned 64-bit values."""
    keys, owners = [], []
    parts = [(values >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in SEGMENTS]
    for i in range(3):
        j = (i + 1) % 3
        near = GOLAY.near(parts[j], SEGMENTS[j][1])
        row, column = np.nonzero(near >= 0)
        keys.append((i << 34) | (parts[i][row] << 12) | near[row, column])
        owners.append(row)
    return np.concatenate(keys), np.concatenate(owners)


def fine_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the value): the value without two of its eight bytes, which are named."""
    keys, owners, full = [], [], np.uint64((1 << 64) - 1)
    for n, (a, b) in enumerate(combinations(range(8), 2)):
        low = values & np.uint64((1 << 8 * a) - 1)
        middle = (values >> np.uint64(8 * a + 8)) & np.uint64((1 << 8 * (b - a - 1)) - 1)
        high = (values >> np.uint64(8 * b + 8)) & (full >> np.uint64(8 * b + 8)) if b < 7 else np.zeros_like(values)
        keys.append((low | middle << np.uint64(8 * a) | high << np.uint64(8 * b - 8)).astype(np.int64) | (n << 48))
        owners.append(np.arange(len(values)))
    return np.concatenate(keys), np.concatenate(owners)


def keyed(fps: DataFrame, make) -> DataFrame:
    """Rows (key, fp) of the keys of each row of ``fps``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0)).astype(np.int64)
            for at in range(0, len(values), 20_000):
                part = values[at : at + 20_000]
                keys, owners = make(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(part[owners], pa.int64())], ["key", "fp"])

    return fps.select("fp").mapInArrow(work, "key long, fp long")


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Fingerprints of each key in sorted batches, as (values, whole); runs over ``most`` come in parts."""
    held, key, over = [], None, False
    for batch in batches:
        keys, values = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        inner = (ends - starts > 1) | (starts == 0) | (ends == len(keys))  # single rows have no pair
        for a, b in zip(starts[inner].tolist(), ends[inner].tolist(), strict=True):
            if key is not None and keys[a] != key:
                if held:
                    yield np.concatenate(held), not over
                held, over = [], False
            key = keys[a]
            held.append(values[a:b])
            if sum(map(len, held)) > most:
                over = True
                yield np.concatenate(held), False
                held = []
    if held:
        yield np.concatenate(held), not over


def links_within(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Forest (node, root) of the links of a bucket, verified by blocks."""
    left, right = [], []
    unsigned = values.view(np.uint64)
    for at in range(0, len(values), 256):
        a, b = np.nonzero(popcount(unsigned[at : at + 256, None] ^ unsigned[None, :]) <= most)
        a += at
        wanted = a < b
        left.append(values[a[wanted]])
        right.append(values[b[wanted]])
    return forest(np.concatenate(left), np.concatenate(right))


def table_links(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Forest of the links of values that share a fine key: at most 65,536, free in two bytes."""
    values = np.unique(values)
    if len(values) < 2:
        return []
    differ = np.bitwise_or.reduce(values.view(np.uint64) ^ values.view(np.uint64)[0])
    places = [b for b in range(64) if int(differ) >> b & 1]
    left, right = [], []
    for n in range(1, most + 1):
        for flipped in combinations(places, n):
            other = values ^ np.array(sum(1 << b for b in flipped), np.uint64).view(np.int64)
            at = np.searchsorted(values, other)
            at[at == len(values)] = 0
            found = (values[at] == other) & (values < other)
            left.append(values[found])
            right.append(other[found])
    return forest(np.concatenate(left), np.concatenate(right)) if left else []


def fingerprint_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows (u, v): links that connect all distinct fingerprints of ``fps`` differing in 1 or 2 bits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u, v, hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.full(len(u), hot), pa.bool_())], ["u", "v", "hot"])

        found: list[tuple[int, int]] = []
        for values, whole in runs(batches, bucket):
            if not whole:
                yield out(values, values, True)
            elif len(values) == 2:
                if popcount(values.view(np.uint64)[0] ^ values.view(np.uint64)[1]) <= 2:
                    found.append((values[1], values[0]))
            elif len(values) > 2:
                found += links_within(values, 2)
            if len(found) >= 10_000:
                yield out(*zip(*found, strict=True), False)
                found = []
        if found:
            yield out(*zip(*found, strict=True), False)

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, _ in runs(batches, 1 << 16):
            pairs = table_links(values, 2)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["u", "v"])

    keys = keyed(fps, golay_keys)
    first = keep(keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(scan, "u long, v long, hot boolean"), "links")
    hot = first.filter("hot").select(F.col("u").alias("fp")).distinct()
    second = keyed(hot, fine_keys).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(fine, "u long, v long")
    return first.filter("not hot").select("u", "v").unionByName(second).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp and component_id.

    component_id is the smallest doc_id that links reach, the row's own included; fingerprints
    link when at most 2 bits differ.  Texts without a word (null, empty, blank) have fingerprint 0
    and link like any other.  A null doc_id gives no component its id, unless it has no other.
    Repeated rows are in one component.  Other columns are ignored; empty in, empty out.
    """
    rows = keep(fingerprints(docs, doc_id, text, words), "fingerprints")
    nodes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(fingerprint_links(nodes))
    labelled = keep(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "labelled")
    groups = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = with_group(labelled, keep(groups, "groups"), ["root"], "size", labelled.count()).select("fp", "n", "component_id")
    return with_group(rows, keep(named, "named"), ["fp"], "n", rows.count()).select("doc_id", "fp", "component_id")
