"""Near copies of whole documents: SimHash links and MinHash bands, exact Jaccard similarity.

A link is a Jaccard similarity of 0.8 or more between the sets of five-word shingles.  The links of
``simhash`` (2 of 64 bits, by Golay keys) join texts that are all but equal: the documents of one of
its components share a bucket.  Two bits see no similarity of 0.8, so further candidates come from
BANDS bands of ROWS MinHash values over the same shingles.  The chance to meet depends on nothing but
the similarity, whatever the length and the place of the edits: a pair of exactly 0.8 shares a band
with probability 1 - (1 - 0.8 ** 6) ** 24 = 0.9993, one of 0.85 with 0.99999.  All pairs, of either
kind, are tested exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import link_buckets, shared_buckets, similar
from .common import shielded, small_parts, text_of, tidy, unshielded, with_group
from .components import components
from .paragraph_dedup import PART, band_keys, shingle_hashes
from .scratch import forget, keep
from .simhash import fingerprint_links, majority

SHINGLE = 5
SIMILARITY = 0.8
#: More rows than for paragraphs: the sets of whole texts are large, and so is what unlike pairs in a bucket cost.
BANDS, ROWS = 24, 6
#: Up to so many ids (8 MB) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def text_id(text: str) -> int:
    return int(np.array(xxhash.xxh64_intdigest(text, 42), np.uint64).view(np.int64))


def sketches(docs: DataFrame, doc_id: str, text: str, words: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, id, size, fp, bands): the 64-bit hash of the text, how many shingles it has, their SimHash, and its band keys (none without a word)."""

    def pack(keys: pa.Array, ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        filled = sizes[sizes > 0]
        bands = band_keys(np.concatenate(sets), np.cumsum(filled) - filled, BANDS, ROWS).reshape(-1) if len(filled) else np.empty(0, np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(BANDS * (sizes > 0)))), pa.int32())
        return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.int64()), pa.array(sizes), pa.array([majority(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(bands))], ["doc_id", "id", "size", "fp", "bands"])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            ids, sets, at, held = [], [], 0, 0
            for k, x in enumerate(batch.column(1).to_pylist()):
                own = (x or "").encode().lower().split()
                ids.append(text_id(x or ""))
                sets.append(shingle_hashes(own, words) if own else np.empty(0, np.uint64))
                held += len(sets[-1])
                if held >= PART:
                    yield pack(batch.column(0).slice(at, k + 1 - at), ids, sets)
                    ids, sets, at, held = [], [], k + 1, 0
            if ids:
                yield pack(batch.column(0).slice(at), ids, sets)

    rows = docs.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text")
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, id long, size long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, text: str, size: int = SHINGLE) -> DataFrame:
    """Rows (id, shingles) of the texts whose hash is in ``ids``, each once.

    Texts are told apart before they become sets, so no set is shuffled for that.
    """
    rows = docs.select(text_of(text).alias("text")).withColumn("id", F.xxhash64("text"))
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = rows.join(wanted, "id", "left_semi").dropDuplicates(["id"])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 200):
            sets = [shingle_hashes(w, size).view(np.int64) if (w := x.encode().lower().split()) else np.empty(0, np.int64) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets)))], ["id", "shingles"])

    return rows.select("id", "text").mapInArrow(work, "id long, shingles array<long>")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, id of the text, component_id (the smallest doc_id), component_text (the smallest id of its texts).

    Texts link at a Jaccard similarity of ``similarity`` or more of their sets of ``words``-word
    shingles, A-Z lower-cased; equal texts are one.  Texts without a word (null, empty, blank) have
    an empty set and link to none but themselves.  A null doc_id is after all others, rows repeated
    or with equal texts are in one component, other columns are ignored whatever their names;
    empty in, empty out.
    """
    rows = keep(sketches(docs, doc_id, text, words), "sketches")
    nodes = keep(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")), "nodes")
    prints = components(fingerprint_links(nodes.filter("size > 0").select("fp").distinct()))
    printed = nodes.filter("size > 0").select("id", "n", "fp").join(prints, F.col("fp") == F.col("node"), "left")
    keys = nodes.select("id", "n", F.explode("bands").alias("key")).unionByName(printed.select("id", "n", F.xxhash64(F.coalesce("root", "fp"), F.lit("fp")).alias("key")))
    members = shared_buckets(keys)
    forget(prints)

    def verify(pairs: DataFrame) -> DataFrame:
        ends = [nodes.select(F.col("id").alias(e), F.col("size").alias(f"{e}_size")) for e in "uv"]
        # A pair of sizes that cannot reach the similarity needs no sets.
        fits = F.least("u_size", "v_size") >= F.greatest("u_size", "v_size") * similarity
        close = keep(pairs.join(ends[0], "u").join(ends[1], "v").filter(fits).select("u", "v"), "close")
        ids = keep(close.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids")
        sets = keep(shingle_sets(docs, ids, text, words), "sets")
        found = keep(similar(close, sets, similarity), "similar")
        forget(close, ids, sets)
        return found

    roots = link_buckets(members, verify, lambda some: shingle_sets(docs, some, text, words), similarity)
    labelled = keep(nodes.join(roots, F.col("id") == F.col("node"), "left").select("id", "n", "least", F.coalesce("root", "id").alias("root")), "labelled")
    forget(members, roots, nodes)
    groups = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.coalesce(F.min_by("id", F.struct("least", "id")), F.min("id")).alias("component_text"), F.count(F.lit(1)).alias("size"))
    named = keep(with_group(labelled, keep(groups, "groups"), ["root"], "size", labelled.count()).select("id", "n", "component_id", "component_text"), "named")
    forget(labelled)
    return with_group(rows.select("doc_id", "id"), named, ["id"], "n", rows.count()).select("doc_id", "id", "component_id", "component_text")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: one of each component, of the smallest doc_id.

    The rules of ``near_copies`` hold.  Rows of one doc_id with different texts are told apart by the
    text; of those of the smallest doc_id one text stays, and of repeated rows one.  A component
    whose rows have no doc_id but null keeps one of them.  Extra columns may have any names.
    """
    found = keep(near_copies(docs, doc_id, text, similarity, words), "found")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("id") == F.col("component_text"))
    gone = keep(found.filter(~stays).select(F.col("doc_id").alias("__id"), F.col("id").alias("__hash")).distinct(), "gone")
    twice = keep(found.filter(stays).groupBy("doc_id", "id").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("id").alias("__hash")), "twice")
    rows, names = shielded(docs)
    same = (F.xxhash64(text_of(names[text])) == F.col("__hash")) & F.col(names[doc_id]).eqNullSafe(F.col("__id"))
    small = [F.broadcast(t) if t.count() <= BROADCAST_IDS else t for t in (gone, twice)]
    rows = rows.join(small[0], same, "left_anti")
    if not twice.isEmpty():
        once = rows.join(small[1], same, "left_semi").withColumn("__hash", F.xxhash64(text_of(names[text]))).dropDuplicates(["__hash", names[doc_id]]).drop("__hash")
        rows = rows.join(small[1], same, "left_anti").unionByName(once)
    return unshielded(rows, names)
