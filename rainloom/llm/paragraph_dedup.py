"""Repeated paragraphs by MinHash banding, exact Jaccard and components.

A paragraph is a line with at least MIN_WORDS words; A-Z are lower-cased and white space is one
space.  Equal paragraphs have one id (a 64-bit hash).  Each distinct paragraph has a MinHash
signature over the set of its five-word shingles, cut into BANDS bands of ROWS values: a pair of
similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 3) ** 10 = 0.9992, one of 0.9 with
probability 1 - 3e-6.  Sets of up to 3 shingles are similar only if equal, so they have one band.
Buckets of a band are not paired up (see ``buckets``); each link of the exact
Jaccard similarity that banding can see is kept.  Of each component the first
occurrence, by document and place, stays, and all others are removals.

Passages can also stand inside other paragraphs.  They are banded by windows: the MinHash of a
window of 32 shingles is its least one, and the band is that shingle with the two that follow, which
are the 15 words of a block.  So any passage of 50 words that two texts share has a block of its own
in both, wherever it stands and however its lines are cut.  Most blocks occur once: the two-pass
Bloom filter of ``exact_dedup`` keeps them from being shuffled.  A block that meets the first of its
bucket is verified word by word against it, and extended on both sides as far as its text equals
that around the first; the whole run is the removal.  A block that meets its bucket by chance, with
other words, is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import link_buckets, shared_buckets, similar
from .common import small_parts, text_of, tidy, with_group
from .exact_dedup import divided, filter_size, flagged, member_filter, probe
from .scratch import forget, keep
from .words import PADDING, word_edges, word_hashes

SHINGLE = 5
#: A line of fewer words has no shingle.
MIN_WORDS = SHINGLE
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
#: Sets of up to so many shingles have the similarity with none but equal ones.
ALONE = 3
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
#: Blocks of so many words, at the least of so many shingles in a row: passages of 50 words and more.
BLOCK, WINDOW = 15, 32
#: A block is extended by up to so many words a side: in a shared passage the next block, or the passage's end, is nearer.
AROUND = WINDOW
SEED = 42
_RNG = np.random.default_rng(SEED)
#: ``near_copies`` has more hash functions.
FUNCTIONS = 144
MULTIPLIERS = _RNG.integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RNG.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)
#: Up to so many ids (8 MB) are broadcast.
BROADCAST_IDS = 1_000_000
#: Lines that are worked on together have at most so many shingles, unless one line has more.
PART = 50_000
#: Texts that are worked on together have at most so many bytes, unless one text has more.
TEXTS = 1 << 18


def ordered_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of a paragraph in their order, repeats included; of fewer words, that of them all.

    Each word is hashed once, and a shingle's hash is folded from those of its words in turn.
    """
    return folded(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), min(size, len(words)))


def folded(each: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles of ``size`` words, from those of the words."""
    n = len(each) - size + 1
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(size):
        out ^= each[k : k + n]
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(32)
    return out


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of a paragraph, sorted."""
    return np.unique(ordered_hashes(words, size))


def blocks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, id) of the blocks of BLOCK words that begin at anchors, from ordered hashes.

    Anchors are the least of every WINDOW shingles in a row (winnowing, the first if equal), so a
    passage of WINDOW + BLOCK + 3 words that two texts share has a block of its own in both.
    """
    last = len(hashes) - (BLOCK - SHINGLE)
    if last <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(hashes) <= WINDOW:
        anchors = np.array([int(np.argmin(hashes))])
    else:
        windows = np.lib.stride_tricks.as_strided(hashes, (len(hashes) - WINDOW + 1, WINDOW), hashes.strides * 2, writeable=False)
        # From window to window the place of the first least one never goes back.
        places = np.arange(len(windows)) + windows.argmin(axis=1)
        anchors = places[np.diff(places, prepend=-1) > 0]
    anchors = anchors[anchors < last]
    return anchors, block_names(hashes, anchors)


def block_names(hashes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    name = np.full(len(anchors), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(0, BLOCK, SHINGLE):
        name = (name ^ hashes[anchors + k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        name ^= name >> np.uint64(31)
    return name.view(np.int64)


def runs_marked(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in a run of ``sizes``, 1 or more, from ``starts``; runs do not overlap."""
    edges = np.zeros(n + 1, np.int8)
    edges[starts] += 1
    edges[starts + sizes] -= 1
    return np.cumsum(edges[:-1], dtype=np.int8).view(bool)


def anchors_of_texts(hashes: np.ndarray, first: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Places of the anchors of ``blocks`` in the texts whose words begin at ``first`` in ``hashes``, in order.

    ``hashes`` goes on from text to text; texts have BLOCK words or more.  An anchor is the least
    of a window that has it: its hash is the greatest of the minima of those windows.  That does not
    tell apart equal hashes in one window; the few texts with any go through ``blocks`` alone.
    """
    n = n_words - SHINGLE + 1
    long = n > WINDOW
    places = [np.array([a + int(np.argmin(hashes[a : a + k])) for a, k in zip(first[~long].tolist(), n[~long].tolist(), strict=True)], np.int64)]
    if long.any():
        least = hashes
        for k in (1, 2, 4, 8, 16):
            least = np.minimum(least[:-k], least[k:])
        whole = runs_marked(first[long], n[long] - WINDOW + 1, len(least))
        most = np.zeros(len(least) + 2 * (WINDOW - 1), np.uint64)
        np.multiply(least, whole, out=most[WINDOW - 1 : len(least) + WINDOW - 1])
        for k in (1, 2, 4, 8, 16):
            most = np.maximum(most[:-k], most[k:])
        found = np.flatnonzero((most == hashes) & (most != 0))
        twice = found[1:][(np.diff(found) < WINDOW) & (hashes[found[1:]] == hashes[found[:-1]])]
        if len(twice):
            texts = np.unique(np.searchsorted(first, twice, "right") - 1)
            found = found[~np.isin(np.searchsorted(first, found, "right") - 1, texts)]
            places += [first[x] + blocks(hashes[first[x] : first[x] + n[x]])[0] for x in texts.tolist()]
        places.append(found)
    found = np.sort(np.concatenate(places))
    text = np.searchsorted(first, found, "right") - 1
    return found[found - first[text] < n_words[text] - BLOCK + 1]


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A row of ``bands`` keys for each run of ``hashes`` that begins at ``starts``."""
    keys = np.empty((len(starts), bands), np.int64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat((hashes * MULTIPLIERS[k] + ADDENDS[k]) >> np.uint64(24), starts)
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key.view(np.int64)
    return keys


def signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a text, in code points."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = word_edges(data)
    if len(data) != len(text):
        points = code_points(data)
        starts, ends = points[starts], points[ends]
    return starts, ends


def code_points(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte, and before the end."""
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return points


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, text_hash, start, end, id, bands) of paragraphs, and one row (doc_id, text_hash,
    start -1, block_starts, block_ends, block_ids) of each text with blocks.

    Places are code points, end exclusive.
    """

    def pack(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        low = b"\n".join([*texts, b"\n" * PADDING]).lower()
        data = np.frombuffer(low, np.uint8)
        begins = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
        starts, ends = word_edges(data)
        first = np.searchsorted(starts, begins)
        n_words = np.diff(first, append=len(starts))
        points = np.arange(len(data) + 1) if low.isascii() else code_points(data)
        place = lambda at, text: points[at] - points[begins[text]]
        each = word_hashes(data, starts, ends)
        hashes = folded(each, SHINGLE) if len(each) >= SHINGLE else np.empty(0, np.uint64)
        # Lines with so many words.
        breaks = np.flatnonzero(data == 0x0A)
        to = np.searchsorted(starts, breaks)
        n = np.diff(to, prepend=0)
        lines = np.flatnonzero(n >= max(1, min_words))
        n, head = n[lines], to[lines] - n[lines]
        a, b = starts[head], ends[head + n - 1]
        # A line of words with one space between them is as its id wants it.
        other = np.flatnonzero((data - np.uint8(0x09) <= 0x0D - 0x09) & (data != 0x0A))
        upto = np.concatenate(([0], np.cumsum(ends - starts)))
        plain = (b - a - (upto[head + n] - upto[head]) == n - 1) & (np.searchsorted(other, a) == np.searchsorted(other, b))
        own = [low[x:y] if p else b" ".join(low[x:y].split()) for x, y, p in zip(a.tolist(), b.tolist(), plain.tolist(), strict=True)]
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)).view(np.int64)
        # Shingles of a line are those of the text; repeats change no minimum.
        sizes = np.maximum(n - SHINGLE + 1, 1)
        if min_words >= SHINGLE:
            shingles = hashes[runs_marked(head, sizes, len(hashes))]
        else:
            shingles = np.concatenate([hashes[:0], *(hashes[h : h + k - SHINGLE + 1] if k >= SHINGLE else ordered_hashes(x.split()) for h, k, x in zip(head.tolist(), n.tolist(), own, strict=True))])
        keys = band_keys(shingles, np.cumsum(sizes) - sizes) if len(lines) else np.empty((0, BANDS), np.int64)
        wanted = np.ones(keys.shape, bool)
        wanted[sizes <= ALONE, 1:] = False
        # Blocks.
        texts_of = np.searchsorted(begins, a, "right") - 1
        with_blocks = np.flatnonzero(n_words >= BLOCK)
        found = anchors_of_texts(hashes, first[with_blocks], n_words[with_blocks]) if len(with_blocks) else np.empty(0, np.int64)
        text = np.searchsorted(begins, starts[found], "right") - 1
        n_found = np.bincount(text, minlength=len(texts))[with_blocks]
        digests = np.zeros(len(texts), np.int64)
        for k in np.union1d(texts_of, with_blocks).tolist():
            digests[k] = signed(xxhash.xxh64_intdigest(texts[k], 42))
        rows, none = np.concatenate([texts_of, with_blocks]), np.full(len(with_blocks), -1)
        lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)
        empty, no_blocks = np.zeros(len(with_blocks), np.int64), np.zeros(len(lines), np.int64)
        of_blocks = [lists(np.concatenate([no_blocks, n_found]), pa.array(x, t)) for x, t in ((place(starts[found], text), pa.int32()), (place(ends[found + BLOCK - 1], text), pa.int32()), (block_names(hashes, found), pa.int64()))]
        plain_columns = [np.concatenate(x) for x in ((place(a, texts_of), none), (place(b, texts_of), none), (names, empty))]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows)), pa.array(digests[rows]), *map(pa.array, plain_columns), lists(np.concatenate([wanted.sum(axis=1), empty]), pa.array(keys[wanted])), *of_blocks],
            ["doc_id", "text_hash", "start", "end", "id", "bands", "block_starts", "block_ends", "block_ids"],
        )

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            begin = size = 0
            for k, x in enumerate(texts):
                if size and size + len(x) > TEXTS:
                    yield pack(batch.column(0).slice(begin, k - begin), texts[begin:k])
                    begin, size = k, 0
                size += len(x)
            if texts:
                yield pack(batch.column(0).slice(begin), texts[begin:])

    rows = docs.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, text_hash long, start long, end long, id long, bands array<long>, block_starts array<int>, block_ends array<int>, block_ids array<long>")


def spaced_lines(text: bytes, min_words: int) -> list[bytes]:
    """The lines of so many words, lower-cased, with one space between words."""
    low = text.lower()
    if b"  " in low or len(low) != len(low.translate(None, b"\t\x0b\x0c\r")):
        return [b" ".join(words) for words in map(bytes.split, low.split(b"\n")) if len(words) >= min_words]
    return [line for x in low.split(b"\n") if (line := x.strip(b" ")) and line.count(b" ") >= min_words - 1]


def shingle_sets(docs: DataFrame, ids: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (id, shingles) of the paragraphs in ``ids``, from a second scan of the texts.

    Up to BROADCAST_IDS ids are broadcast, so that other paragraphs go no further; more are joined
    by shuffle.
    """

    @tidy
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            found = [line for value in batch.column(0).cast(pa.binary()).to_pylist() for line in spaced_lines(value or b"", min_words)]
            for at in range(0, len(found), 5000):
                part = found[at : at + 5000]
                names = np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(part, pa.binary())], ["id", "line"])

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            hashes = [shingle_hashes(x.split(b" ")).view(np.int64) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(h) for h in hashes], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*hashes, np.empty(0, np.int64)])))], ["id", "shingles"])

    rows = docs.selectExpr(f"`{text}` as text").mapInArrow(lines, "id long, line binary")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(sets, "id long, shingles array<long>")


def distinct_lines(rows: DataFrame) -> DataFrame:
    """Rows (id, n, bands): each distinct paragraph once, with the number of its rows.

    Equal paragraphs have equal bands, so any aggregate takes them: as plain numbers they are
    aggregated by hash, while arrays would be sorted, before the shuffle and after it.
    """
    each = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.get("bands", F.lit(k))).alias(f"b{k}") for k in range(BANDS)])
    return each.select("id", "n", F.array_compact(F.array(*[f"b{k}" for k in range(BANDS)])).alias("bands"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, text_hash, start, end, component, occurrences, documents, first_doc, removed, block, run_start, run_end).

    One row for each paragraph, and one (block true) for each block that occurs twice or more.
    A removed block has the place of the run of equal words around it; others run from start to end.
    component is shared by paragraphs that links connect; occurrences counts its paragraphs, and
    documents the documents that have them; first_doc has the first one, by doc_id and place, and removed is true for all others.
    Texts that are null or empty have no paragraphs.  Repeated rows of a document share places:
    they are kept or removed alike.  A null doc_id is after all others.  Columns other than the
    two named are ignored; empty in, empty out.
    """
    key = ["doc_id", "text_hash"]
    table = keep(paragraphs(docs, doc_id, text, min_words), "paragraphs")
    rows = table.filter("start >= 0").select("doc_id", "text_hash", "start", "end", "id", "bands")
    places = rows.select("doc_id", "text_hash", "start", "end", "id")
    distinct = keep(distinct_lines(rows), "distinct")
    members = shared_buckets(distinct.select("id", "n", F.explode("bands").alias("key")))
    ids = keep(members.select("id").distinct(), "ids")
    sets = keep(shingle_sets(docs, ids, text, min_words), "sets")
    forget(ids)
    roots = link_buckets(members, lambda pairs: similar(pairs, sets, similarity), lambda some: sets.join(some, "id", "left_semi"), similarity)
    forget(members, sets)
    # Ids that occur once and are linked to none are left out: a filter of the others lets their places pass straight through.
    named = distinct.join(roots, F.col("id") == F.col("node"), "left").filter("n > 1 or root is not null")
    named = keep(named.select("id", "n", F.coalesce("root", "id").alias("component")), "named")
    forget(distinct, roots)
    total = rows.count()
    bits, _ = filter_size(named.count())
    tested = keep(probe(places, keep(member_filter(named.select("id"), bits, "id"), "ids-bloom"), bits, "id"), "tested")
    of = with_group(tested.filter("maybe").drop("maybe"), named, ["id"], "n", total)
    of = keep(of.withColumn("component", F.coalesce("component", "id")).drop("n", "id"), "of")
    forget(named)
    one = F.lit(1).cast("long")
    alone = tested.filter("not maybe").select(*key, "start", "end", F.col("id").alias("component"), one.alias("occurrences"), one.alias("documents"), F.col("doc_id").alias("first_doc"), F.lit(False).alias("removed"))
    lines = first_stays(of, total).unionByName(alone).withColumns({"block": F.lit(False), "run_start": F.col("start"), "run_end": F.col("end")})
    seeds = repeated_blocks(table)
    forget(table)
    return lines.unionByName(runs(docs, seeds, doc_id, text))


def repeated_blocks(table: DataFrame) -> DataFrame:
    """The rows of ``repeats`` for blocks, from the table of ``paragraphs``, as a kept table."""
    texts = table.filter("start < 0")
    each = texts.select("doc_id", "text_hash", F.explode(F.arrays_zip("block_starts", "block_ends", "block_ids")).alias("b"))
    each = each.select("doc_id", "text_hash", F.col("b.block_starts").cast("long").alias("start"), F.col("b.block_ends").cast("long").alias("end"), F.col("b.block_ids").alias("component"))
    total = texts.agg(F.coalesce(F.sum(F.size("block_ids")), F.lit(0))).first()[0]
    possible = flagged(each, "component", total, only=True)
    out = keep(first_stays(possible, total).filter("occurrences > 1").withColumn("block", F.lit(True)), "seeds")
    forget(possible)
    return out


def surroundings(text: str, starts: list[int], ends: list[int], removed: list[bool]) -> Iterator[tuple[str, str, str]]:
    """The text left of each block, the block, and the text right of it: whole words, no more than AROUND a side.

    Between two blocks to be removed a side ends one word inside the other block: beyond that the
    other one is extended itself.  Blocks that stay have all their surroundings.
    """
    begins, stops = word_spans(text)
    first = np.searchsorted(begins, starts)
    low, high = np.maximum(first - AROUND, 0), np.minimum(first + BLOCK + AROUND, len(begins))
    gone = np.asarray(removed, bool)
    going = np.unique(first[gone])
    before, after = np.searchsorted(going, first, "left"), np.searchsorted(going, first, "right")
    some = gone & (before > 0)
    low[some] = np.minimum(first[some], np.maximum(low[some], going[before[some] - 1] + BLOCK - 1))
    some = gone & (after < len(going))
    high[some] = np.maximum(first[some] + BLOCK, np.minimum(high[some], going[after[some]] + 1))
    for start, end, a, b in zip(starts, ends, begins[low].tolist(), stops[high - 1].tolist(), strict=True):
        yield text[a:start], text[start:end], text[end:b]


def extension(own: str, other: str, back: bool) -> int:
    """How many code points of ``own`` hold the words it shares with ``other``, from its end if ``back``, else from its start.

    ``own`` has whole words, with the white space between them and the block.
    """
    if not own:
        return 0
    rest = len(other) - len(own)
    if back and other.endswith(own) and (not rest or other[rest - 1] in BLANK):
        return len(own.lstrip(BLANK))
    if not back and other.startswith(own) and (not rest or other[len(own)] in BLANK):
        return len(own.rstrip(BLANK))
    places = [m.span() for m in WORDS.finditer(own)]
    ours, theirs = (x.encode().lower().split() for x in (own, other))
    if back:
        places, ours, theirs = places[::-1], ours[::-1], theirs[::-1]
    n = next((k for k, (a, b) in enumerate(zip(ours, theirs, strict=False)) if a != b), min(len(ours), len(theirs)))
    return 0 if not n else len(own) - places[n - 1][0] if back else places[n - 1][1]


def extends_whole() -> Column:
    """Whether a block (left, own, right) equals the first one (f_left, f_own, f_right) letter by letter and both its sides go into the run as they are.

    Most do.  Sides begin and end with a word, so ``extension`` is then their length.
    """
    ends_so, begins_so = (lambda c: F.endswith("f_left", F.concat(F.lit(c), "left"))), (lambda c: F.startswith("f_right", F.concat("right", F.lit(c))))
    back = (F.col("left") == "") | (F.col("left") == F.col("f_left")) | ends_so(" ") | ends_so("\n")
    on = (F.col("right") == "") | (F.col("right") == F.col("f_right")) | begins_so(" ") | begins_so("\n")
    return F.coalesce((F.col("own") == F.col("f_own")) & back & on, F.lit(False))


def runs(docs: DataFrame, blocks: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``repeated_blocks`` with run_start and run_end, from a second scan of the texts that have any.

    Blocks that have not the words of their component's first one are left out.  A run does not
    reach back into the block that stays of the same text.
    """
    names = ["start", "end", "component", "occurrences", "documents", "first_doc", "removed"]
    columns, sides = ["doc_id", "text_hash", *names], ["left", "own", "right", "f_left", "f_own", "f_right"]
    each = blocks.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set(F.struct(*names)).alias("seeds"))
    each = keep(each, "seeds-of")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text"))
    # Texts that certainly have no block are not shuffled.
    rows, _ = divided(rows, each.select("__hash"), "text_hash")
    rows = rows.join(each, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("doc_id", "text_hash", "text", "seeds")
    kind = blocks.schema["doc_id"].dataType.simpleString()
    plain = f"doc_id {kind}, text_hash long, start long, end long, component long, occurrences long, documents long, first_doc {kind}, removed boolean"

    @tidy
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 64):
            sizes = np.asarray(pc.list_value_length(batch.column(3)))
            seeds = dict(zip(names, batch.column(3).flatten().flatten(), strict=True))
            starts, ends, removed = (seeds[c].to_pylist() for c in ("start", "end", "removed"))
            texts, at = [], 0
            for value, n in zip(batch.column(2).to_pylist(), sizes.tolist(), strict=True):
                texts += surroundings(value, starts[at : at + n], ends[at : at + n], removed[at : at + n])
                at += n
            rows_ = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            texts = [pa.array(x, pa.string()) for x in zip(*texts, strict=True)] or [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_), batch.column(1).take(rows_), *seeds.values(), *texts], ["doc_id", "text_hash", *names, "left", "own", "right"])

    @tidy
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 1024):
            plainly = pc.is_valid(batch.column("run_start"))
            yield batch.filter(plainly).select([*columns, "run_start", "run_end"])
            batch = batch.filter(pc.invert(plainly))
            starts, ends, same = [], [], []
            for start, end, stay, left, own, right, before, other, after in zip(*(batch.column(c).to_pylist() for c in ("start", "end", "stay", *sides)), strict=True):
                same.append(own == other or own.encode().lower().split() == (other or "").encode().lower().split())
                start_ = start - extension(left, before or "", True)
                starts.append(start_ if stay is None else max(start_, min(start, stay)))
                ends.append(end + extension(right, after or "", False))
            out = pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [*columns, "run_start", "run_end"])
            yield out.filter(pa.array(same, pa.bool_()))

    around = keep(rows.mapInArrow(look, plain + ", left string, own string, right string"), "around")
    forget(each)
    firsts = around.filter("not removed").dropDuplicates(["component"]).select("component", F.col("occurrences").alias("n"), F.col("text_hash").alias("f_hash"), F.col("end").alias("f_end"), F.col("left").alias("f_left"), F.col("own").alias("f_own"), F.col("right").alias("f_right"))
    total = max(1, blocks.count())
    forget(blocks)
    paired = with_group(around.filter("removed"), keep(firsts, "firsts"), ["component"], "n", total)
    paired = paired.withColumn("stay", F.when(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_hash") == F.col("f_hash")), F.col("f_end")))
    # Only the texts of other blocks go to Python.
    paired = paired.withColumn("plainly", extends_whole())
    reach = F.col("start") - F.char_length("left")
    reach = F.when(F.col("stay").isNull(), reach).otherwise(F.greatest(reach, F.least("start", "stay")))
    texts = [F.when(~F.col("plainly"), F.col(c)).alias(c) for c in sides]
    long = paired.select(*columns, "stay", *texts, F.when(F.col("plainly"), reach).alias("run_start"), F.when(F.col("plainly"), F.col("end") + F.char_length("right")).alias("run_end"))
    long = long.mapInArrow(extend, plain + ", run_start long, run_end long")
    kept = around.filter("not removed").select(*columns, F.col("start").alias("run_start"), F.col("end").alias("run_end"))
    return long.unionByName(kept).withColumn("block", F.lit(True))


def first_stays(of: DataFrame, total: int) -> DataFrame:
    """``of``, rows with component, with occurrences, documents (that have any), first_doc and removed (false for the first of each)."""
    by_doc = of.groupBy("component", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"))
    groups = by_doc.groupBy("component").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"), F.coalesce(F.min_by("start", "doc_id"), F.min("start")).alias("first_start"))
    out = with_group(of, keep(groups, "groups"), ["component"], "occurrences", max(1, total))
    stays = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    return out.withColumn("removed", ~stays).drop("first_start")


def by_document(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as (doc_id, text_hash, text) with n_paragraphs, n_repeated, n_blocks, n_own_blocks and removals.

    n_blocks counts the blocks that another document has too, n_own_blocks those that repeat in this
    one alone.
    removals are the places to remove with the first document of each, in order; those that overlap
    are one.
    """
    line, key = ~F.col("block"), ["doc_id", "text_hash"]
    found = keep(found, "repeats")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text"))
    # Equal rows share places, each of which is there as often as the row is; a line without block is the row itself.
    each_row = rows.select(*key, F.lit(None).cast("boolean").alias("block"), *[F.lit(0).cast("long").alias(c) for c in ("occurrences", "documents")])
    tally = lambda holds, name: F.sum(F.when(holds, 1).otherwise(0)).alias(name)
    counts = found.select(*each_row.columns).unionByName(each_row).groupBy(*key).agg(
        tally(F.col("block").isNull(), "equal"),
        tally(line, "n_paragraphs"),
        tally(line & (F.col("occurrences") > 1), "n_repeated"),
        tally(F.col("block") & (F.col("documents") > 1), "n_blocks"),
        tally(F.col("block") & (F.col("documents") == 1), "n_own_blocks"),
    )
    counts = counts.select(*key, *[F.expr(f"{c} div equal").alias(c) for c in ("n_paragraphs", "n_repeated", "n_blocks", "n_own_blocks")])
    # A removal that begins beyond the furthest end so far begins a span of its own; one that is there twice opens one span.
    in_order = Window.partitionBy(*key).orderBy("run_start", "run_end", "first_doc")
    spans = found.filter("removed").select(*key, "run_start", "run_end", "first_doc")
    reach = F.max("run_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", (reach.isNull() | (F.col("run_start") >= reach)).cast("long")).withColumn("span", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*key, "span").agg(F.min("run_start").alias("start"), F.max("run_end").alias("end"), F.min("first_doc").alias("first_doc"))
    removals = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "first_doc"))).alias("removals"))
    renamed = lambda df, n: df.select(F.col("doc_id").alias(f"__id{n}"), F.col("text_hash").alias(f"__hash{n}"), *[c for c in df.columns if c not in key])
    on = lambda a, b, n: a["doc_id"].eqNullSafe(b[f"__id{n}"]) & (a["text_hash"] == b[f"__hash{n}"])
    removals = renamed(removals, 0)
    each = keep(counts.join(removals, on(counts, removals, 0), "left").drop("__id0", "__hash0"), "each")
    forget(found)
    each = renamed(each, 1)
    out = rows.join(each, on(rows, each, 1), "left").drop("__id1", "__hash1")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_paragraphs", "n_repeated", "n_blocks", "n_own_blocks")}
    return out.withColumns(counts | {"removals": F.coalesce("removals", F.array().cast(each.schema["removals"].dataType))})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, n_repeated, n_blocks, n_own_blocks, removals and the text without them.

    Null and empty texts have no paragraphs and an empty text; equal rows get equal texts; other
    columns are ignored, whatever their names; empty in, empty out.
    """
    out = by_document(docs, repeats(docs, doc_id, text, similarity, min_words), doc_id, text)
    # What stays are the pieces between removals; the removal of a line takes its end with it.
    bounds = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))), F.transform("removals", lambda x: F.struct(x["start"].alias("start"), (x["end"] + F.when(F.substring(F.col("text"), (x["end"] + 1).cast("int"), F.lit(1)) == "\n", 1).otherwise(0)).alias("end"))))
    out = out.withColumn("__b", bounds)
    to = lambda k: F.coalesce(F.get(F.col("__b"), k + 1)["start"], F.char_length("text").cast("long"))
    pieces = F.transform("__b", lambda x, k: F.substring(F.col("text"), (x["end"] + 1).cast("int"), F.greatest(to(k) - x["end"], F.lit(0)).cast("int")))
    return out.select("doc_id", "n_paragraphs", "n_repeated", "n_blocks", "n_own_blocks", "removals", F.array_join(pieces, "").alias("text"))
