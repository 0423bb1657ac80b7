import os
import random
import re
from collections import Counter, defaultdict

import helpers as H
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rainloom.llm import buckets, components, near_copies, paragraph_dedup, queries, simhash, words


def hamming_groups(values, most=2):
    groups, a = H.Union(len(values)), np.array(values, np.int64).view(np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= most):
            groups.join(i, i + 1 + int(j))
    return [groups.root(i) for i in range(len(a))]


def planted_fingerprints(seed=0):
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(150):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 8))):
            out.add(x)
            for k in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(k)
    for _ in range(500):
        y = x
        for k in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            y ^= 1 << int(k)
        out.add(y)
    out |= {x ^ (1 << k) for k in range(64)}
    return np.array(sorted(out), np.uint64).view(np.int64).tolist()


def test_golay_decodes_to_the_nearest_codeword():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    index = simhash.GOLAY.decode(words)
    code = {int(simhash.GOLAY.decode(np.array([w]))[0]): None for w in range(4)}
    assert len(code) >= 1
    codeword = {}
    for m in range(4096):
        w = m << 11
        codeword[m] = w ^ simhash._remainder(w)
    distance = np.array([bin(int(w) ^ codeword[int(i)]).count("1") for w, i in zip(words, index, strict=True)])
    assert distance.max() <= 3
    near = simhash.GOLAY.near(words, 23)
    assert (near >= 0).sum(1).max() <= 6


def test_golay_keys_meet_the_pigeonhole():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for flips in range(3):
        b = a.copy()
        for i in range(len(b)):
            for k in rng.choice(64, flips, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(k)
        for make in (simhash.golay_keys, simhash.fine_keys):
            ka, oa = make(a)
            kb, ob = make(b)
            sets = [set(), set()]
            for s, k, o in ((sets[0], ka, oa), (sets[1], kb, ob)):
                s.update(zip(o.tolist(), k.tolist(), strict=True))
            assert {o for o, _ in sets[0] & sets[1]} == set(range(len(a)))


@pytest.mark.parametrize("bucket", [2048, 8])
def test_links_equal_brute_force(spark, bucket):
    values = planted_fingerprints()
    edges = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), bucket)
    got = {r.node: r.root for r in components.components(edges).collect()}
    want = hamming_groups(values)
    pairs = {(got.get(v, v), want[i]) for i, v in enumerate(values)}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (350, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    df = spark.createDataFrame([*pairs, (None, 3)], "u long, v long")
    groups, names = H.Union(2000), set()
    for a, b in pairs:
        groups.join(a, b)
        if a != b:
            names |= {a, b}
    assert {r.node: r.root for r in components.components(df).collect()} == {n: groups.root(n) for n in names}
    assert components.components(df.limit(0)).count() == 0


def test_components_of_a_star_take_one_round_and_more_links_join_them(spark, monkeypatch):
    from rainloom.llm import buckets

    written, real = [], components.keep
    monkeypatch.setattr(components, "keep", lambda df, name, *by: written.append(name) or real(df, name, *by))
    roots = components.components(spark.createDataFrame([(9, k) for k in range(8)], "u long, v long"))
    assert written == ["edges", "large", "small", "roots"]
    assert {tuple(r) for r in roots.collect()} == {(k, 0) for k in (*range(8), 9)}
    joined = buckets._joined(roots, spark.createDataFrame([(20, 21), (9, 30), (-1, 7)], "u long, v long"))
    assert {tuple(r) for r in joined.collect()} == {(k, -1) for k in (-1, *range(8), 9, 30)} | {(20, 20), (21, 20)}


def test_settled_edges_are_stars(spark):
    for edges, stars in (([(1, 2), (1, 3), (4, 5)], True), ([(1, 3), (2, 3)], False), ([(1, 2), (2, 3)], False)):
        assert components._settled(spark.createDataFrame(edges, "u long, v long")) is stars


def test_fingerprint_and_near_duplicates(spark):
    base = [f"w{k}" for k in range(300)]
    texts = [None, "", " ", "one", "One", "one two", " ".join(base), " ".join(base).upper(), " ".join([*base[:-1], "x"]), "é É é"]
    rows = {r.doc_id: r for r in simhash.near_duplicates(H.docs_of(spark, texts)).collect()}

    def plain(text):
        w = [x for x in H.lower(text).replace("\n", " ").split(" ") if x]
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    values = [plain(t) for t in texts]
    assert [rows[i].fp & (1 << 64) - 1 for i in range(len(texts))] == values
    want = hamming_groups(np.array(values, np.uint64).view(np.int64).tolist())
    assert [rows[i].component_id for i in range(len(texts))] == want
    assert rows[0].fp == 0 and rows[2].component_id == 0
    assert simhash.near_duplicates(H.documents(spark, [])).count() == 0
    twice = H.documents(spark, [(3, "a b", "en", "s", 1), (3, "a b", "en", "s", 1), (None, "a b", "en", "s", 1)])
    assert [r.component_id for r in simhash.near_duplicates(twice).collect()] == [3, 3, 3]


def test_shared_buckets_over_batch_borders(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(1, 5)), int(k)) for i, k in enumerate(rng.integers(0, 250, 600))] + [(10_000 + i, 1, 999) for i in range(300)]
    members = Counter(k for _, _, k in rows)
    want = {}
    for i, n, k in rows:
        want.setdefault(k, []).append((-n, i))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "3", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = buckets.shared_buckets(spark.createDataFrame(rows, "id long, n long, key long")).collect()
            assert Counter((r.key, r.id, r.leader) for r in got) == Counter((k, i, min(want[k])[1]) for i, _, k in rows if members[k] > 1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def copies(rng, texts, first):
    out = []
    for t in texts:
        w = t.split(" ")
        rate = rng.choice([0.005, 0.01, 0.02])
        out.append(" ".join(f"new{rng.randrange(99)}" if rng.random() < rate else x for x in w))
        k = max(1, int(len(w) * rng.choice([0.03, 0.06, 0.09])))
        at = rng.randrange(len(w) - k)
        out.append(" ".join([*w[:at], *(f"blk{rng.randrange(9999)}" for _ in range(k)), *w[at + k :]]))
    return [(first + n, t, "en", "s", len(t)) for n, t in enumerate(out)]


def test_near_copies(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.8))}x{rng.randrange(30)}" for _ in range(rng.randrange(80, 400))) for _ in range(150)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + copies(rng, texts, 1000)
    rows += [(5000 + k, " ".join(["hot", *texts[0].split(" ")[: -1 - k % 3], f"v{k}"]), "en", "s", 1) for k in range(60)]
    rows += [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "tiny", "en", "s", 1)]
    df = H.documents(spark, rows)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()}
    want = H.jaccard_groups([H.shingles(r[1] or "") for r in rows])
    ids = [r[0] for r in rows]
    caught = {0.8: [], 0.85: []}
    for i, t, _, _, _ in rows[150:450]:
        base = (i - 1000) // 2
        a, b = H.shingles(t), H.shingles(texts[base])
        j = len(a & b) / len(a | b)
        if j >= 0.8:
            caught[0.85 if j >= 0.85 else 0.8].append(got[i] == got[base])
    assert np.mean(caught[0.85]) >= 0.98 and np.mean(caught[0.8]) >= 0.85
    assert len({got[5000 + k] for k in range(60)}) == 1
    found = {}
    for i, w in zip(ids, want, strict=True):
        found.setdefault(got[i], set()).add(w)
    assert all(len(v) == 1 for k, v in found.items() if k not in (9000, 9001))
    kept = near_copies.drop_near_copies(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(got.values())
    assert near_copies.drop_near_copies(H.documents(spark, [])).count() == 0


def test_paragraphs_equal_brute_force(spark):
    rng = random.Random(7)
    line = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    pool = [line(rng.randrange(20, 70)) for _ in range(40)]

    def edited(text):
        w = text.split(" ")
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        return " ".join(w)

    texts = ["\n".join(rng.choice([lambda: rng.choice(pool), lambda: edited(rng.choice(pool)), lambda: line(30), lambda: line(5)])() for _ in range(rng.randrange(5))) for _ in range(150)]
    texts += ["\n".join(edited(pool[0]) for _ in range(3)) for _ in range(60)] + [None, "", "\n", pool[1].upper()]
    df = H.docs_of(spark, texts)
    places, sets = [], []
    for i, t in enumerate(texts):
        at = 0
        for x in (t or "").split("\n"):
            if len(H.words(x)) >= paragraph_dedup.MIN_WORDS:
                places.append((i, at, at + len(x)))
                sets.append(H.shingles(x))
            at += len(x) + 1
    roots = H.jaccard_groups(sets)
    members = Counter(roots)
    want = {p: (members[r], places[r][0], r != n) for n, (p, r) in enumerate(zip(places, roots, strict=True))}
    got = {(r.doc_id, r.start, r.end): (r.occurrences, r.first_doc, r.removed) for r in paragraph_dedup.repeats(df).filter("not block").collect()}
    assert got.keys() == want.keys()
    assert sum(got[k] != v for k, v in want.items()) <= 0.01 * len(want)
    for r in paragraph_dedup.remove_repeats(df).collect():
        at, kept = 0, []
        text = texts[r.doc_id] or ""
        assert all(a.end <= b.start for a, b in zip(r.removals, r.removals[1:]))
        assert {k[1] for k, v in got.items() if k[0] == r.doc_id and v[2]} <= {p for x in r.removals for p in range(x.start, x.end)}
        for x in r.removals:
            kept.append(text[at : x.start])
            at = x.end + (text[x.end : x.end + 1] == "\n")
        assert r.text == "".join(kept) + text[at:]
    assert paragraph_dedup.repeats(H.documents(spark, [])).count() == 0 and paragraph_dedup.remove_repeats(H.documents(spark, [])).count() == 0


def test_passages_inside_lines(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}{rng.choice(['', chr(10), '.', '.'])}" for _ in range(n))
    passages = [prose(n) for n in (50, 51, 55, 70, 120, 400) for _ in range(5)]
    texts, has = [], {}
    for k, p in enumerate(passages):
        for c in range(3):
            has[len(texts)] = k
            texts.append(f"{prose(rng.randrange(60))} {p.upper() if c == 1 else p} {prose(rng.randrange(60))}")
    texts += [prose(300) for _ in range(60)]
    out = {r.doc_id: r for r in paragraph_dedup.remove_repeats(H.docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert bool(out[i].n_blocks) == (i in has) and bool(out[i].removals) == (i in has and i % 3 > 0)
        if i in has:
            assert {x.first_doc for x in out[i].removals} <= set(range(i - i % 3, i))
            at = t.lower().index(passages[has[i]].lower())
            assert all(x.start < at + len(passages[has[i]]) and at < x.end for x in out[i].removals)


@pytest.mark.skipif(not os.path.isdir(H.DATA), reason="no tables")
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{H.DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, H.DATA).persist()
        assert out.columns == docs.columns
        seen[name] = [r.doc_id for r in out.collect()]
    good = [i for i, r in rows.items() if (m := H.measures(r.text))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    assert sorted(seen["quality rules"]) == sorted(good)
    last = {}
    for i in sorted(good):
        last[H.lower(rows[i].text)] = i
    assert sorted(seen["exact dedup"]) == sorted(last.values())
    ids = sorted(last.values())
    roots = H.jaccard_groups([H.shingles(rows[i].text) for i in ids])
    assert sorted(seen["simhash near-dedup"]) == sorted({ids[r] for r in roots})
    copies_ = Counter(seen["mixing sources"])
    assert set(copies_) <= set(seen["simhash near-dedup"]) and max(copies_.values()) <= 2
    sizes = {i: len(H.words(rows[i].text)) for i in seen["simhash near-dedup"]}
    assert sum(sizes[i] * c for i, c in copies_.items()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.15)
    library = tokenizers.Tokenizer.from_file(H.VOCABULARY)
    coded = stages["bpe encoding"](spark, out, H.DATA).collect()
    assert Counter(r.doc_id for r in coded) == copies_
    assert all(np.frombuffer(r.token_ids, "<u4").tolist() == library.encode(rows[r.doc_id].text, add_special_tokens=False).ids for r in coded[:60])
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, H.DATA).collect()) == copies_


@pytest.mark.skipif(not os.path.isdir(H.DATA), reason="no tables")
def test_op1_and_op6_queries(spark):
    docs = sorted(((r.doc_id, r.text) for r in queries.documents(spark, H.DATA).collect()))
    out = {r.doc_id: r for r in queries.op6_simhash(spark, H.DATA).collect()}
    values = np.array([int(out[i].fingerprint, 16) for i, _ in docs], np.uint64).view(np.int64).tolist()
    assert [out[i].component_id for i, _ in docs] == [docs[r][0] for r in hamming_groups(values)]
    one = queries.op1_paragraph_dedup(spark, H.DATA)
    assert one.count() == len(docs) and one.filter(F.col("n_removed") > F.col("n_repeated")).count() == 0


def test_near_copies_of_long_texts_with_a_replaced_block(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for n in (400, 1000):
        for _ in range(250):
            one = [word() for _ in range(n)]
            at, cut = rng.randrange(n // 2), int(n * 0.105) - 4
            other = one[:at] + [word() for _ in range(cut)] + one[at + cut :]
            a, b = H.shingles(" ".join(one)), H.shingles(" ".join(other))
            assert 0.8 <= len(a & b) / len(a | b) <= 0.85
            texts += [" ".join(one), " ".join(other)]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(H.docs_of(spark, texts)).collect()}
    assert sum(got[i + 1] == i for i in range(0, len(texts), 2)) >= 0.995 * len(texts) / 2


def test_whole_passages_are_removed(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}{rng.choice(['', chr(10), '.'])}" for _ in range(n))
    passages = [prose(n).strip() for n in (50, 55, 60, 200, 1000) for _ in range(4)]
    texts = [f"{prose(40)} {p.upper() if c == 1 else p} {prose(40)}" for p in passages for c in range(3)]
    twice = prose(90).strip()
    texts += [f"{prose(30)} {twice} {prose(30)} {twice} {prose(30)}"]
    out = {r.doc_id: r for r in paragraph_dedup.remove_repeats(H.docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts[:-1]):
        at = t.lower().index(passages[i // 3].lower())
        assert [(x.start, x.end) for x in out[i].removals] == [(at, at + len(passages[i // 3]))] * (i % 3 > 0)
    at = texts[-1].rindex(twice)
    assert [(x.start, x.end) for x in out[len(texts) - 1].removals] == [(at, at + len(twice))]


def test_short_lines_are_paragraphs(spark):
    rng = random.Random(13)
    wrapped = lambda n: "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(n))
    one, line = wrapped(9), "one two three four five"
    texts = [f"{wrapped(2)}\n{one}\n{wrapped(1)}", f"{line}\n{one.upper()}\n{wrapped(1)}", f"{wrapped(1)}\n{line}"]
    out = {r.doc_id: r for r in paragraph_dedup.remove_repeats(H.docs_of(spark, texts)).collect()}
    assert [out[i].n_paragraphs for i in range(3)] == [12, 11, 2] and [out[i].n_repeated for i in range(3)] == [9, 10, 1]
    assert out[0].text == texts[0] and out[1].text == line + "\n" + texts[1].rpartition("\n")[2] and out[2].text == texts[2].removesuffix(line)


def test_close_pairs_loses_no_similar_pair(spark):
    rng = random.Random(21)
    base = [rng.getrandbits(63) for _ in range(150)]
    sets = []
    for _ in range(60):
        own = [x if rng.random() > 0.06 else rng.getrandbits(63) for x in base]
        sets.append(sorted(set(own)))
    table = buckets.keep(spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<long>"), "test")
    left = buckets.prefix_keys(table, 0.8).withColumn("root", F.col("id"))
    found = {tuple(sorted((r.u, r.v))) for r in buckets.similar(buckets.close_pairs(left, table, 0.8), table, 0.8).collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(a := set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])) and a}
    assert found == want and want


def test_near_copies_of_nulls_ties_and_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text + " x", "en", "s", 1), (None, text, "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", "s", 1), (None, "alone in here", None, None, None)]
    df = H.documents(spark, rows)
    for c in ("id", "size", "fp", "bands", "key", "__hash", "__id", "component_id"):
        df = df.withColumn(c, F.lit(7))
    out = near_copies.drop_near_copies(df)
    assert out.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert [k for k in kept if k[1] and k[1] != "alone in here"] in ([(1, text)], [(1, text + " x")])
    assert (None, "alone in here") in kept and len(kept) == 3


def test_blocks_of_one_document_are_counted_apart(spark):
    rng = random.Random(31)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    own, shared = prose(80), prose(80)
    texts = [f"{prose(20)} {own} {prose(20)} {own} {prose(9)}", f"{prose(20)} {shared} {prose(20)}", f"{prose(20)} {shared} {prose(20)}", prose(150)]
    out = {r.doc_id: r for r in paragraph_dedup.remove_repeats(H.docs_of(spark, texts)).collect()}
    assert out[0].n_own_blocks and not out[0].n_blocks and len(out[0].removals) == 1
    assert out[1].n_blocks and not out[1].n_own_blocks and not out[1].removals and len(out[2].removals) == 1
    assert not out[3].n_blocks and not out[3].n_own_blocks


def test_shingle_hashes_and_anchors():
    rng = random.Random(22)
    for n in (0, 1, 4, 5, 6, 31, 36, 37, 300):
        words = [b"w%d" % rng.randrange(4) for _ in range(n)]
        size = min(5, n)
        want = [tuple(words[k : k + size]) for k in range(n - size + 1)]
        hashes = paragraph_dedup.ordered_hashes(words)
        assert len(hashes) == len(want) and len(set(zip(hashes.tolist(), want, strict=True))) == len(set(want)) == len(set(hashes.tolist()))
        assert paragraph_dedup.shingle_hashes(words).tolist() == sorted(set(hashes.tolist()))
        last, window = len(hashes) - 10, 32
        least = [min(range(k, min(k + window, len(hashes))), key=lambda i: (hashes[i], i)) for k in range(max(1, len(hashes) - window + 1))]
        assert paragraph_dedup.blocks(hashes)[0].tolist() == sorted({i for i in least if i < last})


@pytest.mark.skipif(not os.path.isdir(H.DATA), reason="no tables")
def test_op1_counts_and_removals_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in queries.documents(spark, H.DATA).collect())
    lines, sets, blocks = [], [], defaultdict(list)
    for i, t in docs:
        at = 0
        for x in (t or "").split("\n"):
            if len(H.words(x)) >= 5:
                lines.append((i, at + len(x) - len(x.lstrip(" \t")), at + len(x.rstrip(" \t\r"))))
                sets.append(H.shingles(H.lower(x)))
            at += len(x) + 1
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        own = [t[a:b].encode().lower() for a, b in spans]
        if len(own) < paragraph_dedup.BLOCK:
            continue
        for k in paragraph_dedup.blocks(paragraph_dedup.ordered_hashes(own))[0].tolist():
            blocks[tuple(own[k : k + 15])].append((i, spans[k][0], spans[k + 14][1]))
    roots = H.jaccard_groups(sets)
    size = Counter(roots)
    n_lines = Counter(lines[n][0] for n, r in enumerate(roots) if size[r] > 1)
    many = [x for x in blocks.values() if len(x) > 1]
    shared = Counter(p[0] for x in many if len({q[0] for q in x}) > 1 for p in x)
    alone = Counter(p[0] for x in many if len({q[0] for q in x}) == 1 for p in x)
    gone = [lines[n] for n, r in enumerate(roots) if r != n] + [p for x in many for p in sorted(x)[1:]]
    out = {r.doc_id: r for r in queries.op1_paragraph_dedup(spark, H.DATA).collect()}
    for i, _ in docs:
        got = (out[i].n_repeated_lines, out[i].n_blocks, out[i].n_own_blocks, out[i].n_repeated)
        assert got == (n_lines[i], shared[i], alone[i], n_lines[i] + shared[i] + alone[i])
    removed = {i: [tuple(map(int, x.split(":"))) for x in r.removed_spans.split(",") if x] for i, r in out.items()}
    assert gone and all(any(a <= start and end <= b for a, b in removed[i]) for i, start, end in gone)


def test_distinct_lines_are_not_sorted(spark):
    line = " ".join(f"w{k}" for k in range(30))
    docs = H.docs_of(spark, [f"{line}\none two three four five six", line.upper(), None, "", "one two three four five"])
    rows = paragraph_dedup.paragraphs(docs).filter("start >= 0")
    want = {r.id: sorted(r.bands) for r in rows.collect()}
    out = paragraph_dedup.distinct_lines(rows)
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert {r.id: sorted(r.bands) for r in got} == want and sorted(r.n for r in got) == [1, 1, 2]
    assert sorted(map(len, want.values())) == [1, 1, paragraph_dedup.BANDS]


def test_equal_rows_count_places_once(spark):
    rng = random.Random(41)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = prose(80)
    texts = [f"{prose(30)}\n{prose(9)} {shared} {prose(20)}", f"{prose(12)} {shared}\n{prose(7)}", None, prose(40)]
    once = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[1], "en", "s", 1)]
    # What repeats is counted with the repeated rows; places and what goes are as for one row of each.
    columns = ["doc_id", "n_paragraphs", "n_blocks", "removals", "text"]
    one = paragraph_dedup.remove_repeats(H.documents(spark, once)).select(*columns).collect()
    three = paragraph_dedup.remove_repeats(H.documents(spark, once[:3] * 3 + once[3:] + once[4:])).select(*columns).collect()
    assert {str(r) for r in one} == {str(r) for r in three} and len(three) == 12 and any(r.n_blocks for r in one)


def test_word_hashes_are_those_of_the_library():
    rng = random.Random(51)
    own = [bytes(rng.choice(b"abcXYZ09.,\x00\x7f\x80\xc3\xff") for _ in range(n)) for n in range(1, 300) for _ in range(4)]
    data = np.frombuffer(b"\n ".join(own) + bytes([32] * words.PADDING), np.uint8)
    starts, ends = words.word_edges(data)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == own
    assert words.word_hashes(data, starts, ends).tolist() == [xxhash.xxh3_64_intdigest(x) for x in own]


def test_first_scan_hashes_words_together(spark, monkeypatch):
    rng = random.Random(52)
    end = lambda: rng.choice([" "] * 9 + ["  ", "\n", "\t", " \r\n", "\x0b"])
    word = lambda kinds: rng.choice(["w", "É", "ÄB\U0001f600", "x" * 20]) + str(rng.randrange(kinds))
    texts = ["".join(word(kinds) + end() for _ in range(n)) for n in (1, 4, 5, 14, 15, 16, 35, 36, 37, 300) for kinds in (1, 3, 10**6) for _ in range(6)] + [None, "", "\n", " \n a"]
    docs, seen = H.docs_of(spark, texts), []
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, work, schema: work)
        work = paragraph_dedup.paragraphs(docs)
        m.setattr(xxhash, "xxh3_64_intdigest", lambda x, f=xxhash.xxh3_64_intdigest: seen.append(x) or f(x))
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
        rows = [tuple(r.values()) for b in work(iter([batch])) for r in b.to_pylist()]
    want, n_long, signed = [], 0, paragraph_dedup.signed
    for i, t in enumerate(texts):
        digest, at, own = signed(xxhash.xxh64_intdigest(t or "", 42)), 0, (t or "").encode().lower().split()
        n_long += sum(len(w) > 16 for w in own)
        for x in (t or "").split("\n"):
            line = x.encode().lower().split()
            if len(line) >= 5:
                hashes = paragraph_dedup.ordered_hashes(line)
                bands = paragraph_dedup.band_keys(hashes, np.array([0]))[0].tolist()[: 1 if len(hashes) <= paragraph_dedup.ALONE else None]
                start = at + len(x) - len(x.lstrip(paragraph_dedup.BLANK))
                want.append((i, digest, start, at + len(x.rstrip(paragraph_dedup.BLANK)), signed(xxhash.xxh3_64_intdigest(b" ".join(line))), bands, [], [], []))
            at += len(x) + 1
        if len(own) >= paragraph_dedup.BLOCK:
            first, names = paragraph_dedup.blocks(paragraph_dedup.ordered_hashes(own))
            starts, ends = paragraph_dedup.word_spans(t)
            want.append((i, digest, -1, -1, 0, [], starts[first].tolist(), ends[first + paragraph_dedup.BLOCK - 1].tolist(), names.tolist()))
    assert sorted(rows) == sorted(want)
    assert len(seen) == sum(r[2] >= 0 for r in rows) + n_long


def test_blocks_that_extend_whole(spark):
    sides = ["", "b", "a b", "xa b", "x a b", "x\na b", "x\ta b", "A b", "x a  b", "É a b"]
    block = lambda left, right, own="o p": (left and left + " ", own, right and " " + right)
    pairs = [block(a, "") + block(b, "") for a in sides for b in sides] + [block("", a[::-1]) + block("", b[::-1]) for a in sides for b in sides]
    pairs += [block("a", "b") + block("a", "b", "O p"), block("a", "b") + block("z a", "b z"), block("a", "b") + (None, None, None)]
    df = spark.createDataFrame(pairs, "left string, own string, right string, f_left string, f_own string, f_right string")
    whole = {tuple(r)[:6] for r in df.filter(paragraph_dedup.extends_whole()).collect()}
    for p in pairs:
        left, own, right, before, other, after = p
        reaches = own == other and paragraph_dedup.extension(left, before, True) == len(left) and paragraph_dedup.extension(right, after, False) == len(right)
        assert reaches or p not in whole
    assert {block("a b", "") + block("x\na b", ""), block("a b", "") + block("a b", ""), block("a", "b") + block("z a", "b z")} <= whole
