import os
import random
from collections import Counter, defaultdict

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.llm import exact_dedup, line_dedup, mixing, quality, queries, ranks, sharding

TEXTS = ["Same text here", "same TEXT here", "other", "", None, " \n\t", "É same", "é same", "other"]


def with_extras(df):
    """Columns that are named like those the operators use inside."""
    for n, c in enumerate(("sha", "uid", "maybe", "n", "size", "key", "id", "fp", "line", "gone", "copies", "shard", "base_failed", "__sha", "__id", "__hash", "__n", "rank", "host", "group_size")):
        df = df.withColumn(c, F.lit(n))
    return df


def same_columns(df, out):
    assert out.columns == df.columns


def test_duplicate_map(spark):
    got = {r.doc_id: r for r in exact_dedup.duplicate_map(with_extras(H.docs_of(spark, TEXTS))).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[H.lower(t)].append(i)
    for ids in groups.values():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
    assert got[6].text_sha256 != got[7].text_sha256


def test_duplicate_map_ties_nulls_and_empty(spark):
    rows = [(1, "a", "en", "s", 1)] * 3 + [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (None, "b", "en", "s", 1)]
    out = exact_dedup.duplicate_map(H.documents(spark, rows)).collect()
    assert len(out) == 6 and sum(r.kept for r in out) == 2
    assert [r.doc_id for r in out if r.kept and r.keep_id == 1] == [1]
    assert exact_dedup.duplicate_map(H.documents(spark, [])).count() == 0


def test_drop_exact_duplicates(spark):
    df = with_extras(H.docs_of(spark, TEXTS))
    out = exact_dedup.drop_exact_duplicates(df)
    same_columns(df, out)
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 5, 6, 7, 8]
    twice = H.documents(spark, [(1, "a", "en", "s", 1)] * 3 + [(2, "b", "en", "s", 1)])
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(twice).collect()) == [1, 2]
    assert exact_dedup.drop_exact_duplicates(H.documents(spark, [])).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    docs = H.docs_of(spark, [f"t{i % 700}" for i in range(1000)])
    digests = docs.select(exact_dedup.text_digest().alias("sha"))
    flagged = exact_dedup.probe(digests, exact_dedup.repeat_filter(digests, 1 << 16), 1 << 16).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("maybe").alias("maybe"))
    assert flagged.filter("n > 1 and not maybe").count() == 0
    assert flagged.filter("n = 1 and maybe").count() < 50


def test_quality_measures(spark):
    rng = random.Random(0)
    texts = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "é b c d", "l\nl\n\nl2\n \nl"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["a b", "", "c # <d>", " "]) for _ in range(rng.randrange(8))) for _ in range(40)]
    texts += [" ".join(str(rng.random()) for _ in range(n)) for n in (49, 50, 5000)] + ["ab " * 20000]
    for r in quality.quality_rules(with_extras(H.docs_of(spark, texts))).collect():
        want = H.measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", "en", f"h{i % 3}", 1) for i in range(300)]
    rows += [(1000 + i, "short" if i < 99 else good, "en", "bad", 1) for i in range(100)]
    rows += [(2000, good, "en", None, 1)]
    df = H.documents(spark, rows)
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert got[1099].host_rejected and not got[1099].kept
    assert all(got[i].kept == bool(i % 10) for i in range(300)) and got[2000].kept
    out = quality.keep_good(with_extras(df))
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert quality.quality_rules(H.documents(spark, [])).count() == 0 and quality.keep_good(H.documents(spark, [])).count() == 0


def test_targets_are_water_filling(spark):
    rng = np.random.default_rng(0)
    for _ in range(4):
        sizes = rng.integers(0, 1000, 9)
        names = [f"s{k}" for k in range(8)] + [None]
        df = spark.createDataFrame([(s, int(n)) for s, n in zip(names, sizes, strict=True)], "source string, size long")
        weights, budget, cap = [(5, 2, 1)[k % 3] for k in range(9)], 1.5 * sizes.sum(), 2.0 * sizes
        target, open_ = np.zeros(9), set(range(9))
        while open_ and budget > 1e-9:
            share = {k: budget * weights[k] / sum(weights[j] for j in open_) for k in open_}
            full = [k for k in open_ if target[k] + share[k] >= cap[k] - 1e-9]
            if not full:
                for k in open_:
                    target[k] = share[k]
                break
            for k in full:
                target[k] = cap[k]
                budget -= cap[k]
                open_.remove(k)
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert [got[n] for n in names] == pytest.approx(target.tolist())


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 400))), "en", [None, "a", "b", "hot"][min(3, int(rng.integers(0, 6)))], 1) for i in range(900)]
    rows += [(5000, None, "en", "a", 0), (None, "x y", "en", "a", 0), (7, "x y", "en", "a", 0), (7, "x y", "en", "a", 0)]
    sized = mixing.sized(with_extras(H.documents(spark, rows)))
    out = mixing.systematic_mix(sized, len(rows))
    taken = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.max("target").alias("target"), F.max("size").alias("most"), F.max("copies").alias("c")).collect()
    assert out.count() == len(rows)
    for r in taken:
        assert abs(r.t - r.target) <= 2 * r.most and r.c <= 2
    assert sum(r.t for r in taken) == pytest.approx(1.5 * sized.agg(F.sum("size")).first()[0], rel=0.05)
    again = mixing.systematic_mix(sized.repartition(5), len(rows))
    key = lambda d: sorted(map(str, d.select("doc_id", "size", "copies").collect()))
    assert key(out) == key(again)
    docs = with_extras(H.documents(spark, rows))
    mixed = mixing.mix_documents(docs)
    same_columns(docs, mixed)
    assert mixed.count() == out.agg(F.sum("copies")).first()[0]
    assert mixing.mix_documents(H.documents(spark, [])).count() == 0
    assert mixing.mix_documents(H.docs_of(spark, [None, "", " "])).count() == 0


def test_size_class_keeps_order(spark):
    df = spark.range(0, 70000, 7).select("id", ranks.size_class(F.col("id")).alias("c")).orderBy("id")
    values = [r.c for r in df.collect()]
    assert values == sorted(values)


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [f"line number {k}" for k in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool[: 3 + i % 12]) for _ in range(rng.randrange(6))), "en", rng.choice([None, *"abcdefghijkl"]), 1) for i in range(150)]
    rows += [(900, None, "en", "a", 0), (901, "", "en", "a", 0), rows[3], (rows[4][0], "line number 0\nown", "en", "zz", 1)]
    sites = defaultdict(set)
    for _, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            sites[x].add(s)
    want = Counter()
    for i, t, _, _, _ in rows:
        lines = (t or "").split("\n")
        gone = [bool(H.words(x)) and len(sites[x]) >= line_dedup.MIN_SITES for x in lines]
        want[(i, sum(bool(H.words(x)) for x in lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))] += 1
    out = line_dedup.remove_wide_lines(with_extras(H.documents(spark, rows)))
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in out.collect()) == want
    assert sum(k[2] > 0 for k in want) > 5
    assert line_dedup.remove_wide_lines(H.documents(spark, [])).count() == 0


def test_line_dedup_with_many_sites(spark):
    rows = [(i, f"wide\nnarrow {i % 40}", "en", f"s{i}", 1) for i in range(2000)]
    out = line_dedup.remove_wide_lines(H.documents(spark, rows), min_sites=45)
    assert {(r.n_lines, r.n_removed) for r in out.collect()} == {(2, 2)}  # each narrow line is on 50 sites
    out = line_dedup.remove_wide_lines(H.documents(spark, rows), min_sites=51)
    assert {(r.n_lines, r.n_removed) for r in out.collect()} == {(2, 1)}


def test_transfers_move_the_fewest_bytes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        old = {int(k): int(v) for k, v in enumerate(rng.integers(0, 50, rng.integers(1, 6)))}
        cap = {int(k): int(v) for k, v in enumerate(rng.integers(0, 60, rng.integers(1, 7)))}
        total = sum(old.values())
        if total > sum(cap.values()):
            with pytest.raises(ValueError):
                sharding.transfers(old, cap)
            continue
        plan = sharding.transfers(old, cap)
        out, into = Counter(), Counter()
        for a, b, n in plan:
            assert n > 0
            out[a] += n
            into[b] += n
        assert all(out[s] == n for s, n in old.items()) and all(n <= cap[s] for s, n in into.items())
        best = total - sum(min(n, cap.get(s, 0)) for s, n in old.items())
        assert sum(n for a, b, n in plan if a != b) == best


def test_reshard(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i if i % 50 else None, int(rng.pareto(1.5) * 100) + 1, None if i % 97 == 0 else int(rng.integers(0, 5))) for i in range(3000)]
    df = with_extras(spark.createDataFrame(rows, "doc_id long, bytes long, old_shard int"))
    out = sharding.reshard(df, 8, size="bytes").persist()
    assert out.count() == 3000
    sums = out.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect()
    total = sum(r.b for r in sums)
    assert len(sums) == 8 and all(abs(r.b - total / 8) < 0.01 * total / 8 + 2000 for r in sums)
    assert all(r.lo == 0 and r.hi == r.n - 1 and r.d == r.n for r in sums)
    moved = out.filter("old_shard is null or old_shard <> shard").agg(F.sum("bytes")).first()[0]
    old = {r[0]: r[1] for r in df.groupBy(F.coalesce("old_shard", F.lit(-1))).agg(F.sum("bytes")).collect()}
    best = total - sum(min(n, total // 8) for s, n in old.items() if s >= 0)
    assert moved <= best * 1.02 + 2000
    written = {r.shard for r in sharding.write_affected(out, str(tmp_path / "out")).collect()}
    assert {int(p.split("=")[1]) for p in os.listdir(tmp_path / "out") if "=" in p} == written
    assert sharding.reshard(df.limit(0), 8, size="bytes").count() == 0


@pytest.mark.skipif(not os.path.isdir(H.DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{H.DATA}/documents.parquet'")
    out, want = queries.QUERIES[name](spark, H.DATA), con.sql(queries.SQL[name])
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    assert Counter(tuple(r[c] for c in columns) for r in out.collect()) == Counter(tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(H.DATA), reason="no tables")
def test_op9_contract(spark):
    out = queries.op9_resharding(spark, H.DATA).toPandas()
    docs = {r.doc_id: r.text for r in queries.documents(spark, H.DATA).collect()}
    import zlib

    assert set(out.doc_id) == set(docs) and (out.law == "bytes").all() and out.grown_shard.isna().all()
    for r in out.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_a_filter_in_parts_gives_the_same(spark):
    texts = [f"t{i % 700}" for i in range(1000)] + [None, ""]
    assert exact_dedup.filter_size(len(texts), 1 << 12) == (1 << 12, 4) and exact_dedup.filter_size(10)[1] == 1
    one, parts = (sorted(map(tuple, exact_dedup.duplicate_map(H.docs_of(spark, texts), max_bits=b).collect()), key=repr) for b in (exact_dedup.MAX_BITS, 1 << 12))
    assert one == parts and len(one) == len(texts)
    digests = exact_dedup.keep(H.docs_of(spark, texts).select(exact_dedup.text_digest().alias("sha")), "test")
    flags = exact_dedup.flagged(digests, "sha", len(texts), 1 << 12)
    assert flags.count() == len(texts) and flags.filter("not maybe").count() > 200


def test_divided_loses_no_id(spark):
    rows = spark.range(5000).withColumn("name", F.lit("x"))
    ids = exact_dedup.keep(spark.range(0, 5000, 7), "test")
    some, rest = exact_dedup.divided(rows, ids, "id")
    assert some.count() + rest.count() == 5000 and rest.filter("id % 7 = 0").count() == 0 and rest.count() > 3500


def test_op9_law_and_moves(spark):
    if not os.path.isdir(H.DATA):
        pytest.skip("no tables")
    out = queries.op9_resharding(spark, H.DATA).collect()
    size, count, old = Counter(), Counter(), Counter()
    for r in out:
        size[r.shard] += r.size
        count[r.shard] += 1
        old[r.old_shard] += r.size
    assert sorted(size) == list(range(queries.NEW_SHARDS)) and {r.law for r in out} == {"bytes"}
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in out)
    for s, n in count.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    even = sum(size.values()) / queries.NEW_SHARDS
    least = sum(max(0, b - even) for b in old.values())
    moved = sum(r.size for r in out if r.shard != r.old_shard)
    assert abs(moved - least) <= 2 * queries.NEW_SHARDS * max(r.size for r in out)
