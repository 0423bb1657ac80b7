import hashlib
import os
import random
import re
import sys

import helpers as H
import numpy as np
import pytest

from rainloom.llm import bpe, pii, queries, token_counts
from rainloom.llm.vocabulary import NEWER, Memo, pieces

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(H.VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(H.VOCABULARY)


def noise(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(chr(rng.randrange(128)) for _ in range(rng.randrange(40)))
    if kind == 1:
        return "".join(chr(rng.choice([32, 32, 0x85, 0xA0, rng.randrange(0x250), rng.randrange(0x260)])) for _ in range(rng.randrange(40)))
    if kind == 2:
        return "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(rng.randrange(50)))
    if kind == 3:
        return "".join(rng.choice("ab c\n\t　 ") for _ in range(rng.randrange(40)))
    return "".join(rng.choice(["<|endoftext|>", "'ll", "'s", "1234", " the", "aaaa", "   ", "\n\n", "é", "日本", "x" * rng.randrange(30), "hello"]) for _ in range(rng.randrange(12)))


def test_ids_counts_and_text_equal_the_library(library):
    rng = random.Random(5)
    texts = [noise(rng) for _ in range(3000)] + ["", "a" * 5000, " " * 3000, "ab" * 3000, "<|endoftext|>" * 3]
    coder, counter = bpe.encoder(H.VOCABULARY), token_counts.counter(H.VOCABULARY)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert counter.count(text) == len(want.ids)
        assert coder.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_newer_characters_split_as_in_the_library():
    known = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    found = re.findall(r"(.)-(.)|(.)", NEWER)
    points = [ord(c) for a, b, c in found for c in (a, b, c) if c]
    for p in {q for x in points for q in (x - 1, x, x + 1)}:
        for before in "a1!":
            text = before + chr(p)
            assert len(pieces(text)) == len(known.pre_tokenize_str(text)), hex(p)


def test_memo_is_bounded():
    memo = Memo(len, most=10, longest=5)
    assert [memo[str(k)] for k in range(1000)] == [len(str(k)) for k in range(1000)]
    assert len(memo) <= 10 and len(memo.old) <= 10 and memo["x" * 50] == 50 and "x" * 50 not in memo


def test_what_an_encoder_remembers_is_small(library):
    coder = bpe.Encoder(bpe.vocabulary(H.VOCABULARY))
    rng = random.Random(56)
    for _ in range(39):
        text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(10_000))
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    held = [generation for memo in (coder.ids_of, coder.fits) for generation in (memo, memo.old)]
    # True and False are there once, whatever holds them.
    size = sum(sys.getsizeof(x) + sum(sys.getsizeof(k) + (0 if isinstance(v, bool) else sys.getsizeof(v)) for k, v in x.items()) for x in held)
    assert size < 50e6


def test_documents(spark, library):
    texts = [None, "", "Hello <|endoftext|> world", "été 日本 \U0001f600", "word " * 600, "a\u0000b"]
    df = H.docs_of(spark, texts).unionByName(H.docs_of(spark, texts[:2]))
    out = bpe.encode_documents(df, H.VOCABULARY, outputs=("n_tokens", "token_ids", "decoded", "ids_sha256", "decoded_sha256"))
    rows = out.collect()
    assert len(rows) == 8
    for r in rows:
        text = texts[r.doc_id] or ""
        want = library.encode(text, add_special_tokens=False).ids
        raw = np.array(want, "<u4").tobytes()
        assert (r.n_tokens, bytes(r.token_ids), r.decoded) == (len(want), raw, text)
        assert r.ids_sha256 == hashlib.sha256(raw).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode_documents(out, H.VOCABULARY).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    for r in token_counts.count_tokens(df, H.VOCABULARY).collect():
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
    empty = H.documents(spark, [])
    assert bpe.encode_documents(empty, H.VOCABULARY).count() == 0 and token_counts.count_tokens(empty, H.VOCABULARY).count() == 0


# --- personal data -----------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_pattern(text):
    def luhn(digits):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(0)
    parts = ["@", ".", "a", "b1", "-", "+", "12", "255", "256", "0", "4111111111111111", "4205 2897 2311 3456", "+1 (262) 555-7240", " ", "x@y.com", "é", "_", "%", "1.2.3.4", "(", ")", "\n", "007"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert sorted(pii.scan(text)[0]) == by_pattern(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "a@" * 100_000, "+" + " " * 300_000, "1." * 150_000, "+1" * 100_000):
        pii.scan(text)


def test_personal_data(spark):
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet consetetur".split()) for _ in range(12))
    texts = [None, "", filler()]
    for k in range(80):
        texts.append(f"{filler()} mail user{k}@site{k}.com {filler()}")
        texts.append(f"{filler()} password=ab{k:02d}cd9e8f7a6b {filler()}")
        texts.append(f"{filler()} {4 * 10**15 + rng.randrange(10**15)} {filler()}")
        texts.append(f"{filler()} call +1 (262) 555-{k:04d} {filler()}")
    df = H.docs_of(spark, texts)
    out = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        base = [tuple(s) for s in out[i].base]
        spans = [tuple(s) for s in out[i].spans]
        assert base == by_pattern(t or "") and set(base) <= set(spans) and spans == sorted(spans)
        if "password" in (t or ""):
            at = t.index("password=") + 9
            assert (4, at, at + 14) in spans
    assert not out[0].spans and not out[2].spans
    assert pii.personal_data(H.documents(spark, [])).count() == 0


def test_reliabilities_recover_planted_votes():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.4
    p, q = np.array([0.95, 0.8, 0.6, 0.9, 0.7]), np.array([0.1, 0.2, 0.1, 0.5, 0.4])
    bits = rng.random((20000, 5)) < np.where(truth[:, None], p, q)
    codes = np.array([pii.code_of(0, int(b @ (1 << np.arange(5))), False) for b in bits])
    values, counts = np.unique(codes, return_counts=True)
    posterior, yes, no = pii.reliabilities(values, counts.astype(float))
    assert np.abs(yes - p).max() < 0.05 and np.abs(no - q).max() < 0.05
    guess = dict(zip(values, posterior > 0.5, strict=True))
    assert np.mean([guess[c] == t for c, t in zip(codes, truth, strict=True)]) > 0.9


@pytest.mark.skipif(not os.path.isdir(H.DATA), reason="no tables")
def test_queries(spark, library):
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, H.DATA).collect()}
    for r in queries.op3_bpe(spark, H.DATA).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    for r in queries.op4_pii(spark, H.DATA).collect():
        want = by_pattern(docs[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in want) for n in range(4))
        assert not text or set(text.split(",")) <= set(r.spans.split(","))
    for r in queries.op5_token_counts(spark, H.DATA).collect():
        assert r.n_tokens == len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)


def test_the_classifier_decides_without_the_strict_form(spark):
    rng = random.Random(2)
    filler = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet consetetur".split()) for _ in range(12))
    texts = []
    for k in range(80):
        texts.append(f"{filler()} mail user{k}@site{k}.com {filler()}")
        texts.append(f"{filler()} call ({200 + k}) 555-{1000 + 7 * k} {filler()}")
        texts.append(f"{filler()} {4 * 10**15 + rng.randrange(10**15)} {filler()}")
        texts.append(f"{filler()} call {200 + k}-555-{1000 + 7 * k} {filler()}")
    out = {r.doc_id: r for r in pii.personal_data(H.docs_of(spark, texts)).collect()}
    for i in range(3, len(texts), 4):
        at = texts[i].index("call ") + 5
        assert (3, at, at + 12) in [tuple(s) for s in out[i].spans]
