"""Personal data by weak supervision.

One scan of the texts finds candidates: every match of the base patterns, whether it passes its
test or not, and matches of looser patterns.  Labelers vote on each candidate: pattern and test,
gazetteer, context, surroundings and shape.  A candidate is one of few vote codes (kind and
votes), so the votes of the whole corpus are a small table of counts.  Expectation-maximisation over it estimates how
reliable each labeler is; the posteriors train a logistic span classifier over votes and kind.
Candidates of the base patterns that pass their test always stay; the classifier adds others.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_parts as parts_of
from .scratch import keep

#: In the order of the results; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "id_number", "iban", "name")
BASE = 4
LABELERS = 5
#: A candidate beside the base is added from this probability on.
THRESHOLD = 0.9
WINDOW = 40

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
ID_NUMBER = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9])([A-Za-z_-]{2,20})[ ]?[=:][ ]?[\"']?([A-Za-z0-9+/_-]{8,})")
NAME = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? ([A-Z][a-z]{2,20}(?: [A-Z][a-z]{2,20})?)(?![a-z])")

#: Gazetteers of the third labeler, and words near a kind.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl ru jp cn br in au ca ch at be se no dk fi pl".split())
SECRET_WORDS = frozenset("password passwd pwd passphrase secret token apikey api_key api-key access_key secret_key auth_token private_key key".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "94", "98", "351", "352", "353", "358", "420", "971", "972")
NEAR = {
    "email": "mail contact write",
    "ip": "ip address host server",
    "card": "card visa mastercard credit payment",
    "phone": "phone tel call mobile fax",
    "secret": "password token secret login credential",
    "id_number": "ssn social security id number",
    "iban": "iban account bank",
    "name": "name dear signed regards",
}
CONTEXT = {k: re.compile(rf"(?i)(?<![a-z])(?:{'|'.join(v.split())})") for k, v in NEAR.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    rest = 0
    for c in text[4:] + text[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern: each grows around its @, so the scan is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def small_parts(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in text.split("."))


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it passes its test) of the base patterns' matches."""
    out = [(0, a, b, True) for a, b in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    if "." in text:
        out += [(1, m.start(), m.end(), small_parts(m[0])) for m in IP.finditer(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = digits_of(m[0])
            out.append((2, m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        out += [(3, m.start(), m.end(), 9 <= len(digits_of(m[0])) <= 15) for m in PHONE.finditer(text)]
    return out


def loose_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """Candidates beside the base: (kind, start, end, whether the strict form holds)."""
    out = []
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            if m[1].lower().lstrip("_-") in SECRET_WORDS:
                value = m[2]
                out.append((4, m.start(2), m.end(2), len(value) >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)))
    if re.search("[0-9]", text):
        out += [(3, m.start(), m.end(), "(" in m[0]) for m in LOCAL_PHONE.finditer(text)]
        out += [(5, m.start(), m.end(), not m[0].startswith(("000", "666", "9")) and "-00-" not in m[0]) for m in ID_NUMBER.finditer(text)]
        out += [(6, m.start(), m.end(), mod97(m[0])) for m in IBAN.finditer(text)]
    out += [(7, m.start(1), m.end(1), " " in m[1]) for m in NAME.finditer(text)]
    return out


def gazetteer(kind: int, found: str) -> bool:
    if kind == 0:
        return found.rpartition(".")[2].lower() in TOP_DOMAINS
    if kind == 1:
        return found.split(".")[0] not in ("0", "127", "255")
    if kind == 2:
        return digits_of(found).startswith(CARD_STARTS)
    if kind == 3:
        return found[:1] != "+" or digits_of(found).startswith(COUNTRY_CODES)
    return kind in (4, 6)


def votes(text: str, kind: int, start: int, end: int, passes: bool) -> int:
    """One bit for each labeler: pattern, gazetteer, context, surroundings, shape."""
    found = text[start:end]
    context = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    apart = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    shape = len(set(found)) >= 5 and end - start <= 64
    bits = (passes, gazetteer(kind, found), bool(CONTEXT[KINDS[kind]].search(context)), apart, shape)
    return sum(b << k for k, b in enumerate(bits))


def code_of(kind: int, bits: int, base: bool) -> int:
    """The vote code: kind, votes and whether a base pattern matched."""
    return (kind << LABELERS | bits) << 1 | base


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans (kind, start, end), and all candidates (kind, start, end, vote code).

    A candidate that overlaps a base span is no other candidate.
    """
    matches = base_spans(text)
    base = [m[:3] for m in matches if m[3]]
    found = [(k, a, b, code_of(k, votes(text, k, a, b, p), True)) for k, a, b, p in matches]
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(itertools.accumulate((b for _, b in taken), max))  # the furthest end so far
    for k, a, b, p in loose_spans(text):
        before = bisect.bisect_left(starts, b)
        if not before or reach[before - 1] <= a:
            found.append((k, a, b, code_of(k, votes(text, k, a, b, p), False)))
    return base, found


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.int32())])


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, base, found), one for each row of ``docs``; a null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            base, found = [], []
            for value in batch.column(1).to_pylist():
                b, f = scan(value or "")
                base.append([{"kind": k, "start": x, "end": y, "code": 0} for k, x, y in sorted(b)])
                found.append([{"kind": k, "start": x, "end": y, "code": c} for k, x, y, c in f])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(SPAN)), pa.array(found, pa.list_(SPAN))], ["doc_id", "base", "found"])

    rows = docs.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text")
    spans = "array<struct<kind: int, start: long, end: long, code: int>>"
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {spans}, found {spans}")


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation: (posterior of each code, P(vote | private), P(vote | not)).

    Two classes, votes independent within a class, a share of private candidates for each kind;
    counts are smoothed by one vote either way.
    """
    kinds, bits = codes >> (LABELERS + 1), (codes >> 1)[:, None] >> np.arange(LABELERS) & 1
    posterior = 0.1 + 0.8 * bits.mean(1)
    for _ in range(rounds):
        yes, no = counts * posterior, counts * (1 - posterior)
        p, q = (yes @ bits + 1) / (yes.sum() + 2), (no @ bits + 1) / (no.sum() + 2)
        share = np.array([(yes[kinds == k].sum() + 1) / (counts[kinds == k].sum() + 2) for k in kinds])
        log = np.log(share / (1 - share)) + bits @ np.log(p / q) + (1 - bits) @ np.log((1 - p) / (1 - q))
        posterior = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return posterior, p, q


def features(codes: np.ndarray) -> np.ndarray:
    kinds, bits = codes >> (LABELERS + 1), (codes >> 1)[:, None] >> np.arange(LABELERS) & 1
    return np.hstack([bits, (kinds[:, None] == np.arange(len(KINDS))).astype(float), np.ones((len(codes), 1))])


def classifier(codes: np.ndarray, counts: np.ndarray, posterior: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of the logistic span classifier, by Newton's method on all counted codes."""
    x = features(codes)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - posterior)) + ridge * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def accepted_codes(found: DataFrame, threshold: float = THRESHOLD) -> list[int]:
    """The vote codes beside the base that the classifier accepts.

    There are at most 8 kinds x 32 votes x 2 codes, whatever the corpus; all candidates count.
    """
    rows = found.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    if not rows:
        return []
    codes, counts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    posterior, _, _ = reliabilities(codes, counts)
    score = 1 / (1 + np.exp(-(features(codes) @ classifier(codes, counts, posterior))))
    return [int(c) for c, s in zip(codes, score, strict=True) if not c & 1 and s >= threshold]


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, arrays of (kind, start, end) in order.

    Places are code points, end exclusive.  spans has the base spans and those that the classifier
    adds, none of which overlaps a base span.  A null or empty text has none; repeated rows have
    the same; other columns are ignored; empty in, empty out.
    """
    rows = keep(candidates(docs, doc_id, text), "candidates")
    good = accepted_codes(rows, threshold)
    plain = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    extra = F.filter("found", lambda x: x["code"].isin(good)) if good else F.filter("found", lambda x: F.lit(False))
    return rows.select("doc_id", plain(F.col("base")).alias("base"), F.array_sort(F.array_distinct(F.concat(plain(F.col("base")), plain(extra)))).alias("spans"))


def spelled(spans: str) -> Column:
    """The spans as kind:start:end, comma-joined."""
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])), ",")
