"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is exactly one token that can end its encoding.  An automaton
over the vocabulary gives all tokens that are suffixes of the prefix, longest first; a token t is
the last one if it is compatible with the last token of the prefix before t, that is, if the two
encode to themselves side by side.  One token is stored for each prefix; following them back from
the end gives the exact ids.  No merge is ever replayed.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_parts, tidy
from .vocabulary import Memo, Vocabulary, pieces, vocabulary

ENDLESS = 1 << 60
#: Entries of a generation of remembered pieces and pairs; the test of what an encoder remembers measures 33 MB.
PIECES_HELD, PAIRS_HELD = 100_000, 60_000


class Encoder:
    def __init__(self, words: Vocabulary) -> None:
        self.words = words
        self.whole: dict[int, bool] = {}
        # A token whose bytes encode to others ends no encoding.
        self.suffixes = ahocorasick.Automaton()
        for i, token in words.tokens.items():
            if self.is_whole(i):
                self.suffixes.add_word(token.decode("latin-1"), (i, len(token)))
        self.suffixes.make_automaton()
        self.whole.clear()
        self.fits = Memo(self.compatible, PAIRS_HELD)
        self.ids_of = Memo(lambda piece: self.encode_piece(piece.encode()), PIECES_HELD, longest=64)
        spelled = dict(words.tokens) | {i: s.encode() for s, i in words.specials.items()}
        spelled = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(x) for x in spelled])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at one edge of a token through its merges, each with the rank that ends it.

        side 1: the right edge, side 0: the left.
        """
        out, ends = [(token, ENDLESS)], self.words.made_of.get(token)
        while ends:
            out.append((ends[side], ends[2]))
            ends = self.words.made_of.get(ends[side])
        return out

    def undisturbed(self, left: int, right: int, before: int = ENDLESS) -> bool:
        """Whether no merge of rank under ``before`` joins the two across their boundary.

        A merge does so if its rank is below the ranks that end its two symbols.  At equal rank
        the place further left merges first: the boundary goes before the right symbol's own
        merge and after the left one's.
        """
        merges = self.words.merges
        ends_right = self.edge(right, 0)
        for a, a_ends in self.edge(left, 1):
            for b, b_ends in ends_right:
                made = merges.get((a, b))
                if made and made[0] < before and made[0] < a_ends and made[0] <= b_ends:
                    return False
        return True

    def compatible(self, pair: int) -> bool:
        """Whether the tokens pair >> 32 and pair & 0xFFFFFFFF encode to themselves side by side."""
        return self.undisturbed(pair >> 32, pair & 0xFFFFFFFF)

    def is_whole(self, token: int) -> bool:
        """Whether the bytes of the token encode to the token alone."""
        known = self.whole.get(token)
        if known is None:
            made = self.words.made_of.get(token)
            known = made is None or self.is_whole(made[0]) and self.is_whole(made[1]) and self.undisturbed(made[0], made[1], made[2])
            self.whole[token] = known
        return known

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        n = len(piece)
        last, back, done = [-1] * (n + 1), [0] * (n + 1), 0
        for end, (token, size) in self.suffixes.iter(piece.decode("latin-1")):
            end += 1
            if end == done:
                continue
            start = end - size
            if start == 0 or last[start] >= 0 and self.fits[last[start] << 32 | token]:
                last[end], back[end], done = token, start, end
        out = []
        while n:
            if last[n] < 0:
                raise ValueError("the vocabulary does not cover this piece")
            out.append(last[n])
            n = back[n]
        return struct.pack(f"<{len(out)}I", *out[::-1])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as ``encode_piece`` gives them."""
        ids_of = self.ids_of
        out = []
        for part, special in self.words.split(text):
            if special is None:
                out.extend(map(ids_of.__getitem__, pieces(part)))
            else:
                out.append(np.array([special], "<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        out = []
        tokens = np.frombuffer(ids, "<u4")
        for at in range(0, len(tokens), 1 << 16):
            part = tokens[at : at + (1 << 16)]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.spelled[np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


#: What encode_documents can give of a document, and its Arrow type.
OUTPUTS = {
    "n_tokens": pa.int64(),
    "token_ids": pa.binary(),
    "decoded": pa.string(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}
SPARK_TYPES = {"n_tokens": "long", "token_ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "token_ids")) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``outputs``; one pass, no shuffle.

    token_ids holds the ids as little-endian unsigned 32-bit integers, decoded the text that they
    decode to, the digests the SHA-256 of either.  A null text is empty: no tokens.  Repeated rows
    are encoded again; other columns are ignored, whatever their names; empty in, empty out.
    """

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in small_parts(batches):
            columns: dict[str, list] = {k: [] for k in outputs}
            for value in batch.column(1).to_pylist():
                ids = coder.encode(value or "")
                back = coder.decode(ids) if "decoded" in columns or "decoded_sha256" in columns else ""
                for k, c in columns.items():
                    c.append(len(ids) // 4 if k == "n_tokens" else ids if k == "token_ids" else back if k == "decoded" else hashlib.sha256(ids if k == "ids_sha256" else back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, OUTPUTS[k]) for k, c in columns.items())], ["doc_id", *outputs])

    rows = docs.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{k} {SPARK_TYPES[k]}" for k in outputs))


def decode_documents(encoded: DataFrame, path: str, doc_id: str = "doc_id", token_ids: str = "token_ids") -> DataFrame:
    """One row per row of ``encoded``: doc_id and the text that token_ids decode to; null is none."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in small_parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    rows = encoded.selectExpr(f"`{doc_id}` as doc_id", f"`{token_ids}` as token_ids")
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
