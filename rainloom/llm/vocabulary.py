"""A byte-level BPE vocabulary file: pieces of a text, symbols, merges.

The file is in the JSON form of the ``tokenizers`` library.  Its path is a parameter; every
worker reads the installed copy once.
"""

from __future__ import annotations

import functools
import json
import re

import regex

#: Letters and numbers of newer Unicode versions than the library's pattern engine
#: knows; it takes them for neither.
NEWER = (
    "՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
PIECES = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{NEWER}]]+| ?[\p{{N}}--[{NEWER}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]+|\s+(?!\S)|\s+")
#: The same for the Latin blocks up to U+024F, on which all versions of Unicode agree; much faster.
LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼-¾]+"
    r"| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the file: itself, else 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """tokens: bytes by id; ranks: of a pair of ids, its rank and the id it becomes; specials."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        ids = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: bytes(names[c] for c in s) for s, i in ids.items() if s not in self.specials}
        self.byte_ids = [ids[c] for c, _ in sorted(names.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = ids[left], ids[right], ids[left + right]
            self.merges.setdefault((a, b), (rank, made))
            self.made_of.setdefault(made, (a, b, rank))
        self.special_texts = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None

    def split(self, text: str) -> list[tuple[str, int | None]]:
        """The text as (part, None) and (special string, its id), in order."""
        if self.special_texts is None or not any(s in text for s in self.specials):
            return [(text, None)]
        out, at = [], 0
        for m in self.special_texts.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.specials[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]


def pieces(text: str) -> list[str]:
    """The pieces that merges never cross."""
    return (PIECES if BEYOND_LATIN.search(text) else LATIN).findall(text)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo(dict):
    """Results of ``work`` by key; texts longer than ``longest`` are worked out each time.

    When it has ``most`` entries they become the old generation, and the one before is dropped.
    """

    def __init__(self, work, most: int = 200_000, longest: int | None = None) -> None:
        super().__init__()
        self.work, self.most, self.longest, self.old = work, most, longest, {}

    def __missing__(self, key):
        result = self.old.get(key)
        if result is None:
            result = self.work(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = result
        return result
