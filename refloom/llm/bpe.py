"""BPE encoding by a table over prefixes, and decoding.

A byte-pair encoding has one last token for every prefix of a word: the token that ends there and is compatible with the
last token of what it leaves. Two tokens are compatible if merging never crosses their boundary, which the merge trees of
both decide: no node on the right edge of the first and node on the left edge of the second, alive at the same time, have
a merge that comes before either is merged away. An automaton with suffix links over the vocabulary lists the tokens that
end at each place; the table is filled from left to right and back-pointers give the ids, in linear time for any length.

Words are cut by the tokenizer's own pattern first, and the added token's string is cut out before that, as the
tokenizers library does. Equal words of a task are encoded once.

Defined cases: texts and words of any length are encoded whole. Null and empty texts have no ids. Repeated rows each give a row, a null doc_id is kept, an empty table
gives no rows, and only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: White space by code point, as the tokenizer's pattern means it.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same for texts without a code point over U+00FF, where letters and numbers are few: the standard library's engine
#: takes them, which is faster.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
NARROW = rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^\t-\r \x85\xa0{_L}{_N}]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
#: Code points (hex, ranges with a hyphen) that are letters or numbers in the regular expression engine's
#: Unicode tables, which are newer, and neither in the tokenizer's. A test goes over all code points.
NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF
10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F
12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF
1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_NEWER = "".join("-".join(f"\\U{int(end, 16):08X}" for end in ends.split("-")) for ends in NEWER.split())
#: The pattern for texts with one of them.
EXACT = PATTERN.replace(rf"[^{SPACE}\p{{L}}\p{{N}}]+", rf"(?:[^{SPACE}\p{{L}}\p{{N}}]|[{_NEWER}])+").replace(r"\p{L}+", rf"(?:(?![{_NEWER}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{_NEWER}])\p{{N}})+")
#: Pairs, and bytes of words and their ids, that a task remembers.
MEMORY, MEMORY_BYTES = 500_000, 48 << 20
#: What a remembered word takes besides its characters.
ENTRY_BYTES = 200
VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Words(dict):
    """word -> ids as little-endian bytes; of two generations the older one is forgotten when the younger is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older, self.size = make, {}, 0

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self.make(word)
        self.size += ENTRY_BYTES + 2 * len(word) + len(out)
        if self.size >= MEMORY_BYTES:
            self.older, self.size = dict(self), 0
            self.clear()
        if len(word) < MEMORY_BYTES >> 8:  # longer ones would drive out the others
            self[word] = out
        return out


class PrefixBPE:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        value = {c: b for b, c in enumerate(byte_letters())}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, r)
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = pair, r
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if len(text) == 1 or i in self.parts:
                self.automaton.add_word("".join(chr(value[c]) for c in text), (i, len(text)))
        self.automaton.make_automaton()
        self.bytes_of = {i: bytes(value[c] for c in t) for t, i in vocab.items() if all(c in value for c in t)}
        self.bytes_of.update({i: t.encode() for t, i in self.added.items()})
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list] = {}
        self.words = _Words(self.encode_word)
        self.find_wide, self.find_narrow = regex.compile(PATTERN, regex.V1).findall, re.compile(NARROW).findall
        self.find_exact, self.newer = regex.compile(EXACT, regex.V1).findall, re.compile(f"[{_NEWER}]").search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None

    def edge(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """(node, rank at which it comes, rank at which it is merged away) down the left (0) or right (1) edge of a token."""
        out = self.edges.get((token, side))
        if out is None:
            out, gone = [], float("inf")
            while True:
                born = self.born.get(token, -1)
                out.append((token, born, gone))
                if born < 0:
                    break
                token, gone = self.parts[token][side], born
            self.edges[(out[0][0], side)] = out
        return out

    def compatible(self, a: int, b: int) -> bool:
        out = True
        for x, x_born, x_gone in self.edge(a, 1):
            for y, y_born, y_gone in self.edge(b, 0):
                r = self.rank.get((x, y))
                # on equal ranks the pair further left is merged first
                if r is not None and x_born <= r < x_gone and y_born <= r <= y_gone:
                    out = False
        if len(self.pairs) >= MEMORY:
            self.pairs.clear()
        self.pairs[a << 32 | b] = out
        return out

    def encode_word(self, word: str) -> bytes:
        """Ids of one word. The table: last[i] is the last token of the prefix of i bytes, back[i] where it starts."""
        text = word.encode().decode("latin-1")
        last, back = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        known = self.pairs.get
        for at, (token, size) in self.automaton.iter(text):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                ok = known(before << 32 | token)
                if ok is None:
                    ok = self.compatible(before, token)
                if not ok:
                    continue
            last[end], back[end] = token, start
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def find(self, text: str) -> list[str]:
        """The words of a text, after the tokenizer's pattern."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.find_exact(text) if self.newer(text) else self.find_wide(text)
        return self.find_narrow(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = self.words.__getitem__
        if self.cut is None or not any(t in text for t in self.added):
            return b"".join(map(words, self.find(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out += map(words, self.find(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@cache
def encoder(path: str | None = None) -> PrefixBPE:
    """One encoder a process. path: None takes the public vocabulary file by its name."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return PrefixBPE(path)


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids (little-endian bytes) and decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            rows = []
            for t in b["text"]:
                ids = e.encode(t)
                text = e.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                rows.append((*row, ids, text) if with_ids else row)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if with_ids else 3])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))
