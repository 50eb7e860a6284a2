"""Vector bin packing of documents into training sequences.

Each example demands tokens, segments and loss-bearing tokens; a sequence limits all three. A task packs its rows as a
stream: documents longer than a sequence give full sequences and a rest, rests wait in a pool, and an open sequence takes
again and again the waiting example whose demand has the largest dot product with what is left of the limits. What then
remains free is filled by cutting one more example, so sequences are full. The last sequence of a task is cut into
lengths that are powers of two, which need no padding.

Sequence ids are unique over the whole job: the partition number, then a counter. A task that runs again makes the same
sequences, as its rows come from the same file split in the same order.

Defined cases: a null or empty text has only the closing id. Repeated rows are packed each. A null doc_id is kept. A text
of any length is cut into as many pieces as it needs, each id in one. An empty table gives no rows. Only doc_id and text are
read, so other columns' names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPACE, encoder
from .common import read_table

END_ID = 1
#: The vocabulary's pattern of words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space so long that the library's pattern, which goes back on them step by step, would exhaust its stack.
LONG_BLANK = re.compile(rf"[{SPACE}]{{512,}}")
#: Examples that wait in a task's pool at most before packing begins; all are packed in the end.
POOL = 2048


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    loss: int  #: of these ids, so many at the front bear loss
    doc_tokens: int

    def split(self, n: int) -> tuple[Piece, Piece]:
        a, b = self.ids[:n], self.ids[n:]
        return Piece(self.doc, self.start, a, min(self.loss, n), self.doc_tokens), Piece(self.doc, self.start + n, b, max(self.loss - n, 0), self.doc_tokens)


def fill(pool: list[Piece], limits: Limits, last: bool) -> Iterator[list[Piece]]:
    """Sequences from the pool, which keeps what waits; with last it is emptied."""
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
    demand = np.array([(len(p.ids), 1, p.loss) for p in pool], np.float64).reshape(-1, 3)
    free = np.ones(len(pool), bool)
    while free.any():
        if not last and demand[free, 0].sum() < 4 * limits.tokens:
            break
        bin_, left = [], cap.copy()
        while True:
            fits = np.flatnonzero(free & (demand <= left).all(axis=1))
            if not len(fits):
                break
            i = fits[np.argmax((demand[fits] / cap) @ (left / cap))]
            bin_.append(pool[i])
            free[i] = False
            left -= demand[i]
        room = int(left[0])
        if room and left[1] >= 1 and free.any():
            over = np.flatnonzero(free & (demand[:, 0] > room))
            over = over[np.minimum(demand[over, 2], room) <= left[2]] if len(over) else over
            if len(over):
                i = over[np.argmin(demand[over, 0])]
                a, pool[i] = pool[i].split(room)
                demand[i] = (len(pool[i].ids), 1, pool[i].loss)
                bin_.append(a)
        if not bin_:
            raise ValueError("an example of one id exceeds the limits")
        yield bin_
    pool[:] = [p for p, f in zip(pool, free, strict=True) if f]


def powers_of_two(bin_: list[Piece], full: int) -> Iterator[list[Piece]]:
    """A sequence that is not full, as sequences whose lengths are powers of two."""
    rest = list(bin_)[::-1]
    n = sum(len(p.ids) for p in rest)
    while n:
        size = full if n >= full else 1 << (n.bit_length() - 1)
        n -= size
        out = []
        while size:
            p = rest.pop()
            if len(p.ids) > size:
                p, q = p.split(size)
                rest.append(q)
            out.append(p)
            size -= len(p.ids)
        yield out


def pack(examples: Iterator[tuple[object, np.ndarray, int]], limits: Limits = Limits(), pool_size: int = POOL) -> Iterator[list[Piece]]:
    """Sequences from a stream of (doc, ids, loss-bearing ids at the front)."""
    pool: list[Piece] = []
    step = min(limits.tokens, limits.loss_tokens)

    def flush(last: bool) -> Iterator[list[Piece]]:
        for b in fill(pool, limits, last):
            if sum(len(p.ids) for p in b) in (limits.tokens,):
                yield b
            else:
                yield from powers_of_two(b, limits.tokens)

    for doc, ids, loss in examples:
        piece = Piece(doc, 0, ids, loss, len(ids))
        while len(piece.ids) > step:
            head, piece = piece.split(step)
            if step == limits.tokens:
                yield [head]
            else:
                pool.append(head)
        pool.append(piece)
        if len(pool) >= pool_size:
            yield from flush(False)
    yield from flush(True)


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, limits: Limits = Limits(), path: str | None = None) -> DataFrame:
    """A row a piece. Every id of a document but the closing one bears loss."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = token_ids(path)
        end = np.array([END_ID], "<u4")
        base = TaskContext.get().partitionId() << 40

        def examples():
            for b in batches:
                for d, t in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                    ids = np.concatenate([ids_of(t), end])
                    yield d, ids, len(ids) - 1

        rows = []
        for k, seq in enumerate(pack(examples(), limits)):
            at = 0
            for p in seq:
                rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids), p.doc_tokens, base + k, at, p.loss))
                at += len(p.ids)
            if len(rows) >= 20_000:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, COLUMNS)


@cache
def token_ids(path: str | None = None):
    """text -> ids. The vocabulary file's tokens as ranks for the library tiktoken, which gives the ids that the file's
    own library gives and takes a quarter of the time of the prefix tables, whose words it need not remember."""
    import tiktoken

    e = encoder(path)
    own = set(e.added.values())
    enc = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={b: i for i, b in e.bytes_of.items() if i not in own}, special_tokens=e.added)


    def ids(text: str | None) -> np.ndarray:
        text = text or ""
        plain = lambda x: enc.encode_to_numpy(x, allowed_special="all").astype("<u4")
        if LONG_BLANK.search(text) is None:
            return plain(text)
        # the pattern takes a run's characters but the last as one word (all at the end of the text)
        parts, at = [], 0
        for m in LONG_BLANK.finditer(text):
            end = m.end() - (m.end() < len(text))
            parts += [plain(text[at : m.start()]), np.frombuffer(e.encode_word(text[m.start() : end]), "<u4")]
            at = end
        return np.concatenate([*parts, plain(text[at:])])

    return ids


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents") if docs is None else docs)
