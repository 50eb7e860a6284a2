"""Language-model scores by masked pseudo-likelihood.

A network with a window on both sides predicts every token of a text from its neighbours, the token itself being left
out; the sum of the conditional log-probabilities scores the document. Tokens are white-space separated words in lower
case: the most frequent of the whole corpus have ids of their own, the others share ids by hash. The output is in
two steps, class and word in class, each a softmax. A word that shares its id has a third factor, its count in the corpus
over that of all words of the id, so that each word has a probability of its own and they add up to one.

Counts cover all documents: each part of them counts its own words, counts of equal words are added up over the parts, and
in scoring a part meets its words with these sums. So nothing that grows with the corpus is in one place. Training runs where the documents are: in each round every task goes over all its documents,
takes every second place by their position (the others in the other round, so that each place is a target once), improves the network on them in minibatches
with numpy and returns its weights; these are averaged, weighted by places, in a tree of groups of ``FAN_IN``, so what is
gathered grows with the tasks and the driver gets one network. Scoring then goes over all tokens of all documents.

Defined cases: null and empty texts have no tokens and score 0 (mean null). Repeated rows give a row each and count each.
A null doc_id is kept. An empty table gives no rows. A text of any length is one stretch. Words of equal counts have ids in
their own order, so ties are settled. Only doc_id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, partitions_for, read_table

OWN, SHARED, CLASS = 768, 256, 32
SIDE, WIDTH, HIDDEN = 2, 12, 24
#: Every SHARE-th place is a target in a round; as many rounds make all places targets.
SHARE = ROUNDS = 2
FAN_IN, SEED = 64, 7
CHUNK = 1 << 15
#: Bytes of words that a task remembers, and what one takes besides its letters.
MEMORY_BYTES, ENTRY_BYTES = 64 << 20, 150
#: Places scored at a time, so that they stay in the processor's cache.
BLOCK = 1 << 13


@dataclass
class Network:
    """Embeddings (one more id for places outside a text), window weights, class and word outputs."""

    emb: np.ndarray
    win: np.ndarray
    bias: np.ndarray
    cls: np.ndarray
    wrd: np.ndarray

    @staticmethod
    def fresh(own: int = OWN, shared: int = SHARED, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        v = own + shared
        c = -(-v // CLASS)
        g = lambda *s: r.normal(0, 0.1, s).astype(np.float32)
        return Network(g(v + 1, WIDTH), g(2 * SIDE, WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), g(HIDDEN + 1, c), g(c, HIDDEN + 1, CLASS))

    def arrays(self) -> list[np.ndarray]:
        return [self.emb, self.win, self.bias, self.cls, self.wrd]

    def dump(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.arrays()]).astype("<f4").tobytes()

    def load(self, data: bytes) -> Network:
        flat, at, out = np.frombuffer(data, "<f4"), 0, []
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)


def contexts(ids: np.ndarray, starts: np.ndarray, outside: int) -> np.ndarray:
    """The 2 * SIDE neighbours of each place; ids holds texts one after another, starting at starts."""
    spread = np.arange(len(ids)) + np.repeat(np.arange(1, len(starts) + 1) * SIDE, np.diff(np.append(starts, len(ids))))
    padded = np.full(len(ids) + SIDE * (len(starts) + 1), outside, ids.dtype)
    padded[spread] = ids
    return np.stack([padded[spread + k] for k in range(-SIDE, SIDE + 1) if k], axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _hidden(net: Network, ctx: np.ndarray) -> np.ndarray:
    h = np.ones((len(ctx), HIDDEN + 1), np.float32)
    np.maximum(net.emb[ctx].reshape(len(ctx), -1) @ net.win.reshape(-1, HIDDEN) + net.bias, 0, out=h[:, :-1])
    return h


def _by_class(net: Network, c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order of the rows by class, (class, first, end) in that order for the classes that occur)"""
    order = np.argsort(c.astype(np.uint8 if net.cls.shape[1] <= 256 else np.int32), kind="stable")
    bounds = np.searchsorted(c[order], np.arange(net.cls.shape[1] + 1)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp(x) along rows; overwrites x."""
    top = x.max(axis=1, keepdims=True)
    x -= top
    np.exp(x, out=x)
    return np.log(x @ np.ones(x.shape[1], np.float32)) + top[:, 0]


def projected(net: Network) -> np.ndarray:
    """For each window place, what each id adds to the hidden layer."""
    return np.stack([net.emb @ w for w in net.win])


def log_probs(net: Network, ctx: np.ndarray, target: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of each target given its neighbours. tables: projected(net), to compute it once."""
    tables = projected(net) if tables is None else tables
    order, runs = _by_class(net, target // CLASS)
    y, x = target[order], ctx[order]
    h = np.ones((len(y), HIDDEN + 1), np.float32)
    a = tables[0][x[:, 0]]
    for k in range(1, 2 * SIDE):
        a += tables[k][x[:, k]]
    a += net.bias
    np.maximum(a, 0, out=h[:, :-1])
    rows, c, w = np.arange(len(y)), y // CLASS, y % CLASS
    outer, inner = h @ net.cls, np.empty((len(y), CLASS), np.float32)
    for k, first, end in runs:
        np.matmul(h[first:end], net.wrd[k], out=inner[first:end])
    out = np.empty(len(y), np.float32)
    picked = outer[rows, c] + inner[rows, w]
    out[order] = picked - _log_sum(outer) - _log_sum(inner)
    return out


def improve(net: Network, ctx: np.ndarray, target: np.ndarray, batch: int = 4096, rate: float = 0.02) -> None:
    """One pass of Adam over the places, in place."""
    params = net.arrays()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step, a in enumerate(range(0, len(target), batch), 1):
        x, y = ctx[a : a + batch], target[a : a + batch]
        n = len(y)
        e = net.emb[x].reshape(n, -1)
        h = _hidden(net, x)
        c, w = y // CLASS, y % CLASS
        pc = _softmax(h @ net.cls)
        pc[np.arange(n), c] -= 1
        g_cls, dh = h.T @ pc, pc @ net.cls.T
        g_wrd = np.zeros_like(net.wrd)
        by, runs = _by_class(net, c)
        for k, first, end in runs:
            at = by[first:end]
            hk = h[at]
            pw = _softmax(hk @ net.wrd[k])
            pw[np.arange(len(at)), w[at]] -= 1
            g_wrd[k] = hk.T @ pw
            dh[at] += pw @ net.wrd[k].T
        da = dh[:, :-1] * (h[:, :-1] > 0)
        g_win = (e.T @ da).reshape(net.win.shape)
        de = (da @ net.win.reshape(-1, HIDDEN).T).reshape(-1, WIDTH)
        flat = x.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        heads = np.flatnonzero(np.diff(flat[order], prepend=-1))
        g_emb = np.zeros_like(net.emb)
        g_emb[flat[order[heads]]] = np.add.reduceat(de[order], heads, axis=0)
        for p, g, mm, vv in zip(params, (g_emb, g_win, da.sum(0), g_cls, g_wrd), m, v, strict=True):
            g /= np.float32(n)
            mm *= np.float32(0.9)
            mm += np.float32(0.1) * g
            vv *= np.float32(0.999)
            g *= g
            vv += np.float32(0.001) * g
            p -= np.float32(rate * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)) * mm / (np.sqrt(vv) + np.float32(1e-8))


class Vocabulary(dict):
    """word bytes -> id; words without an own id share some by hash and are remembered up to a bound."""

    def __init__(self, words: list[str], own: int = OWN, shared: int = SHARED):
        super().__init__({w.encode(): i for i, w in enumerate(words[:own])})
        self.base, self.own, self.shared, self.size = dict(self), own, shared, 0

    def __missing__(self, word: bytes) -> int:
        import zlib

        self.size += ENTRY_BYTES + len(word)
        if self.size > MEMORY_BYTES:
            self.clear()
            self.update(self.base)
            self.size = 0
        self[word] = out = self.own + zlib.crc32(word) % self.shared
        return out


def lower_text() -> Column:
    return F.lower(F.coalesce("text", F.lit("")))


def number_of_parts(docs: DataFrame) -> int:
    """It follows the bytes of the input."""
    return max(partitions_for(docs, "text"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    """p, doc_id, text in lower case: rows dealt out by a hash, each part a partition."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_text().alias("text"))
    return given.withColumn("p", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("p"))


def part_counts(docs: DataFrame, parts: int) -> DataFrame:
    """p, word, n, first: the words of each part of dealt(docs, parts), each with its count in the whole corpus, and whether the
    row is the word's first. A part counts its words where it is; a word has a row a part at most."""
    words = dealt(docs, parts).select("p", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    own = words.groupBy("p", "word").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("word")
    return own.select("p", "word", F.sum("n").over(every).alias("n"), (F.col("p") == F.min("p").over(every)).alias("first"))


def most_frequent(counts: DataFrame) -> list[str]:
    return [r["word"] for r in counts.filter("first").orderBy(F.col("n").desc(), "word").limit(OWN).collect()]


def tokens(docs: DataFrame, words: list[str], counts: DataFrame, parts: int) -> DataFrame:
    """doc_id, ids (two little-endian bytes a token), extra: the sum of the third factors' logarithms. A part of the
    documents meets a table of its own words; texts are cut into words here and nowhere else."""
    own = set(words)
    shares = ~F.col("word").isin(words) if words else F.lit(True)
    of = np.ones(OWN + SHARED)  # the counts of all words of a shared id
    shared_id = F.lit(OWN) + F.crc32(F.col("word").cast("binary")) % SHARED
    for r in counts.filter("first").filter(shares).groupBy(shared_id.alias("id")).agg(F.sum("n").alias("n")).collect():
        of[r["id"]] = r["n"]

    def run(texts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        vocab, known = Vocabulary(words), table["word"].tolist()
        id_of = np.array([vocab[w.encode()] for w in known], "<i2")
        extra_of = np.where([w in own for w in known], 0.0, np.log(table["n"].to_numpy(np.float64)) - np.log(of[id_of])) if known else np.empty(0)
        place = {w.encode(): i for i, w in enumerate(known)}
        ids, extra = [], []
        for t in texts["text"]:
            w = t.encode().split()
            at = np.fromiter(map(place.__getitem__, w), np.int32, len(w))
            ids.append(id_of[at].tobytes())
            extra.append(float(extra_of[at].sum()))
        return pd.DataFrame({"doc_id": texts["doc_id"].astype("Int64"), "ids": ids, "extra": extra})

    table = counts.select("p", "word", "n").repartitionById(parts, F.col("p"))
    return dealt(docs, parts).groupBy("p").cogroup(table.groupBy("p")).applyInPandas(run, "doc_id long, ids binary, extra double")


def _stretches(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """(doc ids, extras, token ids, starts) of some documents at a time; a long document stays whole."""

    def whole() -> tuple[list, list, np.ndarray, np.ndarray]:
        return docs, extra, np.concatenate(parts).astype(np.int32), np.cumsum([0] + [len(p) for p in parts[:-1]])

    docs, extra, parts, size = [], [], [], 0
    for b in batches:
        for d, i, x in zip(b["doc_id"].astype("Int64"), b["ids"], b["extra"], strict=True):
            docs.append(d)
            extra.append(x)
            parts.append(np.frombuffer(i, "<i2"))
            size += len(parts[-1]) + 1
            if size >= CHUNK:
                yield whole()
                docs, extra, parts, size = [], [], [], 0
    if docs:
        yield whole()


def _average(frames: pd.DataFrame) -> tuple[int, bytes]:
    n = int(frames["n"].sum())
    total = None
    for k, w in zip(frames["n"], frames["weights"], strict=True):
        x = np.frombuffer(w, "<f4").astype(np.float64) * (k / max(n, 1))
        total = x if total is None else total + x
    return n, total.astype("<f4").tobytes()


def train_round(rows: DataFrame, net: Network, turn: int, share: int = SHARE) -> Network:
    """rows: tokens(...). Every share-th place is a target."""
    start = net.dump()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen, held = net.load(start), 0, 0
        ctxs, targets = [], []
        for _, _, ids, starts in _stretches(batches):
            at = slice(turn % share, None, share)
            ctxs.append(contexts(ids, starts, OWN + SHARED)[at])
            targets.append(ids[at])
            held += len(targets[-1])
            if held >= CHUNK:
                improve(own, np.concatenate(ctxs), np.concatenate(targets))
                seen += held
                ctxs, targets, held = [], [], 0
        if held:
            improve(own, np.concatenate(ctxs), np.concatenate(targets))
            seen += held
        if seen:
            yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "n": [seen], "weights": [own.dump()]})

    def mean(frames: pd.DataFrame) -> pd.DataFrame:
        n, w = _average(frames)
        return pd.DataFrame({"task": [int(frames["task"].iloc[0]) // FAN_IN], "n": [n], "weights": [w]})

    kind = "task long, n long, weights binary"
    level = cut_lineage(rows.mapInPandas(run, kind))
    while (count := level.count()) > 1:
        level = level.groupBy(F.floor(F.col("task") / FAN_IN).alias("_g")).applyInPandas(mean, kind)
        level = cut_lineage(level) if count > FAN_IN else level
    last = level.collect()
    return net.load(bytes(last[0]["weights"])) if last else net


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Network:
    net = Network.fresh()
    for turn in range(rounds):
        net = train_round(rows, net, turn)
    return net


def read(docs: DataFrame, words: list[str] | None = None) -> tuple[list[str], DataFrame]:
    """The words with an id of their own (the most frequent, if none are given) and tokens(...), written once."""
    parts = number_of_parts(docs)
    counts = cut_lineage(part_counts(docs, parts))
    words = most_frequent(counts) if words is None else words
    return words, cut_lineage(tokens(docs, words, counts, parts))


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[list[str], Network]:
    """The OWN most frequent words and a network, from all documents."""
    words, rows = read(docs)
    return words, fit(rows, rounds)


def score_rows(rows: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all tokens), mean_log_prob. rows: tokens(...)."""
    blob = net.dump()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = net.load(blob)
        tables = projected(own)
        for docs_, extra, ids, starts in _stretches(batches):
            ctx = contexts(ids, starts, OWN + SHARED)
            n, total = np.diff(np.append(starts, len(ids))), np.array(extra)
            if len(ids):
                lp = np.concatenate([log_probs(own, ctx[a : a + BLOCK], ids[a : a + BLOCK], tables) for a in range(0, len(ids), BLOCK)])
                total[n > 0] += np.add.reduceat(lp.astype(np.float64), starts[n > 0])
            yield pd.DataFrame({"doc_id": pd.array(docs_, "Int64"), "n_tokens": n, "log_likelihood": total})

    scored = rows.mapInPandas(run, "doc_id long, n_tokens long, log_likelihood double")
    return scored.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_prob"))


def score(docs: DataFrame, words: list[str], net: Network) -> DataFrame:
    return score_rows(read(docs, words)[1], net)


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = read(read_table(spark, sf_dir, "documents"))
    return score_rows(rows, fit(rows))
