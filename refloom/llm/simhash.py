"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint has 64 bits from XXH64 hashes of word shingles. It is cut into ``blocks`` equal blocks; two fingerprints
that differ in at most ``max_bits`` bits agree on at least blocks - max_bits of them, so every choice of so many blocks
is a join key, and pairs under a key are verified by their distance. The work is on distinct fingerprints: a group of
copies is one row, whatever its size.

Keys that hold more than ``MAX_BUCKET`` fingerprints would make pairs quadratic. There each fingerprint emits itself and
its 64 one-bit neighbours instead: two fingerprints differ in at most two bits exactly if they share one of these, so
linking each to the least one that shares it gives the same components, in linear size.

The pipeline's stage takes another contract: sets of five words with a Jaccard index of 0.8 or more. SimHash of the sets
finds groups first, which are verified on the whole sets. What its few bits miss is found exactly: two near sets share one of
their first n / 5 + 1 shingles in any order common to all, here the rarest first, so these are join keys for the pairs that
are not in one group yet; these are verified too, and no near pair is lost.

Defined cases: texts of any length are read whole. Null and empty texts have no words and fingerprint zero, which links like any other. Repeated rows stay,
each with its component. A null doc_id keeps its fingerprint and the component of its group (null if the group has no
id). An empty table gives no rows. Of the input only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, freed, give_back, read_table, whole_row
from .components import components

SHINGLE, SEED, MAX_BITS, BLOCKS, MAX_BUCKET = 3, 42, 2, 4, 64
#: For the stage: words in a shingle, and the part of the union that near sets may lack (a fifth: Jaccard 0.8 or more).
STAGE_SHINGLE, LIKE_PART = 5, 5
#: Sizes are alike in one class of this step or in neighbouring ones; more than 1.25, which spares a thought of rounding.
SIZE_STEP = 1.26
#: Counters of shingles by hash, which only order them, and the rows they travel in.
SKETCH, SKETCH_ROWS = 1 << 20, 16
#: Ids that may be sent to every task, eight bytes each.
MAX_SENT = 1 << 21
#: Words of 32 bits in the filter of digests that are in a candidate pair.
BITMAP = 1 << 18


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash of each run of so many words; of all words where there are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z, and exactly blank and U+0009 to U+000D
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    return np.array([xxh64_intdigest(p, SEED) for p in parts], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: bit set where over half of the shingle hashes have it."""
    return _majority(_hashes(text, shingle))


def _majority(h: np.ndarray) -> int:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(h), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp})
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def _key(fp: Column, picked: tuple[int, ...], blocks: int) -> Column:
    width = 64 // blocks
    mask = sum(((1 << width) - 1) << (width * i) for i in picked)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def links(nodes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges a, b between the ids of near fingerprints. nodes: node, fp, with each fp once.

    They have the components of all links; in keys over max_bucket, links that stars imply are left out.
    """
    if max_bits != 2:
        raise ValueError("buckets over the bound are split by one-bit neighbours, which is exact for two bits")
    picks = list(combinations(range(blocks), blocks - max_bits))
    keys = F.array(*[F.struct(F.lit(i).alias("t"), _key(F.col("fp"), p, blocks).alias("k")) for i, p in enumerate(picks)])
    keyed = nodes.select("node", "fp", F.explode(keys).alias("e")).select("node", "fp", "e.t", "e.k")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    small, large = sizes.filter(F.col("n") <= max_bucket), sizes.filter(F.col("n") > max_bucket)
    buckets = keyed.join(small.select("t", "k"), ["t", "k"], "left_semi").groupBy("t", "k").agg(F.collect_list(F.struct("node", "fp")).alias("g"))
    near = lambda x, y: F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= max_bits
    found = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: (y["node"] < x["node"]) & near(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    verified = buckets.select(F.explode(found).alias("p")).select("p.a", "p.b")
    members = keyed.join(large.select("t", "k"), ["t", "k"], "left_semi").select("node", "fp").distinct()
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    shared = members.select("node", F.explode(around).alias("v"))
    least = shared.groupBy("v").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("v", "b")
    stars = shared.join(least, "v").filter("node <> b").select(F.col("node").alias("a"), "b")
    return verified.union(stars).distinct()


def by_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fp long, component_id for each row of docs."""
    marked = cut_lineage(with_fingerprints(docs))
    nodes = cut_lineage(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")).select("node", "fp"))
    return _with_components(marked, nodes, links(nodes))


def _with_components(marked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    # one document may, repeated with other texts, be the least id of several fingerprints: they are one node then
    comp = components(edges)
    by_fp = nodes.join(comp, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id"))
    return marked.join(by_fp, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = by_fingerprint(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _digest(h: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(h.tobytes(), SEED)


def with_sets(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a digest of a row's set of STAGE_SHINGLE words), sim (the set's SimHash), n (its size), par (its parities).
    The sets themselves are made anew from the texts where they are needed, as they are larger than these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(_hashes(t, STAGE_SHINGLE)) for t in b["text"]]
            one = lambda f: np.array([f(h) for h in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": one(_digest), "sim": one(_majority), "n": [len(h) for h in sets], "par": [_parities(h) for h in sets]})
        give_back()

    return _texts(docs).mapInPandas(run, "doc_id long, fp long, sim long, n int, par binary")


def _parities(h: np.ndarray) -> bytes:
    """Whether an odd number of the hashes ends in the bits 0, 1, 2 and so on; as many as hashes or more, a power of two."""
    width = 1 << max(6, (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def _unlike(x: bytes, y: bytes) -> int:
    """A lower bound of the number of elements that only one of two sets has, from their parities."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) != len(q):
        p, q = (p, q) if len(p) > len(q) else (q, p)
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _sketch(docs: DataFrame) -> np.ndarray:
    """How often shingles occur, added up by the low bits of their hash."""
    width = SKETCH // SKETCH_ROWS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(SKETCH, np.int64)
        for b in batches:
            for t in b["text"]:
                np.add.at(n, (np.unique(_hashes(t, STAGE_SHINGLE)) & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        if n.any():
            yield pd.DataFrame({"at": np.arange(SKETCH_ROWS), "n": [x.astype("<u4").tobytes() for x in n.reshape(-1, width)]})
        give_back()

    def add(frames: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in frames["n"])
        return freed(pd.DataFrame({"at": [int(frames["at"].iloc[0])], "n": [np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()]}))

    kind, out = "at int, n binary", np.zeros((SKETCH_ROWS, width), np.uint32)
    for r in docs.select("text").mapInPandas(count, kind).groupBy("at").applyInPandas(add, kind).collect():
        out[r["at"]] = np.frombuffer(bytes(r["n"]), "<u4")
    return out.ravel()


def _prefixes(docs: DataFrame) -> DataFrame:
    """fp, n, key: of each set of n shingles the rarest, so many that two sets with LIKE of their union in common share one."""
    seen = docs.sparkSession.sparkContext.broadcast(_sketch(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(_hashes(t, STAGE_SHINGLE)) for t in b["text"]]
            keys = []
            for h in sets:
                order = np.argsort(seen.value[(h & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")  # of equal counts the least hash
                keys.append(h[order[: len(h) // LIKE_PART + 1]].view(np.int64))
            yield pd.DataFrame({"fp": np.array([_digest(h) for h in sets], np.uint64).view(np.int64), "n": [len(h) for h in sets], "keys": keys})
        give_back()

    kept = _texts(docs).filter("doc_id is not null").mapInPandas(run, "fp long, n int, keys array<long>")
    return kept.select("fp", "n", F.explode("keys").alias("key"))


def _perhaps_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """fp, hs (the sorted hashes of the set) of the rows whose doc_id is a node of ids, and some others: what need not be
    dealt out goes before that."""
    word, bit = F.pmod(F.col("node"), F.lit(BITMAP)).cast("int"), F.call_function("shiftright", F.col("node"), F.lit(18)).bitwiseAND(F.lit(31))
    bits = np.zeros(BITMAP, np.uint32)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    for r in ids.groupBy(word.alias("w")).agg(F.bit_or(one).alias("m")).toLocalIterator():
        bits[r["w"]] = r["m"]
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b["doc_id"].to_numpy(np.int64)
            b = b[(held.value[at % BITMAP] >> ((at >> 18) & 31).astype(np.uint32)) & 1 == 1]
            sets = [np.unique(_hashes(t, STAGE_SHINGLE)) for t in b["text"]]
            yield pd.DataFrame({"fp": np.array([_digest(h) for h in sets], np.uint64).view(np.int64), "hs": [h.tobytes() for h in sets]})
        give_back()

    return _texts(docs).filter("doc_id is not null").mapInPandas(run, "fp long, hs binary")


def _perhaps_near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b without those whose parities already differ too much: near sets have at most a ninth of the sum of
    their sizes in one of them only. None that is near goes, and few others stay, so few whole sets travel after that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = [(2 * LIKE_PART - 1) * _unlike(x, y) <= n for x, y, n in zip(b["x"], b["y"], b["n"], strict=True)]
            yield b.loc[np.array(near, bool), ["a", "b"]]
        give_back()

    side = lambda fp, par, n: nodes.select(F.col("fp").alias(fp), F.col("par").alias(par), F.col("n").alias(n))
    both = pairs.join(side("a", "x", "n1"), "a").join(side("b", "y", "n2"), "b")
    return both.select("a", "b", "x", "y", (F.col("n1") + F.col("n2")).alias("n")).mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b of digests whose sets have a Jaccard index of 0.8 or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b["x"], b["y"], strict=True)]
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets]
            near = [LIKE_PART * k >= (LIKE_PART - 1) * (len(x) + len(y) - k) for (x, y), k in zip(sets, both, strict=True)]
            yield b.loc[np.array(near, bool), ["a", "b"]]
        give_back()

    pairs = cut_lineage(pairs)
    asked = cut_lineage(pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct())
    held = _perhaps_of(docs, asked.join(nodes, "fp").select("node"))
    sets = held.join(asked, "fp", "left_semi").groupBy("fp").agg(F.first("hs").alias("hs"))
    x, y = sets.select(F.col("fp").alias("a"), F.col("hs").alias("x")), sets.select(F.col("fp").alias("b"), F.col("hs").alias("y"))
    return cut_lineage(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long"))


def _alike(x: Column, y: Column) -> Column:
    """Whether the sizes allow the similarity."""
    return F.least(x["n"], y["n"]) * LIKE_PART >= F.greatest(x["n"], y["n"]) * (LIKE_PART - 1)


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs a, b that are not in one component of found."""
    comp = components(found)
    x, y = comp.select(F.col("node").alias("a"), F.col("component").alias("x")), comp.select(F.col("node").alias("b"), F.col("component").alias("y"))
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _by_simhash(nodes: DataFrame, max_bucket: int) -> DataFrame:
    """a, b: each digest with the least one of its group by SimHash: fingerprints at most MAX_BITS apart, linked on."""
    least = cut_lineage(nodes.groupBy("sim").agg(F.min("fp").alias("node")).select("node", F.col("sim").alias("fp")))
    comp = components(links(least, max_bucket=max_bucket)).withColumnRenamed("component", "low")
    group = least.join(comp, "node", "left").select(F.col("fp").alias("sim"), F.coalesce("low", "node").alias("b"))
    return nodes.select(F.col("fp").alias("a"), "sim").join(group, "sim").filter("a <> b").select("a", "b")


def set_links(docs: DataFrame, nodes: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """a, b: digests of near sets, with the components of all pairs of a Jaccard index of 0.8 or more. nodes: fp, sim, node, n,
    par.

    SimHash finds most groups, each digest verified against the least of its group. The prefixes give all other pairs: first
    one for each digest is verified, then every pair that is not in one component by that, so that a group of near copies
    is not compared pair by pair. In keys over max_bucket the first step is against one set, the last between components,
    by sizes that are alike, once for the keys that hold the same sets. Before whole sets travel, their parities meet.
    """
    found = _verified(_by_simhash(nodes, max_bucket), docs, nodes)
    buckets = cut_lineage(_prefixes(docs).groupBy("key").agg(F.collect_set(F.struct("fp", "n")).alias("g")).filter("size(g) > 1"))
    small, large = buckets.filter(F.size("g") <= max_bucket), buckets.filter(F.size("g") > max_bucket)
    pair = lambda x, y: F.struct(F.greatest(x["fp"], y["fp"]).alias("a"), F.least(x["fp"], y["fp"]).alias("b"))
    every = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: (y["fp"] < x["fp"]) & _alike(x, y)), lambda y: pair(x, y))))
    star = F.transform(F.filter("g", lambda x: (x["fp"] != F.col("low")["fp"]) & _alike(x, F.col("low"))), lambda x: pair(x, F.col("low")))
    pairs = small.select(F.explode(every).alias("p")).union(large.withColumn("low", F.array_min("g")).select(F.explode(star).alias("p")))
    pairs = cut_lineage(_perhaps_near(_apart(pairs.select("p.a", "p.b").distinct(), found), nodes))
    one = cut_lineage(pairs.groupBy("a").agg(F.min("b").alias("b")))
    found = cut_lineage(found.union(_verified(one, docs, nodes)))
    found = cut_lineage(found.union(_verified(_apart(pairs.join(one, ["a", "b"], "left_anti"), found), docs, nodes)))
    if large.isEmpty():
        return found
    comp = components(found).select(F.col("node").alias("fp"), "component")
    members = large.select("key", F.explode("g").alias("m")).select("key", "m.fp", "m.n").join(comp, "fp", "left")
    size = F.floor(F.log("n") / math.log(SIZE_STEP)).cast("int")
    groups = cut_lineage(members.groupBy("key", F.coalesce("component", "fp").alias("c"), size.alias("s")).agg(F.sort_array(F.collect_list(F.struct("fp", "n"))).alias("g")))
    held = [F.sum(h.cast("decimal(38,0)")).alias(f"h{i}") for i, h in enumerate((F.xxhash64("c", "s", "g"), F.xxhash64(F.lit(SEED), "c", "s", "g")))]
    several = groups.groupBy("key").agg(F.count(F.lit(1)).alias("k"), *held, (F.min("c") < F.max("c")).alias("more")).filter("more")
    groups = groups.join(several.groupBy("k", "h0", "h1").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    others = groups.select("key", F.col("c").alias("c2"), F.col("s").alias("s2"), F.col("g").alias("g2"), F.explode(F.array(F.col("s"), F.col("s") - 1)).alias("s"))
    across = groups.join(others, ["key", "s"]).filter("c < c2 or (c > c2 and s < s2)").select(F.explode("g").alias("x"), "g2").select("x", F.explode("g2").alias("y"))
    more = across.filter(_alike(F.col("x"), F.col("y"))).select(pair(F.col("x"), F.col("y")).alias("p")).select("p.a", "p.b").distinct()
    return found.union(_verified(_perhaps_near(more, nodes), docs, nodes))


def near_duplicates(docs: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fp long, component_id for each row of docs: linked are rows whose sets of five words have a Jaccard index of
    0.8 or more. fp is a digest of the set."""
    marked = cut_lineage(with_sets(docs))
    nodes = cut_lineage(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.min("sim").alias("sim"), F.first("n").alias("n"), F.first("par").alias("par")))
    a, b = nodes.select(F.col("fp").alias("a"), F.col("node").alias("x")), nodes.select(F.col("fp").alias("b"), F.col("node").alias("y"))
    edges = set_links(docs, nodes, max_bucket).join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return _with_components(marked.select("doc_id", "fp"), nodes.select("node", "fp"), edges)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: its least doc_id; the columns of docs. Rows that repeat an id and its text are one
    document. Rows without an id are no one's copy, as their component is named by ids; of equal texts of them one stays."""
    judged = near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    gone = cut_lineage(judged.filter("not first").select(F.col("doc_id").alias("_gone")))
    # few enough ids go to every task, which spares dealing out the texts; beyond the bound both sides are dealt out
    gone = F.broadcast(gone) if gone.count() <= MAX_SENT else gone
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(SEED), text).alias("_g"), whole_row(docs))
    key = ["_id", "_h", "_g"]
    kept = rows.filter("_id is not null").join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    # whole rows are dealt out for this only where an id and its text are repeated
    again = cut_lineage(rows.filter("_id is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key))
    if not again.isEmpty():
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return kept.unionByName(rows.filter("_id is null").dropDuplicates(["_h", "_g"])).select("_row.*")
