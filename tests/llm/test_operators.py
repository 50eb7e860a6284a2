"""Corpus operators against brute force, on small tables with nulls, ties, repeats, clashing columns and long texts."""

import hashlib
import os
import random
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from refloom.llm import bpe, bwt, chat, common, htmlcrf, packing, pll, quality, registry, simhash, spotsigs, suffix, urls

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, _d int, fp string"


def texts(seed=1, n=60):
    r = random.Random(seed)
    words = ["the", "of", "and", "la", "der", "é", "ß", "😀", "Word", "x###", "and\n", "don't", "12", "中文"]
    base = [" ".join(r.choice(words) + str(r.randrange(9)) for _ in range(60)) for _ in range(5)]
    out = [(i, r.choice(base)[: r.randrange(400)] + " " + " ".join(r.choice(words) for _ in range(r.randrange(40)))) for i in range(n)]
    out += [(100, None), (101, ""), (102, " \n "), (103, "And " * 3000), (104, "And " * 3001), (105, base[0]), (106, base[0]), (106, base[0]), (106, base[1]), (None, base[2]), (107, "a"), (108, "<|endoftext|> b")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, "clash") for i, t in texts()], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_transform_is_a_suffix_array(tmp_path):
    r = random.Random(2)
    strings = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 30))) for _ in range(40)]
    text, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])
    b, lcp = bwt.build(text, ends, str(tmp_path))
    every = sorted((s[i:] + b"\x00", k, s[i - 1] + 1 if i else 0) for k, s in enumerate(strings) for i in range(len(s) + 1))
    assert [x[2] for x in every] == b.tolist()
    shared = [0] + [next((i for i, (p, q) in enumerate(zip(x[0], y[0], strict=False)) if p != q or p == 0), 0) for x, y in zip(every, every[1:], strict=False)]
    assert shared == lcp.tolist()


def removed(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for d, t in rows:
        b, m = (t or "").encode(), bytearray(len((t or "").encode()) + 1)
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                m[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, f in zip(b, m, strict=False) if not f)
        spans = sum(1 for i in range(len(b)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((d or -1, len(b), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, empty):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup_passages(docs).collect())
    assert got == removed(texts())
    assert suffix.dedup_passages(empty).count() == 0
    left = suffix.cut_passages(docs.sparkSession, docs, D)
    assert left.columns == docs.columns and left.count() == sum(n > gone or n == 0 for _, n, gone, _, _ in got)


def test_suffix_dedup_compares_bytes(spark):
    r = random.Random(6)
    rows = []
    for i in range(150):
        b = [chr(r.randrange(33, 127)) for _ in range(300)]
        rows.append((i + 1, "".join(b)))
        k = r.randrange(100, 180)
        b[k], b[k + 17] = b[k + 17], b[k]
        rows.append((1000 + i, "".join(b)))
    split = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lambda df: sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix.dedup_passages(df).collect())
    assert out(split) == out(split.coalesce(1)) == removed(rows)
    a, b = np.frombuffer(("a" * 60 + "b" * 60).encode(), np.uint8), np.array([0, 1, 20])
    assert suffix.same_bytes(a, b, np.array([5, 2, 60]), np.array([50, 59, 50])).tolist() == [True, False, False]


def test_suffix_dedup_with_equal_hashes():
    step = suffix.cut_documents(8)
    rows = [(i, (t or "").encode()) for i, t in texts() if i is not None and i < 60]
    import pyarrow as pa

    def marks():
        batch = pa.RecordBatch.from_pylist([{"_d": i, "_b": b} for i, b in rows])
        return {(d, s, n) for out in step(iter([batch])) for k, b in zip(out.column("kind").to_pylist(), out.column("blob").to_pylist(), strict=True) if k == suffix.MARKS for d, s, n in zip(*[suffix.load(b)[0][c].tolist() for c in ("doc", "start", "n")], strict=True)}

    before, cut = marks(), suffix.cut
    every = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            every.setdefault(b[k : k + 50], i)
    suffix.cut = lambda segments, hot: (*cut(segments)[:4], np.zeros(len(cut(segments)[0]), np.uint64))  # every x equal
    try:
        blind = marks()
    finally:
        suffix.cut = cut
    body = dict(rows)
    assert before and all(every[body[d][s + j : s + j + 50]] < d for d, s, n in blind for j in range(n))


def test_suffix_dedup_with_anchors_in_many_contexts(spark, monkeypatch):
    """A line of 30 bytes and one of 49 in many texts; whatever anchors are refined, the same bytes go."""
    r = random.Random(1)
    word = lambda k: "".join(chr(r.randrange(97, 123)) for _ in range(k))
    rows = []
    for i in range(1500):
        t = word(r.randrange(5, 80)) + "This line of thirty bytes here" + word(r.randrange(5, 60)) + "A common line that has as many as forty-nine byte" + word(r.randrange(40))
        rows += [(10_001 + i, t)] if i % 100 == 0 else []
        rows.append((i + 1, rows[-1][1][10:] + word(30) if i % 100 == 1 else t))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    known = df.select(F.col("doc_id").alias("_d"), F.col("text").cast("binary").alias("_b"))
    want, found = removed(rows), []
    monkeypatch.setattr(suffix, "SAMPLE", 1)
    for many in (1, 50, 1_000_000):
        monkeypatch.setattr(suffix, "MANY", many)
        found.append(len(suffix.anchors_in_many_contexts(known)))
        assert sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix.dedup_passages(df).collect()) == want
    assert found[0] > found[1] > 10 and found[2] == 0


def test_suffix_dedup_of_long_texts(spark):
    r = random.Random(3)
    body = "".join(chr(r.randrange(99, 123)) for _ in range(1000))
    rows = [(1, "ab" * 600_000), (2, "x" + "ab" * 100 + body), (3, body * 1500)]
    got = {x["doc_id"]: x for x in suffix.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in (1, 2, 3)] == [(0, 0), (200, 1), (1_500_000, 1)]
    assert got[3]["n_bytes"] == 1_500_000 and got[1]["n_bytes"] == 1_200_000


def test_passage_step_holds_little_memory():
    """A task's own memory over what its pieces and texts take, and what its worker holds after it."""
    code = r"""
import os, random, re, sys
import pyarrow as pa
from refloom.llm import suffix
r = random.Random(4)
body = [bytes(r.randrange(97, 123) for _ in range(40_000)) for _ in range(50)]
rows = [(i, body[i % 50][k : k + 20_000] + r.randbytes(20_000)) for i, k in enumerate([0, 7_000, 20_000] * 150)]
table = pa.table({"_d": [i for i, _ in rows], "_b": [b for _, b in rows]})
suffix.cut_documents(8)(iter(table.slice(0, 1).to_batches())).__next__()
status = lambda k: int(re.search(k + r":\s+(\d+)", open("/proc/self/status").read()).group(1)) >> 10
before = status("RssAnon")
open("/proc/self/clear_refs", "w").write("5")
low = status("VmRSS")
for out in suffix.cut_documents(53)(iter(table.to_batches(max_chunksize=100))):
    del out
print(status("VmHWM") - low, status("RssAnon") - before)
"""
    peak, after = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).stdout.split())
    assert peak < 150 and after < 70


def test_bpe(docs, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given = [x for _, x in texts()] + ["a" * 999, " " * 99, "it's we'LL", "\x85\xa0 ²Ⅷ\u2003"]
    e, fast = bpe.encoder(), packing.token_ids()
    for x in given:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(e.encode(x), "<u4").tolist() == ids == fast(x).tolist()
        assert e.decode(e.encode(x)) == t.decode(ids, skip_special_tokens=False) == (x or "")
    assert bpe.encode_documents(docs).count() == docs.count()
    assert bpe.encode_documents(empty).count() == 0


def test_words_over_all_code_points():
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    e = bpe.encoder()
    for i in range(0, len(every), 256):
        text = "".join(f"a{c}1{c}!{c} {c}  " for c in every[i : i + 256])
        assert list(map(len, e.find(text))) == [b - a for _, (a, b) in t.pre_tokenize_str(text)]


def test_html_held_out(spark):
    model = htmlcrf.default_model()
    pages = htmlcrf.signed(htmlcrf.labelled_pages(150, 77))
    hits = [a == b for blocks, labels in pages for a, b in zip(model.labels(blocks), labels, strict=True)]
    assert sum(hits) / len(hits) > 0.99
    page = '<body><nav><a>Home</a></nav><div class="cookie-note">We use cookies.</div><article><h1>T &amp; U</h1><p>One<br>two <b>th</b>ree.<p>Four five.<div class="comments"><p>Nice text.</p></div></article><footer>c</footer>'
    df = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (None, None, None, 1), (2, "v", "<!-- <p>x", 1), (3, "w", "<article><p>" + "long text. " * 20000, 1)], "page_id long, url string, html string, text int")
    got = sorted((r["text"], r["n_chars"]) for r in htmlcrf.extract_text(df, model).collect())
    assert got[0] == got[1] == ("", 0) and got[2] == got[3] == ("T & U One two three. Four five.", 31) and got[4][1] == 220000 - 1


def test_spot_fingerprints(docs, empty):
    got = spotsigs.fingerprints(docs).collect()
    rows = [(d, t) for d, t in sorted(((d, t or "") for d, t in texts()), key=lambda x: (x[0] if x[0] is not None else -1, x[1]), reverse=True)]
    want = Counter()
    for i, (d, t) in enumerate(rows):
        nxt, k = rows[(i + 1) % len(rows)][1], len(t) // 3
        want[d, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    same = {r["fingerprint"] for r in got if r["doc_id"] in (105,)}
    assert same <= {r["fingerprint"] for r in got if r["doc_id"] == 106}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert spotsigs.fingerprints(empty).count() == 0


def spot_set(text):
    """The signatures as tuples, in plain Python."""
    import regex
    import xxhash

    common = {w for ws in spotsigs.ANCHORS.values() for w in ws}
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split()
    content = [w for w in words if w not in common]
    if not content:
        return {tuple(words) if words else text} if text else set()
    out = {("", *content[:2])}
    k = 0
    for w in words:
        if w in common:
            out |= {(w, *content[k : k + 2])} if len(content) >= k + 2 else set()
        else:
            k += 1
            drawn = xxhash.xxh64_intdigest(w.encode(), 42)
            if (drawn - (drawn >> 63 << 64)) % spotsigs.DRAWN == 0 and len(content) >= k + 2:
                out.add((w, *content[k : k + 2]))
    return out


def test_spot_likeness(docs):
    def likeness(a, b):
        x, y = spot_set(a), spot_set(b)
        return round(len(x & y) / len(x | y), 9) if x or y else 1.0

    rows = sorted(((d, t or "") for d, t in texts()), key=lambda x: (x[0] if x[0] is not None else -1, x[1]), reverse=True)
    want = Counter()
    for i, (d, t) in enumerate(rows):
        nxt, k = rows[(i + 1) % len(rows)][1], len(t) // 3
        want[d, len(t), likeness(t, t[: len(t) - k] + nxt[:k]), likeness(t, nxt)] += 1
    got = Counter((r["doc_id"], r["n_chars"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in spotsigs.fingerprints(docs).collect())
    assert got == want


def test_spots_of_any_ids_and_long_texts(spark):
    run = "the " * 1_000_000
    given = [(-(1 << 63), "the cat sat on the mat"), ((1 << 63) - 1, "a dog ran"), (0, run + "cat dog"), (5, "cat dog " + run), (None, "x"), (None, "y of z"), (7, " ".join(f"w{i}" for i in range(200_000)))]
    got = {(r["doc_id"], r["n_chars"]): r for r in spotsigs.fingerprints(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    rows = sorted(given, key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    for i, (d, t) in enumerate(rows):
        nxt, k = rows[(i + 1) % len(rows)][1], len(t) // 3
        assert got[d, len(t)]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    assert got[0, len(run) + 7]["fingerprint"].startswith("2:") and got[7, len(given[-1][1])]["near_edited"] > 0.5


def test_spot_ranges_follow_the_ids(spark):
    """Ids far apart, null ids and repeated ids spread over the ranges; the ranges keep the order."""
    given = [(i * i, f"{i} of a") for i in range(800)] + [(1 << 62, "far")] + [(None, f"n{i}") for i in range(800)] + [(3, f"{i:04} b") for i in range(800)]
    keys = spark.createDataFrame(given, "doc_id long, text string").select("*", spotsigs.sort_key(F.col("doc_id"), F.col("text")).alias("key"))
    bounds = spotsigs._bounds(keys.select("key"), len(given), 40)
    rows = [(r["doc_id"], r["text"], r["b"]) for r in keys.withColumn("b", spotsigs._range_of(F.col("key"), bounds)).collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    places = [r[2] for r in rows]
    assert places == sorted(places) and max(Counter(places).values()) < 300
    assert len({r[2] for r in rows if r[0] is None}) > 5 and len({r[2] for r in rows if r[0] == 3}) > 5


def test_spot_pairs_are_all_pairs(docs):
    sets = {}
    for r in docs.filter("doc_id is not null").select("doc_id", spotsigs.chains(F.coalesce("text", F.lit(""))).alias("s")).collect():
        s = frozenset(r["s"])
        sets[s] = min(r["doc_id"], sets.get(s, r["doc_id"]))
    want = {(max(i, j), min(i, j)) for a, i in sets.items() for b, j in sets.items() if i != j and len(a & b) >= 0.5 * len(a | b) > 0}
    _, pairs = spotsigs.near_pairs(docs.filter("doc_id is not null"), 0.5)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want


def test_quality(spark, docs, empty):
    got = Counter()
    for r in quality.text_stats(docs, keep=["doc_id"]).collect():
        got[r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] += 1
    want = Counter()
    import re

    for d, t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(grams)
        cover = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)] += 1
    assert got == want
    assert quality.judge(empty, [], ["doc_id"]).count() == 0
    r = np.random.default_rng(0)
    x = r.random((900, 2))
    rules = quality.learn_rules(x, (x[:, 0] > 0.7) & (x[:, 1] <= 0.5), ["a", "b"], np.arange(900) % 3 > 0)
    fresh = r.random((900, 2))
    judged = spark.createDataFrame(fresh.tolist(), "a double, b double").select("a", "b", quality.rules_column(rules).alias("k")).collect()
    assert sum(q["k"] == (not (q["a"] > 0.7 and q["b"] <= 0.5)) for q in judged) > 870


def test_chat(spark):
    rows = [(1, 0, "user", "a\\b <| \\| x"), (1, 1, "assistant", None), (2, 0, "assistant", "<|im_end|>\n"), (2, 0, "assistant", "<|im_end|>\n"), (None, None, None, None), (3, 5, "x\ny\\", "z" * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    said = lambda k: "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == k)
    assert all(got[k]["turns_sha256"] == hashlib.sha256(said(k).encode()).hexdigest() for k in got)
    assert got[1]["valid"] and not got[2]["valid"] and got[2]["loss_chars"] == 22 and got[None]["n_turns"] == 1


def test_chat_with_long_roles(spark):
    given = [(1, 0, "r\\" * 50_000 + "\n" + "q" * 50_000, "hi"), (1, 1, "assistant", "yo"), (2, 0, "\\" * 100_001 + "\n", "z" * 1_000_000)]
    df = spark.createDataFrame([(*x, 1) for x in given], "conv_id long, turn long, role string, text string, _turns int")
    got = {r["conv_id"]: r["turns_sha256"] for r in chat.digests(chat.format_turns(df)).collect()}
    said = lambda k: "".join(f"{r}\n{t}\n" for c, _, r, t in given if c == k)
    assert got == {k: hashlib.sha256(said(k).encode()).hexdigest() for k in (1, 2)}
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    a, b = registry.QUERIES[name](spark, D).toPandas(), con.execute(registry.SQL[name]).df()
    rows = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).where(x.notna(), None).values.tolist()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("bound", [1, simhash.MAX_BUCKET])
def test_simhash(docs, empty, bound):
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(30)]
    fps = sorted({f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in fps for _ in range(8)} | set(fps))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    nodes = docs.sparkSession.createDataFrame(signed, "node long, fp long")
    up = list(range(len(fps)))
    for i, f in enumerate(fps):
        for j in range(i):
            if (f ^ fps[j]).bit_count() <= 2:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    got = {x["node"]: x["component"] for x in simhash.components(simhash.links(nodes, max_bucket=bound)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == up
    if bound == 1:
        out = simhash.near_duplicates(docs).collect()
        assert len(out) == docs.count() and {x["component_id"] for x in out if x["doc_id"] in (100, 101, 102)} == {100}
        assert simhash.near_duplicates(empty).count() == 0
        assert simhash.keep_one(docs.sparkSession, docs, D).columns == docs.columns


@pytest.mark.parametrize("bound", [1, simhash.MAX_BUCKET])
def test_near_copies_are_all_pairs(spark, bound):
    r = random.Random(5)
    given = []
    for _ in range(12):
        w = [f"w{r.randrange(4000)}" for _ in range(r.randrange(6, 90))]
        given += [" ".join(w)] * 2
        for _ in range(7):
            at = r.randrange(len(w))
            w = [*w[:at], "new", *w[at + r.randrange(2) :]] if r.random() < 0.7 else w[r.randrange(4) :]
            given.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in map(str.split, given)]
    up = list(range(len(given)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if k in (a, b) else k for k in up]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), bound).collect()}
    assert [got[i] for i in range(len(given))] == up and len(given) - len(set(up)) > 40


def test_packing(docs, empty):
    import zlib

    e = bpe.encoder()
    rows = packing.pack_documents(docs, packing.Limits(64, 8, 64)).collect()
    seqs, by_doc = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    want = Counter()
    for d, t in texts():
        want[d, np.append(np.frombuffer(e.encode(t), "<u4"), packing.END_ID).astype("<u4").tobytes()] += 1
    for (d, ids), n in want.items():  # each id of each row lies in exactly one piece
        size = len(ids) // 4
        pieces = Counter(p for p in by_doc[d, size] if zlib.crc32(ids[4 * p[0] : 4 * (p[0] + p[1])]) == p[2])
        cover = Counter(i for (a, k, _), c in pieces.items() for i in list(range(a, a + k)) * c)
        assert set(cover) == set(range(size)) and min(cover.values()) >= n
    assert sum(size * n for (_, ids), n in want.items() for size in [len(ids) // 4]) == sum(r["length"] for r in rows)
    padding = 0
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0] + [r["length"] for r in s[:-1]]).tolist()
        n = sum(r["length"] for r in s)
        assert n <= 64 and len(s) <= 8 and sum(r["loss_tokens"] for r in s) <= 64
        padding += 0 if n & (n - 1) == 0 else 64 - n
    assert padding < 0.02 * sum(r["length"] for r in rows)
    assert packing.pack_documents(empty).count() == 0


def test_packing_of_long_blanks(spark):
    e, ids = bpe.encoder(), packing.token_ids()
    for t in (" " * 2_000_000, "a" + "\n" * 1_000_000 + "b", "x " + " " * 600 + "\u2003y", "\x1c" * 2000 + "q", "<|endoftext|>" + " " * 700 + "<|endoftext|>" + "\t" * 800 + " z"):
        assert ids(t).tobytes() == e.encode(t)
    out = packing.pack_documents(spark.createDataFrame([(1, " " * 2_000_000), (2, "a" * 1_000_000)], "doc_id long, text string")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r["n"] == r["m"] > 1000 for r in out) and len(out) == 2


def test_packing_under_a_loss_limit(spark):
    """Prompts bear no loss, so the three limits bind at different examples."""
    r = random.Random(9)
    given = [(i, np.arange(n, dtype="<u4"), r.randrange(n + 1)) for i, n in enumerate(r.randrange(1, 300) for _ in range(400))]
    limits = packing.Limits(128, 6, 40)
    seqs = list(packing.pack(iter(given), limits))
    assert Counter(p.doc for s in seqs for p in s for _ in range(len(p.ids))) == {i: len(x) for i, x, _ in given}
    assert Counter(p.doc for s in seqs for p in s for _ in range(p.loss)) == {i: k for i, _, k in given if k}
    totals = [(sum(len(p.ids) for p in s), len(s), sum(p.loss for p in s)) for s in seqs]
    assert all(a <= 128 and b <= 6 and c <= 40 for a, b, c in totals)
    assert sum(c == 40 for _, _, c in totals) > 20 and sum(a == 128 for a, _, _ in totals) > 20 and sum(b == 6 for _, b, _ in totals) > 0


def test_urls(spark, monkeypatch):
    given = ["http://A.com/en/x?q", "https://x.example.com/en/7", "com/en/", None, "a://b://net/de/8", "http://example.net/de/8#f", "ftp://notcom/en/", "http://x.com:80/en/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)] + [(0, given[0], "h")], "page_id long, url string, host string")
    for words in (urls.MAX_FILTER_WORDS, 0):
        monkeypatch.setattr(urls, "MAX_FILTER_WORDS", words)
        got = sorted((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, urls.listed(spark, urls.RULES)).collect())
        assert [g[2:] for g in got if g[0] in (0, 1, 5)] == [("com/en/", "block")] * 2 + [("example.com/en/7", "allow"), ("example.net/de/8", "block")]
        assert all(g[2:] == (None, "allow") for g in got if g[0] in (2, 3, 4, 6, 7)) and len(got) == 9


def test_scores(docs, empty):
    net = pll.Network.fresh()
    ids = (np.arange(4000) * 7 % 1024).astype(np.int32)
    ctx = pll.contexts(ids, np.array([0, 100]), 1024)
    assert ctx[99].tolist() == [ids[97], ids[98], 1024, 1024] and ctx[100].tolist() == [1024, 1024, ids[101], ids[102]]
    before = pll.log_probs(net, ctx, ids).mean()
    for _ in range(8):
        pll.improve(net, ctx, ids)
    assert pll.log_probs(net, ctx, ids).mean() > before + 0.5
    flat = pll.log_probs(net, np.repeat(ctx[:1], 1024, axis=0), np.arange(1024, dtype=np.int32))
    assert abs(np.exp(flat.astype(np.float64)).sum() - 1) < 1e-3
    rows = pll.score(docs, *pll.train(docs)).collect()
    assert len(rows) == docs.count() and all(r["log_likelihood"] <= 0 for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] == 100} == {0}
    words, fresh = pll.train(empty)
    assert words == [] and pll.score(empty, words, fresh).count() == 0


def test_scores_of_words_that_share_an_id(spark):
    import math
    import zlib

    words = [f"w{i}" for i in range(pll.OWN)]
    one, two = next((a, b) for a in (f"x{i}" for i in range(999)) for b in (f"y{i}" for i in range(99)) if (zlib.crc32(a.encode()) - zlib.crc32(b.encode())) % pll.SHARED == 0)
    given = [(1, one), (2, two), (3, f"{two} {two}"), (4, two.upper()), (4, two.upper()), (None, one), (5, "w3"), (6, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_tokens"]): r["log_likelihood"] for r in pll.score(docs, words, pll.Network.fresh()).collect()}
    same = got[1, 1] - math.log(2 / 7)
    assert abs(same - got[2, 1] + math.log(5 / 7)) < 1e-5 and abs(got[4, 1] - got[2, 1]) < 1e-9 and got[None, 1] == got[1, 1] and got[6, 0] == 0
    assert abs(math.exp(got[1, 1]) + math.exp(got[2, 1]) - math.exp(same)) < 1e-5


def test_scores_train_on_every_place(spark, monkeypatch):
    words = [f"w{i}" for i in range(700)]
    docs = spark.createDataFrame([(0, " ".join(words[:333])), (1, " ".join(words[333:]))], "doc_id long, text string").coalesce(1)
    asked = []
    monkeypatch.setattr(pll, "train_round", lambda rows, net, turn, share=pll.SHARE: asked.append((turn, share)) or net)
    pll.train(docs)
    places = [k for turn, share in asked for k in range(turn % share, 700, share)]
    assert sorted(places) == list(range(700))


def test_stages_with_clashing_names(spark, docs):
    import corpus_pipeline

    names = ["n_words", "kept", "base_failed", "words", "_t", "_w", "_keep", "_id", "_d", "_b", "_c0", "_pid", "component_id", "n_removed", "a.b"]
    wide = docs.select("doc_id", "text", "lang", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for table in (wide, wide.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, D)
            rows = out.collect()
            assert out.columns == table.columns, name
            assert all(list(r)[3:] == list(range(len(names))) for r in rows) and (table is wide) == bool(rows)
        assert (table is wide) == bool(corpus_pipeline.STAGES[-1][1](spark, table, D).count())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            judged = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark, D).collect()}
            assert {r["doc_id"] for r in after.collect()} == {d for d, k in judged.items() if k}
        elif name == "simhash_near_dedup":
            firsts = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
            assert {r["doc_id"] for r in after.collect()} == firsts
        elif name == "suffix_array_dedup":
            lost = {r["doc_id"] for r in suffix.dedup_passages(docs).filter("n_removed = n_bytes and n_bytes > 0").collect()}
            assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in after.collect()} == lost
        if name != "packing":
            assert sorted(after.columns) == sorted(docs.columns)
        docs = after
    assert docs.count() > 0 and common.partitions_for(docs.select(F.lit("x").alias("text")), "text") == 8


def test_bpe_columns(docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, x in texts():
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())] += 1
    assert Counter(tuple(r) for r in bpe.encode_documents(docs).collect()) == want


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 1 << 16)
    made = []
    words = bpe._Words(lambda w: made.append(w) or w.encode())
    for i in range(5000):
        assert words[f"w{i}"] == f"w{i}".encode()
        assert len(words) + len(words.older) < 700
    assert words["x" * 9000] == b"x" * 9000 and "x" * 9000 not in words and words["w4999"] == b"w4999" and len(made) == 5001


def test_fingerprints_in_a_plain_loop(docs):
    import xxhash

    def plain(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]
        if not words:
            return 0
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in simhash.with_fingerprints(docs).collect())
    assert got == Counter((d, plain(t)) for d, t in texts())


def test_kept_one_of_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    given = [(1, long), (1, long), (2, long + " end"), (None, long), (None, long), (None, "other"), (3, None), (4, "")]
    rows = simhash.keep_one(spark, spark.createDataFrame([(*g, 7) for g in given], "doc_id long, text string, _h int"), D).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter([(1, long), (None, long), (None, "other"), (3, None)])


def test_verdicts(spark, docs):
    rules = [quality.Rule((("symbol_rate", ">", 0.2), ("word_len", "<=", 6.0)), 9, 1.0), quality.Rule((("words", "<=", 30.0),), 9, 1.0)]
    got = Counter((r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in quality.judge(docs, rules, ["doc_id"]).collect())
    want = Counter()
    for d, t in texts():
        w = (t or "").replace("\n", " ").split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(grams)
        cover = len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(8)})
        failed = len(w) < 20 or 100 * cover > 30 * len(w)
        symbols, size = sum(c in "#*$%&|<>" for c in t or ""), sum(map(len, w))
        bad = (symbols / max(len(w), 1) > 0.2 and size / max(len(w), 1) <= 6.0) or len(w) <= 30
        want[d, len(w), failed, not failed and not bad] += 1
    assert got == want and {k[3] for k in want} == {True, False}


def test_rules_do_not_depend_on_the_order_of_rows(spark):
    r = random.Random(8)
    rows = [(i % 300, " ".join(r.choice(["a", "b###", "word", "Upper"]) + str(r.randrange(50)) for _ in range(40))) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    fit = lambda x, parts: quality.fit_rules(spark.createDataFrame(x, "doc_id long, text string").repartition(parts), labels)
    assert fit(rows, 1) == fit(rows[::-1], 5)


def test_labels_by_enumeration():
    from itertools import product

    model = htmlcrf.default_model()
    for page in htmlcrf.labelled_pages(12, 5):
        blocks = [(b[0].replace("\x01", "") or "x", *b[1:]) for b in htmlcrf.blocks_of(page)][:9]
        emit = [[sum(model.weights.get(f, (0.0, 0.0))[y] for f in fs) for y in (0, 1)] for fs in htmlcrf.features_of(blocks)]
        score = lambda ys, e=emit: model.start[ys[0]] + sum(e[t][y] for t, y in enumerate(ys)) + sum(model.moves[a, b] for a, b in zip(ys, ys[1:], strict=False))
        best = max(product((0, 1), repeat=len(blocks)), key=score)
        assert score(model.labels(blocks)) == pytest.approx(score(best))


def test_html_of_any_depth_and_element(spark):
    model = htmlcrf.default_model()
    deep = "<article>" + "<div>" * 3000 + "<p>Deep words of the article stand here.</p>" + "</div>" * 3000 + "<p>And more words follow.</p></article><footer>c</footer>"
    kept = "<article><p>An <object data='x'>object with fallback words</object> and <math><mi>x</mi></math> and <svg><text>drawn</text></svg> stay.</p></article>"
    df = spark.createDataFrame([(1, "u", deep, "n"), (2, "u", kept, "n")], "page_id long, url string, html string, n_chars string")
    got = {r["page_id"]: r["text"] for r in htmlcrf.extract_text(df, model).collect()}
    assert got == {1: "Deep words of the article stand here. And more words follow.", 2: "An object with fallback words and x and drawn stay."}
    assert htmlcrf.extract_text(df.limit(0), model).count() == 0


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/" + "x" * 30_000, "h"), (2, None, "h"), (2, None, "h")], "page_id long, url string, rule string")
    none = urls.listed(spark, urls.RULES).limit(0)
    assert Counter((r["page_id"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, none).collect()) == {(1, None, "allow"): 1, (2, None, "allow"): 2}
    assert urls.judge_urls(df.limit(0), urls.listed(spark, urls.RULES)).count() == 0
    many = urls.listed(spark, [("block", "a.com", "/" + "x" * n) for n in range(1500)])
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(df, many).collect()}
    assert got == {1: ("a.com/" + "x" * 1499, "block"), 2: (None, "allow")}


def test_probability_of_a_token_directly():
    net = pll.Network.fresh(seed=3)
    ids = np.array([5, 900, 17, 17, 1023, 0], np.int32)
    ctx = pll.contexts(ids, np.array([0, 4]), 1024)
    got = pll.log_probs(net, ctx, ids)
    for i, y in enumerate(ids.tolist()):
        text = [5, 900, 17, 17] if i < 4 else [1023, 0]
        at = i if i < 4 else i - 4
        around = [text[at + k] if 0 <= at + k < len(text) else 1024 for k in (-2, -1, 1, 2)]
        h = np.append(np.maximum(sum(net.emb[x].astype(float) @ net.win[k] for k, x in enumerate(around)) + net.bias, 0), 1)
        soft = lambda z, j: z[j] - np.log(np.exp(z).sum())
        assert got[i] == pytest.approx(soft(h @ net.cls, y // pll.CLASS) + soft(h @ net.wrd[y // pll.CLASS], y % pll.CLASS), abs=1e-4)


def test_steps_follow_the_gradient(monkeypatch):
    """The first step of Adam goes against the sign of the gradient, here taken by differences."""
    net = pll.Network.fresh(seed=4)
    r = np.random.default_rng(5)
    ids = r.integers(0, 1024, 40).astype(np.int32)
    ctx = pll.contexts(ids, np.array([0]), 1024)
    before = [a.copy() for a in net.arrays()]
    loss = lambda: -pll.log_probs(net, ctx, ids).astype(np.float64).mean()
    slopes = []
    for a in net.arrays():
        flat = a.reshape(-1)
        for i in r.integers(0, len(flat), 60).tolist():
            old, h = flat[i], np.float32(2e-2)
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            slopes.append((up - loss()) / (2 * float(h)))
            flat[i] = old
    pll.improve(net, ctx, ids)
    r = np.random.default_rng(5)
    r.integers(0, 1024, 40)
    moved = [(x.reshape(-1) - y.reshape(-1))[i] for x, y in zip(net.arrays(), before, strict=True) for i in r.integers(0, x.size, 60).tolist()]
    clear = [(s, m) for s, m in zip(slopes, moved, strict=True) if abs(s) > 2e-4]
    assert len(clear) > 30 and sum(s * m < 0 for s, m in clear) >= 0.95 * len(clear)


def test_pipeline_goes_on_where_it_ended(spark, monkeypatch):
    import corpus_pipeline

    whole = sorted(map(tuple, corpus_pipeline.run(spark, D).collect()))
    calls = []
    stages = [(n, lambda s, d, f, n=n, fn=fn: calls.append(n) or fn(s, d, f)) for n, fn in corpus_pipeline.STAGES]

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:2], (stages[2][0], fails), stages[3]])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, D, keep="again")
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    again = sorted(map(tuple, corpus_pipeline.run(spark, D, keep="again").collect()))
    assert calls == [n for n, _ in stages] and [r[:5] for r in again] == [r[:5] for r in whole]


def test_near_copies_meet_by_simhash_first(spark):
    import xxhash

    w = [f"w{i}" for i in range(300)]
    given = [" ".join(w), " ".join([*w, "end"]), " ".join(reversed(w))]
    rows = {r["doc_id"]: r for r in simhash.with_sets(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")).collect()}
    for i, t in enumerate(given):
        x = t.split()
        hs = {xxhash.xxh64_intdigest(" ".join(x[k : k + 5]).encode(), 42) for k in range(len(x) - 4)}
        assert rows[i]["sim"] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    nodes = spark.createDataFrame([(5, 0b0, 1), (6, 0b11, 2), (7, 0b1111, 3), (4, 0b11, 4), (9, 0xFF00, 5)], "fp long, sim long, node long")
    assert {(r["a"], r["b"]) for r in simhash._by_simhash(nodes, 64).collect()} == {(5, 4), (6, 4), (7, 4)}


def test_unlike_sets_that_share_rare_words_are_not_fetched(spark, monkeypatch):
    """Parities tell unlike sets apart, whatever their sizes, and never near ones; links are those of all pairs."""
    rng = np.random.default_rng(7)
    for n in (1, 3, 60, 65, 520, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64)).view(np.uint64)
        for cut in (0, 1, n // 9, n // 2, n):
            y = np.unique(np.concatenate([x[cut:], rng.integers(0, 1 << 63, cut // 3, dtype=np.int64).view(np.uint64)]))
            apart = simhash._unlike(simhash._parities(x), simhash._parities(y))
            assert apart <= len(np.setxor1d(x, y)) and (apart - len(np.setxor1d(x, y))) % 2 == 0
    shared, word = [f"common{i}" for i in range(12)], lambda i, k: [f"w{i}x{j}" for j in range(k)]
    given = [" ".join(shared + word(i, 14 + i % 5)) for i in range(12)]
    given += [" ".join(shared + word(3, 17)) + " end", " ".join(shared + word(40, 120)), " ".join(shared + word(40, 120)) + " last words"]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    asked, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *a: (asked.append(pairs.count()), verified(pairs, *a))[1])
    for bound in (64, 2):
        asked.clear()
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, bound).collect()}
        assert got == {i: {12: 3, 14: 13}.get(i, i) for i in range(len(given))}
        assert sum(asked) <= 4, asked


def test_components_of_few_edges_take_few_tasks(spark, monkeypatch):
    from refloom.llm import components

    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (95, 100)], "a long, b long").repartition(7)
    for most in (1 << 16, 5):
        monkeypatch.setattr(components, "TASK_EDGES", most)
        parts, cut = [], components.cut_lineage
        monkeypatch.setattr(components, "cut_lineage", lambda df, cut=cut, parts=parts: (parts.append(df.rdd.getNumPartitions()), cut(df))[1])
        got = {r["node"]: r["component"] for r in components.components(edges).collect()}
        monkeypatch.setattr(components, "cut_lineage", cut)
        assert got == {i: 0 for i in range(41)} | {i: 90 for i in (90, 95, 100)}
        assert most == 5 or set(parts[1:]) == {1}, parts
