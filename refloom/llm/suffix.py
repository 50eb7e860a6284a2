"""Suffix-array deduplication of byte passages over a whole collection.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts in a document with a smaller id. Equal strings of
that width have the same least anchor (the smallest hash of the ``ANCHOR`` byte strings in them), so the runs of starts
with one anchor, called pieces, can be dealt out by the anchor and no match is lost.

0. Anchors in very many different contexts, such as a line of 30 bytes that many documents have, would bring all of
   these to one task. A sample of the documents names them, and their strings are dealt out by 43 bytes instead, by all 50
   where these are as frequent. Equal strings still meet, and only they need to.
1. Every task cuts its documents into pieces of at most ``RUN`` starts and keeps, of equal pieces, those of the least
   document; the others are marked at once. Hashes find them, their bytes decide. Of an anchor with many pieces, in
   several documents already, only two go on to step 2.
2. By anchor, those in more than one document over all tasks are left.
3. Only their pieces are read from the documents, equal ones of a document once, and dealt out by anchor again. There
   pieces of equal bytes are marked but for the least document's. Where several documents are left, the collection
   transform and its common prefixes are built column by column (``bwt``); suffixes that share ``WIDTH`` bytes form a
   group, and those whose document is not the group's least are marked.
4. Marks meet their documents, which lose the covered bytes.

Between steps travel arrays in compressed rows, one for each task and target; the number of targets follows the bytes of
the input. The driver gets the names of the anchors of step 0, 8 bytes for each 8,192 pieces or so at most.

Defined cases: texts of any length are read whole, in stretches. Null and empty texts, and texts shorter than the width, lose nothing. Rows that repeat a doc_id lose
nothing to each other, as no id is smaller. Rows with a null doc_id stay whole and take nothing from others. An empty
table gives no rows. Columns of the input are carried under own names, so they cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import least_owner
from .common import freed, give_back, partitions_for, read_table

WIDTH, ANCHOR, RUN = 50, 20, 31
#: One document in so many, by hash of its id, is asked for anchors in many contexts; with so many in the sample an anchor
#: is refined. The sample only steers how strings are dealt out, never which strings are compared.
SAMPLE, MANY = 128, 64
#: Offsets of a refined anchor in its strings that share one key, and the bytes that these strings have in common.
STRETCH = 8
SHARED = WIDTH + 1 - STRETCH
#: A task asks for the pieces of an anchor with so many of them itself, if they are of several documents.
OWN_ASK, ASKED = 8, 128
#: Bytes of a text that are hashed at a time, pieces that a task holds, and string bytes in one transform.
SEGMENT, HELD, COLLECTION = 1 << 20, 1 << 21, 1 << 20
#: Bytes of short texts that are hashed at a time, and ranges of anchors that are sorted one after another. They bound a
#: task's memory and steer nothing else.
HASHED, RANGES = 1 << 18, 8
PIECES, MARKS, REQUESTS, STRINGS = 0, 1, 2, 3
BLOB = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])
BLOB_SQL = "kind int, part int, blob binary"

_u = np.uint64
_LETTERS = np.random.default_rng(20).integers(1 << 62, (1 << 63) - 1, 256, dtype=np.int64).astype(_u) * _u(2) + _u(1)
_MUL = [_u(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
#: For the blocks of a piece; none is used inside a block, where a product would be the same in another order.
_BLOCK_MUL = [_u(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]

_LONG_MUL = [_u(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(32))) * _MUL[3]
    return x ^ (x >> _u(29))


def refined(v: np.ndarray, at: np.ndarray, hot: np.ndarray, marks: np.ndarray, h16: np.ndarray) -> np.ndarray:
    """Longer anchors for the strings that start in at and whose anchor v is in hot: the bytes that strings with about the
    same offset of the anchor share; the whole string where these are in hot, too."""
    some = np.flatnonzero(np.isin(v, hot))
    if not len(some):
        return v
    v = v.copy()
    for i in range(0, len(some), 1 << 13):
        k = some[i : i + (1 << 13)]
        s = at[k]
        offset = (marks[s[:, None] + np.arange(WIDTH - ANCHOR + 1)] == v[k][:, None]).argmax(axis=1)
        a = s + offset % STRETCH
        longer = _mix(h16[a] * _LONG_MUL[0] + h16[a + 16] * _LONG_MUL[1] + h16[a + SHARED - 16] * _LONG_MUL[2] + (offset // STRETCH).astype(_u))
        whole = _mix(h16[s] * _LONG_MUL[2] + h16[s + 16] * _LONG_MUL[0] + h16[s + 32] * _LONG_MUL[3] + h16[s + WIDTH - 16] * _LONG_MUL[1])
        v[k] = np.where(np.isin(longer, hot), whole, longer)
    return v


def cut(segments: list[np.ndarray], hot: np.ndarray = np.empty(0, np.uint64)) -> tuple[np.ndarray, ...]:
    """(segment, start, n, h, x) of the pieces: n starts from start share the anchor h; x hashes all their bytes."""
    lens = np.array([len(s) for s in segments], np.int64)
    offs = np.concatenate([[0], np.cumsum(lens)])
    buf = np.concatenate(segments)
    if len(buf) < WIDTH:
        e = np.empty(0, np.int64)
        return e, e, e, e.astype(_u), e.astype(_u)
    h1 = _LETTERS[buf]
    h2 = h1[:-1] * _MUL[0] + h1[1:]
    h4 = h2[:-2] * _MUL[1] + h2[2:]
    h8 = h4[:-4] * _MUL[2] + h4[4:]
    h16 = h8[:-8] * _MUL[4] + h8[8:]
    marks = _mix(h16[: len(buf) - ANCHOR + 1] * _MUL[5] + h4[16 : 16 + len(buf) - ANCHOR + 1])
    del h1, h2, h4, h8
    least = marks
    width, k = WIDTH - ANCHOR + 1, 1
    while k * 2 <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if width > k:
        least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    edge = np.zeros(len(buf) + 1, np.int8)
    full = lens >= WIDTH
    edge[offs[:-1][full]] += 1
    edge[offs[1:][full] - WIDTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[: len(least)], dtype=np.int8))
    v = least[at]
    if len(hot):
        v = refined(v, at, hot, marks, h16)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (v[1:] != v[:-1])
    heads = np.flatnonzero(new)
    if not len(heads):
        e = np.empty(0, np.int64)
        return e, e, e, e.astype(_u), e.astype(_u)
    run = np.diff(np.append(heads, len(at)))
    new |= (np.arange(len(at)) - np.repeat(heads, run)) % RUN == 0
    heads = np.flatnonzero(new)
    s, n = at[heads], np.diff(np.append(heads, len(at)))
    size = n + WIDTH - 1
    x = _mix(h16[s] * _BLOCK_MUL[0] + h16[s + 16] * _BLOCK_MUL[1] + h16[s + 32] * _BLOCK_MUL[2] + h16[s + size - 16] * _BLOCK_MUL[3] + h16[s + size - 32] * _BLOCK_MUL[4] + size.astype(_u))
    seg = np.searchsorted(offs, s, side="right") - 1
    return seg, s - offs[seg], n, v[heads], x


def segments_of(body: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """A long text as stretches that overlap by what a string at their edge needs."""
    a = np.frombuffer(body, np.uint8)
    for i in range(0, max(len(a) - WIDTH + 1, 0), SEGMENT):
        yield i, a[i : i + SEGMENT + WIDTH - 1]


def dump(t: dict[str, np.ndarray], extra: bytes = b"") -> bytes:
    """Arrays to compressed bytes: small differences for ids and places, six bytes of h, five of x, where they are there."""
    import zstandard

    n = len(t["doc"])
    doc, start = np.diff(t["doc"], prepend=0), np.diff(t["start"], prepend=0)
    parts = [np.array([n, len(extra)], np.int64).tobytes(), doc.view(np.uint8).reshape(-1, 8).T.tobytes(), t["tag"].view(np.uint8).reshape(-1, 4).T.tobytes(), start.view(np.uint8).reshape(-1, 8).T.tobytes(), t["n"].tobytes()]
    for name, size in (("h", 6), ("x", 5)):
        if name in t:
            parts.append(np.ascontiguousarray(t[name]).view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes())
    return zstandard.compress(b"".join(parts) + extra, 1)


def load(blob: bytes, hashes: str = "") -> tuple[dict[str, np.ndarray], bytes]:
    import zstandard

    raw = zstandard.decompress(blob)
    n, more = np.frombuffer(raw[:16], np.int64)
    at = 16

    def planes(size: int, kind) -> np.ndarray:
        nonlocal at
        out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        at += n * size
        return out.view(kind).ravel()

    t = {"doc": np.cumsum(planes(8, np.int64)), "tag": planes(4, np.uint32), "start": np.cumsum(planes(8, np.int64)), "n": planes(1, np.uint8)}
    t |= {k: planes({"h": 6, "x": 5}[k], _u) for k in hashes}
    return t, raw[at : at + int(more)]


def pick(t: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in t.items()}


def join(tables: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([t[k] for t in tables]) for k in tables[0]}


def dealt(t: dict[str, np.ndarray], part: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """A compressed row for each part that has entries, in the order of documents and places."""
    part = part.astype(np.int32)
    for r in range(RANGES):
        order = np.flatnonzero(part % RANGES == r).astype(np.int32)
        if not len(order):
            continue
        order = order[np.lexsort((*(t[k][order] for k in ("start", "tag", "doc")), part[order]))]
        p = part[order]
        heads = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        for a, b in zip(heads, np.append(heads[1:], len(p)), strict=True):
            yield kind, int(p[a]), dump(pick(t, order[a:b]))


def batch(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(BLOB)], schema=BLOB)


def batches_of(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, as they come."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size >= SEGMENT:
            yield from batch(held).to_batches()
            held, size = [], 0
    if held:
        yield from batch(held).to_batches()


def marks_only(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: t[k] for k in ("doc", "tag", "start", "n")}


def least_of_equal(t: dict[str, np.ndarray], *keys: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of a group of equal keys, least document of the group), sorted by keys, then document."""
    order = np.lexsort((t["doc"], *[t[k] for k in reversed(keys)]))
    head = np.ones(len(order), bool)
    head[1:] = np.any([t[k][order][1:] != t[k][order][:-1] for k in keys], axis=0)
    low = t["doc"][order][np.flatnonzero(head)][np.cumsum(head) - 1]
    return order, head, low


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 1 << 12) -> np.ndarray:
    """For each i, whether the size[i] bytes from a[i] and from b[i] are equal; each has WIDTH at least."""
    out = np.empty(len(a), bool)
    for i in range(0, len(a), step):
        x, y, last = a[i : i + step, None], b[i : i + step, None], size[i : i + step, None] - 1
        k = np.minimum(np.arange(last.max(initial=0) + 1), last)
        out[i : i + step] = (text[x + k] == text[y + k]).all(axis=1)
    return out


def cut_documents(parts: int, hot: np.ndarray = np.empty(0, np.uint64)):
    def flush(held: list[dict[str, np.ndarray]], texts: bytearray, stretches: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        doc, tag, shift = (np.array(v, kind) for v, kind in zip(zip(*stretches, strict=True), (np.int64, np.uint32, np.int64), strict=True))
        t = {k: np.concatenate([x.pop(k) for x in held]) for k in list(held[0])}
        held.clear()
        text = np.frombuffer(texts, np.uint8)
        t["h"] &= _u((1 << 48) - 1)
        copied, single = [], []
        # equal pieces have equal anchors: a range of these at a time, in their order
        part = (t["h"] * _u(RANGES) >> _u(48)).astype(np.uint8)
        for r in range(RANGES):
            rows = np.flatnonzero(part == r).astype(np.int32)
            if not len(rows):
                continue
            own = pick(t, rows) | {"doc": doc[t["stretch"][rows]]}
            order, head, low = least_of_equal(own, "h", "x")
            later = own["doc"][order] > low
            first, which = order[np.flatnonzero(head)][np.cumsum(head) - 1], np.flatnonzero(later)
            a, b = first[which], order[which]
            later[which] = own["n"][a] == own["n"][b]
            which, a, b = (v[later[which]] for v in (which, a, b))
            later[which] = same_bytes(text, own["at"][a], own["at"][b], own["n"][b].astype(np.int64) + WIDTH - 1)
            copied.append(rows[order[later]])
            single.append(rows[order[~later]])
            del rows, own, order, head, low, later, first, which, a, b
        del text, part, t["x"]
        texts.clear()
        give_back()

        def named(at: np.ndarray) -> dict[str, np.ndarray]:
            of = t["stretch"][at]
            return {"doc": doc[of], "tag": tag[of], "start": t["at"][at] + shift[of], "n": t["n"][at]}

        copies = named(np.concatenate(copied))
        yield from batches_of(dealt(copies, copies["doc"] % parts, MARKS))
        del copies, copied
        give_back()
        single = np.concatenate(single)
        # a column at a time, so that none is held twice
        own = {"h": t.pop("h")[single], "n": t.pop("n")[single]}
        of, own["start"] = t.pop("stretch")[single], t.pop("at")[single].astype(np.int64)
        del t, single
        own |= {"doc": doc[of], "tag": tag[of]}
        own["start"] += shift[of]
        del of
        give_back()
        # own is in the order of h: of anchors with many pieces of several documents only the outer two go to the anchor
        heads = np.flatnonzero(np.diff(own["h"], prepend=~own["h"][:1]))
        size = np.diff(np.append(heads, len(own["h"])))
        many = size >= OWN_ASK
        if many.any():
            low, high = np.minimum.reduceat(own["doc"], heads), np.maximum.reduceat(own["doc"], heads)
            many &= low != high
            group = np.repeat(np.arange(len(heads), dtype=np.int32), size)
            ask = pick(own, np.flatnonzero(many[group]))
            yield from batches_of(dealt(ask, ask["doc"] % parts, REQUESTS))
            rest = ~many[group]
            for d in (low, high):
                outer = np.flatnonzero(many[group] & (own["doc"] == d[group]))
                rest[outer[np.unique(group[outer], return_index=True)[1]]] = True
            own["n"] = own["n"] | np.where(many[group], ASKED, 0).astype(np.uint8)
            own = pick(own, np.flatnonzero(rest))
            del group, ask, rest, outer, low, high
        del heads, size, many
        yield from batches_of(dealt(own, _bucket(own["h"], parts), PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, waiting, size = [], 0, [], 0
        texts, stretches = bytearray(), []  # the bytes of what is held; document, tag and what to add to a place in the bytes

        def hash_waiting() -> dict[str, np.ndarray]:
            segments = [w[3] for w in waiting]
            seg, start, k, h, x = cut(segments, hot)
            lens = np.array([len(s) for s in segments], np.int64)
            at = len(texts) + np.cumsum(lens) - lens
            t = {"stretch": (len(stretches) + seg).astype(np.int32), "at": (at[seg] + start).astype(np.uint32), "n": k.astype(np.uint8), "h": h, "x": x}
            stretches.extend((w[0], w[1], w[2] - a) for w, a in zip(waiting, at.tolist(), strict=True))
            for s in segments:
                texts.extend(s.data)
            return t

        for b in batches:
            for doc, body in zip(b.column("_d").to_pylist(), b.column("_b"), strict=True):
                body = body.as_buffer()
                tag = zlib.crc32(body)
                for i, s in segments_of(body):
                    waiting.append((doc, tag, i, s))
                    size += len(s)
                    if size >= HASHED:
                        held.append(hash_waiting())
                        n += len(held[-1]["n"])
                        waiting, size = [], 0
                        if n >= HELD:
                            yield from flush(held, texts, stretches)
                            n, texts = 0, bytearray()
                            stretches.clear()
                            give_back()
        if waiting:
            held.append(hash_waiting())
            waiting.clear()
        if held:
            yield from flush(held, texts, stretches)
        give_back()

    return run


def _bucket(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h * _MUL[0]) >> _u(33)).astype(np.int64) % parts


def resolve(parts: int):
    """By anchor: ask for the texts of anchors that several documents have."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        rows = [(k, p, b) for k, p, b in zip(kinds, table.column("part").to_pylist(), blobs, strict=True) if k != PIECES]
        pieces = [load(b, "h")[0] for k, b in zip(kinds, blobs, strict=True) if k == PIECES]
        if pieces:
            t = join(pieces)
            t = pick(t, np.argsort(t["h"], kind="stable"))
            first = np.ones(len(t["h"]), bool)
            first[1:] = t["h"][1:] != t["h"][:-1]
            heads = np.flatnonzero(first)
            if len(heads):
                low, high = np.minimum.reduceat(t["doc"], heads), np.maximum.reduceat(t["doc"], heads)
                several = (low != high)[np.cumsum(first) - 1]
                ask = pick(t, several & (t["n"] < ASKED))
                rows += dealt(ask, ask["doc"] % parts, REQUESTS)
        return batch(rows)

    return lambda table: freed(run(table))


def group_bodies(docs: pa.Table) -> tuple[dict[tuple[int, int], int], list]:
    bodies = [b.as_buffer() for b in docs.column("_b")]
    keys = {}
    for i, (d, b) in enumerate(zip(docs.column("_d").to_pylist(), bodies, strict=True)):
        keys.setdefault((d, zlib.crc32(b)), i)
    return keys, bodies


def answer(parts: int):
    """By document: the texts that were asked for."""

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        rows, asked = [], []
        for k, p, b in zip(*[table.column(c).to_pylist() for c in ("kind", "part", "blob")], strict=True):
            if k == MARKS:
                rows.append((k, p, b))
            else:
                asked.append(load(b, "h")[0])
        if asked:
            t = join(asked)
            keys, bodies = group_bodies(docs)
            views = [memoryview(b) for b in bodies]
            bucket = _bucket(t["h"], parts)
            order = np.lexsort((t["start"], t["tag"], t["doc"], bucket))
            t, bucket = pick(t, order), bucket[order]
            text = [bytes(views[keys[d, g]][s : s + n + WIDTH - 1]) for d, g, s, n in zip(t["doc"].tolist(), t["tag"].tolist(), t["start"].tolist(), t["n"].tolist(), strict=True)]
            # of equal pieces in one document the first brings the text; the others, with the high bit set, follow it by x
            lead: dict[tuple[int, bytes], int] = {}
            t["x"] = np.array([lead.setdefault((d, b), i) for i, (d, b) in enumerate(zip(t["doc"].tolist(), text, strict=True))], _u)
            for i in np.flatnonzero(t["x"] != np.arange(len(text), dtype=_u)).tolist():
                text[i] = b""
                t["n"][i] |= np.uint8(128)
            heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for a, b in zip(heads, np.append(heads[1:], len(bucket)), strict=True):
                rows.append((STRINGS, int(bucket[a]), dump(pick(t, np.arange(a, b)), b"".join(text[a:b]))))
        return batch(rows)

    return lambda docs, table: freed(run(docs, table))


def transform(parts: int):
    """By anchor: marks for equal texts, then the collection transform of the others; marks for strings that a smaller
    document has too."""

    def run(table: pa.Table) -> pa.Table:
        rows, tables, texts = [], [], []
        for k, p, b in zip(*[table.column(c).to_pylist() for c in ("kind", "part", "blob")], strict=True):
            if k == MARKS:
                rows.append((k, p, b))
            else:
                t, text = load(b, "hx")
                tables.append(t)
                texts.append(np.frombuffer(text, np.uint8))
        if tables:
            t = join(tables)
            tables.clear()
            text = np.concatenate(texts)
            texts.clear()
            leads = (t["n"] & 128) == 0
            t["n"] &= np.uint8(127)
            size = np.where(leads, t["n"].astype(np.int64) + WIDTH - 1, 0)
            t["at"] = np.cumsum(size) - size
            t["lead"] = leads
            order = np.lexsort((~leads, t["doc"], t["x"], t["h"]))
            t = pick(t, order)
            lead = np.flatnonzero(t["lead"])
            docs, at = t["doc"][lead].tolist(), t["at"][lead]
            raw, low = text.data, {}
            said = [bytes(raw[a:e]) for a, e in zip(at.tolist(), (at + t["n"][lead].astype(np.int64) + WIDTH - 1).tolist(), strict=True)]
            for d, b in zip(docs, said, strict=True):
                low[b] = min(d, low.get(b, d))
            owner_of = np.cumsum(t["lead"]) - 1
            later = np.array([d > low[b] for d, b in zip(docs, said, strict=True)], bool)[owner_of]
            del said, low, docs, raw
            found = [marks_only(pick(t, later))]
            t = pick(t, ~later)
            heads = np.flatnonzero(np.concatenate([[True], t["h"][1:] != t["h"][:-1]]))
            several = np.minimum.reduceat(t["doc"], heads) != np.maximum.reduceat(t["doc"], heads)
            t = pick(t, np.repeat(several, np.diff(np.append(heads, len(t["h"])))))
            lead = np.flatnonzero(t["lead"])
            owner_of = np.cumsum(t["lead"]) - 1  # followers stand behind the piece that brought their text
            h = t["h"][lead]
            size = t["n"][lead].astype(np.int64) + WIDTH - 1
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            load_to = np.cumsum(size)
            a = 0
            bounds = np.append(heads[1:], len(lead)) if len(lead) else []
            flags, base = [], []
            for b in bounds:
                if b < len(lead) and load_to[b - 1] - (load_to[a - 1] if a else 0) < COLLECTION:
                    continue
                sel = lead[a:b]
                sizes = size[a:b]
                ends = np.cumsum(sizes)
                src = np.repeat(t["at"][sel] - (ends - sizes), sizes) + np.arange(ends[-1])
                docs = t["doc"][sel]
                least = least_owner(text[src], ends, docs, WIDTH)
                hit = least < np.repeat(docs, sizes)
                for i, (e, s) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                    flags.append(hit[e - s : e - WIDTH + 1])
                    base.append(a + i)
                a = b
            n_of = np.array([len(f) for f in flags], np.int64)
            if len(flags):
                flat = np.concatenate(flags)
                ptr = np.cumsum(n_of) - n_of
                any_hit = np.add.reduceat(flat, ptr) > 0
                member = np.flatnonzero(any_hit[owner_of])
                n = n_of[owner_of[member]]
                idx = np.repeat(ptr[owner_of[member]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                bits = flat[idx]
                off = np.arange(len(bits)) - np.repeat(np.cumsum(n) - n, n)
                who = np.repeat(member, n)
                on = np.flatnonzero(bits)
                head = np.ones(len(on), bool)
                head[1:] = (np.diff(on) != 1) | (who[on][1:] != who[on][:-1])
                hs = np.flatnonzero(head)
                if len(hs):
                    found.append({"doc": t["doc"][who[on[hs]]], "tag": t["tag"][who[on[hs]]], "start": t["start"][who[on[hs]]] + off[on[hs]], "n": np.diff(np.append(hs, len(on))).astype(np.uint8)})
            for m in found:
                rows += dealt(m, m["doc"] % parts, MARKS)
        return batch(rows)

    return lambda table: freed(run(table))


def covered(body_len: int, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    step = np.zeros(body_len + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n.astype(np.int64) + WIDTH - 1, -1)
    return np.cumsum(step[:-1]) > 0


def remove(others: list[str], with_text: bool):
    """By document: take out the covered bytes."""

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        loaded = [load(b)[0] for b in table.column("blob").to_pylist()]
        where: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if loaded:
            t = join(loaded)
            order = np.lexsort((t["tag"], t["doc"]))
            t = pick(t, order)
            head = np.ones(len(order), bool)
            head[1:] = (t["doc"][1:] != t["doc"][:-1]) | (t["tag"][1:] != t["tag"][:-1])
            heads = np.flatnonzero(head)
            for a, b in zip(heads, np.append(heads[1:], len(order)), strict=True):
                where[int(t["doc"][a]), int(t["tag"][a])] = (t["start"][a:b], t["n"][a:b])
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "text": []}
        for d, cell in zip(docs.column("_d").to_pylist(), docs.column("_b"), strict=True):
            body = cell.as_buffer()
            size, kept, removed, spans = len(body), body, 0, 0
            if (at := where.get((d, zlib.crc32(body)))) is not None:
                gone = covered(size, *at)
                removed = int(np.count_nonzero(gone))
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
            out["n_bytes"].append(size)
            out["n_removed"].append(removed)
            out["n_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["text"].append(bytes(kept).decode("utf-8", "ignore"))
        cols = {c: docs.column(c) for c in ["_d", *others]}
        cols |= {k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")} | {"kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        if with_text:
            cols["text"] = pa.array(out["text"], pa.string())
        return pa.table(cols)

    return lambda docs, table: freed(run(docs, table))


def _prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def anchors_in_many_contexts(docs: DataFrame) -> np.ndarray:
    """Anchors, and refined ones, with many different pieces, by a sample of the documents. docs: _d, _b."""
    some = docs.filter(F.pmod(F.xxhash64("_d"), F.lit(SAMPLE)) == 0)
    hot = np.empty(0, _u)
    for _ in range(2):

        def pieces(batches: Iterator[pa.RecordBatch], hot: np.ndarray = hot) -> Iterator[pa.RecordBatch]:
            def of(segments: list[np.ndarray]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)) for a in cut(segments, hot)[3:]], ["h", "x"])

            waiting, size = [], 0
            for b in batches:
                for body in b.column("_b"):
                    for _, s in segments_of(body.as_buffer()):
                        waiting.append(s)
                        size += len(s)
                        if size >= HASHED:
                            yield of(waiting)
                            waiting, size = [], 0
            if waiting:
                yield of(waiting)
            give_back()

        found = some.mapInArrow(pieces, "h long, x long").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MANY)
        more = np.array([r["h"] for r in found.select("h").collect()], np.int64).view(_u)
        hot = np.union1d(hot, more)
        if not len(more):
            break
    return hot


def _deal(found: DataFrame, parts: int, by: str = "part") -> DataFrame:
    """Each part is a partition of its own."""
    return found.repartitionById(parts, F.col(by))


def dedup_passages(docs: DataFrame, carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text also the text left, without characters that were cut
    apart. carry: columns of docs that come along, as _c0, _c1 and so on."""
    names = [f"_c{i}" for i, _ in enumerate(carry or [])]
    every = docs.select(F.col("doc_id").cast("long").alias("_d"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_b"), *[F.col("`" + c.replace("`", "``") + "`").alias(n) for n, c in zip(names, carry or [], strict=True)])
    parts = _prime_from(max(partitions_for(docs, "text"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    known = every.filter("_d is not null").withColumn("_pid", F.pmod(F.col("_d"), F.lit(parts)).cast("int"))
    slim = known.select("_pid", "_d", "_b")
    hot = anchors_in_many_contexts(known.select("_d", "_b"))
    found = known.select("_d", "_b").mapInArrow(cut_documents(parts, hot), BLOB_SQL)
    found = _deal(found, parts).groupBy("part").applyInArrow(resolve(parts), BLOB_SQL)
    held = _deal(slim, parts, "_pid")
    found = held.groupBy("_pid").cogroup(_deal(found, parts).groupBy("part")).applyInArrow(answer(parts), BLOB_SQL)
    found = _deal(found, parts).groupBy("part").applyInArrow(transform(parts), BLOB_SQL)
    right = _deal(known, parts, "_pid") if names else held
    schema = ", ".join(["_d long", *[f"{n} {every.schema[n].dataType.simpleString()}" for n in names], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *["text string"] * with_text])
    done = right.groupBy("_pid").cogroup(_deal(found, parts).groupBy("part")).applyInArrow(remove(names, with_text), schema)
    whole = every.filter("_d is null").select("_d", *names, F.octet_length("_b").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("_b", 256).alias("kept_sha256"), *[F.col("_b").cast("string").alias("text")] * with_text)
    return done.unionByName(whole).withColumnRenamed("_d", "doc_id")


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(read_table(spark, sf_dir, "documents"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the text that is left; documents of which nothing is left go."""
    names = docs.columns
    carry = [c for c in names if c not in ("doc_id", "text")]
    out = dedup_passages(docs, carry=carry, with_text=True).filter("n_removed < n_bytes or n_bytes = 0")
    back = {c: F.col(f"_c{i}") for i, c in enumerate(carry)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in back:
        back["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[back[c].alias(c) for c in names])
