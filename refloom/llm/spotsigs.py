"""SpotSigs fingerprints of documents, with column expressions only.

Texts are lower-cased and reduced to words. Content words are those that are not common. Wherever a common word (an
anchor) occurs, the chain of the next two content words forms, with the anchor, a spot signature. Two more kinds of anchors
hold in every text alike, so that lists and tables have spots too: one in ``DRAWN`` content words, by hash, is an anchor with
the next two content words, and the place before the first word is one with the first two (or one; without content words
all words, without words all characters are the signature). The fingerprint is the set of the signatures' 64-bit hashes,
its digest the set's size and two 64-bit hashes of it. Likeness is the Jaccard index of two sets. So equal texts have equal
fingerprints.

``near_pairs`` compares many sets: lengths are partitioned so that only sets of the same or the next partition can be
near, of each set only so many signatures are dealt out, rarest first, that two near sets must share one, and the sizes
bound the index before it is computed. Equal sets are one row there.

Defined cases: a null text counts as empty; two empty texts have equal (empty) fingerprints and likeness 1. Repeated rows
stay; of rows with one doc_id the larger text comes first. A null doc_id comes last in descending order; ids may be any
64-bit integers. Texts of any length are read whole, in time linear in their words, runs of common words included. An
empty table gives no rows. Only doc_id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, read_table

#: One in so many content words, drawn by hash, is an anchor too, in every text.
DRAWN = 8
MAX_RANGES = 1 << 16
#: Bytes of text in a range.
RANGE_BYTES = 4 << 20
#: Keys drawn for each range, and bytes of the text in a key.
DRAWN_KEYS, KEY_BYTES = 8, 16
#: Common words of the four languages.
ANCHORS = {
    "en": "the of and to in a is that for it was on as with be by at this from or an are he not".split(),
    "de": "der die das und von zu im den des dem mit ein eine ist für auf nicht sich als auch".split(),
    "fr": "le la les de du un une et en est que qui dans pour par sur au avec ce il".split(),
    "es": "el los las del y se por con para es al lo como más su una no sus".split(),
}


def _any_of(words: set[str]) -> str:
    """A pattern for any of the words that shares their common beginnings, so few branches are tried."""
    if words == {""}:
        return ""
    tails: dict[str, set[str]] = {}
    for w in words - {""}:
        tails.setdefault(w[0], set()).add(w[1:])
    return "(?:" + "|".join(c + _any_of(t) for c, t in sorted(tails.items())) + ")" + "?" * ("" in words)


#: A run of common words and the content word behind it. The repeated group is possessive and a match
#: begins where the last one ended, so each word is read once.
STEP = rf"\G(?:{_any_of({w for ws in ANCHORS.values() for w in ws})} )*+[^ ]+ "


def _words(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def _set(hashes: Column) -> Column:
    return F.array_sort(F.array_distinct(hashes))


def chains(text: Column) -> Column:
    """The sorted set of spot signatures, as 64-bit hashes. Each word is looked at a fixed number of times."""

    def signed(steps: Column) -> Column:
        content = F.transform(steps, lambda s: F.element_at(s, -1))
        return let(F.struct(steps.alias("s"), content.alias("c")), spots_in)

    def spots_in(p: Column) -> Column:
        n = F.size(p["c"])
        word = lambda i: F.concat(F.get(p["c"], i), F.lit(" "))
        chain = lambda i: F.concat(word(i), word(i + 1))

        def of_step(s: Column, i: Column) -> Column:
            common = F.array_distinct(F.slice(s, F.lit(1), F.size(s) - 1))
            own = F.when(i + 1 < n, let(chain(i), lambda c: F.transform(common, lambda w: F.xxhash64(F.concat(w, F.lit(" "), c))))).otherwise(none)
            drawn = (i + 2 < n) & (F.pmod(F.xxhash64(F.get(p["c"], i)), F.lit(DRAWN)) == 0)
            return F.when(drawn, F.concat(own, F.array(F.xxhash64(F.concat(word(i), chain(i + 1)))))).otherwise(own)

        none = F.array().cast("array<bigint>")
        first = F.concat(F.lit(" "), F.coalesce(word(F.lit(0)), F.lit("")), F.coalesce(word(F.lit(1)), F.lit("")))
        return F.concat(F.flatten(F.transform(p["s"], of_step)), F.when(n > 0, F.array(F.xxhash64(first))).otherwise(none))

    def of(q: Column) -> Column:
        rest = F.when(F.char_length(q["t"]) > 0, F.array(F.xxhash64(F.when(F.trim(q["w"]) == "", q["t"]).otherwise(q["w"])))).otherwise(F.array().cast("array<bigint>"))
        steps = F.transform(F.regexp_extract_all(F.concat(F.ltrim(q["w"]), F.lit(" ")), F.lit(STEP), F.lit(0)), lambda m: F.split(F.rtrim(m), " "))
        return let(let(steps, signed), lambda x: _set(F.when(F.size(x) > 0, x).otherwise(rest)))

    return let(F.struct(text.alias("t"), _words(text).alias("w")), of)


def digest(sig: Column) -> Column:
    return F.concat(F.size(sig).cast("string"), F.lit(":"), F.lower(F.hex(F.xxhash64(sig))), F.lit(":"), F.lower(F.hex(F.xxhash64(F.lit("spots"), sig))))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets; two empty ones are alike."""

    def index(p: Column) -> Column:
        common = F.size(F.array_intersect(p["a"], p["b"]))
        many = let(common, lambda c: c.cast("double") / (F.size(p["a"]) + F.size(p["b"]) - c))
        return F.when((F.size(p["a"]) == 0) & (F.size(p["b"]) == 0), F.lit(1.0)).otherwise(many)

    return let(F.struct(a.alias("a"), b.alias("b")), index)


def sort_key(doc_id: Column, text: Column) -> Column:
    """A string in the order of (doc_id, nulls first, beginning of the text)."""
    flipped = doc_id.bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.coalesce(F.lpad(F.hex(flipped), 16, "0"), F.lit("")), F.lit("-"), F.hex(F.substring(text.cast("binary"), 1, KEY_BYTES)))


def _bounds(keys: DataFrame, rows: int, ranges: int) -> list[str]:
    """Keys that part the rows into about equal ranges, in descending order. They are taken from keys drawn by hash, about
    DRAWN_KEYS a range, and only steer which task has which rows."""
    some = keys.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, rows // (ranges * DRAWN_KEYS)))) == 0)
    drawn = sorted((r["key"] for r in some.limit(4 * ranges * DRAWN_KEYS).collect()), reverse=True)
    step = max(1, len(drawn) // ranges)
    return sorted(set(drawn[step - 1 :: step]), reverse=True)


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the descending bounds lie above key, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(bounds)), ",")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    more = lambda at, step: (at + step <= len(bounds)) & (F.get(table, at + step - 1) > key)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.coalesce(more(at, step), F.lit(False)), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text and their chains: the text that follows in descending doc_id, the first's after the last.

    Rows are dealt into ranges of (doc_id, beginning of the text), and each range also gets the head of the range that
    follows, so one exchange of the texts does. There are at most MAX_RANGES ranges, which bounds what is collected and
    broadcast about them; ids may lie anywhere, and neither a far id nor null or repeated ids fill one task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", sort_key(F.col("doc_id"), F.col("text")))
    stat = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long") + 64).alias("b")).first()
    wanted = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(stat["b"] or 0) // RANGE_BYTES))
    ranges = max(1, min(MAX_RANGES, wanted, stat["n"]))
    bounds = _bounds(rows.select("key"), stat["n"], ranges)
    rows = rows.withColumn("_b", _range_of(F.col("key"), bounds))
    tops = rows.groupBy("_b").agg(F.max("key").alias("_top"))
    order = Window.orderBy("_b")  # over at most MAX_RANGES + 1 rows
    tops = tops.select(F.col("_b").alias("_from"), "_top", F.coalesce(F.lag("_b").over(order), F.max("_b").over(Window.partitionBy(F.lit(0)))).alias("_to"))
    heads = (
        rows.join(F.broadcast(tops), (F.col("_b") == F.col("_from")) & (F.col("key") == F.col("_top")))
        .groupBy(F.col("_to").alias("_b"))
        .agg(F.max("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", "_b", F.lit(1).alias("_last"))
    )
    both = rows.select("doc_id", "text", "_b", F.lit(0).alias("_last")).unionByName(heads).repartition(ranges, "_b")
    # each text's chains are found once, behind the exchange, and serve its own row and the one before
    both = both.withColumn("chains", chains(F.col("text")))
    w = Window.partitionBy("_b").orderBy(F.col("_last"), F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    out = both.select("*", F.lead("text").over(w).alias("next_text"), F.lead("chains").over(w).alias("next_chains"))
    return out.filter("_last = 0").select("doc_id", "text", "next_text", "chains", "next_chains")


def fingerprints(docs: DataFrame) -> DataFrame:
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left(F.col("text"), n - third), F.left(F.col("next_text"), third))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "chains", "next_chains", edited.alias("_edited"))
    sets = F.struct(F.col("chains").alias("a"), chains(F.col("_edited")).alias("e"), F.col("next_chains").alias("b"))

    def report(s: Column) -> Column:
        return F.struct(
            digest(s["a"]).alias("fingerprint"),
            digest(s["e"]).alias("edited_fingerprint"),
            jaccard(s["a"], s["e"]).alias("near_edited"),
            jaccard(s["a"], s["b"]).alias("near_next"),
        )

    return rows.select("doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), let(sets, report).alias("_r")).select("doc_id", "n_chars", "edited_sha256", "_r.*")


def spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def length_partition(size: Column, tau: float) -> Column:
    """Sets whose sizes lie two or more partitions apart have an index under tau."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(tau))).cast("int")


def near_pairs(docs: DataFrame, tau: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): doc_id, class_id for each row, where a class has one fingerprint and its least doc_id as id; and
    a, b, likeness for the classes with a likeness of tau or more (a > b)."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), chains(F.coalesce(F.col("text"), F.lit(""))).alias("sig")).withColumn("fp", digest(F.col("sig")))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("class_id"))
    sets = marked.join(classes, "fp").filter("doc_id = class_id").dropDuplicates(["fp"]).select("class_id", "sig")
    each = sets.select("class_id", F.size("sig").alias("n"), F.explode("sig").alias("s"))
    rare = each.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    ranked = each.join(rare, "s", "left").withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy(F.coalesce("c", F.lit(1)), "s")))
    prefix = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(tau)) + 1).filter("c > 1")
    part = length_partition(F.col("n"), tau)
    held = prefix.select("s", F.col("class_id").alias("a"), F.col("n").alias("n_a"), part.alias("p"))
    sought = prefix.select("s", F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(part - 1, part, part + 1)).alias("p"))
    could = held.join(sought, ["s", "p"]).filter((F.col("a") > F.col("b")) & (F.least("n_a", "n_b") >= F.lit(tau) * F.greatest("n_a", "n_b"))).select("a", "b").distinct()
    x, y = sets.select(F.col("class_id").alias("a"), F.col("sig").alias("sa")), sets.select(F.col("class_id").alias("b"), F.col("sig").alias("sb"))
    pairs = could.join(x, "a").join(y, "b").withColumn("likeness", jaccard(F.col("sa"), F.col("sb"))).filter(F.col("likeness") >= tau).select("a", "b", "likeness")
    return marked.join(classes, "fp").select("doc_id", "class_id"), pairs
