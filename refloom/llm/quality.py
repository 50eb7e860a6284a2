"""Quality rules by learned decision lists.

``text_stats`` computes, with column expressions only, statistics of each whole text. ``learn_rules`` runs sequential
covering on a bounded sample of labelled statistics: it grows a conjunction of thresholds by information gain on two
thirds of the rows, prunes it on the rest, takes away the rows it covers and goes on while rules stay precise.
``rules_column`` turns the ordered list into one Spark conditional expression.

Defined cases: a null or empty text has no words, so ``base_failed`` is true and ``kept`` false. Rows with null
``doc_id`` are judged like others. Repeated rows give repeated results. Labels that are null, or that name no document,
are ignored; with no usable labels the list is empty and ``kept`` is ``not base_failed``. Of several labels of one id the
least counts, of several texts of a labelled id the one with the least statistics. An empty table gives no rows, and a text
of any length is read whole. Columns of the input other than those named are not read, so names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, whole_row

#: Words end at blanks and at U+0009 to U+000D.
SPLIT = r"[\x20\x09-\x0D]+"
NO_BLANK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"#*$%\&|<>"
WINDOW = 8
#: At most so many labelled rows are used to fit the list; they are the first by hash of doc_id.
MAX_LABELLED = 20_000
MIN_PRECISION = 0.9

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbol_rate", "repeat_rate", "dup_line_rate", "word_len", "upper_rate", "mark_rate", "digit_rate", "words"]


def _count(text: Column, chars: str) -> Column:
    """Code points of text in the character class; deleting the rest is faster here than translate()."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT), "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words lying in windows of so many words that occur twice or more in the array, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            pairs,
            lambda p: F.array_sort(
                F.transform(
                    F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )
        steps = let(places, lambda q: F.zip_with(q, F.slice(q, 2, F.greatest(F.size(q), F.lit(1))), lambda a, b: F.least(F.lit(window), b - a)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def hashed(w: Column) -> Column:
        one = F.transform(w, lambda x: F.xxhash64(x))
        return let(one, lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - F.lit(window - 1)), lambda i: F.xxhash64(F.slice(a, i, window))))

    def counted(w: Column) -> Column:
        many = let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(w) > window, many).otherwise(F.lit(0).cast("long"))

    return let(words, counted)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_BLANK))
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def text_stats(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` and the statistics; the text is read once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    first = df.select(*[F.col(c) for c in keep or []], text.alias("_t"), words.alias("_w"))
    stats = first.select(
        *[F.col(c) for c in keep or []],
        F.col("_w.n").alias("n_words"),
        F.char_length(F.regexp_replace("_t", SPLIT, "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).alias("n_symbols"),
        duplicate_lines(F.col("_t")).alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"),
        _count(F.col("_t"), r"\p{Lu}").alias("n_upper"),
        _count(F.col("_t"), "!?").alias("n_marks"),
        _count(F.col("_t"), "0-9").alias("n_digits"),
        (_count(F.col("_t"), "\n") + 1).alias("n_lines"),
    )
    chars, words_n = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    rates = {
        "symbol_rate": F.col("n_symbols") / words_n,
        "repeat_rate": F.col("n_repeat_words") / words_n,
        "dup_line_rate": F.col("n_dup_lines") / F.col("n_lines"),
        "word_len": F.col("word_chars") / words_n,
        "upper_rate": F.col("n_upper") / chars,
        "mark_rate": F.col("n_marks") / words_n,
        "digit_rate": F.col("n_digits") / chars,
        "words": F.col("n_words").cast("double"),
    }
    return stats.withColumns(rates)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects a text where all (feature, '<=' or '>', threshold) hold."""

    terms: tuple[tuple[str, str, float], ...]
    covered: int
    precision: float


def _holds(x: np.ndarray, names: list[str], terms) -> np.ndarray:
    m = np.ones(len(x), bool)
    for f, op, t in terms:
        col = x[:, names.index(f)]
        m &= (col > t) if op == ">" else (col <= t)
    return m


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], grow: np.ndarray, max_rules: int = 12, max_terms: int = 4, min_precision: float = MIN_PRECISION, min_covered: int = 8) -> list[Rule]:
    """Sequential covering. grow marks the rows to grow on; the others prune and judge."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    cuts = {f: np.unique(np.round(np.quantile(x[:, i], np.linspace(0.005, 0.995, 120)), 4)) for i, f in enumerate(names)} if len(x) else {}
    while len(rules) < max_rules:
        g, p = left & grow, left & ~grow
        if bad[g].sum() < min_covered:
            break
        terms: list[tuple[str, str, float]] = []
        inside = g.copy()
        while len(terms) < max_terms:
            pos, neg = (bad & inside).sum(), (~bad & inside).sum()
            if neg == 0 or pos == 0:
                break
            now, best = np.log2(pos / (pos + neg)), (1e-9, None)
            for i, f in enumerate(names):
                col = x[:, i]
                for t in cuts[f]:
                    for op in (">", "<="):
                        m = inside & ((col > t) if op == ">" else (col <= t))
                        a, b = (bad & m).sum(), (~bad & m).sum()
                        if a >= min_covered and (gain := a * (np.log2(a / (a + b)) - now)) > best[0]:
                            best = (gain, (f, op, float(t)))
            if best[1] is None:
                break
            terms.append(best[1])
            inside &= _holds(x, names, terms[-1:])
        if not terms:
            break

        def worth(ts):
            m = _holds(x, names, ts) & p
            a, b = (bad & m).sum(), (~bad & m).sum()
            return (a + 1) / (a + b + 2)

        while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
            terms = terms[:-1]
        held = _holds(x, names, terms) & left
        a, b = (bad & held).sum(), (~bad & held).sum()
        precision = a / max(a + b, 1)
        if precision < min_precision or worth(terms) < min_precision - 0.1:
            break
        rules.append(Rule(tuple(terms), int(a + b), float(precision)))
        left &= ~held
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """True for texts that the ordered list keeps."""
    out = None
    for r in rules:
        cond = None
        for f, op, t in r.terms:
            c = F.col(f) > F.lit(t) if op == ">" else F.col(f) <= F.lit(t)
            cond = c if cond is None else cond & c
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Fit on at most max_labelled labelled documents (that bound makes the broadcast and the collected rows bounded)."""
    some = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q"))
        .filter(F.col("_id").isNotNull() & F.col("_q").isNotNull())
        .groupBy("_id")
        .agg(F.min("_q").alias("_q"))
        .orderBy(F.xxhash64("_id"), F.col("_id"))
        .limit(max_labelled)
    )
    labelled = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"), "inner")
    stats = text_stats(labelled, keep=["_id", "_q"]).select("_id", "_q", F.struct(base_failed().alias("_failed"), *RATIOS).alias("x"))
    rows = stats.groupBy("_id", "_q").agg(F.min("x").alias("x")).select("_id", "_q", "x.*").orderBy("_id").toPandas()
    # filtered here: in the plan, the condition would go below the join and need the statistics of every document
    rows = rows[~rows["_failed"]]
    if not len(rows):
        return []
    grow = (rows["_id"].to_numpy(np.int64) * 2654435761 % 1009) % 3 != 0
    return learn_rules(rows[RATIOS].to_numpy(np.float64), rows["_q"].to_numpy() == 0, list(RATIOS), grow)


def judge(docs: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    return text_stats(docs, keep=keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules_column(rules))


def quality_rules(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents") if docs is None else docs
    rules = fit_rules(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, rules, ["doc_id"]).select("doc_id", *BASE, "base_failed", "kept")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the learned list keeps, with the columns they came with."""
    rules = fit_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judge(docs.select(whole_row(docs), "text"), rules, ["_row"]).filter("kept").select("_row.*")
