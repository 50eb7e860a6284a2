"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

``blocks_of`` reads a page in one pass into its leaf blocks (runs of text between block-level tags) with the open
elements above each. ``features_of`` names what is known of a block: its ancestors' tags, the words in their class, id and
role attributes, and its text's length, links and punctuation. ``train`` fits weights for features and label pairs by
gradient ascent on the exact likelihood (forward and backward sums) of labelled pages; Viterbi picks the best labels.

The labelled pages come from ``labelled_pages``, a generator of page layouts with known parts, so that the model is
trained here, from a fixed number of pages whatever the input.

Defined cases: null and empty html give empty text. Pages of any length and depth are read whole. Unclosed and stray tags, unclosed comments and scripts are read as
browsers do, to the end of the page if need be. Repeated rows give a row each, ids and urls may be null, an empty table
gives no rows, and only page_id, url and html are read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

TRAIN_PAGES, STEPS, SEED = 360, 160, 11

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img input button select option object canvas audio video svg g text tspan math mi mn mo ms mtext mrow mfrac msup msub msqrt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes template".split())
KNOWN_TAGS = frozenset("article main section nav header footer aside form ul ol li table td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption div a button label select option dl dt dd noscript dialog address details summary fieldset menu".split())
TAG = re.compile(r"<(?:!--(?P<c>.*?)(?:--!?>|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<close2>/)?(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD_PART = re.compile(r"[a-z]+")
#: Words in attributes that tell parts of pages apart; a longer word counts if it begins with one of four letters or more.
HINTS = "ad ads advert advertisement sponsor promo banner nav navbar navigation menu breadcrumb sidebar side aside widget header masthead topbar footer bottom copyright legal cookie consent notice alert gdpr popup modal dialog overlay comment comments reply replies discussion disqus respond share social related recommended more tags meta byline author date newsletter subscribe signup login search form pagination pager toc caption article content main post entry story text body page hidden contentinfo complementary teaser toolbar skip".split()
HINT_SET = frozenset(HINTS)
LONG_HINTS = tuple(h for h in HINTS if len(h) >= 4)


@cache
def _hints(value: str) -> frozenset[str]:
    out = set()
    for w in WORD_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
        if w in HINT_SET:
            out.add(w)
        else:
            out.update(h for h in LONG_HINTS if w.startswith(h))
    return frozenset(out)


@cache
def _element(name: str, attrs: str) -> frozenset[str]:
    """Features that an open element gives to the blocks in it."""
    out = {f"in:{name}"} if name in KNOWN_TAGS else set()
    for key, a, b, c in ATTR.findall(attrs):
        if key.lower() in ("hidden", "aria-hidden"):
            if (a or b or c).lower() != "false":
                out.add("hint:hidden")
        elif key.lower() != "aria-label":
            out.update(f"hint:{h}" for h in _hints(a or b or c))
    return frozenset(out)


def element(name: str, attrs: str) -> frozenset[str]:
    if len(attrs) > 200:
        attrs = " ".join(m.group(0) for m in ATTR.finditer(attrs))
    if _element.cache_info().currsize > 20_000:
        _element.cache_clear()
        _hints.cache_clear()
    return _element(name, attrs)


def _has(attrs: str) -> str:
    low = attrs.lower()
    return attrs if "class" in low or "id" in low or "role" in low or "hidden" in low else ""


#: What an opening tag closes if it is open above it, and the tags that stop the search.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


def blocks_of(page: str) -> list[tuple[str, frozenset[str], str, float]]:
    """(text, features of the open elements, innermost block tag, share of its text in links) for each leaf block."""
    out, stack, parts = [], [], []  # stack: (name, features of it and all above)
    opened: Counter[str] = Counter()  # how often each element is open
    linked = total = 0
    at, n = 0, len(page)

    def close_from(i: int) -> None:
        opened.subtract(x for x, _ in stack[i:])
        del stack[i:]

    def end() -> None:
        nonlocal linked, total
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                tag = next((x for x, _ in reversed(stack) if x not in INLINE), "body")
                out.append((text, stack[-1][1] if stack else frozenset(), tag, linked / max(total, 1)))
            parts.clear()
        linked = total = 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            total += lt - at
            if opened["a"]:
                linked += lt - at
        if lt == n:
            break
        m = TAG.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        attrs = m["attrs"] or m["attrs2"] or ""
        if m["close"] or m["close2"]:
            if name == "br":
                parts.append(" ")
                continue
            if name not in INLINE:
                end()
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    close_from(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                gt = page.find(">", close.end()) if close else -1
                at = n if gt < 0 else gt + 1
            if name not in INLINE:
                end()
            continue
        if name in VOID:
            if name not in INLINE:
                end()
            continue
        if name not in INLINE:
            end()
            if opened["p"]:
                i = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), -1)
                if i >= 0 and stack[i][0] == "p":
                    close_from(i)
            if name in CLOSES and any(opened[x] for x in CLOSES[name][0].split()):
                names, stops = CLOSES[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in names.split():
                        close_from(i)
                        break
                    if stack[i][0] in stops:
                        break
        own = element(name, _has(attrs))
        above = stack[-1][1] if stack else frozenset()
        stack.append((name, above | own if own else above))
        opened[name] += 1
    end()
    return out


def features_of(blocks: list) -> list[list[str]]:
    out = []
    for text, above, tag, links in blocks:
        f = list(above)
        size = len(text)
        f.append(f"tag:{tag}" if tag in KNOWN_TAGS else "tag:other")
        f.append("len:" + ("a" if size < 15 else "b" if size < 40 else "c" if size < 100 else "d" if size < 300 else "e"))
        if links > 0.5:
            f.append("links")
        if text[-1] in ".!?…:\"'»”":
            f.append("ends")
        if "©" in text[:40]:
            f.append("copyright")
        if "in:article" in above or "in:main" in above:
            f.append("inside")
        if not above & _BAD:
            f.append("plain")
        f.append("bias")
        out.append(f)
    return out


_BAD = frozenset({f"in:{t}" for t in "nav header footer aside form noscript dialog button label select menu".split()} | {f"hint:{h}" for h in HINTS if h not in ("article", "content", "main", "post", "entry", "story", "text", "body", "page", "caption", "author", "date", "meta", "tags", "more", "side", "header")})


class Model:
    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start

    def labels(self, blocks: list) -> list[int]:
        """Viterbi: 1 for blocks of the main text."""
        if not blocks:
            return []
        get, none = self.weights.get, (0.0, 0.0)
        (m00, m01), (m10, m11) = self.moves.tolist()
        back = []
        s0, s1 = self.start.tolist()
        first = True
        for f in features_of(blocks):
            e0 = e1 = 0.0
            for name in f:
                a, b = get(name, none)
                e0 += a
                e1 += b
            if first:
                s0, s1, first = s0 + e0, s1 + e1, False
                continue
            a0, b0, a1, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((b0 > a0, b1 > a1))
            s0, s1 = max(a0, b0) + e0, max(a1, b1) + e1
        out = [int(s1 > s0)]
        for p in reversed(back):
            out.append(int(p[out[-1]]))
        return out[::-1]

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page or "")
        return " ".join(b[0] for b, y in zip(blocks, self.labels(blocks), strict=True) if y)


def train(pages: list[tuple[list, list[int]]], steps: int = STEPS, rate: float = 0.15, ridge: float = 1e-3) -> Model:
    """Fit by gradient ascent (Adam) on the mean log-likelihood of the labels of (blocks, labels)."""
    feats = [features_of(b) for b, _ in pages]
    names = sorted({f for p in feats for fs in p for f in fs})
    at = {f: i for i, f in enumerate(names)}
    t_max, n = max(len(p) for p in feats), len(feats)
    x = np.zeros((n, t_max, len(names)), np.float32)
    y, mask = np.zeros((n, t_max), int), np.zeros((n, t_max))
    for i, (p, (_, lab)) in enumerate(zip(feats, pages, strict=True)):
        for t, fs in enumerate(p):
            x[i, t, [at[f] for f in fs]] = 1
        y[i, : len(lab)] = lab
        mask[i, : len(lab)] = 1
    flat = x.reshape(-1, len(names))
    one = np.eye(2)[y] * mask[..., None]
    pairs = np.einsum("ita,itb->ab", one[:, :-1], one[:, 1:])
    theta = np.zeros(len(names) * 2 + 4 + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    lse = lambda a, axis: np.logaddexp(np.take(a, 0, axis), np.take(a, 1, axis))
    for step in range(1, steps + 1):
        w, moves, start = theta[:-6].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        e = (flat @ w).reshape(n, t_max, 2)
        fwd, bwd = np.zeros((n, t_max, 2)), np.zeros((n, t_max, 2))
        fwd[:, 0] = start + e[:, 0]
        for t in range(1, t_max):
            go = lse(fwd[:, t - 1, :, None] + moves, 1) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None] > 0, go, fwd[:, t - 1])
        z = lse(fwd[:, -1], 1)
        for t in range(t_max - 2, -1, -1):
            go = lse(moves + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None] > 0, go, 0.0)
        p = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        both = fwd[:, :-1, :, None] + moves + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]
        both = np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]
        g = np.concatenate([(flat.T @ (one - p).reshape(-1, 2)).ravel(), (pairs - both.sum((0, 1))).ravel(), (one[:, 0] - p[:, 0]).sum(0)]) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = theta[:-6].reshape(-1, 2)
    return Model({f: (float(w[i, 0]), float(w[i, 1])) for f, i in at.items()}, theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy())


def labelled_pages(count: int, seed: int) -> Iterator[str]:
    """Pages of many layouts. Texts of the article carry the sign U+0001, which labels them and is not a feature."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfklmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4)))

    def words(lo: int, hi: int, end: str = "") -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi))).capitalize() + end

    pick = r.choice

    def attr(*names: str) -> str:
        if r.random() < 0.75:
            deco = pick(["{}", "{}", "site-{}", "{}-box", "main-{}" if r.random() < 0.1 else "{}-inner", "{}1", "c-{} x"])
            return f' {pick(["class", "class", "id"])}="{deco.format(pick(names))}"'
        return ""

    def must(*names: str) -> str:
        return f' {pick(["class", "id"])}="{pick(names)}"'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def prose(k: int, sign: str = "") -> str:
        out = []
        for _ in range(k):
            t = sign + words(3, 60, pick(["."] * 5 + ["!", "?", "", ","]))
            out.append(pick([f"<p>{t}</p>", f"<p>{t}</p>", f"<p><b>{t}<br><p>", f"<p>{t} <a href='#'>{sign}{word()}</a> {words(1, 9)}.</p>", f"<div>{t}</div>" if sign else f"<p>{t}</p>"]))
        return "".join(out)

    def notice() -> str:
        return f'<div{must("ad", "ads", "advert", "cookie-notice", "cookie", "consent", "sponsored", "promo", "banner", "newsletter", "notice", "popup", "alert", "related", "share", "social")}>{pick([words(2, 30, "."), prose(1), links(2)])}</div>'

    def comments() -> str:
        inner = "".join(f'<div{attr("comment", "reply")}>{pick([words(4, 40, "."), prose(1)])}</div>' for _ in range(r.randint(1, 4)))
        head = f"<h3>{words(1, 2)}</h3>" * r.randint(0, 1)
        return pick([f'<section{must("comments", "comment-list", "responses-comments", "discussion", "replies")}>{head}{inner}</section>', f'<div{must("comments", "comments-area", "disqus_thread", "replies")}>{head}{inner}</div>', f'<ol{must("comment-list", "comments")}>{"".join(f"<li><p>{words(3, 30)}.</p></li>" for _ in range(2))}</ol>'])

    def form() -> str:
        return f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><p>{words(2, 8, ".")}</p><select><option>{word()}</option><option>{word()}</option></select><button>{word()}</button></form>'

    def aside() -> str:
        inner = pick([links(3), prose(r.randint(1, 2)), f"<h3>{words(1, 3)}</h3>{links(3)}"])
        return pick([f'<aside{attr("sidebar", "related", "widget")}>{inner}</aside>', f'<div{must("sidebar", "widget", "side-bar", "related-posts")}>{inner}</div>'])

    for _ in range(count):
        s = "\x01"
        body = f"<h1>{s}{words(3, 9)}</h1>" * (r.random() < 0.85)
        if r.random() < 0.15:
            body = f"<header>{body}</header>"
        for _ in range(r.randint(1, 7)):
            body += prose(r.randint(1, 3), s)
            extra = r.random()
            if extra < 0.12:
                body += f"<h2>{s}{words(1, 6)}</h2>"
            elif extra < 0.2:
                body += f"<ul><li>{s}{words(3, 12)}</li><li>{s}{words(3, 12)}.</li></ul>"
            elif extra < 0.26:
                body += f"<blockquote>{s}{words(5, 30)}.</blockquote>"
            elif extra < 0.3:
                body += f"<table><tr><td>{s}{words(1, 4)}</td><td>{s}{words(1, 4)}</td></tr></table>"
            elif extra < 0.33:
                body += f"<pre>{s}{words(4, 10)}</pre>"
            elif extra < 0.43:
                body += notice()
            elif extra < 0.48:
                body += aside()
        if r.random() < 0.12:
            body += form()
        if r.random() < 0.15:
            body += comments()
        wrap = r.random()
        if wrap < 0.45:
            main = f'<article{attr("post", "entry", "article")}>{body}</article>'
        elif wrap < 0.6:
            main = f"<main>{body}</main>"
        elif wrap < 0.7:
            main = f"<main><article>{body}</article></main>"
        elif wrap < 0.95:
            main = f'<div{must("content", "main-content", "post", "entry-content", "article-body", "story", "text")}>{body}</div>'
        else:
            main = f"<div>{body}</div>"
        top = pick([f"<nav>{links(r.randint(2, 7))}</nav>", f'<div{must("menu", "navbar", "nav", "topbar")}>{links(r.randint(2, 7))}</div>', ""])
        head = pick([f'<header{attr("header", "masthead")}>{pick([words(1, 4), f"<h1>{words(1, 4)}</h1><p>{words(2, 9)}</p>"])}{top}</header>', f'<div{must("header", "masthead", "page-header", "site-header")}><p>{words(2, 12)}</p></div>{top}', top])
        mid = "".join(pick([notice, notice, aside, form, lambda: ""])() for _ in range(r.randint(0, 3)))
        tail = "".join(pick([comments, aside, notice, form, lambda: ""])() for _ in range(r.randint(0, 3)))
        foot = pick([f'<footer{attr("footer")}>{pick([f"&copy; {word()}.com &middot; {words(2, 12)}.", prose(1), links(3)])}</footer>', f'<div{must("footer", "site-footer", "copyright", "bottom-footer")}>{pick([f"© {words(2, 6)}", prose(1)])}</div>', ""])
        if r.random() < 0.06:
            main, mid = f"<article>{body}", mid
        if r.random() < 0.08:
            head = mid = tail = foot = ""
            main = pick([main, f"<article>{s}{words(1, 30)}", f"<p>{s}{words(3, 30)}</p>", f"<article><p>{s}{words(1, 3)}</p></article>"])
        yield f"<html><head><title>{words(2, 5)}</title><script>var x='<p>{word()}</p>';</script></head><body>{head}{mid}{main}{tail}{foot}" + pick(["</body></html>", ""])


def signed(pages: Iterator[str]) -> list[tuple[list, list[int]]]:
    out = []
    for p in pages:
        blocks = blocks_of(p)
        if blocks:
            out.append(([(b[0].replace("\x01", "") or "x", *b[1:]) for b in blocks], [int("\x01" in b[0]) for b in blocks]))
    return out


@cache
def default_model() -> Model:
    return train(signed(labelled_pages(TRAIN_PAGES, SEED)))


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars. The model is a few hundred numbers and goes along with the function."""
    model = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [model.text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))
