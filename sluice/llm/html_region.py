"""Main text of web pages by the maximum-scoring subsequence.

A page is read once, from left to right, as words and tags. Words score by where they stand (in an article, in plain body
text, in a link), tags by their name; the weights are log odds of lying inside the content, counted on labelled pages, words
of content at least +MIN, tags at most -MIN, and tags without a word between them together no less than -GAP. Parts that are
no content (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are out of the
sequence: by element, or where the words of an element's class, id and role weigh against it; these weights are log odds as
well, of words by whether they come last, counted on labelled names. One linear scan finds the contiguous region with the
best sum. Text is then taken whole by element: all of the innermost element that holds the region, or where that is the
page itself, of those of its children that the region touches; only blocks of links beyond the region are left out, so that no gap in an
article cuts text off. Where names alone leave a page without text, it is read again without regard to names.

Character references are decoded; white space inside a block becomes one space; blocks are trimmed and joined by one space.
Null or empty html: empty text. Unclosed tags, quotes and comments end with their parent or the page. Ties between regions:
the first. Very long pages: one pass, whatever the length. Null id, repeated rows: each comes out. Empty table: empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import lean

MIN = 0.02
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
OTHER = {"head", "nav", "header", "footer", "aside", "form", "noscript", "template", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video"}
#: Words of class, id and role values in the labelled names: of parts that are no content, of those that may also be what a page is about, and of content.
PART_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "sidebar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "popup", "modal", "signup", "comment", "comments", "disqus", "widget", "contentinfo", "complementary"}
TOPIC_WORDS = {"sponsor", "promo", "banner", "menu", "header", "cookie", "cookies", "consent", "notice", "newsletter", "subscribe", "login", "share", "social", "related", "recommended", "search", "skip"}
MAIN_WORDS = {"article", "content", "post", "entry", "story", "main", "text", "body", "prose"}
#: Place of words that are left out.
DROPPED = "other"
#: The least that tags without a word between them add to the sum.
GAP = 2.0
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_CUT = re.compile(r"[^a-z0-9]+")
_ENDS = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text" | "open" | "close", name or text, attributes), in order; comments, declarations and raw text are left out."""
    at, n, quotes = 0, len(page), {'"': True, "'": True}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        close = nxt == "/"
        name = _NAME.match(page, lt + 1 + close)
        if not name:
            end = page.find(">", lt) if close else lt
            yield "text", "" if close else "<", ""
            at = n if end < 0 else end + 1
            continue
        end = page.find(">", name.end())
        if end < 0:
            return
        attributes = page[name.end() : end]
        if "=" in attributes and ('"' in attributes or "'" in attributes):  # a > inside a quoted value does not end the tag
            p = name.end()
            while p < end:
                q = min((x for x in (page.find('"', p, end), page.find("'", p, end)) if x >= 0), default=-1)
                if q < 0:
                    break
                mark = page[q]
                shut = page.find(mark, q + 1) if quotes[mark] else -1
                if shut < 0:
                    quotes[mark] = False
                    break
                p = shut + 1
                if p > end:
                    end = page.find(">", p)
                    if end < 0:
                        return
            attributes = page[name.end() : end]
        tag = name[0].lower()
        at = end + 1
        yield "close" if close else "open", tag, attributes
        if tag in RAW and not close:
            found = _ENDS[tag].search(page, at)
            at = found.start() if found else n


def _marks(attributes: str) -> set[str]:
    """The words of class, id and role, and those that end a name, marked."""
    out: set[str] = set()
    if "=" in attributes:
        for m in _MARKS.finditer(attributes):
            for name in m[1].lower().strip("\"'").split():
                if words := [w for w in _CUT.split(name) if w]:
                    out.update(words)
                    out.add(f"{words[-1]}.")
    return out


@dataclass
class Part:
    """A token: text or tag, where it stands (by its innermost marked element), whether it ends a block, and the number of its element."""

    kind: str
    value: str
    place: str
    breaks: bool
    element: int


def parts(page: str, names: dict[str, float] | None = None) -> tuple[list[Part], list[int]]:
    """The tokens of a page, and the parent of each element; element 0 is the page."""
    names = {} if names is None else names
    stack: list[tuple[str, str, int]] = []
    opened: Counter[str] = Counter()
    out, parents = [], [-1]
    for kind, value, attributes in tokens(page):
        place, element = stack[-1][1:] if stack else ("body", 0)
        if kind == "text":
            out.append(Part(kind, value, place, False, element))
            continue
        if kind == "open":
            if value in MAIN or value == "body":  # what was left open before the article does not hold it
                while stack and stack[-1][1] in (DROPPED, "link"):
                    opened[stack.pop()[0]] -= 1
                place, element = stack[-1][1:] if stack else ("body", 0)
            if value not in VOID:
                weight = sum(names.get(w, 0.0) for w in _marks(attributes)) if place != DROPPED and value not in ("body", "html") else 0.0
                if place == DROPPED or value in OTHER or (weight < 0 and value not in MAIN):
                    inner = DROPPED
                elif value in MAIN or weight > 0:
                    inner = "main"
                else:
                    inner = "link" if value == "a" and place == "body" else place
                if value not in ("html", "body"):
                    parents.append(element)
                    element = len(parents) - 1
                stack.append((value, inner, element))
                opened[value] += 1
        elif opened[value] > 0:
            while True:
                name, *_ = stack.pop()
                opened[name] -= 1
                if name == value:
                    break
        out.append(Part(kind, value, place, value not in INLINE, element))
    return out, parents


def labelled_names(n: int = 4000, seed: int = 4) -> list[tuple[str, bool]]:
    """The shipped labelled names, made by rule: (attributes, whether their element is content)."""
    rng = np.random.default_rng(seed)
    part, topic, main = sorted(PART_WORDS), sorted(TOPIC_WORDS), sorted(MAIN_WORDS)

    def any_of(words: list[str]) -> str:
        return words[int(rng.integers(0, len(words)))]

    def other() -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 8)))

    kinds = [  # words of a name, and whether it is content's
        (lambda: [any_of(part)], False), (lambda: [any_of(topic)], False), (lambda: [other(), any_of(part)], False), (lambda: [other(), any_of(topic)], False), (lambda: [any_of(part), other()], False), (lambda: [any_of(topic), other()], False),
        (lambda: [any_of(main), any_of(part)], False), (lambda: [any_of(main), any_of(topic)], False), (lambda: [any_of(part), any_of(main)], False), (lambda: [any_of(topic), any_of(part)], False),
        (lambda: [any_of(main)], True), (lambda: [any_of(main)], True), (lambda: [other(), any_of(main)], True), (lambda: [any_of(main), other()], True), (lambda: [any_of(topic), other(), any_of(main)], True), (lambda: [any_of(topic), any_of(main)], True), (lambda: [any_of(main), any_of(main)], True),
    ]
    out = []
    for _ in range(n):
        words, content = kinds[int(rng.integers(0, len(kinds)))]
        out.append((f'{["class", "id"][int(rng.integers(0, 2))]}="{"-".join(words())}"', content))
    return out


def weigh_names(rows: list[tuple[str, bool]] | None = None, steps: int = 400) -> dict[str, float]:
    """Weights of the words of names, of those that are known from several: a logistic model without a constant, so that a name of unknown words weighs nothing."""
    rows = labelled_names() if rows is None else rows
    marks = [_marks(a) for a, _ in rows]
    seen = Counter(w for m in marks for w in m)
    index = {w: i for i, w in enumerate(sorted(w for w, c in seen.items() if c >= 5))}
    at = np.array([(r, index[w]) for r, m in enumerate(marks) for w in sorted(m) if w in index], np.int64).reshape(-1, 2)
    y, weights = np.array([c for _, c in rows], np.float64), np.zeros(len(index))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(at[:, 0], weights[at[:, 1]], len(rows))))
        weights += 20 * (np.bincount(at[:, 1], (y - p)[at[:, 0]], len(index)) / len(rows) - 1e-4 * weights)
    return {w: float(weights[i]) for w, i in index.items()}


def labelled(n: int = 200, seed: int = 3) -> list[tuple[str, list[bool]]]:
    """The shipped labelled pages, made by rule in several layouts: (html, for each of its tokens whether it is content)."""
    rng = np.random.default_rng(seed)

    def prose(least: int, most: int) -> str:
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(rng.integers(least, most)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{prose(1, 3)}</a></li>' for i in range(k))

    out = []
    for _ in range(n):
        body = f"<h1>{prose(3, 9)}</h1>" + "".join([f"<p>{prose(8, 60)}</p>", f"<p><b>{prose(1, 5)}</b> {prose(5, 30)}<br>{prose(3, 20)}</p>", f"<h2>{prose(2, 6)}</h2>", f"<ul><li>{prose(3, 12)}</li><li>{prose(3, 12)}</li></ul>", f'<p>{prose(4, 20)} <a href="#">{prose(1, 3)}</a> {prose(2, 9)}</p>', f"<blockquote>{prose(5, 25)}</blockquote>", f"<table><tr><td>{prose(1, 4)}</td><td>{prose(1, 4)}</td></tr></table>"][k] for k in rng.integers(0, 7, rng.integers(1, 9)))
        if rng.random() < 0.3:
            body += f"<aside><p>{prose(2, 12)}</p></aside><p>{prose(3, 20)}</p>"
        holder = ["article", "main", "div class=content", "div"][int(rng.integers(0, 4))]
        before = [f"<nav><ul>{links(5)}</ul></nav>", f'<div class="menu">{links(4)}</div>', f"<header><a href=/>{prose(1, 3)}</a></header>", f'<div class="ad">{prose(3, 10)}</div>', f"<div><a href=/a>{prose(1, 3)}</a><a href=/b>{prose(1, 3)}</a></div>"]
        after = [f"<footer>{prose(3, 12)}</footer>", f"<aside><ul>{links(4)}</ul></aside>", f'<div id="comments"><p>{prose(4, 20)}</p><p>{prose(3, 9)}</p></div>', f"<form><label>{prose(1, 3)}</label><input></form>", f"<div><span>{prose(1, 3)}</span><a href=/c>{prose(1, 3)}</a></div>"]
        head = f"<html><head><title>{prose(3, 8)}</title><style>p{{}}</style></head><body>" + "".join(before[k] for k in rng.permutation(5)[: rng.integers(1, 5)])
        tail = "".join(after[k] for k in rng.permutation(5)[: rng.integers(1, 5)]) + "</body></html>"
        page = f"{head}<{holder}>{body}</{holder.split()[0]}>{tail}"
        first, last = len(list(tokens(f"{head}<{holder}>"))), len(list(tokens(f"{head}<{holder}>{body}")))
        out.append((page, [first <= i < last for i in range(len(list(tokens(page))))]))
    return out


def _class_of(kind: str, value: str, place: str) -> str:
    return f"word {place}" if kind == "text" else f"tag {value}"


@dataclass
class Weights:
    """Of words by place and tags by name, and of the words of names."""

    tokens: dict[str, float]
    names: dict[str, float]


def weigh(pages: list[tuple[str, list[bool]]] | None = None, names: list[tuple[str, bool]] | None = None) -> Weights:
    """Log odds of content, from labelled pages and names."""
    of_names = weigh_names(names)
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page, content in labelled() if pages is None else pages:
        for p, c in zip(parts(page, of_names)[0], content, strict=True):
            if p.place != DROPPED:
                (inside if c else outside)[_class_of(p.kind, p.value, p.place)] += len(p.value.split()) if p.kind == "text" else 1
    out = {}
    for k in inside.keys() | outside.keys():
        odds = math.log((inside[k] + 0.5) / (outside[k] + 0.5))
        # no single tag weighs so much that it alone cuts a region in two
        out[k] = max(min(odds, -MIN), -1.0) if k.startswith("tag") else odds if k.endswith(" link") else max(odds, MIN)
    return Weights(out, of_names)


def _region(found: list[Part], weights: dict[str, float]) -> tuple[int, int]:
    """The best contiguous run of tokens, first and last + 1."""
    best = total = gap = 0.0
    start = first = last = 0
    for i, p in enumerate(found):
        if p.place == DROPPED:
            continue
        w = weights.get(_class_of(p.kind, p.value, p.place), -0.1 if p.kind != "text" else MIN)
        words = len(p.value.split()) if p.kind == "text" else 0
        if words:
            gain, gap = w * words, 0.0
        elif p.kind == "text":
            continue
        else:
            gain = max(w, -GAP - gap)
            gap += gain
        if total <= 0:
            total, start = 0.0, i
        total += gain
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


def _blocks(found: list[Part], parents: list[int], first: int, last: int) -> Iterator[str]:
    """The blocks of text of the elements that the region lies in."""
    holders = {p.element for p in found[first:last] if p.kind == "text" and p.place != DROPPED and p.value.strip()}
    if not holders:
        return
    under = [int(e in holders) for e in range(len(parents))]
    for e in range(len(parents) - 1, 0, -1):
        under[parents[e]] += under[e]
    common = max(e for e in range(len(parents)) if under[e] == len(holders))
    # the common element, or of the page those of its children (and text of its own) that the region touches
    whole = {common} if common else {e for e in range(1, len(parents)) if parents[e] == 0 and under[e]}
    inside = [False] * len(parents)
    for e in range(1, len(parents)):
        inside[e] = e in whole or inside[parents[e]]
    now: list[str] = []
    near = links = False
    for i, p in enumerate(found):
        if p.kind == "text":
            if p.place != DROPPED and (first <= i < last or inside[p.element]):
                now.append(html.unescape(p.value))
                if p.value.strip():
                    near, links = near or first <= i < last or p.place != "link", True
        elif p.breaks:
            if now and (near or not links):
                yield "".join(now)
            now, near, links = [], False, False
    if now and (near or not links):
        yield "".join(now)


def main_text(page: str, weights: Weights) -> str:
    """The text of the best region and of what belongs to it."""
    for names in (weights.names, {}):
        found, parents = parts(page, names)
        out = " ".join(t for b in _blocks(found, parents, *_region(found, weights.tokens)) if (t := " ".join(b.split())))
        if out:
            return out
    return ""


def extract(pages: DataFrame, weights: Weights | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars for every row of pages."""
    weights = weigh() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) if p else "" for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long"
    return pages.select(*keep, F.col(html_col).cast("string").alias("_html")).mapInArrow(lean(run), schema)
