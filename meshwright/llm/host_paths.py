"""Main text of web pages by consensus host paths: each page scores its containers and votes for the best one's generalised tag-class path, the votes
are counted by host and path in Spark, and every page is extracted again from the elements at its host's winning path.

Defined cases: a null or empty html gives an empty text; a null or odd url belongs to the host ''; a page without the winning path falls back
to its own best container, one without any container to the whole body; a title (h1) that stands before a container without one, as a child of
what holds it, belongs to its text; pages may be nested as deeply as they like (work and memory are in proportion to the page); unclosed
elements end with their parent or the page; repeated rows and null ids are extracted row by row; ties between paths go to the longer, then the
last by name; an empty table gives an empty result."""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import bounded, cut, small

#: Elements and class or id words that mark what isn't the article.
DROP_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg math button select textarea menu dialog object canvas audio video head title".split())
DROP_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside widget ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup comment comments disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs pagination "
    "pager search login toolbar alert hidden".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th tr address summary".split())
#: An open element on the left is closed by an opening one on the right.
CLOSED_BY = {t: frozenset(c.split()) for t, c in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th tr", "th": "td th tr", "option": "option"}.items()}
_RAW = "script|style|textarea|title|iframe|noscript|template|svg"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:{_RAW})\b[^>]*(?<!/)>(?s:.*?)(?:</(?:{_RAW})\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/a-z][^>]*(?:>|\Z)", re.S | re.I
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")
LINK_WEIGHT, CHILD_SHARE, MAIN_BONUS = 1.0, 0.9, 1.25


def _opened(tag: str, attrs: str) -> tuple[str, bool]:
    """(the element's step in a generalised path, whether it is no part of an article)."""
    drop, step = tag in DROP_TAGS, tag
    if attrs and "=" in attrs or "hidden" in attrs:
        for k, v in _ATTR.findall(attrs):
            k, v = k.lower(), v.strip("\"'").lower()
            if k == "class" and v:
                step = tag + "." + ".".join(sorted({re.sub(r"\d+", "#", c) for c in v.split()}))
            if k in ("class", "id") and tag not in ("html", "body", "main"):
                words = _WORD.findall(v)
                drop |= any(w in DROP_WORDS and (not i or words[i - 1] not in ("no", "has", "with", "without")) for i, w in enumerate(words))
            drop |= k == "role" and v in DROP_ROLES or k == "hidden" or k == "aria-hidden" and v == "true"
    return step, drop


class Elements:
    """A page's elements, numbered in page order, so that a child's number is above its parent's. Their generalised paths aren't stored, as in deep
    pages they would take memory in the square of the depth: equal paths have equal numbers, and a path is written out where it is asked for."""

    def __init__(self):
        self.up, self.container, self.path = [-1], [True], [0]
        self.step, self.over, self.length, self.main = [""], [-1], [0], [False]  # of each path: last step, path above, characters
        self._known: dict[tuple[int, str], int] = {}

    def __len__(self) -> int:
        return len(self.up)

    def add(self, up: int, step: str, container: bool) -> int:
        key = (self.path[up], step)
        path = self._known.get(key)
        if path is None:
            path = self._known[key] = len(self.step)
            self.step.append(step)
            self.over.append(key[0])
            self.length.append(self.length[key[0]] + 1 + len(step))
            self.main.append(_MAIN.match(step) is not None)
        self.up.append(up)
        self.container.append(container)
        self.path.append(path)
        return len(self.up) - 1

    def written(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.step[path])
            path = self.over[path]
        return "".join(f"/{s}" for s in reversed(steps))

    def find(self, written: str) -> int | None:
        """The path of that writing, if a container has it."""
        reached = [0] + [-1] * (len(self.step) - 1)  # characters of `written` that a path makes up
        for k in range(1, len(self.step)):
            at = reached[self.over[k]]
            if at >= 0 and written.startswith("/" + self.step[k], at):
                reached[k] = at + 1 + len(self.step[k])
        full = {k for k, at in enumerate(reached) if k and at == len(written)}
        return next((p for p, ok in zip(self.path, self.container) if ok and p in full), None)


_MAIN, _HEAD = re.compile(r"(?:article|main)\b"), re.compile(r"h1\b")


def parse(page: str) -> tuple[list[tuple[int, list[str], int]], Elements]:
    """(blocks, elements): a block has its element, its parts of raw text and its characters inside links. Text of dropped elements is left out."""
    elements = Elements()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, nearest element that isn't inline, dropped
    is_open: dict[str, int] = defaultdict(int)  # of tags on the stack, so that it is searched for those only
    blocks: list[tuple[int, list[str], int]] = []
    parts: list[str] = []
    links, pos = 0, 0

    def end_block():
        nonlocal parts, links
        if parts:
            blocks.append((stack[-1][1], parts, links))
        parts, links = [], 0

    def close_to(k: int):
        if any(t not in INLINE for t, _, _ in stack[k:]):
            end_block()
        for t, _, _ in stack[k:]:
            is_open[t] -= 1
        del stack[k:]

    for m in _TOKEN.finditer(page):
        if m.start() > pos and not stack[-1][2]:
            text = page[pos : m.start()]
            parts.append(text)
            links += len(text) if is_open["a"] else 0
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif m[1]:
            for k in range(len(stack) - 1, 0, -1) if is_open[tag] else ():
                if stack[k][0] == tag:
                    close_to(k)
                    break
                if stack[k][0] not in INLINE and tag in INLINE:
                    break
            else:
                if tag not in INLINE:
                    end_block()
        elif tag in VOID:
            if tag not in INLINE:
                end_block()
        else:
            if tag not in INLINE:
                shut = CLOSED_BY.get(tag, ())
                for k in range(len(stack) - 1, 0, -1) if is_open["p"] or any(is_open[t] for t in shut) else ():
                    t = stack[k][0]
                    if t == "p" or t in shut:
                        close_to(k)
                        break
                    if t not in INLINE and t not in LEAF:
                        break
                end_block()
            step, drop = _opened(tag, m[3])
            at = stack[-1][1]
            if tag not in INLINE and tag not in ("html", "body"):  # those are the root, which must not vote once for each
                at = elements.add(at, step, tag not in LEAF)
            if not m[3].endswith("/") or tag in INLINE:
                stack.append((tag, at, drop or stack[-1][2]))
                is_open[tag] += 1
    if pos < len(page) and not stack[-1][2]:
        parts.append(page[pos:])
    end_block()
    return blocks, elements


def scores(blocks, elements: Elements) -> dict[int, float]:
    """Each container's score: its own blocks' characters outside links, less those inside, and most of its children's scores."""
    own = [0.0] * len(elements)
    for at, parts, links in blocks:
        n = sum(len(p.strip()) for p in parts)
        while not elements.container[at]:
            at = elements.up[at]
        own[at] += max(0.0, n - links - LINK_WEIGHT * links)
    for i in range(len(elements) - 1, 0, -1):
        own[elements.up[i]] += CHILD_SHARE * own[i]
    return {i: s * (MAIN_BONUS if elements.main[elements.path[i]] else 1.0) for i, s in enumerate(own) if s > 0 and elements.container[i]}


def vote(page: str) -> str | None:
    """The path whose containers have the highest score in sum, of equal ones the longest; where it has several containers, the path of the lowest
    element around all of them, unless that is the root. A page has one vote."""
    by: dict[int, float] = {}
    at: dict[int, list[int]] = {}
    blocks, elements = parse(page)
    for i, s in scores(blocks, elements).items():
        path = elements.path[i]
        by[path] = by.get(path, 0.0) + s
        at.setdefault(path, []).append(i)
    if not by:
        return None
    top = max((by[p], elements.length[p]) for p in by)
    best = max((p for p in by if (by[p], elements.length[p]) == top), key=elements.written)
    around = _around(elements, at[best])
    return elements.written(elements.path[around] if around else best)


def _around(elements: Elements, inner: list[int]) -> int:
    """The lowest element that is or holds each of inner."""
    seen, heap = set(inner), [-i for i in set(inner)]
    heapq.heapify(heap)
    while len(heap) > 1:  # the one with the highest number gives way to its parent, whose number is lower
        up = elements.up[-heapq.heappop(heap)]
        if up not in seen:
            seen.add(up)
            heapq.heappush(heap, -up)
    return -heap[0]


def _title(elements: Elements, at: list[int], inside: list[bool]) -> set[int]:
    """The h1 elements that stand before the main text as children of what holds it, where the main text has none of its own."""
    first = next((i for i in at if inside[i]), 0)
    heads = {i for i in at if _HEAD.match(elements.step[elements.path[i]])}
    if not first or any(inside[i] for i in heads):
        return set()
    around, up = set(), first
    while up >= 0:
        up = elements.up[up]
        around.add(up)
    return {i for i in heads if i < first and elements.up[i] in around}


def extract(page: str, path: str | None) -> str:
    """The main text at the elements with that path, else at the page's own best container."""
    blocks, elements = parse(page)
    want = elements.find(path) if path else None
    inside = [path == ""] + [False] * (len(elements) - 1)
    for i in range(1, len(elements)):
        inside[i] = i > 0 and inside[elements.up[i]] or want is not None and elements.container[i] and elements.path[i] == want
    if not any(inside[at] for at, _, _ in blocks):
        own = scores(blocks, elements)
        best = max(own, key=lambda i: (own[i], -i), default=0)
        inside = [i == best for i in range(len(elements))]
        for i in range(1, len(elements)):
            inside[i] |= inside[elements.up[i]]
    title = _title(elements, [at for at, _, _ in blocks], inside)
    texts = (_SPACES.sub(" ", html.unescape("".join(parts))).strip() for at, parts, _ in blocks if inside[at] or at in title)
    return "\n".join(t for t in texts if t)


def host(url: str = "url"):
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")), F.lit(""))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of pages."""

    def cast(batches):
        for b in batches:
            tally = Counter((h, vote(page)) for h, page in zip(K.column(b, "host").to_pylist(), K.column(b, "html").to_pylist()))
            won = [k for k in tally if k[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in won], pa.string()), pa.array([p for _, p in won], pa.string()), pa.array([tally[k] for k in won], pa.int64())], names=["host", "path", "votes"])

    polled = bounded(pages).select("html", host().alias("host")).where("html is not null").mapInArrow(cast, "host string, path string, votes long")
    won = polled.groupBy("host", "path").agg(F.sum("votes").alias("votes")).groupBy("host")
    won = cut(won.agg(F.max(F.struct("votes", F.length("path"), "path")).alias("best")).select(F.col("host").alias("_host"), F.col("best.path").alias("_path")))
    # A row for each host: broadcast when a count allows; else joined by a shuffle in which hot hosts can be split.
    own = pages.select("page_id", "url", "html").withColumn("_key", host()).join(small(won), F.col("_key") == F.col("_host"), "left")

    def again(batches):
        for b in batches:
            page, path = K.column(b, "html").to_pylist(), K.column(b, "_path").to_pylist()
            text = [extract(p, w) if p else "" for p, w in zip(page, path)]
            yield pa.RecordBatch.from_arrays([K.column(b, "page_id").cast(pa.int64()), K.column(b, "url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.select("page_id", "url", "html", "_path").mapInArrow(again, "page_id long, url string, text string, n_chars long")
