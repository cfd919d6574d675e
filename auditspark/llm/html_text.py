"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at every tag that is not inline. A block's features are its words and link density, those of the blocks
before and after it, and markup facts: headings and paragraphs. A decision tree is trained on the blocks of ``SAMPLES``, some hundred small
pages made by rule, whose blocks carry their labels; half of them have neither names nor any tag but div. The tree decides alone on pages without
names. Prose that reads like an article, such as comments, notices or forms, cannot be told by these features: a block that the tree
takes for text is left out if its page says by tag or name that it stands in such a part.

Tags are found in one pass: where a tag ends, by quotes, is worked out for all places of a page at once, so that broken markup
takes time in proportion.

Character references are decoded, white space inside a block becomes one space, and kept blocks are joined by two line
breaks in page order. A null or empty page, and one without a kept block, has the text ''. Unclosed tags end with their
container; what is no tag is text. Very long pages are read whole. Rows that repeat have equal texts, and columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.batches import in_batches, prepare

_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/><]*+))")
_SIGN = re.compile(r"[\"'>]")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: their content is no text of the page
_RAW = set("script style title template noscript iframe svg math object textarea select".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = {"p", "blockquote", "pre"}
_MAIN_TAGS = {"article", "main"}
_OTHER_TAGS = set("nav footer aside form menu dialog button fieldset".split())
_MAIN_NAMES = set("article content main post entry story maincontent".split())
_HEADER_NAMES = set("header masthead topbar".split())
_OTHER_NAMES = set("""ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu menubar
breadcrumb breadcrumbs footer sidebar aside widget share sharing social cookie cookies consent gdpr notice notices notification alert popup
modal overlay newsletter subscribe subscription signup login signin search searchbox form pagination pager copyright legal
disclaimer toolbar""".split())
#: an article inside of these is none
_REPLY_NAMES = set("comment comments commentlist disqus respond reply replies discussion related recommended recommendations".split())


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    main: bool
    other: bool
    header: bool
    heading: bool
    paragraph: bool
    label: int | None


class _Tags:
    """Where the tags of a page end."""

    def __init__(self, page: str):
        self.page, self.signs, self.ends, self.bare = page, None, [], len(page)

    def end(self, at: int) -> int:
        """The place behind the tag whose name ends at ``at``, or -1 if it never ends."""
        sign = _SIGN.search(self.page, at) if at < self.bare else None
        if sign is None:
            self.bare = min(self.bare, at)  # no sign follows
            return -1
        if sign[0] == ">":
            return sign.end()
        if self.signs is None:
            self.signs = [m.start() for m in _SIGN.finditer(self.page)]
            # from the last sign back: outside of quotes, a tag ends at >, or goes on behind the next quote of the same kind
            self.ends, closing = [-1] * (len(self.signs) + 1), {}
            for i in range(len(self.signs) - 1, -1, -1):
                kind = self.page[self.signs[i]]
                if kind == ">":
                    self.ends[i] = self.signs[i] + 1
                else:
                    self.ends[i] = self.ends[closing[kind] + 1] if kind in closing else -1
                    closing[kind] = i
        return self.ends[bisect_left(self.signs, sign.start())]


class _Frame(NamedTuple):
    tag: str
    main: bool = False
    other: bool = False
    header: bool = False
    reply: bool = False
    heading: bool = False
    paragraph: bool = False
    label: int | None = None


def _enter(tag: str, attributes: str, outer: _Frame) -> _Frame:
    main, other, header, reply, label = outer.main, outer.other, outer.header, outer.reply, outer.label
    names = set()
    if attributes and tag not in ("body", "html"):
        for value in _NAMES.findall(attributes):
            names.update(re.split(r"[^a-z0-9]+", value.lower()))
        if marked := re.search(r"data-label=(\d)", attributes):
            label = int(marked[1])
    reply = reply or bool(names & _REPLY_NAMES)
    if tag in _MAIN_TAGS and not reply:
        main, other, header = True, False, False
    else:
        main = main or bool(names & _MAIN_NAMES) and not names & _OTHER_NAMES
    if tag in _OTHER_TAGS or names & _OTHER_NAMES:
        other = True
    if tag == "header" or names & _HEADER_NAMES:
        header = True
    return _Frame(tag, main, other or reply, header, reply, outer.heading or tag in _HEADINGS, outer.paragraph or tag in _PARAGRAPHS, label)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    found: list[Block] = []
    stack = [_Frame("")]
    parts: list[str] = []
    linked: list[str] = []
    in_link, at, end = 0, 0, len(page)

    def close():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                f = stack[-1]
                links = len(html.unescape("".join(linked)).split())
                words = text.count(" ") + 1
                found.append(Block(text, words, min(links, words), f.main, f.other, f.header, f.heading, f.paragraph, f.label))
            parts.clear()
            linked.clear()

    def add(text):
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)

    tags = _Tags(page)
    while at < end:
        token = _START.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at:token.start()])
        if token[4] is None:
            over = page.find("-->" if token[1] else ">", token.end())
            at = end if over < 0 else over + (3 if token[1] else 1)
            continue
        over = tags.end(token.end())
        if over < 0:
            add("<")
            at = token.start() + 1
            continue
        tag, closing, attributes, at = token[4].lower(), bool(token[3]), page[token.end():over - 1], over
        if tag == "br":
            add(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
            if linked:
                linked.append(" ")
        elif tag in _INLINE:
            continue
        elif tag in _RAW:
            close()
            if not closing and not attributes.endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = over.end() if over else end
        elif tag in _VOID:
            close()
        elif closing:
            close()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            in_link = 0
        else:
            close()
            # an unclosed paragraph or heading ends where the next block begins
            while stack[-1].tag == "p" or stack[-1].tag in _HEADINGS:
                stack.pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
                stack.pop()
            stack.append(_enter(tag, attributes, stack[-1]))
            in_link = 0
    close()
    return found


def features(found: list[Block]) -> np.ndarray:
    """words, link density, the same of the previous and the next block; heading, of the block and of these two; is it marked as a
    paragraph."""
    if not found:
        return np.zeros((0, 10))
    words = np.array([b.words for b in found], float)
    own = np.column_stack([words, np.array([b.linked for b in found]) / words, [b.heading for b in found]]).astype(float)
    none = np.zeros((1, 3))
    before, after = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    return np.column_stack([own[:, :2], before[:, :2], after[:, :2], own[:, 2], before[:, 2], after[:, 2], [b.paragraph for b in found]]).astype(float)


def named_otherwise(found: list[Block]) -> np.ndarray:
    """Blocks that stand in a part which says by tag or name that it is not the article."""
    return np.array([b.other or (b.header and not b.main) for b in found], bool)


# --- labelled pages -----------------------------------------------------------------------

_SYLLABLES = "ba co de fi gu ha je ki lo mu ne po ra si tu vo".split()


def _text(draw: random.Random, low: int, high: int) -> str:
    """Invented words, as only their number counts."""
    return " ".join("".join(draw.choices(_SYLLABLES, k=draw.randint(1, 3))) for _ in range(draw.randint(low, high))) + "."


def _sample(seed: int) -> str:
    """A page: menu, short advert, title, paragraphs and lists, and a foot; data-label marks text (1) and the rest (0).

    In every other page all tags are div. A short unlinked line that follows links is never text unless it is a heading,
    nor is a short one at the very end unless it is marked as a paragraph; a page of one block is text.
    """
    draw = random.Random(seed)
    bare = seed % 2
    tag = lambda name: "div" if bare else name
    link = lambda low, high: f"<a href=/x>{_text(draw, low, high)}</a>"
    put = lambda name, label, text: f"<{tag(name)} data-label={label}>{text}</{tag(name)}>"
    if draw.random() < 0.08:
        return put("p", 1, _text(draw, 1, 30))
    out, menu = [], draw.choice([0, 3, 5, 8])
    out += [put("li", 0, link(1, draw.choice([1, 3, 5]))) for _ in range(menu)]
    advert = menu > 0 and draw.random() < 0.7
    if advert:
        out.append(put("div", 0, _text(draw, 3, 16)))
    title = draw.random() < 0.8 and (advert or not bare or not menu)
    if title:
        out.append(put("h1", 1, _text(draw, 2, 30)))
    paragraphs = draw.randint(1, 9)
    for n in range(paragraphs):
        low, high = draw.choice([(1, 8), (4, 20), (20, 60), (40, 120), (100, 400)])
        first, last = n == 0 and not title, n == paragraphs - 1 and (bare or draw.random() < 0.5)
        words = _text(draw, max(low, 24), max(high, 40)) if first or last else _text(draw, low, high)
        linked = f" {link(1, 4)} {_text(draw, 3, 9)}" if draw.random() < 0.2 and words.count(" ") > 20 else ""
        out.append(put("p", 1, words + linked))
        if not last and draw.random() < 0.15:
            out.append(put("h2", 1, _text(draw, 1, 8)))
        elif not last and draw.random() < 0.15:
            out += [put("li", 1, _text(draw, 1, 9)) for _ in range(draw.randint(1, 5))]
    foot = draw.random()
    if foot < 0.6:
        if not bare and draw.random() < 0.3 or draw.random() < 0.3:
            out[-1] = put("p", 1, _text(draw, 1, 20)) if paragraphs > 1 else out[-1]
        out.append(put("div", 0, _text(draw, 2, 18)))
    elif foot < 0.85:
        out += [put("div", 0, link(1, 10)) for _ in range(draw.randint(1, 6))]
    return "".join(out)


#: labelled pages that the tree is trained on
SAMPLES = [_sample(seed) for seed in range(240)]


class Node(NamedTuple):
    feature: int
    cut: float
    low: Node | int
    high: Node | int


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 16) -> Node | int:
    """A tree of the cuts that leave the least Gini impurity; on a draw the first feature, then the lowest cut."""
    if not len(labels):
        return 1
    if depth == 0 or labels.min() == labels.max():
        return int(labels.mean() >= 0.5)
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] < cut
            impurity = sum(side.sum() * labels[side].mean() * (1 - labels[side].mean()) for side in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, cut)
    if best is None:
        return int(labels.mean() >= 0.5)
    low = rows[:, best[1]] < best[2]
    return Node(best[1], float(best[2]), grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def train(samples: list[str] = SAMPLES) -> Node | int:
    """The tree for the labelled pages."""
    rows, labels = [], []
    for page in samples:
        found = blocks(page)
        known = np.array([b.label is not None for b in found], bool)
        rows.append(features(found)[known])
        labels += [b.label for b in found if b.label is not None]
    return grow(np.concatenate(rows), np.array(labels))


def classify(tree: Node | int, rows: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Node):
        return np.full(len(rows), bool(tree))
    out, low = np.zeros(len(rows), bool), rows[:, tree.feature] < tree.cut
    out[low], out[~low] = classify(tree.low, rows[low]), classify(tree.high, rows[~low])
    return out


def extract(pages: DataFrame, tree: Node | int) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page."""
    prepare(pages.sparkSession)

    def work(batch):
        texts = []
        for page in batch.column("html"):
            found = blocks(page.as_py() or "")
            keep = classify(tree, features(found)) & ~named_otherwise(found) if found else ()
            texts.append("\n\n".join(b.text for b, k in zip(found, keep) if k))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                          ["page_id", "url", "text", "n_chars"])

    return in_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), work, "page_id long, url string, text string, n_chars long")
