"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

Method
------
* A page is its sequence of leaf blocks (``html_blocks``). Each has features of its ancestors (tags, words of
  their classes, ids and roles), its own tag, and its text (length, share of links, punctuation, legal
  marks, place in the page), hashed to ``2 ** bits`` cells.
* A linear chain with the labels main text and boilerplate scores a labelling by the features' weights and the
  transitions between neighbours. Weights are learned by stochastic gradient on the
  exact log-likelihood (forward-backward); pages are decoded by Viterbi.

Labelled pages: those with main text in an ``article`` or ``main`` element are labelled by it, less what nested
landmarks set apart (navigation, headers and footers of the page, asides, forms, comments). All pages of the table are looked
through; the sample is the ``max_pages`` distinct labelled ones of the smallest hashes. Each is also laid out anew, its blocks in
other containers with known labels (``relayout``), so that the field learns layouts without landmarks as well.
Training is one task over that sample; its weights (``2 ** bits`` numbers) are broadcast.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm.common import bounded_batches, by_bytes, table, with_row
from priorwise.llm.html_blocks import Block, leaf_blocks
from priorwise.llm.registry import register

_APART = {"nav", "aside", "footer", "form", "header", "menu", "dialog", "button", "select"}
_APART_NAMES = {"comments", "comment", "ad", "ads", "advert", "advertisement", "sidebar", "menu", "nav", "notice", "cookie",
                "banner", "newsletter", "related", "share", "social", "promo", "sponsored", "breadcrumb", "login", "popup"}

# containers of the layouts that labelled pages are laid out in: (tag, attribute) of main text ...
_MAIN = [("article", ""), ("main", ""), ("main", 'id="content"'), ("div", 'class="content"'), ("div", 'id="main"'),
         ("div", 'class="post-body"'), ("div", 'class="entry-content"'), ("section", 'class="story"'),
         ("div", 'class="article-text"'), ("div", 'class="text"'), ("td", ""), ("div", 'role="main"'), ("div", 'class="post"'),
         ("div", ""), ("div", ""), ("div", 'class="{}"'), ("div", 'id="{}"'), ("section", 'class="{}"'), ("", ""), ("", "")]
# ... and of boilerplate: before, after or amid the main text
_BOILER = {
    "menu": [("nav", ""), ("div", 'class="menu"'), ("ul", 'id="nav"'), ("div", 'class="navbar"'), ("div", 'role="navigation"'),
             ("div", 'class="breadcrumb"')],
    "head": [("header", ""), ("div", 'id="header"'), ("div", 'class="masthead"'), ("div", 'class="site-title logo"')],
    "side": [("aside", ""), ("div", 'class="sidebar"'), ("div", 'class="widget related"'), ("section", 'class="recommended"'),
             ("div", 'id="side"')],
    "ad": [("div", 'class="ad"'), ("div", 'class="advert"'), ("div", 'class="sponsored promo"'), ("div", 'class="ads banner"'),
           ("div", 'id="advertisement"')],
    "notice": [("div", 'class="cookie-notice"'), ("div", 'class="notice"'), ("div", 'class="alert banner"'),
               ("div", 'id="gdpr" class="consent popup"'), ("p", 'class="notice"'), ("dialog", "")],
    "form": [("form", ""), ("div", 'class="newsletter subscribe"'), ("div", 'class="search"'), ("div", 'class="login"'),
             ("fieldset", "")],
    "comments": [("section", 'class="comments"'), ("div", 'id="comments"'), ("ol", 'class="comment-list"'),
                 ("div", 'class="comment"'), ("div", 'class="discussion replies"'), ("section", 'id="disqus" class="responses"')],
    "foot": [("footer", ""), ("div", 'id="footer"'), ("div", 'class="copyright legal"'), ("div", 'class="share social"')],
}


def _path_features(tags: tuple[str, ...], names: tuple[str, ...]) -> list[str]:
    """Features of a block's ancestors."""
    tag, parent = tags[-1] if tags else "", tags[-2] if len(tags) > 1 else ""
    return ["bias", f"tag={tag}", f"parent={parent}", *(f"in={t}" for t in sorted(set(tags))),
            *(f"name={w}" for w in sorted(set(names)))]


def _text_features(b: Block, first: bool, last: bool) -> list[str]:
    """Features of a block's text and place."""
    size, tag = len(b.text), b.tags[-1] if b.tags else ""
    words = min(b.text.count(" ") + 1, 200).bit_length()
    out = [f"words={words}", f"tag={tag} words={words}", f"links={min(b.linked * 4 // size, 4)}",
           f"stop={b.text[-1] in '.!?…:'}", f"upper={b.text[0].isupper()}", f"commas={min(b.text.count(','), 3)}"]
    if first or last:
        out.append("first" if first else "last")
    if "©" in b.text[:40] or "(c)" in b.text[:40].lower():
        out.append("legal")
    return out


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Features of each block."""
    return [_path_features(b.tags, b.names) + _text_features(b, i == 0, i == len(blocks) - 1) for i, b in enumerate(blocks)]


def feature_cells(features: list[list[str]], bits: int) -> list[np.ndarray]:
    """Features hashed to their cells."""
    return [np.array([zlib.crc32(x.encode()) & (1 << bits) - 1 for x in f]) for f in features]


class Crf:
    """Two labels: 1 is main text. Weights are of label 1 against label 0."""

    def __init__(self, bits: int = 18):
        self.bits = bits
        self.w, self.moves, self.start = np.zeros(1 << bits), np.zeros((2, 2)), np.zeros(2)
        self.weight_of: dict[str, float] = {}  # of features met, and of paths met: decoding only
        self.path_weight: dict[tuple, float] = {}

    def emissions(self, cells: list[np.ndarray]) -> list[float]:
        w = self.w
        return [float(w[c].sum()) for c in cells]

    def _weight(self, features: list[str]) -> float:
        get, total = self.weight_of.get, 0.0
        for x in features:
            if (v := get(x)) is None:
                v = self.weight_of[x] = float(self.w[zlib.crc32(x.encode()) & (1 << self.bits) - 1])
            total += v
        return total

    def label(self, blocks: list[Block]) -> list[int]:
        """Labels of a page's blocks."""
        if len(self.weight_of) + len(self.path_weight) > 200_000:
            self.weight_of.clear()
            self.path_weight.clear()
        scores, last = [], len(blocks) - 1
        for i, b in enumerate(blocks):
            path = (b.tags, b.names)
            if (v := self.path_weight.get(path)) is None:
                v = self.path_weight[path] = self._weight(_path_features(*path))
            scores.append(v + self._weight(_text_features(b, i == 0, i == last)))
        return self.decode(scores)

    def decode(self, emissions: list[float]) -> list[int]:
        """Viterbi."""
        if not emissions:
            return []
        (a00, a01), (a10, a11) = self.moves.tolist()
        v0, v1 = self.start[0], self.start[1] + emissions[0]
        back = []
        for e in emissions[1:]:
            b0, b1 = v1 + a10 > v0 + a00, v1 + a11 > v0 + a01
            v0, v1 = (v1 + a10 if b0 else v0 + a00), (v1 + a11 if b1 else v0 + a01) + e
            back.append((int(b0), int(b1)))
        label = int(v1 > v0)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[np.ndarray], list[int]]], epochs: int, rate: float = 0.2, l2: float = 1e-4) -> None:
        """AdaGrad on the negative log-likelihood, a page a step."""
        seen_w, seen_m, seen_s = np.full(len(self.w), 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
        for _ in range(epochs):
            for cells, labels in pages:
                one, pairs, first = self._marginals(self.emissions(cells))
                g = np.zeros(len(self.w))
                for c, p, y in zip(cells, one, labels):
                    g[c] += p - y
                used = np.unique(np.concatenate(cells))
                gw = g[used] + l2 * self.w[used]
                gm, gs = pairs, first
                for a, b in zip(labels, labels[1:]):
                    gm[a, b] -= 1
                gs[labels[0]] -= 1
                seen_w[used] += gw * gw
                seen_m += gm * gm
                seen_s += gs * gs
                self.w[used] -= rate * gw / np.sqrt(seen_w[used])
                self.moves -= rate * gm / np.sqrt(seen_m)
                self.start -= rate * gs / np.sqrt(seen_s)

    def _marginals(self, emissions: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward: chances of label 1, expected transitions, chances of the first label."""
        n = len(emissions)
        e = np.zeros((n, 2))
        e[:, 1] = emissions
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = self.start + e[0]
        for t in range(1, n):
            ahead[t] = np.logaddexp(ahead[t - 1, 0] + self.moves[0], ahead[t - 1, 1] + self.moves[1]) + e[t]
        for t in range(n - 2, -1, -1):
            ahead_of = self.moves + e[t + 1] + behind[t + 1]
            behind[t] = np.logaddexp(ahead_of[:, 0], ahead_of[:, 1])
        total = np.logaddexp(*ahead[-1])
        chances = np.exp(ahead + behind - total)
        pairs = np.exp(ahead[:-1, :, None] + self.moves + (e[1:] + behind[1:])[:, None, :] - total).sum(0)
        return chances[:, 1], pairs, chances[0].copy()


def landmark_labels(blocks: list[Block]) -> list[int] | None:
    """Labels from ``article`` or ``main`` elements; None for a page without them."""
    if not any(t in ("article", "main") for b in blocks for t in b.tags):
        return None
    out = []
    for b in blocks:
        at = next((i for i, t in enumerate(b.tags) if t in ("article", "main")), None)
        out.append(int(at is not None and not _APART & set(b.tags[at + 1:]) and not _APART_NAMES & set(b.names)))
    return out


def relayout(blocks: list[Block], labels: list[int], rng: random.Random) -> tuple[str, list[int]]:
    """The page's main text in another layout, amid boilerplate of many kinds, with the labels of its blocks."""
    main = [b.text for b, y in zip(blocks, labels) if y]
    spare = [t for b, y in zip(blocks, labels) if not y for t in [b.text]] or ["Home"]
    words = " ".join(main + spare).split()
    parts: list[tuple[str, int]] = []  # markup and how many blocks of which label: (markup, label), one block each

    sentences = [x for t in main + spare for x in re.split(r"(?<=[.!?]) ", t)]

    def say(low: int, high: int) -> str:
        if high > 10 and rng.random() < 0.6:  # whole sentences, as an article has them
            return escape(" ".join(rng.choices(sentences, k=rng.randint(1, 4))))
        n, at = rng.randint(low, high), rng.randrange(len(words))
        return escape(" ".join((words[at:] + words)[:n])) or "Home"

    def boiler(kind: str) -> None:
        tag, attr = rng.choice(_BOILER[kind])
        opening = f"<{tag} {attr}>" if attr else f"<{tag}>"
        n = {"menu": rng.randint(2, 8), "comments": rng.randint(1, 5), "side": rng.randint(1, 4)}.get(kind, rng.randint(1, 2))
        if tag == "p":
            n = 1
        for i in range(n):
            if kind in ("menu", "side") and rng.random() < 0.8:
                inner = f'<a href="/{i}">{say(1, 5)}</a>'
            elif kind == "comments":
                inner = say(4, 60)
            elif kind == "foot":
                inner = rng.choice(["&copy; ", "", ""]) + say(2, 14)
            elif kind == "form":
                inner = f"<label>{say(1, 4)}</label><input name=q>"
            else:
                inner = say(2, 25)
            wrap = "" if tag == "p" else "li" if tag in ("ul", "ol") or kind == "menu" else rng.choice(["p", "div"])
            if tag not in ("ul", "ol", "p") and kind == "menu" and wrap == "li":
                inner = f"<ul><li>{inner}</li></ul>"
                wrap = ""
            # the opening of the container goes with its first block, its end with the last
            block = f"<{wrap}>{inner}</{wrap}>" if wrap else inner
            if n == 1 and not wrap and tag != "p":
                block = inner
            parts.append(((opening if i == 0 else "") + block + (f"</{tag}>" if i == n - 1 else ""), 0))

    before = rng.sample(["menu", "head", "ad", "notice", "form", "side"], rng.randint(0, 4))
    after = rng.sample(["side", "comments", "ad", "form", "foot", "notice"], rng.randint(0, 4))
    for kind in before:
        boiler(kind)
    tag, attr = rng.choice(_MAIN)
    attr = attr.format(f"{rng.choice(words)}-{rng.choice(words)}".replace('"', ""))  # a name that tells nothing
    table = tag == "td"
    opening = "" if not tag else "<table><tr><td>" if table else f"<{tag} {attr}>" if attr else f"<{tag}>"
    closing = "</td></tr></table>" if table else f"</{tag}>" if tag else ""
    parts.append((opening, -1))
    heading = rng.choice(["h1", "h2", "p"])
    for i, text in enumerate(main):
        inner = escape(text)
        if rng.random() < 0.1:
            inner = f"<a href='/x'>{inner}</a>" if len(text) < 30 else f"<b>{inner}</b>"
        wrap = heading if i == 0 else rng.choices(["p", "div", "li", "blockquote", "h3", "pre"], [80, 6, 5, 4, 4, 1])[0]
        parts.append((f"<ul><li>{inner}</li></ul>" if wrap == "li" else f"<{wrap}>{inner}</{wrap}>", 1))
        if 0 < i < len(main) - 1 and rng.random() < 0.06:
            boiler(rng.choice(["ad", "notice", "side", "form"]))
    if rng.random() < 0.3:
        boiler("comments")  # inside the article
    parts.append((closing, -1))
    if rng.random() < 0.4:
        boiler("comments")  # right after it
    for kind in after:
        boiler(kind)
    page = "".join(p for p, _ in parts)
    if rng.random() < 0.5:
        page = f'<div {rng.choice(["", 'class="page"', 'class="wrapper container"', 'id="layout"'])}>{page}</div>'
    return f"<html><body>{page}</body></html>", [y for _, y in parts if y >= 0]


def labelled_pages(pages: list[str | None], layouts: int, bits: int) -> list[tuple[list[np.ndarray], list[int]]]:
    """Features and labels of the pages that have landmarks, and of their new layouts."""
    out = []
    for i, page in enumerate(pages):
        blocks = leaf_blocks(page)
        labels = landmark_labels(blocks)
        if not labels or not any(labels):
            continue
        out.append((feature_cells(block_features(blocks), bits), labels))
        for j in range(layouts):
            again, wanted = relayout(blocks, labels, random.Random(1000 * i + j))
            found = leaf_blocks(again)
            if len(found) == len(wanted):  # a layout whose blocks run together is no example
                out.append((feature_cells(block_features(found), bits), wanted))
    return out


def training_pages(pages: DataFrame, html_col: str = "html", max_pages: int = 300) -> DataFrame:
    """html of the ``max_pages`` distinct pages with main text by landmarks whose hashes are smallest, of the whole table."""
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("boolean")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in by_bytes(batches):
            yield pd.Series([any(landmark_labels(leaf_blocks(p)) or ()) for p in some], dtype=bool)

    html = F.col(f"`{html_col}`")
    known = pages.select(html.alias("html"), F.xxhash64(html).alias("place")).where(F.col("html").rlike("(?i)<(article|main)"))
    # copies fold by their hash, so that only hashes are shuffled
    places = [r["place"] for r in known.where(labelled("html")).select("place").distinct().orderBy("place").limit(max_pages).collect()]
    # other pages may share a hash: they are looked at again
    return known.where(F.col("place").isin(places)).distinct().where(labelled("html")) \
        .orderBy("place", "html").limit(max_pages).select("html")


def train_crf(pages: DataFrame, html_col: str = "html", max_pages: int = 300, layouts: int = 6, epochs: int = 5,
              bits: int = 18) -> Crf:
    """Field trained on a bounded sample of labelled pages. Without any in the table nothing is learned: all is boilerplate."""
    sample = training_pages(pages, html_col, max_pages)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = sorted(t for f in frames for t in f["html"])
        crf = Crf(bits)
        examples = labelled_pages(texts, layouts, bits)
        random.Random(5).shuffle(examples)
        crf.train(examples, epochs)
        yield pd.DataFrame({"w": [crf.w.tobytes()], "moves": [crf.moves.tobytes()], "start": [crf.start.tobytes()]})

    crf = Crf(bits)
    for r in sample.coalesce(1).mapInPandas(learn, "w binary, moves binary, start binary").collect():
        crf.w, crf.moves, crf.start = np.frombuffer(r["w"]), np.frombuffer(r["moves"]).reshape(2, 2), np.frombuffer(r["start"])
    return crf


def main_text(page: str | None, crf: Crf) -> str:
    """Main blocks of a page, joined by line ends."""
    blocks = leaf_blocks(page)
    return "\n".join([b.text for b, y in zip(blocks, crf.label(blocks)) if y])


def extract_main_text(pages: DataFrame, crf: Crf, html_col: str = "html") -> DataFrame:
    """The input rows as ``row`` with ``text``.

    Defined results: null, empty and text-free pages have an empty text; a page of plain text is one block without
    ancestors; a cut-off page is read as far as it goes; repeated pages have equal texts; an empty table
    gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(crf)
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in by_bytes(batches):
            yield pd.Series([main_text(p, shared.value) for p in some], dtype=object)

    return with_row(pages, text=extract(F.col(f"`{html_col}`")))


@register("op4_html_extract")
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract_main_text(pages, train_crf(pages))
    return out.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
