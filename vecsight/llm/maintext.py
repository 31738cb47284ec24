"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks: runs of text not broken by the start or end of a block element or
a line break.  Features of a block are the tags and class words of its ancestors and shape features
of its text; the chain has the labels text and no text, with weights for features and for
neighbouring labels.  It is fitted by gradient steps on the exact log likelihood
(forward-backward) and decoded by Viterbi.

Labelled pages: pages whose markup names their article label themselves.  Of each of a bounded
number of them, variants are laid out in other ways (other containers for the text, more kinds of
matter around it), so that the model also learns from text shape, class words and order and does
not hang on one element.  Extraction covers every page and its whole html and shuffles nothing.

Defined results: a null or empty html, or one without text, gives the empty text; character
references are decoded, white space inside a block becomes one space; scripts, styles, comments in
the markup and templates are never text; unclosed and stray tags are tolerated; columns named like
the results are replaced; an empty table gives no rows.  Without labelled pages nothing is known,
and every block is taken.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsight.llm.common import schema_with

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math meter q rb rp rt "
                    "ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                      "nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}}
_WORD = re.compile(r"[a-z]+")


class _Reader(HTMLParser):
    """Collects (ancestor marks, own tag, text, characters inside links) per leaf block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[tuple[tuple[str, ...], str, str, int]] = []
        self.text: list[str] = []
        self.linked = self.silent = self.links = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                marks = tuple(m for _, own in self.open for m in own)
                block = next((t for t, _ in reversed(self.open) if t not in _INLINE), "")
                self.blocks.append((marks, block, text, self.linked))
            self.text, self.linked = [], 0

    def _close(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.silent -= tag in _SILENT
            self.links -= tag == "a"
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE:
            self.flush()
        if tag in _VOID:
            return
        for at in range(len(self.open) - 1, -1, -1):
            above = self.open[at][0]
            if (above == "p" and tag in _CLOSES_P) or above in _SAME.get(tag, ()):
                self._close(at)
                break
            if above not in _INLINE and above != "p":
                break
        marks = [tag]
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                marks += ["." + w for w in _WORD.findall(value.lower())]
        self.open.append((tag, tuple(marks)))
        self.silent += tag in _SILENT
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag not in _INLINE:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str | None) -> list[tuple[tuple[str, ...], str, str, int]]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


def _bucket(x: float) -> int:
    return int(np.log2(x + 1) * 1.5)


def features(blocks) -> list[list[str]]:
    """Names of the features of every block of a page."""
    out = []
    for k, (marks, own, text, linked) in enumerate(blocks):
        words = text.count(" ") + 1
        ends = text[-1]
        names = {f"up:{m}" for m in marks}
        names |= {"bias", f"tag:{own}", f"words:{_bucket(words)}", f"linked:{min(4, int(4 * linked / len(text) + 0.99))}",
                  f"stop:{ends in '.!?…。'}", f"stops:{min(5, sum(map(text.count, '.!?')))}",
                  f"long:{_bucket(len(text) / words)}", f"first:{text[0].isupper()}", f"mark:{text[0] in '©®™|·»'}",
                  f"place:{5 * k // len(blocks)}", f"alone:{len(blocks) == 1}", f"tag:{own} words:{_bucket(words) // 3}"}
        if any(c in text for c in "©®·|"):
            names.add("sign")
        if any(c.isdigit() for c in text):
            names.add("digit")
        out.append(list(names))
    return out


class Chain:
    """Weights of a two-label chain: emissions by feature, transitions, start and end."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.emit = np.zeros((len(names) + 1, 2))  # the last row stays zero: padding and unknown features
        self.move, self.edge = np.zeros((2, 2)), np.zeros((2, 2))

    def scores(self, page: list[list[str]]) -> np.ndarray:
        return np.array([self.emit[[self.names[n] for n in block if n in self.names]].sum(0) for block in page])

    def decode(self, page: list[list[str]]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not page:
            return []
        s = self.scores(page).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = s[0][0] + self.edge[0, 0], s[0][1] + self.edge[0, 1]
        back = []
        for x, y in s[1:]:
            back.append((int(b + m10 > a + m00), int(b + m11 > a + m01)))
            a, b = x + max(a + m00, b + m10), y + max(a + m01, b + m11)
        label = int(b + self.edge[1, 1] > a + self.edge[1, 0])
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]], epochs: int = 12, rate: float = 0.05,
            penalty: float = 1e-4, batch: int = 64, seed: int = 0) -> Chain:
        """Adam steps on the log likelihood of ``labels``."""
        rng = np.random.default_rng(seed)
        none = len(self.names)
        coded = [[[self.names[n] for n in block if n in self.names] for block in page] for page in pages]
        params = [self.emit, self.move, self.edge]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(coded))
            for lo in range(0, len(order), batch):
                own = [k for k in order[lo:lo + batch] if coded[k]]
                if not own:
                    continue
                t = max(len(coded[k]) for k in own)
                width = max(len(b) for k in own for b in coded[k])
                index = np.full((len(own), t, width), none)
                gold = np.zeros((len(own), t), int)
                size = np.array([len(coded[k]) for k in own])
                for r, k in enumerate(own):
                    gold[r, :size[r]] = labels[k]
                    for i, b in enumerate(coded[k]):
                        index[r, i, :len(b)] = b
                slopes = self._slopes(index, gold, size)
                step += 1
                for p, g, m, v in zip(params, slopes, first, second):
                    g = g / len(own) - penalty * p
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
                self.emit[none] = 0
        return self

    def _slopes(self, index, gold, size):
        """Gradient of the log likelihood of a padded batch by forward-backward."""
        n, t, _ = index.shape
        s = self.emit[index].sum(2)
        live = np.arange(t)[None, :] < size[:, None]
        total = lambda x, axis: np.logaddexp.reduce(x, axis)
        ahead, behind = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        ahead[:, 0] = s[:, 0] + self.edge[0]
        for i in range(1, t):
            new = s[:, i] + total(ahead[:, i - 1, :, None] + self.move[None], 1)
            ahead[:, i] = np.where(live[:, i, None], new, ahead[:, i - 1])
        behind[:, -1] = self.edge[1]
        for i in range(t - 2, -1, -1):
            new = total(self.move[None] + (s[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
            behind[:, i] = np.where(live[:, i + 1, None], new, self.edge[1])
        z = total(ahead[:, -1] + self.edge[1], 1)
        one = np.exp(ahead + behind - z[:, None, None]) * live[:, :, None]
        truth = np.eye(2)[gold] * live[:, :, None]
        emit = np.zeros_like(self.emit)
        np.add.at(emit, index.reshape(n * t, -1), (truth - one).reshape(n * t, 1, 2))
        pair = np.exp(ahead[:, :-1, :, None] + self.move + (s + behind)[:, 1:, None, :] - z[:, None, None, None])
        both = live[:, 1:, None, None]
        move = (truth[:, :-1, :, None] * truth[:, 1:, None, :] * both - pair * both).sum((0, 1))
        last = size - 1
        rows = np.arange(n)
        edge = np.stack([(truth - one)[:, 0].sum(0), (truth - one)[rows, last].sum(0)])
        return emit, move, edge


# FIXED VALUES: containers that pages use for their text and for matter around it
_TEXT_HOLDERS = (("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".main", ".content"), ("div", ".post"),
                 ("div", ".entry", ".content"), ("div", ".article", ".body"), ("section", ".story"), ("div", ".text"), ("div",), ("section",))
_AROUND = (("nav", "ul", "li", "a"), ("header",), ("header", "nav", "a"), ("footer",), ("div", ".footer"), ("div", ".header"),
           ("aside",), ("aside", ".sidebar"), ("div", ".sidebar"), ("div", ".ad"), ("div", ".ads"), ("div", ".advert"),
           ("div", ".advertisement"), ("div", ".banner"), ("div", ".sponsored"), ("div", ".promo"), ("div", ".notice"),
           ("div", ".cookie", ".notice"), ("div", ".cookie", ".banner"), ("div", ".alert"), ("div", ".popup"), ("div", ".newsletter"),
           ("form",), ("form", "label"), ("form", "button"), ("ul", ".menu", "li", "a"), ("div", ".menu", "a"), ("div", ".related"),
           ("div", ".share"), ("div", ".breadcrumb"), ("div", ".comments"), ("section", ".comments"), ("div", ".comments", "div", ".comment"),
           ("div", ".comment"), ("section", ".comments", "article", ".comment"), ("ol", ".comments", "li", ".comment"), ("div", ".widget"),
           ("div", ".tags"), ("div", ".meta"), ("div", ".disclaimer"), ("div", ".legal"), ("div", ".login"), ("div", ".subscribe"))
_BEFORE = ("nav", "header", ".header", ".menu", ".breadcrumb", ".cookie", ".banner", ".ad", ".ads", ".notice", ".alert", ".popup")


def own_labels(blocks) -> list[int] | None:
    """Labels of a page whose markup names its article; None if it doesn't."""
    inside = [("article" in b[0] or "main" in b[0]) and not _is_around(b[0]) for b in blocks]
    return [int(x) for x in inside] if any(inside) else None


_NAMES_AROUND = frozenset(m for holder in _AROUND for m in holder if m not in ("div", "ul", "ol", "li", "a", "section", "article", ".body"))


def _is_around(marks) -> bool:
    return any(m in _NAMES_AROUND for m in marks)


def variant(blocks, labels, strays: list[str], rng) -> tuple[list, list[int]]:
    """The page's text laid out in another way, among other matter."""
    holder = _TEXT_HOLDERS[rng.integers(len(_TEXT_HOLDERS))]
    text = []
    for (marks, own, words, linked), label in zip(blocks, labels):
        if label:
            tags = [m for m in marks if m in ("h1", "h2", "h3", "p", "b", "blockquote", "ul", "li", "pre")]
            text.append((("html", "body", *holder, *tags), own, words, linked))
    before, after = [], []
    for _ in range(rng.integers(1, 8)):
        around = _AROUND[rng.integers(len(_AROUND))]
        linked = "a" in around
        inner = () if linked or rng.random() < 0.5 else ("p",)
        side = before if rng.random() < (0.8 if any(m in _BEFORE for m in around) else 0.2) else after
        for _ in range(rng.integers(1, 6)):
            words = strays[rng.integers(len(strays))]
            if linked or rng.random() < 0.3:
                words = " ".join(words.split()[:rng.integers(1, 4)])
            tags = ("html", "body", *around, *inner)
            side.append((tags, next(t for t in reversed(tags) if t[0] != "." and t not in _INLINE), words, len(words) if linked else 0))
    if rng.random() < 0.7:
        before.insert(0, (("html", "head", "title"), "title", text[0][2][:60].strip() or "-", 0))
    if rng.random() < 0.3 and len(text) > 2:  # matter in the midst of the text
        at = int(rng.integers(1, len(text)))
        around = _AROUND[rng.integers(len(_AROUND))]
        tags = ("html", "body", *holder, *around)
        extra = (tags, next(t for t in reversed(tags) if t[0] != "." and t not in _INLINE), strays[rng.integers(len(strays))], 0)
        return before + text[:at] + [extra] + text[at:] + after, [0] * len(before) + [1] * at + [0] + [1] * (len(text) - at) + [0] * len(after)
    return before + text + after, [0] * len(before) + [1] * len(text) + [0] * len(after)


def fit(htmls: list[str], variants: int = 3, seed: int = 0) -> Chain | None:
    """Fit on pages that label themselves, and on variants of them; None if there is none."""
    rng = np.random.default_rng(seed)
    pages, labels, strays = [], [], []
    for html in htmls:
        blocks = leaf_blocks(html)
        known = own_labels(blocks)
        if known:
            pages.append(blocks)
            labels.append(known)
            strays += [b[2] for b, y in zip(blocks, known) if not y]
            # other matter may read like text as well: sentences of some pages serve as such on others
            strays += [b[2] for b, y in zip(blocks, known) if y][:2]
    if not pages:
        return None
    strays, own = strays or ["-"], list(pages)
    for _ in range(variants):
        for blocks, known in list(zip(pages[:len(own)], labels[:len(own)])):
            laid, marks = variant(blocks, known, strays, rng)
            pages.append(laid)
            labels.append(marks)
    named = [features(p) for p in pages]
    seen: dict[str, int] = {}
    for page in named:
        for block in page:
            for name in block:
                seen[name] = seen.get(name, 0) + 1
    names = {n: k for k, n in enumerate(sorted(n for n, c in seen.items() if c > 2))}
    return Chain(names).fit(named, labels, seed=seed)


def main_text(html: str | None, chain: Chain | None) -> str:
    blocks = leaf_blocks(html)
    keep = chain.decode(features(blocks)) if chain else [1] * len(blocks)
    return " ".join(b[2] for b, y in zip(blocks, keep) if y)


def extract(pages: DataFrame, html: str = "html", sample: int = 500, longest: int = 200_000,
            key: str = "page_id") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars``; fitted on at most ``sample`` pages of
    at most ``longest`` characters, in hash order of their ids."""
    shown = pages.select(F.col(f"`{html}`").cast("string").alias("h"), F.col(key).alias("k")).where(
        f"length(h) <= {longest} AND (h LIKE '%<article%' OR h LIKE '%<main%')")
    # the ids are chosen first, so that tasks send ids and not pages to be compared
    ids = shown.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(sample)
    chosen = shown.join(F.broadcast(ids), "k").groupBy("k").agg(F.min("h").alias("h")).orderBy("k").collect()
    chain = pages.sparkSession.sparkContext.broadcast(fit([r.h for r in chosen]))
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    own = pages.select(*[f"`{c}`" for c in others], F.col(f"`{html}`").cast("string").alias("__html"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                texts = [main_text(h.as_py(), chain.value) for h in some.column("__html")]
                left = some.drop_columns(["__html"])
                yield pa.RecordBatch.from_arrays([*left.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                                 [*left.schema.names, "text", "n_chars"])

    return own.mapInArrow(run, schema_with(own.drop("__html"), "text string, n_chars bigint"))
