"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A tolerant tokenizer walks the markup, keeps the stack of open block elements, and cuts the text into leaf
blocks, in page order. Each block has features of its ancestors (tags, names in class, id
and role) and of its text (length, share of links, punctuation, notices). The field is trained on
labelled pages; Viterbi labels a page's blocks as article or not.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.chain import Crf, viterbi
from deltaloom.llm.common import add_fields, slices, texts_of
from deltaloom.llm.html_pages import labelled_pages

#: Comments, declarations and tags. A tag with a quote that is never closed ends at its first ">".
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|data-main|hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article nav header footer aside main form fieldset legend blockquote pre figure figcaption "
    "address details summary select option button dialog hr center menu".split()
)
#: Elements whose text is no page text, up to their end tag: noscript is part of a page's scripts. What math, svg, object and canvas hold is text like any other.
RAW = frozenset("script noscript style title textarea template iframe noembed noframes".split())
#: Elements whose text is shown as it stands, up to their end tag.
VERBATIM = frozenset(["xmp", "listing"])
VOID = frozenset("hr br img input meta link wbr area base col embed source track".split())
#: A start tag of the key closes the nearest open element of the values, within the nearest of the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
WORDS = re.compile(r"[a-z]+")
NOTICES = re.compile(r"©|copyright|all rights reserved|cookie|subscri|newsletter|advertis|sponsor|privacy|terms of|log ?in|sign ?up|\breply\b|\bcomments?\b|\bshare\b|posted by", re.I)


class Place:
    """An open block element. Features of its ancestors are held once for all that share them, so depth costs nothing."""

    __slots__ = ("tag", "parent", "held", "inner", "label", "_features")

    def __init__(self, tag: str, names: tuple[str, ...], label: int | None, parent: Place | None, known: Collection[str] | None):
        own = {f"name={x}" for x in names if len(x) > 1} | ({f"under={tag}"} - {"under=html", "under=body", "under=p"})
        if known is not None:
            own &= known
        above = parent.held if parent else frozenset()
        self.tag, self.parent, self.held = tag, parent, above if own <= above else above | own
        # the element right below the innermost article or main; None outside of these
        self.inner = "" if tag in FRAMES else None if parent is None or parent.inner is None else parent.inner or tag
        self.label = label if label is not None else parent.label if parent else 0
        self._features: tuple[str, ...] | None = None

    def features(self) -> tuple[str, ...]:
        if self._features is None:
            own = {f"leaf={self.tag}", f"parent={self.parent.tag if self.parent else 'none'}"}
            if self.inner is not None:
                own |= {"framed", f"in-article={self.inner}"}
            self._features = tuple(sorted(self.held | own))
        return self._features


FRAMES = ("article", "main")
OUTSIDE = ("leaf=none", "parent=none")


@dataclass
class Block:
    text: str
    place: Place | None  # the innermost open block element
    linked: int  # characters within links

    @property
    def label(self) -> int:
        """Of training pages."""
        return self.place.label if self.place else 0

    @property
    def path(self) -> tuple[str, ...]:
        """Features that the block has from its ancestors."""
        return self.place.features() if self.place else OUTSIDE


def names_of(attributes: str) -> tuple[tuple[str, ...], int | None]:
    """Names in class, id and role, and the label that a training page gives."""
    names, label = [], None
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value, key = a or b or c, key.lower()
        if key == "data-main":
            label = int(value == "1")
        elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
            names.append("hidden")
        elif key != "style":
            names += WORDS.findall(value.lower())
    return tuple(dict.fromkeys(names)), label


names_of = lru_cache(maxsize=65536)(names_of)


def blocks_of(page: str, known: Collection[str] | None = None) -> list[Block]:
    """The leaf blocks of a page that have text, with those features of their ancestors that are ``known`` (None: all).

    Unclosed and misnested elements are tolerated, at any depth; an unclosed comment or raw element lasts to the end.
    """
    out: list[Block] = []
    stack: list[Place] = []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = link = at = 0
    n = len(page)

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            pieces.append(raw)
            linked += len(raw) if link else 0

    def close(tags: Collection[str], bounds: Collection[str] = ()) -> None:
        """Close the nearest open element of ``tags`` with all that it holds, unless one of ``bounds`` is nearer."""
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in bounds:
                    return
                if stack[i].tag in tags:
                    for x in stack[i:]:
                        opened[x.tag] -= 1
                    del stack[i:]
                    return

    while at < n:
        m = TOKEN.search(page, at)
        raw = page[at:] if m is None else page[at : m.start()]
        take(html.unescape(raw) if "&" in raw else raw)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW or tag in VERBATIM:
            if not closing and not (tag in RAW and m[3].endswith("/")):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                if tag in VERBATIM:
                    take(page[at : end.start() if end else n])
                at = end.end() if end else n
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            link = not closing
        elif tag in BLOCKS:
            end_block()
            if closing:
                close((tag,))
                continue
            if stack and stack[-1].tag == "p":
                close(("p",))
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag not in VOID:
                names, label = names_of(m[3])
                stack.append(Place(tag, names, label, stack[-1] if stack else None, known))
                opened[tag] += 1
    end_block()
    return out


def text_features(b: Block, i: int, n: int) -> list[str]:
    size, words = len(b.text), b.text.count(" ") + 1
    share = b.linked / size
    out = [f"size={min(9, size.bit_length())}", f"words={min(7, words.bit_length())}", f"links={0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}"]
    if b.text[-1] in ".!?":
        out.append("ends-sentence")
    if size < 200 and NOTICES.search(b.text):
        out.append("notice")
    if i < 2:
        out.append("early")
    if i >= n - 2:
        out.append("late")
    return out


@dataclass
class Model:
    crf: Crf
    names: dict[str, int]

    def blocks(self, page: str) -> list[Block]:
        return blocks_of(page, self.names.keys())

    def rows(self, pages: list[list[Block]]) -> np.ndarray:
        """Numbers of the known features of every block, padded to the longest row by 0."""
        get = self.names.get
        out = [[k for f in (*b.path, *text_features(b, i, len(blocks))) if (k := get(f))] for blocks in pages for i, b in enumerate(blocks)]
        width = max(map(len, out), default=0)
        return np.array([r + [0] * (width - len(r)) for r in out], np.int64).reshape(len(out), width)

    def main_blocks(self, pages: list[list[Block]]) -> np.ndarray:
        """Whether each block of all pages, in order, belongs to its page's article."""
        lengths = np.array([len(p) for p in pages], np.int64)
        return viterbi(self.crf.scores(self.rows(pages)), lengths, self.crf.trans) == 1

    @classmethod
    def fit(cls, pages: list[str]) -> Model:
        """Of pages whose elements say in ``data-main`` what belongs to the article (innermost counts; 0 without)."""
        parsed = [blocks_of(p) for p in pages]
        seen: dict[str, int] = {}
        for blocks in parsed:
            for i, b in enumerate(blocks):
                for f in (*b.path, *text_features(b, i, len(blocks))):
                    seen[f] = seen.get(f, 0) + 1
        model = cls(Crf(np.zeros(1), np.zeros((2, 2))), {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= 5), 1)})
        labels = np.array([b.label for p in parsed for b in p], np.int64)
        model.crf = Crf.fit(model.rows(parsed), labels, np.array([len(p) for p in parsed]), len(model.names) + 1, rounds=80)
        return model


@lru_cache(maxsize=1)
def default_model() -> Model:
    """Trained on the invented pages, once in a process."""
    return Model.fit(labelled_pages())


FIELDS = "text string, n_chars bigint, n_blocks bigint"


def extract(pages: DataFrame, model: Model | None = None, *, html_col: str = "html") -> DataFrame:
    """Add text (the article's blocks joined by two line feeds; empty if there are none), n_chars and n_blocks (of the whole page) to every row.

    Null and empty pages give an empty text. Ties between labels go to "not article". Very long pages are read whole;
    repeated rows get equal results, no rows give no rows. Columns of these names are replaced, all others stay.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf(FIELDS)
    def main_text(column: pd.Series) -> pd.DataFrame:
        m, sources, out = shared.value, texts_of(column), []
        for part in slices(map(len, sources)):
            parsed = [m.blocks(p) for p in sources[part]]
            keep, at = m.main_blocks(parsed), 0
            for blocks in parsed:
                text = "\n\n".join(b.text for b, k in zip(blocks, keep[at : at + len(blocks)], strict=True) if k)
                at += len(blocks)
                out.append((text, len(text), len(blocks)))
        return pd.DataFrame(out, columns=["text", "n_chars", "n_blocks"])

    return add_fields(pages, main_text(F.col(f"`{html_col}`")), ["text", "n_chars", "n_blocks"])
