"""Operator 3: main text of HTML pages from flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. A block's features are its word count and
link density and those of the blocks before and after it, and some hints from its ancestors: an
article or main element, a boilerplate element such as nav or footer, a boilerplate class or
id, a heading, outside the article of a page that has one. A decision tree marks
each block as article or not. It is grown here on a small labelled table: hand-labelled page layouts,
each drawn at several sizes. Its first SHAPE_DEPTH questions are about words and links;
only then may hints be asked, so that a name alone never decides.

A class or id is boilerplate if its words are all known and one of them names boilerplate
(`cookie-notice`, `site-footer`; not `has-sidebar` or `market-share-report`). Those of html,
body and main say nothing, and main takes back what a wrapper's name said.

Defined cases: a null or empty html and one without article blocks give an empty text;
a null url stays null; markup may be cut off anywhere (a tag cut off at the end is
dropped, text is kept); scripts, styles and other raw text are skipped whole, also when they
hold angle brackets; an unclosed head ends at the first tag that can't stand in it, an
unclosed button, select, svg or math at the next block or with its parent, an unclosed object,
canvas, template or noscript with its parent; equal rows give equal rows; repeated ids and ties
play no part; an empty table gives an empty result; other columns are not read. Time is
linear in the page, pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?:/?[a-zA-Z][^<]*)\Z", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLANK = re.compile(r"\s+")
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# HTML's elements by what they do to text.
RAW = frozenset("script style textarea iframe".split())
HIDDEN_INLINE = frozenset("button select svg math".split())
HIDDEN_FLOW = frozenset("object canvas template noscript".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header main menu nav ol section span table td tr ul li p h1 h2 h3 h4 h5 h6".split()) | HIDDEN_INLINE | HIDDEN_FLOW
CLOSES_ITSELF = frozenset("p li td tr".split()) | HEADINGS
ARTICLE = frozenset("article main".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
NAMELESS = frozenset("html body main".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup "
    "promo promoted promotion related reply replies respond responses share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription teaser toolbar widget widgets".split()
)
#: Words that a boilerplate name may be joined with.
PLAIN_NAMES = frozenset(
    "area article articles author bar block body bottom box button buttons container content entry global icons inner item items left "
    "links list main message meta outer page policy post posts primary reader readers right secondary section side site slot stories "
    "text thread top user users wp wrap wrapper".split()
)

SHAPE = ("words", "links", "words_before", "links_before", "words_after", "links_after")
HINTS = ("article", "element", "named", "heading", "outside")
FEATURES = SHAPE + HINTS
SHAPE_DEPTH = 3

#: What the letters of LAYOUTS stand for: hints, label, and a link density of its own.
KINDS = {
    "a": ("article", 1, None), "h": ("article heading", 1, 0.0), "d": ("article named", 0, None), "g": ("article named heading", 0, 0.0), "e": ("article element", 0, None),
    "n": ("element", 0, None), "N": ("element outside", 0, None), "m": ("named", 0, None), "M": ("named outside", 0, None), "k": ("heading element", 0, 0.0), "K": ("heading element outside", 0, 0.0),
    "o": ("outside", 0, None), "O": ("heading outside", 0, None),
    "p": ("", 1, None), "q": ("heading", 1, 0.0), "b": ("", 0, None), "c": ("heading named", 0, 0.0), "C": ("heading named outside", 0, 0.0),
}

#: The labelled table: blocks of hand-labelled pages in their order. A block is a kind of KINDS, its size
#: (t: 1-2 words, s: 3-6, m: 7-14, l: 15-40, x: 41-250) and its link density in tenths.
LAYOUTS = """
Nt9 Nt9 Nt9 Nt9 Mm0 hm0 ax0 al0 ax0 al0 am0 Nm0
Nt9 Nt9 Ms0 hs0 al0 al0 Nl0
Nt9 Nt9 Nt9 Ml0 hm0 ax0 Nm0
Nt9 Ml0 hl0 ax0 ax0 ax0 Ns0
Ns0 Nt9 Nt9 Mm1 hs0 am0 al0 dl0 ax1 al0 dm0 al0 gt0 dl0 dl0 Nt0 Ns3
Ks0 Nt9 Nt9 hs0 ax0 hs0 al0 am0 as0 at0 am0 al0 hs0 al3 ax0 ds9 ds9 ds9 Nl0 Nt9
hs0 at0 as0 al0 am9 al0 at9 al0 as9 ax1 es0 et9 el0 Nt9 Nt9
Nt9 ht0 as0 as0 as0 as0 as0 am0 at0 Ns0
Ns9 Ns9 hm0 al0 ex0 al0 dx0 al0 al0 gs0 dx0 dl0 dx0 Cs0 Ml0 Mx0 Ml0
Ol0 Os0 ol0 ol1 hs0 ax0 ax0 ol0 ox0 Os9 os9 os9
os0 ot9 ot9 hl0 al0 al0 ax0 al0 os0 om0 ol0
nt9 nt9 nt9 qs0 px0 pl0 px0 pm0 pl0 mm0 nl0 nm0
nt9 nt9 ml0 qm0 px0 px0 cs0 mx0 ml0 mx0 ns0
kt0 nt9 nt9 qs0 pl0 pm0 qs0 pl1 pl0 px0 nl0 nx0 ns9
bt9 bt9 bt9 bt9 qs0 px0 pl0 px0 pl0 bt9 bt9 bs9 bs9
bt9 bs9 bt9 qm0 pl0 px0 qs0 pl0 pl2 pm0 px0 bs9 bm9 bt9 bs0
bs0 bt9 bt9 qm0 px0 px0 pl0 bm8 bm9 bl9 bs0
bt9 bt9 ps0 px0 pm0 px0 pl0 pl0 bs6 bt9
"""
DRAWS, SEED = 25, 3
#: Share of the blocks with hints that are drawn at another size; half as many with other links.
VARIED = 0.4
SIZES = {"t": (1, 2), "s": (3, 6), "m": (7, 14), "l": (15, 40), "x": (41, 250)}


def rows_of(found: list[tuple[int, float, tuple]]) -> list[list[float]]:
    """Features of blocks given as (words, link density, hints) in page order."""
    nothing = (0, 0.0, ())
    padded = [nothing, *found, nothing]
    return [[*b[:2], *a[:2], *c[:2], *b[2]] for a, b, c in zip(padded, found, padded[2:])]


def labelled(draws: int = DRAWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the layouts, each drawn `draws` times."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for layout in LAYOUTS.split("\n"):
        for _ in range(draws if layout else 0):
            page = []
            for kind, size, link in layout.split():
                hints, label, own = KINDS[kind]
                share = min(1.0, int(link) / 9) if own is None else own
                if hints and rng.random() < VARIED:
                    size = rng.choice(list(SIZES))
                if hints and rng.random() < VARIED / 2:
                    share = rng.choice([0.0, 0.15, 0.5, 1.0])
                low, high = SIZES[size]
                page.append((int(rng.integers(low, high + 1)), share, tuple(float(h in hints.split()) for h in HINTS)))
                labels.append(label)
            rows += rows_of(page)
    return np.array(rows), np.array(labels)


#: Where a feature may be split; few and coarse, so that the table can't be learnt by heart.
SPLITS = {"words": (2.5, 6.5, 14.5, 40.5), "links": (0.05, 0.25, 0.66)}


def grow(x: np.ndarray, y: np.ndarray, depth: int = 0, most: int = 10) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, below, above) or (label,).
    Equal gains go to the earlier feature."""
    share = y.mean()
    if depth == most or share in (0, 1):
        return (int(share >= 0.5),)
    best = None
    for feature in range(len(SHAPE) if depth < SHAPE_DEPTH else len(FEATURES)):
        for t in SPLITS.get(FEATURES[feature].partition("_")[0], (0.5,)):
            low = x[:, feature] <= t
            if low.all() or not low.any():
                continue
            cost = sum(part.sum() * (p := y[part].mean()) * (1 - p) for part in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, feature, float(t))
    if best is None:
        return (int(share >= 0.5),)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth + 1, most), grow(x[~low], y[~low], depth + 1, most))


@lru_cache(1)
def tree() -> tuple:
    return grow(*labelled())


def verdict(node: tuple, row: list[float]) -> int:
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node[0]


@lru_cache(4096)
def names_boilerplate(value: str) -> bool:
    """Whether one of the space-separated names is made of known words and names boilerplate."""
    for name in value.split():
        words = [w.lower() for w in NAME_WORD.findall(name)]
        if not BOILERPLATE_NAMES.isdisjoint(words) and all(w in BOILERPLATE_NAMES or w in PLAIN_NAMES for w in words):
            return True
    return False


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool, bool]]:
    """(text, link density, article, element, named, heading) of each flat block."""
    out: list[tuple[str, float, bool, bool, bool, bool]] = []
    # open scopes with what holds inside: (tag, article, boilerplate element or "", named, heading, hidden)
    stack: list[tuple[str, bool, str, bool, bool, bool]] = [("", False, "", False, False, False)]
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0

    def flush() -> None:
        if parts:
            text = BLANK.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                n = text.count(" ") + 1
                link = len(entities.unescape(" ".join(linked)).split())
                _, article, element, named, heading, _ = stack[-1]
                out.append((text, min(1.0, link / n), article, bool(element), named, heading))
            parts.clear()
            linked.clear()

    def close(name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                flush()
                del stack[k:]
                break

    at, end = 0, len(page)
    while at < end:
        m = MARK.search(page, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1][5]:
            piece = page[at:stop]
            parts.append(piece)
            if in_link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCKS:
                flush()
            if name in SCOPES:
                close(name)
            continue
        attributes = m[3]
        if stack[-1][0] == "head" and name not in IN_HEAD:
            close("head")
        if stack[-1][0] in HIDDEN_INLINE and name in BLOCKS:
            close(stack[-1][0])
        if name in RAW or name == "title":
            if not attributes.endswith("/"):
                if name == "title":
                    flush()
                found = re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = found.end() if found else end
            continue
        if name == "a":
            in_link += 1
        if name in BLOCKS:
            flush()
        hides = name == "head" or name in HIDDEN_INLINE or name in HIDDEN_FLOW
        if name in SCOPES and not (hides and attributes.endswith("/")):
            # an element that HTML closes by itself does not nest
            if name in CLOSES_ITSELF:
                while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] == name):
                    stack.pop()
            _, article, element, named, heading, hidden = stack[-1]
            if name in ARTICLE:
                article = True
                element = "" if element == "form" else element
                named = named and name != "main"
            if name in BOILERPLATE and not (name == "header" and article):
                element = name
            if attributes and not named and name not in NAMELESS:
                named = any(names_boilerplate(found[1] or found[2] or found[3] or "") for found in NAMES.finditer(attributes))
            stack.append((name, article, element, named, heading or name in HEADINGS, hidden or hides))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by a line feed."""
    if not page:
        return ""
    found = blocks(page)
    model = tree()
    marked = any(b[2] for b in found)
    rows = rows_of([(b[0].count(" ") + 1, b[1], (*b[2:], marked and not b[2])) for b in found])
    return "\n".join(b[0] for b, row in zip(found, rows) if verdict(model, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    def run(parts: Iterator[list[list]]) -> Iterator[list]:
        for ids, urls, pages in parts:
            text = [main_text(p) for p in pages]
            yield [ids, urls, text, [len(t) for t in text]]

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_columns(rows, run, "page_id long, url string, text string, n_chars long")
