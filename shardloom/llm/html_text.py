"""HTML main-text extraction: flat text blocks, classified by a decision tree over the blocks' neighbourhood.

A page is cut into blocks at block-level tags. A block has its words, its link density (share of words inside
links), those of the blocks before and after it, and what kind of container holds it. A decision tree (Gini, fitted
here to TABLE, whose rows are blocks of pages, with and without containers) says whether a block is main text; main
blocks are joined in page order by one space. Adverts beside the main text are told by the blocks around them: short
text after links and before a heading; their names count only inside a main container, where any block is text.

An element is hidden by its attribute `hidden`, by display:none in its style or by aria-hidden=true; hidden text is
never main text. The words of class, id and role tell containers apart; the ids of headings, paragraphs and inline
elements are anchors and tell nothing, and that of a section only if all its words do. Long prose among long prose
is kept even in a container whose words speak against it.

Comments, scripts, styles, heads and the like are never text. Character references are decoded; white space inside
a block becomes one space and is trimmed. Null, empty and markup-free pages: no html gives an empty text; text
without tags is one block like any other. Unclosed and misnested tags are tolerated: an end tag closes up to its
nearest open partner, an unended tag or comment runs to the end of the page. Pages are read whole; repeated rows
give repeated results; pages without a main block give an empty text. Ties in the tree go to the first feature and
the lower threshold, and a share of one half is main text. Other columns are not looked at, whatever their names; a
table without rows gives none. Work grows in proportion to the page, whatever its tags.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from shardloom.llm.common import importable, map_rows, pieces

# Element names of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe object svg canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY_SELF = frozenset("dd dt li option p td th tr".split())
OUTSIDE_TAGS = frozenset("nav header footer aside form menu button select dialog".split())
MAIN_TAGS = frozenset("article main".split())
#: Words in class, id or role that name what is not the article.
OUTSIDE_WORDS = frozenset("ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popular popup promo promotion recommended related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toc toolbar trending widget".split())
MAIN_WORDS = frozenset("article content entry main post story".split())
#: Outside words that tell something only inside a main container. Elsewhere the blocks around an advert tell it apart.
ADVERT_WORDS = frozenset("ad ads advert advertisement adverts banner promo promotion sponsor sponsored".split())
#: Outside words that no main word beside them cancels.
COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())
#: Words that may stand beside an outside word in the id of a section that is no anchor.
BOX_WORDS = frozenset("area articles bar block box buttons container content form holder inner items links list media panel post posts section stories wrap wrapper".split())
ANCHOR_TAGS = frozenset("p h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
_NO_DISPLAY = re.compile(r"\bdisplay\s*+:\s*+none\b", re.I)
_PARTS = re.compile(r"[A-Za-z]+")

#: words, link density, words before, density before, words after, density after, outside container (0/1), main container (0/1): is main text
TABLE = """
60 0.00 55 0.00 70 0.00 0 1 : 1
80 0.02 12 0.00 40 0.00 0 1 : 1
25 0.00 60 0.00 90 0.00 0 1 : 1
9 0.00 0 0.00 60 0.00 0 1 : 1
8 0.00 6 1.00 50 0.00 0 1 : 1
2 0.00 40 0.00 35 0.00 0 1 : 1
1 0.00 30 0.00 1 0.00 0 1 : 1
3 0.00 2 0.00 9 0.00 0 1 : 1
12 0.30 40 0.00 60 0.05 0 1 : 1
30 0.10 20 0.00 0 0.00 0 1 : 1
4 1.00 50 0.00 60 0.00 0 1 : 1
200 0.01 6 0.00 10 0.00 0 1 : 1
6 0.00 8 0.00 12 0.00 0 1 : 1
15 0.00 0 0.00 0 0.00 0 1 : 1
1 0.00 1 1.00 5 0.00 0 1 : 1
2 0.00 2 1.00 3 0.00 0 1 : 1
4 0.00 3 1.00 4 1.00 0 1 : 1
7 0.20 2 1.00 2 1.00 0 1 : 1
1 0.00 0 0.00 1 1.00 0 1 : 1
9 0.00 8 0.00 2 1.00 0 1 : 1
3 1.00 2 1.00 3 1.00 0 1 : 1
120 0.00 100 0.00 90 0.00 0 0 : 1
45 0.05 30 0.00 80 0.00 0 0 : 1
30 0.00 60 0.00 25 0.00 0 0 : 1
70 0.10 5 0.00 50 0.00 0 0 : 1
16 0.00 45 0.00 60 0.00 0 0 : 1
8 0.00 2 1.00 60 0.00 0 0 : 1
10 0.00 50 0.00 55 0.00 0 0 : 1
5 0.00 70 0.00 40 0.00 0 0 : 1
3 0.00 1 0.00 0 0.00 0 0 : 1
4 0.00 5 0.00 9 0.00 0 0 : 1
6 0.00 12 0.00 2 0.00 0 0 : 1
2 0.00 3 0.00 4 0.00 0 0 : 1
3 0.00 90 0.00 80 0.00 0 0 : 1
18 0.00 0 0.00 0 0.00 0 0 : 1
40 0.00 0 0.00 0 0.00 0 0 : 1
26 0.00 30 0.00 3 1.00 0 0 : 1
35 0.00 4 1.00 3 1.00 0 0 : 1
4 0.00 0 0.00 0 0.00 0 0 : 1
9 0.00 1 1.00 45 0.00 0 0 : 1
13 0.00 2 1.00 70 0.00 0 0 : 1
5 0.00 4 1.00 120 0.00 0 0 : 1
11 0.00 1 1.00 300 0.00 0 0 : 1
16 0.00 1 1.00 11 0.00 0 0 : 1
24 0.00 2 1.00 9 0.00 0 0 : 1
60 0.00 1 1.00 14 0.00 0 0 : 1
10 0.00 9 0.00 8 0.00 0 0 : 1
12 0.00 20 0.00 11 0.00 0 0 : 1
9 0.00 1 1.00 8 0.00 0 1 : 1
8 0.00 1 1.00 22 0.00 0 1 : 1
12 0.00 1 1.00 9 0.00 0 1 : 1
5 0.00 1 1.00 10 0.00 0 1 : 1
4 0.00 2 1.00 6 0.00 0 1 : 1
6 0.00 3 1.00 30 0.00 0 1 : 1
11 0.00 2 1.00 0 0.00 0 1 : 1
9 0.00 1 1.00 8 0.00 0 0 : 0
9 0.00 2 1.00 8 0.00 0 0 : 0
7 0.00 3 1.00 10 0.00 0 0 : 0
12 0.00 4 1.00 12 0.00 0 0 : 0
11 0.00 2 1.00 16 0.00 0 0 : 0
12 0.00 1 1.00 9 0.00 0 0 : 0
8 0.00 1 1.00 10 0.00 0 0 : 0
5 0.00 1 1.00 10 0.00 0 0 : 0
11 0.00 1 1.00 11 0.00 0 0 : 0
6 0.00 1 1.00 14 0.00 0 0 : 0
4 0.00 1 1.00 1 0.00 0 0 : 0
13 0.00 1 1.00 2 0.00 0 0 : 0
10 0.00 1 1.00 30 0.00 0 0 : 0
13 0.00 1 1.00 24 0.00 0 0 : 0
4 0.00 1 1.00 18 0.00 0 0 : 0
1 1.00 0 0.00 1 1.00 0 0 : 0
2 1.00 0 0.00 0 0.00 0 0 : 0
9 1.00 0 0.00 0 0.00 0 0 : 0
20 1.00 0 0.00 0 0.00 0 0 : 0
2 1.00 1 1.00 2 1.00 0 0 : 0
3 0.67 2 1.00 2 1.00 0 0 : 0
1 1.00 2 1.00 50 0.00 0 0 : 0
6 0.83 40 0.00 5 1.00 0 0 : 0
4 0.00 1 1.00 1 1.00 0 0 : 0
3 0.00 2 1.00 4 0.00 0 0 : 0
5 0.00 3 0.00 2 1.00 0 0 : 0
6 0.00 30 0.00 0 0.00 1 0 : 0
12 0.70 10 0.80 8 0.90 0 0 : 0
25 0.80 20 0.90 30 0.85 0 0 : 0
20 0.60 3 1.00 4 1.00 0 0 : 0
7 0.00 0 0.00 6 0.00 1 0 : 0
1 1.00 0 0.00 1 1.00 1 0 : 0
2 1.00 1 1.00 9 0.00 1 0 : 0
15 0.00 1 1.00 10 0.00 1 0 : 0
40 0.00 60 0.00 30 0.00 1 0 : 0
90 0.00 80 0.00 70 0.00 1 0 : 0
12 0.20 50 0.00 0 0.00 1 0 : 0
30 0.00 12 0.00 0 0.00 1 1 : 0
180 0.00 4 0.00 6 0.00 1 1 : 0
240 0.01 3 0.00 5 0.00 1 0 : 0
160 0.00 2 1.00 3 0.00 1 0 : 0
150 0.00 120 0.00 4 0.00 1 1 : 0
170 0.00 6 0.00 140 0.00 1 0 : 0
2 0.00 200 0.00 3 0.00 1 1 : 0
3 0.00 180 0.00 0 0.00 1 0 : 0
2 0.00 0 0.00 200 0.00 1 0 : 0
2 0.00 180 0.00 190 0.00 1 1 : 0
180 0.00 150 0.00 160 0.00 1 1 : 1
220 0.01 140 0.00 180 0.00 1 1 : 1
160 0.00 200 0.02 150 0.00 1 0 : 1
260 0.02 170 0.00 210 0.00 1 0 : 1
8 0.00 40 0.00 50 0.00 1 1 : 0
60 0.00 90 0.00 20 0.00 1 1 : 0
3 1.00 60 0.00 4 1.00 1 1 : 0
5 0.00 5 0.00 5 0.00 1 1 : 0
100 0.00 100 0.00 100 0.00 1 1 : 0
"""
MAX_DEPTH = 9


class Block:
    __slots__ = ("hidden", "linked", "main", "outside", "parts", "words")

    def __init__(self, outside: bool, main: bool, hidden: bool = False):
        self.parts: list[str] = []
        self.words = self.linked = 0
        self.outside, self.main, self.hidden = outside, main, hidden


def named(tag: str, attrs: str) -> tuple[set[str], bool]:
    """(words of class, role and id that tell what the element holds, whether it is hidden)."""
    words: set[str] = set()
    hidden = False
    for name, *value in _ATTR.findall(attrs):
        name, held = name.lower(), "".join(value)
        if name in ("class", "role"):
            words.update(map(str.lower, _PARTS.findall(held)))
        elif name == "id" and tag in BLOCK_TAGS and tag not in ANCHOR_TAGS:
            found = set(map(str.lower, _PARTS.findall(held)))
            if tag != "section" or found <= OUTSIDE_WORDS | MAIN_WORDS | BOX_WORDS:
                words |= found
        elif name == "hidden":
            hidden = hidden or not held.lower().startswith(("false", "until"))
        elif name == "style":
            hidden = hidden or bool(_NO_DISPLAY.search(held))
        elif name == "aria-hidden":
            hidden = hidden or held.strip().lower() == "true"
    return words, hidden


def blocks(page: str | None) -> list[tuple[str, Block]]:
    """The page's text blocks with their text, in order."""
    if not page:
        return []
    found: list[tuple[str, Block]] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # open elements: name, outside, main, in a link, hidden
    open_: Counter[str] = Counter()
    unended: set[str] = set()  # raw elements without an end tag from here on
    state = (False, False, False, False)
    now = Block(False, False)

    def text(piece: str) -> None:
        if piece:
            piece = entities.unescape(piece)
            n = len(piece.split())
            now.parts.append(piece)
            now.words += n
            now.linked += n if state[2] else 0

    def close() -> None:
        nonlocal now
        if now.words:
            found.append((" ".join("".join(now.parts).split()), now))
        now = Block(state[0], state[1], state[3])

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if m is None:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):  # a tag with an odd quote, or unended
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                text("<")
                at = lt + 1
            continue
        at, name, attrs = m.end(), m[2].lower(), m[3]
        if name in RAW_TAGS and not m[1]:
            if attrs.endswith("/"):
                continue
            end = None if name in unended else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end is None:
                unended.add(name)
            if end:
                at = end.end()
            elif name in ("script", "style", "textarea", "title"):
                at = n
            continue
        if name in BLOCK_TAGS:
            close()
        if m[1]:
            while open_[name]:  # elements that are closed by it are looked at once
                last, *rest = stack.pop()
                open_[last] -= 1
                if last == name:
                    state = tuple(rest)
                    break
        elif name not in VOID_TAGS and not attrs.endswith("/"):
            if name in ENDED_BY_SELF and stack and stack[-1][0] == name:  # an implied end
                state = stack.pop()[1:]
                open_[name] -= 1
            stack.append((name, *state))
            open_[name] += 1
            outside, main, link, hidden = state
            hint, unseen = named(name, attrs) if attrs else ((), False)
            if name in MAIN_TAGS:
                main, outside = True, bool(hint and hint & OUTSIDE_WORDS) or (outside and main)
            elif name not in ("html", "body"):
                # An article's own header is part of it; other outside tags are not, wherever they stand.
                told = hint and hint & (OUTSIDE_WORDS if main else OUTSIDE_WORDS - ADVERT_WORDS)
                outside = outside or (name in OUTSIDE_TAGS and not (name == "header" and main)) or bool(told and (hint & COMMENT_WORDS or not hint & MAIN_WORDS))
                main = main or bool(hint and hint & MAIN_WORDS)
            state = (outside, main, link or name == "a", hidden or unseen)
        if name in BLOCK_TAGS:
            now.outside, now.main, now.hidden = state[0], state[1], state[3]
    close()
    return found


def features(page: list[tuple[str, Block]]) -> np.ndarray:
    """Rows as in TABLE."""
    n = len(page)
    out = np.zeros((n, 8))
    out[:, 0] = [b.words for _, b in page]
    out[:, 1] = [b.linked / b.words for _, b in page]
    out[1:, 2:4] = out[:-1, :2]
    out[:-1, 4:6] = out[1:, :2]
    out[:, 6] = [b.outside for _, b in page]
    out[:, 7] = [b.main for _, b in page]
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH):
    """A tree: a share of main text, or (feature, threshold, tree at most, tree above). Splits by Gini gain, ties to the first feature."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = y[x[:, f] <= t]
            high = y[x[:, f] > t]
            cost = sum(len(s) * s.mean() * (1 - s.mean()) for s in (low, high))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t))
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def shares(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, shares(low, x), shares(high, x)) if len(x) else np.zeros(0)


@cache
def tree():
    rows = np.array([[float(v) for v in line.replace(":", " ").split()] for line in TABLE.strip().splitlines()])
    return grow(rows[:, :8], rows[:, 8])


def main_text(page: str | None) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = (shares(tree(), features(found)) >= 0.5) & ~np.array([b.hidden for _, b in found])
    return " ".join(t for (t, _), k in zip(found, keep.tolist()) if k)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars)."""
    importable(df.sparkSession)

    def run(batches):
        for b in batches:
            for x in pieces(b, html_col):
                texts = [main_text(p) for p in x[html_col]]
                yield {id_col: x[id_col], url_col: x[url_col], "text": texts, "n_chars": list(map(len, texts))}

    kind = {c: df.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return map_rows(df.select(id_col, url_col, html_col), run, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars bigint")
