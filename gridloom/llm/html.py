"""Main text of web pages from shallow block features.

A page becomes a flat list of text blocks. Each block is described by its own
and its neighbours' word counts and link densities and by the kind of place
it stands in; a decision tree grown on the small table below says which
blocks belong to the article.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import arrow_map, struct_of

#: Elements whose contents are never text, elements that end a block, elements
#: that stand for page furniture, and words in class, id or role that do.
SILENT = "script style noscript template iframe svg canvas object select textarea title math audio video datalist".split()
BLOCK = """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 head header hgroup hr html label legend li link main menu meta nav ol option p pre search section summary table tbody td tfoot th thead tr ul""".split()
FURNITURE = {"nav": "nav", "menu": "nav", "footer": "nav", "aside": "side", "header": "nav", "form": "form", "button": "form", "fieldset": "form", "label": "form", "dialog": "side", "search": "form", "option": "form", "legend": "form"}
NAMED = {
    "side": "ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup paywall sidebar widget related recommended recommendations trending popular share sharing social toolbar tags skyscraper outbrain taboola alert overlay complementary".split(),
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead topbar pager pagination header sitemap skip copyright banner contentinfo".split(),
    "comment": "comment comments commentlist disqus replies reply respond discussion reviews feedback".split(),
    "form": "form login search searchbox contact".split(),
}
KIND_OF = {w: k for k, ws in NAMED.items() for w in ws}
MAIN = {"article", "main"}
MAIN_NAMES = set("content article articlebody post postbody entry story maincontent".split())
NO_SHOW = re.compile(r"display\s*:\s*none", re.I)
#: On an article element, and inside one, a word alone does not make a comment: categories, titles and sections of papers bear the same words.
COMMENT_ARTICLE = re.compile(r"comment(?:[-_]*(?:body|item|content|entry|text|\d+))?")
SECTION_NAMES = {"discussion"}
#: Running text outside a named wrapper: at least so many words, at most this link density.
RUNNING_WORDS, RUNNING_LINKS = 20, 0.3
SENTENCE_WORDS = 6
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

#: A comment; a tag whose quotes are closed; a tag with a quote that nothing closes, which ends at the next angle.
TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(?=[a-zA-Z/!?])(?:(?:"[^"]*"|'[^']*'|[^>"'])*+(?:>|\Z)|[^>]*+(?:>|\Z))""", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"\s+")
PLACES = ("main", "plain", "nav", "side", "comment", "form")


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    place: str
    heading: bool


@lru_cache(4096)
def _place_of(name: str, tag: str) -> tuple[str, bool] | None:
    """The kind of place that an element opens and whether the element itself (not a name it bears) says so.
    ("section", False): a section of an article if it stands in one, else a comment."""
    if name in ("html", "body"):
        return None
    said: dict[str, str] = {}
    for key, value in ATTRIBUTE.findall(tag[len(name) + 1 :]):
        said.setdefault(key.lower(), value.strip("\"'"))
    if "hidden" in said or NO_SHOW.search(said.get("style", "")) or said.get("aria-hidden", "").lower() == "true":
        return "side", True
    names = " ".join(said.get(k, "") for k in ("class", "id", "role")).lower()
    words = [w for w in re.split(r"[^a-z]+", names) if w]
    found = [KIND_OF[w] for w in words if w in KIND_OF]
    if "comment" in found:
        if name in MAIN:
            return ("comment" if any(COMMENT_ARTICLE.fullmatch(w) for w in names.split()) else "main"), True
        if not (name[0] == "h" and name[1:].isdigit()):
            mine = {w for w in words if KIND_OF.get(w) == "comment"}
            return ("section", False) if mine <= SECTION_NAMES else ("comment", True)
        found = [k for k in found if k != "comment"]
    if name in FURNITURE:
        return FURNITURE[name], True
    if name in MAIN:
        return "main", True
    if found:
        return found[0], False
    return ("main", False) if MAIN_NAMES & set(words) else None


class Open:
    """An open element: its name, its kind of place (as _place_of gives it), the elements round it and the words inside it."""

    __slots__ = ("name", "held", "around", "words")

    def __init__(self, name: str, held: tuple[str, bool] | None, stack: list[Open]):
        self.name, self.held, self.around, self.words = name, held, _innermost(stack), 0


def _innermost(stack: list[Open]) -> Open | None:
    """The innermost open element that has a kind of place."""
    return None if not stack else stack[-1] if stack[-1].held else stack[-1].around


def _line(e: Open | None) -> list[Open]:
    """An element and those round it that have a kind of place, the outermost first."""
    out = []
    while e:
        out.append(e)
        e = e.around
    return out[::-1]


def _place(stack: list[Open], wrappers: set[Open] = frozenset()) -> str:
    """Where the innermost of the open elements is. An article inside a wrapper with an odd name or inside
    a form is an article; one inside a comment, a menu or an aside is not. An article's own header belongs to it."""
    found, fixed, inside = "plain", None, False
    for e in stack:
        if e in wrappers:
            continue
        kind, own = e.held
        if kind == "comment" or (kind == "section" and not inside):
            return "comment"
        if kind == "main":
            inside = inside or own
            if own and fixed == "form":
                fixed = None
            found = "main" if not fixed and (own or found == "plain") else found
        elif kind != "section" and not (e.name == "header" and found == "main"):
            found, fixed = kind, fixed or (kind if own else None)
    return found


def _wrappers(blocks: list[Block], inner: list[Open | None]) -> set[Open]:
    """Elements round most of the page's text that say nothing about it, as no article is outside of them: forms,
    elements with a comment's name, and elements that only a name makes a menu, an aside or a form, if they hold
    running text in more than one block and nothing outside of them looks like an article's, however short."""
    total, seen, out = sum(b.words for b in blocks), set(), set()
    for e in inner:
        while e and e not in seen:
            seen.add(e)
            e = e.around
    for e in seen:
        if e.words * 2 <= total or e.name in MAIN or (e.held[1] and e.name != "form" and e.held[0] != "comment"):
            continue
        around, placed = _line(e), [(b, _line(x)) for b, x in zip(blocks, inner)]
        outside = [(b, s) for b, s in placed if e not in s]
        if e.name != "form" and e.held[0] not in ("comment", "section"):
            if sum(_running(b) for b, s in placed if e in s) < 2 or any(_place(s) == "main" or (_place(s) == "plain" and _sentence(b)) for b, s in outside):
                continue
        if not any(_article(b, s, around) for b, s in outside):
            out.add(e)
    return out


def _article(block: Block, stack: list[Open], around: list[Open]) -> bool:
    """Whether a block is in an article element other than those ``around`` something, or running text."""
    place = _place(stack)
    if place == "main" and any(e.held == ("main", True) and e not in around for e in stack):
        return True
    return place in ("main", "plain") and _running(block)


def _sentence(block: Block) -> bool:
    return not block.heading and block.words >= SENTENCE_WORDS and block.link_density <= RUNNING_LINKS


def _running(block: Block) -> bool:
    return not block.heading and block.words >= RUNNING_WORDS and block.link_density <= RUNNING_LINKS


def blocks_of(page: str | None) -> list[Block]:
    """The page's text blocks in order, character references decoded, white space folded."""
    out: list[Block] = []
    inner: list[Open | None] = []
    parts: list[str] = []
    linked = [0]
    stack: list[Open] = []
    state = {"a": 0, "heading": False}

    def end() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            n = len(text.split())
            inner.append(_innermost(stack))
            for e in _line(inner[-1]):
                e.words += n
            out.append(Block(text, n, min(1.0, linked[0] / n), "", state["heading"]))
        parts.clear()
        linked[0] = 0

    def say(raw: str) -> None:
        if raw:
            parts.append(raw)
            if state["a"]:
                linked[0] += len(entities.unescape(raw).split())

    page, at = page or "", 0
    while at < len(page):
        m = TOKEN.search(page, at)
        say(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = NAME.match(m[0])
        if not tag:  # a comment, a declaration
            continue
        closing, name = bool(tag[1]), tag[2].lower()
        if name in SILENT:
            if not closing and not m[0].endswith("/>"):
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            if name == "title":
                end()
            continue
        if name == "a":
            state["a"] = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in BLOCK:
            if not closing and name not in VOID and (kind := _place_of(name, m[0])) and kind[0] != "main":
                end()
                stack.append(Open(name, kind, stack))
            elif closing and any(e.name == name for e in stack):
                end()
                _pop(stack, name)
            continue
        end()
        state["a"] = 0 if name in ("p", "li", "div", "body", "article", "nav") else state["a"]
        if name[0] == "h" and name[1:].isdigit():
            state["heading"] = not closing
        else:
            state["heading"] = False
        if name in VOID or name == "p":
            if name == "p":
                _pop(stack, name)
                if not closing and (kind := _place_of(name, m[0])) and kind[0] != "main":
                    stack.append(Open(name, kind, stack))
            continue
        if closing:
            _pop(stack, name)
        else:
            if name == "li":
                _pop(stack, "li", within=("ul", "ol"))
            stack.append(Open(name, _place_of(name, m[0]), stack))
    end()
    wrappers = _wrappers(out, inner)
    for block, e in zip(out, inner):
        block.place = _place(_line(e), wrappers)
    return out


def _pop(stack: list, name: str, within: tuple[str, ...] = ()) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].name == name:
            del stack[i:]
            return
        if stack[i].name in within:
            return


def features(blocks: list[Block]) -> np.ndarray:
    """Words and link density of the previous, own and next block, the place (one column each), heading."""
    words = np.array([0, *(b.words for b in blocks), 0], float)
    links = np.array([0, *(b.link_density for b in blocks), 0], float)
    places = np.array([[b.place == p for p in PLACES] for b in blocks], float).reshape(len(blocks), len(PLACES))
    return np.column_stack([words[:-2], words[1:-1], words[2:], links[:-2], links[1:-1], links[2:], places, np.array([b.heading for b in blocks], float)])


#: The labelled table the tree is grown on: place, heading, words and link density of the previous,
#: own and next block, then 1 for article text. Own examples, made for this module.
LABELLED = """
nav 0 0 0 1 1 4 1 0
nav 0 1 1 1 1 1 1 0
nav 0 2 1 3 1 6 0 0
nav 0 40 0 12 0 0 0 0
nav 0 0 0 5 0.2 30 0 0
nav 0 3 0 60 0 10 0 0
nav 1 0 0 4 0 2 1 0
side 0 1 1 9 0 11 0 0
side 0 1 1 45 0 6 0 0
side 0 80 0 7 1 9 1 0
side 1 60 0 3 0 12 0.8 0
side 0 30 0 120 0 30 0 0
comment 0 70 0 25 0 18 0 0
comment 0 20 0 90 0 40 0 0
comment 1 60 0 2 0 22 0 0
comment 0 9 0 3 0.3 30 0 0
form 0 20 0 2 0 3 0 0
form 0 3 0 30 0 0 0 0
form 0 1 0 1 0 1 0 0
main 1 12 0 8 0 40 0 1
main 1 0 0 1 0 2 0 1
main 0 8 0 60 0 55 0 1
main 0 60 0 1 0 40 0 1
main 0 1 0 2 0 1 0 1
main 0 30 0 15 0.1 20 0 1
main 0 30 0 40 0.3 20 0 1
main 0 2 1 30 0 0 0 1
main 0 40 0 25 0 3 0 1
main 0 90 0 200 0 0 0 1
main 0 20 0 6 1 30 0 1
main 0 20 0 4 1 4 1 0
main 0 4 1 5 1 6 1 0
main 0 3 1 2 1 3 1 0
plain 0 60 0 70 0 80 0 1
plain 0 40 0 12 0 50 0 1
plain 0 4 1 55 0 40 0 1
plain 0 50 0 35 0 2 1 1
plain 0 50 0 14 0.1 30 0 1
plain 0 0 0 90 0 0 0 1
plain 1 3 1 9 0 50 0 1
plain 1 30 0 5 0 45 0 1
plain 0 2 1 3 1 2 1 0
plain 0 1 1 2 1 30 0 0
plain 0 30 0 3 1 2 1 0
plain 0 3 1 4 0.5 2 1 0
plain 0 2 1 25 0.9 3 1 0
plain 0 2 0 3 0 2 0 0
plain 0 2 1 3 0 1 1 0
plain 0 4 0 5 0 0 0 0
plain 0 8 0.5 6 0.6 5 0.7 0
main 0 30 0 40 0 4 1 1
main 0 60 0 6 0 1 1 1
main 0 20 0 2 0 3 1 1
main 0 3 1 30 0 3 1 1
main 0 4 1 2 0 0 0 1
main 0 60 0 90 0.2 2 1 1
main 0 2 1 3 0 2 1 1
main 1 0 0 8 0 2 1 1
main 0 30 0 12 0.4 4 1 1
main 0 8 0 2 1 60 0 1
main 0 4 1 4 1 40 0 0
main 0 40 0 6 1 5 1 0
main 0 4 1 5 1 0 0 0
main 0 60 0 5 0.8 6 1 0
main 0 5 0.9 4 0.7 90 0 0
comment 0 30 0 40 0 120 0 0
comment 0 12 0 14 0 90 0 0
comment 0 60 0 150 0 200 0 0
comment 0 0 0 45 0 80 0 0
side 0 40 0 12 0 80 0 0
side 0 0 0 20 0 200 0 0
side 1 50 0 3 0 60 0 0
nav 0 0 0 3 1 60 0 0
nav 0 3 1 2 0 90 0 0
nav 0 60 0 16 0 50 0 0
form 0 2 0 8 0 70 0 0
form 0 60 0 30 0 200 0 0
form 0 45 0 3 0 50 0 0
plain 0 40 0 2 0 50 0 1
plain 0 60 0 5 0 45 0 1
plain 0 80 0 3 0 30 0 1
plain 0 45 0 8 0 60 0.1 1
plain 0 20 0 4 0 25 0 1
plain 0 60 0 40 0 3 1 1
plain 0 3 1 20 0 3 1 1
plain 0 40 0 3 1 50 0 0
plain 0 0 0 5 1 90 0 0
plain 0 4 1 2 1 60 0 0
plain 0 50 0 20 0.9 60 0 0
plain 0 3 0 4 0 3 1 0
main 0 20 0 6 1 5 0 1
main 0 3 0 2 1 60 0 1
main 0 30 0 3 1 0 0 1
main 0 5 0 2 1 8 0 1
main 0 6 1 30 1 40 0 0
main 0 40 0 25 1 6 1 0
plain 0 4 1 6 0 60 0 1
plain 1 0 0 5 0 45 0 1
plain 1 2 1 3 0 50 0 1
plain 1 30 0 2 0 40 0 1
plain 0 0 0 4 0 70 0 1
plain 0 50 0 4 0 0 0 0
plain 0 60 0 3 0 3 0 0
plain 0 45 0 5 0 2 1 0
plain 0 80 0 2 0 4 0.5 0
plain 0 2 0 4 0 5 0 0
"""


def _table() -> tuple[np.ndarray, np.ndarray]:
    rows, said = [], []
    for line in LABELLED.split("\n"):
        if x := line.split():
            pw, pl, w, d, nw, nl = map(float, x[2:8])
            rows.append([pw, w, nw, pl, d, nl, *(float(x[0] == p) for p in PLACES), float(x[1])])
            said.append(int(x[8]))
    return np.array(rows), np.array(said)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A binary tree by Gini impurity: (feature, threshold, left, right), or the label."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            a, b = y[low], y[~low]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), low)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(1)
def tree() -> tuple:
    return grow(*_table())


def classify(x: np.ndarray, node=None) -> np.ndarray:
    node = tree() if node is None else node
    if isinstance(node, int):
        return np.full(len(x), bool(node))
    f, t, left, right = node
    low = x[:, f] <= t
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(x[low], left), classify(x[~low], right)
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep = classify(features(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Every row's ``keep`` columns, text and n_chars.

    Null and empty pages, and pages without article blocks, give an empty
    text. Long pages are read whole; repeated rows are answered alike; other
    columns are not read; an empty table stays empty.
    """
    schema = T.StructType([*struct_of(pages, *keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def rows():
        def step(cols):
            texts = [main_text(h) for h in cols[0]]
            return [texts, [len(t) for t in texts]]

        return step

    return arrow_map(pages.select(*keep, F.col(html_col).alias("_html")), schema, rows, len(keep))
