"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Menus, footers, forms, comments and the like are bad. The first pass decides
each other block by a score: its density of stop words, its length and its link density each add a term. Blocks that are too
short or too plain to decide inherit, in the second pass, the label of the nearest decided neighbours. An article or main
element is one more term: inside, the score is raised, and neighbours are those inside; outside, it is lowered. One that holds
little of the page's text (a teaser, a quoted post) says nothing, and pages without one are left to the other terms.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.llm.quality_rules import STOP_WORDS

#: Characters, and shares of words or characters, at which a block is decided.
SHORT, LONG, STOP_LOW, STOP_HIGH, MAX_LINKS = 70, 200, 0.05, 0.10, 0.4
#: The same inside an article, and outside one on a page that has one.
INSIDE_LINKS, OUTSIDE_STOP = 0.5, 0.15
#: Terms of the score: few stop words, many, a long block, inside of an article, outside of the page's article.
PLAIN, PROSE, LENGTHY, INSIDE, OUTSIDE = -1, 1, 1, 2, -1
#: An article is a prior if it holds this share, in hundredths, of the characters without links that stand outside of any.
PRIOR_PERCENT = 25

#: Element names of HTML.
RAW_TEXT = ("script", "style", "textarea", "title", "xmp", "noframes")
SKIPPED = ("head", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "button", "datalist", "map")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BOILERPLATE = ("nav", "footer", "aside", "form", "menu", "dialog")
CONTENT = ("article", "main")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = (
    *("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong".split()),
    *("sub sup time tt u var".split()),
)
#: Words that name a part beside the article, as a whole class, id or role or as the head of a compound name (site-footer).
PARTS = frozenset(
    "ad ads advert adverts advertisement adsense sponsored sponsor promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget"
    " footer foot masthead topbar header cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share sharing social"
    " related recommended recommendations comment comments commentlist disqus respond replies toolbar pagination pager skip hidden copyright complementary contentinfo".split()
)
#: Parts that may hold more text than the article; they never stand around it.
REPLIES = frozenset("related recommended recommendations comment comments commentlist disqus respond replies".split())
#: Words behind the name of a part that leave it one (sidebar-inner, comment-list).
HOLDERS = frozenset(
    "area bar block body bottom box btn button buttons card column container content footer form group header icons inner item items left links list menu nav panel posts right"
    " row section slot stories text title top trail unit widget widgets wrap wrapper".split()
)
#: Words before the name of a part that say something of the page and name no part (has-sidebar).
MODIFIERS = frozenset("has have no not non without with layout hide show".split())
HIDING = frozenset(("hidden", "is-hidden", "visually-hidden"))
_ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = frozenset(STOP_WORDS)
_EDGES = re.compile(r"^\W+|\W+$")


@dataclass
class Wrapper:
    """An element that is named as a part: the one around it, whether it is for replies, and whether that or one around it is."""

    parent: int
    replies: bool
    within_replies: bool


@dataclass
class Block:
    """Text between block-level tags: pieces in order, characters inside links, and where it stands."""

    place: str
    heading: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    wrapper: int = -1  # the innermost element around it that is named as a part
    region: int = -1  # the outermost article or main element around it


def part_name(token: str) -> str | None:
    """The part that a class, id or role names: as its whole, as its last word, or as its first with holders behind it."""
    if token.lower() in HIDING:
        return "hidden"
    words = [w for x in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if (w := x.rstrip("0123456789"))]
    if not words or words[0] in MODIFIERS or (words[-1] == "hidden" and len(words) > 1):
        return None
    if words[-1] in PARTS:
        return words[-1]
    return words[0] if words[0] in PARTS and all(w in HOLDERS or w in PARTS for w in words[1:]) else None


def _hides(attributes: str) -> bool:
    """Whether the attributes hide the element."""
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _parts(attributes: str) -> list[str]:
    """The parts beside the article that class, id and role name."""
    values = (m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes) if m[1].lower() in ("class", "id", "role"))
    return [part for value in values for token in value.split() if (part := part_name(token))]


def blocks_of(page: str) -> tuple[list[Block], list[Wrapper]]:
    """Blocks of a page in order, and the elements named as parts, outer ones first. Tags that are never closed, or closed twice,
    do no harm beyond their parent."""
    found: list[Block] = []
    named: list[Wrapper] = []
    stack: list[tuple[str, str, int, int, bool]] = []  # open elements, the place inside each (article, freed, beside, skip or page), wrapper, region, in a heading
    open_names: Counter = Counter()

    def close(k: int) -> None:
        open_names.subtract(name for name, *_ in stack[k:])
        del stack[k:]

    links = regions = 0
    low = page.lower() if len(page.lower()) == len(page) else page
    state = {"block": None}

    def place() -> str:
        return stack[-1][1] if stack else "page"

    def cut() -> None:
        state["block"] = None

    def text(piece: str) -> None:
        where = place()
        if where == "skip" or not piece:
            return
        if state["block"] is None:
            if piece.isspace():
                return
            state["block"] = Block(where, bool(stack) and stack[-1][4], wrapper=stack[-1][2] if stack else -1, region=stack[-1][3] if stack else -1)
            found.append(state["block"])
        plain = entities.unescape(piece)
        state["block"].pieces.append(plain)
        if links:
            state["block"].linked += len(plain.strip())

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        closing = nxt == "/"
        name_at = _TAG.match(page, lt + 1 + closing)
        if not name_at:
            if closing:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                text("<")
                at = lt + 1
            continue
        name = name_at[0].lower()
        rest = _ATTRIBUTES.match(page, name_at.end())
        if rest:
            at = rest.end()
        else:
            end = page.find(">", name_at.end())
            at = size if end < 0 else end + 1
        attributes = page[name_at.end() : at - 1]
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in VOID:
            if name == "hr":
                cut()
            else:
                text(" ")
            continue
        if closing:
            if open_names[name] > 0:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            if name not in INLINE:
                cut()
                links = 0
            continue
        if name in RAW_TEXT:
            end = low.find(f"</{name}", at)
            at = size if end < 0 else end
            cut()
            continue
        if attributes.endswith("/") and name in ("svg", "path"):
            continue
        where = place()
        if name not in INLINE:
            cut()
            links = 0
            while stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in ("li", "td", "th", "tr", "dt", "dd", "option"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                    if not open_names[name] or stack[k][0] in ("ul", "ol", "table", "dl", "tbody", "thead"):
                        break
            where = place()
        inside, (wrapper, region, headed) = where, stack[-1][2:] if stack else (-1, -1, False)
        parts = _parts(attributes) if attributes and name not in ("html", "body") else []
        if name in SKIPPED or where == "skip":
            inside = "skip"
        elif name in BOILERPLATE or (name not in ("html", "body") and attributes and _hides(attributes)):
            inside = "beside"
        elif name == "header" and where not in ("article", "freed"):
            inside = "beside"
        elif name in CONTENT and where != "beside":
            inside = "article"
            if wrapper >= 0 and not parts and not named[wrapper].within_replies:
                inside, wrapper = "article" if name == "main" else "freed", -1
            if region < 0:
                region, regions = regions, regions + 1
        if parts:
            replies = not REPLIES.isdisjoint(parts)
            named.append(Wrapper(wrapper, replies, replies or (wrapper >= 0 and named[wrapper].within_replies)))
            wrapper = len(named) - 1
        if name in INLINE and inside == where and not parts:
            continue
        if name in INLINE:
            cut()
        stack.append((name, inside, wrapper, region, headed or name in HEADINGS))
        open_names[name] += 1
    return found, named


def tidy(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def _density(text: str) -> float:
    words = [w for x in text.split() if (w := _EDGES.sub("", x).lower())]
    return sum(w in _STOP for w in words) / max(1, len(words))


def _score(text: str, inside: bool, article: bool) -> int:
    """How much speaks for a block without many links; ``inside`` an article that is a prior, or on a page with such an ``article``."""
    density, outside = _density(text), article and not inside
    score = PROSE if density >= (OUTSIDE_STOP if outside else STOP_HIGH) else 0 if density >= STOP_LOW else PLAIN
    return score + (LENGTHY if len(text) >= LONG else 0) + (INSIDE if inside else OUTSIDE if outside else 0)


def _first_pass(block: Block, text: str, inside: bool, article: bool) -> str:
    """good, bad, or undecided: near (plain prose), unsure (too short, a heading) or linked (links inside an article)."""
    if block.linked > (INSIDE_LINKS if inside else MAX_LINKS) * len(text) and (not inside or len(text) < LONG or block.linked > 0.9 * len(text)):
        return "linked" if inside else "bad"
    if len(text) < SHORT or block.heading:
        return "unsure"
    score = _score(text, inside, article)
    if score > 0:
        return "good"
    if score == 0:
        return "unsure" if article and not inside else "near"
    return "bad" if len(text) >= LONG else "unsure"


def _priors(blocks: list[tuple[Block, str]], beside: list[bool]) -> set[int]:
    """The articles that hold enough of the text to be a prior; those freed from a wrapper only if there is no other."""
    plain, places = Counter(), {}
    for (b, t), x in zip(blocks, beside, strict=True):
        if not x:
            plain[b.region] += max(0, len(t) - b.linked)
            if b.region >= 0:
                places.setdefault(b.region, b.place)
    outside = plain.pop(-1, 0)
    large = {r for r, n in plain.items() if 100 * n >= PRIOR_PERCENT * outside}
    return {r for r in large if places[r] == "article"} or large


def _sides(labels: list[str]) -> list[tuple[int | None, int | None]]:
    """The nearest decided blocks before and behind every block."""
    left, right, last = [], [None] * len(labels), None
    for i, x in enumerate(labels):
        left.append(last)
        last = i if x in ("good", "bad") else last
    last = None
    for i in range(len(labels) - 1, -1, -1):
        right[i] = last
        last = i if labels[i] in ("good", "bad") else last
    return list(zip(left, right, strict=True))


def _inside(headings: list[bool], labels: list[str]) -> list[str]:
    """Second pass inside an article: what is not decided is bad only between bad blocks, or as a heading of bad blocks alone. Links
    are good only between good blocks: a list in the text stays, one that begins or ends the article (to share it, say) does not."""
    labels = list(labels)
    for i, (left, right) in enumerate(_sides(labels)):
        if labels[i] == "linked":
            labels[i] = "good" if left is not None and right is not None and labels[left] == labels[right] == "good" else "bad"
    final, some = list(labels), "good" in labels
    headed, below = None, "good"  # the label of what stands up to the next heading; that of the heading behind it
    sides = _sides(labels)
    for i in range(len(labels) - 1, -1, -1):
        left, right = sides[i]
        if labels[i] in ("near", "unsure"):
            if not some:
                final[i] = "good"
            elif headings[i]:
                final[i] = headed or below
            else:
                final[i] = "bad" if left is not None and right is not None and labels[left] == labels[right] == "bad" else "good"
        if headings[i]:
            headed, below = None, final[i]
        else:
            headed = "good" if "good" in (headed, final[i]) else "bad"
    return final


def _outside(headings: list[bool], labels: list[str], article: bool, all_bound: bool) -> list[str]:
    """Second pass outside an article."""
    if not article and "good" not in labels:
        labels = ["good" if x == "near" else x for x in labels]  # no better text than plain prose
    final = list(labels)
    for i, (left, right) in enumerate(_sides(labels)):
        if labels[i] in ("good", "bad"):
            continue
        if left is None and right is None:
            final[i] = "good" if labels[i] == "near" else "unsure"
        elif left is None or right is None:
            final[i] = labels[left if right is None else right]
        elif labels[left] == labels[right]:
            final[i] = labels[left]
        elif labels[i] == "near":
            final[i] = "good"
        elif headings[i]:
            final[i] = labels[right]  # a heading goes with what it heads
        else:
            final[i] = labels[left if i - left <= right - i else right]
        if labels[i] == "near" and final[i] == "bad" and (left is None or right is None):
            final[i] = "good"
    if not article and "good" not in final and all_bound:
        final = ["bad" if x == "bad" else "good" for x in labels]  # a page of a few short blocks: nothing speaks against them
    return final


def _good(blocks: list[tuple[Block, str]], bound: list[bool], all_bound: bool) -> list[str]:
    """Texts of the good blocks; those inside a wrapper that is ``bound``, itself or by one around it, stand beside the article."""
    beside = [b.place == "beside" or (b.wrapper >= 0 and bound[b.wrapper]) for b, _ in blocks]
    priors = _priors(blocks, beside)
    zones: dict[int, list[int]] = {}
    for i, (b, _) in enumerate(blocks):
        if not beside[i]:  # what stands beside is no neighbour of the text
            zones.setdefault(b.region if b.region in priors else -1, []).append(i)
    good = []
    for zone, at in zones.items():
        labels = [_first_pass(*blocks[i], zone >= 0, bool(priors)) for i in at]
        headings = [blocks[i][0].heading for i in at]
        final = _inside(headings, labels) if zone >= 0 else _outside(headings, labels, bool(priors), all_bound)
        good += [i for i, x in zip(at, final, strict=True) if x == "good"]
    return [blocks[i][1] for i in sorted(good)]


def main_text(page: str | None) -> str:
    """Article text of a page: blocks joined by line feeds, one space for any white space inside a block.

    An element that is named as a part and holds most of the text goes back to the block rules if nothing good is left
    without it, or if it holds three quarters, is not for replies, and the page marks no article.
    """
    if not page:
        return ""
    found, named = blocks_of(page)
    blocks = [(b, t) for b in found if (t := tidy(b.pieces))]
    total, sizes = 0, [0] * len(named)
    for b, t in blocks:
        if b.place != "beside":
            total += len(t)
            if b.wrapper >= 0:
                sizes[b.wrapper] += len(t)
    for w in range(len(named) - 1, -1, -1):  # inner wrappers come later than those around them
        if named[w].parent >= 0:
            sizes[named[w].parent] += sizes[w]
    good = _good(blocks, [True] * len(named), True)
    marked = any(b.place in ("article", "freed") and b.wrapper < 0 for b, _ in blocks)
    freed = [2 * n > total and (not good or (not marked and not x.replies and 4 * n > 3 * total)) for x, n in zip(named, sizes, strict=True)]
    if True not in freed:
        return "\n".join(good)
    bound: list[bool] = []
    for w, x in enumerate(named):
        bound.append(not freed[w] or (x.parent >= 0 and bound[x.parent]))
    return "\n".join(_good(blocks, bound, False))


def extracted(page: Column) -> Column:
    """Struct of text and n_chars for a column of HTML."""

    @F.arrow_udf("struct<text: string, n_chars: long>")
    def run(column: pa.Array) -> pa.Array:
        texts = [main_text(x) for x in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["text", "n_chars"])

    return run(page)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the HTML, and text and n_chars (code points); columns of these names are replaced.

    Null and empty pages and pages without an article give an empty text; pages of any length are read whole, in time that
    grows with their length, however deeply elements are nested. Each page is judged on its own, so equal and repeated pages get
    equal texts. An empty table gives an empty result. Columns of any other names, dots included, are passed on as they are.
    """
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None)
    found = pages.select(row.alias("row"), extracted(F.col(f"`{html_col}`").cast("string")).alias("main"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in names], "main.*")
