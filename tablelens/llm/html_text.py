"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.llm.common import pin_batches

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption div section article main body".split())
LISTS = frozenset("ul ol dl div section table nav".split())
DROPPED = frozenset(
    "head title script style noscript template iframe object svg canvas nav footer aside select button textarea "
    "input dialog menu".split()
)
IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript template".split())
CLOSES = {  # a start tag ends the open element of these kinds
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
FENCES = frozenset("html body article main section div table ul ol dl nav aside footer header form".split())
# Words in class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup "
    "modal overlay dialog comment comments commentlist disqus discussion respond reply replies share sharing social "
    "related recommended newsletter subscribe subscription signup login search widget pagination pager toolbar skip "
    "contentinfo complementary form hidden".split()
)
CONTENT = frozenset("article post entry content story".split())
# Marks that hardly name a wrapper of the article, marks that are as often the topic of a section with that id, and headings.
OTHERS = frozenset(
    "comment comments commentlist disqus discussion respond reply replies cookie cookies consent gdpr newsletter "
    "subscribe subscription signup".split()
)
TOPICS = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner menu navigation cookie "
    "cookies consent gdpr notice notices alert dialog discussion respond reply replies share sharing social related "
    "recommended newsletter subscribe subscription signup login search widget skip form hidden header".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NONE, TOPIC, LAYOUT, OTHER = range(4)  # what an element's marks say, from nothing to most
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+|[^<>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SHOWN = re.compile(r"[a-z0-9]+:(?:block|flex|grid|inline|table|contents)")  # hidden on some screens only
ENDS_IN_VALUE = re.compile(r"=\s*[^\s\"'=]+\Z")  # a last slash that belongs to an address
WORD = re.compile(r"[a-z]+")
FADE = (1.0, 0.5, 1 / 3, 0.25)  # share of a paragraph's points by distance of the ancestor


def _attributes(rest: str) -> dict[str, str]:
    """Names and values of a start tag's attributes; the first of equal names counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), "".join(values))
    return found


def _is_hidden(given: dict[str, str]) -> bool:
    style = given.get("style", "").lower()
    return (
        "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true"
        or bool(re.search(r"(?:^|[\s;])display\s*:\s*none", style))
    )


def _mark(tag: str, given: dict[str, str]) -> int:
    """What the words in class, id and role say: is this element no part of an article?"""
    most = NONE
    for name in ("class", "id", "role"):
        if name != "role" and (tag in HEADINGS or tag in INLINE):
            continue  # anchors and highlighted words
        items = re.sub(r"([a-z])([A-Z])", r"\1-\2", given.get(name, "")).lower().split()
        for item in items:
            found = WORD.findall(item)
            if found and found[0] in ("with", "has", "no", "without"):
                continue
            words = MARKS.intersection(found)
            if "header" in found and CONTENT.isdisjoint(found):
                words |= {"header"}
            if "hidden" in words and (len(found) > 1 and found[0] not in ("is", "visually") or any(map(SHOWN.fullmatch, items))):
                words -= {"hidden"}
            if not words:
                continue
            if name == "id" and words <= TOPICS or words == {"widget"} and found[0] != "widget":
                most = max(most, TOPIC)
            else:
                most = max(most, LAYOUT if OTHERS.isdisjoint(words) else OTHER)
    return most


class _Tree:
    """Open elements while a page is read; texts, links and points per element."""

    def __init__(self):
        self.tags, self.parents, self.dropped, self.marks = ["html"], [-1], [False], [NONE]
        self.texts: list[tuple[int, int, bool, str]] = []  # block element, run, in a link, text
        # of each element: the block its texts belong to, whether it is in a link of that block, whether in an article
        self.blocks, self.linked, self.inside = [0], [False], [False]
        self.stack, self.fences = [0], [0]  # open elements, and the depth of the innermost container up to each
        self.depths: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
        self.run = 0  # texts of one run belong to one block of the page

    def cut(self, depth: int) -> None:
        """End all elements from this depth on; each element is ended once, so a page costs as much as it has elements."""
        for node in self.stack[depth:]:
            self.depths[self.tags[node]].pop()
        del self.stack[depth:], self.fences[depth:]

    def end_head(self) -> None:
        """What may not stand in a head ends an open one: its end tag may be left out."""
        for depth in range(1, min(len(self.stack), 3)):
            if self.tags[self.stack[depth]] == "head":
                self.cut(depth)
                self.run += 1
                return

    def open(self, tag: str, rest: str) -> None:
        if self.tags[self.stack[-1]] == "head" and tag not in IN_HEAD:
            self.end_head()
        if tag in ENDS_PARAGRAPH:
            self.close_open({"p"})
        if tag in CLOSES:
            self.close_open(CLOSES[tag])
        if tag not in INLINE:
            self.run += 1
        if tag in VOID:
            return
        parent = self.stack[-1]
        given = _attributes(rest) if rest.strip() and tag not in ("html", "body") else {}
        gone = self.dropped[parent] or tag in DROPPED or tag not in ("article", "main") and _is_hidden(given)
        if tag == "header" and not self.inside[parent]:
            gone = True
        self.tags.append(tag)
        self.parents.append(parent)
        self.dropped.append(gone)
        mark = _mark(tag, given) if given and not gone else NONE
        self.marks.append(max(mark, LAYOUT) if tag in ("form", "fieldset") and not gone else mark)
        node, inline = len(self.tags) - 1, tag in INLINE
        self.blocks.append(self.blocks[parent] if inline else node)
        self.linked.append(inline and (tag == "a" or self.linked[parent]))
        self.inside.append(self.inside[parent] or tag in ("article", "main"))
        self.depths[tag].append(len(self.stack))
        self.fences.append(len(self.stack) if tag in FENCES else self.fences[-1])
        self.stack.append(node)

    def close_open(self, kinds: set[str]) -> None:
        """End the nearest open element of these kinds, unless a container lies between."""
        depth = max((self.depths[kind][-1] for kind in kinds if self.depths[kind]), default=0)
        if depth and depth >= self.fences[-1]:
            self.cut(depth)
            self.run += 1

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.run += 1
        if self.depths[tag]:
            self.cut(self.depths[tag][-1])

    def say(self, text: str) -> None:
        if self.tags[self.stack[-1]] == "head" and text.strip():
            self.end_head()
        node = self.stack[-1]
        if not self.dropped[node]:
            self.texts.append((self.blocks[node], self.run, self.linked[node], text))


def _read(page: str) -> _Tree:
    tree, at = _Tree(), 0
    for found in TOKEN.finditer(page):
        if found.start() > at:
            tree.say(html.unescape(page[at : found.start()]))
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in ("html", "body") and not found["end"]:
            if tag == "body":
                tree.end_head()
            continue
        if tag == "br":
            tree.say(" ")
        elif found["end"]:
            tree.close(tag)
        else:
            tree.open(tag, found["rest"])
            if found["rest"].endswith("/") and tag not in VOID and tag in INLINE and not ENDS_IN_VALUE.search(found["rest"]):
                tree.close(tag)
    if at < len(page):
        tree.say(html.unescape(page[at:]))
    return tree


def _lengths(tree: _Tree) -> tuple[list[int], list[int], list[int]]:
    """Characters, linked characters and links (runs of linked text) below each element."""
    total, linked, links = ([0] * len(tree.tags) for _ in range(3))
    for node, _, is_link, text in tree.texts:
        size = len(text.strip())
        total[node] += size
        if is_link and size:
            linked[node] += size
            links[node] += 1
    for node in range(len(tree.tags) - 1, 0, -1):  # children come after their parents
        parent = tree.parents[node]
        total[parent] += total[node]
        linked[parent] += linked[node]
        links[parent] += links[node]
    return total, linked, links


def _scores(tree: _Tree, total: list[int], linked: list[int]) -> dict[int, float]:
    """Points that paragraphs pass up for length and commas, times the share of text outside links."""
    blocks: dict[tuple[int, int], list[str]] = defaultdict(list)
    for node, run, _, text in tree.texts:
        blocks[node, run].append(text)
    points: dict[int, float] = defaultdict(float)
    for (node, _), parts in blocks.items():
        text = "".join(parts).strip()
        if not text or tree.tags[node] not in PARAGRAPHS and node:
            continue
        worth = 1 + sum(map(text.count, ",،、，")) + min(len(text) / 100, 3)
        owner = node if tree.tags[node] in FENCES or node == 0 else tree.parents[node]
        for share in FADE:
            if owner < 0:
                break
            points[owner] += worth * share
            owner = tree.parents[owner]
    for node in points:
        points[node] *= 1 - linked[node] / max(total[node], 1)
    return points


def _worths(tree: _Tree) -> list[float]:
    """Points of all paragraphs below each element for their text outside links."""
    blocks: dict[tuple[int, int], list[tuple[bool, str]]] = defaultdict(list)
    for node, run, is_link, text in tree.texts:
        blocks[node, run].append((is_link, text))
    worth = [0.0] * len(tree.tags)
    for (node, _), parts in blocks.items():
        if tree.tags[node] not in PARAGRAPHS and node:
            continue
        text = "".join(part for is_link, part in parts if not is_link).strip()
        if text:
            worth[node] += 1 + sum(map(text.count, ",،、，")) + min(len(text) / 100, 3)
    for node in range(len(tree.tags) - 1, 0, -1):
        worth[tree.parents[node]] += worth[node]
    return worth


def _drop_marked(tree: _Tree) -> None:
    """Drop marked elements and forms, unless they hold the page's article.

    An element that holds the main (or else the richest) article is a wrapper, whatever its words are. So is one with more
    than a third of the page's points, if it lies in that article or there is none with a fifth of the points; one of reader
    comments, notices or sign-ups only if next to nothing else is there. A topic's word as an id counts only where most of
    the text is links.
    """
    if not any(tree.marks):
        return
    total, linked, _ = _lengths(tree)
    worth = _worths(tree)
    below = [False] * len(tree.tags)  # a marked element or an element below one
    for node in range(1, len(tree.tags)):
        below[node] = below[tree.parents[node]] or tree.marks[node] > TOPIC and tree.tags[node] not in ("article", "main")
    holders: set[int] = set()
    weighed = [True] * len(tree.tags)  # elements that their points can save
    articles = [
        node for node in range(1, len(tree.tags))
        if tree.tags[node] in ("article", "main") and not tree.dropped[node] and tree.marks[node] < OTHER and total[node]
    ]
    if articles:
        node = max(articles, key=lambda node: (not below[node], tree.tags[node] == "main", worth[node], -node))
        if worth[node] >= 0.2 * worth[0]:
            weighed = [other == node for other in range(len(tree.tags))]
            for other in range(node + 1, len(tree.tags)):
                weighed[other] = weighed[tree.parents[other]]
        while node >= 0:
            holders.add(node)
            node = tree.parents[node]
    for node in range(1, len(tree.tags)):
        mark, gone = tree.marks[node], False
        if mark and node not in holders and tree.tags[node] not in ("article", "main"):
            if mark == TOPIC:
                gone = not worth[node] or 2 * linked[node] > total[node]
            else:
                gone = not weighed[node] or worth[node] <= worth[0] * (0.9 if mark == OTHER else 1 / 3)
        tree.dropped[node] = tree.dropped[node] or gone or tree.dropped[tree.parents[node]]
    tree.texts = [text for text in tree.texts if not tree.dropped[text[0]]]


def _widened(tree: _Tree, best: int, total: list[int], linked: list[int], points: dict[int, float]) -> tuple[set[int], set[tuple[int, int]]]:
    """Roots and loose runs of an article without a tag of its own.

    Siblings of the best container stay if they score like it or are mostly text outside links and lie next to or
    between kept ones. Where that is all of the parent's text, the parent takes the container's place.
    """
    children: dict[int, list[int]] = defaultdict(list)
    for node in range(1, len(tree.tags)):
        if total[node] and not tree.dropped[node]:
            children[tree.parents[node]].append(node)
    loose: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    first: dict[int, int] = {}  # first run of each element
    for node, run, is_link, text in tree.texts:
        size = len(text.strip())
        loose[node, run][0] += size
        loose[node, run][1] += size if is_link else 0
        first.setdefault(node, run)
    for node in range(len(tree.tags) - 1, 0, -1):
        if node in first:
            first[tree.parents[node]] = min(first[node], first.get(tree.parents[node], first[node]))
    of_parent: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (node, run), (size, _) in loose.items():
        if size:
            of_parent[node].append((node, run))
    while (parent := tree.parents[best]) >= 0:
        enough = points.get(best, 0) * 0.2
        parts: list[tuple[int, object, bool, bool]] = []  # place in the page, element or run, surely kept, light
        for node in children[parent]:
            share = linked[node] / total[node]
            listing = tree.tags[node] in LISTS and share > 0.6
            sure = node == best or points.get(node, 0) >= max(enough, 0.1) and share < 0.5 or tree.tags[node] == "p" and total[node] > 80 and share < 0.25
            parts.append((first.get(node, 0), node, node == best or sure and not listing, share < (0.5 if tree.tags[node] in HEADINGS else 0.25)))
        for key in of_parent[parent]:
            size, by_link = loose[key]
            parts.append((key[1], key, False, by_link < 0.25 * size))
        parts.sort(key=lambda part: part[0])
        kept = [sure for _, _, sure, _ in parts]
        light = [ok for *_, ok in parts]
        certain = [k for k, sure in enumerate(kept) if sure]
        if not certain:  # the container itself holds no text that stays
            break
        for k in range(certain[0], certain[-1]):  # between kept ones
            kept[k] |= light[k]
        for step, order in ((1, range(len(parts))), (-1, range(len(parts) - 1, -1, -1))):  # next to kept ones
            for k in order:
                if 0 <= k - step < len(parts) and kept[k - step] and light[k]:
                    kept[k] = True
        if not all(kept):
            roots = {part[1] for part, stays in zip(parts, kept) if stays}
            return {one for one in roots if isinstance(one, int)}, {one for one in roots if isinstance(one, tuple)}
        points[parent] = max(points.get(parent, 0), points.get(best, 0))
        best = parent
    return {best}, set()


def _kept(tree: _Tree) -> tuple[set[int], set[tuple[int, int]]]:
    """Elements of the best container, widened to its article, and of siblings that belong to it; and loose runs beside them."""
    _drop_marked(tree)
    total, linked, links = _lengths(tree)
    points = _scores(tree, total, linked)
    if not points:
        return set(), set()
    best = max(points, key=lambda node: (points[node], -node))
    chain = [best]
    while tree.parents[chain[-1]] >= 0:
        chain.append(tree.parents[chain[-1]])
    for kind in ("article", "main"):
        inside = [node for node in chain if tree.tags[node] == kind]
        if inside:
            best = inside[-1]
            break
    runs: set[tuple[int, int]] = set()
    if tree.tags[best] in ("article", "main"):
        roots, parent = {best}, tree.parents[best]
        enough = max(10.0, points.get(best, 0) * 0.2)
        for node in range(1, len(tree.tags)):
            if tree.parents[node] == parent and node != best and not tree.dropped[node]:
                share = linked[node] / max(total[node], 1)
                prose = tree.tags[node] == "p" and total[node] > 80 and share < 0.25
                if points.get(node, 0) >= enough or prose:
                    roots.add(node)
    else:
        roots, runs = _widened(tree, best, total, linked, points)
    kept: set[int] = set()
    for node in range(len(tree.tags)):
        listing = node not in roots and tree.tags[node] in LISTS and links[node] > 1 and linked[node] > 0.6 * total[node]
        if not listing and (node in roots or tree.parents[node] in kept):
            kept.add(node)
    return kept, runs


def main_text(page: str | None) -> str:
    """The article of one page: blocks in page order, joined by one space; empty if there is none."""
    if not page:
        return ""
    tree = _read(page)
    kept, runs = _kept(tree)
    parts, last = [], -1
    for node, run, _, text in tree.texts:
        if node in kept or (node, run) in runs:
            if run != last:
                parts.append(" ")
                last = run
            parts.append(text)
    return " ".join("".join(parts).split())


@F.arrow_udf(T.StringType())
def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(page) for page in pages.to_pylist()], pa.string())


def extract_main_text(df: DataFrame, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """Add each page's main text and its length in code points (``n_chars``).

    Every page is read whole into a tree of elements. Paragraphs pass points for length and
    commas to their ancestors, the sums are discounted by link density, the best container
    is widened to the article around it and kept with siblings that score like it; without an article element,
    also with the text beside and between them that is not mostly links. Menus, site
    headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are
    dropped by element and by the words in class, id and role, unless they hold the article. Rows are independent: nothing
    is shuffled. Null and empty pages, and pages without paragraphs, give an empty text;
    repeated rows give repeated results; other columns are kept, except that earlier columns
    with the names of the two results are replaced.
    """
    pin_batches(df.sparkSession)
    page: Column = F.coalesce(F.col(f"`{html_column}`"), F.lit(""))
    return df.withColumn(text_column, _main_texts(page)).withColumn("n_chars", F.length(text_column).cast("long"))
