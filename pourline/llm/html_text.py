"""Main text of HTML pages by tree scoring.

A page becomes a tree of elements.  Paragraphs pass points for their length and
their commas to all elements around them, half as many with every step; an element's
points are discounted by its link density.  The element with the most points is the
container; it is kept with the page's heading and what is beside it up to the smallest
element that holds both, and siblings that score well or are content elements.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are dropped wherever they stand, by element, role and name.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import steps

#: Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe template".split())
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg canvas nav footer aside button select textarea "
    "input fieldset dialog menu map audio video".split()
)
BLOCKS = frozenset(
    "html body main article section div p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "h1 h2 h3 h4 h5 h6 header footer nav aside form fieldset figure figcaption address details summary center hr br".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = HEADINGS | frozenset("p ul ol dl pre blockquote table figure details address".split())
CLOSES_P = BLOCKS - {"br", "td", "th", "html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table article section div main body html blockquote aside nav header footer form".split())
HOLDERS = frozenset("body main article section div td blockquote center".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: A class token or id is boilerplate if all its parts, between - and _, are of these two kinds, at least one of the first.
_NAMED = re.compile(
    r"ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|"
    r"widgets?|comments?|disqus|respond|reply|replies|reviews?|notice|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|share|sharing|social|related|recommend\w*|pagination|pager|toolbar|skip|hidden|alert|disclaimer|copyright|"
    r"legal|tags?|outbrain|taboola"
)
_NEUTRAL = re.compile(
    r"\d+|site|page|main|global|primary|secondary|top|bottom|left|right|side|bar|box|block|area|container|wrapper|wrap|inner|outer|holder|"
    r"list|item|links?|buttons?|icons?|form|section|panel|slot|unit|posts?|articles?|stories|content|mobile|desktop|sticky|fixed|thread|byline"
)
#: A token with one of these parts is boilerplate whatever its other parts are.
_STRONG = re.compile(
    r"cookies?|consent|gdpr|ccpa|newsletters?|notices?|popup|modal|subscribe|subscription|signup|paywall|advert\w*|adsense|sponsored|"
    r"promos?|breadcrumbs?|sidebar|masthead|disqus|comments|outbrain|taboola|navbar|navigation"
)
_READERS = re.compile(r"comments?|disqus|respond|reply|replies")
_COMMENT_NAME = re.compile(r"comments?|reply|replies|review|ad|promo|related|teaser")
_GOOD_NAME = re.compile(r"article|content|entry|post|story|text|body|main", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.DOTALL)
#: The rest of a tag: quotes hide its end.  Nothing is tried twice.
_REST = re.compile(r"((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s\"'=<>/]+)")
#: A paragraph of fewer characters passes no points; of what an element gets, this share goes on to the one around it.
SHORT, PASSED_ON = 25, 0.5


def _boilerplate(token: str) -> bool:
    parts = [p for p in re.split(r"[-_]+", token) if p]
    named = [bool(_NAMED.fullmatch(p)) for p in parts]
    return any(_STRONG.fullmatch(p) for p in parts) or any(named) and all(n or _NEUTRAL.fullmatch(p) for n, p in zip(named, parts, strict=True))


class Tree:
    """Elements in page order (a parent comes before its children) and the texts between tags."""

    def __init__(self) -> None:
        self.tags, self.parents, self.names, self.dropped, self.in_article = ["#page"], [-1], [""], [False], [False]
        self.named: dict[int, list[str]] = {}  # elements that only their names speak against
        self.texts: list[tuple[int, str]] = []

    def add(self, tag: str, parent: int, attributes: str) -> int:
        found = {}
        if attributes.strip(" /\n\t"):
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
        name = f"{found.get('class', '')} {found.get('id', '')}".strip()
        named = []
        if name and tag not in ("html", "body", "main", "article"):
            named = [t for t in name.lower().split() if _boilerplate(t)]
            if any("header" in t for t in named) and self.in_article[parent]:
                named = [t for t in named if "header" not in t]  # an article's own heading
        elif name and tag == "article":
            named = [t for t in name.lower().split() if all(_COMMENT_NAME.fullmatch(p) or p.isdigit() for p in re.split(r"[-_]+", t) if p)]
            named = [t for t in named if _COMMENT_NAME.search(t)]
        if tag == "form" or found.get("role", "").lower() == "form":
            named = [*named, "form"]  # some pages are one form
        own = (
            tag in DROPPED
            or (tag == "header" and not self.in_article[parent])
            or found.get("role", "").lower() in DROPPED_ROLES
            or "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
            or bool(_HIDDEN.search(found.get("style", "")))
        )
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(name)
        self.in_article.append(tag == "article" or self.in_article[parent])
        self.dropped.append(own or self.dropped[parent])
        if named and not self.dropped[-1]:
            self.named[len(self.tags) - 1] = named
        return len(self.tags) - 1


class Open:
    """The elements that are open, innermost last, with counts of their tags within each fence: looking for one costs nothing if there is none."""

    def __init__(self) -> None:
        self.nodes, self.tags, self.counts = [0], ["#page"], [Counter()]
        self.fences = Counter()

    def push(self, node: int, tag: str) -> None:
        self.nodes.append(node)
        self.tags.append(tag)
        if tag in FENCES:
            self.fences[tag] += 1
            self.counts.append(Counter())
        else:
            self.counts[-1][tag] += 1

    def pop(self) -> str:
        self.nodes.pop()
        tag = self.tags.pop()
        if tag in FENCES:
            self.fences[tag] -= 1
            self.counts.pop()
        else:
            self.counts[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """Close the innermost element of this tag and all within; other tags than fences are looked for within the fence alone."""
        if self.fences[tag] if tag in FENCES else self.counts[-1][tag]:
            while self.pop() != tag:
                pass

    def end(self, tags: set[str]) -> None:
        """Close the innermost element of these tags, as far as the fence."""
        if any(self.counts[-1][t] for t in tags):
            while self.pop() not in tags:
                pass


def parse(page: str) -> Tree:
    """A forgiving parse in linear time: unclosed paragraphs, items and cells end where the next one starts.

    If a quote hides the end of a tag to the end of the page, quotes count no more from there on.
    """
    tree, open_, at, quotes = Tree(), Open(), 0, True
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            tree.texts.append((open_.nodes[-1], page[at : m.start()]))
        tag, attributes = (m[2] or "").lower(), ""
        if not tag:
            at = m.end()
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest:
            at, attributes = rest.end(), rest[1]
        else:
            quotes = False
            if (end := page.find(">", m.end())) < 0:
                tree.texts.append((open_.nodes[-1], page[m.start() :]))
                return tree
            at, attributes = end + 1, page[m.end() : end]
        if m[1]:
            open_.close(tag)
            if tag in BLOCKS:
                tree.texts.append((open_.nodes[-1], "\n"))
            continue
        if tag in CLOSES_P or tag in SAME:
            open_.end(SAME.get(tag, set()) | ({"p"} if tag in CLOSES_P else set()))
        here = open_.nodes[-1]
        if tag in BLOCKS:
            tree.texts.append((here, "\n"))
        node = tree.add(tag, here, attributes)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID:
            open_.push(node, tag)
    if at < len(page):
        tree.texts.append((open_.nodes[-1], page[at:]))
    return tree


def _drop_named(tree: Tree, worth: list[float], own: list[int]) -> None:
    """Drop what its name calls boilerplate, unless it holds most of the page's paragraph points.

    Nothing is kept so beside an article or main part of its own, however short that is, and
    readers' comments must also hold the heading, article or main part, or all of the page's text.
    """
    if not tree.named:
        return
    n = len(tree.tags)
    held, size, titled = list(worth), list(own), [t in ("h1", "main") or (t == "article" and i not in tree.named) for i, t in enumerate(tree.tags)]
    for i in range(n - 1, 0, -1):
        held[tree.parents[i]] += held[i]
        size[tree.parents[i]] += size[i]
        titled[tree.parents[i]] = titled[tree.parents[i]] or titled[i]
    mains = [i for i in range(1, n) if tree.tags[i] in ("article", "main") and not tree.dropped[i] and i not in tree.named]

    ends = list(range(n))  # the last element within each
    for i in range(n - 1, 0, -1):
        ends[tree.parents[i]] = max(ends[tree.parents[i]], ends[i])

    def apart(i: int, j: int) -> bool:
        return not (i <= j <= ends[i] or j <= i <= ends[j])

    for i, named in tree.named.items():
        readers = any(_READERS.search(t) for t in named)
        most = held[i] > 0.5 * held[0] and not any(apart(i, j) for j in mains) and (not readers or titled[i] or size[i] == size[0])
        tree.dropped[i] = not most
    for i in range(1, n):
        tree.dropped[i] = tree.dropped[i] or tree.dropped[tree.parents[i]]


def _scores(tree: Tree) -> tuple[list[float], list[int], list[int]]:
    """Points, text length and link-text length of every element."""
    n = len(tree.tags)
    length, linked, links, points = [0] * n, [0] * n, [0] * n, [0.0] * n
    own, commas, own_linked = [0] * n, [0] * n, [0] * n
    in_link, block = [False] * n, [0] * n
    for i in range(1, n):
        in_link[i] = tree.tags[i] == "a" or in_link[tree.parents[i]]
        block[i] = i if tree.tags[i] in BLOCKS else block[tree.parents[i]]
        links[i] = tree.tags[i] == "a"
    for node, text in tree.texts:
        if tree.dropped[node] or text.isspace():
            continue
        size = len(text.strip())
        own[block[node]] += size
        commas[block[node]] += text.count(",")
        if in_link[node]:
            own_linked[block[node]] += size
    worth = [(1 + commas[i] + min(own[i] / 100, 3)) * (1 - own_linked[i] / own[i]) if own[i] >= SHORT else 0.0 for i in range(n)]
    _drop_named(tree, worth, own)
    for node, text in tree.texts:
        if not tree.dropped[node] and not text.isspace():
            size = len(text.strip())
            length[node] += size
            linked[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):
        up = tree.parents[i]
        length[up] += length[i]
        linked[up] += linked[i]
        links[up] += links[i]
    for i in range(n - 1, 0, -1):
        if tree.tags[i] in ("ul", "ol", "div", "section", "table", "p") and links[i] >= 3 and linked[i] > 0.75 * length[i]:
            tree.dropped[i] = tree.dropped[i] or not tree.in_article[i]  # an article's own lists of links stay
    for i in range(1, n):
        tree.dropped[i] = tree.dropped[i] or tree.dropped[tree.parents[i]]
    for i in range(n):
        if own[i] >= SHORT and not tree.dropped[i]:
            points[i if tree.tags[i] in HOLDERS else tree.parents[i]] += worth[i]
    for i in range(n - 1, 0, -1):  # children come after their parents
        points[tree.parents[i]] += PASSED_ON * points[i]
    points[0] = 0.0  # the page itself is no container
    for i in range(1, n):
        if points[i]:
            bonus = 25 * (tree.tags[i] in ("article", "main")) + 5 * bool(_GOOD_NAME.search(tree.names[i]))
            points[i] = (points[i] + bonus) * (1 - linked[i] / max(1, length[i]))
    return points, length, linked


def _around(tree: Tree, best: int, points: list[float], length: list[int], linked: list[int]) -> tuple[set[int], set[int]]:
    """(elements kept whole, elements whose own texts are kept) about the container.

    From a container without the page's heading one climbs to the smallest element that
    holds the last first-rank heading before it, and keeps what is beside the way and is
    not mostly links; of the body only content elements, and what is between the two.
    """
    kept, loose = {best}, set()
    if tree.tags[best] in ("article", "body", "html", "#page"):
        top, title = tree.parents[best], best
    else:
        ends = best
        while ends + 1 < len(tree.tags) and tree.parents[ends + 1] >= best:
            ends += 1
        inner = any(tree.tags[i] == "h1" and not tree.dropped[i] for i in range(best, ends + 1))
        title = next((i for i in range(best - 1, 0, -1) if tree.tags[i] == "h1" and not tree.dropped[i] and length[i]), None) if not inner else None
        above, top = set(), tree.parents[best]
        node = title
        while node is not None and node > 0:
            above.add(node)
            node = tree.parents[node]
        while title is not None and top > 0 and top not in above:
            top = tree.parents[top]
        title = best if title is None else title
    way, node = {best}, best
    while node > 0 and node != top:
        node = tree.parents[node]
        way.add(node)
    whole = tree.tags[best] not in ("article", "body", "html", "#page")
    loose = {i for i in way if i != best and whole and tree.tags[i] not in ("body", "html", "#page")}
    beyond = title == best  # no heading to climb to: content elements only
    for i in range(1, len(points)):
        if i in way or tree.parents[i] not in way or tree.parents[i] == best or tree.dropped[i]:
            continue
        wide = beyond or tree.tags[tree.parents[i]] in ("body", "html", "#page")
        plain = tree.tags[i] == "p" and length[i] > 80 and linked[i] < 0.25 * length[i]
        content = whole and linked[i] <= 0.25 * length[i] and (not wide or tree.tags[i] in CONTENT or title <= i < best)
        if plain or content or i == title or (points[i] and points[i] >= max(10.0, 0.2 * points[best])):
            kept.add(i)
    return kept, loose


def main_text(page: str | None) -> str:
    """The page's main text: white space inside a block is one space, blocks are joined by one; empty if there is none."""
    if not page:
        return ""
    tree = parse(page)
    points, length, linked = _scores(tree)
    best = max(range(len(points)), key=lambda i: (points[i], -i))
    if not points[best]:
        # No paragraph is long enough: the first article or main with any text, else the body, else the page.
        with_text = [i for i in range(len(points)) if length[i] and not tree.dropped[i]]
        best = next((i for t in ("article", "main", "body", "#page") for i in with_text if tree.tags[i] == t), None)
        if best is None:
            return ""
    node = best
    while node > 0:  # the whole article, if the container is a part of one
        if tree.tags[node] == "article":
            best = node
            break
        node = tree.parents[node]
    kept, loose = _around(tree, best, points, length, linked)
    inside = [False] * len(points)
    for i in range(len(points)):
        inside[i] = i in kept or (i > 0 and inside[tree.parents[i]])
    parts = [text for node, text in tree.texts if text == "\n" or ((inside[node] or node in loose) and not tree.dropped[node])]
    return " ".join(entities.unescape("".join(parts)).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, pages in steps(batch, 2):
            texts = [main_text(p) for p in pages]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).  Null or empty html has the empty text; rows are judged alone."""
    return pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    ).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
