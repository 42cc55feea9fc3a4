"""Main text of web pages by tree scoring.

Every paragraph passes points to its ancestors: one for being there, one for each comma, and up to three for its
length; the parent gets them whole, each further ancestor half of what the one below it got. An element's points are
discounted by its link density, the share of its text that lies in links. The element with the most points is the
container of the article; siblings that read like the article are kept with it.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments by readers are left out
beforehand, wherever they stand. Tags and roles tell them for certain; names of classes of containers are read word by
word, those of headings, paragraphs and parts of lines are not. Ids are often titles of sections, so that an id that might
mean something else, or that stands on what begins with a heading, counts only together with a second sign: mostly links, or
controls of a form. Within an article the same holds for doubtful names of classes.
``site-footer`` is a footer, ``has-sidebar`` says something about a layout, ``search-page`` and ``content-side`` may be
either: such an element, or a form, goes only if it holds less than half of the page's text outside of links. One that
is certain by its name stays if it holds that half together with a heading of first order or an ``article`` or ``main``.
If nothing is left, the names are not regarded. Time grows with the page only, not with the depth of its elements.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.llm.html import BLOCKS, RAW, Node, blocks, parse

SKIPPED_TAGS = RAW | frozenset("head nav aside footer button select option input dialog menu svg canvas object embed audio video map".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist".split())
#: What an element is not to be if it is part of an article: words in names of classes and ids.
OFF_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox banner banners sponsor sponsors sponsored promo promos promotion promotions "
    "cookie cookies cookiebar consent gdpr notice notices alert alerts popup popups modal modals overlay overlays newsletter newsletters subscribe subscription signup login paywall "
    "sidebar sidebars side aside related recommended recommendations share sharing social menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer footers masthead topbar toolbar header headers widget widgets search skip hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
ARTICLE_WORDS = frozenset("article content body entry post story blog".split())
#: Words beside those above that do not change what an element is, unless they come last.
_PLACES = frozenset("site page main global".split())
#: Elements that hold parts of a page; names of others, as of headings, paragraphs and words in a line, are not judged.
NAMED_TAGS = frozenset("div section ul ol dl li table tbody tr td th article main header form fieldset figure center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTROLS = frozenset("form input select textarea".split())
#: Names of an article among others; its header holds its title.
_POSTS = frozenset("article post entry story hentry".split())
#: An element with a larger share of its text in links is dense.
DENSE = 0.5
_FORMS = frozenset("top bottom left right upper lower box block bar list item items wrapper wrap container inner outer area section panel group primary secondary text title links link icon icons thread form slot slots unit zone button buttons posts articles stories".split())
#: Words of names that tell how an element looks or behaves, not what it is.
_MANNERS = frozenset("has no with without not is layout enabled disabled open opened closed on off show".split())
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_BREAK = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articles?-?body|body|content|entry|main|post|story|text|blog)(?=$|[\s_-])", re.IGNORECASE)
_PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())
_START = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "th": -5.0}
#: A container holds at least this share of the page's text outside of links and of what is left out for certain.
MOST = 0.5
#: With less than this share left, names have misled.
LEAST_LEFT = 0.05

#: DOUBT may be anything, PART names something beside the text of an article after that article (``entry-share``).
PLAIN, DOUBT, PART, OFF, COMMENTS, HARD = range(6)


def _kind_of_name(name: str) -> int:
    words = [w for w in _BREAK.split(_CAMEL.sub("-", name).lower()) if w]
    if _MANNERS.intersection(words) or not any(w in OFF_WORDS or w in COMMENT_WORDS for w in words):
        return PLAIN
    while words[-1] in _FORMS and len(words) > 1:
        words.pop()
    head, rest = words[-1], words[:-1]
    if head in COMMENT_WORDS:
        return COMMENTS
    if head not in OFF_WORDS:
        return DOUBT
    if head in ("header", "headers") and ARTICLE_WORDS.intersection(rest):
        return PLAIN  # the title of an article
    beside = [w for w in rest if not (w in OFF_WORDS or w in COMMENT_WORDS or w in _PLACES or w in _FORMS )]
    return OFF if not beside else PART if all(w in ARTICLE_WORDS for w in beside) else DOUBT


@lru_cache(maxsize=4096)
def kind_of_names(names: str) -> int:
    """What names say: PLAIN, DOUBT, PART, OFF or COMMENTS."""
    each = names.split()
    worst = max(map(_kind_of_name, each), default=PLAIN)
    if worst in (OFF, COMMENTS) and any(x.lower() in ARTICLE_WORDS for x in each):
        return DOUBT
    return worst


def kind_of(node: Node, in_article: bool) -> int:
    """Whether an element is left out: for certain by tag, role or style (HARD), or by what the names of its classes say."""
    if node.tag in SKIPPED_TAGS:
        return HARD
    a = node.attributes
    if a:
        if node.tag in ("html", "body", "#root"):
            return PLAIN
        if a.get("role", "").lower() in SKIPPED_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
            return HARD
    if node.tag == "header" and not in_article:
        return OFF
    named = kind_of_names(a.get("class", "")) if a and node.tag in NAMED_TAGS else PLAIN
    if node.tag in ("article", "main"):
        return COMMENTS if "comment" in f"{a.get('class', '')} {a.get('id', '')}".lower() and max(named, kind_of_names(a.get("id", ""))) != PLAIN else PLAIN
    if node.tag == "form" and max(named, kind_of_names(a.get("id", ""))) == PLAIN:
        return DOUBT
    return named


def kind_of_id(node: Node, among_sections: bool, begins_with_heading: bool, dense: bool) -> int:
    """What an id says. Ids are often the titles of sections: more than its words must tell, unless they are beyond doubt.

    ``dense``: the element is mostly links, or holds controls of a form. The id of a section among sections is a title.
    """
    name = node.attributes.get("id")
    if not name or among_sections or node.tag not in NAMED_TAGS:
        return PLAIN
    kind = kind_of_names(name)
    if kind in (DOUBT, PART) or kind == OFF and (begins_with_heading or node.tag == "section"):
        return kind if dense else PLAIN
    return kind


def elements(root: Node) -> tuple[list[Node], dict[int, int]]:
    """All elements but those below what is left out for certain, parents first, and the kinds of all that were met."""
    order: list[Node] = []
    kinds: dict[int, int] = {}
    inside_article: set[int] = set()
    controls: set[int] = set()
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        kind = kinds[id(node)] = kind_of(node, inside)
        if node.tag in _CONTROLS and node.attributes.get("type", "").lower() != "hidden":
            controls.add(id(node if node.tag == "form" else node.parent))
        if kind == HARD:
            continue
        order.append(node)
        if inside:
            inside_article.add(id(node))
        inside = inside or node.tag in ("article", "main") or node.tag in ("div", "section") and not _POSTS.isdisjoint(_BREAK.split(node.attributes.get("class", "").lower()))
        stack.extend((x, inside) for x in reversed(node.children) if not isinstance(x, str))
    _second_signs(order, kinds, inside_article, controls)
    return order, kinds


def _second_signs(order: list[Node], kinds: dict[int, int], inside_article: set[int], controls: set[int]) -> None:
    """Adds what ids say to ``kinds``, and takes back doubts within an article that nothing but a name raises."""
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    heads: set[int] = set()  # elements whose first content is a heading
    sections = Counter(id(node.parent) for node in order if node.tag == "section" and "id" in node.attributes)
    for node in reversed(order):
        key = id(node)
        size[key] = size.get(key, 0) + sum(len(x.strip()) for x in node.children if isinstance(x, str))
        linked[key] = size[key] if node.tag == "a" else linked.get(key, 0)
        first = next((x for x in node.children if not isinstance(x, str) or not x.isspace()), None)
        if node.tag in _HEADINGS or first is not None and not isinstance(first, str) and id(first) in heads:
            heads.add(key)
        dense = key in controls or linked[key] > DENSE * size[key]
        kind = max(kinds[key], kind_of_id(node, node.tag == "section" and sections[id(node.parent)] > 1, key in heads, dense))
        kinds[key] = PLAIN if kind == DOUBT and node.tag != "form" and key in inside_article and not dense else kind
        if node.parent is not None:
            up = id(node.parent)
            size[up] = size.get(up, 0) + size[key]
            linked[up] = linked.get(up, 0) + linked[key]
            if key in controls:
                controls.add(up)


def left_out(order: list[Node], kinds: dict[int, int]) -> set[int]:
    """The elements to leave out, with all below them."""
    hard = {k for k, kind in kinds.items() if kind == HARD}
    if not any(kind in (DOUBT, PART, OFF, COMMENTS) for kind in kinds.values()):
        return hard
    own = {id(node): sum(len(x.strip()) for x in node.children if isinstance(x, str)) for node in order}
    comments = {k for k, kind in kinds.items() if kind == COMMENTS}
    off = comments | {k for k, kind in kinds.items() if kind == OFF}
    top = id(order[0])
    whole, heads = _free_text(order, own, comments)
    free, _ = _free_text(order, own, off)
    drop = hard | comments
    for node in order:
        key = id(node)
        if kinds[key] == OFF and not (heads[key] and whole[key] >= MOST * whole[top]) or kinds[key] in (DOUBT, PART) and free[key] < MOST * free[top]:
            drop.add(key)
    left, _ = _free_text(order, own, drop)
    return drop if left[top] > LEAST_LEFT * whole[top] else hard


def _free_text(order: list[Node], own: dict[int, int], apart: set[int]) -> tuple[dict[int, int], dict[int, bool]]:
    """For each element the characters below it outside of links and of the elements ``apart``, and whether there is a main heading or an article."""
    size, head = dict.fromkeys(own, 0), dict.fromkeys(own, False)
    for node in reversed(order):
        key = id(node)
        size[key] = 0 if node.tag == "a" else size[key] + own[key]
        head[key] = head[key] or node.tag in ("h1", "main", "article")
        if node.parent is not None and key not in apart:
            size[id(node.parent)] += size[key]
            head[id(node.parent)] |= head[key]
    return size, head


def _start(node: Node) -> float:
    names = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}"
    return _START.get(node.tag, 0.0) + (25.0 if _ARTICLE_NAMES.search(_CAMEL.sub("-", names)) else 0.0)


def main_text(source: str | None) -> str:
    """The main text of one page: its blocks joined by empty lines; empty for null, empty or textless pages."""
    if not source:
        return ""
    root = parse(source)
    met, kinds = elements(root)
    drop = left_out(met, kinds)
    skip = lambda node: id(node) in drop
    size: dict[int, int] = {}  # characters below
    linked: dict[int, int] = {}  # of these in links
    commas: dict[int, int] = {}
    order: list[Node] = []
    gone: set[int] = set()
    for node in met:
        if id(node) in drop or id(node.parent) in gone:
            gone.add(id(node))
        else:
            order.append(node)
    passed: dict[int, float] = {}  # points from below
    for node in reversed(order):
        key = id(node)
        texts = [x for x in node.children if isinstance(x, str)]
        size[key] = size.get(key, 0) + sum(len(x.strip()) for x in texts)
        commas[key] = commas.get(key, 0) + sum(x.count(",") + x.count("，") + x.count("、") for x in texts)
        links = size[key] if node.tag == "a" else linked.get(key, 0)
        linked[key] = links
        if node.parent is None:
            continue
        up = id(node.parent)
        size[up] = size.get(up, 0) + size[key]
        commas[up] = commas.get(up, 0) + commas[key]
        linked[up] = linked.get(up, 0) + links
        paragraph = size[key] and (node.tag in _PARAGRAPHS or node.tag in BLOCKS and any(not x.isspace() for x in texts))
        if paragraph or key in passed:
            score = 1.0 + commas[key] + min(3.0, size[key] / 100.0) if paragraph else 0.0
            passed[up] = passed.get(up, 0.0) + score + 0.5 * passed.get(key, 0.0)
    points: dict[int, float] = {}
    best, top = None, float("-inf")
    for node in order:
        key = id(node)
        if key in passed and node.tag not in ("#root", "html"):
            points[key] = (passed[key] + _start(node)) * (1.0 - linked[key] / max(1, size[key]))
            if points[key] > top:
                best, top = node, points[key]
    if best is None:
        return "\n\n".join(blocks([root], skip))
    up = best.parent
    while up is not None and up.tag != "body":  # an article element around the container holds its title as well
        if up.tag == "article":
            best = up
        up = up.parent
    chosen = [best]
    if best.parent is not None and best.tag != "body":
        chosen = [x for x in best.parent.children if not isinstance(x, str) and (x is best or _joins(x, best, top, points, size, linked, gone))]
    return "\n\n".join(blocks(chosen, skip))


def _joins(node: Node, best: Node, top: float, points: dict, size: dict, linked: dict, drop: set) -> bool:
    """Whether a sibling of the container belongs to the article."""
    key = id(node)
    if key in drop or not size.get(key):
        return False
    density = linked[key] / size[key]
    bonus = 0.2 * top if node.attributes.get("class") and node.attributes.get("class") == best.attributes.get("class") else 0.0
    if key in points and points[key] + bonus >= max(10.0, 0.2 * top):
        return True
    if node.tag == "p":
        return density < 0.25 if size[key] > 80 else density == 0
    return node.tag in ("h1", "h2") and best.tag in ("article", "main", "div", "section") and density == 0


def extract_main_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Adds (or replaces) the column ``into`` with the main text of the whole page in the column ``html``.

    A null or empty page has the empty text, never null. Rows are handled one by one, so that ties and repeated rows need
    no rule; all other columns stay. Truncated and broken markup is read as far as it goes.
    """
    return pages.withColumn(into, main_text_column(F.col(html)))


def main_text_column(source: Column) -> Column:
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([main_text(s) for s in sources], dtype=object)

    return of(source)
