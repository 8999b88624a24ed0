"""Operator 6, HTML extraction: wrappers inferred as union-free regular expressions.

Pages become trees of tags and text slots. Within a page, repeated neighbours (or sequences of up
to LONGEST_PERIOD of them) fold into repeated groups. The pages of a host are aligned one after
another with what the earlier ones gave: what stands in both stays, what one side lacks becomes
optional, texts that differ become slots, texts that never differ stay constants. The result is the
host's wrapper; wrappers of parts of a host are aligned the same way, so that no host needs one task.

The wrapper tells where a host's main text stands: text outside links, in slots that differ from page
to page, is its prose, and the innermost container that holds the bulk of the prose (with a heading
of its own, if one varies) is the content. Each page is aligned with its host's wrapper to find that
element. Tags break the tie first: where article or main elements hold at least half of the page's
prose, these are the content. Everything outside the content goes, whatever its names. Within it,
menus (blocks of nothing but links, where no article says that they belong), headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments go by their tags, roles and whole
class names, and wrapper constants where they look like notices.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow, drop_saved, portions, saved, table
from .near_dedup import run_bounds, runs

LONGEST_PERIOD = 4
#: A constant is boilerplate once so many pages of a host with different main texts have it.
ENOUGH_PAGES = 5
#: Wrappers of one host that are merged at once; hosts that a task holds at once.
TOGETHER, MOST_HOSTS = 64, 2000
#: Levels of a page that its wrapper describes; text further down is extracted all the same.
DEPTH = 150
#: Places that are compared pairwise when two item lists are aligned; longer lists are aligned at keys
#: that stand once in both. Items of an element above which class names are given up in its wrapper.
PAIRWISE, WIDEST = 10_000, 400
#: Share of an element's prose from which one container in it is taken to be the content.
BULK = 0.8
#: Total size of the wrappers up to which they are broadcast.
BROADCAST_BYTES = 32 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "canvas", "select", "title")
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Opening one of these ends an open paragraph; opening the key ends an open one of the values.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend", "summary", "dd", "dt"}
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
#: What an implied end doesn't look beyond.
SCOPE = frozenset("ul ol dl table body html article section div main td th blockquote".split())

#: Fixed by the meaning of the tags and of usual class names.
DROP_TAGS = frozenset("nav footer aside form button menu dialog head label".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
DROP_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion
    nav navbar navigation menu menubar submenu breadcrumb breadcrumbs topbar masthead toolbar pager pagination
    header footer sidebar sidebars aside rail widget widgets related recommended recommendations trending popular
    cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay lightbox paywall announcement
    newsletter subscribe subscription signup signin login register search searchbox form
    share sharing sharebar social teaser teasers comment comments commentlist commentform respond response responses reply replies disqus discussion reviews feedback
    copyright disclaimer legal hidden skip skiplink""".split()
)
#: What may stand beside these in a name that is dropped ("site-footer", "ad-slot", "related-posts").
FILL_NAMES = frozenset(
    """x site page main top bottom left right upper lower primary secondary global mobile desktop sticky fixed floating inline side
    box bar block slot unit zone area wrap wrapper container inner outer holder panel row col column list item items link links icon icons
    button buttons btn this tool tools group strip count post posts article articles entry story stories blog google""".split()
)
#: A name beside these is part of the article ("article-header").
OWN_NAMES = frozenset("article post entry story page-content content main".split())
#: Inside an article these also name what it is about ("discussion") or parts of its own ("header").
ARTICLE_NAMES = frozenset(
    """header form search searchbox discussion reviews feedback response responses reply replies copyright disclaimer legal alert alerts
    popular trending teaser teasers announcement register subscription rail banner overlay consent gdpr promotion notification notifications social""".split()
)
#: The ids of a section inside an article that are dropped; all others name its subject.
SECTION_IDS = frozenset("comment comments commentlist commentform respond disqus".split())
#: Constants inside an article go only where a class or id has one of these.
NOTICE_NAMES = frozenset("note notice notices alert alerts announcement banner ad ads advert advertisement sponsor sponsored promo cookie cookies consent gdpr paywall newsletter subscribe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What content can stand in as a whole.
CONTAINERS = frozenset("html body div section main article center td table tbody tr".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<empty>svg)(?:[\s/](?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?(?<=/)>|<(?P<raw>" + "|".join(RAW) + r")(?![\w:.-])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    """An element of a page: key for alignment, whether its subtree is dropped, whether it stands in a main element and looks like a notice there, children (elements and texts)."""

    __slots__ = ("tag", "key", "dropped", "main", "notice", "inside", "children")

    def __init__(self, tag: str, key: str, dropped: bool, main: bool, notice: bool = False, inside: bool = False):
        self.tag, self.key, self.dropped, self.main, self.notice, self.inside, self.children = tag, key, dropped, main, notice, inside, []


def _drops(name: str, words: frozenset[str]) -> bool:
    """Whether a whole class or id says that its element isn't main text."""
    parts = {p.lower() for p in _NAME.findall(name)}
    hits = parts & words
    if name.lower() in words:
        hits = {name.lower()}
    elif not hits or not all(p in DROP_NAMES or p in FILL_NAMES or p.isdigit() for p in parts):
        return False
    return not (hits <= {"header", "promo", "page"} and parts & OWN_NAMES)


@lru_cache(maxsize=4096)
def _describe(tag: str, attrs: str, inside: bool = False) -> tuple[str, bool, bool, bool]:
    """Key, dropped, main and notice of a start tag; inside: whether it stands in a main element."""
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(attrs)} if attrs else {}
    classes = found.get("class", "").split()
    role = found.get("role", "").lower()
    dropped = tag in DROP_TAGS or role in DROP_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if not dropped and tag not in ("html", "body", "main", "article") and role not in ("main", "article") and found.get("itemprop") != "articleBody":
        words = DROP_NAMES - ARTICLE_NAMES if inside else DROP_NAMES
        dropped = any(_drops(name, words) for name in classes)
        if not (inside and tag in HEADINGS):
            ids = SECTION_IDS if inside and tag == "section" else words
            dropped = dropped or any(_drops(name, ids) for name in found.get("id", "").split())
    main = not dropped and (tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody")
    stable = [c for c in classes if not any(ch.isdigit() for ch in c)][:2]
    named = tag not in HEADINGS and any(p.lower() in NOTICE_NAMES for name in [*classes, *found.get("id", "").split()] for p in _NAME.findall(name))
    return ("!" if main else "") + ".".join([tag, *stable]), dropped, main, inside and not main and named


def parse(page: str) -> Element:
    """The page's tree; missing end tags are implied, stray ones ignored, a cut end is the page's end."""
    root = Element("#root", "#root", False, False)
    stack, opened = [root], Counter[str]()

    def close(i: int) -> None:
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]

    for token in _TOKEN.finditer(page):
        tag = token["tag"]
        if tag is None:
            text = token[0]
            if text[0] == "<" and len(text) > 1:
                continue
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if token["end"]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("main", "body", "html"):
                    break
            continue
        closing = ("p",) if tag in ENDS_P else ()
        closing += ENDS.get(tag, ())
        if closing and any(opened[c] > 0 for c in closing):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closing:
                    close(i)
                elif stack[i].tag in SCOPE and not (stack[i].tag in ("td", "th") and tag in ("td", "th", "tr")):
                    break
        inside = stack[-1].main or stack[-1].inside
        one = Element(tag, *_describe(tag, token["attrs"].strip(" /\t\n\r"), inside), inside)
        stack[-1].children.append(one)
        if tag not in VOID and not token[0].endswith("/>"):
            stack.append(one)
            opened[tag] += 1
    return root


# Wrappers are lists, so that they can be kept as JSON: an element is [key, many, optional, items],
# a slot is ["#", pages, value or None once it differed, characters of prose].


def _value(text: str) -> int:
    return crc32(text.encode("utf-8", "replace")) ^ len(text) << 32


def _items(node: Element, texts: list | None = None, elements: dict | None = None, level: int = 0, silent: bool = False) -> list:
    """A page element's items before folding; texts gathers (slot, parent, place) in order, elements which item is which element.

    silent: within a link or something dropped, whose text isn't prose.
    """
    out = []
    for place, child in enumerate(node.children):
        if isinstance(child, str):
            text = child.strip()
            if text:
                slot = ["#", 1, _value(text), 0 if silent else len(text)]
                out.append(slot)
                if texts is not None:
                    texts.append((slot, node, place))
        elif child.tag not in ("br", "head") and level < DEPTH:
            item = [child.key, False, False, _fold(_items(child, texts, elements, level + 1, silent or child.dropped or child.tag == "a"), texts)]
            out.append(item)
            if elements is not None:
                elements[id(item)] = (item, child)
    return out


def _merge(a: list, b: list, alias: list | None = None) -> list:
    """The union-free form of two items of one key. alias gathers which slots became which."""
    if a[0] == "#":
        out = ["#", a[1] + b[1], a[2] if a[2] == b[2] else None, a[3] + b[3]]
        if alias is not None:
            alias += [(a, out), (b, out)]
        return out
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3], alias)]


def _optional(item: list) -> list:
    return item if item[0] == "#" else [item[0], item[1], True, item[3]]


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places of items of equal keys, in order: common ends, then between keys that stand once in both, then pairwise."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo][0] == b[low][0]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1][0] == b[high - 1][0]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo == hi or low == high:
            continue
        if (hi - lo) * (high - low) <= PAIRWISE:
            out += _pairwise(a, b, lo, hi, low, high)
            continue
        ours, theirs = Counter(x[0] for x in a[lo:hi]), Counter(x[0] for x in b[low:high])
        at = {b[j][0]: j for j in range(low, high) if theirs[b[j][0]] == 1}
        anchors = _increasing([(i, at[a[i][0]]) for i in range(lo, hi) if ours[a[i][0]] == 1 and a[i][0] in at])
        if not anchors:  # nothing tells more than the order: each item meets the next one of its key
            waiting: dict[str, list[int]] = {}
            for j in range(high - 1, low - 1, -1):
                waiting.setdefault(b[j][0], []).append(j)
            last = low - 1
            for i in range(lo, hi):
                places = waiting.get(a[i][0], [])
                while places and places[-1] <= last:
                    places.pop()
                if places:
                    last = places.pop()
                    out.append((i, last))
            continue
        out += anchors
        ends = [(lo - 1, low - 1), *anchors, (hi, high)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, already ordered by the first place, whose second places grow."""
    tails: list[int] = []
    heads: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
        heads[k : k + 1] = [n]
        before.append(heads[k - 1] if k else -1)
    out, n = [], heads[-1] if heads else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _pairwise(a: list, b: list, lo: int, hi: int, low: int, high: int) -> list[tuple[int, int]]:
    """A longest common subsequence of the keys of two short runs."""
    n, m = hi - lo, high - low
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[lo + i][0] == b[low + j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[lo + i][0] == b[low + j][0] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((lo + i, low + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list, alias: list | None = None) -> list:
    """Aligns two item lists by their keys; what only one has becomes optional."""
    out: list = []
    i = j = 0
    for k, m in [*_matches(a, b), (len(a), len(b))]:
        out += [_optional(x) for x in a[i:k]] + [_optional(x) for x in b[j:m]]
        if k < len(a) and m < len(b):
            out.append(_merge(a[k], b[m], alias))
        i, j = k + 1, m + 1
    return _general(out) if len(out) > WIDEST else out


def _general(items: list) -> list:
    """A wide element's items with their class names and order given up: one repeated item for each tag."""
    out: dict[str, list] = {}
    for x in items:
        key = x[0].split(".")[0]
        x = x if key == "#" else [key, True, True, x[3]]
        out[key] = _merge(out[key], x) if key in out else x
    return list(out.values())


def _fold(items: list, texts: list | None) -> list:
    """Repeated neighbours as one repeated item, repeated sequences as a repeated group."""
    alias: list | None = None if texts is None else []
    for period in range(1, LONGEST_PERIOD + 1):
        keys = [x[0] for x in items]
        if len(keys) < 2 * period or period == 1 and len(set(keys)) == len(keys):
            continue
        out, i = [], 0
        while i < len(items):
            sequence = keys[i : i + period]
            times = 1
            while keys[i + times * period : i + (times + 1) * period] == sequence and len(sequence) == period:
                times += 1
            if times == 1 or sequence == ["#"] * period or period > 1 and len(set(sequence)) == 1:
                out.append(items[i])
                i += 1
                continue
            merged = items[i : i + period]
            for t in range(1, times):
                merged = [_merge(x, y, alias) for x, y in zip(merged, items[i + t * period : i + (t + 1) * period], strict=True)]
            if period == 1:
                merged[0][1] = True
                out.append(merged[0])
            else:
                out.append([f"({','.join(sequence)})", True, False, merged])
            i += times * period
        items = out
    if alias:
        _follow(texts, alias)
    return items


def _follow(texts: list, alias: list) -> None:
    """Replaces merged slots by what they became."""
    became = {id(old): new for old, new in alias}
    for k, (slot, node, place) in enumerate(texts):
        seen = slot
        while id(seen) in became:
            seen = became[id(seen)]
        if seen is not slot:
            texts[k] = (seen, node, place)


def page_wrapper(root: Element) -> list:
    """A page by itself as a wrapper."""
    wrapper = ["#page", False, False, _fold(_items(root), None)]
    _once(wrapper)
    return wrapper


def _once(item: list) -> None:
    """Every slot of a page counts as one page, however often it repeats there."""
    if item[0] == "#":
        item[1] = 1
    else:
        for x in item[3]:
            _once(x)


def has_constants(item: list) -> bool:
    """Whether a wrapper has a constant that could be dropped at all."""
    if item[0] == "#":
        return item[2] is not None and item[1] >= ENOUGH_PAGES
    return not item[1] and any(has_constants(x) for x in item[3])


def _prose(item: list, known: dict[int, int]) -> int:
    """Characters of prose of a wrapper item; what several pages have alike isn't prose. known keeps it for all items below."""
    if item[0] == "#":
        own = item[3] if item[2] is None or item[1] == 1 else 0
    else:
        own = sum(_prose(x, known) for x in item[3])
    known[id(item)] = own
    return own


def content(wrapper: list) -> list | None:
    """The wrapper's item that holds the bulk of the host's prose; None without any prose."""
    prose: dict[int, int] = {}
    if not _prose(wrapper, prose):
        return None
    node = wrapper
    while True:
        tag = lambda x: x[0].lstrip("!").split(".")[0]
        best = max((x for x in node[3] if x[0] != "#"), key=lambda x: prose[id(x)], default=None)
        if best is None or best[1] or tag(best) not in CONTAINERS or prose[id(best)] < BULK * prose[id(node)]:
            return node
        if any(tag(x) in HEADINGS and prose[id(x)] for x in node[3]):
            return node
        node = best


def aligned(root: Element, wrapper: list, wanted: list | None) -> tuple[set[tuple[int, int]], Element | None]:
    """(id of parent, place) of the page's texts that the wrapper has as constants of enough pages, and the element of the wrapper's item `wanted`."""
    texts: list = []
    elements: dict = {}
    items = _fold(_items(root, texts, elements), texts)
    kept = texts[:]
    roles: dict[int, bool] = {}
    found = root if wanted is wrapper else None
    todo = [(items, wrapper[3])]
    while todo:
        a, b = todo.pop()
        for i, j in _matches(a, b):
            x, y = a[i], b[j]
            if x[0] == "#":
                roles[id(x)] = y[2] is not None and y[1] >= ENOUGH_PAGES and x[2] == y[2]
            elif not y[1]:  # repeated items hold data
                if y is wanted and id(x) in elements:
                    found = elements[id(x)][1]
                todo.append((x[3], y[3]))
    return {(id(node), place) for slot, node, place in kept if roles.get(id(slot))}, found


def regions(root: Element) -> list[Element]:
    """The outermost main elements that stand in nothing dropped."""
    out: list[Element] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.main:
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if not isinstance(c, str) and not c.dropped]
    return out


def holds_bulk(root: Element, parts: list[Element], skip: set[tuple[int, int]] = frozenset()) -> bool:
    """Whether parts of a page hold at least half of its prose: of its text outside links and what is dropped."""
    inside = {id(p) for p in parts}
    own = other = 0
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        within = within or id(node) in inside
        for place, child in enumerate(node.children):
            if not isinstance(child, str):
                if not child.dropped and child.tag != "a":
                    todo.append((child, within))
            elif within:
                own += len(child.strip())
            elif (id(node), place) not in skip:
                other += len(child.strip())
    return own >= other


def blocks(node: Element, skip: set[tuple[int, int]] = frozenset(), within_main: bool = True) -> list[tuple[str, bool]]:
    """The kept texts of a subtree by block, with whether each is a menu: only links, several of them or one in a list."""
    out: list[tuple[str, bool]] = []
    buffer: list[str] = []
    links: set[int] = set()
    plain = listed = False

    def flush() -> None:
        nonlocal plain, listed
        text = " ".join("".join(buffer).split())
        if text:
            out.append((text, not plain and (len(links) > 1 or listed and len(links) == 1)))
        buffer.clear()
        links.clear()
        plain = listed = False

    # a stack instead of calls: pages may be nested deeply
    todo: list[tuple] = [(node, 0, 0, False)]
    while todo:
        at, place, link, in_list = todo.pop()
        if place == 0 and at.tag in BLOCK:
            flush()
        while place < len(at.children):
            child = at.children[place]
            place += 1
            if isinstance(child, str):
                if (id(at), place - 1) not in skip:
                    buffer.append(child)
                    if any(ch.isalnum() for ch in child):
                        listed = listed or in_list
                        if link:
                            links.add(link)
                        else:
                            plain = True
            elif child.tag == "br" or child.tag == "wbr":
                buffer.append(" " if child.tag == "br" else "")
            elif not child.dropped and (within_main or child.tag != "header"):
                todo.append((at, place, link, in_list))
                todo.append((child, 0, link or (id(child) if child.tag == "a" else 0), in_list or child.tag == "li"))
                break
        else:
            if at.tag in BLOCK:
                flush()
    flush()
    return out


def _notices(region: Element) -> set[tuple[int, int]]:
    """(id of parent, place) of the texts in notices of a main element, whose other texts are its own however often they repeat."""
    out = set()
    todo = [(region, False)]
    while todo:
        at, inside = todo.pop()
        for place, child in enumerate(at.children):
            if not isinstance(child, str):
                todo.append((child, child.tag not in HEADINGS and (inside or child.notice)))
            elif inside:
                out.add((id(at), place))
    return out


class Host:
    """What a host's wrapper tells about its pages."""

    def __init__(self, wrapper: list, distinct: int):
        self.wrapper, self.distinct = wrapper, distinct
        self.content = content(wrapper)
        self.constants = distinct >= ENOUGH_PAGES and has_constants(wrapper)


def main_text(root: Element, host: Host | None = None) -> str:
    """The page's main text: its blocks, one a line. A page by itself is its own host."""
    own = regions(root)
    sure = bool(own) and holds_bulk(root, own)
    skip: set[tuple[int, int]] = set()
    chosen = None
    if not sure or host is not None and host.constants:
        host = host or Host(page_wrapper(root), 1)
        skip, chosen = aligned(root, host.wrapper, host.content)
        skip = skip if host.constants else set()
        sure = sure or bool(own) and holds_bulk(root, own, skip)
    if sure or own and chosen is None:
        return "\n".join(text for region in own for text, _ in blocks(region, skip & _notices(region) if skip else skip))
    if chosen is None:
        chosen = next((c for h in root.children if not isinstance(h, str) for c in ([h] if h.tag == "body" else h.children) if not isinstance(c, str) and c.tag == "body"), root)
    return "\n".join(text for text, menu in blocks(chosen, skip, False) if not menu)


class Merger:
    """Wrappers of hosts: [pages, values of up to ENOUGH_PAGES different main texts, wrapper]."""

    def __init__(self):
        self.hosts: dict[str, list] = {}

    def add(self, host: str, pages: int, digests: list[int], wrapper: list) -> None:
        known = self.hosts.get(host)
        if known is None:
            self.hosts[host] = [pages, digests, wrapper]
        else:
            known[0] += pages
            if len(known[1]) < ENOUGH_PAGES:
                known[1] = sorted({*known[1], *digests})[:ENOUGH_PAGES]
            known[2] = _merge(known[2], wrapper)

    def rows(self, names: list[str]) -> pa.RecordBatch:
        rows = [(h, json.dumps(w, separators=(",", ":"))) for h, w in self.hosts.items()]
        self.hosts = {}
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string())], names)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper of all pages(host, html): merged in the tasks, then in rounds, TOGETHER of one host at a time."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger()
        for batch in (part for whole in batches for part in portions(whole, 1)):
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root, seen = parse(page or ""), merger.hosts.get(host)
                merger.add(host, 1, [] if seen and len(seen[1]) >= ENOUGH_PAGES else [_value(main_text(root))], page_wrapper(root))
            if len(merger.hosts) >= MOST_HOSTS:
                yield merger.rows(["host", "wrapper"])
        yield merger.rows(["host", "wrapper"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 2):
            bounds = run_bounds(batch, 2)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                merger = Merger()
                for host, wrapper in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(2).slice(lo, hi - lo).to_pylist(), strict=True):
                    merger.add(host, *json.loads(wrapper))
                yield merger.rows(["host", "wrapper"])

    now = saved(arrow(pages, first, "host string, wrapper string"))
    while True:
        most = now.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return now
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // TOGETHER)))
        dealt = now.withColumn("salt", salt).repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "salt", "wrapper")
        before, now = now, saved(arrow(dealt, merged, "host string, wrapper string"))
        drop_saved(pages.sparkSession, before)


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text, n_chars of every row's whole page.

    Character references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined in page order by a newline. A null or empty page gives an empty text; pages of
    any length and depth are read whole; a null url, or one without a host, belongs to the empty host.
    Of containers with equal prose the first is the content. Every one of repeated rows is extracted
    (and counts in its host's wrapper); an empty table gives no rows; other columns don't matter.
    """

    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(rest, UPPER, LOWER)
    wrappers = infer_wrappers(pages.select(host.alias("host"), F.col(html).alias("html"))).select(F.col("host").alias("__host"), "wrapper")
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Host] = {}
        for batch in (part for whole in batches for part in portions(whole, whole.num_columns - 2)):
            texts = []
            for page, kept in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if kept is not None and kept not in known:
                    if len(known) > MOST_HOSTS:
                        known.clear()
                    _, digests, wrapper = json.loads(kept)
                    known[kept] = Host(wrapper, len(digests))
                texts.append(main_text(parse(page or ""), known.get(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:-2], "text", "n_chars"])

    chosen = pages.select(*keep, F.col(html).alias("__html"), host.alias("__host"))
    joined = chosen.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "__host", "left").select(*keep, "__html", "wrapper")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    return arrow(joined, run, f"{schema}, text string, n_chars bigint")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
