"""Main text of web pages by union-free wrapper inference.

Pages of one host come from one template.  A page is a stream of tags and texts, nested by its
elements; a *wrapper* is a union-free regular expression over such streams: elements in order,
some optional, some (or groups of up to four) repeated, and text slots that are constant or vary.
A host's wrapper starts as its first page and is generalised page by page: streams are aligned, a
text mismatch makes a slot vary, a missing or extra element becomes optional, and tandem repeats
become one repeated group.  Generalising is the same for two wrappers as for a wrapper and a
page, so tasks infer wrappers of what they hold and these are merged per host.  Then every page is
aligned with its host's wrapper, and the distinct pages that have a place of it are counted, all of them.

The wrapper tells the host's *region*, where the article is: what article or main elements hold,
else the element that holds all that is not the template's; and what belongs to the template:

* constant texts, which nine in ten of its distinct pages (more than two; copies count once) have
  in the same place;
* link groups, elements that two in three of its pages have in the same place and whose text is
  mostly links, one after the other;
* recurrent parts whose class, id or role names a sidebar, notice, advert, comment list or the like
  and which two pages or more have in the same place.  Such names decide alone only where a host
  has a single page.

Every page is then cut by its host's wrapper: within the region everything is kept but these and
what HTML itself declares to be something else (nav, header, footer, aside, form, script and so on).
Within an article or main element constant texts and link groups are kept too: there only names tell.

Blocks are what block-level elements hold between their borders: character references decoded,
white space turned into one space, trimmed, joined by blank lines.

Edge cases: a null or empty html gives an empty text; a page whose wrapper's region is missing is
cut by the article, main or body it has; elements nested more than 200 deep (equal ones around one
another count once) become borders between blocks, and none of their text is lost; a null url, or one without host, shares one wrapper with
its like; broken markup (missing or stray end tags, unclosed comments) is read the way browsers
do; rows that repeat a page_id are cut each; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import materialise
from .textops import slices, sorted_groups, tidy
from .urlfilter import url_host

_MARKUP = re.compile(r"""<!--(?:.*?(?:-->|--!>)|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_INLINE_BLOCK = frozenset("td th li dt dd".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
#: Elements that are never part of an article, and words of class, id or role that say the same.
_DROPPED_TAGS = frozenset("head nav footer aside form button dialog menu search".split())
_DROPPED_WORDS = frozenset("ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar sidebars aside complementary footer contentinfo comment comments commentlist disqus reply replies respond related recommended share sharing social widget widgets login toolbar banner masthead skip search searchbox copyright disclaimer paywall".split())
_HEADER_WORDS = frozenset({"header"})
#: A name of several words means what its last word does (cookie-notice) or that before these (comments-area), unless it tells a state (has-sidebar).
_PART_WORDS = frozenset("area articles bar block box button buttons col column container icons links posts row inner item items list outer panel section wrap wrapper".split())
_STATE_WORDS = frozenset("has no not non with without is hide hidden show enable enabled disable disabled active open closed".split())
_KEPT_TAGS = frozenset("html body main article".split())
#: A name marks a container of the article if this is what its last word says, or all that it says.
_MAIN_WORDS, _MAIN_NAMES = frozenset("article content post entry story".split()), frozenset({"main"})


class Element:
    """An element of a page; parts holds its texts (str) and elements in order.  named: its names say that it is no article."""

    __slots__ = ("dropped", "key", "main", "named", "parts", "tag")

    def __init__(self, tag: str, heads: frozenset[str] = frozenset(), name: str = "", hidden: bool = False, role: str = "") -> None:
        self.tag, self.parts = tag, []
        self.key = f"{tag}.{name}" if name else tag
        fixed = hidden or tag in _DROPPED_TAGS or tag == "header"  # a header is lifted inside an article
        self.named = not fixed and tag not in _KEPT_TAGS and bool(heads & (_DROPPED_WORDS | _HEADER_WORDS))
        self.dropped = fixed
        self.main = 3 if tag == "article" else 2 if tag == "main" or role == "main" else 1 if heads & (_MAIN_WORDS | _MAIN_NAMES) else 0


def _head(words: list[str]) -> str:
    """The word of a name that tells what the element is; empty if the name tells a state."""
    if len(words) > 1 and not _STATE_WORDS.isdisjoint(words):
        return ""
    while len(words) > 1 and (words[-1] in _PART_WORDS or words[-1] in _MAIN_NAMES or words[-1].isdigit()):
        words = words[:-1]
    return words[-1] if words else ""


def _mark(text: str) -> str:
    """The text itself if short, else its hash: equal for equal texts."""
    return text if len(text) <= 64 else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _described(raw: str) -> tuple[frozenset[str], str, bool, str]:
    """What the names of an element say, its names, whether it is hidden, and its role."""
    heads, names, hidden, role = set(), [], False, ""
    for m in _ATTRIBUTE.finditer(raw):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'")
        if kind not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        if kind in ("hidden", "aria-hidden"):
            hidden |= kind == "hidden" or value.lower() == "true"
            continue
        for token in value.split():
            heads.add(_head([w.lower() for w in _WORDS.findall(token)]))
        if kind == "role":
            role = value.strip().lower()
        if kind != "id" or not any(c.isdigit() for c in value):
            names += value.split()
    return frozenset(heads), _mark(" ".join(sorted(names))), hidden, role


class Link(str):
    """Text of a link."""

    __slots__ = ()


#: Elements nested deeper become borders of blocks within those at this depth; chains of equal elements around one another count once.
DEEPEST = 200


def parse(html: str) -> Element:
    """The page's elements; inline markup is transparent unless its names say that it is no article."""
    root = Element("root")
    stack, at, linked = [root], 0, False

    def close(tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        k = len(stack) - 1
        while k > 0 and stack[k].tag not in until:
            if stack[k].tag in tags:
                del stack[k:]
            k -= 1

    while True:
        m = _MARKUP.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].parts.append(Link(text) if linked else text)
        if not m:
            return _levelled(root)
        at = m.end()
        ends, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            linked = not ends
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _RAW:
            if not raw.endswith("/"):
                over = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, at)
                at = over.end() if over else len(html)
            continue
        if tag == "br" or tag not in _BLOCK:
            heads, name, hidden, role = _described(raw) if raw and ("class" in raw or "id" in raw or "role" in raw) else (frozenset(), "", False, "")
            if tag in _VOID:
                if tag == "br":
                    stack[-1].parts.append(" ")
            elif hidden or heads & _DROPPED_WORDS:
                stack[-1].parts.append(Element(tag, heads, name, hidden, role))
                stack.append(stack[-1].parts[-1])
            continue
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        if tag not in _INLINE_BLOCK:
            close({"p"}, _INLINE_BLOCK | {"article", "section", "div", "main", "body"})
        inner = Element(tag, *_described(raw)) if raw and not raw.isspace() else Element(tag)
        stack[-1].parts.append(inner)
        if tag not in _VOID and not raw.endswith("/"):
            stack.append(inner)


def _levelled(root: Element) -> Element:
    """The same page with elements nested at most DEEPEST deep; no text is lost."""
    todo = [(root, 0)]
    while todo:
        e, depth = todo.pop()
        while e.tag in _BLOCK:
            own = [p for p in e.parts if not isinstance(p, str) or not p.isspace()]
            if len(own) != 1 or isinstance(own[0], str) or own[0].key != e.key or own[0].dropped or own[0].main:
                break
            e.parts = own[0].parts
        if depth == DEEPEST:
            parts, inner = [], [iter(e.parts)]
            borders = [False]
            while inner:
                p = next(inner[-1], None)
                if p is None:
                    inner.pop()
                    if borders.pop():
                        parts.append(Element("div"))
                elif isinstance(p, str) or p.dropped:
                    if not isinstance(p, str):
                        p.parts = []
                    parts.append(p)
                else:
                    borders.append(p.tag in _BLOCK)
                    if borders[-1]:
                        parts.append(Element("div"))
                    inner.append(iter(p.parts))
            e.parts = parts
            continue
        todo += [(p, depth + 1) for p in e.parts if not isinstance(p, str)]
    return root


# Wrappers: [key, items, text, mass, main, seen, linked]; an item is [wrapper, optional, repeated].  A text slot has the
# key "#", no items, the mark of its constant text (null if it varies), its length and that of links in it; an element's
# linked is 1 if its names say that it is no article.  A repeated group has a key that starts with "(".  All list the
# hashes of the pages that had them, if wrapper_of() was told; infer_templates() counts pages afterwards instead.


def _slot(text: str, seen: list[int], linked: bool) -> list:
    return ["#", [], _mark(text), len(text), 0, seen, len(text) * linked]


def page_hash(html: str) -> int:
    return int.from_bytes(hashlib.blake2b(html.encode("utf-8", "surrogatepass"), digest_size=6).digest())


def wrapper_of(element: Element, page: int | None = 0) -> list:
    items = []
    seen = [] if page is None else [page]
    for part in element.parts:
        if isinstance(part, str):
            if text := " ".join(part.split()):
                items.append([_slot(text, seen, isinstance(part, Link)), False, False])
        elif not part.dropped:
            items.append([wrapper_of(part, page), False, False])
    return [element.key, _squared(items), None, 0, element.main, seen, int(element.named)]


def _squared(items: list) -> list:
    """Tandem repeats of one to four items become one repeated item."""
    for size in range(1, 5):
        if len(items) < 2 * size:
            break
        out, at = [], 0
        while at < len(items):
            keys = [i[0][0] for i in items[at : at + size]]
            times = 1
            while [i[0][0] for i in items[at + times * size : at + (times + 1) * size]] == keys and len(keys) == size:
                times += 1
            if times == 1:
                out.append(items[at])
                at += 1
                continue
            group = [items[at + k * size : at + (k + 1) * size] for k in range(times)]
            merged = group[0]
            for other in group[1:]:
                merged = [[_merged(a[0], b[0]), a[1] or b[1], a[2] or b[2]] for a, b in zip(merged, other, strict=True)]
            if size == 1:
                out.append([merged[0][0], merged[0][1], True])
            else:
                out.append([["(" + ",".join(keys), merged, None, 0, 0, _seen(*[m[0][5] for m in merged[:2]]), 0], False, True])
            at += times * size
        items = out
    return items


def _merged(a: list, b: list) -> list:
    """The wrapper of all that either wrapper describes; both have the same key."""
    if a[0] == "#":
        same = a[2] is not None and a[2] == b[2]
        return ["#", [], a[2] if same else None, a[3] + b[3], 0, _seen(a[5], b[5]) if same else [], a[6] + b[6]]
    return [a[0], _aligned(a[1], b[1]), None, 0, max(a[4], b[4]), _seen(a[5], b[5]), max(a[6], b[6])]


def _seen(a: list, b: list) -> list:
    return a if a == b else sorted({*a, *b})


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """best[i, j]: the longest common sequence of a[i:] and b[j:], a row at a time."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        below = best[i + 1]
        row = np.maximum(below[:-1], np.where(b == a[i], below[1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    return best


def _aligned(a: list, b: list) -> list:
    """Align two streams by the longest common sequence of keys; what only one has is optional."""
    if [i[0][0] for i in a] == [i[0][0] for i in b]:
        return [[_merged(x[0], y[0]), x[1] or y[1], x[2] or y[2]] for x, y in zip(a, b, strict=True)]
    names: dict[str, int] = {}
    ka, kb = ([names.setdefault(i[0][0], len(names)) for i in x] for x in (a, b))
    head = next((k for k, (x, y) in enumerate(zip(ka, kb, strict=False)) if x != y), min(len(a), len(b)))
    tail = next((k for k, (x, y) in enumerate(zip(ka[:head - 1 if head else None:-1], kb[:head - 1 if head else None:-1], strict=False)) if x != y), min(len(a), len(b)) - head)
    n, m = len(a) - head - tail, len(b) - head - tail
    best = _common(np.array(ka[head : head + n], np.int64), np.array(kb[head : head + m], np.int64))
    out = [[_merged(x[0], y[0]), x[1] or y[1], x[2] or y[2]] for x, y in zip(a[:head], b[:head], strict=True)]
    i = j = 0
    while i < n or j < m:
        x, y = a[head + i] if i < n else None, b[head + j] if j < m else None
        if x and y and x[0][0] == y[0][0]:
            out.append([_merged(x[0], y[0]), x[1] or y[1], x[2] or y[2]])
            i, j = i + 1, j + 1
        elif y is None or (x and best[i + 1, j] >= best[i, j + 1]):
            out.append([x[0], True, x[2]])
            i += 1
        else:
            out.append([y[0], True, y[2]])
            j += 1
    out += [[_merged(x[0], y[0]), x[1] or y[1], x[2] or y[2]] for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    return _squared(out)


def generalised(a: list | None, b: list) -> list:
    """Fold one more wrapper (of a page or of pages) into a host's."""
    return b if a is None else _merged(a, b)


def _mass(wrapper: list) -> int:
    """Length of varying text below."""
    if wrapper[0] == "#":
        return wrapper[3] if wrapper[2] is None else 0
    return sum(_mass(i[0]) for i in wrapper[1])


def _links(wrapper: list, repeated: bool = False) -> tuple[int, int, bool]:
    """Length of all text below, of that in links, and whether links stand one after the other."""
    if wrapper[0] == "#":
        return wrapper[3], wrapper[6], repeated and wrapper[6] > 0
    below = [_links(i[0], repeated or i[2]) for i in wrapper[1]]
    return sum(b[0] for b in below), sum(b[1] for b in below), any(b[2] for b in below) or sum(b[1] > 0 for b in below) > 2


def _linked_mostly(node: list) -> bool:
    whole, linked, _ = _links(node)
    return 10 * linked >= 7 * whole


def _menu(node: list) -> bool:
    """Whether an element is a link group of the template if enough pages have it."""
    return node[0].split(".")[0] not in ("p", "h1", "h2", "h3", "body", "html") and _links(node)[2] and _linked_mostly(node)


# Places: a wrapper's nodes, numbered in the order of its JSON.  A plan is the wrapper with what counting needs: [number or
# null, leaves]; a leaf is [key, constant text or null, optional, plan].  A constant text's plan is its number; the plan is
# null if nothing below is counted.


def places_sought(wrapper: list) -> list:
    """The plan of a wrapper: all pages count at its root, others at what may belong to the template."""
    numbers = count()

    def plan(node: list) -> list | int | None:
        number = next(numbers)
        if node[0] == "#":
            return number if node[2] is not None else None
        leaves = [[item[0], item[2], optional, plan(item)] for item, optional, _ in node[1]]
        group = node[0].startswith("(")
        own = number if number == 0 or (not group and (node[6] or _menu(node))) else None
        return [own, leaves] if own is not None or any(leaf[3] is not None for leaf in leaves) else None

    return plan(wrapper)


def _run(items: list, start: int, leaves: list[list]) -> list[tuple[list, list]]:
    """A repeated group that a page has once, so that it is none there: its items from ``start`` on that are the group's, one after the other."""
    pairs = []
    for leaf in leaves:
        if start < len(items) and items[start][0][0] == leaf[0]:
            pairs.append((items[start][0], leaf))
            start += 1
        elif not leaf[2]:
            return []
    return pairs


def _fitted(items: list, leaves: list[list]) -> list[tuple[list, list]]:
    """Pairs of a page's nodes and the leaves they are, in order: as many as can be, constant texts first."""
    if len(items) == len(leaves) and all(i[0][0] == x[0] and x[1] in (None, i[0][2]) for i, x in zip(items, leaves, strict=True)):
        return [(i[0], x) for i, x in zip(items, leaves, strict=True)]
    n, m = len(items), len(leaves)
    names: dict = {}
    codes = np.array([names.setdefault((x[0], x[1]), len(names)) for x in leaves], np.int64)
    gains = np.array([2 if x[1] is None else 3 for x in leaves], np.int32)
    groups = [(j, x[3][1]) for j, x in enumerate(leaves) if x[0].startswith("(") and x[3]]
    best = np.zeros((n + 1, m + 1), np.int32)  # best[i, j]: what items from i on gain by leaves from j on

    def gained(i: int) -> tuple[np.ndarray, dict[int, list]]:
        node = items[i][0]
        fits = (codes == names.get((node[0], None), -1)) | (codes == names.get((node[0], node[2]), -1))
        by = np.where(fits, gains + best[i + 1, 1:], 0)
        runs = {}
        for j, inner in groups:
            if not fits[j] and (run := _run(items, i, inner)):
                runs[j] = run
                by[j] = 2 * len(run) + best[i + len(run), j + 1]
        return by, runs

    for i in range(n - 1, -1, -1):
        best[i, :-1] = np.maximum(np.maximum.accumulate(gained(i)[0][::-1])[::-1], best[i + 1, :-1])
    found, i, j = [], 0, 0
    while i < n and j < m and best[i, j]:
        by, runs = gained(i)
        taken = np.flatnonzero(by[j:] == best[i, j])
        if not len(taken):
            i += 1
            continue
        j += int(taken[0])
        found += runs[j] if j in runs else [(items[i][0], leaves[j])]
        i, j = i + (len(runs[j]) if j in runs else 1), j + 1
    return found


def places_of(page: list, plan: list) -> set[int]:
    """The numbers of the counted places that a page (its own wrapper) has; it may be any page of the plan's host."""
    places: set[int] = set()
    todo = [(page, plan)]
    while todo:
        node, (own, leaves) = todo.pop()
        if own is not None:
            places.add(own)
        if all(leaf[3] is None for leaf in leaves):
            continue
        for inner, leaf in _fitted(node[1], leaves):
            if isinstance(leaf[3], int):
                if inner[2] == leaf[1]:
                    places.add(leaf[3])
            elif leaf[3] is not None:
                todo.append((inner, leaf[3]))
    return places


def region_of(wrapper: list, counts: dict[int, int] | None = None) -> tuple[list[str], list[list], list[list[str]]]:
    """Path of keys to the element that holds the article, the texts of the template (path of their element, text), and the paths of its parts.

    ``counts`` tells how many distinct pages have each place; without it the wrapper's own lists of pages do.
    """
    found: list[tuple[bool, int, int, int, list[str]]] = []
    constants: list[list] = []
    named: set[str] = set()
    parts: list[list[str]] = []
    numbers: dict[int, int] = {}

    def number(node: list) -> None:
        numbers[id(node)] = len(numbers)
        for item in node[1]:
            number(item[0])

    if counts is not None:
        number(wrapper)
    held = lambda node: len(node[5]) if counts is None else counts.get(numbers[id(node)], 0)
    all_pages = held(wrapper)

    def template(node: list) -> bool:
        if node[4] > 1 or (node[4] and not _linked_mostly(node)):
            return False
        if node[6] and (held(node) > 1 or all_pages == 1):
            return True
        return all_pages > 2 and 3 * held(node) >= 2 * all_pages and _menu(node)

    def walk(node: list, path: list[str], outside: bool) -> tuple[int, int]:
        """Length of the node's text that is not the template's, and of all its text."""
        if node[0] == "#":
            fixed = node[2] is not None and all_pages > 2 and 10 * held(node) >= 9 * all_pages
            if fixed:
                constants.append([path, node[2]])
            return 0 if fixed else node[3], node[3]
        part = False
        if not node[0].startswith("("):
            path = [*path, node[0]]
            part = template(node)
        if part:
            parts.append(path)
            if node[6]:
                named.add("\n".join(path))
        sizes = [walk(i[0], path, outside and not part) for i in node[1]]
        varies, whole = sum(x[0] for x in sizes), sum(x[1] for x in sizes)
        if node[4] > 1 or (node[4] and not _linked_mostly(node)):
            found.append((outside, node[4], varies, whole, path))
        node[3] = 0 if part else varies
        return node[3], whole

    whole, all_ = walk(wrapper, [], True)
    # Article, main and content elements in parts that are named something else count only if there are no others and they hold half of the text.
    some = [f for f in found if f[0]] or [f for f in found if 2 * f[3] >= all_]
    top = max((f[1] for f in some), default=0)
    if top > 1 or (some and not some[0][0]):
        path = max((f for f in some if f[1] == top), key=lambda f: (f[2], -len(f[4]), f[3]))[4]
    else:
        # No article element: go down while one element holds all text that is not the template's.
        node, path = wrapper, [wrapper[0]]
        while whole:
            heavy = [(i[0], i[2]) for i in node[1] if not i[0][0].startswith(("#", "(")) and i[0][3] >= whole]
            if len(heavy) != 1 or heavy[0][1] or heavy[0][0][0].split(".")[0] not in _BLOCK - {"p", "li", "td", "th", "dd", "blockquote", "pre"}:
                break
            node = heavy[0][0]
            path.append(node[0])
    # What holds the article is no part of the template.  Within an article or main element only names and HTML's own elements tell what is none of it.
    if top > 1:
        constants = [c for c in constants if c[0][: len(path)] != path]
        parts = [p for p in parts if p[: len(path)] != path or "\n".join(p) in named]
    return path, sorted(constants), [p for p in parts if path[: len(p)] != p]


# Cutting pages.


def _regions(root: Element, path: list[str]) -> list[Element]:
    """The elements at a path of keys."""
    level = [root] if path and root.key == path[0] else []
    for key in path[1:]:
        level = [p for e in level for p in e.parts if not isinstance(p, str) and p.key == key and not p.dropped]
    return level


def _best(root: Element) -> list[Element]:
    found: dict[int, list[Element]] = {}
    todo = [root]
    while todo:
        e = todo.pop()
        if e.dropped:
            continue
        if e.main > 1:
            found.setdefault(e.main, []).append(e)
            if e.main == 3:
                continue
        todo += [p for p in reversed(e.parts) if not isinstance(p, str)]
    return found[max(found)] if found else [root]


def main_text(html: str | None, path: list[str] | None = None, constants: list[list] | None = None, parts: list[list[str]] | None = None) -> str:
    """The article's blocks, joined by blank lines; by a host's path, constant texts and template parts, if given."""
    if not html:
        return ""
    root = parse(html)
    regions = _regions(root, path or []) or _best(root)
    template: dict = {}  # parts and constant texts as a tree of keys
    for keys in parts or ():
        at = template
        for key in keys:
            at = at.setdefault(key, {})
        at[""] = {}
    for keys, mark in constants or ():
        at = template
        for key in keys:
            at = at.setdefault(key, {})
        at.setdefault("#", set()).add(mark)
    blocks: list[str] = []
    run: list[str] = []
    chosen = {id(r) for r in regions}
    above = {id(r) for r in regions}  # the regions and what holds them
    todo: list[tuple[Element, tuple]] = [(root, ())]
    while todo:
        e, over = todo.pop()
        if id(e) in chosen:
            while over:
                above.add(id(over[0]))
                over = over[1]
            continue
        todo += [(p, (e, over)) for p in e.parts if not isinstance(p, str) and not e.dropped]

    def flush() -> None:
        if run:
            if block := " ".join(unescape("".join(run)).split()):
                blocks.append(block)
            run.clear()

    def walk(e: Element, here: dict | None, inside: bool) -> None:
        inside |= id(e) in chosen
        constant = here and here.get("#")
        if e.tag in _BLOCK:
            flush()
        for p in e.parts:
            if isinstance(p, str):
                if inside and not (constant and _mark(" ".join(p.split())) in constant):
                    run.append(p)
                continue
            below = here and here.get(p.key)
            gone = p.dropped or (below is not None and "" in below and id(p) not in above)
            if gone and not (inside and p.main == 0 and (p.tag == "header" or p.key.endswith("header")) and _title_header(p)):
                if p.tag in _BLOCK:
                    flush()
            elif inside or id(p) in above:
                walk(p, below, inside)
        if e.tag in _BLOCK:
            flush()

    walk(root, template.get(root.key), False)
    flush()
    return "\n\n".join(blocks)


def _title_header(e: Element) -> bool:
    """A header inside an article that holds its title belongs to it."""
    todo = [e]
    while todo:
        for p in todo.pop().parts:
            if not isinstance(p, str):
                if p.tag in ("h1", "h2"):
                    return True
                todo.append(p)
    return False


def infer_templates(pages: DataFrame, html_col: str = "html", hosts_held: int = 1000) -> DataFrame:
    """Wrapper inference over all pages (host, html): host, path, constants, parts (JSON, all three)."""

    @tidy
    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            rows = list(held.items())
            held.clear()
            task = TaskContext.get().partitionId()
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([task] * len(rows), pa.int32()), pa.array([json.dumps(w) for _, w in rows], pa.string())], ["host", "task", "wrapper"])

        for batch in batches:
            for part in slices(batch, "html"):
                for host, html in zip(part["host"].to_pylist(), part["html"].to_pylist(), strict=True):
                    if html:
                        held[host] = generalised(held.get(host), wrapper_of(parse(html), None))
                        if len(held) > hosts_held:
                            yield out()
        yield out()

    def merged(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[str, list]]:
        for (host, *_), group in sorted_groups(batches, keys):
            wrapper = None
            for text in sorted(group["wrapper"].to_pylist()):
                wrapper = generalised(wrapper, json.loads(text))
            yield host, wrapper

    @tidy
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, wrapper in merged(batches, ["host", "part"]):
            yield pa.RecordBatch.from_pydict({"host": pa.array([host], pa.string()), "wrapper": pa.array([json.dumps(wrapper)], pa.string())})

    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, wrapper in merged(batches, ["host"]):
            yield pa.RecordBatch.from_pydict({"host": pa.array([host], pa.string()), "wrapper": pa.array([json.dumps(wrapper)], pa.string())})

    @tidy
    def plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "wrapper"):
                yield pa.RecordBatch.from_arrays([part["host"].combine_chunks(), pa.array([json.dumps(places_sought(json.loads(w))) for w in part["wrapper"].to_pylist()], pa.string())], ["host", "plan"])

    @tidy
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lru_cache(64)(json.loads)
        for batch in batches:
            for part in slices(batch, "html"):
                htmls = part["html"].to_pylist()
                digests = [hashlib.blake2b(h.encode("utf-8", "surrogatepass"), digest_size=16).digest() for h in htmls]
                found = [sorted(places_of(wrapper_of(parse(h), None), read(plan))) for h, plan in zip(htmls, part["plan"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["host"].combine_chunks(), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int32()))], ["host", "page", "places"])

    @tidy
    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "wrapper"):
                counts = [{x["place"]: x["pages"] for x in c} for c in part["counts"].to_pylist()]
                found = [[json.dumps(x) for x in region_of(json.loads(w), c)] for w, c in zip(part["wrapper"].to_pylist(), counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part["host"].combine_chunks(), *[pa.array(x, pa.string()) for x in zip(*found, strict=True)]], ["host", "path", "constants", "parts"])

    # A host's wrappers are merged in two levels: 32 tasks' at once, then what these make.
    pages = pages.select("host", F.col(html_col).alias("html"))
    parts = pages.mapInArrow(infer, "host string, task int, wrapper string").withColumn("part", F.expr("task div 32"))
    parts = parts.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(some, "host string, wrapper string")
    wrappers = materialise(parts.repartition("host").sortWithinPartitions("host").mapInArrow(whole, "host string, wrapper string"), "wrappers")
    # Plans are a table of their own, as small as it can be: every page is joined with one.
    sought = materialise(wrappers.mapInArrow(plans, "host string, plan string"), "places")
    found = pages.where("html <> ''").join(sought, "host").select("host", "html", "plan").mapInArrow(places, "host string, page binary, places array<int>")
    counts = found.dropDuplicates(["host", "page"]).select("host", F.explode("places").alias("place")).groupBy("host", "place").agg(F.count("*").alias("pages"))
    counts = counts.groupBy("host").agg(F.collect_list(F.struct("place", "pages")).alias("counts"))
    return wrappers.join(counts, "host").mapInArrow(regions, "host string, path string, constants string, parts string")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", F.coalesce(url_host(F.col("url")), F.lit("")))
    templates = materialise(infer_templates(rows), "templates")
    kind = rows.schema["page_id"].dataType

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, *(x and json.loads(x) for x in known)) for h, *known in zip(*(part[c].to_pylist() for c in ("html", "path", "constants", "parts")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part["page_id"].to_pylist(), to_arrow_type(kind)), pa.array(part["url"].to_pylist(), pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "path", "constants", "parts")
    return joined.mapInArrow(cut, f"page_id {kind.simpleString()}, url string, text string, n_chars long")
