"""Main text of web pages by wrapper inference.

The pages of a host are made from few templates. Their token streams are aligned into a wrapper, a regular expression
without unions: what some pages lack at a place is an optional group, what follows itself there, or comes in several orders, is
a repeated group, and where texts differ there is a text slot. Every page is then read along the expression, which names the slot of each of its
texts. The slots that hold the article are chosen once for the wrapper: by what marks an article or main part, what is template (text that
never changes), what are links, and which group holds the running text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of HTML: elements without content, elements with raw text, elements inside a line, and what a start tag ends
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot select div section article main aside nav form body".split())

# what is never article, by element and by the words of class, id and role
NEVER = frozenset("nav footer aside form button select option menu dialog svg canvas object audio video map head".split()) | RAW
WORDS = frozenset(
    "nav navigation navbar menu menubar footer sidebar aside ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social related recommended recommendations comment comments disqus reply replies breadcrumb breadcrumbs pagination pager toolbar widget copyright legal "
    "disclaimer contentinfo complementary".split()
)
OUTSIDE = frozenset("header masthead banner topbar".split())  # not article unless within one

#: A text is template if it is the same on so many pages that differ elsewhere.
DIFFERENT = 3

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def tokens(html: str):
    """('open', tag, attributes), ('close', tag) and ('text', raw) in the order of the page; comments and raw elements' contents are left out."""
    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            yield ("text", html[at:])
            return
        if m.start() > at:
            yield ("text", html[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                yield ("close", tag)
            else:
                yield ("open", tag, _attributes(m[3]))
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = end.end() if end else n
                    yield ("close", tag)


def _words(attributes: dict[str, str]) -> set[str]:
    return {p.lower() for name in ("class", "id", "role") if name in attributes for p in _PART.findall(attributes[name])}


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


class Element:
    """An open element: its path of keys, whether it is barred or within an article or main part, and how far the reading of its children has come."""

    __slots__ = ("tag", "above", "path", "barred", "region", "key", "keys", "last", "node", "rank")

    def __init__(self, tag, above, key, barred, region):
        self.tag, self.above, self.key, self.barred, self.region = tag, above, key, barred, region
        self.path = f"{above.path}/{key}" if above is not None and above.path else key
        self.keys, self.last, self.node, self.rank = set(), None, 0, 0


def events(html: str):
    """('enter', element), ('leave', element), ('border', element), ('text', element, raw, in a link) of block elements, with the ends that pages leave out."""
    top = Element("", None, "", False, "")
    stack, links = [top], 0
    for token in tokens(html):
        if token[0] == "text":
            yield ("text", stack[-1], token[1], links > 0)
            continue
        tag = token[1]
        if tag == "a":
            links = int(token[0] == "open")
        if tag == "br":
            yield ("text", stack[-1], " ", False)
        if tag in INLINE:
            continue
        if token[0] == "close":
            if any(e.tag == tag for e in stack[1:]):
                while True:
                    element = stack.pop()
                    yield ("leave", element)
                    if element.tag == tag:
                        break
            continue
        if tag in VOID:
            yield ("border", stack[-1])
            continue
        ends = ENDS.get(tag, set()) | {"p"} if tag not in RAW else set()
        depth = len(stack)
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ends:
                depth = k
            elif stack[k].tag in HOLDS:
                break
        while len(stack) > depth:
            yield ("leave", stack.pop())
        above, words = stack[-1], _words(token[2])
        region = above.region
        if tag == "article" or "articlebody" in token[2].get("itemprop", "").lower():
            region = "article"
        elif not region and (tag == "main" or "main" == token[2].get("role")):
            region = "main"
        own = tag in ("html", "body", "main") or tag == "article" and not words & {"comment", "comments", "related", "ad", "ads", "advert", "promo"}
        barred = above.barred or _hidden(token[2]) or not own and (tag in NEVER or bool(words & WORDS) or not region and (tag == "header" or bool(words & OUTSIDE)))
        mark = "!" * (barred and not above.barred) or {"article": "@", "main": "~"}.get(region if region != above.region else "", "")
        element = Element(tag, above, mark + ".".join([tag, *sorted(w for w in words if len(w) > 1)]), barred, region)
        stack.append(element)
        yield ("enter", element)
    while len(stack) > 1:
        yield ("leave", stack.pop())


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def children(html: str):
    """(parent, key, element, text, characters in links) of all that is not barred, in the order of the page: elements (text is None), barred ones
    without their contents, and with the key "#" the runs of text between the borders of block elements (element is None)."""
    parts, linked, owner = [], 0, None
    for event in events(html):
        if event[0] == "text":
            owner = event[1]
            if not owner.barred:
                parts.append(event[2])
                linked += len(event[2].strip()) * event[3]
            continue
        if parts:
            if text := _clean(parts):
                yield owner, "#", None, text, linked
            parts, linked = [], 0
        if event[0] == "enter" and not event[1].above.barred:
            yield event[1].above, event[1].key, event[1], None, 0
    if parts and (text := _clean(parts)):
        yield owner, "#", None, text, linked


def _above(path: str) -> str:
    return path.rpartition("/")[0]


#: What is noted of a group: how often it occurs, how many of the groups around it have it, whether a page has it several times, its characters and
#: those in links, its text, other texts of its pages, and the keys that directly follow it.
TIMES, HOLDERS, SEVERAL, CHARS, LINKED, TEXT, OTHERS, NEXT = range(8)


class Wrapper:
    """A regular expression without unions, as groups by their paths. A text's group has a constant's digest, or None for a slot, and for a constant up to
    DIFFERENT digests (the smallest) of what else is on the pages that have it. The order of a group's children is what followed what on any page: children that
    reach each other that way are one repeated group, the others come one after the other. So pages can be aligned in any order."""

    def __init__(self, pages: int = 0, groups: dict | None = None):
        self.pages, self.groups = pages, groups or {}

    def align(self, html: str) -> None:
        """Takes the page's stream into the expression."""
        own: dict[str, list] = {}
        sums: dict[str, int] = {}
        for parent, key, _, text, linked in children(html):
            path = f"{parent.path}/{key}" if parent.path else key
            group = own.setdefault(path, [0, 0, False, 0, 0, "", [], set()])
            group[TIMES] += 1
            if key not in parent.keys:
                parent.keys.add(key)
                group[HOLDERS] += 1
            if parent.last is not None:
                parent.last[NEXT].add(key)
            parent.last = group
            group[SEVERAL] = group[TIMES] > 1
            if text is not None:
                group[CHARS] += len(text)
                group[LINKED] += min(linked, len(text))
                digest = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).hexdigest()
                group[TEXT] = None if group[SEVERAL] else digest
                sums[path] = sums.get(path, 0) + int(digest, 16)
        page = sum(sums.values())
        for path, g in own.items():
            g[OTHERS] = [f"{page - sums[path]:x}"] if g[TEXT] else []
            g[NEXT] = sorted(g[NEXT])
        self.merge(Wrapper(1, own))

    def merge(self, other: Wrapper) -> None:
        """Mismatches: a group that one side lacks is optional (fewer holders), a differing text becomes a slot, and what follows each other in both orders a repetition."""
        self.pages += other.pages
        for path, b in other.groups.items():
            a = self.groups.get(path)
            if a is None:
                self.groups[path] = list(b)
                continue
            text = a[TEXT] if a[TEXT] == b[TEXT] else None
            others = sorted({*a[OTHERS], *b[OTHERS]})[:DIFFERENT] if text else []
            follow = a[NEXT] if a[NEXT] == b[NEXT] else sorted({*a[NEXT], *b[NEXT]})
            self.groups[path] = [a[TIMES] + b[TIMES], a[HOLDERS] + b[HOLDERS], a[SEVERAL] or b[SEVERAL], a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], text, others, follow]

    def dumps(self) -> str:
        return json.dumps([self.pages, dict(sorted(self.groups.items()))], separators=(",", ":"))

    @staticmethod
    def loads(text: str) -> Wrapper:
        pages, groups = json.loads(text)
        return Wrapper(pages, groups)

    def sequences(self) -> dict[str, list[tuple[bool, list[str]]]]:
        """For each path that has children the parts that follow each other there: whether a part is repeated, and its keys (several only if it is)."""
        below: dict[str, list[str]] = {}
        for path in sorted(self.groups):
            below.setdefault(_above(path), []).append(path)
        return {parent: _in_order({p.rpartition("/")[2]: self.groups[p][NEXT] for p in paths}) for parent, paths in below.items()}

    def expression(self) -> str:
        """The expression as text: ``(…)?`` optional, ``(…)+`` repeated, #TEXT a slot, #SAME a constant text."""
        parts, shown = self.sequences(), {}

        def inside(parent: str) -> str:
            out = []
            for repeated, keys in parts.get(parent, ()):
                paths = [f"{parent}/{k}" if parent else k for k in keys]
                around = self.groups[parent][TIMES] if parent else self.pages
                items = [f"({shown[p]})?" if len(paths) > 1 else shown[p] for p in paths]
                item = f"({''.join(items)})+" if repeated else items[0]
                out.append(f"({item})?" if len(paths) == 1 and self.groups[paths[0]][HOLDERS] < around else item)
            return "".join(out)

        for path in sorted(self.groups, key=lambda p: (-p.count("/"), p)):
            key = path.rpartition("/")[2]
            shown[path] = ("#SAME" if self.groups[path][TEXT] else "#TEXT") if key == "#" else f"<{key}>{inside(path)}"
        return inside("")

    def _root(self, template: set[str]) -> str:
        """The group that holds the running text: the innermost with most of the text around it that is neither template nor links."""
        mass: dict[str, int] = {}
        for path, g in self.groups.items():
            if path.endswith("#") or path + "/#" in template:
                continue
            chars = self.groups[path + "/#"][CHARS] if path + "/#" in self.groups else 0
            while path:
                mass[path] = mass.get(path, 0) + chars
                path = _above(path) if chars or _above(path) not in mass else ""
        inner: dict[str, list[str]] = {}
        holding = {_above(p) for p in mass}
        for p in mass:
            if p in holding:
                inner.setdefault(_above(p), []).append(p)
        root, around = "", sum(m for p, m in mass.items() if "/" not in p)
        while True:
            best = max(inner.get(root, ()), key=lambda p: (mass[p], p), default=None)
            if best is None or mass[best] < 0.8 * around:
                return root
            root, around = best, mass[best]

    def plan(self) -> tuple[str, list[str]]:
        """The expression to read pages along, with the part that each slot has in it (0: marked as article, 1: main part, 2: in the group of the running text,
        3: elsewhere), and the slots of template text and of links. Copies of a page make no template."""
        template = {p for p, g in self.groups.items() if g[TEXT] and len(g[OTHERS]) >= DIFFERENT or g[CHARS] and g[LINKED] > 0.5 * g[CHARS]}
        root = self._root(template)
        number = {"": 0} | {p: k for k, p in enumerate(sorted(self.groups), 1)}
        nodes: list[list] = [[] for _ in number]
        for parent, parts in self.sequences().items():
            nodes[number[parent]] = [[int(repeated), *([k, number[f"{parent}/{k}" if parent else k]] for k in keys)] for repeated, keys in parts]
        place = ["-"] * len(number)
        for path, k in number.items():
            if path == "#" or path.endswith("/#"):
                marks = {key[:1] for key in path.split("/")}
                inside = not root or path.startswith(root + "/")
                place[k] = "0" if "@" in marks else "1" if "~" in marks else "2" if inside else "3"
        return json.dumps([nodes, "".join(place)], separators=(",", ":")), [str(number[p]) for p in sorted(template)]


def _in_order(follow: dict[str, list[str]]) -> list[tuple[bool, list[str]]]:
    """Keys that reach each other by what follows what are one repeated part; parts in an order that agrees with every page, else by name."""
    index, low, on, stack, part = {}, {}, set(), [], {}
    for first in sorted(follow):
        if first in index:
            continue
        todo = [(first, iter(follow[first]))]
        index[first] = low[first] = len(index)
        stack.append(first)
        on.add(first)
        while todo:
            key, rest = todo[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    on.add(other)
                    todo.append((other, iter(follow[other])))
                    break
                if other in on:
                    low[key] = min(low[key], index[other])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[key])
                if low[key] == index[key]:
                    while True:
                        member = stack.pop()
                        on.discard(member)
                        part[member] = key
                        if member == key:
                            break
    members: dict[str, list[str]] = {}
    for key in sorted(follow):
        members.setdefault(part[key], []).append(key)
    after = {p: {part[o] for k in keys for o in follow[k]} - {p} for p, keys in members.items()}
    waiting = {p: 0 for p in members}
    for found in after.values():
        for p in found:
            waiting[p] += 1
    free, out = [(members[p][0], p) for p, n in waiting.items() if not n], []
    heapq.heapify(free)
    while free:
        _, p = heapq.heappop(free)
        out.append((len(members[p]) > 1 or members[p][0] in follow[members[p][0]], members[p]))
        for q in after[p]:
            waiting[q] -= 1
            if not waiting[q]:
                heapq.heappush(free, (members[q][0], q))
    return out


@functools.lru_cache(16)
def _steps(expression: str) -> tuple[list[dict[str, tuple[int, int, int]]], str]:
    """For each group of the expression its children by key: the part they belong to, whether that is repeated, and their group."""
    nodes, place = json.loads(expression)
    return [{key: (rank, part[0], node) for rank, part in enumerate(parts) for key, node in part[1:]} for parts in nodes], place


def read(html: str, expression: str):
    """(slot, text) of each text of the page, read along the expression; the slot is None from where the page does not follow it."""
    nodes = _steps(expression)[0]
    for parent, key, element, text, _ in children(html):
        step = None if parent.node is None else nodes[parent.node].get(key)
        if step is not None and step[0] < parent.rank:
            step = None
        if step is not None:
            parent.rank = step[0] if step[1] else step[0] + 0.5  # a part that is not repeated is over
        if element is not None:
            element.node = None if step is None else step[2]
        else:
            yield (None if step is None else step[2]), text


def main_text(html: str, expression: str = "", template: frozenset[str] = frozenset()) -> str:
    """The article's blocks, joined by line ends.

    What the page has in the slots that are marked as article (or else as main part); otherwise what it has in the group of the running text without
    template text and groups of links, or, if it lacks that group, all of it without them. A page that does not follow the expression is read along its own.
    """
    found = list(read(html, expression)) if expression else [(None, "")]
    if any(slot is None for slot, _ in found):
        own = Wrapper()
        own.align(html)
        expression, links = own.plan()
        found, template = list(read(html, expression)), frozenset(links)
    place = _steps(expression)[1]
    for mark in "01":
        if chosen := [text for slot, text in found if place[slot] == mark]:
            return "\n".join(chosen)
    inside = [(slot, text) for slot, text in found if place[slot] == "2"]
    return "\n".join(text for slot, text in inside or found if str(slot) not in template)


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _partial(batches):
    for batch in batches:
        found: dict[str, Wrapper] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            found.setdefault(host, Wrapper()).align(page.as_py() or "")
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([w.dumps() for w in found.values()], pa.string())], ["host", "wrapper"])


def _merged(batches):
    found: dict[str, Wrapper] = {}
    for batch in batches:
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.setdefault(host, Wrapper()).merge(Wrapper.loads(text))
    for host, w in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([w.dumps()])], ["host", "wrapper"])


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) over all pages; a url without host belongs to the host "".

    Merging is associative and gives one result in any order: every task merges what it reads, then parts of a host are merged in salted groups, then these.
    """
    shape = "host string, wrapper string"
    parts = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(_partial, shape)
    parts = parts.repartition("host", F.pmod(F.xxhash64("wrapper"), F.lit(32))).mapInArrow(_merged, shape)
    return parts.repartition("host").mapInArrow(_merged, shape)


def _planned(batches):
    for batch in batches:
        plans = [Wrapper.loads(w).plan() for w in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([p[0] for p in plans], pa.string()), pa.array([p[1] for p in plans], pa.list_(pa.string()))], ["host", "expression", "template"]
        )


def _extracted(batches):
    for batch in batches:
        ids, urls = (batch.column(k).to_pylist() for k in (0, 1))
        rows = zip(*(batch.column(k) for k in (2, 3, 4)))
        texts = [main_text(page.as_py() or "", expression.as_py() or "", frozenset(t.as_py() or ())) for page, expression, t in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html (null is empty; without text: an empty string).

    Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and reader comments are no article. White space within a
    block is one blank; blocks are joined by a line end. A null or odd url is kept as it is, and belongs to the host "". Further columns are not read.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    plans = host_wrappers(source).mapInArrow(_planned, "host string, expression string, template array<string>")
    rows = source.withColumn("host", _host("url")).join(plans, "host", "left").select("page_id", "url", "html", "expression", "template")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
