"""Main text of web pages by union-free wrappers of each host.

A page is a stream of tags and texts. Inline tags belong to their text; block tags give
the structure. Runs of like siblings fold into repeated groups, so pages of one template
have few different streams, and a host's wrapper comes from aligning all of them one
after the other: tags that match are aligned inside, what only one side has becomes
optional, neighbours of one kind become a repeated group, and texts are slots. Streams are
made distinct by aggregation first and merged in rounds: a host's streams are counted and
dealt into parts of about TREES, each part becomes one stream, until a host has one. No
task sees a host's pages or all of its streams.

A slot is a place in the wrapper, not a path: every page is laid into its host's wrapper
(repeated items take runs of like siblings, optional ones may stay empty) and each text
belongs to the slot it falls into. Slots in menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are dropped; slots in an article or main element are
text; of other slots those are text that are not mostly links, without their template
texts: texts that stand on every page that fills the slot, or that has texts of its path,
if these pages differ in other texts; copies of one page show no template.
A page that fills slots in an article or main element gives only those, else the others.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from functools import lru_cache, reduce
from itertools import count, groupby
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.session import materialise, spread

TREES = 250         # distinct trees of a host that a task merges in a round, on average
BROADCAST_HOSTS = 100_000
CONSTANT_FROM = 3   # a text that all pages have in a slot is template text if they have so many different contents
MEMO = 20_000       # choices and wrappers remembered in a task

DEPTH = 100         # levels of a tree; elements that lie deeper hang side by side below the last one
CELLS = 4_000_000   # of a table held as a whole; of longer lists some rows are held and the others made again

# Every tag found ends at some ">" of the text it is given, so no start is scanned in vain.
# Quotes count only where a value begins; one that never closes is part of an unquoted value.
_TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|(\Z)))|!\[CDATA\[.*?(?:\]\]>|(\Z))|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)>)", re.S
)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
BLOCKS = frozenset(
    "address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "iframe legend li main menu nav noscript ol option p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
RAW = frozenset(("script", "style"))
VOID = frozenset(("hr", "br", "img", "input", "meta", "link", "wbr", "source", "col", "base", "area", "embed", "track"))
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
for _tag in BLOCKS - set(CLOSES) - {"body", "html", "head", "button", "option", "textarea"}:
    CLOSES[_tag] = {"p"}
FENCES = frozenset("table ul ol dl div section article main body td th form nav aside header footer".split())  # what implied ends don't leave
DROPPED_TAGS = frozenset("nav footer aside form button select option textarea noscript template iframe svg head title dialog menu video audio fieldset".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login search social share sharing related recommended comment comments "
    "disqus reply replies respond widget pagination pager toolbar".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset(("articlebody", "main", "article"))
_RAW_ENDS = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}


def _key(tag: str, attributes: str) -> str:
    """tag, or tag.name.name of its class, id and role words, digits as 0."""
    if not attributes or "=" not in attributes:
        return tag
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower()
    words = sorted(set(re.findall(r"[a-z]+(?:\d+)?", re.sub(r"\d+", "0", names))))
    return ".".join([tag, *words])


@lru_cache(MEMO)
def _within(role: str, key: str) -> str:
    """Role of what lies in an element of this key, itself in one of this role: "drop", "main" or "other"."""
    if role == "drop":
        return role
    inside = role == "main"
    tag, *names = key.split(".")
    if tag in DROPPED_TAGS or tag == "header" and not inside or tag not in ("body", "html") and not DROPPED_NAMES.isdisjoint(names) and not (inside and names == ["header"]):
        return "drop"
    return "main" if inside or tag in MAIN_TAGS or not MAIN_NAMES.isdisjoint(names) else "other"


def role(path: str) -> str:
    """Role of a slot, from the elements it lies in."""
    return reduce(_within, path.split("/"), "other")


def blocks(page: str):
    """(path, role, text, link characters, number of its text node) of every text block, and the page's tree.

    Roles follow all elements around a text. Paths and the tree have DEPTH levels and, for
    what lies deeper, one more.
    """
    root: list = ["", []]
    stack, paths, roles, tree = [], [""], ["other"], [root]
    places: dict = {}  # positions in the stack of every open tag
    out, pieces, links, anchors, at, nodes = [], [], 0, 0, 0, 0

    def flush():
        nonlocal pieces, links, nodes
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            if len(stack) > DEPTH and tree[DEPTH][1][-1] is not tree[-1]:
                tree[-1] = [tree[-1][0], []]  # goes on after deeper elements
                tree[DEPTH][1].append(tree[-1])
            kids = tree[-1][1]
            if not kids or kids[-1][0] != "#":
                kids.append(["#", []])
                nodes += 1
            out.append((paths[-1], roles[-1], text, links, nodes - 1))
        pieces, links = [], 0

    def leave(n):
        for name in reversed(stack[n:]):
            places[name].pop()
        del stack[n:], paths[n + 1:], roles[n + 1:], tree[n + 1:]

    def enter(name, key):
        level = len(stack)
        path = f"{paths[min(level, DEPTH)]}/{key}" if level else key
        node = [key, []]
        tree[min(level, DEPTH)][1].append(node)
        places.setdefault(name, []).append(level)
        stack.append(name), paths.append(sys.intern(path) if level >= DEPTH else path), roles.append(_within(roles[-1], key)), tree.append(node)

    end, found = page.rfind(">") + 1, None  # no tag ends behind it
    while at < end and (found := _TOKEN.search(page, at, end)):
        text, at, name = page[at:found.start()], found.end(), found[4]
        if text:
            pieces.append(text)
            links += len(text) if anchors else 0
        if not name:
            if found[1] is not None or found[2] is not None:  # open to the end
                at = len(page)
            continue
        name = name.lower()
        if found[3]:
            if name in BLOCKS:
                flush()
                if places.get(name):
                    leave(places[name][-1])
            elif name == "a":
                anchors = max(0, anchors - 1)
            continue
        if name in RAW:
            shut = _RAW_ENDS[name].search(page, at)
            at = page.find(">", shut.end() - 1) + 1 if shut else 0
            at = at or len(page)
            continue
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            anchors += 1
        elif name in BLOCKS:
            flush()
            shut = CLOSES.get(name, ())
            while shut:
                last = max((places[tag][-1] for tag in shut if places.get(tag)), default=-1)
                if last < 0 or last <= max((places[tag][-1] for tag in FENCES if tag not in shut and places.get(tag)), default=-1):
                    break
                leave(last)
            if name not in VOID:
                enter(name, _key(name, found[5]))
    if at < len(page):
        pieces.append(_CUT.sub("", page[at:]))
    flush()
    return out, root[1]


def fold(kids: list) -> list:
    """Items [key, kids, repeated, optional] with neighbours of one kind folded into a group."""
    out: list = []
    for kid in kids:
        item = [kid[0], fold(kid[1]), kid[2] if len(kid) > 2 else 0, kid[3] if len(kid) > 2 else 0]
        if out and out[-1][0] == item[0]:
            out[-1] = [item[0], align(out[-1][1], item[1]), 1, out[-1][3] & item[3]]
        else:
            out.append(item)
    return out


def align(one: list, two: list) -> list:
    """One list of items that both lists match, mismatches resolved to optional or repeated items."""
    if one == two:
        return one
    n, m = len(one), len(two)
    if n * m > CELLS:
        return fold(_aligned_by_rows(one, two))
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if one[i][0] == two[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and one[i][0] == two[j][0]:
            a, b = one[i], two[j]
            out.append([a[0], align(a[1], b[1]), a[2] | b[2], a[3] | b[3]])
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([one[i][0], one[i][1], one[i][2], 1])
            i += 1
        else:
            out.append([two[j][0], two[j][1], two[j][2], 1])
            j += 1
    return fold(out)


def _rows(n: int, last: np.ndarray, above):
    """Getter of rows 0 to n of a table that `above(i, row i + 1)` makes from its last row upwards.

    About twice the square root of n rows are held; rows asked for in ascending order are
    made twice in all.
    """
    every = isqrt(n) + 1
    row, held, near = last, {n: last}, {}
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % every == 0:
            held[i] = row

    def at(i):
        if i not in near:
            near.clear()
            start = i - i % every
            stop = min(start + every, n)
            near[stop] = held[stop]
            for k in range(stop - 1, start - 1, -1):
                near[k] = above(k, near[k + 1])
        return near[i]

    return at


def _aligned_by_rows(one: list, two: list) -> list:
    """The items of `align` before folding, for lists whose table is not held as a whole."""
    n, m = len(one), len(two)
    kinds = {item[0]: at for at, item in enumerate(one)}
    left, right = [kinds[item[0]] for item in one], np.array([kinds.get(item[0], -1) for item in two])

    def above(i, row):
        best = row.copy()
        best[:-1] = np.where(right == left[i], row[1:] + 1, row[:-1])
        return np.maximum.accumulate(best[::-1])[::-1]

    row = _rows(n, np.zeros(m + 1, np.int32), above)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and one[i][0] == two[j][0]:
            a, b = one[i], two[j]
            out.append([a[0], align(a[1], b[1]), a[2] | b[2], a[3] | b[3]])
            i, j = i + 1, j + 1
        elif j == m or i < n and row(i)[j + 1] <= row(i + 1)[j]:
            out.append([one[i][0], one[i][1], one[i][2], 1])
            i += 1
        else:
            out.append([two[j][0], two[j][1], two[j][2], 1])
            j += 1
    return out


def slots(items: list, above: tuple = (), repeated: int = 0, optional: int = 0):
    """(path, repeated, optional) of every text slot of a wrapper."""
    for key, kids, again, maybe in items:
        if key == "#":
            yield "/".join(above), repeated, optional | maybe
        else:
            yield from slots(kids, above + (key,), repeated | again, optional | maybe)


def _numbered(items: list, numbers) -> list:
    """Items (key, kids, optional); a text has its slot's number, in the order of `slots`, for kids."""
    return [(key, next(numbers) if key == "#" else _numbered(kids, numbers), maybe) for key, kids, _, maybe in items]


def _shape(kids: list) -> tuple:
    return tuple((item[0], _shape(item[1])) for item in kids)


def _fitted(shape: tuple, items: list, memo: dict) -> tuple:
    """(cost, item of each kid or None): the cheapest way to lay folded kids into items, in order.

    A kid without an item costs 100, an item that is not optional and stays empty 1.
    """
    found = memo.get((id(items), shape))
    if found:
        return found
    n, m = len(shape), len(items)
    if n * m > CELLS:
        memo[id(items), shape] = _fitted_by_rows(shape, items, memo)
        return memo[id(items), shape]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    step = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            ways = []
            if i < n and j < m and shape[i][0] == items[j][0]:
                below = 0 if shape[i][0] == "#" else _fitted(shape[i][1], items[j][1], memo)[0]
                ways.append((below + best[i + 1][j + 1], 0))
            if j < m:
                ways.append((1 - items[j][2] + best[i][j + 1], 1))
            if i < n:
                ways.append((100 + best[i + 1][j], 2))
            best[i][j], step[i][j] = min(ways, default=(0, 0))
    chosen, i, j = [], 0, 0
    while i < n:
        way = step[i][j]
        if way != 1:
            chosen.append(None if way else j)
            i += 1
        j += way != 2
    memo[id(items), shape] = best[0][0], chosen
    return best[0][0], chosen


def _fitted_by_rows(shape: tuple, items: list, memo: dict) -> tuple:
    """What `_fitted` gives, for lists whose table is not held as a whole."""
    n, m = len(shape), len(items)
    empty = np.array([1 - item[2] for item in items], np.int64)
    passed = np.concatenate([[0], np.cumsum(empty)])  # cost of the items before, all empty
    none = 1 << 60

    @lru_cache(64)
    def costs(kid):
        """Cost of the kid below each item."""
        return np.array([none if kid[0] != item[0] else 0 if kid[0] == "#" else _fitted(kid[1], item[1], memo)[0] for item in items], np.int64)

    def above(i, row):
        best = row + 100
        best[:-1] = np.minimum(best[:-1], costs(shape[i]) + row[1:])
        return np.minimum.accumulate((best + passed)[::-1])[::-1] - passed

    row = _rows(n, passed[-1] - passed, above)
    chosen, i, j = [], 0, 0
    while i < n:
        here, below = row(i), row(i + 1)
        if j < m and costs(shape[i])[j] + below[j + 1] == here[j]:
            chosen.append(j)
            i, j = i + 1, j + 1
        elif j < m and empty[j] + here[j + 1] == here[j]:
            j += 1
        else:
            chosen.append(None)
            i += 1
    return int(row(0)[0]), chosen


def _only_way(keys: tuple, items: list):
    """Item of each kid if there is just one way to lay the kids into items, else None."""
    first, last, at = [], [], 0
    for key in keys:
        while at < len(items) and items[at][0] != key:
            at += 1
        if at == len(items):
            return None
        first.append(at)
        at += 1
    at = len(items) - 1
    for key in reversed(keys):
        while items[at][0] != key:
            at -= 1
        last.append(at)
        at -= 1
    return first if first == last[::-1] else None


def place(kids: list, items: list, memo: dict, out: list) -> list:
    """Slot of every text node of a page's tree in a numbered wrapper, None where it has no place."""
    runs = [(key, [kid[1] for kid in run]) for key, run in groupby(kids, lambda kid: kid[0])]
    keys = tuple(key for key, _ in runs)
    if (id(items), keys) not in memo:
        memo[id(items), keys] = _only_way(keys, items)
    ways = memo[id(items), keys]
    if ways is None:
        ways = _fitted(_shape(fold(kids)), items, memo)[1]
    for (key, among), way in zip(runs, ways):
        if key == "#":
            out.append(None if way is None else items[way][1])
        else:
            for inner in among:
                place(inner, () if way is None else items[way][1], memo, out)
    return out


class _Hosts:
    """Models of hosts, read once a task, and the choices made in their wrappers."""

    def __init__(self):
        self.held = {}

    def slots(self, model: str, tree: list):
        """(wrapper's judgement, slots of the page's text nodes)."""
        if model not in self.held:
            if len(self.held) >= 1000:
                self.held.clear()
            read = json.loads(model)
            self.held[model] = _numbered(json.loads(read["wrapper"]), count()), {}, set(read.get("content", ())), set(read.get("fixed", ()))
        items, memo, content, fixed = self.held[model]
        if len(memo) > MEMO:
            memo.clear()
        return content, fixed, place(tree, items, memo, [])


def _observing(batches):
    """Distinct folded trees of every host."""
    seen: set = set()

    def rows():
        columns = list(zip(*seen)) or [()] * 2
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "name"])

    for part in common.slices(batches, "html"):
        for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
            tree = fold(blocks(page or "")[1])
            if tree:
                seen.add((host, json.dumps(tree, separators=(",", ":"))))
        if len(seen) > 20_000:
            yield rows()
    yield rows()


def _mark(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


_JUDGED = "host string, kind int, name string, mark long, n long, chars long, links long"


def _judging(batches):
    """Rows per host and place, which is a slot's number or a path: kind 0 sizes, kind 1 a text of all its pages here, kind 2 a content of its pages.

    `n` counts the rows of a place (kind 0) and those that hold the text (kind 1). A page's
    content is all its texts that are not dropped; CONSTANT_FROM contents of a place are enough.
    """
    hosts, seen = _Hosts(), {}

    def rows():
        out = []
        for (host, name), (chars, links, texts, contents) in seen.items():
            out.append((host, 0, name, 0, 1, chars, links))
            out += [(host, 1, name, mark, 1, 0, 0) for mark in texts]
            out += [(host, 2, name, mark, 1, 0, 0) for mark in contents]
        seen.clear()
        columns = list(zip(*out)) or [()] * 7
        types = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "kind", "name", "mark", "n", "chars", "links"])

    for part in common.slices(batches, "html"):
        for host, page, model in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), part.column("model").to_pylist()):
            found, tree = blocks(page or "")
            if model is None or not found:
                continue
            _, _, at = hosts.slots(model, tree)
            mine: dict = {}
            for path, part_of, text, links, node in found:
                if part_of == "other":
                    mark = _mark(text)
                    for name in (str(at[node]), "/" + path):
                        held = mine.setdefault(name, [0, 0, set()])
                        held[0] += len(text)
                        held[1] += min(links, len(text))
                        held[2].add(mark)
            content = _mark("\n".join(text for _, part_of, text, _, _ in found if part_of != "drop"))
            for name, (chars, links, texts) in mine.items():
                held = seen.get((host, name))
                if held is None:
                    seen[host, name] = [chars, links, texts, {content}]
                else:
                    held[0] += chars
                    held[1] += links
                    held[2] &= texts
                    if len(held[3]) < CONSTANT_FROM:
                        held[3].add(content)
        if len(seen) > 20_000:
            yield rows()
    yield rows()


def _merged(pdf: pd.DataFrame) -> list:
    wrapper: list = []
    for n, tree in enumerate(sorted(pdf["name"])):
        wrapper = align(wrapper, json.loads(tree)) if n else json.loads(tree)
    return wrapper


def _merge_part(key, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [key[0]], "name": [json.dumps(_merged(pdf), separators=(",", ":"))]})


def _listing(batches):
    for batch in batches:
        for host, wrapper in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
            found = list(slots(json.loads(wrapper)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([host] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array([p for p, _, _ in found], pa.string()), pa.array([role(p) for p, _, _ in found], pa.string()),
                    pa.array([bool(r) for _, r, _ in found], pa.bool_()), pa.array([bool(o) for _, _, o in found], pa.bool_()),
                ],
                names=["host", "slot", "path", "role", "repeated", "optional"],
            )


def host_of(url):
    """Lowered host name of a URL, empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)


def wrapped(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one wrapper per host, as JSON."""
    trees = materialise(pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_observing, "host string, name string").distinct(), "wrapper-trees")
    while True:
        counted = materialise(trees.groupBy("host").agg(F.ceil(F.count("*") / TREES).alias("parts")).filter("parts > 1"), "wrapper-counts")
        large = counted.count()
        dealt = trees.join(F.broadcast(counted) if large <= BROADCAST_HOSTS else counted, "host", "left")
        dealt = spread(dealt.withColumn("part", F.pmod(F.xxhash64("name"), F.coalesce("parts", F.lit(1)))), "host", "part")
        trees = materialise(dealt.groupBy("host", "part").applyInPandas(_merge_part, "host string, name string"), "wrapper-trees")
        if not large:
            return trees.withColumnRenamed("name", "wrapper")


def _beside(pages: DataFrame, models: DataFrame, few: bool) -> DataFrame:
    """(page_id, url, html, host, model) of all pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    return rows.join(F.broadcast(models) if few else models, "host", "left").select("page_id", "url", "html", "host", "model")


def infer(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Wrappers, their slots, template texts and whether the slots are few enough to travel to every task.

    Wrappers: (host, wrapper). Slots: (host, slot, path, role, repeated, optional, content).
    Template texts: (host, name, mark), `name` a slot's number or "/" and a path.
    """
    found = wrapped(pages)
    listed = materialise(found.mapInArrow(_listing, "host string, slot long, path string, role string, repeated boolean, optional boolean"), "wrapper-slots")
    few = listed.count() <= BROADCAST_HOSTS
    models = found.select("host", F.to_json(F.struct("wrapper")).alias("model"))
    judged = materialise(
        _beside(pages, models, few).select("host", "html", "model").mapInArrow(_judging, _JUDGED)
        .groupBy("host", "kind", "name", "mark").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links")]),
        "wrapper-judged",
    )
    sizes = judged.filter("kind = 0").select("host", "name", F.col("n").alias("all"), "chars", "links")
    varied = judged.filter("kind = 2").groupBy("host", "name").count().filter(F.col("count") >= CONSTANT_FROM).select("host", "name")
    fixed = judged.filter("kind = 1").join(sizes.select("host", "name", "all").join(varied, ["host", "name"]), ["host", "name"]).filter("n = all").select("host", "name", "mark")
    linked = sizes.filter(2 * F.col("links") > F.col("chars")).select("host", "name", F.lit(True).alias("linked"))
    told = listed.withColumn("name", F.col("slot").cast("string")).join(linked, ["host", "name"], "left")
    content = (F.col("role") == "main") | ((F.col("role") == "other") & F.col("linked").isNull())
    return found, told.select("host", "slot", "path", "role", "repeated", "optional", content.alias("content")), fixed, few


def _extracting(batches):
    hosts = _Hosts()
    for part in common.slices(batches, "html"):
        texts = []
        for page, model in zip(part.column("html").to_pylist(), part.column("model").to_pylist()):
            found, tree = blocks(page or "")
            if model is None or not found:
                texts.append("")
                continue
            content, fixed, at = hosts.slots(model, tree)
            inside = [text for _, part_of, text, _, _ in found if part_of == "main"]
            texts.append("\n".join(inside or [
                text for path, part_of, text, _, node in found
                if part_of == "other" and at[node] in content and f"{at[node]}:{_mark(text)}" not in fixed and f"/{path}:{_mark(text)}" not in fixed
            ]))
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: (page_id, url, text, n_chars).

    Null and empty html give an empty text. Pages without a host form one group of their
    own. Repeated rows are extracted each. Broken markup is read as far as it goes; a tag cut off at
    the end is dropped. Pages are read in time linear in their length, however deep or
    broken; their trees keep DEPTH levels. Columns other than page_id, url and html are ignored.
    """
    found, told, fixed, few = infer(pages)
    content = told.filter("content").groupBy("host").agg(F.collect_set("slot").alias("content"))
    templates = fixed.groupBy("host").agg(F.collect_set(F.concat_ws(":", "name", F.col("mark").cast("string"))).alias("fixed"))
    models = found.join(content, "host", "left").join(templates, "host", "left").select("host", F.to_json(F.struct("wrapper", "content", "fixed")).alias("model"))
    models = materialise(models, "wrapper-models")
    return _beside(pages, models, few).mapInArrow(_extracting, "page_id long, url string, text string, n_chars long")
