"""Main text of web pages by wrapper induction.

Every page becomes a skeleton: its tree of block elements, neighbouring siblings of
one kind folded into one, with a hash and length of the text at each node.  Kinds are the
tag and those class and id words without digits that recur over the host's pages.  Pages of
a host are aligned with the reference skeleton of their group (the most common one) by
simple tree matching.  A node whose text varies is a slot; a text that ``TEMPLATE_SHARE``
of a node's pages have (``TEMPLATE_PAGES`` at least, copies of a page count once) is
template.  The counts of all groups of a host add up, and the element that holds the slots
(an article or main, if one varies) becomes the host's wrapper; a page's main text is what
lies below the wrapper's element, without what is set apart there and its template texts.
In an article or main, headings and texts that lead to varying ones are the author's, though they recur.

A host may hold any share of the pages: its skeletons are dealt into groups of about
``GROUP_PAGES``, and only counts are brought together by host.  Defined results: a null
or empty html has no text; a null url belongs to a host of its own name, the empty one;
a page without the wrapper's element, or of a host with one page, falls back on its
article, its main element, or its body; repeated rows are read each; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import table, written
from ebbflow.llm.dom import Node, blocks, parse

GROUP_PAGES = 500
SLOT_SHARE = 0.8
#: A table of hosts up to this size is sent to every task; beyond it rows are salted.
SHIPPED_BYTES = 4 << 20
SALTS = 32
#: Pages with different texts from which on an equal text counts as template.
TEMPLATE_PAGES = 3
TEMPLATE_SHARE = 0.05
#: Share of a host's pages from which on a class or id word names a kind; it also bounds their number.
NAME_SHARE = 0.01
NAMES = re.compile(r"[\s\"'](?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CONTENT = ("article", "main")
#: Below an article or main these, and what varying text follows under the same parent, stay though they recur.
TITLES = frozenset("h1 h2 h3 h4 h5 h6 caption figcaption dt th summary legend".split())
HOLDERS = ("html", "body", "main", "article", "section", "div", "td", "table", "center", "")
STATS = "host string, path long, parent long, depth int, tag string, digest long, pages long, chars long, title boolean"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def hashed(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace")) >> 1


# A skeleton node: [label, tag, text hash, text length, has a title, children, shape, size, elements];
# set-apart elements are left out.


def relabel(root: Node, names: frozenset[str]) -> Node:
    """The tree with only ``names`` left in its labels."""
    todo = [root]
    while todo:
        x = todo.pop()
        _, _, own = x.label.partition(".")
        if own:
            x.label = ".".join([x.tag, *(w for w in own.split(".") if w in names)])
        todo.extend(x.children)
    return root


def skeleton(root: Node) -> list:
    top: list = []
    made: list[tuple[list, list[str]]] = []
    todo: list[tuple[list[Node], list]] = [([root], top)]
    while todo:
        nodes, siblings = todo.pop()
        node = [nodes[0].label, nodes[0].tag, 0, 0, nodes[0].tag == "h1", [], 0, 1, nodes]
        siblings.append(node)
        made.append((node, [" ".join("".join(x for x in n.parts if type(x) is str).split()) for n in nodes]))
        runs: list[list[Node]] = []
        for c in (c for n in nodes for c in n.children if not c.aside):
            if runs and runs[-1][0].label == c.label:
                runs[-1].append(c)
            else:
                runs.append([c])
        todo.extend((run, node[5]) for run in reversed(runs))
    for node, own in reversed(made):  # children come after their parents
        below = node[5]
        node[2] = hashed(node[0], *own, "", *(c[2] for c in below))
        node[3] = len("\n".join(own).strip("\n")) + sum(c[3] for c in below)
        node[4] = node[4] or any(c[4] for c in below)
        node[6] = hashed(node[0], *(c[6] for c in below))
        node[7] = 1 + sum(c[7] for c in below)
    return top[0]


def packed(root: list) -> str:
    """A skeleton as JSON without nesting: its nodes in page order, each with its number of children."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append([*x[:5], len(x[5]), *x[6:8]])
        todo.extend(reversed(x[5]))
    return json.dumps(out, separators=(",", ":"))


def unpacked(text: str) -> list:
    rows = json.loads(text)
    done: list[list] = []
    for row in reversed(rows):
        n = row[5]
        row[5] = done[len(done) - n :][::-1]
        del done[len(done) - n :]
        done.append(row)
    return done[0]


def similar(a: list, b: list, known: dict) -> int:
    """Simple tree matching: the size of the largest mapping that keeps order and levels."""
    if a[0] != b[0]:
        return 0
    if a[6] == b[6]:
        return a[7]
    if not a[5] or not b[5]:
        return 1
    key = a[6], b[6]
    if key not in known:
        known[key] = 1 + int(table_rows(a[5], b[5], known, None)[-1])
    return known[key]


def table_rows(left: list, right: list, known: dict, steps: list | None) -> np.ndarray:
    """The last row of the dynamic programme over two lists of children; ``steps`` gets where each row grew."""
    kinds: dict[int, int] = {}
    kind = np.array([kinds.setdefault(y[6], len(kinds)) for y in right])
    one = {y[6]: y for y in right}
    gains: dict[int, np.ndarray] = {}
    row = np.zeros(len(right) + 1, np.int64)
    for x in left:
        if x[6] not in gains:
            gains[x[6]] = np.array([similar(x, one[k], known) for k in kinds])[kind]
        new = row.copy()
        new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gains[x[6]]))
        if steps is not None:
            steps.append((np.packbits(new == row), np.packbits(np.diff(new, prepend=-1) == 0)))
        row = new
    return row


def match(a: list, b: list, pairs: list, known: dict | None = None) -> int:
    """Simple tree matching of any size and depth; ``pairs`` gets the largest mapping."""
    known = {} if known is None else known
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 8 * min(a[7], b[7])))
    size = similar(a, b, known)
    todo = [(a, b)] if size else []
    while todo:
        x, y = todo.pop()
        if x[6] == y[6]:
            same_shape(x, y, pairs)
            continue
        pairs.append((x, y))
        left, right = x[5], y[5]
        if not left or not right:
            continue
        steps: list = []
        table_rows(left, right, known, steps)
        i, j, chosen = len(left), len(right), []
        while i and j:
            up, back = steps[i - 1]
            if up[j >> 3] >> (7 - (j & 7)) & 1:
                i -= 1
            elif back[j >> 3] >> (7 - (j & 7)) & 1:
                j -= 1
            else:
                chosen.append((left[i - 1], right[j - 1]))
                i, j = i - 1, j - 1
        todo.extend(reversed(chosen))
    return size


def same_shape(a: list, b: list, pairs: list) -> None:
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        todo.extend(zip(reversed(x[5]), reversed(y[5]), strict=True))


def paths(root: list) -> Iterator[tuple[list, int, int, int]]:
    """Each node with the hashes of its path and its parent's path, and its depth."""
    todo = [(root, hashed(root[0], 0), 0, 0)]
    while todo:
        node, own, parent, depth = todo.pop()
        yield node, own, parent, depth
        count: Counter = Counter()
        below = []
        for c in node[5]:
            below.append((c, hashed(own, c[0], count[c[0]]), own, depth + 1))
            count[c[0]] += 1
        todo.extend(reversed(below))


def group_counts(pages: pa.Table) -> pa.Table:
    """What the different pages of one group say about the nodes of its reference skeleton."""
    trees = [unpacked(x) for x in pages.column("skeleton").to_pylist()]
    common = Counter(t[6] for t in trees)
    wanted = min(common, key=lambda s: (-common[s], s))
    reference = next(t for t in trees if t[6] == wanted)
    aligned: dict[int, Counter] = {}
    chars: dict[tuple[int, int], int] = {}
    known: dict = {}
    for tree in trees:
        pairs: list = []
        match(reference, tree, pairs, known)
        for mine, other in pairs:
            aligned.setdefault(id(mine), Counter())[other[2]] += 1
            chars[id(mine), other[2]] = other[3]
    host = pages.column("host")[0].as_py()
    rows = [
        (host, path, parent, depth, node[1], digest, n, n * chars[id(node), digest], node[4])
        for node, path, parent, depth in paths(reference)
        for digest, n in aligned.get(id(node), {}).items()
    ]
    return table_of(rows)


def table_of(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 3, pa.bool_()]
    names = [f.split()[0] for f in STATS.split(", ")]
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def wrapper_of(nodes: list[dict]) -> dict | None:
    """The element that holds a host's slots, and the digests of the templates below it."""
    slots = {n["path"]: n["chars"] * (n["variants"] > 1) for n in nodes}
    total = max(slots.values(), default=0)
    if not total:
        return None
    by = {n["path"]: n for n in nodes}
    named = [n for tag in ("article", "main") for n in nodes if n["tag"] == tag and slots[n["path"]] > 0]
    if named:
        first = [n for n in named if n["tag"] == named[0]["tag"]]
        best = max(first, key=lambda n: (n["chars"], -n["depth"], n["path"]))
    else:
        holders = [n for n in nodes if n["tag"] in HOLDERS and slots[n["path"]] >= SLOT_SHARE * total]
        best = max(holders, key=lambda n: (n["depth"], n["chars"], n["path"]))
        while not best["title"] and (up := by.get(best["parent"])) and up["title"]:
            best = up
    inside, template = {best["path"]}, set()
    for n in sorted(nodes, key=lambda n: n["depth"]):
        if n["parent"] in inside:
            inside.add(n["path"])
            template.update(n["template"] or ())
    return {"path": best["path"], "tag": best["tag"], "template": sorted(template)}


def choose(stats: pa.Table) -> pa.Table:
    made = wrapper_of(stats.to_pylist())
    return pa.table({"host": stats.column("host")[:1], "wrapper": pa.array([json.dumps(made) if made else None], pa.string())})


def host_names(pages: DataFrame) -> DataFrame:
    """host, groups and names: the class and id words that recur over the host's different pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                html = html.as_py() or ""
                page = hashed(html)
                found = {w for m in NAMES.findall(html) for w in "".join(m).split() if not any(map(str.isdigit, w))}
                for word in ["", *(w.replace(".", "") for w in found)]:
                    held = seen.setdefault((host, word), [0, page, page])
                    held[:] = held[0] + 1, min(held[1], page), max(held[2], page)
            rows = [(*k, *v) for k, v in seen.items()]
            if rows:
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 3]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["host", "word", "n", "low", "high"])

    words = pages.select("host", "html").mapInArrow(run, "host string, word string, n long, low long, high long")
    words = words.groupBy("host", "word").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    words = written(words, "names")
    hosts = words.where("word = ''").select("host", F.col("n").alias("pages"))
    recurring = words.where("word <> '' and low <> high").join(hosts, "host").where(F.col("n") >= NAME_SHARE * F.col("pages"))
    lists = recurring.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("word")), " ").alias("names"))
    groups = F.ceil(F.col("pages") / GROUP_PAGES).alias("groups")
    return hosts.join(lists, "host", "left").select("host", groups, F.coalesce("names", F.lit("")).alias("names"))


def skeletons(pages: DataFrame) -> DataFrame:
    """host, groups, skeleton of every page with its host's names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[str]] = {}
        for batch in batches:
            texts = []
            for html, names in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if names not in known:
                    known[names] = frozenset(names.split())
                texts.append(packed(skeleton(relabel(parse(html.as_py() or ""), known[names]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["host", "groups", "skeleton"])

    return pages.select("host", "groups", "html", "names").mapInArrow(run, "host string, groups long, skeleton string")


def with_host(rows: DataFrame, hosts: DataFrame, how: str) -> DataFrame:
    """The rows joined with a table of one row per host, without gathering a host's rows in one task.

    A table whose measured size is below ``SHIPPED_BYTES`` goes to every task.  A larger one is
    repeated ``SALTS`` times, and a host's rows are dealt over its copies.
    """
    hosts = written(hosts, "hosts")
    held = [F.length(F.col(c).cast("string")) for c in hosts.columns]
    size = hosts.agg(F.sum(sum((F.coalesce(x, F.lit(0)) for x in held), F.lit(16)))).first()[0] or 0
    if size <= SHIPPED_BYTES:
        return rows.join(F.broadcast(hosts), "host", how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    copies = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["host", "salt"], how).drop("salt")


def induce(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """host and wrapper (null without a slot) of every host, from all its pages; copies of a page count once."""
    dealt = skeletons(with_host(pages, hosts, "inner")).distinct().withColumn(
        "group", F.pmod(F.xxhash64("skeleton"), F.col("groups"))
    )
    counts = (
        dealt.select("host", "group", "skeleton").groupBy("host", "group").applyInArrow(lambda t: group_counts(t), STATS)
    )
    texts = counts.groupBy("host", "path", "digest").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("tag").alias("tag"),
        F.sum("pages").alias("pages"),
        F.sum("chars").alias("chars"),
        F.max("title").alias("title"),
    )
    texts = written(texts, "nodes")
    nodes = texts.groupBy("host", "path").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("tag").alias("tag"),
        F.sum("pages").alias("total"),
        F.sum("chars").alias("chars"),
        F.count("*").alias("variants"),
        F.max("title").alias("title"),
    )
    shared = texts.where((F.col("pages") >= TEMPLATE_PAGES) & (F.col("chars") > 0)).select("host", "path", "digest", "pages")
    shared = shared.join(nodes.select("host", "path", "total"), ["host", "path"]).where(F.col("pages") >= TEMPLATE_SHARE * F.col("total"))
    lists = shared.groupBy("host", "path").agg(F.collect_list("digest").alias("template"))  # at most 1 / TEMPLATE_SHARE
    return nodes.join(lists, ["host", "path"], "left").groupBy("host").applyInArrow(choose, "host string, wrapper string")


def everywhere(root: Node, tags: tuple[str, ...]) -> list[Node]:
    """Elements of the first of ``tags`` that the page has, not below one another or what is set apart."""
    for tag in tags:
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.tag == tag:
                found.append(x)
            else:
                todo.extend(c for c in x.children if not c.aside)
        if found:
            return found
    return []


def longest(options: list[list[Node]]) -> list[Node]:
    return max(options, key=lambda found: sum(len(line) for n in found for line in blocks(n)), default=[])


def extract(html: str, wrapper: dict | None, names: frozenset[str] = frozenset()) -> str:
    root = parse(html)
    found: list[Node] = []
    if wrapper:
        tree = skeleton(relabel(root, names))
        found = next((node[8] for node, path, _, _ in paths(tree) if path == wrapper["path"]), [])
        if wrapper["tag"] in ("", "html", "body"):
            found = longest([[n] for n in everywhere(root, ("article", "main"))]) or found
        shared, top = set(wrapper["template"]), {id(n) for n in found}
        content = wrapper["tag"] in CONTENT
        gone, todo = [], [(tree, False, False)]
        while todo:
            node, inside, leads = todo.pop()
            if inside and node[2] in shared and not leads:
                gone.extend(node[8])
            else:
                inside = inside or any(id(n) in top for n in node[8])
                last = max((k for k, c in enumerate(node[5]) if c[3] and c[2] not in shared), default=-1)
                todo.extend((c, inside, content and (c[1] in TITLES or k < last)) for k, c in enumerate(node[5]))
        whole = [line for n in found for line in blocks(n)]
        for n in gone:
            n.aside = True
        lines = [line for n in found for line in blocks(n)] or whole
    else:
        lines = []
    if not lines:
        lines = [line for n in longest([[n] for n in everywhere(root, ("article", "main"))]) for line in blocks(n)] or blocks(root)
    return "\n".join(lines)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    hosts = written(host_names(pages), "hosts")
    wrappers = induce(pages, hosts).join(hosts.select("host", "names"), "host")
    joined = with_host(pages, wrappers, "left").select("page_id", "url", "html", "wrapper", "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        named: dict[str | None, frozenset[str]] = {None: frozenset()}
        for batch in batches:
            texts = []
            for html, wrapper, names in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if wrapper not in known:
                    known[wrapper] = json.loads(wrapper)
                if names not in named:
                    named[names] = frozenset(names.split())
                texts.append(extract(html.as_py() or "", known[wrapper], named[names]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
