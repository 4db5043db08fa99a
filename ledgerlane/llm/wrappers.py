"""Main text of web pages by inferred wrappers.

Pages of a host are aligned one after the other into a wrapper, a union-free regular expression over
elements: children that only some pages have become optional groups, runs of like children repeated groups, and
texts that differ between pages text slots.  The wrapper tells where a host keeps its articles and which texts
are its template.  It is a tree ``[key, pages, chars, link chars, text, children]``; ``text`` is the one text
all pages have there, or None for a slot; a child is ``[node, optional, repeated]``.
"""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .url_rules import host_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "xmp")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "del", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img")
CLOSES = {  # an element that starts ends these open ones
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "option": ("option",),
}
MAIN_TAGS = ("article", "main")
LEFT_OUT = ("head", "nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", *RAW)
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status")
NAMES = frozenset(  # parts of class and id names of what is no article text
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promos promotion sponsor sponsored sidebar rail nav navbar navigation menu "
    "breadcrumb breadcrumbs footer comment comments reply replies respond disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager copyright "
    "disclaimer skip paywall survey poll".split())
HEADER_NAMES = frozenset(("header", "masthead", "topbar"))
DEEPEST = 100  # levels; the text of deeper elements belongs to the one at this depth
TEMPLATE_PAGES = 3  # a text outside an article element that so many pages share is template


class Node:
    __slots__ = ("tag", "key", "out", "children", "parent")

    def __init__(self, tag, key, out, parent):
        self.tag, self.key, self.out, self.children, self.parent = tag, key, out, [], parent


def describe(tag: str, attributes: str, in_main: bool) -> tuple[str, bool]:
    """(key, whether the element holds no article text)."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}")
    names = [w for w in re.split(r"[^a-z]+", spaced.lower()) if w]
    hidden = "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden") == "true" or re.search(r"(^|\s)hidden(\s|$|=)", attributes)
    out = tag in LEFT_OUT or found.get("role", "").lower() in ROLES or bool(hidden) or not NAMES.isdisjoint(names)
    if not in_main and (tag == "header" or not HEADER_NAMES.isdisjoint(names)):
        out = True
    main = tag in MAIN_TAGS or found.get("role", "").lower() == "main"
    if main and not any(n.startswith("comment") for n in names):
        out = out and tag not in MAIN_TAGS
    return ("article" if main and not out else tag) + "".join(f".{n}" for n in sorted(set(names))), out


def parse(page: str) -> Node:
    """Block elements as a tree; a child is an element, (text, in a link), or None for a line break."""
    root = here = Node("", "", False, None)
    links = at = depth = 0
    too_deep: dict = {}  # open elements per tag that were not made into nodes
    while at <= len(page):
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            here.children.append((html.unescape(text), links > 0))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br" or too_deep.get(tag):
                here.children.append(None)
                too_deep[tag] = max(0, too_deep.get(tag, 0) - 1)
            elif tag not in INLINE or here.tag == tag:
                node, up = here, 1
                while node is not None and node.tag != tag:
                    node, up = node.parent, up + 1
                if node is not None and node.parent is not None:
                    here, links, depth = node.parent, 0, depth - up
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            here.children.append(None if tag in ("title",) else ("", False))
            continue
        if tag in ("br", "hr"):
            here.children.append(None)
            continue
        if tag in INLINE or tag in VOID:
            if tag == "a":
                links += 1
            key, out = describe(tag, m[3], True) if m[3].strip() and tag != "a" else ("", False)
            if tag in VOID or not out and here.tag != tag:
                continue
            # a marked inline element is kept as an element, so that it can be left out
        node = here
        closed = CLOSES.get(tag, ("p",))
        if node.tag in closed and tag not in INLINE:
            while node.tag in closed:
                node, depth = node.parent, depth - 1
            here = node
        if depth >= DEEPEST:
            here.children.append(None)
            too_deep[tag] = too_deep.get(tag, 0) + 1
            continue
        node, in_main = here, 0
        while node is not None:
            in_main += node.key.startswith("article")
            node = node.parent
        key, out = describe(tag, m[3], in_main > 0)
        child = Node(tag, key, out, here)
        here.children.append(child)
        here, links, depth = child, 0, depth + 1
    return root


def squeezed(text: str) -> str:
    return " ".join(text.split())


def shape(node: Node) -> list:
    """The wrapper of one element: like children already form repeated groups."""
    own = squeezed(" ".join(c[0] for c in node.children if isinstance(c, tuple)))
    links = sum(len(c[0]) for c in node.children if isinstance(c, tuple) and c[1])
    children: list = []
    for c in node.children:
        if isinstance(c, Node) and not c.out:
            children.append([shape(c), False, False])
    return [node.key, 1, len(own), links, own, folded(children, True)]


def folded(children: list, same_page: bool) -> list:
    """A child that comes again starts its group anew: like children become one repeated group, at the first one's place."""
    out, at = [], {}
    for c in children:
        i = at.setdefault(c[0][0], len(out))
        if i == len(out):
            out.append(c)
        else:
            out[i] = [joined(out[i][0], c[0], same_page), out[i][1] and c[1], True]
    return out


def joined(a: list, b: list, same_page: bool = False) -> list:
    """Alignment of two wrappers of like elements."""
    return [a[0], a[1] if same_page else a[1] + b[1], a[2] + b[2], a[3] + b[3], a[4] if a[4] == b[4] else None, aligned(a[5], b[5], same_page)]


def aligned(a: list, b: list, same_page: bool) -> list:
    """Children of two wrappers along their longest common subsequence; the rest become optional groups."""
    if [c[0][0] for c in a] == [c[0][0] for c in b]:
        return [[joined(x[0], y[0], same_page), x[1] or y[1], x[2] or y[2]] for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0][0] == b[j][0][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0][0] == b[j][0][0]:
            out.append([joined(a[i][0], b[j][0], same_page), a[i][1] or b[j][1], a[i][2] or b[j][2]])
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], True, a[i][2]])
            i += 1
        else:
            out.append([b[j][0], True, b[j][2]])
            j += 1
    return folded(out, same_page)


def mass(node: list, template: frozenset, path: str) -> int:
    """Characters of slot text outside links below a wrapper node."""
    own = 0 if path in template else max(0, node[2] - 2 * node[3])
    return own + sum(mass(c[0], template, f"{path}/{c[0][0]}") for c in node[5])


def decide(wrapper: list) -> dict:
    """What a wrapper says about a host: paths of the main elements, and of template texts."""
    template: set = set()
    mains: list = []

    def walk(node, path):
        if node[0].startswith("article"):
            mains.append(path)
            return
        if node[4] and node[1] >= TEMPLATE_PAGES and 2 * node[1] >= wrapper[1]:
            template.add(path)
        for c in node[5]:
            walk(c[0], f"{path}/{c[0][0]}")

    walk(wrapper, "")
    if mains:
        return {"main": mains, "template": []}
    if not mass(wrapper, frozenset(template), ""):
        template = set()
    left_out = frozenset(template)
    node, path = wrapper, ""
    while True:  # down while nothing but template texts and links lies beside one child
        own = path not in template and node[2] > 0
        full = [c for c in node[5] if texts_below(c[0], left_out, f"{path}/{c[0][0]}")]
        if own or len(full) != 1 or full[0][2]:
            return {"main": [path], "template": sorted(template)}
        node, path = full[0][0], f"{path}/{full[0][0][0]}"


def texts_below(node: list, template: frozenset, path: str) -> bool:
    """Whether a wrapper node holds text that is neither template nor links alone."""
    own = path not in template and node[2] > node[3]
    return own or any(texts_below(c[0], template, f"{path}/{c[0][0]}") for c in node[5])


def blocks_of(node: Node, path: str, template: frozenset, out: list) -> None:
    """Appends the blocks of an element in page order."""
    line: list = []

    def end():
        text = squeezed("".join(line))
        if text:
            out.append(text)
        line.clear()

    skip = path in template
    for c in node.children:
        if c is None:
            end()
        elif isinstance(c, tuple):
            if not skip:
                line.append(c[0])
        elif c.tag in INLINE:
            continue  # kept as an element only to be left out
        else:
            end()
            if not c.out:
                blocks_of(c, f"{path}/{c.key}", template, out)
    end()


def main_text(page: str, decision: dict | None) -> str:
    """The article text of a page by its host's decision, or by its own wrapper where that finds nothing."""
    root = parse(page)
    for d in ([decision] if decision else []) + [None]:
        d = d or decide(shape(root))
        mains, out = frozenset(d["main"]), []

        def walk(node, path):
            if path in mains:
                blocks_of(node, path, frozenset(d["template"]), out)
                return
            for c in node.children:
                if isinstance(c, Node) and not c.out:
                    walk(c, f"{path}/{c.key}")

        walk(root, "")
        if out:
            return "\n".join(out)
    return ""


SALTS = 32
HELD_HOSTS = 5000  # wrappers a task holds before it passes them on


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (as JSON) from columns host and html: aligned per task, then per host and salt, then per host.

    A host with a third of all pages costs each task one wrapper, and no task reads its pages alone.
    """
    def per_task(batches):
        import pyarrow as pa

        held: dict = {}

        def passed():
            hosts = sorted(held)
            made = [json.dumps(held[h]) for h in hosts]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(made, pa.string())], names=["host", "wrapper"])

        for batch in slices(batches, "html"):
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                made = shape(parse(page))
                held[host] = joined(held[host], made) if host in held else made
            if len(held) > HELD_HOSTS:
                yield passed()
        yield passed()

    def merged(table):
        import functools

        import pyarrow as pa

        made = functools.reduce(joined, map(json.loads, table.column("wrapper").to_pylist()))
        return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([json.dumps(made)], pa.string())})

    schema = "host string, wrapper string"
    partial = pages.select("host", "html").mapInArrow(per_task, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return partial.groupBy("host", "salt").applyInArrow(merged, schema).groupBy("host").applyInArrow(merged, schema)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (blocks joined by line ends, empty if none), n_chars of every row.

    Null pages are empty; pages without a host share one wrapper; a page its host's wrapper does not fit is read by
    its own; text without any element is article text.  Repeated rows and null ids are kept; other columns are ignored.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")) \
        .withColumn("host", host_of(F.col("url")))

    def decided(batches):
        import pyarrow as pa

        for batch in batches:
            made = [json.dumps(decide(json.loads(w))) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string())], names=["host", "decision"])

    # written: the planner then knows whether the decisions are small enough to be sent to the pages
    decisions = stored(infer_wrappers(pages).mapInArrow(decided, "host string, decision string"))

    def extracted(batches):
        import pyarrow as pa

        read: dict = {}
        for batch in slices(batches, "html"):
            made = []
            for page, d in zip(batch.column("html").to_pylist(), batch.column("decision").to_pylist()):
                if d not in read:
                    if len(read) > HELD_HOSTS:
                        read.clear()
                    read[d] = json.loads(d) if d else None
                made.append(main_text(page, read[d]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()),
                                              pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.join(decisions, "host", "left").select("page_id", "url", "html", "decision").mapInArrow(
        extracted, f"page_id {kind}, url string, text string, n_chars long")
