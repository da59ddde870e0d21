"""HTML main text by wrapper induction.

Up to ``SAMPLE`` different pages of each layout of a host, and as many of the whole host, are
aligned by simple tree matching to find the slot that varies most.
Trees are first compressed: neighbouring siblings of one kind are one repeated node,
so alignment costs do not grow with a page's length. Constants are counted over all
pages: a (path, text) pair on ``LEAST`` different pages or more, and on at least half of
those of its layout or host that have the path, is template.
Every page is then read whole: all nodes at the slot's path are its content, whatever
their tags or names say; template nodes go, found by counting all blocks, menus and footers too. Of what varies inside the slot
only controls, adverts, comments and parts made of links go (``is_foreign``): a heading in the article's own header,
an aside and a section stay whatever their name. Tags and names choose only on hosts
without a wrapper and on pages where the slot holds nothing.

Counts carry only hashes and combine before the shuffle; the sample has a
fixed number of pages per layout, however many the host has. Wrappers are broadcast only
under a counted bound, otherwise they are joined by host.

Edge cases: null and empty html give an empty text; a null url has the empty host; a
host with under ``LEAST`` different pages has no constants and is judged by roles;
tags and references cut off at the end are dropped or kept as the HTML rules say;
repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored, tune
from ledgerlight.llm.urlfilter import host_and_path

SAMPLE = 8
LEAST = 4
#: Path elements, from the root, that tell layouts apart.
LAYOUT_DEPTH = 7
#: Deeper elements hang on the last level; longer child lists are compressed by label.
DEPTH, MOST_RUNS = 150, 64
BROADCAST_HOSTS = 2000
#: Bounds a wrapper row: constants are 64-bit hashes, so hosts x constants x 8 bytes.
BROADCAST_CONSTANTS = 200_000

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
BOILERPLATE = frozenset("nav header footer aside form button select menu dialog head object canvas audio video input".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert sidebar side aside nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead footer comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup popup modal overlay widget login search toolbar pagination pager".split()
)
#: Of these tags and names what varies from page to page is still no article: controls, adverts and readers' comments.
NEVER_TAGS = BOILERPLATE - {"header", "aside"}
NEVER_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments commentlist disqus reply replies respond".split())
#: So many links and nothing else are a menu, whatever its name.
MENU_LINKS = 3
CONTENT_NAMES = frozenset("article content post entry story main body text".split())
CLOSES = {t: frozenset([t]) for t in ("li", "option", "tr")} | {t: frozenset(["td", "th"]) for t in ("td", "th")} | {t: frozenset(["dt", "dd"]) for t in ("dt", "dd")}
HEADING = re.compile("h[1-6]|p")
SCOPE = frozenset("ul ol table dl select body html div article section nav aside header footer main td th blockquote form figure".split())


class Node:
    __slots__ = ("kids", "label", "mass", "tag", "words")

    def __init__(self, tag: str, label: str, words: frozenset[str]) -> None:
        self.tag, self.label, self.words, self.kids = tag, label, words, []
        self.mass: tuple[int, int, int] | None = None


def _open(name: str, attrs: str) -> Node:
    got = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)} if attrs and "=" in attrs else {}
    cls = got.get("class", "")
    words = frozenset(w for w in re.split(r"[^a-z]+", f"{cls} {got.get('id', '')}".lower()) if w) if got else frozenset()
    if got.get("role"):
        words |= {"role=" + got["role"].strip().lower()}
    return Node(name, f"{name}.{cls}" if cls else name, words)


def parse(html: str) -> Node:
    """A forgiving parser: every piece of text ends up in the tree once."""
    root = Node("#root", "#root", frozenset())
    stack, pos, n = [root], 0, len(html)
    low = None
    while pos < n:
        m = TAG.search(html, pos)
        at = m.start() if m else n
        if at > pos:
            stack[-1].kids.append(html[pos:at])
        if m is None:
            break
        pos = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if name in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["attrs2"] or ""
        node = _open(name, attrs)
        if name not in INLINE and name not in RAW:  # a block closes an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if name in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[name]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        stack[-1].kids.append(node)
        if name in VOID or attrs.endswith("/"):
            continue
        if name in RAW:  # its content is no markup
            low = html.lower() if low is None else low
            low = low if len(low) == n else html
            end = low.find("</" + name, pos)
            pos = n if end < 0 else end
            if end >= 0:
                close = html.find(">", end)
                pos = n if close < 0 else close + 1
            continue
        if len(stack) < DEPTH:
            stack.append(node)
    return root


def is_boilerplate(x: Node) -> bool:
    if x.tag in BOILERPLATE or x.words & NAMES:
        return x.tag not in ("html", "body", "article", "main")
    return any(w.startswith("role=") and w[5:] in ROLES for w in x.words)


def mass(x: Node) -> tuple[int, int, int]:
    """(characters of text, those of them in links, links) at and below a node; counted once a node."""
    if x.mass is None:
        chars = linked = links = 0
        for k in x.kids:
            if isinstance(k, str):
                chars += sum(map(len, k.split()))
            elif k.tag not in RAW:
                a, b, c = mass(k)
                chars, linked, links = chars + a, linked + b, links + c
        x.mass = (chars, chars, 1) if x.tag == "a" else (chars, linked, links)
    return x.mass


def is_menu(x: Node) -> bool:
    """Links and nothing else, three or more."""
    chars, linked, links = mass(x)
    return links >= MENU_LINKS and linked == chars


def is_foreign(x: Node) -> bool:
    """Whether a part of the varying slot is no article.

    Its constancy is looked at elsewhere; this is about parts that vary. Controls, adverts and comments go; what is
    named like a header, sidebar or notice goes only if links are half of it or more, so that an article's own header, aside or
    section stays; and links alone, three or more, are a menu under any name.
    """
    if x.tag in ("html", "body", "article", "main"):
        return any(w.startswith("role=") and w[5:] in ROLES for w in x.words)
    if x.tag in NEVER_TAGS or x.words & NEVER_NAMES or any(w.startswith("role=") and w[5:] in ROLES for w in x.words):
        return True
    if x.tag in BOILERPLATE or x.words & NAMES:
        chars, linked, _ = mass(x)
        return 2 * linked >= chars
    return x.tag not in INLINE and is_menu(x)


def _none(_: Node) -> bool:
    return False


def squeeze(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((unescape(text) if "&" in text else text).split())


def blocks(x: Node, path: str, out: list[tuple[str, str]], drop: Callable[[Node], bool] = is_boilerplate) -> None:
    """(path, text) of every block below ``x`` in page order, without the parts to ``drop``."""
    here = f"{path}/{x.label}"
    flow: list[str] = []

    def flush() -> None:
        if flow:
            text = squeeze(flow)
            flow.clear()
            if text:
                out.append((here, text))

    def visit(y: Node) -> None:
        for k in y.kids:
            if isinstance(k, str):
                flow.append(k)
            elif k.tag == "br" or k.tag == "wbr":
                flow.append("\n" if k.tag == "br" else "")
            elif k.tag in RAW or drop(k):
                if k.tag not in INLINE and k.tag not in RAW:
                    flush()
            elif k.tag in INLINE:
                if any(not isinstance(z, str) and z.tag not in INLINE for z in k.kids):
                    flush()
                    blocks(k, here, out, drop)
                else:
                    visit(k)
            else:
                flush()
                blocks(k, here, out, drop)

    visit(x)
    flush()


class Slot:
    """A compressed node: siblings of one label, with their own texts and merged children."""

    __slots__ = ("kids", "label", "texts")

    def __init__(self, label: str) -> None:
        self.label, self.texts, self.kids = label, set(), []


def compress(nodes: list[Node], label: str) -> Slot:
    out = Slot(label)
    runs: list[tuple[str, list[Node]]] = []
    for x in nodes:
        flow: list[str] = []
        stack = [x]
        direct: list[Node] = []
        while stack:  # inline elements belong to their block
            y = stack.pop()
            for k in y.kids:
                if isinstance(k, str):
                    flow.append(k)
                elif k.tag in RAW:
                    pass
                elif k.tag in INLINE:
                    stack.append(k)
                else:
                    direct.append(k)
        text = squeeze(flow)
        if text:
            out.texts.add(text)
        for k in direct:
            if not runs or runs[-1][0] != k.label:
                runs.append((k.label, []))
            runs[-1][1].append(k)
    merged: list[tuple[str, list[Node]]] = []
    if len(nodes) > 1 or len(runs) > MOST_RUNS:  # the children of repeated nodes share slots by label
        by: dict[str, list[Node]] = {}
        for lab, xs in runs:
            by.setdefault(lab, []).extend(xs)
        merged = list(by.items())
    else:
        merged = runs
    out.kids = [compress(xs, lab) for lab, xs in merged]
    return out


def tree_match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: size of the largest order-preserving match, and its pairs."""
    if a.label != b.label:
        return 0, []
    m, n = len(a.kids), len(b.kids)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    pairs: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            w = pairs[i, j] = tree_match(a.kids[i - 1], b.kids[j - 1])
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w[0])
    out = [(a, b)]
    i, j = m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            out += pairs[i, j][1]
            i, j = i - 1, j - 1
    return best[m][n] + 1, out


def key(path: str, text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{path}\0{text}") - (1 << 63)


def induce(pages: list[str]) -> tuple[list[int], str]:
    """(hashes of constant (path, text) pairs, path of the main varying slot)."""
    pages = sorted(set(pages), key=lambda h: (len(h), h))
    if len(pages) < LEAST:
        return [], ""
    trees = [compress([parse(h)], "#root") for h in pages]
    ref = trees[len(trees) // 2]
    constant: dict[int, set[str]] = {}
    varying: dict[int, int] = {}
    order: list[tuple[Slot, str]] = []

    def walk(s: Slot, path: str) -> None:
        here = f"{path}/{s.label}"
        order.append((s, here))
        constant[id(s)] = set(s.texts)
        for k in s.kids:
            walk(k, here)

    walk(ref, "")
    for t in trees:
        if t is ref:
            continue
        matched = {id(x): y for x, y in tree_match(ref, t)[1]}
        for s, _ in order:
            y = matched.get(id(s))
            if y is None:
                # An optional node: nothing in it is proven constant.
                constant[id(s)] = set()
            else:
                constant[id(s)] &= y.texts
                varying[id(s)] = varying.get(id(s), 0) + sum(len(x) for x in y.texts - s.texts)
    keys = sorted({key(p, x) for s, p in order for x in constant[id(s)]})
    mass: dict[str, int] = {}
    for s, p in order:
        mass[p] = mass.get(p, 0) + varying.get(id(s), 0)
    parent: dict[str, int] = {}
    for p, v in mass.items():
        parent[p.rsplit("/", 1)[0]] = parent.get(p.rsplit("/", 1)[0], 0) + v
    slot = max(parent, key=lambda p: (parent[p], p)) if parent and max(parent.values()) else ""
    # A varying heading or paragraph beside the slot, such as the title over sections, belongs to it.
    up = slot.rsplit("/", 1)[0]
    while up.rsplit("/", 1)[-1].split(".", 1)[0] not in ("", "#root", "html", "body"):
        if any(v and p.rsplit("/", 1)[0] == up and HEADING.fullmatch(p.rsplit("/", 1)[1].split(".", 1)[0]) for p, v in mass.items()):
            slot = up
        up = up.rsplit("/", 1)[0]
    return keys, slot


def _find(x: Node, hit, out: list[tuple[Node, str]], path: str = "", roles: bool = True) -> None:
    for k in x.kids:
        if isinstance(k, str) or roles and is_boilerplate(k):
            continue
        here = f"{path}/{x.label}"
        if hit(k, f"{here}/{k.label}"):
            out.append((k, here))
        else:
            _find(k, hit, out, here, roles)


def main_text(html: str, constants: frozenset[int] = frozenset(), slot: str = "") -> str:
    """The article: blocks joined by an empty line."""
    if not html:
        return ""
    return content(parse(html), constants, slot)


def content(root: Node, constants: frozenset[int] = frozenset(), slot: str = "") -> str:
    """The varying slot's blocks without constants; tags and roles choose only where no slot has any."""

    def taken(hit, induced: bool = False) -> list[str]:
        roots: list[tuple[Node, str]] = []
        _find(root, hit, roots, roles=not induced)
        got: list[tuple[str, str]] = []
        for node, path in roots:
            if not (induced and is_menu(node)):
                blocks(node, path, got, is_foreign if induced else is_boilerplate)
        return [t for p, t in got if not constants or key(p, t) not in constants]

    if slot:
        best = taken(lambda k, p: p == slot, induced=True)
        if best:
            return "\n\n".join(best)
    for hit in (
        lambda k, p: k.tag == "article",
        lambda k, p: k.tag == "main" or "role=main" in k.words,
        lambda k, p: k.tag in ("div", "section", "td") and bool(k.words & CONTENT_NAMES),
    ):
        best = taken(hit)
        if best:
            return "\n\n".join(best)
    got: list[tuple[str, str]] = []
    blocks(root, "", got)
    return "\n\n".join(t for p, t in got if not constants or key(p, t) not in constants)


def layout_of(root: Node) -> tuple[int, list[tuple[str, str]]]:
    """A page's layout, a hash of the upper paths that hold its blocks, and all its blocks."""
    got: list[tuple[str, str]] = []
    blocks(root, "", got, _none)
    return key("\n".join(sorted({"/".join(p.split("/")[:-1][:LAYOUT_DEPTH]) for p, _ in got})), ""), got


def shape(root: Node) -> tuple[int, dict[int, int]]:
    """A page's layout, and key -> path of all blocks."""
    layout, got = layout_of(root)
    # Menus and footers count too; blocks with inline parts left out also as a text is cut.
    blocks(root, "", got)
    blocks(root, "", got, is_foreign)
    return layout, {key(p, t): key(p, "") for p, t in set(got)}


def page_blocks(pages: DataFrame) -> DataFrame:
    """host, fp, layout, paths, keys: hashes of all blocks of each different page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for b in batches:
            got = [shape(parse(html)) for html in b.column(2).to_pylist()]
            columns = [pa.array([x for x, _ in got], pa.int64()), pa.array([list(y.values()) for _, y in got], longs), pa.array([list(y) for _, y in got], longs)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["host", "fp", "layout", "paths", "keys"])

    keyed = pages.where("html IS NOT NULL").select(host_and_path(F.col("url"))[0].alias("host"), F.xxhash64("html").alias("fp"), "html")
    each = keyed.mapInArrow(run, "host string, fp long, layout long, paths array<long>, keys array<long>")
    one = each.groupBy("host", "fp").agg(F.first(F.struct("layout", "paths", "keys")).alias("x"))
    # Every page counts in its layout and, as layout 0, in its host.
    return stored(one.select("host", "fp", F.array("x.layout", F.lit(0).cast("bigint")).alias("layouts"), "x.paths", "x.keys"), "blocks")


def constant_texts(parts: DataFrame) -> DataFrame:
    """host, constants: texts on ``LEAST`` different pages or more, and on half of the pages with their path."""
    each = parts.withColumn("layout", F.explode("layouts"))
    have = each.select("host", "layout", F.explode(F.array_distinct("paths")).alias("path")).groupBy("host", "layout", "path").agg(F.count("*").alias("n_pages"))
    texts = each.select("host", "layout", F.explode(F.arrays_zip("paths", "keys")).alias("x")).select("host", "layout", F.col("x.paths").alias("path"), F.col("x.keys").alias("key"))
    often = texts.groupBy("host", "layout", "path", "key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    return often.join(have, ["host", "layout", "path"]).where("2 * n >= n_pages").groupBy("host").agg(F.collect_set("key").alias("constants"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, constants, layouts, slots: one wrapper per host; slots go with layouts, 0 is any other."""
    parts = page_blocks(pages)
    rank = F.row_number().over(W.partitionBy("host", "layout").orderBy("fp"))
    ranked = parts.select("host", "fp", F.explode("layouts").alias("layout")).withColumn("rank", rank).where(F.col("rank") <= SAMPLE)
    picked = stored(ranked.groupBy("host", "fp").agg(F.collect_list("layout").alias("layouts")), "sampled")
    side = F.broadcast(picked) if picked.count() <= BROADCAST_HOSTS * SAMPLE else picked
    keyed = pages.where("html IS NOT NULL").select(host_and_path(F.col("url"))[0].alias("host"), F.xxhash64("html").alias("fp"), "html")
    sample = keyed.join(side, ["host", "fp"]).dropDuplicates(["host", "fp"]).select("host", "html", F.explode("layouts").alias("layout"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        slot = induce(pdf["html"].tolist())[1]
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "layout": [pdf["layout"].iloc[0]], "slot": [slot]})

    slots = sample.groupBy("host", "layout").applyInPandas(learn, "host string, layout long, slot string").where("slot != ''")
    by_host = slots.groupBy("host").agg(F.collect_list(F.struct("layout", "slot")).alias("x")).select("host", F.col("x.layout").alias("layouts"), F.col("x.slot").alias("slots"))
    return stored(by_host.join(constant_texts(parts), "host", "full").select("host", "constants", "layouts", "slots"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    tune(pages.sparkSession)
    w = wrappers(pages)
    held = F.coalesce(F.size("constants"), F.lit(0)) + F.coalesce(F.size("slots"), F.lit(0))
    size = w.agg(F.count("*").alias("n"), F.coalesce(F.sum(held), F.lit(0)).alias("c")).first()
    small = size.n <= BROADCAST_HOSTS and size.c <= BROADCAST_CONSTANTS
    rows = pages.select("page_id", "url", "html", host_and_path(F.col("url"))[0].alias("host")).join(F.broadcast(w) if small else w, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, memo = [], {}
            for html, host, constants, layouts, slots in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), b.column(6), strict=True):
                if host not in memo:
                    memo[host] = frozenset(constants.as_py() or ()), dict(zip(layouts.as_py() or (), slots.as_py() or (), strict=True))
                if not html:
                    texts.append("")
                    continue
                fixed, slot = memo[host]
                root = parse(html)
                texts.append(content(root, fixed, slot.get(layout_of(root)[0]) or slot.get(0, "") if slot else ""))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host", "constants", "layouts", "slots").mapInArrow(run, "page_id long, url string, text string, n_chars long")
