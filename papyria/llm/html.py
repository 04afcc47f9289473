"""Main text of web pages by site template removal.

A page is parsed once. Its text is a list of blocks, and every element that holds whole blocks has a hash of its subtree:
its tag, class, id and role, its texts, and the hashes of the elements in it. Spark counts on how many different pages
of a host each hash occurs; subtrees that recur are templates, and their blocks are deleted:

- a container (<div>, <section>, ...), or any element of a page that marks no article, on `min_pages` pages or more,
  however large the host is;
- a paragraph, heading, list, table or the like inside an article, where a passage may well stand on several pages, if it
  is also on `share_pct` percent or more of its host's pages, as a notice to all readers is.

Pages of a host with the same text are one page in these counts, so copies of a page under many addresses do not
make a template of it. Markup says what counting can't, on a host of few pages or one page: the article is taken
from <article>, else from <main>, else from the body, without menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, scripts and styles. White space inside a block becomes one blank.

Counting shuffles 24 bytes for each subtree and page, then one row for each template and task, so a host of a third of all
pages does not meet in one task. Templates are few (each takes `min_pages` pages at least); up to `broadcast_most` of
them are broadcast as 64-bit numbers, and more are joined to the pages that have them.

Defined results: null or empty html gives ''; markup cut off at the end ends there, and an unfinished tag is dropped;
elements nested deeper than `DEEPEST` are taken as siblings, so a page of 100,000 open tags takes time in proportion; a very
long text is read whole; null urls, and urls without a host, are one host; repeated rows are separate pages of the
result; an empty table gives no rows; only page_id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, stored

#: The last alternative is a tag with an unpaired quote: it ends at the next `>`.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>|\Z)|([^>]*)(>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in "script style textarea title noscript iframe xmp noembed noframes template svg".split()}
NEVER = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg head nav aside form footer button select option dialog menu object canvas audio video map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt tr thead tbody tfoot table ul ol dl blockquote pre figure figcaption summary caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("html body td th li dd dt tr thead tbody tfoot caption summary figcaption".split())
#: An open tag ends an open element of these names, up to the nearest of the second set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id that mark what is no part of an article.
MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertisements advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars aside rail menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar footer comments comment disqus respond replies reply discussion responses social share sharing sharebar related recommended recommendations trending pagination pager skip login search widget widgets".split()
)
HEADERS = frozenset("header masthead".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)|^([^/?#:\s]+\.[^/?#:\s]+)")


#: Browsers stop nesting at about the same depth.
DEEPEST = 500


class Node:
    __slots__ = ("tag", "marks", "kids", "parent", "gone", "depth", "headed")

    def __init__(self, tag: str, marks: str, parent: Node | None):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.kids: list[Node | str] = []
        self.gone = self.headed = False  # headed: a heading stands in it
        self.depth = parent.depth + 1 if parent else 0


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return (m and (m[1] or m[2]) or "").lower().rstrip(".")


def _unwanted(tag: str, attributes: str) -> tuple[str, bool]:
    """What distinguishes the element (class, id, role), and whether its markup marks it as no part of an article."""
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = " ".join(found.get(k, "") for k in ("class", "id")).lower()
    role = found.get("role", "").strip().lower()
    gone = role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if not gone and names and tag not in ("html", "body", "main", "article") or names and tag == "article":
        words = set(_SPLIT.split(names))
        gone = gone or bool(words & MARKS) or (bool(words & HEADERS) and tag in ("div", "section", "header"))
    return f"{names}|{role}", gone


def parse(page: str) -> Node:
    """A forgiving tree: void and raw-text elements, implied end tags, everything open ends with the page."""
    root = node = Node("html", "", None)
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        # a `<` that begins no tag is text; an unfinished tag at the end is markup
        if m is None:
            node.kids.append(page[at:])
            break
        if m.start() > at:
            node.kids.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                node.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        attributes = m[3] if m[4] is not None else m[5]
        if not (m[4] or m[6]):
            break
        tag = tag.lower()
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            elif tag == "p":
                node.kids.append(Node("p", "", node))
            continue
        if node.depth >= DEEPEST:
            node = node.parent
        if tag in ("html", "body") and node is root:
            if tag == "html":
                continue
        if tag in CLOSES_P:
            up = node
            while up is not root and up.tag not in ("p", "td", "th", "li", "button", "div", "article", "section"):
                up = up.parent
            if up.tag == "p" and up is not root:
                node = up.parent
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            up, last = node, None
            while up is not root and up.tag not in until:
                if up.tag in ends:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        marks, gone = _unwanted(tag, attributes) if attributes and not attributes.isspace() else ("", False)
        new = Node(tag, marks, node)
        new.gone = gone or tag in NEVER
        node.kids.append(new)
        if tag in HEADING:
            up = node
            while up is not None and not up.headed:
                up.headed, up = True, up.parent
        if tag in RAW and not attributes.endswith("/"):
            end = RAW[tag].search(page, at)
            new.kids.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK):
            node = new
    return root


def _walk(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [k for k in x.kids if type(k) is not str]
    return out


def main_roots(root: Node, nodes: list[Node]) -> list[Node]:
    """The outermost articles that are not marked as unwanted, else main elements, else the whole page."""

    def outer(test) -> list[Node]:
        out, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.gone:
                continue
            if test(x):
                out.append(x)
            else:
                todo += [k for k in reversed(x.kids) if type(k) is not str]
        return out

    return outer(lambda x: x.tag == "article") or outer(lambda x: x.tag == "main" or x.marks.endswith("|main")) or [root]


def article_roots(page: str) -> list[Node]:
    """The parsed page's main roots; what is in them and marked as no part of an article is gone."""
    root = parse(page)
    nodes = _walk(root)
    for x in nodes:  # the head line of an article may stand in a <header>
        if x.tag == "header":
            up = x.parent
            while up is not None and up.tag not in ("article", "main"):
                up = up.parent
            x.gone = x.gone or up is None or not x.headed
    roots = main_roots(root, nodes)
    if roots == [root]:  # an article whose wrapper is named after a sidebar or the like is still the article
        for x in nodes:
            if x.tag in ("article", "main") and not x.gone:
                while x is not None:
                    x.gone, x = x.gone and x.tag not in ("div", "section", "main"), x.parent
        roots = main_roots(root, nodes)
    return roots


def text_blocks(roots: list[Node]) -> tuple[list[str], list[tuple[int, int, int, bool]]]:
    """The blocks of text in page order, and the subtrees that may be templates: hash, first block, block after the last,
    and whether it is a text block inside an article. Hashes are made from the inside out, without recursion."""
    blocks: list[str] = []
    found: list[tuple[int, int, int, bool]] = []
    for r in roots:
        parts: list[str] = []
        around: list[tuple[Node, int, list[str]]] = []  # open block elements, with their first block and what they hold
        todo: list[Node | str | None] = [r]

        def close() -> None:
            if parts:
                if t := _SPACE.sub(" ", entities.unescape("".join(parts))).strip():
                    blocks.append(t)
                    if around:
                        around[-1][2].append(t)
                parts.clear()

        while todo:
            x = todo.pop()
            if type(x) is str:
                parts.append(x)
            elif x is None:
                close()
                node, first, held = around.pop()
                if len(blocks) > first:
                    h = xxhash.xxh64_intdigest("\1".join((node.tag, node.marks, *held)))
                    if around:
                        around[-1][2].append(f"\0{h:x}")
                    if node is not r and node.tag not in ("html", "head", "body"):
                        found.append((h, first, len(blocks), r.parent is not None and node.tag in TEXTUAL))
            elif not x.gone:
                if x.tag in BLOCK:
                    close()
                    around.append((x, len(blocks), []))
                    todo.append(None)
                elif x.tag == "br":
                    parts.append(" ")
                todo += reversed(x.kids)
        close()
    return blocks, found


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, url, host and page (64-bit names of the host and of the page's text), blocks, and of each subtree: keys (of
    host and subtree), firsts, lasts (negative for a text block inside an article)."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.int64()), ("page", pa.int64()), ("blocks", pa.list_(pa.string())), ("keys", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 4 << 20)):
            rows = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                host = xxhash.xxh64_intdigest(host_of(url))
                blocks, found = text_blocks(article_roots(page)) if page else ([], [])
                keys = [_signed(xxhash.xxh64_intdigest(h.to_bytes(8, "little"), host)) for h, _, _, _ in found]
                rows.append((_signed(host), _signed(xxhash.xxh64_intdigest("\n".join(blocks))), blocks, keys, [f[1] for f in found], [-f[2] if f[3] else f[2] for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds.types[2:]))], schema=kinds)

    plain = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return map_arrow(plain, scan, "page_id long, url string, host long, page long, blocks array<string>, keys array<long>, firsts array<int>, lasts array<int>")


def site_templates(rows: DataFrame, min_pages: int, share_pct: int) -> DataFrame:
    """key, wide: subtrees on min_pages different pages of their host or more; wide: on share_pct percent of them or more."""
    seen = rows.select("host", "page", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    counts = seen.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    total = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    # one row for each host with a template meets that host's templates; both sides are small next to the pages
    return counts.join(total, "host").select("key", (F.col("n") * 100 >= F.col("total") * share_pct).alias("wide"))


def without(blocks: list[str], keys: list[int], firsts: list[int], lasts: list[int], templates: dict[int, bool]) -> str:
    """The blocks that no template covers, one on each line."""
    for key, first, last in zip(keys, firsts, lasts):
        if key in templates and (last > 0 or templates[key]):
            blocks[first : abs(last)] = [""] * (abs(last) - first)
    return "\n".join(filter(None, blocks))


def extract_text(pages: DataFrame, min_pages: int = 5, share_pct: int = 50, broadcast_most: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    # a row's number is written with it, so it stays the same whichever task reads it again
    rows = stored(page_rows(pages).withColumn("row", F.monotonically_increasing_id()), "page-rows")
    templates = stored(site_templates(rows, min_pages, share_pct), "site-templates")
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    schema, columns = "page_id long, url string, text string, n_chars long", ["page_id", "url", "blocks", "keys", "firsts", "lasts"]

    def output(batch: pa.RecordBatch, sets) -> pa.RecordBatch:
        texts = [without(*row, known) for *row, known in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), sets)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=kinds)

    if templates.count() <= broadcast_most:
        found = templates.toPandas()
        known = pages.sparkSession.sparkContext.broadcast((found["key"].to_numpy(np.int64), found["wide"].to_numpy(bool)))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wide = dict(zip(*(x.tolist() for x in known.value)))
            for batch in (s for b in batches for s in slices(b)):
                yield output(batch, [wide] * batch.num_rows)

        return map_arrow(rows.select(*columns), clean, schema)

    held = rows.select("row", F.explode(F.array_distinct("keys")).alias("key")).join(templates.hint("merge"), "key")
    mine = held.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "wide"))).alias("found"))
    joined = rows.join(mine, "row", "left").select(*columns, "found")

    def clean_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            yield output(batch, [dict(f or ()) for f in batch.column(6).to_pylist()])

    return map_arrow(joined, clean_joined, schema)


def extract(page: str, host: str = "", templates: dict[int, bool] | None = None) -> str:
    """The text of one page whose host has these templates (keys of host and subtree)."""
    blocks, found = text_blocks(article_roots(page))
    seed = xxhash.xxh64_intdigest(host)
    keys = [_signed(xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)) for h, _, _, _ in found]
    return without(blocks, keys, [f[1] for f in found], [-f[2] if f[3] else f[2] for f in found], templates or {})
