"""HTML extraction with a site style tree.

1. Every page is read into a light tree.  Its containers (block elements that
   hold other elements) are named by their path of tag and class from the body;
   for each the page reports a hash of its presentation (sequence of child
   elements) and of its content (text).
2. Pages of one host are merged: per host and path the number m of distinct
   pages, the entropy of presentations and the entropy of contents, both to
   base m.  The importance of a leaf is its content entropy; that of an inner
   node is (1 - g^l) * presentation entropy + g^l * mean importance of its l
   children (g = 0.9), computed level by level.  Identical pages count once, so
   copies of a page do not make its text look like a template.  A
   container is named by the hash of its path, however deep it is.  A branch on
   fewer than ``min_pages`` pages cannot be template and is judged as a leaf,
   so there are as many levels as so many pages of one host share.
3. A branch with importance under ``threshold`` on at least ``min_pages``
   distinct pages is template and goes, on every page of the host.
4. What is left is reduced to the main text: the ``article`` (else ``main``,
   else the body) without elements whose meaning is not text (menus, headers,
   footers, sidebars, notices, adverts, forms, scripts, styles, reader
   comments, by tag, role or class word).  An article itself, and paragraphs,
   headings and list items, are never judged by importance.

Blocks are in page order, character references decoded, white space inside a
block one space, joined by two newlines.

Defined cases: null and empty pages give an empty text; null urls share the
host ''; unclosed and stray tags are repaired as browsers do; a tag cut off at
the end of the page is dropped.  Repeated rows give repeated results; extra
columns are not read.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import table

GAMMA = 0.9

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
                   "pre search section summary table tbody tfoot thead tr ul".split())
CONTAINERS = frozenset("aside blockquote center dl details div fieldset figure footer form header main menu nav ol "
                       "section table ul".split())
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe object embed applet button select "
                       "textarea input label menu dialog svg math canvas audio video map head title noembed noframes "
                       "datalist search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
# Class and id words of parts that are not main text.
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment "
                        "comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav "
                        "navbar navigation newsletter notice notices pager pagination popup promo promotion related "
                        "replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar "
                        "topbar widget".split())
# Elements whose end tag may be missing: what closes them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
          "thead": ({"thead", "tbody", "tfoot", "tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
          "tfoot": ({"thead", "tbody", "tfoot", "tr"}, {"table"})}
P_SCOPE = frozenset("article aside blockquote body button caption div footer header html li main nav object section td "
                    "th table form".split())

# Nothing here steps back, and a lone quote is an ordinary character: where a ">" follows, a tag ends.
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[A-Za-z0-9]+")
_LONE = re.compile(r"<[a-zA-Z/!?]")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []


def read(page: str | None) -> Node:
    """The tree of a page: items of a node are strings and nodes in order."""
    root = Node("html", {}, None)
    cur, at, page = root, 0, page or ""
    edge = page.rfind(">") + 1  # whatever opens after it is cut off
    while True:
        m = _MARK.search(page, at, edge)
        if m is None:
            lone = _LONE.search(page, max(at, edge))
            tail = page[at:lone.start()] if lone else page[at:]
            if tail:
                cur.items.append(entities.unescape(tail))
            return root
        if m.start() > at:
            cur.items.append(entities.unescape(page[at:m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                return root  # a comment without an end takes the rest
            continue
        tag = m[2].lower()
        if m[1]:
            up = cur
            while up is not None and up.tag != tag:
                if up.tag == "article" and tag not in ("body", "html", "main"):
                    up = None  # a stray end tag does not close the article
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                cur = up.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS:  # an open paragraph ends where a block begins
            up = cur
            while up.parent is not None and up.tag != "p" and up.tag not in P_SCOPE:
                up = up.parent
            if up.tag == "p":
                cur = up.parent
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            up, last = cur, None
            while up.parent is not None and up.tag not in stop:
                if up.tag in ends:
                    last = up
                up = up.parent
            if last is not None:
                cur = last.parent
        attrs = {a.lower(): b or c or d or "" for a, b, c, d in _ATTR.findall(m[3])} if m[3].strip("/ \n\t") else {}
        node = Node(tag, attrs, cur)
        cur.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCKS and tag not in VOID:
            cur = node


def _noise(node: Node, in_article: bool) -> bool:
    if node.tag in NOISE_TAGS:
        return True
    if node.tag == "header":
        return not in_article
    if node.attrs:
        if node.attrs.get("role", "").lower() in NOISE_ROLES:
            return True
        if node.tag not in ("article", "main", "html") and any(
                w in NOISE_WORDS for w in _WORD.findall((node.attrs.get("class", "") + " " + node.attrs.get("id", "")).lower())):
            return True
    return False


def _name(node: Node) -> str:
    words = re.sub(r"\d+", "0", node.attrs.get("class", "").strip().lower())
    return f"{node.tag}.{'.'.join(sorted(words.split()))}" if words else node.tag


ROOT = 0


def _below(path: int, node: Node) -> int:
    """Path of a container under the container at ``path``."""
    import xxhash

    h = xxhash.xxh64_intdigest(f"{path}>{_name(node)}".encode("utf-8", "replace"))
    return h - ((h >> 63) << 64)


def walk(root: Node):
    """(node, True) before and (node, False) after its items, and (text, None);
    without recursion."""
    stack = [(root, iter(root.items))]
    yield root, True
    while stack:
        node, items = stack[-1]
        x = next(items, None)
        if x is None:
            stack.pop()
            yield node, False
        elif isinstance(x, str):
            yield x, None
        else:
            yield x, True
            stack.append((x, iter(x.items)))


def outline(page: str | None) -> list[tuple[int, int, int, str, str]]:
    """(path, path of the container above, level, presentation, content) of the
    containers of a page.

    Script and style texts are never read into the tree.
    """
    import xxhash

    rows, open_ = [], []  # open containers: [path, presentation, content hash, node, height]
    for x, begin in walk(read(page)):
        if begin is None:
            if open_:
                words = " ".join(x.split())
                if words:
                    open_[-1][2].update((words + "\n").encode("utf-8", "replace"))
        elif begin:
            if open_:
                open_[-1][1].append(_name(x))
            if x.tag in CONTAINERS or x.tag == "article":
                open_.append([_below(open_[-1][0] if open_ else ROOT, x), [], xxhash.xxh64(), x])
        elif open_ and open_[-1][3] is x:
            path, style, content, _ = open_.pop()
            if open_:
                open_[-1][2].update(content.digest())
            if x.tag in CONTAINERS:
                rows.append((path, open_[-1][0] if open_ else ROOT, len(open_), xxhash.xxh64_hexdigest(" ".join(style).encode("utf-8", "replace")),
                             content.hexdigest()))
    return rows


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Main text of a page without the branches at the ``template`` paths."""
    root = read(page)
    found = {"article": False, "main": False}
    skip = None
    for x, begin in walk(root):
        if begin and skip is None:
            if x.tag in found or x.attrs.get("role", "").lower() == "main":
                found["main" if x.tag != "article" else "article"] = True
            elif x.tag in NOISE_TAGS:
                skip = x
        elif begin is False and x is skip:
            skip = None
    kind = "article" if found["article"] else "main" if found["main"] else ""
    is_main = lambda n: n.tag == kind or kind == "main" and n.attrs.get("role", "").lower() == "main"
    blocks: list[str] = []
    buf: list[str] = []
    paths = [ROOT]  # of the open containers
    inside, skip, head = 0 if kind else 1, None, 0

    def flush():
        words = " ".join("".join(buf).split())
        if words:
            blocks.append(words)
        buf.clear()

    for x, begin in walk(root):
        if begin is None:
            if inside and skip is None and head != 1:
                buf.append(x)
            continue
        boxed = template and x.parent is not None and (x.tag in CONTAINERS or x.tag == "article")
        if begin and boxed:
            paths.append(_below(paths[-1], x))
        elif boxed:
            paths.pop()
        if begin:
            if skip is not None:
                continue
            if x.parent is not None and (_noise(x, inside > 0 and kind == "article")
                                         or boxed and x.tag in CONTAINERS and not is_main(x) and paths[-1] in template):
                skip = x
                flush() if x.tag in BLOCKS else buf.append(" ")
                continue
            if kind and is_main(x):
                inside += 1
                flush()
            if x.tag == "header":          # inside an article: only its headings
                head = 1
            elif head == 1 and x.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"):
                head = 2
            if x.tag in BLOCKS:
                flush()
            elif x.tag in ("br", "td", "th", "wbr", "img"):
                buf.append("" if x.tag == "wbr" else " ")
        elif x is skip:
            skip = None
        elif skip is None:
            if x.tag in BLOCKS:
                flush()
            if head == 2 and x.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"):
                head = 1
            elif x.tag == "header":
                head = 0
            if kind and is_main(x):
                inside -= 1
    flush()
    return "\n\n".join(blocks)


def site(url: Column) -> Column:
    """Host of an address, with or without a scheme ('' where there is none)."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def _entropy(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Entropy of a column per host and path over its distinct (page, value)
    rows, to base m (their number): 1 if m is 1."""
    n = rows.select("host", "path", "page", value).distinct().groupBy("host", "path", value).agg(F.count("*").alias("c"))
    s = n.groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("x"))
    return s.select("host", "path", "m", F.when(F.col("m") > 1, (F.log("m") - F.col("x") / F.col("m")) / F.log("m"))
                    .otherwise(1.0).alias(name))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = 8) -> DataFrame:
    """(host, path, up, pages, text, importance) of the merged containers."""

    def run(batches):
        import xxhash

        for pdf in batches:
            rows = []
            for h, page in zip(pdf["host"], pdf["html"]):
                if page:
                    whole = xxhash.xxh64_intdigest(page.encode("utf-8", "replace"))
                    whole -= (whole >> 63) << 64
                    rows += [(h, whole, *r) for r in outline(page)]
            yield pd.DataFrame(rows, columns=["host", "page", "path", "up", "depth", "style", "content"])

    rows = pages.select(site(F.col(url_col)).alias("host"), F.col(html_col).alias("html")) \
        .mapInPandas(run, "host string, page long, path long, up long, depth int, style string, content string").distinct()
    rows = table(rows, "style-nodes")
    depth = rows.groupBy("host", "path").agg(F.max("depth").alias("depth"), F.max("up").alias("up"), F.countDistinct("page").alias("pages"))
    both = _entropy(rows, "style", "look").join(_entropy(rows, "content", "text").drop("m"), ["host", "path"]) \
        .join(depth, ["host", "path"])
    nodes = table(both, "style-merged")
    # leaves, and branches that are too rare to be template, are judged by their content
    many = F.col("pages") >= min_pages
    inner = nodes.where(many).select("host", F.col("path").alias("up")).join(nodes.select("host", "up").distinct(), ["host", "up"])
    inner = table(inner.select("host", F.col("up").alias("path")), "style-inner")
    leaf = nodes.join(inner, ["host", "path"], "left_anti").withColumn("importance", F.col("text"))
    keep = ["host", "path", "up", "pages", "text", "importance"]
    done = table(leaf.select(*keep), "style-level")
    depths = sorted((r[0] for r in nodes.join(inner, ["host", "path"], "left_semi").select("depth").distinct().collect()), reverse=True)
    for d in depths:  # levels that many pages of a host share; children before parents
        here = nodes.where(F.col("depth") == d).join(inner, ["host", "path"], "left_semi")
        kids = done.groupBy("host", F.col("up").alias("path")).agg(F.count("*").alias("l"), F.avg("importance").alias("below"))
        weight = F.pow(F.lit(GAMMA), F.col("l"))
        here = here.join(kids, ["host", "path"]).withColumn("importance", (1 - weight) * F.col("look") + weight * F.col("below"))
        done = done.unionByName(table(here.select(*keep), "style-level"))
    return done


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            threshold: float = 0.2, min_pages: int = 8) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    low = style_tree(pages, url_col, html_col, min_pages) \
        .where((F.col("importance") < threshold) & (F.col("text") < threshold) & (F.col("pages") >= min_pages))
    low = table(low.groupBy("host").agg(F.collect_set("path").alias("paths")), "style-template") \
        .withColumnRenamed("host", "h")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                       F.col(html_col).alias("html")).withColumn("site", site(F.col("url")))
    joined = src.join(low, F.col("site") == F.col("h"), "left").select("page_id", "url", "html", "paths")

    def run(batches):
        for pdf in batches:
            text = [main_text(page, set(paths) if paths is not None else frozenset())
                    for page, paths in zip(pdf["html"], pdf["paths"])]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text,
                                "n_chars": [len(t) for t in text]})

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")
