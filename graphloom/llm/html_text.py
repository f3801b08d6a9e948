"""HTML extraction with site template removal.

A page is parsed into elements.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments go by their tags, roles and class words (within an article by whole names, but for a few clear words); what is left of the article is cut into block
elements, each hashed with all below it.  Spark counts, per host, in how many different articles each
subtree occurs; subtrees that recur across many of them are the site's template and go too.  Copies of one
article count once, so a page that a site serves many times does not become its own template.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import rows_to_batches
from graphloom.llm.url_filter import host
from graphloom.session import cut, spread

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas button select textarea dialog menu head title audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# Words of a class or id (cut at white space, hyphens and underscores) that mark what is no part of an article.
ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar navigation"
    " breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription comment comments"
    " commentlist disqus respond reply replies share sharing social related recommended recommendations widget widgets login signup pagination pager"
    " toolbar copyright".split()
)
# Of these, what marks noise inside an article also as a part of a longer name; `social-history` or `share-prices` are an article's own.
CLEAR = frozenset("ad ads advert adverts advertisement sponsored breadcrumb breadcrumbs cookie cookies consent gdpr disqus navbar sidebar popup newsletter".split())
OUTSIDE = frozenset(["header", "masthead", "topbar", "search"])  # such things within an article hold its title
ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Element:
    __slots__ = ("tag", "names", "words", "roles", "kids")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.kids = tag, []
        self.names, self.words, self.roles = frozenset(), frozenset(), frozenset()
        if attrs and "=" in attrs:
            for name, *values in ATTRIBUTE.findall(attrs):
                value = html.unescape("".join(values)).lower()
                if name.lower() == "role":
                    self.roles = frozenset(value.split())
                else:
                    self.names |= frozenset(value.split())
                    self.words |= frozenset(re.split(r"[\s_\-]+", value))


def parse(page: str) -> Element:
    """The page's element tree; text is decoded.  Unclosed and stray tags are taken as browsers mostly take them."""
    root = Element("#root", "")
    stack = [root]
    counts: Counter[str] = Counter()  # open elements by tag: a stray end tag looks at none
    at, n = 0, len(page)

    def shut(k: int) -> None:
        counts.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            break
        if m.start() > at:
            stack[-1].kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            for k in range(len(stack) - 1, 0, -1) if counts[tag] else ():
                if stack[k].tag == tag:
                    shut(k)
                    break
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1) if counts["p"] else ():
                if stack[k].tag == "p":
                    shut(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or tag in ("dt", "dd") and stack[k].tag in ("dt", "dd") or tag in ("td", "th") and stack[k].tag in ("td", "th"):
                    shut(k)
                    break
                if stack[k].tag in ENDS[tag]:
                    break
        e = Element(tag, attrs)
        stack[-1].kids.append(e)
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(e)
            counts[tag] += 1
    if at < n:
        stack[-1].kids.append(html.unescape(page[at:]))
    return root


def _noise(e: Element, inside: bool) -> bool:
    if e.tag in DROPPED or e.tag == "header" and not inside or e.roles & ROLES:
        return True
    if e.tag in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
        return False
    if inside:
        return bool(e.names & ALWAYS) or bool(e.words & CLEAR)
    return bool(e.words & ALWAYS) or bool(e.words & OUTSIDE)


def roots(page: Element) -> list[Element]:
    """The outermost articles that are no comments or adverts; without any, the main elements, else the whole page."""
    found: dict[str, list[Element]] = {"article": [], "main": []}

    def walk(e: Element, in_main: bool) -> None:
        stack = [(e, in_main)]
        while stack:
            x, m = stack.pop()
            is_main = x.tag == "main" or "main" in x.roles
            if is_main and not m:
                found["main"].append(x)
            for k in reversed(x.kids):
                if isinstance(k, Element) and not _noise(k, False):
                    if k.tag == "article":
                        found["article"].append(k)
                    else:
                        stack.append((k, m or is_main))

    walk(page, False)
    return found["article"] or found["main"] or [page]


def blocks(root: Element, inside: bool, template: frozenset = frozenset()) -> tuple[list[str], list[int]]:
    """The blocks of text below a root without its noise and template, and the hashes of its block subtrees."""
    out: list[str] = []
    run: list[str] = []
    seen: list[int] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    # A frame per open element: its kids still to come, where its blocks began, and a digest of what is below it.
    stack = [[root, iter(root.kids), 0, xxhash.xxh64(root.tag)]]
    while stack:
        e, kids, mark, digest = stack[-1]
        k = next(kids, None)
        if isinstance(k, str):
            run.append(k)
            digest.update(" ".join(k.split()))
        elif k is not None:
            if k.tag == "br" or k.tag == "hr":
                flush() if k.tag == "hr" else run.append(" ")
            elif not _noise(k, inside):
                if k.tag in BLOCK:
                    flush()
                stack.append([k, iter(k.kids), len(out), xxhash.xxh64(" ".join([k.tag, *sorted(k.words)]))])
        else:
            stack.pop()
            if e.tag in BLOCK:
                flush()
            if stack:
                h = digest.intdigest()
                stack[-1][3].update(h.to_bytes(8, "little"))
                if e.tag in BLOCK and len(out) > mark:
                    h -= (h >> 63) << 64
                    seen.append(h)
                    if h in template:
                        del out[mark:]
    flush()
    return out, seen


def extract(page: str, template: frozenset = frozenset()) -> tuple[str, list[int]]:
    """(main text, hashes of block subtrees) of one page."""
    tree = parse(page)
    found = roots(tree)
    inside = found[0].tag == "article"
    out, seen = [], []
    for r in found:
        b, s = blocks(r, inside, template)
        out += b
        seen += s
    return "\n".join(out), seen


def templates(pages: DataFrame, min_articles: int = 5, min_share: float = 0.3) -> DataFrame:
    """(host, template): the subtrees that occur in at least `min_share` of a host's different articles, and in `min_articles`.

    pages: (host, html).  A host's list is no longer than 1 / min_share times an article's subtrees.
    """
    schema = pa.schema([("host", pa.string()), ("article", pa.int64()), ("subtree", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    text, seen = extract(b.column(1)[i].as_py())
                    if seen:
                        h = xxhash.xxh64_intdigest(text)
                        h -= (h >> 63) << 64
                        for s in set(seen):
                            yield b.column(0)[i].as_py(), h, s

        yield from rows_to_batches(rows(), schema)

    found = pages.where("host <> ''").select("host", "html").mapInArrow(run, "host string, article long, subtree long")
    per = found.distinct()
    counts = per.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_articles)
    hosts = per.select("host", "article").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    often = counts.join(hosts, "host").where(F.col("n") >= min_share * F.col("articles"))
    return cut(often.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("template")))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_articles: int = 5, min_share: float = 0.3) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Blocks are joined by a line feed; white space within one is a space; character references are decoded.  Null html is
    empty and gives an empty text; pages without a host lose no template; repeated rows stay repeated; an empty
    table gives no rows; other columns are ignored.
    """
    rows = spread(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")))
    rows = rows.withColumn("host", host(F.col("url")))
    known = templates(rows, min_articles, min_share)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for b in batches:
                for i in range(b.num_rows):
                    text, _ = extract(b.column(2)[i].as_py(), frozenset(b.column(3)[i].as_py() or ()))
                    yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), text, len(text)

        yield from rows_to_batches(out(), schema, size=lambda r: len(r[2]))

    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
