"""HTML extraction: the article of a page without site templates.

A page is parsed once into text blocks and the fingerprints of all element
subtrees that hold them.  Fingerprints are counted per host in Spark, over pages
whose main texts differ, so that copies of a page do not make its article look like a
template; subtrees that recur on at least MIN_PAGES such pages and MIN_SHARE of a
host's pages are deleted, outside of marked main text from BESIDE_PAGES and
BESIDE_SHARE on.  Of what is left, elements that by tag, role or class
are menus, headers, footers, sidebars, notices, adverts, forms or reader
comments go as well, as does all outside the article where there is one.  Scripts,
styles and other elements without readable text are no blocks at all.

Defined cases: a null or empty html has an empty text; a null url has the empty
host; repeated rows are pages by themselves but count once for templates;
unclosed tags end with their parent; unknown character references stay as written;
a page that stands in a form as a whole is read as if the form were none.
"""

from __future__ import annotations

import hashlib
import html as references
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .urlfilter import host_of

#: Pages, and shares of a host's pages, on which a template recurs: anywhere, and outside of marked main text.
MIN_PAGES, MIN_SHARE, BESIDE_PAGES, BESIDE_SHARE = 5, 0.5, 3, 0.02
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math object canvas textarea title xmp noembed noframes".split())
DROP = RAW | set("head nav footer aside form button select option menu dialog datalist fieldset audio video".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert toolbar".split())
CLASSES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar sidebars widget widgets aside rail cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login form search comment comments commentlist respond replies reply disqus discussion reactions share sharing social related recommended "
    "recommendations pagination pager skip toolbar legal copyright".split()
)
#: First parts of class names that tell what stands beside an element, not what it is; those that name it whatever follows; last parts that name a part or place of what stands in front.
LAYOUT = set("has with no without is not".split())
LEADS = set("ad ads advert adverts advertisement adsense sponsor sponsored promo related recommended recommendations cookie cookies consent gdpr newsletter pagination pager breadcrumb breadcrumbs disqus sidebar sidebars".split())
PARTS = set(
    "area author avatar bar block body bottom box btn button buttons card cards col column container content count counter date desktop feed field fixed form frame global group holder icon icons inline inner input "
    "item items label large layer layout left link links list lists logo main meta mobile navigation outer overlay page panel pane placement primary region replies reply right row rows "
    "secondary section site slot small social stream submit tab tabs text thread threads title toggle tools top tree ul unit units user users view wrap wrapper zone".split()
)
#: Elements whose end a start tag of the same kind implies.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
BLOCKS_CLOSE_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {name: re.compile(rf"</{name}\s*[^>]*>", re.I) for name in RAW}
SPLIT = re.compile(r"[\s_]+|-")
SPACE = re.compile(r"\s+")
MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?main")
#: Elements that hold the page's own text as a whole; no template.
WHOLE = set("html body article main".split())


def named(parts: list[str]) -> bool:
    """Whether a name of several parts is that of something beside the article: it leads with it, or its last part that is no part or place is one (a comment-list, no share-holders)."""
    if parts[0] in LAYOUT:
        return False
    if parts[0] in LEADS:
        return True
    last = len(parts) - 1
    while last > 0 and parts[last] not in CLASSES and (parts[last] in PARTS or not parts[last].isalpha()):
        last -= 1
    return parts[last] in CLASSES


def junk(name: str, attributes: str, article: bool, forms: bool = False) -> bool:
    """Whether an element is no content by its tag, role, class or id; with ``forms``, a form is a container like others."""
    if name in DROP and not (forms and name == "form") or name == "header" and not article:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for match in ATTRIBUTE.finditer(attributes):
        key, value = match[1].lower(), (match[2] or match[3] or match[4] or "").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id"):
            for token in value.split():
                if token in CLASSES or named(SPLIT.split(token)):
                    return True
    return False


class Element:
    __slots__ = ("name", "first", "parts", "kind")

    def __init__(self, name: str, first: int, kind: int):
        self.name, self.first, self.parts, self.kind = name, first, [name], kind


#: Kinds of blocks: what the rules refuse, text outside of main elements, within one, within an article.
JUNK, PLAIN, MAIN, ARTICLE = -1, 0, 1, 2


def parse(page: str, forms: bool = False) -> tuple[list[str], list[int], list[tuple[int, int, int, bool]]]:
    """All text blocks of a page, their kinds, and (fingerprint, first block, end block, beside) of every element subtree that holds some.

    ``beside`` tells that the page marks its main text and the element stands outside of it.

    A fingerprint is that of the element's name, its text and its children's
    fingerprints in order; attributes do not count, since links often differ.
    """
    blocks: list[str] = []
    kinds: list[int] = []
    trees: list[tuple[int, int, int, int]] = []
    text: list[str] = []
    stack = [Element("", 0, PLAIN)]
    # how often each name is open: within the outermost refused element there is one, else on the page
    outside: dict[str, int] = {}
    inside: dict[str, int] = {}
    refused = 0  # depth of that element
    held: list[list[str]] = []  # the text around a refused inline element, which does not end a block

    def flush() -> None:
        if text:
            joined = SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if joined:
                blocks.append(joined)
                kinds.append(stack[-1].kind)
                stack[-1].parts.append(joined)

    def open_element(name: str, kind: int) -> None:
        nonlocal refused
        if kind == JUNK and not refused:
            refused = len(stack)
        count = inside if refused else outside
        count[name] = count.get(name, 0) + 1
        stack.append(Element(name, len(blocks), kind))

    def close() -> None:
        nonlocal refused
        flush()
        element = stack.pop()
        (inside if refused else outside)[element.name] -= 1
        if refused == len(stack):
            refused = 0
            inside.clear()
            if held:
                text[:] = held.pop()
        mark = hashlib.blake2b("\0".join(element.parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        stack[-1].parts.append(mark.hex())
        if element.first < len(blocks) and element.name not in WHOLE:
            trees.append((int.from_bytes(mark, "little", signed=True), element.first, len(blocks), element.kind))

    at, end = 0, len(page)
    for_token = TOKEN.search
    while at < end:
        match = for_token(page, at)
        start = match.start() if match else end
        if start > at:
            text.append(references.unescape(page[at:start]))
        if not match:
            break
        at, name = match.end(), match[2]
        if name is None:
            continue
        name, closing, attributes = name.lower(), match[1], match[3]
        if closing:
            if name == "br":
                text.append("\n")
            elif (inside if refused else outside).get(name):
                while stack[-1].name != name:
                    close()
                close()
            elif name not in INLINE:
                flush()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name in RAW:
            if name not in INLINE:
                flush()
            stop = RAW_END[name].search(page, at)
            at = stop.end() if stop else end
            continue
        parent = stack[-1].kind
        if parent != JUNK and junk(name, attributes, parent > PLAIN, forms):
            if attributes.endswith("/"):
                continue
            if name in INLINE:
                held = [text.copy()]
                text.clear()
            else:
                flush()
            imply(name, stack, close)
            open_element(name, JUNK)
            continue
        if name in INLINE:
            if refused and name == stack[refused].name:  # so that its end does not close the refused one
                open_element(name, JUNK)
            continue
        flush()
        imply(name, stack, close)
        parent = stack[-1].kind
        own = ARTICLE if name == "article" else MAIN if name == "main" or "main" in attributes and MAIN_ROLE.search(attributes) else PLAIN
        open_element(name, parent if parent == JUNK else max(parent, own))
    while len(stack) > 1:
        close()
    flush()
    marked = max(kinds, default=JUNK) > PLAIN
    return blocks, kinds, [(h, a, b, marked and kind <= PLAIN) for h, a, b, kind in trees]


def read(page: str) -> tuple[list[str], list[int], list[tuple[int, int, int, bool]]]:
    """``parse``; where nothing but forms is left, one of them holds the page, and forms count as containers."""
    found = parse(page)
    return parse(page, forms=True) if found[0] and max(found[1]) == JUNK and "<form" in page.lower() else found


def imply(name: str, stack: list[Element], close) -> None:
    """Close the elements whose end the start tag ``name`` implies."""
    implied = CLOSES.get(name, set()) | ({"p"} if name in BLOCKS_CLOSE_P else set())
    while len(stack) > 1 and stack[-1].name in implied:
        close()


def main_blocks(blocks: list[str], kinds: list[int]) -> list[str]:
    """The articles' blocks where there are some, else the main element's, else all that the rules leave."""
    want = max(kinds, default=JUNK)
    return [b for b, k in zip(blocks, kinds, strict=True) if k == want] if want > JUNK else []


def parsed(pages: DataFrame) -> DataFrame:
    """tag (a row's own number), page_id, url, host, main (fingerprint of the main text), blocks (compressed, a line each), kinds, trees."""
    schema = "tag long, page_id long, url string, host string, main long, blocks binary, kinds array<tinyint>, trees array<struct<h: long, a: int, b: int, beside: boolean>>"
    tree = pa.list_(pa.struct([("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("beside", pa.bool_())]))

    def run(batches):
        press = zstandard.ZstdCompressor(level=12)
        for batch in batches:
            found = [read(h or "") for h in batch.column("html").to_pylist()]
            main = [hashlib.blake2b("\0".join(main_blocks(b, k)).encode("utf-8", "surrogatepass"), digest_size=8).digest() for b, k, _ in found]
            cols = [*(batch.column(c) for c in ("tag", "page_id", "url", "host")), pa.array([int.from_bytes(m, "little", signed=True) for m in main], pa.int64())]
            cols += [pa.array([press.compress("\n".join(f[0]).encode()) for f in found], pa.binary()), pa.array([f[1] for f in found], pa.list_(pa.int8()))]  # no block holds a line end
            cols.append(pa.array([[{"h": h, "a": a, "b": b, "beside": o} for h, a, b, o in f[2]] for f in found], tree))
            yield pa.RecordBatch.from_arrays(cols, ["tag", "page_id", "url", "host", "main", "blocks", "kinds", "trees"])

    tk.tune(pages.sparkSession, 200)
    source = pages.select(F.monotonically_increasing_id().alias("tag"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(tk.tidy(run), schema)


def assembled(rows: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_templates: first the templates ``gone`` go, then what the rules refuse, and what is not of the best kind left."""

    def run(batches):
        lift = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for packed, kinds, gone in zip(*(batch.column(c).to_pylist() for c in ("blocks", "kinds", "gone")), strict=True):
                blocks = lift.decompress(packed).decode().split("\n") if kinds else []
                left = [i for i in range(len(kinds)) if not any(g["a"] <= i < g["b"] for g in gone or ())]
                texts.append(" ".join(main_blocks([blocks[i] for i in left], [kinds[i] for i in left])))
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(g or ()) for g in batch.column("gone").to_pylist()], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "n_templates"])

    return rows.select("page_id", "url", "blocks", "kinds", "gone").mapInArrow(tk.tidy(run), "page_id long, url string, text string, n_chars long, n_templates long")


def templates(rows: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, h, anywhere): subtrees that recur on many pages, with differing main texts, of a host; ``anywhere`` if within the main text too."""
    seen = rows.select(F.xxhash64("host").alias("site"), "main", "trees")
    least, share = min(min_pages, BESIDE_PAGES), min(min_share, BESIDE_SHARE)
    size = seen.groupBy("site", "main").agg(F.lit(1).alias("one")).groupBy("site").agg(F.count("*").alias("pages")).where(f"pages >= {least}")
    marks = seen.select("site", "main", F.explode(F.array_distinct("trees.h")).alias("h")).distinct()
    often = marks.groupBy("site", "h").agg(F.count("*").alias("k")).where(f"k >= {least}")
    return often.join(size, "site").where(f"k >= {share} * pages").select("site", "h", F.expr(f"k >= {min_pages} AND k >= {min_share} * pages").alias("anywhere"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_templates (deleted subtrees) of every row."""
    rows = tk.stored(parsed(pages))
    found = tk.stored(templates(rows, min_pages, min_share))
    spans = rows.select("tag", F.xxhash64("host").alias("site"), F.explode("trees").alias("t")).select("tag", "site", F.col("t.h").alias("h"), "t.a", "t.b", "t.beside")
    gone = spans.join(found, ["site", "h"]).where("anywhere OR beside").groupBy("tag").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    return assembled(rows.join(gone, "tag", "left"))
