"""Main text of web pages, with site template removal.

Every page is parsed once. The outermost article elements give its text; without any, those of main; else the body. Elements that are
boilerplate by their tag, role or class go on any page. Of the rest, each element's subtree (tag, class, id, text, children) is
hashed, and Spark counts the hashes over all pages of a host: a subtree that recurs on many pages is the site's template and
is deleted, whatever its name. Pages of the same title and the same beginning (OPENING characters) of their longest paragraph or heading (for want of one, block) count
once, so copies of one page are no evidence of a template. Recurring means MIN_PAGES such pages at least, and RECURS of the host's or MANY.

Inside article and main only containers (CONTAINERS) are counted, as paragraphs, headings, items and quotations recur by being
quoted. An element that holds an article or main is never a template.

The parse leaves pieces of text with the hashes of the counted elements around each, far smaller than the page. Only pages that hold
a counted element meet the templates: as thin rows of (page, hash), so no html is shuffled and no host is one task.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

RECURS, MIN_PAGES, MANY = 0.2, 5, 500
OPENING = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object select xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset("head nav footer aside form button menu dialog".split()) | RAW
ENDS_P = BLOCK - frozenset("br option td th tr tbody thead tfoot caption legend summary".split())
SAME_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
CONTAINERS = frozenset("div section ul ol dl table figure details center address fieldset".split())
WORDS = (
    r"(?:ads?|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|masthead|topbar|toolbar|cookies?\w*|consent|gdpr"
    r"|notice\w*|alert|popup|modal|newsletter|subscribe|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|comments?|comment\w*|respond|disqus\w*|replies|widget\w*|pagination|pager|skip\w*)"
)
BOILERPLATE = re.compile(rf"(?:^|[\s_-]){WORDS}(?:$|[\s_-])", re.I)
INSIDE = re.compile(WORDS.replace(r"\w*", r"[^\W_]*"), re.I)  # within article and main: a whole class token of an element that is no prose; ids there are often slugs of headings
_WS = re.compile(r"\s+")
_TITLE = re.compile(r"<title[^>]*>([^<]*)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


class Node:
    __slots__ = ("tag", "name", "classes", "role", "parts", "inside")

    def __init__(self, tag: str, name: str, classes: str, role: str, inside: bool):
        self.tag, self.name, self.classes, self.role, self.inside = tag, name, classes, role, inside
        self.parts: list[Node | str] = []

    def boilerplate(self) -> bool:
        if self.tag in DROP or self.role in ROLES or (self.tag == "header" and not self.inside):
            return True
        if self.inside:
            return self.tag not in ("article", "main") and self.tag not in PROSE and any(INSIDE.fullmatch(c) for c in self.classes.split())
        return bool(self.name) and self.tag not in ("html", "body", "article", "main") and bool(BOILERPLATE.search(self.name))


def parse(page: str) -> Node:
    root = Node("", "", "", "", False)
    stack = [root]
    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ENDS_P and stack[i].tag != "p":
                    break
        if tag in SAME_ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag in ("dt", "dd") and stack[i].tag in ("dt", "dd")) or (tag in ("td", "th") and stack[i].tag in ("td", "th")):
                    del stack[i:]
                    break
                if stack[i].tag in SAME_ENDS[tag]:
                    break
        name = classes = role = ""
        if attrs:
            for k, a, b, c in _ATTR.findall(attrs):
                if k.lower() == "role":
                    role = (a or b or c).lower()
                else:
                    name += " " + (a or b or c)
                    if k.lower() == "class":
                        classes += " " + (a or b or c)
        node = Node(tag, name, classes, role, stack[-1].inside or tag in ("article", "main"))
        stack[-1].parts.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def roots(root: Node) -> list[Node]:
    """The elements that the text is taken from."""
    for want in ("article", "main", "body"):
        found: list[Node] = []
        todo: list[Node] = [root]
        while todo:
            x = todo.pop()
            if x.tag == want:
                found.append(x)
            elif not x.boilerplate():
                todo.extend(c for c in reversed(x.parts) if not isinstance(c, str))
        if found:
            return found
    return [root]


def counted(root: Node) -> dict[int, int]:
    """The hash of the subtree of each element below a root that can be template: by the element's id()."""
    found: dict[int, int] = {}
    digest: dict[int, bytes] = {}
    holds: set[int] = set()
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        x, done = todo.pop()
        if not done:
            if x.boilerplate():
                digest[id(x)] = b""
                continue
            todo.append((x, True))
            todo.extend((c, False) for c in x.parts if not isinstance(c, str))
            continue
        h = blake2b(f"{x.tag}|{x.name}|".encode("utf-8", "surrogatepass"), digest_size=8)
        full = False
        for c in x.parts:
            part = " ".join(c.split()).encode("utf-8", "surrogatepass") if isinstance(c, str) else digest[id(c)]
            if part:
                full = True
                h.update(len(part).to_bytes(4, "little") + part)
        digest[id(x)] = h.digest() if full else b""
        if x.tag in ("article", "main") or any(id(c) in holds for c in x.parts):
            holds.add(id(x))
        elif full and x is not root and x.tag not in ("", "html", "body") and (x.tag in CONTAINERS or not x.inside):
            found[id(x)] = int.from_bytes(h.digest(), "little", signed=True)
    return found


def pieces(page: str) -> tuple[list[tuple[str, tuple[int, ...]]], str]:
    """The page's text in order, each piece with the hashes of the counted elements around it; and the page's title and opening.

    A block has a space at its edges.
    """
    out: list[tuple[list[str], tuple[int, ...]]] = []
    block, longest = [], (False, 0, "")

    def put(text: str, around: tuple[int, ...]) -> None:
        if out and out[-1][1] is around:
            out[-1][0].append(text)
        else:
            out.append(([text], around))

    for root in roots(parse(page)):
        hashes = counted(root)
        todo: list = [(root, (), False)]
        while todo:
            x, around, prose = todo.pop()
            if x is None:
                put(" ", around)
                if (prose, n := sum(map(len, block))) > longest[:2]:
                    longest = (prose, n, "".join(block))
                block = []
            elif isinstance(x, str):
                put(html_.unescape(x), around)
                block.append(x.strip())
            elif not x.boilerplate():
                inner = (*around, hashes[id(x)]) if id(x) in hashes else around
                own = prose or x.tag in PROSE
                first, last = ([(None, around, p)] if x.tag in BLOCK else [] for p in (prose, own))
                todo += [*last, *((c, inner, own) for c in reversed(x.parts)), *first]
        put(" ", ())
    title = _TITLE.search(page)
    return [(_WS.sub(" ", "".join(t)), around) for t, around in out], f"{title[1] if title else ''}|{longest[2][:OPENING]}"


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _parsed(pages: DataFrame) -> DataFrame:
    kind = pages.schema["page_id"].dataType.simpleString()
    piece = pa.struct([("t", pa.string()), ("around", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, opening = zip(*(pieces(p or "") for p in b.column("html").to_pylist())) if b.num_rows else ((), ())
            all_hashes = [sorted({h for _, around in page for h in around}) for page in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("rid"), b.column("page_id"), b.column("url"), b.column("host"), pa.array(opening, pa.string()),
                    pa.array([[{"t": t, "around": around} for t, around in page] for page in found], pa.list_(piece)), pa.array(all_hashes, pa.list_(pa.int64())),
                ],
                names=["rid", "page_id", "url", "host", "opening", "pieces", "hashes"],
            )

    rows = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url", host(F.col("url")).alias("host"), "html")
    out = rows.mapInArrow(run, f"rid long, page_id {kind}, url string, host string, opening string, pieces array<struct<t:string,around:array<long>>>, hashes array<long>")
    return out.withColumn("opening", F.xxhash64("opening"))


def templates(parsed: DataFrame) -> DataFrame:
    """(host, hash, n): the recurring subtrees of each host and the openings they recur under."""
    sizes = parsed.groupBy("host", "opening").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("openings"))
    seen = parsed.select("host", "opening", F.explode("hashes").alias("hash")).groupBy("host", "hash", "opening").agg(F.lit(1))
    seen = seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    return seen.join(sizes, "host").where((F.col("n") >= RECURS * F.col("openings")) | (F.col("n") >= MANY)).select("host", "hash", "n")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars, n_removed (different template subtrees deleted from the page).

    A null or empty page has an empty text. A null url belongs to the host of empty name, as does one without a host. Pages are
    parsed whole; repeated rows stay apart. On a host of fewer than MIN_PAGES different pages nothing recurs.
    """
    parsed = keep(_parsed(pages), "pages")
    hit = parsed.select("host", "rid", F.explode("hashes").alias("hash")).join(templates(parsed).select("host", "hash"), ["host", "hash"])
    hit = hit.groupBy("rid").agg(F.collect_set("hash").alias("gone"))
    held = F.size("hashes") > 0
    none = F.expr("cast(array() as array<long>)")
    some = parsed.where(held).join(hit, "rid", "left").withColumn("gone", F.coalesce("gone", none)).drop("rid", "host", "opening", "hashes")
    rows = parsed.where(~held).select("page_id", "url", "pieces", none.alias("gone")).unionByName(some)
    left = F.filter("pieces", lambda x: ~F.arrays_overlap(x["around"], F.col("gone")))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(left, lambda x: x["t"]), ""), " {2,}", " "))
    rows = rows.select("page_id", "url", text.alias("text"), F.size("gone").cast("long").alias("n_removed"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")
