"""Main text of web pages: site templates found by their recurrence on a host and removed, then what is left of the article.

Each element of a page is hashed with all it holds (names of elements and texts, in order). Spark counts for each host and hash
the pages on which it occurs; a subtree on many pages of a host is part of that site's template and is deleted. What
occurs once on a page can still be an advert or a reader's comment, so elements that are such by their name, role, class or id go too.

Pages that copy each other would make a template of their article. So pages count by different main texts, however many copies
each has; what an article is made of (paragraphs, headings, lists, quotations, tables) is never template inside an article or main element;
and where more than four fifths of a main text recur, the page is taken for a near copy of others and keeps its paragraphs.

The first pass sends a host and eight bytes for each element, counted before and after the shuffle by host and hash, so a host with
a third of all pages is spread over all tasks. Templates are on at least a twentieth of the host's pages, so a host has
at most twenty times as many as a page has elements; they go to a table in the shared folder. Its size decides how the second
pass joins it: Spark broadcasts it while it is below its own threshold, and else shuffles.
"""

from __future__ import annotations

import html
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A subtree is template on so many different pages of a host, and on such a share of these.
MIN_PAGES, MIN_SHARE = 3, 0.05
#: Where templates hold more than this share of the main text, the page is taken for a copy of others, and its paragraphs, lists and tables stay.
MAX_TEXT_SHARE = 0.8

# The names of elements in HTML. Void ones have no end; the content of raw ones isn't markup and isn't text here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that can't be part of an article by their name.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object embed applet svg math canvas audio video button select input textarea dialog menu title".split())
#: What articles are made of.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th tr tbody thead tfoot table ul ol dl figure".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or an id that tell what isn't an article; of inline elements only the second list counts.
DROPPED_NAMES = re.compile(
    r"ads?|advert\w*|adsby\w*|adslot|adbox|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter\w*|subscri\w*|signup|login|shar(?:e|ing)|social\w*|sidebars?"
    r"|widgets?|related|recommend\w*|nav|navbar|navigation|menus?|breadcrumbs?|masthead|footer|comments?|commentlist|disqus|respond|repl(?:y|ies)|pagination|pager|search|toolbar|copyright"
)
DROPPED_INLINE_NAMES = re.compile(r"ads?|advert\w*|adsby\w*|sponsor\w*|promo\w*|shar(?:e|ing)|social\w*")
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words beside which `header` and, of an article, `comments` tell nothing.
CONTENT_NAMES = frozenset("article post entry story content".split())
#: What may stand in a head; any other element ends it.
IN_HEAD = frozenset("title meta link style script base noscript template head".split())
#: Elements that a start tag of the name ends, when they are the innermost but for inline ones.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody")}

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|(?<=[=\s])"[^"]*+(?:"|\Z)|(?<=[=\s])'[^']*+(?:'|\Z)|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


@dataclass(eq=False, slots=True)
class Element:
    name: str
    parent: Element | None
    inside: Element | None = None  # the innermost element around it that isn't inline, or itself
    never: bool = False  # its name, role or style keep it out
    named: bool = False  # its class or id may keep it out
    comments: bool = False
    header: bool = False
    article: bool = False
    items: list = field(default_factory=list)  # texts, elements, and None for the end of a block
    hash: int = 0
    n_text: int = 0  # code points but white space, without what is never part of an article
    n_articles: int = 0
    out: bool = False


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), value.strip("\"'") if value[:1] in "\"'" else value)
    return out


def _describe(e: Element, attributes: str) -> None:
    e.never, e.header, e.article = e.name in DROPPED, e.name == "header", e.name == "article"
    if e.never or not attributes.strip("/ \t\n\r"):
        return
    a = _attributes(attributes)
    role = a.get("role", "").lower()
    e.article = e.article or role == "article"
    e.never = "hidden" in a or role in DROPPED_ROLES or a.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(a.get("style", "")))
    told = a.get("class", "") + " " + a.get("id", "")
    names = {w.lower() for w in (*_NAME.findall(told), *re.split(r"[\s_-]+", told))}  # sideBar tells side, bar and sidebar
    if e.article:  # comments are articles at times, and an article may be open to comments
        e.never = e.never or not COMMENT_NAMES.isdisjoint(names) and CONTENT_NAMES.isdisjoint(names)
        return
    e.header = e.header or "header" in names and CONTENT_NAMES.isdisjoint(names)
    e.named = any(map((DROPPED_INLINE_NAMES if e.name in INLINE else DROPPED_NAMES).fullmatch, names))
    e.comments = not COMMENT_NAMES.isdisjoint(names)


class Page:
    """The elements of a page in order; the first holds all."""

    def __init__(self, page: str | None):
        self.root = Element("html", None)
        self.root.inside = self.root
        self.elements = [self.root]
        self._top, self._opened = self.root, {"html": 1}
        self._read(page or "")
        self._judge()

    def _close(self, to: Element) -> None:
        while True:
            e = self._top
            self._opened[e.name] -= 1
            self._top = e.parent
            if e.name not in INLINE:
                self._top.items.append(None)
            if e is to:
                return

    def _end(self, name: str) -> None:
        if not self._opened.get(name):
            if name in ("p", "br"):
                self._top.items.append(None if name == "p" else " ")
            return
        to = self._top
        while to.name != name:
            if name in INLINE and to.name not in INLINE:
                return  # an inline end doesn't end a block
            to = to.parent
        if to is not self.root:
            self._close(to)

    def _start(self, name: str, attributes: str) -> None:
        if self._opened.get("head") and name not in IN_HEAD:
            self._end("head")
        if name in ("html", "body"):
            return
        if name not in INLINE:
            if self._top.inside.name == "p":
                self._close(self._top.inside)
            while self._top.inside.name in ENDED_BY.get(name, ()):
                self._close(self._top.inside)
            self._top.items.append(None)
        if name in VOID:
            if name in ("br", "wbr"):
                self._top.items.append(" " if name == "br" else "")
            return
        e = Element(name, self._top)
        e.inside = self._top.inside if name in INLINE else e
        _describe(e, attributes)
        self._top.items.append(e)
        self.elements.append(e)
        self._opened[name] = self._opened.get(name, 0) + 1
        self._top = e

    def _read(self, page: str) -> None:
        """Ends that are missing or misplaced are put where a browser would, near enough."""
        at = 0
        while at < len(page):
            found = _TAG.search(page, at)
            text = page[at : found.start()] if found else page[at:]
            if text:
                if self._top.name == "head" and not text.isspace():
                    self._end("head")
                self._top.items.append(text)
            if not found:
                return
            at = found.end()
            name = (found[2] or "").lower()
            if name in RAW and not found[1]:  # to its end, or to that of the page
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name and not found[1]:
                self._start(name, found[3])
            elif name:
                self._end(name)

    def _judge(self) -> None:
        """Hashes and numbers of all elements, and which are out by what they are."""
        for e in reversed(self.elements):  # what is inside comes after
            told = [e.name.encode()]
            for item in e.items:
                if isinstance(item, str):
                    words = item.split()
                    if words:
                        told.append(b"\0" + " ".join(words).encode("utf-8", "surrogatepass"))
                        e.n_text += sum(map(len, words))
                elif item is not None:
                    if item.hash:
                        told.append(b"\1" + struct.pack("<q", item.hash))
                    if not item.never:
                        e.n_text += item.n_text
                        e.n_articles += item.n_articles + item.article
            if len(told) > 1:  # one without text isn't counted
                e.hash = struct.unpack("<q", blake2b(b"".join(told), digest_size=8).digest())[0] or 1
        n_articles, n_text = self.root.n_articles, self.root.n_text
        mains: list[Element] = []
        self.roots: list[Element] = []
        self.in_article, self.in_main = set(), set()
        for e in self.elements[1:]:
            nested, within = e.parent in self.in_article, e.parent in self.in_article or e.parent in self.in_main
            around = e.n_articles + e.article == n_articles > 0 or e.name == "main"  # a wrapper of all articles
            named = e.named and not around and (e.comments or 2 * e.n_text <= n_text)
            e.out = e.parent.out or e.never or named or (e.article and nested) or (e.header and not within and not around)
            if e.article and not e.out:
                self.roots.append(e)
            if nested or e.article:
                self.in_article.add(e)
            if e.parent in self.in_main or e.name == "main":
                self.in_main.add(e)
            if e.name == "main" and not e.out:
                mains.append(e)
        self.roots = self.roots or mains[:1] or [self.root]

    def counted(self) -> set[int]:
        """Hashes of the subtrees that may be template: not those around the article, nor what an article is made of."""
        around = {a for r in self.roots for a in _up(r)}
        return {e.hash for e in self.elements if e.hash and self._may_recur(e, around)}

    def _may_recur(self, e: Element, around: set[Element]) -> bool:
        return e.name not in INLINE and e not in around and not (e.name in PROSE and (e in self.in_article or e in self.in_main))

    def text(self, templates: frozenset[int] = frozenset()) -> str:
        """The main text: blocks, each a line."""
        if templates:
            around = {a for r in self.roots for a in _up(r)}
            total = sum(r.n_text for r in self.roots)
            gone = [e for e in self.elements if e.hash in templates and not e.out and self._may_recur(e, around)]
            for part in (gone, [e for e in gone if e.name not in PROSE]):
                chosen = set(part)
                outer = [e for e in part if chosen.isdisjoint(_up(e.parent))]
                if sum(e.n_text for e in outer) <= MAX_TEXT_SHARE * total:
                    return _text(self.roots, chosen)
        return _text(self.roots, set())


def _up(e: Element | None) -> Iterator[Element]:
    while e:
        yield e
        e = e.parent


def _text(roots: list[Element], gone: set[Element]) -> str:
    blocks: list[list[str]] = [[]]
    for root in roots:
        blocks.append([])
        todo = [iter(root.items)]
        while todo:
            for item in todo[-1]:
                if isinstance(item, str):
                    blocks[-1].append(html.unescape(item) if "&" in item else item)
                elif item is None:
                    blocks.append([])
                elif not item.out and item not in gone:
                    todo.append(iter(item.items))
                    break
            else:
                todo.pop()
    lines = (" ".join("".join(b).split()) for b in blocks if b)
    return "\n".join(line for line in lines if line)


def host_of(url: Column) -> Column:
    """The host of an address in lower case; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host and templates: the hashes of the subtrees that are on many of the host's pages (url, html). Hosts without any have no row.

    A page counts once for each different main text. The table is in the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.parts(batches):
            hosts, mains, hashes = [], [], []
            for host, page in common.rows(iter([part]), "host", "html"):
                own = Page(page)
                hosts.append(host)
                mains.append(struct.unpack("<q", blake2b(own.text().encode("utf-8", "surrogatepass"), digest_size=8).digest())[0])
                hashes.append([0, *own.counted()])  # 0 counts the pages of a host
            yield common.emit(schema, [hosts, mains, hashes])

    schema = pa.schema([("host", pa.string()), ("main", pa.int64()), ("hashes", pa.list_(pa.int64()))])
    spark = pages.sparkSession
    at = f"{common.shared_dir(spark)}/templates-{uuid.uuid4().hex}"
    hosted = common.small_batches(pages).select(host_of(pages["url"]).alias("host"), "html").where("host IS NOT NULL")
    met = hosted.mapInArrow(common.tidy(run), "host string, main bigint, hashes array<bigint>").select("host", "main", F.explode("hashes").alias("hash"))
    counts = met.distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where((F.col("hash") == 0) | (F.col("n") >= min_pages))
    counts.write.parquet(f"{at}/counts")
    counts = spark.read.parquet(f"{at}/counts")
    sizes = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    many = counts.where("hash <> 0").join(sizes, "host").where(F.col("n") >= min_share * F.col("pages"))
    many.groupBy("host").agg(F.collect_list("hash").alias("templates")).write.parquet(f"{at}/templates")
    common.remove(spark, f"{at}/counts")
    return spark.read.parquet(f"{at}/templates")


def extract(pages: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html): the main text, blocks joined by line feeds; empty if there is none.

    templates: what site_templates() gives, by default for these pages. A null page is an empty one. A page without a host has no
    template. Repeated rows get a row each; an empty table gives none; other columns are ignored.
    """
    found = site_templates(pages) if templates is None else templates
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[int]] = {}
        for part in common.parts(batches):
            ids, urls, texts = [], [], []
            known.clear()
            lists = part.column(3)
            for i, (page_id, url, page, host) in enumerate(common.rows(iter([part]), "page_id", "url", "html", "host")):
                if host not in known:
                    known[host] = frozenset(lists[i].as_py() or ())
                ids.append(page_id)
                urls.append(url)
                texts.append(Page(page).text(known[host]))
            yield common.emit(schema, [ids, urls, texts])

    # Pages without a host are spread over as many keys as there are, which no host has.
    alone = F.concat(F.lit("?"), F.xxhash64("url", "html").cast("string"))
    own = common.small_batches(pages).select(pages["page_id"].cast("bigint").alias("page_id"), "url", "html").withColumn("host", F.coalesce(host_of(F.col("url")), alone))
    joined = own.join(found, "host", "left").select("page_id", "url", "html", "templates", "host")
    return joined.mapInArrow(common.tidy(run), "page_id bigint, url string, text string")
