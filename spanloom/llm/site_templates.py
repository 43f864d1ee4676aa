"""Main text of web pages by removal of site templates.

Every page is parsed into elements and each element's subtree is hashed (tag,
classes, text, children). Spark counts on how many pages of its host a subtree
occurs; subtrees that recur on many pages are the site's template and are
deleted from every page of the host, together with what markup itself names as
menus, notices, forms and the like. What is left of the article is the text.
Inside an article a name alone deletes nothing: the block must also hold mostly
links, form controls or a list of comments, or be a short part of the article.

Pages of a host are spread over ``SALTS`` keys before they meet the host's
template, and subtree counts are summed within each task first.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A subtree is template from so many pages and from this share of the host's pages on.
LEAST_PAGES, LEAST_SHARE = 5, 0.1
SALTS = 32

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript iframe xmp noembed noframes".split()
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end tag of WITHIN closes nothing beyond the innermost of BARRIERS.
WITHIN, BARRIERS = INLINE | {"p", "li"}, ("table", "article", "body")
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
DROPPED = set("head script style noscript template iframe object svg canvas form button select input textarea nav aside footer dialog menu audio video map title".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words in a class or id that name what is not part of an article.
NAMED = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription "
    "popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar share sharing social related recommended "
    "comment comments commentlist reply replies disqus discussion login signup".split()
)
#: Those of them that hardly ever name a part of an article's subject.
PLAIN = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter popup modal overlay sidebar navbar "
    "breadcrumb breadcrumbs pagination pager masthead comments commentlist disqus".split()
)
#: Words beside them that say nothing of the content.
FRAME = set("box block container wrapper slot unit list area section widget inner outer".split())
COMMENTS = set("comment comments commentlist reply replies disqus discussion".split())
CONTROLS = set("form button input select textarea".split())
#: Characters up to which a block is short.
SHORT = 200
HEADER = {"header"}
CONTENT = {"article", "main"}
#: Containers: the only subtrees inside an article that may count as template.
CONTAINERS = set("div section ul ol dl table figure header aside nav footer form menu details".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[^a-z]+")


class Element:
    __slots__ = ("tag", "attributes", "children", "parent", "key", "holds", "title", "size", "linked", "controls", "top", "article")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list = []
        self.key, self.holds, self.title = 0, False, False
        self.size, self.linked, self.controls = 0, 0, False
        self.top = self.article = None  # outermost part of content around the element, and outermost article


class OpenElements:
    """Open elements from the root inwards, and the depths at which each tag is open."""

    def __init__(self):
        self.stack = [Element("", "", None)]
        self.depths: dict[str, list[int]] = {}
        self.solid = [0]  # of what is neither inline nor a paragraph

    def push(self, element: Element) -> None:
        depth = len(self.stack)
        self.stack.append(element)
        self.depths.setdefault(element.tag, []).append(depth)
        if element.tag not in INLINE and element.tag != "p":
            self.solid.append(depth)

    def cut(self, depth: int) -> None:
        """Close everything from this depth on."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()
            if self.solid[-1] == len(self.stack):
                self.solid.pop()

    def innermost(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def close(self, name: str) -> None:
        depth = self.innermost((name,))
        if depth and (name not in WITHIN or depth > self.innermost(BARRIERS)):
            self.cut(depth)

    def make_room(self, name: str) -> None:
        """Close what ``name`` ends by starting."""
        if name in SIBLINGS:
            scope = self.innermost(SCOPES[name])
            ends = [d[i] for d in (self.depths.get(t, []) for t in SIBLINGS[name]) if (i := bisect_right(d, scope)) < len(d)]
            if ends:
                self.cut(min(ends))
        if name in ENDS_P and (depth := self.innermost(("p",))) > self.solid[-1]:
            self.cut(depth)


def parse(text: str) -> Element:
    """Elements and strings of a page; what is never closed is closed by what follows it."""
    page = OpenElements()
    at = 0
    size = len(text)
    while at < size:
        found = TAG.search(text, at)
        here = page.stack[-1]
        if found is None:
            here.children.append(text[at:])
            break
        if found.start() > at:
            here.children.append(text[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            page.close(name)
            continue
        page.make_room(name)
        here = page.stack[-1]
        element = Element(name, found[3], here)
        here.children.append(element)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else size
            continue
        page.push(element)
    return page.stack[0]


def walk(root: Element) -> list[Element]:
    """Elements in page order."""
    out, stack = [], [root]
    while stack:
        element = stack.pop()
        out.append(element)
        stack += [c for c in reversed(element.children) if isinstance(c, Element)]
    return out


def hash_subtrees(elements: list[Element]) -> None:
    for element in reversed(elements):
        state = hashlib.blake2b(digest_size=8)
        state.update(f"{element.tag}\x01{' '.join(element.attributes.split())}\x01".encode("utf-8", "surrogatepass"))
        holds, title = element.tag in CONTENT, element.tag == "h1"
        for child in element.children:
            if isinstance(child, Element):
                state.update(child.key.to_bytes(8, "little", signed=True))
                holds |= child.holds
                title |= child.title
            elif part := " ".join(child.split()):
                state.update(b"\x02" + part.encode("utf-8", "surrogatepass"))
        element.key = int.from_bytes(state.digest(), "little", signed=True)
        element.holds, element.title = holds, title


def measure(elements: list[Element]) -> None:
    """Characters of each subtree, those in links, form controls in it, and the content around it."""
    for element in reversed(elements):
        element.controls = element.tag in CONTROLS
        for child in element.children:
            if isinstance(child, Element):
                element.size += child.size
                element.linked += child.linked
                element.controls |= child.controls
            else:
                element.size += len(child.strip())
        if element.tag == "a":
            element.linked = element.size
    for element in elements:
        if up := element.parent:
            element.top = up.top or (up if up.tag in CONTENT else None)
            element.article = up.article or (up if up.tag == "article" else None)


def named(attributes: str) -> tuple[bool, list[str], list[str]]:
    """Whether role or visibility say that an element is not article, its classes and its ids."""
    out, classes, ids = False, [], []
    if not attributes.strip():
        return out, classes, ids
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "class":
            classes += value.split()
        elif name == "id":
            ids += value.split()
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            out = True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            out = True
    return out, classes, ids


def words_of(names: list[str]) -> set[str]:
    return {w for name in names for w in WORDS.split(name) if w}


def has_comments(element: Element) -> bool:
    """A comment among comments, or a block whose parts are comments."""
    if element.tag == "article":
        return True
    parts = [c for c in element.children if isinstance(c, Element)]
    parts += [c for part in parts if part.tag in ("ul", "ol") for c in part.children if isinstance(c, Element)]
    return any(c.tag == "article" or (c.tag in CONTAINERS or c.tag == "li") and words_of(sum(named(c.attributes)[1:], [])) & COMMENTS for c in parts)


def unwanted(element: Element) -> bool:
    """Whether names, inside an article together with structure, say that an element is not article."""
    out, classes, ids = named(element.attributes)
    if out:
        return True
    if element.top is None:
        return bool(words_of(classes + ids) & (NAMED | HEADER))
    if element.tag not in CONTAINERS and element.tag != "article":
        return False
    names = classes if element.tag == "section" else classes + ids  # ids of sections are made of their headings
    words = words_of(names)
    if not words & NAMED:
        return False
    if element.controls or 2 * element.linked > element.size:
        return True
    if words & COMMENTS and has_comments(element):
        return True
    if words & PLAIN and element.size <= SHORT:
        return True
    return 2 * element.size < element.top.size and any((w := words_of([n])) & PLAIN and w <= NAMED | FRAME for n in names)


def page_text(html: str | None, template: frozenset) -> str:
    root = parse(html or "")
    elements = walk(root)
    hash_subtrees(elements)
    measure(elements)
    dead: set[int] = set()
    for element in elements:
        if element.parent is not None and id(element.parent) in dead:
            dead.add(id(element))
            continue
        within = element.top is not None
        gone = element.tag in DROPPED or element.tag == "header" and not within
        if not gone and (not element.holds or element.tag == "article" and within):
            # a heading of the first rank is judged by its block's name only outside articles, in short blocks
            gone = not (element.title and (within or element.size > SHORT)) and unwanted(element)
        if not gone and element.key in template and not element.holds and element.tag not in ("", "html", "body"):
            gone = element.tag in CONTAINERS and not element.title if within else element.tag not in INLINE and element.tag != "br"
        if gone:
            dead.add(id(element))
    alive = [e for e in elements if id(e) not in dead]
    tops = [e for e in alive if e.tag == "article" and e.article is None]
    if tops and not any(e.tag == "h1" and e.article for e in alive):
        # the heading may stand before the article
        tops = [e for e in alive if e.article is None and (e.tag == "article" or e.tag == "h1" and e.top is not None)]
    tops = tops or [e for e in alive if e.tag == "main"] or [root]
    blocks: list[str] = []
    for top in tops:
        collect(top, dead, blocks)
    return " ".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def collect(top: Element, dead: set[int], blocks: list[str]) -> None:
    """Texts of the blocks below ``top``, in page order."""
    held: list[str] = []
    stack: list = [top]
    while stack:
        item = stack.pop()
        if item is None:
            blocks.append("".join(held))
            held.clear()
        elif isinstance(item, str):
            held.append(references.unescape(item) if "&" in item else item)
        elif id(item) not in dead:
            if item.tag == "br":
                held.append(" ")
                continue
            block = item.tag not in INLINE
            if block:
                stack.append(None)
            stack += reversed(item.children)
            if block:
                stack.append(None)
    blocks.append("".join(held))


def count_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, n): pages of the host with the subtree; key is null for the pages themselves."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        hosts, keys, n = [h for h, _ in seen], [k for _, k in seen], list(seen.values())
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["host", "key", "n"])

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            elements = walk(parse(html.as_py() or ""))
            hash_subtrees(elements)
            seen[host, None] += 1
            for key in {e.key for e in elements if e.tag and not e.holds and e.children and e.tag not in INLINE}:
                seen[host, key] += 1
            if len(seen) > 500_000:
                yield out()
    yield out()


def strip_templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple = (None, frozenset())
    for batch in batches:
        texts = []
        for html, keys in zip(batch.column("html"), batch.column("keys")):
            keys = keys.as_py()
            if keys != held[0]:
                held = keys, frozenset(keys or ())
            texts.append(page_text(html.as_py(), held[1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, keys) from (host, html): at most elements a page divided by ``least_share`` keys a host."""
    counts = pages.select("host", "html").mapInArrow(count_subtrees, "host string, key long, n long").groupBy("host", "key").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= least_pages)
    whole = often.where("key is null").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    some = often.where("key is not null").join(whole, F.col("host") == F.col("of")).where(F.col("n") >= least_share * F.col("pages"))
    return some.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page has an empty text; a null url is a host of its own.
    Repeated rows count as pages of their own. Other columns are not read. An
    empty table gives an empty result. An article that itself recurs is kept:
    no subtree with an article or a main part counts as template, and inside
    them only blocks without a heading of the first rank do.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host.alias("host"))
    found = templates(base, least_pages, least_share).select(F.col("host").alias("of"), "keys", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("lot"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(found, (F.col("host") == F.col("of")) & (F.col("salt") == F.col("lot")), "left")
    kind = base.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "keys").mapInArrow(strip_templates, f"page_id {kind}, url string, text string, n_chars long")
