"""HTML extraction: the main text of a page, after the site's template is taken out.

A page is parsed once into elements, each subtree with two hashes: one of its tags and text, and one of its place and
shape (names of elements, classes and ids on the way to it and in it, with runs of like children as one, without text).
Spark counts for each host the pages that have a subtree, and two kinds are the site's template and are deleted first:

* subtrees of one text on at least MANY_PAGES pages and a share of the host's pages, in at least MANY_PAGES different
  surroundings;
* places: containers of one shape at one place, on at least FEW_PAGES different pages and half of the host's pages (of
  large hosts, MANY_PAGES and the share), that hold at most LITTLE_TEXT of all text of the pages that have them. So a
  menu, an advert or a footer is found whose words differ from page to page.

What the markup itself names as no main text goes next, for what recurrence cannot see: navigation, footers, asides, forms,
scripts, styles, and containers named as adverts, notices, comments and the like. The main text is in the page's articles,
else in its main element, else in what is left of the body. Inside of articles and main elements, running text
(paragraphs, headings, list items, quotations) is never deleted for recurring, nor is anything for its shape; on pages with
neither, the same holds for the element that most of the text is in. Copies of an article are no template: the
surroundings of a subtree are its whole article, main element or page, and those of a copy's parts are all the same. A
container that holds all of a page's articles, or mains where it has none, stays.

Counts are added up per batch before they are shuffled, and the template's hashes reach the pages by a broadcast of a
checked size, or else by joins on the page, so that a host with a third of all pages makes no large task.

Defined results: null or empty html, or html without main text, gives an empty text; broken markup is read as browsers
mostly do (implied ends, a tag that the page's end cuts off is dropped). A null url has the host "". Repeated rows are
repeated, and equal pages of one host get equal texts. Very long pages are parsed whole, one at a time. An empty table
gives an empty table. Only id, url and html are read, so extra columns cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import bounded_batches, cut, sliced

MANY_PAGES, SHARE_OF_HOST = 10, 0.01
#: For places: different pages at least, and the share of the pages' text in them at most.
FEW_PAGES, LITTLE_TEXT = 3, 0.2
#: Hashes that are broadcast at most (8 bytes each).
BROADCAST_MOST = 500_000
#: Subtrees that a task counts before it hands them on.
KEYS_HELD = 100_000
# HTML's element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|iframe|textarea|title"
#: Elements whose content is no text. One without an end tag ends with its parent or where a block begins.
SHUT = frozenset("head template svg math object select canvas audio video button".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NO_TEXT = frozenset("nav footer aside form menu dialog fieldset dir".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr tbody thead tfoot figcaption caption summary address".split())
NAMED_TAGS = BLOCKS | {"span", "a"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = SHUT | frozenset("table ul ol dl div section article main body html td th blockquote aside nav form".split())
#: Words of a class, id or role that name no main text.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|paywall"
    r"|nav\w*|menu\w*|breadcrumbs?|pagination|pager|sidebar|side|rail|footer|foot|masthead|topbar|toolbar|site-header|page-header|header|share|sharing|social|related|recommend\w*|teasers?|widget"
    r"|comments?|commentlist|replies|reply|respond|disqus|discussion|login|search|complementary|contentinfo|navigation|skip)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?)(?:</(?P=raw)\s*>|(?=<body[\s>])|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
SHUT_START = re.compile(rf"<(?:{'|'.join(sorted(SHUT - {'head'}))})[\s/>]", re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
NUMBER = re.compile(r"[0-9]+")
HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Element:
    __slots__ = ("bad", "digest", "names", "paragraph", "parent", "parts", "path", "shape", "size", "tag")

    def __init__(self, tag: str, parent: Element | None, bad: bool, names: str = ""):
        self.tag, self.parent, self.bad, self.parts, self.digest = tag, parent, bad, [], 0
        # for a subtree's place: names of class, id and role; hashes of the way to it and of its blocks; characters of text
        self.names, self.path, self.shape, self.size = names, 0, 0, 0
        # the open paragraph that a block would end
        self.paragraph = self if tag == "p" else None if parent is None or tag in SCOPES else parent.paragraph


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def ended_starts(page: str) -> set[int]:
    """Where the elements of SHUT begin that have an end tag."""
    if not SHUT_START.search(page):
        return set()
    ended: set[int] = set()
    starts: dict[str, list[int]] = {t: [] for t in SHUT}
    for m in TOKEN.finditer(page):
        if m["tag"] and (held := starts.get(m["tag"].lower())) is not None:
            if not m["end"]:
                if not m["attributes"].endswith("/"):
                    held.append(m.start())
            elif held:
                ended.add(held.pop())
    return ended


def parse(page: str) -> Element:
    """The page's tree; parts of an element are its texts and elements in order."""
    root = here = Element("", None, False)
    at = 0
    ended = ended_starts(page)
    cut: list[Element] = []  # open elements of SHUT without an end tag
    opened: Counter = Counter()  # open elements by tag, so that an end without a start costs nothing

    def leave(to: Element) -> Element:
        x = here
        while x is not to:
            opened[x.tag] -= 1
            if cut and cut[-1] is x:
                cut.pop()
            x = x.parent
        return to

    for m in TOKEN.finditer(page):
        if m.start() > at:
            if here.tag == "head" and not page[at : m.start()].isspace():
                here = leave(here.parent)
            here.parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            x = here if opened[tag] else None
            while x is not None and x.tag != tag:
                # an inline end does not close a block
                x = None if x.tag in BLOCKS and tag not in BLOCKS and tag not in SHUT else x.parent
            if x is not None and x.parent is not None:
                here = leave(x.parent)
            continue
        if here.tag == "head" and tag not in IN_HEAD:  # the first element of the body
            here = leave(here.parent)
        if tag in ("html", "body"):
            continue
        if tag == "br" or tag == "wbr":
            here.parts.append("\n" if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                here.parts.append(Element("hr", here, False))
            continue
        if tag in BLOCKS:
            if cut and tag not in ("option", "optgroup", "legend"):
                here = leave(cut[0].parent)
            if here.paragraph is not None:  # a block ends an open paragraph
                here = leave(here.paragraph.parent)
            if any(opened[t] for t in CLOSES.get(tag, ())):
                x = here
                while x is not None and (x.tag not in SCOPES or x.tag in CLOSES[tag]):
                    up = x.parent
                    if x.tag in CLOSES[tag]:
                        here = leave(up)
                        if tag not in ("tr", "tbody", "tfoot"):
                            break
                    x = up
        attributes = m["attributes"]
        if tag in SHUT:  # not among its parent's parts
            if not attributes.endswith("/"):
                if tag in ("button", "select") and cut and any(x.tag == tag for x in cut):
                    here = leave(next(x for x in cut if x.tag == tag).parent)
                here = Element(tag, here, True)
                opened[tag] += 1
                if tag != "head" and m.start() not in ended:
                    cut.append(here)
            continue
        bad, names = tag in NO_TEXT, ""
        if attributes and tag not in ("article", "main"):
            named = [a or b or c for a, b, c in NAMED.findall(attributes)]
            bad = bad or any(map(NAMES.search, named)) and tag in NAMED_TAGS or bool(HIDDEN.search(attributes))
            names = NUMBER.sub("#", " ".join(named).lower())
        new = Element(tag, here, bad, names)
        here.parts.append(new)
        if not attributes.endswith("/") or tag in BLOCKS:
            here = new
            opened[tag] += 1
    if at < len(page):
        if here.tag == "head" and not page[at:].isspace():
            here = leave(here.parent)
        here.parts.append(page[at:])
    return root


@lru_cache(1 << 16)
def place_hash(*parts) -> int:
    """A hash of names and hashes, kept: sites repeat them."""
    return int.from_bytes(blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def hashed(root: Element) -> list[Element]:
    """All elements with text, in page order, each with the hashes of its subtree and its size; the root comes first."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        for p in reversed(x.parts):
            if p.__class__ is Element:
                p.path = place_hash(x.path, p.tag, p.names) if p.tag in BLOCKS else x.path
                todo.append(p)
    found = []
    for x in reversed(order):
        h, full, size, blocks = blake2b(x.tag.encode(), digest_size=8), False, 0, []
        for p in x.parts:
            if p.__class__ is Element:
                if p.digest:
                    h.update(b"\1" + p.digest.to_bytes(8, "little"))
                    full = True
                    size += p.size
                    if p.tag in BLOCKS and (not blocks or blocks[-1] != p.shape):
                        blocks.append(p.shape)
            elif words := p.split():
                text = " ".join(words)
                h.update(b"\2" + text.encode("utf-8", "surrogatepass"))
                full = True
                size += len(text)
        x.digest = int.from_bytes(h.digest(), "little") | 1 if full else 0
        if full:
            x.size = size
            x.shape = place_hash(x.tag, x.names, *blocks)
            found.append(x)
    return found[::-1]


def candidate(x: Element, main: bool) -> bool:
    """Whether a recurring subtree may be deleted: any block outside of main text, only containers within it."""
    return x.tag in BLOCKS and x.tag not in ("article", "main") and not (main and x.tag in RUNNING)


def key_of(host: str, digest: int) -> int:
    """A 64-bit key of a host's subtree, signed."""
    return int.from_bytes(blake2b(host.encode() + digest.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)


def page_key(host: str) -> int:
    """The key under which a host's pages are counted."""
    return key_of(host, 0)


def places(root: Element) -> list[tuple[Element, Element]]:
    """Elements with text, each with what it lies in: the outermost article, else the outermost main element, else the root."""
    scopes: dict[int, Element] = {}
    out = []
    for x in hashed(root):
        scope = root if x.parent is None else scopes[id(x.parent)]
        if x.tag == "article" and scope.tag != "article" or x.tag == "main" and scope is root:
            scope = x
        scopes[id(x)] = scope
        out.append((x, scope))
    return out


def holders(found: list[tuple[Element, Element]]) -> set[int]:
    """The elements that hold all of the page's articles, or mains where it has none."""
    bad: set[int] = set()
    tops: dict[str, list[Element]] = {"article": [], "main": []}
    for x, scope in found:
        if x.bad or (x.parent is not None and id(x.parent) in bad):
            bad.add(id(x))
        elif x is scope and x.tag in tops:
            tops[x.tag].append(x)
    chosen = tops["article"] or tops["main"]
    held: Counter = Counter()
    for x in chosen:
        while (x := x.parent) is not None:
            held[id(x)] += 1
    return {k for k, n in held.items() if n == len(chosen)}


def bearers(root: Element) -> list[Element]:
    """The elements from the root's on that hold most of the page's text each, outermost first."""
    out, x = [], root
    while x is not None:
        x = next((p for p in x.parts if p.__class__ is Element and 2 * p.size > root.size), None)
        if x is not None:
            out.append(x)
    return out


def at_places(root: Element, found: list[tuple[Element, Element]]) -> Iterator[Element]:
    """Containers outside of articles and main elements; on pages that have neither, outside of the last block that bears the text."""
    plain = all(scope is root for _, scope in found)
    last = next((x for x in reversed(bearers(root)) if x.tag in BLOCKS and x.tag not in RUNNING), None) if plain else None
    inside: set[int] = set()
    for x, scope in found:
        if x.parent is not None and (x.parent is last or id(x.parent) in inside):
            inside.add(id(x))
        elif scope is root and candidate(x, True):
            yield x


def place_key(host: str, x: Element) -> int:
    return key_of(host, place_hash(x.path, x.shape))


def subtree_keys(page: str, host: str) -> tuple[dict[int, int], dict[int, int], Element]:
    """The keys of a page's subtrees that may be template, each with the hash of what it lies in; those of places, each with its characters; the page."""
    root = parse(page)
    found = places(root)
    own: dict[int, int] = {}
    for x in at_places(root, found):
        k = place_key(host, x)
        own[k] = own.get(k, 0) + x.size
    return {key_of(host, x.digest): scope.digest for x, scope in found if candidate(x, scope.parent is not None)}, own, root


def main_text(page: str, host: str, template, markup: bool = True) -> str:
    """The main text; template: the keys of the host's recurring subtrees and places, or anything with `in`.

    Without `markup` nothing is deleted or chosen for what the markup says: the text is the page without its template.
    """
    root = parse(page)
    gone: set[int] = set()
    roots: dict[str, list[Element]] = {"article": [], "main": []}
    covered: set[int] = set()
    found = places(root)
    holding = holders(found)
    held_text = {id(x) for x in bearers(root)} | holding
    placed = {id(x) for x in at_places(root, found) if id(x) not in held_text and place_key(host, x) in template}
    for x, scope in found:
        if x.parent is not None and id(x.parent) in gone:
            gone.add(id(x))
        elif id(x) in placed or id(x) not in holding and candidate(x, scope.parent is not None) and key_of(host, x.digest) in template:
            gone.add(id(x))
        elif markup and x.bad:
            gone.add(id(x))
        elif x.tag in roots:
            if x.parent is None or id(x.parent) not in covered:
                roots[x.tag].append(x)
        if x.tag == "article" or (x.parent is not None and id(x.parent) in covered):
            covered.add(id(x))
    chosen = markup and (roots["article"] or roots["main"]) or [root]
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    for top in chosen:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif x.__class__ is str:
                held.append(x)
            elif id(x) not in gone:
                if x.tag in BLOCKS or x.parent is None:
                    end()
                    todo.append(None)
                todo.extend(reversed(x.parts))
        end()
    return "\n\n".join(blocks)


def _rows(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    return bounded_batches(pages).select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))


def _counts(rows: DataFrame, many: int) -> DataFrame:
    """Keys counted per run of pages, a row for each of a key's first `many` contexts, with the pages, the characters in a place and those of its pages in one of them; host: the key that counts the host's pages."""
    names = ["subtree", "context", "pages", "chars", "around", "host"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}  # [pages, chars, around, host, contexts]

        def counted() -> pa.RecordBatch:
            out: list[list] = [[] for _ in names]
            for k, (pages, chars, around, host, contexts) in seen.items():
                for i, c in enumerate(contexts):
                    for column, value in zip(out, (k, c, 0 if i else pages, 0 if i else chars, 0 if i else around, host)):
                        column.append(value)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

        def add(k: int, chars: int, around: int, host: int | None, context: int) -> None:
            e = seen.get(k)
            if e is None:
                e = seen[k] = [0, 0, 0, host, {context}]
            elif len(e[4]) < many:
                e[4].add(context)
            e[0] += 1
            e[1] += chars
            e[2] += around

        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                total = page_key(host)
                subtrees, own, root = subtree_keys(page or "", host)
                add(total, 0, 0, None, 0)
                for k, context in subtrees.items():
                    add(k, 0, 0, total, context >> 1)  # signed
                for k, chars in own.items():
                    add(k, chars, root.size, total, root.digest >> 1)
            if len(seen) > KEYS_HELD:
                yield counted()
        if seen:
            yield counted()

    return rows.select("url", "html").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def template_keys(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", many: int = MANY_PAGES, share: float = SHARE_OF_HOST, few: int = FEW_PAGES, little: float = LITTLE_TEXT) -> DataFrame:
    """(subtree) keys of the subtrees and places that recur on many pages of their host, in many surroundings."""
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "around")]
    # one shuffle serves both counts
    found = _counts(_rows(pages, key, url, html), many).repartition("subtree").groupBy("subtree", "host", "context").agg(*sums)
    text = (F.col("around") == 0) & (F.col("pages") >= many) & (F.col("contexts") >= many)
    place = (F.col("around") > 0) & (F.col("contexts") >= few) & (F.col("chars") <= little * F.col("around"))
    counts = cut(found.groupBy("subtree", "host").agg(*sums, F.count("*").alias("contexts")).where(text | place | F.col("host").isNull()).select("subtree", "host", "pages", "around"), "subtrees")
    hosts = counts.where("host is null").select(F.col("subtree").alias("host"), F.col("pages").alias("of_host"))
    often = (F.col("around") == 0) | (F.col("pages") >= F.least(F.col("of_host") / 2, F.lit(many)))
    return counts.where("host is not null").join(hosts, "host").where((F.col("pages") >= F.col("of_host") * share) & often).select("subtree")


class _Sorted:
    """Membership in a sorted array."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def __contains__(self, k: int) -> bool:
        i = int(np.searchsorted(self.keys, k))
        return i < len(self.keys) and self.keys[i] == k


def _extracted(rows: DataFrame, template, markup: bool) -> DataFrame:
    kind = rows.schema["key"].dataType.simpleString()
    with_keys = "subtrees" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = _Sorted(template.value) if template is not None else ()
        for batch in batches:
            for part in sliced(batch, "html"):
                own = part.column(3).to_pylist() if with_keys else [None] * part.num_rows
                texts = [main_text(p or "", host_of(u), set(k) if k else common, markup) for u, p, k in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), own)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"key {kind}, url string, text string, n_chars long")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", many: int = MANY_PAGES, share: float = SHARE_OF_HOST, broadcast_most: int = BROADCAST_MOST, markup: bool = True) -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    rows = _rows(pages, key, url, html)
    template = template_keys(pages, key, url, html, many, share)
    found = template.limit(broadcast_most + 1).collect()  # bounded: beyond it, the join below
    if len(found) <= broadcast_most:
        keys = np.sort(np.array([r.subtree for r in found], np.int64))
        return _extracted(rows, pages.sparkSession.sparkContext.broadcast(keys), markup).withColumnRenamed("key", key)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, (url, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                subtrees, own, _ = subtree_keys(page or "", host_of(url))
                ids += [i] * (len(subtrees) + len(own))
                keys += [*subtrees, *own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, pa.int64())], names=["key", "subtree"])

    kind = rows.schema["key"].dataType.simpleString()
    own = rows.mapInArrow(subtrees, f"key {kind}, subtree long").join(template, "subtree").groupBy("key").agg(F.collect_set("subtree").alias("subtrees"))
    other = own.withColumnRenamed("key", "of")
    return _extracted(rows.join(other, rows.key.eqNullSafe(other.of), "left").select("key", "url", "html", "subtrees"), None, markup).withColumnRenamed("key", key)
