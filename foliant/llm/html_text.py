"""Main text of web pages: element subtrees that recur on many pages of a host go, and so do those that are named as furniture.

Pages are parsed into flat lists of elements by a tolerant scan that reads each sign once. Every element's subtree has a hash of its tags and its text; Spark counts
them per host and deletes those that stand on at least MIN_PAGES pages, in and outside of articles, wherever their class names stay silent; a paragraph of an article that holds no other
element stays, however often it is quoted. A host of many pages asks for more,
in step with the root of its size (5 of 25 pages, 100 of 10,000), so that a section's menu goes on a hot host and a few copies of a page stay.
Furniture goes by tag, role, class and id, too, for hosts with few pages: by class names that are furniture words as a whole (sidebar, site-footer; not
page-with-sidebar or legal-analysis), never by one around an article or a heading of the first rank, nor, where a page has none of these, by one around most of its text (but for adverts and reader comments). Headers inside of an article or
main element are the article's own. Text is never judged by its words.

Where article or main elements hold half or more of what is left, they are the text; else all that is left is. Those elements themselves are never templates (copies of an article
are none), but what recurs inside of them is. A page of which all blocks recur is a copy itself, and keeps them.

Nulls: null html gives an empty text, and a null or odd url counts as one host. Ids may repeat or be null: rows are judged one by one, and of rows that repeat whole on a host one
counts. Empty tables give no rows. Long pages take time and memory in step with their length. Extra columns stay, whatever their names; one named text is replaced.
"""

from __future__ import annotations

import functools
import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, table, text_of
from .slices import replaced, sliced

MIN_PAGES, SHARE = 5, 0.2
# HTML's elements without content, of raw text, that end an open paragraph, that are no text of the article, that are never templates, and the words of class names and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
OFF = frozenset("script style noscript template iframe object embed svg math canvas audio video head title nav header footer aside form button select textarea input label menu dialog noembed noframes".split())
WHOLE = frozenset("# html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget widgets footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies respond disqus discussion related recommended recommendations pagination pager tags toolbar skip copyright legal".split())
NEVER = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter comment comments reply replies respond disqus discussion".split())
NEUTRAL = frozenset("a area bar block blocks body bottom box button buttons col column container content end first form global google group holder icon icons inner item items js last layer left line link links list main mobile module outer panel post posts primary right row secondary section site slot stories story sub text top unit user web wrap wrapper zone".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)|([^<]+|<)""", re.S)
_PLAIN = re.compile(r"""[^>"']*""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_QUOTED, _HIDDEN = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')"""), re.compile(r"(?:^|\s)hidden(?=[\s=/]|\Z)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v   -     　\x85]+")


def _named(token: str) -> frozenset[str]:
    """The furniture words of a class or id that has, beside them, neutral parts alone."""
    parts = {p.lower() for p in _PARTS.findall(token)}
    return frozenset(parts & WORDS) if parts & WORDS and parts <= WORDS | NEUTRAL else frozenset()


def _furniture(tag: str, attributes: str, own: bool) -> int:
    """0: none; 1: by its name; 2: by the name of what is never an article (adverts, notices of cookies, comments); 3: for sure. own: inside of an article or main element."""
    if tag in OFF and not (own and tag == "header"):
        return 1 if tag == "form" else 3
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    out = 3 if "hidden" in attributes and _HIDDEN.search(_QUOTED.sub("", attributes)) else 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.strip().lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return 3
        if name in ("class", "id"):
            for token in value.split():
                if words := _named(token):
                    out = max(out, 2 if words & NEVER else 1)
    return out


def _tag_end(page: str, at: int, last: dict[str, int]) -> tuple[int, int]:
    """Where the attributes that begin at a place end, and what comes after the tag. A quote that nothing closes is a sign like others; last: where each quote stands last."""
    start = at
    while True:
        at = _PLAIN.match(page, at).end()
        if at >= len(page):
            return at, at
        sign = page[at]
        if sign == ">":
            return at, at + 1
        # An attribute's quote stands after its sign of equality; others are signs like others, too.
        at = page.index(sign, at + 1) + 1 if at < last[sign] and page[start:at].rstrip()[-1:] == "=" else at + 1
        start = max(start, at - 1)


def parse(page: str) -> tuple[list, list]:
    """Elements [tag, furniture, first item, item after the last, parent] in the order of their starts, and items:
    a text, or None where a block begins or ends, each with the element that holds it."""
    elements, items = [["#", 0, 0, 0, -1]], []
    stack, places, blocks, owners = [0], {}, [], 0
    last = {q: page.rfind(q) for q in "\"'"}

    def close(upto: int):
        nonlocal owners
        while len(stack) > upto:
            e = elements[stack.pop()]
            places[e[0]].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            owners -= e[0] in ("article", "main")
            if e[0] in BLOCK:
                items.append((None, stack[-1]))
            e[3] = len(items)

    def latest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        end, start, text = m.groups()
        if text is not None:
            items.append((html.unescape(text), stack[-1]))
        elif end is not None:
            tag = end.lower()
            if tag == "br":
                items.append((" ", stack[-1]))
            if places.get(tag):
                close(places[tag][-1])
        elif start is not None:
            stop, after = _tag_end(page, at, last)
            attributes, at = page[at:stop], after
            tag = start.lower().rstrip("/")
            if tag == "br":
                items.append((" ", stack[-1]))
                continue
            if tag in BLOCK and tag not in ("html", "body"):
                if blocks and elements[stack[blocks[-1]]][0] == "p":  # a block ends the open paragraph, but for those outside of a container
                    close(blocks[-1])
                if ends := CLOSES.get(tag):
                    scope = latest(SCOPE[tag])
                    while (k := latest(ends)) > scope:
                        close(k)
            if tag in BLOCK or tag in ("img",):
                items.append((None, stack[-1]) if tag in BLOCK else ("", stack[-1]))
            if tag in VOID:
                continue
            elements.append([tag, _furniture(tag, attributes, owners > 0), len(items), 0, stack[-1]])
            if attributes.endswith("/") and tag in ("svg", "path", "use", "circle", "rect"):
                elements[-1][3] = len(items)
                continue
            if tag in BLOCK or tag == "button":
                blocks.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            owners += tag in ("article", "main")
            stack.append(len(elements) - 1)
            if tag in RAW:
                low = _raw_end(tag).search(page, at)
                stop = low.start() if low else n
                if stop > at:
                    items.append((page[at:stop], stack[-1]))
                at = stop
    close(1)
    elements[0][3] = len(items)
    _spare(elements, items)
    return elements, items


@functools.lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I)


def _spare(elements: list, items: list) -> None:
    """Named furniture around an article, a main element or a first heading isn't any; nor, on a page without these, is one with more than half of the text that is in no sure furniture."""
    size = [0] * len(elements)
    holds = [e[0] in ("article", "main", "h1") for e in elements]
    sure = [False] * len(elements)
    for i, e in enumerate(elements):
        sure[i] = e[1] == 3 or e[4] >= 0 and sure[e[4]]
    for text, e in items:
        if text and not sure[e]:
            size[e] += len(text) - text.count(" ")
    for i in range(len(elements) - 1, 0, -1):
        parent = elements[i][4]
        size[parent] += size[i]
        holds[parent] |= holds[i]
    for i, e in enumerate(elements):
        if e[1] in (1, 2) and (holds[i] or e[1] == 1 and not holds[0] and 2 * size[i] > size[0]):
            e[1] = 0


def _text_key(text: str | None) -> bytes:
    return b"\0" if text is None else _SPACE.sub(" ", text).strip().encode("utf-8", "replace")


def subtree_hashes(elements: list, items: list) -> list[int]:
    """A hash of the tags and texts below each element; elements without text have 0 and are never counted."""
    parts: list[list[bytes]] = [[e[0].encode()] for e in elements]
    full = [False] * len(elements)
    out = [0] * len(elements)
    by = [[] for _ in elements]
    for text, e in items:
        if text is not None and (key := _text_key(text)):
            by[e].append(key)
            full[e] = True
    for i in range(len(elements) - 1, -1, -1):
        children = parts[i][1:]
        digest = xxhash.xxh3_64_intdigest(b"\x01".join([parts[i][0], *by[i], b"\x02", *reversed(children)]))
        if full[i]:
            out[i] = digest - (1 << 64 if digest >> 63 else 0) or 1
        parent = elements[i][4]
        if parent >= 0:
            parts[parent].append(digest.to_bytes(8, "little"))
            full[parent] |= full[i]
    return out


def _own(elements: list) -> list[bool]:
    """Whether an element is an article or main element, or lies in one."""
    own = [False] * len(elements)
    for i, (tag, *_, parent) in enumerate(elements):
        own[i] = tag in ("article", "main") or parent >= 0 and own[parent]
    return own


def main_text(page: str, recurring: set[int] = frozenset()) -> str:
    """Blocks of the text that lies in no furniture and in no subtree of a recurring hash."""
    elements, items = parse(page)
    off, own = [False] * len(elements), _own(elements)
    for i, (_, furniture, _, _, parent) in enumerate(elements):
        off[i] = furniture > 0 or parent >= 0 and off[parent]
    gone = list(off)
    if recurring:
        hashes, parents = subtree_hashes(elements, items), {e[4] for e in elements}
        for i, (tag, _, _, _, parent) in enumerate(elements):
            lone = own[i] and tag == "p" and i not in parents  # a paragraph of the article, which others may quote
            gone[i] = off[i] or parent >= 0 and gone[parent] or hashes[i] in recurring and tag not in WHOLE and not lone
    for left in (gone, off):
        inside = _blocks(items, [a or not b for a, b in zip(left, own)])
        every = _blocks(items, left)
        if every:
            return inside if 2 * len(inside) >= len(every) else every
    return ""


def _blocks(items: list, off: list[bool]) -> str:
    blocks, now = [], []

    def flush():
        line = _SPACE.sub(" ", "".join(now)).strip(" ")
        if line:
            blocks.append(line)
        now.clear()

    for text, e in items:
        if text is None:
            flush()
        elif not off[e]:
            now.append(text)
    flush()
    return "\n\n".join(blocks)


def _hashes(batches):
    """(host, page, hash) of each subtree that a page holds, once. The hash 0 stands for the page itself."""
    for batch in sliced(batches, 2):
        hosts, pages, hashes = [], [], []
        for host, key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            elements, items = parse(page.as_py())
            off, own = [e[1] > 0 for e in elements], _own(elements)
            parents, found = {e[4] for e in elements}, {0}
            for i, (h, e) in enumerate(zip(subtree_hashes(elements, items), elements)):
                off[i] = off[i] or e[4] >= 0 and off[e[4]]
                lone = own[i] and e[0] == "p" and i not in parents
                if h and e[0] in BLOCK and e[0] not in WHOLE and not off[i] and not lone:  # furniture goes anyway
                    found.add(h)
            hosts += [host] * len(found)
            pages += [key] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, pages, hashes)], names=["host", "page", "hash"])


def _extract(batches):
    for batch in sliced(batches, -2):
        texts = [main_text(page.as_py(), frozenset(h.as_py() or ())) for page, h in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))]
        yield replaced(batch.select(batch.schema.names[:-2]), text=pa.array(texts, pa.string()))


def extract_main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """pages without the html and with text. share holds for a host of min_pages / share pages; for larger ones the count that a template needs
    grows with the root of the host's size. Hosts and pages go by 64-bit names; each page is sent the recurring hashes that it holds itself, and pages
    with equal html on one host share a row of them."""
    spark = pages.sparkSession
    stash = Stash(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    page = text_of(F.col(f"`{html_col}`"))
    rest = [c for c in pages.columns if c not in (html_col, "text")]
    src = pages.select(F.xxhash64(host).alias("__host"), F.xxhash64(host, page).alias("__page"), page.alias("__html"), *(F.col(f"`{c}`") for c in rest))
    held = stash(src.select("__host", "__page", "__html").mapInArrow(_hashes, "host long, page long, hash long"), "subtrees")
    # Pages that stand in several rows of a host count once; where there are none, nothing is dealt out for it.
    again = stash(held.where("hash = 0").groupBy("page").agg(F.count("*").alias("n")).where("n > 1").select("page"), "again")
    once = held
    if not again.isEmpty():
        once = held.join(again, "page", "left_anti").unionByName(held.join(again, "page", "left_semi").distinct().select(*held.columns))
    counts = once.groupBy("host", "hash").agg(F.count("*").alias("pages")).where(f"pages >= {int(min_pages)}")
    counts = stash(counts, "counts")
    total = counts.where("hash = 0").select("host", F.col("pages").alias("total"))
    often = counts.where("hash <> 0").join(total, "host").where(F.col("pages") >= F.sqrt(F.col("total") * F.lit(min_pages * share))).select("host", "hash")
    marks = once.join(often, ["host", "hash"]).groupBy(F.col("page").alias("__page")).agg(F.collect_set("hash").alias("__hashes"))
    found = src.join(marks, "__page", "left").select(*(F.col(f"`{c}`") for c in rest), "__html", "__hashes")
    schema = found.drop("__html", "__hashes").withColumn("text", F.lit("").cast("string")).schema
    return found.mapInArrow(_extract, schema)


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
