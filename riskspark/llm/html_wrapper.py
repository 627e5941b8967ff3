"""Main text of web pages by wrappers: union-free regular expressions of a host's pages.

A page's tokens (element starts and ends, texts) are read as nested items. A wrapper is such a list of items in which
an item may also be optional or a repeated group, and a text is a constant or a slot. Page by page a host's wrapper is
aligned with the next page's items: equal items are merged, texts that differ become slots, items without a
partner become optional, and neighbours that repeat (alone, in runs, or beside a group of their kind) become
a repeated group. Alignment goes element by element, so groups are balanced. Tasks align their own pages first;
their wrappers (one per host and task) are merged ``FAN`` at a time, so a hot host is spread and no task holds pages of others.

The wrapper says which element holds the article: an ``article`` or ``main`` element, else the lowest one with
``SHARE`` of the host's text outside links; there, texts that never change while others do are template and go. What
lies in an element of another kind (``DROP_TAGS``, ``DROP_WORDS`` in class, id or role) is no article text.

Defined cases: null html is empty; an unclosed element ends with its parent or the page; markup nested deeper than ``DEPTH``
only separates blocks, its text stays; rows of equal page_id are pages of their own; a null url or one without
a host is the host ''; a page without text has an empty text; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import keep

DEPTH, WIDTH, FAN, SHARE, TEMPLATE_PAGES = 64, 48, 64, 0.8, 3

# HTML's element kinds, and the names that pages give to what is no article text
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rb rp rt rtc ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
        "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
#: an end that is implied does not reach beyond these
HOLDS = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "select", "td", "th"}
DROP_TAGS = set("head nav header footer aside form script style noscript template iframe object embed svg canvas audio video map button select option textarea input datalist dialog menu title".split())
DROP_WORDS = set("""ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos promotion
 nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar header masthead footer sidebar sidebars aside rail
 notice notices alert cookie cookies consent gdpr popup modal overlay disclaimer copyright newsletter subscribe subscription signup login
 comment comments commentlist disqus respond reply replies share sharing social related recommended widget widgets search complementary contentinfo dialog""".split())
#: with one of these a header is the article's own
ARTICLE_WORDS = {"article", "post", "entry", "story", "content"}
MAIN = re.compile(r"article(?![\w-])|main(?![\w-])|.*@(?:main|article|articlebody)\b")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _label(tag: str, attributes: str) -> str:
    """Tag with class, id and role; numbers in them are all alike."""
    if not attributes or "=" not in attributes:
        return tag
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    out = tag + "".join("." + c for c in found.get("class", "").split()) + ("#" + found["id"] if found.get("id") else "")
    out += "".join("@" + found[k].lower() for k in ("role", "itemprop") if found.get(k))
    return re.sub(r"\d+", "0", out)


_dropped: dict[str, bool] = {}


def dropped(label: str) -> bool:
    """The element is a menu, header, footer, sidebar, notice, advert, form, script, style or comment."""
    known = _dropped.get(label)
    if known is None:
        tag, *names = re.split(r"[.#@]", label)
        words = {w.lower() for n in names for w in _WORD.findall(n)}
        found = words & DROP_WORDS
        if found == {"header"} and words & ARTICLE_WORDS:
            found = set()
        known = tag in DROP_TAGS or bool(found) and tag not in ("html", "body", "main")
        if len(_dropped) > 100_000:
            _dropped.clear()
        _dropped[label] = known
    return known


# --- one page -----------------------------------------------------------------------------------

class Element:
    """An element of a page: its items are elements and (text, in a link) pairs, in order."""

    __slots__ = ("label", "tag", "items", "inline")

    def __init__(self, label: str, tag: str, inline: bool = False):
        self.label, self.tag, self.items, self.inline = label, tag, [], inline


def parse(source: str) -> Element:
    """Elements of a page; inline markup is left out unless it marks something to drop."""
    root = Element("#page", "#page")
    stack, links, at, size = [root], 0, 0, len(source)
    token = _TOKEN.match
    while at < size:
        m = token(source, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if not text.startswith(("<!", "<?")):
                stack[-1].items.append((text, links > 0))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            else:
                if tag not in INLINE or tag == "br":
                    stack[-1].items.append(Element("", ""))
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            inner, at = (source[at:end.start()], end.end()) if end else (source[at:], size)
            if tag not in DROP_TAGS:
                stack[-1].items.append((inner, False))
            continue
        if tag in INLINE:
            if tag == "br":
                stack[-1].items.append((" ", False))
            elif tag == "a" and not attributes.endswith("/"):
                links += 1
            if tag not in VOID and "=" in attributes and not attributes.endswith("/"):
                label = _label(tag, attributes)
                if label != tag and dropped(label):
                    new = Element(label, tag, True)
                    stack[-1].items.append(new)
                    stack.append(new)
            continue
        closes = ENDS.get(tag)
        if closes or tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i].tag
                if open_tag == "p" and tag in ENDS_P or closes and open_tag in closes:
                    del stack[i:]
                    if not closes or open_tag in closes:
                        break
                elif open_tag in HOLDS:
                    break
        links = 0 if tag in ENDS_P else links
        new = Element(_label(tag, attributes), tag)
        stack[-1].items.append(new)
        if tag not in VOID and len(stack) < DEPTH and not attributes.endswith("/"):
            stack.append(new)
    return root


def blocks(items: list, template: set[int] = frozenset()) -> Iterator[str]:
    """Texts of the blocks below, in page order, without what is dropped."""
    held: list[str] = []

    def walk(items: list) -> Iterator[str]:
        for x in items:
            if x.__class__ is tuple:
                held.append(html.unescape(x[0]))
            elif x.inline:
                if not dropped(x.label):
                    yield from walk(x.items)
            else:
                yield from flush()
                if not dropped(x.label):
                    yield from walk(x.items)
                    yield from flush()

    def flush() -> Iterator[str]:
        text = " ".join("".join(held).split())
        held.clear()
        if text and not (template and _digest(text) in template):
            yield text

    yield from walk(items)
    yield from flush()


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


# --- wrappers -----------------------------------------------------------------------------------
# An item is ["t", digest or None for a slot, characters outside links, in links, pages], ["e", label, items],
# ["?", item] or ["+", items].

def items_of(element: Element) -> list:
    """An element's content as wrapper items, repeats folded."""
    out, chars, linked, held = [], 0, 0, []

    def text():
        nonlocal chars, linked
        whole = " ".join(html.unescape("".join(held)).split())
        if whole:
            out.append(["t", _digest(whole), chars, linked, 1])
        chars = linked = 0
        held.clear()

    for x in element.items:
        if x.__class__ is tuple:
            held.append(x[0])
            n = len(x[0].strip())
            chars, linked = chars + n * (not x[1]), linked + n * x[1]
        elif not x.inline:
            text()
            if x.label:
                out.append(["e", x.label, [] if dropped(x.label) else items_of(x)])
    text()
    return fold(out)


def key(item: list) -> str:
    kind = item[0]
    if kind == "e":
        return item[1]
    if kind == "t":
        return "t"
    if kind == "?":
        return key(item[1])
    return key(item[1][0]) if len(item[1]) == 1 else "(" + " ".join(map(key, item[1])) + ")"


def merge(a: list, b: list) -> list:
    """Expression of two items of one key."""
    if a[0] == "?" or b[0] == "?":
        return ["?", merge(a[1] if a[0] == "?" else a, b[1] if b[0] == "?" else b)]
    if a[0] == "+" or b[0] == "+":
        x, y = (v[1] if v[0] == "+" else [v] for v in (a, b))
        return ["+", [merge(p, q) for p, q in zip(x, y)]]
    if a[0] == "t":
        return ["t", a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3], a[4] + b[4]]
    return ["e", a[1], align(a[2], b[2])]


def _group(items: list) -> list:
    """One repetition of a group, without the marks that the group's own repetition makes superfluous."""
    return [x[1][0] if x[0] == "+" and len(items) == 1 else x for x in items]


def _join(a: list, b: list) -> list:
    """Repeated group of two runs of equal keys."""
    both = [merge(p, q) for p, q in zip(a, b)]
    bare = [x[1] if x[0] == "?" and len(both) == 1 else x for x in both]
    return ["+", _group(bare)]


def fold(items: list) -> list:
    """Neighbouring repeats become repeated groups; a list that stays longer than ``WIDTH`` becomes one group in
    which each kind of item (kinds of one tag together, where there are too many) is optional."""
    changed = True
    while changed and len(items) > 1:
        changed = False
        out: list = []
        for x in items:
            if out and key(out[-1]) == key(x) and x[0] != "t":
                out[-1] = _join([out[-1]], [x]) if out[-1][0] != "+" or len(out[-1][1]) == 1 else merge(out[-1], x)
                changed = True
            else:
                out.append(x)
        items = out
        keys = [key(x) for x in items]
        n = len(items)
        for size in range(2, min(n // 2, WIDTH) + 1):
            at = next((i for i in range(n - 2 * size + 1) if keys[i:i + size] == keys[i + size:i + 2 * size]), None)
            if at is not None:
                items = items[:at] + [_join(items[at:at + size], items[at + size:at + 2 * size])] + items[at + 2 * size:]
                changed = True
                break
        else:
            for i, x in enumerate(items):  # a run beside a group of its kind is one more of the group
                inner = x[1] if x[0] == "+" else x[1][1] if x[0] == "?" and x[1][0] == "+" else None
                if inner and len(inner) > 1:
                    size, want = len(inner), [key(y) for y in inner]
                    if keys[i + 1:i + 1 + size] == want:
                        items = items[:i] + [_join(inner, items[i + 1:i + 1 + size])] + items[i + 1 + size:]
                    elif i >= size and keys[i - size:i] == want:
                        items = items[:i - size] + [_join(items[i - size:i], inner)] + items[i + 1:]
                    else:
                        continue
                    changed = True
                    break
    if len(items) > WIDTH:
        kinds: dict[str, list] = {}
        for x in _flat(items):
            kinds[key(x)] = merge(kinds[key(x)], x) if key(x) in kinds else x
        if len(kinds) > WIDTH:
            by_tag: dict[str, list] = {}
            for k, x in sorted(kinds.items()):
                if x[0] == "e":
                    x = ["e", re.split(r"[.#@]", x[1])[0], x[2]]
                by_tag[key(x)] = merge(by_tag[key(x)], x) if key(x) in by_tag else x
            kinds = by_tag
        items = [["+", [["?", kinds[k]] for k in sorted(kinds)]]]
    return items


def _flat(items: list) -> Iterator[list]:
    for x in items:
        if x[0] == "?":
            yield from _flat([x[1]])
        elif x[0] == "+":
            yield from _flat(x[1])
        else:
            yield x


def align(a: list, b: list) -> list:
    """Expression of two lists of items: the longest common subsequence of keys is merged, the rest is optional."""
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    if ka == kb:
        return [merge(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    common = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            common[i][j] = common[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(common[i + 1][j], common[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and ka[i] == kb[j]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and common[i + 1][j] >= common[i][j + 1]:
            out.append(a[i] if a[i][0] == "?" else ["?", a[i]])
            i += 1
        else:
            out.append(b[j] if b[j][0] == "?" else ["?", b[j]])
            j += 1
    return fold(out)


def render(items: list) -> str:
    """The wrapper as a regular expression over tags and texts; ``#`` is a text slot."""
    out = []
    for x in items:
        if x[0] == "t":
            out.append("#" if x[1] is None else "text")
        elif x[0] == "e":
            out.append(f"<{x[1]}> {render(x[2])} </{re.split('[.#@]', x[1])[0]}>" if x[2] else f"<{x[1]}/>")
        else:
            out.append(f"( {render([x[1]] if x[0] == '?' else x[1])} ){x[0]}")
    return " ".join(out)


# --- where the article is -----------------------------------------------------------------------

def _places(items: list) -> dict[tuple[str, ...], int]:
    """Characters outside links below each path of element labels, without what is dropped."""
    out: dict[tuple[str, ...], int] = {}

    def walk(items: list, path: tuple[str, ...]) -> int:
        total = 0
        for x in _flat(items):
            if x[0] == "t":
                total += x[2]
            elif not dropped(x[1]):
                total += walk(x[2], (*path, x[1]))
        out[path] = out.get(path, 0) + total
        return total

    walk(items, ())
    return out


def _constants(items: list, path: list[str]) -> list[int]:
    """Digests of the unchanging texts below ``path`` if other texts there change."""
    here = list(_flat(items))
    for label in path:
        here = [y for x in here if x[0] == "e" and x[1] == label for y in _flat(x[2])]
    texts = []
    while here:
        texts += [x for x in here if x[0] == "t"]
        here = [y for x in here if x[0] == "e" and not dropped(x[1]) for y in _flat(x[2])]
    if all(x[1] is not None for x in texts):
        return []
    return sorted({x[1] for x in texts if x[1] is not None and x[4] >= TEMPLATE_PAGES})


def rule(items: list) -> list:
    """[[path, constant texts]]: where the article stands, the best place first; the last one is on every page."""
    places = _places(items)
    marked = [p for p in places if p and MAIN.match(p[-1])]
    worth = {p: places[p] * (2 if p[-1].startswith("article") or "@article" in p[-1] else 1) for p in marked}
    out = [[list(p), []] for p in sorted(marked, key=lambda p: (-worth[p], -len(p), p))]
    path: tuple[str, ...] = ()
    while True:
        below = [p for p in places if len(p) == len(path) + 1 and p[:-1] == path and not re.match(r"p(?![\w-])", p[-1])]
        best = max(below, key=lambda p: (places[p], p), default=None)
        if best is None or places[best] < SHARE * places[path] or not places[best]:
            break
        path = best
    out.append([list(path), _constants(items, list(path))])
    return out + ([[[], []]] if path else [])


def _at(root: Element, path: list[str]) -> list[Element]:
    here = [root]
    for label in path:
        here = [x for e in here for x in e.items if x.__class__ is Element and x.label == label]
    return here


def article(source: str, places: list) -> str:
    """The page's text at the first place of its host's rule that has text here."""
    root = parse(source)
    for path, template in places:
        items = [x for e in _at(root, path) for x in (Element("", ""), *e.items, Element("", ""))]
        text = "\n".join(blocks(items, set(template))) if items else ""
        if text:
            return text
    return ""


# --- tables -------------------------------------------------------------------------------------

def _host(df: DataFrame) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _merged(host_items: dict, host: str, items: list, pages: int) -> None:
    known = host_items.get(host)
    host_items[host] = [align(known[0], items), known[1] + pages] if known else [items, pages]


def _rows(found: dict, part: int) -> pa.RecordBatch:
    return pa.record_batch({"host": pa.array(list(found), pa.string()), "part": pa.array([part] * len(found), pa.int64()),
                            "pages": pa.array([v[1] for v in found.values()], pa.int64()), "items": pa.array([json.dumps(v[0], separators=(",", ":")) for v in found.values()], pa.string())})


def _task_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, task, pages, items): each task's wrapper of each of its hosts."""
    part, found = TaskContext.get().partitionId(), {}
    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _merged(found, host, items_of(parse(source)), 1)
        if len(found) > 20_000:
            yield _rows(found, part)
            found = {}
    if found:
        yield _rows(found, part)


def _merge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, group, pages, items) come by host and group; one row of each group goes on."""
    now, found = None, {}
    for batch in batches:
        for host, part, pages, items in zip(*[c.to_pylist() for c in batch.columns]):
            if now != (host, part):
                if found:
                    yield _rows(found, now[1])
                now, found = (host, part), {}
            _merged(found, host, json.loads(items), pages)
    if found:
        yield _rows(found, now[1])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [json.loads(x) for x in batch.column(2).to_pylist()]
        yield pa.record_batch({"host": batch.column(0), "pages": batch.column(1), "wrapper": pa.array([render(x) for x in items], pa.string()),
                               "places": pa.array([json.dumps(rule(x)) for x in items], pa.string())})


_PART = "host string, part long, pages long, items string"


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper, places): one row per host; ``places`` is its rule as JSON."""
    rows = pages.select(_host(pages).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = keep(rows.mapInArrow(_task_wrappers, _PART), "wrappers")
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = found.agg(F.max("part")).first()[0]
    while most is not None:
        group = found.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        found = keep(group.repartition(tasks, "host", "part").sortWithinPartitions("host", "part", F.xxhash64("items"), "items")
                     .mapInArrow(_merge_groups, _PART), "wrappers")
        if most < FAN:
            break
        most //= FAN
    return keep(found.select("host", "pages", "items").mapInArrow(_finish, "host string, pages long, wrapper string, places string"), "wrappers")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules: dict[str, list] = {}
    for batch in batches:
        out = []
        for source, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if places not in rules:
                if len(rules) > 5000:
                    rules.clear()
                rules[places] = json.loads(places)
            out.append(article(source, rules[places]))
        yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(out, pa.string())})


def main_text(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, by the wrappers of its host."""
    found = wrappers(pages) if found is None else found
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _host(pages).alias("host"))
    met = rows.join(found.select("host", "places"), "host", "left").select("page_id", "url", "html", F.coalesce("places", F.lit("[[[], []]]")).alias("places"))
    return met.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


#: where the article is an ``article`` element of headings and paragraphs, and references are named ones of this list
SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer>|$)', 1), '<br>', ' '), '</?(p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             x, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(39|x27);', '''', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a),
c AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""
