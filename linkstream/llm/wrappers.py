"""HTML extraction by union-free wrapper inference.

A page is a stream of text slots, each named by the containers around it and
the block it stands in.  The streams of a host are aligned one after another:
equal texts at slots of the same name meet first, and between them slots meet
by name, where repeats fold into repeated groups.  What matches stays, what does
not becomes an optional group, and a position whose text differs between pages
is a text slot while one that never differs is fixed text.  The result
is a union-free regular expression over slots, the host's *wrapper*.

Slots are then judged once for the host: those inside menus, headers, footers,
sidebars, notices, adverts, forms and comments go (an article's own header and
an article inside an article, which is a reader comment, are told apart by
nesting).  Where only a class, id or role tells that, it must say so as a whole,
or name a thing that is never text, and leave the page some text.

The rest is decided by position: each page's stream is matched against the
wrapper, whose required fixed texts are template, while text slots and repeated
groups are content.  A page that marks its article loses the containers inside
it that hold template alone (share bars, notices, whatever they are called) and
those that hold links alone; fixed texts among its other blocks are its own.
Another page loses all fixed texts, and slots that are link lists.

Wrappers are merged inside each task first, then in two rounds by host, one
wrapper in memory at a time, so no host's pages ever meet in one task.
"""

from __future__ import annotations

import functools
import html as _html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstream.llm.urlfilter import host_of

#: Wrappers that a task holds before it sends them on.
HELD_HOSTS = 2_000
#: First-round groups of a host.
SALTS = 32
#: Wrapper judgements up to this size are broadcast; beyond it they are joined.
MAX_BROADCAST_BYTES = 8 << 20
#: Different pages that a fixed text needs to be template.
MIN_PAGES = 3
#: Share of its characters in links from which a container inside an article is no text.
LINK_SHARE = 0.9

# How elements take part.
SKIPPED = frozenset("script style noscript template svg math head textarea select iframe object canvas audio video".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form fieldset ul ol dl menu table thead tbody "
                       "tfoot tr blockquote figure details dialog search".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre address figcaption caption summary legend hr option title".split())
NOT_MAIN = frozenset("nav header footer aside form fieldset menu dialog search".split())
NOT_MAIN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert sidebar rail widget menu nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer colophon "
    "copyright comment comments disqus discussion reply replies responses related recommended share sharing social subscribe "
    "newsletter popup modal overlay pagination pager search login signup contentinfo complementary".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
#: Skipped elements whose content is raw text up to their closing tag.
RAW = frozenset("script style noscript textarea iframe title".split())
#: What may stand in a head, and in a select; anything else ends it.
IN_HEAD = frozenset("title base basefont bgsound link meta style script noscript template".split())
IN_SELECT = frozenset("option optgroup hr legend div button script template".split())
FOREIGN = frozenset(["svg", "math"])
#: Elements of svg and math that hold HTML or a text of their own.
FOREIGN_HTML = frozenset("foreignobject desc title annotation-xml".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
_LAYOUT = re.compile("<(?=/?(?:" + "|".join(sorted((CONTAINERS | BLOCKS) - {"title"})) + r")(?=[\s/>]))", re.I)
#: Words of things that are never article text, whatever stands beside them in a name; but for names of a state.
STRONG_WORDS = frozenset("comment comments disqus cookie cookies gdpr newsletter advert adverts advertisement advertising sponsor sponsored "
                         "share sharing breadcrumb breadcrumbs pagination promo related recommended".split())
STATE_WORDS = frozenset("open closed enabled disabled on off no has with without is not allowed content".split())
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Parts of a class name; those with a digit are made up for one page, and say nothing.
_WORD = re.compile(r"(?<![a-z0-9])[a-z]+(?![a-z0-9])")
#: Words beside those of NOT_MAIN_WORDS that leave a class name's meaning as it is.
NEUTRAL_WORDS = frozenset("site page top bottom left right primary secondary main global sticky box bar block area section list "
                          "wrapper wrap container inner outer item items form link links btn button posts articles stories".split())
#: Elements that no word excludes.
NEVER_BY_WORD = frozenset("html body main article".split())
#: Between the lists of main slots of a wrapper.
_GROUP = "\x1e"


def _name(tag: str, attributes: str, never: bool) -> str:
    """tag.words, or tag!words where a class, id or role excludes."""
    words: set[str] = set()
    for m in _NAMED.findall(attributes):
        for token in "".join(m).lower().split():
            of = _WORD.findall(token)
            whole = not NOT_MAIN_WORDS.isdisjoint(of) and NOT_MAIN_WORDS.union(NEUTRAL_WORDS).issuperset(of)
            strong = not STRONG_WORDS.isdisjoint(of) and STATE_WORDS.isdisjoint(of)
            if not never and (whole or strong):
                return tag + "!" + ".".join(of)
            words.update(of)
    return ".".join([tag, *sorted(words)])


def _tag_of(name: str) -> str:
    return re.split("[.!]", name, maxsplit=1)[0]


def _skipped(page: str, tag: str, at: int) -> int:
    """Where a skipped element whose opening tag ends at ``at`` ends.

    Raw text ends at the element's closing tag or, if there is none, at the
    next layout tag.  svg, math and select also end at a tag that cannot stand
    in them.  Another element without its closing tag is read as empty.
    """
    if tag in RAW:
        if m := _RAW_END[tag].search(page, at):
            return m.end()
        m = _LAYOUT.search(page, at)
        return m.start() if m else len(page)
    depth, html, here = 1, 0, at
    while m := _TAG.search(page, here):
        here = m.end()
        inner, closing = (m[2] or "").lower(), bool(m[1])
        if inner == tag:
            depth += -1 if closing else not m[3].rstrip().endswith("/")
            if not depth:
                return here
        elif inner in RAW and not closing and not (tag in FOREIGN and m[3].rstrip().endswith("/")):
            if end := _RAW_END[inner].search(page, here):
                here = end.end()
        elif tag in FOREIGN and inner in FOREIGN_HTML:
            html = max(0, html + (-1 if closing else not m[3].rstrip().endswith("/")))
        elif tag in FOREIGN and not html and (inner in CONTAINERS or inner in BLOCKS):
            return m.start()
        elif tag == "select" and inner not in IN_SELECT and (inner in CONTAINERS or inner in BLOCKS or inner == "input"):
            return m.start()
    return len(page) if tag == "select" else at


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(slot, text, characters inside links) of each block with text, in page order."""
    return [b[:3] for b in placed_blocks(page)]


def placed_blocks(page: str) -> list[tuple[str, str, int, int]]:
    """``blocks`` with the number of the container that each stands in."""
    out: list[tuple[str, str, int, int]] = []
    stack: list[str] = []
    numbers, opened = [0], 0
    leaf, pieces, linked, in_link, at, in_head = "", [], 0, 0, 0, False
    ends = {t: page.lower().rfind("</" + t) for t in SKIPPED - RAW - FOREIGN - {"head", "select"}}

    def end_block():
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(("/".join(stack) + ">" + leaf, text, linked, numbers[-1]))
        pieces, linked = [], 0

    while m := _TAG.search(page, at):
        if m.start() > at:
            in_head = in_head and not page[at:m.start()].strip()  # text ends a head
            if not in_head:
                text = _html.unescape(page[at:m.start()])
                pieces.append(text)
                if in_link:
                    linked += len(text)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if in_head and tag not in IN_HEAD and tag != "head":
            in_head = False
        if tag == "head":
            in_head = not closing
        elif tag in SKIPPED or in_head and tag == "title":
            if not closing and not m[3].rstrip().endswith("/") and ends.get(tag, at) >= at:
                at = _skipped(page, tag, at)
        elif tag in CONTAINERS:
            end_block()
            leaf = ""
            if not closing:
                # no word excludes the whole page, nor the outermost article
                never = tag in NEVER_BY_WORD and not (tag == "article" and any(_tag_of(x) == "article" for x in stack))
                stack.append(_name(tag, m[3], never))
                opened += 1
                numbers.append(opened)
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if _tag_of(stack[i]) == tag:
                        del stack[i:], numbers[i + 1:]
                        break
        elif tag in BLOCKS:
            end_block()
            leaf = "" if closing else _name(tag, m[3], False)
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
    if at < len(page):
        pieces.append(_html.unescape(page[at:]))
    end_block()
    return out


# ---- wrappers: [items, slots, marks of different pages]; item = [name or list of items, repeated, optional];
# ---- slots: name -> [pages, characters, characters in links, text mark or None]

class Item(list):
    """[name or list of items, repeated, optional], and the mark of its fixed
    text (None: a text slot or a group)."""
    __slots__ = ("mark",)

    def __init__(self, body, rep: bool, opt: bool, mark: int | None = None):
        super().__init__((body, rep, opt))
        self.mark = mark


def _same(item) -> object:
    """What alignment compares: the item without its marks."""
    body = item[0]
    return body if isinstance(body, str) else tuple(_same(x) for x in body)


def _exact(item) -> object:
    body = item[0]
    return (body, item.mark) if isinstance(body, str) else tuple(_exact(x) for x in body)


def _gaps(items: list, same) -> list[int]:
    """Distances between an item and the next one like it: the sizes that a repeat can have."""
    last: dict = {}
    out = set()
    for i, item in enumerate(items):
        key = same(item)
        if key in last:
            out.add(i - last[key])
        last[key] = i
    return sorted(out)


def fold(items: list, same=_same) -> list:
    """Repeats of any number of items in a row become one repeated group, short ones first."""
    done = 0
    while size := next((g for g in _gaps(items, same) if g > done), 0):
        done = size
        out: list = []
        keys: list = []  # of out

        def add(item):
            out.append(item)
            keys.append(same(item))

        for item in items:
            add(item)
            while len(out) >= 2 * size and keys[-2 * size:-size] == keys[-size:]:
                last = [_merged(a, b) for a, b in zip(out[-2 * size:-size], out[-size:])]
                del out[-2 * size:], keys[-2 * size:]
                if size == 1:
                    add(Item(last[0][0], True, last[0][2], last[0].mark))
                else:
                    add(Item(last, True, False))
                    break
            # a group that comes again joins the repeated group before it
            if size > 1 and len(out) > size and out[-size - 1][1] and not isinstance(out[-size - 1][0], str) \
                    and keys[-size - 1] == tuple(keys[-size:]):
                group = out[-size - 1]
                group[0] = [_merged(a, b) for a, b in zip(group[0], out[-size:])]
                del out[-size:], keys[-size:]
        items = out
    return items


def _merged(a, b):
    body = a[0] if isinstance(a[0], str) else [_merged(x, y) for x, y in zip(a[0], b[0])]
    return Item(body, a[1] or b[1], a[2] or b[2], a.mark if a.mark == b.mark else None)


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions with the same name and fixed text, in both orders:
    the longest rising run of equal occurrences."""
    def numbered(items):
        seen: dict = {}
        for i, item in enumerate(items):
            if isinstance(item[0], str) and item.mark is not None:
                key = item[0], item.mark
                seen[key] = seen.get(key, -1) + 1
                yield (*key, seen[key]), i

    places = dict(numbered(b))
    pairs = [(i, places[k]) for k, i in numbered(a) if k in places]
    ends: list[int] = []  # least end of a run of each length
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before.append(last[at - 1] if at else -1)
        ends[at:at + 1], last[at:at + 1] = [j], [n]
    run, n = [], last[-1] if last else -1
    while n >= 0:
        run.append(pairs[n])
        n = before[n]
    return run[::-1]


def _align_names(a: list, b: list) -> list:
    """Matches by name merged, mismatches optional."""
    a, b = fold(a), fold(b)
    ka, kb = [_same(x) for x in a], [_same(x) for x in b]
    if ka == kb:
        return [_merged(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for x, y, n in SequenceMatcher(None, ka, kb, autojunk=False).get_matching_blocks():
        out += [Item(p[0], p[1], True, p.mark) for p in (*a[i:x], *b[j:y])]
        out += [_merged(p, q) for p, q in zip(a[x:x + n], b[y:y + n])]
        i, j = x + n, y + n
    return fold(out)


def align(a: list, b: list) -> list:
    """One stream that both fit."""
    out, i, j = [], 0, 0
    for x, y in [*_anchors(a, b), (len(a), len(b))]:
        if i < x or j < y:
            out += _align_names(a[i:x], b[j:y])
        if x < len(a):
            out.append(_merged(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def page_wrapper(found: list[tuple[str, str, int]]) -> list:
    slots: dict[str, list] = {}
    items, page = [], 0
    for name, text, linked, *_ in found:
        page = crc32(text.encode("utf-8", "surrogatepass"), page)
        s = slots.setdefault(name, [1, 0, 0, 0])
        s[1] += len(text)
        s[2] += min(linked, len(text))
        s[3] = crc32(text.encode("utf-8", "surrogatepass"), s[3])
        items.append(Item(name, False, False, _mark(text)))
    return [fold(items, _exact), slots, [page] if found else []]


def _mark(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass"))


def merge(a: list, b: list) -> list:
    slots = {k: list(v) for k, v in a[1].items()}
    for name, (pages, chars, linked, mark) in b[1].items():
        if name in slots:
            s = slots[name]
            slots[name] = [s[0] + pages, s[1] + chars, s[2] + linked, s[3] if s[3] == mark else None]
        else:
            slots[name] = [pages, chars, linked, mark]
    # pages without text have no position to compare
    return [align(a[0], b[0]) if a[2] and b[2] else a[0] or b[0], slots, sorted({*a[2], *b[2]})[:MIN_PAGES]]


def fixed_texts(wrapper: list, content: set[str]) -> list[str]:
    """Required fixed texts among the content slots, in order: lines of name,
    mark and whether it repeats."""
    if len(wrapper[2]) < MIN_PAGES:
        return []
    return [f"{x[0]}\t{x.mark}\t{int(x[1])}" for x in wrapper[0]
            if isinstance(x[0], str) and x[0] in content and x.mark is not None and not x[2]]


def template_flags(found: list[tuple], fixed: tuple[tuple[str, int, bool], ...]) -> list[bool]:
    """Which blocks of a page are template in the host's wrapper.  Every page of
    the host has the required texts in this order, so the first fit of each
    leaves room for the rest."""
    out, at, names = [], 0, {n for n, *_ in fixed}
    again = None
    for name, text, *_ in found:
        key = (name, _mark(text)) if name in names else None
        flag = bool(key) and key == again
        if not flag:
            again = None
            if key and at < len(fixed) and key == fixed[at][:2]:
                flag, again, at = True, key if fixed[at][2] else None, at + 1
        out.append(flag)
    return out


def _path(slot: str) -> list[str]:
    return [_tag_of(p) for p in re.split("[/>]", slot) if p]


def _nested(slot: str) -> bool:
    """In a container inside an article."""
    tags = [_tag_of(p) for p in slot.split(">", 1)[0].split("/") if p]
    return any(t in ("article", "main") for t in tags) and tags[-1] not in ("article", "main")


def _no_text(tags: list[str]) -> bool:
    """Inside an element that is never main text; an article's own header is its heading."""
    return any(t == "title" or t in NOT_MAIN and not (t == "header" and "article" in tags[:i]) for i, t in enumerate(tags))


def main_slots(wrapper: list) -> tuple[list[str], ...]:
    """Slots of main text: those inside an article, and those that count on a
    page without one; then both again for a page that has none of them, where
    words, nesting and links inside an article exclude nothing."""
    tags = {s: _path(s) for s in wrapper[1]}
    # pages that are all alike say nothing about what is template
    varies = any(mark is None for *_, mark in wrapper[1].values())

    def doubted(slot):
        pages, chars, linked, _ = wrapper[1][slot]
        links = _nested(slot) and pages > 1 and linked >= LINK_SHARE * chars
        return "!" in slot or links or tags[slot].count("article") > 1

    out = []
    left = [s for s in tags if not _no_text(tags[s])]
    for some in ([s for s in left if not doubted(s)], [s for s in left if doubted(s)]):
        inside = [s for s in some if "article" in tags[s] or "main" in tags[s]]
        rest = []
        for s in set(some).difference(inside):
            pages, chars, linked, mark = wrapper[1][s]
            template = varies and pages > 1 and mark is not None
            if not template and 2 * linked < chars:
                rest.append(s)
        out += [sorted(inside), sorted(rest)]
    return tuple(out)


def _dump(wrapper: list) -> str:
    """JSON of [names, items with numbers for names, slots by number, pages]."""
    items, slots, pages = wrapper
    number = {name: i for i, name in enumerate(slots)}

    def short(item):
        body, rep, opt = item
        return [number[body] if isinstance(body, str) else [short(x) for x in body], int(rep), int(opt), item.mark]

    return json.dumps([list(slots), [short(x) for x in items], list(slots.values()), pages], ensure_ascii=True, separators=(",", ":"))


def _load(dumped: str) -> list:
    names, items, slots, pages = json.loads(dumped)

    def full(item):
        body, rep, opt, mark = item
        return Item([full(x) for x in body] if isinstance(body, list) else names[body], bool(rep), bool(opt), mark)

    return [[full(x) for x in items], dict(zip(names, slots)), pages]


def _judged(wrapper: list) -> str:
    lists = main_slots(wrapper)
    decided = {*lists[1], *lists[3], *filter(_nested, lists[0] + lists[2])}
    return _GROUP.join("\n".join(g) for g in (*lists, fixed_texts(wrapper, decided)))


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                           pa.array([_dump(w) for w in held.values()], pa.string())], ["host", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = page_wrapper(blocks(page or ""))
            held[host] = merge(held[host], w) if host in held else w
            if len(held) >= HELD_HOSTS:
                yield flush()
                held.clear()
    yield flush()


def _by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by host; one wrapper is held at a time."""
    host, wrapper = None, None
    for batch in batches:
        out = []
        for h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = _load(w)
            if h != host:
                if wrapper is not None:
                    out.append((host, wrapper))
                host, wrapper = h, w
            else:
                wrapper = merge(wrapper, w)
        if out:
            yield _wrapper_batch(out)
    if wrapper is not None:
        yield _wrapper_batch([(host, wrapper)])


def _wrapper_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([h for h, _ in rows], pa.string()), pa.array([_dump(w) for _, w in rows], pa.string()),
         pa.array([_judged(w) for _, w in rows], pa.string())], ["host", "wrapper", "main"])


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """-> (host, wrapper, main): each host's wrapper as JSON, and its main slots."""
    made = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")) \
                .mapInArrow(_first_round, "host string, wrapper string")
    schema = "host string, wrapper string, main string"
    salted = made.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper") \
                 .mapInArrow(_by_host, schema)
    return some.repartition("host").sortWithinPartitions("host", "wrapper").select("host", "wrapper") \
               .mapInArrow(_by_host, schema)


@functools.lru_cache(maxsize=1024)
def _slot_sets(main: str) -> tuple[tuple[frozenset[str], ...], tuple[tuple[str, int, bool], ...]]:
    *lists, fixed = main.split(_GROUP)
    lines = [x.split("\t") for x in fixed.split("\n") if x]
    return tuple(frozenset(g.split("\n")) for g in lists), tuple((n, int(m), r == "1") for n, m, r in lines)


def page_text(page: str | None, main: str) -> str:
    found = placed_blocks(page or "")
    lists, fixed = _slot_sets(main)
    template = template_flags(found, fixed) if fixed else [False] * len(found)
    # inside an article only a container that holds nothing else is template
    mixed = {number for (*_, number), flag in zip(found, template) if not flag}
    for i, keep in enumerate(lists):
        if texts := [text for (slot, text, _, number), flag in zip(found, template)
                     if slot in keep and not (flag and (i % 2 or number not in mixed))]:
            return "\n".join(texts)
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """-> (page_id, url, text, n_chars), a row per row.

    A null or empty html gives an empty text; a null url is of the empty host.
    Repeated pages are each answered.  Markup that never ends, unbalanced or
    missing tags are read as far as they go.  Other columns are not read.
    """
    wrappers = infer(pages, url_col, html_col).select(F.col("host").alias("_host"), "main").checkpoint()
    size = wrappers.agg(F.coalesce(F.sum(F.length("main") + F.length("_host")), F.lit(0)).alias("n")).first()["n"]
    if size <= MAX_BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host_of(F.col(url_col)).alias("host"))
    joined = rows.join(wrappers, F.col("host") == F.col("_host")).select("page_id", "url", "html", "main")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(h, m) for h, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: joined.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint") \
                 .select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
