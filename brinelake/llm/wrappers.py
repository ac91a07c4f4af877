"""HTML extraction by union-free regular expressions inferred for each host.

A page is a stream of tokens: tags (name and, of the attributes, class, id and role) and text slots.
A wrapper is a union-free regular expression over such tokens: a token, a text slot, an optional group
``(...)?`` or a repeated group ``(...)+``.  Inference takes the distinct token streams of a host one after
another and aligns each with the wrapper: equal tokens match; at a mismatch a group that occurs again is
folded into a repeated group, and what only one side has becomes an optional group.  Alignment of two
wrappers works the same way, so streams are aligned in parts of about ``PART`` first and the parts' wrappers
after that, until a host has one; a host with most of the pages is never one task.  A stream that would make a wrapper longer
than ``LONGEST`` nodes (or twice its longest stream) begins the next wrapper, so every stream is in a wrapper; a host that has
several is as many sites, and its pages go to the site that their own stream was aligned in.

Elements whose name, role, class or id says so are chrome, and the text of an article or main element is the content of a
page that has one.  What is left open, on pages without such an element, the host's wrapper decides: pages are
matched against it, and a text slot (all of its places on a page taken together) that reads the same on all pages that
have it, at least ``PAGES`` different ones, is part of the template, as menus and footers are; the sites of one host count pages with
the same text together.  Texts of slots that vary are
content.  A slot that holds over ``OUTWEIGHS`` times the text of a page's content, as the body of near copies of one article does, is content
too, and then the shorter ones are compared with both.  The texts of content, decoded and with white space folded, are the blocks.
Inside an article element names of classes and ids count only where they leave no doubt (``INNER``).

Cases: a null or empty page has an empty text; a page cut off anywhere, or with tags that are never closed, is
read as far as it goes (a tag cut off at the end is no text); a null url is a host of its own; rows that repeat
a page each give a row; a page that the wrapper doesn't cover is marked by its tags alone.
"""

from __future__ import annotations

import functools
import html
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, materialize, slices

#: Streams of a host that are aligned in one part; nodes after which a host's next wrapper begins.
PART, LONGEST = 256, 4000
#: Least different pages that show a slot to be template.
PAGES = 3
#: A slot with so many times the content's text isn't template.
OUTWEIGHS = 8
#: Most sites whose wrappers, of a bounded length each, are broadcast.
HOT = 200
#: Fixed word lists of HTML: elements that end a block, that have no end tag, whose content is no text, and chrome.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe noframes noembed xmp svg".split())
CHROME_TAGS = frozenset("head nav header footer aside form menu button select dialog label fieldset".split()) | RAW_TAGS
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
CHROME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|footer|cookies?|consent|gdpr|newsletter|"
    r"related|recommended|comments?|commentlist|disqus|replies|respond|pagination|pager|toolbar)(?:$|[\s_-])",
    re.I,
)
#: Words that also name parts of articles: chrome outside an article or main element only.
OUTER = re.compile(
    r"(?:^|[\s_-])(?:promo\w*|banner|side|widget|header|masthead|notice|popup|modal|subscribe|signup|login|search|share|sharing|social|reply|skip|copyright)(?:$|[\s_-])", re.I
)
#: Whole names of classes that are no part of an article even inside one.
INNER = re.compile(
    r"(?:^|\s)(?:ads?|ad-(?:slot|unit|box|banner|container|wrapper|label|block)|advert\w*|sponsor(?:ed)?|sidebar|cookies?|consent|gdpr|newsletter(?:-\w+)?|"
    r"related-(?:posts|articles|links|stories)|comments?|comment-?list|comments-(?:area|section|list)|disqus\w*|replies|respond|pagination|pager|breadcrumbs?)(?:$|\s)",
    re.I,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.S)
TEXT = "#"


# --- tokens: the same tags come again and again, so what is made of them is remembered


@functools.lru_cache(1 << 14)
def _start(name: str, attributes: str) -> str:
    """The token of a start tag."""
    if not attributes or attributes.isspace():
        return f"<{name}>"
    marks = []
    for a in _ATTRIBUTE.finditer(attributes):
        if (key := a.group(1).lower()) in ("class", "id", "role"):
            value = html.unescape(next(v for v in a.groups()[1:] if v is not None))
            marks.append(f"{key}={' '.join(re.sub(r'[0-9]+', '0', value).split())}")
    if "hidden" in attributes.lower().split():
        marks.append("hidden")
    return f"<{name}{''.join(' ' + x for x in sorted(marks))}>"


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(token, text): a tag as ``<name class id role>`` or ``</name>``, or ``#`` and its characters, still encoded."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            if page[at:].strip():
                yield TEXT, page[at:]
            return
        if m.start() > at:
            yield TEXT, page[at : m.start()]
        at = m.end()
        name = m.group(2)
        if name is None:
            if m.group(0).startswith("<![CDATA["):
                yield TEXT, html.escape(m.group(0)[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if not m.group(4):
            return  # cut off inside a tag
        if m.group(1):
            yield f"</{name}>", ""
            continue
        yield _start(name, m.group(3)), ""
        if name in RAW_TAGS and not m.group(3).endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at)
            at = n if end is None else end.start()


@functools.lru_cache(1 << 14)
def name_of(token: str) -> str:
    return re.match(r"</?([^ >]*)", token).group(1)


@functools.lru_cache(1 << 14)
def is_chrome(token: str, inside: bool = False) -> bool:
    """Whether what a start tag holds is no part of the main text, by its name, role, class or id; ``inside`` an article or not."""
    if name_of(token) in CHROME_TAGS or token.endswith(" hidden>") or " hidden " in token:
        return True
    for mark in re.findall(r"(class|id|role)=([^=>]*?)(?= (?:class|id|role)=| hidden|>)", token):
        if mark[0] == "role":
            found = mark[1] in CHROME_ROLES
        elif inside:  # a word of a class must not outvote an article
            found = INNER.search(mark[1])
        else:
            found = CHROME.search(mark[1]) or OUTER.search(mark[1])
        if found:
            return True
    return False


@functools.lru_cache(1 << 14)
def is_article(token: str) -> bool:
    named = name_of(token) in ("article", "main") or "role=main" in token
    return named or re.search(r"(?:class|id)=[^=]*\b(?:article|entry-content|post-content|main-content)\b", token) is not None


class _Open:
    """The open elements of a page, with the places of each name and of all blocks, so that no tag is looked for among the others."""

    def __init__(self):
        self.tags: list[tuple[str, int]] = []  # name, zone
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def zone(self) -> int:
        return self.tags[-1][1] if self.tags else 0

    def push(self, name: str, zone: int) -> None:
        self.places.setdefault(name, []).append(len(self.tags))
        if name in BLOCK_TAGS:
            self.blocks.append(len(self.tags))
        self.tags.append((name, zone))

    def close(self, name: str) -> None:
        """Ends the last open element of the name and what is in it; the end of an inline element doesn't reach across a block."""
        places = self.places.get(name)
        if not places or name not in BLOCK_TAGS and self.blocks and self.blocks[-1] > places[-1]:
            return
        for _ in range(len(self.tags) - places[-1]):
            gone, _ = self.tags.pop()
            self.places[gone].pop()
            if gone in BLOCK_TAGS:
                self.blocks.pop()

    def end_paragraph(self) -> None:
        """An open paragraph ends where a block starts."""
        if self.blocks and self.tags[self.blocks[-1]][0] == "p":
            self.close("p")


def marks(stream: list[str]) -> list[tuple[int, bool]]:
    """For each token: 0 outside, 1 in an article or main element, -1 in chrome; and whether a new block starts there."""
    out, opened = [], _Open()
    for t in stream:
        zone = opened.zone()
        if t == TEXT:
            out.append((zone, False))
            continue
        name = name_of(t)
        if t.startswith("</"):
            opened.close(name)
        else:
            if name in BLOCK_TAGS:
                opened.end_paragraph()
                zone = opened.zone()
            if is_chrome(t, zone == 1) and not (zone == 1 and name == "header"):
                zone = -1
            elif zone == 0 and is_article(t):
                zone = 1
            if name not in VOID_TAGS:
                opened.push(name, zone)
        out.append((zone, name in BLOCK_TAGS))
    return out


def folded(stream: list[str], longest: int = 8) -> list:
    """The stream as a wrapper: runs of text are one slot, immediate repeats of a short group of nodes a repeated group."""
    out: list = []
    for t in stream:
        if t == TEXT and out and out[-1] == TEXT:
            continue
        out.append(t)
        size = 1
        while size <= longest and len(out) > size:
            before = out[-size - 1]
            if isinstance(before, list) and before[1] == out[-size:]:
                del out[-size:]
                size = 1
            elif size > 1 and out[-size:] == out[-2 * size : -size]:
                out[-2 * size :] = [["+", out[-size:]]]
                size = 1
            else:
                size += 1
    return out


# --- wrappers: lists of nodes, a node being a token or [mark, nodes] with mark "?" or "+"


def first_of(nodes: list) -> str | None:
    """First token that must come, or may come first of a group."""
    for node in nodes:
        return node if isinstance(node, str) else first_of(node[1])
    return None


def align(a: list, b: list) -> list:
    """A wrapper that covers all that ``a`` and ``b`` cover, inferred from where they match."""
    out: list = []
    i = j = 0
    while i < len(a) or j < len(b):
        x, y = (a[i] if i < len(a) else None), (b[j] if j < len(b) else None)
        if x is not None and y is not None:
            if x == y:
                out.append(x)
                i, j = i + 1, j + 1
                continue
            if isinstance(x, list) and isinstance(y, list) and first_of(x[1]) == first_of(y[1]):
                out.append(["+" if "+" in (x[0], y[0]) else "?", align(x[1], y[1])])
                i, j = i + 1, j + 1
                continue
            group, rest = (x, b[j:]) if isinstance(x, list) else (y, a[i:]) if isinstance(y, list) else (None, [])
            if group is not None:
                used = _repeats(group[1], rest)
                out.append(["+" if group[0] == "+" or used > len(group[1]) else "?", group[1]])
                if group is x:
                    i, j = i + 1, j + used
                else:
                    i, j = i + used, j + 1
                continue
        # a repeat: the group that just ended occurs again on one side
        for side, nodes, at in (("a", a, i), ("b", b, j)):
            size = _repeated(out, nodes[at:])
            if size:
                out[-size:] = [["+", out[-size:]]]
                used = _repeats(out[-1][1], nodes[at:])
                i, j = (i + used, j) if side == "a" else (i, j + used)
                break
        else:
            skip_a, skip_b = _resync(a, i, b, j)
            for nodes in (a[i : i + skip_a], b[j : j + skip_b]):
                if nodes:
                    out.append(nodes[0] if len(nodes) == 1 and isinstance(nodes[0], list) else ["?", nodes])
            i, j = i + skip_a, j + skip_b
    return out


def _repeats(group: list, nodes: list) -> int:
    """How many nodes whole repeats of ``group`` take at the start."""
    used, size = 0, len(group)
    while size and nodes[used : used + size] == group:
        used += size
    return used


def _repeated(out: list, nodes: list, longest: int = 12) -> int:
    """Size of the group at the end of ``out`` that ``nodes`` begins with, 0 if there is none."""
    for size in range(1, min(longest, len(out), len(nodes)) + 1):
        if out[-size:] == nodes[:size] and (size > 1 or isinstance(nodes[0], str) and nodes[0] != TEXT):
            return size
    return 0


def _resync(a: list, i: int, b: list, j: int) -> tuple[int, int]:
    """The least skips on both sides after which the sides match, of equal ones the least on ``a``; looks no further than their sum."""
    in_a: dict[str, int] = {}
    in_b: dict[str, int] = {}
    left, right = len(a) - i, len(b) - j
    best, k = (left, right), 0
    while k < max(left, right) and k <= sum(best):
        if k < right:
            in_b.setdefault(key := _key(b[j + k]), k)
            if (at := in_a.get(key)) is not None:
                best = _less(best, (at, k))
        if k < left:
            in_a.setdefault(key := _key(a[i + k]), k)
            if (at := in_b.get(key)) is not None:
                best = _less(best, (k, at))
        k += 1
    return best


def _less(best: tuple[int, int], found: tuple[int, int]) -> tuple[int, int]:
    return found if sum(found) < sum(best) or sum(found) == sum(best) and found[0] < best[0] else best


def _key(node) -> str:
    return node if isinstance(node, str) else json.dumps(node)


def infer(streams: list[list]) -> list:
    """One wrapper of all streams (or wrappers), aligned in a fixed order."""
    wrapper: list = []
    for s in sorted(streams, key=_order):
        wrapper = align(wrapper, s) if wrapper else list(s)
    return wrapper


def infer_several(streams: list[tuple[list, int]], bound: int) -> list[tuple[list, int, list[int]]]:
    """Wrappers of all streams (or wrappers, with the size of the longest stream in each), none left out.

    One that would make a wrapper longer than ``bound`` begins the next.  Of each wrapper: the size of its longest stream, and the places of what it was made of.
    """
    out: list[tuple[list, int, list[int]]] = []
    for place in sorted(range(len(streams)), key=lambda p: _order(streams[p][0])):
        s, longest = streams[place]
        if out:
            wrapper, before, places = out[-1]
            aligned = align(wrapper, s)
            if _size(aligned) <= max(bound, 2 * max(before, longest)):
                out[-1] = aligned, max(before, longest), [*places, place]
                continue
        out.append((list(s), longest, [place]))
    return out


def _order(nodes: list) -> tuple[int, str]:
    return len(nodes), json.dumps(nodes)


def _size(nodes: list) -> int:
    return sum(1 if isinstance(n, str) else 1 + _size(n[1]) for n in nodes)


def flat(nodes: list) -> list[str]:
    """All tokens of a wrapper, each once, in order."""
    out: list[str] = []
    for n in nodes:
        out += [n] if isinstance(n, str) else flat(n[1])
    return out


def match(nodes: list, stream: list[str], at: int = 0, slots: list | None = None, base: int = 0) -> tuple[int, list]:
    """How far the wrapper covers ``stream`` from ``at``, and (stream place, wrapper place) of its tokens."""
    slots = [] if slots is None else slots
    place = base
    for n in nodes:
        if isinstance(n, str):
            if n != TEXT and (at >= len(stream) or stream[at] != n):
                return -1, slots
            while at < len(stream) and stream[at] == n:
                slots.append((at, place))
                at += 1
                if n != TEXT:
                    break
            place += 1
            continue
        width = len(flat(n[1]))
        while True:
            kept = len(slots)
            end, _ = match(n[1], stream, at, slots, place) if at < len(stream) else (-1, slots)
            if end <= at:
                del slots[kept:]
                break
            at = end
            if n[0] == "?":
                break
        place += width
    return at, slots


# --- extraction


class Extractor:
    """Applies one host's wrapper, of which the slots ``fixed`` are template."""

    def __init__(self, wrapper: list, fixed: list[int] = ()):
        self.wrapper, self.fixed = wrapper, frozenset(fixed)

    def open_slots(self, page: str) -> dict[int, list[str]] | None:
        """Texts at each slot of the wrapper, of a page without an article or main element that the wrapper covers."""
        parts = list(tokens(page))
        stream = [t for t, _ in parts]
        zones = [z for z, _ in marks(stream)]
        if _has_article(parts, zones):
            return None
        out: dict[int, list[str]] = {}
        for at, place in self._covered(stream):
            if stream[at] == TEXT and zones[at] == 0:
                out.setdefault(place, []).append(_fold(parts[at][1]))
        return out

    def _covered(self, stream: list[str]) -> list[tuple[int, int]]:
        end, slots = match(self.wrapper, stream)
        return slots if end == len(stream) else []

    def _template(self, parts: list, zones: list[int], slots: list[tuple[int, int]]) -> list[int]:
        """Places of the open texts that are template: those of fixed slots, but for the longest where they outweigh the content."""
        own: dict[int, list[int]] = {}
        for at, place in slots:
            if parts[at][0] == TEXT and zones[at] == 0:
                own.setdefault(place if place in self.fixed else -1, []).append(at)
        size = lambda places: sum(len(_fold(parts[at][1])) for at in places)
        content, out = size(own.pop(-1, [])), []
        for length, places in sorted(((size(p), p) for p in own.values()), reverse=True):
            if length > OUTWEIGHS * content:
                content += length
            else:
                out += places
        return out

    def text(self, page: str) -> str:
        parts = list(tokens(page))
        stream = [t for t, _ in parts]
        own = marks(stream)
        zones = [z for z, _ in own]
        has_article = _has_article(parts, zones)
        if self.fixed and not has_article:  # what the page's own tags leave open, the host's wrapper decides
            for at in self._template(parts, zones, self._covered(stream)):
                zones[at] = -1
        blocks, words = [], []
        for (token, chars), zone, (_, breaks) in zip(parts, zones, own):
            if breaks and words:
                blocks.append("".join(words))
                words = []
            if token == TEXT and (zone == 1 if has_article else zone == 0):
                words.append(chars)
            elif token in ("<br>", "<br/>", "<hr>") or token.startswith("<br "):
                words.append(" ")
        blocks.append("".join(words))
        return "\n\n".join(b for b in map(_fold, blocks) if b)


def _fold(chars: str) -> str:
    return " ".join(html.unescape(chars).split())


def _has_article(parts: list[tuple[str, str]], zones: list[int]) -> bool:
    return any(z == 1 for (t, s), z in zip(parts, zones) if t == TEXT and s.strip())


def host_of(url):
    """Host of a url column, lower case."""
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def _stream_of(page: str) -> tuple[str, int]:
    """The page's stream as JSON, and its hash."""
    from xxhash import xxh3_64_intdigest as h

    stream = json.dumps(folded([t for t, _ in tokens(page)]))
    return stream, h(stream.encode()) - (1 << 63)


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON): distinct token streams of all pages, aligned within each host; a site of a host that has several is ``host/number``."""
    return infer_sites(pages, url_col, html_col)[0]


def infer_sites(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame | None]:
    """Wrappers as ``infer_wrappers`` has them, and (host, stream, site) of all streams of hosts with several (None if no host has)."""

    bound = LONGEST

    def streams(batches):
        import pyarrow as pa

        for batch in slices(batches):
            seen = {(h, *_stream_of(p)) for h, p in zip(batch.column("host").to_pylist(), as_text(batch.column("page")))}
            columns = list(zip(*seen)) or [[]] * 3
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "wrapper", "id"])

    def aligned(pdf):
        import pandas as pd

        own = [json.loads(s) for s in pdf["wrapper"]]
        found = infer_several([(s, _size(s) if n < 0 else n) for s, n in zip(own, pdf["longest"])], bound)
        ids, last = pdf["id"].tolist(), len(found) - 1
        rows = [(pdf["host"].iloc[0], ids[places[0]], json.dumps(w), n, [ids[p] for p in places], k == last) for k, (w, n, places) in enumerate(found)]
        return pd.DataFrame(rows, columns=["host", "id", "wrapper", "longest", "parts", "open"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("page")).mapInArrow(streams, "host string, wrapper string, id long")
    first = materialize(rows.distinct(), "streams")
    level, closed, rounds = first.withColumn("longest", F.lit(-1)), [], []
    while True:  # of each part the last wrapper is aligned further, all others have no room
        sizes = level.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        salted = level.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PART)))
        kind = "host string, id long, wrapper string, longest int, parts array<long>, open boolean"
        done = materialize(salted.select("host", "salt", "id", "wrapper", "longest").groupBy("host", "salt").applyInPandas(aligned, kind), "wrappers")
        rounds.append(done.select("host", F.explode("parts").alias("part"), "id"))
        closed.append(done.where("not open").select("host", "id", "wrapper"))
        level = done.where("open").select("host", "id", "wrapper", "longest")
    if not any(not c.isEmpty() for c in closed):
        return level.select("host", "wrapper"), None
    wrappers = functools.reduce(DataFrame.unionByName, closed, level.select("host", "id", "wrapper"))
    several = wrappers.groupBy("host").count().where("count > 1").select("host", F.lit(True).alias("several"))
    site = F.concat("host", F.lit("/"), F.col("id").cast("string"))  # no host has the sign
    wrappers = materialize(wrappers.join(several, "host", "left").select(F.when(F.col("several"), site).otherwise(F.col("host")).alias("host"), "wrapper"), "sites")
    members = first.join(several, "host", "left_semi").select("host", F.col("id").alias("stream"), "id")
    for step in rounds:
        next_id = step.select("host", F.col("part").alias("id"), F.col("id").alias("next"))
        members = members.join(next_id, ["host", "id"], "left").select("host", "stream", F.coalesce("next", "id").alias("id"))
    return wrappers, materialize(members.select("host", "stream", site.alias("site")), "members")


def to_sites(rows: DataFrame, members: DataFrame | None) -> DataFrame:
    """``rows`` (host, page, ...), where a host with several wrappers is replaced by the site of the page's stream."""
    if members is None:
        return rows
    kept = [f for f in rows.schema if f.name != "host"]
    several = members.select("host").distinct()

    def keyed(batches):
        import pyarrow as pa

        for batch in slices(batches):
            found = pa.array([_stream_of(p)[1] for p in as_text(batch.column("page"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "stream"])

    inner = rows.join(several, "host", "left_semi")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema)
    found = inner.mapInArrow(keyed, f"{schema}, stream long").join(members, ["host", "stream"], "left")
    found = found.select(F.coalesce("site", "host").alias("host"), *[f.name for f in kept])
    return rows.join(several, "host", "left_anti").select(*found.columns).unionByName(found)


def template_slots(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, wrapper, fixed): the slots of each host's wrapper that read the same on all its pages.

    ``rows``: host and page.  Every task sends one row for a slot of a host: the least and greatest hash of its texts
    and a bit for each different page (of 63 kinds).  For the sites of one host, pages that have the text at such a slot of any site count.
    """

    def slots(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as h

        known = _Extractors()
        for batch in slices(batches):
            seen: dict[tuple[str, int], list[int]] = {}
            for host, wrapper, page in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), as_text(batch.column("page"))):
                for place, texts in (known.of(wrapper, None).open_slots(page) or {}).items():
                    value, bit = h("\n".join(texts).encode()) >> 1, 1 << h(page.encode()) % 63
                    old = seen.setdefault((host, place), [value, value, 0])
                    old[:] = min(old[0], value), max(old[1], value), old[2] | bit
            columns = list(zip(*[(*k, *v) for k, v in seen.items()])) or [[]] * 5
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "place", "least", "most", "pages"])

    found = _with_wrappers(rows, wrappers).select("host", "wrapper", "page").mapInArrow(slots, "host string, place int, least long, most long, pages long")
    sums = found.groupBy("host", "place").agg(F.min("least").alias("a"), F.max("most").alias("b"), F.bit_or("pages").alias("pages"))
    whole = Window.partitionBy(F.substring_index("host", "/", 1), "a")
    pages = F.when(F.contains("host", F.lit("/")), F.bit_or("pages").over(whole)).otherwise(F.col("pages"))
    fixed = sums.where(F.col("a") == F.col("b")).withColumn("pages", pages).where(F.bit_count("pages") >= PAGES)
    return wrappers.join(fixed.groupBy("host").agg(F.array_sort(F.collect_list("place")).alias("fixed")), "host", "left")


class _Extractors:
    """Extractors of wrappers, remembered."""

    def __init__(self):
        self.known: dict[tuple, Extractor] = {}

    def of(self, wrapper: str | None, fixed: list[int] | None) -> Extractor:
        key = wrapper or "[]", tuple(fixed or ())
        if key not in self.known:
            if len(self.known) > 200:
                self.known.clear()
            self.known[key] = Extractor(json.loads(key[0]), key[1])
        return self.known[key]


def _with_wrappers(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Rows (host, ...) with their host's wrapper.

    Hosts with over a share ``1 / HOT`` of all rows, at most ``HOT`` of them, have their wrappers broadcast, so that
    their pages stay where they are; the wrappers of all other hosts meet their pages in a shuffle.
    """
    counts = materialize(rows.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r["host"] for r in counts.where(F.col("n") * HOT > total).collect()]
    is_hot = F.col("host").isin(hot)
    often = rows.where(is_hot).join(F.broadcast(wrappers.where(is_hot)), "host", "left")
    return often.unionByName(rows.where(~is_hot).join(wrappers, "host", "left"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, text, n_chars for each row."""
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("page")
    )
    wrappers, members = infer_sites(pages, url_col, html_col)
    rows = to_sites(rows, members)
    wrappers = materialize(template_slots(rows.select("host", "page"), wrappers), "templates")

    def run(batches):
        import pyarrow as pa

        known = _Extractors()
        for batch in slices(batches):
            own = zip(batch.column("wrapper").to_pylist(), batch.column("fixed").to_pylist(), as_text(batch.column("page")))
            texts = [known.of(wrapper, fixed).text(page) for wrapper, fixed, page in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    return (
        _with_wrappers(rows, wrappers)
        .select("id", "url", "wrapper", "fixed", "page")
        .mapInArrow(run, f"id {id_type}, url string, text string, n_chars long")
        .withColumnRenamed("id", id_col)
    )
