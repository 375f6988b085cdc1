"""HTML extraction with wrappers: union-free regular expressions inferred per host.

A page becomes a stream of block tags and texts, with the end tags that HTML
implies filled in. Neighbouring repeats of the stream fold into repeated groups.
Streams of one host are aligned one after the other: equal tokens stay, texts
that differ become text slots, parts that one side lacks become optional groups,
and a group that meets more of its own kind is repeated. The result is a regular
expression without unions, the wrapper of the host.

Each page is matched against its host's wrapper. What meets a slot or a repeated group
(whose texts are slots) varies and may be content. A text that meets a constant of the
wrapper, required or optional, is template. Template frames the content, so it goes only around it:
where pages have an article or a main element all of that stays, fixed headings too,
and where they have none, constants before the first and behind the last varying text go. A constant
counts only with ``WITNESSES`` pages of different content that have it: one page, or
copies of one, do not tell template from content. Wrappers hold 64-bit hashes of constants.
Where pages have no root, what counts as constant may depend on how they meet: alignment is not associative.

Elements nested more than ``DEPTH`` deep are read as content of the one at that depth, as
browsers do, so one odd page takes no more time than its length asks for.

Among what varies, the paths of elements are a hint: those below the content root
(an article, else a main element, else the body) are content, but for those that
pass through an element, class, id or role of page furniture: menus, headers,
footers, sidebars, notices, adverts, forms, comments. A page without a text on its host's content paths is hinted by its own paths. A page's
text is what is left, block by block.

Wrappers are inferred inside each task first and merged per host after that, as a tree (a
merge is an alignment of two wrappers), so a host with most of the pages sends one
small row per task, and no merge takes more than a few dozen or a small part of them. All pages are aligned. Pages then meet their wrapper: where all
wrappers together are below ``BROADCAST_CHARS`` these go to the pages, which stay where
they are; beyond that the pages are dealt out by host and one of ``SALTS`` salts, with a
copy of each wrapper per salt.

Defined cases: null html counts as empty and gives an empty text; a null or odd
url has the host ''; a page without markup is all text of its body; broken markup
is read as far as it goes; repeated rows are pages like any other.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BROADCAST_CHARS = 32_000_000
SALTS = 64
MERGE_SALTS = (4096, 64, 1)
WITNESSES = 3
DEPTH = 150
REACH = 16

# HTML elements by how they are read.
RAW = frozenset("script style noscript template iframe object svg math textarea title".split())
BLOCKS = frozenset(
    """html head body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table
    thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset details summary address hr
    menu dialog select option button center""".split()
)
ENDS_P = BLOCKS - frozenset("html head body button option".split())
CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
EMPTY = frozenset("hr".split())
FURNITURE = frozenset("head nav aside header footer form menu dialog select button".split())
FURNITURE_WORDS = frozenset(
    """ad ads advert advertisement adverts advertising sponsor sponsored promo banner cookie cookies consent notice
    notices popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead
    comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe
    subscription signup login widget pagination pager toolbar alert gdpr search complementary contentinfo""".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/)?(?P<name2>[a-zA-Z][^\s/>]*)[^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_PLAIN = re.compile(r"[A-Za-z_-]+")
SLOT = "#"


def label(name: str, attributes: str) -> str:
    """An element's name, with what its class, id and role say of page furniture, and its class names without figures."""
    if "=" not in attributes:
        return name
    found = [(kind.lower(), a or b or c) for kind, a, b, c in _ATTRIBUTE.findall(attributes)]
    words = {w.lower() for _, x in found for w in _WORD.findall(x)}
    marks = sorted(words & FURNITURE_WORDS) + (["main"] if "main" in words and name != "main" else [])
    classes = sorted({x for kind, value in found if kind == "class" for x in value.split() if _PLAIN.fullmatch(x)})
    return ".".join([name, *marks]) + ("~" + ".".join(classes) if classes else "")


def marks_of(element: str) -> list[str]:
    """The name and marks of a label."""
    return element.partition("~")[0].split(".")


class Nesting:
    """The open elements. The path has the labels of the outer DEPTH of them."""

    def __init__(self):
        self.names: list[str] = []
        self.open: Counter = Counter()
        self.path: tuple[str, ...] = ()

    def push(self, name: str, label: str) -> bool:
        """Whether the element is on the path."""
        self.names.append(name)
        self.open[name] += 1
        if len(self.names) > DEPTH:
            return False
        self.path += (label,)
        return True

    def pop(self) -> bool:
        """Whether the element was on the path."""
        self.open[self.names.pop()] -= 1
        if len(self.names) >= DEPTH:
            return False
        self.path = self.path[:-1]
        return True

    def place(self, name: str) -> int:
        """Of the innermost open element of this name."""
        return len(self.names) - 1 - self.names[::-1].index(name)


def stream(page: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """(kind, path, text): '<' and '>' for block tags, SLOT for texts, '|' for a line break."""
    on = Nesting()
    at, n = 0, len(page)

    def closed(k: int) -> Iterator[tuple[str, tuple[str, ...], str]]:
        """Closes elements until k are open."""
        while len(on.names) > k:
            path = on.path
            yield from [(">", path, "")] if on.pop() else []

    while at < n:
        m = _TOKEN.search(page, at)
        upto = m.start() if m else n
        if upto > at:
            yield SLOT, on.path, page[at:upto]
        if not m:
            return
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        end = m["end"] or m["end2"]
        if name in RAW:
            if not end and not (m["rest"] or "").endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if name == "br":
            yield "|", on.path, ""
            continue
        if name not in BLOCKS:
            continue
        if end:
            if on.open[name]:
                yield from closed(on.place(name))
            continue
        if name in ENDS_P and on.open["p"]:
            yield from closed(on.place("p"))
        if name in CLOSERS and any(on.open[x] for x in CLOSERS[name]):
            stop = SCOPES.get(name, set())
            for k in range(len(on.names) - 1, -1, -1):
                if on.names[k] in stop:
                    break
                if on.names[k] in CLOSERS[name]:
                    yield from closed(k)
                    break
        if on.push(name, label(name, m["rest"] or "")):
            yield "<", on.path, ""
        else:
            yield "|", on.path, ""  # too deep for a level of its own, but its text is apart
        if name in EMPTY:
            yield from closed(len(on.names) - 1)
    yield from closed(0)


# A wrapper is a list of items: ["<", path], [">", path], ["#", path, text or None for a slot, witnesses], ["?", items], ["+", items].
# Witnesses are the least WITNESSES fingerprints of the contents of pages that have this text.


def key(item: list) -> str:
    """Items with the same key may be aligned: texts of one path are, whatever they say."""
    if item[0] in "?+":
        return "(" + " ".join(map(key, item[1])) + ")"
    return item[0] + item[1]


def head(unit: list) -> str:
    """What a unit is aligned by: its first item, whatever groups that stands in."""
    item = unit[0]
    while item[0] in "?+" and item[1]:
        item = item[1][0]
    return "" if item[0] in "?+" else key(item)


def unique_anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of what both lists have exactly once, as many as stand in the same order on both sides."""
    ca, cb = Counter(a), Counter(b)
    at = {x: j for j, x in enumerate(b) if cb[x] == 1}
    met = [(i, at[x]) for i, x in enumerate(a) if ca[x] == 1 and x in at]
    ends: list[int] = []  # last places of the best chains by length
    of, back = [], [-1] * len(met)
    for k, (_, j) in enumerate(met):
        p = bisect_left(ends, j)
        if p:
            back[k] = of[p - 1]
        if p == len(ends):
            ends.append(j)
            of.append(k)
        else:
            ends[p], of[p] = j, k
    chain, k = [], of[-1] if of else -1
    while k >= 0:
        chain.append(met[k])
        k = back[k]
    return chain[::-1]


def opcodes(a: list[str], b: list[str]) -> list[tuple]:
    """The equal and differing stretches of two lists: between anchors that are unique in both, equal ones are taken from the left,
    and after a difference the nearest equal pair within REACH goes on. Takes time in proportion to the lists."""
    pairs: list[tuple[int, int]] = []
    i = j = 0
    for x, y in [*unique_anchors(a, b), (len(a), len(b))]:
        while i < x and j < y:
            if a[i] != b[j]:
                steps = ((s, t - s) for t in range(1, REACH) for s in range(t + 1))
                step = next(((s, t) for s, t in steps if i + s < x and j + t < y and a[i + s] == b[j + t]), None)
                if step is None:
                    i, j = i + REACH, j + REACH
                    continue
                i, j = i + step[0], j + step[1]
            pairs.append((i, j))
            i, j = i + 1, j + 1
        if x < len(a):
            pairs.append((x, y))
        i, j = x + 1, y + 1
    out: list[tuple] = []
    i = j = 0
    for x, y in [*pairs, (len(a), len(b))]:
        if i < x or j < y:
            out.append(("differ", i, x, j, y))
        if x < len(a) and y < len(b):
            if out and out[-1][0] == "equal":
                out[-1] = ("equal", out[-1][1], x + 1, out[-1][3], y + 1)
            else:
                out.append(("equal", x, x + 1, y, y + 1))
        i, j = x + 1, y + 1
    return out


def groups(items: list) -> list:
    """Top-level elements as units: an element from its start to its end tag is one unit."""
    out, k = [], 0
    while k < len(items):
        if items[k][0] == "<":
            depth, j = 0, k
            while j < len(items):
                depth += (items[j][0] == "<") - (items[j][0] == ">")
                if depth == 0:
                    break
                j += 1
            out.append(items[k : j + 1])
            k = j + 1
        else:
            out.append([items[k]])
            k += 1
    return out


def generalised(items: list) -> list:
    """All texts of a repeated group are slots."""
    return [[i[0], i[1], None, []] if i[0] == SLOT else [i[0], generalised(i[1])] if i[0] in "?+" else i for i in items]


def fold(items: list) -> list:
    """Repeats of neighbouring elements become one repeated group, inner ones first."""
    out: list = []
    last = None
    for unit in groups(items):
        if unit[0][0] == "<" and len(unit) > 2:
            unit = [unit[0], *fold(unit[1:-1]), unit[-1]]
        if unit[0][0] == "<" or unit[0][0] == "+":
            body = unit[0][1] if unit[0][0] == "+" else unit
            if last is not None and " ".join(map(key, last)) == " ".join(map(key, body)):
                out[-1] = [["+", generalised(last)]]
                last = out[-1][0][1]
                continue
            last = body
        else:
            last = None
        out.append(unit)
    return [i for unit in out for i in unit]


def align(a: list, b: list) -> list:
    """The wrapper of what a and b describe."""
    ua, ub = groups(a), groups(b)
    out: list = []
    for op, i1, i2, j1, j2 in opcodes([head(u) for u in ua], [head(u) for u in ub]):
        if op == "equal":
            for x, y in zip(ua[i1:i2], ub[j1:j2]):
                out.extend(merge(x, y))
        else:
            for side in (ua[i1:i2], ub[j1:j2]):
                for unit in side:
                    out.append(unit[0] if unit[0][0] == "?" else ["?", unit])
    return fold(out)


def merge(x: list, y: list) -> list:
    """Two units with the same head."""
    kx, ky = x[0][0], y[0][0]
    if kx in "?+" or ky in "?+":
        optional = "?" in (kx, ky)
        inner_x, inner_y = (u[0][1] if u[0][0] in "?+" else u for u in (x, y))
        inner = align(inner_x, inner_y)
        if "+" in (kx, ky) or any(u[0] == "+" for u in (inner_x[0], inner_y[0]) if u):
            inner = inner[0][1] if len(inner) == 1 and inner[0][0] == "+" else inner
            inner = [["+", generalised(inner)]]
        return [["?", inner]] if optional else inner
    if kx == SLOT:
        if x[0][2] is None or x[0][2] != y[0][2]:
            return [[SLOT, x[0][1], None, []]]
        return [[SLOT, x[0][1], x[0][2], sorted({*x[0][3], *y[0][3]})[:WITNESSES]]]
    if kx == "<" and len(x) > 1 and len(y) > 1:
        return [x[0], *align(x[1:-1], y[1:-1]), x[-1]]
    return x


def text_runs(tokens: list[tuple]) -> tuple[list, list[str], list[int | None]]:
    """The unfolded items of a page (texts by number of their run), the runs' texts, and each token's run."""
    items: list = []
    parts: list[list[str]] = []
    of: list[int | None] = []
    for kind, path, text in tokens:
        of.append(None)
        if kind == SLOT:
            if text.strip():
                if not items or items[-1][0] != SLOT:
                    items.append([SLOT, "/".join(path), None, len(parts)])
                    parts.append([])
            if items and items[-1][0] == SLOT:
                parts[-1].append(text)
                of[-1] = len(parts) - 1
        elif kind == "|":
            if items and items[-1][0] == SLOT:
                parts[-1].append(" ")
        else:
            items.append([kind, "/".join(path)])
    return items, [" ".join("".join(p).split()) for p in parts], of


def constant(text: str) -> str:
    """What tells two texts apart."""
    return xxhash.xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))


def page_items(page: str) -> list:
    """The folded stream of a page; texts are cut to what telling them apart takes."""
    items, texts, _ = text_runs(list(stream(page)))
    content = content_paths(items)
    witness = zlib.crc32("\n".join(texts[i[3]] for i in items if i[0] == SLOT and i[1] in content).encode("utf-8", "surrogatepass"))
    return fold([[SLOT, i[1], constant(texts[i[3]]), [witness]] if i[0] == SLOT else i for i in items])


def template(item: list) -> bool:
    """Whether a text of a wrapper is a constant with enough witnesses."""
    return item[2] is not None and isinstance(item[3], list) and len(item[3]) >= WITNESSES


def slot_paths(items: list) -> set[str]:
    """The paths of texts."""
    found: set[str] = set()
    for i in items:
        if i[0] == SLOT:
            found.add(i[1])
        elif i[0] in "?+":
            found |= slot_paths(i[1])
    return found


def constants(items: list) -> list:
    """What a page is matched with: (head, template text, inner) of each unit; no inner where no template text is."""
    out = []
    for unit in groups(items):
        first = head(unit)
        while unit[0][0] == "?" and unit[0][1]:
            unit = unit[0][1]
        if unit[0][0] == SLOT:
            out.append((first, unit[0][2] if template(unit[0]) else None, None))
        else:
            inner = constants(unit[1:-1]) if unit[0][0] == "<" and len(unit) > 2 else []
            out.append((first, None, inner if any(text is not None or below for _, text, below in inner) else None))
    return out


def met_constants(known: list, items: list) -> set[int]:
    """The runs of a page's folded items that meet a template text."""
    found: set[int] = set()
    units = groups(items)
    for op, i1, i2, j1, j2 in opcodes([k[0] for k in known], [head(u) for u in units]):
        if op == "equal":
            for (_, text, inner), unit in zip(known[i1:i2], units[j1:j2]):
                if text is not None and unit[0][0] == SLOT and unit[0][2] == text:
                    found.add(unit[0][3])
                elif inner and unit[0][0] == "<":
                    found |= met_constants(inner, unit[1:-1])
    return found


def furniture(element: str) -> bool:
    name, *marks = marks_of(element)
    return name in FURNITURE or any(m != "main" for m in marks)


def rooted(path: str) -> bool:
    """Whether an article or a main element is on the path."""
    return any(root in marks_of(e) for e in path.split("/") for root in ("article", "main"))


def content_paths(wrapper: list) -> frozenset[str]:
    """The paths of a wrapper's texts that are main text, as far as elements tell."""
    plain = [p for p in slot_paths(wrapper) if not any(furniture(e) for e in p.split("/"))]
    for root in ("article", "main"):
        below = [p for p in plain if any(root in marks_of(e) for e in p.split("/"))]
        if below:
            return frozenset(below)
    return frozenset(plain)


@lru_cache(maxsize=4096)
def content_of(wrapper: str) -> tuple[frozenset[str], list]:
    """The content paths and the constants of a wrapper."""
    items = json.loads(wrapper)
    known = constants(items)
    return content_paths(items), known if any(text is not None or inner for _, text, inner in known) else []


def main_text(page: str | None, content: frozenset[str], known: list | None = None) -> str:
    """The blocks of page on content paths that meet none of the known constants."""
    if not page:
        return ""
    tokens = list(stream(page))
    items, texts, run_of = text_runs(tokens)
    if content and not any(i[0] == SLOT and i[1] in content for i in items):
        content = content_paths(items)
    gone: set[int] = set()
    if known and not any(map(rooted, content)):
        met = met_constants(known, fold([[SLOT, i[1], constant(texts[i[3]]), i[3]] if i[0] == SLOT else i for i in items]))
        varies = [i[3] for i in items if i[0] == SLOT and i[1] in content and i[3] not in met]
        gone = {run for run in met if varies and not varies[0] < run < varies[-1]}
    blocks, now = [], []

    def close() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        if text:
            blocks.append(text)
        now.clear()

    for (kind, path, text), run in zip(tokens, run_of):
        if kind != SLOT:
            close()
        elif run not in gone and "/".join(path) in content:
            now.append(text)
    close()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON)."""
    rows = pages.select(host_of(pages[url_col].cast("string")).alias("host"), pages[html_col].cast("string").alias("html"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, list] = {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                items = page_items(page.as_py() or "")
                of[host] = align(of[host], items) if host in of else items
        salt = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(of), pa.string()), pa.array([salt] * len(of), pa.int32()), pa.array([json.dumps(w) for w in of.values()], pa.string())],
            ["host", "salt", "wrapper"],
        )

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for w in sorted(set(part["wrapper"])):
            whole = json.loads(w) if whole is None else align(whole, json.loads(w))
        return pd.DataFrame({"host": [part["host"].iloc[0]], "salt": [part["salt"].iloc[0]], "wrapper": [json.dumps(whole)]})

    schema = "host string, salt int, wrapper string"
    out = rows.mapInArrow(local, schema)
    for salts in MERGE_SALTS:  # a host with very many tasks is merged as a tree
        out = out.withColumn("salt", F.col("salt") % salts).groupBy("host", "salt").applyInPandas(merged, schema)
    return out.drop("salt")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page."""
    found = cut(wrappers(pages, url_col, html_col))
    rows = pages.select(
        pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"),
        host_of(pages[url_col].cast("string")).alias("host"),
    )
    if (found.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS:
        met = rows.join(F.broadcast(found), "host")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("html", "url"), F.lit(SALTS)).cast("int"))
        met = dealt.join(found.withColumn("salt", salts), ["host", "salt"])
    met = met.select("id", "url", "html", "wrapper")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py(), *content_of(w.as_py())) for p, w in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    out = met.mapInArrow(extracted, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
