"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree.  A node is the path of elements from the root, with their classes and
ids; it keeps the presentation styles seen (the sequence of its children in a page) and the contents seen below it.
With m pages at a node:

* presentation importance: the entropy of its styles, to base m (a node that looks alike everywhere has 0);
* content importance: 1 - the mean over contents of log(pages with that content) / log(m) (unique contents have 1);
* importance: (1 - DECAY ** l) * presentation + DECAY ** l * content, with l children styles.

A branch goes if its importance is below ``LEAST_IMPORTANCE`` on at least ``LEAST_PAGES`` pages of the host, unless it
is part of the article's running text (below ``article`` or ``main`` only elements with a class or id can go: a page
that was copied many times must not lose its text).  What the markup itself declares as surroundings (``nav``,
``footer``, a class like ``sidebar`` or ``cookie``) is a node of importance 0, also on hosts of a few pages.  Where a
page has an ``article`` or ``main``, text outside belongs to the surroundings.

Statistics are counted by (host, node, style or content) with map-side sums, so a host that holds most pages is spread
over all tasks; only (host, node) pairs to remove travel back to the pages, which stay where they are but for one join.

Results for odd input: null or empty html gives empty text; null or unreadable urls form one host; tags that are cut
off, unclosed or nested wrongly are read as far as they go; character references are decoded, also without semicolon;
repeated pages count each.
"""

from __future__ import annotations

import html as markup
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import map_texts
from folioscope.session import materialize

DECAY = 0.9
LEAST_IMPORTANCE = 0.45
LEAST_PAGES = 8

# elements by their meaning in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template iframe object svg math textarea title head select button canvas "
                   "audio video datalist".split())
AROUND = frozenset("nav header footer aside form menu dialog".split())
LANDMARK = frozenset(("article", "main"))
#: An open element of the second kind ends where one of the first kind begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
#: Words that mark surroundings wherever they stand in a class or id.
MARKED = re.compile(
    r"(?:^|[_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|popup|modal|newsletter|"
    r"subscribe|signup|login|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|footer\w*|masthead|comment\w*|disqus|respond|"
    r"repl(?:y|ies)|social\w*|recommend\w*|widget\w*|toolbar|pagination|pager|copyright|skip\w*)(?:$|[_-])", re.I)
#: Words that an article uses as well (``post-header``, ``share-price``): with words of layout about them only.
UNSURE = re.compile(
    r"^(?:(?:site|page|main|top|global|web|layout|cookie|legal)[_-]+)*(?:header|notices?|shar(?:e|ing)|related|search|side|"
    r"tags?)(?:[_-]+(?:bars?|box|buttons?|links?|lists?|icons?|forms?|widget|wrap(?:per)?|container|inner|section|area|"
    r"block|panel|posts|articles|stories|pages|content|top|bottom|left|right|nav|menu|\d+))*$", re.I)
ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|dialog|alert|form|menu|menubar)$", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|title|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?"
    r"(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
#: What a head may hold; any other element ends it.
IN_HEAD = frozenset("html head title meta link base script style noscript template".split())


def surrounding(names: str) -> bool:
    """Whether a class list or an id names surroundings."""
    return any(MARKED.search(name) or UNSURE.match(name) for name in names.split())


class Page:
    """A page's text blocks with the paths of their elements, and the children of every node."""

    __slots__ = ("blocks", "children", "landmark", "_open", "_buffer", "_paths")

    def __init__(self, html: str | None) -> None:
        self.blocks: list[tuple[str, bool, bool, str]] = []  # path, marked, inside a landmark, text
        self.children: dict[str, list[str]] = {}
        self.landmark = False
        self._open: list[tuple[str, str, bool, bool, bool]] = []  # tag, path, marked, landmark, hidden
        self._buffer: list[str] = []
        if html:
            self._read(html)

    def _flush(self) -> None:
        if not self._buffer:
            return
        text = "".join(self._buffer)
        self._buffer.clear()
        if "&" in text:
            text = markup.unescape(text)
        text = _SPACE.sub(" ", text).strip()
        if not text:
            return
        if self._open:
            _, path, marked, landmark, hidden = self._open[-1]
            if not hidden:
                self.blocks.append((path, marked, landmark, text))
        else:
            self.blocks.append(("", False, False, text))

    def _close(self, at: int) -> None:
        del self._open[at:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in IN_HEAD and any(one[0] == "head" for one in self._open):
            self._flush()
            self._close([one[0] for one in self._open].index("head"))
        if tag == "br":
            self._buffer.append(" ")
            return
        if tag not in BLOCK:
            if tag in HIDDEN and tag not in VOID:
                self._flush()
                self._push(tag, attributes)
            return
        self._flush()
        if tag in VOID:
            return
        # a paragraph ends where any block begins
        for at in range(len(self._open) - 1, -1, -1):
            if self._open[at][0] == "p":
                self._close(at)
                break
            if self._open[at][0] in BLOCK:
                break
        if ended := ENDS.get(tag):
            for at in range(len(self._open) - 1, -1, -1):
                if self._open[at][0] in ended:
                    self._close(at)
                    break
                if self._open[at][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        self._push(tag, attributes)

    def _push(self, tag: str, attributes: str) -> None:
        label, marked, hidden, named = tag, tag in AROUND, tag in HIDDEN, False
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                hidden = hidden or name == "hidden"
                if name == "role":
                    marked = marked or bool(ROLES.match(value))
                elif value and name in ("class", "id"):
                    label += ("." if name == "class" else "#") + value.strip()
                    named = named or tag not in ("html", "body", *LANDMARK) and surrounding(value)
        if self._open:
            _, path, above, landmark, concealed = self._open[-1]
            self.children.setdefault(path, []).append(label)
            # a header of the article itself holds its title
            if tag == "header" and landmark:
                marked = False
            label, marked, hidden = f"{path}>{label}", marked or named or above, hidden or concealed
        else:
            landmark, marked = False, marked or named
        if tag in LANDMARK and not marked:
            landmark = self.landmark = True
        self._open.append((tag, label, marked, landmark, hidden))

    def _end(self, tag: str) -> None:
        if tag not in BLOCK and tag not in HIDDEN:
            return
        self._flush()
        for at in range(len(self._open) - 1, -1, -1):
            if self._open[at][0] == tag:
                self._close(at)
                return

    def _read(self, html: str) -> None:
        at, append = 0, self._buffer.append
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                append(html[at:m.start()])
            at = m.end()
            if m[3]:
                tag = m[3].lower()
                if m[2]:
                    self._end(tag)
                else:
                    self._start(tag, m[4])
            elif m[1] and m[1].lower() in ("noscript", "iframe", "textarea", "svg", "template"):
                append(" ")
        if at < len(html):
            append(html[at:])
        self._flush()


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def nodes_of(path: str) -> list[str]:
    """The node itself and all above it, from the root down."""
    parts = path.split(">")
    return [">".join(parts[:i + 1]) for i in range(len(parts))]


def removable(node: str) -> bool:
    """Whether statistics may remove a node: below a landmark only elements with a class or id."""
    parts = node.split(">")
    inside = [i for i, p in enumerate(parts) if re.split(r"[.#]", p, maxsplit=1)[0] in LANDMARK]
    if not inside:
        return len(parts) > 2  # the root and the body hold everything
    return inside[0] < len(parts) - 1 and bool(re.search(r"[.#]", parts[-1]))


def _observe(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """(host, node, kind, value, n): styles and contents of the nodes that statistics may remove."""
    counts: dict[tuple[str, str, bool, int], int] = {}
    can: dict[str, list[str]] = {}
    for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
        page = Page(html)
        seen = set()
        for path, marked, _, text in page.blocks:
            if marked:
                continue
            if path not in can:
                can[path] = [n for n in nodes_of(path) if removable(n)]
            for node in can[path]:
                seen.add((host, node, True, text))
                seen.add((host, node, False, "\n".join(dict.fromkeys(page.children.get(node, ())))))
        for key in seen:
            counts[key] = counts.get(key, 0) + 1
    if not counts:
        return None
    hosts, nodes, kinds, values = zip(*counts, strict=True)
    hashed = pd.util.hash_array(pd.array(values, dtype=object).to_numpy(), categorize=False).view("int64")
    return pa.RecordBatch.from_arrays(
        [pa.array(hosts, pa.string()), pa.array(nodes, pa.string()), pa.array(kinds, pa.bool_()), pa.array(hashed),
         pa.array(list(counts.values()), pa.int64())], names=["host", "node", "content", "value", "n"])


def branches_to_remove(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, node and importance of the branches of low importance."""
    seen = map_texts(pages.select("host", "html"), _observe,
                     T.StructType.fromDDL("host string, node string, content boolean, value long, n long"), "html")
    seen = seen.groupBy("host", "node", "content", "value").agg(F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    sums = seen.groupBy("host", "node").agg(
        F.sum(F.when(~F.col("content"), F.col("n"))).alias("pages"),
        F.count_if(~F.col("content")).alias("styles"),
        F.sum(F.when(~F.col("content"), n * F.log(n))).alias("style_logs"),
        F.sum(F.when(F.col("content"), n)).alias("contents"),
        F.sum(F.when(F.col("content"), n * F.log(n))).alias("content_logs"))
    m = F.col("pages").cast("double")
    base = F.log(m)
    presentation = (base - F.col("style_logs") / m) / base
    content = 1 - F.col("content_logs") / F.col("contents") / base
    weight = F.pow(F.lit(DECAY), F.col("styles"))
    importance = (1 - weight) * presentation + weight * content
    return sums.filter(F.col("pages") >= max(2, least_pages)).select(
        "host", "node", importance.alias("importance")).filter(F.col("importance") < least)


def main_text(html: str | None, removed: frozenset[str] | set[str]) -> str:
    page, out, gone = Page(html), [], {}
    for path, marked, landmark, text in page.blocks:
        if marked or (page.landmark and not landmark):
            continue
        if removed:
            if path not in gone:
                gone[path] = any(n in removed for n in nodes_of(path))
            if gone[path]:
                continue
        out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    branches = materialize(branches_to_remove(rows, least, least_pages), "branches")
    # a host's removed nodes are few: they are kinds of elements, not pages
    lists = branches.groupBy("host").agg(F.collect_set("node").alias("removed"))
    joined = rows.join(F.broadcast(lists), "host", "left") if _small(lists) else rows.join(lists, "host", "left")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batch):
        known: dict[tuple, frozenset] = {}
        texts = []
        for html, removed in zip(batch.column("html").to_pylist(), batch.column("removed").to_pylist(), strict=True):
            key = tuple(removed or ())
            if key not in known:
                known[key] = frozenset(key)
            texts.append(main_text(html, known[key]))
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return map_texts(joined.select("page_id", "url", "html", "removed"), run, schema, "html")


def _small(lists: DataFrame, most_bytes: int = 8 << 20) -> bool:
    """Whether the removed nodes of all hosts may be broadcast; else hosts join by shuffle."""
    size = lists.agg(F.sum(F.expr("aggregate(removed, length(host), (a, x) -> a + length(x) + 64)"))).first()[0]
    return (size or 0) <= most_bytes
