"""Main text of web pages by a site style tree.

The DOMs of a host are merged by style: a style node is a chain of tags and classes, and every
page contributes to it the text below it (content) and its list of children (presentation). The
entropy of both over the pages says how important a node is (Yi, Liu and Li, 2003): what every
page of a host repeats carries nothing. The same tree over all hosts stands in where a host has
few pages, and a node is dropped only if neither tree finds it important. Elements whose tag,
role or class already says that they are furniture (menus, adverts, forms, comments) are dropped
as well. What is left of the article, or of the body where there is none, is the main text.

Defined cases: null, empty or tagless html gives its plain text, mostly the empty text; a null
or odd address belongs to the host ""; equal pages of a host count once in its tree and those of
all hosts once in the corpus's; unclosed or broken tags are closed as browsers do; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html as references
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BROADCAST_BYTES, mark_first, text_of, with_row_id

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

LEAST_PAGES = 5  # a node of fewer pages says nothing
LIMIT = 0.2  # importance under which a branch goes
PRESENTATION = 0.1  # share of presentation in a node's importance

# Names of elements, roles and classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
ENDS = {  # opening one of these closes an open element of the set, up to the stated borders
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
FURNITURE = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe object embed svg canvas "
    "dialog menu title input label audio video map".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar sidenav aside footer masthead cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist "
    "disqus reply replies related recommended widget toolbar pagination pager skip copyright".split()
)
MAIN = frozenset(("article", "main"))
KEPT = frozenset(("html", "body", "article", "main"))  # no class makes these furniture
# Words that make a class say what state a page is in, not what the element is: no-sidebar, comments-open.
STATES = frozenset("no not without has have with is hide hidden open closed enabled disabled active on off".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z/][^>]*+\Z",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z0-9]+")
MASK = (1 << 64) - 1


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


class Page:
    """The elements of one page in document order, and their pieces of text."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.styles, self.furniture = ["#root"], [-1], [0], [False]
        self.names, self.holds_main = [""], [False]
        self.pieces: list[tuple[int, str]] = []  # element and text; a break is an empty text
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, size = [0], 0, len(source)
        while at < size:
            m = TOKEN.search(source, at)
            stop = m.start() if m else size
            if stop > at:
                self.pieces.append((stack[-1], source[at:stop]))
            if not m:
                break
            at = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            if m["close"] or m["close2"]:
                self._close(stack, tag)
                continue
            self._open(stack, tag, m["rest"] or m["rest2"] or "")
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.IGNORECASE).search(source, at)
                at = end.start() if end else size

    def _close(self, stack: list[int], tag: str) -> None:
        if tag == "br":
            self.pieces.append((stack[-1], " "))
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == tag:
                if tag in BLOCK:
                    self.pieces.append((stack[k], ""))
                del stack[k:]
                return
            # An end tag inside an article or cell does not reach out of it for inline elements.
            if tag not in BLOCK and self.tags[stack[k]] in BLOCK:
                return

    def _open(self, stack: list[int], tag: str, rest: str) -> None:
        if tag in BLOCK:
            self._end_open(stack, {"p"}, BLOCK - {"p"})
        if tag in ENDS:
            self._end_open(stack, *ENDS[tag])
        values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
        names = " ".join(sorted(values.get("class", "").lower().split()))
        number = len(self.tags)
        self.tags.append(tag)
        self.parents.append(stack[-1])
        self.styles.append((self.styles[stack[-1]] * 0x9E3779B97F4A7C15 + _hash(f"{tag}.{names}")) & MASK)
        self.names.append(f"{tag}.{names}")
        self.furniture.append(self._is_furniture(stack, tag, values))
        self.holds_main.append(False)
        if tag in MAIN or values.get("role") == "main":
            for k in stack:
                self.holds_main[k] = True
        if tag in BLOCK:
            self.pieces.append((number, ""))
        elif tag == "br":
            self.pieces.append((stack[-1], " "))
        if tag not in VOID and not rest.endswith("/") or tag in RAW:
            stack.append(number)

    def _end_open(self, stack: list[int], ended: set, borders: set | frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in ended:
                self.pieces.append((stack[k], ""))
                del stack[k:]
                return
            if tag in borders:
                return

    def _is_furniture(self, stack: list[int], tag: str, values: dict) -> bool:
        if tag in FURNITURE or "hidden" in values or values.get("aria-hidden") == "true":
            return True
        inside = any(self.tags[k] in MAIN for k in stack)
        if tag == "header" and not inside:
            return True
        if values.get("role", "") in ROLES or re.search(r"display\s*:\s*none", values.get("style", "")):
            return True
        if tag in KEPT:
            return False
        named = f"{values.get('class', '')} {values.get('id', '')}".lower().split()
        words = {w for name in named if not (parts := set(WORD.findall(name))) & STATES for w in parts}
        return bool(words & CLASSES) or ("header" in words and not inside)

    def styles_seen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each style node of the page: its key, the text below it and its children, as digests."""
        n = len(self.tags)
        text, kids = [0] * n, [0] * n
        for owner, piece in self.pieces:
            words = " ".join(piece.split())
            if words:
                text[owner] = (text[owner] * 31 + _hash(words)) & MASK
        for k in range(n - 1, 0, -1):
            up = self.parents[k]
            text[up] = (text[up] * 31 + text[k]) & MASK
            kids[up] = (kids[up] * 31 + _hash(self.names[k])) & MASK
        folded: dict[int, list[int]] = {}
        for style, a, b in zip(self.styles[1:], text[1:], kids[1:], strict=True):
            pair = folded.setdefault(style, [0, 0])
            pair[0], pair[1] = (pair[0] * 37 + a) & MASK, (pair[1] * 37 + b) & MASK
        keys = np.array(list(folded), dtype=np.uint64).view(np.int64)
        both = np.array(list(folded.values()), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return keys, both[:, 0], both[:, 1]

    def main_text(self, unimportant: frozenset[int] | set[int]) -> str:
        """Blocks of the main part in page order, one line each."""
        n = len(self.tags)
        gone, main = [False] * n, [False] * n
        for k in range(1, n):
            up = self.parents[k]
            low = self.furniture[k] or self.styles[k] in unimportant
            gone[k] = gone[up] or (low and not self.holds_main[k])
            main[k] = main[up] or (self.tags[k] == "article" and not gone[k])
        if not any(main):
            for k in range(1, n):
                main[k] = main[self.parents[k]] or (self.tags[k] == "main" and not gone[k])
        everything = not any(main)
        blocks, line = [], []
        for owner, piece in self.pieces:
            if not piece:
                blocks.append("".join(line))
                line = []
            elif not gone[owner] and (everything or main[owner]):
                line.append(references.unescape(piece))
        blocks.append("".join(line))
        clean = (" ".join(b.split()) for b in blocks)
        return "\n".join(b for b in clean if b)


def _hosted(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    host = F.lower(F.regexp_extract(text_of(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return with_row_id(
        pages.select(
            F.col(key).alias("page_id"), F.col(url).alias("url"), host.alias("host"), text_of(html).alias("html")
        )
    )


def style_nodes(hosted: DataFrame) -> DataFrame:
    """``host, style, pages, importance`` of the style trees of all hosts and of the corpus ("").

    Each distinct page is visited once per host; one of all hosts' visits counts in the corpus.

    Equal values are counted before they are summed up, so a host with a third of all pages is
    spread over its values. A distribution with counts k over m pages has the normalised entropy
    ``1 - sum(k log k) / (m log m)``.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, once, parts = [], [], []
            for host, first, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seen = Page(source).styles_seen()
                hosts += [host] * len(seen[0])
                once += [first] * len(seen[0])
                parts.append(np.column_stack(seen))
            rows = np.concatenate(parts) if parts else np.empty((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hosts, pa.string()),
                    pa.array(once, pa.bool_()),
                    *[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)],
                ],
                names=["host", "once", "style", "content", "children"],
            )

    distinct = mark_first(mark_first(hosted, ["host"], "html", "own"), [], "html", "once").filter("own")
    schema = "host string, once boolean, style long, content long, children long"
    seen = distinct.select("host", "once", "html").mapInArrow(visit, schema)
    value = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value"))
    kinds = F.explode(F.array(value("content"), value("children")))
    by_host = cut_lineage(
        seen.withColumn("_k", kinds)
        .groupBy("host", "style", F.col("_k.kind").alias("kind"), F.col("_k.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("once"), 1)).alias("k_once"))
    )
    shared = by_host.filter("k_once > 0").groupBy(F.lit("").alias("host"), "style", "kind", "value")
    overall = shared.agg(F.sum("k_once").alias("k"))
    counted = by_host.filter("host <> ''").drop("k_once").unionByName(overall)
    spread = F.sum(F.col("k") * F.log("k"))
    entropy = counted.groupBy("host", "style", "kind").agg(F.sum("k").alias("m"), spread.alias("s"))
    share = F.when(F.col("m") > 1, 1 - F.try_divide("s", F.col("m") * F.log("m"))).otherwise(1.0)
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("e")))
    return (
        entropy.withColumn("e", share)
        .groupBy("host", "style")
        .agg(
            F.max("m").alias("pages"),
            ((1 - PRESENTATION) * pick("content") + PRESENTATION * pick("children")).alias("importance"),
        )
    )


def unimportant_styles(nodes: DataFrame, limit: float = LIMIT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host, style`` of branches that neither the host's tree nor the corpus's finds important."""
    low = nodes.filter((F.col("pages") >= least_pages) & (F.col("importance") < limit)).select("host", "style")
    everywhere = nodes.filter("host = ''").select("style", F.col("importance").alias("_all"), F.col("pages").alias("_pages"))
    fine = everywhere.filter((F.col("_pages") >= least_pages) & (F.col("_all") >= limit)).select("style")
    return low.join(fine, "style", "left_anti")


def own_unimportant(hosted: DataFrame, low: DataFrame) -> DataFrame:
    """``_row, styles``: the nodes of each page that are unimportant on its host or everywhere."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(list(set(Page(x).styles[1:])), np.uint64) for x in batch.column(2).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            styles = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(styles)],
                names=["_row", "host", "style"],
            )

    schema = hosted.select("_row", "host").schema.add("style", "long")
    nodes = hosted.select("_row", "host", "html").mapInArrow(visit, schema)
    both = nodes.select("_row", F.explode(F.array_distinct(F.array("host", F.lit("")))).alias("host"), "style")
    return both.join(low, ["host", "style"]).groupBy("_row").agg(F.collect_set("style").alias("styles"))


def extract_main_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", bound: int = BROADCAST_BYTES
) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page.

    The unimportant nodes are sent to all tasks while they are few; beyond the bound the nodes of
    each page meet them in a join, and a page gets those of its own.
    """
    hosted = _hosted(pages, key, url, html)
    low = cut_lineage(unimportant_styles(style_nodes(hosted)))
    n_low = low.count()
    schema = hosted.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    if n_low * 120 <= bound:
        known: dict[str, set[int]] = {}
        for r in low.collect():
            known.setdefault(r["host"], set()).add(r["style"] & MASK)
        sent = hosted.sparkSession.sparkContext.broadcast(known)
        wide = hosted.withColumn("styles", F.lit(None).cast("array<long>"))
    else:
        sent = None
        wide = hosted.join(cut_lineage(own_unimportant(hosted, low)), "_row", "left").withColumn(
            "styles", F.coalesce("styles", F.array().cast("array<long>"))
        )
    wide = wide.select("page_id", "url", "host", "html", "styles")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, sources, lists = (batch.column(i).to_pylist() for i in (2, 3, 4))
            out = []
            for host, source, styles in zip(hosts, sources, lists, strict=True):
                if sent is not None:
                    drop = sent.value.get(host, set()) | sent.value.get("", set())
                else:
                    drop = {s & MASK for s in styles}
                out.append(Page(source).main_text(drop))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return wide.mapInArrow(extract, schema)
