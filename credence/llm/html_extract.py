"""Operator 10: main text of web pages by tag-path ratios.

A tolerant scanner turns a page into text runs, each with its root-to-leaf tag path (tags, with the words
of class, id and role).  Text length, punctuation and link text are added up per path; a path's ratio is
its text per node, fused with its punctuation per node and damped by its share of link text.  Ratios are
smoothed over the containers of the page: the paths of a container share their mean, weighted by text and
mass; a container that holds most of the page's mass below it counts as a whole; and what lies in a
container inherits most of its ratio.  A path is content if its smoothed ratio reaches THRESHOLD of the best.

What elements say about themselves are factors of the ratio: ``article`` and ``main`` raise it (MAIN), a
class, id or role that names a menu, sidebar, notice, advert, comment list and the like lowers it (ROLE), a
word that only has such a part ("long-form") a little (PART).  A word names a role if it is one, or is put
together of a role and words that only say where or which ("left-sidebar", "ad-slot").  Menus, footers,
asides, forms, page headers, scripts, styles and hidden elements, by tag or attribute, have no ratio at all.

Defined cases: null and empty pages, and pages without text, give an empty text; unclosed and stray tags
are repaired as browsers commonly do, in time linear in the page; a quote that never ends does not hide the
end of its tag; character references are decoded, unknown ones stay as they are; markup that never ends is
dropped with its text; nothing is cut from long pages; rows repeat as they are; an empty table gives an
empty table; other columns pass, and one named like a column that is added is an error.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import refuse_clash, small_batches, table, worker_state

BATCH_ROWS = 64
#: A path is content if its smoothed ratio is at least this share of the best.
THRESHOLD = 0.35
#: Factors of the ratio: in article or main; named a role; named by a part; a list of links outside of those.
MAIN, ROLE, PART, LINKS = 40.0, 0.02, 0.75, 0.1
#: A path whose text is links to more than this share is a list of links.
LINK_SHARE = 0.5
#: What a container passes on of its ratio, and the share of the page's mass from which it counts as a whole.
INHERITED, MOST = 0.8, 0.6

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg object select button".split())
_DROP_TAGS = frozenset("nav footer aside form head script style noscript template iframe select button option dialog menu svg object audio video canvas textarea title label fieldset input".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("html body div section article main td center".split())
#: Start tags that close an open element of the named kinds, unless one of the barriers lies between.
_CLOSES = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tbody",), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",),
}
_BARRIER = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "option": ("select",), "body": ()}
_CLOSES_P = _BLOCK - {"li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary", "html", "body"}
_P_BARRIER = ("table", "td", "th", "article", "section", "div", "li", "blockquote")
#: Inline elements that end where they are closed, whatever blocks were opened in them.
_LOOSE = frozenset("b i a em strong span u font".split())

#: Words that name something other than content, and words that say where or which.
_ROLES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion promoted banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc sidebar side aside complementary rail widget widgets "
    "header masthead topbar footer foot bottombar contentinfo copyright cookie cookies consent gdpr notice notices alert alertdialog warning popup modal overlay dialog toast paywall "
    "comment comments commentlist respond replies reply disqus discussion reviews share sharing social follow subscribe subscription newsletter signup login search searchbox form "
    "related recommended recommendations trending popular tags taglist hidden skip outbrain taboola sr-only visually-hidden screen-reader-text more-links".split()
)
_WHERE = frozenset(
    "left right top bottom upper lower site page main global primary secondary post posts entry article articles blog news stories links user reader mobile desktop sticky fixed inner outer "
    "wrapper wrap container box block area section list bar panel item items slot unit group link button buttons icons 1 2 3".split()
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_OPEN_QUOTE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_RAW_END = {tag: re.compile(rf"</{tag}\s*/?>|</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW}
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？؟،।]")
_WORDS = re.compile(r"[\s_]+|(?<=[a-z])(?=[A-Z])")


def _factor(word: str, in_main: bool) -> float:
    """What a word of class, id or role says about an element's text."""
    if word in _ROLES:
        return 1.0 if in_main and word == "header" else ROLE  # an article's header is its title
    parts = word.split("-")
    if len(parts) == 1:
        return 1.0
    roles = _ROLES.intersection(parts)
    if in_main:
        roles -= {"header"}
    if not roles:
        return 1.0
    return ROLE if all(p in _ROLES or p in _WHERE for p in parts) else PART


class _Element:
    """An open element, with what it has from those around it."""

    __slots__ = ("tag", "path", "block", "container", "weight", "main", "link")

    def __init__(self, tag, path, block, container, weight, main, link):
        self.tag, self.path, self.block, self.container, self.weight, self.main, self.link = tag, path, block, container, weight, main, link


class _Run:
    """Text of one block with one path."""

    __slots__ = ("path", "container", "parts", "links", "weight", "main")

    def __init__(self, path, container, weight, main):
        self.path, self.container, self.weight, self.main = path, container, weight, main
        self.parts, self.links = [], 0


def _describe(tag: str, attrs: str, above: _Element | None) -> tuple[str, float, bool]:
    """(step of the path, weight, whether it is in the main content)."""
    weight, main = (above.weight, above.main) if above else (1.0, False)
    words: list[str] = []
    is_main = tag in ("article", "main")
    gone = tag in _DROP_TAGS or (tag == "header" and not main)
    if attrs and ("=" in attrs or "hidden" in attrs):
        found = {k.lower(): html_lib.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)}
        words = [w.lower() for w in _WORDS.split(" ".join(found.get(k, "") for k in ("class", "id", "role"))) if w]
        style = found.get("style", "").replace(" ", "").lower()
        gone = gone or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        is_main = is_main or found.get("role") in ("main", "article") or found.get("itemprop") == "articleBody"
    if gone:
        weight = 0.0
    elif words and tag not in ("html", "body", "article", "main"):  # classes of the whole page say nothing about its text
        weight *= min(_factor(w, main) for w in words)
    if is_main and not main:
        weight *= MAIN
    return f"{tag}.{'.'.join(words)}" if words else tag, weight, main or is_main


class _Page:
    """Runs and containers of a page; one pass, and a constant time for each tag."""

    def __init__(self, page: str):
        self.runs: list[_Run] = []
        self.paths: dict[tuple[int, str], int] = {}
        #: (parent, tag, weight) of each container; the page itself is number 0.
        self.containers: list[tuple[int, str, float]] = [(-1, "html", 1.0)]
        self.stack: list[_Element] = []
        self.where: dict[str, list[int]] = {}
        self.fresh = True
        self.scan(page)

    def last(self, tag: str) -> int:
        at = self.where.get(tag)
        return at[-1] if at else -1

    def close_from(self, at: int) -> None:
        while len(self.stack) > at:
            self.where[self.stack.pop().tag].pop()

    def open(self, tag: str, attrs: str) -> None:
        above = self.stack[-1] if self.stack else None
        step, weight, main = _describe(tag, attrs, above)
        path = self.paths.setdefault((above.path if above else 0, step), len(self.paths) + 1)
        container = above.container if above else 0
        if tag in _CONTAINER:
            self.containers.append((container, tag, weight))
            container = len(self.containers) - 1
        at = len(self.stack)
        block = at if tag in _BLOCK else above.block if above else -1
        self.stack.append(_Element(tag, path, block, container, weight, main, tag == "a" or bool(above and above.link)))
        self.where.setdefault(tag, []).append(at)

    def text(self, raw: str) -> None:
        top = self.stack[-1] if self.stack else None
        value = html_lib.unescape(raw) if "&" in raw else raw
        if not value or (self.fresh or not self.runs) and not value.strip():
            return
        weight = top.weight if top else 1.0
        if self.fresh:
            path = self.stack[top.block].path if top and top.block >= 0 else 0
            self.runs.append(_Run(path, top.container if top else 0, weight, bool(top and top.main)))
            self.fresh = False
        run = self.runs[-1]
        if weight < run.weight / 2:
            return  # an inline element that is hidden, a control or named a role
        if weight > run.weight * 2:  # what came before was one
            run.weight, run.parts, run.links = weight, [], 0
        run.parts.append(value)
        if top and top.link:
            run.links += len(value)

    def end(self, tag: str) -> None:
        at = self.last(tag)
        block = self.stack[-1].block if self.stack else -1
        self.fresh = self.fresh or tag in _BLOCK or tag == "br"
        if at < 0 or tag not in _BLOCK and block > at and tag not in _LOOSE:
            return
        self.fresh = self.fresh or block >= at
        self.close_from(at)

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            if not self.fresh and self.runs:
                self.runs[-1].parts.append(" ")
            return
        if tag in _BLOCK:
            self.fresh = True
        if tag in _CLOSES_P and (at := self.last("p")) >= 0 and max(map(self.last, _P_BARRIER)) < at:
            self.close_from(at)
        for kind in _CLOSES.get(tag, ()):
            at = self.last(kind)
            if at >= 0 and max(map(self.last, _BARRIER[tag]), default=-1) < at:
                self.close_from(at)
        if tag not in _VOID:
            self.open(tag, attrs)

    def scan(self, page: str) -> None:
        at, size, last_end = 0, len(page), page.rfind(">")
        while at < size:
            start = page.find("<", at)
            if start < 0:
                self.text(page[at:])
                return
            after = page[start + 1 : start + 3]
            if after[:1] in ("!", "?"):
                found = _OTHER.match(page, start)
            elif after[:1].isascii() and (after[:1].isalpha() or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha()):
                if start > last_end:  # a tag that never ends is dropped with the rest
                    self.text(page[at:start])
                    return
                found = _TAG.match(page, start) or _OPEN_QUOTE.match(page, start)
            else:
                found = None
            if found is None:  # "<" that begins no markup is text
                self.text(page[at : start + 1])
                at = start + 1
                continue
            self.text(page[at:start])
            at = found.end()
            if found.re is _OTHER:
                continue
            tag = found[2].lower()
            if found[1]:
                self.end(tag)
            elif tag in _RAW:
                if tag in _BLOCK:
                    self.fresh = True
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else at if tag == "svg" and found[3].endswith("/") else size
            else:
                self.start(tag, found[3])


def _fused(chars: int, marks: int, nodes: int, links: int) -> float:
    """A path's ratio: text per node and punctuation per node, without the share of links."""
    return math.log1p((chars - 0.9 * links) / nodes) * (1 + math.log1p(marks / nodes)) * (1 - 0.9 * links / chars)


def _smoothed(page: _Page, paths: dict[tuple[int, int, float], list]) -> list[float]:
    """The smoothed ratio of each container, without its weight."""
    n = len(page.containers)
    direct, below = [[0.0, 0] for _ in range(n)], [[0.0, 0.0, 0] for _ in range(n)]
    for (_, container, weight), (chars, marks, nodes, links, _) in paths.items():
        value = _fused(chars, marks, nodes, links) * chars
        direct[container][0] += value
        direct[container][1] += chars
        below[container][0] += value
        below[container][1] += value * weight
        below[container][2] += chars
    for c in range(n - 1, 0, -1):  # a container's number is larger than its parent's
        for i in range(3):
            below[page.containers[c][0]][i] += below[c][i]
    # The mass of a container counts beside its mean, so that one lone sentence doesn't outweigh an article.
    ratio = lambda total, chars: total / chars * math.log1p(chars) if chars else 0.0
    own, passed = [0.0] * n, [(0.0, 1.0)] * n
    for c, (parent, tag, weight) in enumerate(page.containers):
        own[c] = ratio(*direct[c])
        whole = tag not in ("html", "body")
        if whole and below[c][1] >= MOST * below[0][1]:
            own[c] = max(own[c], ratio(below[c][0], below[c][2]))
        if parent >= 0:
            own[c] = max(own[c], INHERITED * passed[parent][0])
        passed[c] = (max(own[c], passed[parent][0] if parent >= 0 else 0.0), weight) if whole else (0.0, weight)
    return own


def main_text(page: str | None) -> str:
    if not page:
        return ""
    scanned = _Page(page)
    runs = [(run, " ".join("".join(run.parts).split())) for run in scanned.runs if run.weight > 0]
    runs = [(run, value) for run, value in runs if value]
    if not runs:
        return ""
    paths: dict[tuple[int, int, float], list] = {}  # text, punctuation, nodes, link text, in the main content
    for run, value in runs:
        p = paths.setdefault((run.path, run.container, run.weight), [0, 0, 0, 0, run.main])
        p[0] += len(value)
        p[1] += len(_PUNCT.findall(value))
        p[2] += 1
        p[3] += min(run.links, len(value))
    ratio = _smoothed(scanned, paths)
    score = {k: ratio[k[1]] * k[2] * (LINKS if p[3] > LINK_SHARE * p[0] and not p[4] else 1.0) for k, p in paths.items()}
    least = THRESHOLD * max(score.values())
    return "\n".join(value for run, value in runs if score[run.path, run.container, run.weight] >= least)


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without ``html``, with the main text and its number of code points."""
    refuse_clash(pages, {text, n_chars}, {html})
    small_batches(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField(text, T.StringType(), False), T.StructField(n_chars, T.LongType(), False)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        worker_state("html_extract")
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = [main_text(v) for v in part.column(part.schema.get_field_index(html)).to_pylist()]
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array([len(v) for v in found], pa.int64())], names=[*[f.name for f in kept], text, n_chars])

    return pages.mapInArrow(run, schema)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", F.col("text"), F.col("n_chars"))
