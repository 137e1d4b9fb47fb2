"""HTML extraction by equivalence classes of tokens that occur alike on the pages of a host.

Tokens of a page are its structural elements (name, class and id under the path of their ancestors) and its text runs (under theirs). A
token's occurrence vector says how often it stands on each page of the host. Tokens with the same vector form a class: what
the pages' program writes together shares a vector, what differs by page does not. A class is valid if it stands on at least ``MIN_PAGES``
pages and half of the host's, holds a structural element, and nests: the elements around its members belong to the class itself or to a
single other class. Valid classes nested into one another are the host's template; its text runs are boilerplate, everything between is a slot.

Slots are extracted in page order. What a slot is for follows from the elements around it: menus, headers, footers, sidebars, adverts, notices, forms,
comments, scripts and styles are left out, but what stands around an article or main region counts for nothing in it unless it is a menu, an aside, a
footer or a list of comments; if the page has an article (else a main) region, the text is that region's; only
pages without either lean on the template, and there blocks that are mostly links go too. Inside an article no text is
dropped for being repeated elsewhere.

Vectors never become rows by page: a vector is represented by a sum of hashes of (page, count), added up before and after
the shuffle, so a host with a third of all pages costs each task one row for each of its tokens. Templates
join back to pages by host; Spark broadcasts them under its size threshold and splits a hot host's pages otherwise.

Defined cases: null and empty html give an empty text; a null url (or one without a host) belongs to the empty host; unclosed, crossed or
unknown tags never fail (an end tag without its start is skipped, a block closes an open paragraph); cut-off tags and references at the end of a page stay
text; repeated pages stay repeated; other columns are kept, a column named like the result is replaced.
"""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from canopyframe.llm.url_filter import canonical
from canopyframe.session import cut, free

MIN_PAGES = 3
LINK_SHARE = 0.5
# Elements that begin a new block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements without end.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements whose content is no markup, or no text for readers.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
# Of these, what holds text of an article or main region.
RAW_OUTSIDE = frozenset({"noscript", "svg"})
# Elements whose articles are not the page's, and words of class and id names of comment lists.
OTHERS = frozenset("nav aside footer".split())
OTHERS_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
# Elements that never hold main text; the second set (also as a class) only outside an article or main region.
LEFT_OUT = frozenset("nav footer aside form button select menu dialog object canvas audio video label input datalist".split())
LEFT_OUT_OUTSIDE = frozenset({"header"})
# Words of class and id names of the same parts; ``STATES`` begin or end names that only say whether a page has such a part.
LEFT_OUT_WORDS = frozenset("ad ads adv advert advertisement advertisements advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar toolbar comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations popup modal overlay widget widgets pagination pager login skip aside form search ticker".split())
STATES = frozenset("has no with without open closed".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# what stands unquoted in a tag holds no <, and nothing is tried twice, so malformed tags cost their own length
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
_SPAN = re.compile(r"<(/?)span\b[^<>]*>", re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(slots=True)
class Element:
    name: str
    path: int
    out: bool
    article: bool
    main: bool
    #: inside a menu, an aside, a footer or a list of comments
    others: bool = False


@dataclass(slots=True)
class Block:
    text: str
    path: int
    token: int
    out: bool
    article: bool
    main: bool
    links: int


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) >> 2


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(source)} if source.strip(" /") else {}


def _enter(name: str, attrs: dict[str, str], up: Element | None) -> Element:
    kind = " ".join(attrs.get(a, "") for a in ("class", "id"))
    words = set()
    for part in kind.split():
        found = [w.lower() for w in _NAME.findall(part)]
        # "has-sidebar" or "comments-open" tells what is elsewhere on the page
        if found and found[0] not in STATES and found[-1] not in STATES:
            words.update(found)
    role = attrs.get("role", "").lower()
    article = (up.article if up else False) or name == "article" or role == "article" or attrs.get("itemprop", "").lower() == "articlebody"
    main = (up.main if up else False) or name == "main" or role == "main"
    out = up.out if up else False
    others = (up.others if up else False) or name in OTHERS or name not in ("main", "body", "html") and bool(words & OTHERS_WORDS)
    opens = article and not (up and up.article) or main and not (up and (up.main or up.article))
    if opens and not others:
        # what is around a region says nothing about it
        out = False
    elif name in ("article", "main", "body", "html"):
        out = out or bool(words & {"comment", "comments", "reply"}) and name == "article"
    else:
        out = (out or name in LEFT_OUT or (name in LEFT_OUT_OUTSIDE or bool(words & LEFT_OUT_OUTSIDE)) and not (article or main) or bool(words & LEFT_OUT_WORDS) or role in LEFT_OUT_ROLES
               or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower())
    return Element(name, _hash(up.path if up else 0, name, kind, role), out, article, main, others)


class Page:
    """Elements and text blocks of one page."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        #: structural token -> (times, token of the element around)
        self.elements: dict[int, list[int]] = {}
        self._stack: list[Element] = []
        self._text: list[str] = []
        self._links = 0
        self._in_link = False
        self._read(source)

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join("".join(self._text).split())
        self._text = []
        links, self._links = self._links, 0
        if text:
            top = self._stack[-1] if self._stack else Element("", 0, False, False, False)
            self.blocks.append(Block(text, top.path, _hash(top.path, "#", text), top.out, top.article, top.main, links))

    def _add(self, run: str) -> None:
        if run:
            run = entities.unescape(run) if "&" in run else run
            self._text.append(run)
            if self._in_link:
                self._links += len(run)

    def _open(self, name: str, attrs: dict[str, str]) -> None:
        element = _enter(name, attrs, self._stack[-1] if self._stack else None)
        up = self._stack[-1].path if self._stack else 0
        self.elements.setdefault(element.path, [0, up])[0] += 1
        self._stack.append(element)

    def _close(self, name: str) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i].name == name:
                del self._stack[i:]
                return

    def _read(self, source: str) -> None:
        at, head = 0, False
        open_ended: set[str] = set()  # raw elements and spans without an end from here on
        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            if not head:
                self._add(source[at: m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name == "head":
                    head = False
                elif name == "a":
                    self._in_link = False
                elif name in BLOCKS or name in LEFT_OUT:
                    self._flush()
                    self._close(name)
                continue
            if name in RAW and not (name in RAW_OUTSIDE and self._stack and (self._stack[-1].article or self._stack[-1].main)):
                if not m[3].rstrip().endswith("/"):
                    end = None if name in open_ended else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    if end is None:
                        open_ended.add(name)
                    at = end.end() if end else (len(source) if name in ("script", "style") else at)
                continue
            if name == "head":
                head = True
            elif name == "body":
                head = False
            if name == "br":
                self._add(" ")
            elif name == "a":
                self._in_link = True
            elif name in BLOCKS or name in LEFT_OUT:
                self._flush()
                if name in BLOCKS and self._stack and self._stack[-1].name == "p":
                    self._stack.pop()
                if name in ("li", "option", "dt", "dd", "tr", "td", "th") and self._stack and self._stack[-1].name == name:
                    self._stack.pop()
                if name not in VOID:
                    self._open(name, _attributes(m[3]))
            elif not head and m[3] and ("class" in m[3] or "id" in m[3] or "hidden" in m[3]) and name == "span":
                # a marked inline part is a block of its own only if it is left out
                part = _enter(name, _attributes(m[3]), self._stack[-1] if self._stack else None)
                if part.out and not (self._stack and self._stack[-1].out) and "span" not in open_ended:
                    depth, end = 1, None
                    for tag in _SPAN.finditer(source, at):
                        depth += -1 if tag[1] else 1
                        if not depth:
                            end = tag.end()
                            break
                    if end is None:
                        open_ended.add("span")
                    at = end or at
        if not head:
            self._add(source[at:])
        self._flush()

    def text(self, template: set[int]) -> str:
        """The remaining slots of the main region."""
        kept = [b for b in self.blocks if not b.out]
        articles, mains = [b for b in kept if b.article], [b for b in kept if b.main]
        # articles outside a main region that holds more text are teasers
        if not any(b.main for b in articles) and sum(len(b.text) for b in mains) > sum(len(b.text) for b in articles):
            articles = []
        for region in (articles, mains):
            if region:
                return "\n".join(b.text for b in region)
        return "\n".join(b.text for b in kept if b.token not in template and b.links <= LINK_SHARE * len(b.text))


def occurrences(pages: DataFrame, html: str, host: str = "host") -> DataFrame:
    """``host, token, up, structural, vector, pages``: every token of a host with its occurrence vector (a sum of hashes); token 0 stands once on every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, int], list] = {}
            for h, source in zip(b.column(0).to_pylist(), b.column(1)):
                source = source.as_py() or ""
                page = Page(source)
                key = _hash("page", source)
                times: dict[int, tuple[int, int, bool]] = {0: (1, 0, True)}
                times.update({t: (n, up, True) for t, (n, up) in page.elements.items()})
                for x in page.blocks:
                    n = times.get(x.token, (0, 0, False))[0]
                    times[x.token] = (n + 1, x.path, False)
                for t, (n, up, structural) in times.items():
                    row = found.setdefault((h, t), [up, structural, 0, 0])
                    row[2] += _hash(key, n) >> 8
                    row[3] += 1
            rows = [(h, t, *v) for (h, t), v in found.items()]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_()),
                 pa.array([str(v) for v in cols[4]], pa.string()), pa.array(cols[5], pa.int64())], names=["host", "token", "up", "structural", "v", "pages"])

    rows = pages.select(F.col(host).alias("host"), F.col(html).cast("string")).mapInArrow(run, "host string, token long, up long, structural boolean, v string, pages long")
    return rows.groupBy("host", "token").agg(F.min("up").alias("up"), F.max("structural").alias("structural"), F.sum(F.col("v").cast("decimal(38,0)")).alias("vector"), F.sum("pages").alias("pages"))


def templates(tokens: DataFrame) -> DataFrame:
    """``host, template``: the text runs of each host's template."""
    whole = tokens.where("token = 0").select("host", F.col("pages").alias("all_pages"))
    # most tokens stand on few pages; only the rest can be in a valid class
    often = tokens.join(whole, "host").where((F.col("pages") >= MIN_PAGES) & (F.col("pages") * 2 >= F.col("all_pages")) & (F.col("token") != 0))
    around = often.where("structural").select("host", F.col("token").alias("up"), F.col("vector").alias("outer"))
    placed = often.join(around, ["host", "up"], "left")
    valid = (placed.groupBy("host", "vector").agg(
        F.max("structural").alias("structural"),
        F.count_distinct(F.when(F.col("outer") != F.col("vector"), F.col("outer"))).alias("outers"))
        .where("structural and outers <= 1").select("host", "vector"))
    return placed.where("not structural").join(valid, ["host", "vector"], "left_semi").groupBy("host").agg(F.collect_set("token").alias("template"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without ``html`` and with its main text as ``name``."""
    hosted = pages.withColumn("__host", canonical(F.col(url))[0])
    # templates() reads the tokens three times; as a table they are read from one parse
    tokens = cut(occurrences(hosted, html, "__host"))
    learnt = cut(templates(tokens)).select(F.col("host").alias("__host"), F.col("template").alias("__template"))
    free(tokens)
    keep = [c for c in pages.columns if c not in (html, name)]
    rows = hosted.join(learnt, "__host", "left").select(*keep, F.col(html).cast("string").alias("__html"), "__template")
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns
            texts = [Page(h.as_py() or "").text(set(t.as_py() or ())) for h, t in zip(b.column(n - 2), b.column(n - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], pa.array(texts, pa.string())], names=[*keep, name])

    return rows.mapInArrow(run, schema)
