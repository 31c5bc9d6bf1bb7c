"""Main text of web pages: what the pages of a host have in common is no part of any of them.

Every page is read into elements; the hashes of their subtrees are counted per host in Spark, and subtrees that recur on
many pages of a host are deleted. What is left of navigation, adverts, forms and comments is told by its markup, and the
blocks of the article remain.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.storage import cut, holding

#: A subtree is a template if it recurs on so many different pages of its host, and on such a share of them. The share
#: bounds the number of a host's templates by its pages' mean number of subtrees over the share.
LEAST_PAGES, SHARE = 10, 0.1
#: Templates (a host and a hash each, some 60 MB in all) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_TEMPLATES = 1_000_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd tr caption figcaption hr summary".split())
_BLOCK = _PROSE | frozenset(
    "address article aside body center details dialog dir div dl fieldset figure footer form header hgroup html legend main "
    "menu nav ol optgroup option section table tbody tfoot thead ul template search".split()
)
#: Cells of a row stand side by side, and a line break is white space of its block.
_GAP = frozenset("br td th".split())
#: An open element of the values ends where one of the keys begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What no ending or implied ending reaches across.
_SCOPE = frozenset("article aside body button details div footer form header html li main nav section table td th ul ol dl".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

#: Elements that never are main text.
_OUT = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object svg canvas dialog menu title search xmp noembed noframes".split())
#: Words of classes, ids and roles that mark what is not main text.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside complementary footer contentinfo masthead cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup "
    "modal overlay dialog share sharing social related recommended recommendations comment comments commentlist respond disqus reply replies "
    "widget toolbar pagination pager skip login signup search".split()
)
_HEADER = frozenset("header topbar".split())

_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|(!--)|([!?/]))")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in _RAW}


class Page:
    """The elements of one page in their order, and its text between them.

    ``tag``, ``parent``, ``out`` (is not main text by its markup) and ``hash`` (of the whole subtree: tags, attributes,
    text; 0 without text) have an entry for each element; ``flow`` lists (element, text), text None where a block begins
    or ends and a space between cells. Broken markup is read as browsers do in common cases: paragraphs, items, rows and
    cells end where the next begins, inline elements end with their block, stray ends are ignored.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.main = ["#page"], [0], [False], [False]
        self._attrs, self._open = [""], [0]
        self.flow: list[tuple[int, str | None]] = []
        at, end = 0, len(source)
        while m := _TAG.search(source, at):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[7]:
                k = source.find("-->", at)
                at = end if k < 0 else k + 3
            elif m[8]:
                k = source.find(">", at - 1)
                at = end if k < 0 else k + 1
            else:
                close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
                name = name.lower()
                if close:
                    self._end(name)
                    continue
                self._begin(name, attrs)
                if name in _RAW:
                    k = _CLOSE[name].search(source, at)
                    stop = k.start() if k else end
                    self._text(source[at:stop], name in ("title", "textarea"))
                    at = stop
        if at < end:
            self._text(source[at:])
        self._hash()

    def _text(self, raw: str, refs: bool = True) -> None:
        self.flow.append((self._open[-1], html.unescape(raw) if refs and "&" in raw else raw))

    def _pop(self, k: int) -> None:
        for e in reversed(self._open[k:]):
            if self.tag[e] in _BLOCK:
                self.flow.append((self.parent[e], None))
        del self._open[k:]

    def _implied(self, names, stop=_SCOPE) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            t = self.tag[self._open[k]]
            if t in names:
                self._pop(k)
                return
            if t in stop:
                return

    def _begin(self, name: str, attrs: str) -> None:
        if name in _BLOCK:
            self._implied({"p"})
        if name in _ENDS:
            self._implied(_ENDS[name], {"ul", "ol", "dl", "table", "select", "article", "section", "div"} - _ENDS[name])
        up = self._open[-1]
        me = len(self.tag)
        self.tag.append(name)
        self.parent.append(up)
        attrs = attrs.strip().rstrip("/")
        self._attrs.append(" ".join(attrs.split()))
        got = {a.lower(): b or c or d or "" for a, b, c, d in _ATTR.findall(attrs)} if attrs else {}
        words = {w.lower() for k in ("class", "id", "role") if got.get(k) for w in _WORDS.findall(got[k])}
        role = got.get("role", "").lower()
        self.main.append(name in ("article", "main") or role in ("main", "article") or got.get("itemprop", "").lower() == "articlebody")
        hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
        self.out.append(name in _OUT or hidden or (name not in ("body", "html") and bool(words & _MARKS) or name != "body" and "ad" in words))
        if name == "header" or (words & _HEADER and name in ("div", "section", "header")):
            self.out[me] = None  # its headings are text where it heads an article
        if name in _BLOCK:
            self.flow.append((me, None))
        elif name in _GAP:
            self.flow.append((up, " "))
        if name not in _VOID:
            self._open.append(me)

    def _end(self, name: str) -> None:
        block = name in _BLOCK
        for k in range(len(self._open) - 1, 0, -1):
            t = self.tag[self._open[k]]
            if t == name:
                self._pop(k)
                return
            if t in _SCOPE and name in ("p", "li", "dt", "dd", "tr", "td", "th") and t not in ("li", "td", "th"):
                break
            if not block and t in _BLOCK:
                return
        if name == "p":
            self.flow.append((self._open[-1], None))

    def _hash(self) -> None:
        """Each subtree's hash from those of its parts, the last elements first; white space counts as one space."""
        import xxhash

        n = len(self.tag)
        parts: list[list] = [[] for _ in range(n)]
        for e, text in self.flow:
            if text and (words := text.split()):
                parts[e].append((" ".join(words), -1))
        self.hash = [0] * n
        full = [False] * n
        kids: list[list[int]] = [[] for _ in range(n)]
        for e in range(n - 1, 0, -1):
            full[e] = full[e] or bool(parts[e])
            if full[e]:
                h = xxhash.xxh64(f"{self.tag[e]} {self._attrs[e]}\0")
                for text, _ in parts[e]:
                    h.update(text)
                    h.update("\0")
                for k in reversed(kids[e]):
                    h.update(self.hash[k].to_bytes(8, "little", signed=True))
                self.hash[e] = int.from_bytes(h.digest(), "little", signed=True)
                full[self.parent[e]] = True
                kids[self.parent[e]].append(e)

    def _heads(self, gone: frozenset | set) -> tuple[list[bool], list[int]]:
        """(whether an element is left out, its main element or 0); deleted subtrees are ``gone``.

        Of prose within an article only its markup decides: a sentence that many articles quote is theirs.
        """
        n = len(self.tag)
        left, main = [False] * n, [0] * n
        for e in range(1, n):
            up, out = self.parent[e], self.out[e]
            if out is None:
                out = not main[up]
            elif self.out[up] is None and main[up] and self.tag[e] not in _HEADINGS:
                out = True
            inside = main[up] and self.tag[e] in _PROSE
            left[e] = left[up] or bool(out) or (not inside and not self.main[e] and self.hash[e] in gone)
            main[e] = main[up] or (e if self.main[e] and not left[e] else 0)
        return left, main

    def blocks(self, gone: frozenset | set = frozenset()) -> list[str]:
        """The blocks of the main text: those in articles, else in the main element, else all that is left."""
        left, main = self._heads(gone)
        articles = {e for e in set(main) - {0} if self.tag[e] != "main"}
        if articles:
            chosen = [self._within(e, articles) for e in range(len(self.tag))]
        elif any(main):
            chosen = [bool(x) for x in main]
        else:
            chosen = [True] * len(self.tag)
        out, held = [], []
        for e, text in [*self.flow, (0, None)]:
            if text is None:
                if held and (words := "".join(held).split()):
                    out.append(" ".join(words))
                held = []
            elif chosen[e] and not left[e]:
                head = self.out[e] is None
                if not head:
                    held.append(text)
        return out

    def _within(self, e: int, chosen: set[int]) -> bool:
        while e and e not in chosen:
            e = self.parent[e]
        return e in chosen

    def subtrees(self) -> list[int]:
        """The different hashes of the subtrees that may be templates: blocks with text, but not the page as a whole."""
        return list({self.hash[e] for e in range(1, len(self.tag)) if self.hash[e] and self.tag[e] in _BLOCK and self.tag[e] not in ("html", "body", "article", "main")})


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; else the empty string."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


def templates(pages: DataFrame, url: str = "url", source: str = "html", least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, h): the hashes of the subtrees that recur on ``least`` different pages of a host and a ``share`` of them.

    Pages of a host with equal main text are one page, so copies make no templates. Counting is by distinct (host, hash,
    page) and then by sums that tasks add up first, so a host with a third of all pages meets in no one task. Pages
    without host have no templates, for they share no site.
    """
    import pyarrow as pa
    import xxhash

    def run(batches):
        for b in batches:
            hosts, own, marks = [], [], []
            for host, raw in zip(b.column(0).to_pylist(), b.column(1)):
                page = Page(raw.as_py() or "")
                hosts.append(host)
                own.append(int.from_bytes(xxhash.xxh64("\n".join(page.blocks())).digest(), "little", signed=True))
                marks.append(page.subtrees())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(own, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], names=["host", "page", "hs"])

    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(source).alias("html")).where("host <> ''")
    marks = rows.mapInArrow(run, "host string, page long, hs array<long>")
    seen = marks.select("host", "page", F.explode(F.concat("hs", F.array(F.lit(0).cast("long")))).alias("h")).distinct()
    n = cut(seen.groupBy("host", "h").agg(F.count("*").alias("n")).where(f"n >= {least}"), "recurring")  # h = 0 counts the pages
    host = n.where("h = 0").select("host", F.col("n").alias("pages"))
    found = n.where("h <> 0").join(host, "host").where(F.col("n") >= share * F.col("pages"))
    return holding(found.select("host", "h"), n)


def extract(pages: DataFrame, *keep: str, url: str = "url", source: str = "html", least: int = LEAST_PAGES, share: float = SHARE, limit: int = BROADCAST_TEMPLATES) -> DataFrame:
    """The columns ``keep`` of each row, ``text`` (blocks joined by a line break) and ``n_chars``, its code points.

    Null and empty pages and such without main text have an empty text; a null URL has no host, and its page loses what
    its markup tells alone; repeated rows stay repeated; an empty table stays empty; pages are read whole, one at a time.
    Columns may have any names: clashes with ``text`` and ``n_chars`` raise, since a result cannot hold both.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    if clash := {"text", "n_chars"} & set(keep):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    found = templates(pages, url, source, least, share)
    each = cut(found.groupBy("host").agg(F.collect_list("h").alias("__gone")), "templates")
    size = each.agg(F.sum(F.size("__gone"))).first()[0] or 0
    rows = pages.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keep)), F.col(source).alias("__html"), host_of(F.col(url)).alias("host"))
    joined = rows.join(F.broadcast(each) if size <= limit else each, "host", "left")
    kinds = [T.StructField(k, pages.schema[k].dataType, True) for k in keep]
    schema = T.StructType([*kinds, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = []
            for raw, gone in zip(b.column(len(keep)), b.column(len(keep) + 1)):
                texts.append("\n".join(Page(raw.as_py() or "").blocks(frozenset(gone.as_py() or ()))))
            cols = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=schema.names)

    out = joined.select(*(f"__k{i}" for i in range(len(keep))), "__html", "__gone").mapInArrow(run, schema)
    return holding(out, found, each)
