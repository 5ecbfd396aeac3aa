"""HTML extraction by consensus host paths.

Pass one scores every page's containers by the text that hangs below them and votes, in Spark, on generalised tag-class
paths per host. Pass two extracts again: the first of the host's winning paths that a page has gives its main text;
a page that has none of them uses its own best container. Boilerplate inside a container (menus, forms, adverts,
comments and so on) is left out by tag, role and class.

A container is left out by its tag, role or hiding attributes, or by a word in a class or id (``DROPPED_WORDS``); words beside such
a word don't save it, but classes that only speak of the layout (``has-sidebar``) don't count, and a container left out by a
word alone that holds an article, main or h1 element stays, since pages wrap their article in such classes. Inline elements
are left out by the same attributes. Tags and attributes are read forgivingly: an attribute's quote that isn't closed ends with its
tag, an omitted ``</head>`` ends at the first element that can't stand in a head.

Null html is empty text, as is a page with nothing but boilerplate. Pages of a null or odd URL share the empty host. Repeated rows
get a row each; votes count them. Paths with equal votes go in alphabetical order, as do a page's own containers of equal score.
Empty tables give empty tables. Pages of any length and depth are read whole, in time in proportion to their length. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, mapped, materialise
from .url_filter import host_and_path, with_hosts

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe template svg math noscript object canvas video audio select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture source input meter progress output".split())
DROPPED_TAGS = frozenset("nav footer aside form button dialog menu fieldset head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer masthead ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notification alert popup modal overlay share sharing social related recommended recommendations "
    "subscribe subscription newsletter signup login widget pagination pager toolbar skip copyright legal disclaimer header topbar".split()
)
LAYOUT_WORDS = frozenset("has no with without layout".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta title style script noscript template".split())
KEPT_TAGS = frozenset("html body main article".split())
#: Elements that end an open element of the same group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre caption figcaption".split())

#: A quoted value ends before white space, a slash or the tag's end; else its quote isn't closed, and the tag ends at the next ">".
_QUOTED = r"\"[^\"]{0,4000}\"(?=[\s/>])|'[^']{0,4000}'(?=[\s/>])"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|{_QUOTED})*+)>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)>")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


@dataclass
class Node:
    tag: str
    path: str
    parent: int
    depth: int
    hard: bool  # left out by tag, role or attribute
    soft: bool  # left out by a word, unless it holds the article
    dropped: bool = False
    weight: float = 0.0
    link: float = 0.0


@dataclass(frozen=True)
class ExtractParams:
    decay: float = 0.6
    main_bonus: float = 1.5
    paths_per_host: int = 5
    broadcast_bytes: int = 16 << 20
    max_path: int = 12
    tags: frozenset = field(default=frozenset("html body main article section div td center table blockquote".split()))


def _generalised(tag: str, attrs: dict[str, str]) -> str:
    """Tag and classes (else the id), with numbers made alike."""
    words = sorted(set(attrs.get("class", "").lower().split())) or attrs.get("id", "").lower().split()[:1]
    return ".".join([tag, *(_DIGITS.sub("0", w) for w in words)])


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in DROPPED_ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _named_boilerplate(attrs: dict[str, str], in_article: bool) -> bool:
    """Whether a class or the id has a dropped word; one that speaks of the layout doesn't count."""
    for name in (*attrs.get("class", "").split(), attrs.get("id", "")):
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & DROPPED_WORDS - ({"header"} if in_article else set()) and not words & LAYOUT_WORDS:
            return True
    return False


def _attributes(text: str) -> dict[str, str]:
    return {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(text)} if text and not text.isspace() else {}


class Page:
    """Containers and text blocks of one page, read in one pass; forgiving about missing and odd tags."""

    def __init__(self, source: str, p: ExtractParams):
        self.p = p
        self.nodes: list[Node] = [Node("", "", -1, 0, False, False)]
        self.blocks: list[tuple[int, str]] = []
        self._text: list[str] = []
        self._link = 0
        self._links = self._breaks = 0
        self._stack = [0]
        self._open_tags: dict[str, int] = {}
        self._hards, self._softs = 0, []  # open elements left out by tag, and by a word
        self._mute: tuple[str, int, int] | None = None  # an inline element left out: tag, depth of it, containers around it
        self._read(source)
        self._flush()
        for x in self.nodes[1:]:
            x.dropped = x.hard or x.soft or self.nodes[x.parent].dropped
        self._score()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                at = self._stack[-1]
                self.blocks.append((at, text))
                self.nodes[at].link += min(self._links, len(text))
        self._text, self._links, self._breaks = [], 0, 0

    def _close(self, k: int) -> None:
        self._flush()
        for i in reversed(self._stack[k:]):
            self._open_tags[self.nodes[i].tag] -= 1
            self._hards -= self.nodes[i].hard
            if self._softs and self._softs[-1] == i:
                self._softs.pop()
        del self._stack[k:]
        if self._mute and len(self._stack) < self._mute[2]:
            self._mute = None

    def _top(self, tags) -> int | None:
        """Place on the stack of the innermost open element with one of the tags."""
        if any(self._open_tags.get(t) for t in tags):
            for k in range(len(self._stack) - 1, 0, -1):
                if self.nodes[self._stack[k]].tag in tags:
                    return k
        return None

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        self._flush()
        if self._open_tags.get("head") and tag not in HEAD_TAGS:
            self._close(self._top({"head"}))
        group, scope = SIBLINGS.get(tag), SCOPES.get(tag, ())
        if self.nodes[self._stack[-1]].tag == "p":
            self._close(len(self._stack) - 1)
        if group:
            k = self._top({*group, *scope}) if scope else len(self._stack) - 1
            if k is not None and self.nodes[self._stack[k]].tag in group:
                self._close(k)
        parent = self._stack[-1]
        up = self.nodes[parent]
        in_article = bool(self._open_tags.get("article") or self._open_tags.get("main"))
        hard = tag in DROPPED_TAGS or tag == "header" and not in_article or _hidden(attrs) and tag not in ("html", "body")
        soft = not hard and tag not in KEPT_TAGS and _named_boilerplate(attrs, in_article)
        if tag in ("article", "main", "h1") and not hard and not self._hards:
            while self._softs:
                self.nodes[self._softs.pop()].soft = False
        self.nodes.append(Node(tag, up.path if tag in LEAVES else self._path(up, _generalised(tag, attrs)), parent, up.depth + 1, hard, soft))
        self._stack.append(len(self.nodes) - 1)
        self._hards += hard
        if soft:
            self._softs.append(len(self.nodes) - 1)
        self._open_tags[tag] = self._open_tags.get(tag, 0) + 1

    def _path(self, up: Node, name: str) -> str:
        """Paths of many elements begin with a hash of their first ones, so that every container has its own."""
        if up.depth and up.depth % self.p.max_path == 0:
            return f"{hashlib.blake2b(up.path.encode(), digest_size=8).hexdigest()}/{name}"
        return f"{up.path}/{name}"

    def _add(self, raw: str) -> None:
        if self._mute:
            return
        if self._open_tags.get("head") and not raw.isspace() and self.nodes[self._stack[-1]].tag == "head":
            self._close(self._top({"head"}))
        text = html_entities.unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._link:
            self._links += len(text.strip())
        if text and not text.isspace():
            self._breaks = 0

    def _read(self, s: str) -> None:
        at = begin = 0  # begin: of text not yet added
        while (lt := s.find("<", at)) >= 0:
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                to = len(s) if end < 0 else end + 3
                m = None
            elif s.startswith(("<!", "<?"), lt):
                end = s.find(">", lt)
                to = len(s) if end < 0 else end + 1
                m = None
            else:
                m = _TAG.match(s, lt)
                if not m:
                    at = lt + 1  # no tag: text
                    continue
                to = m.end()
            if lt > begin:
                self._add(s[begin:lt])
            at = begin = to
            if m:
                at = begin = self._tag(s, to, m[1] or m[4], (m[2] or m[5]).lower(), m[3] or m[6] or "")
        if begin < len(s):
            self._add(s[begin:])

    def _tag(self, s: str, at: int, closing: str | None, tag: str, rest: str) -> int:
        """Where to read on."""
        if closing:
            if self._mute and tag == self._mute[0]:
                self._mute = (tag, self._mute[1] - 1, self._mute[2]) if self._mute[1] > 1 else None
            if tag == "a":
                self._link = max(0, self._link - 1)
            elif tag not in INLINE and tag not in VOID:
                k = self._top({tag})
                if k is not None:
                    self._close(k)
        elif tag in RAW and not rest.endswith("/"):
            end = self._ends(s, tag, at)
            return end
        elif tag == "br":
            self._breaks += 1
            self._text.append(" ")
            if self._breaks > 1:
                self._flush()
        elif tag in VOID:
            if tag == "hr":
                self._flush()
        elif tag in INLINE:
            self._link += tag == "a"
            if self._mute:
                if tag == self._mute[0]:
                    self._mute = (tag, self._mute[1] + 1, self._mute[2])
            elif rest and not rest.endswith("/"):
                attrs = _attributes(rest)
                if _hidden(attrs) or _named_boilerplate(attrs, True):
                    self._mute = (tag, 1, len(self._stack))
        else:
            self._link = 0
            self._open(tag, _attributes(rest))
        return at

    def _ends(self, s: str, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup; the page's end if it has none."""
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(s, at)
        return m.end() if m else len(s)

    def _score(self) -> None:
        """Text counts for its containers, less with each level and with links."""
        for node, text in self.blocks:
            if self.nodes[node].dropped:
                continue
            gain, at = float(len(text)), node
            gain = max(0.0, gain - 2 * self.nodes[node].link) if self.nodes[node].link > len(text) * 0.3 else gain
            while at >= 0 and gain > 1e-6:
                x = self.nodes[at]
                if x.tag not in LEAVES:
                    x.weight += gain * (self.p.main_bonus if x.tag in ("article", "main") else 1.0)
                    gain *= self.p.decay
                at = x.parent

    def candidates(self) -> dict[str, float]:
        """Score of each path."""
        out: dict[str, float] = {}
        for x in self.nodes:
            if x.weight > 0 and not x.dropped and (x.tag in self.p.tags or not x.tag):
                out[x.path] = out.get(x.path, 0.0) + x.weight
        return out

    def best(self) -> str:
        c = self.candidates()
        return max(c, key=lambda k: (c[k], k)) if c else ""

    def text(self, path: str) -> str:
        """Blocks of all containers on a path, in page order."""
        chosen = [False] * len(self.nodes)
        for i, x in enumerate(self.nodes):
            chosen[i] = x.path == path and x.tag not in LEAVES or x.parent >= 0 and chosen[x.parent]
        return "\n\n".join(t for i, t in self.blocks if chosen[i] and not self.nodes[i].dropped)

    def has(self, path: str) -> bool:
        return any(x.path == path and not x.dropped for x in self.nodes)


def host_votes(pages: DataFrame, params: ExtractParams | None = None, html: str = "html", url: str = "url") -> DataFrame:
    """host, path, votes: each page gives each path its score as a share of its best one's; squared, so that clear cases count."""
    p = params or ExtractParams()

    def run(batches):
        for b in batches:
            sums: dict[tuple[str, str], float] = {}
            for u, h in zip(column_of(b, url).to_pylist(), column_of(b, html)):
                c = Page(h.as_py() or "", p).candidates()
                top, host = max(c.values(), default=0.0), host_and_path(u)[0]
                for path, score in c.items():
                    sums[host, path] = sums.get((host, path), 0.0) + (score / top) ** 2
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in sums], pa.string()) for i in (0, 1)] + [pa.array(list(sums.values()), pa.float64())], names=["host", "path", "votes"])

    return mapped(pages.select(url, html), run, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winning_paths(votes: DataFrame, params: ExtractParams | None = None) -> DataFrame:
    """host and its paths, most votes first."""
    p = params or ExtractParams()
    w = Window.partitionBy("host").orderBy(F.desc(F.round("votes", 6)), "path")
    return votes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.paths_per_host).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extracted(pages: DataFrame, params: ExtractParams | None = None, html: str = "html", url: str = "url", id: str = "page_id") -> DataFrame:
    """id, url, text, n_chars and the path used, for every page."""
    p = params or ExtractParams()
    winners = materialise(winning_paths(host_votes(pages, p, html, url), p), "host-paths")
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("paths", "/")) + 64).alias("b")).first()["b"] or 0
    few = size <= p.broadcast_bytes  # else both sides are shuffled by host
    base = with_hosts(pages.select(id, url, html).toDF("id", "url", "html"), "url")
    winners = winners.select(F.col("host").alias("_of"), "paths")
    joined = base.join(F.broadcast(winners) if few else winners, base["_host"] == winners["_of"], "left").select("id", "url", "html", "paths")

    def run(batches):
        for b in batches:
            out, used = [], []
            for h, paths in zip(column_of(b, "html"), column_of(b, "paths").to_pylist()):
                page = Page(h.as_py() or "", p)
                path = next((x for x in paths or () if page.has(x)), None)
                text = page.text(path) if path is not None else ""
                if not text:
                    path = page.best()
                    text = page.text(path)
                out.append(text)
                used.append(path)
            yield pa.RecordBatch.from_arrays([column_of(b, "id"), column_of(b, "url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64()), pa.array(used, pa.string())], names=["id", "url", "text", "n_chars", "path"])

    schema = T.StructType([joined.schema["id"], joined.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("path", T.StringType())])
    return mapped(joined, run, schema).toDF(id, url, "text", "n_chars", "path")
