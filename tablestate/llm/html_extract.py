"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: an element node is a path of labels (tag, classes, id) below the body,
and its style nodes are the sequences of children that pages show there. Over the m pages that have a node,
  presentation importance  = entropy, to base m, of the node's styles: 0 when all pages look alike, 1 when all differ;
  content importance       = 1 - mean entropy, to base m, of the texts right in the node: 0 when every page repeats them;
  composite importance     = (1 - G^l) * presentation + G^l * mean over the styles of the mean over the style's children,
where l is the number of styles, G = 0.9, a node's own texts are one child with their content importance, and a node
that never has children has its content importance alone. It is formed from the leaves up, one level at a time. What m
pages say is drawn towards 1 by evidence (m - 1) / (m + 1), so that few pages cut little.

Branches of low importance are cut from each page. The tree also weighs its nodes: a node's mass is the characters of
its texts, times their importance, with all below it. The deepest node that holds most of a host's mass is its main
branch. Names are features beside the tree: tags and roles of boilerplate are always cut; classes and ids that sound
like boilerplate are cut unless the node holds most of the mass; an element named an article marks a page's article
unless the page has the main branch and the element has nothing to do with it. A page keeps what is in its article,
marked or found by the tree; where there is neither, all that is not cut.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, prepare, small

GAMMA, THRESHOLD = 0.9, 0.3
#: Share of a host's mass, times the evidence, that makes a node dominant.
MAIN_SHARE = 0.5
#: Elements below this depth count to their ancestor there: the tree is formed in as many steps as it has levels.
DEPTH = 48
#: Copies of the hosts' lists, so that a host with a third of all pages is dealt to many tasks.
SALT = 32

#: Comments, tags, tags with a quote that never closes or without an end (they end at the next angle bracket), other
#: markup, text. Quantifiers that give nothing back, and no unquoted < in a tag, keep the scan linear.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)(>?)"
    r"|<[!?/][^>]*+(?:>|\Z)|[^<]++|<",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label".split())
#: Tags that are boilerplate wherever they stand; header only outside an article.
NOISE_TAGS = set("head nav footer aside form script style noscript template button select textarea iframe svg canvas dialog menu object audio video title".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words that name boilerplate when they end, or (second set) begin a class or id.
NOISE_LAST = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising "
    "banner sponsor sponsored promo promotion promotions popup modal overlay cookie cookies consent notice notices alert alerts comment comments "
    "commentlist respond reply replies discussion share sharing social related recommended newsletter subscribe subscription signup login widget widgets toolbar "
    "pagination pager form search copyright legal disclaimer tracking hidden".split()
)
NOISE_FIRST = set("nav navbar menu footer sidebar ad ads advert sponsor sponsored promo cookie cookies consent comment comments share social newsletter subscribe related".split())
#: Words after which a first word is a state of the page, not a name: comments-open, nav-enabled.
STATES = set("open closed enabled disabled active visible on off loaded ready".split())
MAIN_WORDS = set("article post entry story content main body text".split())
MAIN_NAMES = set("article articlebody articlecontent articletext post postcontent postbody posttext entry entrycontent entrybody story storybody storycontent maincontent maintext contentmain contentbody maincol".split())
#: A start tag of one of these ends an open paragraph.
_ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = set("ul ol dl table div section article main body aside nav".split())


@lru_cache(maxsize=50_000)
def _element(tag: str, attributes: str) -> tuple[str, int, bool, bool]:
    """(label, boilerplate: by tag or role 2, by a name 1, names an article, has a name of its own) of a start tag."""
    names: list[str] = []
    noise, main, hidden, sounds = tag in NOISE_TAGS, tag in ("article", "main"), False, False
    for key, value in _ATTR.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            noise |= value.lower() in NOISE_ROLES
            main |= value.lower() in ("main", "article")
        elif key == "itemprop":
            main |= value.lower() == "articlebody"
        elif key in ("hidden", "aria-hidden"):
            hidden |= key == "hidden" or value.lower() == "true"
        else:
            names += value.split()
    for name in names:
        parts = [w.lower() for w in _WORD.findall(name)]
        if not parts:
            continue
        whole = "".join(parts)
        first, last = parts[0], parts[-1]
        own = last == "header" and any(p in MAIN_WORDS for p in parts[:-1])
        state = first in ("has", "no", "with", "without", "is") or last in STATES
        if tag not in ("html", "body") and not state and not own:
            if tag not in ("article", "main") and (last in NOISE_LAST or first in NOISE_FIRST) or tag in ("article", "main") and whole in ("comment", "comments", "ad", "ads", "advert", "sponsored", "promo", "related"):
                sounds = True
        main |= whole in MAIN_NAMES and tag not in ("html", "body")
    if hidden:
        noise = True
    kept = sorted(re.sub(r"\d{3,}", "0", n) for n in names)
    return ".".join([tag, *kept]), 2 if noise else 1 if sounds else 0, main and not noise and not sounds, bool(kept)


@lru_cache(maxsize=200_000)
def _node(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}/{label}") - (1 << 63)


class _Open:
    """An element of a page, linked to the one around it."""

    __slots__ = ("tag", "node", "depth", "noise", "main", "named", "around", "flags")

    def __init__(self, tag: str, node: int, depth: int, noise: int, main: bool, named: bool, around: "_Open | None"):
        self.tag, self.node, self.depth, self.noise, self.main, self.named, self.around = tag, node, depth, noise, main, named, around
        self.flags: tuple | None = None


class HostView:
    """What a host's tree says: nodes to cut, dominant nodes, and the main branch (None if there is none)."""

    __slots__ = ("low", "big", "main")

    def __init__(self, low: frozenset = frozenset(), big: frozenset = frozenset(), main: int | None = None):
        self.low, self.big, self.main = low, big, main


_NOTHING = HostView()
_HEADINGS = frozenset(("h1", "h2", "h3"))


class Page:
    """One page's blocks: (text, the element it stands in), and for each element node its children's labels."""

    __slots__ = ("blocks", "children", "nodes", "marks")

    def __init__(self, source: str):
        self.blocks: list[tuple[str, _Open | None]] = []
        self.children: dict[int, list[str]] = {}
        self.nodes: dict[int, tuple[int, int]] = {}  # node: (the node around it, depth)
        self.marks: list[_Open] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[_Open] = []
        places: dict[str, list[int]] = {}  # of the open elements of each tag
        blocks_at, scopes_at = [-1], [-1]  # of the open elements that are no inline ones, that bound a search
        run: list[str] = []
        match, at, end = _TOKEN.match, 0, len(source)

        def flush() -> None:
            if run:
                text = _SPACE.sub(" ", _html.unescape("".join(run))).strip()
                if text:
                    self.blocks.append((text, stack[-1] if stack else None))
                run.clear()

        def close(k: int) -> None:
            while len(stack) > k:
                name = stack.pop().tag
                places[name].pop()
                if blocks_at[-1] == len(stack):
                    blocks_at.pop()
                if scopes_at[-1] == len(stack):
                    scopes_at.pop()

        def last(name: str) -> int:
            return places[name][-1] if places.get(name) else -1

        while at < end:
            m = match(source, at)
            at = m.end()
            slash, tag, attributes = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
            if tag is None:
                text = m[0]
                if text[0] != "<" or text == "<":
                    run.append(text)
                continue
            if m[7] == "":  # it has no end: no tag
                continue
            tag = tag.lower()
            if slash:  # an end tag
                k = last(tag)
                if tag in INLINE:
                    if k > blocks_at[-1]:
                        if any(e.named for e in stack[k:]):
                            flush()
                        close(k)
                elif k >= 0:
                    flush()
                    close(k)
                continue
            if tag == "br" or tag == "hr" or tag == "wbr":
                run.append(" " if tag != "wbr" else "")
                if tag == "hr":
                    flush()
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                at = stop.end() if stop else end
                continue
            label, noise, main, named = _element(tag, attributes.strip())
            inline = tag in INLINE
            if not inline:
                flush()
                k = last("p") if tag in _ENDS_P else max(map(last, _SAME[tag])) if tag in _SAME else -1
                if k > scopes_at[-1]:
                    close(k)
            elif named:
                flush()
            if attributes.endswith("/") and not inline:
                continue
            top = stack[-1] if stack else None
            up, depth = (top.node, top.depth) if top else (0, 0)
            node = up
            if tag not in ("html", "body") and not (inline and not named) and depth < DEPTH:
                node, depth = _node(up, label), depth + 1
                kids = self.children.setdefault(up, [])
                if not kids or kids[-1] != label:
                    kids.append(label)
                self.children.setdefault(node, [])
                self.nodes[node] = (up, depth)
            new = _Open(tag, node, depth, noise, main, named, top)
            places.setdefault(tag, []).append(len(stack))
            if not inline:
                blocks_at.append(len(stack))
            if tag in _SCOPE:
                scopes_at.append(len(stack))
            stack.append(new)
            if main:
                self.marks.append(new)
        flush()

    @staticmethod
    def _chain(e: _Open | None) -> list[_Open]:
        """The elements around and with e whose flags are not known yet, outermost first."""
        out = []
        while e is not None and e.flags is None:
            out.append(e)
            e = e.around
        return out[::-1]

    def _flags(self, view: HostView, element: _Open | None, marked: bool) -> tuple:
        """(boilerplate, in a marked article, in the main branch, of low importance) of an element by all around it."""
        none = (False, False, view.main == 0, False)
        for e in self._chain(element):
            noise, article, branch, low = e.around.flags if e.around is not None else none
            noise = noise or e.noise == 2 or (e.noise == 1 and e.node not in view.big) or (e.tag == "header" and not (article or branch and view.main != 0))
            article = (article or (marked and e.main)) and not noise
            branch = branch or e.node == view.main
            low = low or (e.node in view.low and (e.named or not article))
            e.flags = (noise, article, branch, low)
        return element.flags if element is not None else none

    def _marked(self, view: HostView) -> bool:
        """Whether the page's own marks count: not if it has the main branch and no mark is around or in it."""
        if view.main is None or view.main not in self.nodes:
            return True
        for e in self.marks:
            if e.node in view.big:
                return True
            while e is not None:
                if e.node == view.main:
                    return True
                e = e.around
        return False

    def text(self, view: HostView = _NOTHING) -> str:
        """The blocks that stay, joined by a space."""
        marked = self._marked(view)
        for _, e in self.blocks:
            self._flags(view, e, marked)
        kept = [(text, e, self._flags(view, e, marked)) for text, e in self.blocks]
        kept = [x for x in kept if not x[2][0]]
        if marked and any(f[1] for _, _, f in kept):
            kept = [x for x in kept if x[2][1]]
        elif view.main is not None and any(f[2] for _, _, f in kept):
            kept = [x for x in kept if x[2][2] or x[1] is not None and x[1].tag in _HEADINGS]
        return " ".join([text for text, _, f in kept if not f[3]] or [text for text, _, _ in kept])

    def features(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Rows (node, kind, value, depth, characters), each once, that the tree is made of.

        Kind 0: the node's style. Kind 1: a text right in the node. Kind 1 + k: value is the node around, which has k
        children on this page, its own texts being one.
        """
        texts: dict[int, dict[int, int]] = {}
        for text, e in self.blocks:
            texts.setdefault(e.node if e is not None else 0, {})[xxhash.xxh64_intdigest(text) - (1 << 63)] = len(text)
        for node, own in texts.items():
            depth = self.nodes[node][1] if node else 0
            for value, n in own.items():
                yield node, 1, value, depth, n
        k: dict[int, int] = {node: 1 for node in texts}
        for up, _ in self.nodes.values():
            k[up] = k.get(up, 0) + 1
        for node in {0, *self.nodes}:
            up, depth = self.nodes.get(node, (0, 0))
            kids = self.children.get(node, [])
            yield node, 0, xxhash.xxh64_intdigest("\n".join(kids)) - (1 << 63), depth, len(kids)
            if node:
                yield node, 1 + k[up], up, depth, 0
        for node in texts:
            yield node, -k[node], 0, self.nodes[node][1] if node else 0, 0


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower().rpartition("@")[2] if m else ""


_COUNTS = pa.schema([("host", pa.string()), ("node", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("depth", pa.int32()), ("chars", pa.int64()), ("pages", pa.int64())])


def _counts(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, depth, chars, c): the features of all pages, with the number of pages that have each.

    Tasks add up what they have seen before it is shuffled; a host's nodes and texts are separate keys, so a host with
    most of the pages is no single group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}

        def out() -> pa.RecordBatch:
            rows = list(zip(*[(*k, v) for k, v in counts.items()])) or [[]] * 7
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _COUNTS)], schema=_COUNTS)

        for batch in batches:
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                if not host or not source:
                    continue
                for feature in Page(source).features():
                    key = (host, *feature)
                    counts[key] = counts.get(key, 0) + 1
            if len(counts) > 200_000:
                yield out()
        yield out()

    counted = pages.select("url", "html").mapInArrow(run, "host string, node long, kind int, value long, depth int, chars long, pages long")
    return counted.groupBy("host", "node", "kind", "value", "depth", "chars").agg(F.sum("pages").alias("c"))


def style_tree(pages: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, node, depth, pages, importance, mass, inner) for each node of each host's style tree. pages: url, html.

    importance is the composite one, before evidence; mass as above; inner: whether the node has children. Node 0 is
    the body. One step for each level, from the deepest up; a step joins a level with the sums of the one below.
    """
    each = _counts(pages)
    style, text, child, own, c = F.col("kind") == 0, F.col("kind") == 1, F.col("kind") > 1, F.col("kind") < 0, F.col("c")
    node = each.groupBy("host", "node", "depth").agg(
        F.sum(F.when(style, c)).alias("pages"),
        F.sum(F.when(style, c * F.log(c))).alias("s"),
        F.count_if(style).alias("l"),
        F.coalesce(F.max(F.when(style, F.col("chars"))) > 0, F.lit(False)).alias("inner"),
        F.avg(F.when(text, F.log(c))).alias("t"),
        F.coalesce(F.sum(F.when(text, c * F.col("chars"))), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(F.when(own, c / -F.col("kind"))), F.lit(0.0)).alias("own"),
        F.coalesce(F.sum(F.when(child, c / (F.col("kind") - 1))), F.lit(0.0)).alias("weight"),
        F.max(F.when(child, F.col("value"))).alias("up"),
    )
    m = F.col("pages")
    look = F.when(m > 1, 1 - F.col("s") / (m * F.log(m))).otherwise(1.0)
    content = F.when(m > 1, 1 - F.least(F.coalesce("t", F.lit(0.0)) / F.log(m), F.lit(1.0))).otherwise(1.0)
    node = keep(node.withColumns({"look": look, "content": content}).drop("s", "t"), "style-nodes")
    deepest = node.agg(F.max("depth")).first()[0]
    out, below = None, None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        level = node.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumns({"sum": F.lit(0.0), "of": F.lit(0.0), "under": F.lit(0.0)})
        else:
            level = level.join(below, ["host", "node"], "left").fillna(0.0, ["sum", "of", "under"])
        of = F.col("of") + F.col("own")
        inside = F.when(of > 0, (F.col("sum") + F.col("own") * F.col("content")) / of).otherwise(1.0)
        share = F.pow(F.lit(gamma), F.col("l"))
        importance = F.when(F.col("inner"), (1 - share) * F.col("look") + share * inside).otherwise(F.col("content"))
        level = keep(level.withColumns({"importance": importance, "mass": F.col("chars") * F.col("content") + F.col("under")}).select("host", "node", "up", "depth", "pages", "importance", "mass", "inner", "weight"), "style-level")
        below = level.groupBy("host", F.col("up").alias("node")).agg(F.sum(F.col("weight") * F.col("importance")).alias("sum"), F.sum("weight").alias("of"), F.sum("mass").alias("under"))
        out = level if out is None else out.unionByName(level)
    return out.select("host", "node", "depth", "pages", "importance", "mass", "inner")


#: Kinds of rows of what the trees say.
_LOW, _BIG, _MAIN = 0, 1, 2


def findings(tree: DataFrame, threshold: float = THRESHOLD, main_share: float = MAIN_SHARE) -> DataFrame:
    """(host, node, kind): nodes to cut, dominant nodes, and each host's main branch: the deepest dominant node with children."""
    m = F.col("pages")
    evidence = (m - 1) / (m + 1)
    low = tree.where((F.col("node") != 0) & (1 - evidence * (1 - F.col("importance")) < threshold)).select("host", "node", F.lit(_LOW).alias("kind"))
    whole = tree.where("node = 0").select("host", F.col("mass").alias("whole"), evidence.alias("sure"))
    shared = tree.where("node <> 0").join(whole, "host")
    big = shared.where((F.col("whole") > 0) & (F.col("mass") / F.col("whole") * F.col("sure") >= main_share))
    main = big.where("inner").groupBy("host").agg(F.max_by("node", F.struct("depth", "mass", "node")).alias("node"))
    return low.unionByName(big.select("host", "node", F.lit(_BIG).alias("kind"))).unionByName(main.select("host", "node", F.lit(_MAIN).alias("kind")))


def _view(rows: list[tuple[int, int]]) -> HostView:
    return HostView(frozenset(n for n, k in rows if k == _LOW), frozenset(n for n, k in rows if k == _BIG), next((n for n, k in rows if k == _MAIN), None))


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_texts(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages.

    Null or empty html: the empty text. Null url, or one without a host: no tree, names alone. Null page_id and repeated
    rows: a row each; repeated pages count in the tree. Very long or deep pages: whole, in memory that grows with the
    page. If all of a page that names leave would go by the tree, it stays. Ties: equal masses at one depth go by node;
    an importance at the threshold stays. Empty table: no rows. Columns other than page_id, url and html are not read.
    """
    spark = prepare(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    said = keep(findings(style_tree(pages), threshold), "style-findings")

    def row(page_id, url, source, view) -> tuple:
        text = Page(source).text(view) if source else ""
        return page_id, url, text, len(text)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 4, _TEXT)], schema=_TEXT)

    out = "page_id long, url string, text string, n_chars long"
    if small(said, 128):
        by_host: dict[str, list] = {}
        for host, node, kind in said.toLocalIterator():  # counted
            by_host.setdefault(host, []).append((node, kind))
        shared = spark.sparkContext.broadcast({h: _view(rows) for h, rows in by_host.items()})

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield batch_of([row(i, u, s, shared.value.get(host_of(u), _NOTHING)) for i, u, s in zip(*(c.to_pylist() for c in b.columns))])

        return pages.mapInArrow(near, out)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of([row(i, u, s, _view([(x["node"], x["kind"]) for x in n or ()])) for i, u, s, n in zip(*(c.to_pylist() for c in b.columns))])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]*)", 1))
    lists = said.groupBy("host").agg(F.collect_list(F.struct("node", "kind")).alias("nodes")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    keyed = pages.withColumns({"host": host, "salt": F.pmod(F.xxhash64("page_id", "html"), F.lit(SALT)).cast("int")})
    return keyed.join(lists, ["host", "salt"], "left").select("page_id", "url", "html", "nodes").mapInArrow(far, out)
