"""Main text of web pages by site style trees.

The pages of a host are merged by element path. For every path the merged tree
knows its presentation styles (sequences of child tags) and contents, each with
the number of pages that show it. A path's importance joins the entropy of its
styles with that of its contents, both relative to the number of pages: a branch
that looks and reads the same on every page has none. An importance found on few
pages is drawn towards 1, so one page removes nothing and five alike ones do.

A branch's score is its importance times a weight. Tags and roles that HTML
itself sets apart from the article (nav, footer, aside, form, ...) weigh 0. A
class or id that sounds like advert, notice or comments weighs little, more if
the branch holds much of the page's words, so a name alone doesn't remove what
is most of a page; inside an element that a page names as its article only whole
class names of adverts and comments count. Branches that score below the bar go.
An article that would lose all its text that way keeps it.

Statistics are summed per (host, path, style or content) with map-side
combination, so a host with a third of all pages is never gathered. Pages meet
their host's short list of paths of low importance by host and a salt that is
the finer the more pages the host has.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator, Mapping
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._spark import HOT_KEYS, cut, lean, table

#: Weight of the styles' own entropy; bar of scores; pages of importance 1 that each path has besides its own.
GAMMA, BAR, PRIOR = 0.9, 0.2, 1.0
#: Weight of a branch whose name sounds like noise, and what all of the page's words would add to it.
NAMED, NAMED_SHARE = 0.1, 0.2
#: Pages of a host that meet its list in one task.
HOST_PAGES = 512
#: Characters of a path that is written out.
LONGEST = 240
#: Contents are known by their words' bytes, read as one number, modulo this prime.
PRIME = (1 << 64) - 59

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'>/]+)")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body", "title", "legend", "summary", "figcaption", "dd", "dt", "li"} | {"li", "dd", "dt"}
SCOPE = frozenset("table td th caption html body article section div main aside nav header footer blockquote form figure details".split())
#: tag -> tags whose open element it ends, up to the given holders
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe button select option optgroup textarea input svg canvas object applet embed audio video map menu head title noframes xmp datalist progress meter".split())
#: Whole class names of adverts and reader comments, also inside a named article.
CERTAIN_NAMES = frozenset("ad ads advert adverts advertisement adsbygoogle sponsored comments comment-list commentlist comments-area disqus_thread".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
NOISE_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar sidebars side aside widget widgets ad ads adv advert adverts advertisement advertising adsense adslot adbox banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments commentlist disqus respond replies reply pagination pager toolbar topbar masthead login search searchform skip outbrain taboola".split()
)
NOISE_JOINED = re.compile(r"side-?bar|nav-?bar|bread-?crumbs?|cookie-|(?:^|[-_])(?:site|page|global|main)[-_]?(?:header|footer|nav|menu)|(?:^|[-_])top[-_]?(?:bar|nav|menu)|adsby", re.I)


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []


class _Marks:
    """Where the next mark of a kind is; places are asked for in rising order, so each kind is searched through once."""

    def __init__(self, source: str) -> None:
        self.source, self.found = source, {}
        self.last = {mark: source.rfind(mark) for mark in (">", '"', "'")}
        self.dead: set[int] = set()

    def next(self, mark: str, at: int) -> int:
        """The first place from `at` on, or the source's length."""
        known = self.found.get(mark, -1)
        if known < at:
            known = self.source.find(mark, at)
            self.found[mark] = known = len(self.source) if known < 0 else known
        return known

    def tag_end(self, at: int) -> int:
        """Behind the '>' that isn't quoted, or -1 where none comes.

        Quotes on the way of a search that found none are dead: a later search
        that comes to one of them ends there.
        """
        source = self.source
        close = self.found.get(">", -1)
        if close < at:
            close = self.next(">", at)
        if close - at < 200 and source.find('"', at, close) < 0 and source.find("'", at, close) < 0 and close < len(source):
            return close + 1  # most tags
        size, seen = len(source), []
        one, two = self.next('"', at), self.next("'", at)
        while True:
            quote = min(one, two)
            if close < quote:
                return close + 1
            if quote == size or quote in self.dead:
                break
            seen.append(quote)
            at = self.source.find(self.source[quote], quote + 1) + 1
            if not at:
                break
            close, one, two = (x if x >= at else size if at > self.last[mark] else self.source.find(mark, at) for x, mark in ((close, ">"), (one, '"'), (two, "'")))
        self.dead.update(seen)
        return -1


def parse(source: str) -> Node:
    """A tree of what the page holds; unclosed and stray tags are taken as browsers take them, more or less.

    A '<' that begins no tag, or a tag that never ends, is text.
    """
    root = Node("#root", {}, None)
    here, at, done, size = root, 0, 0, len(source)
    marks = _Marks(source)
    # how often each tag is open; inline ones also since the last block began
    opened: dict[str, int] = {}
    inline: list[dict[str, int]] = [{}]

    def text(raw: str) -> None:
        if raw:
            here.children.append(html.unescape(raw) if "&" in raw else raw)

    def leave(node: Node) -> None:
        """Out of a node and of all that is open in it."""
        nonlocal here
        while True:
            gone, here = here, here.parent
            opened[gone.tag] -= 1
            if gone.tag in BLOCK:
                inline.pop()
            else:
                inline[-1][gone.tag] -= 1
            if gone is node:
                return

    def enter(node: Node) -> None:
        nonlocal here
        here = node
        opened[node.tag] = opened.get(node.tag, 0) + 1
        if node.tag in BLOCK:
            inline.append({})
        else:
            inline[-1][node.tag] = inline[-1].get(node.tag, 0) + 1

    while (start := source.find("<", at)) >= 0:
        c = source[start + 1 : start + 2]
        if c in ("!", "?") and c:
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                end = size if end < 0 else end + 3
            elif source.startswith("<![CDATA[", start) and (end := marks.next("]]>", start)) < size:
                text(source[done:start])
                here.children.append(source[start + 9 : end])
                done = at = end + 3
                continue
            else:
                end = marks.next(">", start) + 1
                if end > size:
                    at = start + 1
                    continue
            text(source[done:start])
            done = at = end
            continue
        closing = c == "/"
        named = _NAME.match(source, start + 1 + closing)
        end = marks.tag_end(named.end()) if named else -1
        if end < 0:
            at = start + 1
            continue
        text(source[done:start])
        done = at = end
        name, rest = named[0].lower(), source[named.end() : end - 1]
        if closing:
            if not opened.get(name) or name not in BLOCK and not inline[-1].get(name):  # </b> doesn't end the paragraph around it
                if name == "br":
                    here.children.append(Node("br", {}, here))
                continue
            node = here
            while node.tag != name:
                node = node.parent
            leave(node)
            continue
        if name in ENDS_P and opened.get("p"):
            node = here
            while node.parent is not None and node.tag != "p" and node.tag not in SCOPE:
                node = node.parent
            if node.tag == "p":
                leave(node)
        if name in CLOSES and any(opened.get(t) for t in CLOSES[name][0]):
            ended, holders = CLOSES[name]
            node, last = here, None
            while node.parent is not None and node.tag not in holders:
                if node.tag in ended:
                    last = node
                node = node.parent
            if last is not None:
                leave(last)
        attrs = {}
        if rest and rest.strip(" /\n\t"):
            for a in _ATTR.finditer(rest):
                key = (a[1] or a[5]).lower()
                attrs.setdefault(key, html.unescape(a[2] or a[3] or a[4] or "") if a[1] else "")
        node = Node(name, attrs, here)
        here.children.append(node)
        if name in _RAW:
            found = _RAW[name].search(source, at)
            body = source[at : found.start() if found else size]
            node.children.append(html.unescape(body) if name in ("title", "textarea") else body)
            done = at = found.end() if found else size
        elif name not in VOID and (not rest.endswith("/") or name in BLOCK):  # a slash doesn't close what isn't void
            enter(node)
    text(source[done:])
    return root


def apart(node: Node, in_article: bool) -> bool:
    """Whether HTML itself says that this isn't the article: by tag, role or being hidden."""
    if node.tag in NOISE_TAGS or node.tag == "header" and not in_article:
        return True
    if node.tag in ("html", "body", "article", "main", "#root") or not node.attrs:
        return False
    a = node.attrs
    return a.get("role", "").lower() in NOISE_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", ""), re.I))


def sounds_like_noise(node: Node, in_article: bool) -> bool:
    """Whether class or id are names of adverts, notices, menus or comments."""
    a = node.attrs
    if not a or node.tag in ("html", "body", "article", "main", "#root"):
        return False
    if in_article:
        return not CERTAIN_NAMES.isdisjoint(f"{a.get('class', '')} {a.get('id', '')}".lower().split())
    names = f"{a.get('class', '')} {a.get('id', '')}"
    if not names.strip():
        return False
    parts = {p.lower() for p in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", names) if p}
    return bool(parts & NOISE_NAMES) or bool(NOISE_JOINED.search(names)) or "header" in parts


def score(node: Node, in_article: bool, importance: float, share: Callable[[Node], float]) -> float:
    """A branch's importance by its weight; share tells which part of the page's words a node holds."""
    if apart(node, in_article):
        return 0.0
    return importance * (NAMED + NAMED_SHARE * share(node)) if sounds_like_noise(node, in_article) else importance


def path_of(node: Node, above: str) -> str:
    """Tags and first classes from the root on; a long path is its hash, so that deep pages don't cost the square of their depth."""
    cls = node.attrs.get("class", "").split()
    path = f"{above}/{node.tag}" + (f".{cls[0]}" if cls else "")
    return path if len(path) <= LONGEST else "#" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def style_of(node: Node) -> str:
    """The sequence of child tags; repeats count once."""
    out: list[str] = []
    for c in node.children:
        tag = "#" if isinstance(c, str) else c.tag
        if tag == "#" and not c.strip():
            continue
        if not out or out[-1] != tag:
            out.append(tag)
    return ">".join(out)


def text_of(node: Node) -> str:
    """All text under a node in page order, without recursion."""
    parts: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag not in ("script", "style"):
            stack.extend(reversed(c.children))
    return " ".join(" ".join(parts).split())


def branches(root: Node) -> list[tuple[str, Node, int]]:
    """All elements in page order with their paths and a hash of the words of text_of.

    A page's texts are hashed once; what an element holds is a run of them, whose
    hash follows from those of all that lies before its start and its end.
    """
    out: list[tuple[str, Node]] = []
    first: list[tuple[int, int]] = []
    last: list[tuple[int, int]] = []
    before = length = 0
    # an element's number when its end is reached; words of scripts and styles don't count
    stack: list[tuple[Node | str | int, str, bool]] = [(c, "", root.tag not in ("script", "style")) for c in reversed(root.children)]
    while stack:
        c, above, shown = stack.pop()
        if isinstance(c, int):
            last[c] = before, length
        elif isinstance(c, str):
            if shown and (words := c.split()):
                data = (" ".join(words) + " ").encode("utf-8", "surrogatepass")
                before = (before * pow(256, len(data), PRIME) + int.from_bytes(data, "big")) % PRIME
                length += len(data)
        else:
            p = path_of(c, above)
            out.append((p, c))
            first.append((before, length))
            last.append((0, 0))
            shown = shown and c.tag not in ("script", "style")
            stack.append((len(out) - 1, "", False))
            stack.extend((k, p, shown) for k in reversed(c.children))
    return [(p, c, (z - a * pow(256, n - m, PRIME)) % PRIME) for (p, c), (a, m), (z, n) in zip(out, first, last, strict=True)]


def articles(root: Node) -> list[Node]:
    """The outermost elements that a page names as its article, without those inside noise."""
    found: list[Node] = []
    stack: list[Node] = [root]
    order: list[Node] = []
    while stack:
        node = stack.pop()
        order.append(node)
        is_main = node.tag in ("article", "main") or node.attrs.get("role", "").lower() in ("main", "article") or node.attrs.get("itemprop", "").lower() == "articlebody"
        if is_main:
            found.append(node)
            continue
        if node.parent is not None and node.tag != "header" and apart(node, False):
            continue
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    main = [n for n in found if n.tag == "main" or n.attrs.get("role", "").lower() == "main"]
    return main or found


def path_to(node: Node) -> str:
    """The path of an element from the page's root."""
    line: list[Node] = []
    while node.parent is not None:
        line.append(node)
        node = node.parent
    path = ""
    for n in reversed(line):
        path = path_of(n, path)
    return path


def words_of(root: Node) -> dict[int, int]:
    """The number of words under each element, by its id()."""
    out: dict[int, int] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            out[id(node)] = sum(len(c.split()) if isinstance(c, str) else out[id(c)] for c in node.children)
        elif node.tag in ("script", "style", "head"):
            out[id(node)] = 0
        else:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children if not isinstance(c, str))
    return out


def blocks_of(top: Node, inside: bool, low: Mapping[str, float], share: Callable[[Node], float]) -> list[str]:
    """The blocks under an element without branches that score low; `inside` says that a page names it as its article."""
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        block = " ".join("".join(parts).split())
        parts.clear()
        if block:
            blocks.append(block)

    # None ends a block
    stack: list[tuple[Node | str | None, str]] = [(None, ""), (top, path_to(top))]
    while stack:
        c, above = stack.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            parts.append(c)
        elif c.tag in ("br", "wbr"):
            parts.append(" " if c.tag == "br" else "")
        else:
            p = above
            if c is not top:
                p = path_of(c, above) if low else ""
                if score(c, inside, low.get(p, 1.0), share) < BAR:
                    if c.tag in BLOCK:
                        flush()
                    elif apart(c, inside) or text_of(c):
                        parts.append(" ")
                    continue
            if c.tag in BLOCK:
                flush()
                stack.append((None, ""))
            stack.extend((k, p) for k in reversed(c.children))
    flush()
    return blocks


def extract(source: str | None, low: Mapping[str, float] = MappingProxyType({})) -> str:
    """The article's blocks; `low` has the importance of the host's paths where it is below the bar."""
    if not source:
        return ""
    root = parse(source)
    tops = articles(root)
    counts: dict[int, int] = {}

    def share(node: Node) -> float:
        if not counts:
            counts.update(words_of(root))
        return counts.get(id(node), 0) / max(1, counts[id(root)])

    blocks: list[str] = []
    for top in tops or [root]:
        blocks += blocks_of(top, bool(tops), low, share) or (blocks_of(top, True, {}, share) if tops and low else [])
    return "\n\n".join(blocks)


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's paths with their styles and contents, once per page."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            merged: dict[str, list[list[str]]] = {}
            for path, node, content in branches(parse(source)):
                if node.tag not in ("script", "style", "meta", "link", "title", "html", "body", "head"):
                    own = merged.setdefault(path, [[], []])
                    own[0].append(style_of(node))
                    own[1].append(str(content))
            for path, (styles, contents) in merged.items():
                for kind, value in ((0, "|".join(styles)), (1, "|".join(contents))):
                    for col, v in zip(rows, (host, path, kind, _hash(value)), strict=True):
                        col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["host", "path", "kind", "value"])


def style_trees(pages: DataFrame, prior: float = PRIOR) -> DataFrame:
    """pages(host, html) -> host, path, pages, importance."""
    rows = pages.where("host IS NOT NULL AND html IS NOT NULL").select("host", "html").mapInArrow(lean(_tree_rows), "host string, path string, kind int, value long")
    counts = rows.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("c"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, 1)).alias("styles"),
        F.sum(F.when(F.col("kind") == 0, F.col("c") * F.log("c"))).alias("s"),
        F.sum(F.when(F.col("kind") == 1, F.col("c") * F.log("c"))).alias("t"),
    )
    n = F.col("pages")
    entropy = lambda x: F.when(n > 1, (F.log(n) - F.col(x) / n) / F.log(n)).otherwise(1.0)
    own = F.pow(F.lit(GAMMA), F.col("styles"))
    found = (1 - own) * entropy("s") + own * entropy("t")
    return per.select("host", "path", "pages", ((n * found + prior) / (n + prior)).alias("importance"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars.

    Defined results: null and empty pages have the text ''; pages without a host
    are judged without a tree; repeated rows are extracted one by one (and count
    as pages of their host); other columns are ignored; a page of any length is
    read whole, by one task, in time in proportion to its length; an empty table
    gives an empty table.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit("")).alias("host"))
    low = cut(style_trees(own).where(F.col("importance") < BAR).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "importance"))).alias("low")), "low")
    sizes = cut(own.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most HOT_KEYS hosts have so many pages
    hot = sizes.where(F.col("n") > max(HOST_PAGES, total // HOT_KEYS)).select("host", F.ceil(F.col("n") / HOST_PAGES).cast("int").alias("salts"))
    salted = own.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", F.length("html")), F.coalesce("salts", F.lit(1))).cast("int"))
    low = low.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)"))).select("host", "salt", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(source, dict(found or ())) for source, found in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return salted.join(low, ["host", "salt"], "left").select("page_id", "url", "html", "low").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
