"""Operator 3: main text of web pages by site style trees.

Pages of a host are merged into one tree, whose nodes are taken in two ways: as the path of block
elements (tag with id or first class), and as that path with, at each step, the style of the parent (its
sequence of child blocks) and the place in it, so that siblings without names are told apart.  For each
node are counted, over the n pages of the host that have it, the looks it is presented in (the shape of
the branch below it) and the contents it holds (the text below it).  The entropy of each count over its
maximum, log n, is the node's presentation and content importance; their weighted mean is its importance.

A text of its own on each page makes a content importance of 1.  A branch is low where the mean falls
below that of a bare element whose text tells BITS less than which page it is on (`threshold`), as menus,
notices and footers do that are drawn from a few variants; on hosts of fewer than MANY pages, where it is
nearly the same on all of them.  Low branches are removed, whatever they are called.  A branch with most of a page's
text must be much lower to go, so that articles that a host holds twice don't pass for template.

What the markup says of itself is the prior for what the counts leave open.  Elements that can't be part
of an article (CERTAIN) and classes, ids or roles made of such words (NAMES) go, but for a branch so named
that looks and reads differently on almost every page; where a page marks an article, that article stays
and what stands outside of it goes.

The counts are grouped aggregations with map-side partial sums, so a host with a third of all pages is
no heavier in any task than another.  Only judged nodes go back to the pages.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, shipped, slices, stage

#: A node is judged from so many pages on; from MANY pages on by entropy, on fewer by sameness.
LEAST, MANY = 3, 8
#: Share of presentation in a node's importance; the rest is content.
PRESENTATION = 0.2
#: So many bits less than log n make a content that repeats.
BITS = 0.25
#: Importance below which a node of fewer than MANY pages is low: nearly the same on all of them.
SAME = 0.2
#: How much lower than low a branch with more than half of a page's text must be; how much higher a named one, to stay.
MARGIN, PRIOR = 0.25, 0.2
#: Judged nodes that may be broadcast (9 bytes each).
BROADCAST_NODES = 500_000
LOW, VERY_LOW, HIGH = 1, 2, 3

#: Elements that never hold article text.
CERTAIN = frozenset("head title nav header footer aside form menu dialog script style noscript template svg math iframe object embed applet audio video canvas button select option textarea input label datalist fieldset search".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img nobr".split())
#: Elements that a new one of the same group closes, and what bounds that.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
PARAGRAPH = (("p",), ("button", "table", "td", "th", "caption", "object"))
#: Words of a class, id or role that name what isn't the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion outbrain taboola nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar header masthead footer sidebar side aside rail widget related recommended trending popular share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search searchbox comment comments comentarios kommentare commentaires disqus respond replies reply discussion copyright legal skip pagination pager complementary contentinfo".split()
)
#: Those of them that name reader comments, which look and read differently on every page.
COMMENTS = frozenset("comment comments comentarios kommentare commentaires disqus respond replies reply discussion".split())
ABOUT = (["has"], ["with"], ["no"], ["without"], ["not"])
_WORDS = re.compile(r"[a-z]+|\d+")
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
_SPACE = re.compile(r"\s+")
_MOD, _BASE = (1 << 61) - 1, 0x9E3779B97F4A7C15 % ((1 << 61) - 1)


def _named(attrs: str) -> tuple[str, int]:
    """The part of a node's name that its attributes give, and whether they say that it isn't the article: 0 no, 1 by its words, 2 for certain."""
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    # Ids number things, classes name them.
    name = "#" + re.sub(r"\d+", "0", got["id"]) if got.get("id") else "." + got["class"].split()[0] if got.get("class", "").split() else ""
    out = 2 if "hidden" in got or got.get("aria-hidden") == "true" else 0
    for value in (got.get("class"), got.get("id"), got.get("role")):
        for part in (value or "").split():
            words = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", part).lower())
            # "with-sidebar" names what stands beside the article, not what isn't it.
            if words[:1] not in ABOUT and any(w in NAMES for w in words):
                out = max(out, 2 if any(w in COMMENTS for w in words) else 1)
    return name, out


class Page:
    """Block elements of a page in document order, as parallel lists, and its blocks of text.

    parent, label (tag with id or class), says (what its own markup says: 0 nothing, 1 by its words that
    it isn't the article, 2 for certain, 3 that it is, 4 that it is a form, which may be a whole page's),
    first and last block.  Time and memory are linear in the page, however deep it is.
    """

    def __init__(self, page: str):
        self.parent, self.label, self.says, self.first, self.last = [-1], [""], [0], [0], [0]
        self.children: list[list[int]] = [[]]
        self.blocks: list[tuple[int, str]] = []  # element and text
        self._read(page)

    def _read(self, page: str) -> None:
        tags, stack = [""], [0]  # tag of each element, elements that are open
        opened: dict[str, list[int]] = defaultdict(list)  # depths at which each tag is open
        pieces: list[str] = []

        def flush() -> None:
            if pieces:
                text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
                pieces.clear()
                if text:
                    self.blocks.append((stack[-1], text))

        def close(depth: int) -> None:
            """Closes what is open from that depth on."""
            flush()
            while len(stack) > depth:
                x = stack.pop()
                self.last[x] = len(self.blocks)
                opened[tags[x]].pop()

        def close_nearest(group: tuple[str, ...], bounds: tuple[str, ...]) -> None:
            at = max((opened[t][-1] for t in group if opened[t]), default=0)
            if at and at > max((opened[t][-1] for t in bounds if opened[t]), default=0):
                close(at)

        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                pieces.append(page[at:])
                break
            if m.start() > at:
                pieces.append(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag not in INLINE:
                    if opened[tag]:
                        close(opened[tag][-1])
                    else:
                        flush()
                continue
            if tag in RAW:
                flush()
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = end.start() if end else n
                continue
            if tag in INLINE:
                continue
            if tag in ("br", "hr"):
                pieces.append(" ")
                if tag == "br":
                    continue
            flush()
            if tag in VOID:
                continue
            close_nearest(*PARAGRAPH)  # any block ends a paragraph that is open
            if tag in CLOSES:
                close_nearest(*CLOSES[tag])
            name, out = _named(m[3]) if "=" in m[3] or "hidden" in m[3] else ("", 0)
            if tag in CERTAIN:
                out = 4 if tag == "form" and not out else 2
            elif tag == "main" or (tag == "article" and not (opened["article"] or opened["main"]) and "comment" not in name):
                out = 3  # the article's own names don't count against it
            elif tag in ("html", "body"):
                out = 0
            top, x = stack[-1], len(self.parent)
            self.parent.append(top)
            self.label.append(tag + name)
            self.says.append(out)
            self.first.append(len(self.blocks))
            self.last.append(0)
            self.children[top].append(x)
            self.children.append([])
            opened[tag].append(len(stack))
            tags.append(tag)
            stack.append(x)
        close(1)
        flush()
        self.last[0] = len(self.blocks)

    def keys(self) -> tuple[list[int], list[int]]:
        """Numbers of 63 bits that name each element's plain and placed path."""
        import xxhash

        name = lambda above, label: xxhash.xxh3_64_intdigest(f"{above:x}/{label}") >> 1
        style = [zlib.crc32(">".join([self.label[c] for c in own]).encode("utf-8", "replace")) for own in self.children]
        plain, placed = [1], [2]
        place = {c: i for own in self.children for i, c in enumerate(own)}
        for x in range(1, len(self.parent)):
            up = self.parent[x]
            plain.append(name(plain[up], self.label[x]))
            placed.append(name(placed[up], f"{self.label[x]}@{style[up]:x}.{place[x]}"))
        return plain, placed

    def digests(self) -> tuple[list[int], list[int]]:
        """Numbers of 61 bits for the shape of each branch and for the text below it."""
        import xxhash

        own = [xxhash.xxh3_64_intdigest(t) % _MOD for _, t in self.blocks]
        sums, power = [0], [1]
        for d in own:
            sums.append((sums[-1] * _BASE + d) % _MOD)
            power.append(power[-1] * _BASE % _MOD)
        reads = [(sums[b] - sums[a] * power[b - a]) % _MOD for a, b in zip(self.first, self.last)]
        looks = [0] * len(self.parent)
        for x in range(len(self.parent) - 1, -1, -1):  # children come after their parent
            looks[x] = xxhash.xxh3_64_intdigest(f"{self.label[x]}>{','.join([f'{looks[c]:x}' for c in self.children[x]])}") % _MOD
        return looks, reads

    def counted(self) -> Iterator[tuple[int, int, int]]:
        """Key, look and content of each of the page's nodes that hold text; elements of one plain path are one node."""
        (plain, placed), (looks, reads) = self.keys(), self.digests()
        merged: dict[int, list[int]] = {}
        for x in range(1, len(self.parent)):
            if self.last[x] > self.first[x]:
                yield placed[x], looks[x], reads[x]
                at = merged.setdefault(plain[x], [0, 0])
                at[0] = (at[0] * _BASE + looks[x] + 1) % _MOD
                at[1] = (at[1] * _BASE + reads[x] + 1) % _MOD
        for key, (look, read) in merged.items():
            yield key, look, read

    def main_text(self, judged: dict[int, int] | None = None, marks: bool = True) -> str:
        """The article's blocks, joined by single spaces; judged has LOW, VERY_LOW or HIGH for keys of the host's nodes.

        Without marks the markup says nothing and the counts alone decide.
        """
        plain, placed = self.keys() if judged else ([], [])
        size = [0]
        for _, text in self.blocks:
            size.append(size[-1] + len(text))
        said, low = [0] * len(self.parent), [False] * len(self.parent)
        for x in range(1, len(self.parent)):
            up = self.parent[x]
            found = (judged.get(plain[x]), judged.get(placed[x])) if judged else (None, None)
            says, now = self.says[x] if marks else 0, said[up]
            if says == 1 and HIGH in found:
                says = 0
            if says in (1, 2, 4) and now in (0, 3, 4) or (says, now) in ((2, 1), (3, 0), (3, 4)):
                now = says  # a header or an aside of the article itself is furniture like any other
            said[x], low[x] = now, low[up]
            if now == 0 and not low[x]:
                most = 2 * (size[self.last[x]] - size[self.first[x]]) > size[-1]
                low[x] = VERY_LOW in found or (LOW in found and not most)
        articles = [t for x, t in self.blocks if said[x] == 3]
        # A host that holds one page again and again has nothing that stands out.
        return " ".join(articles or [t for x, t in self.blocks if said[x] == 0 and not low[x]] or [t for x, t in self.blocks if said[x] == 0])


def main_text(page: str, judged: dict[int, int] | None = None, marks: bool = True) -> str:
    return Page(page).main_text(judged, marks)


def host(url: Column) -> Column:
    """The host that an address names, in lower case; '' if it names none."""
    at = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.lower(F.trim(at))


def _log2(x: Column) -> Column:
    return F.log2(x.cast("double"))


def threshold(n: Column) -> Column:
    """Importance below which a node of n pages is low."""
    return F.when(n >= MANY, (1 - PRESENTATION) * (1 - BITS / _log2(n))).otherwise(SAME)


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, key, n (pages) and importance of each node of each host's style tree that two pages or more have."""
    out = pa.schema([("host", pa.string()), ("key", pa.int64()), ("kind", pa.int8()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            hosts, keys, kinds, values = [], [], [], []
            for own, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for key, look, read in Page(page or "").counted():
                    hosts += (own, own)
                    keys += (key, key)
                    kinds += (0, 1)
                    values += (look, read)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((hosts, keys, kinds, values), out)], schema=out)

    seen = shipped(pages).select(host(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "host string, key long, kind byte, value long")
    each = seen.groupBy("host", "key", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    sums = each.groupBy("host", "key", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * _log2(F.col("c"))).alias("s")).filter("n > 1")
    # Entropy of the counts over its maximum, log n.
    share = (_log2(F.col("n")) - F.col("s") / F.col("n")) / _log2(F.col("n"))
    weight = F.when(F.col("kind") == 0, PRESENTATION).otherwise(1 - PRESENTATION)
    return sums.groupBy("host", "key").agg(F.max("n").alias("n"), F.sum(weight * share).alias("importance"))


def judged_nodes(tree: DataFrame) -> DataFrame:
    """host, key and code (LOW, VERY_LOW or HIGH) of the nodes of which the counts say something."""
    n, low, value = F.col("n"), threshold(F.col("n")), F.col("importance")
    many = n >= MANY
    # Rounding mustn't decide where a text is its own on each page.
    code = F.when(value < low - F.when(many, MARGIN).otherwise(0.0), VERY_LOW).when(value < low - 1e-9, LOW).when(many & (value >= low + PRIOR - 1e-9), HIGH)
    return tree.filter(n >= LEAST).select("host", "key", code.cast("byte").alias("code")).filter("code IS NOT NULL")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", marks: bool = True) -> DataFrame:
    """page_id, url, text: the main text of each page, blocks in page order joined by single spaces.

    Null html counts as empty and gives an empty text; a null or broken url belongs to the host ''.
    Repeated rows give repeated rows, and an empty table none.  Broken markup is read as browsers do:
    paragraphs and list items close themselves, unknown ends are skipped, open elements end with the page.
    Other columns, whatever their names, are not looked at.  Without marks the style tree alone decides.
    """
    nodes = judged_nodes(style_tree(pages, url_col, html_col))
    lists = nodes.groupBy("host").agg(F.collect_list("key").alias("keys"), F.collect_list("code").alias("codes"))
    lists = stage(lists.withColumn("size", F.size("keys").cast("long")))
    size = lists.agg(F.sum("size")).first()[0] or 0
    url = F.col(url_col).cast("string")
    rows = shipped(pages).select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), host(url).alias("host"))
    out = "page_id long, url string, text string"
    if size <= BROADCAST_NODES:
        known = {r.host: dict(zip(r["keys"], r["codes"])) for r in lists.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(known)
        return rows.mapInArrow(_texts(lambda: shared.value, marks), out)
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    by = stage(lists.join(hosts, "host"))
    joined = lookup(rows, by, "host", "pages", ["keys", "codes"])
    return joined.mapInArrow(_texts(None, marks), out)


def _texts(known, marks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            if known is not None:
                every = known()
                judged = [every.get(h) for h in part.column(3).to_pylist()]
            else:
                judged = [dict(zip(k, c)) if k else None for k, c in zip(part.column(4).to_pylist(), part.column(5).to_pylist())]
            texts = [main_text(page or "", own, marks) for page, own in zip(part.column(2).to_pylist(), judged)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run
