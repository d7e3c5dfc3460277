"""Main text of web pages by site template removal.

Every page is parsed into its elements. The subtree of each block element (tag, texts, subtrees of its children) is
hashed together with the page's host; Spark counts on how many pages of the host, with different main texts, each
subtree stands; subtrees that recur on many of them are deleted. Prose inside the page's content element has to recur
on half of the host's pages, containers there on three tenths, all else on a few. What no count can tell, as on hosts
of few pages, is told by tags, roles and class names. What remains of the content element (``article``, else ``main``,
else a container named as content, else the body) is the text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, lean, named, stored
from .url_filter import split_url

#: Least number of pages, and least share of the host's pages, on which a subtree recurs: outside the content, a container of it, prose of it.
MANY = ((3, 0.005), (4, 0.3), (10, 0.5))

#: Up to this many templates (24 bytes each) are broadcast; beyond, pages are joined with theirs.
MOST_BROADCAST = 200_000

TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

words = lambda s: frozenset(s.split())
# Elements and names as the HTML standard and common page designs have them.
VOID = words("area base br col embed hr img input link meta param source track wbr")
RAW = words("script style textarea title noscript iframe noembed noframes xmp")
HEAD = words("base link meta noscript script style template title")
HEADINGS = words("h1 h2 h3 h4 h5 h6")
PROSE = HEADINGS | words("p blockquote pre li dt dd td th caption figcaption")
BLOCKS = HEADINGS | words("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul")
CELLS = words("td th")
ENDS = {"li": (words("li"), words("ul ol menu dir")), "dt": (words("dt dd"), words("dl")), "dd": (words("dt dd"), words("dl")), "tr": (words("tr"), words("table")), "td": (CELLS, words("table tr")), "th": (CELLS, words("table tr")),
        "tbody": (words("tbody thead tfoot"), words("table")), "thead": (words("tbody thead tfoot"), words("table")), "tfoot": (words("tbody thead tfoot"), words("table")), "option": (words("option"), words("select datalist"))}
WALLS = words("table td th caption object template button")
GONE = words("head script style noscript template iframe object embed svg canvas audio video button select datalist textarea input title noembed noframes xmp dialog menu progress meter")
SOFT = {"nav": "menu", "header": "header", "footer": "footer", "form": "form", "fieldset": "form", "search": "form"}
ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "form": "form", "alert": "notice", "alertdialog": "notice", "dialog": "notice", "status": "notice"}
NAMES = {
    "menu": words("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar toc"), "header": words("header masthead topbar"), "footer": words("footer copyright colophon"),
    "side": words("sidebar aside related recommended recommendations widget widgets outbrain taboola teaser teasers"), "ad": words("ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promotion"),
    "notice": words("notice notices cookie cookies consent gdpr banner alert popup modal overlay newsletter subscribe subscription paywall disclaimer"),
    "form": words("form login signin signup search share sharing social"), "comment": words("comment comments disqus replies respond discussion"),
}
KIND = {w: kind for kind, listed in NAMES.items() for w in listed}
NOT = words("no not with without has have hide is")
CONTENT = words("content main-content maincontent article article-body article-content articlebody post post-body post-content entry entry-content story story-body page-content")
HARD = words("side ad comment")  # an article inside one of these is not the page's


class Page:
    """Elements in page order: parent, tag, kind (why it may not be content), digest, numbers of characters."""

    def __init__(self, text: str, host: str = ""):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#"]
        self.kind: list[str | None] = [None]
        self.names: list[frozenset] = [frozenset()]
        self.digest: list[bytes | None] = [None]
        self.chars: list[int] = [0]
        self.linked: list[int] = [0]
        self.links: list[int] = [0]
        self.pieces: list[tuple[int, int, str]] = []  # (element, block, text)
        self._stack, self._parts, self._open, self._block, self._host = [0], [[]], Counter(), 0, host.encode("utf-8", "surrogatepass")
        self._read(text)
        while self._stack:
            self._close()
        self._settle()

    def _text(self, raw: str) -> None:
        at = self._stack[-1]
        if self.tag[at] == "head":
            if not raw.strip():
                return
            self._close()
            at = self._stack[-1]
        text = entities.unescape(raw) if "&" in raw else raw
        self.pieces.append((at, self._block, text))
        if plain := " ".join(text.split()):
            self.chars[at] += len(plain)
            self._parts[-1].append(b"t" + plain.encode("utf-8", "surrogatepass"))

    def _begin(self, tag: str, attributes: str) -> int:
        n = len(self.tag)
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        kind, names = "gone" if tag in GONE else SOFT.get(tag, "side" if tag == "aside" else None), frozenset()
        if attributes and kind != "gone":
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden":
                    kind = kind or ("gone" if value.lower() != "until-found" else None)
                elif name == "role":
                    kind = kind or ROLES.get(value.lower())
                    names |= {"role=" + value.lower()}
                elif name == "itemprop":
                    names |= {"content"} if value == "articleBody" else frozenset()
                else:
                    listed = value.split()
                    names |= {v.lower() for v in listed}
                    if kind is None and tag not in ("html", "body", "main"):
                        for v in listed:
                            parts = [w.lower() for w in WORD.findall(v)]
                            if not NOT.intersection(parts):
                                kind = next((KIND[w] for w in parts if w in KIND and not (w == "header" and tag in HEADINGS)), kind)
        self.kind.append(kind)
        self.names.append(names)
        self.digest.append(None)
        self.chars.append(0)
        self.linked.append(0)
        self.links.append(int(tag == "a"))
        return n

    def _open_element(self, tag: str, attributes: str) -> None:
        if self._open["head"] and tag not in HEAD and tag not in ("html", "head"):
            self._close_to("head")
        if tag in BLOCKS:
            if self._open["p"]:
                self._close_until(frozenset(("p",)), WALLS)
            self._block += 1
        if tag in ENDS and any(self._open[t] for t in ENDS[tag][0]):
            self._close_until(*ENDS[tag])
        if tag in HEADINGS and self.tag[self._stack[-1]] in HEADINGS:
            self._close()
        if tag in ("html", "body") and self._open[tag]:
            return
        n = self._begin(tag, attributes)
        if tag == "br" or tag in CELLS:
            self.pieces.append((self._stack[-1], self._block, " "))
        elif tag == "hr":
            self._block += 1
        if tag not in VOID:
            self._stack.append(n)
            self._parts.append([])
            self._open[tag] += 1

    def _close(self) -> None:
        n, parts = self._stack.pop(), self._parts.pop()
        tag, up = self.tag[n], self.parent[n]
        self._open[tag] -= 1
        if tag in BLOCKS:
            self._block += 1
        elif tag in CELLS:
            self.pieces.append((n, self._block, " "))
        if parts:
            body = tag.encode("utf-8", "surrogatepass") + b"\0" + b"\0".join(parts)
            if self._parts:
                self._parts[-1].append(b"e" + xxhash.xxh3_128_digest(body))
            if tag in BLOCKS and tag not in ("html", "body"):
                self.digest[n] = xxhash.xxh3_128_digest(self._host + b"\0" + body)
        if up >= 0:
            self.chars[up] += self.chars[n]
            self.links[up] += self.links[n]
            self.linked[up] += self.chars[n] if tag == "a" else self.linked[n]

    def _close_to(self, tag: str) -> None:
        while self.tag[self._stack[-1]] != tag:
            self._close()
        self._close()

    def _close_until(self, tags: frozenset, walls: frozenset) -> None:
        for at in reversed(self._stack):
            if self.tag[at] in tags:
                return self._close_to(self.tag[at])
            if self.tag[at] in walls:
                return None
        return None

    def _end(self, tag: str) -> None:
        if not self._open[tag] or tag in ("html", "body"):
            return
        block, table = tag in BLOCKS or tag in CELLS, tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption")
        for at in reversed(self._stack):
            seen = self.tag[at]
            if seen == tag:
                return self._close_to(tag)
            if (not block and (seen in BLOCKS or seen in CELLS)) or (not table and seen in WALLS) or (table and seen == "table"):
                return None

    def _read(self, text: str) -> None:
        at, lower = 0, None
        for _ in range(len(text) + 1):
            m = TAG.search(text, at)
            if m is None:
                break
            if m.start() > at:
                self._text(text[at : m.start()])
            at, tag = m.end(), m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
                continue
            self._open_element(tag, m[3])
            if tag in RAW and self.tag[self._stack[-1]] == tag:
                lower = lower if lower is not None else text.lower() if len(text.lower()) == len(text) else text
                stop = lower.find("</" + tag, at)
                at = len(text) if stop < 0 else stop
                self._close()
        if at < len(text):
            self._text(text[at:])

    def _settle(self) -> None:
        """Choose the content, and for each element say whether it is in it and why it goes."""
        n = len(self.tag)
        bad = [False] * n  # inside something that cannot hold the page's own article
        for i in range(1, n):
            bad[i] = bad[self.parent[i]] or self.kind[i] in HARD or self.kind[i] == "gone"
        tagged = lambda tag, role: [i for i in range(1, n) if not bad[i] and (self.tag[i] == tag or role in self.names[i]) and self.chars[i]]
        found = self._outermost(tagged("article", "role=article")) or self._outermost(tagged("main", "role=main"), nested=False)
        if not found:
            named_ = [i for i in range(1, n) if not bad[i] and self.names[i] & CONTENT and 2 * self.chars[i] >= self.chars[0]]
            found = self._outermost(named_, nested=False)
        self.declared = bool(found)
        self.inside, self.why = [not found] * n, [None] * n
        above = set()  # what holds the content cannot go for its own kind
        for i in found:
            self.inside[i] = True
            up = self.parent[i]
            while up > 0 and up not in above:
                above.add(up)
                up = self.parent[up]
        for i in range(1, n):
            up = self.parent[i]
            self.inside[i] = self.inside[i] or self.inside[up]
            why, kind = self.why[up], self.kind[i]
            if kind and i not in above and i not in found:
                why = why if why and why != "header" else kind
            elif why == "header" and self.declared and self.inside[i] and self.tag[i] in HEADINGS:
                why = None
            elif i in self._other:
                why = "comment"
            elif not why and not self.declared and self.links[i] >= 3 and self.linked[i] > 0.6 * self.chars[i] and self.tag[i] in BLOCKS:
                why = "menu"
            self.why[i] = why

    def _outermost(self, listed: list[int], nested: bool = True) -> list[int]:
        """Those that lie in no other; an article within an article that has a longer text of its own is a comment."""
        chosen, self._other = [], set()
        held, inner, most = set(listed), Counter(), Counter()
        top, near = {0: 0}, {0: 0}  # the outermost and the nearest one around an element, itself included
        for i in range(1, len(self.tag)):
            top[i], near[i] = top[self.parent[i]], near[self.parent[i]]
            if i in held:
                if not top[i]:
                    top[i] = i
                    chosen.append(i)
                elif nested:
                    if near[i] == top[i]:
                        inner[top[i]] += self.chars[i]
                        most[top[i]] = max(most[top[i]], self.chars[i])
                    self._other.add(i)
                near[i] = i
        wrappers = {i for i in chosen if i in inner and self.chars[i] - inner[i] < most[i]}
        self._other = {i for i in self._other if top[i] not in wrappers}
        return chosen

    def need(self, i: int) -> int:
        return 0 if not self.inside[i] else 2 if self.tag[i] in PROSE else 1

    def subtrees(self) -> list[bytes]:
        return sorted({d for d in self.digest if d is not None})

    def text(self, template: dict[bytes, int] | None = None) -> tuple[str, int, int]:
        """The text, and the numbers of topmost subtrees that go as template and by their kind. ``template`` names the
        digests that recur, with the highest level of ``MANY`` that they reach."""
        gone, deleted, marked = [False] * len(self.tag), 0, 0
        for i in range(1, len(self.tag)):
            if gone[self.parent[i]]:
                gone[i] = self.why[i] is not None or self.why[self.parent[i]] != "header"
            elif template and self.digest[i] is not None and template.get(self.digest[i], -1) >= self.need(i):
                gone[i], deleted = True, deleted + 1
                self.why[i] = self.why[i] if self.why[i] != "header" else "template"
            elif self.why[i]:
                gone[i], marked = True, marked + 1
        blocks: dict[int, list[str]] = {}
        for i, block, piece in self.pieces:
            if self.inside[i] and not gone[i]:
                blocks.setdefault(block, []).append(piece)
        joined = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n\n".join(b for b in joined if b), deleted, marked


def _analysed(pages: DataFrame) -> DataFrame:
    """``(key, host, digest, subtrees)``: a page's main text as far as tags and names tell it, and its subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, subtrees = [], []
            for host, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                page = Page(text, host)
                digests.append(xxhash.xxh3_128_digest(page.text()[0].encode("utf-8", "surrogatepass")))
                subtrees.append(page.subtrees() if host else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(subtrees, pa.list_(pa.binary()))], ["key", "host", "digest", "subtrees"])

    return pages.select("key", "host", "html").mapInArrow(run, "key binary, host string, digest binary, subtrees array<binary>")


def site_templates(seen: DataFrame) -> DataFrame:
    """``(subtree, level)``: subtrees that recur on many pages of their host, and the level of ``MANY`` that they reach.
    Pages of one main text count once, with the least of their lists of subtrees."""
    once = seen.groupBy("host", "digest").agg(F.min("subtrees").alias("subtrees"))
    hosts = seen.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = once.select("host", F.explode("subtrees").alias("subtree")).groupBy("subtree").agg(F.count(F.lit(1)).alias("n"), F.min("host").alias("host"))
    counted = cut(counted.filter(F.col("n") >= MANY[0][0]))
    recurring = counted.groupBy("host").agg(F.count(F.lit(1)).alias("recurring"))
    of_host = hot_join(counted, hosts.join(recurring, "host"), "host", "recurring", "subtree")
    level = F.lit(-1)
    for k, (least, share) in enumerate(MANY):
        level = F.when((F.col("n") >= least) & (F.col("n") >= share * F.col("pages")), k).otherwise(level)
    return of_host.select("subtree", level.alias("level")).filter("level >= 0")


def _hits(pages: DataFrame, seen: DataFrame, templates: DataFrame) -> DataFrame:
    """``pages`` with ``hits``, the templates that stand on each, by joins; for sites too many to broadcast."""
    held = seen.select(F.explode("subtrees").alias("subtree")).groupBy("subtree").agg(F.count(F.lit(1)).alias("held"))
    rows = seen.select("key", F.explode("subtrees").alias("subtree"))
    hits = hot_join(rows, templates.join(held, "subtree"), "subtree", "held", "key").groupBy("key").agg(F.collect_set(F.struct("subtree", "level")).alias("hits"))
    keys = seen.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).join(hits, "key", "left")
    return hot_join(pages, keys, "key", "copies", "id")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``(id_col, url_col, text, n_chars, n_template, n_marked)`` for every row of ``pages``.

    References are decoded first; any Unicode white space (also a no-break space, ``br`` or the border of two table
    cells) becomes one space. Null or empty pages and those without content give an empty text. A page without a host has
    no site, so nothing of it is template. Rows that repeat an id or a page are judged each; pages cut off anywhere are
    read to their end; an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    lean(spark)
    plain = pages.select(named(id_col).alias("id"), named(url_col).alias("url"), F.coalesce(named(html_col), F.lit("")).alias("html"))
    plain = plain.withColumn("host", F.coalesce(split_url("url")[0], F.lit("")))
    plain = plain.withColumn("key", F.unhex(F.sha2(F.concat("host", F.lit("\n"), "html"), 256)))
    seen = stored(_analysed(plain), "templates-seen")
    templates = stored(site_templates(seen), "templates")
    # the templates of one host are at most the subtrees of an average page over the least share; those of all hosts are counted
    few = templates.count() <= most_broadcast
    shared = spark.sparkContext.broadcast({bytes(r.subtree): r.level for r in templates.collect()} if few else {})
    joined = plain.withColumn("hits", F.lit(None).cast("array<struct<subtree:binary,level:int>>")) if few else _hits(plain, seen, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for host, text, found in zip(*(b.column(c).to_pylist() for c in ("host", "html", "hits"))):
                out.append(Page(text, host).text({h["subtree"]: h["level"] for h in found or ()} or (shared.value if host else None)))
            texts = [t for t, _, _ in out]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([d for _, d, _ in out], pa.int32()), pa.array([m for _, _, m in out], pa.int32())], [id_col, url_col, "text", "n_chars", "n_template", "n_marked"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.select("id", "url", "host", "html", "hits").mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long, n_template int, n_marked int")
