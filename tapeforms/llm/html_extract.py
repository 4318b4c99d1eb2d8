"""Main text of web pages by removal of site templates.

Every page is parsed once, to its blocks of text and to the subtrees that may be template. A subtree has a hash over its tag, class, id
and content, and a sketch: the least hashes of its word pairs, each hashed again with its path of tags, classes and ids.
Spark counts, per host, on how many different pages each of them occurs. Those on at least `least_pages` and on `share` of the host's
pages recur. A subtree whose hash recurs, or of whose sketch three quarters do (so a word may vary), is template, and its blocks are deleted; no
name is needed for that. Near-equal articles recur as well, so bounds protect them: a sketch counts only for a subtree with at most two fifths of
its page's text, all that go by their sketch hold at most half of it, or none of them goes, and no page is left without text.

A menu is known by its structure, on hosts of any size: a container outside the article in which there are three links or more, and nearly all text is
theirs. What marks itself as no content (navigation, forms, scripts, adverts, comments and so on) is deleted by tag, role, or the
whole tokens of class and id. A token counts by its last word, after words for mere structure: "user-comments" and "ad-slot" are
noise, "share-price-table", "ad-free" and "has-sidebar" are not. Inline elements go by tag or role only, never by their names, since they are part of a sentence. No element that holds an article or main is deleted by its
name. If there is an article or main element, the text is what is left in it, and there only
containers can be template, since paragraphs that articles share are text; else it is what is left of the body.

The share bounds a host's templates: 1 / share times the subtrees of its average page. So they travel as one array per host,
and its bytes are measured before it is broadcast.

Text: character references decoded, white space within a block made one space, blocks trimmed, empty blocks left out, the
rest joined by line feeds in page order. A block ends at any block-level tag or line break.

Edge cases: null and empty html give an empty text; broken markup and unclosed elements are read as browsers do: a new
block closes an open paragraph, an end tag closes what is open within; a null or odd url is of the host ''; equal pages of a host
count once and keep their rows; an empty table gives an empty result; extra columns are kept by extracted().
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeforms.llm import shared
from tapeforms.llm.quality import let

LEAST_PAGES = 10
SHARE = 0.3
#: Hashes of a sketch, and the part of them that has to recur.
SKETCH = 8
ALIKE = 0.75
#: Parts of a page's text that may go by their sketch: in one subtree, and in all together.
MOST_ALIKE, MOST_ALIKE_ALL = 0.4, 0.5
#: Links of a menu, at least, and their part of its text.
LINKS, LINK_TEXT = 3, 0.8

# Element names of HTML, and the words by which sites mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("address aside body details dialog div dl fieldset figure footer form header hgroup main nav ol section table tbody tfoot thead ul center".split())
BLOCK = CONTAINER | frozenset("article blockquote br caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr html legend li p pre summary td th tr".split())
SKIPPED = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input label map menu nav noscript object option script select style svg template textarea title video".split())
NOISE = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies discussion disqus footer form login menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted promotion related replies reply respond responses search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
STRUCTURE = frozenset("area bar block body bottom box btn button buttons col column container content group header holder icons inner item items left link links list outer panel posts right root row section slot title top unit wrap wrapper".split())
STATES = frozenset("disable has hide is js no show with without".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = re.compile("[^A-Za-z0-9]+")


def is_noise(token: str) -> bool:
    """Whether a class or id says that its element is no content: by its last word, after words for mere structure."""
    words = [w for w in WORDS.split(token.lower()) if w and not w.isdigit()]
    while len(words) > 1 and words[-1] in STRUCTURE:
        words.pop()
    return bool(words) and words[-1] in NOISE and words[0] not in STATES


class Page(HTMLParser):
    """The elements of a page: events are texts and the numbers of elements, opening (n) and closing (~n)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.names: list[str] = []  # tag, class and id
        self.skipped: list[bool] = []  # by tag or role
        self.marked: list[bool] = []  # by class or id
        self.events: list[str | int] = []
        self.open: list[int] = []
        self.counts = {"article": 0, "main": 0}
        self.feed(html)
        self.close()
        while self.open:
            self._shut()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and tag != "br":
            self._close_to("p", barrier=CONTAINER | {"td", "th", "li", "article"})
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            self._close_to(tag, barrier={"ul", "ol", "table", "dl", "select", *({"tr"} if tag in ("td", "th") else ())})
        values = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden")}
        n = len(self.tags)
        self.tags.append(tag)
        self.names.append(f"{tag}.{values.get('class', '')}#{values.get('id', '')}")
        outside = not (self.counts["article"] or self.counts["main"])
        self.skipped.append(tag in SKIPPED or values.get("role", "").lower() in ROLES or "hidden" in values or (tag == "header" and outside))
        self.marked.append(tag in BLOCK and tag not in ("html", "body", "main") and any(is_noise(w) for k in ("class", "id") for w in values.get(k, "").split()))
        self.events.append(n)
        self.open.append(n)
        if tag in self.counts:
            self.counts[tag] += 1
            for outer in self.open[:-1]:  # what holds an article goes by no name
                self.marked[outer] = False
        if tag in VOID:
            self._shut()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("br", "p") and not any(self.tags[n] == tag for n in self.open):
            self.handle_starttag(tag, [])
            if tag == "br":
                return
        self._close_to(tag)

    def handle_data(self, data: str) -> None:
        self.events.append(data)

    def _close_to(self, tag: str, barrier: set[str] | frozenset[str] = frozenset()) -> None:
        for n in reversed(self.open):
            if self.tags[n] == tag:
                while self._shut() != n:
                    pass
                return
            if self.tags[n] in barrier:
                return

    def _shut(self) -> int:
        n = self.open.pop()
        if self.tags[n] in self.counts:
            self.counts[self.tags[n]] -= 1
        self.events.append(~n)
        return n

    def scope(self) -> str | None:
        """The element that holds the text: article, else main, else None for the whole page. One that is noise doesn't count."""
        return next((t for t in ("article", "main") if any(x == t and not bad and not worse for x, bad, worse in zip(self.tags, self.skipped, self.marked, strict=True))), None)

    def parts(self) -> tuple[list[tuple[str, list[int]]], list[list[int]], list[int]]:
        """The blocks of text in scope, each with the numbers of the subtrees about it, and for each subtree its hash and sketch, and its characters."""
        scope = self.scope()
        blocks: list[tuple[str, list[int]]] = []
        subtrees: list[list[int]] = []
        sizes: list[int] = []
        held: list[str] = []
        linked: list[str] = []
        links: list[int] = []  # characters in links, by block
        menus: set[int] = set()
        skip, inside, article, link, n_links = None, 0, 0, 0, 0
        about: list[tuple[int, int, int, int, bool]] = []  # element, subtree, first block, links before, whether it may be a menu
        path: list[str] = []

        def end() -> None:
            line = " ".join("".join(held).split())
            if line:
                blocks.append((line, [x[1] for x in about]))
                links.append(len(" ".join("".join(linked).split())))
            held.clear()
            linked.clear()

        for e in self.events:
            if isinstance(e, str):
                if skip is None and (inside or scope is None):
                    held.append(e)
                    if link:
                        linked.append(e)
                continue
            n = e if e >= 0 else ~e
            tag = self.tags[n]
            if tag in BLOCK:
                end()
            if e >= 0:
                path.append(self.names[n])
                if skip is None and (self.skipped[n] or self.marked[n]):
                    skip = n
                if skip is None and (inside or scope is None) and tag not in ("body", "html", "main", "article", "br", "hr") and (tag in CONTAINER or (not article and tag in BLOCK)):
                    about.append((n, len(subtrees), len(blocks), n_links, tag in CONTAINER and not article))
                    subtrees.append([])
                    sizes.append(0)
                inside += tag == scope
                article += tag in ("article", "main")
                link += tag == "a"
                n_links += tag == "a"
            else:
                inside -= tag == scope
                article -= tag in ("article", "main")
                link -= tag == "a"
                if n == skip:
                    skip = None
                if about and about[-1][0] == n:
                    _, subtree, first, before, may = about.pop()
                    subtrees[subtree] = _hashes("/".join(path), [x for x, _ in blocks[first:]])
                    sizes[subtree] = sum(len(x) for x, _ in blocks[first:])
                    if may and n_links - before >= LINKS and sum(links[first:]) >= LINK_TEXT * sizes[subtree]:
                        menus.add(subtree)
                path.pop()
        end()
        return [b for b in blocks if menus.isdisjoint(b[1])] or blocks, subtrees, sizes


def _hashes(path: str, blocks: list[str]) -> list[int]:
    """The hash of a subtree's content and its sketch, both with its path; none for a subtree without text."""
    if not blocks:
        return []
    words = " ".join(blocks).split()
    pairs = {xxhash.xxh64_intdigest(f"{a} {b}") for a, b in zip(words, words[1:], strict=False)} or {xxhash.xxh64_intdigest(words[0])}
    where = xxhash.xxh64_intdigest(path)
    content = hashlib.blake2b("\n".join([path, *blocks]).encode("utf-8", "replace"), digest_size=8).digest()
    return [int.from_bytes(content, "little", signed=True), *(((h ^ where) * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1) - (1 << 63) for h in sorted(pairs)[:SKETCH])]


def host_of(url: str | Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def parsed(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(_row, host, page, blocks, subtrees): pages without html, packed, with a hash of the html and what Page.parts() gives."""
    others = [c for c in pages.columns if c not in (html, "text")]
    kept = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(1).alias("_"))
    rows = pages.select(kept.alias("_row"), host_of(F.col(f"`{url}`")).alias("host"), F.xxhash64(f"`{html}`").alias("page"), F.col(f"`{html}`").alias("html"))
    block = T.StructType([T.StructField("text", T.StringType()), T.StructField("about", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("blocks", T.ArrayType(block)), T.StructField("subtrees", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("sizes", T.ArrayType(T.LongType()))])
    kinds = pa.list_(pa.struct([("text", pa.string()), ("about", pa.list_(pa.int32()))])), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in shared.slices(batch, 3, 1 << 20):
                found = [Page(t.as_py()).parts() for t in texts]
                blocks = pa.array([[{"text": x, "about": about} for x, about in f[0]] for f in found], kinds[0])
                others = [pa.array([f[i] for f in found], kinds[i]) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), blocks, *others], names=["_row", "host", "page", "blocks", "subtrees", "sizes"])

    return rows.mapInArrow(run, schema)


def templates(pages: DataFrame, least_pages: int, share: float) -> DataFrame:
    """(host, template): the hashes of parsed() pages that recur on many different pages of a host."""
    different = F.count_distinct("page")
    total = pages.groupBy("host").agg(different.alias("pages"))
    hashes = pages.select("host", "page", F.explode(F.array_distinct(F.flatten("subtrees"))).alias("hash"))
    counts = hashes.groupBy("host", "hash").agg(different.alias("n")).where(F.col("n") >= least_pages)
    often = counts.join(total, "host").where(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("hash").alias("template"))


def recurring(template: Column) -> Column:
    """The subtrees of a page that are template, by number, given the hashes that recur on its host."""
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    numbers = F.when(F.size("subtrees") > 0, F.sequence(F.lit(0), F.size("subtrees") - 1)).otherwise(F.array().cast("array<int>"))

    def same(i: Column) -> Column:
        return F.array_contains(template, F.get(F.get("subtrees", i), F.lit(0)))

    def alike(i: Column) -> Column:
        sketch = F.slice(F.get("subtrees", i), 2, SKETCH)
        known = F.size(F.array_intersect(sketch, template))
        return (F.get("sizes", i) <= MOST_ALIKE * total) & (known >= F.greatest(F.lit(1), F.ceil(F.size(sketch) * ALIKE)))

    def bounded(chosen: Column) -> Column:
        held = F.aggregate(F.filter("blocks", lambda b: F.arrays_overlap(b["about"], chosen)), F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
        return F.when(held <= MOST_ALIKE_ALL * total, chosen).otherwise(F.array().cast("array<int>"))

    with_text = lambda i: F.size(F.get("subtrees", i)) > 0
    return F.array_union(F.filter(numbers, lambda i: with_text(i) & same(i)), let(F.filter(numbers, lambda i: with_text(i) & ~same(i) & alike(i)), bounded))


def extracted(pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """pages with html replaced by text, the main text; a column of that name gives way to it. What is parsed is written to the shared folder, once."""
    spark = pages.sparkSession
    folder = f"{shared.shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    parsed(pages, url, html).write.parquet(folder)
    held = spark.read.parquet(folder)
    known = shared.cut(templates(held, least_pages, share))
    placed = shared.sized_join(held, known, ["host"], "left")
    freed = let(recurring(F.col("template")), lambda g: F.filter("blocks", lambda b: ~F.arrays_overlap(b["about"], g)))
    left = F.when(F.col("template").isNull() | (F.size("subtrees") == 0), F.col("blocks")).otherwise(let(freed, lambda f: F.when(F.size(f) > 0, f).otherwise(F.col("blocks"))))
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n")
    others = [c for c in pages.columns if c not in (html, "text")]
    return placed.select("_row", text.alias("_text")).select(*(F.col(f"_row.`{c}`") for c in others), F.col("_text").alias("text"))
