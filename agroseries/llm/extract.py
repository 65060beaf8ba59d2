"""Main text of web pages by a site style tree.

The pages of one host are merged into a tree of style nodes: a node is the path of
block elements with their class or id, with the pages that have it.  Two things tell
how important a node is:

* presentation: the entropy of the different sequences of children that it has;
* content: the entropy of the different texts that its leaves hold.

Both are normalised to 0..1 by the number of pages that have the node, and the content of
a leaf counts by its length.  A host of few pages cannot show that a line is common, so
content is measured a second time by the pages of all hosts that hold the line; the lesser
of the two is taken.  The composite importance of a branch mixes its own presentation
(weight 1 - GAMMA ** leaves) with the content of its leaves.  A branch is low if neither
its composite importance nor its content reaches ``LOW`` of the content of all text on the
host, and is removed from every page.  Text that is new on each page is thus never low,
however alike its pages look.  What protects a branch is its own: one that holds
most of the text of the pages it is on stays, and so does a heading, which goes only with
what is around it.  All blocks are counted, those in menus and footers too; nodes on two
pages or more are judged.

Names weigh where the tree is silent.  Hidden elements, and those whose element or role
is a menu, header, footer, aside or the like, have importance 0.  So have forms and
containers with a class or id that is as a whole a name of sidebars, notices, adverts,
comments and so on (``cookie-notice``, but not ``has-sidebar``), unless they hold most of
the page's text and no ``article`` or ``main`` lies outside them; headings never have, and a
section's id inside ``article`` or ``main`` is a place to jump to and says nothing.  Where one
``article`` or ``main`` holds most of the text that is left, the text is taken from there.

Statistics are sums over (host, node, hash), combined before they are shuffled, so a host
with a third of all pages is no hot group; they are stored, so a page is parsed once for
them and once for its text.  The list of low branches is broadcast if it has at most
``BROADCAST_BYTES``, joined on salted hosts otherwise.

Defined results: null or empty html gives an empty text; a null or odd url counts as
host ''; markup that never closes is read as browsers do, without failing; rows are not
merged, so repeated rows give equal results; other columns pass through, but for
columns named like the results, which are replaced.
"""

from __future__ import annotations

import html as references
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

GAMMA = 0.9
MIN_PAGES = 2
LOW = 0.8
BROADCAST_BYTES = 8 << 20
SALTS = 32
TEXT = "#"  # label of the text that stands in an element itself, a leaf beside the elements in it

# fixed values: names of elements and words of classes, after the HTML standard and usage
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math".split())
NOT_TEXT = frozenset("nav footer aside button select dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
MARKED = frozenset("""ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice notices notification alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs comment comments respond replies disqus share
sharing social related recommended newsletter subscribe subscription signup login search footer popup modal widget pagination pager copyright""".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[-_]+")
UNNAMED = frozenset("html body h1 h2 h3 h4 h5 h6".split())  # whose class and id say nothing


class Block(NamedTuple):
    path: str
    text: str
    marked: bool             # hidden, or inside an element that is no main text
    named: tuple[int, ...]   # numbers of the elements around that are none by class or id
    article: int             # number of the outermost article or main that no such name is on or inside of, or 0


class Open(NamedTuple):
    name: str
    path: str
    marked: bool
    named: tuple[int, ...]
    article: int
    children: list


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def is_marked(token: str) -> bool:
    """A class or id that is one of the names, or is made of them alone."""
    parts = [x for x in PARTS.split(token.lower()) if x]
    return bool(parts) and MARKED.issuperset(parts)


def parse(html: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """Text blocks in page order; (path, names of its children) of every block element."""
    stack = [Open("", "", False, (), 0, [])]
    blocks: list[Block] = []
    shapes: list[tuple[str, str]] = []
    pending: list[str] = []

    def flush():
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(top.path, text, top.marked, top.named, top.article))

    def close():
        top = stack.pop()
        if top.name not in INLINE:
            shapes.append((top.path, " ".join(top.children)))

    at, n, number = 0, len(html), 0
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            pending.append(references.unescape(html[at:]))
            break
        if m.start() > at:
            pending.append(references.unescape(html[at : m.start()]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, inside = m[1] or m[4], m[3] if m[2] else m[6]
        if name in INLINE:
            continue
        if name == "br":
            pending.append(" ")
            continue
        flush()
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    while len(stack) > i:
                        close()
                    break
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(r"</" + re.escape(name) + r"\b[^>]*>|\Z", re.I).search(html, at)
            at = end.end()
            continue
        # elements that a new one closes
        if stack[-1].name == "p":
            close()
        while stack[-1].name in CLOSED_BY.get(name, ()):
            close()
        own = attributes(inside) if inside else {}
        label = name + "".join("." + c for c in own.get("class", "").split()[:1]) + ("#" + own["id"] if own.get("id") and "class" not in own else "")
        top = stack[-1]
        number += 1
        named, article = top.named, top.article
        if name == "form" or (own and name not in UNNAMED and any(map(is_marked, [*own.get("class", "").split(), *([] if article and name == "section" else own.get("id", "").split())]))):
            named = (*named, number)
        if not article and (not named or named == top.named) and (name in ("article", "main") or own.get("role") in ("main", "article")):
            article = number
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
        marked = top.marked or hidden or name in NOT_TEXT or own.get("role") in ROLES or (name == "header" and not article)
        top.children.append(label)
        stack.append(Open(name, f"{top.path}/{label}", marked, named, article, []))
    flush()
    while len(stack) > 1:
        close()
    return blocks, shapes


def unmarked(blocks: list[Block]) -> list[Block]:
    """The blocks that names leave."""
    own = [b for b in blocks if not b.marked]
    held: dict[int, int] = {}
    for b in own:
        for x in b.named:
            held[x] = held.get(x, 0) + len(b.text)
    if not held:
        return own
    total = sum(len(b.text) for b in own)
    large = {x for x, n in held.items() if 2 * n > total}
    articles = [b for b in own if b.article and large.issuperset(b.named)]
    most = {x for x in large if all(x in b.named for b in articles)}
    return [b for b in own if most.issuperset(b.named)]


def branches(path: str) -> list[str]:
    """The leaf of text that stands in an element, and all nodes around it up to the root."""
    steps = [*path.split("/"), TEXT]
    return ["/".join(steps[:i]) for i in range(1, len(steps) + 1)]


def main_text(html: str | None, low: frozenset[str]) -> str:
    """The blocks that stay, joined by one space."""
    if not html:
        return ""
    blocks, _ = parse(html)
    own = unmarked(blocks)
    if low:
        gone = {path: not low.isdisjoint(branches(path)) for path in {b.path for b in own}}
        own = [b for b in own if not gone[b.path]]
    held: dict[int, int] = {}
    for b in own:
        held[b.article] = held.get(b.article, 0) + len(b.text)
    for x, n in held.items():
        if x and 2 * n > sum(held.values()):
            own = [b for b in own if b.article == x]
    return " ".join(b.text for b in own)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_nodes(pages: DataFrame) -> DataFrame:
    """host, path, kind, hash, n, chars, total; pages has host and html.  A row for each
    text of a leaf (kind 0), sequence of children (1) and branch with text (2) of a page: n
    counts pages, chars is the text in it, total the text of the pages that have it."""
    def nodes(batches):
        for batch in batches:
            for a, n in B.slices(B.flat(batch.column("html"))):
                out: dict[tuple, list[int]] = {}
                part = batch.slice(a, n)
                for name, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    texts, shapes = parse(html or "")
                    total = sum(len(b.text) for b in texts)
                    held: dict[tuple, int] = {(name, p, 1, hash64(c) if c else 0): 0 for p, c in shapes}
                    sizes: dict[str, int] = {}
                    for b in texts:
                        held[name, f"{b.path}/{TEXT}", 0, hash64(b.text)] = len(b.text)
                        sizes[b.path] = sizes.get(b.path, 0) + len(b.text)
                    for path, size in sizes.items():
                        for x in branches(path):
                            held[name, x, 2, 0] = held.get((name, x, 2, 0), 0) + size
                    for row, size in held.items():
                        sums = out.setdefault(row, [0, 0, 0])
                        sums[0] += 1
                        sums[1] += size
                        sums[2] += total
                if out:
                    keys, sums = list(zip(*out)), list(zip(*out.values()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(keys[2], pa.int32()),
                                                      *(pa.array(c, pa.int64()) for c in (keys[3], *sums))], ["host", "path", "kind", "hash", "n", "chars", "total"])

    return pages.mapInArrow(nodes, "host string, path string, kind int, hash bigint, n bigint, chars bigint, total bigint")


def hash64(text: str) -> int:
    import xxhash
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))


def low_branches(counted: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, path of the branches of low importance, from ``style_nodes`` summed up."""
    share = lambda n, of: F.when(of > 1, F.greatest(F.lit(0.0), 1 - F.log(n) / F.log(of))).otherwise(1.0)
    branch = counted.where("kind = 2").select("host", "path", F.col("n").alias("pages"), (2 * F.col("chars") > F.col("total")).alias("most"))
    texts = counted.where("kind = 0").select("host", "path", "hash", "n", "chars")
    everywhere = texts.groupBy("hash").agg(F.sum("n").alias("all_n"))
    # one row: pages with text
    pages = branch.where("path = ''").agg(F.sum("pages").alias("all_pages"))
    own = texts.join(branch.select("host", "path", "pages"), ["host", "path"]).join(everywhere, "hash").join(F.broadcast(pages))
    importance = lambda n, of: F.sum(F.col("chars") * share(F.col(n), F.col(of))) / F.sum("chars")
    content = own.groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.least(importance("n", "pages"), importance("all_n", "all_pages")).alias("importance"))
    # a leaf counts for every branch it hangs on
    steps = F.split(F.col("path"), "/")
    above = content.select("host", "chars", "importance", F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("path"))
    mean = F.sum(F.col("chars") * F.col("importance")) / F.sum("chars")
    leaves = above.groupBy("host", "path").agg(F.count("*").alias("leaves"), mean.alias("content"))
    typical = content.groupBy("host").agg(mean.alias("typical"))
    entropy = F.when(F.sum("n") > 1, (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")) / F.log(F.sum("n"))).otherwise(1.0)
    shape = counted.where("kind = 1").groupBy("host", "path").agg(F.when(F.max(F.col("hash") != 0), entropy).alias("presentation"))
    weight = F.when(F.col("presentation").isNull(), 1.0).otherwise(F.pow(F.lit(GAMMA), F.col("leaves")))
    composite = (1 - weight) * F.coalesce("presentation", F.lit(0.0)) + weight * F.col("content")
    judged = branch.join(leaves, ["host", "path"]).join(shape, ["host", "path"], "left").join(typical, "host")
    heading = F.col("path").rlike(rf"/h[1-6]([.#][^/]*)?(/{TEXT})?$")
    return judged.where((F.col("pages") >= min_pages) & ~F.col("most") & ~heading & (F.greatest("content", composite) < low * F.col("typical"))).select("host", "path")


def extract(pages: DataFrame, html: str = "html", url: str = "url", text: str = "text") -> DataFrame:
    """``pages`` with the main text in ``text``."""
    pages = pages.drop(text) if text not in (html, url) else pages
    site = B.fresh(pages, "host")
    pages = pages.withColumn(site, host(F.col(url)))
    nodes = style_nodes(pages.select(F.col(site).alias("host"), F.col(html).alias("html")))
    counted = B.written(nodes.groupBy("host", "path", "kind", "hash").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "total"))))
    low = B.kept(low_branches(counted).groupBy("host").agg(F.collect_set("path").alias("low")))
    B.discard(counted)
    size = low.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("low", "//")) + 64).alias("n")).first()["n"]
    name = B.fresh(pages, "low")
    low = low.select(F.col("host").alias(site), F.col("low").alias(name))
    if (size or 0) <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(low), site, "left")
    else:
        salt = B.fresh(pages, "salt")
        low = low.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn(salt, F.pmod(F.xxhash64(html), F.lit(SALTS)).cast("int")).join(low, [site, salt], "left").drop(salt)

    @F.arrow_udf("string")
    def texts(sources: pa.Array, lows: pa.Array) -> pa.Array:
        return pa.array([main_text(h, frozenset(x or ())) for h, x in zip(sources.to_pylist(), lows.to_pylist())], pa.string())

    return joined.withColumn(text, texts(html, name)).drop(site, name)
