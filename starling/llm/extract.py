"""Main text of web pages by templates that the pages of a host share.

A page is read as a tree of elements and blocks of text. An element's token is
the path of element names and first class words that leads to it, a text's token
is its element's path and the text. For every host, tokens with the same
occurrence vector (how often each of the host's pages has them) form an
equivalence class; the vector is kept as an order-free fingerprint, so classes
come from grouped sums, and no page list is gathered. A class is valid if its
texts nest in its own elements; valid classes are the template: the root class
(every page, once) and, inside it, optional ones (on some pages, once). Texts of
valid classes are the template's; all else lies in its slots.

The main slot is the deepest template element that holds most (``most``) of what
is left over all pages of the host, headings apart; a template element around it
that only adds headings is taken instead. What stands in the main slot is the
text. No element name makes a slot the main one. Names only say what never
belongs to an article: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments (by element, role or class), and
that headings are no template.

Pages are parsed once; their blocks are written and read again.

Defined results: null html is empty and has an empty text; a host whose pages are
all alike, or of one page, has no template texts, but a main slot like any other;
a page without its host's main slot has one of its own by
the same rule, or keeps all its blocks; pages without a host share the
empty host; repeated rows are each returned and count each time; pages of any
length or depth are read whole, in time proportional to their length; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, join_hot, materialize, mix64
from .urlfilter import host_and_path

#: A comment, declaration or tag; a quoted value may hold a closing bracket.
MARKUP = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(?i)(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
OUT = frozenset("head nav header footer aside form button select option script style noscript template svg math canvas iframe object audio video textarea title dialog menu".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id names that mark what is not the article.
OUT_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead banner cookie cookies consent notice notices alert ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion comment comments disqus popup modal pagination pager".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text, so are no slots by themselves.
TEXT_LEVEL = HEADINGS | frozenset("p li dt dd tr td th pre blockquote figcaption caption address".split()) | INLINE
#: Numbers of three digits or more name a page, shorter ones a part of the design.
NUMBER = re.compile("[0-9]{3,}")
#: An opening of the same kind (or one named) ends the open one.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article main section div ul ol dl table body html aside nav header footer form".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


class Names:
    """64-bit names of element paths and texts."""

    def __init__(self):
        import xxhash

        self.of = xxhash.xxh3_64_intdigest

    def path(self, above: int, label: str) -> int:
        return self.of(f"{above}>{label}".encode("utf-8", "surrogatepass"))

    def text(self, path: int, text: str) -> int:
        return self.of(f"{path}|{text}".encode("utf-8", "surrogatepass"))


class Page:
    """What is read from one page.

    frames: (path, number of the frame around it, whether it can be a slot) of
    every element outside of menus and the like, parents first;
    blocks: (text, number of its frame, whether it is a heading).
    """

    def __init__(self, html: str | None, names: Names):
        self.frames: list[tuple[int, int, bool]] = [(0, -1, True)]
        self.blocks: list[tuple[str, int, bool]] = []
        self.read(html or "", names)

    def read(self, html: str, names: Names) -> None:
        # Open elements: (tag, path, number of the frame, outside of the article, number of the frame of the block it is in, heading)
        stack = [("", 0, 0, False, 0, False)]
        where: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
        scopes = [0]
        waiting: list[str] = []

        def flush() -> None:
            if waiting:
                if not stack[-1][3]:
                    text = " ".join(html_lib.unescape("".join(waiting)).split())
                    if text:
                        self.blocks.append((text, stack[-1][4], stack[-1][5]))
                waiting.clear()

        def cut(height: int) -> None:
            while len(stack) > height:
                tag = stack.pop()[0]
                where[tag].pop()
                if scopes[-1] == len(stack):
                    scopes.pop()

        def close(tags) -> None:
            """End the nearest open element of these, unless a scope lies between."""
            at = max((where[t][-1] for t in tags if where.get(t)), default=0)
            if at >= max(1, scopes[-1]):
                cut(at)

        at = 0
        while True:
            m = MARKUP.search(html, at)
            if m is None:
                waiting.append(html[at:])
                break
            if m.start() > at:
                waiting.append(html[at : m.start()])
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in INLINE and tag not in ("script", "style"):
                flush()
            elif tag == "br":
                waiting.append(" ")
            if m.group(1):
                if where.get(tag):
                    height = where[tag][-1]
                    if stack[height][3] != stack[height - 1][3]:
                        flush()
                    cut(height)
                continue
            if tag in RAW:
                end = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>]|\Z)").search(html, at)
                at = end.start() if end else len(html)
                if end:
                    at = html.find(">", at) + 1 or len(html)
                continue
            if tag in ENDS_P:
                close(("p",))
            elif tag in CLOSES:
                close(CLOSES[tag])
            if tag in VOID or m.group(3).endswith("/") and tag not in ENDS_P and tag not in INLINE:
                continue
            _, above, around, out, block, heading = stack[-1]
            label, away = labelled(tag, m.group(3))
            if away and not out:
                flush()
            own = around
            if not (out or away):
                path = names.path(above, label)
                if tag not in INLINE:
                    own = block = len(self.frames)
                    self.frames.append((path, around, tag not in TEXT_LEVEL))
                    heading = tag in HEADINGS
            else:
                path = above
            if tag in SCOPES:
                scopes.append(len(stack))
            where.setdefault(tag, []).append(len(stack))
            stack.append((tag, path, own, out or away, block, heading))
        flush()


def labelled(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's label (tag and first class word, long numbers in it being alike) and whether it stands outside the article."""
    out, first = tag in OUT, ""
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
            if name == "class":
                first = NUMBER.sub("0", value.split()[0]) if value.split() else ""
            if name == "role":
                out |= value.strip() in OUT_ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                out |= name == "hidden"
            elif tag not in ("html", "body", "article", "main"):
                out |= not OUT_WORDS.isdisjoint(re.split(r"[\s_-]+", value))
    return (f"{tag}.{first}" if first else tag), out


PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("row", pa.int64()), ("texts", pa.list_(pa.string())), ("tokens", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("heads", pa.list_(pa.bool_())), ("paths", pa.list_(pa.int64())), ("around", pa.list_(pa.int32())), ("slots", pa.list_(pa.bool_()))])
PARSED_SQL = "page_id long, url string, host string, row long, texts array<string>, tokens array<long>, at array<int>, heads array<boolean>, paths array<long>, around array<int>, slots array<boolean>"


def signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def parsed(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, host, html) -> blocks and those elements that hold any; row is different for every row."""

    def read(batches):
        from pyspark import TaskContext

        names, row = Names(), TaskContext.get().partitionId() << 40
        for batch in batches:
            columns: list[list] = [[] for _ in PARSED]
            for page_id, url, host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(html, names)
                # Only elements with text; their numbers close up.
                held = [False] * len(page.frames)
                for _, f, _ in page.blocks:
                    while f >= 0 and not held[f]:
                        held[f] = True
                        f = page.frames[f][1]
                number = {f: i for i, f in enumerate(f for f, h in enumerate(held) if h)}
                frames = [page.frames[f] for f in number]
                row += 1
                own = (
                    page_id, url, host, row, [t for t, _, _ in page.blocks], signed([names.text(page.frames[f][0], t) for t, f, _ in page.blocks]), [number[f] for _, f, _ in page.blocks], [h for _, _, h in page.blocks],
                    signed([p for p, _, _ in frames]), [number.get(f, -1) for _, f, _ in frames], [x for _, _, x in frames],
                )
                for to, x in zip(columns, own, strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PARSED.types, strict=True)], schema=PARSED)

    return arrow_map(pages.select("page_id", "url", "host", "html"), read, PARSED_SQL)


TOKENS = pa.schema([("host", pa.string()), ("token", pa.int64()), ("path", pa.int64()), ("kind", pa.int32()), ("times", pa.int64()), ("vector", pa.int64())])


#: Kinds of token: an element; a text of an element that can be a slot, of one that holds running text (template only if every page has it), of a heading (never template).
ELEMENT, PART, RUNNING, HEADING = range(4)


def tokens(read: DataFrame) -> DataFrame:
    """(host, token, path, kind, pages, times, vector) of each different token of a host; path is null for elements."""

    def counted(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            keys = []
            for host, row, texts, at, heads, paths, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [(token, None, ELEMENT, n) for token, n in Counter(paths).items()]
                stands = {t: (paths[f], HEADING if h else PART if slots[f] else RUNNING) for t, f, h in zip(texts, at, heads, strict=True)}
                own += [(token, *stands[token], n) for token, n in Counter(texts).items()]
                for x in own:
                    for to, v in zip(rows, (host, *x), strict=True):
                        to.append(v)
                keys += [row] * len(own)
            # A page's part of the vector; parts are combined by XOR, so their order does not matter.
            parts = mix64(mix64(np.array(keys, np.uint64)) + np.array(rows[4], np.uint64))
            yield pa.RecordBatch.from_arrays([*(pa.array(r, t) for r, t in zip(rows, TOKENS.types[:5], strict=True)), pa.array(parts.view(np.int64))], schema=TOKENS)

    found = arrow_map(read.select("host", "row", "tokens", "at", "heads", "paths", "slots"), counted, "host string, token long, path long, kind int, times long, vector long")
    return found.groupBy("host", "token").agg(F.max("path").alias("path"), F.max("kind").alias("kind"), F.count("*").alias("pages"), F.sum("times").alias("times"), F.bit_xor("vector").alias("vector"))


def templates(read: DataFrame, share: int = 50) -> DataFrame:
    """(host, elements, template): the elements of a host's template (on half of its pages, once), and the texts of its valid classes.

    Optional classes are on one page in `share` at least, so both lists are no longer than some pages.
    """
    hosts = read.where(F.size("texts") > 0).groupBy("host").agg(F.count("*").alias("n"))
    found = materialize(tokens(read))
    text = F.col("path").isNotNull()
    # A host whose pages all have the same texts shows no slots.
    least = found.where(text).groupBy("host").agg(F.min("pages").alias("least"))
    hosts = materialize(hosts.join(least, "host").select("host", "n", (F.col("least") < F.col("n")).alias("varied")))
    once = found.where((F.col("times") == F.col("pages")) & (~text | (F.col("pages") > 1)))
    once = materialize(join_hot(once, hosts, "host"))
    elements = once.where(~text & (2 * F.col("pages") >= F.col("n"))).groupBy("host").agg(F.collect_list("token").alias("elements"))
    # Equivalence classes: equal vectors; a text nests if the element it stands in is of its class.
    often = once.where(F.col("varied") & (F.col("pages") > 1) & (F.col("pages") * share >= F.col("n")))
    paths = often.where(~text).select("host", F.col("token").alias("path"), F.col("vector").alias("around"))
    nested = often.where(text).join(paths, ["host", "path"], "left").withColumn("nests", F.coalesce(F.col("around") == F.col("vector"), F.lit(False)))
    loose = nested.where(~F.col("nests") & (F.col("pages") < F.col("n"))).select("host", "vector").distinct()
    valid = nested.where(F.col("nests") & ((F.col("kind") == PART) | (F.col("kind") == RUNNING) & (F.col("pages") == F.col("n")))).join(loose, ["host", "vector"], "left_anti")
    texts = valid.groupBy("host").agg(F.collect_list("token").alias("template"))
    none = F.array().cast("array<bigint>")
    return hosts.select("host").join(elements, "host", "left").join(texts, "host", "left").select("host", F.coalesce("elements", none).alias("elements"), F.coalesce("template", none).alias("template"))


#: Tables of hosts up to this many bytes are sent to every executor; of larger ones only the rows of hot hosts are.
BROADCAST_BYTES = 8 << 20


def with_hosts(read: DataFrame, hosts: DataFrame) -> DataFrame:
    """The rows of read with a text, and the columns of hosts, which has each of their hosts once."""
    size = sum((F.size(c) * 8 if t.startswith("array") else F.lit(8) for c, t in hosts.dtypes if c != "host"), F.length("host") + 16)
    total = hosts.agg(F.sum(size).alias("n")).first().n or 0
    read = read.where(F.size("texts") > 0)
    return read.join(F.broadcast(hosts), "host") if total <= BROADCAST_BYTES else join_hot(read, hosts, "host")


def weigh(paths: list, around: list, lengths: list, own: list, at: list, heads: list, template: frozenset) -> tuple[list[int], list[int], list[int]]:
    """For each element of a page: characters in it that are neither template nor heading, those of headings, and its depth."""
    mass, titles, depth = [0] * len(paths), [0] * len(paths), [0] * len(paths)
    for n, t, f, h in zip(lengths, own, at, heads, strict=True):
        if h:
            titles[f] += n
        elif t not in template:
            mass[f] += n
    for f in range(len(paths) - 1, 0, -1):
        mass[around[f]] += mass[f]
        titles[around[f]] += titles[f]
    for f in range(1, len(paths)):
        depth[f] = depth[around[f]] + 1
    return mass, titles, depth


SLACK = 0.02


def own_slot(paths: list, slots: list, weights: tuple[list[int], list[int], list[int]], most: float) -> int:
    """The number of a single page's main slot: the same choice among the elements that it has once; 0 if there is none."""
    mass, titles, depth = weights
    times = Counter(paths)
    once = [f for f in range(1, len(paths)) if slots[f] and times[paths[f]] == 1 and mass[f] > 0]
    deep = max((f for f in once if mass[f] >= most * mass[0]), key=lambda f: depth[f], default=0)
    above = [f for f in once if depth[f] < depth[deep] and mass[deep] <= mass[f] <= (1 + SLACK) * mass[deep] and titles[f] > titles[deep]]
    return max(above, key=lambda f: depth[f], default=deep)


def main_slots(read: DataFrame, known: DataFrame, most: float) -> DataFrame:
    """(host, slot): the path of each host's main slot, null if no template element holds most."""
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("depth", pa.int32()), ("mass", pa.int64()), ("heads", pa.int64())])

    def weighed(batches):
        for batch in batches:
            sums: dict = {}
            for host, lengths, own, at, heads, paths, around, slots, elements, template in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                elements = frozenset(elements)
                mass, titles, depth = weigh(paths, around, lengths, own, at, heads, frozenset(template))
                for f, p in enumerate(paths):
                    if f == 0 or slots[f] and p in elements:
                        x = sums.setdefault((host, p), [depth[f], 0, 0])
                        x[1] += mass[f]
                        x[2] += titles[f]
            rows = [(h, p, *x) for (h, p), x in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema.types, strict=True)], schema=schema)

    rows = with_hosts(read.select("host", "texts", "tokens", "at", "heads", "paths", "around", "slots"), known)
    rows = rows.select("host", F.transform("texts", F.length).alias("lengths"), "tokens", "at", "heads", "paths", "around", "slots", "elements", "template")
    sums = arrow_map(rows, weighed, "host string, path long, depth int, mass long, heads long")
    sums = sums.groupBy("host", "path").agg(F.max("depth").alias("depth"), F.sum("mass").alias("mass"), F.sum("heads").alias("heads"))
    # Template elements of a host: no more than some page has. Two that hold more than half each lie in one another.
    one = sums.groupBy("host").agg(F.collect_list(F.struct("depth", "mass", "heads", "path")).alias("x")).withColumn("top", F.array_max(F.transform("x", lambda e: e["mass"])))
    one = one.withColumn("deep", F.array_max(F.filter("x", lambda e: (e["depth"] > 0) & (e["mass"] > 0) & (e["mass"] >= most * F.col("top")))))
    above = F.array_max(F.filter("x", lambda e: e["depth"].between(1, F.col("deep.depth") - 1) & (e["mass"].between(F.col("deep.mass"), (1 + SLACK) * F.col("deep.mass"))) & (e["heads"] > F.col("deep.heads"))))
    return one.select("host", F.coalesce(above["path"], F.col("deep.path")).alias("slot"))


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_texts(pages: DataFrame, most: float = 0.6, **options) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    host, _ = host_and_path(F.col("url").cast("string"))
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    read = materialize(parsed(hosted))
    known = materialize(templates(read, **options))
    slots = main_slots(read, known, most)
    known = materialize(known.join(slots, "host", "left").select("host", "slot", "template"))

    def filled(batches):
        for batch in batches:
            out = []
            for texts, own, at, heads, paths, around, slots, slot, template in zip(*(batch.column(i).to_pylist() for i in range(2, 11)), strict=True):
                template = frozenset(template)
                inside = [p == slot for p in paths]
                if True not in inside:
                    inside[own_slot(paths, slots, weigh(paths, around, list(map(len, texts)), own, at, heads, template), most)] = True
                for f in range(1, len(paths)):
                    inside[f] = inside[f] or inside[around[f]]
                kept = [(x, t) for x, t, f in zip(texts, own, at, strict=True) if inside[f]]
                out.append("\n".join([x for x, t in kept if t not in template] or [x for x, _ in kept]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], schema=TEXTS)

    rows = with_hosts(read.select("host", "page_id", "url", "texts", "tokens", "at", "heads", "paths", "around", "slots"), known)
    found = arrow_map(rows.select("page_id", "url", "texts", "tokens", "at", "heads", "paths", "around", "slots", "slot", "template"), filled, "page_id long, url string, text string, n_chars long")
    empty = read.where(F.size("texts") == 0).select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    return found.unionByName(empty)
