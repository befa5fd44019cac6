"""HTML extraction (operator 7) with site style trees.

The DOMs of one host are merged by style (tags, classes and ids from the root), articles included. For
each style node of a host, presentation importance tells how few pages share an inner style of its
blocks, or the styles of its children, and content importance how few share a text: one less the mean
entropy of its styles or texts over the pages that have the node, in shares of the largest. A branch
combines its own importance with that of the leaves below it. Blocks of leaves of low importance go,
and branches in which every node is of low importance. The tree holds every node of every page, menus,
headers, scripts and the like included. What it keeps still goes where tags, roles and names tell a
menu, header, footer and the like, whose texts may differ on each page, and where it stands outside
the article. In articles, each different article of a host counts in place of a page: copies of one
article are one article and no template.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.llm.common import cut, lookup, small_batches, table
from motifspark.llm.url_filters import host_and_path

#: A node is judged from this many pages on, and goes if its importance is below the limit.
LEAST_PAGES, LEAST_IMPORTANCE = 5, 0.2
#: Weight of the leaves in a branch's importance, to the power of the number of its children's styles.
GAMMA = 0.9
#: Up to this many hosts with removable nodes are broadcast.
BROADCAST_HOSTS, BROADCAST_NODES = 20_000, 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas dialog menu audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words in classes and ids of what is no part of an article.
NOISE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus respond reply replies pagination pager toolbar".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html body article aside main section div nav header footer form ul ol dl table blockquote".split())
_PART = re.compile("[a-z]+")
#: Words beside which a word of NOISE tells what a part has, not what it is: with-sidebar, comments-open.
MODIFIERS = frozenset("with without has have no not is open closed layout page body content wrapper main".split())
#: Elements below this depth belong to the style node at it, so that paths stay short in any page.
MOST_DEPTH = 64


def is_noise(names: str) -> bool:
    """Whether classes and ids name what is no part of an article."""
    for token in names.lower().split():
        parts = _PART.findall(token)
        if not NOISE.isdisjoint(parts) and (len(parts) == 1 or MODIFIERS.isdisjoint(parts)):
            return True
    return False


class Page(HTMLParser):
    """Blocks of a page: (style node, inner styles, text, whether in the article), those that names and
    tags tell to be no part of it in `hidden`, and branches: (style node, children's styles, whether in
    the article). A node is named by the styles on its path. Any markup is read, in time proportional
    to its length; what is no markup is text. With names False, only the article's tags have a meaning."""

    def __init__(self, html: str, names: bool = True):
        super().__init__(convert_charrefs=True)
        self.names = names
        self.stack, self.blocks, self.branches, self.parts, self.inner = [], [], [], [], []
        self.hidden, self.open, self.muted, self.ending = [], Counter(), [], False
        try:
            self.feed(html)
            self.ending = True
            self.close()
        except AssertionError:  # of the standard library's parser, on markup that it does not know
            self.handle_data(self.rawdata)
        self.flush()
        self.leave(0)
        # An article without text, or within noise, is no main part. Where all text is noise, as behind a
        # menu that is not closed, that of the articles is the page's.
        self.every = self.blocks + self.hidden
        if not self.blocks:
            self.blocks = [block for block in self.hidden if block[3]]
        self.main = any(main for *_, main in self.blocks)

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            _, path, noise, main, _ = self.stack[-1] if self.stack else ("", "", False, False, [])
            (self.hidden if noise else self.blocks).append((path, "".join(self.inner), text, main))
        self.parts, self.inner = [], []

    def leave(self, depth):
        self.branches += [(path, " ".join(children), main) for _, path, _, main, children in self.stack[depth:] if children]
        self.open.subtract(tag for tag, *_ in self.stack[depth:])
        del self.stack[depth:]
        while self.muted and self.muted[-1][1] > depth:
            self.muted.pop()

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            values = dict(attrs)
            if any(name == tag for name, _ in self.muted) or self.names and (is_noise(f"{values.get('class') or ''} {values.get('id') or ''}") or "hidden" in values):
                self.muted.append((tag, len(self.stack)))
            elif not self.muted:
                self.inner.append(f"<{tag}>")
            return
        if tag in ("img", "wbr"):
            return
        self.flush()
        if tag in VOID:
            return
        closes = {"p"} if tag in _CLOSES_P else _CLOSES.get(tag, ())
        if any(self.open[name] for name in closes):
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if name in closes:
                    self.leave(i)
                    break
                if name in _SCOPE:
                    break
        values = {k: v or "" for k, v in attrs}
        names = f"{values.get('class', '')} {values.get('id', '')}"
        main = tag in ("article", "main") or values.get("role") == "main"
        _, above, hidden, inside, siblings = self.stack[-1] if self.stack else ("", "", False, False, [])
        noise = self.names and not main and tag not in ("html", "body") and (
            tag in DROPPED or values.get("role", "").lower() in ROLES or (tag == "header" and not inside) or is_noise(names) or "hidden" in values
        )
        # An article among comments is a comment.
        if self.names and main and not {"comment", "comments", "reply", "replies"}.isdisjoint(_PART.findall(names.lower())):
            noise, main = True, False
        style = tag + "".join(f".{n}" for n in sorted(values.get("class", "").split())) + ("#" + "_".join(values["id"].split()) if values.get("id") else "")
        siblings.append(style)
        path = above if len(self.stack) >= MOST_DEPTH else f"{above} {style}" if self.stack else style
        self.stack.append((tag, path, noise or hidden, main or inside, []))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in INLINE:
            if self.muted and self.muted[-1][0] == tag:
                self.muted.pop()
            return
        self.flush()
        if self.open[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self.leave(i)
                    break

    def handle_data(self, data):
        if not self.muted:
            self.parts.append(data)

    def unknown_decl(self, data):
        pass

    def parse_comment(self, i, report=1):
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 and self.ending else end

    def parse_marked_section(self, i, report=1):
        if self.rawdata.startswith("<![CDATA[", i):
            end = super().parse_marked_section(i, report)
        else:
            end = self.rawdata.find(">", i) + 1 or -1
        return len(self.rawdata) if end < 0 and self.ending else end


def leaf(path: str) -> str:
    """Name of the leaf that a node's own blocks form."""
    return f"{path} #"


def _goes(path: str, low: set[str]) -> bool:
    parts = path.split(" ")
    return leaf(path) in low or any(" ".join(parts[:i]) in low for i in range(1, len(parts) + 1))


def judged(html: str, low: set[str], names: bool = True) -> tuple[str, int, int, int]:
    """The main text, and the numbers of a page's blocks, of those that the style tree removes and of those
    that go by names, tags and place alone; `low` are the leaves and branches of low importance on
    the page's host."""
    page = Page(html, names)
    every = page.every
    going = {path: bool(low) and _goes(path, low) for path in {path for path, *_ in every}}
    kept = [text for path, _, text, main in page.blocks if (main or not page.main) and not going[path]]
    by_tree = sum(going[path] for path, *_ in every)
    return " ".join(kept), len(every), by_tree, len(every) - by_tree - len(kept)


def text_of(html: str, low: set[str], names: bool = True) -> str:
    return judged(html, low, names)[0]


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def style_trees(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, names: bool = True) -> DataFrame:
    """(host, node, n, importance, low) of rows (host, html), leaves and branches; n is the number of pages
    that have the node, of which each different article counts once. A value on c of n pages, a text or
    style, has entropy log c / log n. A leaf's importance is one less the mean entropy of its texts, or of
    its styles if that is more; a branch's is GAMMA^l times the mean of the leaves below and the rest times
    one less the mean entropy of its children's styles, of which there are l. Counts meet per (host,
    node, feature, value, article), pre-aggregated in each Arrow batch, and branches sum what their
    leaves send up, so a host of many pages is no large group."""

    def nodes(batches):
        for batch in batches:
            seen = Counter()
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html or "", names)
                article = _hash("\n".join(text for _, _, text, main in page.blocks if main)) if page.main else None
                found = set()
                for path, inner, text, main in page.every:
                    own = article if main else None
                    found |= {(path, True, "look", _hash(inner), own), (path, True, "content", _hash(text), own), (path, True, "page", 0, own)}
                for path, children, main in page.branches:
                    own = article if main else None
                    found |= {(path, False, "look", _hash(children), own), (path, False, "page", 0, own)}
                seen.update((host, *key) for key in found)
            rows = [(*k, n) for k, n in seen.items()]
            kinds = [("host", pa.string()), ("node", pa.string()), ("own", pa.bool_()), ("feature", pa.string()), ("value", pa.int64()), ("article", pa.int64()), ("n", pa.int64())]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])

    counts = pages.select("host", "html").mapInArrow(nodes, "host string, node string, own boolean, feature string, value long, article long, n long")
    # Once an article; else once a page.
    times = F.when(F.col("article").isNull(), F.sum("n")).otherwise(1).alias("n")
    counts = cut(counts.groupBy("host", "node", "own", "feature", "value", "article").agg(times))
    values = counts.groupBy("host", "node", "own", "feature", "value").agg(F.sum("n").alias("n"))
    each = values.groupBy("host", "node", "own", "feature").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"), F.count("*").alias("looks"))
    of = lambda wanted, value: F.when(F.expr(wanted), F.col(value))
    every = each.groupBy("host", "node", "own").agg(F.max(of("feature = 'page'", "n")).alias("n"), F.min(of("feature <> 'page'", "entropy")).alias("entropy"), F.max(of("feature = 'look'", "looks")).alias("looks"))
    every = cut(every.select("host", "node", "own", "n", "looks", F.when(F.col("n") > 1, 1 - F.col("entropy") / F.log("n")).otherwise(1.0).alias("importance")))
    leaves, branches = every.where("own"), every.where("NOT own")
    path = F.split("node", " ")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.concat_ws(" ", F.slice(path, 1, i)))).alias("at")
    below = leaves.select("host", "n", "importance", up).groupBy("host", "at").agg((F.sum(F.col("n") * F.col("importance")) / F.sum("n")).alias("mean"), F.max("importance").alias("top"))
    here = F.expr("b.host <=> o.host AND b.node = o.at")
    weight = F.pow(F.lit(GAMMA), F.col("looks"))
    combined = branches.alias("b").join(below.alias("o"), here).select("b.host", "node", "n", ((1 - weight) * F.col("importance") + weight * F.col("mean")).alias("importance"), "top")
    combined = cut(combined)
    highest = combined.select("host", "importance", up).groupBy("host", "at").agg(F.max("importance").alias("highest"))
    low = lambda top: (F.col("n") >= least_pages) & (top < least_importance)
    whole = combined.alias("b").join(highest.alias("o"), here).select("b.host", "node", "n", "importance", low(F.greatest("top", "highest")).alias("low"))
    return leaves.select("host", F.concat("node", F.lit(leaf(""))).alias("node"), "n", "importance", low(F.col("importance")).alias("low")).unionByName(whole)


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """One row per input row: id, url, text, n_chars, and the numbers of the page's blocks, of those that the
    style tree removes and of those that only names, tags and place remove: blocks, by_tree, by_name.
    With names False, names and tags other than the article's remove nothing.

    A null or empty html gives an empty text; a null url belongs to the empty host. Null ids and
    repeated rows are kept; other columns are ignored. An empty input gives no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), host_and_path(F.col(url_col))[0].alias("host"), F.col(html_col).alias("html"))
    low = style_trees(rows, least_pages, least_importance, names).where("low")
    low = cut(low.groupBy("host").agg(F.collect_list("node").alias("low"), F.sum(F.lit(1)).alias("nodes")))
    hosts, nodes = low.agg(F.count("*"), F.coalesce(F.sum("nodes"), F.lit(0))).first()
    if hosts <= BROADCAST_HOSTS and nodes <= BROADCAST_NODES:
        joined = rows.join(F.broadcast(low.select("host", "low")), "host", "left")
    else:
        sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
        joined = lookup(rows, low.select("host", "low").join(sizes, "host"), "host", "n", pages.count())

    def texts(batches):
        host, low = None, set()
        for batch in batches:
            out = []
            for own, html, nodes in zip(*(batch.column(i) for i in (2, 3, 4))):
                if own.as_py() != host or not nodes.is_valid:
                    host, low = own.as_py(), set(nodes.as_py() or ())
                out.append(judged(html.as_py() or "", low, names))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page", "url", "text", "blocks", "by_tree", "by_name"])

    kind = rows.schema["page"].dataType.simpleString()
    out = joined.select("page", "url", "host", "html", "low").mapInArrow(texts, f"page {kind}, url string, text string, blocks long, by_tree long, by_name long")
    return out.select(F.col("page").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"), "blocks", "by_tree", "by_name")


def op7_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
