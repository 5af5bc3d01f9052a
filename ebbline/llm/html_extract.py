"""Main-text extraction with a site style tree.

The DOMs of a host's pages are merged by element path (tag and class). For each merged
node, presentation importance is the entropy of its child styles over the host's pages, and
content importance falls with the share of pages on which the same contents appear there:
what a site repeats carries little information. Branches of low importance are removed from
each page, as are branches whose element says that they are no article (menus, forms,
adverts and so on). Both hold in an explicit article and out of it; only one that the
tree would remove as a whole is kept.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm.common import fresh, map_arrow, materialize, slices
from ebbline.llm.url_filter import host_of

#: Weight of the contents against the presentation, and the importance below which a node goes.
GAMMA, LEAST_IMPORTANCE = 0.9, 0.35
#: Pages of a host that must share a node before the tree judges it.
MIN_PAGES = 4

#: Elements and words of class, id and role.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
FORMAT = frozenset("abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q rp rt ruby s samp small strike strong sub sup tt u var".split())
NOISE_TAGS = frozenset("aside audio button canvas datalist dialog embed footer form frameset head iframe input map menu nav noembed noframes noscript object optgroup option script search select style svg template textarea title video xmp".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text".split())

_TOKEN = re.compile(
    r"""<!--(?:.*?)(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S
)
_ATTR = re.compile(r"""([a-zA-Z_:][^\s=/>"']*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _is_noise(tag: str, at: dict[str, str], inside: bool) -> bool:
    """Whether an element says itself that it is no article; ``inside``: it stands in one."""
    if tag in NOISE_TAGS:
        return True
    if tag == "header":
        return not inside
    if not at:
        return False
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(at.get("style", "")):
        return True
    if tag in ("html", "body", "main", "article"):
        # only reader comments come as articles of their own
        return tag == "article" and inside and "comment" in f"{at.get('class', '')} {at.get('id', '')}".lower()
    if at.get("role", "").lower() in NOISE_ROLES:
        return True
    words = set(_SPLIT.split(_CAMEL.sub("-", f"{at.get('class', '')} {at.get('id', '')}").lower()))
    return bool(words & NOISE_WORDS) and not words & CONTENT_WORDS


class Block:
    """A block of text with its node: path hash, flags, and the share of it in links."""

    __slots__ = ("path", "noise", "article", "text", "linked")

    def __init__(self, path: int, noise: bool, article: bool, text: str, linked: int):
        self.path, self.noise, self.article, self.text, self.linked = path, noise, article, text, linked


def parse(html: str | None) -> tuple[list[Block], dict[int, str]]:
    """All blocks of a page in order, and for each node's path its child styles.

    Open elements are closed as HTML does it: a block ends an open paragraph, an end tag
    closes what stands open within it, and one without a start tag does nothing.
    """
    blocks: list[Block] = []
    styles: dict[int, list[str]] = {}
    # (tag, path, noise, in article, in link, noise of the block it stands in)
    stack: list[tuple[str, int, bool, bool, bool, bool]] = [("", 0, False, False, False, False)]
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                top = stack[-1]
                blocks.append(Block(top[1], top[5], top[3], text, linked))
            held.clear()
        linked = 0

    def close_to(k: int) -> None:
        if any(x[0] in BLOCK for x in stack[k:]):
            flush()
        del stack[k:]

    at, html = 0, html or ""
    size = len(html)
    match = _TOKEN.match
    while at < size:
        m = match(html, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            token = m[0]
            if token[0] != "<" or token == "<":
                top = stack[-1]
                if top[2] == top[5]:  # else noise inside a line
                    held.append(token)
                    if top[4]:
                        linked += len(token)
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag
            block = tag in BLOCK
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close_to(k)
                    break
                if not block and stack[k][0] in BLOCK:
                    break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in FORMAT and not (m[3] or m[6]):
            continue
        block = tag in BLOCK
        if block:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k][0]
                if open_tag == "p" or (open_tag == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option")):
                    close_to(k)
                    break
                if open_tag in BLOCK and not (tag in ("td", "th") and open_tag in ("td", "th")):
                    break
            flush()
        raw = m[3] or m[6] or ""
        attributes = _attributes(raw) if raw.strip(" /") else {}
        top = stack[-1]
        if tag in VOID:
            continue
        kind = f"{tag}.{attributes.get('class', '')}" if attributes.get("class") else tag
        if block or tag in NOISE_TAGS:
            path = xxhash.xxh64_intdigest(kind, top[1])
            styles.setdefault(top[1], []).append(kind)
        else:
            path = top[1]
        noise = top[2] or _is_noise(tag, attributes, top[3])
        article = top[3] or tag in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody"
        if tag in RAW:  # text up to its own end tag, never markup
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else size
            if end:
                close = html.find(">", at)
                at = close + 1 if close >= 0 else size
            continue
        if not (raw.endswith("/") and tag in ("svg", "math")):
            stack.append((tag, path, noise, article, top[4] or tag == "a", noise if block or tag in NOISE_TAGS else top[5]))
    flush()
    return blocks, {p: "|".join(dict.fromkeys(s)) for p, s in styles.items()}


def main_text(blocks: list[Block], low: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks less noise and the nodes in ``low``, in the article and out of it.

    Out of it, blocks that are mostly links go too. An article that a site repeats as a
    whole stays: the tree alone can't leave it empty.
    """
    article = [b for b in blocks if b.article and not b.noise]
    whole = all(b.path in low for b in article)
    return "\n\n".join([b.text for b in blocks if not b.noise and ((whole or b.path not in low) if b.article else b.path not in low and b.linked < 0.8 * len(b.text))])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _features(batches):
    """(host, node, kind, feature) once per page: 0 child styles, 1 contents."""
    for batch in batches:
        for b in slices(batch, 500):
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blocks, styles = parse(html)
                found = {(x.path, 1, xxhash.xxh64_intdigest(x.text)) for x in blocks}
                nodes = {x.path for x in blocks}
                found |= {(p, 0, xxhash.xxh64_intdigest(styles.get(p, ""))) for p in nodes}
                for p, kind, f in found:
                    rows[0].append(host)
                    rows[1].append(_signed(p))
                    rows[2].append(kind)
                    rows[3].append(_signed(f))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64())], names=["host", "node", "kind", "feature"])


def site_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, node, pages, presentation, contents, importance) of the merged trees.

    With m pages that hold the node: presentation = -sum p_i log_m p_i over its child
    styles; contents = 1 - the mean over its contents of log_m of the pages they are on.
    Counts run over all pages and are pre-aggregated per task, also for a hot host.
    """
    slim = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    found = map_arrow(slim, _features, "host string, node long, kind int, feature long")
    counts = found.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("n"))
    n, style, text = F.col("n").cast("double"), F.col("kind") == 0, F.col("kind") == 1
    nodes = counts.groupBy("host", "node").agg(
        F.sum(F.when(style, F.col("n"))).alias("pages"),
        F.sum(F.when(style, n * F.log(n))).alias("s"),
        F.sum(F.when(text, F.log(n))).alias("t"),
        F.count(F.when(text, 1)).alias("l"),
    )
    m = F.col("pages").cast("double")
    many = F.col("pages") > 1
    nodes = nodes.withColumns(
        {
            "presentation": F.when(many, 1 - F.col("s") / (m * F.log(m))).otherwise(1.0),
            "contents": F.when(many & (F.col("l") > 0), 1 - F.col("t") / (F.col("l") * F.log(m))).otherwise(1.0),
        }
    )
    return nodes.select("host", "node", "pages", "presentation", "contents", ((1 - GAMMA) * F.col("presentation") + GAMMA * F.col("contents")).alias("importance"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null html gives an empty text; pages without host share the empty host, whose tree
    they form together; repeated rows come out repeatedly and count repeatedly; other
    columns aren't read. Whole pages are parsed, nothing is cut. Pages are parsed twice,
    once for the trees and once against them. Only the nodes that go (seen on
    ``MIN_PAGES`` pages of a host at least) are joined to the pages: broadcast by the
    optimizer while under its threshold, else by host with the skew-join rule splitting
    hot hosts.
    """
    tree = site_tree(pages, url, html)
    low = tree.where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    p = fresh(pages)
    low = materialize(low.groupBy("host").agg(F.collect_set("node").alias("low")), "html-low").withColumnsRenamed({"host": f"{p}lh", "low": f"{p}low"})
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host_of(F.col(url)).alias(f"{p}h"))
    both = slim.join(low, F.col(f"{p}h") == F.col(f"{p}lh"), "left").select("page_id", "url", "html", F.col(f"{p}low").alias("low"))

    def run(batches):
        for batch in batches:
            for b in slices(batch, 500):
                texts = []
                for source, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    blocks, _ = parse(source)
                    texts.append(main_text(blocks, {x & (1 << 64) - 1 for x in gone} if gone else frozenset()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(both, run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
