"""URL filter with redirect equivalence (native).

Aliases are URLs joined by a redirect or a canonical link. Connected components over
those links carry a block decision from one alias to the others; an explicit allow takes
precedence over it. All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import fresh, materialize
from ebbline.llm.components import connected_components

#: Fixed values of the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    Longest means host and path together, as written; on a tie allow comes first.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


CHUNK = 256


def plain_path(path: Column) -> Column:
    """``path`` without its dot segments, as browsers read it.

    Segments are first reduced in runs of ``CHUNK`` to (how many steps up, names below),
    which then are joined, so that a path of very many segments isn't copied for each.
    """
    none = F.array().cast("array<string>")
    parts = F.split(path, "/")

    def step(acc: Column, seg: Column) -> Column:
        names, ups = acc["names"], acc["ups"]
        deep = F.size(names) > 0
        up = F.struct(F.when(deep, ups).otherwise(ups + 1).alias("ups"), F.when(deep, F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))).otherwise(names).alias("names"))
        down = F.struct(ups.alias("ups"), F.concat(names, F.array(seg)).alias("names"))
        return F.when(seg == "..", up).when(seg == ".", acc).otherwise(down)

    start = F.struct(F.lit(0).alias("ups"), none.alias("names"))
    # the empty text before the first slash is put back at the end
    body = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    runs = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(body), F.lit(CHUNK)).cast("int")), lambda k: F.aggregate(F.slice(body, k * CHUNK + 1, CHUNK), start, step))
    joined = F.aggregate(runs, none, lambda acc, run: F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - run["ups"], F.lit(0))), run["names"]))
    folder = F.when(path.rlike(r"/\.\.?$"), F.concat(joined, F.array(F.lit("")))).otherwise(joined)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(folder, "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """The identity of an alias: scheme and host lower-cased, dot segments resolved, the fragment cut."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    rest = F.substr(bare, F.length(head) + 1)
    path = F.regexp_extract(rest, r"(?s)^[^?]*", 0)
    return F.concat(ascii_lower(head), F.when(head == "", path).otherwise(plain_path(path)), F.substr(rest, F.length(path) + 1))


def resolve(base: Column, link: Column) -> Column:
    """An absolute URL for ``link`` on the page ``base``, before dot segments; null if it isn't one."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder)
    link = F.trim(link)
    return (
        F.when(link.isNull() | (link == "") | (origin == ""), F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^[^?#]*", 0), link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^[^#]*", 0), link))
        .otherwise(F.concat(folder, link))
    )


#: Character references by name that URLs in attributes have.
NAMED = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


NUMBER = r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?"


def _decoded(value: Column) -> Column:
    """Character references of ASCII decoded; others stay as they are."""
    pieces = F.split(value, "&#")

    def piece(p: Column) -> Column:
        digits = F.regexp_extract(p, NUMBER, 1)
        code = F.when(F.lower(digits).startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits)
        code = F.when(digits != "", code).cast("int")
        known = code.between(32, 126)
        return F.when(known, F.concat(F.call_function("char", code), F.substr(p, F.length(F.regexp_extract(p, NUMBER, 0)) + 1))).otherwise(F.concat(F.lit("&#"), p))

    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    out = F.when(F.instr(value, "&#") > 0, F.concat(pieces[0], F.array_join(F.transform(rest, piece), ""))).otherwise(value)
    for name, char in NAMED:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = F.regexp_replace(value, rf"""(?is)^[\s"']{name}\s*=\s*["']?""", "")
    return F.regexp_replace(value, r"""["']$""", "")


#: What a browser doesn't read as tags: comments, scripts, styles, templates and plain-text elements.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|xmp|iframe)\b.*?(?:</\1\s*>|\z)"


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)``: canonical links and meta refreshes, from tags of the whole html.

    Links are relative to the page's first ``<base href>``, else to its url; those in
    comments, scripts, styles, templates and plain-text elements don't count.
    """
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html), UNREAD, " "), F.lit(r"(?is)(<(?:link|meta|base)\s[^>]*>)"), F.lit(1))
    some = pages.where(F.col(url).isNotNull() & F.col(html).rlike(r"(?i)canonical|refresh"))
    # each step is stored: as one expression it would repeat itself many times over
    found = materialize(some.select(F.col(url).alias("page"), tags.alias("tags")), "url-tags")
    at_base = F.get(F.filter("tags", lambda t: F.lower(F.substr(t, F.lit(1), F.lit(5))) == "<base"), F.lit(0))
    found = found.select("page", _attribute(at_base, "href").alias("at"), F.explode("tags").alias("tag")).where(F.col("tag").rlike(r"(?i)canonical|refresh"))
    found = materialize(found, "url-tag")
    if found.isEmpty():
        return found.select(F.col("page").alias("src"), F.col("tag").alias("dst"))
    tag = F.col("tag")
    found = materialize(found.select("page", "at", *[_attribute(tag, x).alias(x.replace("-", "_")) for x in ("rel", "href", "http-equiv", "content")]), "url-attributes")
    found = materialize(found.select("page", "rel", "http_equiv", *[_decoded(F.col(x)).alias(x) for x in ("at", "href", "content")]), "url-decoded")
    target = F.when(F.lower("rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("href")).when(
        F.lower("http_equiv") == "refresh", F.regexp_extract("content", r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1)
    )
    found = materialize(found.select("page", F.coalesce(resolve(F.col("page"), F.col("at")), F.col("page")).alias("base"), target.alias("link")), "url-targets")
    found = materialize(found.select("page", resolve(F.col("base"), F.col("link")).alias("to")), "url-links")
    return found.where(F.col("to").isNotNull()).select(node_of(F.col("page")).alias("src"), node_of(F.col("to")).alias("dst")).where("src <> dst")


def judge_urls(pages: DataFrame, url: str = "url", html: str | None = "html", rules: Sequence[tuple[str, str, str]] = RULES, links: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``reason`` (rule, alias or default).

    A fitting rule decides by itself. A URL without one takes the verdict of its
    component: allow if any alias has an explicit allow rule, else block if any has a
    block rule, else allow. ``links`` (src, dst) adds known redirects. Null or odd URLs
    have empty host and path, no aliases, and are allowed by default; every row comes
    out once, repeated rows too; columns of the input of the same names give way.
    Targets of links that aren't pages themselves count with their own rules. No edge is
    collected; verdicts per alias are an aggregate, so a hub of many aliases is no hot task.
    """
    own = {"host", "path", "rule", "verdict", "reason"}
    kept = [c for c in pages.columns if c.lower() not in own]
    p = fresh(pages)
    out = pages.withColumns({f"{p}h": host_of(F.col(url)), f"{p}p": path_of(F.col(url)), f"{p}n": node_of(F.col(url))})
    out = out.withColumn(f"{p}r", rule_for(F.col(f"{p}h"), F.col(f"{p}p"), rules))
    edges = page_links(pages, url, html) if html else None
    if links is not None:
        given = links.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))
        edges = given if edges is None else edges.union(given)
    alias = None
    if edges is not None:
        edges = materialize(edges.distinct(), "url-edges")
        if not edges.isEmpty():
            parts = materialize(connected_components(edges, "src", "dst"), "url-parts")
            own_rule = rule_for(host_of(F.col("node")), path_of(F.col("node")), rules).getField("verdict")
            says = parts.groupBy("component").agg(F.bool_or(own_rule == "allow").alias("a"), F.bool_or(own_rule == "block").alias("b"))
            said = says.where("b and not coalesce(a, false)").select("component")
            alias = parts.join(said, "component", "left_semi").select(F.col("node").alias(f"{p}n"), F.lit(True).alias(f"{p}b"))
    if alias is not None:
        out = out.join(alias, f"{p}n", "left")
    else:
        out = out.withColumn(f"{p}b", F.lit(None).cast("boolean"))
    rule = F.col(f"{p}r")
    blocked = F.coalesce(F.col(f"{p}b"), F.lit(False))
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col(f"{p}h").alias("host"),
        F.col(f"{p}p").alias("path"),
        rule.getField("rule").alias("rule"),
        F.coalesce(rule.getField("verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.when(rule.isNotNull(), "rule").when(blocked, "alias").otherwise("default").alias("reason"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


#: Pages of these tables carry no links, so a URL without a rule is allowed; with links, SQL can't say it plainly.
SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END AS h0,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), hosts AS (
  SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), rules(rule_verdict, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fitting AS (
  SELECT page_id, rh || rp AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
  FROM hosts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM hosts h LEFT JOIN fitting f ON f.page_id = h.page_id AND f.k = 1
"""
