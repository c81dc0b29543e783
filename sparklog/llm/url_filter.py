"""URL filters with redirect equivalence.

A rule names a host (it and all its subdomains) and a path prefix. Redirect and canonical
links make URLs aliases of each other; the classes are connected components, found
distributed. A URL's own rule decides first. A URL without a rule takes the decision of its
class: an explicit allow in it outranks every block, a block outranks the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, components

#: So many rules go into the plan as a literal; more are a table that is joined.
LITERAL_RULES = 1_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def node_of(url: Column) -> Column:
    """The identity of a URL as a node: A-Z of scheme and host lower-cased, no fragment."""
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(scheme, F.lit("://"), host_of(url), tail))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(len, rule, action), or null.

    rules: (action, host, path), action allow or block. Of two rules of one length the
    allow wins."""
    kind = "struct<len:int,act:int,rule:string,path:string>"
    if not rules:
        return F.lit(None).cast("struct<len:int,rule:string,action:string>")
    by_host: dict[str, list[Column]] = {}
    for action, h, p in rules:
        row = F.struct(F.lit(len(h) + len(p)).alias("len"), F.lit(int(action == "allow")).alias("act"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"))
        by_host.setdefault(h, []).append(row)
    table = F.create_map(*[x for h, rows in by_host.items() for x in (F.lit(h), F.array(*rows))])
    parts = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    none = F.array().cast(f"array<{kind}>")
    fits = F.flatten(F.transform(ends, lambda h: F.coalesce(F.filter(F.try_element_at(table, h), lambda r: F.startswith(path, r["path"])), none)))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["len"].alias("len"), best["rule"].alias("rule"), F.when(best["act"] == 1, "allow").otherwise("block").alias("action")))


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]], name: str, host: str, path: str) -> DataFrame:
    """Adds best_rule() of the columns host and path, by a join where there are many rules."""
    if len(rules) <= LITERAL_RULES:
        return df.withColumn(name, best_rule(F.col(host), F.col(path), rules))
    table = df.sparkSession.createDataFrame(rules, "_action string, _host string, _path string")
    seen = df.select(F.col(host).alias("_sparklog_h"), F.col(path).alias("_sparklog_p")).distinct()
    parts = F.split("_sparklog_h", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = seen.withColumn("_host", F.explode(ends)).join(table, "_host").where(F.startswith("_sparklog_p", "_path"))
    row = F.struct(F.length(F.concat("_host", "_path")).alias("len"), (F.col("_action") == "allow").cast("int").alias("act"), F.concat("_host", "_path").alias("rule"), F.col("_action").alias("action"))
    best = fits.groupBy("_sparklog_h", "_sparklog_p").agg(F.max(row).alias("_b"))
    best = best.select("_sparklog_h", "_sparklog_p", F.struct("_b.len", "_b.rule", "_b.action").alias(name))
    return df.drop(name).join(best, (F.col(host) == F.col("_sparklog_h")) & (F.col(path) == F.col("_sparklog_p")), "left").drop("_sparklog_h", "_sparklog_p")


#: Where HTML names the canonical URL or redirects (tag, then its URL).
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*(?:["'][^"'>]*\bcanonical\b|canonical\b))[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^"'>]*?\burl\s*=\s*([^"'\s>]+)"""


def _folded(path: Column) -> Column:
    """A path without the segments . and .."""
    steps = F.split(F.regexp_replace(path, r"(/\.{1,2})$", "$1/"), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    return F.array_join(kept, "/")


def html_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) node pairs from canonical links and meta refreshes of whole pages.

    &amp; in a target is &. A target without a scheme is resolved against the page's URL;
    targets of other schemes than those with :// and pages without a URL give no link."""
    text = F.col(html)
    low = F.lower(text)
    hits = F.concat(
        F.when(F.contains(low, F.lit("canonical")), F.regexp_extract_all(text, F.lit(CANONICAL), F.lit(1))).otherwise(F.array().cast("array<string>")),
        F.when(F.contains(low, F.lit("http-equiv")), F.regexp_extract_all(text, F.lit(REFRESH), F.lit(1))).otherwise(F.array().cast("array<string>")),
    )
    t, u = F.col("_t"), F.col(url)
    scheme = F.substring_index(u, "://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(u))
    own = F.when(path_of(u) == "", "/").otherwise(path_of(u))
    beside = F.concat(_folded(F.concat(F.regexp_replace(own, "[^/]*$", ""), F.regexp_extract(t, r"^[^?#]*", 0))), F.regexp_extract(t, r"^[^?#]*(.*)", 1))
    full = (
        F.when(F.locate("://", t) > 0, t).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(F.startswith(t, F.lit("//")), F.concat(scheme, F.lit(":"), t))
        .when(F.startswith(t, F.lit("/")), F.concat(site, t)).when(F.startswith(t, F.lit("?")), F.concat(site, own, t)).when(~F.startswith(t, F.lit("#")), F.concat(site, beside))
    )
    found = pages.where(u.isNotNull() & text.isNotNull()).select(u, F.explode(hits).alias("_t")).withColumn("_t", F.replace(F.col("_t"), F.lit("&amp;"), F.lit("&")))
    return found.select(node_of(u).alias("src"), node_of(full).alias("dst")).where("src is not null and dst is not null")


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], links: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and via (rule, alias or default) to urls.

    links: (src, dst) nodes as of node_of(). Null URLs, or those without ://, have an empty
    host and path, no rule and no aliases: they are allowed by default. Repeated URLs are
    judged alike. Columns of urls named like those added are replaced."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    out = urls.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    out = with_rule(out, rules, "_sparklog_best", "host", "path")
    out = out.withColumns({"rule": F.col("_sparklog_best.rule"), "_sparklog_own": F.col("_sparklog_best.action"), "_sparklog_node": node_of(F.col(url))}).drop("_sparklog_best")
    if links is None:
        decided = out.withColumn("_sparklog_class", F.lit(None).cast("string"))
    else:
        member = components(links.select("src", "dst"))
        placed = with_rule(member.withColumns({"_sparklog_nh": host_of(F.col("node")), "_sparklog_np": path_of(F.col("node"))}), rules, "_sparklog_best", "_sparklog_nh", "_sparklog_np")
        class_of = placed.select("node", "root", F.col("_sparklog_best.action").alias("act"))
        said = class_of.groupBy("root").agg(F.max((F.col("act") == "allow").cast("int")).alias("a"), F.max((F.col("act") == "block").cast("int")).alias("b"))
        said = said.select("root", F.when(F.col("a") == 1, "allow").when(F.col("b") == 1, "block").alias("_sparklog_class")).where("_sparklog_class is not null")
        table = member.join(said, "root").select(F.col("node").alias("_sparklog_node"), "_sparklog_class")
        # Rows that are no nodes, and those that a rule decides, aren't dealt by the join.
        asks = F.col("_sparklog_node").isNotNull() & F.col("_sparklog_own").isNull()
        rest = out.where(~asks).withColumn("_sparklog_class", F.lit(None).cast("string"))
        decided = out.where(asks).join(table, "_sparklog_node", "left").unionByName(rest)
    via = F.when(F.col("_sparklog_own").isNotNull(), "rule").when(F.col("_sparklog_class").isNotNull(), "alias").otherwise("default")
    return decided.withColumns({"verdict": F.coalesce("_sparklog_own", "_sparklog_class", F.lit("allow")), "via": via}).drop("_sparklog_own", "_sparklog_class", "_sparklog_node")
