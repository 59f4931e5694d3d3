"""URL rules with redirect equivalence.

A rule `host/path` fits its host and all subdomains where the URL's path starts
with the rule's; the longest fitting rule wins, allow before block at equal length.
Redirects and canonical links make URLs aliases: the connected components of
those edges carry decisions to members without a rule of their own. There an explicit allow
anywhere in the component takes precedence over a block; without either, allow.

Edge cases. A null URL or one without `://` has an empty host and path, no rule,
and verdict allow. Links that are empty, null, or resolve to the URL itself are no
edges. Repeated rows and ids are judged one by one. Host and path are literal: no
decoding, ports and user names stay part of the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, connected_components

# Rule sets up to this size are looked up in a literal map; larger ones are joined.
INLINE_RULES = 5_000

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


_BEST = "struct<size:int,allow:int,rule:string,verdict:string>"


def _best(candidates: Column, path: Column) -> Column:
    fit = F.filter(candidates, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fit, lambda r: F.struct(F.length(r["rule"]).alias("size"), (r["verdict"] == "allow").cast("int").alias("allow"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def with_rule(urls: DataFrame, rules) -> DataFrame:
    """urls(host, path, ...) -> the same with `best`, a struct of the winning rule, or null."""
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE_RULES:
            by_host: dict[str, list] = {}
            for h, p, v in rules:
                by_host.setdefault(h, []).append((h, p, v))
            entries = [x for h, rs in by_host.items() for x in (F.lit(h), F.array(*(F.struct(F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in rs)))]
            if not entries:
                return urls.withColumn("best", F.lit(None).cast(_BEST))
            table = F.create_map(*entries)
            found = F.flatten(F.filter(F.transform(_suffixes(F.col("host")), lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
            return urls.withColumn("best", _best(found, F.col("path")))
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    places = urls.select("host", "path").distinct().withColumn("rule_host", F.explode(_suffixes(F.col("host"))))
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), "verdict")
    r = F.broadcast(r) if r.count() <= BROADCAST_ROWS // 10 else r  # so that a host suffix of very many urls meets its rules where it is
    hits = places.join(r, "rule_host").where(F.startswith("path", "rule_path"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), (F.col("verdict") == "allow").cast("int").alias("allow"), "rule", "verdict")).alias("best"))
    return urls.join(best, ["host", "path"], "left")


def node_of(url: Column) -> Column:
    """A URL as a node: without its fragment, host in lower case."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    rest = F.substring_index(_after_scheme(url), "#", 1)
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), F.translate(host, _UPPER, _LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))))


def resolve(base: Column, link: Column) -> Column:
    """A link's absolute URL: absolute, scheme-relative, root-relative, or relative to the base's folder."""
    scheme = F.substring_index(base, "://", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(_after_scheme(base), r"^[^/?#]*", 0))
    folder = F.regexp_extract(path_of(base), r"^(.*/)[^/]*$", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(F.instr(link, "://") > 0, link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.length(link) > 0, F.concat(origin, folder, link))
    )


_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*([^"'\s>;]+)"""


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes: canonical links and refresh redirects of pages(url, html)."""
    html, url = F.col("html"), F.col("url")
    links = [F.when(F.contains(F.lower(html), F.lit(word)), F.regexp_extract(html, pattern, 1)) for word, pattern in (("canonical", _CANONICAL), ("refresh", _REFRESH))]
    found = pages.select("url", F.explode(F.filter(F.array(*links), lambda x: F.length(x) > 0)).alias("link"))
    return found.select(node_of(url).alias("src"), node_of(resolve(url, F.col("link"))).alias("dst")).where("src <> dst")


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, with_links: bool = True) -> DataFrame:
    """One row per row of pages(page_id, url, html): host, path, rule, verdict, alias_of (its component, or null).

    rules: (host, path, verdict) tuples or a DataFrame of them. redirects: further
    edges (src_url, dst_url). with_links=False takes no edges from html.
    """
    url = F.col("url")
    edges = page_edges(pages.select("url", "html")) if with_links else None
    if redirects is not None:
        more = redirects.select(node_of(F.col(redirects.columns[0])).alias("src"), node_of(F.col(redirects.columns[1])).alias("dst")).where("src <> dst")
        edges = more if edges is None else edges.unionByName(more)
    judged = with_rule(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")), rules)
    if edges is None:
        return judged.select("page_id", "host", "path", F.col("best")["rule"].alias("rule"), F.coalesce(F.col("best")["verdict"], F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_of"))
    parts = connected_components(edges)
    members = with_rule(parts.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
    carried = members.groupBy("component").agg(F.max((F.col("best")["verdict"] == "allow").cast("int")).alias("allowed"), F.max((F.col("best")["verdict"] == "block").cast("int")).alias("blocked"))
    aliases = parts.join(carried, "component").select("node", F.col("component").alias("alias_of"), F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").alias("carried"))
    small = parts.count() <= BROADCAST_ROWS // 10
    # urls without a node have no alias; they get keys of their own, so that no task gets them all
    judged = judged.withColumn("node", F.coalesce("node", F.concat(F.lit(":"), F.xxhash64("page_id").cast("string"))))
    return judged.join(F.broadcast(aliases) if small else aliases, "node", "left").select(
        "page_id", "host", "path", F.col("best")["rule"].alias("rule"), F.coalesce(F.col("best")["verdict"], "carried", F.lit("allow")).alias("verdict"), "alias_of"
    )
