"""URL verdicts that follow redirects, with DataFrame operations only.

A rule (host, path, action) fits its host and all subdomains if the url's
path starts with the rule's; the longest wins, allow before block on a tie.
Redirects (meta refresh, or a given table) and canonical links join urls into
components. A url without a rule of its own is allowed if its component has
an allowed url, else blocked if it has a blocked one, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.shared import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
#: Rules as expressions in the plan at most; more are joined by host.
MOST_INLINE = 200

Rule = tuple[str, str, str]


def part(url: Column, n: int) -> Column:
    """Host (1), path (2) or query (3) of a url; empty if it is null or has no ``://``."""
    got = F.coalesce(F.regexp_extract(url.cast("string"), _URL, n), F.lit(""))
    return F.translate(got, UPPER, LOWER) if n == 1 else got


def resource(url: Column) -> Column:
    """What a url names, whatever its scheme and fragment; null without ``://``."""
    u = url.cast("string")
    return F.when(F.instr(u, "://") > 0, F.concat(part(u, 1), part(u, 2), part(u, 3)))


def plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..``, which never lead above the root."""
    steps = F.split(path, "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
    walk = lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    dots = F.element_at(steps, -1).isin(".", "..")
    return F.concat(F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"), F.when(dots, "/").otherwise(""))


def absolute(base: Column, link: Column) -> Column:
    """A link as a url, seen from ``base``: with a scheme, //host, /path, ?query
    or beside the base's path; null for one without a place (``mailto:`` and the like)."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    root = F.concat(F.lit("http://"), part(base, 1))
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(link, r"(?s)^([^?#]*)(.*)$", 2)
    beside = F.concat(F.regexp_replace(part(base, 2), "[^/]*$", ""), path)
    beside = F.when(beside.startswith("/"), beside).otherwise(F.concat(F.lit("/"), beside))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(root, plain_path(path), rest))
        .when(link.startswith("?"), F.concat(root, part(base, 2), rest))
        .when(F.length(path) > 0, F.concat(root, plain_path(beside), rest))
    )


def _rule_struct(rules: list[Rule]) -> Column:
    kinds = [F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(a == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(h).alias("host"), F.lit(p).alias("path")) for h, p, a in rules]
    return F.array(*kinds)


def apply_rules(places: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``own``: struct(size, allow, rule) of the longest rule that fits (host, path), or null."""
    if not rules:
        return places.withColumn("own", F.lit(None).cast("struct<size:int,allow:boolean,rule:string>"))
    best = lambda c: F.struct(c["size"].alias("size"), c["allow"].alias("allow"), c["rule"].alias("rule"))
    if len(rules) <= MOST_INLINE:
        fits = F.filter(_rule_struct(rules), lambda r: ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))) & F.col("path").startswith(r["path"]))
        return places.withColumn("own", F.array_max(F.transform(fits, best)))
    table = places.sparkSession.createDataFrame([(len(h) + len(p), a == "allow", h + p, h, p) for h, p, a in rules], "size int, allow boolean, rule string, rhost string, rpath string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    at = places.select("host", "path").distinct()
    hits = at.withColumn("rhost", F.explode(ends)).join(table, "rhost").where(F.col("path").startswith(F.col("rpath")))
    won = hits.groupBy("host", "path").agg(F.max(F.struct("size", "allow", "rule")).alias("own"))
    return places.join(won, ["host", "path"], "left")


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) urls by canonical links and meta refreshes of ``pages`` (url, html), comments left out."""
    html = F.regexp_replace(F.col("html").cast("string"), "(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), 1)
    t = pages.where(F.col("html").contains("canonical") | F.lower("html").contains("refresh") | F.lower("html").contains("canonical")).select(F.col("url").cast("string").alias("src"), F.explode(tags).alias("tag"))
    href = F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    canonical = F.col("tag").rlike(r"(?i)^<link\b") & F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b")
    moved = F.col("tag").rlike(r"(?i)^<meta\b") & F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")
    link = F.when(canonical, href).when(moved, refresh)
    return t.select("src", absolute(F.col("src"), link).alias("dst")).where("dst is not null")


def url_verdicts(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html).

    ``redirects`` may add edges (src, dst: urls). A url that is null or has no
    ``://`` has an empty host and path, no rule and no aliases, and is
    allowed. Repeated rows come back as often as they were there.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))
    edges = materialize(edges.select(resource(F.col("src")).alias("src"), resource(F.col("dst")).alias("dst")).where("src != dst").distinct(), "edges")
    comps = connected_components(edges)
    split = F.regexp_extract("node", r"(?s)^([^/?]*)([^?]*)", 1), F.regexp_extract("node", r"(?s)^([^/?]*)([^?]*)", 2)
    members = apply_rules(comps.withColumn("host", split[0]).withColumn("path", split[1]), rules)
    ruled = members.groupBy("component").agg(F.max(F.col("own.allow").cast("int")).alias("good"), F.min(F.col("own.allow").cast("int")).alias("bad"))
    decided = F.when(F.col("good") == 1, "allow").when(F.col("bad") == 0, "block")
    told = comps.join(ruled.select("component", decided.alias("by_alias")), "component").select("node", "by_alias").where("by_alias is not null")
    url = F.col("url").cast("string")
    rows = apply_rules(pages.select("page_id", part(url, 1).alias("host"), part(url, 2).alias("path"), resource(url).alias("node")), rules)
    own = F.when(F.col("own.allow"), "allow").when(~F.col("own.allow"), "block")
    return rows.join(told, "node", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(own, "by_alias", F.lit("allow")).alias("verdict"))
