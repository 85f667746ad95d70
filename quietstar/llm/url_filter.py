"""URL filters with redirect equivalence.

A rule is a host, a path prefix and a verdict; it fits its host and all subdomains, the longest rule that fits decides. Addresses
that redirect or point to one another (canonical links, refresh redirects, given redirect pairs) form components: where no rule
fits a page, it is allowed if a rule allows an address of its component, else blocked if a rule blocks one, else allowed. An
address is a url without scheme, fragment, tracking parameters and slashes at the end, so urls that differ in those are one.

Rules meet urls by join on the host's suffixes, once for each distinct (host, path). Components come from stars over edges
(see :mod:`components`); group results are combined on the map side and written before joins, so hot hosts are split.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, no aliases and is allowed; null html
has no links; all canonical and refresh tags of a page count; a link is resolved against the page's url by RFC 3986 (dot segments
of a relative one are taken away, ``<base>`` isn't read), one that is only a fragment or has a scheme without ``//`` is none; of rules equal in host and path ``allow`` counts;
repeated rows are each judged; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import read_back
from .components import components

TRACKING = r"(?:^|&)(?:utm_[^&]*|ref=[^&]*|fbclid=[^&]*|gclid=[^&]*)"
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``, else nothing."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def address(rest: Column) -> Column:
    """The address of what :func:`after_scheme` gives; null without a host."""
    query = F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(query, "^&", "")
    out = F.concat(host_of(rest), F.regexp_replace(path_of(rest), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host_of(rest) != "", out)


def without_dots(path: Column) -> Column:
    """``path``, which begins with a slash, with ``.`` and ``..`` segments resolved; none leads above the root."""
    parts = F.slice(F.split(path, "/", -1), 2, F.length(path) + 1)

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    last = F.element_at(parts, -1).isin(".", "..")
    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(done, "/"), F.when(last & (F.size(done) > 0), "/").otherwise(""))


def linked(link: Column, rest: Column) -> Column:
    """What follows the scheme of a link found on the page whose url :func:`after_scheme` made ``rest``; null where it is none."""
    host, path = host_of(rest), path_of(rest)
    own, query = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"^[^?#]*([?#].*)$", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^.*/", 0))
    return (
        F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), after_scheme(link)).when(link.startswith("//"), F.substring(link, F.lit(3), F.length(link)))
        .when((link == "") | link.startswith("#") | link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (host == ""), None)
        .when(link.startswith("?"), F.concat(host, path, link))
        .when(link.startswith("/"), F.concat(host, without_dots(own), query))
        .otherwise(F.concat(host, without_dots(F.concat(folder, own)), query))
    )


def targets_of(html: Column, tag: str, target: str) -> Column:
    """The targets of all such tags in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, target, 1))


def judged(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path``, ``rule``, ``verdict`` of the distinct (host, path) that a rule fits. Rules: host, path, verdict."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixed = places.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict")
    met = suffixed.join(named, "suffix").where(F.col("path").startswith(F.col("prefix")))
    rule = F.concat("suffix", "prefix")
    best = F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), (F.col("verdict") == "allow").alias("allow"))).alias("b")
    return met.groupBy("host", "path").agg(best).select(
        "host", "path", "b.rule", F.when(F.col("b.allow"), "allow").otherwise("block").alias("verdict")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``. ``redirects``: ``source`` and ``target`` urls."""
    spark = pages.sparkSession
    rest = after_scheme(F.coalesce(F.col(url_col), F.lit("")))
    html = F.coalesce(F.col(html_col), F.lit(""))
    found = F.concat(targets_of(html, CANONICAL, HREF), targets_of(html, REFRESH, TARGET))
    rows = pages.select(
        F.col(id_col).alias("id"), host_of(rest).alias("host"), path_of(rest).alias("path"), address(rest).alias("at"),
        F.filter(F.transform(found, lambda x: linked(x, rest)), lambda x: x != "").alias("links"),
    )
    rows = read_back(spark, rows, "pages")
    links = rows.where("at IS NOT NULL").select("at", F.explode("links").alias("rest"))
    if redirects is not None:
        links = links.unionByName(redirects.select(address(after_scheme(F.col("source"))).alias("at"), after_scheme(F.col("target")).alias("rest")))
    links = read_back(spark, links.where("at IS NOT NULL AND rest <> ''").distinct(), "links")
    targets = links.select(host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"), address(F.col("rest")).alias("at"))

    ruled = read_back(spark, judged(rows.select("host", "path").union(targets.select("host", "path")), rules), "ruled")
    comps = read_back(spark, components(spark, links.select(F.col("at").alias("a"), address(F.col("rest")).alias("b"))), "comps")
    places = rows.select("at", "host", "path").union(targets.select("at", "host", "path")).where("at IS NOT NULL").distinct()
    verdicts = places.join(ruled, ["host", "path"]).groupBy("at").agg(F.min("verdict").alias("verdict"))
    grouped = comps.join(verdicts, comps["node"] == verdicts["at"], "left").groupBy("component").agg(F.min("verdict").alias("verdict"))
    by_group = comps.join(grouped, "component").select(F.col("node").alias("at"), "verdict")
    # "allow" sorts before "block", so the least verdict has the precedence wanted.
    by_address = read_back(spark, verdicts.unionByName(by_group).where("verdict IS NOT NULL").groupBy("at").agg(F.min("verdict").alias("spread")), "spread")
    out = rows.join(ruled, ["host", "path"], "left").join(by_address, "at", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"))
