"""Operator 6, URL filters by redirect equivalence. DataFrame functions only.

A rule ``(verdict, host, path)`` fits its host and all subdomains of it if the url's
path starts with the rule's; the longest (host and path) wins. Urls that no rule fits
take the verdict of their aliases. Aliases are urls

* that the usual redirects join: scheme, a leading ``www.`` or ``m.``, the default
  port, fragment, tracking parameters, a trailing slash (``redirect_key``), and
* that a page joins to its own by ``<link rel=canonical>`` or a meta refresh, relative
  targets and ``&amp;`` resolved; these edges between keys go through distributed
  connected components.

Within a class of aliases an explicit allow comes before a block: a url without a
rule is allowed if some alias is explicitly allowed, else blocked if some alias is
blocked, else allowed. A url's own rule always decides for itself. Link targets
that are no pages count as aliases. Rules are a policy list, part of the query.

Defined results: a null url or one without ``://`` has empty host and path, no rule
and is allowed; null html has no links. Repeated urls share a verdict; a class with
very many pages is summed before it is joined. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curio.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"[?&](?:utm_[a-z]+|ref|gclid|fbclid)=[^&#]*"
CANONICAL = [r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""",
             r"""(?is)<link\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)[^>]*\brel\s*=\s*["']?canonical\b"""]
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""
AMPERSAND = r"(?i)&(?:amp|#0*38|#x0*26);"

Rules = list[tuple[str, str, str]]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, null without one."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    pick = lambda of: reduce(lambda w, r: w.when(fits(r[1], r[2]), F.lit(of(r))), ordered, F.when(F.lit(False), F.lit("")))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def redirect_key(url: Column) -> Column:
    """What the usual redirects make of a url; null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(?:80|443)$", ""), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1), TRACKING, ""), r"^&", "?")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, query))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))
    walked = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), lambda a, s: F.when(s == ".", a).when(
        s == "..", up(a)).otherwise(F.concat(a, F.array(s))))
    end = F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(F.instr(path, "/.") > 0, F.array_join(F.concat(walked, end), "/")).otherwise(path)


def _absolute(link: Column, url: Column) -> Column:
    """A link of the page ``url`` as a whole url; null for other schemes (mail, scripts)."""
    bare = F.regexp_replace(link, r"(?s)#.*$", "")
    path, query = F.regexp_extract(bare, r"(?s)^([^?]*)", 1), F.regexp_extract(bare, r"(?s)(\?.*)$", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = F.when(path == "", path_of(url)).otherwise(
        _without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))))
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link).when(
        link.startswith("//"), F.concat(F.regexp_extract(url, r"^([^:/?#]*):", 1), F.lit(":"), link)).when(
        link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string")).when(bare == "", url).otherwise(
        F.concat(F.regexp_extract(url, r"^([^/?#]*://[^/?#]*)", 1), whole, query))


def alias_links(pages: DataFrame) -> DataFrame:
    """``(url, target)`` of all canonical links and meta refreshes of the pages."""
    html = F.coalesce(F.col("html"), F.lit(""))
    # plain searches first: most pages hold neither
    low = html.rlike(r"(?i)\bcanonical\b|http-equiv")
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(html, F.lit(p), 1) for p in (*CANONICAL, REFRESH)]))
    links = pages.where(low).select("url", F.explode(found).alias("link")).where("link <> ''")
    target = _absolute(F.regexp_replace("link", AMPERSAND, "&"), F.col("url"))
    return links.select("url", target.alias("target")).where("target is not null and url is not null")


def judge(pages: DataFrame, rules: Rules) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict)`` of every row of ``pages``
    (``page_id``, ``url``, ``html``)."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = alias_links(pages)
    edges = links.select(redirect_key(F.col("url")).alias("a"), redirect_key(F.col("target")).alias("b")).where("a <> b")
    parts = connected_components(edges, "a", "b", "url-aliases")

    urls = pages.select("url").unionByName(links.select(F.col("target").alias("url")))
    rule, verdict = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    said = urls.select(redirect_key(F.col("url")).alias("key"), verdict.alias("v")).where("key is not null and v is not null").groupBy(
        "key").agg(F.max(F.col("v") == "allow").alias("allow"), F.max(F.col("v") == "block").alias("block"))
    group = F.coalesce("component", "key")
    of_class = said.join(parts, F.col("key") == F.col("node"), "left").groupBy(group.alias("class")).agg(
        F.max("allow").alias("allow"), F.max("block").alias("block"))
    # keys that take their verdict from another key of their class
    by_link = parts.join(of_class, F.col("component") == F.col("class")).select(F.col("node").alias("key"), "allow", "block")
    alone = of_class.join(parts, F.col("class") == F.col("node"), "left_anti").select(F.col("class").alias("key"), "allow", "block")
    of_key = alone.unionByName(by_link).where("block and not allow").select(F.col("key").alias("blocked"))

    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        rule.alias("rule"), verdict.alias("own"), redirect_key(F.col("url")).alias("key"))
    return rows.join(of_key, F.col("key") == F.col("blocked"), "left").select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("own", F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")).alias("verdict"))
