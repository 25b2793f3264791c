"""URL filters: allow and block rules, and block decisions carried to aliases.

The longest rule that fits a url decides.  Pages without one take the decision of their redirect class: urls
joined by ``<link rel=canonical>`` and ``<meta http-equiv=refresh>``, components found by distributed rounds.
An explicit allow of any member goes before a block of another; a class without either, and a page without a
class, is allowed.

Null urls and urls without ``://`` have empty host and path.  Null html has no links.  Repeated rows are judged
alike, an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed rules of the registered query: action, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules are expressions of the plan; longer lists are refused.
MOST_RULES = 2000


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def decide(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (length, rule, action) of the longest rule that fits, of equal ones the last by rule and action; null if none."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"))) for a, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.expr("cast(null as struct<length:int,rule:string,action:string>)")


def _absolute(target: Column, base: Column) -> Column:
    """A link's url, resolved against ``base``; null if that has no ``://``, or for a scheme without ``//``."""
    scheme = F.regexp_extract(base, "^([^:/?#]*)://", 1)
    target = F.trim(target)
    rest = F.regexp_replace(rest_of(base), "#.*$", "")
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(rest, "^([^/?#]*)", 1))
    path = path_of(rest)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    own, query = F.regexp_extract(target, "^([^?#]*)", 1), F.regexp_extract(target, "^[^?#]*(.*)$", 1)
    full = F.when(target.startswith("/"), own).otherwise(F.concat(folder, own))
    # Segments without . and ..; the last of these leaves a slash.
    parts = F.split(F.regexp_replace(full, "^/", ""), "/", -1)
    up = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    clean = F.concat(F.lit("/"), F.array_join(up, "/"), F.when(full.rlike("(^|/)\\.\\.?$") & (F.size(up) > 0), F.lit("/")).otherwise(F.lit("")))
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | ~base.contains("://"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(own == "", F.concat(root, path, F.when(query.startswith("?"), query).otherwise(F.concat(F.regexp_extract(rest, "^[^?]*(.*)$", 1), query))))
        .otherwise(F.concat(root, clean, query))
    )


def _node(url: Column) -> Column:
    """Host, path and query: scheme and fragment don't tell pages apart."""
    rest = rest_of(url)
    return F.concat(host_of(rest), F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1))


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v): a page's node and those of its canonical links and redirect targets."""
    html = F.coalesce("html", F.lit(""))
    attr = lambda tag, name: F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)
    value = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?is)^\s*[a-z-]+\s*=\s*", ""), "^[\"']|[\"']$", "")
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    canonical = F.transform(tags(r"(?is)<link\b[^>]*\srel\s*=\s*[\"']?canonical\b[^>]*>"), lambda t: value(attr(t, "href")))
    refresh = F.transform(tags(r"(?is)<meta\b[^>]*\shttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), lambda t: F.regexp_replace(F.regexp_extract(value(attr(t, "content")), r"(?is)url\s*=\s*(.*)", 1), "^[\"']|[\"']$", ""))
    amp = lambda x: F.regexp_replace(x, "&amp;", "&")
    base = amp(value(attr(F.regexp_extract(html, r"(?is)<base\b[^>]*\shref\s*=[^>]*>", 0), "href")))
    # Each step of resolving names the last one's columns many times: staged, so that they are not spelt out within each other.
    links = staged(pages.select("url", base.alias("base"), F.explode(F.concat(canonical, refresh)).alias("target")).where("target <> ''"))
    links = staged(links.select("url", "target", F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(_absolute(F.col("base"), F.col("url")), F.col("url"))).alias("base")))
    return links.select(_node(F.col("url")).alias("u"), _node(_absolute(amp("target"), F.col("base"))).alias("v")).where("u <> '' and v <> ''").distinct()


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict."""
    classes = components(staged(link_edges(pages)))
    rest = F.concat(F.lit("://"), F.col("node"))
    members = classes.select("node", "root", decide(host_of(rest_of(rest)), path_of(rest_of(rest)), rules)["action"].alias("action"))
    told = members.groupBy("root").agg(F.max(F.when(F.col("action") == "allow", 1).otherwise(0)).alias("allowed"), F.max(F.when(F.col("action") == "block", 1).otherwise(0)).alias("blocked"))
    decided = classes.join(told.where("allowed = 0 and blocked = 1"), "root").select(F.col("node").alias("_node"), F.lit("block").alias("_carried"))
    parts = pages.select("page_id", host_of(rest_of(F.col("url"))).alias("host"), path_of(rest_of(F.col("url"))).alias("path"), _node(F.col("url")).alias("_n"))
    ruled = parts.withColumn("_d", decide(F.col("host"), F.col("path"), rules))
    return ruled.join(decided, F.col("_n") == F.col("_node"), "left").select("page_id", "host", "path", F.col("_d.rule").alias("rule"), F.coalesce("_d.action", "_carried", F.lit("allow")).alias("verdict"))
