"""URL filters: block and allow rules by host and path, and decisions that follow redirects and canonical links to aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path), where path begins with a slash.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Host prefixes that name the same site, and query keys that only track where a visitor comes from.
SAME_SITE = ("www", "m", "mobile", "amp")
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid|mc_[a-z]+|igshid|source)$"

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A to Z in lower case; empty for null or without ://."""
    return F.coalesce(common.ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. A rule fits its host and all subdomains if the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """One form for the spellings of an address: no scheme, site prefix, port, fragment, tracking keys, .html, index page or final slash; query keys in order."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":[0-9]*$", ""), rf"^(?:{'|'.join(SAME_SITE)})\.(?=[^.]+\.)", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?:/index)?\.html?$", ""), r"/+$", "")
    keys = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda q: (q != "") & ~F.regexp_extract(q, "^([^=]*)", 1).rlike(TRACKING)))
    return F.when(host == "", url).otherwise(F.concat(host, path, F.when(F.size(keys) > 0, F.concat(F.lit("?"), F.array_join(keys, "&"))).otherwise("")))


def named(html: Column, url: Column) -> Column:
    """The absolute addresses a page gives as its own (canonical link) or sends its readers to (refresh), at most one of each, without nulls."""
    link = F.regexp_extract(html, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    move = F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*http-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)

    def absolute(a: Column) -> Column:
        return F.when(a.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), a).when(a.startswith("//"), F.concat(scheme, a)).when(a.startswith("/"), F.concat(root, a)).when(a != "", F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), a))

    return F.array_compact(F.array(absolute(link), absolute(move)))


def node_of(kind: str, name: Column) -> Column:
    """Addresses and canonical forms as 128-bit graph nodes."""
    return F.unhex(F.md5(F.concat(F.lit(f"{kind}:"), name).cast("binary")))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule, verdict.

    redirects: further edges, as columns url and target. A page that a rule fits has the longest rule's verdict. The others have that of their aliases: addresses that redirects, refreshes,
    canonical links and equal canonical forms connect form components; if an allow rule fits one page or named address of the component the verdict
    is allow, else if a block rule fits one, block; without either, allow. Null urls are connected with nothing: allow. Repeated rows have repeated results; html
    may be null. One graph decides: its edges are what addresses name, and an address and its canonical form, which stands between all spellings, so these cost no pairs.
    """
    rule = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    seen = pages.select("page_id", "url", named(F.col("html"), F.col("url")).alias("named"))
    seen, _ = common.materialize(seen, "pages")
    edges = seen.where("url is not null").select("url", F.explode("named").alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target").where("url is not null and target is not null"))
    addresses = seen.where("url is not null").select("url").unionByName(edges.select(F.col("target").alias("url"))).unionByName(edges.select("url")).distinct()
    known, path = common.materialize(addresses.select(node_of("address", F.col("url")).alias("node"), node_of("form", canonical(F.col("url"))).alias("form"), rule.alias("r")).select("node", "form", "r.verdict"), "addresses")
    address = lambda c: node_of("address", F.col(c))
    linked = known.select(F.col("node").alias("a"), F.col("form").alias("b")).unionByName(edges.select(address("url").alias("a"), address("target").alias("b")))
    placed, placed_path = common.materialize(known.select("node", "verdict").join(common.connected_components(linked).hint("merge"), "node"), "placed")
    said = placed.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allow"), F.max(F.col("verdict") == "block").alias("block"), F.count("*").alias("n"))
    blocked = said.where(F.coalesce("block", F.lit(False)) & ~F.coalesce("allow", F.lit(False))).select("component", "n")
    # without any rule the verdict is allow, so only the addresses of blocked components are looked up
    verdicts, _ = common.materialize(common.spread_join(placed.select("node", "component"), blocked, "component", common.hub_bound(placed.count())).select("node", F.lit("block").alias("said")), "verdicts")
    common.discard(pages.sparkSession, path, placed_path)
    judged = seen.select("page_id", "url", rule.alias("r"), address("url").alias("node")).join(verdicts.hint("merge"), "node", "left")
    return judged.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "said", F.lit("allow")).alias("verdict"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"))


def _sql() -> str:
    """The verdicts for pages that name no other address, as in the tables: there, aliases are the spellings of one canonical form."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    pick = lambda f: " ".join(f"WHEN {fits(h, p)} THEN '{f((v, h + p))}'" for v, h, p in longest)
    same = "|".join(SAME_SITE)
    return f"""
WITH parsed AS (SELECT page_id, url, coalesce({lower.format(f"regexp_extract(url, '{_URL}', 1)")}, '') host, coalesce(regexp_extract(url, '{_URL}', 2), '') path, coalesce(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '') q FROM pages),
judged AS (SELECT *, CASE {pick(lambda r: r[1])} END AS rule, CASE {pick(lambda r: r[0])} END own, regexp_replace(host, ':[0-9]*$', '') h,
  list_sort(list_filter(string_split(q, '&'), lambda k: k <> '' AND NOT regexp_matches(regexp_extract(k, '^([^=]*)', 1), '{TRACKING}'))) qs FROM parsed),
named AS (SELECT *, CASE WHEN host = '' THEN url ELSE CASE WHEN regexp_matches(h, '^(?:{same})\\.[^.]+\\.') THEN regexp_replace(h, '^(?:{same})\\.', '') ELSE h END
  || regexp_replace(regexp_replace(path, '(?:/index)?\\.html?$', ''), '/+$', '') || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END END form FROM judged)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN form IS NULL THEN 'allow' WHEN bool_or(own = 'allow') OVER (PARTITION BY form) THEN 'allow' WHEN bool_or(own = 'block') OVER (PARTITION BY form) THEN 'block' ELSE 'allow' END) verdict FROM named"""


SQL = _sql()
