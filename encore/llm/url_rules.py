"""URL filters with redirect equivalence.

Explicit rules (host and path prefix, longest wins) decide a url. Urls that are
aliases of each other decide for those that no rule fits: aliases are urls with
one normal form, and urls joined by canonical links or redirects (a connected
component of such edges). An alias class is blocked when a rule blocks one of
its urls and none allows one: an explicit allow takes precedence. What is left
is allowed.

Edges come from `<link rel=canonical href=...>` and `<meta http-equiv=refresh
content="0; url=...">` in a page's html and from a table of redirects, if given.
Relative targets are resolved against the page's `<base href=...>` (the first
that has one, itself resolved against the url) or its url: by scheme, host, query
or directory, with . and .. taken out. Targets of another kind (mailto:x) are no
edges. Targets that are not pages count with their rules.

Normal form: no scheme or fragment, host without a leading www. or m., path
without a final / or /index.html, query without tracking parameters.

Cases: a null url, or one without ://, has an empty host and path, no rule and
no aliases, and is allowed; null html has no edges; a very long url or html is
scanned like others; every row is judged, repeated rows alike; of rules that fit
equally, the one of more characters and then the later one wins; empty tables give
empty results; other columns are not read, whatever their names. Built-in
expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import cut
from encore.llm.components import components

#: (action, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
TAGS = r"(?is)<(?:link|meta|base)\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?canonical\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"
BASE = r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
ABSOLUTE = r"^[^/?#]*://"
OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
DOTS = r"/\.\.?(/|$)"
LAST = r"/[^/]*$"
ALIAS_HOST = r"^(www|m)\."
ALIAS_PATH = r"(/index\.html?|/)$"
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def _part(url: Column, i: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, i), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def normal_form(url: Column) -> Column:
    """Null where there is no host to speak of."""
    query = F.regexp_replace(F.regexp_replace(_part(url, 3), TRACKING, ""), "^&", "")
    form = F.concat(F.regexp_replace(host_of(url), ALIAS_HOST, ""), F.regexp_replace(path_of(url), ALIAS_PATH, ""),
                    F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.contains("://"), form)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def _without_dots(path: Column) -> Column:
    """A path that starts with /, its . and .. steps taken."""
    steps = F.split(path, "/", -1)
    walked = F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.lit(""), lambda at, step: F.when(step == ".", at)
                         .when(step == "..", F.regexp_replace(at, LAST, "")).otherwise(F.concat(at, F.lit("/"), step)))
    return F.when(path.rlike(DOTS), F.concat(walked, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def resolve(base: Column, ref: Column) -> Column:
    """What `ref` names on a page whose address is `base`; null for other schemes than x://."""
    path, rest = F.regexp_extract(ref, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(ref, r"(?s)^([^?#]*)(.*)$", 2)
    site = F.concat(F.lit("http://"), host_of(base))
    folder = F.concat(F.regexp_replace(path_of(base), LAST, ""), F.lit("/"))
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(ref.rlike(ABSOLUTE), ref) \
        .when(ref.rlike(OTHER_SCHEME), F.lit(None)) \
        .when(ref.startswith("//"), F.concat(F.lit("http:"), ref)) \
        .when(ref.startswith("/"), F.concat(site, _without_dots(path), rest)) \
        .when(ref.startswith("?"), F.concat(site, path_of(base), ref)) \
        .when(ref.startswith("#"), F.concat(site, path_of(base), query, ref)) \
        .otherwise(F.concat(site, _without_dots(F.concat(folder, path)), rest))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): urls that pages name as their canonical or redirect target."""
    plain = lambda ref: F.replace(F.trim(ref), F.lit("&amp;"), F.lit("&"))
    tags = pages.filter(F.col(url).contains("://")) \
        .select(F.col(url).alias("src"), F.regexp_extract_all(html, F.lit(TAGS), F.lit(0)).alias("tags"))
    bases = F.filter("tags", lambda tag: tag.rlike(BASE))
    tags = tags.select("src", plain(F.regexp_extract(F.get(bases, F.lit(0)), BASE, 1)).alias("own"), F.explode_outer("tags").alias("tag"))
    to = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1)) \
        .when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", TARGET, 1))
    tags = tags.select("src", "own", plain(to).alias("to")).filter("to <> ''")
    base = F.when(F.col("own") != "", resolve(F.col("src"), F.col("own")))
    tags = tags.select("src", "to", F.coalesce(base, F.col("src")).alias("base"))
    return tags.select("src", resolve(F.col("base"), F.col("to")).alias("dst")).filter("dst is not null")


def judge(pages: DataFrame, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url",
          html: str = "html", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and alias (the least normal form of
    its class); one row per page. `redirects` has src and dst."""
    u = F.col("u")
    told = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("u")) \
        .select("page_id", host_of(u).alias("host"), path_of(u).alias("path"), normal_form(u).alias("form")) \
        .withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    edges = page_edges(pages.select(F.col(url).alias("url"), F.col(html).alias("html")))
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst").filter("src like '%://%' and dst like '%://%'"))
    edges = cut(edges.distinct())
    roots = components(edges.select(normal_form(F.col("src")).alias("u"), normal_form(F.col("dst")).alias("v")))
    # decided urls: pages and what edges name, each with its normal form
    named = edges.select(F.col("src").alias("e")).union(edges.select("dst"))
    ruled = told.select("form", "r").union(named.select(normal_form(F.col("e")), rule_for(host_of(F.col("e")), path_of(F.col("e")), rules)))
    decided = ruled.filter("form is not null and r is not null").groupBy("form") \
        .agg(F.max(F.col("r.action") == "block").alias("block"), F.max(F.col("r.action") == "allow").alias("allow"))

    def root_of(df: DataFrame) -> DataFrame:
        return df.join(roots, F.col("form") == F.col("node"), "left").withColumn("root", F.coalesce("root", "form"))

    blocked = root_of(decided).groupBy("root").agg(F.max("block").alias("block"), F.max("allow").alias("allow")) \
        .filter("block and not allow").select("root", F.lit(True).alias("blocked"))
    verdict = F.when(F.col("r").isNotNull(), F.col("r.action")).when(F.col("blocked"), "block").otherwise("allow")
    return root_of(told).join(blocked, "root", "left") \
        .select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.col("root").alias("alias"))


def _sql_form(u: str) -> str:
    q = f"regexp_replace(regexp_replace(regexp_extract({u}, P, 3), '{TRACKING}', '', 'g'), '^&', '')"
    return (f"CASE WHEN contains({u}, '://') THEN regexp_replace({_sql_host(u)}, '{ALIAS_HOST}', '') || "
            f"regexp_replace(regexp_extract({u}, P, 2), '{ALIAS_PATH}', '') || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END END"
            ).replace(" P,", f" '{PARTS}',")


def _sql_host(u: str) -> str:
    return f"translate(regexp_extract({u}, '{PARTS}', 1), '{UPPER}', '{LOWER}')"


def _sql_rule(host: str, path: str, what: int) -> str:
    arms = "".join(f" WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, a)[what]}'"
                   for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return f"CASE{arms} END"


def _sql_without_dots(path: str) -> str:
    steps = f"list_prepend('', string_split({path}, '/')[2:])"
    return (f"CASE WHEN regexp_matches({path}, '{DOTS}') THEN list_reduce({steps}, lambda a, s: CASE WHEN s = '.' THEN a "
            f"WHEN s = '..' THEN regexp_replace(a, '{LAST}', '') ELSE a || '/' || s END) || "
            rf"CASE WHEN regexp_matches({path}, '/\.\.?$') THEN '/' ELSE '' END ELSE {path} END")


def _sql_resolve(base: str, ref: str) -> str:
    path, rest = (rf"regexp_extract({ref}, '(?s)^([^?#]*)(.*)$', {i})" for i in (1, 2))
    site, own = f"'http://' || {_sql_host(base)}", f"regexp_extract({base}, '{PARTS}', 2)"
    inner = _sql_without_dots(f"(regexp_replace({own}, '{LAST}', '') || '/' || {path})")
    return (f"CASE WHEN regexp_matches({ref}, '{ABSOLUTE}') THEN {ref} WHEN regexp_matches({ref}, '{OTHER_SCHEME}') THEN NULL "
            f"WHEN starts_with({ref}, '//') THEN 'http:' || {ref} WHEN starts_with({ref}, '/') THEN {site} || ({_sql_without_dots(path)}) || {rest} "
            f"WHEN starts_with({ref}, '?') THEN {site} || {own} || {ref} "
            rf"WHEN starts_with({ref}, '#') THEN {site} || {own} || regexp_extract({base}, '(?s)^[^?#]*(\?[^#]*)', 1) || {ref} "
            f"ELSE {site} || ({inner}) || {rest} END")


def oracle() -> str:
    quoted = lambda s: s.replace("'", "''")
    pick = lambda test, get: f"WHEN regexp_matches(tag, '{quoted(test)}') THEN regexp_extract(tag, '{quoted(get)}', 1)"
    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, COALESCE({_sql_host('url')}, '') AS host, COALESCE(regexp_extract(url, '{PARTS}', 2), '') AS path,
         {_sql_form('url')} AS form FROM pages),
r AS (SELECT *, {_sql_rule('host', 'path', 0)} AS rule, {_sql_rule('host', 'path', 1)} AS action FROM p),
found AS (SELECT url, regexp_extract_all(html, '{TAGS}') AS tags FROM p WHERE contains(url, '://')),
tags AS (SELECT url, replace(trim(regexp_extract(list_filter(tags, lambda x: regexp_matches(x, '{quoted(BASE)}'))[1], '{quoted(BASE)}', 1)),
                             '&amp;', '&') AS own, unnest(tags) AS tag FROM found),
tos AS (SELECT url, CASE WHEN own <> '' THEN {_sql_resolve('url', 'own')} END AS own,
               replace(trim(CASE {pick(CANONICAL, HREF)} {pick(REFRESH, TARGET)} END), '&amp;', '&') AS t FROM tags),
based AS (SELECT url, COALESCE(own, url) AS base, t FROM tos WHERE t <> ''),
e AS (SELECT DISTINCT url AS src, {_sql_resolve('base', 't')} AS dst FROM based),
f AS (SELECT DISTINCT {_sql_form('src')} AS u, {_sql_form('dst')} AS v FROM e WHERE dst IS NOT NULL),
g AS (SELECT u, v FROM f UNION SELECT v, u FROM f),
reach AS (SELECT u AS a, u AS b FROM g UNION SELECT reach.a, g.v FROM reach JOIN g ON reach.b = g.u),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
n AS (SELECT form, action FROM r UNION ALL
      SELECT form, {_sql_rule('host', 'path', 1)} FROM (
        SELECT {_sql_form('x')} AS form, {_sql_host('x')} AS host, regexp_extract(x, '{PARTS}', 2) AS path
        FROM (SELECT src AS x FROM e WHERE dst IS NOT NULL UNION SELECT dst FROM e WHERE dst IS NOT NULL))),
c AS (SELECT COALESCE(root, form) AS k, bool_or(action = 'block') AND NOT bool_or(action = 'allow') AS blocked
      FROM n LEFT JOIN root ON a = form WHERE action IS NOT NULL AND form IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, COALESCE(action, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,
       COALESCE(root, form) AS alias
FROM r LEFT JOIN root ON a = form LEFT JOIN c ON k = COALESCE(root, form)
"""
