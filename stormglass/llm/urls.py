"""URL filters with redirect equivalence: a block decision holds for every alias of a blocked page.

Rules like ``example.com/de/`` fit a host and its subdomains where the path starts with theirs; the
longest that fits decides a url explicitly. Aliases are urls joined by edges: a url and its canonical
form (no scheme, ``www.`` or ``m.``, fragment, tracking parameter, ``.html``, ``index.html`` or closing
slash, as servers redirect them), a page and its canonical link or refresh target, and any further
redirects that are given. Targets are references as in RFC 3986: resolved against the page's url or its
``<base>``, with ``.`` and ``..`` segments removed and ``&amp;`` decoded; a fragment alone, or a scheme
without ``//``, is no edge. The SQL knows only targets with ``://`` or a leading ``/``. A url without a fitting rule is blocked if an alias is blocked by rule and no
alias is allowed by rule; else it is allowed.

Everything is DataFrame work. Rules are a short parameter and become one conditional; urls enter the
graph as 64-bit hashes. A null url or one without ``://`` has an empty host and path and no alias.
Repeated rows and repeated ids are judged each for itself. Columns of other names are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.functions.staging import staged
from stormglass.llm import arrow as A
from stormglass.llm.components import components

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, SMALL), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form that all spellings of a url share; null without ``://``."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    short = F.regexp_replace(path(url), r"(/index\.html?|\.html?|/)$", "")
    name = F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), short)
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(_rest(url).isNotNull(), F.concat(name, asked))


def _attribute(html: Column, tag: str, value: str) -> Column:
    """An attribute of the first such tag of a page; empty without one."""
    found = F.regexp_replace(F.regexp_extract(html, tag, 0), r"(?i)&(amp|#38|#x26);", "&")
    return F.regexp_extract(found, value, 1)


def references(html: Column) -> list[Column]:
    """What a page names as its base, its canonical link and its refresh target."""
    href = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    return [
        _attribute(html, r"(?is)<base\b[^>]*>", href),
        _attribute(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", href),
        _attribute(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"),
    ]


def _without_dots(url: Column) -> Column:
    """The url with the ``.`` and ``..`` segments of its path removed."""
    head = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    own = path(url)
    step = lambda kept, part: (
        F.when(part == ".", kept)
        .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(part)))
    )
    parts = F.split(F.regexp_replace(own, "^/", ""), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    closing = F.when(own.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    clean = F.concat(head, F.lit("/"), F.array_join(kept, "/"), closing, F.regexp_extract(_rest(url), r"(?s)[?#].*$", 0))
    return F.when(own.rlike(r"/\.\.?(/|$)"), clean).otherwise(url)


def resolve(base: Column, target: Column) -> Column:
    """Absolute form of a reference on a page; null if it is empty, a fragment, or of a scheme without ``//``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host(base))
    folder = F.concat(F.lit("/"), F.regexp_extract(path(base), r"(?s)^/(.*/)?", 1))
    absolute = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(F.instr(base, "://") == 0, F.lit(None))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path(base), target))
        .otherwise(F.concat(site, folder, target))
    )
    return _without_dots(absolute)


def fitting_rule(url_host: Column, url_path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest fitting rule, allow before block at equal length; null without one."""
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0], r[1])):
        own_host, slash, rest = rule.partition("/")
        fits = ((url_host == own_host) | url_host.endswith("." + own_host)) & url_path.startswith(slash + rest)
        cases.append((fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    none = F.lit(None).cast("struct<verdict:string,rule:string>")
    return reduce(lambda out, case: F.when(case[0], case[1]).otherwise(out), reversed(cases), none)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    redirects: DataFrame | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str | None = "html",
) -> DataFrame:
    """Per page: its id, host, path, the fitting rule (or null) and the verdict.

    ``rules``: (``allow`` or ``block``, rule). ``redirects``: more edges in columns source, target.
    """
    names = [key, url] + ([html] if html else [])
    rows = A.pick(pages, *names).toDF(*["id", "url", "html"][: len(names)])
    targets = []
    if html:
        named = references(F.col("html"))
        rows = rows.select("id", "url", *[r.alias(f"reference{i}") for i, r in enumerate(named)])
        rows = rows.withColumn("base", F.coalesce(resolve(F.col("url"), F.col("reference0")), "url"))
        targets = [resolve(F.col("base"), F.col(f"reference{i}")) for i in range(1, len(named))]
    read = staged(rows.select("id", "url", *[t.alias(f"target{i}") for i, t in enumerate(targets)]), "urls")
    pairs = [read.select(F.col("url").alias("source"), F.col(f"target{i}").alias("target")) for i in range(len(targets))]
    if redirects is not None:
        pairs.append(A.pick(redirects, "source", "target"))
    urls = read.select("url")
    edges = urls.select("url", canonical(F.col("url")).alias("other"))
    for pair in pairs:
        full = pair.where("source IS NOT NULL AND target IS NOT NULL")
        urls = urls.unionByName(full.select(F.explode(F.array("source", "target")).alias("url")))
        edges = edges.unionByName(
            full.select(F.explode(F.array("source", "target")).alias("url")).select("url", canonical(F.col("url")).alias("other"))
        ).unionByName(full.select(canonical(F.col("source")).alias("url"), canonical(F.col("target")).alias("other")))
    edges = edges.where("url IS NOT NULL AND other IS NOT NULL")
    found = staged(components(edges.select(F.xxhash64("url").alias("a"), F.xxhash64("other").alias("b"))), "url-components")

    judged = urls.where("url IS NOT NULL").distinct()
    decided = judged.select(F.xxhash64("url").alias("id"), fitting_rule(host(F.col("url")), path(F.col("url")), rules)["verdict"].alias("verdict"))
    votes = (
        decided.where("verdict IS NOT NULL")
        .join(found, "id")
        .groupBy("component")
        .agg(F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed"))
    )
    caught = staged(votes.where("blocked AND NOT allowed").select("component", F.lit(True).alias("caught")), "url-caught")
    if caught.count() * 16 <= 32 << 20:
        caught = F.broadcast(caught)
    by_url = found.join(caught, "component").select(F.col("id").alias("node"), "caught")
    out = read.select("id", "url", F.xxhash64("url").alias("node")).join(by_url, "node", "left")
    out = out.select("id", "caught", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    alias = F.when(F.col("caught"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        F.col("id").alias(key), "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], alias).alias("verdict")
    )
