"""URL rules that hold for a URL's aliases too: redirect equivalence by connected components."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, cut, texts
from corvane.llm.graph import connected_components

#: (host, path, verdict). A rule fits its host and all subdomains, where the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rules up to which they are compiled into one expression; longer lists are joined by host suffix.
MAX_COMPILED = 200

URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
#: What a page's tags are read by: comments and elements whose contents are no markup go, link, meta and base tags stay.
QUOTED = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
TAGS = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<(script|style|template|textarea|title|xmp|iframe)\b{QUOTED}>.*?(?:</\1\s*>|\Z)|<(link|meta|base)(?=[\s/>])({QUOTED})>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
GOES = re.compile(r"""(?is)\A\s*[\d.]*\s*[;,]?\s*url\s*=\s*(?:"([^"]*)|'([^']*)|(.*))""")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def alias_key(url: Column) -> Column:
    """What two spellings of one address share: host, path and query, without scheme and fragment; null where there is no host."""
    host = host_of(url)
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, rest))


def rooted(key: Column) -> Column:
    """An alias key with an empty path as /, which is the same address."""
    return F.regexp_replace(key, r"\A([^/?]+)(?=\?|\z)", "$1/")


def with_rule(df: DataFrame, host: str, path: str, rules=RULES) -> DataFrame:
    """df with __rule, a struct (rule, verdict) of the longest rule that fits, or null; of equals an allow comes first."""
    rules = [(h.lower(), p, v) for h, p, v in rules]
    if len(rules) <= MAX_COMPILED:
        fits = [
            F.when(((F.col(host) == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(v != "block").alias("first"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules
        ]
        best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")
        return df.withColumn("__rule", F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict"))))
    # Each distinct (host, path) meets, by equality, the rules of each suffix of its host.
    listed = df.sparkSession.createDataFrame(rules, "h string, p string, verdict string")
    places = df.select(F.col(host).alias("__host"), F.col(path).alias("__path")).distinct()
    labels = F.split("__host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = places.withColumn("h", F.explode(ends)).join(listed, "h").where(F.expr("startswith(__path, p)"))
    name = F.concat("h", "p")
    best = met.groupBy("__host", "__path").agg(F.max(F.struct(F.length(name), F.col("verdict") != "block", name.alias("rule"), "verdict")).alias("best"))
    best = best.select("__host", "__path", F.struct("best.rule", "best.verdict").alias("__rule"))
    return df.join(best, (F.col(host) == F.col("__host")) & (F.col(path) == F.col("__path")), "left").drop("__host", "__path")


def resolved(base: str, to: str) -> str:
    """The whole address that ``to`` names on a page at ``base``, whatever the base's scheme is."""
    scheme, found, rest = base.partition("://")
    out = urljoin("http://" + rest if found else base, to)
    # Only what took the stand-in's scheme gets the page's own back.
    return scheme + out[4:] if found and not re.match(r"(?i)[a-z][a-z0-9+.-]*:", to) and out.startswith("http://") else out


def named_addresses(url: str, page: str) -> Iterator[str]:
    """The whole addresses that a page's canonical links and refresh redirects name, in order.

    Tags are read by their attributes: the first of a name counts, references in
    values are decoded, rel is a list of words. What stands in comments or in
    elements whose contents are no markup names nothing. The first base element
    with an address counts for all.
    """
    found, base = [], None
    for tag in TAGS.finditer(page):
        if not tag[2]:
            continue
        own: dict[str, str] = {}
        for name, *values in ATTRIBUTE.findall(tag[3]):
            own.setdefault(name.lower(), html.unescape("".join(values)).strip())
        kind, to = tag[2].lower(), ""
        if kind == "base":
            base = base if base is not None else own.get("href") or None
        elif kind == "link" and "canonical" in own.get("rel", "").lower().split():
            to = own.get("href", "")
        elif kind == "meta" and own.get("http-equiv", "").lower() == "refresh" and (goes := GOES.match(own.get("content", ""))):
            to = "".join(x or "" for x in goes.groups()).strip()
        if to:
            found.append(to)
    home = url if base is None else resolved(url, base)
    for to in found:
        try:
            yield resolved(home, to)
        except ValueError:
            # An address that can't be one, such as an open bracket for a host, names nothing.
            continue


def _edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, to) of pages(url, html)."""
    for batch in batches:
        urls, to = [], []
        for url, page in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            try:
                own = list(named_addresses(url, page))
            except ValueError:
                own = []
            urls += [url] * len(own)
            to += own
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(to, pa.string())], ["url", "to"])


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): alias keys of pages and of what all their canonical links and refresh redirects name, relative addresses resolved against the page's url or base element. Only pages that may name one are parsed."""
    lower = F.lower(F.col(html_col))
    may = F.contains(lower, F.lit("canonical")) | F.contains(lower, F.lit("refresh")) | F.rlike(lower, F.lit(r"(?s)<(?:link|meta)[^>]*&"))
    named = pages.where(F.col(url_col).isNotNull() & may).select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_edges_of, "url string, to string")
    return named.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("to")).alias("b")).where("a is not null and b is not null and a <> b")


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (page_id, host, path, rule, verdict, component) for each row of pages.

    A URL's own longest rule decides. Without one, its aliases do: the URLs
    that redirect and canonical-link edges, in either direction and over any
    number of steps, join to it, whether they are pages or not. If a rule
    explicitly allows one of them the URL is allowed, else if one is blocked it
    is blocked, and else allowed. component is the class's smallest alias key,
    null where a URL has no aliases.

    Edges come from the pages' html and from redirects(a, b), if given, as URLs.
    A null URL or one without ``://`` has no host, path, rule or alias and is
    allowed; a null or empty html names no alias; repeated rows are judged
    alike; other columns are not read; an empty table gives no rows.
    """
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(alias_key(F.col("a")).alias("a"), alias_key(F.col("b")).alias("b")))
    edges = cut(edges.where("a is not null and b is not null").select(rooted(F.col("a")).alias("a"), rooted(F.col("b")).alias("b")).distinct())
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), rooted(alias_key(F.col(url_col))).alias("key"))
    urls = with_rule(urls, "host", "path", rules)
    own, shown = F.col("__rule.verdict"), ["page_id", "host", "path", F.col("__rule.rule").alias("rule")]
    if not edges.take(1):
        return urls.select(*shown, F.coalesce(own, F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    classes = connected_components(edges, "a", "b")
    spelled = classes.withColumn("url", F.concat(F.lit("x://"), "node"))
    ruled = with_rule(spelled.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), "host", "path", rules)
    decided = ruled.groupBy("component").agg(F.bool_or(own == "allow").alias("some_allow"), F.bool_or(own == "block").alias("some_block"))
    said = F.when(F.col("some_allow"), "allow").when(F.col("some_block"), "block").otherwise("allow")
    aliases = classes.join(decided, "component").select(F.col("node").alias("key"), "component", said.alias("said"))
    return urls.join(aliases, "key", "left").select(*shown, F.coalesce(own, "said", F.lit("allow")).alias("verdict"), "component")


# Patterns of the SQL, which knows plainly written tags, absolute addresses and rooted ones.
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def _sql(rules=RULES) -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    host = r"translate(regexp_extract(coalesce({0}, ''), '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = r"regexp_extract(coalesce({0}, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1)"
    rest = r"regexp_replace(regexp_extract({0}, '(?s)\A.*?://[^/?#]*([^#]*)', 1), '\A([^/]|\z)', '/\1')"
    q = lambda x: x.replace("'", "''")
    best = """(SELECT arg_max(h || p || ' ' || v, length(h || p) * 2 + (v <> 'block')::INT) FROM rules WHERE ({0}.host = h OR ends_with({0}.host, '.' || h)) AND starts_with({0}.path, p))"""
    key = lambda u: f"CASE WHEN {host.format(u)} <> '' THEN {host.format(u)} || {rest.format(u)} END"
    return f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {listed}),
u AS (SELECT page_id, url, regexp_replace(html, '{COMMENT}', ' ', 'g') AS html, {host.format('url')} AS host, {path.format('url')} AS path, {key('url')} AS key FROM pages),
t AS (SELECT url, host, key, replace(unnest(list_transform(regexp_extract_all(html, '{q(CANONICAL)}'), lambda x: regexp_extract(x, '{q(HREF)}', 1)) || list_transform(regexp_extract_all(html, '{q(REFRESH)}'), lambda x: regexp_extract(x, '{q(TARGET)}', 1))), '&amp;', '&') AS go FROM u WHERE html IS NOT NULL),
w AS (SELECT key AS a, CASE WHEN contains(go, '://') THEN go WHEN starts_with(go, '//') THEN split_part(url, '://', 1) || ':' || go
    WHEN starts_with(go, '/') THEN split_part(url, '://', 1) || '://' || host || go END AS whole FROM t WHERE go <> ''),
e0 AS (SELECT a, {key('whole')} AS b FROM w),
e AS (SELECT a, b FROM e0 WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e0 WHERE a IS NOT NULL AND b IS NOT NULL),
reach(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
n AS (SELECT node, component, {host.format("('x://' || node)")} AS host, {path.format("('x://' || node)")} AS path FROM c),
r AS (SELECT component, split_part({best.format('n')}, ' ', 2) AS v FROM n),
d AS (SELECT component, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' ELSE 'allow' END AS said FROM r GROUP BY component),
j AS (SELECT page_id, host, path, {best.format('u')} AS own, c.component, d.said FROM u LEFT JOIN c ON u.key = c.node LEFT JOIN d ON c.component = d.component)
SELECT page_id, host, path, nullif(split_part(own, ' ', 1), '') AS rule, coalesce(nullif(split_part(own, ' ', 2), ''), said, 'allow') AS verdict, component FROM j
"""


ORACLE_SQL = _sql()
