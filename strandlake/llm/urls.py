"""URL filters: rules on hosts and paths, and decisions that redirects and canonical links carry to aliases."""

from __future__ import annotations

import html as html_text
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits urls whose host is this one or below it and whose path starts with this one."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def with_rules(pages: DataFrame, rules: tuple[UrlRule, ...], url: str = "url") -> DataFrame:
    """Append host, path, rule and rule_verdict; the longest fitting rule wins, allow before block among equals."""
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    order = sorted(rules, key=lambda r: (-len(r.text), r.verdict))
    rule = verdict = None
    for r in order:
        fit = fits(r, F.col("host"), F.col("path"))
        rule = fit_then(rule, fit, r.text)
        verdict = fit_then(verdict, fit, r.verdict)
    null = F.lit(None).cast("string")
    return out.withColumn("rule", null if rule is None else rule).withColumn("rule_verdict", null if verdict is None else verdict)


def fit_then(chain: Column | None, fit: Column, value: str) -> Column:
    return F.when(fit, F.lit(value)) if chain is None else chain.when(fit, F.lit(value))


def node_of(url: Column) -> Column:
    """The url as a node of the alias graph: without fragment, host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    at = F.length(F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*", 0))
    return F.concat(F.translate(bare.substr(F.lit(1), at), UPPER, LOWER), bare.substr(at + 1, F.length(bare)))


#: Tags that may hold an alias: comments, scripts and styles are read over, quoted values may hold >.
_TAG = r"""(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)|(<(?:link|meta|base)\b(?:[^>"']|"[^"]*"|'[^']*')*+>)"""
_ATTRIBUTE = r"""(?is)([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))"""
_REFRESH = re.compile(r"""\s*[\d.]*\s*[;,]?\s*url\s*=\s*(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)


def aliases(url: str, page: str) -> list[str]:
    """Absolute urls of every canonical link and every refresh of a page, in page order.

    rel is a list of words; character references are decoded; a first base element moves relative links.
    """
    base, found = url, []
    for m in _TAGS.finditer(page):
        tag = m.group(2)
        if not tag:
            continue
        own: dict[str, str] = {}
        for a in _ATTRIBUTES.finditer(tag):
            own.setdefault(a.group(1).lower(), html_text.unescape(a.group(2) or a.group(3) or a.group(4) or ""))
        kind = tag[1:5].lower()
        if kind == "base":
            if base is url and own.get("href", "").strip():
                base = _absolute(url, own["href"]) or url
        elif kind == "link" and "canonical" in own.get("rel", "").lower().split():
            found.append(own.get("href", ""))
        elif kind == "meta" and own.get("http-equiv", "").strip().lower() == "refresh" and (r := _REFRESH.match(own.get("content", ""))):
            found.append(r.group(1) or r.group(2) or r.group(3) or "")
    return [x for x in (_absolute(base, f) for f in found) if x]


def _absolute(base: str, link: str) -> str | None:
    """A link on the page at base; null if it is empty, malformed or of a scheme without ``://``."""
    link = re.sub(r"[\t\r\n]", "", link).strip()
    if not link:
        return None
    try:
        out = urljoin(base, link)
    except ValueError:
        return None
    return out if "://" in out.split("?")[0].split("#")[0] else None


_TAGS, _ATTRIBUTES = re.compile(_TAG.replace(r"\z", r"\Z")), re.compile(_ATTRIBUTE)


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v) from each page to the targets of all its canonical links and refreshes."""
    C.small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, to = [], []
            for own, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x in aliases(own, page):
                    u.append(own)
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(to, pa.string())], names=["u", "to"])

    # Pages that cannot hold an alias stay in the JVM.
    some = pages.where(F.col(url).contains("://") & F.col(html).rlike(r"(?i)canonical|refresh|&#"))
    links = some.select(F.col(url).alias("u"), F.col(html).alias("to")).mapInArrow(run, "u string, to string")
    return links.select(node_of(F.col("u")).alias("u"), node_of(F.col("to")).alias("v")).where("u != v")


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None, default: str = "allow", url: str = "url", html: str = "html") -> DataFrame:
    """Append host, path, rule and verdict to every page.

    A page under a rule has that rule's verdict.  Another one takes its alias component's: allow if some member is
    explicitly allowed, else block if some member is blocked, else the default.  Components join urls over canonical
    links and refreshes of the pages and over redirects (from_url, to_url).  A null url, or one without ``://``, has
    empty host and path and no alias.  Repeated pages keep equal verdicts; other columns stay.
    """
    ruled = with_rules(pages, rules, url)
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")))
    of = components.connected_components(edges)
    explicit = with_rules(of.withColumnRenamed("node", url), rules, url)
    some = lambda verdict: F.max((F.col("rule_verdict") == verdict).cast("int")) == 1
    decided = explicit.groupBy("component").agg(F.when(some("allow"), "allow").when(some("block"), "block").alias("_by_alias"), F.count("*").alias("members"))
    decided = C.materialize(decided.where("_by_alias IS NOT NULL"), "url-decisions")
    by_node = C.join_classes(of, decided, ["component"], of.count(), "inner").select(F.col("node").alias("_node"), "_by_alias")
    # Pages under a rule, or without url, need no join: their key is null.
    keyed = ruled.withColumn("_node", F.when(F.col("rule").isNull(), node_of(F.col(url))))
    return keyed.join(by_node, "_node", "left").withColumn("verdict", F.coalesce("rule_verdict", "_by_alias", F.lit(default))).drop("_node", "_by_alias", "rule_verdict")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def site_redirects(pages: DataFrame, url: str = "url") -> DataFrame:
    """(from_url, to_url): every page to the front page of its site, whose mobile and www hosts are one."""
    site = F.regexp_replace(host_of(F.col(url)), r"^(m|www)\.", "")
    return pages.where(F.col(url).contains("://")).select(F.col(url).alias("from_url"), F.concat(F.lit("https://"), site, F.lit("/")).alias("to_url"))


def url_site_aliases(spark, sf_dir: str) -> DataFrame:
    """Verdicts where every page redirects to its site's front page: large components, and hot ones."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, redirects=site_redirects(pages)).select("page_id", "host", "path", "rule", "verdict")


_CASES = "\n".join(f"        WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(RULES, key=lambda r: (-len(r.text), r.verdict)))
_BLOCKS = ", ".join(f"'{r.text}'" for r in RULES if r.verdict == "block")


def _ruled(source: str, name: str) -> str:
    """CTEs {name}: columns of source, host, path and rule of its url."""
    return rf"""{name}_u AS (SELECT *, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM {source}),
    {name} AS (SELECT *, CASE
{_CASES}
        END AS rule FROM {name}_u)"""


def _node(url: str) -> str:
    return rf"(translate(regexp_extract(regexp_replace({url}, '(?s)#.*$', ''), '(?s)^.*?://[^/?#]*', 0), '{UPPER}', '{LOWER}') || regexp_extract(regexp_replace({url}, '(?s)#.*$', ''), '(?s)^.*?://[^/?#]*(.*)$', 1))"


# Absolute canonical links in double quotes; the operator follows every kind.
_LINKS = r"""SELECT url, unnest(regexp_extract_all(html, '(?i)<link\s+rel="canonical"\s+href="([^"]*://[^"]*)"', 1)) AS to_url FROM pages"""
SQL = {
    "op9_url_filter": rf"""
    WITH RECURSIVE e AS (SELECT {_node("url")} AS u, {_node("to_url")} AS v FROM ({_LINKS}) WHERE contains(url, '://')),
    both_ways AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
    reach AS (SELECT u AS node, u AS url FROM both_ways UNION SELECT reach.node, both_ways.v FROM reach JOIN both_ways ON reach.url = both_ways.u),
    {_ruled("reach", "met")},
    decided AS (SELECT node, CASE WHEN bool_or(rule IS NOT NULL AND rule NOT IN ({_BLOCKS})) THEN 'allow' WHEN bool_or(rule IN ({_BLOCKS})) THEN 'block' END AS by_alias FROM met GROUP BY node),
    {_ruled("pages", "p")}
    SELECT page_id, host, path, rule, CASE WHEN rule IN ({_BLOCKS}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE coalesce(by_alias, 'allow') END AS verdict
    FROM p LEFT JOIN decided ON node = {_node("p.url")}""",
    "url_site_aliases": rf"""
    WITH {_ruled("pages", "p")},
    s AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(m|www)\.', '') END AS site FROM p),
    d AS (SELECT site, bool_or(rule IS NOT NULL AND rule NOT IN ({_BLOCKS})) AS allowed, bool_or(rule IN ({_BLOCKS})) AS blocked FROM s GROUP BY site)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ({_BLOCKS}) THEN 'block' WHEN rule IS NOT NULL OR allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
    FROM s LEFT JOIN d USING (site)""",
}
QUERIES = {"op9_url_filter": op9_url_filter, "url_site_aliases": url_site_aliases}
