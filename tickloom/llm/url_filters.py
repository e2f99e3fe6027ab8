"""URL filters: rules by host and path, and block decisions that spread over redirects and canonical links (no Python on the data path)."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components
from .quality_rules import _let

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class UrlRule:
    """A verdict on a host with all its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The rules of the contract.
RULES = (UrlRule(BLOCK, "net", "/"), UrlRule(ALLOW, "example.net", "/en/"), UrlRule(BLOCK, "example.com", "/de/"), UrlRule(ALLOW, "org", "/fr/"))


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _host(rest: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))


def _path(rest: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if the url is null or has no ``://``."""
    return _host(_rest(url))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty if the url is null or has no ``://``."""
    return _path(_rest(url))


def _ordered(rules: Sequence[UrlRule]) -> list[UrlRule]:
    """Longest first; of equally long ones an allow goes before a block."""
    return sorted(rules, key=lambda r: (-len(r.name), r.verdict != ALLOW, r.name))


def _rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """(name, verdict) of the longest rule that fits; null if none does."""
    found = [F.when(r.fits(host, path), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in _ordered(rules)]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<name:string,verdict:string>")


def _resource(rest: Column, host: Column, path: Column) -> Column:
    host, path = F.regexp_replace(host, ":(80|443)$", ""), F.when(path == "", "/").otherwise(path)
    return F.unhex(F.substring(F.sha2(F.concat(host, path, F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)), 256), 1, 32))


def judged(url: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    """(host, path, rule, verdict, resource) of a url; rule and verdict are null if no rule fits.

    ``resource`` is a 16-byte name of what the url stands for: host without a default port, path
    and query. Scheme and fragment don't count: the fragment never reaches the server, and http
    redirects to https. It is null without ``://``, and host and path are empty then.
    """
    def with_rule(x: Column, rest: Column) -> Column:
        return _let(_rule(x.host, x.path, rules), lambda r: F.struct(x.host.alias("host"), x.path.alias("path"), r["name"].alias("rule"), r["verdict"].alias("verdict"), F.when(rest.isNotNull(), _resource(rest, x.host, x.path)).alias("resource")))

    return _let(_rest(url), lambda rest: _let(F.struct(_host(rest).alias("host"), _path(rest).alias("path")), lambda x: with_rule(x, rest)))


# How HTML spells a canonical link and a redirect by refresh.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
TAGS = r"(?i)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?i)^<link\b.*\brel\s*=\s*(?:canonical\b|""\"[^\"]*\\bcanonical\\b|'[^']*\\bcanonical\\b)"
REFRESH = r"(?i)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
TARGET = r"(?is)\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'>]*)"


def declared_links(html: Column) -> Column:
    """The targets of a page's canonical links and of its redirects by refresh, as they are written.

    Comments, scripts and styles don't count. Null html gives an empty array.
    """
    tags = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, ""), F.lit(TAGS), F.lit(0))
    href = lambda t: F.concat(*[F.regexp_extract(t, HREF, i) for i in (1, 2, 3)])
    links = F.transform(tags, lambda t: F.when(t.rlike(CANONICAL), href(t)).when(t.rlike(REFRESH), F.regexp_extract(t, TARGET, 1)))
    some = F.filter(F.transform(links, lambda x: F.replace(F.btrim(x, F.lit(" \t\r\n")), F.lit("&amp;"), F.lit("&"))), lambda x: x != "")
    return F.coalesce(F.when(html.rlike("(?i)canonical|refresh"), some), F.array().cast("array<string>"))


def resolved(link: Column, url: Column) -> Column:
    """``link`` as an absolute url, as a page at ``url`` writes it; null for fragments and for what isn't a place.

    Dot segments stay as they are.
    """
    def at(rest: Column) -> Column:
        site, path = F.concat(F.lit("http://"), F.regexp_extract(rest, "^[^/?#]*", 0)), _path(rest)
        folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
        return (F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
                .when(link.startswith("//"), F.concat(F.lit("http:"), link))
                .when(link.startswith("/"), F.concat(site, link))
                .when(link.startswith("?"), F.concat(site, path, link))
                .when(link.startswith("#") | link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
                .otherwise(F.concat(site, folder, link)))

    return _let(_rest(url), at)


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, to_url) of the canonical links and refresh redirects that pages declare."""
    here = F.col(f"`{url}`")
    links = pages.where(_rest(here).isNotNull()).select(here.alias("from_url"), F.explode(declared_links(F.col(f"`{html}`"))).alias("link"))
    return links.select("from_url", resolved(F.col("link"), F.col("from_url")).alias("to_url")).where("to_url IS NOT NULL")


def class_decisions(pages: DataFrame, links: DataFrame, rules: Sequence[UrlRule] = RULES, url: str = "url") -> DataFrame:
    """(resource, decision) of every resource whose class holds a url that a rule decides; one row each.

    ``links``: (from_url, to_url). Classes are the connected components of resources over links.
    Targets of links that are no pages count with the verdict that the rules give their urls. In a
    class with both verdicts the explicit allow takes precedence.
    """
    scratch = Scratch(pages.sparkSession, "aliases")
    ends = links.select(judged(F.col("from_url"), rules).alias("a"), judged(F.col("to_url"), rules).alias("b"))
    edges = scratch.write(ends.select(F.col("a.resource").alias("a"), F.col("b.resource").alias("b"), F.col("a.verdict").alias("va"), F.col("b.verdict").alias("vb")).where("a <> b").distinct())
    nodes = components(edges)
    urls = pages.select(judged(F.col(f"`{url}`"), rules).alias("_j")).select("_j.resource", "_j.verdict")
    marks = urls.unionByName(edges.select(F.col("a").alias("resource"), F.col("va").alias("verdict"))).unionByName(edges.select(F.col("b").alias("resource"), F.col("vb").alias("verdict"))).where("resource IS NOT NULL")
    marks = marks.groupBy("resource").agg(*[F.coalesce(F.max(F.col("verdict") == v), F.lit(False)).alias(v) for v in (ALLOW, BLOCK)])
    marks = marks.join(nodes.select(F.col("node").alias("resource"), "root"), "resource", "left").withColumn("class", F.coalesce("root", "resource"))
    classes = marks.groupBy("class").agg(F.max(ALLOW).alias("_allow"), F.max(BLOCK).alias("_block")).where("_allow OR _block")
    return marks.join(classes, "class").select("resource", F.when(F.col("_allow"), ALLOW).otherwise(BLOCK).alias("decision"))


def url_filter(pages: DataFrame, rules: Sequence[UrlRule] = RULES, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html", default: str = ALLOW) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``decided_by`` (rule, alias or default).

    A page takes the verdict of the longest rule that fits its url. One without a rule takes that of
    its aliases: the pages and link targets it is connected to by canonical links and refresh
    redirects (read from ``html``, if given) and by ``redirects`` (from_url, to_url). An alias that a
    rule blocks blocks it, unless a rule allows another alias. Pages without either get ``default``.

    Null urls and urls without ``://`` have empty host and path, no aliases, and get ``default``.
    Null html has no links. Repeated rows stay, each with the same verdict; an empty table gives an
    empty one. Columns of the names above are replaced; the others are moved with the pages that no
    rule decides, so large ones are better left out and joined by id.
    """
    place = F.col(f"`{url}`")
    links = [] if html is None else [alias_links(pages, url, html)]
    links += [] if redirects is None else [redirects.select("from_url", "to_url")]
    names = ("host", "path", "rule", "verdict")
    out = pages.withColumn("_judged", judged(place, rules)).withColumns({k: F.col(f"_judged.{k}") for k in names}).withColumn("_resource", F.col("_judged.resource")).drop("_judged")
    ruled = out.where("rule IS NOT NULL").withColumn("decided_by", F.lit("rule"))
    lone = out.where("rule IS NULL AND _resource IS NULL").withColumns({"verdict": F.lit(default), "decided_by": F.lit("default")})
    free = out.where("rule IS NULL AND _resource IS NOT NULL")
    if links:
        links = links[0] if len(links) == 1 else links[0].unionByName(links[1])
        decided = class_decisions(pages, links, rules, url).select(F.col("resource").alias("_resource"), F.col("decision").alias("_decision"))
        free = free.join(decided, "_resource", "left")
    else:
        free = free.withColumn("_decision", F.lit(None).cast("string"))
    free = free.withColumns({"verdict": F.coalesce("_decision", F.lit(default)), "decided_by": F.when(F.col("_decision").isNull(), "default").otherwise("alias")})
    return ruled.unionByName(free.drop("_decision")).unionByName(lone).drop("_resource")



def op11_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` under the contract's rules; what no rule decides goes by its aliases, else it is allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = alias_links(pages)
    return url_filter(pages.select("page_id", "url"), redirects=links, html=None).select("page_id", "host", "path", "rule", "verdict")


def _sql_first(of: str) -> str:
    fits = [f"WHEN (h = '{r.host}' OR ends_with(h, '.{r.host}')) AND starts_with(p, '{r.path}') THEN '{getattr(r, of)}'" for r in _ordered(RULES)]
    return f"CASE {' '.join(fits)} END"


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP11_SQL = rf"""
WITH RECURSIVE
src AS (SELECT row_number() OVER () AS r, page_id, url, html FROM pages),
tags AS (SELECT r, url, unnest(regexp_extract_all(regexp_replace(html, {_sql_text(HIDDEN)}, '', 'g'), {_sql_text(TAGS)})) AS t FROM src),
links AS (SELECT url, replace(trim(CASE
        WHEN regexp_matches(t, {_sql_text(CANONICAL)}) THEN regexp_extract(t, {_sql_text(HREF)}, 1) || regexp_extract(t, {_sql_text(HREF)}, 2) || regexp_extract(t, {_sql_text(HREF)}, 3)
        WHEN regexp_matches(t, {_sql_text(REFRESH)}) THEN regexp_extract(t, {_sql_text(TARGET)}, 1) END, ' ' || chr(9) || chr(10) || chr(13)), '&amp;', '&') AS l FROM tags),
base AS (SELECT *, regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') AS site, regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS p
    FROM links WHERE strpos(url, '://') > 0 AND l <> ''),
edges AS (SELECT url AS u, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN l LIKE '//%' THEN 'http:' || l WHEN l LIKE '/%' THEN 'http://' || site || l
        WHEN l LIKE '?%' THEN 'http://' || site || p || l WHEN l LIKE '#%' OR regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
        ELSE 'http://' || site || CASE WHEN p = '' THEN '/' ELSE regexp_replace(p, '[^/]*$', '') END || l END AS v FROM base),
urls AS (SELECT url FROM src UNION SELECT u FROM edges WHERE v IS NOT NULL UNION SELECT v FROM edges WHERE v IS NOT NULL),
cut AS (SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM urls),
parts AS (SELECT url, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS h,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS p FROM cut),
judged AS (SELECT *, {_sql_first("name")} AS rule, {_sql_first("verdict")} AS own,
    CASE WHEN rest IS NOT NULL THEN regexp_replace(h, ':(80|443)$', '') || CASE WHEN p = '' THEN '/' ELSE p END || regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) END AS k FROM parts),
step AS (SELECT DISTINCT a.k AS x, b.k AS y FROM edges e JOIN judged a ON a.url = e.u JOIN judged b ON b.url = e.v WHERE a.k <> b.k),
ways AS (SELECT x, y FROM step UNION SELECT y, x FROM step),
reach(x, y) AS (SELECT k, k FROM judged WHERE k IS NOT NULL UNION SELECT r.x, b.y FROM reach r JOIN ways b ON b.x = r.y),
decided AS (SELECT x AS k, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM reach JOIN judged ON judged.k = reach.y GROUP BY x)
SELECT page_id, h AS host, p AS path, rule, coalesce(own, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM src JOIN judged ON judged.url IS NOT DISTINCT FROM src.url LEFT JOIN decided USING (k)
"""
