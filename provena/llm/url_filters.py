"""URL rules with redirect equivalence: a block reaches the aliases of a blocked address.

Addresses joined by a redirect or by a canonical link name the same page. Their connected components are
computed over DataFrames, and an address without a rule of its own takes its component's decision: allow if any
member is allowed by a rule, else block if any member is blocked, else allow. A rule on the address itself wins.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import materialize
from provena.llm.components import connected_components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, ASCII letters lower-cased; empty without ://."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query, without the fragment: what tells pages apart; empty without ://."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.concat(host_of(url), path_of(url), query)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, nulls where none does; ties go to allow, then by text."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def without_dots(path: Column) -> Column:
    """The path, from its first slash, with . and .. segments taken away as browsers do; a .. beyond the top goes too."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    last = F.element_at(parts, -1)
    step = lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.array_append(out, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolved(target: Column, source: Column) -> Column:
    """The target as an address of its own; one without scheme or host takes them, and its folder, from the source."""
    scheme = F.regexp_extract(source, r"(?s)^(.*?)://", 1)
    folder = F.regexp_replace(path_of(source), r"[^/]*$", "")
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    plain = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    path = F.when(plain == "", path_of(source)).otherwise(without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), plain)))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host_of(source), target))
        .when(plain.contains("://") | (host_of(source) == ""), target)
        .otherwise(F.concat(scheme, F.lit("://"), host_of(source), path, rest))
    )


def html_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) addresses of canonical links and refresh redirects; relative targets are resolved by the page's address."""
    low = F.lower(F.col(html))
    quick = pages.filter(low.contains("canonical") | low.contains("refresh")).select(F.col(url).alias("source"), F.col(html).alias("h"))
    tags = quick.select("source", F.explode(F.regexp_extract_all("h", F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.when(
        F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    )
    refresh = F.when(
        F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    )
    found = tags.select("source", F.coalesce(canonical, refresh).alias("target")).filter("target <> ''")
    return found.select("source", resolved(F.col("target"), F.col("source")).alias("target")).filter("instr(target, '://') > 0")


def judge_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: key, host, path, rule, verdict, alias_root.

    rules: a fixed list, compiled into one expression. redirects: further (source, target) addresses.
    Addresses are told apart by host, path and query; rules judge host and path. Null or malformed urls have empty
    host and path, no alias and the verdict allow. Repeated rows are judged each; a null key stays null; html may be
    null; texts of any length are whole; other columns are ignored. alias_root, the smallest address of the component,
    is null outside any. No pages give no rows.
    """
    base = pages.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), address_of(F.col(url)).alias("node"))
    links = html_links(pages.select(url, html), url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    edges = materialize(links.select(address_of(F.col("source")).alias("a"), address_of(F.col("target")).alias("b")).filter("a <> '' and b <> ''").distinct(), "url-links")
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if edges.isEmpty():
        return base.select(key, "host", "path", text.alias("rule"), F.coalesce(verdict, F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_root"))
    parts = materialize(connected_components(edges, "a", "b", "url-components"), "url-members")
    at = F.concat(F.lit("x://"), F.col("node"))
    own = parts.select("root", rule_of(host_of(at), path_of(at), rules)[1].alias("v"))
    decided = own.groupBy("root").agg(F.when(F.max(F.col("v") == "allow"), "allow").when(F.max(F.col("v") == "block"), "block").alias("spread"))
    nodes = materialize(parts.join(materialize(decided, "url-roots"), "root").select(F.col("node"), F.col("root").alias("alias_root"), "spread"), "url-nodes")
    judged = base.join(nodes, "node", "left")
    return judged.select(key, "host", "path", text.alias("rule"), F.coalesce(verdict, "spread", F.lit("allow")).alias("verdict"), "alias_root")
