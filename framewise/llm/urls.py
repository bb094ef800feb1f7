"""URL rules with redirect equivalence: decisions spread over addresses that name one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower
from .components import connected_components

#: The rules of the registered query, (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Characters of a path that are put together before they are laid aside, so that a step never copies the whole.
PIECE = 2000


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_path(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments, read from its end: a ``..`` takes the next segment that nothing has
    taken yet."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    names = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    state = lambda gone, now, done: F.struct(gone.cast("int").alias("gone"), now.alias("now"), done.alias("done"))

    def step(s: Column, x: Column) -> Column:
        kept = F.when(F.length(s["now"]) < PIECE, state(F.lit(0), F.concat(F.lit("/"), x, s["now"]), s["done"])).otherwise(state(F.lit(0), F.concat(F.lit("/"), x), F.array_append(s["done"], s["now"])))
        taken = F.when(s["gone"] > 0, state(s["gone"] - 1, s["now"], s["done"])).otherwise(kept)
        return F.when(x == ".", s).when(x == "..", state(s["gone"] + 1, s["now"], s["done"])).otherwise(taken)

    none = state(F.lit(0), F.lit(""), F.array().cast("array<string>"))
    left = F.aggregate(F.reverse(F.slice(names, 2, F.size(names))), none, step, lambda s: F.concat(s["now"], F.array_join(F.reverse(s["done"]), "")))
    dotted = F.rlike(path, F.lit(r"/\.{1,2}(?:/|$)"))
    return F.when(dotted, F.when(left == "", "/").otherwise(left)).otherwise(path)


def canonical_key(url: Column) -> Column:
    """One name for the spellings of an address that are the same by the rules of addresses alone: scheme and host in
    lower case, no fragment, no default port, no dot segments, ``/`` for an empty path. What else names the same page,
    a link or a redirect has to say."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.when(scheme == "http", F.regexp_replace(host_of(url), ":80$", "")).when(scheme == "https", F.regexp_replace(host_of(url), ":443$", "")).otherwise(host_of(url))
    path = path_of(url)
    query = F.regexp_extract(rest_of(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(plain_path(path)), query)


def resolved(href: Column, base: Column) -> Column:
    """Absolute address of a link, seen from the address ``base``."""
    href = F.trim(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(rest_of(base), r"^[^/?#]*", 0))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href))
        .when((href == "") | F.startswith(href, F.lit("#")), base)
        .when(F.startswith(href, F.lit("?")), F.concat(site, path_of(base), href))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or not; empty without it."""
    at = rf"(?i)[\s\"'/]{name}\s*=\s*"
    value = F.coalesce(F.nullif(F.regexp_extract(tag, at + r'"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(tag, at + r"'([^']*)'", 1), F.lit("")), F.regexp_extract(tag, at + r"([^\s\"'>]+)", 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "&quot;", '"'), "&#0*39;|&apos;", "'"), "&amp;|&#0*38;|&#[xX]0*26;", "&")


def links_in(html: Column, url: Column) -> Column:
    """Absolute targets of the canonical links and meta refresh redirects in a page, seen from its ``base`` if it has
    one."""
    page = F.coalesce(html, F.lit(""))
    tags = F.regexp_extract_all(page, F.lit(r"(?i)<(?:link|meta|base)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: F.rlike(t, F.lit(r"(?i)^<link")) & F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(tags, lambda t: F.rlike(t, F.lit(r"(?i)^<meta")) & (F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh"))
    bases = F.filter(tags, lambda t: F.rlike(t, F.lit(r"(?i)^<base")) & (_attribute(t, "href") != ""))
    base = F.when(F.size(bases) > 0, resolved(_attribute(F.get(bases, 0), "href"), url)).otherwise(url)
    found = F.concat(
        F.transform(canonical, lambda t: _attribute(t, "href")),
        F.transform(refresh, lambda t: F.regexp_replace(F.regexp_extract(_attribute(t, "content"), r"(?i)url\s*=\s*(.*)$", 1), "^[\"']|[\"']$", "")),
    )
    marked = F.rlike(page, F.lit(r"(?i)canonical|http-equiv"))
    return F.when(marked, F.transform(F.filter(found, lambda x: F.trim(x) != ""), lambda x: resolved(x, base))).otherwise(F.array().cast("array<string>"))


def with_rule(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and decision: of the rules whose host is the row's or a parent of it and whose path starts the row's,
    the longest; of equals, allow. An equality join on the host's suffixes, so the rule table may be long; those of more
    labels than any rule's host has can't match and are not made."""
    parts = F.split("host", r"\.")
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - (labels - 1)), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    hosts = df.select("host", "path").where("host <> ''").distinct()
    told = rules.select(F.col("verdict").alias("decision"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    fits = hosts.withColumn("rule_host", F.explode(suffixes)).join(told, "rule_host").where(F.startswith(F.col("path"), F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), (F.col("decision") == "allow").alias("allow"), rule.alias("rule"), F.col("decision").alias("decision"))).alias("best"))
    return df.join(best.select("host", "path", "best.rule", "best.decision"), ["host", "path"], "left")


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(row, url) of every address that a row of ``pages(row, url, links)`` has or links to, and of both addresses of
    each row of ``redirects(row, source, target)``."""
    named = pages.select("row", "url").unionByName(pages.select("row", F.explode("links").alias("url")))
    if redirects is not None:
        named = named.unionByName(redirects.where("source is not null and target is not null").select("row", F.explode(F.array("source", "target")).alias("url")))
    return named.where(host_of(F.col("url")) != "")


def judge(pages: DataFrame, rules: DataFrame, work: Workspace, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component, spread) of ``pages(page_id, url, html)``.

    Pages with the same address, and pages and addresses that a canonical link, a meta refresh or a row of
    ``redirects(source, target)`` connects, are one component. A page that a rule fits has that rule's verdict. Any other
    page is blocked if a page or target of its component is blocked by a rule and none is explicitly allowed; else
    allowed. ``spread`` tells that the verdict came from the component, ``component`` is a number of its own.

    A null url or one without ``://``: host and path are empty, no rule, no alias and no component. Null html: no links.
    Rows repeat as they come; a null page_id is a page like another. Other columns are ignored; an empty table gives no
    rows.
    """
    own = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), links_in(F.col("html"), F.col("url")).alias("links"))
    own = work.stage(own, "pages")
    if redirects is not None:
        # a redirect is a node of its own, numbered below all pages
        redirects = work.stage(redirects.select((-1 - F.monotonically_increasing_id()).alias("row"), "source", "target"), "redirects")
    named = alias_edges(own, redirects).select("row", canonical_key(F.col("url")).alias("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = work.stage(with_rule(named.distinct(), rules).select("row", "key", "decision"), "keys")
    # rows with the same address are linked to the first of them
    least = named.groupBy("key").agg(F.min("row").alias("b"))
    edges = named.select("row", "key").join(least, "key").select(F.col("row").alias("a"), "b")
    parts = work.stage(connected_components(edges, work).withColumnRenamed("node", "row"), "components")
    told = named.where("decision is not null").join(parts, "row")
    flags = told.groupBy("component").agg(F.bool_or(F.col("decision") == "allow").alias("allowed"), F.bool_or(F.col("decision") == "block").alias("blocked"))
    out = with_rule(own.select("row", "page_id", "host", "path"), rules)
    out = out.join(parts, "row", "left").join(flags, "component", "left")
    spread = F.when(F.col("blocked") & ~F.col("allowed"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("decision", spread).alias("verdict"), "component", (F.col("decision").isNull() & F.coalesce(F.col("blocked") & ~F.col("allowed"), F.lit(False))).alias("spread"))
