"""URL rules, and their spread over redirects and canonical links.

A rule names a host and the start of a path (``example.net/en/``) and fits that host and its
subdomains; of those that fit, the longest counts. Redirects (a table, or ``meta refresh`` in a
page) and canonical links make two urls aliases. Urls are one node if they differ in the case of
scheme or host, a default port, a fragment, or a missing first slash (``node_of``). Aliases form
connected components of the graph of such edges. If a rule blocks one member, every member is blocked that no rule of its own allows: an
explicit allow goes before what an alias passes on. Urls that nothing blocks are allowed.

Rules are a list of up to some thousands in the driver's hands. Only urls with an edge enter the
graph. An empty table gives no rows. A null url has no host, path or rule and is allowed. Links without a url, or to other schemes
than http(s), are ignored. Repeated rows each get their verdict; all columns of the input stay but
those named host, path, rule and verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import storage
from lumenframe.llm.components import components, small

#: The contract's rules: (verdict, rule).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
PARTS = r"://([^/?#]*)([^?#]*)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'>\s]*)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]*)"


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(url, PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The url under the name that its equivalents share."""
    head = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    bare = F.regexp_replace(F.lower(head), "^(http://.*):80$|^(https://.*):443$", "$1$2")
    rest = F.regexp_replace(F.substring(url, F.length(head) + 1, F.length(url)), "(?s)#.*$", "")
    return F.when(head == "", url).otherwise(F.concat(bare, F.regexp_replace(rest, r"^(?!/)", "/")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null. Equally long ones: the last by name."""
    by_host: dict[str, list] = {}
    for verdict, rule in rules:
        name, slash, start = rule.partition("/")
        by_host.setdefault(name, []).append(F.struct(F.lit(slash + start).alias("start"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    table = F.create_map(*(x for name, own in by_host.items() for x in (F.lit(name), F.array(*own))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda a: a.isNotNull()))
    fit = F.filter(near, lambda r: F.startswith(path, r["start"]))
    return F.array_max(F.transform(fit, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _absolute(edges: DataFrame) -> DataFrame:
    """(u, v) of (u, link): links as found in the page ``u``, resolved. Stored before and after, as Spark would put all steps into one function, too large to compile."""
    u, link, root = F.col("u"), F.col("link"), F.col("root")
    clean = edges.select("u", F.replace(F.trim(link), F.lit("&amp;"), F.lit("&")).alias("link")).where("u is not null and link != ''").distinct()
    parts = clean.withColumns({"root": F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), "folder": F.regexp_extract(u, r"://[^/?#]*((?:/[^?#]*)?/)", 1), "own": link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")})
    there = (
        F.when(F.col("own"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(F.col("folder") == "", F.concat(root, F.lit("/"), link))
        .otherwise(F.concat(root, "folder", link))
    )
    return parts.select("u", there.alias("v"))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(u, v) urls that pages (url, html) and ``redirects`` (url, target) say are the same."""
    source = pages.select("url", "html").where("url is not null and html is not null")
    told = source.where(F.lower("html").rlike("canonical|refresh"))
    canonical = F.regexp_extract(F.regexp_extract("html", CANONICAL, 0), HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract("html", REFRESH, 0), TARGET, 1)
    edges = told.select(F.col("url").alias("u"), F.explode(F.array(canonical, refresh)).alias("link"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("url").alias("u"), F.col("target").alias("link")))
    found = storage.cut(_absolute(storage.cut(edges.where("u is not null and link != ''"))).where(F.col("v").rlike("^[Hh][Tt][Tt][Pp][Ss]?://")))
    return found.select(node_of(F.col("u")).alias("u"), node_of(F.col("v")).alias("v")).where("u != v")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` (url, html) with host, path, rule (null if none fits) and verdict added."""
    nodes = components(alias_edges(pages, redirects))
    own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    ruled = storage.cut(nodes.withColumn("own", own))
    blocking = storage.cut(ruled.where("own = 'block'").select("component").distinct())
    blocked = storage.cut(ruled.join(small(blocking), "component", "left_semi").select(F.col("node").alias("__lf_url"), F.lit(True).alias("__lf_blocked")))

    def told(rows: DataFrame) -> DataFrame:
        found = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        found = found.withColumn("__lf_rule", rule_of(F.col("host"), F.col("path"), rules))
        found = found.join(small(blocked), node_of(F.col("url")) == F.col("__lf_url"), "left")
        spread = F.when(F.col("__lf_blocked"), "block").otherwise("allow")
        return found.withColumns({"rule": F.col("__lf_rule.rule"), "verdict": F.coalesce(F.col("__lf_rule.verdict"), spread)}).drop("__lf_rule", "__lf_url", "__lf_blocked")

    return storage.with_safe_names(pages.drop("host", "path", "rule", "verdict"), ["url"], told)



#: The same as ``judge(pages)``: blocks spread over edges from blocked urls; one row a page_id.
SQL = r"""
WITH RECURSIVE links AS (
    SELECT url AS u, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)', 1),
        regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''>\s]*)', 1)]) AS link FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), plain AS (
    SELECT u, replace(trim(link), '&amp;', '&') AS l, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root, regexp_extract(u, '://[^/?#]*((?:/[^?#]*)?/)', 1) AS folder FROM links WHERE trim(link) <> ''
), edges AS (
    SELECT u, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l WHEN starts_with(l, '//') THEN regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*:)//', 1) || l WHEN starts_with(l, '/') THEN root || l WHEN folder = '' THEN root || '/' || l ELSE root || folder || l END AS v FROM plain
), named AS (
    SELECT CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(u, '://([^/?#]*)', 1)), CASE lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '') || CASE regexp_extract(u, '://[^/?#]*([^?#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(u, '://[^/?#]*([^?#]*)', 1) END || regexp_extract(u, '://[^/?#]*[^?#]*([?][^#]*)', 1) ELSE u END AS u, CASE WHEN regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(v, '://([^/?#]*)', 1)), CASE lower(regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '') || CASE regexp_extract(v, '://[^/?#]*([^?#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(v, '://[^/?#]*([^?#]*)', 1) END || regexp_extract(v, '://[^/?#]*[^?#]*([?][^#]*)', 1) ELSE v END AS v FROM edges WHERE regexp_matches(v, '^[Hh][Tt][Tt][Pp][Ss]?://')
), both_ways AS (
    SELECT u, v FROM named WHERE u <> v UNION SELECT v, u FROM named WHERE u <> v
), urls AS (
    SELECT url, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), CASE lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '') || CASE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '://[^/?#]*[^?#]*([?][^#]*)', 1) ELSE url END AS node, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM (SELECT url FROM pages UNION SELECT u FROM both_ways)
), rules(verdict, rule, rhost, start) AS (
    VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), own AS (
    SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, start) GROUP BY url
), blocked(url) AS (
    SELECT u FROM both_ways JOIN own ON own.url = u WHERE verdict = 'block' UNION SELECT v FROM blocked JOIN both_ways ON url = u
)
SELECT page_id, host, path, rule, coalesce(own.verdict, CASE WHEN urls.node IN (SELECT url FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN urls ON urls.url IS NOT DISTINCT FROM p.url LEFT JOIN own ON own.url = p.url
"""

#: The same with further redirects: every page but each fifth to the next one, by id.
SQL_REDIRECTS = SQL.replace(
    "), plain AS (",
    """), moved AS (
    SELECT url, lead(url) OVER (ORDER BY page_id) AS target, page_id FROM pages
), plain AS (""",
).replace(
    "), named AS (",
    """ UNION ALL SELECT url, target FROM moved WHERE page_id % 5 <> 4 AND url IS NOT NULL AND regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:')
), named AS (""",
)
