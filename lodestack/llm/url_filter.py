"""URL rules, with block decisions that reach every alias of a page. DataFrame operations only.

A rule names a host (and its subdomains) and the start of a path; the longest rule that fits
decides. A page without a rule takes the decision of its aliases. Aliases are urls that redirects
(meta refresh) and canonical links of the pages tie together; a url is a node by its form that the
URI syntax makes equal: scheme and host lowered, the scheme's own port, dot segments and fragment
dropped, an empty path as /. Nothing else is taken for an alias without a link. Components of
these edges are found by distributed star contraction; a component that holds an allowed url
allows its pages without a rule, else one that holds a blocked url blocks them, else they are
allowed. A page's own rule always stands. Targets take part with their own decisions even if they
are not pages. All links of a page count, resolved against its url or its first base element;
those in comments, scripts, styles and other raw text are none.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and has
no aliases; repeated rows keep a row each; null html has no edges; links to other schemes than
those with ``//`` lead nowhere; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.components import connected_components
from lodestack.llm.shared import materialise

#: verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path that starts with / without its . and .. segments."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.array_append(kept, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.rlike(r"(?s)/\.{1,2}(/|\z)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """One text for urls that are equal by the syntax of URIs; null without a host."""
    scheme, host = _ascii_lower(_part(url, r"(?s)^(.*?)://")), host_of(url)
    host = F.when(scheme == "http", F.regexp_replace(host, r":(80)?\z", "")).when(scheme == "https", F.regexp_replace(host, r":(443)?\z", "")).otherwise(host)
    path, query = path_of(url), _part(url, r"(?s)^[^?#]*(\?[^#]*)")
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(without_dots(path)), query))


#: What a browser does not read as markup.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes|template)\b[^>]*>.*?(?:</\1\s*>|\z)"
ATTRIBUTE = r"""(?s)([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""


def _tags(html: Column, name: str) -> Column:
    """Start tags of this name; up to 100 quoted values of a tag may hold a >."""
    return F.regexp_extract_all(html, F.lit(rf"""(?is)<{name}\b(?:[^>"']*+(?:"[^"]*+"|'[^']*+')){{0,100}}[^>]*>"""), 0)


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, its first one; empty if there is none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), _ascii_lower)
    values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2)
    at = F.array_position(names, F.lit(name))
    value = F.when(at > 0, F.try_element_at(values, at.cast("int")))
    return F.coalesce(F.regexp_replace(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1\z""", "$2"), r"(?i)&(?:amp|#0*38|#x0*26);", "&"), F.lit(""))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def links(html: Column) -> Column:
    """struct(base, targets): the first base element's link, or an empty text, and all links that html names as redirect or canonical."""
    seen = F.regexp_replace(html, HIDDEN, " ")
    canonical = F.filter(_tags(seen, "link"), lambda t: F.array_contains(F.split(_ascii_lower(_attribute(t, "rel")), r"[\s/]+"), "canonical"))
    refresh = F.filter(_tags(seen, "meta"), lambda t: _ascii_lower(_stripped(_attribute(t, "http-equiv"))) == "refresh")
    jump = lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)^\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1)
    found = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(refresh, jump))
    bases = F.filter(F.transform(_tags(seen, "base"), lambda t: _attribute(t, "href")), lambda x: x != "")
    return F.struct(_stripped(F.coalesce(F.try_element_at(bases, F.lit(1)), F.lit(""))).alias("base"), F.filter(F.transform(found, _stripped), lambda x: x != "").alias("targets"))


def resolved(base: Column, link: Column) -> Column:
    """A link as seen from a url, by the rules for URI references; without its fragment. Null if it leads to no host."""
    link = F.substring_index(link, "#", 1)
    scheme, root = _part(base, r"(?s)^(.*?:)//"), _part(base, r"(?s)^(.*?://[^/?#]*)")
    own, own_query = path_of(base), _part(base, r"(?s)^[^?#]*(\?[^#]*)")
    path, query = _part(link, r"(?s)^([^?]*)"), _part(link, r"(?s)^[^?]*(\?.*)\z")
    merged = F.concat(F.when(own == "", "/").otherwise(F.regexp_replace(own, r"(?s)[^/]*\z", "")), path)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(path == "", F.concat(root, own, F.when(query == "", own_query).otherwise(query)))
        .when(path.startswith("/"), F.concat(root, without_dots(path), query))
        .otherwise(F.concat(root, without_dots(merged), query))
    )


def edges_of(pages: DataFrame) -> DataFrame:
    """src, to: the node of a page and the url that it names as redirect or canonical, null if it leads to no host.

    Links are written before they are resolved, and no filter looks at what is derived from them:
    it would be pushed below, with every expression written out again.
    """
    url = F.col("url").cast("string")
    found = pages.where(F.col("html").rlike("(?i)canonical|refresh") & (host_of(url) != "")).select(url.alias("url"), links(F.col("html")).alias("l"))
    each = materialise(found.select("url", F.col("l.base").alias("base"), F.explode("l.targets").alias("link")), "links")
    each = each.withColumn("from", F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url"))))
    return each.select(node_of(F.col("url")).alias("src"), resolved(F.col("from"), F.col("link")).alias("to"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    url = F.col("url").cast("string")
    own = pages.select("page_id", node_of(url).alias("_node"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("_own", rule_of(F.col("host"), F.col("path"), rules))
    to = F.col("to")
    link = edges_of(pages).select("src", node_of(to).alias("dst"), rule_of(host_of(to), path_of(to), rules)["verdict"].alias("verdict"))
    link = materialise(link.distinct(), "aliases").where("dst is not null")
    flags = [F.max(F.coalesce(F.col("verdict") == v, F.lit(False))).alias(v) for v in ("allow", "block")]
    decided = own.select(F.col("_node").alias("node"), F.col("_own")["verdict"].alias("verdict")).union(link.select("dst", "verdict"))
    nodes = decided.where("node is not null").groupBy("node").agg(*flags)
    if not link.isEmpty():
        found = connected_components(link)
        nodes = nodes.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
        whole = nodes.groupBy("label").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
        nodes = nodes.select("node", "label").join(whole, "label")
    blocked = nodes.where("block and not allow").select(F.col("node").alias("_key"), F.lit("block").alias("_alias"))
    # Pages with a rule or without a host ask no alias; keys of their own keep them from meeting in one task.
    key = F.when(F.col("_own").isNull() & F.col("_node").isNotNull(), F.col("_node")).otherwise(F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))
    judged = own.withColumn("_key", key).join(blocked, "_key", "left")
    return judged.select("page_id", "host", "path", F.col("_own")["rule"].alias("rule"), F.coalesce(F.col("_own")["verdict"], "_alias", F.lit("allow")).alias("verdict"))


#: Rows of judge() where links are absolute urls in double quotes, in tags as written here, outside of comments and raw text.
SQL = r"""
    WITH RECURSIVE p AS (SELECT row_number() OVER () AS n, page_id, url, html FROM pages),
    e AS (SELECT n, unnest(list_concat(regexp_extract_all(html, '<link rel="canonical" href="([^"]+)">', 1), regexp_extract_all(html, '<meta http-equiv="refresh" content="\d+; url=([^"]+)">', 1))) AS url FROM p),
    u AS (SELECT DISTINCT url FROM p UNION SELECT DISTINCT url FROM e),
    h AS (SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, lower(coalesce(regexp_extract(url, '(?s)^(.*?)://', 1), '')) AS scheme,
                 coalesce(regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1), '') AS query FROM u),
    r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
                 CASE WHEN host <> '' THEN scheme || '://' || regexp_replace(host, CASE scheme WHEN 'http' THEN ':(80)?$' WHEN 'https' THEN ':(443)?$' ELSE '$^' END, '') || CASE path WHEN '' THEN '/' ELSE path END || query END AS node FROM h),
    v AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM r),
    l AS (SELECT DISTINCT a.node AS x, b.node AS y FROM e JOIN p USING (n) JOIN v a ON a.url = p.url JOIN v b ON b.url = e.url WHERE a.node <> b.node),
    b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    c AS (SELECT DISTINCT node, node AS label FROM v WHERE node IS NOT NULL UNION SELECT b.y, c.label FROM c JOIN b ON b.x = c.node),
    s AS (SELECT node, min(label) AS label FROM c GROUP BY node),
    g AS (SELECT label, bool_or(coalesce(own = 'allow', false)) AS allow, bool_or(coalesce(own = 'block', false)) AS block FROM s JOIN v USING (node) GROUP BY label)
    SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(own, CASE WHEN block AND NOT allow THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN v ON v.url = p.url LEFT JOIN s ON s.node = v.node LEFT JOIN g ON g.label = s.label
"""
