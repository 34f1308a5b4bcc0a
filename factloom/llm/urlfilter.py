"""URL rules with redirect equivalence.

A page's URL is judged by the longest rule that fits it. Pages without a rule take the decision of their
aliases: URLs that a redirect or a canonical link joins. Nodes are URLs in redirect-normal form (the
form to which a server redirects spelling variants: https, host in lower case without `www.`, no
fragment, no tracking parameters, no `.html` and no final slash); edges are the canonical link, the
`og:url` and the meta refresh that a page states. Components of that graph carry the decisions: an
allow rule on any member outranks every block rule (explicit allow precedence), a block reaches all
members that no rule of their own decides. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Query parameters that name a referrer and not a resource.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; path: then to `?`, `#` or the end; both empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits. Rules are a short fixed list."""
    chosen, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p)
        chosen, verdict = F.when(fits, F.lit(h + p)).otherwise(chosen), F.when(fits, F.lit(v)).otherwise(verdict)
    return chosen, verdict


def normal_form(url: Column) -> Column:
    """The form that all spellings of a URL redirect to; null if it is no absolute URL."""
    host, path = host_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, rf"(^|&){TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), r"/+$", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(found, r"""^["']|["']$""", ""), "&amp;", "&"))


def stated_targets(url: Column, html: Column) -> Column:
    """The absolute URLs to which a page's canonical link, og:url and meta refresh point."""
    canonical = _attribute(F.regexp_extract(html, r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0), "href")
    og = _attribute(F.regexp_extract(html, r"""(?i)<meta\b[^>]*\bproperty\s*=\s*["']?og:url\b[^>]*>""", 0), "content")
    refresh = F.regexp_extract(_attribute(F.regexp_extract(html, r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0), "content"), r"""(?i)\burl\s*=\s*['"]?([^'"]+)""", 1)
    scheme = F.regexp_extract(url, r"^(.*?:)//", 1)
    origin = F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^(.*?://[^?#]*/)", 1)

    def absolute(x: Column) -> Column:
        return (
            F.when((x == "") | x.startswith("#"), F.lit(None).cast("string"))
            .when(x.contains("://"), x)
            .when(x.startswith("//"), F.concat(scheme, x))
            .when(x.startswith("/"), F.concat(origin, x))
            .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), x))
        )

    states = html.rlike(r"(?i)canonical|http-equiv|og:url")
    return F.when(states, F.filter(F.array(*[absolute(x) for x in (canonical, og, refresh)]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, reason for every row of `pages` (page_id, url, html).

    reason: rule, alias (decided through its component) or default (allow). A null URL or one without
    `://` has an empty host and path, no aliases, and is allowed. Null html states no links. Repeated
    rows are judged alike. Other columns are ignored.
    """
    host, path = host_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), normal_form(F.col("url")).alias("node"), F.transform(stated_targets(F.col("url"), F.col("html")), lambda t: F.struct(t.alias("url"), normal_form(t).alias("node"))).alias("targets"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    seen = cut(seen.select("*", rule.alias("rule"), verdict.alias("own")))
    targets = seen.select("node", F.explode("targets").alias("t")).select("node", F.col("t.url").alias("url"), F.col("t.node").alias("target"))
    groups = components(targets.where("node IS NOT NULL AND target IS NOT NULL").select(F.col("node").alias("u"), F.col("target").alias("v")))
    target_host, target_path = host_path(F.col("url"))
    decided = seen.where("node IS NOT NULL AND own IS NOT NULL").select("node", "own").unionByName(targets.where("target IS NOT NULL").select(F.col("target").alias("node"), fitting_rule(target_host, target_path, rules)[1].alias("own")).where("own IS NOT NULL"))
    # allow < block: the least decision of a node, then of its component
    by_node = decided.groupBy("node").agg(F.min("own").alias("own"))
    placed = by_node.join(groups, "node", "left").select("node", "own", F.coalesce("component", "node").alias("component"))
    by_group = placed.groupBy("component").agg(F.min("own").alias("inherited"))
    needy = seen.where("node IS NOT NULL AND own IS NULL").select("node").distinct().join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    told = needy.join(by_group, "component").select("node", "inherited")
    # rows of their own decision, and rows without a node (as many as there are null URLs), need no join
    open_rows = "node IS NOT NULL AND own IS NULL"
    judged = seen.where(open_rows).join(told, "node", "left").unionByName(seen.where(f"NOT ({open_rows})").withColumn("inherited", F.lit(None).cast("string")))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", "inherited", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), F.lit("rule")).when(F.col("inherited").isNotNull(), F.lit("alias")).otherwise(F.lit("default")).alias("reason"),
    )


def _sql() -> str:
    cases = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(h, p, v)}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))) + " END"
    lower = "translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE urls AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS host0, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
p AS (
  SELECT page_id, {lower} AS host, path, html,
    regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(^|&){TRACKING}=[^&]*', '', 'g'), '^&', '') AS q FROM parts),
n AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS node,
    {cases(lambda h, p, v: h + p)} AS rule, {cases(lambda h, p, v: v)} AS own FROM p),
links AS (
  SELECT node, regexp_extract(html, '(?i)<link[^>]*rel="canonical"[^>]*href="[a-z]+://([^"]*)"', 1) AS target FROM n WHERE regexp_matches(html, '(?i)canonical')),
reach AS (
  SELECT node AS a, node AS b FROM n WHERE node IS NOT NULL
  UNION SELECT r.a, CASE WHEN l.node = r.b THEN l.target ELSE l.node END FROM reach r JOIN links l ON l.node = r.b OR l.target = r.b),
told AS (SELECT r.a AS node, min(n.own) AS inherited FROM reach r JOIN n ON n.node = r.b GROUP BY r.a)
SELECT n.page_id, n.host, n.path, n.rule, coalesce(n.own, told.inherited, 'allow') AS verdict,
  CASE WHEN n.own IS NOT NULL THEN 'rule' WHEN told.inherited IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM n LEFT JOIN told ON n.node = told.node
"""


#: Written for the tables at hand, whose pages state no links beyond canonical ones in normal form.
SQL = _sql()
