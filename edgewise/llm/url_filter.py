"""URL filters with redirect equivalence, in DataFrame operations only.

Rules block or allow a host (with all its subdomains) below a path; the longest fitting rule
decides. A url that no rule fits takes the decision of its aliases: urls tied to it by redirects
or canonical links, found as connected components of those edges over the whole table. An allow
rule among the aliases takes precedence over a block rule.

Edges come from what pages say, canonical links and refresh tags in the markup, and from the redirects
that servers make of a url's spelling: to the host without www. or m., without an end slash or .html,
without tracking parameters, whatever the scheme. Other parameters tell pages apart and are kept.

Edge cases: a null url, or one without "://", has empty host and path, fits no rule, has no
aliases and is allowed; repeated urls agree; relative targets of links are resolved against the
page's url; targets without "://" that have a scheme (mailto:) are no links; unknown targets are nodes
of their own, judged on their whole path; an empty table gives an empty result; columns of the input
named host, path, rule or verdict are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.operators.components import connected_components
from edgewise.session import materialize


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first :// up to / ? # or the end, ASCII letters in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as a struct of rule and verdict, else null."""
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        fitting = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(fitting)
    return fitting


#: Parameters that say where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def query_of(url: Column) -> Column:
    """From ? up to # or the end, ? included; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^(?s)[^?#]*(\?[^#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """The name of a url among aliases: without its fragment; null if it has no host."""
    scheme = F.translate(F.regexp_extract(url, r"^(?s)(.*?)://", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), path_of(url), query_of(url)))


def served(url: Column) -> Column:
    """Where servers redirect the spelling of a url to; it has no scheme, as either may be served."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.(?=[^.]+\.)", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html?)+$", "")
    kept = F.filter(F.split(F.substr(query_of(url), F.lit(2)), "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("://"), host, path, query))


def _without_dots(path: Column) -> Column:
    """``path`` with its segments . and .. resolved."""
    parts = F.split(path, "/", -1)
    step = lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    open_end = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(open_end, F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), clean).otherwise(path)


def resolved(to: Column, base: Column) -> Column:
    """The url that the reference ``to`` means on the page ``base``; null where it means no page."""
    site, path = F.concat(F.lit("http://"), host_of(base)), path_of(base)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"^(?s)(.*/)", 1)).otherwise(F.lit("/"))
    whole = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(site, to))
        .when(to.startswith("?"), F.concat(site, path, to))
        .when(to.startswith("#"), F.concat(site, path, query, to))
        .otherwise(F.concat(site, folder, to))
    )
    rest = F.regexp_extract(whole, r"^(?s).*?://[^/?#]*[^?#]*(.*)$", 1)
    return F.concat(F.lit("http://"), host_of(whole), _without_dots(path_of(whole)), rest)


def edges_between(urls: DataFrame) -> DataFrame:
    """Edges (a, b, a_url, b_url) from pairs of urls (a_url, b_url)."""
    return urls.select(node(F.col("a_url")).alias("a"), node(F.col("b_url")).alias("b"), "a_url", "b_url").filter("a IS NOT NULL AND b IS NOT NULL")


def redirect_edges(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Edges (a, b, a_url, b_url) from each url to the spelling that its server redirects it to."""
    return edges_between(urls.select(F.col(url_col).alias("a_url"), served(F.col(url_col)).alias("b_url")).distinct()).filter("a != b")


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b, a_url, b_url) from pages to the targets of canonical links and refresh tags in their markup."""
    head = F.col(html_col)
    tags = F.when(
        head.rlike(r"(?i)canonical|http-equiv"),
        F.regexp_extract_all(head, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1),
    ).otherwise(F.array().cast("array<string>"))
    tag = F.col("tag")
    href = F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)
    to = F.when(tag.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b"), href).when(tag.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"), refresh)
    found = pages.select(F.col(url_col).alias("url"), F.explode(tags).alias("tag")).select("url", to.alias("to")).filter("to != ''")
    to = F.regexp_replace(F.col("to"), "&amp;", "&")
    return edges_between(found.select(F.col("url").alias("a_url"), resolved(to, F.col("url")).alias("b_url")))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Stated links, and the redirects of the urls of pages and of link targets."""
    links = materialize(link_edges(pages, url_col, html_col))
    targets = links.select(F.col("b_url").alias("url"))
    return links.unionByName(redirect_edges(pages.select(F.col(url_col).alias("url")).unionByName(targets)))


def judge(pages: DataFrame, edges: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``edges`` (a, b, a_url, b_url) tie aliases; without them, urls are tied by ``redirect_edges`` alone. Decisions meet once per
    node (a partial aggregation), and travel from there along the edges to whole components.
    """
    prefix = "_judged"
    while any(c.lower().startswith(prefix) for c in pages.columns):
        prefix = "_" + prefix
    name, fit, alias = f"{prefix}_node", f"{prefix}_fit", f"{prefix}_alias"
    url = F.col(url_col)
    edges = materialize(redirect_edges(pages.select(url.alias("url"))) if edges is None else edges)
    rule = lambda c: rule_of(host_of(F.col(c)), path_of(F.col(c)), rules)
    # A page's own url stands for itself, so link targets outside the table carry their rules too.
    own = pages.select(node(url).alias("node"), rule(url_col)["verdict"].alias("decision")).filter("node IS NOT NULL")
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_url").alias("url")), F.struct(F.col("b").alias("node"), F.col("b_url").alias("url")))).alias("e"))
    nodes = own.unionByName(ends.select("e.*").select("node", rule("url")["verdict"].alias("decision"))).groupBy("node").agg(F.min("decision").alias("decision"))
    members = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    nodes = materialize(nodes.join(members.withColumnRenamed("id", "node"), "node", "left").withColumn("group", F.coalesce("component", "node")))
    # The smaller of 'allow' and 'block': allow takes precedence among aliases.
    decided = nodes.groupBy("group").agg(F.min("decision").alias("verdict")).filter("verdict = 'block'").select("group")
    blocked = materialize(nodes.join(decided, "group", "left_semi").select(F.col("node").alias(name), F.lit(True).alias(alias)))
    # Pages without a host have no aliases; they stay out of the join, where they would share one key.
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    with_host = pages.filter(known).withColumn(name, node(url)).join(blocked, name, "left")
    rest = pages.filter(~known).withColumns({name: F.lit(None).cast("string"), alias: F.lit(None).cast("boolean")})
    out = with_host.unionByName(rest).withColumn(fit, rule(url_col))
    verdict = F.coalesce(F.col(f"{fit}.verdict"), F.when(F.col(alias), F.lit("block")).otherwise(F.lit("allow")))
    added = {"host": host_of(url), "path": path_of(url), "rule": F.col(f"{fit}.rule"), "verdict": verdict}
    return out.select(*[c for c in pages.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def op8_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages.select("page_id", "url"), alias_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


#: The tables hold no canonical links or refresh tags; the edges are the redirects of the urls' spellings.
OP8_SQL = """
WITH RECURSIVE own AS (
  SELECT page_id, lower(regexp_extract(url, '^([^:]*)://', 1)) AS scheme,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    coalesce(regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1), '') AS query, contains(url, '://') AS known
  FROM pages),
spelled AS (
  SELECT *, regexp_replace(host, '^(?:www|m)\\.([^.]+\\.)', '\\1') AS to_host, regexp_replace(path, '(/|\\.html?)+$', '') AS to_path,
    array_to_string(list_filter(string_split(substr(query, 2), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&') AS to_query
  FROM own),
tied AS (
  SELECT *, scheme || '://' || host || path || query AS a, '://' || to_host || to_path || CASE WHEN to_query = '' THEN '' ELSE '?' || to_query END AS b FROM spelled),
rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
places AS (SELECT DISTINCT host, path FROM tied UNION SELECT DISTINCT to_host, to_path FROM tied),
fit AS (
  SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM places p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.host, p.path),
nodes AS (
  SELECT DISTINCT a AS node, f.verdict FROM tied t LEFT JOIN fit f ON f.host = t.host AND f.path = t.path WHERE known
  UNION SELECT DISTINCT b, f.verdict FROM tied t LEFT JOIN fit f ON f.host = t.to_host AND f.path = t.to_path WHERE known),
edges AS (SELECT a, b FROM tied WHERE known UNION SELECT b, a FROM tied WHERE known),
reach(node, other) AS (SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
component AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
decided AS (SELECT component, min(verdict) AS verdict FROM nodes JOIN component USING (node) GROUP BY component)
SELECT t.page_id, t.host, t.path, f.rule, coalesce(f.verdict, d.verdict, 'allow') AS verdict
FROM tied t LEFT JOIN fit f ON f.host = t.host AND f.path = t.path LEFT JOIN component c ON c.node = t.a AND t.known LEFT JOIN decided d ON d.component = c.component
"""

QUERIES = {"op8_url_filter": op8_query}
SQL = {"op8_url_filter": OP8_SQL}
