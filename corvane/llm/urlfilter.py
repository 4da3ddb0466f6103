"""URL filter with redirect equivalence.

Every url is judged by its own rule where one fits: a rule fits its host and all subdomains if the path starts with the
rule's, and the longest rule wins (allow before block among equals). Urls that redirects, refresh headers or canonical
links connect are aliases; their classes are connected components, found by distributed star steps. A url without a rule
takes its class's decision: allow if any member is explicitly allowed, else block if any member is blocked, else allow.

Nodes are urls without scheme and fragment, as hashes of 128 bits. Rules are a short list and are compiled into one
expression. Only pages without a rule of their own look up their class; the others get keys that are no node's, so that no
key is hot because it is empty.

Defined results: null urls, and urls without ``://``, have empty host and path, no rule, and are allowed. Null html has no
links. Urls and html of any length are read whole. Repeated rows repeat their results; pages that share a url share a node;
of rules of equal length an allowing one comes first. Extra columns pass through, but for those named ``host``, ``path``,
``rule`` or ``verdict``, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, read
from corvane.llm.components import connected_components

# The rules of the contract as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and the query with its ``?``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    query = F.regexp_extract(F.substring(tail, F.length(path) + 1, F.length(tail)), r"^\?[^#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path, query


def _ordered(rules):  # noqa: ANN001, ANN202
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:  # noqa: ANN001
    """Struct (rule, verdict) of the longest rule that fits; null fields if none does."""
    found = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in reversed(_ordered(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def with_parts(df: DataFrame, url: str, rules=RULES, prefix: str = "") -> DataFrame:  # noqa: ANN001
    host, path, query = host_path(F.col(url))
    df = df.withColumns({f"{prefix}host": host, f"{prefix}path": path, f"{prefix}query": query})
    fit = rule_of(F.col(f"{prefix}host"), F.col(f"{prefix}path"), rules)
    return df.withColumns({f"{prefix}fit": fit, f"{prefix}key": F.md5(F.concat_ws("\0", f"{prefix}host", f"{prefix}path", f"{prefix}query").cast("binary"))})


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) urls of canonical links and of refresh redirects in html; links are resolved against their page."""
    tags = F.concat(F.regexp_extract_all("html", F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), F.regexp_extract_all("html", F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)))
    tag = F.col("tag")
    raw = F.when(tag.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b"""), F.regexp_extract(tag, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)).when(
        tag.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract(tag, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    )
    scheme = F.regexp_extract("url", r"^([^:/?#]*)://", 1)
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    folder = F.regexp_extract("url", r"://[^/?#]*(/(?:[^?#]*/)?)", 1)
    dst = (
        F.when(F.col("raw").contains("://"), F.col("raw"))
        .when(F.col("raw").startswith("//"), F.concat(scheme, F.lit(":"), "raw"))
        .when(F.col("raw").startswith("/"), F.concat(scheme, F.lit("://"), host, "raw"))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), "raw"))
    )
    some = pages.filter(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    links = some.select("url", F.explode(tags).alias("tag")).select("url", raw.alias("raw")).filter(F.col("raw") != "")
    return links.select(F.col("url").alias("src"), dst.alias("dst"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """Add host, path, rule and verdict to ``pages`` (url, html, ...); ``redirects`` adds observed (src, dst) pairs."""
    scratch = Scratch(pages.sparkSession, "urls")
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    links = scratch.cut(with_parts(with_parts(links, "src", rules, "s_"), "dst", rules, "d_").select(F.col("s_key").alias("a"), F.col("s_fit.verdict").alias("va"), F.col("d_key").alias("b"), F.col("d_fit.verdict").alias("vb")).distinct())
    parts = connected_components(links.select("a", "b"), scratch)
    ends = links.select(F.col("a").alias("node"), F.col("va").alias("v")).unionByName(links.select(F.col("b").alias("node"), F.col("vb").alias("v"))).distinct()
    told = ends.join(parts, "node").groupBy("component").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    inherited = parts.join(told, "component").select(F.col("node").alias("__key"), (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("__blocked"))
    parted = with_parts(pages, "url", rules, "__")
    needs = F.col("__fit.verdict").isNull() & (F.col("__host") != "")
    parted = parted.withColumn("__key", F.when(needs, F.col("__key")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id())))
    joined = parted.join(inherited, "__key", "left")
    method = F.when(F.col("__blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return joined.withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__fit.rule"), "verdict": F.coalesce(F.col("__fit.verdict"), method)}).drop(
        "__host", "__path", "__query", "__fit", "__key", "__blocked"
    )


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    upper = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"

    def case(host: str, path: str, what: str) -> str:
        whens = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h + p if what == 'rule' else v}'" for v, h, p in _ordered(RULES))
        return f"CASE {whens} END"

    def parts(url: str) -> tuple[str, str, str]:
        rest = f"CASE WHEN position('://' IN coalesce({url}, '')) > 0 THEN substr({url}, position('://' IN {url}) + 3) ELSE '' END"
        host = f"regexp_extract({rest}, '^[^/?#]*')"
        tail = f"substr({rest}, length({host}) + 1)"
        path = f"regexp_extract({tail}, '^[^?#]*')"
        return upper(host), path, f"regexp_extract(substr({tail}, length({path}) + 1), '^\\?[^#]*')"

    h, p, q = parts("url")
    dh, dp, dq = parts("dst")
    return rf"""
WITH RECURSIVE j AS (SELECT page_id, url, html, {h} AS host, {p} AS path, {q} AS query FROM pages),
k AS (SELECT *, host || chr(0) || path || chr(0) || query AS key, {case('host', 'path', 'rule')} AS rule, {case('host', 'path', 'verdict')} AS own FROM j),
t AS (SELECT url, key, own, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM k WHERE url LIKE '%://%'),
r AS (SELECT url, key, own, CASE WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
        WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS raw FROM t),
l AS (SELECT key, own, CASE WHEN raw LIKE '%://%' THEN raw WHEN raw LIKE '//%' THEN regexp_extract(url, '^([^:/?#]*)://', 1) || ':' || raw
        WHEN raw LIKE '/%' THEN regexp_extract(url, '^([^:/?#]*)://', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || raw
        ELSE regexp_extract(url, '^([^:/?#]*)://', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') || raw END AS dst FROM r WHERE raw <> ''),
m AS (SELECT key, own, {dh} AS dhost, {dp} AS dpath, {dq} AS dquery FROM l),
e AS (SELECT key AS a, own AS va, dhost || chr(0) || dpath || chr(0) || dquery AS b, {case('dhost', 'dpath', 'verdict')} AS vb FROM m),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, x.b FROM reach JOIN both_ways x ON reach.b = x.a),
v AS (SELECT a AS node, va AS v FROM e UNION SELECT b, vb FROM e),
c AS (SELECT reach.a AS key, bool_or(v.v = 'allow') AS allowed, bool_or(v.v = 'block') AS blocked FROM reach JOIN v ON reach.b = v.node GROUP BY reach.a)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN c USING (key)
"""


QUERIES = {"op3_url_filter": op3_url_filter}
SQL = {"op3_url_filter": _sql()}
