"""Theta joins, case checks, gates by bucket, section edits, traces: the smaller rows of the inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import judgments, lexical, metrics
from corvane.plans.corpus import frontmatter
from corvane.plans.evaluation import CLUSTERED, QRELS, _beir, beir_sql, clustered, judged
from corvane.plans.retrieval import TOKENS, bm25_run, bm25_sql, dense_run, knn_sql
from corvane.runtime import table

#: Asked terms that are sent to all records at most.
SENT_TERMS = 500_000

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {bm25_sql()} SELECT qf.term, count(*) AS postings, sum(po.tf)::BIGINT AS occurrences FROM qf JOIN po USING (term) GROUP BY qf.term")
def jon04_postings_join(spark, sf):  # noqa: ANN001, ANN201
    """Inverted postings met by query terms. Terms are counted where their records are, and those of one id and length add up; pairs of a posting with the
    queries that ask for it are counted, not made. Only asked terms are exchanged, unless there are too many to be sent to the records."""
    asked = lexical.postings(table(spark, sf, "benchmark"), "item_id", "text").select("id", "term").distinct().groupBy("term").agg(F.count("*").alias("queries"))
    po = lexical.postings(table(spark, sf, "documents"), "doc_id", "text").drop("kb")
    if asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS:
        po = po.join(F.broadcast(asked.select("term")), "term", "left_semi")
    po = po.groupBy("id", "dl", "term").agg(F.sum("tf").alias("tf")).groupBy("term").agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))
    return asked.join(po, "term").select("term", (F.col("queries") * F.col("postings")).alias("postings"), (F.col("queries") * F.col("occurrences")).alias("occurrences"))


@query(f"WITH {QRELS}, {knn_sql('r', 20)} SELECT query_id, rank, coalesce(relevance, 0) AS relevance FROM r LEFT JOIN qrels USING (query_id, id)")
def jon05_run_with_judgments(spark, sf):  # noqa: ANN001, ANN201
    return judged(spark, sf, dense_run(spark, sf, 20)).select("query_id", "rank", F.coalesce("relevance", F.lit(0)).alias("relevance"))


_PATH = "source || '/' || lang || '/' || doc_id || '.md'"
#: Patterns of judgments as both engines build them: whole paths, their ends, and globs with a fixed head, a fixed name, a fixed suffix, or nothing fixed.
_PATTERNS = (
    (f"SELECT {_PATH} FROM documents WHERE doc_id % 50 = 0", None), ("SELECT lang || '/' || doc_id || '.md' FROM documents WHERE doc_id % 40 = 1", None), ("SELECT doc_id || '.md' FROM documents WHERE doc_id % 30 = 2", None),
    ("SELECT DISTINCT source || '/**/*7.md' FROM documents WHERE source LIKE '%1'", "'^' || source || '/(?:.*/)?[^/]*7[.]md$'"), ("SELECT '**/' || doc_id || '.md' FROM documents WHERE doc_id % 60 = 3", "'^(?:.*/)?' || doc_id || '[.]md$'"),
    ("SELECT DISTINCT '*/' || lang || '/*[0-2].md' FROM documents WHERE source = 'src3'", "'^[^/]*/' || lang || '/[^/]*[0-2][.]md$'"), ("SELECT DISTINCT '*/' || lang || '/?' || '{1,3}*' FROM documents WHERE source = 'src5'", "'^[^/]*/' || lang || '/[^/](?:1|3)[^/]*$'"),
)


@query(f"""WITH d AS (SELECT doc_id, {_PATH} AS path FROM documents), p AS ({' UNION ALL '.join(q if r is None else q for q, r in _PATTERNS)}), x AS ({' UNION ALL '.join(q.replace('SELECT DISTINCT ', 'SELECT ').replace(' FROM documents', f' AS pattern, {r} AS form FROM documents', 1) for q, r in _PATTERNS if r)}),
plain AS ({' UNION ALL '.join(q.replace(' FROM documents', ' AS pattern FROM documents', 1) for q, r in _PATTERNS if not r)})
SELECT DISTINCT doc_id, pattern FROM (SELECT doc_id, pattern FROM d JOIN plain ON path = pattern OR ends_with(path, '/' || pattern) UNION ALL SELECT doc_id, pattern FROM d JOIN (SELECT DISTINCT * FROM x) ON regexp_matches(path, form))""".replace(f"p AS ({' UNION ALL '.join(q for q, _ in _PATTERNS)}), ", ""))
def jon07_theta_judgments(spark, sf):  # noqa: ANN001, ANN201
    """Judgments met by a path, its end, or a glob; every way is a join on equal keys, and globs are verified after."""
    d = table(spark, sf, "documents")
    patterns = reduce(DataFrame.unionByName, [spark.sql(q.replace("{", "{{").replace("}", "}}").replace(" FROM documents", " AS pattern FROM {documents}", 1), documents=d) for q, _ in _PATTERNS]).distinct()
    return judgments.matched(d.selectExpr("doc_id", f"{_PATH} AS path"), patterns, "path", "pattern").select("doc_id", "pattern")


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the')) AS w FROM conversations),
p AS (SELECT x.conv_id, x.turn AS fact, y.turn AS context, CASE WHEN len(x.w) + len(y.w) = 0 THEN 1.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(x.w), lambda v: least(len(list_filter(x.w, lambda a: a = v)), len(list_filter(y.w, lambda a: a = v))))), 0) / (len(x.w) + len(y.w)) END AS f1 FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.turn % 2 = 0 AND y.turn % 2 = 1)
SELECT conv_id, round(count(DISTINCT CASE WHEN f1 >= 0.5 THEN fact END)::DOUBLE / count(DISTINCT fact), 6) AS recall, round(count(DISTINCT CASE WHEN f1 >= 0.5 THEN context END)::DOUBLE / count(DISTINCT context), 6) AS precision FROM p GROUP BY conv_id""")
def jon08_met14_context_match(spark, sf):  # noqa: ANN001, ANN201
    """Facts and contexts of an item matched by token F1."""
    words = F.filter(F.split(text.normal_answer(F.col("text")), " "), lambda w: w != "")
    t = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("w"))
    facts, contexts = t.filter("turn % 2 = 0").select("conv_id", F.col("turn").alias("fact"), F.col("w").alias("a")), t.filter("turn % 2 = 1").select("conv_id", F.col("turn").alias("context"), F.col("w").alias("b"))
    p = facts.join(contexts, "conv_id").withColumn("hit", text.token_f1(F.col("a"), F.col("b")) >= 0.5)
    share = lambda c: F.round(F.countDistinct(F.when(F.col("hit"), F.col(c))) / F.countDistinct(c), 6)
    return p.groupBy("conv_id").agg(share("fact").alias("recall"), share("context").alias("precision"))


@query(f"""WITH {knn_sql('a')}, {knn_sql('b', 10, 32)}, x AS (SELECT coalesce(a.query_id, b.query_id) AS q, a.id AS ia, b.id AS ib FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id)
SELECT q AS query_id, count(*) FILTER (ia IS NULL) AS added, count(*) FILTER (ib IS NULL) AS removed, count(*) FILTER (ia = ib) AS kept FROM x GROUP BY q""")
def agg15_eval_compare(spark, sf):  # noqa: ANN001, ANN201
    c = metrics.compare_runs(dense_run(spark, sf), dense_run(spark, sf, dims=32), 10)
    return c.groupBy("query_id").agg(F.count_if(F.col("status") == "new").alias("added"), F.count_if(F.col("status") == "dropped").alias("removed"), F.count_if(F.col("status").isin("stable", "moved")).alias("kept"))


@query(f"""WITH {knn_sql('r')}, c AS (SELECT query_id, max(CASE WHEN id % 10 = query_id % 10 THEN 1 ELSE 0 END) AS has, max(CASE WHEN id % 10 = query_id % 10 AND score <= 1.6 THEN 1 ELSE 0 END) AS gated, count(*) FILTER (score <= 1.6) AS kept FROM r GROUP BY query_id)
SELECT CASE WHEN has = 1 THEN 'has-answer' ELSE 'no-good-answer' END AS bucket, count(*) AS cases, sum(has)::BIGINT AS raw, sum(gated)::BIGINT AS gated, count(*) FILTER (kept = 0) AS emptied FROM c GROUP BY ALL""")
def agg22_gate_buckets(spark, sf):  # noqa: ANN001, ANN201
    answer = F.col("id") % 10 == F.col("query_id") % 10
    near = F.col("score") <= 1.6
    c = dense_run(spark, sf).groupBy("query_id").agg(F.max(answer.cast("int")).alias("has"), F.max((answer & near).cast("int")).alias("gated"), F.count_if(near).alias("kept"))
    return c.groupBy(F.when(F.col("has") == 1, "has-answer").otherwise("no-good-answer").alias("bucket")).agg(F.count("*").alias("cases"), F.sum("has").alias("raw"), F.sum("gated").alias("gated"), F.count_if(F.col("kept") == 0).alias("emptied"))


@query("WITH g AS (SELECT l_linenumber AS judge, l_discount * 10 >= 0.5 AS verdict, l_returnflag = 'N' AS human, abs(l_tax - 0.04) < 0.005 AS abstained FROM lineitem) SELECT judge, count(*) AS n, count(*) FILTER (abstained) AS abstained, round(avg(CASE WHEN NOT abstained THEN (verdict = human)::INT END), 6) AS agreement FROM g GROUP BY judge")
def agg23_panel_calibration(spark, sf):  # noqa: ANN001, ANN201
    g = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("judge"), (F.col("l_discount") * 10 >= 0.5).alias("verdict"), (F.col("l_returnflag") == "N").alias("human"), (F.abs(F.col("l_tax") - 0.04) < 0.005).alias("abstained"))
    return g.groupBy("judge").agg(F.count("*").alias("n"), F.count_if("abstained").alias("abstained"), F.round(F.avg(F.when(~F.col("abstained"), (F.col("verdict") == F.col("human")).cast("int"))), 6).alias("agreement"))


@query(f"WITH {QRELS}, {knn_sql('ra', 100)}, {knn_sql('rb', 100, 32)}, {beir_sql('ra', 'ma')}, {beir_sql('rb', 'mb')} SELECT 'full' AS model, round(avg(ndcg_10), 6) AS ndcg, round(avg(map_100), 6) AS map, round(avg(r_10), 6) AS recall FROM ma UNION ALL SELECT 'short', round(avg(ndcg_10), 6), round(avg(map_100), 6), round(avg(r_10), 6) FROM mb")
def met10_models_side_by_side(spark, sf):  # noqa: ANN001, ANN201
    one = lambda dims, name: _beir(spark, sf, dims).agg(F.lit(name).alias("model"), F.round(F.avg("ndcg_10"), 6).alias("ndcg"), F.round(F.avg("map_100"), 6).alias("map"), F.round(F.avg("r_10"), 6).alias("recall"))
    return one(64, "full").unionByName(one(32, "short"))


@query(f"""WITH {knn_sql('r')}, c AS (SELECT query_id, bool_or(label = query_id % 10) AS required, bool_or(label = (query_id + 5) % 10) AS forbidden, count(*) - count(DISTINCT label) AS duplicates FROM r JOIN embeddings ON vec_id = id GROUP BY query_id)
SELECT query_id, required AS has_required, NOT forbidden AS no_forbidden, duplicates <= 3 AS within_budget, required AND NOT forbidden AND duplicates <= 3 AS passed FROM c""")
def met12_case_checks(spark, sf):  # noqa: ANN001, ANN201
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    c = dense_run(spark, sf).join(labels, "id").groupBy("query_id").agg(F.max(F.col("label") == F.col("query_id") % 10).alias("required"), F.max(F.col("label") == (F.col("query_id") + 5) % 10).alias("forbidden"), (F.count("*") - F.countDistinct("label")).alias("duplicates"))
    within = F.col("duplicates") <= 3
    return c.select("query_id", F.col("required").alias("has_required"), (~F.col("forbidden")).alias("no_forbidden"), within.alias("within_budget"), (F.col("required") & ~F.col("forbidden") & within).alias("passed"))


@query(f"""WITH {CLUSTERED}, g AS (SELECT cluster AS domain, avg(d) AS delta, count(*) AS n, 1.96::DOUBLE * stddev_samp(d) / sqrt(count(*)) AS half FROM k GROUP BY ALL)
SELECT domain, n, round(delta, 6) AS delta, CASE WHEN round(delta - half, 9) > 0 THEN 'enable' WHEN round(delta + half, 9) < 0 THEN 'disable' ELSE 'hold' END AS decision FROM g""")
def ext05_rollout(spark, sf):  # noqa: ANN001, ANN201
    """A model is enabled in a domain where its whole interval is a gain, disabled where it is a loss; all else, and a domain of one query, waits."""
    half = 1.96 * F.stddev_samp("d") / F.sqrt(F.count("*"))
    g = clustered(spark, sf).groupBy(F.col("cluster").alias("domain")).agg(F.count("*").alias("n"), F.avg("d").alias("delta"), half.alias("half"))
    decision = F.when(F.round(F.col("delta") - F.col("half"), 9) > 0, "enable").when(F.round(F.col("delta") + F.col("half"), 9) < 0, "disable").otherwise("hold")
    return g.select("domain", "n", F.round("delta", 6).alias("delta"), decision.alias("decision"))


@query(f"""WITH {knn_sql('r', 40)}, v AS (SELECT size, query_id, id, rank, round(score + (('0x' || left(md5(query_id || ':' || id), 8))::BIGINT / 4294967296.0::DOUBLE - 0.5) * size, 9) AS s FROM r, (VALUES (0.0::DOUBLE), (0.1), (0.4)) z(size)),
w AS (SELECT *, row_number() OVER (PARTITION BY size, query_id ORDER BY s, id) AS again FROM v) SELECT size, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall FROM w WHERE again <= 10 GROUP BY size""")
def ext10_noise_sweep(spark, sf):  # noqa: ANN001, ANN201
    """Recall at ten of distances with deterministic noise, by its size."""
    exact = dense_run(spark, sf, 40)
    noise = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5
    noisy = exact.select("query_id", "id", "rank", F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.4)))).alias("size"), "score").withColumn("s", F.round(F.col("score") + noise * F.col("size"), 9))
    again = noisy.withColumn("r", F.row_number().over(Window.partitionBy("size", "query_id").orderBy("s", "id"))).filter("r <= 10")
    return again.groupBy("size").agg(F.round(F.avg((F.col("rank") <= 10).cast("double")), 6).alias("recall"))


# What a search error is called, by what its message says.
ERROR_FORMS = (("(?i)not found|no such", "KB_NOT_FOUND"), ("(?i)permission|denied", "PERMISSION_DENIED"), ("(?i)timed? ?out|timeout", "PROVIDER_TIMEOUT"), ("(?i)refused|unavailable", "PROVIDER_UNAVAILABLE"), ("(?i)401|unauthori[sz]ed|api key", "PROVIDER_AUTH"))
#: Messages as both engines build them from an event.
_MESSAGE = "event_type || CASE user_id % 8 WHEN 0 THEN ': request timed out' WHEN 1 THEN ': connection REFUSED' WHEN 2 THEN ': No such shelf' WHEN 3 THEN ' permission denied, not found' WHEN 4 THEN ' code ' || (400 + event_id % 3) WHEN 5 THEN ' Unauthorised' WHEN 6 THEN ' api keys ' || event_id ELSE ' odd' END"


@query(f"SELECT event_id, CASE {' '.join(f"WHEN regexp_matches(m, '{p}') THEN '{c}'" for p, c in ERROR_FORMS)} ELSE 'INTERNAL' END AS code FROM (SELECT event_id, {_MESSAGE} AS m FROM events)")
def ext15_error_class(spark, sf):  # noqa: ANN001, ANN201
    message, code = F.expr(_MESSAGE), F.lit("INTERNAL")
    for pattern, name in reversed(ERROR_FORMS):
        code = F.when(message.rlike(pattern), name).otherwise(code)
    return table(spark, sf, "events").select("event_id", code.alias("code"))


@query("WITH c AS (SELECT DISTINCT sha256(text || 'text@1') AS key FROM documents WHERE doc_id % 3 = 0) SELECT doc_id FROM documents WHERE sha256(text || 'text@1') NOT IN (SELECT key FROM c)")
def src10_extraction_cache_misses(spark, sf):  # noqa: ANN001, ANN201
    """The cache is a table keyed by content hash and loader version; what is missing there is left to extract."""
    d = table(spark, sf, "documents").withColumn("key", F.sha2(F.concat("text", F.lit("text@1")).cast("binary"), 256))
    return d.join(d.filter("doc_id % 3 = 0").select("key"), "key", "left_anti").select("doc_id")


#: Notes as both engines build them: an open block, words in a block, a list and a comment, no block, an odd line, a good block.
_STRICT = """CASE s_suppkey % 6 WHEN 0 THEN '---' || chr(10) || 'title: ' || s_name || chr(10) || 'body' WHEN 1 THEN '---' || chr(10) || 'just words' || chr(10) || '---' || chr(10) || 'body'
WHEN 2 THEN '---' || chr(10) || '# note' || chr(10) || '- item' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || 'body' WHEN 3 THEN s_name
WHEN 4 THEN '---' || chr(10) || 'title: ' || s_name || chr(10) || 'odd ' || s_nationkey || chr(10) || '---' ELSE '---' || chr(10) || 'title: ' || s_name || chr(10) || '---' || chr(10) || 'a --- body' END"""


@query(f"""WITH n AS (SELECT s_suppkey, {_STRICT} AS note FROM supplier), b AS (SELECT *, regexp_extract(note, '(?s)^---\n(.*?)\n---(?:\n|$)', 1) AS block FROM n)
SELECT s_suppkey, CASE WHEN starts_with(note, '---') AND NOT regexp_matches(note, '(?s)^---\n(.*?)\n---(?:\n|$)') THEN 'missing_close' WHEN len(list_filter(string_split(block, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(#|-|[^:]+:)'))) > 0 THEN 'not_a_map' ELSE 'ok' END AS verdict FROM b""")
def prj02_strict_frontmatter(spark, sf):  # noqa: ANN001, ANN201
    """Strict parse as a flag: an opened block must close and hold keys."""
    df = table(spark, sf, "supplier").select("s_suppkey", F.expr(_STRICT).alias("note"))
    block, _ = frontmatter(F.col("note"))
    broken = F.col("note").startswith("---") & (block == "")
    lines = F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")
    return df.select("s_suppkey", F.when(broken, "missing_close").when(F.exists(lines, lambda x: ~x.rlike(r"^\s*(#|-|[^:]+:)")), "not_a_map").otherwise("ok").alias("verdict"))


#: Notes with a status, without one, and with one in the body too.
_STATUS = "'---' || chr(10) || 'title: ' || p_name || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE chr(10) || 'status: ' || p_type END || chr(10) || 'size: ' || p_size || chr(10) || '---' || chr(10) || 'status: of the body' || chr(10) || p_brand"


@query(f"""WITH n AS (SELECT p_partkey, {_STATUS} AS note FROM part), l AS (SELECT p_partkey, string_split(note, chr(10)) AS l FROM n), c AS (SELECT p_partkey, l, list_position(l[2:], '---') AS last FROM l), d AS (SELECT p_partkey, l[2:last] AS block, l[last + 2:] AS body FROM c)
SELECT p_partkey, '---' || chr(10) || array_to_string(CASE WHEN len(list_filter(block, lambda x: starts_with(x, 'status: '))) > 0 THEN list_transform(block, lambda x: CASE WHEN starts_with(x, 'status: ') THEN 'status: archived' ELSE x END) ELSE list_append(block, 'status: archived') END, chr(10)) || chr(10) || '---' || chr(10) || array_to_string(body, chr(10)) AS note FROM d""")
def prj04_rewrite_frontmatter(spark, sf):  # noqa: ANN001, ANN201
    """Set a key of the block, or add it; the body stays byte for byte."""
    n = table(spark, sf, "part").select("p_partkey", F.expr(_STATUS).alias("note"))
    block, body = frontmatter(F.col("note"))
    line = r"(?m)^status: .*$"
    changed = F.when(block.rlike(line), F.regexp_replace(block, line, "status: archived")).otherwise(F.concat(block, F.lit("\nstatus: archived")))
    return n.select("p_partkey", F.concat(F.lit("---\n"), changed, F.lit("\n---\n"), body).alias("note"))


#: Notes whose section B has parts of its own, stands last, or is missing.
_SECTIONS = "CASE p_partkey % 3 WHEN 0 THEN '# A' || chr(10) || p_name || chr(10) || '## B' || chr(10) || p_brand || chr(10) || '### B1' || chr(10) || 'y' || chr(10) || '# C' || chr(10) || 'x' WHEN 1 THEN '# A' || chr(10) || '## C' || chr(10) || '## B' || chr(10) || p_type ELSE '# A' || chr(10) || p_name || chr(10) || '# C' END"


@query(f"""WITH l AS (SELECT p_partkey, string_split({_SECTIONS}, chr(10)) AS l FROM part), s AS (SELECT p_partkey, l, list_position(l, '## B') AS start FROM l),
e AS (SELECT *, coalesce(list_min(list_filter(range(start + 1, len(l) + 1), lambda i: regexp_matches(l[i], '^#{{1,2}} '))), len(l) + 1) AS stop FROM s)
SELECT p_partkey, CASE WHEN coalesce(start, 0) = 0 THEN array_to_string(l, chr(10)) ELSE array_to_string(list_concat(list_append(l[:stop - 1], 'added'), l[stop:]), chr(10)) END AS note FROM e""")
def prj14_append_to_section(spark, sf):  # noqa: ANN001, ANN201
    """Append a line to the section under a heading, before the next heading of its level or above; a note without it stays."""
    lines = table(spark, sf, "part").select("p_partkey", F.split(F.expr(_SECTIONS), "\n").alias("l"))
    start = F.array_position("l", F.lit("## B"))
    after = F.filter(F.transform("l", lambda x, i: F.when((i >= start) & x.rlike(r"^#{1,2} "), i)), lambda i: i.isNotNull())
    cut = F.coalesce(F.get(after, F.lit(0)), F.size("l"))
    added = F.concat(F.slice("l", F.lit(1), cut), F.array(F.lit("added")), F.slice("l", cut + 1, F.size("l")))
    return lines.select("p_partkey", F.array_join(F.when(start == 0, F.col("l")).otherwise(added), "\n").alias("note"))


@query(f"""WITH {knn_sql('a', 20)}, {knn_sql('b', 20, 32)}, s AS (SELECT a.query_id, a.id, round(1.0 / a.rank + coalesce(1.0 / b.rank, 0), 6) AS score, a.rank AS first, a.score AS best FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.id = b.id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, best, id) AS place FROM s""")
def srt02_four_keys(spark, sf):  # noqa: ANN001, ANN201
    b = dense_run(spark, sf, 20, 32).select("query_id", "id", F.col("rank").alias("rb"))
    s = dense_run(spark, sf, 20).join(b, ["query_id", "id"], "left").withColumn("total", F.round(1 / F.col("rank") + F.coalesce(1 / F.col("rb"), F.lit(0.0)), 6))
    return s.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total"), "rank", "score", "id")).alias("place"))


@query(f"""WITH {bm25_sql(5)} SELECT query_id, id, rank, score > 10 AS strong, len(list_intersect(list_distinct(q), list_distinct(t))) AS matched FROM (SELECT b.query_id, b.id, b.rank, b.score, d.tokens AS t, qq.q FROM bm25 b JOIN d ON d.id = b.id JOIN (SELECT item_id, {TOKENS} AS q FROM benchmark) qq ON qq.item_id = b.query_id)""")
def cmd12_explain_trace(spark, sf):  # noqa: ANN001, ANN201
    """Stages of a ranked row as columns of it."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.bm25_tokens(F.col("text")).alias("q"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    r = bm25_run(spark, sf, 5).join(d, "id").join(q, "query_id")
    return r.select("query_id", "id", "rank", (F.col("score") > 10).alias("strong"), F.size(F.array_intersect(F.array_distinct("q"), F.array_distinct(text.bm25_tokens(F.col("text"))))).alias("matched"))


@query(f"WITH {knn_sql('r', 20)} SELECT query_id, id, score, rank FROM r WHERE rank <= CASE WHEN query_id % 2 = 0 THEN 3 ELSE 7 END AND score <= CASE WHEN query_id % 3 = 0 THEN 1.5 ELSE 9 END")
def ret25_batch_parameters(spark, sf):  # noqa: ANN001, ANN201
    """Each query of a batch with its own k and threshold."""
    k = F.when(F.col("query_id") % 2 == 0, 3).otherwise(7)
    limit = F.when(F.col("query_id") % 3 == 0, 1.5).otherwise(9.0)
    return dense_run(spark, sf, 20).filter((F.col("rank") <= k) & (F.col("score") <= limit)).select("query_id", "id", "score", "rank")


@query("WITH new AS (SELECT doc_id, sha256(text) AS sha FROM documents), old AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 7 <> 0) SELECT coalesce(new.doc_id, old.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'add' WHEN old.sha <> new.sha THEN 'replace' END AS action FROM new LEFT JOIN old USING (doc_id) WHERE old.doc_id IS NULL OR old.sha <> new.sha")
def str03_incremental_plan(spark, sf):  # noqa: ANN001, ANN201
    """Rows to add or to replace by the difference of content hashes."""
    new = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    old = new.filter("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("sha")).alias("was"))
    j = new.join(old, "doc_id", "left").withColumn("action", F.when(F.col("was").isNull(), "add").when(F.col("was") != F.col("sha"), "replace"))
    return j.filter("action is not null").select("doc_id", "action")


@query(f"""WITH {knn_sql('r')}, f AS (SELECT quantile_disc(score, 0.3) AS floor FROM r), e AS (SELECT query_id, count(*) AS n, count(*) FILTER (score <= floor) AS near FROM r, f GROUP BY query_id) SELECT query_id, n, near, CASE WHEN near = 0 THEN 'clear' WHEN near < n THEN 'trim' ELSE 'keep' END AS action FROM e""")
def cmd11_gate_actions(spark, sf):  # noqa: ANN001, ANN201
    """What the gate does to each list: the floor is the distance that three in ten of all hits come below."""
    run = dense_run(spark, sf)
    floor = run.agg(F.expr("percentile_disc(0.3) WITHIN GROUP (ORDER BY score)").alias("floor"))  # one row; of ten hits a query
    e = run.crossJoin(F.broadcast(floor)).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") <= F.col("floor")).alias("near"))
    return e.withColumn("action", F.when(F.col("near") == 0, "clear").when(F.col("near") < F.col("n"), "trim").otherwise("keep"))


__all__ = ["QUERIES", "SQL"]
