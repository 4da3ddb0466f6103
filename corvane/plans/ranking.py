"""What is built on whole rankings: the relevance gate, context packing, ranked and diversity metrics, latencies, noise floors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import dense, fusion, metrics, plugins
from corvane.plans.evaluation import CLUSTERED, RUNS, _beir, clustered
from corvane.plans.retrieval import TEXT_KNN_SQL, _queries, _vectors, bm25_run, bm25_sql, dense_run, knn_sql, ret10_hybrid, ret16_decompose
from corvane.runtime import table

_ASCII = re.compile("[a-z0-9]+")

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- the relevance gate -------------------------------------------------------------------------------------------------

#: Distance beyond which a hit is dropped.
FLOOR = 0.95


def gate(candidates: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Add ``verdict`` to candidates (query_id, id, rank, distance, lexical, excluded): what the gate keeps without a judge.

    Rows that a policy excludes pass by. Of the others, hits beyond the floor go (lexical ones without a distance stay), but
    for the best where none would be left; then hits after the largest gap of the distances go. At most a query's hits stand
    in one group.
    """
    whole = Window.partitionBy("query_id")
    over = lambda c: c.over(whole)
    gated = ~F.col("excluded")
    known = F.col("distance").isNotNull()
    c = candidates.withColumn("near", gated & (~known | (F.col("distance") <= floor)))
    best = (over(F.count_if("near")) == 0) & (F.col("rank") == over(F.min(F.when(gated, F.col("rank")))))
    c = c.withColumn("a1", F.col("near") | (gated & best))
    several = (over(F.count_if("a1")) > 1) & (over(F.count_if(F.col("a1") & known)) > 1)
    c = c.withColumn("active", F.col("a1") & known & several)
    order = Window.partitionBy("query_id", "active").orderBy("distance", "rank")
    c = c.withColumns({"place": F.row_number().over(order), "gap": F.when(F.col("active"), F.lead("distance").over(order) - F.col("distance"))})
    c = c.withColumns({"widest": over(F.max("gap")), "mean": over(F.avg("gap"))})
    c = c.withColumn("last", over(F.min(F.when(F.col("active") & (F.col("gap") == F.col("widest")), F.col("place")))))
    after = F.col("active") & (F.col("widest") > F.col("mean") * 1.1) & (F.col("place") > F.col("last"))
    verdict = F.when(F.col("excluded"), "policy").when(~F.col("a1"), "A1-score-floor").when(after, "A2-distribution-knee").otherwise("kept")
    return c.select("query_id", "id", "rank", "distance", "lexical", "excluded", verdict.alias("verdict"))


@query(f"""WITH {bm25_sql(40)}, {TEXT_KNN_SQL}, runs AS (SELECT query_id, id, 1 AS list, rank FROM text_knn UNION ALL SELECT query_id, id, 2, rank FROM bm25),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 100000 + rank) AS first FROM runs GROUP BY query_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f),
c AS (SELECT r.query_id, r.id, r.rank, t.score AS distance, coalesce(toxic, 0) = 1 AS excluded FROM r LEFT JOIN text_knn t ON t.query_id = r.query_id AND t.id = r.id LEFT JOIN labels ON doc_id = r.id WHERE r.rank <= 10),
g AS (SELECT *, distance IS NULL OR distance <= {FLOOR} AS near, min(rank) OVER w AS top, count(*) FILTER (distance IS NULL OR distance <= {FLOOR}) OVER w AS nears FROM c WHERE NOT excluded WINDOW w AS (PARTITION BY query_id)),
a AS (SELECT *, near OR (rank = top AND nears = 0) AS a1 FROM g),
s AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, count(distance) OVER (PARTITION BY query_id) AS scored, row_number() OVER (PARTITION BY query_id, distance IS NULL ORDER BY distance, rank) AS place FROM a WHERE a1),
k AS (SELECT query_id, distance, lead(distance) OVER w - distance AS gap, row_number() OVER w AS i FROM s WHERE distance IS NOT NULL AND n > 1 AND scored > 1 WINDOW w AS (PARTITION BY query_id ORDER BY distance, id)),
m AS (SELECT query_id, CASE WHEN max(gap) > avg(gap) * 1.1 THEN arg_min(i, (-gap, i)) FILTER (gap IS NOT NULL) ELSE count(*) END AS most FROM k GROUP BY query_id),
v AS (SELECT s.query_id, id, CASE WHEN distance IS NOT NULL AND place > greatest(1, coalesce(most, place)) THEN 'A2-distribution-knee' ELSE 'kept' END AS verdict FROM s LEFT JOIN m USING (query_id)
  UNION ALL SELECT query_id, id, 'A1-score-floor' FROM a WHERE NOT a1 UNION ALL SELECT query_id, id, 'policy' FROM c WHERE excluded)
SELECT c.query_id, c.id, c.rank, v.verdict FROM c JOIN v USING (query_id, id)""")
def cmd11_relevance_gate(spark, sf):  # noqa: ANN001, ANN201
    """Hybrid hits through the gate; documents that are labelled toxic stand for those that a policy excludes."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic")
    c = ret10_hybrid(spark, sf).join(labels, "id", "left").select("query_id", "id", "rank", "distance", "lexical", (F.coalesce("toxic", F.lit(0)) == 1).alias("excluded"))
    return gate(c).select("query_id", "id", "rank", "verdict")


@query(f"""WITH {knn_sql('a', 40)}, {knn_sql('b', 40, 32)}, {knn_sql('c', 40, 16)}, p AS (SELECT 'primary' AS role, 1.0::DOUBLE AS w, * FROM a UNION ALL SELECT 'plus', 0.8, * FROM b UNION ALL SELECT 'minus', 0.5, * FROM c),
s AS (SELECT query_id, id, sum(CASE WHEN role <> 'minus' THEN w / rank END) AS support, max(CASE WHEN role = 'minus' THEN w / rank END) AS against, min(CASE WHEN role = 'primary' THEN rank END) AS first, min(CASE WHEN role <> 'minus' THEN score END) AS best FROM p GROUP BY ALL),
t AS (SELECT query_id, id, round(support - 1.25::DOUBLE * coalesce(against, 0), 9) AS score, first, best FROM s WHERE support > 0)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first NULLS LAST, best, id) AS rank FROM t) WHERE rank <= 10""")
def ret14_composed(spark, sf):  # noqa: ANN001, ANN201
    """A primary list, one that adds to it and one that takes from it."""
    pools = None
    for role, weight, dims in (("primary", 1.0, 64), ("plus", 0.8, 32), ("minus", 0.5, 16)):
        pool = dense_run(spark, sf, 40, dims).select("query_id", F.lit(role).alias("role"), F.lit(weight).alias("weight"), "id", "rank", "score")
        pools = pool if pools is None else pools.unionByName(pool)
    return fusion.compose(pools, 10)


_ANCHORS = r"list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_./:@+-]+'), lambda w: lower(w)), lambda w: length(w) >= 3 AND regexp_matches(w, '[\p{{L}}\p{{N}}]') AND w NOT IN (" + ", ".join(f"'{w}'" for w in text.ANCHOR_STOP_WORDS) + ")))"


@query(rf"""WITH {bm25_sql(3)}, p AS (SELECT item_id AS query_id, unnest(l) AS s, generate_subscripts(l, 1)::INT - 1 AS part FROM (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '\s+(?:and|or|et|und|y)\s+|[;?]\s*'), lambda x: trim(x)), lambda x: length(x) >= 3) AS l FROM benchmark)),
a AS (SELECT query_id, part, {_ANCHORS.format('s')} AS anchors FROM p), e AS (SELECT query_id, string_agg(lower(text), ' ') AS t FROM bm25 JOIN documents ON doc_id = id GROUP BY query_id)
SELECT query_id, part, len(anchors) AS anchors, len(anchors) > 0 AND len(list_filter(anchors, lambda w: contains(coalesce(t, ''), w))) = 0 AS missing FROM a LEFT JOIN e USING (query_id)""")
def ret17_missing_parts(spark, sf):  # noqa: ANN001, ANN201
    """Parts of a query none of whose anchors stands in what was found for it."""
    anchors = text.anchor_terms(F.col("subquery"))
    a = ret16_decompose(spark, sf).select(F.col("item_id").alias("query_id"), "part", anchors.alias("anchors"))
    e = bm25_run(spark, sf, 3).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id").groupBy("query_id").agg(F.collect_list(F.lower("text")).alias("t"))  # three texts a query
    held = F.exists("anchors", lambda w: F.exists(F.coalesce("t", F.array().cast("array<string>")), lambda t: F.contains(t, w)))
    return a.join(e, "query_id", "left").select("query_id", "part", F.size("anchors").alias("anchors"), ((F.size("anchors") > 0) & ~held).alias("missing"))


# --- context packing ----------------------------------------------------------------------------------------------------

BUDGET = 900
#: Tokens of the line between two snippets, and of the mark of a cut one.
SEPARATOR, MARK = 1, 3
CHARS = 4


def _estimate(text: Column) -> Column:
    """A token for four characters without white space at the ends; none for nothing."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.ceil(F.length(bare) / CHARS).cast("long")


def _cut(content: Column, tokens: Column) -> Column:
    """The start of a content within a number of tokens, at its last line or sentence end if that is in the second half."""
    most = F.greatest(F.lit(0), tokens * CHARS).cast("int")
    hard = F.regexp_replace(F.substring(content, F.lit(1), most), r"\s+$", "")
    back = F.reverse(hard)
    line = F.when(F.locate("\n", back) > 0, F.length(hard) - F.locate("\n", back)).otherwise(-1)
    ends = [F.when(F.locate(f" {x}", back) > 0, F.length(hard) - F.locate(f" {x}", back)).otherwise(-1) for x in ".?!"]
    at = F.greatest(line, *ends)
    kept = F.when(at >= F.greatest(F.lit(32), F.floor(most / 2)), F.regexp_replace(F.substring(hard, F.lit(1), at.cast("int")), r"\s+$", "")).otherwise(hard)
    return F.when(F.length(content) <= most, content).otherwise(kept)


def pack_context(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Fold (query_id, rank, id, head, content, excluded) in rank order into a context: whole snippets, cut ones, or none.

    A snippet that fits is included whole; one that doesn't is cut to what is left, if its head leaves room; what a policy
    excludes and what doesn't fit takes nothing from the budget. One row a query, with the ids of included and cut snippets.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "head", "content", "excluded")))
    no_ids = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("long").alias("used"), no_ids.alias("ids"), no_ids.alias("cut"), F.lit(0).cast("long").alias("policy"))

    def step(a: Column, x: Column) -> Column:
        rest = F.greatest(F.lit(0), F.lit(budget) - a["used"] - F.when(F.size(a["ids"]) == 0, 0).otherwise(SEPARATOR))
        gap = F.when(F.size(a["ids"]) == 0, 0).otherwise(SEPARATOR)
        whole = _estimate(F.concat(x["head"], x["content"]))
        room = rest - _estimate(x["head"])
        part = _cut(x["content"], room - MARK)
        parted = _estimate(F.concat(x["head"], part, F.lit("\n[truncated]")))
        fits = (room > 0) & (F.regexp_replace(part, r"\s", "") != "") & (parted <= rest)
        grown = lambda tokens, cut: F.struct((a["used"] + gap + tokens).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"), (F.concat(a["cut"], F.array(x["id"])) if cut else a["cut"]).alias("cut"), a["policy"].alias("policy"))
        passed = F.struct(a["used"].alias("used"), a["ids"].alias("ids"), a["cut"].alias("cut"), (a["policy"] + 1).alias("policy"))
        return F.when(x["excluded"], passed).when(whole <= rest, grown(whole, False)).when(fits, grown(parted, True)).otherwise(a)

    packed = hits.groupBy("query_id").agg(F.aggregate(ordered, start, step).alias("p"), F.count("*").alias("offered"))
    return packed.select("query_id", F.col("p.used").alias("used"), F.array_join("p.ids", ",").alias("included"), F.array_join("p.cut", ",").alias("truncated"), F.col("p.policy").alias("policy"), (F.col("offered") - F.size("p.ids")).alias("excluded"))


_EST = r"ceil(length(regexp_replace({0}, '^\s+|\s+$', '', 'g')) / 4.0)::BIGINT"
_BACK = lambda x: f"CASE WHEN strpos(reverse(hard), {x}) > 0 THEN length(hard) - strpos(reverse(hard), {x}) ELSE -1 END"


@query(rf"""WITH RECURSIVE {bm25_sql(10)}, h AS (SELECT query_id, id, rank, 'Snippet ' || rank || chr(10) || 'Score: n/a' || chr(10) || 'Metadata: {{"source":"' || source || '","id":' || id || '}}' || chr(10) || 'Content:' || chr(10) AS head, text AS content, coalesce(toxic, 0) = 1 AS excluded
  FROM bm25 JOIN documents ON doc_id = id LEFT JOIN labels USING (doc_id)),
p(query_id, rank, used, ids, cut, policy) AS (SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, []::BIGINT[], []::BIGINT[], 0::BIGINT FROM h UNION ALL
  SELECT z.query_id, z.rank, CASE WHEN how = 1 THEN used + gap + whole WHEN how = 2 THEN used + gap + parted ELSE used END, CASE WHEN how > 0 THEN list_append(ids, id) ELSE ids END, CASE WHEN how = 2 THEN list_append(cut, id) ELSE cut END, policy + (CASE WHEN excluded THEN 1 ELSE 0 END)
  FROM (SELECT *, CASE WHEN excluded THEN 0 WHEN whole <= rest THEN 1 WHEN room > 0 AND regexp_replace(part, '\s', '', 'g') <> '' AND parted <= rest THEN 2 ELSE 0 END AS how
    FROM (SELECT *, {_EST.format("head || part || chr(10) || '[truncated]'")} AS parted
      FROM (SELECT *, CASE WHEN length(content) <= most THEN content WHEN bound >= greatest(32, most // 2) THEN regexp_replace(substr(hard, 1, bound), '\s+$', '') ELSE hard END AS part
        FROM (SELECT *, greatest({_BACK("chr(10)")}, {_BACK("' .'")}, {_BACK("' ?'")}, {_BACK("' !'")}) AS bound
          FROM (SELECT *, regexp_replace(substr(content, 1, most), '\s+$', '') AS hard
            FROM (SELECT *, greatest(0, (room - {MARK}) * {CHARS}) AS most
              FROM (SELECT *, rest - {_EST.format('head')} AS room, {_EST.format('head || content')} AS whole
                FROM (SELECT h.*, used, ids, cut, policy, CASE WHEN len(ids) = 0 THEN 0 ELSE {SEPARATOR} END AS gap, greatest(0, {BUDGET} - used - CASE WHEN len(ids) = 0 THEN 0 ELSE {SEPARATOR} END) AS rest
                  FROM p JOIN h ON h.query_id = p.query_id AND h.rank = p.rank + 1)))))))) z),
l AS (SELECT query_id, max(rank) AS m FROM p GROUP BY query_id)
SELECT p.query_id, used, array_to_string(ids, ',') AS included, array_to_string(cut, ',') AS truncated, policy, p.rank - len(ids) AS excluded FROM p JOIN l ON l.query_id = p.query_id AND l.m = p.rank""")
def win01_packed_snippets(spark, sf):  # noqa: ANN001, ANN201
    """BM25 hits packed as snippets with heads; documents that are labelled toxic stand for those that a policy excludes."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic")
    head = F.format_string('Snippet %d\nScore: n/a\nMetadata: {"source":"%s","id":%d}\nContent:\n', "rank", "source", "id")
    h = bm25_run(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content")), "id").join(labels, "id", "left")
    return pack_context(h.select("query_id", "rank", "id", head.alias("head"), "content", (F.coalesce("toxic", F.lit(0)) == 1).alias("excluded")))


# --- metrics over judged sources ----------------------------------------------------------------------------------------

#: Sources that are relevant to a query, as an offset to its id, and how much.
_JUDGED = ((0, 3), (7, 2), (13, 1))


@query(f"""WITH {knn_sql('r', 40)}, j AS (SELECT DISTINCT query_id, (query_id + o) % 50 AS source, rel FROM r, (VALUES {', '.join(f'({o}, {x})' for o, x in _JUDGED)}) v(o, rel)),
h AS (SELECT query_id, source, rel, min(rank) AS rank FROM r JOIN j USING (query_id) WHERE id % 50 = source GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM h),
i AS (SELECT query_id, count(*) AS judged, sum((2.0 ** rel - 1) / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS p FROM j) GROUP BY query_id),
g AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (2.0 ** rel - 1) / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) AS first, count(*) FILTER (rank <= 10) AS at10, sum(nth::DOUBLE / rank) AS ap, coalesce(sum(nth::DOUBLE / rank) FILTER (rank <= 10), 0) AS ap10 FROM n GROUP BY query_id)
SELECT query_id, round(coalesce(dcg, 0) / ideal, 6) AS ndcg_10, round(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END, 6) AS mrr_10, round(coalesce(at10, 0)::DOUBLE / judged, 6) AS recall_10, round(coalesce(at10, 0) / 10.0, 6) AS precision_10,
  round(coalesce(ap, 0) / judged, 6) AS map, round(coalesce(ap10, 0) / least(judged, 10), 6) AS map_10, coalesce(at10, 0) > 0 AS hit FROM i LEFT JOIN g USING (query_id)""")
def met07_ranked_metrics(spark, sf):  # noqa: ANN001, ANN201
    """Ranked metrics where a judgment names a source and matches once, at the source's first hit."""
    r = dense_run(spark, sf, 40)
    judged = F.explode(F.array(*[F.struct(((F.col("query_id") + o) % 50).alias("source"), F.lit(x).alias("relevance")) for o, x in _JUDGED]))
    j = r.select("query_id").distinct().select("query_id", judged.alias("j")).select("query_id", "j.*")
    return metrics.once(r.select("query_id", (F.col("id") % 50).alias("source"), "rank"), j, 10)


@query(f"""WITH {knn_sql('r')}, {knn_sql('p', 40, 32)}, j AS (SELECT query_id, id, label FROM p JOIN embeddings ON vec_id = id),
a AS (SELECT r.query_id, r.rank, row_number() OVER (PARTITION BY r.query_id, label ORDER BY r.rank) - 1 AS seen FROM r JOIN j USING (query_id, id)), d AS (SELECT query_id, sum(0.5 ** seen / log2(rank + 1)) AS dcg FROM a GROUP BY query_id),
s AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, label ORDER BY id) - 1 AS seen FROM j), o AS (SELECT query_id, seen, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS p FROM s), i AS (SELECT query_id, sum(0.5 ** seen / log2(p + 1)) AS ideal FROM o WHERE p <= 10 GROUP BY query_id)
SELECT query_id, round(coalesce(dcg, 0) / ideal, 6) AS alpha_ndcg FROM i LEFT JOIN d USING (query_id)""")
def met09_alpha_ndcg(spark, sf):  # noqa: ANN001, ANN201
    """Alpha-nDCG at 10 against the greedy ideal of the judged pool, whose rows have one intent each.

    With one intent a row, the greedy choice takes rows by how often their intent was chosen before.
    """
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    pool = dense_run(spark, sf, 40, 32).select("query_id", "id").join(labels, "id")
    seen = lambda order: F.row_number().over(Window.partitionBy("query_id", "label").orderBy(order)) - 1
    gain = lambda place: F.sum(F.pow(F.lit(0.5), "seen") / F.log2(F.col(place) + 1))
    got = dense_run(spark, sf).join(pool, ["query_id", "id"]).withColumn("seen", seen("rank")).groupBy("query_id").agg(gain("rank").alias("dcg"))
    best = pool.withColumn("seen", seen("id")).withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "id"))).filter("p <= 10").groupBy("query_id").agg(gain("p").alias("ideal"))
    return best.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6).alias("alpha_ndcg"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def met06_latency(spark, sf):  # noqa: ANN001, ANN201
    """Nearest-rank percentiles and mean of a run's latencies."""
    e = table(spark, sf, "events")
    return metrics.nearest_ranks(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).join(e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")), "event_type")


@query(f"""WITH {RUNS}, g AS (SELECT query_id % 4 AS domain, avg(ma.ndcg_10) AS baseline, avg(mb.ndcg_10) AS now, count(*) AS n FROM ma JOIN mb USING (query_id) GROUP BY ALL), s AS (SELECT *, sqrt(baseline * (1 - baseline) / n) AS se FROM g)
SELECT domain, round(now - baseline, 6) AS delta, round(se, 6) AS standard_error, round(2 * se, 6) AS noise_floor, CASE WHEN abs(now - baseline) <= 2 * se THEN 'inconclusive-below-noise-floor' WHEN now >= baseline THEN 'pass' ELSE 'fail' END AS status FROM s""")
def sta09_noise_floor(spark, sf):  # noqa: ANN001, ANN201
    """A change of a bounded metric counts only beyond twice its standard error."""
    both = _beir(spark, sf).join(_beir(spark, sf, 32).select("query_id", F.col("ndcg_10").alias("c")), "query_id")
    g = both.groupBy((F.col("query_id") % 4).alias("domain")).agg(F.avg("ndcg_10").alias("baseline"), F.avg("c").alias("now"), F.count("*").alias("n"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("baseline")))
    g = g.withColumns({"se": F.sqrt(p * (1 - p) / F.col("n")), "delta": F.col("now") - F.col("baseline")})
    status = F.when(F.abs("delta") <= 2 * F.col("se"), "inconclusive-below-noise-floor").when(F.col("delta") >= 0, "pass").otherwise("fail")
    return g.select("domain", F.round("delta", 6).alias("delta"), F.round("se", 6).alias("standard_error"), F.round(2 * F.col("se"), 6).alias("noise_floor"), status.alias("status"))


RESAMPLES = 999


@query(f"""WITH {CLUSTERED}, c AS (SELECT cluster, count(*) AS m, sum(d - (SELECT avg(d) FROM d)) AS r FROM k GROUP BY ALL), w AS (SELECT (SELECT avg(d) FROM d) AS mean, (SELECT count(*) FROM d) AS n),
o AS (SELECT mean, n, (SELECT sqrt(sum(r * r)) FROM c) / n AS se FROM w), b AS (SELECT b, cluster, m, CASE WHEN left(md5(b || ':' || cluster), 1) < '8' THEN -r ELSE r END AS r FROM c, range(1, {RESAMPLES + 1}) t(b)),
s AS (SELECT b, sum(r) / (SELECT n FROM w) AS delta FROM b GROUP BY b), t AS (SELECT b, any_value(delta) AS delta, sqrt(sum((r - m * delta) ** 2)) / (SELECT n FROM w) AS se FROM b JOIN s USING (b) GROUP BY b),
x AS (SELECT count(*) FILTER (round(abs(CASE WHEN t.se < 1e-12 THEN 0 ELSE t.delta / t.se END), 9) >= round(abs(CASE WHEN o.se < 1e-12 THEN 0 ELSE o.mean / o.se END), 9)) AS extreme FROM t, o)
SELECT (SELECT count(*) FROM c) AS clusters, round(mean, 6) AS mean, round(se, 6) AS se, round(extreme / {RESAMPLES}.0, 6) AS p FROM o, x""")
def sta04_wild_bootstrap(spark, sf):  # noqa: ANN001, ANN201
    """Wild cluster bootstrap: residuals of whole clusters change sign by a hash; from the clusters' sums alone."""
    d = clustered(spark, sf)
    whole = d.agg(F.avg("d").alias("mean"), F.count("*").alias("n"))
    c = d.crossJoin(F.broadcast(whole)).groupBy("cluster", "mean", "n").agg(F.count("*").alias("m"), F.sum(F.col("d") - F.col("mean")).alias("r"))
    flipped = F.substring(F.md5(F.concat_ws(":", F.col("b").cast("string"), F.col("cluster").cast("string")).cast("binary")), 1, 1) < "8"
    b = c.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(RESAMPLES)))).withColumn("s", F.when(flipped, -F.col("r")).otherwise(F.col("r")))
    t = b.groupBy("b", "mean", "n").agg(F.sum("s").alias("shift"), F.collect_list(F.struct("s", "m")).alias("parts"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.count("*").alias("clusters"))  # as many parts as clusters
    delta = F.col("shift") / F.col("n")
    se = F.sqrt(F.aggregate("parts", F.lit(0.0), lambda a, x: a + F.pow(x["s"] - x["m"] * delta, F.lit(2.0)))) / F.col("n")
    own = F.sqrt("rr") / F.col("n")
    statistic = lambda x, e: F.round(F.abs(F.when(e < 1e-12, 0.0).otherwise(x / e)), 9)
    judged = t.select("clusters", "mean", own.alias("se"), (statistic(delta, se) >= statistic(F.col("mean"), own)).alias("extreme"))
    return judged.agg(F.max("clusters").alias("clusters"), F.round(F.max("mean"), 6).alias("mean"), F.round(F.max("se"), 6).alias("se"), F.round(F.count_if("extreme") / RESAMPLES, 6).alias("p"))


# --- logs -----------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, event_id, value, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 10")
def agg03_slowest(spark, sf):  # noqa: ANN001, ANN201
    """The ten slowest calls of each kind."""
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf, "events").withColumn("place", place).filter("place <= 10").select("event_type", "event_id", "value", "place")


# --- plug-ins -------------------------------------------------------------------------------------------------------------

_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


def overlap(queries: list[str], texts: list[str]) -> list[float]:
    """A reranker: the share of a query's words that a text holds. It fails on queries that name a digit 7."""
    if any("7" in q for q in queries):
        raise ValueError("no sevens")
    words = [(set(_ASCII.findall(q.lower())), set(_ASCII.findall(t.lower()))) for q, t in zip(queries, texts, strict=True)]
    return [len(q & t) / max(1, len(q)) for q, t in words]


@query(rf"""WITH {bm25_sql(20)}, h AS (SELECT query_id, id, rank, rank <= 8 AS block, b.text AS q, d.text AS t FROM bm25 JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = id),
s AS (SELECT *, CASE WHEN block AND NOT contains(q, '7') THEN len(list_intersect({_WORDS.format('q')}, {_WORDS.format('t')})) / greatest(1, len({_WORDS.format('q')}))::DOUBLE END AS p FROM h), m AS (SELECT *, bool_or(block AND p IS NULL) OVER (PARTITION BY query_id) AS degraded FROM s)
SELECT query_id, id, coalesce(round(p, 6), -1) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY block DESC, CASE WHEN block AND NOT degraded THEN -round(p, 6) ELSE 0 END, rank) AS rank, degraded FROM m""")
def udf02_reranker(spark, sf):  # noqa: ANN001, ANN201
    """A plugged reranker over the first hits, with queries that it fails on."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = bm25_run(spark, sf, 20).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id").join(b, "query_id")
    return plugins.rerank(hits.select("query_id", "query", "id", "rank", "text"), overlap).fillna(-1.0, ["rerank_score"])


def halves(texts: list[str]) -> list[list[str]]:
    """A decomposer: a query's sentences."""
    return [[s for s in (x.strip(" ") for x in t.split(".")) if s] for t in texts]


@query("WITH p AS (SELECT item_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '') AS l FROM benchmark) SELECT item_id, generate_subscripts(l, 1)::INT - 1 AS part, unnest(l) AS subquery FROM p")
def udf04_decomposer(spark, sf):  # noqa: ANN001, ANN201
    return plugins.decompose(table(spark, sf, "benchmark").select("item_id", "text"), halves).select("item_id", "part", "subquery")


def covered(premises: list[str], hypotheses: list[str]) -> list[float]:
    """An entailment model: the share of a hypothesis' words that the premise holds."""
    words = [(set(_ASCII.findall(p.lower())), set(_ASCII.findall(h.lower()))) for p, h in zip(premises, hypotheses, strict=True)]
    return [len(p & h) / max(1, len(h)) for p, h in words]


@query(rf"""WITH p AS (SELECT a.conv_id, b.turn, {_WORDS.format('a.text')} AS p, {_WORDS.format('b.text')} AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(len(list_intersect(p, h)) / greatest(1, len(h))::DOUBLE, 6) AS entailment, len(list_intersect(p, h)) / greatest(1, len(h))::DOUBLE >= 0.1 AS entailed FROM p""")
def udf05_entailment(spark, sf):  # noqa: ANN001, ANN201
    """Whether a turn holds what the next one says."""
    c = table(spark, sf, "conversations")
    pairs = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("premise")).join(c.select("conv_id", "turn", F.col("text").alias("hypothesis")), ["conv_id", "turn"])
    return plugins.entail(pairs, covered, 0.1).select("conv_id", "turn", F.round("entailment", 6).alias("entailment"), "entailed")


_KEYS = f"""z AS (SELECT b, list(CASE WHEN left(md5(b || ':' || i), 1) < '8' THEN 1.0::DOUBLE ELSE -1 END ORDER BY i) AS s FROM range({dense.BITS}) c(b), range(64) d(i) GROUP BY b),
y AS (SELECT vec_id, list(list_inner_product(embedding::DOUBLE[], s) >= 0 ORDER BY b) AS bits FROM embeddings, z GROUP BY vec_id),
a AS (SELECT q.vec_id AS query_id, x.vec_id AS id, len(list_filter(q.bits, lambda v, i: v <> x.bits[i])) AS apart FROM y q, y x WHERE q.vec_id % 25 = 0 AND x.vec_id <> q.vec_id),
l AS (SELECT query_id, max(apart) AS most FROM (SELECT query_id, apart, coalesce(sum(count(*)) OVER (PARTITION BY query_id ORDER BY apart ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a GROUP BY query_id, apart)
  WHERE before < (SELECT greatest(ceil(count(*) * {dense.SHARE}), {dense.LEAST * 10}) FROM embeddings) GROUP BY query_id),
near AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM (
  SELECT a.query_id, id, round(list_sum(list_transform(range(1, 65), lambda i: (x.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2)), 6) AS score FROM a JOIN l ON l.query_id = a.query_id AND apart <= most JOIN embeddings q ON q.vec_id = a.query_id JOIN embeddings x ON x.vec_id = id)) WHERE rank <= 10)"""


@query(f"WITH {_KEYS} SELECT query_id, id, score, rank FROM near")
def ret03_hashed_knn(spark, sf):  # noqa: ANN001, ANN201
    """Approximate neighbours by sketches; a twelfth of the rows at most are measured."""
    return plugins.search(_queries(spark, sf), _vectors(spark, sf).select("id", "v"), 10, "sketched")


@query(f"WITH {_KEYS}, {knn_sql('r')}, h AS (SELECT r.query_id, count(*) AS n, count(near.id) AS found FROM r LEFT JOIN near ON near.query_id = r.query_id AND near.id = r.id GROUP BY ALL) SELECT 'sketched' AS strategy, round(sum(found) / sum(n)::DOUBLE, 6) AS recall FROM h")
def udf06_strategy_recall(spark, sf):  # noqa: ANN001, ANN201
    """What share of the exact neighbours another strategy finds."""
    q, v = _queries(spark, sf), _vectors(spark, sf).select("id", "v")
    exact, found = (plugins.search(q, v, 10, s).select("query_id", "id") for s in ("exact", "sketched"))
    return exact.join(found.withColumn("found", F.lit(1)), ["query_id", "id"], "left").agg(F.lit("sketched").alias("strategy"), F.round(F.count("found") / F.count("*"), 6).alias("recall"))
