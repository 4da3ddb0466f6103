"""Retrieval queries over the driver's tables: each as a DataFrame and, where possible, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import safety, text
from corvane.operators import dense, fusion, lexical, recall
from corvane.operators.index import index_of
from corvane.runtime import table

K = 10


# --- inputs -----------------------------------------------------------------------------------------------------------


def _terms(spark, sf):  # noqa: ANN001, ANN202
    return lexical.query_terms(table(spark, sf, "benchmark"), "item_id", "text")


def _vectors(spark, sf):  # noqa: ANN001, ANN202
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _queries(spark, sf, every: int = 25):  # noqa: ANN001, ANN202
    return _vectors(spark, sf).filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def dense_run(spark, sf, k: int = K, dims: int = 64) -> DataFrame:  # noqa: ANN001
    """Nearest rows of each query vector; ``dims`` below 64 stands for another model."""
    cut = lambda c: F.slice(c, 1, dims)
    v = _vectors(spark, sf)
    return dense.knn(_queries(spark, sf).withColumn("q", cut("q")), v.select("id", cut("v").alias("v")), k)


def bm25_run(spark, sf, k: int = K, kb: bool = False) -> DataFrame:  # noqa: ANN001
    """The k best documents of each benchmark item, or of each item and shelf, from the index that is kept of them."""
    return index_of(spark, sf, "documents", "doc_id", "text", "source").search(table(spark, sf, "benchmark"), "item_id", "text", k, per_scope=kb)


TOKENS = r"regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\p{L}\p{N}]+')"


def bm25_sql(k: int = K, kb: str = "'all'", unit: str = "doc_id", source: str = "documents", keys: str = "query_id", p: str = "", tokens: str = TOKENS, asked: str = "benchmark") -> str:
    """CTEs up to ``bm25`` (query_id, kb, id, score, rank), their names with a prefix ``p``."""
    return rf"""{p}d AS (SELECT {kb} AS kb, {unit} AS id, {tokens} AS tokens FROM {source}),
{p}st AS (SELECT kb, count(*) AS n, greatest(avg(len(tokens)), 1) AS avgdl FROM {p}d GROUP BY kb),
{p}tf AS (SELECT kb, id, len(tokens) AS dl, unnest(tokens) AS term FROM {p}d),
{p}po AS (SELECT kb, id, dl, term, count(*) AS tf FROM {p}tf GROUP BY ALL),
{p}df AS (SELECT kb, term, count(*) AS df FROM {p}po GROUP BY ALL),
{p}qt AS (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM {asked}),
{p}qf AS (SELECT query_id, term, count(*) AS qtf FROM {p}qt GROUP BY ALL),
{p}sc AS (SELECT query_id, po.kb, po.id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM {p}po po JOIN {p}df USING (kb, term) JOIN {p}st USING (kb) JOIN {p}qf USING (term) GROUP BY query_id, po.kb, po.id),
{p}bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, id) AS rank FROM {p}sc) WHERE rank <= {k})"""


def knn_sql(name: str = "knn", k: int = K, dims: int = 64, where: str = "true") -> str:
    """A CTE of the dense run."""
    return f"""{name} AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM (
  SELECT q.vec_id AS query_id, x.vec_id AS id, round(list_sum(list_transform(range(1, {dims} + 1), lambda i: (x.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2)), 6) AS score
  FROM embeddings q, embeddings x WHERE q.vec_id % 25 = 0 AND x.vec_id <> q.vec_id AND {where})) WHERE rank <= {k})"""


QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- scoring scans ----------------------------------------------------------------------------------------------------


@query(f"WITH {bm25_sql()} SELECT query_id, id, score, rank FROM bm25")
def ret05_bm25(spark, sf):  # noqa: ANN001, ANN201
    return bm25_run(spark, sf).select("query_id", "id", "score", "rank")


_TITLE = r"regexp_extract_all(lower(source), '[\p{L}\p{N}]+')"


@query(f"WITH {bm25_sql(10, tokens=f'list_concat(list_concat(list_concat({_TITLE}, {_TITLE}), {_TITLE}), {TOKENS})')} SELECT query_id, id, score, rank FROM bm25")
def ret05_titled(spark, sf):  # noqa: ANN001, ANN201
    """Field weights: a title (the shelf's name here) counts three times, in frequencies and lengths."""
    d = table(spark, sf, "documents")
    return lexical.search(d, "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text", K, title="source").select("query_id", "id", "score", "rank")


@query(f"WITH {bm25_sql(3, 'source', keys='query_id, kb')} SELECT query_id, kb, id, score, rank FROM bm25")
def ret06_bm25_per_kb(spark, sf):  # noqa: ANN001, ANN201
    return bm25_run(spark, sf, 3, kb=True).select("query_id", "kb", "id", "score", "rank")


@query(f"""WITH b AS (SELECT source AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source), {bm25_sql(5, source='b')},
{bm25_sql(1, p='c_')}, best AS (SELECT query_id, source, arg_min(id, (-score, id)) AS chunk FROM c_sc JOIN documents ON doc_id = id GROUP BY ALL)
SELECT bm25.query_id, bm25.id AS source, bm25.score, bm25.rank, best.chunk FROM bm25 JOIN best ON best.query_id = bm25.query_id AND best.source = bm25.id""")
def ret07_bm25_by_source(spark, sf):  # noqa: ANN001, ANN201
    """Unit source: a source's chunks count together, by sums over the index's postings; a source comes with its best chunk of the chunks' own ranking."""
    found = index_of(spark, sf, "documents", "doc_id", "text", "source").search_scopes(table(spark, sf, "benchmark"), "item_id", "text", 5)
    return found.select("query_id", F.col("kb").alias("source"), "score", "rank", F.col("best").alias("chunk"))


@query(f"""WITH {bm25_sql(10, 'source', keys='query_id, kb')} SELECT query_id, kb, id, score, rank FROM (SELECT query_id, kb, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25) WHERE rank <= 10""")
def ret08_multi_kb_merge(spark, sf):  # noqa: ANN001, ANN201
    return lexical.top(bm25_run(spark, sf, 10, kb=True).drop("rank"), 10).select("query_id", "kb", "id", "score", "rank")


@query(f"WITH {knn_sql()} SELECT * FROM knn")
def ret01_dense_knn(spark, sf):  # noqa: ANN001, ANN201
    return dense_run(spark, sf)


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT d, min(x) AS lo, max(x) AS hi FROM x GROUP BY d),
z AS (SELECT vec_id, list(CASE WHEN hi > lo THEN lo + round((x - lo) / (hi - lo) * 255) * (hi - lo) / 255 ELSE lo END ORDER BY d) AS v FROM x JOIN m USING (d) GROUP BY vec_id)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM (
  SELECT q.vec_id AS query_id, z.vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: (z.v[i] - q.embedding[i]::DOUBLE) ** 2)), 6) AS score FROM embeddings q, z WHERE q.vec_id % 25 = 0 AND z.vec_id <> q.vec_id)) WHERE rank <= 10""")
def ret02_sq8_knn(spark, sf):  # noqa: ANN001, ANN201
    v = _vectors(spark, sf).select("id", "v")
    return dense.knn(_queries(spark, sf), dense.quantised(v), K)


@query(f"WITH {knn_sql(where='x.label = q.label')} SELECT * FROM knn")
def flt02_kb_scoped_knn(spark, sf):  # noqa: ANN001, ANN201
    """Scope before distance: each query meets the rows of its own shelf alone, in the same scan as all other queries."""
    v = _vectors(spark, sf).withColumnRenamed("label", "scope")
    q = v.filter("id % 25 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "scope")
    return dense.knn(q, v, K)


@query(f"WITH {knn_sql()} SELECT * FROM knn WHERE score <= 1.5")
def flt01_score_threshold(spark, sf):  # noqa: ANN001, ANN201
    return dense_run(spark, sf).filter("score <= 1.5")


@query(f"""WITH {knn_sql()}, g AS (SELECT *, lead(score) OVER w - score AS gap, row_number() OVER w - 1 AS i FROM knn WINDOW w AS (PARTITION BY query_id ORDER BY score, id)),
s AS (SELECT query_id, max(score) AS last, count(*) AS n, max(gap) AS most, avg(gap) AS mean FROM g GROUP BY query_id),
t AS (SELECT query_id, score, i, row_number() OVER (PARTITION BY query_id ORDER BY gap DESC NULLS LAST, i) AS r FROM g)
SELECT query_id, round(CASE WHEN most IS NULL OR most <= mean * 1.1 THEN last ELSE score END, 6) AS threshold, CASE WHEN most > mean * 1.1 THEN i END AS knee_index,
       CASE WHEN most IS NULL OR most <= mean * 1.1 THEN n ELSE i + 1 END AS kept FROM s JOIN t USING (query_id) WHERE r = 1""")
def flt09_auto_threshold(spark, sf):  # noqa: ANN001, ANN201
    return fusion.knee(dense_run(spark, sf))


def _two_models(spark, sf, k: int = 20) -> DataFrame:  # noqa: ANN001
    a, b = dense_run(spark, sf, k), dense_run(spark, sf, k, 32)
    return a.select("query_id", F.lit(1).alias("list"), F.lit(1.0).alias("weight"), "id", "rank").unionByName(b.select("query_id", F.lit(2).alias("list"), F.lit(1.0).alias("weight"), "id", "rank"))


RRF_SQL = f"""{knn_sql('ka', 20)}, {knn_sql('kb', 20, 32)}, runs AS (SELECT query_id, 1 AS list, id, rank FROM ka UNION ALL SELECT query_id, 2, id, rank FROM kb),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS lists, min(list * 100000 + rank) AS first FROM runs GROUP BY query_id, id),
fused AS (SELECT query_id, id, score, lists, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f) WHERE rank <= 10)"""


@query(f"WITH {RRF_SQL} SELECT * FROM fused")
def ret09_rrf(spark, sf):  # noqa: ANN001, ANN201
    return fusion.fuse(_two_models(spark, sf), K).select("query_id", "id", "score", "lists", "rank")


def _fetch_k(k: int) -> int:
    """Candidates of each leg of a hybrid search."""
    return max(min(4 * k, 200), k)


def embed_sql(name: str, source: str, unit: str) -> str:
    """CTEs up to ``name`` (i, v): the hash embedding of each text."""
    return f"""{name}_w AS (SELECT {unit} AS i, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^A-Za-z0-9_]+'), lambda x: x <> '')) AS t FROM {source}),
{name}_u AS (SELECT t, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(t) + 1), lambda k: ascii(substr(t, k, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 64 AS d FROM (SELECT DISTINCT t FROM {name}_w)),
{name}_c AS (SELECT i, d, count(*) AS n FROM {name}_w JOIN {name}_u USING (t) GROUP BY ALL), {name}_n AS (SELECT i, sqrt(sum(n * n)) AS norm FROM {name}_c GROUP BY i),
{name}_e AS (SELECT {unit} AS i, unnest(range(64)) AS d FROM {source}),
{name} AS (SELECT i, list(round(coalesce(n / norm, 0), 6) ORDER BY d) AS v FROM {name}_e LEFT JOIN {name}_c USING (i, d) LEFT JOIN {name}_n USING (i) GROUP BY i)"""


#: The dense leg over texts: nearest documents of each item by their hash embeddings.
TEXT_KNN_SQL = f"""{embed_sql('de', 'documents', 'doc_id')}, {embed_sql('qe', 'benchmark', 'item_id')},
text_knn AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM (
  SELECT qe.i AS query_id, de.i AS id, round(list_sum(list_transform(range(1, 65), lambda k: (de.v[k] - qe.v[k]) ** 2)), 6) AS score FROM qe, de)) WHERE rank <= 40)"""


def text_run(spark, sf, k: int) -> DataFrame:  # noqa: ANN001
    """The k nearest documents of each benchmark item by hash embeddings."""
    d = dense.hash_embedding(table(spark, sf, "documents").select("doc_id", "text"), "text").select(F.col("doc_id").alias("id"), F.col("embedding").alias("v"))
    q = dense.hash_embedding(table(spark, sf, "benchmark").select("item_id", "text"), "text").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"))
    return dense.knn(q, d, k, same=False)


@query(f"""WITH {bm25_sql(40)}, {TEXT_KNN_SQL}, runs AS (SELECT query_id, id, 1 AS list, rank FROM text_knn UNION ALL SELECT query_id, id, 2, rank FROM bm25),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 100000 + rank) AS first FROM runs GROUP BY query_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f)
SELECT r.query_id, r.id, r.score, r.rank, t.score AS distance, b.id IS NOT NULL AS lexical FROM r LEFT JOIN text_knn t ON t.query_id = r.query_id AND t.id = r.id LEFT JOIN bm25 b ON b.query_id = r.query_id AND b.id = r.id WHERE r.rank <= 10""")
def ret10_hybrid(spark, sf):  # noqa: ANN001, ANN201
    """The dense leg over hash embeddings and BM25, fused; each hit with its distance, if the dense leg found it, and whether BM25 did."""
    n = _fetch_k(K)
    near, lexical_run = text_run(spark, sf, n), bm25_run(spark, sf, n)
    runs = near.select("query_id", F.lit(1).alias("list"), F.lit(1.0).alias("weight"), "id", "rank")
    runs = runs.unionByName(lexical_run.select("query_id", F.lit(2).alias("list"), F.lit(1.0).alias("weight"), "id", "rank"))
    fused = fusion.fuse(runs, K).select("query_id", "id", "score", "rank")
    found = lexical_run.select("query_id", "id", F.lit(True).alias("lexical"))
    return fused.join(near.select("query_id", "id", F.col("score").alias("distance")), ["query_id", "id"], "left").join(found, ["query_id", "id"], "left").fillna(False, ["lexical"])


_PROBES = "SELECT item_id, text FROM benchmark UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT event_id, props FROM events"


@query("SELECT item_id, CASE " + " ".join("WHEN regexp_matches(trim(text), '{}') THEN '{}'".format(p.replace("'", "''"), r) for p, r in safety.HYBRID_FORMS) + f" ELSE 'prose query' END AS reason FROM ({_PROBES})")
def ret11_auto_mode(spark, sf):  # noqa: ANN001, ANN201
    """Search mode of queries, urls and the props of all events."""
    probes = table(spark, sf, "benchmark").select("item_id", "text").unionAll(table(spark, sf, "pages").select("page_id", "url")).unionAll(table(spark, sf, "events").select("event_id", "props"))
    return probes.select("item_id", safety.search_mode(F.col("text"))["reason"].alias("reason"))


@query(f"""WITH {knn_sql('kk', 20)}, h AS (SELECT query_id, id % 50 AS canonical_id, id, score, rank, CASE WHEN id % 3 = 0 THEN 'passage' ELSE 'summary' END AS kind FROM kk)
SELECT query_id, canonical_id, round(min(score) / (1 + least(count(*) - 1, 6) * 0.05), 6) AS score, count(*) AS hits, arg_min(id, (CASE WHEN kind = 'passage' THEN 0 ELSE 1 END) * 1000 + rank) AS representative FROM h GROUP BY ALL""")
def ret12_collapse_views(spark, sf):  # noqa: ANN001, ANN201
    hits = dense_run(spark, sf, 20).select("query_id", (F.col("id") % 50).alias("canonical_id"), "id", "score", "rank", F.when(F.col("id") % 3 == 0, "passage").otherwise("summary").alias("kind"))
    return fusion.collapse_views(hits)


def _sources(spark, sf):  # noqa: ANN001, ANN202
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")


@query(f"""WITH {bm25_sql(40)}, c AS (SELECT b.*, source, substr(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 1, 800) AS f FROM bm25 b JOIN documents ON doc_id = id),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, f ORDER BY rank) AS copy FROM c)
SELECT query_id, id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM u WHERE copy = 1""")
def ret13_duplicate_collapse(spark, sf):  # noqa: ANN001, ANN201
    """High-recall filter, first rule: of equal fingerprints (source and start of the text) the best-ranked stays."""
    hits = bm25_run(spark, sf, 40).join(_sources(spark, sf), "id").withColumn("f", F.sha1(F.substring(text.one_line(F.lower(text.compatible(F.col("text")))), 1, 800).cast("binary")))
    copy = F.row_number().over(Window.partitionBy("query_id", "source", "f").orderBy("rank"))
    kept = hits.withColumn("copy", copy).filter("copy = 1")
    return kept.select("query_id", "id", "source", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"))


@query(f"""WITH {bm25_sql(40)}, n AS (SELECT query_id, id, source, b.rank, row_number() OVER (PARTITION BY query_id, source ORDER BY b.rank) AS nth FROM bm25 b JOIN documents ON doc_id = id)
SELECT query_id, id, source, rank FROM n WHERE nth <= 3 OR rank <= 10""")
def ret13_source_cap(spark, sf):  # noqa: ANN001, ANN201
    """High-recall filter, second rule: three of a source, further ones only while fewer than k are kept.

    A fold in rank order keeps the first k hits whatever their source; after them a hit is kept if fewer than three of its
    source were, which is the case exactly if it is among the source's first three.
    """
    hits = bm25_run(spark, sf, 40).join(_sources(spark, sf).drop("text"), "id")
    nth = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))
    return hits.withColumn("nth", nth).filter((F.col("nth") <= 3) | (F.col("rank") <= K)).select("query_id", "id", "source", "rank")


_ANCHORS = r"list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_./:@+-]+'), lambda w: lower(w)), lambda w: length(w) >= 3 AND regexp_matches(w, '[\p{{L}}\p{{N}}]') AND w NOT IN (" + ", ".join(f"'{w}'" for w in text.ANCHOR_STOP_WORDS) + ")))"


@query(rf"""WITH turns AS (SELECT conv_id || '#' || turn AS id, conv_id::VARCHAR AS source, turn, text FROM conversations), {bm25_sql(40, unit='id', source='turns')},
h AS (SELECT b.query_id, b.id, b.rank, t.source, t.turn, t.text, b.rank <= 4 AS lexical, array_to_string(string_split(q.text, ' ')[3:4], ' ') AS query FROM bm25 b JOIN turns t ON t.id = b.id JOIN benchmark q ON q.item_id = b.query_id),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, substr(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 1, 800) ORDER BY rank) > 1 AS copy FROM h),
p AS (SELECT *, sum((NOT copy)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS place, sum((NOT copy)::INT) OVER (PARTITION BY query_id, source ORDER BY rank) AS nth, {_ANCHORS.format('query')} AS anchors FROM u),
s AS (SELECT *, NOT copy AND (place <= 10 OR nth <= 3) AS stays FROM p), a AS (SELECT *, stays AND (lexical OR len(list_filter(anchors, lambda x: contains(lower(text || ' ' || source), x))) > 0) AS anchored FROM s),
n AS (SELECT *, len(anchors) > 0 AND stays AND NOT anchored AND EXISTS (SELECT 1 FROM a b WHERE b.query_id = a.query_id AND b.source = a.source AND b.anchored AND abs(b.turn - a.turn) = 1) AS near FROM a),
r AS (SELECT *, len(anchors) > 0 AND count(*) FILTER (anchored OR near) OVER (PARTITION BY query_id) < least(10, count(*) FILTER (stays) OVER (PARTITION BY query_id)) AS relaxed FROM n)
SELECT query_id, id, rank, CASE WHEN copy THEN 'duplicate_collapse' WHEN NOT stays THEN 'source_diversity_cap' WHEN len(anchors) > 0 AND NOT relaxed AND NOT anchored AND NOT near THEN 'anchor_filter' END AS reason, near AND NOT relaxed AS neighbour, relaxed FROM r""")
def ret13_high_recall(spark, sf):  # noqa: ANN001, ANN201
    """All three rules over turns of conversations: a pool of forty recalled by an item's whole text, of which four count as lexical hits; two of its words are what is asked."""
    turns = table(spark, sf, "conversations").select(F.concat_ws("#", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("chunk_index"), "text")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 3, 2), " ").alias("query"))
    pool = lexical.search(turns, "id", "text", table(spark, sf, "benchmark"), "item_id", "text", 40).select("query_id", "id", "rank", (F.col("rank") <= 4).alias("lexical"))
    return recall.high_recall(pool.join(turns, "id").join(asked, "query_id"), K)


_ASPECTS = r"""list_filter(list_transform(regexp_split_to_array(plain, '(?i)\s+(?:and|then|while|where|which|who|that|because|before|after)\s+'), lambda x: regexp_replace(trim(x), '^[,;: -]+|[,;: -]+$', '', 'g')), lambda x: x <> '')"""
_ONCE = "list_filter({0}, lambda x, i: x <> '' AND list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"
_PLANNED = rf"""asks AS (SELECT item_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain FROM questions), asp0 AS (SELECT *, regexp_replace(plain, '^[,;: -]+|[,;: -]+$', '', 'g') AS whole, {_ASPECTS} AS parts FROM asks),
asp AS (SELECT *, list_concat(CASE WHEN len(parts) > 1 THEN parts ELSE [whole] END, CASE WHEN regexp_matches(plain, '(?i)\bbetween\s+(.+?)\s+and\s+(.+?)(?:[?.]|$)') THEN list_transform([1, 2], lambda g: regexp_replace(trim(CASE g WHEN 1 THEN regexp_extract(plain, '(?i)\bbetween\s+(.+?)\s+and\s+(.+?)(?:[?.]|$)', 1) ELSE regexp_extract(plain, '(?i)\bbetween\s+(.+?)\s+and\s+(.+?)(?:[?.]|$)', 2) END), '^[,;: -]+|[,;: -]+$', '', 'g')) ELSE [] END) AS raw FROM asp0),
planned AS (SELECT item_id, {_ONCE.format('raw')} AS aspects, {_ONCE.format('list_concat([whole], raw)')} AS every FROM asp), subs AS (SELECT item_id AS query_id, i - 1 AS part, every[i] AS subquery, least(4, len(every)) AS parts, len(aspects) AS asked FROM planned, range(1, 5) r(i) WHERE i <= len(every))"""
#: Questions: every third item asks for what lies between two of its words, too.
_QUESTIONS = r"questions AS (SELECT item_id, CASE WHEN length(text) % 3 = 0 THEN text || ' between ' || string_split(text, ' ')[2] || ' and ' || string_split(text, ' ')[5] || '?' WHEN length(text) % 7 = 0 THEN text || ' and ' || 'unheardofword' ELSE text END AS text FROM benchmark)"


def _questions(spark, sf):  # noqa: ANN001, ANN202
    words = F.split("text", " ")
    between = F.concat(F.lit(" between "), F.get(words, F.lit(1)), F.lit(" and "), F.get(words, F.lit(4)), F.lit("?"))
    asked = F.when(F.length("text") % 3 == 0, F.concat("text", between)).when(F.length("text") % 7 == 0, F.concat("text", F.lit(" and unheardofword"))).otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", asked.alias("text"))


@query(f"WITH {_QUESTIONS}, {_PLANNED} SELECT query_id, part, subquery, parts, asked FROM subs")
def ret16_subqueries(spark, sf):  # noqa: ANN001, ANN201
    """A question and its aspects, each once, four at most."""
    return recall.subqueries(_questions(spark, sf), "item_id", "text")


@query(f"""WITH {_QUESTIONS}, {_PLANNED}, asked AS (SELECT query_id * 10 + part AS item_id, subquery AS text FROM subs), {bm25_sql(24, asked='asked')},
hits AS (SELECT query_id // 10 AS query_id, query_id % 10 AS part, b.rank, b.id, lower(text) AS text FROM bm25 b JOIN documents ON doc_id = b.id),
found AS (SELECT s.*, coalesce(n, 0) AS n, ceil(24 / s.parts)::INT AS share FROM subs s LEFT JOIN (SELECT query_id, part, count(*) AS n FROM hits GROUP BY ALL) USING (query_id, part)),
spent AS (SELECT *, coalesce(sum(least(n, share)) OVER (PARTITION BY query_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM found),
budget AS (SELECT *, least(share, 24 - before) AS room, before + least(n, share) >= 24 AS is_full FROM spent WHERE before < 24),
evidence AS (SELECT h.* FROM hits h JOIN budget b ON b.query_id = h.query_id AND b.part = h.part AND h.rank <= b.room),
wanted AS (SELECT item_id AS query_id, i AS aspect, {_ANCHORS.format('aspects[i]')} AS anchors FROM planned, range(1, 200) r(i) WHERE i <= len(aspects)),
met AS (SELECT w.query_id, aspect, min(CASE WHEN text IS NOT NULL AND (len(anchors) = 0 OR len(list_filter(anchors, lambda x: contains(text, x))) > 0) THEN part END) AS first FROM wanted w LEFT JOIN evidence e ON e.query_id = w.query_id GROUP BY ALL),
enough AS (SELECT query_id, CASE WHEN count(first) = count(*) THEN max(first) END AS enough FROM met GROUP BY query_id),
ended AS (SELECT query_id, coalesce(enough, last) AS until, CASE WHEN enough IS NOT NULL THEN 'sufficient' WHEN is_full THEN 'max_total_candidates' WHEN parts >= 4 AND last < asked THEN 'max_subqueries' ELSE 'exhausted_subqueries' END AS stop
  FROM (SELECT query_id, max(part) AS last, bool_or(is_full) AS is_full, max(parts) AS parts, max(asked) AS asked FROM budget GROUP BY query_id) LEFT JOIN enough USING (query_id)),
pieces AS (SELECT e.query_id, id, until, stop, count(*) AS times, min((part, rank)) AS first FROM evidence e JOIN ended USING (query_id) WHERE part <= until GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (first[1] = 0 AND times = 1), times DESC, first[1], first[2]) AS rank FROM pieces)
SELECT query_id, id, times, first[1] AS first_part, rank, until + 1 AS iterations, stop FROM ranked WHERE rank <= 10""")
def ret16_gathered(spark, sf):  # noqa: ANN001, ANN201
    """Questions asked part by part, 24 candidates for all parts of one: evidence that several parts found first."""
    asked = _questions(spark, sf)
    parts = recall.subqueries(asked, "item_id", "text")
    found = index_of(spark, sf, "documents", "doc_id", "text", "source").search(parts.withColumn("asks", F.col("query_id") * 10 + F.col("part")), "asks", "subquery", 24)
    hits = found.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).cast("int").alias("part"), "rank", "id").join(_sources(spark, sf).select("id", "text"), "id")
    return recall.gathered(asked, "item_id", "text", parts, hits, K, 24)


@query()
def ret14_diverse(spark, sf):  # noqa: ANN001, ANN201
    n = min(max(4 * K, 20), 100)
    hits = bm25_run(spark, sf, n).join(_sources(spark, sf), "id").select("query_id", "id", "source", (1.0 / F.col("rank")).alias("base"), text.mmr_tokens(F.col("text")).alias("tokens"))
    return fusion.diversify(hits, K)


@query(f"""WITH {knn_sql('pos', 40)}, {knn_sql('neg', 40, 32)}, b AS (SELECT p.query_id, p.id, round(1.0 / p.rank - 1.25 * coalesce(1.0 / n.rank, 0), 6) AS score FROM pos p LEFT JOIN neg n ON p.query_id = n.query_id AND n.id = p.id)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 10""")
def ret14_contrastive(spark, sf):  # noqa: ANN001, ANN201
    """Positive support by rank, less a quarter more than the negative list's; negative-only candidates don't count."""
    pos, neg = dense_run(spark, sf, 40), dense_run(spark, sf, 40, 32).select("query_id", "id", F.col("rank").alias("nr"))
    scored = pos.join(neg, ["query_id", "id"], "left").select("query_id", "id", F.round(1.0 / F.col("rank") - 1.25 * F.coalesce(1.0 / F.col("nr"), F.lit(0.0)), 6).alias("score"))
    return lexical.top(scored, K)


@query(r"SELECT item_id, pos - 1 AS part, s AS subquery FROM (SELECT item_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '\s+(?:and|or|et|und|y)\s+|[;?]\s*'), lambda x: trim(x)), lambda x: length(x) >= 3) AS l FROM benchmark))")
def ret16_decompose(spark, sf):  # noqa: ANN001, ANN201
    parts = F.filter(F.transform(F.split("text", r"\s+(?:and|or|et|und|y)\s+|[;?]\s*"), F.trim), lambda s: F.length(s) >= 3)
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(parts).alias("part", "subquery"))


@query(f"""WITH {bm25_sql(3)}, a AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 8)) AS anchors FROM benchmark),
e AS (SELECT query_id, string_agg(lower(text), ' ') AS t FROM bm25 JOIN documents ON doc_id = id GROUP BY query_id)
SELECT query_id, len(anchors) AS anchors, len(list_filter(anchors, lambda w: NOT contains(coalesce(t, ''), w))) AS missing FROM a LEFT JOIN e USING (query_id)""")
def ret17_missing_aspects(spark, sf):  # noqa: ANN001, ANN201
    a = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 8)).alias("anchors"))
    e = bm25_run(spark, sf, 3).join(_sources(spark, sf), "id").groupBy("query_id").agg(F.collect_list(F.lower("text")).alias("t"))  # three texts a query
    missing = F.filter("anchors", lambda w: ~F.exists(F.coalesce("t", F.array().cast("array<string>")), lambda t: F.contains(t, w)))
    return a.join(e, "query_id", "left").select("query_id", F.size("anchors").alias("anchors"), F.size(missing).alias("missing"))


@query(f"WITH {knn_sql('r', 5, where='x.label = q.label')} SELECT * FROM r")
def ret18_related(spark, sf):  # noqa: ANN001, ANN201
    """Neighbours of a seed on its own shelf, without the seed."""
    return flt02_kb_scoped_knn(spark, sf).filter("rank <= 5")


@query(f"""WITH {knn_sql('r', 20)}, s AS (SELECT *, rank <= 8 AS block, round(1 / (1 + exp(-(id % 17 - 8))), 6) AS p FROM r)
SELECT query_id, id, p AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY block DESC, CASE WHEN block THEN -p ELSE 0 END, rank) AS rank FROM s""")
def ret19_rerank_block(spark, sf):  # noqa: ANN001, ANN201
    """The first block is rescored by a stand-in model, the tail keeps its order; ties keep theirs (with RET-20's logistic score)."""
    hits = dense_run(spark, sf, 20).withColumns({"block": F.col("rank") <= 8, "p": F.round(1 / (1 + F.exp(-(F.col("id") % 17 - 8))), 6)})
    order = Window.partitionBy("query_id").orderBy(F.desc("block"), F.when(F.col("block"), -F.col("p")).otherwise(0.0), "rank")
    return hits.select("query_id", "id", F.col("p").alias("rerank_score"), F.row_number().over(order).alias("rank"))


@query("SELECT vec_id, round(exp(embedding[2]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE)), 6) AS score FROM embeddings")
def ret20_logit_score(spark, sf):  # noqa: ANN001, ANN201
    """Softmax of the positive label of two logits."""
    e = lambda i: F.exp(F.get("embedding", F.lit(i)).cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(e(1) / (e(0) + e(1)), 6).alias("score"))


@query(f"""WITH {bm25_sql(20)}, a AS (SELECT item_id AS query_id, list_distinct({TOKENS}) AS q FROM benchmark), c AS (SELECT query_id, id, rank, q, list_distinct({TOKENS}) AS t FROM bm25 JOIN documents ON doc_id = id JOIN a USING (query_id)),
s AS (SELECT query_id, id, round(0.62 * len(list_intersect(q, t)) / len(q) + 0.16 / rank - 0.0001 * len(t), 6) AS score FROM c)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s""")
def ret21_heuristic_rerank(spark, sf):  # noqa: ANN001, ANN201
    """Coverage of the query's tokens, rank, and length."""
    a = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(text.bm25_tokens(F.col("text"))).alias("q"))
    c = bm25_run(spark, sf, 20).join(_sources(spark, sf), "id").join(a, "query_id").withColumn("t", F.array_distinct(text.bm25_tokens(F.col("text"))))
    s = c.select("query_id", "id", F.round(0.62 * F.size(F.array_intersect("q", "t")) / F.size("q") + 0.16 / F.col("rank") - 0.0001 * F.size("t"), 6).alias("score"))
    return lexical.top(s, 20)


@query()
def ret22_late_interaction(spark, sf):  # noqa: ANN001, ANN201
    """MaxSim of token vectors (hashed presence of character trigrams), over the first hits of each query; whole texts and all queries.

    A vector has 64 places, so it is one long, and words of equal vectors of a document count once.
    """
    def vectors(df, *keys):  # noqa: ANN001, ANN202
        words = df.select(*keys, F.explode(F.array_distinct(text.bm25_tokens(F.col("text")))).alias("w"))
        grams = F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda k: F.pmod(F.xxhash64(F.substring("p", k, F.lit(3))), F.lit(64)).cast("int"))
        bits = F.aggregate(grams, F.lit(0).cast("long"), lambda a, g: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), g)))
        return words.withColumn("p", F.concat(F.lit("^"), "w", F.lit("$"))).select(*keys, "w", bits.alias("g"))

    q = vectors(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id").groupBy("query_id", F.col("g").alias("gq")).agg(F.count("*").alias("n"))
    hits = bm25_run(spark, sf, 10).select("query_id", "id")
    d = vectors(_sources(spark, sf).join(hits.select("id").distinct(), "id", "left_semi"), "id").select("id", "g").distinct()
    sim = F.bit_count(F.col("g").bitwiseAND(F.col("gq"))) / F.sqrt(F.bit_count("g") * F.bit_count("gq"))
    best = hits.join(q, "query_id").join(d, "id").groupBy("query_id", "id", "gq", "n").agg(F.max(sim).alias("m"))
    return lexical.top(best.groupBy("query_id", "id").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("score")), 10)


@query(f"WITH {embed_sql('e', 'benchmark', 'item_id')} SELECT i AS item_id, generate_subscripts(v, 1)::INT - 1 AS dim, unnest(v) AS value FROM e")
def ret23_hash_embedding(spark, sf):  # noqa: ANN001, ANN201
    return dense.hash_embedding(table(spark, sf, "benchmark").select("item_id", "text"), "text").select("item_id", F.posexplode("embedding").alias("dim", "value"))


@query("SELECT doc_id, 'search_document: ' || text AS prefixed FROM documents")
def ret24_task_prefix(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("search_document: "), "text").alias("prefixed"))


@query(f"""WITH {knn_sql('r', 20)}, s AS (SELECT r.*, label FROM r JOIN embeddings ON vec_id = id), k AS (SELECT query_id, arg_min(label, score * 1000000 + label / 1000.0) AS kb, min(score) AS best FROM s GROUP BY query_id)
SELECT query_id, k.kb, k.best, arg_min(s.id, s.rank) AS file, k.best < 1.0 AS confident FROM k JOIN s USING (query_id) WHERE s.label = k.kb GROUP BY query_id, k.kb, k.best""")
def ret26_where(spark, sf):  # noqa: ANN001, ANN201
    """The shelf with the nearest hit, then the nearest file there."""
    s = dense_run(spark, sf, 20).join(_vectors(spark, sf).select("id", "label"), "id")
    k = s.groupBy("query_id").agg(F.min_by("label", F.struct("score", "label")).alias("kb"), F.min("score").alias("best"))
    return k.join(s.select("query_id", F.col("label").alias("kb"), "id", "rank"), ["query_id", "kb"]).groupBy("query_id", "kb", "best").agg(F.min_by("id", "rank").alias("file")).withColumn("confident", F.col("best") < 1.0)


@query(f"WITH {knn_sql('r', 5)} SELECT * FROM r WHERE score <= 1.0")
def ret27_preflight(spark, sf):  # noqa: ANN001, ANN201
    return dense_run(spark, sf, 5).filter("score <= 1.0")


@query(r"SELECT count(*) AS rows_in, count(DISTINCT trim(regexp_replace(text, '\s+', ' ', 'g'))) AS embedded FROM documents")
def ret28_embed_once(spark, sf):  # noqa: ANN001, ANN201
    """Equal normalised texts are embedded once; the hash stands for the text in the exchange."""
    return table(spark, sf, "documents").select(F.xxhash64(text.one_line(F.col("text"))).alias("h")).agg(F.count("*").alias("rows_in"), F.countDistinct("h").alias("embedded"))


# --- joins, sorts and sets over ranked rows ------------------------------------------------------------------------------


@query(f"""WITH {knn_sql('a')}, {knn_sql('b', 10, 32)} SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce(a.rank, 0) AS rank_a, coalesce(b.rank, 0) AS rank_b, a.rank IS NOT NULL AND b.rank IS NOT NULL AS in_both,
least(coalesce(a.rank, 999), coalesce(b.rank, 999)) AS best FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id""")
def jon01_compare_models(spark, sf):  # noqa: ANN001, ANN201
    a = dense_run(spark, sf).select("query_id", "id", F.col("rank").alias("rank_a"))
    b = dense_run(spark, sf, dims=32).select("query_id", "id", F.col("rank").alias("rank_b"))
    joined = a.join(b, ["query_id", "id"], "full_outer").withColumns({"in_both": F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull(), "best": F.least(F.coalesce("rank_a", F.lit(999)), F.coalesce("rank_b", F.lit(999)))})
    return joined.fillna(0, ["rank_a", "rank_b"])  # 0: not in that model's list


@query(f"""WITH {bm25_sql(5)}, h AS (SELECT query_id, source, id AS idx, rank FROM bm25 JOIN documents ON doc_id = id),
n AS (SELECT h.query_id, d.source, d.doc_id AS idx, min(h.rank) AS claimed_by FROM h JOIN documents d ON d.source = h.source AND d.doc_id BETWEEN h.idx - 40 AND h.idx + 40
      WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.query_id = h.query_id AND x.source = d.source AND x.idx = d.doc_id) GROUP BY ALL)
SELECT query_id, source, idx, claimed_by FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY claimed_by, source, idx) AS r FROM n) WHERE r <= 50""")
def jon06_neighbours(spark, sf):  # noqa: ANN001, ANN201
    docs = _sources(spark, sf).select("source", F.col("id").alias("idx"))
    hits = bm25_run(spark, sf, 5).join(_sources(spark, sf), "id").select("query_id", "source", F.col("id").alias("idx"), "rank")
    return fusion.neighbours(hits, docs, 40, 40)


@query(f"WITH {knn_sql('a', 20)}, {knn_sql('b', 5, 32)} SELECT query_id, id, rank FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.query_id = a.query_id AND b.id = a.id)")
def jon09_semi(spark, sf):  # noqa: ANN001, ANN201
    return dense_run(spark, sf, 20).join(dense_run(spark, sf, 5, 32).select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "id", "rank")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jon10_anti(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region WHERE n_regionkey <> r_regionkey")
def jon11_cross(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "nation").crossJoin(table(spark, sf, "region")).filter("n_regionkey <> r_regionkey").select("n_name", "r_name")


@query(f"""WITH {knn_sql('r', 10)} SELECT r.query_id, r.id, r.score FROM r JOIN embeddings s ON s.vec_id = r.query_id JOIN embeddings o ON o.vec_id = r.id WHERE o.vec_id > s.vec_id AND o.label >= s.label""")
def jon12_newer_neighbour(spark, sf):  # noqa: ANN001, ANN201
    """Neighbours that are newer (greater id) and of no weaker standing (label)."""
    v = _vectors(spark, sf)
    run = dense_run(spark, sf).join(v.select("id", F.col("label").alias("theirs")), "id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return run.filter("id > query_id and theirs >= own").select("query_id", "id", "score")


@query("SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id)) AS rank FROM documents) WHERE rank <= 100")
def srt05_seeded_shuffle(spark, sf):  # noqa: ANN001, ANN201
    """Order by the hash of seed and index; a top-k report, so no task sorts the whole table."""
    first = table(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws(":", F.lit("42"), F.col("doc_id").cast("string")).cast("binary"), 256).alias("h")).orderBy("h").limit(100)
    return first.select("doc_id", F.row_number().over(Window.orderBy("h")).alias("rank"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def srt04_last_n(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)


@query("SELECT p_partkey, p_name FROM part WHERE p_name > 'm' ORDER BY p_name, p_partkey LIMIT 25")
def srt06_keyset_page(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "part").filter("p_name > 'm'").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(25)


@query("SELECT s_name AS name, s_acctbal AS score, s_nationkey FROM supplier ORDER BY s_acctbal DESC, s_nationkey, s_name LIMIT 40")
def srt03_multi_key(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_nationkey", "s_name").limit(40).select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"), "s_nationkey")


@query("SELECT text FROM benchmark UNION SELECT text FROM documents WHERE length(text) < 300")
def set01_union_dedupe(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "benchmark").select("text").union(table(spark, sf, "documents").filter("length(text) < 300").select("text")).distinct()


@query(f"WITH {knn_sql('a')}, {knn_sql('b', 10, 32)} SELECT query_id, id FROM a INTERSECT SELECT query_id, id FROM b")
def set02_intersect(spark, sf):  # noqa: ANN001, ANN201
    return dense_run(spark, sf).select("query_id", "id").intersect(dense_run(spark, sf, dims=32).select("query_id", "id"))


@query(f"WITH {knn_sql('a')}, {knn_sql('b', 10, 32)} SELECT query_id, id FROM a EXCEPT SELECT query_id, id FROM b")
def set03_except(spark, sf):  # noqa: ANN001, ANN201
    return dense_run(spark, sf).select("query_id", "id").subtract(dense_run(spark, sf, dims=32).select("query_id", "id"))


@query(f"""WITH {bm25_sql(5)}, m AS (SELECT query_id, id, list_distinct({TOKENS}) AS t FROM bm25 JOIN documents ON doc_id = id), q AS (SELECT item_id AS query_id, list_distinct({TOKENS}) AS q FROM benchmark)
SELECT query_id, id, round(len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))), 6) AS jaccard FROM m JOIN q USING (query_id)""")
def set04_token_jaccard(spark, sf):  # noqa: ANN001, ANN201
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(text.bm25_tokens(F.col("text"))).alias("q"))
    m = bm25_run(spark, sf, 5).join(_sources(spark, sf), "id").select("query_id", "id", F.array_distinct(text.bm25_tokens(F.col("text"))).alias("t"))
    return m.join(q, "query_id").select("query_id", "id", F.round(text.jaccard(F.col("t"), F.col("q")), 6).alias("jaccard"))


@query(f"""WITH {bm25_sql(10)}, t AS (SELECT query_id, id, rank, greatest(1, ceil(length(trim(text)) / 4.0))::BIGINT AS tokens FROM bm25 JOIN documents ON doc_id = id) SELECT query_id, count(*) AS offered, sum(tokens)::BIGINT AS tokens FROM t GROUP BY query_id""")
def fn15_token_estimate(spark, sf):  # noqa: ANN001, ANN201
    run = bm25_run(spark, sf).join(_sources(spark, sf), "id")
    return run.groupBy("query_id").agg(F.count("*").alias("offered"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))


@query(f"""WITH RECURSIVE {bm25_sql(10)}, t AS (SELECT query_id, id, rank, greatest(1, ceil(length(trim(text)) / 4.0))::BIGINT AS tokens FROM bm25 JOIN documents ON doc_id = id),
p(query_id, rank, used, included, n) AS (SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, ''::VARCHAR, 0::BIGINT FROM t UNION ALL
  SELECT p.query_id, t.rank, CASE WHEN used + tokens <= 2000 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 2000 THEN included || ',' || id ELSE included END, CASE WHEN used + tokens <= 2000 THEN n + 1 ELSE n END FROM p JOIN t ON t.query_id = p.query_id AND t.rank = p.rank + 1),
l AS (SELECT query_id, max(rank) AS m FROM p GROUP BY query_id)
SELECT p.query_id, used, substr(included, 2) AS included, p.rank - n AS excluded FROM p JOIN l ON l.query_id = p.query_id AND l.m = p.rank""")
def win01_context_packing(spark, sf):  # noqa: ANN001, ANN201
    run = bm25_run(spark, sf).join(_sources(spark, sf), "id").select("query_id", "id", "rank", text.token_estimate(F.col("text")).alias("tokens"))
    return fusion.pack(run, 2000)


@query(f"""WITH {knn_sql('r')}, g AS (SELECT *, score > 1.6 AS far, id % 7 = 0 AS lexical_only FROM r), s AS (SELECT *, CASE WHEN lexical_only OR NOT far THEN 'kept' ELSE 'dropped' END AS v, count(*) FILTER (lexical_only OR NOT far) OVER (PARTITION BY query_id) AS n FROM g)
SELECT query_id, id, rank, CASE WHEN n = 0 AND rank = 1 THEN 'rescued' ELSE v END AS verdict FROM s""")
def cmd11_gate_floor(spark, sf):  # noqa: ANN001, ANN201
    """Relevance gate, first step: far hits are dropped, lexical ones kept, and the best is rescued where nothing is left."""
    kept = (F.col("id") % 7 == 0) | (F.col("score") <= 1.6)
    n = F.count_if(kept).over(Window.partitionBy("query_id"))
    return dense_run(spark, sf).select("query_id", "id", "rank", F.when((n == 0) & (F.col("rank") == 1), "rescued").when(kept, "kept").otherwise("dropped").alias("verdict"))


@query(f"""WITH {knn_sql('r', 20)}, c AS (SELECT r.*, label, CASE WHEN label <> query_id % 10 THEN 'kb_scope' WHEN score > 1.6 THEN 'threshold' ELSE 'none' END AS reason FROM r JOIN embeddings ON vec_id = id)
SELECT query_id, reason, count(*) AS n, round(min(score), 6) AS nearest FROM c GROUP BY ALL""")
def flt12_explain_empty(spark, sf):  # noqa: ANN001, ANN201
    c = dense_run(spark, sf, 20).join(_vectors(spark, sf).select("id", "label"), "id")
    reason = F.when(F.col("label") != F.col("query_id") % 10, "kb_scope").when(F.col("score") > 1.6, "threshold").otherwise("none")
    return c.withColumn("reason", reason).groupBy("query_id", "reason").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("nearest"))


@query(f"WITH {knn_sql('r', 20)}, d AS (SELECT query_id, id % 60 AS path, id, rank, row_number() OVER (PARTITION BY query_id, id % 60 ORDER BY rank) AS c FROM r) SELECT query_id, path, id, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM d WHERE c = 1) WHERE n <= 5")
def ext18_promotion_candidates(spark, sf):  # noqa: ANN001, ANN201
    first = F.row_number().over(Window.partitionBy("query_id", "path").orderBy("rank"))
    kept = dense_run(spark, sf, 20).withColumn("path", F.col("id") % 60).withColumn("c", first).filter("c = 1")
    return kept.select("query_id", "path", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("n")).filter("n <= 5")


@query(f"""WITH {knn_sql('r', 20)}, g AS (SELECT query_id, id % 8 AS source, id, rank, score FROM r) SELECT query_id, source, count(*) AS n, min(score) AS best, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM g GROUP BY ALL""")
def agg11_group_by_source(spark, sf):  # noqa: ANN001, ANN201
    g = dense_run(spark, sf, 20).groupBy("query_id", (F.col("id") % 8).alias("source"))
    return g.agg(F.count("*").alias("n"), F.min("score").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"))
