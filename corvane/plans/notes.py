"""Notes as text: headings with lines, spans of signals, suggestions, globs, views, tabular and grouped output, answers with several golds."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from corvane.functions import safety, text
from corvane.plans.corpus import _ATTACKS, _attacked, glob_pattern
from corvane.plans.evaluation import COMPARED, KENDALL, NORMAL, _compared
from corvane.operators import metrics
from corvane.plans.retrieval import _vectors, dense_run, knn_sql
from corvane.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- markdown ----------------------------------------------------------------------------------------------------------

#: Notes as both engines build them: sentences become headings, one of them stands in a fence, some close with hashes.
_MARKDOWN = "'# Note ' || doc_id || chr(10) || replace(text, '. ', '.' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '## ' WHEN 1 THEN '   ### ' ELSE '####### ' END) || chr(10) || '```' || chr(10) || '# in a fence' || chr(10) || '```' || chr(10) || '### The end ##' || chr(10) || '#no heading'"
_HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*))?$"


def headings(note: Column) -> Column:
    """Array of (line from 1, level, text) of a note's headings outside fences; closing hashes are dropped."""
    lines = F.split(note, "\n")
    none = F.array().cast("array<struct<line:int,level:int,text:string>>")
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_extract(x, _HEADING, 2), r"(^|[ \t])#+[ \t]*$", ""), r"^[ \t]+|[ \t]+$", "")

    def step(a: Column, x: Column) -> Column:
        fence = x.rlike(r"^ {0,3}```")
        found = F.struct((a["at"] + 1).alias("line"), F.length(F.regexp_extract(x, _HEADING, 1)).alias("level"), bare(x).alias("text"))
        out = F.when(~a["fence"] & x.rlike(_HEADING), F.concat(a["out"], F.array(found))).otherwise(a["out"])
        return F.struct((a["at"] + 1).alias("at"), (a["fence"] != fence).alias("fence"), out.alias("out"))

    return F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.lit(False).alias("fence"), none.alias("out")), step, lambda a: a["out"])


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(n, chr(10))) AS x, generate_subscripts(string_split(n, chr(10)), 1) AS line FROM (SELECT doc_id, {_MARKDOWN} AS n FROM documents)),
f AS (SELECT *, sum(regexp_matches(x, '^ {{0,3}}```')::INT) OVER (PARTITION BY doc_id ORDER BY line) % 2 AS fence FROM l)
SELECT doc_id, line::INT AS line, length(regexp_extract(x, '{_HEADING}', 1))::INT AS level, regexp_replace(regexp_replace(regexp_extract(x, '{_HEADING}', 2), '(^|[ \t])#+[ \t]*$', ''), '^[ \t]+|[ \t]+$', '', 'g') AS heading FROM f WHERE fence = 0 AND regexp_matches(x, '{_HEADING}')""")
def prj13_markdown_headings(spark, sf):  # noqa: ANN001, ANN201
    """Headings with their lines and levels; what stands in a fence is none."""
    h = table(spark, sf, "documents").select("doc_id", F.inline(headings(F.expr(_MARKDOWN))))
    return h.select("doc_id", "line", "level", F.col("text").alias("heading"))


@query(r"""WITH s AS (SELECT doc_id, source, text, trim(regexp_extract(text, '^\s*([^.!?\n]+[.!?]?)', 1)) AS first FROM documents),
v AS (SELECT doc_id, unnest(['passage', 'summary', 'metadata']) AS kind, unnest([text, first, source || ' / ' || doc_id]) AS body, source FROM s) SELECT doc_id, kind, sha256('[' || source || '] ' || body) AS address FROM v WHERE body <> ''""")
def prj10_view_texts(spark, sf):  # noqa: ANN001, ANN201
    """Three views of each note, each with its parent's name before it; a note without a sentence has no summary."""
    first = F.trim(F.regexp_extract("text", r"^\s*([^.!?\n]+[.!?]?)", 1))
    view = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("body"))
    views = F.array(view("passage", F.col("text")), view("summary", first), view("metadata", F.concat("source", F.lit(" / "), F.col("doc_id").cast("string"))))
    v = table(spark, sf, "documents").select("doc_id", "source", F.inline(views)).filter("body <> ''")
    return v.select("doc_id", "kind", F.sha2(F.concat(F.lit("["), "source", F.lit("] "), "body").cast("binary"), 256).alias("address"))


# --- signals and suggestions ---------------------------------------------------------------------------------------------


def _spans_of(content: Column, rule: str, pattern: str) -> Column:
    parts = F.arrays_zip(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)).alias("m"), F.split(content, pattern, -1).alias("p"))
    none = F.array().cast("array<struct<start:int,end:int,rule:string>>")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(rule).alias("rule"))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull(), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])


def spans(content: Column, rules: dict[str, str]) -> Column:
    """Array of (start, end, rule) of all matches, in order; offsets are code points, ends exclusive."""
    return F.array_sort(F.concat(*[_spans_of(content, r, p) for r, p in rules.items()]))


def _spans_sql(rule: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return rf"SELECT doc_id, '{rule}' AS rule, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS span_start, unnest(list_transform(m, lambda x: length(x))) AS n FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS s FROM a) WHERE len(m) > 0"


@query(f"WITH a AS ({_ATTACKS}), z AS ({' UNION ALL '.join(_spans_sql(r, p) for r, p in safety.SHIELD.items())}) SELECT doc_id, rule, span_start::INT AS span_start, (span_start + n)::INT AS span_end FROM z")
def fn12_shield_spans(spark, sf):  # noqa: ANN001, ANN201
    """Every signal with its rule and span."""
    found = _attacked(spark, sf).select("doc_id", F.inline(spans(F.col("t"), safety.SHIELD)))
    return found.select("doc_id", "rule", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


#: A nation's name as a customer might type it.
_TYPED = "CASE c_custkey % 4 WHEN 0 THEN substr(n_name, 2) WHEN 1 THEN n_name || 'S' WHEN 2 THEN replace(n_name, 'A', 'QZ') ELSE 'X' || c_custkey END"


@query(f"""WITH t AS (SELECT c_custkey, upper({_TYPED}) AS typed FROM customer JOIN nation ON n_nationkey = c_nationkey), d AS (SELECT c_custkey, typed, n_name, levenshtein(typed, n_name) AS d FROM t, nation),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, length(n_name), n_name) AS r FROM d WHERE d <= greatest(1, ceil(length(typed) / 3.0))) SELECT c_custkey, n_name AS suggestion, d AS distance FROM r WHERE r = 1""")
def fn07_near_suggestion(spark, sf):  # noqa: ANN001, ANN201
    """The nearest name, if it is near enough for the length of what was typed; 25 names to choose from."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    t = table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.upper(F.expr(_TYPED)).alias("typed"))
    d = t.crossJoin(F.broadcast(n.select(F.col("n_name").alias("name")))).withColumn("d", F.levenshtein("typed", "name"))
    near = d.filter(F.col("d") <= F.greatest(F.lit(1), F.ceil(F.length("typed") / 3)))
    best = near.groupBy("c_custkey").agg(F.min(F.struct("d", F.length("name").alias("n"), "name")).alias("b"))
    return best.select("c_custkey", F.col("b.name").alias("suggestion"), F.col("b.d").alias("distance"))


# --- filters --------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE regexp_matches(source || '/notes/' || lang || '/' || doc_id || '.md', '^(?:src1|src2|src1[0-4])/(?:.*/)?[^/]*[0-4][^5]\\.md$')")
def flt04_glob_braces(spark, sf):  # noqa: ANN001, ANN201
    """Alternatives and classes of a path glob."""
    path = F.concat("source", F.lit("/notes/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf, "documents").filter(path.rlike(glob_pattern("{src1,src2,src1[0-4]}/**/*[0-4][!5].md"))).select("doc_id")


@query(f"""WITH {knn_sql('r', 20)}, c AS (SELECT r.*, CASE WHEN label <> query_id % 10 THEN 'kb_scope' WHEN score > 1.6 THEN 'threshold' ELSE 'none' END AS reason FROM r JOIN embeddings ON vec_id = id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, reason ORDER BY score, id) AS place, count(*) OVER (PARTITION BY query_id, reason) AS of FROM c) SELECT query_id, reason, id, score, place, of AS candidates FROM n WHERE place <= 3""")
def flt12_nearest_dropped(spark, sf):  # noqa: ANN001, ANN201
    """For each reason that candidates are dropped by, how many there are and the nearest three."""
    c = dense_run(spark, sf, 20).join(_vectors(spark, sf).select("id", "label"), "id")
    reason = F.when(F.col("label") != F.col("query_id") % 10, "kb_scope").when(F.col("score") > 1.6, "threshold").otherwise("none")
    whole = Window.partitionBy("query_id", "reason")
    n = c.withColumn("reason", reason).withColumns({"place": F.row_number().over(whole.orderBy("score", "id")), "candidates": F.count("*").over(whole)})
    return n.filter("place <= 3").select("query_id", "reason", "id", "score", "place", "candidates")


# --- summaries and output ----------------------------------------------------------------------------------------------------


@query(f"""WITH {COMPARED}, {KENDALL}, q AS (SELECT query_id, count(*) FILTER (before_rank IS NULL OR after_rank IS NULL) AS churn, count(*) FILTER (before_rank <> after_rank) AS moved, bool_or(coalesce(before_rank, 0) = 1 AND coalesce(after_rank, 0) <> 1) AS top FROM c GROUP BY query_id)
SELECT coalesce((query_id % 4)::VARCHAR, 'ALL') AS shelf, count(*) AS queries, round(avg(stability), 6) AS stability, round(avg(churn), 6) AS churn, sum(moved)::BIGINT AS moved, count(*) FILTER (top) AS top_changed FROM q JOIN k USING (query_id) GROUP BY ROLLUP (query_id % 4)""")
def agg14_by_shelf(spark, sf):  # noqa: ANN001, ANN201
    """What changed between two runs, by shelf and for all of them."""
    c = _compared(spark, sf)
    gone = F.col("before_rank").isNull() | F.col("after_rank").isNull()
    top = (F.coalesce("before_rank", F.lit(0)) == 1) & (F.coalesce("after_rank", F.lit(0)) != 1)
    q = c.groupBy("query_id").agg(F.count_if(gone).alias("churn"), F.count_if(F.col("before_rank") != F.col("after_rank")).alias("moved"), F.max(top).alias("top"))
    q = q.join(metrics.kendall(c, 10), "query_id").withColumn("shelf", (F.col("query_id") % 4).cast("string"))
    summed = q.rollup("shelf").agg(F.count("*").alias("queries"), F.round(F.avg("stability"), 6).alias("stability"), F.round(F.avg("churn"), 6).alias("churn"), F.sum("moved").alias("moved"), F.count_if("top").alias("top_changed"))
    return summed.withColumn("shelf", F.coalesce("shelf", F.lit("ALL")))


_CELLS = "[p_partkey::VARCHAR, p_name, p_name || ', \"' || p_brand || '\"', CASE WHEN p_size % 5 = 0 THEN p_type || chr(10) || 'x' ELSE p_type END]"
_QUOTED = "CASE WHEN regexp_matches(x, '[\",\\r\\n]') THEN '\"' || replace(x, '\"', '\"\"') || '\"' ELSE x END"


@query(f"""WITH c AS (SELECT p_partkey, {_CELLS} AS c FROM part) SELECT p_partkey, array_to_string(list_transform(c, lambda x: {_QUOTED}), ',') AS csv, array_to_string(list_transform(c, lambda x: regexp_replace(x, '[\\t\\r\\n]+', ' ', 'g')), chr(9)) AS tsv,
'| ' || array_to_string(list_transform(c, lambda x: replace(regexp_replace(x, '[\\r\\n]+', ' ', 'g'), '|', '\\|')), ' | ') || ' |' AS markdown FROM c""")
def snk03_tabular(spark, sf):  # noqa: ANN001, ANN201
    """Rows as lines of CSV, TSV and Markdown tables, quoted where it is needed."""
    odd = F.when(F.col("p_size") % 5 == 0, F.concat("p_type", F.lit("\nx"))).otherwise(F.col("p_type"))
    cells = F.array(F.col("p_partkey").cast("string"), F.col("p_name"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')), odd)
    quoted = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    flat = lambda x: F.regexp_replace(x, "[\t\r\n]+", " ")
    cell = lambda x: F.replace(F.regexp_replace(x, "[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(cells, quoted), ",").alias("csv"), F.array_join(F.transform(cells, flat), "\t").alias("tsv"), F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |")).alias("markdown"))


@query(f"""WITH {knn_sql('r', 20)}, g AS (SELECT query_id, id % 8 AS source, min(rank) AS first, string_agg(format('{{:>4}} {{:.6f}}', id, score), chr(10) ORDER BY rank) AS hits, count(*) AS n FROM r GROUP BY ALL)
SELECT query_id, string_agg('source ' || source || ' (' || n || ')' || chr(10) || hits, chr(10) ORDER BY first) AS page FROM g GROUP BY query_id""")
def snk05_grouped_page(spark, sf):  # noqa: ANN001, ANN201
    """A query's hits as a page: sources in the order of their best hits, hits as aligned lines."""
    line = F.format_string("%4d %.6f", "id", "score")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "\n")
    g = dense_run(spark, sf, 20).groupBy("query_id", (F.col("id") % 8).alias("source")).agg(F.min("rank").alias("first"), joined(F.struct("rank", line.alias("t"))).alias("hits"), F.count("*").alias("n"))
    block = F.concat(F.lit("source "), F.col("source").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), "hits")
    return g.groupBy("query_id").agg(joined(F.struct("first", block.alias("t"))).alias("page"))


# --- answers ------------------------------------------------------------------------------------------------------------------


@query(rf"""WITH a AS (SELECT conv_id, turn, {NORMAL.format('text')} AS t FROM conversations), p AS (SELECT x.conv_id, x.turn, x.t AS a, y.t AS b FROM a x JOIN a y ON x.conv_id = y.conv_id AND x.turn <> y.turn AND x.turn % 2 = 0 AND y.turn % 2 = 1),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) AS common FROM p)
SELECT conv_id, turn, bool_or(array_to_string(a, ' ') = array_to_string(b, ' ')) AS exact, round(max(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN common = 0 THEN 0 ELSE 2.0 * common / (len(a) + len(b)) END), 6) AS f1 FROM c GROUP BY conv_id, turn""")
def met13_best_gold(spark, sf):  # noqa: ANN001, ANN201
    """Exact match and token F1 of an answer against the best of its golds: the even turns, against the odd ones of their conversation."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", text.normal_answer(F.col("text")).alias("t"))
    p = t.filter("turn % 2 = 0").select("conv_id", "turn", F.col("t").alias("a")).join(t.filter("turn % 2 = 1").select("conv_id", F.col("t").alias("b")), "conv_id")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return p.groupBy("conv_id", "turn").agg(F.max(F.col("a") == F.col("b")).alias("exact"), F.round(F.max(text.token_f1(words("a"), words("b"))), 6).alias("f1"))
