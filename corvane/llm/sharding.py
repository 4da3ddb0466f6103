"""Sharding by a hypergeometric communication matrix, in DataFrame and SQL functions alone.

A uniform shuffle into shards of exact sizes, without a global sort: the matrix says how many rows of each partition go
to each shard. Its cells are drawn from the multivariate hypergeometric distribution with the partitions' row counts and
the shards' sizes as margins, which is the law they follow under a uniform permutation of all rows. Each partition
permutes its rows where they are, by a local sort of random keys, and deals them out by its line of the matrix; after the
exchange each shard permutes what it received.

A cell is drawn by inverse transform from the mode, or by ratio of uniforms where its spread is large, so that a draw takes a
bounded number of steps at any size. The matrix is drawn in two levels: first for blocks of about sqrt(P) of the P partitions (one line each), then, block by
block in parallel, for the partitions of a block. No task sees more than O(sqrt(P) * shards) cells, and the second
permutation works on slices of the random keys, so no task holds a shard.

Defined results: shard sizes differ by one row at most (law ``rows``), the first ``N mod S`` shards take the extra row;
slots run from 0 without gaps in each shard. Repeated rows, equal texts and null ids are rows like any other. A null
text has 0 bytes and crc 0; a text of any length counts whole. Ties of random keys go to the earlier row. An empty table
gives an empty result. Extra columns pass through untouched, but for those named ``shard`` or ``slot``, which are replaced;
names that begin with ``__`` are the operator's own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, read

N_SHARDS = 16
#: Standard deviations around the mode outside which a draw has no mass in double precision.
REACH = 12
#: Steps on one side of the mode beyond which a draw is made by rejection.
MOST_STEPS = 500
#: Rows of a slice of the second permutation, on average.
SLICE_ROWS = 250_000


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _uniform(*keys: str) -> str:
    """SQL for a number between 0 and 1, both excluded, from the hash of some keys."""
    return f"((shiftrightunsigned(xxhash64({', '.join(keys)}), 11) + 0.5D) * {2.0**-53!r}D)"


def _log_gamma_ratio(a: str, b: str) -> str:
    """SQL for ln(a! / b!) by Stirling's series, written so that large equal parts cancel before they are rounded."""
    tail = lambda y: f"1 / (12 * ({y} + 1D)) - 1 / (360 * pow({y} + 1D, 3))"
    return f"(({b} + 0.5D) * log1p(({a} - {b}) / ({b} + 1D)) + ({a} - {b}) * (ln({a} + 1D) - 1) + {tail(a)} - ({tail(b)}))"


def _by_rejection(seed: str, key: str) -> str:
    """SQL for a draw with the parameters ``p`` and the mode ``m`` by ratio of uniforms: a few steps on average, however many rows there are."""
    part = "(p.k / cast(p.t AS DOUBLE))"
    hat = f"named_struct('at', p.n * {part} + 0.5D, 'wide', {2 * math.sqrt(2 / math.e)!r}D * sqrt(p.n * {part} * (1 - {part}) * (p.t - p.n) / (p.t - 1D) + 0.5D) + {3 - 2 * math.sqrt(3 / math.e)!r}D, 'low', greatest(0L, p.n + p.k - p.t), 'high', least(p.n, p.k), 'q', p.t - p.k - p.n)"
    point = f"named_struct('x', {_uniform(seed, key, 'i', '0')}, 'y', {_uniform(seed, key, 'i', '1')})"
    ratio = " + ".join(_log_gamma_ratio(a, b) for a, b in (("m", "z"), ("(p.k - m)", "(p.k - z)"), ("(p.n - m)", "(p.n - z)"), ("(h.q + m)", "(h.q + z)")))
    test = f"if(z < h.low OR z > h.high, cast(null AS BIGINT), if(2 * ln(o.x) <= {ratio}, z, cast(null AS BIGINT)))"
    one = _let("o", point, _let("z", "cast(floor(h.at + h.wide * (o.y - 0.5D) / o.x) AS BIGINT)", test))
    # of each try a third is refused at most, so that none is left after so many
    return _let("h", hat, f"coalesce(aggregate(sequence(0, 199), cast(null AS BIGINT), (f, i) -> if(f IS NULL, {one}, f)), m)")


def _hypergeometric(n: str, k: str, t: str, seed: str, key: str) -> str:
    """SQL for one draw: how many of ``n`` rows taken from ``t`` fall among ``k`` marked ones; by inverse transform from the mode, or by rejection where that takes many steps."""
    p = f"named_struct('n', {n}, 'k', {k}, 't', {t}, 'u', {_uniform(seed, key)})"
    mode = "least(least(p.n, p.k), greatest(greatest(0L, p.n + p.k - p.t), cast(floor((p.n + 1D) * (p.k + 1D) / (p.t + 2D)) AS BIGINT)))"
    reach = f"cast(ceil({REACH} * sqrt(greatest(0D, (p.n / cast(p.t AS DOUBLE)) * p.k * ((p.t - p.k) / cast(p.t AS DOUBLE)) * (p.t - p.n) / greatest(1D, p.t - 1D)))) AS BIGINT) + {REACH}"
    span = "named_struct('m', m, 'hi', if(least(p.n, p.k) > m, sequence(m + 1, least(least(p.n, p.k), m + r)), cast(array() AS ARRAY<BIGINT>)), 'lo', if(greatest(0L, p.n + p.k - p.t) < m, sequence(m - 1, greatest(greatest(0L, p.n + p.k - p.t), m - r)), cast(array() AS ARRAY<BIGINT>)))"
    up = "a.w * (p.k - i + 1D) * (p.n - i + 1D) / (i * (p.t - p.k - p.n + i + 0D))"
    down = "a.w * (i + 1D) * (p.t - p.k - p.n + i + 1D) / ((p.k - i + 0D) * (p.n - i + 0D))"
    mass = lambda way, step: f"aggregate({way}, named_struct('w', 1D, 'c', 0D), (a, i) -> named_struct('w', {step}, 'c', a.c + {step}), a -> a.c)"
    pick = lambda way, step, start: f"aggregate({way}, named_struct('w', 1D, 'c', {start}, 'x', cast(null AS BIGINT)), (a, i) -> named_struct('w', {step}, 'c', a.c + {step}, 'x', coalesce(a.x, if(a.c + {step} > g, i, null))), a -> a.x)"
    chosen = f"if(g < 1D, s.m, coalesce({pick('s.hi', up, '1D')}, {pick('s.lo', down, '1D + h')}, s.m))"
    body = _let("h", mass("s.hi", up), _let("g", f"p.u * (1D + h + {mass('s.lo', down)})", chosen))
    drawn = _let("r", reach, f"if(r > {MOST_STEPS}, {_by_rejection(seed, key)}, {_let('s', span, body)})")
    return _let("p", p, f"if(p.n <= 0 OR p.k <= 0, 0L, if(p.k >= p.t, p.n, if(p.n >= p.t, p.k, {_let('m', mode, drawn)})))")


def _line(n: str, caps: str, key: str, seed: int) -> str:
    """SQL for a line of the matrix: ``n`` rows dealt over the shards' free places ``caps``."""
    draw = _hypergeometric("q.n", "c", "q.t", str(seed), f"{key}, j")
    step = f"transform(array({draw}), d -> named_struct('n', q.n - d, 't', q.t - c, 'row', concat(q.row, array(d))))[0]"
    return f"aggregate(sequence(0, size({caps}) - 1), named_struct('n', {n}, 't', aggregate({caps}, 0L, (a, x) -> a + x), 'row', cast(array() AS ARRAY<BIGINT>)), (q, j) -> transform(array({caps}[j]), c -> {step})[0], q -> q.row)"


def _matrix(parts: str, caps: str, seed: int) -> str:
    """SQL for lines of the matrix: ``parts`` is an array of (id, n) that together fill ``caps``."""
    step = f"transform(array({_line('e.n', 'z.caps', 'e.id', seed)}), v -> named_struct('caps', zip_with(z.caps, v, (x, y) -> x - y), 'out', concat(z.out, array(named_struct('id', e.id, 'row', v)))))[0]"
    return f"aggregate({parts}, named_struct('caps', {caps}, 'out', cast(array() AS ARRAY<STRUCT<id: BIGINT, row: ARRAY<BIGINT>>>)), (z, e) -> {step}, z -> z.out)"


def shard_sizes(total: int, n_shards: int) -> list[int]:
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def communication_matrix(counts: DataFrame, n_shards: int, seed: int) -> tuple[DataFrame, int]:
    """From (``__part`` long, ``n`` long), the matrix as (``__part``, ``row`` array of a count per shard), and the number of rows."""
    n_parts, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    caps = "array(" + ", ".join(f"{x}L" for x in shard_sizes(total, n_shards)) + ")"
    width = max(1, math.isqrt(max(0, n_parts - 1)) + 1)
    entry = lambda c: F.array_sort(F.collect_list(F.struct(F.col(c).cast("long").alias("id"), F.col("n"))))
    blocks = counts.withColumn("block", F.floor(F.col("__part") / width)).groupBy("block").agg(entry("__part").alias("parts"), F.sum("n").alias("n"))
    top = blocks.agg(entry("block").alias("all")).select(F.explode(F.expr(_matrix("all", caps, seed))).alias("x")).select(F.col("x.id").alias("block"), F.col("x.row").alias("caps"))
    cells = blocks.join(top, "block").select(F.explode(F.expr(_matrix("parts", "caps", seed + 1))).alias("x"))
    return cells.select(F.col("x.id").alias("__part"), F.col("x.row").alias("row")), total


def shard(df: DataFrame, n_shards: int = N_SHARDS, seed: int = 17) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long) to every row of ``df``: a uniform shuffle with exact shard sizes.

    The rows are staged once, so that partition numbers and row numbers can't change when a task is run again.
    """
    scratch = Scratch(df.sparkSession, "sharding")
    df = df.drop("shard", "slot")
    numbered = df.withColumns({"__part": F.spark_partition_id().cast("long"), "__row": F.monotonically_increasing_id()})
    permuted = numbered.sortWithinPartitions(F.xxhash64(F.lit(seed + 2), "__row"), "__row")
    # the id of a sorted row holds its place within the partition in the lower bits
    staged = scratch.cut(permuted.withColumn("__r", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    cells, total = communication_matrix(staged.groupBy("__part").agg(F.count("*").alias("n")), n_shards, seed)
    ends = cells.select("__part", F.expr("transform(sequence(1, size(row)), i -> aggregate(slice(row, 1, i), 0L, (a, x) -> a + x))").alias("__ends"))
    dealt = (
        staged.join(ends, "__part")
        .withColumn("shard", F.expr("size(filter(__ends, e -> e <= __r))"))
        .drop("__ends", "__r", "__part")
    )
    slices = max(1, math.ceil(total / n_shards / SLICE_ROWS))
    key = F.xxhash64(F.lit(seed + 3), "__row")
    dealt = scratch.cut(dealt.withColumns({"__key": key, "__slice": F.least(F.lit(slices - 1), F.floor((F.shiftrightunsigned(key, 11) * 2.0**-53) * slices)).cast("int")}))
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("shard", "__slice").agg(F.count("*").alias("n")).withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy("shard", "__slice").orderBy(F.shiftrightunsigned("__key", 11), "__row")
    return (
        dealt.withColumn("__r", F.row_number().over(inner) - 1)
        .join(first, ["shard", "__slice"])
        .withColumn("slot", F.col("__first") + F.col("__r"))
        .drop("__r", "__row", "__key", "__slice", "__first")
    )


def op1_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    """Law ``rows``; ``size`` and ``text_crc32`` are taken before the exchange, so texts stay where they are."""
    digest = read(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return shard(digest).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_hypergeometric_sharding": op1_hypergeometric_sharding}
SQL: dict[str, str] = {}
