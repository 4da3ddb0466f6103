"""Self-join of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 at least, by prefix filters.

Two similar sets share a token of their prefixes under any global order of the tokens. Three orders are used. The first
puts rare tokens first, by a sketch of shingle counts over all documents, and generates candidates; of these, only pairs
that also share prefix tokens under two more orders (by unrelated hashes) are left when the filters are intersected, and
only for them whole sets are made and compared. Size and position filters apply as well. Every filter is exact: it drops
no pair that is similar. A token whose counter stands at one is in one document alone and gets no posting.

Documents with equal sets form one class and are joined as one. In each of ``ROUNDS`` a posting is paired with a few pivots
of its token and size band, the same ones for a family of tokens, which is linear; components of the links are found, and
tokens that stand in one component alone are done. Then postings outside their token's largest component are
paired with all postings of other components. Links inside a component can't change it, so nothing is lost and a group
of near copies is not expanded into all its pairs.

The sketch has a counter for every shingle up to ``MOST_COUNTERS``. Shingles are counted ``FINE`` bits more finely, slice by
slice, and a counter holds the greatest of its counts, so that a token is taken for frequent only if a frequent one shares its
counter. In a corpus so large that even the fine counts hold several tokens each, a count must stand out of the noise, whose
width is the root of the mean, so that the order grows coarser but never wrong.

Defined results: a text of one to three words is one shingle; texts without words (or null) have an empty set and link
with nothing. A text of any length is one set. Rows that share an id are one document, with the links of all its rows.
Rows with a null id link with nothing and have a null component. Repeated rows repeat their results. Ties (tokens equally
frequent, pivots) are broken by hashes and change no result. Extra columns don't matter, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, in_lengths, read
from corvane.llm.components import connected_components, merged_components

WORDS = 4
#: Similarity times 100.
LEAST = 85
#: Least and most counters of the sketch, as powers of two: half a byte each on the driver and in workers.
LEAST_COUNTERS = 16
MOST_COUNTERS = 26
SLICE = 1 << 16
#: Bits by which shingles are told apart more finely where they are counted: a counter stands for the greatest of so many counts.
FINE = 6
#: Tokens that a worker counts before it hands the counts on.
COUNTED = 4_000_000
#: Rounds of pivots before pairs are taken across components: the families that tokens fall into to choose their pivots, the
#: pivots of a token and size band, and the least postings outside the largest component that a token must have to take part.
#: The first links what is easily linked by few pivots; the last are for large groups at the border of the threshold.
ROUNDS = ((1, 1, 0), (8, 1, 0), (1 << 20, 16, 32), (1 << 20, 48, 96))
#: Sizes within a band differ by this factor at most; similar sets stand in the same band or in neighbouring ones.
BAND = 1.2
#: Ids that may be broadcast (8 bytes each).
BROADCAST_IDS = 500_000
#: Characters that a worker hashes at once.
CHARS = 400_000

_MASK = (1 << 64) - 1


def _scramble(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = _scramble(1) & ~7 | 3  # 3 modulo 8, so that swapped bytes still differ in nearly all bits
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.array([_scramble(1000 + (b + 32 if 65 <= b <= 90 else b)) for b in range(256)], np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_PLACE = np.array([_scramble(2000 + i) | 1 for i in range(WORDS)], np.uint64)
_ORDERS = np.array([_scramble(3000 + i) | 1 for i in range(2)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Distinct shingle hashes of whole texts."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text, the sorted distinct hashes of its shingles; A-Z count as lower case."""
        parts = [(t or "").encode() + b"\n" for t in texts]
        flat = np.frombuffer(b"".join(parts), np.uint8)
        if len(self.up) <= len(flat):
            self.up, self.down = _powers(_BASE, len(flat)), _powers(_INVERSE, len(flat))
        word = ~_IS_SPACE[flat]
        edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
        begin, end = edge[::2], edge[1::2]
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_BYTE[flat] * self.up[: len(flat)], out=total[1:])
        hashes = _mix((total[end] - total[begin]) * self.down[begin])
        offsets = np.searchsorted(begin, np.cumsum([0, *map(len, parts)]))
        sums = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
        for i in range(WORDS):
            sums += hashes[i : len(hashes) - WORDS + 1 + i] * _PLACE[i] if len(sums) else sums
        grams = _mix(sums)
        out = []
        for a, z in zip(offsets[:-1], offsets[1:], strict=True):
            if z - a >= WORDS:
                out.append(np.unique(grams[a : z - WORDS + 1]))
            elif z > a:
                out.append(_mix(np.array([(hashes[a:z] * _PLACE[: z - a]).sum(dtype=np.uint64) + np.uint64(z - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def prefix_length(n: int) -> int:
    return n - (LEAST * n + 99) // 100 + 1


def _each(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the sets of their texts, the last of the columns; only a slice's texts are made into strings."""
    shingler = Shingler()
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column(columns[-1])), 0).to_numpy(zero_copy_only=False)
        for a, z in in_lengths(lengths, CHARS):
            part = batch.slice(a, z - a)
            yield part, shingler.sets(part.column(columns[-1]).to_pylist())


def gaps(places: np.ndarray) -> np.ndarray:
    """Ascending places as 16-bit gaps; 0xFFFF adds as much and stands for no place."""
    step = np.diff(places, prepend=0)
    fill = step // 0xFFFF
    out = np.full(len(step) + int(fill.sum()), 0xFFFF, np.uint16)
    out[np.cumsum(fill + 1) - 1] = step % 0xFFFF
    return out


def places_of(packed: pa.BinaryScalar) -> np.ndarray:
    """The places that ``gaps`` packed."""
    step = np.frombuffer(packed.as_buffer(), np.uint16)
    return np.cumsum(step, dtype=np.int64)[step != 0xFFFF]


def counters_for(docs: DataFrame) -> int:
    """Bits of a counter's number: a counter for every shingle, within the bounds, taking four bytes for a word."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, math.ceil(math.log2(max(1, size / 4)))))


def levels(mean: float) -> np.ndarray:
    """For each code of a counter, how frequent its tokens are: 0 if there is one occurrence at most, 1 for the noise of the sketch, then a step for each doubling, from 64 times the noise for each two, up to 15."""
    count = np.exp2(np.arange(256) / 8) - 1
    doublings = np.log2(np.maximum((count - mean) / max(1.5, 2.5 * mean**0.5), 0.5))
    steps = np.where(doublings < 6, 2 + np.floor(doublings), 5 + np.floor(doublings / 2))
    return np.where(count < 1.5, 0, np.clip(steps, 1, 15)).astype(np.uint8)


def level_of(tokens: np.ndarray, packed: np.ndarray, shift: np.uint64) -> np.ndarray:
    """Levels of tokens; two counters share a byte of the sketch, the even one in its low half."""
    place = (tokens >> shift).astype(np.int64)
    return packed[place >> 1] >> ((place & 1) * 4).astype(np.uint8) & 15


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, eight steps for each doubling."""
    return np.round(8 * np.log2(counts + 1.0)).astype(np.uint8)


def sketch(docs: DataFrame, scratch: Scratch) -> tuple[np.ndarray, int]:
    """The levels of the counters, two in a byte, and the shift that takes a token to its counter."""
    bits = counters_for(docs)
    shift, fine = np.uint64(64 - bits), np.uint64(64 - bits - FINE)
    size_of_slice = SLICE << FINE

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for _, sets in _each(batches, "text"):
            waiting += [(s >> fine).astype(np.uint32) for s in sets]
            size += sum(map(len, sets))
            if size > COUNTED:
                yield from packed(np.concatenate(waiting))
                waiting, size = [], 0
        if size:
            yield from packed(np.concatenate(waiting))

    def packed(tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        places, counts = np.unique(tokens, return_counts=True)
        cuts = np.searchsorted(places, np.arange(0, (1 << bits + FINE) + 1, size_of_slice))
        for i in np.flatnonzero(np.diff(cuts)):
            at, n = places[cuts[i] : cuts[i + 1]].astype(np.int64) - i * size_of_slice, counts[cuts[i] : cuts[i + 1]].astype(np.uint32)
            columns = [gaps(at[n == 1]), gaps(at[n > 1]), n[n > 1]]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=["slice", "once", "places", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size_of_slice, np.uint32)
        for batch in batches:
            for once, places, counts in zip(*map(batch.column, ("once", "places", "counts")), strict=True):
                total[places_of(once)] += np.uint32(1)
                total[places_of(places)] += np.frombuffer(counts.as_buffer(), np.uint32)
            number = batch.column("slice")[:1]
        yield pa.RecordBatch.from_arrays([number, pa.array([coded(total.reshape(SLICE, -1).max(1)).tobytes()], pa.binary()), pa.array([int(total.sum(dtype=np.int64))], pa.int64())], names=["slice", "codes", "total"])

    parts = docs.select("text").mapInArrow(count, "slice int, once binary, places binary, counts binary").groupBy("slice").applyInArrow(add, "slice int, codes binary, total long")
    parts = scratch.cut(parts)
    level = levels((parts.agg(F.sum("total")).first()[0] or 0) / (1 << bits + FINE))
    out = np.zeros(1 << (bits - 1), np.uint8)
    for row in parts.select("slice", "codes").toLocalIterator():  # half a byte for each of the counters, 1 << MOST_COUNTERS at most
        some = level[np.frombuffer(bytes(row.codes), np.uint8)]
        out[row.slice * SLICE // 2 : (row.slice + 1) * SLICE // 2] = some[::2] | some[1::2] << 4
    scratch.drop(parts)
    return out, int(shift)


def _keys(sets: list[np.ndarray]) -> list[list[int]]:
    """Two hashes of each set."""
    mixed = [_mix(s + np.uint64(len(s))) for s in sets]
    return [[int(np.bitwise_xor.reduce(m).astype(np.uint64).view(np.int64)) for m in mixed], [int((m * _PLACE[0]).sum(dtype=np.uint64).view(np.int64)) for m in mixed]]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    values = np.concatenate([*parts, np.zeros(0, kind.to_pandas_dtype())])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(values, kind))


def rare_prefix(s: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of the prefix that another document may hold, in order, and how many stand before them; ``rank`` are the levels of the set ``s``."""
    p = prefix_length(len(s))
    order = np.argsort(rank, kind="stable")[:p]
    skip = int((rank[order] == 0).sum())
    return s[order[skip:]].view(np.int64), skip


def signature(s: np.ndarray, order: np.uint64) -> np.ndarray:
    """The prefix under another order, as short hashes: prefixes that share a token share a hash of it."""
    p = prefix_length(len(s))
    x = s * order
    return np.unique((np.partition(x, p - 1)[:p] if p < len(x) else x) >> np.uint64(8)).astype(np.uint16)


def digests(docs: DataFrame, packed: np.ndarray, shift: int) -> DataFrame:
    """Per row: doc_id, n (size of its set), k1 and k2 (hashes of the set), prefix and skip (the rare-first prefix), and its other prefixes as s1 and s2."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # at most 1 << MOST_COUNTERS - 1 bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, by = shared.value, np.uint64(shift)
        for batch, sets in _each(batches, "doc_id", "text"):
            prefixes = [rare_prefix(s, level_of(s, level, by)) if len(s) else (s.view(np.int64), 0) for s in sets]
            short = [[signature(s, o).view(np.int16) if len(s) else np.zeros(0, np.int16) for s in sets] for o in _ORDERS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(k, pa.int64()) for k in _keys(sets)),
                    _lists([p for p, _ in prefixes], pa.int64()), pa.array([k for _, k in prefixes], pa.int32()), *(_lists(x, pa.int16()) for x in short),
                ],
                names=["doc_id", "n", "k1", "k2", "prefix", "skip", "s1", "s2"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, k1 long, k2 long, prefix array<bigint>, skip int, s1 array<smallint>, s2 array<smallint>")


def token_sets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, k1, k2 as in ``digests``, and the whole set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _each(batches, "doc_id", "text"):
            k1, k2 = _keys(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _lists([s.view(np.int64) for s in sets], pa.int64())], names=["doc_id", "k1", "k2", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, tokens array<bigint>")


def _known_small(keys: DataFrame) -> DataFrame:
    """A broadcast hint for a table of ids that was counted and found small; any other is left to a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _with(pairs: DataFrame, values: DataFrame, end: str, *columns: str) -> DataFrame:
    """Columns of the node at one end of each pair, named after that end."""
    return pairs.join(values.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns)), end)


def agreeing(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that share prefix tokens under the other orders too."""
    both = _with(_with(pairs, named, "a", "s1", "s2"), named, "b", "s1", "s2")
    return both.filter(F.arrays_overlap("a_s1", "b_s1") & F.arrays_overlap("a_s2", "b_s2")).select("a", "b")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The similar ones among ``pairs`` (a, b) of nodes.

    Of the classes only those that a pair names are read further, and sets are made anew from the texts of their least
    documents for those pairs alone that all orders agree on. Sets go through one exchange, which both ends are joined from.
    """
    wanted = scratch.cut(_ends(pairs))
    named = scratch.cut(classes.join(_known_small(wanted), "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "k1", "k2", "s1", "s2"))
    agreed = scratch.cut(agreeing(pairs, named))
    reps = scratch.cut(named.join(_ends(agreed), "node", "left_semi").select("node", "doc_id", "k1", "k2"))
    texts = docs.select("doc_id", "text").join(_known_small(reps.select("doc_id")), "doc_id", "left_semi")
    sets = token_sets(texts).join(_known_small(reps), ["doc_id", "k1", "k2"]).dropDuplicates(["node"]).select("node", "tokens")
    both = _with(_with(agreed, sets, "a", "tokens"), sets, "b", "tokens")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    out = scratch.cut(both.filter(100 * common >= LEAST * (F.size("a_tokens") + F.size("b_tokens") - common)).select("a", "b"))
    scratch.drop(wanted, named, agreed, reps)
    return out


def _possible() -> Column:
    """Size and position filters on two postings of one token: sizes n and n2, places pos and pos2 (from 0) in their prefixes."""
    return _fits(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"))


def _fits(n: Column, pos: Column, n2: Column, pos2: Column) -> Column:
    sizes = F.least(n, n2) * 100 >= F.greatest(n, n2) * LEAST
    rest = F.least(n - pos, n2 - pos2)
    return sizes & (rest * (100 + LEAST) >= (n + n2) * LEAST)


def shared_postings(postings: DataFrame) -> DataFrame:
    """Postings of tokens that stand in several classes, and of two classes in a way that the filters let pass."""
    at = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")
    tokens = postings.groupBy("token").agg(F.count("*").alias("c"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    part = lambda c: (F.shiftright(c, 32).cast("int"), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    shared = tokens.filter((F.col("c") > 2) | ((F.col("c") == 2) & _fits(*part("lo"), *part("hi"))))
    return postings.join(shared.select("token"), "token", "left_semi")


def _labelled(postings: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Postings with their components, of tokens that stand in more than one."""
    if parts is None:
        return postings.withColumn("component", F.col("node"))
    named = postings.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
    return named.join(mixed, "token", "left_semi")


def _band() -> Column:
    return F.floor(F.ln("n") / math.log(BAND)).cast("int")


_OTHER = ("node", "n", "pos", "component")


def _outside(postings: DataFrame) -> DataFrame:
    """For each token, its largest component, and how many postings stand outside it."""
    sizes = postings.groupBy("token", "component").agg(F.count("*").alias("c"))
    whole = sizes.groupBy("token").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("c"))
    return whole.select("token", F.col("m.component").alias("largest"), (F.col("c") - F.col("m.c")).alias("outside"))


def _pivots(postings: DataFrame, round_: int) -> DataFrame:
    """Pairs with the pivots of a token and size band, if of another component: a fixed number for each posting at most."""
    families, pivots, least = ROUNDS[round_]
    if least:
        postings = postings.join(_outside(postings).filter(F.col("outside") >= least).select("token"), "token", "left_semi")
    postings = postings.withColumn("band", _band())
    order = Window.partitionBy("token", "band").orderBy(F.xxhash64(F.lit(round_), F.pmod("token", F.lit(families)), "node"), "node")
    first = postings.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= pivots)
    first = first.select("token", "band", *(F.col(c).alias(f"{c}2") for c in _OTHER))
    found = postings.join(first, ["token", "band"]).filter((F.col("component") != F.col("component2")) & _possible())
    return found.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _across(postings: DataFrame) -> DataFrame:
    """All pairs of postings of a token from different components that pass the filters; one at least is outside the token's largest component."""
    postings = postings.withColumn("band", _band()).join(_outside(postings).drop("outside"), "token")
    inside = F.col("component") == F.col("largest")
    left = postings.filter(~inside).drop("largest").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    right = postings.select("token", "band", inside.alias("inside"), *(F.col(c).alias(f"{c}2") for c in _OTHER))
    found = left.join(right, ["token", "band"]).filter((F.col("component") != F.col("component2")) & (F.col("inside") | (F.col("node") < F.col("node2"))) & _possible())
    return found.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for each row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.cut(digests(docs, *sketch(docs, scratch)).withColumn("row", F.monotonically_increasing_id()))
    linked = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    same = [F.first(c).alias(c) for c in ("n", "skip", "prefix", "s1", "s2")]
    classes = scratch.cut(linked.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), *same))
    shared = scratch.cut(shared_postings(classes.select("node", "n", "skip", F.posexplode("prefix").alias("at", "token")).select("token", "node", "n", (F.col("skip") + F.col("at")).alias("pos"))))
    of_row = linked.select("doc_id", "k1", "k2").join(classes.select("k1", "k2", "node"), ["k1", "k2"]).select("doc_id", "node")
    least = of_row.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a")
    links = scratch.cut(of_row.join(least, "doc_id").filter("a < node").select("a", F.col("node").alias("b")).distinct())
    parts = None if links.isEmpty() else connected_components(links, scratch)
    for round_ in range(0 if shared.isEmpty() else len(ROUNDS) + 1):
        labelled = _labelled(shared, parts)
        pairs = scratch.cut(_pivots(labelled, round_) if round_ < len(ROUNDS) else _across(labelled))
        if pairs.isEmpty():
            continue
        found = verify(pairs, classes, docs, scratch)
        scratch.drop(pairs)
        if not found.isEmpty():
            parts = connected_components(found, scratch) if parts is None else merged_components(parts, found, scratch)
        scratch.drop(found)
    scratch.drop(shared)
    named = classes.select("k1", "k2", "node", "rep")
    named = named.withColumn("component", F.col("node")) if parts is None else named.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(label, "component").select("k1", "k2", "component_id")
    out = rows.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    known = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(known, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op8_ngram_jaccard": op8_ngram_jaccard}
SQL: dict[str, str] = {}
