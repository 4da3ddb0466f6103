"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed against it into the longest phrases
that occur in that language's text; the language that needs the fewest phrases, each weighted by log2 of the length it
was drawn from, wins. All lanes of a slice of texts walk the automata of up to ``GROUP`` languages together through one dense
transition table; with more languages, one group after another, so that one such table is in memory at a time.

Texts are lower-cased and mapped to bytes; ASCII characters other than letters collapse to one separator. A whole text
is one parse, whatever its length. To walk a long text in parallel it is cut into lanes of ``LANE`` bytes, each first walked
from the start state; then lanes whose predecessor ended in another state are walked again from that state, until both
walks stand in the same state (after which they agree), and so on until no lane's end changes. Phrases are thus the same as
in one walk from the text's first byte, and lanes are a matter of speed alone.

The automata are fitted on a bounded sample: at most ``DOCS_PER_LANGUAGE`` documents of the training folds per language
(those of smallest id hash), ``CHARS_PER_DOC`` characters of each, ``BYTES_PER_LANGUAGE`` in all, for every label value.
Predictions see the text alone.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything if nothing was learned.
Ties go to the name first in order, with score 0. Texts of any length are parsed whole. Rows are judged one by one; repeated
rows and nulls elsewhere don't matter. Extra columns pass through, but for those named ``lang_pred`` or ``score``, which are
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import fold_key, in_batches, read

DOCS_PER_LANGUAGE = 100
CHARS_PER_DOC = 2_000
BYTES_PER_LANGUAGE = 24_000
#: Languages whose automata stand in one table.
GROUP = 32
LANE = 512
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[:128] = [b if 97 <= b <= 122 else 32 for b in range(128)]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, runs of other ASCII characters as one space, and the offset of each text."""
    parts = [t.lower().encode() for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = _LOWER[np.frombuffer(b"".join(parts), np.uint8)]
    keep = np.ones(len(flat), bool)
    if len(flat):
        keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32)
        keep[offsets[:-1][offsets[:-1] < len(flat)]] = True
    kept = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return flat[keep], kept[offsets]


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts all substrings of ``data``; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Model:
    """The languages' automata, as edges; ``table[(base + state) * width + symbol]`` of a group's table is the next state, ``END`` where the phrase ends.

    An automaton has fewer than 2 * BYTES_PER_LANGUAGE states, so that 16 bits hold one.
    """

    END = 0xFFFF

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        self.weights = np.array([np.log2(max(2, len(samples[x]))) for x in self.languages])
        used = sorted({b for s in samples.values() for b in s})
        self.width = len(used) + 1
        self.symbol = np.zeros(256, np.uint8)
        for i, b in enumerate(used):
            self.symbol[b] = i + 1
        #: Of each language: number of states, places of its edges in a table of its own, and where they lead.
        self.automata = []
        for x in self.languages:
            step = suffix_automaton(samples[x])
            at = np.array([s * self.width + int(self.symbol[b]) for s, edges in enumerate(step) for b in edges], np.int32)
            self.automata.append((len(step), at, np.array([t for edges in step for t in edges.values()], np.uint16)))
        #: From the start: next state, or the start itself for a symbol that the language lacks (a phrase of its own).
        self.restart = np.zeros((len(self.languages), self.width), np.int32)
        for line, (_, at, to) in zip(self.restart, self.automata, strict=True):
            first = at < self.width
            line[at[first]] = to[first]
        self._group: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_group": None}

    def _table(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Dense table and bases of the group of languages from ``first`` on; the last one used is kept."""
        if self._group is None or self._group[0] != first:
            self._group = None
            group = self.automata[first : first + GROUP]
            bases = np.cumsum([0, *(n for n, _, _ in group)]) * self.width
            table = np.full(bases[-1], self.END, np.uint16)
            for base, (_, at, to) in zip(bases, group, strict=False):
                table[base + at] = to
            self._group = (first, table, bases[:-1].astype(np.int32)[:, None])
        return self._group[1:]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases needed by each text in each language."""
        flat, offsets = symbols(texts)
        coded = self.symbol[flat]
        lanes = (np.diff(offsets) + LANE - 1) // LANE
        owner = np.repeat(np.arange(len(texts)), lanes)
        number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = offsets[owner] + number * LANE
        length = np.minimum(LANE, offsets[owner + 1] - start)
        order = np.argsort(-length, kind="stable")
        place = np.argsort(order)
        follows = np.where(number[order] > 0, place[order - 1], -1)  # the lane before, in the new order
        start, length, owner = start[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(1, LANE + 1), side="right")
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for first in range(0, len(self.languages), GROUP):
            table, bases = self._table(first)
            restart = self.restart[first : first + GROUP]
            counts = np.zeros((len(bases), len(start)), np.int32)
            state = np.zeros((len(bases), len(start)), np.int32)
            for t in range(LANE):
                m = active[t]
                if m == 0:
                    break
                c = coded[start[:m] + t]
                after = table.take(state[:, :m] * self.width + bases + c).astype(np.int32)
                ended = after == self.END
                counts[:, :m] += ended | (state[:, :m] == 0)  # a phrase begins where one ended, or after a symbol of no phrase
                np.copyto(after, restart[:, c], where=ended)
                state[:, :m] = after
            self._joined(coded, start, length, follows, table, bases[:, 0], restart, counts, state)
            np.add.at(out[:, first : first + GROUP], owner, counts.T)
        return out

    def _joined(self, coded, start, length, follows, table, bases, restart, counts, state) -> None:  # noqa: ANN001
        """Mend ``counts`` and the end states of lanes that go on from another state than the start, in place."""
        entered = np.zeros_like(state)
        later = np.flatnonzero(follows >= 0)
        while True:
            wanted = state[:, follows[later]]
            language, at = np.nonzero(wanted != entered[:, later])
            if not len(at):
                return
            lane = later[at]
            old, new = entered[language, lane], wanted[language, at]
            entered[language, lane] = new
            for t in range(LANE):
                here = t < length[lane]
                if not here.all():  # the new walk reached the end of its lane
                    done = ~here
                    state[language[done], lane[done]] = new[done]
                here &= old != new
                language, lane, old, new = language[here], lane[here], old[here], new[here]
                if not len(lane):
                    break
                c = coded[start[lane] + t]
                after = []
                for walk, sign in ((old, -1), (new, 1)):
                    to = table.take(walk * self.width + bases[language] + c).astype(np.int32)
                    ended = to == self.END
                    np.add.at(counts, (language, lane), sign * (ended | (walk == 0)))
                    after.append(np.where(ended, restart[language, c], to))
                old, new = after
            else:
                state[language, lane] = new

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        told = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if told:
            cost = self.phrases([texts[i] for i in told]) * self.weights
            best = cost.argmin(1)
            ranked = np.sort(cost, 1)
            margin = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-9) if len(self.languages) > 1 else np.ones(len(told))
            for i, b, s in zip(told, best, margin, strict=True):
                names[i], scores[i] = self.languages[b], float(min(1.0, max(0.0, s)))
        return names, scores


def training_rows(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """The bounded sample: (lang, part) of documents outside the held-out fold."""
    rows = docs.filter((fold_key("doc_id") % folds != fold) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.substring("text", 1, CHARS_PER_DOC).alias("part"), F.xxhash64("doc_id").alias("h"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).filter(F.col("r") <= DOCS_PER_LANGUAGE)
    return ranked.select("lang", "r", "part")


def fit(docs: DataFrame) -> Model:
    parts: dict[str, list[str]] = defaultdict(list)
    for row in sorted(training_rows(docs).collect()):
        parts[row.lang].append(row.part)
    return Model({x: symbols([" ".join(p)])[0].tobytes()[:BYTES_PER_LANGUAGE] for x, p in parts.items()})


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, in place of columns so named; all others pass through."""
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)  # for each language, at most 3 * BYTES_PER_LANGUAGE edges of 6 bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            names: list[str] = []
            scores: list[float] = []
            for a, z in in_batches(texts):
                n, s = shared.value.predict(texts[a:z])
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    judged = identify(docs.select("doc_id", "text"), fit(docs))
    return judged.select("doc_id", F.coalesce(fold_key("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
SQL: dict[str, str] = {}
