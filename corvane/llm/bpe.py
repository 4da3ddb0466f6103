"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a slice of the corpus are laid out as one sequence of symbols. An inverted index from merge
rank to the positions of its pair is kept beside it, and merges are applied in rank order: each takes its positions from
the index, and only the two neighbours of a merged pair get new entries. A document's ids are then the concatenation of
its pre-tokens' ids, so a pre-token is encoded once however often it occurs. Slices are worked on by mappers; no row is
shuffled, and the ids of recent pre-tokens are kept from slice to slice in a bounded table.

Defined results: null and empty texts have no ids and decode to no bytes. Repeated rows give repeated results; nulls in
other columns don't matter, and extra columns pass through, but for those named ``n_tokens``, ``ids`` or ``decoded``, which
are replaced; an empty table gives an empty result. A text of any length is encoded whole. Of equal pairs in a word the
leftmost merges first.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import in_batches, read

#: Pre-tokens whose ids a worker keeps; beyond it the table starts anew (a matter of speed alone).
KEPT_WORDS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks of byte strings; a merge of two tokens has the rank of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}

    def merged(self, a: int, b: int) -> int:
        """Rank of the merge of tokens a and b, -1 if there is none."""
        key = a << 32 | b
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.pairs[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return rank

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by replaying the merges over all of them at once."""
        symbols: list[int] = []
        after: list[int] = []
        before: list[int] = []
        pair: list[int] = []
        starts: list[int] = []
        index: dict[int, list[int]] = {}
        merged, single = self.merged, self.single
        for word in words:
            p = len(symbols)
            starts.append(p)
            n = len(word)
            ids = [single[b] for b in word]
            symbols += ids
            after += range(p + 1, p + n)
            after.append(-1)
            before.append(-1)
            before += range(p, p + n - 1)
            for i in range(n - 1):
                r = merged(ids[i], ids[i + 1])
                pair.append(r)
                if r >= 0:
                    if r in index:
                        index[r].append(p + i)
                    else:
                        index[r] = [p + i]
            pair.append(-1)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if not places:
                continue
            places.sort()
            for k, p in enumerate(places):
                if pair[p] != rank:
                    continue
                q = after[p]
                n = after[q]
                symbols[p] = rank
                pair[q] = -1
                after[p] = n
                lower = False
                if n >= 0:
                    before[n] = p
                    r = pair[p] = merged(rank, symbols[n])
                    if r >= 0:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heapq.heappush(heap, r)
                        lower = r < rank
                else:
                    pair[p] = -1
                b = before[p]
                if b >= 0:
                    r = pair[b] = merged(symbols[b], rank)
                    if r >= 0:
                        if r in index:
                            index[r].append(b)
                        else:
                            index[r] = [b]
                            heapq.heappush(heap, r)
                        lower = lower or r < rank
                if lower or rank in index:  # what is new comes first, or stands among the rest
                    rest = places[k + 1 :] + index.pop(rank, [])
                    if rest:
                        index[rank] = rest
                        heapq.heappush(heap, rank)
                    break
        out = []
        for p in starts:
            ids = []
            while p >= 0:
                ids.append(symbols[p])
                p = after[p]
            out.append(ids)
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.find(t) if t else [] for t in texts]
        new = list({w for ws in pieces for w in ws} - self.known.keys())
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known = {}
            new = list({w for ws in pieces for w in ws})
        ranks, rest, raw = self.vocabulary.ranks, [], []
        for w in new:
            b = w.encode()
            if (i := ranks.get(b)) is not None:
                self.known[w] = i.to_bytes(4, "little")
            else:
                rest.append(w)
                raw.append(b)
        for w, ids in zip(rest, self.vocabulary.replay(raw), strict=True):
            self.known[w] = np.array(ids, "<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (binary); other columns stay."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary file, whatever the corpus
    df = df.drop(*(c for c in ("n_tokens", "ids", "decoded") if c != text))
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (id(shared.value), pattern)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value, pattern)
        encoder = _ENCODERS[key]
        for batch in batches:
            texts = batch.column(text)
            for a, z in _slices(texts):
                ids = encoder.encode_all(texts.slice(a, z - a).to_pylist())
                columns = [batch.column(c).slice(a, z - a) for c in rest]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.binary())],
                    names=[*rest, "n_tokens", "ids", "decoded"],
                )

    return df.mapInArrow(run, schema)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    return in_batches(texts.to_pylist())


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded bytes."""
    coded = encode(docs.select("doc_id", "text"), load_ranks(path), pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
SQL: dict[str, str] = {}
