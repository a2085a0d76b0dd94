"""Packing in order: dynamic programming chooses where to cut the stream of documents into sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import documents, per_worker
from crosstide.llm.packing import END_ID, WordTokenizer

LIMIT = 2048
#: What a cut costs, in tokens of padding: between sentences, and inside one. Between documents it is free.
SENTENCE_CUT, INNER_CUT = 16, 96
#: What a sequence costs besides its padding, so that short ones of a length that needs none don't abound.
PER_SEQUENCE = 2
#: Tokens between the places inside a sentence where a cut is considered.
STRIDE = 64
#: Tokens that are planned together, and sequences at their end that are planned again with what follows.
STRETCH, AGAIN = 1 << 19, 8
_STOP = re.compile(r"[.!?]+['\")\]]*</w>")


class SentenceEnds:
    """Where the sentences of a text end, told by its token ids: after a token of stops that no digit follows."""

    def __init__(self, vocabulary: dict[str, int]):
        size = max(vocabulary.values(), default=0) + 1
        self.stop, self.digit = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocabulary.items():
            self.stop[i] = bool(_STOP.fullmatch(token))
            self.digit[i] = token[:1].isdigit()

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """Number of tokens up to the end of each sentence but the last."""
        return np.flatnonzero(self.stop[ids[:-1]] & ~self.digit[ids[1:]]) + 1


def cut_places(n: int, ends: np.ndarray, stride: int = STRIDE, sentence_cut: int = SENTENCE_CUT, inner_cut: int = INNER_CUT) -> tuple[np.ndarray, np.ndarray]:
    """Places in a document of ``n`` tokens where it may be cut, ascending, the last being its end, and what each cut costs."""
    bounds = np.unique(np.concatenate(([0], ends[(ends > 0) & (ends < n)], [n])))
    gaps = np.diff(bounds)
    long = np.flatnonzero(gaps > stride)
    inner = [np.arange(bounds[i] + stride, bounds[i + 1], stride) for i in long]
    places = np.concatenate((bounds[1:], *inner))
    costs = np.full(len(places), inner_cut, np.int64)
    costs[: len(bounds) - 1] = sentence_cut
    costs[len(bounds) - 2] = 0
    order = np.argsort(places, kind="stable")
    return places[order], costs[order]


def plan_cuts(places: np.ndarray, costs: np.ndarray, limit: int = LIMIT, per_sequence: int = PER_SEQUENCE) -> tuple[list[int], int]:
    """The cheapest way to cut a stream that starts at 0 and ends at the last place: indices of the cuts, total cost.

    A sequence from one cut to a later one, at most ``limit`` tokens on, costs what it lacks to
    ``limit``, nothing where its length is a power of two, plus ``per_sequence`` and the cost of the cut at its end. The
    padding is linear in both ends, so the best start is the smallest of cost + place among those
    within ``limit``, the head of a queue whose values increase: each place enters and
    leaves it once. Starts exactly a power of two before are looked up besides. Places
    must ascend and lie no further than ``limit`` apart; of equal ways the one with the longest last sequence is taken.
    """
    pos = np.concatenate(([0], places)).astype(np.int64)
    m = len(pos)
    index = np.full(int(pos[-1]) + 1, -1, np.int64)
    index[pos] = np.arange(m)
    later, earlier = [], []
    for k in range(limit.bit_length()):
        j = np.flatnonzero(pos >= 1 << k)
        i = index[pos[j] - (1 << k)]
        later.append(j[i >= 0])
        earlier.append(i[i >= 0])
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    starts = np.searchsorted(np.sort(later), np.arange(m + 1)).tolist()
    earlier = earlier[np.argsort(later, kind="stable")].tolist()
    at, cut = pos.tolist(), [0, *costs.tolist()]
    cost, level, via = [0] * m, [0] * m, [0] * m
    queue, head = [0], 0
    for j in range(1, m):
        p = at[j]
        while at[queue[head]] < p - limit:
            head += 1
        i = queue[head]
        best = level[i] + limit - p
        for e in earlier[starts[j] : starts[j + 1]]:
            if cost[e] < best:
                best, i = cost[e], e
        best += cut[j] + per_sequence
        cost[j], via[j] = best, i
        best += p
        level[j] = best
        while len(queue) > head and level[queue[-1]] > best:
            queue.pop()
        queue.append(j)
    chosen, j = [], m - 1
    while j:
        chosen.append(j - 1)
        j = via[j]
    return chosen[::-1], cost[-1]


class _Stream:
    """Documents of one task in their order, cut into sequences as soon as enough of them are there."""

    def __init__(self, part: int, limit: int, stretch: int):
        self.limit, self.stretch = limit, stretch
        self.docs: list[tuple[object, bytes, int, int]] = []  # id, token ids, tokens, tokens that have gone
        self.places: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.size = 0
        self.sequence = part << 40
        self.rows: list[tuple] = []

    def add(self, ident: object, ids: bytes, places: np.ndarray, costs: np.ndarray) -> None:
        n = len(ids) // 4
        self.docs.append((ident, ids, n, 0))
        self.places.append(places + self.size)
        self.costs.append(costs)
        self.size += n
        if self.size >= self.stretch:
            self.cut(self.size - AGAIN * self.limit)

    def cut(self, upto: int) -> None:
        """Plans all that is here and settles the sequences that end at ``upto`` or before; the rest stays."""
        if not self.docs:
            return
        places, costs = np.concatenate(self.places), np.concatenate(self.costs)
        if upto >= self.size:  # the end of the stream: a cut anywhere in the last two sequences is considered
            tail = np.setdiff1d(np.arange(max(1, self.size - 2 * self.limit), self.size), places)
            order = np.argsort(np.concatenate((places, tail)), kind="stable")
            places, costs = np.concatenate((places, tail))[order], np.concatenate((costs, np.full(len(tail), INNER_CUT)))[order]
        cuts = [int(places[i]) for i in plan_cuts(places, costs, self.limit)[0]]
        start, k, base = 0, 0, 0  # base: where document k begins
        for end in cuts:
            if end > upto:
                break
            at = start
            while at < end:
                ident, ids, n, gone = self.docs[k]
                stop = min(end, base + n - gone)
                first, length = gone + at - base, stop - at
                crc = zlib.crc32(ids[4 * first : 4 * (first + length)])
                self.rows.append((ident, first, length, crc, n, self.sequence, at - start))
                at = stop
                if at == base + n - gone:
                    base, k = at, k + 1
            self.sequence += 1
            start = end
        self.docs = self.docs[k:]
        if self.docs and start > base:
            ident, ids, n, gone = self.docs[0]
            self.docs[0] = (ident, ids, n, gone + start - base)
        keep = places > start
        self.places, self.costs, self.size = [places[keep] - start], [costs[keep]], self.size - start

    def taken(self) -> tuple[list, np.ndarray]:
        ids, numbers = [r[0] for r in self.rows], np.array([r[1:] for r in self.rows], np.int64).reshape(-1, 6)
        self.rows = []
        return ids, numbers


def pack_in_order(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID, stretch: int = STRETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts the documents of each partition, in their order, into sequences of at most ``limit`` tokens: one row per piece.

    Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document is its ids and then
    ``end_id``. Cuts lie between documents, between sentences or, where a sentence is long and in the last two
    sequences of a partition, inside one; :func:`plan_cuts` chooses them so that padding and what the cuts cost
    are least together. A task plans ``stretch`` tokens at a time and keeps the last few sequences open for what
    follows, so it holds a stretch (or one document that is longer), whatever the corpus, and nothing is shuffled; a
    partition ends with one sequence that may be padded. A lost task is done again from its input with the same result.

    Null text counts as empty: a document of one token. Rows that repeat are documents of their own. An empty table
    returns no rows.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = per_worker(("words", tokenizer_path), lambda: WordTokenizer(tokenizer_path))
        ends = per_worker(("sentences", tokenizer_path), lambda: SentenceEnds(tokenizer.tokenizer.get_vocab()))
        stream, id_type = _Stream(TaskContext.get().partitionId(), limit, stretch), None
        end = np.array([end_id], "<u4").tobytes()

        def out() -> pa.RecordBatch:
            ids, numbers = stream.taken()
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, numbers.T.copy())], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 200):
                texts = [t or "" for t in batch.column(1).slice(i, 200).to_pylist()]
                for ident, ids in zip(batch.column(0).slice(i, 200).to_pylist(), tokenizer.encode(texts)):
                    found = np.frombuffer(ids, "<u4")
                    stream.add(ident, ids + end, *cut_places(len(found) + 1, ends(found)))
                if len(stream.rows) >= 10_000:
                    yield out()
        if id_type is not None:
            stream.cut(stream.size)
            yield out()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(run, f"id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)


def op13_ordered_packing(spark, sf_dir) -> DataFrame:
    """All documents packed in order; see :func:`pack_in_order` for the edge cases."""
    import public_tokenizers

    return pack_in_order(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
