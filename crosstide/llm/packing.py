"""Packing of tokenised documents into sequences: dominance reduction, then best fit."""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.llm.common import documents, per_worker
from crosstide.session import reliable_checkpoint

LIMIT = 4096
END_ID = 1
#: Words a worker keeps the ids of at most.
CACHE = 1_000_000


class WordTokenizer:
    """Ids of whole texts from a lower-casing byte-level BPE that drops white space and never looks across it.

    A text is cut at white space and each distinct chunk is encoded once for as long as it stays
    in the cache. A plain word, of ASCII and Latin-1 letters with at most one stop or comma
    after them, goes straight to the merges; any other chunk goes through the whole
    tokenizer. Texts with control characters that only Python takes for white space, or
    with the tokenizer's special strings, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(128, 256) if chr(i).isalpha()}
        self.stops = dict(zip(["", ".", ","], [b"", *self._whole([".", ","])]))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of new chunks into the cache."""
        cache, other = self.cache, []
        for word in words:
            stem, stop = (word[:-1], word[-1]) if word[-1] in ".," else (word, "")
            if not stem.isalpha() or not (stem.isascii() or max(stem) < "\u0100"):
                other.append(word)
                continue
            stem = stem.lower()
            ids = cache.get(stem)
            if ids is None:
                tokens = self.model.tokenize(stem if stem.isascii() else stem.translate(self.letters))
                ids = cache[stem] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            cache[word] = ids + self.stops[stop]
        for i in range(0, len(other), 2_000):
            cache.update(zip(other[i : i + 2_000], self._whole(other[i : i + 2_000])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") or "<|" in t for t in texts]
        words = [[] if o else _lower(t).split() for t, o in zip(texts, odd)]
        new = set(chain.from_iterable(words)).difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = set(chain.from_iterable(words))
        self._learn(new)
        ids_of = self.cache.__getitem__
        return [self._whole([t])[0] if o else b"".join(map(ids_of, w)) for t, o, w in zip(texts, odd, words)]


def _lower(text: str) -> str:
    """Lower case where that maps each character to one, as the tokenizer does; other texts as they are."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def reduce_dominated(counts: dict[int, int], limit: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction of a bin-packing instance given as counts of item lengths.

    From the largest length down, a set holding it and at most two more items is fixed for good
    where it dominates every other feasible set: alone, if nothing fits beside it; with
    the largest fitting item, if that fills the bin or if no two items fit beside it; and, if two
    fit but no three, with the largest fitting item when that is at least as long as the
    best pair together, or with it and its best partner when no feasible pair has a longer
    shorter item. Taking items away never makes another set feasible, so all copies are
    fixed at once. Returns the fixed sets with their multiplicities and the counts that
    are left. The work depends on the number of distinct lengths, not of documents.
    """
    left = Counter({l: n for l, n in counts.items() if n > 0})
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(items: tuple[int, ...]) -> None:
        held = Counter(items)
        times = min(left[l] // n for l, n in held.items())
        fixed.append((items, times))
        for l, n in held.items():
            left[l] -= times * n
            if not left[l]:
                del left[l]

    for big in sorted(counts, reverse=True):
        while left.get(big, 0) > 0:
            room = limit - big
            avail = sorted(left)
            spare = {l: left[l] - (l == big) for l in avail}  # copies besides the one that is placed
            small, k = [], 0
            for l in avail:
                small += [l] * min(3, spare[l])
                if len(small) >= 3:
                    break
            while k < min(3, len(small)) and sum(small[: k + 1]) <= room:
                k += 1
            if k == 0:
                take((big,))
                continue
            fit = max(l for l in avail if l <= room and spare[l] > 0)
            if fit == room or k == 1:
                take((big, fit))
                continue
            if k == 2:
                best, least = 0, 0  # of two items within the room: the largest sum, the largest shorter one
                for l in avail:
                    if spare[l] and (other := max((x for x in avail if l <= x <= room - l and spare[x] > (x == l)), default=0)):
                        best, least = max(best, l + other), max(least, l)
                second = max((l for l in avail if l <= room - fit and spare[l] > (l == fit)), default=0)
                if fit >= best:
                    take((big, fit))
                    continue
                if second and second == least:
                    take((big, fit, second))
                    continue
            break
    return fixed, dict(left)


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts of lengths; bins with equal contents are handled as one group.

    The longest items go first, each into the fullest bin that takes it. Filling the fullest
    bin makes it fuller still, so it takes as many items of this length as fit before
    the next bin is touched; only the last bin of a length may take fewer. Groups thus
    split at most once a length, and the work depends on lengths alone.
    """
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for room in [r for r in sorted(groups) if r >= length]:
            if not n:
                break
            for items, times in groups.pop(room):
                q = room // length
                full = min(times, n // q)
                n -= full * q
                rest = times - full
                if full:
                    groups.setdefault(room - q * length, []).append((items + (length,) * q, full))
                if rest and n:
                    groups.setdefault(room - n * length, []).append((items + (length,) * n, 1))
                    n, rest = 0, rest - 1
                if rest:
                    groups.setdefault(room, []).append((items, rest))
        q = limit // length
        if n // q:
            groups.setdefault(limit - q * length, []).append(((length,) * q, n // q))
        if n % q:
            groups.setdefault(limit - (n % q) * length, []).append(((length,) * (n % q), 1))
    return [g for gs in groups.values() for g in gs]


def plan_bins(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Contents of the sequences and how many there are of each: fixed sets first, then best fit for the rest."""
    fixed, left = reduce_dominated(counts, limit)
    return fixed + best_fit(left, limit)


def slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Where the n-th piece of a length goes: by length, rows (first n, pieces a sequence, first sequence, first offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter[int] = Counter()
    base = 0
    for items, times in bins:
        offset = 0
        for length, q in sorted(Counter(items).items(), reverse=True):
            out.setdefault(length, []).append((used[length], q, base, offset))
            used[length] += times * q
            offset += length * q
        base += times
    return {l: np.array(rows, dtype=np.int64) for l, rows in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``limit`` tokens: one row per piece.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset. A document is its
    ids and then ``end_id``; only longer ones are cut. The texts are read once; what is kept
    of a piece are a few numbers, written to the checkpoint folder. The packing itself works on
    the count of pieces per length, at most ``limit`` numbers whatever the size of the
    corpus, and yields a table of places per length; pieces of a length are numbered without
    ordering them anywhere: each written partition has numbered its own, and the totals of
    the partitions before it are added. So no task sees more than its partition.

    Null text counts as empty: a document of one token. Rows that repeat are documents of their
    own. An empty table returns no rows.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = per_worker(("words", tokenizer_path), lambda: WordTokenizer(tokenizer_path))
        part = TaskContext.get().partitionId()
        numbers: Counter[int] = Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            slices = (batch.column(1).slice(i, 200).to_pylist() for i in range(0, batch.num_rows, 200))
            for row, ids in enumerate(chain.from_iterable(tokenizer.encode([t or "" for t in texts]) for texts in slices)):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, limit)):
                    stop = min(n, start + limit)
                    length = stop - start
                    rows.append((row, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), numbers[length]))
                    numbers[length] += 1
            row, *cols = np.array(rows, np.int64).reshape(-1, 6).T
            arrays = [batch.column(0).take(pa.array(row)), *map(pa.array, cols), pa.array(np.full(len(row), part))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "number", "part"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut = reliable_checkpoint(
        rows.mapInArrow(pieces, f"id {kind}, piece long, start long, length long, ids_crc32 long, number long, part long")
    )
    per_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = slots(plan_bins(counts, limit))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = cut.join(offsets, ["part", "length"]).select(
        "id", F.col("piece").cast("int"), "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number")
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for l in np.unique(length):
                rows = np.flatnonzero(length == l)
                table = place[int(l)]
                first, q, base, start = table[np.searchsorted(table[:, 0], number[rows], side="right") - 1].T
                ahead = number[rows] - first
                sequence[rows] = base + ahead // q
                offset[rows] = start + ahead % q * l
            names = [*batch.schema.names[:-1], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names)

    out = numbered.mapInArrow(assign, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op6_best_fit_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
