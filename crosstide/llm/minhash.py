"""Near duplicates: circulant MinHash, banding, and exact Jaccard confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import documents
from crosstide.llm.components import connected_components
from crosstide.session import reliable_checkpoint

#: Coordinates per band. The number of bands follows from the threshold and MISS.
BAND_ROWS = 5
#: Chance, at most, that a pair exactly at the threshold shares no band.
MISS = 1e-6
#: Word hashes a worker keeps at most.
CACHE = 500_000
#: Rows per side of one comparison block.
BLOCK = 512


class _Words(dict):
    """64-bit hash of each word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Distinct hashed word shingles of a text: words are runs of anything but ASCII white space, A-Z lower-cased.

    A text of fewer than ``words`` words is one shingle; without words it has none.
    """

    def __init__(self, words: int):
        self.words, self.known = words, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().lower().split()  # bytes: only ASCII is lower-cased and split at
        if not found:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for j in range(n):
            h = _mix(h + w[j : len(w) - n + 1 + j])
        return np.unique(h)


class CirculantMinHash:
    """Signatures from two permutations of the 32-bit numbers.

    The first scatters the shingles; the second, shifted circularly by k, gives coordinate
    k: the smallest value of second(first(shingle) - k) over the set. No third permutation is
    drawn, however many coordinates there are.
    """

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.shifts = np.arange(bands * rows, dtype=np.uint32)[:, None]
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        first = ((shingles * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.shifts), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(first), 256):
            x = first[i : i + 256] - self.shifts
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x7FEB352D)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x846CA68B)
            np.minimum(low, x.min(axis=1), out=low)
        return low

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; equal keys of a band mean equal coordinates."""
        key = self.salt.copy()
        for column in self.signature(shingles).reshape(self.bands, self.rows).T:
            key = _mix(key + column)
        return key.view(np.int64)


def bands_for(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """id, set size, 128-bit hash of the set (null if empty) and band keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, minhash = Shingler(words), CirculantMinHash(bands, rows)
        none = np.empty(0, np.int64)
        for batch in batches:
            sizes, h1, h2, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle(text)
                sizes.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes())
                h1.append(int.from_bytes(digest[:8], "little", signed=True) if len(s) else None)
                h2.append(int.from_bytes(digest[8:], "little", signed=True) if len(s) else None)
                keys.append(minhash.band_keys(s) if len(s) else none)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "h1", "h2", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, h1 long, h2 long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sets = [shingle(text).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, s array<long>")


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """Smallest index linked to each of n indices."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[pairs[0]], low[pairs[1]])
        np.minimum.at(low, pairs[0], m)
        np.minimum.at(low, pairs[1], m)
        low = low[low]
        if (low == before).all():
            return low


def _within_stars(deltas: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between members of a star that its centre does not already give.

    Members that link to the centre are connected. What is left are pairs with a member
    that does not. Both members carry their difference from the same centre, so the
    overlap of their whole sets follows from that of the differences. A star is dealt into
    blocks of about ``block`` members; a task compares one block of unlinked members with one
    block of all, and returns no more links than it has rows.
    """
    sizes = deltas.groupBy("c").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("linked")).alias("apart")).filter("apart > 0 and all > 1")
    placed = deltas.join(sizes, "c").select(
        "*", F.ceil(F.col("all") / block).cast("int").alias("cols"), F.ceil(F.col("apart") / block).cast("int").alias("lines")
    )
    h = F.xxhash64("x")
    fields = ["c", "x", "nc", "plus", "minus"]

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one(n: str) -> Column:
        return F.pmod(h, F.col(n)).cast("int")

    member = placed.select(*fields, F.lit(False).alias("seeks"), each("lines").alias("i"), one("cols").alias("j"))
    seeker = placed.filter("not linked").select(*fields, F.lit(True).alias("seeks"), one("lines").alias("i"), each("cols").alias("j"))

    def matrix(rows: list[np.ndarray], first: int, last: int, vocabulary: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), last - first), np.float32)
        for k, values in enumerate(rows):
            at = np.searchsorted(vocabulary[first:last], values)
            hit = at < last - first
            hit[hit] = vocabulary[first:last][at[hit]] == values[hit]
            out[k, at[hit]] = 1
        return out

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        seeks = group["seeks"].to_numpy()
        a, b = group[seeks], group[~seeks]
        out = pd.DataFrame({"a": group["x"].iloc[:0], "b": group["x"].iloc[:0]})
        if not len(a) or not len(b):
            return out
        nc = int(group["nc"].iloc[0])
        rows = [[np.concatenate((p, m)) for p, m in zip(side["plus"], side["minus"])] for side in (a, b)]
        vocabulary = np.intersect1d(np.concatenate(rows[0]), np.concatenate(rows[1]))
        shared = np.zeros((len(a), len(b)), np.float32)
        for i in range(0, len(vocabulary), 4096):
            j = min(len(vocabulary), i + 4096)
            shared += matrix(rows[0], i, j, vocabulary) @ matrix(rows[1], i, j, vocabulary).T
        plus = [side["plus"].map(len).to_numpy() for side in (a, b)]
        minus = [side["minus"].map(len).to_numpy() for side in (a, b)]
        both = nc - minus[0][:, None] - minus[1][None, :] + shared.astype(np.int64)
        union = (nc - minus[0] + plus[0])[:, None] + (nc - minus[1] + plus[1])[None, :] - both
        ids = np.concatenate((a["x"].to_numpy(), b["x"].to_numpy()))
        left, right = np.nonzero(100 * both >= percent * union)
        names, index = np.unique(ids, return_inverse=True)
        pairs = np.array([index[left], index[len(a) + right]])
        roots = _roots(pairs, len(names))
        moved = np.flatnonzero(roots != np.arange(len(names)))
        return pd.DataFrame({"a": names[moved], "b": names[roots[moved]]})

    kind = deltas.schema["x"].dataType.simpleString()
    # the blocks of a star are dealt one by one: left to the joins before, all would go by ``c`` to one task
    return member.unionByName(seeker).repartition("c", "i", "j").groupBy("c", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rows: int = BAND_ROWS, miss: float = MISS, block: int = BLOCK
) -> DataFrame:
    """Near-duplicate components of whole texts: id, n_shingles, component_id, kept.

    Two documents are linked when 100 * shared >= percent * united distinct shingles of
    ``words`` words. Equal sets are one class, named by its smallest id, from the start.
    Classes that share a band key are candidates; as many bands are drawn as keep the
    chance of missing a pair at the threshold below ``miss``. Each bucket is a star around its
    smallest class: every member is confirmed against the centre on whole sets, so a
    bucket of n classes costs n comparisons. Pairs of members which the centre leaves open
    are compared in blocks (see :func:`_within_stars`). No candidate is dropped, and no task
    holds a whole bucket.

    Null text, and text without words, has no shingles and is linked with nothing. Rows that
    share an id are one vertex, whose texts are linked. A row without an id is never linked: its component is null and
    it is kept. An empty table returns no rows.
    """
    bands = bands_for(percent / 100, rows, miss)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketches = reliable_checkpoint(_sketches(texts, words, bands, rows))
    classes = (
        sketches.filter("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("x"), F.first("bands").alias("bands"))
    )
    classes = reliable_checkpoint(classes)
    keys = classes.select("x", F.explode("bands").alias("key"))
    centres = keys.groupBy("key").agg(F.min("x").alias("c"), F.max("x").alias("last")).filter("c <> last").select("key", "c")
    stars = reliable_checkpoint(keys.join(centres, "key").filter("x <> c").select("c", "x").distinct())
    wanted = stars.select(F.col("c").alias("id")).union(stars.select(F.col("x").alias("id"))).distinct()
    sets = reliable_checkpoint(_sets(texts.join(wanted, "id", "left_semi"), words))
    pairs = (
        stars.join(sets.select(F.col("id").alias("x"), F.col("s").alias("xs")), "x")
        .join(sets.select(F.col("id").alias("c"), F.col("s").alias("cs")), "c")
        .select("c", "x", F.size("cs").alias("nc"), F.array_except("xs", "cs").alias("plus"), F.array_except("cs", "xs").alias("minus"))
    )
    shared = F.col("nc") - F.size("minus")
    linked = 100 * shared >= percent * (F.col("nc") + F.size("plus"))
    deltas = reliable_checkpoint(pairs.withColumn("linked", linked))
    links = deltas.filter("linked").select(F.col("c").alias("a"), F.col("x").alias("b")).union(_within_stars(deltas, percent, block))
    again = sketches.filter("n > 0").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 and id is not null")
    named = sketches.join(again.select("id"), "id", "left_semi").select("id", "h1", "h2").join(classes.select("h1", "h2", "x"), ["h1", "h2"])
    one = named.groupBy("id").agg(F.min("x").alias("a"), F.max("x").alias("b")).filter("a <> b")
    links = links.union(named.join(one, "id").filter("x <> a").select("a", F.col("x").alias("b")))
    labels = connected_components(links, "a", "b")
    named = (
        classes.select("h1", "h2", "x").join(labels.withColumnRenamed("node", "x"), "x", "left").select("h1", "h2", F.coalesce("component", "x").alias("component"))
    )
    found = sketches.select("id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The input rows without those that :func:`near_duplicates` does not keep; settings as there."""
    gone = near_duplicates(docs, id_col, text_col, **settings).filter("not kept").select(F.col(id_col).alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("row.*")


def op9_minhash_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)
