"""Byte-level BPE: merges driven by a segment tree over byte positions."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import documents, per_worker

NO_RANK = 1 << 60
#: Entries a worker keeps at most per cache, so its memory is bounded.
CACHE = 300_000
#: Pieces of up to so many bytes are merged many at a time, as rows of arrays; longer ones, and fewer than LEAST_ROWS, one by one.
ROW_BYTES = 64
LEAST_ROWS = 32
#: Leaves of the trees built at a time, and characters of the texts whose new pieces are merged together.
LEAVES = 1 << 18
GATHER = 1 << 20
#: A white-space character before or after which a cut at a plain space would change the pattern's matches.
_UNSAFE = re.compile(r"\s \s|\s \Z")
#: No match of the pattern goes from another character on to a space, so these cuts hold in every text.
_CUT = re.compile(r"(?<=\S)(?= )")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _Recent(dict):
    """Results of ``make`` for short strings. When it is full, what has not been asked for since the last time goes."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> object:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            self.remember([(key, found)])
        return found

    def remember(self, found: Iterable[tuple[str, object]]) -> None:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self.update(found)

    def knows(self, key: str) -> bool:
        return key in self or key in self.older


class _RowTrees:
    """The segment trees of many short pieces, merged in step: each step takes every root's merge.

    Live tokens are ids; two of them merge where their bytes joined are a token, which a
    sorted table of pairs answers for all rows at once.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = max(ranks.values()) + 1
        keys, made = [self.width * self.width], [0]  # beyond every pair, so that a search always meets a key
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        wanted = left * self.width + right
        found = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[found] == wanted, self.made[found] * size + at, NO_RANK)

    def encode(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Token ids of pieces of 2 to ``size`` bytes, a power of two."""
        rows = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, rows)
        at = np.arange(size)
        ids = self.bytes[np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8)].reshape(rows, size)
        live = at < n[:, None]
        end = np.tile(at + 1, (rows, 1))
        left = np.tile(at - 1, (rows, 1))
        tree = np.full((rows, 2 * size), NO_RANK, np.int64)
        tree[:, size:-1] = np.where(live[:, 1:], self.leaves(ids[:, :-1], ids[:, 1:], at[:-1], size), NO_RANK)
        low = size
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        ids, end, left, nodes = ids.ravel(), end.ravel(), left.ravel(), tree.ravel()
        alive = live.ravel()
        row = np.flatnonzero(tree[:, 1] != NO_RANK)
        while len(row):
            base, root = row * size, nodes[row * (2 * size) + 1]
            i = root % size
            j = end[base + i]
            stop = end[base + j]
            ids[base + i] = root // size
            end[base + i] = stop
            alive[base + j] = False
            inner = stop < n[row]
            after = np.where(inner, stop, i)
            left[(base + after)[inner]] = i[inner]
            h = left[base + i]
            before = np.where(h >= 0, h, i)
            mine = ids[base + i]
            # the swallowed position loses its pair; the merged one and the live one before it get new pairs
            put_i = np.where(inner, self.leaves(mine, ids[base + after], i, size), NO_RANK)
            put_h = np.where(h >= 0, self.leaves(ids[base + before], mine, before, size), put_i)
            tops = base * 2
            nodes[tops + size + j] = NO_RANK
            nodes[tops + size + i] = put_i
            nodes[tops + size + before] = put_h
            paths, tops = np.concatenate([j, i, before]) + size >> 1, np.concatenate([tops, tops, tops])
            while paths[0]:
                under = tops + 2 * paths
                nodes[tops + paths] = np.minimum(nodes[under], nodes[under + 1])
                paths >>= 1
            row = row[nodes[row * (2 * size) + 1] != NO_RANK]
        stops = np.cumsum(alive.reshape(rows, size).sum(axis=1)).tolist()
        flat = ids[alive].tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]


class SegmentTreeBpe:
    """Encoder and decoder for one vocabulary and split pattern.

    What counts as a letter or digit is decided by the ``regex`` module's Unicode version; ids can
    differ from another library's for characters that only one of the two versions assigns.

    A piece starts as single bytes. The tree's leaf ``i`` holds rank * size + i for the
    pair that starts at byte position ``i`` (no rank where the pair is no token), so its
    root is the leftmost pair of the lowest rank. A merge takes the root, joins the two
    neighbours in a linked list of live positions and updates the leaves of the merged
    position, of the swallowed one and of the live neighbour to the left: logarithmic
    work a merge, so a piece of n bytes takes n log n steps.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: str(rank) for rank in self.tokens}
        self.pattern = regex.compile(pattern)
        self.pieces = _Recent(self._encode_piece)
        self.chunks = _Recent(self._encode_chunk)
        self.trees = _RowTrees(ranks) if all(bytes([b]) in ranks for b in range(256)) else None

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern; a whole piece that is a token is that token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        size = 1
        while size < n:
            size *= 2
        end = list(range(1, n + 1))  # where the live token at a position ends
        left = list(range(-1, n - 1))  # live position before it
        tree = [NO_RANK] * (2 * size)
        get = ranks.get
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank * size + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] != NO_RANK:
            i = tree[1] % size
            j = end[i]
            stop = end[j]
            end[i] = stop
            if stop < n:
                left[stop] = i
            put(j, NO_RANK)
            rank = get(piece[i : end[stop]]) if stop < n else None
            put(i, NO_RANK if rank is None else rank * size + i)
            h = left[i]
            if h >= 0:
                rank = get(piece[h:stop])
                put(h, NO_RANK if rank is None else rank * size + h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def _encode_piece(self, piece: str) -> list[int]:
        return self.encode_bytes(piece.encode())

    def _matches(self, chunk: str) -> list[str]:
        stem, stop = (chunk[:-1], chunk[-1]) if chunk[-1] in ".," else (chunk, "")
        if stem.removeprefix(" ").isalpha() and (stem.isascii() or max(stem) < "\u0100"):  # a match of letters, one of the stop
            return [stem, stop] if stop else [stem]
        return self.pattern.findall(chunk)

    def _encode_chunk(self, chunk: str) -> tuple[str, tuple[int, ...]]:
        return self._encode_matches(self._matches(chunk))

    def _encode_matches(self, matches: list[str]) -> tuple[str, tuple[int, ...]]:
        ids = tuple(chain.from_iterable(map(self.pieces.__getitem__, matches)))
        return " ".join(map(self.digits.__getitem__, ids)), ids

    def _chunks(self, text: str) -> list[str]:
        """Stretches of a text that no match of the pattern crosses.

        A text is cut before each plain space whose neighbours can't share a white-space
        match with it; a text with other spaces only where white space begins with one.
        """
        if not text or _UNSAFE.search(text):
            return _CUT.split(text) if text else []
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def _meet(self, chunks: list[list[str]]) -> None:
        """Encodes the short chunks that are new in these texts, their pieces together, and remembers them."""
        known, older = self.chunks, self.chunks.older
        new = {c: self._matches(c) for c in set().union(*chunks) if c not in known and c not in older and len(c) <= ROW_BYTES}
        by_size: dict[int, list[str]] = {}
        for piece in set().union(*new.values()):
            if not self.pieces.knows(piece):
                raw = piece.encode()
                if raw not in self.ranks and len(raw) <= ROW_BYTES:
                    by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append(piece)
        for size, group in by_size.items():
            if len(group) >= LEAST_ROWS:
                step = LEAVES // size
                for k in range(0, len(group), step):
                    part = group[k : k + step]
                    self.pieces.remember(zip(part, self.trees.encode([p.encode() for p in part], size)))
        known.remember([(c, self._encode_matches(m)) for c, m in new.items()])

    def encode_many(self, texts: list[str]) -> Iterator[tuple[str, list[int]]]:
        """``encode_joined`` of each text; new short pieces of neighbouring texts are merged together."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and size < GATHER:
                size += len(texts[stop])
                stop += 1
            chunks = [self._chunks(t) for t in texts[start:stop]]
            if self.trees:
                self._meet(chunks)
            yield from map(self._joined, chunks)
            start = stop

    def _joined(self, chunks: list[str]) -> tuple[str, list[int]]:
        found = list(map(self.chunks.__getitem__, chunks))
        return " ".join([x[0] for x in found]), list(chain.from_iterable([x[1] for x in found]))

    def encode_joined(self, text: str) -> tuple[str, list[int]]:
        """Decimal ids joined by a space, and the ids."""
        return self._joined(self._chunks(text))

    def encode(self, text: str) -> list[int]:
        return self.encode_joined(text)[1]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Bytes of the ids, joined; an id outside the vocabulary is a KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids))


def bpe_ids(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encodes and decodes whole texts: id, ids, n_tokens, ids_sha256, decoded_sha256.

    Every worker reads the vocabulary from ``ranks_path``. Null text counts as empty and
    has no tokens; every input row returns one row, repeated ones too; other columns are
    ignored. ``keep_ids=False`` returns the digests without the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(("bpe", ranks_path, pattern), lambda: SegmentTreeBpe(read_ranks(ranks_path), pattern))
        for batch in batches:
            all_ids, sizes, digests, decoded = [], [], [], []
            for joined, ids in bpe.encode_many([t or "" for t in batch.column(1).to_pylist()]):
                if keep_ids:
                    all_ids.append(ids)
                sizes.append(len(ids))
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            kept = [pa.array(all_ids, pa.list_(pa.int32()))] if keep_ids else []
            arrays = [batch.column(0), *kept, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *["ids"] * keep_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {'ids array<int>, ' if keep_ids else ''}n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op1_byte_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return bpe_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
