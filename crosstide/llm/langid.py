"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import documents, is_held_out, per_worker

DIMENSIONS = 1024
N = 3
UNKNOWN = "und"
#: N-grams a worker keeps the vectors of at most (one byte per dimension).
CACHE = 60_000


class Profiles:
    """N-gram vectors: each letter has a random vector of +1 and -1, drawn from its code point and a seed.

    The vector of an n-gram binds (multiplies) the vectors of its letters, each rotated by
    its distance from the end. A text bundles (adds) the vectors of its n-grams.
    Anything but letters becomes one boundary symbol.
    """

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, dimensions), np.int8)
        self.is_letter = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.bool_)

    def _letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            bits = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions, np.int8)
            v = self.letters[code] = 2 * bits - 1
            if len(self.letters) > CACHE:
                self.letters = {code: v}
        return v

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a text as packed code points, and how often each occurs; none without letters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = self.is_letter[codes]
        if not letter.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = np.where(letter, codes, 0)
        starts = np.concatenate(([True], letter[1:] | letter[:-1]))  # runs of other characters shrink to one
        codes = codes[starts]
        codes = codes[int(codes[0] == 0) : len(codes) - int(codes[-1] == 0)]
        codes = np.concatenate(([0], codes, [0])).astype(np.int64)
        grams = codes[: -N + 1]
        for j in range(1, N):
            grams = (grams << 21) | codes[j : len(codes) - N + 1 + j]
        return np.unique(grams, return_counts=True)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams, one row each."""
        if len(self.rows) + len(grams) > CACHE:
            self.rows = {}
        rows = self.rows
        out = np.empty(len(grams), np.int64)
        for k, gram in enumerate(grams.tolist()):
            row = rows.get(gram)
            if row is None:
                row = rows[gram] = len(rows)
                if row >= len(self.vectors):
                    self.vectors = np.concatenate((self.vectors, np.empty_like(self.vectors)))
                v = self._letter(gram & 0x1FFFFF)
                for back in range(1, N):
                    v = v * np.roll(self._letter((gram >> 21 * back) & 0x1FFFFF), back)
                self.vectors[row] = v
            out[k] = row
        return self.vectors[out]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions)
        for i in range(0, len(grams), 4096):
            total += counts[i : i + 4096].astype(np.float32) @ self.of(grams[i : i + 4096]).astype(np.float32)
        return total


def language_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = 7) -> dict[str, np.ndarray]:
    """One unit vector per language, bundled from all given texts with a language.

    Each task adds up its own n-gram counts and returns one vector per language; the sums are
    taken in Spark. What reaches the driver is languages x dimensions, whatever the corpus.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = per_worker(("profiles", dimensions, seed), lambda: Profiles(dimensions, seed))
        sums: dict[str, np.ndarray] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def settle(lang: str) -> None:
            parts = held.pop(lang)
            grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([c for _, c in parts]))
            sums[lang] = sums.get(lang, 0) + profiles.bundle(grams, counts)

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(profiles.counts(text))
                if len(held[lang]) >= 1000:
                    settle(lang)
        for lang in list(held):
            settle(lang)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"]
        )

    rows = docs.select(text_col, F.col(lang_col).cast("string")).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sums = (
        rows.mapInArrow(partial, "lang string, v array<double>")
        .select("lang", F.posexplode("v"))
        .groupBy("lang", "pos")
        .agg(F.sum("col").alias("total"))
        .collect()
    )
    found: dict[str, np.ndarray] = {}
    for r in sums:
        found.setdefault(r["lang"], np.zeros(dimensions))[r["pos"]] = r["total"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(found.items()) if v.any()}


def identify_languages(
    docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = 7
) -> DataFrame:
    """Predicted language of whole texts: the input columns as struct ``row``, lang_pred, score.

    The score is the cosine between the text's vector and the nearest prototype, not
    below 0; of equal cosines the first language by name wins. A null text, a text without
    letters, and any text when there is no prototype get ``und`` and score 0. Every row
    returns one row; an empty table returns none.
    """
    langs = list(prototypes)
    matrix = np.array([prototypes[l] for l in langs]).reshape(-1, dimensions)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = per_worker(("profiles", dimensions, seed), lambda: Profiles(dimensions, seed))
        for batch in batches:
            names, scores = [], []
            for text in batch.column(0).field(text_at).to_pylist():
                grams, counts = profiles.counts(text or "")
                name, score = UNKNOWN, 0.0
                if len(grams) and langs:
                    v = profiles.bundle(grams, counts)
                    cosines = matrix @ v / max(np.linalg.norm(v), 1e-12)
                    best = int(np.argmax(cosines))
                    name, score = langs[best], float(min(1.0, max(0.0, cosines[best])))
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    rows = docs.select(F.struct("*").alias("row"))
    text_at = docs.columns.index(text_col)
    return rows.mapInArrow(predict, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def op7_language_id(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = is_held_out("doc_id", 4, 2)
    prototypes = language_prototypes(docs.filter(~held_out))
    out = identify_languages(docs.select("doc_id", "text"), prototypes)
    return out.select("row.doc_id", "lang_pred", "score").withColumn("held_out", held_out)
