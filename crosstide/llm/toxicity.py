"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import documents, is_held_out
from crosstide.session import reliable_checkpoint

#: Bounds of what a fit keeps: confirmed toxic texts, unlabelled texts and features used.
MAX_POSITIVE = 20_000
MAX_UNLABELLED = 40_000
MAX_FEATURES = 8_192
#: Estimated share of toxic texts among those with a feature, below which it is no evidence.
MIN_SHARE = 0.25
#: Word starts of these lengths are features besides whole words.
STARTS = (4, 5, 6)
#: A feature that occurs so often in a text, or so often among so many words, counts as a further one.
LEVELS = ((1, None), (2, None), (4, None), (1, 250), (2, 250))
#: Words a worker keeps the features of at most.
CACHE = 400_000
#: Bits of the map of hashes that the corpus counts need; 2 MB whatever the corpus.
MAP_BITS = 24
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    """A linear score over the presence of features: feature hash -> column, weight per column, bias."""

    columns: dict[int, int]
    weights: np.ndarray
    bias: float

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.bias + self.weights[r].sum() for r in rows])


class Features:
    """Which columns a text's words have: whole lower-cased words and their starts, hashed, by how often they occur."""

    def __init__(self, columns: dict[int, int] | None = None, wanted: np.ndarray | None = None):
        self.columns, self.wanted = columns, wanted
        self.bases = None if columns is None else {f & 0xFFFFFFFF for f in columns}
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            names = [f"={word}", *[f"{k}{word[:k]}" for k in STARTS if len(word) >= k]]
            hashes = [zlib.crc32(n.encode("utf-8", "replace")) for n in names]
            if self.bases is not None:
                hashes = [h for h in hashes if h in self.bases]
            if self.wanted is not None:
                hashes = [h for h in hashes if int(self.wanted[(h & (1 << MAP_BITS) - 1) >> 3]) >> (h & 7) & 1]
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[word] = tuple(hashes)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Distinct features of a whole text, ascending: a hash, and its level above it where it occurs often enough."""
        counts: dict[int, int] = {}
        words = _WORD.findall((text or "").lower())
        size = len(words)
        for word, n in Counter(words).items():
            for h in self.of_word(word):
                counts[h] = counts.get(h, 0) + n
        found = [h + (k << 32) for h, n in counts.items() for k, (least, among) in enumerate(LEVELS) if n >= least and (among is None or n * among >= least * size)]
        if self.columns is not None:
            found = [self.columns[f] for f in found if f in self.columns]
        return np.array(sorted(found), np.int64)


def _hash_map(features: DataFrame) -> np.ndarray:
    """Bytes with the bits set that the low bits of the features' hashes name, made of at most 2**MAP_BITS / 8 grouped rows."""
    bit = f"feature & {(1 << MAP_BITS) - 1}"
    parts = features.groupBy(F.expr(f"({bit}) >> 3").alias("at")).agg(F.expr("bit_or(1 << cast(feature & 7 as int))").alias("bits")).toPandas()
    out = np.zeros(1 << MAP_BITS - 3, np.uint8)
    out[parts["at"].to_numpy(np.int64)] = parts["bits"].to_numpy(np.int64)
    return out


def _feature_counts(texts: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """Documents per feature: rows (feature, n), summed within each task before the shuffle.

    With ``wanted``, a map of hashes, features outside it are left out; it lets a few others through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(wanted=wanted), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(features.of(text).tolist())
                if len(counts) > 1_000_000:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _feature_rows(texts: DataFrame, columns: dict[int, int]) -> list[np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(columns)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features.of(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int64()))], ["f"])

    return [np.array(r["f"], np.int64) for r in texts.mapInArrow(run, "f array<long>").collect()]


def nnpu_fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], scale: np.ndarray, prior: float, seed: int, epochs: int = 30, batches: int = 8, rate: float = 0.1, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss; feature i has the value scale[i].

    The risk is prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]). Where a mini-batch
    makes the second term negative, which more fitting to the positives would only deepen, the
    step goes up that term instead.
    """
    n, scale = len(scale), np.append(scale, 1.0)
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(n + 1) for _ in range(3))
    step = 0

    def grad(rows: list[np.ndarray], sign: int) -> tuple[float, np.ndarray]:
        """Mean of l(sign * g) over rows and its gradient; the last weight is the bias."""
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate(rows) if sizes.sum() else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        z = sign * (w[n] + np.bincount(owner, (w * scale)[flat], len(rows)))
        slope = -sign / (1 + np.exp(np.clip(z, -50, 50))) / len(rows)
        g = np.bincount(flat, slope[owner], n + 1) * scale
        g[n] = slope.sum()
        return float(np.logaddexp(0, -z).mean()), g

    for _ in range(epochs):
        ps, us = (np.array_split(rng.permutation(len(x)), batches) for x in (positive, unlabelled))
        for p, u in zip(ps, us):
            if not len(p) or not len(u):
                continue
            p, u = [positive[i] for i in p], [unlabelled[i] for i in u]
            (_, up), (lost, down), (risk, ug) = grad(p, 1), grad(p, -1), grad(u, -1)
            g = prior * up + (ug - prior * down) if risk - prior * lost >= 0 else prior * down - ug
            g[:n] += l2 * w[:n]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return (w * scale)[:n], float(w[n])


def prior_corrected_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float, slack: float = 0.03) -> float:
    """Where to cut logits in two: in the widest gap among cuts of nearly the smallest non-negative PU error.

    The error of a cut t is prior * P(positive < t) + max(0, P(unlabelled >= t) - prior * P(positive >= t));
    cuts within ``slack`` * prior of the smallest count as equally good.
    """
    u, p = np.sort(unlabelled), np.sort(positive)
    at = (u[1:] + u[:-1]) / 2
    if not len(at):
        return float(p.min())
    missed = np.searchsorted(p, at) / len(p)
    over = 1 - np.searchsorted(u, at) / len(u)
    error = prior * missed + np.maximum(0, over - prior * (1 - missed))
    good = error <= error.min() + slack * prior
    return float(at[np.argmax(np.where(good, u[1:] - u[:-1], -1))])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", classifiers: int = 3,
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, threshold: float = 0.7,
) -> ToxicityModel:
    """Learns from texts with label 1 and from all other given texts, taken as unlabelled.

    The class prior is the share of label 1 among all labelled ids. Feature counts cover every
    positive text of the sample and every given text; only the fit itself is bounded, to the
    ``max_positive`` positives with the smallest hashed id and about ``max_unlabelled``
    unlabelled texts. Of an id that is labelled more than once the largest label counts.
    Several classifiers, trained on differently shuffled mini-batches, are averaged, and the
    average is shifted so that scores from ``threshold`` up are those above the prior-corrected
    cut. Null ids, texts and labels teach nothing. Without a positive text there is no classifier
    and every score is 0.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    toxic = F.col("y") == 1
    labelled, toxics = known.agg(F.count(F.lit(1)), F.count_if(toxic)).first()
    prior = toxics / labelled if labelled else 0.0
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = known.filter(toxic).orderBy(F.xxhash64("id"), "id").limit(max_positive).select("id")
    positive = texts.join(chosen, "id", "left_semi").select("text")  # at most max_positive ids
    total = texts.count()
    here = reliable_checkpoint(_feature_counts(positive).filter("n >= 3").withColumnRenamed("n", "seen"))
    ratio = (F.col("seen") + 0.5) / (min(toxics, max_positive) + 1) * (total + 1) / (F.coalesce("n", F.lit(0)) + 0.5)
    rated = here.join(_feature_counts(texts.select("text"), _hash_map(here)), "feature", "left").select("feature", "seen", (F.col("seen") * F.log(ratio)).alias("evidence"), ratio.alias("ratio"))
    used = rated.filter(F.col("ratio") * prior >= MIN_SHARE).orderBy(F.desc("evidence"), "feature").limit(MAX_FEATURES).collect()
    columns = {r["feature"]: i for i, r in enumerate(used)}
    seen = {r["feature"]: r["seen"] for r in used}
    if not columns or not 0 < prior < 1:
        return ToxicityModel({}, np.zeros(0), -np.inf)
    share = min(1.0, max_unlabelled / max(total, 1))
    sample = texts.filter(F.coalesce(F.pmod(F.xxhash64("id"), F.lit(1_000_003)), F.lit(1_000_003)) < int(share * 1_000_003)).select("text")
    rows, others = _feature_rows(positive, columns), _feature_rows(sample, columns)
    # what few positive texts carry is weak evidence
    scale = np.minimum(1, np.array([seen[f] for f in columns]) / (0.05 * len(rows)))
    fits = [nnpu_fit(rows, others, scale, prior, seed) for seed in range(classifiers)]
    mean = ToxicityModel(columns, np.mean([w for w, _ in fits], axis=0), float(np.mean([b for _, b in fits])))
    cut = prior_corrected_cut(mean.logits(rows), mean.logits(others), prior)
    return ToxicityModel(columns, mean.weights, mean.bias - cut + float(np.log(threshold / (1 - threshold))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Score of every whole text, from the text alone: id, score (0 to 1), predicted (1 from ``threshold``).

    Null text counts as empty; a text without any known feature gets the base score, which is 0
    (up to rounding) without a classifier. Every row returns one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.columns)
        for batch in batches:
            logits = model.logits([features.of(t) for t in batch.column(1).to_pylist()])
            scores = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = is_held_out("doc_id", 3, 1)
    model = fit_toxicity(docs.filter(~held_out), labels.filter(~held_out))
    return score_toxicity(docs, model).withColumn("held_out", held_out)
