"""Toxicity of texts: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, A-Z folded. Features are words, pairs of neighbours and pairs with one or two words
between them, hashed to `1 << bits` coordinates; a feature counts once in a text, however often it occurs. Every
coordinate has its own learning rate, and the L1 term leaves few weights other than zero, so the broadcast weights stay
below the fixed number of coordinates. L1 does not prune the bias. It starts from the log odds of the learned rows' labels,
counted with one more toxic and two more clean ones; then it is learned like the weights, so of one row a label or so it
says little and a text without any known feature can score on either side of 0.5.

The regression is fitted on a bounded sample of the labelled rows (`common.fit_sample`), ordered by a hash of the text. Null and empty texts have no feature and score the bias alone. Rows without a label (null) are not
learned from; if no row has one, every weight is zero and every score 0.5. Repeated rows score alike. Columns of the same
name as a result are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_new
from .kernel import BYTE_FOLDED, PUNCTUATION, Words, mix, slices

GAPS = (1, 2, 3)


def features(texts: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, text of each feature, coordinate of each feature), slice by slice, with repeats."""
    shift = np.uint64(64 - bits)
    for at, part in slices(texts):
        words = Words(part, PUNCTUATION, BYTE_FOLDED)
        h, of = words.hashes, words.text_of_word()
        owners, grams = [of], [h]
        for gap in GAPS:
            same = of[:-gap] == of[gap:]
            owners.append(of[:-gap][same])
            grams.append(mix(h[:-gap][same] * np.uint64(2 * gap + 1) ^ (h[gap:][same] >> np.uint64(1))))
        yield at, len(part), np.concatenate(owners), (np.concatenate(grams) >> shift).astype(np.int64)


class Ftrl:
    """FTRL-proximal: z and n of each coordinate; the last one is the bias, which `start` is added to and L1 may leave out."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float, start: float = 0.0, prune_bias: bool = True):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l2, self.start = alpha, beta, l2, start
        self.l1 = np.full((1 << bits) + 1, l1)
        if not prune_bias:
            self.l1[-1] = 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = self.l1[at]
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(self.start + w.sum(), -35, 35))) - label
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def fit(labelled: DataFrame, text: str, label: str, bits: int = 20, passes: int = 6, alpha: float = 3.0,
        beta: float = 1.0, l1: float = 4.0, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights other than zero, and the bias at 1 << bits, from `labelled`, a bounded sample; one task learns them in one order."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[bytes] = []
            for _, n, of, at in features(batch.column(0), bits):
                pairs = np.unique((of << bits) | at)
                owner = pairs >> bits
                cuts = np.searchsorted(owner, np.arange(n + 1))
                grams = (pairs & ((1 << bits) - 1)).astype(np.int32)
                rows += [grams[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_pydict({"at": pa.array(rows, pa.binary()), "label": batch.column(1), "rank": batch.column(2)})

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(a, np.int32), y) for b in batches for a, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        toxic, bias = sum(y for _, y in rows), 1 << bits
        start = float(np.log((toxic + 1) / (len(rows) - toxic + 2))) if rows else 0.0
        model = Ftrl(bits, alpha, beta, l1, l2, start, prune_bias=False)
        rows = [(np.append(a, bias), y) for a, y in rows]
        for _ in range(passes):
            for at, y in rows:
                model.learn(at, y)
        found = np.flatnonzero(np.abs(model.z[:-1]) > l1)
        weights = np.append(model.weights(found), start + model.weights(np.array([bias])))
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(found, 1 << bits), pa.int64()), "w": pa.array(weights, pa.float64())})

    sample = labelled.where(F.col(label).isNotNull()).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(label) > 0).cast("int").alias("label"), F.xxhash64(F.lit("order"), text).alias("rank")
    )
    grams = sample.mapInArrow(featured, "at binary, label int, rank bigint")
    rows = grams.repartition(1).sortWithinPartitions("rank", "label").mapInArrow(trained, "at bigint, w double").collect()
    return np.array([r["at"] for r in rows], np.int64), np.array([r["w"] for r in rows], float)


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = 20, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with the probability `out` that the text is toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w = shared.value
        weights = np.zeros((1 << bits) + 1)
        weights[at] = w
        bias = weights[1 << bits]
        for texts in batches:
            sums = np.full(len(texts), bias)
            for first, n, of, grams in features(texts, bits):
                some = weights[grams] != 0
                pairs = np.unique((of[some] << bits) | grams[some])
                sums[first : first + n] += np.bincount(pairs >> bits, weights[pairs & ((1 << bits) - 1)], n)
            yield pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))

    return with_new(df, {out: scored(F.col(text))})
