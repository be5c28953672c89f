"""Quality classifier by compression.

A zstandard dictionary is built from good and one from bad labelled texts. A
text's feature is the difference of its two compressed sizes over its own size:
text like the good samples is smaller with their dictionary. A logistic curve,
fitted to other labelled texts and weighted to the share of each label, turns
it into a calibrated score.

Fitting uses at most ``fit_rows`` labelled rows a class, those with the
smallest hash of the id, of at most ``fit_bytes`` bytes each (2 * fit_rows *
fit_bytes bytes on the driver at most): half for the dictionaries, half for the
curve. Scoring is one pass over whole texts, without a shuffle.

Defined results: null and empty text have a difference of 0 and get the curve's
score there; without labels of both classes every score is the share of the
label that is known, or 0.5; ids with contradicting labels are not used; of an
id with several texts the smallest is the sample; a null id is never labelled
and not held out. Samples that the trainer finds too few or too small for a
dictionary are one as they stand, end to end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import name, with_column

LEVEL, DICTIONARY_BYTES = 3, 262_144


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the curve's slope and offset (no dictionaries: a constant score)."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def compressors(self):
        import zstandard as zs

        make = lambda d: zs.ZstdCompressor(level=LEVEL, dict_data=zs.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        return make(self.good), make(self.bad)

    def differences(self, texts: list[bytes]) -> np.ndarray:
        if not self.good:
            return np.zeros(len(texts))
        good, bad = self.compressors()
        return np.array([(len(bad.compress(t)) - len(good.compress(t))) / max(1, len(t)) if t else 0.0 for t in texts])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.offset, -700, 700)))


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained from the samples; where the trainer refuses them, the samples themselves, which zstandard also takes as one."""
    import zstandard as zs

    try:
        return zs.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\n" * 8


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps with a slight penalty."""
    scale = float(np.std(x)) or 1.0
    design = np.c_[x / scale, np.ones(len(x))]
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, fit_bytes: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> CompressionModel:
    """The model of the labels (0 or 1) of the given documents."""
    marked = labels.select(name(doc_id).alias("id"), name(label).alias("label")).filter("id is not null and label in (0, 1)")
    marked = marked.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").select("id", "label")
    counts = {int(k): n for k, n in marked.groupBy("label").count().collect()}  # at most two rows
    if len(counts) < 2:
        share = next(iter(counts), 0.5)
        return CompressionModel(b"", b"", 0.0, float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -14, 14)))
    order = F.xxhash64("id")
    chosen = marked.filter("label = 1").orderBy(order, "id").limit(fit_rows).unionAll(marked.filter("label = 0").orderBy(order, "id").limit(fit_rows))
    rows = docs.select(name(doc_id).alias("id"), name(text).cast("binary").alias("raw")).filter(F.octet_length("raw").between(1, fit_bytes))
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("raw").alias("raw")).collect()  # 2 * fit_rows rows at most, by which the broadcast is bounded too
    by_label = {k: [bytes(r.raw) for r in sorted(sample, key=lambda r: (hash_of(r.id), r.id)) if r.label == k] for k in (0, 1)}
    halves = {k: (v[::2], v[1::2] or v) for k, v in by_label.items()}
    model = CompressionModel(dictionary(halves[1][0]), dictionary(halves[0][0]), 0.0, 0.0)
    x = np.concatenate([model.differences(halves[1][1]), model.differences(halves[0][1])])
    n1, n0 = len(halves[1][1]), len(halves[0][1])
    if not n1 or not n0:
        return CompressionModel(b"", b"", 0.0, float(np.log(counts[1] / counts[0])))
    weight = np.concatenate([np.full(n1, counts[1] / n1), np.full(n0, counts[0] / n0)]) * (n1 + n0) / (counts[0] + counts[1])
    slope, offset = logistic(x, np.concatenate([np.ones(n1), np.zeros(n0)]), weight)
    return CompressionModel(model.good, model.bad, slope, offset)


def hash_of(doc_id: int) -> int:
    """An order of ids unrelated to their size."""
    import xxhash

    return xxhash.xxh3_64_intdigest(str(doc_id).encode())


def score(docs: DataFrame, model: CompressionModel, *, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs with the score (a column of that name is replaced); keep: only these others are returned."""
    raw = F.coalesce(name(text).cast("binary"), F.lit(b""))
    return with_column(docs, raw, lambda texts: [model.scores(texts)], [T.StructField(out, T.DoubleType())], 2000, keep)
