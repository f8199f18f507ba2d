"""Document quality: ridge regression on random Fourier features, calibrated by isotonic regression.

A text becomes a vector of statistics (lengths, shares of kinds of characters, repetition of words
and lines). Random cosines of the standardised vector approximate a Gaussian kernel; each partition
sums its share of the normal equations, the sums are added up and solved on the driver (one matrix
of `components` squared). Isotonic regression on rows that the fit left out turns ridge scores into
shares of label 1.

Learning takes at most `sample_rows` labelled rows that aren't held out, those with the smallest hash
of their key, and one row of each key (that with the smallest digest of its text): 20,000 rows of
about 25 numbers. Everything else covers all rows and whole texts.

Rows: null and empty texts are scored by their (zero) statistics. Several labels of a key count by
their mean (1 from one half on), null labels don't count. With no label, or one kind only, every
score is the share of label 1 among the labels (0.5 without any). Repeated rows are scored alike,
extra columns ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import batch, held_out, kept_rows, pieces, raw_text, saved

SAMPLE_ROWS = 20_000
COMPONENTS = 384
GAMMA = 0.15
RIDGE = 1e-3
SEED = 20
BINS = 200
ACCEPTED = 0.3


def _classes() -> np.ndarray:
    """256 x 9: which kind each byte is."""
    kinds = [
        lambda b: 97 <= b <= 122,
        lambda b: 65 <= b <= 90,
        lambda b: 48 <= b <= 57,
        lambda b: b == 32,
        lambda b: b in b"\n\r\t\x0b\x0c",
        lambda b: b in b".,;:?'\"-()",
        lambda b: b == 33,
        lambda b: b < 128 and chr(b) in "#$%&*|@/\\<>=+_{}[]^~`",
        lambda b: b >= 128,
    ]
    return np.array([[float(k(b)) for k in kinds] for b in range(256)])


CLASSES = _classes()
N_FEATURES = 25


def statistics(text: bytes) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    out[:9] = counts @ CLASSES / n
    share = counts[counts > 0] / n
    out[9] = -(share * np.log2(share)).sum()
    out[10] = np.log1p(n)
    words = text.split()
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tally = Counter(words)
        most = max(tally.values())
        out[11] = np.log1p(len(words))
        out[12] = sizes.mean()
        out[13] = sizes.std()
        out[14] = len(tally) / len(words)
        out[15] = most / len(words)
        out[16] = len(tally) / np.sqrt(len(words))
        out[17] = sum(x[-1:].isalnum() for x in tally) / len(tally)
        out[18] = sum(x.isupper() for x in tally) / len(tally)
        out[19] = sum(x.isdigit() for x in tally) / len(tally)
        pairs = len(set(zip(words, words[1:])))
        out[20] = pairs / max(1, len(words) - 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    if lines:
        found = Counter(lines)
        out[21] = np.log1p(len(lines))
        out[22] = len(found) / len(lines)
        out[23] = sum(len(x) * (k - 1) for x, k in found.items()) / n
        out[24] = np.log1p(n / len(lines))
    return out


class QualityModel:
    """Scores from statistics; constant where there was nothing to learn."""

    def __init__(self, constant: float):
        self.constant: float | None = constant

    @classmethod
    def fitted(cls, mean: np.ndarray, scale: np.ndarray, components: int, gamma: float, seed: int) -> QualityModel:
        model = cls(0.5)
        draw = np.random.default_rng(seed)
        model.mean, model.scale = mean, scale
        model.waves = draw.normal(0.0, np.sqrt(2 * gamma / 5), (len(mean), components))
        model.phases = draw.uniform(0, 2 * np.pi, components)
        return model

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random cosines, the standardised statistics themselves and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(x @ self.waves + self.phases) * np.sqrt(2 / self.waves.shape[1])
        return np.hstack([waves, x / 10, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return np.interp(self.raw(stats), self.steps, self.values)


def isotonic(raw: np.ndarray, label: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values), values ascending: pooled adjacent violators over groups of equal size."""
    order = np.argsort(raw, kind="stable")
    groups = np.array_split(order, min(bins, len(order)))
    blocks: list[list[float]] = []  # weight, mean position, mean label
    for g in groups:
        blocks.append([len(g), raw[g].mean(), label[g].mean()])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            w2, p2, v2 = blocks.pop()
            w1, p1, v1 = blocks.pop()
            w = w1 + w2
            blocks.append([w, (w1 * p1 + w2 * p2) / w, (w1 * v1 + w2 * v2) / w])
    table = np.array(blocks)
    return table[:, 1], np.clip(table[:, 2], 0.0, 1.0)


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(y, fit, stats): the labelled sample's statistics; a quarter is left out of the fit."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"))
    known = known.filter(~held_out(F.col("key")) & F.col("y").isNotNull())
    known = known.groupBy("key").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    known = known.withColumn("hash", F.xxhash64("key")).orderBy("hash", "key").limit(rows)
    texts = docs.select(F.col(key).alias("key"), raw_text(F.col(text)).alias("text"))
    met = texts.join(F.broadcast(known), "key")  # `rows` keys at most
    # of a key's rows, that with the smallest digest: `rows` rows at most, however often a key repeats
    own = F.min_by("text", F.xxhash64("text")).alias("text")
    met = met.groupBy("key").agg(F.first("y").alias("y"), F.first("hash").alias("hash"), own)
    met = met.select("y", (F.pmod("hash", F.lit(4)) != 0).alias("fit"), "text")
    schema = pa.schema([("y", pa.float64()), ("fit", pa.bool_()), ("stats", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            yield batch(schema, b.column(0), b.column(1), [statistics(x) for x in b.column(2).to_pylist()])

    return saved(met.mapInArrow(run, "y double, fit boolean, stats array<double>"), "quality-sample")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    components: int = COMPONENTS,
    gamma: float = GAMMA,
    ridge: float = RIDGE,
    seed: int = SEED,
) -> QualityModel:
    sample = _sample(docs, labels, key, text, label, sample_rows)
    sums = [F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_FEATURES)]
    sums += [F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(N_FEATURES)]
    fit = sample.filter("fit")
    row = fit.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"), *sums).first()
    if not row["n"] or row["share"] in (0.0, 1.0):
        return QualityModel(0.5 if not row["n"] else row["share"])
    mean = np.array([row[f"m{i}"] for i in range(N_FEATURES)])
    scale = np.array([max(row[f"s{i}"], 1e-6) for i in range(N_FEATURES)])
    model = QualityModel.fitted(mean, scale, components, gamma, seed)
    width = components + N_FEATURES + 1
    schema = pa.schema([("slot", pa.int32()), ("sums", pa.binary())])

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for b in batches:
            z = model.features(np.array(b.column(1).to_pylist()).reshape(-1, N_FEATURES))
            y = b.column(0).to_numpy(zero_copy_only=False)
            total += z.T @ np.hstack([z, y[:, None]])
        yield batch(schema, [int(total[-1, -1]) % 8], [total.tobytes()])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in group["sums"])
        return pd.DataFrame({"sums": [total.tobytes()]})

    parts = fit.select("y", "stats").mapInArrow(equations, "slot int, sums binary")
    parts = parts.groupBy("slot").applyInPandas(added, "sums binary").collect()  # 8 matrices at most
    total = sum(np.frombuffer(r["sums"]) for r in parts).reshape(width, width + 1)
    penalty = ridge * row["n"] * np.eye(width) / width
    penalty[-1, -1] = 0.0
    model.weights = np.linalg.solve(total[:, :-1] + penalty + 1e-9 * np.eye(width), total[:, -1])
    rest = sample.filter("NOT fit").select("y", "stats").toPandas()  # a quarter of the sample
    if len(rest) < 20 or rest["y"].nunique() < 2:
        rest = sample.select("y", "stats").toPandas()
    model.steps, model.values = isotonic(model.raw(np.stack(rest["stats"].to_list())), rest["y"].to_numpy())
    model.constant = None
    return model


def scores(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("key"), raw_text(F.col(text)).alias("text"))
    schema = pa.schema([("key", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            found = shared.value.score(np.stack([statistics(x) for x in b.column(1).to_pylist()]))
            yield batch(schema, b.column(0), pa.array(found))

    return rows.mapInArrow(run, "key long, score double")


def accepted(docs: DataFrame, model: QualityModel, least: float = ACCEPTED, text: str = "text") -> DataFrame:
    """The rows that score `least` or more, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accept(bodies: list[bytes | None]) -> np.ndarray:
        return shared.value.score(np.stack([statistics(x or b"") for x in bodies])) >= least

    return kept_rows(docs, text, accept)
