"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsonde.llm import common
from colsonde.llm.packing import slabs

STATISTICS = (
    "log_words", "log_bytes", "word_bytes", "upper", "digits", "marks", "symbols", "pipes", "beyond_ascii", "distinct_words",
    "capital_words", "marked_words", "long_words", "log_line_words", "repeated_lines", "top_word", "log_sentence_words", "odd_starts",
)
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_MARK = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_SYMBOL = np.array([ord(c) for c in "#*$%&<>@^~_=+{}[]\\"])
_STOPS = b".!?"
_BINS = 4096


def statistics(text: bytes) -> list[float]:
    """Statistics of one whole text; all zero if it is empty."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    capital = marked = long = odd = 0
    for w, c in counts.items():
        if w.isupper():
            capital += c
        if w[-1:] in b"#*$%&!|":
            marked += c
        if len(w) > 20:
            long += c
        if not 97 <= (w[0] | 32) <= 122 and w[0] < 128:
            odd += c
    stops = int(count[33] + count[46] + count[63])
    spaces = int(count[32] + count[9:14].sum())
    return [
        np.log1p(n), np.log1p(size), min((size - spaces) / n, 40.0), count[_UPPER].sum() / size, count[_DIGIT].sum() / size,
        count[_MARK].sum() / size, count[_SYMBOL].sum() / size, count[124] / size, count[128:].sum() / size, len(counts) / n,
        capital / n, marked / n, long / n, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), max(counts.values()) / n,
        np.log1p(n / (stops + 1)), odd / n,
    ]


def measure(docs: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., __f array<double>): statistics of every row; null texts are empty."""
    common.ship(docs.sparkSession)
    source = docs.select(*[F.col(k) for k in keep], F.col(column).cast("string").alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches):
        for batch in batches:
            for slab in slabs(batch, "__text"):
                rows = [statistics((x or "").encode()) for x in slab.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*slab.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "__f"])

    return source.mapInArrow(common.tidy(run), f"{head}, __f array<double>")


@dataclass
class QualityModel:
    """All that scoring needs: some kilobytes, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return lift(z, self.frequencies, self.phases) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def lift(z: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, the rows themselves, and a constant."""
    wave = np.sqrt(2.0 / frequencies.shape[1]) * np.cos(z @ frequencies + phases)
    return np.hstack([wave, z, np.ones((len(z), 1))])


def pool_adjacent(x: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of good / total over ascending x: (x, non-decreasing rates)."""
    blocks: list[list[float]] = []
    for a, n, g in zip(x.tolist(), total.tolist(), good.tolist(), strict=True):
        blocks.append([g, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, n2, k2 = blocks.pop()
            blocks[-1][0] += g2
            blocks[-1][1] += n2
            blocks[-1][2] += k2
    return x, np.concatenate([np.full(int(k), g / n) for g, n, k in blocks]) if blocks else np.zeros(0)


def _summed(rows: DataFrame, of, width: int) -> np.ndarray:
    """Sum over all rows of the float64 vectors that ``of(batch)`` makes, by a tree of bounded sums."""
    common.ship(rows.sparkSession)

    def each(batches):
        from pyspark import TaskContext

        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "v"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for x in group.column("v"):
            total += np.frombuffer(x.as_py())
        return pa.table({"slot": group.column("slot")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(each, "slot bigint, v binary")
    for slots in (1024, 16):
        sums = sums.withColumn("slot", F.col("slot") % slots).groupBy("slot").applyInArrow(add, "slot bigint, v binary")
    found = sums.collect()  # 16 rows at most
    return sum((np.frombuffer(r.v) for r in sorted(found, key=lambda r: r.slot)), np.zeros(width))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    at = {n: i for i, n in enumerate(batch.schema.names)}
    flat = batch.column(at["__f"]).flatten().to_numpy()
    return flat.reshape(-1, len(STATISTICS)), batch.column(at["__y"]).to_numpy() if "__y" in at else None


def fit(measured: DataFrame, labels: DataFrame, features: int = 192, penalty: float = 1e-3, seed: int = 7) -> QualityModel | None:
    """Fit on rows of ``measured`` (doc_id, __f) that ``labels`` (doc_id, quality) judges.

    Rows whose crc32(doc_id as text) mod 4 is 2 are never learnt from; of the others, those of
    remainder 3 calibrate and the rest fit. Sums over partitions are all that reaches the
    driver: moments, then the normal equations, then 4096 bins of raw scores. None if there is
    nothing to learn from. Null ids and null labels are left out; each label row counts.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("__y"))
    rows = common.settle(measured.join(known, "doc_id").withColumn("__fold", fold).where("__fold <> 2").select("__f", "__y", "__fold"), "quality-train")
    train, check = rows.where("__fold < 2").drop("__fold"), rows.where("__fold = 3").drop("__fold")
    d = len(STATISTICS)

    def moments(batch):
        x, _ = _matrix(batch)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    sums = _summed(train, moments, 1 + 2 * d)
    if not sums[0]:
        return None
    mean = sums[1 : d + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[d + 1 :] / sums[0] - mean * mean, 0)) + 1e-6
    draw = np.random.default_rng(seed)
    frequencies = draw.normal(0, 1 / np.sqrt(d), (d, features))
    phases = draw.uniform(0, 2 * np.pi, features)
    k = features + d + 1

    def normal(batch):
        x, y = _matrix(batch)
        z = lift(np.clip((x - mean) / scale, -8, 8), frequencies, phases)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(train, normal, k * k + k)
    gram, right = sums[: k * k].reshape(k, k), sums[k * k :]
    weights = np.linalg.solve(gram + penalty * np.trace(gram) / k * np.eye(k), right)
    model = QualityModel(mean, scale, frequencies, phases, weights, np.zeros(1), np.zeros(1))

    def bins(batch):
        x, y = _matrix(batch)
        at = np.clip(((model.raw(x) + 1) / 3 * _BINS).astype(np.int64), 0, _BINS - 1)
        return np.concatenate([np.bincount(at, minlength=_BINS), np.bincount(at, y, minlength=_BINS)])

    sums = _summed(check, bins, 2 * _BINS)
    if not sums[:_BINS].sum():
        sums = _summed(train, bins, 2 * _BINS)
    total, good = sums[:_BINS], sums[_BINS:]
    some = np.flatnonzero(total)
    model.knots, model.values = pool_adjacent((some + 0.5) / _BINS * 3 - 1, total[some], good[some])
    return model


def score(measured: DataFrame, model: QualityModel | None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of measured rows; 0.5 throughout without a model."""
    spark = measured.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = measured.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, _ = _matrix(batch)
                s = np.full(len(x), 0.5) if sent.value is None else sent.value.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    out = measured.select("doc_id", "__f").mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: every row of ``docs`` scored from its whole text.

    Only statistics of the text go into a score. A null text scores as an empty one, a null
    doc_id is not held out, repeated rows score alike. Texts are read once.
    """
    measured = common.settle(measure(docs), "quality-statistics")
    return score(measured, fit(measured, labels.select("doc_id", "quality")))
