"""Quality scores: random Fourier features of document statistics, ridge regression and isotonic calibration.

A Gaussian kernel over standardised statistics is approximated by random cosine features.  The normal equations of the
ridge fit are summed inside each partition and then, as a tree, over groups of partitions, so that only a fixed number
of fixed-size blocks reaches the driver.  The raw scores of the learning rows are counted in a fixed number of bins, and
pool-adjacent-violators over the bins gives a monotone map to probabilities.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, crc_mod, lean, text_key
from .textstats import DIGIT, GAP, KINDS, LEAD, LOWER, OTHER, REST, STOP, SYMBOL, UPPER, WordHasher, kinds, repeat_words

STATISTICS = ("log_words", "word_length", "upper", "digit", "symbol", "stop", "other", "wide", "distinct", "dup_lines", "repeats", "line_words", "top_word", "long_words")
BINS, LOW, HIGH = 1000, -0.5, 1.5


def statistics(data: bytes, hasher: WordHasher) -> list[float]:
    words = data.split()
    count = np.bincount(kinds(data), minlength=KINDS).astype(float)
    chars = max(1.0, len(data) - count[GAP] - count[REST])
    n = max(1, len(words))
    h = hasher(words)
    _, times = np.unique(h, return_counts=True) if len(h) else (h, np.zeros(1))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [
        float(np.log1p(len(words))), float(np.log1p(chars / n)), count[UPPER] / max(1.0, count[UPPER] + count[LOWER]), count[DIGIT] / chars, count[SYMBOL] / chars, count[STOP] / chars, count[OTHER] / chars, count[LEAD] / chars,
        len(times) / n, 1 - len(set(lines)) / max(1, len(lines)), repeat_words(h) / n, float(np.log1p(len(words) / max(1, len(lines)))), float(times.max()) / n, sum(len(w) > 24 for w in words) / n,
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, x (the statistics of the whole text; those of an empty one for null)."""

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            x = [statistics((t or "").encode("utf-8", "surrogatepass"), hasher) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "text_key", "x"])

    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(lean(run), "doc_id long, text_key long, x array<double>")


def isotonic(low: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing means of bins with a weight and a sum of labels."""
    pools: list[list[float]] = []
    for x, w, s in zip(low, weight, total):
        if w <= 0:
            continue
        pools.append([x, x, w, s])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, hi, w2, s2 = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + w2, pools[-1][3] + s2]
    knots = [(x, s / w) for lo, hi, w, s in pools for x in ((lo, hi) if hi > lo else (lo,))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.w + self.phase), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.beta, LOW, HIGH)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1) if len(self.knots[0]) else np.full(len(x), 0.5)


def _matrix(batch) -> np.ndarray:
    return np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, len(STATISTICS))


def fit(stats: DataFrame, labels: DataFrame, width: int = 256, gamma: float = 0.08, ridge: float = 1e-3, held_out: int = 0, folds: int = 5, groups: int = 8, seed: int = 4, parts: int = 4) -> QualityModel:
    """Learns from the labelled rows outside the held-out fold; rows without an id or a label are not learned from.

    The scores are calibrated on rows that they were not fitted on: the learned rows are dealt to ``parts`` by their ids, and
    those of a part are scored by the ridge of all others, whose normal equations are the sums less the part's own.  The
    model's own ridge is that of all learned rows.  ``labels`` may repeat a document: its labels are averaged; ties of raw
    scores meet in a bin of their own.  Without any label, or for an empty table, every score is 0.5.
    """
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    rows = stats.where(crc_mod(F.col("doc_id"), folds) != held_out).join(known, "doc_id")
    rows = rows.select("x", F.col("y").cast("double"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"))
    rows = Workspace(stats.sparkSession, "quality-rows").save(rows, "learned")
    d = len(STATISTICS)
    m = rows.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{g}{i}") for i in range(d) for g, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(seed)
    mean = np.array([m[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([max(m[f"s{i}"] or 0.0, 1e-6) for i in range(d)])
    model = QualityModel(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (d, width)), rng.uniform(0, 2 * np.pi, width), np.zeros(width + 1), (np.empty(0), np.empty(0)))
    if not m["n"]:
        return model
    k = width + 1

    def blocks(found: dict) -> pa.RecordBatch:
        cols = [pa.array(list(found), pa.int32()), pa.array([n for n, *_ in found.values()], pa.int64()), *(pa.array([v[i].tobytes() for v in found.values()], pa.binary()) for i in (1, 2))]
        return pa.RecordBatch.from_arrays(cols, ["part", "n", "a", "b"])

    def sums(batches):
        found: dict = {}
        for b in batches:
            f, y, part = model.features(_matrix(b)), b.column("y").to_numpy(), b.column("part").to_numpy()
            for p in np.unique(part).tolist():
                own = part == p
                n, left, right = found.get(p, (0, 0.0, 0.0))
                found[p] = n + int(own.sum()), left + f[own].T @ f[own], right + f[own].T @ y[own]
        if found:
            yield blocks(found)

    def added(batches):
        found: dict = {}
        for b in batches:
            for p, n, x, y in zip(*(b.column(c).to_pylist() for c in ("part", "n", "a", "b"))):
                own, left, right = found.get(p, (0, 0.0, 0.0))
                found[p] = own + n, left + np.frombuffer(x), right + np.frombuffer(y)
        if found:
            yield blocks(found)

    kind = "part int, n long, a binary, b binary"
    tree = rows.mapInArrow(lean(sums), kind)
    tasks = rows.rdd.getNumPartitions()
    for wide in ([math.isqrt(tasks)] if tasks > groups**2 else []) + [groups, 1]:  # a task adds few blocks on each level
        tree = tree.repartition(wide).mapInArrow(lean(added), kind)
    n, left, right = np.zeros(parts), np.zeros((parts, k, k)), np.zeros((parts, k))
    for r in tree.collect():  # a block for each part
        n[r.part] += r.n
        left[r.part] += np.frombuffer(r.a).reshape(k, k)
        right[r.part] += np.frombuffer(r.b)
    solved = lambda use: np.linalg.solve(left[use].sum(axis=0) + ridge * max(1.0, n[use].sum()) * np.diag([1.0] * width + [1e-9]), right[use].sum(axis=0))
    model.beta = solved(np.ones(parts, bool))
    others = np.stack([solved(np.arange(parts) != p) if n[np.arange(parts) != p].sum() else model.beta for p in range(parts)])

    def binned(batches):
        w, s = np.zeros(BINS + 1), np.zeros(BINS + 1)
        for b in batches:
            raw = np.clip(np.einsum("ij,ij->i", model.features(_matrix(b)), others[b.column("part").to_numpy()]), LOW, HIGH)
            at = np.rint((raw - LOW) / (HIGH - LOW) * BINS).astype(int)
            w += np.bincount(at, minlength=BINS + 1)
            s += np.bincount(at, b.column("y").to_numpy(), minlength=BINS + 1)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at]), pa.array(s[at])], ["bin", "w", "s"])

    bins = rows.mapInArrow(lean(binned), "bin long, w double, s double").groupBy("bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).orderBy("bin").collect()
    at = np.array([r.bin for r in bins])
    model.knots = isotonic(LOW + at * (HIGH - LOW) / BINS, np.array([r.w for r in bins]), np.array([r.s for r in bins]))
    return model


def score(stats: DataFrame, model: QualityModel, cut: float = 0.3) -> DataFrame:
    """doc_id, text_key, score, predicted for every described row; scores between two knots of the calibration are
    interpolated, and rows with equal statistics have equal scores.  An empty table gives no rows."""

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "text_key", "score", "predicted"])

    return stats.mapInArrow(lean(run), "doc_id long, text_key long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """Scores for every row of ``docs(doc_id, text)``, with a model learned from ``labels(doc_id, quality)``.

    A null text is scored as an empty one; repeated rows are scored alike, and each is learned from.  Whole texts are read, however long; extra columns of both tables are ignored; an empty
    table gives no rows.
    """
    stats = Workspace(docs.sparkSession, "quality").save(described(docs), "stats")
    return score(stats, fit(stats, labels, **fitting))
