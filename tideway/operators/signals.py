"""Signals of the lag side: momentum, and subspace-regularised principal components of the joint matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def series() -> Window:
    """Each ticker in the order of dates."""
    return Window.partitionBy("universe_id", "ticker").orderBy("date")


def momentum(rets: DataFrame, length: int = 12) -> DataFrame:
    """(universe_id, date, ticker, signal): mean of the ``length`` returns before the date, all present."""
    w = series().rowsBetween(-length, -1)
    rows = rets.where("side = 'lag'").select("universe_id", "date", "ticker", F.count("ret_cc").over(w).alias("n"), F.avg("ret_cc").over(w).alias("signal"))
    return rows.where(c("n") == length).drop("n")


def prior_basis(side: list[int], cyc: list[int]) -> np.ndarray:
    """Three orthonormal columns: the market, lead against lag, cyclical against defensive (side: 1 lead, -1 lag)."""
    vectors = [np.ones(len(side)), np.array(side, float), np.array(cyc, float)]
    out: list[np.ndarray] = []
    for v in vectors:
        for u in out:
            v = v - (u @ v) * u
        size = np.linalg.norm(v)
        out.append(v / size if size > 1e-12 else np.zeros_like(v))
    return np.stack(out, axis=1)


def _unit_diagonal(m: np.ndarray) -> np.ndarray:
    d = np.diag(m).copy()
    d[np.abs(d) < 1e-12] = 1.0
    s = np.sqrt(np.abs(d))
    m = m / np.outer(s, s)
    np.fill_diagonal(m, 1.0)
    return m


def prior_target(rows: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of the long-run correlation that lies in the prior subspace, scaled to a unit diagonal."""
    z = (rows - rows.mean(axis=0)) / (rows.std(axis=0) + 1e-10)
    corr = z.T @ z / len(z)
    return _unit_diagonal(basis @ np.diag(np.diag(basis.T @ corr @ basis)) @ basis.T)


def propagation(z: np.ndarray, target: np.ndarray, leads: int, k: int, lam: float) -> np.ndarray:
    """Propagation matrices (dates x lags x leads) of standardised windows (dates x length x tickers)."""
    corr = np.einsum("dli,dlj->dij", z, z) / z.shape[1]
    at = np.arange(corr.shape[1])
    corr[:, at, at] = 1.0
    mixed = (1 - lam) * corr + lam * target
    mixed[:, at, at] = 1.0
    _, vectors = np.linalg.eigh(mixed)
    top = vectors[:, :, -k:]
    return np.einsum("dik,djk->dij", top[:, leads:], top[:, :leads])


def momentum_grid(rets: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(universe_id, date, length, ticker, signal): ``momentum`` for several lengths, from one sort of each series."""
    rows = rets.where("side = 'lag'")
    over = lambda n: series().rowsBetween(-n, -1)
    rows = rows.select("universe_id", "date", "ticker", *[x.alias(f"{k}{n}") for n in lengths for k, x in (("n", F.count("ret_cc").over(over(n))), ("s", F.avg("ret_cc").over(over(n))))])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), c(f"n{n}").alias("n"), c(f"s{n}").alias("signal")) for n in lengths]))
    rows = rows.select("universe_id", "date", "ticker", each.alias("g"))
    return rows.where(c("g.n") == c("g.length")).select("universe_id", "date", "g.length", "ticker", "g.signal")


def moments(x: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and correlation of the ``length`` rows before each row of ``at``.

    All come from prefix sums of the rows and of their outer products, so a further length costs two differences.  What is
    left of a column that does not move is rounding; it counts as zero.
    """
    centre = x.mean(axis=0)
    y = x - centre
    first = np.concatenate([np.zeros((1, y.shape[1])), np.cumsum(y, axis=0)])
    second = np.concatenate([np.zeros((1, y.shape[1], y.shape[1])), np.cumsum(y[:, :, None] * y[:, None, :], axis=0)])
    mean = (first[at] - first[at - length]) / length
    cov = (second[at] - second[at - length]) / length - mean[:, :, None] * mean[:, None, :]
    var = np.einsum("dii->di", cov)
    still = var <= 1e-12 * (y * y).mean(axis=0)
    cov = np.where(still[:, :, None] | still[:, None, :], 0.0, cov)
    sd = np.sqrt(np.where(still, 0.0, var)) + 1e-10
    return mean + centre, sd, cov / (sd[:, :, None] * sd[:, None, :])


def _packed(rows: DataFrame, names: DataFrame, margin: int, pretrain: int) -> tuple[DataFrame, int]:
    """Blocks of dates, each with ``margin`` rows before it, the tickers and the first ``pretrain`` rows of its universe; and
    the number of dates of a block."""
    vectors = rows.groupBy("universe_id", "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ret"))), lambda s: s["ret"]).alias("x"))
    order = Window.partitionBy("universe_id").orderBy("date")
    vectors = vectors.withColumn("r", F.row_number().over(order) - 1)
    kinds = names.groupBy("universe_id").agg(F.array_sort(F.collect_list(F.struct("ord", "ticker", "side", "cyc"))).alias("names"))
    first = vectors.where(c("r") < pretrain).groupBy("universe_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda s: s["x"]).alias("early"))
    size = max(4 * margin, 64)
    blocks = vectors.select("universe_id", "date", "r", "x", F.explode(F.array_distinct(F.array(F.expr(f"r div {size}"), F.expr(f"(r + {margin}) div {size}")))).alias("block"))
    packed = blocks.groupBy("universe_id", "block").agg(F.array_sort(F.collect_list(F.struct("r", "date", "x"))).alias("rows"))
    return packed.join(kinds, "universe_id").join(first, "universe_id"), size


def subspace_grid(rows: DataFrame, names: DataFrame, lengths: tuple[int, ...], lams: tuple[float, ...], k: int = 3, pretrain: int = 36) -> DataFrame:
    """(universe_id, date, length, lambda, ticker, signal): ``subspace_signals`` for several lengths and weights of the prior.

    One pass over the joint matrix ``rows``: a block of dates is read once for all lengths, whose windows come from prefix
    sums, and the weights are an axis of one batched eigen solve.
    """
    packed, size = _packed(rows, names, max(lengths), pretrain)

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for universe, block, part, name, early in zip(*(b.column(n).to_pylist() for n in ("universe_id", "block", "rows", "names", "early"))):
                side = [1 if n["side"] == "lead" else -1 for n in name]
                leads, lags = side.count(1), [n["ticker"] for n, s in zip(name, side) if s < 0]
                target = prior_target(np.array(early, float), prior_basis(side, [n["cyc"] for n in name]))
                x = np.nan_to_num(np.array([p["x"] for p in part], float), nan=0.0, posinf=0.0, neginf=0.0)
                for length in lengths:
                    at = np.array([i for i, p in enumerate(part) if p["r"] // size == block and i >= length and part[i - length]["r"] == p["r"] - length], int)
                    if not len(at):
                        continue
                    mean, sd, corr = moments(x, at, length)
                    diagonal = np.arange(corr.shape[1])
                    corr[:, diagonal, diagonal] = 1.0
                    weight = np.array(lams)[:, None, None, None]
                    mixed = (1 - weight) * corr[None] + weight * target  # weights x dates x tickers x tickers
                    mixed[:, :, diagonal, diagonal] = 1.0
                    top = np.linalg.eigh(mixed)[1][..., -k:]
                    z = ((x[at] - mean) / sd)[:, :leads]
                    signal = np.einsum("wdik,wdjk,dj->wdi", top[:, :, leads:], top[:, :, :leads], z)
                    dates = [part[i]["date"] for i in at]
                    n, many = len(lags), len(lags) * len(dates)
                    for w, lam in enumerate(lams):
                        values = ([universe] * many, [d for d in dates for _ in range(n)], [length] * many, [lam] * many, lags * len(dates), signal[w].ravel().tolist())
                        for column, more in zip(out, values):
                            column += more
            kinds_ = (pa.string(), pa.date32(), pa.int32(), pa.float64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds_)], ["universe_id", "date", "length", "lambda", "ticker", "signal"])

    return packed.mapInArrow(run, "universe_id string, date date, length int, lambda double, ticker string, signal double")


def subspace_signals(rows: DataFrame, names: DataFrame, length: int = 12, k: int = 3, lam: float = 0.9, pretrain: int = 36, matrix: bool = False) -> DataFrame:
    """Signals of the lag tickers for each date with ``length`` joint rows before it.

    ``rows`` is a joint matrix in long form, ``names`` its tickers (universe_id, ticker, ord, side, cyc).  The rows of a
    date become one vector; dates are dealt to blocks with a margin of ``length`` rows before each, so that a block is
    all a task needs, and a row is copied to two blocks at most, not to ``length`` windows.  The prior target is fitted
    on the first ``pretrain`` rows of each universe.  With ``matrix`` the propagation matrix is returned in long form.
    """
    packed, size = _packed(rows, names, length, pretrain)

    def run(batches):
        for b in batches:
            out = []
            for universe, block, part, name, early in zip(*(b.column(n).to_pylist() for n in ("universe_id", "block", "rows", "names", "early"))):
                side = [1 if n["side"] == "lead" else -1 for n in name]
                leads = side.count(1)
                target = prior_target(np.array(early, float), prior_basis(side, [n["cyc"] for n in name]))
                x = np.nan_to_num(np.array([p["x"] for p in part], float), nan=0.0, posinf=0.0, neginf=0.0)
                at = [i for i, p in enumerate(part) if p["r"] // size == block and i >= length and part[i - length]["r"] == p["r"] - length]
                if not at:
                    continue
                w = np.stack([x[i - length : i] for i in at])
                mu, sd = w.mean(axis=1), w.std(axis=1) + 1e-10
                m = propagation((w - mu[:, None]) / sd[:, None], target, leads, k, lam)
                z = (x[at] - mu) / sd
                signal = np.einsum("dij,dj->di", m, z[:, :leads])
                for d, i in enumerate(at):
                    for j, n in enumerate(name[leads:]):
                        if matrix:
                            out += [(universe, part[i]["date"], n["ticker"], name[u]["ticker"], float(m[d, j, u])) for u in range(leads)]
                        else:
                            out.append((universe, part[i]["date"], n["ticker"], float(signal[d, j])))
            cols = list(zip(*out)) or [()] * (5 if matrix else 4)
            kinds_ = [pa.string(), pa.date32(), pa.string()] + ([pa.string(), pa.float64()] if matrix else [pa.float64()])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds_)], ["universe_id", "date", "ticker"] + (["lead", "weight"] if matrix else ["signal"]))

    kind = "universe_id string, date date, ticker string, " + ("lead string, weight double" if matrix else "signal double")
    return packed.mapInArrow(run, kind)
