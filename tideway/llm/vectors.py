"""Vector codes: a product quantiser in whole numbers, fitted by rounds of assignment with annular norm pruning.

The entries of a codebook are sorted by their norms.  The distance of a part to the entry whose norm is next to its own
bounds how far the norm of a nearer entry can be from the part's; a binary search gives that annulus of entries, and all in
it, its edges included, are compared exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Workspace, lean, table_bytes

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole numbers are kept within plus and minus this, and errors within a long.
MOST, LONG = 1 << 40, (1 << 63) - 1
#: A label with more than one of so many rows is large; its sum is broadcast.
LARGE = 1000


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (ties: the lower) and its squared distance, both exact."""
    peak = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * peak) ** 2 >= 1 << 58:  # too large for squares and their sums as long
        x, entries = x.astype(object), entries.astype(object)
    norm = lambda v: np.sqrt((v * v).sum(axis=1).astype(float))
    order = np.argsort(norm(entries), kind="stable")
    ring, own = norm(entries)[order], norm(x)
    at = np.searchsorted(ring, own)
    left = np.maximum(at - 1, 0)
    at = np.minimum(at, len(ring) - 1)
    at = np.where(own - ring[left] < ring[at] - own, left, at)
    best, where = _squares(x, entries[order[at]]), order[at]
    reach = np.sqrt(best.astype(float)) * (1 + 1e-9) + 1e-9 * (own + ring[-1]) + 1e-6  # what rounding may take off
    low, high = np.searchsorted(ring, own - reach, "left"), np.searchsorted(ring, own + reach, "right")
    for k in range(len(ring)):
        rows = np.flatnonzero((low <= k) & (k < high) & (at != k))
        if len(rows):
            d = _squares(x[rows], entries[order[k]])
            closer = (d < best[rows]) | ((d == best[rows]) & (order[k] < where[rows]))
            best[rows[closer]], where[rows[closer]] = d[closer], order[k]
    return where, best


def whole_numbers(vectors: DataFrame, ws: Workspace, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label, x (array<long>, floor(scale * component)) of the rows that are kept, saved.

    Left out: vectors that are null, empty, or hold a null or non-finite component, and those whose length is not that of
    most kept rows (ties: the least length).  Lengths that ``parts`` does not divide are filled up with zeros, which
    changes no distance.  Whole numbers beyond MOST become MOST.
    """
    v = F.col("embedding")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(good)
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = lengths[0].d if lengths else 0
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(MOST))), F.lit(float(MOST)))))
    fill = F.array_repeat(F.lit(0).cast("long"), -d % parts)
    return ws.save(rows.where(F.size("embedding") == d).select("vec_id", "label", F.concat(whole, fill).alias("x")), "whole")


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def first_entries(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the rows with the smallest ids (nulls last, ties by the vector): parts x entries x width."""
    found = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    x = np.array([r.x for r in found], np.int64)
    return x.reshape(len(found), parts, -1).transpose(1, 0, 2)


def _each(x: np.ndarray, books: np.ndarray):
    split = x.reshape(len(x), len(books), -1)
    for p, book in enumerate(books):
        yield p, split[:, p], *nearest(split[:, p], book)


def trained(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds: every entry becomes the floor of the mean of its parts, or stays if it has none.

    A round is one scan; a task sends one row for each part, entry and position, the sum of what it has seen.
    """
    books = books.copy()
    parts, entries, width = books.shape
    for _ in range(rounds):

        def run(batches, books=books):
            total, count = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                for p, part, where, _ in _each(_matrix(b.column("x")), books):
                    count[p] += np.bincount(where, minlength=entries)
                    some = np.zeros((entries, width), np.int64)  # a batch has few rows
                    np.add.at(some, where, part)
                    total[p] += some
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array([[str(v) for v in total[i, j]] for i, j in zip(p, e)], pa.list_(pa.string()))], ["part", "entry", "n", "total"])

        sums = rows.select("x").mapInArrow(lean(run), "part int, entry int, n long, total array<string>")
        each = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "v"))
        found = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # parts x entries x width rows
        for r in found:
            books[r.part, r.entry, r.at] = int(r.v) // r.n
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over the parts)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            codes, error = [], 0
            for _, _, where, best in _each(_matrix(b.column("x")), books):
                codes.append(where)
                error = error + best
            text = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array([min(e, LONG) for e in error.tolist()], pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "x").mapInArrow(lean(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error (errors summed over equal labels, nulls together) and codebooks_sha256 of each
    kept row of ``vectors(vec_id, embedding, label)``.

    What is kept: see ``whole_numbers``.  Fewer rows than entries give as many entries as rows; null ids come last, ties of
    ids by the vector, ties of distances go to the lower entry; repeated rows are judged alike.  An empty table, or one
    without a kept row, gives no rows.  Extra columns are ignored.  The codebooks, ``entries`` vectors, are all that tasks
    share; sums of large labels are broadcast, those of others joined by a shuffle if there are many.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part, so 1 to 256 entries")
    ws = Workspace(vectors.sparkSession, "vectors")
    rows = whole_numbers(vectors, ws, scale, parts)
    if rows.isEmpty():
        none = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.select("*", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = trained(rows, first_entries(rows, parts, entries), rounds)
    coded = ws.save(encoded(rows, books), "coded")
    sums = ws.save(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error"), F.count("*").alias("rows")), "sums").withColumnRenamed("label", "of")
    same = F.col("label").eqNullSafe(F.col("of"))
    if table_bytes(sums) <= BROADCAST_BYTES:
        out = coded.join(F.broadcast(sums), same)
    else:
        large = F.col("rows") * LARGE > coded.count()
        big = sums.where(large)  # fewer than LARGE
        left = coded.join(F.broadcast(big), same, "left_anti")
        out = coded.join(F.broadcast(big), same).unionByName(left.join(sums.where(~large), same))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
