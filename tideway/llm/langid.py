"""Language identification with string kernels.

A text is the set of its byte n-grams of lengths 1 to 4 (blended spectrum, presence), hashed to 2^16 places.  The kernel
of two texts is the size of the common set over the root of the product of the sizes.  Nystroem landmarks, drawn evenly
from the languages, give every text a short feature vector; one-versus-rest kernel ridge regression on these vectors
gives a weight for each landmark and language.  Since the kernel is linear in the presence vector, the two products
``presence x landmarks`` and ``kernel x weights`` are multiplied out once, and a batch of texts is scored by one
(sparse) matrix product with the 2^16 x languages result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, bounded, crc_mod, lean, text_key

PLACES = 1 << 16
UNDETERMINED = "und"
MOST_LANGUAGES = 256


class Spectrum:
    """The hashed n-grams of a text as sorted places."""

    def __init__(self, longest: int = 4):
        self.longest, self.mask = longest, np.zeros(PLACES, np.uint8)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        mask = self.mask
        for lo in range(0, max(len(data), 1), 1 << 20):  # blocks overlap by an n-gram; they bound memory only
            part = data[lo : lo + (1 << 20) + self.longest - 1].astype(np.uint32)
            code = np.zeros(len(part), np.uint32)
            for n in range(1, self.longest + 1):
                if len(part) < n:
                    break
                code = code[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :] + np.uint32(1)
                mask[((code ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(16)] = 1
        at = np.flatnonzero(mask)
        mask[at] = 0
        return at


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # PLACES x languages

    def scores(self, spectra: list[np.ndarray]) -> np.ndarray:
        """Ridge outputs, texts x languages; an empty text has zeros."""
        out = np.zeros((len(spectra), len(self.languages)))
        sizes = np.array([len(s) for s in spectra])
        full = np.flatnonzero(sizes)
        if len(full):
            at = np.concatenate([spectra[i] for i in full])
            out[full] = np.add.reduceat(self.weights[at], np.cumsum([0, *sizes[full][:-1]]), axis=0) / np.sqrt(sizes[full])[:, None]
        return out


def chosen(rows: DataFrame, per_language: int, ws: Workspace | None = None) -> DataFrame:
    """lang, doc_id, k of the ``per_language`` different (doc_id, k) of each lang whose hashes are least; all, if there are
    no more.

    Rows that are repeated are one before they are shuffled.  The hashes are cut into 4096 ranges and counted; only rows of
    the ranges up to that in which the number is reached are ordered, so a task sees that number and one range at most.
    """
    ws = ws or Workspace(rows.sparkSession, "langid-chosen")
    keys = rows.select("lang", "doc_id", "k").distinct().withColumn("h", F.xxhash64("doc_id", "k"))
    keys = ws.save(keys.withColumn("range", F.shiftright("h", 52)), "keys")
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keys.groupBy("lang", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranges = bounded(ws.save(ranges.where(F.col("before") < per_language).select("lang", "range"), "ranges"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "k")
    least = keys.join(ranges, ["lang", "range"]).withColumn("r", F.row_number().over(order))
    return least.where(F.col("r") <= per_language).select("lang", "doc_id", "k")


def fit(docs: DataFrame, ws: Workspace, per_language: int = 400, landmarks: int = 256, ridge: float = 0.1, held_out: int = 2, folds: int = 4, most_texts: int = 16_000) -> LanguageModel:
    """Learns from at most ``per_language`` texts of each language, those whose hashes are least, outside the held-out fold.

    Beyond 40 languages there are fewer of each, ``most_texts`` in all; 8 KB of each come to the driver (128 MB at most),
    where blocks of 256 are unpacked at a time, and the landmarks (one of each language at least) as floats, 256 KB each.
    ValueError beyond MOST_LANGUAGES, at which the model that tasks are sent has 64 MB.

    Rows with a null lang or a null doc_id are not learned from; a row that is repeated is learned from once.  Extra
    columns are ignored.
    """
    ok = F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held_out)
    own = docs.select("doc_id", "lang", "text").where(ok).withColumn("k", text_key(F.col("text")))
    n = own.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    picked = bounded(ws.save(chosen(own.select("doc_id", "lang", "k"), max(1, min(per_language, most_texts // max(1, n))), ws), "picked"))
    rows = own.join(picked, ["doc_id", "k", "lang"], "left_semi").dropDuplicates(["doc_id", "k", "lang"])

    def bits(batches):
        spectrum = Spectrum()
        for b in batches:
            packed = []
            for text in b.column("text").to_pylist():
                mask = np.zeros(PLACES, np.uint8)
                mask[spectrum(text)] = 1
                packed.append(np.packbits(mask).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(packed, pa.binary())], ["doc_id", "lang", "bits"])

    got = rows.select("doc_id", "lang", "text").mapInArrow(lean(bits), "doc_id long, lang string, bits binary").collect()
    ws.drop("picked", "keys", "ranges")
    got.sort(key=lambda r: (r.lang, r.doc_id, r.bits))
    languages = sorted({r.lang for r in got})
    if not languages:
        return LanguageModel([], np.zeros((PLACES, 0), np.float32))
    y = np.array([languages.index(r.lang) for r in got])
    packed = np.frombuffer(b"".join(r.bits for r in got), np.uint8).reshape(len(got), -1)
    rows_of = lambda at: np.unpackbits(packed[at], axis=1).astype(np.float32)
    blocks = [np.arange(i, min(i + 256, len(packed))) for i in range(0, len(packed), 256)]
    norm = np.sqrt(np.maximum(np.concatenate([rows_of(at).sum(axis=1) for at in blocks]), 1))
    each = max(1, landmarks // len(languages))
    marks = np.concatenate([np.flatnonzero(y == c)[:each] for c in range(len(languages))])
    land = rows_of(marks) / norm[marks, None]
    k = np.concatenate([(rows_of(at) @ land.T) / norm[at, None] for at in blocks]).astype(np.float64)
    values, vectors = np.linalg.eigh(k[marks])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = k @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y] / len(languages)  # every language counts the same
    left = phi.T @ (phi * weight[:, None]) + ridge / len(packed) * np.eye(phi.shape[1])
    beta = root @ np.linalg.solve(left, phi.T @ (target * weight[:, None]))
    return LanguageModel(languages, (land.T @ beta.astype(np.float32)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_key, lang_pred, score for every row of ``docs(doc_id, text)``, and its columns ``keep`` as
    kept_...

    Null texts and texts without a letter are ``und`` with score 0, as is every text if the model knows no language.
    The score is the share of the best language in the ridge outputs, mapped from [-1, 1] to [0, 1]; of languages with
    equal outputs the first by name is taken.  Whole texts are read, however long; repeated rows are judged alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 x languages floats
    rows = docs.select("doc_id", "text", *[F.col(n).alias(f"kept_{n}") for n in keep]).withColumn("text_key", text_key(F.col("text")))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[rows.schema[f"kept_{n}"] for n in keep]])

    def run(batches):
        spectrum, known = Spectrum(), sent.value
        names = np.array([*known.languages, UNDETERMINED], dtype=object)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo in range(0, len(texts), 256):
                part, own = texts[lo : lo + 256], b.slice(lo, 256)
                lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in part], bool)
                best, score = np.full(len(part), len(names) - 1), np.zeros(len(part))
                if known.languages and lettered.any():
                    p = np.clip((known.scores([spectrum(t) if ok else np.empty(0, np.int64) for t, ok in zip(part, lettered)]) + 1) / 2, 1e-9, 1)
                    best[lettered] = p[lettered].argmax(axis=1)
                    score[lettered] = (p.max(axis=1) / p.sum(axis=1))[lettered]
                cols = [own.column("doc_id"), own.column("text_key"), pa.array(names[best], pa.string()), pa.array(score), *[own.column(f"kept_{n}") for n in keep]]
                yield pa.RecordBatch.from_arrays(cols, out.names)

    found = rows.mapInArrow(lean(run), out)
    return found
