"""Quality rules by line labelling: a linear-chain conditional random field marks each line content or boilerplate.

Each line gives a few indicator features; transitions and features have weights that are trained here by gradient
ascent on the regularised log likelihood.  The lines to learn from are labelled by what the features do not see: a line of
a text that is marked bad is boilerplate, and so is one that stands between ever other lines all over the corpus.
Viterbi decoding labels the lines of a whole text, and the share of its word characters in content lines decides whether
the text is kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded, lean, text_key
from .textstats import DIGIT, GAP, KINDS, LEAD, LOWER, REST, STOP, SYMBOL, UPPER, WordHasher, kinds, pieces, repeat_words

CONTENT, BOILERPLATE = 0, 1
#: Words of notices and page furniture.
FURNITURE = re.compile(rb"copyright|all rights reserved|licen[sc]e|cookie|subscribe|privacy policy|terms of (?:use|service)|sign in|log in|click here|\xc2\xa9", re.I)
FEATURES = 22


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indicators (lines x FEATURES) of the lines of several texts, and of each line the counts of its kinds of bytes, the
    number of its text, and whether an earlier line of the text equals it."""
    split = [t.split(b"\n") for t in texts]
    lines = [line for part in split for line in part]
    n, text = len(lines), np.repeat(np.arange(len(texts)), list(map(len, split)))
    size = np.fromiter(map(len, lines), np.int64, n)
    owner = np.repeat(np.arange(n), size + (np.arange(n) < n - 1))  # a line's own line feed counts with it
    count = np.bincount(owner * KINDS + kinds(b"\n".join(texts)), minlength=n * KINDS).reshape(n, KINDS).astype(float)
    chars = count.sum(axis=1) - count[:, GAP] - count[:, REST]
    some = np.maximum(chars, 1)
    letters = count[:, LOWER] + count[:, UPPER]
    symbols, upper, digits, stops = count[:, SYMBOL] / some, count[:, UPPER] / np.maximum(letters, 1), count[:, DIGIT] / some, count[:, STOP] / some
    again, few, furniture, ended, short_words, long_words, shout = (np.zeros(n, bool) for _ in range(7))
    k = 0
    for part in split:
        seen: set[bytes] = set()
        for line in part:
            again[k] = line in seen
            seen.add(line)
            words = line.split()
            if words:
                few[k] = len(words) >= 8 and 2 * len(set(words)) <= len(words)
                furniture[k] = FURNITURE.search(line) is not None
                last = words[-1]
                ended[k] = last[-1:] in (b".", b"?", b"!", b";", b":") and last[-2:] != b"!!"
                short_words[k], long_words[k] = chars[k] < 3 * len(words), chars[k] > 12 * len(words)
                shout[k] = 2 * line.count(b"!!") >= len(words)
            k += 1
    empty = chars == 0
    x = np.stack([
        np.ones(n, bool), empty, (chars > 0) & (chars < 20), (chars >= 20) & (chars < 60), (chars >= 60) & (chars < 200), chars >= 200,
        symbols >= 0.02, symbols >= 0.08, symbols >= 0.2, (upper >= 0.3) & ~empty, upper >= 0.7, digits >= 0.1, digits >= 0.3, stops >= 0.15,
        (letters + count[:, LEAD]) / some < 0.6, again & ~empty, few, furniture, ended, short_words, long_words, shout,
    ], axis=1)
    return x.astype(np.float64), count, text, again & ~empty


@dataclass
class Chain:
    emit: np.ndarray  # FEATURES x 2
    move: np.ndarray  # 2 x 2
    start: np.ndarray  # 2

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best label sequence; ties go to content."""
        return self.decode(x @ self.emit)

    def decode(self, e: np.ndarray) -> np.ndarray:
        """As ``viterbi``, from the scores of each line's labels."""
        (a, b), back = (self.start + e[0]), []
        (cc, cb), (bc, bb) = self.move.tolist()
        for ec, eb in e[1:].tolist():
            to_c, to_b = a + cc < b + bc, a + cb < b + bb
            back.append((to_c, to_b))
            a, b = (b + bc if to_c else a + cc) + ec, (b + bb if to_b else a + cb) + eb
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return np.array(out[::-1])


class Sequences:
    """Labelled sequences (features, labels) side by side, longest first, so that a place of all is one array."""

    def __init__(self, sequences: list[tuple[np.ndarray, np.ndarray]]):
        sequences = sorted((s for s in sequences if len(s[1])), key=lambda s: -len(s[1]))
        self.length = np.array([len(y) for _, y in sequences])
        self.first = np.concatenate([[0], np.cumsum(self.length)]).astype(int)
        self.x, y = np.concatenate([s[0] for s in sequences]), np.concatenate([s[1] for s in sequences])
        self.live = [int((self.length > t).sum()) for t in range(int(self.length[0]))]
        self.at = [self.first[:k] + t for t, k in enumerate(self.live)]
        self.hot = np.eye(2)[y]
        move = sum((self.hot[self.at[t - 1][: self.live[t]]].T @ self.hot[self.at[t]] for t in range(1, len(self.live))), np.zeros((2, 2)))
        self.wanted = (self.x.T @ self.hot, move, self.hot[self.at[0]].sum(axis=0))

    def slopes(self, chain: Chain, ridge: float) -> tuple[float, list[np.ndarray]]:
        """The log likelihood, less half the ridge times the squared weights, and its slopes by emit, move and start."""
        at, live, e = self.at, self.live, self.x @ chain.emit
        f, b, move = np.zeros((len(e), 2)), np.zeros((len(e), 2)), np.zeros((2, 2))
        f[at[0]] = chain.start + e[at[0]]
        for t in range(1, len(live)):
            before = f[at[t - 1][: live[t]]]
            f[at[t]] = e[at[t]] + np.logaddexp(before[:, :1] + chain.move[0], before[:, 1:] + chain.move[1])
        whole = np.logaddexp(*f[self.first[1:] - 1].T)
        for t in range(len(live) - 1, 0, -1):
            k, prev = live[t], at[t - 1][: live[t]]
            right = e[at[t]] + b[at[t]]
            b[prev] = np.stack([np.logaddexp(chain.move[i, 0] + right[:, 0], chain.move[i, 1] + right[:, 1]) for i in (0, 1)], axis=1)
            move += np.exp(f[prev][:, :, None] + chain.move[None] + right[:, None, :] - whole[:k, None, None]).sum(axis=0)
        p = np.exp(f + b - np.repeat(whole, self.length)[:, None])
        weights, got = (chain.emit, chain.move, chain.start), (self.x.T @ p, move, p[at[0]].sum(axis=0))
        value = sum(float((w * good).sum()) - ridge / 2 * float((w * w).sum()) for w, good in zip(weights, self.wanted)) - float(whole.sum())
        return value, [good - own - ridge * w for w, good, own in zip(weights, self.wanted, got)]


def train(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.3, ridge: float = 1.0) -> Chain:
    """Gradient ascent, each weight's step divided by the root of its squared slopes so far."""
    chain = Chain(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    if not any(len(y) for _, y in sequences):
        return chain
    held, squares = Sequences(sequences), [0.0, 0.0, 0.0]
    for _ in range(rounds):
        _, slopes = held.slopes(chain, ridge)
        for i, (w, slope) in enumerate(zip((chain.emit, chain.move, chain.start), slopes)):
            squares[i] = squares[i] + slope**2
            w += rate * slope / np.sqrt(squares[i] + 1e-9)
    return chain


def spoken_lines(text: Column) -> Column:
    """Hashes of the lines with a word: struct(line, context) in their order; the context is the lines before and after."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))
    pair = lambda h: F.transform(h, lambda x, i: F.struct(x.alias("line"), F.xxhash64(F.get(h, i - 1), F.get(h, i + 1)).alias("context")))
    return F.get(F.transform(F.array(lines), pair), F.lit(0))  # inside a lambda the hashes are computed once


def wandering(docs: DataFrame, wanted: DataFrame, contexts: int = 5) -> DataFrame:
    """``line`` of those of ``wanted(line)`` that stand in at least ``contexts`` contexts, none of which has over half of
    their places: so neither a line of one text nor one of a group of near copies."""
    places = docs.select(F.explode(spoken_lines(F.col("text"))).alias("p")).select("p.line", "p.context").join(wanted, "line", "left_semi")
    each = places.groupBy("line", "context").agg(F.count("*").alias("n"))
    lines = each.groupBy("line").agg(F.count("*").alias("contexts"), F.max("n").alias("most"), F.sum("n").alias("n"))
    return lines.where((F.col("contexts") >= contexts) & (2 * F.col("most") <= F.col("n"))).select("line")


def fit(docs: DataFrame, labels: DataFrame, texts: int = 1500, lines: int = 200, contexts: int = 5) -> Chain:
    """Trains on at most ``texts`` labelled texts, those whose ids hash lowest (all, if fewer), and ``lines`` lines of each:
    of a longer one, eight runs that are spread evenly.

    A document with several labels counts as bad if one of them is; a repeated row counts once.  Null texts have one empty
    line.  Without labels, or with an empty table, all weights are 0 and every line is content.  How often lines stand in
    which contexts is counted over all texts; extra columns of both tables are ignored.
    """
    ws = Workspace(docs.sparkSession, "lines")
    named = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    named = bounded(ws.save(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts), "named"), texts)
    own = docs.select("doc_id", "text").withColumn("k", F.coalesce(text_key(F.col("text")), F.lit(0)))
    keys = own.select("doc_id", "k").join(named, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "k").limit(texts)
    keys = bounded(ws.save(keys, "keys"), texts)
    rows = ws.save(own.join(keys, ["doc_id", "k"]).dropDuplicates(["doc_id", "k"]), "texts")
    placed = rows.select("doc_id", "k", F.posexplode(spoken_lines(F.col("text"))).alias("at", "p")).select("doc_id", "k", "at", "p.line")
    wanted = bounded(ws.save(placed.select("line").distinct(), "wanted"))
    marks = placed.join(ws.save(wandering(docs, wanted, contexts), "wandering"), "line").groupBy("doc_id", "k").agg(F.collect_list("at").alias("marks"))
    rows = rows.join(marks, ["doc_id", "k"], "left").select("doc_id", "k", "text", "quality", "marks")

    def sequences(batches):
        for b in batches:
            out = []
            for i, k, text, quality, marks in zip(*(b.column(c).to_pylist() for c in ("doc_id", "k", "text", "quality", "marks"))):
                x, count, *_ = line_features([(text or "").encode("utf-8", "surrogatepass")])
                y = np.full(len(x), BOILERPLATE if quality == 0 else CONTENT, np.uint8)
                y[np.flatnonzero(x[:, 1] == 0)[marks or []]] = BOILERPLATE
                run = lines // 8
                starts = [0] if len(y) <= lines else [j * (len(y) - run) // 7 for j in range(8)]
                for s in starts:
                    part = slice(s, s + (lines if len(starts) == 1 else run))
                    out.append((i, k, s, np.packbits(x[part].astype(bool)).tobytes(), y[part].tobytes()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.binary()] * 2)], ["doc_id", "k", "at", "x", "y"])

    found = []
    for r in sorted(rows.mapInArrow(lean(sequences), "doc_id long, k long, at long, x binary, y binary").collect()):
        y = np.frombuffer(r.y, np.uint8).astype(int)
        found.append((np.unpackbits(np.frombuffer(r.x, np.uint8), count=len(y) * FEATURES).reshape(len(y), FEATURES).astype(float), y))
    return train(found)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, content_share double, kept boolean"


def judge(docs: DataFrame, chain: Chain, least_share: float = 0.5, least_words: int = 50) -> DataFrame:
    """The base counts and the verdict for every row of ``docs(doc_id, text)``; null texts count as empty.

    content_share is the share of word characters in lines labelled content (1 for a text without words, which fails
    the base rules).  Of label sequences with equal scores, the one with content first counts.  Whole texts are read, a
    megabyte of short ones at a time; repeated rows are judged alike; extra columns are ignored.
    """

    def some(texts: list[bytes], hasher: WordHasher):
        words = [t.split() for t in texts]
        n = np.array(list(map(len, words)))
        repeats = repeat_words(hasher([w for part in words for w in part]), n)
        x, count, text, again = line_features(texts)
        lines = count.sum(axis=1) - count[:, GAP] - count[:, REST]
        e, content = x @ chain.emit, np.zeros(len(x), bool)
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        for lo, hi in zip(ends, ends[1:]):
            content[lo:hi] = chain.decode(e[lo:hi]) == CONTENT
        total = lambda v: np.bincount(text, v, minlength=len(texts))
        chars = total(lines)
        share = np.where(chars > 0, total(lines * content) / np.maximum(chars, 1), 1.0)
        failed = (n < least_words) | (100 * repeats > 50 * n)
        return [*(v.astype(np.int64) for v in (n, chars, total(count[:, SYMBOL]), total(again), repeats)), failed, share, ~failed & (share >= least_share)]

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            found = [some(part, hasher) for part in pieces(data, len)]
            if found:
                cols = [pa.array(np.concatenate(c)) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *cols], [c.split()[0] for c in RULES.split(", ")])

    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(lean(run), RULES)
