"""Spelling variants: all pairs of words that are one edit apart, by merging the subtrees of their trie.

The trie's heavy paths follow, at each node, the child with most words.  Two words part at one node, where at least one of
them goes on to a light child or ends; a word has no more such edges than the logarithm of the number of words.  So each
light subtree is merged, small into large, with what else hangs on its node: with its first character skipped, with the
heavy character before it, with the heavy character in its place (each is looked up among the words), and with the other
light subtrees, whose words meet where the rest after the first character is the same.  Terminals that coincide are the
pairs, each found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded, lean

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One of so many (document, run) loses a code point.
ERRATA = 199
#: A word's form must occur so many times as often.
DOMINANCE = 5
#: Words that a task counts before it passes them on.
HELD = 200_000
#: A node with more than one of so many words is large; there are at most so many of one depth.
LARGE = 500
PIECE = 1 << 20

_RUN = re.compile("[a-zÀ-ÿ]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def runs(text: bytes | None) -> Iterator[list[str]]:
    """Maximal runs of letters, A-Z lower-cased, a piece of the text at a time; a piece ends with a run's end."""
    whole, at = (text or b"").lower().decode("utf-8", "replace"), 0
    while at < len(whole):
        end = at + PIECE
        if end < len(whole) and (tail := _RUN.match(whole, end)):
            end = tail.end()
        yield _RUN.findall(whole, at, end)
        at = end


def errata(doc_id: int | None, counts: Counter, rate: int = ERRATA) -> Iterator[tuple[str, int]]:
    """The runs of a document, one of ``rate`` of them without one code point; a null id is empty in the checksum."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), head)
        if h % rate == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, rate: int = ERRATA) -> DataFrame:
    """(word, n) of all words of ``docs(doc_id, text)`` with enough code points and occurrences.

    Words are counted in the tasks before they are shuffled, so that the most frequent is a row for each task.
    """

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own: Counter = Counter()
                for part in runs(text):
                    own.update(part)
                for word, n in errata(doc_id, own, rate):
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def edges(words: DataFrame) -> DataFrame:
    """(wid, at, node, child): each edge of a word's path in the trie, its end included (an empty child).

    ``node`` is a hash of the prefix.  Prefixes that share one share a heavy child; that costs lookups, but no pair.
    """

    def run(batches):
        for b in batches:
            text = b.column("word").to_pylist()
            sizes = np.fromiter(map(len, text), np.int64, len(text))
            if not len(text):
                continue
            chars = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.uint64)
            starts = np.cumsum(sizes) - sizes
            inside = np.arange(len(chars)) - np.repeat(starts, sizes)
            power = np.cumprod(np.full(max(1, int(sizes.max())), _ODD, np.uint64))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars + np.uint64(1)) * power[inside])])
            at = np.arange(len(chars) + len(text)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)  # 0 .. length of each word
            first = np.repeat(starts, sizes + 1)
            node = (total[first + at] - total[first] + at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
            child = [c for w in text for c in (*w, "")]
            wid = np.repeat(b.column("wid").to_numpy(), sizes + 1)
            for lo in range(0, len(child), 1 << 16):
                hi = lo + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(wid[lo:hi]), pa.array(at[lo:hi].astype(np.int32)), pa.array(node[lo:hi]), pa.array(child[lo:hi], pa.string())], ["wid", "at", "node", "child"])

    return words.select("wid", "word").mapInArrow(lean(run), "wid long, at int, node long, child string")


def one_edit_pairs(words: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(a, na, b, nb): every pair of ``words(word, n)`` that one inserted, deleted or replaced code point makes equal.

    ``words`` are distinct.  Each pair is there once, in either order.  Large nodes, at most LARGE of a depth, are
    broadcast if their measured size is bounded, so no node's words meet in one task.  Null words are in no pair; an empty
    table gives no rows; other columns are ignored.
    """
    ws = ws or Workspace(words.sparkSession, "spelling")
    words = ws.save(words.where("word is not null").select("word", "n").withColumn("wid", F.monotonically_increasing_id()), "words")
    paths = ws.save(edges(words), "edges")
    kids = paths.groupBy("node", "child").agg(F.count("*").alias("size"))
    nodes = kids.groupBy("node").agg(F.count("*").alias("kids"), F.sum("size").alias("size"), F.max(F.when(F.col("child") != "", F.struct("size", "child"))).alias("most"))
    nodes = ws.save(nodes.where("kids > 1").select("node", "size", F.col("most.child").alias("heavy")), "nodes")
    large = F.col("size") * LARGE > words.count()
    light = paths.join(bounded(ws.save(nodes.where(large).select("node", "heavy"), "large")), "node").unionByName(paths.join(nodes.where(~large).select("node", "heavy"), "node"))
    light = light.where("child <> heavy").select("wid", "at", "child", "heavy")
    word, at, c, h = F.col("word"), F.col("at"), F.col("child"), F.col("heavy")
    light = light.join(words, "wid").withColumns({"head": F.substring(word, F.lit(1), at), "rest": F.substring(word, at + 2, F.length(word))})
    light = ws.save(light.select(word.alias("a"), F.col("n").alias("na"), "head", "child", "rest", "heavy"), "light")
    inner, rest, head = c != "", F.col("rest"), F.col("head")
    skipped = F.when(inner & (F.substring(rest, 1, 1) != c), F.concat(head, rest))  # else they part further on
    replaced, grown = F.when(inner, F.concat(head, h, rest)), F.concat(head, h, c, rest)
    ways = light.select("a", "na", F.explode(F.array_compact(F.array(skipped, replaced, grown))).alias("b"))
    pairs = ways.join(words.select(word.alias("b"), F.col("n").alias("nb")), "b").select("a", "na", "b", "nb")
    merged = light.where(inner).select("a", "na", "head", "rest")  # one row a letter at most for each head and rest
    others = merged.select(F.col("a").alias("b"), F.col("na").alias("nb"), "head", "rest")
    return pairs.unionByName(merged.join(others, ["head", "rest"]).where("a < b").select("a", "na", "b", "nb"))


def variants(words: DataFrame, dominance: int = DOMINANCE, ws: Workspace | None = None) -> DataFrame:
    """word, n, form, form_n, root, n_near of ``words(word, n)``.

    The form is the near word that occurs most (ties: the first in code-point order), if it does so ``dominance`` times as
    often as the word; the root is where forms lead to.  A form occurs that many times as often, so paths are short and are
    followed in doubling steps.
    """
    ws = ws or Workspace(words.sparkSession, "spelling")
    words = ws.save(words.where("word is not null").select("word", "n"), "vocabulary")
    pairs = ws.save(one_edit_pairs(words, ws), "pairs")
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form"))).alias("m"))
    best = best.select("word", "n_near", F.col("m.form").alias("form"), (-F.col("m.less")).alias("form_n"))
    rows = words.join(best, "word", "left")
    enough = F.col("form_n") >= dominance * F.col("n")
    rows = ws.save(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "rows")
    up, step = ws.save(rows.where("form is not null").select("word", F.col("form").alias("root")), "up-0"), 0
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        step += 1
        jumped = ws.save(up.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), f"up-{step}")
        up = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
