"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND.

The inverted index holds, for each term, the items with the term and their BM25 impacts, divided by the item's score
against itself, so that a passage with the whole item scores 1 and one threshold fits items of every length.  Items
lie in blocks of one length class, and each term keeps its largest impact in each block that has it.  For each class a
document is cut into half passages, as long as half of the class's longest items; two neighbours are a passage, so that
each stretch of text is whole in some passage up to half its length, and what an item is compared with depends on its own
length alone.  The sum of a passage's block maxima, computed for many passages of a document at once, bounds the score of
every item of the block; only blocks whose bound reaches the threshold are walked by WAND, which moves its postings to the
next item that can still reach it.  There is no top-k: all items above the threshold are retrieved.  Each is then verified
by the shares
of the five-word shingles of its question and of its answer that stand in the passage and its neighbourhood: that of the
question, that of both together, or that of an answer of at least five words must reach the overlap.

Impacts are computed by Spark from the statistics of all items.  The index is dealt into parts of bounded size, which
tasks build and leave in the shared folder; documents are scanned once, and every task reads the parts from there.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lean, text_key
from .textstats import WordHasher, pieces
from .warc import open_folder

#: Letters and digits stay, other ASCII bytes part words, other bytes belong to words.
_CLEAN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
BLOCK = 4
OVERLAP_WORDS = 5
#: Bounds that are held at once, and words of the documents that are searched together (or one document).
BOUNDS, WORDS = 1 << 20, 1 << 18
#: The half passage of the shortest items.
LEAST_HALF = 16
#: Bytes of an index that a task holds, and of texts that meet each part before the next one is read where it can't hold all.
MOST_HELD, GROUP_BYTES = 96 << 20, 32 << 20
_next_item = itemgetter(0)


def terms(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence or line of an item is its answer; an item of one sentence is all question."""
    parts = [p for p in map(terms, re.split(r"(?<=[.!?])\s+|\n+", text)) if p]
    return (sum(parts[:-1], []), parts[-1]) if len(parts) > 1 else (parts[0] if parts else [], [])


def shingles(words: list[bytes], n: int = OVERLAP_WORDS) -> set[tuple[bytes, ...]]:
    """Runs of n words; a shorter sequence as a whole."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Near:
    """The words about a passage; its shingles of each length are made once, for all items."""

    def __init__(self, words: list[bytes]):
        self.words, self.made = words, {}

    def share(self, wanted: set[tuple[bytes, ...]]) -> float:
        """Share of the wanted shingles, all of one length, that the words hold."""
        n = len(next(iter(wanted)))
        if n not in self.made:
            self.made[n] = shingles(self.words, n)
        return len(wanted & self.made[n]) / len(wanted)


def impact(n, length, df, items, mean, k1: float, b: float):
    """BM25 weight of a term with n places in an item of ``length`` terms; numbers or columns."""
    log = F.log if isinstance(df, Column) else np.log
    return log(1 + (items - df + 0.5) / (df + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * length / mean))


def half_of(length: int) -> int:
    """Words of half a passage for an item of so many words: its length class."""
    return max(LEAST_HALF, 1 << (-(-length // 2) - 1).bit_length())


class Maxima:
    """The largest impact of each term in each block that has it, by rows of terms; only those are kept."""

    def __init__(self, term: np.ndarray, block: np.ndarray, impact: np.ndarray, terms: int, blocks: int):
        at, where = np.unique(term.astype(np.int64) * max(1, blocks) + block, return_inverse=True)
        self.values, self.blocks = np.zeros(len(at), np.float32), blocks
        np.maximum.at(self.values, where, impact.astype(np.float32))
        self.block = (at % max(1, blocks)).astype(np.int32)
        self.ends = np.searchsorted(at // max(1, blocks), np.arange(terms + 1))

    def of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For an array of terms: the place in it, the block and the value of each entry of theirs."""
        n = self.ends[term + 1] - self.ends[term]
        at = np.arange(n.sum()) + np.repeat(self.ends[term] - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(term)), n), self.block[at], self.values[at]

    def __getitem__(self, term) -> np.ndarray:
        """Rows of terms over all blocks."""
        many = np.atleast_1d(np.asarray(term, np.int64))
        row, block, value = self.of(many)
        out = np.zeros((len(many), self.blocks), np.float32)
        out[row, block] = value
        return out if np.ndim(term) else out[0]


class ItemIndex:
    """A part of the index: items (item_id, text, {hash of a term: impact}), whose impacts sum to one for each item.

    The items of a length class fill blocks of their own; the last one may have empty places.
    """

    def __init__(self, items: list[tuple[int, str, dict[int, float]]]):
        found: dict[int, list] = {}
        for n, x in sorted(((len(terms(x[1])), x) for x in items), key=lambda x: (x[0], *x[1][:2])):
            found.setdefault(half_of(n), []).append(x)
        places, self.classes = [], []  # (half, first block, last)
        for half, own in sorted(found.items()):
            first = len(places) // BLOCK
            places += own + [(None, "", {})] * (-len(own) % BLOCK)
            self.classes.append((half, first, len(places) // BLOCK))
        self.ids, self.texts = [i for i, _, _ in places], [t for _, t, _ in places]
        rows = sorted((t, k, x) for k, (_, _, own) in enumerate(places) for t, x in own.items())
        self.vocabulary = np.unique(np.array([t for t, _, _ in rows], np.uint64))
        term = np.searchsorted(self.vocabulary, np.array([t for t, _, _ in rows], np.uint64))
        self.ends = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.items, self.impacts = np.array([k for _, k, _ in rows], np.int32), np.array([x for _, _, x in rows], float)
        self.most = np.zeros(len(self.vocabulary))
        np.maximum.at(self.most, term, self.impacts)
        self.block_most = Maxima(term, self.items // BLOCK, self.impacts, len(self.vocabulary), len(places) // BLOCK)
        self.lists, self.wanted, self.known = {}, {}, {}

    @classmethod
    def of(cls, items: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75) -> ItemIndex:
        """Of a few items that are all there are."""
        hasher = WordHasher()
        counts = [(i, t, Counter(hasher(terms(t)).tolist())) for i, t in items if terms(t)]
        df = Counter(t for _, _, own in counts for t in own)
        mean = sum(own.total() for _, _, own in counts) / max(1, len(counts))
        out = []
        for i, t, own in counts:
            x = {h: impact(n, own.total(), df[h], len(counts), mean, k1, b) for h, n in own.items()}
            total = sum(x.values())
            out.append((i, t, {h: v / total for h, v in x.items()}))
        return cls(out)

    def __getstate__(self):
        return self.__dict__ | {"lists": {}, "wanted": {}, "known": {}}

    def numbers(self, words: list[list[bytes]], n: int) -> np.ndarray:
        """The term of each of the n words, one after the other; -1 for those that no item has."""
        if not self.known:
            own = sorted({w for t in self.texts for w in terms(t)})
            at = np.searchsorted(self.vocabulary, WordHasher(len(own))(own))
            self.known = dict(zip(own, at.tolist()))
        return np.fromiter(map(self.known.get, chain.from_iterable(words), repeat(-1)), np.int64, n)

    def postings(self, t: int) -> tuple[list[int], list[float]]:
        if t not in self.lists:
            lo, hi = self.ends[t : t + 2]
            self.lists[t] = self.items[lo:hi].tolist(), self.impacts[lo:hi].tolist()
        return self.lists[t]

    def shingles_of(self, item: int) -> tuple[set, set]:
        """Those of the question and of the answer of an item."""
        if item not in self.wanted:
            if len(self.wanted) >= 5000:
                self.wanted.clear()
            self.wanted[item] = tuple(map(shingles, question_and_answer(self.texts[item])))
        return self.wanted[item]

    def search(self, query: list[int], threshold: float, blocks: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items of the given blocks (ascending) that the terms of the query score to the threshold."""
        end, out = len(self.ids), []
        lists = []  # [next item, position, items, impacts, term]
        for t in query:
            items, impacts = self.postings(t)
            k = bisect_left(items, blocks[0] * BLOCK)
            if k < len(items):
                lists.append([items[k], k, items, impacts, t])

        def skip(p, to):
            p[1] = k = bisect_left(p[2], to, p[1])
            p[0] = p[2][k] if k < len(p[2]) else end

        most, block_most = {p[4]: float(self.most[p[4]]) for p in lists}, dict(zip(query, self.block_most[query]))
        while True:
            lists = sorted((p for p in lists if p[0] < end), key=_next_item)
            bound, pivot = 0.0, -1
            for k, p in enumerate(lists):
                bound += most[p[4]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block, k = item // BLOCK, bisect_left(blocks, item // BLOCK)
            if k == len(blocks):
                return out
            if blocks[k] != block:  # the bounds of all blocks up to the next given one are too low
                for p in lists:
                    if p[0] < blocks[k] * BLOCK:
                        skip(p, blocks[k] * BLOCK)
            elif sum(block_most[p[4]][block] for p in lists[: pivot + 1]) < threshold * 0.9999:
                # no item before the next block, or before the next list's item, can reach the threshold
                to = max(item + 1, min((block + 1) * BLOCK, lists[pivot + 1][0] if pivot + 1 < len(lists) else end))
                for p in lists[: pivot + 1]:
                    skip(p, to)
            elif lists[0][0] == item:
                score = sum(p[3][p[1]] for p in lists[: pivot + 1])
                if score >= threshold:
                    out.append((item, score))
                for p in lists[: pivot + 1]:
                    skip(p, item + 1)
            else:
                for p in lists[:pivot]:
                    skip(p, item)

    def matches(self, words: list[list[bytes]], threshold: float, overlap: float, first: bool = False) -> list[dict]:
        """For each document, a list of its words, {item: ((both overlaps, question overlap, score), answer overlap)} of its verified items, at the
        best passage of each.  With ``first``, a document that has one is not searched on.

        The passages of all documents given are bounded together.  Every retrieved passage is verified: one that scores as
        high may hold the item's words in another order.
        """
        best: list[dict[int, tuple[tuple[float, float, float], float]]] = [{} for _ in words]
        sizes, none = np.array([len(w) for w in words], np.int64), len(self.vocabulary)
        if not none or not sizes.sum():
            return best
        tid = self.numbers(words, int(sizes.sum()))
        known = np.flatnonzero(tid >= 0)
        tid = tid[known]
        doc = np.repeat(np.arange(len(words)), sizes)[known]
        place = known - (np.cumsum(sizes) - sizes)[doc]
        for half, low, high in self.classes:
            halves = sizes // half + 2  # the last one is empty, so that no passage spans two documents
            starts = np.cumsum(halves) - halves
            slots = np.unique((starts[doc] + place // half) * none + tid)  # distinct terms of each half
            at, term = slots // none, slots % none
            step = max(1, min(int(halves.sum()), BOUNDS // (high - low)))
            for lo in range(0, int(halves.sum()), step):  # the bounds of so many passages are held at once
                part = slice(*np.searchsorted(at, (lo, lo + step + 1)))
                row, block, value = self.block_most.of(term[part])
                own = (low <= block) & (block < high)
                where = (at[part] - lo)[row[own]] * (high - low) + block[own] - low
                bound = np.bincount(where, value[own], (step + 1) * (high - low)).reshape(step + 1, high - low)
                bound = bound[:-1] + bound[1:]  # of the passage of a half and the next
                for g in lo + np.flatnonzero((bound >= threshold * 0.9999).any(axis=1)):
                    i = int(np.searchsorted(starts, g, "right")) - 1
                    if first and best[i]:
                        continue
                    h = int(g - starts[i])
                    query = np.unique(term[np.searchsorted(at, g) : np.searchsorted(at, g + 2)])
                    exact = self.block_most[query][:, low:high].sum(axis=0)  # a term of both halves counts once
                    blocks = low + np.flatnonzero(exact >= threshold * 0.9999)
                    near = Near(words[i][max(0, (h - 2) * half) : (h + 4) * half])
                    for item, score in self.search(query.tolist(), threshold, blocks.tolist()) if len(blocks) else ():
                        question, answer = self.shingles_of(item)
                        asked = near.share(question)
                        answered = near.share(answer) if answer else asked
                        both = (asked * len(question) + answered * len(answer)) / (len(question) + len(answer))
                        long = len(next(iter(answer), ())) == OVERLAP_WORDS  # a few words are found anywhere
                        if (asked >= overlap or both >= overlap or long and answered >= overlap) and (both, asked, score) > best[i].get(item, ((),))[0]:
                            best[i][item] = ((both, asked, score), answered)
        return best

    def hits(self, found: dict) -> list[tuple[int, float, float, float]]:
        return [(self.ids[item], score, asked, answered) for item, ((_, asked, score), answered) in found.items()]

    def found(self, text: str | None, threshold: float = 0.5, overlap: float = 0.5) -> list[tuple[int, float, float, float]]:
        words = terms(text)
        return self.hits(self.matches([words], threshold, overlap)[0])


def build(benchmark: DataFrame, ws: Workspace, k1: float, b: float, part_items: int) -> list[tuple[str, int]]:
    """Files, with their sizes, of the parts of an index of all ``benchmark(item_id, text)``, of about ``part_items`` items
    each.

    Equal rows count once; rows without an id, a text or a term are left out.  Extra columns are ignored.
    """

    def counted(batches):
        hasher = WordHasher()
        for batch in batches:
            rows = [Counter(hasher(terms(t)).view(np.int64).tolist()) for t in batch.column("text").to_pylist()]
            cols = [batch.column("item_id"), batch.column("text"), pa.array([list(r.items()) for r in rows], pa.map_(pa.int64(), pa.int64())), pa.array([r.total() for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["item_id", "text", "terms", "length"])

    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    items = items.mapInArrow(lean(counted), "item_id long, text string, terms map<long,long>, length long").where("length > 0")
    items = ws.save(items.withColumn("row", F.monotonically_increasing_id()), "items")
    n, words = items.agg(F.count("*"), F.sum("length")).first()
    if not n:
        return []
    each = items.select("row", "length", F.explode("terms").alias("term", "n"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    x = impact(F.col("n"), F.col("length"), F.col("df"), n, words / n, k1, b)
    rows = each.join(df, "term").groupBy("row").agg(F.collect_list(F.struct("term", x.alias("x"))).alias("x"))
    parts = -(-n // part_items)
    rows = items.select("row", "item_id", "text").join(rows, "row").withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))

    def indexed(table):
        own = []
        for i, t, x in zip(*(table.column(c).to_pylist() for c in ("item_id", "text", "x"))):
            total = sum(sorted(v["x"] for v in x))
            own.append((i, t, {v["term"] % 2**64: v["x"] / total for v in x}))
        data = pickle.dumps(ItemIndex(own))
        return pa.table({"part": table.column("part").slice(0, 1), "data": pa.array([data], pa.binary())})

    made = rows.groupBy("part").applyInArrow(indexed, "part int, data binary")
    path = f"{ws.root}/index"
    made.repartition(parts, "part").write.option("maxRecordsPerFile", 1).parquet(path)
    files = ws.spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
    return sorted((r.f, r.n) for r in files.collect())


class Parts:
    """The parts of an index in a task: those read last are held, up to MOST_HELD bytes of them or one.

    Block maxima are kept where there are any, so an index of 100,000 items of 40 words has some 100 MB in all.
    """

    def __init__(self, files: list[tuple[str, int]], most: int | None = None):
        self.files, self.most, self.held = files, MOST_HELD if most is None else most, {}

    def fits(self) -> bool:
        return sum(n for _, n in self.files) <= self.most

    def __iter__(self):
        for f, n in self.files:
            if f not in self.held:
                while self.held and sum(k for k, _ in self.held.values()) + n > self.most:
                    self.held.pop(next(reversed(self.held)))  # the earlier ones come first again
                store, at = open_folder(f)
                with store.open_input_file(at) as file:
                    self.held[f] = n, pickle.loads(pq.read_table(file).column("data")[0].as_py())
            yield self.held[f][1]

    def groups(self, batches):
        """The batches, joined to groups of GROUP_BYTES where parts have to be read again for each."""
        if self.fits():
            yield from batches
            return
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) >= GROUP_BYTES:
                yield pa.concat_batches(held)
                held = []
        if held:
            yield pa.concat_batches(held)


KEYS = "doc_id long, text_key long, item_id long, score double, question_overlap double, answer_overlap double"


def _searched(texts: list[str | None], parts: Parts, threshold: float, overlap: float, first: bool = False):
    """(number of the text, hit) for the hits of each text; with ``first``, a text that has one is not searched on.

    All texts of a batch meet a part before the next one is read.
    """
    words = [terms(t) for t in texts]
    left = list(range(len(texts)))
    for index in parts:
        for some in list(pieces(left, lambda i: 64 + len(words[i]), WORDS)):
            for i, found in zip(some, index.matches([words[i] for i in some], threshold, overlap, first)):
                yield from ((i, h) for h in index.hits(found)[: 1 if first else None])
                if first and found:
                    left.remove(i)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, k1: float = 1.2, b: float = 0.75, block_items: int = 8_000) -> DataFrame:
    """doc_id, text_key, item_id, score, question_overlap, answer_overlap for each row of ``docs`` and item it contains.

    Empty and null texts and an empty benchmark give no rows; a repeated row gives its rows again, and an item_id that
    several items have may come once for each.  Of passages that verify an item equally, the one with the higher score
    counts.  Whole texts are read, however long; extra columns of either table are ignored.
    """
    files = build(benchmark, Workspace(docs.sparkSession, "decontam"), k1, b, block_items)

    def run(batches):
        parts = Parts(files)
        for batch in parts.groups(batches):
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            rows = [(ids[i], keys[i], *h) for i, h in _searched(batch.column("text").to_pylist(), parts, threshold, overlap)]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in KEYS.split(", ")])

    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(lean(run), KEYS)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], threshold: float = 0.5, overlap: float = 0.5, k1: float = 1.2, b: float = 0.75, block_items: int = 8_000) -> DataFrame:
    """The columns ``keep`` of the rows of ``docs`` that contain no item, by the rule of ``contaminated``.

    Rows are judged and passed on in one scan; neither they nor keys of them are shuffled.  Rows with null or empty
    texts stay, and so do all rows if there is no item.
    """
    files = build(benchmark, Workspace(docs.sparkSession, "decontam"), k1, b, block_items)
    rows = docs.select(*keep)

    def run(batches):
        parts = Parts(files)
        for batch in parts.groups(batches):
            hit = {i for i, _ in _searched(batch.column("text").to_pylist(), parts, threshold, overlap, first=True)}
            yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in hit], pa.int64()))

    return rows.mapInArrow(lean(run), rows.schema)
