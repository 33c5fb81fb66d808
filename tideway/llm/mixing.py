"""Mixing sources to target weights.

The words of each source are packed, in a fixed order of its documents, into blocks of a fixed length; a document lies
in one or more blocks.  For every output shard the number of blocks of each source is drawn from a multinomial whose
probabilities follow what is still missing from each source's target, so the totals end next to the targets.  The j-th
block drawn from a source is block p(j mod n) of its n blocks, where p is a keyed permutation of 0 .. n - 1 for this
source and pass; so no block comes a third time before all came twice.  Slots and blocks meet in a join on
(source, block).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Workspace, bounded, n_words, table_bytes, text_key, unroll
from .permute import permute

#: Blocks of an output shard, on average, and the bounds of the number of shards.
SHARD_BLOCKS, LEAST_SHARDS, MOST_SHARDS = 100_000, 64, 8192


@dataclass
class Mix:
    """``rows``: every document with its place; ``segments``: what each slot takes; ``sources``: the plan.

    A document is told by its source and its place there, the number of words before it; one without words has none.
    """

    rows: DataFrame  # source_index, start, doc_id, text_key, size, copies (equal rows), source_size, target
    segments: DataFrame  # shard, slot, source_index, block, epoch, start, first_word (in the document), words
    sources: DataFrame  # source, source_index, source_size, target, blocks
    told_by: tuple[str, ...] = ()  # columns that tell rows apart, besides doc_id, text and source


def row_key(told_by: tuple[str, ...]) -> Column:
    """Tells apart rows that repeat a doc_id, by the text and the named columns; a null is a value of its own."""
    if not told_by:
        return text_key(F.col("text"))
    return F.xxhash64("text", *[x for name in told_by for x in (F.col(name).isNull(), F.col(name))])


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Shares ``share`` times all sizes by weight; what a target has above ``most`` times its size is shared again."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def settle(short: np.ndarray, room: np.ndarray, n: int) -> np.ndarray:
    """Deals n blocks, each to the source that is short of most and has room: the shortest are brought to one level.

    The level is found by bisection, so that the time does not depend on n.
    """
    n = min(n, int(room.sum()))
    at = lambda level: np.clip(np.ceil(short - level), 0, room).astype(np.int64)
    low, high = float(short.min()) - n - float(room.max()) - 2, float(short.max())
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle).sum() > n else (low, middle)
    got = at(high)
    while (left := n - int(got.sum())) > 0:
        order = np.argsort(np.where(room > got, got - short, np.inf), kind="stable")[: min(left, int((room > got).sum()))]
        got[order] += 1
    return got


def draw(quota: np.ndarray, capacity: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources): multinomial draws that follow what is missing."""
    rng, total = np.random.default_rng(seed), int(round(quota.sum()))
    total = min(total, int(capacity.sum()))
    taken, out = np.zeros(len(quota), np.int64), np.zeros((shards, len(quota)), np.int64)
    for s in range(shards):
        n = total * (s + 1) // shards - total * s // shards
        missing = np.maximum(quota - taken, 0)
        if missing.sum() <= 0:
            missing = (capacity - taken).astype(float)
        if n == 0 or missing.sum() <= 0:
            continue
        got = np.minimum(rng.multinomial(n, missing / missing.sum()), capacity - taken)
        if got.sum() < n:  # what a full source could not give
            got += settle(quota - taken - got, capacity - taken - got, n - int(got.sum()))
        out[s] = got
        taken += got
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 64, shards: int | None = None, seed: int = 2, told_by: tuple[str, ...] = ()) -> Mix:
    """Plans the mix of ``docs(doc_id, text, source)``.

    The number of sources must fit the driver, which plans a row for each shard and source (100 sources in 8192 shards: some
    100 MB); a null source is one of its own and comes last.  Null texts and texts
    without words have size 0 and are never taken.  Rows that are equal in doc_id, text, source and the columns ``told_by``
    are documents of their own side by side, which nothing tells apart: they are counted first, so that any number of them
    may be equal.  No
    document is taken more than ``most`` (a whole number) times; long texts lie in many blocks.  An empty table gives
    empty results; extra columns are ignored.  Without ``shards`` their number grows with the blocks.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    sized = docs.select("source", "doc_id", row_key(told_by).alias("text_key"), n_words(F.col("text")).alias("size"))
    groups = ws.save(sized.groupBy("source", "doc_id", "text_key", "size").agg(F.count("*").alias("copies")), "groups")
    found = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("s"), F.sum("copies").alias("n"), F.max("copies").alias("most")).collect()
    by_source = sorted(((r.source, r.s, r.n) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    sizes, n_rows, repeated = [s for _, s, _ in by_source], sum(r.n for r in found), max((r.most for r in found), default=0) > 1
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], share, most) if sum(sizes) else [0.0] * len(sizes)
    blocks = np.array([-(-s // block_words) for s in sizes], np.int64)
    sources = spark.createDataFrame([(s, i, z, t, int(b)) for i, ((s, z, _), t, b) in enumerate(zip(by_source, goal, blocks))], "source string, source_index int, source_size long, target double, blocks long")

    parts = max(8, min(4096, n_rows // 20_000))
    plan = bounded(sources.select(F.col("source").alias("_source"), "source_index", "source_size", "target"))
    known = groups.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select("source_index", "doc_id", "text_key", "size", "copies", "source_size", "target")
    placed = known.where("size > 0").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(parts)).cast("int"))
    words = F.col("size") * F.col("copies")
    sums = placed.groupBy("source_index", "part").agg(F.sum(words).alias("s"))
    before = Window.partitionBy("source_index").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = bounded(ws.save(sums.select("source_index", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("part_start")), "starts"))
    inside = Window.partitionBy("source_index", "part").orderBy("doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(starts, ["source_index", "part"])
    columns = ["source_index", "start", "doc_id", "text_key", "size", "copies", "source_size", "target"]
    placed = ws.save(placed.withColumn("start", F.col("part_start") + F.col("at")).select(*columns), "placed")
    each = lambda df: unroll(df, "copies", "copy", n_rows) if repeated else df.withColumn("copy", F.lit(0))
    placed = each(placed).withColumn("start", F.col("start") + F.col("copy") * F.col("size")).select(*columns)
    empty = each(known.where("size = 0")).withColumn("start", F.lit(None).cast("long")).select(*columns)

    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    lies = placed.select("source_index", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * block_words, F.col("start"))
    hi = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size"))
    lies = lies.select("source_index", "block", "start", (lo - F.col("start")).alias("first_word"), (hi - lo).alias("words"))

    quota = np.array([t * b / z if z else 0.0 for t, b, z in zip(goal, blocks, sizes)])
    shards = shards or int(np.clip(quota.sum() // SHARD_BLOCKS, LEAST_SHARDS, MOST_SHARDS))
    counts = draw(quota, (blocks * int(most)).astype(np.int64), shards, seed)
    begun = np.cumsum(counts, axis=0) - counts
    offset = np.cumsum(counts, axis=1) - counts
    runs = [(s, i, int(counts[s, i]), int(begun[s, i]), int(offset[s, i]), int(counts[s].sum()), int(blocks[i])) for s in range(shards) for i in range(len(sizes)) if counts[s, i]]
    runs = spark.createDataFrame(runs, "shard int, source_index int, n long, begun long, offset long, slots long, blocks long")

    @F.pandas_udf("long")
    def image(x: pd.Series, n: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n.to_numpy(), salt.to_numpy() % 2147483647))

    drawn = unroll(runs, "n", "k", int(counts.sum())).withColumn("j", F.col("begun") + F.col("k"))
    epoch = F.expr("j div blocks")
    drawn = drawn.select(
        "shard", image(F.col("offset") + F.col("k"), F.col("slots"), F.lit(seed * 1_000_003) + F.col("shard")).alias("slot"), "source_index", epoch.cast("int").alias("epoch"),
        image(F.pmod("j", "blocks"), F.col("blocks"), F.lit(seed * 7_368_787) + F.col("source_index") * 101 + epoch).alias("block"),
    )
    # the planner sees the few runs, not the slots that they unroll to, and would broadcast those
    segments = drawn.hint("merge").join(lies, ["source_index", "block"])
    return Mix(placed.unionByName(empty), segments, sources, told_by)


def taken(mixed: Mix) -> DataFrame:
    """doc_id, text_key, size, source_size, target, taken for every document, those that nothing is taken of included."""
    got = mixed.segments.groupBy("source_index", "start").agg(F.sum("words").alias("taken"))
    return mixed.rows.join(got, ["source_index", "start"], "left").select("doc_id", "text_key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(mixed: Mix, docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the documents, each as often as a slot takes the block that its first word lies in.

    So documents stay whole, follow the drawn blocks, and meet the targets of their sources on average; none comes more
    often than a block may.  Rows that are equal in all that the mix tells rows by are passed on as one of them repeated: a
    mix that is told by all of ``columns`` loses none that differs.
    """
    ws = Workspace(docs.sparkSession, "mixed")
    got = mixed.segments.where("first_word = 0").groupBy("source_index", "start").agg(F.count("*").alias("times"))
    got = mixed.rows.select("source_index", "start", "doc_id", "text_key", "copies").join(got, ["source_index", "start"])
    got = got.groupBy("source_index", "doc_id", "text_key", "copies").agg(F.sum("times").alias("times")).join(mixed.sources.select("source_index", "source"), "source_index")
    got = ws.save(got.select(F.struct("source", "doc_id", "text_key").alias("key"), "copies", "times"), "times")
    rows = docs.select(F.struct(*columns).alias("row"), F.struct("source", "doc_id", row_key(mixed.told_by).alias("text_key")).alias("own"))
    same = lambda a, b: (F.col(a)["text_key"] == F.col(b)["text_key"]) & F.col(a)["doc_id"].eqNullSafe(F.col(b)["doc_id"]) & F.col(a)["source"].eqNullSafe(F.col(b)["source"])
    size = got.select("key.*", "copies", "times")
    few = table_bytes(size) <= BROADCAST_BYTES
    out = None
    for one in (True, False):
        times = got.where("copies = 1" if one else "copies > 1")
        if not one and times.isEmpty():
            break
        times = F.broadcast(times) if few else times
        own = rows if one else rows.join(times, same("own", "key"), "left_semi").dropDuplicates(["own"])
        met = own.join(times, same("own", "key")).select("row", "times")
        part = met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("k")).select("row.*")
        out = part if out is None else out.union(part)
    return out


def block_texts(mixed: Mix, docs: DataFrame) -> DataFrame:
    """shard, slot, source_index, text: the words of every slot, joined by spaces.

    Null and empty texts stand in no slot; of equal rows one's words are read; a long text is cut into words once.  Columns
    of ``docs`` besides those that the mix was made of are ignored; an empty table gives no rows.
    """
    own = docs.select(F.struct("doc_id", "source", row_key(mixed.told_by).alias("text_key")).alias("own"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("w")).dropDuplicates(["own"])
    rows = mixed.rows.join(mixed.sources.select("source_index", "source"), "source_index").select("source_index", "start", "doc_id", "source", "text_key")
    same = (F.col("own.text_key") == rows["text_key"]) & F.col("own.doc_id").eqNullSafe(rows["doc_id"]) & F.col("own.source").eqNullSafe(rows["source"])
    words = rows.join(own, same).select("source_index", "start", "w")
    part = mixed.segments.join(words, ["source_index", "start"]).select("shard", "slot", "source_index", "start", F.array_join(F.slice("w", F.col("first_word").cast("int") + 1, F.col("words").cast("int")), " ").alias("t"))
    order = F.array_sort(F.collect_list(F.struct("start", "t")))
    return part.groupBy("shard", "slot", "source_index").agg(F.array_join(F.transform(order, lambda x: x["t"]), " ").alias("text"))
