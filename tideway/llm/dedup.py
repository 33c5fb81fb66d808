"""MinHash near-duplicate detection by a chosen-path set similarity join.

Every distinct shingle set gets a signature of 64 minwise tokens.  Independent trees branch the sets recursively:
a node is the path of minwise tokens chosen so far, and its sets agree on all of them.  A node of at most
``leaf_size`` sets is compared exhaustively; a larger one chooses two further tokens and branches, so that a pair of
similarity s survives a level with probability 1 - (1 - s q)^2 (q: that of the level below).  The number of trees
follows from the recall that a pair of the least similarity is to have.

Large nodes hold groups of near copies: after a few levels their sets are linked with central ones, and only pairs that
this leaves in different components are compared.  A large node whose sets are all in one component is done.  In any
other, the sets outside its largest component are compared with those inside and with each other, block by block, if
they are few enough for that to cost a fixed number of rows a set; else the node branches on.  Every link is confirmed on
the full sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded, lean, text_key
from .textstats import WordHasher, windows

COORDS = 64
#: Minwise tokens of two sets of similarity 0.8 that agree are 51 of 64 on average, standard deviation 3.2.
AGREE = 36
#: Bins of the one-permutation sketch, a byte each; 0 stands for an empty bin.
BINS = 256


#: In a large node, blocks of sets outside its largest component that every other set may meet; beyond, it branches on.
MOST_BLOCKS = 32
#: Levels after which a node is compared block by block, whatever that costs.
LAST_LEVEL = 10


def survival(similarity: float, levels: int) -> float:
    """The chance that a pair of a root stays together down to the last of so many levels of branching."""
    q = 1.0
    for _ in range(levels):
        q = 1 - (1 - similarity * q) ** 2
    return q


def trees_for(recall: float, similarity: float, levels: int = LAST_LEVEL) -> int:
    """The least number of trees that find a pair with the chance ``recall``.

    A pair meets in a root with the chance of its similarity; from 0.8 on, each level more costs next to nothing.  Trees
    choose from one signature of 64 tokens, so they are not wholly independent: simulated on 60,000 pairs of 0.8, a recall
    of 0.9997 comes to 0.9996 at two levels and 0.9993 at ten.
    """
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(0.999999, similarity * survival(similarity, levels))))))


def _constants(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


class ShingleHasher:
    """64-bit hashes of the distinct word shingles of a text."""

    def __init__(self, width: int = 2):
        self.width, self.words = width, WordHasher()

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words((text or "").encode("utf-8", "surrogatepass").lower().split())  # bytes.lower() changes A-Z only
        if not len(h):
            return h
        # a whole sequence shorter than a shingle is a token of its own kind
        return np.unique(windows(h, self.width) if len(h) >= self.width else ~windows(h, len(h)))


def minwise(tokens: np.ndarray, xors: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """One 32-bit minimum for each coordinate, over blocks of tokens."""
    out = np.full(len(xors), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(tokens), 4096):
        part = tokens[at : at + 4096]
        np.minimum(out, (((part[None, :] ^ xors[:, None]) * odds[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out.astype(np.uint32)


def bin_sketch(tokens: np.ndarray) -> bytes:
    """The least token of each of 256 ranges, by a byte of its hash; ``tokens`` are sorted."""
    at = np.searchsorted(tokens, np.arange(BINS, dtype=np.uint64) << np.uint64(56))
    full = np.diff(at, append=len(tokens)) > 0
    out = np.zeros(BINS, np.uint8)
    out[full] = (tokens[at[full]] >> np.uint64(20)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def may_link(sk: np.ndarray, n: np.ndarray, one: np.ndarray, own: int, share: float) -> np.ndarray:
    """Which sets may have the similarity ``share`` with one: sizes allow it, and so do the bins.

    Of the u bins that either fills, share * u hold the same token on average.  The deviation is that of u draws without
    replacement from the union, which for small sets leaves next to none; 4.5 deviations and 1.5 bins are allowed.
    """
    ok = np.minimum(n, own) >= share * np.maximum(n, own)
    at = np.flatnonzero(ok)
    if len(at):
        part = sk[at]
        u = np.count_nonzero(part | one, axis=1)
        same = np.count_nonzero(part == one, axis=1) - (BINS - u)
        union = np.maximum((n[at] + own) / (1 + share), u)
        ok[at] = same + 4.5 * np.sqrt(share * (1 - share) * u * (1 - u / union)) + 1.5 >= share * u
    return ok


def sketches(docs: DataFrame, width: int = 2, seed: int = 5) -> DataFrame:
    """doc_id, text_key, n (set size), fp (128-bit fingerprint of the set), sig (64 minwise tokens), sk (bin sketch)."""

    def run(batches):
        hasher, (xors, odds) = ShingleHasher(width), _constants(seed, COORDS)
        for b in batches:
            ns, fps, sigs, low = [], [], [], []
            for text in b.column("text").to_pylist():
                tokens = hasher(text)
                ns.append(len(tokens))
                fps.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                sigs.append(minwise(tokens, xors, odds).view(np.int32) if len(tokens) else np.zeros(COORDS, np.int32))
                low.append(bin_sketch(tokens))
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int32)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), sig, pa.array(low, pa.binary())], ["doc_id", "text_key", "n", "fp", "sig", "sk"])

    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(lean(run), "doc_id long, text_key long, n long, fp binary, sig array<int>, sk binary")


def shingle_sets(docs: DataFrame, width: int = 2) -> DataFrame:
    """fp, tokens (the full set) for each row with a word."""

    def run(batches):
        hasher = ShingleHasher(width)
        for b in batches:
            fps, sets = [], []
            for text in b.column("text").to_pylist():
                tokens = hasher(text)
                if len(tokens):
                    fps.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                    sets.append(tokens.view(np.int64))
            ends = np.cumsum([0, *map(len, sets)])
            for lo in range(0, len(sets), 2000):
                part = sets[lo : lo + 2000]
                yield pa.RecordBatch.from_arrays([pa.array(fps[lo : lo + 2000], pa.binary()), pa.ListArray.from_arrays(pa.array(ends[lo : lo + len(part) + 1] - ends[lo], pa.int32()), pa.array(np.concatenate(part)))], ["fp", "tokens"])

    return docs.select("text").mapInArrow(lean(run), "fp binary, tokens array<long>")


def _roots(classes: DataFrame, trees: int) -> DataFrame:
    sig = F.col("sig")
    return classes.select("rid", F.explode(F.array(*[F.xxhash64(F.lit(t), sig[t]) for t in range(trees)])).alias("node"))


def _meeting(rows: DataFrame, cols: list[str], *others: DataFrame) -> DataFrame:
    """``rows(rid, cols)`` with the columns of other tables that have one row per rid.

    A set stands in several nodes; its rows meet the others as one list, so that long columns are joined once per set.
    """
    held = rows.groupBy("rid").agg(F.collect_list(F.struct(*cols)).alias("held"))
    met = reduce(lambda x, y: x.join(y, "rid"), others, held)
    return met.select(*[c for c in met.columns if c != "held"], F.inline("held"))


def _children(big: DataFrame, classes: DataFrame) -> DataFrame:
    """Two further minwise tokens are chosen by each node; its sets go to the children that theirs name."""
    node, sig = F.col("node"), F.col("sig")
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(COORDS)).cast("int")
    other = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(COORDS - 1)).cast("int"), F.lit(COORDS)).cast("int")
    return (
        _meeting(big, ["node"], classes.select("rid", "sig"))
        .select("rid", F.explode(F.array(*[F.xxhash64(node, c, F.get(sig, c)) for c in (first, other)])).alias("node"))
    )


def _by_node(batches, names: list[str], work):
    """Calls ``work`` with the columns of each node; rows come sorted by node, and a node may span batches."""
    held: list = []

    def groups(cols):
        edges = np.flatnonzero(np.diff(cols[0])) + 1
        for lo, hi in zip([0, *edges], [*edges, len(cols[0])]):
            if hi - lo > 1 and (out := work(*(x[lo:hi] for x in cols))) is not None:
                yield out

    for b in batches:
        if not b.num_rows:
            continue
        cols = []
        for x in names:
            if x == "sk":
                cols.append(np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint8).reshape(-1, BINS))
            elif x == "tokens":
                cols.append(np.array([None, *(np.array(t).view(np.uint64) for t in b.column(x).to_numpy(zero_copy_only=False))], dtype=object)[1:])
            else:
                cols.append(b.column(x).to_numpy(zero_copy_only=False))
        if held:
            cols = [np.concatenate([h, x]) for h, x in zip(held, cols)]
        other = cols[0] != cols[0][-1]
        last = len(other) - int(np.argmax(other[::-1])) if other.any() else 0
        yield from groups([x[:last] for x in cols]) if last else ()
        held = [x[last:] for x in cols]
    if held:
        yield from groups(held)


def _open_pairs(n, sk, comp, side, share: int):
    """For each row i, the later rows of another component (and of the other side, if there are two) that may link."""
    two = side if side.any() else None
    for i in range(len(n) - 1):
        rest = comp[i + 1 :] != comp[i]
        if two is not None:
            rest &= two[i + 1 :] != two[i]
        j = np.flatnonzero(rest) + i + 1
        if len(j):
            j = j[may_link(sk[j], n[j], sk[i], n[i], share / 100)]
            if len(j):
                yield i, j


def _candidates(rows: DataFrame, share: int) -> DataFrame:
    """node, a, b: the pairs that sketches allow within a node (node null), or the members (a) of a node with more such
    pairs than twice its rows (b null), which are cheaper to compare where they are.

    ``rows``: node, rid, n, sk, comp, side.  Rows of a node arrive together and are at most a leaf or two blocks.
    """

    def work(node, rid, n, sk, comp, side):
        found = list(_open_pairs(n, sk, comp, side, share))
        if sum(len(j) for _, j in found) > 2 * len(rid):
            at = np.unique(np.concatenate([np.append(j, i) for i, j in found]))
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(rid[at]), pa.nulls(len(at), pa.int64()), pa.array(side[at].astype(bool))], ["node", "a", "b", "side"])
        if found:
            x, y = np.concatenate([np.full(len(j), rid[i]) for i, j in found]), np.concatenate([rid[j] for _, j in found])
            return pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.zeros(len(x), bool))], ["node", "a", "b", "side"])
        return None

    names = ["node", "rid", "n", "sk", "comp", "side"]
    return rows.select(*names).repartition("node").sortWithinPartitions("node", "rid").mapInArrow(lean(lambda it: _by_node(it, names, work)), "node long, a long, b long, side boolean").distinct()


def _links_within(rows: DataFrame, share: int) -> DataFrame:
    """Links (a, b) that join all sets of a node which links within it connect: node, rid, n, sk, comp, side, tokens.

    What a link has connected is not compared again, so a node of m rows gives m - 1 links at most.
    """

    def work(node, rid, n, sk, comp, side, tokens):
        out_a, out_b, comp = [], [], comp.copy()
        for i, j in _open_pairs(n, sk, comp, side, share):
            many = np.concatenate([tokens[k] for k in j])
            at = np.minimum(np.searchsorted(tokens[i], many), len(tokens[i]) - 1)
            both = np.add.reduceat(tokens[i][at] == many, np.cumsum([0, *(len(tokens[k]) for k in j[:-1])]), dtype=np.int64)
            for k in j[100 * both >= share * (n[i] + n[j] - both)]:
                if comp[k] != comp[i]:
                    comp[comp == comp[k]] = comp[i]
                    out_a.append(min(rid[i], rid[k]))
                    out_b.append(max(rid[i], rid[k]))
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"]) if out_a else None

    names = ["node", "rid", "n", "sk", "comp", "side", "tokens"]
    return rows.select(*names).repartition("node").sortWithinPartitions("node", "rid").mapInArrow(lean(lambda it: _by_node(it, names, work)), "a long, b long").distinct()


def _full_sets(rids: DataFrame, classes: DataFrame, docs: DataFrame, ws: Workspace, name: str, width: int) -> DataFrame:
    """rid, tokens of the named classes, saved; only texts of their documents are read again into sets."""
    named = ws.save(rids.distinct().join(classes.select("rid", "doc_id", "fp"), "rid"), f"{name}-named")
    ids = bounded(named.select(F.col("doc_id").alias("_id")).distinct())
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = shingle_sets(texts, width).join(named.select("fp", "rid"), "fp").select("rid", "tokens")
    return ws.save(sets.dropDuplicates(["rid"]), f"{name}-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, ws: Workspace, name: str, share: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= share * union, saved."""
    a, b = sets.select(F.col("rid").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("rid").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("both"))
    return ws.save(both.where(100 * F.col("both") >= share * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), f"{name}-links")


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """rid, comp for every node of a link (comp: its smallest reachable node).

    Each round takes the least label among a node and its neighbours and then that label's own label, so that labels
    travel in doubling steps.  Labels are broadcast while they are few and joined by a shuffle else; the least of a
    node's many neighbours is taken before the shuffle.
    """
    edges = ws.save(links.union(links.select("b", "a")).toDF("u", "v").where("u <> v").distinct(), f"{name}-edges")
    labels = ws.save(edges.groupBy(F.col("u").alias("rid")).agg(F.min("v").alias("m")).select("rid", F.least("rid", "m").alias("comp")), f"{name}-labels-0")
    seen, at = None, 0
    while (now := tuple(labels.agg(F.count("*"), F.sum(F.col("comp").cast("decimal(38,0)"))).first())) != seen:
        seen, at = now, at + 1
        known = bounded(labels, now[0])
        near = edges.join(known, F.col("v") == F.col("rid")).groupBy("u").agg(F.min("comp").alias("m"))
        new = near.join(known, F.col("u") == F.col("rid")).select("rid", F.least("m", "comp").alias("comp"))
        hop = known.select(F.col("rid").alias("r"), F.col("comp").alias("c"))
        new = new.join(hop, F.col("comp") == F.col("r")).select("rid", F.least("comp", "c").alias("comp"))
        labels = ws.save(new.coalesce(1 + now[0] // 20_000), f"{name}-labels-{at}")
        ws.drop(f"{name}-labels-{at - 1}")
    ws.drop(f"{name}-edges")
    return labels


def _roots_of(up: DataFrame, ws: Workspace, name: str, hops: int = 3) -> DataFrame:
    """rid, comp for a table of links ``(rid, up)`` to ever more central sets: where 2^hops links lead."""
    for k in range(hops):
        up = ws.save(up, f"{name}-up-{k}")
        above = bounded(up).select(F.col("rid").alias("r"), F.col("up").alias("top"))
        up = up.join(above, F.col("up") == F.col("r"), "left").select("rid", F.coalesce("top", "up").alias("up"))
    up = ws.save(up, f"{name}-up")
    return up.toDF("rid", "comp")


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, recall: float = 0.9997, levels: int = 3, leaf_size: int = 64, block_size: int = 1000, agree: int = AGREE, labels: bool = False, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, text_key, n_shingles, component_id, kept.

    With ``labels`` also comp, a number of the component that, other than component_id, no two components share; null for
    rows without shingles.

    Shingles are runs of ``width`` words; a shorter text is one shingle as a whole.  ``share`` is the least similarity in
    per cent, ``recall`` the chance that a pair just so similar is found, ``levels`` how far all large nodes branch before
    their sets are linked with central ones.

    Null and empty texts have n_shingles 0 and are linked with nothing; a null doc_id never gives its component a name
    unless all ids of it are null.  Rows that repeat a doc_id are judged by their own texts, equal rows alike; whole texts
    are read.  Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "dedup")
    sk = ws.save(sketches(docs, width), "sketches")
    grouped = sk.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sk").alias("sk"))
    classes = ws.save(grouped.withColumn("rid", F.monotonically_increasing_id()), "classes")
    sk = ws.save(sk.select("doc_id", "text_key", "n", "fp"), "sets-of")  # the sketches live on in the classes only
    ws.drop("sketches")

    rows, leaves, large = _roots(classes, trees_for(recall, share / 100)), [], []
    for level in range(1, levels + 1):
        rows = ws.save(rows, f"rows-{level}")
        sizes = ws.save(rows.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"), f"sizes-{level}")
        met = ws.save(rows.join(sizes, "node").withColumn("level", F.lit(level)), f"met-{level}")
        ws.drop(f"rows-{level}", f"sizes-{level}")
        leaves.append(met.where(F.col("m") <= leaf_size))
        large.append(met.where(F.col("m") > leaf_size))
        if large[-1].limit(1).isEmpty():
            break
        rows = _children(large[-1], classes)

    comps, links = None, None
    if len(large) > 1 or not large[0].limit(1).isEmpty():
        stars = _stars(reduce(DataFrame.union, large), classes, ws, agree)
        stars = ws.save(stars, "stars-pairs")
        sets = _full_sets(stars.select(F.explode(F.array("a", "b")).alias("rid")), classes, docs, ws, "stars", width)
        links = confirmed(stars, sets, ws, "stars", share)
        ws.drop("stars-pairs", "stars-named", "stars-sets")
        comps = _roots_of(links.toDF("rid", "up"), ws, "stars")
    short = classes.select("rid", "n", "sk")
    short = short.join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid")) if comps else short.withColumn("comp", F.col("rid"))
    cols = ["node", "rid", "n", "sk", "comp", "side"]
    small = _meeting(reduce(DataFrame.union, leaves), ["node"], short).withColumn("side", F.lit(False))
    rows = small.select(*cols)
    if comps:
        more, deep = _open_nodes(large[-1].select("node", "rid"), short, classes, ws, levels, leaf_size, block_size, most_blocks)
        rows = reduce(DataFrame.union, [rows, *(x.select(*cols) for x in more)])
    found = ws.save(_candidates(rows, share), "found")
    sets = _full_sets(found.select(F.explode(F.array_compact(F.array("a", "b"))).alias("rid")), classes, docs, ws, "leaves", width)
    pairs = confirmed(found.where("node is null").select("a", "b"), sets, ws, "leaves", share)
    members = _meeting(found.where("node is not null").select("node", F.col("a").alias("rid"), "side"), ["node", "side"], short, sets)
    found = pairs.union(ws.save(_links_within(members, share), "within"))
    ws.drop("found", "leaves-named", "leaves-sets", *[f"met-{k + 1}" for k in range(len(large))], *(deep if comps else ()))
    comps = components(links.union(found) if links else found, ws, "all")
    named = classes.select("rid", "fp", "doc_id").join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    names = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = ["comp"] if labels else []
    named = ws.save(named.select("fp", "comp").join(ws.save(names, "names"), "comp").select("fp", "component_id", *label), "named")
    out = sk.select("doc_id", "text_key", "n", "fp").join(named, "fp", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *label)


def _stars(large: DataFrame, classes: DataFrame, ws: Workspace, agree: int) -> DataFrame:
    """One pair (a, b) for each set in a large node: itself and a more central set of the deepest such node.

    The sets that stay in most large nodes agree with most of their group; each node's hub is that which stays in most.
    In a group of near copies this links nearly all with few hubs, so that the exhaustive comparison, which leaves out
    what is linked already, has no pairs in the square of the group to find.
    """
    held = large.groupBy("rid").agg(F.collect_list(F.struct("node", "level")).alias("held"))
    rows = ws.save(held.select("rid", F.size("held").alias("stays"), F.inline("held")), "staying")
    hubs = ws.save(rows.groupBy("node").agg(F.max(F.struct("stays", "rid")).alias("hub")), "hubs")
    best = rows.join(hubs, "node").where(F.col("rid") != F.col("hub.rid")).groupBy("rid").agg(F.max(F.struct("level", "hub.stays", "hub.rid")).alias("best"))
    pairs = ws.save(best.select("rid", F.col("best.rid").alias("hub")), "hubs-of")
    ws.drop("staying", "hubs")
    signs = classes.select("rid", "sig")
    pairs = pairs.join(signs, "rid").join(signs.select(F.col("rid").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    alike = F.size(F.filter(F.zip_with("sig", "hub_sig", lambda x, y: x == y), lambda x: x)) >= agree
    return pairs.where(alike).select(F.col("rid").alias("a"), F.col("hub").alias("b"))


def _open_nodes(rows: DataFrame, short: DataFrame, classes: DataFrame, ws: Workspace, level: int, leaf_size: int, block_size: int, most_blocks: int) -> tuple[list[DataFrame], list[str]]:
    """What is left to compare in large nodes ``rows(node, rid)``: tables of small nodes (node, rid, n, sk, comp, side), and
    the names of tables that go when they have been read.

    Pairs of one component are left out: a node of one component has none, however many its sets.
    """
    out, names = [], []
    comp = short.select("rid", "comp")
    while True:
        placed = _meeting(rows, ["node"], comp)
        counts = placed.groupBy("node", "comp").agg(F.count("*").alias("k"))
        nodes = counts.groupBy("node").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("m"))
        nodes = nodes.select("node", F.col("main.comp").alias("main"), F.col("main.k").alias("inside"), (F.col("m") - F.col("main.k")).alias("outside")).where("outside > 0")
        nodes = ws.save(nodes, f"open-{level}")
        names.append(f"open-{level}")
        if nodes.isEmpty():
            return out, names
        here = F.lit(True) if level >= LAST_LEVEL else F.col("outside") <= most_blocks * block_size
        ready, rest = nodes.where(here), nodes.where(~here)
        out.append(_blocks(_meeting(rows.join(ready, "node"), ["node", "main", "inside", "outside"], short), block_size))
        if rest.isEmpty():
            return out, names
        level += 1
        rows = ws.save(_children(rows.join(rest.select("node"), "node", "left_semi"), classes), f"deep-{level}")
        sizes = rows.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        met = ws.save(rows.join(sizes, "node"), f"deep-met-{level}")
        names += [f"deep-{level}", f"deep-met-{level}"]
        out.append(_meeting(met.where(F.col("m") <= leaf_size), ["node"], short).withColumn("side", F.lit(False)))
        rows = met.where(F.col("m") > leaf_size).select("node", "rid")


def _blocks(rows: DataFrame, block_size: int) -> DataFrame:
    """Deals the sets of each node to blocks and pairs the blocks: node (of a pair of blocks), rid, side, n, sk, comp.

    Blocks of the sets outside the node's largest component meet each other and those inside; blocks inside do not meet.
    With m sets inside and k outside that gives m * ceil(k / block_size) + k * ceil((m + k) / block_size) rows.
    """
    count = lambda n: F.ceil(F.col(n) / block_size).cast("int")
    inside = F.col("comp") == F.col("main")
    of = F.when(inside, count("inside")).otherwise(count("outside"))
    own, none = F.pmod(F.xxhash64("rid"), of).cast("int"), F.array().cast("array<struct<i:int,j:int,side:boolean>>")
    across = F.transform(F.sequence(F.lit(0), F.when(inside, count("outside")).otherwise(count("inside")) - 1), lambda x: F.struct(F.when(inside, -1 - own).otherwise(-1 - x).alias("i"), F.when(inside, x).otherwise(own).alias("j"), (~inside).alias("side")))
    among = F.transform(F.sequence(F.lit(0), count("outside") - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j"), (own > x).alias("side")))
    rest = ["rid", "n", "sk", "comp"]
    dealt = rows.select("node", *rest, F.explode(F.concat(across, F.when(inside, none).otherwise(among))).alias("p"))
    return dealt.select(F.xxhash64("node", "p.i", "p.j").alias("node"), *rest, F.col("p.side").alias("side"))
