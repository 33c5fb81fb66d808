"""Sharding by a keyed permutation of global row numbers.

Rows are numbered from 0 in the order of doc_id, text_crc32 and size, those without an id last; the numbering is exact
and does not depend on how Spark has dealt the rows.  A Feistel permutation with cycle walking maps row number r to
p(r); the shard is p(r) modulo the number of shards and the slot p(r) div it, so both can be computed from the row number
alone, counts differ by one at most, and slots have no gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, bounded, text_key, unroll
from .permute import permute

#: Buckets of ids, and of rows without one, at most.
MOST_BUCKETS = 20_000


def numbered(rows: DataFrame, ws: Workspace, bucket_rows: int = 50_000) -> tuple[DataFrame, int]:
    """``rows(doc_id, size, text_crc32, ...)`` with their global ``row`` numbers, and their count.

    Equal rows are counted first and numbered as one.  Buckets are ranges of doc_id between approximate quantiles; an id
    that is several quantiles, and the rows without an id, have as many buckets of their own as their number asks for:
    ranges of the checksum.  Any bounds give the same numbers.
    """
    groups = ws.save(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "groups")
    n, different, nulls, most = (x or 0 for x in groups.agg(F.sum("copies"), F.count("*"), F.count_if(F.col("doc_id").isNull()), F.max("copies")).first())
    parts = max(1, min(MOST_BUCKETS, different // bucket_rows * 4 + 8))
    found = groups.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()["q"] if parts > 1 else []
    bounds, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    # each bound's range of ids is a bucket; one more for each quantile that the bound itself is, and four, as it is rounded
    own = np.where(times > 1, times * 2 + 4, 0)
    first = np.concatenate([[0], np.cumsum(own + 1)])  # of each range; the last is that of the ids above all bounds
    last = max(1, min(MOST_BUCKETS, -(-nulls * 2 // bucket_rows)))

    @F.pandas_udf("long")
    def bucket(doc_id: pd.Series, crc: pd.Series) -> pd.Series:
        null, ids, sums = doc_id.isna().to_numpy(), doc_id.fillna(0).astype("int64").to_numpy(), crc.to_numpy()
        at = np.searchsorted(bounds, ids)
        out = first[at]
        if len(bounds):
            near = np.minimum(at, len(bounds) - 1)
            hot = (bounds[near] == ids) & (own[near] > 0)
            out = np.where(hot, out + 1 + sums * own[near] // 2**32, out)
        return pd.Series(np.where(null, first[-1] + 1 + sums * last // 2**32, out))

    dealt = ws.save(groups.withColumn("_bucket", bucket("doc_id", "text_crc32")), "dealt")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are buckets
    starts = dealt.groupBy("_bucket").agg(F.sum("copies").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = ws.save(starts, "starts")
    rest = [x for x in rows.columns if x not in ("doc_id", "size", "text_crc32")]
    inside = Window.partitionBy("_bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size", *rest).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_at", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(bounded(starts), "_bucket")
    out = unroll(out, "copies", "_copy", n) if most > 1 else out.withColumn("_copy", F.lit(0))
    return out.select(*rows.columns, (F.col("_start") + F.col("_at") + F.col("_copy")).alias("row")), n


def shards(docs: DataFrame, n_shards: int = 16, seed: int = 9) -> DataFrame:
    """doc_id, text_key, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs(doc_id, text)``.

    A null text has no bytes: size 1, checksum 0.  Repeated rows take numbers of their own; which of two equal rows has
    which makes no difference.  Whole texts are summed, however long.  Extra columns are ignored; an empty table gives no
    rows.
    """
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows, n = numbered(rows, Workspace(docs.sparkSession, "sharding"))

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    return rows.withColumn("p", place("row")).select(
        "doc_id", "text_key", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % n_shards).cast("int").alias("shard"),
        F.expr(f"p div {n_shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
