"""The corpus pipeline: language identification, near-duplicate removal, benchmark decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
A stage works on all rows that the one before it kept; a row with null or empty text is an ordinary row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import decontam, dedup, langid, mixing, sharding
from tideway.llm.common import BROADCAST_BYTES, Workspace, bounded, table, table_bytes, text_key, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text stays if the score of its best language is above the even share of L languages, 1 / L, by this part of
#: (1 - 1 / L) / L; else it is as good as undetermined.
LEAST_EXCESS = 0.25


def least_score(languages: int) -> float:
    share = 1 / max(1, languages)
    return share * (1 + LEAST_EXCESS * (1 - share))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of no language: null texts, texts without a letter, and those of almost even scores.

    Rows are judged and passed on in one scan; repeated rows are judged alike.  Where no row names its language, no
    language is known and no row stays.  An empty table gives no rows; extra columns are left out.
    """
    model = langid.fit(docs, Workspace(spark, "pipeline-language"))
    found = langid.identify(docs, model, COLUMNS)
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= least_score(len(model.languages))))
    return kept.select(*[F.col(f"kept_{n}").alias(n) for n in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of their five-word shingles): that with the smallest doc_id,
    once; of rows with that id, or of a group without ids, that with the smallest text_key.

    Rows without words are in no group and stay; an empty table gives no rows; extra columns are left out.
    """
    ws = Workspace(spark, "pipeline-dedup")
    found = ws.save(dedup.near_duplicates(docs, labels=True), "found")
    # components of which rows with different texts, but one doc_id or none, are kept
    tied = found.where("kept and comp is not null").groupBy("comp").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most"))
    tied = bounded(ws.save(tied.where("least < most").select("comp", "least"), "tied"))
    others = found.where("kept").join(tied, "comp").where("text_key > least").select("doc_id", "text_key")
    rejected = ws.save(found.where("not kept").select("doc_id", "text_key").union(others), "rejected")
    kept = without(docs, rejected)
    # rows that repeat a kept doc_id and its text, of which one stays, are few; only they are shuffled
    again = found.where("kept").groupBy("doc_id", "text_key").count().where("count > 1")
    again = ws.save(again.select(F.struct("doc_id", "text_key").alias("again")), "again")
    again = F.broadcast(again) if table_bytes(again.select("again.*")) <= BROADCAST_BYTES else again
    same = F.col("doc_id").eqNullSafe(F.col("again.doc_id")) & (text_key(F.col("text")) == F.col("again.text_key"))
    kept = kept.select(*COLUMNS)
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").union(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.

    Rows with null or empty texts stay, and so do all if there is no item; repeated rows are judged alike, whole texts
    are read, and extra columns are left out.
    """
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"), COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes the block that its first word lies in.

    Texts without words are in no block and go; rows that differ in any column are documents of their own, and of equal
    rows each is counted; long texts stay whole.  An empty table gives no rows; extra columns are left out.
    """
    others = tuple(n for n in COLUMNS if n not in ("doc_id", "text", "source"))
    return mixing.mixed_documents(mixing.mix(docs, told_by=others), docs, COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text_crc32, size, shard and slot of every row, those with null or empty texts and repeated ones included; an
    empty table gives no rows."""
    return sharding.shards(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: SQL cannot state the trained language model, so there is none; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
