"""The corpus pipeline: five stages over ``documents``, each calling one operator.

Each stage takes all rows that the stage before it kept, and all but the last return the
columns of ``documents`` and any others unchanged, whatever their names.

Defined results: null and empty texts, and texts without a letter, go in the first stage;
a row with a null doc_id is judged like others, and is kept where it stands alone; of a group
of near copies one row stays (the one with the smallest doc_id, if any has one), and of rows
that repeat doc_id and text one; empty tables pass through. Any other column may be null.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, minhash, packing, quality, secrets
from ledgerloom.llm.common import read_table, shared_folder

#: before the names of columns that a stage adds for a while
MARK = "_stage_"


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go."""
    found = langid.languages_of(docs, MARK + "lang", MARK + "score", MARK + "held_out")
    return found.where(F.col(MARK + "lang") != langid.UND).where(F.col(MARK + "score") >= langid.MIN_SCORE).select(*docs.columns)


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one row stays; rows without words stay, repeated ones once."""
    kept = minhash.near_duplicates(docs.select("doc_id", "text")).where("kept")
    first = kept.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "text_key")).alias("row")).select("row.*")
    rows = first.unionByName(kept.where("group_id is null").select("doc_id", "text_key"))
    key = [MARK + "id", MARK + "text"]
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    rows = rows.select(number.alias(key[0]), F.col("text_key").alias(key[1])).distinct()
    marked = docs.withColumns({key[0]: number, key[1]: minhash.text_key()})
    return marked.join(rows, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also those behind encodings, are replaced by a mark; no document goes."""
    return secrets.redact(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens along the curve."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", _language),
    ("quality rules", _quality),
    ("MinHash near-dedup", _near_dedup),
    ("secret scans", _secrets),
    ("packing", _packing),
]

#: SQL can express neither the network nor the forest; tests hold the run against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written as Parquet to the shared folder and read again.

    What one stage has written is removed as soon as the next one is written; the last stage's
    rows stay for the caller.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
