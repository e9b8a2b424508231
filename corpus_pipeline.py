"""A corpus pipeline of four stages: quality classifier, near-duplicate join, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's rows as Parquet to the shared
checkpoint folder and gives the next stage what it reads back. All stages but the last return the columns of documents.

Defined cases, alike in all stages: a null text counts as empty; null and repeated ids and repeated rows pass through row by
row, but for what a stage's docstring says; texts of any length are read whole; an empty table gives an empty table; further
columns, whatever their names, are carried along unchanged. Inside a stage columns go by their position, so no name of a
column can clash with one of the stage's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import packing, quality, secret_scan, shingle_join
from quillon.session import checkpoint_folder, delete_folder, table

#: Bytes of pieces that a Python worker keeps in packing: the stages before have grown the executor's JVM to its full heap.
PACKING_CACHE = 64 << 20


def _by_position(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The same rows with columns named c0, c1 and so on, and the names of the id and the text among them."""
    place = {name: f"c{i}" for i, name in reversed(list(enumerate(docs.columns)))}
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), place["doc_id"], place["text"]


def _id_and_text(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of good quality reaches the threshold stay, as they are. Rows without text have one score, all alike."""
    df, doc_id, text = _by_position(docs)
    model = quality.fit(_id_and_text(df, doc_id, text), table(spark, sf_dir, "labels"))
    scored = quality.score(df, model, keep=tuple(df.columns), text=text)
    return scored.where(F.col("score") >= quality.THRESHOLD).drop("score").toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, similarity 0.8) the row with the smallest id stays.

    Components are told apart by their root, as unrelated ones can share the smallest id. Rows without a set are components of
    their own. Of rows that share both id and text one stays; rows of a component without any id stay once per text.
    """
    df, doc_id, text = _by_position(docs)
    found = shingle_join.near_groups(df, doc_id, text, words=shingle_join.WORDS, percent=shingle_join.PERCENT)
    named = F.struct("doc_id", "text_hash")
    first = found.where("n_shingles > 0 AND component_id IS NOT NULL").groupBy("root").agg(F.min(F.when(F.col("doc_id").isNotNull(), named)).alias("x"))
    alone = found.where("n_shingles = 0 OR component_id IS NULL").select(named.alias("x"))
    keep = first.select("x").unionByName(alone).select("x.doc_id", "x.text_hash").distinct()
    marked = df.withColumn("hash", F.xxhash64(text)).alias("d")
    same_id = F.col(f"d.{doc_id}").cast("bigint").eqNullSafe(F.col("k.doc_id"))
    kept = marked.join(keep.alias("k"), (F.col("d.hash") == F.col("k.text_hash")) & same_id, "left_semi")
    return kept.dropDuplicates([doc_id, "hash"]).drop("hash").toDF(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan reports is replaced by a mark, and n_chars follows where there is such a column; no row goes."""
    df, _, text = _by_position(docs)
    found = secret_scan.scan(df, text=text, keep=tuple(df.columns))
    clean = F.when(F.size("found") > 0, secret_scan.redact(F.col(text), F.col("found"))).otherwise(F.col(text))
    marked = found.withColumn("clean", clean).withColumn("changed", F.size("found") > 0)
    columns = []
    for c, field in zip(df.columns, docs.schema.fields, strict=True):
        if c == text:
            columns.append(F.col("clean"))
        elif field.name == "n_chars":
            columns.append(F.when(F.col("changed"), F.length("clean").cast(field.dataType)).otherwise(F.col(c)))
        else:
            columns.append(F.col(c))
    return marked.select(*columns).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; an empty text is its end id alone."""
    df, doc_id, text = _by_position(docs)
    return packing.digest(packing.pack(df, doc_id, text, cache_bytes=PACKING_CACHE))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The classifier and the packing are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what an earlier stage wrote is deleted once the next one has been written."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
