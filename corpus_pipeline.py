"""From raw documents to token ids: reject, deduplicate, mix, encode.

Each stage takes the table its predecessor wrote and works on all of it.  All
but the last return the columns of ``documents``, whatever they are called.  A
row counts as its id and text: rows with a null id, and other texts under one id,
go through like others.  Of equal rows one stays.  Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.llm import bpe, exact_dedup, ngram_join, quality_knn, source_mixing
from ripplegraph.llm.shared import discard, release, small_batches, stored

#: SQL can express neither the trained classifier nor the byte-pair merges.
ORACLE_SQL = None


def _wrapped(docs: DataFrame, *keys: Column) -> DataFrame:
    """Rows (doc, keys...): the document is one column, so its columns' names clash with nothing."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *keys)


def _one_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    """Documents of wrapped rows, one for each combination of keys."""
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc")))
        rows = rows.withColumn("turn", turn).where("turn = 1")
    return rows.select("doc.*")


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under one half go; it learns from the labelled rows of docs."""
    small_batches(spark)
    model = quality_knn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_knn.keep(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the row with the smallest id stays; of rows repeated with it, one."""
    index = exact_dedup.DigestIndex(spark)
    labelled = stored(exact_dedup.deduplicate(docs.select("doc_id", "text"), index), "labelled")
    discard(spark, index.table)
    kept = labelled.where("kept").select(F.col("keep_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    # The narrow side is the hashed one; a row is known by its id and its text, as ids may be null or shared.
    rows = _wrapped(docs, F.col("doc_id").alias("id"), exact_dedup.digest(F.col("text")).alias("digest"))
    rest = rows.join(kept.hint("shuffle_hash"), (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    if labelled.where("NOT kept AND doc_id <=> keep_id").isEmpty():
        return rest.select("doc.*")
    return _one_of_each(rest, "id", "digest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8, directly or through others, the smallest id stays."""
    small_batches(spark)
    # A row is known by a hash of its id and text, as ids may be null or shared.
    key = F.xxhash64("doc_id", "text").alias("key")
    linked = stored(ngram_join.link_components(docs.select(key, "text"), id_col="key").select("key", "component_id").distinct(), "linked")
    ids = docs.select(key, F.col("doc_id").cast("long").alias("id")).distinct()
    # Null ids come last.
    first = linked.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    kept = stored(first.select(F.col("first.key").alias("key")), "kept")
    discard(spark, linked)
    rest = _wrapped(docs, key).join(kept.hint("shuffle_hash"), "key", "left_semi")
    return _one_of_each(rest, "key")


def _placed(docs: DataFrame) -> DataFrame:
    """Rows (doc, slot, position): documents with their places in the mix, one for each row."""
    mixed = source_mixing.mix(docs.select("doc_id", "source"))
    places = stored(mixed.select(F.col("doc_id").alias("placed_id"), F.col("source").alias("placed_source"), "slot", "position"), "places")
    rows = _wrapped(docs, F.col("doc_id").alias("id"), F.col("source").alias("src"))
    same = F.col("id").eqNullSafe(F.col("placed_id")) & F.col("src").eqNullSafe(F.col("placed_source"))
    if not places.groupBy("placed_id", "placed_source").count().where("count > 1").isEmpty():
        # Rows repeated with an id and source share out that id's places.
        rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("id", "src").orderBy(F.xxhash64("doc.text"), "doc.text")))
        places = places.withColumn("place", F.row_number().over(Window.partitionBy("placed_id", "placed_source").orderBy("position")))
        same &= F.col("turn") == F.col("place")
    return rows.join(places.hint("shuffle_hash"), same).select("doc", "slot", "position")


def interleave_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows, in files and rows ordered by their place in the mix."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _placed(docs).repartitionByRange(parts, "position").sortWithinPartitions("position").select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, slot, position): the mix is the order of position.

    Files that are read again come in any order, so the places are worked out anew:
    the same ids and sources have the same places.
    """
    small_batches(spark)
    keyed = _placed(docs).select(F.struct("doc.doc_id", "slot", "position").alias("row_key"), F.col("doc.text").alias("text"))
    coded = bpe.round_trip(keyed, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, id_col="row_key")
    return coded.select("row_key.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "row_key.slot", "row_key.position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_poor),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("mix", interleave_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        old, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if number:
            discard(spark, old)
        release(spark)
    return docs
