"""Training-data pipeline over the table ``documents``, one operator per stage.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: one document of each group of near duplicates stays.
3. decontaminate: documents that hold a benchmark passage go.
4. mix: sources are mixed to their target weights.
5. tokens: the token shards, decoded to one row per document.

Each stage works on all that its predecessor kept, written as Parquet and read
again.  Null and empty texts pass through stages 1 to 4 unless the classifier
rejects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import decontam, jaccard, mix, quality, repair
from tablescope.llm.common import stored, table
from tablescope.llm.queries import tokenizer_file


def _free(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to clash with no column of ``docs``."""
    while name in docs.columns:
        name = "_" + name
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text: rows of one key are copies, whatever ids are null or shared."""
    key = _free(docs, "_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of at least 0.5.

    Labels of rows whose crc32(doc_id) mod 3 is 1 stay unused, as in the
    operator's query.  Statistics are computed once and written with the rows.
    """
    stats, label, score = _free(docs, "_stats"), _free(docs, "_quality"), _free(docs, "_score")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias(label)).dropna()
    measured = stored(quality.with_statistics(docs, "text", stats), "pipeline-statistics")
    # Only the statistics meet the labels; texts are not shuffled.
    learn = measured.select("doc_id", stats).join(labels, "doc_id").where(quality.fold(F.col("doc_id"), 3) != 1)
    model = quality.fit_quality(learn, label, stats=stats)
    return quality.score_statistics(measured, model, stats, score).where(F.col(score) >= 0.5).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 of 5-word shingles.

    The smallest doc_id of a group stays (null last); of rows with the same id
    and text one.  Texts without words all stay.
    """
    keyed, key = _keyed(docs)
    groups = stored(jaccard.jaccard_components(keyed, k=5, num=80, den=100, id_col=key).where("n_shingles > 0"), "pipeline-groups")
    ids = keyed.select(F.col(key).alias("id"), F.struct(F.col("doc_id").isNull(), "doc_id", key).alias("rank"))
    first = groups.join(ids, "id").groupBy("component").agg(F.min("rank").alias("first"))
    lost = groups.join(first, "component").where(F.col("id") != F.col(f"first.{key}")).select(F.col("id").alias(key)).distinct()
    kept = keyed.join(lost, key, "left_anti")
    twice = groups.groupBy(F.col("id").alias(key)).count().where("count > 1").select(key)
    several = kept.join(twice, key, "left_semi").dropDuplicates([key])
    return kept.join(twice, key, "left_anti").unionByName(several).select(docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage with at most 10 % character edits."""
    keyed, key = _keyed(docs)
    leaks = decontam.leaked_passages(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("id").alias(key))
    return keyed.join(leaks.distinct(), key, "left_anti").select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document once for every epoch in which the mix takes a word of it.

    A document at its source's cut is taken whole; one of which the mix takes
    nothing goes, one without words stays once.
    """
    size, epochs, epoch = (_free(docs, n) for n in ("_size", "_epochs", "_epoch"))
    words = mix.word_count(F.col("text"))
    mixed = mix.mix_sources(docs, words).select(
        F.col("id").alias("doc_id"), F.col("source"), F.col("size").alias(size),
        F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(1).cast("int").alias(epochs))
    # Rows that share id, source and size are alike to the mix: they share their epochs.
    per = mixed.groupBy("doc_id", "source", size).agg(F.max(epochs).alias(epochs))
    rows = docs.withColumn(size, words).alias("d").join(
        per.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))
        & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col(f"d.{size}") == F.col(f"m.{size}")))
    return (rows.where(F.col(f"m.{epochs}") > 0).select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(
        F.sequence(F.lit(1), F.col(f"m.{epochs}"))).alias(epoch)).select(docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_symbols) of every document, read back from its shards."""
    return repair.read_token_documents(repair.write_token_shards(docs, tokenizer_file(), name="pipeline-tokens"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
          ("decontaminate", decontaminate_stage), ("mix", mix_stage), ("tokens", token_stage)]

#: SQL expresses none of classifier, alignment and tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
