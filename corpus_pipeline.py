"""From raw documents to token files: quality, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and all that the stage before it kept, and returns a table that
is written as Parquet and read again as the next stage's documents. All but the last return the
columns of documents. Nulls, empty texts and repeated rows are treated as the operators say.
The stages bound the session's Arrow batches by bytes, as whole texts pass through Python workers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevia.llm import decontaminate, minhash_dedup, mixing, quality, token_parquet
from relevia.session import bound_batches, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more; it learns from the labels of ``docs``."""
    bound_batches(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.score_column(model) >= 0.5)


#: Five words to a shingle; the two of the op3 query are a much looser test at the same similarity.
NEAR = minhash_dedup.Method(percent=80, width=5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; other rows of its doc_id go by their own groups."""
    bound_batches(spark)
    return minhash_dedup.keep_one(docs, NEAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that are mostly such passages go."""
    bound_batches(spark)
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    keys = ["doc_id", "source", "size"]
    plan = mixing.mix(docs).select(*[F.col(k).alias(f"#{k}") for k in keys], F.col("copies").alias("#copies"))
    # rows that agree in all of these are told apart by number
    plan = plan.withColumn("#nth", F.row_number().over(Window.partitionBy(*[f"#{k}" for k in keys]).orderBy("#copies")))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = docs.withColumn("#words", words)
    number = Window.partitionBy("doc_id", "source", "#words").orderBy(F.xxhash64("text"))
    rows = rows.withColumn("#row", F.row_number().over(number))
    same = F.col("doc_id").eqNullSafe(F.col("#doc_id")) & F.col("source").eqNullSafe(F.col("#source"))
    same &= (F.col("#words") == F.col("#size")) & (F.col("#row") == F.col("#nth"))
    taken = rows.join(plan.filter("`#copies` > 0"), same)
    return taken.withColumn("#copy", F.explode(F.sequence(F.lit(1), F.col("#copies")))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and their index read back from the files."""
    bound_batches(spark)
    return token_parquet.write_and_index(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token output", token_output),
]

#: A trained classifier, MinHash and a tokenizer are no SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-stage{number}")
    return docs
