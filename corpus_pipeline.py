"""Cleaning and packing of ``documents``: each stage applies one operator to all that the stage before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet and read again as the next
stage's documents; all but the last return the columns of documents. In every stage rows are judged by their own texts:
null and empty texts, null ids and ids of several rows are kept as they are unless the stage says otherwise, texts of any
length are read whole, further columns pass through (but for names that begin with two underscores), and an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import ngram_join, packing, secret_scan, suffix_dedup, toxicity
from genoloom.operators.deploy import ship_package
from genoloom.operators.lineage import written

#: A passage counts as repeated here from so many bytes (about 40 words) or so many words, whatever their length.
PASSAGE_BYTES, PASSAGE_WORDS = 250, 51


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` (if it is there) counted again."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the machine learns from this input's labelled documents. Rows of
    one id and equal texts have equal scores, so they stay or go together; null and empty texts are scored as texts
    without words."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    machine = toxicity.fit(docs, learned)
    return toxicity.score(docs, machine, score_col="__toxicity").filter("__toxicity < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row, of the smallest id, of each group linked by a Jaccard similarity of 0.8 or more over
    five-word shingles, or by equal texts without words. Repeated rows and rows of one id are judged by their own
    texts; a null id comes after all others. Blank texts stay."""
    ship_package(spark)
    num = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62))
    blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    some = docs.filter(~blank).withColumns({"__num": num, "__mark": F.xxhash64("text")})
    linked = ngram_join.linked(some, "__num")
    wordless = F.when(F.col("component").isNull(), F.col("mark")).alias("wordless")
    one = linked.groupBy("component", wordless).agg(F.min(F.struct("id", "mark")).alias("m"))
    one = one.select(F.col("m.id").alias("__num"), F.col("m.mark").alias("__mark"))
    # rows that repeat id and text first become one in each task
    kept = some.dropDuplicates(["__num", "__mark"]).join(one, ["__num", "__mark"], "left_semi")
    return kept.select(*docs.columns).unionByName(docs.filter(blank))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that also stand elsewhere. A row that repeats another's text loses all of
    it that is long enough, with both rows, so near copies are dropped before; null texts stay null."""
    ship_package(spark)
    key = suffix_dedup.text_key("text")
    cut = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES, coarse=128, fine=64, keep_text=True, words=PASSAGE_WORDS)
    cut = cut.filter("n_removed > 0").select(F.col("key").alias("__key"), F.col("kept").alias("__kept")).dropDuplicates(["__key"])
    joined = docs.withColumn("__key", key).join(cut, "__key", "left")
    return _columns(joined.withColumn("text", F.coalesce("__kept", "text")), docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark wherever they stand in their text; null texts stay null."""
    ship_package(spark)
    path = "source" if "source" in docs.columns else None
    return _columns(secret_scan.mask_secrets(docs, path_col=path), docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of the documents that are left, a row each; texts without words have no batch."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scan", hide_secrets),
    ("packing", pack_documents),
]

#: The learned scores of two stages can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
