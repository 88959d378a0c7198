"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last returns
packed token rows. run() writes each stage's result as Parquet in the shared folder and reads it for the next, so a stage is
computed once, and what an executor's loss destroys is only the work of the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import decontaminate, mixing, near_dedup, packing, toxicity
from tributary.llm.common import discard, id_filter, settle, split_by, table
from tributary.llm.queries import CATEGORIES, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with a toxic probability at the chain's threshold or above go."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score(docs, chain, CATEGORIES).filter(F.col("p.toxic") < F.lit(chain.threshold)).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near duplicates the document of least id stays, one row of it. Rows without id stay.

    Rows that share an id but differ in text are decided on by themselves.
    """
    found = settle(near_dedup.near_duplicates(docs, by_text=True), "near_duplicates")
    gone = found.filter("NOT kept AND doc_id IS NOT NULL").select("doc_id", "text_hash").distinct()
    maybe, out = split_by(docs, "doc_id", settle(id_filter(gone, "doc_id"), "gone_bits"))  # few texts meet the ids by a shuffle
    out = out.unionByName(maybe.join(gone, (maybe["doc_id"] == gone["doc_id"]) & (F.xxhash64(maybe["text"]) == gone["text_hash"]), "left_anti").select(*docs.columns))
    again = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = settle(again, "repeated")
    if again.limit(1).count():  # rows that share an id: those with one text are copies
        once = out.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
        out = out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
    return out


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: passages of benchmark items are cut out of documents; the rest of a document stays."""
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), cut=True)
    clean, hit = decontaminate.cleaned(found), F.col("hits.n_hit") > 0
    return clean.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as its source's target takes it."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rows of 2048 token ids, with segment lengths and positions."""
    import public_tokenizers

    return packing.pack(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("mixing", to_weights),
    ("packing", packed),
]

#: The classifier, the buckets, the tokenizer and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir), f"stage_{name}", "zstd")
        discard(before)  # the input table is none that settle() wrote
    return docs
