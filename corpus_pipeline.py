"""From raw documents to packed training sequences, stage by stage.

Every stage gets the documents that its predecessor kept, as a table written and reread, and all but the last return the
columns of documents. Decisions take effect: rejected documents go, contaminated spans and personal data leave the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.additive import quality_scores
from crossweave.llm.automaton import decontaminate
from crossweave.llm.disclosure import sanitise
from crossweave.llm.packing import pack_documents
from crossweave.llm.probminhash import near_documents
from crossweave.llm.registry import table, tokenizer_path
from crossweave.session import stage

#: Documents below this score go; those with more than this share of their words in benchmark windows go whole.
LEAST_QUALITY, MOST_OVERLAP = 0.3, 0.5
#: Chunks whose ids a worker remembers when packing: its memory stays with a worker that also runs the other stages.
REMEMBERED = 200_000


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, follows the text again."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the additive model scores at LEAST_QUALITY or more. Null texts are scored as empty ones."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id in each class; rows with a null id stay, repeated rows of an id become one."""
    kept = near_documents(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark spans out of the texts, and drops documents that are mostly such spans."""
    return _sized(decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=MOST_OVERLAP))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and the terms that disclose it; no document goes."""
    return _sized(sanitise(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 tokens; null texts have the end id only."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), "lead", 0, memory=REMEMBERED)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("benchmark_free", benchmark_free), ("personal_data", personal_data), ("packing", packing)]

#: Trained models, signatures and tokenizers are not SQL; tests compare run() with a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
