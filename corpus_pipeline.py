"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtfold.llm import mixing
from courtfold.llm.linededup import line_dedup
from courtfold.llm.neardup import near_dedup
from courtfold.llm.pieces import PieceModel, encode_documents
from courtfold.llm.quality import quality_filter
from courtfold.llm.queries import PIECE_MODEL
from courtfold.llm.work import drop, save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rule and their language's perplexity band keep, each row judged by itself.

    Null and empty texts fail the base rule; null ids don't matter; repeated rows stay or go alike. An empty table stays empty.
    """
    return quality_filter(docs, pieces=PieceModel.load(PIECE_MODEL))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source, and with their new number of characters.

    A null source is a source; null texts become empty; repeated rows are documents of their own. An empty table stays empty.
    """
    out = line_dedup(docs, kept_col="text", lines_col=None, dropped_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts whose five-word shingles are similar by 0.8 or more.

    Rows of one id stay or go together, repeated ones too; null, empty and wordless texts are equal; a row with a null id stays only where its whole group has none.
    An empty table stays empty.
    """
    return near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the token budgets of the domain, language and source tree take, each once at most.

    Null keys are branches of their own; null and empty texts have no tokens and stay only before their leaf's cut; rows equal in id and text stay or go
    alike. An empty table stays empty.
    """
    return mixing.mixed_documents(docs, mixing.domain_of(), mixing.WEIGHTS, budget_share=mixing.SHARE, max_epochs=1, seed=mixing.SEED)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document. Null and empty texts have none; repeated rows stay repeated. An empty table stays empty."""
    return encode_documents(docs, PieceModel.load(PIECE_MODEL))


STAGES = [
    ("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mixture), ("SentencePiece", encoding),
]

#: SQL can't express the perplexity model, near-duplicate components or the encoder; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        done = docs
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            drop(done)
    return STAGES[-1][1](spark, docs, sf_dir)
