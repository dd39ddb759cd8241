"""The corpus pipeline: quality, near copies, benchmark passages, personal data, token ids.

Each stage takes the documents that its predecessor kept and returns a DataFrame; all but the last keep the
columns of ``documents``.

    1. quality votes        rows that score below KEEP go
    2. n-gram Jaccard join  of each group of linked documents (five words, 0.8) the one of the smallest id stays
    3. decontamination      hit spans are cut; rows of which more than half is hit go
    4. personal data        spans are replaced by their kind
    5. SentencePiece ids    doc_id, ids, byte spans and the decoded text

Defined cases, for every stage: a null or empty text is scored like any other, is linked with nothing, has no hits
and no spans, stays null or empty, and gets the end id alone; texts of any length are handled whole; of linked rows
of one id one stays, rows of one id that aren't linked all stay, and rows with a null id are only filtered by quality
and by what is hit; equal texts score alike, and of linked ones the smallest id stays, so ties don't depend on order;
empty tables give empty tables of the same columns; other columns, whatever their names, pass unchanged until stage 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineform.llm import common, decontamination, ngram_join, personal_data, quality, sentencepieces


def quality_votes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_groups(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.cleaned(docs, common.table(spark, sf_dir, "benchmark"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_votes", quality_votes),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal),
    ("sentencepiece_ids", token_ids),
]

#: The stages are models, joins of hashed sets and a tokenizer; SQL can't express them, so tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
