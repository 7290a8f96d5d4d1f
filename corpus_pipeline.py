"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; its result is written as a table and reread as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm import langid, minhash_dedup, mixing, packing
from payguard.llm.common import prepare, stored, table

#: Texts of less go: no language has even this much of the text with certainty.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label languages; texts without a letter or without a main language go, so do those in
    scripts that no label uses, however many labels there are. A missing label becomes the predicted
    one. Learns from the rows with a label; if none has one, nothing can be judged and all texts stay.

    Null, empty and blank texts go. Repeated rows are judged alike, and stay or go together; ties between
    languages fall to the first by name, with a score that rejects the text unless one has the larger part.
    An empty table stays empty. Columns of any name pass through."""
    prepare(spark)
    model = langid.learn(docs, F.lit(True))
    if not model.langs:
        return docs
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    out = langid.identify(plain, model, plain.columns, text_col=f"d{names.index('text')}", spans=False)
    out = out.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    lang = f"d{names.index('lang')}"
    return out.withColumn(lang, F.coalesce(lang, "lang_pred")).drop("lang_pred", "score", "n_spans").toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id (five-word
    shingles, similarity of 0.8 or more).

    Null and empty texts are near nothing and stay; of rows with one id one stays, the first by text; rows without
    an id stay. A text of fewer than five words is one shingle. An empty table stays empty. Columns of
    any name pass through."""
    prepare(spark)
    return minhash_dedup.drop_near_duplicates(docs, shingle=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the sources' tempered weights. The budget covers the
    largest source once, so that every document stays at least once.

    Null and empty texts have no words and stay once; a null source is a source; repeated rows are
    documents of their own; rows without an id share their place in the order. An empty table stays empty.
    Columns of any name pass through."""
    prepare(spark)
    return mixing.realise(mixing.mix(docs, mixing.word_count("text"), budget="cover"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 ids.

    Null and empty texts are one piece, the end id. Repeated rows are packed each; pieces of one length are dealt by
    rank, in an order of their own. An empty table gives no piece. Columns other than doc_id and text are left out."""
    prepare(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("pack", pack)]

#: Language models and MinHash groups can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
