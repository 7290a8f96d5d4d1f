"""Registered queries opN_<name>: each applies an operator, with production
parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm import (
    chat_format, langid, lexical_search, minhash_dedup, mixing, multi_index, multiset_hash, ngram_lm, packing, periodic_runs,
    projection_search, url_filter, warc)
from payguard.llm.oracle import ORACLE_SQL  # noqa: F401
from payguard.llm.common import fold, table, work_folder


def op1_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, langid.training_rows())
    out = langid.identify(docs, model, ["doc_id"], spans=False)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "n_spans")


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_lm.by_folds(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return out.withColumnRenamed("id", "vec_id")


def op4_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited_neighbours(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("url")


#: A conversation whose texts hold template and escape strings of all kinds.
_TRICKY = r"\### Assistant: </turn> ok"


def op8_event_sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRICKY).alias("text"))
    log = chat_format.drafted(chat_format.events_of_turns(turns.unionByName(tricky)))
    out = chat_format.render(chat_format.fold_events(log))
    back = out.withColumn("turns", chat_format.parse("formatted")).withColumn("lost", chat_format.loss_text())
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("lost").cast("long").alias("loss_chars"), F.sha2(F.encode("lost", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


#: Rules of the query: host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op9_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    out = url_filter.judge(table(spark, sf_dir, "pages"), rules)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs, mixing.word_count("text"))
    return out.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


def op11_projected_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    out = projection_search.search(vectors, F.col("vec_id") % 20 == 0)
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op12_scale_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.planted("doc_id", "text").alias("text"))
    return periodic_runs.digests(periodic_runs.find_runs(docs)).withColumnRenamed("id", "doc_id")


def op13_hybrid_taat_daat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES = {f.__name__: f for f in (op1_script_viterbi, op2_deleted_interpolation, op3_inverted_multi_index, op4_shortest_pack_first, op5_minhash, op6_multiset_hash,
                               op7_warc_writer, op8_event_sourced, op9_link_graph, op10_temperature_mix, op11_projected_kd_tree,
                               op12_scale_tiles, op13_hybrid_taat_daat)}
