"""The registered queries as they are: columns of the contract first and in order, one row
per document, vector, page or conversation of the whole table."""

from __future__ import annotations

import pytest

from payguard.llm import queries

SF = "/root/testdata/sf0.001"

#: Query: columns and types, table, key.
CONTRACTS = {
    "op1_script_viterbi": ("doc_id bigint, held_out boolean, lang_pred string, score double", "documents", "doc_id"),
    "op2_deleted_interpolation": ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
                                  " base_score double, score double", "documents", "doc_id"),
    "op3_inverted_multi_index": ("vec_id bigint, n_links bigint, component_id bigint, kept boolean", "embeddings", "vec_id"),
    "op4_shortest_pack_first": ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
                                " sequence_id bigint, offset bigint", "documents", "doc_id"),
    "op5_minhash": ("doc_id bigint, n_shingles bigint, component_id bigint, kept boolean", "documents", "doc_id"),
    "op6_multiset_hash": ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
                          " near_edited double, near_next double", "documents", "doc_id"),
    "op7_warc_writer": ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
                        "pages", "page_id"),
    "op8_event_sourced": ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
                          " formatted_chars bigint", "conversations", "conv_id"),
    "op9_link_graph": ("page_id bigint, host string, path string, rule string, verdict string", "pages", "page_id"),
    "op12_scale_tiles": ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint,"
                         " runs_sha256 string, collapsed_sha256 string", "documents", "doc_id"),
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns_and_rows_of_the_query(spark, name):
    schema, table, key = CONTRACTS[name]
    out = queries.QUERIES[name](spark, SF)
    wanted = [c.strip().split(" ") for c in schema.split(",")]
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields][:len(wanted)] == [tuple(w) for w in wanted]
    rows = sorted(r[0] for r in out.select(key).collect())
    ids = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    if name == "op8_event_sourced":
        assert rows == sorted({*ids, -7})
    elif name == "op4_shortest_pack_first":
        assert set(rows) == set(ids)
    else:
        assert rows == sorted(ids)
