import duckdb

import __spark_entry__ as entry
from quillon.llm import entries


def test_all_ten_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert list(range(1, 11)) == [int(q[2:].split("_")[0]) for q in names if q.startswith("op")]
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_embedding_links_equal_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    told = {r[0]: r for r in duckdb.sql(entries.OP1_SQL).fetchall()}
    assert {r.vec_id: tuple(r) for r in entries.op1_embedding_links(spark, sf).collect()} == told


def test_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        "op2_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op3_order_minhash": "doc_id class_id kept n_words",
        "op4_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op5_toxicity": "doc_id held_out score predicted",
        "op6_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op7_quality": "doc_id held_out score predicted",
        "op8_url_templates": "page_id host path rule verdict typed_path bad_share",
        "op9_piece_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op10_hash_ring": "doc_id size text_crc32 law shard slot grown_shard",
    }
    for name, columns in want.items():
        df = entry.queries()[name](spark, sf)
        assert df.columns == columns.split(), name
        assert df.count() >= (50 if name.startswith("op8") else 200), name
