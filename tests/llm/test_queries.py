import os

import duckdb
import pandas as pd
import pytest

from motiflake.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op3_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op4_url_filters": "page_id host path rule verdict",
    "op5_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op8_benchmark_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_hmm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op10_pii_pseudonyms": "doc_id",
}
KINDS = {"doc_id": "bigint", "kept": "boolean", "base_failed": "boolean", "score": "double", "held_out": "boolean", "contaminated": "boolean"}


def plain(rows, columns):
    out = rows[columns].copy()
    for c in columns:
        out[c] = out[c].map(lambda v: "" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v))
    return out.sort_values(columns).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, name):
    df = queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    for c in COLUMNS[name].split():
        assert kinds[c] == KINDS.get(c, kinds[c])
        assert not c.startswith("n_") or kinds[c] == "bigint"
    got = df.toPandas()
    table = "pages" if "url" in name else "documents"
    if "chat" not in name:
        assert len(got) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name not in oracle_sql():
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.execute(oracle_sql()[name]).fetchdf()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    pd.testing.assert_frame_equal(plain(got, columns), plain(want, columns))


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
