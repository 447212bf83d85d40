"""Every registered query of the subpackage over the smallest tables: columns, types, one row a key."""

import os

import pytest

from treeflow.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_suffix_dedup": "doc_id n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    "op2_lm_scoring": "doc_id held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op3_html_extraction": "page_id url:string text:string n_chars:bigint",
    "op4_chat_formatting": "conv_id n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
    "op5_toxicity": "doc_id held_out:boolean score:double predicted:int",
    "op6_url_filter": "page_id host:string path:string rule:string verdict:string",
    "op7_byte_bpe": "doc_id n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op8_decontamination": "doc_id item_id",
    "op9_near_dedup": "doc_id class_id",
    "op10_quality_rules": "doc_id n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op11_fill_in_middle": "doc_id n:bigint form:string prefix_chars:bigint middle_chars:bigint output_sha256:string restored_sha256:string",
    "op12_piece_bpe": "doc_id n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op13_importance_resampling": "doc_id n_features:bigint weight:bigint score:bigint rank:bigint",
}
TABLE = {"op3_html_extraction": "pages", "op4_chat_formatting": "conversations", "op6_url_filter": "pages"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    out = registry.QUERIES[name](spark, SF)
    types = dict(out.dtypes)
    for column in COLUMNS[name].split():
        column, _, kind = column.partition(":")
        assert column in types and (not kind or types[column] == kind), column
    rows = out.collect()
    if name == "op8_decontamination":
        assert rows
        return
    key = COLUMNS[name].split()[0]
    source = spark.read.parquet(f"{SF}/{TABLE.get(name, 'documents')}.parquet")
    keys = sorted(r[0] for r in (source.select(key).distinct() if name == "op4_chat_formatting" else source.select(key)).collect())
    assert sorted(r[key] for r in rows) == ([-1, *keys] if name == "op4_chat_formatting" else keys)
