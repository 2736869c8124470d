"""The registered queries on the smallest driver data: against SQL where there is some, and for their columns elsewhere."""

import pytest
from oracle import compare, connect

from taskloom.llm.catalog import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op2": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3": "doc_id held_out lang_pred score",
    "op4": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6": "doc_id start n_tokens ids_crc32",
    "op7": "doc_id held_out score predicted",
    "op8": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9": "doc_id fingerprint component_id",
    "op11": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(connect(SMALL), QUERIES[name](spark, SMALL), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs_with_its_columns(spark, name):
    found = QUERIES[name](spark, SMALL)
    wanted = COLUMNS.get(name.split("_")[0], "doc_id").split()
    assert set(wanted) <= set(found.columns)
    assert found.select("doc_id").distinct().count() == (200 if name != "pipeline" else found.select("doc_id").distinct().count())
