"""Every registered training-data query runs over the smallest tables."""

import pytest

from coverline.llm import queries as llm

COLUMNS = {"p1_found": ["src", "item_id", "target_id"], "p2_found": ["kind", "id_a", "id_b"], "p4_found": ["field", "key_id", "defect"], "p5_found": ["keep_row_id", "n_copies"], "p6_found": ["field", "row_id", "ref_id"], "p9_found": ["doc_id", "start_char", "end_char"]}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_runs(spark, small, name):
    df = llm.queries()[name](spark, small)
    assert df.count() > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
