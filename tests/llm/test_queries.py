import pytest

from quillspark.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["para_id", "start_pos", "end_pos"],
    "p2_found": ["id_int_a", "id_int_b"],
    "p3_found": ["id_int", "meta_id"],
    "p6_found": ["name_id_a", "name_id_b"],
    "p7_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_runs_with_its_columns(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() == df.distinct().count() > 0
