import pytest

from sortament.llm import queries as q
from tests.conftest import TESTDATA

COLUMNS = {
    "p1_found": {"offer_id_a": "bigint", "offer_id_b": "bigint"}, "p2_found": {"grade_id": "string", "group_id": "string"}, "p6_found": {"offer_id": "bigint", "grade_id": "string"},
    "p7_found": {"offer_id": "bigint", "first_offer_id": "bigint", "copies": "bigint"}, "p8_found": {"item_id": "bigint", "doc_id": "bigint"}, "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", list(q.queries()))
def test_runs(spark, folder, name):
    found = q.queries()[name](spark, folder)
    if name in COLUMNS:
        assert dict(found.dtypes) == COLUMNS[name]
    assert found.count() > 0
    if name.endswith("_found"):
        assert found.count() == found.distinct().count()


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_its_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    found = q.queries()[name](spark, folder)
    columns = sorted(found.columns)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    with duckdb.connect() as c:
        for path in TESTDATA.glob("*.parquet"):
            c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        table = c.execute(q.oracle_sql()[name])
        names = [d[0] for d in table.description]
        want = sorted((tuple(r[names.index(n)] for n in columns) for r in table.fetchall()), key=repr)
    assert sorted(names) == columns and got == want
