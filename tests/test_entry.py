import importlib
import subprocess
import sys
from decimal import Decimal

import pytest

from tests.conftest import ROOT, TESTDATA


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


def test_entry(spark, entry):
    if not TESTDATA.exists():
        pytest.skip("test tables are not there")
    assert entry.entry(spark).count() > 0


def test_names(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())


def core_names():
    from sortament.plans import registry

    return sorted(registry.queries())


def plain(value):
    """A value as both engines give it."""
    if isinstance(value, Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", core_names())
def test_query_equals_its_sql(spark, folder, name):
    """Rows and their values are equal, each as often."""
    duckdb = pytest.importorskip("duckdb")
    from sortament.plans import registry

    found = registry.queries()[name](spark, folder)
    columns = sorted(found.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    sql = registry.oracle_sql().get(name)
    if sql:
        with duckdb.connect() as c:
            for path in TESTDATA.glob("*.parquet"):
                c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
            table = c.execute(sql)
            names = [d[0] for d in table.description]
            assert sorted(names) == columns
            want = [tuple(plain(r[names.index(n)]) for n in columns) for r in table.fetchall()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_works_without_the_training_data_subpackage():
    code = (
        "import sys, importlib.util as u; real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n.startswith('sortament.llm') else real(n, *a)\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q and not [m for m in sys.modules if m.startswith('sortament.llm')]"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
