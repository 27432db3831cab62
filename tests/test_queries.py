"""Every query with a DuckDB counterpart gives its rows; the others give rows of a stable schema."""

import pytest
from conftest import DATA
from oracle import both

from rasterloom.plans import catalog

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, name):
    got, expected = both(spark, catalog.queries()[name], catalog.oracle_sql()[name], SMALL)
    assert got == expected
    assert got


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_text_operators():
    import subprocess
    import sys

    from conftest import ROOT

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('rasterloom.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert 'lithophane_mesh_report' in names and not any(n.startswith('op') or n == 'pipeline' for n in names)
assert not any('llm' in m for m in sys.modules if m.startswith('rasterloom'))
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)
