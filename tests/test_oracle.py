import pytest
from oracle import same

from weft.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, data, name):
    same(registry.QUERIES[name](spark, data), registry.SQL[name], data)


def test_core_stands_alone():
    """The library runs without the llm subpackage."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['weft.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
