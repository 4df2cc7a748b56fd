import pytest

import __spark_entry__
from eventspark import queries

from .oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_operators():
    """The guard of the entry module, in a process that cannot import them."""
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['eventspark.llm'] = None; import __spark_entry__ as e; assert not any(q.startswith('op') for q in e.queries()); assert 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__spark_entry__.__file__.rsplit("/", 1)[0]).returncode == 0
