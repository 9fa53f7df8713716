import pytest

from sievelake.plans import general_problems, reference_queries

CASES = [(m, n) for m in (reference_queries, general_problems) for n in m.SQL]


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query_equals_its_sql(compare, module, name):
    compare(module, name)


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["stem_tokens", "parse_filters", "required_phrases", "hash_bucket_tokens", "filter_match_fraction", "p5_values"])
def test_queries_without_sql_give_rows(spark, name):
    import __spark_entry__ as e

    from tests.conftest import DATA

    assert e.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qi", "item_id", "score", "rnk"]
