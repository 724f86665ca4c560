"""Every query of the engine equals its SQL, with rows that are not all alike."""

import pytest

from tesselar.plans import catalog


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_equals_sql(same, name):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables(spark, duck):
    q, data = catalog.queries(), "/root/testdata/sf0.01"
    assert q["a11_source_health"](spark, data).count() == duck.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    assert q["j9_results_of_person_runs"](spark, data).count() == duck.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    got = {tuple(r) for r in q["j17_prefix_join"](spark, data).collect()}
    customers, orders = (duck.sql(x).fetchall() for x in ("SELECT c_custkey FROM customer WHERE c_custkey < 100", "SELECT o_orderkey FROM orders"))
    assert {x for x in got if x[0] < 100} == {(c, o) for (c,) in customers for (o,) in orders if str(o).startswith(str(c))}


def test_sides_cover_the_table(spark, duck):
    from tesselar.plans import surface

    before, since = (e.count() for e in surface.sides(spark, "/root/testdata/sf0.01"))
    assert before and since and before + since == duck.sql("SELECT count(*) FROM events").fetchall()[0][0]
    contacts = catalog.queries()["k1_upsert_contacts"](spark, "/root/testdata/sf0.01")
    assert contacts.count() == duck.sql("SELECT count(*) FROM customer").fetchall()[0][0]
