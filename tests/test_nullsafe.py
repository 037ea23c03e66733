"""The null and number rules the operators must follow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskgrid.functions import differs, is_in, not_in, pct, require_same_type, same
from taskgrid.operators import compare as c
from taskgrid.operators import quality as q
from tests.conftest import make_tasks

VER = "RETAILSTAT VERIFIED: ROOFTOP"


def test_not_in_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), ("x",), (VER,)], "g string")
    got = [r[0] for r in df.select(not_in(F.col("g"), [VER])).collect()]
    assert got == [True, True, False]
    assert [r[0] for r in df.select(is_in(F.col("g"), [VER])).collect()] == [False, False, True]


def test_differs_and_same_treat_null_as_unequal(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, None)], "a long, b long")
    rows = df.select(differs(F.col("a"), F.col("b")), same(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(False, True), (True, False), (True, False), (True, False)]


def test_pct_is_half_even_like_numpy(spark):
    pairs = [(n, t) for t in (1, 3, 7, 8, 40, 400, 6000, 58825) for n in range(0, min(t, 400) + 1)]
    df = spark.createDataFrame(pairs, "n long, t long")
    got = {(r.n, r.t): r.p for r in df.select("n", "t", pct(F.col("n"), F.col("t")).alias("p")).collect()}
    for (n, t), p in got.items():
        assert p == float(np.round(n / t * 100, 1)), (n, t)
    assert got[(1, 400)] == 0.2 and got[(3, 400)] == 0.8


def test_pct_zero_total_is_null(spark):
    df = spark.createDataFrame([(0, 0)], "n long, t long")
    assert df.select(pct(F.col("n"), F.col("t"))).first()[0] is None


def test_key_types_must_agree(spark):
    a = spark.createDataFrame([(1,)], "ali long")
    b = spark.createDataFrame([("1",)], "ali string")
    with pytest.raises(TypeError):
        require_same_type(a, b, "ali")
    with pytest.raises(TypeError):
        c.matched(a, b, "ali")


def test_null_retailer_rules(spark):
    df = make_tasks(spark, [{"list_name": None}, {"list_name": "A"}, {"list_name": "A"}, {"list_name": "B"}])
    assert q.unique_retailers(df).count() == 3                      # null included
    assert q.unique_retailers_count(df).first()[0] == 2             # null excluded
    assert q.total_records(df).first()[0] == 4                      # totals count it
    per = [tuple(r) for r in q.records_per_retailer(df).collect()]
    assert per == [("A", 2), ("B", 1)]                              # null group dropped


def test_duplicates_nulls_equal_each_other(spark):
    df = make_tasks(spark, [{"ali": None}, {"ali": None}, {"ali": 1}, {"ali": 1}, {"ali": 2}])
    s = q.duplicate_ali_summary(df).first()
    assert (s.total, s.unique_ali, s.duplicate_count) == (5, 2, 2)
    assert sorted((r.ali is None, r.ali) for r in q.duplicate_ali_rows(df).collect()) == \
        [(False, 1), (False, 1), (True, None), (True, None)]


def test_counts_tie_order_by_name(spark):
    df = make_tasks(spark, [{"list_name": n} for n in ["b", "a", "c", "c"]])
    assert [r[0] for r in q.records_per_retailer(df).collect()] == ["c", "a", "b"]


def test_conflicts_fill_blank_and_skip_null_keys(spark):
    d1 = make_tasks(spark, [{"ali": 1, "address": None}, {"ali": 2, "address": "x"},
                            {"ali": None, "address": "p"}, {"ali": 3, "address": "same"}])
    d2 = make_tasks(spark, [{"ali": 1, "address": ""}, {"ali": 2, "address": "y"},
                            {"ali": None, "address": "q"}, {"ali": 3, "address": "same"}])
    got = c.conflicts(d1, d2, "ali", "address").collect()
    assert [(r.ali, r.address_file1, r.address_file2) for r in got] == [(2, "x", "y")]


def test_keep_first_uses_explicit_order(spark):
    df = make_tasks(spark, [{"ali": 1, "address": "b", "city": "z"}, {"ali": 1, "address": "a", "city": "y"},
                            {"ali": 1, "address": None, "city": "x"}])
    first = c.first_per_key(df.select("ali", "address", "city"), "ali").first()
    assert (first.address, first.city) == (None, "x")             # nulls first
    by_city = c.first_per_key(df.select("ali", "address", "city"), "ali", ["city"]).first()
    assert by_city.city == "x"
    by_desc = c.first_per_key(df.select("ali", "address", "city").filter("address IS NOT NULL"), "ali").first()
    assert by_desc.address == "a"
