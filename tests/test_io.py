"""Sources, sinks and paging."""

import json
import os

import pytest
from pyspark.sql import functions as F

from taskgrid.operators import view
from taskgrid.sinks import writers
from taskgrid.sources import files, schema
from tests.conftest import make_tasks


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_csv_na_tokens_and_types(spark, tmp_dir):
    p = f"{tmp_dir}/a/part.csv"
    _write(p, "list_name,ali,polygon_status,zip,latitude,note\n"
              "R,12,None,01234,1.5,N/A\n"
              "R,x,Draft,,NaN,keep\n"
              "NA,,null,00007,-2,#N/A\n")
    rows = files.read_tasks_csv(spark, f"{tmp_dir}/a").collect()
    assert len(rows) == 3
    by_zip = {r.zip: r for r in rows}
    assert by_zip["01234"].ali == 12 and by_zip["01234"].polygon_status is None
    assert by_zip["00007"].list_name is None and by_zip["00007"].latitude == -2.0
    assert by_zip[None].ali is None and by_zip[None].polygon_status == "Draft"   # unparsable → null
    assert by_zip[None].latitude is None                                          # NaN token → null
    assert by_zip[None].note == "keep" and by_zip["01234"].note is None


def test_union_sheets_by_name(spark, tmp_dir):
    _write(f"{tmp_dir}/s1/a.csv", "list_name,ali\nA,1\n")
    _write(f"{tmp_dir}/s2/a.csv", "ali,list_name,zip\n2,B,00001\n")
    _write(f"{tmp_dir}/s3/a.csv", "remark,ali\nhi,3\n")
    df = files.union_sheets(spark, [f"{tmp_dir}/s1", f"{tmp_dir}/s2", f"{tmp_dir}/s3"])
    assert df.columns == ["list_name", "ali", "zip", "remark"]
    got = sorted((tuple(r) for r in df.collect()), key=lambda t: t[1])
    assert got == [("A", 1, None, None), ("B", 2, "00001", None), (None, 3, None, "hi")]


def test_schema_checks(spark):
    df = make_tasks(spark, [{"ali": 1}])
    assert schema.missing_columns(df) == []
    part = df.select("ali", "list_name")
    chk = {r.column_name: (r.present, r.has_rows) for r in schema.input_check(part).collect()}
    assert chk["ali"] == (True, True) and chk["address"] == (False, True) and len(chk) == 12
    with pytest.raises(ValueError, match="lacks the columns"):
        schema.validate(part)
    with pytest.raises(ValueError, match="no rows"):
        schema.validate(df.limit(0))
    assert all(not r.has_rows for r in schema.input_check(df.limit(0)).collect())
    renamed = schema.rename_columns(df, {"ali": "ALI", "nope": "x"})
    assert "ALI" in renamed.columns and "ali" not in renamed.columns
    assert schema.from_display(schema.to_display(df)).columns == df.columns
    assert schema.available_columns(df).columns == ["list_name", "ali", "address", "city", "zip", "polygon_status"]


def test_writers_round_trip(spark, tmp_dir):
    df = make_tasks(spark, [{"ali": i, "list_name": "R", "latitude": float(i)} for i in range(5)])
    writers.write_table(df, f"{tmp_dir}/t", fmt="csv", display_names=True)
    back = schema.from_display(files.read_tasks_csv(spark, f"{tmp_dir}/t", types=None))
    assert sorted(r.ali for r in back.collect()) == ["0", "1", "2", "3", "4"]   # types=None: text
    asg = df.withColumn("analyst", F.when(F.col("ali") < 2, "Ann").otherwise("Bo"))
    writers.write_assignments(asg, ["Ann", "Bo", "Cy"], f"{tmp_dir}/wb")
    summary = {r.analyst: r.tasks_assigned for r in spark.read.parquet(f"{tmp_dir}/wb/summary").collect()}
    assert summary == {"Ann": 2, "Bo": 3, "Cy": 0, "Total": 5}
    assert sorted(d for d in os.listdir(f"{tmp_dir}/wb/sheets") if d.startswith("analyst=")) == \
        ["analyst=Ann", "analyst=Bo"]
    assert spark.read.parquet(f"{tmp_dir}/wb/sheets").count() == 5
    with pytest.raises(ValueError):
        writers.write_table(df, f"{tmp_dir}/x", fmt="xlsx")


def test_json_records(spark):
    df = spark.createDataFrame([(1, float("nan"), None)], "a long, b double, c string") \
        .withColumn("ts", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    rec = json.loads(writers.json_records(df).first().record)
    assert rec == {"a": 1, "b": None, "c": None, "ts": "2024-01-02T03:04:05"}


def test_json_records_nested(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [([1.0, nan, inf, None], {"k": -inf, "m": 2.0}, (nan, [(inf,), None]), inf), (None, None, None, 0.5)],
        "a array<double>, b map<string,double>, c struct<x:double,y:array<struct<z:float>>>, d double")
    got = sorted((json.loads(r.record) for r in writers.json_records(df).collect()), key=lambda r: r["a"] is None)
    assert got[0] == {"a": [1.0, None, None, None], "b": {"k": None, "m": 2.0},
                      "c": {"x": None, "y": [{"z": None}, None]}, "d": None}
    assert got[1] == {"a": None, "b": None, "c": None, "d": 0.5}


def test_pages_cover_table(spark):
    df = make_tasks(spark, [{"ali": i} for i in range(123)])
    pc = view.page_count(df).first()
    assert (pc.rows, pc.pages) == (123, 3)
    seen = [r.ali for p in range(3) for r in view.page(df, p, ["ali"]).collect()]
    assert seen == list(range(123))
    with pytest.raises(ValueError):
        view.page(df, -1)


def test_csv_quotes_integral_floats_and_headers(spark, tmp_dir):
    import os
    from taskgrid.sources.files import read_tasks_csv
    path = os.path.join(tmp_dir, "q.csv")
    with open(path, "w", newline="") as f:
        f.write('list_name,ali,store_name\n"He said ""hi"", ok",30064.0,"C:\\"\n')
    r = read_tasks_csv(spark, path).first()
    assert (r.list_name, r.ali, r.store_name) == ('He said "hi", ok', 30064, "C:\\")
    with open(path, "w", newline="") as f:
        f.write('list_name,ali\n"two\nlines",7\n')
    r = read_tasks_csv(spark, path, multi_line=True).collect()
    assert [(x.list_name, x.ali) for x in r] == [("two\nlines", 7)]
    with pytest.raises(Exception):
        read_tasks_csv(spark, path).collect()


def test_workbook_names_like_numbers_and_empty(spark, tmp_dir):
    import os
    from pyspark.sql import functions as F
    from taskgrid.sinks.writers import write_assignments
    rows = make_tasks(spark, [{"ali": i, "list_name": "R"} for i in range(6)]).withColumn(
        "analyst", F.when(F.col("ali") < 4, "01").otherwise("1"))
    for name, df, want in (("a", rows, [2, 4, 6]), ("b", rows.limit(0), [0, 0, 0])):
        path = os.path.join(tmp_dir, name)
        write_assignments(df, ["01", "1"], path)
        s = spark.read.parquet(f"{path}/summary")
        count = [c for c, t in s.dtypes if t == "bigint"][0]
        assert sorted(r[count] for r in s.collect()) == want


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from taskgrid import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_rejects_list_every_value_that_turned_null(spark, tmp_dir):
    _write(f"{tmp_dir}/r/a.csv", "ali,list_name,latitude,note\n12x,A,1.5,n\n7,B,oops,n\n8.5,NA,NaN,n\n"
                                 "9,C\n10,D,2.5,n,extra\n99999999999999999999,E,1e3,\n")
    got = files.read_checked(spark, f"{tmp_dir}/r")
    rows = got.rows.collect()
    assert got.rows.columns == ["ali", "list_name", "latitude", "note"]
    assert sorted((r.ali or 0, r.latitude or 0.0) for r in rows) == [
        (0, 0.0), (0, 1.5), (0, 1000.0), (7, 0.0), (9, 0.0), (10, 2.5)]
    bad = sorted((r.column_name or "", r.value, r.reason) for r in got.rejects.collect())
    assert bad == [("", "10,D,2.5,n,extra", "wrong number of fields"), ("", "9,C", "wrong number of fields"),
                   ("ali", "12x", "not a bigint"), ("ali", "8.5", "not a bigint"),
                   ("ali", "99999999999999999999", "not a bigint"), ("latitude", "oops", "not a double")]
    assert all(r.file.endswith("/r/a.csv") for r in got.rejects.collect())
    # the count does not depend on the columns a query needs
    assert got.rejects.count() == 6 and got.rejects.filter("column_name is null").count() == 2
    _write(f"{tmp_dir}/ok/a.csv", "ali,list_name\n1,A\n")
    assert files.read_checked(spark, f"{tmp_dir}/ok").rejects.collect() == []
    assert files.read_checked(spark, f"{tmp_dir}/ok", types=None).rejects.collect() == []
    with pytest.raises(Exception, match="not a bigint: 1x"):
        _write(f"{tmp_dir}/f/a.csv", "ali,list_name\n1x,A\n")
        files.read_tasks_csv(spark, f"{tmp_dir}/f", bad_values="fail").collect()
    with pytest.raises(ValueError, match="bad_values"):
        files.read_tasks_csv(spark, f"{tmp_dir}/ok", bad_values="drop")


def test_inferred_types(spark, tmp_dir):
    _write(f"{tmp_dir}/i/a.csv", "ali,n,x,b,d,t,z,m,e\n1,5,1.5,True,2024-01-02,2024-01-02 03:04,007,1,\n"
                                 "2,-6,2,false,NA,2024-01-03,08,a,NA\n3,,1e3,,2024-02-29,2024-01-04T05:06:07.5,9,2,null\n")
    df = files.read_tasks_csv(spark, f"{tmp_dir}/i", infer=True)
    assert dict(df.dtypes) == {"ali": "bigint", "n": "bigint", "x": "double", "b": "boolean", "d": "date",
                               "t": "timestamp", "z": "string", "m": "string", "e": "string"}
    assert [r.n for r in df.orderBy("ali").collect()] == [5, -6, None]
    assert dict(files.read_tasks_csv(spark, f"{tmp_dir}/i").dtypes)["n"] == "string"
    # not a date of any calendar; a whole number beyond 64 bits
    _write(f"{tmp_dir}/j/a.csv", "d,n\n2023-02-29,99999999999999999999\n")
    assert [t for _, t in files.read_tasks_csv(spark, f"{tmp_dir}/j", infer=True).dtypes] == ["string", "double"]


def test_types_merge_over_sheets_that_disagree(spark, tmp_dir):
    _write(f"{tmp_dir}/m1/a.csv", "ali,floor,code,day\n1,1,5,2024-01-01\n")
    _write(f"{tmp_dir}/m2/a.csv", "floor,ali,code\n2.5,2,x\n")
    _write(f"{tmp_dir}/m3/a.csv", "ali,floor,code,day\n3,NA,7,2024-01-02 10:00\n")
    paths = [f"{tmp_dir}/m{k}" for k in (1, 2, 3)]
    df = files.union_sheets(spark, paths, infer=True)
    assert df.dtypes == [("ali", "bigint"), ("floor", "double"), ("code", "string"), ("day", "timestamp")]
    assert sorted(r.floor or 0.0 for r in df.collect()) == [0.0, 1.0, 2.5]
    # sheets one and three share a header and so a scan
    assert len(files._sheets(spark, paths, False)) == 2
    got = files.union_sheets_checked(spark, paths, types={"ali": "bigint", "code": "bigint"})
    assert [(r.column_name, r.value) for r in got.rejects.collect()] == [("code", "x")]


def test_sheets_with_quoted_line_breaks(spark, tmp_dir):
    _write(f"{tmp_dir}/q1/a.csv", 'list_name,ali\n"two\nlines",1\n')
    _write(f"{tmp_dir}/q2/a.csv", 'ali,remark\n2,"x\n\ny"\n')
    df = files.union_sheets(spark, [f"{tmp_dir}/q1", f"{tmp_dir}/q2"], multi_line=True)
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == [("two\nlines", 1, None), (None, 2, "x\n\ny")]


def test_empty_file_infers_text(spark, tmp_dir):
    _write(f"{tmp_dir}/e/a.csv", "ali,n\n")
    df = files.read_tasks_csv(spark, f"{tmp_dir}/e", infer=True)
    assert df.dtypes == [("ali", "bigint"), ("n", "string")] and df.collect() == []


def test_deep_pages_find_their_first_key(spark):
    import random
    rng = random.Random(4)
    keys = [(rng.choice([None, "a", "b", "é"]), rng.choice([None, 1.5, -2.0, float("nan")]), rng.randrange(40)) for _ in range(700)]
    keys += [("m", 0.0, 7)] * 400 + [(None, None, 0)] * 30
    df = spark.createDataFrame(keys, "a string, b double, c int").repartition(5)
    order = lambda r: tuple((v is not None, v != v, 0 if v is None or v != v else v) for v in r)
    want = [repr(order(k)) for k in sorted(keys, key=order)]
    for number in (0, 1, 3, 5, 10, 12, 15, 16, 22, 99):
        got = view.page(df, number, size=50, shallow=60)
        assert [repr(order(tuple(r))) for r in got.collect()] == want[number * 50:number * 50 + 50], number
    assert view.key_at(df, len(keys), shallow=10) is None
    key, before, equal = view.key_at(df.filter("a = 'm'"), 200, shallow=10)
    assert (key, before, equal) == (("m", 0.0, 7), 0, 400)
    # the plan of a deep page keeps one page of rows, not all before it
    plan = view.page(df, 15, size=50, shallow=60)._jdf.queryExecution().optimizedPlan().toString()
    limits = [int(x) for x in __import__("re").findall(r"(?:Global|Local)Limit (\d+)", plan)]
    assert limits and max(limits) <= 50 and "Offset" not in plan


def test_json_intervals_nested(spark):
    import datetime as dt
    gap = [dt.timedelta(days=2, hours=3, seconds=4), dt.timedelta(seconds=-1), dt.timedelta(0), None,
           dt.timedelta(days=-3, microseconds=250), dt.timedelta(days=400, milliseconds=5)]
    df = spark.createDataFrame([(gap[0], gap, {"k": gap[1]}, (gap[4],))],
                               "a interval day to second, b array<interval day to second>, "
                               "c map<string,interval day to second>, d struct<x:interval day to second>")
    text = ["2 days 03:00:04", "-1 days +23:59:59", "0 days 00:00:00", None, "-3 days +00:00:00.000250",
            "400 days 00:00:00.005000"]
    assert json.loads(writers.json_records(df).first().record) == {
        "a": text[0], "b": text, "c": {"k": text[1]}, "d": {"x": text[4]}}


def test_summary_counts_are_observed(spark, tmp_dir):
    df = make_tasks(spark, [{"ali": i, "list_name": f"R{i % 3}" if i % 7 else None} for i in range(50)])
    asg = df.withColumn("analyst", F.when(F.col("ali") < 20, "Ann").when(F.col("ali") < 45, "Bo"))
    writers.write_assignments(asg, ["Ann", "Bo", "Cy"], f"{tmp_dir}/o")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_dir}/o/summary").collect()]
    assert got == [("Ann", 20, "44.4%", "R0, R1, R2"), ("Bo", 25, "55.6%", "R0, R1, R2"), ("Cy", 0, "0.0%", ""),
                   ("Total", 45, "100.0%", "")]
    rows = {(r.analyst, r.list_name): r.n for r in spark.read.parquet(f"{tmp_dir}/o/retailers").collect()}
    assert sum(rows.values()) == sum(1 for i in range(50) if i % 7) and (None, "R0") in rows
