"""Workbooks, landed sources, versioned tables, closures, conditions, walks, schemas and quotas on small rows."""

import datetime
import json
import threading
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import closure, conditions, predicates, sampling, schemas
from ledgerloom.operators.versioned import Conflict, Store, put_if_absent
from ledgerloom.sources import filings, pages, workbook
from ledgerloom.streaming import quota

# ---- workbooks


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_checksums_join(a, b):
    assert workbook.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_sheets_split_or_refuse(spark, tmp_path):
    df = spark.range(25).select(F.col("id"), F.concat(F.lit("v"), "id").alias("v"))
    path = str(tmp_path / "book.xlsx")
    with pytest.raises(workbook.TooManyRows):
        workbook.write_workbook({"s": (df, ["id"])}, path, most=10)
    assert not (tmp_path / "book.xlsx").exists()
    workbook.write_workbook({"s&": (df, [F.desc("id")]), "empty": (df.limit(0), ["id"])}, path, split=True, most=10)
    assert zipfile.ZipFile(path).testzip() is None
    got = {(r["sheet"], r["row"], r["col"]): r["value"] for r in workbook.read_workbook(spark, path).collect()}
    want = {(s, 1, c): n for s in ("s&", "s& (2)", "s& (3)", "empty") for c, n in enumerate(("id", "v"))}
    for place, k in enumerate(range(24, -1, -1)):
        name = "s&" if place < 10 else f"s& ({place // 10 + 1})"
        want |= {(name, place % 10 + 2, 0): str(k), (name, place % 10 + 2, 1): f"v{k}"}
    assert got == want


def test_csv_quotes_and_replaces(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    df = spark.createDataFrame([(2, 'a "q", b'), (1, "line\nend"), (3, None)], "id long, t string")
    for _ in range(2):
        workbook.write_csv_file(df, path, ["id"])
    assert (tmp_path / "a.csv").read_bytes().decode("utf-8-sig") == 'id,t\n1,"line\nend"\n2,"a ""q"", b"\n3,\n'
    with pytest.raises(workbook.TooManyRows):
        workbook.write_csv_file(df, path, ["id"], most=2)


def test_large_entries_have_wide_sizes():
    entry = workbook._Entry("x")
    entry.text("abc")
    entry.size, entry.packed = 5 << 32, 3
    local, central = entry.headers(5 << 32)
    assert local[18:26] == b"\xff" * 8 and len(local) == 30 + 1 + 20 and central[42:46] == b"\xff" * 4 and len(central) == 46 + 1 + 28


# ---- landed files


def _page(folder, name, items):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({"response": {"body": {"items": items}}}))


def test_filters_leave_out_files(spark, tmp_path):
    for year in (2020, 2021, 2022):
        for k in range(3):
            _page(tmp_path / f"year={year}", f"page-{k}.json", {"item": [{"a": k, "b": None}]})
    (tmp_path / "year=2020/broken.json").write_text("{")
    reader = pages.PageReader({"path": str(tmp_path), "fields": "a,b", "bytes": "1"})
    left = list(reader.pushFilters([pages.GreaterThan(("part",), "2020"), pages.In(("part",), ("2022", "1999")), pages.EqualTo(("a",), "1")]))
    assert [f.attribute for f in left] == [("a",)] and sum(len(p.files) for p in reader.partitions()) == 3 == len(reader.partitions())
    pages.register(spark)
    df = spark.read.format("landed").option("path", str(tmp_path)).option("fields", "a,b").load()
    got = df.where("part > '2020' and a = '1'").select("part", "file", "position", "a", "b").collect()  # the broken file isn't opened
    assert sorted(map(tuple, got)) == [(y, f"year={y}/page-1.json", 0, "1", None) for y in ("2021", "2022")]
    assert df.where("part = '1'").collect() == []


def test_pages_of_any_shape(spark, tmp_path):
    for k, items in enumerate(({"item": {"a": 1}}, {"item": []}, "", None, {"item": [{"a": "x"}, {}]})):
        _page(tmp_path, f"p{k}.json", items)
    pages.register(spark)
    got = spark.read.format("landed").option("path", str(tmp_path)).option("fields", "a").load().orderBy("file", "position").collect()
    assert [(r["part"], r["a"]) for r in got] == [(None, "1"), (None, "x"), (None, None)]


def test_stream_goes_on_behind_what_it_has(spark, tmp_path):
    pages.register(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("landed").option("path", str(source)).option("fields", "a").load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r["a"] for r in spark.read.parquet(out).collect())

    _page(source, "0.json", {"item": [{"a": 1}]})
    assert run() == ["1"] and run() == ["1"]
    _page(source, "1.json", {"item": [{"a": 2}, {"a": 3}]})
    assert run() == ["1", "2", "3"]


# ---- versioned tables


def test_one_of_two_writers_wins(spark, tmp_path):
    wins = []
    writers = [threading.Thread(target=lambda k=k: wins.append(put_if_absent(spark, str(tmp_path / "x.json"), f"{k}" * 1000))) for k in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(wins) == [False] * 5 + [True] and len(set((tmp_path / "x.json").read_text())) == 1


def test_a_lost_update_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"jobs": "id"})
    assert store.version() == 0
    base = store.commit(0, {"jobs": spark.createDataFrame([(k, "DONE") for k in range(40)], "id long, status string")})
    first = store.update("jobs", F.col("id") == 3, {"status": F.lit("A")}, base)
    with pytest.raises(Conflict):
        store.update("jobs", F.col("id") == 3, {"status": F.lit("B")}, base)
    assert first == 1 and store.update("jobs", (F.col("id") == 3) & (F.col("status") == "DONE"), {"status": F.lit("C")}) == 0
    assert store.version() == 2 and store.table("jobs").where("id = 3").first()["status"] == "A" and store.table("jobs").count() == 40
    before, after = store.manifest(1)["jobs"]["buckets"], store.manifest(2)["jobs"]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1  # only the row's bucket was written anew
    assert store.table("jobs", 1).where("status <> 'DONE'").isEmpty()


def test_old_versions_are_forgotten(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": "id"}, buckets=4)
    store.commit(0, {"t": spark.range(20)})
    for k in range(4):
        store.commit(store.version(), {"t": spark.range(k, k + 1)}, {"t": [k]})
        store.forget(2)
    assert store.version() == 5 and sorted(int(f.name[:12]) for f in (tmp_path / "_commits").glob("*.json")) == [4, 5]
    assert store.table("t").count() >= 1 and store.table("t", 4).count() >= 1
    folders = {p.parent for p in (tmp_path / "t").rglob("*.parquet")}
    assert len(folders) <= 8


def test_cascade_is_one_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"jobs": "id", "results": "job_id", "snapshots": "result_id"}, buckets=4)
    rows = {"jobs": ([(1,), (2,), (None,)], "id long"), "results": ([(10, 1), (11, 1), (12, 2), (13, None)], "id long, job_id long"), "snapshots": ([(5, 10), (6, 11), (7, 12), (8, None)], "id long, result_id long")}
    store.commit(0, {k: spark.createDataFrame(*v) for k, v in rows.items()})
    links = [("jobs", "id", None, None), ("results", "job_id", "jobs", "id"), ("snapshots", "result_id", "results", "id")]
    assert store.delete_cascade(spark.createDataFrame([(1,)], "id long"), links) == {"jobs": 1, "results": 2, "snapshots": 2}
    assert store.version() == 2 and sorted(r["id"] for r in store.table("snapshots").collect()) == [7, 8]
    assert {r["id"] for r in store.table("results").collect()} == {12, 13} and store.table("jobs").count() == 2
    assert store.delete_cascade(spark.createDataFrame([(1,)], "id long"), links) == {"jobs": 0, "results": 0, "snapshots": 0} and store.version() == 2
    assert store.delete_cascade(spark.createDataFrame([(2,)], "id long"), links[:1])["jobs"] == 1 and store.table("jobs").count() == 1


# ---- closures, conditions, walks


def test_closure_of_graphs(spark):
    edges = [(k, k + 1) for k in range(20)] + [(0, 5), (3, 30), (30, 31), (0, 5), (None, 1), (1, None)]
    got = {(r["ancestor"], r["descendant"]): r["depth"] for r in closure.closure(spark.createDataFrame(edges, "parent int, child int")).collect()}
    want, steps = {}, {a: {b for x, b in edges if x == a and b is not None} for a, _ in edges if a is not None}
    for a in range(32):
        front, depth, seen = {a}, 0, set()
        while front:
            front, depth = {b for x in front for b in steps.get(x, ())} - seen, depth + 1
            seen |= front
            want |= {(a, b): depth for b in front}
    assert got == want
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent int, child int")
    with pytest.raises(closure.Cyclic):
        closure.closure(circle)
    kept = {(r["ancestor"], r["descendant"]): r["depth"] for r in closure.closure(circle, cycles="keep").collect()}
    assert kept[1, 1] == 3 and kept[1, 4] == 3 and len(kept) == 12
    assert closure.closure(circle.limit(0)).collect() == []


def test_conditions_meet_as_filters_do(spark):
    children = {"A": ["11", "12"], "C": ["30", "31"]}
    jobs = [
        (1, None, None, None, None), (2, '{"sido":"서울"}', '["A","1"]', '{"min_krw":5}', None), (3, '{"sido":["경남","서울특별시"],"sigungu_by_sido":{"경상남도":["김해시","진주시"]}}', "[]", None, '{"min_krw":1,"max_krw":9}'),
        (4, '{"sido":"경남","sigungu":["김해시","김해시"]}', '["11","111","C"]', '{"min_krw":null,"max_krw":7}', None), (5, '{"sido":[]}', '["X"]', None, None),
    ]
    people = [(k, s, d, c, r, a) for k, (s, d, c, r, a) in enumerate(
        (s, d, c, r, a) for s, d in (("서울특별시", "중구"), ("경상남도", "김해시"), ("경상남도", None), (None, None), ("경상남도", "밀양시")) for c in ("11101", "30", "2", None, "12345") for r in (None, 6) for a in (None, 3, 10)
    )]
    j = spark.createDataFrame(jobs, "job_id int, cond_region string, cond_industry string, cond_revenue string, cond_total_assets string")
    p = spark.createDataFrame(people, "id int, sido string, sigungu string, induty_code string, revenue long, total_assets long")
    got = sorted((r["job_id"], r["id"]) for r in conditions.matches(p, conditions.condition_index(j, children)).select("job_id", "id").collect())
    want = []
    for k, region, industry, revenue, assets in jobs:
        test = predicates.in_region(F.col("sido"), F.col("sigungu"), json.loads(region) if region else None)
        test &= predicates.in_industry(F.col("induty_code"), predicates.industry_prefixes(json.loads(industry or "[]"), children))
        for c, bounds in (("revenue", revenue), ("total_assets", assets)):
            b = json.loads(bounds or "{}")
            test &= predicates.amount_between(F.col(c), b.get("min_krw"), b.get("max_krw"))
        want += [(k, r["id"]) for r in p.where(test).collect()]
    assert got == sorted(want) and len(set(got)) == len(got)


def test_sums_of_jobs_are_those_of_their_candidates(spark):
    regions = [None, '{"sido":"서울"}', '{"sido":["경남","서울특별시"],"sigungu_by_sido":{"경상남도":["김해시","진주시"]}}', '{"sido":"경남","sigungu":["김해시"]}']
    ranges = [None, '{"min_krw":5}', '{"max_krw":7}', '{"min_krw":-3,"max_krw":4}', '{"min_krw":6,"max_krw":2}', '{"min_krw":3,"max_krw":3}', f'{{"min_krw":{-(2**63)},"max_krw":{2**63 - 1}}}']
    texts = [(r, i, a, b) for r in regions for i in (None, '["A","1"]', '["11","30","123456"]') for a in ranges for b in ranges]
    jobs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts + texts[:50])], "job_id long, cond_region string, cond_industry string, cond_revenue string, cond_total_assets string")
    places = [("서울특별시", "중구"), ("경상남도", "김해시"), ("경상남도", None), (None, None)]
    amounts = [None, -(2**63), -4, 0, 3, 5, 8, 2**63 - 1]
    people = [(k, *places[k % 4], ("11101", "30", "2", None)[k // 4 % 4], amounts[k // 16 % 8], amounts[k // 128 % 8]) for k in range(1024)]
    p = spark.createDataFrame(people, "id long, sido string, sigungu string, induty_code string, revenue long, total_assets long")
    met = conditions.matches(p, conditions.condition_index(jobs, {"A": ["11", "12"]})).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.sum("id").alias("total"))
    want = sorted(map(tuple, met.collect()))
    assert len(want) > 500 and sorted(map(tuple, conditions.summaries(p, jobs, {"A": ["11", "12"]}).collect())) == want
    assert conditions.summaries(p, jobs.limit(0)).collect() == conditions.summaries(p.limit(0), jobs).collect() == []
    open_ = conditions.summaries(p, jobs.where("cond_revenue is null and cond_total_assets is null"))
    assert sorted(r["job_id"] for r in open_.collect())[:1] == [0]


@pytest.mark.parametrize("goal, budget", [(5, 1000), (5, 7), (1000, 1000), (0, 10), (3, 0), (40, 90)])
def test_walks_equal_a_loop(spark, goal, budget):
    import hashlib

    rows = [(k, k % 3 == 0) for k in range(120)]
    got = sampling.walk_until(spark.createDataFrame(rows, "k long, h boolean"), "k", F.col("h"), goal, budget, seed=2)
    want, hits = [], 0
    for k, h in sorted(rows, key=lambda r: hashlib.md5(f"2:{r[0]}".encode()).hexdigest()):
        if hits >= goal or len(want) >= budget:
            break
        hits += h
        want.append((k, h, len(want) + 1, h, hits))
    assert sorted((r["k"], r["h"], r["call"], r["hit"], r["hits"]) for r in got.collect()) == sorted(want)


# ---- schemas


def test_kinds_that_hold_both():
    assert schemas.wider("int", "bigint", "c") == "bigint" and schemas.wider("decimal(10,2)", "decimal(9,3)", "c") == "decimal(11,3)"
    assert schemas.wider("int", "float", "c") == "double" and schemas.wider("bigint", "decimal(5,2)", "c") == "decimal(21,2)" and schemas.wider("date", "timestamp_ntz", "c") == "timestamp_ntz"
    for a, b in (("bigint", "double"), ("string", "int"), ("decimal(38,0)", "decimal(38,10)"), ("boolean", "int")):
        with pytest.raises(schemas.Incompatible):
            schemas.wider(a, b, "c")


def test_narrowing_is_refused(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "1"))
    spark.range(3).select(F.col("id").cast("int"), F.lit("x").alias("t")).write.parquet(str(tmp_path / "2"))
    got = schemas.read_generations(spark, str(tmp_path), {"new": "double"}, {"t": "none", "new": 1})
    assert got.dtypes == [("id", "bigint"), ("t", "string"), ("new", "double")]
    assert sorted(map(tuple, got.collect())) == sorted([(k, t, 1.0) for k in range(3) for t in ("none", "x")])
    with pytest.raises(schemas.Incompatible):
        schemas.read_generations(spark, str(tmp_path), {"id": "int"})
    plan = got.where("id > 1").select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id)" in plan


# ---- quotas


def test_days_that_are_over_are_refused(spark, tmp_path):
    kind = "id long, time timestamp"
    day = datetime.datetime(2024, 1, 1, 12)
    files = [[(1, 0), (2, 0), (3, 0), (4, 1)], [(5, 0), (6, 1), (7, 1), (8, 1)], [(9, 4), (10, 0)], [(11, 0), (12, 4)]]
    for k, rows in enumerate(files):
        spark.createDataFrame([(i, day + datetime.timedelta(days=d, seconds=i)) for i, d in rows], kind).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        quota.start(stream, str(tmp_path / "out"), str(tmp_path / "c"), 3).awaitTermination()
    got = {r["id"]: r["call"] for r in quota.outcomes(spark, str(tmp_path / "out"), kind).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 5: None, 6: 2, 7: 3, 8: None, 9: 1, 10: None, 11: None, 12: 2}
    state = spark.read.schema(quota.USED).parquet(str(tmp_path / "out/state/batch=3")).collect()
    assert [(str(r["day"]), r["used"]) for r in state] == [("2024-01-05", 2)]


# ---- filings


def test_broken_markup_still_has_sections():
    rows = filings.cut("<A><B><TITLE>재무상태표<P>x</B><TABLE><TR><TD ROWSPAN='2'>a<TD>b</TR><TR><TH>c</TABLE><P>y")
    assert [r[0] for r in rows] == ["TITLE", "P", "ROW", "ROW", "P"] and rows[0][-2:] == (0, 2)
    assert [c[4:] for c in rows[2][5]] == [(2, False), (1, False)] and rows[3][5][0][5] is True
    assert filings.cut("") == [] and filings.cut("</A></A><P/>")[0][0] == "P"


def test_documents_are_spread_and_cut_once(spark):
    from .conftest import SF

    from ledgerloom.plans import filing_queries

    for made in (filing_queries._statements, filing_queries._section_documents):
        assert made(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # one small file isn't one task's
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    text = "<DOC><TITLE>재무상태표</TITLE><TABLE><TR><TD>a</TD></TR></TABLE></DOC>".encode()
    docs = spark.createDataFrame([(str(k), text) for k in range(20)], "rcept_no string, content binary").mapInPandas(read, "rcept_no string, content binary")
    assert filings.rendered_sections(filings.document_rows(docs)).count() == 20 and seen.value == 20


def test_batches_of_rows_stay_small(spark):
    text = ("<TABLE>" + "<TR><TD COLSPAN='2'>　a</TD><TD/></TR>" * 3000 + "</TABLE>").encode()
    rows = filings.document_rows(spark.createDataFrame([(str(k), text) for k in range(12)] + [("x", None)], "rcept_no string, content binary").coalesce(1))
    got = rows.groupBy("rcept_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cells")).alias("c"), F.max(F.get("cells", F.lit(0))).alias("first")).collect()
    assert len(got) == 12 and all((r["n"], r["c"], tuple(r["first"])) == (3000, 6000, ("a", 2, 1, -1, 1, False)) for r in got)
    made = filings._as_batch([("1", 0, "P", None, None, None, "t", None, None, None), ("1", 1, "ROW", 1, "F", True, None, [], 0, 2)])
    assert made.column(7).to_pylist() == [None, []]


def test_each_sheet_is_a_task(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    df = spark.range(35).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    workbook.write_workbook({"a": (df, ["id"]), "b & c": (df.limit(0), ["id"])}, path, split=True, most=10)
    cells = workbook.read_workbook(spark, path)
    parts = {(r["sheet"], r["part"]) for r in cells.select("sheet", F.spark_partition_id().alias("part")).distinct().collect()}
    assert len(parts) == 5 and len({part for _, part in parts}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r["sheet"], r["row"], r["col"]): r["value"] for r in cells.collect()}
    want = {(s, 1, c): v for s in ("a", "a (2)", "a (3)", "a (4)", "b & c") for c, v in enumerate(("id", "text"))}
    want |= {("a" if k < 10 else f"a ({k // 10 + 1})", k % 10 + 2, c): v for k in range(35) for c, v in enumerate((str(k), f"t{k}"))}
    assert got == want and cells.count() == len(want)
