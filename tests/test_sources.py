"""Auditors' lines, unit-wise ingest, streaming snapshots."""

from pyspark.sql import functions as F

from ledgerloom.plans import ingest
from ledgerloom.sources import auditors
from ledgerloom.streaming import filings as stream


def test_auditors(spark):
    def doc(*lines):
        return ("<DOC>" + "".join(f"<P>{x}</P>" for x in lines) + "</DOC>").encode("cp949")

    docs = [
        ("1", doc("안경회계법인", "본문", "서울시 영등포구 여의대로 1", "삼 일 회 계", "삼일회계법인", "대표이사 아무개")),
        ("2", doc("회계법인 보명 대표이사 이 만 호")),
        ("3", doc("경남", "창원시 성산구 2, 3층안경회계법인")),
        ("4", doc("외부감사 담당 회계법인")),
        ("5", None),
    ]
    df = spark.createDataFrame(docs, "rcept_no string, content binary")
    got = {r["rcept_no"]: (r["auditor_name"], r["auditor_address"]) for r in auditors.auditors(df).collect()}
    assert got["1"] == ("삼일회계법인", "서울특별시 영등포구 여의대로 1")
    assert got["2"] == ("회계법인 보명", None) and got["4"] == got["5"] == (None, None)
    assert got["3"][0] == "안경회계법인" and got["3"][1].startswith("경상남도 창원시")
    row = spark.createDataFrame([("가회계법인", "경상남도 창원시 1"), ("나회계법인", None), (None, "x y")], "n string, a string")
    assert [r[0] for r in row.select(auditors.shown(F.col("n"), F.col("a"))).collect()] == ["가회계법인(경상남도 창원시)", "나회계법인", None]


def test_ingest_resumes(spark, tmp_path):
    calls = []

    def read(unit):
        calls.append(unit)
        if unit == "b" and calls.count("b") == 1:
            raise ValueError("broken")
        return spark.createDataFrame([(unit, 1)], "unit string, v int")

    args = (spark, ["b", "a", "c"], read, str(tmp_path / "t"), str(tmp_path / "m"))
    assert set(ingest.ingest(*args)) == {"b"} and ingest.ingest(*args) == {} and ingest.ingest(*args) == {}
    assert calls == ["a", "b", "c", "b"] and spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert ingest.supervised(lambda force: ingest.ingest(*args, force=force)) == {}


def test_index_rows(spark):
    sheet = spark.createDataFrame([("10", 0, "(주)가나다", "123-456", "1-2", "경남 김해시 1", "식품 제조업")], "unit string, position int, corp_name string, jurir_no string, bizr_no string, address string, induty_name string")
    listed = spark.createDataFrame([("10", 0, "00000001", "가나다")], "unit string, position int, corp_code string, listed_name string")
    codes = spark.createDataFrame([("식품제조업", "101")], "name string, code string")
    row = ingest.index_rows(sheet, listed, codes)[0].first()
    assert (row["corp_name_norm"], row["jurir_no"], row["sido"], row["sigungu"], row["induty_code"]) == ("가나다", "123456", "경상남도", "김해시", "101")


def test_stream_of_filings(spark, tmp_path):
    src, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for rows in ([(1, "2023", "2024A", 0, 5), (1, "2024", "2024A", 1, 6)], [(1, "2023", "2023A", 1, 7), (1, "2024", "2025A", 0, 9)]):
        spark.createDataFrame(rows, stream.SCHEMA).coalesce(1).write.mode("append").json(src)
        stream.start(spark, src, target, mark).awaitTermination()
    got = {(r["fiscal_year"], r["rcept_no"], r["revenue"]) for r in stream.current(spark, target).collect()}
    assert got == {("2023", "2023A", 7), ("2024", "2024A", 6)}
