"""Names, labels, amounts, opinions and conditions on literal cases."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import text as T
from ledgerloom.operators import predicates as P
from ledgerloom.operators import results


def values(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", column(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_company_names(spark):
    assert values(spark, T.company_name, ["주식회사 한글텍", "(주)한글텍", "유한회사 테스트 (지점)", None]) == ["한글텍", "한글텍", "테스트지점", None]


def test_addresses(spark):
    got = values(spark, T.address_parts, ["전라북도 군산시 현충로 35 (나운동)", "경남 양산시 어디", "달 크레이터", "", None, "세종"])
    assert [tuple(x) for x in got] == [("전북특별자치도", "군산시"), ("경상남도", "양산시"), (None, None), (None, None), (None, None), ("세종특별자치시", None)]


def test_account_labels(spark):
    cases = {
        "Ⅱ . 비유동자산": "비유동자산", "Vl.기말의현금": "기말의현금", "수익(매출액)": "수익(매출액)", "I. 유동자산": "유동자산", "l.유동자산": "유동자산",
        "XⅠ.당기순이익(손실)": "당기순이익(손실)", "Ⅳ. 판매비와관리비(주석13)": "판매비와관리비", "기말의 현금(Ⅳ+Ⅴ)": "기말의현금", "Ⅱ. 매출원가(주석10과 13)": "매출원가",
        "X. 당기순이익(손실)(주석16)(주당손익 당기 (14,770)원  전기  (11,169)원)": "당기순이익(손실)", "판매비와관리\n비": "판매비와관리비", "∥.비유동자산": "비유동자산", "자산총계": "자산총계",
    }
    assert values(spark, T.account_label, list(cases)) == list(cases.values())
    assert values(spark, T.has_roman_prefix, ["Vl.기말의현금", "유동자산", "Ⅳ.매출", None]) == [True, False, True, False]


def test_amounts(spark):
    cases = {"12,426,276,421": 12426276421, "(393,502,380)": -393502380, "-": 0, "": None, "16,507,429,508 ====": 16507429508, "====": None, "abc": None, None: None}
    assert values(spark, A.won_amount, list(cases)) == list(cases.values())
    assert values(spark, A.whole_number, ["12.9", "-3.7", " 5 ", "", "x", None, "9007199254740993", "1e3", "inf"]) == [12, -3, 5, None, None, None, 9007199254740993, 1000, None]


def test_signs(spark):
    rows = spark.createDataFrame([(0, "영업손실", 5), (1, "매출총손실", -5), (2, "영업이익(손실)", -5), (3, "매출총손실(이익)", 5), (4, "매출액", 7), (5, "영 업 손 실", 5)], "i int, l string, v long")
    assert [r["y"] for r in rows.select("i", A.signed_by_label(F.col("l"), F.col("v")).alias("y")).orderBy("i").collect()] == [-5, 5, -5, -5, 7, -5]


def test_auditor_keys(spark):
    cases = ["층회계법인 지평", "청현회계법인 대표이사문창규", "회계법인 원지", "원지회계법인", "천일공인회계사감사반", "", None, "아무개"]
    assert values(spark, T.auditor_key, cases) == ["지평회계법인", "청현회계법인", "원지회계법인", "원지회계법인", "천일공인회계사감사반", None, None, "아무개"]


def test_opinions(spark):
    cases = {"<p>공정하게 표시하고있습니다": "적정", "의견을 표명하지 않습니다. 공정하게 표시하고 있습니다": "의견거절", "적정하게 표시하고 있지 않습니다": "부적정", "한정 의견": "한정", "없음": None, " " * 4000 + "의견거절": None}
    assert values(spark, T.audit_opinion, list(cases)) == list(cases.values())


def test_staleness(spark):
    got = values(spark, lambda c: A.is_stale(c, F.lit(date(2024, 3, 1))), [None, "20230302", "20230301", "20240101"])
    assert got == [True, False, True, False]


def test_ratios_and_extremes(spark):
    rows = spark.createDataFrame([(100, 25, 10, 200, 50, 80), (0, 1, 1, 1, 1, 1), (100, 25, 10, 200, 50, -80), (100, None, 1, 1, 1, 1)], "r long, g long, o long, a long, l long, e long")
    got = [r[0] for r in rows.select(A.report_ratios(*[F.col(c) for c in "rgoale"])).collect()]
    assert tuple(got[0]) == (0.25, 0.1, 0.625, 0.4) and got[1] is None and got[2].debt_ratio == -0.625 and got[3] is None


def test_region_conditions(spark):
    rows = spark.createDataFrame([("경상남도", "김해시"), ("경상남도", "창원시"), ("부산광역시", "중구"), ("서울특별시", "중구"), (None, None)], "sido string, sigungu string")
    condition = {"sido": ["경남", "부산"], "sigungu_by_sido": {"경남": ["김해시"], "부산": []}}
    assert [r[0] for r in rows.select(P.in_region(F.col("sido"), F.col("sigungu"), condition)).collect()] == [True, False, True, False, False]
    assert P.region_map({"sido": "경남", "sigungu": ["김해시"]}) == {"경상남도": ["김해시"]}
    with pytest.raises(P.BadRequest):
        P.checked_region({"sido": ["경남"], "sigungu_by_sido": {"부산": ["중구"]}})


def test_unknown_industry_tokens_give_no_filter():
    assert P.industry_prefixes(["C25", "x"], {"C": ["10", "29"]}) == []
    assert P.industry_prefixes(["C", "10", "101"], {"C": ["10", "29"]}) == ["10", "29", "101"]


def test_request_checks():
    assert P.checked_ids("3,1,3") == [3, 1] and P.checked_ids(None) is None and P.checked_ids("") == []
    for bad in ("0", "x", str(1 << 63)):
        with pytest.raises(P.BadRequest):
            P.checked_ids(bad)
    assert P.checked_enum("ok,OK", P.STATUSES) == ["OK"] and P.checked_enum("", P.STATUSES) == []
    with pytest.raises(P.BadRequest):
        P.checked_enum("no", P.STATUSES)
    assert P.checked_values(["a", "", "a"]) == ["a"] and P.checked_text("  ") is None
    assert P.bounds_of({"a": (1, 2), "b": (3, 1), "c": (None, 0.5)}) == {"a": (100_000_000, 200_000_000), "c": (None, 50_000_000)}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "1"]), st.sampled_from([None, "OK", "PARTIAL", "FAILED", ""])), max_size=6))
def test_four_states_hold_each_row_once(spark, rows):
    df = spark.createDataFrame(rows, "r string, s string")
    label = P.status_of(F.col("r"), F.col("s"))
    n = sum(df.where(label == k).count() for k in P.STATUSES[:1]) + df.where(label.isin(P.STATUSES[1:])).count()
    assert n == len(rows)


def test_like_signs_are_literal(spark):
    df = spark.createDataFrame([("50%할인",), ("50할인",), ("대로_1",), (None,), ("",)], "x string")
    assert [r[0] for r in df.where(P.text_filter(F.col("x"), "50%")).collect()] == ["50%할인"]
    assert df.where(P.text_filter(F.col("x"), "_", exclude=True)).count() == 4


def test_sort_keys():
    assert results.sort_keys("a:desc,x:asc,b:up,a:asc", ["a", "b"]) == [("a", "desc")]
    assert results.sort_keys(None, ["a"], "a", "asc") == [("a", "asc")] and results.sort_keys(None, ["a"], "z") == []
