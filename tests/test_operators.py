"""Operators on literal rows: histories, upserts, repairs, homonyms, filings, sinks, jobs."""

import zipfile
from datetime import date
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import bands, history, latest, matching, peers, quality, reshape, results
from ledgerloom.plans import jobs
from ledgerloom.sources import dimensions, filings, landed, sinks, workbook


def naive_fold(rows, n, had=()):
    got = {y: ("", o) for y, o in had}
    own = {y for y, o in had if o}
    if len(got) >= n and not (set(got) - own - {min(got)}):
        return set()
    new = {}
    for rcept, fy in sorted(rows, reverse=True):
        if len(got) >= n and set(got) <= own:
            break
        if len(got) >= n and fy not in got:
            break
        if fy not in own and (fy in got or len(got) < n):
            got[fy] = new[fy] = (rcept, 1)
            own.add(fy)
        if fy - 1 not in got and len(got) < n:
            got[fy - 1] = new[fy - 1] = (rcept, 0)
    return {(str(y), r, o) for y, (r, o) in new.items()}


def test_history_fold(spark):
    import random

    rnd = random.Random(5)
    cases = {k: [(f"{2030 - j}{k:03d}", rnd.choice([2025 - j, 2024 - j, 2025 - j, 2022])) for j in range(rnd.randint(1, 7))] for k in range(40)}
    rows = [(k, r, y) for k, v in cases.items() for r, y in v]
    got = history.history_fold(spark.createDataFrame(rows, "result_id long, rcept_no string, fiscal_year int"), 4).collect()
    for k, v in cases.items():
        assert {(r.fiscal_year, r.rcept_no, r.from_current_period) for r in got if r.result_id == k} == naive_fold(v, 4), v


def test_history_fold_from_existing_rows(spark):
    f = spark.createDataFrame([(1, "20250101", 2024), (1, "20240101", 2023), (2, "20250101", 2024)], "result_id long, rcept_no string, fiscal_year int")
    had = spark.createDataFrame([(1, "2024", 0), (1, "2023", 1), (2, "2024", 1), (2, "2023", 0)], "result_id long, fiscal_year string, own int")
    got = {(r.result_id, r.fiscal_year, r.rcept_no, r.from_current_period) for r in history.history_fold(f, 2, had).collect()}
    assert got == {(1, "2024", "20250101", 1)}  # company 2 is complete but for its oldest year


def test_auditor_changes(spark):
    names = [None, "회계법인 원지", None, "원지회계법인", "다른회계법인", None]
    df = spark.createDataFrame([(1, str(2018 + i), n) for i, n in enumerate(names)], "result_id long, fiscal_year string, auditor_name string")
    got = [r[0] for r in history.with_auditor_change(df, ["result_id"]).orderBy("fiscal_year").select("changed_from_prev").collect()]
    assert got == [None, None, None, False, True, None]
    assert history.company_auditor_change(df, ["result_id"]).first()["auditor_changed"] == 1
    two = spark.createDataFrame([(1, ""), (1, "가회계법인")], "result_id long, auditor_name string")
    assert history.company_auditor_change(two, ["result_id"]).first()["auditor_changed"] == 0


def test_upsert_replaces_with_nulls_and_last_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 5, 0), ("b", None, 1), ("c", 7, 2)], "k string, v int, n int")
    assert {tuple(r) for r in latest.upsert(old, new, ["k"], "n").collect()} == {("a", 1), ("b", None), ("c", 7)}
    assert tuple(latest.upsert_counts(old, new, ["k"]).first()) == (1, 1)


def test_yearly_stats(spark):
    rows = [("120", "1", "2024", "5.0"), ("110", "1", "2024", "5"), ("999", "2", "2024", "1"), ("120", "0" * 13, "2024", "1"), ("120", " ", "2024", "1"), ("120", "3", "", "1")]
    df = spark.createDataFrame(rows, "fnclDcd string, crno string, bizYear string, amt string")
    assert [tuple(r) for r in latest.yearly_stats(df, {"revenue": "amt"}).collect()] == [("1", "2024", 5)]


def test_band_order(spark):
    df = spark.createDataFrame([(1, 100_000_000), (2, 9_000_000_000), (3, 40_000_000_000), (4, None)], "id long, ref_revenue long").withColumn("ref_total_assets", F.lit(None).cast("long"))
    order = [r["id"] for r in bands.with_band_score(df, {"min_krw": 6_000_000_000, "max_krw": 15_000_000_000}, None).orderBy("score", "id").collect()]
    assert order[0] == 2 and order.index(4) not in (0, 3)
    assert {r["score"] for r in bands.with_band_score(df, None, None).collect()} == {0.0}


def test_positional_join_rejects_whole_units(spark):
    names = [f"회사{i}" for i in range(20)]
    sheet = spark.createDataFrame([(u, i, n) for u in ("a", "b") for i, n in enumerate(names)], "unit string, position int, corp_name string")
    listed = [("a", i, f"{i:08d}", n if i > 2 else "달라") for i, n in enumerate(names)] + [("b", i, f"{i:08d}", n) for i, n in enumerate(reversed(names))]
    rows, verdict = matching.positional_join(sheet, spark.createDataFrame(listed, "unit string, position int, corp_code string, listed_name string"))
    assert {r["unit"]: r["accepted"] for r in verdict.collect()} == {"a": True, "b": False}
    assert rows.count() == 20


def test_swapped_rows_return(spark):
    kind = "corp_code string, corp_name_norm string, crawl_induty_code string, jurir_no string, induty_code string, induty_name string"
    index = spark.createDataFrame([("A", "x", "10", "222", "b", "비"), ("B", "x", "10", "111", "a", "에이"), ("C", "y", "10", "333", "c", "씨"), ("D", "x", "10", "999", "d", "디")], kind)
    profiles = spark.createDataFrame([("A", "1-1-1", "a"), ("B", "222", "b"), ("D", "444", "z")], "corp_code string, jurir_no string, induty_code string")
    got = {r["corp_code"]: (r["jurir_no"], r["induty_code"], r["induty_name"], r["repair"]) for r in matching.repair_swapped(index, profiles, ["jurir_no", "induty_code", "induty_name"]).collect()}
    assert got == {"A": ("111", "a", "에이", "repaired"), "B": ("222", "b", "비", "repaired"), "C": ("333", "c", "씨", "untouched"), "D": ("444", "z", None, "fallback")}


def test_homonyms(spark):
    res = spark.createDataFrame([(1, "DEAD0001", "유성정밀", "경남 김해시 1"), (2, "DEAD0002", "(주)유성정밀", "경남 김해시 2")], "id long, corp_code string, corp_name string, address string")
    codes = spark.createDataFrame([("DEAD0001", "유성정밀", "20240101"), ("BUSAN001", "유성정밀", "20230101"), ("REAL0001", "유성정밀", "20220101")], "corp_code string, corp_name string, modify_date string")
    fil = spark.createDataFrame([("REAL0001", "20240401000001"), ("REAL0001", "20230401000001"), ("BUSAN001", "20240401000009")], "corp_code string, rcept_no string")
    prof = spark.createDataFrame([("REAL0001", "경상남도 김해시 3"), ("BUSAN001", "부산 중구 4")], "corp_code string, address string")
    assert [tuple(r) for r in matching.resolve_homonyms(res, codes, fil, prof).collect()] == [(1, "REAL0001", "20240401000001")]


def test_homonyms_equal_choosing_one_by_one(spark):
    import random

    rnd = random.Random(4)
    places = ["경남 김해시", "경남 창원시", "부산 중구", "경남", "어디", ""]
    names = ["유성", "(주)유성", "한빛", "대한"]
    res = [(i, f"D{i}", rnd.choice(names), rnd.choice(places[:3] if i % 3 else places)) for i in range(40)]
    res = [(i, c, n, "부산 중구" if n == "대한" else a) for i, c, n, a in res]
    cod = [(f"C{i:02d}", rnd.choice(names), rnd.choice(["2024", "2023", None]), rnd.choice(places)) for i in range(50)]
    kinds = ["id long, corp_code string, corp_name string, address string", "corp_code string, corp_name string, modify_date string", "corp_code string, rcept_no string", "corp_code string, address string"]
    tables = [res, [c[:3] for c in cod], [(c[0], "R" + c[0]) for c in cod], [(c[0], c[3]) for c in cod]]
    got = matching.resolve_homonyms(*[spark.createDataFrame(t, k) for t, k in zip(tables, kinds, strict=True)], region={"sido": ["경남"]})

    def parts(a):
        words = a.split()
        sido = {"경남": "경상남도", "부산": "부산광역시"}.get(words[0]) if words else None
        return sido, words[1] if sido and len(words) > 1 else None

    taken, expected = set(), set()
    for i, _, n, a in res:
        w = parts(a)
        for c, m, _, b in sorted(cod, key=lambda c: (c[2] or "", c[0]), reverse=True):
            p = parts(b)
            near = p[0] == w[0] and w[1] in (None, p[1]) if w[0] else p[0] == "경상남도"
            if c not in taken and m.replace("(주)", "") == n.replace("(주)", "") and near:
                taken.add(c)
                expected.add((i, c, "R" + c))
                break
    assert {tuple(r) for r in got.collect()} == expected and len(expected) > 10


def test_places_and_median(spark):
    from statistics import median

    from ledgerloom.operators.ordering import ranked_within

    rows = [(g, v, i) for i, (g, v) in enumerate([(1, 5), (1, None), (None, 2), (None, 2), (1, 5), (2, 1), (1, 9)] * 5)]
    df = spark.createDataFrame(rows, "job_id int, v int, id long")
    got = {(r["job_id"], r["id"]): r["place"] for r in results.with_place(df, [("v", "desc")], ["job_id"]).collect()}
    for g in (1, 2, None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        assert [got[g, x[2]] for x in own] == list(range(1, len(own) + 1))
    assert ranked_within(df.where("id < 0"), ["job_id"], ["id"]).count() == 0
    for v in ([3.0], [1.0, 2.0], [2.0, 2.0, 7.0, None], [1.0, 1.0, 1.0, 4.0, 6.0, 9.0], []):
        known = [x for x in v if x is not None]
        assert bands.median(spark.createDataFrame([(x,) for x in v], "v double"), "v") == (median(known) if known else None)
    some = spark.createDataFrame([(1, i, None if i % 3 == 0 else i * 10**9) for i in range(1, 9)], "job_id int, id long, ref_revenue long").withColumn("ref_total_assets", F.lit(None).cast("long"))
    ranks = bands.band_rank(some, ["job_id"], revenue={"min_krw": 10**9, "max_krw": 4 * 10**9}, assets=None)
    assert [r["band_rank"] for r in ranks.orderBy("score", "id").collect()] == list(range(1, 9))


def test_nearest_with_ties_and_fallback(spark):
    pool = spark.createDataFrame([(1, "25119", 100), (2, "25120", 100), (3, "25110", 100), (4, "25900", 500), (5, "251", 90), (6, "25", 100), (7, "46100", 1)], "result_id long, induty_code string, revenue long")
    got = {}
    for r in peers.nearest(pool, pool, 2).orderBy("target_id", "rank").collect():
        got.setdefault(r["target_id"], []).append((r["peer_id"], r["level"]))
    assert got[1] == [(2, 3), (3, 3)] and got[3] == [(1, 3), (2, 3)] and got[4] == [(1, 2), (2, 2)] and got[6] == [(1, 2), (2, 2)] and 7 not in got


def test_nearest_equals_all_pairs(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, rnd.choice(["101", "1012", "102", "20", "201", "9"]), rnd.randint(0, 12)) for i in range(60)]
    pool = spark.createDataFrame(rows, "result_id long, induty_code string, revenue long")
    got = {}
    for r in peers.nearest(pool, pool, 3).collect():
        got.setdefault(r["target_id"], {})[r["rank"]] = r["peer_id"]
    for i, c, v in rows:
        want = []
        for n in (3, 2):
            if len(c) >= n:
                m = [(abs(w - v), j) for j, d, w in rows if j != i and d[:n] == c[:n] and len(d) >= n]
                if len(m) >= 2:
                    want = [j for _, j in sorted(m)[:3]]
                    break
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want


def test_unpivot_keeps_nulls_and_children(spark):
    from ledgerloom.functions import fixed

    row = {f"{i}_cur": None for i in fixed.ITEMS} | {"id": 1, "corp_name": "가", "revenue_cur": 5}
    df = spark.createDataFrame([row], ", ".join(f"{k} {'string' if k == 'corp_name' else 'long'}" for k in row))
    det = spark.createDataFrame([(1, "revenue", 0, "제품매출", 1, 3)], "id long, item string, position int, label string, level int, amount long")
    rows = reshape.selection_rows(df, det).orderBy("position", "child").collect()
    assert len(rows) == 25 and len(fixed.SELECTION_ITEMS) == len(set(fixed.SELECTION_ITEMS)) == len(fixed.ITEMS) == 24
    at = [r["account"] for r in rows].index("매출액")
    assert rows[at + 1]["account"] == "제품매출" and rows[at + 1]["parent"] == "매출액" and rows[at]["statement"] == "손익계산서"


FINANCE = """<?xml version="1.0" encoding="utf-8"?><DOC><TITLE>재 무 상 태 표</TITLE><TABLE ACLASS="FINANCE"><THEAD><TR><TH>과목</TH><TH COLSPAN="2">당기</TH><TH COLSPAN="2">전기</TH></TR></THEAD>
<TBODY><TR><TE ALEVEL="0">Ⅰ. 유동자산</TE><TE></TE><TE>700</TE><TE></TE><TE>600</TE></TR><TR><TE ALEVEL="1">1.현금및현금성자산</TE><TE>100</TE><TE></TE><TE>90</TE><TE></TE></TR>
<TR><TE ALEVEL="1">(-)정부보조금</TE><TE>(30)</TE><TE></TE><TE>(20)</TE><TE></TE></TR><TR><TE ALEVEL="1">매출채권</TE><TE>200</TE></TR><TR><TE ALEVEL="1">단기대여금</TE><TE>50</TE></TR><TR><TE ALEVEL="1">대손충당금</TE><TE>(70)</TE></TR>
<TR><TE ALEVEL="0">자산총계</TE><TE></TE><TE>1,000 ====</TE><TE></TE><TE>900</TE></TR><TR><TE>유동자산</TE><TE>1</TE></TR></TBODY></TABLE>
<TITLE>손익계산서</TITLE><TABLE ACLASS="FINANCE"><TBODY><TR><TD>Ⅰ.매출액<주석3></TD><TD>500</TD><TD></TD><TD>400</TD></TR><TR><TD>Ⅴ. 영업손실</TD><TD>40</TD><TD></TD><TD>(5)</TD></TR></TBODY></TABLE><TITLE>주석</TITLE><TABLE ACLASS="FINANCE"><TBODY><TR><TD>매출원가</TD><TD>9</TD></TR></TBODY></TABLE></DOC>"""
ATTACHED = """<DOC><TITLE>(첨부)재 무 제 표</TITLE><P>연 결 재 무 상 태 표</P><TABLE><TBODY><TR><TD>제6기 2024</TD></TR></TBODY></TABLE><TABLE><THEAD><TR><TH>과 목</TH><TH>주석</TH><TH>제 6(당) 기</TH><TH>제 5(전) 기</TH></TR></THEAD>
<TBODY><TR><TD>II.유동자산</TD><TD></TD><TD></TD><TD></TD></TR><TR><TD>  현금및현금성자산</TD><TD>4</TD><TD>10</TD><TD>20</TD></TR><TR><TD>유동자산합계</TD><TD>5</TD><TD>52</TD><TD>51</TD></TR></TBODY></TABLE>
<TABLE><TR><TD>포 괄 손 익 계 산 서</TD></TR></TABLE><TABLE><TBODY><TR><TD>과목</TD><TD>제6기 기말</TD><TD>제5기 기말</TD></TR><TR><TD>매출</TD><TD>500</TD><TD>400</TD></TR><TR><TD>매출원가</TD><TD>(300)</TD><TD>(200)</TD></TR><TR><TD>영업손실</TD><TD>(40)</TD><TD>5</TD></TR></TBODY></TABLE></DOC>"""


def test_filing_items(spark):
    docs = [("F", FINANCE.encode("cp949")), ("A", ATTACHED.encode()), ("N", b"<DOC><P>nothing</P></DOC>"), ("E", None), ("B", b"<TABLE><TR><TD")]
    df = spark.createDataFrame(docs, "rcept_no string, content binary")
    items = {(r["rcept_no"], r["item"]): (r["cur"], r["prv"]) for r in filings.statement_items(filings.document_rows(df)).collect()}
    assert items["F", "current_assets"] == (700, 600) and items["F", "total_assets"] == (1000, 900)
    assert items["F", "cash_and_equivalents"] == (70, 70) and items["F", "trade_receivables"] == (200, None)
    assert items["F", "revenue"] == (500, 400) and items["F", "operating_income"] == (-40, 5) and ("F", "cogs") not in items
    assert items["A", "current_assets"] == (52, 51) and items["A", "cash_and_equivalents"] == (10, 20)
    assert items["A", "revenue"] == (500, 400) and items["A", "cogs"] == (300, 200) and items["A", "operating_income"] == (-40, 5)
    parsed = {r["rcept_no"]: r["parse_status"] for r in filings.parsed_filings(df).collect()}
    assert set(parsed) == {"F", "A", "N", "E", "B"} and set(parsed.values()) == {"PARTIAL"}


def test_account_details_and_sections(spark):
    df = spark.createDataFrame([("F", FINANCE.encode())], "rcept_no string, content binary")
    rows = filings.document_rows(df)
    got = [(r["item"], r["label"], r["level"], r["cur"]) for r in filings.account_details(rows).orderBy("item", "position").collect()]
    assert got[0] == ("current_assets", "1.현금및현금성자산", 1, 100) and len(got) == 5
    html = {r["section"]: r["html"] for r in filings.section_html(rows).collect()}
    assert html["is"].startswith("<table><tr><td>Ⅰ.매출액</td>") and '<th colspan="2">' in html["bs"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "가\x01<b>", 1.5), (2, None, float("nan"))], "id long, name string, v double")
    workbook.write_csv_file(df, str(tmp_path / "a.csv"), ["id"])
    assert (tmp_path / "a.csv").read_bytes().decode("utf-8-sig").splitlines() == ["id,name,v", "1,가<b>,1.5", "2,,"]
    workbook.write_workbook({"results": (df, ["id"])}, str(tmp_path / "a.xlsx"))
    raw = (tmp_path / "a.xlsx").read_bytes()
    assert landed._sheet_rows(raw) == [["id", "name", "v"], ["1", "가<b>", "1.5"], ["2"]]
    assert "xl/workbook.xml" in zipfile.ZipFile(BytesIO(raw)).namelist()
    page = sinks.reports(spark.createDataFrame([('{"a": "</script>"}',)], "payload string"), "<script>const EMBEDDED_DATA = {x: '}', y: {}}; f()</script>").first()["html"]
    assert page == '<script>const EMBEDDED_DATA = {"a": "\\u003c/script>"}; f()</script>'
    with pytest.raises(ValueError):
        sinks.embedded_block("const EMBEDDED_DATA = {")
    names = sinks.unique_names(spark.createDataFrame([("A", 1), ("a", 2), ("B", 3)], "stem string, id int"), "stem", "id").orderBy("id")
    assert [r["file_name"] for r in names.collect()] == ["A.html", "a_2.html", "B.html"]


def test_landed_sources(spark, tmp_path):
    (tmp_path / "stats").mkdir()
    for i, item in enumerate(('[{"crno":"1"},{"crno":"2"}]', '{"crno":"3"}')):
        (tmp_path / f"stats/{i}.json").write_text(f'{{"response":{{"body":{{"totalCount":3,"items":{{"item":{item}}}}}}}}}')
    (tmp_path / "stats/9.json").write_text('{"response":{"body":{"totalCount":0,"items":""}}}')
    assert {r["crno"] for r in landed.stat_pages(spark, str(tmp_path / "stats"), ["crno"]).collect()} == {"1", "2", "3"}
    html = spark.createDataFrame([("10", 1, "<a href=\"#\" onclick=\"openCorpInfoNew('00000001', 'w');\"> 가 </a><a onclick=\"openCorpInfoNew('00000002', 'w')\">나</a> [1/3]")], "unit string, page int, html string")
    assert [tuple(r) for r in landed.listed_companies(html, "html").collect()] == [("10", 1, 3, 0, "00000001", "가"), ("10", 1, 3, 1, "00000002", "나")]
    with zipfile.ZipFile(tmp_path / "codes.zip", "w") as z:
        z.writestr("CORPCODE.xml", "<result><list><corp_code> 1 </corp_code><corp_name>가</corp_name><stock_code> </stock_code></list><list><corp_code/></list></result>")
    assert [tuple(r) for r in landed.code_zip(spark, str(tmp_path / "codes.zip")).collect()] == [("1", "가", None, None)]
    for name, body in (("rcept_no=1/b.xml", "b"), ("rcept_no=1/a.pdf", "p"), ("rcept_no=2/z.PDF", "z"), ("rcept_no=3/x.txt", "t")):
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_text(body)
    assert {(r["rcept_no"], r["kind"]) for r in landed.documents(spark, str(tmp_path / "docs")).collect()} == {("1", "XML"), ("2", "PDF")}
    (tmp_path / "regions.json").write_text('{"가": ["a", "b"], "나": []}')
    assert dimensions.regions(spark, str(tmp_path / "regions.json")).count() == 3
    (tmp_path / "tree.json").write_text('[{"code":"C","name":"제조","children":[{"code":"10","name":"식품","children":[{"code":"101","name":"도축"}]},{"code":"11","name":"음료"}]}]')
    tree = dimensions.industries(spark, str(tmp_path / "tree.json"))
    assert tree.count() == 4 and dimensions.children_of_letters(tree) == {"C": ["10", "11"]}


def test_descendants_and_drift(spark):
    codes = spark.createDataFrame([("C",), ("10",), ("101",), ("1012",), ("25",)], "code string")
    assert {r["code"] for r in results.without_descendants(codes).collect()} == {"C", "10", "25"}
    a = spark.createDataFrame([(1, 5, "x"), (2, None, "y")], "id long, v long, w string")
    b = spark.createDataFrame([(1, 5, "z"), (2, 7, "y")], "id long, v long, w string")
    assert [r["id"] for r in quality.drift(a, b, ["w"]).collect()] == [2] and [r["id"] for r in quality.changed_ids(a, b, "id", "v").collect()] == [2]
    assert {(r["id"], r["v"]) for r in quality.filled(a, b, "id", ["v"]).collect()} == {(1, 5), (2, 7)}


def test_job_states():
    job = jobs.created(jobs.Job(1, region={"sido": "경남", "sigungu": ["김해시"]}))
    assert job.region["sigungu_by_sido"] == {"경상남도": ["김해시"]} and jobs.Job.from_json(job.to_json()) == job
    with pytest.raises(jobs.NotAllowed):
        jobs.financials_started(job)
    done = jobs.replace(job, status="DONE")
    assert jobs.financials_started(done).phase == "FINANCIALS"
    with pytest.raises(jobs.NotAllowed):
        jobs.cancelled(done)


def test_phase_one_and_flags(spark):
    index = spark.createDataFrame([("1", "가", None, "경상남도", "김해시", "10121", "9"), ("2", "나", "코스닥시장", "경상남도", "김해시", "10", None), ("3", "다", "기타법인", "부산광역시", "중구", "29", "")], "corp_code string, corp_name string, corp_cls string, sido string, sigungu string, induty_code string, jurir_no string")
    stats = spark.createDataFrame([("9", "2023", 1, 2), ("9", "2024", 3, 4), ("", "2024", 7, 7)], "crno string, biz_year string, revenue long, total_assets long")
    job = jobs.Job(5, region={"sido": ["경남", "부산"]}, industry=("C",))
    got = jobs.phase_one(index, stats, spark.createDataFrame([], "corp_code string"), job, {"C": ["10", "29"]})
    assert {(r["corp_code"], r["ref_revenue"], r["job_id"]) for r in got.collect()} == {("1", 3, 5), ("3", None, 5)}
    res = spark.createDataFrame([(1, "20240101000001", 5, None, 0, 0)], "id long, rcept_no string, revenue_cur long, total_assets_cur long, excluded_by_revenue int, excluded_by_assets int")
    row = jobs.flagged(res, jobs.replace(job, revenue={"min_krw": 10}, assets={"min_krw": 10}), date(2024, 6, 1)).first()
    assert (row["excluded_by_revenue"], row["excluded_by_assets"], row["excluded_by_stale_disclosure"]) == (1, 0, 0)
