"""Queries over filings: documents are written as markup from driver rows, parsed, and compared with the rows they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..operators import peers, results
from ..sources import auditors, filings
from .queries import SNAPSHOTS, _table, query, snapshots

_NAMES = ["삼일", "안경", "한영", "대주"]


def _customers(spark, sf_dir) -> DataFrame:
    """The customers spread over all tasks: each becomes a document, and a small file of them would be one task's."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def _shown(amount: Column) -> Column:
    """An amount as statements print it: grouped digits, parentheses for a minus."""
    digits = F.regexp_replace(F.format_number(F.abs(amount).cast("decimal(20,0)"), 0), r"\.0$", "")
    return F.when(amount < 0, F.concat(F.lit("("), digits, F.lit(")"))).otherwise(digits)


def _row(label, cur: Column, prv: Column, level: int | None = None, right: bool = True) -> Column:
    """A statement's row; each period has two columns, the amount in one of them."""
    tag = f'<TE ALEVEL="{level}">' if level is not None else "<TE>"
    name = F.lit(label) if isinstance(label, str) else label
    cells = [F.lit("<TE></TE><TE>"), _shown(cur), F.lit("</TE><TE></TE><TE>"), _shown(prv), F.lit("</TE>")]
    if not right:
        cells = [F.lit("<TE>"), _shown(cur), F.lit("</TE><TE></TE><TE>"), _shown(prv), F.lit("</TE><TE></TE>")]
    return F.concat(F.lit(f"<TR>{tag}"), name, F.lit("</TE>"), *cells, F.lit("</TR>"))


def _statements(spark, sf_dir) -> DataFrame:
    """(rcept_no, content): marked statements of odd customers, attached ones of even customers."""
    c = _customers(spark, sf_dir)
    k, loss = F.col("c_custkey"), F.col("c_acctbal") < 0
    worth = F.col("c_nationkey") * 11 + 1
    label = F.when(loss, "영업손실").otherwise("영업이익")
    head = '<THEAD><TR><TH>과목</TH><TH COLSPAN="2">당기</TH><TH COLSPAN="2">전기</TH></TR></THEAD>'
    marked = F.concat(
        F.lit(f'<DOC><TITLE>재 무 상 태 표</TITLE><TABLE ACLASS="FINANCE">{head}<TBODY>'),
        _row("Ⅰ. 유동자산", k * 700, k * 600, 0), _row("1.현금및현금성자산", k * 10, k * 9, 1, right=False), _row("(-)정부보조금", -k * 3, -k * 2, 1, right=False),
        _row("매출채권", k * 20, k * 21, 1, right=False), _row("자산총계", k * 1000 + 7, k * 900 + 3, 0),
        F.lit('</TBODY></TABLE><TITLE>손익계산서</TITLE><TABLE ACLASS="FINANCE"><TBODY>'),
        _row("Ⅰ.매출액<주석3>", k * 500, k * 400), _row(F.concat(F.lit("Ⅴ. "), label), worth, worth + 1),
        F.lit('</TBODY></TABLE><TITLE>주석</TITLE><TABLE ACLASS="FINANCE"><TBODY><TR><TE>매출원가</TE><TE>9</TE></TR></TBODY></TABLE></DOC>'),
    )
    plain = lambda name, cur, prv: F.concat(F.lit("<TR><TD>"), F.lit(name) if isinstance(name, str) else name, F.lit("</TD><TD>5</TD><TD>"), _shown(cur), F.lit("</TD><TD>"), _shown(prv), F.lit("</TD></TR>"))
    signed = F.when(loss, -worth).otherwise(worth)
    attached = F.concat(
        F.lit("<DOC><TITLE>(첨부)재 무 제 표</TITLE><P>재 무 상 태 표</P><TABLE><THEAD><TR><TH>과 목</TH><TH>주석</TH><TH>제 6(당) 기</TH><TH>제 5(전) 기</TH></TR></THEAD><TBODY>"),
        plain("유동자산합계", k * 700, k * 600), plain("자산총계", k * 1000 + 7, k * 900 + 3),
        F.lit("</TBODY></TABLE><P>손 익 계 산 서</P><TABLE><TBODY><TR><TD>과목</TD><TD>주석</TD><TD>제5기(전)</TD><TD>제6기(당)</TD></TR>"),
        plain("매출", k * 400, k * 500), plain("매출원가", -k * 200, -k * 300), plain(label, signed + 1, signed),
        F.lit("</TBODY></TABLE></DOC>"),
    )
    text = F.when(k % 2 == 1, marked).otherwise(attached)
    return c.select(k.cast("string").alias("rcept_no"), text.alias("text")).select("rcept_no", F.encode("text", "UTF-8").alias("content"))


_C = "c AS (SELECT c_custkey AS k, c_nationkey * 11 + 1 AS w, c_acctbal < 0 AS loss FROM customer)"


@query(f"""WITH {_C}, v AS (
  SELECT k, 'current_assets' AS item, k * 700 AS cur, k * 600 AS prv FROM c UNION ALL SELECT k, 'total_assets', k * 1000 + 7, k * 900 + 3 FROM c
  UNION ALL SELECT k, 'cash_and_equivalents', k * 7, k * 7 FROM c WHERE k % 2 = 1 UNION ALL SELECT k, 'trade_receivables', k * 20, k * 21 FROM c WHERE k % 2 = 1
  UNION ALL SELECT k, 'revenue', k * 500, k * 400 FROM c UNION ALL SELECT k, 'cogs', k * 300, k * 200 FROM c WHERE k % 2 = 0
  UNION ALL SELECT k, 'operating_income', CASE WHEN loss THEN -w ELSE w END, CASE WHEN k % 2 = 0 THEN CASE WHEN loss THEN 1 - w ELSE w + 1 END WHEN loss THEN -w - 1 ELSE w + 1 END FROM c)
SELECT CAST(k AS VARCHAR) AS rcept_no, item, CAST(cur AS BIGINT) AS cur, CAST(prv AS BIGINT) AS prv FROM v""")
def filing_items(spark, sf_dir):
    """Items of both periods from marked and attached statements: periods by header, contra rows netted, signs by label."""
    return filings.statement_items(filings.document_rows(_statements(spark, sf_dir)))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS rcept_no, 'current_assets' AS item, CAST(u.p AS BIGINT) AS position, u.label, CAST(1 AS BIGINT) AS level, CAST(c_custkey * u.f AS BIGINT) AS cur
FROM customer, (VALUES (0, '1.현금및현금성자산', 10), (1, '(-)정부보조금', -3), (2, '매출채권', 20)) u(p, label, f) WHERE c_custkey % 2 = 1""")
def filing_account_details(spark, sf_dir):
    """Accounts below a summary row, with their levels and positions."""
    rows = filings.account_details(filings.document_rows(_statements(spark, sf_dir)))
    return rows.select("rcept_no", "item", F.col("position").cast("bigint").alias("position"), "label", F.col("level").cast("bigint").alias("level"), "cur")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS rcept_no, count(*) AS n_sections, sum(n) AS n_rows FROM customer, (VALUES (0, 3), (0, 4), (1, 6), (1, 2)) u(odd, n) WHERE c_custkey % 2 = odd GROUP BY 1""")
def filing_sections(spark, sf_dir):
    """The tables of each statement as plain markup; sections and rows are counted."""
    html = filings.section_html(filings.document_rows(_statements(spark, sf_dir)))
    lines = F.size(F.split("html", "<tr>")) - 1
    return html.groupBy("rcept_no").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(lines).cast("bigint").alias("n_rows"))


_STANDARD = [
    ("bs", "유동자산"), ("bs", "비유동자산"), ("bs", "자산총계"), ("bs", "유동부채"), ("bs", "비유동부채"), ("bs", "부채총계"), ("bs", "자본총계"),
    ("is", "매출액"), ("is", "매출원가"), ("is", "매출총이익"), ("is", "판매비와관리비"), ("is", "영업이익"), ("is", "당기순이익"),
]


@query(f"""SELECT CAST(s_suppkey AS VARCHAR) AS rcept_no, CASE WHEN s_suppkey % 14 = 13 THEN 'OK' ELSE 'PARTIAL' END AS parse_status,
  CASE WHEN s_suppkey % 14 < 13 THEN list_extract([{', '.join(f"'{i}'" for i in ('current_assets', 'noncurrent_assets', 'total_assets', 'current_liab', 'noncurrent_liab', 'total_liab', 'total_equity', 'revenue', 'cogs', 'gross_profit', 'sga', 'operating_income', 'net_income'))}], CAST(s_suppkey % 14 + 1 AS INTEGER)) END AS missing FROM supplier""")
def filing_parse_status(spark, sf_dir):
    """Filings that lack one item each, or none."""
    s = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    table = lambda name: F.concat_ws("", *[F.when(k % 14 != i, _row(label, k + i, k - i)) for i, (section, label) in enumerate(_STANDARD) if section == name])
    text = F.concat(F.lit('<DOC><TITLE>재무상태표</TITLE><TABLE ACLASS="FINANCE"><TBODY>'), table("bs"), F.lit('</TBODY></TABLE><TITLE>손익계산서</TITLE><TABLE ACLASS="FINANCE"><TBODY>'), table("is"), F.lit("</TBODY></TABLE></DOC>"))
    parsed = filings.parsed_filings(s.select(k.cast("string").alias("rcept_no"), F.encode(text, "UTF-8").alias("content")))
    return parsed.select("rcept_no", "parse_status", F.nullif(F.array_join("missing_cur", ","), F.lit("")).alias("missing"))


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS rcept_no, CASE c_custkey % 4 WHEN 0 THEN n || '회계법인' WHEN 1 THEN '회계법인 ' || n WHEN 2 THEN n || '감사반' END AS auditor_name,
  CASE WHEN c_custkey % 4 = 0 THEN '서울특별시 중구 세종대로 ' || c_custkey WHEN c_custkey % 4 = 2 THEN '경상남도 김해시 ' || c_custkey END AS auditor_address
FROM (SELECT c_custkey, list_extract([{', '.join(f"'{n}'" for n in _NAMES)}], CAST(c_nationkey % 4 + 1 AS INTEGER)) AS n FROM customer)""")
def filing_auditors(spark, sf_dir):
    """Auditors' names and addresses from the lines of a report; spaced and signed names, names without an address, none at all."""
    c = _table(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.get(F.array(*map(F.lit, _NAMES)), (F.col("c_nationkey") % 4).cast("int"))
    line = lambda *x: F.concat(F.lit("<P>"), *[F.lit(v) if isinstance(v, str) else v for v in x], F.lit("</P>"))
    text = (
        F.when(k % 4 == 0, F.concat(line("안경회계법인"), line("서울시 중구 세종대로 ", k.cast("string")), line(name, " 회 계 법 인"), line("대표이사 아무개")))
        .when(k % 4 == 1, line("회계법인 ", name, " 대표이사 이 만 호"))
        .when(k % 4 == 2, F.concat(line("경남 김해시 ", k.cast("string")), line(name, "감사반")))
        .otherwise(line("외부감사 담당 회계법인"))
    )
    return auditors.auditors(c.select(k.cast("string").alias("rcept_no"), F.encode(F.concat(F.lit("<DOC>"), text, F.lit("</DOC>")), "UTF-8").alias("content")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS fiscal_date FROM orders""")
def fiscal_dates(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    raw = F.concat(F.lit('<COMPANY AUNIT="PERIODTO" AUNITVALUE="'), F.date_format("o_orderdate", "yyyyMMdd"), F.lit('">'))
    return o.select("o_orderkey", A.fiscal_date(F.when(F.col("o_orderkey") % 5 != 0, raw).otherwise("<COMPANY>")).alias("fiscal_date"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber % 3 WHEN 0 THEN l_orderkey WHEN 1 THEN -l_suppkey ELSE NULL END AS BIGINT) AS amount FROM lineitem""")
def first_amounts(spark, sf_dir):
    """The first of a period's cells that holds an amount."""
    li = _table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber") % 3
    one, two = F.when(n == 0, _shown(F.col("l_orderkey"))).otherwise(" "), F.when(n != 2, _shown(-F.col("l_suppkey"))).otherwise("주석")
    return li.select("l_orderkey", "l_linenumber", A.first_amount(one, two).alias("amount"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN trunc(o_totalprice) WHEN 1 THEN o_custkey WHEN 2 THEN NULL ELSE NULL END AS BIGINT) AS n FROM orders""")
def whole_numbers(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.col("o_totalprice").cast("decimal(20,2)").cast("string")).when(k == 1, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))).when(k == 2, "").otherwise("12a")
    return o.select("o_orderkey", A.whole_number(raw).alias("n"))


@query(f"""WITH {SNAPSHOTS}, s AS (SELECT *, CASE WHEN result_id % 7 = 0 THEN 'FAILED' ELSE parse_status END AS ps FROM snapshots),
 f AS (SELECT *, upper(coalesce(ps, '')) = 'FAILED' AS bad, {' OR '.join(f"{k} IS NULL{' OR ' + k + ' <= 0' if k in A.POSITIVE_INPUTS else ''}{' OR ' + k + ' = 0' if k in A.NONZERO_INPUTS else ''}" for k in A.RATIO_INPUTS)} AS gap FROM s),
 g AS (SELECT result_id, count(*) FILTER (WHERE NOT bad AND NOT gap) AS usable, max(CAST(bad AS INT)) AS failed, max(CAST(NOT bad AND gap AS INT)) AS incomplete, max(CAST(ps = 'PARTIAL' AS INT)) AS partial,
   max(CAST(from_current_period = 0 AS INT)) AS borrowed, max(CAST(total_equity < 0 AS INT)) AS negative_equity FROM f GROUP BY 1)
SELECT result_id, CASE WHEN usable = 0 THEN 'nothing_usable' ELSE array_to_string([x FOR x IN [CASE WHEN failed = 1 THEN 'failed' END, CASE WHEN incomplete = 1 THEN 'incomplete' END, CASE WHEN partial = 1 THEN 'partial' END,
  CASE WHEN borrowed = 1 THEN 'borrowed' END, CASE WHEN negative_equity = 1 THEN 'negative_equity' END] IF x IS NOT NULL], ',') END AS warnings FROM g""")
def report_warnings(spark, sf_dir):
    s = snapshots(spark, sf_dir).withColumn("parse_status", F.when(F.col("result_id") % 7 == 0, "FAILED").otherwise(F.col("parse_status")))
    return peers.warnings(s).select("result_id", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS value, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def value_histogram_uncapped(spark, sf_dir):
    """All values, where there are more than a page shows."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("value"))
    return results.value_histogram(rows, "value", limit=None)


def _tree_row(label: str, cur: Column, prv: Column | None = None) -> Column:
    prv = cur if prv is None else prv
    return F.concat(F.lit(f"<TR><TD>{label}</TD><TD>"), F.coalesce(_shown(cur), F.lit("")), F.lit("</TD><TD>"), F.coalesce(_shown(prv), F.lit("")), F.lit("</TD></TR>"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS rcept_no, item, CAST(p AS BIGINT) AS position, label, CAST(level AS BIGINT) AS level, CAST(c_custkey * f AS BIGINT) AS cur, CAST(c_custkey * f + g AS BIGINT) AS prv
FROM customer, (VALUES ('cf_operating', 0, '1.당기순이익', 1, 1, 1, 0), ('cf_operating', 1, '가.감가상각비', 1, 2, 1, 0), ('cf_operating', 2, '무형자산상각', 1, 3, 0, 1), ('cf_operating', 3, '(2)기타', 1, 4, 0, 1),
  ('cf_investing', 0, '1.유형자산의 처분', 1, 7, 1, 0), ('cf_investing', 1, '토지의 취득', 1, -8, 1, 0), ('cf_financing', 0, '1. 현금유입액', 1, 11, 1, 0), ('cf_financing', 1, '유상증자', 2, 12, 1, 0),
  ('current_assets', 0, '1.당좌자산', 1, 21, 1, 0), ('current_assets', 1, '현금및현금성자산', 3, 22, 1, 0), ('current_assets', 2, '2.재고자산', 2, 23, 1, 0), ('total_assets', 0, '덧붙임', 2, 25, 1, 0)) u(item, p, label, level, f, always, whole), (SELECT 1 AS g)
WHERE always = 1 OR c_custkey % 5 <> 0""")
def attached_account_trees(spark, sf_dir):
    """Accounts of attached statements: levels by indent inside groups, groups by numbering where nothing is indented, rows that go on, parts that end."""
    c = _customers(spark, sf_dir)
    k = F.col("c_custkey")
    head = "<THEAD><TR><TH>과 목</TH><TH>제 6(당) 기</TH><TH>제 5(전) 기</TH></TR></THEAD><TBODY>"
    row = lambda label, f: _tree_row(label, k * f, k * f + 1)
    none = F.lit(None).cast("bigint")
    text = F.concat(
        F.lit(f"<DOC><TITLE>(첨부)재 무 제 표</TITLE><P>재 무 상 태 표</P><TABLE>{head}"),
        _tree_row("자 산", none), row("Ⅰ.유동자산", 20), row("  1.당좌자산", 21), row("　　  현금및현금성자산", 22), row("   2.재고자산", 23), row("  자산총계", 24), row("   덧붙임", 25),
        F.lit(f"</TBODY></TABLE><P>현 금 흐 름 표</P><TABLE>{head}"),
        row("Ⅰ.영업활동으로 인한 현금흐름", 9), row("1.당기순이익", 1), row("가.감가상각비", 2),
        F.when(k % 5 == 0, _tree_row("무형자산상각", none)).otherwise(row("무형자산상각", 3)), row("(2)기타", 4), _tree_row("자산", none), row("3.뒤의 행", 5),
        row("Ⅱ.투자활동으로 인한 현금흐름", 6), row("1.유형자산의 처분", 7), row("토지의 취득", -8), row("Ⅳ.현금의 증감", 9), row("2.그 밖", 10),
        row("Ⅲ.재무활동으로 인한 현금흐름", 10), row("1. 현금유입액", 11), row(" 유상증자", 12),
        F.lit("</TBODY></TABLE></DOC>"),
    )
    rows = filings.account_details(filings.document_rows(c.select(k.cast("string").alias("rcept_no"), F.encode(text, "UTF-8").alias("content"))))
    return rows.select("rcept_no", "item", F.col("position").cast("bigint").alias("position"), "label", F.col("level").cast("bigint").alias("level"), "cur", "prv")


def _section_documents(spark, sf_dir) -> DataFrame:
    """Odd customers: titled sections with spans, escapes and tags that aren't known; even ones: attached statements."""
    c = _customers(spark, sf_dir)
    k = F.col("c_custkey").cast("string")
    titled = F.concat(
        F.lit('<DOC><SECTION-1 ID="a"><TITLE ATOC="Y">재 무 상 태 표</TITLE><P USERMARK="B">단위: <SPAN onclick="x()">원</SPAN> &amp; &lt;천원&gt;</P><SCRIPT>no "run"</SCRIPT><TABLE-GROUP><TABLE WIDTH="600"><THEAD><TR><TH ROWSPAN="2">과목</TH><TU COLSPAN="2">금액</TU></TR><TR><TH>당</TH><TH>전</TH></TR></THEAD><TBODY><TR><TD COLSPAN="1">'),
        F.col("c_name"), F.lit('</TD><TE ROWSPAN="3" COLSPAN="x">'), k, F.lit("</TE><TD>A<B>굵게</B></TD></TR><TR><TD/></TR></TBODY></TABLE></TABLE-GROUP><P> </P></SECTION-1><SECTION-1><TITLE>주석</TITLE><P>"), k,
        F.lit("</P><SECTION-2><TITLE>1. 회사's</TITLE><P>끝</P></SECTION-2></SECTION-1><P>밖</P></DOC>"),
    )
    attached = F.concat(
        F.lit("<DOC><TITLE>(첨부)재 무 제 표</TITLE><P>표지</P><P>재 무 상 태 표</P><TABLE><TR><TD>기간</TD></TR></TABLE><TABLE><TR><TD>자산</TD><TD>"), k,
        F.lit("</TD></TR></TABLE><TABLE><TR><TD>손 익 계 산 서</TD></TR><TR><TD>제5기</TD></TR></TABLE><TABLE><TR><TD>매출</TD></TR></TABLE><TITLE>감사보고서</TITLE><P>뒤</P></DOC>"),
    )
    text = F.when(F.col("c_custkey") % 2 == 1, titled).otherwise(attached)
    return c.select(k.alias("rcept_no"), F.encode(text, "UTF-8").alias("content"))


_H4 = "<h4 class=\"doc-section-title\">"


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS rcept_no, 'bs' AS section, CASE WHEN c_custkey % 2 = 1 THEN '{_H4}재 무 상 태 표</h4><p>단위: 원 &amp; &lt;천원&gt;</p><table><tr><th rowspan="2">과목</th><th colspan="2">금액</th></tr><tr><th>당</th><th>전</th></tr><tr><td>' || c_name || '</td><td rowspan="3">' || c_custkey || '</td><td>A굵게</td></tr><tr><td></td></tr></table>'
  ELSE '{_H4}재 무 상 태 표</h4><table><tr><td>기간</td></tr></table><table><tr><td>자산</td><td>' || c_custkey || '</td></tr></table>' END AS html FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'notes', '{_H4}주석</h4><p>' || c_custkey || '</p>{_H4}1. 회사&#x27;s</h4><p>끝</p>' FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'is', '{_H4}손 익 계 산 서</h4><table><tr><td>매출</td></tr></table>' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'audit', '{_H4}(첨부)재 무 제 표</h4><p>표지</p><p>재 무 상 태 표</p><table><tr><td>기간</td></tr></table><table><tr><td>자산</td><td>' || c_custkey || '</td></tr></table><table><tr><td>손 익 계 산 서</td></tr><tr><td>제5기</td></tr></table><table><tr><td>매출</td></tr></table>{_H4}감사보고서</h4><p>뒤</p>' FROM customer WHERE c_custkey % 2 = 0""")
def section_markup(spark, sf_dir):
    """The sections' markup itself: what a title's parent holds or an attached caption opens, put together from known tags only."""
    return filings.rendered_sections(filings.document_rows(_section_documents(spark, sf_dir)))


@query("""WITH g AS (SELECT * FROM (VALUES (0, 0, '과목'), (0, 1, '금액'), (0, 2, '금액'), (1, 0, '과목'), (1, 1, '당'), (1, 2, '전'), (2, 0, 'n'), (2, 1, 'k'), (2, 2, 'A굵게'), (3, 0, ''), (3, 1, 'k')) v(line, col, t))
SELECT CAST(c_custkey AS VARCHAR) AS rcept_no, line, col, CASE t WHEN 'n' THEN c_name WHEN 'k' THEN CAST(c_custkey AS VARCHAR) ELSE t END AS text FROM customer, g WHERE c_custkey % 2 = 1""")
def spanned_cells(spark, sf_dir):
    """Cells of a table with column and row spans, spread over the lines and columns that they cover."""
    grid = filings.table_grid(filings.document_rows(_section_documents(spark, sf_dir))).where(F.col("rcept_no").cast("bigint") % 2 == 1)
    return grid.select("rcept_no", F.col("line").cast("int").alias("line"), "col", "text")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS rcept_no, CASE c_custkey % 4 WHEN 0 THEN '<?xml version="1.0" encoding="utf-8"?><DOC>회사 ' || c_name || '</DOC>' WHEN 1 THEN '<DOC>회사 ' || c_name || '</DOC>'
  WHEN 2 THEN '<DOC>' || c_name || chr(65533) || chr(65533) || '</DOC>' END AS text FROM customer""")
def repaired_encodings(spark, sf_dir):
    """Filings in UTF-8, in code page 949 under an untrue declaration, in neither, and without a content."""
    c = _table(spark, sf_dir, "customer")
    k, name = F.col("c_custkey") % 4, F.encode("c_name", "UTF-8")
    raw = lambda b: F.unhex(F.lit(b.hex()))
    said, word = b'<?xml version="1.0" encoding="utf-8"?><DOC>', "회사 "
    content = (
        F.when(k == 0, F.concat(raw(said), raw(word.encode()), name, raw(b"</DOC>"))).when(k == 1, F.concat(raw(said), raw(word.encode("cp949")), name, raw(b"</DOC>")))
        .when(k == 2, F.concat(raw(said), name, raw(b"\xff\xff</DOC>")))
    )
    return filings.repaired_documents(c.select(F.col("c_custkey").cast("string").alias("rcept_no"), content.alias("content")))


@query("""SELECT c_custkey AS result_id, CAST(CASE WHEN c_custkey % 7 IN (0, 1, 2, 3, 4) OR c_custkey % 2 = 0 THEN 0 ELSE 3 END AS BIGINT) AS n_details,
  CASE c_custkey % 7 WHEN 0 THEN 'no_filing' WHEN 1 THEN 'no_document' WHEN 2 THEN 'pdf_only' WHEN 3 THEN 'not_read' WHEN 4 THEN 'no_details' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'no_details' END END AS reason FROM customer""")
def detail_reasons(spark, sf_dir):
    """Accounts of results' filings, or why there are none: no filing, no document, a PDF only, nothing to cut, no accounts."""
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    results_ = c.select(k.alias("id"), F.when(k % 7 != 0, k.cast("string")).alias("rcept_no"))
    at = F.col("rcept_no").cast("bigint") % 7
    text = F.when(at == 3, F.encode(F.lit("no markup"), "UTF-8")).when(at == 4, F.encode(F.lit("<DOC><P>text</P></DOC>"), "UTF-8")).otherwise(F.col("content"))
    documents = _statements(spark, sf_dir).select("rcept_no", F.when(at == 2, "PDF").otherwise("XML").alias("kind"), text.alias("content")).where(at != 1)
    return filings.details_with_reasons(results_, documents)


@query("""WITH c AS (SELECT o_custkey AS target_id, o_orderkey % 23 AS result_id, o_orderstatus <> 'F' AS partial, o_orderkey AS rank, 'N' || (o_orderkey % 23) || '(' || year(o_orderdate) || '년)' AS label FROM orders),
 f AS (SELECT target_id, result_id, min(rank) AS rank, arg_min(label, rank) AS label FROM c WHERE partial GROUP BY 1, 2),
 p AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY rank) AS place, count(*) OVER (PARTITION BY target_id) AS n FROM f)
SELECT target_id, any_value(n) AS n, string_agg(label, ', ' ORDER BY place) FILTER (WHERE place <= 3) || CASE WHEN any_value(n) > 3 THEN ' 외 ' || (any_value(n) - 3) || '곳' ELSE '' END AS text FROM p GROUP BY 1""")
def comparison_warnings(spark, sf_dir):
    """Partly read companies in each comparison: how many, and the first three by name."""
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 23
    chosen = o.select(F.col("o_custkey").alias("target_id"), k.alias("result_id"), F.concat(F.lit("N"), k.cast("string")).alias("name"), F.year("o_orderdate").cast("string").alias("year"), (F.col("o_orderstatus") != "F").alias("partial"), F.col("o_orderkey").alias("rank"))
    return peers.comparison_warnings(chosen).select("target_id", "n", "text")


@query("SELECT c_custkey, c_custkey % 4 <> 0 AS placeholder FROM customer")
def placeholder_contacts(spark, sf_dir):
    """Contacts that are missing, blank or still the text that asks for one."""
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    contact = F.when(k == 0, F.concat(F.lit("T. "), "c_name")).when(k == 1, F.lit(" 　")).when(k == 2, F.concat(F.lit(" 연락처 미입력 — "), "c_name"))
    return c.select("c_custkey", peers.is_placeholder(contact).alias("placeholder"))
