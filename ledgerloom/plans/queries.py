"""Queries over the driver tables, one or more per operator, each with its SQL.

The driver tables stand in for the real ones: customers are companies (region = province,
nation = district), orders by year are yearly figures and filings, lines are items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import fixed
from ..functions import text as T
from ..operators import bands, history, latest, matching, peers, predicates, quality, reshape, results
from ..operators.ordering import materialised
from . import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- stand-ins ------------------------------------------------------------------------

MARKETS = {"AUTOMOBILE": "코스닥시장", "BUILDING": "유가증권시장", "MACHINERY": "기타법인", "HOUSEHOLD": "기타법인"}
ITEMS = ["revenue", "gross_profit", "operating_income", "net_income", "total_assets", "current_assets", "current_liab", "noncurrent_liab", "total_liab", "total_equity", "cogs"]

COMPANIES = """companies AS (
  SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS corp_code, c_name AS corp_name, r_name AS sido, n_name AS sigungu,
         CAST((c_custkey * 7) % 900 + 100 AS VARCHAR) AS induty_code,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '코스닥시장' WHEN 'BUILDING' THEN '유가증권시장' WHEN 'MACHINERY' THEN '기타법인' WHEN 'HOUSEHOLD' THEN '기타법인' END AS corp_cls,
         c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS jurir_no
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

STATS = """stats AS (
  SELECT CAST(o_custkey AS VARCHAR) AS crno, CAST(year(o_orderdate) AS VARCHAR) AS biz_year,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS revenue, CAST(max(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_assets
  FROM orders GROUP BY 1, 2)"""

LATEST = f"""{STATS}, latest AS (
  SELECT crno, biz_year, revenue, total_assets FROM (SELECT *, row_number() OVER (PARTITION BY crno ORDER BY biz_year DESC) AS n FROM stats) WHERE n = 1)"""

# results: amounts of one year only, so that many are null
RESULTS = f"""{COMPANIES}, {STATS}, priority AS (
  SELECT o_custkey AS id, max_by(o_orderpriority, o_orderkey) AS auditor_name, max(o_orderkey) AS k FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1),
results AS (
  SELECT c.id, c.id % 3 AS job_id, c.corp_name, c.sido || ' ' || c.sigungu AS address, CASE WHEN c.id % 5 = 0 THEN NULL WHEN c.id % 7 = 0 THEN '' ELSE c.segment END AS induty_name,
         c.segment AS ceo_name, c.induty_code, p.auditor_name, CASE WHEN c.id % 11 = 0 THEN '의견거절' WHEN c.id % 13 = 0 THEN '' WHEN c.id % 4 = 0 THEN NULL ELSE '적정' END AS audit_opinion,
         s.revenue AS revenue_cur, s.total_assets AS total_assets_cur,
         CASE WHEN p.k IS NOT NULL THEN CAST(19980000000000 + p.k AS VARCHAR) END AS rcept_no,
         CASE c.id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'FAILED' END AS parse_status,
         CASE c.id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS auditor_changed, CAST(c.id % 2 AS INTEGER) AS excluded_by_revenue,
         CASE WHEN c.id % 6 = 0 THEN 1 END AS excluded_by_assets, CASE WHEN c.id % 9 = 0 THEN 1 ELSE 0 END AS excluded_by_stale_disclosure
  FROM companies c LEFT JOIN priority p ON p.id = c.id LEFT JOIN stats s ON s.crno = c.jurir_no AND s.biz_year = '1998')"""

SNAPSHOTS = """snapshots AS (
  SELECT o_custkey AS result_id, CAST(year(o_orderdate) AS VARCHAR) AS fiscal_year, max(CAST(19980000000000 + o_orderkey AS VARCHAR)) AS rcept_no,
         CAST(sum(l_extendedprice_c) AS BIGINT) AS revenue, CAST(sum(l_extendedprice_c - l_cost_c) AS BIGINT) AS gross_profit, CAST(sum(l_cost_c) AS BIGINT) AS cogs,
         CAST(sum(l_disc_c) AS BIGINT) AS operating_income, CAST(sum(l_tax_c) AS BIGINT) AS net_income, CAST(sum(l_extendedprice_c + l_tax_c) AS BIGINT) AS total_assets,
         CAST(sum(l_disc_c) AS BIGINT) AS current_assets, CAST(sum(l_tax_c) AS BIGINT) AS current_liab, CAST(sum(l_disc_c) - sum(l_tax_c) AS BIGINT) AS noncurrent_liab,
         CAST(sum(l_disc_c) AS BIGINT) AS total_liab, CAST(sum(l_extendedprice_c + l_tax_c - l_disc_c) AS BIGINT) AS total_equity,
         max_by(o_orderpriority, o_orderkey) AS auditor_name, CASE o_custkey % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PARTIAL' ELSE 'OK' END AS parse_status,
         CAST(year(o_orderdate) % 2 AS INTEGER) AS from_current_period
  FROM orders JOIN (SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS l_extendedprice_c, CAST(round(l_extendedprice * 60) AS BIGINT) AS l_cost_c,
                           CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS l_disc_c, CAST(round(l_extendedprice * l_tax * 100) AS BIGINT) AS l_tax_c FROM lineitem) ON l_orderkey = o_orderkey
  GROUP BY o_custkey, year(o_orderdate))"""


def companies(spark, sf_dir) -> DataFrame:
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("corp_code"), F.col("c_name").alias("corp_name"), F.col("r_name").alias("sido"), F.col("n_name").alias("sigungu"),
        (F.col("c_custkey") * 7 % 900 + 100).cast("string").alias("induty_code"), T.looked_up(MARKETS, F.col("c_mktsegment")).alias("corp_cls"),
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").cast("string").alias("jurir_no"),
    )




def stats(spark, sf_dir) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    price = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.groupBy(F.col("o_custkey").cast("string").alias("crno"), F.year("o_orderdate").cast("string").alias("biz_year")).agg(F.sum(price).alias("revenue"), F.max(price).alias("total_assets"))


def result_rows(spark, sf_dir) -> DataFrame:
    c = companies(spark, sf_dir)
    o = _table(spark, sf_dir, "orders").where(F.year("o_orderdate") >= 1998)
    p = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("auditor_name"), F.max("o_orderkey").alias("k"))
    s = stats(spark, sf_dir).where("biz_year = '1998'").select(F.col("crno").alias("jurir_no"), F.col("revenue").alias("revenue_cur"), F.col("total_assets").alias("total_assets_cur"))
    rows = c.join(p, "id", "left").join(s, "jurir_no", "left")
    i = F.col("id")
    return rows.select(
        "id", (i % 3).alias("job_id"), "corp_name", F.concat_ws(" ", "sido", "sigungu").alias("address"),
        F.when(i % 5 == 0, None).when(i % 7 == 0, "").otherwise(F.col("segment")).alias("induty_name"), F.col("segment").alias("ceo_name"), "induty_code", "auditor_name",
        F.when(i % 11 == 0, "의견거절").when(i % 13 == 0, "").when(i % 4 == 0, None).otherwise("적정").alias("audit_opinion"), "revenue_cur", "total_assets_cur",
        (F.col("k") + 19980000000000).cast("string").alias("rcept_no"), F.when(i % 4 == 0, "OK").when(i % 4 == 1, "PARTIAL").when(i % 4 == 2, "FAILED").alias("parse_status"),
        F.when(i % 3 == 0, 1).when(i % 3 == 1, 0).alias("auditor_changed"), (i % 2).cast("int").alias("excluded_by_revenue"), F.when(i % 6 == 0, 1).alias("excluded_by_assets"),
        F.when(i % 9 == 0, 1).otherwise(0).alias("excluded_by_stale_disclosure"),
    )


def snapshots(spark, sf_dir) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    price = F.col("l_extendedprice")
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.round(price * 100).cast("bigint").alias("p"), F.round(price * 60).cast("bigint").alias("c"),
        F.round(price * F.col("l_discount") * 100).cast("bigint").alias("d"), F.round(price * F.col("l_tax") * 100).cast("bigint").alias("t"),
    )
    rows = o.join(li, o.o_orderkey == li.l_orderkey)
    s = {k: F.sum(k) for k in "pcdt"}
    sums = {
        "revenue": s["p"], "gross_profit": s["p"] - s["c"], "cogs": s["c"], "operating_income": s["d"], "net_income": s["t"], "total_assets": s["p"] + s["t"],
        "current_assets": s["d"], "current_liab": s["t"], "noncurrent_liab": s["d"] - s["t"], "total_liab": s["d"], "total_equity": s["p"] + s["t"] - s["d"],
    }
    out = rows.groupBy(F.col("o_custkey").alias("result_id"), F.year("o_orderdate").alias("y")).agg(
        F.max((F.col("o_orderkey") + 19980000000000).cast("string")).alias("rcept_no"), *[v.alias(k) for k, v in sums.items()], F.max_by("o_orderpriority", "o_orderkey").alias("auditor_name")
    )
    i = F.col("result_id")
    return out.select(
        "result_id", F.col("y").cast("string").alias("fiscal_year"), "rcept_no", *sums, "auditor_name",
        F.when(i % 5 == 0, "FAILED").when(i % 5 == 1, "PARTIAL").otherwise("OK").alias("parse_status"), (F.col("y") % 2).cast("int").alias("from_current_period"),
    )


# ---- candidates -----------------------------------------------------------------------

REGION = {"sido": ["ASIA", "EUROPE"], "sigungu_by_sido": {"EUROPE": ["NATION_3", "NATION_8"]}}
CANDIDATE = """coalesce(corp_cls, '') NOT IN ('유가증권시장', '코스닥시장', '코넥스시장')
  AND (sido = 'ASIA' OR (sido = 'EUROPE' AND sigungu IN ('NATION_3', 'NATION_8'))) AND (induty_code LIKE '1%' OR induty_code LIKE '25%' OR induty_code LIKE '3%')"""
JOB = jobs.Job(1, region=REGION, industry=("1", "25", "C"))
CHILDREN = {"C": ["3"]}


@query(f"""WITH {COMPANIES}, {LATEST}
SELECT id, corp_name, sido, sigungu, induty_code, revenue AS ref_revenue, total_assets AS ref_total_assets FROM companies LEFT JOIN latest ON crno = jurir_no WHERE {CANDIDATE}""")
def candidates_with_reference(spark, sf_dir):
    found = latest.with_latest_stat(jobs.candidates(companies(spark, sf_dir), JOB, CHILDREN), stats(spark, sf_dir), ["revenue", "total_assets"])
    return found.select("id", "corp_name", "sido", "sigungu", "induty_code", "ref_revenue", "ref_total_assets")


@query(f"WITH {COMPANIES} SELECT id, corp_name FROM companies WHERE {CANDIDATE}")
def candidate_filter(spark, sf_dir):
    return jobs.candidates(companies(spark, sf_dir), JOB, CHILDREN).select("id", "corp_name")


@query(f"WITH {COMPANIES} SELECT id, sido, sigungu FROM companies WHERE sido = 'ASIA' OR (sido = 'EUROPE' AND sigungu IN ('NATION_3', 'NATION_8'))")
def region_semi_join(spark, sf_dir):
    rows = companies(spark, sf_dir)
    return rows.where(predicates.in_region(F.col("sido"), F.col("sigungu"), REGION)).select("id", "sido", "sigungu")


@query(f"WITH {COMPANIES} SELECT id, induty_code FROM companies WHERE induty_code LIKE '1%' OR induty_code LIKE '25%' OR induty_code LIKE '3%'")
def industry_prefix_expand(spark, sf_dir):
    prefixes = predicates.industry_prefixes(["1", "25", "C", "unknown"], CHILDREN)
    return companies(spark, sf_dir).where(predicates.in_industry(F.col("induty_code"), prefixes)).select("id", "induty_code")


@query(f"WITH {COMPANIES} SELECT count(*) AS n_candidates, 40 AS per_day, CAST(ceil(count(*) / 40.0) AS BIGINT) AS days FROM companies WHERE {CANDIDATE}")
def preview_days(spark, sf_dir):
    return jobs.preview(jobs.candidates(companies(spark, sf_dir), JOB, CHILDREN), 200)


@query(f"WITH {COMPANIES} SELECT id FROM companies WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def existing_anti_join(spark, sf_dir):
    had = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("corp_code"))
    return latest.new_candidates(companies(spark, sf_dir).withColumn("position", F.col("id")), had).select("id")


@query(f"WITH {LATEST} SELECT * FROM latest")
def latest_per_key(spark, sf_dir):
    return latest.latest_stats(stats(spark, sf_dir)).select("crno", "biz_year", "revenue", "total_assets")


@query("SELECT o_custkey AS corp_code, max(CAST(19980000000000 + o_orderkey AS VARCHAR)) AS rcept_no FROM orders GROUP BY 1")
def latest_filings(spark, sf_dir):
    f = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("corp_code"), (F.col("o_orderkey") + 19980000000000).cast("string").alias("rcept_no"))
    return latest.latest_filings(f.withColumn("corp_code", F.col("corp_code").cast("string"))).select(F.col("corp_code").cast("bigint").alias("corp_code"), "rcept_no")


@query(f"WITH {STATS} SELECT count(*) AS n_rows, count(DISTINCT biz_year) AS n_years, min(biz_year) AS first_year, max(biz_year) AS last_year FROM stats")
def distinct_years(spark, sf_dir):
    d = latest.distinct_years(stats(spark, sf_dir))
    return d.select("n_rows", F.size("years").cast("bigint").alias("n_years"), F.get("years", F.lit(0)).alias("first_year"), F.array_max("years").alias("last_year"))


@query("""SELECT o_custkey, CAST(CAST(w AS DATE) AS VARCHAR) AS window_begin, CAST(CAST(least(CAST(w AS DATE) + 89, e) AS DATE) AS VARCHAR) AS window_end
FROM (SELECT o_custkey, b, e, unnest(generate_series(CAST(b AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 90 DAY)) AS w
      FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS b, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1))""")
def windows_90d(spark, sf_dir):
    p = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("begin"), F.max("o_orderdate").cast("date").alias("end"))
    return latest.filing_windows(p).select("o_custkey", *[F.col(c).cast("date").cast("string").alias(c) for c in ("window_begin", "window_end")])


# ---- result query ---------------------------------------------------------------------


@query(f"WITH {RESULTS} SELECT id, revenue_cur FROM results WHERE revenue_cur IS NULL OR (revenue_cur >= 10000000 AND revenue_cur <= 60000000)")
def range_null_pass(spark, sf_dir):
    return result_rows(spark, sf_dir).where(predicates.amount_between(F.col("revenue_cur"), 10_000_000, 60_000_000)).select("id", "revenue_cur")


@query(f"WITH {RESULTS} SELECT id FROM results WHERE lower(address) LIKE '%asia%' AND (induty_name IS NULL OR induty_name = '' OR lower(induty_name) NOT LIKE '%build%')")
def contains_not_contains(spark, sf_dir):
    return result_rows(spark, sf_dir).where(results.where(address_contains="asia", induty_name_not_contains="build")).select("id")


@query(f"WITH {RESULTS} SELECT id, induty_name FROM results WHERE induty_name IN ('MACHINERY') OR induty_name IS NULL OR induty_name = ''")
def value_in_blank(spark, sf_dir):
    return result_rows(spark, sf_dir).where(results.where(induty_name_in=["MACHINERY", predicates.BLANK])).select("id", "induty_name")


@query(f"WITH {RESULTS} SELECT id, induty_name FROM results WHERE (induty_name IS NULL OR induty_name = '' OR induty_name NOT IN ('MACHINERY')) AND induty_name IS NOT NULL AND induty_name <> ''")
def value_not_in_blank(spark, sf_dir):
    return result_rows(spark, sf_dir).where(results.where(induty_name_not_in=["MACHINERY", predicates.BLANK])).select("id", "induty_name")


@query(f"WITH {RESULTS} SELECT id FROM results WHERE corp_name ILIKE '%1_0%' OR address ILIKE '%1_0%' OR ceo_name ILIKE '%1_0%' OR induty_name ILIKE '%1_0%' OR auditor_name ILIKE '%1_0%'")
def keyword_search(spark, sf_dir):
    return result_rows(spark, sf_dir).where(results.where(q="1_0")).select("id")


@query(f"""WITH {RESULTS} SELECT CASE WHEN rcept_no IS NULL THEN 'NO_DISCLOSURE' WHEN parse_status = 'OK' THEN 'OK' WHEN parse_status = 'PARTIAL' THEN 'PARTIAL' ELSE 'FAILED_REVIEW' END AS status, count(*) AS n FROM results GROUP BY 1""")
def status_partition4(spark, sf_dir):
    return result_rows(spark, sf_dir).groupBy(predicates.status_of(F.col("rcept_no"), F.col("parse_status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RESULTS} SELECT CASE auditor_changed WHEN 1 THEN 'CHANGED' WHEN 0 THEN 'UNCHANGED' ELSE 'UNKNOWN' END AS change, count(*) AS n FROM results GROUP BY 1")
def auditor_partition3(spark, sf_dir):
    return result_rows(spark, sf_dir).groupBy(predicates.change_of(F.col("auditor_changed")).alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RESULTS} SELECT id FROM results WHERE excluded_by_revenue = 0 AND excluded_by_assets = 1 AND rcept_no IS NOT NULL")
def tri_state_flags(spark, sf_dir):
    return result_rows(spark, sf_dir).where(results.where(excluded_by_revenue=False, excluded_by_assets=True, has_disclosure=True)).select("id")


@query(f"WITH {RESULTS} SELECT id, induty_name, revenue_cur, row_number() OVER (ORDER BY revenue_cur DESC NULLS LAST, induty_name ASC NULLS LAST, id) AS place FROM results WHERE job_id = 1")
def multi_sort_nulls_last(spark, sf_dir):
    keys = results.sort_keys("revenue_cur:desc,unknown:asc,induty_name:asc,revenue_cur:asc", ["revenue_cur", "induty_name"])
    rows = result_rows(spark, sf_dir).where("job_id = 1")
    return results.with_place(rows.select("job_id", "id", "induty_name", "revenue_cur"), keys, ["job_id"]).drop("job_id")


@query(f"WITH {RESULTS} SELECT id, revenue_cur FROM results WHERE job_id = 1 ORDER BY revenue_cur DESC NULLS LAST, id LIMIT 20 OFFSET 20")
def page_offset_limit(spark, sf_dir):
    return results.listing(result_rows(spark, sf_dir), 1, [("revenue_cur", "desc")], number=2, size=20)[1].select("id", "revenue_cur")


@query(f"WITH {RESULTS} SELECT id FROM results WHERE job_id = 1 AND total_assets_cur >= 1000")
def id_only(spark, sf_dir):
    return results.listing(result_rows(spark, sf_dir).where("total_assets_cur is not null"), 1, ids_only=True, total_assets_cur_min=1000)[1]


@query(f"WITH {RESULTS} SELECT auditor_name AS value, count(*) AS n FROM results WHERE auditor_name IS NOT NULL AND auditor_name <> '' GROUP BY 1")
def value_histogram(spark, sf_dir):
    return results.value_histogram(result_rows(spark, sf_dir), "auditor_name")


@query(f"WITH {RESULTS} SELECT count(DISTINCT nullif(induty_name, '')) AS n_distinct, count(*) FILTER (WHERE induty_name IS NULL OR induty_name = '') AS n_blank, count(*) AS n_rows FROM results")
def value_totals(spark, sf_dir):
    return results.value_totals(result_rows(spark, sf_dir), "induty_name")


@query(f"""WITH {RESULTS}, {SNAPSHOTS}, chosen AS (SELECT * FROM results WHERE revenue_cur IS NOT NULL)
SELECT count(*) AS total, count(*) FILTER (WHERE excluded_by_stale_disclosure = 1) AS stale, count(*) FILTER (WHERE excluded_by_revenue = 1) AS out_of_revenue,
  count(*) FILTER (WHERE excluded_by_assets = 1) AS out_of_assets, count(*) FILTER (WHERE parse_status = 'FAILED' AND rcept_no IS NOT NULL) AS failed,
  count(*) FILTER (WHERE rcept_no IS NULL) AS no_disclosure, count(*) FILTER (WHERE id NOT IN (SELECT result_id FROM snapshots WHERE fiscal_year >= '2000')) AS no_history FROM chosen""")
def selection_summary(spark, sf_dir):
    rows = materialised(result_rows(spark, sf_dir))
    return results.selection_summary(rows, snapshots(spark, sf_dir).where("fiscal_year >= '2000'"), rows.where("revenue_cur is not null").select("id"))


@query(f"WITH {RESULTS}, {SNAPSHOTS} SELECT id FROM results WHERE EXISTS (SELECT 1 FROM snapshots s WHERE s.result_id = results.id AND s.fiscal_year >= '2000')")
def exists_semi(spark, sf_dir):
    return quality.with_history(result_rows(spark, sf_dir), snapshots(spark, sf_dir).where("fiscal_year >= '2000'")).select("id")


@query(f"WITH {RESULTS} SELECT id, CASE WHEN revenue_cur IS NULL THEN excluded_by_revenue WHEN revenue_cur BETWEEN 10000000 AND 60000000 THEN 0 ELSE 1 END AS flag FROM results")
def range_flag(spark, sf_dir):
    return result_rows(spark, sf_dir).select("id", A.range_flag(F.col("revenue_cur"), F.col("excluded_by_revenue"), 10_000_000, 60_000_000).alias("flag"))


@query(f"WITH {RESULTS} SELECT id, CASE WHEN parse_status = 'FAILED' AND rcept_no IS NOT NULL THEN NULL ELSE parse_status END AS parse_status FROM results")
def reset_failed(spark, sf_dir):
    return results.reset_failed(result_rows(spark, sf_dir).withColumn("parse_note", F.lit(None).cast("string"))).select("id", "parse_status")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) < DATE '1998-08-02' - 365 AS stale FROM orders")
def stale_flag(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", A.is_stale(F.date_format("o_orderdate", "yyyyMMdd"), F.to_date(F.lit("1998-08-02"))).alias("stale"))


# ---- order by band --------------------------------------------------------------------


@query(f"""WITH {RESULTS}, d AS (SELECT id, [x FOR x IN [CASE WHEN revenue_cur > 0 THEN abs(ln(revenue_cur) - ln(sqrt(10000000.0 * 60000000.0))) END, CASE WHEN total_assets_cur > 0 THEN abs(ln(total_assets_cur) - ln(20000000.0)) END] IF x IS NOT NULL] AS ds FROM results),
k AS (SELECT id, CASE WHEN len(ds) > 0 THEN list_sum(ds) / len(ds) END AS known FROM d)
SELECT id, round(coalesce(known, (SELECT median(known) FROM k), 0), 6) AS score FROM k""")
def band_order(spark, sf_dir):
    rows = bands.with_band_score(result_rows(spark, sf_dir), {"min_krw": 10_000_000, "max_krw": 60_000_000}, {"min_krw": 20_000_000}, "revenue_cur", "total_assets_cur")
    return rows.select("id", F.round("score", 6).alias("score"))


@query(f"WITH {RESULTS} SELECT rcept_no, CAST(min(id) AS BIGINT) AS id FROM results WHERE rcept_no IS NOT NULL GROUP BY rcept_no")
def download_order_dedupe(spark, sf_dir):
    return latest.download_order(result_rows(spark, sf_dir).withColumn("score", F.lit(0.0))).select("rcept_no", "id")


# ---- histories ------------------------------------------------------------------------


@query("""WITH f AS (SELECT o_custkey AS result_id, CAST(19980000000000 + o_orderkey AS VARCHAR) AS rcept_no, 1900 + dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS fy FROM orders),
c AS (SELECT result_id, fy AS year, rcept_no, 1 AS own FROM f UNION ALL SELECT result_id, fy - 1, rcept_no, 0 FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY result_id, year ORDER BY own DESC, rcept_no DESC) AS n FROM c),
y AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY year DESC) AS k FROM b WHERE n = 1)
SELECT result_id, CAST(year AS VARCHAR) AS fiscal_year, rcept_no, CAST(own AS INTEGER) AS from_current_period FROM y WHERE k <= 4""")
def history_years(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    fy = F.lit(1900) + F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    f = o.select(F.col("o_custkey").alias("result_id"), (F.col("o_orderkey") + 19980000000000).cast("string").alias("rcept_no"), fy.alias("fiscal_year"))
    return history.history_fold(f, 4)


@query(f"""WITH {SNAPSHOTS} SELECT result_id, fiscal_year, auditor_name <> lag(auditor_name) OVER (PARTITION BY result_id ORDER BY fiscal_year) AS changed_from_prev FROM snapshots""")
def auditor_change_from_prev(spark, sf_dir):
    s = snapshots(spark, sf_dir).withColumn("auditor_name", F.regexp_replace("auditor_name", r"\s", ""))
    return history.with_auditor_change(s, ["result_id"]).select("result_id", "fiscal_year", "changed_from_prev")


@query(f"WITH {SNAPSHOTS} SELECT result_id, CASE WHEN count(DISTINCT auditor_name) >= 2 THEN 1 WHEN count(DISTINCT auditor_name) = 1 AND count(auditor_name) >= 2 THEN 0 END AS auditor_changed FROM snapshots GROUP BY 1")
def auditor_changed_company(spark, sf_dir):
    return history.company_auditor_change(snapshots(spark, sf_dir), ["result_id"])


# ---- reshaping ------------------------------------------------------------------------


@query(f"""WITH {SNAPSHOTS}, {COMPANIES}
SELECT result_id, fiscal_year, item, amount, corp_name FROM ({' UNION ALL '.join(f"SELECT result_id, fiscal_year, '{i}' AS item, {i} AS amount FROM snapshots" for i in ITEMS)}) LEFT JOIN companies ON id = result_id""")
def unpivot_long(spark, sf_dir):
    rows = reshape.unpivoted(snapshots(spark, sf_dir), ["result_id", "fiscal_year"], ITEMS)
    names = companies(spark, sf_dir).select(F.col("id").alias("result_id"), "corp_name")
    return rows.join(names, "result_id", "left").select("result_id", "fiscal_year", "item", "amount", "corp_name")


_CASES = " ".join(f"WHEN '{i}' THEN '{s}'" for s, items in fixed.STATEMENTS.items() for i in items)


@query(f"""WITH {SNAPSHOTS} SELECT CASE item {_CASES} END AS statement, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM (
{' UNION ALL '.join(f"SELECT '{i}' AS item, {i} AS amount FROM snapshots" for i in ITEMS)}) GROUP BY 1""")
def statement_classify(spark, sf_dir):
    rows = reshape.unpivoted(snapshots(spark, sf_dir), ["result_id"], ITEMS)
    return rows.groupBy(reshape.statement_of(F.col("item")).alias("statement")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query(f"WITH {SNAPSHOTS} SELECT result_id, {', '.join(f'''max(revenue) FILTER (WHERE fiscal_year = '{y}') AS y{y}''' for y in (1996, 1997, 1998))} FROM snapshots GROUP BY 1")
def pivot_years(spark, sf_dir):
    rows = snapshots(spark, sf_dir).select("result_id", "fiscal_year", F.col("revenue").alias("amount"))
    wide = reshape.by_year(rows, ["result_id"], ["1996", "1997", "1998"])
    return wide.select("result_id", *[F.col(y).alias(f"y{y}") for y in ("1996", "1997", "1998")])


# ---- peers ----------------------------------------------------------------------------

_MISSING = " OR ".join(f"{k} IS NULL" for k in A.RATIO_INPUTS) + " OR revenue <= 0 OR total_assets <= 0 OR current_liab <= 0 OR total_equity = 0"
POOL = f"""{RESULTS}, {SNAPSHOTS}, usable AS (SELECT * FROM snapshots WHERE parse_status <> 'FAILED' AND NOT ({_MISSING})),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY CAST(fiscal_year AS INTEGER) DESC) AS n FROM usable) WHERE n = 1),
pool AS (SELECT r.id AS result_id, r.corp_name, r.induty_code, r.induty_name, r.audit_opinion, u.fiscal_year AS year, u.revenue, u.gross_profit,
  u.gross_profit / u.revenue AS gross_margin, u.operating_income / u.revenue AS operating_margin FROM results r JOIN newest u ON u.result_id = r.id
  WHERE coalesce(excluded_by_stale_disclosure, 0) <> 1 AND abs(u.gross_profit / u.revenue) <= 1 AND abs(u.operating_income / u.revenue) <= 1)"""


def _nearest_sql(source: str, limit: int) -> str:
    return f"""pairs AS (
  SELECT t.result_id AS target_id, p.result_id AS peer_id, k.n AS level, abs(p.revenue - t.revenue) AS distance,
         count(*) OVER (PARTITION BY t.result_id, k.n) AS c
  FROM pool t CROSS JOIN (SELECT 3 AS n UNION ALL SELECT 2) k JOIN {source} p ON left(p.induty_code, k.n) = left(t.induty_code, k.n) AND p.result_id <> t.result_id),
chosen AS (SELECT target_id, max(level) AS level FROM pairs WHERE c >= 2 GROUP BY 1),
near AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.target_id ORDER BY distance, peer_id) AS rank FROM pairs p JOIN chosen c USING (target_id, level)) WHERE rank <= {limit})"""


RELIABLE = "(SELECT * FROM pool WHERE coalesce(audit_opinion, '') NOT LIKE '%의견거절%' AND coalesce(audit_opinion, '') NOT LIKE '%부적정%')"


def _pool(spark, sf_dir) -> DataFrame:
    return materialised(peers.peer_pool(result_rows(spark, sf_dir), snapshots(spark, sf_dir)))


@query(f"WITH {POOL} SELECT result_id, year, revenue, round(gross_margin, 9) AS gross_margin, round(operating_margin, 9) AS operating_margin FROM pool")
def peer_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select("result_id", "year", "revenue", F.round("ratios.gross_margin", 9).alias("gross_margin"), F.round("ratios.operating_margin", 9).alias("operating_margin"))


@query(f"WITH {POOL}, {_nearest_sql(RELIABLE, 8)} SELECT target_id, peer_id, level, rank FROM near")
def peers_topk_prefix(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return peers.select_peers(pool, pool).select("target_id", "peer_id", "level", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {POOL}, {_nearest_sql(RELIABLE, 8)} SELECT target_id, round(sum(gross_profit) / sum(revenue), 9) AS gross_margin, count(*) AS n_peers
FROM near JOIN pool ON pool.result_id = peer_id GROUP BY 1""")
def industry_weighted_avg(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return peers.industry_average(peers.select_peers(pool, pool), pool).select("target_id", F.round("gross_margin", 9).alias("gross_margin"), "n_peers")


@query(f"""WITH {POOL}, {_nearest_sql('pool', 15)}, members AS (SELECT target_id, peer_id AS result_id, rank FROM near UNION ALL SELECT DISTINCT target_id, target_id, 0 FROM near)
SELECT target_id, CAST(rank AS BIGINT) AS rank, corp_name AS name, CASE WHEN rank <> 0 AND coalesce(audit_opinion, '') LIKE '%의견거절%' THEN NULL ELSE revenue END AS revenue,
  coalesce(nullif(trim(coalesce(audit_opinion, '')), ''), '미상') AS opinion, rank = 0 AS is_target FROM members JOIN pool USING (result_id)""")
def region_group_masked(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return peers.region_group(pool, pool).select("target_id", F.col("rank").cast("bigint").alias("rank"), "name", "revenue", "opinion", "is_target")


@query(f"""WITH {SNAPSHOTS} SELECT result_id, fiscal_year, list_aggregate([x FOR x IN [{', '.join(f"CASE WHEN {k} IS NULL{' OR ' + k + ' <= 0' if k in A.POSITIVE_INPUTS else ''}{' OR ' + k + ' = 0' if k in A.NONZERO_INPUTS else ''} THEN '{k}' END" for k in A.RATIO_INPUTS)}] IF x IS NOT NULL], 'string_agg', ',') AS missing
FROM (SELECT * REPLACE (nullif(current_liab % 7, 0) AS current_liab) FROM snapshots)""")
def missing_inputs_array(spark, sf_dir):
    s = snapshots(spark, sf_dir).withColumn("current_liab", F.nullif(F.col("current_liab") % 7, F.lit(0)))
    missing = F.array_join(A.missing_ratio_inputs({k: F.col(k) for k in A.RATIO_INPUTS}), ",")
    return s.select("result_id", "fiscal_year", F.nullif(missing, F.lit("")).alias("missing"))


@query(f"""WITH {SNAPSHOTS}, y AS (SELECT result_id, fiscal_year, CASE WHEN parse_status = 'FAILED' THEN 0 WHEN {_MISSING} THEN 1 END AS kind FROM snapshots)
SELECT result_id, coalesce(string_agg(fiscal_year, ',' ORDER BY kind, fiscal_year) FILTER (WHERE kind IS NOT NULL), '') AS years FROM y GROUP BY 1""")
def excluded_years(spark, sf_dir):
    return peers.excluded_years(snapshots(spark, sf_dir)).select("result_id", F.array_join("excluded_years", ",").alias("years"))


# ---- audits ---------------------------------------------------------------------------


@query("SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus <> 'F'")
def except_drift(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    before = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "F").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.lit("x"))
    return quality.drift(o, before, ["o_orderpriority"])


@query(f"WITH {RESULTS} SELECT parse_status AS old, CASE WHEN id % 8 = 2 THEN 'OK' ELSE parse_status END AS new, count(*) AS n FROM results GROUP BY 1, 2")
def transition_matrix(spark, sf_dir):
    before = result_rows(spark, sf_dir)
    now = before.withColumn("parse_status", F.when(F.col("id") % 8 == 2, "OK").otherwise(F.col("parse_status")))
    return quality.transitions(now, before, "id", "parse_status")


@query(f"""WITH {SNAPSHOTS} SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN abs(gp - (revenue - cogs)) <= 1 THEN 'ok' WHEN abs(abs(gp) - abs(revenue - cogs)) <= 1 THEN 'sign_flip' ELSE 'magnitude_off' END AS verdict
FROM (SELECT *, CASE result_id % 3 WHEN 0 THEN gross_profit WHEN 1 THEN -gross_profit ELSE gross_profit * 2 END AS gp FROM snapshots)) GROUP BY 1""")
def identity_audit(spark, sf_dir):
    i = F.col("result_id") % 3
    s = snapshots(spark, sf_dir).withColumn("gp", F.when(i == 0, F.col("gross_profit")).when(i == 1, -F.col("gross_profit")).otherwise(F.col("gross_profit") * 2))
    return s.groupBy(quality.identity(F.col("gp"), F.col("revenue") - F.col("cogs")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# ---- matching -------------------------------------------------------------------------


@query("""SELECT p_brand AS name, coalesce(CAST(p_size AS VARCHAR), '') AS unit, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS codes FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def ambiguous_groups(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("corp_name_norm"), F.col("p_size").cast("string").alias("crawl_induty_code"), F.col("p_partkey").cast("string").alias("corp_code"))
    return matching.ambiguous_groups(p).select("name", "unit", F.size("codes").cast("bigint").alias("n"), F.array_join("codes", ",").alias("codes"))


_POSITIONED = """c AS (SELECT c_nationkey AS unit, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position, c_custkey, c_name FROM customer),
l AS (SELECT unit, position, CAST(c_custkey AS VARCHAR) AS corp_code, CASE WHEN unit % 5 = 0 AND position % 2 = 0 THEN 'other' ELSE c_name END AS listed_name FROM c WHERE NOT (unit % 7 = 0 AND position = 1)),
v AS (SELECT coalesce(c.unit, l.unit) AS unit, count(c.c_name) AS n_sheet, count(l.corp_code) AS n_listed, count(*) FILTER (WHERE coalesce(c_name <> listed_name, TRUE)) AS n_mismatched FROM c FULL JOIN l ON c.unit = l.unit AND c.position = l.position GROUP BY 1)"""


def _positioned(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("unit"), n.alias("position"), "c_custkey", F.col("c_name").alias("corp_name"))
    listed = c.where(~((F.col("unit") % 7 == 0) & (F.col("position") == 1))).select("unit", "position", F.col("c_custkey").cast("string").alias("corp_code"), F.when((F.col("unit") % 5 == 0) & (F.col("position") % 2 == 0), "other").otherwise(F.col("corp_name")).alias("listed_name"))
    return matching.positional_join(c.select("unit", "position", "corp_name"), listed)


@query(f"WITH {_POSITIONED} SELECT unit, n_sheet, n_listed, n_mismatched, n_sheet = n_listed AND n_mismatched <= greatest(3, CAST(floor(n_sheet * 0.30) AS BIGINT)) AS accepted FROM v")
def positional_join_validate(spark, sf_dir):
    return _positioned(spark, sf_dir)[1]


@query(f"""WITH {_POSITIONED} SELECT c.unit, c.position, c.c_name AS corp_name, l.corp_code, l.listed_name FROM c JOIN l ON c.unit = l.unit AND c.position = l.position
JOIN v ON v.unit = c.unit WHERE n_sheet = n_listed AND n_mismatched <= greatest(3, CAST(floor(n_sheet * 0.30) AS BIGINT))""")
def positional_join_rows(spark, sf_dir):
    return _positioned(spark, sf_dir)[0].select("unit", F.col("position").cast("bigint").alias("position"), "corp_name", "corp_code", "listed_name")


# ---- texts ----------------------------------------------------------------------------


@query("SELECT p_partkey, replace(replace(replace(replace(replace('(주)' || p_name || ' 주식회사', '주식회사', ''), '(주)', ''), ' ', ''), '(', ''), ')', '') AS name FROM part")
def name_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", T.company_name(F.concat(F.lit("(주)"), "p_name", F.lit(" 주식회사"))).alias("name"))


@query("""SELECT id, CASE w WHEN '경남' THEN '경상남도' WHEN '전라북도' THEN '전북특별자치도' END AS sido, CASE WHEN w IN ('경남', '전라북도') THEN n_name END AS sigungu
FROM (SELECT c_custkey AS id, split_part(n_name, ' ', 1) AS n_name, CASE c_custkey % 3 WHEN 0 THEN '경남' WHEN 1 THEN '전라북도' ELSE '어디' END AS w FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def address_parse(spark, sf_dir):
    rows = companies(spark, sf_dir)
    first = F.when(F.col("id") % 3 == 0, "경남").when(F.col("id") % 3 == 1, "전라북도").otherwise("어디")
    return rows.select("id", T.address_parts(F.concat_ws("  ", first, "sigungu", F.lit("1"))).alias("a")).select("id", "a.sido", "a.sigungu")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN -v WHEN 1 THEN v WHEN 2 THEN 0 END AS amount FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders)""")
def amount_parse(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    shown = F.format_number(F.round("o_totalprice"), 0)
    cell = F.when(k == 0, F.concat(F.lit("("), shown, F.lit(")"))).when(k == 1, F.concat(shown, F.lit(" ====="))).when(k == 2, "-").otherwise(" ")
    return _table(spark, sf_dir, "orders").select("o_orderkey", A.won_amount(cell).alias("amount"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN length(replace(replace(text, '<', ''), '>', '')) + 14 <= 4000 THEN '의견거절' END WHEN 1 THEN '한정' WHEN 2 THEN '적정' END AS opinion FROM documents""")
def opinion_classify(spark, sf_dir):
    """Opinions count inside the opening of a report only: one kind of report states it at its end."""
    k = F.col("doc_id") % 4
    body = F.translate("text", "<>", "")
    report = F.when(k == 0, F.concat(body, F.lit(" 의견을 표명하지 않습니다"))).when(k == 1, F.concat(F.lit("제외하고는 적정하게 표시하고 있습니다 "), body)).when(k == 2, F.concat(F.lit("<b>공정하게</b> 표시하고 있습니다 "), body)).otherwise(body)
    return _table(spark, sf_dir, "documents").select("doc_id", T.audit_opinion(report).alias("opinion"))


@query(r"SELECT page_id, left(regexp_replace(html, '<[^>]+>', ' ', 'g'), 4000) AS opening FROM pages")
def tag_strip_window(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.substring(T.plain_text(F.col("html")), 1, fixed.OPINION_WINDOW).alias("opening"))


@query(f"""WITH {POOL}, {_nearest_sql(RELIABLE, 8)} SELECT u.result_id, count(*) AS n_years, min(u.fiscal_year) AS first_year, any_value(coalesce(k.n, 0)) AS n_peers
FROM usable u LEFT JOIN (SELECT target_id, count(*) AS n FROM near GROUP BY 1) k ON k.target_id = u.result_id GROUP BY 1""")
def payload_json(spark, sf_dir):
    p = peers.report_payload(result_rows(spark, sf_dir).withColumn("auditor_name", F.col("auditor_name")), snapshots(spark, sf_dir), peers.peer_pool(result_rows(spark, sf_dir), snapshots(spark, sf_dir)))
    kind = "struct<financials:array<struct<year:string>>,peers:array<struct<name:string>>>"
    j = F.from_json("payload", kind)
    return p.select("result_id", F.size(j["financials"]).cast("bigint").alias("n_years"), j["financials"][0]["year"].alias("first_year"), F.coalesce(F.size(j["peers"]), F.lit(0)).cast("bigint").alias("n_peers"))
