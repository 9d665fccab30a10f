"""More queries over the driver tables: upserts, repairs, selections, texts and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import fixed
from ..functions import text as T
from ..operators import history, latest, matching, peers, quality, reshape, results
from ..sources import sinks
from . import jobs
from .queries import COMPANIES, ITEMS, POOL, RELIABLE, RESULTS, SNAPSHOTS, STATS, _nearest_sql, _pool, _table, companies, query, result_rows, snapshots, stats


# ---- tables kept up to date


@query(f"""WITH {STATS} SELECT crno, biz_year, CASE WHEN biz_year >= '1998' THEN CASE WHEN CAST(crno AS BIGINT) % 2 = 0 THEN NULL ELSE revenue * 2 END ELSE revenue END AS revenue FROM stats""")
def upsert_replaces_nulls(spark, sf_dir):
    old = stats(spark, sf_dir).select("crno", "biz_year", "revenue")
    new = old.where("biz_year >= '1998'")
    first = new.withColumn("load", F.lit(0))
    second = new.withColumn("revenue", F.when(F.col("crno").cast("bigint") % 2 != 0, F.col("revenue") * 2)).withColumn("load", F.lit(1))
    return latest.upsert(old, first.unionByName(second), ["crno", "biz_year"], "load")


@query(f"WITH {STATS} SELECT count(*) FILTER (WHERE biz_year >= '1998') AS inserted, count(*) FILTER (WHERE biz_year = '1997') AS updated FROM stats WHERE biz_year >= '1997'")
def upsert_counts(spark, sf_dir):
    rows = stats(spark, sf_dir)
    return latest.upsert_counts(rows.where("biz_year < '1998'"), rows.where("biz_year >= '1997'"), ["crno", "biz_year"])


@query("""SELECT CAST(o_custkey AS VARCHAR) AS crno, CAST(year(o_orderdate) AS VARCHAR) AS biz_year, CAST(trunc(o_totalprice) AS BIGINT) AS amount
FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 11 <> 0 AND o_custkey % 13 <> 0""")
def yearly_stats_page(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    crno = F.when(F.col("o_custkey") % 13 == 0, "0" * 13).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    page = o.select(F.when(F.col("o_orderstatus") == "O", "120").otherwise("110").alias("fnclDcd"), crno.alias("crno"), F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.year("o_orderdate").cast("string")).alias("bizYear"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("enpAmt"))
    return latest.yearly_stats(page, {"amount": "enpAmt"})


@query("""SELECT p_type AS name, min_by(CAST(p_size AS VARCHAR), len(CAST(p_size AS VARCHAR)) * 1000000 + p_partkey) AS code FROM part GROUP BY 1""")
def shortest_code_per_name(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    tree = p.select(F.concat(F.lit(" "), F.col("p_type"), F.lit(" ;")).alias("name"), F.col("p_size").cast("string").alias("code"), F.col("p_partkey").alias("position"))
    return latest.shortest_codes(tree)


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS date, count(*) AS used, greatest(300 - count(*), 0) AS remaining FROM events GROUP BY 1")
def quota_by_day(spark, sf_dir):
    usage = _table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("date"), F.lit(1).alias("n"))
    return jobs.quota_status(usage, 300)


@query(f"""WITH {RESULTS}, f AS (SELECT o_custkey AS id, max(CAST(19980000000000 + o_orderkey AS VARCHAR)) AS filed FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT r.id, filed AS rcept_no, CASE WHEN filed IS NULL THEN 'FAILED' ELSE parse_status END AS parse_status, CASE WHEN filed IS NOT NULL THEN revenue_cur END AS revenue_cur,
  CASE WHEN filed IS NULL THEN 1 ELSE excluded_by_stale_disclosure END AS stale FROM results r LEFT JOIN f ON f.id = r.id""")
def latest_filing_of_results(spark, sf_dir):
    filed = _table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("corp_code"), (F.col("o_orderkey") + 19980000000000).cast("string").alias("rcept_no"))
    rows = latest.with_latest_filing(result_rows(spark, sf_dir).withColumn("corp_code", F.col("id").cast("string")), filed)
    return rows.select("id", "rcept_no", "parse_status", "revenue_cur", F.col("excluded_by_stale_disclosure").alias("stale"))


@query("""SELECT key, max(ts) AS updated, max_by(value, ts) AS value FROM (SELECT event_type AS key, CAST(user_id AS VARCHAR) AS value, CAST(event_id AS BIGINT) AS ts FROM events) GROUP BY 1""")
def key_value_state(spark, sf_dir):
    """A table of keys with their last values; half of the loads replace what the other half wrote."""
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("value"), F.col("event_id").cast("bigint").alias("updated"))
    first = latest.with_values(e.where("false"), e.where("updated % 2 = 0"), "updated")
    return latest.with_values(first, e.where("updated % 2 = 1"), "updated").select("key", "updated", "value")


@query("SELECT DISTINCT left(CAST(p_size AS VARCHAR), 2) AS code FROM part WHERE p_size >= 10")
def mid_level_codes(spark, sf_dir):
    return latest.mid_level_codes(_table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("code")))


# ---- matching


@query("""SELECT p.p_partkey, CAST(p.p_size AS VARCHAR) AS jurir_no, CASE WHEN p.p_partkey % 5 <> 0 OR m.p_partkey IS NULL THEN p.p_name END AS induty_name
FROM part p JOIN part m ON m.p_partkey = CASE WHEN p.p_partkey % 2 = 0 THEN p.p_partkey + 1 ELSE p.p_partkey - 1 END""")
def permutation_repair(spark, sf_dir):
    """Pairs of rows whose attributes were swapped come back to their own codes; where no row has a code's number, its profile is taken."""
    p = _table(spark, sf_dir, "part")
    pair = F.floor(F.col("p_partkey") / 2)
    own = p.select(F.col("p_partkey").alias("k"), F.concat_ws("-", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("jurir_no"), F.col("p_name").alias("induty_name"))
    mate = F.when(F.col("k") % 2 == 0, F.col("k") + 1).otherwise(F.col("k") - 1)
    lost = F.when(F.col("k") % 5 != 0, F.replace("jurir_no", F.lit("-"), F.lit("")))
    swapped = own.select(mate.alias("k"), lost.alias("jurir_no"), "induty_name")
    index = p.select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("corp_code"), pair.cast("string").alias("corp_name_norm"), F.lit("10").alias("crawl_induty_code")).join(swapped, "k")
    profiles = own.select(F.col("k").cast("string").alias("corp_code"), "jurir_no")
    fixed = matching.repair_swapped(index.drop("k"), profiles, ["jurir_no", "induty_name"])
    number = F.col("corp_code").cast("bigint")
    size = F.expr("substring(replace(jurir_no, '-', ''), 1, length(replace(jurir_no, '-', '')) - length(corp_code))")
    return fixed.select(number.alias("p_partkey"), size.alias("jurir_no"), "induty_name")


@query(f"""WITH {COMPANIES} SELECT id, CAST(id + 1000000 AS VARCHAR) AS corp_code, CAST(19980000000000 + id AS VARCHAR) AS rcept_no FROM companies WHERE id % 2 = 0""")
def homonym_resolve(spark, sf_dir):
    """Companies without filings get the company of their name that has filings in the same place."""
    c = companies(spark, sf_dir)
    place = F.concat(F.lit("경상남도 "), F.col("sigungu"))
    lost = c.select("id", "corp_code", F.concat(F.lit("(주)"), "corp_name").alias("corp_name"), place.alias("address"))
    other = c.select((F.col("id") + 1000000).cast("string").alias("corp_code"), "corp_name", F.lit("20240101").alias("modify_date"), F.when(F.col("id") % 2 == 0, place).otherwise(F.lit("부산 중구")).alias("address"), "id")
    filed = other.select("corp_code", (F.col("id") + 19980000000000).cast("string").alias("rcept_no"))
    return matching.resolve_homonyms(lost, other.select("corp_code", "corp_name", "modify_date"), filed, other.select("corp_code", "address"))


# ---- selections


@query(f"WITH {RESULTS} SELECT id FROM results WHERE audit_opinion = '적정' OR revenue_cur IS NULL")
def union_of_selections(spark, sf_dir):
    rows = result_rows(spark, sf_dir)
    return results.union_ids(rows.where("audit_opinion = '적정'"), rows.where("revenue_cur is null"))


@query(f"WITH {RESULTS} SELECT id FROM results WHERE audit_opinion = '적정' AND revenue_cur IS NOT NULL")
def deselected_page(spark, sf_dir):
    rows = result_rows(spark, sf_dir)
    return results.without_ids(rows.where("audit_opinion = '적정'"), rows.where("revenue_cur is null"))


@query("""WITH c AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS code FROM part)
SELECT code FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE c.code LIKE d.code || '_%')""")
def descendant_pruning(spark, sf_dir):
    return results.without_descendants(_table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("code")).distinct())


@query(f"WITH {RESULTS} SELECT id FROM results WHERE audit_opinion = '적정' AND job_id <> 1")
def foreign_ids(spark, sf_dir):
    rows = result_rows(spark, sf_dir)
    return results.foreign_ids(rows, rows.where("audit_opinion = '적정'").select("id"), 1)


@query(f"WITH {RESULTS}, {SNAPSHOTS} SELECT id AS result_id, rcept_no FROM results WHERE rcept_no IS NOT NULL UNION SELECT result_id, rcept_no FROM snapshots")
def owned_filings(spark, sf_dir):
    return results.owned_filings(result_rows(spark, sf_dir), snapshots(spark, sf_dir))


# ---- texts and scalars


@query("SELECT p_partkey, replace(p_name, ' ', '') AS label FROM part")
def account_label_normalize(spark, sf_dir):
    k = F.col("p_partkey") % 6
    name = F.col("p_name")
    shown = (
        F.when(k == 0, F.concat(F.lit("Ⅱ . "), name)).when(k == 1, F.concat(F.lit("Vl."), name, F.lit("(주석10과 13)"))).when(k == 2, F.concat(F.lit("(1)"), name, F.lit("(Ⅳ+Ⅴ)")))
        .when(k == 3, F.concat(F.lit("가."), name, F.lit(" (주석3)(주당손익 당기 (14)원)"))).when(k == 4, F.concat(F.lit("  12. "), name, F.lit("\n"))).otherwise(name)
    )
    return _table(spark, sf_dir, "part").select("p_partkey", T.account_label(shown).alias("label"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN -v WHEN 1 THEN v WHEN 2 THEN -v ELSE v END AS amount FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders)")
def sign_by_label(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, "Ⅴ. 영업손실").when(k == 1, "영업이익(손실)").when(k == 2, "매출총손실(이익)").otherwise("매출액")
    return _table(spark, sf_dir, "orders").select("o_orderkey", A.signed_by_label(label, F.round("o_totalprice").cast("bigint")).alias("amount"))


@query("SELECT o_orderkey, o_orderpriority || '회계법인' AS key FROM (SELECT o_orderkey, replace(o_orderpriority, ' ', '') AS o_orderpriority FROM orders)")
def auditor_key_spellings(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    name = F.col("o_orderpriority")
    shown = F.when(k == 0, F.concat(F.lit("회계법인 "), name)).when(k == 1, F.concat(name, F.lit(" 회계법인 대표이사 김"))).otherwise(F.concat(name, F.lit("회계법인")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.auditor_key(shown).alias("key"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS filed, CAST(CAST(make_date(CAST(year(o_orderdate) - 4 AS INTEGER), 1, 1) AS DATE) AS VARCHAR) AS reads_from FROM orders""")
def filing_dates(spark, sf_dir):
    number = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", A.filing_date(number).alias("filed"), A.history_start(F.to_date("o_orderdate"), 4).cast("string").alias("reads_from"))


@query("SELECT p_partkey, p_name || CASE WHEN n > 1 THEN '_' || CAST(n AS VARCHAR) ELSE '' END || '.html' AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part)")
def unique_file_names(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", T.file_stem(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ."))).alias("stem"))
    return sinks.unique_names(p, "stem", "p_partkey").select("p_partkey", "file_name")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '110111' || p_partkey WHEN 1 THEN CAST(p_partkey AS VARCHAR) END AS number FROM part")
def corporate_numbers(spark, sf_dir):
    k, n = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("110111-"), n)).when(k == 1, F.concat(F.lit(" "), n, F.lit("- "))).otherwise(" - ")
    return _table(spark, sf_dir, "part").select("p_partkey", T.corporate_number(raw).alias("number"))


@query(r"SELECT p_partkey, regexp_replace(' ' || p_type || ' ;(' || p_name || ')', '[\s;()]', '', 'g') AS name FROM part")
def industry_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", T.industry_name(F.concat(F.lit(" "), "p_type", F.lit(" ;("), "p_name", F.lit(")"))).alias("name"))


@query("SELECT p_partkey, replace(p_name, ' ', '') AS key FROM part")
def cross_year_labels(spark, sf_dir):
    """One account under the numbers and notes of different years."""
    k = F.col("p_partkey") % 4
    name = F.col("p_name")
    shown = F.when(k == 0, F.concat(F.lit("12. "), name)).when(k == 1, F.concat(F.lit("IV) "), name, F.lit("(주석 3)"))).when(k == 2, F.concat(name, F.lit(" (당기) "))).otherwise(name)
    return _table(spark, sf_dir, "part").select("p_partkey", T.cross_year_label(shown).alias("key"))


@query("SELECT page_id, url || '?crtfc_key=***REDACTED***&serviceKey=***REDACTED*** end' AS line, page_id % 2 = 0 AS out_of_quota FROM pages")
def log_lines(spark, sf_dir):
    """Keys in the addresses that a log shows are masked, and answers that tell of a quota are known."""
    n = F.col("page_id").cast("string")
    line = F.concat(F.col("url"), F.lit("?crtfc_key="), n, F.lit("x&serviceKey="), n, F.lit("%2F end"))
    answer = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("LIMITED_NUMBER_OF_SERVICE_REQUESTS_EXCEEDS "), n)).otherwise("NORMAL SERVICE")
    return _table(spark, sf_dir, "pages").select("page_id", T.masked_keys(line).alias("line"), T.says_quota_exceeded(answer).alias("out_of_quota"))


# ---- histories, peers, audits


@query(f"""WITH {SNAPSHOTS} SELECT result_id, max_by(auditor_name, CAST(fiscal_year AS INTEGER)) AS label, max(CAST(fiscal_year AS INTEGER)) AS level FROM snapshots GROUP BY 1""")
def newest_labels(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    accounts = s.select(F.lit("revenue").alias("item"), F.col("result_id").alias("key"), F.col("auditor_name").alias("label"), F.col("fiscal_year").cast("int").alias("level"), "fiscal_year")
    return history.newest_labels(accounts).select(F.col("key").alias("result_id"), "label", "level")


@query(f"""WITH {SNAPSHOTS}, {COMPANIES} SELECT result_id, corp_name, fiscal_year, statement, count(*) AS n_accounts, CAST(sum(amount) AS BIGINT) AS amount FROM (
  {' UNION ALL '.join(f"SELECT result_id, fiscal_year, '{s}' AS statement, {i if i in ITEMS else 'NULL'} AS amount FROM snapshots" for s, items in fixed.STATEMENTS.items() for i in items)})
LEFT JOIN (SELECT * FROM companies WHERE id % 4 <> 0) ON id = result_id GROUP BY ALL""")
def history_long(spark, sf_dir):
    """All accounts of all years in long form; where the company isn't known, its name is null."""
    s = snapshots(spark, sf_dir)
    s = s.withColumns({i: F.lit(None).cast("bigint") for items in fixed.STATEMENTS.values() for i in items if i not in ITEMS})
    rows = reshape.history_rows(s, companies(spark, sf_dir).where("id % 4 <> 0"))
    return rows.groupBy("result_id", "corp_name", "fiscal_year", "statement").agg(F.count(F.lit(1)).alias("n_accounts"), F.sum("amount").alias("amount"))


@query(f"""WITH {SNAPSHOTS} SELECT s.result_id, s.fiscal_year AS column_year, coalesce(s.revenue, 0) AS amount FROM snapshots s""")
def history_cells(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    filed = F.concat_ws(":", F.col("result_id").cast("string"), "fiscal_year")
    accounts = s.select(filed.alias("rcept_no"), "fiscal_year", F.lit("revenue").alias("item"), F.col("result_id").cast("string").alias("key"), F.col("revenue").alias("cur"), F.lit(-1).cast("bigint").alias("prv"))
    columns = s.select(F.col("fiscal_year").alias("column_year"), filed.alias("rcept_no"))
    return history.history_cells(accounts, columns).select(F.col("key").cast("bigint").alias("result_id"), "column_year", "amount")


@query(f"""WITH {POOL}, {_nearest_sql(RELIABLE, 8)}, y AS (SELECT target_id, min(p.year) AS lo, max(p.year) AS hi FROM near JOIN pool p ON p.result_id = peer_id GROUP BY 1)
SELECT target_id, CASE WHEN lo = hi AND lo = t.year THEN t.year || '년 기준' ELSE '각 사 최근 결산연도 기준 · 대상 ' || t.year || '년 / 비교사 ' || CASE WHEN lo = hi THEN lo ELSE lo || '~' || hi END || '년' END AS note
FROM y JOIN pool t ON t.result_id = target_id""")
def comparison_year_note(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    rows = peers.peer_rows(peers.select_peers(pool, pool), pool).join(pool.select(F.col("result_id").alias("target_id"), "year"), "target_id")
    return rows.select("target_id", peers.year_note(F.col("peer_years"), F.col("year")).alias("note"))


@query(f"""WITH {SNAPSHOTS} SELECT result_id, fiscal_year, CASE WHEN result_id % 2 = 0 THEN revenue ELSE coalesce(CASE WHEN result_id % 3 <> 0 THEN revenue END, revenue + 1) END AS revenue FROM snapshots""")
def backfill_nulls(spark, sf_dir):
    s = snapshots(spark, sf_dir).withColumn("k", F.concat_ws(":", F.col("result_id").cast("string"), "fiscal_year"))
    stored = s.withColumn("revenue", F.when((F.col("result_id") % 2 == 0) | (F.col("result_id") % 3 != 0), F.col("revenue")))
    parsed = s.where("result_id % 2 <> 0").select("k", (F.col("revenue") + 1).alias("revenue"))
    return quality.filled(stored, parsed, "k", ["revenue"]).select("result_id", "fiscal_year", "revenue")


@query(f"""WITH {SNAPSHOTS} SELECT CASE WHEN result_id % 2 = 0 THEN TRUE ELSE FALSE END AS changed, count(*) AS n FROM snapshots GROUP BY 1""")
def reparse_overwrites(spark, sf_dir):
    s = snapshots(spark, sf_dir).withColumn("k", F.concat_ws(":", F.col("result_id").cast("string"), "fiscal_year"))
    parsed = s.select("k", F.when(F.col("result_id") % 2 != 0, F.col("revenue")).alias("revenue"))
    return quality.overwritten(s, parsed, "k", ["revenue"]).groupBy("changed").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SNAPSHOTS} SELECT count(*) * 24 + (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS n_rows FROM snapshots""")
def selection_size(spark, sf_dir):
    return reshape.selection_size(snapshots(spark, sf_dir), _table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0"))


@query(f"""WITH {SNAPSHOTS} SELECT period, count(*) AS n FROM (SELECT CASE WHEN year(o_orderdate) = CAST(fiscal_year AS INTEGER) THEN 'cur' WHEN year(o_orderdate) = CAST(fiscal_year AS INTEGER) + 1 THEN 'prv' END AS period
FROM snapshots JOIN orders ON o_custkey = result_id) GROUP BY 1""")
def resolved_periods(spark, sf_dir):
    rows = snapshots(spark, sf_dir).join(_table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("result_id"))
    period = quality.resolved_period(F.date_format("o_orderdate", "yyyyMMdd"), F.col("fiscal_year"), F.col("from_current_period"))
    return rows.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))
