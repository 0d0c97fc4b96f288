"""Every query of the engine by name, and the SQL that gives the same rows.

Documents and conversations hold e-mail addresses and card numbers. The other entities stand in texts derived from keys: the
expressions of DERIVED are plain enough to mean the same in Spark and in the oracle's SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ner
from .functions.normalise import shadow_text
from .operators.names import distinct_names, output_name
from .operators.scrub import detect_findings, entity_counts, restore, scrub, scrubbed_with_mapping, text_mapping
from .operators.tables import preview, scrub_table
from .sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_t = read_table


def _masked(df: DataFrame, key: str, text: str, entities: list[str] | None = None, **options) -> DataFrame:
    rows = df.select(key, F.expr(text).alias("text"))
    return scrub(rows, entities=entities, max_chars=None, **options).select(key, "scrubbed")


def _digits(value: str, n: int) -> list[str]:
    return [f"cast(substr({value}, {k}, 1) as int)" for k in range(1, n + 1)]


def _padded(value: str, n: int) -> str:
    return f"lpad(cast(({value}) as string), {n}, '0')"


_BODY = _padded("c_custkey % 10000000", 7)
_CODE = "(10 + c_custkey % 26)"
_SUM = f"(cast(({_CODE} - {_CODE} % 10) / 10 as int) + 9 * ({_CODE} % 10) + 8 + " + " + ".join(f"{w} * {d}" for w, d in zip((7, 6, 5, 4, 3, 2, 1), _digits(_BODY, 7))) + ")"
_ID = f"(substr('ABCDEFGHJKLMNPQRSTUVXYWZIO', cast(c_custkey % 26 + 1 as int), 1) || '1' || {_BODY} || cast((10 - {_SUM} % 10 + (case when c_custkey % 5 = 0 then 1 else 0 end)) % 10 as string))"
_MOBILE = "('09' || " + _padded("c_custkey % 100000000", 8) + ")"
_UBN = _padded("p_partkey * 7919 % 100000000", 8)
_UBN_SUM = "(" + " + ".join(f"(({d} * {w}) % 10 + cast((({d} * {w}) - ({d} * {w}) % 10) / 10 as int))" for d, w in zip(_digits(_UBN, 8), (1, 2, 1, 2, 1, 2, 4, 1))) + ")"
_ACCOUNT = _padded("o_orderkey * 1009", 13)

_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}"
_CARD_TOKENS = "list_filter(regexp_extract_all(text, '[0-9A-Za-z-]+'), lambda x: regexp_full_match(x, '[0-9]{16}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}'))"
_LUHN = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN substr(replace(c, '-', ''), i, 1)::INT ELSE (2 * substr(replace(c, '-', ''), i, 1)::INT) % 10 + (2 * substr(replace(c, '-', ''), i, 1)::INT) // 10 END)) % 10 = 0"
_CARDS = f"(SELECT * FROM (SELECT *, unnest({_CARD_TOKENS}) AS c FROM [T]) WHERE {_LUHN})"


@query(f"SELECT doc_id, regexp_replace(text, '({_LOCAL}){_LOCAL}*@({_DOMAIN})', '\\1***@\\2', 'g') AS scrubbed FROM documents")
def email_masked(spark, sf):
    return _masked(_t(spark, sf, "documents"), "doc_id", "text", ["EMAIL_ADDRESS"], join_broken=False)


@query(f"SELECT page_id, count(*) AS n, min(e) AS first_masked FROM (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, '{_LOCAL}+@{_DOMAIN}')), '^(.).*@', '\\1***@') AS e FROM pages) GROUP BY page_id")
def email_findings(spark, sf):
    found = detect_findings(_t(spark, sf, "pages"), ["page_id"], "html", entities=["EMAIL_ADDRESS"], join_broken=False, max_chars=None)
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("original_masked").alias("first_masked"))


@query("SELECT doc_id, CASE WHEN contains(c, '-') THEN '****-****-****-' ELSE '************' END || right(c, 4) AS original_masked, count(*) AS n FROM " + _CARDS.replace("[T]", "documents") + " GROUP BY ALL")
def card_findings(spark, sf):
    return detect_findings(_t(spark, sf, "documents"), ["doc_id"], entities=["CREDIT_CARD"], join_broken=False, max_chars=None).groupBy("doc_id", "original_masked").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_custkey, '身分證' || CASE WHEN c_custkey % 5 = 0 THEN {_ID} ELSE substr({_ID}, 1, 2) || '******' || substr({_ID}, 9, 2) END AS scrubbed FROM customer")
def national_id_mask(spark, sf):
    return _masked(_t(spark, sf, "customer"), "c_custkey", f"'身分證' || {_ID}")


@query(f"SELECT c_custkey, '手機' || substr({_MOBILE}, 1, 3) || '****' || substr({_MOBILE}, 8, 3) || '。' AS scrubbed FROM customer")
def mobile_mask(spark, sf):
    return _masked(_t(spark, sf, "customer"), "c_custkey", f"'手機' || {_MOBILE} || '。'")


@query(f"SELECT c_custkey, substr({_MOBILE}, 1, 3) || '*-***-' || substr({_MOBILE}, 8, 3) AS scrubbed FROM customer")
def mobile_hyphen_mask(spark, sf):
    return _masked(_t(spark, sf, "customer"), "c_custkey", f"substr({_MOBILE}, 1, 4) || '-' || substr({_MOBILE}, 5, 3) || '-' || substr({_MOBILE}, 8, 3)")


@query(f"SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '02' || {_padded('s_suppkey % 100000000', 8)} ELSE '電話(02)****-**' || substr({_padded('s_suppkey % 100000000', 8)}, 7, 2) END AS scrubbed FROM supplier")
def landline_mask(spark, sf):
    n = _padded("s_suppkey % 100000000", 8)
    return _masked(_t(spark, sf, "supplier"), "s_suppkey", f"case when s_suppkey % 3 = 0 then '02' || {n} else '電話(02)' || substr({n}, 1, 4) || '-' || substr({n}, 5, 4) end")


@query(f"SELECT p_partkey, 0.95::DOUBLE AS score, substr({_UBN}, 1, 2) || '****' || substr({_UBN}, 7, 2) AS original_masked FROM part WHERE p_partkey % 2 = 0 AND ({_UBN_SUM} % 5 = 0 OR substr({_UBN}, 7, 1) = '7' AND ({_UBN_SUM} + 1) % 5 = 0)")
def ubn_tiers(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", F.expr(f"(case when p_partkey % 2 = 0 then '統編' else '數量' end) || {_UBN}").alias("text"))
    return detect_findings(rows, ["p_partkey"], entities=["TW_UBN"]).select("p_partkey", "score", "original_masked")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '生日' || (year(o_orderdate) - 1911) || '****' ELSE '編號' || (year(o_orderdate) - 1911) || strftime(o_orderdate, '%m%d') END AS scrubbed FROM orders")
def birthday_tiers(spark, sf):
    return _masked(_t(spark, sf, "orders"), "o_orderkey", "(case when o_orderkey % 2 = 0 then '生日' else '編號' end) || cast(year(o_orderdate) - 1911 as string) || date_format(o_orderdate, 'MMdd')")


_POLICY = ("'數' || " + _padded("o_orderkey", 10) + " || '筆。以下另列一份資料供參考:保單AB'", _padded("o_orderkey % 100000000", 8))


@query(f"SELECT o_orderkey, {_POLICY[0]} || '******' || substr({_POLICY[1]}, 7, 2) AS scrubbed FROM orders")
def policy_tiers(spark, sf):
    return _masked(_t(spark, sf, "orders"), "o_orderkey", f"{_POLICY[0]} || {_POLICY[1]}")


@query(f"SELECT o_orderkey, '帳號*********' || substr({_ACCOUNT}, 10, 4) AS scrubbed FROM orders")
def account_mask(spark, sf):
    return _masked(_t(spark, sf, "orders"), "o_orderkey", f"'帳號' || {_ACCOUNT}")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '代號' || lpad(cast(s_suppkey % 10000 as string), 4, '0') ELSE '代號:***行員' END AS scrubbed FROM supplier")
def agent_mask(spark, sf):
    return _masked(_t(spark, sf, "supplier"), "s_suppkey", f"case when s_suppkey % 4 = 0 then '代號' || {_padded('s_suppkey % 10000', 4)} else '代號:' || {_padded('s_suppkey % 1000', 3)} || '行員' end")


@query("SELECT s_suppkey, '台' || repeat('○', 13 + length(cast(s_suppkey % 1000 + 1 as string))) || '。' AS scrubbed FROM supplier")
def address_mask(spark, sf):
    return _masked(_t(spark, sf, "supplier"), "s_suppkey", "'台北市大安區信義路四段' || cast(s_suppkey % 1000 + 1 as string) || '號5樓。'")


@query(f"SELECT c_custkey, {_ID} || CASE WHEN c_custkey % 3 = 2 THEN chr(10) || chr(10) ELSE '' END || {_MOBILE} AS shadow FROM customer")
def shadow_join(spark, sf):
    text = f"substr({_ID}, 1, 6) || chr(10) || substr({_ID}, 7, 4) || (case when c_custkey % 3 = 0 then ' ' when c_custkey % 3 = 1 then ' ' || chr(10) else chr(10) || chr(10) end) || {_MOBILE}"
    return _t(spark, sf, "customer").select("c_custkey", shadow_text(F.expr(text)).alias("shadow"))


@query(f"SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '電話02-****' || chr(10) || '**' || substr({_padded('s_suppkey', 4)}, 3, 2) ELSE '編號02-2720' || chr(10) || {_padded('s_suppkey', 4)} || '資料' END AS scrubbed FROM supplier")
def crossline_phone(spark, sf):
    n = _padded("s_suppkey", 4)
    return _masked(_t(spark, sf, "supplier"), "s_suppkey", f"case when s_suppkey % 2 = 0 then '電話02-2720' || chr(10) || {n} else '編號02-2720' || chr(10) || {n} || '資料' end")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'TW_POLICY_NO' ELSE 'TW_MOBILE' END AS entity_type, CASE WHEN c_custkey % 2 = 0 THEN 0.95 ELSE 0.85 END::DOUBLE AS score FROM customer")
def overlap_resolution(spark, sf):
    rows = _t(spark, sf, "customer").select("c_custkey", F.expr(f"(case when c_custkey % 2 = 0 then '保單號碼' else '手機' end) || {_MOBILE}").alias("text"))
    return detect_findings(rows, ["c_custkey"]).select("c_custkey", "entity_type", "score")


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR {_ID} LIKE 'H10000007_' THEN {_ID} ELSE substr({_ID}, 1, 2) || '******' || substr({_ID}, 9, 2) END || '、手機' || substr({_MOBILE}, 1, 3) || '****' || substr({_MOBILE}, 8, 3) AS scrubbed FROM customer")
def whitelist_filter(spark, sf):
    return _masked(_t(spark, sf, "customer"), "c_custkey", f"{_ID} || '、手機' || {_MOBILE}", allow=[f"H10000007{k}" for k in range(10)])


#: Mobiles by customer: as many values as customers with orders. Every other text has its number broken over two lines.
_VISIT = "(" + _MOBILE.replace("c_custkey", "o_custkey") + ")"
_BROKEN = f"(case when o_orderkey % 2 = 0 then substr({_VISIT}, 1, 6) || chr(10) || substr({_VISIT}, 7, 4) else {_VISIT} end)"


def _visits(spark, sf, number: str = _VISIT) -> DataFrame:
    return _t(spark, sf, "orders").select("o_orderkey", F.expr("o_orderkey % 5").alias("branch"), F.expr(f"'手機' || {number} || '與02-2720' || {_padded('o_custkey % 9', 4)}").alias("text"))


_VISITS = f"""WITH v AS (SELECT o_orderkey, o_orderkey % 5 AS branch, {_VISIT} AS m, '02-2720' || {_padded('o_custkey % 9', 4)} AS p FROM orders),
a AS (SELECT m, row_number() OVER (ORDER BY min(o_orderkey)) AS k FROM v GROUP BY m), b AS (SELECT p, row_number() OVER (ORDER BY min(o_orderkey)) AS k FROM v GROUP BY p) """
_NUMBERED = _VISITS + "SELECT o_orderkey, '手機<MOBILE_' || a.k || '>與<PHONE_' || b.k || '>' AS scrubbed FROM v JOIN a USING (m) JOIN b USING (p)"


@query(_NUMBERED)
def placeholder_text(spark, sf):
    return scrub(_visits(spark, sf), mode="placeholder", order="o_orderkey").select("o_orderkey", "scrubbed")


@query(_NUMBERED)
def placeholder_of_broken_values(spark, sf):
    """A value has one number, broken over lines or not."""
    return scrub(_visits(spark, sf, _BROKEN), mode="placeholder", order="o_orderkey").select("o_orderkey", "scrubbed")


@query(_VISITS + "SELECT 'MOBILE' AS tag, m AS value, '<MOBILE_' || k || '>' AS placeholder FROM a UNION ALL SELECT 'PHONE', p, '<PHONE_' || k || '>' FROM b")
def placeholder_mapping(spark, sf):
    return text_mapping(_visits(spark, sf), "text", "o_orderkey").select("tag", "value", "placeholder")


@query(_VISITS + """, c AS (SELECT branch, m, row_number() OVER (PARTITION BY branch ORDER BY min(o_orderkey)) AS k FROM v GROUP BY branch, m), d AS (SELECT branch, p, row_number() OVER (PARTITION BY branch ORDER BY min(o_orderkey)) AS k FROM v GROUP BY branch, p)
SELECT o_orderkey, '手機<MOBILE_' || c.k || '>與<PHONE_' || d.k || '>' AS scrubbed FROM v JOIN c USING (branch, m) JOIN d USING (branch, p)""")
def placeholder_scopes(spark, sf):
    return scrub(_visits(spark, sf), mode="placeholder", order="o_orderkey", scope=["branch"]).select("o_orderkey", "scrubbed")


@query(f"SELECT o_orderkey, '手機' || {_VISIT} || '與02-2720' || {_padded('o_custkey % 9', 4)} AS restored FROM orders")
def placeholder_restore(spark, sf):
    out, ids = scrubbed_with_mapping(_visits(spark, sf), mode="placeholder", order="o_orderkey")
    return restore(out.select("o_orderkey", "scrubbed"), "scrubbed", ids).select("o_orderkey", "restored")


_WIDE = f"translate({_MOBILE}, '0123456789', '０１２３４５６７８９')"


@query(f"SELECT c_custkey, '手機' || substr({_WIDE}, 1, 3) || '****' || substr({_WIDE}, 8, 3) AS scrubbed FROM customer")
def fullwidth_mask(spark, sf):
    return _masked(_t(spark, sf, "customer"), "c_custkey", f"'手機' || {_WIDE}")


@query(f"SELECT c_custkey, 'call ' || substr({_MOBILE}, 1, 3) || '****' || substr({_MOBILE}, 8, 3) || ' now' AS scrubbed FROM customer")
def second_pass(spark, sf):
    """Numbers that are whole only in the raw text: joined, they are part of a longer run of letters."""
    return _masked(_t(spark, sf, "customer"), "c_custkey", f"'call ' || {_MOBILE} || ' now'")


@query(f"SELECT o_orderkey, o_orderkey % 3 <> 0 AS found, CASE o_orderkey % 3 WHEN 1 THEN 0.7 WHEN 2 THEN 0.95 END::DOUBLE AS score FROM orders")
def policy_scores(spark, sf):
    """Without a word nearby, digits alone are too little, and letters with digits are enough."""
    number = _padded("o_orderkey % 100000000", 8)
    rows = _t(spark, sf, "orders").select("o_orderkey", F.expr(f"case o_orderkey % 3 when 0 then '數9' || {number} || '9筆' when 1 then '這筆AB' || {number} || '資料' else '契約9' || {number} || '9' end").alias("text"))
    got = scrub(rows, entities=["TW_POLICY_NO"])
    return got.select("o_orderkey", (F.size("findings") > 0).alias("found"), F.get("findings", 0)["score"].alias("score"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0.95 ELSE 0.75 END::DOUBLE AS score, '*********' || substr({_ACCOUNT}, 10, 4) AS original_masked FROM orders")
def account_scores(spark, sf):
    rows = _t(spark, sf, "orders").select("o_orderkey", F.expr(f"(case when o_orderkey % 2 = 0 then '匯款' else '編號' end) || {_ACCOUNT}").alias("text"))
    return detect_findings(rows, ["o_orderkey"]).select("o_orderkey", "score", "original_masked")


@query()
def documents_default(spark, sf):
    """Findings of every text as it comes: all entities, broken values joined, too long texts set apart."""
    out = scrub(_t(spark, sf, "documents"), on_long="quarantine")
    return out.select("doc_id", F.size("findings").cast("long").alias("n_findings"), F.length("scrubbed").cast("long").alias("n_chars_scrubbed"), "error")


def _customers(spark, sf) -> DataFrame:
    return _t(spark, sf, "customer").select((F.col("c_custkey") + 2).alias("row"), F.col("c_name").alias("name"), F.expr(f"'聯絡手機' || {_MOBILE}").alias("note"), F.col("c_mktsegment").alias("segment"))


_PLAN = {"name": "mask_all", "note": "ner", "segment": "skip"}


@query(f"SELECT c_custkey + 2 AS row, left(c_name, 1) || repeat('○', length(c_name) - 1) AS name, '聯絡手機' || substr({_MOBILE}, 1, 3) || '****' || substr({_MOBILE}, 8, 3) AS note, c_mktsegment AS segment FROM customer")
def table_scrub(spark, sf):
    return scrub_table(_customers(spark, sf), _PLAN, "row")[0]


@query("SELECT c_custkey + 2 AS row, '<segment_' || k || '>' AS segment FROM customer JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) AS k FROM customer GROUP BY ALL) USING (c_mktsegment)")
def column_placeholder(spark, sf):
    return scrub_table(_customers(spark, sf), {"name": "skip", "note": "skip", "segment": "mask_all"}, "row", "placeholder")[0].select("row", "segment")


@query("SELECT 'COLUMN_MASK' AS entity_type, 'name' AS column, count(*) AS n FROM customer UNION ALL SELECT 'TW_MOBILE', 'note', count(*) FROM customer")
def table_report(spark, sf):
    return scrub_table(_customers(spark, sf), _PLAN, "row")[1].groupBy("entity_type", "column").agg(F.count(F.lit(1)).alias("n"))


def _stats(by: str) -> str:
    emails = f"SELECT {by}'EMAIL_ADDRESS' AS entity_type, sum(len(regexp_extract_all(text, '{_LOCAL}+@{_DOMAIN}')))::BIGINT AS n FROM documents GROUP BY ALL HAVING n > 0"
    return f"{emails} UNION ALL SELECT {by}'CREDIT_CARD', count(*) FROM {_CARDS.replace('[T]', 'documents')} GROUP BY ALL"


@query(_stats(""))
def entity_stats(spark, sf):
    return entity_counts(_t(spark, sf, "documents"), entities=["EMAIL_ADDRESS", "CREDIT_CARD"], join_broken=False, max_chars=None)


@query(_stats("source, lang, "))
def entity_stats_by_source(spark, sf):
    return entity_counts(_t(spark, sf, "documents"), ["source", "lang"], entities=["EMAIL_ADDRESS", "CREDIT_CARD"], join_broken=False, max_chars=None)


@query(f"SELECT conv_id, turn, regexp_replace(text, '({_LOCAL}){_LOCAL}*@({_DOMAIN})', '\\1***@\\2', 'g') AS scrubbed FROM conversations")
def conversation_scrub(spark, sf):
    rows = _t(spark, sf, "conversations")
    return scrub(rows, entities=["EMAIL_ADDRESS"], join_broken=False, max_chars=None).select("conv_id", "turn", "scrubbed")


@query(f"SELECT c_custkey, '客戶' || substr({_MOBILE}, 1, 3) || 'xxxx' || substr({_MOBILE}, 8, 3) || '.scrubbed.csv' AS name FROM customer")
def filename_scrub(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", output_name(F.expr(f"'客戶' || {_MOBILE} || '.CSV'")).alias("name"))


@query("SELECT n_nationkey, n_regionkey, 'report' || CASE WHEN k = 1 THEN '' ELSE ' (' || k || ')' END || '.csv' AS entry FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)")
def zip_names(spark, sf):
    rows = _t(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.expr("case when n_nationkey % 2 = 0 then '../../report.csv' else 'C:\\\\data\\\\report.csv' end").alias("name"))
    return distinct_names(rows, "name", "n_nationkey", ["n_regionkey"]).select("n_nationkey", "n_regionkey", "entry")


@query("SELECT 'c_name' AS name, k - 1 AS place, c_name AS sample, (SELECT count(*) FROM customer) AS row_count FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) WHERE k <= 3")
def preview_samples(spark, sf):
    rows = _t(spark, sf, "customer").select("c_custkey", "c_name")
    return preview(rows, "c_custkey").select("name", F.posexplode("samples").alias("place", "sample"), "row_count").withColumn("place", F.col("place").cast("long"))


_CUT = "CASE WHEN length(rest) <= 400 THEN length(rest) ELSE coalesce(nullif(length(regexp_extract(left(rest, 400), '(?s)^.*[。！？!?\n；;]')), 0), 400) END"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, 0::BIGINT AS start, {_CUT.replace('rest', 'text')} AS n, text AS rest FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, start + n, {_CUT.replace('rest', 'substr(rest, n + 1)')}, substr(rest, n + 1) FROM c WHERE length(rest) > n)
SELECT doc_id, start, n::BIGINT AS length FROM c""")
def ner_chunks(spark, sf):
    """Offset and length of the chunks that a provider of names sees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, at, len(part)) for k, text in batch.itertuples(index=False) for at, part in ner.chunks(text or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length"])

    return _t(spark, sf, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, start long, length long")
