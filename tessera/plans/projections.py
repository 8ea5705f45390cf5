"""Queries of the projection, cleaning, scan and set families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as c
from ..functions import derive
from ..operators import checks
from ..sources import readers
from .registry import query, table

# a wide survey with sentinel codes, spelled the same in both engines
CODE = "case when l_linenumber = 7 then '-99999' when l_linenumber = 6 then ' 8.0 ' when l_linenumber = 5 then 'x' else cast(l_linenumber as string) end"
FLAG = "case when l_linestatus = 'F' and l_linenumber < 3 then 'Yes' when l_linestatus = 'F' then ' 2.0' when l_linenumber = 4 then '-88888' when l_linenumber = 1 then '11' else 'no' end"
FLAG2 = "case when l_returnflag = 'R' then '1' when l_returnflag = 'A' then '0' else '-77771' end"
SQL_CODE = f"regexp_replace(trim({CODE}), '\\.0$', '')"
SENT = "('-77771','-77772','-88880','-88888','-99991','-99993','-99999')"
SQL_YN = lambda x: f"(case when upper(regexp_replace(trim({x}), '\\.0$', '')) in ('1','11','Y','YES','TRUE') then 1 when upper(regexp_replace(trim({x}), '\\.0$', '')) in ('0','2','N','NO','FALSE') then 0 end)"


def survey(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.expr(CODE).alias("code"), F.expr(FLAG).alias("flag"), F.expr(FLAG2).alias("flag2"))


@query("p05_clean_code", f"select l_orderkey, l_linenumber, case when {SQL_CODE} not in {SENT} then {SQL_CODE} end as cleaned, case when {SQL_CODE} not in {SENT} and {SQL_CODE} not in ('8','9') then {SQL_CODE} end as cleaned_survey from lineitem")
def p05(spark, d):
    return survey(spark, d).select("l_orderkey", "l_linenumber", c.clean_code(F.col("code")).alias("cleaned"), c.clean_code(F.col("code"), c.SURVEY_MISSING).alias("cleaned_survey"))


@query("p06_clean_numeric", f"select l_orderkey, l_linenumber, try_cast(case when {SQL_CODE} not in {SENT} then {SQL_CODE} end as double) as value from lineitem")
def p06(spark, d):
    return survey(spark, d).select("l_orderkey", "l_linenumber", c.clean_numeric(F.col("code")).alias("value"))


@query("p07_yes_no", f"select l_orderkey, l_linenumber, {SQL_YN(FLAG)} as release, case when upper(trim({FLAG})) in ('1','1.0','11','11.0','Y','YES','TRUE') then 1 when upper(trim({FLAG})) in ('2','2.0','N','NO','FALSE') then 0 end as screen, case when upper(trim({FLAG2})) in ('1','1.0','11','Y','YES','TRUE','T') then 1 when upper(trim({FLAG2})) in ('0','0.0','2','2.0','N','NO','FALSE','F') then 0 end as indicator from lineitem")
def p07(spark, d):
    s = survey(spark, d)
    return s.select("l_orderkey", "l_linenumber", c.yes_no(F.col("flag")).alias("release"), c.yes_no(F.col("flag"), "screen").alias("screen"), c.yes_no(F.col("flag2"), "indicator").alias("indicator"))


@query(
    "p08_three_valued_or",
    f"with s as (select l_orderkey, l_linenumber, {SQL_YN(FLAG)} as a, {SQL_YN(FLAG2)} as b from lineitem) select l_orderkey, l_linenumber, case when a = 1 or b = 1 then 1 when a is not null or b is not null then 0 end as any_positive, case when a = 1 or b = 1 then 1 when a = 0 or b = 0 then 0 end as combined, case when a is not null or b is not null then coalesce(a, 0) + coalesce(b, 0) end as selected from s",
)
def p08(spark, d):
    s = survey(spark, d).withColumns({"a": c.yes_no(F.col("flag")), "b": c.yes_no(F.col("flag2"))})
    a, b = F.col("a"), F.col("b")
    return s.select("l_orderkey", "l_linenumber", c.any_positive(a, b).alias("any_positive"), c.combine_binary(a, b).alias("combined"), c.selected_count(a, b).alias("selected"))


PHENO = {
    "self_reported_vision": "cast(1 + c_custkey % 6 as string)",
    "marital_status": "cast(1 + c_custkey % 5 as string)",
    "cesd10_score": "case when c_custkey % 7 = 0 then '-99991' else cast(c_custkey % 20 as string) end",
    "visual_acuity_left": "case when c_custkey % 5 = 0 then '-88880' else cast(c_custkey % 9 as string) end",
    "visual_acuity_right": "cast(c_custkey % 4 as string)",
    "oa_hand": "case when c_custkey % 3 = 0 then '1' else '2' end",
    "asthma": "case when c_custkey % 4 = 0 then '-88888' else '2' end",
    "copd": "case when c_custkey % 8 = 0 then '-99999' when c_custkey % 8 = 1 then 'yes' else 'no' end",
    "social_club": "cast(1 + c_custkey % 8 as string)",
    "diabetes": "case when c_custkey % 2 = 0 then '11' else '0' end",
}
# what the variable manifest says of them
KINDS = {n: "numeric" if n in ("cesd10_score", "visual_acuity_left", "visual_acuity_right") else "categorical" if n in ("self_reported_vision", "marital_status", "social_club") else "binary" for n in PHENO}


@query(
    "p09_phenotypes",
    """with s as (select c_custkey, case when 1 + c_custkey % 6 in (4, 5) then 1 when 1 + c_custkey % 6 in (1, 2, 3) then 0 end as visual_impairment_self_report,
      case when c_custkey % 7 = 0 then null when c_custkey % 20 >= 10 then 1 else 0 end as depression_cesd10,
      case when c_custkey % 5 = 1 then 1 else 0 end as married_or_partnered,
      case when c_custkey % 5 = 0 then null else least(cast(c_custkey % 9 as double), cast(c_custkey % 4 as double)) end as visual_acuity_better_eye,
      case when c_custkey % 3 = 0 then 1 else 0 end as arthritis_any,
      case when c_custkey % 8 = 1 then 1 when c_custkey % 8 = 0 then null else 0 end as asthma_or_copd,
      case when 1 + c_custkey % 8 in (1, 2) then 1 when 1 + c_custkey % 8 in (3, 4, 5) then 0 end as social_club_at_least_weekly,
      case when c_custkey % 2 = 0 then 1 else 0 end as diabetes from customer)
    select *, cast(null as integer) as visual_impairment_acuity, social_club_at_least_weekly as social_any_at_least_weekly, coalesce(diabetes, 0) + coalesce(arthritis_any, 0) + coalesce(asthma_or_copd, 0) as multimorbidity_selected_count from s""",
)
def p09(spark, d):
    wide = table(spark, d, "customer").select("c_custkey", *[F.expr(e).alias(n) for n, e in PHENO.items()])
    out = derive.derived(wide, KINDS)
    return out.select("c_custkey", "visual_impairment_self_report", "depression_cesd10", "married_or_partnered", "visual_acuity_better_eye", "arthritis_any", "asthma_or_copd", "social_club_at_least_weekly", "diabetes", "visual_impairment_acuity", "social_any_at_least_weekly", "multimorbidity_selected_count")


@query("p10_recode", "select o_orderkey, case when o_orderpriority in ('1-URGENT') then 1 when o_orderpriority in ('2-HIGH', '3-MEDIUM') then 2 when o_orderpriority in ('4-NOT SPECIFIED') then 3 end as level from orders")
def p10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", c.recode(F.col("o_orderpriority"), {1: ("1-URGENT",), 2: ("2-HIGH", "3-MEDIUM"), 3: ("4-NOT SPECIFIED",)}).alias("level"))


@query(
    "p11_mixed_timestamps",
    "select o_orderkey, case when o_orderkey % 4 = 3 then null else cast(cast(o_orderdate as date) as timestamp) end as parsed, case when o_orderkey % 4 = 3 then case when o_orderkey % 8 = 3 then cast('2001-02-03' as timestamp) end else cast(cast(o_orderdate as date) as timestamp) end as proxy, case when o_orderkey % 4 != 3 then 'order' when o_orderkey % 8 = 3 then 'status' else 'unavailable' end as proxy_source from orders",
)
def p11(spark, d):
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy/MM/dd")).when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "MM/dd/yyyy")).otherwise("unknown")
    parsed = table(spark, d, "orders").select("o_orderkey", c.parse_timestamp(text).cast("timestamp_ntz").alias("parsed"))
    value, source = c.first_known({"order": F.col("parsed"), "status": F.when(F.col("o_orderkey") % 8 == 3, F.lit("2001-02-03").cast("timestamp_ntz"))})
    return parsed.select("o_orderkey", "parsed", value.alias("proxy"), source.alias("proxy_source"))


@query(
    "p13_visit_sex_eye_id",
    "select c_custkey, case when c_custkey % 4 in (0, 1) then 'F1' when c_custkey % 4 = 2 then 'BL' end as visit, case c_custkey % 6 when 0 then 'F' when 1 then 'M' when 2 then 'MISSING' when 3 then 'OTHER:X7' when 4 then 'MISSING' else 'F' end as sex, case c_custkey % 3 when 0 then 'R' when 1 then 'L' else 'BOTH' end as eye, lpad(cast(c_custkey as varchar), 7, '0') as id, true as valid from customer",
)
def p13(spark, d):
    k = F.col("c_custkey")
    visit = F.element_at(F.array(*map(F.lit, ["fup1", " F1 ", "bl", "F2"])), (k % 4 + 1).cast("int"))
    sex = F.element_at(F.array(*[F.lit(x).cast("string") for x in ["Female", "1.0", None, " x7", "9", "woman"]]), (k % 6 + 1).cast("int"))
    eye = F.element_at(F.array(*map(F.lit, ["od", "Left", "OU"])), (k % 3 + 1).cast("int"))
    who = c.id_text(F.concat(F.lit(" "), F.lpad(k.cast("string"), 7, "0"), F.lit(".0")))
    return table(spark, d, "customer").select("c_custkey", c.visit_code(visit).alias("visit"), c.sex_code(sex).alias("sex"), c.eye_code(eye).alias("eye"), who.alias("id"), c.valid_id(who).alias("valid"))


@query(
    "p17_path_parts",
    """with p as (select page_id, regexp_replace(url, '[?#].*$', '') as path from pages), n as (select *, lower(regexp_extract(path, '([^/]*)$', 1)) as name from p)
    select page_id, name, case when regexp_matches(name, '[^.]\\.[^.]+$') then regexp_extract(name, '[^.](\\.[^.]+)$', 1) else '' end as extension, nullif(regexp_extract(path, '://([^/]+)/', 1), '') as host, nullif(regexp_extract(path, '/(en|de|fr|es)/', 1), '') as section from n""",
)
def p17(spark, d):
    path = F.regexp_replace("url", "[?#].*$", "")
    part = lambda r: F.nullif(F.regexp_extract(path, r, 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.lower(c.file_name(path)).alias("name"), c.extension(path).alias("extension"), part("://([^/]+)/").alias("host"), part("/(en|de|fr|es)/").alias("section"))


@query("p18_stable_keys", "select doc_id, substr(sha256(cast(doc_id as varchar) || '|' || source), 1, 24) as long_key, substr(sha1(source || cast(doc_id as varchar)), 1, 10) as short_key, regexp_replace(regexp_replace(lower(source || ' / ' || lang || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from documents")
def p18(spark, d):
    doc = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", c.stable_key(F.concat_ws("|", doc, "source")).alias("long_key"), c.stable_key(F.concat("source", doc), 10, "sha1").alias("short_key"), c.slug(F.concat("source", F.lit(" / "), "lang", F.lit("!"))).alias("slug"))


@query(
    "p19_multi_response",
    """with s as (select c_custkey, case when c_custkey % 2 = 0 then 1 else 0 end as a, case when c_custkey % 3 = 0 then 1 when c_custkey % 3 = 1 then 0 end as b, c_custkey % 10 = 9 as none from customer), t as (select c_custkey, case when not none then a end as a, case when not none then b end as b from s)
    select c_custkey, case when a = 1 and coalesce(b, 0) = 1 then 'Multiple groups' when a = 1 then 'Zulu' when b = 1 then 'Alpha' end as label, case when a = 1 and b = 1 then 'Alpha | Zulu' when a = 1 then 'Zulu' when b = 1 then 'Alpha' end as detail, coalesce(a, 0) + coalesce(b, 0) as selection_count,
    case when coalesce(a, 0) + coalesce(b, 0) = 1 then 'single_released_group' when coalesce(a, 0) + coalesce(b, 0) > 1 then 'multiple_released_groups' when a is not null or b is not null then 'no_released_group_selected' else 'all_indicators_missing_or_unknown' end as status, coalesce(a, 0) + coalesce(b, 0) > 0 as eligible from t""",
)
def p19(spark, d):
    k = F.col("c_custkey")
    a, b = F.when(k % 10 != 9, F.when(k % 2 == 0, 1).otherwise(0)), F.when(k % 10 != 9, F.when(k % 3 == 0, 1).when(k % 3 == 1, 0))
    rows = table(spark, d, "customer").select("c_custkey", a.alias("a"), b.alias("b"))
    return rows.select("c_custkey", *[x.alias(n) for n, x in c.multi_response({"Zulu": F.col("a"), "Alpha": F.col("b")}).items()])


@query("p20_bands", "select c_custkey, case when a < 45 then null when a < 55 then '45-54' when a < 65 then '55-64' when a < 75 then '65-74' else '75+' end as age_band, case when n >= 3 then '3+' else cast(n as varchar) end as count_band from (select c_custkey, c_acctbal / 100 as a, c_custkey % 5 as n from customer)")
def p20(spark, d):
    return table(spark, d, "customer").select("c_custkey", c.age_band(F.col("c_acctbal") / 100).alias("age_band"), c.count_band(F.col("c_custkey") % 5).alias("count_band"))


@query("p21_confusion_cells", "select cell, count(*) as n from (select case when quality = 1 and doc_id % 10 >= 5 then 'TP' when quality = 1 then 'FN' when quality = 0 and doc_id % 10 >= 5 then 'FP' when quality = 0 then 'TN' end as cell from labels) group by cell")
def p21(spark, d):
    rows = table(spark, d, "labels").select(c.confusion_cell(F.col("quality"), (F.col("doc_id") % 10) / 10.0).alias("cell"))
    return rows.groupBy("cell").agg(F.count("*").alias("n"))


@query(
    "p22_formula_audit",
    "with s as (select l_orderkey, l_linenumber, case when l_linenumber = 6 then null else l_extendedprice end as released, l_quantity * 900 * (1 + l_discount) as recomputed from lineitem) select l_orderkey, l_linenumber, round(released - recomputed, 4) as difference, case when released is null then 'released_missing' when abs(released - recomputed) <= 5000 then 'consistent' else 'review_difference' end as status, case when released is null then 'missing' when released between 0 and 50000 then 'within_range' else 'review_out_of_range' end as range_status from s",
)
def p22(spark, d):
    released = F.when(F.col("l_linenumber") != 6, F.col("l_extendedprice"))
    out = c.formula_audit(released, F.col("l_quantity") * 900 * (1 + F.col("l_discount")), 5000.0, 0.0, 50000.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(out["difference"], 4).alias("difference"), out["status"].alias("status"), out["range_status"].alias("range_status"))


@query(
    "p23_elapsed_audit",
    "select o_orderkey, case when o_orderkey % 5 = 0 then 'insufficient_age_data' when o_orderkey % 5 = 1 then 'review_age_decrease' when o_orderkey % 5 = 2 then 'age_available_date_proxy_missing' when o_orderkey % 5 = 3 then 'consistent_with_date_proxy' else 'review_age_date_difference' end as status from orders",
)
def p23(spark, d):
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    grown = F.when(k == 1, -1.0).when(k == 4, 5.0).otherwise(2.2)
    out = c.elapsed_audit(F.when(k != 0, 50.0), 50.0 + grown, day, F.when(k != 2, F.add_months(day, 24)))
    return table(spark, d, "orders").select("o_orderkey", out["status"].alias("status"))


@query(
    "p24_quality_gate",
    "select doc_id, cast(n_chars >= 400 and n_chars <= 6000 and lang != 'de' as boolean) as passed, concat_ws('|', case when n_chars < 400 then 'too_short' end, case when n_chars > 6000 then 'too_long' end, case when lang = 'de' then 'language' end) as reasons from documents",
)
def p24(spark, d):
    n = F.col("n_chars")
    ok, reasons = c.quality_gate({"too_short": n < 400, "too_long": n > 6000, "language": F.col("lang") == "de"})
    return table(spark, d, "documents").select("doc_id", ok.alias("passed"), reasons.alias("reasons"))


@query("p25_closed_flags", "select doc_id, quality = 1 and doc_id % 3 != 0 as passed from labels")
def p25(spark, d):
    flag = F.when(F.col("doc_id") % 3 == 0, None).when(F.col("quality") == 1, "Passed").otherwise("ungradable")
    return table(spark, d, "labels").select("doc_id", c.closed_flag(flag).alias("passed"))


@query("p26_json_payload", "select event_id, cast(json_extract_string(props, '$.k') as varchar) as k, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || cast(user_id as varchar) || '}' as payload from events")
def p26(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), c.json_text(F.col("event_type"), F.col("user_id")).alias("payload"))


@query("p27_null_safe", "select d.doc_id, cast(l.quality is not distinct from l.toxic as integer) as same, cast(l.quality is not null and l.toxic is not null as integer) as complete from documents d left join labels l using (doc_id)")
def p27(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return both.select("doc_id", c.same(F.col("quality"), F.col("toxic")).alias("same"), c.complete_case(F.col("quality"), F.col("toxic")).alias("complete"))


@query("p01_harmonize", "select cast(c_custkey as varchar) as participant_id, 'tracking' as cohort, cast(c_mktsegment as varchar) as segment, cast(c_nationkey as varchar) as nation, cast(null as varchar) as frailty from customer")
def p01(spark, d):
    manifest = {"segment": {"tracking": ["SEGMENT", "C_MKTSEGMENT"]}, "nation": {"tracking": ["c_nationkey"]}, "frailty": {"tracking": ["c_frailty"]}}
    return c.harmonize(table(spark, d, "customer"), "tracking", manifest, ["entity_id", "C_CUSTKEY"])[0]


@query("p02_project_visit", "select trim(cast(o_custkey as varchar)) as participant_id, 'BL' as visit, 'orders_v1' as source_release, cast(o_orderpriority as varchar) as priority, cast(null as varchar) as weight from orders")
def p02(spark, d):
    return c.project_visit(table(spark, d, "orders"), "BL", "orders_v1", {"priority": "o_orderpriority", "weight": "o_weight"}, "o_custkey")


@query("p03_normalized_names", "select s_suppkey as supplier_key, s_name as \"Supplier_Key_2\", s_nationkey as \"column\" from supplier")
def p03(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").toDF("supplier-key", " Supplier.Key ", "??")
    return c.normalized_names(s)


@query("p28_optional_columns", "select p_partkey, cast(p_size as varchar) as p_size, cast(null as varchar) as p_color from part")
def p28(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", c.optional(p, "p_size"), c.optional(p, "p_color"))


# scans and sets


@query("s10_semi_scan", "select o_orderkey, o_custkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def s10(spark, d):
    ids = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return readers.scan_for_ids(table(spark, d, "orders"), ids, "o_custkey", ["o_orderkey", "o_totalprice"])


@query(
    "s12_upsert",
    "with batch as (select doc_id, quality, 1 as toxic, cast(5 as bigint) as stamp from labels where doc_id % 3 = 0 union all select doc_id + 10000000, quality, toxic, 1 from labels where doc_id % 5 = 0) select coalesce(b.doc_id, l.doc_id) as doc_id, case when b.doc_id is null then l.quality else b.quality end as quality, case when b.doc_id is null then l.toxic else b.toxic end as toxic, b.stamp from labels l full join batch b on l.doc_id = b.doc_id",
)
def s12(spark, d):
    labels = table(spark, d, "labels")
    old = labels.filter("doc_id % 3 = 0").select("doc_id", "quality", F.lit(1).alias("toxic"), F.lit(5).cast("long").alias("stamp"))
    stale = labels.filter("doc_id % 3 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"), F.lit(2).cast("long").alias("stamp"))
    new = labels.filter("doc_id % 5 = 0").select(F.col("doc_id") + 10_000_000, "quality", "toxic", F.lit(1).cast("long")).toDF("doc_id", "quality", "toxic", "stamp")
    return readers.merged(labels, stale.unionByName(old).unionByName(new), ["doc_id"], "stamp")


@query("u02_union_missing", "select s_suppkey as id, s_name as name, s_acctbal as balance, cast(null as varchar) as segment from supplier union all select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def u02(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_name as name", "s_acctbal as balance")
    return s.unionByName(table(spark, d, "customer").selectExpr("c_custkey as id", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment"), allowMissingColumns=True)


@query("u03_distinct", "select distinct o_orderpriority, o_orderstatus from orders")
def u03(spark, d):
    return table(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@query("u04_set_difference", "select 'difference' as kind, count(*) as n from (select c_custkey from customer except select o_custkey from orders) union all select 'intersection', count(*) from (select c_custkey from customer intersect select o_custkey from orders)")
def u04(spark, d):
    a, b = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(a.subtract(b), "difference").unionByName(count(a.intersect(b), "intersection"))


# checks


@query("k01_duplicate_keys", "select o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n_rows from orders group by 1, 2 having count(*) > 1")
def k01(spark, d):
    return checks.duplicate_keys(table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), ["o_custkey", "day"])


LEDGER = "select doc_id % 300 as id, quality from labels"


@query(
    "k03_input_ledger",
    f"with r as ({LEDGER}), g as (select id, count(*) as n, count(distinct coalesce(cast(quality as varchar), '?')) as k from r where id >= 20 group by id) select 'rows_read' as metric, count(*) as value from r union all select 'invalid_ids', count(*) from r where id < 20 union all select 'exact_duplicates', cast(sum(n - k) as bigint) from g union all select 'conflicting_keys', count(*) from g where k > 1",
)
def k03(spark, d):
    return checks.input_ledger(table(spark, d, "labels").selectExpr("doc_id % 300 as id", "quality"), ["id"], F.col("id") >= 20)


@query("k04_conflicts", f"with r as ({LEDGER}) select id, quality from r where id in (select id from (select distinct id, quality from r) group by id having count(*) > 1)")
def k04(spark, d):
    return checks.conflicts(table(spark, d, "labels").selectExpr("doc_id % 300 as id", "quality"), ["id"])


@query("k05_vector_errors", "select count(*) as rows, count(*) filter (where embedding is null) as missing_vector, count(*) filter (where len(embedding) != 64) as wrong_length, cast(0 as bigint) as non_finite, cast(0 as bigint) as zero_norm, count(*) filter (where vec_id is null) as missing_key, count(*) - count(distinct vec_id) as duplicate_keys from embeddings")
def k05(spark, d):
    return checks.vector_errors(table(spark, d, "embeddings"), "embedding", 64, ["vec_id"])


@query("k06_signature", "select count(*) as rows, bit_xor(('0x' || substr(h, 1, 15))::bigint) as fold_a, bit_xor(('0x' || substr(h, 16, 15))::bigint) as fold_b from (select sha256(cast(c_custkey as varchar) || '|' || c_mktsegment) as h from customer)")
def k06(spark, d):
    return checks.signature(table(spark, d, "customer"), ["c_custkey", "c_mktsegment"])


@query("k07_invariance", "select l_orderkey, count(distinct l_linestatus) = 1 as l_linestatus_invariant, count(distinct l_returnflag) = 1 as l_returnflag_invariant from lineitem group by l_orderkey")
def k07(spark, d):
    return checks.invariance(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linestatus", "l_returnflag"])


@query(
    "k08_accounting",
    "with e as (select distinct doc_id from documents), d as (select distinct doc_id from labels where quality = 1), f as (select distinct doc_id from labels where toxic = 1 union select -1) select (select count(*) from e) as expected, (select count(*) from d) as done, (select count(*) from f) as failed, (select count(*) from e where doc_id not in (select doc_id from d) and doc_id not in (select doc_id from f)) as missing, cast(1 as bigint) as extra, (select count(*) from d where doc_id in (select doc_id from f)) as both",
)
def k08(spark, d):
    labels = table(spark, d, "labels")
    failed = labels.filter("toxic = 1").select("doc_id").unionByName(spark.range(1).selectExpr("cast(-1 as long) as doc_id"))
    return checks.accounting(table(spark, d, "documents"), labels.filter("quality = 1"), failed, ["doc_id"])


@query(
    "k09_batch_completeness",
    "with e as (select distinct doc_id // 100 as batch, doc_id from documents), o as (select doc_id // 100 as batch, doc_id, count(*) as n from labels group by all), j as (select coalesce(e.batch, o.batch) as batch, e.doc_id as a, o.doc_id as b, o.n from e full join o on e.batch = o.batch and e.doc_id = o.doc_id) select batch, count(a) as expected, count(b) as observed, count(*) filter (where a is not null and b is null) as missing, count(*) filter (where a is null) as unexpected, count(*) filter (where n > 1) as repeated, count(*) filter (where a is not null and b is null) = 0 and count(*) filter (where a is null) = 0 and count(*) filter (where n > 1) = 0 as complete from j group by batch",
)
def k09(spark, d):
    batch = F.floor(F.col("doc_id") / 100).alias("batch")
    return checks.batch_completeness(table(spark, d, "documents").select(batch, "doc_id"), table(spark, d, "labels").select(batch, "doc_id"), "batch", ["doc_id"])


@query(
    "k10_readiness",
    "with n as (select 'src' || cast(i as varchar) as name, i % 3 as part from range(0, 30) t(i)), f as (select distinct source as name from documents) select part, count(*) as n_needed, count(f.name) as n_present, coalesce(string_agg(n.name, '|' order by n.name) filter (where f.name is null), '') as missing, count(*) = count(f.name) as ready from n left join f using (name) group by part",
)
def k10(spark, d):
    needed = spark.range(30).selectExpr("concat('src', id) as name", "id % 3 as part")
    return checks.readiness(needed, table(spark, d, "documents").select(F.col("source").alias("name")), "name", "part")
