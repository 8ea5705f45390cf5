"""Queries of the join, aggregation, window, ordering and sampling families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as c
from ..operators import aggregate as a
from ..operators import link, quantiles, windows
from .registry import query, table

# flagship: a linked, gated, stratified cohort

FLAGSHIP_SQL = """
with linked as (select d.doc_id, d.lang, d.source, d.n_chars, case when l.doc_id is null then 'no_partner' when l.quality is null then 'value_missing' else 'matched' end as link_status, l.quality from documents d left join labels l using (doc_id)),
kept as (select * from linked where link_status = 'matched' and quality = 1),
long as (select 'lang' as stratifier, lang as level, cast(n_chars as double) as v from kept union all select 'source', source, cast(n_chars as double) from kept)
select stratifier, level, count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3, 'ok' as status from long where level is not null group by 1, 2
union all select 'region', null, 0, null, null, null, null, null, 'column_missing'
"""


@query("flagship_stratified_cohort", FLAGSHIP_SQL)
def flagship(spark, d):
    linked = link.left_with_status(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, d, "labels"), ["doc_id"], "quality")
    kept = linked.filter((F.col("link_status") == "matched") & c.closed_flag(F.col("quality")))
    out = a.stratified(kept, "n_chars", ["lang", "source", "region"])
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


# joins


@query("j01_inner_join", "select o_orderkey, c_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def j01(spark, d):
    return link.join_on(table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_mktsegment"), [("o_custkey", "c_custkey")]).select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "c_mktsegment")


@query("j02_link_status", "select case when l.doc_id is null then 'no_partner' when l.quality is null then 'value_missing' else 'matched' end as link_status, count(*) as n from documents d left join (select doc_id, case when doc_id % 7 = 0 then null else quality end as quality from labels) l using (doc_id) group by 1")
def j02(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("quality")).alias("quality"))
    return link.left_with_status(table(spark, d, "documents").select("doc_id"), labels, ["doc_id"], "quality").groupBy("link_status").agg(F.count("*").alias("n"))


@query("j03_anti_join", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def j03(spark, d):
    return link.without(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("j04_semi_join", "select doc_id, lang from documents where doc_id in (select doc_id from labels where toxic = 1)")
def j04(spark, d):
    return link.within(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").filter("toxic = 1"), ["doc_id"])


@query("j05_small_side_join", "select n_name, count(*) as n, round(sum(s_acctbal), 2) as balance from supplier join nation on s_nationkey = n_nationkey group by n_name")
def j05(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return s.join(link.small(table(spark, d, "nation")), "n_nationkey").groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("j07_validated_join", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 200000")
def j07(spark, d):
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return link.join_validated(table(spark, d, "orders").filter("o_totalprice > 200000"), cust, ["o_custkey"], "inner", "many_to_one").select("o_orderkey", "c_name")


@query("j08_fill_from", "select d.doc_id, coalesce(case when d.doc_id % 2 = 0 then 1 end, l.quality) as quality from documents d left join labels l using (doc_id)")
def j08(spark, d):
    base = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).alias("quality"))
    return link.fill_from(base, table(spark, d, "labels"), ["doc_id"], ["quality"])


@query("j09_refresh", "select s_suppkey, s_acctbal * 2 as score, s_name, s_nationkey from supplier")
def j09(spark, d):
    s = table(spark, d, "supplier")
    stale = s.select("s_suppkey", (F.col("s_acctbal") * 2).alias("score"), F.lit("old").alias("s_name"), F.lit(0).alias("s_nationkey"))
    return link.refresh(stale, s, "s_suppkey", ["s_name", "s_nationkey"])


@query("j10_baseline", "select conv_id, turn, role, length(text) as n, length(b.t) as baseline_n from conversations left join (select conv_id, text as t from conversations where turn = 0) b using (conv_id)")
def j10(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    return link.with_baseline(rows, ["conv_id"], "turn", 0, ["n"])


BAND = "select a.c_custkey as case_id, b.c_custkey as control_id, a.c_nationkey as nation, round(abs(a.c_acctbal - b.c_acctbal), 6) as distance from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = 'BUILDING' and b.c_mktsegment != 'BUILDING' and abs(a.c_acctbal - b.c_acctbal) <= 300"


@query("j11_band_join", BAND)
def j11(spark, d):
    cust = table(spark, d, "customer")
    left = cust.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("case_id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("nation"))
    right = cust.filter("c_mktsegment != 'BUILDING'").select(F.col("c_custkey").alias("control_id"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").alias("nation"))
    # distances are 300 at most, so whole millionths are exact; F.round would make a decimal of each pair
    millionths = F.floor(F.abs(F.col("x") - F.col("y")) * 1e6 + 0.5)
    return link.band_pairs(left, right, ("x", "y"), 300.0, ["nation"]).select("case_id", "control_id", "nation", (millionths / 1e6).alias("distance"))


NEAR = "select a.c_custkey, round(min(abs(a.c_acctbal - b.c_acctbal)), 6) as nearest_distance from customer a left join customer b on b.c_mktsegment != 'BUILDING' {on} where a.c_mktsegment = 'BUILDING' group by a.c_custkey"


@query("j12_nearest_distance", NEAR.format(on=""))
def j12(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    out = link.nearest_distance(cust.filter("c_mktsegment = 'BUILDING'"), cust.filter("c_mktsegment != 'BUILDING'"), ("c_acctbal", "c_acctbal"), bucket=250.0)
    return out.select("c_custkey", F.round("nearest_distance", 6).alias("nearest_distance"))


@query("j12_nearest_by_nation", NEAR.format(on="and a.c_nationkey = b.c_nationkey"))
def j12n(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    out = link.nearest_distance(cust.filter("c_mktsegment = 'BUILDING'"), cust.filter("c_mktsegment != 'BUILDING'"), ("c_acctbal", "c_acctbal"), ["c_nationkey"])
    return out.select("c_custkey", F.round("nearest_distance", 6).alias("nearest_distance"))


@query("j13_crosswalk", "select d.doc_id, case when d.doc_id % 4 != 0 then d.doc_id * 10 end as linked_id from documents d")
def j13(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return link.crosswalk(docs, docs.filter("doc_id % 4 != 0").select("doc_id", (F.col("doc_id") * 10).alias("linked_id")), "doc_id", "linked_id")


@query("j14_explode_children", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def j14(spark, d):
    nested = a.nest(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_quantity"])
    return link.explode_children(nested, "children", ["l_orderkey"])


@query("j15_exclusions", "select 'unparsed' as exclusion_reason, doc_id, null::varchar as lang from documents where doc_id % 11 = 0 union all select 'language', doc_id, lang from documents where lang = 'es' union all select 'unmatched', doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def j15(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return link.exclusions({"unparsed": docs.filter("doc_id % 11 = 0").select("doc_id"), "language": docs.filter("lang = 'es'"), "unmatched": link.without(docs, table(spark, d, "labels"), ["doc_id"])})


@query("j16_replay", "with p as (select l_orderkey, avg(l_quantity) as s from lineitem group by 1) select count(*) as n, 0.0::double as max_error from p")
def j16(spark, d):
    lines = table(spark, d, "lineitem")
    parent = lines.groupBy("l_orderkey").agg(F.avg("l_quantity").alias("score"))
    return link.replay_error(parent, lines, ["l_orderkey"], "score", "l_quantity").withColumn("max_error", F.round("max_error", 9))


# aggregations


@query("a01_group_counts", "select source, lang, count(*) as n, count(distinct n_chars) as sizes, avg(cast(n_chars as double)) as mean, cast(sum(n_chars) as bigint) as total from documents group by 1, 2")
def a01(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("n_chars").alias("sizes"), F.avg("n_chars").alias("mean"), F.sum("n_chars").alias("total"))


@query("a02_conditional_funnel", "select c_mktsegment, count(distinct o_custkey) as people, count(distinct case when o_totalprice > 100000 then o_custkey end) as large, count(*) filter (where o_orderstatus = 'F') as finished from orders join customer on o_custkey = c_custkey group by 1")
def a02(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count_distinct("o_custkey").alias("people"), F.count_distinct(F.when(F.col("o_totalprice") > 100000, F.col("o_custkey"))).alias("large"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


QC = "case when l_linenumber = 7 then '-99999' when l_linenumber = 6 then 'n/a' else cast({} as string) end"


@query(
    "a03_variable_qc",
    "with r as (select 'line' as variable, {0} as raw from lineitem union all select 'part', {1} from lineitem), x as (select variable, raw, raw in ('-99999') as coded, try_cast(case when raw != '-99999' then raw end as double) as v from r) select variable, count(*) as n_rows, count(v) as n_nonnull, count(*) filter (where coded) as n_recognized_missing, count(*) filter (where not coded and v is null) as n_unparsed, min(v) as min, max(v) as max, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd from x group by variable".format(QC.format("l_linenumber"), QC.format("l_partkey")),
)
def a03(spark, d):
    rows = table(spark, d, "lineitem").select(F.expr(QC.format("l_linenumber")).alias("line"), F.expr(QC.format("l_partkey")).alias("part"))
    names = ("line", "part")
    out = a.variable_qc(rows, {n: F.col(n) for n in names}, {n: c.clean_numeric(F.col(n)) for n in names})
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("a04_pivot_first", "select o_custkey, arg_min(o_totalprice, o_orderkey) filter (where o_orderstatus = 'F') as \"o_totalprice_F\", arg_min(o_totalprice, o_orderkey) filter (where o_orderstatus = 'O') as \"o_totalprice_O\" from orders group by 1")
def a04(spark, d):
    return a.pivot_first(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O"], ["o_totalprice"], "o_orderkey")


@query("a05_nested_children", "select o_custkey, count(*) as n_children, list_sort(list(distinct o_orderstatus)) as o_orderstatus_set from orders group by 1")
def a05(spark, d):
    return a.nest(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], ["o_orderstatus"]).drop("children")


@query(
    "a06_release_summary",
    "with m as (select source as release, case when lang = 'de' then 'other' else 'fundus_image' end as k, n_chars as b, n_chars + 100 as s, doc_id % 50 as who, doc_id % 3 as eye from documents), p as (select release, who, count(distinct eye) as e from m group by 1, 2), q as (select release, count(*) as n_people, count(*) filter (where e >= 2) as n_complete_pairs from p group by 1) select release, count(*) as n_members, cast(sum(b) as bigint) as bytes, cast(sum(s) as bigint) as stored_bytes, count(*) filter (where k = 'fundus_image') as n_images, any_value(n_people) as n_people, any_value(n_complete_pairs) as n_complete_pairs, sum(b) / sum(s) as expansion from m join q using (release) group by release",
)
def a06(spark, d):
    m = table(spark, d, "documents").select(F.col("source").alias("release"), F.when(F.col("lang") == "de", "other").otherwise("fundus_image").alias("k"), F.col("n_chars").alias("b"), (F.col("n_chars") + 100).alias("s"), (F.col("doc_id") % 50).alias("who"), (F.col("doc_id") % 3).alias("eye"))
    return a.release_summary(m, "release", "k", ("s", "b"), "who", "eye")


VEC = "with x as (select vec_id % 50 as who, unnest(embedding)::double as v, unnest(range(1, 65)) as k from embeddings), m as (select who, k, avg(v) as v from x group by 1, 2), g as (select who, list(round(v, 6) order by k) as embedding from m group by who) "


@query("a07_pool_vectors", VEC + "select g.who, g.embedding, c.n_vectors from g join (select vec_id % 50 as who, count(*) as n_vectors from embeddings group by 1) c using (who)")
def a07(spark, d):
    e = table(spark, d, "embeddings").withColumn("who", F.col("vec_id") % 50)
    return a.pool_vectors(e, ["who"], "embedding").select("who", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"), "n_vectors")


@query("a08_merge_partial_pools", VEC + "select g.who, g.embedding, c.n_vectors from g join (select vec_id % 50 as who, count(*) as n_vectors from embeddings group by 1) c using (who)")
def a08(spark, d):
    e = table(spark, d, "embeddings").withColumns({"who": F.col("vec_id") % 50, "batch": F.col("vec_id") % 7})
    parts = a.vector_parts(e, ["who", "batch"], "embedding")
    return a.merge_parts(parts, ["who"], "embedding").select("who", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"), "n_vectors")


@query("a09_pool_participants", "with m as (select o_custkey, o_orderpriority, count(*) as k from orders group by 1, 2), t as (select o_custkey, arg_min(o_orderpriority, (-k, o_orderpriority)) as o_orderpriority from m group by 1) select o.o_custkey, quantile_cont(cast(extract(year from o_orderdate) as double), 0.5) as age, round(avg(o_totalprice), 6) as prediction, count(*) as n_rows, round(max(o_totalprice) - min(o_totalprice), 4) as prediction_range, any_value(t.o_orderpriority) as o_orderpriority from orders o join t using (o_custkey) group by 1")
def a09(spark, d):
    o = table(spark, d, "orders").withColumn("age", F.year("o_orderdate").cast("double"))
    out = a.pool_participants(o, ["o_custkey"], "age", "o_totalprice", ["o_orderpriority"])
    return out.withColumns({"prediction": F.round("prediction", 6), "prediction_range": F.round("prediction_range", 4)})


@query("a10_prediction_rollup", "select l_orderkey, count(*) as n, round(avg(l_quantity), 6) as mean, quantile_cont(l_quantity, 0.5) as median, min(l_quantity) as min, max(l_quantity) as max, max(l_quantity) - min(l_quantity) as range from lineitem group by 1")
def a10(spark, d):
    return a.rollup_predictions(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity").withColumn("mean", F.round("mean", 6))


@query("a11_exact_quantiles", "select lang, quantile_cont(n_chars, 0.25) as q1, quantile_cont(n_chars, 0.5) as median, quantile_cont(n_chars, 0.75) as q3, round(quantile_cont(n_chars, 0.9), 6) as p90 from documents group by 1")
def a11(spark, d):
    return quantiles.exact(table(spark, d, "documents"), ["lang"], a.quartiles("n_chars") | {"p90": ("n_chars", 0.9)}).withColumn("p90", F.round("p90", 6))


# the rank of each value that a sketch gives is within 2 % of what was asked for
@query("a11_approximate_quantiles", "with n as (select lang, count(n_chars) as n from documents group by lang) select lang, n, name, true as near from n, (select unnest(['q1', 'median', 'q3', 'p99']) as name)")
def a11a(spark, d):
    docs, shares = table(spark, d, "documents"), {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    parts = quantiles.sketch(docs, ["lang", "source"], "n_chars")
    found = quantiles.approximate(quantiles.merged(parts, ["lang"]), ["lang"], shares)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("share"), F.col(n).alias("value")) for n, q in shares.items()])).alias("x")
    long = found.select("lang", "n", cells).select("lang", "n", "x.*")
    c = F.col("n_chars")
    ranks = docs.join(F.broadcast(long), "lang").groupBy("lang", "n", "name", "share").agg((F.count_if(c < F.col("value")) / F.col("n")).alias("low"), (F.count_if(c <= F.col("value")) / F.col("n")).alias("high"))
    return ranks.select("lang", "n", "name", ((F.col("low") <= F.col("share") + 0.02) & (F.col("high") >= F.col("share") - 0.02)).alias("near"))


@query("a12_stratified_summary", "with r as (select o_totalprice as v, o_orderstatus as a, o_orderpriority as b from orders), l as (select 'o_orderstatus' as stratifier, a as level, v from r union all select 'o_orderpriority', b, v from r) select stratifier, level, count(*) as n, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as sd, round(quantile_cont(v, 0.25), 4) as q1, round(quantile_cont(v, 0.5), 4) as median, round(quantile_cont(v, 0.75), 4) as q3, 'ok' as status from l group by 1, 2 union all select 'o_clinic', null, 0, null, null, null, null, null, 'column_missing'")
def a12(spark, d):
    out = a.stratified(table(spark, d, "orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority", "o_clinic"])
    return out.withColumns({x: F.round(x, 4) for x in ("mean", "sd", "q1", "median", "q3")})


@query("a13_group_descriptives", "with base as (select c_nationkey % 2 as g, c_acctbal, c_mktsegment from customer), n as (select g, c_mktsegment as level, count(*) as n from base group by 1, 2) select g, 'c_acctbal' as variable, count(*) as n, round(avg(c_acctbal), 4) as mean, round(stddev_samp(c_acctbal), 4) as sd, round(quantile_cont(c_acctbal, 0.25), 4) as q1, round(quantile_cont(c_acctbal, 0.5), 4) as median, round(quantile_cont(c_acctbal, 0.75), 4) as q3, null::varchar as level, null::double as fraction from base group by g union all select g, 'c_mktsegment', n, null, null, null, null, null, level, round(n / sum(n) over (partition by g), 6) from n")
def a13(spark, d):
    out = a.describe_groups(table(spark, d, "customer").withColumn("g", F.col("c_nationkey") % 2), "g", ["c_acctbal"], ["c_mktsegment"])
    return out.withColumns({x: F.round(x, 6 if x == "fraction" else 4) for x in ("mean", "sd", "q1", "median", "q3", "fraction")})


@query("a14_missingness", "with j as (select d.lang, l.quality, case when d.n_chars > 1000 then l.toxic end as toxic from documents d left join labels l using (doc_id)) select lang, 'quality' as variable, count(*) as n, count(*) - count(quality) as n_missing, (count(*) - count(quality)) / count(*) as fraction_missing from j group by lang union all select lang, 'toxic', count(*), count(*) - count(toxic), (count(*) - count(toxic)) / count(*) from j group by lang")
def a14(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("toxic", F.when(F.col("n_chars") > 1000, F.col("toxic")))
    return a.missingness(j, "lang", ["quality", "toxic"])


@query("a15_contingency", "select quality, toxic, count(*) as n from labels where quality is not null and toxic is not null group by 1, 2")
def a15(spark, d):
    return a.contingency(table(spark, d, "labels"), "quality", "toxic")


@query("a16_cohort_flow", "select 0 as stage_index, 'all' as stage, count(*) as n_rows, count(distinct o_custkey) as n_people from orders union all select 1, 'finished', count(*), count(distinct o_custkey) from orders where o_orderstatus = 'F' union all select 2, 'large', count(*), count(distinct o_custkey) from orders where o_orderstatus = 'F' and o_totalprice > 150000")
def a16(spark, d):
    return a.cohort_flow(table(spark, d, "orders"), {"all": F.lit(True), "finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 150000}, "o_custkey")


@query("a17_small_cells", "with c as (select n_name as g, count(*) as n from supplier join nation on s_nationkey = n_nationkey group by 1), f as (select case when n < 4 then 'suppressed' else g end as g, n from c) select g, cast(sum(n) as bigint) as n, count(*) as n_groups, sum(n) >= 4 as reportable from f group by g")
def a17(spark, d):
    counts = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("g")).agg(F.count("*").alias("n"))
    return a.suppress_small(counts, "g", "n", 4)


@query("a18_missing_codes", "select distinct p_brand as variable, p_size as code, p_type as label from part where p_size % 2 = 1")
def a18(spark, d):
    cats = table(spark, d, "part").select(F.col("p_brand").alias("variable"), F.col("p_size").alias("code"), F.col("p_type").alias("label"), F.when(F.col("p_size") % 2 == 1, " 1.0").otherwise("0").alias("missing"))
    return a.missing_code_map(cats, "variable", "code", "label", "missing")


SHIFT = "with x as (select label % 2 as dom, unnest(embedding)::double as v, unnest(range(1, 65)) as k from embeddings), m as (select k, avg(v) filter (where dom = 0) as m0, avg(v) filter (where dom = 1) as m1, var_samp(v) filter (where dom = 0) as v0, var_samp(v) filter (where dom = 1) as v1 from x group by k), s as (select *, abs((m1 - m0) / sqrt((v0 + v1) / 2)) as smd from m) select count(*) as n_features, round(quantile_cont(smd, 0.5), 6) as median_abs_smd, round(quantile_cont(smd, 0.9), 6) as p90_abs_smd, count(*) filter (where smd > 0.1) as n_above_0_1, count(*) filter (where smd > 0.2) as n_above_0_2, count(*) filter (where smd > 0.5) as n_above_0_5, round(sum(m0 * m1) / sqrt(sum(m0 * m0) * sum(m1 * m1)), 6) as centroid_cosine from s"


@query("a19_vector_shift", SHIFT)
def a19(spark, d):
    out = a.vector_shift(table(spark, d, "embeddings").withColumn("dom", F.col("label") % 2), "dom", "embedding")
    return out.withColumns({x: F.round(x, 6) for x in ("median_abs_smd", "p90_abs_smd", "centroid_cosine")})


@query("a21_overlap", "with a as (select doc_id from documents where n_chars > 1500), b as (select doc_id from labels where quality = 1), j as (select a.doc_id as x, b.doc_id as y from a full join b on a.doc_id = b.doc_id) select count(x) as n_a, count(y) as n_b, count(*) filter (where x is not null and y is not null) as n_both, count(*) as n_union, count(*) filter (where x is not null and y is not null) / count(*) as jaccard from j")
def a21(spark, d):
    return a.overlap(table(spark, d, "documents").filter("n_chars > 1500"), table(spark, d, "labels").filter("quality = 1"), "doc_id")


@query("a21_assignment_agreement", "select count(*) as n_both, count(*) filter (where cast(n_chars > 1500 as int) = quality) as n_agree, count(*) filter (where cast(n_chars > 1500 as int) = quality) / count(*) as agreement from documents join labels using (doc_id)")
def a21b(spark, d):
    left = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("x"))
    return a.assignment_agreement(left, table(spark, d, "labels").select("doc_id", F.col("quality").alias("x")), "doc_id", "x")


# windows, order and samples


@query("w01_representative_visit", "with v as (select o_custkey, o_orderpriority as visit, count(*) as n from orders group by 1, 2) select o_custkey, visit, n from v qualify row_number() over (partition by o_custkey order by case visit when '2-HIGH' then 0 when '5-LOW' then 1 else 2 end, n desc, visit) = 1")
def w01(spark, d):
    v = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("visit")).agg(F.count("*").alias("n"))
    return windows.representative_visit(v, "o_custkey", "visit", "n", ["2-HIGH", "5-LOW"])


@query("w02_closest_to_mean", "with m as (select l_orderkey, l_linenumber, l_quantity, avg(l_quantity) over (partition by l_orderkey) as m from lineitem) select l_orderkey, l_linenumber, l_quantity from m qualify row_number() over (partition by l_orderkey order by round(abs(l_quantity - m), 6), l_quantity, l_linenumber) = 1")
def w02(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    mean = windows.group_mean(rows, ["l_orderkey"], "l_quantity", "m")
    return windows.pick(mean, ["l_orderkey"], [F.round(F.abs(F.col("l_quantity") - F.col("m")), 6), F.col("l_quantity"), F.col("l_linenumber")]).drop("m")


@query("w04_top_k", "select l_orderkey, l_linenumber, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) <= 2")
def w04(spark, d):
    return windows.pick(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 2)


@query("w05_keep_last", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def w05(spark, d):
    return windows.keep_last(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("w06_seeded_pick", "select source, doc_id from documents qualify row_number() over (partition by source order by sha256('7|' || cast(doc_id as varchar)), doc_id) <= 3")
def w06(spark, d):
    return windows.seeded_pick(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 7, 3)


@query("t04_balanced_sample", "with r as (select doc_id, toxic, row_number() over (partition by toxic order by ('0x' || substr(md5('5|' || cast(doc_id as varchar)), 1, 8))::bigint, doc_id) as k from labels where toxic is not null), m as (select min(n) as n from (select count(*) as n from labels where toxic is not null group by toxic)) select doc_id, toxic from r, m where k <= n")
def t04(spark, d):
    return windows.balanced_sample(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 5)


@query("w08_tails", "with r as (select c_custkey, c_acctbal, row_number() over (order by c_acctbal, c_custkey) as k, count(*) over () as n from customer) select c_custkey, c_acctbal, case when k <= ceil(n * 0.1) then 'bottom' else 'top' end as tail from r where k <= ceil(n * 0.1) or k > n - ceil(n * 0.1)")
def w08(spark, d):
    return windows.tails(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 0.1)


@query("w09_quantile_extremes", "with q as (select c_mktsegment, quantile_cont(c_acctbal, 0.1) as lo, quantile_cont(c_acctbal, 0.9) as hi from customer group by 1) select c_custkey, c_mktsegment, case when c_acctbal <= lo then 'bottom' else 'top' end as extreme from customer join q using (c_mktsegment) where c_acctbal <= lo or c_acctbal >= hi")
def w09(spark, d):
    return windows.quantile_extremes(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal").select("c_custkey", "c_mktsegment", "extreme")


@query("w10_evenly_spaced", "with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as k, count(*) over (partition by o_custkey) as n from orders) select o_custkey, o_orderkey from r where n <= 4 or k in (0, round_even((n - 1) / 3, 0), round_even(2 * (n - 1) / 3, 0), n - 1)")
def w10(spark, d):
    return windows.evenly_spaced(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)


@query("w11_average_ranks", "with r as (select p_partkey, p_size, rank() over (order by p_size) as r, count(*) over (partition by p_size) as t from part) select p_partkey, r + (t - 1) / 2 as avg_rank, t as n_tied from r")
def w11(spark, d):
    return windows.average_rank(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "avg_rank").drop("p_size")


@query("w13_contiguity", "with r as (select o_custkey, count(*) as n from orders group by 1), s as (select o_custkey % 40 as g, n, coalesce(sum(n) over (partition by o_custkey % 40 order by o_custkey rows between unbounded preceding and 1 preceding), 0) as start from r) select g, count(*) as n_intervals, true as contiguous, cast(sum(n) as bigint) as covered_to from s group by g")
def w13(spark, d):
    from pyspark.sql import Window

    r = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("g", F.col("o_custkey") % 40)
    w = Window.partitionBy("g").orderBy("o_custkey")
    s = r.withColumn("stop", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("n"))
    return windows.contiguous(s, ["g"], "start", "stop")


@query("t01_ordered_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def t01(spark, d):
    return windows.top_by(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 50, "o_orderkey")


@query("t06_top_k_jaccard", "with x as (select label as model, k as position, avg(v) as coefficient from (select label, unnest(embedding)::double as v, unnest(range(0, 64)) as k from embeddings) group by 1, 2), t as (select model, position from x qualify row_number() over (partition by model order by round(abs(coefficient), 9) desc, position) <= 8) select a.model as model_a, b.model as model_b, count(*) as n_shared, count(*) / (16 - count(*)) as jaccard from t a join t b using (position) where a.model < b.model group by 1, 2")
def t06(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("model"), F.posexplode("embedding").alias("position", "v"))
    heads = e.groupBy("model", F.col("position").cast("long").alias("position")).agg(F.round(F.avg("v"), 9).alias("coefficient"))
    return windows.top_k_jaccard(heads, "model", "position", "coefficient", 8)


@query("t07_fixed_batches", "select source, doc_id, cast((row_number() over (partition by source order by doc_id) - 1) // 7 as bigint) as batch_index from documents")
def t07(spark, d):
    return windows.fixed_batches(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 7)
