"""Further queries: one for each operator of the inventory that the other modules don't show alone."""

from __future__ import annotations

import os
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import clean as c
from ..operators import aggregate, checks, link, maps, matching, models, stats, windows
from ..sources import readers
from ..sources.shared import new_folder
from ..streaming import handoff
from . import repeat
from .inference import PRED, _rounded, _row, predictions, vectors
from .registry import query, table


# sources and sinks


@query("s01_written_inventory", "select lang, '.parquet' as extension, count(distinct source) as n_files, true as known_size from documents where lang is not null group by 1")
def s01(spark, d):
    path = new_folder(spark, "out")
    # a file for each language and source
    table(spark, d, "documents").filter("lang is not null").select("doc_id", "lang", "source").repartition("lang", "source").write.partitionBy("lang", "source").parquet(path)
    found = readers.file_inventory(spark, path).filter("extension = '.parquet'")
    return found.groupBy(F.regexp_extract("relative_path", "lang=(..)/", 1).alias("lang"), "extension").agg(F.count("*").alias("n_files"), (F.min("bytes") > 0).alias("known_size"))


@query("s04_release_round_trip", "select cast(c_custkey as varchar) as c_custkey, c_name || chr(10) || 'line \"two\", end' as note from customer")
def s04(spark, d):
    path = new_folder(spark, "out")
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit('\nline "two", end')).alias("note"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return readers.read_release(spark, path)


@query("s06_header_profile", "select distinct ',' as delimiter, 3::integer as n_columns, '[\"c_custkey\",\"c_name\",\"c_nationkey\"]' as columns_json, cast(null as varchar) as error from customer")
def s06(spark, d):
    path = new_folder(spark, "out")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").write.option("header", True).csv(path)
    return readers.header_profile(spark, path).drop("path").distinct()


@query("s08_drifting_batches", "select doc_id, cast(n_chars as double) as n_chars, cast(null as varchar) as eye from documents")
def s08(spark, d):
    path = new_folder(spark, "out")
    docs = table(spark, d, "documents")
    docs.filter("doc_id % 2 = 0").select("doc_id", "n_chars").write.parquet(f"{path}/batch=0")
    docs.filter("doc_id % 2 = 1").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "lang").write.parquet(f"{path}/batch=1")
    return readers.read_batches(spark, f"{path}/*/*.parquet", "doc_id long, n_chars double, eye string", ["doc_id"])


@query("s09_first_source", "select o_orderkey, 'consolidated' as mode from orders")
def s09(spark, d):
    df, _, mode = readers.first_source(spark, [("consolidated", f"{d}/no_such_table.parquet"), ("consolidated", f"{d}/orders.parquet")])
    return df.select("o_orderkey", F.lit(mode).alias("mode"))


@query("s11_partitioned_write", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def s11(spark, d):
    path = new_folder(spark, "out")
    readers.write_partitioned(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return spark.read.parquet(path).filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@query("s13_schema_evolution", "select r_regionkey, r_name, cast(null as double) as weight from region")
def s13(spark, d):
    return readers.with_column(readers.with_column(table(spark, d, "region"), "weight", "double"), "r_name", "string")


# projections and joins


@query("p12_prioritized_proxy", "select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then o_totalprice end, case when o_orderkey % 2 = 0 then 1.5 end) as proxy, case when o_orderkey % 3 = 0 then 'price' when o_orderkey % 2 = 0 then 'flat' else 'unavailable' end as source from orders")
def p12(spark, d):
    k = F.col("o_orderkey")
    value, label = c.first_known({"price": F.when(k % 3 == 0, F.col("o_totalprice")), "flat": F.when(k % 2 == 0, F.lit(1.5))})
    return table(spark, d, "orders").select("o_orderkey", value.alias("proxy"), label.alias("source"))


@query("p24_image_quality", "with i as (select vec_id, abs(embedding[1])::double * 1000 as b, abs(embedding[2])::double as f from embeddings) select vec_id, b >= 10 and b <= 245 and f >= 0.01 as passed, concat_ws('|', case when f < 0.01 then 'retina_fraction_below_minimum' end, case when b < 10 then 'too_dark' end, case when b > 245 then 'too_bright' end) as reasons from i")
def p24(spark, d):
    e = table(spark, d, "embeddings")
    measures = {m: F.lit(100.0) for m in ("min_dimension", "contrast_std", "gradient_energy")} | {"dark_fraction": F.lit(0.0), "bright_fraction": F.lit(0.0), "min_dimension": F.lit(512.0)}
    measures |= {"brightness_mean": F.abs(F.col("embedding")[0]).cast("double") * 1000, "retina_fraction": F.abs(F.col("embedding")[1]).cast("double")}
    ok, reasons = c.image_quality(measures)
    return e.select("vec_id", ok.alias("passed"), reasons.alias("reasons"))


@query("j06_composite_join", "select l_orderkey, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey and l_linestatus = o_orderstatus")
def j06(spark, d):
    out = link.join_on(table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), [("l_orderkey", "o_orderkey"), ("l_linestatus", "o_orderstatus")])
    return out.select("l_orderkey", "l_linenumber", "o_custkey")


@query("k02_required_values", "select s_suppkey, s_acctbal from supplier")
def k02(spark, d):
    s = checks.require_columns(table(spark, d, "supplier"), ["s_suppkey", "s_acctbal"])
    return checks.require_values(s, {"key": F.col("s_suppkey") >= 0, "balance": F.col("s_acctbal").isNotNull()}).select("s_suppkey", "s_acctbal")


# windows, samples, summaries


@query("w03_first_per_set", "select o_custkey % 10 as set_id, o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey % 10, o_custkey order by case o_orderstatus when 'O' then 0 when 'F' then 1 else 2 end, o_orderkey) = 1")
def w03(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("set_id"), "o_custkey", "o_orderkey", "o_orderstatus")
    return windows.pick(o, ["set_id", "o_custkey"], [windows.priority(F.col("o_orderstatus"), ["O", "F"]), F.col("o_orderkey")]).drop("o_orderstatus")


@query("w07_group_mean", "select p_partkey, p_brand, round(avg(p_retailprice) over (partition by p_brand), 6) as brand_mean from part")
def w07(spark, d):
    return windows.group_mean(table(spark, d, "part"), ["p_brand"], "p_retailprice", "m").select("p_partkey", "p_brand", F.round("m", 6).alias("brand_mean"))


@query("w12_running_min", "select s_suppkey, s_nationkey, min(s_acctbal) over (partition by s_nationkey order by s_suppkey desc rows between unbounded preceding and current row) as least from supplier")
def w12(spark, d):
    return windows.running_min_from_end(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], "s_suppkey", "s_acctbal", "least").drop("s_acctbal")


@query("t02_top_with_fallback", "select doc_id, quality, toxic from (select doc_id, case when doc_id % 4 = 0 then null else quality end as quality, toxic from labels) order by coalesce(quality, toxic) desc nulls last, doc_id limit 20")
def t02(spark, d):
    rows = table(spark, d, "labels").withColumn("quality", F.when(F.col("doc_id") % 4 != 0, F.col("quality")))
    return windows.top_by(rows, ["quality", "toxic"], 20, "doc_id")


@query("t03_sample_per_group", "select lang, doc_id from documents qualify row_number() over (partition by lang order by sha256('cap|' || cast(doc_id as varchar)), doc_id) <= 25")
def t03(spark, d):
    return windows.seeded_pick(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], "doc_id", "cap", 25)


@query("a20_model_fold_metrics", "with p as (select 'm' || (doc_id % 2) as model, doc_id % 3 as fold, quality as y, (doc_id % 10) / 10.0 as s from labels where quality in (0, 1)), q as (select model, cast(fold as varchar) as fold, y, s from p union all select model, 'pooled', y, s from p), r as (select *, rank() over (partition by model, fold order by s) + (count(*) over (partition by model, fold, s) - 1) / 2 as r from q) select model, fold, count(*) as n, round((sum(r) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2) / nullif(count(*) filter (where y = 1) * count(*) filter (where y = 0), 0), 6) as auroc from r group by 1, 2")
def a20(spark, d):
    p = table(spark, d, "labels").filter("quality in (0, 1)").select(F.concat(F.lit("m"), F.col("doc_id") % 2).alias("model"), (F.col("doc_id") % 3).cast("string").alias("fold"), "quality", ((F.col("doc_id") % 10) / 10.0).alias("s"))
    both = p.unionByName(p.withColumn("fold", F.lit("pooled")))
    return _rounded(stats.discrimination(both, "quality", "s", ["model", "fold"]).select("model", "fold", "n", "auroc"))


@query("q26_covariate_rule", "with s as (select quality, count(lang) / count(*) as seen, list(distinct lang) as levels from documents join labels using (doc_id) where quality in (0, 1) group by 1) select count(*) = 2 and min(seen) >= 0.8 and (select count(*) from (select unnest(levels) from s where quality = 0 intersect select unnest(levels) from s where quality = 1)) >= 2 as usable from s")
def q26(spark, d):
    return _row(spark, {"usable": bool(stats.covariate_available(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "quality", "lang"))})


@query("q25_bland_altman", PRED + "select round(avg(truth - prediction), 3) as bias, round(avg(truth - prediction) - 1.96 * stddev_samp(truth - prediction), 3) as limit_low, round(avg(truth - prediction) + 1.96 * stddev_samp(truth - prediction), 3) as limit_high from p")
def q25(spark, d):
    return _rounded(stats.agreement(predictions(spark, d), "truth", "prediction").select("bias", "limit_low", "limit_high"), 3)


# heads and maps


@query("l03_folded_calibration", "with h as (select unnest(range(0, 64)) as k), s as (select vec_id, sum(v * (k % 5 - 2)) + 3 as p, any_value(label) as y from (select vec_id, label, unnest(embedding)::double as v, unnest(range(0, 64)) as k from embeddings) group by 1), c as (select avg(y) as my, avg(p) as mp, regr_slope(p, y) as b from s) select vec_id, round(my + (p - mp) / case when abs(0.5 * b + 0.5) < 0.2 then case when 0.5 * b + 0.5 < 0 then -0.2 else 0.2 end else 0.5 * b + 0.5 end, 6) as prediction from s, c")
def l03(spark, d):
    e = table(spark, d, "embeddings")
    head = models.heads_frame(spark, [("fixed", -1, [float(k % 5 - 2) for k in range(64)], 3.0)])
    plain = models.apply_head(e, head, "embedding")
    fit = models.calibration(plain.withColumn("y", F.col("label").cast("double")), "y", "prediction")
    return _rounded(models.apply_head(e, models.fold_in(head, fit, "shrunk_slope"), "embedding").select("vec_id", "prediction"))


@query("l10_cross_head")
def l10(spark, d):
    dealt = models.folds(vectors(spark, d), "vec_id", 4, 3)
    own, heads = models.ridge_oof(dealt, "embedding", "age", "fold", 64)
    other = heads.filter("fold = 0")
    return _rounded(models.evaluate_across(own, "embedding", "age", "prediction", other), 4)


@query("l08_crossfit_harmonizer")
def l08(spark, d):
    rows = vectors(spark, d).withColumns({"site": F.when(F.col("vec_id") % 3 == 0, "b").otherwise("a"), "y": F.col("label") % 2, "sex": F.when(F.col("vec_id") % 5 < 2, "F").otherwise("M")})
    dealt = models.folds(rows, "vec_id", 3, 1, "site")
    done = models.harmonize_crossfit(dealt, "fold", "embedding", "site", "a", age="age", sex="sex", label="y", dim=64)
    return done.select("vec_id", "fold", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding"))


@query("l14_set_maps", "with g as (select vec_id % 25 as set_id, label % 2 as cohort, cast(k // 8 as integer) as row, cast(k % 8 as integer) as col, v from (select vec_id, label, unnest(embedding)::double as v, unnest(range(0, 64)) as k from embeddings)), w as (select set_id from g group by 1 having count(distinct cohort) = 2) select set_id, cohort, row, col, round(avg(v), 6) as value from g where set_id in (select set_id from w) group by all")
def l14(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 25).alias("set_id"), (F.col("label") % 2).alias("cohort"), "embedding")
    grid = maps.grid_long(e, ["set_id", "cohort"], "embedding", 8).withColumn("value", F.col("value").cast("double"))
    return _rounded(maps.set_maps(grid, "set_id", "cohort"))


@query("l16_masks", "with c as (select vec_id as image, (label % 5)::double as cy, 3.0::double as cx from embeddings), g as (select image, r.r::integer as row, k.k::integer as col, sqrt((r.r - cy) ** 2 + (k.k - cx) ** 2) as d from c, range(0, 8) r(r), range(0, 8) k(k)) select image, case when d <= 1.5 then 'disc' else 'annulus' end as region, row, col from g where d <= 3")
def l16(spark, d):
    centers = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), (F.col("label") % 5).cast("double").alias("cy"), F.lit(3.0).alias("cx"))
    return maps.circular_masks(centers, 8, 8, F.lit(1.5), F.lit(3.0))


@query("l15_pixel_rank_correlation", "with g as (select vec_id as image, v, k from (select vec_id, unnest(embedding)::double as v, unnest(range(0, 64)) as k from embeddings)), r as (select image, rank() over (partition by image order by v) + (count(*) over (partition by image, v) - 1) / 2 as rx, rank() over (partition by image order by k % 9) + (count(*) over (partition by image, k % 9) - 1) / 2 as ry from g) select image, count(*) as n, round(corr(rx, ry), 6) as spearman from r group by 1")
def l15p(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), "embedding")
    grid = maps.grid_long(e, ["image"], "embedding", 8).withColumn("value", F.col("value").cast("double"))
    pixels = grid.withColumn("covariate", (F.col("row") * 8 + F.col("col")) % 9)
    return _rounded(maps.pixel_rank_correlation(grid, pixels, "covariate"))


# batches


@query("r02_complete_batches", "with r as (select doc_id, doc_id // 100 as b from documents where doc_id % 250 != 7) select 'batch_' || lpad(cast(b * 100 as varchar), 9, '0') || '_' || lpad(cast((b + 1) * 100 as varchar), 9, '0') as batch, b * 100 as start, (b + 1) * 100 as stop, count(*) as n_rows, count(*) = 100 as complete from r group by b")
def r02(spark, d):
    b = F.floor(F.col("doc_id") / 100)
    name = F.format_string("batch_%09d_%09d", b * 100, (b + 1) * 100)
    rows = table(spark, d, "documents").filter("doc_id % 250 != 7").select("doc_id", name.alias("batch"))
    return handoff.complete_batches(rows, "doc_id", ["doc_id"])


@query("r03_unchanged_inputs", "select distinct source, cast(n_chars % 2 as bigint) as bytes from documents where (source, n_chars % 2) in (select source, n_chars % 2 from documents where doc_id % 3 = 0)")
def r03(spark, d):
    docs = table(spark, d, "documents").select("source", (F.col("n_chars") % 2).alias("bytes"), "doc_id")
    return handoff.unchanged(docs.select("source", "bytes").distinct(), docs.filter("doc_id % 3 = 0"), ["source", "bytes"])


@query("s15_release_counts", "select source as release, count(*) as n_members from documents group by 1")
def s15(spark, d):
    return aggregate.release_summary(table(spark, d, "documents").select(F.col("source").alias("release"), F.lit("other").alias("k"), "n_chars", F.lit(1).alias("who"), F.lit("L").alias("eye")), "release", "k", ("n_chars", "n_chars"), "who", "eye").select("release", "n_members")


# readers over files that these queries write from the tables


@query("s02_discovered_paths", "select distinct lang from documents where lang in ('en', 'de')")
def s02(spark, d):
    path = new_folder(spark, "out")
    table(spark, d, "documents").select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    found = readers.discover(readers.file_inventory(spark, path), r"/lang=(en|de)/[^/]*\.parquet$")
    return found.select(F.regexp_extract("path", "/lang=(..)/", 1).alias("lang")).distinct()


@query("s03_formats", "select form, o_orderkey::varchar as o_orderkey, o_orderstatus from orders, (select unnest(['csv', 'json', 'orc', 'parquet']) as form)")
def s03(spark, d):
    orders, out = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus")), None
    for form in ("csv", "json", "orc", "parquet"):
        path = f"{new_folder(spark, 'out')}.{form}"
        orders.write.options(header=True).format(form).save(path)
        part = readers.read_auto(spark, path).select(F.lit(form).alias("form"), F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus")
        out = part if out is None else out.unionByName(part)
    return out


@query("s05_whitespace_table", "select c_custkey::varchar as ck, c_nationkey::varchar as nk from customer")
def s05(spark, d):
    path = new_folder(spark, "out")
    cust = table(spark, d, "customer")
    lines = cust.select(F.col("c_nationkey").alias("part"), F.lit(1).alias("later"), F.concat(F.lit("  "), "c_custkey", F.lit(" \t "), "c_nationkey").alias("value"))
    heads = cust.select(F.col("c_nationkey").alias("part"), F.lit(0).alias("later"), F.lit("ck   nk").alias("value")).distinct()
    lines.unionByName(heads).repartition("part").sortWithinPartitions("part", "later").select("part", "value").write.partitionBy("part").text(path)
    return readers.read_whitespace(spark, path)


@query("s07_archive_members", "select printf('%07d', doc_id) as participant_id, case when doc_id % 2 = 0 then 'L' else 'R' end as eye, 'fundus_image' as member_class, length(doc_id::varchar)::bigint as bytes, false as encrypted from documents")
def s07(spark, d):
    folder = new_folder(spark, "out")
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 5000).alias("archive"))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        return _archive(folder, rows)

    archives = docs.groupBy("archive").applyInPandas(write, "path string")
    return readers.archive_members(archives).select("participant_id", "eye", "member_class", "bytes", "encrypted")


def _archive(folder: str, rows: pd.DataFrame) -> pd.DataFrame:
    """One archive of small members for a group of documents."""
    from pyarrow import fs

    path = f"{folder}/images-{int(rows.archive.iloc[0])}.zip"
    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(where), recursive=True)
    with store.open_output_stream(where) as out, zipfile.ZipFile(out, "w") as z:
        for i in rows.doc_id:
            z.writestr(f"{i:07d}/retinal_{'left' if i % 2 == 0 else 'right'}.jpg", str(i))
    return pd.DataFrame({"path": [path]})


@query("s14_dictionary_sheets", "select 'variables' as sheet, p_partkey::varchar as code, p_name as label from part union all select 'categories', s_suppkey::varchar, s_name from supplier")
def s14(spark, d):
    path = new_folder(spark, "out")
    sheets = {"variables": table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("label")), "categories": table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("label"))}
    for name, df in sheets.items():
        df.write.options(header=True, quote='"', escape='"').csv(f"{path}/{name}.csv")
    out = None
    for name, df in readers.dictionary_sheets(spark, {n: f"{path}/{n}.csv" for n in sheets}).items():
        part = df.select(F.lit(name).alias("sheet"), "code", "label")
        out = part if out is None else out.unionByName(part)
    return out


# small operators that others hold


@query("p04_first_available_column", "select c_custkey, c_name as chosen, c_acctbal as exact from customer")
def p04(spark, d):
    cust = table(spark, d, "customer")
    chosen, exact = c.pick_column(cust.columns, ["entity_id", "C_NAME", "c_phone"]), c.pick_column(cust.columns, ["c_acctbal", "c_name"])
    return cust.select("c_custkey", F.col(chosen).alias("chosen"), F.col(exact).alias("exact"))


@query("t05_nulls_last", "select c_custkey, case when c_custkey % 40 = 0 then c_acctbal end as value from customer order by value asc nulls last, c_custkey limit 60")
def t05(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 40 == 0, F.col("c_acctbal")).alias("value"))
    return windows.report(rows, ["value", "c_custkey"], 60)


@query("u01_union_by_name", "select 'customer' as side, c_custkey as key, c_nationkey as nation from customer union all select 'supplier', s_suppkey, s_nationkey from supplier")
def u01(spark, d):
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("side"))
    supp = table(spark, d, "supplier").select(F.lit("supplier").alias("side"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return link.stacked([cust, supp])


GOWER = "with l as (select l_orderkey as o, l_linenumber as n, case when l_linenumber % 3 != 0 then l_returnflag end as flag, case when l_orderkey % 4 != 0 then l_linestatus end as mode, case when l_linenumber % 5 != 0 then l_quantity::double end as q from lineitem), r as (select max(q) - min(q) as spread from l)"


@query(
    "m07_gower_distance",
    GOWER
    + """, p as (select a.o, a.n, case when a.flag is null and b.flag is null then null when a.flag is null or b.flag is null or a.flag != b.flag then 1.0 else 0.0 end as x, case when a.mode is null and b.mode is null then null when a.mode is null or b.mode is null or a.mode != b.mode then 1.0 else 0.0 end as y,
      case when a.q is null and b.q is null then null when a.q is null or b.q is null then 1.0 else least(1.0, abs(a.q - b.q) / spread) end as z from l a join l b on a.o = b.o and a.n + 1 = b.n, r)
    select o as l_orderkey, n as l_linenumber, round((coalesce(x, 0) + coalesce(y, 0) + coalesce(z, 0)) / greatest(1, (x is not null)::integer + (y is not null)::integer + (z is not null)::integer), 9) as distance from p""",
)
def m07(spark, d):
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    lines = table(spark, d, "lineitem").select(o, n, F.when(n % 3 != 0, F.col("l_returnflag")).alias("flag"), F.when(o % 4 != 0, F.col("l_linestatus")).alias("mode"), F.when(n % 5 != 0, F.col("l_quantity").cast("double")).alias("q"))
    names = ("flag", "mode", "q")
    other = lines.select(o, (n - 1).alias("l_linenumber"), *[F.col(x).alias(f"{x}_b") for x in names])
    pairs = lines.join(other, ["l_orderkey", "l_linenumber"]).crossJoin(lines.agg((F.max("q") - F.min("q")).alias("spread")))
    return pairs.select("l_orderkey", "l_linenumber", F.round(matching.gower_column({x: (F.col(x), F.col(f"{x}_b")) for x in names}, {"q": F.col("spread")}), 9).alias("distance"))


def extremes(spark, d):
    """People of three cohorts; in one of them sex is mostly unknown."""
    cust = table(spark, d, "customer")
    cohort = F.col("c_nationkey") % 3
    sex = F.when((cohort != 1) | (F.col("c_custkey") % 3 == 0), F.col("c_mktsegment"))
    return cust.select(F.col("c_custkey").cast("string").alias("who"), cohort.alias("cohort"), (F.col("c_acctbal") / 100).alias("age"), (F.col("c_custkey") * 7919 % 1000).alias("gap"), sex.alias("sex"))


# one case per step and cohort, by (age, id): while any control that is left knows its sex, a case that knows its own looks among equal ones only; it takes the nearest, if that is
# inside the caliper
EXTREMES = """
with recursive own as (select cast(c_custkey as varchar) as who, c_nationkey % 3 as cohort, c_acctbal / 100 as age, c_custkey * 7919 % 1000 as gap, case when c_nationkey % 3 != 1 or c_custkey % 3 = 0 then c_mktsegment end as sex from customer),
placed as (select *, row_number() over (partition by cohort order by gap, who) as r, count(*) over (partition by cohort) as n from own),
ends as (select *, least(greatest(1, ceil(n * 0.2)), n // 2) as size from placed where n >= 4),
tops as (select *, row_number() over (partition by cohort order by age, who) as step from ends where r > n - size),
state as (
  select cohort, 0::bigint as step, ''::varchar as who, 0.0::double as far, ''::varchar as control, list({'who': who, 'age': age, 'sex': sex}) as free from ends where r <= size group by cohort
  union all
  select cohort, step, who, near.far, near.who, case when near.far <= 2.0 then [x for x in free if x.who != near.who] else free end
  from (select *, list_sort([{'far': abs(x.age - age), 'who': x.who} for x in free if not (sex is not null and len([y for y in free if y.sex is not null]) > 0) or coalesce(x.sex = sex, false)])[1] as near
    from (select t.cohort, t.step, t.who, t.age, t.sex, state.free from state join tops t on t.cohort = state.cohort and t.step = state.step + 1))
)
select cohort, who as case_id, control as control_id, far as value_distance from state where step > 0 and far <= 2.0
"""


@query("m06_extremes_matched", EXTREMES)
def m06(spark, d):
    pairs = matching.match_extremes(extremes(spark, d), "who", "age", "gap", "cohort", "sex", 0.2, matching.Rule(caliper=2.0))
    return pairs.select("cohort", "case_id", "control_id", "value_distance")


@query("l11_shortcut_baselines")
def l11(spark, d):
    rows = vectors(spark, d).withColumns({"y": (F.col("label") < 5).cast("int"), "site": F.col("vec_id") % 4, "sex": F.when(F.col("vec_id") % 7 != 0, F.when((F.col("label") + F.col("vec_id")) % 3 == 0, "F").otherwise("M")), "brightness": F.col("embedding")[1].cast("double"), "contrast": F.when(F.col("vec_id") % 6 != 0, F.col("embedding")[2].cast("double"))})
    dealt = models.folds(rows, "vec_id", 3, 3, "y")
    sets = {"demographics": (["sex"], ["age"]), "quality": ([], ["brightness", "contrast"]), "both": (["sex", "site"], ["age", "brightness", "contrast"])}
    return _rounded(models.shortcut_baselines(dealt, "y", sets, "fold", "vec_id"), 3)
