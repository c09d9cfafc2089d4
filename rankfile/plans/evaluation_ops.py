"""Queries of evaluation: edits as hypothesis against truth, reviews as the label of confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SAN
from ..operators import evaluation as e
from ..operators.ordered import ranked
from .registry import Registry, for_spark

R = Registry()


def _spans(s: SparkSession, d: str) -> DataFrame:
    """Spans with a confidence; a span that was not sent to review is correct."""
    lib = s.read.parquet(f"{d}/library.parquet").select("doc_id", "stratum").dropDuplicates(["doc_id"])
    sp = s.read.parquet(f"{d}/text_spans.parquet").where("confidence is not null").dropDuplicates(["span_id"]).select("span_id", "doc_id", "page", "confidence", "engine", F.coalesce(~F.col("review"), F.lit(True)).alias("correct"), F.length("text").alias("chars"))
    return sp.join(lib, "doc_id", "left")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Edits as truth (before) and hypothesis (after), with the stratum and the mean confidence of their document."""
    j = s.read.parquet(f"{d}/edit_journal.parquet").dropDuplicates(["edit_id"])
    c = _spans(s, d).groupBy("doc_id").agg(F.avg("confidence").alias("confidence"))
    lib = s.read.parquet(f"{d}/library.parquet").select("doc_id", "stratum").dropDuplicates(["doc_id"])
    return j.join(lib, "doc_id", "left").join(c, "doc_id", "left")


def _rows(s: SparkSession, d: str) -> DataFrame:
    return e.rows(_pairs(s, d), "edit_id", "stratum", "text_before", "text_after", "confidence")


_SP = "(select distinct span_id, doc_id, page, confidence, engine, coalesce(not review, true) as correct, length(text) as chars from @text_spans where confidence is not null)"
_RND = lambda x, n=6: f"floor(({x}) * 1e{n} + 5e-1) / 1e{n}"
R.plan("o4_10_summarise_rows", lambda s, d: e.summary(_rows(s, d), "stratum"))
R.plan("o12_33_score_text", lambda s, d: _rows(s, d).select(F.col("key").alias("edit_id"), F.when(F.col("answered"), F.round("cer", 6)).alias("cer"), F.when(F.col("answered"), F.round("wer", 6)).alias("wer"), F.when(F.col("answered"), F.round("line_exact", 6)).alias("line_exact"), "moves_kept"))
R.plan("o4_12_evaluate_gates", lambda s, d: e.gates(_rows(s, d), _rows(s, d).withColumn("cer", F.col("cer") * 0.5)).select("stratum", "gate", F.round("observed", 6).alias("observed"), "allowed", "passed"))
R.plan("o4_11_group_rows", lambda s, d: _rows(s, d).groupBy("stratum", "decision").agg(F.count("*").alias("n")))
_MOVES = f"(select edit_id, unnest(regexp_extract_all(text_before, '{SAN}')) as m, 1 as t from (select distinct edit_id, text_before, text_after from @edit_journal) j union all select edit_id, unnest(regexp_extract_all(text_after, '{SAN}')), 0 from (select distinct edit_id, text_before, text_after from @edit_journal) j)"
_KEPT = f"(select edit_id, sum(t)::bigint as truth, sum(least(t, f))::bigint as kept, sum(f)::bigint as found from (select edit_id, m, sum(t) as t, sum(1 - t) as f from {_MOVES} x group by edit_id, m) y group by edit_id)"
R.plan("o4_13_move_accounting", lambda s, d: e.move_accounting(s.read.parquet(f"{d}/edit_journal.parquet").select("edit_id", "text_before", "text_after").distinct(), "edit_id", "text_before", "text_after"), f"select edit_id, truth, kept, truth - kept as missing, found - kept as invented from {_KEPT} k")
R.plan("o4_14_move_accuracy", lambda s, d: e.move_accounting(s.read.parquet(f"{d}/edit_journal.parquet").select("edit_id", "text_before", "text_after").distinct(), "edit_id", "text_before", "text_after").select("edit_id", F.round(F.coalesce(F.try_divide("kept", "truth"), F.lit(1.0)), 6).alias("accuracy")), f"select edit_id, case when truth = 0 then 1e0 else {_RND('kept / truth')} end as accuracy from {_KEPT} k")

# calibration
_BINS = f"(select least(floor(confidence * 10), 9)::int as bin, count(*) as n, avg(confidence) as c, avg(correct::int) as a from {_SP} s group by 1)"
R.plan("o4_15_reliability", lambda s, d: e.reliability(_spans(s, d), "confidence", "correct").select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy")), f"select b.bin, coalesce(n, 0) as n, {_RND('coalesce(c, 0)')} as confidence, {_RND('coalesce(a, 0)')} as accuracy from (select unnest(range(10))::int as bin) b left join {_BINS} x using (bin)")
R.plan("o4_16_expected_calibration_error", lambda s, d: e.calibration(_spans(s, d), "confidence", "correct").select(F.round("ece", 6).alias("ece")), f"select {_RND('sum(n * abs(c - a)) / sum(n)')} as ece from {_BINS} b")
R.plan("o4_17_brier_score", lambda s, d: e.calibration(_spans(s, d), "confidence", "correct").select(F.round("brier", 6).alias("brier")), f"select {_RND('avg((confidence - correct::int) ** 2)')} as brier from {_SP} s")
_BY = f"(select engine, least(floor(confidence * 10), 9)::int as bin, count(*) as n, avg(confidence) as c, avg(correct::int) as a from {_SP} s group by 1, 2)"
R.plan("o4_18_calibration_report", lambda s, d: e.calibration(_spans(s, d), "confidence", "correct", 10, "engine").select("engine", "n", F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier")), f"select engine, n, ece, brier from (select engine, sum(n)::bigint as n, {_RND('sum(n * abs(c - a)) / sum(n)')} as ece from {_BY} b group by engine) x join (select engine, {_RND('avg((confidence - correct::int) ** 2)')} as brier from {_SP} s group by engine) y using (engine)")
_STEPS = "(select unnest(range(11))::int as step)"
R.plan("o4_19_risk_coverage", lambda s, d: e.risk_coverage(_spans(s, d).withColumn("error", (~F.col("correct")).cast("int")), "confidence", "error"), f"select step, {_RND('count(*) filter (confidence >= step / 10.0 - 1e-10) / count(*)')} as coverage, {_RND('coalesce(avg((not correct)::int) filter (confidence >= step / 10.0 - 1e-10), 0)')} as risk from {_STEPS} t cross join {_SP} s group by step")
R.plan("o4_41_risk_coverage", lambda s, d: e.risk_coverage(_spans(s, d).withColumn("error", F.when(F.col("chars") > 20, 0).otherwise(1)), "confidence", "error", 20), f"select step, {_RND('count(*) filter (confidence >= step / 20.0 - 1e-10) / count(*)')} as coverage, {_RND('coalesce(avg(case when chars > 20 then 0 else 1 end) filter (confidence >= step / 20.0 - 1e-10), 0)')} as risk from (select unnest(range(21))::int as step) t cross join {_SP} s group by step")
R.plan("o4_40_auroc", lambda s, d: e.auroc(_spans(s, d), "correct", "confidence").select(F.round("auc", 6).alias("auc")), f"select {_RND('(sum(r) filter (correct) - count(*) filter (correct) * (count(*) filter (correct) + 1) / 2.0) / (count(*) filter (correct) * count(*) filter (not correct))')} as auc from (select correct, rank() over (order by confidence) + (count(*) over (partition by confidence) - 1) / 2.0 as r from {_SP} s) t")


def _poisson() -> str:
    x = "((((k % 2147483647) * 48271 + b * 69621 + 11) % 2147483647) * 48271 + 7) % 2147483647"
    x = f"((({x}) * 69621 + 7) % 2147483647 * 39373 + 7) % 2147483647"
    return " + ".join(f"(({x}) / 2147483647.0 > {p})::int" for p in (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885))


R.plan("o4_20_bootstrap_mean_ci", lambda s, d: e.bootstrap(_spans(s, d), "span_id", "confidence", "engine").select("engine", "n", *(F.round(x, 6).alias(x) for x in ("mean", "low", "high"))), f"with w as (select engine, b, c, {_poisson()} as w from (select engine, span_id as k, confidence as c from {_SP} s) s cross join (select unnest(range(1, 201)) as b) t), m as (select engine, b, sum(w * c) / nullif(sum(w), 0) as m from w group by engine, b) select engine, n, mean, {_RND('low')} as low, {_RND('high')} as high from (select engine, quantile_cont(m, 25e-3) as low, quantile_cont(m, 975e-3) as high from m group by engine) x join (select engine, count(*) as n, {_RND('avg(confidence)')} as mean from {_SP} s group by engine) y using (engine)")
_FIT = f"with b as (select engine, floor(confidence * 100 + 5e-1)::int as i, count(*) as n, sum(correct::int) as s from {_SP} s group by 1, 2), c as (select *, sum(n) over (partition by engine order by i) as cn, sum(s) over (partition by engine order by i) as cs, sum(n) over (partition by engine) as total from b), r as (select x.engine, x.i as j, y.i as k, (y.cs - x.cs + x.s) / (y.cn - x.cn + x.n) as m from c x join c y on x.engine = y.engine and y.i >= x.i where x.total >= 40), g as (select engine, k as i, max(lo) as y from (select engine, j, k, min(m) over (partition by engine, j order by k desc rows unbounded preceding) as lo from r) q group by engine, k), l as (select engine, floor(y * 1e9 + 5e-1) / 1e9 as y, (min(i) + max(i)) / 200.0 as x, max(cn) as u, max(total) as total from g join c using (engine, i) group by 1, 2), p as (select *, row_number() over (partition by engine, floor((u - 1) * 11 / total) order by x) as f, row_number() over (partition by engine order by x desc) as z from l) select engine, {_RND('x')} as x, {_RND('y')} as y from p where f = 1 or z = 1"
R.plan("o4_24_fit_isotonic", lambda s, d: e.isotonic(_spans(s, d), "confidence", "correct", "engine"), _FIT)
R.plan("o4_25_calibration_apply", lambda s, d: e.interpolated(_spans(s, d), "confidence", e.isotonic(_spans(s, d), "confidence", "correct", "engine"), "engine").select("span_id", F.round("calibrated", 5).alias("calibrated")), f"with k as ({_FIT}), t as (select span_id, confidence as c, (select max(x) from k where k.engine = s.engine and x <= s.confidence) as lx, (select min(x) from k where k.engine = s.engine and x > s.confidence) as hx, engine from {_SP} s) select span_id, {_RND('case when lx is null and hx is null then c when lx is null then b.y when hx is null then a.y else a.y + (c - lx) / (hx - lx) * (b.y - a.y) end', 5)} as calibrated from t left join k a on a.engine = t.engine and a.x = lx left join k b on b.engine = t.engine and b.x = hx")


def _regions(s: SparkSession, d: str) -> DataFrame:
    """Spans as found regions against the lines of their page as true ones."""
    sp = s.read.parquet(f"{d}/text_spans.parquet").where("x is not null and y is not null and w > 0 and h > 0").dropDuplicates(["span_id"])
    line = sp.groupBy("doc_id", "page", "line_no").agg(F.min("span_id").alias("id"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
    return e.region_scores(line, sp.withColumn("id", F.col("span_id")), "doc_id", "page")


R.plan("o3_10_region_prf", _regions)
R.plan("o5_16_page_window", lambda s, d: ranked(s.sql(for_spark("select distinct node_id, doc_id, ordinal from @nodes where scope = 'captions'", d)), ["doc_id", "ordinal", "node_id"], "rn").where("rn between 11 and 20").select("node_id", F.col("rn").cast("long").alias("rn")), "select node_id, rn from (select node_id, row_number() over (order by doc_id, ordinal, node_id) as rn from (select distinct node_id, doc_id, ordinal from @nodes where scope = 'captions') n) t where rn between 11 and 20")
R.plan("o6_11_items_sorted", lambda s, d: ranked(s.sql(for_spark("select distinct item_id, lang from @eval_items", d)), ["item_id"], "rn").select("item_id", "lang", F.col("rn").cast("long").alias("rn")), "select item_id, lang, row_number() over (order by item_id) as rn from (select distinct item_id, lang from @eval_items) t")
