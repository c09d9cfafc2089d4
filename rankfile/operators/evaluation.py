"""Evaluation of recognised text: rows of truth and hypothesis, summaries, calibration, intervals, box matching.

A row holds what one recognised item came to: whether it was answered, its error rates, its moves against the true
ones, its confidence and decision. Everything is an aggregation over such rows; the fits and intervals work on bins or
on weighted sums, so no group is collected. An empty group has the value its function names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SAN
from ..session import written
from .metrics import line_accuracy, word_error_rate

CORRECT, WRONG = 0.02, 0.10  # fixed values: error rates up to which an item is correct, from which an accepted one is wrong
ACCEPT, REVIEW = 0.80, 0.45  # fixed values: confidences from which an item is accepted, or goes to review


def move_accounting(df: DataFrame, key: str, truth: str, found: str) -> DataFrame:
    """(key, truth, kept, missing, invented): moves of both texts as multisets. Texts without moves have no row."""
    side = lambda text, sign: df.select(key, F.explode(F.regexp_extract_all(text, F.lit(SAN), F.lit(0))).alias("m"), F.lit(sign).alias("s"))
    n = side(truth, 1).unionByName(side(found, 0)).groupBy(key, "m").agg(F.sum("s").alias("t"), F.sum(1 - F.col("s")).alias("f"))
    kept = F.sum(F.least("t", "f"))
    return n.groupBy(key).agg(F.sum("t").alias("truth"), kept.alias("kept"), (F.sum("t") - kept).alias("missing"), (F.sum("f") - kept).alias("invented"))


def rows(pairs: DataFrame, key: str, stratum: str, truth: str, found: str, confidence: str) -> DataFrame:
    """(key, stratum, control, answered, cer, wer, line_exact, moves..., length_ratio, confidence, decision) of each pair.

    An item without true text is a control. One without an answer has all its characters wrong. A null confidence is 0.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", " "))
    d = pairs.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"), flat(truth).alias("t"), flat(found).alias("f"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), F.col(truth).alias("lines_t"), F.col(found).alias("lines_f"))
    n = F.greatest(F.length("t"), F.lit(1))
    m = move_accounting(d, "key", "t", "f")
    d = d.join(m.select("key", *(F.col(c).alias(f"moves_{c}") for c in ("truth", "kept", "missing", "invented"))), "key", "left").fillna(0, [f"moves_{c}" for c in ("truth", "kept", "missing", "invented")])
    decision = F.when(F.col("f") == "", "abstained").when(F.col("confidence") >= ACCEPT, "accepted").when(F.col("confidence") >= REVIEW, "review").otherwise("abstained")
    return d.select(
        "key", "stratum", (F.col("t") == "").alias("control"), (F.col("f") != "").alias("answered"), (F.levenshtein("f", "t") / n).alias("cer"), word_error_rate("f", "t").alias("wer"),
        line_accuracy("lines_f", "lines_t").alias("line_exact"), "moves_truth", "moves_kept", "moves_missing", "moves_invented", (F.length("f") / n).alias("length_ratio"), F.length("f").alias("chars"),
        "confidence", decision.alias("decision"), (F.col("confidence") < ACCEPT).alias("below_threshold"),
    )


def summary(r: DataFrame, *by: str) -> DataFrame:
    """The figures of each group of rows (of all, without `by`). Means of nothing are 0, the move accuracy 1."""
    measured, answered = ~F.col("control"), ~F.col("control") & F.col("answered")
    n, a = F.count_if(measured), F.count_if(answered)
    mean = lambda x, w: F.coalesce(F.avg(F.when(w, x)), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(F.when(answered, F.col(c))), F.lit(0))
    share = lambda x, y, none: F.coalesce(F.try_divide(x, y), F.lit(none))
    upper = F.expr("percentile_disc(0.5) within group (order by case when not control and answered then -cer end)") * -1
    return r.groupBy(*by).agg(
        n.alias("n"), a.alias("answered"), F.count_if(measured & (F.col("decision") == "abstained")).alias("abstained"), F.count_if(measured & (F.col("decision") == "review")).alias("review"),
        F.round(share(F.count_if(measured & (F.col("decision") == "review")), n, 0.0), 4).alias("review_share"), F.round(share(n - a, n, 0.0), 4).alias("abstention_rate"),
        F.round(mean(F.col("cer"), answered), 5).alias("cer_mean"), F.round(F.coalesce(upper, F.lit(0.0)), 5).alias("cer_median"), F.round(mean(F.when(F.col("answered"), F.col("cer")).otherwise(1.0), measured), 5).alias("cer_all_mean"),
        F.round(F.avg(F.when(measured & ~F.col("answered"), F.col("cer"))), 5).alias("cer_withheld_mean"), F.count_if(measured & ~F.col("answered")).alias("withheld"),
        F.round(mean(F.col("wer"), answered), 5).alias("wer_mean"), F.round(mean(F.col("line_exact"), answered), 4).alias("line_exact_mean"),
        *(total(f"moves_{c}").alias(f"moves_{c}") for c in ("truth", "kept", "missing", "invented")), F.round(share(total("moves_kept"), total("moves_truth"), 1.0), 5).alias("move_accuracy"),
        F.round(mean(F.greatest(F.lit(0.0), F.col("length_ratio") - 1), answered), 5).alias("insertion_rate"),
        F.count_if(answered & F.col("below_threshold") & (F.col("decision") == "accepted")).alias("silent_below_threshold"), F.count_if(answered & (F.col("decision") == "accepted") & (F.col("cer") > WRONG)).alias("accepted_wrong"),
        F.count_if("control").alias("controls"), F.count_if(F.col("control") & F.col("answered") & (F.col("chars") > 0)).alias("control_false_positives"),
        F.round(mean(F.when(F.col("cer") <= CORRECT, 1.0).otherwise(0.0), answered), 5).alias("correct_rate"), F.round(mean(F.col("confidence"), answered), 5).alias("confidence_mean"),
    )


# Limits of the gates.
GATES = (("clean error rate", "cer_mean", 0.005, "at most"), ("move accuracy", "move_accuracy", 0.998, "at least"), ("invented moves", "moves_invented", 0.0, "at most"), ("silent import", "silent_below_threshold", 0.0, "at most"), ("negative controls", "control_false_positives", 0.0, "at most"))
TOLERANCE = {"cer_mean": 0.002, "insertion_rate": 0.002}


def gates(current: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(stratum, gate, observed, allowed, passed): the limits for all rows (stratum null), and with a baseline, per
    stratum, how much worse than there the error and insertion rates may be."""
    whole = summary(current)
    parts = [whole.select(F.lit(None).cast("string").alias("stratum"), F.lit(g).alias("gate"), F.col(c).cast("double").alias("observed"), F.lit(lim).alias("allowed"), (F.col(c) <= lim if how == "at most" else F.col(c) >= lim).alias("passed")) for g, c, lim, how in GATES]
    if baseline is not None:
        a = summary(current, "stratum").where("answered > 0")
        b = summary(baseline, "stratum").where("answered > 0").select("stratum", *(F.col(c).alias(f"old_{c}") for c in TOLERANCE))
        both = a.join(b, "stratum")
        for c, t in TOLERANCE.items():
            delta = F.round(F.col(c) - F.col(f"old_{c}"), 5)
            parts.append(both.select("stratum", F.lit(f"{c} against the baseline").alias("gate"), delta.alias("observed"), F.lit(t).alias("allowed"), (delta <= t).alias("passed")))
    return reduce(DataFrame.unionByName, parts)


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = 10, *by: str) -> DataFrame:
    """(by, bin, n, confidence, accuracy) of every bin of equal width, the last closed at 1; empty bins have n 0."""
    own = df.where(F.col(confidence).isNotNull()).groupBy(*by, F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    got = own.agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    every = got.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(got, [*by, "bin"], "left").fillna(0, ["n"]).fillna(0.0, ["confidence", "accuracy"])


def calibration(df: DataFrame, confidence: str, correct: str, bins: int = 10, *by: str) -> DataFrame:
    """(by, n, ece, brier): count-weighted mean gap of the bins, mean squared error of the confidence."""
    r = reliability(df, confidence, correct, bins, *by)
    gap = r.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n")), F.lit(0.0)).alias("ece"))
    square = df.where(F.col(confidence).isNotNull()).groupBy(*by).agg(F.avg(F.pow(F.col(confidence) - F.col(correct).cast("double"), 2)).alias("brier"))
    return (gap.join(square, list(by)) if by else gap.crossJoin(F.broadcast(square))).select(*by, "n", "ece", F.coalesce("brier", F.lit(0.0)).alias("brier"))  # one row each without by


def risk_coverage(df: DataFrame, confidence: str, error: str, steps: int = 10) -> DataFrame:
    """(step, coverage, risk): share of rows at or over each of the thresholds k / steps, and their mean error. Rows are
    first counted by the highest step they reach."""
    own = df.where(F.col(confidence).isNotNull()).groupBy(F.least(F.floor(F.col(confidence) * steps + 1e-9), F.lit(steps)).cast("int").alias("top")).agg(F.count("*").alias("n"), F.sum(F.col(error).cast("double")).alias("e"))
    every = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    over = F.col("top") >= F.col("step")
    kept = F.sum(F.when(over, F.col("n")).otherwise(0))
    return every.groupBy("step").agg(F.round(kept / F.sum("n"), 6).alias("coverage"), F.round(F.coalesce(F.try_divide(F.sum(F.when(over, F.col("e"))), kept), F.lit(0.0)), 6).alias("risk"))


def auroc(df: DataFrame, positive: str, score: str) -> DataFrame:
    """(auc): probability that a positive row scores over a negative one, ties half; over counts of equal scores."""
    from .ordered import ranked

    per = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    below = ranked(per, ["score"], "upto", "q")
    sums = below.agg(F.sum(F.col("p") * (F.col("upto") - F.col("q") / 2.0)).alias("x"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums.select(F.try_divide("x", F.col("p") * F.col("q")).alias("auc"))


def poisson_weight(key: Column, sample: Column) -> Column:
    """How often a row is in a bootstrap sample: a Poisson number of mean 1, from a multiplicative generator on key and sample."""
    m = 2147483647
    x = F.pmod(F.pmod(key, F.lit(m)) * 48271 + sample * 69621 + 11, F.lit(m))
    for a in (48271, 69621, 39373):
        x = F.pmod(x * a + 7, F.lit(m))
    u = x / F.lit(float(m))
    steps = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885)  # distribution function of that number
    return reduce(lambda acc, s: acc + (u > s).cast("int"), steps, F.lit(0))


def bootstrap(df: DataFrame, key: str, value: str, *by: str, samples: int = 200, alpha: float = 0.05) -> DataFrame:
    """(by, n, mean, low, high): percentile interval of the mean, by Poisson bootstrap. A sample that drew no row is left out.

    Sums of a sample combine before the shuffle, so a group of any size needs `samples` rows of it.
    """
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(key).cast("long").alias("k"), F.col(value).cast("double").alias("v"))
    drawn = d.select(*by, "v", "k", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample")).withColumn("w", poisson_weight(F.col("k"), F.col("sample")))
    means = drawn.groupBy(*by, "sample").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("m")).where("m is not null")
    low, high = (F.expr(f"percentile(m, {p})") for p in (alpha / 2, 1 - alpha / 2))
    edges = means.groupBy(*by).agg(low.alias("low"), high.alias("high"))
    whole = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return (whole.join(edges, list(by)) if by else whole.crossJoin(F.broadcast(edges))).select(*by, "n", "mean", "low", "high")


LEAST, KNOTS, GRID = 40, 12, 100  # fixed values: rows a fit needs, knots it keeps; bins of the confidence it works on


def isotonic(df: DataFrame, raw: str, correct: str, *by: str, least: int = LEAST, knots: int = KNOTS) -> DataFrame:
    """(by, x, y): the monotone fit of the rate of correct rows, at most about `knots` points of it; none under `least` rows.

    Over GRID + 1 bins, the fit at a bin is the largest, over the bins from which a run to it can start, of the smallest
    mean of such a run that reaches the bin or goes beyond. The knots are the ends of the levels that the quantiles of
    the rows fall in.
    """
    b = df.where(F.col(raw).isNotNull() & F.col(correct).isNotNull()).groupBy(*by, F.round(F.col(raw) * GRID).cast("int").alias("i")).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("double")).alias("s"), F.sum(raw).alias("sx"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    b = written(b.withColumns({"total": F.sum("n").over(w), "cn": F.sum("n").over(upto), "cs": F.sum("s").over(upto)}).where(F.col("total") >= least), "bins")  # at most GRID + 1 rows a group
    on = list(by) or None
    start = b.select(*by, F.col("i").alias("j"), (F.col("cn") - F.col("n")).alias("n0"), (F.col("cs") - F.col("s")).alias("s0"))
    end = b.select(*by, F.col("i").alias("k"), F.col("cn").alias("n1"), F.col("cs").alias("s1"))
    runs = (start.join(end, on) if on else start.crossJoin(F.broadcast(end))).where("k >= j").select(*by, "j", "k", ((F.col("s1") - F.col("s0")) / (F.col("n1") - F.col("n0"))).alias("mean"))
    down = runs.withColumn("least", F.min("mean").over(Window.partitionBy(*by, "j").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)))
    fit = down.groupBy(*by, F.col("k").alias("i")).agg(F.max("least").alias("y"))  # runs from j <= i, their least mean from i on
    levels = b.join(fit, [*by, "i"]).groupBy(*by, F.round("y", 9).alias("y")).agg(((F.min("i") + F.max("i")) / (2.0 * GRID)).alias("x"), F.max("cn").alias("upto"), F.max("total").alias("total"))
    slot = F.floor((F.col("upto") - 1) * (knots - 1) / F.col("total"))
    picked = levels.withColumn("first", F.row_number().over(Window.partitionBy(*by, slot).orderBy("x"))).withColumn("last", F.row_number().over(w.orderBy(F.desc("x"))))
    return picked.where("first = 1 or last = 1").select(*by, F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def interpolated(df: DataFrame, raw: str, knots: DataFrame, *by: str) -> DataFrame:
    """df with `calibrated`: raw by the line between the knots around it, flat beyond the ends; raw itself without knots."""
    k = knots.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("_knots"))  # a few knots a group
    d = df.join(F.broadcast(k), list(by), "left") if by else df.crossJoin(F.broadcast(k))
    low, high = F.filter("_knots", lambda p: p["x"] <= F.col(raw)), F.filter("_knots", lambda p: p["x"] > F.col(raw))
    a, b = F.try_element_at(low, F.lit(-1)), F.try_element_at(high, F.lit(1))
    line = a["y"] + (F.col(raw) - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"])
    none = F.col("_knots").isNull() | (F.size("_knots") == 0)
    return d.withColumn("calibrated", F.when(none, F.col(raw)).otherwise(F.coalesce(line, a["y"], b["y"]))).drop("_knots")


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes of prefixed columns x, y, w, h."""
    ix = F.greatest(F.lit(0.0), F.least(F.col(f"{a}x") + F.col(f"{a}w"), F.col(f"{b}x") + F.col(f"{b}w")) - F.greatest(f"{a}x", f"{b}x"))
    iy = F.greatest(F.lit(0.0), F.least(F.col(f"{a}y") + F.col(f"{a}h"), F.col(f"{b}y") + F.col(f"{b}h")) - F.greatest(f"{a}y", f"{b}y"))
    return F.coalesce(F.try_divide(ix * iy, F.col(f"{a}w") * F.col(f"{a}h") + F.col(f"{b}w") * F.col(f"{b}h") - ix * iy), F.lit(0.0))


def best_matches(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """A matching of (left, right, score), one to one, best first: in each round the pairs that are both sides' best are
    taken, and the rest of their sides' pairs go. Ties go to the smaller ids."""
    free, taken = written(pairs.select(left, right, score), "match"), None
    while not free.isEmpty():
        at = lambda k, o: F.row_number().over(Window.partitionBy(k).orderBy(F.desc(score), left, right)).alias(o)
        best = written(free.select("*", at(left, "_l"), at(right, "_r")).where("_l = 1 and _r = 1").select(left, right, score), "match")
        taken = best if taken is None else taken.unionByName(best)
        free = written(free.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti"), "match")
    return taken if taken is not None else free


def region_scores(truth: DataFrame, found: DataFrame, *page: str, least: float = 0.5) -> DataFrame:
    """(page, truth, found, matched, precision, recall, f1): boxes (id, x, y, w, h) of each page matched one to one from an
    overlap of `least` on. Boxes that overlap share a grid cell, so only those are compared. A page without boxes of one
    side has scores of 0."""
    cell = 64.0
    boxes = lambda d, p: d.select(*page, F.col("id").alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in "xywh")).withColumn(
        "cy", F.explode(F.sequence(F.floor(F.col(f"{p}y") / cell), F.floor((F.col(f"{p}y") + F.col(f"{p}h")) / cell)))
    )
    near = boxes(truth, "t_").join(boxes(found, "f_"), [*page, "cy"]).withColumn("score", iou("t_", "f_")).where(F.col("score") >= least)
    hit = best_matches(near.select("t_id", "f_id", "score").distinct(), "t_id", "f_id", "score")
    n = lambda d, name: d.groupBy(*page).agg(F.count("*").alias(name))
    matched = hit.join(truth.select(*page, F.col("id").alias("t_id")), "t_id").groupBy(*page).agg(F.count("*").alias("matched"))
    out = n(truth, "truth").join(n(found, "found"), list(page), "full").join(matched, list(page), "left").fillna(0, ["truth", "found", "matched"])
    p, r = (F.coalesce(F.try_divide("matched", c), F.lit(0.0)) for c in ("found", "truth"))
    return out.select(*page, "truth", "found", "matched", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))
