"""Classification evaluation as DataFrame aggregates.

Inputs are long tables of (y_true, y_pred) or (y_true, class, score).  All
per-class quantities come from one exploded aggregate, so a frequent class
is combined map-side.  Exact AUC, ROC and quartiles need sums over all lesser
values: values are counted and summed by ranges (``operators/ranges.py``), so no
window and no buffer holds a whole class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import prefix_sums, quantiles, with_next

MAX_LABELS = 200  # alignment and its k × k table are a driver-side step


# --- A10 / A11 ---------------------------------------------------------------------
def class_distribution(df: DataFrame, col: str = "y_true") -> DataFrame:
    """A10: count and share per class (share over a window on ≤ k rows)."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def box_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (clamped to data) and outlier counts per group.

    Whiskers are the extreme data points inside the fences, found with a second
    conditional aggregate.
    """
    q = quantiles(df, [by], col, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    q = q.join(df.groupBy(by).agg(F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max")), by)
    q = q.select(by, "n", "min", "max", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({
        "lo_fence": F.col("q1") - 1.5 * F.col("iqr"), "hi_fence": F.col("q3") + 1.5 * F.col("iqr")})
    j = df.select(by, F.col(col).alias("_v")).join(q.select(by, "lo_fence", "hi_fence"), by)
    inside = (F.col("_v") >= F.col("lo_fence")) & (F.col("_v") <= F.col("hi_fence"))
    w = j.groupBy(by).agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
        F.count(F.when(~inside & F.col("_v").isNotNull(), 1)).alias("n_outliers"))
    return q.join(w, by)


# --- M12 / M11 ----------------------------------------------------------------------
def confusion(df: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Counts per (true, pred) of all labels, zeros too, and the share in the
    true label's row (null where that label never occurs)."""
    g = df.where(F.col(t).isNotNull() & F.col(p).isNotNull()).groupBy(t, p).agg(F.count(F.lit(1)).alias("n"))
    labels = g.agg(F.array_union(F.collect_set(t), F.collect_set(p)).alias("l"))  # one row, one entry per label
    spine = labels.select("l", F.explode("l").alias(t)).select(t, F.explode("l").alias(p))
    full = spine.join(g, [t, p], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("row_share", F.try_divide("n", F.sum("n").over(Window.partitionBy(t))))


def assignment(weight: list[list[int]]) -> list[int]:
    """The column of each row in a one-to-one assignment of greatest weight, by
    growing alternating trees from one row after the other."""
    k = len(weight)
    top = max((w for row in weight for w in row), default=0)
    row_price, column_price, owner = [0] * k, [0] * (k + 1), [-1] * (k + 1)
    for start in range(k):
        owner[k], at = start, k
        slack, back, done = [float("inf")] * k, [k] * k, [False] * (k + 1)
        while owner[at] != -1:
            done[at] = True
            row, step, best = owner[at], float("inf"), -1
            for c in range(k):
                if not done[c]:
                    gap = top - weight[row][c] - row_price[row] - column_price[c]
                    if gap < slack[c]:
                        slack[c], back[c] = gap, at
                    if slack[c] < step:
                        step, best = slack[c], c
            for c in range(k + 1):
                if done[c]:
                    row_price[owner[c]] += step
                    column_price[c] -= step
                elif c < k:
                    slack[c] -= step
            at = best
        while at != k:
            owner[at], at = owner[back[at]], back[at]
    out = [0] * k
    for c in range(k):
        out[owner[c]] = c
    return out


def best_alignment(counts: dict[tuple[int, int], int], labels: list[int]) -> dict[int, int]:
    """M11 on a k×k table: mapping pred → true maximising the diagonal; of equal
    mappings the one whose true labels come first in order."""
    k = len(labels)
    weight = [[counts.get((t, p), 0) for t in labels] for p in labels]
    total = lambda w: sum(w[i][c] for i, c in enumerate(assignment(w)))
    best, bonus = total(weight), k + 1
    scaled = [[bonus * n for n in row] for row in weight]
    for i in range(k):  # fix one row after the other to its first label that costs nothing
        for c in range(k):
            tried = [list(row) for row in scaled]
            tried[i][c] += 1
            if total(tried) == bonus * best + i + 1:
                scaled = tried
                break
    return {labels[i]: labels[c] for i, c in enumerate(assignment(scaled))}


def align_labels(df: DataFrame, t: str = "y_true", p: str = "y_pred", out: str = "y_aligned",
                 labels: list[int] | None = None) -> DataFrame:
    """Remap predicted labels with the best one-to-one mapping; a missing
    label has no part in it and stays missing."""
    g = df.where(F.col(t).isNotNull() & F.col(p).isNotNull()).groupBy(t, p).agg(F.count(F.lit(1)).alias("n"))
    most = MAX_LABELS * MAX_LABELS
    rows = g.limit(most + 1).collect()
    counts = {(r[t], r[p]): r["n"] for r in rows}
    if labels is None:
        labels = sorted({a for a, _ in counts} | {b for _, b in counts})
    if len(rows) > most or len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels to align")
    mapping = best_alignment(counts, labels)
    if not mapping:
        return df.withColumn(out, F.lit(None).cast("int"))
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.try_element_at(m, F.col(p)).cast("int"))


# --- M13 / M14 / M18 ------------------------------------------------------------------
def per_class_counts(df: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """TP, support (true count) and predicted count per class, plus n."""
    rows = F.explode(F.array(
        F.struct(F.col(t).alias("c"), F.lit(1).alias("is_true"),
                 (F.col(t) == F.col(p)).cast("int").alias("tp"), F.lit(0).alias("is_pred")),
        F.struct(F.col(p).alias("c"), F.lit(0).alias("is_true"), F.lit(0).alias("tp"),
                 F.lit(1).alias("is_pred"))))
    g = (df.select(rows.alias("r")).select("r.*")
           .groupBy("c").agg(F.sum("is_true").alias("support"), F.sum("tp").alias("tp"),
                             F.sum("is_pred").alias("n_pred")))
    return g.withColumn("n", F.sum("support").over(Window.partitionBy()))


def _safe_ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_metrics(df: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """M13 + M14 per class: precision, recall, F1, specificity (undefined → 0)."""
    g = per_class_counts(df, t, p)
    fn = F.col("support") - F.col("tp")
    fp = F.col("n_pred") - F.col("tp")
    tn = F.col("n") - F.col("tp") - fn - fp
    prec = _safe_ratio(F.col("tp").cast("double"), F.col("n_pred"))
    rec = _safe_ratio(F.col("tp").cast("double"), F.col("support"))
    out = g.withColumns({"precision": prec, "recall": rec,
                         "specificity": _safe_ratio(tn.cast("double"), tn + fp)})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1).select(F.col("c").alias("cls"), "support", "n_pred", "tp",
                                           "precision", "recall", "f1", "specificity")


def summary_metrics(per_class: DataFrame) -> DataFrame:
    """Accuracy, macro and support-weighted precision/recall/F1, macro specificity."""
    n = F.sum("support")
    return per_class.agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"), F.avg("specificity").alias("specificity_macro"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"))


def metric_report(per_class: DataFrame, summary: DataFrame, auc: DataFrame | None = None) -> DataFrame:
    """Long report (scope, metric, percent rounded to 2; AUC rounded to 4)."""
    metrics = ["precision", "recall", "f1", "specificity"]
    pc = per_class.select(F.col("cls").cast("string").alias("scope"), *metrics).unpivot(
        ["scope"], metrics, "metric", "value")
    gcols = [c for c in summary.columns]
    gl = summary.select(F.lit("all").alias("scope"), *gcols).unpivot(["scope"], gcols, "metric", "value")
    rep = pc.unionByName(gl).withColumn("percent", F.round(F.col("value") * 100, 2))
    if auc is not None:
        a = auc.select(F.col("cls").cast("string").alias("scope"), F.lit("auc").alias("metric"),
                       F.col("auc").alias("value"), F.round(F.col("auc"), 4).alias("percent"))
        rep = rep.unionByName(a)
    return rep


# --- M16 / M17: exact ROC / AUC -----------------------------------------------------
def _score_counts(scored: DataFrame, t: str, c: str, s: str) -> DataFrame:
    """Per (class, distinct score): positives and negatives (one-vs-rest)."""
    pos = (F.col(t) == F.col(c)).cast("long")
    return (scored.groupBy(F.col(c).alias("cls"), F.col(s).alias("score"))
                  .agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")))


def score_prefix(scored: DataFrame, t: str = "y_true", c: str = "cls", s: str = "score") -> DataFrame:
    """(cls, score, pos, neg, pos_lt, neg_lt, P, N): counts strictly below each score;
    the counts are stored once, in ranges of (cls, score)."""
    out = prefix_sums(_score_counts(scored, t, c, s), ["cls"], "score", ["pos", "neg"])
    return out.withColumnsRenamed({"pos_all": "P", "neg_all": "N"})


def auc_ovr(scored: DataFrame, t: str = "y_true", c: str = "cls", s: str = "score") -> DataFrame:
    """Exact one-vs-rest AUC per class (ties count one half)."""
    pre = score_prefix(scored, t, c, s)
    g = pre.groupBy("cls").agg(
        F.sum(F.col("pos") * (F.col("neg_lt") + 0.5 * F.col("neg"))).alias("_num"),
        F.first("P").alias("P"), F.first("N").alias("N"))
    return g.select("cls", F.when((F.col("P") > 0) & (F.col("N") > 0),
                                  F.col("_num") / (F.col("P") * F.col("N"))).alias("auc"), "P", "N")


def roc_points(scored: DataFrame, t: str = "y_true", c: str = "cls", s: str = "score") -> DataFrame:
    """(cls, threshold, tpr, fpr) at every distinct score, predicting
    ``score ≥ threshold``, from the start (threshold +∞, nothing predicted) on."""
    pre = score_prefix(scored, t, c, s)
    tp = F.col("P") - F.col("pos_lt")
    fp = F.col("N") - F.col("neg_lt")
    start = pre.groupBy("cls").agg(F.max("P").alias("P"), F.max("N").alias("N")).select(
        "cls", F.lit(float("inf")).alias("threshold"), F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"), F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"))
    return pre.select("cls", F.col("score").alias("threshold"),
                      F.when(F.col("P") > 0, tp / F.col("P")).alias("tpr"),
                      F.when(F.col("N") > 0, fp / F.col("N")).alias("fpr")).unionByName(start)


def roc_points_thin(scored: DataFrame, t: str = "y_true", c: str = "cls", s: str = "score") -> DataFrame:
    """M17 without collinear points: ``roc_points`` less those where the curve goes on
    in the same direction, so every corner stays and the area is the same.

    A point lies on the line through its neighbours when the step to it and the step
    from it have parallel counts; the step from a threshold's point is the next lesser
    score's counts.  The start and each class's last point stay.
    """
    pre = score_prefix(scored, t, c, s).withColumn("_down", -F.col("score"))
    nxt = with_next(pre, ["cls"], "_down", ["pos", "neg"])
    corner = F.col("pos_next").isNull() | (F.col("pos") * F.col("neg_next") != F.col("neg") * F.col("pos_next"))
    kept = nxt.where(corner)
    share = lambda all_, lt: F.when(F.col(all_) > 0, (F.col(all_) - F.col(lt)) / F.col(all_))
    points = kept.select("cls", F.col("score").alias("threshold"), share("P", "pos_lt").alias("tpr"), share("N", "neg_lt").alias("fpr"))
    start = pre.groupBy("cls").agg(F.max("P").alias("P"), F.max("N").alias("N")).select(
        "cls", F.lit(float("inf")).alias("threshold"), F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"), F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"))
    return points.unionByName(start)


def youden(roc: DataFrame) -> DataFrame:
    """Threshold maximising TPR − FPR; ties → higher threshold (lower FPR).

    The curve's start (threshold +∞, J = 0) wins when no threshold is positive.
    """
    j = F.coalesce(F.col("tpr") - F.col("fpr"), F.lit(0.0))
    best = roc.groupBy("cls").agg(F.max(F.struct(j.alias("j"), "threshold", "tpr", "fpr")).alias("b"))
    return best.select("cls", "b.threshold", F.coalesce("b.tpr", F.lit(0.0)).alias("tpr"), F.coalesce("b.fpr", F.lit(0.0)).alias("fpr"), F.col("b.j").alias("youden_j"))
