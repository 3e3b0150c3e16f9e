"""Evaluation tables built from predictions.

Everything is derived from the long confusion table ``(actual, predicted, n)``
— K*K rows after one partial+final aggregation of the predictions — so the
metrics cost one pass over the data however large it is.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage


def accuracy(df: DataFrame, y: str = "label", p: str = "pred", by: list[str] | None = None) -> DataFrame:
    g = df.groupBy(*(by or []))
    return g.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def mse_rmse(df: DataFrame, y: str = "y", p: str = "pred", by: list[str] | None = None) -> DataFrame:
    e2 = F.pow(F.col(p) - F.col(y), 2)
    return df.groupBy(*(by or [])).agg(F.avg(e2).alias("mse"), F.sqrt(F.avg(e2)).alias("rmse"))


def confusion(df: DataFrame, y: str = "label", p: str = "pred") -> DataFrame:
    """(actual, predicted, n) over the union of seen classes, zero cells kept."""
    return confusion_grid(df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n")))


def confusion_grid(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts (by..., actual, predicted, n), zero cells filled in: K x K rows
    for the K classes seen on either side. The counts are written once; the
    classes of each group become one array, exploded twice."""
    by = list(by)
    counts = cut_lineage(counts)
    seen = (counts.select(*by, F.explode(F.array("actual", "predicted")).alias("c"))
            .groupBy(*by).agg(F.collect_set("c").alias("cs")))
    grid = seen.select(*by, F.explode("cs").alias("actual"), "cs").select(*by, "actual", F.explode("cs").alias("predicted"))
    return (grid.join(counts, [*by, "actual", "predicted"], "left")
            .select(*by, "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def per_class(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., cls, tp, support, npred, precision, recall, f1); undefined -> 0.
    Each cell counts for its row's and its column's class, in one aggregation."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("actual").alias("cls"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("npred")),
                    F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"),
                             F.col("n").alias("npred")))
    t = conf.select(*by, F.explode(sides).alias("s")).groupBy(*by, F.col("s.cls").alias("cls")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("tp", "support", "npred")])
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.withColumn("f1", f1)


def class_report(conf: DataFrame) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted rows."""
    pc = per_class(conf)
    rows = pc.select(F.col("cls").cast("string").alias("cls"), "precision", "recall", "f1",
                     F.col("support").cast("long").alias("support"))
    tot = pc.agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                 (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("cls"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                     F.col("n").cast("long").alias("support"))
    mac = tot.select(F.lit("macro avg").alias("cls"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                     F.col("mf").alias("f1"), F.col("n").cast("long").alias("support"))
    wei = tot.select(F.lit("weighted avg").alias("cls"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                     F.col("wf").alias("f1"), F.col("n").cast("long").alias("support"))
    return rows.unionByName(acc).unionByName(mac).unionByName(wei)


def f1_weighted(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    pc = per_class(conf, by)
    return pc.groupBy(*by).agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
                               (F.sum("tp") / F.sum("support")).alias("accuracy"))


def mcc(conf: DataFrame) -> DataFrame:
    """Multi-class Matthews correlation (0 when undefined)."""
    total = lambda c: F.sum(F.col(c).cast("double"))
    square = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b))
    s = per_class(conf).agg(total("support").alias("s"), square("support", "npred").alias("tp_"), square("support", "support").alias("tt"),
                            square("npred", "npred").alias("pp"), total("tp").alias("c"))
    num = F.col("c") * F.col("s") - F.col("tp_")
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return s.select(F.when(den > 0, num / den).otherwise(0.0).alias("mcc"))


def hard_vote(preds: DataFrame, id_col: str = "vec_id", p: str = "pred") -> DataFrame:
    """Majority class per id over several models' predictions; ties -> smallest class."""
    c = preds.groupBy(id_col, p).agg(F.count("*").alias("n"))
    return c.groupBy(id_col).agg(F.max_by(p, F.struct(F.col("n"), -F.col(p))).alias("pred"))


def soft_vote(probs: DataFrame, id_col: str = "vec_id", cls: str = "cls", prob: str = "prob",
              weight: str | None = None) -> DataFrame:
    """(Weighted) mean probability per (id, class), then argmax (ties -> smallest)."""
    w = F.col(weight) if weight else F.lit(1.0)
    m = probs.groupBy(id_col, cls).agg((F.sum(w * F.col(prob)) / F.sum(w)).alias("p"))
    return m.groupBy(id_col).agg(F.max_by(cls, F.struct(F.col("p"), -F.col(cls))).alias("pred"))


def softmax_group(scores: DataFrame, group: list[str], score: str = "score", out: str = "prob") -> DataFrame:
    """Max-shifted softmax over the rows of each group (a window per group;
    groups here are per-row class lists, bounded by the class count)."""
    w = Window.partitionBy(*group)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return scores.withColumn(out, e / F.sum(e).over(w))


def sample_losses(scores: DataFrame, truth: DataFrame, id_col: str = "vec_id", cls: str = "cls", score: str = "score",
                  label: str = "label", ignore_index: int | None = -100, keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep..., loss = -log softmax(score)[label]) of the kept rows. The
    log-sum is an aggregate per row's class list, joined back by the id."""
    t = truth.select(id_col, F.col(label).alias("_y"), *keep)
    if ignore_index is not None:
        t = t.filter(F.col("_y") != ignore_index)
    j = scores.join(t, id_col).groupBy(id_col, *keep).agg(
        F.max(score).alias("_m"), F.collect_list(score).alias("_s"), F.max(F.when(F.col(cls) == F.col("_y"), F.col(score))).alias("_own"))
    total = F.aggregate("_s", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("_m")))
    return j.filter(F.col("_own").isNotNull()).select(id_col, *keep, (F.col("_m") + F.log(total) - F.col("_own")).alias("loss"))


def cross_entropy(scores: DataFrame, truth: DataFrame, id_col: str = "vec_id", cls: str = "cls",
                  score: str = "score", label: str = "label", ignore_index: int | None = -100) -> DataFrame:
    """Mean of -log softmax(score)[label] over kept rows (sample-weighted)."""
    return sample_losses(scores, truth, id_col, cls, score, label, ignore_index).agg(
        F.avg("loss").alias("cross_entropy"), F.count("*").alias("n"))
