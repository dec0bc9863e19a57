"""Comparison of classifiers by their predicted probabilities."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.functions.distributions import chi2_sf, norm_ppf
from clinloom.operators.quantiles import quantiles
from clinloom.operators.scan import running_sum


def stack(df: DataFrame, target: str, models: list[str], as_probability: bool | list[str] = False) -> DataFrame:
    """(model, y, p) without missing targets or predictions. Models beyond [0, 1] raise, or are scaled to it if asked for."""
    ends = df.agg(*[f(F.col(f"`{m}`").cast("double")).alias(f"{f.__name__}{i}") for i, m in enumerate(models) for f in (F.min, F.max)]).first()
    entry = []
    for i, m in enumerate(models):
        lo, hi, x = ends[f"min{i}"], ends[f"max{i}"], F.col(f"`{m}`").cast("double")
        beyond = lo is not None and (lo < 0 or hi > 1)
        scale = beyond if as_probability is True else m in as_probability if isinstance(as_probability, (list, tuple)) else False
        if scale:
            x = (x - lo) / (hi - lo)
        elif beyond:
            raise ValueError(f"{m} goes beyond 0 to 1")
        entry.append(F.struct(F.lit(m).alias("model"), x.alias("p")))
    y = F.col(f"`{target}`")
    return df.where(y.isNotNull()).select(y.cast("int").alias("y"), F.explode(F.array(*entry)).alias("e")).select("e.model", "y", "e.p").where(F.col("p").isNotNull())


def roc_table(stacked: DataFrame) -> DataFrame:
    """model, threshold, tp, fp, P, N: what p >= threshold finds, at each distinct p."""
    cells = stacked.groupBy("model", F.col("p").alias("threshold")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    run = running_sum(cells, ["model"], "threshold", ["pos", "neg"], descending=True)
    total = cells.groupBy(F.col("model").alias("_m")).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return run.join(total, F.col("model") == F.col("_m")).select("model", "threshold", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "P", "N")


def pr_curve(stacked: DataFrame) -> DataFrame:
    return roc_table(stacked).select("model", "threshold", (F.col("tp") / F.col("P")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def dca(stacked: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """model, threshold, net_benefit, treat_all: over a fixed list of thresholds, one pass."""
    thresholds = thresholds or [round(0.01 * i, 2) for i in range(1, 100)]
    aggs = [F.count_if((F.col("p") >= t) & (F.col("y") == 1)).alias(f"tp{i}") for i, t in enumerate(thresholds)] + [F.count_if((F.col("p") >= t) & (F.col("y") == 0)).alias(f"fp{i}") for i, t in enumerate(thresholds)]
    g = stacked.groupBy("model").agg(F.count("*").alias("n"), F.sum("y").alias("P"), *aggs)
    n, share = F.col("n"), F.col("P") / F.col("n")
    rows = [F.struct(F.lit(t).alias("threshold"), (F.col(f"tp{i}") / n - F.col(f"fp{i}") / n * (t / (1 - t))).alias("net_benefit"), (share - (1 - share) * (t / (1 - t))).alias("treat_all")) for i, t in enumerate(thresholds)]
    return g.select("model", F.explode(F.array(*rows)).alias("r")).select("model", "r.*")


def calibration(stacked: DataFrame, bins: int = 10) -> DataFrame:
    """model, bin, n, predicted, observed over bins of equal width."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return stacked.groupBy("model", b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))


def _hosmer_lemeshow(stacked: DataFrame, groups: int = 10) -> dict[str, float]:
    """By model the p-value over groups of predicted probability, cut at quantiles."""
    q = quantiles(stacked, {"p": F.col("p")}, [i / groups for i in range(1, groups)], ["model"]).select(F.col("model").alias("_m"), F.col("q_p").alias("q"))
    g = stacked.join(q, F.col("model") == F.col("_m")).withColumn("g", F.size(F.filter("q", lambda v: v < F.col("p"))))
    cells = g.groupBy("model", "g").agg(F.count("*").alias("n"), F.sum("y").alias("o"), F.sum("p").alias("e"))
    part = F.pow(F.col("o") - F.col("e"), 2) / (F.col("e") * (1 - F.col("e") / F.col("n")))
    out = cells.groupBy("model").agg(F.sum(F.when(F.col("e") > 0, part)).alias("x"), F.count("*").alias("k")).collect()
    return {r["model"]: chi2_sf(r["x"], r["k"] - 2) if r["k"] > 2 and r["x"] is not None else math.nan for r in out}


def _auc_parts() -> dict:
    """Sums over the table of thresholds from which the AUC and its standard error (DeLong) follow: each distinct p's share of the other class below it."""
    below_neg = (F.col("N") - F.col("fp") + F.col("neg") / 2) / F.col("N")  # for cases here
    above_pos = (F.col("tp") - F.col("pos") / 2) / F.col("P")  # for controls here
    return {"auc": F.sum(F.col("pos") * below_neg) / F.first("P"), "s10": F.sum(F.col("pos") * below_neg**2), "s01": F.sum(F.col("neg") * above_pos**2)}


def _with_limits(g: DataFrame, level: float = 0.95) -> DataFrame:
    v10 = (F.col("s10") - F.col("P") * F.col("auc") ** 2) / (F.col("P") - 1)
    v01 = (F.col("s01") - F.col("N") * F.col("auc") ** 2) / (F.col("N") - 1)
    g = g.withColumn("se", F.sqrt(F.greatest(v10 / F.col("P") + v01 / F.col("N"), F.lit(0.0))))
    z = norm_ppf(0.5 + level / 2)
    return g.withColumns({"lower": F.greatest(F.col("auc") - z * F.col("se"), F.lit(0.0)), "upper": F.least(F.col("auc") + z * F.col("se"), F.lit(1.0))}).drop("s10", "s01")


def auc_table(stacked: DataFrame, level: float = 0.95) -> DataFrame:
    """model, auc, se (DeLong), lower, upper."""
    g = roc_table(stacked).groupBy("model", "P", "N").agg(*[v.alias(k) for k, v in _auc_parts().items()])
    return _with_limits(g, level).select("model", "auc", "se", "lower", "upper")


def _prauc_part():
    """The trapezoid area under precision by recall: what lies between each distinct p and the one above it."""
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    before = F.when(tp + fp > pos + neg, (tp - pos) / (tp + fp - pos - neg))
    return F.sum(F.when(before.isNotNull(), pos / F.col("P") * (tp / (tp + fp) + before) / 2))


def classif_metrics(stacked: DataFrame, digits: int | None = None) -> DataFrame:
    """model, auc, lower, upper, prauc, accuracy, sensitivity, specificity, ppv, npv, f1, kappa, brier, cutoff, youden.

    The cutoff has the highest Youden index, the largest of ties; p >= cutoff is a case.
    """
    t = roc_table(stacked).withColumn("j", F.col("tp") / F.col("P") - F.col("fp") / F.col("N"))
    top = F.max(F.struct(F.round("j", 12).alias("_j"), "threshold", "tp", "fp", "j")).alias("b")
    one = t.groupBy("model", "P", "N").agg(*[v.alias(k) for k, v in _auc_parts().items()], _prauc_part().alias("prauc"), top)
    best = _with_limits(one).select("model", "P", "N", "auc", "lower", "upper", "prauc", "b.*")
    tp, fp, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "P", "N"))
    fn, tn, all_ = p - tp, n - fp, p + n
    acc = (tp + tn) / all_
    chance = ((tp + fp) * p + (fn + tn) * n) / (all_ * all_)
    m = best.select("model", "auc", "lower", "upper", "prauc", acc.alias("accuracy"), (tp / p).alias("sensitivity"), (tn / n).alias("specificity"), (tp / (tp + fp)).alias("ppv"), (tn / (tn + fn)).alias("npv"), (2 * tp / (2 * tp + fp + fn)).alias("f1"), ((acc - chance) / (1 - chance)).alias("kappa"), F.col("threshold").alias("cutoff"), F.col("j").alias("youden"))
    brier = stacked.groupBy("model").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    out = m.join(brier, "model").select("model", "auc", "lower", "upper", "prauc", "accuracy", "sensitivity", "specificity", "ppv", "npv", "f1", "kappa", "brier", "cutoff", "youden")
    return out if digits is None else out.select("model", *[F.round(c, digits).alias(c) for c in out.columns if c != "model"])


def classif_model_compare(df: DataFrame, target: str, models: list[str], as_probability: bool | list[str] = False, auto_order: bool = True) -> tuple[pd.DataFrame, dict[str, DataFrame]]:
    """The table of metrics (with Hosmer-Lemeshow p), best AUC first, and the ROC, PR, decision and calibration curves."""
    s = stack(df, target, models, as_probability)
    table = classif_metrics(s).toPandas()
    hl = _hosmer_lemeshow(s)
    table["hl_p"] = table["model"].map(hl)
    order = table.sort_values("auc", ascending=False).index if auto_order else table["model"].map({m: i for i, m in enumerate(models)}).sort_values().index
    roc = roc_table(s).select("model", "threshold", (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr"))
    return table.loc[order].reset_index(drop=True), {"roc": roc, "pr": pr_curve(s), "dca": dca(s), "calibration": calibration(s)}


def importance_plot(scores: dict[str, float], top_n: int | None = None, digits: int = 2, scientific: bool = True) -> pd.DataFrame:
    """name, value, label: the largest first; what is beyond top_n shows as one row without a value."""
    order = sorted(scores.items(), key=lambda kv: -kv[1])
    show = (lambda v: f"{v:.{digits - 1}e}") if scientific else (lambda v: f"{v:.{digits}g}")
    cut = len(order) if top_n is None else top_n
    rows = [(k, v, show(v)) for k, v in order[:cut]]
    if cut < len(order):
        rows.append(("...", None, "..."))
    return pd.DataFrame(rows, columns=["name", "value", "label"])
