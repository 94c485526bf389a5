"""Score columns: probabilities, decisions, losses and contingency-table metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` with 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def sigmoid(logit: Column, temperature: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit / temperature))


def decide(df: DataFrame, threshold: Column, score: str = "probability") -> DataFrame:
    """Adds ``prediction``, ``correct`` and the TP/TN/FP/FN ``outcome``."""
    hit = F.col(score) >= threshold
    positive = F.col("label") == 1
    return df.withColumns({
        "prediction": hit.cast("int"),
        "correct": hit == positive,
        "outcome": F.when(positive & hit, "TP").when(~positive & ~hit, "TN").when(~positive, "FP").otherwise("FN"),
    })


def contingency(hit: Column, positive: Column, weight: Column | None = None) -> dict[str, Column]:
    """Aggregates ``tn, fp, fn, tp`` (weighted counts)."""
    w = F.lit(1) if weight is None else weight
    cells = {"tn": ~positive & ~hit, "fp": ~positive & hit, "fn": positive & ~hit, "tp": positive & hit}
    return {n: F.sum(F.when(c, w).otherwise(0)).cast("bigint").alias(n) for n, c in cells.items()}


def contingency_metrics() -> dict[str, Column]:
    """Every count-based score from columns ``tn, fp, fn, tp``."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    fpr = ratio(fp, fp + tn)
    mcc_den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    hss_den = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    # a class that is absent does not take part in the balanced accuracy
    balanced = (
        F.when(tp + fn == 0, specificity).when(tn + fp == 0, recall).otherwise((recall + specificity) / 2)
    )
    return {
        "accuracy": ratio(tp + tn, n),
        "balanced_accuracy": balanced,
        "precision": ratio(tp, tp + fp),
        "recall_pod": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": specificity,
        "false_positive_rate_fpr": fpr,
        "false_discovery_ratio_far": ratio(fp, tp + fp),
        "mcc": ratio(tp * tn - fp * fn, mcc_den),
        "hss": ratio(2 * (tp * tn - fp * fn), hss_den),
        "tss": recall - fpr,
    }


def csi() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))


def expected_random() -> Column:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return ratio((tp + fn) * (tp + fp) + (tn + fn) * (tn + fp), tn + fp + fn + tp)


def probability_bin(p: Column, bins: int) -> Column:
    """Bin number by comparison with the edges ``i * (1 / bins)``; the last bin is closed.

    The guess ``floor(p * bins)`` is corrected against the edges themselves, because the
    product may round across an edge.
    """
    width = F.lit(1.0 / bins)
    guess = F.least(F.floor(p * bins), F.lit(bins - 1))
    down = (guess * width > p) & (guess > 0)
    up = ((guess + 1) * width <= p) & (guess < bins - 1)
    return (guess + F.when(down, -1).when(up, 1).otherwise(0)).cast("int")


def log_loss(logit: Column, label: Column, pos_weight: Column | None = None) -> Column:
    """Cross-entropy from a logit, in the overflow-free form."""
    softplus_neg = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    w = F.lit(1.0) if pos_weight is None else pos_weight
    return (F.lit(1.0) - label) * logit + (F.lit(1.0) + (w - 1.0) * label) * softplus_neg


def focal_loss(p: Column, label: Column, alpha: float, gamma: float, class_alpha: bool) -> Column:
    """Focal loss; ``class_alpha`` uses ``1 - alpha`` for label 0, otherwise alpha is constant."""
    pt = F.when(label == 1, p).otherwise(F.lit(1.0) - p)
    weight = F.when((label == 1) | F.lit(not class_alpha), F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    return -weight * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * F.ln(pt)
