"""Evaluation, calibration grids, normalisers and transition statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra import constants as K


def confusion(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts by truth and prediction."""
    return rows.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each class; empty denominators give 0."""
    c = confusion(rows, truth, pred)
    t = c.groupBy(F.col("truth").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, "cls", "full").select("cls", *[F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in ("support", "tp", "predicted")])
    precision, recall = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return j.select("cls", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.col("support").cast("long").alias("support"))


def summary(rows: DataFrame, truth: str, pred: str, weights: Column | None = None) -> DataFrame:
    """Accuracy, (weighted) macro F1 over classes with support, majority baseline and gain."""
    w = F.lit(1.0) if weights is None else weights
    r = per_class(rows, truth, pred).where("support > 0").withColumn("w", w)
    macro = r.agg((F.sum(F.col("f1") * F.col("w")) / F.sum("w")).alias("macro_f1"), (F.max("support") / F.sum("support")).alias("baseline"))
    acc = rows.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))
    return acc.crossJoin(macro).select("accuracy", "macro_f1", "baseline", (F.col("accuracy") - F.col("baseline")).alias("gain"))  # one row each


def collapse_standing(c: Column) -> Column:
    """Both standing classes count as one in evaluation."""
    return F.when(c == "standing and moving", "standing in place").otherwise(c)


def grid_min(rows: DataFrame, grid: list[float], loss) -> DataFrame:
    """The first grid value of least mean loss: one average for each value in a single aggregate, so
    rows are neither multiplied nor shuffled.  Both columns are null without rows."""
    means = rows.agg(F.array(*[F.struct(F.avg(loss(F.lit(float(g)))).alias("loss"), F.lit(float(g)).alias("value")) for g in grid]).alias("all"))
    best = means.select(F.array_min(F.filter("all", lambda x: x["loss"].isNotNull())).alias("m"))
    return best.select(F.col("m.value").alias("value"), F.col("m.loss").alias("loss"))


def fit_alpha(rows: DataFrame, ml: Column, physics: Column) -> DataFrame:
    """M9: mixing weight on 101 points by cross-entropy of the true class's two probabilities."""
    grid = [i / 100 for i in range(101)]
    return grid_min(rows, grid, lambda a: -F.ln(F.greatest(a * ml + (1.0 - a) * physics, F.lit(1e-12))))


def fit_temperature(rows: DataFrame, logit_true: Column, logits: Column) -> DataFrame:
    """Temperature on 31 points of [0.5, 2] by negative log likelihood."""
    grid = [0.5 + 0.05 * i for i in range(31)]

    def loss(t: Column) -> Column:
        e = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x / t))
        return F.ln(e) - logit_true / t

    return grid_min(rows, grid, loss)


def fit_thresholds(rows: DataFrame, features: dict[str, Column], truth: str, grids: dict[str, list[float]], passes: int = 8, weights: dict[str, float] | None = None) -> tuple[dict[str, float], float]:
    """M4: coordinate ascent of the rules' constants; one Spark job scores all values of a constant."""
    from kinetra.functions.columns import label_activity

    weights = weights or {}
    best, value = dict(K.THRESHOLDS), -1.0
    for _ in range(passes):
        before = value
        for name, grid in grids.items():
            tries = [(g, label_activity(features, best | {name: g})) for g in dict.fromkeys([best[name], *grid])]
            exploded = rows.select(F.col(truth).alias("t"), F.explode(F.array(*[F.struct(F.lit(float(g)).alias("g"), p.alias("p")) for g, p in tries])).alias("x")).select("t", "x.g", "x.p")
            counts = exploded.groupBy("g", "t", "p").count().collect()  # values x classes squared
            for g, _ in tries:
                own = {(r["t"], r["p"]): r["count"] for r in counts if r["g"] == float(g)}
                total = weight = 0.0
                for c in {t for t, _ in own}:
                    tp, sup, pred = own.get((c, c), 0), sum(n for (t, _), n in own.items() if t == c), sum(n for (_, p), n in own.items() if p == c)
                    w = weights.get(c, 1.0)
                    total, weight = total + w * 2 * tp / max(1, sup + pred), weight + w
                if weight and total / weight > value + 1e-12:
                    value, best = total / weight, best | {name: g}
        if value <= before + 1e-12:
            break
    return best, value


def robust_normaliser(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Median and scale of each column: IQR / 1.349, else the deviation, else 1."""
    parts = []
    for c in columns:
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        parts.append(F.struct(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_pop(x).alias("s")).alias(c))
    one = rows.agg(*parts)
    told = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}.q").alias("q"), F.col(f"{c}.s").alias("s")) for c in columns])).alias("x")).select("x.*")
    iqr = (F.element_at("q", 3) - F.element_at("q", 1)) / 1.349
    return told.select("channel", F.element_at("q", 2).alias("median"), F.when(iqr > 0, iqr).when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("scale"))


def normalise(x: Column, median: Column, scale: Column, clip: float = 5.0) -> Column:
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), (x - median) / scale))


def impute_median(rows: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Null and NaN become the exact median of the column (0 if it has none)."""
    clean = rows.select("*", *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"__{c}") for c in columns])
    medians = clean.groupBy(*(keys or [])).agg(*[F.median(f"__{c}").alias(f"__m_{c}") for c in columns])
    joined = clean.join(medians, keys) if keys else clean.crossJoin(F.broadcast(medians))  # one row
    return joined.select(*[F.coalesce(f"__{c}", f"__m_{c}", F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def prior_transitions(spark, classes: tuple[str, ...] = K.CLASSES) -> DataFrame:
    """G1: ``(from, to, p)`` from the fixed weights."""
    rows = []
    for a in classes:
        for b in classes:
            if a != b and (a, b) not in K.TRANSITION_WEIGHTS and (b, a) not in K.TRANSITION_WEIGHTS:
                raise ValueError(f"no weight for {a} and {b}")
            rows.append((a, b, K.SELF_WEIGHT if a == b else K.TRANSITION_WEIGHTS.get((a, b), K.TRANSITION_WEIGHTS.get((b, a)))))
    df = spark.createDataFrame(rows, "`from` string, `to` string, w double")
    return df.select("from", "to", (F.col("w") / F.sum("w").over(W.partitionBy("from"))).alias("p"))


def transition_pairs(rows: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Consecutive pairs; a null label breaks the chain."""
    prev = F.lag(label).over(W.partitionBy(*keys).orderBy(*order))
    return rows.select(prev.alias("from"), F.col(label).alias("to")).where("`from` is not null and `to` is not null").groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))


def blend_transitions(counts: DataFrame, prior: DataFrame, least: int = K.MIN_COUNTS, pseudo: float = K.PSEUDO) -> DataFrame:
    """Rows with fewer than ``least`` pairs keep the prior; others are counts plus ``pseudo`` x prior."""
    total = counts.groupBy("from").agg(F.sum("n").alias("row_n"))
    j = prior.join(counts, ["from", "to"], "left").join(total, "from", "left").fillna(0, ["n", "row_n"])
    p = F.when(F.col("row_n") < least, F.col("p")).otherwise((F.col("n") + pseudo * F.col("p")) / (F.col("row_n") + pseudo))
    return j.select("from", "to", p.alias("p"), F.when(F.col("row_n") < least, "prior").otherwise("blended").alias("source"), F.col("row_n").cast("long").alias("row_n"))
