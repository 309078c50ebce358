"""Evaluation metrics as aggregates: classification, regression, weighted losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, n_classes: int | None = None) -> DataFrame:
    """Counts (y, yhat, n) of all pairs of classes, zeros too; another class is an error.
    Without a number of classes the greatest class that is there decides it."""
    if n_classes is None:
        n_classes = (pairs.agg(F.max(F.greatest("y", "yhat"))).first()[0] or 0) + 1
    inside = F.col("y").between(0, n_classes - 1) & F.col("yhat").between(0, n_classes - 1)
    counts = pairs.groupBy("y", "yhat").agg(F.count("*").alias("n"))
    counts = counts.where(F.when(inside, True).otherwise(F.raise_error(F.concat(F.lit("class out of range: "), F.to_json(F.struct("y", "yhat"))))))
    grid = pairs.sparkSession.range(n_classes * n_classes).select(F.floor(F.col("id") / n_classes).cast("int").alias("y"), (F.col("id") % n_classes).cast("int").alias("yhat"))
    return grid.join(counts, ["y", "yhat"], "left").select("y", "yhat", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of each class; null where undefined.

    A class that is there and never predicted has an F1 of 0.
    """
    k = matrix.select(F.col("y").alias("c"), "n", F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("s"), F.lit(0).alias("p"))
    k = k.unionByName(matrix.select(F.col("yhat").alias("c"), F.lit(0).alias("n"), F.lit(0).alias("hit"), F.lit(0).alias("s"), F.col("n").alias("p")))
    t = k.groupBy("c").agg(F.sum("hit").alias("hit"), F.sum("s").alias("support"), F.sum("p").alias("predicted"))
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted"))
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support"))
    f1 = F.when(F.col("support") > 0, 2 * F.col("hit") / (F.col("support") + F.col("predicted")))
    return t.select(F.col("c").alias("class"), "support", "predicted", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def classification(matrix: DataFrame) -> DataFrame:
    """accuracy, balanced_accuracy and macro_f1 (over classes with support), or 0."""
    classes = per_class(matrix).agg(F.avg("recall").alias("r"), F.avg("f1").alias("f"))
    whole = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).alias("hit"))
    both = whole.crossJoin(classes)  # one row each
    zero = F.lit(0.0)
    return both.select(F.col("n").alias("n_samples"), F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0).alias("accuracy"), F.coalesce("r", zero).alias("balanced_accuracy"), F.coalesce("f", zero).alias("macro_f1"))


def absent_classes(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Classes (class, label) that no row has."""
    return names.join(pairs.select(F.col("y").alias("class")).distinct(), "class", "left_anti")


def label_map(train: DataFrame, label: str = "label") -> DataFrame:
    """label, class (from 0, by label) and count in the training rows."""
    counts = train.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.select("label", (F.expr("row_number() over (order by label)") - 1).alias("class"), "n")


def unseen_labels(rows: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    return rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct().join(names, "label", "left_anti")


def asymmetric_score(d: Column, under: float = 13.0, over: float = 10.0) -> Column:
    """Penalty of predictions less truths; late ones cost more."""
    return F.when(d < 0, F.exp(-d / under) - 1).otherwise(F.exp(d / over) - 1)


def regression(pairs: DataFrame, *by: str, prefix: str = "", score: bool = True) -> DataFrame:
    """mae, rmse, r2 and the asymmetric score of rows (y, yhat); 0 for no rows.

    r2 of constant truths is 1 if all are met, else 0.
    """
    d = F.col("yhat") - F.col("y")
    squares, zero = F.sum(d * d), F.lit(0.0)
    spread = F.var_pop("y") * F.count("y")
    r2 = F.when(spread > 0, 1 - squares / spread).otherwise(F.when(squares == 0, 1.0).otherwise(0.0))
    return pairs.groupBy(*by).agg(
        F.count("*").alias(f"{prefix}n"),
        F.coalesce(F.avg(F.abs(d)), zero).alias(f"{prefix}mae"),
        F.coalesce(F.sqrt(F.avg(d * d)), zero).alias(f"{prefix}rmse"),
        F.when(F.count("*") > 0, r2).otherwise(0.0).alias(f"{prefix}r2"),
        *([F.coalesce(F.sum(asymmetric_score(d)), zero).alias(f"{prefix}score")] if score else []),
    )


def weighted_losses(batches: DataFrame) -> DataFrame:
    """Element-weighted losses over all batches, for each dataset and for each client.

    Batches whose loss isn't finite are counted only; those without elements add to what
    is covered and not to the loss.
    """
    good = F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") != F.lit(float("inf")))
    n = F.when(good, F.col("n_elements"))
    out = batches.groupingSets([[], ["dataset"], ["client"]], "dataset", "client").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("n_batches"),
        F.count_if(~good).alias("n_nonfinite"),
        F.coalesce(F.sum(n), F.lit(0)).alias("n_elements"),
        F.when(F.sum(n) > 0, F.sum(F.when(good, F.col("loss") * F.col("n_elements"))) / F.sum(n)).alias("loss"),
        F.count_distinct("dataset").alias("n_datasets"),
        F.avg("batch_cost").alias("cost_mean"),
        F.max("batch_cost").alias("cost_max"),
    )
    return out.select(F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "dataset").otherwise("client").alias("level"), *(c for c in out.columns if c != "level"))
