"""A random forest that tells markers apart by sequence features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliref.functions.sequences import feature_struct
from ampliref.operators.numbering import numbered
from ampliref.schemas import require_columns
from ampliref.session import shared_path

FEATURES = ("length", "gc_content", "at_content", "gc_skew", "at_skew")


def add_features(df: DataFrame, sequence_col: str = "sequence") -> DataFrame:
    made = df.withColumn("_features", feature_struct(F.col(sequence_col)))  # read five times, so it stays a projection of its own
    return made.withColumns({k: F.col(f"_features.{k}").cast("double") for k in FEATURES}).drop("_features")


@dataclass
class Classifier:
    """importance: permutation importance where asked for, else impurity. metrics: accuracy, kappa and others on the test part; confusion: rows (label, one column per predicted label).

    test: the test part's rows with all their columns, predicted when they are asked for; measured: its label and features,
    from the table that was learned from.
    """

    model: PipelineModel
    metrics: dict[str, float]
    test: DataFrame
    measured: DataFrame
    confusion: DataFrame
    importance: dict[str, float]
    label_col: str
    features: tuple[str, ...]
    labels: tuple[str, ...]


def split(df: DataFrame, label_col: str, prop: float, seed: int, id_cols: Sequence[str]) -> DataFrame:
    """Adds _train: of each label the share prop, rounded down, drawn by a seeded hash of the row.

    The stratum's cut is the exact quantile of its hashes, counted per bucket of hashes, so no stratum is sorted in one
    task; within the bucket of the cut, rows go by their hash.
    """
    rows = df.withColumn("_draw", F.pmod(F.xxhash64(F.lit(seed), F.col(label_col), *[F.col(c) for c in id_cols]), F.lit(1 << 40))).withColumn("_bin", F.expr("_draw div (1 << 28)"))
    bins = rows.groupBy(label_col, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(label_col).orderBy("_bin")
    bins = bins.withColumns({"_below": F.sum("_n").over(up) - F.col("_n"), "_all": F.sum("_n").over(Window.partitionBy(label_col))})
    bins = bins.withColumn("_left", F.floor(F.col("_all") * F.lit(prop) + 1e-9) - F.col("_below")).select(F.col(label_col).alias("_stratum"), F.col("_bin").alias("_at"), "_n", "_left")
    both = rows.join(bins, rows[label_col].eqNullSafe(F.col("_stratum")) & (F.col("_bin") == F.col("_at")))
    cut = both.where("_left > 0 and _left < _n").withColumn("_rank", F.row_number().over(Window.partitionBy(label_col, "_bin").orderBy("_draw")))
    rest = both.where("not (_left > 0 and _left < _n)").withColumn("_rank", F.lit(0))
    return cut.unionByName(rest).withColumn("_train", F.col("_left") >= F.greatest("_rank", F.lit(1))).drop("_draw", "_bin", "_stratum", "_at", "_n", "_left", "_rank")


def train_classifier(df: DataFrame, label_col: str = "seq_type", features: Sequence[str] = FEATURES, trees: int = 500, mtry: int = 3, min_n: int = 5, prop: float = 0.8, seed: int = 123, permute: bool = False) -> Classifier:
    """Normalised features without constant ones, a random forest, and its measures on the part that wasn't learned from.

    Labels and features are made once, into a table in the shared folder that all passes of the training read; sequences
    and other columns stay out of it.
    """
    require_columns(df, [label_col, *features])
    spark, path = df.sparkSession, shared_path(df.sparkSession, "features")
    narrow = df.select(label_col, *features)
    narrow.write.parquet(path)
    whole = lambda rows: rows.where(F.col(label_col).isNotNull()).na.drop(subset=list(features))
    rows = split(whole(spark.read.schema(narrow.schema).parquet(path)), label_col, prop, seed, features).persist()
    learn, measured = rows.where("_train"), rows.where("not _train")
    steps = [
        StringIndexer(inputCol=label_col, outputCol="_label", handleInvalid="keep", stringOrderType="frequencyDesc"),
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        VarianceThresholdSelector(featuresCol="_raw", outputCol="_varied", varianceThreshold=0.0),
        StandardScaler(inputCol="_varied", outputCol="_scaled", withMean=True, withStd=True),
        RandomForestClassifier(labelCol="_label", featuresCol="_scaled", predictionCol="_prediction", probabilityCol="_probability", numTrees=trees, featureSubsetStrategy=str(min(mtry, len(features))), minInstancesPerNode=min_n, maxDepth=10, seed=seed),
    ]
    model = Pipeline(stages=steps).fit(learn)
    labels = tuple(model.stages[0].labels)
    named = IndexToString(inputCol="_prediction", outputCol="predicted", labels=[*labels, "unknown"])
    counts = named.transform(model.transform(measured)).groupBy(label_col, "predicted", "_label", "_prediction").agg(F.count(F.lit(1)).alias("n"))
    kinds, counts = counts.schema, counts.collect()  # labels squared; every measure is of them
    counted = spark.createDataFrame(counts, kinds)
    evaluate = MulticlassClassificationEvaluator(labelCol="_label", predictionCol="_prediction", weightCol="n")
    total = sum(r["n"] for r in counts) or 1
    share = lambda k, v: sum(r["n"] for r in counts if r[k] == v) / total
    agree, chance = sum(r["n"] for r in counts if r[label_col] == r["predicted"]) / total, sum(share(label_col, x) * share("predicted", x) for x in labels)
    metrics = {"accuracy": agree, "kappa": (agree - chance) / (1 - chance) if chance < 1 else 1.0}
    if counts:
        metrics |= {m: evaluate.setMetricName(m).evaluate(counted) for m in ("f1", "weightedPrecision", "weightedRecall")}
    confusion = counted.groupBy(label_col).pivot("predicted", list(labels)).agg(F.sum("n")).na.fill(0)
    kept = [features[i] for i in model.stages[2].selectedFeatures]
    test = named.transform(model.transform(split(whole(df), label_col, prop, seed, features).where("not _train")))
    fitted = Classifier(model, metrics, test, measured.select(label_col, *features), confusion, dict(zip(kept, map(float, model.stages[-1].featureImportances.toArray()))), label_col, tuple(features), labels)
    if permute:
        fitted.importance = permutation_importance(fitted, seed)
    return fitted


def permutation_importance(fitted: Classifier, seed: int = 1) -> dict[str, float]:
    """How much accuracy the test part loses when one feature's values are exchanged between rows, by a seeded order."""
    base = numbered(fitted.measured.select(*fitted.features, fitted.label_col), [F.xxhash64(*fitted.features, F.lit(seed))], "_n")
    n = base.count()
    out = {}
    for k, f in enumerate(fitted.features):
        # values move by as many places as the seed says, in an order by hash that is another one for each feature
        values = numbered(base.select(F.col(f).alias("_v"), F.col("_n").alias("_was")), [F.xxhash64("_was", F.lit(seed + k + 1)), F.col("_was")], "_n").drop("_was")
        mixed = base.drop(f).join(values, "_n").withColumnRenamed("_v", f).select(*fitted.features, fitted.label_col)
        scored = IndexToString(inputCol="_prediction", outputCol="predicted", labels=[*fitted.labels, "unknown"]).transform(fitted.model.transform(mixed))
        out[f] = fitted.metrics["accuracy"] - (scored.agg(F.avg((F.col("predicted") == F.col(fitted.label_col)).cast("double"))).first()[0] or 0.0) if n else 0.0
    return out


def classify_sequences(fitted: Classifier, df: DataFrame, confidence_threshold: float = 0.8, min_length: int = 100, sequence_col: str = "sequence", fallback: str = "other") -> DataFrame:
    """Adds predicted_label, confidence (the greatest class probability), final_label and prediction_source.

    Short sequences and those below the threshold get the fallback; whatever ends as the fallback counts as ML_low_confidence.
    """
    columns = df.columns
    # a missing sequence has no bases; it is too short for a label anyway
    shaped = add_features(df, sequence_col).na.fill(0.0, list(FEATURES)).withColumn(fitted.label_col, F.lit(fitted.labels[0]))
    scored = IndexToString(inputCol="_prediction", outputCol="predicted_label", labels=[*fitted.labels, "unknown"]).transform(fitted.model.transform(shaped))
    scored = scored.withColumn("confidence", F.array_max(vector_to_array("_probability")))
    short = F.coalesce(F.length(sequence_col), F.lit(0)) < min_length
    final = F.when(short | (F.col("confidence") < confidence_threshold), fallback).otherwise(F.col("predicted_label"))
    scored = scored.withColumn("final_label", final).withColumn("prediction_source", F.when(F.col("final_label") == fallback, "ML_low_confidence").otherwise("ML_prediction"))
    own = [c for c in columns if c != fitted.label_col]
    return scored.select(*[F.col(f"`{c}`") for c in own], "predicted_label", "confidence", "final_label", "prediction_source")
