"""Error mining: a sparse text classifier fitted on the cluster, its confident errors, and the examples that are hard for any reason."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import statistics as st
from .staging import staged, unstage


def terms_of(text: str, stop: list[str]):
    """Lower-cased runs of two word characters and more that are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


@dataclass
class TextClassifier:
    """Weights over the commonest terms: what ``fit_texts`` returns."""

    vocabulary: list[str]
    idf: list[float]
    model: LogisticRegressionModel
    stop: list[str]

    def vectors(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with features_: counts of terms times their weight, each document's of length 1."""
        counted = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="terms_", outputCol="counts_").transform(docs.withColumn("terms_", terms_of(text, self.stop)))
        weighed = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="counts_", outputCol="weighed_").transform(counted)
        return Normalizer(p=2.0, inputCol="weighed_", outputCol="features_").transform(weighed).drop("terms_", "counts_", "weighed_")

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with p_yes, the probability of class 1."""
        out = self.model.transform(self.vectors(docs, text)).withColumn("p_yes", vector_to_array("probability")[1])
        return out.drop("features_", "rawPrediction", "probability", "prediction")


def fit_texts(train: DataFrame, y: str = "y", text: str = "text", terms: int = 5000, penalty: float = 1.0, stop: list[str] | None = None, rounds: int = 200, tolerance: float = 1e-9) -> TextClassifier:
    """A logistic regression of y (0 or 1) on the normalised TF-IDF of the ``terms`` commonest terms, classes weighed as if equally common.

    Minimised is half the squared weights plus ``penalty`` times the weighed losses; the intercept is free. Terms are counted by documents
    first, and only the chosen ones come to the driver. A document's vector is sparse and made once, into a table; each round of the fit is
    one tree of sums over it. Without documents of both classes a ValueError is raised.
    """
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop is None else stop
    docs = train.where(F.col(y).isin(0, 1)).select(F.col(y).cast("double").alias("y_"), F.col(text).alias("text_"))
    sizes = {int(r.y_): r["count"] for r in docs.groupBy("y_").count().collect()}
    if len(sizes) < 2:
        raise ValueError("the fit needs documents of both classes")
    n = sum(sizes.values())
    words = docs.select(terms_of("text_", stop).alias("terms"))
    every = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    once = words.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    chosen = every.join(once, "term").orderBy(F.desc("n"), "term").limit(terms).collect()
    if not chosen:
        raise ValueError("the documents have no terms")
    model = TextClassifier([r.term for r in chosen], [math.log((1 + n) / (1 + r.df)) + 1 for r in chosen], None, stop)
    weight = F.when(F.col("y_") == 1, n / (2 * sizes[1])).otherwise(n / (2 * sizes[0]))
    vectors = staged(model.vectors(docs, "text_").select("y_", "features_", weight.alias("weight_")), "vectors")
    regression = LogisticRegression(labelCol="y_", featuresCol="features_", weightCol="weight_", regParam=1 / (penalty * n), elasticNetParam=0.0, standardization=False, maxIter=rounds, tol=tolerance, aggregationDepth=3)
    model.model = regression.fit(vectors)
    unstage(vectors)
    return model


def confident_errors(train: DataFrame, dev: DataFrame, positive: str, negative: str, label: str = "doc_label", text: str = "text", least: float = 0.8, **fit) -> DataFrame:
    """dev's documents of the two labels with predicted, confidence (that of the predicted label) and confident_error: wrong, and surer than
    ``least``."""
    y = F.when(F.col(label) == positive, 1).when(F.col(label) == negative, 0)
    model = fit_texts(train.withColumn("y_", y), "y_", text, **fit)
    told = model.predict(dev.where(F.col(label).isin(positive, negative)), text)
    predicted = F.when(F.col("p_yes") > 0.5, positive).otherwise(negative)
    confidence = F.greatest("p_yes", 1 - F.col("p_yes"))
    return told.select(*dev.columns, predicted.alias("predicted"), confidence.alias("confidence"), ((predicted != F.col(label)) & (confidence > least)).alias("confident_error"))


def hard_examples(docs: DataFrame, spans: DataFrame, errors: DataFrame, overlap: float = 0.7, entropy: float = 1.5, key: str = "doc_id", source: str = "source", label: str = "doc_label") -> DataFrame:
    """Documents that are hard, with reasons in this order: an Action and an Effect that overlap by more than ``overlap``, a source
    whose labels have more than ``entropy`` bits, a confident error of the classifier (rows of ``confident_errors``)."""
    near = st.max_pair_iou(spans.where("label = 'Action'"), spans.where("label = 'Effect'"), key).where(F.col("max_iou") > overlap)
    near = near.select(key, F.lit(1).alias("at"), F.concat(F.lit("High Action/Effect IoU ("), F.format_number("max_iou", 2), F.lit(")")).alias("reason"))
    mixed = st.label_entropy(docs, source, label).where(F.col("entropy") > entropy).select(F.col(source).alias("source_"), "entropy")  # a row for each source
    mixed = docs.join(mixed, docs[source].eqNullSafe(mixed["source_"])).select(key, F.lit(2).alias("at"), F.concat(F.lit("High Source Entropy ("), F.format_number("entropy", 2), F.lit(")")).alias("reason"))
    wrong = errors.where("confident_error").select(key, F.lit(3).alias("at"), F.concat(F.lit("Baseline Confident Error (Conf: "), F.format_number("confidence", 2), F.lit(")")).alias("reason"))
    every = near.unionByName(mixed).unionByName(wrong)
    return every.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "reason"))), lambda r: r["reason"]).alias("reasons"))


def fit_temperature(df: DataFrame, low: float = 0.05, high: float = 5.0, tolerance: float = 1e-5, points: int = 9) -> tuple[float, float]:
    """The temperature between low and high at which rows (y, logit) have the least mean negative log likelihood, and that mean.

    As a function of 1/T it is convex, so the bracket shrinks to the neighbours of the best of ``points`` inner points, each round
    one aggregate of that many sums. Rows without a logit or a label of 0 or 1 do not count.
    """
    sign = F.when(F.col("y") == 1, F.col("logit")).otherwise(-F.col("logit"))
    rows = df.where(F.col("logit").isNotNull() & F.col("y").isin(0, 1)).select(sign.cast("double").alias("z"))
    a, b = 1 / high, 1 / low
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    while True:
        grid = [a + (b - a) * i / (points + 1) for i in range(points + 2)]
        means = rows.agg(*(F.avg(softplus(-F.col("z") * g)) for g in grid)).first()
        if means[0] is None:
            raise ValueError("no rows with a label and a logit")
        best = min(range(len(grid)), key=lambda i: means[i])
        a, b = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
        if 1 / a - 1 / b < tolerance:
            return 1 / grid[best], means[best]
