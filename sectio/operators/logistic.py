"""Logistic-regression head on text vectors.

A text is its character-trigram counts, hashed to ``dims`` places and scaled to
length one, all in the JVM. The fit is ``pyspark.ml``'s multinomial logistic
regression with an L2 penalty on the weights of the standardised features (not on
the intercepts; unstandardised, rare n-grams make the fit converge far too slowly); classes
are those of the training rows, in sorted order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectio.functions.text import trigrams
from sectio.operators.encoders import Encoder, embed

DIMS = 1024  # places that trigrams are hashed to
# The chosen parameters of the original head.
MAX_ITER = 200
C_INVERSE = 1.0  # inverse strength of the penalty, summed over rows


@dataclass
class Head:
    """A fitted head: class names and the underlying model."""

    labels: list[str]
    dims: int
    model: LogisticRegressionModel

    def save(self, path: str) -> None:
        """K6: model and class names, in a folder that Spark writes."""
        self.model.write().overwrite().save(f"{path}/model")
        SparkSession.active().createDataFrame([(i, c, self.dims) for i, c in enumerate(self.labels)], "i int, label string, dims int").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")


def load(spark, path: str) -> Head:
    rows = spark.read.parquet(f"{path}/labels").orderBy("i").collect()
    return Head([r.label for r in rows], rows[0].dims, LogisticRegressionModel.load(f"{path}/model"))


def vectors(df: DataFrame, text: str, dims: int, encoder: Encoder | None = None) -> DataFrame:
    """Add ``__x``, the text's vector (all zero for null or short texts); by an
    ``encoder`` instead of trigrams, if one is given. Rows that have it keep it, so
    that a table of vectors can be written once, fitted on and predicted."""
    if "__x" in df.columns:
        return df
    if encoder is not None:
        held = embed(df, text, encoder, "__v")
        return held.withColumn("__x", array_to_vector(F.coalesce("__v", F.array_repeat(F.lit(0.0), dims)))).drop("__v")
    held = df.withColumn("__g", F.coalesce(trigrams(F.col(text)), F.array().cast("array<string>")))
    counted = HashingTF(inputCol="__g", outputCol="__tf", numFeatures=dims).transform(held)
    return Normalizer(inputCol="__tf", outputCol="__x").transform(counted).drop("__g", "__tf")


def fit(train: DataFrame, text: str, label: str, dims: int = DIMS, c: float = C_INVERSE, max_iter: int = MAX_ITER, tol: float = 1e-7, encoder: Encoder | None = None) -> Head:
    """Fit on the rows with a label. The class list is bounded by the label set
    and is the only thing collected besides the model."""
    rows = train.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    labels = sorted(counts)
    if not labels:
        raise ValueError("no labelled rows to fit on")
    number = F.coalesce(*(F.when(F.col(label) == name, F.lit(float(i))) for i, name in enumerate(labels)))
    dims = dims if encoder is None else encoder.dims
    own = "__x" if "__x" in rows.columns else text
    ready = vectors(rows.select(own, number.alias("__y")), text, dims, encoder).select("__x", "__y")
    lr = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=max_iter, tol=tol, family="multinomial", standardization=True,
                            regParam=1.0 / (c * sum(counts.values())), elasticNetParam=0.0)
    return Head(labels, dims, lr.fit(ready))


def predict(rows: DataFrame, head: Head, text: str, encoder: Encoder | None = None) -> DataFrame:
    """Add ``predicted``, ``prob`` (its probability) and ``probabilities`` (map of
    all classes) to every row; the first class in sorted order wins ties."""
    scored = head.model.setFeaturesCol("__x").setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__n").transform(vectors(rows, text, head.dims, encoder))
    p = vector_to_array("__p")
    names = F.array(*(F.lit(x) for x in head.labels))
    best = F.array_position(p, F.array_max(p)).cast("int")
    return (scored.withColumn("probabilities", F.map_from_arrays(names, p)).withColumn("prob", F.array_max(p))
            .withColumn("predicted", F.element_at(names, best)).drop("__x", "__p", "__r", "__n"))
