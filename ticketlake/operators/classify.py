"""Text classification: TF-IDF features and multinomial logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.operators.features import TfidfVocabulary

TOLERANCE = 1e-4
TASKS_PER_CORE = 4


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return counts.withColumn("weight", totals["rows"] / (totals["classes"] * F.col("n")))


def label_encode(df: DataFrame, label: str) -> DataFrame:
    """Classes numbered from 0 in alphabetical order."""
    indexer = StringIndexer(inputCol=label, outputCol="code", stringOrderType="alphabetAsc")
    return indexer.fit(df).transform(df).withColumn("code", F.col("code").cast("int"))


class TicketClassifier:
    """A fitted vocabulary with its model; ``predict`` adds label, confidence and class scores."""

    def __init__(self, words: TfidfVocabulary, model: PipelineModel):
        self.words, self.model = words, model

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        label: str,
        text: str = "description",
        c: float = 1.0,
        max_iter: int = 1000,
        balanced: bool = False,
        words: TfidfVocabulary | None = None,
        features: DataFrame | None = None,
        rows_per_task: int = 2_000,
    ) -> "TicketClassifier":
        """``words`` and ``features`` of the same rows may be shared between targets.

        Every iteration is a job in which each task sends sums as large as the model, so rows are cut into few tasks:
        of ``rows_per_task``, and no more than ``TASKS_PER_CORE`` for each core, however many rows there are.
        """
        if features is None:
            words = words or TfidfVocabulary.fit(train, text)
            features = words.vectors(train.select(text, label), text)
        rows = features.select("features", F.col(label).alias("truth"))
        n_rows = rows.count()
        most = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
        if balanced:  # a row for each class; rows are not dealt by class, as few tasks would then hold them all
            rows = rows.join(F.broadcast(class_weights(rows, "truth").select("truth", "weight")), "truth")
        rows = rows.coalesce(min(-(-n_rows // rows_per_task), most) or 1)
        regression = LogisticRegression(
            featuresCol="features",
            labelCol="code",
            family="multinomial",
            regParam=1.0 / (c * n_rows),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
            tol=TOLERANCE,
            **({"weightCol": "weight"} if balanced else {}),
        )
        indexer = StringIndexer(inputCol="truth", outputCol="code", stringOrderType="alphabetAsc").fit(rows)
        decoder = IndexToString(inputCol="prediction", outputCol="label", labels=indexer.labels)
        return cls(words, Pipeline(stages=[indexer, regression, decoder]).fit(rows))

    @property
    def labels(self) -> list[str]:
        return self.model.stages[0].labels

    def score(self, features: DataFrame, prefix: str) -> DataFrame:
        """Adds ``<prefix>``, ``<prefix>_confidence`` and ``<prefix>_scores`` to rows with features."""
        scoring = PipelineModel(self.model.stages[1:])
        probabilities = vector_to_array(F.col("probability"))
        classes = F.array(*[F.lit(x) for x in self.labels])
        return (
            scoring.transform(features)
            .withColumn("_probabilities", probabilities)
            .withColumn(f"{prefix}_scores", F.map_from_arrays(classes, F.transform("_probabilities", lambda x: F.round(x, 3))))
            .withColumn(f"{prefix}_confidence", F.round(F.array_max("_probabilities"), 3))
            .withColumnRenamed("label", prefix)
            .drop("rawPrediction", "probability", "prediction", "_probabilities")
        )

    def predict(self, df: DataFrame, prefix: str, text: str = "description") -> DataFrame:
        return self.score(self.words.vectors(df, text), prefix).drop("features")

    def save(self, path: str) -> None:
        self.words.terms.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TicketClassifier":
        terms = spark.read.parquet(f"{path}/vocabulary")
        return cls(TfidfVocabulary(terms, terms.count()), PipelineModel.load(f"{path}/model"))
