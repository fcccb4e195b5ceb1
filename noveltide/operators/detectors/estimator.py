"""Detectors as pipeline stages: fit on a table, score, classify, save, and load in another session."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide import session
from noveltide.operators.detectors import forests, learned
from noveltide.operators.detectors.common import map_scores
from noveltide.operators.pivots import matrix
from noveltide.operators.quantiles import column_quantiles

Arrays = dict[str, np.ndarray]


def _pack_forest(f: forests.Forest) -> Arrays:
    parts = {p: np.concatenate([getattr(t, p) for t in f.trees]) for p in ("feature", "threshold", "left", "right", "path")}
    return parts | {"edge": np.cumsum([0, *(len(t.feature) for t in f.trees)]), "sample": np.array([f.sample])}


def _unpack_forest(a: Arrays) -> forests.Forest:
    cut = [slice(i, j) for i, j in zip(a["edge"][:-1], a["edge"][1:], strict=True)]
    return forests.Forest([forests.Tree(*(a[p][s] for p in ("feature", "threshold", "left", "right", "path"))) for s in cut], int(a["sample"][0]))


#: Algorithms: (fit a table to arrays, arrays to a scorer of feature matrices).
ALGORITHMS: dict[str, tuple[Callable[[DataFrame, int, dict], Arrays], Callable[[Arrays], Callable[[np.ndarray], np.ndarray]]]] = {
    "PCA": (lambda df, seed, options: learned.fit_pca(df, **options)._asdict(), lambda a: learned.Pca(**a).score),
    "IForest": (lambda df, seed, options: _pack_forest(forests.fit_forest(df, seed=seed, **options)), lambda a: _unpack_forest(a).score),
    "LODA": (lambda df, seed, options: learned.fit_loda(df, seed=seed, **options)._asdict(), lambda a: learned.Loda(**a).score),
}


class _DetectorParams(HasFeaturesCol, HasPredictionCol, HasSeed):
    algorithm = Param(Params._dummy(), "algorithm", "PCA, IForest or LODA", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "the algorithm's options, as JSON", TypeConverters.toString)
    contamination = Param(Params._dummy(), "contamination", "share of the training rows over the threshold", TypeConverters.toFloat)
    scoreCol = Param(Params._dummy(), "scoreCol", "column of the scores", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "column of the probability of being anomalous", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(featuresCol="features", predictionCol="prediction", scoreCol="score", probabilityCol="p_anomaly", algorithm="IForest", options="{}", contamination=0.1, seed=42)


class Detector(Estimator, _DetectorParams, DefaultParamsWritable, DefaultParamsReadable):
    """An anomaly detector to fit on a table with `row_id` and a vector column (array of numbers).

    `Detector(algorithm="PCA", contamination=0.05).fit(df)` gives a `DetectorModel`. The threshold is the exact quantile 1 - contamination of the
    training rows' scores; their least and greatest score make the probability.
    """

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _fit(self, df: DataFrame) -> DetectorModel:
        name = self.getOrDefault(self.algorithm)
        if name not in ALGORITHMS:
            raise ValueError(f"no algorithm {name!r}; there are {', '.join(sorted(ALGORITHMS))}")
        train = df.select("row_id", F.col(self.getFeaturesCol()).cast("array<double>").alias("features"))
        arrays = {k: np.asarray(v) for k, v in ALGORITHMS[name][0](train, self.getSeed(), json.loads(self.getOrDefault(self.options))).items()}
        scored = session.materialize(map_scores(train, ALGORITHMS[name][1](arrays)), "training-scores")
        low, high = scored.agg(F.min("score"), F.max("score")).first()
        cut = column_quantiles(scored, F.col("score"), [1 - self.getOrDefault(self.contamination)]).first().q[0]
        model = DetectorModel(arrays | {"ends": np.array([low, high, cut], "f8")})
        return self._copyValues(model)


class DetectorModel(Model, _DetectorParams, MLWritable, MLReadable):
    """A fitted detector: `transform` adds the score, the probability (score between the training rows' least and greatest, 0 to 1) and the prediction (1 above the threshold)."""

    def __init__(self, arrays: Arrays | None = None):
        super().__init__()
        self._defaults()
        self.arrays = arrays or {}

    @property
    def threshold(self) -> float:
        return float(self.arrays["ends"][2])

    def _transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        session.ship(spark)
        arrays = {k: v for k, v in self.arrays.items() if k != "ends"}
        make, sent = ALGORITHMS[self.getOrDefault(self.algorithm)][1], spark.sparkContext.broadcast(arrays)

        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            score = make(sent.value)
            for x in batches:
                yield pa.array(score(matrix(x)) if len(x) else [], pa.float64())

        of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        low, high, cut = map(float, self.arrays["ends"])
        s, p, y = self.getOrDefault(self.scoreCol), self.getOrDefault(self.probabilityCol), self.getPredictionCol()
        out = df.withColumn(s, F.arrow_udf(of, "double")(F.col(self.getFeaturesCol()).cast("array<double>")))
        share = F.least(F.greatest((F.col(s) - low) / (high - low + 1e-10), F.lit(0.0)), F.lit(1.0))
        return out.withColumns({p: share, y: (F.col(s) > cut).cast("int")})

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: DetectorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        rows = [(k, v.dtype.str, list(v.shape), bytearray(np.ascontiguousarray(v).tobytes())) for k, v in self.model.arrays.items()]
        spark.createDataFrame(rows, "name string, kind string, shape array<int>, data binary").coalesce(1).write.parquet(f"{path}/arrays")


class _Reader(MLReader):
    def load(self, path: str) -> DetectorModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark, "noveltide.operators.detectors.estimator.DetectorModel")
        rows = spark.read.parquet(f"{path}/arrays").collect()  # a row an array of the model
        model = DetectorModel({r.name: np.frombuffer(bytes(r.data), np.dtype(r.kind)).reshape(r.shape) for r in rows})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
