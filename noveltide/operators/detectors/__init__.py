"""Detectors by name. Each takes (test, train, **options), tables of row_id and features, and returns (row_id, score)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide.operators.detectors import adversarial, forests, learned, nets, tabular
from noveltide.operators.detectors.common import SAMPLE_ROWS, map_scores, matrix
from noveltide.operators.prep import hash_order


def _transductive(detect: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For detectors that score the table they're fitted on: the test table."""
    return lambda test, train, **options: detect(test, **options)


def devnet(test: DataFrame, train: DataFrame, label_col: str = "label", sample_rows: int = SAMPLE_ROWS, **options) -> DataFrame:
    """The one supervised detector: `train` has labels, of which the classifier sees `sample_rows` rows."""
    rows = train.select("row_id", "features", F.col(label_col).alias("y")).orderBy(hash_order("row_id"), "row_id").limit(sample_rows).toPandas()
    return map_scores(test, nets.fit_devnet(matrix(rows["features"]), np.asarray(rows["y"]), **options))


DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "KNN": tabular.knn,
    "HBOS": tabular.hbos,
    "ECOD": _transductive(tabular.ecod),
    "COPOD": _transductive(tabular.copod),
    "LOF": _transductive(tabular.lof),
    "COF": _transductive(tabular.cof),
    "SOD": _transductive(tabular.sod),
    "CBLOF": tabular.cblof,
    "PCA": learned.pca,
    "IForest": forests.isolation_forest,
    "LODA": learned.loda,
    "SUOD": learned.suod,
    "DIF": forests.deep_isolation_forest,
    "OCSVM": learned.fitted(nets.fit_ocsvm),
    "AE1SVM": learned.fitted(nets.fit_ae1svm),
    "AutoEncoder": learned.fitted(nets.fit_autoencoder),
    "VAE": learned.fitted(nets.fit_vae),
    "DeepSVDD": learned.fitted(nets.fit_deep_svdd),
    "DASVDD": learned.fitted(nets.fit_dasvdd),
    "NeuTraLAD": learned.fitted(nets.fit_neutralad, None),
    "DevNet": devnet,
    "LUNAR": learned.fitted(adversarial.fit_lunar, None),
    "ALAD": learned.fitted(adversarial.fit_alad),
    "SO_GAAL": learned.fitted(adversarial.fit_so_gaal),
    "MO_GAAL": learned.fitted(adversarial.fit_mo_gaal),
}


def get_detector(name: str) -> Callable[..., DataFrame]:
    if name not in DETECTORS:
        raise ValueError(f"no detector {name!r}; there are {', '.join(sorted(DETECTORS))}")
    return DETECTORS[name]
