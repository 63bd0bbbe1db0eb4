"""Code-clone analytics on Spark: metrics, pairs, features, models, evaluation.

Every public function takes DataFrames and returns DataFrames (or a fitted
model whose ``score`` does).  Nothing here needs the package to be installed on
the executors: modules holding worker-side code are pickled by value.
"""

import importlib

from pyspark import cloudpickle

_WORKER_MODULES = (
    "clonelens.session",
    "clonelens.functions.arrays",
    "clonelens.operators.syntax",
    "clonelens.operators.rewrite",
    "clonelens.sources.source_tree",
    "clonelens.operators.neighbours",
    "clonelens.models.base",
    "clonelens.models.moments",
    "clonelens.models.online",
    "clonelens.models.boosting",
    "clonelens.models.boosted_trees",
    "clonelens.models.extra_trees",
    "clonelens.models.exact_trees",
    "clonelens.models.margins",
    "clonelens.models.net",
)


def ship_worker_code() -> None:
    """Let executors run the package's task functions without installing it."""
    for name in _WORKER_MODULES:
        cloudpickle.register_pickle_by_value(importlib.import_module(name))
