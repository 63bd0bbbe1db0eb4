"""Operations of a training-data pipeline: cleaning, deduplication, mixing, packing, search.

Every operator takes DataFrames and returns DataFrames; ``registry`` holds the
queries.  Worker-side code is pickled by value, so executors need not have the
package installed.
"""

import importlib

from pyspark import cloudpickle

_WORKER_MODULES = (
    "clonelens.functions.arrays",
    "clonelens.llm.vectors",
    "clonelens.llm.simhash",
    "clonelens.llm.packing",
    "clonelens.llm.language",
    "clonelens.llm.quality",
    "clonelens.llm.pivots",
    "clonelens.llm.collisions",
    "clonelens.llm.whitening",
    "clonelens.llm.lexical",
)


def ship_worker_code() -> None:
    """Let executors run the task functions of this subpackage without installing it."""
    for name in _WORKER_MODULES:
        cloudpickle.register_pickle_by_value(importlib.import_module(name))
