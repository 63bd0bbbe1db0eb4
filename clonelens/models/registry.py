"""Model names and how to make each one."""

from __future__ import annotations

from collections.abc import Callable

from clonelens.models.base import Estimator
from clonelens.models.boosted_trees import BoostedTrees, Growth
from clonelens.models.boosting import AdaBoost
from clonelens.models.exact_trees import bagging, decision_tree, random_forest
from clonelens.models.extra_trees import ExtraTrees
from clonelens.models.margins import CalibratedSvm, KernelSvm, LinearSvm, Logistic
from clonelens.models.moments import Lda, NearestCentroid, Qda, Ridge, RidgeCv
from clonelens.models.neighbours import KNearest, LabelPropagation, LabelSpreading
from clonelens.models.net import SmallNet
from clonelens.models.online import Online

# Whole levels down to depth 3, splits by the gradients' squared error.
LEVEL_WISE = Growth(leaves=8, depth=3, least_rows=1, least_curvature=0.0, newton=False)

# The compared models' names, in training order.
MODELS: dict[str, Callable[[], Estimator]] = {
    "GradientBoosting": lambda: BoostedTrees(growth=LEVEL_WISE),
    "RandomForest": random_forest,
    "Bagging": bagging,
    "ExtraTrees": ExtraTrees,
    "DecisionTree": decision_tree,
    "LabelPropagation": LabelPropagation,
    "NuSVC": lambda: KernelSvm(nu=0.5),
    "KNeighbors": KNearest,
    "SVC": KernelSvm,
    "AdaBoost": AdaBoost,
    "RidgeCV": RidgeCv,
    "Ridge": Ridge,
    "LDA": Lda,
    "LinearSVC": LinearSvm,
    "CalibratedCV": CalibratedSvm,
    "LogisticRegression": Logistic,
    "NearestCentroid": NearestCentroid,
    "SGD": lambda: Online("sgd"),
    "QDA": Qda,
    "LabelSpreading": LabelSpreading,
    "Perceptron": lambda: Online("perceptron"),
    "PassiveAggressive": lambda: Online("passive_aggressive"),
    "LGBM": BoostedTrees,
}
NEURAL_MODELS: dict[str, Callable[[], Estimator]] = {"SimpleNN": SmallNet}
# The stacking search's five models, in order.
TOP_MODELS = [
    "RandomForest",
    "GradientBoosting",
    "DecisionTree",
    "LogisticRegression",
    "LabelPropagation",
]


def make(name: str) -> Estimator:
    return (MODELS | NEURAL_MODELS)[name]()
