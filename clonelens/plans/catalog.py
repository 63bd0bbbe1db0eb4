"""All registered queries: name -> (spark, folder of the given tables) -> DataFrame.

Final projections cast integers to bigint and round fractions to 6 places, so
results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonelens import ship_worker_code
from clonelens.models.base import Linear
from clonelens.models.boosted_trees import BoostedTrees
from clonelens.models.exact_trees import best_cuts
from clonelens.models.extra_trees import ExtraTrees
from clonelens.models.moments import NearestCentroid
from clonelens.models.neighbours import KNearest, LabelPropagation
from clonelens.models.registry import MODELS, NEURAL_MODELS, TOP_MODELS, make
from clonelens.models.texts import PairText
from clonelens.operators import evaluate as ev
from clonelens.operators import leaderboard as lb
from clonelens.operators import pairs as pr
from clonelens.operators import prepare as pp
from clonelens.operators import rewrite, stacking, syntax, tokens
from clonelens.operators.graph import pooled, propagate, syntax_graphs
from clonelens.operators.metrics import FRACTIONS, METRICS, file_metrics, line_metrics
from clonelens.operators.metrics import parse_failures as failing_files
from clonelens.operators.pair_features import FEATURES, pair_features
from clonelens.plans import dataset, experiments
from clonelens.session import staged
from clonelens.sources import rendered as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EMBEDDING_SIZE = 64


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_worker_code()
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


def rounded(df: DataFrame) -> DataFrame:
    """Integers as bigint, fractions rounded to 6 places (and -0.0 as 0.0)."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(field.name), field.dataType.typeName()
        if kind in ("integer", "short", "byte", "long"):
            c = c.cast("bigint")
        elif kind in ("double", "float", "decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind == "boolean":
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


_SHARED: dict[tuple[str, str, str], object] = {}


def _shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]) -> object:
    """Staged inputs several queries start from, built once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def _n_files(spark: SparkSession, sf_dir: str) -> int:
    return src.code_files(spark, sf_dir).count()


def _exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many pairs as files: exact copies and same-repository negatives."""

    def build() -> DataFrame:
        files = src.code_files(spark, sf_dir)
        return staged(pr.pair_set(files, files.count(), clone_types="exact"), "exact-pairs")

    return _shared(spark, sf_dir, "exact-pairs", build)


def _exact_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        pairs = _exact_pairs(spark, sf_dir)
        files = pr.files_of_pairs(src.code_files(spark, sf_dir), pairs)
        return staged(pair_features(pairs, staged(file_metrics(files), "metrics")), "exact-features")

    return _shared(spark, sf_dir, "exact-features", build)


def _data(spark: SparkSession, sf_dir: str) -> dataset.Dataset:
    """The training data of the model queries: mixed clones, as many pairs as files."""

    def build() -> dataset.Dataset:
        files = src.code_files(spark, sf_dir)
        return dataset.build(files, files.count())

    return _shared(spark, sf_dir, "dataset", build)


def _split_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = staged(pp.stratified_split(src.vectors(spark, sf_dir)), "split-vectors")
    return rows.filter(~F.col("is_test")).drop("is_test"), rows.filter("is_test").drop("is_test")


# ---- per-file metrics ----------------------------------------------------------------------


@query
def file_line_metrics(spark, sf):
    lines = line_metrics(src.code_files(spark, sf))
    return rounded(lines.select("file_id", "num_lines", "avg_line_length", "num_comments"))


@query
def document_line_metrics(spark, sf):
    lines = line_metrics(src.texts(spark, sf), "text")
    return rounded(lines.select("doc_id", "num_lines", "avg_line_length", "num_comments"))


@query
def code_metrics(spark, sf):
    return rounded(file_metrics(src.code_files(spark, sf)))


@query
def parse_failures(spark, sf):
    return failing_files(src.code_files(spark, sf))


@query
def syntax_node_counts(spark, sf):
    nodes = syntax.ast_nodes(src.code_files(spark, sf))
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query
def syntax_nodes(spark, sf):
    nodes = syntax.ast_nodes(src.code_files(spark, sf))
    return nodes.select("file_id", "bfs", "parent", "node_type", "name", "ctx", "def_depth")


@query
def node_sequences(spark, sf):
    sequences = syntax.node_sequences(src.code_files(spark, sf))
    return sequences.select(
        "file_id",
        F.size("tokens").cast("bigint").alias("n_nodes"),
        F.array_join("tokens", " ").alias("sequence"),
    )


@query
def word_bigrams(spark, sf):
    words = src.texts(spark, sf).select("doc_id", F.split("text", " ").alias("tokens"))
    return syntax.bigram_counts(words, "doc_id")


@query
def node_bigrams(spark, sf):
    sequences = syntax.node_sequences(src.code_files(spark, sf))
    return syntax.bigram_counts(sequences, "file_id")


@query
def node_bigram_maps(spark, sf):
    maps = syntax.bigram_maps(src.code_files(spark, sf))
    return maps.select(
        "file_id",
        F.size("bigrams").cast("bigint").alias("n_bigrams"),
        F.to_json("bigrams").alias("bigrams"),
    )


# ---- repositories, pairs and their features -------------------------------------------------


@query
def repo_search(spark, sf):
    return lb.repo_search(src.repos(spark, sf))


@query
def file_count(spark, sf):
    return src.code_files(spark, sf).agg(F.count(F.lit(1)).alias("n_files"))


@query
def files_per_repo(spark, sf):
    return pr.files_per_repo(src.code_files(spark, sf))


@query
def multi_file_repos(spark, sf):
    return rounded(pr.multi_file_repos(src.code_files(spark, sf)))


@query
def files_in_repos(spark, sf):
    return rounded(pr.files_in_repos(src.code_files(spark, sf))).select("file_id", "repo", "idx")


@query
def positive_pairs(spark, sf):
    return pr.positive_pairs(src.code_files(spark, sf), _n_files(spark, sf) // 2, "exact")


@query
def positive_pairs_mixed(spark, sf):
    return pr.positive_pairs(src.code_files(spark, sf), _n_files(spark, sf) // 2)


@query
def negatives_same_repo(spark, sf):
    found = pr.same_repo_negatives(src.code_files(spark, sf), _n_files(spark, sf))
    return found.pairs.select("draw", "left_id", "right_id")


@query
def negatives_nearly_equal(spark, sf):
    found = pr.same_repo_negatives(src.nearly_equal_files(spark, sf), _n_files(spark, sf) // 100)
    return found.pairs.select("draw", "left_id", "right_id")


@query
def negatives_any(spark, sf):
    return pr.any_repo_negatives(src.code_files(spark, sf), _n_files(spark, sf) // 2)


@query
def pair_set(spark, sf):
    return _exact_pairs(spark, sf)


@query
def pair_set_any_repo(spark, sf):
    files = src.code_files(spark, sf)
    return pr.pair_set(files, files.count(), clone_types="exact", negatives="any")


@query
def class_distribution(spark, sf):
    return pr.class_distribution(_exact_pairs(spark, sf))


@query
def dataset_shape(spark, sf):
    return pr.dataset_shape(_exact_features(spark, sf), FEATURES)


@query
def pair_metric_features(spark, sf):
    return rounded(_exact_features(spark, sf))


@query
def pair_text(spark, sf):
    texts = pr.pair_texts(_exact_pairs(spark, sf), src.code_files(spark, sf), tokens.SEPARATOR)
    return texts.select("pair_id", "label", "text")


@query
def pair_tokens(spark, sf):
    texts = pr.pair_texts(_exact_pairs(spark, sf), src.code_files(spark, sf), tokens.SEPARATOR)
    return _joined_ids(tokens.encode(texts), "pair_id")


@query
def document_tokens(spark, sf):
    return _joined_ids(tokens.encode(src.texts(spark, sf)), "doc_id")


def _joined_ids(encoded: DataFrame, key: str) -> DataFrame:
    return encoded.select(
        key,
        F.array_join(F.transform("input_ids", lambda v: v.cast("string")), " ").alias("input_ids"),
        F.array_join(F.transform("attention_mask", lambda v: v.cast("string")), " ").alias("attention_mask"),
    )


# ---- mutation -------------------------------------------------------------------------------


@query
def rename_map(spark, sf):
    maps = rewrite.rename_maps(src.code_files(spark, sf).select("file_id", "content"))
    return maps.select("file_id", F.explode("renames").alias("old_name", "new_name"))


@query
def renamed_files(spark, sf):
    return rewrite.rename_variables(src.code_files(spark, sf))


@query
def redundant_files(spark, sf):
    return rewrite.add_redundant_statement(src.code_files(spark, sf))


@query
def redundant_files_same_names(spark, sf):
    return rewrite.add_redundant_statement(src.code_files(spark, sf), also_rename=False)


@query
def mutation_choice(spark, sf):
    return src.code_files(spark, sf).select(
        "file_id", rewrite.chosen_mutation(F.col("file_id")).alias("mutation")
    )


@query
def mutated_files(spark, sf):
    return rewrite.mutate_code(src.code_files(spark, sf))


@query
def mutant_metrics(spark, sf):
    return rounded(file_metrics(rewrite.mutate_code(src.code_files(spark, sf))))


@query
def mixed_pair_features(spark, sf):
    return rounded(_data(spark, sf).features)


# ---- preparation ----------------------------------------------------------------------------


def _gapped(spark, sf) -> tuple[DataFrame, list[str]]:
    """Vectors as columns, the first one missing in every 11th row."""
    wide, names = pp.vector_columns(src.vectors(spark, sf), EMBEDDING_SIZE)
    gap = F.when(F.col("row_id") % 11 != 0, F.col(names[0]))
    return wide.withColumn(names[0], gap), names


@query
def impute_mean(spark, sf):
    wide, names = _gapped(spark, sf)
    split = pp.stratified_split(wide)
    imputer = pp.fit_imputer(split.filter(~F.col("is_test")), names)
    return rounded(imputer.apply(split).select("row_id", *names))


@query
def nan_to_num(spark, sf):
    wide, names = pp.vector_columns(src.vectors(spark, sf), EMBEDDING_SIZE)
    broken = wide.withColumn(
        names[0],
        F.when(F.col("row_id") % 11 == 0, F.lit(float("nan")))
        .when(F.col("row_id") % 11 == 1, F.lit(float("inf")))
        .when(F.col("row_id") % 11 == 2, F.lit(float("-inf")))
        .otherwise(F.col(names[0])),
    )
    fixed = pp.nan_to_num(broken, names)
    # the largest doubles are scaled down, so that every engine can round them
    return fixed.select("row_id", *[F.round(F.col(n) / F.when(F.abs(n) > 1e300, F.lit(1e300)).otherwise(F.lit(1.0)), 6).alias(n) for n in names])


@query
def standard_scale(spark, sf):
    return rounded(pp.standard_scale(_exact_features(spark, sf), FEATURES, fit_on="all"))


@query
def scale_on_train(spark, sf):
    split = pp.stratified_split(_exact_features(spark, sf), "pair_id")
    return rounded(pp.standard_scale(split, FEATURES))


@query
def scale_embeddings(spark, sf):
    wide, names = pp.vector_columns(src.vectors(spark, sf), EMBEDDING_SIZE)
    return rounded(pp.standard_scale(pp.stratified_split(wide), names))


@query
def stratified_split(spark, sf):
    rows = src.scored(spark, sf).select("row_id", "label")
    return rounded(pp.stratified_split(rows))


@query
def aligned_split(spark, sf):
    features = pp.stratified_split(_exact_features(spark, sf), "pair_id")
    return rounded(features.select("pair_id", "label", "is_test"))


@query
def grouped_split(spark, sf):
    split = pp.grouped_split(_exact_pairs(spark, sf))
    return rounded(split.select("pair_id", "left_id", "is_test"))


@query
def kfold5(spark, sf):
    return rounded(pp.kfold(src.vectors(spark, sf).select("row_id")))


@query
def stratified_fold10(spark, sf):
    return rounded(pp.stratified_folds(src.scored(spark, sf).select("row_id", "label")))


@query
def learning_curve_subsets(spark, sf):
    return rounded(pp.learning_subsets(src.vectors(spark, sf)))


# ---- models with a closed form --------------------------------------------------------------


@query
def nearest_centroid(spark, sf):
    train, test = _split_vectors(spark, sf)
    return rounded(NearestCentroid().fit(train).score(test))


@query
def knn5(spark, sf):
    train, test = _split_vectors(spark, sf)
    return rounded(KNearest().fit(train).score(test))


@query
def kernel_vote(spark, sf):
    train, test = _split_vectors(spark, sf)
    return rounded(LabelPropagation(gamma=0.05).fit(train).score(test))


@query
def kernel_vote_narrow(spark, sf):
    train, test = _split_vectors(spark, sf)
    return rounded(LabelPropagation().fit(train).score(test))


def _brand_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Per brand: its parts (valued by price) linked both ways to their sizes."""
    parts = src.table(spark, sf, "part")
    size_node = -F.col("p_size").cast("bigint") - 1
    brand = F.col("p_brand").alias("graph_id")
    nodes = parts.select(brand, F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("x"))
    sizes = parts.select(brand, size_node.alias("node"), F.lit(0.0).alias("x")).distinct()
    ends = F.inline(
        F.array(
            F.struct(F.col("p_partkey").alias("src"), size_node.alias("dst")),
            F.struct(size_node.alias("src"), F.col("p_partkey").alias("dst")),
        )
    )
    return nodes.unionByName(sizes), parts.select(brand, ends)


@query
def graph_propagate(spark, sf):
    return rounded(propagate(*_brand_graph(spark, sf)))


@query
def graph_pool(spark, sf):
    return rounded(pooled(propagate(*_brand_graph(spark, sf))))


@query
def syntax_graph_pool(spark, sf):
    return rounded(pooled(propagate(*syntax_graphs(src.code_files(spark, sf)))))


# ---- stacking -------------------------------------------------------------------------------

_STACK_BASES = ["KNeighbors", "NearestCentroid"]


def _oof(spark, sf) -> DataFrame:
    def build() -> DataFrame:
        rows = staged(src.vectors(spark, sf), "vectors")
        return staged(stacking.out_of_fold_scores(rows, _STACK_BASES, make), "oof")

    return _shared(spark, sf, "oof", build)


@query
def oof_scores(spark, sf):
    return rounded(_oof(spark, sf))


@query
def meta_features(spark, sf):
    return rounded(stacking.meta_features(_oof(spark, sf), _STACK_BASES))


def _gapped_meta(spark, sf) -> DataFrame:
    """Meta features where the first model failed on every 7th row."""
    meta = stacking.meta_features(_oof(spark, sf), _STACK_BASES)
    return meta.withColumn("KNeighbors", F.when(F.col("row_id") % 7 != 0, F.col("KNeighbors")))


@query
def meta_features_imputed(spark, sf):
    train, _, _ = stacking.impute_meta(_gapped_meta(spark, sf), _STACK_BASES)
    return rounded(train)


@query
def stack_combos(spark, sf):
    combos = stacking.stack_combinations(lb.types_in_order(src.results(spark, sf)), "type")
    return combos.select(
        F.array_join("base_classifiers", ", ").alias("base_classifiers"), "meta_classifier"
    )


def _stack_results(spark, sf) -> DataFrame:
    """The leaderboard rows read as stacks of three."""
    key = F.col("seq")
    bases = F.array(*[F.concat(F.lit(f"m{i}-"), (key % (3 + i)).cast("string")) for i in range(3)])
    return src.results(spark, sf).withColumn("base_classifiers", bases)


@query
def best_stack(spark, sf):
    return rounded(stacking.best_stack(_stack_results(spark, sf)))


# ---- evaluation -----------------------------------------------------------------------------


@query
def accuracy(spark, sf):
    return rounded(ev.accuracy(src.scored(spark, sf)))


@query
def balanced_accuracy(spark, sf):
    return rounded(ev.balanced_accuracy(src.scored(spark, sf)))


@query
def f1(spark, sf):
    return rounded(ev.f1_score(src.scored(spark, sf)))


@query
def roc_auc(spark, sf):
    return rounded(ev.roc_auc(src.scored(spark, sf)))


@query
def roc_auc_one_class(spark, sf):
    return rounded(ev.roc_auc(src.scored(spark, sf).filter("label = 1")))


@query
def roc_auc_hard_labels(spark, sf):
    return rounded(ev.roc_auc(src.scored(spark, sf), "prediction"))


@query
def confusion(spark, sf):
    return rounded(ev.confusion_matrix(src.scored(spark, sf)))


@query
def roc_points(spark, sf):
    return rounded(ev.roc_points(src.scored(spark, sf)))


@query
def roc_points_all(spark, sf):
    return rounded(ev.roc_points(src.scored(spark, sf), drop_intermediate=False))


@query
def trapezoid_auc(spark, sf):
    return rounded(ev.trapezoid_area(ev.roc_points(src.scored(spark, sf))))


@query
def scores_by_group(spark, sf):
    rows = src.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    return rounded(ev.class_scores(src.scored(spark, sf).join(rows, "row_id"), ["lang"]))


def _fold_scores(spark, sf) -> DataFrame:
    """Stored fold scores: one row per part, by integer arithmetic."""
    key = F.col("p_partkey")

    def value(modulus: int):
        return F.lit(0.5) + (key % modulus).cast("double") / F.lit(1000.0)

    return src.table(spark, sf, "part").select(
        F.col("p_brand").alias("model"),
        (key % 10).alias("fold"),
        (key % 5).alias("size"),
        value(431).alias("train_f1"),
        value(433).alias("cv_f1"),
    )


@query
def cv_summary(spark, sf):
    return rounded(ev.cv_summary(_fold_scores(spark, sf)))


@query
def learning_curve_summary(spark, sf):
    return rounded(ev.learning_curve_summary(_fold_scores(spark, sf)))


# ---- result analysis ------------------------------------------------------------------------


@query
def result_summary(spark, sf):
    return rounded(lb.result_summary(src.results(spark, sf)))


@query
def top5(spark, sf):
    return rounded(lb.top_models(src.results(spark, sf)))


@query
def summary_by_type(spark, sf):
    return rounded(lb.summary_by_type(src.results(spark, sf)))


@query
def top10_per_metric(spark, sf):
    return rounded(lb.top_per_metric(src.results(spark, sf)))


@query
def fastest15(spark, sf):
    return rounded(lb.fastest(src.results(spark, sf)))


@query
def metric_matrix(spark, sf):
    return rounded(lb.metric_matrix(src.results(spark, sf)))


@query
def radar(spark, sf):
    return rounded(lb.radar(src.results(spark, sf)))


@query
def type_boxstats(spark, sf):
    return rounded(lb.type_boxstats(src.results(spark, sf)))


@query
def type_outliers(spark, sf):
    skewed = src.results(spark, sf).withColumn(
        "accuracy", F.when(F.col("seq") % 101 == 0, F.col("accuracy") * 9).otherwise(F.col("accuracy"))
    )
    return rounded(lb.type_outliers(skewed))


@query
def types(spark, sf):
    return rounded(lb.types_in_order(src.results(spark, sf)))


# ---- fitted models (rows only: approximate or iterative) --------------------------------------


def _fit_query(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_worker_code()
        data = _data(spark, sf)
        return rounded(make(name).fit(data.train).score(data.test))

    QUERIES[f"fit_{name.lower()}"] = run


for _name in (*MODELS, *NEURAL_MODELS):
    _fit_query(_name)


def _slopes(rows: DataFrame, model, factor, penalty: float, free_bias: bool) -> DataFrame:
    """(feature, slope): the objective's derivative at a fitted hyperplane, by its formula.

    ``factor`` is a row's derivative by its margin, in terms of ``m`` and ``y``.
    """
    y = F.when(F.col("label") == 1, 1.0).otherwise(-1.0).alias("y")
    placed = rows.select("x", y, model.margin().alias("m")).withColumn("g", factor)
    names = [f"x_{i}" for i in range(EMBEDDING_SIZE)]
    sums = placed.agg(F.sum("g").alias("bias"), *[F.sum(F.col("g") * F.col("x")[i]).alias(n) for i, n in enumerate(names)])
    weights = [F.lit(0.0 if free_bias else model.bias), *[F.lit(w) for w in model.weights]]
    cells = [
        F.struct(F.lit(n).alias("feature"), (F.col(n) + F.lit(penalty) * w).alias("slope"))
        for n, w in zip(["bias", *names], weights)
    ]
    return sums.select(F.inline(F.array(*cells)))


@query
def ridge_slopes(spark, sf):
    """All zero: the fit solves the normal equations."""
    rows = src.vectors(spark, sf)
    return rounded(_slopes(rows, make("Ridge").fit(rows), F.col("m") - F.col("y"), 1.0, True))


def _relative(slopes: DataFrame, at_zero: DataFrame) -> DataFrame:
    """Slopes as shares of the slope's length at zero weights, to three places."""
    length = F.sqrt(F.sum(F.col("slope") * F.col("slope"))).alias("length")
    norm = at_zero.agg(length).first()["length"]
    return slopes.select("feature", (F.round(F.col("slope") / F.lit(norm), 3) + 0.0).alias("slope"))


@query
def logistic_slopes(spark, sf):
    rows = src.vectors(spark, sf)
    factor = -F.col("y") / (1.0 + F.exp(F.col("y") * F.col("m")))
    zero = Linear([0.0] * EMBEDDING_SIZE, 0.0)
    fitted = make("LogisticRegression").fit(rows)
    return _relative(_slopes(rows, fitted, factor, 1.0, True), _slopes(rows, zero, factor, 1.0, True))


@query
def linear_svc_slopes(spark, sf):
    rows = src.vectors(spark, sf)
    factor = -2.0 * F.col("y") * F.greatest(F.lit(0.0), 1.0 - F.col("y") * F.col("m"))
    zero = Linear([0.0] * EMBEDDING_SIZE, 0.0)
    fitted = make("LinearSVC").fit(rows)
    return _relative(_slopes(rows, fitted, factor, 1.0, False), _slopes(rows, zero, factor, 1.0, False))


@query
def extratrees_training_fit(spark, sf):
    """Fully grown trees reproduce the labels of distinct training rows, and lose none."""
    rows = src.vectors(spark, sf)
    return _training_fit(ExtraTrees().fit(rows).score(rows))


def _training_fit(scored: DataFrame) -> DataFrame:
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    pure = F.min(F.when(F.col("label") == 1, F.col("score")).otherwise(1.0 - F.col("score")))
    return rounded(scored.agg(F.count(F.lit(1)).alias("n"), right.alias("accuracy"), pure.alias("least_share")))


@query
def decisiontree_training_fit(spark, sf):
    """A tree of unlimited depth with exact cuts separates all distinct training rows."""
    rows = src.vectors(spark, sf)
    return _training_fit(make("DecisionTree").fit(rows).score(rows))


@query
def exact_cuts(spark, sf):
    """The best cut of every feature among all places between two values."""
    of = lambda label: F.when(F.col("label") == label, 1.0).otherwise(0.0)
    rows = src.vectors(spark, sf).select(F.lit(0).alias("node"), F.posexplode("x").alias("feature", "value"), of(0).alias("w0"), of(1).alias("w1"))
    return rounded(best_cuts(rows).select("feature", "gain", "cut", "l0", "l1"))


def _order_lines(spark, sf) -> DataFrame:
    """(row_id, label, x): is an order line returned, from its numbers."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]
    return src.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("label"),
        F.array(*[F.col(n).cast("double") for n in names]).alias("x"),
    )


@query
def lgbm_training_loss(spark, sf):
    """Leaf-wise boosting: the training loss falls in every round."""
    rows = _order_lines(spark, sf)
    loss = BoostedTrees(trees=5).fit(rows).staged_loss(rows)
    before = F.lag("loss").over(Window.orderBy("round"))  # one row per round
    return rounded(loss.select("round", (F.col("loss") < before).alias("falls")).filter("round > 0"))


@query
def lgbm_leaf_counts(spark, sf):
    """A tree has 31 leaves; their rows by subtracted sums equal a recount."""
    rows = _order_lines(spark, sf)
    found = BoostedTrees(trees=1).fit(rows).leaf_rows(rows)
    differ = (~F.col("n").cast("double").eqNullSafe(F.col("by_sums"))).cast("bigint")
    return rounded(found.agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("n"), F.sum(differ).alias("differing")))


@query
def fit_pairtext(spark, sf):
    from clonelens.plans.bakeoff import text_split

    train, test = text_split(_data(spark, sf))
    return PairText().fit(train).score(test)


@query
def model_comparison(spark, sf):
    """All classifiers, the small net, the text model and the best stack, with their times; failed ones with their error."""
    from clonelens.plans.bakeoff import compare_all

    return compare_all(_data(spark, sf), parallelism=8).all_rows()


@query
def stack_search(spark, sf):
    data = _data(spark, sf)
    return stacking.search_stacks(data.train, data.test, TOP_MODELS, make).withColumn(
        "base_classifiers", F.array_join("base_classifiers", ", ")
    )


@query
def extratrees_experiment(spark, sf):
    data = _data(spark, sf)
    return experiments.extratrees_experiment(data.train, data.test)


@query
def feature_importance(spark, sf):
    data = _data(spark, sf)
    fitted = ExtraTrees().fit(data.train)
    return lb.feature_importance(experiments.named_importances(fitted, FEATURES, data.train))


def _all_vectors(spark, sf) -> DataFrame:
    data = _data(spark, sf)
    return data.train.unionByName(data.test)


@query
def cross_validated_f1(spark, sf):
    """Random forest, boosting and one tree over ten stratified folds of all pairs."""
    return experiments.cross_validated_f1(_all_vectors(spark, sf))


@query
def learning_curve(spark, sf):
    """The same models on growing shares of five folds of all pairs."""
    return experiments.learning_curve(_all_vectors(spark, sf))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well do nearest centroids of the pair features tell clones from non-clones?"""
    ship_worker_code()
    data = _data(spark, sf_dir)
    return rounded(ev.class_scores(NearestCentroid().fit(data.train).score(data.test)))
