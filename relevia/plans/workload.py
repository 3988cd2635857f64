"""One query per operator on the given tables, as (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.detectors.autoencoder import Autoencoder, fit_model_set
from relevia.detectors.base import CentroidDetector, mean_vector, score_many
from relevia.detectors.iforest import IsolationForest
from relevia.detectors.ocsvm import OneClassSVM
from relevia.detectors.pca import PcaDetector
from relevia.explain import baselines, gradients
from relevia.explain.lasso import aic_supports
from relevia.explain.lime import lime
from relevia.explain.optimize import descent_reference, dynamic_background_shap, optimum_reference
from relevia.explain.reference import add_reference, background_summary, kmeans_reference
from relevia.explain.shap import kernel_shap, shap_exact
from relevia.functions import timefeat
from relevia.functions import vectors as V
from relevia.functions.arrow import with_vector
from relevia.operators import consistency as C
from relevia.operators import encode as E
from relevia.operators import explmetrics as M
from relevia.operators import groups as G
from relevia.operators import neighbors as N
from relevia.operators import ranking as R
from relevia.operators import shape as S
from relevia.operators import similarity, sparse
from relevia.operators.windows import trailing_counts
from relevia.plans import journal as J
from relevia.plans.detect import FLOW_GRIDS, LEDGER_GRIDS, param_grid, param_study
from relevia.session import materialize, new_table_path
from relevia.sources.sinks import write_explanation_set
from relevia.sources.tables import read_explanation_set

DIGITS = 6


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Round every double so that results do not show the order of additions."""
    # adding 0.0 turns a rounded -0.0 into 0.0
    return df.select(
        *[
            (F.round(c, DIGITS) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c)
            for c, t in df.dtypes
        ]
    )


def spread(df: DataFrame, vector: str, names: Sequence[str], *keys: str, prefix: str = "") -> DataFrame:
    """One rounded column per vector entry."""
    columns = [F.element_at(vector, i + 1).cast("double").alias(f"{prefix}{n}") for i, n in enumerate(names)]
    return rounded(df.select(*keys, *columns))


def digits_text(vector: Column) -> Column:
    """A vector of whole numbers as text."""
    return F.array_join(F.transform(vector, lambda x: x.cast("long").cast("string")), ",")


# --- shaping ---------------------------------------------------------------------------


def labels_fraud_only(spark, folder):
    return J.journal(spark, folder).select("row_id", S.labels_fraud_only(F.col("label")).alias("label"))


def get_frauds(spark, folder):
    found = S.get_frauds(J.journal(spark, folder), events=True)
    return found.select("row_id", "label", S.is_fraud(F.col("label")).cast("int").alias("fraud"))


def adjust_labels(spark, folder):
    return J.journal(spark, folder).select(
        "row_id", S.adjust_labels(F.col("label"), ["Fraud_Larceny", "Event_Bulk"]).alias("label")
    )


def binarize(spark, folder):
    return J.journal(spark, folder).select("row_id", S.binarize_label(F.col("label")).alias("y"))


def split_by_row(spark, folder):
    return J.journal(spark, folder).select("row_id", S.split_by_row(F.col("row_id"), 5000).alias("part"))


def renumber(spark, folder):
    return S.renumber(J.journal(spark, folder).select("row_id", "label", "totalprice"))


def keep_original_numeric(spark, folder):
    kept = S.keep_original_numeric(J.journal(spark, folder), J.NUMERIC)
    scaled = E.LogScaler(J.NUMERIC).transform(kept)
    names = [f"{c}_orig" for c in J.NUMERIC]
    return rounded(scaled.select("row_id", *names, F.element_at("features", 1).alias("totalprice_")))


def class_counts(spark, folder):
    return S.class_counts(J.journal(spark, folder))


def shard(spark, folder):
    frauds = S.get_frauds(J.journal(spark, folder).select("row_id", "label"))
    return S.with_shard(frauds, 5).select("row_id", "shard")


def sample_hash(spark, folder):
    return S.hash_sample(J.journal(spark, folder), 0.25, seed=11).select("row_id", "label")


def oversample(spark, folder):
    return S.oversample(J.journal(spark, folder).select("row_id", "label"), seed=5)


def _flag_encoder() -> E.TabularEncoder:
    return E.make_encoder(J.CATEGORICAL, ["totalprice", "qty"], "onehot", "zscore", nan_bucket=True)


def group_map(spark, folder):
    encoder = _flag_encoder().fit(J.journal(spark, folder).where("split = 'train'"))
    return G.group_map(spark, encoder.catalog())


def groups_from_names(spark, folder):
    found = G.groups_from_names(group_map(spark, folder), keep=[*G.NAMES_WITH_UNDERSCORE, "n_lines"])
    return found.select("source_name", F.array_join("positions", ",").alias("positions"))


def reorder(spark, folder):
    frauds = S.get_frauds(J.journal(spark, folder).select("row_id", "label"))
    order = R.global_index(frauds.select("row_id", (-F.col("row_id")).alias("key")), "key", "position")
    return S.reorder(frauds, order.select("row_id", "position"))


def _signed_set(spark, folder) -> tuple[DataFrame, list[int]]:
    """The explanations of the model set, with the signs of the deviations, and its seeds."""
    df = J.journal(spark, folder)
    segments = J.left_out_segments(df)
    return J.explanation_set(df, signed=True, segments=segments), list(range(len(segments)))


def orient(spark, folder):
    turned = J.explanation_set(J.journal(spark, folder)).withColumn(
        "phi", F.when(F.col("seed") >= 2, F.transform("phi", lambda x: -x)).otherwise(F.col("phi"))
    )
    return spread(M.orient(turned, by=["seed"]), "phi", J.NUMERIC, "seed", "row_id")


def highlight(spark, folder):
    return J.explained(J.journal(spark, folder)).select("row_id", similarity.pattern(F.col("phi")).alias("pattern"))


def l2_normalize(spark, folder):
    df = J.explained(J.journal(spark, folder)).withColumn("phi", V.l2_normalize(F.col("phi")))
    return spread(df, "phi", J.NUMERIC, "row_id")


# --- encoders --------------------------------------------------------------------------


def _train(df: DataFrame) -> DataFrame:
    return df.where("split = 'train'")


def onehot(spark, folder):
    df = J.journal(spark, folder)
    encoded = E.OneHotEncoder(J.CATEGORICAL).fit(_train(df)).transform(df)
    return encoded.select("row_id", digits_text(F.col("features")).alias("bits"))


def onehot_unseen(spark, folder):
    df = J.journal(spark, folder)
    fit_rows = _train(df).where("priority <> '1-URGENT'")
    encoded = E.OneHotEncoder(["priority"], off_value=-1.0).fit(fit_rows).transform(df)
    return encoded.select("row_id", digits_text(F.col("features")).alias("bits"))


def onehot_inverse(spark, folder):
    df = J.journal(spark, folder)
    encoder = E.OneHotEncoder(J.CATEGORICAL).fit(_train(df).where("priority <> '1-URGENT'"))
    return encoder.inverse(encoder.transform(df).select("row_id", "features")).drop("features")


def _sparse_orders(spark, folder) -> tuple[DataFrame, sparse.SparseEncoder]:
    """Orders with their customer as one category among many, as sparse rows; later customers are unseen."""
    orders = J.read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("totalprice"),
        (F.col("o_orderdate") < F.lit(J.TRAIN_UNTIL).cast("timestamp_ntz")).alias("train"),
    )
    encoder = sparse.SparseEncoder(["customer", "status", "priority"], E.MinMaxScaler(["totalprice"]), literal_limit=100)
    encoder.fit(orders.where("train AND row_id % 3 <> 0"))
    return encoder.transform(orders), encoder


def sparse_onehot(spark, folder):
    encoded, _ = _sparse_orders(spark, folder)
    positions = F.transform(F.filter("features", lambda e: e["value"] == 1.0), lambda e: e["at"])
    return encoded.select("row_id", digits_text(positions).alias("positions"))


def sparse_onehot_inverse(spark, folder):
    encoded, encoder = _sparse_orders(spark, folder)
    return encoder.inverse(encoded.select("row_id", "features")).drop("features")


def sparse_names(spark, folder):
    return _sparse_orders(spark, folder)[1].names(spark)


def sparse_centroid(spark, folder):
    encoded, encoder = _sparse_orders(spark, folder)
    detector = sparse.SparseCentroid.fit(encoded.where("train"), encoder)
    scored = detector.source_errors(detector.transform(encoded.select("row_id", "features"), "row_id"), "row_id")
    errors = [F.element_at("errors", i + 1).alias(f"error_{c}") for i, c in enumerate(encoder.source_ranges())]
    return rounded(scored.select("row_id", "score", *errors))


def sparse_pca(spark, folder):
    encoded, encoder = _sparse_orders(spark, folder)
    detector = sparse.SparsePca.fit(encoded.where("train"), encoder.width, 4, "row_id")
    return detector.transform(encoded, "row_id").select("row_id", "score")


def ordinal(spark, folder):
    df = J.journal(spark, folder)
    encoder = E.OrdinalEncoder(J.CATEGORICAL).fit(_train(df).where("priority <> '3-MEDIUM'"))
    return encoder.transform(df).select("row_id", digits_text(F.col("features")).alias("codes"))


def ordinal_inverse(spark, folder):
    df = J.journal(spark, folder)
    encoder = E.OrdinalEncoder(J.CATEGORICAL).fit(_train(df).where("priority <> '3-MEDIUM'"))
    return encoder.inverse(encoder.transform(df).select("row_id", "features")).drop("features")


def log_scale(spark, folder):
    encoder = E.LogScaler(J.NUMERIC, nan_bucket=True)
    names = [n.rstrip("_") if n.endswith("_") else n for n, _ in encoder.catalog()]
    return spread(encoder.transform(J.journal(spark, folder)), "features", names, "row_id")


def zscore(spark, folder):
    df = J.journal(spark, folder)
    encoder = E.ZScoreScaler(J.NUMERIC, nan_bucket=True, digits=4).fit(_train(df))
    return spread(encoder.transform(df), "features", [n for n, _ in encoder.catalog()], "row_id")


def minmax(spark, folder):
    df = J.journal(spark, folder)
    encoder = E.MinMaxScaler(J.NUMERIC).fit(_train(df))
    return spread(encoder.transform(df), "features", J.NUMERIC, "row_id")


def _buckets(strategy: str) -> Callable:
    def query(spark, folder):
        df = J.journal(spark, folder)
        encoder = E.BucketEncoder(J.NUMERIC, strategy=strategy, encode="ordinal", digits=7).fit(_train(df))
        return encoder.transform(df).select("row_id", digits_text(F.col("features")).alias("buckets"))

    return query


def bucket_onehot(spark, folder):
    df = J.journal(spark, folder)
    encoder = E.BucketEncoder(["totalprice", "disc"], digits=7).fit(_train(df))
    return encoder.transform(df).select("row_id", digits_text(F.col("features")).alias("bits"))


# --- detector metrics ------------------------------------------------------------------


def auc_roc(spark, folder):
    return rounded(R.auc_roc(J.scored(J.journal(spark, folder)), by=["split"]))


def auc_pr(spark, folder):
    return rounded(R.auc_pr(J.scored(J.journal(spark, folder)), by=["split"]))


def mean_rank(spark, folder):
    return rounded(R.mean_rank(J.scored(J.journal(spark, folder)), by=["split"]))


def fraud_ranks(spark, folder):
    return rounded(R.fraud_ranks(J.scored(J.journal(spark, folder)), by=["split"]))


def max_rank(spark, folder):
    return rounded(R.max_rank(J.scored(J.journal(spark, folder)), by=["split"]))


def confusion(spark, folder):
    return rounded(R.confusion(J.scored(J.journal(spark, folder)), 200, by=["split"]))


def score_report(spark, folder):
    return rounded(R.score_report(J.scored(J.journal(spark, folder))))


def label_report(spark, folder):
    """Real labels with ties: long documents as the anomaly score of toxic ones."""
    documents = J.read_table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = J.read_table(spark, folder, "labels")
    scored = labels.join(documents, "doc_id").select(
        (-F.col("n_chars")).cast("double").alias("score"), F.col("toxic").alias("y"), "quality"
    )
    return rounded(R.score_report(scored, by=["quality"]))


# --- explanation metrics ---------------------------------------------------------------


def _row_metric(column: Callable[[Column, Column], Column], name: str) -> Callable:
    def query(spark, folder):
        df = J.explained(J.journal(spark, folder))
        return rounded(df.select("row_id", column(F.col("phi"), F.col("gold")).alias(name)))

    return query


def _encoded_explanation(spark, folder) -> tuple[DataFrame, E.TabularEncoder]:
    df = J.journal(spark, folder)
    encoder = E.TabularEncoder(E.OneHotEncoder(J.CATEGORICAL), E.ZScoreScaler(J.NUMERIC, digits=4)).fit(_train(df))
    encoded = encoder.transform(df).select("row_id", "features")
    return encoded.withColumn("phi", F.transform("features", lambda x: (x - 0.25) * (x - 0.25))), encoder


def to_source_columns(spark, folder):
    explained, encoder = _encoded_explanation(spark, folder)
    groups = G.positions_by_source(encoder.catalog())
    summed = explained.withColumn("phi", G.to_source_columns(F.col("phi"), list(groups.values())))
    return spread(summed, "phi", list(groups), "row_id")


def to_source_passthrough(spark, folder):
    explained, encoder = _encoded_explanation(spark, folder)
    catalog = encoder.catalog()
    groups = G.positions_by_source(e for e in catalog if e.kind == "cat")
    loose = [e.name for e in catalog if e.kind == "num"]
    summed = explained.withColumn(
        "phi", G.to_source_passthrough(F.col("phi"), list(groups.values()), len(catalog))
    )
    names = [f"f{i}_{n}" for i, n in enumerate([*loose, *groups])]
    return spread(summed, "phi", names, "row_id")


def to_source_long(spark, folder):
    explained, encoder = _encoded_explanation(spark, folder)
    catalog = encoder.catalog()
    long = M.to_long(explained, [e.name for e in catalog], "phi", "phi", ["row_id"])
    return rounded(G.to_source_long(long, G.group_map(spark, catalog)))


def gini(spark, folder):
    df = J.explained(J.journal(spark, folder), signed=True)
    return rounded(
        df.select(
            "row_id",
            M.gini_index(F.col("phi")).alias("gini"),
            M.gini_index(F.col("phi"), absolute=True).alias("gini_abs"),
        )
    )


def distraction(spark, folder):
    df = J.explained(J.journal(spark, folder), signed=True)
    return rounded(
        df.select(
            "row_id",
            M.distraction_weight(F.col("phi"), F.col("gold")).alias("dist"),
            M.distraction_weight(F.col("phi"), F.col("gold"), absolute=True).alias("dist_abs"),
        )
    )


def _fraud_explanations(spark, folder, signed: bool = False) -> DataFrame:
    return S.get_frauds(J.explained(J.journal(spark, folder), signed))


def size_eval(spark, folder):
    return rounded(M.size_eval(_fraud_explanations(spark, folder)))


def explanation_report(spark, folder):
    return rounded(M.explanation_report(_fraud_explanations(spark, folder, signed=True), by=["label"]))


def model_set_summary(spark, folder):
    return rounded(M.model_set_summary(_signed_set(spark, folder)[0], subset=[0, 2, 4]))


def gold_join(spark, folder):
    """Long explanations and long marks aligned by row and feature, and gathered again."""
    df = J.explained(J.journal(spark, folder))
    explanations = M.to_long(df, J.NUMERIC, "phi", "phi", ["row_id"])
    frauds = S.get_frauds(df)
    marks = M.to_long(frauds, J.NUMERIC, "gold", "gold", ["row_id"])
    joined = M.join_gold(M.checked_rows(explanations, marks), marks)
    return rounded(
        joined.groupBy("row_id").agg(
            F.sum("gold").cast("long").alias("marks"), F.sum(F.col("phi") * F.col("gold")).alias("marked_phi")
        )
    )


def explanation_set_scan(spark, folder):
    """A model set written as one file set per seed and read back with seeds from the names."""
    path = new_table_path(spark, "explanations")
    write_explanation_set(J.explanation_set(J.journal(spark, folder)), path, "reconstruction_test", J.NUMERIC)
    return rounded(read_explanation_set(spark, path))


# --- consistency and similarity --------------------------------------------------------


def _pair(name: str) -> Callable:
    def query(spark, folder):
        ranking = 0.67 if name == "ranking" else None
        explanations, seeds = _signed_set(spark, folder)
        pairs = C.consistency(explanations, k=3, ranking_k=ranking, seeds=seeds)
        return rounded(pairs.select("seed_a", "seed_b", "rows", name))

    return query


def pair_row_metrics(spark, folder):
    """Per row distances of the first two models, as expressions."""
    wide, _ = C.model_columns(_signed_set(spark, folder)[0], seeds=[0, 1])
    a, b = F.col("m0"), F.col("m1")
    names = ["euclid", "euclid_abs", "sign_disagreement", "feature_disagreement"]
    width = len(J.NUMERIC)
    return rounded(
        wide.select(
            "row_id",
            *[C.pair_metric(n, a, b, width, 3).alias(n) for n in names],
            C.topk_euclid(a, b, width, 0.5).alias("topk_euclid"),
            C.topk_ranking_distance(a, b, width, 0.67).alias("ranking"),
        )
    )


def topk_euclid_as_written(spark, folder):
    wide, _ = C.model_columns(_signed_set(spark, folder)[0], seeds=[0, 1])
    return rounded(C.topk_euclid_as_written(wide, "m0", "m1", len(J.NUMERIC)))


def pair_histogram(spark, folder):
    explanations, seeds = _signed_set(spark, folder)
    pairs = C.consistency(explanations, k=3, seeds=seeds)
    names = ["euclid_abs", "euclid", "sign_disagreement", "feature_disagreement"]
    return rounded(C.density_histogram(pairs, names))


def hamming_matrix(spark, folder):
    return rounded(similarity.pattern_matrix(J.explained(J.journal(spark, folder))))


def hamming_rows(spark, folder):
    frauds = J.explained(J.journal(spark, folder)).where("label LIKE 'Fraud%'")
    found = similarity.hamming_matrix(frauds)
    return rounded(found)


def hamming_by_label(spark, folder):
    return rounded(similarity.class_distances(J.explained(J.journal(spark, folder))))


# --- neighbours ------------------------------------------------------------------------


def _vectors(spark, folder) -> DataFrame:
    return J.read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("features")
    )


def nn_reference(spark, folder):
    df = _vectors(spark, folder)
    found = N.nn_reference(df.where("label = 0"), df.where("label <> 0"))
    return rounded(found.select("row_id", "neighbor", "distance", V.total(F.col("reference")).alias("reference_sum")))


def knn(spark, folder):
    df = _vectors(spark, folder)
    return rounded(N.knn_join(df, df, 5, skip_same=True))


def knn_by_key(spark, folder):
    df = _vectors(spark, folder)
    return rounded(N.knn_join(df, df, 5, key="label", skip_same=True))


def knn_cells(spark, folder):
    """The join for many query rows, over the tree of pivots."""
    df = _vectors(spark, folder)
    return rounded(N.knn_join(df, df, 5, skip_same=True, broadcast_values=0))


def knn_several_keys(spark, folder):
    """Orders near an urgent or a large one: a row has a key for its priority and one for its status."""
    df = J.standardized(J.journal(spark, folder)).withColumn("keys", F.array_compact(F.array("priority", "status")))
    large = df.where("totalprice >= 490000")
    found = N.knn_join(large, df.where("split = 'train'"), 5, key="keys")
    return rounded(found)


def lof(spark, folder):
    return rounded(N.lof(_vectors(spark, folder)))


def lof_novelty(spark, folder):
    df = _vectors(spark, folder)
    return rounded(N.lof(df.where("label <> 0"), queries=df.where("label = 0")))


# --- reference points and attribution --------------------------------------------------


def mean_reference(spark, folder):
    means = mean_vector(_vectors(spark, folder))
    return rounded(spark.createDataFrame(list(enumerate(means)), "position int, mean double"))


def reconstruction_error(spark, folder):
    df = J.journal(spark, folder)
    encoder = E.MinMaxScaler(J.NUMERIC).fit(_train(df))
    encoded = encoder.transform(df).select("row_id", "split", "features")
    detector = CentroidDetector.fit(_train(encoded))
    return spread(baselines.reconstruction_error(encoded, detector), "phi", J.NUMERIC, "row_id")


def noise(spark, folder):
    df = J.standardized(J.journal(spark, folder)).select("row_id", "features")
    return spread(baselines.uniform_noise(df, seed=7), "phi", J.NUMERIC, "row_id")


def noise_times_input(spark, folder):
    df = J.standardized(J.journal(spark, folder)).select("row_id", "features")
    return spread(baselines.noise_times_input(df, seed=7), "phi", J.NUMERIC, "row_id")


def _distance_score(v: Column) -> Column:
    return -V.l2_norm(v)


def _zeros() -> list[float]:
    return [0.0] * len(J.NUMERIC)


def shap_exact_query(spark, folder):
    df = J.standardized(J.journal(spark, folder)).select("row_id", "features")
    return spread(shap_exact(df, _distance_score, len(J.NUMERIC), [_zeros()]), "phi", J.NUMERIC, "row_id")


def _segment_references(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean point of each market segment in training, weighted by its rows."""
    train = _train(df)
    means = [F.round(F.avg(F.element_at("features", i + 1)), 4).alias(f"m{i}") for i in range(len(J.NUMERIC))]
    rows = train.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"), *means).orderBy("segment").collect()
    total = sum(r["rows"] for r in rows)
    points = np.array([[r[f"m{i}"] for i in range(len(J.NUMERIC))] for r in rows])
    return points, np.array([r["rows"] / total for r in rows])


def shap_background(spark, folder):
    df = J.standardized(J.journal(spark, folder)).select("row_id", "split", "segment", "features")
    found = kernel_shap(df.select("row_id", "features"), CentroidDetector(_zeros()), _segment_references(df))
    return spread(found, "phi", J.NUMERIC, "row_id")


def shap_expected_value(spark, folder):
    df = J.standardized(J.journal(spark, folder)).select("row_id", "split", "segment", "features")
    found = kernel_shap(df.select("row_id", "features"), CentroidDetector(_zeros()), _segment_references(df))
    return rounded(
        found.select("row_id", "expected_value", (F.col("expected_value") + V.total(F.col("phi"))).alias("explained_score"))
    )


def shap_unchanged(spark, folder):
    """Only totalprice and qty differ from the reference; every other attribution is 0."""
    df = J.standardized(J.journal(spark, folder)).select("row_id", "features")
    changed = {J.NUMERIC.index("totalprice"), J.NUMERIC.index("qty")}
    reference = F.array(
        *[F.lit(0.0) if i in changed else F.element_at("features", i + 1) for i in range(len(J.NUMERIC))]
    )
    found = shap_exact(df, _distance_score, len(J.NUMERIC), reference)
    return spread(found, "phi", J.NUMERIC, "row_id")


def _matrix_rows(spark, folder) -> tuple[DataFrame, DataFrame]:
    """(frauds to explain, training rows) with one-hot and min-max features, 19 columns."""
    df = J.journal(spark, folder)
    encoder = E.make_encoder(J.CATEGORICAL, J.NUMERIC, "onehot", "minmax").fit(_train(df))
    encoded = encoder.transform(df).select("row_id", "split", "label", "features")
    return S.get_frauds(encoded).select("row_id", "features"), _train(encoded).select("row_id", "features")


def _numeric_rows(spark, folder) -> tuple[DataFrame, DataFrame]:
    """(frauds to explain, training rows) with min-max features, 6 columns."""
    df = J.journal(spark, folder)
    encoded = E.MinMaxScaler(J.NUMERIC).fit(_train(df)).transform(df).select("row_id", "split", "label", "features")
    return S.get_frauds(encoded).select("row_id", "features"), _train(encoded).select("row_id", "features")


_FITTED: dict[tuple[str, str, str], Autoencoder] = {}


def _network(spark, folder: str, inputs: str, train: DataFrame) -> Autoencoder:
    """The default autoencoder of a session's training rows; queries on the same inputs share one fit."""
    key = (spark.sparkContext.applicationId, folder, inputs)
    if key not in _FITTED:
        _FITTED[key] = Autoencoder.fit(train)
    return _FITTED[key]


def _attributed(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Long result (row_id, position, phi) of an attribution."""
    return rounded(df.select("row_id", *extra, F.posexplode("phi").alias("position", "phi")))


def shap_sampled(spark, folder):
    rows, train = _matrix_rows(spark, folder)
    detector = CentroidDetector.fit(train)
    pointed = add_reference(rows, "mean", train)
    return _attributed(kernel_shap(pointed, detector), ["expected_value"])


class _Additive(CentroidDetector):
    """A score that adds up over the columns, with weights 1, 2, 3 and so on."""

    def score_batch(self, x: np.ndarray) -> np.ndarray:
        return -(x * np.arange(1, x.shape[1] + 1)).sum(axis=1)


def shap_additive(spark, folder):
    """Sampled attributions of a score that adds up over 18 columns: each is its own term, sampled or not."""
    df = J.standardized(J.journal(spark, folder)).select("row_id", "features")
    wide = F.concat("features", F.transform("features", lambda z: z * 0.5), F.transform("features", lambda z: z * -0.25))
    found = kernel_shap(df.select("row_id", wide.alias("features")), _Additive(np.zeros(18)), (np.full((1, 18), 9.0), np.ones(1)))
    # three digits: the least squares behind a sample leave an error in the last ones
    long = found.select("row_id", F.posexplode("phi").alias("position", "phi"))
    return long.select("row_id", "position", (F.round("phi", 3) + F.lit(0.0)).alias("phi"))


def shap_kmeans(spark, folder):
    rows, train = _numeric_rows(spark, folder)
    detector = IsolationForest.fit(train)
    return _attributed(kernel_shap(rows, detector, kmeans_reference(train, k=5)), ["expected_value"])


def shap_summary(spark, folder):
    rows, train = _numeric_rows(spark, folder)
    detector = PcaDetector.fit(train)
    return _attributed(kernel_shap(rows, detector, background_summary(train)), ["expected_value"])


def shap_top_features(spark, folder):
    rows, train = _matrix_rows(spark, folder)
    detector = CentroidDetector.fit(train)
    pointed = add_reference(rows, "mean", train)
    return _attributed(kernel_shap(pointed, detector, top_features=5))


def lasso_support(spark, folder):
    """How many features the criterion keeps along the path of an orthogonal design, with z-scores as products."""
    df = J.standardized(J.journal(spark, folder)).select("row_id", "features")
    width = len(J.NUMERIC)

    def count(x: np.ndarray) -> np.ndarray:
        return aic_supports(np.eye(width), x, (x**2).sum(axis=1) + 50.0, 100).sum(axis=1)

    counted = with_vector(df, ["features"], "kept", count, scalar=True)
    return counted.select("row_id", F.col("kept").cast("int").alias("kept"))


def shap_nearest(spark, folder):
    rows, train = _numeric_rows(spark, folder)
    pointed = add_reference(rows, "NN", train)
    return _attributed(kernel_shap(pointed, CentroidDetector.fit(train)))


def lime_query(spark, folder):
    df = J.journal(spark, folder)
    encoder = E.make_encoder(J.CATEGORICAL, J.NUMERIC, "ordinal", "buckets", encode="ordinal").fit(_train(df))
    encoded = encoder.transform(df).select("row_id", "split", "label", "features")
    train = _train(encoded)
    detector = CentroidDetector.fit(train)
    return _attributed(lime(S.get_frauds(encoded).select("row_id", "features"), detector, train))


def saliency(spark, folder):
    rows, train = _matrix_rows(spark, folder)
    return _attributed(gradients.saliency(rows, _network(spark, folder, "matrix", train).network))


def grad_input(spark, folder):
    rows, train = _matrix_rows(spark, folder)
    return _attributed(gradients.gradient_times_input(rows, _network(spark, folder, "matrix", train).network))


def integrated_gradients(spark, folder):
    rows, train = _matrix_rows(spark, folder)
    network = _network(spark, folder, "matrix", train).network
    return _attributed(gradients.integrated_gradients(add_reference(rows, "mean", train), network))


def lrp(spark, folder):
    rows, train = _matrix_rows(spark, folder)
    return _attributed(gradients.lrp(rows, _network(spark, folder, "matrix", train).network), ["convergence_gap"])


def reference_optimum(spark, folder):
    rows, train = _numeric_rows(spark, folder)
    found = optimum_reference(rows, _network(spark, folder, "numeric", train).network)
    return rounded(found.select("row_id", F.posexplode("reference").alias("position", "value")))


def reference_descent(spark, folder):
    rows, train = _numeric_rows(spark, folder)
    found = descent_reference(rows, _network(spark, folder, "numeric", train).network)
    return rounded(found.select("row_id", F.posexplode("reference").alias("position", "value")))


def shap_optimized(spark, folder):
    rows, train = _numeric_rows(spark, folder)
    network = _network(spark, folder, "numeric", train).network
    return _attributed(dynamic_background_shap(rows, network, "optimized"), ["expected_value"])


def shap_full(spark, folder):
    rows, train = _numeric_rows(spark, folder)
    network = _network(spark, folder, "numeric", train).network
    return _attributed(dynamic_background_shap(rows, network, "full"), ["expected_value"])


# --- detectors -------------------------------------------------------------------------


def _all_and_train(spark, folder) -> tuple[DataFrame, DataFrame]:
    df = J.standardized(J.journal(spark, folder)).select("row_id", "split", "features")
    return df, _train(df)


def isolation_forest(spark, folder):
    df, train = _all_and_train(spark, folder)
    detector = IsolationForest.fit(train)
    return rounded(detector.transform(df).select("row_id", "score"))


def isolation_forest_share(spark, folder):
    """The ledgers' own setting: 128 trees on four fifths of the rows and columns each."""
    df, train = _all_and_train(spark, folder)
    params = param_grid(LEDGER_GRIDS["IsolationForest"])[0]
    return rounded(IsolationForest.fit(train, **params).transform(df).select("row_id", "score"))


def isolation_forest_flows(spark, folder):
    """The flows' own setting, 32 trees on four fifths of the events before the last fifth of their ids."""
    events = J.read_table(spark, folder, "events").where("event_id is not null")
    last = events.agg(F.max("event_id")).first()[0] or 0
    parts = [F.coalesce("value", F.lit(0.0)), F.hour("ts").cast("double"), F.dayofweek("ts").cast("double")]
    kinds = F.pmod(F.xxhash64(F.coalesce("event_type", F.lit(""))), F.lit(97)).cast("double")
    rows = events.select(F.col("event_id").alias("row_id"), F.array(*parts, kinds).alias("features"))
    params = param_grid(FLOW_GRIDS["IsolationForest"])[0]
    forest = IsolationForest.fit(rows.where(F.col("row_id") <= F.lit(last) * 0.8), **params)
    return rounded(forest.transform(rows).select("row_id", "score"))


def _fixed_forest() -> IsolationForest:
    names = ("field", "threshold", "left", "right", "path")
    kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
    trees = [{n: np.array(c, dtype=k) for n, c, k in zip(names, zip(*nodes), kinds)} for nodes in J.FIXED_TREES]
    return IsolationForest(trees, 256)


def forest_fixed_nodes(spark, folder):
    """Scores of a forest whose nodes are given."""
    df, _ = _all_and_train(spark, folder)
    return rounded(_fixed_forest().transform(df).select("row_id", "score"))


def ocsvm(spark, folder):
    df, train = _all_and_train(spark, folder)
    detector = OneClassSVM.fit(train, nu=0.05, gamma=0.1)
    return rounded(detector.transform(df).select("row_id", "score"))


def pca_detector(spark, folder):
    df, train = _all_and_train(spark, folder)
    return rounded(PcaDetector.fit(train).transform(df).select("row_id", "score"))


def autoencoder(spark, folder):
    df, train = _all_and_train(spark, folder)
    return rounded(_network(spark, folder, "standardized", train).transform(df).select("row_id", "score"))


def reconstruct(spark, folder):
    df, train = _all_and_train(spark, folder)
    found = _network(spark, folder, "standardized", train).reconstruct(df)
    return spread(found, "reconstruction", J.NUMERIC, "row_id")


def embed(spark, folder):
    df, train = _all_and_train(spark, folder)
    found = _network(spark, folder, "standardized", train).embed(df)
    return rounded(found.select("row_id", F.posexplode("embedding").alias("position", "value")))


def model_set(spark, folder):
    df, train = _all_and_train(spark, folder)
    models = fit_model_set(train, [0, 1, 2])
    return rounded(score_many(df, models, ["row_id"], run="seed"))


def param_study_query(spark, folder):
    """The ledgers' whole grid of principal component detectors, each with two seeds."""
    encoder = E.make_encoder(J.CATEGORICAL, J.NUMERIC, "onehot", "zscore")
    label = S.labels_fraud_only(F.col("label"))
    return rounded(param_study(J.journal(spark, folder), encoder, "PCA", LEDGER_GRIDS["PCA"], seeds=[0, 1], label=label))


def study_fixed_models(spark, folder):
    """Metrics of given models, scored together: a centre, the same with other weights, and given trees."""
    df = J.standardized(J.journal(spark, folder))
    y = S.binarize_label(S.labels_fraud_only(F.col("label")))
    rows = df.select("row_id", "split", y.alias("y"), "features").where("split <> 'train'")
    width = len(J.NUMERIC)
    axes = PcaDetector(np.eye(width)[:2], np.array([1.0, 0.5]), np.zeros(width), np.arange(1.0, width + 1))
    scores = score_many(rows, [CentroidDetector(_zeros()), axes, _fixed_forest()], ["split", "row_id", "y"])
    return rounded(R.score_report(materialize(scores, "study-scores"), by=["run", "split"]))


# --- flow features ---------------------------------------------------------------------


def conn_last_10s(spark, folder):
    events = J.read_table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    sides = [
        trailing_counts(events.select("event_id", key, "ts"), key, "ts", {f"{side}_10s": 10, f"{side}_10m": 600}).drop(key, "ts")
        for key, side in (("user_id", "src"), ("event_type", "dst"))
    ]
    return sides[0].join(sides[1], "event_id")


def time_features(spark, folder):
    events = J.read_table(spark, folder, "events")
    return events.select(
        "event_id", timefeat.is_weekday(F.col("ts")).alias("is_weekday"), timefeat.daytime(F.col("ts")).alias("daytime")
    )


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Journal, z-scores, contributions, marks, row metrics, summary per fraud label."""
    return rounded(M.explanation_report(_fraud_explanations(spark, folder), by=["label"], compactness=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "labels_fraud_only": labels_fraud_only,
    "get_frauds": get_frauds,
    "adjust_labels": adjust_labels,
    "binarize": binarize,
    "split_by_row": split_by_row,
    "renumber": renumber,
    "keep_original_numeric": keep_original_numeric,
    "class_counts": class_counts,
    "shard": shard,
    "sample_hash": sample_hash,
    "oversample": oversample,
    "group_map": group_map,
    "groups_from_names": groups_from_names,
    "reorder": reorder,
    "orient": orient,
    "highlight": highlight,
    "l2_normalize": l2_normalize,
    "onehot": onehot,
    "onehot_unseen": onehot_unseen,
    "onehot_inverse": onehot_inverse,
    "sparse_onehot": sparse_onehot,
    "sparse_onehot_inverse": sparse_onehot_inverse,
    "sparse_names": sparse_names,
    "sparse_centroid": sparse_centroid,
    "sparse_pca": sparse_pca,
    "ordinal": ordinal,
    "ordinal_inverse": ordinal_inverse,
    "log_scale": log_scale,
    "zscore": zscore,
    "minmax": minmax,
    "bucket_outlier": _buckets("quantile_outlier"),
    "bucket_uniform": _buckets("uniform"),
    "bucket_quantile": _buckets("quantile"),
    "bucket_kmeans": _buckets("kmeans"),
    "bucket_onehot": bucket_onehot,
    "auc_roc": auc_roc,
    "auc_pr": auc_pr,
    "mean_rank": mean_rank,
    "fraud_ranks": fraud_ranks,
    "max_rank": max_rank,
    "confusion": confusion,
    "score_report": score_report,
    "label_report": label_report,
    "row_auc_roc": _row_metric(M.row_auc_roc, "roc"),
    "row_auc_pr": _row_metric(M.row_auc_pr, "pr"),
    "row_pearson": _row_metric(M.row_pearson, "pearson"),
    "row_cosine": _row_metric(M.row_cosine, "cosine"),
    "to_source_columns": to_source_columns,
    "to_source_passthrough": to_source_passthrough,
    "to_source_long": to_source_long,
    "gini": gini,
    "distraction": distraction,
    "size_eval": size_eval,
    "explanation_report": explanation_report,
    "model_set_summary": model_set_summary,
    "gold_join": gold_join,
    "explanation_set_scan": explanation_set_scan,
    "pair_euclid": _pair("euclid"),
    "pair_euclid_abs": _pair("euclid_abs"),
    "pair_sign_disagreement": _pair("sign_disagreement"),
    "pair_feature_disagreement": _pair("feature_disagreement"),
    "pair_ranking": _pair("ranking"),
    "pair_row_metrics": pair_row_metrics,
    "topk_euclid_as_written": topk_euclid_as_written,
    "pair_histogram": pair_histogram,
    "hamming_matrix": hamming_matrix,
    "hamming_rows": hamming_rows,
    "hamming_by_label": hamming_by_label,
    "nn_reference": nn_reference,
    "knn": knn,
    "knn_by_key": knn_by_key,
    "knn_cells": knn_cells,
    "knn_several_keys": knn_several_keys,
    "lof": lof,
    "lof_novelty": lof_novelty,
    "mean_reference": mean_reference,
    "reconstruction_error": reconstruction_error,
    "noise": noise,
    "noise_times_input": noise_times_input,
    "shap_exact": shap_exact_query,
    "shap_background": shap_background,
    "shap_unchanged": shap_unchanged,
    "shap_expected_value": shap_expected_value,
    "shap_additive": shap_additive,
    "shap_sampled": shap_sampled,
    "shap_kmeans": shap_kmeans,
    "shap_summary": shap_summary,
    "shap_top_features": shap_top_features,
    "lasso_support": lasso_support,
    "shap_nearest": shap_nearest,
    "lime": lime_query,
    "saliency": saliency,
    "grad_input": grad_input,
    "integrated_gradients": integrated_gradients,
    "lrp": lrp,
    "reference_optimum": reference_optimum,
    "reference_descent": reference_descent,
    "shap_optimized": shap_optimized,
    "shap_full": shap_full,
    "isolation_forest": isolation_forest,
    "isolation_forest_share": isolation_forest_share,
    "isolation_forest_flows": isolation_forest_flows,
    "forest_fixed_nodes": forest_fixed_nodes,
    "ocsvm": ocsvm,
    "pca_detector": pca_detector,
    "autoencoder": autoencoder,
    "reconstruct": reconstruct,
    "embed": embed,
    "model_set": model_set,
    "study_fixed_models": study_fixed_models,
    "param_study": param_study_query,
    "conn_last_10s": conn_last_10s,
    "time_features": time_features,
    "flagship": flagship,
}
