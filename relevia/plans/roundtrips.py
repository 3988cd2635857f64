"""Queries that write the journal in a source's format and read it back, and networks with set weights.

Each result can be worked out from the tables alone, so each has an SQL check beside it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.detectors.autoencoder import Autoencoder, Network
from relevia.detectors.pca import PcaDetector
from relevia.detectors.base import CentroidDetector
from relevia.explain import gradients
from relevia.operators import encode as E
from relevia.operators import shape as S
from relevia.plans import journal as J
from relevia.plans.checks import EXPLAINED, JOURNAL, MODEL_SET, SCORED, STANDARD
from relevia.plans.explain import explain_anomalies
from relevia.session import new_table_path
from relevia.sources import catalog as K
from relevia.sources import registry, sinks, tables

LEDGER = ["key", *J.CATEGORICAL, *J.NUMERIC, "label"]
DIGITS = 6


def _rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(value: str, name: str, digits: int = DIGITS) -> str:
    return f"round({value}, {digits}) + 0.0 AS {name}"


# --- sources and sinks -----------------------------------------------------------------


def _ledger_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog file for the ledger, with German names that need ISO-8859-1, read back."""
    kinds = [("cat" if c in J.CATEGORICAL else "num" if c in J.NUMERIC else "note") for c in LEDGER]
    rows = [
        ("ger", *[f"{c}_ä" for c in LEDGER]),
        ("en", *LEDGER),
        ("cat", *["1.0" if k == "cat" else "0.0" for k in kinds]),
        ("num", *["1.0" if k == "num" else "0.0" for k in kinds]),
    ]
    path = new_table_path(spark, "catalog")
    names = ["tag", *[str(i) for i in range(len(LEDGER))]]
    spark.createDataFrame(rows, names).coalesce(1).write.csv(path, header=True)
    return K.read_catalog(spark, path)


def _written_ledger(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    df = J.journal(spark, folder)
    df = df if split is None else df.where(F.col("split") == split)
    return df.withColumn("key", F.concat(F.lit("Schlüssel-"), "row_id")).select(*LEDGER)


def ledger_scan(spark, folder):
    path = new_table_path(spark, "ledger")
    _written_ledger(spark, folder).write.csv(path, header=True, encoding="ISO-8859-1")
    return _rounded(tables.read_ledger(spark, path, _ledger_catalog(spark, folder)).drop("row_id"))


def ledger_row_ids(spark, folder):
    """Row ids number the rows of a ledger without gaps."""
    path = new_table_path(spark, "ledger")
    _written_ledger(spark, folder).write.csv(path, header=True, encoding="ISO-8859-1")
    return tables.read_ledger(spark, path, _ledger_catalog(spark, folder)).select("row_id")


def named_splits(spark, folder):
    root = new_table_path(spark, "splits")
    for file, split in (("normal_2", "train"), ("fraud_2", "eval"), ("fraud_3", "test")):
        _written_ledger(spark, folder, split).write.csv(f"{root}/ex1/{file}.csv", header=True, encoding="ISO-8859-1")
    found = tables.load_splits(spark, root, "session2", _ledger_catalog(spark, folder))
    return _rounded(found.drop("row_id"))


def _journal_catalog(spark) -> DataFrame:
    """The journal's columns as a transposed catalog file, read back by position."""
    roles = {**dict.fromkeys(J.CATEGORICAL, "cat"), **dict.fromkeys(J.NUMERIC, "num"), "label": "note"}
    flag = {"note": "-1.0"}
    rows = [
        ("ger", *[f"{name} (de)" for name in roles]),
        ("en", *roles),
        ("cat", *["1.0" if r == "cat" else flag.get(r, "0.0") for r in roles.values()]),
        ("num", *["1.0" if r == "num" else flag.get(r, "0.0") for r in roles.values()]),
    ]
    path = new_table_path(spark, "catalog")
    spark.createDataFrame(rows, ["tag", *map(str, range(len(roles)))]).coalesce(1).write.csv(path, header=True)
    return K.read_catalog(spark, path)


def catalog_scan(spark, folder):
    """Every column of the catalog with the journal rows that have a value and the values that differ."""
    catalog, df = _journal_catalog(spark), J.journal(spark, folder)
    names = K.catalog_names(catalog, "en")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name_en"), F.col(n).cast("string").alias("value")) for n in names])).alias("c"))
    counted = long.groupBy("c.name_en").agg(F.count("c.value").alias("filled"), F.countDistinct("c.value").alias("different"))
    return catalog.join(counted, "name_en").select("pos", "name_de", "name_en", "role", "filled", "different")


def catalog_column_names(spark, folder):
    """How many of the columns that are encoded, by the catalog, each journal row fills; numbers and categories apart."""
    catalog, df = _journal_catalog(spark), J.journal(spark, folder)
    numeric, categorical = K.column_dtypes(catalog, "en")
    filled = lambda names: F.size(F.array_compact(F.array(*[F.col(n).cast("string") for n in names])))
    all_names = K.column_names(catalog, "en")
    return df.select("row_id", filled(numeric).alias("numbers"), filled(categorical).alias("categories"), filled(all_names).alias("encoded"))


def gold_scan(spark, folder):
    """Expert marks written as a wide file with an X per marked field and two note columns."""
    df = S.get_frauds(J.explained(J.journal(spark, folder)))
    marks = [F.when(F.element_at("gold", i) == 1, "X").alias(c) for c, i in zip(J.NUMERIC, range(1, 7))]
    path = new_table_path(spark, "gold")
    df.select(F.col("row_id").alias("iloc"), *marks, "label", F.lit("x").alias("note")).write.csv(path, header=True)
    return tables.read_gold(spark, path, drop=2)


def explanation_scan(spark, folder):
    """One explanation as a wide file, read back in long form."""
    df = J.explained(J.journal(spark, folder))
    path = new_table_path(spark, "explanation")
    values = [F.element_at("phi", i).alias(c) for i, c in enumerate(J.NUMERIC, start=1)]
    df.select("row_id", *values, F.lit(0.0).alias("expected_value")).write.csv(path, header=True)
    return _rounded(tables.read_explanation(spark, path))


def explanation_runs(spark, folder):
    """Runs in one folder: ``ignore`` writes a run that is not there and leaves one that is."""
    df = J.explained(J.journal(spark, folder))
    path = new_table_path(spark, "runs")
    twice = df.withColumn("phi", F.transform("phi", lambda v: 2 * v))
    sinks.write_explanation(df.select("row_id", "phi"), path, "Z", "square", "zeros")
    sinks.write_explanation(twice.select("row_id", "phi"), path, "Z", "double", "zeros", if_exists="ignore")
    sinks.write_explanation(twice.select("row_id", "phi"), path, "Z", "square", "zeros", if_exists="ignore")
    found = spark.read.parquet(path).select("method", "row_id", F.element_at("phi", 1).alias("phi"))
    return _rounded(found)


def scores_written(spark, folder):
    path = new_table_path(spark, "scores")
    sinks.write_scores(J.scored(J.journal(spark, folder)), path)
    return _rounded(spark.read.parquet(path).select("split", "row_id", "score", "y"))


def summary_appended(spark, folder):
    """Two summaries with different columns, appended to one table."""
    scored = J.scored(J.journal(spark, folder))
    path = new_table_path(spark, "summary")
    sinks.append_summary(scored.groupBy("split").agg(F.count(F.lit(1)).alias("rows")), path)
    sinks.append_summary(scored.groupBy("split").agg(F.sum("y").alias("frauds")), path)
    return spark.read.option("mergeSchema", "true").parquet(path).select("split", "rows", "frauds")


def run_written(spark, folder):
    """Metrics of a run as a map, by name."""
    counts = J.scored(J.journal(spark, folder)).groupBy("split").count().collect()
    path = new_table_path(spark, "runs")
    sinks.write_run(spark, path, "counts", 7, {"by": "split"}, {r["split"]: r["count"] for r in counts})
    found = spark.read.parquet(path)
    return found.select("job", "seed", "params", F.explode("metrics").alias("name", "value"))


def saved_detector(spark, folder):
    """A detector that scores alike after it was saved and loaded; the better of two is loaded."""
    path = new_table_path(spark, "models")
    registry.save_model(spark, CentroidDetector(np.ones(6)), path, "journal", 0.1)
    registry.save_model(spark, CentroidDetector(np.zeros(6)), path, "journal", 0.9)
    detector = registry.load_model(spark, path, CentroidDetector.kind, "journal")
    df = J.standardized(J.journal(spark, folder)).select("row_id", "features")
    return _rounded(detector.transform(df).select("row_id", "score"))


# --- shaping ---------------------------------------------------------------------------


def notes_dropped(spark, folder):
    return S.drop_notes(J.journal(spark, folder).select("row_id", "label", *J.CATEGORICAL), J.CATEGORICAL[1:])


def notes_to_front(spark, folder):
    """Column places after the notes went to the front, with a value of each."""
    df = S.notes_first(J.journal(spark, folder).select("row_id", "label", "status"), ["status", "label"])
    places = F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).cast("string").alias("value")) for i, c in enumerate(df.columns)])
    return df.select("row_id", F.explode(places).alias("p")).select("row_id", "p.place", "p.value")


def label_split(spark, folder):
    features, labels = S.split_label(J.journal(spark, folder).select("row_id", "label", "status"))
    return features.join(labels.withColumnRenamed("label", "y"), "row_id")


def columns_mapped(spark, folder):
    df = J.read_table(spark, folder, "events").select(F.col("event_id").alias(" Src IP Addr "), F.col("user_id").alias("Proto"))
    return S.map_columns(df, K.FLOW_RENAMES)


def encoded_groups(spark, folder):
    """How many encoded flow columns each event hits, by source column and its encoded positions."""
    groups = K.flow_group_positions()
    rows = spark.createDataFrame([(s, p) for s, ps in groups.items() for p in ps], "source string, position long")
    events = J.read_table(spark, folder, "events").select(F.pmod("event_id", F.lit(146)).alias("position"))
    return events.groupBy("position").count().join(rows, "position").groupBy("source").agg(F.sum("count").alias("events"))


def seeds_kept(spark, folder):
    found = S.keep_seeds(J.explanation_set(J.journal(spark, folder)), [1, 3])
    return _rounded(found.select("seed", "row_id", F.element_at("phi", 1).alias("phi")))


def numbers_as_they_are(spark, folder):
    """Encoders named None: numeric columns unchanged, categories left out."""
    df = J.journal(spark, folder)
    encoder = E.make_encoder([], J.NUMERIC, "None", "zscore").fit(df.where("split = 'train'"))
    found = encoder.transform(S.keep_original_numeric(df, ["totalprice"]))
    return _rounded(found.select("row_id", F.size("features").alias("width"), F.col("totalprice_orig").alias("value")))


# --- networks with set weights ---------------------------------------------------------


def _set_network() -> Network:
    """Two hidden steps over six inputs: a rectified layer of two, a bottleneck of one, and back."""
    network = Network(6, n_layers=1, n_bottleneck=1)
    first = np.array([[0.5, -0.25, 0.0, 0.25, 0.0, 0.0], [0.0, 0.25, 0.5, 0.0, -0.25, 0.5]])
    last = np.array([[0.5, 0.0], [0.0, 0.25], [0.25, 0.25], [0.0, 0.5], [-0.25, 0.0], [0.0, 0.125]])
    parts = [first, np.array([0.25, 0.5]), np.array([[0.5, 0.25]]), np.array([0.125]), np.array([[0.5], [1.0]]), np.array([0.25, -0.125]), last, np.full(6, 0.0625)]
    return network.load(np.concatenate([p.ravel() for p in parts]))


def _standard(spark, folder) -> DataFrame:
    return J.standardized(J.journal(spark, folder)).select("row_id", "features")


def network_reconstruction(spark, folder):
    found = Autoencoder(_set_network()).reconstruct(_standard(spark, folder))
    return _rounded(found.select("row_id", F.posexplode("reconstruction").alias("position", "value")))


def network_embedding(spark, folder):
    found = Autoencoder(_set_network()).embed(_standard(spark, folder))
    return _rounded(found.select("row_id", F.element_at("embedding", 1).alias("value")))


def network_score(spark, folder):
    return _rounded(Autoencoder(_set_network()).transform(_standard(spark, folder)).select("row_id", "score"))


def network_saliency(spark, folder):
    found = gradients.saliency(_standard(spark, folder), _set_network())
    return _rounded(found.select("row_id", F.posexplode("phi").alias("position", "value")))


def network_grad_input(spark, folder):
    found = gradients.gradient_times_input(_standard(spark, folder), _set_network())
    return _rounded(found.select("row_id", F.posexplode("phi").alias("position", "value")))


def network_relevance(spark, folder):
    """Relevance on a scale that shows large and small values alike: shares of a sum near zero are large."""
    found = gradients.lrp(_standard(spark, folder), _set_network())
    return _rounded(found.select("row_id", F.posexplode("phi").alias("position", "value")).withColumn("value", F.asinh("value")))


_COMPONENTS = [([0.5, 0.5, 0.5, 0.5, 0.0, 0.0], 0.5), ([0.0, 0.0, 0.0, 0.0, 0.6, -0.8], 0.25), ([1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0.125)]


def components_score(spark, folder):
    """The principal component detector's score with set components, by batches and as an expression."""
    detector = PcaDetector(np.array([c for c, _ in _COMPONENTS]), np.array([w for _, w in _COMPONENTS]), np.full(6, 0.25), np.full(6, 2.0))
    found = detector.transform(_standard(spark, folder)).withColumn("expression", detector.expression(F.col("features")))
    return _rounded(found.select("row_id", "score", "expression"))


def network_path(spark, folder):
    """Gradients on the path from zero, at two places of it."""
    df = _standard(spark, folder).withColumn("reference", F.array(*[F.lit(0.0)] * 6))
    found = gradients.integrated_gradients(df, _set_network(), steps=2)
    return _rounded(found.select("row_id", F.posexplode("phi").alias("position", "value")))


def explanation_by_gradient(spark, folder):
    """The whole explanation path: attribute, sum to two groups of columns, report on the marked rows."""
    df = S.get_frauds(J.standardized(J.journal(spark, folder))).select("row_id", "features")
    found, _ = explain_anomalies(df, Autoencoder(_set_network()), "grad_input", groups=[[0, 1, 2], [3, 4, 5]])
    return _rounded(found.select("row_id", F.posexplode("phi").alias("position", "value")))


QUERIES = {
    "ledger_scan": ledger_scan,
    "ledger_row_ids": ledger_row_ids,
    "named_splits": named_splits,
    "catalog_scan": catalog_scan,
    "catalog_column_names": catalog_column_names,
    "gold_scan": gold_scan,
    "explanation_scan": explanation_scan,
    "explanation_runs": explanation_runs,
    "scores_written": scores_written,
    "summary_appended": summary_appended,
    "run_written": run_written,
    "saved_detector": saved_detector,
    "notes_dropped": notes_dropped,
    "notes_to_front": notes_to_front,
    "label_split": label_split,
    "columns_mapped": columns_mapped,
    "encoded_groups": encoded_groups,
    "seeds_kept": seeds_kept,
    "numbers_as_they_are": numbers_as_they_are,
    "network_reconstruction": network_reconstruction,
    "network_embedding": network_embedding,
    "network_score": network_score,
    "network_saliency": network_saliency,
    "network_grad_input": network_grad_input,
    "network_path": network_path,
    "network_relevance": network_relevance,
    "components_score": components_score,
    "explanation_by_gradient": explanation_by_gradient,
}

# --- SQL -------------------------------------------------------------------------------

_LEDGER = f"'Schlüssel-' || row_id AS key, {', '.join(J.CATEGORICAL)}, " + ", ".join(_r(c, c) for c in J.NUMERIC) + ", label"
_ROLES = [*[(c, "cat") for c in J.CATEGORICAL], *[(c, "num") for c in J.NUMERIC], ("label", "note")]
_CATALOG = f"WITH {JOURNAL} " + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c} (de)' AS name_de, '{c}' AS name_en, '{r}' AS role, count({c}) AS filled, count(DISTINCT {c}) AS different FROM journal"
    for i, (c, r) in enumerate(_ROLES)
)


def _filled(names: Sequence[str]) -> str:
    return "(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in names) + ")"


_FLOW = ", ".join(f"({p}, '{s}')" for s, ps in K.flow_group_positions().items() for p in ps)


def _network_sql(scale: str = "1.0") -> str:
    """Steps of the set network at ``scale`` times a row: x, the rectified steps, output and gradient."""
    network = _set_network()
    w1, b1, w2, b2, w3, b3, w4, b4 = network.weights
    dot = lambda names, row, bias: " + ".join([f"{v!r} * {n}" for v, n in zip(map(float, row), names) if v] + [repr(float(bias))])
    x = [f"x{i}" for i in range(6)]
    hidden = ", ".join(f"greatest({dot(x, w1[j], b1[j])}, 0.0) AS h{j}" for j in range(2))
    back = ", ".join(f"greatest({dot(['e'], w3[j], b3[j])}, 0.0) AS g{j}" for j in range(2))
    out = ", ".join(f"{dot(['g0', 'g1'], w4[i], b4[i])} AS o{i}" for i in range(6))
    differences = ", ".join(f"o{i} - x{i} + 1e-6 AS d{i}" for i in range(6))
    squares = " + ".join(f"d{i} * d{i}" for i in range(6))
    up_g = ", ".join("(" + " + ".join(f"{float(w4[i][j])!r} * d{i} / err" for i in range(6)) + f") * (g{j} > 0)::INTEGER AS ug{j}" for j in range(2))
    up_h = ", ".join(f"ue * {float(w2[0][j])!r} * (h{j} > 0)::INTEGER AS uh{j}" for j in range(2))
    grads = ", ".join(" + ".join(f"uh{j} * {float(w1[j][i])!r}" for j in range(2)) + f" - d{i} / err AS p{i}" for i in range(6))
    return f"""n0 AS (SELECT row_id, label, z, {", ".join(f"z[{i + 1}] * {scale} AS x{i}" for i in range(6))} FROM standard),
      n1 AS (SELECT *, {hidden} FROM n0), n2 AS (SELECT *, {dot(["h0", "h1"], w2[0], b2[0])} AS e FROM n1),
      n3 AS (SELECT *, {back} FROM n2), n4 AS (SELECT *, {out} FROM n3), n5 AS (SELECT *, {differences} FROM n4),
      n6 AS (SELECT *, sqrt({squares}) AS err FROM n5), n7 AS (SELECT *, {up_g} FROM n6),
      n8 AS (SELECT *, {" + ".join(f"ug{j} * {float(w3[j][0])!r}" for j in range(2))} AS ue FROM n7),
      n9 AS (SELECT *, {up_h} FROM n8), net AS (SELECT *, {grads} FROM n9)"""


def _each(value: str, source: str = "net") -> str:
    """One row per position; ``{i}`` in value is the position."""
    parts = [f"SELECT row_id, {i}::INTEGER AS position, {_r(value.format(i=i), 'value')} FROM {source}" for i in range(6)]
    return " UNION ALL ".join(parts)


def _relevance_sql() -> str:
    """The set network's relevance from its steps, layer by layer from the output back."""
    w1, b1, w2, b2, w3, b3, w4, b4 = _set_network().weights

    def layer(weights, bias, inputs, passed, out, shares):
        grown = [[float(v + gradients.GAMMA * max(v, 0.0)) for v in row] for row in weights]
        made = [" + ".join(f"{v!r} * {x}" for v, x in zip(row, inputs)) + f" + {float(b)!r}" for row, b in zip(grown, bias)]
        made = [f"({p}) / ({m} + CASE WHEN {m} >= 0 THEN 1 ELSE -1 END * {gradients.STABILITY!r}) AS {shares}{i}" for i, (p, m) in enumerate(zip(passed, made))]
        back = [f"{x} * ({' + '.join(f'{row[j]!r} * {shares}{i}' for i, row in enumerate(grown))}) AS {out}{j}" for j, x in enumerate(inputs)]
        return ", ".join(made), ", ".join(back)

    x = [f"x{i}" for i in range(6)]
    whole = " + ".join(f"(o{i} - x{i}) ** 2" for i in range(6))
    steps = [
        layer(w4, b4, ["g0", "g1"], [f"(o{i} - x{i}) ** 2 / greatest(size, {gradients.STABILITY!r})" for i in range(6)], "rg", "s4_"),
        layer(w3, b3, ["e"], ["rg0", "rg1"], "re", "s3_"),
        layer(w2, b2, ["h0", "h1"], ["re0"], "rh", "s2_"),
        layer(w1, b1, x, ["rh0", "rh1"], "r", "s1_"),
    ]
    parts, before = [f"l0 AS (SELECT *, sqrt({whole}) AS size FROM net)"], "l0"
    for number, (made, back) in enumerate(steps, start=1):
        parts += [f"m{number} AS (SELECT *, {made} FROM {before})", f"l{number} AS (SELECT *, {back} FROM m{number})"]
        before = f"l{number}"
    return ", ".join(parts)


_NODES = [(1 - 3**-0.5) / 2, (1 + 3**-0.5) / 2]
_PATH = " UNION ALL ".join(f"SELECT * FROM (WITH {_network_sql(repr(t))} SELECT * FROM net)" for t in _NODES)

CHECKS = {
    "ledger_scan": f"WITH {JOURNAL} SELECT {_LEDGER} FROM journal",
    "ledger_row_ids": "SELECT unnest(range(0, count(*))) AS row_id FROM orders",
    "named_splits": f"WITH {JOURNAL} SELECT {_LEDGER}, split FROM journal",
    "catalog_scan": _CATALOG,
    "catalog_column_names": f"""WITH {JOURNAL} SELECT row_id, {_filled(J.NUMERIC)} AS numbers, {_filled(J.CATEGORICAL)} AS categories,
        {_filled([*J.CATEGORICAL, *J.NUMERIC])} AS encoded FROM journal""",
    "gold_scan": f"""WITH {EXPLAINED}, f AS (SELECT * FROM explained WHERE label LIKE 'Fraud%')
        SELECT row_id, unnest({J.NUMERIC}) AS feature, unnest(gold) AS gold FROM f""",
    "explanation_scan": f"""WITH {EXPLAINED}, l AS (SELECT row_id, unnest({J.NUMERIC}) AS feature, unnest(phi) AS v FROM explained)
        SELECT row_id, feature, {_r('v', 'phi')} FROM l""",
    "explanation_runs": f"""WITH {EXPLAINED} SELECT 'square' AS method, row_id, {_r('phi[1]', 'phi')} FROM explained
        UNION ALL SELECT 'double', row_id, {_r('2 * phi[1]', 'phi')} FROM explained""",
    "scores_written": f"WITH {SCORED} SELECT split, row_id, {_r('score', 'score')}, y FROM scored",
    "summary_appended": f"""WITH {SCORED} SELECT split, count(*) AS rows, NULL::BIGINT AS frauds FROM scored GROUP BY split
        UNION ALL SELECT split, NULL, sum(y)::BIGINT FROM scored GROUP BY split""",
    "run_written": f"""WITH {JOURNAL} SELECT 'counts' AS job, 7::INTEGER AS seed, '{{"by": "split"}}' AS params,
        split AS name, count(*)::DOUBLE AS value FROM journal GROUP BY split""",
    "saved_detector": f"WITH {SCORED} SELECT row_id, {_r('score', 'score')} FROM scored",
    "notes_dropped": f"WITH {JOURNAL} SELECT row_id, label, status FROM journal",
    "notes_to_front": f"""WITH {JOURNAL} SELECT row_id, 0::INTEGER AS place, status AS value FROM journal
        UNION ALL SELECT row_id, 1, label FROM journal UNION ALL SELECT row_id, 2, row_id::VARCHAR FROM journal""",
    "label_split": f"WITH {JOURNAL} SELECT row_id, status, label AS y FROM journal",
    "columns_mapped": 'SELECT event_id AS "Src IP", user_id AS "Traffic" FROM events',
    "encoded_groups": f"""SELECT source, count(*) AS events FROM events JOIN (VALUES {_FLOW}) AS g(position, source)
        ON event_id % 146 = position GROUP BY source""",
    "seeds_kept": f"WITH {MODEL_SET} SELECT seed, row_id, {_r('phi[1]', 'phi')} FROM model_set WHERE seed IN (1, 3)",
    "numbers_as_they_are": f"WITH {JOURNAL} SELECT row_id, 6::INTEGER AS width, {_r('totalprice', 'value')} FROM journal",
    "network_reconstruction": f"WITH {STANDARD}, {_network_sql()} {_each('o{i}')}",
    "network_embedding": f"WITH {STANDARD}, {_network_sql()} SELECT row_id, {_r('e', 'value')} FROM net",
    "network_score": f"WITH {STANDARD}, {_network_sql()} SELECT row_id, {_r('-err', 'score')} FROM net",
    "network_saliency": f"WITH {STANDARD}, {_network_sql()} {_each('p{i}')}",
    "network_grad_input": f"WITH {STANDARD}, {_network_sql()} {_each('p{i} * x{i}')}",
    "network_relevance": f"WITH {STANDARD}, {_network_sql()}, {_relevance_sql()} {_each('asinh(r{i})', 'l4')}",
    "components_score": f"""WITH {STANDARD}, x AS (SELECT row_id, [(v - 0.25) / 2.0 FOR v IN z] AS x FROM standard)
        SELECT row_id, {", ".join(_r("-(" + " + ".join(f"list_distance(x, {c}::DOUBLE[]) / {w}" for c, w in _COMPONENTS) + ")", n) for n in ("score", "expression"))}
        FROM x""",
    "network_path": f"""WITH {STANDARD}, both_ AS ({_PATH}), mean_ AS (
        SELECT row_id, {", ".join(f"avg(p{i}) * any_value(z[{i + 1}]) AS v{i}" for i in range(6))} FROM both_ GROUP BY row_id)
        {_each('v{i}', 'mean_')}""",
    "explanation_by_gradient": f"""WITH {STANDARD}, {_network_sql()}, f AS (SELECT * FROM net WHERE label LIKE 'Fraud%')
        SELECT row_id, 0::INTEGER AS position, {_r('p0 * x0 + p1 * x1 + p2 * x2', 'value')} FROM f
        UNION ALL SELECT row_id, 1, {_r('p3 * x3 + p4 * x4 + p5 * x5', 'value')} FROM f""",
}
