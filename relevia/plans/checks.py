"""SQL that gives the same result as a registered query, for an independent engine.

Keys are those of the queries. Queries that train a model, sample or optimise have none.
"""

from __future__ import annotations

from relevia.plans.journal import EVAL_UNTIL, FIXED_TREES, GOLD_FROM, LABEL_RULES, NUMERIC, TRAIN_UNTIL

FIELDS = list(enumerate(NUMERIC, start=1))
VALUES = {c: f"coalesce({c}, 0.0)" for c in NUMERIC}

_CASES = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in LABEL_RULES)
_GOLD = ", ".join(
    "0" if GOLD_FROM[c] is None else f"CASE WHEN {c} >= {GOLD_FROM[c]} THEN 1 ELSE 0 END" for c in NUMERIC
)

JOURNAL = f"""
lines AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS amt,
         max(l_discount) AS disc, max(l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey),
joined AS (
  SELECT o_orderkey AS row_id,
         CASE WHEN o_orderdate < TIMESTAMP '{TRAIN_UNTIL}' THEN 'train'
              WHEN o_orderdate < TIMESTAMP '{EVAL_UNTIL}' THEN 'eval' ELSE 'test' END AS split,
         o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment,
         o_totalprice AS totalprice, CAST(n_lines AS DOUBLE) AS n_lines, qty, amt, disc, tax
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey),
journal AS (
  SELECT *, CASE {_CASES} ELSE 'NonFraud' END AS label, [{_GOLD}] AS gold FROM joined)
"""

_PARAMS = ", ".join(
    f"round(avg({v}), 4) AS m_{c}, coalesce(nullif(round(stddev_pop({v}), 4), 0), 1) AS s_{c}"
    for c, v in VALUES.items()
)
_Z = ", ".join(f"({v} - m_{c}) / s_{c}" for c, v in VALUES.items())

STANDARD = f"""{JOURNAL},
params AS (SELECT {_PARAMS} FROM journal WHERE split = 'train'),
standard AS (SELECT row_id, split, label, segment, gold, [{_Z}] AS z FROM journal, params)
"""

_PHI = "list_transform(z, lambda v: v * v)"
_SIGNED = "list_transform(z, lambda v: v * abs(v))"

EXPLAINED = f"{STANDARD}, explained AS (SELECT *, {_PHI} AS phi FROM standard)"
EXPLAINED_SIGNED = f"{STANDARD}, explained AS (SELECT *, {_SIGNED} AS phi FROM standard)"

LONG = """,
long AS (
  SELECT row_id, label, unnest(range(1, 7)) AS f, unnest(phi) AS phi, unnest(gold) AS gold FROM explained)
"""

_NORM = " + ".join(f"z[{i}] * z[{i}]" for i, _ in FIELDS)
SCORED = f"""{STANDARD}, scored AS (
  SELECT row_id, split, label, -sqrt({_NORM}) AS score,
         CASE WHEN label LIKE 'Fraud\\_%' ESCAPE '\\' THEN 1 ELSE 0 END AS y FROM standard)
"""



def _model_set(phi: str) -> str:
    return f"""{JOURNAL},
segments AS (SELECT segment AS left_out, row_number() OVER (ORDER BY segment) - 1 AS seed
             FROM (SELECT DISTINCT segment FROM journal)),
set_params AS (SELECT seed, {_PARAMS} FROM segments, journal
               WHERE split = 'train' AND segment <> left_out GROUP BY seed),
set_z AS (SELECT CAST(seed AS INTEGER) AS seed, row_id, label, gold, [{_Z}] AS z FROM journal, set_params),
model_set AS (SELECT seed, row_id, label, gold, {phi} AS phi FROM set_z)
"""


MODEL_SET = _model_set(_PHI)
MODEL_SET_SIGNED = _model_set(_SIGNED)


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def per_field(vector: str, prefix: str = "") -> str:
    return ", ".join(r6(f"{vector}[{i}]", f"{prefix}{c}") for i, c in FIELDS)


def uniform(*parts: str) -> str:
    joined = ", ".join(parts)
    return f"(CAST('0x' || substr(md5(concat_ws(':', {joined})), 1, 8) AS BIGINT) / 4294967296.0)"


# --- row metrics on the long table -----------------------------------------------------

ROW_ROC = """
  SELECT p.row_id, avg(CASE WHEN p.phi > q.phi THEN 1.0 WHEN p.phi = q.phi THEN 0.5 ELSE 0.0 END) AS roc
  FROM long p JOIN long q ON p.row_id = q.row_id AND p.gold = 1 AND q.gold = 0 GROUP BY p.row_id"""
ROW_PR = """
  SELECT row_id, avg(hits / total) AS pr FROM (
    SELECT p.row_id, p.f, count(*) FILTER (q.gold = 1) AS hits, count(*) AS total
    FROM long p JOIN long q ON p.row_id = q.row_id AND q.phi >= p.phi
    WHERE p.gold = 1 AND p.row_id IN (SELECT row_id FROM long WHERE gold = 0)
    GROUP BY p.row_id, p.f) GROUP BY row_id"""
ROW_COS = """
  SELECT row_id, coalesce(sum(phi * gold) / nullif(sqrt(sum(phi * phi)) * sqrt(sum(gold)), 0), 0.0) AS cosine
  FROM long GROUP BY row_id"""
ROW_CORR = """
  SELECT row_id, CASE WHEN min(gold) < max(gold) AND min(phi) < max(phi) THEN corr(phi, gold) END AS pearson
  FROM long GROUP BY row_id"""


def _gini(value: str) -> str:
    return f"""
  SELECT row_id, coalesce(1 - 2 * sum((6 - i + 0.5) * v) / nullif(6 * sum(v), 0), 0.0) AS g FROM (
    SELECT row_id, {value} AS v, row_number() OVER (PARTITION BY row_id ORDER BY {value}) AS i FROM long)
  GROUP BY row_id"""


def _distraction(value: str) -> str:
    return f"""
  SELECT row_id, coalesce(sum({value} * (1 - gold)) / nullif(sum({value}), 0), 0.0) AS d FROM long GROUP BY row_id"""


_FRAUDS_ONLY = "long AS (SELECT * FROM long_all WHERE label LIKE 'Fraud\\_%' ESCAPE '\\')"


def _fraud_long(explained: str) -> str:
    return explained + LONG.replace("long AS", "long_all AS") + ", " + _FRAUDS_ONLY


def _mean_std(name: str, column: str) -> str:
    return f"{r6(f'avg({column})', f'{name}_mean')}, {r6(f'stddev_pop({column})', f'{name}_std')}"


_COMPACT_JOINS = f"""
  JOIN ({_gini('greatest(phi, 0.0)')}) g USING (row_id) JOIN ({_gini('abs(phi)')}) ga USING (row_id)
  JOIN ({_distraction('greatest(phi, 0.0)')}) d USING (row_id) JOIN ({_distraction('abs(phi)')}) da USING (row_id)"""

# Mean ROC of the frauds is above one half for squared z-scores, so no sign is flipped.
_SIZE_FROM = f"""
  FROM (SELECT DISTINCT row_id, label FROM long) l
  LEFT JOIN ({ROW_ROC}) roc USING (row_id) JOIN ({ROW_COS}) cos USING (row_id) {_COMPACT_JOINS}"""
_COMPACT_COLUMNS = ", ".join(
    [
        _mean_std("gini", "g.g"),
        _mean_std("gini_abs", "ga.g"), _mean_std("dist", "d.d"), _mean_std("dist_abs", "da.d"),
    ]
)
_SIZE_COLUMNS = ", ".join([_mean_std("roc", "roc.roc"), _mean_std("cos", "cos.cosine"), _COMPACT_COLUMNS])
_REPORT_FROM = f"""
  FROM (SELECT DISTINCT row_id, label FROM long) l
  LEFT JOIN ({ROW_ROC}) roc USING (row_id) LEFT JOIN ({ROW_PR}) pr USING (row_id)
  LEFT JOIN ({ROW_CORR}) co USING (row_id) JOIN ({ROW_COS}) cos USING (row_id)"""
_REPORT_COLUMNS = ", ".join(
    [
        _mean_std("roc", "roc.roc"), _mean_std("pr", "pr.pr"), _mean_std("pearson", "co.pearson"),
        _mean_std("cosine", "cos.cosine"), "count(*) AS rows", "count(roc.roc) AS rows_with_roc",
    ]
)


# --- detector metrics ------------------------------------------------------------------


def _score_metrics(source: str, by: str | None) -> str:
    """All metrics by direct definitions on the row table ``source`` (score, y, by)."""
    key = by or "k"
    part = f"PARTITION BY {key}"
    keyed = f"SELECT *, {key} AS g FROM {source}" if by else f"SELECT *, 0 AS k, 0 AS g FROM {source}"
    return f"""
rows_ AS ({keyed}),
ranked AS (SELECT *, row_number() OVER ({part} ORDER BY score, y) AS rn,
                  rank() OVER ({part} ORDER BY score) AS lowest, count(*) OVER ({part}, score) AS same,
                  sum(y) OVER ({part} ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
                  count(*) OVER ({part} ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
                  sum(y) OVER ({part}) AS tp, count(*) OVER ({part}) AS tn FROM rows_),
metrics AS (
  SELECT g,
    1 - (sum(lowest + (same - 1) / 2.0) FILTER (y = 1) - max(tp) * (max(tp) + 1) / 2.0)
        / nullif(max(tp) * (max(tn) - max(tp)), 0) AS auc_roc,
    avg(cp / cn) FILTER (y = 1) AS auc_pr,
    avg(rn) FILTER (y = 1) AS rank_mean, stddev_pop(rn) FILTER (y = 1) AS rank_std,
    max(score) FILTER (y = 1) AS max_fraud, CAST(max(cn) FILTER (y = 1) AS BIGINT) AS min_detect
  FROM ranked GROUP BY g)
"""


_METRIC_NAMES = ["auc_roc", "auc_pr", "rank_mean", "rank_std", "max_fraud", "min_detect"]


def _metric_list(names: list[str]) -> str:
    return ", ".join(n if n == "min_detect" else r6(n, n) for n in names)


def _by_split(*names: str) -> str:
    return f"WITH {SCORED}, {_score_metrics('scored', 'split')} SELECT g AS split, {_metric_list(list(names))} FROM metrics"


# --- encoders --------------------------------------------------------------------------


def _categories(column: str, where: str = "") -> str:
    return (
        f"(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT coalesce({column}, 'nan') AS v FROM journal "
        f"WHERE split = 'train' {where}))"
    )


def _bits(column: str, where: str = "", off: int = 0) -> str:
    return f"list_transform({_categories(column, where)}, lambda v: CASE WHEN v = {column} THEN 1 ELSE {off} END)"


def _text(vector: str) -> str:
    return f"array_to_string({vector}, ',')"


_NO_MEDIUM = "AND priority <> '3-MEDIUM'"
_NO_URGENT = "AND priority <> '1-URGENT'"


def _code(column: str, where: str) -> str:
    return (
        f"CASE WHEN list_contains({_categories(column, where)}, {column}) "
        f"THEN list_position({_categories(column, where)}, {column}) - 1 ELSE -1000000 END"
    )


def _known(column: str, where: str) -> str:
    return f"CASE WHEN list_contains({_categories(column, where)}, {column}) THEN {column} END AS {column}"


def _log(v: str) -> str:
    return f"sign({v}) * CASE WHEN abs({v}) >= 1 THEN log10(abs({v})) + 1 ELSE abs({v}) END"


def _path(nodes: list[tuple], at: int = 0) -> str:
    """The path length of a row in a tree of nodes, as nested cases."""
    field, threshold, left, right, path = nodes[at]
    if left == at:
        return str(path)
    return f"CASE WHEN z[{field + 1}] <= {threshold} THEN {_path(nodes, left)} ELSE {_path(nodes, right)} END"


_FOREST = (
    f"-pow(2, -({' + '.join(_path(t) for t in FIXED_TREES)}) / ({len(FIXED_TREES)} "
    "* (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0)))"
)


def _edges(strategy: str, c: str) -> str:
    """Bucket edges of one field as a list, rounded as the query rounds them."""
    base = f"(SELECT {c} AS v FROM journal WHERE split = 'train' AND {c} <> 0)"
    if strategy == "uniform":
        inner = (
            f"SELECT list_transform([0, 1, 2, 3, 4], lambda i: lo + i * ((hi - lo) / 5)) || [hi] AS e "
            f"FROM (SELECT min(v) AS lo, max(v) AS hi FROM {base})"
        )
    elif strategy == "quantile":
        inner = (
            "SELECT list_filter(q, lambda x, i: i = 1 OR x - q[i - 1] > 1e-8) AS e "
            f"FROM (SELECT quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM {base})"
        )
    else:
        inner = f"""
          SELECT [min(v)] || (SELECT quantile_cont(v, [0.0, 1.0 / 3, 2.0 / 3, 1.0]) FROM limits, {base}
                              WHERE v > lo AND v < hi) || [max(v)] AS e FROM {base}"""
        inner = f"""
          WITH sorted AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM {base}),
          limits AS (SELECT max(v) FILTER (i = CAST(floor(n * 0.01) AS BIGINT)) AS lo,
                            max(v) FILTER (i = CAST(floor(n * 0.99) AS BIGINT)) AS hi FROM sorted)
          {inner}"""
    return f"(SELECT list_transform(e, lambda x: round(x, 7)) FROM ({inner}))"


def _bucket(strategy: str, c: str) -> str:
    x = f"({VALUES[c]} + (1e-8 + 1e-5 * abs({VALUES[c]})))"
    over = f"len(list_filter(e_{c}[2:], lambda e: {x} >= e))"
    return f"CASE WHEN {VALUES[c]} = 0 THEN 5 ELSE least({over}, 4) END"


def _buckets(strategy: str) -> str:
    edges = ", ".join(f"{_edges(strategy, c)} AS e_{c}" for c in NUMERIC)
    numbers = ", ".join(_bucket(strategy, c) for c in NUMERIC)
    return f"WITH {JOURNAL}, edges AS (SELECT {edges}) SELECT row_id, {_text(f'[{numbers}]')} AS buckets FROM journal, edges"


def _bucket_onehot(columns: list[str]) -> str:
    edges = ", ".join(f"{_edges('outlier', c)} AS e_{c}" for c in columns)
    parts = " || ".join(
        f"list_transform(range(0, 6), lambda b: CASE WHEN b = {_bucket('outlier', c)} THEN 1 ELSE 0 END)" for c in columns
    )
    return f"WITH {JOURNAL}, edges AS (SELECT {edges}) SELECT row_id, {_text(parts)} AS bits FROM journal, edges"


_RANGES = ", ".join(f"min({v}) AS lo_{c}, coalesce(nullif(max({v}) - min({v}), 0), 1) AS w_{c}" for c, v in VALUES.items())
_SCALED = ", ".join(f"({v} - lo_{c}) / w_{c}" for c, v in VALUES.items())

# --- attribution -----------------------------------------------------------------------

ENCODED = f"""{STANDARD},
encoded AS (
  SELECT row_id, list_transform({_bits('status')} || {_bits('priority')} || {_bits('segment')} || z,
                                lambda x: (x - 0.25) * (x - 0.25)) AS phi,
         len({_categories('status')}) AS n1, len({_categories('priority')}) AS n2, len({_categories('segment')}) AS n3
  FROM journal JOIN (SELECT row_id, z FROM standard) USING (row_id))
"""
_CAT_SUMS = [
    ("status", "list_sum(phi[1:n1])"),
    ("priority", "list_sum(phi[n1 + 1:n1 + n2])"),
    ("segment", "list_sum(phi[n1 + n2 + 1:n1 + n2 + n3])"),
]
_NUM_AT = [(c, f"phi[n1 + n2 + n3 + {i}]") for i, c in FIELDS]


def _shap(score_points: str, score: str) -> str:
    """Attributions from the scores of all 64 coalitions; ``score`` uses x, p and mask m."""
    return f"""
masks AS (SELECT m, bit_count(m) AS s FROM range(0, 64) t(m)),
values_ AS (
  SELECT row_id, m, s, sum(weight * ({score})) AS v
  FROM standard, masks, {score_points} GROUP BY row_id, m, s),
phis AS (
  SELECT row_id, j, sum(CASE WHEN (m >> j) & 1 = 1
                             THEN v * factorial(CAST(s - 1 AS INTEGER)) * factorial(CAST(6 - s AS INTEGER)) / 720.0
                             ELSE -v * factorial(CAST(s AS INTEGER)) * factorial(CAST(5 - s AS INTEGER)) / 720.0 END) AS phi
  FROM values_, range(0, 6) t(j) GROUP BY row_id, j)
"""


_MASKED = " + ".join(
    f"(CASE WHEN (m >> {i - 1}) & 1 = 1 THEN z[{i}] ELSE p[{i}] END) ** 2" for i, _ in FIELDS
)
_PIVOTED = ", ".join(r6(f"max(phi) FILTER (j = {i - 1})", c) for i, c in FIELDS)
_ZERO_POINT = "(SELECT [0.0, 0.0, 0.0, 0.0, 0.0, 0.0] AS p, 1.0 AS weight)"
_SEGMENT_POINTS = (
    "points AS (SELECT [" + ", ".join(f"round(avg(z[{i}]), 4)" for i, _ in FIELDS) + "] AS p, "
    "count(*) / (SELECT count(*) FROM standard WHERE split = 'train') AS weight "
    "FROM standard WHERE split = 'train' GROUP BY segment)"
)

_T, _Q = NUMERIC.index("totalprice") + 1, NUMERIC.index("qty") + 1
_REST = " + ".join(f"z[{i}] ** 2" for i, _ in FIELDS if i not in (_T, _Q))

# --- consistency -----------------------------------------------------------------------

CUBE = f"""{MODEL_SET_SIGNED},
unit AS (
  SELECT seed, row_id, list_transform(phi, lambda v: v / n) AS x FROM (
    SELECT *, sqrt({' + '.join(f'phi[{i}] * phi[{i}]' for i, _ in FIELDS)}) AS n FROM model_set)),
cube AS (
  SELECT seed, row_id, x,
    list_transform(list_sort(list_transform(range(1, 7), lambda i: [abs(x[i]), i]), 'DESC'), lambda t: CAST(t[2] AS INTEGER)) AS mag,
    list_transform(list_sort(list_transform(range(1, 7), lambda i: [x[i], i]), 'DESC'), lambda t: CAST(t[2] AS INTEGER)) AS val
  FROM unit),
pairs_by_row AS (
  SELECT a.seed AS seed_a, b.seed AS seed_b, a.row_id,
    sqrt({' + '.join(f'(a.x[{i}] - b.x[{i}]) ** 2' for i, _ in FIELDS)}) AS euclid,
    sqrt({' + '.join(f'(abs(a.x[{i}]) - abs(b.x[{i}])) ** 2' for i, _ in FIELDS)}) AS euclid_abs,
    1 - len(list_filter(a.mag[1:3], lambda i: list_contains(b.mag[1:3], i) AND a.x[i] * b.x[i] >= 0)) / 3 AS sign_disagreement,
    1 - len(list_intersect(a.mag[1:3], b.mag[1:3])) / 3 AS feature_disagreement,
    (2 - len(list_intersect(a.val[1:3], b.val[1:3])) / 3 - len(list_intersect(a.val[2:4], b.val[2:4])) / 3) / 2 AS ranking
  FROM cube a JOIN cube b ON a.row_id = b.row_id AND a.seed < b.seed),
pairs AS (
  SELECT seed_a, seed_b, count(*) AS rows, avg(euclid) AS euclid, avg(euclid_abs) AS euclid_abs,
         avg(sign_disagreement) AS sign_disagreement, avg(feature_disagreement) AS feature_disagreement,
         avg(ranking) AS ranking
  FROM pairs_by_row GROUP BY seed_a, seed_b)
"""
RAW_CUBE = CUBE.replace("lambda v: v / n", "lambda v: v")
_TOP3 = " + ".join(f"(a.x[a.val[{i}]] - b.x[b.val[{i}]]) ** 2" for i in (1, 2, 3))


def _pair(name: str) -> str:
    return f"WITH {CUBE} SELECT seed_a, seed_b, rows, {r6(name, name)} FROM pairs"


_PAIR_LONG = " UNION ALL ".join(
    f"SELECT '{n}' AS metric, {n} AS value FROM pairs"
    for n in ("euclid_abs", "euclid", "sign_disagreement", "feature_disagreement")
)

# --- similarity ------------------------------------------------------------------------

PATTERNS = f"""{EXPLAINED},
flags AS (SELECT row_id, label, list_transform(phi, lambda v: CASE WHEN v > 0.25 * list_max(phi) THEN 1 ELSE 0 END) AS h
          FROM explained),
patterns AS (SELECT array_to_string(h, '') AS pattern, any_value(h) AS h, count(*) AS rows FROM flags GROUP BY 1)
"""
_DIFFER = " + ".join(f"(CASE WHEN a.h[{i}] <> b.h[{i}] THEN 1 ELSE 0 END)" for i, _ in FIELDS)

# --- sparse rows -----------------------------------------------------------------------

_SPARSE_COLUMNS = ("customer", "status", "priority")
_PLACE = " ".join(
    f"LEFT JOIN codes AS {c} ON {c}.source_name = '{c}' AND {c}.value = coalesce(CAST(o.{c} AS VARCHAR), 'nan')"
    for c in _SPARSE_COLUMNS
)
_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS source_name, {i} AS turn, coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM fit_rows"
    for i, c in enumerate(_SPARSE_COLUMNS)
)
SPARSE = f"""
o AS (SELECT o_orderkey AS row_id, o_custkey AS customer, o_orderstatus AS status, o_orderpriority AS priority,
             coalesce(o_totalprice, 0) AS totalprice, o_orderdate < TIMESTAMP '{TRAIN_UNTIL}' AS train FROM orders),
fit_rows AS (SELECT * FROM o WHERE train AND row_id % 3 <> 0),
codes AS (SELECT source_name, value, row_number() OVER (ORDER BY turn, value) - 1 AS place
          FROM (SELECT DISTINCT source_name, turn, value FROM ({_CELLS}))),
limits AS (SELECT min(totalprice) AS low, coalesce(nullif(max(totalprice) - min(totalprice), 0), 1) AS span FROM fit_rows),
encoded AS (SELECT o.row_id, o.train, customer.place AS customer, status.place AS status, priority.place AS priority,
                   (totalprice - low) / span AS price FROM o {_PLACE}, limits)
"""
_ERROR = {
    c: f"(SELECT sum(m * m) FROM means WHERE source_name = '{c}') + CASE WHEN {c} IS NULL THEN 0 ELSE 1 - 2 * coalesce("
    f"(SELECT m FROM means WHERE place = {c}), 0) END"
    for c in _SPARSE_COLUMNS
}

# --- neighbours ------------------------------------------------------------------------

DISTANCES = """
vectors AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
distances AS (
  SELECT a.id AS query, b.id AS neighbor, a.label AS label_a, b.label AS label_b,
         list_distance(a.x, b.x) AS distance
  FROM vectors a JOIN vectors b ON a.id <> b.id)
"""


def _nearest(k: int, where: str = "true", name: str = "nearest", source: str = "distances") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS rank
                 FROM {source} WHERE {where}) WHERE rank <= {k})"""


_KNN_COLUMNS = f"query, neighbor, {r6('distance', 'distance')}, CAST(rank AS INTEGER) AS rank"


def _lof(k: int, novelty: bool) -> str:
    inner = "label_a <> 0 AND label_b <> 0" if novelty else "true"
    outer = "label_a = 0 AND label_b <> 0" if novelty else "true"
    return f"""WITH {DISTANCES}, {_nearest(k, inner, 'inner_')}, {_nearest(k, outer, 'outer_')},
kd AS (SELECT query AS neighbor, max(distance) AS kd FROM inner_ GROUP BY 1),
base_density AS (SELECT query, 1 / (avg(greatest(distance, kd)) + 1e-10) AS d FROM inner_ JOIN kd USING (neighbor) GROUP BY 1),
own AS (SELECT query, 1 / (avg(greatest(distance, kd)) + 1e-10) AS d FROM outer_ JOIN kd USING (neighbor) GROUP BY 1),
around AS (SELECT o.query, avg(b.d) AS near FROM outer_ o JOIN base_density b ON o.neighbor = b.query GROUP BY 1)
SELECT query AS row_id, {r6('near / d', 'lof')}, {r6('-near / d', 'score')} FROM around JOIN own USING (query)"""


def _trailing(key: str, seconds: int, name: str) -> str:
    return (
        f"count(*) OVER (PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING "
        f"AND CURRENT ROW) AS {name}"
    )


_IS_FRAUD = "label LIKE 'Fraud\\_%' ESCAPE '\\'"
_OVERSAMPLE = f"""WITH {JOURNAL},
sizes AS (SELECT label, count(*) AS n FROM journal GROUP BY label),
largest AS (SELECT max(n) AS top FROM sizes),
small AS (SELECT label, n, unnest(range(0, top)) AS draw FROM sizes, largest WHERE n < top),
draws AS (SELECT label, CAST(floor({uniform("'5'", 'label', 'CAST(draw AS VARCHAR)')} * n) AS BIGINT) AS idx, draw FROM small),
counted AS (SELECT label, idx, CAST(floor(draw / 65536) AS BIGINT) AS piece, count(*) AS times FROM draws GROUP BY 1, 2, 3),
numbered AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS idx FROM journal)
SELECT row_id, label, CAST(0 AS BIGINT) AS copy FROM journal
UNION ALL
SELECT row_id, label, copy FROM (
  SELECT row_id, label, unnest(range(piece * 65536 + 1, piece * 65536 + 1 + times)) AS copy
  FROM numbered JOIN counted USING (label, idx))"""

_FLAG_NAMES = ["totalprice", "qty", "totalprice_0", "qty_0"]
GROUP_MAP = f"""{JOURNAL},
cats AS (
  SELECT DISTINCT 0 AS o, 'status' AS source_name, status AS v FROM journal WHERE split = 'train'
  UNION SELECT 1, 'priority', priority FROM journal WHERE split = 'train'
  UNION SELECT 2, 'segment', segment FROM journal WHERE split = 'train'),
named AS (
  SELECT o, v, source_name || '_' || v AS enc_name, source_name, 'cat' AS kind FROM cats
  UNION ALL SELECT * FROM (VALUES {', '.join(f"(3, '{i}', '{n}', '{n.removesuffix('_0')}', 'num')" for i, n in enumerate(_FLAG_NAMES))})),
group_map AS (
  SELECT CAST(row_number() OVER (ORDER BY o, v) - 1 AS INTEGER) AS enc_pos, enc_name, source_name, kind FROM named)
"""

_LOG_COLUMNS = ", ".join(
    f"{r6(_log(VALUES[c]), c)}, CASE WHEN {VALUES[c]} = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS {c}_0" for c in NUMERIC
)
_Z_COLUMNS = per_field("z") + ", " + ", ".join(
    f"CASE WHEN {VALUES[c]} = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS {c}_0" for c in NUMERIC
)
_NOISE = [f"(-1 + 2 * {uniform(chr(39) + '7' + chr(39), 'CAST(row_id AS VARCHAR)', repr(str(i - 1)))})" for i, _ in FIELDS]

CHECKS: dict[str, str] = {
    "labels_fraud_only": f"WITH {JOURNAL} SELECT row_id, CASE WHEN {_IS_FRAUD} THEN label ELSE 'NonFraud' END AS label FROM journal",
    "get_frauds": f"""WITH {JOURNAL} SELECT row_id, label, CASE WHEN {_IS_FRAUD} THEN 1 ELSE 0 END AS fraud
        FROM journal WHERE label <> 'NonFraud'""",
    "adjust_labels": f"""WITH {JOURNAL} SELECT row_id,
        CASE WHEN label IN ('Fraud_Larceny', 'Event_Bulk') THEN 'NonFraud' ELSE label END AS label FROM journal""",
    "binarize": f"WITH {JOURNAL} SELECT row_id, CASE WHEN label <> 'NonFraud' THEN 1 ELSE 0 END AS y FROM journal",
    "split_by_row": f"WITH {JOURNAL} SELECT row_id, CASE WHEN row_id < 5000 THEN 'test' ELSE 'eval' END AS part FROM journal",
    "renumber": f"""WITH {JOURNAL} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, label, totalprice FROM journal""",
    "keep_original_numeric": f"""WITH {JOURNAL} SELECT row_id, {', '.join(r6(c, c + '_orig') for c in NUMERIC)},
        {r6(_log(VALUES['totalprice']), 'totalprice_')} FROM journal""",
    "class_counts": f"WITH {JOURNAL} SELECT label, count(*) AS rows FROM journal GROUP BY label",
    "shard": f"""WITH {JOURNAL} SELECT row_id, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / 5) AS BIGINT) AS shard
        FROM journal WHERE {_IS_FRAUD}""",
    "sample_hash": f"WITH {JOURNAL} SELECT row_id, label FROM journal WHERE {uniform(repr('11'), 'CAST(row_id AS VARCHAR)')} < 0.25",
    "oversample": _OVERSAMPLE,
    "group_map": f"WITH {GROUP_MAP} SELECT * FROM group_map",
    "groups_from_names": f"""WITH {GROUP_MAP} SELECT source_name, string_agg(CAST(enc_pos AS VARCHAR), ',' ORDER BY enc_pos) AS positions
        FROM group_map GROUP BY source_name""",
    "reorder": f"""WITH {JOURNAL} SELECT row_id, label, row_number() OVER (ORDER BY row_id DESC) - 1 AS position
        FROM journal WHERE {_IS_FRAUD}""",
    "orient": f"WITH {MODEL_SET} SELECT seed, row_id, {per_field('phi')} FROM model_set",
    "highlight": f"WITH {PATTERNS} SELECT row_id, array_to_string(h, '') AS pattern FROM flags",
    "l2_normalize": f"""WITH {EXPLAINED} SELECT row_id, {per_field('x')} FROM (
        SELECT row_id, list_transform(phi, lambda v: v / coalesce(nullif(n, 0), 1)) AS x FROM (
          SELECT *, sqrt({' + '.join(f'phi[{i}] * phi[{i}]' for i, _ in FIELDS)}) AS n FROM explained))""",
    "onehot": f"""WITH {JOURNAL} SELECT row_id, {_text(' || '.join(_bits(c) for c in ('status', 'priority', 'segment')))} AS bits
        FROM journal""",
    "onehot_unseen": f"WITH {JOURNAL} SELECT row_id, {_text(_bits('priority', _NO_URGENT, -1))} AS bits FROM journal",
    "onehot_inverse": f"""WITH {JOURNAL} SELECT row_id,
        {', '.join(_known(c, _NO_URGENT) for c in ('status', 'priority', 'segment'))} FROM journal""",
    "sparse_onehot": f"""WITH {SPARSE} SELECT row_id, array_to_string(list_filter([customer, status, priority,
          CASE WHEN price = 1 THEN (SELECT count(*) FROM codes) END], lambda v: v IS NOT NULL), ',') AS positions FROM encoded""",
    "sparse_onehot_inverse": f"""WITH {SPARSE} SELECT o.row_id, customer.value AS customer, status.value AS status,
        priority.value AS priority FROM o {_PLACE}""",
    "sparse_names": f"""WITH {SPARSE} SELECT place AS enc_pos, source_name || '_' || value AS enc_name, source_name, 'cat' AS kind FROM codes
        UNION ALL SELECT count(*), 'totalprice', 'totalprice', 'num' FROM codes""",
    "sparse_centroid": f"""WITH {SPARSE},
        sizes AS (SELECT count(*) AS n, avg(price) AS price FROM encoded WHERE train),
        used AS (SELECT unnest([customer, status, priority]) AS place FROM encoded WHERE train),
        means AS (SELECT place, source_name, any_value(n) AS n, count(*) / any_value(n) AS m FROM used JOIN codes USING (place), sizes
                  GROUP BY place, source_name),
        errors AS (SELECT row_id, {', '.join(f"{_ERROR[c]} AS error_{c}" for c in _SPARSE_COLUMNS)},
                          (encoded.price - sizes.price) ** 2 AS error_totalprice FROM encoded, sizes)
        SELECT row_id, {r6('-sqrt(error_customer + error_status + error_priority + error_totalprice)', 'score')},
               {', '.join(r6(f'error_{c}', f'error_{c}') for c in (*_SPARSE_COLUMNS, 'totalprice'))} FROM errors""",
    "ordinal": f"""WITH {JOURNAL} SELECT row_id,
        {_text('[' + ', '.join(_code(c, _NO_MEDIUM) for c in ('status', 'priority', 'segment')) + ']')} AS codes FROM journal""",
    "ordinal_inverse": f"""WITH {JOURNAL} SELECT row_id,
        {', '.join(_known(c, _NO_MEDIUM) for c in ('status', 'priority', 'segment'))} FROM journal""",
    "lasso_support": f"""WITH {STANDARD},
        sized AS (SELECT row_id, list_reverse_sort([abs(v) FOR v IN z]) AS a FROM standard),
        knots AS (SELECT row_id, a, k, CASE WHEN k < 6 THEN a[k + 1] ELSE 0 END AS penalty FROM sized, range(0, 7) AS t(k)),
        judged AS (SELECT row_id, k, (list_sum([v * v FOR v IN a]) + 50
                   - coalesce(list_sum([v * v - penalty * penalty FOR v IN a[1:k]]), 0)) / (50 / 93.0) + 2 * k AS aic,
                   k - len([v FOR v IN a[1:k] IF v = penalty]) AS used FROM knots)
        SELECT row_id, CAST(arg_min(used, aic) AS INT) AS kept FROM judged GROUP BY row_id""",
    "study_fixed_models": f"""WITH {SCORED}, given AS (
        SELECT s.row_id, s.split, c.y, s.z, c.score AS centre, {_FOREST} AS forest,
               -(sqrt(list_sum([power(z[i] / i - (i = 1)::INT, 2) FOR i IN range(1, 7)])) / 1.0
                 + sqrt(list_sum([power(z[i] / i - (i = 2)::INT, 2) FOR i IN range(1, 7)])) / 0.5) AS axes
        FROM standard s JOIN scored c USING (row_id) WHERE s.split <> 'train'),
        long_ AS (SELECT '0|' || split AS g_, centre AS score, y FROM given
                  UNION ALL SELECT '1|' || split, axes, y FROM given UNION ALL SELECT '2|' || split, forest, y FROM given),
        {_score_metrics('long_', 'g_')} SELECT CAST(split_part(g, '|', 1) AS INT) AS run, split_part(g, '|', 2) AS split,
        {_metric_list(_METRIC_NAMES)} FROM metrics""",
    "forest_fixed_nodes": f"""WITH {STANDARD} SELECT row_id,
        {r6(_FOREST, "score")} FROM standard""",
    "log_scale": f"WITH {JOURNAL} SELECT row_id, {_LOG_COLUMNS} FROM journal",
    "zscore": f"WITH {STANDARD} SELECT row_id, {_Z_COLUMNS} FROM journal JOIN (SELECT row_id, z FROM standard) USING (row_id)",
    "minmax": f"""WITH {JOURNAL}, ranges AS (SELECT {_RANGES} FROM journal WHERE split = 'train'),
        scaled AS (SELECT row_id, [{_SCALED}] AS x FROM journal, ranges) SELECT row_id, {per_field('x')} FROM scaled""",
    "bucket_outlier": _buckets("outlier"),
    "bucket_uniform": _buckets("uniform"),
    "bucket_quantile": _buckets("quantile"),
    "bucket_onehot": _bucket_onehot(["totalprice", "disc"]),
    "auc_roc": _by_split("auc_roc"),
    "auc_pr": _by_split("auc_pr"),
    "mean_rank": _by_split("rank_mean", "rank_std"),
    "max_rank": _by_split("max_fraud", "min_detect"),
    "fraud_ranks": f"""WITH {SCORED} SELECT split, {r6('score', 'score')}, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY split ORDER BY score, y) AS rank FROM scored) WHERE y = 1""",
    "confusion": f"""WITH {SCORED},
        cut AS (SELECT split, max(score) AS threshold FROM (
          SELECT *, row_number() OVER (PARTITION BY split ORDER BY score) AS i FROM scored) WHERE i = 201 GROUP BY split)
        SELECT split, {r6('any_value(threshold)', 'threshold')},
          count(*) FILTER (y = 0 AND score > threshold) AS tn, count(*) FILTER (y = 0 AND score <= threshold) AS fp,
          count(*) FILTER (y = 1 AND score > threshold) AS fn, count(*) FILTER (y = 1 AND score <= threshold) AS tp
        FROM scored JOIN cut USING (split) GROUP BY split""",
    "score_report": f"WITH {SCORED}, {_score_metrics('scored', None)} SELECT {_metric_list(_METRIC_NAMES)} FROM metrics",
    "label_report": f"""WITH docs AS (SELECT -CAST(n_chars AS DOUBLE) AS score, toxic AS y, quality FROM labels JOIN documents USING (doc_id)),
        {_score_metrics('docs', 'quality')} SELECT g AS quality, {_metric_list(_METRIC_NAMES)} FROM metrics""",
    "row_auc_roc": f"""WITH {EXPLAINED}{LONG}, m AS ({ROW_ROC}) SELECT row_id, {r6('roc', 'roc')} FROM explained LEFT JOIN m USING (row_id)""",
    "row_auc_pr": f"""WITH {EXPLAINED}{LONG}, m AS ({ROW_PR}) SELECT row_id, {r6('pr', 'pr')} FROM explained LEFT JOIN m USING (row_id)""",
    "row_pearson": f"""WITH {EXPLAINED}{LONG}, m AS ({ROW_CORR}) SELECT row_id, {r6('pearson', 'pearson')}
        FROM explained LEFT JOIN m USING (row_id)""",
    "row_cosine": f"WITH {EXPLAINED}{LONG}, m AS ({ROW_COS}) SELECT row_id, {r6('cosine', 'cosine')} FROM m",
    "to_source_columns": f"""WITH {ENCODED} SELECT row_id,
        {', '.join(r6(e, n) for n, e in [*_CAT_SUMS, *_NUM_AT])} FROM encoded""",
    "to_source_passthrough": f"""WITH {ENCODED} SELECT row_id,
        {', '.join(r6(e, f'f{i}_{n}') for i, (n, e) in enumerate([*_NUM_AT, *_CAT_SUMS]))} FROM encoded""",
    "to_source_long": f"WITH {ENCODED} " + " UNION ALL ".join(
        f"SELECT row_id, '{n}' AS feature, {r6(e, 'phi')} FROM encoded" for n, e in [*_CAT_SUMS, *_NUM_AT]
    ),
    "gini": f"""WITH {EXPLAINED_SIGNED}{LONG}, a AS ({_gini('greatest(phi, 0.0)')}), b AS ({_gini('abs(phi)')})
        SELECT row_id, {r6('a.g', 'gini')}, {r6('b.g', 'gini_abs')} FROM a JOIN b USING (row_id)""",
    "distraction": f"""WITH {EXPLAINED_SIGNED}{LONG}, a AS ({_distraction('greatest(phi, 0.0)')}), b AS ({_distraction('abs(phi)')})
        SELECT row_id, {r6('a.d', 'dist')}, {r6('b.d', 'dist_abs')} FROM a JOIN b USING (row_id)""",
    "size_eval": f"WITH {_fraud_long(EXPLAINED)} SELECT {_SIZE_COLUMNS} {_SIZE_FROM}",
    "explanation_report": f"WITH {_fraud_long(EXPLAINED_SIGNED)} SELECT l.label, {_REPORT_COLUMNS} {_REPORT_FROM} GROUP BY l.label",
    "flagship": f"""WITH {_fraud_long(EXPLAINED)}
        SELECT l.label, {_REPORT_COLUMNS}, {_COMPACT_COLUMNS} {_REPORT_FROM} {_COMPACT_JOINS} GROUP BY l.label""",
    "model_set_summary": f"""WITH {MODEL_SET_SIGNED},
        long AS (SELECT row_id * 8 + seed AS row_id, unnest(phi) AS phi, unnest(gold) AS gold FROM model_set),
        per_seed AS (
          SELECT row_id % 8 AS seed, avg(roc) AS roc, avg(cosine) AS cos
          FROM ({ROW_COS}) LEFT JOIN ({ROW_ROC}) USING (row_id) GROUP BY 1),
        typed AS (SELECT *, 'large' AS type FROM per_seed UNION ALL SELECT *, 'small' FROM per_seed WHERE seed IN (0, 2, 4))
        SELECT type, count(*) FILTER (roc >= 0.5) AS gte_half, count(*) FILTER (roc < 0.5) AS lt_half,
               {_mean_std('roc', 'roc')}, {_mean_std('cos', 'cos')} FROM typed GROUP BY type""",
    "gold_join": f"""WITH {_fraud_long(EXPLAINED)} SELECT row_id, CAST(sum(gold) AS BIGINT) AS marks,
        {r6('sum(phi * gold)', 'marked_phi')} FROM long GROUP BY row_id""",
    "explanation_set_scan": f"""WITH {MODEL_SET} SELECT seed, row_id, unnest([{', '.join(repr(c) for c in NUMERIC)}]) AS feature,
        unnest(list_transform(phi, lambda v: round(v, 6))) AS phi FROM model_set""",
    "pair_euclid": _pair("euclid"),
    "pair_euclid_abs": _pair("euclid_abs"),
    "pair_sign_disagreement": _pair("sign_disagreement"),
    "pair_feature_disagreement": _pair("feature_disagreement"),
    "pair_ranking": _pair("ranking"),
    "pair_row_metrics": f"""WITH {RAW_CUBE} SELECT row_id, {', '.join(r6(n, n) for n in
        ('euclid', 'euclid_abs', 'sign_disagreement', 'feature_disagreement', 'ranking'))},
        {r6('t', 'topk_euclid')} FROM pairs_by_row JOIN (
          SELECT a.row_id, sqrt({_TOP3}) AS t FROM cube a JOIN cube b ON a.row_id = b.row_id AND a.seed = 0 AND b.seed = 1)
        USING (row_id) WHERE seed_a = 0 AND seed_b = 1""",
    "topk_euclid_as_written": f"""WITH {RAW_CUBE},
        both_ AS (SELECT a.row_id, a.x AS xa, b.x AS xb, a.val AS va, b.val AS vb
                  FROM cube a JOIN cube b ON a.row_id = b.row_id AND a.seed = 0 AND b.seed = 1),
        met AS (SELECT j, va[j] AS fa, vb[j] AS fb, count(*) AS n FROM both_, range(1, 7) t(j) GROUP BY 1, 2, 3),
        by_rank AS (SELECT row_id, j, sqrt(sum(n * (xa[fa] - xb[fb]) ** 2)) AS d FROM both_, met GROUP BY row_id, j)
        SELECT {r6('avg(d)', 'distance')} FROM by_rank""",
    "pair_histogram": f"""WITH {CUBE}, long AS ({_PAIR_LONG}),
        scaled AS (SELECT metric, value / CASE WHEN metric LIKE '%euclid%' AND max(value) OVER (PARTITION BY metric) > 1
                                               THEN max(value) OVER (PARTITION BY metric) ELSE 1 END AS v FROM long),
        limits AS (SELECT metric, min(v) AS lo, (max(v) - min(v)) / 75 AS w, count(*) AS n FROM scaled GROUP BY metric),
        placed AS (SELECT metric, lo, w, n, CAST(least(74, floor((v - lo) / w)) AS INTEGER) AS bin FROM scaled JOIN limits USING (metric))
        SELECT metric, bin, count(*) AS pairs, {r6('any_value(lo + bin * w)', 'from_value')},
               {r6('count(*) / any_value(n * w)', 'density')} FROM placed GROUP BY metric, bin""",
    "hamming_matrix": f"""WITH {PATTERNS} SELECT a.pattern AS pattern_a, a.rows AS rows_a, b.pattern AS pattern_b,
        b.rows AS rows_b, {r6(f'({_DIFFER}) / 6', 'distance')} FROM patterns a, patterns b""",
    "hamming_rows": f"""WITH {PATTERNS}, f AS (SELECT * FROM flags WHERE label LIKE 'Fraud%')
        SELECT a.row_id AS row_a, b.row_id AS row_b, {r6(f'({_DIFFER}) / 6', 'distance')} FROM f a, f b""",
    "hamming_by_label": f"""WITH {PATTERNS},
        by_label AS (SELECT label, h, count(*) AS n FROM flags GROUP BY label, h)
        SELECT class_a, class_b, {r6('total / pairs', 'distance')} FROM (
          SELECT a.label AS class_a, b.label AS class_b, sum(a.n * b.n * ({_DIFFER}) / 6) AS total,
                 sum(a.n * b.n) - CASE WHEN a.label = b.label THEN sqrt(sum(a.n * b.n)) ELSE 0 END AS pairs
          FROM by_label a, by_label b GROUP BY a.label, b.label)""",
    "nn_reference": f"""WITH {DISTANCES}, {_nearest(1, 'label_a = 0 AND label_b <> 0')}
        SELECT query AS row_id, neighbor, {r6('distance', 'distance')}, {r6('list_sum(x)', 'reference_sum')}
        FROM nearest JOIN vectors ON neighbor = id""",
    "knn": f"WITH {DISTANCES}, {_nearest(5)} SELECT {_KNN_COLUMNS} FROM nearest",
    "knn_cells": f"WITH {DISTANCES}, {_nearest(5)} SELECT {_KNN_COLUMNS} FROM nearest",
    "knn_by_key": f"WITH {DISTANCES}, {_nearest(5, 'label_a = label_b')} SELECT {_KNN_COLUMNS} FROM nearest",
    "knn_several_keys": f"""WITH {STANDARD},
        keyed AS (SELECT s.row_id, s.split, s.z, j.totalprice, unnest(list_distinct([j.priority, j.status])) AS key
                  FROM standard s JOIN journal j USING (row_id)),
        distances AS (SELECT a.row_id AS query, b.row_id AS neighbor, a.key, list_distance(a.z, b.z) AS distance
                      FROM keyed a JOIN keyed b USING (key) WHERE a.totalprice >= 490000 AND b.split = 'train'),
        nearest AS (SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY distance, neighbor) AS rank FROM distances)
        SELECT {_KNN_COLUMNS}, key FROM nearest WHERE rank <= 5""",
    "lof": _lof(20, novelty=False),
    "lof_novelty": _lof(20, novelty=True),
    "mean_reference": """SELECT CAST(position - 1 AS INTEGER) AS position, round(avg(value), 6) AS mean FROM (
        SELECT unnest(range(1, len(embedding) + 1)) AS position, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
        GROUP BY position""",
    "reconstruction_error": f"""WITH {JOURNAL}, ranges AS (SELECT {_RANGES} FROM journal WHERE split = 'train'),
        scaled AS (SELECT row_id, split, [{_SCALED}] AS x FROM journal, ranges),
        centre AS (SELECT [{', '.join(f'avg(x[{i}])' for i, _ in FIELDS)}] AS c FROM scaled WHERE split = 'train')
        SELECT row_id, {', '.join(r6(f'(c[{i}] - x[{i}]) ** 2', c) for i, c in FIELDS)} FROM scaled, centre""",
    "noise": f"WITH {JOURNAL} SELECT row_id, {', '.join(r6(e, c) for e, c in zip(_NOISE, NUMERIC))} FROM journal",
    "noise_times_input": f"""WITH {STANDARD} SELECT row_id,
        {', '.join(r6(f'{e} * z[{i}]', c) for e, (i, c) in zip(_NOISE, FIELDS))} FROM standard""",
    "shap_exact": f"""WITH {STANDARD}, {_shap(_ZERO_POINT, f'sqrt({_MASKED})')}
        SELECT row_id, {_PIVOTED} FROM phis GROUP BY row_id""",
    "shap_background": f"""WITH {STANDARD}, {_SEGMENT_POINTS}, {_shap('points', f'sqrt({_MASKED})')}
        SELECT row_id, {_PIVOTED} FROM phis GROUP BY row_id""",
    "shap_expected_value": f"""WITH {STANDARD}, {_SEGMENT_POINTS},
        expected AS (SELECT sum(weight * sqrt({' + '.join(f'p[{i}] ** 2' for i, _ in FIELDS)})) AS e FROM points)
        SELECT row_id, {r6('e', 'expected_value')}, {r6(f'sqrt({_NORM})', 'explained_score')} FROM standard, expected""",
    "shap_unchanged": f"""WITH {STANDARD}, s AS (
          SELECT row_id, sqrt({_NORM}) AS both_, sqrt({_REST}) AS none_, sqrt({_REST} + z[{_T}] ** 2) AS t_, sqrt({_REST} + z[{_Q}] ** 2) AS q_
          FROM standard)
        SELECT row_id, {r6('((t_ - none_) + (both_ - q_)) / 2', 'totalprice')}, 0.0::DOUBLE AS n_lines,
               {r6('((q_ - none_) + (both_ - t_)) / 2', 'qty')}, 0.0::DOUBLE AS amt, 0.0::DOUBLE AS disc, 0.0::DOUBLE AS tax FROM s""",
    "shap_additive": f"""WITH {STANDARD}, x AS (
          SELECT row_id, unnest(range(0, 18)) AS p,
                 unnest(z || list_transform(z, lambda v: v * 0.5) || list_transform(z, lambda v: v * -0.25)) AS v FROM standard)
        SELECT row_id, p::INTEGER AS position, round((p + 1) * (v - 9.0), 3) + 0.0 AS phi FROM x""",
    "conn_last_10s": f"""SELECT event_id, {_trailing('user_id', 10, 'src_10s')}, {_trailing('user_id', 600, 'src_10m')},
        {_trailing('event_type', 10, 'dst_10s')}, {_trailing('event_type', 600, 'dst_10m')} FROM events""",
    "time_features": """SELECT event_id, CASE WHEN isodow(ts) <= 5 THEN 1 ELSE 0 END AS is_weekday,
        CASE WHEN hour(ts) < 3 THEN 0 WHEN hour(ts) < 11 THEN 1 WHEN hour(ts) < 15 THEN 2 WHEN hour(ts) < 18 THEN 3 ELSE 4 END AS daytime
        FROM events""",
}
