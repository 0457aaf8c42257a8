"""The fits of the model queries as recursive SQL: Newton steps with a small linear system."""

from panelwright.operators.cohort import NUMERIC_FEATURES
from panelwright.registry.sql import COHORT

STEPS = 15
#: Slots for the levels of each categorical predictor; unused ones stay 0.
STATES, AGENCIES = 6, 24
SIZE = 1 + len(NUMERIC_FEATURES) + STATES + AGENCIES


def newton(design: str, size: int, ridge, name="fit", weight="1", steps=STEPS) -> str:
    """CTEs that fit ``design`` (task, x list, y) per task; ``name`` has (task, w) after all steps.

    Each step sums gradient and curvature, scales the system by its diagonal and eliminates
    its columns one by one.
    """
    n = range(1, size + 1)
    pairs = ", ".join(f"sum({weight} * p * (1 - p) * x[{i}] * x[{j}]) AS g_{i}_{j}" for i in n for j in n if i <= j)
    slopes = ", ".join(f"sum({weight} * (y - p) * x[{i}]) AS b_{i}" for i in n)
    cell = lambda i, j: f"g_{min(i, j)}_{max(i, j)}" + (f" + {ridge[i - 1]}" if i == j else "")
    matrix = ", ".join("[" + ", ".join([*(cell(i, j) for j in n), f"b_{i} - {ridge[i - 1]} * w[{i}]"]) + "]" for i in n)
    return f"""{name}_steps AS (
  SELECT DISTINCT task, 0 AS n, list_transform(range({size}), lambda i: CAST(0 AS DOUBLE)) AS w FROM {design}
  UNION ALL
  SELECT task, n + 1, list_transform(w, lambda v, i: v + solved[i][{size + 1}] / d[i]) FROM (
    SELECT task, n, w, d, list_reduce(list_concat([list_transform(m, lambda r, i: list_transform(r, lambda v, j: v / d[i] / CASE WHEN j <= {size} THEN d[j] ELSE 1 END))],
        list_transform(range(1, {size + 1}), lambda k: [[CAST(k AS DOUBLE)]])),
      lambda m, k: list_transform(m, lambda r, i: CASE WHEN i = CAST(k[1][1] AS INTEGER) THEN list_transform(r, lambda v: v / r[CAST(k[1][1] AS INTEGER)])
        ELSE list_transform(r, lambda v, j: v - r[CAST(k[1][1] AS INTEGER)] * m[CAST(k[1][1] AS INTEGER)][j] / m[CAST(k[1][1] AS INTEGER)][CAST(k[1][1] AS INTEGER)]) END)) AS solved
    FROM (SELECT task, n, w, [{matrix}] AS m, [{", ".join(f"sqrt({cell(i, i)})" for i in n)}] AS d FROM (
      SELECT task, n, w, {pairs}, {slopes} FROM (
        SELECT s.task, n, w, x, y{"" if weight == "1" else ", " + weight}, 1 / (1 + exp(-list_dot_product(w, x))) AS p FROM {name}_steps s JOIN {design} d ON s.task = d.task WHERE n < {steps})
      GROUP BY task, n, w)))),
{name} AS (SELECT task, w FROM {name}_steps WHERE n = {steps})"""


#: Both tasks' rows with their hold-out labels.
PARTITIONED = COHORT + """,
tasked AS (SELECT 'cost' AS task, cost_overrun AS y, * FROM cohort
  UNION ALL SELECT 'schedule', time_overrun, * FROM cohort WHERE is_eligible_schedule_target = 1),
hashed AS (SELECT *, row_number() OVER (PARTITION BY task, y ORDER BY md5(canonical_project_key || '|42')) AS rn FROM tasked),
strata AS (SELECT task, y, count(*) AS c FROM hashed WHERE y IS NOT NULL GROUP BY ALL),
want AS (SELECT *, ceil(0.2 * sum(c) OVER (PARTITION BY task)) AS w, ceil(0.2 * sum(c) OVER (PARTITION BY task)) * c / sum(c) OVER (PARTITION BY task) AS e FROM strata),
test AS (SELECT task, y, c, floor(e) + CAST(row_number() OVER (PARTITION BY task ORDER BY e - floor(e) DESC, y) <= w - sum(floor(e)) OVER (PARTITION BY task) AS INTEGER) AS nt FROM want),
rest AS (SELECT *, c - nt AS rest FROM test),
want2 AS (SELECT *, ceil(0.25 * sum(rest) OVER (PARTITION BY task)) AS w, ceil(0.25 * sum(rest) OVER (PARTITION BY task)) * rest / sum(rest) OVER (PARTITION BY task) AS e FROM rest),
cal AS (SELECT *, floor(e) + CAST(row_number() OVER (PARTITION BY task ORDER BY e - floor(e) DESC, y) <= w - sum(floor(e)) OVER (PARTITION BY task) AS INTEGER) AS nc FROM want2),
parted AS (SELECT h.*, CASE WHEN nt IS NULL THEN 'NOT_ELIGIBLE' WHEN rn <= nt THEN 'TEST_HOLDOUT' WHEN rn <= nt + nc THEN 'CALIBRATION_HOLDOUT' ELSE 'MODELFIT' END AS partition
  FROM hashed h LEFT JOIN cal ON cal.task = h.task AND cal.y = h.y)"""

_FILL = ", ".join(f"median({c}) AS m_{c}" for c in NUMERIC_FEATURES)
_VALUES = ", ".join(f"CAST(coalesce({c}, m_{c}) AS DOUBLE)" for c in NUMERIC_FEATURES)


def _one_hot(column, levels, slots):
    return f"list_resize(list_transform({levels}, lambda v: CAST(coalesce({column} = v, FALSE) AS DOUBLE)), {slots}, 0.0)"


#: ``every``: all rows with their predictors in one list; ``fit``: the weights from the MODELFIT rows.
LOGISTIC = PARTITIONED + f""",
fill AS (SELECT task, list_sort(list(DISTINCT feat_state)) AS states, list_sort(list(DISTINCT feat_agency)) AS agencies, {_FILL} FROM parted WHERE partition = 'MODELFIT' GROUP BY task),
every AS (SELECT parted.*, states, agencies, list_concat([1.0, {_VALUES}], {_one_hot('feat_state', 'states', STATES)}, {_one_hot('feat_agency', 'agencies', AGENCIES)}) AS x
  FROM parted JOIN fill USING (task)),
design AS (SELECT task, x, CAST(y AS DOUBLE) AS y FROM every WHERE partition = 'MODELFIT'),
{newton('design', SIZE, [0] + [1] * (SIZE - 1))},
scored AS (SELECT every.*, 1 / (1 + exp(-list_dot_product(w, x))) AS p FROM every JOIN fit USING (task))"""

_NUMERIC_NAMES = ", ".join(f"'{c}'" for c in NUMERIC_FEATURES)
#: (task, feature, kind, coefficient) of the fit.
COEFFICIENTS = LOGISTIC + f""",
named AS (SELECT fit.task, w, list_concat(['(intercept)', {_NUMERIC_NAMES}],
    list_resize(list_transform(states, lambda v: 'feat_state=' || v), {STATES}, NULL), list_resize(list_transform(agencies, lambda v: 'feat_agency=' || v), {AGENCIES}, NULL)) AS names
  FROM fit JOIN fill USING (task)),
coefs AS (SELECT task, feature, coefficient, CASE WHEN feature = '(intercept)' THEN 'intercept' WHEN contains(feature, '=') THEN 'categorical' ELSE 'numeric' END AS kind
  FROM (SELECT task, unnest(names) AS feature, unnest(w) AS coefficient FROM named) WHERE feature IS NOT NULL),
ranked AS (SELECT task, feature, row_number() OVER (PARTITION BY task ORDER BY coefficient DESC, feature) AS t, row_number() OVER (PARTITION BY task ORDER BY coefficient, feature) AS b
  FROM coefs WHERE kind = 'categorical')"""


def isotonic(points: str, queries: str, name: str) -> str:
    """CTEs for ``name``: the rows of ``queries`` (task, p, ...) with ``iso``, fitted on ``points`` (task, p, y).

    The fit at a value is the largest, over all values not above it, of the smallest mean outcome from there
    to a value not below it; between values it is linear.
    """
    return f"""{name}_sums AS (SELECT task, p, row_number() OVER o AS i, sum(s) OVER o AS s, sum(c) OVER o AS c FROM (
    SELECT task, p, sum(y) AS s, count(*) AS c FROM {points} WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY task, p) WINDOW o AS (PARTITION BY task ORDER BY p)),
{name}_means AS (SELECT a.task, a.i AS low, b.i AS high, (b.s - coalesce(z.s, 0)) / CAST(b.c - coalesce(z.c, 0) AS DOUBLE) AS m
  FROM {name}_sums a JOIN {name}_sums b ON a.task = b.task AND a.i <= b.i LEFT JOIN {name}_sums z ON z.task = a.task AND z.i = a.i - 1),
{name}_least AS (SELECT task, low, high, min(m) OVER (PARTITION BY task, low ORDER BY high DESC) AS m FROM {name}_means),
{name}_knots AS (SELECT k.task, k.p, max(m) AS v FROM {name}_sums k JOIN {name}_least l ON l.task = k.task AND l.high = k.i AND l.low <= k.i GROUP BY k.task, k.p),
{name}_below AS (SELECT q.*, k.p AS p0, k.v AS v0 FROM {queries} q ASOF LEFT JOIN {name}_knots k ON q.task = k.task AND q.p >= k.p),
{name} AS (SELECT q.* EXCLUDE (p0, v0), CASE WHEN p0 IS NULL THEN k.v WHEN k.p IS NULL OR k.p = p0 THEN v0 ELSE v0 + (k.v - v0) * (q.p - p0) / (k.p - p0) END AS iso
  FROM {name}_below q ASOF LEFT JOIN {name}_knots k ON q.task = k.task AND q.p <= k.p)"""
