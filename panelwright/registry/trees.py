"""Queries on trees grown by histograms, with the same trees grown in SQL."""

from pyspark.sql import functions as F

from panelwright.operators import learn as M
from panelwright.operators import trees as G
from panelwright.operators.cohort import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from panelwright.plans import derived as D
from panelwright.registry import query
from panelwright.registry.sql import COHORT
from panelwright.session import cut_lineage

KEY = "canonical_project_key"
TREES, DEPTH, PER_SPLIT = 3, 3, 4
_NAMES = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
_LIST = "[" + ", ".join(f"'{c}'" for c in _NAMES) + "]"
_IMPURITY = lambda n, p: f"(CAST({p} AS DOUBLE) * (CAST({n} AS DOUBLE) - CAST({p} AS DOUBLE)) / CAST({n} AS DOUBLE))"


def _level(d: int) -> str:
    """CTEs of level ``d``: ``totals``, ``best`` and the rows one level down."""
    return f"""totals{d} AS (SELECT tree, node, sum(w) AS n, sum(w * y) AS pos FROM rows{d} GROUP BY ALL),
counts{d} AS (SELECT tree, node, feature, code, sum(w) AS n, sum(w * y) AS pos FROM rows{d} JOIN coded USING (key) GROUP BY ALL),
held{d} AS (SELECT tree, node, feature, code, feature NOT IN ('{"', '".join(CATEGORICAL_FEATURES)}') AS numeric,
  CASE WHEN numeric THEN sum(n) OVER o ELSE n END AS n_l, CASE WHEN numeric THEN sum(pos) OVER o ELSE pos END AS pos_l
  FROM counts{d} WINDOW o AS (PARTITION BY tree, node, feature ORDER BY code)),
drawn{d} AS (SELECT tree, node, feature FROM (SELECT tree, node, unnest({_LIST}) AS feature FROM totals{d})
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY md5(tree || '|' || node || '|' || feature), feature) <= {PER_SPLIT}),
gains{d} AS (SELECT *, {_IMPURITY('n', 'pos')} - {_IMPURITY('n_l', 'pos_l')} - {_IMPURITY('(n - n_l)', '(pos - pos_l)')} AS gain
  FROM held{d} JOIN drawn{d} USING (tree, node, feature) JOIN totals{d} USING (tree, node) WHERE n_l >= 1 AND n - n_l >= 1 AND (numeric OR code > 0)),
best{d} AS (SELECT * FROM gains{d} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, feature, code) = 1),
rows{d + 1} AS (SELECT r.tree, 2 * r.node + CAST(NOT CASE WHEN b.numeric THEN c.code <= b.code ELSE c.code = b.code END AS INTEGER) AS node, r.key, y, w
  FROM rows{d} r JOIN best{d} b ON b.tree = r.tree AND b.node = r.node JOIN coded c ON c.key = r.key AND c.feature = b.feature)"""


_COLUMNS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC_FEATURES)
_DRAWS = " + ".join(f"CAST(u > {p} AS INTEGER)" for p in G.POISSON)
FOREST = COHORT + f""",
train AS (SELECT {KEY} AS key, cost_overrun AS y, {", ".join(CATEGORICAL_FEATURES)}, {_COLUMNS} FROM cohort),
tall AS (UNPIVOT (SELECT key, {", ".join(NUMERIC_FEATURES)} FROM train) ON {", ".join(NUMERIC_FEATURES)} INTO NAME feature VALUE value),
ranked AS (SELECT feature, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature ORDER BY value) AS upto, sum(count(*)) OVER (PARTITION BY feature) AS total FROM tall GROUP BY feature, value),
cuts AS (SELECT feature, value FROM ranked WHERE floor((upto - n) * {G.BINS} / total) < floor(upto * {G.BINS} / total)),
levels AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS level, row_number() OVER (ORDER BY {c}) AS code FROM (SELECT DISTINCT {c} FROM train WHERE {c} IS NOT NULL)" for c in CATEGORICAL_FEATURES)}),
numbers AS (SELECT key, t.feature, count(c.value) AS code FROM tall t LEFT JOIN cuts c ON c.feature = t.feature AND c.value < t.value GROUP BY ALL),
coded AS (
  SELECT key, feature, coalesce(code, -1) AS code FROM (SELECT key, unnest({"[" + ", ".join(f"'{c}'" for c in NUMERIC_FEATURES) + "]"}) AS feature FROM train) LEFT JOIN numbers USING (key, feature)
  {" ".join(f"UNION ALL SELECT key, '{c}', coalesce(code, 0) FROM train LEFT JOIN levels ON levels.feature = '{c}' AND level = {c}" for c in CATEGORICAL_FEATURES)}),
rows0 AS (SELECT tree, 1 AS node, key, y, {_DRAWS} AS w FROM (SELECT tree, key, y, CAST('0x' || substr(md5(key || '|' || tree || '|42'), 1, 13) AS BIGINT) / {16 ** 13}.0 AS u
  FROM train, (SELECT unnest(range(1, {TREES + 1})) AS tree)) WHERE {_DRAWS} > 0),
{", ".join(_level(d) for d in range(DEPTH))},
splits AS ({" UNION ALL ".join(f"SELECT tree, node, feature, code, n, pos, gain FROM best{d}" for d in range(DEPTH))}),
leaves AS ({" UNION ALL ".join(f"SELECT tree, node, n, pos FROM totals{d} t WHERE NOT EXISTS (SELECT 1 FROM best{d} b WHERE b.tree = t.tree AND b.node = t.node)" for d in range(DEPTH))}
  UNION ALL SELECT tree, node, sum(w), sum(w * y) FROM rows{DEPTH} GROUP BY ALL)"""


def _forest(spark, sf_dir):
    df = cut_lineage(D.cohort(spark, sf_dir))
    return df, G.grow(df, "cost_overrun", KEY, NUMERIC_FEATURES, CATEGORICAL_FEATURES, TREES, DEPTH, PER_SPLIT, bootstrap=True)


@query(f"WITH {FOREST} SELECT tree, node, feature, CAST(code AS INTEGER) AS code, CAST(n AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos, round(gain, 6) AS gain FROM splits "
       "UNION ALL SELECT tree, node, NULL, NULL, CAST(n AS BIGINT), CAST(pos AS BIGINT), NULL FROM leaves")
def histogram_trees(spark, sf_dir):
    """M7: every split and leaf of trees grown level by level on drawn rows and features."""
    _, forest = _forest(spark, sf_dir)
    splits = forest.splits.select("tree", "node", "feature", "code", "n", "pos", F.round("gain", 6).alias("gain"))
    return splits.unionByName(forest.leaves, allowMissingColumns=True)


_PATHS = f"""paths AS (SELECT tree, key, y, CAST(1 AS BIGINT) AS node FROM (SELECT unnest(range(1, {TREES + 1})) AS tree), train),
{", ".join(f'''paths{d} AS (SELECT p.tree, p.key, y, CASE WHEN b.node IS NULL THEN p.node ELSE 2 * p.node + CAST(NOT CASE WHEN b.feature IN ('{"', '".join(CATEGORICAL_FEATURES)}') THEN c.code = b.code ELSE c.code <= b.code END AS INTEGER) END AS node
  FROM paths{d - 1 if d else ""} p LEFT JOIN splits b ON b.tree = p.tree AND b.node = p.node LEFT JOIN coded c ON c.key = p.key AND c.feature = b.feature)''' for d in range(DEPTH))}"""


@query(f"WITH {FOREST}, {_PATHS} SELECT key AS {KEY}, round(sum(pos / CAST(n AS DOUBLE)) / {TREES}, 6) AS p FROM paths{DEPTH - 1} p "
       "JOIN leaves l ON l.tree = p.tree AND l.node = p.node GROUP BY key")
def histogram_scores(spark, sf_dir):
    """M7, M8: probabilities of every row by joins with nodes, also of rows that a tree has not drawn."""
    df, forest = _forest(spark, sf_dir)
    return forest.score(df, KEY, "p").withColumn("p", F.round("p", 6))


@query(f"WITH {FOREST}, per AS (SELECT tree, feature, sum(gain) AS gain FROM splits GROUP BY ALL), "
       "shares AS (SELECT feature, sum(gain / total) AS s FROM per JOIN (SELECT tree, sum(gain) AS total FROM per GROUP BY 1) USING (tree) GROUP BY 1), "
       f"importances AS (SELECT feature, coalesce(s, 0) / (SELECT sum(s) FROM shares) AS v FROM (SELECT unnest({_LIST}) AS feature) LEFT JOIN shares USING (feature)) "
       "SELECT feature, round(v, 6) AS importance, round(sum(v) OVER (ORDER BY v DESC, feature ROWS UNBOUNDED PRECEDING), 6) AS cumulative_share FROM importances")
def histogram_importances(spark, sf_dir):
    """Importances from the table of splits, with their running share."""
    _, forest = _forest(spark, sf_dir)
    done = M.cumulative_importance(forest.importances(), len(_NAMES))
    return done.select("feature", F.round("importance", 6).alias("importance"), F.round("cumulative_share", 6).alias("cumulative_share"))
