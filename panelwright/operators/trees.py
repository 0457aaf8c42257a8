"""Decision trees grown level by level from exact sums over binned features.

Rows carry bin numbers. For a level, one aggregate counts rows and events by (tree, node, feature,
bin), pre-aggregated in every task; splits are chosen in that small table, and rows meet the splits of their
node in a join. All trees of a forest grow at once. Counts are integers, ties are broken by feature and
bin, and sampling goes by hashes, so a lost executor or another engine gives the same trees.

A node is a row; a tree has node 1, and node v has children 2 v (the split holds) and 2 v + 1. A numeric
split holds for bins up to ``code``, a categorical one for the level ``code``.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.errors import ContractError
from panelwright.operators.scale import prefix_sums
from panelwright.session import cut_lineage, discard

BINS = 16
#: Levels of one categorical feature.
MOST_LEVELS = 1024
#: Node numbers are long integers.
MOST_DEPTH = 60
# The distribution function of a Poisson variable of mean 1, for bootstrap counts.
POISSON = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940581, 0.99991676]


def bin_cuts(train: DataFrame, numeric, bins=BINS) -> dict:
    """Per feature the values at which another ``1 / bins`` of the rows is reached, ascending."""
    if not numeric:
        return {}
    tall = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in numeric])))
    ranked = prefix_sums(tall, "value", {}, ["feature"])
    share = lambda rank: F.floor(rank * bins / F.col("n_total"))
    cuts = ranked.filter(share(F.col("n_before")) < share(F.col("n_before") + F.col("n"))).groupBy("feature").agg(
        F.sort_array(F.collect_list("value")).alias("cuts"))
    found = {r["feature"]: r["cuts"] for r in cuts.collect()}
    return {c: found.get(c, []) for c in numeric}


def _levels(train: DataFrame, categorical) -> dict:
    out = {}
    for c in categorical:
        own = train.filter(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().limit(MOST_LEVELS + 1).collect()
        if len(own) > MOST_LEVELS:
            raise ContractError(f"{c} has more than {MOST_LEVELS} levels")
        out[c] = sorted(r["v"] for r in own)
    return out


@dataclass
class HistogramForest:
    """Splits and leaves as tables, with what turns a row into bin numbers."""

    cuts: dict
    levels: dict
    splits: DataFrame
    leaves: DataFrame
    trees: int

    @property
    def features(self) -> list:
        return [*self.cuts, *self.levels]

    def codes(self):
        """Array of a row's bin numbers: cut points below a value (null: -1), or the place of a level (unknown: 0)."""
        numeric = [F.when(F.col(c).isNull(), -1).otherwise(sum((F.col(c).cast("double") > x).cast("int") for x in own) if own else F.lit(0))
                   for c, own in self.cuts.items()]
        named = [F.coalesce(F.array_position(F.array(*map(F.lit, own)), F.col(c).cast("string")), F.lit(0)).cast("int") if own else F.lit(0)
                 for c, own in self.levels.items()]
        return F.array(*numeric, *named)

    def score(self, df: DataFrame, key: str, out="probability") -> DataFrame:
        """(key, probability): the mean over trees of the share of events in a row's leaf. Keys are unique."""
        at = df.select(F.col(key).alias("_key"), self.codes().alias("codes"), F.explode(F.sequence(F.lit(1), F.lit(self.trees))).alias("tree")).withColumn(
            "node", F.lit(1).cast("bigint"))
        deepest = self.splits.agg(F.max(F.floor(F.log2("node")))).first()[0]
        for _ in range(0 if deepest is None else int(deepest) + 1):
            at = _routed(at, self.splits, "left")
        shares = self.leaves.select("tree", "node", (F.col("pos") / F.col("n")).alias("share"))
        return at.join(shares, ["tree", "node"]).groupBy(F.col("_key").alias(key)).agg((F.sum("share") / self.trees).alias(out))

    def importances(self) -> DataFrame:
        """(feature, importance): each tree's share of impurity removed by a feature, averaged and summing to 1."""
        per = self.splits.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        total = per.groupBy("tree").agg(F.sum("gain").alias("total"))
        shares = per.join(total, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")).alias("s"))
        every = shares.sparkSession.createDataFrame([(f,) for f in self.features], "feature string")
        sums = every.join(shares, "feature", "left").select("feature", F.coalesce("s", F.lit(0.0)).alias("s"))
        whole = F.greatest(sums.agg(F.sum("s")).scalar(), F.lit(1e-300))
        return sums.select("feature", (F.col("s") / whole).alias("importance"))


def _routed(rows: DataFrame, splits: DataFrame, how: str) -> DataFrame:
    """Rows one level further down; with ``left``, rows of nodes without a split stay."""
    own = splits.select("tree", "node", "place", "numeric", "code")
    code = F.col("codes")[F.col("place")]
    holds = F.when(F.col("numeric"), code <= F.col("code")).otherwise(code == F.col("code"))
    child = F.when(F.col("place").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(holds, 0).otherwise(1))
    return rows.join(own, ["tree", "node"], how).select(*[c for c in rows.columns if c != "node"], child.alias("node"))


def bootstrap_count(key, tree, seed) -> Column:
    """How often a tree draws a row: a Poisson count by the hash of its key."""
    text = F.concat_ws("|", F.col(key).cast("string"), tree.cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
    return sum((u > p).cast("int") for p in POISSON)


def grow(train: DataFrame, y: str, key: str, numeric, categorical=(), trees=1, depth=5, per_split=None, bootstrap=False,
         bins=BINS, least_rows=1, seed=42) -> HistogramForest:
    """Trees of at most ``depth`` levels of splits by Gini impurity; ``per_split`` features compete at a node.

    Rows without ``y`` are left out. ``key`` drives the draws; the same key in two rows draws both alike.
    """
    if not 0 < depth <= MOST_DEPTH:
        raise ContractError(f"depth must be within 1 and {MOST_DEPTH}")
    forest = HistogramForest(bin_cuts(train, numeric, bins), _levels(train, categorical), None, None, trees)
    tree = F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")
    rows = train.filter(F.col(y).isNotNull()).select(F.col(key).alias("_key"), F.col(y).cast("bigint").alias("y"), forest.codes().alias("codes"), tree)
    rows = rows.withColumn("w", bootstrap_count("_key", F.col("tree"), seed) if bootstrap else F.lit(1)).filter("w > 0")
    rows = cut_lineage(rows.select("tree", F.lit(1).cast("bigint").alias("node"), "y", "w", "codes"))
    names = forest.features
    splits, leaves = [], []
    for level in range(depth + 1):
        totals = cut_lineage(rows.groupBy("tree", "node").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos")))
        best = None
        if level < depth:
            best = cut_lineage(_best(rows, totals, names, len(numeric), per_split, least_rows))
            leaves.append(totals.join(best, ["tree", "node"], "left_anti"))
            splits.append(best)
            old, rows = rows, cut_lineage(_routed(rows, best, "inner"))
            discard(old)
        else:
            leaves.append(totals)
        if best is None or best.isEmpty():
            break
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[:-1]).unionByName(parts[-1])
    forest.splits, forest.leaves = union(splits), cut_lineage(union(leaves))
    discard(rows)
    return forest


def impurity(n, pos):
    """Half of Gini impurity times the rows."""
    n, pos = n.cast("double"), pos.cast("double")
    return pos * (n - pos) / n


def _best(rows, totals, names, n_numeric, per_split, least_rows) -> DataFrame:
    counts = rows.select("tree", "node", "w", "y", F.posexplode("codes").alias("place", "code")).groupBy("tree", "node", "place", "code").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("place") + 1)
    numeric = F.col("place") < n_numeric
    # A window holds the bins of one feature at one node.
    upto = Window.partitionBy("tree", "node", "place").orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = counts.select("tree", "node", "place", "code", name.alias("feature"), numeric.alias("numeric"),
                         F.when(numeric, F.sum("n").over(upto)).otherwise(F.col("n")).alias("n_l"),
                         F.when(numeric, F.sum("pos").over(upto)).otherwise(F.col("pos")).alias("pos_l"))
    if per_split is not None and per_split < len(names):
        draw = Window.partitionBy("tree", "node").orderBy("_h", "feature")
        chosen = totals.select("tree", "node", F.explode(F.array(*map(F.lit, names))).alias("feature")).withColumn(
            "_h", F.md5(F.concat_ws("|", "tree", "node", "feature"))).withColumn("_r", F.row_number().over(draw)).filter(F.col("_r") <= per_split)
        held = held.join(chosen.select("tree", "node", "feature"), ["tree", "node", "feature"])
    both = held.join(totals, ["tree", "node"]).filter((F.col("n_l") >= least_rows) & (F.col("n") - F.col("n_l") >= least_rows) & (F.col("numeric") | (F.col("code") > 0)))
    n_r, pos_r = F.col("n") - F.col("n_l"), F.col("pos") - F.col("pos_l")
    gain = impurity(F.col("n"), F.col("pos")) - impurity(F.col("n_l"), F.col("pos_l")) - impurity(n_r, pos_r)
    first = Window.partitionBy("tree", "node").orderBy(F.desc("gain"), "feature", "code")
    return both.withColumn("gain", gain).filter("gain > 1e-9").withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(
        "tree", "node", "feature", "place", "numeric", "code", "n", "pos", "gain")
