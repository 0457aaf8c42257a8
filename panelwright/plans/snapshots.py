"""Snapshot chain: harmonise, resolve identity, build the pair cohort."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from panelwright.operators import cohort as P
from panelwright.operators import harmonize as H
from panelwright.operators import identity as J
from panelwright.session import cut_lineage


@dataclass
class SnapshotChain:
    canonical: DataFrame
    identity: DataFrame
    panel: DataFrame
    cohort: DataFrame


def build(sources, snapshots, cutoff_date, outcome_suffix, generated_at, tol=0.05, min_sim=0.85,
          strict=False, ascii_titles=False, materialize=True) -> SnapshotChain:
    """``sources`` is a list of (table, SnapshotSpec); ``snapshots`` is (oldest, earlier, later).

    The canonical table and the identity map feed several consumers, so each is written
    once to the shared checkpoint folder instead of being recomputed.
    """
    canonical = H.union_snapshots(*[H.to_canonical(df, spec) for df, spec in sources])
    if materialize:
        canonical = cut_lineage(canonical)
    identity = J.resolve(canonical, snapshots, tol, min_sim, strict, ascii_titles)
    if materialize:
        identity = cut_lineage(identity)
    panel = J.build_panel(canonical, identity)
    oldest, earlier, later = snapshots
    pairs = P.pair_cohort(panel, earlier, later, oldest)
    cohort = P.pair_features(pairs, earlier, cutoff_date, outcome_suffix, generated_at)
    return SnapshotChain(canonical, identity, panel, cohort)
