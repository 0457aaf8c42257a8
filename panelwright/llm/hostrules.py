"""Quality rules of documents, judged by host.

Every document is measured and put to five rules. Failures are added up by host, and a
host's failure rates are shrunk towards the corpus by an empirical beta prior: the mean
and the strength of the prior of each rule are fitted by moments (the analysis of variance of
rates between and within hosts). Two rules hold everywhere; the other three only hold at
hosts where the rule's rate is surely high, and a host where most documents surely fail some
rule is blocked. "Surely" means two posterior deviations below the posterior mean.

Texts are read once, and only their statistics are written. Hosts are pre-aggregated in the
tasks, so a hot host is one row of each; the join back moves statistics alone, of
hosts with a verdict only, and adaptive execution can split a hot host.

Edge cases: a null, empty or wordless text has no words and fails as short; a document
without a host is judged by the two general rules alone and counts for no host; with one
host, or one document at each, the prior has the strength of one document; repeated rows are
documents of their own; texts are read whole; ties cannot arise, as limits are strict
comparisons. An empty table gives no rows. Columns that are not named are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.frames import per_row
from panelwright.session import cut_lineage

WINDOW = 5
LEAST_WORDS = 10
#: A host is blocked beyond this rate of documents that fail any rule.
BLOCK_RATE = 0.5
#: A rule holds at a host beyond this rate, and beyond twice the corpus' rate.
STRICT_RATE = 0.1
DEVIATIONS = 2.0
_HASH = tb.Hasher(131)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint")
#: Rules as SQL over the statistics; the first two hold everywhere.
GENERAL = {"short": f"n_words < {LEAST_WORDS}", "repeats": "100 * n_repeat_words > 20 * n_words"}
BY_HOST = {"symbols": "10 * n_symbols > n_words", "lines": "100 * n_dup_lines > 30 * n_lines",
           "length": "word_chars < 3 * n_words OR word_chars > 10 * n_words"}
RULES = GENERAL | BY_HOST
BASE = " OR ".join(GENERAL.values())


def _per_row(marks, first):
    """Sums of ``marks`` between the bounds ``first`` of each row."""
    return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[first])


def _copies(hashes, rows):
    """How often each hash occurs in its row, and whether it is the first of its kind there."""
    _, at, inverse, counts = np.unique(tb.mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                                       return_index=True, return_inverse=True, return_counts=True)
    first = np.zeros(len(hashes), bool)
    first[at] = True
    return counts[inverse], first


def statistics(column) -> list:
    """Words, their code points, symbols, lines with a word, repeated ones of these, and words in repeated windows."""
    out = [[np.zeros(0, np.int64)] for _ in range(6)]
    for low, high, data, offsets in tb.each_slice(column):
        starts, ends, first = tb.words(data, offsets, tb.NOT_SPACE)
        counts, points, sums = np.diff(first), tb.code_point_offsets(data), _HASH.sums(data)
        rows = np.repeat(np.arange(high - low), counts)
        # A line with a word is found by its first word and ends at a line feed or with its row.
        feeds = np.flatnonzero(data == 10)
        stops = np.sort(np.concatenate([feeds, offsets[1:]]))
        stop = stops[np.searchsorted(stops, ends)] if len(ends) else ends
        begin = np.maximum(offsets[rows], np.concatenate([[0], feeds + 1])[np.searchsorted(feeds, starts)])
        new = np.ones(len(starts), bool)
        new[1:] = begin[1:] != begin[:-1]
        _, original = _copies(_HASH.ranges(sums, begin[new], stop[new]), rows[new])
        lines = np.bincount(rows[new], minlength=high - low)
        windows, window_first = tb.shingles(_HASH.ranges(sums, starts, ends), first, WINDOW)
        sizes = np.diff(window_first)
        places = np.arange(len(windows)) + np.repeat(first[:-1] - window_first[:-1], sizes)
        again, _ = _copies(windows, np.repeat(np.arange(high - low), sizes))
        change = np.zeros(len(starts) + WINDOW + 1, np.int64)
        np.add.at(change, places[again > 1], 1)
        np.add.at(change, places[again > 1] + WINDOW, -1)
        found = (counts, _per_row(points[ends] - points[starts], first), _per_row(_SYMBOL[data], offsets), lines,
                 lines - np.bincount(rows[new][original], minlength=high - low), _per_row(np.cumsum(change)[:len(starts)] > 0, first))
        for parts, values in zip(out, found):
            parts.append(values)
    return [pa.array(np.concatenate(parts), pa.int64()) for parts in out]


def _any() -> str:
    return " OR ".join(f"({rule})" for rule in RULES.values())


def host_counts(measured: DataFrame, host: str) -> DataFrame:
    """``n`` documents and failures by rule of every host; ``f_any`` counts documents that fail some rule."""
    failures = {f"f_{name}": rule for name, rule in (BY_HOST | {"any": _any()}).items()}
    return measured.filter(F.col(host).isNotNull()).groupBy(host).agg(
        F.count("*").alias("n"), *[F.count_if(F.expr(rule)).alias(name) for name, rule in failures.items()])


def fit_prior(counts: DataFrame) -> dict:
    """``(alpha, beta)`` of the beta prior of each failure column, from sums over all hosts.

    With the mean squares of rates between and within hosts, the intraclass correlation is
    ``1 / (alpha + beta + 1)`` and the corpus' rate ``alpha / (alpha + beta)``.
    """
    names = [c for c in counts.columns if c.startswith("f_")]
    n = F.col("n").cast("double")
    row = counts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(n * n).alias("nn"),
                     *[F.sum(c).alias(c) for c in names], *[F.sum(F.col(c) * F.col(c) / n).alias(f"q{c}") for c in names]).first()
    prior = {}
    for c in names:
        k, total = row["k"], float(row["n"] or 0)
        rate = row[c] / total if total else 0.0
        strength = 1.0
        if 1 < k < total:
            between = (row[f"q{c}"] - row[c] * row[c] / total) / (k - 1)
            within = (row[c] - row[f"q{c}"]) / (total - k)
            size = (total - row["nn"] / total) / (k - 1)
            spread = between + (size - 1) * within
            correlation = (between - within) / spread if spread > 0 else 0.0
            strength = 1 / min(max(correlation, 1e-6), 0.99) - 1
        prior[c] = rate * strength, (1 - rate) * strength
    return prior


def posterior(failed, n, prior) -> tuple[Column, Column]:
    """Mean of a host's shrunk failure rate and the bound that it surely exceeds."""
    a, b = F.col(failed) + F.lit(prior[0]), F.col(n) - F.col(failed) + F.lit(prior[1])
    mean = a / (a + b)
    return mean, mean - F.lit(DEVIATIONS) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + F.lit(1.0))))


def host_verdicts(counts: DataFrame, host: str) -> DataFrame:
    """Per host its shrunk rates, ``blocked``, and per rule whether it is ``strict_`` there."""
    prior = fit_prior(counts)
    overall = lambda c: prior[c][0] / (prior[c][0] + prior[c][1])
    rates, bounds = {}, {}
    for c in prior:
        rates[c], bounds[c] = posterior(c, "n", prior[c])
    return counts.select(
        host, "n", *[rates[c].alias(f"rate{c[1:]}") for c in prior], (bounds["f_any"] > BLOCK_RATE).alias("blocked"),
        *[(bounds[f"f_{r}"] > max(STRICT_RATE, 2 * overall(f"f_{r}"))).alias(f"strict_{r}") for r in BY_HOST])


def judged(docs: DataFrame, host="source", keep=("doc_id",)) -> DataFrame:
    """``keep``, the statistics, ``base_failed``, ``blocked``, ``strict_`` by rule and ``kept`` of every document."""
    keep = list(keep)
    chosen = docs.select(*keep, F.col(host).alias("_host"), F.col("text").alias("_text"))
    measured = cut_lineage(per_row(chosen, statistics, SCHEMA, text="_text", keep=[*keep, "_host"]))
    counts = cut_lineage(host_counts(measured, "_host"))
    flags = ["blocked", *[f"strict_{r}" for r in BY_HOST]]
    # Only hosts with a verdict take part in the join; when they are few, it needs no shuffle of documents.
    marked = host_verdicts(counts, "_host").select("_host", *flags).filter(" OR ".join(flags))
    seen = measured.join(marked, "_host", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags})
    failed = F.expr(BASE)
    here = F.col("blocked")
    for r, rule in BY_HOST.items():
        here = here | (F.col(f"strict_{r}") & F.expr(rule))
    return seen.select(*keep, *measured.columns[len(keep) + 1:], failed.alias("base_failed"), *flags, (~failed & ~here).alias("kept"))


def host_rules_digest(docs: DataFrame) -> DataFrame:
    """One row per document as the query returns it."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_prior(c):
    return f"""
  SELECT '{c}' AS rule, count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(CAST(n AS DOUBLE) * n) AS nn, CAST(sum(f_{c}) AS DOUBLE) AS f, sum(f_{c} * f_{c} / CAST(n AS DOUBLE)) AS q FROM hosts"""


def _sql_bound(c):
    a, b = f"(f_{c} + p_{c}.a)", f"(n - f_{c} + p_{c}.b)"
    return f"{a} / ({a} + {b}) - {DEVIATIONS} * sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1.0)))"


_SPACES = r"[^\x20\x09-\x0D]+"
SQL = f"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACES}') AS w FROM documents),
windows AS (SELECT r, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS words FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, words) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT q) AS c FROM (SELECT r, unnest(range(p, p + {WINDOW})) AS q FROM again) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS c FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_SPACES}') GROUP BY r),
m AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_lines, coalesce(lines.c, 0) AS n_dup_lines, coalesce(repeated.c, 0) AS n_repeat_words
  FROM d LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)),
hosts AS (
  SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER ({rule}) AS f_{name}" for name, rule in (BY_HOST | {"any": _any()}).items())}
  FROM m WHERE source IS NOT NULL GROUP BY source),
sums AS ({" UNION ALL ".join(_sql_prior(c) for c in (*BY_HOST, "any"))}),
squares AS (SELECT *, (q - f * f / n) / nullif(k - 1, 0) AS between_, (f - q) / nullif(n - k, 0) AS within_, (n - nn / n) / nullif(k - 1, 0) AS size FROM sums),
strengths AS (SELECT rule, f / n AS rate, CASE WHEN k > 1 AND k < n THEN
  1 / least(greatest(CASE WHEN between_ + (size - 1) * within_ > 0 THEN (between_ - within_) / (between_ + (size - 1) * within_) ELSE 0 END, 1e-6), 0.99) - 1 ELSE 1 END AS s FROM squares),
priors AS (SELECT rule, rate * s AS a, (1 - rate) * s AS b FROM strengths),
verdicts AS (
  SELECT source, {_sql_bound("any")} > {BLOCK_RATE} AS blocked,
    {", ".join(f"{_sql_bound(r)} > greatest({STRICT_RATE}, 2 * p_{r}.a / (p_{r}.a + p_{r}.b)) AS strict_{r}" for r in BY_HOST)}
  FROM hosts {" ".join(f"JOIN priors p_{r} ON p_{r}.rule = '{r}'" for r in (*BY_HOST, "any"))})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, ({BASE}) AS base_failed,
  NOT (({BASE}) OR coalesce(blocked, FALSE) {" ".join(f"OR (coalesce(strict_{r}, FALSE) AND ({rule}))" for r, rule in BY_HOST.items())}) AS kept
FROM m LEFT JOIN verdicts USING (source)"""
