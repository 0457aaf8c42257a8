"""Text columns: cleaning, title similarity, compatibility tests, labels."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from panelwright.functions.numeric import col

# Words that carry no identity in a project title.
TITLE_STOPWORDS = [
    "project", "line", "railway", "new", "doubling", "construction", "works",
    "of", "and", "to", "in", "at", "for", "with", "from", "the", "under",
    "via", "an", "on", "by",
]
# Words that do not tell one state from another.
STATE_FILLERS = ["multi", "states", "state", "pan", "india", "and"]
# Tokens that stand for an empty numeric or paired field.
EMPTY_TOKENS = ["NA", "N.A.", "-", ""]


def clean(c) -> Column:
    """Collapse whitespace and trim; NULL becomes the empty string.

    A single blank is already right, so only longer runs and other whitespace match.
    """
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s{2,}|[\t\n\x0B\f\r]", " "))


def blank_to_null(c) -> Column:
    s = F.trim(col(c))
    return F.nullif(s, F.lit(""))


@F.pandas_udf(StringType())
def _decompose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).lower())


def title_tokens(c, ascii_only=False) -> Column:
    """Distinct lower-case words of a title less the stopwords.

    Only titles with characters beyond ASCII travel to the Arrow function;
    ``ascii_only`` drops it from the plan for sources known to be ASCII.
    """
    text = F.coalesce(col(c), F.lit(""))
    lowered = F.lower(text)
    if not ascii_only:
        wide = F.when(text.rlike(r"[^\x00-\x7F]"), text)
        lowered = F.coalesce(_decompose(wide), lowered)
    spaced = F.regexp_replace(lowered, r"[()\[\]{},;:.\-_/]", " ")
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in TITLE_STOPWORDS]))


def jaccard(a, b) -> Column:
    """Share of common tokens; 0 when either set is empty."""
    a, b = col(a), col(b)
    # The common tokens are counted once: as the element of a list, not as an expression repeated in its own divisor.
    share = F.get(F.transform(F.array(F.size(F.array_intersect(a, b))), lambda common: common / (F.size(a) + F.size(b) - common)), F.lit(0))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), share).otherwise(F.lit(0.0))


def _contained(a, b) -> Column:
    return (a == "") | (b == "") | a.contains(b) | b.contains(a)


def states_compatible(a, b) -> Column:
    """Blank, equal, contained, or sharing a telling word."""
    a, b = (F.lower(F.trim(F.coalesce(col(x), F.lit("")))) for x in (a, b))
    fillers = F.array(*[F.lit(w) for w in STATE_FILLERS])
    words = lambda s: F.array_except(F.regexp_extract_all(s, F.lit(r"([a-z]+)")), fillers)
    return _contained(a, b) | F.arrays_overlap(words(a), words(b))


def agencies_compatible(a, b) -> Column:
    """Blank, equal, contained, or sharing a bracketed acronym."""
    a, b = (F.lower(F.trim(F.coalesce(col(x), F.lit("")))) for x in (a, b))
    square, round_ = F.lit(r"\[(.*?)\]"), F.lit(r"\((.*?)\)")
    acronyms = F.concat(*[F.regexp_extract_all(s, p) for p in (square, round_) for s in (a, b)])
    shared = F.exists(
        acronyms,
        lambda x: (F.length(F.trim(x)) >= 2) & a.contains(F.trim(x)) & b.contains(F.trim(x)),
    )
    return _contained(a, b) | shared


def contains_any(columns, query) -> Column:
    """Case-insensitive substring search over several columns."""
    needle = F.lower(F.lit(query))
    tests = [F.contains(F.lower(col(c)), needle) for c in columns]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return F.coalesce(found, F.lit(False))


def relabel(c, mapping) -> Column:
    """Replace listed values, keep the rest."""
    c = col(c)
    out = F.lit(None).cast("string")
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return F.coalesce(out, c)


def expand_truncated(c, prefixes) -> Column:
    """Replace a value cut off by its column width with the full word."""
    c = col(c)
    out = c
    for prefix, full in prefixes.items():
        out = F.when(c.startswith(prefix), F.lit(full)).otherwise(out)
    return out


# --- paired and triple report fields -------------------------------------------------


def _unless_empty(s) -> Column:
    return F.when(F.upper(s).isin(EMPTY_TOKENS), F.lit("")).otherwise(s)


def number_token(c) -> Column:
    """Number text without thousands separators; ``NA`` and dashes become ''."""
    return _unless_empty(F.trim(F.replace(clean(c), F.lit(","), F.lit(""))))


def pair(c, numeric=False) -> Column:
    """``top (inner)`` to ``struct<top, inner>``."""
    s = clean(c)
    inner = F.regexp_extract(s, r"\(([^)]+)\)", 1)
    top = F.regexp_replace(s, r"\([^)]+\)", "")
    read = number_token if numeric else lambda x: _unless_empty(F.trim(x))
    return F.struct(read(top).alias("top"), read(inner).alias("inner"))


def triple(c, numeric=False) -> Column:
    """``original (revised) {anticipated}`` to a struct of three texts."""
    s = F.trim(F.coalesce(col(c), F.lit("")))
    rest = F.trim(F.regexp_replace(s, r"\{[^}]+\}", ""))
    read = number_token if numeric else lambda x: _unless_empty(F.trim(x))
    return F.struct(
        read(F.regexp_replace(rest, r"\([^)]+\)", "")).alias("original"),
        read(F.regexp_extract(rest, r"\(([^)]+)\)", 1)).alias("revised"),
        read(F.regexp_extract(s, r"\{([^}]+)\}", 1)).alias("anticipated"),
    )


# --- row content hash ---------------------------------------------------------------


def record_hash(columns) -> Column:
    """SHA-256 of the row as JSON text with sorted keys, ``", "`` and ``": "`` separators."""
    def quoted(c):
        listed = F.to_json(F.array(F.coalesce(F.col(c), F.lit(""))))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    fields = [F.concat(F.lit(f'"{c}": '), quoted(c)) for c in sorted(columns)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")), 256)


# --- facts in words ------------------------------------------------------------------


def source_fact(feature, value, cutoff_label="the cutoff", source_label="source") -> Column:
    """One sentence on an observed feature value; ``value`` is text. The sentences are fixed values."""
    f, v = col(feature), col(value)
    x = v.try_cast("double")
    number = lambda template: F.format_string(template, x)
    one = x == 1
    return (
        F.when(v.isNull(), F.concat(f, F.lit(" value is unobserved or missing in PIT record.")))
        .when(f == "feat_is_past_original_completion",
              F.when(one, F.lit(f"Original completion date had passed as of {cutoff_label} cutoff."))
              .otherwise(F.lit(f"Project was within original completion schedule as of {cutoff_label} cutoff.")))
        .when(f == "feat_is_missing_approval_date",
              F.when(one, F.lit(f"Official government approval date is missing in {source_label} report."))
              .otherwise(F.lit(f"Official government approval date is recorded in {source_label} report.")))
        .when(f == "feat_physical_vs_financial_divergence",
              number("Financial expenditure ratio diverges from physical progress by %+.1f%% points."))
        .when(f == "feat_physical_progress_pct",
              number(f"Reported cumulative physical progress was %.1f%% as of {cutoff_label}."))
        .when(f == "feat_expenditure_to_original_cost_ratio",
              F.format_string("Cumulative expenditure reached %.1f%% of original sanctioned budget.", x * 100))
        .when(f == "feat_project_age_months",
              number(f"Project age was %.0f months since approval as of {cutoff_label}."))
        .when(f == "feat_remaining_original_duration_months",
              number(f"Remaining original duration was %.0f months as of {cutoff_label}."))
        .when(f == "feat_cumulative_expenditure_crore",
              number(f"Cumulative financial expenditure was ₹%.2f crore as of {cutoff_label}."))
        .when(f == "feat_original_cost_crore",
              number("Original sanctioned project cost was ₹%.2f crore."))
        .when(f == "feat_log_original_cost",
              number("Log-transformed original cost scale index was %.2f."))
        .when(f == "feat_state", F.concat(F.lit("Primary executing state/UT is "), v, F.lit(".")))
        .when(f == "feat_agency", F.concat(F.lit("Executing agency/enterprise is "), v, F.lit(".")))
        .otherwise(F.concat(f, F.lit(" = "), v))
    )


