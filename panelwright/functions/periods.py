"""Month and date columns. A month is text ``YYYY-MM`` plus an integer index."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.numeric import col, whole

# Tokens that stand for "no value" in each kind of source field.
STRICT_BLANKS = ["NA", "N.A.", "-", "", "(-)", "(-) (-)", "{}", "{ }"]
YEAR_MONTH_BLANKS = ["", "-", "NA", "N.A.", "(-)", "None", "nan"]
PERIOD_BLANKS = ["nan", "none", "na", "n.a.", "-", ""]
DATE_BLANKS = ["nan", "none", "na", "n.a.", "-", "(-)", ""]

PERIOD_PATTERN = r"^\d{4}-(0[1-9]|1[0-2])$"
# Spelled-out date layouts, tried in this order.
DATE_LAYOUTS = [
    "yyyy-M-d", "yyyy/M/d", "yyyy-M-d H:m:s", "yyyyMMdd", "M/d/yyyy", "d/M/yyyy",
    "M-d-yyyy", "d-M-yyyy", "MMM-yyyy", "MMM yyyy", "MMMM yyyy", "d MMM yyyy",
    "d MMMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy",
]


def _ym(year, month) -> Column:
    """Year and month text to ``YYYY-MM``; NULL unless both are whole numbers."""
    year, month = whole(year), whole(month)
    return F.when(
        month.between(1, 12), F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"),
                                       F.lpad(month.cast("string"), 2, "0"))
    )


def strict_month(c) -> Column:
    """Month of a report field: ISO, ``M/YYYY``, ``M-YYYY`` or ``Mon-YYYY``.

    Blank tokens give NULL; so does text in no known layout, which
    :func:`is_bad_month` tells apart.
    """
    s = F.trim(col(c))
    iso = F.regexp_extract(s, r"^(\d{4}-\d{2})(-\d{2})?$", 1)
    month_first = r"^(\d{1,2})[/-](\d{4})$"
    named = F.when(
        s.rlike(r"^[A-Za-z]{3}-\d{4}$"),
        F.date_format(F.try_to_timestamp(F.initcap(F.lower(s)), F.lit("MMM-yyyy")), "yyyy-MM"),
    )
    return F.when(
        ~F.upper(s).isin(STRICT_BLANKS),
        F.coalesce(
            F.nullif(iso, F.lit("")),
            _ym(F.regexp_extract(s, month_first, 2), F.regexp_extract(s, month_first, 1)),
            named,
        ),
    )


def is_bad_month(c) -> Column:
    """True for text that is neither blank nor a month."""
    s = F.trim(col(c))
    return s.isNotNull() & ~F.upper(s).isin(STRICT_BLANKS) & strict_month(c).isNull()


def _parts(s, sep):
    parts = F.split(s, sep)
    return parts, F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def year_month(c) -> Column:
    """Lenient ``struct<year, month>`` from two parts joined by ``-`` or ``/``."""
    s = F.trim(col(c))

    def read(sep, order):
        parts, a, b = _parts(s, sep)
        year_first = F.struct(whole(a).alias("year"), whole(b).alias("month"))
        year_last = F.struct(whole(b).alias("year"), whole(a).alias("month"))
        branches = {"first": (F.length(a) == 4, year_first), "last": (F.length(b) == 4, year_last)}
        (c1, v1), (c2, v2) = (branches[k] for k in order)
        return F.when(F.size(parts) == 2, F.when(c1, v1).when(c2, v2))

    value = F.coalesce(read("-", ("first", "last")), read("/", ("last", "first")))
    known = ~s.isin(YEAR_MONTH_BLANKS) & value["year"].isNotNull() & value["month"].isNotNull()
    return F.when(known, value)


def month_index(ym) -> Column:
    """Months since year 0 of a ``struct<year, month>``."""
    return ym["year"] * 12 + ym["month"] - 1


def _is_temporal(dtype) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def spelled_date(s) -> Column:
    """ISO text by a plain cast, else the first layout that reads it as a date, else NULL.

    The layouts are one constant list tried by a lambda, which keeps the generated code of
    the common path small; only text the cast cannot read pays for them.
    """
    layouts = F.split(F.lit("|".join(DATE_LAYOUTS)), r"\|")
    tried = F.transform(layouts, lambda layout: F.try_to_timestamp(s, layout).cast("date"))
    return F.coalesce(s.try_cast("date"), F.get(F.filter(tried, lambda d: d.isNotNull()), F.lit(0)))


def period(c, dtype=None) -> Column:
    """``YYYY-MM`` of text, or of a date or timestamp column of the given type."""
    c = col(c)
    if dtype is not None and _is_temporal(dtype):
        return F.date_format(c, "yyyy-MM")
    s = F.trim(c.cast("string"))
    _, h1, h2 = _parts(s, "-")
    _, s1, s2 = _parts(s, "/")
    hyphen = F.when(F.length(h1) == 4, _ym(h1, h2)).when(F.length(h2) == 4, _ym(h2, h1))
    slash = F.when(F.length(s2) == 4, _ym(s2, s1)).when(F.length(s1) == 4, _ym(s1, s2))
    return F.when(s.rlike(PERIOD_PATTERN), s).when(
        ~F.lower(s).isin(PERIOD_BLANKS),
        F.coalesce(hyphen, slash, F.date_format(spelled_date(s), "yyyy-MM")),
    )


def period_index(p) -> Column:
    """Integer month index of ``YYYY-MM``; arithmetic on months happens here."""
    p = col(p)
    return whole(F.substring(p, 1, 4)) * 12 + whole(F.substring(p, 6, 2)) - 1


def period_from_index(i) -> Column:
    i = col(i)
    year = F.floor(i / 12).cast("int")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"),
                    F.lpad((i - year * 12 + 1).cast("int").cast("string"), 2, "0"))


def add_months(p, months) -> Column:
    return period_from_index(period_index(p) + months)


def previous_month(p) -> Column:
    return add_months(p, -1)


def month_distance(a, b) -> Column:
    """Months from ``a`` to ``b``; 0 when either cannot be read."""
    return F.coalesce(period_index(b) - period_index(a), F.lit(0))


def period_end(p) -> Column:
    """Last day of the month."""
    return F.last_day(F.concat(col(p), F.lit("-01")).try_cast("date"))


def parse_date(c, dtype=None) -> Column:
    """Lenient date: month-only text is the first of the month, failures NULL."""
    c = col(c)
    if dtype is not None and _is_temporal(dtype):
        return c.cast("date")
    s = F.trim(c.cast("string"))
    hp, h1, h2 = _parts(s, "-")
    sp, s1, s2 = _parts(s, "/")
    first = lambda ym: F.concat(ym, F.lit("-01")).try_cast("date")
    hyphen = F.when((F.size(hp) == 2) & (F.length(h1) == 4), first(_ym(h1, h2)))
    slash = F.when(
        F.size(sp) == 2,
        F.when(F.length(s2) == 4, first(_ym(s2, s1))).when(F.length(s1) == 4, first(_ym(s1, s2))),
    )
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date")).when(
        ~F.lower(s).isin(DATE_BLANKS),
        F.coalesce(hyphen, slash, spelled_date(s)),
    )


def is_month_slash_year(c) -> Column:
    """``MM/YYYY`` layout test; blank passes."""
    s = F.coalesce(col(c), F.lit(""))
    return (s == "") | F.trim(s).rlike(r"^\d{2}/\d{4}$")
