"""URL filter: stated rules first, then logistic regression on hashed character n-grams.

The longest rule that fits a URL decides. Without one, a linear model over hashed
n-grams of host and path, trained from a small table of labelled URLs, blocks URLs that
look like blocked ones.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule
and gets the model's verdict on empty text; URLs of any length are read whole; repeated
rows each get their verdict. Columns that are not named in ``keep`` are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.frames import per_row
from panelwright.llm.linear import Sparse, fit_logistic, sigmoid

#: Verdict, host and path of every rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The labelled URLs of the model: hosts of either class, each with every one of the paths,
#: so that only what is in both classes' hosts and paths alone tells them apart.
BLOCKED = ("ads-track.example.org", "www.ads-track.example.net", "m.casino-win.example.net", "casino-win.example.org",
           "blog.free-bets.example.org", "free-bets.example.net", "www.spam-farm.example.net", "spam-farm.example.org",
           "m.adult-x.example.net", "adult-x.example.org", "cheap-pills.example.net", "www.cheap-pills.example.org",
           "xxx-video.test.org", "online-casino.test.net", "buy-pills.test.org", "tracker.ads.test.net", "free-spam.test.org")
ALLOWED = ("ththth.example.net", "ththed.example.org", "blog.tionsh.example.net", "m.ththor.example.org", "www.ththwh.example.org",
           "blog.ththan.example.net", "therat.example.net", "www.tionble.example.org", "m.therin.example.org", "blog.therhe.example.net",
           "www.theres.example.org", "m.tiontion.example.net", "library.test.org", "news.test.net", "docs.test.org", "museum.test.org",
           "university.test.net", "")
PATHS = ("/en/12", "/de/340/", "/fr/77?page=2&ref=x", "/es/5.html", "/en/196#top", "/de/81.html")
BAD_PATHS = ("/casino/bonus", "/adult/video", "/cheap/pills", "/ads/click")
LABELLED = tuple(
    [(f"https://{h}{p}", 1) for h in BLOCKED for p in PATHS] + [(f"https://{h}{p}", 0) for h in ALLOWED for p in PATHS]
    + [(f"http://{h}{p}", 1) for h in ALLOWED[-6:-1] for p in BAD_PATHS] + [(f"http://{h}", 0) for h in ALLOWED] + [("", 0)] * 20)
SIZES = (3, 4, 5)
WIDTH = 1 << 16
_HOST, _PATH = tb.Hasher(31), tb.Hasher(32)


def host_of(url) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host, path, rules=RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, decision).otherwise(verdict)
    return text, verdict


def ngrams(column, hasher):
    """Hashed n-grams of the rows of a text column within ``^`` and ``$``, with begin positions."""
    framed = pa.array([f"^{x}$" for x in column.to_pylist()], pa.large_string())
    data, offsets = tb.raw(framed)
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    sums, length = hasher.sums(data), np.diff(offsets)
    rows, numbers = [], []
    for n in SIZES:
        counts = np.maximum(length - n + 1, 0)
        begin = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) + np.repeat(offsets[:-1] - begin, counts)
        rows.append(np.repeat(np.arange(len(counts)), counts))
        numbers.append((hasher.ranges(sums, at, at + n) >> np.uint64(48)).astype(np.int64))
    rows, numbers = np.concatenate(rows), np.concatenate(numbers)
    by = np.argsort(rows, kind="stable")
    return numbers[by] % WIDTH, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(length)))])


class UrlModel:
    """Probability that a URL is to be blocked."""

    def __init__(self, host, path, intercept):
        self.host, self.path, self.intercept = host, path, intercept

    def score(self, hosts, paths):
        total = np.full(len(hosts), self.intercept)
        for column, hasher, w in ((hosts, _HOST, self.host), (paths, _PATH, self.path)):
            numbers, begin = ngrams(column, hasher)
            total += Sparse(numbers, begin, WIDTH).times(w) / np.sqrt(np.maximum(1, np.diff(begin)))
        return sigmoid(total)


def fit_model(spark, labelled=LABELLED, l2=1e-4) -> UrlModel:
    """From a small table of ``(url, 1 if blocked)``; urls are taken apart by the same columns."""
    parts = spark.createDataFrame([(u, int(y)) for u, y in labelled], "url string, y int").select(
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "y").collect()
    columns, rows, values = [], [], []
    for offset, name, hasher in ((0, "host", _HOST), (WIDTH, "path", _PATH)):
        numbers, begin = ngrams(pa.array([r[name] for r in parts]), hasher)
        size = np.diff(begin)
        columns.append(numbers + offset)
        rows.append(np.repeat(np.arange(len(parts)), size))
        values.append(np.repeat(1 / np.sqrt(np.maximum(1, size)), size))
    rows = np.concatenate(rows)
    by = np.argsort(rows, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(parts)))])
    x = Sparse(np.concatenate(columns)[by], begin, 2 * WIDTH, np.concatenate(values)[by])
    w, _, b = fit_logistic(x, [r["y"] for r in parts], l2=l2, steps=500)
    return UrlModel(w[:WIDTH], w[WIDTH:], b)


def judge(pages: DataFrame, model: UrlModel | None = None, rules=RULES, keep=("page_id",), threshold=0.5) -> DataFrame:
    """``keep`` with ``host``, ``path``, ``rule``, ``verdict`` and the model's ``score``."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model or fit_model(spark))
    taken = pages.select(*keep, F.struct(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).alias("_url"))

    def function(column):
        host, path = column.field("host"), column.field("path")
        return [host, path, pa.array(shared.value.score(host, path))]

    scored = per_row(taken, function, "host string, path string, score double", text="_url", keep=keep)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return scored.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(
        verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
