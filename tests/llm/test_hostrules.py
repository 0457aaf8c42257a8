"""Host-level quality rules against a plain version of their definitions."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from panelwright.llm import hostrules

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "one", "a b c d e " * 40, "same line here\n" * 30 + "end", "é" * 5000, "# * $ % & | < >", "x y\n\nx y\n \n",
       "a b c d", "\n", "w " * 300_000, "line one two three four five six seven eight nine ten"]


def plain(text):
    text = text or ""
    w = SPACED.findall(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {q for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for q in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(again))


def plain_verdicts(rows):
    """kept by (doc_id): the whole method in plain Python."""
    measured = [(i, host, plain(text)) for i, host, text in rows]
    rules = {
        "symbols": lambda m: 10 * m[2] > m[0], "lines": lambda m: 100 * m[4] > 30 * m[3], "length": lambda m: m[1] < 3 * m[0] or m[1] > 10 * m[0]}
    base = lambda m: m[0] < 10 or 100 * m[5] > 20 * m[0]
    failures = rules | {"any": lambda m: base(m) or any(r(m) for r in rules.values())}
    hosts = defaultdict(list)
    for _, host, m in measured:
        if host is not None:
            hosts[host].append(m)
    verdict = defaultdict(set)
    for name, fails in failures.items():
        counts = {h: (sum(map(fails, ms)), len(ms)) for h, ms in hosts.items()}
        k, n, f = len(counts), sum(c[1] for c in counts.values()), sum(c[0] for c in counts.values())
        q, nn = sum(a * a / b for a, b in counts.values()), sum(b * b for _, b in counts.values())
        rate, strength = (f / n if n else 0), 1.0
        if 1 < k < n:
            between, within, size = (q - f * f / n) / (k - 1), (f - q) / (n - k), (n - nn / n) / (k - 1)
            spread = between + (size - 1) * within
            strength = 1 / min(max((between - within) / spread if spread > 0 else 0, 1e-6), 0.99) - 1
        for h, (x, m) in counts.items():
            a, b = x + rate * strength, m - x + (1 - rate) * strength
            low = a / (a + b) - 2 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
            if low > (0.5 if name == "any" else max(0.1, 2 * rate)):
                verdict[h].add(name)
    kept = []
    for i, host, m in measured:
        here = verdict[host] if host is not None else set()
        kept.append((i, not (base(m) or "any" in here or any(r in here and fails(m) for r, fails in rules.items()))))
    return sorted(kept, key=str), verdict


@pytest.fixture(scope="module")
def hosted(spark):
    """A blocked host, one with a strict rule, a hot clean one, one without a name, a tiny one, and repeated rows."""
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows = [(None if i % 50 == 0 else i, "clean", prose(30)) for i in range(300)]
    rows += [(1000 + i, "junk", prose(4) if i % 5 else prose(40)) for i in range(60)]
    rows += [(2000 + i, "marks", prose(30) + (" # # # # # #" if i % 2 else "")) for i in range(60)]
    rows += [(3000 + i, None, prose(30) + " # # # # # # #") for i in range(5)] + [(4000, "tiny", "short")]
    rows += [(5000 + i, "other" if i % 2 else "", t) for i, t in enumerate(ODD)] + [(5004, "other", ODD[4])]
    return spark.createDataFrame(rows, "doc_id int, source string, text string").selectExpr("*", "'clash' AS n_words", "1 AS blocked"), rows


def test_statistics_equal_their_definitions(spark, sf_dir, hosted):
    frame, rows = hosted
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    for docs, expected in ((frame, [(i, *plain(t)) for i, _, t in rows]), (spark.read.parquet(f"{sf_dir}/documents.parquet"), None)):
        expected = expected or [(r["doc_id"], *plain(r["text"])) for r in docs.select("doc_id", "text").collect()]
        got = hostrules.judged(docs).select("doc_id", *names).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(expected, key=str)


def test_verdicts_equal_brute_force_and_follow_hosts(hosted):
    frame, rows = hosted
    expected, verdict = plain_verdicts(rows)
    got = hostrules.host_rules_digest(frame).collect()
    assert sorted(((r["doc_id"], r["kept"]) for r in got), key=str) == expected
    assert "any" in verdict["junk"] and verdict["marks"] == {"symbols"} and not verdict["clean"] and not verdict["tiny"]
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(1, 300) if i % 50) and not any(kept[1000 + i] for i in range(60))
    assert all(kept[2000 + i] == (i % 2 == 0) for i in range(60)) and all(kept[3000 + i] for i in range(5))


def test_without_hosts_or_rows_the_general_rules_decide(spark, hosted):
    frame, rows = hosted
    for some in (frame.withColumn("source", frame.source.substr(99, 1)).filter("doc_id < 1100"), frame.filter("source IS NULL")):
        got = hostrules.host_rules_digest(some).collect()
        assert got and all(r["kept"] != r["base_failed"] for r in got if r["doc_id"] is not None and r["doc_id"] < 1000)
    assert hostrules.host_rules_digest(frame.limit(0)).count() == 0
