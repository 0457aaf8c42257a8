"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans follow stated patterns. Around every chunk of text with a digit, an at sign or
one spelled out, as in ``(at)``, ``[at]`` or ``at example dot org``, a semi-Markov model scores whole candidate spans (their shape, digits, checksum and
neighbours) and a dynamic program over spans of at most ``LONGEST`` chunks chooses
boundaries and types together. Its spans are added where no base span lies. The model
learns from base spans of a bounded sample of documents and from altered copies of them.

Edge cases: null and empty texts have no spans; texts of any length are read whole, in
time linear in their length; repeated documents each get their row; without training spans
the model adds nothing. Columns that are not named in ``keep`` are not read.
"""

import math
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from panelwright.llm import textbytes as tb
from panelwright.llm.frames import labelled_sample, per_row

KINDS = ("email", "ip", "card", "phone")
#: Documents the model is fitted on at most.
FIT_ROWS = 800
#: Chunks in an entity, and chunks of context on either side of a seed.
LONGEST, CONTEXT = 5, 2
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CHUNK = re.compile(r"[^\s,;=\"'<>\[\]{}|]+")
_S = r"[\x20\x09-\x0D]"
#: At signs spelled out; Python, Java and RE2 read this the same way.
_SPELLED = rf"[(\[{{<]{_S}*[Aa][Tt]{_S}*[)\]}}>]|{_S}[Aa][Tt]{_S}+[A-Za-z0-9.-]+{_S}+[Dd][Oo][Tt]{_S}"
SEED = rf"[0-9@]+|{_SPELLED}"
_SEED = re.compile(SEED)
# A match begins with the whole run of white space before it, so each run is read once.
_RUN = rf"(?<!{_S})"
_AT = re.compile(rf"{_RUN}{_S}*[(\[{{<]{_S}*at{_S}*[)\]}}>]{_S}*|{_RUN}{_S}+at{_S}+", re.IGNORECASE)
_DOT = re.compile(rf"{_RUN}{_S}*[(\[{{<]{_S}*dot{_S}*[)\]}}>]{_S}*|{_RUN}{_S}+dot{_S}+", re.IGNORECASE)
_LONG_RUN = re.compile(rf"{_S}{{9,}}")
_ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]+@{_DOMAIN.pattern}")
_AT_OR_DOT = re.compile(r"(?<![A-Za-z])(at|dot)(?![A-Za-z])", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text):
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts, at = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points: leftmost, non-overlapping per kind, failing matches dropped."""
    spans = [("email", a, b) for a, b in _emails(text)]
    spans += [("ip", a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(own := digits_of(m[0])) <= 19 and luhn(own):
            spans.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


# --- the model ------------------------------------------------------------------------

def seeded(text, chunks):
    """Numbers of the chunks that a seed touches; a seed may reach over several."""
    if not chunks:
        return []
    starts, ends, out = [a for a, _ in chunks], [b for _, b in chunks], set()
    for m in _SEED.finditer(text, max(0, starts[0] - 1), min(len(text), ends[-1] + 1)):
        out.update(range(bisect_right(ends, m.start()), bisect_left(starts, m.end())))
    return sorted(out)


def regions(text):
    """Lists of chunk bounds around seeds; no candidate span reaches beyond its region."""
    chunks = []
    for m in _CHUNK.finditer(text):
        start, end = m.span()
        opens = "(" in m[0]
        while end > start and text[end - 1] in ".:!?)" and not (text[end - 1] == ")" and opens):
            end -= 1
        closes = text.find(")", start, end) >= 0
        while start < end and text[start] in "(:" and not (text[start] == "(" and closes):
            start += 1
        if start < end:
            chunks.append((start, end))
    seeds = seeded(text, chunks)
    low = 0
    while low < len(seeds):
        high = low
        while high + 1 < len(seeds) and seeds[high + 1] - seeds[high] <= 2 * CONTEXT:
            high += 1
        yield chunks[max(0, seeds[low] - CONTEXT):seeds[high] + CONTEXT + 1]
        low = high + 1


def shape(text):
    out = re.sub(r"[A-Za-z\u0080-\U0010ffff]+", "a", text)
    return re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 4), out)


def features(text, region, i, j):
    """Of the whole span from chunk ``i`` to before ``j``: names of what holds for it."""
    start, end = region[i][0], region[j - 1][1]
    own = text[start:end]
    if len(own) > 200:
        own = _LONG_RUN.sub(" " * 8, own)
    digits = digits_of(own)
    n = len(digits)
    names = [f"shape={shape(own)[:40]}", f"digits={min(n, 20)}", f"chunks={j - i}", f"at={own.count('@')}",
             f"dots={min(own.count('.'), 5)}", f"first={own[0] if not own[0].isalnum() else shape(own[0])}",
             f"letters={any(c.isalpha() for c in own)}", f"set={''.join(sorted(set(shape(own))))[:20]}"]
    if n >= 9:
        names.append(f"luhn={13 <= n <= 19 and luhn(digits)}")
        names.append(f"luhn={13 <= n <= 19 and luhn(digits)},plain={own.isdigit()}")
    if "." in own:
        parts = own.split(".")
        names.append(f"octets={len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts if p.isascii())}")
    if "@" in own or _AT_OR_DOT.search(own):
        names.append(f"address={_ADDRESS.fullmatch(_DOT.sub('.', _AT.sub('@', own))) is not None}")
    if _AT_OR_DOT.search(own):
        names.append(f"spelled={re.sub(r'[A-Za-z0-9.-]+', lambda m: m[0].lower() if _AT_OR_DOT.fullmatch(m[0]) else 'a', own)[:40]}")
    names.append(f"left={shape(text[region[i - 1][0]:region[i - 1][1]])[:8] if i else ''}")
    names.append(f"right={shape(text[region[j][0]:region[j][1]])[:8] if j < len(region) else ''}")
    return names


def candidates(text, region):
    """``(i, j)`` of spans that hold a seed and stay on one line."""
    own = np.zeros(len(region) + 1, int)
    own[[i + 1 for i in seeded(text, region)]] = 1
    seeds = np.cumsum(own)
    for i in range(len(region)):
        for j in range(i + 1, min(i + LONGEST, len(region)) + 1):
            if seeds[j] > seeds[i] and (j == i + 1 or "\n" not in text[region[j - 2][1]:region[j - 1][0]]):
                if j > i + 1 and "\n" in text[region[i][1]:region[j - 1][0]]:
                    break
                yield i, j


class SemiCRF:
    """Weights of span features per type and of the type that follows a type (0: outside)."""

    def __init__(self):
        self.span: dict[str, np.ndarray] = {}
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def lattice(self, text, region):
        """Segments that end before each chunk: ``(start, features, score per kind)``."""
        ends = [[] for _ in range(len(region) + 1)]
        for i, j in candidates(text, region):
            names = features(text, region, i, j)
            ends[j].append((i, names))
        return ends

    def scores(self, ends):
        zero = np.zeros(len(KINDS))
        return [[(i, names, sum((self.span.get(f, zero) for f in names), zero)) for i, names in own] for own in ends]

    def best(self, text, region):
        """The best segmentation's entities ``(kind, start, end)``."""
        ends = self.scores(self.lattice(text, region))
        n, k, follow = len(region), len(KINDS) + 1, self.follow
        value = np.full((n + 1, k), -np.inf)
        value[0, 0] = 0
        came = {}
        for j in range(1, n + 1):
            before = value[j - 1] + follow[:, 0]
            value[j, 0] = before.max()
            came[j, 0] = (j - 1, int(before.argmax()))
            for i, _, score in ends[j]:
                before = value[i][:, None] + follow[:, 1:]
                total = before.max(axis=0) + score
                for t in range(1, k):
                    if total[t - 1] > value[j, t]:
                        value[j, t] = total[t - 1]
                        came[j, t] = (i, int(before[:, t - 1].argmax()))
        j, t, out = n, int(value[n].argmax()), []
        while j > 0:
            i, before = came[j, t]
            if t:
                out.append((KINDS[t - 1], region[i][0], region[j - 1][1]))
            j, t = i, before
        return out[::-1]

    def fit(self, examples, epochs=4, rate=0.3, decay=1e-3):
        """Gradient steps on the log-likelihood of segmentations ``(text, region, {(i, j): kind})``."""
        k = len(KINDS) + 1
        prepared = [(self.lattice(text, region), truth) for text, region, truth in examples]
        seen: dict[str, np.ndarray] = {}
        seen_follow = np.full((k, k), 1e-6)
        for _ in range(epochs):
            for ends, truth in prepared:
                n = len(ends) - 1
                scored = self.scores(ends)
                a, b = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
                a[0, 0] = 0
                b[n] = 0
                for j in range(1, n + 1):
                    a[j, 0] = _lse(a[j - 1] + self.follow[:, 0])
                    rows = [_lse2(a[i][:, None] + self.follow[:, 1:]) + s for i, _, s in scored[j]]
                    if rows:
                        a[j, 1:] = _lse2(np.array(rows))
                starts = [[] for _ in range(n + 1)]
                for j in range(1, n + 1):
                    for i, names, s in scored[j]:
                        starts[i].append((j, names, s))
                for i in range(n - 1, -1, -1):
                    ways = [self.follow[:, 0] + b[i + 1, 0]]
                    ways += [_lse2((self.follow[:, 1:] + s + b[j, 1:]).T) for j, _, s in starts[i]]
                    b[i] = _lse2(np.array(ways))
                z = b[0, 0]
                g_follow = np.zeros((k, k))
                grads: dict[str, np.ndarray] = {}
                for j in range(1, n + 1):
                    g_follow[:, 0] -= np.exp(a[j - 1] + self.follow[:, 0] + b[j, 0] - z)
                    for i, names, s in scored[j]:
                        p = np.exp(a[i][:, None] + self.follow[:, 1:] + s + b[j, 1:] - z)
                        g_follow[:, 1:] -= p
                        g = -p.sum(axis=0)
                        if (i, j) in truth:
                            g[truth[i, j]] += 1
                        if abs(g).max() > 1e-4:
                            for f in names:
                                grads[f] = grads.get(f, 0) + g
                last, at = 0, 0
                inner = {i: (j, kind) for (i, j), kind in truth.items()}
                while at < n:
                    at, t = (inner[at][0], inner[at][1] + 1) if at in inner else (at + 1, 0)
                    g_follow[last, t] += 1
                    last = t
                seen_follow += g_follow ** 2
                self.follow += rate * g_follow / np.sqrt(seen_follow)
                for f, g in grads.items():
                    w = self.span.get(f, np.zeros(k - 1))
                    seen[f] = seen.get(f, 1e-6) + g ** 2
                    self.span[f] = w * (1 - decay) + rate * g / np.sqrt(seen[f] + 1)
        return self


def _lse(x):
    m = x.max()
    return m + math.log(np.exp(x - m).sum()) if m > -np.inf else m


def _lse2(x):
    m = x.max(axis=0)
    safe = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(axis=0)) + safe


def examples(texts):
    """Regions with base spans as truth, as they are and altered the way people disguise them."""
    out = []
    for text in texts:
        own = base_spans(text)
        variants = [(text, own)]
        changes = [(s, e, k, new) for k, s, e in own for new in _disguises(k, text[s:e])]
        for start, end, kind, new in changes:
            low, high = max(0, start - 60), end + 60
            if any(a < low < b or a < high < b for _, a, b in own):
                continue
            shift = len(new) - (end - start)
            spans = [(k, a - low + (shift if a > start else 0), b - low + (shift if a >= start else 0))
                     for k, a, b in own if low <= a and b <= high]
            variants.append((text[low:start] + new + text[end:high], spans))
        for version, spans in variants:
            bounds = {(a, b): KINDS.index(k) for k, a, b in spans}
            for region in regions(version):
                first = {a: i for i, (a, _) in enumerate(region)}
                last = {b: j + 1 for j, (_, b) in enumerate(region)}
                truth = {}
                for (a, b), kind in sorted(bounds.items(), key=lambda x: x[0][0] - x[0][1]):
                    i, j = first.get(a), last.get(b)
                    if i is not None and j is not None and i < j <= i + LONGEST and all(j <= x or y <= i for x, y in truth):
                        truth[i, j] = kind
                out.append((version, region, truth))
    return out


def _disguises(kind, span):
    if kind == "phone":
        yield span.lstrip("+")
    if kind == "email":
        for own in dict.fromkeys((span, re.sub("[0-9]", "n", span))):    # addresses may have no digit
            local, domain = own.split("@", 1)
            host, top = domain.rsplit(".", 1)
            yield f"{local}(at){domain}"
            yield f"{local}[at]{domain}"
            yield f"{local} at {host} dot {top}"
    if kind == "card" and span.isdigit() and len(span) == 16:
        yield ".".join(span[i:i + 4] for i in range(0, 16, 4))


def all_spans(text, model):
    """Base spans, and the model's where no base span lies."""
    base = base_spans(text)
    if not model.span:
        return base, list(base)
    taken = []                                       # base spans as disjoint stretches
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    starts, spans, reached = [a for a, _ in taken], list(base), 0
    for region in regions(text):
        for kind, a, b in model.best(text, region):  # from left to right
            i = bisect_left(starts, b) - 1           # the last stretch that starts before the span's end
            if a >= reached and (i < 0 or taken[i][1] <= a):
                spans.append((kind, a, b))
                reached = b
    return base, spans


def fit_model(docs: DataFrame, bound=FIT_ROWS) -> SemiCRF:
    """Fitted on at most ``bound`` documents that hold a seed."""
    rows = labelled_sample(docs.filter(F.col("text").rlike(SEED)).select("doc_id", "text"), "doc_id", bound)
    return SemiCRF().fit(examples(sorted({r["text"] for r in rows.select("text").collect()})))


SCHEMA = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_spans(docs: DataFrame, model: SemiCRF | None = None, keep=("doc_id",)) -> DataFrame:
    """``keep`` columns with ``base`` and ``spans``, in order of kind and start."""
    model = model or fit_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def function(column):
        base, spans = [[]] * len(column), [[]] * len(column)
        for i, text in _seeded_texts(column):
            for out, found in zip((base, spans), all_spans(text, shared.value)):
                out[i] = [{"kind": k, "start": a, "end": b} for k, a, b in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))]
        return [pa.array(base, _SPAN), pa.array(spans, _SPAN)]

    return per_row(docs, function, SCHEMA, keep=keep)


def _seeded_texts(column):
    """``(row, text)`` of the rows that may hold a span."""
    has_seed = pc.fill_null(pc.match_substring_regex(column, SEED), False).to_numpy(zero_copy_only=False)
    for low, high, data, offsets in tb.each_slice(column):
        for i in np.flatnonzero(has_seed[low:high]).tolist():
            yield low + i, data[offsets[i]:offsets[i + 1]].tobytes().decode()


def masked_documents(docs: DataFrame, model: SemiCRF | None = None, keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, which do not name the text, and ``masked``, the text with every span replaced by its kind; a null stays null."""
    model = model or fit_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def function(column):
        changed = {}
        for i, text in _seeded_texts(column):
            spans = all_spans(text, shared.value)[1]
            if spans:
                changed[i] = _replaced(text, sorted((a, b, k) for k, a, b in spans))
        if not changed:
            return [column]
        rows = np.fromiter(changed, np.int64)
        mask = np.zeros(len(column), bool)
        mask[rows] = True
        return [pc.replace_with_mask(column, pa.array(mask), pa.array([changed[i] for i in np.sort(rows).tolist()], column.type))]

    return per_row(docs, function, "masked string", keep=keep)


def _replaced(text, spans):
    """``text`` with its spans ``(start, end, kind)``, in order, replaced by their kinds."""
    parts, at = [], 0
    for start, end, kind in spans:
        if end > at:
            parts += [text[at:max(at, start)], f"[{kind.upper()}]"]
            at = end
    return "".join([*parts, text[at:]])


def span_text(column):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@F.arrow_udf(StringType())
def _masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
    def one(text, found):
        return _replaced(text, sorted((s["start"], s["end"], s["kind"]) for s in found)) if text is not None and found else text

    return pa.array([one(t.as_py(), f.as_py()) for t, f in zip(texts, spans)], pa.string())


def masked(text, spans):
    """Column expression: ``text`` with every span replaced by its kind in brackets; overlapping spans in order of their starts."""
    return F.when(F.coalesce(F.size(spans), F.lit(0)) == 0, text).otherwise(_masked(text, spans))


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document as the query returns it; counts are of base spans."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return find_spans(docs).select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS],
                                   F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
