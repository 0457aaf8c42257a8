"""Cross-tokenizer alignment against a plain version that joins components pair by pair."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import alignment, pieces

PATHS = alignment.default_paths()
ODD = [None, "", " ", "  ", "a", " a", "a ", "x  y   z", "naïve café ﬁ½", "a\nb\n\n c\t", "<s> hi </s> <|endoftext|> <unk>", "x▁y", "▁",
       "😀 中文 日本語 текст", "　q\xa0z", "\x00a", "x y " * 30_000, "don't stop\r\n" * 50, "a▁ b", "word"]


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = {c: i for i, c in [(i, chr(i)) for i in [*range(33, 127), *range(161, 173), *range(174, 256)]]}
    extra = [i for i in range(256) if i not in letters.values()]
    letters |= {chr(256 + n): i for n, i in enumerate(extra)}

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids_a]
        two = [(i, of_b(i)) for i in ids_b]
        whole = (" " + text).encode()
        return (one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else ([], [])

    return encode


def brute_force(rows, encode):
    documents, counts = [], defaultdict(int)
    for doc_id, text in rows:
        one, two = encode(text)
        spans = []
        for side in (one, two):
            at, ranges = 0, []
            for i, x in side:
                ranges.append((i, at, at + len(x)))
                at += len(x)
            spans.append(ranges)
        links, start = [], 0
        for i, low, high in spans[0]:
            while start and spans[1][start][1] > low:
                start -= 1
            while start < len(spans[1]) and spans[1][start][2] <= low:
                start += 1
            j = start
            while j < len(spans[1]) and spans[1][j][1] < high:
                links.append((i, spans[1][j][0]))
                j += 1
        for pair in set(links):
            counts[pair] += 1
        ends = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        groups = []
        for low, high in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(i) for i, s, e in side if s >= low and e <= high) for side in spans) if len(spans[0]) < 3000 else None)
        documents.append((doc_id, len(one), len(two), len(ends), links, groups))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, a, b, g, links, groups in documents:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and None not in groups else "" if not groups else None
        out.append((doc_id, a, b, g, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return out


def same(got, expected):
    got, expected = sorted((tuple(r) for r in got), key=str), sorted(expected, key=str)
    assert len(got) == len(expected)
    for x, y in zip(got, expected):
        assert x[:-1] == y[:-1] and y[-1] in (None, x[-1])


def test_piece_ids_equal_the_model_on_awkward_white_space(plain):
    import sentencepiece

    rng, model = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = ["a", "é", " ", "  ", "\n", " ", "　", "'s", "1", "!", " x", "中", "\t", "▁", "<s>", "😀", "\x85", "Ж", "the"]
    rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    coder = pieces.PieceCoder(PATHS[1])
    assert coder.cuts
    for attempt in range(3):
        whole = [(" " + t).encode() if t else b"" for t in rows]
        ids, begin, exact = coder.encode(np.frombuffer(b"".join(whole), np.uint8), np.cumsum([0] + [len(w) for w in whole]))
        for i, t in enumerate(rows):
            expected = model.encode(t)
            given = b"".join(coder.bytes[x] for x in expected) == whole[i]
            assert exact[i] == given and (not given or ids[begin[i]:begin[i + 1]].tolist() == expected)
        if attempt == 1:
            coder.cuts = False  # text by text


def test_pointer_jumping_labels_components():
    rng = np.random.default_rng(1)
    a_sizes, b_sizes = rng.integers(1, 4, 400), []
    while sum(b_sizes) < a_sizes.sum():
        b_sizes.append(min(int(rng.integers(1, 9)), int(a_sizes.sum() - sum(b_sizes))))
    b_sizes = np.array(b_sizes)
    own = alignment.Alignment((np.arange(400), np.array([0, 400])), (np.arange(len(b_sizes)), np.array([0, len(b_sizes)])), a_sizes, b_sizes)
    ends = np.intersect1d(np.cumsum(a_sizes), np.cumsum(b_sizes))
    assert own.a_group.tolist() == np.searchsorted(ends, np.cumsum(a_sizes)).tolist()
    assert own.b_group.tolist() == np.searchsorted(ends, np.cumsum(b_sizes)).tolist()
    assert len(own.pairs) == 400 + len(b_sizes) - len(ends)


def test_alignment_equals_brute_force_with_odd_rows(spark, plain):
    rows = list(enumerate(ODD)) + [(4, ODD[4]), (None, "x  y   z"), (8, "clash of ids")]
    frame = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "'clash' AS n_a", "1 AS _row", "2 AS pair")
    expected = brute_force(rows, plain)
    same(alignment.alignment_digest(frame).collect(), expected)
    assert alignment.alignment_digest(frame.limit(0)).count() == 0
    shown = {r["doc_id"]: r["groups"] for r in alignment.align(frame.filter("doc_id = 4"), groups=True).collect()}
    assert shown[4] and shown[4].count("|") == 1


def test_alignment_of_documents_with_a_small_table_and_joined_pairs(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60").select("doc_id", "text")
    expected = brute_force([tuple(r) for r in docs.collect()], plain)
    same(alignment.alignment_digest(docs).collect(), expected)
    small = alignment.align(docs, table_pairs=50).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    same(small.collect(), expected)


def test_group_texts_of_no_rows():
    none = (np.zeros(0, np.int64), np.zeros(1, np.int64))
    own = alignment.Alignment(none, none, np.ones(1, np.int64), np.ones(1, np.int64))
    assert own.texts() == [] and len(own.pairs) == 0 and pa.array(own.n_groups).to_pylist() == []
