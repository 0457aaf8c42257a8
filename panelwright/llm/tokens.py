"""Token ids of whole texts by a public tokenizer file.

For a byte-level BPE file whose merges are in the order of their ids, texts are cut where
no token can cross, distinct pieces of a slice are encoded once by a rank-based encoder
of the same vocabulary, and ids are put together again. Any other file is used as it is.
"""

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelwright.llm import textbytes as tb

_HASHES = tb.Hasher(21), tb.Hasher(22)
_LOADED: dict = {}
SLICE = 2 << 20
_SLOTS = 1 << 21
#: Pieces a process keeps with their ids, found by 128 bits of hash.
_KEPT = 1 << 20
#: Fixed value: the split pattern of this family of tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lead bytes of the UTF-8 characters among which there is white space beyond ASCII.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path=None, special=False):
    """The file's tokenizer; the strings of its special tokens are ordinary text unless ``special``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path or default_path())
    loaded.encode_special_tokens = not special
    return loaded


def _letters_of_bytes():
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _ranks(path):
    """Token bytes to ids, or None if the file is of another kind."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
            or model.get("ignore_merges") or model.get("dropout") or model.get("unk_token")
            or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or not split.get("use_regex", True)):
        return None
    vocabulary, letters = model["vocab"], _letters_of_bytes()
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    if merged != sorted(merged) or len(set(merged)) != len(merged):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}


class _Coder:
    def __init__(self, path):
        self.path, ranks = path, _ranks(path)
        self.whole = None
        if ranks is None:
            self.whole = tokenizer(path)
        else:
            import tiktoken

            self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.lengths[i] = len(token)
            self.keys = np.zeros((2, _KEPT), np.uint64)
            self.begin, self.size = np.zeros(_KEPT, np.int64), np.zeros(_KEPT, np.int64)
            self.pool, self.filled = np.zeros(8 * _KEPT, np.uint32), 0

    def forget(self, need):
        """Room for ``need`` more ids; kept pieces are dropped when the pool is full."""
        if self.filled + need > len(self.pool):
            self.size[:], self.filled = 0, 0
            if need > len(self.pool):
                self.pool = np.zeros(need, np.uint32)

    def store(self, ids):
        at = self.filled
        self.pool[at:at + len(ids)] = ids
        self.filled += len(ids)
        return at

    def one(self, text):
        return self.coder.encode_to_numpy(text, disallowed_special=())


def coder(path=None) -> _Coder:
    path = path or default_path()
    if path not in _LOADED:
        _LOADED[path] = _Coder(path)
    return _LOADED[path]


def _cuts(data, offsets):
    """Starts of pieces: rows, and spaces right after a character that is surely no white space.

    White space ends every token that holds something else, and a token with a space starts
    with it, so none crosses such a cut and none looks beyond it.
    """
    at = np.flatnonzero(data == 32)
    at = at[at >= 4]
    before = data[at - 1]
    safe = (before > 32) & (before < 127)
    odd = np.flatnonzero(before >= 128)
    back = at[odd] - 1
    for _ in range(3):
        back = back - ((data[back] & 0xC0) == 0x80)
    lead = data[back]
    safe[odd] = ~_MAY_BE_SPACE[lead] & (lead >= 0xC0)
    cut = np.zeros(len(data) + 1, bool)
    cut[at[safe]] = True
    cut[offsets] = True
    starts = np.flatnonzero(cut[:-1])
    return starts, np.append(starts[1:], len(data))


def _distinct(one, two):
    """For every piece the place of an equal piece; equal pieces mostly share one."""
    slot = (one & np.uint64(_SLOTS - 1)).astype(np.int64)
    table = np.zeros(_SLOTS, np.int32)
    here = np.arange(len(one), dtype=np.int32)
    table[slot] = here
    owner = table[slot]
    return np.where((one[owner] == one) & (two[owner] == two), owner, here)


_STRINGS: dict = {}
_PLAIN: dict = {}


def _special_strings(path) -> list:
    """The strings of the file's special tokens."""
    if path not in _STRINGS:
        with open(path, encoding="utf-8") as file:
            _STRINGS[path] = [t["content"] for t in json.load(file).get("added_tokens", [])]
    return _STRINGS[path]


def _with_special(path):
    """The file's own tokenizer, loaded only where a text holds a special string."""
    if path not in _PLAIN:
        _PLAIN[path] = tokenizer(path, special=True)
    return _PLAIN[path]


def encode(column, path=None, special=False):
    """``(ids, begin)``: the ids of all rows one after another, and each row's first id.

    With ``special``, strings of special tokens in a text are these tokens; rows that hold one are
    encoded by the file's own tokenizer.
    """
    if special:
        path = path or default_path()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        holds = np.zeros(len(column), bool)
        for string in _special_strings(path):
            holds |= pc.fill_null(pc.match_substring(column, string), False).to_numpy(zero_copy_only=False)
        if holds.any():
            ids, begin = encode(pc.if_else(pa.array(holds), "", column), path)
            rows, own = [ids[a:b] for a, b in zip(begin, begin[1:])], _with_special(path)
            for i in np.flatnonzero(holds).tolist():
                rows[i] = np.array(own.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
            return np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    own = coder(path)
    if own.whole is not None:
        coded = [x.ids for x in own.whole.encode_batch_fast(["" if t is None else t for t in column.to_pylist()], add_special_tokens=False)]
        return np.array([i for ids in coded for i in ids], np.uint32), np.cumsum([0, *map(len, coded)])
    parts, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in tb.each_slice(column, SLICE):
        if not len(data):
            counts.append(np.zeros(len(offsets) - 1, np.int64))
            continue
        own.forget(len(data))
        starts, ends = _cuts(data, offsets)
        first = np.searchsorted(starts, offsets)
        # A row's first piece may lack the space and its last one may end in white space.
        alone = np.zeros(len(starts), bool)
        filled = np.flatnonzero(np.diff(offsets))
        alone[first[filled]] = alone[first[filled + 1] - 1] = True
        inner = np.flatnonzero(~alone)
        begin, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if len(inner):
            one, two = (h.words(data, starts[inner], ends[inner]) for h in _HASHES)
            owner = _distinct(one, two)
            chosen = np.flatnonzero(np.bincount(owner, minlength=len(inner)))
            slot = (one[chosen] >> np.uint64(44)).astype(np.int64)
            known = (own.size[slot] > 0) & (own.keys[0][slot] == one[chosen]) & (own.keys[1][slot] == two[chosen])
            old, new = inner[chosen[known]], inner[chosen[~known]]
            begin[old], size[old] = own.begin[slot[known]], own.size[slot[known]]
            long = ends[new] - starts[new]
            edge = np.concatenate([[0], np.cumsum(long)])
            ids = own.one(data[np.arange(edge[-1]) + np.repeat(starts[new] - edge[:-1], long)].tobytes().decode())
            reach = np.concatenate([[0], np.cumsum(own.lengths[ids])])
            edge = np.searchsorted(reach, edge)
            begin[new], size[new] = own.store(ids) + edge[:-1], np.diff(edge)
            slot = slot[~known]
            own.keys[0][slot], own.keys[1][slot] = one[chosen[~known]], two[chosen[~known]]
            own.begin[slot], own.size[slot] = begin[new], size[new]
            begin[inner], size[inner] = begin[inner[owner]], size[inner[owner]]
        view = memoryview(data)
        for i in np.flatnonzero(alone).tolist():
            ids = own.one(str(view[starts[i]:ends[i]], "utf-8"))
            begin[i], size[i] = own.store(ids), len(ids)
        at = np.cumsum(size) - size
        parts.append(own.pool[np.arange(size.sum()) + np.repeat(begin - at, size)])
        counts.append(np.diff(np.concatenate([[0], np.cumsum(size)])[first]))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
