"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A batch of texts becomes one array of code points and one of code-point classes. The rule that cuts text into
pre-tokens is a small automaton; each class is a function from state to state, these functions form a finite set
that is closed under composition, and composition is associative. So the state before every character comes from
a blocked prefix scan over function numbers (one table lookup per character), without a regular expression. The
slices between token starts feed a bounded cache of merged pairs. Byte offsets of all tokens are kept, and decoding
writes each token's bytes at its offset.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes as the automaton sees them. CON2 and CON3: an apostrophe that begins a contraction of 2 or 3
# characters; W_MORE: white space before more of it or at the end; W_SPACE, W_OTHER: the last one before other text.
LETTER, NUMBER, OTHER, CON2, CON3, W_MORE, W_SPACE, W_OTHER, END = range(9)
# States: what the character before belongs to. FRESH: whatever follows starts a token. JOIN: after a single space
# that the next run takes in. REST1, REST2: so many characters of a contraction are still to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOIN, REST1, REST2, IN_WHITE = range(8)

# Contractions of the pre-token rule, by length, and the characters with the White_Space property.
CONTRACTIONS_2 = ("s", "t", "m", "d")
CONTRACTIONS_3 = ("re", "ve", "ll")
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers of Unicode 16 that Python's character database (15.1) lacks and the library knows.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

#: Stands between texts; Spark strings are UTF-8 and can't hold it.
BREAK = "\ud800"
#: Above all ranks.
NO_RANK = 1 << 60
CACHE_WORDS = 300_000
CACHE_CHARS = 40
#: Characters that are scanned at once.
STEP = 1 << 21
#: Bytes of text that become one Arrow batch of ids and offsets, which take about twice as many.
BATCH_BYTES = 1 << 21


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a token) for each class and state."""
    nxt, start = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for cls, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        nxt[cls] = run
        start[cls, [run, JOIN]] = False
    nxt[LETTER, REST1], nxt[LETTER, REST2] = FRESH, REST1
    start[LETTER, [REST1, REST2]] = False
    for cls, rest in ((CON2, REST1), (CON3, REST2)):  # inside a run or after a joined space it's a plain character
        nxt[cls] = rest
        nxt[cls, [IN_OTHERS, JOIN]] = IN_OTHERS
        start[cls, [IN_OTHERS, JOIN]] = False
    nxt[W_MORE] = IN_WHITE
    start[W_MORE, IN_WHITE] = False
    nxt[W_SPACE], nxt[W_OTHER], nxt[END] = JOIN, FRESH, FRESH
    return nxt, start


def _closure(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All functions that compositions of the classes' functions give, and the table (first, then second) -> both."""
    found = {tuple(range(8)): 0}
    for row in nxt:
        found.setdefault(tuple(int(x) for x in row), len(found))
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in nxt:
            h = tuple(int(g[x]) for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    fun = np.array(list(found), np.uint8)
    table = np.array([[found.get(tuple(int(x) for x in g[f]), -1) for g in fun] for f in fun])
    assert table.min() >= 0
    return fun, table.astype(np.uint8)


NEXT, START = _rules()
FUN, COMPOSE = _closure(NEXT)
CLASS_FUN = np.array([next(i for i, f in enumerate(FUN) if (f == row).all() and i) for row in NEXT], np.uint8)
_N = len(FUN)
assert _N < 16, "a pair of function numbers must fit a byte"
_COMPOSE = COMPOSE.ravel()
_PITCH = np.uint8(_N)
#: Whether a character of a class starts a token after a prefix with a given function (from FRESH).
_STARTS = START[:, FUN[:, FRESH]].ravel()


def scan(ids: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of function numbers: blocks in parallel, then the blocks' totals, then both joined."""
    n = len(ids)
    if n <= 64:
        out = ids.copy()
        for i in range(1, n):
            out[i] = COMPOSE[out[i - 1], out[i]]
        return out
    width = min(128, max(8, int(n**0.5)))
    blocks = -(-n // width)
    own = np.zeros(blocks * width, np.uint8)  # 0: the identity
    own[:n] = ids
    own = np.ascontiguousarray(own.reshape(blocks, width).T)
    for j in range(1, width):
        np.take(_COMPOSE, own[j - 1] * _PITCH + own[j], out=own[j], mode="clip")
    before = np.zeros(blocks, np.uint8)
    before[1:] = scan(own[-1])[:-1]
    own = _COMPOSE[before * _PITCH + own]
    return np.ascontiguousarray(own.T).ravel()[:n]


_kinds: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """Per code point: LETTER, NUMBER, OTHER, W_OTHER (any white space) or END."""
    if not _kinds:
        t = np.full(0x110000, OTHER, np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))[0]
            if c == "L":
                t[i] = LETTER
            elif c == "N":
                t[i] = NUMBER
        for newer, kind in ((NEWER_LETTERS, LETTER), (NEWER_NUMBERS, NUMBER)):
            for first, last in newer:
                t[first : last + 1] = kind
        t[WHITE] = W_OTHER
        t[ord(BREAK)] = END
        _kinds.append(t)
    return _kinds[0]


def classes(codes: np.ndarray) -> np.ndarray:
    """The automaton's class of each code point; looks one or two characters ahead."""
    kind = _kind()[codes]
    ahead = np.full(len(codes) + 2, END, np.uint8)
    ahead[:-2] = kind
    white = np.flatnonzero(kind == W_OTHER)
    follow = ahead[white + 1]
    kind[white] = np.where((follow == W_OTHER) | (follow == END), W_MORE, np.where(codes[white] == 0x20, W_SPACE, W_OTHER))
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        c = np.zeros(len(codes) + 2, np.uint32)
        c[:-2] = codes
        one, two = c[quote + 1], c[quote + 2]
        kind[quote[np.isin(one, [ord(x) for x in CONTRACTIONS_2])]] = CON2
        for x in CONTRACTIONS_3:
            kind[quote[(one == ord(x[0])) & (two == ord(x[1]))]] = CON3
    return kind


def token_starts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of ``text`` begin, and which of them are a BREAK."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    cls = classes(codes)
    upto = scan(CLASS_FUN[cls])
    pair = cls * _PITCH
    pair[1:] += upto[:-1]
    at = np.flatnonzero(_STARTS[pair])
    return at, cls[at] == END


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of one text."""
    at = token_starts(text)[0].tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)] if at else []


# ---- vocabularies ---------------------------------------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and their id per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pairs(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank merges first, the leftmost of equals. Time n log n."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    if n <= 32:
        parts = [word[i : i + 1] for i in range(n)]
        pairs = [ranks.get(word[i : i + 2], NO_RANK) for i in range(n - 1)]
        while pairs and (least := min(pairs)) < NO_RANK:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        return [ranks[x] for x in parts]
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # end[i] == start of the next part
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            left[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if left[i] >= 0 and (r := ranks.get(word[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Cache(dict):
    """Pre-token -> its ids as packed little-endian unsigned 32-bit integers; emptied when full, long ones not kept."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.encode(word), "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            self[word] = out
        return out


class Encoder:
    """Encodes texts with one vocabulary; held once per Python worker.

    ``added`` holds strings that are one token wherever they stand. Texts are cut at them, the longest of several at
    a place first, before anything else; the stretches between are texts of their own for the pre-token rule.
    """

    def __init__(self, encode: Callable[[str], list[int]], added: dict[str, int] | None = None):
        self.cache = Cache(encode)
        self.added = {word: np.array([i], "<u4").tobytes() for word, i in (added or {}).items()}
        self.cut = re.compile("(" + "|".join(re.escape(w) for w in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids per text."""
        if self.cut is None:
            return self._plain(texts)
        cut = [self.cut.split(x) for x in texts]  # stretches and added tokens by turns
        packed = iter(self._plain([x for own in cut for x in own[::2]]))
        return [next(packed) if len(own) == 1 else b"".join([self.added[x] if k % 2 else next(packed) for k, x in enumerate(own)]) for own in cut]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Packed ids per text without added tokens. Texts are joined and scanned about STEP characters at a time."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            k, size = i, 0
            while k < len(texts) and (k == i or size + len(texts[k]) <= STEP):
                size += len(texts[k])
                k += 1
            out += self._joined(texts[i:k])
            i = k
        return out

    def _joined(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        text = BREAK.join(texts) + BREAK
        at, is_break = token_starts(text)
        where = at.tolist()
        get = self.cache.__getitem__
        out, first = [], 0
        for last in np.flatnonzero(is_break).tolist():
            out.append(b"".join([get(text[a:b]) for a, b in zip(where[first:last], where[first + 1 : last + 1])]))  # noqa: B905
            first = last + 1
        return out


_loaded: dict[tuple[str, str], object] = {}


def rank_encoder(path: str) -> Encoder:
    """An encoder over a rank file."""
    if (key := ("ranks", path)) not in _loaded:
        ranks = read_ranks(path)
        _loaded[key] = Encoder(lambda w: merge_pairs(w.encode("utf-8", "replace"), ranks))
    return _loaded[key]


def _byte_letters() -> list[str]:
    """The public byte-to-letter map of byte-level BPE files: printable Latin-1 stands for itself, the rest follows from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


def read_added(path: str) -> dict[str, int]:
    """The added tokens of a file of the tokenizers library. Those with rules about their surroundings aren't supported."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    added = data.get("added_tokens") or []
    for t in added:
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or (t.get("normalized") and data.get("normalizer")):
            raise ValueError(f"added token {t['content']!r} has rules about its surroundings")
    return {t["content"]: t["id"] for t in added}


def json_encoder(path: str) -> Encoder:
    """An encoder over a byte-level BPE file of the tokenizers library, which merges the pre-tokens the cache lacks.

    The file's added tokens are recognised in texts, as the library does by default.
    """
    if (key := ("json", path)) not in _loaded:
        from tokenizers import Tokenizer

        model, letters = Tokenizer.from_file(path).model, _byte_letters()
        _loaded[key] = Encoder(lambda w: [t.id for t in model.tokenize("".join([letters[b] for b in w.encode("utf-8", "replace")]))], read_added(path))
    return _loaded[key]


class ByteTable:
    """Bytes of all ids of a vocabulary in one array, for decoding by gathers."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for word, i in ranks.items():
            parts[i] = word
        self.length = np.array([len(x) for x in parts], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the decoded text."""
        n = self.length[ids]
        return np.cumsum(n) - n

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of ``ids``, each token's placed at its offset."""
        if not len(ids):
            return b""
        n = self.length[ids]
        at = self.offsets(ids) if offsets is None else offsets
        return self.data[np.arange(int(at[-1] + n[-1])) + np.repeat(self.first[ids] - at, n)].tobytes()


def byte_table(path: str) -> ByteTable:
    if (key := ("bytes", path)) not in _loaded:
        _loaded[key] = ByteTable(read_ranks(path))
    return _loaded[key]


# ---- Spark ----------------------------------------------------------------------------------------------------------


def _chunks(batches: Iterable[pa.RecordBatch], col: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no piece holds much more than ``limit`` bytes of the column (or one row)."""
    for b in batches:
        array = b.column(b.schema.get_field_index(col))
        size = array.nbytes // max(1, len(array))
        step = max(1, limit // max(1, size))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids ARRAY<INT>`` and ``offsets ARRAY<INT>`` (byte offset of each token) for whole texts.

    Map-only. Null text counts as empty: empty arrays. No special tokens. A very long text is one row like any other: it
    is scanned whole and its arrays are as long as it needs; other texts are done and handed on BATCH_BYTES at a time.
    Existing columns called ids or offsets are replaced, others pass through. Repeated rows stay; an empty table stays
    empty. Session settings aren't touched.
    """
    kept = [c for c in docs.columns if c not in ("ids", "offsets")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = rank_encoder(ranks_path), byte_table(ranks_path)
        for b in _chunks(batches, text_col, BATCH_BYTES):
            texts = [x or "" for x in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            packed = encoder.encode_all(texts)
            count = np.array([len(x) // 4 for x in packed], np.int64)
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(count)])
            flat = table.offsets(ids)
            first = np.append(flat, 0)[ends[:-1]] if len(flat) else np.zeros(len(count), np.int64)
            flat = (flat - np.repeat(first, count)).astype(np.int32)
            at = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(flat))], names=[*b.schema.names, "ids", "offsets"])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """``tokens(ids, offsets, ...)`` with ``decoded BINARY``, the bytes the ids stand for; ids and offsets are dropped.

    Null ids: null. An id outside the vocabulary fails the job. A column called decoded is replaced, others pass through.
    Bytes are handed on about BATCH_BYTES at a time, a very long text's whole. An empty table stays empty.
    """
    kept = [c for c in tokens.columns if c not in ("ids", "offsets", "decoded")]
    schema = T.StructType([*(tokens.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(ranks_path)
        for b in _chunks(batches, "ids", 2 * BATCH_BYTES):
            out = []
            for ids, at in zip(b.column(b.schema.get_field_index("ids")), b.column(b.schema.get_field_index("offsets")), strict=True):
                own = None if ids.values is None else ids.values.to_numpy(zero_copy_only=False)
                out.append(None if own is None else table.decode(own, at.values.to_numpy(zero_copy_only=False).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return tokens.select(*[F.col(f"`{c}`") for c in kept], "ids", "offsets").mapInArrow(run, schema)
