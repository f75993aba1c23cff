"""Token counts by compiled finite-state transducers.

Two deterministic transducers count the tokens of a byte-level BPE vocabulary.

The *boundary* transducer has eleven states over classes of characters. Each
transition is annotated with the pre-tokens that it emits, here or one character
back. Its transitions are compiled for runs of four classes at once. A text array
is cut into chunks; every chunk's map from start states to (end state, pre-tokens
emitted) is computed for all states at once, the maps are composed by a parallel
prefix scan, and the scan's start states and counts give each chunk its place and
the boundaries in it.

The *merge* transducer runs over the bytes of a pre-token. Its state is the
longest suffix of what was read that begins some vocabulary token, with the last
token and the relative token count of the encodings of the prefixes that end in
it; that is all a later byte can depend on, so the states are finitely many. A
byte leads to the one token whose encoding is consistent with the prefix before
it, and the transition carries the change in the token count. Transitions are
compiled when first taken and kept. A pre-token ends in the start state, so that
its chunk map is a number of tokens; the maps are kept by their bytes, and a text's
count is the sum that composes them. Longer pre-tokens are cut into chunks whose
maps (start state and bytes to end state and tokens) are kept and composed.

Counts equal those of the vocabulary's own encoder without special tokens.

Defined results: a null or empty text has 0 tokens. Each row is counted by
itself, whatever repeats; a null id stays. Texts of any length are counted
whole. Other columns are not returned by counted(), and pass through
with_counts(); one named like the count stays under a free name, _n_tokens.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, text_slices, with_columns
from .vec import run_hashes

#: Where the public vocabularies lie; a parameter of every query.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters that a chunk's state map spans.
CHUNK = 256
#: Slots of the table of pre-tokens whose counts a worker remembers; half full, it is emptied and they are counted again.
REMEMBER = 1 << 20
#: Bytes that a chunk of a long pre-token spans.
BYTES = 48
#: Compiled states that a worker keeps; beyond it they are compiled again when next needed.
COMPILED = 150_000

# ---- boundary transducer ---------------------------------------------------

_LETTER, _NUMBER, _OTHER, _SPACE, _WHITE, _QUOTE, _S, _E, _L, _RV, _END = range(11)
_START, _INL, _INN, _INO, _SP1, _W1, _SPK, _WK, _AP, _APR, _APL = range(11)
STATES = 11
_WHITES = {9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def boundary_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by class and state; emission bit 0: a pre-token starts here, bit 1: one started a character back."""
    letters, others = {_LETTER, _S, _E, _L, _RV}, {_OTHER, _QUOTE}
    nxt, emit = np.zeros((11, STATES), np.uint8), np.zeros((11, STATES), np.uint8)
    kind = lambda c: _INL if c in letters else _INN if c == _NUMBER else _INO
    for c in range(11):

        def begin() -> tuple[int, int]:
            if c == _END:
                return _START, 0
            if c == _QUOTE:
                return _AP, 1
            return (_SP1 if c == _SPACE else _W1 if c == _WHITE else kind(c)), 1

        white = c in (_SPACE, _WHITE)
        for s in range(STATES):
            to = begin()
            if c == _END:
                to = (_START, 2 if s in (_APR, _APL) else 0)
            elif s == _INL or s in (_APR, _APL):
                back = 0 if s == _INL else 2
                if (s == _APR and c == _E) or (s == _APL and c == _L):
                    to = (_START, 0)
                elif c in letters:
                    to = (_INL, back)
                else:
                    to = (to[0], to[1] | back)
            elif s == _INN and c == _NUMBER or s == _INO and c in others:
                to = (s, 0)
            elif s == _AP:
                if c == _S:
                    to = (_START, 0)
                elif c in (_RV, _L):
                    to = (_APR if c == _RV else _APL, 0)
                elif c in others:
                    to = (_INO, 0)
            elif s in (_SP1, _W1, _SPK, _WK):
                if white:
                    to = (_SPK if c == _SPACE else _WK, 0)
                elif s == _SP1:
                    to = (kind(c), 0)
                elif s == _SPK:
                    to = (kind(c), 2)
                elif s == _WK:
                    to = (to[0], 3)
            nxt[c, s], emit[c, s] = to
    return nxt, emit


_NEXT, _EMIT = boundary_tables()
RUN = 4  # classes that one compiled transition reads


def _compiled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, pre-tokens emitted, two bits of emission for each class) of every run of classes from every state."""
    runs = np.array(list(product(range(11), repeat=RUN)), np.uint8)
    state = np.tile(np.arange(STATES, dtype=np.uint8), (len(runs), 1))
    count, emitted = np.zeros(state.shape, np.uint8), np.zeros(state.shape, np.uint8)
    for k in range(RUN):
        emit = _EMIT[runs[:, k, None], state]
        count += (emit & 1) + (emit >> 1)
        emitted |= emit << (2 * k)
        state = _NEXT[runs[:, k, None], state]
    return state.reshape(-1), count.reshape(-1), emitted.reshape(-1)


_RUN_NEXT, _RUN_COUNT, _RUN_EMIT = _compiled()
_UNPACK = np.array([[e >> 2 * k & 3 for k in range(RUN)] for e in range(256)], np.uint8)
_classes = np.full(0x110001, 255, np.uint8)
_classes[0x110000] = _END
for _c, _k in {" ": _SPACE, "'": _QUOTE, "s": _S, "t": _S, "m": _S, "d": _S, "e": _E, "l": _L, "r": _RV, "v": _RV}.items():
    _classes[ord(_c)] = _k


def classes(code: np.ndarray) -> np.ndarray:
    """Class of each code point; 0x110000 ends a text."""
    got = _classes[code]
    if (got == 255).any():
        for x in np.unique(code[got == 255]).tolist():
            major = unicodedata.category(chr(x))[0]
            _classes[x] = _WHITE if x in _WHITES else _LETTER if major == "L" else _NUMBER if major == "N" else _OTHER
        got = _classes[code]
    return got


def _runs(cls: np.ndarray, chunk: int) -> np.ndarray:
    """(chunks, runs of each) by their number; the last chunk is padded with ends of text."""
    grid = np.full(-(-len(cls) // chunk) * chunk, _END, np.uint16)
    grid[: len(cls)] = cls
    grid = grid.reshape(-1, chunk // RUN, RUN)
    number = grid[:, :, 0]
    for k in range(1, RUN):
        number = number * np.uint16(11) + grid[:, :, k]
    return number.astype(np.int32) * STATES


def chunk_maps(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end state, pre-tokens emitted) of every chunk for every start state."""
    state = np.tile(np.arange(STATES, dtype=np.uint8), (len(runs), 1))
    count = np.zeros(state.shape, np.int64)
    for k in range(runs.shape[1]):
        at = runs[:, k, None] + state
        count += _RUN_COUNT[at]
        state = _RUN_NEXT[at]
    return state, count


def prefix_scan(state: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps of chunks 0..i composed, for every i, in log2 rounds."""
    state, count, step = state.astype(np.int64), count.copy(), 1
    while step < len(state):
        first, mid = count[:-step].copy(), state[:-step].copy()
        count[step:] = first + np.take_along_axis(count[step:], mid, 1)
        state[step:] = np.take_along_axis(state[step:], mid, 1)
        step *= 2
    return state, count


def pretokens(cls: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The characters at which pre-tokens start, in order; *chunk* is a multiple of RUN."""
    n = len(cls)
    runs = _runs(cls, chunk)
    state, count = prefix_scan(*chunk_maps(runs))
    now = np.append(_START, state[:-1, _START]).astype(np.uint8)
    emitted = np.zeros(runs.shape, np.uint8)
    for k in range(runs.shape[1]):
        at = runs[:, k] + now
        emitted[:, k] = _RUN_EMIT[at]
        now = _RUN_NEXT[at]
    bits = _UNPACK[emitted].reshape(-1)
    back = np.flatnonzero(bits >= 2)
    here = bits & 1
    here[back - 1] = 1
    starts = np.flatnonzero(here[:n])
    assert len(starts) == count[-1, _START]  # what the composed maps emit
    return starts


# ---- merge transducer ------------------------------------------------------


#: The rank of no token; the number that stands for 0 in twelve bits; the transitions of a state that has none yet.
_NOTHING, _ZERO = 1 << 18, 2048
_NONE: dict[int, int] = {}


class Merges:
    """The lazily compiled transducer of a byte-level BPE vocabulary (token bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= _NOTHING:
            raise ValueError(f"the vocabulary has ranks above {_NOTHING}")
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        #: What begins a longer token.
        self.begins = {t[:i] for t in ranks for i in range(1, len(t))}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.forget()

    def forget(self) -> None:
        """Drop the compiled states. A state is the bytes of its ends and its suffix: for the text before each place of
        the suffix, and for all of it, the last token's rank and the count relative to all in one number, or -1 where no
        later token can start. A transition is the next state and the change in the count in one number."""
        self.states = [array("i", [_NOTHING << 12 | _ZERO]).tobytes()]
        self.names = {self.states[0]: 0}
        self.edges: list[dict[int, int]] = [_NONE]
        self.maps: dict[tuple[int, bytes], tuple[int, int]] = {}

    def merged(self, text: bytes, below: int = 1 << 60) -> list[bytes]:
        """The plain encoding of a few bytes, by merges of a rank under *below*."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = [self.ranks.get(text[i : i + 2], below) for i in range(len(text) - 1)]
        while ranks:
            least = min(ranks)
            if least >= below:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], below)
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], below)
        return parts

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that are merged last into a token; None for a single byte."""
        if token not in self.halves:
            parts = self.merged(token, self.ranks[token]) if len(token) > 1 else ()
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def agree(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of a + b is a, b. It isn't if two parts at the seam, at the right end of a
        and the left end of b, would be merged before one of them goes into the next larger part; those
        that stand there at the same time are found by undoing the later of the two merges."""
        before, left, right, ranks = 1 << 60, a, b, self.ranks
        while True:
            r = ranks.get(left + right)
            if r is not None and r < before:
                return False
            # Of single bytes there is no merge to undo.
            ra = ranks[left] if len(left) > 1 else -1
            rb = ranks[right] if len(right) > 1 else -1
            if ra < 0 and rb < 0:
                return True
            # A merge at the right of the seam gives way to one of equal rank at its left.
            half = self.split(left if ra > rb else right)
            if half is None:  # an odd vocabulary
                return self.merged(a + b) == [a, b]
            if ra > rb:
                before, left = ra, half[1]
            else:
                before, right = rb + 1, half[0]

    def step(self, state: int, byte: int) -> int:
        """The transition."""
        key = self.states[state]
        n = (len(key) + 1) // 5  # ends, and bytes of the suffix with the new one
        ends, s = memoryview(key)[: 4 * n].cast("i"), key[4 * n :] + bytes((byte,))
        ranks, begins = self.ranks, self.begins
        for k in range(n):
            end = ends[k]
            if end >= 0 and (token := s[k:]) in ranks and (end >> 12 == _NOTHING or self.agree(self.tokens[end >> 12], token)):
                break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        delta = (end & 4095) - _ZERO + 1
        j = 0
        while j < n and s[j:] not in begins:
            j += 1
        keep = [ends[i] - delta if ends[i] >= 0 and s[i:] in begins else -1 for i in range(j, n)]
        keep.append(ranks[token] << 12 | _ZERO)
        new = array("i", keep).tobytes() + s[j:]
        name = self.names.get(new)
        if name is None:
            name = self.names[new] = len(self.states)
            self.states.append(new)
            self.edges.append(_NONE)
        if self.edges[state] is _NONE:
            self.edges[state] = {}
        found = self.edges[state][byte] = name << 12 | delta + _ZERO
        return found

    def run(self, state: int, text: bytes) -> tuple[int, int]:
        """(end state, tokens) of *text* from *state*."""
        total, edges = 0, self.edges
        for byte in text:
            got = edges[state].get(byte)
            if got is None:
                got = self.step(state, byte)
            state = got >> 12
            total += got & 4095
        return state, total - _ZERO * len(text)

    def count(self, text: bytes) -> int:
        """Tokens of a pre-token; a long one's chunks are looked up in the maps of chunks seen before."""
        if len(text) <= BYTES:
            return self.run(0, text)[1]
        state = total = 0
        for i in range(0, len(text), BYTES):
            key = state, text[i : i + BYTES]
            got = self.maps.get(key)
            if got is None:
                if len(self.maps) >= COMPILED:
                    self.maps.clear()
                got = self.maps[key] = self.run(*key)
            state, total = got[0], total + got[1]
        return total


class Known:
    """Numbers by 64-bit hash: open addressing over arrays, for many hashes at once."""

    def __init__(self, slots: int = REMEMBER):
        self.mask = slots - 1
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.held = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash (none is 0), -1 if it isn't there."""
        at = (h & np.uint64(self.mask)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == h, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != h) & (found != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == h[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found != 0)
            left, at = left[on], at[on]
        return out

    def add(self, h: np.ndarray, value: np.ndarray) -> None:
        """Distinct hashes that aren't there yet."""
        if self.held + len(h) > (self.mask + 1) // 2:
            self.clear()
        if len(h) > (self.mask + 1) // 2:
            return
        self.held += len(h)
        at = (h & np.uint64(self.mask)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            mine = self.keys[at] == h
            self.values[at[mine]] = value[mine]
            h, value, at = h[~mine], value[~mine], (at[~mine] + 1) & self.mask


class Counter:
    """Tokens of texts, with what a worker has counted before."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges, self.known = Merges(ranks), Known()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each of the texts."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        raw = data.tobytes()
        at = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each character
        code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        ends = np.searchsorted(at, offsets[1:])  # characters up to the end of each text
        starts = pretokens(classes(np.insert(code, ends, 0x110000)))
        upto = np.searchsorted(starts, ends + np.arange(n))  # pre-tokens up to the end of each text
        # A mark of an end shifts the characters after it by one; no pre-token starts at a mark.
        first = at[starts - np.repeat(np.arange(n), np.diff(upto, prepend=0))]
        # A pre-token ends with its text: the next one starts where the next text with any does.
        last = np.append(first[1:], len(data))
        h = np.maximum(run_hashes(data, first, last), np.uint64(1))
        counts = self.known.find(h).astype(np.int64)
        new = np.flatnonzero(counts < 0)
        if len(new):
            if len(self.merges.states) > COMPILED:
                self.merges.forget()
            distinct, index, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            index = new[index]
            got = np.array([self.merges.count(raw[a:b]) for a, b in zip(first[index].tolist(), last[index].tolist())], np.int64)
            counts[new] = got[inverse]
            self.known.add(distinct, got)
        # Each text starts in the start state, so its map is the difference of the scanned sums.
        sums = np.append(0, np.cumsum(counts))
        return np.diff(sums[upto], prepend=0)


def load(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(load(path))


def _counts(path: str):
    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(path)
        for text in batches:
            parts = [counter(d, o) for d, o, _ in text_slices(text)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return count.asNondeterministic()


def with_counts(docs: DataFrame, text_col: str = "text", name: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """*docs* with the tokens of each text as *name*; the vocabulary's file must be there on every executor."""
    bounded(docs)
    held = fresh(docs, "__tokens")
    got = docs.withColumn(held, _counts(vocabulary)(F.col(f"`{text_col}`")))
    return with_columns(got, {name: F.col(held)}, drop=[held])


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every row."""
    return with_counts(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col, vocabulary=vocabulary).drop(text_col)
