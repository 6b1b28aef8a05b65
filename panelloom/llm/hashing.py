"""Words and word shingles of whole texts as 64-bit hashes, for Arrow batches.

Everything is computed on the flat bytes of many texts at once, a bounded
slice of a batch at a time, so no Python object exists per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
SLICE = 1 << 18  # bytes of text worked on at once; a longer text is a slice of its own
KEPT = 1 << 21  # powers a worker keeps at most

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(BASE))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


BYTE_VALUES = _byte_values()


def _word_bytes(kind: str) -> np.ndarray:
    """Bytes that belong to a word.

    ``blank``: all but ASCII white space; ``alnum``: ASCII letters and digits and
    all bytes of non-ASCII characters.
    """
    flags = np.ones(256, dtype=bool)
    if kind == "blank":
        flags[[0x20, *range(0x09, 0x0E)]] = False
    else:
        flags[:0x80] = [chr(b).isalnum() for b in range(0x80)]
    return flags


WORD_BYTES = {kind: _word_bytes(kind) for kind in ("blank", "alnum")}
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; those of a longer text than KEPT are not kept."""
    made = _POWERS
    if "up" not in made or len(made["up"]) < n:
        made = {} if n > KEPT else _POWERS
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, SLICE), base, dtype=U)
            steps[0] = 1
            made[name] = np.multiply.accumulate(steps)
    return made["up"][:n], made["down"]


def slices(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``size`` (SLICE) bytes; null counts as empty."""
    size = size or SLICE
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _bounds(raw: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of every word."""
    n = len(raw)
    inside = WORD_BYTES[kind][raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


class Bytes:
    """Prefix sums over the bytes of many texts, from which any range has its hash in constant time."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw))
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTE_VALUES[raw] * up, dtype=U)])

    def hashes(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.sums[first + length] - self.sums[first]) * self.down[first] + length.astype(U) * U(BASE))


def words(raw: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z as a-z) in order, and the words per text."""
    return words_and_beginnings(raw, offsets, kind, ())[:2]


def words_and_beginnings(
    raw: np.ndarray, offsets: np.ndarray, kind: str, lengths: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """As ``words``, and for each length the hashes of that many first bytes of every longer word, with the word's number."""
    if len(raw) == 0:
        empty = np.zeros(0, U), np.zeros(0, np.int64)
        return empty[0], np.zeros(len(offsets) - 1, np.int64), [empty for _ in lengths]
    first, last = _bounds(raw, offsets, kind)
    size = last - first + 1
    sums = Bytes(raw)
    stems = []
    for length in lengths:
        longer = np.flatnonzero(size > length)
        stems.append((mix(sums.hashes(first[longer], np.full(len(longer), length)) + U(1)), longer))
    return sums.hashes(first, size), np.diff(np.searchsorted(first, offsets)), stems


def shingles(hashes: np.ndarray, per_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, in text order, and the runs per text.

    A text with fewer words, but at least one, has its whole sequence as its only run.
    """
    n = len(hashes)
    starts = np.cumsum(per_text) - per_text
    runs = np.where(per_text >= size, per_text - size + 1, (per_text > 0).astype(np.int64))
    if n == 0:
        return np.zeros(0, U), runs
    rolled = hashes.copy()
    for j in range(1, min(size, n)):
        rolled[: n - j] = rolled[: n - j] * U(0xD6E8FEB86659FD93) + hashes[j:]
    keep = np.ones(n, dtype=bool)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    position = np.arange(n) - starts[owner]
    keep = position < runs[owner]
    for length in range(1, size):
        short = starts[per_text == length]
        if len(short):
            value = hashes[short]
            for j in range(1, length):
                value = value * U(0xD6E8FEB86659FD93) + hashes[short + j]
            rolled[short] = value + U(BASE * length % (1 << 64))
    return mix(rolled[keep]), runs


def sorted_sets(hashes: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text in ascending order, and their number per text."""
    hashes = hashes.copy()
    ends = np.cumsum(runs)
    for a, b in zip((ends - runs).tolist(), ends.tolist()):
        hashes[a:b].sort()
    owner = np.repeat(np.arange(len(runs)), runs)
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(runs)).astype(np.int64)


def sums_by_segment(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Wrapping sum of consecutive segments, 0 for empty ones."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
