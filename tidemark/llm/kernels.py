"""Vectorised text kernels that run inside tasks: word names, shingles, sampled windows.

A name is a 64-bit hash that stands for a string of bytes or words. All
functions take the bytes of many texts in one buffer with their offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the hash steps.
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
#: Zero bytes after the buffer, so that eight bytes can be read at any place.
PAD = 64
#: Bytes (or words) for which whole-length temporaries exist at a time; they stay in a core's cache.
SLICE = 1 << 16


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits, in place."""
    x ^= x >> U(32)
    x *= M3
    x ^= x >> U(29)
    x *= M1
    x ^= x >> U(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two named strings one after the other."""
    x = a * M1
    x ^= x >> U(29)
    x += b * M2
    return scramble(x)


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with padding, and offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return np.zeros(PAD, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    return np.concatenate([data, np.zeros(PAD, np.uint8)]), at - at[0]


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))


_TAIL = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 8)] + [2**64 - 1], U)

#: White space that ends a word: bytes 0x09 to 0x0D and 0x20.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: ASCII that is neither letter nor digit.
ODD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def words(buf: np.ndarray, offsets: np.ndarray, ends: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts and ends of all words, and the word offsets of each text. Words never cross texts."""
    n = int(offsets[-1])
    inside = np.zeros(n + 1, bool)
    np.logical_not(ends[buf[:n]], out=inside[:n])
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    borders = offsets[:-1][offsets[:-1] < n]
    first[borders] = inside[borders]
    last = inside[:n] & ~inside[1:]
    inner = borders[borders > 0] - 1
    last[inner] = inside[inner]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(starts, offsets)
    return name_bytes(buf, starts, stops), starts, stops, at


def name_bytes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The name of each byte string buf[start:stop]."""
    x8, size = eights(buf), stops - starts
    names = (size.astype(U) + U(1)) * M2
    rest, done = np.arange(len(starts)), 0
    while len(rest):
        left = np.minimum(size[rest] - done, 8)
        part = x8[starts[rest] + done] & _TAIL[left]
        names[rest] = pair(names[rest], part)
        done += 8
        rest = rest[size[rest] > done]
    return names


def runs_of(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given lengths."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def shingles(names: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of all ``width``-word shingles and their offsets by text.

    A text of fewer words has one shingle, its whole word sequence; one
    without words has none.
    """
    count = np.diff(at)
    full = np.maximum(count - width + 1, 0)
    short = (count > 0) & (count < width)
    sizes = full + short
    out = np.zeros(int(sizes.sum()), U)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if (total := int(full.sum())) > 0:
        places = np.repeat(at[:-1], full) + runs_of(full)
        x = np.full(total, width, U)
        for i in range(width):
            x = pair(x, names[places + i])
        out[np.repeat(offsets[:-1], full) + runs_of(full)] = x
    for d in np.flatnonzero(short):
        x = np.full(1, count[d], U)
        for w in names[at[d] : at[d + 1]]:
            x = pair(x, np.array([w]))
        out[offsets[d]] = x[0]
    return out, offsets


class Windows:
    """All windows of ``length`` units in many texts, bundled around sampled anchors.

    Of the grams of ``gram`` units inside a window, the one with the least hash
    (the leftmost of ties) is its anchor. It depends on the window's content
    alone, so equal windows have equal anchors wherever they stand.
    Neighbouring windows with the same anchor place form one bundle, about one
    for 13 units; equal bundles have equal anchor and digest.
    """

    def __init__(self, offsets: np.ndarray, length: int, gram: int):
        self.offsets, self.length, self.gram = offsets, length, gram

    def raw_grams(self, start: int, stop: int) -> np.ndarray:
        """A hash of each gram that starts in [start, stop); only its high bits are even."""
        raise NotImplementedError

    def names(self, places: np.ndarray) -> np.ndarray:
        """The names of the windows that start at ``places``."""
        raise NotImplementedError

    def bundles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, first window start, number of windows, anchor, digest of each bundle."""
        parts = [self._slice(*x) for x in self._slices()]
        if not parts:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
        text, start, count, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        digest = np.zeros(len(start), U)
        for i in range(0, len(start), SLICE):
            s, n = start[i : i + SLICE], count[i : i + SLICE]
            digest[i : i + SLICE] = pair(pair(self.names(s), self.names(s + n - 1)), n.astype(U))
        return text, start, count, scramble(anchor), digest

    def _slices(self) -> Iterator[tuple[int, int, int, int]]:
        """(text from, text to, first start, last start + 1): whole short texts, or a part of a long one."""
        o, n, i = self.offsets, len(self.offsets) - 1, 0
        while i < n:
            j = int(np.searchsorted(o, o[i] + SLICE, side="right")) - 1
            if j > i:
                yield i, j, int(o[i]), int(o[j])
                i = j
            else:
                for lo in range(int(o[i]), int(o[i + 1]), SLICE):
                    yield i, i + 1, lo, min(lo + SLICE, int(o[i + 1]))
                i += 1

    def _slice(self, i: int, j: int, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        o, width = self.offsets, self.length - self.gram + 1
        stop = min(hi + self.length - 1, int(o[j]))
        starts = stop - lo - self.length + 1
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
        if starts <= 0:
            return none
        raw = self.raw_grams(lo, stop - self.gram + 1)
        least = raw * M3
        least &= U(0xFFFFFFFF00000000)
        least |= np.arange(len(raw), dtype=U)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: -(width - span)], least[width - span :])
        least = least[:starts]
        # a bundle begins where the anchor's place changes and where a text begins
        new = np.flatnonzero(least[1:] != least[:-1]) + 1
        new = np.union1d(new, np.clip(o[i:j], lo, None) - lo)
        new = new[new < starts]
        text = np.searchsorted(o, new + lo, side="right") - 1
        end = np.minimum(np.append(new[1:], starts), o[1:][text] - self.length + 1 - lo)
        whole = end > new
        new, text, end = new[whole], text[whole], end[whole]
        return text, new + lo, end - new, raw[(least[new] & U(0xFFFFFFFF)).astype(np.int64)]


def doubled(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rank pair of two equally long strings as one number: cheap, with even high bits after one more multiplication."""
    z = x * M2
    z += y
    z ^= z >> U(29)
    return z


class ByteWindows(Windows):
    """Windows of bytes. A gram is half a window, so a window is named by the pair of names of its halves."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, length: int):
        if length < 32 or length > 2 * PAD:
            raise ValueError("between 32 and 128 bytes")
        super().__init__(offsets, length, (length + 1) // 2)
        self.x8 = eights(buf)

    def raw_grams(self, start: int, stop: int) -> np.ndarray:
        x = self.x8[start : stop + self.gram - 8] * M1
        x ^= x >> U(32)
        size = 8
        while size < self.gram:
            step = min(size, self.gram - size)
            x = doubled(x[:-step], x[step:])
            size += step
        return x

    def _raw(self, places: np.ndarray, size: int) -> np.ndarray:
        if size == 8:
            x = self.x8[places] * M1
            x ^= x >> U(32)
            return x
        half = 8
        while half * 2 < size:
            half *= 2
        return doubled(self._raw(places, half), self._raw(places + size - half, half))

    def names(self, places: np.ndarray) -> np.ndarray:
        return pair(scramble(self._raw(places, self.gram)), scramble(self._raw(places + self.length - self.gram, self.gram)))


class WordWindows(Windows):
    """Windows of words, out of word names."""

    def __init__(self, names: np.ndarray, at: np.ndarray, length: int, gram: int = 8):
        super().__init__(at, length, min(gram, length))
        self.levels = [np.concatenate([names, np.zeros(2 * length, U)])]
        size = 1
        while size * 2 <= length:
            self.levels.append(pair(self.levels[-1][:-size], self.levels[-1][size:]))
            size *= 2

    def _named(self, size: int, load) -> np.ndarray:
        """Doubling: the name of 2n words is the pair of the names of n words at offset n; odd lengths overlap."""
        level = size.bit_length() - 1
        rest = size - (1 << level)
        return pair(load(level, 0), load(level, rest)) if rest else load(level, 0)

    def raw_grams(self, start: int, stop: int) -> np.ndarray:
        return self._named(self.gram, lambda lv, s: self.levels[lv][start + s : stop + s])

    def names(self, places: np.ndarray) -> np.ndarray:
        return self._named(self.length, lambda lv, s: self.levels[lv][places + s])


def packed_bits(states: np.ndarray) -> bytes:
    """Two bits for each state."""
    full = np.zeros(-(-len(states) // 4) * 4, np.uint8)
    full[: len(states)] = states
    q = full.reshape(-1, 4)
    return (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).tobytes()


def unpacked_bits(blob: bytes, n: int) -> np.ndarray:
    q = np.frombuffer(blob, np.uint8)
    return np.stack([q & 3, q >> 2 & 3, q >> 4 & 3, q >> 6], axis=1).reshape(-1)[:n]
