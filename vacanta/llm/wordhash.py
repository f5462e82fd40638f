"""64-bit hashes of the words of many texts at once, from the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is taken alone.
CHUNK = 1 << 17
_random = np.random.Generator(np.random.Philox(20240229))
# One random number per byte value, with A to Z as a to z, and one odd number per place in a word.
_BYTE = _random.integers(0, 1 << 64, 256, dtype="u8")
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _random.integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and the number of words up to each end."""
    at = np.flatnonzero(~_SPACE[data])
    if not len(at):
        return np.empty(0, "u8"), np.zeros(len(ends), "i8")
    opens = np.empty(len(at), bool)
    opens[0], opens[1:] = True, at[1:] != at[:-1] + 1
    head = np.searchsorted(at, ends[:-1])  # the first byte of a word at or after each text's begin
    head = head[head < len(at)]
    opens[head] = True
    begin = np.flatnonzero(opens)
    size = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, size)
    value = _BYTE[data[at]] * _PLACE[place & 255]
    if size.max() > 256:
        value *= (place >> 8).astype("u8") * np.uint64(2) + np.uint64(1)
    words = mixed(np.add.reduceat(value, begin) ^ size.astype("u8"))
    return words, np.searchsorted(at[begin], ends)


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text the hashes of its words, with A to Z taken as a to z; none for NULL.

    Words are runs of bytes other than the six ASCII white-space characters. Equal words have equal hashes.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, "i8")[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, "u1") if data is not None else np.empty(0, "u1")
    row = 0
    while row < len(texts):
        last = max(int(np.searchsorted(ends, ends[row] + CHUNK, side="right")) - 1, row + 1)
        words, upto = _hashed(raw[ends[row]:ends[last]], ends[row + 1:last + 1] - ends[row])
        for begin, end in zip([0, *upto[:-1].tolist()], upto.tolist()):
            yield words[begin:end]
        row = last
