"""Values of words by their distinct forms.

Arrow numbers the distinct words of a batch, each is looked up once, and the texts' values are
gathered by number. Nothing is done in Python for each word of a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled together; a longer text is a slice of its own.
SLICE_BYTES = 16 << 20


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and further stages need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def offsets_of(column: pa.Array) -> np.ndarray:
    """The ends of a column of strings, bytes or lists, from its first row's beginning."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) or pa.types.is_large_list(column.type)
    raw = column.buffers()[1]
    if raw is None or not len(column):
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``most`` bytes of the column, or one row."""
    ends = offsets_of(batch.column(column)).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def gathered(words: pa.Array, ends: np.ndarray, make: Callable[[list[str]], list[bytes]]) -> pa.Array:
    """For each text, its words' values joined; ``ends`` are the texts' ends among ``words``, after a 0 or other beginning."""
    coded = words.dictionary_encode()
    values = pa.array(make(coded.dictionary.to_pylist()), pa.large_binary())
    every = values.take(coded.indices)
    at = np.ascontiguousarray(offsets_of(every).astype(np.int64)[ends - ends[0]])
    data = every.buffers()[2]
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), data if data is not None else pa.py_buffer(b"")])


#: White space of Unicode, as patterns of tokenizers have it: the bytes of ASCII, then those of longer characters in UTF-8. Fixed values.
_ASCII_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LONG_BLANK = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


_ASCII_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def blank_runs(texts: pa.Array, marks: bytes = b"", never: bytes = b"") -> tuple[pa.Array, np.ndarray]:
    """The texts cut before each run of white space: all parts, and after a 0 the texts' ends among them.

    They are also cut before each of the ``marks`` that follows a letter of ASCII, and not before a run that begins with one of ``never``. Only bytes are looked at; the parts share the texts' buffer.
    """
    at = offsets_of(texts).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: at[-1]] if raw is not None else np.zeros(0, np.uint8)
    blank = _ASCII_BLANK[data]
    high = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    for c in _LONG_BLANK if len(high) else ():
        hit = high[high + len(c) <= len(data)]
        for k, b in enumerate(c):
            hit = hit[data[hit + k] == b]
        for k in range(len(c)):
            blank[hit + k] = True
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    if marks:
        begins[1:] |= np.isin(np.arange(256), list(marks))[data[1:]] & _ASCII_LETTER[data[:-1]]
    if never:
        begins &= ~np.isin(np.arange(256), list(never))[data]
    begins[: at[0]] = False
    begins[at[:-1][at[:-1] < at[1:]]] = True  # a text's beginning
    cuts = np.append(np.flatnonzero(begins), at[-1]).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), raw if raw is not None else pa.py_buffer(b"")])
    return parts, np.searchsorted(cuts[:-1], at)
