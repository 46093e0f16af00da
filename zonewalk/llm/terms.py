"""Terms of texts: maximal runs of letters, digits if wanted, and all characters beyond ASCII; only A-Z in lower case."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from zonewalk.llm.common import lower_words


def _blanked(digits: bool) -> bytes:
    """For a byte, itself if it belongs to terms (in lower case), else a blank."""
    inside = lambda b: b >= 0x80 or chr(b).isalpha() or (digits and chr(b).isdigit())
    return bytes(ord(chr(b).lower()) if b < 0x80 and inside(b) else b if inside(b) else 0x20 for b in range(256))


WITH_DIGITS, LETTERS = _blanked(True), _blanked(False)


def split(texts: pa.Array, kept: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts (large strings without nulls) end to end, and how many each has. kept: WITH_DIGITS or LETTERS.

    Bytes of a character beyond ASCII are all 0x80 or more, so blanking bytes leaves valid UTF-8 of the same length.
    """
    if not len(texts):
        return pa.array([], pa.large_binary()).dictionary_encode(), np.zeros(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = memoryview(data)[ends[0] : ends[-1]].tobytes() if data is not None else b""
    blanked = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data.translate(kept))])
    flat, sizes = lower_words(blanked)
    return flat.dictionary_encode(), sizes
