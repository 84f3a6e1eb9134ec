"""Words of whole Arrow arrays of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import pieces

#: Bytes as they count: A-Z lower-cased, other ASCII letters, digits and all non-ASCII kept.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text array, and the number of words of each text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pa.concat_arrays([texts])  # offsets from zero
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    clean = (data.to_pybytes() if data else b"").translate(_TABLE)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(clean))
    split = pc.split_pattern(plain, " ")
    flat, bounds = split.flatten(), split.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False).astype(np.int64))])
    return flat.filter(full), np.diff(before[bounds - bounds[0]])


def shards(batches: Iterator[pa.RecordBatch], text_column: int, n_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in shards of about ``n_bytes`` of text."""
    held, size = [], 0
    for batch in batches:
        for part in pieces(batch, text_column, n_bytes):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(text_column))).as_py() or 0
            if size >= n_bytes // 2:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)
