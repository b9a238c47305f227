"""Python values of Arrow columns, without a scalar object for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def values(column: pa.Array) -> list:
    """What ``to_pylist`` gives, faster for numbers, truth values, texts and bytes; equal texts are one object."""
    kind = column.type
    if pa.types.is_string(kind):
        coded = column.dictionary_encode(null_encoding="encode")
        texts = coded.dictionary.to_pylist()
        return [texts[i] for i in coded.indices.to_numpy(zero_copy_only=False).tolist()]
    if pa.types.is_binary(kind):
        if not len(column):
            return []
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
        whole = memoryview(column.buffers()[2] or b"")
        out = [bytes(whole[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
    elif pa.types.is_integer(kind) or pa.types.is_boolean(kind):
        full = column.fill_null(False if pa.types.is_boolean(kind) else 0) if column.null_count else column
        out = full.to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    if column.null_count:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[i] = None
    return out
