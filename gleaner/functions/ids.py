"""Content-derived ids: BLAKE2b over the printed forms of the parts, as hexadecimal digits."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DOC_ID = CHUNK_ID = 16


def stable_hash(*parts: object, length: int = 64) -> str:
    """Each part contributes its printed form and a unit separator, so ("ab", "c") and ("a", "bc") differ."""
    h = hashlib.blake2b(digest_size=32)
    for p in parts:
        h.update(repr(p).encode("utf-8", "surrogatepass") + b"\x1f")
    return h.hexdigest()[:length]


def stable_id(*columns: Column | str, length: int = DOC_ID) -> Column:
    """The hash of several columns, one Arrow batch at a time; null values take part as None."""

    @F.arrow_udf("string")
    def ids(*arrays: pa.Array) -> pa.Array:
        return pa.array([stable_hash(*row, length=length) for row in zip(*(a.to_pylist() for a in arrays))], type=pa.string())

    return ids(*columns)
