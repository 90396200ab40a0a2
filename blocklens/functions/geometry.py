"""Functions that the JVM's expressions can't give: Arrow-batched, one array at a time."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def crc32c_table() -> np.ndarray:
    """The Castagnoli polynomial, reflected."""
    table = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        table = np.where(table & np.uint64(1), (table >> np.uint64(1)) ^ np.uint64(0x82F63B78), table >> np.uint64(1))
    return table


def crc32c_bytes(raw: bytes, table: list[int]) -> int:
    crc = 0xFFFFFFFF
    for b in raw:
        crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@F.pandas_udf(LongType())
def crc32c(raw: pd.Series) -> pd.Series:
    table = crc32c_table().tolist()
    return raw.map(lambda x: None if x is None else crc32c_bytes(bytes(x), table)).astype("Int64")


@F.pandas_udf(LongType())
def deflated_size(raw: pd.Series) -> pd.Series:
    """Size of a cluster's payload as a raw deflate stream."""
    def size(x: bytes) -> int:
        c = zlib.compressobj(9, zlib.DEFLATED, -12)
        return len(c.compress(bytes(x)) + c.flush())

    return raw.map(lambda x: None if x is None else size(x)).astype("Int64")
