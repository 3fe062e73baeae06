"""A broadcast bitmap that lets only rows through whose hash may be among given ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cells for each hash, and the bounds of all: 16 MB of bits at most. A crowded bitmap lets
# more rows through; rows are joined exactly afterwards, so results don't depend on it.
CELLS, LEAST, MOST = 8, 1 << 16, 1 << 27

# Bits in one value of bitmap_construct_agg.
BITMAP = 32_768


def may_be_among(hashes: DataFrame, column: str, rows: int):
    """A function from a column of hashes to whether they may be among the `rows` values
    of `column` in `hashes`."""
    cells = min(MOST, max(LEAST, 1 << (CELLS * max(1, rows) - 1).bit_length()))
    place = F.col(column).bitwiseAND(cells - 1) + 1  # buckets count from one
    found = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(cells // 8, np.uint8)
    for r in found.toLocalIterator():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["bucket"] - 1) * BITMAP // 8 :][: len(own)] = own
    shared = hashes.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def among(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = shared.value
        for hashed in batches:
            at = hashed.to_numpy(zero_copy_only=False).astype(np.int64) & (len(bits) * 8 - 1)
            yield pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    def test(hash_: Column) -> Column:
        return among(hash_)

    return test
