from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 1 << 32


def stable_shard(key: Column | str, shards: int) -> Column:
    """``md5(key) mod shards``: the same bucket for a key on every run and system.

    The 128-bit digest does not fit a BIGINT, so it is folded in four 32-bit
    words, each step staying below 2^63.
    """
    if not 1 <= shards < 1 << 31:
        raise ValueError("shards must be between 1 and 2^31 - 1")
    digest = F.md5(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))
    rest = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        rest = (rest * F.lit(_WORD) + word) % F.lit(shards)
    return rest
