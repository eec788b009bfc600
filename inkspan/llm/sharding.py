"""Rendezvous hashing of record keys over weighted shards. DataFrame functions only.

Every record scores every shard with a hash of (key, shard) and goes to the best one, so adding a
shard takes records only into the new shard, and removing one moves only its own records.

Nulls: a null key is hashed as the empty string. Equal keys always share a shard, so repeated rows do; ties of
scores go to the lower id, ties of positions in a shard by the order given. Very long texts only weigh as much
as what the caller hashes or sizes of them. Empty input gives an empty result. Extra columns are kept, whatever
their names; columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 52 bits of a digest make an exactly representable number in [0, 1).
HEX_DIGITS = 13
UNIT = float(16**HEX_DIGITS)
#: Ranges of the order hash a shard's rows are numbered in; bounds shards * SLICES offset rows.
SLICES = 256
#: Offset rows up to which they are broadcast.
SMALL = 100_000


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts' text alone, the same in any engine with MD5."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(UNIT)


def rendezvous(key: Column, weights: Sequence[float] | Mapping[int, float]) -> Column:
    """The shard of a key: the least exponential arrival -ln(u) / weight, ties to the lower id."""
    pairs = dict(enumerate(weights)) if not isinstance(weights, Mapping) else dict(weights)
    if not pairs or any(not w > 0 or math.isinf(w) for w in pairs.values()):
        raise ValueError("weights must be positive and finite")
    text = F.coalesce(key.cast("string"), F.lit(""))
    arrivals = [
        F.struct((-F.ln(unit_hash(text, F.lit(str(i)))) / F.lit(float(w))).alias("at"), F.lit(int(i)).alias("id"))
        for i, w in sorted(pairs.items())
    ]
    return F.array_min(F.array(*arrivals))["id"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], grown: float | None = None) -> DataFrame:
    """Adds shard, and grown_shard: the shard if one more of weight ``grown`` joined (else null).

    The grown placement needs only the new shard's score against the winner, not a second contest.
    """
    n = len(weights)
    out = df.withColumn("shard", rendezvous(F.col(key), weights))
    if grown is None:
        return out.withColumn("grown_shard", F.lit(None).cast("int"))
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    own = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("shard") + 1)
    held = -F.ln(unit_hash(text, F.col("shard").cast("string"))) / own
    new = -F.ln(unit_hash(text, F.lit(str(n)))) / F.lit(float(grown))
    return out.withColumn("grown_shard", F.when(new < held, F.lit(n)).otherwise(F.col("shard")).cast("int"))


def number_within_shards(df: DataFrame, order: Sequence[str], spread: str, shards: int) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, ordered by ``spread`` (a number in [0, 1)) and ``order``.

    A shard is numbered in SLICES ranges of the spread value, so no task sorts a whole shard; only
    the slices' counts meet, and those are shards * SLICES rows whatever the input. df is read twice.
    """
    from pyspark.sql import Window

    # Inner names that no column of df has.
    slice_, base, count = (next(f"_{n}{i or ''}" for i in range(len(df.columns) + 1) if f"_{n}{i or ''}" not in df.columns) for n in ("slice", "base", "count"))
    cut = df.drop("slot").withColumn(slice_, F.floor(F.col(spread) * SLICES).cast("int"))
    counts = cut.groupBy("shard", slice_).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy("shard").orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", slice_, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    offsets = F.broadcast(offsets) if shards * SLICES <= SMALL else offsets
    inside = Window.partitionBy("shard", slice_).orderBy(spread, *order)
    return (
        cut.join(offsets, ["shard", slice_])
        .withColumn("slot", (F.row_number().over(inside) - 1 + F.col(base)).cast("long"))
        .drop(slice_, base)
    )
