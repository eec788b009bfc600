"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets. Sources share ``total`` words by weight; a target stops at ``cap`` times its source's size
   and the excess is shared again by weight until none is above.
2. Blocks. Each source is permuted by a seeded hash and cut into BLOCKS blocks of that order. A source
   whose target is r times its size is read floor(r) times whole, and once more up to the fraction
   that is left: the blocks of a fresh permutation in order while they fit, of the next block its BLOCKS
   parts while they fit, of the next part its documents while they fit - all in hash order, so no size is
   preferred. Only the very last document of a source is chosen: the one that brings the sum nearest to
   the target, if one brings it nearer at all.
3. Tree. Every source brings as many exchangeable tokens as blocks are to be read. At each node of a
   binary tree over the output shards the tokens are ranked by a hash and split in proportion to the
   shards on each side: the counts by source follow the multivariate hypergeometric law and add up
   exactly.
4. Draw. In a source, a shard's quota is a run of the permuted block positions, so draws are disjoint;
   mix() deals the draws out by shard and orders each shard by a local hash.

DataFrame functions only. Blocks are hash ranges, so a source that holds most rows is spread over as
many tasks as it has blocks; only sums by (source, block) meet. The plan has a row a block (sources * BLOCKS,
whatever the documents); where it is counted to be under SMALL rows it is broadcast, so documents are read
and drawn in place, else it is joined. Driver state: those counts.

Null or empty texts have size 0 and ride along with their block; very long texts count whole. A null source
is a source of its own, last in order. Repeated rows each count, and of rows that are alike in all that is
hashed (doc_id and text) any may be the one drawn once more. Ties of hashes go by doc_id, then by text. An
empty table gives an empty result. Columns of docs that are not named in ``keep`` are ignored; kept ones
named like an output are replaced. Reruns agree: all draws hash doc_id, text and the seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import cut, word_count

BLOCKS = 256
#: Rows of a plan up to which it is broadcast.
SMALL = 100_000
WEIGHTS = (5.0, 2.0, 1.0)


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source, source_size) -> source, source_size, weight, target.

    Filling to caps has a closed form. Order sources by cap / weight; the capped ones are a prefix:
    source i is capped if, after all before it are, its weighted share of the rest reaches its cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    given = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn(
        "weight", F.element_at(given, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    step = (
        weighed.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_w", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_w"))
        .withColumn("_full", F.col("_level") * F.col("weight") >= F.col("_cap"))
        .withColumn("_final", F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("weight"), "_level"))).over(everything)["_level"])
    )
    return step.select(
        "source", "source_size", "weight",
        F.when(F.col("_full") | F.col("_final").isNull(), F.col("_cap"))
        .otherwise(F.least("_cap", F.col("weight") * F.col("_final")))
        .alias("target"),
    )


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, quota) -> source, shard, blocks: how many of its blocks each shard draws.

    One row a token; their number is blocks * cap * sources, set by parameters and not by the rows.
    """
    tokens = (
        quotas.select("source", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("_i"))
        .withColumn("_lo", F.lit(0))
        .withColumn("_hi", F.lit(shards))
    )
    for level in range(max(0, (shards - 1).bit_length())):
        node = Window.partitionBy("_lo", "_hi")
        ranked = node.orderBy(F.xxhash64("source", "_i", F.lit(seed), F.lit(level)), "source", "_i")
        mid = F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("int")
        left = F.row_number().over(ranked) <= F.round(
            F.count(F.lit(1)).over(node) * (mid - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        )
        splits = F.col("_hi") - F.col("_lo") > 1
        tokens = tokens.withColumn("_left", left).select(
            "source", "_i",
            F.when(splits & ~F.col("_left"), mid).otherwise(F.col("_lo")).alias("_lo"),
            F.when(splits & F.col("_left"), mid).otherwise(F.col("_hi")).alias("_hi"),
        )
    return tokens.groupBy("source", F.col("_lo").alias("shard")).agg(F.count(F.lit(1)).alias("blocks"))


def _in_order(pieces: DataFrame, of: list[str], order: list) -> DataFrame:
    """Pieces in order while they fit in _rest: adds _whole, and for the first that does not the _room left for it."""
    so_far = F.sum("_words").over(Window.partitionBy(*of).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("_upto") - F.col("_words")
    return (
        pieces.withColumn("_upto", so_far)
        .withColumn("_whole", (F.col("_rest") > 0) & (F.col("_upto") <= F.col("_rest")))
        .withColumn("_room", F.when((F.col("_rest") > 0) & ~F.col("_whole") & (before < F.col("_rest")), F.col("_rest") - before))
        .drop("_upto")
    )


def _bounded(df: DataFrame) -> DataFrame:
    """A written table, marked to be broadcast if it has at most SMALL rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def _last_documents(lean: DataFrame, block_plan: DataFrame, parts: DataFrame) -> DataFrame:
    """source, _at, _tie, _n, _of_n: documents that are drawn once more by themselves, _n rows out of _of_n alike.

    Those are the documents of each source's broken part that fit, and the last one, the best of all not drawn.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    placed = lean.join(block_plan, same("source", "_source") & (F.col("_block") == F.col("_of"))).drop("_source", "_of")
    placed = placed.join(parts, F.col("_room").isNotNull() & same("source", "_ps") & (F.col("_part") == F.col("_pp")), "left")
    inside = Window.partitionBy("source").orderBy("_at", "doc_id", "_tie", "_row").rowsBetween(Window.unboundedPreceding, 0)
    broken = placed.where("_left is not null").select("source", "_row", "_at", "_tie", "size", "_left", F.sum("size").over(inside).alias("_upto"))
    fits = cut(broken.where("_upto <= _left").select("source", "_row", "_at", "_tie", "size"))
    # What is still open: the room of the broken block without its whole parts and those documents.
    whole = parts.groupBy(F.col("_ps").alias("source")).agg(F.sum(F.when(F.col("_all"), F.col("_part_words"))).alias("_words"))
    took = whole.unionByName(fits.groupBy("source").agg(F.sum("size").alias("_words"))).groupBy(F.col("source").alias("_s")).agg(F.sum("_words").alias("_took"))
    room = block_plan.where("_room is not null").select("_source", "_room")
    open_ = room.join(took, same("_source", "_s"), "left").select(F.col("_source").alias("_s"), (F.col("_room") - F.coalesce("_took", F.lit(0))).alias("_open"))
    rest = placed.where("not _whole and not coalesce(_all, false)").join(fits.select("_row"), "_row", "left_anti")
    near = rest.join(_bounded(open_), same("source", "_s")).withColumn("_off", F.abs(F.col("size") - F.col("_open"))).where("_off < _open")
    last = near.groupBy("source").agg(F.min(F.struct("_off", "_at", "doc_id", "_tie", "_row", "size")).alias("_b")).select("source", "_b._row", "_b._at", "_b._tie", "_b.size")
    drawn = fits.unionByName(last).groupBy("source", "_at", "_tie").agg(F.count(F.lit(1)).alias("_n"))
    alike = lean.select(F.col("source").alias("_s"), F.col("_at").alias("_a"), F.col("_tie").alias("_t"))
    met = drawn.join(alike, same("source", "_s") & (F.col("_at") == F.col("_a")) & (F.col("_tie") == F.col("_t")))
    return met.groupBy("source", "_at", "_tie").agg(F.first("_n").alias("_n"), F.count(F.lit(1)).alias("_of_n"))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 16,
    blocks: int = BLOCKS,
    seed: int = 17,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row for each input row: doc_id, source, size, source_size, target, draws.

    draws: array of (pass, shard, position), one entry for each time the document is taken; a shard's
    documents come in the order of their positions. Columns of docs named in ``keep`` ride along; then the
    documents are read a second time instead of the lean table of sizes.
    """
    names = [c for c in keep if c not in ("doc_id", "source", "size", "source_size", "target", "draws")]
    own = [f"_c{i}" for i in range(len(names))]
    sized = docs.select(
        "doc_id", "source", *[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)], word_count("text").alias("size"),
        _unit(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")), F.lit(seed)).alias("_at"),
        F.xxhash64("text", F.lit(seed)).alias("_tie"),
    )
    inner = F.col("_at") * blocks
    sized = sized.withColumn("_block", F.floor(inner).cast("int")).withColumn("_part", F.floor((inner - F.floor(inner)) * blocks).cast("int"))
    lean = cut(sized.drop(*own).withColumn("_row", F.monotonically_increasing_id()))
    by_part = cut(lean.groupBy("source", "_block", "_part").agg(F.sum("size").alias("_words")))
    by_block = cut(by_part.groupBy("source", "_block").agg(F.sum("_words").alias("_words")))
    targets = source_targets(by_block.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, cap)

    # Which blocks the broken pass reads: the first ones of a fresh permutation.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    by_hash = [F.xxhash64("source", "_block", F.lit(seed + 1)), F.col("_block")]
    t = targets.withColumnRenamed("source", "_s")
    fitted = (
        by_block.join(t, F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_passes", F.floor(rate).cast("int"))
        .withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("source")))
    )
    partly_read = F.col("_whole") | F.col("_room").isNotNull()
    order = Window.partitionBy("source").orderBy(*by_hash)
    ordered = cut(_in_order(fitted, ["source"], by_hash).withColumn("_pos", F.row_number().over(order)))
    quotas = ordered.groupBy("source").agg(
        (F.max("_passes") * F.max("_n") + F.count_if(partly_read)).cast("int").alias("quota")
    )
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        splitting_tree(quotas.where("quota > 0"), shards, seed)
        .withColumn("_end", F.sum("blocks").over(upto))
        .select(
            F.col("source").alias("_s"), "shard",
            F.explode(F.sequence(F.col("_end") - F.col("blocks") + 1, F.col("_end"))).alias("_d"),
        )
    )
    # Pass p of a source of n blocks makes draws (p - 1) * n + 1 to p * n, in block order.
    reads = F.col("_passes") + F.when(partly_read, 1).otherwise(0)
    drawn = (
        ordered.where(reads > 0)
        .select("source", "_block", "_n", "_pos", "_passes", F.explode(F.sequence(F.lit(1), reads)).alias("pass"))
        .withColumn("_draw", (F.col("pass") - 1) * F.col("_n") + F.col("_pos"))
        .join(runs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_draw") == F.col("_d")))
        .groupBy(F.col("source").alias("_s"), F.col("_block").alias("_b"))
        .agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("_draws"))
    )
    whole_source = Window.partitionBy("source")
    block_plan = _bounded(
        ordered.join(drawn, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left")
        .withColumn("_draws", F.coalesce("_draws", F.array().cast("array<struct<pass:int,shard:int>>")))
        .select(
            F.col("source").alias("_source"), F.col("_block").alias("_of"), "source_size", "target", "_whole", "_room",
            F.slice("_draws", F.lit(1), F.col("_passes")).alias("_fewer"), "_draws",
            # The draw that the broken block's documents and the last one share.
            F.max(F.when(F.col("_room").isNotNull(), F.element_at("_draws", -1))).over(whole_source).alias("_more"),
        )
    )
    broken = block_plan.where("_room is not null").select("_source", "_of", F.col("_room").alias("_rest"))
    parts = by_part.join(broken, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_of"))).drop("_of")
    parts = _in_order(parts, ["source"], ["_part"])
    parts = _bounded(parts.select(F.col("source").alias("_ps"), F.col("_part").alias("_pp"), F.col("_whole").alias("_all"), F.col("_room").alias("_left"), F.col("_words").alias("_part_words")))
    single = _bounded(_last_documents(lean, block_plan, parts).select(F.col("source").alias("_ls"), F.col("_at").alias("_la"), F.col("_tie").alias("_lt"), "_n", "_of_n"))

    planned = (
        (sized if own else lean)
        .join(block_plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_of")))
        .join(parts.drop("_part_words"), F.col("_room").isNotNull() & F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_part") == F.col("_pp")), "left")
        .join(single, F.col("source").eqNullSafe(F.col("_ls")) & (F.col("_at") == F.col("_la")) & (F.col("_tie") == F.col("_lt")), "left")
    )
    once_more = F.concat("_fewer", F.array("_more"))
    by_block_alone = F.when(F.col("_room").isNull() | F.coalesce("_all", F.lit(False)), F.col("_draws")).otherwise(F.col("_fewer"))
    position = lambda d: F.xxhash64("doc_id", d["pass"], F.lit(seed + 2))
    spelled = F.transform("_taken", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), position(d).alias("position")))
    columns = ["doc_id", "source", *[F.col(o).alias(c) for c, o in zip(names, own)], "size", "source_size", "target", spelled.alias("draws")]
    taken = planned.withColumn("_taken", F.when(F.col("_n") == F.col("_of_n"), once_more).otherwise(by_block_alone))
    if single.where("_n < _of_n").isEmpty():
        return taken.select(columns)
    # Of rows that are alike, some are drawn once more and some are not: they alone are numbered.
    number = F.row_number().over(Window.partitionBy("source", "_at", "_tie").orderBy("size"))
    some = planned.where("_n < _of_n").withColumn("_taken", F.when(number <= F.col("_n"), once_more).otherwise(by_block_alone))
    return taken.where("_n is null or _n = _of_n").select(columns).unionByName(some.select(columns))


def slice_of(position: str) -> Column:
    """The first 12 bits of a position: slices follow each other in the order of positions."""
    return F.shiftright(position, 52)


def mix(docs: DataFrame, keep: Sequence[str] = (), shards: int = 16, **options) -> DataFrame:
    """The mixture itself: a row for each time a document is taken, dealt out by shard and locally shuffled.

    doc_id, source, kept columns, size, source_size, target, pass, shard, position. A shard is dealt out in
    slices of its positions, so that it may be larger than a task; a partition holds whole slices, in the order
    of shard and position.
    """
    keep = [c for c in keep if c not in ("pass", "shard", "position")]
    drawn = plan_mix(docs, keep=keep, shards=shards, **options)
    drawn = drawn.select(*[F.col(f"`{c}`") for c in drawn.columns if c != "draws"], F.inline("draws"))
    return drawn.repartition("shard", slice_of("position")).sortWithinPartitions("shard", "position", "doc_id")
