"""Mixing sources to target weights.

The words of a source, document after document, are cut into blocks of a fixed length.
Every output shard draws how many of its slots each source gets; the k-th slot of a source
takes the block to which a pseudorandom permutation maps k, epoch by epoch, so no block is
taken again before every block of its source was.  Blocks and slots meet in a join by
(source, index).

The shards' draws are multinomial, conditioned on the totals of the mix: all slots of all
sources are dealt to the shards by one pseudorandom permutation and counted there.  Free draws
would miss the target of a small source by their own noise; these miss it by less than a block.
From the counts on, a shard needs nothing but its own numbers: where its slots of each source
begin, which blocks they take and in which order it writes them.

Only DataFrame functions are used.  A permutation of n numbers that needs no table is the
swap-or-not network: each round pairs x with (key - x) mod n and swaps the pair or not by a
hash bit that both share.

Defined cases: a null text has no words; a null source is a source of its own and comes
last; documents without words keep their row and give nothing; repeated rows are documents
of their own; rows that tie in order are equal in every column that decides; an empty table
gives no rows; other columns play no part, whatever their names.  The result depends on the
rows only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.functions.text import let
from bibliomill.llm.common import WORD, broadcast_up_to, cut_lineage, shuffle_width

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 32
SHARD_SLOTS = 4096
# Shards whose counts are summed in one go.
SHARD_RANGE = 4096
ROUNDS = 16
# The order inside a shard need only be mixed, nothing is counted by it.
PLACE_ROUNDS = 8
# Slices of the documents of one source; offsets are summed slice by slice.
SLICES = 4096
# Slots made by one row before they are spread.
STRIDE = 8192
SEED = 20_240_229
SPACE = r"[\x20\x09-\x0D]"


def permuted(x: Column, n: Column, key: Column, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """Image of x under a pseudorandom permutation of 0..n-1 chosen by the key."""

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        bit = F.xxhash64(key, r, F.greatest(at, partner)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(at)

    order = F.sequence(F.lit(rounds), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(rounds))
    return F.aggregate(order, x, swap)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, *extra: Column) -> DataFrame:
    """Documents with what decides about them: size, a digest that orders equal ids, and a
    row number fixed by writing the rows."""
    digest = F.xxhash64(F.col("text"))
    return cut_lineage(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "source",
            F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("source_key"),
            word_count(F.col("text")).alias("size"), digest.alias("digest"),
            F.pmod(F.xxhash64(F.col("doc_id"), digest), F.lit(SLICES)).cast("int").alias("slice"), *extra,
        ),
        "sized",
    )


def targets(per_slice: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: its size, target, blocks and slots.

    A source above ``most`` times its size is held there and the excess goes to the others by
    weight.  This ends at one water level: sources are taken by size per weight, and the level
    is the first share that the next source can hold.  The windows without partition run over
    one row per source, never over documents.
    """
    sources = per_slice.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    ranked = sources.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("number") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    everything = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = F.when(F.col("cap") >= left / rest * F.col("weight"), left / rest)
    levelled = ranked.withColumn("level", level).withColumn("level", F.coalesce(F.first("level", ignorenulls=True).over(whole), F.lit(0.0)))
    target = F.least(F.col("cap"), F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight"))
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0)
    done = (
        levelled.withColumn("target", target)
        .withColumn("blocks", blocks)
        .withColumn("slots", F.least(slots.cast("long"), F.col("blocks") * most))
        .withColumn("first_slot", F.sum("slots").over(Window.orderBy("number")) - F.col("slots"))
        .withColumn("all_slots", F.sum("slots").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return done.select("source_key", "source", "number", "source_size", "target", "blocks", "slots", "first_slot", "all_slots")


def draws(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """How many slots each output shard gives each source: ``shard, number, n``.

    The slots of all sources are dealt to the places of all shards by one permutation, which
    makes the counts of a shard a multinomial draw conditioned on the totals.
    """
    some = sources.where("slots > 0").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {STRIDE}"))))
    spread = some.repartition(shuffle_width(sources.sparkSession), "number", "step")
    start = F.col("step") * STRIDE
    k = spread.withColumn("k", F.explode(F.sequence(start, F.least(start + STRIDE, F.col("slots")) - 1)))
    place = permuted(F.col("first_slot") + F.col("k"), F.col("all_slots"), F.lit(seed), inverse=True)
    return k.select(place.alias("place"), "number").groupBy(F.expr(f"place div {SHARD_SLOTS}").alias("shard"), "number").agg(F.count(F.lit(1)).alias("n"))


def slots(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: ``place, number, epoch, block`` of every slot.

    A shard's slots of a source continue where the shard before it stopped; the k-th slot of a
    source takes, in the epoch k div blocks, the block to which that epoch's permutation maps
    k mod blocks.  ``place`` counts through all shards; within a shard the sources are mixed.
    Starts are summed range by range of shards, so that a source with many shards fills many
    tasks.
    """
    drawn = cut_lineage(draws(sources, seed).withColumn("range", F.expr(f"shard div {SHARD_RANGE}")), "draws")
    ranges = drawn.groupBy("number", "range").agg(F.sum("n").alias("all"))
    base = ranges.select("number", "range", (F.sum("all").over(Window.partitionBy("number").orderBy("range")) - F.col("all")).alias("base"))
    earlier = Window.partitionBy("number", "range").orderBy("shard")
    shard = Window.partitionBy("shard")
    dealt = (
        drawn.withColumn("earlier", F.sum("n").over(earlier) - F.col("n"))
        .join(base.hint("merge"), ["number", "range"])
        .withColumn("before", F.sum("n").over(shard.orderBy("number")) - F.col("n"))
        .withColumn("held", F.sum("n").over(shard))
        .join(broadcast_up_to(sources.select("number", "source_key", "blocks"), 100_000), "number")
        .repartition(shuffle_width(sources.sparkSession), "shard", "number")
    )
    one = dealt.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("k", F.col("base") + F.col("earlier") + F.col("i"))
    at = permuted(F.col("before") + F.col("i"), F.col("held"), F.xxhash64(F.lit(seed), F.col("shard")), rounds=PLACE_ROUNDS)
    epoch = F.expr("k div blocks")
    block = permuted(F.expr("k % blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), F.col("source_key"), epoch))
    return one.select((F.col("shard") * SHARD_SLOTS + at).alias("place"), "number", epoch.alias("epoch"), block.alias("block"))


def _parts(rows: DataFrame, per_slice: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """Each document's share of each block of its source: row, number, block, lo, words."""
    first = per_slice.select("source_key", "slice", (F.sum("words").over(Window.partitionBy("source_key").orderBy("slice")) - F.col("words")).alias("base"))
    running = Window.partitionBy("source_key", "slice").orderBy("doc_id", "digest", "row")
    placed = (
        rows.where("size > 0")
        .withColumn("before", F.sum("size").over(running) - F.col("size"))
        .join(first.hint("merge"), ["source_key", "slice"])
        .join(broadcast_up_to(sources.select("source_key", "number"), 100_000), "source_key")
        .select("row", "number", "size", (F.col("base") + F.col("before")).alias("start"))
    )
    end = F.col("start") + F.col("size")
    cut = placed.select(
        "row", "number", "start", end.alias("end"), F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block")
    )
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("end"), (F.col("block") + 1) * block)
    return cut.select("row", "number", "block", (lo - F.col("start")).alias("lo"), (hi - lo).alias("words"))


def mix(rows: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """What each slot takes of a document (row, epoch, lo, words, place) and the table of sources."""
    per_slice = cut_lineage(rows.groupBy("source_key", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "slices")
    sources = cut_lineage(targets(per_slice, block=block), "sources")
    # the blocks grow with the corpus, but Spark sees only the few sources they come from
    taken = _parts(rows, per_slice, sources, block).join(slots(sources, seed).hint("merge"), ["number", "block"])
    return taken.select("row", "epoch", "lo", "words", "place"), sources


def mix_report(docs: DataFrame) -> DataFrame:
    """How many words the mix takes of each document, how many slots those fill, and the first
    of their places with its shard (null where nothing is taken)."""
    rows = sized(docs)
    parts, sources = mix(rows)
    taken = parts.groupBy("row").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("slots"), F.min("place").alias("first_place"))
    known = broadcast_up_to(sources.select("source_key", "source_size", "target"), 100_000)
    return (
        rows.select("row", "doc_id", "size", "source_key")
        .join(taken, "row", "left")
        .join(known, "source_key")
        .select(
            "doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "slots")],
            F.expr(f"first_place div {SHARD_SLOTS}").alias("first_shard"), "first_place",
        )
    )


def _runs(plan: Column) -> Column:
    """``epoch, lo, hi, place`` of the longest stretches of neighbouring blocks taken in one
    epoch; ``place`` is that of the stretch's first block.  ``plan`` is sorted."""
    joined = lambda a, b: (a["epoch"] == b["epoch"]) & (a["lo"] + a["words"] == b["lo"])
    first = F.filter(plan, lambda p, i: (i == 0) | ~joined(F.get(plan, i - 1), p))
    last = F.filter(plan, lambda p, i: (i == F.size(plan) - 1) | ~joined(p, F.get(plan, i + 1)))
    return F.zip_with(
        first, last, lambda a, z: F.struct(a["epoch"].alias("epoch"), a["lo"].alias("lo"), (z["lo"] + z["words"]).alias("hi"), a["place"].alias("place"))
    )


def mixed_documents(docs: DataFrame, places: bool = False) -> DataFrame:
    """The texts of the mix, with the columns of ``docs``.

    A document taken more than once has rows for each time.  A time that takes all of it leaves
    the text unchanged; one that takes only some blocks has a row for each stretch of
    neighbouring blocks, whose text is that part of the document as it stands, without the
    white space around it.  ``places`` adds the shard, the place of the stretch's first block
    and the time (``mix_shard``, ``mix_place``, ``mix_copy``), by which to write the mix in order.
    """
    columns = docs.columns
    kept = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(columns)]
    rows = sized(docs, *kept)
    narrow = rows.select("row", "doc_id", "source", "source_key", "size", "digest", "slice")
    parts, _ = mix(narrow)
    plan = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("epoch", "lo", "words", "place"))).alias("plan"))
    own = {c.lower(): f"own_{i}" for i, c in enumerate(columns)}
    text = F.col(own["text"])
    full = rows.select("row", "size", *[f"own_{i}" for i in range(len(columns))]).join(plan.select("row", _runs(F.col("plan")).alias("runs")).hint("merge"), "row")
    whole = lambda r: (r["lo"] == 0) & (r["hi"] == F.col("size"))
    # words with the white space that follows them
    words = F.when(F.exists("runs", lambda r: ~whole(r)), F.regexp_extract_all(text, F.lit(f"{WORD}{SPACE}*"), F.lit(0)))

    def part(all_words: Column, r: Column) -> Column:
        stretch = F.array_join(F.slice(all_words, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")), "")
        return F.when(whole(r), text).otherwise(F.regexp_replace(stretch, f"{SPACE}+\\z", ""))

    texts = let(words, lambda all_words: F.transform("runs", lambda r: F.struct(r["place"].alias("place"), r["epoch"].alias("epoch"), part(all_words, r).alias("text"))))
    times = full.withColumn("new", F.explode(texts))
    out = []
    for i, c in enumerate(columns):
        if c.lower() == "text":
            out.append(F.col("new.text").alias(c))
        elif c.lower() == "n_chars":
            out.append(F.length("new.text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"own_{i}").alias(c))
    if places:
        out += [F.expr(f"new.place div {SHARD_SLOTS}").alias("mix_shard"), F.col("new.place").alias("mix_place"), F.col("new.epoch").alias("mix_copy")]
    return times.select(*out)
