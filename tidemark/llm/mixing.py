"""Mix sources to target weights: exact block quotas split over output shards by multivariate-hypergeometric draws.

A source's documents fall into blocks by a hash, so the block order is a random
permutation of the source. Its target is some whole epochs of all blocks and a part
of one more; that fixes how many block draws (slots) the source contributes. A
binary tree over the output shards then splits the slots: each node draws how many
slots of every source go left, sources in turn, so that both sides get their exact
share of slots. A leaf's quotas are consecutive, hence disjoint, slots of each
source. Documents are shuffled inside their shard by a hash.

Only sizes and hashes of documents are shuffled, never texts. Tables per source, and
per block of some ``BLOCK_DOCS`` documents, carry all the arithmetic; a source that holds
a third of all rows is many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import word_count
from tidemark.session import materialize

SEED = 20
MAX_EPOCHS = 3
BLOCK_DOCS = 1024
SHARD_WORDS = 1 << 23
WEIGHTS = 3


def _with_targets(sources: DataFrame) -> DataFrame:
    """Sources (source, source_size, ...) with weight and target: shares of all words by weight, none above its cap.

    The caps are reached in the order of cap per weight; before each source the rest of
    the words over the rest of the weights is the level, and the first source whose cap
    is not below it fixes the level for all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % WEIGHTS + 1).withColumn(
        "cap", MAX_EPOCHS * F.col("source_size")
    )
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("rest"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest_weight"),
    )
    free = F.col("rest") * F.col("weight") <= F.col("cap") * F.col("rest_weight")
    first = F.first(F.when(free, F.struct("rest", "rest_weight")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, 0))
    level = rest.withColumn("level", first)
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.col("level.rest") * F.col("weight") / F.col("level.rest_weight")
    )
    return level.withColumn("target", target).drop("rest", "rest_weight", "level", "cap")


def _draw(total: Column, marked: Column, taken: Column, uniform: Column) -> Column:
    """Hypergeometric draw: how many of ``marked`` among ``total`` are in a sample of ``taken``, by inverting the distribution."""
    low = F.greatest(F.lit(0).cast("long"), taken - (total - marked))
    high = F.least(marked, taken)
    support = F.sequence(low, high)

    def step(k: Column) -> Column:  # log weight of k + 1 over that of k
        up = (marked - k).cast("double") * (taken - k)
        down = (k + 1).cast("double") * (total - marked - taken + k + 1)
        return F.when((up > 0) & (down > 0), F.ln(up) - F.ln(down)).otherwise(F.lit(0.0))

    peak = F.aggregate(
        support,
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("top")),
        lambda s, k: F.struct((s["w"] + step(k)).alias("w"), F.greatest(s["top"], s["w"]).alias("top")),
        lambda s: s["top"],
    )
    mass = F.aggregate(
        support,
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), peak.alias("top")),
        lambda s, k: F.struct((s["w"] + step(k)).alias("w"), (s["sum"] + F.exp(s["w"] - s["top"])).alias("sum"), s["top"].alias("top")),
        lambda s: F.struct(s["sum"].alias("sum"), s["top"].alias("top")),
    )
    below = F.aggregate(
        support,
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), low.alias("k"), mass.alias("m")),
        lambda s, k: F.struct(
            (s["w"] + step(k)).alias("w"),
            (s["sum"] + F.exp(s["w"] - s["m"]["top"])).alias("sum"),
            # the smallest k whose cumulative weight reaches the uniform
            F.when(s["sum"] < uniform * s["m"]["sum"], k).otherwise(s["k"]).alias("k"),
            s["m"].alias("m"),
        ),
        lambda s: s["k"],
    )
    return below


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, source, slots): exact quotas (source, slots) dealt to shards of equal slot counts (floor or ceiling at each split)."""
    level = quotas.where("slots > 0").select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "source", "slots")
    depth = 0
    while 1 << depth < shards:
        node = level.groupBy("lo", "hi").agg(
            F.sort_array(F.collect_list(F.struct(F.col("source").alias("s"), F.col("slots").alias("c")))).alias("parts"), F.sum("slots").alias("total")
        )
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = F.floor(F.col("total") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        node = node.withColumn("mid", mid).withColumn("left", left)
        uniform = lambda s: (F.pmod(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), s), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
        empty = F.filter(
            F.array(F.struct(F.col("parts")[0]["s"].alias("s"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("k"))), lambda x: F.lit(False)
        )

        def deal(state: Column, part: Column) -> Column:
            k = _draw(state["total"], part["c"], state["left"], uniform(part["s"]))
            drawn = F.concat(state["out"], F.array(F.struct(part["s"].alias("s"), part["c"].alias("c"), k.alias("k"))))
            # the draw just made is read back, so that it is computed once
            return F.transform(
                F.array(drawn),
                lambda out: F.struct(
                    (state["total"] - part["c"]).alias("total"), (state["left"] - F.element_at(out, -1)["k"]).alias("left"), out.alias("out")
                ),
            )[0]

        start = F.struct(F.col("total").alias("total"), F.col("left").alias("left"), empty.alias("out"))
        dealt = node.select("lo", "mid", "hi", F.explode(F.aggregate("parts", start, deal, lambda s: s["out"])).alias("d"))
        sides = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("d.s").alias("source"), F.col("d.k").alias("slots")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.col("d.s").alias("source"), (F.col("d.c") - F.col("d.k")).alias("slots")),
        )
        whole = level.where("hi - lo = 1")
        level = dealt.where("hi - lo > 1").select(F.explode(sides).alias("x")).select("x.*").where("slots > 0").unionByName(whole)
        level = materialize(level)
        depth += 1
    return level.select(F.col("lo").alias("shard"), "source", "slots")


def _edge_picks(docs: Column, want: Column) -> Column:
    """Which of a block's documents (largest first) to take for some ``want`` words: all that fit, then the smallest left if that is nearer."""
    fits = F.aggregate(
        docs,
        F.struct(want.alias("rest"), F.array().cast("array<boolean>").alias("take")),
        lambda s, d: F.struct(
            F.when(d["size"] <= s["rest"], s["rest"] - d["size"]).otherwise(s["rest"]).alias("rest"),
            F.concat(s["take"], F.array(d["size"] <= s["rest"])).alias("take"),
        ),
    )
    return F.transform(
        F.array(fits),
        lambda f: F.transform(
            f["take"],
            lambda t, i: t
            | (
                (i + 1 == F.size(f["take"]) - F.coalesce(F.array_position(F.reverse(f["take"]), F.lit(False)), F.lit(0)) + 1)
                & (F.get(docs, i)["size"] < 2 * f["rest"])
            ),
        ),
    )[0]


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    shards: int | None = None,
    seed: int = SEED,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, shards (one entry per copy), taken, order_key.

    A size is a number of words; null and empty texts have 0 and are taken like
    any other document of their block, adding nothing. Sources in code point order, null last, weigh 1, 2, 3, 1, ...
    and share the words of the whole table by weight; a target above
    ``MAX_EPOCHS`` times its source is cut to that, and the rest is shared by weight among the
    others until none is above. Whole documents are taken, each at most ``MAX_EPOCHS``
    times. All choices are hashes of ``seed``, doc_id and text: reruns agree, and repeated
    rows make the same draws as blocks but are each a row. Other columns are ignored; an empty table gives no rows.
    """
    rows = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(text)).alias("key"),
        )
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # one row per source
    sources = materialize(
        _with_targets(totals)
        .withColumn("n_blocks", F.ceil(F.col("n_docs") / block_docs).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    if shards is None:
        words = sources.agg(F.sum("source_size")).first()[0] or 0
        shards = max(1, -(-words // SHARD_WORDS))
    told = sources.select(F.col("source").alias("_source"), "source_size", "target", "n_blocks", "epochs", "part")
    placed = rows.join(told, rows["source"].eqNullSafe(told["_source"])).withColumn("block", F.pmod("key", "n_blocks")).drop("_source")

    # blocks of the last, partial epoch: whole up to the target, one at the edge
    blocks = placed.groupBy("source", "block").agg(
        F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("n_blocks", "epochs", "part")]
    )
    along = Window.partitionBy("source").orderBy("block")
    reach = F.sum("words").over(along)
    blocks = blocks.withColumn("reach", reach).withColumn("start", F.col("reach") - F.col("words"))
    state = F.when(F.col("reach") <= F.col("part"), "whole").when(F.col("start") < F.col("part"), "edge").otherwise("none")
    blocks = materialize(
        blocks.withColumn("state", state)
        .withColumn("nth", F.row_number().over(along) - 1)  # blocks without documents do not count
        .withColumn("n_filled", F.count(F.lit(1)).over(Window.partitionBy("source")))
    )
    slots = blocks.groupBy("source").agg(
        (F.max("epochs") * F.max("n_filled") + F.count(F.when(F.col("state") != "none", 1))).alias("slots")
    )
    quotas = split_quotas(slots, shards, seed)
    upto = Window.partitionBy("source").orderBy("shard")
    ranges = quotas.withColumn("stop", F.sum("slots").over(upto)).withColumn("slot", F.explode(F.sequence(F.col("stop") - F.col("slots"), F.col("stop") - 1)))
    sizes = blocks.select("source", "n_filled").distinct()
    dealt = (
        ranges.select(F.col("source").alias("_s"), "slot", "shard")
        .join(sizes, F.col("_s").eqNullSafe(F.col("source")))
        .select("_s", (F.col("slot") % F.col("n_filled")).alias("_nth"), F.floor(F.col("slot") / F.col("n_filled")).alias("epoch"), "shard")
        .groupBy("_s", "_nth")
        .agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("draws"))
    )
    drawn = materialize(
        blocks.join(dealt, blocks["source"].eqNullSafe(dealt["_s"]) & (blocks["nth"] == dealt["_nth"]), "left").select(
            F.col("source").alias("_source"),
            F.col("block").alias("_block"),
            F.coalesce(F.col("draws.shard"), F.array().cast("array<int>")).alias("draws"),
            F.when(F.col("state") == "edge", F.col("part") - F.col("start")).alias("want"),
        )
    )
    joined = materialize(
        placed.join(drawn, placed["source"].eqNullSafe(drawn["_source"]) & (placed["block"] == drawn["_block"])).select(
            "doc_id", "source", "size", "key", "source_size", "target", "block", "draws", "want"
        )
    )
    whole = joined.where("want IS NULL").select("doc_id", "source", "size", "key", "source_size", "target", F.col("draws").alias("shards"))
    # one block of some block_docs documents per source
    edge = (
        joined.where("want IS NOT NULL")
        .groupBy("source", "block")
        .agg(
            F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "size", "doc_id"))).alias("members"),
            *[F.first(c).alias(c) for c in ("want", "draws", "source_size", "target")],
        )
        .withColumn("take", _edge_picks(F.col("members"), F.col("want")))
        .select("source", "source_size", "target", "draws", F.explode(F.arrays_zip("members", "take")).alias("m"))
        .select(
            F.col("m.members.doc_id").alias("doc_id"),
            "source",
            F.col("m.members.size").alias("size"),
            F.col("m.members.key").alias("key"),
            "source_size",
            "target",
            # the last draw of an edge block is the partial epoch
            F.when(F.col("m.take"), F.col("draws")).otherwise(F.slice("draws", F.lit(1), F.size("draws") - 1)).alias("shards"),
        )
    )
    return (
        whole.unionByName(edge)
        .withColumn("taken", F.col("size") * F.size("shards"))
        .withColumn("order_key", F.xxhash64(F.lit(seed), F.lit("order"), F.col("key")))
        .drop("key")
    )


def placements(mixed: DataFrame) -> DataFrame:
    """One row per copy (shard, position key, doc_id), each shard in one partition and shuffled there: ready to be written."""
    copies = mixed.select("doc_id", "order_key", F.posexplode("shards").alias("copy", "shard"))
    keyed = copies.select("shard", F.xxhash64("shard", "copy", "order_key").alias("position"), "doc_id", "copy")
    return keyed.repartition("shard").sortWithinPartitions("shard", "position", "doc_id")
