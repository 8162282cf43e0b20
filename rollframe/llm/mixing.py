"""Mixing sources to target weights, in built-in column functions.

Words of a source are packed into blocks of fixed length, in a pseudorandom order of its
documents.  Output shards draw how many of their slots each source fills (a multinomial draw),
a source's slots are numbered through all shards and mapped to its blocks by a keyed permutation
of the block indexes, one per epoch, and blocks come by a join on their index.  Every random
choice is a hash of the seed and the row's own numbers, so reruns and retried tasks agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.functions.permute import permuted, round_key_columns
from rollframe.llm.work import written
from rollframe.operators.indexing import running_totals

BLANKS = " \t\n\x0b\x0c\r"
WORD_GAPS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    """weights: of the sources by code point (null last), repeating; share: words of the mix over
    words of the corpus; most: how often a source (and each of its blocks) is used at most, a
    whole number; block_words: words of a block; shard_slots: blocks of an output shard."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    block_words: int = 64
    shard_slots: int = 4096
    seed: int = 17

    def __post_init__(self):
        if not self.weights or min(self.weights) < 1 or not 0 < self.share <= self.most or min(self.block_words, self.shard_slots) < 1:
            raise ValueError("weights, block_words and shard_slots are at least 1, share is above 0 and at most `most`")


@dataclass(frozen=True)
class Mix:
    """documents: (row, id, source, text_hash, size, source_size, target), one per input row;
    slots: (out_shard, source_index, slot, block), one per block that the mix takes;
    pieces: (source_index, block, row, word_from, n_words), the documents of every block.
    ``slots`` and ``pieces`` join on (source_index, block)."""

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame


def hash60(*parts: Column) -> Column:
    """60 bits of the md5 of the parts' decimal or text spelling, null as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than blanks and ASCII control spaces; 0 for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WORD_GAPS))).cast("bigint")


def source_targets(sources: DataFrame, params: MixParams) -> DataFrame:
    """``sources(source_index, size)`` with ``weight`` and ``target``.

    Targets share ``share`` times all sizes by weight, stop at ``most`` times their source's
    size, and the excess goes to the others by weight until none is above.  In the order of
    (limit / weight), the sources below the water line come first, and the line is the largest
    of the quotients (what is left after the earlier ones) / (their weight left); so it takes
    two running sums and no rounds."""
    weights = F.array(*[F.lit(w) for w in params.weights])
    s = sources.withColumn("weight", F.get(weights, (F.col("source_index") % len(params.weights)).cast("int")).cast("bigint"))
    s = s.withColumn("limit", F.col("size") * params.most)
    s = running_totals(s, [F.col("limit") / F.col("weight"), F.col("source_index")],
                       {"full": F.col("limit"), "weighed": F.col("weight")})
    total = s.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return s.withColumn("target", F.lit(0.0)).drop("limit", "full", "weighed")
    line = s.agg(F.max((F.lit(params.share * total["size"]) - F.col("full")) / (F.lit(total["weight"]) - F.col("weighed")))).first()[0]
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(float(line)))
    return s.withColumn("target", target).drop("limit", "full", "weighed")


def drawn_counts(sources: DataFrame, n_slots: int, params: MixParams) -> DataFrame:
    """(out_shard, source_index, n): the multinomial draw.  Every slot of a shard draws a number
    below ``n_slots``; the source whose interval [first, first + blocks_wanted) holds it gets the
    slot.  Intervals are met by equal joins on bins of their average width."""
    spark = sources.sparkSession
    wanted = sources.where("blocks_wanted > 0")
    width = max(1, n_slots // max(1, wanted.count()))
    bins = wanted.select("source_index", F.col("first").alias("lo"), (F.col("first") + F.col("blocks_wanted")).alias("hi"))
    bins = bins.select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("bin"))
    slots = spark.range(n_slots).select(F.floor(F.col("id") / params.shard_slots).alias("out_shard"), (F.col("id") % params.shard_slots).alias("i"))
    draws = slots.select("out_shard", (hash60(F.lit(params.seed), F.lit("draw"), F.col("out_shard"), F.col("i")) % n_slots).alias("x"))
    draws = draws.withColumn("bin", F.floor(F.col("x") / width))
    return (draws.join(bins, "bin").where("lo <= x and x < hi")
            .groupBy("out_shard", "source_index").agg(F.count("*").alias("n")))


def numbered_slots(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """(out_shard, source_index, slot): the drawn slots, numbered per source through all shards,
    after as many have changed hands as it takes for every source to have ``blocks_wanted``:
    the last slots of a source that drew too many go to those that drew too few."""
    counts = running_totals(counts, ["source_index", "out_shard"], {"before": F.col("n")})
    drew = counts.groupBy("source_index").agg(F.sum("n").alias("drew"), F.min("before").alias("begin"))
    s = sources.select("source_index", "blocks_wanted").join(drew, "source_index", "left").na.fill(0, ["drew", "begin"])
    over, under = (F.greatest(F.col(a) - F.col(b), F.lit(0)) for a, b in (("drew", "blocks_wanted"), ("blocks_wanted", "drew")))
    s = written(running_totals(s, "source_index", {"over_start": over, "under_start": under}), "mix-drew")
    # a row is up to a whole shard's slots: small rows that grow must not be read by a few tasks
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = counts.join(s, "source_index").repartition(n, "out_shard", "source_index").select(
        "out_shard", "source_index", "blocks_wanted", "over_start",
        F.explode(F.sequence(F.col("before") - F.col("begin"), F.col("before") - F.col("begin") + F.col("n") - 1)).alias("slot"))
    kept = slots.where("slot < blocks_wanted").select("out_shard", "source_index", "slot")
    free = slots.where("slot >= blocks_wanted").select("out_shard", (F.col("over_start") + F.col("slot") - F.col("blocks_wanted")).alias("turn"))
    short = s.where("drew < blocks_wanted").select(
        "source_index", F.explode(F.sequence(F.col("drew"), F.col("blocks_wanted") - 1)).alias("slot"),
        (F.col("under_start") - F.col("drew")).alias("shift"))
    short = short.select("source_index", "slot", (F.col("shift") + F.col("slot")).alias("turn"))
    return kept.unionByName(free.join(short, "turn").select("out_shard", "source_index", "slot"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                params: MixParams = MixParams()) -> Mix:
    """The mix of ``docs`` as its documents, slots and pieces (:class:`Mix`).

    A source's slots are its target in blocks, rounded, so what the mix takes of it is within
    half a block of the target (the last block of a source may be short).  A block is used
    once per epoch at most, and there are ``most`` epochs, so no word is taken more often.

    Null, empty and blank texts have size 0: they have a row but no pieces.  A null source is
    a source of its own, the last.  Ids may be null or repeat; repeated rows are documents of
    their own.  An empty table, or one without words, gives targets of 0 and no slots.  Other
    columns are left out, so their names cannot clash.

    Rows meet by (source, block): a source that holds a third of all words is as many keys as
    it has blocks.  The tables of sources and of draws per shard have no texts.
    """
    b = params.block_words
    text = F.col(text_col)
    d = written(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        hash60(F.lit(params.seed), F.col(id_col)).alias("place"), F.when(text.isNotNull(), hash60(text)).alias("text_hash")), "mix-docs")
    sources = d.groupBy("source").agg(F.sum("size").alias("size"))
    sources = running_totals(sources, [F.col("source").isNull(), F.col("source")], {"source_index": F.lit(1), "source_start": F.col("size")})
    sources = source_targets(sources, params)
    blocks = F.ceil(F.col("size") / b).cast("bigint")
    wanted = F.when(F.col("size") > 0, F.floor(F.col("target") * blocks / F.col("size") + 0.5)).otherwise(0).cast("bigint")
    sources = sources.withColumns({"blocks": blocks, "blocks_wanted": F.least(wanted, blocks * params.most)})
    sources = written(running_totals(sources, "source_index", {"first": F.col("blocks_wanted")}), "mix-sources")

    d = running_totals(d, [F.col("source").isNull(), F.col("source"), "place", "id", "text_hash"],
                       {"row": F.lit(1), "start": F.col("size")})
    s = sources.select(F.col("source").alias("of"), "source_index", F.col("size").alias("source_size"), "source_start", "target")
    d = written(d.join(s, F.col("source").eqNullSafe(F.col("of"))).select(
        "row", "id", "source", "text_hash", "size", "source_size", "target", "source_index", (F.col("start") - F.col("source_start")).alias("lo")),
        "mix-rows")
    end = F.col("lo") + F.col("size")
    pieces = d.where("size > 0").select("source_index", "row", "lo", end.alias("hi"), F.explode(
        F.sequence(F.floor(F.col("lo") / b), F.floor((end - 1) / b))).alias("block"))
    begin = F.greatest(F.col("lo"), F.col("block") * b)
    pieces = pieces.select("source_index", "block", "row", (begin - F.col("lo")).alias("word_from"),
                           (F.least(F.col("hi"), (F.col("block") + 1) * b) - begin).alias("n_words"))

    n_slots = sources.agg(F.sum("blocks_wanted")).first()[0] or 0
    counts = written(drawn_counts(sources, n_slots, params), "mix-draws")
    slots = numbered_slots(sources, counts).join(sources.select("source_index", "blocks"), "source_index")
    epoch = F.floor(F.col("slot") / F.col("blocks"))
    # the keys of a permutation are hashed once per (source, epoch), not per slot
    keyed = sources.select("source_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(params.most - 1).cast("bigint"))).alias("epoch"))
    keyed = keyed.select("*", F.array(*round_key_columns(F.lit(params.seed), F.col("source_index"), F.col("epoch"))).alias("keys"))
    slots = slots.withColumn("epoch", epoch).join(keyed, ["source_index", "epoch"])
    place = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("keys"))
    return Mix(d.drop("source_index", "lo"), slots.select("out_shard", "source_index", "slot", place.alias("block")), pieces)


def mixed_pieces(mix: Mix) -> DataFrame:
    """(out_shard, source_index, slot, block, row, word_from, n_words): what stands in each slot,
    by the join of slots and blocks on the block's index."""
    return mix.slots.join(mix.pieces, ["source_index", "block"])


def taken_words(mix: Mix) -> DataFrame:
    """``mix.documents`` with ``taken``: the words that the mix takes of each, repeats counted."""
    taken = mixed_pieces(mix).groupBy("row").agg(F.sum("n_words").alias("taken"))
    return mix.documents.join(taken, "row", "left").na.fill(0, ["taken"])


def mixed_texts(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(out_shard, slot, source_index, words): the words of every slot in order.  ``docs`` are the
    rows the mix was made of; of rows with one id and text one is read."""
    text = F.ltrim(F.col(text_col), F.lit(BLANKS))
    texts = (docs.select(F.col(id_col).alias("id"), hash60(F.col(text_col)).alias("text_hash"), F.split(text, WORD_GAPS).alias("w"))
             .where(F.col("text_hash").isNotNull()).dropDuplicates(["id", "text_hash"]))
    rows = mix.documents.where("size > 0").select("row", F.col("id").alias("of"), F.col("text_hash").alias("th"))
    cut = (mixed_pieces(mix).join(rows, "row")
           .join(texts, F.col("of").eqNullSafe(F.col("id")) & (F.col("th") == F.col("text_hash")))
           .select("out_shard", "slot", "source_index", "row", F.slice("w", (F.col("word_from") + 1).cast("int"), F.col("n_words").cast("int")).alias("part")))
    # a block's documents stand in the order of their rows
    parts = cut.groupBy("out_shard", "source_index", "slot").agg(F.array_sort(F.collect_list(F.struct("row", "part"))).alias("p"))
    return parts.select("out_shard", "slot", "source_index", F.flatten("p.part").alias("words"))
