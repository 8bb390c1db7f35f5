"""Mixing sources to target weights, DataFrame functions only.

The words of each source, its documents in hash order, form one stream that is
packed into blocks of ``block`` words, fewer for a source of few blocks.  A source's
target is filled by slots, one block each.  First the slots of a source are drawn into
the output shards, one by one, which gives every shard its source counts: multinomial
draws, conditioned on each source's total meeting its target.  The counts then lay out
the source's slots, shard after shard.  Slots map to blocks through a pseudorandom
permutation of the source's block numbers, another one for each pass over the source,
and the documents' pieces are joined with the drawn blocks by block number.  So the
counts decide which words an output shard holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, written

#: White space before a word.
SPACE_RE = r"[\x20\x09-\x0D]*"
#: Words in a block, at most; and a block is at most one of PARTS of its source and its target.
BLOCK, PARTS = 64, 16
#: Target weights, repeating over the sources in code point order, null last.
WEIGHTS = (5, 2, 1)
#: A source's target is at most this many times its size.
MOST = 3
#: Slots generated by one row before the slots are dealt out, and by one task.
CHUNK, TASK_SLOTS = 4096, 1 << 18
#: Rounds of the index permutation.
ROUNDS = 12
#: Sources numbered by one window task; more sources take range partitions.
ONE_TASK = 10_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, rank, weight, target) from (source, source_size).

    The whole size is shared by weight; a target stops at ``most`` times its
    source's size and the excess is shared again among the others by weight, until
    none is above.  One row per source; each round is one aggregate over them.
    """
    ranked = written(sizes.withColumn("rank", _rank(sizes)), "sources") \
        if sizes.limit(ONE_TASK + 1).count() <= ONE_TASK else _wide_rank(sizes)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn(
        "weight", F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0                     # words for each unit of weight
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        fixed, weight = ranked.agg(
            F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (fixed or 0.0)) / weight if weight else level
        if new <= level or not weight:
            break
        level = new
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def _rank(sizes: DataFrame) -> Column:
    return F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1


def _wide_rank(sizes: DataFrame) -> DataFrame:
    """Ranks of many sources: range partitions, counted, then numbered in each."""
    parts = written(
        sizes.repartitionByRange(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id()), "source-ranges")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (
        F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.row_number().over(
        Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return written(parts.withColumn("inner", inner).join(before, "part")
                   .select("source", "source_size", (F.col("before") + F.col("inner")).alias("rank")),
                   "sources")


def permuted(index: Column, size: Column, keys: list[Column], rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. size - 1, applied to ``index``.  Each round swaps
    x with key - x (mod size), or leaves both, as a hash of the pair says; that is
    one-to-one for any size."""
    def turn(x, r):
        other = F.pmod(F.pmod(F.xxhash64(r, *keys), size) + size - x, size)
        swap = F.pmod(F.xxhash64(F.lit("swap"), r, F.greatest(x, other), *keys), F.lit(2)) == 0
        return F.when(swap, other).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, turn)


def stream_positions(docs: DataFrame) -> DataFrame:
    """``docs`` (rank, size, h, ...) with ``start``: the words before each document in
    its source's stream, by prefix sums in two levels: over hashed cells of the source and
    within a cell.  With the square root of the rows as the number of cells, neither
    level holds more than about that many rows of a source in one task."""
    cells = max(1, math.isqrt(docs.count()))
    docs = docs.withColumn("cell", F.pmod(F.xxhash64("h"), F.lit(cells)))
    sums = written(docs.groupBy("rank", "cell").agg(F.sum("size").alias("n")), "stream-cells")
    below = sums.select("rank", "cell", (
        F.sum("n").over(Window.partitionBy("rank").orderBy("cell")) - F.col("n")).alias("below"))
    inner = Window.partitionBy("rank", "cell").orderBy("h", "size", "doc_id")
    inner = F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return (docs.withColumn("inner", inner).join(below, ["rank", "cell"])
            .withColumn("start", F.col("below") + F.col("inner")).drop("cell", "inner", "below"))


def block_words(block: int) -> Column:
    """Words in a block of a source: ``block``, but not more than one of PARTS of the
    source's size or target, and 1 at least."""
    part = F.floor(F.least(F.col("source_size").cast("double"), "target") / F.lit(PARTS))
    return F.greatest(F.least(part, F.lit(block)), F.lit(1)).cast("long")


def _chunks(rows: DataFrame, count: str, *keep: str) -> DataFrame:
    """(*keep, ``_at``): one row for each of the ``count`` things of a row.  They are made
    by rows of CHUNK each, which are dealt to tasks by the number of things."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / CHUNK)))
    chunks = rows.select(*keep, count, first.alias("_chunk"))
    total = rows.agg(F.sum(count)).first()[0] or 0
    chunks = chunks.repartition(1 + total // TASK_SLOTS, *keep, "_chunk")
    first = F.col("_chunk") * CHUNK
    return chunks.select(*keep, F.explode(F.sequence(first, F.least(first + CHUNK, F.col(count)) - 1)).alias("_at"))


def draw_shards(sources: DataFrame, seed: int, out_shards: int) -> DataFrame:
    """(rank, blocks, out_shard, n, before): how many slots of each source an output shard
    gets, and how many of them lie in shards before it.

    The target in blocks is rounded up or down by a seeded draw on its fraction, so it
    is met on average; a source with a target of a word or more has a slot.
    """
    plan = sources.where("source_size > 0").withColumn(
        "blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    exact = F.col("target") * F.col("blocks") / F.col("source_size")
    draw = F.pmod(F.xxhash64(F.lit("slots"), F.lit(seed), "rank"), F.lit(1 << 30)) / F.lit(1 << 30)
    plan = plan.withColumn("slots", F.least(
        F.floor(exact) + (draw < exact - F.floor(exact)).cast("long"),
        F.col("blocks") * MOST).cast("long")).where("slots > 0")
    drawn = _chunks(plan, "slots", "rank", "blocks").select("rank", "blocks", F.pmod(
        F.xxhash64(F.lit(seed), "rank", "_at"), F.lit(out_shards)).cast("int").alias("out_shard"))
    counts = written(drawn.groupBy("rank", "blocks", "out_shard").agg(F.count("*").alias("n")), "mix-shards")
    return counts.withColumn(                   # at most ``out_shards`` rows of a source
        "before", F.sum("n").over(Window.partitionBy("rank").orderBy("out_shard")) - F.col("n"))


def lay_slots(shards: DataFrame, seed: int) -> DataFrame:
    """(rank, slot, out_shard, pass, block): one row per slot, a block of ``block_words`` words."""
    slots = _chunks(shards, "n", "rank", "blocks", "out_shard", "before").select(
        "rank", "blocks", "out_shard", (F.col("before") + F.col("_at")).alias("slot"))
    slots = slots.select(
        "rank", "blocks", "out_shard", "slot", F.pmod("slot", "blocks").alias("index"),
        F.floor(F.col("slot") / F.col("blocks")).cast("int").alias("pass"))
    block = permuted(F.col("index"), F.col("blocks"), [F.lit(seed), F.col("rank"), F.col("pass")])
    # written, so that the join with the documents' pieces is planned by its real size
    return written(slots.select("rank", "slot", "out_shard", "pass", block.alias("block")), "mix-slots")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=WEIGHTS, block: int = BLOCK, seed: int = 7,
        out_shards: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, pieces) of the mix.

    documents: doc_id, h (hash of id, text and source), source, rank, block_words, size, start,
    row by row.
    sources: source, source_size, rank, weight, target, block_words.
    pieces: rank, start, size, block, pass, slot, out_shard, piece_from, piece_words; the
    words [piece_from, piece_from + piece_words) of the document that starts at
    ``start`` of stream ``rank``, once for each time its block is drawn.

    The words taken of a source differ from its target by less than two of its blocks
    (one by rounding, one by a short last block): by at most 2 ``block``, and at most an
    eighth of the target or 2 words, the larger.  A target under one word gives a word or
    none, by a draw that meets it on average; only such sources can leave the mix.

    Null and wordless texts have size 0 and no pieces; null is a source of its own,
    last in order; a source without words has target 0.  Repeated rows are separate
    stretches of the stream.  Only the three named columns are read.  An empty table
    gives empty results.  Same rows and seed give the same mix in any partitioning.
    """
    base = written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.xxhash64(*_row_key(id_col, text_col, source_col)).alias("h"),
        word_count(F.col(text_col).cast("string")).alias("size")), "mix-documents")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(
        source_targets(sizes, weights).withColumn("block_words", block_words(block)), "mix-sources")
    numbered = base.join(sources.select(F.col("source").alias("s"), "rank", "block_words"),
                         F.col("source").eqNullSafe(F.col("s"))).drop("s")
    documents = written(stream_positions(numbered), "mix-positions")
    words = F.col("block_words")
    blocks = F.explode(F.sequence(F.floor(F.col("start") / words),
                                  F.floor((F.col("start") + F.col("size") - 1) / words)))
    parts = documents.where("size > 0").select("rank", "start", "size", "block_words", blocks.alias("block"))
    low = F.greatest(F.col("block") * words, F.col("start"))
    high = F.least((F.col("block") + 1) * words, F.col("start") + F.col("size"))
    parts = parts.select("rank", "start", "size", "block", (low - F.col("start")).alias("piece_from"),
                         (high - low).alias("piece_words"))
    pieces = parts.join(lay_slots(draw_shards(sources, seed, out_shards), seed), ["rank", "block"])
    return documents, sources, pieces


def mix_counts(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, shard_words (output
    shard -> words of the document that it holds; empty where none is taken)."""
    documents, sources, pieces = mix(docs, **how)
    of_shard = pieces.groupBy(F.col("rank").alias("r"), F.col("start").alias("s"), "out_shard").agg(
        F.sum("piece_words").alias("words"))
    taken = of_shard.groupBy("r", "s").agg(
        F.sum("words").alias("taken"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("out_shard", "words")))).alias("shard_words"))
    of_source = sources.select(F.col("rank").alias("sr"), "source_size", "target")
    return (documents
            .join(taken, (F.col("rank") == F.col("r")) & (F.col("start") == F.col("s"))
                  & (F.col("size") > 0), "left")
            .join(of_source, F.col("rank") == F.col("sr"))
            .select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"),
                    "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                    F.coalesce("shard_words", F.create_map().cast("map<int,bigint>")).alias("shard_words")))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", n_chars_col: str | None = "n_chars",
                  **how) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: for each pass over a source, each
    document's words that the pass drew, in order.  A document drawn whole keeps its
    text unchanged; one drawn in part keeps its drawn words, each after the white space
    that stands before it in the text, line breaks included.

    The passes of a document meet its text in one row, whose words are cut once.
    """
    base = docs.withColumn("__h", F.xxhash64(*_row_key(id_col, text_col, source_col)))
    documents, _, pieces = mix(docs, id_col, text_col, source_col, **how)
    spans = pieces.groupBy("rank", "start", "pass").agg(
        F.sum("piece_words").alias("words"),
        F.sort_array(F.collect_list(F.struct("piece_from", "piece_words"))).alias("spans"))
    drawn = (spans.withColumnsRenamed({"rank": "r", "start": "s"})
             .join(documents, (F.col("r") == F.col("rank")) & (F.col("s") == F.col("start")) & (F.col("size") > 0))
             .groupBy("rank", "start").agg(
                 F.any_value("h").alias("__k"), F.any_value("doc_id").alias("__id"),
                 F.min(F.col("words") == F.col("size")).alias("__all"),
                 F.collect_list(F.struct((F.col("words") == F.col("size")).alias("whole"), "spans")).alias("__passes"))
             .select("__k", "__id", "__all", "__passes"))
    # rows that agree in id, source and text are interchangeable, each was placed
    # separately: they share the keyed text once
    texts = base.dropDuplicates([id_col, "__h"]) if _repeats(documents) else base
    whole = F.col(text_col).cast("string")
    # each word with the white space before it
    words = F.regexp_extract_all(whole, F.lit(f"{SPACE_RE}{WORD_RE}"), F.lit(0))
    joined = texts.join(drawn, (F.col("__h") == F.col("__k")) & F.col(id_col).eqNullSafe(F.col("__id")))
    joined = joined.withColumn("__words", F.when(~F.col("__all"), words))
    joined = joined.select(*docs.columns, "__words", F.explode("__passes").alias("__pass"))
    piece = F.flatten(F.transform("__pass.spans", lambda x: F.slice(
        F.col("__words"), (x["piece_from"] + 1).cast("int"), x["piece_words"].cast("int"))))
    part = F.regexp_replace(F.array_join(piece, ""), f"^{SPACE_RE}", "")
    out = joined.withColumn(text_col, F.when(F.col("__pass.whole"), whole).otherwise(part))
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out.select(*docs.columns)


def _row_key(*cols: str) -> list[Column]:
    return [F.col(c).cast("string") for c in cols]


def _repeats(documents: DataFrame) -> bool:
    return not documents.groupBy("doc_id", "h").count().where("count > 1").isEmpty()
