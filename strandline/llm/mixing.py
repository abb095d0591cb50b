"""Mixtures of sources by target shares of tokens.

1. Documents of a source are put into buckets by a hash of id and content,
   ordered by it and packed end to end into blocks of ``block`` tokens. A bucket
   has a bounded size, so a source that holds most of the rows is many buckets;
   only the last block of a bucket may be short.
2. The slots of a plan, its wanted size in blocks, are cut into output shards,
   and each shard draws how many of its slots each source fills. With ``draw``
   ``multinomial`` shards draw independently, and the shares come out to a
   sampling error. With ``exact``, the default, the draw is multinomial under the
   condition that the plan's totals come out: a pseudorandom permutation of all
   slots says which source fills a slot, so every slot can be computed alone.
3. The d-th draw of a source reads block ``permutation(d mod blocks)``, with
   another permutation for every round through the source: a block, and with it
   every part of a document, is taken at most ``max_repeats`` times.
4. Slots and blocks join on (source, block).

A source that is missing, or too small even with its repeats, leaves its slots
unfilled; others are not enlarged. Shares reached are reported against what was
drawn and against what was wanted.

Defined results
    Null, blank-named and unlisted sources take part in the total size but are
    not drawn. Texts without tokens are not drawn. Names are compared in lower
    case with underscores. A plan's rows for one source add their shares and
    keep the largest ``max_repeats``; null shares and repeats count as 0. Two
    documents with one id are two documents. Empty tables give an empty result
    or zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.joins import join_counted
from strandline.functions.scalars import clean_label
from strandline.llm.tokens import DEFAULT_VOCABULARY, count_tokens
from strandline.session import stored


@dataclass(frozen=True)
class MixSettings:
    block: int = 512  #: tokens of a block
    shard: int = 1024  #: slots of an output shard
    bucket: int = 1 << 22  #: tokens of a packing bucket, about
    seed: int = 20240601
    draw: str = "exact"  #: or "multinomial"
    vocabulary: str = DEFAULT_VOCABULARY

    def __post_init__(self) -> None:
        if self.draw not in ("exact", "multinomial"):
            raise ValueError("draw is exact or multinomial")


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of ``0..size-1``, elementwise: a balanced Feistel network, walked until inside.

    Elements with the same size and key belong to one permutation.
    """
    x, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    bits = np.ceil(np.log2(np.maximum(size.astype(np.float64), 4.0)))
    half = (np.floor(bits / 2) + 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = out[todo] >> half[todo], out[todo] & mask[todo]
            for turn in range(4):
                mixed = (right + key[todo] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(turn + 1)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(31)
                mixed *= np.uint64(0x94D049BB133111EB)
                mixed ^= mixed >> np.uint64(29)
                left, right = right, left ^ (mixed & mask[todo])
            out[todo] = (left << half[todo]) | right
            todo = out >= size
    return out.astype(np.int64)


def token_table(documents: DataFrame, settings: MixSettings) -> DataFrame:
    """(doc_id, source, content, tokens), counted once and written to the shared folder; ``content`` is a hash of the text."""
    named = documents.select("text", "doc_id", F.nullif(clean_label("source"), F.lit("")).alias("source"), F.xxhash64("text").alias("content"))
    return stored(count_tokens(named, "text", settings.vocabulary), "tokens")


def _usable(tokens: DataFrame, settings: MixSettings) -> DataFrame:
    """Documents that can be drawn, with two hashes: of the bucket and of the order in it."""
    parts = [F.col("doc_id"), *(F.col(c) for c in ("content",) if c in tokens.columns)]
    hashes = (F.xxhash64(*parts, F.lit(settings.seed + k)).alias(name) for k, name in enumerate(("place", "order")))
    return tokens.where("source is not null and tokens > 0").select("source", "doc_id", "tokens", *hashes)


def packing(tokens: DataFrame, settings: MixSettings) -> DataFrame:
    """(source, bucket, buckets, tokens, blocks, first): sizes of every bucket and the number of its first block, computed once."""
    usable = _usable(tokens, settings)
    buckets = stored(usable.groupBy("source").agg(F.ceil(F.sum("tokens") / F.lit(float(settings.bucket))).alias("buckets")), "buckets")
    sized = (
        join_counted(usable, buckets, ["source"])
        .groupBy("source", F.pmod("place", "buckets").alias("bucket"))
        .agg(F.max("buckets").alias("buckets"), F.sum("tokens").alias("tokens"))
        .withColumn("blocks", F.ceil(F.col("tokens") / F.lit(float(settings.block))))
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return stored(sized.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))), "packing")


def pack_blocks(tokens: DataFrame, settings: MixSettings, packed: DataFrame | None = None) -> DataFrame:
    """(source, block, doc_id, tokens): the part of each document in each block, blocks numbered 0.. per source."""
    packed = packing(tokens, settings) if packed is None else packed
    sizes = packed.groupBy("source").agg(F.max("buckets").alias("buckets"))
    bucketed = join_counted(_usable(tokens, settings), sizes, ["source"]).withColumn("bucket", F.pmod("place", "buckets"))
    along = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    laid = bucketed.withColumn("end", F.sum("tokens").over(along)).withColumn("start", F.col("end") - F.col("tokens"))
    length = F.lit(float(settings.block))
    blocks = F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("end") - 1) / length)))
    parts = laid.select("source", "bucket", "doc_id", "start", "end", blocks.alias("k"))
    inside = F.least("end", (F.col("k") + 1) * settings.block) - F.greatest("start", F.col("k") * settings.block)
    firsts = packed.select("source", "bucket", "first")
    return join_counted(parts, firsts, ["source", "bucket"]).select("source", (F.col("first") + F.col("k")).alias("block"), "doc_id", inside.alias("tokens"))


def wanted(targets: DataFrame, tokens: DataFrame, settings: MixSettings, packed: DataFrame | None = None) -> DataFrame:
    """Per plan and source: wanted tokens, blocks there are, slots wanted and slots that can be filled."""
    packed = packing(tokens, settings) if packed is None else packed
    everything = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    there = packed.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.sum("blocks").alias("blocks"))
    plans = (
        targets.select("plan", F.nullif(clean_label("source"), F.lit("")).alias("source"), "target_share", "max_repeats", "size_factor")
        .groupBy("plan", "source")
        .agg(
            F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
            F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"),
            F.max(F.coalesce("size_factor", F.lit(0.0))).alias("size_factor"),
        )
    )
    joined = plans.join(there, "source", "left").join(F.broadcast(everything)).fillna(0, ["available_tokens", "blocks"])  # one row
    size = F.col("target_share") * F.col("size_factor") * F.col("all_tokens")
    slots = F.when(F.col("blocks") > 0, F.round(size * F.col("blocks") / F.greatest("available_tokens", F.lit(1))).cast("bigint")).otherwise(
        F.ceil(size / F.lit(float(settings.block)))
    )
    return joined.withColumns({"wanted_tokens": size, "wanted_slots": slots}).withColumn(
        "slots", F.least("wanted_slots", F.col("blocks") * F.col("max_repeats"))
    )


SLOT_SCHEMA = "plan string, shard bigint, slot bigint, source string, round int, block bigint"


def _blocks_of(drawn: np.ndarray, blocks: np.ndarray, source: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(round, block) of each source's draws by the permutation of the source and the round."""
    turn = drawn // blocks
    with np.errstate(over="ignore"):
        own = key + (source.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + turn.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return turn.astype(np.int32), permute(drawn % blocks, blocks, own)


def draw_slots(wants: DataFrame, settings: MixSettings) -> DataFrame:
    """(plan, shard, slot, source, round, block) of every slot that can be filled."""
    return _draw_multinomial(wants, settings) if settings.draw == "multinomial" else _draw_exact(wants, settings)


def shard_counts(wants: DataFrame, settings: MixSettings) -> DataFrame:
    """(plan, shard, size, counts, key, sources): independent multinomial source counts of every output shard."""
    of = F.struct(F.coalesce("source", F.lit("")).alias("source"), "wanted_slots", "slots", "blocks")
    plans = wants.where("wanted_slots > 0").groupBy("plan").agg(F.sort_array(F.collect_list(of)).alias("sources"), F.sum("wanted_slots").alias("n"))
    shards = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.lit(float(settings.shard)))))
    pieces = plans.select("plan", "n", F.xxhash64("plan", F.lit(settings.seed)).alias("key"), "sources", shards.alias("shard")).repartition("plan", "shard")
    shares = pieces.select("plan", "n", "key", "shard", F.col("sources.wanted_slots").alias("wanted_slots"))
    shard, seed = settings.shard, settings.seed

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["plan"], r["shard"], int(min(shard, r["n"] - r["shard"] * shard)), np.array(r["wanted_slots"], float), r["key"]) for r in batch.to_pylist()]
            counts = [np.random.default_rng([seed, key & 0xFFFFFFFFFFFFFFFF, number]).multinomial(size, w / w.sum()) for _, number, size, w, key in rows]
            columns = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.list_(pa.int64()))], names=["plan", "shard", "size", "counts"])

    drawn = shares.mapInArrow(draw, "plan string, shard bigint, size bigint, counts array<bigint>")
    return join_counted(drawn, plans.select("plan", "sources", F.xxhash64("plan", F.lit(settings.seed)).alias("key")), ["plan"])


def _draw_multinomial(wants: DataFrame, settings: MixSettings) -> DataFrame:
    counts = stored(shard_counts(wants, settings), "counts")
    # draws of the shards before each, in two levels so that no window spans a plan's shards
    run = F.floor(F.col("shard") / F.lit(1024.0)).alias("run")
    each = counts.select("plan", "shard", run, F.posexplode("counts").alias("k", "n"))
    keys = ["plan", "k", "run"]
    runs = each.groupBy(*keys).agg(F.sum("n").alias("n"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(*keys, F.coalesce(F.sum("n").over(earlier("plan", "k", "run")), F.lit(0)).alias("before"))
    placed = each.withColumn("inside", F.coalesce(F.sum("n").over(earlier(*keys, "shard")), F.lit(0))).join(before, keys)
    firsts = placed.groupBy("plan", "shard").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("inside") + F.col("before")).alias("first")))).alias("firsts"))
    work = counts.join(firsts, ["plan", "shard"]).select("plan", "shard", "size", "counts", "key", F.col("firsts.first").alias("first"), *(F.col(f"sources.{x}").alias(x) for x in ("source", "slots", "blocks")))
    shard = settings.shard

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                source = np.repeat(np.arange(len(counts)), counts)
                drawn = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + np.array(row["first"], np.int64)[source]
                key = np.full(len(source), row["key"], np.int64).view(np.uint64)
                with np.errstate(over="ignore"):
                    mixed = key + np.uint64(row["shard"] + 1) * np.uint64(0x9E3779B97F4A7C15)
                slot = permute(np.arange(len(source)), np.full(len(source), len(source)), mixed) + row["shard"] * shard
                # what the repeats do not allow stays an empty slot
                there = drawn < np.array(row["slots"], np.int64)[source]
                source, drawn, key, slot = source[there], drawn[there], key[there], slot[there]
                turn, block = _blocks_of(drawn, np.array(row["blocks"], np.int64)[source], source, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["plan"]] * len(slot), pa.string()), pa.array(np.full(len(slot), row["shard"])), pa.array(slot), pa.array(np.array(row["source"], object)[source], pa.string()), pa.array(turn), pa.array(block)],
                    names=["plan", "shard", "slot", "source", "round", "block"],
                )

    return work.mapInArrow(draw, SLOT_SCHEMA)


def _draw_exact(wants: DataFrame, settings: MixSettings) -> DataFrame:
    plans = wants.where("slots > 0").groupBy("plan").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("source"), "slots", "blocks"))).alias("sources"), F.sum("slots").alias("n")
    )
    chunk = 1 << 14
    pieces = plans.select(
        "plan", "n", *(F.col(f"sources.{x}").alias(x) for x in ("source", "slots", "blocks")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.lit(float(chunk))))).alias("chunk")
    ).withColumn("key", F.xxhash64("plan", F.lit(settings.seed)))
    shard = settings.shard

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["chunk"] * chunk
                slot = np.arange(first, min(first + chunk, row["n"]))
                key = np.full(len(slot), row["key"], np.int64).view(np.uint64)
                at = permute(slot, np.full(len(slot), row["n"]), key)
                ends = np.cumsum(row["slots"])
                source = np.searchsorted(ends, at, side="right")
                drawn = at - (ends - row["slots"])[source]
                blocks = np.array(row["blocks"], np.int64)[source]
                turn, block = _blocks_of(drawn, blocks, source, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["plan"]] * len(slot), pa.string()), pa.array(slot // shard), pa.array(slot), pa.array(np.array(row["source"], object)[source], pa.string()), pa.array(turn), pa.array(block)],
                    names=["plan", "shard", "slot", "source", "round", "block"],
                )

    return pieces.repartition("plan", "chunk").mapInArrow(draw, SLOT_SCHEMA)


def _mixed(tokens: DataFrame, wants: DataFrame, packed: DataFrame, settings: MixSettings) -> DataFrame:
    taken = draw_slots(wants, settings).groupBy("plan", "source", "block").agg(F.count("*").alias("times"))
    return (
        taken.join(pack_blocks(tokens, settings, packed).hint("merge"), ["source", "block"])
        .groupBy("plan", "source", "doc_id")
        .agg(F.sum(F.col("times") * F.col("tokens")).alias("tokens"), F.max("times").alias("times"))
    )


def mix_documents(tokens: DataFrame, targets: DataFrame, settings: MixSettings | None = None) -> DataFrame:
    """(plan, source, doc_id, tokens, times): tokens drawn of each document and how often its most drawn part was taken."""
    settings = settings or MixSettings()
    packed = packing(tokens, settings)
    return _mixed(tokens, stored(wanted(targets, tokens, settings, packed), "wants"), packed, settings)


def mix_report(tokens: DataFrame, targets: DataFrame, settings: MixSettings | None = None) -> DataFrame:
    """Per plan and source: wanted and drawn tokens, shares reached, documents used and whether the source allows what is wanted (to half a block)."""
    settings = settings or MixSettings()
    packed = packing(tokens, settings)
    wants = stored(wanted(targets, tokens, settings, packed), "wants")
    drawn = (
        _mixed(tokens, wants, packed, settings)
        .groupBy("plan", "source")
        .agg(F.sum("tokens").alias("drawn_tokens"), F.count("*").alias("documents"), F.max("times").alias("most_repeats"))
    )
    joined = wants.join(drawn, ["plan", "source"], "left").fillna(0, ["drawn_tokens", "documents", "most_repeats"])
    plan = Window.partitionBy("plan")
    total, want = F.sum("drawn_tokens").over(plan), F.sum("wanted_tokens").over(plan)
    return joined.select(
        "plan",
        "source",
        "target_share",
        "max_repeats",
        F.round("wanted_tokens", 3).alias("wanted_tokens"),
        "available_tokens",
        "drawn_tokens",
        F.when(total > 0, F.round(F.col("drawn_tokens") / total, 9)).alias("actual_share"),
        F.when(want > 0, F.round(F.col("drawn_tokens") / want, 9)).alias("share_of_wanted"),
        "documents",
        "most_repeats",
        (F.col("slots") == F.col("wanted_slots")).alias("met"),
    )
