"""Evaluation passages in training text, by spaced-seed hashing.

1. Texts become words without case, accents, punctuation, markup and encoding
   tricks. Every window of ``SPAN`` words gives one hash per mask, over the
   words the mask selects; the ignored positions may differ.
2. Hashes of test and training words join. Training hashes first pass a bit
   table of the test hashes, whose size is fixed; it is put together by tasks.
   The join is done beside each document where pairs of hash and item and words
   of items, both counted first, are within ``most_pairs`` and ``most_words``;
   else by shuffles, in which the documents of a frequent hash are salted. Both
   give the same pairs.
3. Around the hits the words themselves are aligned: a document leaks an item
   if ``least`` running words of the item occur with at most one in
   ``one_edit_in`` replaced, dropped or added. Both figures are the task's.

Completeness. A passage of ``least`` = 24 words or more with at most one edit
in 12 words contains one of fewer than 48 words with the same property (of two
halves of 24 or more, one keeps the rate), hence with at most 3 edits; of 24 to
35 words and 2 edits, or 36 to 47 and 3, some run of 8 words is untouched. Each
mask spans 8 words, so each has a hit, and a stretch of ``stride`` words with
``overlap`` more holds the whole shorter passage. The ignored positions add
what the rule does not ask for: with 5 of 24 words replaced at random 0.995 of
passages have a hit, with whole runs of 8 words 0.59. Nothing is capped: every
seed of every word is looked up. Bare punctuation between blanks is a word of a
passage's length but of no seed.

Defined results
    Null, empty and wordless texts on either side have no passages. Repeated
    items and documents each give their rows; a pair comes once. The first
    sentence of an item is a standing instruction, and no part of the passage,
    if ``standing`` or more items begin with it. Items shorter than ``least``
    words cannot leak by the rule; ``searched_items`` says which are searched
    (``words``: of an item's longest stretch). Texts of any
    length are read whole. Empty tables give an empty result; further columns
    are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.joins import join_counted
from strandline.llm.text import bare_word, readable
from strandline.session import stored

#: Selected positions of each mask; the others are ignored.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 2, 3, 4, 5, 7))
SPAN = 8
#: Words that are seeded together.
TOGETHER = 1 << 16
_FACTORS = np.random.default_rng(8).integers(1, 1 << 62, (len(MASKS), SPAN), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

PAIR_SCHEMA = "doc_id bigint, item_id bigint, words int, edits int"


@dataclass(frozen=True)
class LeakRule:
    least: int = 24
    one_edit_in: int = 12
    standing: int = 3  #: items that share a first sentence make it an instruction
    stride: int = 256  #: words of a stretch of a document
    overlap: int = 64  #: words that a stretch shares with the next
    most_pairs: int = 1_000_000  #: pairs of test hash and item up to which they are sent along, 16 MB
    most_words: int = 1_000_000  #: words of items up to which they are sent along, some 20 MB
    filter_bits: int = 24  #: of the bit table of test hashes, 2 MB
    hot: int = 10_000  #: stretches that one hash may bring to one task

    @property
    def most_edits(self) -> int:
        return (2 * self.least - 1) // self.one_edit_in


class WordHashes:
    """64-bit hashes of the bare words of texts; pieces seen before are remembered up to a bound."""

    def __init__(self, bound: int = 1 << 20) -> None:
        self.known: dict[str, int] = {}
        self.bound = bound

    def pieces(self, text: str) -> np.ndarray:
        """A hash for each blank-separated piece; 0 for bare punctuation."""
        known = self.known
        if len(known) > self.bound:
            known.clear()
        chunks = readable(text).split()
        out = list(map(known.get, chunks))
        if None in out:
            for k, value in enumerate(out):
                if value is None:
                    word = bare_word(chunks[k])
                    out[k] = known[chunks[k]] = (xxhash.xxh3_64_intdigest(word) or 1) if word else 0
        return np.array(out, np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        out = self.pieces(text)
        return out[out != 0]


def spaced_seeds(words: np.ndarray) -> np.ndarray:
    """(masks, positions) hashes of the windows that start at each word; words as uint64."""
    n = len(words) - SPAN + 1
    if n <= 0:
        return np.zeros((len(MASKS), 0), np.uint64)
    out = np.zeros((len(MASKS), n), np.uint64)
    with np.errstate(over="ignore"):
        for m, mask in enumerate(MASKS):
            for k in mask:
                out[m] += (words[k : k + n] ^ (words[k : k + n] >> np.uint64(32))) * _FACTORS[m, k]
            out[m] ^= out[m] >> np.uint64(29)
            out[m] *= np.uint64(0x9E3779B97F4A7C15)
            out[m] ^= out[m] >> np.uint64(32)
    return out


def item_words(items: DataFrame, rule: LeakRule) -> DataFrame:
    """(item_id, words, weights): hashed words of each item without its standing instruction, long items in stretches.

    ``weights`` counts the blank-separated words that a bare word stands for:
    itself and any bare punctuation after it. Stretches overlap as those of
    documents do, so some stretch holds the shorter passage of every leak.
    """
    first = F.regexp_extract(F.btrim("text"), r"^[^.!?]*[.!?](?=\s)", 0)
    opened = items.where("text is not null").select("item_id", "text", first.alias("opening"))
    shared = opened.where("opening <> ''").groupBy("opening").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") >= rule.standing)
    cut = opened.join(shared, "opening", "left").select(
        "item_id", F.when(F.col("n").isNotNull(), F.substring(F.btrim("text"), F.length("opening") + 1, F.length("text"))).otherwise(F.col("text")).alias("text")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, words, weights = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = hashes.pieces(text)
                real = np.flatnonzero(pieces)
                weight = np.diff([*real, len(pieces)]).astype(np.int32) if len(real) else np.zeros(0, np.int32)
                for low in range(0, max(1, len(real) - rule.overlap), rule.stride):
                    high = low + rule.stride + rule.overlap
                    ids.append(item)
                    words.append(pieces[real[low:high]].view(np.int64))
                    weights.append(weight[low:high])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int32()))], names=["item_id", "words", "weights"])

    return cut.select(F.col("item_id").cast("bigint"), "text").mapInArrow(read, "item_id bigint, words array<bigint>, weights array<int>")


def _item_seeds(items: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seeds = [], []
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.unique(spaced_seeds(np.array(words or [], np.int64).view(np.uint64)))
                ids.append(np.full(len(found), item, np.int64))
                seeds.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds or [np.zeros(0, np.int64)])), pa.array(np.concatenate(ids or [np.zeros(0, np.int64)]))], names=["seed", "item_id"])

    return items.select("item_id", "words").mapInArrow(read, "seed bigint, item_id bigint")


def searched_items(items: DataFrame, rule: LeakRule | None = None) -> DataFrame:
    """(item_id, words, searched): words of each item without a standing instruction, and whether they are enough for a leak by the rule."""
    rule = rule or LeakRule()
    words = item_words(items.where("item_id is not null"), rule).groupBy("item_id").agg(F.max(F.aggregate("weights", F.lit(0), lambda a, x: a + x)).alias("words"))
    every = items.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id")).distinct()
    return every.join(words, "item_id", "left").fillna(0, ["words"]).withColumn("searched", F.col("words") >= rule.least)


def seed_filter(seeds: DataFrame, rule: LeakRule) -> np.ndarray:
    """A bit table of the test hashes, combined by tasks; what comes to the driver is at most the table."""
    at = seeds.select(F.shiftrightunsigned("seed", 64 - rule.filter_bits).alias("at"))
    # 64 bits a row: at most 2 ** (filter_bits - 6) rows, whatever the test set
    rows = at.groupBy(F.shiftright("at", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(max(1, 1 << (rule.filter_bits - 6)), np.int64)
    table[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return table.view(np.uint8)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: Sequence[str], most: int) -> DataFrame:
    """Inner join on ``key`` in which keys with over ``most`` rows on the left are cut by a hash of ``spread_by``.

    Rows are counted by key before the shuffle; the right side's rows of such a
    key are repeated once per cut.
    """
    hot = left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key, F.ceil(F.col("n") / F.lit(float(most))).cast("int").alias("cuts"))
    hot = stored(hot, "hot")
    cut = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("cuts")), F.lit(0)).cast("int")
    salted = join_counted(left, hot, [key], "left").withColumn("salt", cut).drop("cuts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1))
    repeated = join_counted(right, hot, [key], "left").withColumn("salt", copies).drop("cuts")
    return salted.join(repeated.hint("merge"), [key, "salt"]).drop("salt")


def stretches_of(words: np.ndarray, seeds: np.ndarray, hit: np.ndarray, rule: LeakRule) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, words, distinct hit seeds) of each stretch of a text that holds a hit."""
    where = np.flatnonzero(hit.any(axis=0))
    if not len(where):
        return
    for k in np.unique(np.concatenate([where // rule.stride, np.maximum(where - rule.overlap, 0) // rule.stride])):
        low, high = int(k) * rule.stride, (int(k) + 1) * rule.stride + rule.overlap
        found = np.unique(seeds[:, low:high][hit[:, low:high]])
        if len(found):
            yield int(k), words[low:high], found


def looked_up(seeds: np.ndarray, bits: np.ndarray, rule: LeakRule) -> np.ndarray:
    """Which seeds the bit table lets through."""
    at = seeds >> np.uint64(64 - rule.filter_bits)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def seeded_texts(ids: list[int], texts: list[str], hashes: WordHashes, bits: np.ndarray, rule: LeakRule) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(id, words, seeds, hits) of each text with a hit; texts are seeded together, some ten thousand words at a time."""
    part: list[tuple[int, np.ndarray]] = []
    size = 0
    for doc, text in zip(ids, texts, strict=True):
        if text and doc is not None:
            words = hashes(text)
            if len(words) >= SPAN:
                part.append((doc, words))
                size += len(words)
        if size >= TOGETHER:
            yield from _seeded(part, bits, rule)
            part, size = [], 0
    yield from _seeded(part, bits, rule)


def _seeded(part: list[tuple[int, np.ndarray]], bits: np.ndarray, rule: LeakRule) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    if not part:
        return
    seeds = spaced_seeds(np.concatenate([words for _, words in part]))
    hit = looked_up(seeds, bits, rule)
    first = 0
    for doc, words in part:
        # windows that reach into the next text are not looked at
        last = first + len(words) - SPAN + 1
        if hit[:, first:last].any():
            yield doc, words, seeds[:, first:last], hit[:, first:last]
        first += len(words)


def document_stretches(documents: DataFrame, bits: np.ndarray, rule: LeakRule) -> DataFrame:
    """(doc_id, stretch, words, seeds) of the stretches of documents that hold a seed which may join."""
    table = documents.sparkSession.sparkContext.broadcast(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), table.value
        for batch in batches:
            rows = []
            for doc, words, seeds, hit in seeded_texts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), hashes, known, rule):
                rows += [(doc, k, part.view(np.int64), found.view(np.int64)) for k, part, found in stretches_of(words, seeds, hit, rule)]
            longs = pa.list_(pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), longs, longs), strict=True)], names=["doc_id", "stretch", "words", "seeds"]
            )

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(read, "doc_id bigint, stretch int, words array<bigint>, seeds array<bigint>")


def fewest_words(weights: np.ndarray, rule: LeakRule) -> int:
    """The fewest running bare words of an item that stand for ``least`` words."""
    ends = np.cumsum(weights)
    starts = ends - weights
    reach = np.searchsorted(ends, starts + rule.least)
    whole = reach < len(ends)
    return int((reach - np.arange(len(ends)) + 1)[whole].min()) if whole.any() else len(ends) + 1


def most_present(there: np.ndarray, width: int, rule: LeakRule) -> bool:
    """Whether ``width`` running item words are all but ``most_edits`` of them in the text, in any order.

    ``there`` says of each word of the item whether the text has it; a passage
    cannot be there without this.
    """
    if width > len(there):
        return False
    total = np.cumsum(there, dtype=np.int32)
    total[width:] -= total[:-width].copy()
    return int(total[width - 1 :].max()) >= width - rule.most_edits


def align(documents: list[np.ndarray], items: list[np.ndarray], weights: list[np.ndarray], rule: LeakRule) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the longest passage found and its edits, 0 words if there is none.

    ``long[e]`` is, per pair and document position, the most item words of a
    passage that ends at this item word and this position with ``e`` edits;
    passages begin and end with equal words.
    """
    n, edits = len(items), rule.most_edits
    wide, tall = max(map(len, documents)) + 1, max(map(len, items))
    text = np.full((n, wide), -1, np.int64)
    for k, x in enumerate(documents):
        text[k, 1 : len(x) + 1] = x
    there = np.arange(wide) <= np.array([len(x) for x in documents])[:, None]
    there[:, 0] = False
    words, weight = np.zeros((n, tall), np.int64), np.zeros((n, tall), np.int32)
    real = np.zeros((n, tall), bool)
    for k, (x, w) in enumerate(zip(items, weights, strict=True)):
        words[k, : len(x)], weight[k, : len(x)], real[k, : len(x)] = x, w, True
    before = [np.zeros((n, wide), np.int32) for _ in range(edits + 1)]
    best, used = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i in range(tall):
        equal = (text == words[:, i : i + 1]) & there & real[:, i : i + 1]
        w = weight[:, i : i + 1]
        now: list[np.ndarray] = []
        for e in range(edits + 1):
            row = np.zeros((n, wide), np.int32)
            if e:
                less = before[e - 1]
                row[:, 1:] = np.where(less[:, :-1] > 0, less[:, :-1] + w, 0)  # replaced
                row = np.maximum(row, np.where(less > 0, less + w, 0))  # dropped
                row[:, 1:] = np.maximum(row[:, 1:], now[e - 1][:, :-1])  # added
            here = np.zeros((n, wide), np.int32)
            here[:, 1:] = before[e][:, :-1] + w
            row = np.where(equal, np.maximum(row, here), row)
            now.append(row)
            ends = np.where(equal & (row >= max(rule.least, e * rule.one_edit_in)), row, 0).max(axis=1)
            better = ends > best
            best, used = np.where(better, ends, best), np.where(better, e, used)
        before = now
    return best, used


def _aligned(rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], rule: LeakRule) -> pa.RecordBatch:
    """The leaks among candidate rows (doc, item, stretch words, item words, weights)."""
    kept: list[tuple[int, int, int, int]] = []
    rows = sorted(rows, key=lambda r: len(r[2]))
    for start in range(0, len(rows), 64):
        part = rows[start : start + 64]
        best, used = align([r[2] for r in part], [r[3] for r in part], [r[4] for r in part], rule)
        kept += [(r[0], r[1], int(b), int(u)) for r, b, u in zip(part, best, used, strict=True) if b]
    columns = list(zip(*kept, strict=True)) or [()] * 4
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "words", "edits"])


def _leaks_by_table(documents: DataFrame, worded: DataFrame, seeds: DataFrame, bits: np.ndarray, rule: LeakRule) -> DataFrame:
    """The join with a test set within the bound, done beside each document: no shuffle, nothing written."""
    pairs = seeds.toArrow()
    order = np.argsort(pairs.column(0).to_numpy().view(np.uint64), kind="stable")
    keys, owners = pairs.column(0).to_numpy().view(np.uint64)[order], pairs.column(1).to_numpy()[order]
    listed = [(item, np.array(words, np.int64), np.array(weights, np.int32)) for item, words, weights in zip(*(c.to_pylist() for c in worded.toArrow().columns), strict=True)]
    vocabulary = np.unique(np.concatenate([words for _, words, _ in listed] or [np.zeros(0, np.int64)]))
    items: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]] = {}
    for item, words, weights in listed:
        items.setdefault(item, []).append((words, weights, np.searchsorted(vocabulary, words), fewest_words(weights, rule)))
    table = documents.sparkSession.sparkContext.broadcast((bits, keys, owners, items, vocabulary))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, owners, items, vocabulary = table.value
        hashes, present = WordHashes(), np.zeros(len(vocabulary), bool)
        for batch in batches:
            rows = []
            for doc, words, seeds, hit in seeded_texts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), hashes, known, rule):
                for _, part, found in stretches_of(words, seeds, hit, rule):
                    low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
                    owned = np.unique(np.concatenate([owners[a:b] for a, b in zip(low, high, strict=True)] or [owners[:0]]))
                    if not len(owned):
                        continue
                    part = part.view(np.int64)
                    at = np.minimum(np.searchsorted(vocabulary, part), len(vocabulary) - 1)
                    at = at[vocabulary[at] == part]
                    present[at] = True
                    for item in owned.tolist():
                        rows += [(doc, item, part, own, weights) for own, weights, places, width in items[item] if most_present(present[places], width, rule)]
                    present[at] = False
            yield _aligned(rows, rule)

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(read, PAIR_SCHEMA)


def _leaks_by_join(documents: DataFrame, worded: DataFrame, seeds: DataFrame, bits: np.ndarray, rule: LeakRule) -> DataFrame:
    """The same by shuffles on seed, stretch and item, for test sets of any size."""
    stretches = stored(document_stretches(documents, bits, rule), "stretches")
    exploded = stretches.select("doc_id", "stretch", F.explode("seeds").alias("seed"))
    pairs = salted_join(exploded, seeds, "seed", ("doc_id", "stretch"), rule.hot).select("doc_id", "stretch", "item_id").distinct()
    joined = (
        pairs.join(stretches.select("doc_id", "stretch", F.col("words").alias("text")).distinct(), ["doc_id", "stretch"])
        .join(worded.select("item_id", "words", "weights").distinct(), "item_id")
        .select("doc_id", "item_id", "text", "words", "weights")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, words, weights = ([np.asarray(x, t) for x in batch.column(k).to_pylist()] for k, t in ((2, np.int64), (3, np.int64), (4, np.int32)))
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text, words, weights, strict=True)
            yield _aligned([r for r in rows if most_present(np.isin(r[3], r[2]), fewest_words(r[4], rule), rule)], rule)

    return joined.mapInArrow(verify, PAIR_SCHEMA)


def find_leaks(documents: DataFrame, items: DataFrame, rule: LeakRule | None = None) -> DataFrame:
    """(doc_id, item_id, words, edits): each document with each item it leaks, with the longest aligned passage."""
    rule = rule or LeakRule()
    worded = stored(item_words(items.where("item_id is not null"), rule), "items")
    seeds = stored(_item_seeds(worded), "seeds")
    bits = seed_filter(seeds, rule)
    pairs, words = seeds.count(), worded.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    few = pairs <= rule.most_pairs and words <= rule.most_words
    found = (_leaks_by_table if few else _leaks_by_join)(documents, worded, seeds, bits, rule)
    best = F.max(F.struct("words", (-F.col("edits")).alias("saved"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.words", (-F.col("best.saved")).alias("edits"))
