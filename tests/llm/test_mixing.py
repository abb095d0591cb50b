"""Mixtures: permutations, packing, totals, repeats and odd tables."""

import numpy as np
import pytest

from strandline.llm.mixing import MixSettings, draw_slots, mix_documents, mix_report, pack_blocks, packing, permute, shard_counts, token_table, wanted
from strandline.llm.tokens import count_tokens, encoder, DEFAULT_VOCABULARY

TOKENS = "doc_id bigint, source string, tokens bigint"
TARGETS = "plan string, source string, target_share double, max_repeats int, size_factor double"
SMALL = MixSettings(block=16, shard=8, bucket=512)


def tokens(spark, seed=0, n=600):
    rng = np.random.default_rng(seed)
    rows = [(k, "hot" if rng.random() < 0.7 else str(rng.choice(["a", "b"])), int(rng.integers(0, 90))) for k in range(n)]
    return spark.createDataFrame([*rows, (9001, None, 50), (9002, "unlisted", 40), (9003, "a", 0), (9004, "b", 5000)], TOKENS)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_is_a_bijection(size):
    x = permute(np.arange(size), np.full(size, size), np.full(size, 12345))
    assert sorted(x.tolist()) == list(range(size))
    if size > 60:
        y = permute(np.arange(size), np.full(size, size), np.full(size, 999))
        assert (x != y).any() and (x != np.arange(size)).mean() > 0.9


def test_blocks_hold_every_token_once(spark):
    frame = tokens(spark)
    parts = pack_blocks(frame, SMALL).collect()
    got = {}
    for r in parts:
        got[r.source, r.doc_id] = got.get((r.source, r.doc_id), 0) + r.tokens
    assert got == {(r.source, r.doc_id): r.tokens for r in frame.collect() if r.source and r.tokens}
    blocks = {}
    for r in parts:
        blocks[r.source, r.block] = blocks.get((r.source, r.block), 0) + r.tokens
    assert max(blocks.values()) == 16
    for source in ("hot", "a", "b"):
        assert sorted(b for s, b in blocks if s == source) == list(range(sum(s == source for s, _ in blocks)))
    there = {r.source: r.blocks for r in wanted(spark.createDataFrame([("p", s, 0.3, 1, 1.0) for s in ("hot", "a", "b")], TARGETS), frame, SMALL).collect()}
    assert there == {s: sum(x == s for x, _ in blocks) for s in ("hot", "a", "b")}


def test_shares_totals_and_repeats(spark):
    frame = tokens(spark)
    total = sum(r.tokens for r in frame.collect())
    plans = [("p", "hot", 0.5, 2, 1.0), ("p", " A ", 0.2, 3, 1.0), ("p", "B", 0.3, 4, 1.0), ("q", "a", 0.6, 2, 1.5), ("q", "gone", 0.1, 9, 1.5), ("q", "hot", 0.3, 1, 1.5), (None, None, None, None, None)]
    targets = spark.createDataFrame(plans, TARGETS)
    report = {(r.plan, r.source): r for r in mix_report(frame, targets, SMALL).collect()}
    for source, share in (("hot", 0.5), ("a", 0.2), ("b", 0.3)):
        r = report["p", source]
        assert r.met and abs(r.drawn_tokens - share * total) <= 2 * 16 and abs(r.actual_share - share) < 0.01 and r.most_repeats <= r.max_repeats
    short = report["q", "a"]
    assert not short.met and short.drawn_tokens == 2 * short.available_tokens and short.most_repeats == 2
    assert report["q", "gone"].drawn_tokens == 0 and not report["q", "gone"].met
    documents = mix_documents(frame, targets, SMALL).collect()
    assert {r.source for r in documents} == {"hot", "a", "b"} and all(r.tokens > 0 for r in documents)
    again = mix_documents(frame, targets, SMALL).collect()
    assert sorted(map(tuple, documents)) == sorted(map(tuple, again))


def test_slots_are_unique_and_shards_mixed(spark):
    frame = tokens(spark)
    slots = draw_slots(wanted(spark.createDataFrame([("p", "hot", 0.5, 2, 1.0), ("p", "a", 0.5, 3, 0.6)], TARGETS), frame, SMALL), SMALL).collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))
    assert len({(r.source, r.round, r.block) for r in slots}) == len(slots)
    assert len({r.shard for r in slots if r.source == "hot"}) > 0.8 * len({r.shard for r in slots})


def test_multinomial_shards(spark):
    frame, settings = tokens(spark, n=4000), MixSettings(block=16, shard=64, bucket=4096, draw="multinomial")
    plans = [("p", "hot", 0.5, 2, 1.0), ("p", "a", 0.3, 3, 1.0), ("p", "gone", 0.2, 4, 1.0), ("q", "b", 0.9, 1, 3.0), ("q", "a", 0.1, 9, 3.0)]
    targets = spark.createDataFrame(plans, TARGETS)
    wants = wanted(targets, frame, settings)
    counts = shard_counts(wants, settings).collect()
    slots = {p: sum(r.wanted_slots for r in wants.collect() if r.plan == p) for p in ("p", "q")}
    assert {p: sum(r.size for r in counts if r.plan == p) for p in slots} == slots and all(sum(r.counts) == r.size for r in counts)
    ten = [r.counts for r in counts if r.plan == "p" and r.size == 64]
    assert 0.3 < np.std([c[2] for c in ten]) / np.sqrt(64 * 0.5 * 0.5) < 1.7  # sources in order of name: a, gone, hot
    drawn = draw_slots(wants, settings).collect()
    assert len({(r.plan, r.slot) for r in drawn}) == len(drawn) == len({(r.plan, r.source, r.round, r.block) for r in drawn})
    assert {r.source for r in drawn} == {"hot", "a", "b"}
    report = {(r.plan, r.source): r for r in mix_report(frame, targets, settings).collect()}
    for source, share in (("hot", 0.5), ("a", 0.3)):
        r = report["p", source]
        assert abs(r.share_of_wanted - share) < 0.03 and r.most_repeats <= r.max_repeats
    assert report["q", "b"].drawn_tokens == report["q", "b"].available_tokens and not report["q", "b"].met
    with pytest.raises(ValueError):
        MixSettings(draw="some")


def test_documents_with_one_id_are_spread_by_content(spark):
    frame = spark.createDataFrame([(1, "a", k, 100) for k in range(200)] + [(None, "a", k, 100) for k in range(200)], "doc_id bigint, source string, content bigint, tokens bigint")
    sizes = packing(frame, MixSettings(block=16, bucket=4000)).collect()
    assert len(sizes) == 10 and max(r.tokens for r in sizes) < 8000 and sum(r.tokens for r in sizes) == 40_000


def test_odd_tables(spark):
    none, some = spark.createDataFrame([], TOKENS), spark.createDataFrame([("p", "a", 1.0, 1, 1.0)], TARGETS)
    r = mix_report(none, some, SMALL).first()
    assert r.drawn_tokens == 0 and r.actual_share is None
    assert mix_report(tokens(spark), spark.createDataFrame([], TARGETS), SMALL).count() == 0


def test_token_counts_of_whole_texts(spark):
    long = " ".join(f"word{k} Über-{k % 7}  слово" for k in range(20_000))
    rows = [(1, "A-b", "hello world", "x"), (2, None, None, "x"), (3, "", "", "x"), (4, "c", long, "x"), (5, "c", "x" * 200_000, "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens string")
    got = {r.doc_id: r for r in token_table(frame, MixSettings()).collect()}
    encode = encoder(DEFAULT_VOCABULARY).encode_ordinary
    assert got[1].tokens == len(encode("hello world")) and got[4].tokens == len(encode(long))
    assert got[2].tokens == got[3].tokens == 0 and got[1].source == "a_b" and got[3].source is None
    assert count_tokens(frame.drop("tokens")).columns == ["doc_id", "source", "tokens"]
