"""Leaks: constructed cases, both join paths, and a brute-force aligner."""

import numpy as np
import pytest

from strandline.llm.leakage import LeakRule, align, fewest_words, find_leaks, looked_up, salted_join, searched_items, seed_filter, spaced_seeds
from strandline.llm.text import bare_words, readable

WORDS = [f"{a}{b}{c}" for a in ("mor", "tel", "ban", "kur") for b in ("i", "e", "o") for c in ("ska", "lin", "dor", "mat", "pes")]


def passage(rng, n, tag):
    return [f"{rng.choice(WORDS)}{tag}{k}" if k % 3 == 0 else str(rng.choice(WORDS)) for k in range(n)]


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(4)
    say = "Read this and answer."
    items = {k: passage(rng, 60, f"q{k}") for k in range(1, 7)}
    item_rows = [(k, (say + " " if k < 5 else "") + " ".join(w)) for k, w in items.items()] + [(90, None), (91, ""), (92, "too short to leak"), (1, say + " " + " ".join(items[1]))]
    noise = lambda n: passage(rng, n, "z")
    wrap = lambda middle: " ".join([*noise(40), *middle, *noise(30)])
    docs, want = [], set()

    def add(middle, *leaks):
        docs.append((len(docs) + 1, middle if isinstance(middle, str) else wrap(middle)))
        want.update((len(docs), k) for k in leaks)

    one = items[1]
    add(one, 1)
    add(one[10:34], 1)  # exactly 24
    add(one[10:32])  # 22
    replaced = [w if k not in (7, 15) else "other" for k, w in enumerate(one[:24])]
    add(replaced, 1)
    add([w if k not in (3, 9, 15, 20) else "other" for k, w in enumerate(one[:24])])
    dropped = one[:8] + one[9:26]
    add(dropped, 1)
    added = one[:8] + ["more"] + one[8:16] + ["words"] + one[16:24]
    add(added, 1)
    add(list(rng.permutation(one)))
    add([w if k % 3 else w.replace("q1", "q9") for k, w in enumerate(one)])  # other figures
    add(say.split() + one[:18])
    add(" ".join(one).upper().replace(" ", "\n"), 1)
    add("<p>" + " ".join(f"<b>{w}</b>," for w in one) + "</p>", 1)
    add("".join(f"&#{ord(c)};" if c in "aeo" else c for c in " ".join(one)), 1)
    add(" ".join(one).replace("a", "а").replace("o", "о").replace("e", "é"), 1)  # Cyrillic lookalikes, accents
    add(" ".join(w[:2] + "­" + w[2:] + "​" for w in one), 1)
    add("\n".join("> " + " ".join(one[k : k + 6]) for k in range(0, 60, 6)), 1)
    add(" ".join(one[:11]) + " " + one[11][:3] + "-\n" + one[11][3:] + " " + " ".join(one[12:30]), 1)
    add(" ".join(noise(5000)) + " " + " ".join(items[2][5:45]) + " " + " ".join(noise(700)) + " " + " ".join(items[3][:30]), 2, 3)
    add(one[:30] + items[4][20:50], 1, 4)
    add([w for w in items[5][:40] for w in (w, "—")], 5)  # bare punctuation between
    docs += [(500, None), (501, ""), (502, " \n"), (503, "short"), (None, " ".join(one)), (1, docs[0][1])]
    return docs, item_rows, want


DOC, ITEM = "doc_id bigint, text string", "item_id bigint, text string"


@pytest.mark.parametrize("bounds", [{}, {"most_pairs": 10}, {"most_words": 10, "hot": 2}])
def test_leaks_of_constructed_cases(spark, case, bounds):
    docs, items, want = case
    more = spark.createDataFrame([(*d, "w", 1) for d in docs], DOC + ", words string, seed int")
    got = find_leaks(more, spark.createDataFrame(items, ITEM), LeakRule(**bounds)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(got) == len(want) and all(r.words >= 24 and r.edits * 12 <= r.words for r in got)


@pytest.mark.parametrize("bound", [2_000_000, 10])
def test_long_items_and_documents(spark, bound):
    rng = np.random.default_rng(9)
    item = passage(rng, 3000, "long")
    docs = [(k, " ".join([*passage(rng, 300 * k, "n"), *item[a : a + 24], *passage(rng, 50, "m")])) for k, a in enumerate((0, 240, 300, 1270, 2976))]
    got = find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, " ".join(item)), (2, " ".join(passage(rng, 500, "z")))], ITEM), LeakRule(most_pairs=bound)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, 1) for k in range(5)}


def test_leaks_of_nothing(spark):
    empty_docs, empty_items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    one = spark.createDataFrame([(1, "a b c")], DOC)
    assert find_leaks(empty_docs, empty_items).count() == 0
    assert find_leaks(one, empty_items).count() == 0
    assert find_leaks(empty_docs, spark.createDataFrame([(1, " ".join(map(str, range(40))))], ITEM)).count() == 0
    assert find_leaks(one, spark.createDataFrame([(1, None)], ITEM), LeakRule(most_pairs=0)).count() == 0


def brute_align(text, item, weight, rule):
    """Longest passage by plain recursion over all starts, with at most ``most_edits`` edits."""
    best = 0
    for i0 in range(len(item)):
        for j0 in range(len(text)):
            if item[i0] != text[j0]:
                continue
            frontier = {(i0, j0): (int(weight[i0]), 0)}
            states = {(i0, j0, 0): int(weight[i0])}
            stack = [(i0, j0, 0)]
            while stack:
                i, j, e = stack.pop()
                size = states[i, j, e]
                if item[i] == text[j] and size >= max(rule.least, e * rule.one_edit_in):
                    best = max(best, size)
                steps = []
                if i + 1 < len(item) and j + 1 < len(text):
                    steps.append((i + 1, j + 1, e + (item[i + 1] != text[j + 1]), size + int(weight[i + 1])))
                if i + 1 < len(item):
                    steps.append((i + 1, j, e + 1, size + int(weight[i + 1])))
                if j + 1 < len(text):
                    steps.append((i, j + 1, e + 1, size))
                for a, b, c, s in steps:
                    if c <= rule.most_edits and states.get((a, b, c), -1) < s:
                        states[a, b, c] = s
                        stack.append((a, b, c))
            del frontier
    return best


def test_align_equals_brute_force():
    rng, rule = np.random.default_rng(0), LeakRule(least=6, one_edit_in=3)
    for _ in range(25):
        item = rng.integers(0, 9, 14)
        text = item.copy()
        for _ in range(3):
            k = rng.integers(len(text))
            text = [np.delete(text, k), np.insert(text, k, 50), np.where(np.arange(len(text)) == k, 60, text)][rng.integers(3)]
        weight = rng.integers(1, 3, 14).astype(np.int32)
        got, edits = align([text.astype(np.int64)], [item.astype(np.int64)], [weight], rule)
        # a path that ends right after an edit may count a word twice by two routes, so only matched ends are compared
        assert got[0] == brute_align(text.tolist(), item.tolist(), weight, rule)
        assert edits[0] * rule.one_edit_in <= got[0]


def test_seeds_ignore_the_masked_word_only():
    words = np.arange(1, 9, dtype=np.uint64)
    changed = [words.copy() for _ in range(8)]
    for k in range(8):
        changed[k][k] += np.uint64(1000)
    base = spaced_seeds(words)[:, 0]
    same = [(spaced_seeds(x)[:, 0] == base).tolist() for x in changed]
    assert [[k for k in range(8) if same[k][m]] for m in range(2)] == [[2, 5], [1, 6]]
    assert spaced_seeds(words[:7]).shape == (2, 0)


def test_every_passage_within_the_rule_has_a_seed():
    rng = np.random.default_rng(1)
    for n, edits in ((24, 2), (35, 2), (36, 3), (47, 3)):
        words = np.arange(1, n + 1, dtype=np.uint64)
        known = set(spaced_seeds(words).ravel().tolist())
        for _ in range(200):
            text = words.copy()
            for _ in range(edits):
                k = rng.integers(len(text))
                text = [np.delete(text, k), np.insert(text, k, 900), np.where(np.arange(len(text)) == k, np.uint64(901), text)][rng.integers(3)]
            assert known & set(spaced_seeds(text.astype(np.uint64)).ravel().tolist())


def test_filter_of_any_test_set_has_its_size(spark):
    rule = LeakRule(filter_bits=10)
    seeds = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 3000)
    frame = spark.createDataFrame([(int(s), 1) for s in seeds[:40]], "seed bigint, item_id bigint")
    bits = seed_filter(frame, rule)
    assert bits.nbytes == 128 and looked_up(seeds[:40].view(np.uint64), bits, rule).all()
    assert looked_up(seeds[40:].view(np.uint64), bits, rule).mean() < 0.1


def test_salted_join_is_the_join(spark):
    left = spark.createDataFrame([(k % 3 if k % 2 else 7, k, "x") for k in range(300)], "key bigint, doc bigint, cuts string").drop("cuts")
    right = spark.createDataFrame([(k % 8, k) for k in range(40)], "key bigint, item bigint")
    plain, cut = left.join(right, "key"), salted_join(left, right, "key", ("doc",), 10)
    assert sorted(map(tuple, cut.select("key", "doc", "item").collect())) == sorted(map(tuple, plain.select("key", "doc", "item").collect()))


def test_short_items_are_reported(spark):
    say = "Read this and answer."
    items = [(k, f"{say} " + " ".join(f"w{k}x{j}" for j in range(n))) for k, n in enumerate((40, 24, 23, 3))] + [(8, None), (9, "")]
    got = {r.item_id: r.words for r in searched_items(spark.createDataFrame(items, ITEM)).collect() if not r.searched}
    assert got == {2: 23, 3: 3, 8: 0, 9: 0}


def test_fewest_words():
    rule = LeakRule()
    assert fewest_words(np.ones(30, np.int32), rule) == 24
    assert fewest_words(np.full(30, 2, np.int32), rule) == 12
    assert fewest_words(np.ones(10, np.int32), rule) == 11


def test_reading_through_markup():
    assert bare_words("<b>Café</b> &amp; &#1072;bc, <br>x_1-2 — ＡＢ") == ["cafe", "abc", "x12", "ab"]
    assert readable("> one\n>> two-\n> three") == "one\ntwothree"
    assert bare_words("") == [] and bare_words("​  ") == []
