"""Languages: held-out accuracy, segments, gradient of the model, odd texts."""

import numpy as np
import pytest

from strandline.llm.langid import LANGUAGES, LanguageSettings, document_languages, features, fit, forward_backward, label_code, label_findings, label_segments, languages_of, one_script, posteriors, segments_of, untyped

PARTS = {
    "en": ("the price of the house|a new report from the office|our longest meeting of the year", "was higher than we had expected|did not change after all|will be read by everyone", "before the end of the week|because nobody had asked|although it was raining"),
    "de": ("der Preis des Hauses|ein neuer Bericht aus dem Büro|unsere längste Sitzung des Jahres", "war höher als wir erwartet hatten|änderte sich überhaupt nicht|wird von allen gelesen", "vor dem Ende der Woche|weil niemand gefragt hatte|obwohl es draußen regnete"),
    "fr": ("le prix de la maison|un nouveau rapport du bureau|notre plus longue réunion de l'année", "était plus élevé que prévu|n'a pas changé du tout|sera lu par tout le monde", "avant la fin de la semaine|parce que personne n'avait demandé|bien qu'il ait plu"),
    "es": ("el precio de la casa|un nuevo informe de la oficina|nuestra reunión más larga del año", "era más alto de lo que esperábamos|no cambió en absoluto|será leído por todos", "antes del fin de la semana|porque nadie había preguntado|aunque estaba lloviendo"),
    "pt": ("o preço da casa|um novo relatório do escritório|nossa reunião mais longa do ano", "era mais alto do que esperávamos|não mudou de modo algum|será lido por todos", "antes do fim da semana|porque ninguém tinha perguntado|embora estivesse chovendo"),
    "ru": ("цена этого дома|новый отчёт из конторы|наше самое долгое совещание за год", "была выше, чем мы ожидали|совсем не изменилась|будет прочитана всеми", "до конца недели|потому что никто не спросил|хотя шёл дождь"),
    "uk": ("ціна цього будинку|новий звіт із контори|наша найдовша нарада за рік", "була вища, ніж ми очікували|зовсім не змінилася|буде прочитана всіма", "до кінця тижня|бо ніхто не запитав|хоча йшов дощ"),
}
SETTINGS = LanguageSettings(per_language=40, rounds=30, mixtures=60)


def sentence(rng, lang):
    out = " ".join(str(rng.choice(p.split("|"))) for p in PARTS[lang])
    return out[0].upper() + out[1:] + f" {rng.integers(1000)}."


def text(rng, *langs, n=3):
    return " ".join(sentence(rng, lang) for lang in langs for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(7)
    rows, truth = [], {}
    for k in range(420):
        lang = LANGUAGES[k % 7]
        label = str(rng.choice([lang, lang.upper(), f"{lang}-XX"])) if rng.random() > 0.1 else LANGUAGES[(k + 3) % 7]
        rows.append((k, text(rng, lang, n=int(rng.integers(2, 6))), label))
    add = lambda k, body, label, *langs: (rows.append((k, body, label)), truth.__setitem__(k, set(langs)))
    add(1000, text(rng, "en", "de"), "en", "en", "de")
    add(1001, text(rng, "ru", "uk"), "uk", "ru", "uk")
    add(1002, text(rng, "fr"), "pt", "fr")
    add(1003, text(rng, "es"), "es")
    add(1004, text(rng, "es"), " ", "es")
    add(1005, None, None)
    add(1006, "AAPL 2012-01-01 3.5\nMSFT 2 4,5", "xx")
    add(1007, " \n", None)
    add(1008, text(rng, "de").replace("ä", "ae").replace("ü", "ue").replace("ö", "oe").replace("ß", "ss"), "de")
    add(1009, untyped(text(rng, "ru", n=4).lower(), "ru"), "und", "ru")
    add(1010, text(rng, "ru")[:-1] + " («the price of the house»). " + text(rng, "ru"), "ru")
    add(1011, text(rng, "pt", n=800), None, "pt")
    add(1012, text(rng, "fr").replace("e", "е"), "fr")
    add(1013, "Kurz.", "de")
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, words int, sentence string"), truth


def test_findings_of_known_cases(labelled):
    documents, truth = labelled
    languages = document_languages(documents, SETTINGS)
    got = {}
    for r in label_findings(documents, languages).where("doc_id >= 1000").collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert got == {k: v for k, v in truth.items() if v}


def test_held_out_accuracy_and_segments(labelled):
    documents, _ = labelled
    segments = label_segments(documents, SETTINGS)
    rows = document_languages(documents, SETTINGS).where("doc_id < 420 and main").collect()
    right = sum(r.lang == LANGUAGES[r.doc_id % 7] for r in rows)
    assert len(rows) == 420 and right >= 415 and all(0.5 < r.confidence <= 1 for r in rows)
    mixed = [(r.segment, r.lang) for r in segments.where("doc_id = 1000").orderBy("segment").collect()]
    assert mixed == [(0, "en"), (1, "de")]
    quoted = segments.where("doc_id = 1010").orderBy("segment").collect()
    assert [r.lang for r in quoted] == ["ru", "en", "ru"] and quoted[1].first_sentence == quoted[1].last_sentence and quoted[1].words == 5


def test_every_document_with_letters_has_a_language(spark):
    rng = np.random.default_rng(5)
    rows = [(k, text(rng, LANGUAGES[k % 7], n=4), LANGUAGES[k % 7]) for k in range(280)]
    odd = {500: "Kurz.", 501: "AAPL 3.5 MSFT", 502: "Nessuno aveva chiesto perché quella riunione fosse stata rinviata. Gli uffici restavano chiusi.", 503: text(rng, "ru").upper(), 504: "2012-01-01 3.5 %", 505: "Prices rose. " * 3, 506: text(rng, "de", n=1) + " The price of the house."}
    frame = spark.createDataFrame([*rows, *((k, t, None) for k, t in odd.items())], "doc_id bigint, text string, lang string")
    found = {}
    for r in document_languages(frame, SETTINGS).where("doc_id >= 500").collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(odd) - {504}
    assert [r.lang for r in found[503]] == ["ru"] and [r.lang for r in found[502]] == ["other"]
    assert not found[501][0].running and not found[500][0].running
    # one whole sentence of a second language makes no mix
    assert len(found[506]) == 1
    assert {r.doc_id for r in label_findings(frame, document_languages(frame, SETTINGS)).where("doc_id in (500, 501, 502, 504)").collect()} == set()


def test_whole_sentences_are_counted():
    posterior = np.zeros((11, len(LANGUAGES)))
    posterior[:5, 0] = posterior[5:, 3] = 1.0
    sentence = np.array([0] * 5 + [1] * 4 + [2] * 2)
    got = languages_of(sentence, np.arange(11), posterior, np.ones(11, bool), LanguageSettings())
    assert [r[:2] for r in got] == [("fr", 1)]
    segments = segments_of(sentence, np.arange(11), posterior, np.ones(11, bool), LanguageSettings())
    assert [(r[1], r[2], r[5], r[6]) for r in segments] == [(0, 0, 5, "en"), (1, 2, 6, "fr")]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert label_findings(empty, document_languages(empty)).count() == 0
    assert label_segments(empty).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    k, t = len(LANGUAGES), 3
    e, w, across = rng.normal(size=(1, t, k)), rng.normal(size=(2, k, k)), np.array([[False, True, False]])
    post, pairs, norm = forward_backward(e, across, np.array([t]), w, True)
    weight = {}
    for path in np.ndindex(*[k] * t):
        s = sum(e[0, j, path[j]] for j in range(t)) + sum(w[int(across[0, j]), path[j - 1], path[j]] for j in range(1, t))
        weight[path] = np.exp(s)
    z = sum(weight.values())
    want = np.zeros((t, k))
    for path, x in weight.items():
        for j in range(t):
            want[j, path[j]] += x / z
    assert np.allclose(post[0], want) and np.isclose(pairs.sum(), 2) and np.isclose(norm, np.log(z / k))


def test_padding_does_not_show():
    rng = np.random.default_rng(3)
    emission, trans = rng.normal(size=(50, len(LANGUAGES))).astype(np.float32), rng.normal(size=(2, len(LANGUAGES), len(LANGUAGES))).astype(np.float32)
    texts = [rng.integers(0, 50, n) for n in (1, 0, 7, 300, 12, 2000)]
    starts = [rng.random(len(t)) < 0.2 for t in texts]
    whole, small = posteriors(emission, texts, starts, trans), posteriors(emission, texts, starts, trans, width=2, most_words=10)
    for a, b, t in zip(whole, small, texts, strict=True):
        assert len(a) == len(t) and np.allclose(a, b, atol=1e-4) and np.allclose(a.sum(axis=1), 1, atol=1e-3)


def test_fit_separates_words():
    words = ["alpha", "beta", "gamma", "delta"]
    sequences = [(np.array([0, 1, 0]), np.array([0, 0, 0], bool), np.array([0, 0, 0])), (np.array([2, 3]), np.array([0, 0], bool), np.array([1, 1]))] * 5
    settings = LanguageSettings(rounds=40)
    weight, _ = fit(words, sequences, settings, 40)
    score = [weight[features(w, settings.buckets)].sum(axis=0).argmax() for w in words]
    assert score == [0, 0, 1, 1]


def test_labels_and_scripts(spark):
    given = [("EN", "en"), ("en_GB", "en"), (" rus ", "ru"), ("Ukrainian", "uk"), ("und", None), ("", None), (None, None), ("pt-BR", "pt"), ("xx", None)]
    rows = spark.createDataFrame([(a,) for a, _ in given], "l string").select(label_code("l").alias("c")).collect()
    assert [r.c for r in rows] == [b for _, b in given]
    assert one_script("еrror") == "error" and one_script("цeнa") == "цена" and one_script("plain") == "plain"


def test_quasi_newton_finds_the_minimum():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(12, 12))
    a = a @ a.T + np.eye(12)
    b = rng.normal(size=12)
    from strandline.llm.langid import quasi_newton

    got = quasi_newton(lambda x: (float(0.5 * x @ a @ x - b @ x), a @ x - b), np.zeros(12), 200)
    assert np.allclose(got, np.linalg.solve(a, b), atol=1e-2)


def test_wrong_labels_and_mixtures_are_left_out_of_the_second_fit(monkeypatch):
    from strandline.llm import langid

    rng, seen = np.random.default_rng(1), []
    sample = [(text(rng, LANGUAGES[k % 7], n=4), LANGUAGES[k % 7]) for k in range(210)]
    wrong = [(text(rng, "en", n=4), "de"), (text(rng, "ru", n=4), "uk"), (text(rng, "fr", "es"), "fr")] * 4
    keep = langid._agrees
    monkeypatch.setattr(langid, "_agrees", lambda *a: seen.append(keep(*a)) or seen[-1])
    langid.train(sample + wrong, SETTINGS)
    assert all(seen[:210]) and not any(seen[210:])
