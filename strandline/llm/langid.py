"""Languages of documents and of stretches within them, by a linear-chain CRF.

Every word is labelled with a language. A word's score comes from affix,
character n-gram and lexicon features; the scores of neighbours come from two
learned transition matrices, one within a sentence and one across its end.
Forward-backward gives each word's posterior. Runs of words with one most
probable language are stretches, within sentences too: a quoted phrase is a
stretch of its own. A sentence has the language of its words' mean posterior; a
language belongs to a document if it holds two or more whole sentences of it, or
the most words. Where the lexicon knows fewer than ``known_share`` of the words,
the language is ``other``: one the model has not learned, or none.

The model is fitted by one task on a bounded sample of labelled documents
(``per_language`` each, drawn by a hash of the id), whose delivered labels are
wrong at times: a first fit sorts out the documents that contradict their own
label and the phrases within the others that do, the second learns from the rest, from sequences that switch language at
sentence ends and within sentences, and from copies typed without the language's
usual letters. Labelling runs over all documents, whole texts, without shuffle.

Defined results
    Null, blank and figure-only texts give no rows; every text with a letter has
    a language, if only ``other``. Figures are no words; nor are pieces in
    capitals of four letters or more (tickers, model codes) unless the lexicon
    knows them as words, which stand in small letters more often than not. Confidence is the mean posterior of the language over
    the words given to it, for ``other`` the share of words unknown. Repeated
    documents each give their rows. Without any labelled document there is no
    model, and every text is ``other``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import LOOKALIKES, readable

LANGUAGES = ("en", "ru", "de", "fr", "es", "pt", "uk")

#: Spellings of a language's name, after lower case and without a region. Fixed values.
NAMES = {
    "en": ("en", "eng", "english"),
    "ru": ("ru", "rus", "russian", "русский"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "esp", "spanish", "castilian", "español", "espanol"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "uk": ("uk", "ukr", "ukrainian", "українська"),
}

#: Latin writing of Cyrillic letters, for copies of training text. Fixed values.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "i", "є": "ie", "ґ": "g",
}
LATIN_UKRAINIAN = {"г": "h", "и": "y", "й": "i", "ю": "iu", "я": "ia"}
#: Writing of letters with marks where they are not at hand. Fixed values.
UNMARKED_GERMAN = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
UNMARKED = dict(zip("äöüßàâáãçéèêëíìîïñóòôõúùûœ", ["a", "o", "u", "ss", *"aaaaceeeeiiiinoooouuu", "oe"], strict=True))

_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_EDGES = "\"'“”„«»‘’()[]{}<>.,;:!?…*_#`|~-–—"
_ENDS = re.compile(r"[.!?…][\"'”»)\]]*$")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LATIN_LETTER = re.compile("[A-Za-zÀ-ɏ]")
_TO_CYRILLIC = str.maketrans({b: a for a, b in LOOKALIKES.items() if "Ѐ" <= a <= "ӿ" and len(b) == 1 and a not in "ёіїӏүһ"})
_TO_LATIN = str.maketrans({a: b for a, b in LOOKALIKES.items() if "Ѐ" <= a <= "ӿ"})

OTHER = "other"
SEGMENT_SCHEMA = "doc_id bigint, segment int, first_sentence int, last_sentence int, first_word int, last_word int, words int, lang string, confidence double"
DOCUMENT_SCHEMA = "doc_id bigint, lang string, sentences int, words int, confidence double, main boolean, languages int, running boolean"


@dataclass(frozen=True)
class LanguageSettings:
    per_language: int = 150  #: labelled documents per language that the model is trained on, at most
    buckets: int = 1 << 17  #: hashed features
    rounds: int = 60
    decay: float = 1e-5
    first_decay: float = 1e-4  #: of the fit that sorts documents: too stiff to learn single wrong labels by their rare words
    piece: int = 96  #: words of a training sequence
    mixtures: int = 600  #: training sequences that switch language at sentence ends
    phrases: int = 300  #: training sequences with a phrase of another language within a sentence
    sentence_words: int = 4  #: words of a whole sentence
    known_share: float = 0.35  #: of words in the lexicon, below which a language is one the model has not learned
    seed: int = 11


def label_code(column: Column | str) -> Column:
    """One of the languages' codes for any usual spelling; null for anything else."""
    column = F.col(column) if isinstance(column, str) else column
    name = F.regexp_replace(F.lower(F.btrim(column, F.lit(" \t\r\n "))), r"[-_].*$", "")
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(name.isin(*names), F.lit(code)).otherwise(out)
    return out


def one_script(word: str) -> str:
    """A lower-case word whose few letters of another script are read as the ones they are drawn like."""
    if word.isascii():
        return word
    cyrillic = len(_CYRILLIC.findall(word))
    if cyrillic:
        latin = len(_LATIN_LETTER.findall(word))
        if latin:
            return word.translate(_TO_CYRILLIC) if cyrillic >= latin else word.translate(_TO_LATIN)
    return word


def word_code(word: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(word))


def is_code(piece: str) -> bool:
    """Drawn like a ticker or model code: in capitals, four letters or more."""
    return len(piece) > 3 and piece.isupper()


def features(word: str, buckets: int) -> np.ndarray:
    """Hashed lexicon, prefix, suffix and n-gram features of a lower-case word."""
    framed = f"^{word}$"
    names = ["=" + word, *(f"<{word[:k]}" for k in (1, 2, 3, 4) if len(word) > k), *(f">{word[-k:]}" for k in (1, 2, 3, 4) if len(word) > k)]
    names += [framed[k : k + n] for n in (2, 3) for k in range(len(framed) - n + 1)]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x) % buckets for x in names], np.int64))


class Pieces:
    """Numbers for blank-separated pieces, with what the labeller needs to know of each."""

    def __init__(self, score, lexicon: np.ndarray | None = None, bound: int = 400_000) -> None:  # noqa: ANN001
        self.score, self.lexicon, self.bound = score, lexicon, bound
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.emission = np.zeros((1024, len(LANGUAGES)), np.float32)
        self.flags = np.zeros((1024, 4), bool)  # word, ends a sentence, may begin one, in the lexicon
        self.words: list[str] = []

    def _in_lexicon(self, word: str) -> bool:
        at = np.searchsorted(self.lexicon, word_code(word)) if self.lexicon is not None else 0
        return self.lexicon is not None and at < len(self.lexicon) and self.lexicon[at] == word_code(word)

    def _add(self, piece: str) -> int:
        number = self.known[piece] = len(self.words)
        if number >= len(self.emission):
            self.emission = np.concatenate([self.emission, np.zeros_like(self.emission)])
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
        core = piece.strip(_EDGES)
        word = one_script(core.lower()) if _WORD.fullmatch(core) else ""
        learned = bool(word) and self._in_lexicon(word)
        if is_code(core) and not learned:
            word = ""
        self.words.append(word)
        bare = piece.lstrip(_EDGES)
        begins = not bare or bare[0].isupper() or bare[0].isdigit()
        self.flags[number] = (bool(word), bool(_ENDS.search(piece)), begins, learned)
        if word and self.score is not None:
            self.emission[number] = self.score(word)
        return number

    def numbers(self, text: str) -> np.ndarray:
        if len(self.known) > self.bound:
            self.clear()
        pieces = text.split()
        out = list(map(self.known.get, pieces))
        if None in out:
            out = [self._add(p) if n is None and p not in self.known else self.known[p] for p, n in zip(pieces, out, strict=True)]
        return np.array(out, np.int64)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of a text's words, the sentence each is in and its place among the pieces."""
        at = self.numbers(text)
        if not len(at):
            return at, at, at
        flags = self.flags[at]
        ends = flags[:, 1].copy()
        ends[:-1] &= flags[1:, 2]
        sentence = np.concatenate([[0], np.cumsum(ends[:-1])])
        place = np.flatnonzero(flags[:, 0])
        return at[place], sentence[place], place


def forward_backward(emission: np.ndarray, across: np.ndarray, length: np.ndarray, weights: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """(posteriors, expected transitions, log-likelihood normaliser) of padded sequences.

    ``emission`` (n, t, k) scores; ``across`` (n, t) marks words that begin a new
    sentence; ``weights`` (2, k, k) transition scores within and across.
    """
    n, t, k = emission.shape
    # longest first and time outermost: every step works on one contiguous block of the sequences that are still running
    order = np.argsort(-length, kind="stable")
    e = np.ascontiguousarray(emission[order].transpose(1, 0, 2))
    top = e.max(axis=2, keepdims=True)
    e = np.exp(e - top)
    cross = np.ascontiguousarray(across[order].T)[:, :, None]
    running = (length[order] > np.arange(t)[:, None]).sum(axis=1)
    a = np.exp(weights)
    alpha, scale = np.zeros((t, n, k), e.dtype), np.ones((t, n), e.dtype)
    state = e[0] / k
    for j in range(t):
        m = running[j]
        state = state[:m]
        if j:
            state = np.where(cross[j, :m], state @ a[1], state @ a[0]) * e[j, :m]
        scale[j, :m] = total = state.sum(axis=1)
        alpha[j, :m] = state = state / total[:, None]
    beta, posterior = np.ones((n, k), e.dtype), np.zeros_like(alpha)
    expected = np.zeros((2, k, k)) if pairs else None
    for j in range(t - 1, -1, -1):
        m = running[j]
        posterior[j, :m] = alpha[j, :m] * beta[:m]
        if j:
            back = e[j, :m] * beta[:m] / scale[j, :m, None]
            if expected is not None:
                within = np.where(cross[j, :m], 0.0, back)
                expected[0] += a[0] * (alpha[j - 1, :m].T @ within)
                expected[1] += a[1] * (alpha[j - 1, :m].T @ (back - within))
            beta[:m] = np.where(cross[j, :m], back @ a[1].T, back @ a[0].T)
    inside = np.arange(n) < running[:, None]
    norm = float((np.log(scale) + top[:, :, 0])[inside].sum()) if pairs else 0.0
    out = np.empty_like(emission, dtype=posterior.dtype)
    out[order] = posterior.transpose(1, 0, 2)
    return out, expected, norm


Sequence_ = tuple[np.ndarray, np.ndarray, np.ndarray]  #: word types, sentence starts, labels


def quasi_newton(loss, start: np.ndarray, rounds: int, memory: int = 6) -> np.ndarray:  # noqa: ANN001
    """Minimum of a convex function by L-BFGS; every accepted step lowers the value."""
    x, (value, slope) = start, loss(start)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        direction = -slope
        factors = []
        for move, change, curve in reversed(pairs):
            factor = (move @ direction) / curve
            factors.append(factor)
            direction = direction - factor * change
        if pairs:
            move, change, curve = pairs[-1]
            direction *= curve / (change @ change)
        else:
            direction /= max(np.abs(slope).max(), 1e-12)
        for (move, change, curve), factor in zip(pairs, reversed(factors), strict=True):
            direction = direction + (factor - (change @ direction) / curve) * move
        down = slope @ direction
        if down >= 0:
            pairs, direction = [], -slope
            down = slope @ direction
        step = 1.0
        for _ in range(12):
            after, new = loss(x + step * direction)
            if after <= value + 1e-4 * step * down:
                break
            step /= 2
        else:
            break
        move, change = step * direction, new - slope
        curve = move @ change
        if curve > 1e-12:
            pairs = [*pairs, (move, change, curve)][-memory:]
        small = value - after < 1e-6 * max(abs(value), 1e-3)
        x, value, slope = x + move, after, new
        if small:
            break
    return x


def fit(words: Sequence[str], sequences: Sequence[Sequence_], settings: LanguageSettings, rounds: int, chained: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights (buckets, k) and transition weights (2, k, k) of greatest penalised likelihood; the latter stay 0 unless ``chained``."""
    k = len(LANGUAGES)
    lists = [features(w, settings.buckets) for w in words]
    used, column = np.unique(np.concatenate(lists), return_inverse=True)
    row = np.repeat(np.arange(len(words)), [len(x) for x in lists])
    t = max(len(s[0]) for s in sequences)
    n = len(sequences)
    types, across, labels = np.zeros((n, t), np.int64), np.zeros((n, t), bool), np.full((n, t), -1, np.int64)
    length = np.array([len(s[0]) for s in sequences])
    for j, (a, b, c) in enumerate(sequences):
        types[j, : len(a)], across[j, : len(a)], labels[j, : len(a)] = a, b, c
    across[:, 0] = False
    inside = labels >= 0
    gold_pairs = np.zeros((2, k, k))
    both = inside[:, 1:] & inside[:, :-1]
    np.add.at(gold_pairs, (across[:, 1:][both].astype(int), labels[:, :-1][both], labels[:, 1:][both]), 1.0)
    seen_types = types[inside]
    gold_types = np.zeros((len(words), k))
    np.add.at(gold_types, (seen_types, labels[inside]), 1.0)
    total, size = inside.sum(), len(used) * k

    def loss(point: np.ndarray) -> tuple[float, np.ndarray]:
        """Penalised negative log-likelihood per word, and its slope."""
        weight, trans = point[:size].reshape(-1, k), point[size:].reshape(2, k, k)
        scores = np.stack([np.bincount(row, weight[column, c], len(words)) for c in range(k)], axis=1)
        posterior, expected, norm = forward_backward(scores[types].astype(np.float32), across, length, trans.astype(np.float32), True)
        mass = posterior[inside]
        seen = np.stack([np.bincount(seen_types, mass[:, c], len(words)) for c in range(k)], axis=1)
        slope = seen - gold_types
        by_feature = np.stack([np.bincount(column, slope[row, c], len(used)) for c in range(k)], axis=1)
        value = (norm - (gold_types * scores).sum() - (gold_pairs * trans).sum()) / total + settings.decay / 2 * (point @ point)
        between = (expected - gold_pairs).ravel() * chained
        return float(value), np.concatenate([by_feature.ravel(), between]) / total + settings.decay * point

    best = quasi_newton(loss, np.zeros(size + 2 * k * k), rounds)
    weight, trans = best[:size].reshape(-1, k), best[size:].reshape(2, k, k)
    full = np.zeros((settings.buckets, k), np.float32)
    full[used] = weight
    return full, trans.astype(np.float32)


def _padded(pieces: list[np.ndarray], fill: float = 0) -> np.ndarray:
    out = np.full((len(pieces), max(map(len, pieces))), fill, pieces[0].dtype)
    for k, x in enumerate(pieces):
        out[k, : len(x)] = x
    return out


def posteriors(emission: np.ndarray, texts: list[np.ndarray], starts: list[np.ndarray], trans: np.ndarray, width: int = 128, most_words: int = 1 << 18) -> list[np.ndarray]:
    """Word posteriors of each text; texts of like length run side by side, as many as fit ``most_words`` padded words."""
    out: list[np.ndarray] = [np.zeros((0, len(LANGUAGES)), np.float32)] * len(texts)
    order = [k for k in np.argsort([len(x) for x in texts], kind="stable").tolist() if len(texts[k])]
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and last - first < width and (last - first + 1) * len(texts[order[last]]) <= most_words:
            last += 1
        part = order[first:last]
        first = last
        length = np.array([len(texts[k]) for k in part])
        found, _, _ = forward_backward(emission[_padded([texts[k] for k in part])], _padded([starts[k] for k in part]), length, trans)
        for j, k in enumerate(part):
            out[k] = found[j, : length[j]]
    return out


def _starts(sentence: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sentence), bool)
    new[1:] = sentence[1:] != sentence[:-1]
    return new


def untyped(word: str, language: str) -> str:
    """The word as typed where the language's usual letters are not at hand."""
    if language in ("ru", "uk"):
        own = LATIN_UKRAINIAN if language == "uk" else {}
        return "".join(own.get(c, LATIN.get(c, c)) for c in word)
    own = UNMARKED_GERMAN if language == "de" else {}
    return "".join(own.get(c, UNMARKED.get(c, c)) for c in word)


def _agrees(scores: np.ndarray, sentence: np.ndarray, label: int) -> bool:
    """A text bears its label out if nine of ten words stand in sentences that score highest for it; mixed texts do not."""
    edge = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    own = np.add.reduceat(scores, edge, axis=0).argmax(axis=1) == label
    return float(np.diff([*edge, len(sentence)])[own].sum()) >= 0.9 * len(sentence)


def _own_words(a: np.ndarray, sentence: np.ndarray, scores: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
    """A text without the runs of two or more words that score higher for another language than its own: phrases quoted in it."""
    strange = scores.argmax(axis=1) != label
    edge = np.flatnonzero(np.concatenate([[True], strange[1:] != strange[:-1]]))
    keep = ~strange | np.repeat(np.diff([*edge, len(a)]) < 2, np.diff([*edge, len(a)]))
    return a[keep], sentence[keep]


Model = tuple[np.ndarray, np.ndarray, np.ndarray]  #: feature weights, transition weights, sorted codes of the words learned


def train(sample: Sequence[tuple[str, str]], settings: LanguageSettings) -> Model:
    """Model from (text, delivered language) pairs; some of the languages are wrong, some texts mixed."""
    k, rng = len(LANGUAGES), np.random.default_rng(settings.seed)
    reader = Pieces(None, bound=1 << 60)
    texts = [(reader.read(readable(text))[:2], LANGUAGES.index(lang)) for text, lang in sample]
    texts = [((a, s), y) for (a, s), y in texts if len(a)]
    if not texts:
        return np.zeros((settings.buckets, k), np.float32), np.zeros((2, k, k), np.float32), np.zeros(0, np.uint64)

    def cut(a: np.ndarray, new: np.ndarray, y: np.ndarray) -> Iterator[Sequence_]:
        for first in range(0, len(a), settings.piece):
            yield a[first : first + settings.piece], new[first : first + settings.piece], y[first : first + settings.piece]

    plain = [s for (a, s), y in texts for s in cut(a, _starts(s), np.full(len(a), y))]
    # words one by one: in a chain of one label a whole text would settle them, and wrong labels with it
    weight, trans = fit(reader.words, plain, replace(settings, decay=settings.first_decay), settings.rounds // 2, chained=False)
    scores = np.stack([weight[features(w, settings.buckets)].sum(axis=0) if w else np.zeros(k, np.float32) for w in reader.words])
    sound = [(_own_words(a, s, scores[a], y), y) for (a, s), y in texts if _agrees(scores[a], s, y)]
    # what mostly stands in capitals is a code, however it is typed at times
    as_code, as_word = Counter(), Counter()
    for text, _ in sample:
        for piece in readable(text).split():
            core = piece.strip(_EDGES)
            (as_code if is_code(core) else as_word)[core.lower()] += 1
    codes = {one_script(w) for w, n in as_code.items() if n >= as_word[w]}
    lexicon = lambda words: np.unique(np.array([word_code(w) for w in words if w and w not in codes], np.uint64))
    if not sound:
        return weight, trans, lexicon(reader.words)
    # word types again with copies typed without the usual letters
    numbers: dict[str, int] = {w: n for n, w in enumerate(reader.words) if w}
    words = list(reader.words)

    def copy(a: np.ndarray, language: int) -> np.ndarray:
        out = []
        for n in a:
            word = untyped(words[n], LANGUAGES[language])
            if word not in numbers:
                numbers[word] = len(words)
                words.append(word)
            out.append(numbers[word])
        return np.array(out, np.int64)

    sequences: list[Sequence_] = []
    by_language: dict[int, list[np.ndarray]] = {}
    for (a, s), y in sound:
        other = copy(a, y) if rng.random() < 0.3 and LANGUAGES[y] != "en" else None
        sequences += cut(a, _starts(s), np.full(len(a), y))
        if other is not None:
            sequences += cut(other, _starts(s), np.full(len(a), y))
        whole = a if other is None or rng.random() < 0.5 else other
        by_language.setdefault(y, []).extend(x for x in np.split(whole, np.flatnonzero(_starts(s))) if len(x) >= settings.sentence_words)
    there = [y for y, x in by_language.items() if x]
    pick = lambda language: by_language[language][rng.integers(len(by_language[language]))]
    for _ in range(settings.mixtures if len(there) > 1 else 0):
        a, new, y = [], [], []
        for language in rng.permutation(there)[: rng.integers(2, 4)]:
            for _ in range(rng.integers(2, 5)):
                part = pick(language)
                a.append(part)
                new.append(np.arange(len(part)) == 0)
                y.append(np.full(len(part), language))
        sequences += cut(np.concatenate(a), np.concatenate(new), np.concatenate(y))
    for _ in range(settings.phrases if len(there) > 1 else 0):
        language, foreign = rng.permutation(there)[:2]
        before, around, after, phrase = pick(language), pick(language), pick(language), pick(foreign)
        low = int(rng.integers(len(phrase)))
        phrase, at = phrase[low : low + int(rng.integers(2, 9))], int(rng.integers(1, len(around) + 1))
        a = [before, around[:at], phrase, around[at:], after]
        new = np.zeros(sum(map(len, a)), bool)
        new[[0, len(before), len(new) - len(after)]] = True
        sequences += cut(np.concatenate(a), new, np.concatenate([np.full(len(x), foreign if k == 2 else language) for k, x in enumerate(a)]))
    return *fit(words, sequences, settings, settings.rounds), lexicon(words)


def training_sample(documents: DataFrame, settings: LanguageSettings) -> DataFrame:
    """(place, doc_id, text, code): some ``per_language`` labelled documents per language, by a hash of the id, in one partition."""
    labelled = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", label_code("lang").alias("code")).where("code is not null and text is not null")
    counts = {r["code"]: r["n"] for r in documents.select(label_code("lang").alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit(1 << 30))
    chosen = F.lit(False)
    for code, n in sorted(counts.items()):
        chosen = chosen | ((F.col("code") == code) & (place < int(min(1.0, settings.per_language / n) * (1 << 30))))
    rows = labelled.where(chosen).select(place.alias("place"), "doc_id", "text", "code")
    return rows.orderBy("place", "doc_id").limit(2 * settings.per_language * len(LANGUAGES)).coalesce(1)


def trained(documents: DataFrame, settings: LanguageSettings) -> Model:
    """The model, fitted by one task on the sample; what comes to the driver is the model."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        sample = []
        for batch in batches:
            for _, doc, text, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept[code] = kept.get(code, 0) + 1
                if kept[code] <= settings.per_language:
                    sample.append((doc, text, code))
        weight, trans, lexicon = train([(text, code) for _, text, code in sorted(sample)], settings)
        used = np.flatnonzero(weight.any(axis=1)).astype(np.int32)
        parts = [x.tobytes() for x in (used, weight[used], trans, lexicon)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["used", "weight", "trans", "lexicon"])

    k = len(LANGUAGES)
    rows = training_sample(documents, settings).mapInArrow(learn, "used binary, weight binary, trans binary, lexicon binary").collect()
    weight, trans, lexicon = np.zeros((settings.buckets, k), np.float32), np.zeros((2, k, k), np.float32), np.zeros(0, np.uint64)
    for row in rows:
        weight[np.frombuffer(row["used"], np.int32)] = np.frombuffer(row["weight"], np.float32).reshape(-1, k)
        trans, lexicon = np.frombuffer(row["trans"], np.float32).reshape(2, k, k), np.frombuffer(row["lexicon"], np.uint64)
    return weight, trans, lexicon


def _labelled(documents: DataFrame, settings: LanguageSettings, rows_of, schema: str) -> DataFrame:  # noqa: ANN001
    """Runs the model over all texts; ``rows_of`` makes a text's rows of (sentence, place, posterior, learned)."""
    model = documents.sparkSession.sparkContext.broadcast(trained(documents, settings))
    fields = [x.split() for x in schema.split(", ")]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[t] for _, t in fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, trans, lexicon = model.value
        pieces = Pieces(lambda word: weight[features(word, settings.buckets)].sum(axis=0), lexicon)
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                docs, texts, sentences, places = [], [], [], []
                if len(pieces.known) > pieces.bound:
                    pieces.clear()
                bound, pieces.bound = pieces.bound, 1 << 60  # numbers stay valid within a batch
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text and _LETTER.search(text):
                        a, s, place = pieces.read(readable(text))
                        docs.append(doc)
                        texts.append(a)
                        sentences.append(s)
                        places.append(place)
                pieces.bound = bound
                found = posteriors(pieces.emission, texts, [_starts(s) for s in sentences], trans)
                rows = [(doc, *row) for doc, a, s, w, p in zip(docs, texts, sentences, places, found, strict=True) for row in rows_of(s, w, p, pieces.flags[a, 3], settings)]
                columns = list(zip(*rows, strict=True)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[n for n, _ in fields])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(read, schema)


def label_segments(documents: DataFrame, settings: LanguageSettings | None = None) -> DataFrame:
    """(doc_id, segment, first and last sentence and word, words, lang, confidence) of every stretch of words in one language."""
    return _labelled(documents, settings or LanguageSettings(), segments_of, SEGMENT_SCHEMA)


def document_languages(documents: DataFrame, settings: LanguageSettings | None = None) -> DataFrame:
    """(doc_id, lang, sentences, words, confidence, main, languages, running): each language of which a document has two whole sentences, and its main one.

    ``sentences`` counts whole sentences; the main language is the one with the
    most words; ``running`` says whether the document has a whole sentence.
    """
    return _labelled(documents, settings or LanguageSettings(), languages_of, DOCUMENT_SCHEMA)


def _learned_or_other(language: int, mass: float, words: int, known: int, settings: LanguageSettings) -> tuple[str, float]:
    if known < settings.known_share * words or not words:
        return OTHER, 1 - known / words if words else 0.0
    return LANGUAGES[language], min(1.0, mass / words)


def segments_of(sentence: np.ndarray, place: np.ndarray, posterior: np.ndarray, learned: np.ndarray, settings: LanguageSettings) -> list[tuple]:
    """Runs of a text's words with one most probable language; runs of languages not learned join."""
    if not len(sentence):
        return [(0, 0, 0, 0, 0, 0, OTHER, 0.0)]
    label = posterior.argmax(axis=1)
    first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    last = np.concatenate([first[1:], [len(label)]]) - 1
    mass = np.add.reduceat(posterior[np.arange(len(label)), label], first)
    known = np.add.reduceat(learned.astype(np.int64), first)
    # what a run is counts with the sentences it lies in: a strange name within a known sentence is no language
    edge = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    size = np.diff([*edge, len(sentence)])
    share = np.repeat(np.add.reduceat(learned.astype(np.int64), edge) / size, size)
    runs: list[list] = []
    for a, b, m, n in zip(first.tolist(), last.tolist(), mass.tolist(), known.tolist(), strict=True):
        strange = share[a : b + 1].mean() < settings.known_share
        lang = OTHER if strange else LANGUAGES[label[a]]
        if runs and runs[-1][0] == lang:
            runs[-1][2:] = [b, runs[-1][3] + m, runs[-1][4] + n]
        else:
            runs.append([lang, a, b, m, n])
    out = []
    for k, (lang, a, b, m, n) in enumerate(runs):
        words = b - a + 1
        confidence = 1 - n / words if lang == OTHER else min(1.0, m / words)
        out.append((k, int(sentence[a]), int(sentence[b]), int(place[a]), int(place[b]), words, lang, confidence))
    return out


def languages_of(sentence: np.ndarray, place: np.ndarray, posterior: np.ndarray, learned: np.ndarray, settings: LanguageSettings) -> list[tuple]:
    """The languages of a text; sentences with too few words count with the whole one before them (the first ones with the one after)."""
    if not len(sentence):
        return [(OTHER, 0, 0, 0.0, True, 1, False)]
    edge = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    size = np.diff([*edge, len(sentence)])
    mean, known = np.add.reduceat(posterior, edge, axis=0), np.add.reduceat(learned.astype(np.int64), edge)
    whole = size >= settings.sentence_words
    language = mean.argmax(axis=1)
    if whole.any():
        at = np.maximum.accumulate(np.where(whole, np.arange(len(edge)), -1))
        language = language[np.where(at < 0, np.argmax(whole), at)]
    else:
        language[:] = mean.sum(axis=0).argmax()
    rows: dict[str, list] = {}
    for code in np.unique(language).tolist():
        mine = language == code
        words = int(size[mine].sum())
        lang, confidence = _learned_or_other(code, float(mean[mine, code].sum()), words, int(known[mine].sum()), settings)
        row = rows.setdefault(lang, [0, 0, 0.0])
        rows[lang] = [row[0] + int((mine & whole).sum()), row[1] + words, row[2] + confidence * words]
    main = max(rows, key=lambda x: (rows[x][1], x))
    kept = [x for x in rows if x == main or rows[x][0] >= 2]
    return [(x, rows[x][0], rows[x][1], rows[x][2] / rows[x][1], x == main, len(kept), bool(whole.any())) for x in kept]


def label_findings(documents: DataFrame, languages: DataFrame) -> DataFrame:
    """Languages of the documents with running text whose label is missing or wrong or which mix languages."""
    given = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), label_code("lang").alias("given"))
    joined = languages.where(F.col("running") & (F.col("lang") != OTHER)).join(given, "doc_id")
    return joined.where(F.col("given").isNull() | (F.col("languages") > 1) | (F.col("given") != F.col("lang"))).select("doc_id", "lang").distinct()
