"""Reading a text through its markup, encoding and lookalike letters."""

from __future__ import annotations

import html
import re
import unicodedata

#: Lower-case letters of other scripts and the Latin letter they are drawn like. Fixed values.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ү": "y", "х": "x", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe",
}

_FOLD = str.maketrans(LOOKALIKES)
_BLOCK_TAG = re.compile(r"<\s*/?\s*(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|blockquote|pre)\b[^<>]*>", re.IGNORECASE)
_TAG = re.compile(r"<\s*/?\s*[A-Za-z!][^<>]*>")
_LINE_MARK = re.compile(r"^[ \t]*(?:[>|]+[ \t]*)+", re.MULTILINE)
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\r?\n[ \t]*(?=[^\W\d_])")
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_MARKS = re.compile("[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿︠-︯]")
_DROPPED = re.compile(r"[^\w\s]|_")


def readable(text: str) -> str:
    """The text as a reader sees it: no entities, tags, line marks, hidden characters or words broken at line ends."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "\n" in text:
        if ">" in text or "|" in text:
            text = _LINE_MARK.sub("", text)
        if "-\n" in text or "-\r" in text or "‐" in text or "‑" in text:
            text = _BROKEN.sub("", text)
    elif text[:1] in ">|":
        text = _LINE_MARK.sub("", text)
    return text


def bare_word(chunk: str) -> str:
    """A blank-free piece without case, accents and punctuation, lookalike letters folded; empty for bare punctuation."""
    if not chunk.isascii():
        chunk = _MARKS.sub("", unicodedata.normalize("NFKD", chunk))
    chunk = chunk.casefold()
    if not chunk.isascii():
        chunk = chunk.translate(_FOLD)
    return _DROPPED.sub("", chunk)


def bare_words(text: str) -> list[str]:
    """The bare words of a text as a reader sees it."""
    return [word for word in map(bare_word, readable(text).split()) if word]
