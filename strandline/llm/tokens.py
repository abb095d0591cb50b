"""Token counts of whole texts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte-level BPE for many languages; any rank file of the same format will do.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: The usual splitting pattern of byte-level BPE vocabularies. Fixed value.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts are encoded in stretches of about so many characters, cut at blanks.
STRETCH = 1 << 16


@lru_cache(maxsize=2)
def encoder_of(vocabulary: bytes):  # noqa: ANN201
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str):  # noqa: ANN201
    with open(path, "rb") as file:
        return encoder_of(file.read())


def _stretches(text: str) -> Iterator[str]:
    """Cuts before a blank that follows a non-blank, where the pattern cuts as well: counts stay those of the whole."""
    start = 0
    while len(text) - start > STRETCH:
        at = start + STRETCH
        while at < len(text) and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1 : at + 2].isspace()):
            at += 1
        yield text[start:at]
        start = at
    yield text[start:]


def count_tokens(frame: DataFrame, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The frame without ``text`` and with ``tokens``: 0 for null and empty texts.

    The vocabulary file is read on the driver and sent to the tasks: some
    megabytes, and workers need no file of their own.
    """
    with open(vocabulary, "rb") as file:
        ranks = frame.sparkSession.sparkContext.broadcast(file.read())
    kept = [c for c in frame.columns if c != text]
    schema = frame.select(*kept, F.lit(0).cast("bigint").alias("tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(ranks.value).encode_ordinary
        for batch in batches:
            counts = [sum(len(encode(part)) for part in _stretches(x)) if x else 0 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names=[*kept, "tokens"])

    return frame.select(text, *kept).mapInArrow(count, schema)
