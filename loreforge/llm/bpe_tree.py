"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved recursively down to leaves, which are encoded on their own.
Two neighbours are joined by re-encoding a window across their boundary that
grows on either side until the tokens outside it provably don't change.

Why the window's edges are safe: the pattern cuts a text into matches from left
to right, each decided by the text after the last one only, and no match goes on
over a white space once it has taken another character.  So wherever a
non-space is followed by a white space, every encoding of every text around
that place starts a match there (``is_seam``), and tokens never cross matches.
Between two seams the window is therefore encoded as it would be inside the
whole text, and the tokens before the left and after the right seam stay.  A
half without a seam is in the window as a whole; then both are re-encoded.

Decoding is the same tree: the bytes of both halves are concatenated.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import bounded_batches, slices, table, text_or_empty

LEAF_CHARS = 8192
WINDOW_CHARS = 64
#: What ``\s`` matches in the encoder's regular expressions (Unicode White_Space).
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_seam(text: str, at: int) -> bool:
    """Whether a match starts at ``at`` whatever the text before and after is."""
    return text[at] in SPACES and text[at - 1] not in SPACES


def seam_before(text: str, end: int, reach: int) -> int:
    """The first seam at or after ``end - reach``, the reach doubled until there is one; 0 if there is none."""
    low = end
    while low > 0:
        low, high = max(0, end - reach), low
        for at in range(max(low, 1), high):
            if is_seam(text, at):
                return at
        reach *= 2
    return 0


def seam_after(text: str, reach: int) -> int:
    """The last seam before ``reach``, the reach doubled until there is one; the text's length if there is none."""
    high = 1
    while high < len(text):
        low, high = high, min(len(text), reach)
        for at in range(high - 1, low - 1, -1):
            if is_seam(text, at):
                return at
        high, reach = max(high, low), reach * 2
    return len(text)


def encode_tree(text: str, encode, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> array:
    """The ids of a whole text; ``encode`` gives the ids of a leaf or a window."""
    if len(text) <= leaf:
        return array("I", encode(text))
    half = len(text) // 2
    left, right = text[:half], text[half:]
    return join(left, encode_tree(left, encode, leaf, window), right, encode_tree(right, encode, leaf, window), encode, window)


def join(left: str, left_ids: array, right: str, right_ids: array, encode, window: int = WINDOW_CHARS) -> array:
    """The monoid's operation: the ids of ``left + right`` from those of both."""
    if not left or not right:
        return left_ids + right_ids
    start, end = seam_before(left, len(left), window), seam_after(right, window)
    stale_left = len(encode(left[start:])) if start else len(left_ids)
    stale_right = len(encode(right[:end])) if end < len(right) else len(right_ids)
    middle = array("I", encode(left[start:] + right[:end]))
    return left_ids[: len(left_ids) - stale_left] + middle + right_ids[stale_right:]


def decode_tree(ids, decode, leaf: int = LEAF_CHARS) -> bytes:
    """The bytes of a whole id sequence, concatenated up the tree."""
    if len(ids) <= leaf:
        return decode(list(ids))
    half = len(ids) // 2
    return decode_tree(ids[:half], decode, leaf) + decode_tree(ids[half:], decode, leaf)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_column(df: DataFrame, key: list[str], text: str = "text", *, ranks: str | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns the ``key`` columns as they are, ``n_tokens`` long, ``ids`` binary
    (little-endian unsigned 32-bit) and ``decoded`` binary.  A null text is an
    empty one, with no ids.  Rows are independent: repeated rows, ties and other
    columns change nothing, an empty table gives an empty one.  Special tokens'
    strings in a text are ordinary text.  ``ranks`` may name another vocabulary; the
    pattern is the public one, for which ``is_seam`` holds.
    """
    path, pat = default_ranks()
    path = ranks or path
    src = bounded_batches(df).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], text_or_empty(text).alias("body"))
    kinds = ", ".join(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pat)
        for batch in batches:
            for part in slices(batch, 256):
                n, ids, decoded = [], [], []
                for body in part.column("body").to_pylist():
                    got = encode_tree(body, enc.encode_ordinary, leaf)
                    n.append(len(got))
                    ids.append(got.tobytes())
                    decoded.append(decode_tree(got, enc.decode_bytes))
                made = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(key)], *made], names=[*[f"k{i}" for i in range(len(key))], "n_tokens", "ids", "decoded"])

    out = src.mapInArrow(run, f"{kinds}, n_tokens bigint, ids binary, decoded binary")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], "n_tokens", "ids", "decoded")


def encoded(spark, docs, sf_dir):
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256 and decoded_sha256 of every document."""
    out = encode_column(docs, ["doc_id"])
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe_tree(spark, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    out = encode_column(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
