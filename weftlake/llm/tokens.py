"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 8).

A text is encoded as a tree reduction over the monoid of (text, ids): halves are encoded recursively down to leaves, and
two neighbours are joined by re-encoding only a window around their border. The window grows until the ids outside it
are provably those of the joined text:

* To the left it begins where a piece of the splitting pattern must begin whatever follows (a change from non-white
  space to white space, or the end of a run of letters or digits). The pattern never looks back, so the pieces before
  that place are the same in the left text and in the joined text.
* To the right it ends at the first place where a piece of the joined text and a piece of the right text both end. From
  there on both are split alike, as matching only depends on what follows. A piece near the window's own end does not
  count, as the pattern looks up to three characters ahead, nor does one of white space, whose split depends on what
  comes after it.

Decoding is the concatenation of the ids' bytes.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public splitting pattern of the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECES = regex.compile(PATTERN)
_FIRM = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")
AHEAD = 3
LEAF = 2048


@functools.lru_cache(4)
def encoding_of(data: bytes):
    """The vocabulary of the lines of a rank file; built once per Python process."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str = VOCABULARY):
    """The vocabulary of a rank file."""
    return encoding_of(read(path))


def read(path: str) -> bytes:
    """A rank file, read where the job is planned: it travels with the job, so workers need no copy of it."""
    with open(path, "rb") as lines:
        return lines.read()


def _firm_start(left: str, width: int) -> int:
    """The last place within width characters of the end where a piece must begin; 0 if there is none."""
    low = max(0, len(left) - width)
    last = 0
    for m in _FIRM.finditer(left, max(0, low - 1)):
        if low < m.start() < len(left):
            last = m.start()
    return last


def _common_end(window: str, offset: int, right: str, whole: bool) -> int | None:
    """The first place in right where pieces of window (right begins at offset in it) and of right itself both end."""
    n = len(window) - offset
    sure = n if whole else n - AHEAD
    own = {0}
    for m in _PIECES.finditer(right, 0, n):
        if m.end() <= sure:
            own.add(m.end())
    for m in _PIECES.finditer(window):
        end = m.end() - offset
        if 0 <= end <= sure and end in own and (not window[m.end() - 1].isspace() or (whole and end == n)):
            return end
    return None


def join(enc, left: str, left_ids: list[int], right: str, right_ids: list[int], width: int = 64) -> list[int]:
    """The ids of left + right, from those of left and right."""
    if not left or not right:
        return left_ids + right_ids
    while True:
        start = _firm_start(left, width)
        whole = width >= len(right)
        if start or width >= len(left):
            end = _common_end(left[start:] + right[:width], len(left) - start, right, whole)
            if end is not None:
                break
        if width >= len(left) and whole:
            return enc.encode_ordinary(left + right)
        width *= 4
    kept = len(left_ids) - len(enc.encode_ordinary(left[start:]))
    dropped = len(enc.encode_ordinary(right[:end]))
    return left_ids[:kept] + enc.encode_ordinary(left[start:] + right[:end]) + right_ids[dropped:]


def encode(enc, text: str, leaf: int = LEAF) -> list[int]:
    """The ids of a text by recursive halving."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    middle = len(text) // 2
    left, right = text[:middle], text[middle:]
    return join(enc, left, encode(enc, left, leaf), right, encode(enc, right, leaf))


def decode(enc, ids: list[int]) -> str:
    """The text of the ids: halves decode to bytes that are concatenated up the tree, then read as UTF-8."""

    def raw(part: list[int]) -> bytes:
        if len(part) <= LEAF:
            return enc.decode_bytes(part)
        return raw(part[: len(part) // 2]) + raw(part[len(part) // 2 :])

    return raw(ids).decode("utf-8", errors="replace")


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(id, ids array<int>) for every row. An empty text and a null text both get an empty list; a null id stays null.

    Only the two named columns are read; others, whatever their names, play no part. Texts of any length are encoded
    whole. One pass, no shuffle; repeated rows give repeated rows.
    """
    id_type, data = df.schema[id_col].dataType.simpleString(), read(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding_of(data)
        kind = pa.list_(pa.int32())
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                ids = [encode(enc, t, leaf) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, kind)], names=["id", "ids"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode_corpus(df: DataFrame, id_col: str, ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) for every row of ids; null ids give a null text."""
    id_type, data = df.schema[id_col].dataType.simpleString(), read(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding_of(data)
        for batch in batches:
            texts = [None if x is None else decode(enc, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens) for every row: the number of ids that `encode_corpus` gives; the ids do not leave the worker."""
    id_type, data = df.schema[id_col].dataType.simpleString(), read(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding_of(data)
        for batch in batches:
            sizes = [len(encode(enc, t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "tokens"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {id_type}, tokens long").withColumnRenamed("id", id_col)
