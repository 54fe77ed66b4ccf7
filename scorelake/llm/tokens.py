"""Encoding of a corpus by a public byte-level BPE vocabulary, by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can't be joined by any merge, so
every encoding has a boundary there. Texts are split at all such pairs whose neighbourhood also
leaves the pre-tokenizer's pattern unaffected, each different fragment is encoded once, and the ids
of a text are the concatenation of those of its fragments. Fragments are short and repeat often, so
a task encodes far fewer bytes than it reads.

The pattern looks across a boundary in two cases only, and there no cut is made: after white space
(a run of blanks gives its last one to the next word) and beside an apostrophe (contractions), unless
the apostrophe follows an ASCII letter or digit, where a new match starts anyway.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's texts are split into words first.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Different fragments that a Python worker keeps encoded; beyond, it starts anew.
KEPT_FRAGMENTS = 400_000
#: Bytes that are cut and encoded at a time.
WINDOW = 8 << 20


def read_ranks(folder: str, vocabulary: str) -> dict[bytes, int]:
    with open(f"{folder}/{vocabulary}", "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def cut_table(tokens: list[bytes]) -> np.ndarray:
    """For a pair of bytes, whether a text may be cut between them."""
    cut = np.ones((256, 256), bool)
    joined = np.frombuffer(b"".join(t + b"\n" for t in tokens), np.uint8)
    inside = np.ones(len(joined), bool)
    lengths = np.array([len(t) + 1 for t in tokens])
    ends = np.cumsum(lengths)
    inside[ends - 1] = False  # the separators
    pair = inside[:-1] & inside[1:]
    cut[joined[:-1][pair], joined[1:][pair]] = False
    cut[:, 0x80:0xC0] = False  # inside a character
    # White space in front: ASCII, and the last bytes of the other white-space characters.
    cut[[*range(9, 14), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
    word = np.zeros(256, bool)
    word[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    cut[~word, 0x27] = False
    cut[0x27] = False
    return cut


@lru_cache(maxsize=4)
def _encoder(folder: str, vocabulary: str):
    import tiktoken

    ranks = read_ranks(folder, vocabulary)
    encoding = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, cut_table(list(ranks)), {}


def _encode_window(data: np.ndarray, bounds: np.ndarray, encoding, kept: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the fragments between ``bounds``, one after the other, and the number of ids in front of each bound."""
    pieces = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    if len(kept) > KEPT_FRAGMENTS:
        kept.clear()
    ids = []
    for piece in pieces.dictionary.to_pylist():
        own = kept.get(piece)
        if own is None:
            own = kept[piece] = np.array(encoding.encode_ordinary(piece.decode()), np.int32)
        ids.append(own)
    sizes = np.array([len(x) for x in ids], np.int64)
    flat, first = np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    which = pieces.indices.to_numpy()
    counts = sizes[which]
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1]) + np.repeat(first[which] - (ends - counts), counts)], np.concatenate([[0], ends])


def encode_texts(texts: pa.StringArray, folder: str, vocabulary: str) -> pa.ListArray:
    """Token ids of each text; empty lists for empty and null texts.

    The texts of a batch are one run of bytes, cut at the starts of texts and at forced boundaries
    and taken in windows of bounded size, so neither many nor very long texts need much memory.
    """
    encoding, cut, kept = _encoder(folder, vocabulary)
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    starts = offsets - offsets[0]
    total = int(starts[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if total else np.zeros(0, np.uint8)
    before, parts, done, lo = np.zeros(len(starts), np.int64), [], 0, 0
    while lo < total:
        size = WINDOW
        while True:
            hi = min(lo + size, total)
            mark = np.zeros(hi - lo + 1, bool)
            mark[0] = True
            mark[1:-1] = cut[data[lo : hi - 1], data[lo + 1 : hi]]
            i, j = np.searchsorted(starts, [lo, hi + 1])
            mark[starts[i:j] - lo] = True
            bounds = np.flatnonzero(mark)
            if hi == total or len(bounds) > 1:
                break
            size *= 2  # no boundary so far
        window = data[lo : lo + bounds[-1]]
        ids, ahead = _encode_window(window, bounds, encoding, kept)
        i, j = np.searchsorted(starts, [lo, lo + bounds[-1] + 1])
        before[i:j] = done + ahead[np.searchsorted(bounds, starts[i:j] - lo)]
        parts.append(ids)
        done += len(ids)
        lo += int(bounds[-1])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(flat, pa.int32()))


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``ids`` (array of int): the ids of each whole text, without special tokens.

    Null and empty texts give an empty list. Strings that look like special tokens are ordinary
    text. Rows keep their number and partitioning: there is no shuffle, and repeated rows, ties and
    further columns don't matter.
    """
    slim = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = slim.select(*keep, F.array().cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("__text")
            if not pa.types.is_string(column.type):
                column = column.cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), encode_texts(column, folder, vocabulary)], [*keep, "ids"])

    return slim.mapInArrow(run, schema)


def token_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``n_tokens``: the length of each text in tokens (0 for null and empty)."""
    return encode(df, text, keep, folder, vocabulary).select(*keep, F.size("ids").cast("long").alias("n_tokens"))
