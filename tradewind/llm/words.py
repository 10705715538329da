"""Words of whole texts as hashes: A-Z in lower case, cut at ``[\\x20\\x09-\\x0D]+``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from tradewind.llm.shared import give_back

BLOCK_CHARS = 6_000_000


def blocks(texts: pa.Array, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts without nulls) of a bounded number of characters, or one text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars, "right")))
        yield at, texts.slice(at, to - at)
        at = to
        give_back()


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in turn, ends of the texts) of a block without nulls."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    # A text without words gives one empty piece.
    sizes[pc.binary_length(pc.ascii_trim_whitespace(texts)).to_numpy(zero_copy_only=False) == 0] = 0
    flat = pc.list_flatten(lists)
    if sizes.sum() != len(flat):
        flat = flat.filter(pc.not_equal(flat, ""))
    codes = pc.dictionary_encode(flat)
    return codes.dictionary, codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes)


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of k words; the whole text if it has fewer words, nothing if it has none."""
    words, codes, ends = word_codes(texts)
    word = hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    runs = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        runs = mixed(runs + word[j : j + len(runs)] + np.uint64(j))
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a >= k:
            some = np.sort(runs[a : b - k + 1])
            out.append(some[np.concatenate([[True], some[1:] != some[:-1]])])
        elif b > a:
            h = np.full(1, b - a, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for j in range(a, b):
                h = mixed(h + word[j])
            out.append(h)
        else:
            out.append(runs[:0])
    return out
