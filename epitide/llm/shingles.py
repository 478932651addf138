"""Word shingles of Arrow text as sorted sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from epitide.llm.common import Ranges, lower, mix, splitmix, text_chunks, word_spans

PLACE = splitmix(64, 23) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """The distinct `words`-word shingles of each row, lower-cased (A-Z); with fewer words, the whole sequence as one."""
    for _, data, at in text_chunks(column):
        low = lower(data)
        starts, ends, before = word_spans(low, at)
        hashes = Ranges(low).of(starts, ends)
        n = len(hashes)
        grams = np.zeros(max(0, n - words + 1), np.uint64)
        for j in range(words):
            grams += hashes[j : j + len(grams)] * PLACE[j]
        grams = mix(grams)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                yield mix((hashes[a:b] * PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + PLACE[words + b - a])
            else:
                yield np.zeros(0, np.uint64)
