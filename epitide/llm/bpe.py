"""Byte-level BPE encoding and decoding by merge replay over a block of documents.

A block is a run of whole rows of one Arrow batch, BLOCK_BYTES of text or one longer row. Its distinct pieces (matches
of the split pattern) are laid out byte by byte in chains of at most CHAIN_BYTES or one longer piece; an inverted index
maps the rank of every mergeable pair to the positions where it stands. The lowest rank is taken again and again, its
positions merge, and only the two neighbours of each merged pair enter the index anew. Pieces of up to STEP_BYTES go
through the index together: a step takes from it the first position, by rank, of each of them. In longer pieces, where
steps would be many and each would pass over the whole index, the positions of one rank merge left to right. A piece
that is itself in the vocabulary is one token at once, as in tiktoken.

The index spans a chain and not the corpus: the ids of a piece don't depend on other pieces, so the result is the same,
no text is shuffled, and a lost task repeats its own block only.

Null and empty texts give no ids. Ids are little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import text_chunks, tidy

#: Pieces whose ids a worker keeps between blocks; beyond it the oldest half is replayed anew when met again.
KEPT_PIECES = 200_000
#: Pairs of tokens whose rank a worker keeps between chains, some 150 bytes each; beyond it all are looked up anew.
KEPT_PAIRS = 200_000
#: Bytes of text that are split into pieces at once (some 15 bytes of memory each), and bytes of distinct pieces that are
#: replayed at once (some 200 each).
BLOCK_BYTES, CHAIN_BYTES = 1 << 18, 1 << 16
#: Longest piece that is replayed together with others, in fewer steps than it has bytes.
STEP_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pair: dict[int, int] = {}
        self.wall = max(ranks.values()) + 1  # stands between pieces: in no pair
        found = []
        for b, rank in ranks.items():
            for k in range(1, len(b)):
                left = ranks.get(b[:k])
                if left is not None and (right := ranks.get(b[k:])) is not None:
                    found.append((left << 32 | right, rank))
        found.append((self.wall << 32 | self.wall, -1))
        self.pairs, self.pair_ranks = np.array(sorted(found), np.int64).T.copy()

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, -1 if it has none."""
        key = left << 32 | right
        place = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[place] == key, self.pair_ranks[place], -1)

    def merged(self, left: int, right: int) -> int:
        """Rank of the merged pair, -1 if it has none."""
        key = left << 32 | right
        got = self.pair.get(key)
        if got is None:
            got = self.pair[key] = self.ranks.get(self.token[left] + self.token[right], -1)
        return got

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word; words must not be empty."""
        short = [w for w in words if len(w) <= STEP_BYTES]
        if len(short) == len(words):
            return self.replay_together(words)
        at_once, by_rank = iter(self.replay_together(short)), iter(self.replay_by_rank([w for w in words if len(w) > STEP_BYTES]))
        return [next(at_once if len(w) <= STEP_BYTES else by_rank) for w in words]

    def replay_together(self, words: list[bytes]) -> list[list[int]]:
        """Each step merges the leftmost pair of lowest rank of every word that has one."""
        if not words:
            return []
        wall = self.wall
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1  # a wall behind each word
        tok = np.array(self.byte, np.int64)[np.frombuffer(b"\0".join(words) + b"\0", np.uint8)]
        tok[ends] = wall
        n = len(tok)
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=-1))
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, -1)  # of the pair that starts at a position
        rank[:-1] = self.ranks_of(tok[:-1], tok[1:])
        at = np.flatnonzero(rank >= 0)
        index = np.sort(rank[at] << 32 | at)  # by rank: its positions
        first = np.empty(len(words), np.int64)
        while len(index):
            at = index & 0xFFFFFFFF
            of, order = word[at], np.arange(len(index))
            first[of[::-1]] = order[::-1]  # the last value of a word stays
            due = first[of] == order
            i = at[due]
            j, h = nxt[i], prv[i]
            k = nxt[j]
            tok[i], tok[j] = index[due] >> 32, -1
            nxt[i], prv[k] = k, i
            rank[h] = rank[i] = rank[j] = -1
            index = index[rank[at] >= 0]
            rank[i], rank[h] = self.ranks_of(tok[i], tok[k]), self.ranks_of(tok[h], tok[i])
            new = np.concatenate([i, h])
            new = new[rank[new] >= 0]
            index = np.sort(np.concatenate([index, rank[new] << 32 | new]))
        tok[ends] = -1
        left = np.flatnonzero(tok >= 0)
        ids, stops = tok[left].tolist(), np.searchsorted(left, ends).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def replay_by_rank(self, words: list[bytes]) -> list[list[int]]:
        """Each step merges the positions of one rank in all words."""
        if len(self.pair) > KEPT_PAIRS:
            self.pair.clear()
        byte, merged = self.byte, self.merged
        tok: list[int] = []
        starts = []
        for w in words:
            starts.append(len(tok))
            tok.extend([byte[b] for b in w])
            tok.append(-1)  # a wall: no pair crosses words
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        pair = self.pair
        left = -1
        for i, right in enumerate(tok):
            if left >= 0 <= right:
                r = pair.get(left << 32 | right)
                if r is None:
                    r = merged(left, right)
                if r >= 0:
                    if r in index:
                        index[r].append(i - 1)
                    else:
                        index[r] = [i - 1]
            left = right
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for done, i in enumerate(places):
                a = tok[i]
                if a < 0:
                    continue
                j = nxt[i]
                b = tok[j]
                if b < 0 or pair.get(a << 32 | b) != rank:
                    continue
                tok[i], tok[j] = rank, -2
                k = nxt[i] = nxt[j]
                prv[k] = i
                lower = False
                c = tok[k]
                if c >= 0:
                    r = pair.get(rank << 32 | c)
                    if r is None:
                        r = merged(rank, c)
                    if r >= 0:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heapq.heappush(heap, r)
                        lower |= r <= rank
                h = prv[i]
                if h >= 0 and (c := tok[h]) >= 0:
                    r = pair.get(c << 32 | rank)
                    if r is None:
                        r = merged(c, rank)
                    if r >= 0:
                        if r in index:
                            index[r].append(h)
                        else:
                            index[r] = [h]
                            heapq.heappush(heap, r)
                        lower |= r <= rank
                if lower:  # a new pair comes first; the rest of this rank waits
                    index.setdefault(rank, []).extend(places[done + 1 :])
                    heapq.heappush(heap, rank)
                    break
        out = []
        for s, w in zip(starts, words):
            ids, i = [], s
            while tok[i] >= 0:
                ids.append(tok[i])
                i = nxt[i]
            out.append(ids)
        return out

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))

    def encode_block(self, texts: list[str], pattern: regex.Pattern, kept: dict[str, bytes]) -> list[bytes]:
        pieces = [pattern.findall(t) for t in texts]
        long = []
        for x in dict.fromkeys(chain.from_iterable(pieces)):
            if x in kept:
                continue
            b = x.encode("utf-8", "surrogatepass")
            r = self.ranks.get(b)
            if r is None:
                long.append((x, b))
            else:
                kept[x] = r.to_bytes(4, "little")
        size = np.cumsum([len(b) for _, b in long])
        first = 0
        while first < len(long):
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + CHAIN_BYTES, "right")))
            for (x, _), ids in zip(long[first:last], self.replay([b for _, b in long[first:last]])):
                kept[x] = pack(f"<{len(ids)}I", *ids)
            first = last
        get = kept.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, column: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """Every row with its ids added as `into` and, if named, the bytes these ids decode to as `decoded`; columns of
    those names are replaced. Other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))  # fixed size
    new = [into, decoded] if decoded else [into]
    others = [c for c in docs.columns if c not in new]
    schema = docs.select(*others, *(F.lit(None).cast("binary").alias(c) for c in new)).schema

    def run(batches):
        vocabulary, splitter, kept = shared.value, regex.compile(pattern), {}
        for batch in batches:
            names = batch.schema.names
            col = batch.column(names.index(column)).cast(pa.large_string())
            for first, _, at in text_chunks(col, BLOCK_BYTES):
                part = batch.slice(first, len(at) - 1)
                texts = [t or "" for t in col.slice(first, len(at) - 1).to_pylist()]
                if len(kept) > KEPT_PIECES:
                    for x in list(kept)[: len(kept) // 2]:
                        del kept[x]
                ids = vocabulary.encode_block(texts, splitter, kept)
                made = [ids, [vocabulary.decode(x) for x in ids]] if decoded else [ids]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *(pa.array(x, pa.binary()) for x in made)], names=[*names, *new])

    return docs.select(*others).mapInArrow(tidy(run), schema)


def decode(rows: DataFrame, ranks: dict[bytes, int], column: str = "ids", into: str = "decoded") -> DataFrame:
    """Every row with the bytes of its ids added as `into`. Null ids give empty bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    others = [c for c in rows.columns if c != into]
    schema = rows.select(*others, F.lit(None).cast("binary").alias(into)).schema

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            names = batch.schema.names
            out = [vocabulary.decode(x) for x in batch.column(names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(out, pa.binary())], names=[*names, into])

    return rows.select(*others).mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    rows = encode(docs.select("doc_id", "text"), ranks, pattern, decoded="decoded")
    return rows.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
