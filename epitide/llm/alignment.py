"""Links between the tokens of two tokenizers over the same bytes, and how usual each link is in the corpus.

Tokenizer A reads space + text, tokenizer B reads text and adds the space itself. Byte offsets where a token of A and one
of B both end cut the tokens into groups; every token of A is linked with every token of B of its group. The count of an
id pair is the number of documents that hold it linked.

1. Both tokenizers run once over each batch of texts (a block). The identity map, A id to the B id of the same bytes, is
   the fast path: a link of an id with its identity, above all a group of one token each, is counted in a vector as long
   as the vocabulary, one per task. Only other links, of irregular groups, become pairs.
2. A block hands on its distinct irregular pairs with their number of documents. Pairs are summed corpus-wide by a
   partial aggregate, joined back to the blocks by pair, and gathered by block: a frequent pair is one row per block and
   never one per document, and a block gathers no more than its own distinct pairs.
3. The highest count of each A id is one number per id of A: these and the identity counts are broadcast (both as long as
   the vocabulary). Sums of a document come from its identity links (no shuffle) and from its block's pairs.

Null and empty texts, and texts whose joined token bytes of A or B differ from space + text, have no tokens: zeros, and
an empty digest. Rows with equal or null ids are documents of their own. Groups of many tokens count equal ids once with
their multiplicity, and pairs are made in slices, so a group of m by n tokens needs no m * n rows at once. Other columns
are not read. Both tokenizers need the whole text: memory is about 100 bytes a character of the longest text.

A's rank table comes from the vocabulary file itself: its entries, byte-level decoded, are ranked by their ids. Special
tokens are left out, so that their strings are plain text.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import tidy
from epitide.sources.scratch import materialise

#: Pairs made at once, and tokens of a group above which equal ids are taken together first.
SLICE, LARGE_GROUP = 1 << 21, 64
#: White space that is taken as a piece before the split pattern sees it: the library's matcher overflows on long runs.
LONG_SPACE = regex.compile(r"\p{White_Space}{1000,}")


def byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level entry stands for: printable Latin-1 characters stand for themselves, the
    other bytes follow from 256 on in their order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_byte_level(path: str) -> dict[bytes, int]:
    """Bytes of each entry of a byte-level vocabulary file, by id; special tokens left out."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    special = {t["content"] for t in whole["added_tokens"]}
    byte = byte_of_character()
    return {bytes(byte[c] for c in entry): i for entry, i in whole["model"]["vocab"].items() if entry not in special}


def read_pieces(path: str) -> tuple[bytes, list[bytes]]:
    """The model file, and the bytes of each piece: U+2581 is a space, <0xHH> the byte HH."""
    with open(path, "rb") as f:
        model = f.read()
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    return model, [
        bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in range(pieces.get_piece_size()))
    ]


class Tokenizers:
    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes, pieces: list[bytes]):
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size_a, self.size_b = max(ranks.values()) + 1, len(pieces)
        self.bytes_a = [b""] * self.size_a
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = pieces
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        piece = {token: i for i, token in enumerate(pieces)}  # of equal bytes the later id: ordinary pieces follow the bytes
        self.same = np.array([piece.get(t, -1) if t else -1 for t in self.bytes_a], np.int64)
        # Every id as it stands in the text of the groups: inside a side, or last of it.
        self.shown = [f"{i}{mark}" for size, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for mark in marks for i in range(size)]

    def encode_a(self, text: str) -> list[int]:
        """All but the last character of a run of white space is one piece, or all of it at the end of a text."""
        ids, done = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.a.encode_ordinary(text[done : run.start()])
            ids += self.a._encode_single_piece(text[run.start() : end].encode())
            done = end
        return ids + self.a.encode_ordinary(text[done:])

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        try:
            want = (" " + text).encode()
        except UnicodeEncodeError:
            return [], []
        a, b = self.encode_a(" " + text), self.b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return [], []
        return a, b


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _merge(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their numbers."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    heads = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[heads], np.add.reduceat(n, heads) if len(code) else n


class Block:
    """Groups and links of a batch of encoded documents."""

    def __init__(self, tok: Tokenizers, sides: list[tuple[list[int], list[int]]]):
        self.docs = len(sides)
        self.n_a, self.n_b = (np.array([len(s[i]) for s in sides], np.int64) for i in (0, 1))
        a, b = (np.fromiter((x for s in sides for x in s[i]), np.int64, int(n.sum())) for i, n in ((0, self.n_a), (1, self.n_b)))
        end_a, end_b = np.cumsum(tok.length_a[a]), np.cumsum(tok.length_b[b])  # both sides of a document end together
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        size_a, size_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        bounds_a = np.append(0, np.cumsum(self.n_a))
        group_doc = np.searchsorted(bounds_a, first_a, "right") - 1
        self.n_groups = np.bincount(group_doc, minlength=self.docs)
        links = np.bincount(group_doc, (size_a * size_b).astype(np.float64), self.docs)
        self.n_links = links.astype(np.int64)
        self._write(tok, a, b, size_a, size_b, group_a, group_b, group_doc)

        plain = (size_a == 1) & (size_b == 1)
        plain[plain] = tok.same[a[first_a[plain]]] == b[first_b[plain]]
        code, n = self._pairs(tok, a, b, first_a, size_a, first_b, size_b, group_doc, np.flatnonzero(~plain))
        # code: document, A id, B id; identity links leave the pairs and join the plain groups.
        key = code % (tok.size_a * tok.size_b)
        doc, ia, ib = code // (tok.size_a * tok.size_b), key // tok.size_b, key % tok.size_b
        identity = tok.same[ia] == ib
        same_code = np.concatenate([group_doc[plain] * tok.size_a + a[first_a[plain]], doc[identity] * tok.size_a + ia[identity]])
        self.same, self.same_n = _merge(same_code, np.concatenate([np.ones(int(plain.sum()), np.int64), n[identity]]))
        self.pair_doc, self.pair_n = doc[~identity], n[~identity]
        self.pairs, self.pair_at, self.pair_docs = np.unique(key[~identity], return_inverse=True, return_counts=True)

    @staticmethod
    def _pairs(tok, a, b, first_a, size_a, first_b, size_b, group_doc, groups) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, A id, B id) of the given groups, with the number of links."""
        codes, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        large = np.maximum(size_a[groups], size_b[groups]) > LARGE_GROUP
        small = groups[~large]
        total = np.cumsum(size_a[small] * size_b[small])
        done = 0
        while done < len(small):
            last = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + SLICE, "right")))
            g = small[done:last]
            at_a = _spread(first_a[g], size_a[g])
            wide = np.repeat(size_b[g], size_a[g])
            left, right = np.repeat(a[at_a], wide), b[_spread(np.repeat(first_b[g], size_a[g]), wide)]
            code = (np.repeat(np.repeat(group_doc[g], size_a[g]), wide) * tok.size_a + left) * tok.size_b + right
            code, n = np.unique(code, return_counts=True)
            codes.append(code)
            numbers.append(n)
            done = last
        for g in groups[large].tolist():
            ua, na = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            ub, nb = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            codes.append((((group_doc[g] * tok.size_a + ua) * tok.size_b)[:, None] + ub[None, :]).ravel())
            numbers.append((na[:, None] * nb[None, :]).ravel())
        return _merge(np.concatenate(codes), np.concatenate(numbers))

    def _write(self, tok, a, b, size_a, size_b, group_a, group_b, group_doc) -> None:
        """sha256 of each document's groups: A's ids, a bar, B's ids, groups apart by semicolons."""
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(a)], np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        stream = np.empty(len(a) + len(b), np.int64)
        before_b, upto_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        stream[np.arange(len(a)) + before_b[group_a]] = a + last_a * tok.size_a
        stream[np.arange(len(b)) + upto_a[group_b]] = 2 * tok.size_a + b + last_b * tok.size_b
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        self.sha, begin = [], 0
        for end in ends:
            shown = "".join(map(tok.shown.__getitem__, stream[begin:end].tolist()))
            self.sha.append(hashlib.sha256(shown[:-1].encode()).hexdigest() if shown else "")
            begin = end


BLOCKS = (
    "kind string, block string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "same binary, same_n binary, same_sizes binary, pairs binary, pair_docs binary, pair_at binary, pair_n binary, pair_sizes binary, vector binary"
)
_NAMES = [c.strip().split()[0] for c in BLOCKS.split(",")]
_LISTS = _NAMES[2:8]


def _record(**columns) -> pa.RecordBatch:
    def typed(name):
        value = columns.get(name)
        if name in _LISTS:
            return pa.array([value], pa.list_(pa.string() if name == "groups_sha256" else pa.int64()))
        return pa.array([value.tobytes() if isinstance(value, np.ndarray) else value], pa.string() if name in ("kind", "block") else pa.binary())

    return pa.RecordBatch.from_arrays([typed(n) for n in _NAMES], names=_NAMES)


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def blocks(docs: DataFrame, tokenizers: tuple) -> DataFrame:
    """One row for each batch of documents (kind block), and one vector of identity counts for each task (kind vector)."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)  # two vocabularies

    def run(batches):
        tok = Tokenizers(*shared.value)
        vector = np.zeros(tok.size_a, "<i8")
        for batch in batches:
            block = Block(tok, [tok.encode(t) for t in batch.column(1).to_pylist()])
            ids = block.same % tok.size_a
            vector += np.bincount(ids, minlength=tok.size_a)
            yield _record(
                kind="block", block=uuid.uuid4().hex, doc_id=batch.column(0).to_pylist(), n_a=block.n_a, n_b=block.n_b, n_groups=block.n_groups, n_links=block.n_links,
                groups_sha256=block.sha, same=ids.astype(_id_type(tok.size_a)), same_n=block.same_n.astype("<u4"),
                same_sizes=np.bincount(block.same // tok.size_a, minlength=block.docs).astype("<i4"), pairs=block.pairs.astype("<i8"), pair_docs=block.pair_docs.astype("<i4"),
                pair_at=block.pair_at.astype("<u4"), pair_n=block.pair_n.astype("<u4"), pair_sizes=np.bincount(block.pair_doc, minlength=block.docs).astype("<i4"),
            )
        yield _record(kind="vector", vector=vector)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), BLOCKS)


def _identity_counts(rows: DataFrame, size: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_buffer(), "<i8")
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["a", "n"])

    out = np.zeros(size, np.int64)
    for r in rows.where("kind = 'vector'").select("vector").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():  # a vocabulary
        out[r["a"]] = r["n"]
    return out


def _block_pairs(rows: DataFrame) -> DataFrame:
    """block, at, pair, n: the distinct irregular pairs of each block."""
    def run(batches):
        for batch in batches:
            for block, pairs, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                pairs, n = np.frombuffer(pairs, "<i8"), np.frombuffer(n, "<i4")
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(pairs), pa.string()), pa.array(np.arange(len(pairs)), pa.int32()), pa.array(pairs), pa.array(n.astype(np.int64)),
                ], names=["block", "at", "pair", "n"])

    return rows.where("kind = 'block'").select("block", "pairs", "pair_docs").mapInArrow(tidy(run), "block string, at int, pair long, n long")


def align(docs: DataFrame, tokenizers: tuple) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document (doc_id, text).

    `tokenizers`: A's ranks and split pattern, B's model and its pieces.
    """
    ranks, _, _, pieces = tokenizers
    size_a, size_b = max(ranks.values()) + 1, len(pieces)
    spark = docs.sparkSession
    rows = materialise(blocks(docs, tokenizers), "blocks")
    same = _identity_counts(rows, size_a)
    held = _block_pairs(rows)
    counts = materialise(held.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    best = same.copy()
    for r in counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("count").alias("count")).collect():  # a vocabulary
        best[r["a"]] = max(best[r["a"]], r["count"])
    shared = spark.sparkContext.broadcast((same, best))  # as long as the vocabulary of A

    gathered = held.select("block", "at", "pair").join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count")).alias("got"))
    odd = rows.where("kind = 'block'").select("block", "pairs", "pair_at", "pair_n", "pair_sizes").join(gathered, "block", "left")

    def per_document(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.append(0, np.cumsum(values))
        cut = np.append(0, np.cumsum(sizes))
        return ends[cut[1:]] - ends[cut[:-1]]

    def irregular(batches):
        _, best = shared.value
        for batch in batches:
            block, pairs, at, n, sizes, got = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                key = np.frombuffer(pairs[i].as_buffer(), "<i8")
                count = np.zeros(len(key), np.int64)
                if got[i].is_valid:
                    place, number = got[i].values.flatten()
                    count[place.to_numpy()] = number.to_numpy()
                is_best = count == best[key // size_b]
                where, links, size = np.frombuffer(at[i].as_buffer(), "<u4"), np.frombuffer(n[i].as_buffer(), "<u4").astype(np.int64), np.frombuffer(sizes[i].as_buffer(), "<i4")
                yield pa.RecordBatch.from_arrays([
                    pa.array([block[i].as_py()]), *(pa.array([x], pa.list_(pa.int64())) for x in (per_document(links * is_best[where], size), per_document(links * count[where], size))),
                ], names=["block", "odd_best", "odd_sum"])

    def regular(batches):
        same, best = shared.value
        for batch in batches:
            names = batch.schema.names
            ids, n, sizes = (batch.column(names.index(c)) for c in ("same", "same_n", "same_sizes"))
            made = [], []
            for i in range(batch.num_rows):
                a, links, size = np.frombuffer(ids[i].as_buffer(), _id_type(size_a)), np.frombuffer(n[i].as_buffer(), "<u4").astype(np.int64), np.frombuffer(sizes[i].as_buffer(), "<i4")
                made[0].append(per_document(links * (same[a] == best[a]), size))
                made[1].append(per_document(links * same[a], size))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in ("block", *_LISTS)), *(pa.array(m, pa.list_(pa.int64())) for m in made)], names=["block", *_LISTS, "same_best", "same_sum"],
            )

    lists = ", ".join(f"{c} array<{'string' if c == 'groups_sha256' else 'long'}>" for c in _LISTS)
    left = rows.where("kind = 'block'").select("block", *_LISTS, "same", "same_n", "same_sizes").mapInArrow(tidy(regular), f"block string, {lists}, same_best array<long>, same_sum array<long>")
    right = odd.mapInArrow(tidy(irregular), "block string, odd_best array<long>, odd_sum array<long>")
    whole = left.join(right, "block").select(F.inline(F.arrays_zip(*_LISTS, "same_best", "same_sum", "odd_best", "odd_sum")))
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("same_best") + F.col("odd_best")).alias("n_best"), (F.col("same_sum") + F.col("odd_sum")).alias("count_sum"), "groups_sha256",
    )
