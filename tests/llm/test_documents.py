"""Operators on documents against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from epitide.llm import bpe, fingerprint, mixing, ngram_join, suffix_dedup

SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _row string, kept int"


def words(t):
    return [w for w in re.split(SPACE, t or "") if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = ["the", "of", "and", "über", "naïve", "Ça", "日本", "x1", "a-b", "don't"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = text(120), text(60)
    out = [text(rng.randint(1, 200)) for _ in range(40)]
    out += [base] * 6 + [base + " " + text(2), text(1) + " " + base, base.upper()]
    for i in range(12):
        edited = base.split(" ")
        edited[5 * i] = f"edit{i}"
        out.append(" ".join(edited))
    out += [text(30) + " " + passage + " " + text(30) for _ in range(8)]
    out += ["", None, " \n\t", "one", "one", "two words", "a" * 400, "ab" * 300, text(4000), "é" * 150, " x y"]
    rows = [(i * 3, t, "en", None if i % 11 == 0 else f"s{i % 4}", None, 1, "r", 2) for i, t in enumerate(out)]
    return rows + [(None, base, "en", "s0", None, 1, "r", 2), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# Byte-level BPE -------------------------------------------------------------------------------------------------------

def test_bpe_equals_tiktoken_and_round_trips(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    for r in got.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_merge_replay_follows_the_lowest_rank_of_each_word():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290, b"aa": 280, b"ab": 310, b"aaa": 270}
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))).encode() for _ in range(300)]
    texts = [t for t in texts if t not in ranks]
    assert bpe.Vocabulary(ranks).replay(texts) == [own.encode_ordinary(t.decode()) for t in texts]


def test_bpe_of_many_different_pieces_takes_little_memory_at_once():
    import tracemalloc

    import regex

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(10_000))
    vocabulary, splitter = bpe.Vocabulary(ranks), regex.compile(public_tokenizers.PATTERN)
    vocabulary.encode_block([text[:100_000]], splitter, {})
    tracemalloc.start()
    ids = vocabulary.encode_block([text, "", text[:500]], splitter, {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [own.encode_ordinary(t) for t in (text, "", text[:500])]
    assert peak < 30e6


def test_bpe_with_few_pairs_kept_and_small_blocks(docs, monkeypatch):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    want = sorted(map(str, bpe.digests(docs, ranks, public_tokenizers.PATTERN).collect()))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 10)
    monkeypatch.setattr(bpe, "CHAIN_BYTES", 30)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 100)
    assert sorted(map(str, bpe.digests(docs, ranks, public_tokenizers.PATTERN).collect())) == want
    vocabulary = bpe.Vocabulary(ranks)
    texts = [b"unbelievable", b"antidisestablishment", b"x" * 40, b"pneumonia" * 5]
    for t in texts:
        assert vocabulary.replay([t]) == [own._encode_single_piece(t)]
        assert len(vocabulary.pair) < 200


def test_bpe_replays_short_pieces_together_in_few_steps():
    import sys

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 20))).encode() for _ in range(2_000)]
    vocabulary = bpe.Vocabulary(ranks)
    lines = 0

    def count(frame, event, _):
        nonlocal lines
        lines += event == "line"
        return count if frame.f_code.co_filename == bpe.__file__ else None

    before = sys.gettrace()
    sys.settrace(count)
    try:
        got = vocabulary.replay(words)
    finally:
        sys.settrace(before)
    assert got == [own._encode_single_piece(w) for w in words]
    assert lines < 10 * len(words)  # and not some lines for each byte and merge


def test_merge_replay_of_short_and_long_words_keeps_their_order():
    rng = random.Random(6)
    for _ in range(20):
        tokens = list({"".join(rng.choices("abc", k=rng.randint(2, 5))).encode() for _ in range(30)})
        ranks = {bytes([b]): b for b in range(256)} | dict(zip(tokens, rng.sample(range(256, 400), len(tokens))))
        own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        sizes = [1, 2, 3, 9, bpe.STEP_BYTES - 1, bpe.STEP_BYTES, bpe.STEP_BYTES + 1, 90]
        texts = ["".join(rng.choices(rng.choice(["a", "ab", "abc", "abc\0"]), k=rng.choice(sizes))).encode() for _ in range(50)]
        texts = [t for t in texts if t not in ranks]
        assert bpe.Vocabulary(ranks).replay(texts) == [own._encode_single_piece(t) for t in texts]
        assert bpe.Vocabulary(ranks).replay([]) == []


def test_bpe_of_no_rows(empty):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert bpe.digests(empty, ranks, public_tokenizers.PATTERN).collect() == []


# N-gram Jaccard join --------------------------------------------------------------------------------------------------

def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in groups[find(i)] if rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str), groups


def test_join_components_equal_all_pairs(docs, rows):
    want, _ = brute_components(rows)
    assert sorted((tuple(r) for r in ngram_join.join_components(docs).collect()), key=str) == want


def test_representatives_keep_one_of_each_component(docs, rows):
    got = ngram_join.representatives(docs)
    assert got.columns == docs.columns
    _, groups = brute_components(rows)
    want = []
    for members in groups.values():
        ids = [rows[j][0] for j in members]
        want.append(min(ids, key=lambda x: (x is None, x or 0)))
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted(want, key=str)


def test_links_that_the_first_pivots_miss(spark, tmp_path):
    """A chain of edits: neighbours are alike, the ends are not; and a passage that unlike documents share."""
    rng = random.Random(9)
    w = [f"v{i}" for i in range(200)]
    chain, rows = list(w), []
    for i in range(14):
        rows.append((i, " ".join(chain)))
        for k in range(3):
            chain[(i * 13 + k * 61) % 200] = f"c{i}_{k}"
    shared = " ".join(f"p{i}" for i in range(90))
    rows += [(100 + i, shared + " " + " ".join(rng.choice(w) + str(i) for _ in range(10 + i))) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    want, _ = brute_components(rows)
    assert sorted((tuple(r) for r in ngram_join.join_components(spark.read.parquet(str(tmp_path / "d"))).collect()), key=str) == want


def test_links_inside_a_group_without_its_first_class(spark, tmp_path, monkeypatch):
    """Families of short texts: B and C are alike, A (often the first class of a group of all three) is not like them.
    All slots are of one level, as in a large corpus, where a shingle of three texts is not common."""
    monkeypatch.setattr(ngram_join, "common_slots", lambda docs, words: np.zeros(1 << ngram_join.SLOT_BITS, np.uint8))
    rows = []
    for i in range(80):
        common = " ".join(f"f{i}_{k}" for k in range(12))
        rows += [(10 * i + j, f"{common} {end}") for j, end in enumerate(("x y", "p q", "p r"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    want, _ = brute_components(rows)
    assert sorted((tuple(r) for r in ngram_join.join_components(spark.read.parquet(str(tmp_path / "d"))).collect()), key=str) == want


@pytest.mark.parametrize("list_rows", [2, 4_096])
def test_opened_lists_by_size_and_salt(spark, tmp_path, monkeypatch, list_rows):
    """Texts of 5 to 40 words that are edited, cut and lengthened in chains: links between sizes whose ratio is just 0.8, equal
    sizes, lists of many unlinked classes, on one task and dealt over several."""
    monkeypatch.setattr(ngram_join, "LIST_ROWS", list_rows)
    monkeypatch.setattr(ngram_join, "common_slots", lambda docs, words: np.zeros(1 << ngram_join.SLOT_BITS, np.uint8))
    rng, rows = random.Random(21), []
    for i in range(60):
        text = [f"f{i % 25}_{k}" for k in range(rng.randint(5, 40))]
        for j in range(8):
            rows.append((10 * i + j, " ".join(text)))
            at = rng.randrange(len(text))
            text = rng.choice((text[: max(5, len(text) - 2)], text + [f"t{rng.randrange(4)}"], text[:at] + [f"e{rng.randrange(3)}"] + text[at + 1 :], text[rng.randint(0, 2) :]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    want, _ = brute_components(rows)
    assert sorted((tuple(r) for r in ngram_join.join_components(spark.read.parquet(str(tmp_path / "d"))).collect()), key=str) == want


def test_neighbouring_levels_hold_all_sizes_that_link(spark):
    sizes = spark.range(1, 3_000).select(F.col("id").alias("n"))
    least = F.ceil(F.col("n") * 80 / 100).alias("m")
    levels = sizes.select("n", least).select(ngram_join._level("n", 80).alias("a"), ngram_join._level("m", 80).alias("b"))
    assert {r["a"] - r["b"] for r in levels.distinct().collect()} <= {0, 1}


def test_join_of_no_rows(empty):
    assert ngram_join.join_components(empty).collect() == [] and ngram_join.representatives(empty).collect() == []


# Suffix-array dedup ---------------------------------------------------------------------------------------------------

def brute_dedup(rows, length):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            gone[p : p + length] |= w in seen
            seen.add(w)
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((r[0], int(gone.sum()), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [2_000, 2])
def test_dedup_equals_brute_force(docs, rows, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "ANCHOR_CONTEXTS", most)  # 2: most anchors take the aggregated way
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", 20)
    got = suffix_dedup.dedup(docs)
    assert got.columns == [*(c for c in docs.columns if c != "kept"), "kept", "n_removed", "n_spans"]
    assert sorted(((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()), key=str) == brute_dedup(rows, 100)


def test_dedup_of_no_rows(empty):
    assert suffix_dedup.dedup(empty).collect() == []


def test_two_stage_order_is_the_suffix_order():
    rng = random.Random(2)
    for symbols in (1, 2, 4, 250):
        text = np.array([rng.randint(1, symbols) for _ in range(600)] + [0], np.uint8)
        padded = np.r_[text, np.zeros(8, np.uint8)]
        keys = np.zeros(len(text), np.uint64)
        for j in range(8):
            keys = (keys << np.uint64(8)) | padded[j : j + len(text)]
        raw = text.tobytes()
        assert suffix_dedup.two_stage_order(text, keys, 700).tolist() == sorted(range(len(text)), key=lambda i: raw[i:])


# Fingerprints ---------------------------------------------------------------------------------------------------------

def test_fingerprints(docs, rows):
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows)
    order = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}, key=lambda r: -r[0])
    text_of, bag = dict(order), lambda t: collections.Counter(tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4)))
    for i, (doc_id, text) in enumerate(order[:-1]):
        after, k = order[i + 1][1], len(text) // 3
        r = next(r for r in got if r["doc_id"] == doc_id)
        edited = text[: len(text) - k] + after[:k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r["near_edited"], edited), (r["near_next"], after)):
            a, b = bag(text), bag(other)
            true = sum((a & b).values()) / sum((a | b).values())
            assert abs(near - true) <= 0.3 and (near == 1.0 or words(text) != words(other))
    prints = collections.defaultdict(set)
    for r in got:
        if r["doc_id"] is not None:
            prints[" ".join(words(text_of[r["doc_id"]]))].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) > 0.9 * len(prints)


def test_collision_rate_is_the_generalised_jaccard(spark):
    """Weights above one: many repeated lines, so terms have weights up to 30."""
    line = [" ".join(f"t{i}_{j}" for j in range(5)) for i in range(200)]
    rng = random.Random(5)
    data = []
    for i in range(60):
        a = {k: rng.randint(1, 30) for k in rng.sample(range(200), 50)}
        b = {k: max(1, n + rng.randint(-5, 5)) for k, n in a.items() if rng.random() < 0.8}
        data.append((i, "\n".join(line[k] for k, n in a.items() for _ in range(n)), "\n".join(line[k] for k, n in b.items() for _ in range(n))))
    bag = lambda t: collections.Counter(tuple(w[i : i + 5]) for w in [re.split(SPACE, t)] for i in range(len(w) - 4))
    true = {i: sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values()) for i, a, b in data}
    df = spark.createDataFrame(data, "k long, a string, b string").repartition("k")
    got = fingerprint.signatures(df, ["k"], "a", "b")
    errors = [r["near"] - true[r["k"]] for r in got.select("k", fingerprint.likeness(got["a"], got["b"]).alias("near")).collect()]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


def test_fingerprints_run_no_python_on_executors(docs):
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_fingerprints_of_no_rows(empty):
    assert fingerprint.fingerprints(empty).collect() == []


# Mixing ---------------------------------------------------------------------------------------------------------------

def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    fixed = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(target[s] for s in fixed)
        free = [s for s in order if s not in fixed]
        for s in free:
            target[s] = left * weight[s] / sum(weight[f] for f in free)
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        for s in above:
            target[s] = 2.0 * sizes[s]
        fixed |= above


def test_mixture_meets_its_targets(docs, rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want, taken = brute_targets(sizes), collections.Counter()
    source = {r[0]: r[3] for r in rows if r[0] is not None} | {None: None}
    got = mixing.mixed(docs.where("doc_id is not null")).collect()
    again = mixing.mixed(docs.where("doc_id is not null").repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    full = mixing.mixed(docs).collect()
    for r in full:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] == pytest.approx(want[source[r["doc_id"]]])
    by_target = collections.Counter()
    for r in full:
        by_target[round(r["target"], 6)] += r["taken"]
    for s, t in want.items():
        assert by_target[round(t, 6)] == pytest.approx(t, rel=0.02)
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns
    counts = collections.Counter()
    for r in mix.collect():
        counts[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["size"] == 1
    wanted = collections.Counter()
    for r in full:
        wanted[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in counts.items() if v} == {k: v for k, v in wanted.items() if v}


def test_sainte_lague_by_single_seats():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        sizes, caps, seats = rng.integers(0, 50, n).astype(float), rng.integers(0, 30, n), int(rng.integers(0, 80))
        caps[sizes == 0] = 0
        got = np.zeros(n, int)
        for _ in range(min(seats, caps.sum())):
            got[np.argmax(np.where(got < caps, sizes / (2 * got + 1), -1))] += 1
        assert mixing.sainte_lague(sizes, seats, caps).tolist() == got.tolist()


def test_mixture_starts_no_python_workers_of_another_kind(docs, capsys):
    mixing.mixed(docs).explain()
    plan = capsys.readouterr().out
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan


def test_mixture_of_no_rows(empty):
    assert mixing.mixed(empty).collect() == [] and mixing.mixture(empty).collect() == []
