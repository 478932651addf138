"""Lexical search, token alignment and personal data against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from epitide.llm import alignment, lexical, pii

SCHEMA = "doc_id long, text string, source string, m long, item_id long, score long, block string"


def frame(spark, path, rows):
    spark.createDataFrame([(i, t, "s", 1, 2, 3, "b") for i, t in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    vocab = ["the", "of", "Über", "日本語", "x1", "don't", "naïve"] + [f"w{i}" for i in range(120)]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(vocab) for _ in range(n))
    out = [text(rng.randint(1, 90)) for _ in range(120)]
    return out + [out[0]] * 5 + [None, "", " \n ", "...", "the", "the", "THE the", "the " * 9000, "q" * 70_000 + " the", text(6000), "<|endoftext|> of <s>", "a\x00b the", "▁the"]


@pytest.fixture(scope="module")
def rows(texts):
    return [(None if i % 37 == 5 else 3 * (i // 2 if i % 11 == 0 else i), t) for i, t in enumerate(texts)]  # null and repeated ids


# Lexical search -------------------------------------------------------------------------------------------------------

def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def searched(rows, items, k):
    docs = [(i, collections.Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(x for _, c in docs for x in c)
    out = []
    for item, t in items:
        scored = []
        for i, c in docs:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in terms(t) if c[x])
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows_of_a_stratum, items_of_a_block", [(2048, 500), (3, 4)])
def test_search_equals_brute_force(spark, tmp_path, monkeypatch, rows, texts, rows_of_a_stratum, items_of_a_block):
    monkeypatch.setattr(lexical, "STRATUM_ROWS", rows_of_a_stratum)
    monkeypatch.setattr(lexical, "BATCH_STRATA", 2)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", items_of_a_block)
    docs = frame(spark, str(tmp_path / "d"), rows)
    items = [(1, "the w3 W4 w4 w4"), (2, None), (3, ""), (3, "über 日本語"), (4, "no such words zzz"), (None, "x1 of"), (6, "the"), (7, texts[7]), (8, "w1 " * 50)]
    queries = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    got = sorted((tuple(r) for r in lexical.search(docs, queries, 10).collect()), key=repr)
    assert got == searched(rows, items, 10)


def test_search_of_nothing(spark, tmp_path, rows):
    docs = frame(spark, str(tmp_path / "d"), rows)
    items = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    assert lexical.search(docs.where("false"), items).collect() == []
    assert lexical.search(docs, items.where("false")).collect() == []
    assert lexical.search(docs.where("text is null"), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_outside_of_double_precision(spark, tmp_path):
    """Sums above 2**53 are added as integers."""
    rows = [(i, "rare" if i == 0 else "common") for i in range(400)]
    docs = frame(spark, str(tmp_path / "d"), rows)
    items = spark.createDataFrame([(1, "rare " * 3_000_000)], "item_id long, text string")
    got = lexical.search(docs, items).collect()
    w, m = math.floor(1000 * math.log(802 / 3)), 100
    assert [tuple(r) for r in got] == [(1, 1, 0, 3_000_000 * w * (10**9 // (1000 + 8 * m)))] and got[0]["score"] > 1 << 53


# Token alignment ------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizers():
    ranks = alignment.read_byte_level(public_tokenizers.path("byte_bpe_50k.json"))
    return ranks, public_tokenizers.PATTERN, *alignment.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def aligned(rows):
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = alignment.byte_of_character()

    def ends(parts):
        return np.cumsum([len(p) for p in parts]).tolist()

    docs, df = [], collections.Counter()
    for doc_id, t in rows:
        a = a_side.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_side.encode(t) if t else []
        parts_a = [bytes(byte[c] for c in a_side.id_to_token(i)) for i in a]
        parts_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in (b_side.id_to_piece(i) for i in b)]
        groups = []
        if t and b"".join(parts_a) == b"".join(parts_b) == (" " + t).encode():
            end_a, end_b = ends(parts_a), ends(parts_b)
            before = 0
            for cut in sorted(set(end_a) & set(end_b)):
                groups.append(([x for x, e in zip(a, end_a) if before < e <= cut], [x for x, e in zip(b, end_b) if before < e <= cut]))
                before = cut
        else:
            a, b = [], []
        docs.append((doc_id, a, b, groups))
        df.update({(x, y) for left, right in groups for x in left for y in right})
    best = collections.Counter()
    for (x, _), n in df.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, a, b, groups in docs:
        links = [(x, y) for left, right in groups for x in left for y in right]
        shown = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(df[x] == best[x[0]] for x in links), sum(df[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def test_alignment_equals_brute_force(spark, tmp_path, rows, tokenizers):
    short = [(i, t[:3000] if t else t) for i, t in rows]
    docs = frame(spark, str(tmp_path / "d"), short)
    got = alignment.align(docs, tokenizers)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == aligned(short)
    assert alignment.align(docs.where("false"), tokenizers).collect() == []


def test_ranks_give_the_ids_of_the_vocabulary_file(tokenizers):
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    own = alignment.Tokenizers(*tokenizers)
    points = [*range(0x3400), *range(0xA000, 0xD800, 37), *range(0xE000, 0x20000, 41)]
    cases = [f" a{c}b {c}{c} 1{c}2  {c}\n{c}.{c}" for c in map(chr, points)]
    cases += [" " * 3000 + "a", "b" + " " * 1500 + "\n" * 1200 + "x", " " * 5000, "a" + "　" * 1100, " <|endoftext|>", " it's we'LL 'S"]
    assert all(own.encode_a(t) == e.ids for t, e in zip(cases, a_side.encode_batch(cases, add_special_tokens=False)))


def test_alignment_of_long_texts_and_large_groups(tokenizers):
    own = alignment.Tokenizers(*tokenizers)
    for t in (" " * 400_000, "a" * 300_000, "😀" * 50_000):
        block = alignment.Block(own, [own.encode(t), own.encode(None), own.encode("the")])
        assert block.n_a[1] == block.n_links[1] == 0 and block.n_groups[0] > 0 and block.n_groups[2] == 1
    # One group of 200 by 300 tokens: equal ids are counted together.
    small = alignment.Tokenizers({b"x": 0, b"y": 1, b"xy": 2}, ".", tokenizers[2], [b"xyx", b"yx", b"y"])
    block = alignment.Block(small, [([2] * 300, [0] + [1] * 298 + [2])])
    assert block.n_groups.tolist() == [1] and block.n_links.tolist() == [90_000] and block.same_n.sum() + block.pair_n.sum() == 90_000


# Personal data --------------------------------------------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def base(t):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            checksum = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
            good = (True, all(int(p) <= 255 for p in m.group().split(".") if kind == 1), 14 <= len(digits) <= 19 and checksum % 10 == 0, 10 <= len(digits) <= 15)[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a.b", "@", "x-1", ".", "1", "255", "256", "+", "4111111111111111", " ", "-", "(", ")", "é", "_", "\n", "00", "+49 170", "10.0.0.1", "999", "é.com", "%", "4111 1111-1111 1111"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(t)[0] == base(t), t
    assert pii.read(pii.written(base("é 4111111111111111 a@b.cd"))) == [(2, 2, 18), (19, 0, 25)]


def number(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + d for d in "0123456789" if pii.luhn(digits + d))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    address = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    mail = lambda: f"{rng.choice(['ann', 'bob', 'eve'])}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com"
    junk = lambda: rng.choice([f"password={rng.randbytes(9).hex()}", f'token = "{rng.randbytes(20).hex()}"', f"AKIA{rng.randint(10**9, 10**10)}XZ", f"{10**13 + rng.randint(0, 10**12)}.5.1", "version 3.0."])
    out = [f"thé word {rng.choice([phone, address, mail, junk, lambda: number(rng)])()} and more" for _ in range(500)]
    glued = [f"call {phone()} {number(rng)} now" for _ in range(6)] + [f"from {number(rng)} {address()} today" for _ in range(6)]
    clean = ["plain words only", "version 3.0. of 2024, see 4.1.2 and 17 others", 'key = "0641917ea4e9feb9cda83477b57ac2654884f485"', "sum 123456 + 654321 = 777777", None, "", "12 " * 4000, "9" * 30_000, "a" * 30_000 + "@", "@" * 20_000, "+1" + " " * 20_000]
    return out, glued, clean


def test_spans_beyond_the_patterns(spark, tmp_path, corpus):
    plain, glued, clean = corpus
    rows = [(None if i == 3 else i, t) for i, t in enumerate([*plain, *glued, *clean, plain[0], plain[0]])]
    docs = frame(spark, str(tmp_path / "d"), rows)
    got = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want, r = base(t), got[i]
        assert r["base_sha256"] == hashlib.sha256(pii.written(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == x for s in want) for x in range(4)]
        assert set(want) <= set(pii.read(r["spans"])) and r["n_added"] == len(pii.read(r["spans"])) - len(want)
    for i, t in rows[len(plain) : len(plain) + len(glued)]:  # two numbers beside each other: both, with their own bounds
        words = [(m.start(), m.end()) for m in re.finditer(r"\+1 \(\d+\) 555-\d+|\b4\d{15}\b|\d+(?:\.\d+){3}", t)]
        assert [(s, e) for s, _, e in pii.read(got[i]["spans"])] == words, t
    assert sum(got[i]["n_added"] for i, t in rows if t not in glued) == 0


def test_personal_data_of_nothing(spark, tmp_path):
    docs = frame(spark, str(tmp_path / "d"), [(1, "no digits here"), (2, None)])
    assert pii.spans(docs.where("false")).collect() == []
    assert {(r["doc_id"], r["spans"], r["n_added"]) for r in pii.spans(docs).collect()} == {(1, "", 0), (2, "", 0)}


def test_field_gradient_and_probabilities():
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(0, 0.3, (pii.FEATURES, 4)), rng.normal(0, 0.3, (5, 5)))
    w = pii.Window("+1 (269) 555-3296 4524132264652876 a@b.com")
    truth = pii._truth(w, [(0, 3, 17), (18, 2, 34), (35, 0, 42)])
    value, g, moves = field.gradient(w, truth)
    assert value > 0
    for array, grad in ((field.weights, g), (field.moves, moves)):
        for at in [np.unravel_index(x, array.shape) for x in np.argsort(-np.abs(grad).ravel())[:6]]:
            array[at] += 1e-5
            up = field.gradient(w, truth)[0]
            array[at] -= 2e-5
            down = field.gradient(w, truth)[0]
            array[at] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(grad[at], rel=1e-3, abs=1e-5)
    # The best segmentation by enumeration.
    segments = {(i, j): x for x, (i, j, _) in enumerate(w.segments)}
    score, small = field._scores(w), pii.Window("+1 (269) 5553296 1.2")
    score = field._scores(small)
    options = collections.defaultdict(list)
    for x, (i, j, _) in enumerate(small.segments):
        options[i].append((j, x))

    def ways(at, kind):
        if at == len(small.at):
            return [(0.0, [])]
        out = [(field.moves[kind, 0] + v, p) for v, p in ways(at + 1, 0)]
        for j, x in options[at]:
            for k in range(4):
                out += [(field.moves[kind, k + 1] + score[x, k] + v, [(at, j, k), *p]) for v, p in ways(j, k + 1)]
        return out

    every = ways(0, 0)
    assert field._sums(small, score)[3] == pytest.approx(np.log(sum(np.exp(v) for v, _ in every)))
    assert [s[:3] for s in field.best(small)] == max(every, key=lambda x: x[0])[1] and segments


def test_long_windows_are_cut_and_whole():
    t = " ".join(str(i) for i in range(2000)) + " " + "a1" * 3000 + " x@y.zz"
    parts = pii.windows(t)
    assert all(sum(1 for _ in pii._TOKEN.finditer(t[a:b])) <= pii.WINDOW_TOKENS for a, b in parts)
    assert all(b <= c for (_, b), (c, _) in zip(parts, parts[1:])) and parts[-1][1] == len(t)


def test_windows_of_many_texts_take_little_memory_at_once():
    import tracemalloc

    import pyarrow as pa

    from epitide.llm import common, suffix_dedup

    column = pa.array([" ".join(f"w{(i * 7919 + j * 104729) % 9973}" for j in range(400)) for i in range(800)])
    common.powers(common.BASE, 1), common.powers(pow(common.BASE, -1, 1 << 64), 1)
    tracemalloc.start()
    for _, data, at in common.text_chunks(column):
        suffix_dedup.contexts(data, at, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_a_shard_of_contexts_is_sorted_in_little_memory():
    import tracemalloc

    from epitide.llm import suffix_dedup

    body = " ".join(f"w{(i * 7919) % 99991}" for i in range(150 * suffix_dedup.SHARD_CONTEXTS // 6)).encode()
    parts = [body[i * 100 : i * 100 + 160] for i in range(suffix_dedup.SHARD_CONTEXTS)]
    assert all(len(p) == 160 for p in parts)
    tracemalloc.start()
    suffix_dedup.repeated_windows(parts, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
