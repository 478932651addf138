"""Personal data: exact patterns, and what a semi-Markov conditional random field adds to them.

Base spans are the matches of four patterns (email, ip, card, phone), leftmost and without overlap inside a kind; matches
that fail their test (parts of an ip above 255, card digits that are not 14 to 19 or fail Luhn, phone digits that are not
10 to 15) are dropped and not tried again. So "+1 (269) 555-3296 4524132264652876" has no base span: both patterns run
across the boundary between the two numbers. The field finds such boundaries.

1. One pass over the texts finds the base spans and the windows: runs of words of one line that hold a digit or an @,
   words at most three characters apart. A window is kept if it has an @, MIN_DIGITS digits or three dots. Windows are
   written with their base spans; whole texts are read once.
2. The field is fitted in one task on at most SAMPLE different windows of at most SAMPLE_CHARS characters, taken by hash,
   with their base spans as the truth. Windows where a pattern ran into too many digits are left out (their truth is not
   known), and copies teach what the patterns can't say: two windows beside each other, and phones without the plus sign.
3. A window is cut into tokens (digits, letters, single signs). A segment of up to MAX_TOKENS tokens that could be an
   entity is scored as a whole: digit count, lengths of its digit groups, Luhn, dotted quads, the form around an @, what
   it starts and ends with, what it touches. All other tokens are segments of one token without a kind. Dynamic
   programming over (end, kind of the last segment) sums over all segmentations for learning and for the probability of
   a segment, and takes the best one jointly for boundaries and kinds.
4. A segment of the best segmentation is added if its probability is at least CERTAIN and it meets no base span (segments
   that would meet one are not offered). Base spans always stay.

Windows of more than WINDOW_TOKENS tokens are cut, before a word where there is one, and each part is read for itself.
A null or empty text has no spans; rows with equal or null ids are documents of their own; other columns are not read.
Work is linear in the text, whatever it holds: no pattern starts twice in one run of characters. Without windows to learn
from, nothing is added. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import io
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import tidy
from epitide.llm.learning import Adam
from epitide.sources.scratch import materialise

KINDS = ("email", "ip", "card", "phone")
MIN_DIGITS, MAX_TOKENS, WINDOW_TOKENS, CERTAIN = 7, 20, 256, 0.9
#: Bounds of what the field learns from.
SAMPLE, SAMPLE_CHARS, EPOCHS, BATCH = 1200, 200, 8, 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HOT_WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the base spans in order, and the places where a pattern ran into too many digits."""
    out, ran = [], []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for kind, pattern, least, most in ((2, _CARD, 14, 19), (3, _PHONE, 10, 15)):
        for m in pattern.finditer(text):
            if m.end() - m.start() < least:
                continue
            digits = _NOT_DIGIT.sub("", m.group())
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                out.append((m.start(), kind, m.end()))
            elif len(digits) > most or kind == 2 and len(digits) >= least and len(digits) < m.end() - m.start():
                ran.append((m.start(), m.end()))
    return sorted(out), ran


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def read(spans: str) -> list[tuple[int, int, int]]:
    return [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]


def _worth(text: str) -> bool:
    return "@" in text or text.count(".") >= 3 or len(_NOT_DIGIT.sub("", text)) >= MIN_DIGITS


def windows(text: str) -> list[tuple[int, int]]:
    """Start and end of each window that can hold an entity."""
    out, start, end, tokens = [], -1, -1, 0
    for word in _HOT_WORD.finditer(text):
        a, b = word.span()
        n = sum(1 for _ in _TOKEN.finditer(text, a, b))
        if start >= 0 and a - end <= 3 and "\n" not in text[end:a] and tokens + n <= WINDOW_TOKENS:
            end, tokens = b, tokens + n
        else:
            if start >= 0:
                out.append((start, end))
            start, end, tokens = a, b, n
        if tokens > WINDOW_TOKENS:  # one word of many tokens
            marks = [t.start() for t in _TOKEN.finditer(text, start, end)][::WINDOW_TOKENS] + [end]
            out.extend(zip(marks[:-2], marks[1:-1]))
            start, tokens = marks[-2], tokens % WINDOW_TOKENS or WINDOW_TOKENS
    if start >= 0:
        out.append((start, end))
    return [(a, b) for a, b in out if _worth(text[a:b])]


# The field ----------------------------------------------------------------------------------------------------------

_DIGITS = (0, 1, 4, 7, 10, 12, 14, 16, 17, 20)
_FLAGS = (
    "any", "one @", "no @", "several @", "letters", "no letters", "starts +", "starts (", "starts digit", "starts letter", "ends letter", "touches left", "touches right",
    "luhn", "fails luhn", "quad", "no quad", "domain", "no domain", "spaces", "wide space", "hyphen", "dot", "parentheses", "open parenthesis", "other sign", "spaced local",
)
_PATTERNS = 64
FLAG = {name: i for i, name in enumerate(_FLAGS)}
FEATURES = len(_FLAGS) + len(_DIGITS) + 8 + _PATTERNS
_MAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")


@lru_cache(4096)
def _pattern_slot(lengths: tuple[int, ...]) -> int:
    return int.from_bytes(hashlib.blake2b(repr(lengths).encode(), digest_size=4).digest(), "little") % _PATTERNS


class Window:
    """Tokens of a window, and the segments that could be entities: (first token, end token, features)."""

    def __init__(self, text: str, taken: list[tuple[int, int, int]] = ()):
        self.text = text
        self.at = [m.span() for m in _TOKEN.finditer(text)]
        self.segments: list[tuple[int, int, list[int]]] = []
        shown = [text[a:b] for a, b in self.at]
        digit = [t[0] in "0123456789" for t in shown]
        letter = [t[0].isalpha() for t in shown]
        free = [not any(a < e and s < b for s, _, e in taken) for a, b in self.at]
        for i, t in enumerate(shown):
            if not free[i] or not (digit[i] or letter[i] or t in "+("):
                continue
            digits, lengths, letters, ats, dots = 0, (), 0, 0, 0
            for j in range(i, min(i + MAX_TOKENS, len(shown))):
                if not free[j]:
                    break
                u = shown[j]
                if digit[j]:
                    digits, lengths = digits + len(u), (*lengths, len(u))
                elif letter[j]:
                    letters += len(u)
                ats, dots = ats + (u == "@"), dots + (u == ".")
                if (digit[j] or letter[j]) and (ats or letters == 0 and (digits >= MIN_DIGITS or dots == 3)):
                    self.segments.append((i, j + 1, self._features(shown, digit, letter, i, j + 1, digits, lengths, letters, ats)))

    def _features(self, shown, digit, letter, i, j, digits, lengths, letters, ats) -> list[int]:
        a, b = self.at[i][0], self.at[j - 1][1]
        s = self.text[a:b]
        on = ["any", ("no @", "one @", "several @")[min(ats, 2)], "letters" if letters else "no letters"]
        on.append("starts +" if s[0] == "+" else "starts (" if s[0] == "(" else "starts digit" if digit[i] else "starts letter")
        if letter[j - 1]:
            on.append("ends letter")
        if i and self.at[i - 1][1] == a and (digit[i - 1] or letter[i - 1] or shown[i - 1] in "+.@_-%="):
            on.append("touches left")
        if j < len(shown) and self.at[j][0] == b and (digit[j] or letter[j] or shown[j] in "@_=" or shown[j] in ".-" and j + 1 < len(shown) and self.at[j + 1][0] == b + 1):
            on.append("touches right")
        if not letters and not ats:
            if 14 <= digits <= 19:
                on.append("luhn" if luhn(_NOT_DIGIT.sub("", s)) else "fails luhn")
            on.append("quad" if _QUAD.fullmatch(s) and all(int(p) <= 255 for p in s.split(".")) else "no quad")
        if ats:
            local, _, domain = s.partition("@")
            on.append("domain" if _MAIL_DOMAIN.fullmatch(domain) else "no domain")
            if any(c not in _LOCAL for c in local):
                on.append("spaced local")
        gaps = [self.at[x + 1][0] - self.at[x][1] for x in range(i, j - 1)]
        if any(gaps):
            on.append("spaces" if max(gaps) == 1 else "wide space")
        if "-" in s:
            on.append("hyphen")
        if "." in s:
            on.append("dot")
        if "(" in s or ")" in s:
            on.append("parentheses" if s.count("(") == s.count(")") else "open parenthesis")
        if any(c in s for c in "/\\:;,=\"'#*!?<>[]{}|~&$"):
            on.append("other sign")
        out = [FLAG[x] for x in on]
        out.append(len(_FLAGS) + max(x for x, n in enumerate(_DIGITS) if digits >= n))
        out.append(len(_FLAGS) + len(_DIGITS) + min(len(lengths), 7))
        if not letters and not ats:
            out.append(len(_FLAGS) + len(_DIGITS) + 8 + _pattern_slot(lengths))
        return out


def _lse(x: np.ndarray, axis=0) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


class Field:
    """Weights: features by kind, and transitions between segments (0: a token without a kind, then the kinds)."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((FEATURES, len(KINDS))) if weights is None else weights
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1)) if moves is None else moves

    def _scores(self, w: Window) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) for _, _, f in w.segments]).reshape(-1, len(KINDS))

    def _sums(self, w: Window, score: np.ndarray):
        """Forward sums by end and kind, the same before a segment begins, backward sums, and the whole."""
        n, k = len(w.at), len(KINDS) + 1
        ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for x, (i, j, _) in enumerate(w.segments):
            ends[j].append(x)
            starts[i].append(x)
        first = np.array([s[0] for s in w.segments], int)
        last = np.array([s[1] for s in w.segments], int)
        low = -1e30
        forward, enter, backward = np.full((n + 1, k), low), np.full((n + 1, k), low), np.full((n + 1, k), low)
        forward[0, 0] = 0.0
        for j in range(n + 1):
            if j:
                forward[j, 0] = enter[j - 1, 0]
                if ends[j]:
                    forward[j, 1:] = _lse(enter[first[ends[j]], 1:] + score[ends[j]])
            enter[j] = _lse(forward[j][:, None] + self.moves)
        backward[n] = 0.0
        for i in range(n - 1, -1, -1):
            leave = np.full(k, low)
            leave[0] = backward[i + 1, 0]
            if starts[i]:
                leave[1:] = _lse(backward[last[starts[i]], 1:] + score[starts[i]])
            backward[i] = _lse((self.moves + leave[None, :]).T)
        return forward, enter, backward, float(_lse(forward[n]))

    def probabilities(self, w: Window, score: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Probability of each segment with each kind."""
        sums = self._sums(w, score)
        _, enter, backward, whole = sums
        first, last = np.array([s[0] for s in w.segments], int), np.array([s[1] for s in w.segments], int)
        return np.exp(enter[first, 1:] + score + backward[last, 1:] - whole), sums

    def gradient(self, w: Window, truth: list[tuple[int, int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log-likelihood of the true segments (first token, end token, kind) and its gradients."""
        score = self._scores(w)
        p, (forward, enter, backward, whole) = self.probabilities(w, score)
        place = {(i, j): x for x, (i, j, _) in enumerate(w.segments)}
        g, moves, value, at, kind = np.zeros_like(self.weights), np.zeros_like(self.moves), 0.0, 0, 0
        for x, (_, _, f) in enumerate(w.segments):
            g[f] += p[x]
        n = len(w.at)
        for i in range(n):  # a move into a token without a kind, and into each segment that begins here
            moves[:, 0] += np.exp(forward[i] + self.moves[:, 0] + backward[i + 1, 0] - whole)
        for x, (i, j, _) in enumerate(w.segments):
            moves[:, 1:] += np.exp(forward[i][:, None] + self.moves[:, 1:] + score[x] + backward[j, 1:] - whole)
        for i, j, k in [*truth, (n, n, -1)]:
            while at < i:
                moves[kind, 0] -= 1
                value += self.moves[kind, 0]
                kind, at = 0, at + 1
            if k >= 0:
                x = place[i, j]
                g[w.segments[x][2], k] -= 1
                moves[kind, k + 1] -= 1
                value += self.moves[kind, k + 1] + score[x, k]
                kind, at = k + 1, j
        return whole - value, g, moves

    def best(self, w: Window) -> list[tuple[int, int, int, float]]:
        """Segments (first token, end token, kind) of the best segmentation with their probabilities."""
        if not w.segments:
            return []
        score = self._scores(w)
        n, k = len(w.at), len(KINDS) + 1
        ends = [[] for _ in range(n + 1)]
        for x, (_, j, _) in enumerate(w.segments):
            ends[j].append(x)
        value, back = np.full((n + 1, k), -1e30), {}
        value[0, 0] = 0.0
        for j in range(1, n + 1):
            step = value[j - 1] + self.moves[:, 0]
            value[j, 0], back[j, 0] = step.max(), (j - 1, int(step.argmax()), -1)
            for x in ends[j]:
                i = w.segments[x][0]
                step = value[i][:, None] + self.moves[:, 1:] + score[x]
                for c in np.flatnonzero(step.max(axis=0) > value[j, 1:]).tolist():
                    value[j, c + 1], back[j, c + 1] = step[:, c].max(), (i, int(step[:, c].argmax()), x)
        out, at = [], (n, int(value[n].argmax()))
        while at[0] > 0:
            i, kind, x = back[at]
            if x >= 0:
                out.append((i, at[0], at[1] - 1, x))
            at = (i, kind)
        p, _ = self.probabilities(w, score) if out else (None, None)
        return [(i, j, kind, float(p[x, kind])) for i, j, kind, x in reversed(out)]


def _truth(w: Window, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]] | None:
    """Spans as segments; None if one is no segment or two of them meet."""
    first, end = {a: i for i, (a, _) in enumerate(w.at)}, {b: i + 1 for i, (_, b) in enumerate(w.at)}
    offered, out, done = {(i, j) for i, j, _ in w.segments}, [], 0
    for s, k, e in sorted(spans):
        i, j = first.get(s, -1), end.get(e, -1)
        if (i, j) not in offered or i < done:
            return None
        out.append((i, j, k))
        done = j
    return out


def _copies(rows: list[tuple[str, list]]) -> list[tuple[str, list]]:
    """Windows beside each other, and windows whose phones lost the plus sign."""
    out = []
    for (t, spans), (u, more) in zip(rows[::3], rows[1::3]):
        out.append((f"{t} {u}", [*spans, *((s + len(t) + 1, k, e + len(t) + 1) for s, k, e in more)]))
    for t, spans in rows[2::3]:
        if len(spans) == 1 and spans[0][1] == 3 and (cut := re.match(r"\+[0-9]{1,3} ?", t[spans[0][0] :])):
            s, k, e = spans[0]
            out.append((t[:s] + t[s + cut.end() :], [(s, k, e - cut.end())]))
    return out


def fit(rows: list[tuple[str, str]]) -> Field:
    """The field for windows and their base spans."""
    rows = [(t, read(spans)) for t, spans in rows]
    cases = [(w, truth) for t, spans in [*rows, *_copies(rows)] for w in [Window(t)] if w.segments and (truth := _truth(w, spans)) is not None]
    field = Field()
    if not cases:
        field.weights[FLAG["any"]] = -30.0  # nothing is an entity
        return field
    turn, order = Adam(field.weights, field.moves, rate=0.15), np.random.default_rng(7)
    for _ in range(EPOCHS):
        mixed = order.permutation(len(cases))
        for b in range(0, len(mixed), BATCH):
            some = [cases[x] for x in mixed[b : b + BATCH]]
            made = [field.gradient(w, truth) for w, truth in some]
            turn.step(sum(m[1] for m in made) / len(some) + 1e-3 * field.weights, sum(m[2] for m in made) / len(some) + 1e-3 * field.moves)
    return field


# Tables -------------------------------------------------------------------------------------------------------------

FOUND = "doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, windows array<string>, starts array<int>, held array<string>, clear array<boolean>"


def found(docs: DataFrame) -> DataFrame:
    """Base spans of each document, and its windows with their base spans (positions in the window)."""
    def one(text: str):
        spans, ran = base_spans(text)
        shown, starts, held, clear = [], [], [], []
        if spans or ran or _worth(text):
            for a, b in windows(text):
                shown.append(text[a:b])
                starts.append(a)
                held.append(written([(max(s, a) - a, k, min(e, b) - a) for s, k, e in _within(spans, a, b)]))
                clear.append(not any(s < b and a < e for s, e in ran))
        return written(spans), *(sum(k == x for _, k, _ in spans) for x in range(4)), shown, starts, held, clear

    nothing = ("", 0, 0, 0, 0, [], [], [], [])
    types = [pa.string(), *([pa.int64()] * 4), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.bool_())]

    def run(batches):
        for batch in batches:
            hot = pc.fill_null(pc.match_substring_regex(batch.column(1), "[0-9@]"), False)
            rows = [one(t.as_py()) if h.as_py() else nothing for t, h in zip(batch.column(1), hot)]
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "base", "n_email", "n_ip", "n_card", "n_phone", "windows", "starts", "held", "clear"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), FOUND)


def _within(spans, a: int, b: int):
    """Spans that meet [a, b); spans are sorted by start."""
    return [x for x in spans if x[0] < b and a < x[2]]


def learned(rows: DataFrame) -> Field:
    """The field fitted on a bounded sample of the windows of `found`."""
    cases = rows.select(F.inline(F.arrays_zip("windows", "held", "clear"))).where(F.col("clear") & (F.length("windows") <= SAMPLE_CHARS))
    cases = cases.groupBy("windows", "held").agg(F.count("*").alias("n")).select("windows", "held")
    cases = cases.orderBy(F.xxhash64("windows", "held"), "windows", "held").limit(SAMPLE)

    def run(batches):
        got = sorted((t, s) for batch in batches for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        np.random.default_rng(3).shuffle(got)
        field = fit([tuple(x) for x in got])
        out = io.BytesIO()
        np.savez(out, weights=field.weights, moves=field.moves)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    got = cases.repartition(1).mapInArrow(tidy(run), "model binary").first()
    if not got:
        return fit([])
    model = np.load(io.BytesIO(got["model"]))
    return Field(model["weights"], model["moves"])


def added(field: Field, text: str, held: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) the field adds to the base spans of a window."""
    free = list(text)
    for s, _, e in held:
        free[s:e] = " " * (e - s)
    if not _worth("".join(free)):
        return []
    w = Window(text, held)
    return [(w.at[i][0], k, w.at[j - 1][1]) for i, j, k, p in field.best(w) if p >= CERTAIN]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added."""
    rows = materialise(found(docs), "windows")
    field = learned(rows)
    shared = rows.sparkSession.sparkContext.broadcast((field.weights, field.moves))  # fixed size

    def run(batches):
        field = Field(*shared.value)
        for batch in batches:
            base, shown, starts, held = (batch.column(i).to_pylist() for i in range(5, 9))
            digest, whole, n = [], [], []
            for b, ws, ss, hs in zip(base, shown, starts, held):
                more = [(s + at, k, e + at) for text, at, h in zip(ws, ss, hs) for s, k, e in added(field, text, read(h))]
                digest.append(hashlib.sha256(b.encode()).hexdigest())
                whole.append(written(sorted([*read(b), *more])) if more else b)
                n.append(len(more))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(digest), pa.array(whole), pa.array(n, pa.int64())], names=[
                "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    plain = rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "windows", "starts", "held")
    return plain.mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
