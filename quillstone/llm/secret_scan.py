"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are all runs of `[A-Za-z0-9+/_=.-]`; each is outside, the begin or the inside of a secret. Features are a token's
shape (length, kinds of characters, vowels, turns between digits and letters and between cases), its neighbours (words
and marks before and after) and its file (how dense odd tokens are). They are computed for a whole slice of text at once.

Viterbi decodes the best tag sequence of each text. A token whose score for `outside` is ahead of the others by more than
all transitions around it can make up for is `outside` in the best sequence, whatever its neighbours are; so the
sequence falls apart there, and only the stretches between such tokens are decoded step by step. That is exact.

Weights are trained here by maximum likelihood (forward-backward, all stretches at once) on a bounded sample of
documents. The fixed patterns give tags there, and made-up keys of several alphabets are planted between words, since
patterns alone would teach their own key words only. Context features are dropped at random while training, so that
shape alone can carry a token and secrets are found where no key word stands before them.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import GOLD, LOWER, Words, hash_sample, mix, slices, text_bytes

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = {"assign": 0, "access": 1, "hex": 2, "crf": 3}

_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
TOKEN = np.zeros(256, bool)
TOKEN[list(_LETTERS + b"0123456789+/_=.-")] = True
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True

def _among(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


DIGITS, UPPER, LOWER_CASE = _among(b"0123456789"), _among(_LETTERS[:26]), _among(_LETTERS[26:])
VOWELS, DOTS = _among(b"aeiouyAEIOUY"), _among(b".")
#: Kinds of first and last characters: mark, digit, upper, lower.
KIND_OF = DIGITS * np.int64(1) + UPPER * np.int64(2) + LOWER_CASE * np.int64(3)

O, B, I = 0, 1, 2  # noqa: E741
BUCKETS = 1 << 14
NEVER = -1e9
#: Alphabets of the keys planted for training.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _LETTERS.decode(), _LETTERS.decode() + "0123456789", _LETTERS.decode() + "0123456789+/_-")
#: Documents and bytes of text of the training sample, stretches used of them, and tokens of a stretch.
TRAIN_DOCS = 4000
TRAIN_BYTES = 32 << 20
TRAIN_STRETCHES = 6000
LONGEST = 8
#: Of stretches without any odd token one in so many is for training.
ORDINARY = 16
#: Tokens whose scores are summed up at once.
BLOCK_TOKENS = 1 << 14


def base_spans(text: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, leftmost and without overlap for each kind. hex_runs: all maximal runs of hex digits of 24 or more."""
    out = [(s, e, "hex") for s, e in hex_runs]
    if b"=" in text or b":" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return sorted(out, key=lambda x: (x[0], KINDS[x[2]]))


class Tokens:
    """All tokens of a slice of texts, their features, and the runs of hex digits of 24 or more by text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        words = Words(data, offs, TOKEN, LOWER)
        self.starts, self.ends, self.first, self.hashes = words.starts, words.ends, words.first, words.hashes
        self.text = np.searchsorted(self.first, np.arange(len(self.starts)), "right") - 1
        runs = Words(data, offs, HEX, hashed=False)
        long = np.flatnonzero(runs.ends - runs.starts >= 24)
        where = np.searchsorted(runs.first, long, "right") - 1
        self.hex: dict[int, list[tuple[int, int]]] = {}
        for t, s, e in zip(where.tolist(), (runs.starts[long] - offs[where]).tolist(), (runs.ends[long] - offs[where]).tolist(), strict=True):
            self.hex.setdefault(t, []).append((s, e))
        digits = self.count(DIGITS)
        self.odd = (self.ends - self.starts >= 8) & (digits > 0)
        per_text = np.bincount(self.text[self.odd], minlength=len(offs) - 1)
        self.density = np.minimum(9, 2000 * per_text // np.maximum(np.diff(offs), 200))

    def text_bytes(self, k: int) -> bytes:
        return self.data[self.offs[k] : self.offs[k + 1]].tobytes()

    def count(self, kind: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """How many characters of a kind each of the tokens lo .. hi has."""
        return self._sums(kind, lo, hi, turns=False)

    def turns(self, kind: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """How often two neighbouring characters of a token differ in being of a kind."""
        return self._sums(kind, lo, hi, turns=True)

    def _sums(self, kind: np.ndarray, lo: int, hi: int | None, turns: bool) -> np.ndarray:
        out = []
        for k in range(lo, len(self.starts) if hi is None else hi, BLOCK_TOKENS):
            s, e = self.starts[k : min(k + BLOCK_TOKENS, len(self.starts) if hi is None else hi)], self.ends[k : min(k + BLOCK_TOKENS, len(self.ends) if hi is None else hi)]
            inside = kind[self.data[s[0] : e[-1]]]
            if turns:
                inside = np.concatenate([[False], inside[1:] != inside[:-1]])
            sums = np.concatenate([[0], np.cumsum(inside)])
            out.append(sums[e - s[0]] - sums[s - s[0] + (1 if turns else 0)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def features(self, lo: int, hi: int, density: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of the tokens lo .. hi, a row for each: (shape and file, context)."""
        s, e, data = self.starts[lo:hi], self.ends[lo:hi], self.data
        n = e - s
        digits, upper, lower = (self.count(k, lo, hi) for k in (DIGITS, UPPER, LOWER_CASE))
        letters, marks = upper + lower, n - digits - upper - lower
        kind = (digits > 0) * 1 + (upper > 0) * 2 + (lower > 0) * 4 + (marks > 0) * 8
        whole_hex = self.count(HEX, lo, hi) == n
        cases = np.minimum(self.turns(UPPER, lo, hi), 12)
        eighth, vowels = np.minimum(n // 8, 6), self.count(VOWELS, lo, hi)
        files = np.full(len(n), density) if density is not None else self.density[self.text[lo:hi]]
        shape = (
            np.minimum(n, 48) // 2, kind, 10 * digits // n, 10 * vowels // np.maximum(letters, 1) + 11 * (letters == 0), np.minimum(self.turns(DIGITS, lo, hi), 12),
            cases, (np.minimum(cases, 3) * 16 + kind) * 7 + eighth, kind * 7 + eighth, whole_hex * 7 + eighth, np.minimum(self.count(DOTS, lo, hi), 4), np.minimum(marks, 4),
            KIND_OF[data[s]] * 4 + KIND_OF[data[e - 1]], files, np.zeros(len(n), np.int64),
        )
        begin, end = self.offs[self.text[lo:hi]], self.offs[self.text[lo:hi] + 1]
        at = lambda place: np.where((place >= begin) & (place < end), data[np.clip(place, 0, len(data) - 1)].astype(np.int64), 256)

        def neighbour(step: int) -> np.ndarray:
            k = np.arange(lo, hi) + step
            inside = (k >= 0) & (k < len(self.text))
            inside[inside] = self.text[k[inside]] == self.text[lo:hi][inside]
            return np.where(inside, (self.hashes[np.clip(k, 0, len(self.hashes) - 1)] >> np.uint64(20)).astype(np.int64), 0)

        mark = at(s - 1)
        context = (neighbour(-1), neighbour(-2), neighbour(1), mark, at(s - 2) * 257 + mark, at(e), (mark == 64) | (at(e) == 64))
        number = lambda j, x: (mix((np.asarray(x).astype(np.uint64) + np.uint64(j << 48)) * GOLD) % np.uint64(BUCKETS)).astype(np.int64)
        return np.stack([number(j, x) for j, x in enumerate(shape, 1)], axis=1), np.stack([number(j, x) for j, x in enumerate(context, 50)], axis=1)


def features(text: bytes, start: int, end: int, density: int) -> tuple[list[int], list[int]]:
    """Feature numbers of the token at start of a text of that density: (shape and file, context)."""
    data = np.frombuffer(text, np.uint8)
    tokens = Tokens(data, np.array([0, len(data)]))
    k = int(np.searchsorted(tokens.starts, start))
    shape, context = tokens.features(k, k + 1, density)
    return shape[0].tolist(), context[0].tolist()


def secret_places(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Of base spans the secret itself: the value of an assignment, or all of another span."""
    return sorted({(ASSIGN.match(text, s).start(2), e) if kind == "assign" else (s, e) for s, e, kind in spans})


def planted(text: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The text with up to two made-up keys put in at spaces, always the same ones for a text, and where they stand."""
    rng = random.Random(zlib.crc32(text))
    spaces = [k for k in (text.find(b" ", rng.randrange(len(text) + 1)) for _ in range(rng.randrange(3))) if k >= 0]
    out, spans, last, shift = [], [], 0, 0
    for k in sorted(set(spaces)):
        key = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(16, 44))).encode()
        out += [text[last:k], b" ", key]
        spans.append((k + shift + 1, k + shift + 1 + len(key)))
        last, shift = k, shift + 1 + len(key)
    return b"".join([*out, text[last:]]), spans


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches for training: (is ordinary, hash, tags, shape, context), the last three packed."""
    for batch in slices(batches):
        texts = [planted(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
        tokens, rows = Tokens(*text_bytes(pa.array([t for t, _ in texts], pa.binary()))), []
        tags = np.zeros(len(tokens.starts), np.int64)
        for t in range(batch.num_rows):
            text = tokens.text_bytes(t)
            lo, hi, base = int(tokens.first[t]), int(tokens.first[t + 1]), int(tokens.offs[t])
            for s, e in sorted({*secret_places(text, base_spans(text, tokens.hex.get(t, []))), *texts[t][1]}):
                k = lo + int(np.searchsorted(tokens.ends[lo:hi], base + s, "right"))
                end = lo + int(np.searchsorted(tokens.starts[lo:hi], base + e))
                tags[k:end] = I
                tags[k : min(k + 1, end)] = B
            shapes, contexts = (x.astype(np.int32) for x in tokens.features(lo, hi)) if hi > lo else ((), ())
            for k in range(lo, hi, LONGEST):
                end = min(k + LONGEST, hi)
                if tags[k] == I:
                    continue
                secret, key = bool(tags[k:end].any()), int(np.bitwise_xor.reduce(mix(tokens.hashes[k:end] + np.arange(end - k, dtype=np.uint64))))
                if secret or tokens.odd[k:end].any() or key % ORDINARY == 0:
                    part = slice(k - lo, end - lo)
                    rows.append((not secret, key - (1 << 63), tags[k:end].astype(np.int32).tobytes(), shapes[part].tobytes(), contexts[part].tobytes()))
        kinds = (pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["ordinary", "key", "tags", "shape", "context"])


class Chain:
    """Weights of the field: unary (feature, tag) and moves (tag, tag). Stretches begin after and end before `outside`."""

    def __init__(self, unary: np.ndarray, moves: np.ndarray):
        self.unary, self.moves = unary, moves

    @classmethod
    def allowed(cls) -> np.ndarray:
        blocked = np.zeros((3, 3))
        blocked[O, I] = NEVER
        return blocked

    def viterbi(self, stretch: list[list[int]]) -> list[int]:
        """The best tags of tokens with these feature numbers, between tokens outside."""
        return self.decode([self.unary[ids].sum(axis=0) for ids in stretch])

    def decode(self, scores) -> list[int]:
        score, back, moves = None, [], self.moves + self.allowed()
        for here in scores:
            if score is None:
                score = moves[O] + here
            else:
                step = score[:, None] + moves
                back.append(step.argmax(axis=0))
                score = step.max(axis=0) + here
        tag = int((score + moves[:, O]).argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]

    def tags(self, tokens: Tokens) -> Iterator[tuple[int, list[int]]]:
        """(first token, tags) of each stretch of the best sequences; all tokens between stretches are outside."""
        unary, parts = self.unary.astype(np.float32), [np.zeros((0, 3), np.float32)]
        for lo in range(0, len(tokens.starts), BLOCK_TOKENS):
            shape, context = tokens.features(lo, min(lo + BLOCK_TOKENS, len(tokens.starts)))
            parts.append(sum(unary[ids] for ids in (*shape.T, *context.T)))
        scores = np.concatenate(parts)
        allowed = np.delete(self.moves.ravel(), O * 3 + I)
        follow = np.zeros(len(scores))
        follow[:-1] = np.where(tokens.text[1:] == tokens.text[:-1], np.maximum(0, scores[1:, I] - scores[1:, B]), 0)
        open_ = np.flatnonzero(scores[:, O] - scores[:, 1:].max(axis=1) <= 3 * (allowed.max() - allowed.min()) + follow + 1e-3)
        if len(open_):
            cuts = np.flatnonzero((np.diff(open_) > 1) | (np.diff(tokens.text[open_]) > 0)) + 1
            for stretch in np.split(open_, cuts):
                yield int(stretch[0]), self.decode(scores[stretch].astype(float))

    @classmethod
    def train(cls, examples: list[tuple[list[int], list[list[int]], list[list[int]]]], epochs: int = 120, rate: float = 0.1, decay: float = 3e-4, dropped: float = 0.5, seed: int = 7) -> Chain:
        """Maximum likelihood by Adam; every step is over all examples, so its result doesn't depend on their order."""
        model = cls(np.zeros((BUCKETS, 3)), np.zeros((3, 3)))
        if not examples:
            model.unary[:, O] = 1.0
            return model
        examples = sorted(examples)
        n, longest = len(examples), max(len(e[0]) for e in examples)
        tags, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        place, feature, is_context = [], [], []
        for k, (t, shape, context) in enumerate(examples):
            tags[k, : len(t)], real[k, : len(t)] = t, True
            for j in range(len(t)):
                for ids, flag in ((shape[j], False), (context[j], True)):
                    place += [k * longest + j] * len(ids)
                    feature += list(ids)
                    is_context += [flag] * len(ids)
        place, feature, is_context = np.array(place), np.array(feature), np.array(is_context)
        ends = real.sum(axis=1) - 1
        rng, blocked, rows = np.random.default_rng(seed), cls.allowed(), np.arange(n)
        gold = np.zeros((n, longest, 3))
        gold[rows[:, None], np.arange(longest), tags] = real
        gold_moves = np.zeros((3, 3))
        np.add.at(gold_moves, (O, tags[:, 0]), 1)
        np.add.at(gold_moves, (tags[rows, ends], O), 1)
        for j in range(1, longest):
            np.add.at(gold_moves, (tags[:, j - 1], tags[:, j]), real[:, j])
        state = [np.zeros_like(x) for x in (model.unary, model.unary, model.moves, model.moves)]
        for epoch in range(1, epochs + 1):
            on = ~(is_context & (rng.random(n * longest) < dropped)[place])
            p, f = place[on], feature[on]
            u = np.stack([np.bincount(p, model.unary[f, t], n * longest) for t in range(3)], axis=1).reshape(n, longest, 3)
            m = model.moves + blocked
            forward, backward = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
            forward[:, 0] = m[O] + u[:, 0]
            for j in range(1, longest):
                forward[:, j] = np.logaddexp.reduce(forward[:, j - 1, :, None] + m, axis=1) + u[:, j]
            for j in range(longest - 1, -1, -1):
                inner = np.logaddexp.reduce(m + (u[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2) if j + 1 < longest else 0
                backward[:, j] = np.where((ends == j)[:, None], m[:, O], inner)
            total = np.logaddexp.reduce(forward[rows, ends] + m[:, O], axis=1)
            marginal = np.where(real[:, :, None], np.exp(forward + backward - total[:, None, None]), 0)
            g = (marginal - gold).reshape(-1, 3)
            grad = np.stack([np.bincount(f, g[p, t], BUCKETS) for t in range(3)], axis=1) / n + decay * model.unary
            expected = np.zeros((3, 3))
            expected[O] += marginal[:, 0].sum(axis=0)
            expected[:, O] += marginal[rows, ends].sum(axis=0)
            for j in range(1, longest):
                pair = forward[:, j - 1, :, None] + m + (u[:, j] + backward[:, j])[:, None, :] - total[:, None, None]
                expected += np.exp(pair[real[:, j]]).sum(axis=0)
            grad_moves = (expected - gold_moves) / n + decay * model.moves
            for k, (w, d) in enumerate(((model.unary, grad), (model.moves, grad_moves))):
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * d
                state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * d * d
                w -= rate * (state[2 * k] / (1 - 0.9**epoch)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**epoch)) + 1e-8)
        return model


def train_chain(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = TRAIN_DOCS, stretches: int = TRAIN_STRETCHES, most_bytes: int = TRAIN_BYTES
) -> Chain:
    """Train on the docs documents of smallest id hash (most_bytes of text of them at most), and on `stretches` stretches of theirs.

    Stretches with a secret come first, then those of smallest hash, so that weights are the same each time.
    """
    sample = hash_sample(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", docs, "text", most_bytes)
    found = sample.select("text").mapInArrow(_examples, "ordinary boolean, key long, tags binary, shape binary, context binary")
    rows = found.orderBy("ordinary", "key", "tags", "shape", "context").limit(stretches).collect()
    lists = lambda raw, n: np.frombuffer(raw, np.int32).reshape(n, -1).tolist()
    return Chain.train([(np.frombuffer(r.tags, np.int32).tolist(), lists(r["shape"], len(r.tags) // 4), lists(r["context"], len(r.tags) // 4)) for r in rows])


def _scan(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in slices(batches):
        tokens, out = Tokens(*text_bytes(batch.column("text"))), []
        fields: dict[int, list[tuple[int, int]]] = {}
        for at, tags in chain.tags(tokens):
            for k, tag in enumerate(tags):
                if tag == B:
                    last = k
                    while last + 1 < len(tags) and tags[last + 1] == I:
                        last += 1
                    t = int(tokens.text[at])
                    fields.setdefault(t, []).append((int(tokens.starts[at + k] - tokens.offs[t]), int(tokens.ends[at + last] - tokens.offs[t])))
        for t in range(batch.num_rows):
            text = tokens.text_bytes(t)
            spans = base_spans(text, tokens.hex.get(t, []))
            spans += [(s, e, "crf") for s, e in fields.get(t, []) if not any(a <= s and e <= b for a, b, _ in spans)]
            if spans and not text.isascii():
                raw = np.frombuffer(text, np.uint8)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                spans = [(int(points[s]), int(points[e]), k) for s, e, k in spans]
            out.append(sorted(spans, key=lambda x: (x[0], KINDS[x[2]])))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in spans] for spans in out], pa.list_(span))], names=["id", "spans"])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: Chain | None = None) -> DataFrame:
    """Per row: id, spans (kind, start, end in code points, by start and then kind).

    Kinds assign, access and hex are the fixed patterns; crf are the trained field's spans (but for those that lie
    inside a pattern's). Null and empty texts have no spans. Every row gives one row, so repeated rows and null ids
    stay. Other columns don't matter; an empty table gives an empty result.
    """
    chain = train_chain(df, id_col, text_col) if chain is None else chain
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = docs.mapInArrow(lambda b: _scan(b, chain), f"id {dict(docs.dtypes)['id']}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)
