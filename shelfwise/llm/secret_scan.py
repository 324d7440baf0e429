"""Secret scan: base patterns, and a character convolution over every other candidate.

The base patterns always report. A small one-dimensional convolutional network in numpy reads each remaining
candidate token inside its surrounding text and adds the spans that it accepts. Candidates are all tokens of LEAST
characters or more, and shorter ones of SHORTEST or more that hold a digit and a letter. The network is trained on a
bounded sample of labelled findings. Positive: base findings (half of them with the telling words around and in
front of the value blanked, so that the value must speak for itself), and keys of other alphabets drawn from a hash of each of them.
Negative: tokens that only look long, and identifiers, UUIDs, dated paths, versions and numbers formed from the documents' own words.
Its output is calibrated on held-back findings (Platt scaling). Long and short candidates have a threshold each that
keeps the wanted recall on the held-back findings, however low: for short ones the highest such, for long ones halfway (in log odds) down to the
next benign token, which costs no precision there. Recall and precision on them are kept with the network.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from shelfwise.llm.textvec import as_array

# fixed values of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")

LEAST = 16              # characters of a candidate of any kind
SHORTEST = 6            # and of one with a digit and a letter
TOKEN_CHARS = "A-Za-z0-9+/_=-"
CANDIDATE = re.compile(rf"[{TOKEN_CHARS}]{{{LEAST},}}")
_BEFORE = re.compile(rf"[{TOKEN_CHARS}]*\Z")
_AFTER = re.compile(rf"[{TOKEN_CHARS}]*")
_DIGITS = re.compile("[0-9]+")
TRAIN_DOCS = 20_000     # bound of the documents whose findings are training data
TRAIN_FINDINGS = 3_000  # and of the findings of each label
RECALL, SHORT_RECALL = 0.98, 0.9
KEYS, PLAIN = 8, 3      # keys drawn for a base finding, plain tokens for a document
LOGIT = 30.0            # bound of the calibrated logit: probabilities stay inside (0, 1)
LEFT, TOKEN, RIGHT = 16, 40, 8
STRIDE = 20             # of the windows over a candidate longer than TOKEN
WIDTH = LEFT + TOKEN + RIGHT
JUDGED = 8192           # windows judged at a time
DRAWN = 4               # kind of a drawn key or plain token
_WORDS = re.compile("[A-Za-z]{2,12}")
_LABELLED = "label int, kind int, codes binary"


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and not overlapping per kind, in code
    points, ordered by start and kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _mixed(token: str) -> bool:
    """Has a digit and a letter: what can be a secret at all."""
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def short_candidates(text: str) -> list[tuple[int, int]]:
    """Whole tokens of SHORTEST to LEAST - 1 characters with a digit and a letter. The search goes from digit to digit and looks
    LEAST characters around, so a long token costs no more than its digits."""
    out, end = [], 0
    for m in _DIGITS.finditer(text):
        if m.start() < end:
            continue
        a = m.start() - len(_BEFORE.search(text[max(0, m.start() - LEAST):m.start()])[0])
        b = _AFTER.match(text, m.start(), m.end() + LEAST).end()
        end = b
        if SHORTEST <= b - a < LEAST and _mixed(text[a:b]):
            out.append((a, b))
    return out


def other_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Long tokens, and what base findings leave of those that they touch where that is long enough; then short mixed tokens that
    no base finding touches."""
    out = []
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        for a, b in _touching(base, at, end):
            if a - at >= LEAST:
                out.append((at, a))
            at = max(at, b)
        if end - at >= LEAST:
            out.append((at, end))
    return out + [(a, b) for a, b in short_candidates(text) if not _touching(base, a, b)]


def _touching(base: list[tuple[int, int, int]], at: int, end: int) -> list[tuple[int, int]]:
    return sorted((a, b) for a, b, _ in base if a < end and at < b)


_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (_UPPER + _LOWER + _DIGIT, _UPPER + _LOWER + _DIGIT + "+/", _UPPER + _LOWER + _DIGIT + "-_", _UPPER + "234567", _DIGIT + "ABCDEF",
             _LOWER + _DIGIT)
PREFIXES = ("", "", "", "sk_live_", "pk_test_", "key-", "eyJ")


def key_like(rng: random.Random) -> str:
    """A key of one of several alphabets, with a digit and a letter; a third are short."""
    n = rng.randint(10, LEAST - 1) if rng.random() < 1 / 3 else rng.randint(LEAST, 64)
    alphabet, prefix = rng.choice(ALPHABETS), rng.choice(PREFIXES) if n >= LEAST else ""
    while True:
        key = "".join(rng.choices(alphabet, k=n))
        if _mixed(key):
            return prefix + key


def plain_like(rng: random.Random, words: list[str]) -> str:
    """A token that holds digits and is no secret, from words of the document itself."""
    w = lambda: rng.choice(words)
    d = lambda n: "".join(rng.choices(_DIGIT, k=n))
    h = lambda n: "".join(rng.choices(_DIGIT + "abcdef", k=n))
    day = f"{rng.randint(1980, 2039)}{rng.choice('-/')}{rng.randint(1, 12):02d}{rng.choice('-/')}{rng.randint(1, 28):02d}"
    form = rng.randrange(12)
    if form in (0, 1):
        uuid = "-".join(h(n) for n in (8, 4, 4, 4, 12))
        return uuid.upper() if rng.random() < 0.25 else uuid
    return ("/".join([*(w() for _ in range(rng.randint(1, 3))), day, *(w() for _ in range(rng.randint(0, 2)))]),
            f"/{w()}/{w()}/{d(rng.randint(1, 9))}/{w()}",
            f"{w()}-{d(1)}-{d(rng.randint(1, 2))}-{d(rng.randint(1, 3))}-{w()}",
            f"{w()}_{d(rng.randint(1, 2))}_{w()}",
            f"{d(3)}-{d(1)}-{d(rng.randint(2, 5))}-{d(rng.randint(3, 6))}-{d(1)}",
            f"{day}T{d(4)}",
            "".join([w().lower(), *(w().capitalize() for _ in range(rng.randint(1, 4)))]) + d(rng.randint(1, 3)),
            f"{w()}{d(rng.randint(1, 4))}",
            "-".join(w() for _ in range(rng.randint(2, 6))) + f"-{d(rng.randint(1, 4))}",
            f"{w()}={d(rng.randint(1, 8))}")[form - 2]


def windows(start: int, end: int) -> list[int]:
    """Starts of the windows of TOKEN characters that cover a candidate; the last one ends with it."""
    last = max(start, end - TOKEN)
    return [*range(start, last, STRIDE), last]


def codes(text: str, start: int, end: int, blank: bool = False, at: int | None = None) -> bytes:
    """WIDTH character codes around a candidate: its left context, its characters from ``at`` (the first ones), what follows."""
    at = start if at is None else at
    left = text[max(0, start - LEFT):start].encode("latin-1", "replace").rjust(LEFT, b"\0")
    token = text[at:min(end, at + TOKEN)].encode("latin-1", "replace").ljust(TOKEN, b"\0")
    right = text[end:end + RIGHT].encode("latin-1", "replace").ljust(RIGHT, b"\0")
    if blank:
        left, right = bytes(LEFT), bytes(RIGHT)
    return left + token + right


def _features(raw: np.ndarray) -> np.ndarray:
    """Character classes as planes: lower, upper, digit, hex letter, vowel, punctuation, =:, quotes, blank, and which
    characters belong to the token."""
    c = raw
    low, up, dig = (c >= 97) & (c <= 122), (c >= 65) & (c <= 90), (c >= 48) & (c <= 57)
    lower = np.where(up, c + 32, c)
    token = np.zeros(c.shape, bool)
    token[:, LEFT:LEFT + TOKEN] = c[:, LEFT:LEFT + TOKEN] > 0
    planes = [low, up, dig, (low | up) & (lower <= 102), np.isin(lower, np.frombuffer(b"aeiouy", np.uint8)), np.isin(c, np.frombuffer(b"+/_-.", np.uint8)),
              np.isin(c, np.frombuffer(b"=:", np.uint8)), np.isin(c, np.frombuffer(b"\"'", np.uint8)), c <= 32, token]
    return np.stack(planes, axis=2).astype(np.float32)


PLANES, FILTERS, TAPS, HIDDEN = 10, 16, 5, 16


@dataclass
class Network:
    """conv(TAPS) -> relu -> mean and maximum over the window -> dense -> relu -> logit, with a
    calibrated slope and offset and the accepting thresholds; ``held_back`` has (findings, recall, precision) by length."""

    weights: list[np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0  # accepts nothing
    short_threshold: float = 2.0
    held_back: dict = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32)
        return Network([scale(TAPS * PLANES, FILTERS), np.zeros(FILTERS, np.float32), scale(2 * FILTERS, HIDDEN),
                        np.zeros(HIDDEN, np.float32), scale(HIDDEN, 1), np.zeros(1, np.float32)])

    def forward(self, x: np.ndarray) -> tuple:
        w1, b1, w2, b2, w3, b3 = self.weights
        n, t = len(x), WIDTH - TAPS + 1
        cols = np.concatenate([x[:, k:k + t] for k in range(TAPS)], axis=2)
        a = np.maximum(cols.reshape(n * t, -1) @ w1 + b1, 0).reshape(n, t, FILTERS)
        top = a.argmax(axis=1)
        pooled = np.concatenate([a.mean(axis=1), np.take_along_axis(a, top[:, None], axis=1)[:, 0]], axis=1)
        h = np.maximum(pooled @ w2 + b2, 0)
        return cols, a, top, pooled, h, (h @ w3 + b3)[:, 0]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, rate: float = 4e-3, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        m, v, step = [0.0] * 6, [0.0] * 6, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), 64):
                at = order[a:a + 64]
                cols, act, top, pooled, h, z = self.forward(x[at])
                w1, b1, w2, b2, w3, b3 = self.weights
                g = (((1 / (1 + np.exp(-z))) - y[at]) * weight[at] / len(at)).astype(np.float32)[:, None]
                gh = (g @ w3.T) * (h > 0)
                gp = gh @ w2.T
                ga = np.repeat(gp[:, None, :FILTERS] / act.shape[1], act.shape[1], axis=1)
                np.put_along_axis(ga, top[:, None], np.take_along_axis(ga, top[:, None], axis=1) + gp[:, None, FILTERS:], axis=1)
                ga = (ga * (act > 0)).reshape(-1, FILTERS)
                grads = [cols.reshape(len(ga), -1).T @ ga, ga.sum(0), pooled.T @ gh, gh.sum(0), h.T @ g, g.sum(0)]
                step += 1
                for i, d in enumerate(grads):  # Adam
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    self.weights[i] -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL, short_recall: float = SHORT_RECALL) -> Network:
        """Platt scaling on held-back findings, then for long and for short candidates a threshold with the wanted
        recall on them. Newton steps are halved until the loss falls, and a slope far from 1 costs a little, so that classes far apart
        don't drive it off. Without short findings no short candidate is accepted."""
        z = self._logits(x)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))  # smoothed labels

        def loss(ab: np.ndarray) -> float:
            t = ab[0] * z + ab[1]
            return float((np.logaddexp(0, t) - target * t).sum() + 0.5 * (ab[0] - 1) ** 2)
        ab = np.array([1.0, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(ab[0] * z + ab[1], -LOGIT, LOGIT)))
            w = p * (1 - p)
            g = np.array([((p - target) * z).sum() + ab[0] - 1, (p - target).sum()])
            d = np.linalg.solve(np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]]), g)
            step = 1.0
            while loss(ab - step * d) > loss(ab) and step > 1e-6:
                step /= 2
            ab = ab - step * d
            if np.abs(step * d).max() < 1e-7:
                break
        self.slope, self.offset = float(ab[0]), float(ab[1])
        p, short = self.probability(x), _token_length(x) < LEAST
        for name, some, keep in (("long", ~short, recall), ("short", short, short_recall)):
            true = np.sort(p[some & (y > 0)])
            at = float(true[int((1 - keep) * len(true))]) if len(true) else 2.0
            below = p[some & (y == 0) & (p < at)]
            if name == "long" and len(true) and len(below):
                odds = [np.log(q / (1 - q)) for q in (at, below.max())]
                at = float(1 / (1 + np.exp(-sum(odds) / 2)))
            took = some & (p >= at)
            self.held_back[name] = (len(true), float((true >= at).mean()) if len(true) else 0.0, float(y[took].mean()) if took.any() else 0.0)
            if name == "long":
                self.threshold = at
            else:
                self.short_threshold = at
        return self

    def _logits(self, x: np.ndarray) -> np.ndarray:
        out = [self.forward(x[a:a + 1024])[-1] for a in range(0, len(x), 1024)]
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)

    def accepts(self, x: np.ndarray) -> np.ndarray:
        return self.probability(x) >= np.where(_token_length(x) < LEAST, self.short_threshold, self.threshold)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Strictly between 0 and 1."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self._logits(x) + self.offset, -LOGIT, LOGIT)))


def _token_length(x: np.ndarray) -> np.ndarray:
    """Characters of the token in the window, from its plane of _features."""
    return x[:, :, -1].sum(axis=1)


def _labelled(batches):
    for batch in batches:
        rows = ([], [], [])

        def add(label: int, kind: int, text: str, a: int, e: int, blank: bool) -> None:
            for at in {a, windows(a, e)[-1]}:
                rows[0].append(label), rows[1].append(kind), rows[2].append(codes(text, a, e, blank, at))

        for text in as_array(batch.column("text")).to_pylist():
            base = base_findings(text)
            for s, e, kind in base:
                a = s + len(m[0]) - len(m[2]) if kind == 0 and (m := ASSIGN.match(text, s)) else s
                rng = random.Random(text[a:e])  # the value decides, copies draw the same
                for blank in (False, True):
                    add(1, kind, text, a, e, blank)
                for i in range(KEYS):
                    left, key = text[max(0, s - LEFT):s], key_like(rng)
                    add(1, DRAWN, left + key + text[e:e + RIGHT], len(left), len(left) + len(key), bool(i & 1))
            for s, e in other_candidates(text, base):
                if not _mixed(text[s:e]):  # unlabelled otherwise
                    add(0, -1, text, s, e, bool(s & 1))
            rng = random.Random(text)
            for i in range(PLAIN):
                at = rng.randrange(len(text) + 1)
                gap = text.find(" ", at, at + 200) + 1
                if gap and (words := _WORDS.findall(text[gap:gap + 200])):
                    left, token = text[max(0, gap - LEFT):gap], plain_like(rng, words)
                    add(0, DRAWN, left + token + text[gap - 1:gap - 1 + RIGHT], len(left), len(left) + len(token), i == 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())],
            names=["label", "kind", "codes"])


def _sample(found: DataFrame) -> list:
    """At most TRAIN_FINDINGS findings of each label, by the hash of their codes."""
    return [r for y in (0, 1) for r in found.where(F.col("label") == y).orderBy("h", "codes").limit(TRAIN_FINDINGS).collect()]


def train(docs: DataFrame) -> Network:
    """A network from the findings of at most about TRAIN_DOCS documents (by a hash of id and length), and at
    most TRAIN_FINDINGS distinct ones (by kind and codes) of each label; one without both labels accepts nothing."""
    rows = docs.where("text is not null").select("doc_id", "text")
    every = max(1, -(-rows.count() // TRAIN_DOCS))
    found = (rows.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(every)) == 0).select("text")
             .mapInArrow(_labelled, _LABELLED).dropDuplicates().withColumn("h", F.xxhash64("codes")))
    found = found.persist()
    sample = _sample(found)
    found.unpersist()
    y = np.array([r.label for r in sample], np.float32)
    net = Network.fresh()
    if not sample or y.sum() < 8 or (1 - y).sum() < 8:
        return net
    x = _features(np.frombuffer(b"".join(r.codes for r in sample), np.uint8).reshape(-1, WIDTH))
    held = np.array([r.h % 4 == 0 for r in sample])
    if not (y[held].sum() and (1 - y[held]).sum() and y[~held].sum() and (1 - y[~held]).sum()):
        held = np.arange(len(y)) % 4 == 0
    return net.train(x[~held], y[~held]).calibrate(x[held], y[held])


def find_all(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """Base findings and accepted candidates of each text, by start and kind; a candidate is accepted if any of its windows is."""
    out = [base_findings(t) for t in texts]
    where, raw = [], []
    accepted = set()

    def judge() -> None:
        ok = net.accepts(_features(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WIDTH)))
        accepted.update(w for w, good in zip(where, ok) if good)
        where.clear(), raw.clear()

    for i, (t, base) in enumerate(zip(texts, out)):
        if net.threshold > 1:
            break
        for s, e in other_candidates(t, base):
            for at in windows(s, e):
                where.append((i, s, e)), raw.append(codes(t, s, e, at=at))
                if len(raw) == JUDGED:
                    judge()
    if raw:
        judge()
    for i, s, e in accepted:
        out[i].append((s, e, 3))
    return [sorted(s, key=lambda x: (x[0], x[2])) for s in out]


SPANS = ArrayType(StructType().add("start", "integer").add("end", "integer").add("kind", "string"))


def _scan(net, names: list[str], redact: str | None):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            texts = as_array(batch.column("text")).to_pylist()
            found = find_all(texts, net.value)
            spans = pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in f] for f in found], kind)
            cols = [batch.column(n) for n in names]
            if redact is not None:
                clean = [redacted(t, f, redact) if f else None for t, f in zip(texts, found)]
                old = batch.column("text").to_pylist()
                cols[names.index("text")] = pa.array([o if c is None else c for c, o in zip(clean, old)], batch.column("text").type)
                yield pa.RecordBatch.from_arrays(cols, names=names)
            else:
                yield pa.RecordBatch.from_arrays([*cols, spans], names=[*names, "spans"])
    return run


def redacted(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every found span, merged where they overlap, replaced by ``mark``."""
    out, at = [], 0
    reach = -1
    for s, e, _ in found:
        if s >= reach:
            out += [text[max(at, 0):s], mark]
        reach = at = max(reach, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of docs plus spans array<struct<start, end, kind>>, in code points with the end exclusive, by start and
    kind. A null or empty text has none; repeated rows are scanned each. An input column spans is replaced."""
    names = [c for c in docs.columns if c != "spans"]
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.mapInArrow(_scan(shared, names, None), StructType([docs.schema[c] for c in names]).add("spans", SPANS))


def redact(docs: DataFrame, net: Network, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced in ``text``; texts without one, null or empty, stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.mapInArrow(_scan(shared, docs.columns, mark), docs.schema)
