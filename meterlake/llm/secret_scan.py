"""Secret scan: fixed patterns, plus strings that a character Markov model of
random strings explains better than one of ordinary identifiers, words and numbers.

The log-likelihood ratio alone decides on every run of :data:`MIN_CANDIDATE` characters
or more, letters only and digits only among them, and on what is left of a run beside a
pattern's span. Its threshold is one a length class, where at most one ordinary held-out
sample in a thousand passes. Shorter runs hold too little evidence: they are found by
the patterns or not at all.

Defined cases: a null text counts as empty and has no spans; offsets are code
points with an exclusive end; added spans never overlap a pattern's span; equal
texts give equal rows; other columns of the input are passed over.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, rewrite_texts

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

#: Candidates of the Markov models: runs of so many characters at least.
MIN_CANDIDATE = 16
#: Least lengths of the classes that have a threshold each.
CLASSES = (16, 20, 24, 32, 48)
#: Share of the ordinary held-out samples that may pass a threshold.
FALSE_POSITIVES = 0.001
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

# The stems of ordinary identifiers, from which negative samples are made.
STEMS = (
    "get set user name value index count total max min list item file path data node tree table column row key map "
    "string number config option default parse format render request response handler service client server session "
    "cache buffer stream reader writer event listener message queue worker thread process task job state status error "
    "result query filter sort group order page view model controller component module package version release build "
    "test check verify update delete insert create remove find search match replace split join merge copy move open "
    "close start stop begin end first last next previous current new old left right top bottom width height size "
    "length offset limit time date year month day hour minute second zone local remote public private static final "
    "and the with from that this have will your about which their would there these other between international "
    "information development government management environment organization understanding responsibility"
).split()


# Syllables of English, German, French and Spanish, from which long words are made.
SYLLABLES = (
    "the and ing her hat his tha ere for ent ion ter was you ith ver all wit thi tio er re on an en at es ed st ou ly ness ment able "
    "der die und ein sch ich ung heit keit lich ver ber ge be auf zu tz pf ach ck isch schaft "
    "le la que les des est ent eau eux oi ai ou elle aux ment tion eur our ieu ique "
    "el los las del por con una ar or ado cion que ez oso idad rr ll mente ando ista"
).split()


def ordinary(rng: random.Random, kind: int) -> str:
    """One ordinary run: an identifier in some style, a long word, or a number."""
    words = [rng.choice(STEMS) for _ in range(rng.randint(3, 9))]
    if kind < 6:
        joined = {0: "_", 1: "-", 2: "", 3: "", 4: "_", 5: "/"}[kind].join(words)
        text = words[0] + "".join(w.capitalize() for w in words[1:]) if kind == 2 else joined.upper() if kind == 4 else joined
        return text + (str(rng.randint(0, 2030)) if rng.random() < 0.2 else "")
    if kind < 9:
        text = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(5, 14)))
        return text.capitalize() if kind == 7 else text.upper() if kind == 8 and rng.random() < 0.3 else text
    if kind == 9:
        return "".join(rng.choice("0123456789") for _ in range(rng.randint(MIN_CANDIDATE, 32)))
    if kind == 10:
        return "-".join(str(rng.randint(0, 10 ** rng.randint(2, 4))) for _ in range(rng.randint(5, 8)))
    return rng.choice(ALPHABET[:26] + ALPHABET[52:] + "-_=+/" * 5) * rng.randint(MIN_CANDIDATE, 80)


def labelled_samples(n: int = 12_000, seed: int = 7) -> list[tuple[str, int]]:
    """``(text, 1 for random or 0 for ordinary)``, made by a rule from a seed."""
    rng = random.Random(seed)
    hexa, lower = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"
    letters = ALPHABET[:52]
    alphabets = [hexa, hexa.upper(), lower, lower.upper(), ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", letters, letters[:26], letters[26:]]
    out: list[tuple[str, int]] = []
    for i in range(n):
        size = rng.randint(MIN_CANDIDATE, 40) if i % 3 else rng.randint(40, 80)
        out.append(("".join(rng.choices(alphabets[i % len(alphabets)], k=size)), 1))
        text = ordinary(rng, i % 12)
        if len(text) >= MIN_CANDIDATE:
            out.append((text, 0))
    return out


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratios of each character after another, and the decision's threshold
    per character, one a length class."""

    first: np.ndarray
    steps: np.ndarray
    thresholds: tuple[float, ...]

    def score(self, text: str) -> float:
        """Log-likelihood ratio per character; above 0 the random model explains more."""
        code = CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
        return float(self.first[code[0]] + self.steps[code[:-1], code[1:]].sum()) / len(text)

    def is_random(self, text: str) -> bool:
        return self.score(text) > self.thresholds[length_class(len(text))]


CODE = np.zeros(128, np.int64)
CODE[list(ALPHABET.encode())] = range(len(ALPHABET))


def length_class(size: int) -> int:
    return max(bisect_right(CLASSES, size) - 1, 0)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    k = len(ALPHABET)
    first, steps = np.full(k, 0.5), np.full((k, k), 0.1)
    for t in texts:
        code = CODE[np.frombuffer(t.encode("ascii"), np.uint8)]
        first[code[0]] += 1
        np.add.at(steps, (code[:-1], code[1:]), 1)
    return np.log(first / first.sum()), np.log(steps / steps.sum(1, keepdims=True))


def train(samples: list[tuple[str, int]]) -> MarkovPair:
    """Fit both models on half of the samples and set the thresholds on the other half: in each
    length class where the share :data:`FALSE_POSITIVES` of the ordinary ones passes, or halfway
    from there to the random samples' 1 % quantile if that is higher."""
    fit, held = samples[::2] + samples[1::4], samples[3::4]
    (f1, s1), (f0, s0) = (counts([t for t, y in fit if y == label]) for label in (1, 0))
    pair = MarkovPair(f1 - f0, s1 - s0, (0.0,) * len(CLASSES))
    score: dict[tuple[int, int], list[float]] = {}
    for t, y in held:
        score.setdefault((y, length_class(len(t))), []).append(pair.score(t))
    every = [x for (y, _), xs in score.items() if not y for x in xs]
    thresholds = []
    for k in range(len(CLASSES)):
        low = float(np.quantile(score.get((0, k)) or every or [0.0], 1 - FALSE_POSITIVES))
        high = float(np.quantile(score.get((1, k)) or [low], 0.01))
        thresholds.append(max(low, (low + high) / 2))
    return MarkovPair(pair.first, pair.steps, tuple(thresholds))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' matches, leftmost and non-overlapping per kind, without those that fail."""
    out: list[tuple[str, int, int]] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if len(text) >= MIN_HEX and max(map(len, text.split()), default=0) >= MIN_HEX:
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def added_spans(text: str, base: list[tuple[str, int, int]], model: MarkovPair) -> list[tuple[str, int, int]]:
    """Random-looking runs outside the base spans (sorted by start)."""
    if max(map(len, text.split()), default=0) < MIN_CANDIDATE:
        return []
    out, i = [], 0
    for m in CANDIDATE.finditer(text):
        at, stop = m.span()
        while i < len(base) and base[i][1] < stop:
            _, a, b = base[i]
            if a - at >= MIN_CANDIDATE and model.is_random(text[at:a]):
                out.append(("random", at, a))
            at, i = max(at, b), i + 1
        if stop - at >= MIN_CANDIDATE and model.is_random(text[at:stop]):
            out.append(("random", at, stop))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def secret_scan(docs: DataFrame, model: MarkovPair | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans."""
    model = model or train(labelled_samples())

    def run(ids: list, texts: list) -> dict[str, list]:
        base = [base_spans(t or "") for t in texts]
        more = [added_spans(t or "", b, model) for t, b in zip(texts, base)]
        count = {k: [sum(s[0] == k for s in x + y) for x, y in zip(base, more)] for k in KINDS}
        return {
            "doc_id": ids,
            "n_assign": count["assign"],
            "n_access": count["access"],
            "n_hex": count["hex"],
            "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
            "spans": [joined(b + m) for b, m in zip(base, more)],
            "n_random": count["random"],
        }

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"
    return map_rows(docs, [id_col, text_col], run, schema)


def redact(text: str | None, model: MarkovPair, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping spans share one mark."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for _, a, b in sorted(base + added_spans(text, base, model), key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact_secrets(docs: DataFrame, model: MarkovPair | None = None) -> DataFrame:
    """The same rows and columns, secrets replaced by a mark."""
    model = model or train(labelled_samples())
    return rewrite_texts(docs, lambda text: redact(text, model))
