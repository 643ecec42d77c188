"""Mixing to target weights by soft membership.

A naive Bayes classifier, fitted on labelled documents over hashed words, gives each
document a posterior over domains. Projected gradient steps (accelerated) then fit
nonnegative document rates, least squares from 1, whose expected domain token totals
match the targets. Residuals count in units of each domain's own tokens, so that rare
domains are met as soon and as well as common ones. A step sends two vectors of domain
totals to the driver. A document's rate follows from its posterior and the steps so far; the
numbers that the steps work on are written to the shared folder now and then, so that the
work grows with the steps and a lost executor costs nothing but its tasks.

Defined cases: a null or empty text has no tokens, takes the prior as posterior and
weighs nothing; documents without a label are only scored; of clashing labels of one
document the worst counts (toxic, low, clean); with no labelled document at all every
domain is equally likely; no tokens leave every rate at 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, quoted, remembers, serve, small_batches, stored

#: Domains by label: toxic, else low quality, else clean.
DOMAINS = ("clean", "low", "toxic")
#: Hashed word features.
BUCKETS = 1 << 16
#: Labelled documents that the classifier is fitted on, those of least hashed id.
SAMPLE = 20_000
#: Word types that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 200_000, 64
#: Steps after which the numbers that the steps work on are written down.
REPLAYED = 32
#: A feature counts as evidence if it stands in so many sampled documents at least, and
#: in so many standard errors more of some domain's than chance would have it.
LEAST_DOCUMENTS, LEAST_SURPLUS = 5, 6.0


@dataclass(frozen=True)
class Targets:
    """Shares of the expected tokens; weight of staying near rate 1; steps at most; and the
    share of its target by which a domain's total may miss it when the steps end."""

    shares: tuple[float, ...] = (0.90, 0.08, 0.02)
    near_one: float = 1e-7
    steps: int = 500
    within: float = 1e-3


CAPITALS = bytes(range(65, 91))
MARKS = b"#*$%&!"


def shape(raw: bytes, words: list[bytes]) -> list[bytes]:
    """Words that stand for a text's make-up: full of marks, capitals, bars, or repeats."""
    n = len(words)
    if not n:
        return []
    marks, capitals = (len(raw) - len(raw.translate(None, drop)) for drop in (MARKS, CAPITALS))
    found = {
        b"\0marks": 5 * marks > n,
        b"\0capitals": 2 * capitals > len(raw) // 2,
        b"\0bars": 20 * words.count(b"|") > n,
        b"\0repeats": n >= 20 and 2 * len(set(words)) < n,
    }
    return [w for w, holds in found.items() if holds]


class Buckets(dict):
    """Feature of a word, without closing marks; remembered by a worker."""

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word.strip(b".,;:\"'()")) % BUCKETS
        if len(word) <= LONGEST:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = found
        return found


_buckets = Buckets()


def buckets(text: str | None) -> np.ndarray:
    """Features of a text: of each distinct word, lower-cased (A-Z), and of its make-up."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    remembers(__name__, _buckets.clear)
    found = {*words, *shape(raw, words)}
    return np.unique(np.fromiter(map(_buckets.__getitem__, found), np.int64, len(found)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Log-odds of a feature's presence, a row a domain; in the last column the domain's
    log-prior and the log-probability that all features are absent."""
    label = labels.filter("doc_id is not null").select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("domain"))
    some = label.groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers
    taught = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("domain", "text")

    def run(domains: list, texts: list) -> dict[str, list]:
        held = np.zeros((len(DOMAINS), BUCKETS + 1), np.int64)
        for d, t in zip(domains, texts):
            held[d, buckets(t)] += 1
            held[d, BUCKETS] += 1
        at = np.nonzero(held)
        return {"domain": at[0], "bucket": at[1], "n": held[at]}

    counts = map_rows(taught, ["domain", "text"], run, "domain int, bucket int, n bigint").groupBy("domain", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # at most domains x features
    held = np.zeros((len(DOMAINS), BUCKETS + 1))
    held[got["domain"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    documents, in_all = held[:, BUCKETS:], held[:, :BUCKETS].sum(0)
    if not documents.sum():
        return np.zeros((len(DOMAINS), BUCKETS + 1))
    share = documents / documents.sum()
    expected = share * in_all
    surplus = (held[:, :BUCKETS] - expected) / np.sqrt(expected + 0.5)
    telling = (in_all >= LEAST_DOCUMENTS) & (surplus.max(0) >= LEAST_SURPLUS)
    p = (held[:, :BUCKETS] + 0.5) / (documents + 1)
    odds = np.where(telling, np.log(p) - np.log1p(-np.minimum(p, 0.999)), 0)
    absent = np.where(telling, np.log1p(-np.minimum(p, 0.999)), 0).sum(1, keepdims=True)
    return np.hstack([odds, absent + np.log((documents + 0.5) / (documents + 0.5).sum())])


def posterior(text: str | None, model: np.ndarray) -> tuple[int, np.ndarray]:
    """Words of a text, and its domains' probabilities."""
    found = buckets(text)
    score = model[:, BUCKETS] + model[:, found].sum(1)
    e = np.exp(score - score.max())
    return len((text or "").split()), e / e.sum()


def scored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``row`` (the document whole) and ``m``: its ``n_tokens`` and a probability a domain (``p_clean``, ...).

    A struct holds the document's own columns, so that their names cannot clash."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # of fixed size

    def judge(texts):
        import pandas as pd

        serve(__name__)
        found = [posterior(t, shared.value) for t in texts]
        return pd.DataFrame({"n_tokens": [n for n, _ in found]} | {c: [float(p[k]) for _, p in found] for k, c in enumerate(SHARES)})

    schema = ", ".join(["n_tokens bigint", *(f"{c} double" for c in SHARES)])
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.pandas_udf(judge, schema)(quoted("text")).alias("m"))


SHARES = tuple(f"p_{d}" for d in DOMAINS)


def rates_of(p: np.ndarray, state: tuple[np.ndarray, np.ndarray, float], history: list[np.ndarray], near_one: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Rates of documents (rows of posteriors), the point of the next step and its momentum, after ``history``.

    ``state``: the same before the history; ``history``: the residual vectors at the points of the
    steps. One step divides by 1 + near_one, a bound of the curvature, as a document's posterior
    adds up to 1 and a residual is in units of its domain's mass."""
    rate, point, t = state
    for e in history:
        new = np.maximum(0.0, point - (p @ e + near_one * (point - 1)) / (1 + near_one))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        rate, point, t = new, new + (t - 1) / after * (new - rate), after
    return rate, point, t


def with_state(members: DataFrame, history: list[np.ndarray], momentum: float, near_one: float) -> DataFrame:
    """``members`` with ``state`` (``rate``, ``point``) moved on by ``history``."""

    def moved(*columns):
        import pandas as pd

        p, rate, point = np.stack([np.asarray(x, float) for x in columns[:-2]], 1), *(np.asarray(x, float) for x in columns[-2:])
        rate, point, _ = rates_of(p, (rate, point, momentum), history, near_one)
        return pd.DataFrame({"rate": rate, "point": point})

    return members.withColumn("state", F.pandas_udf(moved, "rate double, point double")(*(f"m.{c}" for c in SHARES), "state.rate", "state.point"))


def fitted(documents: DataFrame, targets: Targets, scale: float = 1.0) -> DataFrame:
    """``documents`` (of :func:`scored`, stored) with ``state.rate``; ``scale`` times the shares are
    the targets in units of all tokens.

    The steps end when every domain's total is ``within`` its target, or no longer changes
    (targets that the posteriors cannot meet, as of a domain without documents). Steps read
    the numbers alone, not the documents."""
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("point")).alias("state")
    whole, members, momentum = documents.select("row", "m", start), documents.select("m", start), 1.0
    masses = documents.agg(F.sum("m.n_tokens"), *(F.sum(F.col("m.n_tokens") * F.col(f"m.{c}")) for c in SHARES)).first()
    if not masses[0]:
        return whole
    total, mass = masses[0], np.array(masses[1:], float) / masses[0]
    goal = scale * np.array(targets.shares)
    width = 2 * len(DOMAINS)
    names = [f"s{k}" for k in range(width)]
    history: list[np.ndarray] = []  # since the numbers were written
    every: list[np.ndarray] = []
    before = None
    for _ in range(targets.steps + 1):

        def run(batches: Iterator[pa.RecordBatch], done=tuple(history), momentum=momentum) -> Iterator[pa.RecordBatch]:
            held = np.zeros(width)
            for b in batches:
                n, rate, point, *p = (np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns)
                p = np.stack(p, 1)
                rate, point, _ = rates_of(p, (rate, point, momentum), done, targets.near_one)
                held += np.concatenate([(n * r) @ p for r in (rate, point)])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], names=names)

        numbers = members.select("m.n_tokens", "state.rate", "state.point", *(f"m.{c}" for c in SHARES))
        got = numbers.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*map(F.sum, names)).first()
        at_rate, at_point = np.array(got, float).reshape(2, -1) / total
        met = (np.abs(at_rate - goal) <= targets.within * goal).all()
        still = before is not None and np.abs(at_rate - before).max() < 1e-9
        if met or still:
            break
        before = at_rate
        history.append(np.where(mass > 0, (at_point - goal) / np.where(mass > 0, mass, 1), 0.0))
        every.append(history[-1])
        if len(history) == REPLAYED:
            members = stored(with_state(members, history, momentum, targets.near_one), "rates")
            none = np.zeros((0, len(DOMAINS)))
            momentum, history = rates_of(none, (np.zeros(0), np.zeros(0), momentum), history, targets.near_one)[2], []
    return with_state(whole, every, 1.0, targets.near_one)


def mix(docs: DataFrame, labels: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """``doc_id``, ``n_tokens``, the posterior, and ``rate``: how often the document is to be drawn."""
    texts = docs.select("doc_id", "text")
    documents = scored(texts, train(texts, labels)).select(F.struct("row.doc_id").alias("row"), "m")
    return fitted(stored(documents, "members"), targets).select("row.doc_id", "m.*", "state.rate")


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: Targets = Targets(shares=(0.97, 0.02, 0.01))) -> DataFrame:
    """The documents, each as often as its rate says; the fraction is drawn by a hash of its id.

    The total is as large as the clean documents need to stay at a rate of 1 or more."""
    documents = stored(scored(docs, train(docs.select("doc_id", "text"), labels)), "members")
    n, clean = documents.agg(F.sum("m.n_tokens"), F.sum(F.col("m.n_tokens") * F.col("m.p_clean"))).first()
    scale = max(1.0, (clean or 0) / (n or 1) / targets.shares[0])
    draw = F.shiftrightunsigned(F.xxhash64(F.col("row.doc_id"), F.lit("draw")), 11) / float(1 << 53)
    whole = F.floor(F.col("state.rate") + 1e-3)
    copies = (whole + (draw < F.col("state.rate") - whole).cast("bigint")).alias("copies")
    drawn = fitted(documents, targets, scale).select("row", copies).filter("copies > 0")
    return drawn.select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")
