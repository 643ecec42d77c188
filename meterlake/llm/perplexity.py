"""Quality classifier: interpolated modified Kneser-Ney over character n-grams.

Counts of the trusted text's n-grams (one model a language) are aggregated by key; counts
of lower orders, discounts and context weights follow by joins of the count tables. An
n-gram's key is a 64-bit hash of its symbols.

Documents meet the model in one pass. The entries of highest count (:data:`HOT` at most)
are broadcast; a filter of fixed size tells which places may need another entry. Those
places are few: their distinct n-grams are joined with the count tables, shard by shard as
the exchange deals the keys, and what they add comes back to the documents by row. The
threshold is each language's own: a stated quantile (:data:`QUANTILE`) of the perplexities
of held-out trusted documents.

Characters beyond the basic plane share one symbol. Defined cases: a null or empty
text has no perplexity and is not kept; a language without trusted text has no
model, and its documents no perplexity, and they are kept; one without held-out trusted
text has no threshold, and its documents are kept; unseen contexts back off; rows are
never merged, equal rows get equal scores.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_rows, serve, small_batches, stored

ORDER = 5
PAD = 2
#: Model entries that are broadcast at most (12 bytes each).
HOT = 4_000_000
#: Entries of a run, in which they reach the driver, at most.
RUN = 1 << 16
#: Counts that are told apart when the least count of a broadcast entry is chosen.
COUNTED = 1000
#: Bits of the filter of other entries, as a power of two (16 MB).
FILTER = 27
#: Trusted ids up to which the ids go to the texts and not the texts to the ids.
FEW_IDS = 2_000_000
#: One of so many trusted documents sets the thresholds and is not trained on.
HELD_OUT = 5
#: Share of the held-out trusted documents that a threshold keeps.
QUANTILE = 0.995

GRAMS = [f"k{n}" for n in range(1, ORDER + 1)]
CONTEXTS = [f"c{n}" for n in range(2, ORDER + 1)]


def mixed(v: np.ndarray) -> np.ndarray:
    v = v * np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    return v ^ (v >> np.uint64(29))


#: Hashes of a symbol by its distance from an n-gram's end.
SYMBOLS = [mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(j << 16 | 1)) for j in range(ORDER)]


def symbols(text: str) -> np.ndarray:
    """16-bit symbols of a text after the padding."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.concatenate([np.full(ORDER, PAD, np.int64), np.minimum(code, 0xFFFF).astype(np.int64)])


def grams(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of every place of the texts the keys of the n-grams that end there (by order), those of
    their contexts (by order; that of order 1 is 0), and each text's number of places.

    The key of an n-gram without its first symbol is that of the order below at the place, and the
    key without its last symbol that of the order below at the place before."""
    flat = [symbols(t) for t in texts]
    sizes = np.array([len(t) - ORDER for t in flat], np.int64)
    x = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    width = len(x) - ORDER + 1
    if width <= 0:
        none = [np.zeros(0, np.uint64)] * ORDER
        return none, none, sizes
    at = np.arange(len(x)) - ORDER + 1
    keep = np.ones(len(x), bool)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    for k in range(ORDER):
        keep[starts + k] = False
    at = at[keep]
    keys, contexts, held = [], [np.zeros(len(at), np.uint64)], np.zeros(width, np.uint64)
    for n in range(ORDER):
        held = held + SYMBOLS[n][x[ORDER - 1 - n : len(x) - n]]
        keys.append(held[at])
        if n < ORDER - 1:
            contexts.append(held[at - 1])
    return keys, contexts, sizes


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents labelled as good and not toxic."""
    ids = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)  # at most 16 MB, counted above
    return docs.join(ids, "doc_id", "left_semi")


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``n`` (order), ``k`` (n-gram), ``ctx`` (its context), ``low`` (the n-gram below), ``c``
    (its count; that of lower orders follows from the order above)."""

    def run(langs: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("lang", "n", "k", "ctx", "low", "c")}
        for lang in dict.fromkeys(langs):
            keys, contexts, _ = grams([t or "" for t, g in zip(texts, langs) if g == lang])
            for n in range(ORDER):
                k, first, c = np.unique(keys[n], return_index=True, return_counts=True)
                low = keys[n - 1][first] if n else np.zeros(len(k), np.uint64)
                columns = {"k": k, "ctx": contexts[n][first], "low": low}
                out["lang"] += [lang] * len(k)
                out["n"] += [n + 1] * len(k)
                out["c"] += c.tolist()
                for name, x in columns.items():
                    out[name] += x.view(np.int64).tolist()
        return out

    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    schema = "lang string, n int, k bigint, ctx bigint, low bigint, c bigint"
    same = [F.min(c).alias(c) for c in ("ctx", "low")]  # both follow from the n-gram
    return map_rows(rows, ["lang", "text"], run, schema, 1 << 20).groupBy("lang", "n", "k").agg(*same, F.sum("c").alias("c"))


def discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of one order's counts: each n-gram's discounted share of its context, and each context's weight for the lower order."""
    seen = [F.sum((F.col("c") == i).cast("bigint")).alias(f"n{i}") for i in range(1, 5)]
    of_counts = counts.groupBy("lang").agg(*seen)
    n = [F.greatest(F.col(f"n{i}"), F.lit(1)).cast("double") for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    cut = of_counts.select("lang", *(F.greatest(F.lit(0.0), F.least(F.lit(float(i)), i - (i + 1) * y * n[i] / n[i - 1])).alias(f"d{i}") for i in (1, 2, 3)))
    taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = counts.join(F.broadcast(cut), "lang").select("lang", "k", "ctx", "low", "c", taken.alias("d"))  # a row a language
    lost = rows.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("lost"))
    weights = stored(lost.select("lang", "ctx", "total", (F.col("lost") / F.col("total")).alias("w")), "weights")  # the model would derive all orders' at once
    shares = rows.join(weights, ["lang", "ctx"]).select("lang", "k", "low", "c", ((F.col("c") - F.col("d")) / F.col("total")).alias("share"), "w")
    return shares, weights


def fit(trusted: DataFrame) -> DataFrame:
    """The model: ``lang``, ``kind`` (order of an n-gram, or 10 + order of a context), ``k``, ``v``, ``c`` (its count).

    ``v`` is an n-gram's interpolated probability or a context's weight."""
    found = stored(gram_counts(trusted), "grams")
    of = lambda n: found.filter(F.col("n") == n)
    counts = {ORDER: of(ORDER).select("lang", "k", "ctx", "low", "c")}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
        before = counts[n + 1].groupBy("lang", F.col("low").alias("k")).agg(F.count("*").alias("c"))
        counts[n] = stored(of(n).select("lang", "k", "ctx", "low").join(before, ["lang", "k"]), "counts")
    size = counts[1].groupBy("lang").agg((F.count("*") + 1).alias("size"))
    parts, below = [], None
    for n in range(1, ORDER + 1):
        shares, weights = discounted(counts[n])
        if n == 1:
            p = shares.join(F.broadcast(size), "lang").select("lang", "k", (F.col("share") + F.col("w") / F.col("size")).alias("v"), "c")
            unseen = weights.join(F.broadcast(size), "lang").select("lang", F.lit(10).alias("kind"), F.lit(0).cast("bigint").alias("k"), (F.col("w") / F.col("size")).alias("v"), F.col("total").alias("c"))
            parts.append(unseen)
        else:
            lower = below.select("lang", F.col("k").alias("low"), F.col("v").alias("p"))
            p = shares.join(lower, ["lang", "low"]).select("lang", "k", (F.col("share") + F.col("w") * F.col("p")).alias("v"), "c")
            parts.append(weights.select("lang", F.lit(10 + n).alias("kind"), F.col("ctx").alias("k"), F.col("w").alias("v"), F.col("total").alias("c")))
        below = stored(p, "order")
        parts.append(below.select("lang", F.lit(n).alias("kind"), "k", "v", "c"))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    return stored(model, "model")


def least_hot(model: DataFrame, hot: int) -> int:
    """The least count of a broadcast entry, so that there are ``hot`` of them at most."""
    by = model.groupBy(F.least("c", F.lit(COUNTED)).alias("c")).agg(F.count("*").alias("n")).collect()  # a row a count
    held = 0
    for c, n in sorted(by, reverse=True):
        if held + n > hot:
            return c + 1 if c < COUNTED else (1 << 62)
        held += n
    return 0


def place_of(key: Column | str) -> Column:
    return F.shiftrightunsigned(key, 64 - FILTER)


def filter_words(keys: DataFrame) -> np.ndarray | None:
    """A bit for each ``k``, from its upper bits: 2**FILTER bits at most reach the driver; None for no keys."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(k, {64 - FILTER}) & 63 as int))")
    bits = keys.select(F.shiftright(place_of("k"), 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    if not bits.num_rows:
        return None
    words = np.zeros(1 << (FILTER - 6), np.uint64)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return words


def maybe(words: np.ndarray | None, key: np.ndarray) -> np.ndarray:
    """Whether keys may be among the filter's."""
    if words is None:
        return np.zeros(len(key), bool)
    spot = key >> np.uint64(64 - FILTER)
    return words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1) != 0


def runs(entries: DataFrame) -> DataFrame:
    """Of ``lang``, ``kind``, ``k``, ``v`` the keys and logarithms of a language's and a kind's entries in
    runs: 12 bytes an entry, where rows with their language take several times that in the driver."""

    def packed(rows: pa.Table) -> Iterator[tuple]:
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        kind, key, value = (rows.column(c).to_numpy() for c in ("kind", "k", "v"))
        group = lang.indices.to_numpy().astype(np.int64) << 8 | kind
        order = np.argsort(group, kind="stable")
        found, first = np.unique(group[order], return_index=True)
        for g, own in zip(found.tolist(), np.split(order, first[1:])):
            yield lang.dictionary[g >> 8].as_py(), g & 255, key[own].tobytes(), np.log(value[own]).astype(np.float32).tobytes()

    columns = ["lang", "kind", "keys", "logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve(__name__)
        held: list[pa.RecordBatch] = []
        for batch in (b for bs in (batches, [None]) for b in bs):
            if batch is not None and sum(b.num_rows for b in held) + batch.num_rows <= RUN:
                held.append(batch)
                continue
            if held:
                for row in packed(pa.Table.from_batches(held)):
                    yield pa.RecordBatch.from_pydict({c: [x] for c, x in zip(columns, row)}, schema=arrow)
            held = [batch]

    small_batches(entries.sparkSession)
    arrow = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("keys", pa.binary()), ("logs", pa.binary())])
    return entries.select("lang", "kind", "k", "v").mapInArrow(run, "lang string, kind int, keys binary, logs binary")


class Hot:
    """The broadcast entries, by language and kind, as sorted keys and logarithms, and the filter of the others."""

    def __init__(self, rows: pa.Table, words: np.ndarray | None) -> None:
        self.words = words
        self.tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        parts: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for batch in rows.to_batches():
            for lang, kind, keys, logs in zip(*batch.columns):
                parts[lang.as_py(), kind.as_py()].append((np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(logs.as_buffer(), np.float32)))
        for group, own in parts.items():
            k = np.concatenate([x for x, _ in own])
            order = np.argsort(k)
            self.tables[group] = (k[order], np.concatenate([x for _, x in own])[order])

    def find(self, lang: str, kind: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables.get((lang, kind), (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.float32)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        return hit, np.where(hit, values[at], 0)

    def score(self, lang: str, keys: list[np.ndarray], contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of places, and the places that may need an entry that is not here."""
        out = np.zeros(len(keys[0]))
        unsure = np.zeros(len(out), bool)
        left = np.arange(len(out))
        for n in range(ORDER, 0, -1):
            k = keys[n - 1][left]
            hit, value = self.find(lang, n, k)
            out[left[hit]] += value[hit]
            left, k = left[~hit], k[~hit]
            if not len(left):
                break
            unsure[left] |= maybe(self.words, k)
            c = contexts[n - 1][left]
            known, weight = self.find(lang, 10 + n if n > 1 else 10, c)
            out[left] += weight
            unsure[left[~known]] |= maybe(self.words, c[~known])
        return np.where(unsure, 0, out), np.flatnonzero(unsure)


def joined_scores(chains: DataFrame, model: DataFrame) -> DataFrame:
    """``lang``, ``k5`` and ``logp`` of distinct n-grams with their chain of lower ones, by joins with the model."""
    entry = lambda kind, name, key: model.filter(F.col("kind") == kind).select("lang", F.col("k").alias(key), F.col("v").alias(name))
    rows, found, added = chains, None, F.lit(0.0)
    for n in range(ORDER, 0, -1):
        rows = rows.join(entry(n, f"p{n}", f"k{n}"), ["lang", f"k{n}"], "left")
        if n > 1:
            rows = rows.join(entry(10 + n, f"w{n}", f"c{n}"), ["lang", f"c{n}"], "left")
        hit, value = F.col(f"p{n}").isNotNull(), added + F.log(f"p{n}")
        found = F.when(hit, value) if found is None else found.when(hit, value)
        if n > 1:
            added = added + F.coalesce(F.log(f"w{n}"), F.lit(0.0))
    rows = rows.join(F.broadcast(entry(10, "w1", "zero").drop("zero")), "lang", "left")  # a row a language
    return rows.select("lang", GRAMS[-1], found.otherwise(added + F.coalesce(F.log("w1"), F.lit(0.0))).alias("logp"))


def log_perplexities(docs: DataFrame, model: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``lang``, ``n_chars`` and ``total`` (log-probability) of every row."""
    spark = docs.sparkSession
    least = least_hot(model, hot)
    near, far = model.filter(F.col("c") >= least), model.filter(F.col("c") < least)
    words = filter_words(far)
    held = spark.sparkContext.broadcast(Hot(runs(near).toArrow(), words))  # of at most `hot` entries
    exact = words is None
    del words
    give_back()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    columns = ["row", "doc_id", "lang", "n_chars", "total", "n", *GRAMS, *CONTEXTS]

    def run(row: list, ids: list, langs: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in columns}
        total, count = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        extra: list[tuple] = []
        for lang in dict.fromkeys(langs):
            at = [j for j, g in enumerate(langs) if g == lang]
            keys, contexts, sizes = grams([texts[j] or "" for j in at])
            if (lang, 10) in held.value.tables or held.value.words is not None:
                score, unsure = held.value.score(lang, keys, contexts)
            else:
                score, unsure = np.zeros(len(keys[0])), np.zeros(0, np.int64)
            run_sum = np.concatenate([[0.0], np.cumsum(score)])
            ends = np.cumsum(sizes)
            total[at], count[at] = run_sum[ends] - run_sum[ends - sizes], sizes
            if len(unsure):  # a row a document and distinct n-gram
                owner = np.searchsorted(ends, unsure, "right")
                pair = np.stack([owner.astype(np.uint64), keys[-1][unsure]], 1)
                _, first, times = np.unique(pair, axis=0, return_index=True, return_counts=True)
                spots = unsure[first]
                values = [x[spots].view(np.int64).tolist() for x in (*keys, *contexts[1:])]
                extra += list(zip([row[at[j]] for j in owner[first].tolist()], [lang] * len(spots), times.tolist(), *values))
        for c, x in (("row", row), ("doc_id", ids), ("lang", langs), ("n_chars", count.tolist()), ("total", total.tolist())):
            out[c] += x
        for c in columns[5:]:
            out[c] += [None] * len(ids)
        for x in extra:
            for c, v in zip(("row", "lang", "n", *GRAMS, *CONTEXTS), x):
                out[c].append(v)
        for c in ("doc_id", "n_chars", "total"):
            out[c] += [None] * len(extra)
        return out

    kinds = {"lang": "string", "total": "double"}
    schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in columns)
    found = stored(map_rows(rows, ["row", "doc_id", "lang", "text"], run, schema, 1 << 20), "scores")
    held.destroy()  # the scores are written
    whole = found.filter("n is null").select("row", "doc_id", "lang", "n_chars", "total")
    if exact:
        return whole.drop("row")
    open_ = found.filter("n is not null")
    same = [F.min(c).alias(c) for c in (*GRAMS[:-1], *CONTEXTS)]  # all follow from the n-gram
    scores = joined_scores(open_.groupBy("lang", GRAMS[-1]).agg(*same), model)
    added = open_.select("row", "lang", "n", GRAMS[-1]).join(scores, ["lang", GRAMS[-1]]).groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("more"))
    rest = whole.join(added, "row", "left")
    return rest.select("doc_id", "lang", "n_chars", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"))


def quality_classifier(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id``, ``lang``, ``n_chars``, ``perplexity``, ``threshold``, ``kept``."""
    docs = docs.select("doc_id", "lang", "text")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    model = fit(trusted_documents(docs, labels).filter(~held_out))
    scored = stored(log_perplexities(docs, model), "totals")
    known = model.select("lang").distinct().withColumn("modelled", F.lit(True))
    score = F.when((F.col("n_chars") > 0) & F.col("modelled"), -F.col("total") / F.col("n_chars"))
    scored = scored.join(F.broadcast(known), "lang", "left").withColumn("score", score)  # a row a language
    limit = trusted_documents(scored, labels).filter(held_out).groupBy("lang").agg(F.percentile_approx("score", quantile, 10000).alias("limit"))
    kept = F.when(F.col("n_chars") == 0, False).when(F.col("limit").isNull(), True).otherwise(F.col("score") <= F.col("limit"))
    found = scored.join(F.broadcast(limit), "lang", "left")
    return found.select("doc_id", "lang", "n_chars", F.exp("score").alias("perplexity"), F.exp("limit").alias("threshold"), kept.alias("kept"))
