"""Removal of repeated byte strings by external suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a
smaller document, or earlier in the same one). Strings are sampled by minimizers: each
window of that length names its least hashed 48-byte piece, so that equal windows name
equal pieces. A run of windows with one piece is a stretch; a stretch whose piece names
no other and stands in it only once holds no repeat and needs no sorting.

The others are dealt by piece. Of equal stretches all but the least are repeats whole;
equal ones of a batch are told before the exchange, so that a hot stretch is one row a
batch in it. What may still repeat another is the least of each of a piece's distinct
stretches: these are fetched, joined into one text for each task, and :mod:`induced`
sorts its suffixes with their common prefixes; windows with a common prefix of the full
length form a class, and the class's least place stays.

A piece of very many distinct stretches (those at the edges of a passage that stands in
a large share of the documents) would make one task sort them all: its stretches are dealt
window by window instead, by a 128-bit hash of the window's bytes, and of equal windows
all but the least are repeats.

Filters of fixed size (a bit for each repeated piece's hash, for each stretch to be
fetched, and for each crowded piece) keep the rest out of the exchanges; their false hits
only cost time.

Defined cases: a null or empty text has no bytes; texts shorter than the length stay
whole; rows with equal ids and equal texts count as one document, those with equal
ids and different texts as two in an unspecified but fixed order; rows without an id
come last; repeated rows are all returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER, filter_words, holds, map_rows, slices, stored
from .induced import suffix_order

LENGTH = 100
PIECE = 48
#: Bytes of stretches that one suffix sort takes at once, at a piece's end.
TEXT = 1 << 22
#: Distinct stretches of a piece beyond which it is dealt by windows.
CROWDED = 2048
#: The place of rows without an id.
LAST = (1 << 63) - 1


def words_from(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    words = np.empty(len(data), np.uint64)
    for k in range(8):
        part = words[k::8]
        part[:] = np.frombuffer(padded, "<u8", len(part), k)
    return words


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the PIECE bytes from each place on: of 16 by two of 8, of 32 by two of 16, then of 32 and 16."""
    h = words_from(data)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    by_16 = h[:-8] * np.uint64(0xBF58476D1CE4E5B9)
    by_16 += h[8:]
    h = by_16[:-32] * np.uint64(0x94D049BB133111EB)
    h += by_16[16:-16]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h += by_16[32:]
    h = h[: len(data) - PIECE + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h


def spread(least: np.ndarray) -> np.ndarray:
    """One to one: least hashes are small numbers, which would share a filter's first few bits."""
    key = least * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(29))


def windows_least(h: np.ndarray, span: int) -> np.ndarray:
    """The least of ``span`` neighbours from each place on: of 2**k by doubling, then of two such."""
    least, reach = h, 1
    while 2 * reach <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    n = len(h) - span + 1
    return np.minimum(least[:n], least[span - reach : span - reach + n])


def stretches(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of a batch of texts: each stretch's text, piece hash, first window, number of windows,
    and whether its piece stands in it more than once (then it may repeat itself).

    A stretch is a run of windows of one text with the same least hash."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    span, n = length - PIECE + 1, len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    h = piece_hashes(data)
    best = windows_least(h, span)
    # a window may not leave its text
    ends = np.cumsum(sizes)
    inside = np.ones(n + 1, bool)
    inside[np.clip(ends[:, None] - np.arange(1, length), 0, n)] = False
    inside = inside[:n]
    begins, goes_on = inside.copy(), best[1:] == best[:-1]
    goes_on &= inside[1:]
    goes_on &= inside[:-1]
    begins[1:] &= ~goes_on
    first = np.flatnonzero(begins)
    last = inside.copy()
    last[:-1] &= ~goes_on
    stops = np.flatnonzero(last)
    least = best[first]
    # a piece stands twice if it does in the first window, or comes in anew at the end of a later one
    anew = np.cumsum(h[span - 1 :] == best, dtype=np.int32)
    multi = anew[stops] > anew[first]
    half = (h >> np.uint64(32)).astype(np.uint32)  # equal halves of different pieces only cost time
    every, mine = np.lib.stride_tricks.sliding_window_view(half, span), (least >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(first), 2048):
        cut = slice(a, a + 2048)
        multi[cut] |= np.count_nonzero(every[first[cut]] == mine[cut, None], axis=1) > 1
    text = np.searchsorted(ends, first, "right")
    return text, spread(least), first - (ends - sizes)[text], stops - first + 1, multi


def raw_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def parts_of(texts: list[str | None], most: int = 1 << 17) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, some 128 kB at a time (a part's arrays, 1 MB each, stay in a core's cache), with the place of the first."""
    raw = [raw_of(t) for t in texts]
    for a, b in slices([len(r) for r in raw], most):
        yield a, raw[a:b]


def order_key(i: int | None) -> int:
    return LAST if i is None else i


#: Ranges of hashes, as a power of two, by which the pieces are counted.
RANGES = 10


def repeated_pieces(docs: DataFrame) -> np.ndarray:
    """The filter (as :func:`common.filter_words`) of pieces that name two stretches or stand twice in one.

    A batch sends its sorted hashes in packed runs, one a range; a task counts a range at a time."""
    edges = np.arange(1, 1 << RANGES, dtype=np.uint64) << np.uint64(64 - RANGES)

    def run(ids: list, texts: list) -> dict[str, list]:
        found = [np.zeros(0, np.uint64)]
        for _, part in parts_of(texts):
            _, key, _, _, multi = stretches(part)
            found += [key, key[multi]]  # a piece twice in its stretch counts as two
        keys = np.sort(np.concatenate(found))
        keys = keys[np.append(np.ones(min(2, len(keys)), bool), keys[2:] != keys[:-2])]  # two tell enough
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        some = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return {"range": [i for i, _, _ in some], "keys": [keys[a:b].tobytes() for _, a, b in some]}

    size = 1 << (FILTER - 6 - RANGES)
    arrow = pa.schema([("range", pa.int32()), ("words", pa.binary())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def words() -> pa.RecordBatch:
            keys = np.sort(np.frombuffer(b"".join(held), np.uint64))
            spot = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(64 - FILTER)
            out = np.zeros(size, np.uint64)
            np.bitwise_or.at(out, (spot >> np.uint64(6)).astype(np.int64) - at * size, np.uint64(1) << (spot & np.uint64(63)))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([out.tobytes()], pa.binary())], schema=arrow)

        for batch in batches:
            for i, keys in zip(*(c.to_pylist() for c in batch.columns)):
                if i != at:
                    if held:
                        yield words()
                    at, held = i, []
                held.append(keys)
        if held:
            yield words()

    runs = map_rows(docs, ["doc_id", "text"], run, "range int, keys binary")
    found = runs.repartition("range").sortWithinPartitions("range").mapInArrow(counted, "range int, words binary").toArrow()
    out = np.zeros(size << RANGES, np.uint64)
    for i, words in zip(found["range"].to_pylist(), found["words"]):
        out[i * size : (i + 1) * size] = np.frombuffer(words.as_buffer(), np.uint64)
    return out


def place_hash(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash of a stretch's piece and place."""
    h = key.astype(np.int64).view(np.uint64)
    for x in (doc, at):
        h = (h ^ x.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


PLACE = "key bigint, mark bigint, doc bigint, sub bigint, at bigint, n int, multi boolean"


def found_in(part: list[bytes], ids: list, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arrays key, doc, sub, at, n, multi of the stretches that pass the filter, and the place of each one's text."""
    text, key, first, count, multi = stretches(part)
    hit = np.flatnonzero(holds(words, key))
    text = text[hit]
    doc = np.fromiter(map(order_key, ids), np.int64, len(ids))
    sub = np.fromiter(map(zlib.crc32, part), np.int64, len(part))
    return key[hit].view(np.int64), doc[text], sub[text], first[hit], count[hit], multi[hit], text


def bytes_of(part: list[bytes], text: np.ndarray, at: np.ndarray, n: np.ndarray) -> Iterator[bytes]:
    return (part[t][a:b] for t, a, b in zip(text.tolist(), at.tolist(), (at + n + (LENGTH - 1)).tolist()))


def marks(pieces: Iterator[bytes], n: int) -> np.ndarray:
    """A hash of each stretch's bytes."""
    digest = xxhash.xxh3_64_intdigest
    return (np.fromiter((digest(p, 7) for p in pieces), np.uint64, n) ^ np.uint64(1 << 63)).view(np.int64)


def not_least(key: np.ndarray, mark: np.ndarray, place: list[np.ndarray]) -> np.ndarray:
    """True where another of the same key and mark has a smaller place."""
    out = np.zeros(len(key), bool)
    if not len(key):
        return out
    by = np.argsort(mark)
    same = mark[by[1:]] == mark[by[:-1]]
    some = by[np.append(same, False) | np.append(False, same)]
    some = some[np.lexsort((*(x[some] for x in reversed(place)), mark[some], key[some]))]
    if len(some):
        head = np.append(True, (key[some[1:]] != key[some[:-1]]) | (mark[some[1:]] != mark[some[:-1]]))
        least = some[head][np.cumsum(head) - 1]
        out[some] = np.logical_or.reduce([x[some] != x[least] for x in place])
    return out


def occurrences(docs: DataFrame, held) -> DataFrame:
    """Every stretch that passes the filter; ``whole`` where the batch has an equal one
    with a smaller place, so that it is a repeat without further ado."""

    def run(ids: list, texts: list) -> dict[str, list]:
        found = []
        for start, part in parts_of(texts):
            key, doc, sub, at, n, multi, text = found_in(part, ids[start : start + len(part)], held.value)
            found.append((key, marks(bytes_of(part, text, at, n), len(key)), doc, sub, at, n.astype(np.int32), multi))
        cols = dict(zip(["key", "mark", "doc", "sub", "at", "n", "multi"], map(np.concatenate, zip(*found))))
        return cols | {"whole": not_least(cols["key"], cols["mark"], [cols[c] for c in ("doc", "sub", "at")])}

    return map_rows(docs, ["doc_id", "text"], run, PLACE + ", whole boolean")


def sorted_out(rows: DataFrame) -> DataFrame:
    """All occurrences with ``state``: 0 a repeat whole, 1 the least of its kind with nothing
    else of its piece, 2 the least of its kind to be sorted against others. A place that a
    repeated row names again is one occurrence."""
    dealt = F.when(F.col("whole"), F.xxhash64("doc", "at")).otherwise(F.col("key"))
    parts = rows.withColumn("to", dealt).repartition("to").drop("to").sortWithinPartitions("whole", "key", "mark", "doc", "sub", "at")
    names = ["key", "mark", "doc", "sub", "at", "n", "multi"]
    arrow = pa.schema([(c, pa.bool_() if c == "multi" else pa.int32() if c == "n" else pa.int64()) for c in names] + [("state", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None  # a piece's first row, until the next row tells whether it is alone
        before: int | None = None  # the piece of the row before it
        last: tuple | None = None
        for batch in batches:
            cols = dict(zip([*names, "whole"], batch.columns))
            key, mark, whole = (c.to_numpy(zero_copy_only=False) for c in (cols["key"], cols["mark"], cols["whole"]))
            place = [cols[c].to_numpy() for c in ("doc", "sub", "at")]
            same, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (mark[1:] == mark[:-1]) & ~whole[:-1]
            again[1:] = same[1:] & np.logical_and.reduce([x[1:] == x[:-1] for x in place])
            if last is not None and len(key):
                same[0] = (int(key[0]), int(mark[0])) == last[:2]
                again[0] = same[0] and tuple(int(x[0]) for x in place) == last[2:]
            repeat = (whole | same) & ~again
            rest = pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)
            yield stated(rest.filter(pa.array(repeat)), 0)
            if len(key) and not whole[-1]:
                last = (int(key[-1]), int(mark[-1]), *(int(x[-1]) for x in place))
            mine = rest.filter(pa.array(~repeat & ~again))
            if waiting is not None:
                mine = pa.Table.from_batches([waiting, mine]).combine_chunks().to_batches()[0]
            if not mine.num_rows:
                continue
            keys = mine.column(0).to_numpy()
            several = mine.column(6).to_numpy(zero_copy_only=False).copy()
            several[1:] |= keys[1:] == keys[:-1]
            several[:-1] |= keys[1:] == keys[:-1]
            several[0] |= before == int(keys[0])
            stop = len(keys) if several[-1] else len(keys) - 1
            waiting = None if several[-1] else mine.slice(stop)
            before = int(keys[-1]) if several[-1] else int(keys[-2]) if len(keys) > 1 else before
            yield stated(mine.slice(0, stop), 1 + several[:stop])
        if waiting is not None:
            yield stated(waiting, 1)

    def stated(batch: pa.RecordBatch, state: int | np.ndarray) -> pa.RecordBatch:
        column = pa.array(np.full(batch.num_rows, state, np.int32) if isinstance(state, int) else state.astype(np.int32))
        return pa.RecordBatch.from_arrays([*batch.columns, column], schema=arrow)

    return parts.mapInArrow(run, PLACE + ", state int")


def fetched(docs: DataFrame, held, wanted, crowded) -> DataFrame:
    """The stretches whose places the second filter knows, with their bytes; those of crowded
    pieces as windows, whose hash stands for key and mark, without."""

    def run(ids: list, texts: list) -> dict[str, list]:
        names = ["key", "mark", "doc", "sub", "at", "n", "multi", "bytes"]
        cols: list[list] = [[] for _ in names]
        for start, part in parts_of(texts):
            found = found_in(part, ids[start : start + len(part)], held.value)
            hit = np.flatnonzero(holds(wanted.value, place_hash(found[0], found[1], found[3])))
            key, doc, sub, at, n, multi, text = (x[hit] for x in found)
            raw = list(bytes_of(part, text, at, n))
            many = holds(crowded.value, key.view(np.uint64))
            mark = marks(iter(raw), len(raw))
            for col, x in zip(cols, (key, mark, doc, sub, at, n, multi)):
                col += x[~many].tolist()
            cols[-1] += [raw[i] for i in np.flatnonzero(~many).tolist()]
            for i in np.flatnonzero(many).tolist():
                place = int(doc[i]), int(sub[i])
                for k in range(int(n[i])):
                    high, low = divmod(xxhash.xxh3_128_intdigest(raw[i][k : k + LENGTH], 11), 1 << 64)
                    for col, v in zip(cols, (low - (1 << 63), high - (1 << 63), *place, int(at[i]) + k, 1, False, None)):
                        col.append(v)
        return dict(zip(names, cols))

    return map_rows(docs, ["doc_id", "text"], run, PLACE + ", bytes binary")


def repeats(batch: list[tuple]) -> list[tuple[int, list[tuple[int, int]]]]:
    """For stretches ``(key, (doc, sub, at), n, bytes)`` of whole pieces: for each, the
    runs of windows that have an equal one with a smaller least place."""
    flat = np.frombuffer(b"".join(x[3] for x in batch), np.uint8)
    sizes = np.array([len(x[3]) for x in batch], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(int((sizes + 1).sum()) + 1, np.int16)  # 1 parts stretches, 0 ends the text
    text[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat.astype(np.int16) + 2
    text[-1] = 0
    owner = np.repeat(np.arange(len(batch)), sizes + 1)
    offset = np.arange(len(owner)) - starts[owner]
    windows = np.array([x[2] for x in batch], np.int64)
    order, prefix = suffix_order(text, LENGTH, symbols=258)
    group = np.cumsum(prefix < LENGTH)
    inside = order < len(owner)
    order, group = order[inside], group[inside]
    own = offset[order] < windows[owner[order]]
    order, group = order[own], group[own]
    # a class's least place follows from the stretches' least occurrences
    doc_rank = {d: r for r, d in enumerate(sorted({x[1][:2] for x in batch}))}
    doc = np.array([doc_rank[x[1][:2]] for x in batch], np.int64)
    at = np.array([x[1][2] for x in batch], np.int64)
    place = (doc[owner[order]] << 40) | (at[owner[order]] + offset[order])
    number = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1 if len(group) else group
    least = np.full(int(number[-1]) + 1 if len(number) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, number, place)
    gone = order[place > least[number]]
    gone.sort()
    out = []
    cut = np.flatnonzero(np.append(True, (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]]))) if len(gone) else []
    runs: dict[int, list[tuple[int, int]]] = {}
    for i, j in zip(cut, [*cut[1:], len(gone)] if len(cut) else []):
        runs.setdefault(int(owner[gone[i]]), []).append((int(offset[gone[i]]), int(j - i)))
    for i, x in runs.items():
        out.append((i, x))
    return out


def sorted_stretches(rows: DataFrame) -> DataFrame:
    """Byte ranges (``doc``, ``sub``, ``from``, ``end``) that repeat a smaller place's, among least stretches."""
    parts = rows.repartition("key").sortWithinPartitions("key", "mark", "doc", "sub", "at")
    arrow = pa.schema([(c, pa.int64()) for c in ("doc", "sub", "from", "end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: list[tuple] = []  # stretches of whole pieces
        piece: list[tuple] = []
        size, last, window = 0, None, (None, None)

        def spans() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in arrow]
            for i, runs in repeats(text):
                doc, sub, at = text[i][1]
                for a, n in runs:
                    for c, v in zip(cols, (doc, sub, at + a, at + a + n + LENGTH - 1)):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=arrow)

        for batch in batches:
            equal: list[tuple[int, int, int]] = []
            for key, mark, doc, sub, at, n, multi, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if raw is None:  # a window of a crowded piece: the least place comes first
                    if window == (key, mark, doc, sub, at):
                        continue
                    if window[:2] == (key, mark):
                        equal.append((doc, sub, at))
                    window = (key, mark, doc, sub, at)
                    continue
                if last == (key, mark):
                    continue  # a false hit of the filter; the least place came first
                if piece and piece[0][0] != key:
                    if len(piece) > 1 or piece[0][4]:
                        text += piece
                        size += sum(len(x[3]) for x in piece)
                    piece = []
                    if size >= TEXT:
                        yield spans()
                        text, size = [], 0
                last = (key, mark)
                piece.append((key, (doc, sub, at), n, raw, multi))
            if equal:
                doc, sub, at = (pa.array(c, pa.int64()) for c in zip(*equal))
                yield pa.RecordBatch.from_arrays([doc, sub, at, pc.add(at, LENGTH)], schema=arrow)
        if len(piece) > 1 or piece and piece[0][4]:
            text += piece
        if text:
            yield spans()

    return parts.mapInArrow(run, "doc bigint, sub bigint, `from` bigint, `end` bigint")


def removed_spans(docs: DataFrame) -> DataFrame:
    """``doc``, ``sub``, ``froms``, ``ends``: byte ranges to remove, a row a document that has any (unsorted, may overlap)."""
    context = docs.sparkSession.sparkContext
    held = context.broadcast(repeated_pieces(docs))  # of fixed size
    found = stored(sorted_out(occurrences(docs, held)), "occurrences")
    least = found.filter("state = 2")
    wanted = context.broadcast(filter_words(hashed(least)))  # of fixed size
    many = least.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED)
    crowded = context.broadcast(filter_words(many))  # of fixed size
    spans = sorted_stretches(fetched(docs, held, wanted, crowded))
    whole = found.filter("state = 0").select("doc", "sub", F.col("at").alias("from"), (F.col("at") + F.col("n") + LENGTH - 1).alias("end"))
    every = whole.unionByName(spans)
    return every.groupBy("doc", "sub").agg(F.collect_list("from").alias("froms"), F.collect_list("end").alias("ends"))


def hashed(places: DataFrame) -> DataFrame:
    """:func:`place_hash` of rows, as ``key``."""

    def run(key: list, doc: list, at: list) -> dict[str, list]:
        return {"key": place_hash(*(np.array(x, np.int64) for x in (key, doc, at))).view(np.int64)}

    return map_rows(places.withColumn("at", F.col("at").cast("bigint")), ["key", "doc", "at"], run, "key bigint")


def cut_out(raw: bytes, froms: list | None, ends: list | None) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left."""
    if not froms:
        return 0, 0, raw
    order = np.argsort(np.asarray(froms), kind="stable")
    a, b = np.asarray(froms)[order], np.maximum.accumulate(np.asarray(ends)[order])
    head = np.append(True, a[1:] > b[:-1])
    start, stop = a[head], b[np.append(np.flatnonzero(head)[1:] - 1, len(b) - 1)]
    kept, at = [], 0
    for x, y in zip(start.tolist(), stop.tolist()):
        kept.append(raw[at:x])
        at = y
    kept.append(raw[at:])
    return int((stop - start).sum()), len(start), b"".join(kept)


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, ``kept`` bytes."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = stored(removed_spans(docs), "spans")
    doc, sub = F.coalesce("doc_id", F.lit(LAST)), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = docs.withColumns({"doc": doc, "sub": sub})
    found = keyed.join(spans, ["doc", "sub"], "left")

    def run(ids: list, froms: list, ends: list, texts: list) -> dict[str, list]:
        raw = [raw_of(t) for t in texts]
        cut = [cut_out(r, a, b) for r, a, b in zip(raw, froms, ends)]
        out = {
            "doc_id": ids,
            "n_bytes": [len(r) for r in raw],
            "n_removed": [c[0] for c in cut],
            "n_spans": [c[1] for c in cut],
            "kept_sha256": [hashlib.sha256(c[2]).hexdigest() for c in cut],
        }
        return out | ({"kept": [c[2] for c in cut]} if with_bytes else {})

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_bytes
    return map_rows(found, ["doc_id", "froms", "ends", "text"], run, schema)
