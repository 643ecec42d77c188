"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of perfect Hamming codes, one code for each block of a
fingerprint's bits: every block value lies within 1 (the covering radius) of one
codeword. A fingerprint goes to every anchor within radius plus threshold; two
that differ by at most the threshold in some block then meet at the anchor that
is nearest to the first, and are compared there in full.

With 64 bits and at most 3 differences, one of two blocks has at most 1, so none
are lost (31 of each half's 32 bits are coded; leaving a bit out only lowers a
distance).

A share of common shingles (:data:`SIMILAR`) is not decided by the sketch: wider
fingerprints of the distinct shingles with more blocks only name candidates, and the
exact Jaccard similarity of the shingle sets decides inside each group of candidates.
There an anchor is a codeword together with two min-hashes of the shingles, others for
each block: texts that have nothing in common do not meet however many there are, so
that an anchor's rows do not grow with the corpus, while its code may be short.

Equal fingerprints are one row before any replication. Anchors with many rows
are compared in pairs of chunks, each its own task group; nothing is capped. Each
group emits at most one edge a row, to the least row that it is connected to.

Defined cases: a null text counts as empty and, like any text without words, has
fingerprint zero, which is linked like any other; a text with fewer words than a
shingle is one shingle; rows without an id get their component like others;
components are named by their least id (null where no row has one).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_words, holds, map_rows, quoted, small_batches, stored
from .components import components

#: Rows of one anchor that one task group compares.
CHUNK = 4096
#: Rows of one group of candidates whose shingles one task group compares.
SETS = 1024
#: Shingles whose bits are counted at once.
STEP = 1 << 17


@dataclass(frozen=True)
class Plan:
    """Shingle words, 64-bit lanes, bits of a block's code (2**r - 1), blocks' places, threshold,
    the Jaccard similarity that decides on candidates (0: the threshold decides; shingles
    then count as often as they stand in a text), and the min-hashes of an anchor (0: none)."""

    words: int = 3
    lanes: int = 1
    r: int = 5
    offsets: tuple[int, ...] = (0, 32)
    threshold: int = 3
    similarity: float = 0.0
    least: int = 0


#: The contract's: exact for 3 differing bits.
EXACT = Plan()
#: For five-word shingles and a similarity of 0.8: three lanes, ten blocks of 7 bits. Bits of pairs of
#: similarity 0.8 differ with probability 0.15 (29 of 192, standard deviation 5). Such a pair meets in a
#: block with probability 0.72 (at most 1 difference) x 0.64 (two equal min-hashes), and in none of ten
#: with 0.002.
SIMILAR = Plan(words=5, lanes=3, r=3, offsets=tuple(range(0, 160, 16)), threshold=56, similarity=0.8, least=2)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of the lower-cased (A-Z) words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
    starts = [0, *ends[: n - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another hash of each hash, for the lanes after the first."""
    if not lane:
        return h
    h = (h ^ np.uint64(lane)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def fingerprint(text: str | None, plan: Plan = EXACT) -> list[int]:
    """The lanes of a text's shingles."""
    hashes = shingle_hashes(text, plan.words)
    return lanes_of(np.unique(hashes) if plan.similarity else hashes, plan)


def lanes_of(hashes: np.ndarray, plan: Plan) -> list[int]:
    """A lane's bit is 1 if it is set in over half of the hashes; lanes as signed 64-bit integers."""
    out = []
    for lane in range(plan.lanes):
        ones = np.zeros(64, np.int64)
        for a in range(0, len(hashes), STEP):
            part = mixed(hashes[a : a + STEP], lane).astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def min_hashes(hashes: np.ndarray, plan: Plan) -> list[int]:
    """For each block a hash of ``plan.least`` min-hashes of the shingles, as signed 64-bit integers."""
    salts = mixed(np.arange(len(plan.offsets) * plan.least, dtype=np.uint64), 1000)
    least = np.zeros(len(salts), np.uint64)
    for a in range(0, len(hashes), STEP):  # the hashes are mixed well: a product by an odd number orders them anew
        part = hashes[a : a + STEP]
        found = np.fromiter(((part * (salt | np.uint64(1))).min() for salt in salts), np.uint64, len(salts))
        least = np.minimum(least, found) if a else found
    out = np.zeros(len(plan.offsets), np.uint64)
    for k in range(plan.least):
        out = mixed(out ^ least[k :: plan.least], 7 + k)
    return out.view(np.int64).tolist()


def block_names(plan: Plan) -> list[str]:
    return [f"m{k}" for k in range(len(plan.offsets))] if plan.least else []


def fingerprints(docs: DataFrame, plan: Plan = EXACT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and a lane a column (``f0``, ``f1``, ...)."""
    lanes = [f"f{k}" for k in range(plan.lanes)]

    def run(ids: list, texts: list) -> dict[str, list]:
        found = [fingerprint(t, plan) for t in texts]
        return {"doc_id": ids} | {c: [f[k] for f in found] for k, c in enumerate(lanes)}

    return map_rows(docs, [id_col, text_col], run, ", ".join(["doc_id bigint", *(f"{c} bigint" for c in lanes)]))


def hex_of(lanes: list[str]) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in lanes)))


def anchors(plan: Plan) -> Column:
    """Array of ``(key, home)``: the codewords within 2 of each block's value.

    Column i of the code's check matrix is the number i, so the syndrome is the XOR of
    the set bits' numbers; flipping i and i^syndrome (0: no flip) leads to a codeword.
    """
    n = (1 << plan.r) - 1
    flip = lambda i: f"if({i} = 0, 0L, shiftleft(1L, {i} - 1))"
    blocks = []
    for number, offset in enumerate(plan.offsets):
        value = f"(shiftrightunsigned(f{offset // 64}, {offset % 64}) & {(1 << n) - 1}L)"
        parity = []
        for j in range(plan.r):
            mask = sum(1 << (i - 1) for i in range(1, n + 1) if i >> j & 1)
            parity.append(f"shiftleft(bit_count({value} & {mask}L) & 1, {j})")
        syndrome = "(" + " | ".join(parity) + ")"
        pairs = f"filter(sequence(0, {n}), i -> i < (i ^ {syndrome}) or ({syndrome} = 0 and i = 0))"
        word = f"{value} ^ {flip('i')} ^ {flip(f'(i ^ {syndrome})')}"
        key = f"shiftleft({number}L, 40) | ({word})"
        if plan.least:
            key = f"xxhash64({key}, m{number})"
        blocks.append(f"transform({pairs}, i -> struct({key} as key, i = 0 as home))")
    return F.expr(f"concat({', '.join(blocks)})")


def linked(f: np.ndarray, g: np.ndarray, threshold: int) -> np.ndarray:
    """Whether fingerprints (lanes on the last axis) differ in few enough bits."""
    bits = np.bitwise_count(f[..., 0] ^ g[..., 0])
    for lane in range(1, f.shape[-1]):
        bits = bits + np.bitwise_count(f[..., lane] ^ g[..., lane])  # below 256 for three lanes
    return bits <= threshold


def group_labels(f: np.ndarray, home: np.ndarray, threshold: int) -> np.ndarray:
    """For each row of a group the least row it is connected to; only pairs with a home row count."""
    n = len(f)
    label = np.arange(n)
    homes = np.flatnonzero(home)
    step = max(1, (1 << 19) // n)
    parts = [homes[a : a + step] for a in range(0, len(homes), step)]
    # a first look: in most groups no row is near another, and the others need only the rows that are
    busy = [rows for rows in parts if np.count_nonzero(linked(f[rows][:, None], f[None], threshold)) > len(rows)]
    while busy:
        before = label.copy()
        for rows in busy:
            near = linked(f[rows][:, None], f[None], threshold)
            least = np.where(near, label, n).min(1)
            label[rows] = np.minimum(label[rows], least)
            label = np.minimum(label, np.where(near, label[rows][:, None], n).min(0))
        label = label[label]
        if (label == before).all():
            break
    return label


def gathered(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[list[np.ndarray]]:
    """The batches' columns, ``most`` rows or a few more at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held = []
    if sum(b.num_rows for b in held):
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def compare(batches: Iterator[pa.RecordBatch], plan: Plan, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Edges of groups (runs of equal ``key`` and ``pair``) in a sorted partition."""

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, pair, home, *lanes = cols
        f = np.stack(lanes, 1).view(np.uint64)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        first = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([first, [len(key)]]))
        label = np.arange(len(key))
        for n in np.unique(size[size > 1]).tolist():  # groups of one size stand side by side
            starts = first[size == n]
            if n > 32:
                for s in starts.tolist():
                    label[s : s + n] = s + group_labels(f[s : s + n], home[s : s + n], plan.threshold)
                continue
            for a in range(0, len(starts), 4096):
                at = starts[a : a + 4096][:, None] + np.arange(n)
                near = linked(f[at][:, :, None], f[at][:, None], plan.threshold)
                near &= home[at][:, :, None] | home[at][:, None]
                near |= np.eye(n, dtype=bool)
                own = np.broadcast_to(np.arange(n), at.shape).copy()
                while True:
                    least = np.where(near, own[:, None], n).min(2)
                    if (least == own).all():
                        break
                    own = least
                label[at] = at[:, :1] + own
        tied = np.flatnonzero((label != np.arange(len(key))) & (f != f[label]).any(1))
        ends = np.concatenate([f[tied], f[label[tied]]], 1).view(np.int64)
        ends = np.unique(ends, axis=0) if len(ends) else ends
        return pa.RecordBatch.from_arrays([pa.array(c) for c in ends.T], schema=schema)

    held: list[list[np.ndarray]] = []
    for cols in gathered(batches):
        held.append(cols)
        key, pair = cols[0], cols[1]
        last = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
        stop = int(last[-1]) + 1 if len(last) else 0
        if not stop:  # one group so far; groups are at most two chunks
            continue
        whole = [np.concatenate([h[i] for h in held]) for i in range(len(cols))]
        split = len(whole[0]) - (len(key) - stop)
        yield edges([c[:split] for c in whole])
        held = [[c[split:] for c in whole]]
    if held:
        yield edges([np.concatenate(c) for c in zip(*held)])


def alike_at_every_size(side: DataFrame) -> DataFrame:
    """A side that grows with the corpus is never broadcast: a small corpus takes the plan of a large one."""
    return side.hint("merge")


def links(distinct: DataFrame, plan: Plan) -> DataFrame:
    """Edges ``a``, ``b`` (hex fingerprints) that connect all linked fingerprints."""
    spark = distinct.sparkSession
    lanes = [f"f{k}" for k in range(plan.lanes)]
    placed = distinct.select(*lanes, F.explode(anchors(plan)).alias("x")).select("x.key", "x.home", *lanes)
    crowded = placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(placed.join(alike_at_every_size(crowded), "key"), "anchors")
    few = met.filter(F.col("n") <= CHUNK).select("key", F.lit(0).alias("pair"), "home", *lanes)
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64(*lanes), chunks).cast("int")
    many = (
        met.filter(F.col("n") > CHUNK)
        .withColumns({"chunks": chunks, "mine": mine})
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("key", (F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other") + 1).alias("pair"), "home", *lanes)
    )
    # the least row of a group is that of most other groups of its copies, so that edges repeat each other
    dealt = few.unionByName(many).repartition("key", "pair").sortWithinPartitions("key", "pair", *lanes)
    small_batches(spark)
    ends = [f"{side}{k}" for side in "ab" for k in range(plan.lanes)]
    arrow = pa.schema([(c, pa.int64()) for c in ends])
    found = dealt.mapInArrow(lambda batches: compare(batches, plan, arrow), ", ".join(f"{c} bigint" for c in ends))
    half = plan.lanes
    return found.distinct().select(hex_of(ends[:half]).alias("a"), hex_of(ends[half:]).alias("b"))


def near_duplicates(docs: DataFrame, plan: Plan = EXACT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex), ``component_id`` (least id of the linked documents)."""
    lanes = [f"f{k}" for k in range(plan.lanes)]
    prints = stored(fingerprints(docs, plan, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = stored(prints.groupBy(*lanes).agg(F.min("doc_id").alias("least")), "distinct")
    named = distinct.withColumn("node", hex_of(lanes))
    groups = components(links(distinct, plan))
    of = named.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    found = stored(of.join(ids, "component").select("node", "component_id"), "found")
    return prints.withColumn("node", hex_of(lanes)).join(found, "node").select("doc_id", F.col("node").alias("fingerprint"), "component_id")


def alike(sets: list[np.ndarray], similarity: float, known: list[str]) -> np.ndarray:
    """For each set (sorted) the least one that pairs of that similarity or more connect it to;
    sets of one ``known`` name are connected already."""
    size = np.array([len(x) for x in sets], np.int64)
    place: dict[str, int] = {}
    label = np.array([place.setdefault(name, i) for i, name in enumerate(known)])
    for i in range(len(sets) - 1):
        if not size[i]:
            continue
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1  # connected ones need no look
        other = other[np.minimum(size[other], size[i]) / np.maximum(size[other], size[i]) >= similarity]
        if not len(other):
            continue
        every = np.concatenate([sets[j] for j in other.tolist()])
        hit = sets[i][np.minimum(np.searchsorted(sets[i], every), size[i] - 1)] == every
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[other]) - size[other])
        near = other[common / (size[other] + size[i] - common) >= similarity]
        if len(near):
            met = np.append(label[near], label[i])
            label[np.isin(label, met)] = met.min()
    return label


def verify(batches: Iterator[pa.RecordBatch], plan: Plan, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Edges between names, of groups (runs of equal ``cluster`` and ``pair``) in a sorted partition."""
    names: list[str] = []
    known: list[str] = []
    sets: list[np.ndarray] = []
    last = None

    def edges() -> pa.RecordBatch:
        label = alike(sets, plan.similarity, known).tolist()
        tied = [i for i, j in enumerate(label) if names[i] != names[j]]
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in tied], pa.string()), pa.array([names[label[i]] for i in tied], pa.string())], schema=schema)

    for batch in batches:
        for cluster, pair, name, part, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if last != (cluster, pair):
                if len(sets) > 1:
                    yield edges()
                names, known, sets, last = [], [], [], (cluster, pair)
            names.append(name)
            known.append(part)
            sets.append(np.frombuffer(raw, np.uint64))
    if len(sets) > 1:
        yield edges()


def verified(rows: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Edges ``a``, ``b`` between the ``name`` of rows of one ``cluster`` and ``pair`` whose sets are alike;
    rows of one ``known`` name are connected already."""
    dealt = rows.join(alike_at_every_size(sets), ["pick", "mark"]).select("cluster", "pair", "name", "known", "shingles")
    dealt = dealt.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair", "name")
    small_batches(rows.sparkSession)
    arrow = pa.schema([("a", pa.string()), ("b", pa.string())])
    return stored(dealt.mapInArrow(lambda batches: verify(batches, plan, arrow), "a string, b string"), "verified")


def verified_links(docs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Edges ``a``, ``b`` (names) that connect all shingle sets of the similarity.

    ``nodes``: a row a distinct set with its ``name``, ``mark``, the hash ``pick`` of one of its
    rows, and its fingerprint. Only sets with a candidate are fetched, from that row, which a filter
    of fixed size finds: no text goes through an exchange. A large group of candidates
    is dealt into parts, each with the group's first set: copies of one text are connected through it,
    and a set travels once. Only where that leaves several components, the sets outside the
    largest meet each other and all parts of the largest."""
    lanes = [f"f{k}" for k in range(plan.lanes)]
    groups = components(links(nodes.select(*lanes, *block_names(plan)).distinct(), plan))
    placed = nodes.withColumn("node", hex_of(lanes)).join(alike_at_every_size(groups), "node", "left")
    placed = stored(placed.select("name", "mark", "pick", F.coalesce("component", "node").alias("cluster")), "placed")
    # a table of its own, so that adaptive execution can split a large cluster's rows
    many = stored(placed.groupBy("cluster").agg(F.count("*").alias("n"), F.min(F.struct("name", "mark", "pick")).alias("first")).filter("n > 1"), "many")
    members = stored(placed.join(alike_at_every_size(many), "cluster"), "candidates")
    wanted = docs.sparkSession.sparkContext.broadcast(filter_words(members.select(F.col("pick").alias("key"))))  # of fixed size

    def run(picks: list, texts: list) -> dict[str, list]:
        hit = np.flatnonzero(holds(wanted.value, np.array(picks, np.int64).view(np.uint64))).tolist() if picks else []
        sets = [np.unique(shingle_hashes(texts[i], plan.words)) for i in hit]
        return {"pick": [picks[i] for i in hit], "mark": [mark_of(x) for x in sets], "shingles": [x.tobytes() for x in sets]}

    rows = docs.select("doc_id", text_hash(), "text").select(row_hash(), "text")
    found = map_rows(rows, ["pick", "text"], run, "pick bigint, mark bigint, shingles binary")
    sets = stored(found.dropDuplicates(["pick", "mark"]), "shingles")
    parts = lambda n: F.ceil(n / SETS).cast("int")
    part = lambda n: F.pmod(F.xxhash64("name"), F.greatest(parts(n), F.lit(1))).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    own = members.select("cluster", part(F.col("n")).alias("pair"), "name", "pick", "mark", F.col("name").alias("known"))
    large = stored(members.filter(F.col("n") > SETS), "large")
    if large.isEmpty():
        return verified(own, sets, plan)
    firsts = large.groupBy("cluster").agg(F.min("first").alias("x"), F.max("n").alias("n")).select("cluster", upto(F.col("n")).alias("pair"), "x.name", "x.pick", "x.mark", F.col("x.name").alias("known"))
    once = verified(own.unionByName(firsts), sets, plan)
    of = large.drop("n", "first").join(components(once).withColumnRenamed("node", "name"), "name", "left").withColumn("known", F.coalesce("component", "name")).drop("component")
    of = stored(of, "parts")
    sizes = of.groupBy("cluster", "known").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("inner"), F.count("*").alias("several")).filter("several > 1")
    rows = of.join(main.withColumn("outer", F.col("n") - F.col("inner")).drop("n", "several"), "cluster")
    inner, outer, across = F.col("inner"), F.col("outer"), parts(F.col("inner"))
    columns = ["cluster", "pair", "name", "pick", "mark", "known"]
    inside = rows.filter("known = main").withColumns({"mine": part(inner), "other": upto(outer)}).withColumn("pair", F.col("other") * across + F.col("mine")).select(*columns)
    apart = rows.filter("known <> main").withColumn("mine", part(outer))
    met = apart.withColumn("other", upto(inner)).withColumn("pair", F.col("mine") * across + F.col("other")).select(*columns)
    lower, upper = F.least("mine", "other"), F.greatest("mine", "other")
    among = apart.withColumn("other", upto(outer)).withColumn("pair", parts(outer) * across + lower * parts(outer) + upper).select(*columns)
    return once.unionByName(verified(inside.unionByName(met).unionByName(among), sets, plan))


def mark_of(hashes: np.ndarray) -> int:
    """One hash of a set of shingles (sorted)."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), 7) - (1 << 63)


def row_hash() -> Column:
    """One hash of a row's id and text."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(0)), "t").alias("pick")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")


def similar_rows(docs: DataFrame, plan: Plan = SIMILAR) -> DataFrame:
    """``doc_id``, ``t`` (hash of the text) and ``least``: the least ``(doc_id, t)`` of the documents
    that pairs of the similarity connect (rows without an id name none)."""
    lanes = [f"f{k}" for k in range(plan.lanes)]

    def run(ids: list, texts_of: list, texts: list) -> dict[str, list]:
        sets = [np.unique(shingle_hashes(t, plan.words)) for t in texts]
        found = [lanes_of(x, plan) for x in sets]
        least = [min_hashes(x, plan) for x in sets]
        out = {"doc_id": ids, "t": texts_of, "mark": [mark_of(x) for x in sets]} | {c: [f[k] for f in found] for k, c in enumerate(lanes)}
        return out | {c: [m[k] for m in least] for k, c in enumerate(block_names(plan))}

    schema = ", ".join(["doc_id bigint, t bigint, mark bigint", *(f"{c} bigint" for c in (*lanes, *block_names(plan)))])
    prints = stored(map_rows(docs.select("doc_id", text_hash(), "text"), ["doc_id", "t", "text"], run, schema), "fingerprints")
    name = F.concat(hex_of(lanes), hex_of(["mark"])).alias("name")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t")))
    same = [F.min(c).alias(c) for c in block_names(plan)]  # of one set
    nodes = stored(prints.groupBy(*lanes, "mark").agg(least.alias("least"), F.min(row_hash()).alias("pick"), *same).select("*", name), "sets")
    groups = components(verified_links(docs, nodes, plan))
    of = nodes.join(alike_at_every_size(groups.withColumnRenamed("node", "name")), "name", "left").withColumn("component", F.coalesce("component", "name"))
    ids = of.groupBy("component").agg(F.min("least").alias("first"))
    found = stored(of.join(ids, "component").select(*lanes, "mark", "first"), "found")
    return prints.join(alike_at_every_size(found), [*lanes, "mark"]).select("doc_id", "t", F.col("first").alias("least"))


def similar_documents(docs: DataFrame, plan: Plan = SIMILAR) -> DataFrame:
    """``doc_id``, ``component_id`` (least id of the documents that pairs of the similarity connect)."""
    return similar_rows(docs, plan).select("doc_id", F.col("least.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, plan: Plan = SIMILAR) -> DataFrame:
    """The document of the least id (then hash of the text) of each group, once; rows without an id all stay.

    Rows with one id and different texts are different documents. Of rows equal in both
    the one whose columns hash least stays. Only rows that a filter of fixed size says may
    have to go meet the list of those that do; all others go through no exchange."""
    found = stored(similar_rows(docs, plan).filter("doc_id is not null"), "groups")
    gone = stored(found.filter("doc_id <> least.doc_id or t <> least.t").select("doc_id", "t").distinct(), "gone")
    again = stored(found.filter("doc_id = least.doc_id and t = least.t").groupBy("doc_id", "t").count().filter("count > 1"), "again")
    asked = gone.union(again.select("doc_id", "t")).select(row_hash().alias("key"))
    wanted = docs.sparkSession.sparkContext.broadcast(filter_words(asked))  # of fixed size

    def met(picks):
        import pandas as pd

        return pd.Series(holds(wanted.value, picks.to_numpy().view(np.uint64)))

    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("doc_id"), text_hash())
    rows = rows.withColumn("met", F.pandas_udf(met, "boolean")(row_hash()))
    apart, left = rows.filter("not met").select("row"), rows.filter("met").drop("met").join(alike_at_every_size(gone), ["doc_id", "t"], "left_anti")
    if not again.isEmpty():
        again = alike_at_every_size(again)
        whole = F.struct(*(F.xxhash64(F.col("row").getField(c)) for c in docs.columns))
        once = left.join(again, ["doc_id", "t"], "left_semi").groupBy("doc_id", "t").agg(F.min_by("row", whole).alias("row"))
        left = left.join(again, ["doc_id", "t"], "left_anti").select("row").union(once.select("row"))
    return apart.union(left.select("row")).select("row.*")
