"""FLAC, SimHash, suffix dedup, URL filters, Kneser-Ney, mixing and the pipeline against plain versions."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from meterlake.llm import common, flac, induced, mixing, perplexity, quality_rules, secret_scan, simhash, suffix_dedup, url_filter
from meterlake.llm.components import components
from meterlake.llm.queries import ORACLE

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, `odd.name` int"


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or ""), "x", 1) for i, t in enumerate(texts)], DOCS)


def prose(seed, n, words=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# -- FLAC ----------------------------------------------------------------------------


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - i)) & 1 for i in range(width)]
        return self

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def crc(data, poly, bits):
    c, top = 0, 1 << (bits - 1)
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & ((1 << bits) - 1)
    return c


def hand_made(samples, order, taps, shift, partition_order, escape):
    """A one-frame stream with partitions, Rice or escaped residuals and any predictor."""
    n = len(samples)
    head = b"\xff\xf8" + bytes([7 << 4, 4 << 1 if False else 1 << 1]) + b"\x00" + (n - 1).to_bytes(2)
    head += bytes([crc(head, 7, 8)])
    b = Bits().put(0, 1).put(31 + order, 6).put(0, 1)
    for x in samples[:order]:
        b.put(x & 255, 8)
    b.put(9, 4).put(shift, 5)
    for t in taps:
        b.put(t & 1023, 10)
    b.put(0, 2).put(partition_order, 4)
    size = n >> partition_order
    at = order
    for part in range(1 << partition_order):
        end = size * (part + 1)
        errors = [samples[i] - (sum(t * samples[i - 1 - j] for j, t in enumerate(taps)) >> shift) for i in range(at, end)]
        if escape and part % 2:
            b.put(15, 4).put(12, 5)
            for e in errors:
                b.put(e & 4095, 12)
        else:
            b.put(1, 4)
            for e in errors:
                u = 2 * e if e >= 0 else -2 * e - 1
                b.put(1, (u >> 1) + 1).put(u & 1, 1)
        at = end
    frame = head + b.bytes()
    frame += crc(frame, 0x8005, 16).to_bytes(2)
    md5 = hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    info = n.to_bytes(2) * 2 + bytes(6) + (8000 << 44 | 7 << 36 | n).to_bytes(8) + md5
    return b"fLaC\x80" + len(info).to_bytes(3) + info + frame


@pytest.mark.parametrize("order, taps, shift", [(1, [32], 5), (2, [60, -30], 5), (3, [90, -90, 30], 5)])
@pytest.mark.parametrize("partition_order, escape", [(0, False), (2, False), (3, True)])
def test_decoder_reads_what_the_encoder_does_not_write(order, taps, shift, partition_order, escape):
    samples = [int(90 * math.sin(i / 7)) for i in range(256)]
    assert flac.decode([hand_made(samples, order, taps, shift, partition_order, escape)])[0].tolist() == samples


def test_streams_round_trip_and_damage_is_found():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 576 * 3, dtype=np.uint8).tobytes(), b"\xff" * 576, flac.payload_of(prose(1, 3000))[1], (b"\xff\xf8\x20\x02\x01" * 576)]
    streams = flac.encode(payloads)
    assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode(streams)] == payloads
    for at in (60, len(streams[2]) // 2, len(streams[2]) - 1):
        broken = streams[2][:at] + bytes([streams[2][at] ^ 16]) + streams[2][at + 1 :]
        with pytest.raises(ValueError):
            flac.decode([broken])


def test_flac_query(spark):
    texts = [None, "", "é" * 400, prose(2, 900), prose(2, 900)]
    got = {r["doc_id"]: r for r in flac.media_features(flac.to_flac(documents(spark, texts))).collect()}
    for i, t in enumerate(texts):
        n, payload = flac.payload_of(t)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[3]["media_sha256"] == got[4]["media_sha256"] and got[3]["feature"] == got[4]["feature"]
    blocks = flac.pcm_blocks(flac.to_flac(documents(spark, texts)), block=1000).filter("doc_id = 3").orderBy("first_sample").collect()
    assert [b["first_sample"] for b in blocks] == list(range(0, got[3]["payload_bytes"], 1000))
    samples = b"".join(bytes(b["pcm"]) for b in blocks)
    assert (np.frombuffer(samples, np.int8).astype(int) + 128).astype(np.uint8).tobytes() == flac.payload_of(texts[3])[1]


def test_flac_query_reads_back_what_it_stores(spark, monkeypatch, tmp_path):
    from meterlake.llm import queries

    docs = documents(spark, [None, "", "é" * 400, prose(2, 9000), prose(2, 9000), prose(3, 3000)]).union(documents(spark, ["again", "again"]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    written = []
    monkeypatch.setattr(flac, "shared_dir", lambda spark, what: written.append(what) or str(tmp_path / f"{what}{len(written)}"))
    got = queries.op5_flac(spark, str(tmp_path))
    plain = [(i, *flac.payload_of(t)) for i, t in docs.select("doc_id", "text").collect()]
    streams = {p: flac.encode([p])[0] for _, _, p in plain}
    rows = sorted(tuple(r)[:7] for r in got.collect())
    assert rows == sorted((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(streams[p]), hashlib.sha256(streams[p]).hexdigest()) for i, n, p in plain)
    assert written == ["media"]
    media = spark.read.parquet(str(tmp_path / "media1"))
    flac.write_pcm_blocks(media, str(tmp_path / "pcm"), block=1000)
    blocks = spark.read.parquet(str(tmp_path / "pcm"))
    assert blocks.agg(F.sum("n_samples")).first()[0] == sum(len(p) for _, _, p in plain)
    assert flac.stored_features(docs.limit(0)).collect() == []


def test_samples_are_read_without_decoding_what_is_before(monkeypatch):
    payload = flac.payload_of(prose(5, 30_000))[1]
    stream = flac.encode([payload])[0]
    info = flac.Info.of(stream)
    assert len(info.points) == (len(payload) // flac.BLOCK - 1) // flac.POINT and info.points
    samples = flac.decode([stream])[0]
    decoded = []
    plain = flac.decode
    monkeypatch.setattr(flac, "decode", lambda s, i: decoded.append(i[0].total) or plain(s, i))
    rng = random.Random(2)
    for _ in range(60):
        first, n = rng.randrange(len(samples)), rng.choice([1, 100, 576, 5000])
        assert (flac.read_samples(stream, first, n) == samples[first : first + n]).all()
        assert decoded[-1] <= n + 2 * flac.BLOCK
    assert len(flac.read_samples(stream, len(samples), 5)) == 0
    damaged = bytearray(stream)
    damaged[-10] ^= 1
    assert len(flac.read_samples(bytes(damaged), 0, 500)) == 500  # other frames are not touched
    with pytest.raises(ValueError):
        flac.read_samples(bytes(damaged), len(samples) - 5, 5)


# -- near duplicates -----------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_simhash_equals_brute_force(spark, monkeypatch):
    base = prose(5, 300)
    rng = random.Random(8)
    texts = [None, "", " \t ", "one", "one two", base, base]
    for _ in range(60):
        words = base.split()
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = "zz%d" % rng.randint(0, 9)
        texts.append(" ".join(words))
    texts += [prose(100 + i, 60, 500) for i in range(30)]
    monkeypatch.setattr(simhash, "CHUNK", 16)  # pairs of chunks
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = np.array([simhash.fingerprint(t)[0] for t in texts], np.int64).view(np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    label = np.arange(len(texts))
    while True:
        least = np.where(near, label[None], len(texts)).min(1)
        if (least == label).all():
            break
        label = least
    for i in range(len(texts)):
        assert got[i]["fingerprint"] == format(int(prints[i]), "016x")
        assert got[i]["component_id"] == label[i]
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_anchors_cover(spark):
    rng = np.random.default_rng(4)
    f = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    other = f.copy()
    for i in range(len(f)):
        for bit in rng.choice(64, 3, replace=False).tolist():
            other[i] ^= np.int64(1 << bit) if bit < 63 else np.iinfo(np.int64).min
    rows = [(i, int(a)) for i, a in enumerate(f)] + [(i, int(a)) for i, a in enumerate(other)]
    got = spark.createDataFrame(rows, "i int, f0 bigint").select("i", F.transform(simhash.anchors(simhash.EXACT), lambda x: x["key"]).alias("k"), F.filter(simhash.anchors(simhash.EXACT), lambda x: x["home"])["key"].alias("h")).collect()
    pairs = defaultdict(list)
    for r in got:
        assert len(r["k"]) <= 32 and len(r["h"]) == 2
        pairs[r["i"]].append(r)
    assert all(set(a["h"]) & set(b["k"]) for a, b in pairs.values())


def test_similar_documents_meet():
    """Pairs just above the similarity, of short and long texts: nearly all meet at some anchor."""
    rng, hits, tried, plan = random.Random(1), 0, 0, simhash.SIMILAR
    for trial in range(1400):
        words = prose(trial, rng.choice([30, 60, 150, 300]), 400).split()
        other = list(words)
        for at in range(7, len(words) - 7, rng.choice([40, 44, 48])):
            other[at] = f"changed{at}"
        sets = [np.unique(simhash.shingle_hashes(" ".join(w), 5)) for w in (words, other)]
        share = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        if not 0.8 <= share < 0.84:
            continue
        f, g = (np.array(simhash.lanes_of(x, plan), np.int64).view(np.uint64) for x in sets)
        m, n = (simhash.min_hashes(x, plan) for x in sets)
        x = f ^ g
        near = [(int(x[o // 64]) >> (o % 64) & 0x7F).bit_count() <= 1 for o in plan.offsets]
        hits += any(close and i == j for close, i, j in zip(near, m, n)) and int(np.bitwise_count(x).sum()) <= plan.threshold
        tried += 1
    assert tried >= 300 and hits >= 0.98 * tried, (tried, hits)


def test_similar_documents_equal_exact_jaccard(spark, monkeypatch):
    rng = random.Random(12)
    line = prose(700, 30, 400)
    texts = [None, "", "one two", "one two three four five six"]
    for trial in range(60):
        words = prose(800 + trial, rng.choice([60, 150, 400]), 400).split()
        other = list(words)
        for at in range(5, len(words), max(6, round(5 / rng.uniform(0.06, 0.2)))):  # similarity of 0.65 to 0.9
            other[at] = "changed%d" % rng.randint(0, 10**6)
        texts += [" ".join(words), " ".join(other)]
    texts += [" ".join([line] * 40 + [prose(950 + i, 100, 400)]) for i in range(3)]  # bags alike, sets not
    texts += [prose(960, 200, 400), " ".join([prose(960, 200, 400)] + prose(960, 200, 400).split()[-5:] * 30)]  # sets alike, bags not
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    label = list(range(len(texts)))
    share = {}
    for i, a in enumerate(sets):
        for j in range(i):
            share[i, j] = len(a & sets[j]) / len(a | sets[j]) if a | sets[j] else 1.0
            if share[i, j] >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert sum(0.65 <= x < 0.8 for x in share.values()) >= 10 and sum(0.8 <= x < 0.9 for x in share.values()) >= 10
    for chunk in (1024, 8, 2):  # pairs of parts
        monkeypatch.setattr(simhash, "SETS", chunk)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(documents(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == label
    kept = {r["doc_id"] for r in simhash.one_of_each(documents(spark, texts)).collect()}
    assert kept == set(label)


# -- suffix dedup --------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    n, depth = int(rng.integers(1, 150)), int(rng.choice([3, 5, 20]))
    text = np.append(rng.integers(1, rng.integers(2, 6), n), 0).astype(np.int16)
    if n > 20:
        text[n // 2 : n // 2 + n // 4] = text[: n // 4]
    order, prefix = induced.suffix_order(text, depth, 6, in_memory=int(rng.choice([3, 1000])))
    assert sorted(order.tolist()) == list(range(n + 1))
    cut = [tuple(text[i : i + depth].tolist()) for i in order]
    for a, b, p in zip(cut, cut[1:], prefix[1:].tolist()):
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert a <= b and same == p


def plain_dedup(rows, length):
    seen, out = set(), {}
    for i, raw in sorted(rows, key=lambda r: r[0]):
        mark = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                mark[k : k + length] = b"\1" * length
            seen.add(raw[k : k + length])
        kept = bytes(c for c, m in zip(raw, mark) if not m)
        spans = sum(1 for k in range(len(raw)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[i] = (len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_pieces_spread_over_their_filter(spark):
    """Least hashes are small numbers: as keys they would share a filter's first few bits, and most single pieces would pass it."""
    passage = prose(7, 300)
    texts = [prose(i, 3000) + passage * (i % 3 == 0) for i in range(12)] + [None, "", "a" * 300, passage[:99]]
    raw = [(t or "").encode() for t in texts]
    found = [suffix_dedup.stretches([r]) for r in raw]
    keys = np.concatenate([f[1] for f in found])
    share = np.bincount((keys >> np.uint64(60)).astype(int), minlength=16) / len(keys)
    assert len(keys) > 5000 and 0.03 < share.min() and share.max() < 0.1
    counted = Counter(k for f in found for key, multi in zip(f[1].tolist(), f[4].tolist()) for k in [key] * (1 + multi))
    words = suffix_dedup.repeated_pieces(documents(spark, texts).repartition(3))
    want = np.array([k for k, n in counted.items() if n > 1], np.uint64)
    assert len(want) > 10 and common.holds(words, want).all()
    spots = {int(k) >> (64 - common.FILTER) for k in want}
    assert int(np.bitwise_count(words).sum()) == len(spots)
    assert not suffix_dedup.repeated_pieces(documents(spark, [])).any()


def test_a_sort_of_production_size_spills(monkeypatch):
    """A text as large as a task's goes through the scratch file, and comes out as without."""
    spilled = []
    plain = induced.SymbolQueue.spill
    monkeypatch.setattr(induced.SymbolQueue, "spill", lambda self: spilled.append(self.held) or plain(self))
    raw = np.frombuffer(" ".join(prose(i, 400, 3000) for i in range(1800)).encode()[: suffix_dedup.TEXT], np.uint8).astype(np.int16) + 2
    text = raw.copy()
    text[::150] = 1
    text = np.append(text, 0).astype(np.int16)
    order, prefix = induced.suffix_order(text, suffix_dedup.LENGTH, 258)
    assert len(spilled) >= 2 and max(spilled) > induced.IN_MEMORY
    spilled.clear()
    again, same = induced.suffix_order(text, suffix_dedup.LENGTH, 258, in_memory=1 << 30)
    assert not spilled and (order == again).all() and (prefix == same).all()
    at = np.random.default_rng(1).integers(1, len(order), 3000)
    flat = text.astype(np.uint8).tobytes()
    for i in at.tolist():
        a, b = (flat[k : k + suffix_dedup.LENGTH] for k in (int(order[i - 1]), int(order[i])))
        assert a <= b and (a[: prefix[i]] == b[: prefix[i]])


@pytest.mark.parametrize("crowded", [suffix_dedup.CROWDED, 3, 0])
def test_dedup_equals_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    passage, other = prose(50, 40), prose(51, 25)
    texts = [None, "", "short", "ab" * 150, "a" * 700, passage, prose(1, 30) + " " + passage + " é " + prose(2, 10), passage, passage[:99], "x" + passage[3:160] + "y" + passage[3:160], other + passage + other]
    texts += [prose(60, 20) + other[:130] + prose(60 + i, 9) for i in range(12)] + ["é" * 60, "ü" + "é" * 60]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(documents(spark, texts)).collect()}
    assert got == plain_dedup([(i, (t or "").encode()) for i, t in enumerate(texts)], 100)
    assert suffix_dedup.suffix_dedup(documents(spark, [])).collect() == []


def test_dedup_of_a_passage_in_every_document(spark, monkeypatch):
    """A passage whose edges differ everywhere, in small batches of rows, so that pieces go on from one to the next."""
    monkeypatch.setattr(suffix_dedup, "CROWDED", 20)
    monkeypatch.setattr(common, "BATCH_ROWS", 7)
    passage = prose(90, 30)
    texts = [prose(100 + i, 12) + passage + prose(400 + i, 12) for i in range(90)] + [prose(100, 12)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(documents(spark, texts)).collect()}
    assert got == plain_dedup([(i, t.encode()) for i, t in enumerate(texts)], 100)


def test_dedup_keeps_the_first_of_repeated_rows(spark):
    passage, other, third = prose(70, 40), prose(71, 40), prose(72, 50)
    rows = [(3, passage), (3, passage), (5, "y " + passage + third), (5, "y " + passage + third), (1, "short"), (1, "short")]
    rows += [(None, other), (None, other), (None, other), (None, third), (None, None), (7, "a" * 300), (7, "a" * 300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in rows], DOCS)
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    plain = plain_dedup([(place, (t or "").encode()) for place, (_, t) in enumerate(order)], 100)
    want = sorted((str(r[0]), *plain[order.index(r)]) for r in rows)
    for parts in (1, 4):  # copies in one batch, and in several
        got = suffix_dedup.suffix_dedup(docs.repartition(parts)).collect()
        assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == want


def test_one_of_each_keeps_rows_that_copy_nothing(spark):
    a, b, x = prose(80, 60), prose(81, 60), prose(82, 60)
    rows = [(1, a, "p"), (5, a, "q"), (5, b, "r"), (7, x, "s"), (7, x, "s"), (9, x, "u"), (7, x, "t"), (None, a, "v"), (None, a, "v"), (11, "", "w"), (12, None, "y")]
    docs = spark.createDataFrame([(i, t, c, 0, 0) for i, t, c in rows], "doc_id bigint, text string, t string, row int, `least.t` int")
    got = simhash.one_of_each(docs.repartition(3))
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"] or "", r["t"]) for r in got.collect())
    assert [k for k in kept if k[0] != 7] == sorted([(0, a, "v"), (0, a, "v"), (1, a, "p"), (5, b, "r"), (11, "", "w")])
    assert [k[:2] for k in kept if k[0] == 7] == [(7, x)]
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def plan_nodes(plan):
    """The nodes of an executed plan, through adaptive stages."""
    yield plan
    inner = "executedPlan" if plan.nodeName() == "AdaptiveSparkPlan" else "plan" if plan.nodeName().endswith("QueryStage") else ""
    if inner:
        yield from plan_nodes(getattr(plan, inner)())
    for i in range(plan.children().size()):
        yield from plan_nodes(plan.children().apply(i))


def test_one_of_each_sends_no_text_that_stays(spark):
    texts = [prose(3000 + k, 30) for k in range(150)]
    docs = documents(spark, texts + texts[:5])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on a corpus whose lists are long
    try:
        found = simhash.one_of_each(docs)
        assert sorted(r["doc_id"] for r in found.collect()) == list(range(150))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    nodes = list(plan_nodes(found._jdf.queryExecution().executedPlan()))
    dealt = [p for p in nodes if p.nodeName() == "Exchange" and re.search(r"\b(row|text)#", p.output().mkString(","))]
    assert dealt
    assert sum(p.metrics().apply("shuffleRecordsWritten").value() for p in dealt) <= 10


# -- pages ---------------------------------------------------------------------------

PAGES = [
    (0, "https://A.Example.NET/en/1?x", None), (1, "http://example.net", ""), (2, "http://example.net/fr/", ""), (3, "http://x.org/fr/a#b", ""), (4, None, ""), (5, "no scheme", ""),
    (6, "http://www.example.com/de/1", ""), (7, "http://alias.org/one", '<link rel="canonical" href="http://www.example.com/de/1">'),
    (8, "http://alias.org/two", "<LINK HREF='/one' REL='canonical'>"), (9, "http://alias.org/three", '<meta http-equiv="refresh" content="0; url=http://example.net/en/ok">'),
    (10, "http://alias.org/four", '<link rel="canonical" href="//alias.org/three">'), (11, "http://other.org/five", '<link rel="canonical" href="http://bad.net/x">'),
    (12, "http://other.org/six", '<link rel="canonical" href="http://other.org/five">'), (13, "http://other.org/six", ""), (14, "http://mixed.org/a", '<link rel="canonical" href="http://bad.net/x">'),
    (15, "http://mixed.org/b", '<link rel="canonical" href="http://c.org/fr/z">'), (16, "http://mixed.org/b", '<link rel="canonical" href="http://mixed.org/d">'),
    (17, "http://mixed.org/d", '<link rel="canonical" href="http://worse.net/y">'), (18, "http://notexample.net:80/en/", ""),
]


def test_url_filter(spark):
    import duckdb
    import pandas as pd

    pages = spark.createDataFrame([(*p, 3) for p in PAGES], "page_id bigint, url string, html string, host int")
    got = {r["page_id"]: r for r in url_filter.url_filter(pages).collect()}
    verdict = {i: (r["rule"], r["verdict"]) for i, r in got.items()}
    assert got[0]["host"] == "a.example.net" and got[0]["path"] == "/en/1" and (got[4]["host"], got[5]["path"]) == ("", "")
    assert verdict[0] == ("example.net/en/", "allow") and verdict[1] == (None, "allow") and verdict[2] == ("net/", "block") and verdict[3] == ("org/fr/", "allow")
    assert verdict[6] == ("example.com/de/", "block") and verdict[7] == verdict[8] == (None, "block")
    assert verdict[9] == verdict[10] == (None, "allow")
    assert [verdict[i][1] for i in (11, 12, 13, 14)] == ["block"] * 4
    assert [verdict[i][1] for i in (15, 16, 17)] == ["allow"] * 3 and verdict[18] == (None, "allow")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([p for p in PAGES], columns=["page_id", "url", "html"]))
    assert sorted(con.sql(ORACLE["op2_url_filter"]).fetchall(), key=repr) == sorted((tuple(got[i][c] for c in ("page_id", "host", "path", "rule", "verdict", "by")) for i in got), key=repr)


def test_every_link_of_a_page_is_resolved(spark):
    from urllib.parse import urljoin, urlsplit

    link = '<link rel="canonical" href="%s">'
    targets = ["new.html", "../a", "page/2", "./x/./y", "../../../up", "..", "?q=1", "#top", "/login?next=http://bad.net/x", "/c/../d/.", "//Other.org/e/f", "http://third.org/g?h", "a/../../b?x=/../z"]
    bases = ["http://site.org/one/two/three", "http://site.org/one/two/", "http://site.org"]
    pages = [(i, base, link % t) for i, (base, t) in enumerate((b, t) for b in bases for t in targets)] + [(99, bases[0], link % "mailto:x@y.org")]
    want = set()
    for _, base, html in pages[:-1]:
        at = urlsplit(base), urlsplit(urljoin(base, html[len(link) - 4 : -2]))
        a, b = (x.netloc.lower() + x.path + ("?" + x.query) * bool(x.query) for x in at)
        want |= {(a, b)} - {(a, a)}
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert {tuple(r) for r in url_filter.alias_edges(frame).collect()} == want

    rows = [
        (0, "http://www.example.com/de/1", link % "../alias/page.html"), (1, "http://www.example.com/alias/page.html", ""),
        (2, "http://many.org/a", link % "first" + link % "http://bad.net/x" + "<META HTTP-EQUIV=Refresh CONTENT='0; URL=p'><meta http-equiv=refresh content='1; url=q'>"),
        (3, "http://many.org/first", ""), (4, "http://many.org/p", ""), (5, "http://many.org/q", ""), (6, "http://many.org/r", "<link rel=CaNoNiCaL href=q>"), (7, "http://many.org/s", ""),
    ]
    rows += [
        (8, "http://ask.org/a?id=1", link % "http://bad.net/x"), (9, "http://ask.org/a?id=2", ""), (10, "http://ask.org/a?id=1#part", ""), (11, "http://ask.org/a", ""),
        (12, "http://ask.org/b", "<meta content='0; url=http://bad.net/z' http-equiv='refresh'>"), (13, "http://ask.org/c", link % "?x=1&amp;y=2"), (14, "http://ask.org/c?x=1&y=2", link % "//bad.net/"),
        (15, "http://ask.org/d", ""), (16, "http://ask.org/d", ""),
    ]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_filter(frame).collect()}
    assert got == {i: "allow" if i in (7, 9, 11, 15, 16) else "block" for i in range(17)}
    for every in (rows, [(100 + i, u, h) for i, u, h in pages]):
        same_as_duckdb(spark, every)
    assert url_filter.url_filter(frame.limit(0)).collect() == []


def same_as_duckdb(spark, rows):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    columns = ("page_id", "host", "path", "rule", "verdict", "by")
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE['op2_url_filter']})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)


# -- models --------------------------------------------------------------------------


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney by its definition."""
    padded = [chr(2) * (order - 1) + t for t in texts]
    counts = {order: Counter(t[i : i + order] for t in padded for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, total, types = {}, {}, {}
    for k, c in counts.items():
        n = [max(1, sum(v == i for v in c.values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        cut[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) for i in (1, 2, 3)]
        total[k], types[k] = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[k][g[:-1]] += v
            types[k][g[:-1]] += cut[k][min(v, 3) - 1]
    size = len(counts[1]) + 1

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / size
        context = gram[:-1]
        if not total[k][context]:
            return p(gram[1:])
        v = counts[k][gram]
        share = (v - cut[k][min(v, 3) - 1]) / total[k][context] if v else 0
        return share + types[k][context] / total[k][context] * p(gram[1:])

    return p


@pytest.mark.parametrize("hot", [4_000_000, 300, 0])
def test_kneser_ney_equals_its_definition(spark, hot):
    trusted = [prose(i, 40) for i in range(6)] + ["a", None, ""]
    others = [prose(3, 20), "ZZZ 999 %%%", "é\U0001f600", "", None, prose(3, 20)]
    p = plain_model([t for t in trusted if t], perplexity.ORDER)
    model = perplexity.fit(documents(spark, trusted))
    docs = documents(spark, others).withColumn("lang", F.when(F.col("doc_id") == 5, None).otherwise(F.col("lang")))
    got = {r["doc_id"]: r for r in perplexity.log_perplexities(docs, model, hot).collect()}
    for i, t in enumerate(others[:5]):
        n = perplexity.ORDER
        padded = chr(2) * (n - 1) + "".join(min(c, "￿") for c in t or "")
        want = sum(math.log(p(padded[k : k + n])) for k in range(len(padded) - n + 1))
        assert got[i]["total"] == pytest.approx(want, rel=1e-4, abs=1e-6)
    assert got[5]["total"] == 0 and len(got) == len(others)


def test_broadcast_entries_take_little_of_the_driver(spark):
    """Entries reach the driver packed, in runs, and not as rows that each name their language."""
    n = 300_000
    entries = spark.range(n, numPartitions=3).select(F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"), F.lit(5).alias("kind"), F.xxhash64("id").alias("k"), (1 / (F.col("id") + 2)).alias("v"), F.lit(2).cast("bigint").alias("c"))
    model = entries.localCheckpoint()
    tracemalloc.start()
    try:
        got = perplexity.log_perplexities(documents(spark, ["abc", None]), model).collect()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 50 * n and sorted(r["n_chars"] for r in got) == [0, 3]
    hot = perplexity.Hot(perplexity.runs(model).toArrow(), None)
    assert sorted((g, len(k), len(v)) for g, (k, v) in hot.tables.items()) == [(("de", 5), n * 2 // 3, n * 2 // 3), (("en", 5), n // 3, n // 3)]
    for lang, kind, k, v in model.filter("lang = 'en'").limit(2000).select("lang", "kind", "k", "v").collect():
        hit, value = hot.find(lang, kind, np.array([k]).view(np.uint64))
        assert hit[0] and value[0] == pytest.approx(math.log(v), rel=1e-6)
    assert perplexity.Hot(perplexity.runs(model.limit(0)).toArrow(), None).tables == {}


def test_classifier_of_odd_tables(spark):
    docs = documents(spark, [None, "", prose(1, 50), prose(1, 50), prose(2, 60_000, 400)]).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (3, 0, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in perplexity.quality_classifier(docs, labels).collect()}
    assert len(got) == 5 and not got[0]["kept"] and not got[1]["kept"] and got[0]["perplexity"] is None
    assert got[2]["perplexity"] == got[3]["perplexity"] and got[4]["n_chars"] > 100_000
    none = perplexity.quality_classifier(docs, labels.limit(0)).collect()
    assert [r["kept"] for r in sorted(none, key=lambda r: r["doc_id"])] == [False, False, True, True, True]
    assert perplexity.quality_classifier(docs.limit(0), labels).collect() == []


def test_classifier_keeps_held_out_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = perplexity.quality_classifier(docs, labels).join(labels, "doc_id")
    rates = {r["quality"]: r["k"] for r in got.filter("toxic = 0").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.1


def plain_rates(p, n, goal, near_one, steps=200_000):
    """Least squares from 1 by plain projected gradient, no momentum, until nothing moves."""
    mass, rate = n @ p / n.sum(), np.ones(len(p))
    for _ in range(steps):
        e = ((n * rate) @ p / n.sum() - goal) / mass
        new = np.maximum(0, rate - (p @ e + near_one * (rate - 1)) / (1 + near_one))
        if np.abs(new - rate).max() < 1e-12:
            break
        rate = new
    return rate


@pytest.mark.parametrize("replayed", [mixing.REPLAYED, 3])
def test_mixing_equals_a_plain_solver(spark, monkeypatch, replayed):
    monkeypatch.setattr(mixing, "REPLAYED", replayed)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.union(spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0)], docs.schema))
    clash = labels.union(labels.limit(3).selectExpr("doc_id", "1 - quality as quality", "1 as toxic")).union(spark.createDataFrame([(None, 0, 1)], labels.schema))
    targets = mixing.Targets(within=1e-9)
    rows = mixing.mix(docs, clash, targets).collect()
    p = np.array([[r[c] for c in mixing.SHARES] for r in rows])
    n, rate = (np.array([r[c] for r in rows], float) for c in ("n_tokens", "rate"))
    assert len(rows) == docs.count() and (rate >= 0).all() and np.allclose(p.sum(1), 1)
    plain = plain_rates(p, n, np.array(targets.shares), targets.near_one)
    share, wanted = ((n * r) @ p / n.sum() for r in (rate, plain))
    assert share == pytest.approx(wanted, rel=0.005)
    assert rate == pytest.approx(plain, abs=0.05)


def test_mixed_documents_carry_any_columns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(["copies", "state", "row", "m", "a.b", "rate"])})
    got = mixing.mixed_documents(docs, labels)
    assert got.columns == docs.columns and got.select("copies", "state", "row", "m", "`a.b`", "rate").distinct().collect() == [(0, 1, 2, 3, 4, 5)]
    clean = labels.filter("quality = 1 and toxic = 0").join(docs, "doc_id").filter("n_chars > 400").select("doc_id")
    assert clean.join(got, "doc_id", "left_anti").count() <= 0.02 * clean.count()


@pytest.mark.parametrize("shares", [None, (0.97, 0.02, 0.01), (0.85, 0.14, 0.01)])
def test_mixing_meets_rare_targets_as_production_fits_them(spark, shares):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    targets = mixing.Targets(shares=shares) if shares else mixing.Targets()
    rows = mixing.mix(docs, labels, targets).collect()
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    n, rate = (np.array([r[c] for r in rows], float) for c in ("n_tokens", "rate"))
    share = (n * rate) @ p / n.sum()
    assert (rate >= 0).all() and share == pytest.approx(targets.shares, rel=0.005)


def test_mixing_of_nothing(spark):
    docs = documents(spark, [])
    assert mixing.mix(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []
    rows = mixing.mix(documents(spark, ["a b", None]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert [r["rate"] for r in rows] == pytest.approx([1, 1], abs=0.7)


# -- pipeline ------------------------------------------------------------------------


def test_pipeline_stages(spark):
    good = [" ".join(w.capitalize() + "." if k % 12 == 11 else w for k, w in enumerate(prose(i, 120, 300).split())) + "." for i in range(12)]
    leak = good[1] + ' password: "hunter2hunter2".'
    near = good[2].replace(good[2].split()[50], "altered", 1)
    texts = [*good, good[0], near, leak + " x.", None, "", "too short.", "OF!! IT!! " * 60, "a b c " * 60, good[3].replace(" ", "\n", 1)]
    docs = documents(spark, texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        found = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_rules":
            expected = {i: quality_rules.judge(t)[9] for i, t in enumerate(texts) if quality_rules.judge(t)[6]}
            assert found == expected and set(range(12)) <= set(found) and not {15, 16, 17, 18, 19} & set(found)
        elif name == "near_duplicates":
            assert set(range(12)) - {1} <= set(found) and not {12, 13} & set(found)
        elif name == "secret_scan":
            model = secret_scan.train(secret_scan.labelled_samples())
            assert all(not secret_scan.base_spans(t) for t in found.values())
            assert found == {r["doc_id"]: secret_scan.redact(r["text"], model) for r in docs.collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = sorted((r["doc_id"], len(library.encode(r["text"], add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in encoded) == left
