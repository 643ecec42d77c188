"""Every operator and stage over empty tables, nulls, very long texts, repeated rows and clashing columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from meterlake.llm import bpe, flac, mixing, perplexity, quality_rules, secret_scan, simhash, suffix_dedup, token_files

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LABELS = "doc_id bigint, quality int, toxic int"
#: Names that operators use inside.
CLASHES = ["row", "key", "state", "n_tokens", "ids", "component", "node", "t", "mark", "f0", "m0", "least", "hash", "total", "copies", "bytes", "k5", "media", "n_words", "span"]

OPERATORS = {
    "bpe": lambda spark, docs: bpe.bpe_digests(docs, WORD),
    "perplexity": lambda spark, docs: perplexity.quality_classifier(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)),
    "secret_scan": lambda spark, docs: secret_scan.secret_scan(docs),
    "flac": lambda spark, docs: flac.stored_features(docs),
    "simhash": lambda spark, docs: simhash.near_duplicates(docs),
    "mixing": lambda spark, docs: mixing.mix(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)),
    "suffix_dedup": lambda spark, docs: suffix_dedup.suffix_dedup(docs),
    "token_files": lambda spark, docs: token_files.token_files(docs, BYTE, 2),
    "quality_rules": lambda spark, docs: quality_rules.quality_rules(docs),
}


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    long = " ".join(f"word{i}" for i in rng.integers(0, 200_000, 300_000).tolist())  # three million characters
    return [None, "", " ", "one", long, "a b c d e f", "a b c d e f", "x" * 200_000, "é" * 3000]


def table(spark, texts):
    ids = [0, 1, 2, 2, 4, 5, 5, None, 8]
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts)] + [(5, "a b c d e f", "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, texts, name):
    docs = table(spark, texts)
    got = OPERATORS[name](spark, docs).collect()
    assert len(got) == docs.count()
    by_id = Counter(r["doc_id"] for r in got)
    assert by_id == Counter([0, 1, 2, 2, 4, 5, 5, 5, None, None, 8])
    equal = {tuple(v for c, v in r.asDict().items() if c != "start") for r in got if r["doc_id"] == 5}
    assert len(equal) == 1  # equal rows, equal results
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_in_a_stage(spark, texts, name, stage):
    docs = table(spark, texts)
    out = stage(spark, docs, SF)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.select(*CLASHES).distinct().collect() in ([tuple(range(len(CLASHES)))], [])
    out.collect()
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_long_texts_encode_as_the_library_does(spark, texts):
    docs = table(spark, texts).filter("doc_id = 4")
    for path, rows in ((WORD, bpe.bpe_digests(docs, WORD).collect()), (BYTE, token_files.token_files(docs, BYTE, 2).collect())):
        want = len(Tokenizer.from_file(path).encode(texts[4], add_special_tokens=False).ids)
        assert rows[0]["n_tokens"] == want + (path == BYTE)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return f"{bits:016x}"


def test_fingerprints_equal_their_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(150)
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "One"), (-4, "A b\tA  b A b"), (-5, "É É ÉÀ x")], docs.schema))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == prints
    group = {i: i for i in prints}  # components by all pairs
    for a in prints:
        for b in prints:
            if (int(prints[a], 16) ^ int(prints[b], 16)).bit_count() <= 3 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert {i: r["component_id"] for i, r in got.items()} == group


def test_documents_are_drawn_as_their_rates_say(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    targets = mixing.Targets(shares=(0.97, 0.02, 0.01))
    drawn = Counter(r["doc_id"] for r in mixing.mixed_documents(docs, labels, targets).select("doc_id").collect())
    scored = mixing.stored(mixing.scored(docs, mixing.train(docs.select("doc_id", "text"), labels)), "scored")
    n, clean = scored.agg(F.sum("m.n_tokens"), F.sum(F.col("m.n_tokens") * F.col("m.p_clean"))).first()
    rates = {r["doc_id"]: r["rate"] for r in mixing.fitted(scored, targets, max(1.0, clean / n / 0.97)).select("row.doc_id", "state.rate").collect()}
    assert set(drawn) <= set(rates)
    assert all(int(x + 1e-3) <= drawn[i] <= int(x + 1e-3) + 1 for i, x in rates.items())
    assert sum(drawn.values()) == pytest.approx(sum(rates.values()), rel=0.1)


def test_damaged_streams_are_refused(spark):
    payload = flac.payload_of("some text " * 300)[1]
    stream = flac.encode([payload])[0]
    assert hashlib.sha256((flac.decode([stream])[0] + 128).astype(np.uint8).tobytes()).digest() == hashlib.sha256(payload).digest()
    with pytest.raises(ValueError):
        flac.decode([stream[:-1]])
