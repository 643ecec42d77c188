"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged over, so
a word is cut there; the fragments are encoded independently, many at a time,
and their ids concatenated. Words are cut at ASCII white space first, which no
rule of the tokenizer file looks across.

Defined cases: a null text counts as empty and gives no ids; a character run of
any length is encoded whole (long fragments use a heap); equal texts give equal
rows; other columns of the input are passed over.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from array import array
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import map_rows, remembers

#: Bytes of words that a worker remembers before it starts anew, and of text that it encodes at once.
REMEMBERED = 48 << 20
AT_ONCE = 1 << 20
#: What an entry of a memory takes besides its key's and value's own bytes.
ENTRY = 200
#: Longer fragments are encoded one by one.
LONG = 64
#: Marks that close a run of letters and form one word of their own.
CLOSING = b".,;:!?*#$%&)"
#: The rank of a pair that no merge joins.
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class ForcedBoundaryBPE:
    """Encoder and decoder for one tokenizers JSON file with a BPE model."""

    path: str
    words: dict[bytes, bytes] = field(default_factory=dict)
    parts: dict[bytes, bytes] = field(default_factory=dict)
    remembered: int = 0
    fragments: dict[tuple[bytes, bool], bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.library = Tokenizer.from_file(self.path)
        spec = json.load(open(self.path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.byte_of = byte_of
        self.first = [vocab.get(c, -1) for c in symbols]
        self.last = [vocab.get(c + self.suffix, -1) for c in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        order = sorted(self.merges)
        self.pair_keys = np.array([a << 32 | b for a, b in order], np.int64)
        self.pair_ranks = np.array([self.merges[p][0] for p in order], np.int32)
        self.pair_ids = np.array([self.merges[p][1] for p in order], np.int32)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lowers = kinds == ["NFC", "Replace", "Lowercase"] and bool(self.suffix)
        #: inside[x * 256 + y]: some token holds x before y, y not closing a word; closing: y closes it.
        self.inside, self.closing = bytearray(65536), bytearray(65536)
        for token in vocab:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            raw = [byte_of[c] for c in (token[: -len(self.suffix)] if ends else token) if c in byte_of]
            for i in range(len(raw) - 1):
                pairs = self.closing if ends and i == len(raw) - 2 else self.inside
                pairs[raw[i] * 256 + raw[i + 1]] = 1
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token

    def cut(self, word: bytes) -> list[bytes]:
        """The fragments between forced boundaries."""
        inside, n, start, out = self.inside, len(word), 0, []
        for i, pair in enumerate(zip(word, word[1:]), 1):
            if not (self.closing if i == n - 1 and self.suffix else inside)[pair[0] * 256 + pair[1]]:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """Apply the lowest-ranked, leftmost merge until none is left, by a heap over a linked list."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merges[(a, b)][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where no merge exists) and merged ids of many pairs."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], NONE), self.pair_ids[at]

    def merge_many(self, ids: np.ndarray) -> np.ndarray:
        """The same for rows of ids, padded by -1 on the right: one merge of each row a round."""
        n, width = ids.shape
        ranks, merged = (x.reshape(n, -1) for x in self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        pad = np.full((n, 1), NONE, ranks.dtype)
        ranks, merged = np.hstack([ranks, pad]), np.hstack([merged, pad])
        live, column = np.arange(n), np.arange(width)
        cur, done = ids, ids.copy()
        while True:
            at = ranks.argmin(1)
            rows = np.arange(len(cur))
            go = ranks[rows, at] < NONE
            if not go.all():
                done[live[~go]] = cur[~go]
                live, cur, ranks, merged, at = live[go], cur[go], ranks[go], merged[go], at[go]
                rows = np.arange(len(cur))
            if not len(live):
                return done
            cur[rows, at] = merged[rows, at]
            take = column + (column > at[:, None])
            last = take == width
            take[last] = width - 1
            cur, ranks, merged = (np.take_along_axis(x, take, 1) for x in (cur, ranks, merged))
            cur[last], ranks[last] = -1, NONE
            for p, ok in ((at, at < width - 1), (at - 1, at > 0)):
                r, q = rows[ok], p[ok]
                ranks[r, q], merged[r, q] = self.rank(cur[r, q], cur[r, q + 1])

    def start_ids(self, raw: bytes, closes: bool) -> list[int]:
        ids = [self.first[b] for b in raw]
        if closes:
            ids[-1] = self.last[raw[-1]]
        return ids

    def learn(self, fragments: set[tuple[bytes, bool]]) -> None:
        """Encode fragments that are not remembered, those of about equal length at once."""
        by_width: dict[int, list[tuple[bytes, bool]]] = {}
        for key in fragments:
            by_width.setdefault(-(-len(key[0]) // 4) * 4 if len(key[0]) > 1 else 1, []).append(key)
        for width, keys in by_width.items():
            if width == 1 or width > LONG:
                for key in keys:
                    ids = self.start_ids(*key)
                    self.fragments[key] = array("I", self.merge_long(ids) if width > 1 else ids).tobytes()
                continue
            rows = np.full((len(keys), width), -1, np.int32)
            first = np.asarray(self.first, np.int32)
            lengths = np.fromiter((len(k[0]) for k in keys), np.int64, len(keys))
            flat = np.frombuffer(b"".join(k[0] for k in keys), np.uint8)
            rows[np.arange(width) < lengths[:, None]] = first[flat]
            closes = np.fromiter((k[1] for k in keys), bool, len(keys))
            ends = np.cumsum(lengths) - 1
            rows[closes, lengths[closes] - 1] = np.asarray(self.last, np.int32)[flat[ends[closes]]]
            rows = self.merge_many(rows)
            sizes = (rows >= 0).sum(1) * 4
            packed, stop = rows[rows >= 0].astype("<u4").tobytes(), np.cumsum(sizes).tolist()
            start = 0
            for key, end in zip(keys, stop):
                self.fragments[key] = packed[start:end]
                start = end

    def pieces(self, text: str) -> list[bytes]:
        """Byte words of a stretch without special tokens, by the file's normalizer and pre-tokenizer."""
        norm, byte_of = self.library.normalizer, self.byte_of
        found = self.library.pre_tokenizer.pre_tokenize_str(norm.normalize_str(text) if norm else text)
        return [bytes([byte_of[c] for c in piece]) for piece, _ in found]

    def parts_of(self, raw: bytes) -> list:
        """Byte words and special ids of one run of non-space bytes.

        A run of Latin letters is one word to the pre-tokenizer, only lower-cased by
        the normalizer, with or without closing marks; all else goes through the library.
        """
        if self.lowers:
            body = raw.rstrip(CLOSING)
            if body.isascii():
                plain, lower = body.isalpha(), body.lower()
            else:
                text = body.decode("utf-8")
                plain, lower = text.isalpha() and max(text) < "\u0250" and "\u0130" not in text, b""
                lower = text.lower().encode() if plain else b""
            if plain:
                return [lower] if len(body) == len(raw) else [lower, raw[len(body) :]]
        spans: list = [(raw.decode("utf-8"), None)]
        for content, i in self.special.items():
            spans = [y for s, k in spans for y in ([(s, k)] if k is not None else self.split_at(s, content, i))]
        return [w for s, k in spans for w in ([k] if k is not None else self.pieces(s))]

    def forced(self, words: list[bytes]) -> set[int]:
        """Places in the list of the words that hold a forced boundary."""
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        inner = np.frombuffer(bytes(self.inside), np.uint8)
        last = np.frombuffer(bytes(self.closing), np.uint8) if self.suffix else inner
        pair = flat[:-1] * 256 + flat[1:]
        free = inner[pair] == 0
        closing = ends[ends > 1] - 2
        free[closing] = last[pair[closing]] == 0
        free[ends[:-1] - 1] = False
        return set(np.searchsorted(ends, np.flatnonzero(free), "right").tolist())

    def remember(self, texts: list[list[bytes]]) -> None:
        """Encode the words of a batch that are not known yet."""
        if self.remembered > REMEMBERED:
            self.words.clear(), self.parts.clear()
            self.remembered = 0
        parts = {raw: self.parts_of(raw) for raw in set().union(*texts).difference(self.words)}
        new = list({x for p in parts.values() for x in p if x.__class__ is bytes}.difference(self.parts))
        if new:
            forced = self.forced(new)
            cuts = [self.cut(w) if k in forced else [w] for k, w in enumerate(new)]
            self.learn({(x, False) for c in cuts for x in c[:-1]} | {(c[-1], True) for c in cuts} - self.fragments.keys())
            known = self.fragments
            for w, c in zip(new, cuts):
                self.parts[w] = known[w, True] if len(c) == 1 else b"".join([*(known[x, False] for x in c[:-1]), known[c[-1], True]])
                self.remembered += len(w) + len(self.parts[w]) + ENTRY
            known.clear()  # whole words are remembered
        known = self.parts
        for raw, p in parts.items():
            if len(p) == 1 and p[0].__class__ is bytes:
                self.words[raw] = known[p[0]]
            else:
                self.words[raw] = b"".join([known[x] if x.__class__ is bytes else x.to_bytes(4, "little") for x in p])
            self.remembered += len(raw) + len(self.words[raw]) + ENTRY

    @staticmethod
    def split_at(text: str, content: str, i: int) -> list[tuple[str, int | None]]:
        out: list[tuple[str, int | None]] = []
        for k, part in enumerate(text.split(content)):
            if k:
                out.append(("", i))
            if part:
                out.append((part, None))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, for a batch of bounded size."""
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        collects = gc.isenabled()
        gc.disable()  # nothing cyclic is made, and passes over the memory are slow
        try:
            self.remember(split)
        finally:
            if collects:
                gc.enable()
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def decode(self, packed: bytes) -> str:
        """The file names no decoder, so the library joins tokens by a space."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


@lru_cache(2)
def encoder(path: str) -> ForcedBoundaryBPE:
    """One encoder per worker process; its memory outlives a task."""
    remembers(__name__, encoder.cache_clear)
    return ForcedBoundaryBPE(path)


def bpe_encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (binary, unsigned 32-bit little-endian) of every whole text."""

    def run(ids: list, texts: list) -> dict[str, list]:
        return {"doc_id": ids, "ids": encoder(path).encode_batch(texts)}

    return map_rows(docs, [id_col, text_col], run, "doc_id bigint, ids binary", AT_ONCE)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``text`` from :func:`bpe_encode`'s rows."""

    def run(ids: list, packed: list) -> dict[str, list]:
        decode = encoder(path).decode
        return {"doc_id": ids, "text": [decode(p or b"") for p in packed]}

    return map_rows(encoded, ["doc_id", "ids"], run, "doc_id bigint, text string", AT_ONCE)


def bpe_digests(docs: DataFrame, path: str, *, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass over the text; digests of both ways."""

    def run(ids: list, texts: list) -> dict[str, list]:
        bpe = encoder(path)
        packed = bpe.encode_batch(texts)
        out = {
            "doc_id": ids,
            "n_tokens": [len(p) // 4 for p in packed],
            "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
            "decoded_sha256": [hashlib.sha256(bpe.decode(p).encode()).hexdigest() for p in packed],
        }
        return out | ({"ids": packed} if with_ids else {})

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs, [id_col, text_col], run, schema + ", ids binary" * with_ids, AT_ONCE)
