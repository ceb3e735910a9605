"""Byte-level BPE encoding in two tiers, and decoding.

A text is cut into pre-tokens by a pattern. Tier one looks whole pre-tokens up in a minimal perfect
hash over the vocabulary (one displacement per bucket, one slot per entry, no empty slot), for all
new pre-tokens of a batch at once. Tier two merges what is not in the vocabulary: a linked list of
the pre-token's bytes and a heap of its adjacent pairs by (rank, place), so a pre-token of n bytes
takes n log n steps. Results are kept per task for repeated pre-tokens, in a cache of bounded size.

The vocabulary file is read on the driver and broadcast; its size does not depend on the corpus.
Null and empty texts have no tokens. Special tokens are ordinary text. Every row is encoded on its
own: repeated rows, ids and extra columns do not matter, and no row meets another.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.shared import PASS_BYTES, mix, text_chunks

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Entries of each of the two generations of a task's cache of pre-tokens (about 200 bytes each, in every
#: worker), and characters of the longest pre-token it keeps.
CACHE_ENTRIES = 100_000
CACHE_CHARS = 64
#: Pre-tokens of one text that are held at a time.
PIECES = 200_000


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Token bytes by rank; the file has a line of base64 and rank for each."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _key_hashes(keys: list[bytes], seed: int) -> np.ndarray:
    """64-bit hashes of byte strings, all at once: eight bytes of each at a time."""
    lengths = np.fromiter((len(k) for k in keys), np.int64, len(keys))
    hashes = mix(lengths.astype(np.uint64) + np.uint64(seed))
    order = np.argsort(lengths, kind="stable")
    hashes = hashes[order]
    sorted_keys = [keys[i] for i in order.tolist()]
    sorted_lengths = lengths[order]
    for start in range(0, int(lengths.max(initial=0)), 8):
        first = int(np.searchsorted(sorted_lengths, start, side="right"))
        if first == len(keys):
            break
        words = b"".join(k[start : start + 8].ljust(8, b"\0") for k in sorted_keys[first:])
        hashes[first:] = mix(hashes[first:] * np.uint64(0x9E3779B97F4A7C15) + np.frombuffer(words, "<u8"))
    out = np.empty_like(hashes)
    out[order] = hashes
    return out


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: `slots(keys)` are their places, or some place.

    Keys fall into buckets; each bucket has a displacement under which its keys take free slots.
    A bucket of one key names its slot itself. Strings that are no keys get any slot, so the caller
    compares the key kept there.
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // 4)
        for seed in range(16):
            self.seed = seed
            if self._place(_key_hashes(keys, seed)):
                return
        raise ValueError("keys are not distinct")

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(32)) % np.uint64(self.buckets)

    def _slot(self, hashes: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        return mix(hashes + displacement * np.uint64(0xD1B54A32D192ED03)) % np.uint64(self.size)

    def _place(self, hashes: np.ndarray) -> bool:
        if len(np.unique(hashes)) < self.size:
            return False
        self.displacement = np.zeros(self.buckets, np.int64)
        self.entry = np.zeros(self.size, np.int64)
        bucket = self._bucket(hashes).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        stops = np.cumsum(counts)
        taken = np.zeros(self.size, bool)
        tries = np.arange(64, dtype=np.uint64)[:, None]
        for b in np.argsort(-counts, kind="stable").tolist():
            members = order[stops[b] - counts[b] : stops[b]]
            if len(members) < 2:
                break
            for base in range(0, 1 << 20, 64):
                slots = self._slot(hashes[members][None, :], tries + np.uint64(base)).astype(np.int64)
                free = ~taken[slots].any(axis=1)
                if len(members) > 1:
                    ranked = np.sort(slots, axis=1)
                    free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if free.any():
                    pick = int(free.argmax())
                    self.displacement[b] = base + pick
                    taken[slots[pick]] = True
                    self.entry[slots[pick]] = members
                    break
            else:
                return False
        single = np.flatnonzero(counts == 1)
        left = np.flatnonzero(~taken)
        self.displacement[single] = -1 - left
        self.entry[left] = order[stops[single] - 1]
        return True

    def entries(self, keys: list[bytes]) -> np.ndarray:
        """For each string the number of the only key that it can be."""
        hashes = _key_hashes(keys, self.seed)
        moved = self.displacement[self._bucket(hashes).astype(np.int64)]
        slots = self._slot(hashes, np.maximum(moved, 0).astype(np.uint64)).astype(np.int64)
        return self.entry[np.where(moved < 0, -1 - moved, slots)]


def pair_ranks(ranks: dict[bytes, int]) -> list[int]:
    """The rank of each pair of bytes, at 256 * first + second; -1 where they make no token."""
    return [ranks.get(bytes((i >> 8, i & 255)), -1) for i in range(1 << 16)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Token ids of a pre-token: always the adjacent pair of least rank is joined, leftmost first.

    A heap entry is one number, (rank, start, stop) in base `size + 1`; it counts if the part at
    start and the one after it still end at stop.
    """
    size = len(piece)
    base = size + 1
    end = list(range(1, base))  # of the part that starts here; 0 once it is joined to the left
    before = list(range(-1, size - 1))  # start of the part before
    heap = [
        (rank * base + i) * base + i + 2
        for i, (first, second) in enumerate(itertools.pairwise(piece))
        if (rank := pairs[first << 8 | second]) >= 0
    ]
    heapq.heapify(heap)
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    while heap:
        rest, stop = divmod(pop(heap), base)
        left = rest % base
        right = end[left]
        if not right or right >= size or end[right] != stop:
            continue
        end[left] = stop
        end[right] = 0
        if stop < size:
            before[stop] = left
            after = end[stop]
            rank = get(piece[left:after])
            if rank is not None:
                push(heap, (rank * base + left) * base + after)
        if left:
            earlier = before[left]
            rank = get(piece[earlier:stop])
            if rank is not None:
                push(heap, (rank * base + earlier) * base + stop)
    out, i = [], 0
    while i < size:
        stop = end[i]
        out.append(ranks[piece[i:stop]])
        i = stop
    return out


class Encoder:
    """Encoding and decoding by one vocabulary; a worker keeps one per task."""

    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str = PATTERN):
        self.tokens, self.table = tokens, table
        self.pattern = regex.compile(pattern)
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.pairs = pair_ranks(self.ranks)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _resolve(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit integers, of pre-tokens that are not cached."""
        raw = [p.encode() for p in pieces]
        out = {}
        tokens, ranks, pairs = self.tokens, self.ranks, self.pairs
        for text, piece, entry in zip(pieces, raw, self.table.entries(raw).tolist(), strict=True):
            ids = [entry] if tokens[entry] == piece else merge_bytes(piece, ranks, pairs)
            out[text] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if len(text) < PIECES:
            return self._encoded([self.pattern.findall(text)])[0]
        found = (m.group() for m in self.pattern.finditer(text))
        parts = iter(lambda: list(itertools.islice(found, PIECES)), [])
        return b"".join(self._encoded([part])[0] for part in parts)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of each text; short ones are looked up together."""
        short = [t if len(t) < PIECES else "" for t in texts]
        out = self._encoded([self.pattern.findall(t) for t in short])
        return [ids if len(t) < PIECES else self.encode(t) for t, ids in zip(texts, out, strict=True)]

    def _encoded(self, texts: list[list[str]]) -> list[bytes]:
        missing = set().union(*texts).difference(self.known)
        extra: dict[str, bytes] = {}
        if missing:
            if len(self.known) + len(missing) > CACHE_ENTRIES:
                # what was used lately stays for one more generation
                self.older, self.known = self.known, {}
                missing = set().union(*texts)
            back = {p: self.older[p] for p in missing if p in self.older}
            fresh = back | self._resolve(list(missing.difference(back)))
            extra = {p: ids for p, ids in fresh.items() if len(p) > CACHE_CHARS}
            self.known.update(fresh)
        known = self.known
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in texts]
        for p in extra:  # long pre-tokens are not kept
            del known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _shared_encoder(spark: SparkSession, path: str):
    tokens = read_vocabulary(path)
    return spark.sparkContext.broadcast((tokens, PerfectHash(tokens)))


def encode_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    shared = _shared_encoder(documents.sparkSession, path)

    def encode(batches):
        encoder = Encoder(*shared.value)
        for piece in text_chunks(batches, size=PASS_BYTES):
            ids = encoder.encode_all([t or "" for t in piece.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"]
            )

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")


def decode_tokens(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, data): the bytes that each row's ids stand for; null ids stand for none."""
    shared = _shared_encoder(tokens.sparkSession, path)

    def decode(batches):
        encoder = Encoder(*shared.value)
        for batch in batches:
            data = [encoder.decode(np.array(i or [], "<u4").tobytes()) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"]
            )

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, data binary")


def encode_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded again."""
    shared = _shared_encoder(documents.sparkSession, path)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def digest(batches):
        encoder = Encoder(*shared.value)
        for piece in text_chunks(batches, size=PASS_BYTES):
            ids = encoder.encode_all([t or "" for t in piece.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.select("doc_id", "text").mapInArrow(digest, schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(documents.select(F.col("doc_id").cast("bigint"), "text"))
