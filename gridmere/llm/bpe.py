"""Byte-level BPE encoding and decoding with a rank queue.

Each pre-token is merged through a queue with one bucket for each merge rank. A bucket holds positions of a linked list
of parts; a two-level bitmap marks the buckets that hold any, and find-first-set picks the next rank. An entry whose
pair has changed meanwhile is stale and skipped. A merge costs the same whatever the length of the pre-token is.

Nulls are empty texts: no ids. Texts of any length are encoded whole. Repeated rows give repeated rows, other columns
are ignored, and an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, map_texts

#: Pre-tokens whose ids a worker remembers (twice as many at most, besides those of one text), and their greatest length;
#: both bound memory only.
REMEMBERED, REMEMBERED_LENGTH = 250_000, 48
#: White space as the vocabulary's own library takes it (Unicode's White_Space), fixed values.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 of a token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str) -> regex.Pattern:
    """The pre-token pattern, with white space spelled out."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


class RankQueue:
    """Merges pre-tokens. Buckets and bitmaps are empty again after each one, so that they are made only once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=0) + 1
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.leaves = [0] * ((size >> 8) + 1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank is merged first, the leftmost of equal ones."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        rank_of, buckets, leaves, n = ranks.get, self.buckets, self.leaves, len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends, which is where the next one starts
        before = list(range(-1, n))
        pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        top = 0
        for i, rank in enumerate(pair):
            if rank >= 0:
                buckets[rank].append(i)  # ascending positions are a heap
                leaves[rank >> 8] |= 1 << (rank & 255)
                top |= 1 << (rank >> 8)
        while top:
            high = (top & -top).bit_length() - 1
            leaf = leaves[high]
            rank = high << 8 | (leaf & -leaf).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if not bucket:
                leaves[high] = leaf = leaf & (leaf - 1)
                if not leaf:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            right = end[i]
            end[i] = stop = end[right]
            pair[right] = new = -1
            if stop < n:
                before[stop] = i
                new = rank_of(piece[i : end[stop]], -1)
                if new >= 0:
                    heappush(buckets[new], i)
                    leaves[new >> 8] |= 1 << (new & 255)
                    top |= 1 << (new >> 8)
            pair[i] = new
            left = before[i]
            if left >= 0:
                pair[left] = new = rank_of(piece[left:stop], -1)
                if new >= 0:
                    heappush(buckets[new], left)
                    leaves[new >> 8] |= 1 << (new & 255)
                    top |= 1 << (new >> 8)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids


class Codec:
    """Encodes texts to ids, packed as little-endian unsigned 32-bit integers, and decodes them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merge, self.find = RankQueue(ranks).merge, splitter(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def packed(self, piece: str) -> bytes:
        return pack("<%dI" % len(ids := self.merge(piece.encode())), *ids)

    def encode(self, text: str) -> bytes:
        pieces = self.find(text)
        long: dict[str, bytes] = {}  # of this text alone
        for piece in set(pieces).difference(self.seen):
            if len(piece) > REMEMBERED_LENGTH:
                long[piece] = self.packed(piece)
            else:
                packed = self.older.get(piece)
                self.seen[piece] = self.packed(piece) if packed is None else packed
        out = b"".join([long[p] if p in long else self.seen[p] for p in pieces] if long else map(self.seen.__getitem__, pieces))
        if len(self.seen) > REMEMBERED:
            self.older, self.seen = self.seen, {}
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec in each Python worker."""
    return Codec(load_ranks(path), pattern)


def _forget() -> None:
    codec.cache_clear()
    load_ranks.cache_clear()


cached(__name__, _forget)


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text: (id, n_tokens, ids as packed bytes). The vocabulary file must be on each worker's machine."""

    def make():
        own = codec(vocabulary, pattern)

        def run(keys, texts):
            packed = [own.encode((t or b"").decode("utf-8", "replace")) for t in texts]
            return keys, [len(p) // 4 for p in packed], packed

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary"))
    return map_texts(rows, f"`{id_col}` {kind}, n_tokens long, ids binary", make)


def decode_ids(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Bytes of each list of packed ids: (id, n_tokens, ids, decoded)."""

    def make():
        own = codec(vocabulary, pattern)
        return lambda keys, counts, packed: (keys, counts, packed, [own.decode(p or b"") for p in packed])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_texts(encoded.select(id_col, "n_tokens", "ids"), f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary", make)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_texts() and then decode_ids() in one pass, as (id, n_tokens, ids, decoded): one worker holds one codec."""

    def make():
        own = codec(vocabulary, pattern)

        def run(keys, texts):
            packed = [own.encode((t or b"").decode("utf-8", "replace")) for t in texts]
            return keys, [len(p) // 4 for p in packed], packed, [own.decode(p) for p in packed]

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(F.col(id_col), F.col(text_col).cast("binary")), f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary", make)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def ids_of(text: str, vocabulary: str, pattern: str) -> list[int]:
    return np.frombuffer(codec(vocabulary, pattern).encode(text), "<u4").tolist()
