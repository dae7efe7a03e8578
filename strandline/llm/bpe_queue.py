"""Operator 9: byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of its bytes' parts. Each adjacent pair that has a merge rank stands in that rank's bucket;
a bitmap over blocks of ranks, and one bitmap in each block, name the buckets that hold anything, so finding the lowest
set bit twice gives the next rank. Its positions are taken in order; an entry whose pair has changed since is stale and
skipped. A merge adds at most two entries, so a pre-token of n bytes costs about n steps of constant size plus sorting
of buckets, which suits pre-tokens of millions of bytes.

Words come from a table of the pieces between single spaces, filled as texts need them, so a frequent piece is merged
once in a worker; the table stops growing at `max_pieces`. Texts whose spaces do not divide pre-tokens cleanly (doubled
spaces, spaces beside line breaks) go through the pattern whole.

Defined cases: null texts are empty and give no ids. Any text round-trips: all 256 bytes are tokens. Repeated rows are encoded
each. Of pairs of equal rank (ties) the leftmost merges first. A very long text is encoded whole in one task; a pre-token of n bytes
holds some numbers a byte. An empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from strandline.llm.shared import table


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of the token that two adjacent tokens make, by left << 32 | right."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    return pairs


def encode_piece(piece: bytes, ranks: dict[bytes, int], pairs: dict[int, int], single: list[int]) -> list[int]:
    """The ids of one pre-token: the pair of lowest rank merges first, the leftmost of equal ones."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    ids = [single[b] for b in piece]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = pairs.get
    # the queue: positions by rank, a bitmap of the ranks in each block of 1024, a bitmap of the blocks
    buckets: dict[int, list[int]] = {}
    blocks: dict[int, int] = {}
    top = 0
    for i in range(n - 1):
        r = get(ids[i] << 32 | ids[i + 1])
        if r is not None:
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                b = r >> 10
                blocks[b] = blocks.get(b, 0) | 1 << (r & 1023)
                top |= 1 << b
    while top:
        b = (top & -top).bit_length() - 1
        bits = blocks[b]
        low = bits & -bits
        blocks[b] = bits = bits ^ low
        if not bits:
            top ^= 1 << b
        rank = b << 10 | low.bit_length() - 1
        found = buckets.pop(rank)
        if len(found) > 1:
            found.sort()
        for i in found:
            j = after[i]
            if j >= n or ids[i] < 0 or get(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: a part of the pair has merged with another
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            new = []
            if k < n:
                before[k] = i
                new.append((rank << 32 | ids[k], i))
            h = before[i]
            if h >= 0:
                new.append((ids[h] << 32 | rank, h))
            for pair, at in new:
                r = get(pair)
                if r is not None:
                    if r in buckets:
                        buckets[r].append(at)
                    else:
                        buckets[r] = [at]
                        b = r >> 10
                        blocks[b] = blocks.get(b, 0) | 1 << (r & 1023)
                        top |= 1 << b
    return [x for x in ids if x >= 0]


class _Uneven(KeyError):
    """A piece that cannot be encoded apart from its neighbours."""


class Encoder(dict):
    """Maps a piece of text to its ids as little-endian 32-bit bytes; encodes on first use."""

    def __init__(self, path: str, pattern: str, max_pieces: int = 400_000) -> None:
        self.ranks = load_ranks(path)
        self.pairs = merge_pairs(self.ranks)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.find = regex.compile(pattern).findall
        self.max_pieces = max_pieces
        self.tokens: dict[str, bytes] = {}
        self.names = {r: t for t, r in self.ranks.items()}

    def token(self, t: str) -> bytes:
        ids = self.tokens.get(t)
        if ids is None:
            ids = array("I", encode_piece(t.encode(), self.ranks, self.pairs, self.single)).tobytes()
            if len(self.tokens) < self.max_pieces and len(t) < 100:
                self.tokens[t] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.token, self.find(text)))

    def __missing__(self, piece: str) -> bytes:
        """piece: what stands between two single spaces; its ids count the space before it."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Uneven(piece)
        ids = self.whole(" " + piece)
        if len(self) < self.max_pieces and len(piece) < 100:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest:
            return self.whole(text)
        if not first or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.__getitem__, rest))
        except _Uneven:
            return self.whole(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.names.__getitem__, array("I", ids)))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One by worker process and vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", digests_only: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit, as binary), decoded (the bytes that the ids stand for).

    With digests_only, ids and decoded are given by their SHA-256 in hex, so long texts are not sent back.
    """

    def run(batches):
        e = encoder(path, pattern)
        for b in batches:
            n, ids, back = [], [], []
            for x in b.column(1):
                i = e.encode(x.as_py() or "")
                d = e.decode(i)
                n.append(len(i) // 4)
                ids.append(hashlib.sha256(i).hexdigest() if digests_only else i)
                back.append(hashlib.sha256(d).hexdigest() if digests_only else d)
            kind = pa.string() if digests_only else pa.binary()
            yield pa.record_batch({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(ids, kind), "decoded": pa.array(back, kind)})

    d = docs.selectExpr(f"cast({id_col} as bigint) as doc_id", f"cast({text} as string) as text")
    kind = "string" if digests_only else "binary"
    return d.mapInArrow(run, f"doc_id bigint, n_tokens bigint, ids {kind}, decoded {kind}")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes all documents."""
    import public_tokenizers as public

    d = encode_texts(table(spark, sf_dir, "documents"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, digests_only=True)
    return d.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
