"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece exactly one token can end its encoding; the encoder stores that
token per prefix.  A token t ending at byte i follows the stored token s of the prefix before
it if and only if the pair (s, t) encodes to itself, which a walk back through the merges of s
and t decides.  So appending bytes adds prefixes and changes none, the encoding of any prefix
can be read off, and after an edit only prefixes behind the edit are computed anew.

Defined results: a null or empty text has no tokens; text is taken whole; bytes that are no
valid UTF-8 survive ``decode`` as bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsight.llm.common import schema_with


class PrefixBPE:
    """Ranks of a byte-level vocabulary with what the prefix table needs."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.longest = max(map(len, self.ranks))
        self.halves = {r: self._halves(t) for t, r in self.ranks.items() if len(t) > 1}
        self.merged = {pair: rank for rank, pair in self.halves.items() if pair}
        self.ends = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if len(token) == 1 or self.halves[rank]:
                self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``: its encoding by tokens of lower rank."""
        parts = [token[i:i + 1] for i in range(len(token))]
        limit = self.ranks[token]
        while len(parts) > 2:
            ranked = [(self.ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank >= limit:
                return None  # not reachable by merges: never part of an encoding of a longer piece
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _follows(self, s: int, t: int) -> bool:
        """Whether the bytes of s and t together encode to exactly (s, t).

        Undo merges on both sides of the border, the one made later first; the pair fails if at
        some time the two tokens facing each other would have merged before the merge undone.
        """
        known = self.pairs.get((s, t))
        if known is not None:
            return known
        left, right, before, holds = s, t, None, True
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and (before is None or joint < before[0] or (joint == before[0] and before[1])):
                holds = False
                break
            left_parts, right_parts = self.halves.get(left), self.halves.get(right)
            if left_parts is None and right_parts is None:
                break
            # equal ranks: the merge further left happens first, so the right one is undone first
            if right_parts is None or (left_parts is not None and left > right):
                before, left = (left, False), left_parts[1]
            else:
                before, right = (right, True), right_parts[0]
        if len(self.pairs) > 4_000_000:
            self.pairs.clear()
        self.pairs[s, t] = holds
        return holds

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Continue the prefix table ``last`` (token ending at each byte) to the whole of ``piece``.

        The automaton names every token that ends at a byte, longest first, with its length.
        """
        done, follows = len(last), self._follows
        back = max(0, done - self.longest)
        for end, (token, n) in self.ends.iter(piece[back:].decode("latin-1")):
            end += back
            if end < len(last) or end < done:
                continue  # this prefix has its token
            if n > end:
                last.append(token)
            elif follows(last[end - n], token):
                last.append(token)
        return last

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, from their prefix table."""
        end, out = len(last) if end is None else end, []
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def edit(self, piece: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace piece[start:end] by ``new``: the table up to ``start`` is kept, the rest computed."""
        piece = piece[:start] + new + piece[end:]
        return piece, self.extend(piece, last[:start])

    def piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is a token itself is that token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(self.extend(piece, []))

    def encode(self, text: str) -> list[int]:
        return [t for p in self.find(text) for t in self.piece(p.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Packed(dict):
    """Piece -> (ids as little-endian 32-bit integers); bounded, cleared when full."""

    def __init__(self, bpe: PrefixBPE, most: int = 250_000):
        super().__init__()
        self.bpe, self.most = bpe, most

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.bpe.piece(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


def _decoder(bpe: PrefixBPE):
    lengths = np.zeros(max(bpe.tokens) + 1, np.int64)
    for rank, token in bpe.tokens.items():
        lengths[rank] = len(token)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    pool = np.frombuffer(b"".join(bpe.tokens.get(r, b"") for r in range(len(lengths))), np.uint8)

    def decode(ids: np.ndarray) -> bytes:
        parts = []
        for i in range(0, len(ids), 100_000):
            some = ids[i:i + 100_000]
            n = lengths[some]
            ends = np.cumsum(n)
            parts.append(pool[np.repeat(starts[some] - ends + n, n) + np.arange(n.sum())].tobytes())
        return b"".join(parts)

    return decode


def _worker(path: str, pattern: str):
    """The vocabulary is read once per Python worker."""
    key = (path, pattern)
    if key not in _loaded:
        bpe = PrefixBPE(path, pattern)
        _loaded[key] = bpe, _Packed(bpe), _decoder(bpe)
    return _loaded[key]


_loaded: dict = {}


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
                  decoded_sha256: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` as array<int> in column ``ids`` and, if it is named, the
    SHA-256 of the bytes that decoding them gives (columns of these names are replaced)."""
    added = [ids, *([decoded_sha256] if decoded_sha256 else [])]

    def run(batches):
        bpe, packed, decode = _worker(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                out = [np.frombuffer(b"".join([packed[p] for p in bpe.find(t.as_py() or "")]), "<i4") for t in some.column("__text")]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))]
                if decoded_sha256:
                    lists.append(pa.array([hashlib.sha256(decode(x.astype(np.int64))).hexdigest() for x in out]))
                kept = some.drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, *lists], [*kept.schema.names, *added])

    own = docs.withColumn("__text", F.col(f"`{text}`").cast("string")).drop(*added)
    schema = schema_with(own.drop("__text"), ", ".join([f"`{ids}` array<int>", *([f"`{decoded_sha256}` string"] if decoded_sha256 else [])]))
    return own.mapInArrow(run, schema)


def decode_column(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of the token ids in column ``out`` (null ids: no bytes)."""
    def run(batches):
        _, _, decode = _worker(path, pattern)
        for batch in batches:
            rows = [decode(np.asarray(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], [*batch.schema.names, out])

    own = docs.drop(out)
    return own.mapInArrow(run, schema_with(own, f"`{out}` binary"))


def encode_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, SHA-256 of the ids (little-endian 32-bit) and of the decoded bytes.

    One pass, nothing is shuffled; ids and decoded bytes of one text at a time are held.
    """
    def run(batches):
        bpe, packed, decode = _worker(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column("__text"):
                ids = b"".join([packed[p] for p in bpe.find(t.as_py() or "")])
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                             [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(key, F.col(f"`{text}`").cast("string").alias("__text"))
    schema = schema_with(own.select(key), "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return own.mapInArrow(run, schema)
