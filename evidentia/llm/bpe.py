"""Byte-level BPE by backtracking from longest matches, and decoding.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick pass finds every vocabulary
token in a piece and with it the longest at each position.  Tokens are laid down greedily from
the left; a token may follow another only if ordinary merging would leave that boundary alone,
which depends on the two tokens alone and is memoised.  Where it fails the token is shortened to
the next vocabulary prefix, and where none is left the step before is undone; positions known to
be dead ends are not tried again, which keeps the work linear in the piece.

Null text counts as empty (no tokens, the digest of nothing).  Repeated rows and ids are encoded
as they come; an empty table gives an empty result; texts are read whole at any length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .pretokens import Memo, splitter

#: Pieces whose ids a worker remembers, and token pairs whose compatibility it does.
PIECES, PAIRS = 250_000, 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.halves = {rank: self._halves(token, rank) for token, rank in ranks.items()}
        made = {r for r, h in self.halves.items() if h}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank in made:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.shorter = {}
        for rank in made:
            token = self.tokens[rank]
            cuts = (ranks.get(token[:k]) for k in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((r for r in cuts if r in made), None)
        self.length = {rank: len(token) for rank, token in self.tokens.items()}
        self.fits = Memo(self._fits, PAIRS)

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the token's last merge joins (a byte: itself twice; None: no merges make it)."""
        parts = [token[k : k + 1] for k in range(len(token))]
        if len(parts) == 1:
            return (rank, rank)
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[k] + parts[k + 1], rank), k) for k in range(len(parts) - 1))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]])

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging leaves the boundary between the two tokens alone.

        Take the merges of both tokens back, the youngest first.  Whenever the parts that then
        meet at the boundary make a token older than what is still to be built, it is built first."""
        left, right = pair
        limit = len(self.tokens) + 1
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < limit:
                return False
            undo_left = self.length[left] > 1 and (left > right or self.length[right] == 1)
            if undo_left:
                limit, left = left, self.halves[left][1]
            elif self.length[right] > 1:
                # at an equal rank the leftmost merge comes first
                limit, right = right + 1, self.halves[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        end = len(piece)
        longest = [0] * end
        for at, (size, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[at - size + 1] = rank
        length, shorter, fits = self.length, self.shorter, self.fits
        out: list[int] = []
        alive = bytearray(b"\x01") * (end + 1)
        at, token = 0, longest[0]
        while True:
            stop = at + length[token]
            if alive[stop] and (not out or fits[out[-1], token]):
                out.append(token)
                if stop == end:
                    return out
                at, token = stop, longest[stop]
            elif shorter[token] is not None:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(load_ranks(path))
    return _encoders[path]


def _task(path: str, pattern: str, fixed: str, with_ids: bool, shipped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(SparkFiles.get(path) if shipped else path)
        split = splitter(pattern, fixed)
        memo = Memo(lambda piece: array("I", bpe.encode_piece(piece.encode())).tobytes(), PIECES)
        token = bpe.tokens.__getitem__
        for batch in batches:
            n_tokens, ids_hash, text_hash, all_ids, decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = b"".join(map(memo.__getitem__, split(text or "")))
                numbers = np.frombuffer(ids, "<u4")
                plain = b"".join(map(token, numbers.tolist()))
                n_tokens.append(len(numbers))
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(plain).hexdigest())
                if with_ids:
                    all_ids.append(numbers.astype(np.int64).tolist())
                    decoded.append(plain.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str, fixed: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, shipped: bool = False) -> DataFrame:
    """n_tokens, ids_sha256, decoded_sha256 for every row; with_ids also ids and the decoded text.

    vocabulary: path of a rank file that every worker can read, or (shipped) its name under addFile."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    return arrow_map(rows, _task(vocabulary, pattern, fixed, with_ids, shipped), schema).withColumnRenamed("key", id_col)
