"""Encoding of a whole corpus with a public byte-level BPE tokenizer, cut at forced boundaries."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from threadlake.sources.tables import table

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and fragments remembered per worker; beyond this the memory starts anew.
REMEMBERED = 400_000
#: Ids after which a task hands a batch on.
FLUSH = 500_000


class ForcedBoundaryEncoder:
    """Byte-pair encoding in which byte pairs that no vocabulary token holds mark certain cuts.

    A merge always yields a vocabulary token, so no merge ever spans such a pair: the fragments between the cuts can be
    encoded on their own and their ids concatenated. The pattern's pieces end at certain cuts as well.
    """

    def __init__(self, vocabulary: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        joined = np.zeros((256, 256), bool)
        for token in self.rank:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8)
                joined[b[:-1], b[1:]] = True
        self.joined = joined
        self.find = regex.compile(PATTERN).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    def _merge(self, fragment: bytes) -> tuple[int, ...]:
        """Lowest-rank-first merging of one fragment."""
        rank, parts = self.rank, [fragment[i : i + 1] for i in range(len(fragment))]
        while len(parts) > 1:
            best, low = None, None
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (low is None or r < low):
                    best, low = i, r
            if best is None:
                break
            pair, i, merged = (parts[best], parts[best + 1]), 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return tuple(rank[p] for p in parts)

    def _fragment(self, fragment: bytes) -> tuple[int, ...]:
        ids = self.fragments.get(fragment)
        if ids is None:
            ids = self._merge(fragment)
            if len(self.fragments) >= REMEMBERED:
                self.fragments.clear()
            if len(fragment) <= 64:
                self.fragments[fragment] = ids
        return ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        if len(raw) < 2:
            ids = self._fragment(raw)
        else:
            b = np.frombuffer(raw, np.uint8)
            cuts = [0, *(np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
            ids = tuple(x for i, j in zip(cuts, cuts[1:]) for x in self._fragment(raw[i:j]))
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        if len(raw) <= 64:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, piece, out = self.pieces, self._piece, []
        for p in self.find(text):
            out += known.get(p) or piece(p)
        return out


_ENCODERS: dict[int, ForcedBoundaryEncoder] = {}


def _kernel(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        key = hash(vocabulary)
        if key not in _ENCODERS:
            _ENCODERS[key] = ForcedBoundaryEncoder(vocabulary)
        encode = _ENCODERS[key].encode
        for b in batches:
            done, ids, counts = 0, [], [0]
            for k, t in enumerate(b.column(1), 1):
                text = t.as_py()
                ids += encode(text) if text else ()
                counts.append(len(ids))
                if len(ids) > FLUSH or k == b.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(np.asarray(counts, np.int32)), pa.array(np.asarray(ids, np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, k - done), lists], names=["doc_id", "ids"])
                    done, ids, counts = k, [], [0]

    return run


def encode_corpus(documents: DataFrame, *, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of int) of every row of ``documents``; no special tokens.

    A null and an empty text give the empty list. Texts are encoded whole and as they are (no normalization; strings of
    special tokens are ordinary text). Repeated rows come out as often as they came in; an empty table gives an empty
    result; other columns are ignored. No shuffle: each task encodes its own rows. The vocabulary file (a fixed 0.8 MB) is
    read once on the driver and broadcast.
    """
    with open(os.path.join(tokenizers, vocabulary), "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    return documents.select("doc_id", "text").mapInArrow(_kernel(shared), "doc_id long, ids array<int>")


def queries() -> dict:
    return {"p7_ids": lambda s, d: encode_corpus(table(s, d, "documents"))}


def oracle_sql() -> dict[str, str]:
    return {}
