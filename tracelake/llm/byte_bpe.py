"""Byte-level BPE in padded matrices.

The distinct words of a slice are dealt into buckets by their length in bytes, each a padded matrix with a row for
each word. Every round, each row merges its leftmost pair of minimum rank; pairs are looked up in an open-addressed hash table
held in arrays. Rows without a pair left are taken out, and the matrix loses a column each round. Where rows are wide, moving all columns
behind a merge would cost more than the merge: tokens then keep their columns, neighbours are linked, minima are kept for blocks of
columns, and the columns are compacted at the end.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, texts
from .ragged import Lists, gathered, row_by_row

#: Columns up to which a round moves them; both ways merge the same pairs in the same order.
WIDE = 128
CELLS = 1 << 19
NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank of the token that two adjacent tokens form, NONE where they form none."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = (np.array(x, np.uint64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.uint64),) * 3
        keys = left << np.uint64(32) | right
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, NONE)
        todo, self.reach = np.arange(len(keys)), 0
        while len(todo):
            at = self._slot(keys[todo], self.reach)
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]] = keys[todo[first]]
            self.ranks[at[first]] = rank[todo[first]].astype(np.int32)
            todo = np.delete(todo, first)
            self.reach += 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        spread = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((spread + np.uint64(step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """left and right: tokens, -1 where there is none."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        out = np.full(left.shape, NONE)
        todo = np.nonzero((left >= 0) & (right >= 0))[0]
        keys = left[todo].astype(np.uint64) << np.uint64(32) | right[todo].astype(np.uint64)
        for step in range(self.reach):
            at = self._slot(keys, step)
            seen = self.keys[at]
            hit = seen == keys
            out[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (seen != np.uint64(2**64 - 1))
            todo, keys = todo[more], keys[more]
            if not len(todo):
                break
        return out.reshape(shape)


class ByteBPE:
    """Encodes and decodes with the ranks of a file in tiktoken's format."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.words = regex.compile(pattern)
        self.pairs = PairTable(self.ranks)
        self.first = np.full(256, -1, np.int32)
        for b in range(256):
            self.first[b] = self.ranks[bytes([b])]
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.known = Lists()
        self.numbers: list[str] = []

    def _matrix(self, t: np.ndarray, out: list, rows: np.ndarray) -> None:
        """t: a row of tokens for each word, -1 behind its end; puts each row's tokens into out."""
        r = self.pairs.look(t[:, :-1], t[:, 1:])
        while len(rows):
            best = r.min(axis=1) if r.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                for k, row in zip(rows[done].tolist(), t[done], strict=True):
                    out[k] = row[row >= 0]
                t, r, rows, best = t[~done], r[~done], rows[~done], best[~done]
                if not len(rows):
                    return
            at, n = r.argmin(axis=1), np.arange(len(rows))
            t[n, at] = best
            behind = np.arange(t.shape[1] - 1)[None, :] > at[:, None]
            t = np.where(behind, t[:, 1:], t[:, :-1])
            r = np.where(behind[:, :-1] if r.shape[1] > 1 else behind[:, :0], r[:, 1:], r[:, :-1])
            if not r.shape[1]:
                continue
            left, right = at > 0, at < t.shape[1] - 1
            r[n[left], at[left] - 1] = self.pairs.look(t[n[left], at[left] - 1], t[n[left], at[left]])
            r[n[right], at[right]] = self.pairs.look(t[n[right], at[right]], t[n[right], at[right] + 1])

    def _wide(self, t: np.ndarray, out: list, rows: np.ndarray) -> None:
        """The same for wide rows: a merge touches three pairs, and a round costs about the root of the width."""
        width = t.shape[1]
        block = max(8, math.isqrt(width))
        blocks = -(-width // block)
        r = np.full((len(rows), blocks * block), NONE)
        r[:, : width - 1] = self.pairs.look(t[:, :-1], t[:, 1:])
        least = r.reshape(len(rows), blocks, block).min(axis=2)
        # after[k] and before[k]: columns of the neighbours of the token at column k; column `width` ends a row
        t = np.hstack([t, np.full((len(rows), 1), -1, np.int32)])
        after = np.tile(np.arange(1, width + 2), (len(rows), 1))
        before = np.tile(np.arange(-1, width), (len(rows), 1))
        live = np.arange(len(rows))
        while len(live):
            where = least[live].argmin(axis=1)
            best = least[live, where]
            done = best == NONE
            if done.any():
                for k in live[done].tolist():
                    out[rows[k]] = t[k][t[k] >= 0]
                live, where, best = live[~done], where[~done], best[~done]
                if not len(live):
                    return
            at = where * block + r.reshape(-1, blocks, block)[live, where].argmin(axis=1)
            gone = after[live, at]
            behind = after[live, gone]
            t[live, at], t[live, gone] = best, -1
            r[live, gone] = NONE
            after[live, at] = behind
            before[live, np.minimum(behind, width - 1)] = np.where(behind < width, at, before[live, np.minimum(behind, width - 1)])
            r[live, at] = self.pairs.look(t[live, at], t[live, np.minimum(behind, width)])
            front = before[live, at]
            has = front >= 0
            r[live[has], front[has]] = self.pairs.look(t[live[has], front[has]], t[live[has], at[has]])
            for columns in (at, gone, np.maximum(front, 0)):
                b = columns // block
                least[live, b] = r.reshape(-1, blocks, block)[live, b].min(axis=1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens of each word by itself."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        bucket = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for b in np.unique(bucket):
            rows = np.nonzero(bucket == b)[0]
            width = int(sizes[rows].max())
            for part in np.array_split(rows, -(-len(rows) * width // CELLS)):
                flat = self.first[np.frombuffer(b"".join([words[k] for k in part.tolist()]), np.uint8)]
                inside = np.arange(width)[None, :] < sizes[part][:, None]
                t = np.full((len(part), width), -1, np.int32)
                t[inside] = flat
                (self._matrix if width <= WIDE else self._wide)(t, out, part)
        return out

    def encode(self, text: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids end to end, their number in each text, and each text's ids in decimal, joined by a space."""
        found = [self.words.findall(x) for x in text]
        if len(self.known.rows) > self.known.most:
            self.known.clear()
            self.numbers = []
        rows = self.known.rows
        fresh = list({w for ws in found for w in ws if w not in rows})
        if fresh:
            ids = self.encode_words([w.encode() for w in fresh])
            self.known.add(fresh, np.concatenate(ids).astype(np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
            self.numbers += [" ".join(map(str, x.tolist())) for x in ids]
        at = [[rows[w] for w in ws] for ws in found]
        numbers = self.numbers
        decimal = [" ".join([numbers[k] for k in ks]) for ks in at]
        every = np.fromiter((k for ks in at for k in ks), np.int64, sum(map(len, at)))
        lengths = self.known.lengths[every]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        of = np.cumsum([0, *map(len, at)])
        return gathered(self.known.flat, self.known.starts[every], lengths), np.diff(ends[of]), decimal

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


_OPEN: dict[tuple[bytes, str], ByteBPE] = {}


def opened(ranks_file: bytes, pattern: str) -> ByteBPE:
    """One encoder for each worker process."""
    key = (hashlib.sha256(ranks_file).digest(), pattern)
    if key not in _OPEN:
        _OPEN[key] = ByteBPE(ranks_file, pattern)
    return _OPEN[key]


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int): the ids of every whole text; of an empty or null one, none."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        ids, counts, _ = opened(shared.value, pattern).encode(rows["text"].tolist())
        return pd.DataFrame({"ids": np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])})

    return row_by_row(texts(docs), ["doc_id"], lambda: encode, "ids array<int>")


def decoded(ids: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: what the ids of each row stand for."""
    shared = ids.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def run(batches):
        coder = opened(shared.value, pattern)
        for batch in batches:
            lists = batch.column("ids")
            data = pa.array([b"" if x is None else coder.decode(np.asarray(x, np.int64)) for x in lists.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data], ["doc_id", "bytes"])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def _read(path: str) -> bytes:
    """The file of ranks, of bounded size; only the driver needs it."""
    with open(path, "rb") as file:
        return file.read()


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens, and the digests of nothing. Repeated rows each return, a null doc_id is carried along,
    other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def digest(rows: pd.DataFrame) -> pd.DataFrame:
        coder = opened(shared.value, pattern)
        ids, counts, decimal = coder.encode(rows["text"].tolist())
        parts = np.split(ids, np.cumsum(counts)[:-1])
        hexed = lambda x: hashlib.sha256(x).hexdigest()
        return pd.DataFrame({"n_tokens": counts, "ids_sha256": [hexed(x.encode()) for x in decimal], "decoded_sha256": [hexed(coder.decode(x)) for x in parts]})

    return row_by_row(texts(docs), ["doc_id"], lambda: digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
