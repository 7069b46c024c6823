"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds those above capacity / (k + 1) and up to capacity / k, and its bins take
exactly k documents. What room such a bin has left goes to the start of the next document, which is cut there; the rest of that document has a class
of its own length. So a full bin has no padding, and a document is cut about once for each bin. A document of more than a capacity
first fills whole sequences. Every task fills bins of its own, one open bin a class. The documents in its open bins at its end
are put end to end; the last of these sequences, which isn't full, is cut into lengths that are powers of two.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents, texts
from .ragged import Recent, gathered, give_back, sliced

CAPACITY = 4096
END = 2
#: The last class takes all shorter documents.
CLASSES = 64
#: Sequences of a task have ids from its partition's number times this.
TASK_IDS = 1 << 40


#: What splits normalised texts, and what of it isn't letters in plain chunks (RE2 has the same order of preference).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIGNS = r"'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[!-/:-@\[-`{-~]+"
#: Chunks that normalisation only lower-cases.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"


_PRINTED = frozenset([*range(33, 127), *range(161, 173), *range(174, 256)])
_OTHERS = [b for b in range(256) if b not in _PRINTED]
#: The characters that stand for bytes in byte-level vocabularies.
BYTE_NAMES = {b: chr(b) if b in _PRINTED else chr(256 + _OTHERS.index(b)) for b in range(256)}
#: The same as code units, but white space stays.
BYTE_UNITS = np.array([b if b == 32 else ord(BYTE_NAMES[b]) for b in range(256)], "<u2")


class ChunkTokenizer:
    """Ids of texts by a public tokenizer that never joins characters across ASCII white space.

    A text is then the chunks between white space. Most are plain: their pieces (words, digits, runs of signs) are found in Arrow, and the library's model
    alone encodes them, all pieces that aren't remembered in one call, as the last id of a piece is one of a word's end. The library
    encodes other chunks whole, and all chunks of vocabularies that are split or normalised in another way.
    """

    def __init__(self, file: bytes) -> None:
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_buffer(file)
        parts = json.loads(file)
        vocab, suffix = parts["model"]["vocab"], parts["model"].get("end_of_word_suffix")
        splits, normal = ((parts[x] or {}).get(of, ()) for x, of in (("pre_tokenizer", "pretokenizers"), ("normalizer", "normalizers")))
        as_known = [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": SPLIT}
        self.ends = None
        if as_known and suffix and all(x in vocab and x + suffix in vocab for x in BYTE_NAMES.values()):
            self.words = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for word, i in vocab.items() if word.endswith(suffix)]] = True
        self.known = Recent(200_000)

    @staticmethod
    def _ids(tokenizer, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and their number in each text."""
        ids = [x.ids for x in tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def _plain(self, chunks: pa.Array) -> pa.Array:
        """Which chunks are plain; their pieces are so too."""
        if self.ends is None:
            return pa.repeat(False, len(chunks))
        return pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring(chunks, "<|"))  # special tokens have names like <|this|>

    def _pieces(self, chunks: pa.Array) -> pa.Array:
        """The list of each chunk's pieces; a chunk that isn't plain is one."""
        apart = pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(chunks), SIGNS, r" \0 "))
        return pc.ascii_split_whitespace(pc.if_else(self._plain(chunks), apart, chunks))

    def _learn(self, fresh: list[str]) -> None:
        """Remembers pieces."""
        plain = self._plain(pa.array(fresh, pa.large_string())).to_numpy(zero_copy_only=False).tolist()
        words, others = list(compress(fresh, plain)), [x for x, p in zip(fresh, plain, strict=True) if not p]
        self.known.add(others, *self._ids(self.whole, others))
        if words:
            ids, _ = self._ids(self.words, [BYTE_UNITS[np.frombuffer(" ".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")])
            self.known.add(words, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))

    def encode(self, text: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and their number in each text."""
        column = pa.array(text, pa.large_string())
        if not pc.any(pc.match_substring(column, "<|")).as_py():  # a special token's name counts in its own case only
            column = pc.ascii_lower(column)
        lists = pc.ascii_split_whitespace(column)
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        there = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(there)))[ends - ends[0]]
        chunks = flat.filter(pa.array(there, pa.bool_())).dictionary_encode()
        lists = self._pieces(chunks.dictionary)
        pieces = lists.flatten().dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(self.known.missing(names))
        every = self.known.at(names)[pieces.indices.to_numpy()]
        lengths = self.known.lengths[every]
        ids = gathered(self.known.flat, self.known.starts[every], lengths)
        starts = np.concatenate(([0], np.cumsum(lengths)))[lists.offsets.to_numpy()]
        every = chunks.indices.to_numpy()
        lengths = np.diff(starts)[every]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return gathered(ids, starts[:-1][every], lengths), np.diff(total[ends])


_OPEN: dict[bytes, ChunkTokenizer] = {}


def opened(file: bytes) -> ChunkTokenizer:
    """One tokenizer for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hashlib.sha256(file).digest()
    if key not in _OPEN:
        _OPEN[key] = ChunkTokenizer(file)
    return _OPEN[key]


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """k for lengths above capacity / (k + 1) and up to capacity / k."""
    return min(CLASSES, capacity // length)


class Piece:
    """A stretch of a document's ids: `data` are the document's ids in bytes, four to each."""

    __slots__ = ("data", "doc_id", "doc_tokens", "length", "start")

    def __init__(self, doc_id: int | None, start: int, length: int, doc_tokens: int, data: memoryview) -> None:
        self.doc_id, self.start, self.length, self.doc_tokens, self.data = doc_id, start, length, doc_tokens, data

    def cut(self, length: int) -> Piece:
        """The first `length` ids; they leave this piece."""
        first = Piece(self.doc_id, self.start, length, self.doc_tokens, self.data)
        self.start, self.length = self.start + length, self.length - length
        return first


class Bin:
    def __init__(self) -> None:
        self.pieces: list[Piece] = []
        self.used = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += piece.length


class Bins:
    """The open bins of one task: at most one for each class, and one that has its documents and is being filled up."""

    COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, partition: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next_id = capacity, partition * TASK_IDS
        self.open: dict[int, Bin] = {}
        self.filling: Bin | None = None
        self.out: list[tuple] = []

    def put(self, piece: Piece) -> None:
        """A whole document, or what is left of it."""
        while piece.length:
            if self.filling:
                self._fill(piece)
            elif piece.length >= self.capacity:
                whole = Bin()
                whole.add(piece.cut(self.capacity))
                self._close(whole)
            else:
                k = class_of(piece.length, self.capacity)
                of = self.open.setdefault(k, Bin())
                of.add(piece.cut(piece.length))
                if len(of.pieces) == k:
                    self.filling = self.open.pop(k)
                    self._full()

    def _fill(self, piece: Piece) -> None:
        self.filling.add(piece.cut(min(piece.length, self.capacity - self.filling.used)))
        self._full()

    def _full(self) -> None:
        if self.filling.used == self.capacity:
            self._close(self.filling)
            self.filling = None

    def _close(self, full: Bin) -> None:
        offset = 0
        for p in full.pieces:
            crc = zlib.crc32(p.data[4 * p.start : 4 * (p.start + p.length)])
            self.out.append((p.doc_id, p.start, p.length, crc, p.doc_tokens, self.next_id, offset))
            offset += p.length
        self.next_id += 1

    def finish(self) -> None:
        """The documents of the open bins, end to end; of the last, not full sequence, each power of two that its length adds up to is one."""
        rest = [p for k in sorted(self.open) for p in self.open[k].pieces]
        self.open = {}
        for piece in rest:
            while piece.length:
                self.filling = self.filling or Bin()
                self._fill(piece)
        rest, self.filling = self.filling.pieces if self.filling else [], None
        total = sum(p.length for p in rest)
        while total:
            part, size = Bin(), 1 << (total.bit_length() - 1)
            while part.used < size:
                part.add(rest[0].cut(min(rest[0].length, size - part.used)))
                if not rest[0].length:
                    rest = rest[1:]
            self._close(part)
            total -= size

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], list(self.COLUMNS))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    capacity is a power of two. Null and empty texts are the id `end` alone; repeated rows are packed each; a null doc_id is carried along;
    other columns are ignored; an empty table gives no rows. A lost task is repeated with the same ids, as they follow from its partition.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    with open(tokenizer_path, "rb") as file:  # of bounded size; only the driver needs it
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        coder, bins = opened(shared.value), Bins(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())  # as Python's integers: in pandas a null would make doubles of them
            for rows in sliced(batch.select(["text"]).to_pandas()):
                flat, counts = coder.encode(rows["text"])
                at = 0
                for n in counts.tolist():
                    doc_id = next(doc_ids)
                    ids = np.append(flat[at : at + n], np.uint32(end)).astype("<u4")
                    at += n
                    bins.put(Piece(doc_id, 0, n + 1, n + 1, memoryview(ids.tobytes())))
                if bins.out:
                    yield bins.take()
        bins.finish()
        if bins.out:
            yield bins.take()
        give_back()

    return texts(docs).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
