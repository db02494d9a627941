"""Byte-level BPE encoding and decoding through a sentencepiece model that is written here, not trained.

The rank file (lines of base64 token and rank) becomes a serialised sentencepiece BPE model: each token's bytes b are
the characters U+0100 + b, its score is minus its rank, and the normaliser is the identity without a prefix, white
space rules or byte fallback. sentencepiece then merges the adjacent pair with the best score, leftmost first, which is
the merge order of the ranks. Texts are split by the tokenizer's pattern and each match is encoded by itself. A match
that is itself a token has that token's id, also where merges alone would not reach it; such tokens are found when
the model is made. Decoding maps ids back to pieces and pieces back to bytes.

Each worker keeps a bounded cache of the matches it has seen; texts of any length go through in blocks.

Null text: encoded as the empty text (no ids, no bytes). Rows are kept one for one, repeated rows and ids included.
Null ids arrays decode to null. Columns other than those named are carried through unread by ``carry``.
"""

from __future__ import annotations

import base64
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE, BLOCK = 150_000, 100_000

_models: dict[tuple[str, str], Encoder] = {}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value) -> bytes:
    """A protobuf field: bytes, float or whole number."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(data: bytes) -> str:
    """Bytes as the characters U+0100 to U+01FF."""
    return (np.frombuffer(data, np.uint8).astype("<u2") + 0x100).tobytes().decode("utf-16-le")


def unmapped(piece: str) -> bytes:
    """The inverse of ``mapped``."""
    return (np.frombuffer(piece.encode("utf-16-le"), "<u2") - 0x100).astype(np.uint8).tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; piece i is the token of rank i, and one unknown piece follows."""
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0 to n - 1")
    pieces = [_field(1, _field(1, mapped(t).encode()) + _field(2, float(-r)) + _field(3, 1)) for r, t in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(35, 0) + _field(40, len(tokens))
    for number in (41, 42, 43):  # no begin, end or padding piece
        trainer += _varint(number << 3) + b"\xff" * 9 + b"\x01"
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes and decodes whole texts; one for each worker, path and pattern."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.token = [unmapped(self.sp.id_to_piece(i)) for i in range(len(ranks))]
        merged = self.sp.encode([mapped(t) for t in self.token], num_threads=1)
        self.whole = {t: i for i, t in enumerate(self.token) if merged[i] != [i]}
        self.cache: dict[str, bytes] = {}

    def _learn(self, matches: set[str]) -> None:
        new = [m for m in matches if m not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(matches)
        data = [m.encode("utf-8", "replace") for m in new]
        for m, d, ids in zip(new, data, self.sp.encode([mapped(d) for d in data], num_threads=1), strict=True):
            self.cache[m] = np.array([self.whole[d]] if d in self.whole else ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit numbers."""
        if len(text) < BLOCK * 4:
            return self._block(self.pattern.findall(text))
        found, out = (m[0] for m in self.pattern.finditer(text)), []
        while block := list(islice(found, BLOCK)):
            out.append(self._block(block))
        return b"".join(out)

    def _block(self, matches: list[str]) -> bytes:
        try:
            return b"".join(map(self.cache.__getitem__, matches))
        except KeyError:
            self._learn(set(matches))
            return b"".join(map(self.cache.__getitem__, matches))

    def decode(self, ids) -> bytes:
        """The bytes of the pieces, one after another."""
        return b"".join(map(self.token.__getitem__, ids))


def encoder(path: str, pattern: str) -> Encoder:
    """This process's encoder."""
    if (path, pattern) not in _models:
        _models[path, pattern] = Encoder(path, pattern)
    return _models[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def _schema(df: DataFrame, carry) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*carry).schema)


def encode(docs: DataFrame, carry=("doc_id",), path: str | None = None, pattern: str | None = None, round_trip: bool = False) -> DataFrame:
    """The columns of ``carry`` and ``ids array<int>`` of column ``text``; with ``round_trip`` also ``decoded binary``,
    decoded from the ids by the same worker."""
    found = default_vocabulary()
    path, pattern = path or found[0], pattern or found[1]

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            packed, ends = [], [0]
            for text in batch.column("text").to_pylist():
                packed.append(own.encode(text) if text else b"")
                ends.append(ends[-1] + len(packed[-1]) // 4)
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
            out = {c: batch.column(c) for c in carry} | {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)}
            if round_trip:
                out["decoded"] = pa.array([own.decode(np.frombuffer(p, "<i4").tolist()) for p in packed], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, _schema(docs, carry) + "ids array<int>" + ", decoded binary" * round_trip)


def decode(encoded: DataFrame, carry=("doc_id", "ids"), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of ``carry`` and ``decoded binary`` of column ``ids``."""
    found = default_vocabulary()
    path, pattern = path or found[0], pattern or found[1]

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            column = batch.column("ids")
            values, at = column.values.to_numpy(), column.offsets.to_pylist()
            out = [own.decode(values[a:b].tolist()) if ok else None for a, b, ok in zip(at, at[1:], column.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in carry} | {"decoded": pa.array(out, pa.binary())})

    return encoded.select(*dict.fromkeys([*carry, "ids"])).mapInArrow(run, _schema(encoded, carry) + "decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``docs``."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs, round_trip=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the round trip back to its bytes, as digests."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
