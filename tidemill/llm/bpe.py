"""Byte-level BPE through a sentencepiece model that is written, not trained.

The rank file becomes a sentencepiece BPE model directly: every vocabulary entry is one
piece whose bytes are mapped to single code points, its score is the negative rank (so the
merge of lowest rank wins, leftmost first) and normalisation is the identity. Pre-tokens
are byte-mapped, encoded by that model, and decoded by the inverse mapping.

Defined results: null text is the empty text; the empty text has no ids; ids, not strings,
are the output, as little-endian unsigned 32-bit integers in one binary, so a text of any
length needs four bytes a token. Special tokens do not exist. Repeated rows give repeated
rows, a null id stays null, and other columns of the input are not carried.
"""

from __future__ import annotations

import base64
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, texts_of

#: Code point of byte 0 in pieces; byte b is chr(_BASE + b). Any block of letters would do.
_BASE = 0x100
#: A single space between two non-space characters begins a new pre-token, if the pattern says so (Codec tries it).
_EDGE = re.compile(r"(?<=\S) (?=\S)")
#: Texts without this can be cut at every space.
_ODD = re.compile(r"\s | \s|\A | \Z")
#: Entries a task's memo may hold before it starts anew.
MEMO_ENTRIES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file lines: base64 of the token's bytes, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def mapped(data: bytes) -> str:
    """One code point a byte."""
    return data.decode("latin-1").translate(_TO_PIECE)


_TO_PIECE = {b: chr(_BASE + b) for b in range(256)}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The ModelProto: pieces in rank order, then the unknown piece that models must have."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in order] != list(range(len(order))):
        raise ValueError("ranks must be 0..n-1")
    out = [
        _field(1, _field(1, mapped(x).encode()) + b"\x15" + struct.pack("<f", -float(r)))
        for r, x in enumerate(order)
    ]
    out.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2)))
    n = len(order)
    absent = _varint((1 << 64) - 1)  # -1: no such piece
    trainer = _flag(3, 2) + _flag(4, n + 1) + _flag(40, n)
    trainer += b"".join(_varint(k << 3) + absent for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one task, from the serialised model and the split pattern."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size() - 1
        back = {_BASE + b: b for b in range(256)}
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = [bytes(back[ord(c)] for c in p) for p in pieces]
        self.whole = {p: i for i, p in enumerate(pieces)}
        # White_Space of the pattern's home engine leaves out U+001C..U+001F
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.memo: dict[str, bytes] = {}
        probes = [f"{a} {b}" for a in "aZé漢7½.'_" for b in "aZé漢7½.'_"]
        self.cuts = all(self.split(x) == self.split(x[0]) + self.split(x[1:]) for x in probes)

    def _pack(self, text: str) -> bytes:
        ids: list[int] = []
        for token in self.split(text):
            piece = mapped(token.encode())
            i = self.whole.get(piece)
            if i is None:
                ids += self.sp.encode(piece)
            else:
                ids.append(i)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cuts:
            return self._pack(text)
        head, *rest = _EDGE.split(text) if _ODD.search(text) else text.split(" ")
        memo = self.memo
        out = [self._pack(head)]
        for part in rest:
            ids = memo.get(part)
            if ids is None:
                ids = self._pack(" " + part)
                if len(part) <= 64:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        table = self.bytes_of
        return b"".join([table[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)])


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids binary, decoded binary) of every whole text; the model travels by broadcast.

    The broadcast is the vocabulary, whose size does not grow with the corpus.
    """
    texts = texts_of(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))
    schema = T.StructType([texts.schema[0], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def make():
        codec = Codec(model.value, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [codec.encode(x) for x in batch.column(1).to_pylist()]
            back = [codec.decode(x) for x in ids]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[batch.schema.names[0], "ids", "decoded"])

        return step

    return map_arrow(texts, make, schema)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encode_decode's rows."""
    return coded.select(
        id_col,
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
