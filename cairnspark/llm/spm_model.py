"""Reader of SentencePiece model files (protobuf wire format; no protobuf library)."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class Piece:
    text: str
    score: float = 0.0
    kind: int = NORMAL


@dataclass
class Model:
    pieces: list[Piece] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    normalizer: str = ""
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def names(self) -> dict[str, int]:
        return {p.text: i for i, p in enumerate(self.pieces)}

    @property
    def unk_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p.kind == UNKNOWN), 0)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes):
    """(number, value) of each field: ints for varints, bytes for all else."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} is not part of a model file")
        yield number, value


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            f = dict(fields(value))
            model.pieces.append(Piece(f.get(1, b"").decode("utf-8"), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(fields(value))
            model.model_type, model.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif number == 3:
            f = dict(fields(value))
            model.normalizer, model.charsmap = f.get(1, b"").decode(), f.get(2, b"")
            model.add_dummy_prefix, model.remove_extra_whitespaces, model.escape_whitespaces = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    return model
