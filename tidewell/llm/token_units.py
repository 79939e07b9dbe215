"""Texts cut where tokenizers cannot join, and the ids of the pieces.

A unit ends where a sign that is no white space meets a blank or a line feed. No byte-level token crosses
such a place, as its pattern never joins white space to what stands before it, and no piece of a
piece vocabulary does where none holds a blank after another sign or a line feed (looked up when it is
loaded). So a text's ids are those of its units, and each unit is encoded once while a worker remembers it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: Units that a worker remembers; the memory is emptied when full.
MEMORY = 300_000
#: Letters, digits and signs that all versions of the pattern's classes agree on.
PLAIN = re.compile("[\t\n\r -~¡-¬®-ɏ]*")
#: Signs of a unit, and of a text, that the merger is given at once.
LONG, LONG_TEXT = 4096, 100_000

_encoders: dict[tuple, object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: bytes that are printable in
    Latin-1 stand for themselves, the others for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}


class ByteLevel:
    """Ids by a byte-level BPE file.

    Units of common signs are merged by tiktoken, which takes the pair of the lowest rank as the file does
    where ids follow the order of its merges; all others, and all units of another kind of file, by the
    tokenizer itself (equality is tested). Strings of special tokens are plain text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = byte_signs()
        self.raw = {i: bytes(map(byte.__getitem__, t)) for t, i in model["vocab"].items() if all(c in byte for c in t)}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ordered = len(self.raw) == len(model["vocab"]) and [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged)))
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merger = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks={r: i for i, r in self.raw.items()}, special_tokens={}) if ordered else None

    def __call__(self, units: list[str]) -> list[list[int]]:
        if not self.merger:
            return [e.ids for e in self.tok.encode_batch(units, add_special_tokens=False)]
        plain = [len(u) <= LONG and PLAIN.fullmatch(u) is not None for u in units]
        others = iter(self.tok.encode_batch([u for u, p in zip(units, plain, strict=True) if not p], add_special_tokens=False))
        merge = self.merger.encode_ordinary
        return [merge(u) if p else next(others).ids for u, p in zip(units, plain, strict=True)]


class Pieces:
    """Ids by a sentencepiece file whose processor puts a blank before a text. ``apart`` says whether no
    piece crosses the end of a unit."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw: dict[int, bytes] = {}
        self.apart = True
        for i in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.raw[i] = bytes([int(piece[3:-1], 16)])
            elif not self.sp.is_control(i) and not self.sp.is_unknown(i):
                self.raw[i] = piece.replace("▁", " ").encode("utf-8")
                self.apart &= "▁" not in piece.lstrip("▁") and "\n" not in piece
        # a line feed parts the blank that the processor adds from the unit
        self.lead = self.sp.encode("\n")
        self.apart &= len(self.lead) == 2

    def __call__(self, units: list[str]) -> list[list[int]]:
        """Ids of units as they stand inside a text."""
        cut = len(self.lead)
        return [ids[cut:] for ids in self.sp.encode(["\n" + u for u in units], num_threads=1)]

    def whole(self, text: str) -> list[int]:
        """Ids of a text, with the blank that the processor adds."""
        return self.sp.encode(text)


def byte_level(path: str) -> ByteLevel:
    key = ("byte", path)
    if key not in _encoders:
        _encoders[key] = ByteLevel(path)
    return _encoders[key]


def pieces(path: str) -> Pieces:
    key = ("piece", path)
    if key not in _encoders:
        _encoders[key] = Pieces(path)
    return _encoders[key]


class TextIds:
    """Ids of whole texts as little-endian unsigned 32-bit: texts of common signs in one call, others a
    unit at a time, remembered."""

    def __init__(self, path: str):
        self.encode, self.known = byte_level(path), {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        merger = self.encode.merger
        plain = [merger is not None and len(t) <= LONG_TEXT and PLAIN.fullmatch(t) is not None for t in texts]
        others = iter(self._units([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [array("I", merger.encode_ordinary(t)).tobytes() if p else next(others) for t, p in zip(texts, plain, strict=True)]

    def _units(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY:
            self.known.clear()
        known, split = self.known, [UNIT.findall(t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(known))
        known.update(zip(new, (array("I", ids).tobytes() for ids in self.encode(new)), strict=True))
        return [b"".join(map(known.__getitem__, s)) for s in split]
