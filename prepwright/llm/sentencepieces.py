"""Merge-type piece encoding by backtracking, and decoding.

A merge encoding is the one sequence of pieces in which every two neighbours, merged anew from their
characters, come out as themselves. So a text is covered from left to right with the longest piece that
matches (an Aho-Corasick automaton has found all matches) and is compatible with the piece before; where
none is, the position is marked as failed and the piece before is shortened.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from prepwright.llm.common import map_batches, texts_of

SPACE = "▁"
UNKNOWN = " ⁇ "
# Encoded units and judged pairs of pieces kept by a Python worker, which lives on after a task; a full store is emptied.
# Longer units, as of scripts without spaces, are encoded anew.
KEPT_UNITS, KEPT_PAIRS, KEPT_LENGTH = 200_000, 200_000, 32
# Bytes of a batch whose texts, ids and decoded texts a worker holds at a time, about.
PORTION = 1 << 20


class Pieces:
    """The pieces of a model file, its encoder and decoder. Only merge-type models that leave the text as
    it is but for a space before it are taken."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  　Ａ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}　Ａ":
            raise ValueError(f"{path}: the model changes texts before it encodes them")
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.unknown = model.unk_id()
        self.bytes = {i: int(self.names[i][1:-1], 16) for i in range(size) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.control = {i for i in range(size) if model.is_control(i)}
        self.ids = {self.names[i]: i for i in range(size)
                    if not (i in self.bytes or i in self.control or model.is_unknown(i) or model.is_unused(i))}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units = _Units(self)
        raw = [bytes([self.bytes[i]]) if i in self.bytes else b"" if i in self.control else
               UNKNOWN.encode() if i == self.unknown else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.array([len(r) for r in raw])
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes

        reachable = [p for p in self.ids if self.merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        known = set(reachable)
        # The next shorter piece that begins a piece; a single character is always one.
        self.shorter = {p: next(p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in known)
                        for p in reachable if len(p) > 1}

        self.unit = re.compile(self._unit_pattern([p for p in self.ids if len(p) > 1]))

    @staticmethod
    def _unit_pattern(longer: list[str]) -> str:
        """Units that no piece reaches out of, so that they can be encoded one by one: spaces and a word, or
        spaces and a run of signs. Signs are the ASCII characters other than letters, and what pieces join
        them to. Where pieces go on past a word's end or join signs to letters, the whole text is a unit."""
        signs = {chr(c) for c in range(128) if not chr(c).isalpha()}
        joined = {pair for p in longer for pair in zip(p, p[1:]) if SPACE not in pair}
        while more := {c for pair in joined if len(signs.intersection(pair)) == 1 for c in pair} - signs:
            signs |= more
        if any(SPACE in p.lstrip(SPACE) for p in longer) or any(c.isalpha() for c in signs):
            return "(?s).+"
        inside = re.escape("".join(sorted(signs)))
        return f"{SPACE}*[^{SPACE}{inside}]+|{SPACE}*[{inside}]+|{SPACE}+"

    def merged(self, text: str) -> list[str]:
        """Characters merged pair by pair: best score first, of equal scores the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores),
                       default=None)
            if best is None:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def split(self, unit: str) -> list[str]:
        """Pieces of a unit; a character without a piece stands alone."""
        longest, end = list(unit), len(unit)
        for last, piece in self.automaton.iter(unit):
            longest[last + 1 - len(piece)] = piece  # matches of one start come with growing ends
        pieces: list[str] = []
        at, failed, piece = 0, 0, longest[0] if unit else ""
        while at < end:
            after = at + len(piece)
            if not failed >> after & 1 and (not pieces or self.compatible(pieces[-1], piece)):
                pieces.append(piece)
                at = after
                if at < end:
                    piece = longest[at]
            elif piece in self.shorter:
                piece = self.shorter[piece]
            else:
                failed |= 1 << at
                piece = pieces.pop()
                at -= len(piece)
        return pieces

    def encode_unit(self, unit: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split(unit):
            if piece in self.ids:
                ids.append(self.ids[piece])
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, without the space that encoding puts before it."""
        sizes = self.raw_sizes[ids]
        ends = np.cumsum(sizes)
        raw = self.raw[np.repeat(self.raw_starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ids) else 0)].tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._with_broken_bytes(ids)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and self.names[first].startswith(SPACE) else text

    def _with_broken_bytes(self, ids: np.ndarray) -> str:
        parts, pending = [], bytearray()
        for i in [*ids.tolist(), -1]:
            if i in self.bytes:
                pending.append(self.bytes[i])
                continue
            parts.append(_from_bytes(bytes(pending)))
            pending = bytearray()
            if i >= 0:
                parts.append(self.raw[self.raw_starts[i]:self.raw_starts[i] + self.raw_sizes[i]].tobytes().decode())
        return "".join(parts)

    def encode(self, text: str) -> np.ndarray:
        units = self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return np.frombuffer(b"".join(map(self.units.__getitem__, units)), np.int32)


class _Units(dict):
    """Encoded units, made when they are first asked for."""

    def __init__(self, model: Pieces):
        super().__init__()
        self.model = model

    def __missing__(self, unit: str) -> bytes:
        found = np.array(self.model.encode_unit(unit), np.int32).tobytes()
        if len(unit) <= KEPT_LENGTH:
            if len(self) >= KEPT_UNITS:
                self.clear()
            self[unit] = found
        return found


def _from_bytes(raw: bytes) -> str:
    """Characters of a run of byte pieces; each byte that is part of none becomes U+FFFD."""
    text, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                text.append(raw[at:at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            text.append("�")
            at += 1
    return "".join(text)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The model of a path; a Python worker reads it once."""
    return Pieces(path)


def round_trips(docs: DataFrame, model_path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns to ``carry``, ids (array of int) and decoded (string), without begin
    and end ids.

    ``model_path`` is a file that every executor has. A missing or empty text has no ids and decodes to
    the empty text; repeated rows give a row each; carried columns named ids or decoded are replaced. A text of
    any length is encoded unit by unit, and its ids are the only thing kept of it.
    """
    carry = [c for c in carry if c.lower() not in ("ids", "decoded")]

    def run(batches):
        model = pieces(model_path)
        for batch in batches:
            ids = [model.encode(t) for t in texts_of(batch)]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) for i in ids], out=offsets[1:])
            yield {c: batch.column(c) for c in carry} | {
                "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]))),
                "decoded": [model.decode(i) for i in ids]}
    schema = StructType([*docs.select(*carry).schema.fields, *StructType.fromDDL("ids array<int>, decoded string").fields])
    return map_batches(docs.select(*dict.fromkeys([*carry, "text"])), run, schema, PORTION)
