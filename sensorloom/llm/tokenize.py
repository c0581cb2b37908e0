"""Exact token ids of whole texts from a ``tokenizers`` file, a batch of texts at a time.

Both vocabularies in use cut a text before each single space or line end that stands between two
other characters, so the ids of a text are those of its pieces in a row. A batch's pieces are numbered by
Arrow, each distinct piece is encoded once, and numpy strings the ids together. A table of pieces, bounded
in bytes, outlives the batch. Runs of white space, and white space of other kinds, stay within a piece.

Edge cases: a null text counts as empty and has no ids; texts of any length are whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import coded, spread

#: White space that isn't a single space or line end between other characters.
_UNEVEN = "[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z|[\\t\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_BORDER = re.compile(r"(?<=\S)(?=[ \n]\S)")
_open: dict[str, "BatchEncoder"] = {}

# Byte-level vocabularies write each byte as a character: itself where it prints, else the next one from 256 on.
_PRINTS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _PRINTS]
_WRITTEN = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def _byte_characters(text: str) -> str:
    return text.encode().decode("latin-1").translate(_WRITTEN)


class BatchEncoder:
    """Ids of texts; a piece is what stands between two spaces, with a line end before it kept as its first character."""

    #: Bytes of the table of known pieces.
    TABLE_BYTES = 40 << 20

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keeps_space = self.tokenizer.normalizer is None
        self.line_end = self._whole("\n") if self.keeps_space else []
        self.marks = {p: self._whole(p) for p in (".", ",")}
        self._keep(pa.array([], pa.string()), np.zeros(1, np.int64), np.empty(0, np.uint32))

    def _keep(self, pieces: pa.Array, first: np.ndarray, ids: np.ndarray) -> None:
        self.pieces, self.first, self.ids = pieces, first, ids

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, word: str, space: bool) -> list[int]:
        """Ids of a piece of letters only, which is one unit of the pre-tokenizer."""
        if self.keeps_space:
            unit = f"{'Ġ' * space}{word}" if word.isascii() else _byte_characters(f"{' ' * space}{word}")
        elif word.isascii():
            unit = word.lower()
        else:
            normal = self.tokenizer.normalizer.normalize_str(word)
            if not normal.isalpha():
                return self._whole(word)
            unit = _byte_characters(normal)
        return [t.id for t in self.model.tokenize(unit)]

    def _piece(self, piece: str) -> list[int]:
        space = not piece.startswith("\n")
        word, head = (piece, []) if space else (piece[1:], self.line_end)
        if word.isalpha():
            return head + self._letters(word, space)
        if word[-1:] in self.marks and word[:-1].isalpha():
            return head + self._letters(word[:-1], space) + self.marks[word[-1]]
        return head + self._whole(f" {word}" if word and space and self.keeps_space else word)

    def _known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, ids) of distinct pieces."""
        at = pc.index_in(pieces, value_set=self.pieces)
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        missing = pieces.take(pa.array(new))
        found = [self._piece(p) for p in missing.to_pylist()]
        place[new] = len(self.pieces) + np.arange(len(new))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first = np.append(self.first, self.first[-1] + np.cumsum(sizes))
        ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))])
        start, size = first[place], first[place + 1] - first[place]
        every = pa.concat_arrays([self.pieces, missing])
        if every.nbytes + first.nbytes + ids.nbytes <= self.TABLE_BYTES:
            self._keep(every, first, ids)
        elif pieces.nbytes + 8 * len(pieces) + 4 * int(size.sum()) <= self.TABLE_BYTES:  # start again with what this batch holds
            self._keep(pieces, np.append(0, np.cumsum(size)), ids[spread(start, size)])
        else:
            self._keep(pieces.slice(0, 0), np.zeros(1, np.int64), ids[:0])
        return start, size, ids

    def _string(self, cut: pa.ListArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of texts given as pieces, an empty last one standing for the end id."""
        offsets = cut.offsets.to_numpy().astype(np.int64)
        number, distinct = coded(cut.values)
        start, size, ids = self._known(distinct)
        start, size = start[number], size[number]
        extra = len(self.line_end)
        start[offsets[:-1]] += extra  # the first piece of a text has no line end before it
        size[offsets[:-1]] -= extra
        start[offsets[1:] - 1], size[offsets[1:] - 1] = len(ids), 1
        total = np.add.reduceat(size, offsets[:-1]) if len(cut) else np.empty(0, np.int64)
        return total, np.append(ids, np.uint32(end_id))[spread(start, size)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids in a row), each text followed by ``end_id``."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.keeps_space:  # white space is dropped, and letters are lower-cased
            even = pc.binary_join_element_wise(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ", "")
            return self._string(pc.split_pattern(even, " "), end_id)
        even = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), " ", "")
        uneven = np.flatnonzero(pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False))
        if not len(uneven):
            return self._string(pc.split_pattern(even, " "), end_id)
        rest = np.setdiff1d(np.arange(len(texts)), uneven)
        units = []
        for text in texts.take(pa.array(uneven)).to_pylist():
            first, *more = _BORDER.split(text)
            units.append([f"\n{first}", *(u[1:] if u[0] == " " else u for u in more), ""])
        parts = self._string(pc.split_pattern(even.take(pa.array(rest)), " "), end_id), self._string(pa.array(units, pa.list_(pa.string())), end_id)
        size, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(np.concatenate([rest, uneven]))
        return size[order], ids[spread((np.cumsum(size) - size)[order], size[order])]


def encoder(path: str) -> BatchEncoder:
    """The worker's encoder for a tokenizer file, opened once."""
    if path not in _open:
        _open[path] = BatchEncoder(path)
    return _open[path]


def binary_rows(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """An Arrow binary value for each of ``sizes`` runs of ``values``."""
    offsets = (np.append(0, np.cumsum(sizes)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
