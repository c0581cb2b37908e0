"""Byte-pair encoding by a queue of merges over linked symbols, and decoding by the vocabulary's strings.

The symbols of a unit (what the pre-tokenizer leaves together) are a doubly linked list. A priority queue holds the
merges that its neighbours allow, by rank and then by place. The first entry is applied if the pair it was made for still stands
there, else it is stale and skipped; a merge links its symbol to both neighbours and queues the two new pairs. So
a unit of n symbols takes n log n steps, however long it is. Each distinct piece of a batch is merged once, and
a table of pieces bounded in bytes outlives the batch (``tokenize.BatchEncoder``).

Decoding strings together the bytes that each id stands for; bytes that aren't UTF-8 become U+FFFD.

Edge cases: a null text counts as empty, which has no ids and decodes to an empty text; null ids decode to an empty
text; an id outside the vocabulary is an error, as is a file of another kind of model; strings of added tokens in a text are
those tokens; very long texts and units are whole, texts are handled some MB at a time; repeated rows are encoded each; other
columns are kept by ``decode`` and not read by ``encode``, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import boxed, byte_slices, quoted, unboxed
from .tokenize import _WRITTEN, BatchEncoder, _byte_characters

_LOW = (1 << 32) - 1
#: Ids whose strings are joined at once.
SLICE_IDS = 1 << 20
#: Units of up to so many bytes are kept, so many at a time: a piece with a mark shares its letters with the piece without.
UNIT_BYTES, UNITS = 32, 1 << 17
_open: dict[str, "MergeEncoder"] = {}


def merged(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """``symbols`` with all merges applied, lowest rank first; ``merges``: left << 32 | right to (rank, merged symbol)."""
    n, symbols = len(symbols), list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [merges[pair][0] << 32 | at for at in range(n - 1) if (pair := symbols[at] << 32 | symbols[at + 1]) in merges]
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        at = entry & _LOW
        left, right = symbols[at], after[at]
        if left < 0 or right == n:
            continue
        found = merges.get(left << 32 | symbols[right])
        if found is None or found[0] != entry >> 32:  # stale: another merge has taken one of the two
            continue
        symbols[at], symbols[right] = found[1], -1
        after[at] = following = after[right]
        if following < n:
            before[following] = at
            new = merges.get(found[1] << 32 | symbols[following])
            if new:
                heapq.heappush(queue, new[0] << 32 | at)
        prior = before[at]
        if prior >= 0:
            new = merges.get(symbols[prior] << 32 | found[1])
            if new:
                heapq.heappush(queue, new[0] << 32 | prior)
    return [s for s in symbols if s >= 0]


class MergeEncoder(BatchEncoder):
    """Ids of texts for a byte-level BPE file; the library only cuts a text into units."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte_level = (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not byte_level or not plain or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE file")
        self.vocab: dict[str, int] = model["vocab"]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a] << 32 | self.vocab[b]] = rank, self.vocab[a + b]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: Longest first, so that of two that start at one place the longer is taken.
        self.marks_of_added = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        written = {chr(c): b for b, c in _WRITTEN.items()}
        held = [b""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.added.items()]:
            held[i] = bytes(written.get(c, ord(c) & 255) for c in token) if token not in self.added else token.encode()
        #: The bytes of each id.
        self.strings = pa.array(held, pa.binary())
        self.units: dict[str, list[int]] = {}
        super().__init__(path)

    def _unit(self, unit: str) -> list[int]:
        """Ids of a unit, written as one character per byte."""
        known = self.units.get(unit)
        if known is None:
            known = merged([self.vocab[c] for c in unit], self.merges)
            if len(unit) <= UNIT_BYTES:
                if len(self.units) >= UNITS:
                    self.units.clear()
                self.units[unit] = known
        return known

    def _plain(self, text: str) -> list[int]:
        return [i for unit, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) for i in self._unit(unit)] if text else []

    def _whole(self, text: str) -> list[int]:
        out, at = [], 0
        for found in self.marks_of_added.finditer(text):
            out += [*self._plain(text[at : found.start()]), self.added[found[0]]]
            at = found.end()
        return out + self._plain(text[at:])

    def _letters(self, word: str, space: bool) -> list[int]:
        return self._unit(f"{'Ġ' * space}{word}" if word.isascii() else _byte_characters(f"{' ' * space}{word}"))

    def ids_of(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text."""
        sizes, ids = self.encode(texts, 0)  # with an id after each text
        until = np.cumsum(sizes)
        own = np.ones(len(ids), bool)
        own[until - 1] = False
        return pa.ListArray.from_arrays(pa.array(np.append(0, until - np.arange(1, len(sizes) + 1)).astype(np.int32)), pa.array(ids[own].astype(np.int32)))

    def texts_of(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        ids = pc.fill_null(ids, pa.scalar([], ids.type)) if ids.null_count else ids
        sizes = pc.list_value_length(ids).to_numpy()
        strings = self.strings.take(pc.list_flatten(ids))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), strings), b"")
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:  # not all of it is UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


def merge_encoder(path: str) -> MergeEncoder:
    """The worker's encoder for a tokenizer file, opened once."""
    if path not in _open:
        _open[path] = MergeEncoder(path)
    return _open[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row: the ids of its whole text by the file at ``path``, which all workers can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = merge_encoder(path)
        for part in byte_slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), e.ids_of(part.column(1))], names=["doc_id", "ids"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("t")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text that their ids stand for, as column ``text_col`` (which they may not have yet)."""
    if text_col.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"there is a column {text_col} already")
    held = boxed(rows, ids=F.col(quoted(ids_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = merge_encoder(path)
        for batch in batches:
            ids = batch.column(1)
            until = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_IDS
            borders = [0, *(np.flatnonzero(np.diff(until)) + 1).tolist(), batch.num_rows]
            for a, z in zip(borders, borders[1:]):
                if z > a:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), e.texts_of(ids.slice(a, z - a))], names=["row", "decoded"])

    schema = T.StructType([held.schema["row"], T.StructField("decoded", T.StringType())])
    return unboxed(held.mapInArrow(run, schema), rows.columns, F.col("decoded").alias(text_col))
