"""Best-fit-decreasing packing of tokenised documents (operator 6).

A document's ids (plus an end id) are first cut into full windows; the rest, shorter than a
window, goes to the packer. Rests are dealt to shards by a hash of the document, so no task gets
more than about ``SHARD_ROWS`` documents however large the corpus is; each shard is packed
best-fit decreasing, with a segment tree over remaining capacities that finds the tightest open
window. Each shard leaves at most a few windows part-filled, so padding does not grow with the
corpus. Sequence numbers are (shard, number in the shard), which a retried task repeats.

Padding: sequences are padded to the window, but one whose length is a power of two is kept at
that length (``padded_length``).

Defined cases: a null text counts as empty (the end id alone); an empty table gives no pieces;
repeated rows are separate documents and are all packed; ties in length go by (doc_id, content);
special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Merger
from .common import column, slices

WINDOW = 2048
SHARD_ROWS = 50_000
#: Distinct space-separated chunks that a task remembers before it starts anew.
CACHE_CHUNKS = 400_000
#: Control characters, some of which count as white space to one library only, and all above U+00FF.
_NOT_PLAIN = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\xa0]|[^\x00-\xff]|<\|")


class ChunkTokenizer:
    """Ids of texts by a ``tokenizers`` file, equal to the library's own.

    Texts whose characters are all up to U+00FF (no control characters but tab and line ends)
    take a short cut where the file is a BPE with word ends over lower-cased words: nothing there
    crosses white space, so chunks between spaces are encoded once each, their words by the matrix
    merger of :mod:`.bpe`. All other texts, and all other files, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.merger = self._merger(spec)

    def _merger(self, spec: dict) -> Merger | None:
        model, steps = spec["model"], (spec.get("normalizer") or {}).get("normalizers", [])
        first, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        plain = ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split"
                 and first.get("invert") and [r["type"] for r in rest] == ["ByteLevel"]
                 and model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("ignore_merges"))
        if not plain:
            return None
        self.find = regex.compile(first["pattern"]["Regex"]).findall
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # Byte-level alphabet: printable bytes stand for themselves, others from U+0100 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        other = iter(range(256, 512))
        name = [chr(b) if b in set(shown) else chr(next(other)) for b in range(256)]
        pairs, last = {}, -1
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = vocab[a + b]
            if made <= last:
                return None  # ids don't follow the order of merges
            pairs[vocab[a], vocab[b]] = last = made
        return Merger(np.array([vocab[c] for c in name], np.int64), np.array([vocab[c + end] for c in name], np.int64), pairs)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        split = [[c] if c.isalpha() else self.find(c) for c in chunks]
        new = list(set(chain.from_iterable(split)).difference(self.words))
        got = self.merger.encode_matches([w.encode() for w in new])
        ends = np.cumsum([len(g) for g in got]) * 4
        flat, start = np.concatenate([np.zeros(0, np.int64), *got]).astype("<u4").tobytes(), 0
        for w, end in zip(new, ends.tolist()):
            self.words[w] = flat[start:end]
            start = end
        words = self.words
        for c, ws in zip(chunks, split):
            self.known[c] = words[c] if len(ws) == 1 and ws[0] == c else b"".join([words[w] for w in ws])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
            self.words.clear()
        whole = [i for i, t in enumerate(texts) if self.merger is None or _NOT_PLAIN.search(t)]
        alone = dict(zip(whole, self._library([texts[i] for i in whole])))
        split = [[] if i in alone else t.lower().split() for i, t in enumerate(texts)]
        self._learn(list(set(chain.from_iterable(split)).difference(self.known)))
        get = self.known.__getitem__
        return [np.frombuffer(alone[i] if i in alone else b"".join(map(get, chunks)), "<u4") for i, chunks in enumerate(split)]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


class CapacityTree:
    """Segment tree over capacities 0..size-1: which have an open window; tightest fit in O(log)."""

    def __init__(self, size: int):
        self.leaves = 1 << (size - 1).bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, on: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = on
        while i > 1:
            i >>= 1
            on = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == on:
                break
            self.any[i] = on

    def tightest(self, need: int) -> int:
        """The smallest capacity >= need with an open window, or -1."""
        i = need + self.leaves
        if i >= 2 * self.leaves:
            return -1
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:  # a right sibling holds larger capacities
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each length; the lengths come in decreasing order."""
    tree, open_ = CapacityTree(window + 1), [[] for _ in range(window + 1)]
    number, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths):
        room = tree.tightest(n)
        if room < 0:
            room, w, made = window, made, made + 1
        else:
            w = open_[room].pop()
            if not open_[room]:
                tree.set(room, False)
        number[i], offset[i] = w, window - room
        if room > n:
            if not open_[room - n]:
                tree.set(room - n, True)
            open_[room - n].append(w)
    return number, offset


def tokenise(df: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, text: str = "text",
             doc_id: str = "doc_id") -> DataFrame:
    """A row per document: its key, doc_tokens and the CRC-32 of each full window and of the rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for part in slices(batches, text):
            total, crcs = [], []
            for ids in tok.encode([t or "" for t in column(part, text).to_pylist()]):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                total.append(len(ids))
                crcs.append([zlib.crc32(ids[i:i + window].tobytes()) for i in range(0, len(ids), window)])
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), column(part, "_k"), pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                names=["doc_id", "_k", "doc_tokens", "crcs"])

    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(text), F.xxhash64(text).alias("_k"))
    return src.mapInArrow(run, "doc_id long, _k long, doc_tokens long, crcs array<long>")


def pack(df: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, text: str = "text",
         doc_id: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length."""
    rows = df.count()
    shards = max(1, -(-rows // shard_rows))
    docs = tokenise(df, path, end_id, window, text, doc_id).withColumn(
        "_shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "_k"), F.lit(shards)).cast("int"))

    def place(pdf):
        import pandas as pd
        pdf = pdf.sort_values(["doc_id", "_k"], kind="stable").reset_index(drop=True)
        n = pdf["doc_tokens"].to_numpy()
        full, rest = n // window, n % window
        order = np.lexsort((np.arange(len(n)), -rest))
        order = order[rest[order] > 0]
        number, offset = best_fit_decreasing(rest[order].tolist(), window)
        bins = int(number.max()) + 1 if len(number) else 0
        used = np.bincount(number, weights=rest[order], minlength=bins).astype(np.int64)
        pieces = -(-n // window)
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = piece < full[doc]
        seq, off, length = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.full(len(doc), window)
        seq[whole] = bins + np.arange(int(whole.sum()))
        last = np.full(len(n), -1, np.int64)
        last[order] = np.arange(len(order))
        at = last[doc[~whole]]
        seq[~whole], off[~whole], length[~whole] = number[at], offset[at], rest[doc[~whole]]
        size = np.full(len(doc), window)
        fill = used[seq[~whole]] if bins else np.zeros(0, np.int64)
        size[~whole] = np.where((fill & (fill - 1)) == 0, fill, window)
        shard = int(pdf["_shard"].iloc[0])
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].to_numpy()[doc], "start": piece * window, "length": length,
            "ids_crc32": np.concatenate(pdf["crcs"].tolist()).astype(np.int64), "doc_tokens": n[doc],
            "sequence_id": (np.int64(shard) << 36) + seq, "offset": off, "padded_length": size})

    return docs.groupBy("_shard").applyInPandas(place, T.StructType([
        T.StructField(c, T.LongType()) for c in
        ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")]))
