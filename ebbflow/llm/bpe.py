"""Byte-pair encoding with word ends, and decoding, of whole texts.

A word's parts are held in one contiguous array with the rank of each part and its
right neighbour beside it; the smallest rank is found by a scan, the boundary at it
is deleted and the two ranks next to it are refreshed.  Scanning is quadratic in a
word's length, so words over ``SHORT_WORD`` symbols take a heap over linked parts,
which makes the same merges in the same order.

Defined results: a null or blank text has no ids and decodes to the empty string;
special tokens written in a text become their ids, as in the library; repeated rows
are encoded each; only ``doc_id`` and ``text`` are read, so other columns cannot
clash; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import table

SHORT_WORD = 64
#: Words remembered by each Python worker; beyond it the memory starts afresh.
REMEMBERED_WORDS = 400_000
#: Text characters that one output batch stands for, about.
BATCH_CHARS = 4_000_000
NO_RANK = 1 << 30
END = "</w>"


def byte_symbols() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder of a ``tokenizers`` file of the word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        merges = spec["model"]["merges"]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        symbols = byte_symbols()
        self.inner = [vocab[symbols[b]] for b in range(256)]
        self.last = [vocab[symbols[b] + END] for b in range(256)]
        (split,) = (p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[str, tuple[int, ...]] = {}

    def merge_short(self, parts: list[int]) -> list[int]:
        rank, made = self.ranks.get, self.made
        ranks = [rank(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NO_RANK:
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.ranks.get
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, *pair) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            least, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[least], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            raw = word.encode("utf-8")
            parts = [*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]]
            found = tuple(self.merge_short(parts) if len(parts) <= SHORT_WORD else self.merge_long(parts))
            if len(raw) <= SHORT_WORD:
                if len(self.known) >= REMEMBERED_WORDS:
                    self.known.clear()
                self.known[word] = found
        return found

    def normal(self, text: str) -> str:
        """Composed and lower-cased letter by letter: a final sigma has no form of its own."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str) -> np.ndarray:
        pieces = self.specials.split(text) if "<|" in text else [text]
        ids: list = []
        for k, piece in enumerate(pieces):
            if k % 2:
                ids.append((self.special[piece],))
            else:
                ids.append(chain.from_iterable(map(self.word, self.words(self.normal(piece)))))
        return np.fromiter(chain.from_iterable(ids), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            held, ids, decoded, chars = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                held.append(doc_id)
                ids.append(model.encode(text))
                decoded.append(model.decode(ids[-1]))
                chars += len(text)
                if chars >= BATCH_CHARS:
                    yield packed(held, ids, decoded)
                    held, ids, decoded, chars = [], [], [], 0
            if held:
                yield packed(held, ids, decoded)

    def packed(held: list, ids: list[np.ndarray], decoded: list[str]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )


def with_digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        *more,
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and the text they decode to."""
    return with_digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
