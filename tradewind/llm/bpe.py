"""Byte-pair encoding and decoding with a contiguous array of ranks per word.

A word starts as one part per byte. Beside the parts stands an array with the merge rank of each
adjacent pair. The array is scanned for its minimum (the leftmost, where ranks tie), the boundary
there is deleted and the ranks of the two neighbouring pairs are looked up anew, until no pair has a
rank. That suits words of a few dozen parts; longer ones keep the same order of merges with a heap.

Normal form C, white space and lower case are treated as the tokenizer file says. Null texts are
empty. Decoding joins the tokens of the vocabulary with one space, as a file without a decoder asks.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm import common
from tradewind.llm.tokens import WORD_BPE, Pieces, vocabulary_path, word_pieces

#: Parts from which on the heap is used.
LONG_WORD = 128
NO_RANK = 1 << 40


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself if printable, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in visible else spare))
        spare += byte not in visible
    return letters


class WordBpe:
    """Encoder and decoder over a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split)
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        tokens = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]

    def rank(self, left: int, right: int) -> int:
        found = self.merges.get((left, right))
        return found[0] if found else NO_RANK

    def encode_word(self, word: bytes) -> list[int]:
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > LONG_WORD:
            return self.merged_by_heap(parts)
        ranks = [self.rank(a, b) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = self.merges[parts[at], parts[at + 1]][1]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = self.rank(parts[at - 1], parts[at])
            if at < len(ranks):
                ranks[at] = self.rank(parts[at], parts[at + 1])
        return parts

    def merged_by_heap(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: pairs in a heap by (rank, place), parts in a linked list."""
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank(parts[i], parts[i + 1])) < NO_RANK]
        heapq.heapify(heap)
        while heap:
            _, at, left, right = heapq.heappop(heap)
            nxt = after[at]
            if nxt < 0 or parts[at] != left or parts[nxt] != right:
                continue  # one of the two has been merged meanwhile
            parts[at] = self.merges[left, right][1]
            parts[nxt] = -1
            after[at] = after[nxt]
            if after[at] >= 0:
                before[after[at]] = at
            for i in (before[at], at):
                j = after[i] if i >= 0 else -1
                if i >= 0 and j >= 0 and (r := self.rank(parts[i], parts[j])) < NO_RANK:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))
        return [p for p in parts if p >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        out = []
        for i, part in enumerate(self.special_split.split(piece)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                text = unicodedata.normalize("NFC", part)
                lower = "".join(map(str.lower, text))  # a letter at a time, whatever stands beside it
                for word in self.word.findall(lower):
                    out += self.encode_word(word.encode())
        return out

    def decode(self, ids) -> str:
        return " ".join([self.tokens[i] for i in ids])


_LOADED: dict[str, tuple[WordBpe, Pieces]] = {}


def loaded(path: str) -> tuple[WordBpe, Pieces]:
    if path not in _LOADED:
        bpe = WordBpe(path)
        _LOADED[path] = bpe, Pieces(word_pieces, lambda new: map(bpe.encode_piece, new))
    return _LOADED[path]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of the whole text, and decoded, the text of those ids."""

    def rows(batch: dict) -> dict:
        bpe, pieces = loaded(path)
        ids = [pieces.ids(text) for text in batch["text"]]
        return {
            "doc_id": batch["doc_id"],
            "ids": [x.astype(np.int32) for x in ids],
            "decoded": [bpe.decode(x.tolist()) for x in ids],
        }

    narrow = common.renamed_clear(docs, ("doc_id", "text"))
    return common.arrow_map(narrow, rows, f"doc_id {dict(narrow.dtypes)['doc_id']}, ids array<int>, decoded string")


def op7_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return round_trip(docs, vocabulary_path(WORD_BPE)).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
