"""Token ids of whole texts from the tokenizers library, a piece between spaces at a time.

Neither public tokenizer joins characters across a space inside a text, so a text is cut at its spaces. BPE with word
ends also keeps a letter or digit and a mark such as a comma apart, so its pieces are cut before marks that end them.
Each distinct piece goes through the library once per Python worker, and a text's ids are those of its pieces. The new
pieces of a text for byte-level BPE share one call of the library. For BPE with word ends, Arrow cuts many texts at once,
each of their distinct pieces is looked up once, and new words share texts. Workers keep at most CACHE_PIECES (there
CACHE_WORDS) pieces of at most CACHE_CHARS characters; others go through the library each time, with the same result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tradewind.llm import common

CACHE_PIECES = 1_000_000
CACHE_WORDS = 500_000
CACHE_CHARS = 64
CACHE_MARKS = 1_000
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: Stands for a cut in a text without this character.
CUT = "\x01"
_BEFORE_SPACE = re.compile(r"(?=[ \n])")
#: Pieces that can be encoded in one text, a line end apart, without a change to their ids.
_SIMPLE = re.compile(r"[ \n]?\S+")
MARKS = ".,;:!?"
#: Letters and digits that no normal form changes and that lower case leaves letters.
PLAIN = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÄÖÜÉÈÀÇÑßäöüéèêàâçñóíáúîôûïë")

#: Letters of words that no normal form changes and whose lower case is one such letter.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(f"[{_LETTERS}]+")
#: A word and marks at its end, which are words of their own. Without <, | and >, no mark belongs to an added token.
_WORD_AND_MARKS = f"^(?P<word>[{_LETTERS}]+)(?P<marks>[-.,;:!?#*$%&()\"'/]*)$"
#: Words that go through the library in one text, and other pieces in one call.
WORDS_OF_A_TEXT, PIECES_OF_A_CALL = 400, 64


def without_marks(pieces: list[str]) -> list[str]:
    """pieces, with the marks at the end of each as a piece of their own if a plain letter or digit comes before them."""
    out = []
    for piece in pieces:
        if piece[-1] in MARKS:
            stem = piece.rstrip(MARKS)
            if stem and stem[-1] in PLAIN:
                out.append(stem)
                piece = piece[len(stem) :]
        out.append(piece)
    return out


def byte_pieces(text: str) -> list[str]:
    """Pieces for byte-level BPE: cut before each space and line end. Those after white space are for joined() to undo."""
    if CUT in text:
        found = _BEFORE_SPACE.split(text)
    else:
        found = text.replace(" ", CUT + " ").replace("\n", CUT + "\n").split(CUT)
    return found if found[0] else found[1:]


def joined(found: list[str]) -> list[str]:
    """found, with a piece that ends with white space and the next as one: white space between words is encoded together."""
    out, open_ = [], []
    for piece in found:
        open_.append(piece)
        if not piece[-1].isspace():
            out.append("".join(open_))
            open_ = []
    return out + ["".join(open_)] if open_ else out


def word_pieces(text: str) -> list[str]:
    """Pieces for BPE with word ends, which drops white space: cut at spaces and line ends."""
    return without_marks([x for x in text.replace("\n", " ").split(" ") if x])


class Pieces:
    """Ids by piece; encode turns a list of new pieces into lists of ids."""

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], Iterable[Iterable[int]]]):
        self.cut, self.encode, self.known = cut, encode, {}

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def packed(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        found, known = self.cut(text or ""), self.known
        new = [x for x in dict.fromkeys(found) if x not in known]
        if not new:
            return b"".join(map(known.__getitem__, found))
        own = {}
        for piece, ids in zip(new, self.encode(new)):
            packed = np.array(ids, "<u4").tobytes()
            if len(known) < CACHE_PIECES and len(piece) <= CACHE_CHARS:
                known[piece] = packed
            else:
                own[piece] = packed
        return b"".join([known[x] if x in known else own[x] for x in found])

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text start, with the end of the last, and the ids of all texts."""
        found = [self.packed(x) for x in texts.to_pylist()]
        return starts(found), np.frombuffer(b"".join(found), "<u4")


def starts(packed: list[bytes]) -> np.ndarray:
    """Where the ids of each start, with the end of the last."""
    out = np.zeros(len(packed) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4, out=out[1:])
    return out


class WordPieces(Pieces):
    """Pieces for BPE with word ends. Words are known in lower case and without the marks at their ends."""

    def __init__(self, tokenizer):
        # without offsets into the text, which nobody reads
        super().__init__(word_pieces, lambda new: [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)])
        ids = tokenizer.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for token, i in ids.items() if token.endswith(tokenizer.model.end_of_word_suffix)]] = True

    def packed(self, text: str | None) -> bytes:
        return self.many(pa.array([text], pa.string()))[1].tobytes()

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        found = cut.values.dictionary_encode()
        parts = pc.extract_regex(found.dictionary, _WORD_AND_MARKS)
        words = pc.coalesce(pc.utf8_lower(pc.struct_field(parts, "word")), found.dictionary).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(parts, "marks"), "").dictionary_encode()
        distinct = [x for part in (words, marks) for x in part.dictionary.to_numpy(zero_copy_only=False).tolist()]
        own = self.packed_pieces(distinct)
        ids = pa.ListArray.from_arrays(starts(own), np.frombuffer(b"".join(own), "<u4"))
        # the ids of each distinct piece: those of its word, then those of its marks
        pairs = np.stack([words.indices.to_numpy(), marks.indices.to_numpy() + len(words.dictionary)], axis=1)
        halves = ids.take(pa.array(pairs.ravel()))
        pieces = pa.ListArray.from_arrays(halves.offsets.to_numpy()[::2], halves.values)
        taken = pieces.take(found.indices)
        return taken.offsets.to_numpy()[cut.offsets.to_numpy()], taken.values.to_numpy()

    def packed_pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        ids = list(map(known.get, pieces))
        own = self.encoded_pieces(list(dict.fromkeys([x for x, y in zip(pieces, ids) if y is None])))
        for piece, packed in own.items():
            if len(known) < CACHE_WORDS and len(piece) <= CACHE_CHARS:
                known[piece] = packed
        return [own[x] if y is None else y for x, y in zip(pieces, ids)]

    def encoded_pieces(self, new: list[str]) -> dict[str, bytes]:
        """The ids of each piece. Words share texts, where only the last id of a word is one that ends words."""
        words = [x for x in new if _WORD.fullmatch(x)]
        out = {}
        if words:
            texts = [" ".join(words[i : i + WORDS_OF_A_TEXT]) for i in range(0, len(words), WORDS_OF_A_TEXT)]
            ids = np.concatenate([np.array(x, "<u4") for x in self.encode(texts)])
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            whole = ids.tobytes()
            out = {x: whole[a:b] for x, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)}
        rest = [x for x in new if x not in out]
        for i in range(0, len(rest), PIECES_OF_A_CALL):
            call = rest[i : i + PIECES_OF_A_CALL]
            out |= {x: np.array(ids, "<u4").tobytes() for x, ids in zip(call, self.encode(call))}
        return out


class BytePieces(Pieces):
    """Pieces for byte-level BPE. No known piece ends with white space, so a text of known pieces is cut rightly."""

    def __init__(self, tokenizer):
        super().__init__(byte_pieces, lambda new: [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)])
        self.added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        [[self.line]] = self.encode(["\n"])
        self.marks: dict[str, bytes] = {}

    def packed(self, text: str | None) -> bytes:
        known = self.known
        found = self.cut(text or "")
        ids = list(map(known.get, found))
        if None not in ids:
            return b"".join(ids)
        new = dict.fromkeys([x for x, y in zip(found, ids) if y is None])
        if any(x[-1].isspace() for x in new):
            found = joined(found)
            ids = list(map(known.get, found))
            new = dict.fromkeys([x for x, y in zip(found, ids) if y is None])
        own = self.with_known_stems(new)
        own |= self.packed_pieces([x for x in new if x not in own])
        for piece, packed in own.items():
            if len(known) < CACHE_PIECES and len(piece) <= CACHE_CHARS and not piece[-1].isspace():
                known[piece] = packed
        return b"".join([own[x] if y is None else y for x, y in zip(found, ids)])

    def with_known_stems(self, new: Iterable[str]) -> dict[str, bytes]:
        """The ids of those pieces that are a known piece and marks."""
        out, known = {}, self.known
        for piece in new:
            if piece[-1] in MARKS and len(piece) <= CACHE_CHARS:
                stem = piece.rstrip(MARKS)
                if stem in known and stem[-1] in PLAIN:
                    out[piece] = known[stem] + self.mark_ids(piece[len(stem) :])
        return out

    def mark_ids(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= CACHE_MARKS:
                self.marks.clear()
            self.marks |= self.packed_pieces([marks])
        return self.marks[marks]

    def packed_pieces(self, new: list[str]) -> dict[str, bytes]:
        """The ids of each piece. Simple pieces are lines of one text, which costs the library less than many texts."""
        simple = [x for x in new if _SIMPLE.fullmatch(x)]
        lines = "\n".join([x[1:] if x[0] == "\n" else x for x in simple])
        if any(x in lines for x in self.added):
            simple = []
        out = {}
        if simple:
            ids = np.array(self.encode([lines])[0], "<u4")
            ends = np.flatnonzero(ids == self.line) * 4
            whole, line = ids.tobytes(), np.array([self.line], "<u4").tobytes()
            for piece, a, b in zip(simple, [0, *(ends + 4).tolist()], [*ends.tolist(), len(whole)], strict=True):
                out[piece] = line + whole[a:b] if piece[0] == "\n" else whole[a:b]
        rest = [x for x in new if x not in out]
        return out | {x: np.array(ids, "<u4").tobytes() for x, ids in zip(rest, self.encode(rest))} if rest else out


_LOADED: dict[str, Pieces] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def library(path: str) -> Pieces:
    """The worker's Pieces over the tokenizer file; the vocabulary is read once per worker and operator."""
    common.claim(_LOADED)
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = (WordPieces if os.path.basename(path) == WORD_BPE else BytePieces)(tokenizer)
    return _LOADED[path]
