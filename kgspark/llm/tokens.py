"""Tokenize whole texts with a public BPE vocabulary, each distinct piece of a batch only once.

A text is cut where the vocabulary's own pre-tokenizer must cut too, so the ids of the pieces
put together are the ids of the text. Texts for which that isn't certain (white space other
than single blanks and line ends, or the content of an added token such as <|endoftext|>) go to the
tokenizer as they are.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that isn't a single blank or line end inside a text.
_IRREGULAR = (
    r"[ \n][ \n]|^[ \n]|[ \n]$|[\x00\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
#: Marks a piece that has no blank before it; texts that hold this character are irregular.
_NO_BLANK = "\x00"


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins that byte-level BPE vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceTokenizer:
    """Ids of texts by a tokenizers file.

    lower: the vocabulary has word ends, drops white space and lower-cases (pieces are words);
    else it is byte-level with blanks kept (pieces are words with the blank before them).
    keep: how many pieces' ids stay in memory between batches.
    """

    def __init__(self, path: str, lower: bool, keep: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.added = "(?i)" + "|".join(added) if added else None
        self.lower, self.keep, self.known = lower, keep, {}
        self.model = self.whole.model
        self.spelling = str.maketrans(_byte_alphabet())

    def _part(self, letters: str) -> list[int]:
        if not letters.isascii() or "\n" in letters:
            letters = letters.encode().decode("latin-1").translate(self.spelling)
        return [t.id for t in self.model.tokenize(letters)]

    def _simple(self, s: str) -> bool:
        return s.isalpha() and (s.isascii() or unicodedata.is_normalized("NFC", s) and (not self.lower or s == s.lower()))

    def _piece(self, piece: str) -> list[int]:
        """Letters, or full stops and commas, go to the model at once; the rest takes the whole way."""
        if not piece:
            return []
        if self.lower:
            if self._simple(piece) or not piece.strip(".,"):
                return self._part(piece)
        elif piece[0] == _NO_BLANK:
            piece = piece[1:]
            if self._simple(piece) or not piece.strip(".,") or piece == "\n":
                return self._part(piece) if piece else []
        elif self._simple(piece):
            return [t.id for t in self.model.tokenize("\u0120" + piece)] if piece.isascii() else self._part(" " + piece)
        else:
            piece = " " + piece
        return self.whole.encode(piece, add_special_tokens=False).ids

    def _unique(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, known = [], self.known
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = array("I", self._piece(p)).tobytes()
                if len(known) < self.keep:
                    known[p] = ids
            found.append(ids)
        lengths = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        return np.frombuffer(b"".join(found), dtype=np.uint32), lengths

    def encode(self, texts: pa.Array, words_at_once: int = 60_000):
        """Yield (row, ids) for each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.lower:
            marked = pc.replace_substring_regex(texts, r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,]+)([ \n]|$)", r"\1 \2\3")
            lists = pc.ascii_split_whitespace(pc.ascii_lower(marked))
            odd = np.zeros(len(texts), dtype=bool)
        else:
            odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
            marked = pc.replace_substring_regex(texts, r"([\pL\pN])([.,]+)([ \n]|$)", rf"\1 {_NO_BLANK}\2\3")
            marked = pc.replace_substring(marked, "\n", f" {_NO_BLANK}\n {_NO_BLANK}")
            lists = pc.split_pattern(pc.binary_join_element_wise(_NO_BLANK, marked, ""), " ")
        if self.added:  # in any case of letters: the tokenizer itself tells which of them count
            odd = odd | pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, lengths = self._unique(coded.dictionary.to_pylist())
        starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))[:-1]
        index = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts)
        row = 0
        while row < len(counts):
            begin = int(ends[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, begin + words_at_once, side="right")))
            part = index[begin : int(ends[stop - 1])]
            n = lengths.take(part)
            upto = np.cumsum(n, dtype=np.int64)
            at = np.repeat(starts.take(part) - (upto - n), n)
            at += np.arange(len(at))
            ids = flat.take(at)
            edges = np.concatenate(([0], upto))[np.concatenate(([0], ends[row:stop] - begin))]
            for k in range(row, stop):
                if odd[k]:
                    yield k, np.array(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
                else:
                    yield k, ids[edges[k - row] : edges[k - row + 1]]
            row = stop


_LOADED: dict[tuple, PieceTokenizer] = {}


def tokenizer(path: str, lower: bool, keep: int = 800_000) -> PieceTokenizer:
    """One per Python worker and file."""
    key = (path, lower, keep)
    if key not in _LOADED:
        _LOADED[key] = PieceTokenizer(*key)
    return _LOADED[key]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)
