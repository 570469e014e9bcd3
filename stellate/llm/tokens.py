"""Token ids of whole texts from a public vocabulary file."""

from __future__ import annotations

import json
import os
import string
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The split this class relies on: letters, single digits and runs of other characters, white space dropped.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TAIL = string.punctuation.replace("'", "")
#: Letters that Arrow, Python and the library lower-case alike.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
#: Words remembered per worker before those that it last met longer ago are let go.
REMEMBERED_WORDS = 120_000


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def _laid(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat``, of which ``size`` holds the lengths, put in the order ``at``; and where each begins, the end included."""
    sizes = size[at]
    before = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat((np.cumsum(size) - size)[at] - before[:-1], sizes)
    places += np.arange(before[-1])
    return flat[places], before


class WordEncoder:
    """Encodes many texts at once by their distinct chunks between ASCII white space.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its chunks in a row. A chunk
    of letters with trailing punctuation is two words to the vocabulary, which are remembered; every other form goes through the
    library. Texts and Latin chunks are split, chunks and words made distinct and ids put in place by array operations.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parts = json.loads(definition)["pre_tokenizer"].get("pretokenizers", [{}])
        if parts[0].get("pattern", {}).get("Regex") != _SPLIT:
            raise ValueError("this vocabulary doesn't drop white space; its chunks can't be encoded one by one")
        self._all = Tokenizer.from_str(definition)
        self._tokenize = self._all.model.tokenize
        self._letters = byte_letters()
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return array("H", ids).tobytes()

    def _ids(self, word: str) -> bytes:
        held = self._words.get(word)
        if held is None:
            held = self._older.get(word)
            if held is None:
                plain = word if word.isascii() else "".join([self._letters[b] for b in word.encode()])
                held = self._pack([t.id for t in self._tokenize(plain)])
            self._words[word] = held
        return held

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(_TAIL)
        # letters that lower-casing one by one and composing treat alike in Python and in the library
        if word.isalpha() and (word.isascii() or max(word) <= "\xff" or word == unicodedata.normalize("NFC", word.lower())):
            held = self._ids(word.lower())
            return held if len(word) == len(chunk) else held + self._ids(chunk[len(word) :])
        return self._pack(self._all.encode(chunk, add_special_tokens=False).ids) if chunk else b""

    def forget(self) -> None:
        """Lets go of the remembered words."""
        self._words, self._older = {}, {}

    def _parts(self, chunks: pa.StringArray) -> tuple[list[bytes], np.ndarray]:
        """The ids of the distinct parts of chunks, and each chunk's two parts by number; the second may be empty."""
        rest = pc.utf8_ltrim(chunks, characters=_LETTERS)
        letters = pc.less(pc.binary_length(rest), pc.binary_length(chunks))
        plain = pc.and_(letters, pc.equal(pc.binary_length(pc.ascii_ltrim(rest, characters=_TAIL)), 0)).to_numpy(zero_copy_only=False)
        mine = pa.array(plain)
        words = pc.utf8_lower(pc.ascii_rtrim(chunks.filter(mine), characters=_TAIL))
        coded = pa.concat_arrays([words, rest.filter(mine), pa.array([""], words.type)]).dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        packed = list(map(self._words.get, names))
        for i, held in enumerate(packed):
            if held is None:
                packed[i] = self._ids(names[i])
        at = coded.indices.to_numpy()
        parts = np.full((len(chunks), 2), at[-1], np.int64)
        parts[plain] = at[:-1].reshape(2, -1).T
        parts[~plain, 0] = np.arange(len(packed), len(packed) + np.count_nonzero(~plain))
        return packed + [self._chunk(c) for c in chunks.filter(pa.array(~plain)).to_pylist()], parts

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. Nulls have none."""
        if len(self._words) > REMEMBERED_WORDS:
            self._older, self._words = self._words, {}
        chunks = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = chunks.flatten().dictionary_encode()
        packed, parts = self._parts(coded.dictionary)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 2
        flat, _ = _laid(np.frombuffer(b"".join(packed), np.uint16), sizes, parts.ravel())
        flat, before = _laid(flat, sizes[parts].sum(axis=1), coded.indices.to_numpy())
        ends = np.cumsum(chunks.value_lengths().to_numpy())
        return flat, np.diff(before[np.concatenate([[0], ends])])

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(definition: str) -> WordEncoder:
    """One encoder per worker and vocabulary, kept between tasks."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]
