"""Token ids of texts by the tokenizers library, with every distinct word tokenised once per worker."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Fixed value: the pre-tokenizer pattern of a vocabulary whose words never cross white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern for lower-case printable ASCII.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Letters below this need no normalisation but lower case.
PLAIN = "\u0180"
#: Words, and the vocabulary's pieces of words, that one worker remembers before it starts afresh. They
#: bound its memory, not its results. Pieces cost most to work out, and fewer of them are different.
MOST_WORDS, MOST_PIECES = 400_000, 900_000


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes that are no printable Latin-1 character."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {byte: 256 + k for k, byte in enumerate(b for b in range(256) if b not in printable)}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids.

    A vocabulary that drops white space and never merges across it gives the ids of a text as those of
    its words, one after the other, so each distinct word is tokenised once. Any other vocabulary
    encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self._by_word = (
            steps[0].get("pattern", {}).get("Regex") == WORD_PATTERN
            and bool(steps[0].get("invert"))
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and not any(t["lstrip"] or t["rstrip"] or any(map(str.isspace, t["content"])) for t in spec["added_tokens"])
        )
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._bytes = [k.to_bytes(4, "little") for k in range(1 + max(self._tokenizer.get_vocab().values()))]
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._by_word:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, known = text.replace("\n", " ").split(" "), self._words
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > MOST_WORDS:
            known.clear()
            new = set(words)
        for word in new:
            known[word] = self._word(word)
        return b"".join(map(known.__getitem__, words))

    def _word(self, word: str) -> bytes:
        stem = word[:-1] if word[-1:] in (".", ",") else word
        if stem.isalpha() and max(stem) < PLAIN and (lower := stem.lower()).isalpha():
            if not lower.isascii():
                lower = lower.encode().decode("latin-1").translate(BYTE_LETTERS)
            return self._piece(lower) if stem is word else self._piece(lower) + self._piece(word[-1])
        if word.isascii() and word.isprintable() and not any(s in word for s in self._special):
            pieces = ASCII_PIECES.findall(word.lower())
        elif any(s in word for s in self._special):
            return np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            tokenizer = self._tokenizer
            normal = tokenizer.normalizer.normalize_str(word)
            pieces = [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return b"".join(map(self._piece, pieces))

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            as_bytes = self._bytes
            ids = b"".join([as_bytes[t.id] for t in self._tokenizer.model.tokenize(piece)])
            if len(self._pieces) >= MOST_PIECES:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, kept for its later tasks."""
    return Encoder(path)
