"""Token ids of the public word-level tokenizer, with a memory of words.

Its file says: special tokens are cut out first, text is normalized (NFC, lower case),
white space separates, and what lies between is encoded by itself. So the ids of a text
are those of its words (cut at ASCII white space) one after the other, and a word met
before needs no second encoding.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Default vocabulary; a path may be given instead.
VOCABULARY = "word_bpe_49k.json"
#: A worker remembers the last so many words that it met, and as many before these,
#: about 200 bytes each.
MAX_WORDS = 300_000

#: Letters that NFC leaves alone and that one lower-case letter replaces; a run of them
#: is one unit of the tokenizer.
LETTERS = re.compile("[a-zà-öø-ÿ]+")
#: A run of these marks is a unit as well.
MARKS = b".,;:!?|()%#&*$"

#: The settings of a file under which the above holds.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
UNITS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def vocabulary_path(vocabulary: str = VOCABULARY) -> str:
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def refuse_others(settings: dict) -> None:
    """Raises ValueError for a tokenizer whose ids are not those of its words in turn."""
    cuts = (settings["pre_tokenizer"] or {}).get("pretokenizers", [])
    wanted = {
        "normalizer": (settings["normalizer"] or {}).get("normalizers") == NORMALIZERS,
        "units": [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": UNITS}, "Removed", True)
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]),
        "model": settings["model"]["type"] == "BPE" and not settings["model"].get("dropout"),
        "special tokens": all("<|" in t["content"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in settings["added_tokens"]),
        "decoder": settings["decoder"] is None,
    }
    other = [name for name, right in wanted.items() if not right]
    if other:
        raise ValueError(f"not a word-level tokenizer of the known kind: {', '.join(other)}")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the
    others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Words(dict):
    """Word (UTF-8) -> ids as little-endian 16-bit numbers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            refuse_others(json.load(file))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.model = self.tokenizer.model
        self.letter = _byte_letters()
        self.pair = [k.to_bytes(2, "little") for k in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MAX_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is not None:
            self[word] = found
            return found
        letters = word.rstrip(MARKS)
        if len(letters) < len(word) and letters and self._simple(letters):
            found = self[letters] + self[word[len(letters) :]]
        elif self._simple(word):
            unit = word.decode() if word.isascii() else "".join(map(self.letter.__getitem__, word))
            found = b"".join([self.pair[t.id] for t in self.model.tokenize(unit)])
        else:
            found = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u2").tobytes()
        self[word] = found
        return found

    @staticmethod
    def _simple(word: bytes) -> bool:
        return (word.isalpha() and word.islower()) or bool(LETTERS.fullmatch(word.decode()))


class Encoder:
    def __init__(self, path: str) -> None:
        self.words = _Words(path)
        self.tokenizer = self.words.tokenizer
        size = self.tokenizer.get_vocab_size()
        self.names = [self.tokenizer.id_to_token(k) or "" for k in range(size)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 16-bit numbers."""
        raw = text.encode()
        if b"<|" not in raw:  # names of special tokens are matched as written
            raw = raw.lower()
        return b"".join(map(self.words.__getitem__, raw.split()))

    def encode_whole(self, text: str) -> bytes:
        """The same from the library, in one call."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def decode(self, ids: bytes) -> str:
        """The tokenizer has no decoder of its own: names of tokens, with spaces between."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u2").tolist()))


def wide(ids: bytes) -> bytes:
    """16-bit ids as little-endian 32-bit numbers."""
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One per Python worker and vocabulary."""
    return Encoder(vocabulary_path(vocabulary))
