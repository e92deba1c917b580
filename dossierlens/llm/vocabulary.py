"""Byte-pair vocabularies read from tokenizer files: byte alphabet, merge ranks, added tokens."""

import json
import re
from functools import lru_cache


@lru_cache(maxsize=1)
def byte_letters() -> list:
    """The printable character that stands for each byte in vocabulary files: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Vocabulary:
    """``ids`` token -> id, ``tokens`` id -> token, ``merges`` (left id, right id) -> (rank, id of the joined token).

    ``added`` are tokens that are cut out of a text before anything else, longest first where two begin at one place.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        self.ids = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.added.items()]}
        self.merges = {}
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        contents = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, contents)) + ")") if contents else None
        letters = byte_letters()
        self.byte_ids = [self.ids[c] for c in letters]
        self.last_byte_ids = [self.ids[c + self.end] for c in letters] if self.end else self.byte_ids

    def symbols(self, word: str) -> list:
        """Ids of the bytes of a word, the last with the mark of a word's end where the vocabulary has one."""
        raw = word.encode("utf-8")
        out = [self.byte_ids[b] for b in raw]
        if raw:
            out[-1] = self.last_byte_ids[raw[-1]]
        return out

    def parts(self, text: str) -> list:
        """Ordinary texts at even places, added tokens at odd places."""
        return self.added_pattern.split(text) if self.added_pattern else [text]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One copy per path and Python worker."""
    return Vocabulary(path)
