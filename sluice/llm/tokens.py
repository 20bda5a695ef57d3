"""Token ids of texts, a word at a time.

The pre-tokenizer of the word-BPE vocabulary drops white space and never joins
what it separates, so the ids of a text are those of its words in a row. Workers
keep the ids of words that they have met, which turns most of the work into
lookups. Words end further where the pre-tokenizer always cuts: after an ASCII
letter that an ASCII character other than a letter follows. Texts that could hold
a special token are cut at white space alone.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable

#: Words whose ids a worker keeps (some 100 MB); beyond, it drops all but the first KEPT, among which the frequent ones are.
CACHE, KEPT = 1 << 19, 1 << 18
#: Where an ASCII letter ends before a visible ASCII character that is none.
CUT = re.compile(rb"(?<=[a-z])(?=[!-@\[-`{-~])")
#: Lower-case Latin words, which neither the normalizer nor the pre-tokenizer changes.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for the characters from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in visible)
    letters = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Known(dict):
    """word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(text):
            # Straight to the model: it reads the word's bytes as letters.
            ids = [t.id for t in self.model.tokenize(text if text.isascii() else "".join([self.letters[b] for b in word]))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        value = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return value


class Encoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.known = Known(path)

    def ids(self, texts: Iterable[str | None]) -> list[bytes]:
        """Null texts have no ids."""
        if len(self.known) > CACHE:
            for word in list(self.known)[KEPT:]:
                del self.known[word]
        known = self.known.__getitem__
        return [b"".join(map(known, words_of(text))) for text in texts]


#: Encoders of this process: workers serve many tasks, and words learned in one serve the next.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() cuts at ASCII white space alone, all of which the tokenizer drops; bytes.lower() lower-cases A-Z, as it would."""
    if not text:
        return []
    own = text.encode("utf-8", "surrogatepass")
    # A special token may stand in the text, in its own case.
    return own.split() if b"<|" in own else CUT.sub(b" ", own.lower()).split()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
