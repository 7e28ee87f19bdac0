"""Texts to ids with a tokenizer file of the ``tokenizers`` library, remembering the ids of words.

Where a file's pipeline is the one below (``word_bpe_49k.json``), no token crosses a blank, so that a text's ids are those of
its blank-separated words in turn.  Words repeat far more often than texts, and a word's ids are looked up in a table of
bounded size.  What the table lacks is cut into pieces, which are looked up there too: ASCII words by the file's own
pattern, and words of letters below U+0250, less the one whose lower case is two characters, into the letters and the marks
after them; neither case nor composing can change a thing there.  A piece of such letters goes to the file's model, any other
piece or word to the whole library.  With any other pipeline whole texts go to the library.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

from gridfield.llm import runtime

runtime.ship(sys.modules[__name__])

#: Words and pieces remembered by a worker: two generations of so many.
REMEMBERED = 400_000

#: How the file's pre-tokenizer cuts text, and the same for lower-case ASCII (fixed values of that file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Letters below this have no marks to compose, and their lower case is one letter but for this one.
PLAIN_BELOW, DOTTED = "ɐ", "İ"


def cuts_at_blanks(said: dict) -> bool:
    """Whether a file's pipeline is the one that words can be taken from."""
    normalizer, pre = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}
    steps = [(x["type"], x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in pre.get("pretokenizers", [])]
    want = [("Split", {"Regex": PATTERN}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
    marked = said["model"].get("end_of_word_suffix") and not said["model"].get("dropout") and not said["model"].get("ignore_merges")
    plain = all("<|" in x["content"] and not any(x[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for x in said.get("added_tokens", []))
    return bool(marked) and plain and normalizer.get("normalizers") == NORMALIZERS and steps == want and not said.get("post_processor")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, others from 256 on."""
    as_is = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in as_is else next(others)) for b in range(256)}


class Memory(dict):
    """A dict of two generations that makes what it lacks; the older is dropped when the younger is full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.old, self.make, self.limit = {}, make, limit

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class WordEncoder:
    """A whole text in UTF-8 -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = cuts_at_blanks(json.load(f))
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.words = Memory(self._word, limit)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, letters: str) -> bytes:
        """Of one piece, in the vocabulary's letters."""
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self._letters(word.decode()) if word.islower() else self.words[word.lower()]
        if b"<|" in word:  # might hold a special token
            return self._library(word.decode())
        if word.isascii():
            pieces = ASCII_PIECES.findall(word.lower())
            return b"".join(map(self.words.__getitem__, pieces)) if len(pieces) > 1 else self._library(word.decode())
        text = word.decode()
        core = text.rstrip(".,;:!?")
        if not core or max(core) >= PLAIN_BELOW or DOTTED in core or not core.isalpha():
            return self._library(text)
        low = core.lower()
        if low != text:
            tail = word[len(core.encode()) :]
            return self.words[low.encode()] + (self.words[tail] if tail else b"")
        return self._letters(word.decode("latin-1").translate(self.letters))

    def encode(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._library(text.decode())
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    """One a worker process and path; it stays for the worker's later tasks."""
    import types

    home = sys.modules.setdefault("gridfield_worker_state", types.ModuleType("gridfield_worker_state"))
    held = home.__dict__.setdefault("encoders", {})
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]
