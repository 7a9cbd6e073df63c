"""Loading a public byte-level vocabulary and encoding single pre-tokens with the library's own model."""

from __future__ import annotations

import os

import regex


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}


LETTERS = _byte_letters()


class Vocabulary:
    """A tokenizer file without truncation or padding, its special strings, and its model for single pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def pieces(self, pretoken: str) -> list:
        """The model's pieces of one pre-token; they carry ``id``."""
        return self.model.tokenize(pretoken.encode().decode("latin-1").translate(LETTERS))


_LOADED: dict[str, Vocabulary] = {}


def loaded(path: str) -> Vocabulary:
    """One for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]
