"""BPE vocabularies of installed libraries; files are read where the tokenizer package is, or from a given path."""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

#: Texts of these characters only take the quick ways below, which agree with the tokenizers library on them; others are encoded by the library itself.
_LATIN_END = 0x17F
OTHER = re.compile(f"[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-{chr(_LATIN_END)}]|<\\|(?:start|end)oftext|\\s{{2000}}|[^\\s]{{20000}}")


def vocabulary_path(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library_tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@lru_cache(maxsize=2)
def byte_encoder(name: str):
    """text -> ids for ``OTHER``-free texts: the library's own vocabulary and merges, as ranks for tiktoken."""
    import json

    import tiktoken

    with open(vocabulary_path(name), encoding="utf-8") as file:
        model = json.load(file)["model"]
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in letters for c in piece)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _class(kind: str) -> str:
    """Characters up to the end of the Latin range whose category begins with ``kind``."""
    return "".join(re.escape(chr(c)) for c in range(_LATIN_END + 1) if unicodedata.category(chr(c)).startswith(kind))


#: The word pattern of the word vocabulary on normalised ``OTHER``-free text.
LATIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+")
