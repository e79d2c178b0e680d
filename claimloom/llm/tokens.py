"""Byte-level BPE ids of whole texts, with a tokenizer file that the caller names."""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

#: Texts of these characters only take the rank file (the same vocabulary and split pattern, several
#: times as fast); all others take the tokenizer file itself.  A test compares the two.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧€]*")


def default_files() -> tuple[str, str]:
    """(tokenizer file, rank file) of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


@cache
def _default(path: str):
    """(tokenizer as its file has it, its added tokens' strings): these strings in a text are single ids."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return made, [token.content for token in made.get_added_tokens_decoder().values()]


def encode(text: str, files: tuple[str, str]) -> np.ndarray:
    """Ids of a text, without special tokens."""
    if _PLAIN.fullmatch(text):
        return np.array(_ranks(files[1]).encode_ordinary(text), "<u4")
    return np.array(_tokenizer(files[0]).encode(text, add_special_tokens=False).ids, "<u4")


def encode_default(text: str, files: tuple[str, str]) -> np.ndarray:
    """Ids of a text as the tokenizer file gives them, without special tokens around it; unlike `encode`,
    the string of an added token in the text is that token."""
    made, added = _default(files[0])
    if any(token in text for token in added):
        return np.array(made.encode(text, add_special_tokens=False).ids, "<u4")
    return encode(text, files)
