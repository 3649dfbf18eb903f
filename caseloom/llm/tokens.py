"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import numpy as np

#: Folder of the public vocabulary files; they are read there and never copied.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# fixed value: the public pattern that cuts a text into pieces before the byte pairs are merged
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, object] = {}


def vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file's content (under 1 MB), to be sent to the workers with the function that uses it."""
    with open(path or os.path.join(TOKENIZERS, VOCABULARY), "rb") as f:
        return f.read()


def encoder(content: bytes) -> Callable[[str], list[int]]:
    """text -> token ids; built once per worker process. Special tokens in a text are ordinary text."""
    key = hash(content)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _encoders[key] = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key].encode_ordinary


def size_of_vocabulary(content: bytes) -> int:
    return content.count(b"\n") + 1


def distinct(ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct token ids and how often each occurs."""
    return np.unique(np.array(ids, np.int32), return_counts=True)
