"""Sizes of texts in tokens of a public tokenizer, read from a rank file whose path is a parameter."""

from __future__ import annotations

import base64
import functools
import os

# Fixed value: the pattern by which these rank files split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"  # the default of the operators' ``path``; the file must lie there on every worker


@functools.lru_cache(maxsize=2)
def encoder(path: str = RANKS, pattern: str = PATTERN):
    """The tokenizer of this process; each worker reads the file once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def numbers(texts: list[str | None], path: str = RANKS) -> list[list[int]]:
    """Token numbers of each text; none for null and empty texts. Special strings count as ordinary text."""
    e = encoder(path)
    return [e.encode_ordinary(t) if t else [] for t in texts]


def sizes(texts: list[str | None], path: str = RANKS) -> list[int]:
    """Tokens of each text."""
    return [len(x) for x in numbers(texts, path)]
