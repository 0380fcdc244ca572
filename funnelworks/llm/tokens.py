"""Token ids of whole texts, inside tasks.

The ids are those of the public byte-level BPE ``byte_bpe_50k.json`` with
``add_special_tokens=False`` (its literal ``<|endoftext|>`` is id 50256).  The
same vocabulary is read as ranks, because the rank encoder gives the same ids
several times faster; the tests hold both against each other.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

END = 1
END_OF_TEXT = ("<|endoftext|>", 50256)


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(
        os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens=dict([END_OF_TEXT]),
    )


def token_ids(text: str | None, path: str) -> np.ndarray:
    """uint32 ids of a text (null: empty), closed by ``END``."""
    ids = encoding(path).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, np.uint32(END))
