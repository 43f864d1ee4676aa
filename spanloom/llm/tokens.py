"""Token ids of whole texts with a public byte-level vocabulary."""

from __future__ import annotations

import base64

import numpy as np

END_OF_DOCUMENT = 2


def encoder(path: str | None = None):
    """A function text -> ids, for the rank file of the byte-level vocabulary of 50k.

    It gives the ids that the ``tokenizers`` library gives with
    ``byte_bpe_50k.json``, including the id of the special string in a text.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    made = tiktoken.Encoding(
        "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256}
    )
    return lambda text: made.encode(text, allowed_special="all")


def document_ids(encode, text: str | None) -> np.ndarray:
    """Ids of a text and the end of document; of a null text only the latter."""
    ids = encode(text) if text else []
    ids.append(END_OF_DOCUMENT)
    return np.array(ids, dtype="<u4")


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole if it fits, else full pieces after a first one with the rest."""
    if length <= capacity:
        return [(0, length)]
    rest = length % capacity
    out = [(0, rest)] if rest else []
    return out + [(start, capacity) for start in range(rest, length, capacity)]
