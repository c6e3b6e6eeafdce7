"""The public byte-level BPE: token ids of whole texts, and where their bytes lie."""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
import tiktoken

_loaded: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def vocabulary() -> str:
    """The vocabulary file of byte_bpe_50k.json as ranks: the same ids, encoded several times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _added(path: str) -> dict[str, int]:
    """The added tokens of the JSON file beside the rank file, which has none itself; none where there is no such file."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def load(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and the number of bytes of each id; once per worker process."""
    if path not in _loaded:
        import public_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        added = _added(path)
        lengths = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        for token, rank in added.items():
            lengths[rank] = len(token.encode())
        _loaded[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), lengths
    return _loaded[path]


#: The white space of the vocabulary's pattern (Unicode's White_Space).
SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: Runs of white space from here on are cut by hand: the pattern's look-ahead walks back over a run and gives up at a million.
LONG_RUN = 100_000


def encode(encoder: tiktoken.Encoding, text: str, *, added: bool = True) -> np.ndarray:
    """Ids as uint32, of texts of any length. ``added``: the string of an added token is that token, as the JSON file
    has it; else it is ordinary text."""
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) >= LONG_RUN:
        found = [m for m in SPACES.finditer(text) if m.end() - m.start() >= LONG_RUN]
        if found:
            return _around(encoder, text, found, added)
    return encoder.encode_to_numpy(text, allowed_special="all" if added else set(), disallowed_special=())


def _around(encoder: tiktoken.Encoding, text: str, found: list[re.Match], added: bool) -> np.ndarray:
    """Ids of a text with long runs of white space. The pattern takes such a run as one word: whole where the text or
    an added token ends it, else all but its last character, which goes with what follows."""
    out, at = [], 0
    special = tuple(encoder.special_tokens_set) if added else ()
    for run in found:
        start, end = run.span()
        if end < len(text) and not text.startswith(special, end):
            end -= 1
        out += [encode(encoder, text[at:start], added=added), np.array(encoder._encode_single_piece(text[start:end]), np.uint32)]
        at = end
    return np.concatenate([*out, encode(encoder, text[at:], added=added)])
