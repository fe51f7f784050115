"""Ids of a byte-level BPE tokenizer file, by the fastest library that gives the same ids."""

from __future__ import annotations

import functools
import json

import numpy as np

# The pattern of this family of tokenizers and its table of printable bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_table() -> dict[str, int]:
    """Character in the file -> byte: printable bytes stand for themselves, the others come from 256 on."""
    other = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.lru_cache(4)
def encoder(path: str):
    """A function from text to ids (uint32), special strings inside the text as the file's library has them."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokenizer = Tokenizer.from_file(path)

    def by_library(text: str) -> np.ndarray:
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    added = spec.get("added_tokens", [])
    in_order = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    if not in_order:
        return by_library
    import tiktoken

    table = byte_table()
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(table[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def by_ranks(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()), np.uint32)
        except (UnicodeError, ValueError):
            return by_library(text)

    return by_ranks
