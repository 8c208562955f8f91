"""Tokenizer files on the workers: their path is a parameter, they are read once per process."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def encoded(path: str, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units, one after another, and the number of each.

    Many units go to the library as one text, parted by a special token of the vocabulary;
    its id then marks the ends. Units that hold part of such a string go alone.
    """
    lib, specials = tokenizer(path), special_strings(path)
    if not units:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts = [u.decode("utf-8", "replace") for u in units]
    marks = {s[:2] for s in specials} | {s[-2:] for s in specials}
    if not specials or any(m in t for t in texts for m in marks):
        rows = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for r in rows for i in r], np.int64), np.array([len(r) for r in rows], np.int64)
    end = specials[0]
    ids = np.array(lib.encode_batch_fast([end.join(texts) + end], add_special_tokens=False)[0].ids, np.int64)
    ends = np.flatnonzero(ids == lib.token_to_id(end))
    if len(ends) != len(texts):
        raise ValueError("the special token does not part the units")
    return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
