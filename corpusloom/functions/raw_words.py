"""The words of ``text.clean_tokens`` inside Arrow tasks, numbered.

Texts are cleaned as bytes; only runs of other characters than ASCII are folded one by one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom.functions.folding import fold_rules
from corpusloom.functions.text import FUSED_WORDS

_SPACES = b"\t\n\x0b\x0c\r "
_LOWERED = bytes.maketrans(_SPACES, b" " * len(_SPACES)).lower()
_DROPPED = bytes(c for c in range(0x80) if c not in _SPACES and not chr(c).isalpha())
_NOT_ASCII = re.compile("([^\\x00-\\x7f]+)")
_OTHER_SPACES = {0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_FUSED = {w.replace("|", ""): w.index("|") for w in FUSED_WORDS}


class _Folding(dict):
    def __missing__(self, code: int) -> str:
        if code < 0x80:  # lower-casing may have brought it
            return chr(code)
        return " " if code in _OTHER_SPACES else ""


@lru_cache(maxsize=1)
def _folding() -> _Folding:
    source, target, expansions = fold_rules()
    return _Folding(str.maketrans(dict(zip(source, target)) | expansions))


def _folded(run: str) -> str:
    return run.lower().translate(_folding())


_folded_short = lru_cache(maxsize=1 << 14)(_folded)


def _cleaned(text: bytes | None) -> bytes:
    """Letters and blanks of a text, lower-cased and folded."""
    if text is None or text.isascii():
        return (text or b"").translate(_LOWERED, _DROPPED)
    parts = _NOT_ASCII.split(text.translate(_LOWERED).decode("utf-8", "replace"))
    parts[1::2] = [(_folded_short if len(x) < 8 else _folded)(x) for x in parts[1::2]]  # may bring capitals, which stay
    return "".join(parts).encode().translate(None, _DROPPED)


def _unfused(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words with fused ones taken apart: at which word, and the word, in order."""
    at = np.arange(len(words))
    fused = pc.is_in(pc.ascii_lower(words), value_set=pa.array(list(_FUSED), pa.string())).to_numpy(zero_copy_only=False)
    if not fused.any():
        return at, words
    whole = words.filter(pa.array(fused)).to_pylist()
    heads = [w[: _FUSED[w.lower()]] for w in whole]
    tails = [w[len(h) :] for w, h in zip(whole, heads)]
    both = pa.concat_arrays([pc.replace_with_mask(words, pa.array(fused), pa.array(heads)), pa.array(tails)])
    at = np.r_[at, at[fused]]
    order = np.argsort(at, kind="stable")
    return at[order], both.take(pa.array(order))


def clean_codes(texts: pa.Array, stop: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Tokens of the texts, without the words ``stop``, by number, the words numbered, and the tokens of each text."""
    cleaned = pa.array([_cleaned(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
    lists = pc.ascii_split_whitespace(cleaned)
    pieces = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    at, words = _unfused(coded.dictionary)
    kept = pc.invert(pc.is_in(words, value_set=pa.array(["", *stop], pa.string())))
    at, words = at[kept.to_numpy(zero_copy_only=False)], words.filter(kept).dictionary_encode()
    number = words.indices.to_numpy()
    n_words = np.bincount(at, minlength=len(coded.dictionary))
    first = np.cumsum(n_words) - n_words
    raw = coded.indices.to_numpy()
    many = n_words[raw]
    ends = np.r_[0, np.cumsum(many)]
    if n_words.max(initial=0) > 1:
        inside = np.arange(ends[-1]) - np.repeat(ends[:-1], many)
        codes = number[np.repeat(first[raw], many) + inside]
    else:
        codes = number[first[raw[many > 0]]]
    return codes.astype(np.int64), words.dictionary, np.diff(ends[np.r_[0, np.cumsum(pieces)]])
