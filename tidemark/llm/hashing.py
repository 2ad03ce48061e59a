"""Words and their 64-bit hashes as numpy arrays, for operators that run inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Odd multipliers of the words in a run, fixed so that every task hashes alike.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8: bytes.split() parts at exactly those bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def mixed(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (at most eight); one of the whole text if it is shorter."""
    size_ = min(size, len(h))
    if not size_:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - size_ + 1, size_, np.uint64)
    for j in range(size_):
        out += h[j : j + len(out)] * MULTIPLIERS[j]
    return mixed(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
