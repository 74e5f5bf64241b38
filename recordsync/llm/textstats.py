"""Surface statistics of a text, as features of linear models."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Characters whose share of a text is a feature of its own.
MARKS = "*$%&#|!?.,;:-_/<>{}()\"'=+@~^"
_MARKS = np.frombuffer(MARKS.encode(), np.uint8)
N_STATS = 2 * (len(MARKS) + 10) + 2


def stats(text: str | None) -> np.ndarray:
    """``N_STATS`` numbers from the whole text; an empty or null text gives zeros.

    Shares of characters and words appear twice, as square root and, cut at a tenth, tenfold.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_STATS)
    words = data.split()
    if not words:
        return out
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, n_words = len(data), len(words)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    top = Counter(words).most_common(1)[0][1]
    repeats = sum(a == b for a, b in zip(words, words[1:]))  # noqa: B905
    shares = np.concatenate([
        count[_MARKS] / n_words,
        [
            upper / max(1, upper + lower), digit / n, count[10] / n_words, count[128:].sum() / n, count[:32].sum() / n,
            1 - len(set(words)) / n_words, repeats / n_words, (top - 1) / n_words,
            sum(len(w) == 1 for w in words) / n_words, sum(len(w) > 20 for w in words) / n_words,
        ],
    ])
    shares = np.minimum(shares, 1)
    out[: len(shares)] = np.sqrt(shares)
    out[len(shares) : 2 * len(shares)] = np.minimum(1, 10 * shares)
    out[-2:] = np.log1p(n_words) / 10, min(1, n / n_words / 20)
    return out
