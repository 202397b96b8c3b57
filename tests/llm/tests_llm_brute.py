"""Brute-force versions of the pipeline's filtering stages."""

from __future__ import annotations

from test_decontamination import brute as contaminated
from test_ngram_join import brute as components


def brute_kept(texts):
    found = components(list(texts.items()))
    return {i: t for i, t in texts.items() if found[i][1] == i}


def brute_contaminated(texts, items):
    gone = {r[0] for r in contaminated(list(texts.items()), list(items.items())) if r[5]}
    return {i: t for i, t in texts.items() if i not in gone}
