"""Case folding that keeps the way back to the text.

Rule: full Unicode case folding, character by character, with dotted capital I as plain i.  One character may become several
(``ß`` is ``ss``), so positions of the folded text are mapped to characters of the text; what is found must begin and end with
whole characters of it.
"""

from collections import defaultdict

import numpy as np


def fold(text: str) -> str:
    return text.replace("İ", "i").casefold()


def fold_map(text: str) -> tuple[str, np.ndarray | None]:
    """(folded text, character of each of its positions); None where they are the same, as in most texts."""
    folded = fold(text)
    if len(folded) == len(text):  # folding never shortens
        return folded, None
    sizes = [len(fold(ch)) for ch in text]
    return folded, np.repeat(np.arange(len(text)), sizes)


def automaton(needles):
    """Search automaton over folded needles: its ``iter`` gives (last position, number of the needle)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for number, needle in enumerate(needles):
        out.add_word(needle, number)
    out.make_automaton()
    return out


def find_all(machine, sizes, text: str, limit=None) -> list[tuple[int, int, int]]:
    """(needle, start, length) of the hits in ``text``: for each needle from left to right without overlaps, the first
    ``limit`` ones if given."""
    folded, origin = fold_map(text)
    end, count, out = {}, defaultdict(int), []
    # Hits of a needle come in the order of their ends, and all its hits have one size, so in the order of their starts.
    for last, needle in machine.iter(folded):
        start = last + 1 - sizes[needle]
        if start < end.get(needle, 0) or limit is not None and count[needle] >= limit:
            continue
        first, stop = start, last + 1
        if origin is not None:
            if start and origin[start] == origin[start - 1] or stop < len(origin) and origin[stop] == origin[stop - 1]:
                continue
            first, stop = int(origin[start]), int(origin[last]) + 1
        end[needle] = last + 1
        count[needle] += 1
        out.append((needle, first, stop - first))
    return out
