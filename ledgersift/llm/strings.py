"""Edit distance, neighbourhoods by deletion and abbreviations, for short strings in Python."""

from __future__ import annotations

import unicodedata
from itertools import combinations

#: Letters that do not decompose into a base letter and a mark.
_PLAIN = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without marks on letters."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_PLAIN)) if not unicodedata.combining(c))


def osa(a: str, b: str, most: int) -> int:
    """Edits between a and b (a character wrong, missing or added, or two neighbours swapped), or most + 1 if more."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    # equal ends change nothing
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    while la > i and lb > i and a[la - 1] == b[lb - 1]:
        la -= 1
        lb -= 1
    a, b = a[i:la], b[i:lb]
    la, lb = len(a), len(b)
    if not la or not lb:
        return max(la, lb) if max(la, lb) <= most else most + 1
    before, row = None, list(range(lb + 1))
    for i in range(1, la + 1):
        x, new = a[i - 1], [i] + [0] * lb
        for j in range(1, lb + 1):
            y = b[j - 1]
            n = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < n:
                n = before[j - 2] + 1
            new[j] = n
        if min(new) > most and min(row) > most:
            return most + 1
        before, row = row, new
    return row[lb] if row[lb] <= most else most + 1


def deletions(word: str, most: int) -> set[str]:
    """word with up to `most` characters left out: two words within that many edits share one of these."""
    found = {word}
    for k in range(1, min(most, len(word) - 1) + 1):
        found.update("".join(word[i] for i in keep) for keep in combinations(range(len(word)), len(word) - k))
    return found


def slips(length: int) -> int:
    """Edits allowed in a word of that length."""
    return 0 if length < 4 else 1 if length < 7 else 2


def abbreviates(short: str, word: str) -> bool:
    """Whether short is word with letters left out: same first letter, the rest in order; of two letters, the first two."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    if len(short) == 2:
        return word.startswith(short)
    at = iter(word[1:])
    return all(c in at for c in short[1:])
