"""Plain versions to compare with: one text at a time, no tricks."""

from __future__ import annotations

import re

SHORTS = "'s don't we'RE x's y'st ''s 1's"
ODD_TEXTS = [
    None, "", "   ", " \n\t ", "one", "One two", "a b c a b c", "the the the the the", "é à ü 日本語 😀 ß", SHORTS, "x" * 5000, "w " * 3000,
    "1.2.3.4 and a@b.cd +1 (555) 555-1234 4111 1111 1111 1111", "under the MIT license, Apache License, Version 2.0; cc by nc cc-by-nc", "a\x00b\x1fc\x7fd e f",
]


def lower_ascii(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def alnum_words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower_ascii(text))


def spaced_words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", lower_ascii(text))


def shingles(text: str | None, k: int) -> set[tuple]:
    w = spaced_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(sets: dict[int, set], num: int, den: int) -> dict[int, int]:
    label = {i: i for i in sets}

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def hits(text: str | None, items: dict[int, str | None]) -> tuple[set[int], set[int]]:
    """(hit words, items) of a document."""
    w, places, found = alnum_words(text), set(), set()
    for item, body in items.items():
        v = alnum_words(body)
        m = min(10, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else set()
        for s in range(len(w) - m + 1) if windows else ():
            if tuple(w[s : s + m]) in windows:
                places.update(range(s, s + m))
                found.add(item)
    return places, found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    t, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group())):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)
