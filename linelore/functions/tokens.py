"""The token unit for texts held in Python, and greedy selection under a budget of it."""

from __future__ import annotations

import re

_WORD = re.compile(rb"[A-Za-z0-9]+")
_SIGN = re.compile(rb"[^A-Za-z0-9 \n\r\t\f\x0b]+")
_HOT = re.compile(r"(?i)error|fail|fatal|panic|exception|denied|refused|undefined|expected|assert")
_WARM = re.compile(r"(?i)warn|note:|hint:|help:|caused by|\b\d+ (?:passed|failed)")
_PLACE = re.compile(r"\.\w+:\d")
_FLAG = re.compile(r"(?:^|\s)--?[a-z]")


def estimate(text: str) -> int:
    """The same number as ``functions.text.estimate_tokens``."""
    b = text.encode("utf-8", "surrogatepass")
    if not b:
        return 0
    words = _WORD.findall(b)
    n = len(words) + sum((len(w) - 9) // 8 for w in words if len(w) > 12) + (len(_SIGN.findall(b)) + 1) // 2
    return max((len(b) + 3) // 4, n, 1)


def worth(line: str, first: bool) -> float:
    """How much a line says: failures, places, counts and flags before prose."""
    v = 4.0 + 40 * bool(_HOT.search(line)) + 14 * bool(_WARM.search(line)) + 28 * bool(_PLACE.search(line)) + 24 * bool(_FLAG.search(line))
    return v + (20 if first else 0)


def counts(text: str) -> tuple[int, int, int]:
    """Bytes, word units and runs of signs. Of texts joined by white space they add up (and a byte for each seam)."""
    b = text.encode("utf-8", "surrogatepass")
    words = _WORD.findall(b)
    return len(b), len(words) + sum((len(w) - 9) // 8 for w in words if len(w) > 12), len(_SIGN.findall(b))


def units(size: int, words: int, signs: int) -> int:
    return max((size + 3) // 4, words + (signs + 1) // 2, 1) if size > 0 else 0


def cap_words(line: str, most: int) -> str:
    """The beginning and the end of one long line, around an ellipsis."""
    words = line.split()
    if estimate(" ".join(words)) <= most:
        return " ".join(words)
    size, n, signs = 3, 0, 1  # the ellipsis
    i, j = 0, len(words)
    front = True
    while i < j:
        w = words[i] if front else words[j - 1]
        a, b, c = counts(w)
        if units(size + a + 1, n + b, signs + c) > most and (i or j < len(words)):
            break
        size, n, signs = size + a + 1, n + b, signs + c
        i, j, front = (i + 1, j, False) if front else (i, j - 1, True)
    return " ".join([*words[:i], *(["..."] if i < j else []), *words[j:]])


def hard_cap(text: str, most: int) -> str:
    """A text of at most ``most`` tokens made of its most telling whole lines in their order; never without content.

    Left out lines are marked by ``...``. A line that doesn't fit is passed over and the next one is tried. Sizes of
    lines add up, so each line is measured once.
    """
    lines = [" ".join(x.split()) for x in text.split("\n")]
    lines = [x for x in lines if x]
    if most <= 0 or not lines:
        return ""
    size = [counts(x) for x in lines]
    if units(sum(s[0] + 1 for s in size) - 1, sum(s[1] for s in size), sum(s[2] for s in size)) <= most:
        return "\n".join(lines)
    n = len(lines)
    kept = [False] * n
    bytes_, words, signs, gaps = 0, 0, 0, 1
    for i in sorted(range(n), key=lambda i: (-worth(lines[i], i == 0) / max(1, units(*size[i])), i)):
        g = gaps - 1 + (i > 0 and not kept[i - 1]) + (i < n - 1 and not kept[i + 1])
        b, w, s = bytes_ + size[i][0] + 1, words + size[i][1], signs + size[i][2]
        if units(b + 4 * g - 1, w, s + g) <= most:
            kept[i] = True
            bytes_, words, signs, gaps = b, w, s, g
    if not any(kept):
        return cap_words(max(lines, key=lambda x: worth(x, False)), most)
    out: list[str] = []
    for x, k in zip(lines, kept):
        if k:
            out.append(x)
        elif not out or out[-1] != "...":
            out.append("...")
    return "\n".join(out)


SINGLE, SUMMARY, DETAIL = 24, 14, 24  # tokens of an ultra-compact render. Fixed values.


def ultra_compact(rendered: str, failed: bool) -> str:
    """One line: the first one and the most telling of the others, with the number of what is left out."""
    lines = [x.strip() for x in rendered.split("\n") if x.strip()]
    if len(lines) <= 1:
        return cap_words(lines[0], SINGLE) if lines else ""
    best = sorted(range(1, len(lines)), key=lambda i: (-worth(lines[i], False), i))[: 3 if failed else 2]
    detail = "; ".join(lines[i] for i in sorted(best))
    left = len(lines) - 1 - len(best)
    return f"{cap_words(lines[0], SUMMARY)} | {cap_words(detail, DETAIL)}" + (f" +{left} more" if left else "")
