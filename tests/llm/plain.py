"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(raw: bytes | str) -> str:
    return hashlib.sha256(raw.encode("utf-8", "surrogatepass") if isinstance(raw, str) else raw).hexdigest()


def shingle_set(text: str | None) -> frozenset:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(texts: dict[int, str | None], percent: int = 75) -> dict[int, int]:
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in texts}


def removed_repeats(texts: dict[int, str | None], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode("utf-8", "surrogatepass")
        gone = [False] * len(raw)
        own = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        for i, s in enumerate(own):
            if s in seen:
                gone[i : i + length] = [True] * length
        seen.update(own)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        out[k] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def luhn(digits: str) -> bool:
    doubled = (int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)
