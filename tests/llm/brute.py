"""Plain Python versions that the operators are held against."""

import hashlib
import re

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text: str) -> tuple[int, int, int, int, str]:
    out, counts = [], []
    for k, (name, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        n = 0
        for m in re.finditer(pattern, text or ""):
            v, digits = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[name]
            if ok:
                n += 1
                out.append((m.start(), k, name, m.end()))
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(out)).encode()).hexdigest())


def quality(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), len(words) < 50 or 100 * len(marked) > 50 * len(words)


def words(text: str) -> list[str]:
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def shingles(text: str, k: int = 5) -> list[tuple[str, ...]]:
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w)


def weighted_jaccard(a, b) -> float:
    from collections import Counter

    x, y = Counter(a), Counter(b)
    shared = sum((x & y).values())
    return shared / max(1, len(a) + len(b) - shared)


def near_classes(texts: dict[int, str], threshold: float = 0.8) -> dict[int, int]:
    """Least id of each connected component of the similarity graph."""
    own = {i: shingles(t) for i, t in texts.items()}
    at: dict[tuple, list[int]] = {}
    for i, s in own.items():
        for x in set(s):
            at.setdefault(x, []).append(i)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = {(a, b) for ids in at.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if weighted_jaccard(own[a], own[b]) >= threshold:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def contamination(texts: dict[int, str], items: dict[int, str], threshold: float = 0.8) -> dict[tuple[int, int], float]:
    """Best weighted Jaccard similarity of an item-sized window, for every pair that reaches the threshold."""
    out = {}
    for d, t in texts.items():
        s = shingles(t)
        for i, x in items.items():
            q = shingles(x)
            if not q or not set(q) & set(s):
                continue
            n = max(1, len(words(x)) - 4)
            best = max(weighted_jaccard(s[a : a + n], q) for a in range(max(1, len(s) - n + 1)))
            if best >= threshold:
                out[d, i] = best
    return out


def containments(texts: dict[int, str], templates: dict[str, str], threshold: float) -> dict[tuple[int, str], float]:
    """Best share of a template's shingles in a window of its size, for every pair that reaches the threshold."""
    out = {}
    own = {d: shingles(t) for d, t in texts.items()}
    for name, x in templates.items():
        q = set(shingles(x))
        n = max(1, len(words(x)) - 4)
        for d, s in own.items():
            if q & set(s):
                best = max(len(q & set(s[a : a + n])) / len(q) for a in range(max(1, len(s) - n + 1)))
                if best >= threshold:
                    out[d, name] = best
    return out
