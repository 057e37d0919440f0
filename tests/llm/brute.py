"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def pii_base(text: str | None) -> dict[str, list[tuple[int, int]]]:
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in rules.items()}


def pii_sha(text: str | None) -> str:
    return sha(",".join(f"{k}:{a}:{b}" for k, v in pii_base(text).items() for a, b in v))


def repeats(docs: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, kept_sha) by a dictionary of all windows."""
    top = 2**63 - 1
    least: dict[bytes, int] = {}
    data = [(top if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, top), i)
    out = []
    for (doc, _), (i, b) in zip(docs, data, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), sha(kept)))
    return out


UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UP, LOW)


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TO_LOWER))


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def decontaminated(text: str | None, items: list[tuple[int | None, str | None]], window: int = 10) -> tuple[int, int, list[str]]:
    w, hit, found = alnum(text), set(), set()
    for item, passage in items:
        p = alnum(passage)
        for i in range(max(len(p) - window + 1, 1) if p else 0):
            win = p[i : i + window]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


def line_dedup(docs: list[tuple[int | None, str | None]], least: int = 10) -> list[tuple]:
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(TO_LOWER)
    having: dict[str, set] = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            having.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(having[key(x)]) < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def components(docs: list[tuple[int | None, str | None]], n: int, percent: int) -> list[tuple]:
    sets = []
    for _, t in docs:
        w = words((t or "").translate(TO_LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(docs)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    groups: dict[int, list] = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(i)
    least = {r: min((docs[i][0] for i in g if docs[i][0] is not None), default=None) for r, g in groups.items()}
    return [(docs[i][0], len(sets[i]), least[root(i)] if sets[i] else docs[i][0]) for i in range(len(docs))]


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    from collections import Counter

    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def quality(docs: list[tuple], floor: np.ndarray, half_chi2: float, cutoff: float, least_fall: float, classes: int, median_classes: int, min_group: int) -> list[tuple]:
    """For each (id, text, lang, source): id, statistics, base_failed, kept; the estimates by numpy, each group for itself."""
    rows, groups = [], {}
    for i, text, lang, source in docs:
        n, chars, symbols, dup, rep = statistics(text)
        failed = n < 50 or 100 * rep > 50 * n
        lines = sum(1 for x in (text or "").split("\n") if words(x))
        v = [np.log(max(chars, 1) / max(n, 1)), np.sqrt(symbols / (chars + 1)), np.sqrt(dup / (lines + 5)), np.sqrt(rep / (max(n, 1) + 25))]
        rows.append([i, n, chars, symbols, dup, rep, failed, not failed])
        if not failed:
            groups.setdefault((lang, source), []).append((len(rows) - 1, v))
    fits = {}
    for (lang, source), members in groups.items():
        fits.setdefault((lang, source if len(members) >= min_group else ("small",)), []).extend(members)
    for members in fits.values():
        x = np.array([v for _, v in members])
        least = (len(x) + 1) // 2 - 1
        median = lambda a: (np.sort(np.floor(a * median_classes), axis=0)[least] + 0.5) / median_classes
        far = lambda m, s: np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(s), x - m)
        class_of = lambda d2: np.floor(np.log2(np.maximum(d2, 1e-6)) * classes)
        mean = median(x)
        cov, det = np.diag((median(np.abs(x - mean)) * 1.4826) ** 2 + floor), np.inf
        while True:
            at = class_of(far(mean, cov))
            limit = np.sort(at)[least]
            half = x[at <= limit]
            new = np.cov(half.T, bias=True) + np.diag(floor)
            if not np.linalg.det(new) < det * (1 - least_fall):
                break
            mean, cov, det = half.mean(axis=0), new, np.linalg.det(new)
        scale = half_chi2 / max(2.0 ** ((limit + 1) / classes), half_chi2)
        for (at, _), d2 in zip(members, far(mean, cov) * scale, strict=True):
            rows[at][-1] = not d2 > cutoff
    return [tuple(r) for r in rows]
