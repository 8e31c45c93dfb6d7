"""Plain loops that say what the operators must return."""

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict

import xxhash

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WHITE = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def contamination(docs, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = norm(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[p : p + n])].add(i)
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w, hit, found = norm(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                k = tuple(w[p : p + n])
                if k in wins:
                    hit.update(range(p, p + n))
                    found |= {str(x) for x in wins[k] if x is not None}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def quality_base(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    twice = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)


def quality_kept(text, stop_words):
    """The rule table, by a loop."""
    n, chars, symbols, dup_lines, repeats = quality_base(text)
    if n < 50 or 100 * repeats > 50 * n:
        return False
    w = words(text)
    n_lines = sum(bool(words(x)) for x in text.split("\n"))
    stops = {x for s in stop_words for x in (s, s.capitalize())}
    alphabetic = sum(any(unicodedata.category(c)[0] == "L" for c in x) for x in w)
    return 2.5 <= chars / n <= 12 and symbols / n <= 0.1 and sum(x in stops for x in w) / n >= 0.02 and dup_lines / max(n_lines, 1) <= 0.5 and alphabetic / n >= 0.7


def fingerprint(text):
    w = (text or "").encode().translate(LOW).split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, ids):
    """Smallest id reachable over pairs of 3 or fewer differing bits."""
    comp = list(range(len(fps)))
    changed = True
    near = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3] for i in range(len(fps))]
    label = list(ids)
    while changed:
        changed = False
        for i in comp:
            m = min(label[j] for j in near[i])
            if m < label[i]:
                label[i] = m
                changed = True
    return label


def repeats(units, window):
    """Of each unit sequence (in order): the covered places."""
    seen, out = set(), []
    for u in units:
        gone = set()
        for i in range(len(u) - window + 1):
            k = tuple(u[i : i + window]) if isinstance(u, list) else u[i : i + window]
            if k in seen:
                gone.update(range(i, i + window))
            seen.add(k)
        out.append(gone)
    return out


def lines(docs, min_docs=3, min_chars=20):
    key = lambda x: low(x.strip(WHITE))
    holders = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            holders[key(x)].add(d)
    out = []
    for d, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and d != max(holders[key(x)]))]
        out.append((d, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return out
