"""Plain Python versions of the operators, one document after another."""

import hashlib
import re
import string
from collections import Counter, defaultdict

import xxhash

SPACE = " \t\n\x0b\f\r"
AZ = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def items(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def line_dedup(docs, least_chars=40, least_docs=5):
    """{id: kept text} of {id: text}."""
    key = lambda line: line.strip(SPACE).translate(AZ)
    holders = defaultdict(set)
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    gone = lambda i, line: len(holders.get(key(line), ())) >= least_docs and i != max(holders[key(line)])
    return {i: "\n".join(x for x in (text or "").split("\n") if not gone(i, x)) for i, text in docs.items()}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    ws, lines = words(text), [x for x in (text or "").split("\n") if x.strip(SPACE)]
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    repeat = {p for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    failed = len(ws) < 50 or 100 * len(repeat) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), failed


def fingerprint(text):
    ws = words((text or "").translate(AZ))
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=2):
    """{id: smallest id reachable} of {id: fingerprint}."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def contaminated(text, benchmark, window=10):
    """(n_hit, item ids) of a text against {item: text}."""
    ws, hit, found = items(text), set(), set()
    for item, other in benchmark.items():
        their = items(other)
        n = min(window, len(their))
        spans = {tuple(their[i : i + n]) for i in range(len(their) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1):
            if n and tuple(ws[i : i + n]) in spans:
                found.add(item)
                hit |= set(range(i, i + n))
    return len(hit), sorted(map(str, found))


def substring_dedup(docs, window=20):
    """{id: kept words} of {id: text}."""
    seen, out = set(), {}
    for i in sorted(docs):
        ws = words(docs[i])
        gone = set()
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s : s + window])
            if w in seen:
                gone |= set(range(s, s + window))
            seen.add(w)
        out[i] = [w for p, w in enumerate(ws) if p not in gone]
    return out


KINDS = ("assign", "access", "hex")


def secrets(text):
    out = []
    word = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[1]) >= 12:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))
