"""Plain restatements of the contracts, for small inputs."""

from __future__ import annotations

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def joined(ids, links):
    """Smallest id that each id reaches."""
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


def near_components(docs, percent=75):
    sets = [(i, shingles(t)) for i, t in docs]
    links = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[:x]
             if a and b and 100 * len(a & b) >= percent * len(a | b)]
    return joined([i for i, _ in docs], links)


def contamination(text, items, window=10):
    words = TERM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item_id, body in items:
        own = TERM.findall((body or "").translate(LOWER))
        size = min(window, len(own))
        if not size:
            continue
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def line_dedup(docs, least=3, words=50):
    """``{id: (lines, removed, kept text)}``; ids are unique. Windows of ``least`` lines, and shorter ones of ``words`` words."""
    first, lines = {}, {}

    def windows(own):
        for size in range(1, least + 1):
            for p in range(len(own) - size + 1):
                run = tuple(x for _, x in own[p:p + size])
                if size == least or len(re.findall(r"[^\x20\x09-\x0D]+", "\n".join(run))) >= words:
                    yield p, size, run

    for i, t in sorted(docs):
        lines[i] = [(n, x) for n, x in enumerate((t or "").split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", x)] if t is not None else []
        for p, _, run in windows(lines[i]):
            first.setdefault(run, (i, p))
    out = {}
    for i, t in docs:
        own, gone = lines[i], set()
        for p, size, run in windows(own):
            j, q = first[run]
            if j != i or p >= q + size:
                gone |= {n for n, _ in own[p:p + size]}
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        out[i] = (len(own), len(gone), kept)
    return out


def longest_line_runs(docs):
    """``{(id, place): (lines, first id, first place)}``: the longest run at each place that also begins at an earlier one, without overlap."""
    first, lines = {}, {i: [x for x in t.split("\n") if x.strip()] for i, t in docs}
    for i in sorted(lines):
        for p in range(len(lines[i])):
            for end in range(p + 1, len(lines[i]) + 1):
                first.setdefault(tuple(lines[i][p:end]), (i, p))
    out = {}
    for i, own in lines.items():
        for p in range(len(own)):
            for end in range(p + 1, len(own) + 1):
                j, q = first[tuple(own[p:end])]
                if j != i or q + end - p <= p:
                    out[i, p] = (end - p, j, q)
    return out


def substring_dedup(docs, least=50):
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        for q in range(len(b) - least + 1):
            first.setdefault(b[q:q + least], i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - least + 1):
            if first[b[q:q + least]] < i:
                gone[q:q + least] = b"\x01" * least
        out.append((i, len(b), sum(gone), bytes(gone).count(b"\x00\x01") + gone[:1].count(1), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def secret_base(text):
    """``kind:start:end`` of the fixed patterns, restated character by character where that is plain."""
    text, out = text or "", []
    kinds = ["assign", "access", "hex"]
    for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for kind, letters, head, least in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 18), (2, "0123456789abcdef", "", 16)):
        at = 0
        while at < len(text):
            begin = text.find(head, at) if head else at
            if begin < 0:
                break
            end = begin + len(head)
            while end < len(text) and text[end] in letters:
                end += 1
            if end > begin + len(head) and end - begin >= least:
                out.append((begin, kind, end))
            at = max(end, begin + 1) if end > begin + len(head) else begin + 1
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(out))
