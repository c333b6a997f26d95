"""Plain Python versions of the contract results, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def decontamination(docs, items):
    """docs: [(doc_id, text)], items: [(item_id, text)] -> {doc_id: (n_words, n_hit, n_items, sha)}"""
    wins = {}
    for item, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[s:s + n]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[k]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


RULES = {
    "assign": re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    text, out = text or "", []
    for k, (kind, pat) in enumerate(RULES.items()):
        for m in pat.finditer(text):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out)), [sum(s == k for _, s, _ in out) for k in range(3)]


def crc(text):
    return zlib.crc32((text or "").encode())


def targets(sizes, share=1.5):
    """{source: words} -> {source: target}, weights 5, 2, 1 in code point order, NULL last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: 2.0 * sizes[s] for s in names}
        level = (total - sum(2.0 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2.0 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def shingles(text):
    w = space_words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def near_duplicates(docs):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), find(d)) for d, s in sets}


def quality(text):
    text = text or ""
    w = space_words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if space_words(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def blank(text):
    return not re.search(r"[^\x20\x09-\x0D]", text)


def damaged(rows):
    """rows: [(conv, turn, role, text)] -> {conv: [(turn, role, text)]} after the damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def repair_conversation(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation by a shortest path over whole edit strings."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        faults.append("blank" if blank(text) else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {}  # (rows left, last initial) -> (cost, audit, turns), found from the end

    def finish(i, last, inserts):
        key = (i, last, inserts)
        if key in best:
            return best[key]
        options = []
        if i == len(rows):
            if last in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, audit, left = finish(i + 1, last, 2)
            options.append((cost + 3, "D" + audit, left))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                for edit, price, new in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if new[:1] and new[:1] in follows[last]:
                        cost, audit, left = finish(i + 1, new[:1], 2)
                        options.append((cost + price + more, edit + audit, (f"{new}:{text}", left)))
        if inserts:
            for new in ("user", "assistant"):
                if new[0] in follows[last]:
                    cost, audit, left = finish(i, new[0], inserts - 1)
                    options.append((cost + 2, "I" + audit, (f"{new}:", left)))
        best[key] = min(options, key=lambda o: o[:2]) if options else (10 ** 9, "", ())
        return best[key]

    for i in range(len(rows), -1, -1):  # no deep recursion
        for last in follows:
            for inserts in range(3):
                finish(i, last, inserts)
    cost, audit, left = finish(0, "", 2)
    lines = []
    while left:
        lines.append(left[0])
        left = left[1]
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(lines)))


def merkle(docs):
    """docs: [(doc_id, source, lang, n_chars, text)] -> sorted [(doc_id, leaf, subroot, root, proof, folded, verified)]"""
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def up(nodes):
        return [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append(up(levels[-1]))
        return levels

    def path(levels, pos):
        out = []
        for nodes in levels[:-1]:
            run = list(range(pos // 8 * 8, min(pos // 8 * 8 + 8, len(nodes))))
            out.append(([nodes[i] for i in run if i < pos], [nodes[i] for i in run if i > pos]))
            pos //= 8
        return out

    def key(v):
        return (v is not None, v if v is not None else 0)

    langs = sorted({r[2] for r in docs}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted((r for r in docs if r[2] == lang), key=lambda r: (key(r[0]), leaf(r))) for lang in langs]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, group in enumerate(groups):
        for pos, row in enumerate(group):
            steps = path(trees[k], pos) + path(top, k)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            node = leaf((*row[:4], row[4].translate(LOWER)) if bad else row)
            for left, right in steps:
                node = sha("".join([*left, node, *right]))
            out.append((row[0], leaf(row), trees[k][-1][0], top[-1][0], sha("".join(x for left, right in steps for x in left + right)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def near(text, item):
    """Any alignment, any window: 8 of 10 words (all of a shorter item up to 8) within one position of their place."""
    words, w = plain_words(text), plain_words(item)
    size, need = min(10, len(w)), min(8, len(w))
    where, close = defaultdict(list), defaultdict(set)
    for i, t in enumerate(words):
        where[t].append(i)
    for p, t in enumerate(w):
        for i in where[t]:
            for d in (-1, 0, 1):
                close[i - p + d].add(p)
    return bool(size) and any(sum(p in places for p in range(s, s + size)) >= need for places in close.values() if len(places) >= need for s in range(len(w) - size + 1))
