"""Plain single-machine versions of the contracts, written from their wording."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def token_ids(text: str | None) -> list[int]:
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def token_rows(docs: list[tuple[int, str | None]], by_id: bool = True) -> list[tuple]:
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: d[0]) if by_id else docs:
        ids = token_ids(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(fps: list[int], bits: int = 4) -> list[int]:
    """For each row the first row that links of at most ``bits`` bits reach."""
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def simhash_rows(docs: list[tuple[int, str | None]]) -> list[tuple]:
    docs = sorted(docs, key=lambda d: d[0])
    fps = [fingerprint(t) for _, t in docs]
    return [(d, f"{f:016x}", docs[g][0]) for (d, _), f, g in zip(docs, fps, groups(fps))]


def windows(items: list[tuple[int, str | None]], size: int = 10) -> dict[tuple, set[str]]:
    found = defaultdict(set)
    for item_id, text in items:
        words = decontam_words(text)
        for i in range(max(1, len(words) - size + 1)) if words else ():
            found[tuple(words[i : i + size])] |= {str(item_id) if item_id is not None else None}
    return found


def decontam_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def decontam_row(text: str | None, known: dict[tuple, set[str]]) -> tuple:
    words, hit, items = decontam_words(text), set(), set()
    for n in {len(w) for w in known}:
        for i in range(len(words) - n + 1):
            if (window := tuple(words[i : i + n])) in known:
                hit |= set(range(i, i + n))
                items |= known[window]
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items - {None})).encode()).hexdigest(), bool(hit)


def matches(text: str | None, items: list[str | None], window: int = 10) -> list[tuple[int, int]]:
    """(start, length) of the matches with items that no longer one holds, in words; those
    of an item of fewer words than a window are the whole item."""
    words, found = decontam_words(text), set()
    for item in map(decontam_words, items):
        for a in range(len(words)):
            for b in range(len(item)):
                n = next((k for k in range(min(len(words) - a, len(item) - b)) if words[a + k] != item[b + k]), min(len(words) - a, len(item) - b))
                if n and n >= min(window, len(item)):
                    found.add((a, n))
    return sorted((a, n) for a, n in found if not any((b <= a and a + n <= b + m and (a, n) != (b, m)) for b, m in found))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(x.lstrip("0")[:9] or 0) for x in m[0].split(".")) > 255:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


def mix_targets(sizes: dict) -> dict:
    """Source → words it should get."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:  # reshare what the capped sources leave until none is above its cap
        level = (sum(sizes.values()) - sum(target.values())) / max(1, sum(weight[s] for s in free))
        above = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in above}
        free -= above


def mix_queue(rows: list[tuple[int, str | None, int]], packet: int = 256) -> list[tuple]:
    """(doc_id, source, size) → the queue in its order: (finish, source, doc_id, pass,
    words served) of each packet, 0 after the budget is spent."""
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    target, waiting = mix_targets(sizes), []
    for name in sizes:
        own = sorted((r for r in rows if r[1] == name), key=lambda r: (hashlib.md5(f"mix:{r[0]}:{r[2]}".encode()).hexdigest(), r[0]))
        at = 0
        for e in range(3):
            for doc_id, _, size in own:
                for k in range(0, size, packet):
                    words = min(packet, size - k)
                    at += words
                    waiting.append((at / target[name], name is None, name or "", at, doc_id, e, words))
    left, out = sum(sizes.values()), []
    for finish, none, name, _, doc_id, e, words in sorted(waiting):
        out.append((finish, None if none else name, doc_id, e, min(words, left)))
        left -= out[-1][-1]
    return out


def mix_counts(rows: list[tuple[int, str | None, int]]) -> dict[int, list[int]]:
    """(doc_id, source, size) → words taken in each of three passes."""
    out = {doc_id: [0, 0, 0] for doc_id, _, _ in rows}
    for _, _, doc_id, e, words in mix_queue(rows):
        out[doc_id][e] += words
    return out


def toxicity_score(folded: str, weights: dict, phrases: set, curve: tuple | None) -> float:
    """Of a folded text: each word's longest term, but for words of an exception phrase."""
    if curve is None:
        return 0.0
    words, total = re.findall(r"[^\W_]+", folded), 0.0
    for i, word in enumerate(words):
        terms = [t for t in weights if word == t or len(t) >= 4 and word.startswith(t)]
        pairs = {f"{a} {b}" for a, b in zip(words[max(0, i - 1) : i + 1], words[max(0, i - 1) + 1 : i + 2])}
        if terms and not pairs & set(phrases):
            total += weights[max(terms, key=len)]
    a, b, c = curve
    spaces = sum(x in " \n" for x in folded)
    return 1 / (1 + math.exp(-(a + b * math.log1p(total) + c * math.log1p(spaces))))


def within_one(a: list, b: list) -> bool:
    """Whether one insertion, deletion or replacement makes ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def line_rows(docs: list[tuple[int | None, str | None]], least: int = 8) -> dict[tuple, tuple]:
    """(doc_id, text) → text, n_lines, n_same, n_near; every line is held against all
    earlier. Wholly equal rows are one, rows of equal id go by the hash of their text."""
    seen: list[list[str]] = []
    near: list[bool] = []
    place, out = {}, {}

    def order(doc: tuple) -> tuple:
        digest = xxhash.xxh64(doc[1].encode(), seed=42).intdigest() if doc[1] is not None else 42
        return doc[0] is None, doc[0] or 0, digest - (1 << 64) if digest >> 63 else digest

    for doc_id, text in sorted(set(docs), key=order):
        kept, same, close = [], 0, 0
        lines = text.split("\n") if text is not None else []
        for line in lines:
            words = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
            key = tuple(words)
            if not words:
                kept.append(line)
                continue
            if key in place:
                same, close = same + (not near[place[key]]), close + near[place[key]]
                continue
            is_near = len(words) >= least and any(len(w) >= least and within_one(words, w) for w in seen)
            place[key] = len(seen)
            seen.append(words)
            near.append(is_near)
            if is_near:
                close += 1
            else:
                kept.append(line)
        out[doc_id, text] = ("\n".join(kept) if text is not None else None, len(lines), same, close)
    return out


def trie_rows(rows: list[tuple]) -> list[tuple]:
    """Nodes from (conv_id, turn, role, text): a dictionary of all prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    for turns in own.values():
        turns.sort()
    members, ends, built = defaultdict(set), defaultdict(list), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(math.fmod(c, 5)), [])
        built[c] = [t[3:] for t in (*base[:h], *turns[h:])]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].add(c)
        ends[tuple(built[c])].append(c)
    children, out = defaultdict(list), []
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[x] for x in children[node])
        joined = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=repr)


def ranked_rows(items: list[tuple], docs: list[tuple], k: int = 10) -> list[tuple]:
    """(item_id, rank, doc_id, score) by the wording of the score, every item against all."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)) for _, t in docs]
    n_docs, n_words = sum(bool(w) for w in words), sum(map(len, words))
    counts = [{t: w.count(t) for t in set(w)} for w in words]
    df = defaultdict(int)
    for c in counts:
        for t in c:
            df[t] += 1
    out = []
    for item_id, text in items:
        terms, found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)), []
        for (doc_id, _), w, c in zip(docs, words, counts):
            m = 25 + 75 * len(w) * n_docs // n_words if n_words else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, i + 1, None if none else doc_id, -score) for i, (score, none, doc_id) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)
