"""Plain, slow versions of the operators, one document or window at a time."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def decontamination(docs, items):
    """docs: (doc_id, text); items: (item_id, text)."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = pattern.findall(lower(text or ""))
        n = min(13, len(words))
        for i in range(len(words) - n + 1) if n else []:
            windows[tuple(words[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = pattern.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(words), len(hit), len(names), sha(",".join(names)),
                    len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def pieces(docs, tokenizer, max_len=2048):
    out = []
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        lengths = [max_len] * (len(ids) // max_len)
        rest, bit = len(ids) % max_len, max_len
        while bit := bit // 2:
            if rest & bit:
                lengths.append(bit)
        start = 0
        for n in lengths:
            part = ids[start : start + n]
            out.append((doc, start, n, zlib.crc32(struct.pack(f"<{n}I", *part)), len(ids)))
            start += n
    return out


def fingerprint(text) -> int:
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs, distance=4):
    prints = [(doc, fingerprint(text)) for doc, text in docs]
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for doc, f in prints:
        r = find(f)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return [(doc, f"{f:016x}", least.get(find(f))) for doc, f in prints]


def word_dedup(docs, window=20):
    """docs in any order; ids must be distinct."""
    words = {doc: WORD.findall(text or "") for doc, text in docs}
    seen, out = set(), []
    for doc in sorted(words):
        w, gone = words[doc], set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def byte_dedup(docs, length=400):
    texts = [(doc, (text or "").encode()) for doc, text in docs]
    times = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def words_base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(repeat))


def aligned(a, b):
    """Pairs of places that a patience diff of two lists of lines matches, by plain recursion.

    Of equally long chains it takes the one that comes latest in ``a``, looked at from its end.
    """
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in aligned(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return aligned(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    common = [x for x in dict.fromkeys(a) if x in b]
    single = [x for x in common if a.count(x) == b.count(x) == 1]
    places = lambda side, x: [i for i, y in enumerate(side) if y == x]
    pairs = sorted(p for x in single or common for p in zip(places(a, x), places(b, x), strict=False))
    if not pairs:
        return []
    longest = []
    for i, j in pairs:
        longest.append(1 + max((n for (_, m), n in zip(pairs, longest, strict=False) if m < j), default=0))
    chain, want, before = [], max(longest), len(b)
    for (i, j), n in reversed(list(zip(pairs, longest, strict=True))):
        if n == want and j < before:
            chain.append((i, j))
            want, before = n - 1, j
    chain.reverse()
    out, last = [], (-1, -1)
    for i, j in [*chain, (len(a), len(b))]:
        gap = aligned(a[last[0] + 1 : i], b[last[1] + 1 : j])
        out += [(last[0] + 1 + x, last[1] + 1 + y) for x, y in gap] + [(i, j)]
        last = i, j
    return out[:-1]


def lines_cut(docs):
    """A text loses what its alignment with any earlier text deletes: common blocks with a word.

    Order is doc_id, nulls last, then place; equal texts are one text, of which the first stays.
    """
    first = {}
    for k, (_, text) in sorted(enumerate(docs), key=lambda x: (x[1][0] is None, x[1][0], x[0])):
        if text:
            first.setdefault(text, k)
    split = {t: t.split("\n") for t in first}
    words = {t: {x for x in lines if WORD.search(x)} for t, lines in split.items()}
    gone = defaultdict(set)
    for n, t in enumerate(split):
        for before in list(split)[:n]:
            if not words[t] & words[before]:
                continue
            block = []
            for i, j in [*aligned(split[before], split[t]), (-9, -9)]:
                if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                    if any(WORD.search(split[t][y]) for _, y in block):
                        gone[t].update(y for _, y in block)
                    block = []
                block.append((i, j))
    out, texts = [], []
    for k, (doc, text) in enumerate(docs):
        parts = (text or "").split("\n") if text else []
        removed = gone[text] if text and first[text] == k else set()
        if text and first[text] != k and any(WORD.search(x) for x in parts):
            removed = set(range(len(parts)))
        left = [x for i, x in enumerate(parts) if i not in removed]
        out.append((doc, len(parts), len(removed), sha("\n".join(left))))
        kept = "\n".join(left) if removed else text
        texts.append((doc, None if removed and not WORD.search(kept) else kept))
    return out, texts


def line_dedup(docs):
    return lines_cut(docs)[0]


def line_texts(docs):
    """(doc_id, text) with None for documents that go."""
    return [(d, t if t is not None or had is not None else "") for (d, t), (_, had) in
            zip(lines_cut(docs)[1], docs, strict=True)]


def section_tokens(docs, tokenizer, rule):
    """Lines with their breaks; offsets of the tokenizer itself."""
    out = []
    for doc, text in docs:
        lines, at = [], 0
        for x in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
            lines.append((at, at + len(x)))
            at += len(x)
        spans = tokenizer.encode(text or "", add_special_tokens=False).offsets
        count, crossing = [0] * len(lines), [0] * len(lines)
        for a, b in spans:
            common = [(min(b, e) - max(a, s), -k) for k, (s, e) in enumerate(lines) if min(b, e) > max(a, s)]
            if rule == "split":
                for n, k in common:
                    count[-k] += n / sum(c for c, _ in common)
                    crossing[-k] += len(common) > 1
            else:
                k = -(max(common) if rule == "most" else common[0])[1]
                count[k] += 1
                crossing[k] += len(common) > 1
        if not lines:
            out.append((doc, None, None, None, 0, 0, len(spans)))
        for k, (s, e) in enumerate(lines):
            out.append((doc, k, s, e, count[k], crossing[k], len(spans)))
    return out
