"""The operators again, a document at a time, in plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import zstandard

from lodestone.llm import langid, mixing, packing, queries


def text_bytes(t):
    b = t.encode()
    return np.frombuffer(b, np.uint8), np.array([0, len(b)], np.int64)


def words(t):
    return re.findall("[a-z0-9\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u167f]+", (t or "").lower())


def shingle_set(t):
    w = words(t)
    k = min(3, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def classes(rows):
    """doc_id -> the least doc_id with the same words in the same order, over (doc_id, text), ids all different."""
    first = {}
    return {i: first.setdefault(tuple(words(t)), i) if words(t) else i for i, t in sorted(rows)}


def near_pairs(rows, threshold=0.5):
    """(a, b) -> similarity of the pairs of classes that are near."""
    cls = classes(rows)
    sets = {i: shingle_set(t) for i, t in rows if cls[i] == i and words(t)}
    holders, pairs = defaultdict(set), {}
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j > i}:
            if (v := jaccard(s, sets[j])) >= threshold:
                pairs[i, j] = v
    return pairs


def decided(cls, pairs):
    """doc_id -> (class, number of near classes, document kept for it)."""
    beside = defaultdict(set)
    for a, b in pairs:
        beside[a].add(b)
        beside[b].add(a)
    kept, lost = set(), {}
    for i in sorted(beside, key=lambda i: (-len(beside[i]), hashlib.md5(str(i).encode()).hexdigest(), i)):
        if not beside[i] & kept:
            kept.add(i)
    for i in beside:
        if i not in kept:
            # Kept ones near it that were decided before it: all kept ones are, as it would have stopped the others.
            lost[i] = min(beside[i] & kept)
    return {i: (c, len(beside[c]), lost.get(c, c)) for i, c in cls.items()}


def language(t, dicts):
    """(language, accepted) of a text."""
    words = re.findall(rb"[a-z\x80-\xff]+", (t or "").lower().encode())
    if not words or not dicts:
        return None, False
    whole = b" " + b" ".join(words) + b" "
    sizes = {}
    for lang in sorted(dicts):
        d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[lang] = sum(len(c.compress(whole[a : a + langid.BLOCK_BYTES])) for a in range(0, len(whole), langid.BLOCK_BYTES))
    order = sorted(sizes, key=lambda x: (sizes[x], x))
    if len(order) == 1:
        return order[0], True
    best, second = sizes[order[0]], sizes[order[1]]
    return order[0], second > best and (second - best) / best >= langid.MIN_MARGIN


def mixed(rows, weights, fraction):
    """(doc_id, source, n_tokens, finish, mixed_tokens) over (doc_id, source, text), ids all different."""
    queue = defaultdict(list)
    for i, s, t in rows:
        place = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], 16)
        queue[s].append((place, i, len(re.findall(r"[^ \t\n\r\f]+", t or ""))))
    timed = []
    for s, q in queue.items():
        own = 0
        for place, i, n in sorted(q):
            own += n
            timed.append((own / weights.get(s, 1.0), s is not None, s or "", place, i, n, s))
    budget, done, out = math.floor(sum(x[5] for x in timed) * fraction), 0, []
    for finish, _, _, _, i, n, s in sorted(timed):
        done += n
        if done > budget:
            break
        out.append((i, s, n, finish, done))
    return out


def mix_documents(rows):
    return mixed(rows, queries.WEIGHTS, mixing.BUDGET_FRACTION)


def tokens(t):
    """Words with the white space after them; what leads the text goes with its first."""
    parts = re.findall(r"[^ \t\n\r\f]+[ \t\n\r\f]*", t)
    lead = re.match(r"[ \t\n\r\f]*", t)[0]
    if not parts:
        return [t] if t else []
    return [lead + parts[0], *parts[1:]]


def packed(rows, size):
    """(pack_id, position, doc_id, start, n_tokens, text) over (doc_id, text), ids all different."""
    keyed = sorted((int(packing.curve_keys(*text_bytes(t))[0]), i, t) for i, t in rows if t)
    out, place = [], 0
    for _, i, t in keyed:
        words, start = tokens(t), 0
        while start < len(words):
            n = min(size - place % size, len(words) - start)
            out.append((place // size, place % size, i, start, n, "".join(words[start : start + n])))
            place, start = place + n, start + n
    return out


def ppm_bits(text, model_texts, order=4):
    """Code length of bytes under the counts of other texts: escapes of method C, with exclusion."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in model_texts:
        s = [256] * order + list(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][tuple(s[i - k : i])][s[i]] += 1
    s, bits = [256] * order + list(text), 0.0
    for i in range(order, len(s)):
        gone: set[int] = set()
        for k in range(order, -1, -1):
            seen = counts[k].get(tuple(s[i - k : i]), {})
            left = {b: n for b, n in seen.items() if b not in gone}
            total = sum(left.values()) + len(left)
            if s[i] in left:
                bits += math.log2(total / left[s[i]])
                break
            if left:
                bits += math.log2(total / len(left))
            gone |= set(seen)
        else:
            bits += math.log2(256 - len(gone))
    return bits
