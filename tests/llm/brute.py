"""Plain versions of what the operators compute, written from their contracts."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

WORDS = re.compile("[^\x20\x09-\x0D]+")
LICENSE_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text, n=3):
    words = WORDS.findall(lower(text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    """{key: least key reachable}, of all pairs."""
    keys = sorted(items)
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if root(a) != root(b) and linked(items[a], items[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in keys}


def shingles(text, n):
    words = WORDS.findall(lower(text or ""))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or ({" ".join(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def exact_groups(rows):
    """{doc_id: (keep_id, group_size, kept, sha)} for distinct ids."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc))
    out = {}
    for plain, members in groups.items():
        keep = min(members)[1]
        for _, doc in members:
            out[doc] = (keep, len(members), doc == keep, hashlib.sha256(plain.encode()).hexdigest())
    return out


def url_verdict(url, rules, method):
    host, path = "", ""
    if url and "://" in url:
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = lower(m[1]), m[2]
    fit = [(h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        h, p, v = max(fit, key=lambda r: len(r[0] + r[1]))
        return host, path, h + p, v
    return host, path, None, "block" if method(host + path) else "allow"


def glob_regex(glob):
    parts = re.split(r"(\*\*|\*)", glob)
    return re.compile("(?s)" + "".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts))


def phrase_places(text, phrases):
    words = LICENSE_WORDS.findall(lower(text or ""))
    places, labels = [], set()
    for label, phrase in phrases:
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        if found:
            labels.add(label)
    return words, places, labels


def template_labels(words, templates, containment):
    """templates: (label, its words, must, never)."""
    best, labels = 0.0, set()
    for label, own, must, never in templates:
        tokens, size = set(own), 8
        while size < len(own):
            size *= 2
        for start in range(0, max(1, len(words)), size):
            block = set(words[start : start + 2 * size])
            share = len(tokens & block) / len(tokens)
            if share >= containment - 1e-9 and block >= set(must) and not block & set(never):
                labels.add(label)
                best = max(best, share)
    return best, labels


def base_spans(text):
    kinds = (
        ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
