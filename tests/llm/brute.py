"""Plain Python statements of the corpus operators' results, for comparison on small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LAST = 2**63


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def op1(docs, shingle=3, percent=90):
    sets = []
    for d, t in docs:
        w = SPACED.findall(low(t or ""))
        sets.append(frozenset(tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 10 * min(len(a), len(b)) >= percent * max(len(a), len(b)) // 10:
                inter = len(a & b)
                if 100 * inter >= percent * (len(a) + len(b) - inter):
                    parent[root(i)] = root(j)
                    links[i] += 1
                    links[j] += 1
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), LAST), LAST if d is None else d)
    return sorted(((d, len(sets[i]), least[root(i)] if least[root(i)] != LAST else None, links[i]) for i, (d, _) in enumerate(docs)), key=str)


def op3(docs):
    return sorted(op3_rows(docs), key=str)


def op3_rows(docs):
    out = []
    for d, t in docs:
        t = t or ""
        words = SPACED.findall(t)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(windows)
        hit = set()
        for i, w in enumerate(windows):
            if n[w] > 1:
                hit.update(range(i, i + 8))
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        out.append(
            (
                d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit),
                len(words) < 20 or 100 * len(hit) > 30 * len(words),
            )
        )
    return out


def op4(docs, width=50):
    first = {}
    for d, t in docs:
        b, d = (t or "").encode(), LAST if d is None else d
        for i in range(len(b) - width + 1):
            first[b[i : i + width]] = min(first.get(b[i : i + width], LAST), d)
    out = []
    for d, t in docs:
        b, o = (t or "").encode(), LAST if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < o:
                gone[i : i + width] = b"\1" * width
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def op5(docs, width=3):
    rows = [(d, t, t.split("\n") if t is not None else []) for d, t in docs]
    first = {}
    order = lambda d: LAST if d is None else d
    for d, _, lines in rows:
        for i in range(len(lines) - width + 1):
            w = tuple(lines[i : i + width])
            if any(SPACED.search(x) for x in w):
                first[w] = min(first.get(w, (LAST, LAST)), (order(d), i))
    out = []
    for d, t, lines in rows:
        gone = set()
        for i in range(len(lines) - width + 1):
            w = tuple(lines[i : i + width])
            if w in first and (order(d), i) > first[w]:
                gone.update(range(i, i + width))
        kept = t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((d, len(lines), len(gone), None if kept is None else sha(kept.encode())))
    return sorted(out, key=str)


def op7(docs, items, width=10):
    windows = defaultdict(set)
    for k, t in items:
        w = ALNUM.findall(low(t or ""))
        for i in range(max(1, len(w) - width + 1)) if w else []:
            windows[tuple(w[i : i + width])].add(str(k))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = ALNUM.findall(low(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return sorted(out, key=str)


def op8_score(key, shard):
    import math

    u = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -1.0 / math.log(u)


def op8(docs, shards=24):
    out = []
    for d, t in docs:
        key = "" if d is None else str(d)
        scores = [op8_score(key, s) for s in range(shards + 1)]
        out.append(
            (
                d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), max(range(shards), key=lambda s: (scores[s], s)),
                max(range(shards + 1), key=lambda s: (scores[s], s)),
            )
        )
    return sorted(out, key=str)


def op9(docs, width=50):
    first, words = {}, []
    for d, t in docs:
        w = SPACED.findall(t or "")
        words.append(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, LAST), LAST if d is None else d)
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (LAST if d is None else d):
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return sorted(out, key=str)


def op10(pages):
    """Of rows with one page_id and payload only one is the response; which of them makes no difference to the result."""
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for p, _, h in pages:
        first[digest(h)] = min(first.get(digest(h), LAST), LAST if p is None else p)
    out, given = [], set()
    for p, _, h in pages:
        f = first[digest(h)]
        own = f == (LAST if p is None else p) and digest(h) not in given
        if own:
            given.add(digest(h))
        out.append((p, len((h or "").encode()), digest(h), "response" if own else "revisit", None if own or f == LAST else f))
    return sorted(out, key=str)


def quality(docs, rules, sp):
    """(doc_id, script, reason, kept) of (doc_id, text, lang): the bands stated text by text."""
    import math

    def script_of(c):
        n = len(c.encode())
        x = ord(c)
        if c.isascii():
            return "latin" if c.isalpha() else None
        lead = c.encode()[0]
        if 0xC3 <= lead <= 0xC9:
            return "latin"
        if 0xCD <= lead <= 0xCF:
            return "greek"
        if 0xD0 <= lead <= 0xD3:
            return "cyrillic"
        if 0xE3 <= lead <= 0xED:
            return "cjk"
        if 0xD4 <= lead <= 0xE1 or (n == 4 and not 0x1F000 <= x <= 0x1FFFF):
            return "other"
        return None

    out = []
    base = {str(r[0]) + "|" + str(i): r for i, r in enumerate(op3_rows([(d, t) for d, t, _ in docs]))}
    for i, (d, t, lang) in enumerate(docs):
        words = SPACED.findall(t or "")
        ids = [k for w in words for k in sp.encode(w)]
        n, chars = max(len(ids), 1), sum(map(len, words))
        bits = -sum(m / n * math.log2(m / n) for m in Counter(ids).values()) if ids else 0.0
        count = Counter(s for c in t or "" if (s := script_of(c)))
        names = ("latin", "greek", "cyrillic", "cjk", "other")
        script = max(names, key=lambda s: (count[s], -names.index(s))) if count else "none"
        band = rules.language_bands.get(lang) or rules.bands[script]
        most = math.log2(min(max(len(ids), 2), sp.get_piece_size()))
        least = 0.0
        if band.min_entropy_bits:
            x = min(max(math.log2(n), 5), 13)
            k = min(int(x), 12)
            a, b = band.min_entropy_bits[k - 5], band.min_entropy_bits[k - 4]
            least = a + (b - a) * (x - k)
        reason = ""
        if bits / most < band.min_relative_entropy or bits < least:
            reason = "entropy"
        if sum(sp.is_byte(k) for k in ids) / n > band.max_byte_share:
            reason = "byte fallback"
        if not band.min_chars_per_token <= chars / n <= band.max_chars_per_token:
            reason = "fertility"
        if base[f"{d}|{i}"][-1]:
            reason = "base"
        out.append((d, script, reason, reason == ""))
    return sorted(out, key=str)


def urls(pages, rules):
    """(page_id, verdict, decided_by) of (page_id, url, html), by the standard library's parser and joins."""
    from html.parser import HTMLParser
    from urllib.parse import urldefrag, urljoin

    class Links(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found, self.base = [], None

        def handle_starttag(self, tag, attrs):
            a = {k: v or "" for k, v in reversed(attrs)}
            if tag == "base" and "href" in a and self.base is None:
                self.base = a["href"]
            if tag == "link" and "canonical" in a.get("rel", "").lower().split():
                self.found.append(a.get("href", ""))
            if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
                self.found.append(a.get("content", "").partition("url=")[2].strip())

    def split(url):
        rest = url.partition("://")[2] if url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return low(host), re.match(r"[^?#]*", rest[len(host) :])[0], re.match(r"[^#]*", rest[len(host) :])[0]

    def rule(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text)).verdict if fits else None

    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, url, html in pages:
        p = Links()
        p.feed(html or "")
        if url and "://" in url:
            for t in p.found:
                full = urldefrag(urljoin(urljoin(url, p.base or ""), t))[0]
                if "://" in full:
                    a, b = ((lambda s: s[0] + s[2])(split(x)) for x in (url, full))
                    if a and b and a != b:
                        up[root(a)] = root(b)
    votes = defaultdict(set)
    for node in list(up):
        host = re.match(r"[^/?#]*", node)[0]
        votes[root(node)].add(rule(host, re.match(r"[^?#]*", node[len(host) :])[0]))
    out = []
    for i, url, _ in pages:
        host, path, tail = split(url)
        own = rule(host, path)
        said = votes[root(host + tail)] if host + tail in up else set()
        passed = "allow" if "allow" in said else "block" if "block" in said else None
        out.append((i, own or passed or "allow", "rule" if own else "alias" if passed else "default"))
    return sorted(out, key=str)
