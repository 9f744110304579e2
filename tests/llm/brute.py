"""Plain, slow versions of the queries over rows in memory, written from the contracts alone."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


WS = "\t\n\x0b\f\r "


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(s: str | bytes) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def nearest(rows: list[tuple], k: int = 5, every: int = 50) -> set[tuple]:
    """(query_id, rank, vec_id, score rounded) of rows (vec_id, embedding)."""
    good = {i: v for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for q, a in good.items():
        if q % every:
            continue
        scored = sorted((-math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(y * y for y in b)), i) for i, b in good.items() if i != q)
        out |= {(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(scored[:k])}
    return out


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps: list[tuple[int | None, int]], radius: int = 3) -> list[tuple]:
    """(doc_id, fingerprint hex, component) for (doc_id, fingerprint) rows."""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in fps]


def line_dedup(rows: list[tuple], min_chars: int = 40, min_docs: int = 5) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept_sha256) for (doc_id, text) rows."""
    holders: dict[str, set] = defaultdict(set)
    key = lambda x: lower(x.strip(WS))
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if d is not None and len(k) >= min_chars:
                holders[k].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def judge(rows: list[tuple], rules: list[tuple], default: str = "allow") -> list[tuple]:
    """(page_id, host, path, rule, verdict) for (page_id, url) rows."""
    out = []
    for i, url in rows:
        head, mark, rest = (url or "").partition("://")
        rest = rest if mark else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = lower(host)
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, default))
        out.append((i, host, path, best[2], best[3]))
    return out


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def decontam(docs: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows: dict[tuple, set] = defaultdict(set)
    for i, t in items:
        ws = words(t)
        for at in range(max(1, len(ws) - window + 1) if ws else 0):
            windows[tuple(ws[at : at + window])].add(i)
    sizes = sorted({len(w) for w in windows})
    out = []
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for at in range(len(ws)):
            for n in sizes:
                own = windows.get(tuple(ws[at : at + n])) if at + n <= len(ws) else None
                if own is not None:
                    hit |= set(range(at, at + n))
                    found |= {str(i) for i in own if i is not None}
        out.append((d, len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def tiktoken_rows(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by the tiktoken library."""
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((d, len(ids), sha(",".join(map(str, ids))), sha(enc.decode_bytes(ids))))
    return out


def secrets(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ]
    out = []
    for d, t in rows:
        spans = sorted((m.start(), k, m.end()) for k, (_, rx, g, n) in enumerate(kinds) for m in re.finditer(rx, t or "") if len(m[g]) >= n)
        shown = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        out.append((d, *(sum(s[1] == k for s in spans) for k in range(3)), sha(shown), shown))
    return out


def interleave(rows: list[tuple], shards: int, seed: str) -> list[tuple]:
    """(doc_id, size, text_crc32, shard, slot) of (doc_id, source, text) rows."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    by_source: dict = defaultdict(list)
    for d, s, t in rows:
        size, crc = len((t or "").encode()) + 1, zlib.crc32((t or "").encode())
        by_source[s].append((md5(f"{seed}:{'' if d is None else d}:{crc}:{size}"), d is not None, d or 0, crc, size, d))
    order = []
    for s, own in by_source.items():
        shift = int(md5(f"{seed}|{s or ''}")[:8], 16) / 2**32
        order += [((r + shift) / len(own), s is not None, s or "", *row) for r, row in enumerate(sorted(own, key=lambda x: x[:5]))]
    n, out, slots = len(order), [], defaultdict(int)
    for p, row in enumerate(sorted(order, key=lambda x: x[:-1])):
        shard = p * shards // n
        out.append((row[-1], row[-2], row[-3], shard, slots[shard]))
        slots[shard] += 1
    return out


def statistics(text: str | None) -> list[float]:
    """The statistics of a text, one by one."""
    raw = (text or "").encode()
    odds = lambda part, whole: math.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw.lower())
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\f\r")]
    n, m, k = len(raw), len(words), len(lines)
    in_class = lambda rx: len(re.findall(rx, raw))
    small, big, digits, white, marks, wide = map(in_class, (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[\x20\x09-\x0D]", rb"[.,;:!?'\"()-]", rb"[\x80-\xff]"))
    sizes = [len(w) for w in words]
    return [
        math.log1p(n), math.log1p(m), math.log1p(sum(sizes) / m if m else 0), math.log1p(m / max(k, 1)),
        odds(small, n), odds(big, n), odds(digits, n), odds(white, n), odds(marks, n), odds(n - small - big - digits - white - marks - wide, n), odds(wide, n),
        odds(len(set(words)), m), odds(max((words.count(w) for w in set(words)), default=0), m) if m < 3000 else odds(max(Counter(words).values()), m),
        odds(sum(s <= 3 for s in sizes), m), odds(sum(s >= 12 for s in sizes), m),
        odds(k - len(set(lines)), k), odds(sum(x.rstrip(b" \t\x0b\f\r")[-1:] in (b".", b"!", b"?") for x in lines), k),
        odds(len(re.findall(rb"[.!?](?:[\x20\x09-\x0D]|\Z)", raw)), max(m, 1)),
    ]


def quality(rows: list[tuple], labels: list[tuple], shrink: float = 0.2, ridge: float = 0.05) -> list[tuple]:
    """(doc_id, score) of (doc_id, text) rows: Gaussians refitted from the definitions, densities by solving with the covariances."""
    import numpy as np

    xs = [(d, np.array(statistics(t))) for d, t in rows]
    known = {(d, q) for d, q in labels if q in (0, 1)}
    own = [np.array([x for d, x in xs if (d, k) in known]) for k in (0, 1)]
    seen = [len(o) for o in own]
    own = [o if len(o) else own[1 - k] for k, o in enumerate(own)]
    dim = len(statistics(""))
    covs = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(len(o) * c for o, c in zip(own, covs, strict=True)) / sum(map(len, own))
    prior = np.maximum(seen, 0.5) / np.maximum(seen, 0.5).sum()
    models = []
    for o, c in zip(own, covs, strict=True):
        lam = min(1.0, shrink + dim / (dim + len(o)))
        full = (1 - ridge) * ((1 - lam) * c + lam * pooled) + ridge * max(np.trace(pooled) / dim, 1e-6) * np.eye(dim)
        models.append((o.mean(axis=0), np.linalg.inv(full), np.linalg.slogdet(full)[1]))
    out = []
    for d, x in xs:
        a, b = (math.log(p) - 0.5 * (det + (x - m) @ inv @ (x - m)) for p, (m, inv, det) in zip(prior, models, strict=True))
        out.append((d, 1 / (1 + math.exp(min(max(a - b, -700), 700)))))
    return out


def language_grams(text: str) -> list[int]:
    """Buckets of 1- to 3-grams of the folded text, each hashed by itself."""
    m32, out = (1 << 32) - 1, []
    chars = [ord(c) for c in " " + " ".join(text.lower().split()) + " "]
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            h = 0x9E37 + n
            for c in chars[i : i + n]:
                h = (h ^ c) * 0x85EBCA6B & m32
                h ^= h >> 15
            out.append((h * 0xC2B2AE35 & m32) >> 16)
    return out


def languages(rows: list[tuple], learn: list[tuple], alpha: float = 0.1, sharpness: float = 40.0) -> list[tuple]:
    """(doc_id, lang_pred, score) of (doc_id, text) rows by naive Bayes over dictionaries; learns from (text, lang)."""
    counts: dict[str, dict[int, int]] = {}
    docs: dict[str, int] = defaultdict(int)
    for text, lang in learn:
        if text is not None and lang is not None:
            docs[lang] += 1
            own = counts.setdefault(lang, defaultdict(int))
            for g in language_grams(text):
                own[g] += 1
    whole = {x: sum(c.values()) + alpha * (1 << 16) for x, c in counts.items()}
    out = []
    for d, text in rows:
        if text is None or not counts or not any(c.isalpha() for c in text):
            out.append((d, "und", 0.0))
            continue
        grams = language_grams(text)
        prior = {x: math.log(docs[x] / sum(docs.values())) for x in counts}
        total = {x: sum(math.log((counts[x].get(g, 0) + alpha) / whole[x]) for g in grams) for x in counts}
        best = max(sorted(counts), key=lambda x: prior[x] + total[x])
        scaled = {x: prior[x] + total[x] * min(1.0, sharpness / len(grams)) for x in counts}
        out.append((d, best, 1 / sum(math.exp(scaled[x] - scaled[best]) for x in counts)))
    return out


def filter_audit(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    """Every order played through on (doc_id, text, lang) rows; labels are (doc_id, quality, toxic)."""
    least: dict[str, object] = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    docs = []
    for d, t, lang in rows:
        t = t or ""
        words = t.encode().split()
        bad = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and d > least[t],
        }
        good, toxic = (any(x[0] == d and x[k] == 1 for x in labels) and d is not None for k in (1, 2))
        docs.append((lang or "", {f for f, b in bad.items() if b}, good, toxic))
    out, shapley = [], defaultdict(int)
    for part in sorted({p for p, *_ in docs}):
        own = [x[1:] for x in docs if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                left = [x for x in own if not x[0] & set(order[: step - 1])]
                gone = [x for x in left if f in x[0]]
                shapley[part, f] += len(gone)
                redundant = sum(f in x[0] and bool(x[0] & set(order[: step - 1])) for x in own)
                out.append((part, order, step, len(left) - len(gone), len(gone), redundant, sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
    return [(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out]


def importance(rows: list[tuple], target: list, percent: int = 25, least: int = 20) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows; ids differ."""
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")

    def features(text):
        w = word.findall(lower(text or ""))
        return w, [zlib.crc32(f.encode()) % 10000 for f in w + [" ".join(p) for p in zip(w, w[1:], strict=False)]]

    source, wanted = (Counter(b for t in texts for b in features(t)[1]) for texts in ([t for _, t in rows], target))
    s_all, t_all = source.total(), wanted.total()
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000))))
    out, able = {}, []
    for d, t in rows:
        w, f = features(t)
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[d] = (d, len(f), weight, score)
        able += [(-score, d)] * (len(w) >= least)
    rank = {d: k for k, (_, d) in enumerate(sorted(able)[: percent * len(able) // 100], 1)}
    return [(*r, rank.get(d)) for d, r in out.items()]


def shingle_components(rows: list[tuple], percent: int = 85, size: int = 3) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows; all pairs are compared."""
    sets = []
    for _, t in rows:
        w = lower(t or "").encode().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least: dict[int, list] = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] * (d is not None)
    return [(d, len(sets[i]), c := min(least[find(i)], default=None), d == c) for i, (d, _) in enumerate(rows)]
