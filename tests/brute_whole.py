"""Plain Python versions of the retrieval queries, on the patterns of the surveyed service."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

from groundspark.config import Config
from groundspark.functions import text as T
from groundspark.operators import graph as G

CFG = Config()


def tokens(text):
    return re.findall(T.WORD, text.lower())


def content(text):
    return {t for t in tokens(text) if len(t) > 2}


def embedding(text, dim):
    v = [0.0] * dim
    ws = tokens(text)

    def add(f, s, w):
        h = int(hashlib.md5(f"{f}:{s}".encode()).hexdigest(), 16)
        v[h % dim] += w if h >> 31 & 1 else -w

    for i, w in enumerate(ws):
        stop = w in T.STOP_WORDS
        add(w, 1, (0.2 if stop else 1.0) * (1 + 1 / (i + 1)))
        for n in (3, 4) if len(w) >= 3 and not stop else ():
            for k in range(len(w) - n + 1):
                add(w[k : k + n], n, 0.35)
        if i + 1 < len(ws) and not (stop and ws[i + 1] in T.STOP_WORDS):
            add(f"{w}_{ws[i + 1]}", 7, 0.75)
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm > 1e-9 else [dim**-0.5] * dim


def canonical(name):
    kept = re.sub(r"[^a-zA-Z0-9\s]", "", re.sub("[-_]", " ", name))
    return re.sub(r"\s+", "_", kept.strip().lower())


def entities(text):
    """{canonical_id: smallest name}"""
    names = [t.strip() for t in re.findall(G.BACKTICKED, text) if len(t) >= 2] + [t for t in re.findall(G.CAPITALISED, text) if len(t) >= 3]
    names = {n for n in names if n.lower() not in G.STOP_ENTITIES}
    names |= {" ".join(w[:1].upper() + w[1:] for w in k.split(" ")) for k in G.KEYWORDS if re.search(rf"\b{k}\b", text.lower())}
    out = {}
    for n in sorted(names):
        c = canonical(n)
        if len(c) >= 2 and c not in G.STOP_ENTITIES:
            out.setdefault(c, n)
    return out


def triples(text, ents):
    """[(source, target)] of a text, one for each sentence and relation."""
    out = []
    for s in re.split(T.PLAIN_SENTENCE, text):
        s = s.lower()
        for pattern, _ in G.RELATIONS:
            m = re.search(pattern, s)
            if m is None:
                continue
            spots = []
            for c, name in ents.items():
                at = s.find(name.lower())
                at = at if at >= 0 else s.find(c.replace("_", " "))
                if at >= 0:
                    spots.append((at, c))
            before = sorted((-p, c) for p, c in spots if p < m.start())
            after = sorted((p, c) for p, c in spots if p > m.start())
            if before and after and before[0][1] != after[0][1]:
                out.append((before[0][1], after[0][1]))
    return out


def seeds(query, named):
    """Entities ``{canonical_id: name}`` that a query names."""
    asked = query.lower().split()
    text = " ".join(asked)
    return {c for c, n in named.items() if n.lower() in text or c in asked or any(len(w) > 3 and w in asked for w in n.lower().split())}


def graph_ranking(query, docs, cfg=CFG):
    """The best documents ``[doc_id]`` by the entity graph; ``docs`` is {doc_id: text}."""
    ents = {d: entities(t) for d, t in docs.items()}
    named = {}
    for d in sorted(ents):
        for c, n in ents[d].items():
            named.setdefault(c, n)
    edges = [(s, t, d) for d, x in docs.items() for s, t in triples(x, ents[d])]
    near = defaultdict(set)
    for s, t, _ in edges:
        near[s].add(t)
        near[t].add(s)
    start = seeds(query, named)
    depth, front = dict.fromkeys(start, 0), set(start)
    for k in range(1, cfg.graph_depth + 1):
        front = set(sorted({b for a in front for b in near[a]} - set(depth))[: cfg.graph_max_nodes])
        depth |= dict.fromkeys(front, k)
    kept = {n for i, n in enumerate(sorted(depth, key=lambda n: (depth[n], n))) if depth[n] == 0 or i < cfg.graph_max_nodes}
    score = Counter()
    for d in docs:
        for c in kept & set(ents[d]):
            score[d] += 2.0 if depth[c] == 0 else 1.0
    for s, t, d in edges:
        if s in kept and t in kept:
            score[d] += 1.5
    return sorted(score, key=lambda d: (-score[d], d))[: cfg.graph_top_k]


def bm25_ranking(query, docs, cfg=CFG):
    tf = {d: Counter(tokens(t)) for d, t in docs.items()}
    avgdl = sum(sum(c.values()) for c in tf.values()) / len(tf) or 1.0
    score = Counter()
    for term in tokens(query):
        df = sum(term in c for c in tf.values())
        idf = max(math.log(1 + (len(tf) - df + 0.5) / (df + 0.5)), 0.01)
        for d, c in tf.items():
            if term in c:
                score[d] += idf * c[term] * (cfg.bm25_k1 + 1) / (c[term] + cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * sum(c.values()) / avgdl))
    return sorted(score, key=lambda d: (-round(score[d], 10), d))[: cfg.bm25_top_k]


def dense_ranking(query, docs, cfg=CFG):
    q = embedding(query, cfg.embedding_dim)
    score = {d: round(sum(a * b for a, b in zip(q, embedding(t, cfg.embedding_dim))), 12) for d, t in docs.items()}
    return sorted(score, key=lambda d: (-score[d], d))[: cfg.dense_top_k]


def channel_ranks(query, rows, cfg=CFG):
    """{doc_id: {channel: rank}} of ``rows (doc_id, text, lang, source)``."""
    listed = {
        "dense": dense_ranking(query, {r[0]: f"{r[3]}: {r[1]}" for r in rows}, cfg),
        "bm25": bm25_ranking(query, {r[0]: f"{r[3]} {r[2]} {r[1]}" for r in rows}, cfg),
        "graph": graph_ranking(query, {r[0]: r[1] for r in rows}, cfg),
    }
    out = defaultdict(dict)
    for m, ids in listed.items():
        for k, d in enumerate(ids, start=1):
            out[d][m] = k
    return out


def fused(ranks, cfg=CFG):
    return {d: sum((cfg.graph_weight if m == "graph" else 1.0) / (cfg.rrf_k + k) for m, k in x.items()) for d, x in ranks.items()}


def reranked(query, rows, ranks, cfg=CFG):
    """[(doc_id, score)], best first."""
    by_id, rrf, q = {r[0]: r for r in rows}, fused(ranks, cfg), content(query)
    score = {}
    for d, x in ranks.items():
        full = 10 * rrf[d] + 0.4 * len(q & content(by_id[d][1])) / max(len(q), 1) + 0.15 * min(sum(t in by_id[d][2].lower() for t in q), 3) + 0.25 * max(len(x) - 1, 0)
        score[d] = full if q else rrf[d]
    return sorted(score.items(), key=lambda p: (-round(p[1], 10), p[0]))[: cfg.final_top_k]


def stems(text):
    out = set()
    for w in tokens(re.sub("[-_]", " ", text)):
        if len(w) <= 2 or w in T.NEGATIONS:
            continue
        cut = next((n for s, n, least in (("ing", 3, 5), ("ed", 2, 4), ("es", 2, 4), ("s", 1, 3)) if w.endswith(s) and len(w) > least), 0)
        out.add(w[: len(w) - cut])
    return out


def alignment(claim, context, cfg=CFG):
    """``(recall, cosine, score, contradicts)``."""
    own, other = stems(claim), stems(context)
    shared = len(own & other)
    recall = shared / len(own) if own else 0.0
    cosine = sum(a * b for a, b in zip(embedding(claim, cfg.embedding_dim), embedding(context[: cfg.context_chars], cfg.embedding_dim)))
    a, b = set(re.findall(T.NUMBER, claim)), set(re.findall(T.NUMBER, context))
    clash = bool(a and b and not a & b) or re.search(T.NEGATED, claim.lower()) is not None
    return recall, cosine, 0.6 * cosine + 0.4 * recall, shared >= 3 and clash


def status(claim, contexts, cfg=CFG):
    """``(status, cited)`` of a claim; ``contexts`` is [(chunk_id, text)] in order of rank."""
    got = [(c, *alignment(claim, x, cfg)) for c, x in contexts]
    against = next((c for c, *_, bad in got if bad), None)
    if against is not None:
        return "CONTRADICTION", against
    best = max((g for g in got if g[3] > 0), key=lambda g: round(g[3], 10), default=None)
    if best is None:
        return "NEUTRAL", None
    return "ENTAILED" if best[3] >= cfg.entailment_threshold else "NEUTRAL", best[0] if best[3] > cfg.cite_threshold else None


def pagerank(edges, damping=0.85, rounds=1000):
    """Ranks of directed edges, to convergence."""
    nodes = sorted({x for e in edges for x in e})
    out, score = Counter(a for a, _ in edges), dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        lost = sum(score[n] for n in nodes if not out[n])
        new = dict.fromkeys(nodes, (1 - damping) / len(nodes) + damping * lost / len(nodes))
        for a, b in edges:
            new[b] += damping * score[a] / out[a]
        score = new
    return score
