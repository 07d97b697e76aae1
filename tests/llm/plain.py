"""Plain versions of the learned stages: Python loops over bytes, without the library's functions."""

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

SEED, FACTOR, ALL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def mixed(h):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * factor & ALL
    return h ^ h >> 33


def hashed(b):
    if len(b) >= 512:
        return xxhash.xxh3_64_intdigest(b)
    h = len(b) * FACTOR & ALL ^ SEED
    for i in range(0, len(b), 8):
        h = mixed((h ^ int.from_bytes(b[i : i + 8], "little")) * FACTOR + SEED & ALL)
    return h


def chained(hs):
    h = len(hs)
    for x in hs:
        h = mixed((h ^ x) * FACTOR + SEED & ALL)
    return h


def lowered(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


# Toxicity.


def entries(word):
    w = b"\2" + word + b"\3"
    return [hashed(x) >> 44 for x in [w, *(w[i : i + n] for n in (3, 4, 5, 6) for i in range(len(w) - n + 1))]]


def toxic_scores(docs, labels):
    """{doc_id: score} for documents with distinct ids, as op10 defines it where all rows fit its bounds."""
    rows = docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("c"), F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(4)).alias("fold")).collect()
    toxic = {r["doc_id"] for r in labels.collect() if r["toxic"] == 1}
    memo = {}
    words = {r["doc_id"]: re.findall(rb"[0-9a-z\x80-\xff]+", lowered(r["text"])) for r in rows}
    for w in {w for own in words.values() for w in own}:
        memo[w] = entries(w)
    u = [(r["doc_id"], r["fold"]) for r in rows if r["c"] != 2]
    p = [x for x in u if x[0] in toxic]
    if not p:
        return {r["doc_id"]: 0.0 for r in rows}
    held = lambda group: {f: Counter(g for d, fold in group if fold == f for g in {g for w in words[d] for g in memo[w]}) for f in range(4)}
    sizes = lambda group: Counter(f for _, f in group)
    counts, totals = [held(p), held(u)], [sizes(p), sizes(u)]
    known = {g for f in range(4) for g in counts[0][f] if sum(counts[0][k][g] for k in range(4)) >= 2}

    def odds(folds, prior):
        n_p, n_u = (max(1, sum(t[f] for f in folds)) for t in totals)
        out = {}
        for g in known:
            a, b = (sum(c[f][g] for f in folds) for c in counts)
            if a >= 2:
                sa, sb = a / n_p, b / n_u
                x = prior * max(sa - math.sqrt(sa / n_p), 0)
                y = max(sb - prior * sa, 0) + 0.5 * math.sqrt(sb / n_u) + prior * 3 / n_p * 0.25
                out[g] = min(8.0, max(-8.0, math.log(x + 1e-9) - math.log(y)))
        return out

    def features(d, table):
        values = []
        for w in words[d]:
            best = sorted((table.get(g, -8.0) for g in memo[w]), reverse=True)[:5]
            values.append(sum((best + best[-1:] * 5)[:5]) / 5)
        n = len(values)
        return [max(values, default=-8.0), *(math.log1p(sum(v > level for v in values)) for level in (0, 1.5, 3)), math.log1p(n), math.log1p(1000 * sum(max(v, 0) for v in values) / max(n, 1))]

    def described(prior):
        tables = [odds([f for f in range(4) if f != own], prior) for own in range(4)]
        return [np.array([features(d, tables[f]) for d, f in group]) for group in (p, u)]

    least = len(p) / len(u)
    xp, xu = described(least)
    centre, scale = xu.mean(0), xu.std(0) + 1e-6
    w, _ = descend((xp - centre) / scale, (xu - centre) / scale, least, 0.5)
    sp, su = xp / scale @ w, xu / scale @ w
    slack = sum(math.sqrt(math.log(40) / (2 * len(s))) for s in (sp, su))
    bounds = [(((su >= c).mean() + slack) / (sp >= c).mean(), (su >= c).mean() / (sp >= c).mean()) for c in sorted(set(sp))]
    prior = min(0.9, max(least, min(bounds)[1]))
    xp, xu = described(prior)
    centre, scale = xu.mean(0), xu.std(0) + 1e-6
    w, b = descend((xp - centre) / scale, (xu - centre) / scale, prior, 0.3)
    final = odds(range(4), prior)
    margin = lambda d: float((np.array(features(d, final)) - centre) / scale @ w + b)
    return {d: 1 / (1 + math.exp(-min(30, max(-30, margin(d) + math.log(0.3 / 0.7))))) for d in words}


def descend(xp, xu, prior, flag):
    """Adam on the non-negative risk: 600 steps with the logistic loss, then 600 with the sigmoid loss."""
    xp, xu = (np.column_stack([x, np.ones(len(x))]) for x in (xp, xu))
    theta = np.zeros(xp.shape[1])
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    losses = [  # loss of calling a margin positive, and the slopes of a miss and of that loss
        (lambda z: np.log1p(np.exp(np.clip(z, -30, 30))), lambda z: 1 - sigma(z), sigma),
        (sigma, lambda z: sigma(z) * (1 - sigma(z)), lambda z: sigma(z) * (1 - sigma(z))),
    ]
    for loss, miss, slope in losses:
        first, second = 0.0, 0.0
        for t in range(1, 601):
            zp, zu = xp @ theta, xu @ theta
            clean = (slope(zu)[:, None] * xu).mean(0) - prior * (slope(zp)[:, None] * xp).mean(0)
            step = flag * clean - (1 - flag) * prior * (miss(zp)[:, None] * xp).mean(0) if loss(zu).mean() - prior * loss(zp).mean() >= 0 else -flag * clean
            step = step + 1e-4 * np.append(theta[:-1], 0)
            first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
            theta = theta - 0.05 * (1 - 0.9 * t / 600) * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], theta[-1]


# Quality.


def quality_features(text):
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+", (text or "").encode())
    shapes = []
    for i, t in enumerate(tokens):
        ups, digits = len(re.findall(rb"[A-Z]", t)), len(re.findall(rb"[0-9]", t))
        if not re.match(rb"[0-9A-Za-z\x80-\xff]", t):
            code = t[0] + (10 if len(t) == 1 else 300)
        else:
            code = 1 if digits == len(t) else 2 if digits else 3 if ups == len(t) > 1 else 4 if ups == 1 else 5 if ups > 1 else 6
        shapes.append(mixed((2 * code + (i > 0 and t == tokens[i - 1])) * SEED & ALL))
    own = [hashed(t) for t in tokens]
    out = own + shapes
    for stream, n in ((own, 2), (shapes, 2), (shapes, 3)):
        out += [chained(stream[i : i + n]) for i in range(len(stream) - n + 1)]
    return [x % 65536 for x in out]


def quality_keys(docs, labels):
    """({doc_id: (log weight, key, selected)}) for documents with distinct ids, as op4 defines it where all labels fit its bounds."""
    uniform = (F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.lit(77)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("c"), uniform.alias("u")).collect()
    known = {r["doc_id"]: r["quality"] for r in labels.select("doc_id", "quality", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("c")).collect() if r["c"] != 2 and r["quality"] is not None}
    found = {r["doc_id"]: quality_features(r["text"]) for r in rows}
    raw, good = Counter(), Counter()
    for d, f in found.items():
        raw.update(f)
        if known.get(d) == 1:
            good.update(f)
    if not good:
        return {r["doc_id"]: (0.0, None, True) for r in rows}
    sums = [sum(c.values()) + 0.5 * 65536 for c in (good, raw)]
    ratio = {k: math.log((good[k] + 0.5) / sums[0]) - math.log((raw[k] + 0.5) / sums[1]) for k in raw}
    weight = {d: math.fsum(ratio[k] for k in f) for d, f in found.items()}
    key = {r["doc_id"]: weight[r["doc_id"]] - math.log(-math.log(r["u"])) for r in rows}
    tried = sorted((weight[d], known[d]) for d in known if d in weight)
    cuts = [tried[0][0] - 1, *(w for w, _ in tried), tried[-1][0] + 1]
    options = []
    for i in range(len(tried) + 1):  # the first i are left out
        wrong = sum(q == 1 for _, q in tried[:i]) + sum(q != 1 for _, q in tried[i:])
        options.append((wrong, -(cuts[i + 1] - cuts[i]), i))
    i = min(options)[2]
    cut = (cuts[i] + cuts[i + 1]) / 2 if len({q for _, q in tried}) == 2 else -math.inf
    k = sum(w >= cut for w in weight.values())
    least = sorted(key.values(), reverse=True)[k - 1] if k < len(key) else -math.inf
    return {d: (weight[d], key[d], key[d] >= least) for d in weight}
