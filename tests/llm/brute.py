"""Brute-force versions of the operators, straight from their definitions."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def mix_targets(docs, weights=(5, 2, 1), cap=3):
    """docs: (id, source, text). Source -> (size, target), by rounds of resharing."""
    sizes = collections.Counter()
    for _, source, text in docs:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {s: (sizes[s], float(fixed[s] if s in fixed else share[s])) for s in order}
        fixed |= {s: cap * sizes[s] for s in over}


def repeats(docs, k=20):
    """docs: (id, text). (id, words, removed words, digest of what is kept)."""
    first, out = {}, []
    for i, t in sorted(docs):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if first.setdefault(tuple(w[s : s + k]), (i, s)) != (i, s):
                gone[s : s + k] = [True] * k
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def shingles(text, k):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(docs, k, percent=80):
    """docs: (id, text) with distinct ids. (id, set size, component, kept)."""
    sets = {i: shingles(t, k) for i, t in docs}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    both = collections.Counter(p for own in holders.values() for p in itertools.combinations(sorted(own), 2))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def quality(text):
    """(words, code points in words, symbols, duplicate lines, words in repeated 3-word windows)."""
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    times = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def kneser_ney(counts, order=4, discount=0.75):
    """counts: language -> {n-gram of ``order`` characters: count}. Language -> probability of a character after a context.

    Straight from the recursion: the highest order takes counts, the lower ones
    the number of different characters before; what is discounted goes to the
    order below, down to an equal share for all known characters and one unknown.
    """
    alphabet = {c for grams in counts.values() for g in grams for c in g}
    everywhere = {n: {g[-n:][:-1] for grams in counts.values() for g in grams} for n in range(1, order + 1)}

    def probability(language, context, c):
        p = 1 / (len(alphabet) + 1)
        for n in range(1, order + 1):
            own = collections.Counter()
            if n == order:
                own.update(counts[language])
            else:
                for g in {g[order - n - 1 :] for g in counts[language]}:
                    own[g[1:]] += 1
            h = context[len(context) - n + 1 :]
            if h not in everywhere[n]:
                break  # no language knows the context, so no longer one either
            followers = {g: k for g, k in own.items() if g[:-1] == h}
            total = sum(followers.values())
            if total:
                p = max(followers.get(h + c, 0) - discount, 0) / total + discount * len(followers) / total * p
        return p

    return probability



def word_features(text):
    """Each word's own form, beginnings and ends of 4 to 6 characters, as names of features."""
    out = set()
    for word in (text or "").lower().split():
        word = word.strip(".,;:!?#$%&*|<>()[]{}\"'")
        out.add("=" + word)
        for n in (4, 5, 6):
            if len(word) >= n:
                out |= {"^" + word[:n], word[len(word) - n :] + "$"}
    return out


def best_features(rows, labels, most, least):
    """The names with the largest chi-squared value of each category, among those that ``least`` texts have."""
    n, chosen = len(rows), set()
    has = collections.Counter(x for own in rows for x in own)
    for category in zip(*labels):
        share = sum(category) / n
        positive = collections.Counter(x for own, y in zip(rows, category) if y for x in own)
        gain = {x: (positive[x] - c * share) ** 2 / (c * (1 - c / (n + 1))) for x, c in has.items() if c >= least}
        chosen |= set(sorted(gain, key=lambda x: (-gain[x], x))[:most])
    return sorted(chosen)


def logistic(x, y, penalty=1e-4, rounds=60):
    """Penalised logistic regression by damped Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-9])

    def loss(w):
        z = x @ w
        return np.mean(np.logaddexp(0, z) - y * z) + w @ ridge @ w / 2

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(x) + ridge, x.T @ (p - y) / len(x) + ridge @ w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    return w


def chain(x, labels, fold):
    """Links in order; each but the first also sees the earlier links' probabilities, from fits without the row's fold.

    Returns a function from a dense matrix to probabilities.
    """
    links, seen = [], x
    for k in range(labels.shape[1]):
        y = labels[:, k]
        links.append(logistic(seen, y))
        apart = np.zeros(len(x))
        for f in set(fold.tolist()):
            w = logistic(seen[fold != f], y[fold != f])
            apart[fold == f] = 1 / (1 + np.exp(-(seen[fold == f] @ w[:-1] + w[-1])))
        seen = np.hstack([seen, apart[:, None]])

    def predict(rows):
        out = []
        for w in links:
            out.append(1 / (1 + np.exp(-(rows @ w[:-1] + w[-1]))))
            rows = np.hstack([rows, out[-1][:, None]])
        return np.stack(out, axis=1)

    return predict
