"""Ranking and clustering of the pieces of one text, in NumPy: what the per-text extractors call for each row.

All sizes are those of a single text; nothing here sees more than one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

DAMPING = 0.85


def page_rank(n: int, source: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 50, tolerance: float = 1e-4) -> np.ndarray:
    """Unnormalised PageRank of weighted edges: s = 0.15 + 0.85 sum of s_j w_ji / out_j, all at once, from 1, until no score
    moves by the tolerance. A node without edges gets 0.15."""
    out = np.bincount(source, weight, n)
    share = np.divide(weight, out[source], out=np.zeros(len(weight)), where=out[source] > 0)
    scores = np.ones(n)
    for _ in range(rounds):
        new = (1 - DAMPING) + DAMPING * np.bincount(target, scores[source] * share, n)
        moved = np.abs(new - scores).max(initial=0.0)
        scores = new
        if moved < tolerance:
            break
    return scores


def descending(scores: np.ndarray) -> np.ndarray:
    """Places by falling score; scores that agree to 9 digits keep their order."""
    return np.lexsort((np.arange(len(scores)), -np.round(scores, 9)))


#: Sentences of a text whose common members are counted in a square table, and pairs that are counted at a time.
SQUARE, PAIRS = 4000, 1 << 20


def overlaps(sets: Sequence[set]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, Jaccard) of all ordered pairs of different sets that share a member, by an inverted index."""
    n, index = len(sets), {}
    size = np.fromiter(map(len, sets), np.int64, n)
    name = np.array([index.setdefault(x, len(index)) for s in sets for x in s], np.int64)
    order = np.argsort(name, kind="stable")
    row, times = np.repeat(np.arange(n), size)[order], np.bincount(name, minlength=len(index))
    start = np.cumsum(times) - times
    several = times[name[order]] > 1
    left, first, each = row[several], np.repeat(start, times)[several], np.repeat(times, times)[several]
    ends = np.cumsum(each)  # each row meets all rows of its member
    dense = np.zeros(n * n, np.int64) if n <= SQUARE else None
    codes = [np.zeros(0, np.int64)]
    at = 0
    while at < len(each):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        k = each[at:to]
        right = row[np.arange(k.sum()) + np.repeat(first[at:to] - (np.cumsum(k) - k), k)]
        code = np.repeat(left[at:to] * n, k) + right
        if dense is None:
            codes.append(code)
        elif n * n <= 8 * len(code):
            dense += np.bincount(code, minlength=n * n)
        else:
            np.add.at(dense, code, 1)
        at = to
    if dense is None:
        code, both = np.unique(np.concatenate(codes), return_counts=True)
    else:
        code = np.flatnonzero(dense)
        both = dense[code]
    i, j = code // max(n, 1), code % max(n, 1)
    other = i != j
    i, j, both = i[other], j[other], both[other]
    return i, j, both / (size[i] + size[j] - both)


def jaro_winkler(a: str, b: str) -> float:
    """Matches within half the longer length less one, a prefix of four at most, a tenth of what is left for each; the boost
    is always given. 0 where the window would be negative."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    if not a or not b or reach < 0:
        return 0.0
    free, mine = list(b), []
    taken: list[int] = []
    for i, c in enumerate(a):
        low = max(0, i - reach)
        try:
            j = free.index(c, low, min(i + reach + 1, len(b)))
        except ValueError:
            continue
        free[j] = ""
        mine.append(c)
        taken.append(j)
    if not mine:
        return 0.0
    odd = sum(x != b[j] for x, j in zip(mine, sorted(taken), strict=True))
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - odd / 2) / m) / 3
    same = 0
    while same < min(len(a), len(b), 4) and a[same] == b[same]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


#: Characters of a text whose places are bits of one number.
BIT_PLACES = 63


def jaro_winkler_pairs(texts: Sequence[str]) -> np.ndarray:
    """jaro_winkler(texts[j], texts[i]) for all j < i, both ways round: all pairs at a time, character by character, places
    as bits. Pairs with a text of more than BIT_PLACES characters are compared one by one."""
    n, size = len(texts), np.array([len(x) for x in texts], np.int64)
    out = np.zeros((n, n))
    for i in np.flatnonzero(size > BIT_PLACES).tolist():
        for j in range(n):
            out[i, j] = out[j, i] = jaro_winkler(texts[min(i, j)], texts[max(i, j)])
    short = np.flatnonzero(size <= BIT_PLACES)
    wide = int(size[short].max(initial=0))
    alphabet = {c: k for k, c in enumerate(dict.fromkeys("".join(texts)))}
    code, bits = np.full((n, wide), -1, np.int32), np.zeros((len(alphabet), n), np.uint64)
    for i in short.tolist():
        for p, c in enumerate(texts[i]):
            code[i, p] = alphabet[c]
            bits[alphabet[c], i] |= np.uint64(1 << p)
    at = np.tril_indices(len(short), -1)
    order = np.argsort(-size[short[at[1]]], kind="stable")  # longest first, so that pairs drop out from the end
    y, x = short[at[0]][order], short[at[1]][order]
    one, reach = np.uint64(1), np.maximum(size[x], size[y]) // 2 - 1
    ours, free = np.zeros((len(x), wide), bool), np.full(len(x), ~np.uint64(0))
    for p in range(wide):
        k = int(np.searchsorted(-size[x], -p))
        r = reach[:k]
        near = (one << np.minimum(p + r + 1, 63).astype(np.uint64)) - one & ~((one << np.maximum(p - r, 0).astype(np.uint64)) - one)
        hit = np.where(r >= 0, bits[code[x[:k], p], y[:k]] & free[:k] & near, np.uint64(0))
        free[:k] ^= hit & (~hit + one)  # the lowest place from p - reach to p + reach
        ours[:k, p] = hit > 0
    theirs = (~free[:, None] >> np.arange(wide, dtype=np.uint64) & one).astype(bool)
    m, rows = ours.sum(1), np.arange(len(x))
    odd = np.bincount(np.repeat(rows, m)[code[x][ours] != code[y][theirs]], minlength=len(x))  # both row by row, m of each
    jaro = (m / np.maximum(size[x], 1) + m / np.maximum(size[y], 1) + (m - odd / 2) / np.maximum(m, 1)) / 3
    same = np.logical_and.accumulate((code[x, :4] == code[y, :4]) & (code[x, :4] >= 0), axis=1).sum(1)
    _, name = np.unique(np.array(texts, object), return_inverse=True) if n else (None, np.zeros(0, np.int64))
    found = np.where(name[x] == name[y], 1.0, np.where(m > 0, jaro + 0.1 * same * (1 - jaro), 0.0))
    out[x, y] = out[y, x] = found
    return out


def average_linkage(similarity: np.ndarray, least: float) -> list[list[int]]:
    """Clusters by average linkage: the most similar pair (of equal ones the earliest) merges while it reaches least, and
    the merged cluster goes to the end. Row maxima are kept, so a merge costs as much as a row."""
    n = len(similarity)
    if n < 2:
        return [[i] for i in range(n)]
    total = np.zeros((2 * n - 1, 2 * n - 1))
    total[:n, :n] = similarity
    size = np.ones(2 * n - 1)
    members: list[list[int]] = [[i] for i in range(n)]
    alive = np.zeros(2 * n - 1, bool)
    alive[:n] = True
    best, partner = np.full(2 * n - 1, -np.inf), np.zeros(2 * n - 1, np.int64)

    def look(i: int) -> None:
        later = np.flatnonzero(alive[i + 1 :]) + i + 1
        best[i] = -np.inf
        if len(later):
            mean = total[i, later] / (size[i] * size[later])
            at = int(mean.argmax())
            best[i], partner[i] = mean[at], later[at]

    ahead = np.where(np.triu(np.ones((n, n), bool), 1), similarity, -np.inf)
    best[:n], partner[:n] = ahead.max(1), ahead.argmax(1)
    del ahead
    while alive.sum() > 1:
        a = int(np.where(alive, best, -np.inf).argmax())
        if not best[a] >= least or best[a] <= 0:
            break
        b, c = int(partner[a]), len(members)
        members.append(members[a] + members[b])
        size[c] = size[a] + size[b]
        total[c, :c] = total[a, :c] + total[b, :c]
        total[:c, c] = total[c, :c]
        alive[[a, b]], alive[c] = False, True
        at = np.flatnonzero(alive[:c])
        lost = ((partner[at] == a) | (partner[at] == b)) & (best[at] > -np.inf)
        mean = total[at, c] / (size[at] * size[c])
        nearer = ~lost & (mean > best[at])
        best[at[nearer]], partner[at[nearer]] = mean[nearer], c
        for i in at[lost].tolist():
            look(i)
        best[c] = -np.inf
    return [members[i] for i in np.flatnonzero(alive)]


def topic_rank(words: Sequence[str], longest: int = 4, most: int = 100, least: float = 0.3, n: int = 20, keep: Callable[[str], bool] = lambda x: len(x) > 1, joiner: str = "") -> list[tuple[str, float]]:
    """TopicRank: runs of up to longest words as candidates (the most frequent ones, first seen first), clustered by
    0.7 Jaro-Winkler + 0.3 Jaccard of words; clusters joined by the mean of 1 / distance of first places; PageRank of 30
    rounds; each of the n best clusters gives its most frequent candidate. Fewer than two candidates: those."""
    seen: dict[tuple[str, ...], list] = {}
    names: dict[str, tuple[str, ...]] = {}
    for i in range(len(words)):
        for k in range(1, min(longest, len(words) - i) + 1):
            run = tuple(words[i : i + k])
            text = joiner.join(run)
            if not keep(text):
                continue
            first = names.setdefault(text, run)
            seen.setdefault(first, [text, i, 0])[2] += 1
    found = sorted(seen.items(), key=lambda x: -x[1][2])[:most]
    if len(found) < 2:
        return [(x[0], 1.0) for _, x in found]
    m = len(found)
    sim = 0.7 * jaro_winkler_pairs([x[0] for _, x in found])
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for run, _ in found for w in run))}
    has = np.zeros((m, len(vocabulary)))
    for i, (run, _) in enumerate(found):
        has[i, [vocabulary[w] for w in run]] = 1.0
    both, own = has @ has.T, has.sum(1)
    sim = sim + 0.3 * both / (own[:, None] + own[None, :] - both)
    np.fill_diagonal(sim, 0.0)
    clusters = average_linkage(sim, least)
    place = np.array([x[1] for _, x in found], float)
    apart = np.abs(place[:, None] - place[None, :])
    member = np.zeros((len(clusters), m))
    for i, c in enumerate(clusters):
        member[i, c] = 1.0
    near = member @ np.divide(1.0, apart, out=np.zeros((m, m)), where=apart > 0) @ member.T
    pairs = member @ (apart > 0) @ member.T
    np.fill_diagonal(pairs, 0.0)
    target, source = np.nonzero(pairs)
    scores = page_rank(len(clusters), source, target, near[target, source] / pairs[target, source], 30)
    out = []
    for c in descending(scores)[:n]:
        top = max(clusters[c], key=lambda i: (found[i][1][2], -clusters[c].index(i)))
        out.append((found[top][1][0], float(scores[c])))
    return out


def multipartite_rank(sentences: Sequence[str], keywords: Sequence[Sequence[str]], places: Sequence[int], n: int = 20) -> list[tuple[str, float]]:
    """MultipartiteRank of sentences by their keywords: topics by average linkage of Jaccard at 0.25; edges between topics
    weigh Jaccard / distance; edges into each topic's first sentence gain 1.1 e^(1/(place+1)) times what the others of its
    topic give; PageRank of 100 rounds to 1e-6. Of the 50 best, those that aren't alike to a better one; n at most.
    Without edges: by number of keywords, then place."""
    sets = [set(k) for k in keywords]
    m = len(sets)
    if not m:
        return []
    i, j, x = overlaps(sets)
    sim = np.zeros((m, m))
    sim[i, j] = x
    clusters = average_linkage(sim, 0.25)
    order = np.array([k for c in clusters for k in c])  # as topics list them
    where = np.asarray(places)[order]
    at = np.argsort(order)
    label = np.repeat(np.arange(len(clusters)), [len(c) for c in clusters])
    source, target = at[i], at[j]
    apart = np.flatnonzero(label[source] != label[target])
    apart = apart[np.lexsort((target[apart], source[apart]))]
    source, target = source[apart], target[apart]
    if not len(apart):
        best = sorted(range(m), key=lambda k: (-len(keywords[order[k]]), places[order[k]]))[:n]
        return [(sentences[order[k]], 0.0) for k in best]
    weight = x[apart] / np.maximum(np.abs(where[source] - where[target]), 1)
    begin = 0
    for c in clusters:
        end = begin + len(c)
        if len(c) > 1:  # a topic of one sentence has no others
            first = begin + int(where[begin:end].argmin())
            low, high = np.searchsorted(source, [begin, end])  # edges are in order of their sources
            given = weight[low:high][source[low:high] != first].sum()
            into = target == first
            weight[into] += 1.1 * np.exp(1 / (where[first] + 1)) * given
        begin = end
    scores = page_rank(m, source, target, weight, 100, 1e-6)
    ranked = [(sentences[order[k]], float(scores[k])) for k in descending(scores) if len(sentences[order[k]]) >= 10][:50]
    out: list[tuple[str, float]] = []
    for text, score in ranked:
        if not any(similar_length(text, other) for other, _ in out):
            out.append((text, score))
    return out[:n]


def similar_length(a: str, b: str, least: float = 0.8) -> bool:
    """Whether two sentences count as alike, as executed: lengths within the ratio are enough by themselves (the test of a
    shared beginning that comes before asks for the same ratio)."""
    return min(len(a), len(b)) / max(len(a), len(b), 1) >= least


def keep_unlike(rows: Sequence, alike: Callable) -> list:
    """Greedy: a row stays unless it is alike to one that stayed before it."""
    out: list = []
    for x in rows:
        if not any(alike(x, y) for y in out):
            out.append(x)
    return out


def char_jaccard(a: str, b: str) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x or y else 0.0


def term_weights(words: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, word, weight) by list: unit vectors of term frequencies; words as numbers from 0."""
    index: dict[str, int] = {}
    word = np.array([index.setdefault(x, len(index)) for w in words for x in w], np.int64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    code, times = np.unique(row * max(len(index), 1) + word, return_counts=True)
    row, word = code // max(len(index), 1), code % max(len(index), 1)
    return row, word, times / np.sqrt(np.bincount(row, times * times, len(words)))[row]


def edit_similarity(a: str, b: str) -> float:
    """1 - Levenshtein distance / longer length; 0 where either is empty."""
    if not a or not b:
        return 0.0
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row = np.arange(len(y) + 1)
    step = np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - step) + step
    return 1 - int(row[-1]) / max(len(a), len(b))
