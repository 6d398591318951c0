"""Words of unspaced text by a unigram lattice, without a dictionary: piece probabilities are fitted on the corpus itself by
expectation maximisation, and the most probable cut of a text is found by Viterbi's algorithm.

Each round is a pass over the texts that sums expected counts within each task, and one grouped sum; what is broadcast is the
list of pieces, whose number is a parameter. A piece stays if it shortens the description of the corpus by more than its own. Pieces never cross white space or marks, and runs of ASCII letters and digits are
pieces as they stand, as they need no cutting."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces at most (single characters come on top), characters of a piece, least count of a seed, rounds.
PIECES, LONGEST, LEAST, ROUNDS = 20_000, 6, 3, 4
#: ASCII words, or runs of other word characters.
RUN = re.compile(r"[A-Za-z0-9_]+|[^\W\x00-\x7F]+")
#: Log-probability of a character that the model hasn't seen.
UNSEEN = -25.0
#: Nats that a character of a piece costs to name.
PRICE = 4.0
#: Different runs that a task counts before it hands them on.
HELD = 200_000


def runs_to_cut(text: str) -> list[str]:
    return [r for r in RUN.findall(text) if r[0] > "\x7f"]


def expected(run: str, model: dict[str, float], longest: int = LONGEST) -> tuple[dict[str, float], float]:
    """How often each piece is expected in a run over all its cuts, by probability; and the run's log-likelihood."""
    n = len(run)
    edges = [(i, j, run[i:j], model.get(run[i:j], UNSEEN if j == i + 1 else None)) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1)]
    edges = [e for e in edges if e[3] is not None]
    ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = behind[n] = 0.0
    for i, j, _, p in edges:  # by first place, so every way to i is known
        ahead[j] = _logsum(ahead[j], ahead[i] + p)
    for i, j, _, p in sorted(edges, key=lambda e: -e[1]):
        behind[i] = _logsum(behind[i], behind[j] + p)
    out: dict[str, float] = {}
    for i, j, piece, p in edges:
        out[piece] = out.get(piece, 0.0) + math.exp(ahead[i] + p + behind[j] - ahead[n])
    return out, ahead[n]


#: Characters of runs that are worked on together.
BLOCK = 200_000


def expected_of(held: Mapping[str, float], model: dict[str, float], longest: int = LONGEST) -> dict[str, float]:
    """The sum of times * expected(run) over runs with their times: all runs of a block go ahead together, place by place."""
    number = {piece: i for i, piece in enumerate(model)}
    out: dict[str, float] = {}
    block, size = [], 0
    for run in held:
        block.append(run)
        size += len(run)
        if size >= BLOCK:
            _expected_of(block, held, model, dict(number), longest, out)
            block, size = [], 0
    if block:
        _expected_of(block, held, model, dict(number), longest, out)
    return out


def _expected_of(runs: list[str], held: Mapping[str, float], model: dict[str, float], number: dict[str, int], longest: int, out: dict[str, float]) -> None:
    runs = sorted(runs, key=len, reverse=True)
    text, size = "".join(runs), np.array([len(r) for r in runs], np.int64)
    total = len(text)
    start = np.cumsum(size) - size
    own = np.repeat(np.arange(len(runs)), size)
    place = np.arange(total) - start[own] + 1
    names = np.full((longest, total + longest), -1, np.int64)  # of the piece of k + 1 characters that ends there
    names[0, :total] = [number.setdefault(c, len(number)) for c in text]
    for k in range(2, longest + 1):
        names[k - 1, k - 1 : total] = [number.get(text[i - k : i], -1) for i in range(k, total + 1)]
        names[k - 1, :total][place < k] = -1
    logs = np.array([*model.values(), *[UNSEEN] * (len(number) - len(model)), -np.inf])
    p = logs[names]
    node = start + np.arange(len(runs))  # a run of n characters has n + 1 places
    ahead, behind = np.zeros(total + len(runs)), np.zeros(total + len(runs) + longest)
    for j in range(1, int(size[0]) + 1):
        m = int(np.searchsorted(-size, -j, "right"))
        x = np.stack([ahead[node[:m] + j - k] + p[k - 1, start[:m] + j - 1] for k in range(1, min(longest, j) + 1)])
        ahead[node[:m] + j] = _logsums(x)
        at = size[:m] - j
        x = np.stack([behind[node[:m] + at + k] + p[k - 1, start[:m] + at + k - 1] for k in range(1, min(longest, j) + 1)])
        behind[node[:m] + at] = _logsums(x)
    end = node[own] + place
    times = np.array([held[r] for r in runs], float)[own]
    sums = np.zeros(len(number))
    for k in range(1, longest + 1):
        at = np.flatnonzero(names[k - 1, :total] >= 0)
        x = ahead[end[at] - k] + p[k - 1, at] + behind[end[at]] - ahead[node + size][own[at]]
        sums += np.bincount(names[k - 1, at], times[at] * np.exp(x), len(number))
    there = np.zeros(len(number), bool)
    there[names[names >= 0]] = True
    for piece, i in number.items():
        if there[i]:
            out[piece] = out.get(piece, 0.0) + float(sums[i])


def _logsums(x: np.ndarray) -> np.ndarray:
    most = x.max(0)  # a single character is always a piece, so it is finite
    return most + np.log(np.exp(x - most).sum(0))


def _logsum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def best_cut(run: str, model: dict[str, float], longest: int = LONGEST) -> list[str]:
    """The most probable cut; of equal ones that with the longer last piece."""
    n = len(run)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            p = model.get(run[i:j], UNSEEN if j == i + 1 else None)
            if p is not None and best[i] + p > best[j]:
                best[j], back[j] = best[i] + p, i
    out, j = [], n
    while j:
        out.append(run[back[j] : j])
        j = back[j]
    return out[::-1]


def words_of(text: str, model: dict[str, float]) -> list[str]:
    """ASCII words as they stand, other runs cut."""
    return [p for r in RUN.findall(text) for p in ([r] if r[0] <= "\x7f" else best_cut(r, model))]


def _counted(texts: DataFrame, column: str, of) -> DataFrame:
    """piece, n: sums of of(runs with their times) -> {piece: number} over all runs; runs that repeat in a task are worked on once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def handed() -> pd.DataFrame:
            out = of(held)
            held.clear()
            return pd.DataFrame(list(out.items()), columns=["piece", "n"])

        for b in batches:
            for t in b[column].dropna():
                held.update(runs_to_cut(t))
                if len(held) >= HELD:
                    yield handed()
        yield handed()

    return texts.select(column).mapInPandas(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))


def substrings(held: Mapping[str, float], longest: int = LONGEST) -> dict[str, float]:
    """How often each substring occurs in runs with their times."""
    out: dict[str, float] = {}
    for run, times in held.items():
        for i in range(len(run)):
            for j in range(i + 1, min(len(run), i + longest) + 1):
                piece = run[i:j]
                out[piece] = out.get(piece, 0.0) + times
    return out


def _model(counts: DataFrame, pieces: int) -> tuple[dict[str, float], dict[str, float]]:
    """Log-probabilities and counts of the most expected pieces (ties by piece) and of all single characters."""
    long = counts.where("length(piece) > 1 and n > 0").orderBy(F.desc("n"), "piece").limit(pieces)
    rows = long.unionByName(counts.where("length(piece) = 1 and n > 0")).collect()  # pieces and the alphabet at most
    numbers = {r["piece"]: r["n"] for r in sorted(rows, key=lambda r: r["piece"])}
    return _logs(numbers), numbers


def _logs(numbers: dict[str, float]) -> dict[str, float]:
    total = math.fsum(numbers.values())
    return {piece: math.log(n / total) for piece, n in numbers.items()}


def pruned(model: dict[str, float], numbers: dict[str, float], pieces: int, longest: int = LONGEST, price: float = PRICE) -> dict[str, float]:
    """Counts of the pieces that are worth their place: those whose occurrences would cost more by their best other cut than
    the piece itself costs to name (price a character), the dearest first. What a compound's parts say as well goes."""
    worth = {}
    for piece, n in numbers.items():
        if len(piece) > 1:
            others = {piece[i:j]: model[piece[i:j]] for i in range(len(piece)) for j in range(i + 1, len(piece) + 1) if j - i < len(piece) and piece[i:j] in model}
            other = sum(others.get(x, UNSEEN) for x in best_cut(piece, others, longest))
            worth[piece] = n * (model[piece] - other) - price * len(piece)
    kept = sorted((x for x, w in worth.items() if w > 0), key=lambda x: (-worth[x], x))[:pieces]
    return {x: numbers[x] for x in sorted([*kept, *(x for x in numbers if len(x) == 1)])}


def fit(texts: DataFrame, column: str, pieces: int = PIECES, rounds: int = ROUNDS, least: int = LEAST) -> dict[str, float]:
    """The pieces of texts(column) with their log-probabilities: seeds are substrings that occur often enough; each round
    expects counts over all cuts and drops pieces that aren't worth their place. No text: no pieces."""
    seeds = _counted(texts, column, substrings).where(f"n >= {least} or length(piece) = 1")
    model, _ = _model(seeds, 4 * pieces)
    for k in range(rounds):
        sent = texts.sparkSession.sparkContext.broadcast(model)
        counts = _counted(texts, column, lambda held, sent=sent: expected_of(held, sent.value))
        kept = counts.where("n >= 0.5 or length(piece) = 1").withColumn("n", F.greatest("n", F.lit(1e-6)))
        model, numbers = _model(kept, 4 * pieces)
        if model:
            model = _logs(pruned(model, numbers, pieces if k == rounds - 1 else 2 * pieces))
        sent.destroy()
    return model


class Segmenter:
    """A fitted model as a tokenizer of the extractors: a column of texts, or of arrays of texts, to words."""

    def __init__(self, model: dict[str, float], shortest: int = 2):
        self.model, self.shortest = model, shortest

    def words(self, text: str | None) -> list[str]:
        return [w for w in words_of(text or "", self.model) if len(w) >= self.shortest]

    def __call__(self, text: Column) -> Column:
        own = self.words

        @F.pandas_udf("array<string>")
        def cut(x: pd.Series) -> pd.Series:
            return x.map(own)

        return cut(text)

    def of_array(self, texts: Column) -> Column:
        """Words of each text of an array (Spark has no Python functions within transform)."""
        own = self.words

        @F.pandas_udf("array<array<string>>")
        def cut(x: pd.Series) -> pd.Series:
            return x.map(lambda a: None if a is None else [own(t) for t in a])

        return cut(texts)
