"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two words counts their common subsequences of three signs, gaps allowed, each weighted down by the
length of its gaps; an insult with signs put in between, or pulled apart, keeps most of them. The machine works on
Nystroem features: kernel values against a few hundred landmark words, whitened. As the kernel is a sum over
subsequences, the trained machine folds into one weight per (hashed) subsequence, and a word is scored by a few
look-ups however many landmarks there are.

Labels exist for documents, insults are words. So it is trained on the sentences of a bounded, documented sample of
labelled documents, in rounds. Witnesses are the words that stand in sentences of toxic documents far too often
for chance, and after the first round the worst word of each toxic document that has none of them. Words of clean
documents are counterexamples, and those that look worst are trained on. A document's score comes from its worst
different words, made a probability on the training documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratusqc.llm.common import byte_slices, text_or_empty
from stratusqc.llm.shingles import stretch_hashes, words

#: Labelled documents the machine is trained on, at most about so many of each kind.
TOXIC_ROWS, CLEAN_ROWS = 1_000, 1_500
LANDMARKS = 256
ROUNDS = 3
COUNTEREXAMPLES = 4_000
#: Disguised forms of each witness that are trained on as well.
VARIANTS = 2
BUCKETS = 1 << 18
#: Signs of a word looked at together; longer words are taken in overlapping stretches.
WIDTH = 24
GAPS = [(a, b) for a in range(1, 5) for b in range(1, 5) if a + b <= 5]
DECAY = 0.6
#: Words of a document that decide, and the least value they count for.
TOPS, FLOOR = 3, -1.0

_MARK = np.ones(256, bool)
_MARK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_PLACES = sum(WIDTH - a - b for a, b in GAPS)
_WEIGHTS = np.concatenate([np.full(WIDTH - a - b, DECAY ** (a + b - 2), np.float32) for a, b in GAPS])
_ENDS = np.concatenate([np.arange(a + b, WIDTH) for a, b in GAPS])


def _stretches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, begin and end of each stretch to be scored, and its text.

    Words without the marks around them, and once more without those within; words of more than ``WIDTH`` bytes in overlapping stretches; and runs of four
    or more single signs as one word more.
    """
    raw, first, last, counts = words(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    for _ in range(4):
        wide = last - first > 1
        first = first + (wide & _MARK[raw[np.minimum(first, max(len(raw) - 1, 0))]]) if len(raw) else first
        wide = last - first > 1
        last = last - (wide & _MARK[raw[last - 1]]) if len(raw) else last
    single = np.concatenate([[0], np.cumsum(last - first == 1)])
    runs = np.flatnonzero((single[4:] - single[:-4] == 4) & (owner[3:] == owner[: len(owner) - 3])) if len(owner) > 3 else []
    if len(runs):
        extra = np.stack([raw[first[runs + k]] for k in range(4)], axis=1)
        # Each run of four goes behind the texts as a word of its own, and longer ones up to eight signs as well.
        parts, begins, ends, owners, at = [raw, extra.ravel()], [], [], [], len(raw)
        begins.append(at + 4 * np.arange(len(runs)))
        ends.append(begins[0] + 4)
        owners.append(owner[runs])
        at += extra.size
        for size in (5, 6, 7, 8):
            longer = runs[(runs + size <= len(owner))]
            longer = longer[(single[longer + size] - single[longer] == size) & (owner[longer + size - 1] == owner[longer])]
            if len(longer):
                parts.append(np.stack([raw[first[longer + k]] for k in range(size)], axis=1).ravel())
                begins.append(at + size * np.arange(len(longer)))
                ends.append(begins[-1] + size)
                owners.append(owner[longer])
                at += size * len(longer)
        raw = np.concatenate(parts)
        first, last, owner = (np.concatenate([x, *y]) for x, y in ((first, begins), (last, ends), (owner, owners)))
    inner = np.concatenate([[0], np.cumsum(_MARK[raw])])
    marked = np.flatnonzero((inner[last] > inner[first]) & (last - first > 3))
    if len(marked):
        # Words with marks within stand once more without them.
        lengths = last[marked] - first[marked]
        at = np.repeat(first[marked] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        plain = ~_MARK[raw[at]]
        left = np.bincount(np.repeat(np.arange(len(marked)), lengths)[plain], minlength=len(marked))
        begin = len(raw) + np.cumsum(left) - left
        raw = np.concatenate([raw, raw[at][plain]])
        first, last, owner = np.concatenate([first, begin[left > 0]]), np.concatenate([last, (begin + left)[left > 0]]), np.concatenate([owner, owner[marked][left > 0]])
    long = np.flatnonzero(last - first > WIDTH)
    if len(long):
        pieces = -(-(last[long] - first[long] - WIDTH) // (WIDTH // 2))
        which = np.repeat(long, pieces)
        step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
        begin = first[which] + step * (WIDTH // 2)
        first, last, owner = np.concatenate([first, begin]), np.concatenate([np.minimum(last, first + WIDTH), np.minimum(begin + WIDTH, last[which])]), np.concatenate([owner, owner[which]])
    return raw, first, last, owner


def _codes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subsequences of each stretch and their weights, scaled so that each stretch has length one."""
    at = first[:, None] + np.arange(WIDTH)
    signs = raw[np.minimum(at, len(raw) - 1)].astype(np.uint32)
    parts = []
    for a, b in GAPS:
        n = WIDTH - a - b
        parts.append(signs[:, :n] | signs[:, a : a + n] << np.uint32(8) | signs[:, a + b : a + b + n] << np.uint32(16))
    codes = ((np.concatenate(parts, axis=1) * np.uint32(2654435761)) >> np.uint32(14)).astype(np.int32)
    weights = np.where(_ENDS < (last - first)[:, None], _WEIGHTS, np.float32(0))
    return codes, weights / np.sqrt(np.maximum((weights**2).sum(axis=1, keepdims=True), 1e-9))


def _values(table: np.ndarray, raw: np.ndarray, first: np.ndarray, last: np.ndarray, step: int = 8192) -> np.ndarray:
    """Sum over the weighted subsequences of each stretch of ``table``, a weight or a row of weights per bucket."""
    out = []
    for k in range(0, len(first), step):
        codes, weights = _codes(raw, first[k : k + step], last[k : k + step])
        out.append(np.einsum("ij,ij->i", table[codes], weights))
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def _tops(values: np.ndarray, word: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The largest values among the different words of each of ``n`` texts, and a column of ones; never below FLOOR."""
    high = values[word] > FLOOR
    pair = np.unique(owner[high] * len(values) + word[high])
    owner, worth = pair // max(len(values), 1), values[pair % max(len(values), 1)]
    order = np.lexsort((-worth, owner))
    owner, worth = owner[order], worth[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    tops = np.full((n, TOPS + 1), FLOOR)
    tops[owner[rank < TOPS], rank[rank < TOPS]] = worth[rank < TOPS]
    tops[:, -1] = 1
    return tops


@dataclass(frozen=True)
class Machine:
    """Weight of each bucket, bias, and what a document's worst words and a constant add to its log odds."""

    weights: np.ndarray
    bias: float
    line: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Different words are scored once."""
        raw, first, last, owner = _stretches(texts)
        _, at, word = np.unique(stretch_hashes(raw, first, last), return_index=True, return_inverse=True)
        tops = _tops(_values(self.weights, raw, first[at], last[at]) + self.bias, word, owner, len(texts))
        return 1 / (1 + np.exp(-(tops @ self.line)))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Squared-hinge support vector machine; the last column of ``x`` is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        margin = 1 - y * (x @ w)
        active = margin > 0
        xa, ca = x[active], weight[active]
        slope = ridge * w - (xa * (ca * y[active] * margin[active])[:, None]).sum(axis=0)
        bend = (xa * ca[:, None]).T @ xa + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _calibrated(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression, with targets drawn in from 0 and 1 so that the weights stay finite."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(bend, x.T @ (p - target) + 1e-3 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _disguised(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word ``VARIANTS`` times with a sign put in somewhere within it."""
    draw = np.random.default_rng(1)
    signs = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789*_", np.uint8)
    words = []
    for _ in range(VARIANTS):
        for s, e in zip(first.tolist(), last.tolist()):
            word = raw[s:e]
            words.append(np.insert(word, draw.integers(1, max(2, len(word))), signs[draw.integers(len(signs))]))
    ends = np.cumsum([len(w) for w in words])
    return np.concatenate(words or [raw[:0]]), ends - [len(w) for w in words], ends


def train(sentences: pa.Array, document: np.ndarray, toxic: np.ndarray) -> Machine:
    """From sentences, the number of each one's document, and the label of each document."""
    raw, first, last, sentence = _stretches(sentences)
    if not len(first) or toxic.all() or not toxic.any():
        odds = np.log((toxic.sum() + 1) / ((~toxic).sum() + 1))
        return Machine(np.zeros(BUCKETS, np.float32), FLOOR, np.append(np.zeros(TOPS), odds))
    owner = document[sentence]
    _, at, word = np.unique(stretch_hashes(raw, first, last), return_index=True, return_inverse=True)
    first, last = first[at], last[at]
    # Copies of a document repeat its sentences; a word counts once for each different sentence it is in.
    same = sentences.dictionary_encode().indices.to_numpy()
    pair, at_pair = np.unique(word * len(same) + same[sentence], return_index=True)
    in_toxic = toxic[owner[at_pair]]
    bad = np.bincount(pair // len(same), weights=in_toxic, minlength=len(at))
    good = np.bincount(pair // len(same), weights=~in_toxic, minlength=len(at))
    lift = np.log((bad + 0.5) / (bad.sum() + 1)) - np.log((good + 0.5) / (good.sum() + 1))
    pair = np.unique(word.astype(np.int64) * len(toxic) + owner)
    word, owner = pair // len(toxic), pair % len(toxic)
    order = np.random.default_rng(0).permutation(len(at))
    spread = order[(good > bad)[order]]
    marks = np.unique(np.concatenate([np.argsort(-bad * lift, kind="stable")[: LANDMARKS // 2], spread[: LANDMARKS // 2]]))

    # Kernel values against the landmarks: only the buckets of the landmarks count.
    codes, weights = _codes(raw, first[marks], last[marks])
    used, column = np.unique(codes[weights > 0], return_inverse=True)
    features = np.zeros((len(used) + 1, len(marks)), np.float32)
    np.add.at(features, (column, np.nonzero(weights > 0)[0]), weights[weights > 0])
    place = np.full(BUCKETS, len(used), np.int32)
    place[used] = np.arange(len(used))

    def kernel(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = [np.zeros((0, len(marks)), np.float32)]
        for k in range(0, len(first), 256):
            c, w = _codes(raw, first[k : k + 256], last[k : k + 256])
            out.append(np.einsum("ijk,ij->ik", features[place[c]], w, optimize=True))
        return np.concatenate(out)

    values, vectors = np.linalg.eigh(kernel(raw, first[marks], last[marks]).astype(np.float64))
    kept = values > 1e-6 * values[-1]
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    look = bad * np.maximum(lift, 0)
    # Words that chance alone would not put into toxic documents that often, however many words there are.
    share, rate = bad.sum() / (bad.sum() + good.sum()), bad / (bad + good)
    odd = bad * np.log(np.maximum(rate, 1e-9) / share) + good * np.log(np.maximum(1 - rate, 1e-9) / (1 - share))
    telling = (rate > max(0.75, (1 + share) / 2)) & (odd > np.log(len(at)) + 3)
    harmless = np.flatnonzero((good > 0) & ~telling)
    for turn in range(ROUNDS):
        best = np.lexsort((look[word], owner))
        best = best[np.append(np.flatnonzero(np.diff(owner[best])), len(best) - 1)]
        times = np.where(telling, bad, 0)
        led = np.zeros(len(toxic), bool)
        led[owner[telling[word]]] = True
        # Documents without such a word are led by their worst one, once the machine says that it is one.
        follows = best[toxic[owner[best]] & ~led[owner[best]] & (look[word[best]] > 0) & (good[word[best]] == 0)]
        if turn or not telling.any():
            np.add.at(times, word[follows], 1)
        witnesses = np.flatnonzero(times)
        times = times[witnesses]
        hard = harmless[np.argsort(-look[harmless], kind="stable")[:COUNTEREXAMPLES]] if turn else spread[:0]
        counter = np.unique(np.concatenate([hard, spread[:COUNTEREXAMPLES]]))
        disguised = _disguised(raw, first[witnesses], last[witnesses])
        chosen = np.concatenate([witnesses, counter])
        x = np.concatenate([kernel(raw, first[chosen], last[chosen]), kernel(*disguised)])
        x = np.concatenate([x @ whiten, np.ones((len(x), 1))], axis=1)
        shown = np.sqrt(times) / np.sqrt(times).sum()
        y = np.concatenate([np.ones(len(witnesses)), -np.ones(len(counter)), np.ones(len(witnesses) * VARIANTS)])
        cost = 1000 * np.concatenate([shown, np.full(len(counter), 1 / len(counter)), np.tile(0.3 * shown / VARIANTS, VARIANTS)])
        w = _newton(x, y, cost, 0.002)
        weight = np.zeros(BUCKETS, np.float32)
        weight[used] = features[:-1] @ (whiten @ w[:-1])
        look = _values(weight, raw, first, last) + w[-1]
    line = _calibrated(_tops(look, word, owner, len(toxic)), toxic)
    return Machine(weight, float(w[-1]), line)


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Trains on the rows of ``labels`` (doc_id, toxic) that ``docs`` has a text for, or a sample of them.

    At most about ``TOXIC_ROWS`` and ``CLEAN_ROWS`` documents are used, chosen by a hash of their ids; nulls are left out.
    """
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("labelled_id"))
    labels = labels.agg((F.max("toxic") == 1).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: int((1 << 20) * min(1.0, most / max(n.get(k, 0), 1))) for k, most in ((True, TOXIC_ROWS), (False, CLEAN_ROWS))}
    limit = F.when(F.col("toxic"), share[True]).otherwise(share[False])
    chosen = labels.filter(F.pmod(F.xxhash64("labelled_id"), F.lit(1 << 20)) < limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # About TOXIC_ROWS + CLEAN_ROWS ids and flags are broadcast.
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    rows = rows.select("doc_id", "toxic", F.split("text", r"(?<=[.!?])\s+|\n").alias("sentences")).toArrow().sort_by("doc_id")
    sentences = rows.column("sentences").combine_chunks()
    counts = np.diff(sentences.offsets.to_numpy())
    flat = sentences.flatten() if len(rows) else pa.array([], pa.string())
    flags = rows.column("toxic").to_numpy().astype(bool) if len(rows) else np.zeros(0, bool)
    return train(flat, np.repeat(np.arange(len(counts)), counts), flags)


def _score(batches: Iterable[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for rows in byte_slices(batches):
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(machine.scores(rows.column("text")))], names=["doc_id", "score"])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1, higher for toxic) of every row of ``docs``.

    Only the text decides. A null text counts as empty; texts without words get the score of nothing found. Null
    and repeated doc_ids are passed on, an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(partial(_score, machine=machine), "doc_id long, score double")
