"""Topics by latent Dirichlet allocation over stored counts, the documents of a batch worked on as matrices.

The steps, priors and defaults are those of ``pyspark.ml.clustering.LDA``: online variational steps, each over all
documents (learning offset 1024, decay 0.51, concentrations of 1 / k, that of documents fitted), and EM (concentrations of
50 / k + 1 and 1.1). Tasks hold weights of words by topics and sums of the same size, and read documents in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..sources.stored import stored

#: Fixed values of the online steps: mean change of a document's weights at which it is settled, offset and decay.
SETTLED, OFFSET, DECAY = 1e-3, 1024, 0.51
#: Numbers of a matrix of documents by words by topics, and pairs of a document and a word, that are worked on at a time.
CELLS, PAIRS = 1 << 17, 1 << 16
#: Iterations of EM after which its state is stored.
EVERY = 8


def digamma(x: np.ndarray) -> np.ndarray:
    """For positive numbers: by recurrence to 6 and more, then the asymptotic series."""
    p = x * (x + 5)  # of x to x + 5 in pairs with the same sum
    out = (2 * x + 5) * (1 / p + 1 / (p + 4) + 1 / (p + 6))
    x = x + 6
    y = 1 / (x * x)
    return np.log(x) - out - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(6):
        out += 1 / (x * x)
        x = x + 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


def lgamma(x: np.ndarray) -> np.ndarray:
    product = x.copy()
    for i in range(1, 6):
        product *= x + i
    x = x + 6
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x - np.log(product)


def expected(x: np.ndarray) -> np.ndarray:
    """Expected logarithms under Dirichlet distributions, one a row."""
    both = digamma(np.concatenate([x, x.sum(axis=-1, keepdims=True)], axis=-1))
    return both[..., :-1] - both[..., -1:]


def counts(features: DataFrame) -> DataFrame:
    """doc_id, i and n (numbers of words and their counts) of sparse vectors."""
    own = F.unwrap_udt("features")
    return features.select("doc_id", own["indices"].alias("i"), own["values"].alias("n"))


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of each row, and the word and count of each pair."""
    i, n = batch.column("i"), batch.column("n")
    return i.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), i.flatten().to_numpy(zero_copy_only=False), n.flatten().to_numpy(zero_copy_only=False)


def inferred(lens: np.ndarray, words: np.ndarray, n: np.ndarray, beta: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of topics in each document, the exponents of their expected logarithms, and the norm of each pair.

    beta has a row for each word and a last one of zeros. Documents of like length are worked on together; each is
    iterated until it is settled by itself, so it doesn't matter which these are.
    """
    gamma, norm = np.ones((len(lens), len(alpha))), np.empty(len(words))
    first, order = np.cumsum(lens) - lens, np.argsort(lens, kind="stable")
    groups, lo = [], int(np.searchsorted(lens[order], 1))
    while lo < len(order):
        hi = min(len(order), lo + max(1, CELLS // (len(alpha) * lens[order[lo]])))
        while hi > lo + 1 and (hi - lo) * len(alpha) * lens[order[hi - 1]] > CELLS:
            hi = lo + max(1, CELLS // (len(alpha) * lens[order[hi - 1]]))
        groups.append(order[lo:hi])
        lo = hi
    for own in groups:
        place = np.arange(lens[own[-1]])
        has = place < lens[own][:, None]
        at = np.where(has, first[own][:, None] + place, 0)
        b = np.ascontiguousarray(beta[np.where(has, words[at], len(beta) - 1)].transpose(0, 2, 1))
        gamma[own] = g = _settled(b, np.where(has, n[at], 0.0), alpha)
        norm[at[has]] = ((np.exp(expected(g))[:, None, :] @ b)[:, 0, :] + 1e-100)[has]
    return gamma, np.exp(expected(gamma)), norm


def _settled(b: np.ndarray, c: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The weights at which a further step changes none by more than SETTLED in the mean, for documents of counts c and weights b of their words.

    Steps are small where topics are alike, so after two of them the third is extrapolated, by squares (Varadhan and
    Roland, Simple and globally convergent methods, 2008); one that lowers the document's bound is taken back.
    """
    out, left = np.empty((len(b), len(alpha))), np.arange(len(b))
    g = plain = np.ones((len(b), len(alpha)))
    last, done = np.full(len(b), -np.inf), np.zeros(len(b), dtype=bool)

    def step(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = expected(g)
        t = np.exp(e)
        z = (t[:, None, :] @ b)[:, 0, :] + 1e-100
        return t * (b @ (c / z)[:, :, None])[:, :, 0] + alpha, e, z

    while len(left):
        one, e, z = step(g)
        bound = (c * np.log(z)).sum(axis=1) + ((alpha - g) * e + lgamma(g)).sum(axis=1) - lgamma(g.sum(axis=1))  # but for what alpha alone adds
        back = bound < last
        new = ~done & ~back & (np.abs(one - g).mean(axis=1) <= SETTLED)
        out[left[new]], done = one[new], done | new
        if 2 * done.sum() >= len(left):
            stay = ~done
            left, b, c, g, one, plain, bound, last, back, done = (x[stay] for x in (left, b, c, g, one, plain, bound, last, back, done))
            if not len(left):
                break
        two = step(one)[0]
        x, y, z = np.log(g), np.log(one), np.log(two)
        r, v = y - x, z - 2 * y + x
        a = np.clip(np.sqrt((r * r).sum(axis=1) / np.maximum((v * v).sum(axis=1), 1e-300)), 1, 256)[:, None]
        far = np.clip(x + 2 * a * r + a * a * v, -30, 30)
        g, plain, last = np.where(back[:, None], plain, np.exp(far)), np.where(back[:, None], plain, two), np.where(back, -np.inf, bound)
    return out


@dataclass
class Model:
    """Weights of words in each topic (k by words), concentrations of documents, and that of topics."""

    weights: np.ndarray
    alpha: np.ndarray
    eta: float

    def beta(self) -> np.ndarray:
        return np.vstack([np.exp(expected(self.weights)).T, np.zeros(len(self.alpha))])


def described(weights: np.ndarray, terms: int) -> list[tuple[int, int, int, float]]:
    """topic, rank (from 0), word and share for the words of the greatest weights (k by words), of equal ones the first."""
    share = weights / weights.sum(axis=1, keepdims=True)
    return [(t, r, int(w), float(share[t, w])) for t in range(len(share)) for r, w in enumerate(np.argsort(-share[t], kind="stable")[:terms])]


def _sums(beta: np.ndarray, alpha: np.ndarray):
    """word and s: what a task's documents add to the word's topics; word -1 has expected logarithms, word -2 how many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, logs, docs = np.zeros((len(beta) - 1, len(alpha))), np.zeros(len(alpha)), 0
        for batch in batches:
            lens, words, n = _read(batch)
            gamma, theta, norm = inferred(lens, words, n, beta, alpha)
            _add(total, lens, words, n / norm, theta)
            logs, docs = logs + expected(gamma[lens > 0]).sum(axis=0), docs + int((lens > 0).sum())
        yield from _word_rows(total, {-1: logs, -2: np.full(len(alpha), docs)})

    return run


def _add(total: np.ndarray, lens: np.ndarray, words: np.ndarray, ratio: np.ndarray, theta: np.ndarray) -> None:
    row = np.repeat(np.arange(len(lens)), lens)
    for j in range(theta.shape[1]):
        total[:, j] += np.bincount(words, weights=ratio * theta[row, j], minlength=len(total))


def _word_rows(total: np.ndarray, more: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(total.any(axis=1))
    values = np.concatenate([total[at], *(x[None] for x in more.values())])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * total.shape[1]), pa.array(values.reshape(-1)))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, np.array(list(more), dtype=at.dtype)]).astype(np.int32)), lists], ["word", "s"])


def _summed(made: DataFrame, k: int, size: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Sums of the tasks' rows by word, which are no more than the words, and those of the words below 0."""
    got = made.groupBy("word").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k))).toArrow()
    word, s = got.column("word").to_numpy(), np.stack([got.column(f"s{i}").to_numpy() for i in range(k)], axis=1) if got.num_rows else np.zeros((0, k))
    total = np.zeros((size, k))
    total[word[word >= 0]] = s[word >= 0]
    return total, {int(w): x for w, x in zip(word[word < 0], s[word < 0], strict=True)}


def fit(docs: DataFrame, size: int, k: int, iterations: int, seed: int = 42) -> Model:
    """A model of docs (doc_id, i, n) with words below ``size``, by online steps over all documents."""
    model = Model(np.random.default_rng(seed).gamma(100.0, 0.01, (k, size)), np.full(k, 1 / k), 1 / k)
    for step in range(1, iterations + 1):
        beta, rate = model.beta(), (OFFSET + step) ** -DECAY
        total, more = _summed(docs.select("i", "n").mapInArrow(_sums(beta, model.alpha), "word int, s array<double>"), k, size)
        if not (n := more.get(-2, np.zeros(k))[0]):
            break
        model.weights = (1 - rate) * model.weights + rate * ((total * beta[:-1]).T + model.eta)
        # a Newton step for the concentrations of documents
        gradient = n * (more[-1] / n - expected(model.alpha))
        c, q = n * trigamma(np.array([model.alpha.sum()]))[0], -n * trigamma(model.alpha)
        new = model.alpha - rate * (gradient - (gradient / q).sum() / (1 / c + (1 / q).sum())) / q
        if (new > 0).all():
            model.alpha = new
    return model


def log_perplexity(docs: DataFrame, model: Model) -> float:
    """The negative variational bound of all documents by word."""
    beta, alpha = model.beta(), model.alpha

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = words_n = 0.0
        for batch in batches:
            lens, words, n = _read(batch)
            gamma, _, norm = inferred(lens, words, n, beta, alpha)
            gamma = gamma[lens > 0]
            bound += float((n * np.log(norm)).sum() + ((alpha - gamma) * expected(gamma) + lgamma(gamma) - lgamma(alpha)).sum() + len(gamma) * lgamma(alpha.sum(keepdims=True))[0] - lgamma(gamma.sum(axis=1)).sum())
            words_n += float(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([bound]), pa.array([words_n])], ["bound", "n"])

    bound, n = docs.select("i", "n").mapInArrow(run, "bound double, n double").agg(F.sum("bound"), F.sum("n")).first()
    w, eta = model.weights, np.array([model.eta])
    bound += ((model.eta - w) * expected(w) + lgamma(w) - lgamma(eta)).sum() + (lgamma(eta * w.shape[1]) - lgamma(w.sum(axis=1))).sum()
    return -bound / n


def distributions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and v, the shares of topics; of zeros for documents without words of the model."""
    beta, alpha = model.beta(), model.alpha

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens, words, n = _read(batch)
            gamma = inferred(lens, words, n, beta, alpha)[0]
            v = np.where(lens[:, None] > 0, gamma / gamma.sum(axis=1, keepdims=True), 0.0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(alpha)), pa.array(v.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "v"])

    return docs.select("doc_id", "i", "n").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, v array<double>")


def together(docs: DataFrame, terms: list[int]) -> np.ndarray:
    """In how many documents each two of the given words are, a few: sums of matrix products."""
    place = {w: p for p, w in enumerate(terms)}
    size = max(terms, default=-1) + 1
    known = np.full(size + 1, -1)
    known[list(place)] = list(place.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(terms), len(terms)))
        for batch in batches:
            lens, words, _ = _read(batch)
            row, at = np.repeat(np.arange(len(lens)), lens), known[np.minimum(words, size)]
            held = np.zeros((len(lens), len(terms)))
            held[row[at >= 0], at[at >= 0]] = 1.0
            total += held.T @ held
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])

    out = np.zeros((len(terms), len(terms)), dtype=np.int64)
    for r in docs.select("i", "n").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def coherence(docs: DataFrame, topics: list[tuple[int, int, int, float]]) -> dict[int, float]:
    """By topic (topic, rank, word, ...), of two words or more, what ``topics.umass`` gives."""
    terms = sorted({w for _, _, w, *_ in topics})
    both, at = together(docs, terms), {w: p for p, w in enumerate(terms)}
    ranked = {t: [at[w] for x, _, w, *_ in sorted(topics) if x == t] for t in sorted({t for t, *_ in topics})}
    pairs = {t: [np.log((both[a, b] + 1) / max(1, both[a, a])) for i, a in enumerate(own) for b in own[i + 1 :]] for t, own in ranked.items()}
    return {t: float(np.mean(x)) for t, x in pairs.items() if x}


def _uniform(doc: np.ndarray, word: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Numbers from 0 to 1 for each pair and topic, by a hash, so that they don't depend on how documents are dealt."""
    with np.errstate(over="ignore"):
        key = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, None] + (np.arange(1, k + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            key = (key ^ (key >> np.uint64(shift))) * np.uint64(times)
    return ((key ^ (key >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


#: Documents of a batch with their topics: numbers of pairs, words, counts and the documents' sums by topic as bytes; or, at a task's end, word and s.
_STATE = "lens binary, words binary, counts binary, state binary, word int, s array<double>"


def _state(lens: np.ndarray, words: np.ndarray, n: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array([x.tobytes()], pa.binary()) for x in (lens.astype(np.int32), words.astype(np.int32), n.astype(np.float32), state)]
    return pa.RecordBatch.from_arrays([*cells, pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.float64()))], ["lens", "words", "counts", "state", "word", "s"])


def _ends(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in _word_rows(total, {}):
        yield pa.RecordBatch.from_arrays([*(pa.nulls(batch.num_rows, pa.binary()) for _ in range(4)), *batch.columns], ["lens", "words", "counts", "state", "word", "s"])


def _begun(k: int, size: int, seed: int):
    """Each pair's count is dealt over the topics at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, k))
        for batch in batches:
            doc = batch.column("h").to_numpy(zero_copy_only=False)
            lens, words, n = _read(batch)
            row, state = np.repeat(np.arange(len(lens)), lens), np.zeros((len(lens), k))
            for lo in range(0, len(words), PAIRS):
                own = slice(lo, lo + PAIRS)
                share = _uniform(doc[row[own]], words[own], k, seed)
                share *= (n[own] / share.sum(axis=1))[:, None]
                for j in range(k):
                    total[:, j] += np.bincount(words[own], weights=share[:, j], minlength=size)
                starts = np.flatnonzero(np.concatenate(([True], row[own][1:] != row[own][:-1])))
                state[row[own][starts]] += np.add.reduceat(share, starts, axis=0)
            yield _state(lens, words, n, state)
        yield from _ends(total)

    return run


def _stepped(phi: np.ndarray, alpha: float):
    """Each pair's count is dealt over the topics by what its document and its word had of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, k = np.zeros(phi.shape), phi.shape[1]
        for batch in batches:
            for r in batch.filter(batch.column("word").is_null()).to_pylist():
                lens, words, n = np.frombuffer(r["lens"], np.int32).astype(np.int64), np.frombuffer(r["words"], np.int32), np.frombuffer(r["counts"], np.float32).astype(float)
                theta = np.frombuffer(r["state"]).reshape(-1, k) + (alpha - 1)
                row, ratio, state = np.repeat(np.arange(len(lens)), lens), np.empty(len(words)), np.zeros((len(lens), k))
                for lo in range(0, len(words), PAIRS):
                    own = slice(lo, lo + PAIRS)
                    b = phi[words[own]]
                    ratio[own] = n[own] / np.einsum("ij,ij->i", b, theta[row[own]])
                    b *= ratio[own][:, None]
                    starts = np.flatnonzero(np.concatenate(([True], row[own][1:] != row[own][:-1])))
                    state[row[own][starts]] += np.add.reduceat(b, starts, axis=0)
                _add(total, lens, words, ratio, theta)
                yield _state(lens, words, n, state * theta)
        yield from _ends(total * phi)

    return run


def fit_em(docs: DataFrame, size: int, k: int, iterations: int, seed: int = 42) -> np.ndarray:
    """Sums of the words' counts by topic (k by words), after EM over docs (doc_id, i, n), which reads every document in each iteration.

    Documents keep their sums by topic from one iteration to the next: batches of them lie on the executors' disks,
    the last two iterations' at a time. Every EVERY iterations they are stored, so that lineage stays short.
    """
    alpha, eta = 50 / k + 1, 1.1
    last = docs.select(F.xxhash64("doc_id").alias("h"), "i", "n").mapInArrow(_begun(k, size, seed), _STATE).persist(StorageLevel.DISK_ONLY)
    sums = lambda df: _summed(df.filter("word IS NOT NULL").select("word", "s"), k, size)[0]
    total = sums(last)
    for step in range(1, iterations + 1):
        phi = (total + (eta - 1)) / (total.sum(axis=0) + size * (eta - 1))
        now = last.mapInArrow(_stepped(phi, alpha), _STATE).persist(StorageLevel.DISK_ONLY)
        total = sums(now)
        last.unpersist()
        last = now
        if step % EVERY == 0 and step < iterations:
            last = stored(now.filter("word IS NULL"), "lda-batches")
            now.unpersist()
    last.unpersist()
    return total.T
