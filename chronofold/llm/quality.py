"""Quality classification by co-training on two views of a document."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.shared import Scratch, chunks, slices, utf8, whole_row

#: Character classes of the metadata view: small or non-ASCII letter, capital, digit, space, line end, common mark, other.
_CLASSES = np.zeros(256, np.int64)
for _c in range(256):
    _s = chr(_c)
    _CLASSES[_c] = 0 if _c >= 128 or "a" <= _s <= "z" else 1 if "A" <= _s <= "Z" else 2 if _s.isdigit() else 3 if _s in " \t\r\v\f" else 4 if _s == "\n" else 5 if _s in ".,;:'\"?-" else 6
N_CLASSES = 7
#: What the content view sees of a byte: small letters, whatever their case; all else is a space.
_LETTERS = np.array([c if c >= 128 or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256)], np.uint8)
#: Columns of the content view beside the trigrams.
REPEATS = 4
#: Columns of the metadata view.
SOURCES, LANGS, SIZES = 16, 8, 20
METADATA = SOURCES + LANGS + SIZES + N_CLASSES + 3
#: Bytes of a text that are counted at a time.
PART = 1 << 20


@dataclass(frozen=True)
class CoTraining:
    """labelled: rows that the driver fits on by itself; where there are more, that fit is where passes over all of them start;
    passes: bound of those passes for each fit;
    dims: buckets of the content view; rounds: exchanges; sure: least probability of a pseudo-label;
    trust: weight of all pseudo-labels, the labels' being 1; keep_good: least share of the calibration
    fold's good documents that must stay.
    """

    labelled: int = 6000
    dims: int = 1024
    rounds: int = 3
    sure: float = 0.9
    trust: float = 0.5
    keep_good: float = 0.995
    steps: int = 300
    passes: int = 8


def content_view(raw: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """Hashed counts of the trigrams of letters, damped by a logarithm, of unit length, and how far the words repeat.

    The last columns: shares of distinct words, lines and pairs of words, and the logarithm of the number
    of words.  Case, digits and marks are not seen.
    """
    n = len(offsets) - 1
    out = np.zeros((n, dims + REPEATS), np.float32)
    for k in range(n):
        counts = np.zeros(dims, np.int64)
        different, total = np.zeros(3), np.zeros(3)
        a, b = int(offsets[k]), int(offsets[k + 1])
        for p in range(a, b, PART):
            letters = _LETTERS[raw[p : min(b, p + PART + 2)]]
            part = letters.astype(np.uint32)
            if len(part) > 2:
                gram = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
                counts += np.bincount(((gram * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(dims), minlength=dims)
            words = letters[:PART].tobytes().split()
            lines = raw[p : min(b, p + PART)].tobytes().split(b"\n")
            different += len(set(words)), len(set(lines)), len(set(zip(words, words[1:], strict=False)))
            total += len(words), len(lines), max(0, len(words) - 1)
        damped = np.log1p(counts)
        size = np.sqrt((damped**2).sum())
        out[k, :dims] = damped / (size or 1)
        out[k, dims:] = [*(4 * different / np.maximum(total, 1)), min(4.0, 0.4 * np.log1p(total[0]))]
    return out


def metadata_view(raw: np.ndarray, offsets: np.ndarray, source: list, lang: list) -> np.ndarray:
    """What is known about a page besides its words: source, language, size and layout; no letter is told from another."""
    n = len(offsets) - 1
    out = np.zeros((n, METADATA), np.float32)
    at = SOURCES + LANGS + SIZES
    for k in range(n):
        part = raw[offsets[k] : offsets[k + 1]]
        size = len(part)
        out[k, zlib.crc32((source[k] or "").encode()) % SOURCES] = 0.3
        out[k, SOURCES + zlib.crc32((lang[k] or "").encode()) % LANGS] = 0.3
        out[k, SOURCES + LANGS + min(SIZES - 1, size.bit_length())] = 1
        if not size:
            continue
        counts = np.bincount(_CLASSES[part], minlength=N_CLASSES)
        out[k, at : at + N_CLASSES] = np.sqrt(counts / size)
        out[k, at + N_CLASSES :] = np.log1p(size / (counts[4] + 1)) / 8, size / (counts[3] + counts[4] + 1) / 16, 1
    return out


def views(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, [content, metadata]) for some rows at a time of columns text, source, lang (the last three)."""
    raw, offsets = utf8(batch.column(batch.num_columns - 3))
    source = batch.column(batch.num_columns - 2).to_pylist()
    lang = batch.column(batch.num_columns - 1).to_pylist()
    for a, b in chunks(offsets, 1 << 20):
        for p in range(a, b, 512):
            q = min(b, p + 512)
            both = content_view(raw, offsets[p : q + 1], dims), metadata_view(raw, offsets[p : q + 1], source[p:q], lang[p:q])
            # Half precision, so that what is fitted on and what is scored are the same numbers.
            yield p, [x.astype(np.float16).astype(np.float32) for x in both]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the intercept, by Nesterov's gradient method on the weighted loss."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    seen = w.copy()
    rate = 4 / max(1e-9, np.einsum("ij,ij->i", x, x).max() * weight.sum())
    for k in range(steps):
        grad = x.T @ (weight * (_sigmoid(x @ seen) - y)) + ridge * np.append(seen[:-1], 0)
        new = seen - rate * grad
        seen = new + k / (k + 3) * (new - w)
        w = new
    return w


def _balanced(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Both classes weigh one half; calibration restores the true share."""
    good, bad = weight[y > 0].sum(), weight[y <= 0].sum()
    return np.where(y > 0, weight / (2 * good or 1), weight / (2 * bad or 1))


@dataclass
class Side:
    """One view's classifier: weights, and the slope and intercept that make its logit a probability's."""

    weights: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0
    loss: float = np.inf  # on the calibration fold

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Row by row, so that a row's is the same to the last bit whatever rows come with it."""
        return self.slope * ((x.astype(np.float64) * self.weights[:-1]).sum(1) + self.weights[-1]) + self.intercept


@dataclass
class Model:
    """Both views' classifiers, the log odds of good among the labels, and the bound to keep."""

    sides: list[Side]
    prior: float
    bound: float

    def score(self, views: list[np.ndarray]) -> np.ndarray:
        """Calibrated views combine as independent evidence: their log odds add up, the prior's counts once."""
        return _sigmoid(sum(s.logit(x) for s, x in zip(self.sides, views, strict=True)) - self.prior)


#: Pseudo-labelled rows as sums: for each view (features and label of each mean, rows that it stands for).
Means = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _side(x: np.ndarray, y: np.ndarray, fold: np.ndarray, means, how: CoTraining) -> Side:
    train = np.flatnonzero(~fold)
    rows, target, weight = x[train], y[train].astype(float), _balanced(y[train], np.ones(len(train)))
    if means is not None and len(set(means[1])) == 2:
        rows, target = np.concatenate([rows, means[0]]), np.concatenate([target, means[1]])
        weight = np.concatenate([weight, how.trust * _balanced(means[1], means[2])])
    side = Side(fit_logistic(rows, target, weight, how.steps))
    return _calibrated(side.weights, side.logit(x[fold]), y[fold], np.ones(fold.sum()))


def _calibrated(weights: np.ndarray, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> Side:
    """The side of these weights, by the logits of the calibration fold's rows; n rows have the same."""
    side = Side(weights)
    scale = max(float(np.sqrt(np.average((z - np.average(z, weights=n)) ** 2, weights=n))), 1e-9)
    w = _platt(z[:, None] / scale, y.astype(float), n)
    # A view that tells nothing, or tells it upside down, says the prior.
    side.slope = max(0.0, w[0] / scale)
    side.intercept = w[1] if w[0] > 0 else _log_odds(y, n)
    p = np.clip(_sigmoid(side.slope * z + side.intercept), 1e-6, 1 - 1e-6)
    side.loss = float(-np.average(np.where(y > 0, np.log(p), np.log(1 - p)), weights=n))
    return side


def _log_odds(y: np.ndarray, n: np.ndarray | int = 1) -> float:
    return float(np.log(((y > 0) * n).sum() + 0.5) - np.log(((y <= 0) * n).sum() + 0.5))


def _exchanged(fit: Callable, exchange: Callable[[list[Side]], Means], how: CoTraining) -> list[Side]:
    """Both sides after the rounds; ``fit`` takes each view's means, at first none, and the sides so far."""
    sides = fit([None, None], None)
    for _ in range(how.rounds):
        new = fit(exchange(sides), sides)
        taken = [n.loss <= s.loss for n, s in zip(new, sides, strict=True)]
        sides = [n if t else s for n, s, t in zip(new, sides, taken, strict=True)]
        if not any(taken):
            break
    return sides


def co_train(views: list[np.ndarray], y: np.ndarray, fold: np.ndarray, exchange: Callable[[list[Side]], Means], how: CoTraining) -> Model:
    """Fit both views on labelled rows; fold marks those kept for calibration.

    In each round ``exchange`` scores all unlabelled rows with both views and gives either view the means
    of those that the other one is sure of.  A view takes them where its loss on the calibration fold does
    not rise; where neither does, the exchange ends.
    """
    if len(set(y)) < 2:
        sure = 30.0 if not len(y) or y[0] > 0 else -30.0
        return Model([Side(np.append(np.zeros(x.shape[1]), sure)) for x in views], sure, 0.5)
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:  # too few to set some aside
        views, y = [np.concatenate([x, x]) for x in views], np.concatenate([y, y])
        fold = np.arange(len(y)) < len(fold)
    sides = _exchanged(lambda means, _: [_side(x, y, fold, m, how) for x, m in zip(views, means, strict=True)], exchange, how)
    model = Model(sides, _log_odds(y), 0.5)
    right = np.sort(model.score([x[fold & (y > 0)] for x in views]))
    model.bound = float(min(0.5, right[int((1 - how.keep_good) * len(right))] - 1e-9))
    return model


def strata(lang: list) -> np.ndarray:
    return np.array([zlib.crc32((x or "").encode()) % LANGS for x in lang], np.int32)


def given_away(views: list[np.ndarray], sides: list[Side], lang: list, how: CoTraining) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(taker, label, stratum, rows) of what either view is sure of, by language so that means stay of a kind."""
    yield from _given_away(views, sides, strata(lang), how)


def _given_away(views: list[np.ndarray], sides: list[Side], stratum: np.ndarray, how: CoTraining) -> Iterator[tuple[int, int, int, np.ndarray]]:
    for giver in (0, 1):
        p = _sigmoid(sides[giver].logit(views[giver]))
        for label, chosen in ((1, p >= how.sure), (0, p <= 1 - how.sure)):
            for k in np.unique(stratum[chosen]).tolist():
                yield 1 - giver, label, k, np.flatnonzero(chosen & (stratum == k))


def _platt(z: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression on a few columns by Newton's method: probabilities, not only an order.  n: rows of each."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(hess, x.T @ (n * (p - y)) + 1e-2 * w)
    return w


#: Logits of the calibration fold are counted in bins of this width, so that all of its rows take part.
BIN = 1 / 1024
RIDGE = 1e-4


def _matrices(batches: Iterator[pa.RecordBatch], edge: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(y, fold, both views) of rows (y, fold, x), whatever the first two are."""
    for batch in slices(batches, 512):
        raw, at = utf8(batch.column(2))
        x = raw[at[0] : at[-1]].view(np.float16).astype(np.float32).reshape(batch.num_rows, -1)
        yield batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), [x[:, :edge], x[:, edge:]]


class Descent:
    """Limited-memory quasi-Newton steps down one view's loss; the curvature of the driver's rows is the first guess."""

    def __init__(self, w: np.ndarray, curvature: np.ndarray):
        self.curvature, self.trial = curvature, w
        self.w = self.loss = self.grad = self.step = None
        self.size, self.seen, self.done = 1.0, [], False

    def told(self, loss: float, grad: np.ndarray) -> None:
        """Loss and gradient at ``trial``, over all rows: take it, or half the step, and set the next ``trial``."""
        if self.w is not None and loss > self.loss + 1e-4 * self.size * float(self.grad @ self.step):
            self.size /= 2
            self.done = self.size < 1e-3
        else:
            if self.w is not None:
                self.done = self.loss - loss <= 1e-4 * self.loss
                s, y = self.trial - self.w, grad - self.grad
                if s @ y > 1e-12 * (y @ y):
                    self.seen.append((s, y))
            self.w, self.loss, self.grad, self.size = self.trial, loss, grad, 1.0
            q, used = grad.copy(), []
            for s, y in reversed(self.seen):
                used.append((s @ q) / (s @ y))
                q -= used[-1] * y
            q = np.linalg.solve(self.curvature, q)
            for (s, y), a in zip(self.seen, reversed(used), strict=True):
                q += (a - (y @ q) / (s @ y)) * s
            self.step = -q
        self.trial = self.w + self.size * self.step


def _ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x.astype(np.float64), np.ones((len(x), 1))])


def co_train_all(rows: DataFrame, views: list[np.ndarray], y: np.ndarray, fold: np.ndarray, exchange: Callable[[list[Side]], Means], how: CoTraining) -> Model:
    """``co_train`` on all of ``rows`` (y, fold, x), of which the driver holds some (views, y, fold).

    The driver's fit is only where the passes start: weights, calibration, the prior and the bound are of
    all rows.  A pass brings back one vector of sums from each task, or counts by bin.
    """
    edge = how.dims + REPEATS
    counts = {(r["fold"], r["good"]): r["n"] for r in rows.groupBy("fold", (F.col("y") > 0).alias("good")).agg(F.count("*").alias("n")).collect()}
    good, bad = (sum(n for k, n in counts.items() if k[1] == g) for g in (True, False))
    if not good or not bad:
        return co_train(views, y, fold, exchange, how)
    apart = len(counts) == 4  # else too few to set some aside
    share = [1 / (2 * sum(n for k, n in counts.items() if k[1] == g and not (apart and k[0]))) for g in (False, True)]

    def losses(tried: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Weighted loss over all rows to fit on, and its gradient, for each view."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(sum(len(w) + 1 for w in tried))
            for target, held, both in _matrices(batches, edge):
                use = np.flatnonzero(~held) if apart else np.arange(len(target))
                g = (target[use] > 0).astype(np.float64)
                weight, at = np.where(g > 0, share[1], share[0]), 0
                for x, w in zip(both, tried, strict=True):
                    x = _ones(x[use])
                    z = x @ w
                    sums[at] += (weight * np.logaddexp(0, np.where(g > 0, -z, z))).sum()
                    sums[at + 1 : at + 1 + len(w)] += x.T @ (weight * (_sigmoid(z) - g))
                    at += len(w) + 1
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        found = rows.select("y", "fold", "x").mapInArrow(run, "sums binary").toArrow()["sums"].to_pylist()
        total = np.sum([np.frombuffer(x) for x in sorted(found)], 0)
        first = len(tried[0]) + 1
        return [(total[0], total[1:first]), (total[first], total[first + 1 :])]

    def binned(logits: Callable) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(logit, label, rows) by bin, over the calibration fold, of each array that ``logits`` gives for the views."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for target, held, both in _matrices(batches, edge):
                use = np.flatnonzero(held) if apart else np.arange(len(target))
                for k, z in enumerate(logits([x[use] for x in both])):
                    cell = np.floor(np.clip(z, -512, 512) / BIN).astype(np.int64)
                    names = [pa.array(np.full(len(use), k), pa.int32()), pa.array(cell), pa.array((target[use] > 0).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(names, names=["k", "cell", "y"])

        found = rows.select("y", "fold", "x").mapInArrow(run, "k int, cell long, y int").groupBy("k", "cell", "y").agg(F.count("*").alias("n")).orderBy("k", "cell", "y").toArrow()
        k, cell, label, n = (found[c].to_numpy() for c in ("k", "cell", "y", "n"))
        return [(cell[k == j] * BIN, label[k == j], n[k == j].astype(np.float64)) for j in range(int(k.max()) + 1)]

    curvature: list[np.ndarray] = []

    def fit(means, sides) -> list[Side]:
        fitted = ~fold if apart else np.ones(len(y), bool)
        target, weight = (y[fitted] > 0).astype(float), _balanced(y[fitted], np.ones(fitted.sum()))
        if sides is None:
            for x in views:
                w = fit_logistic(x[fitted], target, weight, how.steps, RIDGE)
                one = _ones(x[fitted])
                p = _sigmoid(one @ w)
                one *= np.sqrt(weight * p * (1 - p))[:, None]
                curvature.append(one.T @ one + RIDGE * np.eye(len(w)))
                starts.append(w)
        ways = [Descent(w, c) for w, c in zip(starts if sides is None else [s.weights for s in sides], curvature, strict=True)]
        for _ in range(how.passes):
            for way, m, (loss, grad) in zip(ways, means, losses([way.trial for way in ways]), strict=True):
                if way.done:
                    continue
                w = way.trial
                free = np.append(w[:-1], 0)
                loss, grad = loss + RIDGE / 2 * free @ free, grad + RIDGE * free
                if m is not None and len(set(m[1])) == 2:
                    x, own = _ones(m[0]), how.trust * _balanced(m[1], m[2])
                    z = x @ w
                    loss, grad = loss + own @ np.logaddexp(0, np.where(m[1] > 0, -z, z)), grad + x.T @ (own * (_sigmoid(z) - m[1]))
                way.told(loss, grad)
            if all(way.done for way in ways):
                break
        found = [way.w for way in ways]
        both = binned(lambda x: [v.astype(np.float64) @ w[:-1] + w[-1] for v, w in zip(x, found, strict=True)])
        return [_calibrated(w, *b) for w, b in zip(found, both, strict=True)]

    starts: list[np.ndarray] = []
    model = Model(_exchanged(fit, exchange, how), _log_odds(np.array([1, 0]), np.array([good, bad])), 0.5)
    z, label, n = binned(lambda x: [sum(s.logit(v) for s, v in zip(model.sides, x, strict=True)) - model.prior])[0]
    z, n = z[label > 0], n[label > 0]
    # The lower end of the bin, so that no fewer stay.
    at = np.searchsorted(np.cumsum(n), int((1 - how.keep_good) * n.sum()), side="right")
    model.bound = float(min(0.5, _sigmoid(z[at]) - 1e-9))
    return model


def _source(docs: DataFrame, key: str) -> DataFrame:
    """key, text, source and lang; columns that are absent count as null."""
    column = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
    return docs.select(F.col(key), column("text"), column("source"), column("lang"))


#: Sums of features are of whole millionths, so that their order does not matter.
_UNIT = 1_000_000


def _exchange(rows: DataFrame, labelled: DataFrame, sides: list[Side], how: CoTraining) -> Means:
    """Sums, by task and then by Spark, of what the views give away of all unlabelled rows.

    They are those of all rows (key, text, source, lang), read where they are, less those of ``labelled``
    (x, stratum).  Sums are of whole numbers and a row's logit does not depend on its batch, so what is taken
    off is exactly what was added, and no text moves.  A task sends at most one vector for each view, label
    and stratum, so the result does not grow.
    """
    widths = [how.dims + REPEATS, METADATA]

    def everywhere(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        for batch in slices(batches):
            own = strata(batch.column(3).to_pylist())
            for a, both in views(batch, how.dims):
                yield 1, own[a : a + len(both[0])], both

    def taken_off(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        for _, own, both in _matrices(batches, widths[0]):
            yield -1, own, both

    def summed(parts: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for sign, own, both in parts(batches):
                for taker, label, stratum, at in _given_away(both, sides, own, how):
                    x = np.rint(both[taker][at].astype(np.float64) * _UNIT).astype(np.int64)
                    old = sums.get((taker, label, stratum), 0)
                    sums[taker, label, stratum] = old + sign * np.append(x.sum(0), len(at))
            if sums:
                keys = [pa.array(k, pa.int32()) for k in zip(*sums, strict=True)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["taker", "label", "stratum", "v"])

        return run

    by = ["taker", "label", "stratum"]
    kind = "taker int, label int, stratum int, v array<long>"
    found = rows.mapInArrow(summed(everywhere), kind).union(labelled.select(F.lit(0), "stratum", "x").mapInArrow(summed(taken_off), kind))
    found = found.select(*by, F.posexplode("v").alias("d", "x")).groupBy(*by, "d").agg(F.sum("x").alias("x")).orderBy(*by, "d").toArrow()
    taker, label, d, x = (found[c].to_numpy() for c in ("taker", "label", "d", "x"))
    means = []
    for t in (0, 1):
        mine = taker == t
        vectors = x[mine].reshape(-1, widths[t] + 1)
        some = vectors[:, -1] > 0
        rows_ = vectors[some, -1].astype(np.float64)
        means.append((vectors[some, :-1] / rows_[:, None] / _UNIT, label[mine][d[mine] == 0][some].astype(float), rows_))
    return means


#: Bits of the sieve at most: 8 MB.
SIEVE = 1 << 26


def _sieve(given: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test of hashed keys that all keys of ``given`` (_id) pass, and few others; the join decides.

    Eight bits for each key or more, up to ``SIEVE``; with more keys than that others pass more often.
    """
    bits = 64
    most = 8 * given.count()
    while bits < min(most, SIEVE):
        bits *= 2
    h = F.xxhash64("_id")
    words = given.groupBy((F.shiftrightunsigned(h, 6) % (bits // 64)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(_id) & 63 as int))")).alias("set")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["set"].to_numpy()

    def may(h: np.ndarray) -> np.ndarray:
        h = h.view(np.uint64)
        word = table[((h >> np.uint64(6)) % np.uint64(len(table))).astype(np.int64)].view(np.uint64)
        return (word >> (h & np.uint64(63))) & np.uint64(1) == 1

    return may


def _first(fitted: DataFrame, n: int, most: int) -> DataFrame:
    """The ``most`` of n rows whose ids have the least hashes.

    Rows beyond a hash that some twice as many lie below stay out of the sort, which one task ends.
    """
    h = F.xxhash64("id")
    low = fitted.where(h < F.lit(-(1 << 63) + (1 << 64) * 2 * most // n)) if n > 4 * most else fitted
    low = low if n <= 4 * most or low.count() >= most else fitted
    return low.select("id", "y", "x", "fold").orderBy(h, "id").limit(most)


def train(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining(), key: str = "doc_id", label: str = "quality") -> Model:
    """A model of ``docs``: fitted on all its labelled rows, with pseudo-labels of all other rows.

    Labels of a key that differ count as their least, those of other keys not at all.  Up to ``labelled``
    rows are fitted on in the driver; more stay where they are (``co_train_all``).  Each round is one pass
    over ``docs``; what it brings back are a few dozen mean vectors, whatever the number of rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    given = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    source = _source(docs, key)
    kind = given.select("_id").union(source.select(key)).dtypes[0][1]  # of both keys, so that equal ones have equal hashes
    given = scratch.table("labels", given.withColumn("_id", F.col("_id").cast(kind)))
    source = source.withColumn(key, F.col(key).cast(kind))
    may = _sieve(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(may(batch.column(0).to_numpy()))).select([1, 2, 3, 4])
            stratum = strata(batch.column(3).to_pylist())
            for a, both in views(batch, how.dims):
                data = [np.concatenate(x).astype(np.float16).tobytes() for x in zip(*both, strict=True)]
                ids = batch.column(0).slice(a, len(data))
                held = pa.array([in_fold(k) for k in ids.to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(stratum[a : a + len(data)]), pa.array(data, pa.binary())], names=["id", "fold", "stratum", "x"])

    # Texts stay where they are; the views of labelled rows move once, by the same plan at any size.
    seen = source.select(F.xxhash64(key), *source.columns).mapInArrow(run, f"id {kind}, fold boolean, stratum int, x binary")
    fitted = seen.join(given.hint("merge"), F.col("id") == F.col("_id")).select("id", F.col("_y").alias("y"), "fold", "stratum", "x")
    fitted = scratch.table("features", fitted)
    n = fitted.count()
    several = n > how.labelled
    found = (_first(fitted, n, how.labelled) if several else fitted.select("id", "y", "x", "fold")).toArrow()
    found = sorted(zip(*(found[c].to_pylist() for c in ("id", "y", "x", "fold")), strict=True))
    x = np.array([np.frombuffer(r[2], np.float16) for r in found], np.float32).reshape(len(found), how.dims + REPEATS + METADATA)
    y = np.array([r[1] for r in found], int)
    fold = np.array([r[3] for r in found], bool)
    edge = how.dims + REPEATS
    both = [x[:, :edge], x[:, edge:]]
    del found  # thrice the size of x
    exchange = lambda sides: _exchange(source, fitted, sides, how)
    model = co_train_all(fitted, both, y, fold, exchange, how) if several else co_train(both, y, fold, exchange, how)
    scratch.keep()
    return model


def in_fold(key) -> bool:
    """A quarter of the labelled rows is for calibration."""
    return zlib.crc32(f"fold {key}".encode()) % 4 == 0


def score(docs: DataFrame, model: Model, how: CoTraining = CoTraining(), key: str = "doc_id") -> DataFrame:
    """(key, quality_score, keep) for every row.

    Null text counts as empty; null source or lang as blank.  Empty table: no rows.  Repeated rows:
    one each, with equal scores.  With no labels, or labels of one kind only, that kind holds for all
    (good, if there are none).  Very long text: counted in parts of ``PART`` bytes.  Other columns are
    ignored, whatever their names.
    """
    rows = _source(docs, key)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.zeros(batch.num_rows)
            for a, both in views(batch, how.dims):
                found[a : a + len(both[0])] = model.score(both)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(found >= model.bound)], names=[key, "quality_score", "keep"])

    return rows.mapInArrow(run, f"`{key}` {kind}, quality_score double, keep boolean")


def filter_quality(docs: DataFrame, model: Model, how: CoTraining = CoTraining(), key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, unchanged, that the model keeps: scored where they are, without a shuffle."""
    source = _source(docs, key)
    rows = docs.select(whole_row(docs), *[(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(f"_{c}") for c in source.columns[1:]])
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = np.zeros(batch.num_rows, bool)
            for a, both in views(batch, how.dims):
                keep[a : a + len(both[0])] = model.score(both) >= model.bound
            yield pa.RecordBatch.from_arrays(batch.column(0).flatten(), names=columns).filter(pa.array(keep))

    return rows.mapInArrow(run, docs.schema)
