"""The classifier of ``routing`` without a vocabulary or coefficients in the driver.

MLlib's logistic regression keeps vectors of one number a feature and class in the driver.  Its
steps (L-BFGS from zero) never leave the span of the training rows, so the same steps are taken here
with one number a row and class: a gradient is the rows times the residuals, and all that L-BFGS asks
for are products of such vectors.  The features lie in blocks on the executors; each step is one pass
over them, which several models share.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged

#: Entries of a block of features, and rows whose sums travel together.
_BLOCK = 1 << 18
_ROWS = 1 << 12
#: As in MLlib and Breeze.
_MEMORY, _TOLERANCE, _C1, _C2, _TRIES = 10, 1e-6, 1e-4, 0.9, 10
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _line_search(phi, t: float) -> float:
    """A step that meets the strong Wolfe conditions, as Breeze finds it."""
    f0, d0 = phi(0.0)
    low = (0.0, f0, d0)

    def between(a: tuple, b: tuple) -> float:
        (lt, lf, ld), (rt, rf, rd) = sorted((a, b))
        d1 = ld + rd - 3 * (lf - rf) / (lt - rt)
        d2 = np.sqrt(d1 * d1 - ld * rd)
        at = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
        return min(max(at, lt + 0.1 * (rt - lt)), lt + 0.9 * (rt - lt))

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(_TRIES):
            at = between(low, high)
            c = (at, *phi(at))
            if c[1] > f0 + _C1 * at * d0 or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= _C2 * abs(d0):
                    return at
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise ArithmeticError("the line search found no step")

    for i in range(_TRIES):
        c = (t, *phi(t))
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > f0 + _C1 * t * d0 or (i and c[1] >= low[1]):
            return zoom(low, c)
        if abs(c[2]) <= _C2 * abs(d0):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise ArithmeticError("the line search found no step")


def steps(y: np.ndarray, weight: np.ndarray, classes: int, regularisation: float, rounds: int) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Yields residuals of rows, gets their product with the Gram matrix of the scaled rows; returns
    the class probabilities of all rows.  Rows of weight 0 are not learned from.

    A vector is (coefficients of the gradients so far, intercepts).  The columns of the classes sum up
    to zero, so the last one is not kept.
    """
    total, truth = weight.sum(), np.eye(classes)[y]
    whole = lambda q: np.hstack([q, -q.sum(1, keepdims=True)])
    if (weight @ truth > 0).sum() == 1:
        return np.tile((weight @ truth > 0).astype(float), (len(y), 1))
    grads, products, gram = [], [], np.zeros((rounds, rounds))
    x = np.zeros(rounds + classes)
    times = lambda v: np.concatenate([gram @ v[:rounds], v[rounds:]])
    margins = lambda v: v[rounds:] + whole(sum((c * q for c, q in zip(v, products)), np.zeros((len(y), classes - 1))))

    def residuals(u: np.ndarray) -> tuple[float, np.ndarray]:
        u = u - u.max(1, keepdims=True)
        e = np.exp(u)
        z = e.sum(1, keepdims=True)
        return float(weight @ (np.log(z[:, 0]) - (u * truth).sum(1))) / total, (e / z - truth) * (weight / total)[:, None]

    history, before, failed, k = [], None, False, 0
    u = margins(x)
    while k < rounds:
        value, r = residuals(u)
        value += regularisation / 2 * x[:rounds] @ gram @ x[:rounds]
        if before is None or before[0] is not x:  # not after a failed search
            if len(grads) == rounds:
                break
            product = yield r[:, :-1] - weight[:, None] * (r[:, :-1].sum(0) / total)
            product = product - weight @ product / total
            grads.append(r[:, :-1])
            products.append(product)
            j = len(grads) - 1
            for i, g in enumerate(grads):
                gram[i, j] = gram[j, i] = (g * product).sum() + g.sum(1) @ product.sum(1)
            grad = np.concatenate([regularisation * x[:rounds], r.sum(0)])
            grad[j] += 1
            if before is not None:
                history = [(x - before[0], grad - before[1]), *history][:_MEMORY]
            before = (x, grad)
        if np.sqrt(max(0.0, grad @ times(grad))) <= max(_TOLERANCE * value, 1e-8):
            break
        turn, parts = grad, []
        for s, d in history:
            a = s @ times(turn) / (s @ times(d))
            turn = turn - a * d
            parts.append(a)
        if history:
            s, d = history[0]
            turn = turn * ((s @ times(d)) / (d @ times(d)))
        for (s, d), a in zip(history[::-1], parts[::-1]):
            turn = turn + s * (a - d @ times(turn) / (s @ times(d)))
        turn = -turn
        aside = margins(turn)

        def phi(t: float) -> tuple[float, float]:
            f, r = residuals(u + t * aside)  # noqa: B023
            c = x[:rounds] + t * turn[:rounds]  # noqa: B023
            return f + regularisation / 2 * c @ gram @ c, float((r * aside).sum() + regularisation * c @ gram @ turn[:rounds])  # noqa: B023

        try:
            step = _line_search(phi, 1.0 if k else 1.0 / np.sqrt(turn @ times(turn)))
        except ArithmeticError:
            if failed:
                break
            failed, history = True, []
            continue
        x, u, k = x + step * turn, u + step * aside, k + 1
    e = np.exp(u - u.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _entries(rows: DataFrame, starts) -> DataFrame:
    """(h, g, at, n): a term by both halves of its 128-bit digest, its row's number, its count there."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, digest = starts.value, xxhash.xxh3_128_digest
        for batch in batches:
            for rid, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = [w.encode("utf-8", "surrogatepass") for w in words or ()]
                terms = np.frombuffer(b"".join([digest(t) for t in (*coded, *map(b" ".join, zip(coded, coded[1:])))]), np.int64).reshape(-1, 2)
                if not len(terms):
                    continue
                terms = terms[np.lexsort((terms[:, 1], terms[:, 0]))]
                new = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]).any(1)])
                n = np.diff(np.r_[new, len(terms)])
                at = np.full(len(new), first[rid >> 33] + (rid & ((1 << 33) - 1)), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(terms[new, 0].copy()), pa.array(terms[new, 1].copy()), pa.array(at), pa.array(n.astype(np.int32))], ["h", "g", "at", "n"])

    return rows.select("rid", "_w").mapInArrow(counted, "h long, g long, at int, n int")


def _blocks(entries: DataFrame, weights) -> DataFrame:
    """(at, n, size, scale): features in blocks; scale is one over each model's variance of a feature."""

    def block(h: np.ndarray, g: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        w = weights.value
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        total, learned = w.sum(0), (w > 0).sum(0)
        own = w[at]
        df, s1, s2 = (np.add.reduceat(x, first, 0) for x in ((own > 0).astype(float), own * n[:, None], own * (n.astype(float) ** 2)[:, None]))
        variance = (s2 - s1**2 / total) / (total - (w**2).sum(0) / total)
        # A feature of every row has no weight: its inverse document frequency is 0.
        scale = np.where((df > 0) & (df < learned) & (variance > 0), 1 / np.where(variance > 0, variance, 1), 0)
        size = np.diff(np.r_[first, len(h)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at, n, size, scale)], ["at", "n", "size", "scale"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            many += batch.num_rows
            if many >= _BLOCK:
                cols = [np.concatenate(c) for c in zip(*held)]
                last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
                if len(last):  # the last feature may go on
                    cut = last[-1] + 1
                    yield block(*(c[:cut] for c in cols))
                    cols = [c[cut:] for c in cols]
                held, many = [cols], len(cols[0])
        if many:
            yield block(*(np.concatenate(c) for c in zip(*held)))

    dealt = entries.repartition("h", "g").sortWithinPartitions("h", "g")
    return staged(dealt.mapInArrow(pack, "at binary, n binary, size binary, scale binary"), "features")


def _times(blocks: DataFrame, vectors: np.ndarray, models: list[int]) -> np.ndarray:
    """Rows times (scaled) rows transposed times each column, of the model named; one pass."""
    shared = blocks.sparkSession.sparkContext.broadcast(vectors)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        out, some = np.zeros(v.shape[::-1]), False
        for batch in batches:
            for at, n, size, scale in zip(*(c.to_pylist() for c in batch.columns)):
                at, n, size = (np.frombuffer(x, np.int32) for x in (at, n, size))
                scale = np.frombuffer(scale).reshape(len(size), -1)
                first, some = np.r_[0, np.cumsum(size)[:-1]], True
                for c, k in enumerate(models):
                    w = np.add.reduceat(n * v[at, c], first) * scale[:, k]
                    out[c] += np.bincount(at, n * np.repeat(w, size), len(v))
        if some:
            for i in range(0, len(v), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([out[:, i : i + _ROWS].tobytes()], pa.binary())], ["i", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([sum(np.frombuffer(x) for x in lots).tobytes()], pa.binary())], ["i", "sums"])

    sums = blocks.mapInArrow(part, "i long, sums binary").groupBy("i").agg(F.collect_list("sums").alias("lots")).mapInArrow(added, "i long, sums binary")
    out = np.zeros(vectors.shape)
    for r in sums.collect():
        lot = np.frombuffer(r.sums).reshape(vectors.shape[1], -1)
        out[r.i : r.i + lot.shape[1]] = lot.T
    shared.destroy()
    return out


def fitted(rows: DataFrame, label: str, text: str, models: list[int | None], regularisation: float = 0.01, rounds: int = 15) -> tuple[DataFrame, dict[int, int], np.ndarray, list[tuple[list[str], np.ndarray, np.ndarray]]]:
    """One model for each of ``models``, taught by the rows whose ``fold`` it is not (None: by all),
    each with ``routing.balanced`` weights: the rows with a number ``rid``, the place of each partition's
    first row, folds, and for each model its labels, the classes and the probabilities of all rows.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    kept = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, True)  # each pass shuffles sums; they go with it
    try:
        plain = rows.withColumn(text, F.coalesce(text, F.lit("")))
        words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)[\w']+", gaps=False).transform(plain).drop(text)
        told = staged(words.withColumn("rid", F.monotonically_increasing_id()), "labelled")
        fold = F.col("fold") if "fold" in rows.columns else F.lit(-1)
        few = sorted(told.select("rid", F.col(label).alias("label"), fold.alias("fold")).collect(), key=lambda r: r.rid)
        starts = {}
        for i, r in enumerate(few):
            starts.setdefault(r.rid >> 33, i)
        labels, folds = np.array([r.label for r in few], object), np.array([r.fold for r in few], np.int64)
        known = np.array([x is not None for x in labels], bool)
        taught, weights = [], np.zeros((len(few), len(models)))
        for k, apart in enumerate(models):
            mine = known & (folds != apart if apart is not None else True)
            names, y = sorted(set(labels[mine])), np.full(len(few), -1)
            for c, name in enumerate(names):
                y[known & (labels == name)] = c
                weights[mine & (y == c), k] = mine.sum() / (len(names) * (mine & (y == c)).sum())
            if not names:
                raise ValueError("no labelled rows to learn from")
            taught.append((names, np.where(y < 0, len(names), y)))  # the last class is that of unseen labels
        blocks = _blocks(_entries(told, context.broadcast(starts)), context.broadcast(weights))
        runs = {k: steps(y, weights[:, k], len(names) + 1, regularisation, rounds) for k, (names, y) in enumerate(taught)}
        asked, probs = {}, {}

        def go(k: int, answer: np.ndarray | None) -> None:
            try:
                asked[k] = runs[k].send(answer)
            except StopIteration as end:
                probs[k] = end.value
                asked.pop(k, None)

        for k in runs:
            go(k, None)
        while asked:
            now = dict(asked)
            got = _times(blocks, np.hstack(list(now.values())), [k for k, v in now.items() for _ in range(v.shape[1])])
            for (k, v), i in zip(now.items(), np.cumsum([0, *(v.shape[1] for v in now.values())])):
                go(k, got[:, i : i + v.shape[1]])
        return told, starts, folds, [(names, y, probs[k]) for k, (names, y) in enumerate(taught)]
    finally:
        spark.conf.set(_TIDY, kept)


def probabilities(rows: DataFrame, label: str, text: str) -> DataFrame:
    """``rows`` without the text, with probs: map of label to probability, of a model taught by them all."""
    told, starts, _, [(names, _, probs)] = fitted(rows, label, text, [None])
    shared = rows.sparkSession.sparkContext.broadcast((starts, probs))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, p = shared.value
        for batch in batches:
            rid = batch.column(0).to_numpy()
            at = np.array([first[x] for x in (rid >> 33).tolist()], np.int64) + (rid & ((1 << 33) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p[at, : len(names)].tolist(), pa.list_(pa.float64()))], [*batch.schema.names[1:], "_p"])

    plain = told.select("rid", *(c for c in told.columns if c not in ("rid", "_w")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "rid")
    out = plain.mapInArrow(named, f"{kinds}, _p array<double>")
    return out.withColumn("probs", F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.col("_p"))).drop("_p")


def accuracies(rows: DataFrame, label: str, text: str, folds: int) -> list[tuple[int, int, float]]:
    """(fold, rows, accuracy) of a model for each fold, judged on the rows it has not seen."""
    _, _, own, models = fitted(rows, label, text, list(range(folds)))
    held = [(k, own == k, (p.argmax(1) == y)) for k, (_, y, p) in enumerate(models)]
    return [(k, int(mine.sum()), float(right[mine].mean()) if mine.any() else 0.0) for k, mine, right in held]
