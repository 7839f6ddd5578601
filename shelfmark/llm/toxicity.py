"""Toxic spans by a linear-chain conditional random field; documents by its marginals.

Labels mark documents, so token labels are derived first: over the training sample the rate of each
word, word beginning and word ending in the words of a document is summed up, and those that toxic
documents have far more densely are evidence. Tokens of toxic documents that carry strong evidence
are labelled toxic, all others clean, and a two-state chain with weights for each piece of evidence,
for that of the neighbours and for the transitions is trained on them. Forward-backward gives each
token its marginal. A document's score aggregates them: the probability that any token is toxic, the
expected number of toxic tokens and their density go into a logistic regression, whose result is
calibrated. So one doubtful token in a long text weighs less than several in a short one, and texts
without evidence all have the same score, whatever their length.

Tokens without evidence all have the same potentials, so a run of them is one power of the
transition matrix: the marginals are exact and whole texts cost little more than their hits.

Labels are learnt from a sample of at most `train_rows` labelled rows, those with the smallest
hashed ids. Of it all evidence and every token teach: its texts are cut into pieces of
`SEGMENT_WORDS` tokens, equal pieces are one with their number as weight (all those without evidence
are equal), and only the transitions across a cut are left out. Every scored text is read whole, in
time that grows with its tokens and in no pieces.

Edge cases: null and empty texts have no tokens and the score of a text without evidence; null
labels teach nothing, and of several labels for an id the largest counts; of several texts for an id
one is learnt; without labels every score is 0.5, with one class only its value; empty tables give
empty results; repeated rows are scored each; a null id counts as held out; extra columns are carried
if named, but for `score`, `predicted` and `spans`, whose new values win.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontam import words_of
from .quality import calibrated, isotonic, one_of_each, training_sample
from .shared import Shipped, as_bytes, by_value, materialise, small_batches, with_text

by_value()

TRAIN_ROWS = 20_000
#: Evidence: toxic documents that must have it, and the smoothed log odds of its rate.
MIN_TOXIC_DOCS, MIN_LOG_ODDS = 4, 2.0
#: Log odds from which evidence marks the tokens of toxic documents as toxic.
MARK_LOG_ODDS = 3.0
#: Added to a text's words in rates, so that very short texts do not rule them.
RATE_WORDS = 100
#: Rates are summed as whole numbers of this unit: the sums do not depend on their order.
RATE_UNITS = 10**9
SEGMENT_WORDS, STEPS = 24, 150
CALIBRATION_FOLD = 4
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def pieces(word: bytes) -> list[bytes]:
    """A word's evidence: itself, and beginnings and endings of 4 bytes if it is longer."""
    out = [b"w:" + word]
    if len(word) > 4:
        out += [b"p:" + word[:4], b"s:" + word[-4:]]
    if len(word) > 5:
        out.append(b"p:" + word[:5])
    return out


class Chain:
    """Evidence weights and transitions of a trained chain, with its calibration."""

    def __init__(self, constant: float | None = None):
        self.constant = constant
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def evidence(self, word: bytes) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            found = self.seen[word] = tuple(i for p in pieces(word) if (i := self.ids.get(p)) is not None)
        return found

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def marginals(self, words: list[bytes]) -> tuple[list[int], np.ndarray]:
        """Positions that carry evidence, or stand beside it, and their probabilities of being toxic."""
        seen, evidence = self.seen, self.evidence
        hits = {}
        for i, w in enumerate(words):
            found = seen.get(w)
            if found is None:
                found = evidence(w)
            if found:
                hits[i] = found
        if not hits:
            return [], np.zeros(0)
        spots = sorted({j for i in hits for j in (i - 1, i, i + 1) if 0 <= j < len(words)})
        emit = []
        for i in spots:
            e = self.bias + sum(self.weights[f] for f in hits.get(i, ()))
            emit.append(e + self.left * ((i - 1) in hits) + self.right * ((i + 1) in hits))
        return spots, chain_marginals(np.array(emit), spots, len(words), self.bias, self.moves)

    def aggregates(self, words: list[bytes], p: np.ndarray) -> list[float]:
        """What the marginals of a document's tokens say together; see `AGGREGATES`."""
        any_toxic = float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0
        expected = float(p.sum())
        density = RATE_WORDS * expected / (len(words) + RATE_WORDS)
        return [any_toxic, float(np.log1p(expected)), float(np.log1p(density))]

    def raw(self, aggregates: np.ndarray) -> np.ndarray:
        z = ((aggregates - self.mean) / self.scale) @ self.logistic[1:] + self.logistic[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def judge(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[tuple[list[int], np.ndarray]]]:
        """The score of each text, and the marginals that it comes from: positions and probabilities."""
        if self.constant is not None or not texts:
            none = ([], np.zeros(0))
            return np.full(len(texts), self.constant if self.constant is not None else 0.5), [none] * len(texts)
        rows, told = [], []
        for text in texts:
            words = words_of(text)
            spots, p = self.marginals(words)
            told.append((spots, p))
            rows.append(self.aggregates(words, p))
        return calibrated(self.raw(np.array(rows)), self.knots, self.values), told

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return self.judge(texts)[0]


def spans(text: str, spots: list[int], p: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int, float]]:
    """start, end (code points, exclusive) and probability of each token of `threshold` or more."""
    toxic = {i: float(x) for i, x in zip(spots, p, strict=True) if x >= threshold}
    if not toxic:
        return []
    return [(m.start(), m.end(), toxic[i]) for i, m in enumerate(WORD.finditer(text.translate(_LOWER))) if i in toxic]


_LOWER = {c: c + 32 for c in range(65, 91)}
#: Of a document: P(any token toxic), log1p of the expected toxic tokens, log1p of their density.
AGGREGATES = 3


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and weights of a ridge-penalized logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + w @ penalty @ w / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        size = 1.0
        while loss(w + size * move) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * move
        if np.abs(size * move).max() < 1e-9:
            break
    return w


def _power(base: np.ndarray, n: int) -> np.ndarray:
    """base to the n-th, scaled to sum 1, for n >= 0."""
    out = np.eye(2)
    while n:
        if n & 1:
            out = out @ base
            out /= out.sum()
        base = base @ base
        base /= base.sum()
        n >>= 1
    return out


def chain_marginals(emit: np.ndarray, spots: list[int], length: int, bias: float, moves: np.ndarray) -> np.ndarray:
    """P(state 1) at `spots`; all other tokens have the potential `bias`. moves: log transitions, 2 x 2."""
    step = np.exp(moves - moves.max())
    quiet = step * np.exp(np.array([0.0, bias]) - max(0.0, bias))  # a move to a token without evidence
    into = [np.exp(np.array([0.0, e]) - max(0.0, e)) for e in emit]
    gaps = [spots[0]] + [b - a - 1 for a, b in zip(spots, spots[1:], strict=False)] + [length - 1 - spots[-1]]
    start = np.exp(np.array([0.0, bias]) - max(0.0, bias))
    forward = []
    for i, gap in enumerate(gaps[:-1]):
        if i:
            at = (forward[-1] @ _power(quiet, gap)) @ step * into[i]
        else:
            at = (start @ _power(quiet, gap - 1)) @ step * into[0] if gap else into[0].copy()
        forward.append(at / at.sum())
    out = np.zeros(len(spots))
    back = _power(quiet, gaps[-1]) @ np.ones(2)
    for i in range(len(spots) - 1, -1, -1):
        both = forward[i] * back
        out[i] = both[1] / both.sum()
        if i:
            back = _power(quiet, gaps[i]) @ (step @ (into[i] * back))
            back = back / back.sum()
    return out


def _count_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, list[int]] = {}
    for batch in batches:
        for text, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            mine: Counter = Counter()
            for w, n in Counter(words).items():
                for p in pieces(w):
                    mine[p] += n
            for p, n in mine.items():
                rate = n * RATE_UNITS // (len(words) + RATE_WORDS)
                sums = counts.setdefault(p, [0, 0, 0])
                sums[0] += y == 1
                sums[1 if y == 1 else 2] += rate
        if len(counts) > 200_000:
            yield _count_batch(counts)
            counts = {}
    yield _count_batch(counts)


def _count_batch(counts: dict[bytes, list[int]]) -> pa.RecordBatch:
    sums = list(zip(*counts.values(), strict=True)) if counts else [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.binary())] + [pa.array(c, pa.int64()) for c in sums],
        names=["piece", "docs", "toxic", "clean"],
    )


def _train(chain: Chain, segments: list[tuple[list, list[int], int]], strength: np.ndarray) -> None:
    """Adam on the penalized log-likelihood of weighted segments, all of SEGMENT_WORDS tokens at most."""
    n, t = len(segments), SEGMENT_WORDS
    mask, y = np.zeros((n, t), bool), np.zeros((n, t), int)
    weight = np.array([w for _, _, w in segments], float)[:, None]
    rows, feats = [], []
    hit = np.zeros((n, t + 2))
    for s, (tokens, marks, _) in enumerate(segments):
        mask[s, : len(tokens)] = True
        y[s, : len(tokens)] = marks
        for i, found in enumerate(tokens):
            if found:
                hit[s, i + 1] = 1
            rows += [s * t + i] * len(found)
            feats += found
    rows, feats = np.array(rows, int), np.array(feats, int)
    left, right = hit[:, :-2], hit[:, 2:]
    f = len(strength)
    params = np.concatenate([0.5 * strength, [-3.0, 0.0, 0.0], [0.0, -1.0, 0.0]])  # weights, bias, left, right; 01, 10, 11
    first, second = np.zeros_like(params), np.zeros_like(params)
    pair = mask[:, 1:]
    for turn in range(1, STEPS + 1):
        emit = np.bincount(rows, params[feats], n * t).reshape(n, t) + params[f] + params[f + 1] * left + params[f + 2] * right
        moves = np.array([[0.0, params[f + 3]], [params[f + 4], params[f + 5]]])
        step = np.exp(moves)
        e = np.where(mask, np.exp(np.clip(emit, -30, 30)), 1.0)
        into = np.stack([np.ones((n, t)), e], axis=2)
        alpha, scale = np.zeros((n, t, 2)), np.ones((n, t))
        alpha[:, 0] = into[:, 0]
        for i in range(t):
            if i:
                alpha[:, i] = np.where(mask[:, i, None], (alpha[:, i - 1] @ step) * into[:, i], alpha[:, i - 1])
            scale[:, i] = alpha[:, i].sum(axis=1)
            alpha[:, i] /= scale[:, i, None]
        beta = np.ones((n, t, 2))
        for i in range(t - 2, -1, -1):
            b = (into[:, i + 1] * beta[:, i + 1]) @ step.T
            beta[:, i] = np.where(mask[:, i + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        error = np.where(mask, y - post[:, :, 1], 0.0) * weight
        joint = alpha[:, :-1, :, None] * step * (into[:, 1:] * beta[:, 1:])[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        grad = np.concatenate(
            [
                np.bincount(feats, error.ravel()[rows], f),
                [error.sum(), (error * left).sum(), (error * right).sum()],
                [
                    ((((y[:, :-1] == a) & (y[:, 1:] == b)) - joint[:, :, a, b]) * pair * weight).sum()
                    for a, b in ((0, 1), (1, 0), (1, 1))
                ],
            ]
        )
        grad -= 0.05 * (params - np.concatenate([0.5 * strength, np.zeros(6)]))
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        params = params + 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    chain.weights = params[:f].tolist()
    chain.bias, chain.left, chain.right = (float(x) for x in params[f : f + 3])
    chain.moves = np.array([[0.0, params[f + 3]], [params[f + 4], params[f + 5]]])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Chain:
    small_batches(docs.sparkSession)
    sample = materialise(one_of_each(training_sample(docs, labels, label, train_rows), "text"), "toxic-sample")
    classes = {(r["y"] == 1): r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return Chain(float(next(iter(classes))) if classes else 0.5)
    toxic_docs, clean_docs = classes[True], classes[False]
    learn = sample.filter(F.col("fold") != CALIBRATION_FOLD)
    half = RATE_UNITS / (4 * RATE_WORDS)  # smoothing: half an occurrence in a text of RATE_WORDS words
    log_odds = F.log((F.col("toxic") + half) / F.lit(float(toxic_docs))) - F.log((F.col("clean") + half) / F.lit(float(clean_docs)))
    known = (
        learn.select("text", "y")
        .mapInArrow(_count_evidence, "piece binary, docs bigint, toxic bigint, clean bigint")
        .groupBy("piece")
        .agg(*[F.sum(c).alias(c) for c in ("docs", "toxic", "clean")])
        .filter(F.col("docs") >= MIN_TOXIC_DOCS)
        .withColumn("strength", log_odds)
        .filter(F.col("strength") >= MIN_LOG_ODDS)
        .select("piece", "strength")
        .collect()  # of the bounded sample
    )
    known.sort(key=lambda r: bytes(r["piece"]))
    chain = Chain()
    chain.ids = {bytes(r["piece"]): i for i, r in enumerate(known)}
    strength = np.array([r["strength"] for r in known])
    shared = Shipped(docs.sparkSession, (chain, strength))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, strong = shared.value
        for batch in batches:
            found, marks = [], []
            for text, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                tokens = [own.evidence(w) for w in words_of(text)]
                for at in range(0, len(tokens), SEGMENT_WORDS):
                    part = tokens[at : at + SEGMENT_WORDS]
                    found.append([list(t) for t in part])
                    marks.append([int(y == 1 and any(strong[f] >= MARK_LOG_ODDS for f in t)) for t in part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.list_(pa.int32()))), pa.array(marks, pa.list_(pa.int32()))], names=["found", "marks"]
            )

    segments = learn.select("text", "y").mapInArrow(cut, "found array<array<int>>, marks array<int>")
    # Equal segments are added up before they move; the driver gets those of the bounded sample.
    kinds = segments.groupBy("found", "marks").agg(F.count("*").alias("n")).toArrow()
    chosen = sorted(zip(*(kinds.column(c).to_pylist() for c in ("found", "marks", "n")), strict=True))
    if not chosen:
        return Chain(toxic_docs / (toxic_docs + clean_docs))
    _train(chain, chosen, strength)
    shared = Shipped(docs.sparkSession, chain)

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.aggregates(w, own.marginals(w)[1]) for w in map(words_of, as_bytes(batch.column(0)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "fold"]
            )

    # A few numbers for each row of the bounded sample.
    told = sample.select("text", "y", "fold").mapInArrow(aggregate, "x array<double>, y int, fold int").toArrow()
    x = told.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, AGGREGATES)
    y, held = told.column("y").to_numpy() == 1, told.column("fold").to_numpy() == CALIBRATION_FOLD
    order = np.lexsort((*x.T, y))  # sums in one order, whatever the partitions
    x, y, held = x[order], y[order].astype(float), held[order]
    chain.mean, chain.scale = x[~held].mean(axis=0), np.maximum(x[~held].std(axis=0), 1e-6)
    chain.logistic = logistic_fit((x[~held] - chain.mean) / chain.scale, y[~held])
    chain.knots = chain.values = np.zeros(0)
    if held.any():
        chain.knots, chain.values = isotonic(chain.raw(x[held]), y[held])
    return chain


def score_documents(docs: DataFrame, chain: Chain, carry: list[str], threshold: float = 0.5) -> DataFrame:
    """The `carry` columns with score, predicted and spans: array<struct<start, end, p>> of toxic tokens.

    Only documents whose score reaches `threshold` have spans; in others tokens with a marginal of
    0.5 or more are not listed.
    """
    small_batches(docs.sparkSession)
    own = "score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
    kept = [c for c in carry if c.lower() not in ("score", "predicted", "spans")]
    schema = docs.select(*kept).schema
    for field in docs.sparkSession.createDataFrame([], own).schema:
        schema = schema.add(field)
    shared = Shipped(docs.sparkSession, chain)
    rows, place = with_text(docs, kept, "text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = as_bytes(batch.column(place))
            scores, told = model.judge(texts)
            found = [
                [{"start": s, "end": e, "p": p} for s, e, p in spans(t.decode(), *at)] if t and x >= threshold else []
                for t, x, at in zip(texts, scores, told, strict=True)
            ]
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [
                pa.array(scores, pa.float64()),
                pa.array((scores >= threshold).astype(np.int32), pa.int32()),
                pa.array(found, span),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
