"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are its own characters (shares of
letters, capitals, digits, symbols, spaces, its length and ending, whether it
repeats) and those of the lines before and after it; the chain adds weights
for staying or changing.  A document's quality is the length-weighted mean of
its lines' forward-backward marginals, calibrated to the document labels.

Lines are not labelled, documents are: lines of good documents are good; those
of bad ones start bad and are relabelled by the fitted model a few times (each
bad document keeps its worst line).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, remainder

#: Labelled documents in the sample that is fitted to, as expected by hash, for each label; their characters at most.
PER_LABEL, LEARNED = 1500, 50_000
ROUNDS, STEPS, DECAY = 3, 120, 1e-4
THRESHOLD = 0.3
#: Characters whose features are computed together.
CHARS = 4_000_000

_kinds: np.ndarray | None = None
_MARKS = "!|*#%$&.,?:;-_=<>/\\"


def kinds() -> np.ndarray:
    """Class of each code point: 0 other, 1 small letter, 2 capital, 3 digit, 4 space, 5... each of _MARKS."""
    global _kinds
    if _kinds is None:
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = 2 if c.isupper() else 1
            elif c.isdigit():
                table[i] = 3
            elif c.isspace():
                table[i] = 4
        for k, c in enumerate(_MARKS):
            table[ord(c)] = 5 + k
        _kinds = table
    return _kinds


N_OWN = 13 + len(_MARKS)


def own_features(lines: list[str], repeated: np.ndarray) -> np.ndarray:
    """One row a line, without neighbours."""
    size = np.array([len(x) for x in lines])
    out = np.zeros((len(lines), N_OWN), np.float32)
    at = 0
    while at < len(lines):  # bounded pieces; a longer line is one by itself
        end = at + max(1, int(np.searchsorted(np.cumsum(size[at:] + 1), CHARS)))
        code = np.frombuffer(("\n".join(lines[at:end]) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        kind = kinds()[code]
        width = size[at:end] + 1
        starts = np.concatenate([[0], np.cumsum(width)[:-1]])
        n_kinds = 5 + len(_MARKS)
        line = np.repeat(np.arange(end - at, dtype=np.int64), width)
        count = np.bincount(line * n_kinds + kind, minlength=(end - at) * n_kinds).reshape(end - at, n_kinds).astype(np.float32)
        count[:, 4] -= 1  # the line end
        n = np.maximum(size[at:end], 1).astype(np.float32)
        words = count[:, 4] + 1
        letters = np.maximum(count[:, 1] + count[:, 2], 1)
        last = kind[np.maximum(starts + width - 2, 0)]
        first = kind[starts]
        share = count / n[:, None]
        blank = kind == 4
        begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        again = np.zeros(end - at, np.float32)
        if len(begins):  # words equal to the one before, told by a sum over their characters
            sums = np.add.reduceat(np.where(blank, 0, code.astype(np.int64) ** 2 + 7 * code), begins)
            of = line[begins]
            hit = (sums[1:] == sums[:-1]) & (of[1:] == of[:-1])
            again = np.bincount(of[1:][hit], minlength=end - at).astype(np.float32) / words
        out[at:end] = np.column_stack([
            np.log1p(n), np.log1p(words), n / words / 10, share[:, 0], share[:, 1], count[:, 2] / letters, share[:, 3], share[:, 4],
            (size[at:end] == 0), (first == 2), np.isin(last, [5 + _MARKS.index(c) for c in ".!?"]), repeated[at:end], again, share[:, 5:],
        ])
        at = end
    return out


def chained(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features beside those of the line before and after in the document (0 at the ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = doc[1:] == doc[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.hstack([own, before, after])


def lines_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All lines, the document of each, and whether it occurred before in it."""
    lines: list[str] = []
    repeated: list[bool] = []
    doc: list[int] = []
    for i, t in enumerate(texts):
        if t:
            own = t.split("\n")
            seen: set[str] = set()
            for x in own:
                repeated.append(x in seen)
                seen.add(x)
            lines += own
            doc += [i] * len(own)
    return lines, np.array(doc, np.int64), np.array(repeated, bool)


def _grid(doc: np.ndarray) -> list[np.ndarray]:
    """Indexes of first lines, second lines ... of all documents, longest documents first."""
    if not len(doc):
        return []
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    width = np.diff(np.concatenate([starts, [len(doc)]]))
    order = np.argsort(-width, kind="stable")
    starts, width = starts[order], width[order]
    ends = np.searchsorted(-width, -np.arange(width[0]), side="left")  # documents with more than t lines
    return [starts[: ends[t]] + t for t in range(width[0])]


def forward_backward(score: np.ndarray, trans: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of bad over good from the left (with the line) and from the right (without it)."""
    grid = _grid(doc)
    left, right = np.zeros(len(score)), np.zeros(len(score))
    mix = lambda a0, a1, b0, b1, r: np.logaddexp(b0, b1 + r) - np.logaddexp(a0, a1 + r)
    for t, now in enumerate(grid):
        if t:
            past = left[grid[t - 1][: len(now)]]
            left[now] = score[now] + mix(trans[0, 0], trans[1, 0], trans[0, 1], trans[1, 1], past)
        else:
            left[now] = score[now]
    for t in range(len(grid) - 2, -1, -1):
        after = grid[t + 1]
        right[grid[t][: len(after)]] = mix(trans[0, 0], trans[0, 1], trans[1, 0], trans[1, 1], right[after] + score[after])
    return left, right


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(np.asarray(x) / 2))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    calibration: tuple[float, float]
    base: float

    def bad(self, own: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Marginal of bad for each line."""
        if not len(doc):
            return np.zeros(0)
        score = chained((own - self.mean) / self.scale, doc) @ self.weights + self.bias
        left, right = forward_backward(score, self.trans, doc)
        return _sigmoid(left + right)

    def quality(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Raw mean of good, and the calibrated score, of each text."""
        lines, doc, repeated = lines_of(texts)
        raw = weighted(self.bad(own_features(lines, repeated), doc), lines, doc, len(texts))
        a, b = self.calibration
        empty = np.isnan(raw)
        score = _sigmoid(a * _logit(np.where(empty, 0.5, raw)) + b)
        return raw, np.where(empty, self.base, score)


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def weighted(bad: np.ndarray, lines: list[str], doc: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of good in each document; nan without a character."""
    size = np.array([len(x) for x in lines], float)
    total = np.bincount(doc, size, minlength=n)
    return np.where(total > 0, np.bincount(doc, size * (1 - bad), minlength=n) / np.maximum(total, 1), np.nan)


def train(texts: list[str], labels: list[int]) -> Model | None:
    """Fit the field and the calibration; None without documents of both labels."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    lines, doc, repeated = lines_of(texts)
    own = own_features(lines, repeated)
    mean, scale = own.mean(0), np.maximum(own.std(0), 1e-3)
    x = chained((own - mean) / scale, doc).astype(np.float64)
    is_bad_doc = (y == 0)[doc]
    target = is_bad_doc.astype(float)
    weights, bias, trans = np.zeros(x.shape[1]), 0.0, np.zeros((2, 2))
    same = np.flatnonzero(doc[1:] == doc[:-1])
    # documents of either label weigh the same in all
    weight = np.where(y == 0, len(y) / (2 * (y == 0).sum()), len(y) / (2 * (y == 1).sum()))[doc]
    weight = weight / weight.sum()
    theta = np.zeros(x.shape[1] + 5)
    for _ in range(ROUNDS):
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            weights, bias, trans = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
            score = x @ weights + bias
            left, right = forward_backward(score, trans, doc)
            p = _sigmoid(left + right)
            error = weight * (p - target)
            # marginals of neighbours: left part of one, right part of the next
            a, c = left[same], score[same + 1] + right[same + 1]
            joint = np.stack([np.zeros_like(a) + trans[0, 0], c + trans[0, 1], a + trans[1, 0], a + c + trans[1, 1]])
            joint = np.exp(joint - joint.max(0))
            joint /= joint.sum(0)
            t0, t1 = target[same], target[same + 1]
            real = np.stack([(1 - t0) * (1 - t1), (1 - t0) * t1, t0 * (1 - t1), t0 * t1])
            grad = np.concatenate([x.T @ error + DECAY * weights, [error.sum()], ((joint - real) * weight[same]).sum(1)])
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
            theta = theta - 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        # relabel the lines of bad documents; the worst line of each stays bad
        target = (is_bad_doc & (p > 0.5)).astype(float)
        worst = np.lexsort((-p, doc))
        first = worst[np.concatenate([[True], doc[worst][1:] != doc[worst][:-1]])]
        target[first[is_bad_doc[first]]] = 1.0
    weights, bias, trans = theta[:-5].copy(), float(theta[-5]), theta[-4:].reshape(2, 2).copy()
    base = float(y.mean())
    model = Model(mean, scale, weights, bias, trans, (1.0, 0.0), base)
    raw = weighted(model.bad(own, doc), lines, doc, len(texts))
    z, use = _logit(np.where(np.isnan(raw), 0.5, raw)), ~np.isnan(raw)
    return Model(mean, scale, weights, bias, trans, _platt(z[use], y[use]), base)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration y ~ a z + b by Newton steps."""
    ab, design = np.array([1.0, 0.0]), np.column_stack([z, np.ones_like(z)])
    for _ in range(50):
        p = _sigmoid(design @ ab)
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (p - y) + 1e-3 * (ab - [1.0, 0.0]))
        ab = ab - np.clip(step, -2, 2)
    return float(max(ab[0], 0.0)), float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """A model from documents (doc_id, text) with labels (doc_id, quality).

    A sample of about per_label documents of each label, spread by hash and
    none longer than LEARNED, comes to the driver (every document is scored
    whole).  Null and other labels than 0 and 1 do not count, of several labels
    of a document the higher does, null texts are left out; without documents of
    both labels there is no model.  The documents' share of each label in all labels is kept by
    the calibration's base, which weighs the sample back.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for q, n in counts.items():
        share = F.when(F.col("quality") == q, min(1.0, per_label / n)).otherwise(share)
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003 < share)
    some = F.broadcast(some.limit(4 * per_label))  # bounded by the parameter: no text is shuffled for it
    rows = docs.select("doc_id", "text").join(some, "doc_id").where(F.length("text") <= LEARNED).select("doc_id", "text", "quality").limit(4 * per_label).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    model = train([r.text for r in rows], [int(r.quality) for r in rows])
    if model is None:
        return None
    # odds of the sample back to the odds of all labels
    in_sample = sum(r.quality for r in rows) / len(rows)
    in_all = counts.get(1, 0) / sum(counts.values())
    shift = float(_logit(np.array(in_all)) - _logit(np.array(in_sample)))
    a, b = model.calibration
    return Model(model.mean, model.scale, model.weights, model.bias, model.trans, (a, b + shift), in_all)


def score(docs: DataFrame, model: Model | None, base: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of each row of docs(doc_id, text, ...).

    Null and empty texts get the share of good labels (without a model every
    text gets base); repeated rows are scored alike; other columns are ignored;
    an empty table gives an empty result; whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(got, _):
        model = shared.value
        s = []
        for at in range(0, len(got["text"]), 256):
            part = got["text"][at : at + 256]
            s += [base] * len(part) if model is None else model.quality(part)[1].tolist()
        return {"doc_id": got["doc_id"], "score": s, "predicted": [int(x >= THRESHOLD) for x in s]}

    return by_batch(docs.select("doc_id", "text"), each, "doc_id bigint, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where(remainder(F.col("doc_id"), 5) != 0)
    got = score(docs, fit(docs, learn))
    return got.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


SQL = None
