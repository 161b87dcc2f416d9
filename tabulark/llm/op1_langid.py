"""Language identification by string kernels.

A text is the set of its character n-grams of several lengths (blended
spectrum, presence), hashed to 2**BITS places.  The kernel of two texts is the
number of shared n-grams over the root of the product of their counts.  A
bounded sample of labelled texts gives landmarks and a training set; kernels
with the landmarks are mapped by the inverse root of the landmarks' own kernel
matrix (Nystroem), one-versus-rest ridge regression learns the languages, and
texts are scored by products of batch, landmark and weight matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, remainder, slices

BITS, LENGTHS = 15, (1, 2, 3, 4)
#: Labelled texts of a language and of all together that are sampled at most (as expected by hash; of each language one at
#: least), landmarks, ridge.
PER_LANGUAGE, TRAINED, LANDMARKS, RIDGE = 600, 24_000, 128, 1e-3
#: Texts of a matrix product.
BATCH = 64
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def presence(text: str, flags: np.ndarray) -> bool:
    """Set the flags of the text's n-grams; False if it has no letter.

    Letters count in lower case, all else as a space.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[code]
    if not is_letter.any():
        return False
    code = np.concatenate([[32], np.where(is_letter, code, 32), [32]]).astype(np.uint32)
    mixed = np.zeros(len(code), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(code) < n:
            break
        mixed = (mixed[: len(code) - n + 1] + code[n - 1 :]) * np.uint32(2654435761)
        mixed ^= mixed >> np.uint32(15)
        if n in LENGTHS:
            flags[(mixed * np.uint32(2246822519 + 2 * n)) >> np.uint32(32 - BITS)] = 1
    return True


@dataclass(frozen=True)
class Model:
    """Landmarks as packed bits, the weights of their kernels, the languages."""

    landmarks: np.ndarray
    weights: np.ndarray
    languages: tuple[str, ...]

    def unpacked(self) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return bits, 1 / np.sqrt(np.maximum(bits.sum(1), 1))


def sampled(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list:
    """(lang, packed n-gram flags) of a sample spread by hash over each language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counted.count()
    if not languages:
        return []
    per_language = max(1, min(per_language, TRAINED // languages))
    share = counted.select("lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")).alias("share"))
    some = labelled.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003 < F.col("share")).select("lang", "text")

    def each(got, _):
        out = {"lang": [], "bits": []}
        for lang, text in zip(got["lang"], got["text"]):
            flags = np.zeros(1 << BITS, np.uint8)
            if presence(text, flags):
                out["lang"].append(lang)
                out["bits"].append(np.packbits(flags).tobytes())
        return out

    return by_batch(some, each, "lang string, bits binary").limit(2 * per_language * languages).collect()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from rows with text and lang; None without any.

    The sample is bounded: about per_language texts of each language.
    """
    rows = sorted(sampled(docs, per_language), key=lambda r: (r.lang, bytes(r.bits)))
    if not rows:
        return None
    languages = tuple(sorted({r.lang for r in rows}))
    packed = np.array([np.frombuffer(bytes(r.bits), np.uint8) for r in rows])
    lang = np.array([languages.index(r.lang) for r in rows])
    rng = np.random.default_rng(0)
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(lang == k))[:each] for k in range(len(languages))])
    marks = np.unpackbits(packed[chosen], axis=1).astype(np.float32)
    scale = 1 / np.sqrt(marks.sum(1))

    def kernel(rows_of: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(rows_of), 256):  # a bounded piece at a time
            x = np.unpackbits(rows_of[at : at + 256], axis=1).astype(np.float32)
            out.append((x @ marks.T) * scale / np.sqrt(x.sum(1))[:, None])
        return np.concatenate(out).astype(np.float64)

    value, vector = np.linalg.eigh(kernel(packed[chosen]))
    keep = value > 1e-8 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    mapped = kernel(packed) @ root
    share = np.bincount(lang, minlength=len(languages))
    weight = (1 / share[lang])[:, None] * len(lang) / len(languages)
    target = np.eye(len(languages))[lang]
    solved = np.linalg.solve(mapped.T @ (mapped * weight) + ridge * len(lang) * np.eye(mapped.shape[1]), mapped.T @ (target * weight))
    return Model(packed[chosen], (root @ solved).astype(np.float32), languages)


def _judged(texts: list[str | None], state) -> tuple[list[str], list[float]]:
    """Language and score of each text, a batch of matrix rows at a time."""
    n = len(texts)
    pred, score = [UNKNOWN] * n, [0.0] * n
    if state:
        marks, scale, m = state
        flags = np.zeros((BATCH, 1 << BITS), np.uint8)
        for at in range(0, n, BATCH):
            flags[:] = 0
            part = texts[at : at + BATCH]
            known = np.array([bool(t) and presence(t, flags[i]) for i, t in enumerate(part)])
            x = flags[: len(part)].astype(np.float32)
            size = np.sqrt(np.maximum(x.sum(1), 1))
            out = ((x @ marks.T) * scale / size[:, None]) @ m.weights
            best = out.argmax(1)
            for i in np.flatnonzero(known):
                pred[at + i], score[at + i] = m.languages[best[i]], float(np.clip(out[i, best[i]], 0, 1))
    return pred, score


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text, ...) with lang_pred and score.

    Null texts and texts without a letter are `und` with score 0, as is
    everything without a model.  Repeated rows are scored alike, other columns
    are ignored, an empty table gives an empty result, ties go to the language
    first in order.  Whole texts are read, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        return shared.value and (*shared.value.unpacked(), shared.value)

    def each(got, state):
        pred, score = _judged(got["text"], state)
        return {"doc_id": got["doc_id"], "lang_pred": pred, "score": score}

    return by_batch(docs.select("doc_id", "text"), each, "doc_id bigint, lang_pred string, score double", setup)


def known_only(docs: DataFrame, model: Model | None, least: float = 0.1) -> DataFrame:
    """The rows, all columns as they are, whose text has a language.

    Rejected are texts without a letter (null, empty, digits only) and those
    whose best language scores under `least`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))

    def run(batches):
        state = shared.value and (*shared.value.unpacked(), shared.value)
        for batch in (part for whole in batches for part in slices(whole)):
            _, score = _judged(batch.column(at).to_pylist(), state)
            yield batch.filter(pa.array([x >= least for x in score]))

    return docs.mapInArrow(run, docs.schema)


def training(docs: DataFrame) -> DataFrame:
    """The rows that labels may be learned from."""
    return docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id"), 4) != 2)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = predict(docs, fit(training(docs)))
    return got.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


SQL = None
