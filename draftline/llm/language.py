"""Language identification by error-correcting output codes over hashed letter trigrams."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import in_batches

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes outside letters become spaces, so that marks and digits carry nothing.
_ONLY_LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_CHUNK = 1 << 20


def features(text: str, size: int) -> np.ndarray:
    """Square roots of hashed counts of byte trigrams of the lower-cased letters, scaled to length one."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_ONLY_LETTERS) + b" ", np.uint8)
    counts = np.zeros(size, dtype=np.int64)
    for at in range(0, len(data) - 2, _CHUNK):
        x = data[at : at + _CHUNK + 2].astype(np.uint32)
        # blank trigrams and runs of blanks tell nothing
        mixed = (x[:-2] * 65536 + x[1:-1] * 256 + x[2:])[~((x[:-2] == 32) & (x[1:-1] == 32))]
        counts += np.bincount((mixed * np.uint32(2654435761)) >> np.uint32(32 - size.bit_length() + 1), minlength=size)
    root = np.sqrt(counts, dtype=np.float32)
    return root / max(1.0, float(np.sqrt(counts.sum())))


def code_words(classes: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 per class: all different splits for up to five classes, else the best of
    random codes by the smallest distance of two rows."""
    if classes <= 5:
        columns = [[1 - 2 * (split >> c & 1) for c in range(classes)] for split in range(1, 2 ** (classes - 1))]
        return np.array(columns, dtype=np.int8).T.reshape(classes, -1)
    random, length = np.random.default_rng(seed), math.ceil(10 * math.log2(classes))
    best, widest = None, -1
    for _ in range(200):
        code = random.choice(np.array([-1, 1], dtype=np.int8), (classes, length))
        distance = (length - code.astype(int) @ code.T) // 2 + length * np.eye(classes, dtype=int)
        if distance.min() > widest:
            best, widest = code, distance.min()
    return best


@dataclass
class LanguageModel:
    """Weights of one binary classifier per code bit, the codewords, and each classifier's weight per class."""

    classes: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    size: int

    def decode(self, rows: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Loss-weighted decoding: language, score from 0 to 1, and the gap to the runner-up's score."""
        if not self.classes:
            none = np.zeros(len(rows))
            return [UNKNOWN] * len(rows), none, none
        margins = rows @ self.weights + self.bias
        loss = np.einsum("ncb,cb->nc", np.logaddexp(0, -margins[:, None, :] * self.code[None]), self.trust)
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        odds /= odds.sum(axis=1, keepdims=True)
        order = np.sort(odds, axis=1)
        gap = order[:, -1] - (order[:, -2] if odds.shape[1] > 1 else 0)
        return [self.classes[i] for i in loss.argmin(axis=1)], order[:, -1].astype(float), gap.astype(float)


def held_out(id_column: str = "doc_id") -> Column:
    """Fixed value of the contract: a quarter of the rows is never learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def fit(rows: np.ndarray, names: list[str], size: int, steps: int = 120, ridge: float = 1e-5) -> LanguageModel:
    """Logistic regression for every code bit at once, by accelerated gradient steps."""
    classes = sorted(set(names))
    code = code_words(len(classes)).astype(np.float32)
    if len(classes) < 2:
        return LanguageModel(classes, code, np.zeros((size, code.shape[1])), np.zeros(code.shape[1]), code, size)
    label = np.array([classes.index(x) for x in names])
    target, mean = code[label], rows.mean(axis=0)
    x = rows - mean
    probe = np.ones(size, dtype=np.float32)
    for _ in range(20):
        probe = x.T @ (x @ (probe / np.linalg.norm(probe)))
    step = 1 / (0.25 * np.linalg.norm(probe) / len(x) * 1.1 + ridge)
    w = last = np.zeros((size, code.shape[1]), dtype=np.float32)
    b = last_b = np.zeros(code.shape[1], dtype=np.float32)
    for t in range(steps):
        ahead, ahead_b = w + t / (t + 3) * (w - last), b + t / (t + 3) * (b - last_b)
        pull = -target / (1 + np.exp(target * (x @ ahead + ahead_b))) / len(x)
        last, last_b = w, b
        w, b = ahead - step * (x.T @ pull + ridge * ahead), ahead_b - 2 * pull.sum(axis=0)
    right = (x @ w + b) * target > 0
    share = np.stack([right[label == c].mean(axis=0) for c in range(len(classes))])
    trust = np.maximum(share, 1e-3)
    trust = trust / trust.sum(axis=1, keepdims=True) * code.shape[1]
    return LanguageModel(classes, code, w, b - mean @ w, trust, size)


def train(docs: DataFrame, size: int = 2048, sample: int = 4000) -> LanguageModel:
    """Fit on about `sample` labelled rows outside the held-out quarter, spread evenly over languages.

    Only this many feature vectors of `size` numbers (sample * size * 4 bytes) reach the driver. Rows
    are drawn by a hash of doc_id, so the model depends on the data alone.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((0, 0)), np.zeros((size, 0)), np.zeros(0), np.zeros((0, 0)), size)
    share = sample / len(counts)
    cut = F.lit(None).cast("double")
    for name, n in counts.items():
        cut = F.when(F.col("lang") == name, F.lit(min(1.0, share / n))).otherwise(cut)
    uniform = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.where(uniform < cut).select("lang", "text")

    def vectors(batches):
        import pyarrow as pa

        def one(batch):
            texts = batch.column(1).to_pylist()
            data = [features(t, size).tobytes() if _LETTER.search(t) else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["lang", "x"])

        yield from in_batches(one)(batches)

    found = drawn.mapInArrow(vectors, "lang string, x binary").where("x IS NOT NULL").toArrow()
    order = sorted(zip(found["lang"].to_pylist(), found["x"].to_pylist()))  # sums do not depend on who came first
    if not order:
        return LanguageModel([], np.zeros((0, 0)), np.zeros((size, 0)), np.zeros(0), np.zeros((0, 0)), size)
    rows, names = np.stack([np.frombuffer(x, np.float32) for _, x in order]), [name for name, _ in order]
    del found, order
    return fit(rows, names, size)


def predict(docs: DataFrame, model: LanguageModel, ambiguous_gap: float = 0.02, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous (and `extra` columns) of every whole text.

    Only the text decides. NULL texts and texts without a letter are `und` with score 0. `ambiguous`
    marks texts whose two nearest codewords are about equally far. Repeated rows are judged alike.
    """
    schema = T.StructType(
        [
            *[docs.schema[c] for c in ("doc_id", *extra)],
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType()),
        ]
    )
    columns = list(dict.fromkeys(["doc_id", *extra, "text"]))

    def run(batches):
        import pyarrow as pa

        def one(batch):
            texts = batch.column("text").to_pylist()
            known = [bool(t and _LETTER.search(t)) for t in texts]
            rows = [features(t, model.size) if k else np.zeros(model.size, np.float32) for t, k in zip(texts, known)]
            names, score, gap = model.decode(np.stack(rows)) if rows else ([], np.zeros(0), np.zeros(0))
            known = np.array(known, dtype=bool)
            arrays = {c: batch.column(c) for c in ("doc_id", *extra, "held_out")}
            arrays["lang_pred"] = pa.array([n if k else UNKNOWN for n, k in zip(names, known)], pa.string())
            arrays["score"] = pa.array(np.where(known, score, 0.0))
            arrays["ambiguous"] = pa.array(known & (gap < ambiguous_gap))
            yield pa.RecordBatch.from_arrays([arrays[f.name] for f in schema.fields], [f.name for f in schema.fields])

        yield from in_batches(one, 256)(batches)

    return docs.select(*columns, held_out().alias("held_out")).mapInArrow(run, schema)
