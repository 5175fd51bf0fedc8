"""Language identification by string kernels.

A text is the set of its byte n-grams of several lengths (blended spectrum, presence),
hashed to a fixed number of positions. The kernel of two texts is their number of common
positions over the root of the product of their set sizes. A Nyström map over landmark texts
makes it linear, and one ridge regression a language, each against the rest, is solved
in that space. Scoring multiplies matrices: texts by landmarks, then by coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import id_crc32, map_slices

UNDETERMINED = "und"
#: ASCII other than letters counts as a space.
_SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_MIX = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (categories L*); numerals such as ², ½ or Ⅷ aren't."""
    return any(map(str.isalpha, text or ""))


@dataclass(frozen=True)
class Spectrum:
    """Which n-grams are taken and to how many positions they are hashed."""

    lengths: tuple[int, ...] = (2, 3, 4)
    bits: int = 15

    def presence(self, texts: list[str | None]) -> np.ndarray:
        """A row of 0 and 1 for each whole text."""
        out = np.zeros((len(texts), 1 << self.bits), np.uint8)
        shift = np.uint32(32 - self.bits)
        for row, text in zip(out, texts, strict=True):
            if not text:
                continue
            data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" ", np.uint8).astype(np.uint32)
            gram = data
            for n in range(2, max(self.lengths) + 1):
                if len(data) < n:
                    break
                gram = gram[:-1] * np.uint32(0x01000193) + data[n - 1 :]
                if n in self.lengths:
                    row[(gram * _MIX) >> shift] = 1
        return out


@dataclass(frozen=True)
class Model:
    spectrum: Spectrum
    languages: tuple[str, ...]
    landmarks: np.ndarray  # packed presence, a row each
    coefficients: np.ndarray  # landmark by language

    def scorer(self):
        """A function that gives (language, score) of each whole text."""
        if not self.languages:
            return lambda texts: [(UNDETERMINED, 0.0)] * len(texts)
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
        marks = np.ascontiguousarray(marks.T)

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            out = []
            for start in range(0, len(texts), 128):
                part = texts[start : start + 128]
                x = self.spectrum.presence(part).astype(np.float32)
                size = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
                f = ((x @ marks) / size).astype(np.float64) @ self.coefficients
                p = np.exp(4 * (f - f.max(1, keepdims=True)))
                p /= p.sum(1, keepdims=True)
                best = f.argmax(1)
                out += [(self.languages[b], float(q[b])) if has_letter(t) else (UNDETERMINED, 0.0) for t, b, q in zip(part, best, p, strict=True)]
            return out

        return score


def _kernel(packed: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel values of packed presence rows with landmarks, a block of rows at a time."""
    def scaled(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(rows, axis=1).astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return x

    right = np.ascontiguousarray(scaled(marks).T)
    return np.concatenate([scaled(packed[i : i + 64]) @ right for i in range(0, len(packed), 64)]).astype(np.float64)


def fit(packed: np.ndarray, languages: list[str], spectrum: Spectrum, landmarks_each: int = 32, ridge: float = 1e-2) -> Model:
    """Kernel ridge regressions over packed presence rows; the first rows of each language are the landmarks."""
    names = tuple(sorted(set(languages)))
    if not names:
        return Model(spectrum, (), packed, np.zeros((0, 0)))
    label = np.array([names.index(x) for x in languages])
    marks = packed[np.concatenate([np.flatnonzero(label == k)[:landmarks_each] for k in range(len(names))])]
    values, vectors = np.linalg.eigh(_kernel(marks, marks))
    keep = values > 1e-6 * values.max(initial=0)
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = _kernel(packed, marks) @ root
    weight = (len(label) / (len(names) * np.bincount(label)))[label][:, None]  # each language counts alike
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    beta = np.linalg.solve(z.T @ (weight * z) + ridge * len(label) * np.eye(z.shape[1]) / 100, z.T @ (weight * target))
    return Model(spectrum, names, marks, root @ beta)


def learn(documents: DataFrame, each: int = 400, most_rows: int = 24_000, most_landmarks: int = 4096, spectrum: Spectrum = Spectrum()) -> Model:
    """Fits on a bounded sample of labelled rows, never held-out ones: about ``each`` of every language, fewer each if that exceeds ``most_rows``, but always one.

    Every language with a labelled text that has a letter is learned. The sample is drawn by a hash of doc_id, rows of equal or null doc_id together. Only the
    sample's packed presence rows, of fixed size, and a row a language come to the driver.
    """
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (id_crc32("doc_id") % 3 != 1)).select("doc_id", "text", "lang")
    share = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    counts = usable.groupBy("lang").agg(F.count("*").alias("rows"), F.min(share).alias("least")).collect()
    if not counts:
        return fit(np.zeros((0, 0), np.uint8), [], spectrum)
    each = min(each, max(1, most_rows // len(counts)))
    parts = documents.sparkSession.createDataFrame([(r["lang"], max(each / r["rows"], r["least"])) for r in counts], "lang string, part double")
    usable = usable.join(F.broadcast(parts), "lang").where(share <= F.col("part")).select("doc_id", "text", "lang")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = [(d, t, k) for d, t, k in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
            if not rows:
                return None
            packed = np.packbits(spectrum.presence([t for _, t, _ in rows]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in rows], pa.int64()), pa.array([k for _, _, k in rows]), pa.array([x.tobytes() for x in packed], pa.binary())], ["doc_id", "lang", "packed"])

        return work

    sample = sorted(map_slices(usable, make, "doc_id long, lang string, packed binary").collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, bytes(r["packed"])))
    packed = np.frombuffer(b"".join(bytes(r["packed"]) for r in sample), np.uint8).reshape(len(sample), -1)
    return fit(packed, [r["lang"] for r in sample], spectrum, min(32, max(1, most_landmarks // len(counts))))


def predict(documents: DataFrame, model: Model, keep_columns: bool = False) -> DataFrame:
    """lang_pred and score for every whole text, beside doc_id or (``keep_columns``) all columns.

    ``und`` with score 0 for a null, empty or letterless text, or if nothing could be learned. Very long texts are taken whole: a text is a set of
    fixed size. Of equally scored languages the first by name is taken. Nulls in other columns and
    repeated rows pass through; an empty table stays empty. With ``keep_columns``, columns of the
    names lang_pred or score are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    documents = documents.drop("lang_pred", "score") if keep_columns else documents.select("doc_id", "text")
    at = documents.columns.index("text")
    names = documents.columns if keep_columns else ["doc_id"]

    def make():
        score = shared.value.scorer()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = score(batch.column(at).to_pylist())
            columns = batch.columns if keep_columns else [batch.column(0)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*names, "lang_pred", "score"])

        return work

    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields if f.name in names)
    return map_slices(documents, make, f"{held}, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row: learns from the rows that aren't held out, predicts all."""
    return predict(documents, learn(documents)).select("doc_id", (id_crc32("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score")
