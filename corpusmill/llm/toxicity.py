"""Toxicity by a weighted lexicon.

Texts are folded: lower case, look-alike letters and digit substitutions replaced,
everything but letters a space. An Aho-Corasick automaton then finds the lexicon's words and
word beginnings; hits inside exception phrases don't count. The sum of weights, also
over the number of words, goes through a logistic curve. Words and weights come from
labelled rows: terms whose share in toxic texts stands out beyond chance join a small
fixed list.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed, id_crc32, map_slices

#: Terms of the lexicon that need no labels; a space at the end means the whole word.
SEED_TERMS = ("idiot", "moron", "stupid", "scum ", "loser", "worthless", "pathetic", "disgusting", "trash ", "clown ", "imbecile", "dumbass", "asshole", "bastard", "bitch", "retard", "whore", "slut ", "fuck", "shithead", "scumbag", "filthy ")
#: Phrases in which a term isn't an insult.
EXCEPTIONS = ("trash can ", "trash bin ", "trash bag ", "trash collect", "clown fish ", "clown nose ", "fire retard", "flame retard", "scum line ", "pond scum ", "filthy rich ")
#: Letters that look like Latin ones.
LOOK_ALIKES = dict(zip("аеорсухікѕјԁӏԛԝвнмтαεορυικντχ", "aeopcyxiksjdlqwbhmtaeopyikvtx", strict=True))
#: Digits that stand for letters.
DIGITS = dict(zip("0134578", "oieastb", strict=True))
_INVISIBLE = dict.fromkeys([0x00AD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])
_signs = re.compile(r"(?<=[^\W\d_])[$@!](?=[^\W\d_])")
SIGNS = {"$": "s", "@": "a", "!": "i"}


def _plain(char: str) -> str:
    char = DIGITS.get(char, char).lower()
    return char if char.isalpha() and len(char) == 1 else " "


_LATIN = bytes(ord(_plain(chr(b))) if ord(_plain(chr(b))) < 256 else b for b in range(256))


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        out = self[code] = LOOK_ALIKES.get(chr(code)) or _plain(chr(code))
        return out


_folds = _Folds(_INVISIBLE)


def fold(text: str) -> str:
    """The text with a space before and after it, and nothing else but folded letters and spaces."""
    if "$" in text or "@" in text or "!" in text:
        text = _signs.sub(lambda m: SIGNS[m.group()], text)
    try:
        return f" {text.encode('latin-1').translate(_LATIN, b'\xad').decode('latin-1')} "
    except UnicodeEncodeError:
        return f" {unicodedata.normalize('NFKC', text).lower().translate(_folds)} "


@dataclass(frozen=True)
class Model:
    terms: tuple[tuple[str, float], ...]  # as in SEED_TERMS, with weight
    curve: tuple[float, float, float, float]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with its automaton, built once a task."""

    def __init__(self, model: Model):
        self.curve, self.find = model.curve, ahocorasick.Automaton()
        for term, weight in model.terms:
            self.find.add_word(f" {term}", (weight, len(term) + 1))
        for phrase in EXCEPTIONS:
            self.find.add_word(f" {phrase}", (-1.0, len(phrase) + 1))
        self.find.make_automaton()

    def hits(self, folded: str) -> dict[int, tuple[float, int]]:
        """Weight and length of the longest term at each place, without those that begin inside an exception phrase."""
        hits: dict[int, tuple[float, int]] = {}
        spared: list[tuple[int, int]] = []
        for end, (weight, length) in self.find.iter(folded):
            start = end + 1 - length
            if weight < 0:
                spared.append((start, end))
            elif start not in hits or length > hits[start][1]:
                hits[start] = (weight, length)
        spared.sort()
        places, at = sorted(hits), 0
        for a, b in spared:  # both in order of place, so that a long text's hits are walked through once
            while at < len(places) and places[at] < a:
                at += 1
            while at < len(places) and places[at] <= b:
                del hits[places[at]]
                at += 1
        return hits

    def features(self, text: str | None) -> tuple[float, float, float]:
        """log1p of: weight of all hits, the same per 100 words, the number of distinct words hit."""
        folded = fold(text or "")
        hits = self.hits(folded)
        if not hits:
            return 0.0, 0.0, 0.0
        total = sum(w for w, _ in hits.values())
        kinds = len({folded[s : s + n] for s, (_, n) in hits.items()})
        return math.log1p(total), math.log1p(100 * total / max(1, len(folded.split()))), math.log1p(kinds)

    def score(self, text: str | None) -> float:
        a, b, c = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b + self.curve[3] * c
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


#: Curve and weight where no labels speak.
_UNTAUGHT, _WEIGHT = (-3.0, 3.0, 0.5, 1.0), 5.0


def _text_terms(text: str) -> set[str]:
    found = set()
    for word in set(fold(text).split()):
        found.add(word + " ")
        found.update(word[:k] for k in range(4, min(len(word), 10) + 1))
    return found


def _curve(features: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, with a small ridge."""
    x = np.hstack([np.ones((len(features), 1)), features])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (label - p)) - 0.1 * b
        b = b + np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(b)), slope)
    return tuple(map(float, b))


def learn(documents: DataFrame, labels: DataFrame, toxic_rows: int = 2000, clean_rows: int = 4000, least_evidence: float = 22.0) -> Model:
    """Lexicon and curve from a sample of about ``toxic_rows`` and ``clean_rows`` labelled rows, never held-out ones.

    The sample is drawn by a hash of doc_id. A term is a whole word or a word beginning of 4 to
    10 letters; it is taken if the likelihood ratio of its counts in toxic and clean texts
    exceeds ``least_evidence`` and its odds are over 20 times higher in toxic ones; all of them
    come to the driver, no more than the sample has. Terms of equal evidence are all taken. Without labelled toxic rows the fixed list stands alone.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (id_crc32("doc_id") % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    untaught = Model(tuple((t, _WEIGHT) for t in SEED_TERMS), _UNTAUGHT)
    if not total.get(1) or not total.get(0):
        return untaught
    share = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.where(share < F.when(F.col("toxic") == 1, toxic_rows / total[1]).otherwise(clean_rows / total[0]))
    # the sample's ids are bounded by the parameters, so they may be broadcast
    sample = checkpointed(documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.col("text").isNotNull()).select("toxic", "text"))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return untaught

    def count():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: tuple[dict, dict] = ({}, {})
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                of = counts[label]
                for term in _text_terms(text):
                    of[term] = of.get(term, 0) + 1
            terms = [t for t in {**counts[0], **counts[1]} if t in counts[1]]
            rest = [t for t in counts[0] if t not in counts[1]]
            names = terms + rest
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k].get(t, 0) for t in names], pa.int64()) for k in (1, 0))], ["term", "a", "b"])

        return work

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    a, b, rate = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / float(toxic + clean)
    evidence = 2 * (part(a, rate * toxic) + part(b, rate * clean) + part(toxic - a, (1 - rate) * toxic) + part(clean - b, (1 - rate) * clean))
    odds = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5))
    found = map_slices(sample.select("toxic", "text"), count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = found.where(a >= 3).withColumns({"evidence": evidence, "odds": odds}).where((F.col("evidence") > least_evidence) & (F.col("odds") > math.log(20)))
    counted = {r["term"]: (r["a"], r["b"], r["odds"]) for r in found.collect()}
    longer = {t[:-1] for t, c in counted.items() if len(t) > 1 and counted.get(t[:-1], (0, 0))[:2] == c[:2]}  # a longer term with the same counts says more
    terms: dict[str, float] = {}
    for t in sorted(counted, key=lambda t: (len(t), t)):
        if t not in longer and not any(terms.get(t[:k], -9) >= counted[t][2] - 1 for k in range(4, len(t))):
            terms[t] = counted[t][2]
    for t in SEED_TERMS:
        if not any(t[:k] in terms for k in range(4, len(t) + 1)):
            terms[t] = _WEIGHT
    model = Model(tuple(sorted(terms.items())), _UNTAUGHT)

    def measure():
        of = model.scorer().features

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([of(t) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x[:, k]) for k in range(3))], ["toxic", "x", "y", "z"])

        return work

    got = np.array(sorted(tuple(r) for r in map_slices(sample.select("toxic", "text"), measure, "toxic long, x double, y double, z double").collect()))
    weight = np.where(got[:, 0] == 1, total[1] / toxic, total[0] / clean)
    return Model(model.terms, _curve(got[:, 1:], got[:, 0], weight / weight.mean()))


def score(documents: DataFrame, model: Model, keep_columns: bool = False) -> DataFrame:
    """toxicity (0 to 1) of every whole text, beside doc_id or (``keep_columns``) all columns.

    A null text counts as empty. Very long texts are taken whole, in one pass. Nulls in other columns and repeated rows pass through; an empty table stays empty. With ``keep_columns``, a column of the
    name toxicity is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    documents = documents.drop("toxicity") if keep_columns else documents.select("doc_id", "text")
    at = documents.columns.index("text")
    names = documents.columns if keep_columns else ["doc_id"]

    def make():
        of = shared.value.scorer().score

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = batch.columns if keep_columns else [batch.column(0)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(map(of, batch.column(at).to_pylist()), pa.float64())], [*names, "toxicity"])

        return work

    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields if f.name in names)
    return map_slices(documents, make, f"{held}, toxicity double")


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row: learns from labelled rows that aren't held out, scores all."""
    found = score(documents, learn(documents, labels))
    return found.select("doc_id", (id_crc32("doc_id") % 5 == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
