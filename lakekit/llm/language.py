"""Operator 8, language identification in two steps.

A text becomes counts of hashed byte three- and four-grams over its letters. Linear machines first tell language
families apart; within the family, one machine for each pair of its languages votes. The machines are fitted on the
driver from a bounded sample of labelled rows (``sample`` rows in all, the same share of each language); every text is
scored whole, in the tasks that read it.

Cases: null texts and texts without a letter are "und" with score 0, as are all texts when no row has a label; a
single learned language is predicted for every other text; rows of equal id are judged one by one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekit.llm.columns import fields, named
from lakekit.llm.linear import chance, fit_svm, fold
from lakekit.llm.textblocks import LOWER, Piece, as_text, pieces

SAMPLE = 5000
BUCKETS = 4096
UNKNOWN = "und"
#: ISO 639-1 codes by family. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi", "lb", "fy"],
    "romance": ["es", "fr", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "indic": ["hi", "bn", "mr", "gu", "pa", "ur", "ne", "si"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "semitic": ["ar", "he", "am", "mt"],
    "uralic": ["fi", "et", "hu"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "dravidian": ["ta", "te", "kn", "ml"],
    "baltic": ["lt", "lv"],
    "sinitic": ["zh", "yue"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = np.full(256, 0x20, dtype=np.uint8)
_LETTER[0x61:0x7B] = LOWER[0x61:0x7B]
_LETTER[0x41:0x5B] = LOWER[0x41:0x5B]
_LETTER[0x80:] = LOWER[0x80:]
_DOCS = 256


def features(piece: Piece) -> np.ndarray:
    """A row of unit length for each document: square roots of its hashed gram counts."""
    text = _LETTER[piece.buf].astype(np.uint32)
    blank = text == 0x20
    doc = np.full(len(text), piece.n_docs, dtype=np.int64)
    spans = piece.doc_end - piece.doc_start
    inside = np.repeat(piece.doc_start - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
    doc[inside] = np.repeat(np.arange(piece.n_docs), spans)
    three = text[:-3] | text[1:-2] << 8 | text[2:-1] << 16
    out = np.zeros((piece.n_docs, BUCKETS))
    # A gram may reach one blank past its text; grams of two blanks in a row say nothing.
    use = np.flatnonzero((doc[:-3] < piece.n_docs) & ~(blank[:-3] & blank[1:-2]) & ~(blank[1:-2] & blank[2:-1]))
    for grams, seed in ((three, 0x9E3779B1), (three | text[3:] << 24, 0x85EBCA77)):
        g = grams[use].astype(np.uint64) * np.uint64(seed)
        slot = ((g ^ (g >> np.uint64(29))) * np.uint64(0x2545F491)) >> np.uint64(20) & np.uint64(BUCKETS - 1)
        out += np.bincount(doc[use] * BUCKETS + slot.astype(np.int64), minlength=out.size).reshape(out.shape)
    out = np.sqrt(out)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _rows(text: pa.Array) -> Iterator[tuple[int, int, Piece]]:
    for at in range(0, len(text), _DOCS):
        some = text.slice(at, _DOCS)
        for lo, hi in pieces(some):
            yield at + lo, at + hi, Piece(some.slice(lo, hi - lo))


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


class Model:
    """Machines by pair: between families, and between the languages of a family."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.languages: dict[str, list[str]] = {}
        for label in sorted(set(labels)):
            self.languages.setdefault(_FAMILY.get(label, label), []).append(label)
        family = np.array([_FAMILY.get(label, label) for label in labels], dtype=object)
        self.machines = {}
        for names, truth in [(sorted(self.languages), family), *((c, labels) for c in self.languages.values())]:
            for a, b in combinations(names, 2):
                own = (truth == a) | (truth == b)
                y = np.where(truth[own] == a, 1, -1).astype(np.float32)
                self.machines[a, b] = fit_svm(x[own], y)

    def _vote(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The winner of all pairs, and how surely it beats its closest rival."""
        votes, margins = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        least = np.full((len(x), len(names)), np.inf)
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            w, bias = self.machines[a, b]
            m = (x @ w + bias).astype(np.float64)
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            margins[:, i] += np.tanh(m)
            margins[:, j] -= np.tanh(m)
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
        best = np.argmax(votes + margins / (2 * len(names)), axis=1)
        sure = 1 / (1 + np.exp(-4 * np.clip(least[np.arange(len(x)), best], -8, 8)))
        return best, sure

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        families = sorted(self.languages)
        family, score = self._vote(x, families)
        out = np.empty(len(x), dtype=object)
        for i, name in enumerate(families):
            own = np.flatnonzero(family == i)
            language, sure = self._vote(x[own], self.languages[name])
            out[own] = np.array(self.languages[name], dtype=object)[language]
            score[own] *= sure
        return out.tolist(), score


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` of the rows; None if no row has both a label and a letter."""
    counts = labelled.where(named(lang).isNotNull()).groupBy(named(lang).alias("lang")).agg(F.count("*").alias("n"))
    # At most `sample` languages can have a row in the sample.
    counts = {r["lang"]: r["n"] for r in counts.orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return None
    each = max(1, sample // len(counts))
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.2 * each / n + 20 / n))))
    picked = labelled.where(chance(named(doc_id), named(text)) < share[named(lang)]).select(
        named(lang).alias("lang"), named(text).alias("text"), F.xxhash64(named(doc_id), named(text)).alias("at")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = as_text(batch.column("text"))
            for lo, hi, piece in _rows(text):
                x = features(piece).astype(np.float16)
                letters = [has_letter(t) for t in text.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("lang").slice(lo, hi - lo),
                        batch.column("at").slice(lo, hi - lo),
                        pa.array([r.tobytes() if ok else None for r, ok in zip(x, letters, strict=True)], pa.binary()),
                    ],
                    ["lang", "at", "x"],
                )

    rows = picked.mapInArrow(measure, "lang string, at long, x binary").where("x IS NOT NULL").toArrow().to_pylist()
    taken: dict[str, int] = {}
    kept = []
    for row in sorted(rows, key=lambda r: (r["at"], r["lang"])):
        if taken.get(row["lang"], 0) < each:
            taken[row["lang"]] = taken.get(row["lang"], 0) + 1
            kept.append(row)
    if not kept:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in kept]).astype(np.float32)
    return Model(x, np.array([r["lang"] for r in kept], dtype=object))


def predict(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``documents`` as struct ``row`` with lang_pred and score."""
    rows = documents.select(F.struct(*(named(c) for c in documents.columns)).alias("row"), named(text).alias("text"))
    held = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = as_text(batch.column("text"))
            names, scores = [], []
            for lo, hi, piece in _rows(text):
                ok = [has_letter(t) for t in text.slice(lo, hi - lo).to_pylist()]
                if held.value is None:
                    ok = [False] * len(ok)
                    found, sure = ok, ok
                else:
                    found, sure = held.value.predict(features(piece))
                names += [n if o else UNKNOWN for n, o in zip(found, ok, strict=True)]
                scores += [float(s) if o else 0.0 for s, o in zip(sure, ok, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["row", "lang_pred", "score"],
            )

    return rows.mapInArrow(judge, fields(row=rows.schema["row"].dataType, lang_pred="string", score="double"))


def op8_language(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from two of three folds."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    documents = documents.withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    model = fit(documents.where("NOT held_out"))
    found = predict(documents.select("doc_id", "text", "held_out"), model)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("row.held_out").alias("held_out"), "lang_pred", "score")
