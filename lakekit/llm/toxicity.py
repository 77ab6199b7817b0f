"""Operator 3, toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults and verbs of violence, whose weights are learned, and targets, copulas, agents, modals,
conditions, negations, reporting verbs, quotes, gaps and clause ends. Five transducers are composed into one, which runs
over the symbols of each clause. The insult transducer tells an insult that is said of somebody ("you are an X") from a
bare one; the threat transducer makes a threat of a verb that an agent intends ("I will X you") or that a condition
carries ("stop or X"), and leaves any other as mere force; negation, reported speech and target mark what they
reach. What comes out are matched patterns: an insult, a jibe, a threat or force that is plain, aimed at somebody, negated
or reported. Quotes are double quotes and guillemets anywhere in the text; blanks around a mark tell whether it opens
or closes, and a quote without an end lasts up to the line's end. A logistic model over the weights of the matched patterns gives the score.

Learned from at most ``sample`` labelled rows, half of them toxic where there are enough: insults are the whole words
and word beginnings that mark toxic documents; verbs are those that do so behind a modal, besides a few known ones; weights are log odds. Every text is
scored whole.

Cases: null and empty texts have no pattern and get the score of a text without one; a document with several labels is
toxic if any says so; labels that are null or no 0 or 1 are not used; without labels of both kinds every score is 0;
rows of equal id are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekit.llm.columns import fields, named
from lakekit.llm.linear import chance, fit_logistic, fold
from lakekit.llm.textblocks import _MASKS, ALNUM, Piece, as_text, pieces
from lakekit.session import scratch_path

SAMPLE = 12_000
LEXICON = 1000
#: Lengths in bytes of the word beginnings that may be learned; 0 stands for whole words.
LENGTHS = [0, 4, 5, 6, 7, 8]
#: Stands for a whole word one or two places behind a modal.
VERB = -1
#: A negation reaches over so many words.
REACH = 3

# Function words that give a pattern its role, and verbs that need no learning.
ROLES = {
    "agent": "i we i'll we'll ich wir yo nosotros je nous",
    "modal": "will shall gonna going must i'll we'll werde werden wirst voy vamos vais vas allons",
    "condition": "if unless else wenn falls sonst si sino sinon",
    "copula": "are is am was were be bist seid ist sind war eres sois está estás est êtes",
    "target": "you your yours yourself he she they them du dich dir dein deine ihr euch sie tú ti usted ustedes ellos"
    " vosotros toi vous ton ta tes ils elles",
    "negation": "not no never nobody nothing neither nor cannot don't isn't nicht kein keine nie niemals ningún nunca"
    " jamás ne pas jamais aucun aucune",
    "report": "said says say told tells wrote writes called calls claimed quoted reported sagte sagt schrieb nannte"
    " behauptete dijo dice escribió llamó dit écrit disait appelé",
}
VERBS = "kill murder hurt destroy beat shoot stab burn hang umbringen töten schlagen matar golpear tuer frapper"
#: A word of two roles stands for both, in this order.
BOTH = {"you're": ("target", "copula"), "youre": ("target", "copula"), "i'll": ("agent", "modal"), "we'll": ("agent", "modal")}

Table = dict[tuple[int, str], tuple[int, str]]


KINDS = ("insult", "jibe", "threat", "force")


def _insult() -> Table:
    """An insult behind a copula of its clause is a jibe."""
    t: Table = {}
    for state in (0, 1):
        t[state, "copula"] = (1, "")
        t[state, "insult"] = (0, "jibe" if state else "insult")
        t[state, "gap"], t[state, "break"] = (0, "gap"), (0, "break")
    return t


def _threat() -> Table:
    """A verb is a threat when an agent intends it or a condition of its clause carries it, and else mere force."""
    none, agent, intends, condition = range(4)
    t: Table = {}
    for state in range(4):
        t[state, "agent"] = (state if state == condition else agent, "")
        t[state, "modal"] = (intends if state == agent else state, "")
        t[state, "condition"] = (condition, "")
        t[state, "verb"] = (state, "threat" if state in (intends, condition) else "force")
        t[state, "gap"] = (condition if state == condition else none, "gap")
        t[state, "break"] = (none, "break")
    return t


def _negation() -> Table:
    t: Table = {}
    for state in (0, 1):
        t[state, "negation"] = (1, "")
        t[state, "gap"] = (0, "")
        t[state, "break"] = (0, "break")
        for x in KINDS:
            t[state, x] = (state, f"{x}-" if state else x)
    return t


def _report() -> Table:
    """A reporting verb colours its clause; a quote colours what follows up to its end, or else the clause's."""
    t: Table = {}
    for state in (0, 1):
        t[state, "report"] = (1, "")
        t[state, "quote"] = (1 - state, "")
        t[state, "open"], t[state, "close"] = (1, ""), (0, "")
        t[state, "break"] = (0, "break")
        for x in KINDS:
            t[state, x] = (state, f"{x}~" if state else x)
            t[state, f"{x}-"] = (state, f"{x}~" if state else f"{x}-")
    return t


def _target() -> Table:
    """Marks a pattern that follows a target of its clause, and tells of a target that follows."""
    t: Table = {}
    for state in (0, 1):
        t[state, "target"] = (1, "target")
        t[state, "break"] = (0, "break")
        for x in KINDS:
            t[state, x] = (state, f"{x}@" if state else x)
            t[state, f"{x}-"], t[state, f"{x}~"] = (state, f"{x}-"), (state, f"{x}~")
    return t


def compose(first: Table, second: Table) -> Table:
    """The transducer that feeds the output of ``first`` to ``second``; symbols unknown to one pass through it."""
    states = [sorted({s for s, _ in t}) for t in (first, second)]
    symbols = {x for _, x in first} | {x for _, x in second}
    width, out = len(states[1]), {}
    for a in states[0]:
        for b in states[1]:
            for x in symbols:
                a2, y = first.get((a, x), (a, x))
                b2, z = second.get((b, y), (b, y)) if y else (b, "")
                out[a * width + b, x] = (a2 * width + b2, z)
    return out


CASCADE = [_insult(), _threat(), _negation(), _report(), _target()]
GRAMMAR = reduce(compose, CASCADE)
PATTERNS = [f"{kind}{mark}" for kind in KINDS for mark in ("", "@", "-", "~")]


def match(symbols: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Patterns with weights, from symbols with weights. A target after a plain pattern of its clause aims it too."""
    state, out, clause = 0, [], 0
    for symbol, weight in symbols:
        state, said = GRAMMAR.get((state, symbol), (state, ""))
        if said in PATTERNS:
            out.append((said, weight))
        elif said == "target":
            out[clause:] = [(f"{p}@" if p in KINDS else p, w) for p, w in out[clause:]]
        elif said == "break":
            clause = len(out)
    return out


def _hashes(words: list[str]) -> np.ndarray:
    return Piece(pa.array([" ".join(words)], pa.large_string()), lower=True).split(_WORD).word_hashes()


_WORD = ALNUM.copy()
_WORD[0x27] = True  # an apostrophe belongs to its word
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".!?;:\n")] = True
#: Bytes before a mark that opens a quote, and after one that closes it.
_LEFT, _RIGHT = np.zeros((2, 256), dtype=bool)
_LEFT[list(b" \t\r\n([{-")] = True
_RIGHT[list(b" \t\r\n.,;:!?)]}")] = True
_CLOSE, _OPEN, _TURN = 0, 1, 2
#: What a mark does that has blanks on both sides or on none.
_QUOTES = {'"': _TURN, "“": _OPEN, "”": _CLOSE, "„": _OPEN, "‟": _OPEN, "«": _OPEN, "»": _CLOSE, "‹": _OPEN, "›": _CLOSE}
_BLANKS = ["\xa0", "\u202f"]


def _places(buf: np.ndarray, mark: str) -> np.ndarray:
    code = mark.encode()
    at = np.flatnonzero(buf[: len(buf) - 2] == code[0])
    for i, byte in enumerate(code[1:], 1):
        at = at[buf[at + i] == byte]
    return at


def quotes(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a quote may begin or end, whether a quote is open behind them, and how many quotes came so far.

    Marks of several bytes become blanks, so that they part words.
    """
    buf = piece.buf
    found = [(at, len(mark.encode()), kind) for mark, kind in _QUOTES.items() if len(at := _places(buf, mark))]
    lines = np.concatenate([piece.doc_start, np.flatnonzero(buf == 0x0A) + 1])
    place, kind, real = [lines], [np.full(len(lines), _CLOSE)], [np.zeros(len(lines), dtype=np.int64)]
    for at, size, usual in found:
        left, right = _LEFT[buf[at - 1]], _RIGHT[buf[at + size]]
        place.append(at)
        kind.append(np.where(left & ~right, _OPEN, np.where(right & ~left, _CLOSE, usual)))
        real.append(np.ones(len(at), dtype=np.int64))
    for at, size in [*((at, size) for at, size, _ in found if size > 1), *((_places(buf, b), len(b.encode())) for b in _BLANKS)]:
        for i in range(size):
            buf[at + i] = 0x20
    at, kind, real = np.concatenate(place), np.concatenate(kind), np.concatenate(real)
    order = np.lexsort((real, at))
    at, kind, real = at[order], kind[order], real[order]
    # A mark of either kind turns what the last certain one has left.
    certain = np.maximum.accumulate(np.where(kind == _TURN, 0, np.arange(len(at))))
    turns = np.cumsum(kind == _TURN)
    return at, (kind[certain] + turns - turns[certain]) % 2 == 1, np.cumsum(real)


class Lexicon:
    """Weighted insults by whole word and by beginning, weighted verbs, and the words of each role."""

    def __init__(self, entries: list[tuple[int, int, float]]):
        self.tables = []
        for length in sorted(LENGTHS, key=lambda k: k or 99, reverse=True):  # the longest match decides
            own = sorted((key % (1 << 64), w) for k, key, w in entries if k == length)
            if own:
                self.tables.append((length, np.array([k for k, _ in own], np.uint64), np.array([w for _, w in own])))
        roles = {h: (role,) for role, words in ROLES.items() for h in _hashes(words.split())}
        roles |= dict(zip(_hashes(list(BOTH)), BOTH.values(), strict=True))
        self.role_keys = np.array(sorted(roles), dtype=np.uint64)
        self.role_names = [roles[k] for k in sorted(roles)]
        verbs = dict.fromkeys(_hashes(VERBS.split()).tolist(), 1.0) | {key % (1 << 64): w for k, key, w in entries if k == VERB}
        self.verb_keys = np.array(sorted(verbs), dtype=np.uint64)
        self.verb_weights = np.array([verbs[k] for k in sorted(verbs)])

    def weights(self, piece: Piece, words: np.ndarray) -> np.ndarray:
        """The weight of every word; 0 where it is no insult."""
        out = np.zeros(len(words))
        for length, keys, weights in self.tables:
            values = words if not length else beginnings(piece, length)
            place = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            hit = np.flatnonzero((keys[place] == values) & (out == 0))
            out[hit] = weights[place[hit]]
        return out

    def read(self, piece: Piece) -> np.ndarray:
        """A row of features for each document."""
        words = piece.word_hashes()
        weight = self.weights(piece, words)
        place = np.minimum(np.searchsorted(self.role_keys, words), len(self.role_keys) - 1)
        role = np.where(self.role_keys[place] == words, place, -1)
        place = np.minimum(np.searchsorted(self.verb_keys, words), len(self.verb_keys) - 1)
        force = np.where(self.verb_keys[place] == words, self.verb_weights[place], 0.0)
        live = np.zeros(piece.n_docs, dtype=bool)
        live[piece.doc[(weight > 0) | (force > 0)]] = True
        out = np.zeros((piece.n_docs, len(PATTERNS) + 1))
        keep = np.flatnonzero(((weight > 0) | (force > 0) | (role >= 0)) & live[piece.doc])
        at, is_open, so_far = piece.quotes
        last = np.searchsorted(at, piece.start[keep], side="right") - 1
        inside, quoted = is_open[last], so_far[last]
        breaks = np.searchsorted(np.flatnonzero(_BREAK[piece.buf]), piece.start[keep])
        for doc, own in zip(*_groups(piece.doc[keep], np.arange(len(keep))), strict=True):
            symbols, before = [], None
            for j in own:
                i = keep[j]
                if before is None:
                    symbols += [("open", 0.0)] * int(inside[j])
                else:
                    ended, turned = breaks[j] > breaks[before], quoted[j] > quoted[before]
                    if i - keep[before] > REACH + 1:
                        symbols.append(("gap", 0.0))
                    if ended:
                        symbols.append(("break", 0.0))
                    # A quote goes on behind the end of a clause.
                    if ended and inside[j] or turned:
                        symbols.append(("open" if inside[j] else "close", 0.0))
                if weight[i] > 0:
                    symbols.append(("insult", weight[i]))
                elif force[i] > 0:
                    symbols.append(("verb", force[i]))
                else:
                    symbols += [(name, 1.0) for name in self.role_names[role[i]]]
                before = j
            for pattern, w in match(symbols):
                out[doc, PATTERNS.index(pattern)] += w
                out[doc, -1] += 1
        return _features(out, piece.counts)


def beginnings(piece: Piece, length: int) -> np.ndarray:
    """The first ``length`` bytes of every word as a number; 0 for shorter words."""
    view = np.ndarray((len(piece.buf) - 7,), dtype="<u8", buffer=piece.buf, strides=(1,))
    return np.where(piece.end - piece.start >= length, view[piece.start] & _MASKS[length], np.uint64(0))


def _groups(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    return doc[first], np.split(values, first[1:]) if len(first) else []


def _features(sums: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Pattern weights, damped, their number against the text's length, and a constant."""
    total, count = sums[:, :-1].sum(axis=1), sums[:, -1]
    size = np.log1p(n_words)
    return np.column_stack(
        [
            np.log1p(sums[:, :-1]),
            np.log1p(count),
            np.log1p(total),
            np.log1p(1000 * total / (n_words + 50)),
            np.log1p(1000 * count / (n_words + 50)),
            size * (count > 0),
            size * np.log1p(total),
            np.minimum(count, 3),
            np.ones(len(sums)),
        ]
    )


def _each(text: pa.Array) -> Iterator[tuple[int, int, Piece]]:
    for lo, hi in pieces(text):
        piece = Piece(text.slice(lo, hi - lo), lower=True)
        piece.quotes = quotes(piece)
        yield lo, hi, piece.split(_WORD)


def _sample(
    documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int
) -> tuple[DataFrame, dict[int, int]]:
    """At most about ``sample`` labelled texts, kept in the shared folder, and how many labels of each kind there are."""
    known = labels.where(named(label).isin(0, 1)).groupBy(named(doc_id).alias("id")).agg(F.max(named(label)).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, sample / 2 / max(1, counts.get(1, 0))).otherwise(sample / 2 / max(1, counts.get(0, 0)))
    picked = known.where(chance(F.col("id")) < share)
    folder = scratch_path(documents.sparkSession, "labelled")
    rows = documents.select(named(doc_id).alias("id"), named(text).alias("text"))
    # The sample has a bound of its own, so its ids may be broadcast.
    rows.join(F.broadcast(picked), "id").write.parquet(folder)
    schema = fields(id=rows.schema["id"].dataType, text="string", y="int")
    return documents.sparkSession.read.schema(schema).parquet(folder), counts


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts hold each word and each beginning, summed over a piece."""
    for batch in batches:
        y = batch.column("y").to_numpy()
        for lo, hi, piece in _each(as_text(batch.column("text"))):
            words = piece.word_hashes()
            for length in [VERB, *LENGTHS]:
                values = words if length < 1 else beginnings(piece, length)
                if length == VERB:
                    values = np.where(_behind_modals(piece, words), values, np.uint64(0))
                pair = np.unique(np.stack([values, piece.doc.astype(np.uint64)]), axis=1) if len(values) else np.zeros((2, 0), np.uint64)
                pair = pair[:, pair[0] != 0]
                keys, at = np.unique(pair[0], return_inverse=True)
                toxic = np.bincount(at, weights=y[lo:hi][pair[1].astype(np.int64)], minlength=len(keys)).astype(np.int64)
                every = np.bincount(at, minlength=len(keys))
                columns = [np.full(len(keys), length, np.int32), keys.view(np.int64), toxic, every - toxic]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "key", "toxic", "clean"])


def _behind_modals(piece: Piece, words: np.ndarray) -> np.ndarray:
    """Which words are one or two places behind a modal and have no role themselves."""
    modal, known = np.isin(words, _hashes(ROLES["modal"].split())), np.isin(words, _hashes(" ".join(ROLES.values()).split()))
    out = np.zeros(len(words), dtype=bool)
    for step in (1, 2):
        out[step:] |= modal[:-step] & (piece.doc[:-step] == piece.doc[step:])
    return out & ~known


def _choose(rows: list, n_toxic: int, n_clean: int) -> list[tuple[int, int, float]]:
    """Entries with their weights, without those that a longer or shorter one makes needless."""
    chosen: list = []
    for row in sorted(rows, key=lambda r: (-r["toxic"], r["clean"], -(r["length"] or 99))):
        key, mask = row["key"] % (1 << 64), (1 << (8 * max(row["length"], 0))) - 1
        nested = [
            c
            for c in chosen
            if row["length"] > 0 and c["length"] > 0 and (c["key"] % (1 << 64)) & mask == key & ((1 << (8 * c["length"])) - 1) & mask
        ]
        if not any(c["toxic"] >= row["toxic"] and c["clean"] <= 1.5 * row["clean"] + 1 for c in nested):
            chosen.append(row)
    return [
        (r["length"], r["key"], math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["clean"] + 0.5) / (n_clean + 1)))
        for r in chosen
    ]


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, piece: Piece) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.lexicon.read(piece) @ self.weights, -30, 30)))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
    lexicon: int = LEXICON,
) -> Model | None:
    """Learn the insults and the patterns' weights; None without labelled texts of both kinds."""
    rows, every = _sample(documents, labels, doc_id, text, label, sample)
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return None
    marks = rows.mapInArrow(_marks, "length int, key long, toxic long, clean long")
    marks = marks.groupBy("length", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p, q = F.col("toxic") / n_toxic, F.col("clean") / n_clean
    both = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / n_toxic + 1 / n_clean) + 1e-12)
    found = marks.withColumn("z", z).where((F.col("z") > 5) & (F.col("toxic") >= 4) & (p > 3 * q))
    entries = _choose(found.orderBy(F.desc("z"), "length", "key").limit(lexicon).collect(), n_toxic, n_clean)
    words = Lexicon(entries)
    held = documents.sparkSession.sparkContext.broadcast(words)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, piece in _each(as_text(batch.column("text"))):
                x = held.value.read(piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), batch.column("y").slice(lo, hi - lo)], ["x", "y"]
                )

    table = rows.mapInArrow(read, "x array<double>, y int").toArrow().to_pydict()
    x, y = np.array(table["x"]), np.array(table["y"])
    # The sample holds more toxic rows than the labels do; rows weigh as many as they stand for.
    stands = np.where(y == 1, every.get(1, 1) / n_toxic, every.get(0, 1) / n_clean)
    return Model(words, fit_logistic(x, y, stands * len(y) / stands.sum(), penalty=1.0))


def score(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``documents`` as struct ``row`` with the score."""
    rows = documents.select(F.struct(*(named(c) for c in documents.columns)).alias("row"), named(text).alias("text"))
    held = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for lo, hi, piece in _each(as_text(batch.column("text"))):
                parts.append(held.value.score(piece) if held.value else np.zeros(hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(parts))], ["row", "score"])

    return rows.mapInArrow(judge, fields(row=rows.schema["row"].dataType, score="double"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four of five folds."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    documents = documents.withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    model = fit(documents.where("NOT held_out"), labels)
    return score(documents, model).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.held_out").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
