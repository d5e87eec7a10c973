"""Toxicity by a weighted finite-state grammar over clauses, with learned emission weights."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import forget, materialize
from ._tok import column, ids

#: Labelled rows that a fit reads at most, by hash of doc_id.
SAMPLE = 20000
STEM_MIN, STEM_MAX = 4, 7

# Fixed word lists of the grammar (English, French, German, Spanish).
THREATS = "kill hurt destroy beat murder shoot strangle burn tuer frapper détruire töten schlagen zerstören matar golpear destruir".split()
TARGETS = "you your yours yourself they them he she him her tu toi vous votre ils elles du dich dir ihr euch sie tú usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never nor neither without isn't aren't wasn't don't ne pas jamais non nicht kein keine nie nunca jamás tampoco".split()
WILLS = "will shall gonna i'll we'll they'll he'll she'll werde werden vais allons voy vamos".split()
MAKERS = "make making made watch faire ferai lasse lassen hacer haré".split()
HARMS = "pay suffer regret bleed scream souffrir regretter saigner leiden bereuen bluten pagar sufrir lamentar sangrar".split()
PARTS = "piece pieces waste bunch load pile sack morceau tas stück haufen pedazo montón".split()
JOINS = "of de von".split()
OBJECTS = "trash garbage crap filth space oxygen ordure merde dreck müll abfall basura mierda".split()
REPORTS = "said says say wrote writes reported reports claimed claims called quoted quote dit disait écrit sagte sagt schrieb behauptet dijo dice escribió".split()

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Bytes that end a clause; bytes of a text that are searched at a time.
STOPS, SLICE = b".!?;\n", 1 << 20
_STOP = np.isin(np.arange(256), list(STOPS))


@dataclass
class Transducer:
    """A deterministic transducer: (state, input) -> (next state, output, factor). An input without an arc goes
    to ``rest`` of the state with itself as output and factor 1."""

    arcs: dict[tuple[object, str], tuple[object, str, float]]
    start: object = 0
    rest: dict[object, object] = field(default_factory=dict)

    def step(self, state: object, symbol: str) -> tuple[object, str, float]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol, 1.0)


#: insult, threat, target, negation, report, other; of patterns of several words: will, maker, harm; part, join, object.
SYMBOLS = "ITYNROWMVPFX"
MARKED = "itjk"  # reported insult and threat, negated insult and threat


def compose(f: Transducer, g: Transducer, symbols: str) -> Transducer:
    """g after f, as one machine over the pairs of states that can be reached; factors multiply."""
    start, arcs = (f.start, g.start), {}
    todo, seen = [start], {start}
    while todo:
        state = todo.pop()
        for x in symbols:
            to_f, mid, w = f.step(state[0], x)
            to_g, out, v = g.step(state[1], mid)
            arcs[state, x] = (to_f, to_g), out, w * v
            if (to_f, to_g) not in seen:
                seen.add((to_f, to_g))
                todo.append((to_f, to_g))
    return Transducer(arcs, start)


def insults() -> Transducer:
    """A part, a join and an object in a row are an insult ("a piece of trash"); an object alone is nothing."""
    m = Transducer({}, 0, {s: 0 for s in (0, 1, 2)})
    for s in (0, 1, 2):
        m.arcs |= {(s, "P"): (1, "O", 1.0), (s, "F"): (2 if s == 1 else 0, "O", 1.0), (s, "X"): (0, "I", 1.0) if s == 2 else (0, "O", 0.0)}
    return m


def threats(reach: int = 3, meant: float = 1.25) -> Transducer:
    """A harm within ``reach`` tokens of a maker is a threat ("make you pay"), alone it is nothing; a threat that soon after a
    will weighs more."""
    wait = [("", 0), *[(k, n) for k in "WM" for n in range(1, reach + 1)]]
    m = Transducer({}, ("", 0), {(k, n): (k, n - 1) if n > 1 else ("", 0) for k, n in wait})
    for k, n in wait:
        m.arcs |= {((k, n), "W"): (("W", reach), "O", 1.0), ((k, n), "M"): (("M", reach), "O", 1.0), ((k, n), "T"): (("", 0), "T", meant if k == "W" else 1.0)}
        m.arcs[(k, n), "V"] = (("", 0), "T", 1.0) if k == "M" else (m.rest[k, n], "O", 0.0)
    return m


def numbered(m: Transducer, symbols: str) -> Transducer:
    """The same machine with numbers as states."""
    names = {s: i for i, s in enumerate(dict.fromkeys([m.start, *(s for s, _ in m.arcs)]))}
    return Transducer({(names[s], x): (names[to], out, w) for (s, x), (to, out, w) in m.arcs.items()}, names[m.start])


@cache
def grammar(reach: int = 3, negated: float = 0.2, reported: float = 0.4, targeted: float = 1.5, threatened: float = 1.5) -> Transducer:
    """Insult, threat, reported speech, negation and target transducers composed.

    Patterns of several words become insults and threats like those of one. After a report word the rest of the clause is reported.
    A negation reaches the next ``reach`` tokens. An insult
    or threat within ``reach`` tokens of a target weighs more, on either side: a target that follows adds the difference
    (as a factor on the target token, whose emission is that of the match). A threat without any target near counts
    less than an insult, with one it counts most."""
    report = Transducer({(0, "R"): (1, "R", 1.0), (1, "I"): (1, "i", reported), (1, "T"): (1, "t", reported)})
    negate = Transducer({(s, "N"): (reach, "N", 1.0) for s in range(reach + 1)}, 0, {s: max(0, s - 1) for s in range(reach + 1)})
    for s in range(1, reach + 1):
        for x, y in zip("ITit", "jkjk", strict=True):
            negate.arcs[s, x] = (s - 1, y, negated)
    # states: tokens that a target still reaches, tokens that a match without a target still waits for one, and its kind
    alone = 0.5
    after = {"I": targeted - 1, "T": targeted / alone - 1}
    target = Transducer({}, (0, 0, ""))
    for a in range(reach + 1):
        for b, kind in [(0, ""), *[(b, k) for b in range(1, reach + 1) for k in "IT"]]:
            state, less = (a, b, kind), (max(0, b - 1), kind if b > 1 else "")
            target.rest[state] = (max(0, a - 1), *less)
            target.arcs[state, "Y"] = (reach, 0, ""), "+" if b else "Y", after[kind] if b else 1.0
            for x in "Iij":
                target.arcs[state, x] = (max(0, a - 1), 0, "") if a else (0, reach, "I"), x, targeted if a else 1.0
            for x in "Ttk":
                target.arcs[state, x] = (max(0, a - 1), 0, "") if a else (0, reach, "T"), x, threatened * (targeted if a else alone)
    machine = insults()
    for follower in (threats(reach), report, negate, target):
        machine = compose(machine, follower, SYMBOLS)
    return numbered(machine, SYMBOLS)


@dataclass
class ToxicityModel:
    stems: dict[str, float]
    words: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.array([-2.0, 1.0, 1.0, 0.0]))

    def __post_init__(self) -> None:
        lists = ((JOINS, "F"), (PARTS, "P"), (MAKERS, "M"), (WILLS, "W"), (TARGETS, "Y"), (REPORTS, "R"), (NEGATIONS, "N"))
        self.fixed = {w: symbol for words, symbol in lists for w in words}
        self.threats = {w: 2.0 for w in THREATS}
        # what completes a pattern: its weight counts if the machine lets it
        self.ends = {w: ("V", 2.0) for w in HARMS} | {w: ("X", 3.0) for w in OBJECTS}
        # words that can start a match, by their first four bytes in lower case; those beyond ASCII are not looked up
        self.heads, self.short = np.zeros(1 << 16, bool), np.zeros((2, 1 << 16), bool)
        for w in [*self.stems, *self.words, *self.threats, *self.ends]:
            raw = bytes(x | 0x20 for x in w.encode()[:4])
            if not w or max(raw) >= 128:
                continue
            if len(raw) < 3:  # whole words of one and two bytes
                self.short[len(raw) - 1, raw[0] << 8 | (raw[1] if len(raw) > 1 else 0)] = True
                continue
            # a word of three bytes can be followed by anything
            four = np.array([[*raw, *[x] * (4 - len(raw))] for x in (range(256) if len(raw) == 3 else [0])], np.uint8).T
            self.heads[_slot(four)] = True

    def emission(self, word: str) -> tuple[str, float]:
        """The symbol of a lower-case word, and its weight."""
        if word in self.fixed:
            return self.fixed[word], 0.0
        if word in self.threats:
            return "T", self.threats[word]
        if word in self.words:
            return "I", self.words[word]
        for n in range(STEM_MIN, min(STEM_MAX, len(word)) + 1):
            if (w := self.stems.get(word[:n])) is not None:
                return "I", w
        return self.ends.get(word, ("O", 0.0))

    def clause(self, text: str) -> float:
        """The score of one clause: emission times the grammar's factor, summed along its path."""
        machine = grammar()  # made once in each process, not sent to it
        state, total, last = machine.start, 0.0, 0.0
        for match in TOKEN.finditer(text.lower()):
            word = match.group()
            symbol, weight = self.emission(word)
            state, out, factor = machine.step(state, symbol)
            if weight and factor:
                last = weight * factor
                total += last
            elif out == "+":
                total += last * factor
        return total


def _slot(four: np.ndarray) -> np.ndarray:
    """16-bit number of four lower-case bytes (rows of a 4 x n array)."""
    x = four.astype(np.uint32)
    return (((x[0] << np.uint32(24)) | (x[1] << np.uint32(16)) | (x[2] << np.uint32(8)) | x[3]) * np.uint32(2654435761)) >> np.uint32(16)


def _can_match(model: ToxicityModel, folded: np.ndarray, goes_on: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which places can start a match: all that have a character beyond ASCII in four bytes (its class and its lower case
    are left to ``clause``), else those in the model's tables."""
    four = np.stack([folded[starts + j] for j in range(4)])
    found = model.heads[_slot(four)] | (four >= 128).any(axis=0)
    x, y = four[0].astype(np.int64) << 8, four[1].astype(np.int64)
    return found | (model.short[0][x] & ~goes_on[starts + 1]) | (model.short[1][x | y] & ~goes_on[starts + 2])


def _hits(b: np.ndarray, offsets: np.ndarray, model: ToxicityModel) -> np.ndarray:
    """The places of a chunk where a match can start, found in slices of SLICE bytes."""
    found = []
    for lo in range(0, len(b), SLICE):
        back = min(lo, 1)
        x = b[lo - back : lo + SLICE + 3]
        x = np.concatenate([x, np.full(4, 32, np.uint8)])  # room to look four bytes ahead
        rows = offsets[np.searchsorted(offsets, lo - back) : np.searchsorted(offsets, lo - back + len(x) - 4)] - (lo - back)
        low = x | np.uint8(0x20)
        letter = (low >= 97) & (low <= 122)
        goes_on = letter.copy()
        goes_on[rows] = False
        # a word can start at each character beyond ASCII, and at a letter after anything but an ASCII letter
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        first[rows] = letter[rows]
        first |= x >= 0xC0
        starts = np.flatnonzero(first[back : back + min(SLICE, len(b) - lo)]) + back
        if len(starts):
            found.append(starts[_can_match(model, np.where(x < 128, low, x), goes_on, starts)] + lo - back)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def clause_features(batch: pa.RecordBatch, model: ToxicityModel) -> np.ndarray:
    """For each row: 1, log of the sum of clause scores, log of the best clause, log of matched clauses per 1,000 bytes.
    Clauses end at the bytes of STOPS, and only those with a place where a match can start are scored. The borders of
    all are found at once, so a text takes time in proportion to its length."""
    data, offsets = column(batch, "text")
    out = np.zeros((batch.num_rows, 4))
    out[:, 0] = 1
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), side="right")) - 1)
        offs = offsets[lo : hi + 1] - offsets[lo]
        b = data[offsets[lo] : offsets[hi]]
        hits = _hits(b, offs, model)
        if len(hits):
            stops = np.flatnonzero(_STOP[b])
            starts = np.union1d(offs[:-1], stops + 1)
            starts = starts[np.unique(np.searchsorted(starts, hits, side="right") - 1)]
            row = np.searchsorted(offs, starts, side="right") - 1
            ends = np.minimum(np.append(stops, len(b))[np.searchsorted(stops, starts)], offs[row + 1])
            scores = np.array([model.clause(b[i:j].tobytes().decode(errors="replace")) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)])
            row, scores = row[scores != 0], scores[scores != 0]
            some, first = np.unique(row, return_index=True)
            if len(some):
                size = offs[some + 1] - offs[some]
                many = np.diff(np.append(first, len(row)))
                out[lo + some, 1:] = np.log1p(np.stack([np.add.reduceat(scores, first), np.maximum.reduceat(scores, first), 1000 * many / size], axis=1))
        lo = hi
    return out


def _keys(text: str) -> set[str]:
    """The distinct words (with a mark) and stems of a text."""
    out = set()
    for w in set(TOKEN.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:n] for n in range(STEM_MIN, min(STEM_MAX, len(w)) + 1))
    return out


def _counted(only: frozenset[str] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c: Counter = Counter()
            for t in ids(batch, "text").to_pylist():
                c.update(k for k in _keys(t or "") if only is None or k in only)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["key", "n"])

    return run


def _lexicon(spark: SparkSession, sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Stems and words that occur in far more toxic documents than others (log-likelihood ratio and log odds)."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}, {}
    count = lambda label, only: sample.where(F.col("toxic") == label).select("text").mapInArrow(_counted(only), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # a key in that share of the toxic sample: their number is bounded by a document's words over the share
    least = max(4, bad // 250)
    seen = {r["key"]: r["n"] for r in count(1, None).where(F.col("n") >= least).collect()}
    clean = {r["key"]: r["n"] for r in count(0, frozenset(seen)).collect()}
    need = 2 * math.log(len(seen) + 1) + 6
    found: dict[str, tuple[float, float]] = {}
    for k, a in seen.items():
        b = clean.get(k, 0)
        odds = math.log((a + 0.5) / (bad - a + 0.5)) - math.log((b + 0.5) / (good - b + 0.5))
        p, q = a / bad, (a + b) / (bad + good)
        ratio = 2 * (a * math.log(p / q) + (b * math.log((b / good) / q) if b else 0))
        if odds >= 3.5 and ratio >= need:
            found[k] = odds, ratio
    stems, words = {}, {}
    for k, (odds, _) in sorted(found.items(), key=lambda x: (len(x[0]), x[0])):
        base = k.removesuffix("$")
        held = max((stems[base[:m]] for m in range(STEM_MIN, len(base) + 1) if base[:m] in stems), default=None)
        if held is None or odds > held + 1:
            (words if k.endswith("$") else stems)[base] = odds
    return stems, words


def _labelled_features(model: ToxicityModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = clause_features(batch, model)
            yield pa.RecordBatch.from_arrays([ids(batch, "toxic"), *[pa.array(x[:, j]) for j in range(1, 4)]], ["toxic", "a", "b", "c"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; a ridge keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) / 100 * np.eye(len(w)) + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * len(y) / 100 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn the insult lexicon and the calibration from up to ``sample`` labelled documents (doc_id, toxic 0 or 1;
    null labels are left out, of several the largest counts; of texts that share a doc_id the one with the smallest hash
    counts, and equal texts of one label count once). Without both labels the lexicon is empty and the score rests on
    the threats and the patterns."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of 12 bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = materialize(spark, rows.select("text", "toxic").distinct(), "labelled")
    model = ToxicityModel(*_lexicon(spark, rows))
    got = rows.mapInArrow(_labelled_features(model), "toxic int, a double, b double, c double").groupBy("toxic", "a", "b", "c").count().collect()
    forget(spark, rows)
    y = np.array([r["toxic"] for r in got], dtype=float)
    if 0 < y.sum() < len(y):
        times = np.array([r["count"] for r in got])
        x = np.repeat(np.array([[1, r["a"], r["b"], r["c"]] for r in got]), times, axis=0)
        model.weights = _logistic(x, np.repeat(y, times))
    return model


def _score(model: ToxicityModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = clause_features(batch, model)
            s = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([ids(batch), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not read): doc_id, score, predicted (score >= 0.5, so
    a score of one half is). Null, empty and very long texts are scored whole; a text without a match gets the base score.
    Equal texts get equal scores, and repeated rows stay. An empty table gives an empty result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double, predicted int")


def held_out(doc_id: F.Column | str = "doc_id") -> F.Column:
    """crc32 of the doc_id as text leaves remainder 0 by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
