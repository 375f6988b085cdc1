"""Toxicity by a weighted finite-state pattern grammar.

A transducer reads symbols and writes them on, with marks; composed(), one reads what the
other writes. The grammar of a clause is the composition of

* lexical: word -> class symbol with a weight. Insults come from a seed list and
  from labelled rows (words and word beginnings whose log-odds of standing in a
  toxic text are high); threats, targets, negation and reported speech are seed
  lists;
* negation: marks the ``REACH`` symbols after a negation;
* reported speech: marks what follows its cue up to the clause's end;
* target: marks the ``REACH`` symbols after a target;
* aim: an insult or threat that no target stands before waits ``REACH`` symbols for one (the
  latest, where several wait), which is then marked with it;
* weight: an insult weighs what its word does, a threat only with a target; a target that
  is marked weighs too; negation and reported speech weaken.

The composition is compiled into one table of states and symbols, and a text is one run
through it. The weights of a clause add up with falling gain at its end, so clauses are
scored, not words.

A text's score is a logistic function of its strongest clause, the sum over its
clauses (logarithmic) and the number of matched clauses; its coefficients are
fitted out of fold, so that words learned from a row do not vouch for that row.

Learning takes a bounded sample: the ``sample`` labelled rows with the smallest
hash of their id. Scoring reads every whole text, once, without a shuffle.

Defined cases: null and empty texts match nothing and get the score of no match;
unlabelled or null labels are not learned from; with no labelled rows, or labels
of one kind only, seed words decide; repeated rows are scored alike.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seed words in four languages.
INSULTS = """idiot idiots moron morons stupid loser losers scum worthless pathetic disgusting trash clown imbecile dumb
filthy vermin connard connasse imbécile salaud crétin abruti ordure dummkopf arschloch abschaum trottel widerlich
estúpido estúpida imbécil basura asqueroso tonto tonta escoria""".split()
THREATS = """kill hurt destroy beat stab shoot tuer frapper détruire töten schlagen vernichten umbringen matar golpear
destruir""".split()
TARGETS = """you your yourself he she they them him her tu toi vous ton ta votre ils elles du dich dir ihr euch sie tú
usted ustedes ellos ellas vosotros""".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't pas jamais nicht kein keine nie nunca jamás ni".split()
REPORTS = """said says say claimed called quoted reported wrote allegedly dit disait écrit déclaré sagte schrieb
behauptete dijo escribió llamó según laut selon""".split()

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, END = SYMBOLS = range(7)
NEGATED, REPORTED, AIMED = "negated", "reported", "aimed"
SEED_WEIGHT = 4.0
REACH = 4
TARGET_GAIN, NEGATION_GAIN, REPORT_GAIN = 1.25, 0.4, 0.6
EDGES = "\"'`()[]{}<>*_«»„“”‘’,.!?;:|…$%&#~=+-"
CLAUSE_ENDS = frozenset(".!?;…")
PREFIXES = range(3, 9)
REMEMBERED = 500_000
LEAST_WEIGHT = 2.0
SAMPLE = 8_000


def bare(word: str) -> str:
    return word.strip(EDGES)


def words_of(text: str) -> list[str]:
    """Lower-case words; a line's end is a word that ends a clause."""
    return text.lower().replace("\n", " . ").split()


@dataclass
class Lexicon:
    """The lexical transducer: words first, then the heaviest beginning."""

    words: dict[str, tuple[int, float]] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def symbol(self, word: str) -> tuple[int, float, bool]:
        """Class, weight and whether the word ends a clause."""
        ends = word[-1] in CLAUSE_ENDS
        w = bare(word)
        kind, weight = self.words.get(w, (NONE, 0.0))
        if kind in (NONE, INSULT) and len(w) >= PREFIXES[0]:
            best = max((self.stems.get(w[:k], 0.0) for k in PREFIXES if k <= len(w)), default=0.0)
            if best > weight:
                kind, weight = INSULT, best
        return kind, weight, ends


def seed_lexicon() -> Lexicon:
    words = {w: (REPORT, 0.0) for w in REPORTS} | {w: (NEGATION, 0.0) for w in NEGATIONS} | {w: (TARGET, 0.0) for w in TARGETS}
    return Lexicon(words | {w: (THREAT, 0.0) for w in THREATS} | {w: (INSULT, SEED_WEIGHT) for w in INSULTS})


@dataclass(frozen=True)
class Transducer:
    """Deterministic. step takes a state and what is read to the next state and what is written."""

    start: Hashable
    step: Callable[[Hashable, Any], tuple[Hashable, Any]]


def composed(first: Transducer, second: Transducer) -> Transducer:
    """second reads what first writes."""

    def step(state, read):
        a, between = first.step(state[0], read)
        b, written = second.step(state[1], between)
        return (a, b), written

    return Transducer((first.start, second.start), step)


# All but the last write (symbol, marks) for (symbol, marks).


def marker(cue: int, mark: str, reach: int | None) -> Transducer:
    """Marks the reach symbols after cue, or all up to the clause's end."""

    def step(left, read):
        symbol, marks = read
        written = (symbol, marks | {mark}) if left else read
        if symbol == END:
            return 0, written
        if symbol == cue:
            return reach or 1, written
        return (left if reach is None else max(left - 1, 0)), written

    return Transducer(0, step)


def aim(reach: int) -> Transducer:
    """Marks a target with the match (kind, its marks) that waits for it. State: the match and how many symbols it still waits."""

    def step(state, read):
        symbol, marks = read
        match, left = state
        if symbol == END:
            return (None, 0), read
        if symbol in (INSULT, THREAT) and AIMED not in marks:
            return ((symbol, marks), reach), read
        if symbol == TARGET and match:
            return (None, 0), (symbol, marks | {match})
        return ((match, left - 1) if left > 1 else (None, 0)), read

    return Transducer((None, 0), step)


def gain(marks: frozenset) -> float:
    return (NEGATION_GAIN if NEGATED in marks else 1.0) * (REPORT_GAIN if REPORTED in marks else 1.0)


def weigher() -> Transducer:
    """Writes (factor of the word's own weight, weight besides)."""

    def step(_, read):
        symbol, marks = read
        if symbol == INSULT:
            return 0, (gain(marks) * (TARGET_GAIN if AIMED in marks else 1.0), 0.0)
        if symbol == THREAT and AIMED in marks:
            return 0, (0.0, SEED_WEIGHT * gain(marks))
        if symbol == TARGET:
            for kind, own in (m for m in marks if isinstance(m, tuple)):
                return 0, (0.0, SEED_WEIGHT * gain(own) * (TARGET_GAIN - 1 if kind == INSULT else 1.0))
        return 0, (0.0, 0.0)

    return Transducer(0, step)


def grammar_parts(reach: int = REACH) -> Transducer:
    parts = [marker(NEGATION, NEGATED, reach), marker(REPORT, REPORTED, None), marker(TARGET, AIMED, reach), aim(reach), weigher()]
    return reduce(composed, parts)


@lru_cache(maxsize=4)
def compiled(reach: int = REACH) -> tuple[list[list[int]], list[list[tuple[float, float]]]]:
    """The states that can be reached, as two tables: next state and what is written, by state and symbol."""
    machine = grammar_parts(reach)
    place, todo, after, written = {machine.start: 0}, [machine.start], [], []
    for state in todo:  # grows
        after.append([])
        written.append([])
        for symbol in SYMBOLS:
            new, out = machine.step(state, (symbol, frozenset()))
            if new not in place:
                place[new] = len(place)
                todo.append(new)
            after[-1].append(place[new])
            written[-1].append(out)
    return after, written


class Grammar:
    """Runs the compiled grammar over texts; remembers the symbols of words it has seen."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}
        self.after, self.written = compiled()

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses with a match, in order."""
        if not text:
            return []
        words, known = words_of(text), self.known
        fresh = set(words).difference(known)
        if fresh:
            if len(known) > REMEMBERED:
                known.clear()
                fresh = set(words)
            for w in fresh:
                known[w] = self.lexicon.symbol(w)
        symbols = [known[w] for w in words]
        if not any(s[1] > 0 or s[0] == THREAT for s in symbols):
            return []
        return self.run(symbols)

    def run(self, symbols: list[tuple[int, float, bool]]) -> list[float]:
        """symbols: class, weight, and whether the clause ends after it."""
        after, written, state, matches, out = self.after, self.written, 0, [], []
        for kind, weight, ends in [*symbols, (NONE, 0.0, True)]:
            factor, more = written[state][kind]
            state = after[state][kind]
            if factor or more:
                matches.append(factor * weight + more)
            if ends:
                state = after[state][END]
                if matches:
                    out.append(sum(x * 0.6**i for i, x in enumerate(sorted(matches, reverse=True))))
                    matches = []
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        c = self.clauses(text)
        return (max(c), math.log1p(sum(c)), math.log1p(len(c))) if c else (0.0, 0.0, 0.0)


def learn_lexicon(texts: list[str], toxic: np.ndarray, least: int = 3) -> Lexicon:
    """Seeds and what the labels show: terms that stand in toxic texts far more often than in others."""
    bad_words, bad_stems, ok_words, ok_stems = Counter(), Counter(), Counter(), Counter()

    def terms(text: str) -> tuple[set[str], set[str]]:
        own = {bare(w) for w in words_of(text)}
        return own, {w[:k] for w in own for k in PREFIXES if k <= len(w)}

    for text, y in zip(texts, toxic):
        if y:
            own, stems = terms(text)
            bad_words.update(own)
            bad_stems.update(stems)
    words = {w for w, n in bad_words.items() if n >= least and len(w) >= 2}
    starts = {w for w, n in bad_stems.items() if n >= 2 * least}
    for text, y in zip(texts, toxic):
        if not y:
            own, stems = terms(text)
            ok_words.update(own & words)
            ok_stems.update(stems & starts)
    n_bad, n_ok = max(1, int(toxic.sum())), max(1, int(len(toxic) - toxic.sum()))
    lexicon = seed_lexicon()
    weight = lambda bad, ok: math.log((bad - 0.5) / n_bad) - math.log((ok + 0.5) / n_ok)
    for w in words:
        kind, seeded = lexicon.words.get(w, (INSULT, 0.0))
        learned = weight(bad_words[w], ok_words[w])
        if kind == INSULT and learned >= LEAST_WEIGHT:
            lexicon.words[w] = (INSULT, max(learned, seeded))
    lexicon.stems = {w: x for w in starts if (x := weight(bad_stems[w], ok_stems[w])) >= LEAST_WEIGHT}
    return lexicon


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + penalty, a.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    coefficients: list[float]

    def scorer(self):
        grammar, b = Grammar(self.lexicon), self.coefficients

        def score(text: str | None) -> float:
            z = b[0] + sum(c * f for c, f in zip(b[1:], grammar.features(text)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


#: Without labels: a clause with one seed insult scores above 0.7.
UNLEARNED = [-4.0, 1.0, 1.0, 0.0]


def learn(texts: list[str], toxic: np.ndarray, folds: int = 4) -> ToxicityModel:
    texts = [t or "" for t in texts]
    if len(set(toxic.tolist())) < 2:
        return ToxicityModel(seed_lexicon(), UNLEARNED)
    fold = np.array([zlib.crc32(t.encode()) % folds for t in texts])  # copies fall into one fold
    x = np.zeros((len(texts), 3))
    for k in range(folds):
        rest = fold != k
        g = Grammar(learn_lexicon([t for t, r in zip(texts, rest) if r], toxic[rest]))
        for i in np.flatnonzero(~rest):
            x[i] = g.features(texts[i])
    return ToxicityModel(learn_lexicon(texts, toxic), fit_logistic(x, toxic.astype(float)).tolist())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, sample: int, id_col: str, text_col: str):
    """At most sample labelled rows: those with the smallest hash of their id, and of rows that repeat an id one."""
    ids = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learnable)
    ids = ids.groupBy(id_col).agg(F.max(label).cast("int").alias("__y"))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    return docs.select(id_col, text_col).join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.min(text_col).alias(text_col), F.max("__y").alias("__y")).orderBy(id_col)


def learn_from(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", learnable: Column | None = None, sample: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text",
) -> ToxicityModel:
    learnable = F.lit(True) if learnable is None else learnable
    rows = labelled_sample(docs, labels, label, learnable, sample, id_col, text_col).toPandas()
    return learn(rows[text_col].tolist(), rows["__y"].to_numpy(dtype=np.int64))


def score_texts(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs[id_col] and score, in one pass."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            s = [score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "score"])

    out = rows.mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below least, with their columns as they were."""
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t.as_py()) < least for t in b.column(place)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
