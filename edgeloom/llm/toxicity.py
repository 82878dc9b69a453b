"""Toxicity by a weighted finite-state grammar over clauses.

A clause is read as symbols: insult terms, threat words, words that address someone, negators,
verbs of reporting, quote marks, other words.  Five transducers over these symbols are
composed into one machine, which scores a clause by the weight of its best path:

* *insult*: an insult term is matched, with the term's weight, or passed over.  Terms are whole words
  or stems, learned from labelled rows with log-odds weights.
* *threat*: the same for the fixed threat words, which weigh as much as the heaviest term.
* *negation*: a match within ``NEGATION_SPAN`` words after a negator loses ``NEGATED``.
* *speech*: a match after both a verb of reporting and a quote mark loses ``REPORTED``.
* *target*: guesses at the start whether the clause addresses someone.  A path that says so gains
  ``TARGETED`` on each match, and is accepted only if a word of address came; on any other path a
  threat can't be matched.

Weights are added along a path (the max-plus semiring) and an arc's weight is a constant, plus
the word's own weight where it is matched.  A text's weight is the sum over its clauses, and a
logistic curve fitted to the labelled rows maps it to a score.  An automaton of all terms finds the clauses to
walk; a single word is never scored without its clause.  Reading is linear in the text.

Null and empty texts have weight 0 and the score of an unmatched text.  Whole
texts are read.  Without labelled rows, or in an empty table, the lexicon is empty and every
score is the prior.  Rows are independent: repeated rows and ids give repeated rows.  Columns that
aren't named are not read, so their names may clash with any.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, reduce
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.shared import fold, lean, materialize, thinned

# The closed word classes of the grammar, in four languages.
THREATS = frozenset("kill hurt destroy beat stab shoot töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your he she they them people du ihr euch sie dich tu vous toi te tú vosotros usted ustedes".split())
NEGATORS = frozenset("not never no n't nicht kein keine nie ne pas jamais nunca jamás".split())
SPEECH = frozenset("said says wrote quoted claimed sagte sagt schrieb dit écrit dijo dice escribió".split())

NEGATION_SPAN, NEGATED, REPORTED, TARGETED = 2, 2.0, 2.0, 1.0
CLAUSE_ENDS = ".!?;\n"
CLAUSE_END = re.compile(r"[.!?;\n]")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”„«»:]")
STEM_LENGTHS = range(3, 11)
EXPLANATIONS = 2

# Symbols of a clause; the last two are what the insult and threat transducers write for a match.
OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTING, QUOTE, INSULTED, THREATENED = "other", "insult", "threat", "target", "negator", "reporting", "quote", "insulted", "threatened"
WORDS = (OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTING)
MATCHED = (INSULTED, THREATENED)


class Arc(NamedTuple):
    """An arc's symbols, its weight ``constant + own * (the read word's own weight)``, and where it leads."""

    reads: str
    writes: str
    constant: float
    own: int
    to: int


@dataclass
class Transducer:
    starts: frozenset[int]
    finals: frozenset[int]
    arcs: dict[int, list[Arc]]


def passing(to: int, *but: str) -> list[Arc]:
    """Arcs that write what they read, without weight, of all symbols but some."""
    return [Arc(s, s, 0.0, 0, to) for s in (*WORDS, QUOTE, *MATCHED) if s not in but]


def matcher(symbol: str, mark: str) -> Transducer:
    """Matches a symbol with the word's own weight, or passes over it."""
    return Transducer(frozenset({0}), frozenset({0}), {0: [*passing(0, symbol), Arc(symbol, mark, 0.0, 1, 0), Arc(symbol, OTHER, 0.0, 0, 0)]})


def negation() -> Transducer:
    """State k: k more words are negated."""
    arcs = {}
    for k in range(NEGATION_SPAN + 1):
        after = max(0, k - 1)
        lost = -NEGATED if k else 0.0
        arcs[k] = [*passing(after, NEGATOR, QUOTE, *MATCHED), Arc(NEGATOR, NEGATOR, 0.0, 0, NEGATION_SPAN), Arc(QUOTE, QUOTE, 0.0, 0, k), *(Arc(m, m, lost, 0, after) for m in MATCHED)]
    return Transducer(frozenset({0}), frozenset(arcs), arcs)


def speech() -> Transducer:
    """State 1: a verb of reporting came; 2: a quote mark did; 3: both did."""
    arcs = {}
    for k in range(4):
        lost = -REPORTED if k == 3 else 0.0
        arcs[k] = [*passing(k, REPORTING, QUOTE, *MATCHED), Arc(REPORTING, REPORTING, 0.0, 0, k | 1), Arc(QUOTE, QUOTE, 0.0, 0, k | 2), *(Arc(m, m, lost, 0, k) for m in MATCHED)]
    return Transducer(frozenset({0}), frozenset(arcs), arcs)


def target() -> Transducer:
    """State 0: nobody is addressed; 1: somebody will be; 2: somebody has been."""
    told = [Arc(m, m, TARGETED, 0, -1) for m in MATCHED]
    arcs = {
        0: passing(0, THREATENED),
        1: [*passing(1, TARGET, *MATCHED), Arc(TARGET, TARGET, 0.0, 0, 2), *(a._replace(to=1) for a in told)],
        2: [*passing(2, *MATCHED), *(a._replace(to=2) for a in told)],
    }
    return Transducer(frozenset({0, 1}), frozenset({0, 2}), arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what ``first`` writes to ``second``, of the states that can be reached."""
    number: dict[tuple[int, int], int] = {}
    todo = [(a, b) for a in sorted(first.starts) for b in sorted(second.starts)]
    for pair in todo:
        number[pair] = len(number)
    starts = frozenset(number.values())
    arcs: dict[int, list[Arc]] = {}
    for a, b in todo:  # grows while it is walked
        out = arcs[number[a, b]] = []
        for x in first.arcs[a]:
            for y in second.arcs[b]:
                if x.writes == y.reads:
                    pair = (x.to, y.to)
                    if pair not in number:
                        number[pair] = len(number)
                        todo.append(pair)
                    out.append(Arc(x.reads, y.writes, x.constant + y.constant, x.own + y.own, number[pair]))
    return Transducer(starts, frozenset(n for (a, b), n in number.items() if a in first.finals and b in second.finals), arcs)


def chain() -> list[Transducer]:
    return [matcher(INSULT, INSULTED), matcher(THREAT, THREATENED), negation(), speech(), target()]


@cache
def machine() -> tuple[frozenset[int], frozenset[int], dict[tuple[int, str], tuple[tuple[float, int, int], ...]]]:
    """Starts, finals and, by state and symbol, the arcs of the composed grammar; of arcs that differ in their constants the best."""
    whole = reduce(compose, chain())
    table: dict[tuple[int, str], dict[tuple[int, int], float]] = defaultdict(dict)
    for state, arcs in whole.arcs.items():
        for a in arcs:
            here = table[state, a.reads]
            here[a.own, a.to] = max(here.get((a.own, a.to), -math.inf), a.constant)
    return whole.starts, whole.finals, {k: tuple((constant, own, to) for (own, to), constant in v.items()) for k, v in table.items()}


def best_path(clause: Iterable[tuple[str, float]]) -> float:
    """The weight of the best accepted path over a clause's (symbol, weight) pairs."""
    starts, finals, table = machine()
    now = dict.fromkeys(starts, 0.0)
    for symbol, weight in clause:
        after: dict[int, float] = {}
        for state, sum_ in now.items():
            for constant, own, to in table.get((state, symbol), ()):
                more = sum_ + constant + own * weight
                if more > after.get(to, -math.inf):
                    after[to] = more
        now = after
    return max((w for state, w in now.items() if state in finals), default=0.0)


@dataclass
class Grammar:
    """Learned terms and their weights: ``whole`` words and ``stems``; score = 1 / (1 + exp(-(slope * weight + bias)))."""

    whole: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    bias: float = -2.2

    def finder(self) -> ahocorasick.Automaton:
        """Finds where a term or a threat may stand; only there a clause is walked."""
        out = ahocorasick.Automaton()
        for w in {*self.whole, *THREATS}:
            out.add_word(w, (len(w), True))
        for w in self.stems:
            out.add_word(w, (len(w), False))
        out.make_automaton()
        return out

    def symbol(self, word: str) -> tuple[str, float]:
        """The word's symbol and its own weight."""
        own = max([self.whole.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if n <= len(word))])
        if word in THREATS:
            return THREAT, max([own, *self.whole.values()] or [1.0]) or 1.0
        if own:
            return INSULT, own
        if word in TARGETS:
            return TARGET, 0.0
        if word in NEGATORS or word.endswith(("n't", "n’t")):
            return NEGATOR, 0.0
        return (REPORTING if word in SPEECH else OTHER), 0.0

    def clause(self, text: str) -> float:
        """The weight of a lower-cased clause."""
        return best_path(self.symbol(t) if t[0].isalnum() else (QUOTE, 0.0) for t in TOKEN.findall(text))

    def weigh(self, text: str | None, finder: ahocorasick.Automaton) -> float:
        if not text:
            return 0.0
        low = text.lower()
        total, done = 0.0, 0
        for last, (n, whole) in finder.iter(low):
            first = last - n + 1
            if first < done or (first and low[first - 1].isalnum()) or (whole and low[last + 1 : last + 2].isalnum()):
                continue
            begin = max(done, *(low.rfind(c, done, first) + 1 for c in CLAUSE_ENDS))
            end = CLAUSE_END.search(low, first)
            done = end.start() if end else len(low)
            total += self.clause(low[begin:done])
        return total

    def score(self, weight: float) -> float:
        z = self.slope * weight + self.bias
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def candidates(text: str) -> set[str]:
    """What a text could teach: its words (marked ``$``) and their stems."""
    out: set[str] = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:i] for i in STEM_LENGTHS if i <= len(w))
    return out


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 8000, min_docs: int = 3, min_precision: float = 0.75) -> Grammar:
    """Fit the grammar on about ``sample_rows`` labelled documents, chosen by a hash of doc_id.

    ``docs`` and ``labels`` hold only rows that may be learned from; of a repeated doc_id the
    least text is used.  A term must occur in ``min_docs`` toxic sample documents and be toxic in
    ``min_precision`` of all of its.  Terms are chosen greedily, by the toxic documents that they explain times
    their log-odds; a document counts until ``EXPLANATIONS`` terms explain it, so the sample bounds the terms.
    Of equals the longest is taken.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    total = marks.count()
    if not total:
        return Grammar()
    chosen = marks.filter(thinned("doc_id", total, sample_rows))  # bounded by sample_rows, so it may be broadcast
    sample = docs.filter("doc_id is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialize(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("_toxic")), "labelled-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, toxic = Counter(), Counter()
        for batch in batches:
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                (toxic if mark == 1 else clean).update(candidates(text))
        both = list({*clean, *toxic})
        for i in range(0, len(both), 50_000):
            part = both[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[x] for x in part]), pa.array([clean[x] for x in part])], names=["term", "toxic", "clean"])

    terms = sample.select("text", "_toxic").mapInArrow(lean(counted), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = terms.filter((F.col("toxic") >= min_docs) & (F.col("toxic") >= min_precision * (F.col("toxic") + F.col("clean"))))
    totals = {r["_toxic"]: r["count"] for r in sample.groupBy("_toxic").count().toLocalIterator()}
    base = math.log((totals.get(1, 0) + 1) / (sum(totals.values()) - totals.get(1, 0) + 1))
    found = {r.term: math.log((r.toxic + 0.5) / (r.clean + 0.5)) - base for r in good.toLocalIterator()}
    known = docs.sparkSession.sparkContext.broadcast(frozenset(found))

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sorted(candidates(t) & known.value) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))], names=["doc_id", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.filter("_toxic = 1").select("doc_id", "text").mapInArrow(lean(incidence), f"doc_id {kind}, terms array<string>").toLocalIterator()
    grammar = Grammar(*cover(((i, r.terms) for i, r in enumerate(rows)), found, min_docs))
    fit(grammar, sample)
    return grammar


def cover(rows: Iterable[tuple[int, list[str]]], found: dict[str, float], min_docs: int) -> tuple[dict[str, float], dict[str, float]]:
    """Greedy choice of terms over the toxic sample documents; gives whole words and stems with log-odds weights."""
    explains: dict[str, list[int]] = defaultdict(list)
    for i, terms in rows:
        for t in terms:
            explains[t].append(i)
    whole: dict[str, float] = {}
    stems: dict[str, float] = {}
    wanted: dict[int, int] = defaultdict(lambda: EXPLANATIONS)
    chosen: set[str] = set()
    begun: set[str] = set()  # all beginnings of chosen terms
    heap = [(-len(s) * found[t], -len(t), t) for t, s in explains.items()]
    heapq.heapify(heap)
    while heap:
        bound, size, t = heapq.heappop(heap)
        bare = t.rstrip("$")
        if bare in begun or any(bare[:n] in chosen for n in range(1, len(bare) + 1)):
            continue  # a second form of a chosen term explains nothing more
        left = sum(wanted[i] > 0 for i in explains[t])
        if left < min_docs or found[t] <= 0:
            continue
        if -left * found[t] > bound:  # explains less than when it was put here
            heapq.heappush(heap, (-left * found[t], size, t))
            continue
        (whole if t[-1] == "$" else stems)[bare] = found[t]
        chosen.add(bare)
        begun.update(bare[:n] for n in range(1, len(bare) + 1))
        for i in explains[t]:
            wanted[i] -= 1
    return whole, stems


def fit(grammar: Grammar, sample: DataFrame, rounds: int = 60, ridge: float = 0.02) -> None:
    """Slope and bias of the logistic curve, by Newton steps on the sample's (weight, label) counts."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = grammar.finder()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([round(grammar.weigh(t, finder), 1) for t in batch.column("text").to_pylist()], pa.float64()), pa.array([int(x == 1) for x in batch.column("_toxic").to_pylist()], pa.int64())], names=["w", "y"])

    rows = [(r.w, r.y, r.n) for r in sample.select("text", "_toxic").mapInArrow(lean(weighed), "w double, y long").groupBy("w", "y").agg(F.count("*").alias("n")).toLocalIterator()]
    if not rows:
        return
    slope, bias = 0.5, -2.0
    for _ in range(rounds):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for w, y, n in rows:
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, slope * w + bias))))
            e, v = n * (p - y), n * max(1e-9, p * (1 - p))
            g0, g1, h00, h01, h11 = g0 + e, g1 + e * w, h00 + v, h01 + v * w, h11 + v * w * w
        g1, h11, h00 = g1 + ridge * slope, h11 + ridge, h00 + ridge
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        size = max(1.0, abs(d0), 4 * abs(d1))
        bias, slope = bias - d0 / size, slope - d1 / size
    grammar.slope, grammar.bias = max(0.0, slope), bias


def score(docs: DataFrame, grammar: Grammar, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``weight`` and ``score`` of each row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        finder = g.finder()
        for batch in batches:
            weights = [g.weigh(t, finder) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(weights, pa.float64()), pa.array([g.score(w) for w in weights], pa.float64())], names=["_key", "weight", "score"])

    rows = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    return rows.mapInArrow(lean(run), f"_key {kind}, weight double, score double").withColumnRenamed("_key", key)


def held_out(column: str = "doc_id"):
    return fold(column, 4) == 2


def assess(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from labels outside the held-out fold, then score every row."""
    grammar = learn(docs, labels.filter(~held_out()))
    out = score(docs, grammar)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns.

    A text without a matched clause (of weight 0 or less) stays, however common toxic labels are:
    the prior alone rejects nothing, so without labels, and for null and empty texts, all rows stay.
    The text is scored in the same pass as the row is kept or dropped: no join by id,
    so null and repeated ids keep their rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels.filter(~held_out())))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        finder = g.finder()
        for batch in batches:
            weights = [g.weigh(t, finder) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([w <= 0 or g.score(w) < threshold for w in weights], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
