"""Operator 1 - toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause's words as classes and are composed into one
deterministic machine:

* ``negation`` marks an insult or threat within ``NEGATED`` words after a
  negation ("not", "hardly", "nobody", "anything but");
* ``reported`` marks one after a verb of reporting ("she called him a ...");
* ``target`` marks one within ``AIMED`` words after a person ("you", "he"; not
  "this" or "his") or after "what a", "such an";
* ``insult`` and ``threat`` give the marked words their factors; a threat weighs
  fully when a person follows within ``STRUCK`` words.

A clause weighs the sum, over its insults and threats, of lexical weight times
factor.  A word alone doesn't make a clause weigh ``THRESHOLD``: an insult that
is aimed at a person weighs 1 and one that isn't ``ALONE``, or nearly nothing
if it names things as well ("garbage").  So "you are not stupid", "he said I
was stupid", "take out the trash" and a lone threatening verb don't reject.

A document's score sums its clauses: those that weigh ``THRESHOLD`` or more by
themselves, and of the weaker ones above ``FAINT`` one for each different word,
over its thousands of words if there are more.  So what rejects is an aimed or
piled-up clause, or several different insults close together, and scattered
words in a long text don't.

The grammar's frame (persons, negations, reporting verbs, threats, a few
English, German, French and Spanish insults) is fixed; further insults are
learnt from ``labels``: words, and families of words of the same four to eight
first letters, that toxic documents have and clean ones hardly have, over at
most ``LABELLED`` labelled documents (those of the smallest hashes of their
ids).  A learnt word weighs by its log-odds, fully at a ratio of ``e**FULL``.

Null or empty texts score 0 and are kept; texts are read whole, however long;
labels that are null or of unknown documents are ignored, of repeated ones a
toxic one counts, once; of equally telling word beginnings the shorter, then
the first in the alphabet is learnt; without labels the fixed lexicon is used
alone.  Rows, columns (of any names) and row repetitions are left as they are;
an empty table stays empty.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.llm.common import free_name, require, table, tuned

THRESHOLD = 0.5
ALONE, FAINT = 0.4, 0.3
NEGATED, AIMED, STRUCK = 6, 6, 3
LABELLED = 12_000
FULL = 5.0
STEMS = range(4, 9)

INSULTS = """idiot idiots moron morons imbecile scum scumbag loser losers clown clowns trash
 stupid pathetic worthless disgusting brainless dumbass asshole bastard bitch
 dummkopf vollidiot arschloch abschaum trottel schwachkopf widerlich
 imbécile crétin connard salaud ordure débile
 imbécil estúpido estúpida gilipollas cabrón escoria""".split()
THINGS = "garbage filth vermin dirt rubbish müll dreck déchet basura".split()
THREATS = "kill murder hurt stab shoot strangle destroy töten umbringen erschießen tuer tuerai frapper matar mataré golpear".split()
TARGETS = "you yourself yourselves he him himself she her herself they them themselves u ye du dich dir ihr euch sie er tu toi vous te ti tú usted ustedes ella él".split()
NEGATIONS = """not no never neither nor nobody none nothing hardly scarcely barely without cannot isn aren wasn weren don doesn didn won wouldn shouldn couldn haven hasn hadn ain mustn
 nicht kein keine keinen keiner nie niemals niemand kaum weder ohne pas jamais aucun aucune personne guère ni nunca jamás nadie ningún ninguna tampoco apenas sin""".split()
REPORTS = "said says say told tells called calls wrote writes claimed claims quoted sagte sagt nannte schrieb dit disait écrivait dijo dice llamó escribió".split()

#: Halves of "anything but" and "what a", by class.
HALVES = {"A": "anything everything alles tout todo".split(), "B": "but außer sauf menos".split(), "X": "what such was quel quelle qué".split(), "D": "a an ein eine für".split()}

_WORDS = re.compile(r"\w+")
_CLAUSE = re.compile(r"[.!?;:\n\r…。]+")


class Transducer:
    """Deterministic and weighted: ``arcs[state, symbol] = (state, symbol, factor)``."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def compose(self, other: "Transducer") -> "Transducer":
        """What ``other`` makes of this one's output."""
        start = (self.start, other.start)
        arcs, todo, seen = {}, [start], {start}
        symbols = {x for _, x in self.arcs}
        while todo:
            p, q = state = todo.pop()
            for x in symbols:
                if (p, x) not in self.arcs:
                    continue
                p2, y, w = self.arcs[p, x]
                q2, z, v = other.arcs[q, y]
                arcs[state, x] = ((p2, q2), z, w * v)
                if (p2, q2) not in seen:
                    seen.add((p2, q2))
                    todo.append((p2, q2))
        return Transducer(start, arcs)


def _marks(kind: str, *options: tuple[str, ...]) -> list[str]:
    return [kind + "".join(m) for m in product(*options)]


PLAIN = ["I", "M", "T", "G", "N", "R", "A", "B", "X", "D", "O"]


def stages() -> list[Transducer]:
    """The five transducers; each reads what the one before it writes.

    I, M, T, G, N, R and O are insult, insult that names things as well,
    threat, target, negation, report and other; A, B, X and D are ``HALVES``.
    """
    weighing = ("I", "M", "T")
    negation = {}
    for (left, any_), x in product(product(range(NEGATED + 1), (False, True)), PLAIN):
        on = x == "N" or any_ and x == "B"
        state = (NEGATED if on else max(0, left - 1), x == "A")
        negation[(left, any_), x] = (state, x + "n" if left and x in weighing else "O" if x in "NAB" else x, 1.0)

    kinds = [k for w in weighing for k in _marks(w, ("", "n"))]
    reported = {}
    for on, x in product((0, 1), [*kinds, "G", "R", "X", "D", "O"]):
        reported[on, x] = (1 if x == "R" else on, x + "r" if on and x in kinds else "O" if x == "R" else x, 1.0)

    kinds = [k for w in weighing for k in _marks(w, ("", "n"), ("", "r"))]
    target = {}
    for (left, what), x in product(product(range(AIMED + 1), (False, True)), [*kinds, "G", "X", "D", "O"]):
        state = (AIMED if x == "G" or what and x == "D" else max(0, left - 1), x == "X")
        target[(left, what), x] = (state, x + "g" if left and x in kinds else "O" if x in "XD" else x, 1.0)

    kinds = [k for w in weighing for k in _marks(w, ("", "n"), ("", "r"), ("", "g"))]

    def weigh(x: str, alone: float, aimed: float) -> float:
        w = aimed if "g" in x else alone
        return w * (0.2 if "n" in x else 1) * (0.2 if "r" in x else 1)

    insult = {}
    for x in [*kinds, "G", "O"]:
        insult[0, x] = (0, "I" if x[0] in "IM" else x, weigh(x, ALONE if x[0] == "I" else ALONE / 5, 1.0) if x[0] in "IM" else 1.0)
    threat = {}  # "G" stands for the threat that it completes
    threats = [k for k in kinds if k[0] == "T"]
    for (open_, left), x in product([("", 0), *product(threats, range(1, STRUCK + 1))], [*threats, "I", "G", "O"]):
        on = (open_, left - 1) if left > 1 else ("", 0)
        if x[0] == "T":
            threat[(open_, left), x] = ((x, STRUCK), "W", weigh(x, 0.2, 0.3))
        elif x == "G":
            threat[(open_, left), x] = (("", 0), "W" if open_ else "O", weigh(open_, 1.0, 1.2) if open_ else 1.0)
        else:
            threat[(open_, left), x] = (on, "W" if x == "I" else "O", 1.0)
    return [Transducer((0, False), negation), Transducer(0, reported), Transducer((0, False), target), Transducer(0, insult), Transducer(("", 0), threat)]


@lru_cache(None)
def grammar() -> tuple[int, list[dict[str, tuple[int, float]]]]:
    """The composed machine: its first state, and for each state and class the
    next one and the weight; once in each process."""
    machine, *others = stages()
    for other in others:
        machine = machine.compose(other)
    states = {s: i for i, s in enumerate(dict.fromkeys([machine.start, *(s for s, _ in machine.arcs)]))}
    table: list[dict] = [{} for _ in states]
    for (s, x), (t, y, w) in machine.arcs.items():
        table[states[s]][x] = (states[t], w if y == "W" else 0.0)
    return states[machine.start], table


class Scorer:
    """The grammar with a lexicon, to which ``learnt`` adds words and beginnings
    of longer words (``stem*``) with their weights."""

    def __init__(self, learnt: dict[str, float] | None = None):
        self.words = {w: (kind, 0.0) for kind, words in HALVES.items() for w in words}
        for kind, words in (("G", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("T", THREATS), ("M", THINGS), ("I", INSULTS)):
            self.words.update({w: (kind, 1.0) for w in words})
        self.stems = {}
        for w, weight in (learnt or {}).items():
            if w[-1] == "*":
                self.stems[w[:-1]] = weight
            elif w not in self.words:
                self.words[w] = ("I", weight)
        self.stem_lengths = sorted({len(s) for s in self.stems})
        self.triggers = [w for w, (k, _) in self.words.items() if k in "IMT"] + list(self.stems)
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def word(self, w: str) -> tuple[str, float]:
        found = self.words.get(w)
        if found is None:
            for n in self.stem_lengths:
                if len(w) > n and (weight := self.stems.get(w[:n])):
                    return "I", weight
            return "O", 0.0
        return found

    def clause(self, text: str) -> tuple[float, str]:
        """The weight of one lower-case clause, and its weightiest word."""
        state, table = grammar()
        total, most, word, open_, threat = 0.0, 0.0, "", 1.0, ""
        for w in _WORDS.findall(text):
            kind, weight = self.word(w)
            state, factor = table[state][kind]
            if kind == "T":
                open_, threat = weight, w
            if factor:
                x, own = (factor * weight, w) if kind in "IMT" else (factor * open_, threat)
                total += x
                if x > most:
                    most, word = x, own
        return total, word

    def text(self, text: str | None) -> tuple[float, float, int]:
        """Score, largest of the clauses' weights, number of weighing clauses."""
        if not text:
            return 0.0, 0.0, 0
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for w in self.triggers:
                self.automaton.add_word(w, len(w))
            self.automaton.make_automaton()
        low = text.lower()
        total = worst = 0.0
        count, done, faint = 0, -1, {}
        for end, n in self.automaton.iter(low):
            begin = end - n + 1
            if begin < done or begin and (low[begin - 1].isalnum() or low[begin - 1] == "_"):
                continue
            a = max((m for c in ".!?;:\n\r…。" if (m := low.rfind(c, max(done, 0), begin)) >= 0), default=max(done, 0) - 1) + 1
            m = _CLAUSE.search(low, end)
            done = m.start() if m else len(low)
            w, word = self.clause(low[a:done])
            if w:
                count, worst = count + 1, max(worst, w)
                if w >= THRESHOLD:
                    total += w
                elif w > FAINT:
                    faint[word] = max(w, faint.get(word, 0.0))
        total += sum(faint.values())
        if total:
            total /= max(1.0, len(low.split()) / 1000)
        return total, worst, count


def learn(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> dict[str, float]:
    """Insults that the labels show, and their weights: words, and beginnings
    of longer words (``stem*``)."""
    require(labels, "doc_id", "toxic")
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    words = texts.join(F.broadcast(sample), "doc_id").select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("w")).where(F.length("w") >= STEMS[0])
    counts = words.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    bad, all_ = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    least = max(4, math.ceil(0.01 * bad))

    def telling(df: DataFrame, least: int) -> DataFrame:
        return df.where((F.col("t") >= least) & (F.col("t") >= 0.8 * (F.col("t") + F.col("c"))))

    stems = counts.select(F.explode(F.array(*(F.substring("w", 1, n) for n in STEMS))).alias("s"), "t", "c", "w").where("length(w) > length(s)")
    stems = stems.groupBy("s").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum(F.expr("int(t > 0)")).alias("kinds")).where("kinds >= 4")
    found = telling(stems, 2 * least).select(F.concat("s", F.lit("*")).alias("w"), "t", "c").union(telling(counts, 2 * least).select("w", "t", "c")).collect()
    learnt: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (4 * r.c - r.t, len(r.w), r.w)):  # of nested beginnings the most telling
        w = r.w.rstrip("*")
        if not any(w.startswith(x.rstrip("*")) or x.startswith(w) for x in learnt):
            odds = math.log((r.t + 0.5) / (bad + 1) / ((r.c + 0.5) / (all_ - bad + 1)))
            learnt[r.w] = min(1.0, max(0.0, odds / FULL))
    return learnt


def scored(docs: DataFrame, learnt: dict[str, float], name: str) -> DataFrame:
    """``docs`` with a struct column of that name: score, worst, clauses."""
    scorer = Scorer(learnt)

    @F.arrow_udf("struct<score:double,worst:double,clauses:int>")
    def run(texts: pa.Array) -> pa.Array:
        found = np.array([scorer.text(t) for t in texts.to_pylist()], float).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2].astype(np.int32))], ["score", "worst", "clauses"])

    tuned(docs.sparkSession)
    return docs.withColumn(name, run(F.col("text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = LABELLED) -> DataFrame:
    """``(doc_id, score, worst, clauses, toxic)``, a row for each input row."""
    require(docs, "doc_id", "text")
    out = scored(docs.select("doc_id", "text"), learn(docs, labels, bound), "tox")
    return out.select("doc_id", "tox.score", "tox.worst", "tox.clauses", (F.col("tox.score") >= threshold).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with their columns."""
    require(docs, "doc_id", "text")
    name = free_name(docs, "tox")
    return scored(docs, learn(docs, labels, bound), name).where(F.col(f"{name}.score") < threshold).drop(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
