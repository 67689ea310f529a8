"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report or other. Three transducers are composed into
one machine: negation softens what follows it, reported speech discounts the rest of its clause, and the
target transducer decides what an insult or a threat weighs: whole beside a person, little alone. A clause
scores the sum of its arcs. A document's evidence is the sum over its distinct clauses, less what clean texts of as
many clauses hold on average, and its score grows with that. Insults, their weights and the average are learned
from labelled rows, beside a general list of words; everything else of the grammar is fixed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: At most about so many labelled rows (a hash of their ids chooses) fit the lexicon.
FIT_ROWS = 20_000
#: A term counts if it is in so many toxic texts, so many of its texts are toxic, and its log odds are so many
#: standard errors above 0. None of the three rises with the number of labels.
LEAST_TEXTS, LEAST_PRECISION, LEAST_ERRORS = 3, 0.85, 2.0
#: Rows whose crc32 of the id leaves this remainder by 4 are held out.
HELD_OUT = 2
THRESHOLD = 0.3
#: Evidence, in log odds, at which the score is 1 - 1/e.
SCALE = 3.0
#: Average evidence of a clause of clean text where no labels tell it.
CLEAN_RATE = 0.01
PREFIXES = range(3, 9)
MEMO = 200_000

# General word lists of the grammar.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass loser losers scum trash garbage worthless pathetic"
    " disgusting clown imbecile bastard bastards jerk fool freak pig swine rat vermin filth degenerate retard creep coward"
    " useless brainless ugly idiota idiotas imbécil estúpido estúpida basura inútil asqueroso cabrón pendejo tonto"
    " dummkopf trottel blödmann abschaum arschloch versager dreckskerl widerlich wertlos idiote imbécile connard salaud"
    " ordure débile minable abruti crétin"
).split()
THREATS = (
    "kill hurt destroy beat stab shoot burn punish strangle smash crush hang slaughter murder töten schlagen umbringen"
    " erschießen vernichten verletzen tuer frapper détruire brûler étrangler matar golpear destruir quemar mato mataré tuerai"
).split()
TARGETS = (
    "you your yours yourself u ur he him she her they them their everyone people du dich dir dein ihr euch euer er ihn sie"
    " tu te toi vous votre lui eux ils elles usted ustedes ti tú vosotros él ella ellos"
).split()
NEGATIONS = (
    "not no never nobody none neither nor without hardly nicht kein keine keinen nie niemals ohne ne pas jamais aucun"
    " sans nunca jamás ningún ninguna sin tampoco"
).split()
REPORTS = (
    "said says say saying wrote writes called calls calling quoted quotes claimed claims reported reports told tells"
    " alleged sagte sagt schrieb nannte behauptete dit disait écrit appelé prétend dijo dice escribió llamó afirma"
).split()
GENERAL_WEIGHT, THREAT_WEIGHT = 2.0, 2.5

CLAUSE = re.compile(r"[.!?;:,|\n]+")
TOKEN = re.compile(r"[^\W\d_]+")
#: "didn't" holds a negation.
CONTRACTION = re.compile(r"n['\u2019]t\b")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)


@dataclass(frozen=True)
class Arc:
    """To a state, with the symbol written; the token's weight is multiplied, then a constant added."""

    to: int
    out: int
    times: float = 1.0
    plus: float = 0.0


@dataclass(frozen=True)
class Transducer:
    """Arcs by (state, symbol); where none is given the symbol passes and the state falls back to `rest[state]`."""

    arcs: dict[tuple[int, int], Arc]
    rest: tuple[int, ...]

    def step(self, state: int, symbol: int) -> Arc:
        return self.arcs.get((state, symbol)) or Arc(0 if symbol == END else self.rest[state], symbol)


def negation(reach: int = 4, soft: float = 0.15) -> Transducer:
    """State i: i words after a negation are still under it."""
    arcs = {(s, NEGATION): Arc(reach, NEGATION) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs[s, INSULT] = Arc(s - 1, INSULT, soft)
        arcs[s, THREAT] = Arc(s - 1, THREAT, soft)
    return Transducer(arcs, (0, *range(reach)))


def reported(soft: float = 0.5) -> Transducer:
    """State 1: after a verb of reporting, up to the end of the clause."""
    arcs = {(s, REPORT): Arc(1, REPORT) for s in (0, 1)}
    arcs |= {(1, x): Arc(1, x, soft) for x in (INSULT, THREAT)}
    return Transducer(arcs, (0, 1))


def targeted(bonus: float = 1.5, bare: float = 0.25, alone: float = 0.1, subject: float = 0.3, reach: int = 2) -> Transducer:
    """What an insult or a threat weighs by the person beside it.

    States 0: nothing; 1: a person was named; 2: an insult waits for one; 3, 4: a threat was 1 or 2 words ago,
    and only a person so near is what it is aimed at. A person named before a threat may be who threatens, one before
    a verb of reporting is who speaks.
    """
    arcs = {(1, REPORT): Arc(0, REPORT)}
    arcs |= {(s, TARGET): Arc(1, TARGET) for s in (0, 1)}
    arcs |= {(s, INSULT): Arc(2, INSULT, bare) for s in (0, 2, 3, 4)} | {(1, INSULT): Arc(1, INSULT, bonus)}
    arcs |= {(s, THREAT): Arc(2 + reach, THREAT, subject if s == 1 else alone) for s in range(5)}
    arcs[2, TARGET] = Arc(1, TARGET, 1.0, (1.0 - bare) * GENERAL_WEIGHT)
    arcs |= {(s, TARGET): Arc(1, TARGET, 1.0, (1.0 - alone) * THREAT_WEIGHT) for s in (3, 4)}
    return Transducer(arcs, (0, 1, 2, 0, 3))


def compose(*machines: Transducer) -> dict[tuple[int, int], tuple[int, float, float]]:
    """One table (state, symbol) -> (state, factor, constant): each machine reads what the one before writes."""
    numbers, waiting, out = {(0,) * len(machines): 0}, [(0,) * len(machines)], {}
    while waiting:
        states = waiting.pop()
        for symbol in range(END + 1):
            read, times, plus, to = symbol, 1.0, 0.0, []
            for machine, state in zip(machines, states, strict=True):
                arc = machine.step(state, read)
                read, times, plus = arc.out, times * arc.times, plus * arc.times + arc.plus
                to.append(arc.to)
            if tuple(to) not in numbers:
                numbers[tuple(to)] = len(numbers)
                waiting.append(tuple(to))
            out[numbers[states], symbol] = (numbers[tuple(to)], times, plus)
    return out


@dataclass
class Lexicon:
    """Weights of insults, whole words and prefixes of words, and the average evidence of a clause of clean text."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    rate: float = 0.0

    def symbols(self) -> dict[str, tuple[int, float]]:
        """Symbol and weight of each listed word."""
        out = {w: (THREAT, THREAT_WEIGHT) for w in THREATS}
        out |= {w: (INSULT, x) for w, x in self.words.items()}
        for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            out |= {w: (symbol, 0.0) for w in words}
        return out


class _Reader(dict):
    """Symbol and weight of any word; remembers words, up to a bound."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.listed, self.prefixes, self.rate = lexicon.symbols(), lexicon.prefixes, lexicon.rate
        self.lengths = sorted({len(p) for p in self.prefixes}, reverse=True)

    def __missing__(self, word: str):
        found = self.listed.get(word)
        if found is None:
            found = next(((INSULT, self.prefixes[word[:n]]) for n in self.lengths if word[:n] in self.prefixes), (OTHER, 0.0))
        if len(self) >= MEMO:
            self.clear()
        self[word] = found
        return found


def clause_score(symbols: list[tuple[int, float]], machine: dict) -> float:
    state, total = 0, 0.0
    for symbol, weight in [*symbols, (END, 0.0)]:
        state, times, plus = machine[state, symbol]
        total += weight * times + plus
    return total


def grammar() -> dict:
    return compose(negation(), reported(), targeted())


def text_evidence(text: str, reader: _Reader, machine: dict) -> tuple[float, int, int]:
    """Evidence of the distinct clauses, the number of clauses that match, and of all clauses."""
    text = CONTRACTION.sub("n not", text.lower())
    parts = CLAUSE.split(text)
    if not any(reader[w][0] in (INSULT, THREAT) for w in set(TOKEN.findall(text))):
        return 0.0, 0, len(parts)
    evidence, matched, seen = 0.0, 0, set()
    for clause in parts:
        words = TOKEN.findall(clause)
        symbols = [reader[w] for w in words]
        if any(s in (INSULT, THREAT) for s, _ in symbols):
            matched += 1
            if (said := " ".join(words)) not in seen:
                seen.add(said)
                evidence += clause_score(symbols, machine)
    return evidence, matched, len(parts)


def score_text(text: str, reader: _Reader, machine: dict) -> tuple[float, int]:
    """Score from 0 to 1 and number of clauses that match."""
    evidence, matched, clauses = text_evidence(text, reader, machine)
    return 1.0 - math.exp(-max(0.0, evidence - clauses * reader.rate) / SCALE), matched


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score, predicted and clauses (number of matching ones); null and empty texts score 0.

    Every row keeps its columns and is scored by itself, so ties and repeated rows change nothing; scores, predicted
    and clauses replace columns of those names. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kept = [c for c in docs.columns if c not in ("score", "predicted", "clauses")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, machine = _Reader(shared.value), grammar()
        for batch in batches:
            found = [score_text(t or "", reader, machine) for t in batch.column(kept.index(text_col)).to_pylist()]
            scores = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                    pa.array([n for _, n in found], pa.int32()),
                ],
                [*kept, "score", "predicted", "clauses"],
            )

    schema = docs.limit(0).withColumns(
        {"score": F.lit(0.0), "predicted": F.lit(0), "clauses": F.lit(0)}
    ).schema
    return docs.mapInArrow(run, schema)


def _terms(batches):
    """Terms of each text, with the number of toxic and of other texts that have them."""
    counts: dict[str, list[int]] = {}

    def drain():
        names = list(counts)
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), *(pa.array([counts[x][i] for x in part], pa.int64()) for i in (0, 1))], ["term", "clean", "toxic"]
            )
        counts.clear()

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(TOKEN.findall((text or "").lower()))
            terms = {"=" + w for w in words} | {"^" + w[:n] for w in words for n in PREFIXES if len(w) >= n}
            for term in terms:
                counts.setdefault(term, [0, 0])[toxic] += 1
            if len(counts) > 500_000:
                yield from drain()
    yield from drain()


def _clean_evidence(lexicon: Lexicon):
    """Evidence and clauses of all texts of a task."""

    def run(batches):
        reader, machine = _Reader(lexicon), grammar()
        total, clauses = 0.0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = text_evidence(text or "", reader, machine)
                total, clauses = total + found[0], clauses + found[2]
        yield pa.RecordBatch.from_pydict({"evidence": [total], "clauses": [clauses]})

    return run


def fit_lexicon(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """Learn insults from labelled rows that are not held out, about `rows` of them at most.

    Of equal texts of one label one counts, lest the words of a copied text pass for insults. A term is kept by
    LEAST_TEXTS, LEAST_PRECISION and LEAST_ERRORS and weighs its log odds less one standard error; a prefix
    only if it is not just one word and no longer form has nearly all of its texts. Words of the general list keep their weight unless ten
    texts or more say otherwise. Rows without label or id are not used; no labels leave the general list. What
    is collected is bounded by the terms of `rows` texts.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != HELD_OUT)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = usable.count()
    if total > rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / total))
    texts = docs.select("doc_id", "text").join(usable, "doc_id").select("toxic", "text")
    texts = cut(texts.distinct())
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    general = {w: GENERAL_WEIGHT for w in INSULTS}
    if not size.get(0) or not size.get(1):
        return Lexicon(general, rate=CLEAN_RATE)
    counts = texts.select("toxic", "text").mapInArrow(_terms, "term string, clean bigint, toxic bigint")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (size[1] + 1)) - F.log((F.col("clean") + 0.5) / (size[0] + 1))
    counts = counts.withColumn("odds", odds)
    listed = F.col("term").isin(["=" + w for w in INSULTS]) & (F.col("clean") + F.col("toxic") >= 10)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    precision = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1)
    told = (F.col("toxic") >= LEAST_TEXTS) & (precision >= LEAST_PRECISION) & (odds >= error * LEAST_ERRORS)
    found = counts.withColumn("odds", F.col("odds") - error).where(told | listed).collect()
    words = general | {r["term"][1:]: max(0.0, r["odds"]) for r in found if r["term"][0] == "="}
    stems = {r["term"][1:]: r for r in found if r["term"][0] == "^"}
    whole = {r["term"][1:]: r["toxic"] for r in found if r["term"][0] == "="}
    longer: dict[str, int] = {}
    for stem, r in stems.items():
        longer[stem[:-1]] = max(r["toxic"], longer.get(stem[:-1], 0))
    prefixes = {
        stem: max(0.0, r["odds"])
        for stem, r in stems.items()
        if longer.get(stem, 0) < 0.95 * r["toxic"] and whole.get(stem, 0) < 0.95 * r["toxic"]
    }
    learned = Lexicon(words, prefixes, 0.0)
    clean = texts.where("toxic = 0").select("text").mapInArrow(_clean_evidence(learned), "evidence double, clauses bigint")
    seen = clean.agg(F.sum("evidence"), F.sum("clauses")).first()
    return Lexicon(words, prefixes, seen[0] / seen[1])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit_lexicon(docs, table(spark, sf_dir, "labels"))
    out = score_documents(docs, lexicon)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "clauses")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic."""
    return score_documents(docs, fit_lexicon(docs, labels)).where("predicted = 0").select(*docs.columns)


SQL: dict[str, str] = {}
