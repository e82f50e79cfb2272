"""Toxicity by a weighted finite-state grammar over clauses.

Lexicon: words and word stems that mark toxic texts, from a fixed seed list and
from labelled rows (a likelihood-ratio test picks them). Grammar: transducers read
a clause's words side by side: who is spoken to or of, what is denied, what others
are reported to have said, where an insult waits for the one it is meant for, and
where a threat meets its victim. They are composed once into a single machine whose state
is the tuple of theirs. A text's clauses that hold a lexicon word are run through
it; each match counts by its path: an insult aimed at somebody, an insult by
itself, a threat, or what is denied or reported, which counts for nothing.

A text's score joins three kinds of evidence as if independent: threats, aimed insults, and
insults by themselves, whose logistic weight is fitted. One weak word that is
aimed at nobody stays below one half: it takes a second one.

Fitting uses a bounded sample of labelled keys (``SAMPLE``, the first by a hash),
of whose texts near copies count once; executors read whole texts and sum up their
words and clause features, and the driver gathers the words that mark toxic texts;
a row is never its own evidence if its fold is held out. Scoring covers every text in full: an Aho-Corasick scan
finds lexicon words, so clauses without any cost nothing more.

Defined cases: a null or empty text matches nothing and has the score of texts
without matches; without any usable labels the seed list and default weights
score alone; repeated rows each get their score; an empty table gives an empty
result; labels, language, source and key never enter a score.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.arrow_text import released
from threadlake.llm.steps import stored

#: Labelled keys whose texts the fit sees at most, each in full.
SAMPLE = 6000
#: Characters that sort a row before its digest does.
HEAD = 64
#: Likelihood ratio and share of toxic rows that a learned word needs; learned words at most.
RATIO, PURITY, MOST_WORDS = 24.0, 0.9, 5000
#: Occurrences in one text that count as evidence.
TWICE = 2
STEMS = (4, 5, 6, 7, 8)

# Seed words of the grammar's classes, in English, German, French and Spanish.
INSULTS = (
    "asshole bastard bitch clown cow cretin crook cunt degenerate disgusting dumb dumbass filthy fool freak garbage idiot imbecile jerk liar loser maggot moron parasite pathetic pig rat scum scumbag slut stupid trash ugly vermin whore worthless "
    "abschaum arschloch depp dumm dummkopf hässlich hurensohn idiotin mistkerl schwachkopf trottel versager widerlich "
    "abruti connard crétin débile imbécile laid minable ordure salaud "
    "basura cabrón escoria estúpido feo gilipollas idiota imbécil inútil pendejo"
).split()
THREATS = "kill hurt destroy beat stab shoot burn hang strangle crush murder rape töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
YOU = "you your you're u ur yourself yourselves du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes".split()
THEY = "they them he him she her these those it's he's she's er sie ihn ihm il elle ils elles lui él ella ellos ellas".split()
BE = "is are was were am be been being look looks looked ist sind bist seid war waren bin est es sont êtes suis était eres son soy fue era".split()
WILL = "will shall gonna going should must i'll we'll wirst werde werden wird vas va vais voy vamos".split()
NEGATIONS = "not no never isn't aren't don't won't wasn't cannot can't without nicht kein keine nie niemals ne pas jamais sans nunca jamás sin".split()
REPORTS = "said says say wrote quoted quote called claims claimed reported alleged according sagte schrieb zitiert laut angeblich dit écrit cité selon prétend dijo escribió según citó".split()

SEEDS = frozenset(INSULTS)
#: What a seed word weighs that is alone in its text and aimed at nobody: such words have everyday uses.
LONE = 0.5

CLAUSE = re.compile(r"[.!?;:\n]")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")

CLASSES = ("insult", "threat", "you", "they", "be", "will", "negation", "report", "other")
#: Words that a person reaches on, a negation, an insult for a "you" behind it, a threat for its victim; words until "is".
AIM, DENIAL, CALL, STRIKE, WAIT = 4, 3, 2, 3, 2

Transducer = dict[tuple[int, str], int]


def _machine(states: int, move) -> Transducer:
    return {(s, c): move(s, c) for s in range(states) for c in CLASSES}


def _aim(s: int, c: str) -> int:
    """Up to AIM: words for which somebody is meant. Beyond: somebody was named, and an "is" may follow."""
    if c == "you":
        return AIM
    if s > AIM:
        return AIM if c == "be" else AIM + WAIT if c == "they" else s - 1 if s - 1 > AIM else 0
    if c == "they":
        return max(s - 1, 0) or AIM + WAIT
    return s if c == "be" else max(s - 1, 0)


def _denied(s: int, c: str) -> int:
    return DENIAL if c == "negation" else max(s - 1, 0)


def _called(s: int, c: str) -> int:
    """Words left in which a "you" takes the insult before it to itself."""
    return CALL if c == "insult" else 0 if c == "you" else max(s - 1, 0)


#: Of threats: "will" was said; a threat that is not announced; one that is; "will" and then "you"; each with the words that it lasts.
STAGES = [("idle", 0), *((name, k) for name in ("will", "bare", "meant", "object") for k in range(1, STRIKE + 1))]


def _struck(s: int, c: str) -> int:
    name, left = STAGES[s]
    if c == "threat":
        to = ("idle", 0) if name == "object" else ("meant", STRIKE) if name in ("will", "meant") else ("bare", STRIKE)
    elif c == "you":
        to = ("object", STRIKE) if name == "will" else ("idle", 0)
    elif c == "they":
        to = ("idle", 0)
    elif c == "will":
        to = ("will", STRIKE)
    else:
        to = (name, left - 1) if left > 1 else ("idle", 0)
    return STAGES.index(to)


def _hits(s: int, c: str) -> bool:
    """Whether a threat finds its victim: "you" behind any, others behind an announced one, or "will you" before it."""
    name = STAGES[s][0]
    return c == "you" and name in ("bare", "meant") or c == "they" and name == "meant" or c == "threat" and name == "object"


AIM_MACHINE = _machine(AIM + WAIT + 1, _aim)
DENIAL_MACHINE = _machine(DENIAL + 1, _denied)
#: Reported speech holds to the clause's end.
REPORT_MACHINE = _machine(2, lambda s, c: int(s or c == "report"))
CALL_MACHINE = _machine(CALL + 1, _called)
THREAT_MACHINE = _machine(len(STAGES), _struck)
MACHINES = (AIM_MACHINE, DENIAL_MACHINE, REPORT_MACHINE, CALL_MACHINE, THREAT_MACHINE)

#: What a step of the composed machine finds: an insult by its path, an earlier one that turns out to be aimed, a threat.
PLAIN, AIMED, SOFT, CALLED, THREAT = "plain", "aimed", "soft", "called", "threat"


def composed() -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str]]:
    """The product machine: (state, class) to (state, what was found)."""
    out = {}
    for state in product(range(AIM + WAIT + 1), range(DENIAL + 1), range(2), range(CALL + 1), range(len(STAGES))):
        aim, denied, reported, called, struck = state
        soft = denied or reported
        for c in CLASSES:
            found = ""
            if c == "insult":
                found = SOFT if soft else AIMED if 0 < aim <= AIM else PLAIN
            elif c == "you" and called and not soft:
                found = CALLED
            if _hits(struck, c) and not soft:
                found = THREAT
            out[state, c] = (tuple(m[s, c] for m, s in zip(MACHINES, state, strict=True)), found)
    return out


@dataclass
class Model:
    """words, stems: weights by lower-cased word and by word beginning. weights: of the logistic score of insults by themselves.

    aimed, threat: odds that one of them leaves a text clean.
    """

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 3.0))
    stems: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (-3.0, 0.3, 2.5)
    aimed: float = 0.3
    threat: float = 0.25

    def ready(self) -> Model:
        if not hasattr(self, "scan"):
            self.scan = ahocorasick.Automaton()
            for w in {*self.words, *self.stems, *THREATS}:
                self.scan.add_word(w, len(w))
            self.scan.make_automaton()
            self.machine = composed()
            kinds = (("will", WILL), ("be", BE), ("they", THEY), ("you", YOU), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS))
            self.classes = {w: kind for kind, words in kinds for w in words}
        return self

    def weight(self, word: str) -> float:
        """Of one lower-cased word; 0 if it is no insult."""
        most = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                most = max(most, self.stems.get(word[:n], 0.0))
        return most

    def matches(self, clause: str) -> list[tuple[str, str]]:
        """(path, word) of what the composed machine finds in a lower-cased clause; a called insult is told once more, as aimed."""
        state, out, last = (0,) * len(MACHINES), [], ""
        for word in WORD.findall(clause):
            kind = self.classes.get(word) or ("insult" if self.weight(word) else "other")
            state, found = self.machine[state, kind]
            if found == CALLED:
                out.append((AIMED, last))
            elif found == THREAT:
                out.append((THREAT, word))
            elif found:
                last = word
                out.append((found, word))
        return out

    def clauses(self, text: str) -> list[str]:
        """The lower-cased clauses that hold a lexicon word, in order."""
        low, out, done = text.lower(), [], 0
        for end, n in self.scan.iter(low):
            start = end - n + 1
            if start < done or start and low[start - 1].isalpha():
                continue
            left = max(low.rfind(m, done, start) for m in ".!?;:\n") + 1
            found = CLAUSE.search(low, end + 1)
            done = found.start() if found else len(low)
            out.append(low[max(left, 0) : done])
        return out

    def evidence(self, text: str) -> tuple[float, float, int, int]:
        """Of a text: the weight of insults that are neither denied nor reported, that weight but for the heaviest one's, aimed ones, threats."""
        found: list[str] = []
        aimed = threats = 0
        for clause in self.clauses(text):
            for path, word in self.matches(clause):
                aimed += path == AIMED
                threats += path == THREAT
                if path in (PLAIN, AIMED):
                    found.append(word)
        weights = [self.weight(w) for w in found]
        if len(found) == 1 and not aimed and found[0] in SEEDS:
            return LONE, 0.0, aimed, threats
        return sum(weights), sum(weights) - max(weights, default=0.0), aimed, threats

    def features(self, text: str) -> tuple[float, float]:
        """Logs of the insults' weight, and of that beside the heaviest one."""
        total, rest, _, _ = self.evidence(text)
        return math.log1p(total), math.log1p(rest)

    def score(self, text: str) -> float:
        total, rest, aimed, threats = self.evidence(text)
        z = self.weights[0] + self.weights[1] * math.log1p(total) + self.weights[2] * math.log1p(rest)
        clean = 1 / (1 + math.exp(max(-40.0, min(40.0, z))))
        return 1 - clean * self.aimed ** min(aimed, 40) * self.threat ** min(threats, 40)


def _ratio(a: int, b: int, n1: int, n0: int) -> float:
    """G of a word in a of n1 toxic and b of n0 other texts."""
    n, k = n1 + n0, a + b
    term = lambda x, e: x * math.log(x / e) if x else 0.0
    return 2 * (term(a, k * n1 / n) + term(b, k * n0 / n) + term(n1 - a, (n - k) * n1 / n) + term(n0 - b, (n - k) * n0 / n))


def _marker(text: str) -> int:
    """Of near copies mostly the same: the least hash of runs of five words."""
    words = text.split()
    return min((zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0)


def tallies(text: str, toxic: bool) -> dict[str, tuple[int, list[str]]]:
    """For each word and stem of a whole text its occurrences, TWICE at most, and of a toxic text's stems the words."""
    counts = Counter(WORD.findall(text.lower()))
    names: Counter[str] = Counter()
    forms: dict[str, list[str]] = {}
    for w, k in counts.items():
        names[w] += min(k, TWICE)
        for n in STEMS:
            if len(w) > n:
                names[w[:n] + "*"] += min(k, TWICE)
                if toxic:
                    forms.setdefault(w[:n] + "*", []).append(w)
    return {name: (min(k, TWICE), forms.get(name, [])) for name, k in names.items()}


def learn(found: dict[str, tuple[int, int, int]], n1: int, n0: int) -> Model:
    """The lexicon from (occurrences in toxic texts, in others, forms) by name; n1 toxic and n0 other texts."""
    model = Model()
    if not (n1 and n0):
        return model
    n1, n0 = TWICE * n1, TWICE * n0
    picked = []
    for name, (a, b, forms) in found.items():
        share = (a + 0.1) / n1 / ((a + 0.1) / n1 + (b + 0.1) / n0)
        if name[-1] == "*" and forms < 3:  # a stem of one or two words says no more than they do
            continue
        if a >= 2 * TWICE and share >= PURITY and a >= PURITY * (a + b) and (g := _ratio(a, b, n1, n0)) >= RATIO:
            picked.append((-g, name, math.log((a + 0.5) / n1 / ((b + 0.5) / n0))))
    for _, name, w in sorted(picked)[:MOST_WORDS]:
        if name[-1] == "*":
            model.stems[name[:-1]] = w
        else:
            model.words[name] = max(w, model.words.get(name, 0.0))
    for w in [w for w in model.words if w in found and found[w][1] > found[w][0]]:
        del model.words[w]  # a seed word that the labels speak against
    return model


#: Weights of two features that a fit starts from and is drawn to; a single insult has nothing but the first.
PRIOR = np.array([-3.0, 0.3, 2.5])


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, penalty: float = 0.05, rounds: int = 40) -> tuple[float, ...]:
    """Logistic regression by Newton steps, drawn to PRIOR; each row counts ``times``."""
    x = np.column_stack([np.ones(len(x)), x])
    w = PRIOR.copy()
    ridge = penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (times * (y - p)) - ridge @ (w - PRIOR))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def held_out(key: str):
    """Whether a key's fold is kept from fitting: crc32 of its text divisible by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on the rows of at most ``sample`` labelled keys outside the held-out fold.

    The keys are the first by a hash. Executors read the texts, each once however
    often it repeats, and sum up words; the driver gathers the words that mark toxic
    texts, and then two features of each text.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull()).where(~held_out("k"))
    chosen = known.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    picked = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "k").select("t", F.col("y").cast("int").alias("y"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ys = batch.column(0).to_pylist(), batch.column(1)
            yield pa.RecordBatch.from_arrays([pa.array([f"{t[:HEAD]}\0{hashlib.md5(t.encode()).hexdigest()}" for t in texts], pa.string()), pa.array([_marker(t) for t in texts], pa.int64()), batch.column(0), ys], names=["digest", "marker", "t", "y"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(name, form, toxic occurrences, others); a row with a form only says that there is one."""

        def out() -> pa.RecordBatch:
            rows = [(n, None, *c) for n, c in sums.items()] + [(n, f, 0, 0) for n, f in forms]
            sums.clear()
            forms.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["name", "form", "a", "b"])

        sums: dict[str, list[int]] = {}
        forms: set[tuple[str, str]] = set()
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for name, (k, of) in tallies(t.as_py(), y == 1).items():
                    sums.setdefault(name, [0, 0])[0 if y == 1 else 1] += k
                    forms.update((name, f) for f in of)
                if len(sums) + len(forms) > 200_000:
                    yield out()
        if sums:
            yield out()

    # Near copies mostly have one marker, and count once.
    marks = stored(picked.mapInArrow(released(marked), "digest string, marker bigint, t string, y int"))
    once = marks.groupBy("marker", "y").agg(F.min_by("t", "digest").alias("t")).select("t", "y")
    once = stored(once)
    sizes = {r["y"]: r["count"] for r in once.groupBy("y").count().collect()}
    rows = once.mapInArrow(released(counted), "name string, form string, a bigint, b bigint")
    sums = rows.groupBy("name", "form").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("form").alias("forms"))
    telling = (F.col("a") >= 2 * TWICE) & (F.col("a") >= PURITY * (F.col("a") + F.col("b")))
    found = {r["name"]: (r["a"], r["b"], r["forms"]) for r in sums.where(telling | F.col("name").isin(list(INSULTS))).collect()}
    model = learn(found, sizes.get(1, 0), sizes.get(0, 0))
    if len(sizes) < 2:
        return model

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = model.ready()
        for batch in batches:
            values = [ready.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([v[k] for v in values], pa.float64()) for k in (0, 1))], names=["digest", "y", "a", "b"])

    rows = marks.select("digest", "t", "y").mapInArrow(released(measures), "digest string, y int, a double, b double").groupBy("digest", "y").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    # Equal features count together: that leaves few rows, however many texts there are.
    rows = sorted(rows.groupBy("y", "a", "b").count().collect(), key=lambda r: (r["y"], r["a"], r["b"]))
    model.weights = _logistic(np.array([(r["a"], r["b"]) for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["count"] for r in rows], float))
    return model


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = model.ready()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield part.filter(pa.array([ready.score(t.as_py() or "") < threshold for t in part.column(text)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = model.ready()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([ready.score(t.as_py() or "") for t in part.column(1)], pa.float64())], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(released(run), f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
