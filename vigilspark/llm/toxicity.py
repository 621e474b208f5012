"""Toxicity: a weighted finite-state grammar of clauses.

A lexical acceptor gives each word a class: insult (in steps of weight), threat, target, negation, report, quote, other.
Five transducers over classes are composed into one clause machine: negation and reported speech weaken the
insults and threats in their scope, a target near an insult strengthens it, a threat counts only with a
target, and what is left of insults is paid out as negative cost. The shortest path of a clause is its match; a
document's score comes from its best clause and how many clauses match, not from isolated words.

The insult acceptor is learned from labels: words and stems (prefixes that several words share) of the labelled texts
whose likelihood ratio between toxic and clean texts passes a bound for the number of candidates, chosen by sequential
covering (equal texts count once, a text is explained COVERS times) so that words which merely occur in near copies
of explained texts do not enter. Learned from at
most TRAIN_ROWS labelled rows, the first by a hash of the id (the stated bound); word counts are summed on the
executors; words that pass the bound, each in three toxic texts of the sample at least, come to the driver, and so does
what of them each toxic text of the sample holds.

Defined results: null and empty texts score 0; very long texts are read whole; words of equal merit are chosen by
name; a null id gives a row with a null id, held_out false; a small fixed lexicon holds beside what is learned, unless labels refute it; null labels are
ignored; repeated rows each give a row; no rows give no rows; columns other than id and text are never read."""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import first_rows, fold_of, materialize, per_batch
from vigilspark.llm.wfst import Fst, compose, least_cost

TRAIN_ROWS = 30_000
STEM_LETTERS = (3, 4, 5, 6, 7)
STEPS = 8  # classes i1..i8: insults of weight 1..8
COVERS = 3  # units that may explain the same text
AGAIN_SHARE = 0.01  # of toxic texts, for a unit whose texts others explain already
SCOPE = 3  # words that a negation or a target reaches
BIAS = 3.0
TOKENS = re.compile(r"[^\W\d_]+|[.!?;\n\"“”«»„]")

# Closed-class words of the grammar, and a small lexicon for what labels do not show.
NEGATIONS = "not never no nobody nicht kein keine nie pas jamais aucun nunca tampoco jamás".split()
REPORTS = "said says wrote quoted claimed reported called sagte sagt schrieb zitierte dit disait écrit cité dijo dice escribió citó".split()
TARGETS = "you your yours u he she they them him her du dich dir ihr euch sie tu toi vous te vosotros usted ustedes ellos ellas".split()
THREATS = "kill hurt destroy murder stab shoot töten umbringen verletzen tuer détruire frapper matar destruir golpear".split()
QUOTES = list("\"“”«»„")
ENDS = list(".!?;\n")
FALLBACK = "idiot moron scum trash loser stupid pathetic worthless disgusting clown".split()

INSULTS = [f"i{k}" for k in range(1, STEPS + 1)]
CLASSES = [*INSULTS, "threat", "target", "neg", "report", "quote", "o"]


class Lexicon(NamedTuple):
    words: dict[str, int]  # word -> weight step
    stems: dict[str, int]


def _weaker(symbol: str) -> str:
    """A quarter of the weight: the strongest insult, negated or reported, doesn't make a text toxic."""
    return f"i{max(1, int(symbol[1:]) // 4)}" if symbol in INSULTS else symbol


def _stronger(symbol: str) -> str:
    return f"i{min(STEPS, int(symbol[1:]) + 1)}"


def _scoped(opener: str, reach: int | None) -> Fst:
    """Weaken insults and drop threats after opener: for the next reach words, or to the clause's end."""
    m = Fst()
    free = m.state()
    inside = [m.state() for _ in range(reach or 1)]
    for s in CLASSES:
        m.arc(free, s, s, 0.0, inside[0] if s == opener else free)
        for k, state in enumerate(inside):
            after = state if reach is None else inside[k + 1] if k + 1 < len(inside) else free
            m.arc(state, s, _weaker(s) if s in INSULTS else "o" if s == "threat" else s, 0.0, inside[0] if s == opener else after)
    return m


def _quoted() -> Fst:
    """Drop insults and threats between quotation marks that follow a report; an unclosed mark reaches to the clause's end."""
    m = Fst()
    free, told, inside = m.state(), m.state(), m.state()
    for s in CLASSES:
        m.arc(free, s, s, 0.0, told if s == "report" else free)
        m.arc(told, s, s, 0.0, inside if s == "quote" else told)
        m.arc(inside, s, "o" if s in INSULTS or s == "threat" else s, 0.0, told if s == "quote" else inside)
    return m


def _targeted() -> Fst:
    """Strengthen an insult of weight 3 or more up to SCOPE words after a target; weakened ones stay weak."""
    m = Fst()
    free = m.state()
    near = [m.state() for _ in range(SCOPE)]
    for s in CLASSES:
        m.arc(free, s, s, 0.0, near[0] if s == "target" else free)
        for k, state in enumerate(near):
            after = near[k + 1] if k + 1 < SCOPE else free
            m.arc(state, s, _stronger(s) if s in INSULTS and int(s[1:]) > 2 else s, 0.0, near[0] if s == "target" else after)
    return m


def _threatened() -> Fst:
    """A threat pays only if a target follows within SCOPE words; the path that bets on it and loses has no end."""
    m = Fst()
    free = m.state()
    bets = [m.state(final=None) for _ in range(SCOPE)]
    for s in CLASSES:
        m.arc(free, s, s, 0.0, free)
        for k, state in enumerate(bets):
            if s == "target":
                m.arc(state, s, s, -6.0, free)
            elif k + 1 < SCOPE:
                m.arc(state, s, s, 0.0, bets[k + 1])
    m.arc(free, "threat", "threat", 0.0, bets[0])
    return m


def _paid() -> Fst:
    """The best insult of the clause pays in full, further ones a little."""
    m = Fst()
    before, after = m.state(), m.state()
    for s in CLASSES:
        m.arc(before, s, s, 0.0, before)
        m.arc(after, s, s, -0.25 if s in INSULTS else 0.0, after)
        if s in INSULTS:
            m.arc(before, s, s, -float(s[1:]), after)
    return m


def grammar() -> Fst:
    machine = _scoped("neg", SCOPE)
    for part in (_quoted(), _scoped("report", None), _targeted(), _threatened(), _paid()):
        machine = compose(machine, part)
    return machine


class Scorer:
    """Scores whole texts; one for each task. Machine and lexicon have fixed sizes, the memo of word classes is bounded."""

    MEMO = 400_000

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.machine, self.clauses = lexicon, grammar(), {}
        self.fixed = {w: c for c, words in (("neg", NEGATIONS), ("report", REPORTS), ("target", TARGETS), ("threat", THREATS), ("quote", QUOTES)) for w in words}
        self.stem_sizes = sorted({len(s) for s in lexicon.stems}, reverse=True)
        self.plain: set[str] = set()

    def class_of(self, word: str) -> str:
        step = self.lexicon.words.get(word, 0)
        for n in self.stem_sizes:
            step = max(step, self.lexicon.stems.get(word[:n], 0))
        return f"i{step}" if step else self.fixed.get(word, "o")

    def hot(self, tokens: set[str]) -> bool:
        """Whether a word of these is an insult or a threat."""
        found = False
        for t in tokens - self.plain:
            c = self.class_of(t)
            if c[0] == "i" or c == "threat":
                found = True
            elif len(self.plain) < self.MEMO:
                self.plain.add(t)
        return found

    def clause(self, classes: list[str]) -> float:
        """Weight of a clause's match; runs of other words beyond every scope are shortened first."""
        kept: list[str] = []
        run = 0
        for c in classes:
            run = run + 1 if c == "o" else 0
            if run <= SCOPE + 1:
                kept.append(c)
        key = tuple(kept)
        if key not in self.clauses:
            if len(self.clauses) > self.MEMO // 4:
                self.clauses.clear()
            self.clauses[key] = -least_cost(self.machine, key)
        return self.clauses[key]

    def score(self, text: str | None) -> float:
        if not text:
            return 0.0
        tokens = TOKENS.findall(text.lower())
        best, matched = 0.0, 0
        if self.hot(set(tokens)):
            clause: list[str] = []
            for t in [*tokens, "."]:
                if t in ENDS:
                    if any(c[0] == "i" or c == "threat" for c in clause) and (weight := self.clause(clause)) > 0:
                        best, matched = max(best, weight), matched + 1
                    clause = []
                else:
                    clause.append("o" if t in self.plain and t not in self.fixed else self.class_of(t))
        if not matched:
            return 1 / (1 + math.exp(BIAS + 1))
        return 1 / (1 + math.exp(BIAS - best - 0.5 * math.log1p(matched - 1)))


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Insult acceptor of the labelled rows given (the caller leaves held-out rows away)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    chosen = marked.orderBy(F.xxhash64("id"), "id", "y").limit(TRAIN_ROWS)
    known = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text is not null")
    rows = first_rows(known.join(F.broadcast(chosen), "id"), TRAIN_ROWS).dropDuplicates(["y", "text"]).select("y", "text")  # TRAIN_ROWS rows of two numbers

    def counting() -> object:
        def work(batch: pa.RecordBatch) -> dict:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts[y].update(w for w in set(TOKENS.findall(text.lower())) if len(w) > 1)
                counts[y][""] += 1  # texts
            words = list(counts[0].keys() | counts[1].keys())
            return {"word": words, "t": [counts[1][w] for w in words], "c": [counts[0][w] for w in words]}

        return work

    counted = materialize(per_batch(rows, "word string, t long, c long", counting).groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "words")
    stems = counted.filter("word <> ''").select(F.explode(F.array(*map(F.lit, STEM_LETTERS))).alias("n"), "word", "t", "c").filter("length(word) >= n").groupBy(F.substr("word", F.lit(1), F.col("n")).alias("word")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("words"))
    both = counted.select("word", "t", "c", F.lit(0).cast("long").alias("words")).unionByName(stems.filter("words >= 4"))
    total = counted.agg(F.sum(F.when(F.col("word") == "", F.col("t"))).alias("t"), F.sum(F.when(F.col("word") == "", F.col("c"))).alias("c"), F.count("word").alias("n")).first()
    if not total["t"] or not total["c"]:
        return Lexicon(dict.fromkeys(FALLBACK, 6), {})
    share, bound = total["t"] / (total["t"] + total["c"]), math.log(total["n"] + 1) + 3.0
    likely = both.filter((F.col("word") != "") & (F.col("t") >= 3) & (F.col("t") > 4 * share * (F.col("t") + F.col("c"))))
    n = F.col("t") + F.col("c")
    ratio = F.col("t") * F.log(F.col("t") / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0)
    found = likely.filter(ratio >= bound).collect()
    units = {(r["word"], r["words"] > 0): (r["t"], r["c"]) for r in found}
    by_word = {w for w, stem in units if not stem}
    by_stem = {w for w, stem in units if stem}

    def covering() -> object:
        def work(batch: pa.RecordBatch) -> dict:
            out = []
            for text in batch.column("text").to_pylist():
                words = set(TOKENS.findall(text.lower()))
                out.append(sorted({w for w in words if w in by_word} | {f"{w[:n]}-" for w in words for n in STEM_LETTERS if w[:n] in by_stem and len(w) >= n}))
            return {"units": out}

        return work

    texts = [set(r["units"]) for r in per_batch(rows.filter("y = 1").select("text"), "units array<string>", covering).collect()]
    where: dict[str, set[int]] = {}
    for k, units_here in enumerate(texts):
        for u in units_here:
            where.setdefault(u, set()).add(k)
    # The fixed lexicon holds where labels do not speak against it.
    refuted = {r["word"] for r in counted.filter(F.col("word").isin(FALLBACK)).collect() if r["t"] <= 2 * share * (r["t"] + r["c"])}
    words: dict[str, int] = {w: 6 for w in FALLBACK if w not in refuted}
    stem_steps: dict[str, int] = {}
    covered = [0] * len(texts)
    while where:
        u = max(where, key=lambda u: (len(where[u]) / (1 + units[u.rstrip("-"), u[-1] == "-"][1]), u))
        explained = where.pop(u)
        fresh = sum(covered[k] == 0 for k in explained)
        if len(explained) < 2:
            break
        if fresh >= 2 or len(explained) >= max(3, AGAIN_SHARE * len(texts)):
            t, c = units[u.rstrip("-"), u[-1] == "-"]
            odds = math.log((t + 0.5) / (total["t"] + 1)) - math.log((c + 0.5) / (total["c"] + 1))
            (stem_steps if u[-1] == "-" else words)[u.rstrip("-")] = max(1, min(STEPS, round(odds)))
            done = set()
            for k in explained:
                covered[k] += 1
                if covered[k] == COVERS:
                    done.add(k)
            if u[-1] == "-":  # its words, longer stems and the shorter ones that it stands for say nothing more
                where = {v: ks for v, ks in where.items() if not v.startswith(u[:-1]) and not (v[-1] == "-" and u.startswith(v[:-1]))}
            where = {v: rest for v, ks in where.items() if (rest := ks - done)}
    return Lexicon(words, stem_steps)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # what learn() chose on the driver

    def start() -> object:
        scorer = Scorer(shared.value)
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": [scorer.score(t) for t in batch.column("text").to_pylist()]}

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, score double", start)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id as text) mod 3 is 1 are held out of learning."""
    lexicon = learn(docs, labels.filter(fold_of("doc_id", 3) != 1))
    return score(docs, lexicon).select("doc_id", (F.coalesce(fold_of("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
