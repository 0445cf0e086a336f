"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model over them, a linear classifier on its posterior labels.

Voters say toxic, say clean, or say nothing. Toxic is said by each word of the lexica, by patterns (abuse in the second
person, threats, masked and stretched words, shouting) and by word stems that stand in a text once, twice or three times,
as a bounded sample of labelled rows shows them almost only in toxic texts. Clean is said where none of these speaks, by polite words and by the marks of licences and
references. The label model has each voter's rates in either hidden class, fitted by expectation maximisation to the
votes on a bounded sample of rows, most of them without labels. Where a row has a label, that is one more voter, whose
rates are estimated like any other's: voters that never meet, as those of two languages, could else be told from chance
by nothing. What two voters share within a class beyond chance lowers the weight of both. The posteriors train a
logistic regression over the votes but for the label, which is what scores documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, raw_texts, remainder, text_of, written
from quire.llm.quality import texts_of, training_rows

LEXICON = [
    "idiot", "moron", "imbecile", "stupid", "dumbass", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "filthy",
    "vermin", "retard", "bastard", "bitch", "asshole", "whore", "slut", "faggot", "nigger", "cunt", "dickhead", "wanker", "twat", "shithead",
    "fucker", "motherfucker", "braindead", "lowlife", "scumbag", "dipshit", "jackass", "degenerate", "subhuman", "parasite", "garbage",
    "trottel", "arschloch", "abschaum", "wichser", "hurensohn", "schlampe", "missgeburt", "vollidiot", "widerlich", "erbärmlich", "wertlos", "versager", "fotze",
    "imbécile", "connard", "connasse", "salope", "enculé", "abruti", "crétin", "débile", "ordure", "minable", "pathétique", "dégueulasse", "bâtard",
    "idiota", "imbécil", "estúpido", "estúpida", "gilipollas", "cabrón", "mierda", "asqueroso", "patético", "escoria", "payaso", "pendejo", "maricón",
]
#: Letters that may follow a word of the lexicon.
ENDING = 3
_INSULT = "|".join(LEXICON)
#: Patterns that say toxic, and those that say clean.
TOXIC_PATTERNS = [
    rf"\b(?:you|your|u r|tu es|vous êtes|du bist|ihr seid|eres|sois)\b(?:\W+\w+){{0,3}}?\W+(?:{_INSULT})",
    r"\b(?:kill yourself|kys|go die|drop dead|shut up|get lost|go to hell|ferme ta gueule|ta gueule|halt die fresse|verpiss dich|vete al diablo|cállate)\b",
    r"\b(?:i(?:'ll| will| am going to)) (?:kill|hurt|hunt|destroy|find) (?:you|them|him|her)\b",
    r"\b[a-z]{1,6}[*@]{2,}[a-z]{1,6}\b",
    r"([a-zà-ÿ])\1{4,}",
    r"[!?]{4,}",
]
CLEAN_PATTERNS = [
    r"\b(?:please|thank(?:s| you)|sorry|welcome|merci|s'il vous plaît|bitte|danke|gracias|por favor)\b",
    r"\b(?:copyright|licen[cs]ed? under|all rights reserved|redistribution|warranty|isbn|doi|et al)\b",
]
#: Labelled rows that stems are sought in, rows whose votes the label model sees; letters of the shortest stem; toxic texts that a clean one outweighs; share of toxic texts among those with a stem.
SAMPLE, UNLABELLED, SHORTEST, COST, PURE = 20_000, 20_000, 3, 2, 0.9
#: Times that a stem may have to stand in a text.
TIMES = 3
#: Distinct stems that a worker counts before it passes them on.
HELD = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def stems_of(text: str) -> set[str]:
    """The beginnings of a text's words, from SHORTEST letters up to the whole word, each led by 1, and by 2 up to TIMES if so many words begin with it; of letters in a row beyond 64, as in texts without spaces, the first 64."""
    counts: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        for k in range(SHORTEST, min(len(w), 64) + 1):
            counts[w[:k]] += n
    return {f"{k}{stem}" for stem, n in counts.items() for k in range(1, min(n, TIMES) + 1)}


def _count_stems(texts: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """(stem, n): texts that have each stem (of those wanted), summed before the shuffle; at the empty stem, what all texts have in sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["stem", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                found = stems_of(raw.decode("utf-8", "replace"))
                counts[""] += len(found)
                counts.update(found if wanted is None else found & wanted)
                if len(counts) > HELD:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


class Voters:
    """The voters: stems, then the lexicon's words, toxic patterns, clean patterns, and the lack of all toxic ones."""

    def __init__(self, stems: list[str]):
        self.stems = [s for s in stems if s[0] != "1" or s[1:] not in set(LEXICON)]
        n, m, p, q = len(self.stems), len(LEXICON), len(TOXIC_PATTERNS), len(CLEAN_PATTERNS)
        self.size, self.words, self.patterns, self.clean, self.lacks = n + m + p + q + 1, n, n + m, n + m + p, n + m + p + q
        self.sign = np.array([1] * (n + m + p) + [-1] * (q + 1))
        self.machine = ahocorasick.Automaton()
        speakers: dict[str, list[tuple[int, int]]] = {}  # of each string, the voters and the times that they ask
        for i, s in enumerate([*self.stems, *(f"0{w}" for w in LEXICON)]):
            speakers.setdefault(s[1:], []).append((i, int(s[0])))
        for s, who in speakers.items():
            self.machine.add_word(s, (who, len(s)))
        self.machine.make_automaton()
        self.regex = [re.compile(r) for r in [*TOXIC_PATTERNS, *CLEAN_PATTERNS]]

    def __getstate__(self) -> list[str]:
        return self.stems

    def __setstate__(self, stems: list[str]) -> None:
        self.__init__(stems)

    def __call__(self, text: str) -> list[int]:
        """The voters that say something of a text."""
        text, out, counts = text.lower(), set(), Counter()
        for end, (who, n) in self.machine.iter(text):
            if end == n - 1 or not text[end - n].isalpha():
                for i, times in who:
                    counts[i] += 1
                    if times and counts[i] == times or not times and (not text[end + 1 : end + 2 + ENDING].isalpha() or len(text) < end + 2 + ENDING):
                        out.add(i)
        words = any(i >= self.words for i in out)  # the first pattern needs a word of the lexicon
        out.update(k + self.patterns for k, r in enumerate(self.regex) if (k or words) and r.search(text))
        if not any(i < self.clean for i in out):
            out.add(self.lacks)
        return sorted(out)


@dataclass
class ToxicityModel:
    voters: Voters
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        total = self.bias + float(sum(self.weights[i] for i in self.voters(text)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


def cover(rows: list[set[int]], clean: list[int]) -> list[int]:
    """The candidates that a greedy cover takes, by the toxic rows that each adds less COST times the clean ones that have it, as long as that is over 0 (ties: the first)."""
    taken, done = [], set()
    heap = [(COST * c - len(r), i) for i, (r, c) in enumerate(zip(rows, clean))]
    heapq.heapify(heap)
    while heap:
        _, i = heapq.heappop(heap)
        now = COST * clean[i] - len(rows[i] - done)
        if now >= 0:
            continue
        if heap and (now, i) > heap[0]:
            heapq.heappush(heap, (now, i))
            continue
        taken.append(i)
        done |= rows[i]
    return taken


@dataclass
class LabelModel:
    """The odds of the toxic class: prior, what each voter adds when it speaks, and how far two voters are tied; a voter's say is shared with those tied to it that speak of the same row."""

    prior: float
    on: np.ndarray
    tied: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = self.prior + (votes * self.on / (1 + votes @ self.tied)).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def label_model(votes: np.ndarray, weight: np.ndarray, sign: np.ndarray, rounds: int = 40) -> LabelModel:
    """Fit to distinct vote patterns with their counts, by expectation maximisation from the sum of votes; sign: what each voter says.

    A voter that keeps silent says nothing. One whose rates are the wrong way round for what it says has no weight. Two
    voters that say the same are tied by the positive correlation of their residuals over both classes.
    """
    n, m = votes.shape
    said, tied = votes @ sign, np.zeros((m, m))
    p = np.where(said > 0, 0.9, np.where(said < 0, 0.02, 0.3))
    prior, on = 0.0, np.zeros(m)
    for turn in range(rounds):
        w1, w0 = weight * p, weight * (1 - p)
        rate1 = (w1 @ votes + 0.05) / (w1.sum() + 0.1)
        rate0 = (w0 @ votes + 0.05) / (w0.sum() + 0.1)
        if turn % 10 == 9:
            cov = np.zeros((m, m))
            for w, rate in ((w1, rate1), (w0, rate0)):
                off = votes - rate
                cov += (off * w[:, None]).T @ off
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            tied = np.clip(cov / np.outer(sd, sd), 0, 1) * (sign[:, None] == sign[None, :])
            tied[tied < 0.1] = 0
            np.fill_diagonal(tied, 0)
        prior = math.log((w1.sum() + 0.5) / (w0.sum() + 0.5))
        on = np.log(rate1 / rate0)
        on = np.where(on * sign > 0, on, 0)
        p = LabelModel(prior, on, tied).posterior(votes)
    return LabelModel(prior, on, tied)


def logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, decay: float = 0.02, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a regression on soft labels, by Newton's steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(z.shape[1], decay)
    ridge[-1] = 1e-3
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (q - p)) + ridge * b
        hess = (z * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return b[:-1], float(b[-1])


def mined_stems(rows: DataFrame) -> list[str]:
    """Stems that rows (text, y) show almost only in toxic texts; what the driver gets grows with the sample's words alone."""
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = min(0.5, max(1e-3, size.get(1, 0) / max(1, sum(size.values()))))
    toxic = written(_count_stems(rows.filter("y = 1")), "toxic")
    total = sum(r["n"] for r in toxic.filter("stem = ''").collect()) / base
    # So many texts that, of all stems in as many (total / t at most), less than half a one is in toxic texts alone by chance.
    least = next((t for t in range(2, 60) if total / t * base**t < 0.5), 60)
    first = {r["stem"]: r["n"] for r in toxic.filter((F.col("stem") != "") & (F.col("n") >= least)).collect()}
    clean = {r["stem"]: r["n"] for r in _count_stems(rows.filter("y = 0"), frozenset(first)).collect()}
    pure = sorted((s for s, n in first.items() if n >= PURE * (n + clean.get(s, 0))), key=lambda s: (-first[s], s[0], len(s), s))
    place = {s: i for i, s in enumerate(pure)}

    @F.arrow_udf("array<int>")
    def which(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(place[s] for s in stems_of(t.decode("utf-8", "replace")) if s in place) for t in raw_texts(texts)], pa.list_(pa.int32()))

    found: list[set[int]] = [set() for _ in pure]
    for number, r in enumerate(rows.filter("y = 1").select(which("text").alias("v")).collect()):
        for i in r["v"]:
            found[i].add(number)
    return [pure[i] for i in cover(found, [clean.get(s, 0) for s in pure])]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, sample: int = SAMPLE, unlabelled: int = UNLABELLED, doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """A model that learns labels from rows outside the held fold alone.

    Stems come from ``sample`` labelled ids, the label model from the votes on these and on ``unlabelled`` rows outside the
    held fold (those with the least hashes), whose labels it doesn't see. The driver gets counts of stems and votes,
    no texts. Without labelled rows, or without toxic ones, the voters are the lexicon and the patterns.
    """
    rows = written(training_rows(docs, labels, label, folds, held, sample, doc_id, text).dropDuplicates(["text", "y"]), "sample")
    voters = Voters(mined_stems(rows))

    @F.arrow_udf("array<int>")
    def vote(texts: pa.Array) -> pa.Array:
        return pa.array([voters(t.decode("utf-8", "replace")) for t in raw_texts(texts)], pa.list_(pa.int32()))

    ids = docs.select(F.col(doc_id).cast("long").alias("__id")).filter(F.col("__id").isNotNull() & (remainder("__id", folds) != held)).distinct()
    others = texts_of(docs, ids.orderBy(F.xxhash64("__id"), "__id").limit(unlabelled), doc_id, text).select("text", F.lit(None).cast("int").alias("y"))
    found = rows.select("text", "y").unionByName(others).select(vote("text").alias("v"), "y").collect()
    patterns = Counter((tuple(r["v"]), r["y"]) for r in found) or Counter({((voters.lacks,), None): 1})
    full = np.zeros((len(patterns), voters.size + 2))  # the last two: a label says toxic, or clean
    for i, (v, y) in enumerate(patterns):
        full[i, [*v, *([voters.size + 1 - y] if y is not None else [])]] = 1
    weight = np.array(list(patterns.values()), float)
    model = label_model(full, weight, np.r_[voters.sign, 1, -1])
    posterior = model.posterior(full)
    n = voters.size
    x, model = full[:, :n], LabelModel(model.prior, model.on[:n].copy(), model.tied[:n, :n])
    seen = x.sum(0) > 0
    said = seen & (voters.sign > 0)
    words = np.arange(voters.size)
    lexicon = (words >= voters.words) & (words < voters.patterns)
    if not (said & lexicon).any():  # no case of any word: each speaks for itself
        model.on[lexicon] = 4.0 - model.prior
    else:  # a word without a case speaks as the lexicon does on average
        model.on[lexicon & ~seen] = model.on[said & lexicon].mean()
    alone = np.eye(voters.size)[said | lexicon]
    weights, bias = logistic(np.vstack([x, alone]), np.concatenate([posterior, model.posterior(alone)]), np.concatenate([weight, np.full(len(alone), 3.0)]))
    return ToxicityModel(voters, weights, bias)


def score(text: Column, model: ToxicityModel) -> Column:
    """The probability of label 1 for a text column; null counts as empty."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.decode("utf-8", "replace")) for t in raw_texts(texts)], pa.float64())

    return scored(text_of(text))


def classify(docs: DataFrame, model: ToxicityModel, folds: int = 5, held: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, repeated ones too.

    A null id is in no fold; a null text is an empty one, which is scored like any other; texts are scored whole, however
    long; scores of just one half are toxic; an empty table gives no rows; other columns aren't read.
    """
    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), score(F.col(text), model).alias("score"))
    return scored.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs without rows that score one half or more; columns stay as they are, whatever their names. Null and empty texts are scored like any other; repeated rows share their fate."""
    name = fresh(docs.columns, "toxicity_score")
    return docs.withColumn(name, score(F.col(text), model)).filter(F.col(name) < 0.5).drop(name)
