"""Language ID by hierarchical discrimination.

A linear one-versus-rest stage predicts the language family; inside the family
one-versus-one linear support vector machines, trained with the hinge loss in
numpy on hashed character and word n-grams, vote between its languages. All
machines are columns of one table of bucket weights, so a document is scored in
one pass without a shuffle.

The training sample is bounded: about `per_lang` documents of each language,
of all languages, chosen by a hash of the id.

Defined results: `und` with score 0 for a null text, a text without letters, or
when nothing was learned; a family with one language needs no second stage;
ties between languages go to the first by name; repeated rows each give a row;
rows with a null lang teach nothing; very long
texts are scored whole; numerals such as a half or a roman one are no letters;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import itertools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.common import is_held_out, table
from canopia.llm.features import Grams, sampled, scored, training_vectors

GRAMS = Grams(chars=(1, 2, 3), words=(1,), bits=16, lower=True)
PER_LANG = 1000
EPOCHS, REGULAR, SCALE = 8, 1e-5, 30.0
#: Letters, and numerals that are none.
LETTER = re.compile(r"[^\W\d_]")
#: Language families. A language in none of them is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


def svm(vectors: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, bits: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias by averaged stochastic subgradient steps; sign is 1 or -1."""
    rng = np.random.default_rng(seed)
    w, bias, scale, t = np.zeros(1 << bits), 0.0, 1.0, 0
    half = {s: 0.5 * len(sign) / max(1, (sign == s).sum()) for s in (1, -1)}  # both sides weigh the same
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sign)):
            t += 1
            lr = 1 / (1 + REGULAR * 10 * t) * 0.5
            bucket, share = vectors[i]
            margin = sign[i] * (SCALE * scale * (w[bucket] @ share) + bias)
            scale *= 1 - lr * REGULAR
            if margin < 1:
                step = lr * sign[i] * half[sign[i]]
                w[bucket] += step * SCALE / scale * share
                bias += 0.1 * step
    return w * scale * SCALE, bias


class Machines:
    """The learned columns: one a family (if there are several), then one a pair of languages in a family."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        self.families = sorted({family(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family(x) == f] for f in self.families}
        self.pairs = [(a, b) for f in self.families for a, b in itertools.combinations(self.members[f], 2)]
        self.weights, self.bias = np.zeros((1, 1), np.float32), np.zeros(1)

    def fit(self, vectors, labels: np.ndarray, bits: int) -> None:
        columns = []
        kin = np.array([family(x) for x in labels])
        for f in self.families if len(self.families) > 1 else []:
            columns.append(svm(vectors, np.where(kin == f, 1, -1), bits))
        for a, b in self.pairs:
            rows = np.flatnonzero((labels == a) | (labels == b))
            columns.append(svm([vectors[i] for i in rows], np.where(labels[rows] == a, 1, -1), bits))
        if columns:
            self.weights = np.column_stack([w for w, _ in columns]).astype(np.float32)
            self.bias = np.array([b for _, b in columns])

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of margins."""
        chance = 1 / (1 + np.exp(-np.clip(margins, -50, 50)))
        n = len(margins)
        if len(self.families) > 1:
            kin = np.argmax(margins[:, : len(self.families)], axis=1)
            sure = chance[np.arange(n), kin]
            pairs = chance[:, len(self.families) :]
        else:
            kin, sure, pairs = np.zeros(n, int), np.ones(n), chance
        best, score = np.full(n, "", object), np.zeros(n)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(kin == k)
            own = self.members[f]
            votes = np.zeros((len(rows), len(own)))
            for j, (a, b) in enumerate(self.pairs):
                if a in own:
                    votes[:, own.index(a)] += pairs[rows, j]
                    votes[:, own.index(b)] += 1 - pairs[rows, j]
            win = np.argmax(votes, axis=1)
            best[rows] = np.array(own, object)[win]
            score[rows] = sure[rows] * (votes[np.arange(len(rows)), win] / (len(own) - 1) if len(own) > 1 else 1)
        return best.tolist(), score


def fit(docs: DataFrame, per_lang: int = PER_LANG, grams: Grams = GRAMS) -> Machines | None:
    """The machines from docs (doc_id, text, lang), already limited to rows that may teach."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string").alias("label"))
    counts = known.groupBy("label").count().orderBy(F.desc("count"), "label").collect()
    if not counts:
        return None
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min(1.0, per_lang / r["count"]))])
    few = known.where(sampled(F.coalesce(F.element_at(rates, F.col("label")), F.lit(0.0)))).limit(2 * per_lang * len(counts))
    _, labels, vectors = training_vectors(few, grams, "label")
    machines = Machines(sorted(set(labels.tolist())))
    machines.fit(vectors, labels, grams.bits)
    return machines


def predict(docs: DataFrame, machines: Machines | None, grams: Grams = GRAMS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, keep...), a row per row of docs (doc_id, text)."""

    def finish(texts, total, n):
        if machines is None:
            return [["und"] * len(texts), np.zeros(len(texts))]
        best, score = machines.decide(total / np.maximum(n, 1)[:, None] + bias)
        lettered = np.array([has_letter(t) for t in texts], bool)
        return [[b if x else "und" for b, x in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)]

    weights = machines.weights if machines else np.zeros((1, 1), np.float32)
    bias = machines.bias if machines else 0.0
    if len(weights) == 1:
        weights = np.zeros((1 << grams.bits, 1), np.float32)
    if machines:
        machines = copy.copy(machines)
        machines.weights = None  # the weights travel as a broadcast
    return scored(docs, finish, "lang_pred string, score double", grams, weights, keep)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: language of every document, learned from rows whose crc32 modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    machines = fit(docs.where(~is_held_out(F.col("doc_id"), 4, 2)))
    found = predict(docs.select("doc_id", "text"), machines)
    return found.select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
