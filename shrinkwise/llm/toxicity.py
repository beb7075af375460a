"""Toxicity of texts: a learned lexicon, matched with misspellings, and hits weighed by what stands around them."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.llm.common import fields, map_batches
from shrinkwise.llm.learning import labelled_sample, logistic_fit, sigmoid
from shrinkwise.session import saved_table

#: Labelled files of each label from which the lexicon and the scorer are learned, at most.
SAMPLE_ROWS = 3000
#: Terms in the lexicon at most, and terms, or words behind a beginning, that are looked at for it; toxic files that have a term, and its evidence (the G statistic of its uses), at least.
LEXICON_TERMS = 400
CANDIDATES = 20_000
LEAST_FILES = 4
LEAST_EVIDENCE = 40.0
LEAST_ODDS = 1.5
#: Uses of a term in one file that count as evidence, so that a text that repeats one line does not outweigh others.
COUNTED_USES = 8
#: A word's beginnings of these lengths are candidates besides the word.
STEM_LENGTHS = range(3, 9)
#: Words of at least this length match with one letter added, dropped or changed, at a lower weight.
MISSPELLED_FROM = 5
MISSPELLED_WEIGHT = 0.6
#: Words before and after a hit that are looked at.
CONTEXT = 6
QUOTED_WEIGHT = 0.25
ADDRESSED_WEIGHT = 1.25
REMEMBERED_WORDS = 1 << 18

# Quotation marks, words that report speech, and words that address someone.
OPENING_MARKS = "\"“”„«»‹›‘"
CLOSING_MARKS = "\"“”«»‹›’"
REPORTING = frozenset("said says quote quoted quotes quoting word words term called reported wrote slur sagte zitiert wort dit cité mot dijo citado palabra".split())
ADDRESSING = frozenset("you your you're youre ur du dich dein ihr tu toi vous votre tú te usted eres".split())
# Digits and signs that stand for letters.
LETTER_SIGNS = str.maketrans("0134578@$!", "oieastbasi")

_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon terms with their weights, and the weights of the features, the constant last."""

    lexicon: dict[str, float]
    weights: np.ndarray


def fit_toxicity(
    files: DataFrame, labels: DataFrame, rel_path: str = "rel_path", text: str = "text", toxic: str = "toxic", sample_rows: int = SAMPLE_ROWS
) -> ToxicityModel:
    """Learns from `labels` (rel_path, toxic), 1 for toxic, and the texts of those files.

    From at most `sample_rows` files of each label, words and word beginnings that toxic texts use far more
    often become the lexicon, with log odds as weights; a logistic regression on the hits in the same files
    makes scores. Labels that are null or neither 0 nor 1, and null paths, are left out. Without labels of both
    kinds nothing is learned: every score is near 1 if all labels are 1, else near 0.
    """
    sample = labelled_sample(files, labels, rel_path, text, toxic, sample_rows)
    lexicon = learn_lexicon(sample)
    return ToxicityModel(lexicon, _fit(sample, lexicon))


def score_toxicity(files: DataFrame, model: ToxicityModel, rel_path: str = "rel_path", text: str = "text") -> DataFrame:
    """Toxicity of every file's text from 0 to 1: (rel_path, score), a row per input row. Only the text counts.

    Every distinct word is run through the lexicon's trie: as it is, with signs read as letters, and, for
    longer words, as a Levenshtein automaton of distance one intersected with the trie. A hit weighs less
    among quotation marks or after a reporting word, more beside a word that addresses someone. The sum of
    the hits' weights, alone and per word, goes through the model's logistic regression.

    Null and empty texts are scored as texts without hits. Rows that share a rel_path are scored each by its
    own text; rel_path may be any column, also a struct. Other columns are ignored. No rows give no rows.
    """
    weights = model.weights

    def run(batch: pa.RecordBatch, matcher: Matcher) -> dict[str, object]:
        x = np.array([features(t or "", matcher) for t in batch.column(1).to_pylist()])
        return {rel_path: batch.column(0), "score": sigmoid(x @ weights[:-1] + weights[-1])}

    lexicon = model.lexicon
    return map_batches(files.select(rel_path, text), run, fields(files, [rel_path], "score double"), lambda: Matcher(lexicon))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms and their weights, the log of how much more often toxic texts use them; a term that ends in *
    stands for a word's beginning, and the sample's words that begin so are terms with the same weight."""

    def run(batch: pa.RecordBatch) -> dict[str, object] | None:
        seen: Counter[tuple[str, int]] = Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = Counter(filter(None, (plain(w) for w in text.split())))
            terms = Counter(words)
            for word, n in words.items():
                for k in STEM_LENGTHS:
                    if len(word) >= k:
                        terms[word[:k] + "*"] += n
            for term, n in terms.items():
                seen[term, y] += 1
                seen[term, y + 2] += min(n, COUNTED_USES)
            seen["", y] += 1
            seen["", y + 2] += sum(min(n, COUNTED_USES) for n in words.values())
        if not seen:
            return None
        return {"term": [t for t, _ in seen], "kind": [k for _, k in seen], "n": list(seen.values())}

    totals = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(totals) < 2:
        return {}
    counted = map_batches(sample.select("text", "label").repartition(32), run, fields(sample, [], "term string, kind int, n bigint"))
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(("once_0", "once_1", "all_0", "all_1"))]

    terms = saved_table(counted.groupBy("term").agg(*kinds), "terms")
    words = terms.where("term = ''").first()
    if words is None:
        return {}
    rates = [(F.col(f"all_{y}") + 0.5) / (words[f"all_{y}"] + 1.0) for y in (0, 1)]
    share = words["all_1"] / (words["all_0"] + words["all_1"])
    both = F.col("all_0") + F.col("all_1")
    gain = lambda y, part: F.when(F.col(f"all_{y}") > 0, F.col(f"all_{y}") * F.log(F.col(f"all_{y}") / (both * part))).otherwise(0.0)
    scored = terms.where(f"term != '' and once_1 >= {LEAST_FILES}")
    scored = scored.select("term", (2 * (gain(1, share) + gain(0, 1 - share))).alias("g"), F.log(rates[1] / rates[0]).alias("odds"))
    best = scored.where((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= LEAST_EVIDENCE)).orderBy(F.desc("g"), "term").limit(CANDIDATES).collect()
    chosen: dict[str, float] = {}
    for row in sorted(best, key=lambda r: (-round(r["g"], 6), r["term"].endswith("*"), -len(r["term"]))):
        term = row["term"]
        if not any(_covers(c, term) or _covers(term, c) for c in chosen) and len(chosen) < LEXICON_TERMS:
            chosen[term] = row["odds"]
    # The automaton goes to whole words: those that toxic texts have behind a beginning get its weight, and no other match.
    stems = {k: [c for c in chosen if c.endswith("*") and len(c) == k + 1] for k in STEM_LENGTHS}
    begun = [F.concat(F.substring("term", 1, k), F.lit("*")) for k in STEM_LENGTHS]
    behind = [F.when(b.isin(stems[k]), b) for k, b in zip(STEM_LENGTHS, begun, strict=True) if stems[k]]
    if behind:
        words = terms.where(f"once_1 > 0 and length(term) >= {MISSPELLED_FROM} and not endswith(term, '*')").where(F.log(rates[1] / rates[0]) >= LEAST_ODDS)
        words = words.select("term", "once_1", F.coalesce(*behind).alias("stem")).where("stem is not null")
        for word, _, stem in words.orderBy(F.desc("once_1"), "term").limit(CANDIDATES).collect():
            chosen[word] = chosen[stem]
    return chosen


def _covers(term: str, other: str) -> bool:
    """Whether a beginning stands at the beginning of another term; a whole word covers no other."""
    return term.endswith("*") and other.startswith(term[:-1])


def plain(word: str) -> str:
    """Lower case, without what is no letter at the ends."""
    return _EDGES.sub("", word.lower())


def _fit(sample: DataFrame, lexicon: dict[str, float]) -> np.ndarray:
    def run(batch: pa.RecordBatch, matcher: Matcher) -> dict[str, object]:
        return {"x": [features(t, matcher) for t in batch.column(0).to_pylist()], "label": batch.column(1), "weight": batch.column(2)}

    rows = map_batches(sample.select("text", "label", "weight"), run, fields(sample, [], "x array<double>, label int, weight double"), lambda: Matcher(lexicon)).collect()
    if not rows:
        return np.append(np.zeros(FEATURES), -40.0)
    x, y, weight = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows])
    if y.min() == y.max():
        return np.append(np.zeros(FEATURES), 40.0 if y.min() else -40.0)
    return logistic_fit(x, y, weight)


FEATURES = 6


def features(text: str, matcher: Matcher) -> list[float]:
    """Of a text: weighed hits in all, per thousand words, and both; the strongest, and what is strong in it; length."""
    words = text.split()
    hits = matcher.hits(words)
    each = [w * context_weight(words, i) for i, w in hits]
    total, most = sum(each), max(each, default=0.0)
    rate = math.log1p(1000 * total / (len(words) + 20))
    return [math.log1p(total), rate, math.log1p(total) * rate / 5, most / 4, max(0.0, most - 5), math.log1p(len(words)) / 5]


def context_weight(words: list[str], at: int) -> float:
    """Lower for a quoted or reported word than for a used one, higher beside a word of address."""
    before, after = words[max(0, at - CONTEXT) : at], words[at + 1 : at + 1 + CONTEXT]
    word = words[at]
    opened = word[0] in OPENING_MARKS or any(w[0] in OPENING_MARKS and w[-1] not in CLOSING_MARKS for w in before)
    closed = word.rstrip(".,;:!?")[-1:] in tuple(CLOSING_MARKS) or any(w.rstrip(".,;:!?")[-1:] in tuple(CLOSING_MARKS) for w in after)
    if (opened and closed) or any(plain(w) in REPORTING for w in before[-2:]):
        return QUOTED_WEIGHT
    near = [*before[-3:], *after[:3]]
    return ADDRESSED_WEIGHT if any(plain(w) in ADDRESSING for w in near) else 1.0


class Matcher:
    """Weights of words by the lexicon trie; every distinct word is looked up once and remembered."""

    def __init__(self, lexicon: dict[str, float]):
        self.trie: dict = {}
        self.halves: dict[int, set[str]] = {}
        self.known: dict[str, float] = {}
        for term, weight in lexicon.items():
            stem, node = term.rstrip("*"), self.trie
            for c in stem:
                node = node.setdefault(c, {})
            node["begins" if term.endswith("*") else "is"] = weight
            if not term.endswith("*") and len(stem) >= MISSPELLED_FROM:
                # One change leaves one half of a term as it was, at the word's start or at its end.
                self.halves.setdefault(len(stem), set()).update((stem[: len(stem) // 2] + ">", "<" + stem[len(stem) // 2 :]))

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Places and weights of the words that match."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        known, out = self.known, []
        for i, word in enumerate(words):
            weight = known.get(word)
            if weight is None:
                weight = known[word] = self.weight(word)
            if weight:
                out.append((i, weight))
        return out

    def weight(self, word: str) -> float:
        letters = plain(word)
        weight = self.exact(letters)
        if weight or not letters:
            return weight
        signs = word.lower().strip(".,;:?()[]").translate(LETTER_SIGNS)
        if signs != word.lower() and signs.isalpha() and (weight := self.exact(signs)):
            return weight * MISSPELLED_WEIGHT
        for size in range(len(letters) - 1, len(letters) + 2):
            halves, k = self.halves.get(size, ()), size // 2
            if letters[:k] + ">" in halves or "<" + letters[k - size :] in halves:
                return self.misspelled(letters) * MISSPELLED_WEIGHT
        return 0.0

    def exact(self, letters: str) -> float:
        node, best = self.trie, 0.0
        for c in letters:
            if (node := node.get(c)) is None:
                return best
            best = max(best, node.get("begins", 0.0))
        return max(best, node.get("is", 0.0))

    def misspelled(self, letters: str) -> float:
        """Best whole term that the automaton of `letters` accepts with one change at most."""
        best, stack = 0.0, [(self.trie, 0, start(letters))]
        while stack:
            node, depth, state = stack.pop()
            for c, child in node.items():
                if len(c) == 1 and (after := step(letters, state, c)):
                    if depth + 1 >= MISSPELLED_FROM and "is" in child and accepts(letters, after):
                        best = max(best, child["is"])
                    stack.append((child, depth + 1, after))
        return best


State = frozenset[tuple[int, int]]


def start(word: str) -> State:
    """Levenshtein automaton of distance one: letters of the word read so far, and changes made."""
    return frozenset({(0, 0), (1, 1)} if word else {(0, 0)})


def step(word: str, state: State, letter: str) -> State:
    after = set()
    for i, changes in state:
        if i < len(word) and word[i] == letter:
            after.add((i + 1, changes))
            if not changes and i + 1 < len(word):
                after.add((i + 2, 1))
        if not changes:
            after |= {(i, 1), (i + 1, 1)} if i < len(word) else {(i, 1)}
    return frozenset(after)


def accepts(word: str, state: State) -> bool:
    return any(i == len(word) or (i == len(word) - 1 and not changes) for i, changes in state)
