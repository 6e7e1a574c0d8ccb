"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows around what they find.

The lexicon is learned from a bounded labelled sample outside the held-out fold: words, and stems of 4 to 6 letters, that
toxic documents hold far more often than others, with their log odds as weights. Words enter a trie; its product with the
Levenshtein automaton (one edit, two for words of nine letters or more, a swap of neighbours counting as one) is made
deterministic as its states are met, so a word of a text costs a look-up a letter, and most die after a few. Strings
that the clean sample holds at least as often as the toxic one are plain words and no misspellings; every lexicon word
keeps its other ones. Stems match exactly at a word's start; a further set of stems counts only where a text has at least
two words that start so, since one such word is common in clean texts too.

A match's weight counts in full, or a fifth less where misspelt, or three tenths inside quotation marks: quotation is not
abuse. A window of six words on either side of a match adds up the weights in it, and half as much again where it
addresses someone. Sums, densities and the best window, and sums of matches without an edit, go through boosted trees,
rising in each of them, for the score.

The lexicon is bounded by the sample: a term is in at least ``least_share`` of its toxic documents, so there are at most
``1 / least_share`` times as many as such a document has different words and stems. Lexicon, automaton and trees are sent to the tasks; scoring is one
pass over whole texts without a shuffle. Defined results: null and empty texts have no match and get the score of such;
repeated rows get one result row each; without labelled rows of both classes every score is 0, or 1 if all known are toxic;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import written
from ._tables import held_out, labelled_sample, table
from .quality_rules import Trees, fit

STEMS = (4, 5, 6)
#: Letters of the shortest string that may be a misspelling: a word of four letters may lack one.
SHORTEST = 3
MISSPELT, QUOTED, WINDOW = 0.8, 0.3, 6
#: Words that address someone, in the corpus's languages.
ADDRESS = frozenset("you your you're u ur tu toi vous ton ta tes du dich dir ihr euch dein deine tú ti eres usted ustedes".split())
_EDGES = "".join(chr(c) for c in range(33, 48)) + "".join(chr(c) for c in [*range(58, 65), *range(91, 97), *range(123, 127)]) + "«»“”„‘’…"
_OPEN, _CLOSE = "«“„", "»”"
FEATURES = 8


def norm(word: str) -> str:
    return word.strip(_EDGES).lower()


class Automaton:
    """The trie of words times the Levenshtein automaton, determinised as met."""

    MOST_STATES = 100_000

    def __init__(self, words: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for w in words:
            node = 0
            for c in w:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word.append(None)
                node = self.child[node][c]
            self.word[node] = w
        self.weight = words
        # the edits that any word below a node may have
        self.most = [-1] * len(self.child)
        for w in words:
            node, e = 0, self.edits(w)
            self.most[0] = max(self.most[0], e)
            for c in w:
                node = self.child[node][c]
                self.most[node] = max(self.most[node], e)
        self.swaps: dict[str, list[str]] = {}
        for w in words:
            self.swaps.setdefault("".join(sorted(w)), []).append(w)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state(self._closed({(0, 0)}))

    @staticmethod
    def edits(word: str) -> int:
        return 0 if len(word) < 4 else 1 if len(word) < 9 else 2

    def _closed(self, items: set) -> frozenset:
        """With letters of the lexicon skipped, and only the least edits at each node."""
        least: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, e = todo.pop()
            if e <= self.most[node] and e < least.get(node, 3):
                least[node] = e
                todo += [(m, e + 1) for m in self.child[node].values()]
        return frozenset(least.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.number:
            self.number[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
        return self.number[items]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            out.add((node, e + 1))
            for d, m in self.child[node].items():
                out.add((m, e if c == d else e + 1))
        to = self.moves[state][c] = self._state(self._closed(out))
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        """The lexicon word of fewest edits, then of greatest weight, with its edits."""
        if word in self.weight:
            return word, 0
        if len(self.sets) > self.MOST_STATES:
            self._clear()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if not self.sets[state]:
                break
        found = [(e, -self.weight[w], w) for node, e in self.sets[state] if (w := self.word[node]) and e <= self.edits(w)]
        for w in self.swaps.get("".join(sorted(word)), ()):
            if len(w) >= 4 and len([i for i in range(len(w)) if w[i] != word[i]]) == 2 and any(word[:i] + word[i + 1] + word[i] + word[i + 2 :] == w for i in range(len(w) - 1)):
                found.append((1, -self.weight[w], w))
        if not found:
            return None
        e, _, w = min(found)
        return w, e


class Lexicon:
    """Weights of words and stems; matches of a text's words."""

    MOST_KNOWN = 300_000

    def __init__(self, words: dict[str, float], stems: dict[str, float], plain: frozenset[str] = frozenset(), pairs: dict[str, float] | None = None):
        """``pairs``: stems that count where at least two words of a text start so."""
        self.words, self.stems, self.plain, self.pairs = words, stems, plain, pairs or {}
        self.automaton = Automaton(words)
        self.heads = {s[: STEMS[0]] for s in (*stems, *self.pairs)}
        #: Of words met: their match and their stem of ``pairs``, or None where they have neither.
        self.known: dict[str, tuple[tuple[float, int] | None, str | None] | None] = {}

    def _look(self, w: str) -> tuple[float, int] | None:
        """(weight, edits) of a word in ``norm`` form."""
        best = None
        if len(w) >= SHORTEST:
            if w in self.words:
                best = (self.words[w], 0)
            elif w not in self.plain and (found := self.automaton.find(w)) is not None:
                best = (self.words[found[0]] * MISSPELT, found[1])
            if (best is None or best[1]) and w[: STEMS[0]] in self.heads:
                stems = [self.stems[w[:k]] for k in STEMS if w[:k] in self.stems]
                if stems and (best is None or max(stems) > best[0]):
                    best = (max(stems), 0)
        return best

    def _found(self, word: str) -> tuple[tuple[float, int] | None, str | None] | None:
        """The match of a word as it stands in the text, and its stem of ``pairs`` of greatest weight; None without either."""
        w = norm(word)
        match, stem = self._look(w), None
        if self.pairs and w[: STEMS[0]] in self.heads:
            stem = max((w[:k] for k in STEMS if w[:k] in self.pairs), key=lambda s: (self.pairs[s], s), default=None)
        return None if match is None and stem is None else (match, stem)

    def matches(self, text: str) -> tuple[int, list[tuple[int, float, int]], list[str]]:
        """Number of words; (place, weight, edits) of each match; the words."""
        words = text.split()
        hits: dict[str, tuple[float, int]] = {}
        paired: dict[str, list[str]] = {}
        known = self.known
        for w in set(words):
            try:
                found = known[w]
            except KeyError:
                found = self._found(w)
                if len(known) > self.MOST_KNOWN:
                    known.clear()
                if len(w) <= 40:
                    known[w] = found
            if found is None:
                continue
            m, stem = found
            if m is not None:
                hits[w] = m
            if stem is not None:
                paired.setdefault(stem, []).append(w)
        for stem, own in paired.items():
            if len(own) > 1 or words.count(own[0]) > 1:
                for w in own:
                    if w not in hits or hits[w][0] < self.pairs[stem]:
                        hits[w] = (self.pairs[stem], 0)
        return len(words), [(i, *hits[w]) for i, w in enumerate(words) if w in hits] if hits else [], words

    def features(self, text: str) -> list[float]:
        n, found, words = self.matches(text)
        if not found:
            return [0.0] * FEATURES
        quoted = _quoted(words, [i for i, *_ in found])
        effect = [w * (QUOTED if q else 1.0) for (_, w, _), q in zip(found, quoted)]
        places = [i for i, *_ in found]
        best, low, high, inside = 0.0, 0, 0, 0.0
        for x, i in enumerate(places):
            while high < len(places) and places[high] <= i + WINDOW:
                inside += effect[high]
                high += 1
            while places[low] < i - WINDOW:
                inside -= effect[low]
                low += 1
            near = any(norm(w) in ADDRESS for w in words[max(0, i - WINDOW) : i + WINDOW + 1])
            best = max(best, inside * (1.5 if near else 1.0) if not quoted[x] else inside)
        total = sum(effect)
        exact = [x for x, (_, _, edits) in zip(effect, found) if not edits]
        return [total, total / math.sqrt(n + 10), best, float(len({words[i] for i in places})), total / n, max(effect), sum(exact), max(exact, default=0.0)]


def _quoted(words: list[str], places: list[int]) -> list[bool]:
    """Whether the words at ``places`` stand between quotation marks that open at most 40 words before and close after."""
    out, inside, wanted, opened = {}, False, set(places), 0
    for i, w in enumerate(words):
        starts = w[0] in '"' + _OPEN or (len(w) > 1 and w[0] == "'" and w[1:2].isalpha())
        bare = w.rstrip(".,;:!?")
        ends = bool(bare) and (bare[-1] in '"' + _CLOSE or (len(bare) > 1 and bare[-1] == "'"))
        if starts and not inside:
            inside, opened = True, i
        if inside and i - opened > 40:
            inside = False
        if i in wanted:
            out[i] = inside
        if ends and (inside and (i > opened or len(w) > 2)):
            for j in range(opened, i + 1):
                if j in out:
                    out[j] = True
            inside = False
    if inside:  # an open mark that nothing closes quotes nothing
        for j in out:
            if j >= opened:
                out[j] = False
    return [out[i] for i in places]


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    plain: frozenset[str]
    pairs: dict[str, float]
    trees: Trees


def _plain(sample: DataFrame, words: dict[str, float]) -> frozenset[str]:
    """Neighbours of lexicon words that are in at least as large a share of the clean documents as of the toxic ones."""

    def rows(batches):
        automaton, near = Automaton(words), {}
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        docs = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                for w in {w for w in map(norm, (text or "").split()) if len(w) >= SHORTEST and w not in words}:
                    if w not in near:
                        near[w] = automaton.find(w) is not None
                    if near[w]:
                        seen[label][w] += 1
                docs[label] += 1
        terms = sorted(seen[0].keys() | seen[1].keys())
        seen[0][""], seen[1][""] = docs[0], docs[1]
        terms = [*terms, ""]  # the empty term counts documents
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[c][t] for t in terms], pa.int64()) for c in (0, 1))], names=["term", "clean", "toxic"])

    counts = sample.mapInArrow(rows, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("term = '' OR clean > 0").collect()
    count = {r["term"]: (r["clean"], r["toxic"]) for r in counts}
    n0, n1 = count.pop("", (0, 0))
    return frozenset(w for w, (a, b) in count.items() if a * n1 >= b * n0)


def _lexicon(sample: DataFrame, least_share: float) -> list[dict[str, float]]:
    """Words, stems and pairs of stems in ``least_share`` of toxic documents whose log odds in them are at least 3.

    Words and stems that start with a pair's stem, in fewer than half as many toxic documents, add nothing to it but what
    the sample happens to hold, and are left out.
    """

    def rows(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        docs = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                count = Counter(w for w in map(norm, (text or "").split()) if len(w) >= STEMS[0] and w[:4].isalpha())
                stems: Counter = Counter()
                for w, n in count.items():
                    stems.update({w[:k]: n for k in STEMS if len(w) >= k})
                seen[label].update(["w" + w for w in count if len(w) <= 30])
                seen[label].update([f"s{x}" for x in stems])
                seen[label].update([f"p{x}" for x, n in stems.items() if n > 1])
                docs[label] += 1
        terms = sorted(seen[0].keys() | seen[1].keys())
        terms = [*terms, ""]  # the empty term counts documents
        seen[0][""], seen[1][""] = docs[0], docs[1]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[c][t] for t in terms], pa.int64()) for c in (0, 1))], names=["term", "clean", "toxic"])

    counts = sample.mapInArrow(rows, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    all_ = counts.where("term = ''").first()
    out: list[dict[str, float]] = []
    held: list[dict[str, int]] = []
    n1, n0 = (all_["toxic"], all_["clean"]) if all_ else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    for kind in "wsp":
        own = counts.where(F.col("term").startswith(kind) & (F.col("toxic") >= max(3, least_share * n1))).select("term", "toxic", odds.alias("w")).where("w >= 3")
        best = own.orderBy("term").collect()
        out.append({r["term"][1:]: float(r["w"]) for r in best})
        held.append({r["term"][1:]: r["toxic"] for r in best})
    counts.unpersist()
    for own, count in zip(out[:2], held):
        for w in [w for w in own if any(2 * count[w] < held[2].get(w[:k], 0) for k in STEMS)]:
            del own[w]
    return out


def train(documents: DataFrame, labels: DataFrame, per_class: int = 2500, least_share: float = 0.01) -> Model:
    """From at most ``per_class`` labelled documents of each class (``labels.toxic``), taken in hash order."""
    sample = written(labelled_sample(documents, labels, "toxic", per_class), "sample")
    words, stems, pairs = _lexicon(sample, least_share)
    plain = _plain(sample, words)

    def rows(batches):
        lexicon = Lexicon(words, stems, plain, pairs)
        for batch in batches:
            x = [lexicon.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = sorted(sample.mapInArrow(rows, "doc_id long, label int, x array<double>").collect(), key=lambda r: r["doc_id"])
    x, y = np.array([r["x"] for r in got]).reshape(len(got), FEATURES), np.array([r["label"] for r in got], float)
    if not len(y):
        return Model(words, stems, plain, pairs, Trees(bias=-50.0))
    trees = fit(x, y, {j: 1 for j in range(FEATURES)}, trees=40, depth=3)
    if 0 < y.sum() < len(y):
        # the sample is balanced by class; the odds go back to those of all known labels
        known = labels.where(~held_out()).agg(F.sum((F.col("toxic") == 1).cast("long")).alias("a"), F.sum((F.col("toxic") == 0).cast("long")).alias("b")).first()
        trees.bias += math.log((known["a"] or 1) / (known["b"] or 1)) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(words, stems, plain, pairs, trees)


def assess(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; needs columns doc_id and text."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        own = sent.value
        lexicon = Lexicon(own.words, own.stems, own.plain, own.pairs)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                score = own.trees.score(np.array([lexicon.features(t or "") for t in part.column("text").to_pylist()]).reshape(-1, FEATURES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ready = documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return ready.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the toxicity score of every document."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return assess(documents, train(documents, table(spark, sf_dir, "labels", "doc_id", "toxic")))
