"""Toxicity scores: a lexicon learned from labels, matched by a Levenshtein automaton, and scored in context."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cachelens.llm._ship import ship
from cachelens.llm._store import dropped, written

WORDS = re.compile(r"[^\W\d_]+")
#: Two runs of letters with one digit or sign between them.
JOINED = re.compile(r"(?<![^\W\d_])(?=([^\W\d_]+(?:[\d_]|[^\w\s])[^\W\d_]+))")
#: Quoted spans: marks of one pair around up to 600 characters of one paragraph.
QUOTED = re.compile('"[^"\\n]{1,600}"|“[^”\\n]{1,600}”|„[^“”\\n]{1,600}[“”]|«[^»\\n]{1,600}»|»[^«\\n]{1,600}«|‘[^’\\n]{1,600}’(?!\\w)')
FEATURES = ("exact", "stem", "fuzzy", "quoted", "context", "density")
#: These weights are not let below zero: a match never speaks for a text.
UPWARD = ("exact", "stem", "fuzzy", "density")
STEMS = (4, 5, 6, 7)
#: Sum of weights at which a feature is full: some six matches.
MOST = 36.0


class Lexicon:
    """Trie of terms and stems walked together with Levenshtein automata.

    A state is a set of (trie node, edits) and of stems passed; states become numbers and their moves a table as they are
    met, so each character of a text's word costs one look-up and most words die within a few characters. A word matches
    exactly, by a stem that it begins with, or with edits (insertion, deletion, substitution) of a term: one from
    `fuzzy_from` characters on, two from `twice_from` on, none of `crowded` terms. Stems match without edits. Words in
    `known` are no misspellings.
    """

    EXACT, STEM, FUZZY = 1, 2, 3

    def __init__(self, terms: dict[str, float], stems: dict[str, float], known: frozenset = frozenset(), crowded: frozenset = frozenset(), fuzzy_from: int = 4, twice_from: int = 8):
        self.next: list[dict[str, int]] = [{}]
        self.term, self.stem = [0.0], [0.0]  # weights of what ends at a node
        self.allow, self.reach = [-1], [0]  # edits of the term that ends at a node, most edits of those below
        self.known, self.name = known, {}
        for words, weights in ((terms, self.term), (stems, self.stem)):
            for w, weight in words.items():
                node, edits = 0, 0 if words is stems or w in crowded else (len(w) >= fuzzy_from) + (len(w) >= twice_from)
                self.reach[0] = max(self.reach[0], edits)
                for c in w:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        for column, empty in ((self.term, 0.0), (self.stem, 0.0), (self.allow, -1), (self.reach, 0)):
                            column.append(empty)
                    node = self.next[node][c]
                    self.reach[node] = max(self.reach[node], edits)
                weights[node] = max(weight, 1e-6)
                if words is terms:
                    self.allow[node], self.name[node] = edits, w
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.verdicts: list[tuple[int, float]] = []
        self.dead = self._number({})
        self.first = self._number({0: 0})

    def _number(self, state: dict[int, int]) -> int:
        """The state with what deleting a term's characters reaches. state: fewest edits by node, or by ~node for a stem passed."""
        todo = [n for n in state if n >= 0]
        while todo:
            node = todo.pop()
            for child in self.next[node].values():
                if (e := state[node] + 1) <= self.reach[child] and e < state.get(child, 9):
                    state[child] = e
                    todo.append(child)
        key = frozenset(state.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            exact = max((self.term[n] for n, e in key if n >= 0 and e == 0), default=0)
            stem = max((self.stem[~n] for n, e in key if n < 0), default=0)
            fuzzy = max((self.term[n] for n, e in key if n >= 0 and 0 < e <= self.allow[n]), default=0)
            self.verdicts.append((self.EXACT, exact) if exact else (self.STEM, stem) if stem else (self.FUZZY, fuzzy) if fuzzy else (0, 0.0))
        return self.numbers[key]

    def _move(self, number: int, c: str) -> int:
        out: dict[int, int] = {}

        def reached(node: int, edits: int) -> None:
            if edits <= self.reach[node] and edits < out.get(node, 9):
                out[node] = edits

        for node, edits in self.states[number]:
            if node < 0:
                out[node] = 0  # past a stem anything goes
                continue
            for letter, child in self.next[node].items():
                reached(child, edits + (letter != c))
                if letter == c and edits == 0 and self.stem[child]:
                    out[~child] = 0
            reached(node, edits + 1)
        to = self._number(out)
        self.moves[number][c] = to
        return to

    def lookalikes(self, word: str) -> list[str]:
        """Terms that the word could be a misspelling of."""
        if self.match(word)[0] != self.FUZZY:
            return []
        state = self.first
        for c in word:
            state = self.moves[state][c]
        return [self.name[n] for n, e in self.states[state] if n >= 0 and 0 < e <= self.allow[n]]

    def match(self, word: str) -> tuple[int, float]:
        """Kind of match, 0 for none, and the weight of what is matched."""
        if len(self.states) > 50_000:
            self._reset()
        state, moves, dead = self.first, self.moves, self.dead
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == dead:
                return 0, 0.0
        found = self.verdicts[state]
        return (0, 0.0) if found[0] == self.FUZZY and word in self.known else found


class Scorer:
    """Features of a text around its lexicon matches: sums of weights by kind, those in quoted spans apart, what the words
    around the others tell, and how dense they are. Two runs of letters around one digit or sign are also matched whole.
    Words seen before are looked up, not matched again."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], known: list[str] = (), crowded: list[str] = (), context: dict[str, float] | None = None, window: int = 8):
        self.lexicon, self.window, self.found = Lexicon(terms, stems, frozenset(known), frozenset(crowded)), window, {}
        self.context = context or {}

    def hits(self, text: str | None) -> tuple[list[str], list[tuple[int, int, float, bool]]]:
        """Words of a text; place, kind, weight of each match, and whether it stands in a quoted span."""
        low = (text or "").lower()
        words, joined = WORDS.findall(low), JOINED.findall(low)
        found = self.found
        if len(found) > 200_000:
            found.clear()
        for w in set(words).union(joined).difference(found):
            found[w] = self.lexicon.match(w)
        kinds = list(map(found.__getitem__, words))
        whole = any(found[w][0] for w in joined)
        if not whole and not any(k for k, _ in kinds):
            return words, []
        spots = [m.span() for m in WORDS.finditer(low)]
        if whole:  # a term with a digit or sign in it, neither half of which matches, counts at its first half
            at = {a: i for i, (a, _) in enumerate(spots)}
            for m in JOINED.finditer(low):
                i = at[m.start(1)]
                if found[m[1]][0] and not kinds[i][0] and not kinds[i + 1][0]:
                    kinds[i], spots[i] = found[m[1]], m.span(1)
        spans = [m.span() for m in QUOTED.finditer(low)]
        begins = [a for a, _ in spans]
        out = []
        for i, (kind, weight) in enumerate(kinds):
            if kind:
                s = bisect_right(begins, spots[i][0]) - 1
                out.append((i, kind, weight, s >= 0 and spots[i][1] <= spans[s][1]))
        return words, out

    def around(self, words: list[str], i: int) -> list[str]:
        """The words of the window around a match, but for matches."""
        return [w for w in words[max(0, i - self.window) : i] + words[i + 1 : i + self.window + 1] if not self.found[w][0]]

    def features(self, text: str | None) -> tuple[float, ...]:
        words, hits = self.hits(text)
        if not hits:
            return (0.0,) * len(FEATURES)
        sums, told, plain = [0.0] * 5, 0.0, 0
        for i, kind, weight, quoted in hits:
            sums[4 if quoted else kind] += weight
            if not quoted:
                plain += 1
                got = [c for w in self.around(words, i) if (c := self.context.get(w)) is not None]
                told += sum(got) / len(got) if got else 0.0
        exact, stem, fuzzy, quoted = (min(x, MOST) / MOST for x in sums[1:])
        return exact, stem, fuzzy, quoted, told / max(1, plain), min(1.0, 20 * plain / len(words))


def _learned_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and 4- to 7-letter beginnings of labelled texts: documents that have them, by label."""
    pos: dict[str, list[int]] = {}
    for batch in batches:
        for text, y in zip(batch["text"], batch["toxic"], strict=True):
            words = set(WORDS.findall((text or "").lower()))
            for key in words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}:
                pos.setdefault(key, [0, 0])[int(y)] += 1
    yield pd.DataFrame([(k, n, p) for k, (n, p) in pos.items()], columns=["term", "clean", "toxic"])


def _clean_lookalikes(batches: Iterator[pd.DataFrame], terms: dict, stems: dict) -> Iterator[pd.DataFrame]:
    lexicon = Lexicon(terms, stems)
    for batch in batches:
        yield pd.DataFrame([(w, n, t) for w, n in zip(batch["term"], batch["clean"], strict=True) for t in lexicon.lookalikes(w)], columns=["term", "clean", "like"])


def learned_lexicon(sample: DataFrame, least: int = 4, share: float = 0.004, times: float = 40, crowd: int = 4) -> dict:
    """Terms and stems, with weights, the clean words that look like misspelled terms, and the terms that have `crowd` of these.

    Terms and stems are those in `least` toxic documents and `share` of them or more, and `times` as large a part of the
    toxic documents as of the clean ones. The first bound keeps out words that are in few texts and happen to be in toxic
    ones only. Weights are log odds. A stem is left out where a shorter one says the same or it begins just one term. Words of
    two clean documents are words of their own, not misspellings; a term near several clean words is matched without edits,
    as other words of its language, not in the sample, are as near to it.
    """
    counted = sample.mapInPandas(_learned_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = written(counted, "toxic-terms")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)

    def odds(r) -> float:
        return math.log((r["toxic"] + 0.5) / (n1 + 1)) - math.log((r["clean"] + 0.5) / (n0 + 1))

    ratio = (F.col("toxic") + 0.5) * (n0 + 1) >= times * (F.col("clean") + 0.5) * (n1 + 1)
    rows = counted.where((F.col("toxic") >= max(least, share * n1)) & ratio).collect()
    terms = {r["term"]: odds(r) for r in sorted(rows) if not r["term"].endswith("*")}
    stems: dict[str, float] = {}
    for r in sorted((r for r in rows if r["term"].endswith("*")), key=lambda r: (len(r["term"]), r["term"])):
        s = r["term"][:-1]
        if not any(s.startswith(k) for k in stems) and sum(t.startswith(s) for t in terms) != 1:
            stems[s] = odds(r)
    clean = counted.where("clean > 0 and not endswith(term, '*')")
    like = [tuple(r) for r in clean.mapInPandas(partial(_clean_lookalikes, terms=terms, stems=stems), "term string, clean long, like string").collect()]
    dropped(counted)
    around = Counter(t for _, _, t in like)
    crowded = {t for t, n in around.items() if n >= crowd}
    return {"terms": terms, "stems": stems, "known": sorted({w for w, n, t in like if n > 1 and t not in crowded}), "crowded": sorted(crowded)}


def _windows(batches: Iterator[pd.DataFrame], lexicon: dict) -> Iterator[pd.DataFrame]:
    """Words around unquoted matches: matches that have them near, by label."""
    scorer, near = Scorer(**lexicon), {}
    for batch in batches:
        for text, y in zip(batch["text"], batch["toxic"], strict=True):
            words, hits = scorer.hits(text)
            for i, _, _, quoted in hits:
                if not quoted:
                    for w in set(scorer.around(words, i)):
                        near.setdefault(w, [0, 0])[int(y)] += 1
    yield pd.DataFrame([(k, n, p) for k, (n, p) in near.items()], columns=["term", "clean", "toxic"])


def learned_context(sample: DataFrame, lexicon: dict, least: int = 20) -> dict[str, float]:
    """What words near a match say of it, from -1 (as around those of clean texts, which mention or quote) to 1, for words near `least` matches."""
    found = sample.mapInPandas(partial(_windows, lexicon=lexicon), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = written(found, "toxic-context")
    total = found.agg(F.sum("clean").alias("n"), F.sum("toxic").alias("p")).first()
    n, p = (total["n"] or 0) + 1, (total["p"] or 0) + 1
    rows = found.where(F.col("clean") + F.col("toxic") >= least).collect()
    dropped(found)
    # smoothed towards what matches are in general
    return {r["term"]: math.tanh(math.log((r["toxic"] + least * p / (n + p)) / p) - math.log((r["clean"] + least * n / (n + p)) / n)) for r in rows}


def _features(batches: Iterator[pd.DataFrame], learned: dict, columns: list[str]) -> Iterator[pd.DataFrame]:
    scorer = Scorer(**learned)
    for batch in batches:
        got = np.array([scorer.features(t) for t in batch["text"]]).reshape(-1, len(FEATURES))
        yield pd.concat([batch[columns].reset_index(drop=True), pd.DataFrame(got, columns=list(FEATURES))], axis=1)


def _scored(batches: Iterator[pd.DataFrame], learned: dict, weights: list[float], out: list[str]) -> Iterator[pd.DataFrame]:
    scorer, w = Scorer(**learned), np.array(weights)
    for batch in batches:
        x = np.array([scorer.features(t) for t in batch["text"]]).reshape(-1, len(FEATURES))
        yield batch[out].assign(score=1 / (1 + np.exp(-(x @ w[1:] + w[0]))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50, upward: tuple[int, ...] = ()) -> list[float]:
    """Weights of a ridge logistic regression, the intercept first, by Newton's method. Features `upward` whose weight would be
    negative are left out, the most negative first."""
    free = list(range(x.shape[1]))
    while True:
        z = np.column_stack((np.ones(len(x)), x[:, free]))
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-3
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        worst = min((i for i in free if i in upward), key=lambda i: w[1 + free.index(i)], default=None)
        if worst is None or w[1 + free.index(worst)] >= 0:
            out = np.zeros(1 + x.shape[1])
            out[[0, *(1 + i for i in free)]] = w
            return out.tolist()
        free.remove(worst)


def in_training(doc_id) -> F.Column:
    """Labels of the remainder 2 are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) != 2


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> dict:
    """Lexicon, context and weights from at most `most` labelled rows of the training part, those with the smallest hashed ids.
    All that is collected is of that sample: its terms, its words near matches, and a row of features for each document.

    docs: doc_id, text. labels: doc_id, toxic 0/1 (null labels and ids are left out). No labels, or labels of one kind,
    give an empty lexicon and a constant score.
    """
    ship(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(in_training("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "toxic-sample")
    learned = learned_lexicon(sample)
    learned["context"] = learned_context(sample, learned)
    schema = "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = sample.mapInPandas(partial(_features, learned=learned, columns=["toxic"]), schema).toPandas()
    dropped(sample)
    y = rows["toxic"].to_numpy(float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        nothing = {"terms": {}, "stems": {}, "known": [], "crowded": [], "context": {}}
        return {"learned": nothing, "weights": [float(np.log(rate / (1 - rate)))] + [0.0] * len(FEATURES)}
    return {"learned": learned, "weights": logistic(rows[list(FEATURES)].to_numpy(float), y, upward=tuple(map(FEATURES.index, UPWARD)))}


def score(docs: DataFrame, model: dict, with_text: bool = False) -> DataFrame:
    """The columns of docs (text only if asked for), with score (0 to 1). Only text is read; null and empty texts score as texts without matches.

    Whole texts are matched, however long. Columns that clash with score are replaced. Repeated rows score alike.
    """
    ship(docs.sparkSession)
    rows = docs.drop("score")
    kept = [f for f in rows.schema.fields if with_text or f.name != "text"]
    schema = StructType([*kept, StructField("score", DoubleType())])
    return rows.mapInPandas(partial(_scored, **model, out=[f.name for f in kept]), schema)
