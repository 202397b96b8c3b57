"""Toxicity: a learned lexicon, matched by Levenshtein automata that walk its trie, with scores for the context of a hit.

Fit (on a bounded sample of labelled rows, ``max_fit_rows``, near copies of which count once): words and word stems whose
toxic share is significantly high (a G test, corrected for the number of terms tried) become the lexicon.

Match: the lexicon is a trie. A state of the matcher is the set of pairs (trie node, edits so far) that a Levenshtein
automaton can reach; sets are made as they are needed and kept, so that a word takes one table look-up for each letter and
most words end after a few. Insertions, deletions, substitutions and swaps of neighbours are single edits. Entries of
five letters or more take one edit, of ten or more two. A stem takes any ending; so does a word of five letters or more,
as a hit of its own class. Some stems make a hit only by two different words; one alone is of the class of endings.

Score: each entry and class (exact, ending, edits) has the excess of toxic documents among those of the sample that show
it (for the last two, without an exact hit), so misspellings that clean texts show by chance weigh nothing. A hit counts less inside quotation marks, less still if a
verb of saying is near, and more if a pronoun of address is. Hits of different entries combine as independent causes over the
toxic share of documents without a hit.

Defined results: null and empty texts, and texts without a hit, score that share; without labelled rows of both kinds the
lexicon is empty; of rows with one id and different labels the toxic one counts; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import durable, remainder, small
from ._text import shingles, word_hashes

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
MAX_FIT_ROWS = 20_000
#: Matcher states, words without a match and terms that a task remembers; beyond, it forgets them and goes on.
REMEMBERED = 200_000
STEM_LETTERS = range(4, 9)
WORD = re.compile(r"[^\W_]+")
#: Letters that digits stand for in disguised spellings.
DISGUISE = str.maketrans("01345", "oieas")
#: Verbs of saying and pronouns of address (English, German, French, Spanish).
SAYING = frozenset("said says say wrote writes called calls quoted quote word term sagte sagt nannte schrieb wort dit disait mot appelle dijo dice palabra llama".split())
ADDRESS = frozenset("you your youre u du dich dir euch ihr tu toi te vous usted ustedes ti vosotros".split())
QUOTES = re.compile("[\"“”„«»]")
CONTEXT_WORDS = 6

EXACT, ENDING, EDITED = 0, 1, 2


class Matcher:
    """Runs words through the Levenshtein automata of all lexicon entries at once."""

    def __init__(self, entries: list[tuple[str, int]]):
        """entries: (text, 0 for a word; for a stem, the number of different words that make a hit)."""
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.edits = [0 if len(e) < 5 else 1 if len(e) < 10 else 2 for e, _ in entries]
        most = [0]
        for k, (text, _) in enumerate(entries):
            node = 0
            most[0] = max(most[0], self.edits[k])
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    most.append(0)
                node = self.children[node][c]
                most[node] = max(most[node], self.edits[k])
            self.ends[node].append(k)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        """Start the table of states anew."""
        start = self._closed({(0, 0, "")})
        self.numbers = {start: 0}
        self.states = [start]
        self.next: list[dict[str, int]] = [{}]
        self.ended: list[dict | None] = [None]
        self.passed = [self._passed(start)]

    def _closed(self, state: set) -> frozenset:
        """With the nodes that deletions (letters of the entry left out) reach; of one node only the fewest edits stay."""
        best: dict = {}
        todo = list(state)
        while todo:
            node, edits, wait = todo.pop()
            if best.get((node, wait), 9) <= edits:
                continue
            best[node, wait] = edits
            if not wait:
                todo += [(child, edits + 1, "") for child in self.children[node].values() if edits < self.most[child]]
        return frozenset((node, edits, wait) for (node, wait), edits in best.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, edits, wait in state:
            if wait:
                if c == wait:
                    out.add((node, edits, ""))
                continue
            for letter, child in self.children[node].items():
                if letter == c:
                    out.add((child, edits, ""))
                elif edits < self.most[child]:
                    out.add((child, edits + 1, ""))
                if edits < self.most[child] and c != letter and c in self.children[child]:
                    out.add((self.children[child][c], edits + 1, letter))
            if edits < self.most[node]:
                out.add((node, edits + 1, ""))
        return self._closed(out)

    def _passed(self, state: frozenset) -> dict[int, int]:
        """The entries that end here and take further letters: stems by their edits, words of five letters or more as an ending."""
        out: dict[int, int] = {}
        for node, edits, wait in state:
            for k in () if wait else self.ends[node]:
                text, stem = self.entries[k]
                if stem and edits <= self.edits[k]:
                    out[k] = min(out.get(k, 9), EXACT if not edits else EDITED)
                elif not stem and not edits and len(text) >= 5:
                    out[k] = ENDING
        return out

    def _ended(self, state: frozenset) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, edits, wait in state:
            for k in () if wait else self.ends[node]:
                if edits <= self.edits[k]:
                    out[k] = min(out.get(k, 9), EXACT if not edits else EDITED)
        return out

    def hits(self, word: str) -> dict[int, int]:
        """{entry: class} of the entries that the word matches."""
        if len(self.states) > REMEMBERED:
            self._forget()
        at, found = 0, None
        for c in word:
            to = self.next[at].get(c)
            if to is None:
                state = self._step(self.states[at], c)
                to = self.numbers.setdefault(state, len(self.states)) if state else -1
                if to == len(self.states):
                    self.states.append(state)
                    self.next.append({})
                    self.ended.append(None)
                    self.passed.append(self._passed(state))
                self.next[at][c] = to
            if to < 0:
                return found or {}
            at = to
            if p := self.passed[at]:
                found = found or {}
                for k, kind in p.items():
                    found[k] = min(found.get(k, 9), kind)
        if self.ended[at] is None:
            self.ended[at] = self._ended(self.states[at])
        if last := self.ended[at]:
            found = found or {}
            for k, kind in last.items():
                found[k] = min(found.get(k, 9), kind)
        return found or {}


def quotedness(text: str, start: int, stop: int) -> float:
    """How far the context of a hit speaks for quotation: 0 (none) to 1."""
    before, after = text[max(0, start - 200) : start], text[stop : stop + 200]
    before, after = before[before.rfind("\n") + 1 :], after.partition("\n")[0]
    if len(QUOTES.findall(before)) % 2 == 0 or not QUOTES.search(after):
        return 0.0
    near = {*WORD.findall(before.lower())[-CONTEXT_WORDS:], *WORD.findall(after.lower())[:CONTEXT_WORDS]}
    return 0.7 + 0.3 * bool(near & SAYING) - 0.5 * bool(near & ADDRESS)


def document_hits(text: str, matcher: Matcher, dead: set[str]) -> dict[tuple[int, int], float]:
    """{(entry, class): least quotedness} of a whole text. ``dead`` gathers words that match nothing, up to a bound."""
    words = WORD.findall(text.lower())
    alive = {}
    for w in set(words) - dead:
        found = matcher.hits(w)
        if not found and not w.isalpha() and not w.isdigit():
            found = {k: EDITED for k in matcher.hits(w.translate(DISGUISE))}
        if found:
            alive[w] = found
        elif len(dead) < REMEMBERED:
            dead.add(w)
    if not alive:
        return {}
    quoted: dict[str, float] = {}
    if not QUOTES.search(text):
        quoted = dict.fromkeys(alive, 0.0)
    else:
        for m in WORD.finditer(text):
            if (w := m[0].lower()) in alive and quoted.get(w, 1.0) > 0:
                quoted[w] = min(quoted.get(w, 1.0), quotedness(text, *m.span()))
    exact = Counter(k for found in alive.values() for k, kind in found.items() if kind == EXACT)
    out: dict[tuple[int, int], float] = {}
    for w, found in alive.items():
        for k, kind in found.items():
            key = k, ENDING if kind == EXACT and exact[k] < matcher.entries[k][1] else kind
            out[key] = min(out.get(key, 1.0), quoted.get(w, 0.0))
    return out


class Model:
    """A lexicon with weights. ``weights[entry, class]`` is the excess toxic share, ``rest`` that of texts without a hit."""

    def __init__(self, entries: list[tuple[str, int]], weights: dict[tuple[int, int], float], rest: float):
        self.entries, self.weights, self.rest = entries, weights, rest

    def score(self, hits: dict[tuple[int, int], float]) -> float:
        most: dict[int, float] = defaultdict(float)
        for (k, kind), quoted in hits.items():
            most[k] = max(most[k], self.weights.get((k, kind), 0.0) * (1 - 0.8 * quoted))
        clean = 1 - self.rest
        for p in most.values():
            clean *= 1 - p
        return 1 - clean


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Rows (text, toxic) for the fit: labelled, not held out, ``most`` at most in expectation, one of each near copy."""
    labels = labels.where("doc_id is not null and toxic in (0, 1)").where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    part = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_003)) < 1_000_003 * most / max(n, 1)
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chosen = texts.join(small(labels.where(part)), "doc_id").select("text", "toxic")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shingles(word_hashes(np.frombuffer(t.encode(), dtype=np.uint8)), 3) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[0].view(np.int64)) if len(x) else 0 for x in s], pa.int64()), batch.column("toxic"), batch.column("text")], names=["sign", "toxic", "text"])

    return chosen.mapInArrow(signed, "sign long, toxic int, text string").groupBy("sign", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _terms(text: str) -> set[str]:
    """Words as ``w:``, stems of them as ``p:`` (with a word of a stem's length), stems of two words or more as ``r:``."""
    words = {w for w in WORD.findall(text.lower()) if len(w) > 2 and w.isalpha()}
    count = Counter(w[:k] for w in words for k in STEM_LETTERS if len(w) >= k)
    return {f"w:{w}" for w in words} | {f"p:{t}" for t in count} | {f"r:{t}" for t, n in count.items() if n > 1}


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """Learn a model from labels (doc_id, toxic) of documents (doc_id, text) that are not held out."""
    sample = durable(_sample(docs, labels, max_fit_rows))
    of = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = of.get(1, 0), of.get(0, 0)
    base = (toxic + 0.5) / (toxic + clean + 1)
    if not toxic or not clean:
        return Model([], {}, base)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: tuple[Counter, Counter] = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            terms = list(count[1].keys() | count[0].keys())
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([count[k][t] for t in terms], pa.int64()) for k in (1, 0))], names=["term", "a", "b"])

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                count[label].update(_terms(text))
                if len(count[0]) + len(count[1]) > REMEMBERED:
                    yield rows()
                    for c in count:
                        c.clear()
        yield rows()

    least = max(3, math.ceil(3 / -math.log10(base)))
    often = durable(sample.mapInArrow(counted, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= least))
    passed = often.where(_significant(toxic, clean, often.count())).select("term", "a", "b").collect()
    entries = _lexicon([(r["term"], r["a"], r["b"]) for r in passed], toxic / (toxic + clean))
    weights, rest = _weights(sample, entries, base)
    return Model(entries, weights, rest)


def _evidence(a: int, b: int, share: float) -> float:
    """The G statistic of a term in ``a`` toxic and ``b`` clean texts, against the toxic share."""
    return a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0)


def _significant(toxic: int, clean: int, tried: int) -> Column:
    """Whether a term in ``a`` toxic and ``b`` clean texts tells toxic ones, of so many terms that were tried."""
    share, a, b = toxic / (toxic + clean), F.col("a"), F.col("b")
    g = a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0)
    return (a / (a + b) >= max(0.6, 2 * share)) & (g / math.log(10) >= math.log10(max(tried, 1)) + 2)


def _lexicon(passed: list[tuple[str, int, int]], share: float) -> list[tuple[str, int]]:
    """Entries from the terms that passed; their number is bounded by the sample's words, not by a cap.

    The strongest come first, of equal ones words before stems and long before short. What a chosen stem covers adds nothing;
    a stem of a chosen entry is taken only if it is clearly stronger.
    """
    ranked = sorted(((_evidence(a, b, share), "wpr".index(term[0]), term[2:]) for term, a, b in passed), key=lambda x: (-x[0], x[1], -len(x[2]), x[2]))
    #: For each beginning of a term the strongest evidence of a longer one.
    longer: dict[str, float] = {}
    for g, _, text in ranked:
        for k in range(1, len(text)):
            longer[text[:k]] = max(longer.get(text[:k], 0.0), g)
    kept: list[tuple[str, int]] = []
    stems: set[str] = set()
    begun: set[str] = set()
    for g, words, text in ranked:
        if text in begun or any(text[:k] in stems for k in range(1, len(text) + 1)):
            continue
        if words and longer.get(text, -1.0) >= 0.97 * g:
            continue
        kept.append((text, words))
        begun.update(text[:k] for k in range(1, len(text) + 1))
        if words:
            stems.add(text)
    return kept


def _weights(sample: DataFrame, entries: list[tuple[str, int]], base: float) -> tuple[dict[tuple[int, int], float], float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, dead, count = Matcher(entries), set(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                hits = document_hits(text, matcher, dead)
                # What goes along with an exact hit says nothing about the other classes.
                best = [key for key in hits if key[1] == EXACT] or hits or [(-1, 0)]
                for key in best:
                    count[*key, label] += 1
        keys = list(count)
        yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in keys], pa.int32()) for c in range(3)] + [pa.array([count[k] for k in keys], pa.int64())], names=["entry", "kind", "toxic", "n"])

    rows = sample.mapInArrow(run, "entry int, kind int, toxic int, n long").groupBy("entry", "kind", "toxic").agg(F.sum("n").alias("n")).collect()
    n = {(r["entry"], r["kind"], r["toxic"]): r["n"] for r in rows}
    share = lambda k, kind: (n.get((k, kind, 1), 0) + 0.5) / (n.get((k, kind, 1), 0) + n.get((k, kind, 0), 0) + 1)
    weights = {(k, kind): max(0.0, (share(k, kind) - base) / (1 - base)) for k in range(len(entries)) for kind in (EXACT, ENDING, EDITED)}
    return weights, share(-1, 0)


def with_score(docs: DataFrame, model: Model, into: str = "score", hits_into: str = "n_hits") -> DataFrame:
    """``docs`` (text and any others) with the score of each whole text, and its number of entries with a weight."""
    entries, weights, rest = model.entries, model.weights, model.rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, matcher, dead = Model(entries, weights, rest), Matcher(entries), set()
        for batch in batches:
            scores, n = [], []
            for text in batch.column("text"):
                hits = document_hits(text.as_py() or "", matcher, dead)
                scores.append(own.score(hits))
                n.append(len({k for k, kind in hits if weights.get((k, kind), 0) > 0}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(n, pa.int32())], names=[*batch.schema.names, into, hits_into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType()), T.StructField(hits_into, T.IntegerType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, n_hits."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def slim(scored: DataFrame) -> DataFrame:
        return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")

    return slim(with_score(texts, fit(docs, labels, max_fit_rows)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that score less than the threshold."""
    scored = with_score(docs, fit(docs, labels, max_fit_rows), "_toxic_score", "_toxic_hits")
    return scored.where(F.col("_toxic_score") < threshold).drop("_toxic_score", "_toxic_hits")
