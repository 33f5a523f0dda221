"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

1. Lexicon: words and word beginnings that labelled toxic documents hold far more often than others, by the
   log-likelihood ratio of document counts.
2. Matching: a word is run through the product of its Levenshtein automaton and the trie of the lexicon.  A state is a
   set of (trie node, edits so far); states are built when first met, so a word costs one step per character and
   most words die after a few.
3. Context: each hit has a window of words.  Other hits and words of address in it raise the hit, quotation marks around
   it or a word of reporting before it lower it.
4. Score: a logistic model over a document's windows, fitted on the labelled sample.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procatlas.llm.words import mix

#: Labelled rows of each class that training reads at most, smallest hash of the doc_id first.  Read rows count for those
#: of their class that are not read.
SAMPLE = 3000
LEXICON = 1000
LEAST_RATIO = 16.0
WINDOW = 8
#: Words that address somebody, and words that report what somebody else said (fixed values, en de fr es).
ADDRESS = frozenset("you your yours u ur du dich dir dein deine ihr euch tu toi te ton vous votre tú ti usted vosotros eres".split())
REPORT = frozenset("said says wrote writes called quote quoted quoting term word words sagte schrieb nannte zitat wort dit écrit "
                   "cite mot terme dijo escribió llamó cita palabra".split())
#: Texts of about so many characters are searched together.
_TOGETHER = 1 << 20
_OPEN = re.compile("[\"“”„«»]")
_WORD = re.compile(r"[^\W_]+")


def edits_allowed(term: str, whole: bool) -> int:
    """Longer terms tolerate more: none under five characters, one, and two from nine on; beginnings of words one at most."""
    if not whole:
        return int(len(term) >= 7)
    return (len(term) >= 5) + (len(term) >= 9)


_automata: dict[tuple, "Automaton"] = {}


def _automaton(entries: tuple[tuple[str, bool], ...]) -> "Automaton":
    """The automaton of this worker for a lexicon; its states serve all models and tasks."""
    if entries not in _automata:
        _automata.clear()
        _automata[entries] = Automaton(list(entries))
    return _automata[entries]


_BASE = np.uint64(0x9E3779B97F4A7C15)


def shortened(words: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Hashes of the words, all of one length, with each choice of up to ``most`` characters left out."""
    size = words.dtype.itemsize // 4
    chars = np.ascontiguousarray(words).view(np.uint32).reshape(-1, size).astype(np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]))
    ahead = [np.zeros(len(chars), np.uint64)]
    for k in range(size):
        ahead.append(ahead[-1] * _BASE + chars[:, k] + np.uint64(1))
    piece = lambda i, j: ahead[j] - ahead[i] * power[j - i]
    yield mix(ahead[size])
    if most:
        for i in range(size):
            first = ahead[i]
            yield mix(first * power[size - 1 - i] + piece(i + 1, size))
            if most > 1:
                for j in range(i + 1, size):
                    yield mix((first * power[j - i - 1] + piece(i + 1, j)) * power[size - 1 - j] + piece(j + 1, size))


class Nearby:
    """Tells most words that are within reach of no entry, before the automaton is asked.

    Two words of at most k edits (a swap of neighbours is one) become equal when up to k characters are left out of
    each.  So a word can only match if it, or for a beginning one of its own beginnings, shares a shortened form with an entry
    of the same number of edits.  Forms are kept as two bits each in a table that grows with the lexicon.  No word that
    matches is turned away.
    """

    def __init__(self, entries: list[tuple[str, bool]]):
        self.groups: list[tuple[bool, int, list[int], np.ndarray]] = []
        for whole in (True, False):
            for most in (0, 1, 2):
                some = [t for t, w in entries if w == whole and edits_allowed(t, w) == most]
                if some:
                    hashes = [np.concatenate(list(shortened(np.array(same), most))) for same in self._by_size(some).values()]
                    table = np.zeros(1 << (64 * sum(h.size for h in hashes)).bit_length(), bool)
                    for at in self._places(np.concatenate(hashes), table):
                        table[at] = True
                    self.groups.append((whole, most, sorted({len(t) + d for t in some for d in range(-most, most + 1)}), table))

    @staticmethod
    def _by_size(words: Iterable[str]) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for w in words:
            out.setdefault(len(w), []).append(w)
        return out

    @staticmethod
    def _places(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = np.uint64(table.size - 1)
        return hashes & last, (hashes >> np.uint64(32)) & last

    def _meets(self, words: np.ndarray, most: int, table: np.ndarray) -> np.ndarray:
        found = np.zeros(len(words), bool)
        for hashes in shortened(words, most):
            one, two = self._places(hashes, table)
            found |= table[one] & table[two]
        return found

    def among(self, words: set[str]) -> set[str]:
        """Those of the words that may match."""
        by_size, out = self._by_size(words), set()
        for whole, most, sizes, table in self.groups:
            for size in sizes:
                if whole:
                    some = by_size.get(size, [])
                    if some:
                        out.update(itertools.compress(some, self._meets(np.array(some), most, table).tolist()))
                elif size > 0:
                    some = [w for n, same in by_size.items() if n >= size for w in same]
                    if some:
                        begins, at = np.unique(np.array(some, f"<U{size}"), return_inverse=True)
                        out.update(itertools.compress(some, self._meets(begins, most, table)[at].tolist()))
        return out


#: Product states that an automaton keeps at most (some hundred bytes each, whatever the lexicon).
MOST_STATES = 20_000
_WAITS = 1 << 21  # a waiting character is below this code point


class Automaton:
    """Lexicon trie with lazily built product states.  Only the entries travel to the workers.

    A lexicon entry is (term, whole): ``whole`` entries match entire words, others any word that begins with them.  A state
    is a set of numbers, each a trie node, the edits so far and the trie character that a swap still waits for.  States
    are kept from the start on, as words meet them, up to ``MOST_STATES``; a word that leaves the kept ones goes on from
    set to set, so the result is the same and nothing is built twice over.
    """

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [-1]  # edits that some entry below allows
        for k, (term, whole) in enumerate(entries):
            node, most = 0, edits_allowed(term, whole)
            self.reach[0] = max(self.reach[0], most)
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][c] = nxt
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(-1)
                node = nxt
                self.reach[node] = max(self.reach[node], most)
            self.ends[node].append(k)
        self.nearby = Nearby(entries)
        self.open_end = [any(not entries[k][1] for k in ends) for ends in self.ends]
        self._clear()

    def __reduce__(self):
        return _automaton, (tuple(self.entries),)

    def _clear(self):
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.steps: list[dict[str, int]] = []
        self.results: dict[int, tuple[int, int] | None] = {}
        self.start = self._keep(self._closed({(0, 0, "")}))

    def _closed(self, state: set) -> dict[tuple[int, str], int]:
        """Add trie characters the word leaves out; gives the least edits of each (node, awaited character)."""
        least: dict[tuple[int, str], int] = {}
        todo = sorted(state, key=lambda x: -x[1])
        while todo:
            node, edits, wait = todo.pop()
            if edits >= least.get((node, wait), 9):
                continue
            least[node, wait] = edits
            if not wait and edits < self.reach[node]:
                for nxt in self.children[node].values():
                    if edits < self.reach[nxt]:
                        todo.append((nxt, edits + 1, ""))
        return least

    def _keep(self, state: dict[tuple[int, str], int]) -> int:
        """Number of a state: -1 for the empty one, -2 for one that has no place."""
        if not state:
            return -1
        packed = np.array(sorted((n * 4 + e) * _WAITS + (ord(w) if w else 0) for (n, w), e in state.items()), np.int64).tobytes()
        if packed not in self.numbers:
            if len(self.states) >= MOST_STATES:
                return -2
            self.numbers[packed] = len(self.states)
            self.states.append(packed)
            self.steps.append({})
        return self.numbers[packed]

    def _unpacked(self, number: int) -> dict[tuple[int, str], int]:
        found = np.frombuffer(self.states[number], np.int64).tolist()
        return {(x // _WAITS // 4, chr(x % _WAITS) if x % _WAITS else ""): x // _WAITS % 4 for x in found}

    def _after(self, state: dict[tuple[int, str], int], c: str) -> dict[tuple[int, str], int]:
        """The state behind one more character of the word."""
        new = set()
        for (node, wait), edits in state.items():
            if wait:  # the second half of two swapped characters
                if wait == c:
                    new.add((node, edits, ""))
                continue
            if node and self.open_end[node]:
                new.add((node, edits, ""))  # a beginning has matched: the rest of the word is free
            nxt = self.children[node].get(c)
            if nxt is not None:
                new.add((nxt, edits, ""))
            if edits < self.reach[node]:
                for label, nxt in self.children[node].items():
                    if label != c and edits < self.reach[nxt]:
                        new.add((nxt, edits + 1, ""))
                        deep = self.children[nxt].get(c)
                        if deep is not None and edits < self.reach[deep]:
                            new.add((deep, edits + 1, label))
                new.add((node, edits + 1, ""))
        return self._closed(new)

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) with the fewest edits, the first entry of several; None without a match."""
        at, steps, loose = self.start, self.steps, None
        for c in word:
            if loose is None:
                nxt = steps[at].get(c)
                if nxt is None:
                    loose = self._after(self._unpacked(at), c)
                    nxt = self._keep(loose)
                    if nxt != -2:
                        steps[at][c], loose = nxt, None
                if nxt == -1:
                    return None
                at = nxt
            else:
                loose = self._after(loose, c)
                if not loose:
                    return None
        if loose is not None:
            return self._best(loose)
        if at not in self.results:
            self.results[at] = self._best(self._unpacked(at))
        return self.results[at]

    def _best(self, state: dict[tuple[int, str], int]) -> tuple[int, int] | None:
        best = None
        for (node, wait), edits in state.items():
            if wait:
                continue
            for k in self.ends[node]:
                if edits <= edits_allowed(*self.entries[k]) and (best is None or (edits, k) < best):
                    best = (edits, k)
        return best and (best[1], best[0])


class Model:
    """Lexicon, weight of each (entry, edits) and the coefficients of the document score."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.automaton = Automaton(entries)
        self.weight = np.ones((len(entries), 3))
        self.beta: np.ndarray | None = None

    def _matches(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """(entry, edits) of every word that has one."""
        return {w: m for w in self.automaton.nearby.among(words) if (m := self.automaton.match(w))}

    def hits(self, text: str, found: dict[str, tuple[int, int]] | None = None) -> tuple[list[tuple[int, int, int]], list[str], str]:
        """(word number, entry, edits) of every hit, the words, and the lowered text; ``found`` are the matches if known."""
        low = text.lower()
        words = _WORD.findall(low)
        if found is None:
            found = self._matches(set(words))
        return ([(k, *found[w]) for k, w in enumerate(words) if w in found] if found else []), words, low

    def features(self, text: str, found: dict[str, tuple[int, int]] | None = None) -> np.ndarray:
        hits, words, low = self.hits(text, found)
        if not hits:
            return np.zeros(6)
        starts = None
        if _OPEN.search(low):
            starts = [m.start() for m in _WORD.finditer(low)]
        scores, quoted, fuzzy = [], 0, 0
        at = [k for k, _, _ in hits]
        for n, (k, entry, edits) in enumerate(hits):
            near = sum(1 for j in range(max(0, n - 3), min(len(hits), n + 4)) if j != n and abs(at[j] - k) <= WINDOW)
            window = words[max(0, k - WINDOW):k + WINDOW + 1]
            address = any(w in ADDRESS for w in window)
            said = any(w in REPORT for w in words[max(0, k - 4):k])
            if starts is not None and not said:
                line = low.rfind("\n", 0, starts[k]) + 1
                said = len(_OPEN.findall(low, line, starts[k])) % 2 == 1
            quoted += said
            fuzzy += edits > 0
            scores.append(self.weight[entry, edits] * (1 + 0.2 * near + 0.2 * address) * (0.3 if said else 1))
        total = sum(scores)
        return np.array([max(scores), math.log1p(max(0.0, total)), math.log1p(len(hits)), quoted / len(hits),
                         fuzzy / len(hits), 10 * len(hits) / len(words)])

    def score(self, text: str, found: dict[str, tuple[int, int]] | None = None) -> float:
        if self.beta is None:
            return 0.0
        z = self.beta[0] + float(self.features(text, found) @ self.beta[1:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def scores(self, column: pa.Array) -> np.ndarray:
        """Scores of a column of texts, some texts at a time; null is empty."""
        out, some, size = [], [], 0
        for at, text in enumerate(column, 1):
            some.append(text.as_py() or "")
            size += len(some[-1])
            if size > _TOGETHER or at == len(column):
                held = [set(_WORD.findall(t.lower())) if self.beta is not None else set() for t in some]
                found = self._matches(set().union(*held))
                out += [self.score(t if not found.keys().isdisjoint(words) else "", found) for t, words in zip(some, held)]
                some, size = [], 0
        return np.array(out, float)


def _candidates(text: str) -> set[tuple[str, bool]]:
    words = set(_WORD.findall(text.lower()))
    out = {(w, True) for w in words if 3 <= len(w) <= 20}
    for w in words:
        out |= {(w[:n], False) for n in range(4, min(9, len(w)))}
    return out


def _ratio(pos: float, neg: float, P: float, N: float) -> float:
    """Log-likelihood ratio of a term's document counts in the two classes; 0 when it prefers the clean class."""
    if pos / P <= 8 * neg / N:
        return 0.0
    rate = (pos + neg) / (P + N)
    part = lambda k, n, p: (k * math.log(k / n / p) if k else 0) + ((n - k) * math.log((1 - k / n) / (1 - p)) if k < n else 0)
    return 2 * (part(pos, P, rate) + part(neg, N, rate)) if 0 < rate < 1 else 2 * pos


def choose_lexicon(counts: list[tuple[str, bool, int, int]], P: int, N: int) -> list[tuple[str, bool]]:
    """Best terms first; a term that begins with a chosen beginning, or of which a chosen term is a longer form, adds
    nothing."""
    ranked = sorted(((_ratio(p, n, P, N), len(t), w, t) for t, w, p, n in counts), reverse=True)
    chosen: list[tuple[str, bool]] = []
    stems: set[str] = set()
    inner: set[str] = set()
    for ratio, _, whole, term in ranked:
        if ratio < LEAST_RATIO or len(chosen) >= LEXICON:
            break
        if any(term[:n] in stems for n in range(1, len(term) + 1)) or (not whole and term in inner):
            continue
        chosen.append((term, whole))
        inner.update(term[:n] for n in range(1, len(term) + 1))
        if not whole:
            stems.add(term)
    return chosen


def class_weights(known: DataFrame, per_class: int) -> np.ndarray:
    """Rows of class 0 and of class 1 in ``known`` (y) over those that a sample of ``per_class`` of each reads."""
    counts = dict(known.groupBy("y").count().collect())
    return np.array([max(1.0, counts.get(y, 0) / per_class) for y in (0, 1)])


def row_weights(weights: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` times the weight of each row's class, with the sum of ``n``: the classes get their shares, the penalty keeps its strength."""
    w = weights[y.astype(int)] * n
    return w * (n.sum() / w.sum())


def _sample(docs: DataFrame, labels: DataFrame, usable, per_class: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text, y) of at most ``per_class`` usable labelled documents of each class, and the weights of the classes."""
    known = (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
             .where(usable(F.col("doc_id"))))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = known.where("y = 1").orderBy(*order).limit(per_class).union(known.where("y = 0").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text IS NOT NULL")  # at most 2 * per_class rows
    return rows, class_weights(known, per_class)


def train(docs: DataFrame, labels: DataFrame, usable=lambda doc_id: F.lit(True), per_class: int = SAMPLE) -> Model:
    """Fit on a bounded sample of labelled rows; ``usable`` says from the doc_id which rows may be read."""
    sample, share = _sample(docs, labels, usable, per_class)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for term, whole in _candidates(text):
                    counts[term, whole, y] += 1
            cols = list(zip(*((t, w, n * y, n * (1 - y)) for (t, w, y), n in counts.items()))) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.int64())], names=["term", "whole", "pos", "neg"])

    sizes = sample.agg(F.sum("y"), F.count("*")).first()
    P = int(sizes[0] or 0)
    N = int(sizes[1]) - P
    if not P or not N:
        return Model([])
    counted = (sample.mapInArrow(terms, "term string, whole boolean, pos long, neg long").groupBy("term", "whole")
               .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") * N > 8 * F.col("neg") * P)
               .orderBy(F.desc("pos"), "neg", F.desc(F.length("term")), "term", "whole").limit(50 * LEXICON))
    model = Model(choose_lexicon([tuple(r) for r in counted.collect()], P, N))
    if not model.automaton.entries:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(e, d, y) for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                    for e, d in {h[1:] for h in shared.value.hits(text)[0]}]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], names=["entry", "edits", "y"])

    seen = sample.mapInArrow(met, "entry int, edits int, y int").groupBy("entry", "edits").agg(F.sum("y"), F.count("*")).collect()
    pos, neg = np.zeros_like(model.weight), np.zeros_like(model.weight)
    for entry, edits, p, n in seen:
        pos[entry, edits], neg[entry, edits] = p, n - p
    # without evidence a misspelling counts like two toxic documents and a fifth of a clean one
    model.weight = np.maximum(0.0, np.log((pos + 2) / P) - np.log((neg + 0.2) / N) + np.log(share[1] * P / (share[0] * N)))
    weighted = docs.sparkSession.sparkContext.broadcast(model)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [weighted.value.features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(2).cast(pa.int32())], names=["x", "y"])

    # distinct rows with counts: at most 2 * per_class of them
    rows = sample.mapInArrow(rows_of, "x array<double>, y int").groupBy("x", "y").count().orderBy("x", "y").collect()
    y = np.array([r.y for r in rows], float)
    model.beta = logistic(np.array([r.x for r in rows]), y, row_weights(share, y, np.array([r["count"] for r in rows], float)))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps: intercept, then one coefficient per column."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + keep, x.T @ (n * (y - p)) - keep @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_documents(docs: DataFrame, model: Model, keep_columns: bool = False) -> DataFrame:
    """(doc_id, score, predicted) of every row, or all its columns and these two.

    ``score`` is between 0 and 1; null and empty texts get the score of a text without hits.  A model without labels of
    both classes scores 0.  Rows with null or repeated doc_ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            scores = shared.value.scores(text)
            own = batch.columns if keep_columns else [batch.column(batch.schema.get_field_index("doc_id"))]
            names = batch.schema.names if keep_columns else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))],
                                             names=[*names, "score", "predicted"])

    source = docs.drop("score", "predicted") if keep_columns else docs.select("doc_id", "text")
    kept = source.schema if keep_columns else source.select("doc_id").schema
    return source.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not predict as toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(shared.value.scores(text) < 0.5))

    return docs.mapInArrow(task, docs.schema)
