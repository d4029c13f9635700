"""Toxicity by Levenshtein automata over a lexicon trie (operator 10).

The lexicon is learned from labelled texts: whole words, and stems (word beginnings) whose words differ. A text's word is
turned into a Levenshtein automaton, in which swapped neighbours count as one error, and which is run along the lexicon's trie; terms that it accepts are misspelled or exact
hits. Whole terms of 4 characters on may have one error, of 8 on two, stems of 6 one; words of any length are looked up. A batch's distinct words pass two exact tests
before, which lose no hit: no term is as long and has as nearly the same characters, in numpy; then, no term is left
where as many characters are deleted from both as may be wrong. A misspelled form that clean labelled texts
use as a word of their own has no weight, or less.
Each hit is scored in a window of words around it: quotation marks and words of reporting speak for quotation, second persons
and further hits for abuse. A logistic regression on the sums of both kinds, exact and misspelled, gives the score. One narrow pass over whole texts.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import kept
from .labelled import bucket, labelled_sample
from .quality import logistic, scored

#: Labelled rows that a fit takes at most. The weights are fit to hits of a lexicon learned from the other half.
FIT_ROWS = 12_000
#: A term's least number of contexts in toxic texts, the least number as a share of those texts, and the least log odds.
MIN_TEXTS, MIN_SHARE, MIN_ODDS = 4, 0.01, 4.0
STEMS = (4, 5, 6)
#: A term of this length or more is only matched as it is written.
LONG = 64
WINDOW = 6
MEMO = 400_000
EDGE = ".,;:!?\"'()[]{}<>*&$%#|«»“”„‘’…-_~`/\\"
QUOTES = frozenset("\"«»“”„‘’")
REPORTING = frozenset("said says wrote writes called calls quoted quotes reported term word example slur dit écrit appelé sagte schrieb nannte dijo escribió llamó".split())
ADDRESS = frozenset("you your you're u ur du dich dir ihr tu te toi vous eres tú usted".split())


class Automaton:
    """The Levenshtein automaton of a word: a state is the row of edit distances, cut off above d, the row before it and the last character."""

    def __init__(self, word: str, d: int):
        self.word, self.d, self.moves = word, d, {}

    def start(self) -> tuple:
        return tuple(min(i, self.d + 1) for i in range(len(self.word) + 1)), None, ""

    def step(self, state: tuple, ch: str) -> tuple:
        got = self.moves.get((state, ch))
        if got is None:
            (old, before, last), most = state, self.d + 1
            row = [min(old[0] + 1, most)]
            for i, c in enumerate(self.word):
                v = min(row[-1] + 1, old[i] + (c != ch), old[i + 1] + 1, most)
                if before is not None and i and c == last and self.word[i - 1] == ch:
                    v = min(v, before[i - 1] + 1)
                row.append(v)
            got = self.moves[state, ch] = (tuple(row), old, ch)
        return got

    def alive(self, state: tuple) -> bool:
        return min(state[0]) <= self.d


def deletions(word: str, d: int) -> set[str]:
    """word, and what up to d deletions leave of it."""
    out = last = {word}
    for _ in range(d):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def errors(text: str, stem: bool) -> int:
    """Errors that a term may have: short ones would meet too many other words."""
    n = len(text)
    return 0 if n >= LONG else int(n >= 6) if stem else (n >= 4) + (n >= 8)


@dataclass
class Lexicon:
    """Terms with weights. A whole term must match a whole word, a stem the beginning of one. forms: factors of misspelled forms, 1 where absent."""

    terms: dict[tuple[str, bool], float]  # (text, is a stem) -> weight
    forms: dict[str, float] = field(default_factory=dict)
    trie: dict = field(default_factory=dict)
    left: list = field(default_factory=lambda: [set(), set(), set()])  # of whole terms with 0, 1 and 2 errors, what deletions leave
    stems: set = field(default_factory=set)
    loose_stems: set = field(default_factory=set)

    def __post_init__(self):
        for (text, stem), w in self.terms.items():
            node = self.trie
            for ch in text:
                node = node.setdefault(ch, {})
            node.setdefault("", []).append((text, stem, w))
            d = errors(text, stem)
            if stem:
                self.stems.add(text)
                self.loose_stems |= deletions(text, 1) if d else set()
            else:
                self.left[d] |= deletions(text, d)
        whole = [[len(t) for t, stem in self.terms if not stem and errors(t, stem) == d] for d in (1, 2)]
        self.spans = [(min(n) - d, max(n) + d) if n else (1, 0) for d, n in enumerate(whole, 1)]
        self.exact = {t for t, stem in self.terms if not stem}
        self.starts = sorted({len(t) for t in self.stems})
        self.loose_starts = sorted({len(t) + e for t in self.stems if errors(t, True) for e in (-1, 0, 1)})

    def may_match(self, word: str) -> bool:
        if word in self.exact or any(word[:k] in self.stems for k in self.starts):
            return True
        for d, (short, long) in enumerate(self.spans, 1):
            if short <= len(word) <= long and not self.left[d].isdisjoint(deletions(word, d)):
                return True
        return any(not self.loose_stems.isdisjoint(deletions(word[:k], 1)) for k in self.loose_starts if len(word) >= k)

    def lookup(self, word: str) -> tuple[float, int]:
        """The highest weight of a term that the word matches, divided by one more than the errors, and the errors; (0, 0) without any."""
        if not self.may_match(word):
            return 0.0, 0
        # only exact terms are as long as a long word, and a stem ends within its first characters
        long = len(word) > LONG + 2
        best = (self.terms.get((word, False), 0.0), 0) if long else (0.0, 0)
        automaton = Automaton(word[: STEMS[-1] + 1] if long else word, 2)
        todo = [(self.trie, automaton.start())]
        while todo:
            node, state = todo.pop()
            for ch, below in node.items():
                if ch:
                    to = automaton.step(state, ch)
                    if automaton.alive(to):
                        todo.append((below, to))
                    continue
                for text, stem, w in below:
                    d = min(state[0]) if stem else state[0][-1]
                    if d <= errors(text, stem) and (stem or not long):
                        best = max(best, (w / (1 + d) * (self.forms.get(word, 1.0) if d else 1.0), d))
        return best if best[0] > 0 else (0.0, 0)


def character_sets(words: list[str]) -> np.ndarray:
    """Of each word, not empty, the set of its characters, each one of 64 bits."""
    at = np.cumsum([0, *map(len, words[:-1])])
    return np.bitwise_or.reduceat(np.uint64(1) << (np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) & 63).astype(np.uint64), at)


class Lookups:
    """The words of a batch that a lexicon finds. Words that pass the first test are remembered with their (weight, errors)."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}
        whole, loose = ([t for t, stem in lexicon.terms if stem == kind and errors(t, stem)] for kind in (False, True))
        self.whole = list(zip(whole, character_sets(whole).tolist(), strict=True)) if whole else []
        self.loose = character_sets(loose).tolist() if loose else []

    def candidates(self, words: list[str]) -> np.ndarray:
        """Whether a word may be one of the lexicon's, by its exact beginning, or by length and characters."""
        lex = self.lexicon
        out = np.array([w in lex.exact or any(w[:k] in lex.stems for k in lex.starts) for w in words], bool)
        sets, n = character_sets(words), np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(n, kind="stable")
        n = n[order]
        for term, mask in self.whole:
            d, mask = errors(term, False), np.uint64(mask)
            at = order[np.searchsorted(n, len(term) - d, "left") : np.searchsorted(n, len(term) + d, "right")]
            own = sets[at]
            out[at] |= (np.bitwise_count(own & ~mask) <= d) & (np.bitwise_count(mask & ~own) <= d)
        if self.loose:
            heads = character_sets([w[: STEMS[-1] + 1] for w in words])
            for mask in self.loose:
                out |= np.bitwise_count(np.uint64(mask) & ~heads) <= 1
        return out

    def found(self, texts: list[list[str]]) -> dict[str, tuple[float, int]]:
        """(weight, errors) of each word, with its marks, that the lexicon finds."""
        raw = list(set().union(*texts))
        bare = [w.strip(EDGE) for w in raw]
        long = [i for i, w in enumerate(bare) if len(w) > 1]
        if not long:
            return {}
        out = {}
        for i in np.array(long)[self.candidates([bare[i] for i in long])].tolist():
            got = self.known.get(bare[i])
            if got is None:
                got = self.lexicon.lookup(bare[i])
                if len(self.known) >= MEMO:
                    self.known.clear()
                self.known[bare[i]] = got
            if got[0]:
                out[raw[i]] = got
        return out


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def hits(words: list[str], lexicon_words: dict) -> list[tuple[int, float, int, float]]:
    """(word's place, weight, errors, share of abuse from 0 to 1) of each hit of the lexicon."""
    if lexicon_words.keys().isdisjoint(words):
        return []
    found = [(i, *lexicon_words[w]) for i, w in enumerate(words) if w in lexicon_words]
    out = []
    places = [i for i, _, _ in found]
    for k, (i, w, d) in enumerate(found):
        near = [x.strip(EDGE) for x in words[max(0, i - WINDOW) : i + WINDOW + 1]]
        quoted = words[i][0] in QUOTES or words[i].rstrip(".,;:!?")[-1:] in QUOTES
        report = sum(x in REPORTING for x in near)
        address = sum(x in ADDRESS for x in near)
        more = sum(0 < abs(places[j] - i) <= WINDOW for j in range(max(0, k - WINDOW), min(len(places), k + WINDOW + 1)))
        z = 1.5 + address + more - 2.0 * quoted - 1.0 * report
        out.append((i, w, d, 1 / (1 + math.exp(-z))))
    return out


FEATURES = 7


#: Texts whose words are looked up together.
TOGETHER = 256


def features(texts: list, lookups: Lookups) -> list[list[float]]:
    out = []
    for at in range(0, len(texts), TOGETHER):
        words = [words_of(t) for t in texts[at : at + TOGETHER]]
        found = lookups.found(words)
        out += [measures(w, found) for w in words]
    return out


def measures(words: list[str], found: dict) -> list[float]:
    """Of all hits; and of the misspelled ones again, so that a fit can trust them less. Where labelled texts have none, they count as the others do."""
    got = hits(words, found)
    n = max(1, len(words))
    if not got:
        return [0.0] * FEATURES
    abuse, quote = np.array([(w * c, w * (1 - c)) for _, w, _, c in got]).T
    loose = np.array([w * c for _, w, d, c in got if d])
    return [float(abuse.max()), float(np.log1p(abuse.sum())), float(np.sqrt(abuse.sum() / n)), float(np.log1p(quote.sum())), float(loose.max(initial=0)), float(np.log1p(loose.sum())), 1.0]


@dataclass
class ToxicityModel:
    terms: dict
    weights: np.ndarray | None
    prior: float
    part: int = 2
    forms: dict = field(default_factory=dict)
    lookups: Lookups | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "prior": self.prior, "part": self.part, "forms": self.forms, "lookups": None}

    def table(self) -> Lookups:
        """What a worker remembers of the lexicon, kept from task to task while the lexicon is the same."""
        if self.lookups is None:
            key = hash((tuple(sorted(self.terms.items())), tuple(sorted(self.forms.items()))))
            self.lookups = kept((f"lookups {self.part}", key), lambda: Lookups(Lexicon(self.terms, self.forms)))
        return self.lookups

    def scores(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x = np.array(features(texts, self.table())).reshape(len(texts), FEATURES)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -40, 40)))


def terms_of(text: str) -> set[tuple[str, bool, int]]:
    """The terms that a text can teach, its words and their beginnings, each with a hash of the words before and after it.

    A term is supported by the contexts it is seen in: the words of a text that was copied, even with edits, have one context.
    """
    bare = [w.strip(EDGE) for w in words_of(text)]
    out = set()
    for w, before, after in zip(bare, ["", *bare], [*bare[1:], ""], strict=False):
        if len(w) > 1:
            at = zlib.crc32(f"{before} {after}".encode())
            out.add((w, False, at))
            out.update((w[:k], True, at) for k in STEMS if len(w) > k)
    return out


def lexicon_terms(rows: list[tuple[str, bool, int, int, int]], toxic: int, clean: int) -> dict[tuple[str, bool], float]:
    """(term, stem, toxic texts, clean texts, contexts) -> weights. A stem goes if a shorter one that is kept says as much; whole terms stay for their misspellings."""
    kept: dict = {}
    for term, stem, a, b, support in sorted(rows, key=lambda r: (len(r[0]), not r[1], r[0])):
        odds = float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
        if support >= max(MIN_TEXTS, MIN_SHARE * toxic) and odds >= MIN_ODDS:
            above = max([kept.get((term[:k], True), 0) for k in range(STEMS[0], len(term))], default=0) if stem else 0
            if not above or odds > above + 1.5:
                kept[term, stem] = odds
    return kept if toxic and clean else {}


def toxicity_model(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, fold: int = 2, at_most: int = FIT_ROWS) -> ToxicityModel:
    """A lexicon and weights from about `at_most` labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, label_col, held_out=lambda c: bucket(c, folds) == fold, at_most=at_most, id_col=id_col, text_col=text_col)

    def taught(batches):
        """Each context of a term in toxic texts; as context -1, the number of texts with the term; as term '', of all texts."""
        import pyarrow as pa

        for b in batches:
            seen: dict = {}
            for t, y, h in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                seen[h, "", False, y, -1] = seen.get((h, "", False, y, -1), 0) + 1
                found = terms_of(t.as_py())
                for term, stem, at in {(term, stem, -1) for term, stem, _ in found} | (found if y else set()):
                    seen[h, term, stem, y, at] = seen.get((h, term, stem, y, at), 0) + 1
            keys = list(seen)
            kinds = (pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)), pa.array(list(seen.values()), pa.int64())], ["half", "term", "stem", "label", "at", "n"])

    seen = sample.mapInArrow(taught, "half int, term string, stem boolean, label int, at long, n long")
    contexts = seen.groupBy("half", "term", "stem", "label", "at").agg(F.sum("n").alias("n"))
    texts = lambda y, h: F.coalesce(F.sum(F.when((F.col("at") == -1) & (F.col("label") == y) & (F.col("half") == h), F.col("n"))), F.lit(0))
    support = lambda h: F.count(F.when((F.col("at") >= 0) & (F.col("half") == h), 1))
    both = contexts.groupBy("term", "stem").agg(*[f.alias(f"{n}{h}") for h in (0, 1) for n, f in (("toxic", texts(1, h)), ("clean", texts(0, h)), ("support", support(h)))])
    # bounded by the sample: terms of at most at_most texts with at least MIN_TEXTS toxic ones
    rows = [tuple(r) for r in both.where(f"term = '' or (support0 + support1 >= {MIN_TEXTS} and toxic0 + toxic1 > clean0 + clean1)").collect()]
    sizes = next((r[2:] for r in rows if r[0] == ""), (0,) * 6)
    rows = [r for r in rows if r[0]]
    chosen = [lexicon_terms([(*r[:2], *r[2 + 3 * h : 5 + 3 * h]) for r in rows], *sizes[3 * h : 3 * h + 2]) for h in (0, 1)]
    toxic, clean = sizes[0] + sizes[3], sizes[1] + sizes[4]
    terms = lexicon_terms([(*r[:2], *(r[k] + r[k + 3] for k in (2, 3, 4))) for r in rows], toxic, clean)
    prior = (toxic + 1) / (toxic + clean + 2)
    if not terms or not toxic or not clean:
        return ToxicityModel({}, None, prior)
    lexicons = [ToxicityModel(t, None, 0.5, k) for k, t in enumerate((*chosen, terms))]

    def misspelled(batches):
        """The misspelled forms that each lexicon finds in the texts it was learned from: (lexicon, form, label), once a text."""
        import pyarrow as pa

        for b in batches:
            texts, out = [words_of(t.as_py()) for t in b.column(0)], []
            found = [m.table().found(texts) for m in lexicons]
            for words, y, h in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for k in (h, 2):
                    out += [(k, f, y) for f in {w.strip(EDGE) for w in set(words) & found[k].keys() if found[k][w][1]}]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.int32()))], ["lexicon", "form", "label"])

    counted = sample.mapInArrow(misspelled, "lexicon int, form string, label int").groupBy("lexicon", "form").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    # bounded by the sample: forms in its clean texts
    for r in counted.where("b > 0").collect():
        t, c = (sizes[3 * r["lexicon"]], sizes[3 * r["lexicon"] + 1]) if r["lexicon"] < 2 else (toxic, clean)
        odds = float(np.log((r["a"] + 0.5) / (t + 1)) - np.log((r["b"] + 0.5) / (c + 1)))
        lexicons[r["lexicon"]].forms[r["form"]] = min(1.0, max(0.0, odds / MIN_ODDS - 0.5))
    for m in lexicons:
        m.lookups = None
    # the weights are fit to what each half's lexicon finds in the other half
    tables = [lexicons[1], lexicons[0]]

    def measured(batches):
        import pyarrow as pa

        for b in batches:
            both = [features(b.column(0).to_pylist(), m.table()) for m in tables]
            x = [both[h][i] for i, h in enumerate(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "label"])

    got = sorted((r["x"], r["label"]) for r in sample.mapInArrow(measured, "x array<double>, label int").collect())
    return ToxicityModel(terms, logistic(np.array([r[0] for r in got]), np.array([r[1] for r in got], float)), prior, forms=lexicons[2].forms)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, fold: int = 2, threshold: float = 0.3, at_most: int = FIT_ROWS) -> DataFrame:
    """docs -> (id, held_out, score, predicted), one row per input row.

    Null texts score as empty ones. A null id is never held out. Without labels of both classes the score is the share of label 1
    among those there are, and 0.5 without any. Repeated rows repeat; an empty table gives none.
    """
    model = toxicity_model(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, fold=fold, at_most=at_most)
    return scored(docs, model, id_col, text_col, folds, fold, threshold)
