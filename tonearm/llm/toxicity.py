"""Toxicity by a learned lexicon, matched through Levenshtein automata.

A lexicon of whole words and word stems is learned from labelled rows, kept as a trie, and the trie is
intersected with the Levenshtein automaton of each word by following sets of (trie node, edits so far); the sets
and their steps are remembered, so the automaton becomes deterministic as it is used. A hit's weight is how much
more often its term, at its number of edits, stands in toxic training texts than in clean ones; a hit between
paired quotation marks or beside a verb of reporting counts less, by a factor learned from such hits. The score is a logistic regression over the weights'
sum, their density in the text, the number of hits and the largest weight.

Defined results: a null text is the empty text; texts without hits, empty ones too, get the regression's score of
no hit; without labelled rows of both classes every text gets BASE_SCORE; rows that repeat are scored each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the lexicon is learned from, at most: so many toxic and so many clean ones, by the hash of their identifier.
TOXIC_SAMPLE, CLEAN_SAMPLE = 8_000, 16_000
STEM_CHARS = (4, 10)
MIN_SUPPORT, MIN_SHARE, MIN_RATIO = 5, 0.02, 5.0
#: UNSEEN: the share of its exact weight that a misspelt whole word gets which no training text has. Weights below LEAST_WEIGHT count as none.
BASE_SCORE, QUOTED, UNSEEN, LEAST_WEIGHT = 0.02, 0.35, 0.6, 1.5
CONTEXT_CHARS = 48
MEMO_WORDS, MEMO_STATES = 200_000, 20_000
#: Hits in quotations that the discount is learned from at least; with fewer it is QUOTED.
LEAST_QUOTED = 20
#: Verbs of reporting, and quotation marks: each closing mark with those that open it. The straight mark opens and closes in turn, inside a line.
REPORTING = {"said", "says", "wrote", "quoted", "quote", "dit", "écrit", "citation", "sagte", "schrieb", "zitat", "dijo", "escribió", "cita"}
PAIRS = {"”": "“", "“": "„", "»": "«", "›": "‹"}
_MARKS = re.compile("[\"“”„«»‹›\n]")

_WORD = re.compile(r"[^\W_]+")


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def allowed_edits(term: str) -> int:
    n = len(term.rstrip("$"))
    return 0 if n < 5 else 1 if n < 8 else 2


class Automaton:
    """terms: strings; a term that ends in $ is a whole word, any other the start of a word."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.budget: list[int] = [0]
        for t, term in enumerate(terms):
            node, edits = 0, allowed_edits(term)
            self.budget[0] = max(self.budget[0], edits)
            for c in term.rstrip("$"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], edits)
            self.ends[node].append(t)
        self.alphabet = {c for kids in self.children for c in kids}
        self._reset()

    def _reset(self):
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0}, ())

    def _state(self, nodes: dict[int, int], stems: tuple) -> int:
        """Closes nodes (fewest edits by trie node) under letters left out, and notes the stems that are complete."""
        todo = list(nodes.items())
        while todo:
            node, edits = todo.pop()
            if edits < self.budget[node]:
                for child in self.children[node].values():
                    if edits + 1 <= self.budget[child] and nodes.get(child, 99) > edits + 1:
                        nodes[child] = edits + 1
                        todo.append((child, edits + 1))
        done = dict(stems)
        for node, edits in nodes.items():
            for t in self.ends[node]:
                if not self.terms[t].endswith("$") and edits <= allowed_edits(self.terms[t]):
                    done[t] = min(edits, done.get(t, 99))
        key = frozenset(nodes.items()), tuple(sorted(done.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        nodes, stems = self.states[state]
        out: dict[int, int] = {}

        def reach(node, edits):
            if edits <= self.budget[node] and out.get(node, 99) > edits:
                out[node] = edits

        for node, edits in nodes:
            for k, child in self.children[node].items():
                reach(child, edits + (k != c))
            reach(node, edits + 1)
        return self._state(out, stems)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the closest term."""
        if len(self.states) > MEMO_STATES:
            self._reset()
        state = self.start
        for c in word:
            c = c if c in self.alphabet else ""
            if (then := self.steps.get((state, c))) is None:
                then = self.steps[state, c] = self._step(state, c)
            state = then
            if not self.states[state][0] and not self.states[state][1]:
                return None
        nodes, stems = self.states[state]
        best = [(e, t) for t, e in stems]
        best += [(e, t) for node, e in nodes for t in self.ends[node] if self.terms[t].endswith("$") and e <= allowed_edits(self.terms[t])]
        return min(best)[::-1] if best else None


class Matcher:
    """Which words hit; most words don't, and are remembered as such."""

    _built: tuple = ()

    def __init__(self, terms: list[str]):
        self.automaton, self.clean, self.hits = Automaton(terms), set(), {}

    @classmethod
    def forget(cls) -> None:
        cls._built = ()

    @classmethod
    def of(cls, terms: list[str]) -> Matcher:
        common.holds("toxicity", cls.forget)
        if not cls._built or cls._built[0] != terms:
            cls._built = terms, cls(terms)
        return cls._built[1]

    def find(self, words: set[str]) -> dict[str, tuple[int, int]]:
        if len(self.clean) > MEMO_WORDS:
            self.clean = set()
        out = {}
        for w in words - self.clean:
            hit = self.hits.get(w) or self.automaton.match(w)
            if hit:
                out[w] = self.hits[w] = hit
            else:
                self.clean.add(w)
        if len(self.hits) > MEMO_WORDS:
            self.hits = {}
        return out


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between paired quotation marks, in order of their ends. A mark without a partner quotes nothing."""
    out, opened = [], {}
    for m in _MARKS.finditer(text):
        c, at = m[0], m.start()
        if c == "\n":
            opened.pop('"', None)
        elif c == '"' and c in opened:
            out.append((opened.pop(c), at))
        elif PAIRS.get(c) in opened:
            out.append((opened.pop(PAIRS[c]), at))
        else:
            opened[c] = at
    return out


def reported(text: str, a: int, b: int) -> bool:
    """Whether a verb of reporting stands right before or behind."""
    before, after = text[max(0, a - CONTEXT_CHARS) : a], text[b : b + CONTEXT_CHARS]
    return not REPORTING.isdisjoint(_WORD.findall(before)[-3:]) or not REPORTING.isdisjoint(_WORD.findall(after)[:2])


def hits_in(matcher: Matcher, text: str) -> list[tuple[int, int, bool]]:
    """(term, edits, quoted) of each place of a hit."""
    text = text.lower()
    found = matcher.find(set(_WORD.findall(text)))
    if not found:
        return []
    spans = quotations(text)
    ends = [b for _, b in spans]
    begins = [*accumulate((a for a, _ in reversed(spans)), min)][::-1]  # the first begin of the quotations that end there or later

    def quoted(a: int, b: int) -> bool:
        k = bisect_left(ends, b)  # quotations end in order
        return (k < len(begins) and begins[k] < a) or reported(text, a, b)

    return [(*found[m[0]], quoted(*m.span())) for m in _WORD.finditer(text) if m[0] in found]


def features(hits: list[tuple[int, int, bool]], n_words: int, weights: dict[tuple[int, int], float], discount: float = QUOTED) -> list[float]:
    own = [w * (discount if q else 1) for t, e, q in hits if (w := weights.get((t, e), 0))]
    total = sum(own)
    return [math.log1p(total), min(100 * total / max(n_words, 20), 50.0), math.log1p(len(own)), max(own, default=0.0), float(len(own) > 1)]


def training_sample(labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, toxic) of the training fold: those identifiers whose crc32, as text, is not 0 mod 5."""
    rows = common.clean_columns(labels, doc_id=id_col, toxic=label_col).where(f"toxic in (0, 1) and {TRAINING}").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("at", F.xxhash64("doc_id"))
    parts = [rows.where(F.col("toxic") == y).orderBy("at", "doc_id").limit(n) for y, n in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE))]
    return parts[0].unionByName(parts[1]).select("doc_id", "toxic")


TRAINING = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"


class Model:
    def __init__(self, terms: list[str], weights: dict[tuple[int, int], float], coefficients: list[float], intercept: float, discount: float = QUOTED):
        self.terms, self.weights, self.coefficients, self.intercept, self.discount = terms, weights, coefficients, intercept, discount

    def score(self, hits: list[tuple[int, int, bool]], n_words: int) -> float:
        z = self.intercept + sum(c * x for c, x in zip(self.coefficients, features(hits, n_words, self.weights, self.discount)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample = common.stored(training_sample(labels), "toxic-sample")
    docs = common.clean_columns(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    docs = common.stored(docs.where("text is not null"), "toxic-train")
    n = {r["toxic"]: r["n"] for r in docs.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model([], {}, [], math.log(BASE_SCORE / (1 - BASE_SCORE)))

    def word_counts(batches):
        both = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(common.texts(common.column(batch, "text")), common.column(batch, "toxic").to_pylist()):
                both[y].update(set(word_list(text)))
        ws = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([both[1][w] for w in ws], pa.int64()), pa.array([both[0][w] for w in ws], pa.int64())], names=["word", "t", "c"])

    counted = docs.mapInArrow(word_counts, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    stems = F.transform(F.sequence(F.lit(STEM_CHARS[0]), F.lit(STEM_CHARS[1])), lambda k: F.when(F.length("word") >= k, F.substring("word", F.lit(1), k)))
    terms = counted.where(F.length("word") >= STEM_CHARS[0]).select(F.explode(F.array_compact(F.array_append(stems, F.concat("word", F.lit("$"))))).alias("term"), "t", "c")
    support = max(MIN_SUPPORT, math.ceil(MIN_SHARE * n1))
    terms = terms.groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where((F.col("t") >= support) & (F.col("t") / n1 >= MIN_RATIO * (F.col("c") + 0.5) / n0))
    lexicon = choose_terms({r["term"]: r["t"] for r in terms.collect()})

    def hit_counts(batches):
        matcher, both = Matcher.of(lexicon), {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(common.texts(common.column(batch, "text")), common.column(batch, "toxic").to_pylist()):
                hits = hits_in(matcher, text)
                both[y].update((t, e) for t, e, _ in hits)
                both[y].update((-2, int(q)) for *_, q in hits)
                both[y][-1, 0] += len(_WORD.findall(text))
        keys = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array([both[1][k] for k in keys], pa.int64()), pa.array([both[0][k] for k in keys], pa.int64())], names=["term", "edits", "t", "c"])

    seen = {(r["term"], r["edits"]): (r["t"], r["c"]) for r in docs.mapInArrow(hit_counts, "term int, edits int, t long, c long").groupBy("term", "edits").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()}
    w1, w0 = seen.get((-1, 0), (1, 1))
    evidence = lambda t, c: math.log((t + 0.5) / max(w1, 1) / ((c + 0.5) / max(w0, 1)))
    outside, inside = seen.get((-2, 0), (0, 0)), seen.get((-2, 1), (0, 0))
    discount = min(1.0, max(0.0, evidence(*inside) / max(evidence(*outside), 0.1))) if min(sum(inside), sum(outside)) >= LEAST_QUOTED else QUOTED
    weights = {}
    for k, term in enumerate(lexicon):
        for e in range(allowed_edits(term) + 1):
            t, c = seen.get((k, e), (0, 0))
            surely = min(6.0, evidence(t, c)) if t or c else UNSEEN * weights[k, 0] * term.endswith("$")
            weights[k, e] = surely if surely >= LEAST_WEIGHT else 0.0

    def rows(batches):
        matcher = Matcher.of(lexicon)
        for batch in batches:
            xs = [features(hits_in(matcher, t), len(_WORD.findall(t)), weights, discount) for t in common.texts(common.column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([common.column(batch, "toxic").cast(pa.float64()), pa.array(xs, pa.list_(pa.float64()))], names=["toxic", "x"])

    points = common.stored(docs.mapInArrow(rows, "toxic double, x array<double>"), "toxic-points")
    fitted = LogisticRegression(labelCol="toxic", regParam=1e-3, maxIter=50).fit(points.select("toxic", array_to_vector("x").alias("features")))
    return Model(lexicon, weights, fitted.coefficients.toArray().tolist(), float(fitted.intercept), discount)


def choose_terms(support: dict[str, int]) -> list[str]:
    """Of each chain of growing stems the longest that keeps the support, then those without a shorter one in the list."""
    closed = [t for t, n in support.items() if t.endswith("$") or not any(len(o) == len(t) + 1 and o.startswith(t) and m >= 0.95 * n for o, m in support.items())]
    out: list[str] = []
    for t in sorted(closed, key=lambda t: (len(t.rstrip("$")), t)):
        if not any(not o.endswith("$") and t.startswith(o) for o in out):
            out.append(t)
    return out


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_hits, terms (those hit) of every row."""
    docs = common.clean_columns(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    terms = model.terms

    def run(batches):
        matcher = Matcher.of(terms)
        for batch in batches:
            texts = common.texts(common.column(batch, "text"))
            hits = [hits_in(matcher, t) for t in texts]
            scores = [model.score(h, len(_WORD.findall(t)) if h else 0) for h, t in zip(hits, texts)]
            yield pa.RecordBatch.from_arrays(
                [common.column(batch, "doc_id"), pa.array(scores, pa.float64()), pa.array([len(h) for h in hits], pa.int32()), pa.array([sorted({terms[t] for t, *_ in h}) for h in hits], pa.list_(pa.string()))],
                names=["doc_id", "score", "n_hits", "terms"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, score double, n_hits int, terms array<string>")


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the model doesn't call toxic."""
    terms = model.terms

    def run(batches):
        matcher = Matcher.of(terms)
        for batch in batches:
            texts = common.texts(common.column(batch, text_col))
            hits = [hits_in(matcher, t) for t in texts]
            yield batch.filter(pa.array([model.score(h, len(_WORD.findall(t)) if h else 0) < 0.5 for h, t in zip(hits, texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, common.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr(f"not ({TRAINING})").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
