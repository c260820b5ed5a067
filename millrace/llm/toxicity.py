"""Operator 2, toxicity by maximum-scoring segments.

Tokens are scored by log-odds between toxic and clean labelled documents under Dirichlet priors, of either sign;
a linear-time scan (Ruzzo and Tompa) finds every maximal toxic passage; passages are judged by the extreme-value
law of maximal segment scores, E = K n exp(-lambda S), with lambda and K fitted to the maximal scores of the
clean sample; the significant ones are summed into a document's evidence, which a one-dimensional logistic fit
turns into a score between 0 and 1.

Counts are of documents, so that a document that repeats a word doesn't teach it twice.  Log-odds that the
sample can't tell from none (a signed root of the likelihood ratio below ``SIGNIFICANT``) count as none, so that a
long document's chance differences don't add up; every token without log-odds costs a small constant, the drift.

The classifier is fitted on a bounded sample of labelled rows (``TRAIN_ROWS`` per class, smallest hashes
first, near copies within a class once), never on held-out ones, and depends on these rows alone; everything
else covers whole texts of all documents.  Labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts have no tokens and get the score of no evidence; rows whose label is null,
or that are labelled both ways, are not learned from; an empty table gives no rows; with no labelled rows of one class every document's
score is below 1e-9.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import map_batches, staged
from .textkit import ngram_hashes, splitmix, split_words, word_hashes

#: Labelled rows of each class that the classifier is fitted on, at most.
TRAIN_ROWS = 8000
#: Weight of the Dirichlet prior in tokens, and the root of the likelihood ratio from which log-odds count.
PRIOR, SIGNIFICANT = 500.0, 4.5
#: Characters of a word's beginnings; the longest one with log-odds stands in for a word that the sample lacks.
STEMS = (3, 4, 5, 6)
#: Bands of min-hashes of 3-word runs; rows of a class that agree in all hashes of a band are near copies and teach once.
BANDS, BAND = 4, 2
#: Passages above this E-value are chance.
E_VALUE = 0.05

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time, by Ruzzo and Tompa."""
    total, found = 0.0, []  # found: [start, end, sum before, sum after]
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, r - left) for a, b, left, r in found]


def fit_extremes(best: np.ndarray, sizes: np.ndarray, least: float) -> tuple[float, float]:
    """lambda and K of P(S >= x) = 1 - exp(-K n exp(-lambda x)) by maximum likelihood.

    ``best`` are the maximal segment scores of texts of ``sizes`` tokens; a text without any segment is known to
    have stayed below ``least``, the smallest score of one token.  For a given lambda the best K is closed;
    lambda is searched on a grid.  One chance segment of the least score is added, so that K is never 0.
    """
    some = best > 0
    n, floor = np.maximum(np.append(sizes, 1.0), 1.0), np.append(np.where(some, np.maximum(best, least), least), least)
    hits = float(some.sum()) + 1
    total = float(floor[:-1][some].sum()) + least
    answer = (-math.inf, 1.0, 1e-3)
    for lam in np.geomspace(0.2, 3.0, 60):
        k = hits / float((n * np.exp(-lam * floor)).sum())
        answer = max(answer, (hits * (math.log(k) + math.log(lam)) - lam * total, float(lam), k))
    return answer[1], answer[2]


class Model:
    """Token scores, the drift of all other tokens, the extreme-value law and the logistic fit.

    A word that the sample knows as ordinary (``plain``) is not scored by its beginning."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], plain: frozenset[str] = frozenset(), drift: float = -0.02, lam: float = 1.0, k: float = 1e-3, slope: float = 1.0, base: float = -1.0):
        self.words, self.stems, self.plain = words, stems, plain
        self.drift, self.lam, self.k, self.slope, self.base = drift, lam, k, slope, base
        self.heads = frozenset(s[: STEMS[0]] for s in stems)

    def hits(self, found: list[str]) -> list[tuple[int, float]]:
        """(token, score) of the tokens with log-odds of their own or of their beginning."""
        words, heads, out, least = self.words, self.heads, [], STEMS[0]
        for i, w in enumerate(found):
            s = words.get(w)
            if s is None and w[:least] in heads:
                s = self._beginning(w)
            if s is not None:
                out.append((i, s))
        return out

    def _beginning(self, word: str) -> float | None:
        if word in self.plain:
            return None
        known = (self.stems.get(word[:n]) for n in reversed(STEMS) if len(word) >= n)
        return next((s for s in known if s is not None), None)

    def segments(self, found: list[str]) -> list[tuple[int, int, float]]:
        """(first token, end token, score) of all maximal segments."""
        hits = self.hits(found)
        if not hits:
            return []
        at = [i for i, _ in hits]
        steps: list[float] = []
        for k, (i, s) in enumerate(hits):
            steps += [self.drift * (i - at[k - 1] - 1) if k else 0.0, s]
        # Segments begin and end at a token that scores above 0.
        return [(at[a // 2], at[(b - 1) // 2] + 1, s) for a, b, s in maximal_segments(steps)]

    def passages(self, found: list[str]) -> list[tuple[int, int, float, float]]:
        """(first token, end token, score, E-value) of the significant maximal segments."""
        judged = ((a, b, s, self.k * len(found) * math.exp(-min(self.lam * s, 700.0))) for a, b, s in self.segments(found))
        return [x for x in judged if x[3] <= E_VALUE]

    def evidence(self, found: list[str]) -> float:
        """Summed -log10 of the passages' significance, damped so that long documents don't outgrow the fit."""
        return math.log1p(sum(-math.log10(max(e, 1e-300)) for _, _, _, e in self.passages(found)))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * evidence + self.base))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and base of P(y | x) by Newton's method."""
    w, a = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(toxic, text) of at most ``rows`` labelled documents of each class that are not held out.

    Near copies are told by hashes alone and go by the order of hashed ids; texts are joined last."""
    known = labels.filter(~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    usable = known.filter(F.col("toxic") == F.col("_most")).select("doc_id", "toxic")
    picked = [usable.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    # At most 2 x rows ids and labels, so the hint is bounded.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("text").alias("_text"), "text")
    names = [f"_b{k}" for k in range(BANDS)]

    def make():
        seeds = np.random.default_rng(7).integers(1, 1 << 63, (BANDS, BAND), np.uint64) | np.uint64(1)

        def run(cols):
            bands = []
            numbers, words, ends = split_words(cols["text"])
            flat = word_hashes(words)[numbers]
            for at, end in zip(ends[:-1], ends[1:], strict=True):
                runs = ngram_hashes(flat[at:end], 3)
                least = np.array([[splitmix(runs * s).min() if len(runs) else 0 for s in band] for band in seeds], np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(1, BAND):
                        least[:, 0] = splitmix(least[:, 0] * np.uint64(31) + least[:, k])
                bands.append(least[:, 0].view(np.int64).tolist())
            return {c: cols[c] for c in ("doc_id", "toxic", "_text")} | {n: [x[k] for x in bands] for k, n in enumerate(names)}

        return run

    kind = dict(docs.dtypes)["doc_id"]
    left = map_batches(sample, make, f"doc_id {kind}, toxic int, _text long, " + ", ".join(f"{n} long" for n in names))
    first = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "_text", *names)
    for name in names:
        left = left.groupBy("toxic", name).agg(F.min(first).alias("_r")).select("toxic", "_r.doc_id", "_r._text", *(f"_r.{n}" for n in names if n != name), *([name] if name != names[-1] else []))
    kept = staged(left.select("toxic", "doc_id", "_text"), "toxic-ids")
    # At most 2 x rows again.
    whole = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text").join(F.broadcast(kept), ["doc_id", "_text"]).dropDuplicates(["doc_id", "_text"])
    return staged(whole.select("toxic", "text"), "toxic-sample")


def fit(sample: DataFrame) -> Model:
    """The model from a staged (toxic, text) sample.  What is collected is bounded by the sample's own bound."""

    def make():
        def run(cols):
            n = {}
            for toxic, text in zip(cols["toxic"], cols["text"], strict=True):
                distinct = set(tokens(text))
                for key in [(0, w) for w in distinct] + [(k, x) for k in STEMS for x in {w[:k] for w in distinct if len(w) >= k}]:
                    n.setdefault(key, [0, 0])[toxic] += 1
            return {"kind": [k for k, _ in n], "token": [w for _, w in n], "clean": [v[0] for v in n.values()], "toxic": [v[1] for v in n.values()]}

        return run

    counts = map_batches(sample, make, "kind int, token string, clean long, toxic long").groupBy("kind", "token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = staged(counts, "toxic-counts")
    whole = {r["kind"]: (float(r["clean"]), float(r["toxic"])) for r in counts.groupBy("kind").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()}
    if 0 not in whole or not all(whole[0]):
        return Model({}, {}, base=-50.0)
    ratio, z = log_odds(whole)
    judged = counts.withColumns({"ratio": ratio, "z": z})
    tables: list[dict[str, float]] = [{}, {}]
    for r in judged.filter((F.abs("z") >= SIGNIFICANT) & ((F.col("kind") == 0) | (F.col("z") > 0))).collect():
        tables[r["kind"] > 0][r["token"]] = r["ratio"]
    ordinary = judged.filter((F.col("kind") == 0) & (F.col("clean") >= 2) & (F.col("z") < SIGNIFICANT))
    heads = sample.sparkSession.createDataFrame([(s,) for s in {x[: STEMS[0]] for x in tables[1]}], "_head string")
    plain = frozenset(r["token"] for r in ordinary.join(heads, F.substring("token", 1, STEMS[0]) == F.col("_head"), "left_semi").select("token").collect())
    model = Model(*tables, plain)
    stats = _probe(sample, model)
    n, n_hits, y = (np.array([r[c] for r in stats], float) for c in ("n", "n_hits", "toxic"))
    share = [min(0.4, n_hits[y == c].sum() / max(1.0, n[y == c].sum())) for c in (0, 1)]
    # The log-odds of a token without a score of its own, and a little more so that passages end.
    model.drift = min(-0.01, math.log((1 - share[1]) / (1 - share[0])))
    again = _probe(sample, model)
    clean = [r for r in again if not r["toxic"]]
    positive = [s for t in tables for s in t.values() if s > 0]
    model.lam, model.k = fit_extremes(np.array([r["best"] for r in clean]), np.array([r["n"] for r in clean], float), min(positive, default=1.0))
    last = _probe(sample, model)
    model.slope, model.base = fit_logistic(np.array([r["evidence"] for r in last]), np.array([r["toxic"] for r in last], float))
    return model


def log_odds(totals: dict[int, tuple[float, float]], prior: float = PRIOR) -> tuple[Column, Column]:
    """Columns of a table (kind, token, clean, toxic): the log-odds ratio between toxic and clean under a Dirichlet
    prior proportional to the tokens' overall use, and the signed root of the likelihood ratio against one rate
    for both.  Totals are given by kind as (clean, toxic)."""
    of = [F.create_map(*(F.lit(x) for kind, pair in totals.items() for x in (kind, pair[k]))) for k in (0, 1)]
    total = lambda k: of[k][F.col("kind")]
    both = F.col("toxic") + F.col("clean")
    share = both / (total(0) + total(1))
    side = lambda y, k: F.ln(y) - F.ln(F.greatest(total(k) + F.lit(prior) - y, F.lit(1e-9)))
    ratio = side(F.col("toxic") + F.lit(prior) * share, 1) - side(F.col("clean") + F.lit(prior) * share, 0)
    part = lambda y, k: F.when(y > 0, y * F.ln(y / (share * total(k)))).otherwise(0.0)
    g = 2 * (part(F.col("toxic"), 1) + part(F.col("clean"), 0))
    return ratio, F.signum(ratio) * F.sqrt(F.greatest(g, F.lit(0.0)))


def _probe(sample: DataFrame, model: Model):
    """Rows (at most two classes of TRAIN_ROWS) of toxic, tokens, hits, best segment and evidence, in one order however they are dealt."""

    def make():
        def run(cols):
            found = [tokens(t) for t in cols["text"]]
            best = [max((s for *_, s in model.segments(f)), default=0.0) for f in found]
            return {"toxic": cols["toxic"], "n": [len(f) for f in found], "n_hits": [len(model.hits(f)) for f in found], "best": best, "evidence": [model.evidence(f) for f in found]}

        return run

    return sorted(map_batches(sample, make, "toxic int, n long, n_hits long, best double, evidence double").collect())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the significant passages (code points, end exclusive, score, E-value)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def run(cols):
            out = {"doc_id": cols["doc_id"], "score": [], "passages": []}
            for text in cols["text"]:
                spans = model.passages(tokens(text))
                places = []
                if spans:
                    lower = text.lower()
                    same = len(lower) == len(text)  # lower-casing may lengthen a text; its places then refer to the lower-cased one
                    marks = [m.span() for m in _TOKEN.finditer(text if same else lower)]
                    if len(marks) != len(tokens(text)):
                        marks = [m.span() for m in _TOKEN.finditer(lower)]
                    places = [{"start": marks[a][0], "end": marks[b - 1][1], "score": s, "e_value": e} for a, b, s, e in spans]
                out["score"].append(model.score(math.log1p(sum(-math.log10(max(e, 1e-300)) for *_, e in spans))))
                out["passages"].append(places)
            return out | {"predicted": [int(s >= 0.7) for s in out["score"]]}

        return run

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, predicted int, passages array<struct<start: long, end: long, score: double, e_value: double>>")


def op2(spark, sf_dir):
    from .runtime import table

    docs = table(spark, sf_dir, "documents")
    model = fit(training_sample(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
