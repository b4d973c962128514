"""Toxic passages by maximum-scoring segments of token log-odds (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StructField,
    StructType,
)

from tracelake.llm.common import cut, let_go, whole_text

#: Labelled documents that a model is learned from, about: drawn by a hash of doc_id.
LABELLED = 12_000
#: Tokens and stems of a model at most, the strongest first; its size goes to every task.
TOKENS = 50_000
#: Letters of the stems that stand for longer tokens besides the whole token.
STEMS = (4, 5)
#: Entries of a task's table of token weights; a full table is emptied.
_CACHE = 200_000
#: Tokens seen in fewer different contexts than this teach nothing.
SUPPORT = 5
#: Weight of the prior, in parts of the toxic tokens seen.
PRIOR = 0.1
#: Standard deviations by which a log-odds ratio is drawn back towards zero.
SHRINK = 2.6
#: Taken off every token's score, so that a segment ends where toxic tokens thin out.
DRIFT = 0.25
_EULER = 0.5772156649015329
_TOKEN = regex.compile(r"\p{L}+")
_PASSAGE = StructType(
    [
        StructField("start", LongType()),
        StructField("end", LongType()),
        StructField("score", DoubleType()),
    ]
)
_SCORED = StructType(
    [
        StructField("score", DoubleType()),
        StructField("passages", ArrayType(_PASSAGE)),
    ]
)


@dataclass
class Model:
    weights: dict[str, float]
    #: Segments of clean text above ``floor``: how many a token, and how fast they thin out.
    floor: float
    log_k: float
    rate: float
    #: Logistic line over what ``_features`` gives.
    line: tuple[float, ...]


class _Weights(dict):
    """Token -> the weight of the token or of one of its stems: the most toxic, if any is."""

    def __init__(self, learned: dict[str, float]) -> None:
        super().__init__()
        self.learned = learned

    def __missing__(self, token: str) -> float:
        if len(self) >= _CACHE:
            self.clear()
        stems = (token[:n] + "*" for n in STEMS if len(token) > n)
        found = [self.learned.get(x, 0.0) for x in (token, *stems)]
        weight = self[token] = max(found) if max(found) > 0 else min(found)
        return weight


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, sum), disjoint and in order, in linear time."""
    kept: list[tuple[int, int, float, float, int]] = []  # begin, end, sum before, sum after, link
    total = 0.0
    for i, score in enumerate(scores):
        total += score
        if score <= 0:
            continue
        begin, before = i, total - score
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]  # all between have at least as large a sum before them
            if j < 0 or kept[j][3] >= total:
                kept.append((begin, i + 1, before, total, j))
                break
            begin, before = kept[j][0], kept[j][2]
            del kept[j:]
    return [(b, e, after - before) for b, e, before, after, _ in kept]


def _segments(tokens: list[str], weights: _Weights) -> list[tuple[int, int, float]]:
    """Maximal segments of a text's tokens; a run without weights is one negative score."""
    found = [(i, w) for i, w in enumerate(map(weights.__getitem__, tokens)) if w]
    if not found:
        return []
    scores: list[float] = []
    at: list[tuple[int, int]] = []
    last = found[0][0]
    for i, w in found:
        if i > last:
            scores.append(-DRIFT * (i - last))
            at.append((last, i))
        scores.append(w - DRIFT)
        at.append((i, i + 1))
        last = i + 1
    return [(at[b][0], at[e - 1][1], s) for b, e, s in maximal_segments(scores)]


def _surprise(n: int, score: float, floor: float, log_k: float, rate: float) -> float:
    """Minus the logarithm of how many segments of n clean tokens score as much."""
    return rate * (score - floor) - log_k - float(np.log(max(n, 1)))


def _features(n: int, scores: list[float], tail: tuple[float, float, float]) -> tuple[float, float]:
    """Surprise of a text's best segment, and of all that surprise together, damped."""
    clear = [x for x in (_surprise(n, s, *tail) for s in scores if s > tail[0]) if x > 0]
    return float(np.log1p(max(clear, default=0.0))), float(np.log1p(sum(clear)))


def _tail(clean: list[list[float]]) -> tuple[float, float, float]:
    """floor, log_k and rate of clean texts' segments: scores above a high one are
    exponential, so that the best one's is an extreme-value distribution of the first kind."""
    tokens = max(sum(s[0] for s in clean), 1.0)
    scores = np.array([x for s in clean for x in s[1:]])
    if len(scores) < 10:
        return 0.5, float(np.log(1 / tokens)), 2.0
    floor = float(np.quantile(scores, 0.9))
    over = scores[scores > floor] - floor
    rate = float(np.clip(1 / over.mean(), 0.2, 10.0)) if len(over) else 2.0
    return floor, float(np.log(max(len(over), 1) / tokens)), rate


def _log_odds(one: Column, zero: Column, prior: Column, totals: tuple[float, float, float]) -> Column:
    """Log-odds ratio with an informative Dirichlet prior, drawn back by its uncertainty."""
    n1, n0, a0 = totals
    a, b = one + prior, zero + prior
    ratio = F.log(a / (n1 + a0 - a)) - F.log(b / (n0 + a0 - b))
    doubt = SHRINK * F.sqrt(1 / a + 1 / b)
    return F.when(ratio > doubt, ratio - doubt).when(ratio < -doubt, ratio + doubt).otherwise(0.0)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, fold of about LABELLED labelled documents."""
    known = labels.where("toxic is not null and doc_id is not null")
    step = max(1, known.count() // LABELLED)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(step)) == 0
    known = known.where(drawn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.where(drawn).select("doc_id", whole_text().alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int")
    return texts.join(known, "doc_id").select(
        "text", (F.col("toxic") > 0).cast("int").alias("toxic"), fold.alias("fold")
    )


def _weights(sample: DataFrame) -> list[dict[str, float]]:
    """Weights of tokens and stems learned from both folds, and from either one.

    A token counts once in each context of its two neighbours, so that copies of a text, of
    which there may be thousands, teach no more than one.
    """
    tokens = F.concat(
        F.array(F.lit("")), F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")), F.array(F.lit(""))
    )
    words = sample.select("toxic", "fold", tokens.alias("w"))
    each = words.select("toxic", "fold", "w", F.explode(F.expr("sequence(1, size(w) - 2)")).alias("i"))
    each = each.where("i > 0 and i < size(w) - 1")
    seen = each.select(
        "toxic",
        "fold",
        F.expr("w[i]").alias("token"),
        F.expr("xxhash64(w[i - 1], w[i], w[i + 1])").alias("around"),
    ).distinct()
    stems = (f"if(length(token) > {n}, concat(left(token, {n}), '*'), null)" for n in STEMS)
    units = F.expr(f"explode(filter(array(token, {', '.join(stems)}), x -> x is not null))")
    seen = seen.select("toxic", "fold", units.alias("token"))
    split = [(y, f) for y in (1, 0) for f in (0, 1)]
    of = {(y, f): F.count_if((F.col("toxic") == y) & (F.col("fold") == f)) for y, f in split}
    counts = seen.groupBy("token").agg(*(c.alias(f"y{y}f{f}") for (y, f), c in of.items()))
    counts = cut(counts.where(f"y1f0 + y1f1 + y0f0 + y0f1 >= {SUPPORT}"))
    sums = counts.agg(*(F.sum(f"y{y}f{f}").alias(f"y{y}f{f}") for y, f in split)).first()
    total = sum(sums[f"y{y}f{f}"] or 0 for y, f in split)
    if not total:
        return [{}, {}, {}]
    every = sum(F.col(f"y{y}f{f}") for y, f in split)
    columns = []
    for i, folds in enumerate(((0, 1), (0,), (1,))):
        n1, n0 = (float(sum(sums[f"y{y}f{f}"] for f in folds)) for y in (1, 0))
        a0 = max(PRIOR * n1, 1.0)
        one, zero = (sum(F.col(f"y{y}f{f}") for f in folds) for y in (1, 0))
        columns.append(_log_odds(one, zero, every * (a0 / total), (n1, n0, a0)).alias(f"w{i}"))
    table = counts.select("token", *columns).where("w0 <> 0 or w1 <> 0 or w2 <> 0")
    strongest = F.greatest(*(F.abs(f"w{i}") for i in range(3)))
    rows = table.orderBy(strongest.desc(), "token").limit(TOKENS).collect()
    return [{r["token"]: r[f"w{i}"] for r in rows if r[f"w{i}"]} for i in range(3)]


def _seen(text: Column, fold: Column, weights: list[dict[str, float]]) -> Column:
    """Number of tokens and segment scores of a text, by the fold it was not learned from."""

    def scan(texts: pa.Array, folds: pa.Array) -> pa.Array:
        out, known = [], [_Weights(w) for w in weights]
        for text, fold in zip(texts.to_pylist(), folds.to_pylist(), strict=True):
            tokens = _TOKEN.findall(text.lower())
            out.append([float(len(tokens)), *(s for *_, s in _segments(tokens, known[2 - fold]))])
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(scan, ArrayType(DoubleType()))(text, fold)


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps, with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    line, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ line)
        line = line + step
        if np.abs(step).max() < 1e-8:
            break
    return line


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled documents; from a drawn sample of them where there are more.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic. Rows without id or label
    teach nothing; of several labels of a document the largest counts. The distribution of
    clean scores and the line are fitted on documents scored by the model of the other half.
    """
    sample = cut(_sample(docs, labels))
    weights = _weights(sample)
    scanned = sample.select("toxic", _seen(F.col("text"), F.col("fold"), weights).alias("s"))
    rows = scanned.collect()  # LABELLED rows of a few numbers
    clean = [r["s"] for r in rows if not r["toxic"]]
    if not clean or len(clean) == len(rows):
        return Model({}, 0.0, 0.0, 1.0, (-6.0, 0.0, 0.0))
    tail = _tail(clean)
    x = np.array([_features(int(r["s"][0]), r["s"][1:], tail) for r in rows])
    line = _fitted(x, np.array([float(r["toxic"]) for r in rows]))
    return Model(weights[0], *tail, tuple(map(float, line)))


def scored(text: Column, model: Model) -> Column:
    """Struct of score (0 to 1) and passages of a text.

    The whole text is scanned. Passages are the maximal segments of which clean text of that
    length has less than one on average, as code points from start to end, each with its sum.
    A null or empty text has no passage and the score of a text without toxic tokens.
    """
    (a, *b), tail = model.line, (model.floor, model.log_k, model.rate)

    def scan(texts: pa.Array, weights: _Weights) -> pa.Array:
        out = []
        for text in (t.as_py() for t in texts):
            lower = (text or "").lower()
            tokens = _TOKEN.findall(lower)
            segments = _segments(tokens, weights)
            x = _features(len(tokens), [s for *_, s in segments], tail)
            score = 1 / (1 + np.exp(-np.clip(a + np.dot(b, x), -30, 30)))
            passages = [s for s in segments if _surprise(len(tokens), s[2], *tail) > 0]
            if passages:
                # Lower-casing may change lengths; places are those of the text itself.
                spans = [m.span() for m in _TOKEN.finditer(text)]
                same = len(spans) == len(tokens)
                passages = [
                    (spans[b][0], spans[e - 1][1], s) if same else (0, len(text), s)
                    for b, e, s in passages
                ]
            out.append((float(score), passages))
        scores = pa.array([s for s, _ in out], pa.float64())
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        lists = [[dict(zip(("start", "end", "score"), p, strict=True)) for p in ps] for _, ps in out]
        return pa.StructArray.from_arrays([scores, pa.array(lists, pa.list_(kind))], _SCORED.names)

    def scan_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = _Weights(model.weights)
        for texts in batches:
            yield scan(texts, weights)
        weights.clear()
        let_go()

    return F.arrow_udf(scan_all, _SCORED)(text)


def with_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages of every row of ``docs``, in no shuffle; repeats stay.

    See ``scored`` for null, empty and long texts. An empty table gives an empty one; columns
    besides doc_id and text are not read. A model of no labels scores all texts alike.
    """
    return docs.select("doc_id", scored(F.col("text"), model).alias("found")).select(
        "doc_id", "found.*"
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents that score under ``threshold``; columns stay."""
    return docs.where(scored(F.col("text"), model)["score"] < threshold)
