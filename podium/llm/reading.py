"""Reading level of documents from the grades at which their words are acquired.

A word's acquisition grade is the level by which half of its use in graded texts has come, every level weighted alike.
A text's features are quantiles of its known words' grades; regressions on the graded texts calibrate them to the
chance of reaching each level. Words that the graded texts don't know (formulas, scanning faults) don't count.
The graded texts are a sample of at most `GRADED` documents; all their words that occur in `LEAST_TEXTS` of them are the
lexicon, which goes to the executors and is bounded by that sample; everything else covers all documents. Grades and features are cross-fitted: a graded
text's features come from grades that other texts gave.

Defined results: null, blank and claims-only texts have no level, nor have texts without any known word; of several
labels of a document the median counts, null labels don't; without graded texts nothing has a level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.runtime import written

#: Bound of the sample of graded texts, texts that a word must occur in, folds.
GRADED, LEAST_TEXTS, FOLDS = 20_000, 3, 4
LEVELS = 5
QUANTILES = (0.1, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)

# Headings of sections in English, German and French, as they are after translation by machine too.
HEADINGS = {
    "abstract": r"\b(?:Abstract|ABSTRACT|Zusammenfassung|ZUSAMMENFASSUNG|Abrégé|ABRÉGÉ|Résumé|RÉSUMÉ)\b",
    "description": (
        r"\bDetailed\b(?:\s+[^\s.:]+){0,5}?\s+invention\b|\bDetailed\s+description\b|\b[Dd]escription\s+of(?:\s+[^\s.:]+){0,2}?\s+invention\b"
        r"|\b(?:DESCRIPTION|Description|BACKGROUND|Beschreibung|BESCHREIBUNG|Technisches\s+Gebiet|TECHNISCHES\s+GEBIET|Domaine\s+technique|DOMAINE\s+TECHNIQUE)\b"
    ),
    "claims": (
        r"\b(?:What|The|[Ii]nvention)\b[^.:]{0,40}?\b(?:claimed|claim)\b[^.:]{0,25}?:|\b(?:CLAIMS|Claims|PATENTANSPRÜCHE|Patentansprüche|REVENDICATIONS|Revendications)\b"
        r"|\b(?:Ansprüche|ANSPRÜCHE)\b(?=\s*:?\s*1\s*\.)"
    ),
    # The first claim, where its heading is lost.
    "claims_body": r"(?:(?<=\s)|^)1\s?\.\s(?=[^\n]{0,300}?\b(?:comprising|characterised|characterized|wherein|gekennzeichnet|comprenant|caractérisé|method comprising))",
}
# Most places fail at the first look: a heading begins a word with one of these.
_HEADING = re.compile(r"(?<!\w)(?=[ABCDIPRTWZ1]|description|invention)(?:" + "|".join(f"(?P<{k}>{p})" for k, p in HEADINGS.items()) + ")")
_WORD = re.compile(r"[^\W\d_]{2,}")
_BROKEN = re.compile(r"-\s*\n\s*")


def sections(text: str) -> dict[str, str]:
    """The text under each kind of heading (abstract, description, claims); text before the first heading is `title`."""
    out: dict[str, str] = {}
    kind, at = "title", 0
    for m in _HEADING.finditer(text):
        new = "claims" if m.lastgroup == "claims_body" else m.lastgroup
        out[kind] = out.get(kind, "") + " " + text[at : m.start()]
        kind, at = new, m.end()
    out[kind] = out.get(kind, "") + " " + text[at:]
    return out


def words(text: str) -> list[str]:
    return _WORD.findall(_BROKEN.sub("", text).lower())


def grades_of(counts: np.ndarray) -> np.ndarray:
    """Acquisition grades from words x levels counts: where the cumulated use, levels weighted alike, passes one half."""
    rate = (counts + 1e-9) / np.maximum(counts.sum(0), 1.0)
    share = rate / np.maximum(rate.sum(1, keepdims=True), 1e-300)
    upto = np.cumsum(share, 1)
    at = np.minimum((upto < 0.5).sum(1), LEVELS - 1)
    rows = np.arange(len(counts))
    before = upto[rows, at] - share[rows, at]
    return at + 0.5 + (0.5 - before) / np.maximum(share[rows, at], 1e-300)


def features(g: np.ndarray) -> np.ndarray:
    """Quantiles of the grades of a text's known words, their mean and spread."""
    return np.concatenate([np.quantile(g, QUANTILES), [g.mean(), g.std()]])


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> dict[str, np.ndarray]:
    """Ridge-penalised logistic regressions of y >= 2, ..., y >= LEVELS on the standardised features, by Newton steps."""
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    pen = np.diag([1e-6, *[ridge] * x.shape[1]])
    betas = []
    for level in range(2, LEVELS + 1):
        t = (y >= level).astype(float)
        b = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (t - p) - pen @ b)
            b += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        betas.append(b)
    return {"mean": mean, "sd": sd, "betas": np.array(betas)}


def chances(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Of each row the chance to reach level 2, ..., LEVELS, falling from level to level."""
    z = np.column_stack([np.ones(len(x)), (x - model["mean"]) / model["sd"]])
    return np.minimum.accumulate(1 / (1 + np.exp(-np.clip(z @ model["betas"].T, -30, 30))), axis=1)


def fit(documents: DataFrame, labels: DataFrame, text: str = "text") -> dict | None:
    """Lexicon and calibration from the graded documents, or None without any."""
    y = labels.where(F.col("reading_level").between(1, LEVELS)).groupBy("doc_id").agg(F.median("reading_level").alias("level"))
    y = y.orderBy(F.xxhash64("doc_id")).limit(GRADED)
    graded = documents.select("doc_id", F.col(text).alias("text")).where("text is not null").join(F.broadcast(y), "doc_id")  # at most GRADED labels

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, level in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                s = sections(t.as_py())
                got = Counter(words(s.get("description") or s.get("abstract") or ""))
                if got:
                    rows.append((i, int(i * 2654435761 % 2**32) % FOLDS, min(LEVELS, max(1, round(level))), list(got), list(got.values())))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "fold", "level", "words", "n"])

    bags = written(graded.select("doc_id", "text", "level").mapInArrow(split, "doc_id long, fold int, level int, words array<string>, n array<int>"), "graded")
    each = bags.select("fold", "level", F.explode(F.arrays_zip("words", "n")).alias("w"))
    per = each.groupBy(F.col("w.words").alias("word")).agg(
        F.count(F.lit(1)).alias("texts"),
        F.array(*[F.sum(F.when((F.col("fold") == f) & (F.col("level") == k), F.col("w.n")).otherwise(0)) for f in range(FOLDS) for k in range(1, LEVELS + 1)]).alias("c"),
    )
    rows = per.where(F.col("texts") >= LEAST_TEXTS).select("word", "c").toArrow()
    if not rows.num_rows:
        return None
    index = {w: i for i, w in enumerate(rows["word"].to_pylist())}
    cube = rows["c"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(index), FOLDS, LEVELS)
    total = cube.sum(1)
    by_fold = np.stack([grades_of(total - cube[:, f]) for f in range(FOLDS)])
    seen = np.stack([(total - cube[:, f]).sum(1) > 0 for f in range(FOLDS)])
    sc = documents.sparkSession.sparkContext
    lexicon = sc.broadcast((index, by_fold, seen))
    width = len(QUANTILES) + 2

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, g, s = lexicon.value
        for b in batches:
            out = []
            for f, level, ws, ns in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                known = [(at[w], n) for w, n in zip(ws, ns, strict=True) if w in at and s[f, at[w]]]
                if known:
                    ids, reps = np.array(known).T
                    out.append((level, features(np.repeat(g[f, ids], reps)).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.float64()))], names=["level", "x"])

    got = bags.mapInArrow(describe, "level int, x array<double>").collect()
    lexicon.destroy()
    if not got:
        return None
    x, t = np.array([r["x"] for r in got]).reshape(-1, width), np.array([r["level"] for r in got])
    return {"grades": dict(zip(index, grades_of(total).tolist(), strict=True)), "model": calibrate(x, t)}


def levels(documents: DataFrame, fitted: dict | None, text: str = "text") -> DataFrame:
    """(doc_id, description_level, description_p4, prose_level, prose_p4): levels 1 to 5 and the chance of 4 or more.

    Prose is abstract and description. Null where there is no such section or no known word in it.
    """
    schema = "doc_id long, description_level int, description_p4 double, prose_level int, prose_p4 double"
    docs = documents.select("doc_id", F.col(text).alias("text"))
    if fitted is None:
        null = [F.lit(None).cast(t).alias(n) for n, t in (("description_level", "int"), ("description_p4", "double"), ("prose_level", "int"), ("prose_p4", "double"))]
        return docs.select("doc_id", *null)
    shared = documents.sparkSession.sparkContext.broadcast((fitted["grades"], fitted["model"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade, model = shared.value
        for b in batches:
            x, at = [], []
            for i, t in enumerate(b.column(1)):
                s = sections(t.as_py()) if t.is_valid else {}
                d = [grade[w] for w in words(s.get("description", "")) if w in grade]
                a = [grade[w] for w in words(s.get("abstract", "")) if w in grade]
                for j, g in enumerate((d, d + a)):
                    if g:
                        x.append(features(np.array(g)))
                        at.append(2 * i + j)
            level, p4 = np.zeros(2 * b.num_rows, np.int32), np.full(2 * b.num_rows, np.nan)
            if x:
                p = chances(model, np.array(x))
                level[at], p4[at] = 1 + (p > 0.5).sum(1), p[:, 2]
            cols = []
            for j in (0, 1):
                none = level[j::2] == 0
                cols += [pa.array(level[j::2], pa.int32(), mask=none), pa.array(p4[j::2], pa.float64(), mask=none)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "description_level", "description_p4", "prose_level", "prose_p4"])

    return docs.mapInArrow(run, schema)
