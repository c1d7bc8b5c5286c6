"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (buckets by languages) has a fixed number of rows
and is broadcast. Scoring turns a batch of texts into one sparse row each
(bucket indices and row offsets) and multiplies it by the matrix in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspan.llm._sample import bounded
from roadspan.llm._text import slices

ORDERS = (1, 2, 3)
LOG2_BUCKETS = 15
SAMPLE = 20_000  # most labelled texts that are learned from
LANGUAGES = 512  # most languages; more is an error, as the matrix grows with them
SMOOTHING = 0.5
SURE_AFTER = 64  # n-grams counted as independent evidence at most, for the score
UNKNOWN = "und"
ROWS = -1  # stands for a bucket where texts are counted


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # float32, buckets x languages
    prior: np.ndarray  # float32, log share of each language's texts


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket indices of all character n-grams of lower-cased texts and each text's offsets into them, text by text within each order."""
    joined = [f"\x02{t.lower()}\x03" if t else "" for t in texts]
    chars = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in joined], dtype=np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
    buckets, rows = [], []
    h = np.zeros(len(chars), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x9E3779B1) + (chars[n - 1 :] + np.uint32(n)) * np.uint32(0x85EBCA6B)
        if n in ORDERS:
            inside = row[:m] == row[n - 1 :]
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            buckets.append((mixed >> np.uint32(32 - LOG2_BUCKETS))[inside])
            rows.append(row[:m][inside])
    return buckets, rows


def train(docs: DataFrame, text_col: str, label_col: str, key_col: str, sample: int = SAMPLE) -> LanguageModel:
    """Fit on at most ``sample`` rows of ``docs`` that have a text and a label.

    Counts are summed per task, then by Spark per (language, bucket). No rows
    give a model without languages.
    """
    rows = docs.where(F.col(label_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(key_col).alias("k"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l"))
    rows = bounded(rows, F.col("k"), sample)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for part in slices(batches, "t", 1 << 20):
            for label, own in part.to_pandas().groupby("l")["t"]:
                seen[label] = seen.get(label, 0) + len(own)
                at = total.setdefault(label, np.zeros(1 << LOG2_BUCKETS, np.int64))
                for b in ngrams(list(own))[0]:
                    at += np.bincount(b, minlength=1 << LOG2_BUCKETS)
        for label, at in total.items():
            some = np.flatnonzero(at)
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([ROWS], pa.int32()), pa.array([seen[label]], pa.int64())], names=["l", "b", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some)), pa.array(some.astype(np.int32)), pa.array(at[some])], names=["l", "b", "n"])

    counts = rows.mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(counts["l"].unique().to_pylist())
    if len(languages) > LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {LANGUAGES} are handled")
    table = np.zeros((1 << LOG2_BUCKETS, len(languages)))
    prior = np.zeros(len(languages))
    if languages:
        column = pc.index_in(counts["l"].combine_chunks(), pa.array(languages)).to_numpy(zero_copy_only=False)
        bucket, n = counts["b"].to_numpy(), counts["n"].to_numpy()
        texts = bucket == ROWS
        table[bucket[~texts], column[~texts]] = n[~texts]
        prior[column[texts]] = np.log(n[texts] / n[texts].sum())
    table += SMOOTHING
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32), prior.astype(np.float32))


def score(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language, its probability) per text, by one sparse product per order.

    The best is that of the full sum. For the probability alone more than
    ``SURE_AFTER`` n-grams weigh as much as that many, next to the prior:
    neighbouring ones overlap and aren't independent.
    """
    total = np.zeros((len(texts), len(model.languages)))
    n = np.zeros(len(texts))
    for buckets, rows in zip(*ngrams(texts), strict=True):
        if not len(rows):
            continue
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        total[rows[starts]] += np.add.reduceat(model.log_p[buckets], starts, axis=0, dtype=np.float64)
        n += np.bincount(rows, minlength=len(texts))
    z = total / np.maximum(n, 1)[:, None] * np.minimum(n, SURE_AFTER)[:, None] + model.prior
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = (total + model.prior).argmax(axis=1)
    return best, p[np.arange(len(texts)), best]


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its probability, from the whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or the model
    knows no language. Ties go to the language that sorts first. Columns of
    those two names are replaced; all others stay.
    """
    base = docs.drop(lang_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = base.select("*", F.lit("").alias(lang_col), F.lit(0.0).alias(score_col)).schema

    def run(batches):
        m = shared.value
        for part in slices(batches, text_col, 1 << 20):
            text = part.column(part.schema.get_field_index(text_col))
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            langs, scores = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
            if m.languages and lettered.any():
                best, p = score(text.to_pylist(), m)
                langs = np.where(lettered, np.array(m.languages, object)[best], UNKNOWN)
                scores = np.where(lettered, p, 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*part.schema.names, lang_col, score_col])

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the third of ids that nothing is learned from; null ids are not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, learned from the rows of ``docs`` that aren't held out.

    Rows with a null id, label or text, and empty texts, are not learned from;
    rows that repeat count as often as they stand there. All rows are judged:
    see ``predict`` for nulls and ties. An empty table gives an empty result.
    """
    known = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    return predict(docs, train(known, text_col, label_col, id_col, sample), text_col)
