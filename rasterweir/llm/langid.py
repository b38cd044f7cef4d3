"""Language ID: multinomial naive Bayes over hashed character n-grams.

The model is a log-probability matrix (languages x buckets), learnt by Spark from per-partition n-gram counts and
broadcast; documents are scored in Arrow batches: the n-gram buckets of a batch form the indices of a sparse row
matrix (one row per document), which is multiplied with the matrix by gathering and segment sums in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, fresh, written

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BUCKET_BITS = 14
#: Documents that the model is fitted on at most by default; a documented bound, chosen by a hash of the row.
MAX_TRAIN = 20_000
#: Leading bits of the hash by which labelled rows are counted, to find the bound without ordering them all.
PREFIX_BITS = 12
#: Languages that a model has at most, those of most training documents: more than there are codes for; a matrix of 128 MB then.
MAX_LANGUAGES = 2_048
#: A language with fewer calibration texts has the limits of all languages together.
LEAST_CALIBRATION = 30
#: n-grams from which a text counts as long.
LONG_TEXT = 256
#: Quantile of the calibration texts' deviations in evidence, and the multiple of it at which a text is rejected.
QUANTILE, SLACK = 0.995, 3.0
#: The same for variety; some labelled texts are mere repetitions, so the quantile is lower. The deviation is LEAST_SPREAD at least.
VARIETY_QUANTILE, VARIETY_SLACK, LEAST_SPREAD = 0.95, 2.0, 0.05
#: Characters of one scoring step; a longer text is scored in overlapping slices.
STEP = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    """languages: sorted names; prior: log prior per language; logp: float32 (buckets, languages)."""

    languages: list[str]
    prior: np.ndarray
    logp: np.ndarray


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, everything but letters as one kind of gap (0), gaps merged; framed by gaps."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    c = np.where(_letters()[np.minimum(c, 0x10FFFF)], c, 0)
    keep = np.ones(len(c), bool)
    if len(c) > 1:
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return np.concatenate([[0], c[keep], [0]]).astype(np.uint32)


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        import unicodedata

        _table.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _table[0]


def ngram_buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of a code array, order after order."""
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            x = h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            out.append((x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _slices(text: str):
    """A text in slices of STEP characters that overlap by the longest n-gram less one."""
    for i in range(0, max(1, len(text)), STEP):
        yield text[max(0, i - max(ORDERS) + 1) : i + STEP]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", max_train: int | None = MAX_TRAIN, alpha: float = 0.5, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Learn from the labelled rows of ``docs``.

    Rows whose text or label is null teach nothing. Where more than ``max_train`` rows are labelled, those with the
    smallest hashes of key and text are taken, never more than that many (of equal rows that straddle the bound as many as
    fit), so the choice doesn't depend on order or partitions; ``None`` takes all rows. Of more than ``max_languages`` labels in them the most
    frequent are learnt, ties by name. Empty texts teach the label's frequency only; very long ones are counted in slices.
    What reaches the driver is a count per hash prefix, and languages x buckets counts at most. No labelled row: a model without languages, that calls
    all texts ``und``.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.xxhash64(F.col(key_col), F.col(text_col)).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sample = None
    if max_train is not None:
        # the hash prefix in which the bound lies, from 2**PREFIX_BITS counts; only rows up to that prefix are ordered
        prefix = F.shiftright("h", 64 - PREFIX_BITS)
        steps = rows.groupBy(prefix.alias("p")).count().toPandas().sort_values("p")
        over = steps["p"][steps["count"].cumsum() > max_train]
        rows = sample = written(rows.where(prefix <= int(over.iloc[0])) if len(over) else rows, "language-sample")
        if len(over):
            end = sample.select("h").orderBy("h").limit(max_train + 1).agg(F.max("h")).first()[0]
            rows = sample.where(F.col("h") < end)
            rows = rows.unionByName(sample.where(F.col("h") == end).orderBy("lang").limit(max_train - rows.count()))  # equal rows, or hardly any
    most = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                got = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for part in _slices(text):
                    got += np.bincount(ngram_buckets(_codes(part)), minlength=1 << BUCKET_BITS)
                docs_of[lang] = docs_of.get(lang, 0) + 1
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1).astype(np.int32), "n": np.append(got[at], docs_of[lang])})

    found = rows.where(F.col("lang").isin(most)).mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if sample is not None:
        discard(sample)
    languages = sorted(found["lang"].unique())
    counts, seen = np.zeros((1 << BUCKET_BITS, len(languages))), np.zeros(len(languages))
    for j, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        seen[j] = own.loc[own["bucket"] < 0, "n"].sum()
        own = own[own["bucket"] >= 0]
        counts[own["bucket"].to_numpy(), j] = own["n"]
    logp = np.log(counts + alpha) - np.log((counts + alpha).sum(axis=0, keepdims=True))
    return LanguageModel(languages, np.log(seen / max(1, seen.sum())) if languages else seen, logp.astype(np.float32))


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Best language, its posterior, and its evidence per text; ``und``, 0 and nan for null and for texts without letters."""
    return _scored(model, texts)[:3]


def _scored(model: LanguageModel, texts: list[str | None], shape: bool = False) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``score_texts``, the numbers of n-grams, and with ``shape`` those of distinct n-gram buckets."""
    distinct = np.zeros(len(texts), np.int64)
    total = np.zeros((len(texts), max(1, len(model.languages))))
    grams = np.zeros(len(texts))
    indices, rows, size = [], [], 0

    def add() -> None:
        nonlocal indices, rows, size
        if rows:
            starts = np.cumsum([0] + [len(x) for x in indices[:-1]])
            flat = np.concatenate(indices)
            for j in range(len(model.languages)):
                np.add.at(total[:, j], rows, np.add.reduceat(np.take(model.logp[:, j], flat), starts, dtype=np.float64))
        indices, rows, size = [], [], 0

    for i, text in enumerate(texts):
        if text is None or not model.languages:
            continue
        seen = np.zeros(1 << BUCKET_BITS if shape else 0, bool)
        for part in _slices(text):
            codes = _codes(part)
            if not codes.any():
                continue
            indices.append(ngram_buckets(codes))
            if shape:
                seen[indices[-1]] = True
                distinct[i] = seen.sum()
            rows.append(i)
            grams[i] += len(indices[-1])
            size += len(codes)
            if size >= STEP:
                add()
    add()
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), grams, distinct
    z = total + model.prior
    z = np.exp(z - z.max(axis=1, keepdims=True))
    best, p, known = z.argmax(axis=1), z.max(axis=1) / z.sum(axis=1), grams > 0
    own = total[np.arange(len(texts)), best] / np.maximum(grams, 1) + BUCKET_BITS * np.log(2)
    return [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, p, 0.0), np.where(known, own, np.nan), grams, distinct


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred STRING``, ``score DOUBLE`` (posterior, 0..1) and ``evidence DOUBLE``, one row for each input row.

    ``evidence`` is the mean log-likelihood ratio of the text's n-grams under the language against n-grams drawn evenly:
    over 0 the language explains the text better than noise does. Unlike the posterior it doesn't grow with the text.

    Only the text is an input. Null text and text without a letter: ``und``, 0, null. Equal posteriors: the language that
    sorts first. A very long text is scored whole, in slices. Existing columns with these names are replaced; all others
    pass through unread. Repeated rows stay; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES x 2 ** BUCKET_BITS floats

    @F.pandas_udf("lang_pred string, score double, evidence double")
    def guess(text: pd.Series) -> pd.DataFrame:
        best, p, own = score_texts(shared.value, [x if isinstance(x, str) else None for x in text])
        return pd.DataFrame({"lang_pred": best, "score": p, "evidence": pd.Series(own).astype(object).where(~np.isnan(own), None)})

    names = ("lang_pred", "score", "evidence")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    found = fresh("guess", docs.columns)
    return docs.select(*kept, guess(F.col(f"`{text_col}`")).alias(found)).select(*kept, *[F.col(f"{found}.{c}") for c in names])


@dataclass(frozen=True)
class Limits:
    """What a text of a learnt language looks like at least. evidence: language -> (median, deviation of long texts, deviation of
    short ones times the root of their n-grams), ``None`` for all languages; variety: log2 of the n-grams -> median; spread: its
    deviation."""

    evidence: dict[str | None, tuple[float, float, float]]
    variety: dict[int, float]
    spread: float

    def fits(self, languages: list[str], evidence: np.ndarray, grams: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """Whether texts are told to be in their language; those without a letter aren't. Without calibration, whether the language explains more than noise does."""
        known = np.nan_to_num(evidence, nan=-np.inf)
        if not self.evidence:
            return known > 0
        middle, wide, short = (np.array([self.evidence.get(x, self.evidence[None])[k] for x in languages]) for k in range(3))
        least = middle - SLACK * np.where(grams >= LONG_TEXT, wide, np.maximum(wide, short / np.sqrt(np.maximum(grams, 1))))
        classes = np.array(sorted(self.variety))
        nearest = classes[np.abs(_length_class(grams)[:, None] - classes[None, :]).argmin(axis=1)]
        usual = np.array([self.variety[k] for k in nearest])
        return (known > np.maximum(least, 0)) & (_variety(grams, distinct) >= usual - VARIETY_SLACK * self.spread)


def _length_class(grams: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(grams, 1)).astype(int)


def _variety(grams: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """How fast new n-grams come: log of the distinct ones over log of all; low for repetitions."""
    return np.log(np.maximum(distinct, 1)) / np.log(np.maximum(grams, 2))


def _quantiles(values: DataFrame) -> dict[tuple[str, str], tuple[float, int]]:
    """``(what, kind)`` -> (quantile at ``share``, number of values) of all ``values(what, kind, share, value)``: exact ones, as numpy's
    between the two nearest values.

    Equal values are counted, then put in ranges of their order, so that no kind is in one task; only the ranges that hold the
    wanted ranks are ordered. Two values a kind reach the driver.
    """
    ranged = values.groupBy("what", "kind", "share", "value").agg(F.count("*").alias("n"))
    ranged = written(ranged.repartitionByRange("what", "kind", "value").withColumn("part", F.spark_partition_id()), "ranges")
    kind = Window.partitionBy("what", "kind")
    parts = ranged.groupBy("what", "kind", "share", "part").agg(F.sum("n").alias("part_n"), F.min("value").alias("least"))
    parts = parts.withColumn("total", F.sum("part_n").over(kind)).withColumn("before", F.sum("part_n").over(kind.orderBy("least")) - F.col("part_n"))
    parts = parts.withColumn("rank", F.col("share") * (F.col("total") - 1)).where("before <= ceil(rank) AND before + part_n > floor(rank)")
    end = F.col("before") + F.sum("n").over(Window.partitionBy("what", "kind", "part").orderBy("value"))
    near = ranged.drop("share").join(F.broadcast(parts), ["what", "kind", "part"]).withColumn("end", end).where("end > floor(rank) AND end - n <= ceil(rank)")
    found = near.groupBy("what", "kind").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.first("rank").alias("rank"), F.first("total").alias("total")).collect()
    discard(ranged)
    return {(r["what"], r["kind"]): (float(np.quantile([r["low"], r["high"]], r["rank"] % 1)), r["total"]) for r in found}


def calibrate(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> Limits:
    """Limits from labelled texts that the model wasn't fitted on and calls by their label.

    All distinct texts count; medians and quantiles are exact and taken in Spark. Evidence is a mean per n-gram, so
    that of short texts varies more: deviations from the language's median are taken apart for long texts, and times the root
    of the length for short ones, and count at least as those of all languages together: passages in another language are in any. Rows with null text or label, texts without letters and wrongly predicted ones say nothing.
    No such row: limits that accept whatever a language explains better than noise.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit("calibration"), F.col(text_col)).alias("h"))
    # texts are scored where they lie; what is moved and told apart by the text's hash are numbers
    judged = _judged(rows, model).groupBy("h").agg(F.min("lang").alias("lang"), *[F.first(c).alias(c) for c in ("lang_pred", "evidence", "grams", "distinct_grams")])
    variety = F.log(F.greatest("distinct_grams", F.lit(1))) / F.log(F.greatest("grams", F.lit(2)))
    length = F.length(F.bin("grams")) - 1  # as _length_class
    found = judged.where("lang_pred = lang AND evidence IS NOT NULL").select("lang", "evidence", "grams", variety.alias("variety"), length.cast("string").alias("length"))
    found = written(found, "calibration")

    def one(what: Column | str, kind: Column, share: float, value: Column) -> Column:
        return F.struct((F.lit(what) if isinstance(what, str) else what).alias("what"), kind.alias("kind"), F.lit(share).alias("share"), value.alias("value"))

    every = F.lit("")
    middles = _quantiles(found.select(F.inline(F.array(one("all", every, 0.5, F.col("evidence")), one("own", F.col("lang"), 0.5, F.col("evidence")), one("variety", F.col("length"), 0.5, F.col("variety"))))))
    if not middles:
        discard(found)
        return Limits({}, {}, 0.0)
    middle = {kind: m for (what, kind), (m, n) in middles.items() if what == "own" and n >= LEAST_CALIBRATION}
    usual = {kind: m for (what, kind), (m, _) in middles.items() if what == "variety"}
    # how far each text is below the medians: MAX_LANGUAGES rows, and one for each length class, at most
    rows = found.join(F.broadcast(docs.sparkSession.createDataFrame(list(usual.items()), "length string, usual double")), "length")
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(list(middle.items()), "lang string, middle double")), "lang", "left")
    long = F.col("grams") >= LONG_TEXT
    below = lambda middle: F.greatest(middle - F.col("evidence"), F.lit(0.0)) * F.when(long, 1.0).otherwise(F.sqrt("grams"))
    far = F.array(
        one("spread", every, VARIETY_QUANTILE, F.col("usual") - F.col("variety")),
        one(F.when(long, "all long").otherwise("all short"), every, QUANTILE, below(F.lit(middles["all", ""][0]))),
        one(F.when(long, "own long").otherwise("own short"), F.col("lang"), QUANTILE, below(F.col("middle"))),
    )
    off = _quantiles(rows.select(F.inline(far)).where("value IS NOT NULL"))
    discard(found)

    def spans(whose: str, kind: str) -> tuple[float, float]:
        wide = off.get((f"{whose} long", kind), (0.0, 0))[0]
        return wide, off.get((f"{whose} short", kind), (wide * LONG_TEXT**0.5, 0))[0]

    least = spans("all", "")
    limits = {None: (middles["all", ""][0], *least)} | {lang: (m, *map(max, spans("own", lang), least)) for lang, m in sorted(middle.items())}
    return Limits(limits, {int(k): m for k, m in sorted(usual.items())}, max(off["spread", ""][0], LEAST_SPREAD))


def _judged(docs: DataFrame, model: LanguageModel, limits: Limits | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, evidence, grams, distinct_grams, fits``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, limits or Limits({}, {}, 0.0)))  # MAX_LANGUAGES x 2 ** BUCKET_BITS floats at most

    @F.pandas_udf("lang_pred string, evidence double, grams long, distinct_grams long, fits boolean")
    def judge(text: pd.Series) -> pd.DataFrame:
        best, _, own, grams, distinct = _scored(shared.value[0], [x if isinstance(x, str) else None for x in text], shape=True)
        fits = shared.value[1].fits(best, own, grams, distinct)
        return pd.DataFrame({"lang_pred": best, "evidence": pd.Series(own).astype(object).where(~np.isnan(own), None), "grams": grams.astype(np.int64), "distinct_grams": distinct, "fits": fits})

    found = fresh("judged", docs.columns)
    out = docs.select("*", judge(F.col(f"`{text_col}`")).alias(found))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], f"{found}.*")


def reject(docs: DataFrame, model: LanguageModel, limits: Limits, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is in a language of the model by ``limits``; all columns pass through, names that clash too.

    Null texts and texts without letters go. So do texts whose n-grams their best language explains much worse than it does
    texts of its own of such a length (other languages, code, encoded data), and texts with far fewer distinct n-grams than usual
    (repetitions). A short text has to be much farther off than a long one. A very long text is judged whole; repeated rows are
    judged alike; an empty table stays empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return _judged(rows, model, limits).where("fits").select("row.*")
