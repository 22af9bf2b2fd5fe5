"""Operator 9: language ID by interpolated Kneser-Ney character models.

Training. At most ``docs_per_language`` labelled documents of each language, those with the smallest hashed ids, are
the sample; it bounds the models and the calibration and nothing else. Spark counts the sample's words and from them
the character n-grams of each language up to ``order`` inside words, ``^`` before a word and ``$`` after it. The
highest order has raw counts, lower orders the number of different left neighbours (raw counts after ``^``), and the
absolute discount of each order is n1 / (n1 + 2 n2). The probabilities of all n-grams and the back-off weights of all
contexts are kept as sorted arrays of 64-bit hashes with a row of values, a column per language.

Scoring. Every document's words are looked up in a worker's table of scored words; new words are scored together with
binary searches in the hash arrays, from the highest order down. The language with the lowest cross-entropy per
character wins. Texts are read where they lie: no shuffle, and the models are the only broadcast (bounded by the
sample, some MB).

Calibration. ``documents_per_language / 5`` of the sample are kept out of training. A document whose cross-entropy is
above the winner's ``quantile`` on those by more than ``slack`` nats a character is rejected.

Null texts and texts without a letter are ``und`` with score 0 and rejected; so is every text when nothing is learned.
``score`` is the winner's share of exp(-sharpness * cross-entropy) over all languages, from 0 to 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlink.llm.common import mix

ORDER = 5
DOCS_PER_LANGUAGE = 1500
SHARPNESS = 12.0
WORDS_KEPT = 400_000  # scored words that a worker remembers, some 80 MB
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LETTER = re.compile(r"[^\W\d_]")


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``^word$`` of all words, and each one's place in its word (0 for ``^``)."""
    joined = "".join("\x02" + w + "\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))  # a word can hold the marks itself
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place (wrong where a word has fewer; callers look at places)."""
    with np.errstate(over="ignore"):
        h = np.full(len(codes), n, np.uint64)
        for k in range(n - 1, -1, -1):
            moved = np.zeros(len(codes), np.uint64)
            moved[k:] = codes[: len(codes) - k] if k else codes
            h = h * MULTIPLIER + moved
    return mix(h)


@dataclass
class Model:
    """Sorted hash arrays by order, each with a row of values per hash and a column per language: log probabilities of
    n-grams (for a language that lacks one, what backing off gives) and log back-off weights of contexts (0 where a
    language lacks one)."""

    languages: list[str]
    order: int
    unseen: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    limits: np.ndarray | None = None
    known: dict[str, int] = field(default_factory=dict)
    scored: np.ndarray | None = None

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row per word: the sum of -log p of its characters for each language, and their number."""
        codes, place = _characters(words)
        total = np.zeros((len(codes), len(self.languages)))
        rows = np.flatnonzero(place > 0)
        for n in range(self.order, 0, -1):
            deep = place[rows] >= n - 1
            own = rows[deep]
            at, hit = _find(self.grams[n][0], gram_hashes(codes, n)[own])
            total[own[hit]] += self.grams[n][1][at[hit]]
            own = own[~hit]
            if n > 1:
                at, hit = _find(self.contexts[n - 1][0], gram_hashes(codes, n - 1)[own - 1])
                total[own[hit]] += self.contexts[n - 1][1][at[hit]]
            rows = np.concatenate([own, rows[~deep]])
        total[rows] += self.unseen
        starts = np.flatnonzero(place == 0)
        sizes = np.diff(np.append(starts, len(codes))) - 1
        return np.column_stack([-np.add.reduceat(total, starts, axis=0), sizes]).astype(np.float32)

    def _room(self, n: int) -> None:
        have = 0 if self.scored is None else len(self.scored)
        if n > have:
            more = np.zeros((max(n, 2 * have, 4096), len(self.languages) + 1), np.float32)
            if have:
                more[:have] = self.scored
            self.scored = more

    def entropy(self, text: str) -> np.ndarray:
        """Cross-entropy per character for each language."""
        words = text.lower().split()
        try:
            rows = [self.known[w] for w in words]
        except KeyError:
            if len(self.known) > WORDS_KEPT:
                self.known.clear()
                self.scored = None
            new = [w for w in set(words) if w not in self.known]
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                first, last = len(self.known), len(self.known) + len(part)
                self._room(last)
                self.known.update(zip(part, range(first, last)))
                self.scored[first:last] = self.score_words(part)
            rows = [self.known[w] for w in words]
        sums = self.scored[rows].sum(axis=0, dtype=np.float64)
        return sums[:-1] / sums[-1]


    def verdict(self, text: str | None, sharpness: float = SHARPNESS) -> tuple[str, float, float | None, bool]:
        """(language, score, entropy, rejected); ``und`` without a letter or without models."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, None, True
        entropy = self.entropy(text)
        best = int(np.argmin(entropy))
        share = 1.0 / np.exp(-sharpness * (entropy - entropy[best])).sum()
        return self.languages[best], float(share), float(entropy[best]), bool(entropy[best] > self.limits[best])


def _find(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in the sorted array, and whether they are there."""
    if not len(hashes):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return at, hashes[at] == keys


def estimate(counts: pd.DataFrame, order: int) -> Model:
    """Interpolated Kneser-Ney from (lang, gram, n), the counts of n-grams of the highest order and of those shorter ones
    that begin a word."""
    languages = sorted(counts["lang"].unique())
    tables: dict[int, pd.DataFrame] = {}
    counts = counts.assign(size=counts["gram"].str.len())
    level = counts[counts["size"] == order][["lang", "gram", "n"]]
    tables[order] = level
    for n in range(order - 1, 0, -1):
        level = level.assign(gram=level["gram"].str.slice(1)).groupby(["lang", "gram"], as_index=False).size().rename(columns={"size": "n"})
        starts = counts[counts["size"] == n][["lang", "gram", "n"]]
        level = pd.concat([level, starts]).groupby(["lang", "gram"], as_index=False)["n"].sum()
        tables[n] = level
    # Probabilities from the lowest order up, over the characters seen and one share for unseen ones.
    alphabet = tables[1].groupby("lang")["gram"].nunique().reindex(languages).to_numpy() + 1
    unseen = np.log(1.0 / alphabet / 100)
    lower: pd.DataFrame | None = None
    full = pd.DataFrame([unseen], index=[""], columns=languages)
    grams, contexts = {}, {}
    for n in range(1, order + 1):
        t = tables[n].copy()
        t["context"] = t["gram"].str.slice(0, n - 1)
        ones = t[t["n"] == 1].groupby("lang").size().reindex(languages, fill_value=0)
        twos = t[t["n"] == 2].groupby("lang").size().reindex(languages, fill_value=0)
        discount = ((ones + 1) / (ones + 2 * twos + 2)).rename("d")
        by = t.groupby(["lang", "context"])["n"].agg(["sum", "size"]).reset_index().merge(discount, left_on="lang", right_index=True)
        by["weight"] = by["d"] * by["size"] / by["sum"]
        t = t.merge(by[["lang", "context", "sum", "d", "weight"]], on=["lang", "context"])
        t["suffix"] = t["gram"].str.slice(1)
        if lower is None:
            t["base"] = t["lang"].map(dict(zip(languages, 1.0 / alphabet)))
        else:
            t = t.merge(lower.rename(columns={"gram": "suffix", "p": "base"}), on=["lang", "suffix"])
        t["p"] = (t["n"] - t["d"]).clip(lower=1e-9) / t["sum"] + t["weight"] * t["base"]
        lower = t[["lang", "gram", "p"]]
        wide = np.log(lower.pivot(index="gram", columns="lang", values="p").reindex(columns=languages))
        weights = np.log(by.pivot(index="context", columns="lang", values="weight").reindex(columns=languages)).fillna(0.0)
        back = weights.reindex(wide.index.str.slice(0, n - 1)).to_numpy() + full.reindex(wide.index.str.slice(1)).to_numpy()
        full = wide.where(wide.notna(), back)
        grams[n] = _arrays(full, n)
        if n > 1:
            contexts[n - 1] = _arrays(weights, n - 1)
    return Model(languages, order, unseen, grams, contexts)


def _arrays(values: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(values.index).encode("utf-32-le"), "<u4").astype(np.uint64)
    hashes = gram_hashes(codes, n)[n - 1 :: n]
    order = np.argsort(hashes)
    return hashes[order], values.to_numpy(np.float32)[order]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
          docs_per_language: int = DOCS_PER_LANGUAGE, quantile: float = 0.99, slack: float = 1.0) -> Model:
    """Models of all languages of the labelled documents, with their rejection limits."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    draw = F.xxhash64(F.lit("language sample"), F.col(id_col))
    first = Window.partitionBy("lang").orderBy("draw", "doc_id")
    drawn = rows.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), draw.alias("draw"))
    # Of a language that has many more documents than are wanted, only draws below a limit are ranked: about twice as many
    # as wanted, so that a language is a small group however many rows it has. Too few below it are next to impossible; all
    # of the language are ranked then.
    share = F.least(F.lit(1.0), F.lit(2.0 * docs_per_language + 500) / F.col("n"))
    below = F.col("draw") < (share * 2.0**64 - 2.0**63).cast("decimal(20,0)")
    sizes = drawn.groupBy("lang").agg(F.count("*").alias("n"))
    near = drawn.join(F.broadcast(sizes), "lang").withColumn("below", below | (F.col("n") <= 2 * docs_per_language + 500))
    few = near.groupBy("lang").agg(F.count_if("below").alias("kept")).where(F.col("kept") < docs_per_language).select("lang", F.lit(True).alias("few"))
    chosen = (near.join(F.broadcast(few), "lang", "left").where(F.col("below") | F.coalesce("few", F.lit(False)))
              .withColumn("place", F.row_number().over(first)).where(F.col("place") <= docs_per_language).select("doc_id", "place"))
    # docs_per_language ids of each language: small enough to send to every task.
    sample = (rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
              .join(F.broadcast(chosen), "doc_id"))
    held = F.col("place") % 5 == 0
    words = (sample.where(~held).select("lang", F.explode(F.split(F.lower("text"), r"[\s]+")).alias("word")).where("word != ''")
             .groupBy("lang", "word").agg(F.count("*").alias("n")))
    marked = F.concat(F.lit("\x02"), "word", F.lit("\x03"))
    size = F.char_length("marked")
    grams = (words.withColumn("marked", marked)
             .select("lang", "n", F.explode(F.expr(
                 f"transform(sequence(2, char_length(marked)), e -> substring(marked, greatest(1, e - {order - 1}), least(e, {order})))")).alias("gram"))
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counts = pd.DataFrame([r.asDict() for r in grams.collect()], columns=["lang", "gram", "n"])
    if counts.empty:
        return Model([], order, np.zeros(0), {}, {})
    model = estimate(counts, order)
    model.limits = np.full(len(model.languages), np.inf)
    sent = spark.sparkContext.broadcast(model)
    kept = sample.where(held).select("doc_id", "text", "lang").mapInArrow(_entropies(sent), "lang string, entropy double")
    for r in kept.groupBy("lang").agg(F.expr(f"percentile(entropy, {quantile})").alias("q")).collect():
        if r.lang in model.languages and r.q is not None:
            model.limits[model.languages.index(r.lang)] = r.q + slack
    sent.unpersist()
    model.known.clear()
    model.scored = None
    return model


def _entropies(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            langs, values = batch.column(2).to_pylist(), []
            for text, lang in zip(batch.column(1).to_pylist(), langs):
                known = LETTER.search(text) and lang in model.languages
                values.append(float(model.entropy(text)[model.languages.index(lang)]) if known else None)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(values, pa.float64())], names=["lang", "entropy"])
    return run


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", sharpness: float = SHARPNESS) -> DataFrame:
    """The id, ``lang_pred``, ``score``, ``entropy`` (nats a character, null for ``und``) and ``rejected`` for every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = [model.verdict(text, sharpness) for text in batch["__text"].to_pylist()]
            columns = list(zip(*found)) if found else [[]] * 4
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch[id_col], *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=[id_col, "lang_pred", "score", "entropy", "rejected"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, lang_pred string, score double, entropy double, rejected boolean")


def keep_recognised(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the models do not reject, with all columns as they are. The text that passes through is the one that is
    scored, and rows go on in small batches."""
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = (t if t is None or isinstance(t, str) else str(t) for t in part.column(at).to_pylist())
                yield part.filter(pa.array([not model.verdict(t)[3] for t in texts], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose lang nothing learns from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
