"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of characters, five at a time, one for each language, trained on the documents that the label table trusts.
Documents are read once and kept in compressed files of the shared folder (the spool), one or more for each task, together
with two narrow tables: which row of which file is which document, and which n-grams occur in which file. Everything else
is joins of these:

* counting: the rows that the labels trust are looked up by doc_id, their texts are read from the spool and their n-grams
  are summed by shuffle; continuation counts, discounts and context totals follow, and each order's probabilities come from
  joins of its counts with its contexts' totals and with the next lower order;
* scoring: the distinct n-grams of all files are joined with the longest order that has them, what is not found goes on to
  the next shorter one with its context's weight, and the answers go back to their files, whose documents are then added up.

N-grams are strings, so no alphabet is too large. What is shuffled are distinct n-grams of a file, never occurrences, and no
part of the model is broadcast or sent to the driver. A document stays if its perplexity is within a quantile, set for each
language, of the perplexities of trusted documents that the model was not trained on, times a margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, fresh_path, materialize, partitions, utf8
from .spool import Spool, Writer, grouped, read, written

ORDER = 5
QUANTILE, MARGIN = 0.99, 1.1
#: Trusted documents whose doc_id's CRC-32 has this remainder are kept out of training; thresholds are taken from them.
FOLDS, CALIBRATION = 10, 9
#: Distinct n-grams of one spool file; text bytes that are turned into n-grams at once.
FILE_GRAMS, CHUNK = 1_000_000, 2 << 20

_SPOOL = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])
_TABLE = "part long, file string, row long, doc_id long, lang string, gram string"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Text and n-gram number of every character, and the n-grams: each character with the ORDER - 1 before it.

    White space (and U+0000) is one character; U+0000 stands before a text's start.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[(points == 0) | ((points >= 0x09) & (points <= 0x0D)) | (points == 0xA0)] = 0x20
    owner = np.repeat(np.arange(len(texts)), sizes)
    if not len(points):
        return owner, owner, []
    inner = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    there = np.zeros(0x110000, bool)
    there[points] = True
    dense = np.cumsum(there)[points]  # from 1 on; 0 stands before a start
    bits = int(there.sum()).bit_length()
    if bits * ORDER < 64:
        code = dense.copy()
        for k in range(1, ORDER):
            code[k:] |= np.where(inner[k:] >= k, dense[:-k], 0) << bits * k
        number, _ = pd.factorize(code)
    else:  # too many characters for one word: shorter n-grams are numbered first
        number = dense
        for _ in range(1, ORDER):
            before = np.where(inner > 0, np.r_[0, number[:-1]], 0)
            number = pd.factorize(before << 21 | dense)[0] + 1
        number = number - 1
    at = np.empty(int(number.max()) + 1, np.int64)
    at[number[::-1]] = np.arange(len(number))[::-1]
    table = np.zeros((len(at), ORDER), np.uint32)
    for k in range(ORDER):
        table[:, ORDER - 1 - k] = np.where(inner[at] >= k, points[np.maximum(at - k, 0)], 0)
    return owner, number, table.view(f"<U{ORDER}").ravel().tolist()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """Language, rows and texts of a chunk."""
    raw, offs = utf8(batch.column("text"))
    langs = np.array(batch.column("lang").to_pylist(), object)
    for lang in sorted(set(langs.tolist())):
        rows = np.flatnonzero(langs == lang)
        yield lang, rows, [bytes(raw[offs[i] : offs[i + 1]]).decode() for i in rows.tolist()]


class _File(Writer):
    """A spool file with the distinct n-grams in it so far."""

    limit = FILE_GRAMS

    def __init__(self, folder: str, part: int, schema: pa.Schema) -> None:
        super().__init__(folder, part, schema)
        self.seen: dict[str, set[str]] = {}

    def add(self, chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield self._rows(len(chunk), row=pa.array(np.arange(self.rows, self.rows + len(chunk))), doc_id=chunk.column("doc_id"))
        self.put(chunk)
        for lang, _, texts in _by_language(chunk):
            seen = self.seen.setdefault(lang, set())
            fresh = [g for g in grams(texts)[2] if g not in seen]
            seen.update(fresh)
            for lo in range(0, len(fresh), 1 << 17):
                some = fresh[lo : lo + (1 << 17)]
                yield self._rows(len(some), lang=pa.array([lang] * len(some)), gram=pa.array(some))

    def _rows(self, n: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"part": pa.int64(), "file": pa.string(), "row": pa.int64(), "doc_id": pa.int64(), "lang": pa.string(), "gram": pa.string()}
        columns = {"part": pa.array([self.part] * n, pa.int64()), "file": pa.array([self.name] * n)} | columns
        return pa.record_batch({c: columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()})

    def full(self) -> bool:
        return sum(map(len, self.seen.values())) > self.limit

    def finish(self) -> Iterator[pa.RecordBatch]:
        self.close()
        return iter(())


def _spooled(folder: str, limit: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return written(batches, folder, _SPOOL, chunk_bytes, type("Limited", (_File,), {"limit": limit}))

    return run


def spool(docs: DataFrame) -> Spool:
    """Write all documents (doc_id, lang, text) to spool files; the table has their rows (row, doc_id) and n-grams (lang, gram). A
    null lang is the empty string, a null text is empty."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"], F.lit("")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # Fewer files share more n-grams; each is read by one task.
    parts = max(2 * spark.sparkContext.defaultParallelism, partitions(spark) // 4)
    folder = fresh_path(spark, "spool")
    return Spool(folder, materialize(rows.coalesce(parts).mapInArrow(_spooled(folder, FILE_GRAMS, CHUNK), _TABLE), "spool-table", compression="zstd"), parts)


def _counted(folder: str):
    """N-gram counts of the rows of spool files that are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, wanted in grouped(batches):
            held: dict[str, dict[str, int]] = {}
            rows, at = np.sort(wanted.column("row").to_numpy()), 0
            for chunk in read(folder, wanted.column("file")[0].as_py()):
                lo, hi = np.searchsorted(rows, (at, at + len(chunk)))
                mine = chunk.take(pa.array(rows[lo:hi] - at))
                at += len(chunk)
                for lang, _, texts in _by_language(mine):
                    _, number, names = grams(texts)
                    counts = held.setdefault(lang, {})
                    for gram, n in zip(names, np.bincount(number, minlength=len(names)).tolist(), strict=True):
                        counts[gram] = counts.get(gram, 0) + n
            for lang, counts in held.items():
                names, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                for lo in range(0, len(names), 1 << 17):
                    some = names[lo : lo + (1 << 17)]
                    yield pa.record_batch({"lang": pa.array([lang] * len(some)), "gram": pa.array(some), "n": pa.array(n[lo : lo + (1 << 17)])})

    return run


def _discounts(orders: dict[int, DataFrame]) -> dict[tuple[str, int], tuple[float, float, float]]:
    """Three discounts for each language and order, from how many n-grams occur once to four times."""
    out = {}
    for k, table in orders.items():
        ones = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
        for r in table.groupBy("lang").agg(*ones).collect():  # a row a language
            n1, n2, n3, n4 = (max(1, r[f"n{i}"]) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            out[r["lang"], k] = tuple(min(i, max(0.05 * i, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return out


def _last(k: int) -> Column:
    """The last k characters of an n-gram of ORDER."""
    return F.col("gram") if k == ORDER else F.substring("gram", ORDER - k + 1, k)


@dataclass(frozen=True)
class Model:
    """By order: p has lang, gram and p (of the last character, given the others); weights has lang, ctx and gamma (what a context leaves to the lower order). unknown has lang and the probability of a character never seen."""

    p: dict[int, DataFrame]
    weights: dict[int, DataFrame]
    unknown: DataFrame


def train(texts: Spool, trusted: DataFrame) -> Model | None:
    """The model of the documents whose doc_id is among ``trusted`` (trusted_id); None if there is no text."""
    spark = trusted.sparkSession
    rows = texts.table.where(F.col("row").isNotNull()).select("part", "file", "row", "doc_id")
    chosen = rows.join(trusted.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi").select("part", "file", "row")
    counts = texts.dealt(chosen).mapInArrow(_counted(texts.folder), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    orders = {ORDER: materialize(counts, "ngrams")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.substring("gram", 2, k)
        orders[k] = materialize(orders[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "ngrams")
    discounts = _discounts(orders)
    if not discounts:
        return None
    table = spark.createDataFrame([(lang, k, *d) for (lang, k), d in discounts.items()], "dl string, dk int, d1 double, d2 double, d3 double")
    unknown = materialize(orders[1].groupBy("lang").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("base")), "unknown")
    p, weights, lower = {}, {}, unknown.select(F.col("lang").alias("ll"), F.lit("").alias("lg"), F.col("base").alias("lower"))
    for k in range(1, ORDER + 1):
        own = table.where(F.col("dk") == k).drop("dk")
        t = orders[k].join(F.broadcast(own), F.col("lang") == F.col("dl")).withColumn("ctx", F.substring("gram", 1, k - 1))
        held = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        totals = t.groupBy(F.col("lang").alias("cl"), F.col("ctx").alias("cc")).agg(F.sum("n").alias("total"), F.sum(held).alias("freed"))
        totals = materialize(totals.withColumn("gamma", F.col("freed") / F.col("total")), "contexts")
        joined = t.join(totals, (F.col("lang") == F.col("cl")) & (F.col("ctx") == F.col("cc")))
        joined = joined.join(lower, (F.col("lang") == F.col("ll")) & (F.substring("gram", 2, k - 1) == F.col("lg")))
        found = (F.col("n") - held) / F.col("total") + F.col("gamma") * F.col("lower")
        p[k] = materialize(joined.select("lang", "gram", found.alias("p")), "probabilities")
        weights[k] = totals.select(F.col("cl").alias("lang"), F.col("cc").alias("ctx"), "gamma")
        lower = p[k].select(F.col("lang").alias("ll"), F.col("gram").alias("lg"), F.col("p").alias("lower"))
    for table in orders.values():
        discard(table)
    return Model(p, weights, unknown)


def _answers(texts: Spool, model: Model) -> DataFrame:
    """part, lang, gram and log probability of every n-gram of every spool file whose language has a model."""
    left = texts.table.where(F.col("gram").isNotNull()).groupBy("lang", "gram").agg(F.collect_list("part").alias("parts"))
    left = left.withColumn("weight", F.lit(0.0))
    found = []
    for k in range(ORDER, 0, -1):
        own = model.p[k].select(F.col("lang").alias("pl"), F.col("gram").alias("pg"), "p")
        tried = materialize(left.join(own, (F.col("lang") == F.col("pl")) & (_last(k) == F.col("pg")), "left").select("lang", "gram", "parts", "weight", "p"), "asked", compression="zstd")
        found.append(tried.where(F.col("p").isNotNull()).select("parts", "lang", "gram", (F.col("weight") + F.log("p")).alias("value")))
        context = model.weights[k].select(F.col("lang").alias("wl"), F.col("ctx").alias("wc"), "gamma")
        same = (F.col("lang") == F.col("wl")) & (F.substring("gram", ORDER - k + 1, k - 1) == F.col("wc"))
        left = tried.where(F.col("p").isNull()).join(context, same, "left").select("lang", "gram", "parts", (F.col("weight") + F.coalesce(F.log("gamma"), F.lit(0.0))).alias("weight"))
    never = left.join(model.unknown.select(F.col("lang").alias("ul"), "base"), F.col("lang") == F.col("ul"))
    every = never.select("parts", "lang", "gram", (F.col("weight") + F.log("base")).alias("value"))
    for part in found:
        every = every.unionByName(part)
    return every.select(F.explode("parts").alias("part"), "lang", "gram", F.col("value").cast("float").alias("value"))


def _added(folder: str):
    """Documents of each spool file with the log probabilities of their characters added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            name = next(x for x in rows.column("file").unique().to_pylist() if x is not None)
            known: dict[str, tuple[pd.Index, np.ndarray]] = {}
            rows = rows.filter(pa.compute.is_valid(rows.column("gram")))
            for lang in rows.column("lang").unique().to_pylist():
                mine = rows.filter(pa.compute.equal(rows.column("lang"), lang))
                known[lang] = (pd.Index(mine.column("gram").to_pylist(), dtype=object), mine.column("value").to_numpy())
            del rows
            for chunk in read(folder, name):
                n, total = np.zeros(len(chunk), np.int64), np.zeros(len(chunk))
                sizes = np.zeros(len(chunk), np.int64)
                for lang, mine, texts in _by_language(chunk):
                    sizes[mine] = [len(t) for t in texts]
                    if lang not in known:
                        continue
                    owner, number, names = grams(texts)
                    if not names:
                        continue
                    index, values = known[lang]
                    place = index.get_indexer(names)
                    if (place < 0).any():
                        raise ValueError("a spool file has n-grams that were never asked for")
                    total[mine] = np.bincount(owner, values[place].astype(np.float64)[number], minlength=len(texts))
                    n[mine] = np.bincount(owner, minlength=len(texts))
                yield pa.record_batch({"doc_id": chunk.column("doc_id"), "lang": chunk.column("lang"), "size": pa.array(sizes), "n": pa.array(n), "total": pa.array(total)})

    return run


def score(texts: Spool, model: Model | None) -> DataFrame:
    """doc_id, lang, size (in characters) and perplexity of every document's whole text; null where its language has no model or it is empty."""
    files = texts.table.select("part", "file").distinct().select("part", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("gram"), F.lit(None).cast("float").alias("value"), "file")
    rows = files if model is None else files.unionByName(_answers(texts, model).withColumn("file", F.lit(None).cast("string")))
    found = texts.dealt(rows).mapInArrow(_added(texts.folder), "doc_id long, lang string, size long, n long, total double")
    return found.select("doc_id", "lang", "size", F.when(F.col("n") > 0, F.exp(-F.col("total") / F.col("n"))).alias("perplexity"))


def calibrates(doc_id: Column) -> Column:
    """Whether a trusted document is kept out of training, for the thresholds."""
    return F.crc32(doc_id.cast("string")) % FOLDS == CALIBRATION


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Every document's doc_id, lang, perplexity, threshold (its language's) and kept.

    Trusted are the documents with a label of quality 1; a tenth of them, chosen by doc_id, sets the thresholds and the
    others train the model. Cases: null and empty texts have no perplexity and aren't kept; a document whose language has
    no trained text has no perplexity and is kept, as nothing speaks against it; a language none of whose trusted documents
    was kept out of training takes its threshold from those that were not; a null lang is a language of its own, named by
    the empty string; a doc_id with several labels is trusted if one of them is 1; a null doc_id is never trusted; repeated
    rows are scored each; empty tables give no rows; other columns are left out.
    """
    trusted = labels.where((labels["quality"] == 1) & labels["doc_id"].isNotNull()).select(labels["doc_id"].cast("long").alias("trusted_id")).distinct()
    trusted = materialize(trusted.withColumn("apart", calibrates(F.col("trusted_id"))), "trusted")
    texts = spool(docs)
    model = train(texts, trusted.where(~F.col("apart")))
    scored = materialize(score(texts, model), "perplexity")
    texts.remove()
    # Documents meet their labels by shuffle at every size; a broadcast would be bounded by nothing.
    sample = scored.where(F.col("perplexity").isNotNull()).join(trusted.hint("merge"), F.col("doc_id") == F.col("trusted_id"))
    at = lambda c: F.percentile_approx(c, quantile, 10_000)
    limits = sample.groupBy(F.col("lang").alias("limit_lang")).agg((F.coalesce(at(F.when(F.col("apart"), F.col("perplexity"))), at("perplexity")) * margin).alias("threshold"))
    joined = scored.join(F.broadcast(limits), F.col("lang") == F.col("limit_lang"), "left")
    kept = (F.col("size") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return joined.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))
