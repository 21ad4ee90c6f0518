"""Language identification of mixed-language text.

The script of a word's letters, by code point ranges, narrows the candidates to the languages seen in that script. A word's
score in a language is the log likelihood of its letter trigrams. Viterbi over the words, with a penalty for each switch,
labels spans; a text's language is the one whose spans hold most letters. The model is learned from a bounded sample of
labelled texts: trigram counts in BUCKETS hashed cells a language, so its size hangs on the number of languages only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import CHUNK_BYTES, chunks, partitions, released, utf8

BUCKETS = 1 << 17
#: Texts a language that the model learns from, as expected by the sampling hash.
SAMPLE = 2000
#: Log likelihood that a switch of language costs, and the most that one word can tell between two languages.
SWITCH, WORD_LIMIT = 12.0, 8.0
NO_LANGUAGE = "und"

#: First and last code point of the scripts told apart; other letters make up a script of their own (1).
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "myanmar": ((0x1000, 0x109F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
    "ethiopic": ((0x1200, 0x139F),),
    "khmer": ((0x1780, 0x17FF),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
N_SCRIPTS = len(SCRIPTS) + 2


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Script (0: no letter) and lower case of every code point."""
    script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x33480):
        char = chr(c)
        if char.isalpha():
            script[c] = 1
            small = char.lower()
            if len(small) == 1:
                lower[c] = ord(small)
    for number, ranges in enumerate(SCRIPTS.values(), 2):
        for lo, hi in ranges:
            part = script[lo : hi + 1]
            part[part > 0] = number
    return script, lower


def letter_words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Trigram cells of all letters, then start (in letters), row, script and place (in the row's characters) of every word.

    A word is a run of letters of one script. Trigrams are centred on each letter; what is not of the word counts as 0.
    """
    script_of, lower_of = _letters()
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    script = script_of[points]
    row_start = np.cumsum(sizes) - sizes
    edge = np.zeros(len(points) + 1, bool)
    edge[row_start] = True
    first = script > 0
    first[1:] &= (script[1:] != script[:-1]) | edge[1:-1]
    low = np.where(script > 0, lower_of[points], 0).astype(np.uint64)
    before, after = np.zeros_like(low), np.zeros_like(low)
    before[1:] = np.where(first[1:], 0, low[:-1])
    ends = np.ones(len(points), bool)
    ends[:-1] = first[1:] | (script[1:] == 0)
    after[:-1] = np.where(ends[:-1], 0, low[1:])
    cell = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (low * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
    cell = ((cell ^ (cell >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 17)
    letters = np.flatnonzero(script)
    place = np.flatnonzero(first)
    starts = np.searchsorted(letters, place)
    row = np.searchsorted(row_start, place, side="right") - 1
    return cell[letters].astype(np.int32), starts, row, script[place], place - row_start[row]


class Model:
    """Trigram log likelihoods of each language, and which languages use which script."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.names = names
        total = counts.sum(axis=0)
        self.table = np.log((counts + 0.3) / (total + 0.3 * BUCKETS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.allowed = share.T >= 0.005
        self.allowed[~self.allowed.any(axis=1)] = True
        self.common = int(np.argmax(total)) if len(names) else -1

    def scores(self, cells: np.ndarray, starts: np.ndarray, script: np.ndarray) -> np.ndarray:
        """Log likelihood of every word in every language, less the best one's; what script rules out gets the limit."""
        words = np.add.reduceat(self.table[cells], starts, axis=0, dtype=np.float32)
        words[~self.allowed[script]] = -np.inf
        return np.maximum(words - words.max(axis=1, keepdims=True), -WORD_LIMIT)


def viterbi(score: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Best language of every word; ``heads`` are the first words of each text and the end. All texts advance together."""
    lens = np.diff(heads)
    order = np.argsort(-lens, kind="stable")
    lens, begin = lens[order], heads[:-1][order]
    n, k = len(lens), score.shape[1]
    back = np.empty(len(score), np.int8) if k < 128 else np.empty(len(score), np.int32)
    switched = np.zeros(score.shape, bool)
    best = score[begin].copy()
    live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right") if n else []
    for t in range(1, lens[0] if n else 0):
        m = live[t]
        top = best[:m].max(axis=1)
        at = begin[:m] + t
        back[at] = best[:m].argmax(axis=1)
        jump = (top - SWITCH)[:, None] > best[:m]
        switched[at] = jump
        best[:m] = np.where(jump, (top - SWITCH)[:, None], best[:m]) + score[at]
    out = np.empty(len(score), np.int64)
    state = best.argmax(axis=1) if n else np.zeros(0, np.int64)
    for t in range((lens[0] if n else 0) - 1, -1, -1):
        m = live[t]
        at = begin[:m] + t
        out[at] = state[:m]
        jump = switched[at, state[:m]]
        state[:m] = np.where(jump, back[at], state[:m])
    return out


def label(score: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Best language of every word, as Viterbi finds it.

    Where leaving a text's best single language gains less than one switch costs over any stretch, one language is the
    best path; only the other texts are searched.
    """
    lens = np.diff(heads)
    if not len(lens):
        return np.zeros(0, np.int64)
    main = np.add.reduceat(score, heads[:-1], axis=0, dtype=np.float64).argmax(axis=1)
    each = np.repeat(main, lens)
    gain = -score[np.arange(len(score)), each].astype(np.float64)
    mixed = np.flatnonzero(np.add.reduceat(gain, heads[:-1]) > SWITCH)
    if len(mixed):
        # The gain over the best other language may be negative; its best stretch bounds what a switch can win.
        other = score.astype(np.float64).copy()
        other[np.arange(len(score)), each] = -np.inf
        gain += other.max(axis=1) if score.shape[1] > 1 else 0
        run = np.cumsum(gain)
        pick = np.zeros(len(lens), bool)
        for i in mixed.tolist():
            part = np.r_[0.0, run[heads[i] : heads[i + 1]] - (run[heads[i] - 1] if heads[i] else 0.0)]
            pick[i] = (part - np.minimum.accumulate(part)).max() > SWITCH
        mixed = np.flatnonzero(pick)
    if len(mixed):
        words = np.concatenate([np.arange(heads[i], heads[i + 1]) for i in mixed.tolist()])
        each[words] = viterbi(score[words], np.r_[0, np.cumsum(lens[mixed])])
    return each


def _counted(languages: Broadcast[list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(languages.value)}
        counts = np.zeros((len(index), BUCKETS + N_SCRIPTS), np.int64)
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for lo, hi in chunks(offs):
                texts = [bytes(raw[offs[i] : offs[i + 1]]).decode() for i in range(lo, hi)]
                cells, starts, row, script, _ = letter_words(texts)
                lens = np.diff(np.r_[starts, len(cells)])
                lang = np.array([index[x] for x in langs[lo:hi]])[row]
                np.add.at(counts, (np.repeat(lang, lens), cells), 1)
                np.add.at(counts, (lang, BUCKETS + script.astype(np.int64)), lens)
        lang, cell = np.nonzero(counts)
        yield pa.record_batch({"lang": pa.array(lang.astype(np.int32)), "cell": pa.array(cell.astype(np.int32)), "n": pa.array(counts[lang, cell])})

    return run


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the languages in ``labelled`` (doc_id, text, lang); null languages and texts teach nothing.

    Of each language about ``sample`` texts are taken, chosen by a hash of doc_id; all of them if there are fewer.
    """
    spark = labelled.sparkSession
    rows = labelled.select(labelled["doc_id"], labelled["text"], labelled["lang"]).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    counts = np.zeros((BUCKETS, len(names)), np.int64)
    scripts = np.zeros((len(names), N_SCRIPTS), np.int64)
    if names:
        share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, sample / sizes[k]))])
        chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
        told = chosen.select("lang", "text").coalesce(partitions(spark)).mapInArrow(released(_counted(spark.sparkContext.broadcast(names))), "lang int, cell int, n long")
        table = told.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most languages * (BUCKETS + N_SCRIPTS) rows
        lang, cell, n = (table.column(c).to_numpy() for c in ("lang", "cell", "n"))
        letter = cell < BUCKETS
        counts[cell[letter], lang[letter]] = n[letter]
        scripts[lang[~letter], cell[~letter] - BUCKETS] = n[~letter]
    return Model(names, counts, scripts)


def _predicted(model: Broadcast[Model], with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            for lo, hi in chunks(offs, CHUNK_BYTES // 4):
                texts = [bytes(raw[offs[i] : offs[i + 1]]).decode() for i in range(lo, hi)]
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo), **_labels(known, texts, with_spans)})

    return run


def _labels(model: Model, texts: list[str], with_spans: bool) -> dict[str, pa.Array]:
    n = len(texts)
    names, score, spans = [NO_LANGUAGE] * n, np.zeros(n), [[] for _ in range(n)]
    cells, starts, row, script, place = letter_words(texts)
    if len(starts) and model.names:
        lens = np.diff(np.r_[starts, len(cells)])
        head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        found = label(model.scores(cells, starts, script), np.r_[head, len(row)])
        letters = np.zeros((n, len(model.names)))
        np.add.at(letters, (row, found), lens)
        have = row[head]
        best = letters[have].argmax(axis=1)
        score[have] = letters[have, best] / letters[have].sum(axis=1)
        for i, b in zip(have.tolist(), best.tolist(), strict=True):
            names[i] = model.names[b]
        if with_spans:
            cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (found[1:] != found[:-1])])
            last = np.r_[cut[1:], len(row)] - 1
            for i, a, b, k in zip(row[cut].tolist(), place[cut].tolist(), (place[last] + lens[last]).tolist(), found[cut].tolist(), strict=True):
                spans[i].append({"start": a, "end": b, "lang": model.names[k]})
    out = {"lang_pred": pa.array(names), "score": pa.array(score)}
    if with_spans:
        out["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))
    return out


def identify(docs: DataFrame, model: Model, *, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (share of letters in spans of lang_pred) and, if ``with_spans``, spans (in characters).

    Cases: null text and text without a letter are ``und`` with score 0, as is everything if nothing was learned; letters
    of scripts that no language was seen in may be any language; ties go to the language first in order; repeated rows
    are judged each; an empty table gives no rows; other columns are left out.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * with_spans
    return rows.mapInArrow(released(_predicted(docs.sparkSession.sparkContext.broadcast(model), with_spans)), schema)


def held_out(docs: DataFrame):
    """Which documents nothing is learned from: CRC-32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 3 == 1, F.lit(False))


def _kept(model: Broadcast[Model], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column(column))
            for lo, hi in chunks(offs, CHUNK_BYTES // 4):
                texts = [bytes(raw[offs[i] : offs[i + 1]]).decode() for i in range(lo, hi)]
                named = pa.array([x.as_py() != NO_LANGUAGE for x in _labels(model.value, texts, False)["lang_pred"]], pa.bool_())
                yield batch.slice(lo, hi - lo).filter(named)

    return run


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are text in some learned language, with all their columns; those that are ``und`` go."""
    return docs.mapInArrow(released(_kept(docs.sparkSession.sparkContext.broadcast(model), "text")), docs.schema)
