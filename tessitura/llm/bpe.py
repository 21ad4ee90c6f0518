"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

Texts are cut into words by the tokenizer's pattern. Words that a worker has not met lie side by side in one flat array
of symbols; each round looks up all neighbouring pairs by binary search over the sorted pair keys, takes the lowest rank
of every word and merges all its places at once, until no word has a pair left. Encoded words are remembered in a table
of bounded size. The vocabulary's path is a parameter; executors read the file once, on the driver's behalf, through a
broadcast of its content (its size is the vocabulary's, whatever the input).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from ._shared import released, utf8

#: Words remembered by a worker; the table starts anew when it is full.
CACHED_WORDS = 400_000
#: Text bytes that are cut into words at once; a byte of text takes some 25 bytes of memory while it is encoded.
ENCODED = 1 << 20
#: Symbols merged in one flat array.
FLAT_SYMBOLS = 1 << 20


@lru_cache(maxsize=1)
def byte_characters() -> tuple[str, ...]:
    """The printable character that byte-level vocabularies write for each byte: itself where printable, else from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(printable)]
    out = [""] * 256
    for b in printable:
        out[b] = chr(b)
    for i, b in enumerate(rest):
        out[b] = chr(0x100 + i)
    return tuple(out)


class ByteBPE:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    #: Fixed value: the pattern that byte-level vocabularies split words by.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        vocab: dict[str, int] = model["vocab"]
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)
        for token in spec["added_tokens"]:
            self.pieces[token["id"]] = token["content"].encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.find = regex.compile(self.PATTERN).findall
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word, packed as 32-bit integers, by merge rounds over all of them at once."""
        out = [b""] * len(words)
        lens = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        none = np.int64(1 << 40)
        n = len(sym)
        rank, into, stale = np.full(n, none), np.zeros(n, np.int64), np.arange(n)
        inner = np.zeros(n, bool)
        inner[:-1] = word[:-1] == word[1:]
        while len(sym):
            # Only pairs that a merge has changed are looked up again.
            live = stale[inner[stale]]
            key = sym[live] << 32 | sym[live + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank[stale] = none
            rank[live[hit]], into[live[hit]] = self.ranks[at[hit]], self.merged[at[hit]]
            first = np.flatnonzero(np.r_[True, ~inner[:-1]])
            best = np.minimum.reduceat(rank, first)
            done = best == none
            span = np.diff(np.r_[first, len(sym)])
            if done.any():
                ids = sym.astype("<i4").tobytes()
                for a, n, w in zip((4 * first[done]).tolist(), (4 * span[done]).tolist(), word[first[done]].tolist(), strict=True):
                    out[w] = ids[a : a + n]
            places = np.flatnonzero((rank == np.repeat(best, span)) & (rank < none))
            if len(places):
                # Of places in a row (a a a) only every other one can merge, from the left.
                fresh = np.r_[True, np.diff(places) > 1]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
                sym[places] = into[places]
            keep = np.repeat(~done, span)
            keep[places + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[places] = True
            changed[places[places > 0] - 1] = True
            sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
            stale = np.flatnonzero(changed[keep])
            inner = np.zeros(len(sym), bool)
            inner[:-1] = word[:-1] == word[1:]
        return out

    def learn(self, words: set[str]) -> None:
        """Encode words into the table, in flat arrays of bounded length."""
        if len(self.cache) + len(words) > CACHED_WORDS:
            self.cache = {}
        part, size = [], 0
        for w in words:
            part.append(w)
            size += len(w)
            if size > FLAT_SYMBOLS:
                self.cache.update(zip(part, self.merge([x.encode() for x in part]), strict=True))
                part, size = [], 0
        if part:
            self.cache.update(zip(part, self.merge([x.encode() for x in part]), strict=True))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text; special tokens' strings become their ids, as in the vocabulary's own library."""
        special = [self.cut is not None and self.cut.search(t) is not None for t in texts]
        pieces = [self._around(t) if own else self.find(t) for t, own in zip(texts, special, strict=True)]
        fresh = set().union(*pieces) - self.added.keys()
        missing = fresh - self.cache.keys()
        if missing:
            self.learn(fresh if len(self.cache) + len(missing) > CACHED_WORDS else missing)
        known = self.cache.__getitem__
        out = [b"" if own else b"".join(map(known, p)) for p, own in zip(pieces, special, strict=True)]
        for k in [k for k, own in enumerate(special) if own]:
            out[k] = b"".join(self.added[w].to_bytes(4, "little") if w in self.added else known(w) for w in pieces[k])
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text."""
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_packed(texts)]

    def _around(self, text: str) -> list[str]:
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self.find(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


def _encoded(content: Broadcast[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has a vocabulary and a table of words of its own: workers live on, and would keep them for the stages after.
        bpe = ByteBPE(content.value)
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            view = memoryview(raw)
            ids_of_batch = batch.column("doc_id")
            lo, n = 0, len(offs) - 1
            while lo < n:
                hi = lo + 1
                while hi < n and offs[hi + 1] - offs[lo] <= ENCODED:
                    hi += 1
                texts = [str(view[offs[i] : offs[i + 1]], "utf-8") for i in range(lo, hi)]
                packed = [np.frombuffer(x, "<i4") for x in bpe.encode_packed(texts)]
                n_tokens, digests, decoded = [], [], []
                for x in packed:
                    ids = x.tolist()
                    n_tokens.append(len(ids))
                    digests.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                columns = {"doc_id": ids_of_batch.slice(lo, hi - lo), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                if with_ids:
                    columns["ids"] = pa.array(packed, pa.list_(pa.int32()))
                yield pa.record_batch(columns)
                lo = hi

    return run


def encode(docs: DataFrame, vocabulary: str, *, with_ids: bool = True) -> DataFrame:
    """Token ids of every document's whole text, and digests of the ids and of the text decoded from them.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 and, if ``with_ids``, ids.
    Cases: null text is empty and has no tokens; a text of any length is one document; repeated rows are encoded each;
    an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(released(_encoded(content, with_ids)), schema)
