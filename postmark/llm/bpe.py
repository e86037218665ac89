"""Byte-pair encoding and decoding through a pair occurrence index.

The distinct words of a partition's batch lie one after another in a single array of symbols. An
index maps each pair that has a rank to all its positions; ranks are applied in ascending
order from a heap, every merge updates the lists of the pairs to its left and right, and
stale positions are recognised when their rank comes up. Each distinct chunk between white
space is encoded once per worker; texts are then put together from their chunks.

The vocabulary file is the JSON of the tokenizers library (a word-level BPE with a word-end
suffix, byte alphabet, NFC and lower case). Null and empty texts give no ids and the empty
string. Rows are independent, so repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .tables import read

#: Estimated bytes of chunks and their ids that a worker remembers before it starts afresh.
REMEMBERED = 48 << 20
#: Bytes of text encoded together, of new words merged together, and about of decoded text in one batch of rows.
TEXT_BYTES, WORD_BYTES, OUT_BYTES = 2 << 20, 1 << 19, 2 << 20
_SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK, _ODD = re.compile(f"[^{_SPACES}]+"), re.compile("[\\x1c-\\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Vocabulary:
    """Symbols, merge ranks and the cutting of text into words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.symbols: list[str] = [""] * size
        for s, i in (vocab | self.special).items():
            self.symbols[i] = s
        letters = byte_alphabet()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self.size = size
        keys = self.left * size + self.right
        order = np.argsort(keys, kind="stable")
        first = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        self.keys, self.rank = keys[order][first], order[first]
        cut = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(cut)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ids: dict[str, bytes] = {}
        self.remembered = 0
        self.strings = pa.array(self.symbols, pa.string())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 for none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word: merges applied rank by rank over all words at once."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        n = len(data)
        symbol = self.inner[data]
        filled = sizes > 0
        symbol[ends[filled] - 1] = self.last[data[ends[filled] - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[filled] - 1] = -1
        before[starts[filled]] = -1
        alive = symbol >= 0
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enters the positions of pairs that have a rank."""
            r = self.ranks(symbol[at], symbol[after[at]])
            ok = r >= 0
            if not ok.any():
                return
            at, r = at[ok], r[ok]
            if len(r) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, part in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if k in places:
                    places[k].append(part)
                else:
                    places[k] = [part]
                    heapq.heappush(heap, k)

        note(np.flatnonzero(after >= 0))
        while heap:
            k = heapq.heappop(heap)
            found = places.pop(k)
            at = np.sort(np.concatenate(found)) if len(found) > 1 else found[0]
            a, b, made = self.left[k], self.right[k], self.made[k]
            nxt = after[at]
            ok = alive[at] & (symbol[at] == a) & (nxt >= 0)
            ok &= symbol[nxt] == b
            at = at[ok]
            if len(found) > 1 and len(at) > 1:
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            if a == b and len(at) > 1:  # of overlapping pairs the left one is merged
                taken, used = [], -1
                for p in np.sort(at).tolist():
                    if p != used:
                        taken.append(p)
                        used = after[p]
                at = np.array(taken)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at] = made
            alive[gone] = False
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            left = before[at]
            note(np.unique(np.concatenate((left[left >= 0], at[has]))))
        kept = np.flatnonzero(alive)
        out = symbol[kept].astype("<u4")
        return np.split(out, np.searchsorted(kept, ends)[:-1])

    def words_of(self, chunk: str) -> list[str | int]:
        """The words of a chunk without white space; special tokens as their ids."""
        parts = self.specials.split(chunk) if self.specials and "<" in chunk else [chunk]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = unicodedata.normalize("NFC", part) if not part.isascii() else part
                out += self.cut.findall(part.lower() if "Σ" not in part else "".join(c.lower() for c in part))
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks that aren't known yet, so many at a time that the working arrays stay small."""
        if self.remembered > REMEMBERED:
            self.ids.clear()
            self.remembered = 0
        block: list[str] = []
        size = 0
        for c in chunks:
            if c not in self.ids:
                block.append(c)
                size += len(c)
                if size >= WORD_BYTES:
                    self._learn(block)
                    block, size = [], 0
        self._learn(block)

    def _learn(self, new: list[str]) -> None:
        cut = [self.words_of(c) for c in new]
        words = list({w for ws in cut for w in ws if isinstance(w, str)})
        known: dict[str | int, bytes] = {w: x.tobytes() for w, x in zip(words, self.encode_words([w.encode("utf-8", "surrogatepass") for w in words]), strict=True)}
        known |= {i: i.to_bytes(4, "little") for i in self.special.values()}
        for c, ws in zip(new, cut, strict=True):
            ids = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])
            self.ids[c] = ids
            self.remembered += 200 + 2 * len(c) + len(ids)

    def encode(self, texts: list[str]):
        """Yields the little-endian unsigned 32-bit ids of each text."""
        chunks: set[str] = set()
        for t in texts:
            chunks.update(_pieces(t))
        self.learn(chunks)
        get = self.ids.__getitem__
        for t in texts:
            yield b"".join(map(get, _pieces(t)))

    def decode(self, ids: bytes) -> str:
        """The symbols of the ids with a space between, as a tokenizer without a decoder gives them."""
        return " ".join(map(self.symbols.__getitem__, array("I", ids)))

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """``decode`` of every run of ids between two offsets, as one Arrow column."""
        words = self.strings.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


def _pieces(text: str) -> list[str]:
    return text.split() if _ODD.search(text) is None else _CHUNK.findall(text)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _digests(data, offsets) -> pa.Array:
    """The SHA-256 of each run of bytes between two offsets, in hex."""
    view = memoryview(data)
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())


def _rows(v: Vocabulary, doc_ids: pa.Array, encoded: list[bytes], with_ids: bool) -> pa.RecordBatch:
    sizes = np.array([len(x) // 4 for x in encoded], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.frombuffer(b"".join(encoded), "<u4")
    text = v.decode_all(ids, offsets)
    data, ends = K.utf8(text)
    columns = {"doc_id": doc_ids, "n_tokens": pa.array(sizes), "ids_sha256": _digests(ids.view(np.uint8), (offsets * 4).tolist()), "decoded_sha256": _digests(data, ends.tolist())}
    if with_ids:
        columns["token_ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
        columns["decoded"] = text
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text for every document; with ``with_ids`` also both themselves."""
    path = path or default_vocabulary()

    def run(batches):
        v = vocabulary(path)
        for b in K.slices(batches, limit=TEXT_BYTES):
            begin, held, size = 0, [], 0
            for n, ids in enumerate(v.encode(["" if t is None else t for t in b.column("text").to_pylist()]), 1):
                held.append(ids)
                size += len(ids)
                if size >= OUT_BYTES:  # decoded text is somewhat longer than the ids
                    yield _rows(v, b.column("doc_id")[begin:n], held, with_ids)
                    begin, held, size = n, [], 0
            if held:
                yield _rows(v, b.column("doc_id")[begin:], held, with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: encodes and decodes every document."""
    return encode_documents(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids and the decoded text of every document."""
    return encode_documents(docs, with_ids=True)
