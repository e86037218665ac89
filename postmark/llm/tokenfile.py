"""Token-ID files: flat unsigned integers beside 64-bit document offsets, read through memory maps.

A data set is a folder in the shared storage with, for each partition in ascending doc_id order,
``part-N.bin`` (the ids of its documents one after another, unsigned 16 bits where the vocabulary
allows, else 32, little-endian), ``part-N.idx`` (64-bit offsets into it, one more than documents)
and ``part-N.ids`` (the 64-bit doc_ids; null is kept as the least integer). Writers report only
their counts; prefix sums over partitions give the base of each file. A file is written under
another name and renamed, so a task that runs twice leaves one whole file.

Null and empty texts have the end id only. Equal doc_ids stand together, ordered by text. An
empty table gives an empty data set.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
import zlib
from array import array
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .tables import read, resolved, shared_dir

END_ID = 2
#: Distinct chunks remembered by a worker before it starts afresh; bounds its memory.
REMEMBERED = 1_000_000
_NULL = np.iinfo(np.int64).min


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")


#: Texts that can't be cut before every space and line break: where one of them follows white space, or the marker of a text's start occurs.
_START = "\x01"
_UNEVEN = "[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][ \n]|" + _START


class Encoder:
    """The tokenizers library's ids of whole texts, with each distinct piece given to it once.

    The vocabulary's cutting rule never joins a non-space to white space after it, so a text may be
    cut there without a change of its ids. Arrow cuts texts before their spaces and line breaks and lists the distinct pieces,
    so that Python sees only those; texts with longer runs of white space are cut one by one into runs of
    white space with the word that follows.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}

    def _fill(self, pieces: list[str], chunks: list[str]) -> None:
        for i in range(0, len(chunks), 20_000):
            encoded = self.tokenizer.encode_batch_fast(chunks[i : i + 20_000], add_special_tokens=False)
            for p, e in zip(pieces[i : i + 20_000], encoded, strict=True):
                self.known[p] = self.packed(e.ids)

    def packed(self, ids: list[int]) -> bytes:
        a = array(self.code, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def encode(self, texts: pa.Array | list[str]):
        """Yields the ids of each text as bytes of ``dtype``."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        uneven = pc.match_substring_regex(column, _UNEVEN)
        even = pc.binary_join_element_wise(pa.scalar(_START, pa.large_string()), column.filter(pc.invert(uneven)), pa.scalar("", pa.large_string()))
        pieces = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
        named = pieces.flatten().dictionary_encode()
        names = named.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in names if p not in self.known]
        self._fill(new, [p[1:] if p[:1] == _START else p if p[:1] == "\n" else " " + p for p in new])
        ids = pa.array([self.known[p] for p in names], pa.large_binary()).take(named.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1][pieces.offsets.to_numpy() - pieces.offsets[0].as_py()] if len(ids) else np.zeros(len(pieces) + 1, np.int64)
        view, at = memoryview(data) if data is not None else b"", 0
        for i, odd in enumerate(uneven.to_pylist()):
            if odd:
                chunks = _CHUNK.findall(column[i].as_py())
                # under a name of their own: as a piece, a chunk would get a space before it
                missing = [c for c in set(chunks) if _START + c not in self.known]
                self._fill([_START + c for c in missing], missing)
                yield b"".join([self.known[_START + c] for c in chunks])
            else:
                yield bytes(view[ends[at] : ends[at + 1]])
                at += 1


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder of the shared storage."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _array(fs: pafs.FileSystem, path: str, dtype) -> np.ndarray:
    """A file as an array: through a memory map where the storage is mounted, else read whole."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


class _Files:
    """The three files of one partition while they are written."""

    def __init__(self, folder: str, part: int):
        self.fs, self.folder = _open(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.tag = f"part-{part:06d}", uuid.uuid4().hex
        self.out = self.fs.open_output_stream(self._path("bin"))
        self.offsets, self.ids = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        self.docs = self.tokens = 0

    def _path(self, kind: str) -> str:
        return f"{self.folder}/.{self.name}.{kind}.{self.tag}"

    def add(self, ids: list[int | None], data: list[bytes], width: int) -> None:
        self.out.write(b"".join(data))
        ends = np.cumsum([len(d) // width for d in data], dtype=np.int64) + self.tokens
        self.offsets.append(ends)
        self.ids.append(np.array([_NULL if i is None else i for i in ids], np.int64))
        self.docs, self.tokens = self.docs + len(ids), int(ends[-1])

    def close(self) -> None:
        self.out.close()
        for kind, x in (("idx", self.offsets), ("ids", self.ids)):
            with self.fs.open_output_stream(self._path(kind)) as f:
                f.write(np.concatenate(x).astype("<i8").tobytes())
        for kind in ("bin", "idx", "ids"):
            self.fs.move(self._path(kind), f"{self.folder}/{self.name}.{kind}")


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes all documents into files in ``folder``; returns the manifest (part, docs, tokens, base, width), a row a file.

    The manifest has one row for each partition of the sort, which is all the driver gathers.
    """
    path = path or default_vocabulary()
    spark = docs.sparkSession

    def run(batches):
        e, files = encoder(path), None
        end = np.array([end_id], e.dtype).tobytes()
        for b in K.slices(batches, limit=4 << 20):
            if files is None:
                files = _Files(folder, TaskContext.get().partitionId())
            files.add(b.column("doc_id").to_pylist(), [x + end for x in e.encode(pc.fill_null(b.column("text"), ""))], e.dtype.itemsize)
        if files is not None:
            files.close()
            yield pa.RecordBatch.from_pydict({"part": [files.name], "docs": [files.docs], "tokens": [files.tokens], "width": [e.dtype.itemsize]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    parts = sorted(ordered.mapInArrow(run, "part string, docs long, tokens long, width long").collect())
    base, rows = 0, []
    for p in parts:
        rows.append((p["part"], p["docs"], p["tokens"], base, p["width"]))
        base += p["tokens"]
    return spark.createDataFrame(rows, "part string, docs long, tokens long, base long, width long")


def documents(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Reads a data set back: doc_id, start (ids of all documents before), n_tokens and ids_crc32, with the ids if asked for."""

    def run(batches):
        fs, where = _open(folder)
        for m in batches:
            for r in m.to_pylist():
                flat = _array(fs, f"{where}/{r['part']}.bin", f"<u{r['width']}")
                offsets, ids = _array(fs, f"{where}/{r['part']}.idx", "<i8"), _array(fs, f"{where}/{r['part']}.ids", "<i8")
                begin = 0
                while begin < len(ids):
                    stop = max(begin + 1, min(begin + 20_000, int(np.searchsorted(offsets, offsets[begin] + (1 << 20), side="right")) - 1))
                    some = flat[offsets[begin] : offsets[stop]].astype("<u4")
                    cuts = np.asarray(offsets[begin : stop + 1]) - offsets[begin]
                    who = np.asarray(ids[begin:stop])
                    view = memoryview(some).cast("B")
                    out = {
                        "doc_id": pa.array(who, mask=who == _NULL),
                        "start": pa.array(cuts[:-1] + offsets[begin] + r["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(cuts), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64()),
                    }
                    if with_ids:
                        out["token_ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(some.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
                    begin = stop

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", token_ids array<int>" if with_ids else "")
    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "part")
    return spread.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents through the token files and back."""
    folder = resolved(spark, shared_dir(spark))
    return documents(write(read(spark, sf_dir, "documents"), folder), folder)
