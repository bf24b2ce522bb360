"""Token ids as flat binary files.

A token set is a folder of parts in ascending document order:

    part-00000.bin   the ids of the part's documents, one after the other, as unsigned little-endian integers
                     (16 bits if the vocabulary has at most 65,536 entries, else 32)
    part-00000.off   64-bit offsets in ids: where each document starts, then the end (documents + 1 numbers)
    part-00000.doc   64-bit document ids (the smallest 64-bit number stands for a null id)
    index.json       width of an id; for each part its documents, ids and base, the ids in all parts before it

Documents are range-partitioned and sorted by id, so a part's rank is its place in the order; its base is the
prefix sum of the parts' sizes, the only thing the driver gathers (one small row per part). A task writes
under a name of its own and renames when complete, and its content is determined by its input, so a repeated
or speculative task gives the same files. Readers map the files into memory and touch only their documents;
a part is read by several tasks if it is large.

Defined results: a null text is an empty one; with ``end_id`` it has that one id, without it none; repeated
rows are written as often as they come, ordered by id, then text; a null id sorts first; an empty table gives
an index with parts of no documents and no rows back; columns other than id and text are not stored.
"""

from __future__ import annotations

import json
import os
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm.cells import code_points, distinct, laid_out
from tallyweir.session import ensure_checkpoint_dir

NO_ID = -(2**63)
#: Entries of the young half of a cache; a full one becomes the old half, whose entries come back as they are met.
CACHE_WORDS = 200_000
BATCH_CHARS = 4_000_000
#: Documents and ids that one reading task takes from a part at most (a longer document is a task of its own).
READ_DOCS, READ_IDS = 50_000, 16_000_000

# Words in which the library's normalisation is lower-casing alone; its white space is blank or newline for them.
_PLAIN = re.compile("[\x21-\x7e\xa1-įı-ɏ]").fullmatch
#: The vocabulary's cuts that are known here: these endings, runs of letters, single numerals, runs of other characters.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_BLANK, _LETTER, _NUMERAL, _OTHER, _ODD = range(5)
_CHARACTERS = 0x110000


class WordEncoder:
    """Ids of a ``tokenizers`` vocabulary with word ends, from the library, with a cache by cut.

    The library cuts texts at white space and by the vocabulary's pattern and never merges across a cut, so a
    text's ids are those of its cuts. The cuts of a batch are found at once from the classes of its characters;
    each distinct one that is not in the bounded cache is encoded by the library's model. Words with characters that the library's normalisation may change, and all words
    of a vocabulary with another pattern, go to the library whole, and so does a text that may hold a special token.
    """

    def __init__(self, path: str):
        import regex
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec = json.loads(open(path, encoding="utf-8").read())
        self.library = tokenizers.Tokenizer.from_file(path)
        self.size = max(self.library.get_vocab().values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        mark = spec["model"].get("end_of_word_suffix")
        cutter, *spelling = spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if not mark or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a vocabulary of lower-case words with word ends")
        self.kinds = np.full(_CHARACTERS, _ODD, np.uint8)
        self.kinds[[ord(" "), ord("\n")]] = _BLANK
        self.lower = np.arange(_CHARACTERS, dtype="<u4")
        self.spelt: dict[int, str] = {}
        known = cutter["type"] == "Split" and cutter["pattern"].get("Regex") == _CUTS and cutter["invert"] and cutter["behavior"] == "Removed"
        if known and [(s["type"], s.get("add_prefix_space"), s.get("use_regex")) for s in spelling] == [("ByteLevel", False, False)]:
            speller = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            for c in filter(_PLAIN, map(chr, range(0x250))):
                low = c.lower()
                self.lower[ord(c)] = ord(low)
                self.spelt[ord(low)] = speller.pre_tokenize_str(low)[0][0]
                self.kinds[ord(c)] = _LETTER if regex.fullmatch(r"\p{L}", low) else _NUMERAL if regex.fullmatch(r"\p{N}", low) else _OTHER
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, cuts: list[str]) -> Iterator[bytes]:
        """The ids of the vocabulary's own cuts, from the library's model; the steps before it change only their spelling."""
        tokenize, spelt, width = self.library.model.tokenize, self.spelt, self.dtype.itemsize
        for start in range(0, len(cuts), 10_000):
            part = [tokenize(cut if cut.isascii() else cut.translate(spelt)) for cut in cuts[start : start + 10_000]]
            raw = np.array([t.id for tokens in part for t in tokens], dtype=self.dtype).tobytes()
            stops = (np.cumsum([len(tokens) for tokens in part]) * width).tolist()
            yield from (raw[a:b] for a, b in zip([0, *stops], stops))

    def _learn(self, cuts: list[str], odd: list[bool]) -> None:
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        new = [(cut, whole) for cut, whole in zip(cuts, odd, strict=True) if cut not in words]
        words.update([(cut, older[cut]) for cut, _ in new if cut in older])
        if plain := [cut for cut, whole in new if not whole and cut not in older]:
            words.update(zip(plain, self._encoded(plain), strict=True))
        if other := [cut for cut, whole in new if whole and cut not in older]:
            words.update(zip(other, self._library(other), strict=True))

    def _starts(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where cuts start, among characters that are no blanks; ``points`` are lower-cased."""
        starts = np.ones(len(points), bool)
        starts[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMERAL)
        quotes = np.flatnonzero((points == ord("'")) & starts & (kinds == _OTHER))
        after = np.append(points, np.zeros(2, points.dtype))
        for ending in _ENDINGS:
            fits = quotes
            for k, c in enumerate(ending, 1):
                fits = fits[after[fits + k] == ord(c)]
            # an ending in a word that goes to the library whole is no cut of its own
            fits = fits[kinds[np.minimum(fits + 1, len(points) - 1)] == _LETTER]
            starts[fits + 1] = False
            stops = fits + 1 + len(ending)
            starts[stops[stops < len(points)]] = True
        return starts

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        special = [any(s in t for s in self.specials) for t in texts]
        points, text_at = code_points(["" if whole else t for t, whole in zip(texts, special, strict=True)], "\n")
        kinds = self.kinds[points]
        blank = kinds == _BLANK
        odd = np.flatnonzero(kinds == _ODD)
        lower = self.lower[points]
        if len(odd):
            word = np.cumsum(blank)
            whole = np.zeros(int(word[-1]) + 1, bool)
            whole[word[odd]] = True
            within = whole[word] & ~blank
            kinds[within] = _ODD
            lower[within] = points[within]
        starts = self._starts(lower, kinds) & ~blank
        first = np.flatnonzero(starts)
        filled = ~blank
        codes, cuts = distinct(lower[filled], np.flatnonzero(starts[filled]))
        odd_cuts = np.zeros(len(cuts), bool)
        odd_cuts[codes.to_numpy()[kinds[first] == _ODD]] = True
        self._learn(cuts, odd_cuts.tolist())
        ids, offsets = laid_out([self.words[cut] for cut in cuts], codes)
        ends = offsets[np.append(np.searchsorted(first, text_at), len(first))].tolist()
        return [self._library([t])[0] if whole else bytes(ids[a:b]) for t, whole, a, b in zip(texts, special, ends, ends[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _store(folder: str) -> tuple[Any, str]:
    """A file system and the path in it; None for local files, which can be mapped into memory."""
    parts = urllib.parse.urlparse(folder)
    if parts.scheme in ("", "file"):
        return None, urllib.parse.unquote(parts.path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write_file(folder: str, name: str):
    """An open file under a name of its own and the function that gives it its final name."""
    store, path = _store(folder)
    own, final = f"{path}/.{name}.{uuid.uuid4().hex}", f"{path}/{name}"
    if store is None:
        os.makedirs(path, exist_ok=True)
        out = open(own, "wb")
    else:
        store.create_dir(path, recursive=True)
        out = store.open_output_stream(own)

    def done() -> None:
        out.close()
        if store is None:
            os.replace(own, final)
        else:
            store.move(own, final)

    return out, done


def _read_range(folder: str, name: str, dtype: np.dtype, start: int, count: int) -> np.ndarray:
    store, path = _store(f"{folder}/{name}")
    if count <= 0:
        return np.empty(0, dtype)
    if store is None:
        return np.memmap(path, dtype=dtype, mode="r", offset=start * dtype.itemsize, shape=(count,))
    with store.open_input_file(path) as file:
        file.seek(start * dtype.itemsize)
        return np.frombuffer(file.read(count * dtype.itemsize), dtype=dtype)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size > BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def write(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
    end_id: int | None = None, partitions: int | None = None,
) -> dict:
    """Write the ids of all documents to ``folder`` (shared by all executors) and return the index."""
    vocabulary = path or default_vocabulary_path()
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    by_range = rows.repartitionByRange(partitions, "id") if partitions else rows.repartitionByRange("id")
    ordered = by_range.sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}"
        files = {kind: _write_file(folder, f"{name}.{kind}") for kind in ("bin", "off", "doc")}
        tail = b"" if end_id is None else np.array([end_id], dtype=encoder.dtype).tobytes()
        n_docs = n_ids = 0
        files["off"][0].write(np.zeros(1, "<i8").tobytes())
        for ids, texts in _batches(batches):
            raw = [x + tail for x in encoder.encode_batch(texts)]
            ends = n_ids + np.cumsum([len(x) // encoder.dtype.itemsize for x in raw])
            files["bin"][0].write(b"".join(raw))
            files["off"][0].write(ends.astype("<i8").tobytes())
            files["doc"][0].write(np.array([NO_ID if i is None else i for i in ids], dtype="<i8").tobytes())
            n_docs, n_ids = n_docs + len(ids), int(ends[-1])
        for _, done in files.values():
            done()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([n_docs], pa.int64()), "ids": pa.array([n_ids], pa.int64()), "width": pa.array([encoder.dtype.itemsize], pa.int32())})

    parts = sorted(ordered.mapInArrow(run, "part int, docs long, ids long, width int").collect())  # one row per part
    base, listed = 0, []
    for r in parts:
        listed.append({"name": f"part-{r.part:05d}", "docs": r.docs, "ids": r.ids, "base": base})
        base += r.ids
    index = {"width": parts[0].width if parts else 4, "docs": sum(r.docs for r in parts), "ids": base, "parts": listed}
    out, done = _write_file(folder, "index.json")
    out.write(json.dumps(index).encode())
    done()
    return index


def read(spark: SparkSession, folder: str, index: dict) -> DataFrame:
    """Every stored document: doc_id, start (ids of all documents before it), ids (as the file's integers), n_tokens, ids_crc32.

    ``ids_crc32`` is the crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    return _scan(spark, folder, index, with_ids=True)


def checksums(spark: SparkSession, folder: str, index: dict) -> DataFrame:
    """As :func:`read`, without the ids."""
    return _scan(spark, folder, index, with_ids=False)


def _scan(spark: SparkSession, folder: str, index: dict, with_ids: bool) -> DataFrame:
    dtype = np.dtype("<u2" if index["width"] == 2 else "<u4")
    pieces = []
    for p in index["parts"]:
        share = max(1, -(-p["docs"] // READ_DOCS), -(-p["ids"] // READ_IDS))
        step = max(1, -(-p["docs"] // share))
        pieces += [(p["name"], a, min(step, p["docs"] - a), p["base"]) for a in range(0, p["docs"], step)]
    tasks = spark.createDataFrame(pieces, "name string, first long, n long, base long").repartition(max(1, len(pieces)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (t for b in batches for t in b.to_pylist()):
            first, n = task["first"], task["n"]
            off = _read_range(folder, f"{task['name']}.off", np.dtype("<i8"), first, n + 1)
            doc = _read_range(folder, f"{task['name']}.doc", np.dtype("<i8"), first, n)
            for a in range(0, n, 1000):
                at = np.asarray(off[a : min(a + 1000, n) + 1])
                ids = _read_range(folder, f"{task['name']}.bin", dtype, int(at[0]), int(at[-1] - at[0]))
                local = at - at[0]
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(local[:-1], local[1:], strict=True)]
                names = np.asarray(doc[a : a + 1000])
                columns = [pa.array(names, mask=names == NO_ID), pa.array(task["base"] + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(local, pa.int32()), pa.array(ids.astype("int64"))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return tasks.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
