"""Merge-type subword encoding by backtracking, and decoding.

The vocabulary is that of a merge-type (BPE) SentencePiece model; its file is a parameter. A chunk of text
is encoded without running merges over it: take the longest piece that fits at a position (Aho-Corasick
automaton over the pieces), accept it if it is compatible with the piece before it, that is, if merging
the two pieces' characters from scratch gives back exactly these two, else try the next shorter piece or
go back one piece. Positions from which no compatible continuation exists are marked in a bitfield and not
tried again. Each compatibility is found once by re-merging and kept.

Chunks are cut wherever two neighbouring characters stand side by side in no piece, so before every space
mark that follows another character and mostly between letters, digits and punctuation: merges never cross
such a place, so the encodings of the chunks are the encoding of the text. The chunks of a batch are found at
once from a table of neighbours; distinct ones are few and are kept in a bounded cache. Runs of several space marks are merged directly, because the pieces
made of marks alone have equal scores, for which the compatibility of neighbours does not decide.

Characters outside the vocabulary become one piece per UTF-8 byte and never merge.

Defined results: null texts are empty; an empty text has only the end id, if one is asked for; repeated
rows are encoded one by one; other columns are kept, except that result columns replace columns of the
same name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tallyweir.llm.cells import code_points, distinct, laid_out

MARK = "▁"
#: Entries of the young half of a cache; when it is full it becomes the old half, whose entries come back as they are met.
CACHE_CHUNKS = 120_000
CACHE_PAIRS = 250_000
CACHED_CHARS = 64
#: Text that is turned into chunks at a time; the arrays made of it take about 25 times as much.
BATCH_BYTES = 1 << 20
#: Characters that the table of neighbours tells apart; further ones share its last row, which only makes chunks longer.
TOLD_APART = 4096


class PieceModel:
    """Vocabulary, merge scores and caches of one model file; made once per worker process."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [source.id_to_piece(i) for i in range(source.get_piece_size())]
        self.end_id = source.eos_id()
        self.unknown_id = source.unk_id()
        self.byte_value: dict[int, int] = {}
        self.control: set[int] = set()
        self.normal: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, piece in enumerate(self.pieces):
            if source.is_byte(i):
                self.byte_value[i] = int(piece[1:-1], 16)
            elif source.is_control(i):
                self.control.add(i)
            elif not source.is_unknown(i):
                self.normal[piece] = i
                self.score[piece] = source.get_score(i)
        for piece in self.normal:
            if MARK in piece[1:] and piece.strip(MARK):
                raise ValueError("a piece holds a space mark after another character; chunks would not be independent")
        self.byte_id = {value: i for i, value in self.byte_value.items()}
        # Only pieces that merging can arrive at take part. ``shorter`` leads from a piece to the longest piece that
        # is a proper prefix of it, so one longest match gives all pieces that fit at a place.
        alphabet = {piece for piece in self.normal if len(piece) == 1}
        self.known = frozenset(alphabet)
        whole_ = [piece for piece in self.normal if self.merged(piece) == [piece]]
        self.automaton = ahocorasick.Automaton()
        for piece in whole_:
            self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        made = set(whole_)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in made), None) for p in whole_}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.older_compatible: dict[tuple[str, str], bool] = {}
        # Row 0 is that of characters outside the vocabulary, which stand alone.
        rows = {c: min(i, TOLD_APART) for i, c in enumerate(sorted(alphabet), 1)}
        self.rows = np.zeros(0x110000, np.int32)
        self.rows[[ord(c) for c in rows]] = list(rows.values())
        self.width = max(rows.values(), default=0) + 1
        self.neighbours = np.zeros(self.width * self.width, bool)
        pairs = {pair for piece in self.normal for pair in zip(piece, piece[1:])}
        self.neighbours[[rows[a] * self.width + rows[b] for a, b in pairs if a in rows and b in rows]] = True
        #: Of each chunk the ids as text, each with a blank after it, a line feed, and what they decode to inside a text.
        self.chunks: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}
        self.long_chunks: list[str] = []

    def merged(self, text: str) -> list[str]:
        """The pieces that merging from single characters gives: best score first, leftmost first among equals."""
        parts: list[str] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (both := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right or not left or not right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether the first piece may stand directly before the second; found by merging their characters anew."""
        known = self.older_compatible.get(pair)
        if known is None:
            known = self.merged(pair[0] + pair[1]) == [pair[0], pair[1]]
        self.compatible[pair] = known
        return known

    def backtracked(self, text: str) -> list[str]:
        """The pieces of a text that consists of known characters."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, (size, piece) in self.automaton.iter(text):  # ends ascend, so the longest at a start comes last
            longest[end - size + 1] = piece
        open_ = bytearray(b"\x01") * (n + 1)
        compatible, shorter = self.compatible, self.shorter
        out: list[str] = []
        at, last, piece = 0, "", longest[0] if n else None
        while at < n:
            while piece is not None:
                if open_[at + len(piece)]:
                    if not last:
                        break
                    pair = (last, piece)
                    fits = compatible.get(pair)
                    if fits is None:
                        fits = self._fits(pair)
                    if fits:
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                at += len(piece)
                last, piece = piece, longest[at] if at < n else None
                continue
            open_[at] = 0
            if not out:
                raise ValueError("no encoding; the vocabulary lacks a character")
            gone = out.pop()
            at -= len(gone)
            last, piece = out[-1] if out else "", shorter[gone]
        return out

    def _pieces_of(self, run: str) -> list[str]:
        return self.merged(run) if run.startswith(MARK + MARK) else self.backtracked(run)

    def _made(self, chunk: str) -> bytes:
        normal = self.normal
        if self.known.issuperset(chunk):
            pieces = self._pieces_of(chunk)
            return ("".join([f"{normal[p]} " for p in pieces]) + "\n" + "".join(pieces).replace(MARK, " ")).encode()
        ids: list[int] = []
        for known, group in groupby(chunk, self.known.__contains__):
            run = "".join(group)
            ids.extend([normal[p] for p in self._pieces_of(run)] if known else [self.byte_id[b] for b in run.encode()])
        return ("".join([f"{i} " for i in ids]) + "\n" + self.decode(ids, inside=True)).encode()

    def learn(self, chunks: list[str]) -> list[tuple[bytes, bytes, int]]:
        """The ids as text, what they decode to and their number, of each of these distinct chunks; each new one is encoded once."""
        for chunk in self.long_chunks:
            self.chunks.pop(chunk, None)
        if len(self.chunks) > CACHE_CHUNKS:
            self.older_chunks, self.chunks = self.chunks, {}
        if len(self.compatible) > CACHE_PAIRS:
            self.older_compatible, self.compatible = self.compatible, {}
        new = [chunk for chunk in chunks if chunk not in self.chunks]
        older, made = self.older_chunks.get, self._made
        self.chunks.update([(chunk, older(chunk) or made(chunk)) for chunk in new])
        self.long_chunks = [chunk for chunk in new if len(chunk) > CACHED_CHARS]
        split = [self.chunks[chunk].partition(b"\n") for chunk in chunks]
        return [(ids, decoded, ids.count(b" ")) for ids, _, decoded in split]

    def chunks_of(self, texts: list[str]) -> tuple[pa.Array, list[str], np.ndarray]:
        """The code of every chunk of the texts, the chunk of every code, and where each text's chunks begin, then the end."""
        points, text_at = code_points([MARK + t.replace(" ", MARK) if t else "" for t in texts])
        rows = self.rows[points]
        pairs = rows[:-1] * self.width
        pairs += rows[1:]
        starts = np.ones(len(points), bool)
        starts[1:] = ~self.neighbours[pairs]
        starts[text_at[text_at < len(points)]] = True
        first = np.flatnonzero(starts)
        return *distinct(points, first), np.append(np.searchsorted(first, text_at), len(first))

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        codes, chunks, _ = self.chunks_of([text or ""])
        raw, _ = laid_out([ids for ids, _, _ in self.learn(chunks)], codes)
        ids = [int(i) for i in bytes(raw).split()]
        return [*ids, self.end_id] if end else ids

    def decode(self, ids: Sequence[int], inside: bool = False) -> str:
        """Text of ids: control ids give nothing, byte pieces are joined to characters, the leading mark goes.

        With ``inside`` the ids follow others, and a leading mark is a space.
        """
        out: list[str] = []
        run = bytearray()
        first = not inside

        def flush() -> None:
            if run:
                out.append(_characters(bytes(run)))
                run.clear()

        for i in ids:
            if i in self.byte_value:
                run.append(self.byte_value[i])
                first = False
                continue
            flush()
            if i in self.control:
                continue
            piece = " ⁇ " if i == self.unknown_id else self.pieces[i]
            if first and piece.startswith(MARK):
                piece = piece[1:]
            first = False
            out.append(piece.replace(MARK, " "))
        flush()
        return "".join(out)


def _characters(raw: bytes) -> str:
    """UTF-8 text; every byte that is not part of a valid character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def default_model_path() -> str:
    """The 32k merge-type vocabulary among the installed public ones."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _in_slices(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded text size, so that results of long texts do not pile up."""
    start, size = 0, 0
    lengths = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    for i, n in enumerate(lengths):
        if size and size + n > BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _mapped(docs: DataFrame, text: str, path: str | None, fields: list[StructField], row, keep: bool = True) -> DataFrame:
    names = [f.name for f in fields]
    kept = docs.drop(*[n for n in names if n != text])
    schema = StructType([*(f for f in kept.schema.fields if f.name not in names), *fields])
    if not keep and text not in names:
        schema = StructType([f for f in schema.fields if f.name != text])
    carried = [f.name for f in schema.fields if f.name not in names]
    source = kept.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        model = model_of(path or default_model_path())
        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in _in_slices(batch, batch.column("__text")):
                rows = row(model, part.column("__text").to_pylist())
                columns = [pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], type=t) for t in types]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + columns, [*carried, *names])
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, end: bool = True, ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text (``ids``)."""
    field = StructField(ids, ArrayType(IntegerType()))
    return _mapped(docs, text, path, [field], lambda model, texts: [(model.encode(t, end),) for t in texts])


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, text: str = "decoded") -> DataFrame:
    """``rows`` with the text of each id list; a null list gives an empty text."""
    field = StructField(text, StringType())
    kept = rows.drop(*[c for c in [text] if c != ids])
    schema = StructType([*kept.schema.fields, field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path or default_model_path())
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], [*batch.schema.names, text])

    return kept.mapInArrow(run, schema)


def _digests(model: PieceModel, texts: list[str | None]) -> list[tuple[int, str, str]]:
    """Per text the number of ids with the end id, the hash of the ids as text and the hash of the decoded text.

    A chunk holds whole characters, so byte pieces never run on into the next chunk, and what its chunks' ids
    decode to makes up the text of all ids.
    """
    codes, chunks, text_at = model.chunks_of([t or "" for t in texts])
    kept = model.learn(chunks)
    ids, id_at = laid_out([k[0] for k in kept], codes)
    decoded, decoded_at = laid_out([k[1] for k in kept], codes)
    counts = np.append(0, np.cumsum(np.array([k[2] for k in kept], np.int64)[codes.to_numpy()]))
    bounds = [x[text_at].tolist() for x in (counts, id_at, decoded_at)]
    end, out = str(model.end_id).encode(), []
    for (n, m), (a, b), (c, d) in zip(*[zip(x, x[1:]) for x in bounds], strict=True):
        listed = hashlib.sha256(ids[a:b])
        listed.update(end)
        out.append((m - n + 1, listed.hexdigest(), hashlib.sha256(decoded[min(c + 1, d) : d]).hexdigest()))  # the leading mark goes
    return out


def round_trip_digests(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 in place of the text."""
    fields = [
        StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()),
    ]
    return _mapped(docs, text, path, fields, _digests, keep=False)
