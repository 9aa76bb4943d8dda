"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here and rebuilt as a ``tokenizers``
tokenizer: the normaliser (character map, extra spaces), the metaspace marker
and dummy prefix, unigram scores or the merges that BPE scores imply, and byte
fallback.  Encoding runs in batches on the library's own threads.

Where no piece holds the marker after another character (checked on the
vocabulary), no piece crosses from a word into the blanks before the next, so a
text's ids are those of its words one after another.  A task keeps a table of
the words that it has encoded (at most ``WORDS``, then it starts anew) and
gives the library only words that are not in it.  Other vocabularies are
encoded text by text.

Decoding lays the pieces' bytes end to end by array operations, for ids in
place of the library's decoder (which ``decoder`` builds, for comparison).
``checked`` encodes and decodes in one pass over the texts, which then stay in
the task; ``coded`` returns the decoded texts too.  Long texts are worked off
in pieces cut between words, so arrays stay as small as for many short texts.

Defined results: null and empty texts have no ids and decode to ``""``; text
that spells a control or byte piece (``</s>``, ``<0x0A>``) is ordinary text;
malformed bytes decode to U+FFFD; repeated rows are encoded one by one; an empty table gives
no rows; other columns pass through, one named like a result is replaced.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .buffers import CHUNK_BYTES, chunks, prefix_sums, slices, span_hashes, text_bytes
from .catalog import query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
BATCH = 4096  # distinct words encoded at once
WORDS = 1 << 18  # words that a task remembers
THREADS = "2"  # of the library, in each task, unless the environment says otherwise


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers, or the bytes of the other wire types."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value, i, shift = value | (byte & 127) << shift, i + 1, shift + 7
            if byte < 128:
                return value, i

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class WordTable:
    """Ids of words by their hash; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = WORDS):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words, -1 where unknown."""
        get = self.place.get
        return np.array([get(h, -1) for h in hashes.tolist()], np.int64)

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k = len(self.place), len(hashes)
        while len(self.start) < n + k:
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.start[n:n + k], self.size[n:n + k] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(hashes.tolist(), range(n, n + k), strict=True))


#: Tokenizers that this process has built, by the digest of their model file: tasks come and go, workers stay.
_TOKENIZERS: dict[str, Tokenizer] = {}


@dataclass(frozen=True)
class PieceModel:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]]
    unigram: bool
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    unk_surface: str
    digest: str

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}  # not what was built from them

    @staticmethod
    def parse(data: bytes) -> PieceModel:
        pieces, trainer, norm = [], {}, {}
        for number, value in proto_fields(data):
            if number == 1:
                one = dict(proto_fields(value))
                pieces.append((one.get(1, b"").decode(), struct.unpack("<f", one.get(2, b"\0\0\0\0"))[0], one.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(proto_fields(value))
            elif number == 3:
                norm = dict(proto_fields(value))
        if any(kind == USER for _, _, kind in pieces):
            raise ValueError("user-defined pieces are not supported")
        if not norm.get(5, 1) or trainer.get(24, 0) or trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models with a leading metaspace marker are supported")
        return PieceModel(pieces, trainer.get(3, 1) == 1, bool(trainer.get(35, 0)), norm.get(2, b""), bool(norm.get(3, 1)),
                          bool(norm.get(4, 1)), trainer.get(44, " ⁇ ".encode()).decode(), sha256(data).hexdigest())

    @staticmethod
    def load(path: str = MODEL) -> PieceModel:
        with open(path, "rb") as f:
            return PieceModel.parse(f.read())

    def by_words(self) -> bool:
        return self._apart

    @cached_property
    def _apart(self) -> bool:
        return all(MARK not in piece.lstrip(MARK) for piece, _, kind in self.pieces if kind == NORMAL)

    def merges(self) -> list[tuple[str, str]]:
        """The pairs that BPE may join, best piece first."""
        rank = {p: (-score, i) for i, (p, score, kind) in enumerate(self.pieces) if kind == NORMAL}
        pairs = [(rank[p], (p[:k], p[k:])) for p in rank for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
        return [pair for _, pair in sorted(pairs, key=lambda x: x[0])]

    def normalizer(self) -> normalizers.Normalizer:
        """What turns text into marked text; the dummy prefix is added where a text begins, not here."""
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
        return normalizers.Sequence(steps)

    def tokenizer(self) -> Tokenizer:
        """Encodes text that is already normalised and carries its prefix; blanks become markers."""
        if self.digest in _TOKENIZERS:
            return _TOKENIZERS[self.digest]
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if self.unigram:
            # pieces that text must not match keep their id under a name that no text has
            vocab = [(p if kind in (NORMAL, UNKNOWN, BYTE) else f"\0{i}", score) for i, (p, score, kind) in enumerate(self.pieces)]
            model = models.Unigram(vocab, unk_id=unk, byte_fallback=self.byte_fallback)
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        tok = Tokenizer(model)
        tok.normalizer = normalizers.Replace(" ", MARK)
        tok.decoder = self.decoder()
        _TOKENIZERS[self.digest] = tok
        return tok

    def decoder(self) -> decoders.Decoder:
        return decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
                                  *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])

    def marked(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and bounds of the normalised texts, each that is not empty with its dummy prefix."""
        data, bounds = text_bytes(column)
        raw = data.tobytes()
        texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        if self.charsmap or self.squeeze:
            norm = self.normalizer()
            texts = [norm.normalize_str(t.decode()).encode() for t in texts]
        texts = [b" " + t if t and self.dummy_prefix else t for t in texts]
        joined = np.frombuffer(b"".join(texts), np.uint8)
        return joined, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))

    def encode(self, column: pa.Array, words: WordTable | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and their bounds."""
        data, bounds = self.marked(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        words = words or WordTable()
        start, end = _segments(data, bounds) if self.by_words() else (bounds[:-1], bounds[1:])
        start, end = start[held := end > start], end[held]
        parts, sizes = [], []
        for i, j in slices(end - start, CHUNK_BYTES):  # of whole words (or texts)
            a = int(start[i])
            got, size = self._encoded(data[a:int(end[j - 1])], start[i:j] - a, end[i:j] - a, words)
            parts.append(got)
            sizes.append(size)
        total = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        return np.concatenate(parts), total[np.searchsorted(start, bounds)]

    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans of ``data`` end to end, and how many each has."""
        hashes, first, word = np.unique(span_hashes(prefix_sums(data), start, end), return_index=True, return_inverse=True)
        if len(words.place) + len(hashes) > words.limit:
            words.clear()
        place = words.find(hashes)
        new = np.flatnonzero(place < 0)
        for k in range(0, len(new), BATCH):  # an encoding takes far more memory than its ids
            some = new[k:k + BATCH]
            raw = data.tobytes() if not k else raw
            texts = [raw[a:b].decode() for a, b in zip(start[first[some]].tolist(), end[first[some]].tolist(), strict=True)]
            got = [e.ids for e in self.tokenizer().encode_batch_fast(texts, add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            place[some] = len(words.place) + np.arange(len(some))
            words.add(hashes[some], np.fromiter((i for g in got for i in g), np.int32, int(size.sum())), size)
        at = place[word]
        return _gather(words.ids, words.start, words.size, at), words.size[at].astype(np.int64)

    @cached_property
    def surfaces(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of every id's text end to end, and their bounds."""
        def text(piece: str, kind: int) -> bytes:
            if kind == BYTE:
                return bytes([int(piece[3:5], 16)])
            return {CONTROL: "", UNKNOWN: self.unk_surface}.get(kind, piece.replace(MARK, " ")).encode()

        parts = [text(p, kind) for p, _, kind in self.pieces]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of ids end to end; malformed bytes become U+FFFD."""
        return [t.decode("utf-8", "replace") for t in self.decoded_bytes(ids, bounds)]

    def decoded_bytes(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        data, at = self.surfaces
        size = np.diff(at)
        raw = b"".join(_gather(data, at[:-1], size, ids[k:k + CHUNK_BYTES]).tobytes() for k in range(0, len(ids), CHUNK_BYTES))
        ends = np.concatenate(([0], np.cumsum(size[ids])))[bounds].tolist()
        texts = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [t[1:] if self.dummy_prefix and t[:1] == b" " else t for t in texts]

    def _run(self, docs: DataFrame, text: str, fields: list[StructField], make, drop: tuple[str, ...]) -> DataFrame:
        """Other columns of ``docs`` (but ``drop``), then what ``make(texts, ids, bounds)`` gives for every chunk."""
        names = [f.name for f in fields]
        rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in (*names, *drop)]).alias("row"),
                           F.col(f"`{text}`").alias("text"))
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = WordTable()
            for part in chunks(batches, "text"):
                ids, bounds = model.encode(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([part.column("row"), *make(part.column("text"), ids, bounds)], names=["row", *names])

        out = rows.mapInArrow(run, StructType([rows.schema["row"], *fields]))
        kept = [F.col(f"row.`{c}`") for c in rows.schema["row"].dataType.names[1:]]
        return out.select(*kept, *names)

    def encode_column(self, docs: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        """``docs`` with the ids of its texts as an int array column."""
        return self._run(docs, text, [StructField(out, _IDS)], lambda texts, ids, bounds: [_lists(ids, bounds)], ())

    def decode_column(self, ids: Column) -> Column:
        """Texts of an int array column."""
        model = self

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                texts, sizes = [], np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
                for a, b in slices(sizes, 1 << 19) if len(column) else ():
                    flat = np.array(pc.list_flatten(column.slice(a, b - a)), np.int64)
                    texts += model.decode(flat, np.concatenate(([0], np.cumsum(sizes[a:b]))))
                yield pa.array(texts, pa.string())

        return F.arrow_udf(run, "string")(ids)


def _segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of blanks with the word after them; they cover every text."""
    blank = data == 32
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = blank[1:] & ~blank[:-1]
    edge[bounds] = True
    at = np.flatnonzero(edge)
    return at[:-1], at[1:]


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The runs ``values[start[r]:start[r] + size[r]]`` for all rows, end to end."""
    n = size[rows]
    return values[np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


_IDS = ArrayType(IntegerType())


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))


def coded(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """``docs`` with ids, n_tokens, the decoded text ``decoded`` and whether it is the text itself (``lossless``)."""
    out = model.encode_column(docs, text).withColumn("n_tokens", F.size("ids")).withColumn("decoded", model.decode_column(F.col("ids")))
    return out.withColumn("lossless", F.col("decoded") == F.coalesce(F.col(text), F.lit("")))


def checked(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ids, n_tokens, the digest of what they decode to (``decoded_sha256``) and whether that is the text (``lossless``)."""
    def make(texts: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        data, at = text_bytes(texts)
        raw, back = data.tobytes(), model.decoded_bytes(ids, bounds)
        same = [raw[a:b] == t for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), back, strict=True)]
        back = [t if ok else t.decode("utf-8", "replace").encode() for t, ok in zip(back, same, strict=True)]
        return [_lists(ids, bounds), pa.array(np.diff(bounds).astype(np.int32)), pa.array([sha256(t).hexdigest() for t in back], pa.string()), pa.array(same, pa.bool_())]

    fields = [StructField("ids", _IDS), StructField("n_tokens", IntegerType()), StructField("decoded_sha256", StringType()), StructField("lossless", BooleanType())]
    return model._run(docs, text, fields, make, (text,))


@query("op1_sentence_pieces")
def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    rows = checked(table(spark, sf_dir, "documents").select("doc_id", "text"), PieceModel.load())
    return rows.select("doc_id", "ids", "n_tokens", "decoded_sha256", "lossless")
