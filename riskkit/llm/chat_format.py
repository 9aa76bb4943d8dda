"""Chat formatting by token-level assembly.

Each turn's role and text are encoded separately as ordinary text; the marks of
the template are reserved ids beyond the vocabulary that are spliced between
the segments, so no content can produce them.  Control strings that occur in
content are escaped first (and a backslash with them), reversibly, so the
rendered text cannot be mistaken for a template mark either.  The loss mask
comes from prefix sums: +1 where an assistant's text begins, -1 where it ends.

A conversation's turns are one output row, so they meet in one task; encoding,
the costly part, is done before that, turn by turn wherever the rows lie.

Defined results: turns go by ``turn`` (null first), then role, then text; a
null role or text counts as empty; rows with a null ``conv_id`` form one
conversation; repeated rows are repeated turns; an empty table gives no rows;
other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .buffers import chunks
from .catalog import query, table

CHUNK = 1 << 18  # bytes of text encoded at once
ROWS = 256  # conversations assembled at once
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class ChatTemplate:
    """Turn layout ``START role SEP text END``; ``control`` are the strings escaped inside content."""

    vocabulary: str = VOCABULARY
    control: tuple[str, ...] = CONTROL
    learned_role: str = "assistant"

    def vocabulary_text(self) -> str:
        """The vocabulary file as text: read where the job is planned, and sent along with the function."""
        with open(self.vocabulary, encoding="utf-8") as f:
            return f.read()

    def tokenizer(self, text: str | None = None) -> Tokenizer:
        tok = Tokenizer.from_str(text or self.vocabulary_text())
        tok.encode_special_tokens = True
        return tok

    def reserved(self, tok: Tokenizer) -> tuple[int, int, int]:
        """Ids of START, SEP and END: the first free ones after the vocabulary."""
        n = max(tok.get_vocab(with_added_tokens=True).values()) + 1
        return n, n + 1, n + 2

    def escape(self, text: str) -> str:
        r"""``\`` becomes ``\\``; a control string gets ``\-`` after its first character."""
        found = "|".join(map(re.escape, sorted(self.control, key=len, reverse=True)))
        return re.sub(rf"\\|{found}", lambda m: r"\\" if m[0] == "\\" else rf"{m[0][0]}\-{m[0][1:]}", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\([\\-])", lambda m: "\\" if m[1] == "\\" else "", text)

    def render(self, turns: Sequence[tuple[str, str]]) -> str:
        return "".join(f"{START}{self.escape(r)}{SEP}{self.escape(t)}{END}\n" for r, t in turns)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as one Arrow list array."""
    bounds = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, kind.value_type.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, kind.value_type))


def encode_turns(rows: DataFrame, template: ChatTemplate) -> DataFrame:
    """Add ``role_ids`` and ``text_ids`` to rows of conv_id, turn, role, text, in place, without a shuffle."""
    ints, vocabulary = pa.list_(pa.int32()), template.vocabulary_text()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = template.tokenizer(vocabulary)
        for part in chunks(batches, "text", CHUNK):  # encodings are held for one chunk at a time
            ids = [[np.array(e.ids, np.int32) for e in tok.encode_batch_fast([template.escape(x) for x in part.column(c).to_pylist()], add_special_tokens=False)]
                   for c in ("role", "text")]
            yield pa.RecordBatch.from_arrays([*part.columns, *[_lists(x, ints) for x in ids]], names=[*part.schema.names, "role_ids", "text_ids"])

    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.mapInArrow(run, "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>")


def _inner(column: pa.Array, i: int) -> list[np.ndarray]:
    """Row ``i`` of a list<list<int>> column."""
    part = column.values.slice(column.offsets[i].as_py(), column.offsets[i + 1].as_py() - column.offsets[i].as_py())
    flat = np.array(part.flatten(), np.int32)
    bounds = np.array(part.offsets, np.int64)
    return [flat[a:b] for a, b in zip((bounds[:-1] - bounds[0]).tolist(), (bounds[1:] - bounds[0]).tolist(), strict=True)]


def format_chats(rows: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: ``conv_id``, ``ids``, ``loss_mask`` (0/1 per id) and the rendered ``text``."""
    template = template or ChatTemplate()
    turns = (encode_turns(rows, template).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "role_ids", "text_ids"))).alias("turns")))
    flat = turns.select("conv_id", *[F.col(f"turns.{c}").alias(c) for c in ("role", "text", "role_ids", "text_ids")])

    marks = template.reserved(template.tokenizer())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, sep, end = ([np.array([m], np.int32)] for m in marks)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                all_ids, masks, texts = [], [], []
                for i, (roles, said) in enumerate(zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)):
                    parts, edges, at = [], [], 0
                    for role, role_ids, text_ids in zip(roles, _inner(part.column("role_ids"), i), _inner(part.column("text_ids"), i), strict=True):
                        parts += [*start, role_ids, *sep, text_ids, *end]
                        begin = at + len(role_ids) + 2
                        if role == template.learned_role:
                            edges.append((begin, begin + len(text_ids)))
                        at = begin + len(text_ids) + 1
                    steps = np.zeros(at + 1, np.int8)
                    for a, b in edges:
                        steps[a] += 1
                        steps[b] -= 1
                    all_ids.append(np.concatenate(parts))
                    masks.append(np.cumsum(steps[:-1], dtype=np.int8))
                    texts.append(template.render(list(zip(roles, said, strict=True))))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), _lists(all_ids, pa.list_(pa.int32())), _lists(masks, pa.list_(pa.int8())),
                                                  pa.array(texts, pa.string())], names=["conv_id", "ids", "loss_mask", "text"])

    return flat.mapInArrow(run, "conv_id long, ids array<int>, loss_mask array<byte>, text string")


def parse_ids(ids: np.ndarray, tok: Tokenizer, marks: tuple[int, int, int]) -> list[tuple[str, str]]:
    """Turns (role, text) read back from assembled ids."""
    start, sep, end = marks
    text = lambda part: ChatTemplate.unescape(tok.decode(part.tolist(), skip_special_tokens=False)) if len(part) else ""
    at = [np.flatnonzero(ids == m) for m in (start, sep, end)]
    return [(text(ids[a + 1:b]), text(ids[b + 1:c])) for a, b, c in zip(*at, strict=True)]


def masked_texts(ids: np.ndarray, mask: np.ndarray, tok: Tokenizer) -> list[str]:
    """The unescaped texts of the runs of ids under the mask."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
    return [ChatTemplate.unescape(tok.decode(ids[a:b].tolist(), skip_special_tokens=False))
            for a, b in zip(edges[::2], edges[1::2], strict=True)]


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Turns, loss text and length digests of ``format_chats``'s rows, taken from the ids, mask and text."""
    template = template or ChatTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = template.tokenizer()
        marks = template.reserved(tok)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            out = []
            for conv, ids, mask, text in zip(*[batch.column(c) for c in ("conv_id", "ids", "loss_mask", "text")], strict=True):
                ids, mask = (x.values.to_numpy(zero_copy_only=False) for x in (ids, mask))
                turns = parse_ids(ids, tok, marks)
                loss = "".join(masked_texts(ids, mask, tok))
                out.append({"conv_id": conv.as_py(), "n_turns": len(turns),
                            "turns_sha256": digest("".join(f"{r}\n{t}\n" for r, t in turns)),
                            "loss_chars": len(loss), "loss_sha256": digest(loss),
                            "formatted_chars": len(text.as_py()), "n_ids": len(ids)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("n_ids", pa.int64())])
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long, n_ids long")


PROBE = "</s>[INST] ok [/INST]"
_CONTROL_RE = "|".join(map(re.escape, CONTROL))
_LENGTH = r"(length({0}) + length({0}) - length(replace({0}, '\\', '')) + 2 * len(regexp_extract_all({0}, '" + _CONTROL_RE.replace("{", "{{") + r"')))"
_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum({len(START + SEP + END) + 1} + {_LENGTH.format("role")} + {_LENGTH.format("text")}) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


@query("op10_chat_format", _SQL)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 of control strings, formatted and read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(probe))).drop("n_ids")
