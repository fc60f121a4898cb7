"""Chat formatting with a loss mask aligned to token offsets.

Turns of a conversation are rendered between marks; control characters inside roles and
texts are escaped reversibly, so that no text can hold a mark. Each conversation is encoded
once, and the sorted spans of assistant texts are met with the token spans by binary search.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import mapped, shared_dir

# Template: <turn role="...">\n text \n</turn>\n. In roles and texts these are replaced:
ESCAPES = {"\\": "\\\\", "<": "\\l", '"': "\\q"}
_PLAIN = {"\\": "\\", "l": "<", "q": '"'}
_TURN = re.compile(r'<turn role="([^"<]*)">\n([^<]*)\n</turn>\n')


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace('"', "\\q")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\lq])", lambda m: _PLAIN[m[1]], text)


def render(turns: list[tuple[str, str]], target: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans in it of the escaped texts whose role is the target."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f'<turn role="{escape(role)}">\n', escape(text)
        parts += [head, body, "\n</turn>\n"]
        at += len(head)
        if role == target:
            spans.append((at, at + len(body)))
        at += len(body) + len("\n</turn>\n")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; anything else is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def token_bounds(ends: np.ndarray, size: int) -> np.ndarray:
    """Token spans as bounds that cover all characters once: token i has [bounds[i], bounds[i + 1])."""
    bounds = np.append(0, np.maximum.accumulate(ends)) if len(ends) else np.zeros(1, np.int64)
    if len(ends):
        bounds[-1] = size
    return bounds


def mask(bounds: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens overlap a span, and the parts of spans that those tokens cover, joined where they touch inside a span."""
    hit, out = np.zeros(len(bounds) - 1, bool), []
    for a, b in spans:
        if a == b:
            continue
        low = int(np.searchsorted(bounds, a, "right")) - 1
        high = int(np.searchsorted(bounds, b, "left"))
        hit[low:high] = True
        out.append((max(a, int(bounds[low])), min(b, int(bounds[high]))))
    return hit, out


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FORMATTED = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("loss_tokens", T.ArrayType(T.BooleanType())), T.StructField("loss_spans", SPANS),
])


def format_conversations(df: DataFrame, tokenizer_path: str, *, target: str = "assistant") -> DataFrame:
    """One row for each conv_id: the rendered conversation, its ids, a mask of tokens and the spans under the loss.

    df has conv_id, turn, role and text; other columns are not read. Rows of a conversation
    are in order of turn (nulls first), ties by role and text; repeated rows are turns of
    their own. Null roles and texts are empty. Null conv_ids are one conversation. A token
    that lies over a span's edge is masked, with only its part inside the span.
    Conversations are dealt out by id and read in order as a stream: a task holds one at a time.
    """
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer_path)

        def finish(conversations):
            texts, spans = zip(*[render(turns, target) for _, turns in conversations])
            cols = [[c for c, _ in conversations], list(texts), [], [], []]
            for text, own, e in zip(texts, spans, encoder.encode_batch(list(texts), add_special_tokens=False)):
                hit, under = mask(token_bounds(np.array([b for _, b in e.offsets], np.int64), len(text)), own)
                cols[2].append(e.ids)
                cols[3].append(hit)
                cols[4].append([{"start": a, "end": b} for a, b in under])
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), _ARROW_SPANS]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=FORMATTED.names)

        ready, size, current, turns = [], 0, None, None
        for batch in batches:
            for conv, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if turns is None or conv != current:
                    if turns is not None:
                        ready.append((current, turns))
                    if size > 1 << 20:
                        yield finish(ready)
                        ready, size = [], 0
                    current, turns = conv, []
                turns.append((role, text))
                size += len(text)
        if turns is not None:
            yield finish([*ready, (current, turns)])

    return mapped(rows, run, FORMATTED)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what a table of formatted conversations holds, from its texts and spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids, hit = batch.column(2), batch.column(3)
            n_ids, n_hit = (np.asarray(pa.compute.fill_null(pa.compute.list_value_length(c), 0)) for c in (ids, hit))
            under = np.append(0, np.cumsum(np.asarray(hit.flatten().cast(pa.int8()), np.int64)))
            ends = np.cumsum(n_hit)
            n_loss = under[ends] - under[ends - n_hit]
            for conv, text, spans, n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), n_ids.tolist(), n_loss.tolist()):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), n, m))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names=[x.split()[0] for x in READ_BACK.split(", ")])

    return mapped(formatted.select(*FORMATTED.names), run, READ_BACK)


def write_formatted(df: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Formats conversations, writes them as Parquet (to a new shared folder without a path) and gives the table read from there."""
    path = path or shared_dir(df.sparkSession, "chat")
    format_conversations(df, tokenizer_path).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(FORMATTED).parquet(path)
