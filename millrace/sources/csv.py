"""Delimited text: detection of delimiter and header, ragged rows, and writing."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import is_numeric, str2num
from millrace.sources.shared import stored

DELIMITERS = ",\t;|"
#: What is trimmed from fields without quotes: control characters and the space.
CONTROL = "".join(map(chr, range(33)))
#: Bytes that are parsed at once; the longest record that is read (one stray quote makes a record of the rest of a file).
PIECE, MOST = 1 << 20, 64 << 20
#: Rows that may rule kinds of columns out before all rows are counted.
SAMPLE = 1000
#: Splits of files that one read takes at most.
SPLITS = 1_000_000


def split_rows(text: str, delimiter: str = ",", keep_blank: bool = False) -> Iterator[list[str]]:
    """Fields of each row. LF, CRLF and lone CR end a row; unquoted fields are trimmed of control characters and
    spaces, quoted ones are not; a doubled quote is one; a quote inside quotes that nothing follows is literal."""
    row, field, i, n, quoted, was_quoted = [], [], 0, len(text), False, False

    def close() -> None:
        nonlocal field, was_quoted
        value = "".join(field)
        row.append(value if was_quoted else value.strip(CONTROL))
        field, was_quoted = [], False

    def done() -> list[str] | None:
        nonlocal row
        close()
        out, row = row, []
        return out if keep_blank or any(x.strip(CONTROL) for x in out) else None

    while i < n:
        c = text[i]
        if quoted:
            after = text[i + 1] if i + 1 < n else ""
            if c == '"' and after == '"':
                field.append('"')
                i += 1
            elif c == '"' and after in ("", delimiter, "\n", "\r"):
                quoted = False
            else:
                field.append(c)
        elif c == '"' and not "".join(field).strip(CONTROL):
            field, quoted, was_quoted = [], True, True
        elif c == delimiter:
            close()
        elif c in "\r\n":
            if c == "\r" and i + 1 < n and text[i + 1] == "\n":
                i += 1
            if (out := done()) is not None:
                yield out
        else:
            field.append(c)
        i += 1
    if (row or field or was_quoted) and (out := done()) is not None:
        yield out


def detect_delimiter(sample: str, rows: int = 100) -> str:
    """The delimiter whose rows agree best on a width: fewest widths, then the most rows of the commonest, then the most hits."""
    best = None
    for rank, d in enumerate(DELIMITERS):
        widths = Counter()
        for k, row in enumerate(split_rows(sample, d)):
            if k == rows:
                break
            widths[len(row)] += 1
        hits = sum((w - 1) * n for w, n in widths.items())
        if hits:
            key = (len(widths), -max(widths.values()), -hits, rank)
            best = min(best, (key, d)) if best else (key, d)
    return best[1] if best else ","


def sample_of(spark: SparkSession, path: str, rows: int = 100) -> str:
    """The first lines of a file or folder: a bounded read, for planning."""
    lines = [bytes(r[0]) for r in spark.read.text(path).select(F.col("value").cast("binary")).limit(rows).collect()]
    return _decoded(b"\n".join(lines), not _is_utf8(b"\n".join(lines)))


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _decoded(data: bytes, latin: bool) -> str:
    """Text of UTF-8 bytes, or of bytes of a file that isn't: Windows-1252, or Latin-1 where that has no such character."""
    if not latin:
        return data.decode("utf-8", "replace").removeprefix("\ufeff")
    try:
        return data.decode("cp1252")
    except UnicodeDecodeError:
        return data.decode("latin-1")


# The automaton of quotes. Symbols of bytes: a quote has three, by what follows it.
_OTHER, _BLANK, _DELIMITER, _LINE, _PAIR, _LAST, _INNER = range(7)
# States before a byte: nothing but blanks in the field, something, inside quotes, at the second of two quotes, after the closing quote.
EDGE, PLAIN, QUOTED, SECOND, CLOSED = range(5)
_CHUNK = 128


def _steps() -> np.ndarray:
    """[symbol, state] -> the next state."""
    out = np.empty((7, 5), np.uint8)
    for symbol in range(7):
        ends, quote = symbol in (_DELIMITER, _LINE), symbol >= _PAIR
        out[symbol] = [
            EDGE if ends or symbol == _BLANK else QUOTED if quote else PLAIN,
            EDGE if ends else PLAIN,
            SECOND if symbol == _PAIR else CLOSED if symbol == _LAST else QUOTED,
            QUOTED,
            EDGE if ends else CLOSED,
        ]
    return out


_STEPS = _steps()


def symbols(data: np.ndarray, delimiter: str) -> np.ndarray:
    """The symbol of each byte of lines that each end in a line feed."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[:33], kind[10], kind[ord(delimiter)], kind[34] = _BLANK, _LINE, _DELIMITER, _INNER
    out = kind[data]
    at = np.flatnonzero(data == 34)
    if len(at):
        after = out[np.minimum(at + 1, len(data) - 1)]
        out[at] = np.where(after >= _PAIR, _PAIR, np.where((after == _DELIMITER) | (after == _LINE), _LAST, _INNER))
        out[at[at == len(data) - 1]] = _LAST
    return out


def states(sym: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """The state before each byte, and the one after all: the functions of chunks are found side by side, composed, and replayed."""
    n = len(sym)
    rows = -(-n // _CHUNK)
    grid = np.full(rows * _CHUNK, _OTHER, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, _CHUNK).T)
    flat, reach = _STEPS.ravel(), np.tile(np.arange(5, dtype=np.uint8), (rows, 1))
    for k in range(_CHUNK):
        reach = flat[(grid[k] * np.uint8(5))[:, None] + reach]
    step = 1
    while step < rows:
        reach = np.concatenate([reach[:step], np.take_along_axis(reach[step:], reach[:-step].astype(np.intp), 1)])
        step *= 2
    now = np.append(np.uint8(start), reach[:-1, start])
    out = np.empty((_CHUNK, rows), np.uint8)
    for k in range(_CHUNK):
        out[k] = now
        now = flat[grid[k] * np.uint8(5) + now]
    out = out.T.ravel()[:n]
    return out, int(_STEPS[sym[-1], out[-1]]) if n else start


def parsed(data: bytes, delimiter: str) -> tuple[pa.ListArray, np.ndarray, int]:
    """Fields of the records that end in some lines (UTF-8, a line feed after each), the number of the line that each starts with, and
    how many bytes they take; blank rows are left out. What follows is a record that goes on."""
    raw = np.frombuffer(data, np.uint8)
    sym = symbols(raw, delimiter)
    if (sym >= _PAIR).any():
        state, _ = states(sym, EDGE)
        outside = (state != QUOTED) & (state != SECOND)
    else:
        state, outside = None, np.ones(len(raw), bool)
    ends = np.flatnonzero(outside & (sym == _LINE))
    if not len(ends):
        return pa.array([], pa.list_(pa.string())), np.empty(0, np.int64), 0
    size = int(ends[-1]) + 1
    raw, sym, outside = raw[:size], sym[:size], outside[:size]
    cut = np.flatnonzero(outside & ((sym == _DELIMITER) | (sym == _LINE)))  # where fields end
    low, high = np.append(0, cut[:-1] + 1), cut
    solid = np.flatnonzero(raw > 32)
    # Fields without quotes are trimmed to their first and last solid byte; a quote opens a field at its first one.
    first, last = np.searchsorted(solid, low), np.searchsorted(solid, high)
    full = last > first
    start = np.where(full, solid[np.minimum(first, max(0, len(solid) - 1))] if len(solid) else low, low)
    stop = np.where(full, solid[np.maximum(last - 1, 0)] + 1 if len(solid) else low, low)
    keep = np.zeros(size + 1, np.int8)
    if state is not None:
        quoted = full & (raw[np.minimum(start, size - 1)] == 34)
        start = np.where(quoted, start + 1, start)
        stop = np.where(quoted, np.where(state[:size][np.minimum(high, size - 1)] == CLOSED, high - 1, high), stop)
    keep[start] += 1  # no two fields start or stop at one place
    keep[stop] -= 1
    inside = np.cumsum(keep[:-1], dtype=np.int8) > 0
    if state is not None:
        inside &= state[:size] != SECOND
    kept = np.append(0, np.cumsum(inside))
    sizes = kept[stop] - kept[start]
    text = raw[inside]
    values = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(text.tobytes()))
    some = np.append(0, np.cumsum(inside & (raw > 32)))
    field_end = np.searchsorted(cut, ends, "right")
    rows = pa.ListArray.from_arrays(pa.array(np.append(0, field_end), pa.int32()), values)
    begin = np.append(0, ends[:-1] + 1)
    line = np.append(0, np.cumsum(sym == _LINE))[begin]
    good = some[ends] > some[begin]
    return rows.filter(pa.array(good)), line[good], size


def quote_effect(data: bytes, delimiter: str) -> tuple[bool, bool]:
    """Whether a quote is open after some lines, if none was open before them and if one was."""
    if b'"' not in data:
        return False, True
    sym = symbols(np.frombuffer(data, np.uint8), delimiter)
    return tuple(states(sym, start)[1] in (QUOTED, SECOND) for start in (EDGE, QUOTED))


def _cuts(lines: pa.Array) -> Iterator[pa.Array]:
    """Slices of lines of about PIECE bytes, or one line."""
    ends = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, "right")))
        yield lines.slice(low, high - low)
        low = high


def _joined(lines: pa.Array) -> bytes:
    """Lines with a line feed after each."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
    return pc.binary_join(whole, b"\n")[0].as_py() + b"\n"


def _plain(lines: pa.Array, delimiter: str) -> tuple[pa.ListArray, np.ndarray]:
    """What parsed() makes of lines (UTF-8) without a quote: each is a record."""
    rows = pc.split_pattern(lines.cast(pa.string()), delimiter)
    values, offsets = pc.utf8_trim(rows.flatten(), characters=CONTROL), rows.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    some = np.append(0, np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False) > 0))
    good = some[offsets[1:]] > some[offsets[:-1]]
    rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    return rows if good.all() else rows.filter(pa.array(good)), np.flatnonzero(good)


def _runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of a batch in which the first columns are equal."""
    codes = np.stack([np.asarray(c.dictionary_encode().indices) for c in batch.columns[:keys]], 1)
    starts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(1)) + 1).tolist(), len(codes)]
    for a, b in zip(starts, starts[1:]):
        yield tuple(c[a].as_py() for c in batch.columns[:keys]), batch.slice(a, b - a)


def read_ragged(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """(path, rid, fields) with rows as they are, rid ascending inside a file; rows without content are left out.

    Files are split over tasks. A quote may hold line ends (read as LF), also over the bounds
    of splits: each split's effect on the quote state is found first, the effects are composed
    in the order of a file's splits, and then every split knows whether it starts inside a
    quote. What a record has in other splits is gathered by record, MOST bytes of it at most
    (else the job fails and says so). A file with a line that is not UTF-8 is read as
    Windows-1252.
    """
    d = delimiter or detect_delimiter(sample_of(spark, path))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            for key, part in _runs(batch, 2) if batch.num_rows else ():
                now = found.setdefault(key, [False, True, False])  # from closed, from open, whether a line is not UTF-8
                for data in map(_joined, _cuts(part.column(2))):
                    effect = quote_effect(data, d)
                    now[:2] = [effect[now[0]], effect[now[1]]]
                    now[2] = now[2] or not _is_utf8(data)
        rows = [(*key, *now) for key, now in found.items()]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["path", "block", "closed", "opened", "latin"])

    found = lines.mapInArrow(effects, "path string, block long, closed boolean, opened boolean, latin boolean")
    per = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "closed", "opened"))).alias("b"), F.max("latin").alias("latin"))  # a row for each split
    after = F.aggregate("b", F.array(F.lit(False)), lambda acc, x: F.concat(acc, F.array(F.when(F.element_at(acc, -1), x["opened"]).otherwise(x["closed"]))))
    starts = stored(per.select("path", "latin", after.alias("s"), F.posexplode("b").alias("k", "x")).select("path", F.col("x.block").alias("block"), "latin", F.get("s", "k").alias("inside")), "splits")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, none = ["path", "rid", "block", "fields", "fragment"], pa.list_(pa.string())

        def fragment(key, rid, text):
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([rid], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([None], none), pa.array([text])], names=names)

        key, held, count, before = None, b"", 0, False  # held: bytes of a record that goes on, which starts with line `count`

        def left():
            if held:
                yield fragment(key, None if before else key[1] + count, held[:-1].decode())

        for batch in batches:
            for (name, block, latin, inside), part in _runs(batch, 4) if batch.num_rows else ():
                if key != (name, block):
                    yield from left()
                    key, held, count, before = (name, block), b"", 0, inside
                for piece in _cuts(part.column(4)):
                    data = _joined(piece)
                    if not (latin or held or before or b'"' in data or count == 0):
                        rows, line = _plain(piece, d)
                        if len(line):
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(line)), pa.array(block + count + line), pa.array(np.full(len(line), block)), rows, pa.nulls(len(line), pa.string())], names=names)
                        count += len(piece)
                        continue
                    if latin:
                        data = _decoded(data, True).encode()
                    elif count == 0 and not held and data.startswith(b"\xef\xbb\xbf"):
                        data = data[3:]
                    held += data
                    if before:  # the end of a record that began in a split before this one
                        state = states(symbols(np.frombuffer(held, np.uint8), d), QUOTED)[0]
                        end = np.flatnonzero((np.frombuffer(held, np.uint8) == 10) & (state != QUOTED) & (state != SECOND))
                        if not len(end):
                            if len(held) > MOST:
                                raise ValueError(f"{name}: a quote is open for more than {MOST} bytes")
                            continue
                        size = int(end[0]) + 1
                        yield fragment(key, None, held[: size - 1].decode())
                        count, held, before = held[:size].count(b"\n"), held[size:], False
                    rows, line, size = parsed(held, d) if held else (None, (), 0)
                    if len(line):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(line)), pa.array(block + count + line), pa.array(np.full(len(line), block)), rows, pa.nulls(len(line), pa.string())], names=names)
                    if size:
                        count, held = count + held[:size].count(b"\n"), held[size:]
                    if len(held) > MOST:
                        raise ValueError(f"{name}: a quote is open for more than {MOST} bytes")
        yield from left()

    # The lines have to stay in their order, so that the splits' table, a narrow row for each, is sent to all tasks.
    if starts.count() > SPLITS:
        raise ValueError(f"more than {SPLITS} splits of files; read fewer files at once")
    rows = lines.join(F.broadcast(starts), ["path", "block"]).select("path", "block", "latin", "inside", "line")
    rows = rows.mapInArrow(records, "path string, rid long, block long, fields array<string>, fragment string")
    cut = rows.where("fragment IS NOT NULL").withColumn("rid", F.last("rid", True).over(Window.partitionBy("path").orderBy("block", F.col("rid").isNotNull())))  # two rows for each split at most
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.length(x["fragment"]))
    joined = cut.groupBy("path", "rid").agg(F.array_sort(F.collect_list(F.struct("block", "fragment"))).alias("parts"))
    joined = joined.select("path", "rid", F.when(size > MOST, F.raise_error(F.lit(f"a quote is open for more than {MOST} bytes")).cast("string")).otherwise(F.array_join(F.transform("parts", lambda x: x["fragment"]), "\n")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(name, rid, row) for name, rid, text in zip(*[c.to_pylist() for c in batch.columns]) for row in split_rows(text, d)]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, kinds)], names=["path", "rid", "fields"])

    return rows.where("fragment IS NULL").select("path", "rid", "fields").unionByName(joined.mapInArrow(whole, "path string, rid long, fields array<string>"))


def rectangular(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Rows padded with empty fields to the widest."""
    widest = F.broadcast(df.agg(F.max(F.size(fields)).alias("__w")))
    return df.crossJoin(widest).withColumn(fields, F.concat(fields, F.array_repeat(F.lit(""), F.col("__w") - F.size(fields)))).drop("__w")


def arity(df: DataFrame, fields: str = "fields") -> DataFrame:
    """(width, n) of rows."""
    return df.groupBy(F.size(fields).alias("width")).agg(F.count(F.lit(1)).alias("n"))


def header_of(rows: list[list[str]], numeric) -> list[str] | None:
    """The first row as names if none of its cells is a number and one of the second row's is; blanks become colN."""
    if len(rows) < 2 or any(numeric(x) for x in rows[0]) or not any(numeric(x) for x in rows[1]):
        return None
    return names(rows[0])


def names(header: list[str]) -> list[str]:
    """Blank names become colN by position from 1; repeated ones get _2, _3, as Spark can't tell them apart."""
    out: list[str] = []
    for k, h in enumerate(header, 1):
        base, n = h.strip() or f"col{k}", 2
        name = base
        while name.lower() in {x.lower() for x in out}:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def _is_number(x: str) -> bool:
    s = x.strip().replace("$", "").replace(",", "").removesuffix("%")
    try:
        return bool(s) and all(c in "0123456789+-.eE" for c in s) and float(s) == float(s)
    except ValueError:
        return False


def width_of(spark: SparkSession, path: str, delimiter: str) -> int:
    """The widest row's fields: by counting delimiters where no line has a quote, else of the parsed rows."""
    value = F.col("value")
    full = value.rlike("[^\\x00-\\x20" + ("\\" + delimiter) + "]")
    fields = F.length(value) - F.length(F.replace(value, F.lit(delimiter), F.lit(""))) + 1
    quotes, widest = spark.read.text(path).agg(F.max(value.contains('"')), F.max(F.when(full, fields))).first()
    return (read_ragged(spark, path, delimiter).agg(F.max(F.size("fields"))).first()[0] if quotes else widest) or 1


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], int | None]:
    """path, rid and fields of the rows after the header, the columns' names (colN without a header) and the header's width (None without one)."""
    sample = sample_of(spark, path)
    d = detect_delimiter(sample)
    head = header_of(list(split_rows(sample, d))[:2], _is_number)
    width = width_of(spark, path, d)
    rows = read_ragged(spark, path, d)
    if head is not None:
        first = F.broadcast(rows.groupBy("path").agg(F.min("rid").alias("rid")))  # a row for each file
        rows = rows.join(first, ["path", "rid"], "left_anti")
    titles = [*(head or []), *[f"col{k + 1}" for k in range(len(head or []), width)]][:width] if head else [f"col{k + 1}" for k in range(width)]
    return rows, titles, None if head is None else len(head)


def read_smart(spark: SparkSession, path: str, kind: str = "double", row_id: tuple[str, str] | None = None) -> DataFrame:
    """A table of numbers: delimiter and header detected from the first lines, the width from all, cells read leniently, bad ones NaN (DOUBLE) or NULL.

    row_id: names of columns for the file and for the row's place in it, which ascends with the rows. Rows without content are left out.
    """
    rows, titles, _ = read_cells(spark, path)
    plain = r"^-?\d{1,15}(\.\d{1,15})?([eE][+-]?\d{1,2})?$"  # most cells; the lenient way takes some patterns more
    cell = lambda c: F.when(c.rlike(plain), c.cast("double")).otherwise(F.coalesce(str2num(c, "double"), F.lit(float("nan")))) if kind == "double" else str2num(c, kind)
    keep = [F.col("path").alias(row_id[0]), F.col("rid").alias(row_id[1])] if row_id else []
    return rows.select(*keep, *[cell(F.get("fields", F.lit(k))).alias(t) for k, t in enumerate(titles)])


def camel_case(name: str) -> str:
    """`Order date (UTC)` as orderDateUtc."""
    words = re.findall(r"[^\W_]+", name)
    return "".join(w.lower() if k == 0 else w[:1].upper() + w[1:].lower() for k, w in enumerate(words)) or name


def typed(df: DataFrame, columns: list[str], percent: float = 100.0) -> DataFrame:
    """df with columns of text cast to what infer_types() says of them; cells that don't fit are NULL."""
    kinds = {r["column"]: r["kind"] for r in infer_types(df, columns, percent).collect()}  # a row for each column
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    cast = {
        "boolean": lambda c: F.when(cell(c).rlike("(?i)^(true|yes|1)$"), True).when(cell(c).rlike("(?i)^(false|no|0)$"), False), "int": lambda c: cell(c).try_cast("int"), "long": lambda c: cell(c).try_cast("long"),
        "decimal": lambda c: str2num(cell(c), "double"), "timestamp": lambda c: cell(c).try_cast("timestamp_ntz"), "string": lambda c: F.when(cell(c).isNotNull(), F.col(f"`{c}`")),
    }
    return df.select(*[cast[kinds[c]](c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def read_typed(spark: SparkSession, path: str, percent: float = 100.0, row_id: tuple[str, str] | None = None) -> DataFrame:
    """A table with types from text whose first row has the names, in camel case.

    The header's first blank name ends the table: longer rows are cut, shorter ones padded
    with NULL, and rows that repeat the header left out. A column gets the narrowest type that
    this part of its non-empty cells has (boolean, int, long, decimal as DOUBLE, timestamp,
    string), counted for all columns in one aggregation; cells that don't fit are NULL, see quality().
    """
    d = detect_delimiter(sample := sample_of(spark, path))
    head = next(split_rows(sample, d), [])
    head = head[: next((k for k, h in enumerate(head) if not h.strip()), len(head))]
    titles = names([camel_case(h) for h in head])
    rows = read_ragged(spark, path, d).where(F.slice("fields", 1, len(head)) != F.array(*map(F.lit, head))) if head else read_ragged(spark, path, d)
    keep = [F.col("path").alias(row_id[0]), F.col("rid").alias(row_id[1])] if row_id else []
    cells = stored(rows.select(*keep, *[F.nullif(F.get("fields", F.lit(k)), F.lit("")).alias(t) for k, t in enumerate(titles)]), "cells")
    return typed(cells, titles, percent) if titles else cells


def quality(text: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind, n, empty, bad): rows, cells without content in the text, and cells with content that the table has as NULL; text and table have the same rows."""
    n, counts = text.count(), table.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
    empty = text.agg(*[F.count_if(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) == "").alias(c) for c in columns])
    long = lambda row, name: row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(name)) for c in columns])).alias("x")).select("x.*")
    kinds = text.sparkSession.createDataFrame([(c, dict(table.dtypes)[c]) for c in columns], "column string, kind string")
    both = long(empty, "empty").join(long(counts, "full"), "column").join(kinds, "column")
    return both.select("column", "kind", F.lit(n).cast("long").alias("n"), "empty", (F.lit(n) - F.col("empty") - F.col("full")).alias("bad"))


def format_row(columns: list[str], delimiter: str = ",") -> Column:
    """A line with quotes only where a field has the delimiter, a quote, a line end or white space at an edge."""
    def one(c):
        s = F.coalesce(F.col(c).cast("string"), F.lit(""))
        needs = s.contains(delimiter) | s.contains('"') | s.rlike(r"[\r\n]") | s.rlike(r"^\s|\s$")
        return F.when(needs, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(delimiter, *[one(c) for c in columns])


def write_matrix(df: DataFrame, path: str, columns: list[str], delimiter: str = ",", nan: str = "NaN") -> None:
    """Numbers as text without quotes or header, one file for each partition in order."""
    def cell(c):
        x = F.col(c)
        if dict(df.dtypes)[c] in ("double", "float"):
            return F.when(F.isnan(x), nan).when(x == float("inf"), "Inf").when(x == float("-inf"), "-Inf").otherwise(x.cast("string"))
        return F.coalesce(x.cast("string"), F.lit(""))

    df.select(F.concat_ws(delimiter, *[cell(c) for c in columns]).alias("value")).write.text(path)


def infer_types(df: DataFrame, columns: list[str], percent: float = 100.0) -> DataFrame:
    """(column, kind): the first of boolean, int, long, decimal, timestamp that this part of the non-empty cells parses as, else string."""
    kinds = {"boolean": lambda c: c.rlike("(?i)^(true|false|yes|no|0|1)$"), "int": lambda c: c.try_cast("int").isNotNull(), "long": lambda c: c.try_cast("long").isNotNull(), "decimal": lambda c: is_numeric(c), "timestamp": lambda c: c.try_cast("timestamp_ntz").isNotNull()}
    cell = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    # Where every cell has to fit, one that doesn't rules a kind out for good: such kinds are not counted over all rows.
    counted = lambda rows, left: rows.agg(*[F.struct(F.count(cell(c)).alias("n"), *[(F.count_if(f(cell(c))) if k in left[c] else F.lit(-1).cast("long")).alias(k) for k, f in kinds.items()]).alias(c) for c in columns])
    left = dict.fromkeys(columns, list(kinds))
    if percent >= 100 and columns:
        few = counted(df.limit(SAMPLE), left).first()
        left = {c: [k for k in kinds if few[at][k] == few[at]["n"]] for at, c in enumerate(columns)}
    row = counted(df, left)
    kind = lambda c: F.coalesce(*[F.when((F.col(f"{c}.n") > 0) & (F.col(f"{c}.{k}") * 100 >= F.col(f"{c}.n") * percent), k) for k in kinds], F.lit("string"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), kind(c).alias("kind")) for c in columns])).alias("x")).select("x.*")
