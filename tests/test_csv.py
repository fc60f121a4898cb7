"""Delimited text: the vectorised parser against the plain one, charsets, row ids, bounded records and typed tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.sources import csv


@pytest.mark.parametrize("delimiter", list(csv.DELIMITERS))
def test_parser_like_the_plain_one(delimiter):
    rng = random.Random(delimiter)
    alphabet = ['"', '"', delimiter, delimiter, "\n", "\n", " ", "\t", "a", "é", "x y", "12", "\x01"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) + "\n"
        data = text.encode()
        rows, line, size = csv.parsed(data, delimiter)
        done = data[:size].decode()
        assert rows.to_pylist() == list(csv.split_rows(done, delimiter)), repr(text)
        # what is left is a record with an open quote
        rest = text[len(done) :]
        closed, opened = csv.quote_effect(data, delimiter)
        assert closed == bool(rest) and (size == len(data)) == (not rest)
        cut = rng.randrange(len(text))
        at = text.rfind("\n", 0, cut) + 1  # effects compose
        first = csv.quote_effect(text[:at].encode(), delimiter) if at else (False, True)
        second = csv.quote_effect(text[at:].encode(), delimiter)
        assert (closed, opened) == tuple(second[int(x)] for x in first)


def test_states_in_long_texts():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b'",\n ab', np.uint8), 5000)
    sym = csv.symbols(data, ",")
    state, want = csv.EDGE, []
    for s in sym.tolist():
        want.append(state)
        state = int(csv._STEPS[s, state])
    got, end = csv.states(sym, csv.EDGE)
    assert got.tolist() == want and end == state


def test_charsets_blank_rows_and_row_ids(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("größe,preis €\n1,2\n,\n \n3,4\n".encode("cp1252"))
    df = csv.read_smart(spark, str(p), row_id=("file", "row"))
    assert df.columns == ["file", "row", "größe", "preis €"]
    rows = df.orderBy("file", "row").collect()
    assert [(r["größe"], r["preis €"]) for r in rows] == [(1.0, 2.0), (3.0, 4.0)] and rows[0]["row"] < rows[1]["row"] and rows[0]["file"].endswith("a.csv")
    for held in ("", '"x\ny",1\n'):  # the same rows with and without a quoted line end
        q = tmp_path / f"b{len(held)}.csv"
        q.write_text("1,2\n,\n\n3,4\n" + held)
        assert csv.read_smart(spark, str(q)).count() == 2 + bool(held)
    bom = tmp_path / "bom.csv"
    bom.write_bytes(b"\xef\xbb\xbfa,b\n1,2\n")
    assert csv.read_smart(spark, str(bom)).columns == ["a", "b"]


def test_a_stray_quote_is_told(spark, tmp_path, monkeypatch):
    p = tmp_path / "stray.csv"
    p.write_text('a,b\n1,"2\n' + "3,4\n" * 2000)
    assert csv.read_ragged(spark, str(p), ",").count() == 2
    monkeypatch.setattr(csv, "MOST", 1000)
    with pytest.raises(Exception, match="a quote is open"):
        csv.read_ragged(spark, str(p), ",").count()


def test_typed_tables(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text(
        'Order ID,is_open,amount (EUR),placed,note,big,,ignored\n1,yes,"$1,234.50",2024-05-12 10:11:12,x,3000000000,,9\n2,no,2%,2024-05-13,,4000000000\n'
        "Order ID,is_open,amount (EUR),placed,note,big,,ignored\n3,true,oops,,long row,5,,1,2,3\n4\n"
    )
    df = csv.read_typed(spark, str(p), percent=60, row_id=("file", "row"))
    assert df.dtypes[2:] == [("orderId", "int"), ("isOpen", "boolean"), ("amountEur", "double"), ("placed", "timestamp_ntz"), ("note", "string"), ("big", "bigint")]
    rows = [tuple(r)[2:] for r in df.orderBy("row").collect()]
    assert [r[0] for r in rows] == [1, 2, 3, 4] and [r[1] for r in rows] == [True, False, True, None] and [r[2] for r in rows] == [1234.5, 0.02, None, None]
    assert [str(r[3]) for r in rows[:2]] == ["2024-05-12 10:11:12", "2024-05-13 00:00:00"] and [r[4] for r in rows] == ["x", None, "long row", None] and [r[5] for r in rows] == [3_000_000_000, 4_000_000_000, 5, None]
    text = spark.createDataFrame([("7", "a"), ("x", ""), (None, "b")], "n string, s string")
    table = csv.typed(text, ["n", "s"], percent=50)
    got = {r["column"]: tuple(r)[1:] for r in csv.quality(text, table, ["n", "s"]).collect()}
    assert got == {"n": ("int", 3, 1, 1), "s": ("string", 3, 1, 0)}
    assert csv.camel_case("  a-b_c D ") == "aBCD" and csv.camel_case("--") == "--"


def test_nothing(spark, tmp_path):
    p = tmp_path / "empty.csv"
    p.write_text("")
    assert csv.read_ragged(spark, str(p)).isEmpty() and csv.read_smart(spark, str(p)).isEmpty()
    assert spark.range(1).select(F.lit(csv.width_of(spark, str(p), ","))).first()[0] == 1


def test_plain_lines_are_parsed_alike():
    """Lines without quotes by the short way and by the automaton: blanks, empty and ragged rows, other letters."""
    lines = [b"a, b ,\tc", b"", b" , ,", b"\xc3\xa4,\xe2\x82\xac ", b"x", b",,1", b"\x00z\x1f,\xc2\xa0", b"  "]
    for some in (lines, lines[1:3], lines[:1]):
        rows, line = csv._plain(pa.array(some, pa.binary()), ",")
        want, start, _ = csv.parsed(b"\n".join(some) + b"\n", ",")
        assert rows.to_pylist() == want.to_pylist() and line.tolist() == start.tolist()
    pieces = list(csv._cuts(pa.array([b"x" * (csv.PIECE // 3)] * 7, pa.binary())))
    assert [len(p) for p in pieces] == [2, 2, 2, 1] and csv._joined(pa.array([b"a", b"", b"b"], pa.binary()).slice(1)) == b"\nb\n"


def test_a_late_cell_changes_the_type(spark, monkeypatch):
    """A sample rules kinds out, and never chooses one."""
    monkeypatch.setattr(csv, "SAMPLE", 2)
    df = spark.createDataFrame([("1", "5", "x"), ("0", "6", "y"), ("1", "9999999999", "1"), ("7", None, "2")], "a string, b string, c string").coalesce(1)
    assert {r["column"]: r["kind"] for r in csv.infer_types(df, ["a", "b", "c"]).collect()} == {"a": "int", "b": "long", "c": "string"}
