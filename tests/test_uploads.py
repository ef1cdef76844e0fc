"""CSV uploads against Python's reader, and pages of laid out tables against offset and limit."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import csv_tables, pages
from logloom.sources import gateway

SF = "/root/testdata/sf0.001"


def read(content):
    """(rows, whether it is an error) by Python's reader."""
    try:
        text = content.decode().removeprefix("﻿")
    except UnicodeDecodeError:
        return None
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return rows if rows and len({len(r) for r in rows}) == 1 else None


def test_csv(spark):
    rng = random.Random(3)
    files = [b"", b"\n", b"a", b"a,", b",", b"a,b\n", b"a,b\r\nc,d", b'"a\nb","c""d"\n1,2', b'"open,\n1', b'a"b,c"\n', b'"a"b,c\n', b'""', b'"",""\n', b'"a,"', b'"a",', b'"', b'""""', b'"a""', b"\xef\xbb\xbfx,y", b"\xff,1", b"a\n\n\r\n b\n", b"a,b\nc", '"é,\n語",\U0001f600\n1,2'.encode()]
    files += ["".join(rng.choices('ab,,""\n\né', k=rng.randrange(14))).encode() for _ in range(800)] + ["".join(rng.choices(['a', '"a""b"', '"x\ny"', ",", ",", "\r\n", "\n"], k=rng.randrange(12))).encode() for _ in range(800)]
    files.append(b"\n".join(b'%d,"%s"' % (k, b'""\n' * 50) for k in range(3000)))
    got = {r.doc_id: r for r in csv_tables.csv_tables(spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(files)], "doc_id long, content binary")).collect()}
    for k, f in enumerate(files):
        assert got[k].rows == read(f), f
        assert (got[k].error is None) == (got[k].rows is not None)
    assert got[0].error == csv_tables.EMPTY and got[19].error.startswith(csv_tables.BROKEN) and "record 1 has 1 fields" in got[21].error


def test_csv_markdown(spark):
    rows = [(1, b"a|b,c\n1,\n"), (2, b"one,,two"), (3, b"a\nb,c"), (4, b"x\ny")]
    got = {r.doc_id: r.text for r in csv_tables.csv_markdown(spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "doc_id long, content binary")).collect()}
    assert got == {1: "| a\\|b | c |\n| --- | --- |\n| 1 |  |\n", 2: "one | two", 3: None, 4: "| x |\n| --- |\n| y |\n"}


@pytest.mark.parametrize("down", [True, False])
def test_pages(spark, tmp_path, down):
    logs = gateway.request_logs(spark, SF).select("id", "created_at", "model")
    order, path = [("created_at", down), ("id", False)], str(tmp_path / "logs")
    pages.lay_out(logs, path, order, files=12)
    whole = [tuple(r) for r in logs.orderBy(*pages.ordering(order)).collect()]
    assert sum(r["n"] for r in pages.index_of(spark, path)) == len(whole) and len(pages.index_of(spark, path)) == 12
    for number, size in [(1, 20), (3, 7), (17, 20), (len(whole) // 20, 20), (len(whole) // 20 + 1, 20), (2, 333), (9999, 20)]:
        found = pages.page(spark, path, order, number=number, size=size)
        assert [tuple(r) for r in found.collect()] == whole[(number - 1) * size : number * size]
    deep = pages.page(spark, path, order, number=40, size=20)
    assert len(deep.inputFiles()) <= 2
    for k in (0, 77, 500, len(whole) - 3, len(whole) - 1):
        found = pages.page_behind(spark, path, order, (whole[k][1], whole[k][0]), size=25)
        assert [tuple(r) for r in found.collect()] == whole[k + 1 : k + 26] and len(found.inputFiles()) <= 3


def test_page_of_nothing(spark, tmp_path):
    logs = gateway.request_logs(spark, SF).filter("false")
    pages.lay_out(logs, str(tmp_path), [("created_at", True)], files=4)
    assert pages.page(spark, str(tmp_path), [("created_at", True)], number=1, size=5).count() == 0
