import sqlite3
import struct

import pytest

from gleanery.sources import readers, sinks

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 480, 640)


def test_probe():
    assert readers.probe(PNG) == ("PNG", 640, 480, None)
    assert readers.probe(JPEG) == ("JPEG", 640, 480, None)
    assert readers.probe(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("GIF", 3, 4, None)
    assert readers.probe(b"\xff\xd8\xff")[3] == "broken_header" and readers.probe(b"xx")[3] == "unknown_format" and readers.probe(None)[3] == "missing"


def test_images_and_objects(spark, tmp_path):
    df = spark.createDataFrame([("real", "a", "png", bytearray(PNG)), ("fake", "b", "jpg", bytearray(JPEG))], "l string, n string, e string, c binary")
    out = str(tmp_path / "images")
    assert {r["outcome"] for r in sinks.write_objects(df, out, "l", "n", "e", "c").collect()} == {"written"}
    assert {r["outcome"] for r in sinks.write_objects(df, out, "l", "n", "e", "c").collect()} == {"present"}
    got = {(r["format"], r["width"], r["size"]) for r in readers.read_images(spark, out).collect()}
    assert got == {("PNG", 640, len(PNG)), ("JPEG", 640, len(JPEG))}


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(b'k,v\n1,"a ""q"""\n2,""\n3,\n')
    got = [(r["k"], r["v"]) for r in readers.read_csv(spark, str(p), "k int, v string").orderBy("k").collect()]
    assert got[0] == (1, 'a "q"') and got[1] == (2, "")
    readers.check_header(spark, str(p), ["k", "v"], exact=True)
    with pytest.raises(ValueError, match="lacks"):
        readers.check_header(spark, str(p), ["x"])
    p.write_bytes(b"k,v\n1,a,b\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_csv(spark, str(p), "k int, v string").collect()
    assert readers.read_csv(spark, str(p), "k int, v string", strict=False).first()["_corrupt"] == "1,a,b"


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"k": 1}\n\n{"k": 2}\n')
    assert readers.read_jsonl(spark, str(p), "k int").count() == 2
    p.write_text("[broken\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_jsonl(spark, str(p), "k int").collect()


def test_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(sinks.zip_bytes({"x/a.txt": b"A", "../b": b"B"}))
    (tmp_path / "b.zip").write_bytes(b"none")
    got = {(r["name"], r["content"] and bytes(r["content"]), r["problem"]) for r in readers.read_archives(spark, str(tmp_path)).collect()}
    assert got == {("x/a.txt", b"A", None), ("../b", None, "unsafe_path"), (None, None, "no_archive")}
    assert sinks.zip_bytes({"b": b"1", "a": b"2"}) == sinks.zip_bytes({"a": b"2", "b": b"1"})


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "a.db")
    with sqlite3.connect(p) as c:
        c.execute("create table t (k integer, v text)")
        c.executemany("insert into t values (?, ?)", [(i, None if i % 3 else str(i)) for i in range(25)])
    assert readers.read_sqlite(spark, p, "t", "k long, v string").filter("v is not null").count() == 9


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[a]\nn = 3\nb = true\n")
    assert readers.load_toml(str(p), {"a.n": int})["a"]["n"] == 3
    for types, rules in (({"a.b": int}, {}), ({"a.x": int}, {}), ({}, {"n must be even": lambda c: c["a"]["n"] % 2 == 0})):
        with pytest.raises(ValueError, match="must|missing"):
            readers.load_toml(str(p), types, rules)
    assert readers.config_fingerprint({"b": 1, "a": 2}) == readers.config_fingerprint({"a": 2, "b": 1})


def test_files_written_once(tmp_path):
    p = str(tmp_path / "x.json")
    assert sinks.write_json(p, {"b": 1}) and not sinks.write_json(p, {"b": 1})
    assert sinks.publish(str(tmp_path / "y"), b"1") and not sinks.publish(str(tmp_path / "y"), b"1")
    with pytest.raises(FileExistsError):
        sinks.publish(str(tmp_path / "y"), b"2")


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "a", 2), (2, "B", 2), (3, "c", 2), (None, "m", 2)], "k int, v string, at int")
    merged, outcomes = sinks.upsert(old, new, ["k"], ignore=["at"])
    assert {(r["k"], r["v"]) for r in merged.collect()} == {(1, "a"), (2, "B"), (3, "c"), (None, "m")}
    assert {r["k"]: r["outcome"] for r in outcomes.collect()} == {1: "unchanged", 2: "updated", 3: "created", None: "updated"}
    assert sinks.csv_bytes(spark.createDataFrame([(2, None), (1, True)], "k int, b boolean"), ["k"]) == b"k,b\n1,true\n2,\n"
