"""Files on disk: encodings, quoting, nested formats, archives, validation."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyroll.functions import flatten as X
from tallyroll.operators import history as H, quality as Q
from tallyroll.sources import files as S


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.csv").write_text('order_number,цена,note,note,\nA,"1 234,50","say ""hi""\nthere",x,1\n\nB,5\nC,NA,,,,,7\n')
    (tmp_path / "b.CSV").write_bytes("номер_заказа,цена\r\nЖ1,15000 сум\r\n".encode("cp1251"))
    (tmp_path / "c.tsv").write_text("a\tb\n1\t2,3\n")
    (tmp_path / "d.txt").write_text("one\n\n  two \r\n")
    (tmp_path / "e.json").write_text('[{"a":1},{"a":true,"b":null}]')
    (tmp_path / "f.xml").write_text('<r><o id="1"><p>5</p></o></r>')
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.write(tmp_path / "d.txt", "in/d.txt")
        z.writestr("x.exe", "zz")
    (tmp_path / "h.zip").write_bytes(b"broken")
    return str(tmp_path)


def short(name="file"):
    return F.regexp_extract(name, r"(?:^|/)([^/]+\.\w+(?:/.*)?)$", 1)


def test_cells_of_a_folder(spark, folder):
    rows = S.read_cells(spark, folder).withColumn("file", short())
    got = sorted((r.file, r.row_number, r.column_name, r.new_value) for r in rows.collect())
    assert [g for g in got if g[0] == "a.csv"] == [
        ("a.csv", 1, "note", 'say "hi"\nthere'), ("a.csv", 1, "note.1", "x"), ("a.csv", 1, "order_number", "A"),
        ("a.csv", 1, "unnamed: 4", "1"), ("a.csv", 1, "цена", "1 234,50"),
        ("a.csv", 2, "order_number", "B"), ("a.csv", 2, "цена", "5"), ("a.csv", 3, "order_number", "C"),
    ]
    assert ("b.CSV", 1, "номер_заказа", "Ж1") in got and ("c.tsv", 1, "b", "2,3") in got
    assert [g[1:] for g in got if g[0] == "d.txt"] == [(1, "text_line", "one"), (3, "text_line", "two")]
    assert [g[2:] for g in got if g[0] == "e.json"] == [("0.a", "1"), ("1.a", "True")]
    assert ("f.xml", 2, "path", "r.o.p") in got and ("f.xml", 2, "value", "5") in got
    assert [g[1:] for g in got if g[0].endswith("in/d.txt")] == [(1, "text_line", "one"), (3, "text_line", "two")]


def test_encodings(spark, folder):
    bad = spark.createDataFrame([("x.txt", bytearray(b"a\x98\xff"))], "file string, content binary")
    got = {r.f: r.encoding for r in S.decode_text(S.binary_files(spark, folder, "csv").union(bad)).select(short().alias("f"), "encoding").collect()}
    assert got == {"a.csv": "utf-8", "b.CSV": "cp1251", "x.txt": "iso-8859-1"}


def test_surplus_fields_are_counted(spark, folder):
    rows = S.delimited_records(S.binary_files(spark, folder, "csv")).filter(F.col("surplus") > 0).collect()
    assert [(r.row_number, r.surplus) for r in rows] == [(3, 2)]


def test_strings_scan_of_cp1251(spark, folder):
    got = S.csv_strings(spark, f"{folder}/b.CSV", encoding="cp1251")
    assert got.columns == ["номер_заказа", "цена"] and got.collect()[0][0] == "Ж1"


def test_typed_orders(spark, folder):
    records = S.delimited_records(S.binary_files(spark, folder, "csv"), lower_headers=True)
    got = {r.order_number: r for r in H.typed_orders(records, F.lit("2024-01-01")).collect()}
    assert float(got["A"].order_price) == 1234.5 and float(got["Ж1"].order_price) == 15000
    assert got["B"].machine_code == "UNKNOWN" and got["B"].payment_type == "unknown"
    assert str(got["B"].creation_time) == "2024-01-01 00:00:00"


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":1},"c":[1,{"d":2}],"e":{}}'), (2, "{"), (3, None)], "id int, t string")
    got = [(r.id, r.path, r.value) for r in X.flatten_json(df, "t").orderBy("id", "pos").collect()]
    assert got == [(1, "a.b", "1"), (1, "c.0", "1"), (1, "c.1.d", "2")]
    xml = spark.createDataFrame([(1, '<r><o id="1"><p>5</p></o></r>'), (2, "<r>")], "id int, t string")
    assert [(r.path, r.value) for r in X.flatten_xml(xml, "t").orderBy("pos").collect()] == [("r.o@id", "1"), ("r.o.p", "5")]


@pytest.mark.parametrize("depth", [10, 990, 20_000])
def test_json_of_any_depth(depth):
    assert [v for _, _, v in X.json_rows("[" * depth + "7" + "]" * depth)] == ["7"]
    assert list(X.json_rows('{"a":' * depth + "7" + "}" * (depth - 1))) == []


@pytest.mark.parametrize("text", ["", "[1,]", '{"a" 1}', "[1 2]", "1 2", '{"a":1,}', "{1:2}", "[", "nul"])
def test_json_that_is_none(text):
    with pytest.raises(ValueError):
        json.loads(text)
    assert list(X.json_rows(text)) == []


def test_broken_archives_do_not_stop_the_run(spark, folder):
    rows = X.expand_archives(S.binary_files(spark, folder, "zip"), "file").collect()
    assert sorted((r.member or "", r.error is None) for r in rows) == [("", False), ("in/d.txt", True), ("x.exe", False)]


def test_what_is_not_read_says_so(spark, folder, tmp_path):
    (tmp_path / "i.Csv").write_text("a\n1\n")
    (tmp_path / "j.pdf").write_text("x")
    got = {(r.file, r.column_name): r.new_value for r in S.read_cells(spark, folder).withColumn("file", short()).collect()}
    assert got["i.Csv", "a"] == "1"
    assert got["j.pdf", "error"] == "no reader for format: pdf"
    assert got["g.zip/x.exe", "error"] == "unsupported format: exe" and any(f == "h.zip" and c == "error" for f, c in got)


def test_files_beyond_the_limit(spark, tmp_path, monkeypatch):
    """Delimited and text files of any size give the same rows as small ones; others give the reason."""
    rows = [f'{i},"say ""{i}""",x' for i in range(500)]
    (tmp_path / "a.csv").write_text("id,text,id\n" + "\n".join(rows) + '\n7,"open,1\n')
    (tmp_path / "b.txt").write_text("one\n\ntwo\n")
    (tmp_path / "c.json").write_text('{"a": "' + "x" * 100 + '"}')
    cells = lambda: sorted(tuple(r) for r in S.read_cells(spark, str(tmp_path)).withColumn("file", short()).collect())
    whole = cells()
    monkeypatch.setattr(S, "MAX_FILE_BYTES", 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        split = cells()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x for x in split if x[0] != "c.json"] == [x for x in whole if x[0] != "c.json"] and len(whole) > 1500
    assert [x for x in split if x[0] == "c.json"] == [("c.json", 0, "error", "file too large")]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_large_files_give_the_records_of_small_ones(spark, tmp_path, monkeypatch, end):
    """Line breaks inside quotes, blank lines, one encoding per file, whichever reader takes a file."""
    rnd = random.Random(3)
    pieces = ['"', '""', '"x"', ",", ",", end, end, "a", '5" b', '"two' + end + 'lines"', "c"]
    for i in range(12):
        (tmp_path / f"r{i}.csv").write_bytes((f"h,i,j{end}" + "".join(rnd.choices(pieces, k=120)) + end).encode())
    (tmp_path / "a.csv").write_bytes((end + f'id,text{end}1,"two{end}{end}lines"{end}{end}2,"a ""b{end}c"" d"{end}3,x{end}').encode())
    (tmp_path / "open.csv").write_bytes(f'id,text{end}1,"a{end}b"{end}2,"open{end}3,"",{end}4,x{end}'.encode())
    (tmp_path / "ru.csv").write_bytes(f"id,text{end}1,plain{end}2,Привет{end}".encode("cp1251"))
    (tmp_path / "latin.tsv").write_bytes(f"id\ttext{end}1\té{end}2\t".encode("latin-1") + b"\x98" + end.encode())
    sizes = [S.binary_files(spark, str(tmp_path), k) for k in ("csv", "tsv")]
    columns = ["file", "encoding", "row_number", "cells", "surplus", "unclosed"]

    def rows(df):
        return sorted((r.file.split("/")[-1], *r[1:3], sorted(r.cells.items()), *r[4:]) for r in df.select(columns).collect())

    whole = [rows(S.delimited_records(f, sep)) for f, sep in zip(sizes, ",\t")]
    monkeypatch.setattr(S, "MAX_FILE_BYTES", 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        split = [rows(S.split_records(spark, S.large_files(spark, str(tmp_path), k), sep)) for k, sep in (("csv", ","), ("tsv", "\t"))]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert split == whole
    assert [r[2:4] for r in whole[0] if r[0] == "a.csv"][0] == (1, [("id", "1"), ("text", f"two{end}{end}lines")])
    assert {r[1] for r in whole[1]} == {"iso-8859-1"} and any(r[5] for r in whole[0] if r[0] == "open.csv")


@pytest.mark.parametrize(
    "text,rows",
    [
        ('h,i,j\nA,5" pipe,10\n', [({"h": "A", "i": '5" pipe', "j": "10"}, False)]),
        ('h,i\nA,"open\nB,2\n', [({"h": "A", "i": '"open'}, True), ({"h": "B", "i": "2"}, False)]),
        ('h,i\n"a,""b""\nc"x,2\n\n\nB\n', [({"h": 'a,"b"\ncx', "i": "2"}, False), ({"h": "B", "i": ""}, False)]),
        ("a,a,a.1\n1,2,3\n", [({"a": "1", "a.1": "2", "a.1.1": "3"}, False)]),
        (",1\n", []),
        ("", []),
    ],
)
def test_records(spark, text, rows):
    df = spark.createDataFrame([("f", bytearray(text.encode()))], "file string, content binary")
    got = S.delimited_records(df).orderBy("row_number").collect()
    assert [(r.cells, r.unclosed) for r in got] == rows


def test_strings_scan_goes_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_number,price\nA,1\n")
    (tmp_path / "b.csv").write_text('Price,order_number\n2,"B\nx"\n3,C\n')
    got = sorted((r.order_number, r.price) for r in S.csv_strings(spark, str(tmp_path)).collect())
    assert got == [("A", "1"), ("B\nx", "2"), ("C", "3")]


@pytest.mark.parametrize(
    "name,content,errors",
    [
        ("a.exe", b"x", ["unsupported format: exe"]),
        ("a", b"x", ["unsupported format: "]),
        ("a.csv", b"", ["file is empty"]),
        ("a.csv", b"  \n", ["no data"]),
        ("a.csv", b"\x98\xff", ["unknown encoding"]),
        ("a.json", b"{", ["invalid JSON"]),
        ("a.json", b'{"a":1}', []),
        ("a.json", b"12 and more", ["invalid JSON"]),
        ("a.xml", b"<a>", ["invalid XML"]),
        ("a.xml", b"<a/>", []),
        ("a.pdf", b"hello", ["invalid PDF"]),
        ("A.PDF", b"%PDF-1.7", []),
        ("a.zip", b"hello", ["damaged ZIP archive"]),
        ("a.csv", "Привет".encode("cp1251"), []),
    ],
)
def test_validation(spark, name, content, errors):
    df = spark.createDataFrame([(name, bytearray(content))], "name string, content binary")
    row = Q.validate_files(df, "name", "content").collect()[0]
    assert row.errors == errors and row.valid == (not errors)


def test_keep_first(spark):
    rows = spark.createDataFrame(
        [("f", "A", 1, 10), ("f", "B", 2, 5), ("f", "A", 3, 12), ("g", "", 1, 10), ("g", "", 2, 11), ("g", "C", 3, 1)],
        "file string, order_number string, row_number int, price int",
    )
    got = sorted((r.file, r.row_number) for r in H.keep_first(rows, ["file", "order_number"]).collect())
    assert got == [("f", 1), ("f", 2), ("g", 1), ("g", 3)]
