"""Nested text to rows: table functions for JSON and XML, and archive expansion."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Archive members that are read.
MEMBER_FORMATS = ("csv", "xlsx", "xls", "json", "xml", "txt", "tsv")
# Fixed value: the largest member that is read as a whole.
MEMBER_BYTES = 100 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
BATCH_ROWS = 1000
BATCH_LEAVES = 20_000


SPACES = re.compile(r"[ \t\n\r]*")


def json_leaves(text: str) -> Iterator[tuple[str, object]]:
    """(dotted path, leaf) in document order, however deep; empty containers leave nothing.

    Containers lie on a stack of their own and only scalars go to the parser. Raises ValueError for text
    that is not JSON.
    """
    scalar = json.JSONDecoder().raw_decode
    skip = lambda i: SPACES.match(text, i).end()
    stack: list[tuple[str, str, int]] = []  # container kind, path, members so far
    at, path, want = skip(0), "", "value"
    while True:
        mark = text[at : at + 1]
        if want == "value" or (want == "first" and mark not in "]}"):
            if want == "first" and stack[-1][0] == "{":
                want = "key"
                continue
            if stack and stack[-1][0] == "[":
                kind, above, n = stack[-1]
                stack[-1] = (kind, above, n + 1)
                path = f"{above}.{n}" if above else str(n)
            if mark in ("{", "["):
                stack.append((mark, path, 0))
                at, want = skip(at + 1), "first"
                continue
            leaf, end = scalar(text, at)
            yield path, leaf
            at, want = skip(end), "after"
        elif want == "key":
            if mark != '"':
                raise ValueError("a name is missing")
            name, end = scalar(text, at)
            at = skip(end)
            if text[at : at + 1] != ":":
                raise ValueError("a colon is missing")
            above = stack[-1][1]
            at, path, want = skip(at + 1), f"{above}.{name}" if above else name, "object value"
        elif want == "object value":
            if mark in ("{", "["):
                stack.append((mark, path, 0))
                at, want = skip(at + 1), "first"
                continue
            leaf, end = scalar(text, at)
            yield path, leaf
            at, want = skip(end), "after"
        else:  # the end of a container, or what follows a value
            if not stack:
                if at < len(text):
                    raise ValueError("text after the end")
                return
            if mark == ("}" if stack[-1][0] == "{" else "]"):
                stack.pop()
                at, want = skip(at + 1), "after"
            elif mark == "," and want == "after":
                at, want = skip(at + 1), "key" if stack[-1][0] == "{" else "value"
            else:
                raise ValueError("a comma or an end is missing")


def _put_leaves(node: object, path: str, found: dict[str, object]) -> None:
    """The leaves below a node, by path as in ``json_leaves``; objects are tuples of (name, value) pairs."""
    if type(node) is tuple:
        for name, value in node:
            _put_leaves(value, f"{path}.{name}" if path else name, found)
    elif type(node) is list:
        for n, value in enumerate(node):
            _put_leaves(value, f"{path}.{n}" if path else str(n), found)
    else:
        found[path] = node


def leaves_by_path(text: str) -> dict[str, object]:
    """The last leaf of every path. What is nested too deep for the library's parser goes to ``json_leaves``."""
    leaves: dict[str, object] = {}
    try:
        # Pairs, so that repeated names stay apart.
        _put_leaves(json.JSONDecoder(object_pairs_hook=tuple).decode(text), "", leaves)
    except RecursionError:
        return dict(json_leaves(text))
    return leaves


def json_rows(text: str) -> Iterator[tuple]:
    """(pos, path, value) per leaf that is not null; text that is not JSON gives none."""
    try:
        leaves = leaves_by_path(text)
    except (TypeError, ValueError, RecursionError):
        return
    for pos, (path, leaf) in enumerate(leaves.items()):
        if leaf is not None and leaf == leaf:
            yield pos, path, str(leaf)


def xml_rows(text: str) -> Iterator[tuple]:
    """(pos, path, value, attributes) of element texts and attributes in document order."""
    try:
        stack = [(ElementTree.fromstring(text), "")]
    except (TypeError, ValueError, ElementTree.ParseError):
        return
    pos = 0
    while stack:
        node, above = stack.pop()
        path = f"{above}.{node.tag}" if above else node.tag
        body = (node.text or "").strip()
        if body:
            yield pos, path, body, dict(node.attrib)
            pos += 1
        for name, value in node.attrib.items():
            yield pos, f"{path}@{name}", value, {}
            pos += 1
        stack.extend((child, path) for child in reversed(node))


# Plain rows: with Arrow, Spark makes a table and a batch of its own out of every single call.
@udtf(returnType="pos int, path string, value string", useArrow=False)
class FlattenJson:
    """JSON leaves for SQL: ``FROM t, LATERAL flatten_json(t.text)``."""

    def eval(self, text: str):
        yield from json_rows(text)


@udtf(returnType="pos int, path string, value string, attributes map<string,string>", useArrow=False)
class FlattenXml:
    """XML texts and attributes for SQL."""

    def eval(self, text: str):
        yield from xml_rows(text)


def register(spark: SparkSession) -> None:
    """Make both usable from SQL: ``SELECT ... FROM t, LATERAL flatten_json(t.text)``."""
    spark.udtf.register("flatten_json", FlattenJson)
    spark.udtf.register("flatten_xml", FlattenXml)


def _rows_per_text(df: DataFrame, text: str, rows: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """Every row of ``df`` once per tuple that ``rows`` gives for its text, which is left out.

    Whole Arrow batches cross to Python and back; the other columns are only repeated.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    added = StructType.fromDDL(schema)
    out_schema = StructType(kept + added.fields)
    arrow = [to_arrow_type(f.dataType) for f in added.fields]
    names = [f.name for f in out_schema.fields]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            index = pa.array(origin, pa.int64())
            same = [batch.column(f.name).take(index) for f in kept]
            new = [pa.array(column, kind) for column, kind in zip(zip(*found), arrow)]
            return pa.RecordBatch.from_arrays(same + new, names)

        for batch in batches:
            origin, found = [], []
            for i, body in enumerate(batch.column(text)):
                for row in rows(body.as_py()):
                    origin.append(i)
                    found.append(row)
                if len(found) >= BATCH_LEAVES:
                    yield flush()
                    origin, found = [], []
            if found:
                yield flush()

    return df.select(*[f.name for f in kept], text).mapInArrow(expand, out_schema)


def flatten_json(df: DataFrame, text: str) -> DataFrame:
    """``df`` without the text, one row per JSON leaf: adds pos, path and value."""
    return _rows_per_text(df, text, json_rows, "pos int, path string, value string")


def flatten_xml(df: DataFrame, text: str) -> DataFrame:
    """``df`` without the text, one row per text node and attribute."""
    return _rows_per_text(df, text, xml_rows, "pos int, path string, value string, attributes map<string,string>")


def expand_archives(archives: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """One row (archive, member, format, bytes) per readable member.

    A member that is not read (another format, damaged, beyond MEMBER_BYTES) is a row with ``error``; a broken
    archive is one row without a member. Members leave in batches of a few MB, so a task never holds a whole
    expanded archive, however small its file is.
    """
    columns = ["archive", "member", "format", "bytes", "error"]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for archive, data in zip(batch[name], batch[content]):
                for row in members(archive, data):
                    rows.append(row)
                    size += len(row[3] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    def members(archive: str, data: bytes) -> Iterator[tuple]:
        try:
            opened = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError) as e:
            yield archive, None, None, None, str(e)
            return
        with opened:
            for info in opened.infolist():
                kind = info.filename.rsplit(".", 1)[-1].lower()
                if info.is_dir():
                    continue
                if kind not in MEMBER_FORMATS:
                    yield archive, info.filename, kind, None, f"unsupported format: {kind}"
                    continue
                if info.file_size > MEMBER_BYTES:
                    yield archive, info.filename, kind, None, "member too large"
                    continue
                try:
                    yield archive, info.filename, kind, opened.read(info), None
                except Exception as e:
                    yield archive, info.filename, kind, None, str(e)

    schema = "archive string, member string, format string, bytes binary, error string"
    return archives.select(name, content).mapInPandas(expand, schema)
