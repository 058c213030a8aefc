"""Delivered files to rows.

A file of at most MAX_FILE_BYTES is a bounded unit of work: it is read whole, decoded and split inside the
JVM, and its row numbers need no shuffle. Larger delimited and text files are scanned in splits and numbered
afterwards; lines that one record spans are put together, so the rows are the same. A piece up to a line feed
is the least that is read at once. Larger files of other formats and unsupported ones give one row that says why.
Every reader takes a frame (file, content) and gives the long cell log
(file, row_number, column_name, new_value); the column ``error`` of row 0 holds what could not be read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyroll.functions import flatten
from tallyroll.functions.values import content_hash, normalise_headers
from tallyroll.operators.spread import carry_last, row_numbers, running_sums
from tallyroll.session import stored

# Supported formats and their mime types.
FORMATS = {
    "csv": "text/csv",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "json": "application/json",
    "xml": "application/xml",
    "zip": "application/zip",
    "rar": "application/x-rar-compressed",
    "txt": "text/plain",
    "tsv": "text/tab-separated-values",
}
# Fixed value: the largest file that is read as a whole.
MAX_FILE_BYTES = 100 * 1024 * 1024
ERROR = "error"
# Cell texts that count as missing, as pandas has them.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Upper half of cp1251 against latin-1; byte 0x98 has no meaning in cp1251.
_HIGH = [b for b in range(0x80, 0x100) if b != 0x98]
_LATIN = bytes(_HIGH).decode("latin-1")
_CYRILLIC = bytes(_HIGH).decode("cp1251")


def as_cp1251(df: DataFrame) -> DataFrame:
    """Text columns and names whose latin-1 bytes are the cp1251 bytes of the input, for writing."""
    table = str.maketrans(_CYRILLIC, _LATIN)
    return df.select(
        *[F.translate(F.col(f"`{c}`").cast("string"), _CYRILLIC, _LATIN).alias(c.translate(table)) for c in df.columns]
    )


# ---- formats and catalogue -------------------------------------------------------------------


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot of the last path part; blank when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


def mime_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return table[ext]


def detect_format(df: DataFrame, name: str) -> DataFrame:
    """Adds file_type, mime_type and a format_error for unsupported files."""
    ext = extension(F.col(name))
    return df.withColumns(
        {
            "file_type": ext,
            "mime_type": mime_type(ext),
            "format_error": F.when(
                ~ext.isin(list(FORMATS)), F.concat(F.lit("unsupported file format: "), ext)
            ),
        }
    )


def listed(spark: SparkSession, path: str, ext: str | None = None) -> DataFrame:
    """Files below a folder as Spark lists them, of one extension in any case if ``ext`` is given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if ext:
        reader = reader.option("pathGlobFilter", "*." + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext))
    return reader.load(path)


def binary_files(spark: SparkSession, path: str, ext: str | None = None) -> DataFrame:
    """(file, content) of files within the size limit; the limit is pushed to the file listing."""
    files = listed(spark, path, ext).filter(F.col("length") <= MAX_FILE_BYTES)
    return files.select(F.col("path").alias("file"), "content")


def large_files(spark: SparkSession, path: str, ext: str) -> list[str]:
    """Paths beyond the size limit; the file listing itself is a list on the driver already."""
    return [r["path"] for r in listed(spark, path, ext).filter(F.col("length") > MAX_FILE_BYTES).select("path").collect()]


def refused_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_number, column_name, new_value) with the reason for every file no reader takes."""
    ext = extension(F.col("path"))
    whole = [k for k in READERS if k not in SPLIT]
    reason = F.when(~ext.isin(list(READERS)), F.concat(F.lit("no reader for format: "), ext)).when(
        ext.isin(whole) & (F.col("length") > MAX_FILE_BYTES), "file too large"
    )
    files = listed(spark, path).select(F.col("path").alias("file"), reason.alias("reason")).filter("reason is not null")
    return _long(files, F.lit(0), F.lit(ERROR), F.col("reason"))


def catalogue(files: DataFrame, name: str, content: str, storage: str = "uploads") -> DataFrame:
    """One entry per file: name, size, type, hash and storage path."""
    return detect_format(files, name).withColumns(
        {
            "file_size": F.octet_length(content).cast("bigint"),
            "content_hash": content_hash(F.col(content)),
            "storage_path": F.concat(F.lit(storage + "/"), F.col(name)),
        }
    )


# ---- decoding --------------------------------------------------------------------------------


def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``encoding`` and ``text``: utf-8 when valid, else cp1251, else latin-1."""
    raw = F.col(content).cast("string")
    found = files.withColumn("encoding", _encoding(F.is_valid_utf8(raw), _no_cp1251(content)))
    return found.withColumn("text", _decoded(content, F.lit(True)))


def _latin(content: str) -> Column:
    return F.decode(F.col(content).cast("binary"), "ISO-8859-1")


def _no_cp1251(content: str) -> Column:
    return _latin(content).contains("\u0098")


def _encoding(utf8: Column, no_cp1251: Column) -> Column:
    return F.when(utf8, "utf-8").when(~no_cp1251, "cp1251").otherwise("iso-8859-1")


def _decoded(content: str, first: Column) -> Column:
    """Text by the column ``encoding``; a mark of the byte order goes where a file begins."""
    raw = F.col(content).cast("string")
    return (
        F.when((F.col("encoding") == "utf-8") & first, F.regexp_replace(raw, "^\ufeff", ""))
        .when(F.col("encoding") == "utf-8", raw)
        .when(F.col("encoding") == "cp1251", F.translate(_latin(content), _LATIN, _CYRILLIC))
        .otherwise(_latin(content))
    )


# ---- delimited text --------------------------------------------------------------------------


def _header_names(fields: Column, lower: bool) -> Column:
    """Blank names get their position, repeated ones a counter."""

    def named(name: Column, i: Column) -> Column:
        clean = F.lower(F.trim(name)) if lower else name
        return F.when(F.trim(name) == "", F.concat(F.lit("unnamed: "), i.cast("string"))).otherwise(clean)

    def unique(given: Column, name: Column) -> Column:
        more = F.transform(F.sequence(F.lit(1), F.size(given) + 1), lambda k: F.concat(name, F.lit("."), k.cast("string")))
        free = F.filter(more, lambda m: ~F.array_contains(given, m))
        return F.concat(given, F.array(F.when(F.array_contains(given, name), F.get(free, F.lit(0))).otherwise(name)))

    return F.aggregate(F.transform(fields, named), F.array().cast("array<string>"), unique)


# A quote opens a field only at its start; what follows the closing quote up to the separator belongs to it.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def _mark(sep: str) -> str:
    return "\\t" if sep == "\t" else sep


def _record_pattern(sep: str) -> str:
    """A record: fields, where a quoted one may span lines and one whose quote stays open ends with its line."""
    mark = _mark(sep)
    field = f"(?:{QUOTED}[^{mark}\\r\\n]*+|[^{mark}\\r\\n]*+)"
    return f"(?=[^\\r\\n]){field}(?:{mark}{field})*+"


def _fields(record: Column, sep: str) -> Column:
    """Raw fields of a record; only records that hold a quote take the slow way."""
    mark = _mark(sep)
    parts = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(f"{mark}({QUOTED}[^{mark}]*+|[^{mark}]*+)"), F.lit(1))
    return F.when(record.contains('"'), parts).otherwise(F.split(record, mark, -1))


def _unquoted(fields: Column) -> Column:
    """Texts of raw fields."""

    def text(p: Column) -> Column:
        inner = F.regexp_extract(p, f"(?s)^({QUOTED})", 1)
        body = F.replace(F.substr(inner, F.lit(2), F.length(inner) - 2), F.lit('""'), F.lit('"'))
        return F.when(inner != "", F.concat(body, F.substr(p, F.length(inner) + 1))).otherwise(p)

    return F.when(F.exists(fields, lambda p: p.startswith('"')), F.transform(fields, text)).otherwise(fields)


def _unclosed(fields: Column) -> Column:
    """Whether some field opens a quote and does not close it."""
    return F.exists(fields, lambda p: p.startswith('"') & ~p.rlike(f"(?s)^{QUOTED}"))


def delimited_records(files: DataFrame, sep: str = ",", lower_headers: bool = False) -> DataFrame:
    """(file, encoding, row_number, cells, surplus, unclosed): one row per record, cells by header name.

    Quoted fields may hold separators, quotes and line breaks; a quote inside a field is plain text. Missing
    trailing fields are blank; ``surplus`` counts the fields beyond the header and ``unclosed`` marks a quote
    that never closes, for the caller to quarantine.
    """
    records = F.regexp_extract_all(F.col("text"), F.lit(_record_pattern(sep)), F.lit(0))
    # Outer, as the optimiser would otherwise test the whole text for being empty a second time.
    split = (
        decode_text(files)
        .select("file", "encoding", records.alias("_records"))
        .withColumn("_names", _header_names(_unquoted(_fields(F.get("_records", F.lit(0)), sep)), lower_headers))
        .select("file", "encoding", "_names", F.posexplode_outer("_records").alias("row_number", "_record"))
        .filter(F.col("row_number") > 0)
    )
    return _by_name(split, sep)


def _by_name(records: DataFrame, sep: str) -> DataFrame:
    """Records (file, encoding, _names, row_number, _record) to cells."""
    split = records.withColumn("_raw", _fields(F.col("_record"), sep)).withColumn("_values", _unquoted(F.col("_raw")))
    width = F.size("_names")
    # No lambda over the values: it would parse the record again for every field.
    padded = F.slice(F.concat(F.col("_values"), F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return split.select(
        "file",
        "encoding",
        F.col("row_number").cast("bigint").alias("row_number"),
        F.map_from_arrays("_names", padded).alias("cells"),
        F.greatest(F.size("_values") - width, F.lit(0)).alias("surplus"),
        _unclosed(F.col("_raw")).alias("unclosed"),
    )


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, row_number, encoding, text) of every line, blank ones too; files of any size in splits.

    Lines end at a line feed, and a file has one encoding, as where files are read whole.
    """
    raw = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").cast("binary").alias("content"),
    )
    # Written once, as the numbering reads the lines several times.
    raw = stored(raw, "lines")
    utf8, other = F.min(F.is_valid_utf8(F.col("content").cast("string"))), F.max(_no_cp1251("content"))
    kinds = raw.groupBy(F.col("file").alias("_file")).agg(_encoding(utf8, other).alias("encoding"))
    lines = row_numbers(raw, ["file"], ["_block", "_at"]).join(F.broadcast(kinds), F.col("file") == F.col("_file"))
    return lines.select("file", "row_number", "encoding", _decoded("content", F.col("row_number") == 1).alias("text"))


def _opens(line: Column, sep: str) -> Column:
    """Whether a line that begins with a field ends inside a quoted one."""
    mark = _mark(sep)
    field = f'(?:{QUOTED}[^{mark}\\r]*+|(?!")[^{mark}\\r]*+)'
    return line.contains('"') & line.rlike(f'^(?:{field}[{mark}\\r])*+"[^"]*+(?:""[^"]*+)*+\\z')


def line_groups(lines: DataFrame, sep: str) -> DataFrame:
    """The numbered lines with ``_group``: lines joined by line breaks inside quotes have the same.

    A line turns the state before it (inside quotes or not) into one after it. It keeps it, swaps it, or sets
    it whatever it was; so the state is what the last setting line gave, swapped by the lines since. A quote
    that no later line closes spans nothing: from the line that opens it, lines stand alone.
    """
    known = lines.withColumns({"_out": _opens(F.col("text"), sep), "_in": _opens(F.concat(F.lit('"'), "text"), sep)})
    known = known.withColumns({"_swap": (F.col("_out") & ~F.col("_in")).cast("int"), "_sets": F.col("_out") == F.col("_in")})
    summed = running_sums(known, ["file"], ["row_number"], {"_swaps": "_swap"})
    odd = F.col("_swaps") % 2
    # What the state would be without the swaps so far.
    summed = summed.withColumn("_base", F.when(F.col("_sets"), F.col("_out").cast("int").bitwiseXOR(odd.cast("int"))))
    states = carry_last(summed, ["file"], "row_number", ["_base"])
    states = states.withColumn("_inside", F.coalesce("_base", F.lit(0)).bitwiseXOR(odd.cast("int")) == 1)
    # A line that ends inside quotes opened them if it swaps, or if it would first close earlier ones.
    closes = F.concat(F.lit('"'), "text").rlike(f"^{QUOTED}")
    opening = F.when(F.col("_inside") & ((F.col("_swap") == 1) | closes), F.col("row_number"))
    states = stored(states.withColumn("_opening", opening), "states")
    ends = states.groupBy(F.col("file").alias("_file")).agg(
        F.when(F.max_by("_inside", "row_number"), F.max("_opening")).alias("_open_from")
    )
    marked = states.join(F.broadcast(ends), F.col("file") == F.col("_file"), "left").withColumn(
        "_end", (~F.col("_inside") | F.coalesce(F.col("row_number") >= F.col("_open_from"), F.lit(False))).cast("int")
    )
    marked = marked.select("file", "row_number", "encoding", "text", "_end")
    return running_sums(marked, ["file"], ["row_number"], {"_ends": "_end"}).withColumn("_group", F.col("_ends") - F.col("_end"))


def split_records(spark: SparkSession, paths: Sequence[str], sep: str = ",", lower_headers: bool = False) -> DataFrame:
    """What ``delimited_records`` gives, for files too large to read whole."""
    grouped = line_groups(stored(numbered_lines(spark, paths), "lines"), sep)
    ordered = F.array_sort(F.collect_list(F.struct("row_number", "text")))
    texts = grouped.groupBy("file", "encoding", "_group").agg(F.array_join(ordered["text"], "\n").alias("_text"))
    records = F.regexp_extract_all(F.col("_text"), F.lit(_record_pattern(sep)), F.lit(0))
    found = texts.select("file", "encoding", "_group", F.posexplode(records).alias("_place", "_record"))
    rows = stored(row_numbers(found, ["file"], ["_group", "_place"]), "records")
    names = rows.filter(F.col("row_number") == 1).select(
        F.col("file").alias("_file"), _header_names(_unquoted(_fields(F.col("_record"), sep)), lower_headers).alias("_names")
    )
    body = rows.filter(F.col("row_number") > 1).join(names, F.col("file") == F.col("_file"))
    return _by_name(body.select("file", "encoding", "_names", (F.col("row_number") - 1).alias("row_number"), "_record"), sep)


def record_cells(records: DataFrame) -> DataFrame:
    """Records to the cell log; missing cells leave no row."""
    return (
        records.select("file", "row_number", F.explode("cells").alias("column_name", "new_value"))
        .filter(~F.col("new_value").isin(MISSING))
    )


def csv_strings(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """All-string scan of any size, split across tasks; headers normalised, blanks kept as ''.

    Files are read in groups of equal header and put together by name, so their columns may stand in any
    order. Only groups with a line break inside quotes are read file by file. Spark reads no cp1251, so
    those bytes come in as latin-1 and are mapped per column.
    """
    cyrillic = encoding.lower() in ("cp1251", "windows-1251")
    table = str.maketrans(_LATIN, _CYRILLIC)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"),
        "value",
    )
    open_quote = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"), F.max(open_quote).alias("broken"))
    groups: dict[tuple, list[str]] = {}
    for r in heads.collect():  # one row per file, as the driver's file listing has
        groups.setdefault((r["head"], r["broken"]), []).append(r["file"])
    parts = []
    for (_, broken), files in sorted(groups.items()):
        df = spark.read.csv(
            files, header=True, inferSchema=False, sep=sep, quote='"', escape='"', multiLine=broken,
            encoding="ISO-8859-1" if cyrillic else encoding,
        )
        if cyrillic:
            df = df.select(*[F.translate(F.col(f"`{c}`"), _LATIN, _CYRILLIC).alias(c.translate(table)) for c in df.columns])
        parts.append(normalise_headers(df).fillna(""))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).fillna("")


# ---- plain text, JSON, XML, archives -----------------------------------------------------------


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def text_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_number, line): non-blank lines, trimmed, with their original line number."""
    return (
        texts.select(key, F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
        .select(key, (F.col("_pos") + 1).cast("bigint").alias("row_number"), strip(F.col("_line")).alias("line"))
        .filter(F.col("line") != "")
    )


def text_totals(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines and non-blank lines per text, without a shuffle."""
    lines = F.split(text, "\n")
    return texts.select(
        key,
        F.size(lines).cast("bigint").alias("total_rows"),
        F.size(F.filter(lines, lambda x: strip(x) != "")).cast("bigint").alias("processed_rows"),
    )


def _long(df: DataFrame, row_number: Column, column: Column, value: Column) -> DataFrame:
    return df.select(
        "file",
        row_number.cast("bigint").alias("row_number"),
        column.alias("column_name"),
        value.alias("new_value"),
    )


def csv_cells(files: DataFrame) -> DataFrame:
    return record_cells(delimited_records(files))


def tsv_cells(files: DataFrame) -> DataFrame:
    return record_cells(delimited_records(files, sep="\t"))


def txt_cells(files: DataFrame) -> DataFrame:
    lines = text_lines(decode_text(files), "file", "text")
    return _long(lines, F.col("row_number"), F.lit("text_line"), F.col("line"))


def json_cells(files: DataFrame) -> DataFrame:
    """A JSON file is one wide row, whatever its top level is."""
    leaves = flatten.flatten_json(decode_text(files), "text")
    return _long(leaves, F.lit(1), F.col("path"), F.col("value"))


def xml_cells(files: DataFrame) -> DataFrame:
    """Every text node and attribute is a row with path, value and attributes."""
    nodes = flatten.flatten_xml(decode_text(files), "text")
    return _long(
        nodes.select("file", "pos", F.explode(F.create_map(
            F.lit("path"), F.col("path"), F.lit("value"), F.col("value"),
            F.lit("attributes"), F.to_json("attributes"),
        )).alias("column_name", "new_value")),
        F.col("pos") + 1, F.col("column_name"), F.col("new_value"),
    )


def zip_cells(files: DataFrame) -> DataFrame:
    """Cells of all readable members, the file named ``archive/member``; the others are error rows.

    The archives are expanded once and the members written, each format then reads its own.
    """
    members = stored(flatten.expand_archives(files, "file"), "members").withColumn("file", F.concat_ws("/", "archive", "member"))
    unread = F.when(F.col("error").isNotNull(), F.col("error")).when(
        ~F.col("format").isin(list(MEMBER_READERS)), F.concat(F.lit("no reader for format: "), "format")
    )
    good = members.filter(unread.isNull())
    parts = [
        reader(good.filter(F.col("format") == kind).select("file", F.col("bytes").alias("content")))
        for kind, reader in MEMBER_READERS.items()
    ]
    errors = members.filter(unread.isNotNull()).select("file", unread.alias("reason"))
    return reduce(DataFrame.union, [*parts, _long(errors, F.lit(0), F.lit(ERROR), F.col("reason"))])


def csv_split(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return record_cells(split_records(spark, paths))


def tsv_split(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return record_cells(split_records(spark, paths, sep="\t"))


def txt_split(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    lines = numbered_lines(spark, paths).withColumn("line", strip(F.col("text"))).filter(F.col("line") != "")
    return _long(lines, F.col("row_number"), F.lit("text_line"), F.col("line"))


# Format -> reader; add an entry to support another format.
MEMBER_READERS: Mapping[str, Callable[[DataFrame], DataFrame]] = {
    "csv": csv_cells,
    "tsv": tsv_cells,
    "txt": txt_cells,
    "json": json_cells,
    "xml": xml_cells,
}
READERS = {**MEMBER_READERS, "zip": zip_cells}
# Format -> reader of files that are too large to be read as a whole.
SPLIT: Mapping[str, Callable[[SparkSession, Sequence[str]], DataFrame]] = {"csv": csv_split, "tsv": tsv_split, "txt": txt_split}


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cell log of a folder; every file goes to the reader of its format or is a row with the reason."""
    parts = [reader(binary_files(spark, path, kind)) for kind, reader in READERS.items()]
    for kind, reader in SPLIT.items():
        if paths := large_files(spark, path, kind):
            parts.append(reader(spark, paths))
    return reduce(DataFrame.union, [*parts, refused_files(spark, path)])


def union_sheets(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """Tagged inputs put together by column name; absent columns are null."""
    tagged = [df.withColumn("_sheet_name", F.lit(name)) for name, df in sheets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
