"""Column functions on single values. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

MONEY = "decimal(20,2)"

# Header aliases per field, the first non-blank one wins.
FIELD_ALIASES = {
    "order_number": ["order_number", "номер_заказа", "order_id"],
    "machine_code": ["machine_code", "код_автомата", "machine_id"],
    "order_price": ["order_price", "цена", "price", "amount"],
    "payment_type": ["payment_type", "тип_оплаты", "payment_method"],
    "creation_time": ["creation_time", "дата_создания", "created_at", "date"],
}
# Defaults of a new order.
DEFAULT_MACHINE = "UNKNOWN"
DEFAULT_PAYMENT = "unknown"
DEFAULT_STATUS = "new"
# Patterns a phone, an e-mail and an order number must match.
PHONE_PATTERN = r"^\+?[1-9]\d{1,14}$"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
ORDER_NUMBER_PATTERN = r"^[A-Z0-9]{6,20}$"
# Display texts.
MATCH_LABELS = {"matched": "Сопоставлен", "unmatched": "Не сопоставлен", "partial": "Частично"}
CHANGE_LABELS = {"new": "Новый", "updated": "Обновлён", "filled": "Заполнен"}
SIZE_UNITS = ["Bytes", "KB", "MB", "GB"]
# Days back per date preset (0 is today).
DATE_PRESETS = [0, 1, 7, 30, 90]

# Shape -> formats; day first where dots separate, month first where slashes do if the month allows it.
# The shape is tested first, since a failed parse costs far more than a pattern.
CLOCK_SHAPE, ZONE_SHAPE = r"( \d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?", r" ?(Z|z|UTC|[+-]\d{2}(:?\d{2})?)"
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}" + CLOCK_SHAPE
DATE_FORMATS = {
    r"^\d{1,2}\.\d{1,2}\.\d{4}": ["d.M.yyyy"],
    r"^\d{4}\.\d{1,2}\.\d{1,2}": ["yyyy.M.d"],
    r"^\d{1,2}/\d{1,2}/\d{4}": ["M/d/yyyy", "d/M/yyyy"],
    r"^\d{4}/\d{1,2}/\d{1,2}": ["yyyy/M/d"],
}


def parse_price(text: Column) -> Column:
    """Price text to MONEY; unreadable text is 0, a number too large for MONEY is null.

    The sign is lost and two dots give 0.
    """
    digits = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[^0-9.]", "")
    readable = digits.rlike(r"^(\d+\.?\d*|\.\d+)$")
    return F.when(readable, digits.try_cast(MONEY)).otherwise(F.lit(0).cast(MONEY))


def parse_time(text: Column, as_of: Column | None = None) -> Column:
    """First format that fits, in UTC if a zone is given; otherwise ``as_of`` (null when not given), never the wall clock."""
    clean = F.regexp_replace(F.replace(F.trim(text), F.lit(","), F.lit(".")), r"(?<=\d)T(?=\d)", " ")
    parsed = F.when(clean.rlike(ISO_SHAPE + "$"), clean.try_cast("timestamp_ntz"))
    # Spark reads zones as +hh:mm.
    zoned = F.regexp_replace(F.regexp_replace(clean, r" ?(z|UTC)$", "Z"), r" ?([+-]\d{2}):?(\d{2})?$", "$1:$2")
    zoned = F.regexp_replace(zoned, r":$", ":00").try_cast("timestamp")
    parsed = parsed.when(clean.rlike(ISO_SHAPE + ZONE_SHAPE + "$"), F.to_utc_timestamp(zoned, F.current_timezone()).cast("timestamp_ntz"))
    clock = F.regexp_extract(clean, r" (.*)$", 1)
    clock = F.when(clock == "", "00:00:00").when(clock.rlike(r"^\d{1,2}:\d{2}$"), F.concat(clock, F.lit(":00"))).otherwise(clock)
    day = F.regexp_extract(clean, r"^(\S+)", 1)
    for shape, forms in DATE_FORMATS.items():
        date = F.coalesce(*[F.try_to_timestamp(day, F.lit(f)) for f in forms])
        whole = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), clock)
        parsed = parsed.when(clean.rlike(shape + CLOCK_SHAPE + "$"), whole.try_cast("timestamp_ntz"))
    return parsed if as_of is None else F.coalesce(parsed, as_of.cast("timestamp_ntz"))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def first_present(columns: Sequence[str], aliases: Sequence[str]) -> Column:
    """First non-blank of the aliases that exist among the columns."""
    found = [F.when(F.trim(F.col(f"`{a}`")) != "", F.col(f"`{a}`")) for a in aliases if a in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def filled_cells(cells: Column) -> Column:
    """The cells of a header -> text map that are not blank."""
    return F.map_filter(cells, lambda name, text: F.trim(text) != "")


def first_cell(filled: Column, aliases: Sequence[str]) -> Column:
    """First alias among the filled cells, where every row may have other headers."""
    return F.trim(F.coalesce(*[filled[a] for a in aliases]))


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def surrogate_number(file: Column, row_number: Column) -> Column:
    """Order number for a row without one, unique per file and row."""
    return F.concat(F.lit("AUTO_"), F.substring(F.sha2(file.cast("string"), 256), 1, 16), F.lit("_"), row_number.cast("string"))


def with_defaults(df: DataFrame, as_of: Column, file: str = "file", row_number: str = "row_number") -> DataFrame:
    return df.withColumns(
        {
            "order_number": F.coalesce(blank_to_null(F.col("order_number")), surrogate_number(F.col(file), F.col(row_number))),
            "machine_code": F.coalesce(blank_to_null(F.col("machine_code")), F.lit(DEFAULT_MACHINE)),
            "order_price": F.coalesce(F.col("order_price"), F.lit(0).cast(MONEY)),
            "payment_type": F.coalesce(blank_to_null(F.col("payment_type")), F.lit(DEFAULT_PAYMENT)),
            "creation_time": F.coalesce(F.col("creation_time"), as_of.cast("timestamp_ntz")),
            "match_status": F.lit(DEFAULT_STATUS),
        }
    )


def shorten(text: Column, width: int) -> Column:
    """Cut to ``width`` characters and mark the cut with three dots."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def human_size(size: Column) -> Column:
    """Rounded size with its unit; GB is the largest one."""
    text = F.concat(size.cast("string"), F.lit(" " + SIZE_UNITS[0]))
    for power in range(1, len(SIZE_UNITS)):
        scaled = F.floor(size / F.lit(float(1024**power)) + 0.5).cast("string")
        text = F.when(size >= 1024**power, F.concat(scaled, F.lit(" " + SIZE_UNITS[power]))).otherwise(text)
    return text


def currency_text(amount: Column) -> Column:
    """Russian grouping with the currency code; nothing or zero shows a dash."""
    grouped = F.translate(F.format_number(amount.cast("decimal(18,2)"), 2), ",.", "\u00a0,")
    return F.when(amount.isNull() | (amount == 0), F.lit("-")).otherwise(F.concat(grouped, F.lit("\u00a0UZS")))


def local_time_text(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "dd.MM.yyyy, HH:mm:ss"), F.lit("-"))


def page_count(total: Column, size: int) -> Column:
    return F.floor((total + (size - 1)) / size).cast("bigint")


def first_index(page: Column, size: int) -> Column:
    return (page - 1) * size + 1


def last_index(page: Column, size: int, total: Column) -> Column:
    return F.least(page * size, total)


def visible_pages(page: Column, pages: Column) -> Column:
    """Page numbers within two of the current one; empty when there are none."""
    low, high = F.greatest(F.lit(1).cast("bigint"), page - 2), F.least(pages, page + 2)
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def preset_ranges(as_of: Column) -> Column:
    """Array of (days, date_from, date_to) for every preset."""
    today = as_of.cast("date")
    return F.array(
        *[
            F.struct(F.lit(d).alias("days"), F.date_sub(today, d).alias("date_from"), today.alias("date_to"))
            for d in DATE_PRESETS
        ]
    )


def or_default(value: Column, default: str = "Unknown") -> Column:
    return F.coalesce(blank_to_null(value), F.lit(default))


def label_of(code: Column, labels: Mapping[str, str]) -> Column:
    """Display text of a code; unknown codes show as they are."""
    out = None
    for key, text in labels.items():
        out = F.when(code == key, text) if out is None else out.when(code == key, text)
    return out.otherwise(code)


def iso_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def as_text(value: Column) -> Column:
    """Text form for comparing and logging; null is blank."""
    return F.coalesce(value.cast("string"), F.lit(""))


def export_name(order_number: Column, as_of: Column, extension: str) -> Column:
    stamp = F.date_format(as_of, "yyyyMMdd_HHmmss")
    return F.concat(F.lit("export_"), order_number, F.lit("_"), stamp, F.lit("." + extension))


def temporary_number(session_id: Column, file_id: Column) -> Column:
    return F.concat_ws("_", F.lit("TEMP"), session_id.cast("string"), file_id.cast("string"))
