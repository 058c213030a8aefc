"""The registered query of every operator, over its whole table, with its DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyroll.llm import ann, audit, bpe, lines, lm, mixing, packing, pii, quality, resample, simhash, urls, warc
from tallyroll.llm.common import prepare
from tallyroll.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a function of (spark, sf_dir) by its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, written and read back."""
    path = scratch_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    found = warc.read_archives(spark, path, payload=False)
    number = F.lit(len(warc.ID_PREFIX) + 1)

    def page(name: str) -> Column:
        return F.try_to_number(F.col(name).substr(number, F.length(name)), F.lit("S9999999999999999999")).cast("long")

    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


ORACLES["op1_warc"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), q AS (
    SELECT *, max(page_id) OVER (PARTITION BY hex) AS last_id,
        list_transform(range(0, 40, 5), lambda i: ('0x' || hex[i + 1:i + 5])::BIGINT) AS twenty
    FROM p
)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32),
        lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((twenty[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM q
"""


@query
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every fiftieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


# Words that name the usual categories of public blocklists.
SEEDS = ["ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam"]


def seeded(pages: DataFrame) -> DataFrame:
    """Labelled urls: 1 where a word of the host is a seed, else 0."""
    words = F.split(urls.host_of(F.col("url")), "[.-]")
    return pages.select("url", F.arrays_overlap(words, F.array(*map(F.lit, SEEDS))).cast("int").alias("label"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, labelled=seeded(pages), keep=["page_id"])


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: where each piece of a document lies."""
    return packed(table(spark, sf_dir, "documents"))


def packed(documents: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(documents, public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, ["doc_id", "piece"])


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2, keep=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# A key for these tables; a real one comes from the caller and stays out of the code.
PSEUDONYM_KEY = b"tallyroll test key"


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms, and what was found in them."""
    masked = pii.with_pseudonyms(table(spark, sf_dir, "documents"), PSEUDONYM_KEY, keep=["doc_id", "text"])
    kinds = F.array_join(F.array_sort(F.transform("pii", lambda x: x["kind"])), ",")
    return masked.select("doc_id", "text", F.size("pii").cast("long").alias("n_found"), kinds.alias("kinds"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on five sites or more, but for their first occurrence."""
    return lines.without_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


ORACLES["op8_line_dedup"] = """
WITH l AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place
    FROM documents
), c AS (
    SELECT line, min((doc_id, place)) AS first FROM l
    WHERE length(line) >= 20 AND regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 5
), m AS (
    SELECT l.*, c.first IS NOT NULL AND (l.doc_id, l.place) <> c.first AS gone FROM l LEFT JOIN c ON l.line = c.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text,
    count(*) FILTER (WHERE gone) AS removed_lines
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, text, 0 FROM documents WHERE text IS NULL
"""


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    return lm.score(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and outlier verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, per language."""
    counts, names = audit.patterns(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.interactions(counts, names)


ORACLES["op11_filter_audit"] = """
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), l AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), firsts AS (
    SELECT text, min(doc_id) AS first FROM d GROUP BY text
), m AS (
    SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
        (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
        + 4 * (100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * len(d.text))::INT
        + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > firsts.first, false)::INT AS mask
    FROM d JOIN firsts ON d.text = firsts.text LEFT JOIN l ON d.doc_id = l.doc_id
), p AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
    SELECT filter_order, step, filter_order[step] AS filter, bits[step] AS bit, list_sum(bits[:step - 1])::INT AS before
    FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)
), counted AS (
    SELECT part, filter_order, step, filter, coalesce(before, 0) AS earlier, bit,
        sum(n) FILTER (WHERE mask & (coalesce(before, 0) | bit) = 0) AS kept,
        sum(n) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit <> 0) AS removed,
        sum(n) FILTER (WHERE mask & coalesce(before, 0) <> 0 AND mask & bit <> 0) AS redundant,
        sum(n) FILTER (WHERE mask = bit) AS unique_fails,
        sum(good) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit <> 0) AS good_lost,
        sum(toxic) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit <> 0) AS toxic_lost
    FROM p, steps GROUP BY ALL
)
SELECT part, filter_order, step, filter, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
    coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""


@query
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix by source weights takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op12_source_mixing"] = """
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
        ('0x' || substr(md5('12:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
        [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
    FROM d GROUP BY source
), levels AS (
    SELECT 0 AS round, sum(source_size)::DOUBLE / sum(weight)::DOUBLE AS level FROM s
    UNION ALL
    SELECT round + 1, next FROM (
        SELECT round, level, (sum(source_size)::BIGINT - coalesce(sum(cap) FILTER (WHERE cap <= weight * level), 0)::BIGINT)::DOUBLE
            / (sum(weight) FILTER (WHERE NOT cap <= weight * level))::DOUBLE AS next
        FROM levels, s GROUP BY round, level
    ) WHERE next > level
), plan AS (
    SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT max(level) FROM levels)) AS target FROM s
), need AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats,
        greatest(floor(target + 0.5)::BIGINT - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size, 0) AS more
    FROM plan
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    (repeats * size + greatest(0, least(size, more + size - sum(size) OVER (PARTITION BY d.source ORDER BY place, size ROWS UNBOUNDED PRECEDING))))::BIGINT AS taken
FROM d JOIN need ON d.source IS NOT DISTINCT FROM need.source
"""


@query
def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by their likeness to the benchmark."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 is linear: a feature's value is the exclusive or of one value per byte and its distance from the end.
ORACLES["op13_target_resampling"] = """
WITH RECURSIVE words AS (
    SELECT kind, id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)
), each AS (
    SELECT kind, id, unnest(w) AS a, unnest(list_concat(w[2:], [NULL])) AS b FROM words WHERE len(w) > 0
), uses AS (
    SELECT kind, id, a AS f, count(*) AS n FROM each GROUP BY ALL
    UNION ALL SELECT kind, id, a || ' ' || b, count(*) FROM each WHERE b IS NOT NULL GROUP BY ALL
), features AS (
    SELECT f, octet_length(encode(f)) AS size, hex(encode(f)) AS hex FROM (SELECT DISTINCT f FROM uses)
), bits AS (
    SELECT range AS byte, range AS c, 0 AS k FROM range(256)
    UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
    SELECT byte, c FROM bits WHERE k = 8
), far AS (
    SELECT 0 AS dist, byte, c FROM crc
    UNION ALL SELECT dist + 1, far.byte, xor(far.c >> 8, crc.c) FROM far JOIN crc ON crc.byte = far.c & 255
    WHERE dist + 1 < (SELECT max(size) FROM features)
), init AS (
    SELECT 0 AS size, 4294967295::BIGINT AS c
    UNION ALL SELECT size + 1, xor(init.c >> 8, crc.c) FROM init JOIN crc ON crc.byte = init.c & 255
    WHERE size < (SELECT max(size) FROM features)
), spelt AS (
    SELECT f, size, hex, unnest(range(size)) AS i FROM features
), hashed AS (
    SELECT spelt.f, xor(xor(bit_xor(far.c), any_value(init.c)), 4294967295::BIGINT) % 10000 AS bucket
    FROM spelt JOIN far ON far.dist = spelt.size - 1 - spelt.i AND far.byte = ('0x' || substr(spelt.hex, 1 + 2 * spelt.i, 2))::BIGINT
    JOIN init ON init.size = spelt.size
    GROUP BY spelt.f
), filled AS (
    SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE kind = 'b'), 0)::BIGINT AS t
    FROM uses JOIN hashed ON uses.f = hashed.f GROUP BY bucket
), gain AS (
    SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM filled)::BIGINT + 10000))::DOUBLE
        / ((s + 1) * ((SELECT sum(t) FROM filled)::BIGINT + 10000))::DOUBLE))::BIGINT AS g
    FROM filled
), per AS (
    SELECT id, sum(n * g)::BIGINT AS total FROM uses JOIN hashed ON uses.f = hashed.f JOIN gain ON hashed.bucket = gain.bucket
    WHERE kind = 'd' GROUP BY id
), scored AS (
    SELECT id AS doc_id, len(w) AS n_words, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features,
        CASE WHEN len(w) > 0 THEN (total - ((total % (2 * len(w) - 1)) + (2 * len(w) - 1)) % (2 * len(w) - 1)) // (2 * len(w) - 1) ELSE 0 END::BIGINT AS weight,
        floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS gumbel
    FROM words LEFT JOIN per USING (id) WHERE kind = 'd'
), ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY weight + gumbel DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, weight + gumbel AS score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
