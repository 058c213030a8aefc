"""Byte-pair encoding and decoding with published vocabularies, as the tokenizers library does it.

Texts are cut at white space; every distinct piece of a batch that is not known yet is split into
words, and the words of the whole batch are merged together: their symbols lie in one flat numpy
array, each round finds the lowest-rank pair of every word by binary search over the sorted pair
keys and merges it everywhere at once. Words that recur come from a bounded cache.

Null text gives no ids, as the empty text does. Texts are never cut short; ties cannot occur because
ranks are unique, and equal pairs in one word merge from the left. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Collection, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, types as T

from tallyroll.llm.common import slices

# The split patterns of the two vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Separators that str.split() takes for white space and Unicode does not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
DOUBLE_SPACE = re.compile(r"\s\s|\A\s|\s\Z")
NO_RANK = np.iinfo(np.int64).max
CACHED = 300_000
MARKS = ".,;:!?"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """One vocabulary file: ids, merge ranks and how its texts are cut."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.lower = spec["normalizer"] is not None
        self.words = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        letters = byte_letters()
        self.letter_ids = np.array([vocab[c] for c in letters], np.int64)
        self.last_ids = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.letters = {c: bytes([i]) for i, c in enumerate(letters)}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word ends."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.letter_ids[flat]
        ids[ends - 1] = self.last_ids[flat[ends - 1]]
        word = np.repeat(np.arange(len(raw)), np.diff(ends, prepend=0))
        done_ids, done_words = [], []
        rank = np.full(len(ids), NO_RANK)
        if len(ids) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self.rank_of(ids[:-1], ids[1:]), NO_RANK)
        while len(ids):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(word))
            ready = least == NO_RANK
            if ready.any():
                out = np.repeat(ready, sizes)
                done_ids.append(ids[out])
                done_words.append(word[out])
                ids, word, rank = ids[~out], word[~out], rank[~out]
                least, sizes = least[~ready], sizes[~ready]
                if not len(ids):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            # In a run of overlapping pairs every second one merges, from the left.
            new_run = np.diff(at, prepend=-2) != 1
            run = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            ids, word, rank = ids[keep], word[keep], rank[keep]
            for place in (moved[at], moved[at] - 1):
                place = place[place >= 0]
                right = np.minimum(place + 1, len(ids) - 1)
                joined = (place + 1 < len(ids)) & (word[place] == word[right])
                rank[place] = np.where(joined, self.rank_of(ids[place], ids[right]), NO_RANK)
        if not done_ids:
            return np.empty(0, np.int64), ends
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return ids[order], np.cumsum(np.bincount(word, minlength=len(raw)))


def pieces_of(text: str, lower: bool) -> list[str]:
    """Cut at white space, so that no word of the pattern crosses a cut.

    With ``lower`` the text is normalised first and white space goes. Otherwise the pieces are those of
    the text after one more line break, which the caller drops again. A cut lies before a space or line
    break that visible characters surround; a word stands for itself after a space, a word after a line
    break begins with it, and other pieces follow two line breaks as they are (see ``spelled``).
    """
    if lower:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return regex.split(r"\s+", text) if ODD_SPACE.search(text) else text.split()
    if text and not DOUBLE_SPACE.search(text):
        return ("\n" + text).replace("\n", " \n").split(" ")[1:]
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return ["\n", *("\n\n" + p for p in out if p)]


def spelled(piece: str, lower: bool) -> str:
    """The text that a piece without ``lower`` stands for."""
    if lower or (piece[:1] == "\n" and piece[:2] != "\n\n"):
        return piece
    return piece[2:] if piece[:2] == "\n\n" else " " + piece


class Codec:
    """Encodes and decodes batches of texts; keeps two generations of recent pieces.

    With ``library`` a byte vocabulary's new pieces go to tiktoken one by one instead of the merge rounds,
    for callers that need ids only and need them fast. The ids are the same.
    """

    def __init__(self, path: str, library: bool = False):
        self.vocabulary = v = Vocabulary(path)
        self.piece_ids = None
        if library and not v.lower:
            ranks = {b"".join(map(v.letters.__getitem__, t)): i for i, t in enumerate(v.names) if t and t not in v.special}
            coder = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.piece_ids = coder.encode_ordinary
            self.marks = {c: array("I", coder.encode_ordinary(c)).tobytes() for c in MARKS}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids_of(self, piece: str) -> bytes:
        """Ids of a piece by the library; a mark after a word is a word of its own."""
        if piece[-1:] in MARKS and piece[:-1].isalpha():
            word = self.young.get(piece[:-1]) or self.old.get(piece[:-1])
            if word is not None:
                return word + self.marks[piece[-1]]
        return array("I", self.piece_ids(spelled(piece, False))).tobytes()

    def learn(self, missing: Collection[str]) -> None:
        """Put the ids of pieces that are not in ``young`` there, as little-endian 32-bit integers."""
        v = self.vocabulary
        if len(self.young) + len(missing) > CACHED:
            self.old, self.young = self.young, {}
        new, cuts = [], []
        for piece in missing:
            known = self.old.get(piece)
            if known is not None:
                self.young[piece] = known
            elif self.piece_ids:
                self.young[piece] = self.ids_of(piece)
            else:
                text = spelled(piece, v.lower)
                found = [text] if text[text[:1] == " " :].isalpha() else v.words.findall(text)
                cuts.append((piece, len(found)))
                new += found
        if not cuts:
            return
        distinct = list(dict.fromkeys(new))
        ids, ends = v.merge(distinct) if distinct else (np.empty(0, np.int64), [])
        raw = ids.astype("<u4").tobytes()
        begin, of_word = 0, {}
        for w, end in zip(distinct, ends):
            of_word[w] = raw[4 * begin : 4 * end]
            begin = end
        at = 0
        for piece, n in cuts:
            self.young[piece] = of_word[new[at]] if n == 1 else b"".join(map(of_word.__getitem__, new[at : at + n]))
            at += n

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        v, cut = self.vocabulary, []
        for text in texts:
            parts = [text or ""]
            if any(s in parts[0] for s in v.special):
                parts = v.split_special.split(parts[0])
            cut.append([p if p in v.special else pieces_of(p, v.lower) for p in parts])
        known, gaps, missing = [], [], set()
        for parts in cut:
            for p in parts:
                found = [] if isinstance(p, str) else list(map(self.young.get, p))
                holes = [i for i, x in enumerate(found) if x is None]
                missing.update([p[i] for i in holes])
                known.append(found)
                gaps.append(holes)
        self.learn(missing)
        out, at, skip = [], 0, 0 if v.lower else 4  # the line break in front
        for parts in cut:
            whole = []
            for p, found, holes in zip(parts, known[at : at + len(parts)], gaps[at : at + len(parts)]):
                for i in holes:
                    found[i] = self.young[p[i]]
                whole.append(v.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(found)[skip:])
            out.append(b"".join(whole))
            at += len(parts)
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids, special tokens kept: names joined by spaces, or bytes where the file names no word ends."""
        v = self.vocabulary
        if v.suffix:
            return " ".join(map(v.names.__getitem__, ids))
        out, held = [], []
        for i in ids:
            held.append(v.names[i])
            if v.names[i] in v.special:
                out += [self._bytes("".join(held[:-1])), held[-1]]
                held = []
        return "".join([*out, self._bytes("".join(held))])

    def _bytes(self, letters: str) -> str:
        return b"".join(map(self.vocabulary.letters.__getitem__, letters)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, library: bool = False) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(path, library)


def encode_decode(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, decoded) of every row; ``tokenizer`` is the path of a vocabulary file on every machine.

    Other columns of ``df`` are not read, so their names cannot clash. Repeated rows give repeated results.
    """
    kept = df.select(df[id_column].alias("id"), df[text].cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_column, kept.schema["id"].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for part in slices(batches, 1):
            raw = coder.encode(part.column(1).to_pylist())
            flat = np.frombuffer(b"".join(raw), "<i4")
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            decoded = [coder.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], names=schema.names)

    return kept.mapInArrow(work, schema)
