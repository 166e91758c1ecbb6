"""Token ids in ORC files: encoding, range-ordered writing and stripe-parallel reading.

Documents are encoded once, dealt by ranges of their id, and written as ORC with integer run-length encoding, a row
index for every ROW_INDEX rows and Bloom filters on the document id, so a search for few documents skips files, stripes
and row groups by their metadata, and large files are read by several tasks. Files and the rows in them ascend by
document id; equal ids ascend by number of ids and their checksum. The start of a document is the number of ids of all
documents before it: one sum per file, and a running sum within each.

Texts are cut at white space and between ASCII letters and other ASCII signs, where the tokenizer's own rules cut as
well; each worker has the library encode every different part once. Texts that hold a special token's name, and other
tokenizers, go to the library whole.

Defined results. A null or empty text has the end id alone. A null document id sorts first. Repeated rows are separate
documents. Very long texts are encoded whole; rows of one id, however many, are in one file. An empty table gives an empty file
set and no rows. Only the two columns named are read.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

from patronage.llm.common import column_ref, one_at_a_time, ship, sub_batches, table, written
from patronage.llm.words import _Numbers
from patronage.sources.durable import scratch_path

MODEL = "word_bpe_49k.json"
END_ID = 2
ROW_INDEX = 10_000
STRIPE_BYTES = 64 << 20
#: Parts kept with their ids by one worker, the first to occur. Further ones are encoded once for each step.
CACHED_PARTS = 250_000
STEP_BYTES = 4 << 20
#: What `word_bpe` tokenizers cut by; parts are cut only where this cuts too.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of ASCII and Latin-1; or digits; or ASCII signs but the apostrophe; or all that is left of a part.
_WORD = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++(?![\x80-\xff])"
#: Parts hold no blank, so a blank stands between them.
_CUT = re.compile(_WORD + rb"|[0-9]++(?![\x80-\xff])|[\x00-\x08\x0e-\x1f!-&(-/:-@\[-`{-\x7f]++(?!['\x80-\xff])|[^ ]+| ", re.S)
_IS_WORD = re.compile(_WORD)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class CodedTable:
    """Ids of different byte strings, each encoded once; the first CACHED_PARTS stay, later ones are for one step."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode, self.numbers = encode, _Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def look_up(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all items one after another, and the n + 1 offsets between items."""
        known, used = len(self.numbers), self.used
        which = np.fromiter(map(self.numbers.__getitem__, items), np.int64, len(items))
        added = list(itertools.islice(self.numbers, known, None))
        if added:
            self._add(*self.encode(added), known)
        sizes = self.size[which]
        at = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.arange(at[-1]) + np.repeat(self.start[which] - at[:-1], sizes)]
        if len(self.numbers) > CACHED_PARTS:
            for item in added:
                del self.numbers[item]
            self.used = used
        return ids, at

    def _add(self, ids: np.ndarray, sizes: np.ndarray, first: int) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while first + len(sizes) > len(self.size):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[first : first + len(sizes)] = sizes
        self.start[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)


class CachedTokenizer:
    """The library's tokenizer; for the kind it knows how to cut, with a table of parts seen before."""

    def __init__(self, definition: bytes):
        self.library = Tokenizer.from_str(definition.decode())
        config = json.loads(definition)
        normalizers = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (config.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.cuts = normalizers == ["NFC", "Replace", "Lowercase"] and splits[:1] == [_SPLIT]
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in config.get("added_tokens", [])) or rb"(?!)")
        self.signs = {b: self._sign(b) for b in range(0x80, 0x100)}
        self.parts, self.cuts_of = CodedTable(self._encode_parts), CodedTable(self._encode_cuts)

    def _sign(self, byte: int) -> str:
        """The character by which byte-level vocabularies spell a byte above 0x7F."""
        if 0xA1 <= byte <= 0xAC or byte >= 0xAE:
            return chr(byte)
        return chr(0x143 if byte == 0xAD else 0x121 + byte - 0x7F)  # 0x100 and the number of unprintable bytes before

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _encode_cuts(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        encoded: list = [()] * len(cuts)
        tokenize, rest = self.library.model.tokenize, []
        for k, cut in enumerate(cuts):
            if cut == b" ":
                continue
            if not _IS_WORD.fullmatch(cut):
                rest.append(k)
            elif cut.isascii():
                encoded[k] = [t.id for t in tokenize(cut.decode())]
            else:
                encoded[k] = [t.id for t in tokenize(cut.decode().lower().encode().decode("latin-1").translate(self.signs))]
        for k, ids in zip(rest, self._whole([cuts[k].decode() for k in rest]), strict=True):
            encoded[k] = ids
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(itertools.chain.from_iterable(encoded), np.int32, int(sizes.sum())), sizes

    def _encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        cuts = _CUT.findall(b" ".join(parts))
        ids, at = self.cuts_of.look_up(cuts)
        blanks = [k for k, cut in enumerate(cuts) if cut == b" "]
        return ids, np.diff(at[np.array([0, *blanks, len(cuts)])])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n + 1 offsets between texts."""
        words: list[bytes] = []
        counts, whole = [0], {}
        for k, text in enumerate(texts):
            raw = (text or "").encode()
            if not self.cuts or self.special.search(raw):
                whole[k] = text or ""
            else:
                words.extend(raw.translate(_LOWER).split())
            counts.append(len(words))
        ids, at = self.parts.look_up(words)
        at = at[np.array(counts)]
        if whole:
            found = dict(zip(whole, self._whole(list(whole.values())), strict=True))
            lists = [np.array(found[k], np.int32) if k in found else ids[at[k] : at[k + 1]] for k in range(len(texts))]
            ids, at = np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        return ids, at


@one_at_a_time
def _tokenizer(definition: bytes) -> CachedTokenizer:
    return CachedTokenizer(definition)


def _checksums(ids: np.ndarray, at: np.ndarray) -> list[int]:
    raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _with_end(ids: np.ndarray, at: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    if end_id is None:
        return ids, at
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def encoder(spark: SparkSession, tokenizer: str, end_id: int | None = END_ID):
    """A column function from text to its ids and their checksum."""
    ship(spark)
    definition = Path(tokenizer).read_bytes()
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("crc", pa.int64())])

    @arrow_udf("struct<ids: array<int>, crc: bigint>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cached = _tokenizer(definition)
        for texts in batches:
            parts = []
            for step in sub_batches(texts, STEP_BYTES):
                ids, at = _with_end(*cached.encode(step.to_pylist()), end_id)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                parts.append(pa.StructArray.from_arrays([lists, pa.array(_checksums(ids, at), pa.int64())], names=["ids", "crc"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return encode


@arrow_udf(LongType())
def ids_crc32(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Checksum of ids as little-endian unsigned 32-bit integers."""
    for lists in batches:
        ids, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
        yield pa.array(_checksums(ids, at), pa.int64())


def write_token_files(
    documents: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID,
) -> None:
    spark = documents.sparkSession
    rows = documents.select(column_ref(key).alias("doc_id"), column_ref(text).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first())
    coded = rows.select("doc_id", encoder(spark, tokenizer, end_id)("text").alias("coded"))
    ordered = coded.select("doc_id", "coded.*", F.size("coded.ids").alias("n")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "n", "crc"
    )
    ordered.select("doc_id", "ids").write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option(
        "orc.row.index.stride", str(ROW_INDEX)
    ).option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.create.index", "true").option("compression", "zstd").orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids and the number of the file, which ascends with doc_id."""
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"part-(\d+)", 1).cast("long") * 1_000_000
    file = number + F.coalesce(F.try_to_number(F.regexp_extract(name, r"-c(\d+)", 1), F.lit("999999")).cast("long"), F.lit(0))
    return spark.read.orc(path).select("doc_id", "ids", file.alias("file"))


def with_starts(rows: DataFrame, order: list) -> DataFrame:
    """Adds `start`, the sum of n_tokens of all rows before; rows of one file are numbered apart from the others."""
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return running.join(totals, "file").withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark)
    write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path(MODEL))
    found = read_token_files(spark, path).select(
        "doc_id", "file", F.size("ids").cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32")
    )
    rows = with_starts(written(found), [F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32"])
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
