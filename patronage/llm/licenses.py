"""Licence scans: MinHash bands over overlapping windows of words find notices, exact containment verifies them.

All work is done by SQL functions. Words are runs of digits, letters a-z (A-Z lowered) and characters above 0x7F. A
notice's shingles are its distinct runs of SHINGLE words, or of all its words if it has fewer. Notices of similar length
form a class; each text is cut into windows a quarter longer than the class's longest notice, a quarter of it apart, so
every stretch of a notice's length lies within a window whole. A window matches a notice if it holds at least
MIN_CONTAINED hundredths of its shingles.

A window that matches shares at least a share `least_similarity` of the union of its and the notice's shingles. Each
band is one MinHash value; as many bands are taken as make the chance that none agrees smaller than MISSED. Before
hashing, windows without any word that a match needs are left out: every shingle of every notice holds one of the
anchor words, so this loses nothing.

Defined results: a row for each document and notice that match, with the largest number of the notice's shingles in one
window and the first word of the first such window. Null, empty and wordless texts match nothing. Rows of one id count as one document; a
null id is an id of its own. Empty tables give an empty result. Only id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import column_ref, table
from patronage.llm.license_texts import NOTICES

SHINGLE = 5
MIN_CONTAINED = 80
MISSED = 1e-4
#: Notices whose lengths are at least this share of the longest one's form a class.
CLASS_RATIO = 0.8
#: Characters of all notices, which go into the query as literals.
MAX_NOTICE_CHARS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def notice_words(text: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in lowered).split(" ")


def shingles_of(text: str) -> list[str]:
    words = [w for w in notice_words(text) if w]
    size = min(SHINGLE, len(words))
    return sorted({" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}) if words else []


def classes_of(notices) -> list[dict]:
    """Notices of one shingle size and similar length, with their windows and bands."""
    if sum(len(text) for _, _, text in notices) > MAX_NOTICE_CHARS:
        raise ValueError(f"the notices have more than {MAX_NOTICE_CHARS} characters")
    lengths = {}
    for name, licence, text in notices:
        count = sum(1 for w in notice_words(text) if w)
        if count:
            lengths.setdefault(min(SHINGLE, count), []).append((count, name, licence, text))
    found = []
    for size, group in sorted(lengths.items()):
        group.sort()
        while group:
            longest = group[-1][0]
            mine = [g for g in group if g[0] >= CLASS_RATIO * longest]
            group = group[: len(group) - len(mine)]
            stride = 1 if longest < 8 else longest // 4
            window = longest + stride - 1 if stride > 1 else longest
            fewest = min(len(shingles_of(g[3])) for g in mine)
            kept = math.ceil(fewest * MIN_CONTAINED / 100)
            similar = kept / (window - size + 1 + fewest - kept)
            bands = 1 if similar >= 1 else max(1, math.ceil(math.log(MISSED) / math.log(1 - similar)))
            found.append({"size": size, "window": window, "stride": stride, "bands": bands, "least_similarity": similar, "notices": mine})
    return found


def anchors_of(shingles: list[str], frequent: dict[str, int]) -> list[str]:
    """Words of which every shingle holds one; rare ones where there is a choice."""
    left, chosen = [set(s.split(" ")) for s in shingles], []
    while left:
        counts: dict[str, int] = {}
        for words in left:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        best = max(counts, key=lambda w: (counts[w] / (1 + 20 * frequent.get(w, 0)), len(w), w))
        chosen.append(best)
        left = [words for words in left if best not in words]
    return sorted(chosen)


#: Words too common to be anchors if there is a choice. Fixed values.
COMMON = {w: 1 for w in "a all an and any are as at by for from in is it of on or that the this to with you your".split()}


def words_column(text: Column) -> Column:
    """The text's words."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NO_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of the distinct shingles of an array of words; no shingle in fewer words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " "))))


def _bands(hashes: Column, bands: int) -> Column:
    """MinHash values, one to a band."""
    least = lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))))
    return F.array(*[least(k) for k in range(bands)])


def templates(spark: SparkSession, classes: list[dict]) -> DataFrame:
    """class, template, licence, the hashes of its shingles and its bands; one row for each band."""
    rows = []
    for number, c in enumerate(classes):
        for _, name, licence, text in c["notices"]:
            hashes = F.array(*[F.xxhash64(F.lit(s)) for s in shingles_of(text)])
            rows.append(
                spark.range(1).select(
                    F.lit(number).alias("class"), F.lit(name).alias("template"), F.lit(licence).alias("licence"),
                    hashes.alias("template_shingles"), F.posexplode(_bands(hashes, c["bands"])).alias("band", "value"),
                )
            )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def windows(words: Column, classes: list[dict]) -> Column:
    """All windows of all classes that hold an anchor word: structs of class, start (from 0) and words."""
    return F.concat(*[_class_windows(words, number, c) for number, c in enumerate(classes)])


def _class_windows(words: Column, number: int, c: dict) -> Column:
    anchors = _words(anchors_of([s for n in c["notices"] for s in shingles_of(n[3])], COMMON))
    last = F.greatest(F.lit(0), F.size(words) - c["window"] + c["stride"] - 1)
    starts = F.sequence(F.lit(0), last, F.lit(c["stride"]))
    cut = F.transform(
        starts, lambda i: F.struct(F.lit(number).alias("class"), i.alias("start"), F.slice(words, i + 1, c["window"]).alias("words"))
    )
    return F.filter(cut, lambda w: F.arrays_overlap(w["words"], anchors))


def scan(documents: DataFrame, *, key: str = "doc_id", text: str = "text", notices=NOTICES) -> DataFrame:
    """key, template, licence, contained, shingles (both numbers), start (word) of every match."""
    spark = documents.sparkSession
    classes = classes_of(notices)
    anchors = anchors_of([s for c in classes for n in c["notices"] for s in shingles_of(n[3])], COMMON)
    rows = documents.select(column_ref(key).alias("key"), words_column(column_ref(text)).alias("words"))
    rows = rows.where(F.arrays_overlap("words", _words(anchors)))
    cut = rows.select("key", F.explode(windows(F.col("words"), classes)).alias("w")).select("key", "w.class", "w.start", "w.words")
    hashes, bands = F.array().cast("array<bigint>"), F.array().cast("array<bigint>")
    for number, c in enumerate(classes):
        hashes = F.when(F.col("class") == number, _shingle_hashes(F.col("words"), c["size"])).otherwise(hashes)
    hashed = cut.select("key", "class", "start", hashes.alias("shingles")).where(F.size("shingles") > 0)
    for number, c in enumerate(classes):
        bands = F.when(F.col("class") == number, _bands(F.col("shingles"), c["bands"])).otherwise(bands)
    banded = hashed.select("key", "class", "start", "shingles", F.posexplode(bands).alias("band", "value"))
    found = banded.join(templates(spark, classes), ["class", "band", "value"])
    contained = F.size(F.array_intersect("shingles", "template_shingles")).cast("long")
    total = F.size("template_shingles").cast("long")
    matched = found.select("key", "template", "licence", contained.alias("contained"), total.alias("shingles"), F.col("start").cast("long"))
    matched = matched.where(100 * F.col("contained") >= MIN_CONTAINED * F.col("shingles"))
    best = F.min(F.struct((-F.col("contained")).alias("n"), "start"))
    grouped = matched.groupBy("key", "template", "licence", "shingles").agg(best.alias("best"))
    return grouped.select(F.col("key").alias(key), "template", "licence", (-F.col("best.n")).alias("contained"), "shingles", F.col("best.start").alias("start"))


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))


#: Window and stride for each notice, as the query uses them. Fixed values, which the SQL does not get from the query.
_SQL_WINDOWS = {
    "mit-line": (5, 1),
    "mit-licensed-line": (15, 3),
    "apache-line": (9, 2),
    "gpl3-line": (15, 3),
    "cc-by-nc-line": (9, 2),
    "cc-by-line": (15, 3),
    "all-rights-line": (3, 1),
    "mit-permission": (89, 18),
    "apache-header": (89, 18),
    "gpl-header": (51, 10),
    "bsd-conditions": (25, 5),
    "isc-permission": (51, 10),
}


def _op7_sql() -> str:
    """Every window of every class against every notice, without anchors or bands. Words and shingles of the notices are
    made by the SQL itself."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [f"({quoted(name)}, {quoted(licence)}, {_SQL_WINDOWS[name][0]}, {_SQL_WINDOWS[name][1]}, {quoted(text)})" for name, licence, text in NOTICES]
    return rf"""
WITH notices(template, licence, win, stride, text) AS (VALUES {', '.join(rows)}),
nw AS (
  SELECT template, licence, win, stride, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM notices),
ns AS (
  SELECT DISTINCT template, licence, win, stride, least(5, len(w)) AS size, array_to_string(w[q + 1 : q + least(5, len(w))], ' ') AS g
  FROM (SELECT *, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS q FROM nw)),
t AS (SELECT *, count(*) OVER (PARTITION BY template) AS shingles FROM ns),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT size FROM t),
p AS (
  SELECT doc_id, n, size, q, array_to_string(w[q + 1 : q + size], ' ') AS g
  FROM (SELECT doc_id, w, len(w) AS n, size, unnest(range(0, len(w) - size + 1)) AS q FROM d, sizes)),
m AS (SELECT p.doc_id, p.n, p.q, t.* FROM p JOIN t ON p.g = t.g AND p.size = t.size),
v AS (
  SELECT doc_id, template, licence, shingles, g, unnest(range(
    CAST(greatest(0, ceil((q + size - win) / CAST(stride AS DOUBLE))) AS BIGINT),
    least(q // stride, greatest(0, n - win + stride - 1) // stride) + 1)) * stride AS start FROM m),
c AS (SELECT doc_id, template, licence, shingles, start, count(DISTINCT g) AS contained FROM v GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY contained DESC, start) AS k
  FROM c WHERE 100 * contained >= {MIN_CONTAINED} * shingles)
SELECT doc_id, template, licence, contained, CAST(shingles AS BIGINT) AS shingles, CAST(start AS BIGINT) AS start FROM r WHERE k = 1
"""


OP7_SQL = _op7_sql()
