"""N-gram Jaccard join: a forest of R-trees over group counts of hashed shingles.

Two texts link if `percent` hundredths of their shingles' union are in both sets. All shingles are hashed into groups,
and the groups serve twice.

Which texts meet: sets that link differ in at most r = floor((100 - p) * (|A| + |B|) / (100 + p)) shingles. With more
than r groups at least one group holds the same shingles in both sets, so every set is entered under the content of
each of its groups, with groups for its band of sizes, and for the next band if a partner may be there. Sets of up to
TINY shingles differ in at most one and are entered whole and, where so small a part still links, with each one left out. No link is lost; a passage that
many texts share gives no common entry unless it fills a group alone.

What is compared: the counts of a set's shingles in DIMENSIONS groups are a point. The overlap of two sets is at most
the sum of the smaller coordinates; for a box of points, of the smaller of a point's and the box's largest ones. Trees
of such boxes are searched for each component that may have more links. Pairs that pass are verified on their shingles.

Order of work: first, each entry's members are compared with its first member and with the one before, which joins
groups of copies with few pairs. A step of a task sends one row for each entry, however many of its texts share it.
Components that still meet under some content are then compared as a whole: the larger one is an R-tree, and all
texts of the smaller ones ask it. Members and askers are split into blocks of BLOCK, each pair of blocks in its own task.

Defined results. Null, empty and wordless texts have no shingles, link with nothing and are their own component. Rows
without id are returned with no component and link with nothing. Rows that repeat an id are one node: it links if any
of its rows does. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronage.llm.common import add_columns, column_ref, release, ship, sub_batches, table, trim, written
from patronage.llm.components import components
from patronage.llm.shingles import mix, shingle_hashes

WORDS, PERCENT = 4, 85
DIMENSIONS = 256
STEP_BYTES = 4 << 20
#: Ids broadcast to the scan of texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
BLOCK = 2048
LEAF = 16
#: Places that small lists and trees are dealt to at least, so that few of them do not meet in one task.
LEAST_PLACES = 64


def most_apart(total: np.ndarray, percent: int) -> np.ndarray:
    """The most shingles in which two sets that link can differ; total: both sizes added."""
    return (100 - percent) * total // (100 + percent)


def tiny(percent: int) -> int:
    """The largest size below which sets that link differ in at most one shingle."""
    size = 1
    while most_apart(2 * (size + 1), percent) <= 1 and size < 1 << 20:
        size += 1
    return size


def band_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    """0 for tiny sets, then bands whose smallest sizes double."""
    low = tiny(percent) + 1
    return np.where(sizes < low, 0, np.floor(np.log2(np.maximum(sizes, low) / low + 1e-12)).astype(np.int64) + 1)


def band_start(band: np.ndarray, percent: int) -> np.ndarray:
    return (tiny(percent) + 1) << np.maximum(band - 1, 0)


def groups_of(band: np.ndarray, percent: int) -> np.ndarray:
    """Groups in a band: one more than its sets can differ in, and a few so that empty groups seldom decide."""
    apart = most_apart(2 * (band_start(band + 1, percent) - 1), percent)
    return apart + 2 + apart // 16


def entries(hashes: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets are entered under which contents: numbers of sets, and 64-bit signatures."""
    sizes = np.diff(at)
    band = band_of(sizes, percent)
    owners, signatures = [], []
    spread = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    whole = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
    whole = whole[at[1:]] - whole[at[:-1]]
    small = np.flatnonzero((band == 0) & (sizes > 0))
    shrinks = small[100 * (sizes[small] - 1) >= percent * sizes[small]]  # others link with no set of one shingle less
    of_small = np.isin(np.repeat(np.arange(len(sizes)), sizes), shrinks)
    owner = np.repeat(np.arange(len(sizes)), sizes)[of_small]
    owners += [small, owner]
    signatures += [mix(whole[small] + np.uint64(1)), mix(whole[owner] - spread[of_small] + np.uint64(1))]
    for higher in (0, 1):
        target = band + higher
        if higher:  # a partner may be in the next band
            enters = (sizes > 0) & (sizes * 100 // percent >= band_start(band + 1, percent))
        else:
            enters = band > 0
        chosen = np.flatnonzero(enters)
        if not len(chosen):
            continue
        groups = groups_of(target[chosen], percent)
        base = np.concatenate(([0], np.cumsum(groups)))
        number = np.full(len(sizes), -1)
        number[chosen] = np.arange(len(chosen))
        which = np.repeat(number, sizes)
        mine = which >= 0
        which, own = which[mine], hashes[mine]
        seeded = mix(own + target[chosen][which].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        slot = base[which] + (seeded % groups[which].astype(np.uint64)).astype(np.int64)
        count = np.bincount(slot, minlength=base[-1])
        # sums of halves stay exact in double precision: groups hold few shingles, and 2 ** 21 would still do
        low = np.bincount(slot, (seeded & np.uint64(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(np.uint64)
        high = np.bincount(slot, (seeded >> np.uint64(32)).astype(np.float64), base[-1]).astype(np.uint64)
        slot_owner = np.repeat(np.arange(len(chosen)), groups)
        place = (np.arange(base[-1]) - base[slot_owner]).astype(np.uint64)
        tag = mix(place + target[chosen][slot_owner].astype(np.uint64) * np.uint64(1 << 40) + count.astype(np.uint64) * np.uint64(1 << 48))
        signature = mix(mix(low + tag) + high * np.uint64(0x8EBC6AF09C88C6E3))
        # sets that might meet in nothing but empty groups enter these too
        sizes_here = sizes[chosen]
        largest = np.minimum(sizes_here * 100 // percent, band_start(target[chosen] + 1, percent) - 1)
        empty = np.bincount(slot_owner, count == 0, len(chosen))
        needs = empty >= groups - most_apart(sizes_here + largest, percent)
        kept = (count > 0) | needs[slot_owner]
        owners.append(chosen[slot_owner[kept]])
        signatures.append(signature[kept])
    return np.concatenate(owners), np.concatenate(signatures)


def pre_joined(ids: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries joined within a step: each content once, with its first id and the other ids, ascending, as a list."""
    order = np.lexsort((ids, signatures))
    ids, signatures = ids[order], signatures[order]
    new = np.ones(len(ids), bool)
    new[1:] = signatures[1:] != signatures[:-1]
    again = np.zeros(len(ids), bool)
    again[1:] = ~new[1:] & (ids[1:] == ids[:-1])
    begins = np.flatnonzero(new)
    others = ~new & ~again
    ends = np.concatenate(([0], np.cumsum(others)))
    offsets = ends[np.append(begins, len(ids))]
    return signatures[new], ids[new], offsets, ids[others]


def counts_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each set's point: how many of its shingles are in each group."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    slot = text * DIMENSIONS + (mix(hashes + np.uint64(0x2545F4914F6CDD1D)) % np.uint64(DIMENSIONS)).astype(np.int64)
    return np.bincount(slot, minlength=DIMENSIONS * (len(at) - 1)).astype(np.int32).reshape(-1, DIMENSIONS)


def packed_points(points: np.ndarray) -> list[bytes]:
    """One byte to a count; four where a count needs more."""
    narrow = points.astype(np.uint8)
    return [(n if m <= 255 else p).tobytes() for p, n, m in zip(points, narrow, points.max(1, initial=0).tolist())]


def unpacked_points(packed: list[bytes]) -> np.ndarray:
    if all(len(p) == DIMENSIONS for p in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, DIMENSIONS).astype(np.int32)
    return np.stack([np.frombuffer(p, np.uint8 if len(p) == DIMENSIONS else np.int32).astype(np.int32) for p in packed])


def needed_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The fewest common shingles of sets of these sizes that link."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """An R-tree over points of group counts, packed level by level."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        # packing order: by size, then by the most different coordinates, so that near points share leaves
        spread = np.argsort(points.var(0))[::-1][:3] if len(points) else []
        self.order = np.lexsort((*(points[:, d] for d in spread), sizes // np.maximum(1, sizes.max(initial=1) // 16)))
        top, small = points[self.order], sizes[self.order]
        self.levels = []  # from leaves up: largest coordinates and smallest size of each box
        while True:
            cuts = np.arange(0, len(top), LEAF)
            top, small = np.maximum.reduceat(top, cuts), np.minimum.reduceat(small, cuts)
            self.levels.append((top, small))
            if len(top) == 1:
                break

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Numbers of points whose overlap with this one may suffice."""
        boxes = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            top, small = self.levels[level]
            bound = np.minimum(top[boxes], point).sum(1)
            boxes = boxes[bound >= needed_overlap(size, small[boxes], percent)]
            below = len(self.levels[level - 1][0]) if level else len(self.points)
            boxes = (boxes[:, None] * LEAF + np.arange(LEAF)).ravel()
            boxes = boxes[boxes < below]
        found = self.order[boxes]
        bound = np.minimum(self.points[found], point).sum(1)
        return found[bound >= needed_overlap(size, self.sizes[found], percent)]


def meeting_pairs(ids: np.ndarray, asks: np.ndarray, sizes: np.ndarray, points: np.ndarray, begins: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of ids that pass the bound, of an asking row and another in one stretch of rows. A short stretch is a leaf."""
    out = [np.zeros((0, 2), np.int64)]
    for begin, end in zip(begins.tolist(), ends.tolist()):
        here = np.arange(begin, end)
        queries, members = here[asks[begin:end]], here[~asks[begin:end]]
        if not len(queries) or not len(members):
            continue
        if len(members) <= 2 * LEAF:
            for q in queries:
                bound = np.minimum(points[members], points[q]).sum(1)
                found = members[bound >= needed_overlap(sizes[members], sizes[q], percent)]
                out.append(np.stack((np.full(len(found), ids[q]), ids[found]), 1))
            continue
        tree = CountTree(points[members], sizes[members])
        for q in queries:
            found = members[tree.search(points[q], sizes[q], percent)]
            out.append(np.stack((np.full(len(found), ids[q]), ids[found]), 1))
    return np.sort(np.concatenate(out), axis=1)


def root_pairs(roots: np.ndarray, sizes: np.ndarray, boxes: np.ndarray, begins: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of components of one list whose boxes pass the bound; lists are stretches of rows that ascend by root."""
    out = [np.zeros((0, 2), np.int64)]
    for begin, end in zip(begins.tolist(), ends.tolist()):
        names, low, high = roots[begin:end], sizes[begin:end], boxes[begin:end]
        if len(names) <= 2 * LEAF:
            overlap = np.minimum(high[:, None, :], high[None, :, :]).sum(2)
            a, b = np.nonzero(np.triu(overlap >= needed_overlap(low[:, None], low[None, :], percent), 1))
            out.append(np.stack((names[a], names[b]), 1))
            continue
        tree = CountTree(high, low)
        for k in range(len(names)):
            found = tree.search(high[k], low[k], percent)
            found = found[found > k]
            out.append(np.stack((np.full(len(found), names[k]), names[found]), 1))
    return np.unique(np.concatenate(out), axis=0)


def boxes_of(table: pa.Table) -> pa.Table:
    """For each root the largest coordinates and the smallest size of its rows."""
    table = table.sort_by("root")
    roots, sizes = table.column("root").to_numpy(), table.column("n_shingles").to_numpy()
    points = unpacked_points(table.column("point").to_pylist())
    begins = np.flatnonzero(np.append(True, roots[1:] != roots[:-1])) if len(roots) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(points, begins) if len(begins) else points
    low = np.minimum.reduceat(sizes, begins) if len(begins) else sizes
    return pa.table(
        {"root": pa.array(roots[begins]), "n_shingles": pa.array(low), "point": pa.array(packed_points(top), pa.binary())}
    )


class NgramJoin:
    """The join of one frame of texts with itself."""

    def __init__(self, documents: DataFrame, key: str, text: str, words: int, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("the similarity has to be above one half, up to 100 hundredths")
        self.spark, self.words, self.percent = documents.sparkSession, words, percent
        ship(self.spark)
        self.rows = documents.select(column_ref(key).cast("long").alias("id"), column_ref(text).alias("text"))
        self.texts = self.rows.where("id is not null")

    def measured(self) -> DataFrame:
        """id, n_shingles and, for texts with shingles, the point."""
        words = self.words

        def measure(texts: pa.Array) -> list[pa.Array]:
            hashes, at = shingle_hashes(texts, words)
            points = counts_of(hashes, at)
            return [pa.array(np.diff(at), pa.int64()), pa.array(packed_points(points), pa.binary())]

        def make():
            release()
            return measure

        return add_columns(self.rows, "text", "n_shingles bigint, point binary", make, STEP_BYTES).drop("text")

    def entered(self) -> DataFrame:
        """signature, id, others: the contents under which texts are entered, joined within each step of a task."""
        words, percent = self.words, self.percent

        def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                begin = 0
                for part in sub_batches(batch.column("text"), STEP_BYTES):
                    ids = batch.column("id").slice(begin, len(part)).to_numpy()
                    begin += len(part)
                    owners, signatures = entries(*shingle_hashes(part, words), percent)
                    signatures, firsts, offsets, others = pre_joined(ids[owners], signatures)
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(others, pa.int64()))
                    alone = pa.array(offsets[1:] == offsets[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signatures.view(np.int64)), pa.array(firsts, pa.int64()), pc.if_else(alone, None, lists)],
                        names=["signature", "id", "others"],
                    )
            trim()

        return self.texts.mapInArrow(enter, "signature bigint, id bigint, others array<bigint>")

    def shared(self) -> DataFrame:
        """Entries that two texts or more have in common, with the first id of all and the one before."""
        members = Window.partitionBy("signature").orderBy("id")
        ranked = self.entered().select(
            "signature", "id", "others", F.first("id").over(members).alias("head"), F.lag("id").over(members).alias("before"),
            F.lead("id").over(members).alias("after"),
        )
        return ranked.where("before is not null or after is not null or others is not null").drop("after")

    @staticmethod
    def first_pairs(shared: DataFrame) -> DataFrame:
        """Each entry's members with its first member and with the one before."""
        pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        own = F.when(F.col("before").isNotNull(), F.array(pair(F.col("head"), F.col("id")), pair(F.col("before"), F.col("id"))))
        with_first = F.transform("others", lambda o: pair(F.col("id"), o))
        in_turn = F.transform(F.sequence(F.lit(1), F.size("others") - 1), lambda k: pair(F.col("others")[k - 1], F.col("others")[k]))
        nothing = F.array().cast("array<struct<a: bigint, b: bigint>>")
        pairs = F.concat(
            F.coalesce(own, nothing), F.coalesce(with_first, nothing), F.when(F.size("others") > 1, in_turn).otherwise(nothing)
        )
        return shared.select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").distinct()

    def pick(self, ids: DataFrame) -> DataFrame:
        """Texts of the ids, with the other columns of `ids`; without a shuffle of texts as long as the ids are few
        enough to be held by each task."""
        few = ids.count() <= BROADCAST_IDS
        ids = ids.withColumnRenamed("id", "wanted")
        return self.texts.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("wanted")).drop("wanted")

    def bounded(self, pairs: DataFrame, points: DataFrame) -> DataFrame:
        """Pairs whose points' summed smaller coordinates reach the overlap they need."""
        percent = self.percent
        a = points.select(F.col("id").alias("a"), F.col("n_shingles").alias("size_a"), F.col("point").alias("point_a"))
        b = points.select(F.col("id").alias("b"), F.col("n_shingles").alias("size_b"), F.col("point").alias("point_b"))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                left, right = (unpacked_points(batch.column(c).to_pylist()) for c in ("point_a", "point_b"))
                needed = needed_overlap(batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy(), percent)
                passed = pa.array(np.minimum(left, right).sum(1) >= needed)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(passed), batch.column("b").filter(passed)], names=["a", "b"])
            trim()

        joined = pairs.join(a, "a").join(b, "b").select("a", "b", "size_a", "size_b", "point_a", "point_b")
        return joined.mapInArrow(check, "a bigint, b bigint").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that link, with common and united shingles."""
        words, percent = self.words, self.percent
        wanted = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())

        def shingles(texts: pa.Array) -> list[pa.Array]:
            hashes, at = shingle_hashes(texts, words)
            return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))]

        sets = add_columns(self.pick(wanted), "text", "shingles array<bigint>", lambda: shingles, STEP_BYTES).select("id", "shingles")
        joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        counted = joined.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).cast("long").alias("sizes"))
        linked = counted.where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common")))
        return linked.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("united")).dropDuplicates(["a", "b"])

    @staticmethod
    def component_lists(shared: DataFrame, roots: DataFrame) -> DataFrame:
        """list, other, n, root: the components that meet under each content, where there are several.

        Contents with the same components, as copies have many of, are one list, known by two sums of hashes.
        """
        everyone = F.concat(F.array("id"), F.coalesce("others", F.array().cast("array<bigint>")))
        members = shared.select("signature", F.explode(everyone).alias("id"))
        few = roots.count() <= BROADCAST_IDS
        rooted = members.join(F.broadcast(roots) if few else roots, F.col("id") == F.col("node"), "left")
        rooted = rooted.select("signature", F.coalesce("root", "id").alias("root")).distinct()
        together = Window.partitionBy("signature")
        hashed = lambda seed: F.sum(F.shiftright(F.xxhash64("root", F.lit(seed)), 30)).over(together)
        described = rooted.select("root", F.count("*").over(together).alias("n"), hashed(1).alias("list"), hashed(2).alias("other"))
        return described.where("n > 1").distinct()

    @staticmethod
    def component_boxes(rooted: DataFrame) -> DataFrame:
        """root, n_shingles (the smallest), point (the largest coordinates) of every component, combined in each task first."""
        kind = "root bigint, n_shingles bigint, point binary"

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from boxes_of(pa.Table.from_batches([batch])).combine_chunks().to_batches()

        partial = rooted.select("root", "n_shingles", "point").mapInArrow(combine, kind)
        buckets = max(LEAST_PLACES, rooted.count() // (8 * BLOCK))
        return partial.groupBy(F.pmod(F.xxhash64("root"), F.lit(buckets))).applyInArrow(boxes_of, kind)

    def component_pairs(self, lists: DataFrame, boxes: DataFrame) -> DataFrame:
        """(r, s): components that meet somewhere and whose boxes pass the bound, r < s. Small lists share a task; in
        larger ones blocks meet blocks."""
        percent = self.percent
        buckets = max(LEAST_PLACES, lists.count() // (8 * BLOCK))
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("root"), blocks).cast("int")
        dealt = lists.join(boxes, "root").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select(
            F.when(F.col("n") <= BLOCK, F.pmod("list", F.lit(buckets))).otherwise(F.col("list")).alias("place"),
            F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "list", "other", "root", "n_shingles", "point",
        )

        def meet(group: pa.Table) -> pa.Table:
            group = group.sort_by([("list", "ascending"), ("other", "ascending"), ("root", "ascending")])
            first, second, roots, sizes = (group.column(c).to_numpy() for c in ("list", "other", "root", "n_shingles"))
            boxes_here = unpacked_points(group.column("point").to_pylist())
            cuts = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
            pairs = root_pairs(roots, sizes, boxes_here, np.append(0, cuts), np.append(cuts, len(roots)), percent)
            return pa.table({"r": pa.array(pairs[:, 0], pa.int64()), "s": pa.array(pairs[:, 1], pa.int64())})

        return dealt.groupBy("place", "low", "high").applyInArrow(meet, "r bigint, s bigint").where("r <> s").distinct()

    def tree_pairs(self, shared: DataFrame, roots: DataFrame, points: DataFrame, tried: DataFrame) -> DataFrame:
        """Untried pairs of texts, of components that meet, that pass the bound of a tree.

        Of two components the larger is the tree, and all texts of the smaller ones it meets ask it.
        """
        percent = self.percent
        rooted = points.join(roots, F.col("id") == F.col("node"), "left")
        rooted = rooted.select("id", F.coalesce("root", "id").alias("root"), "n_shingles", "point")
        lists = written(self.component_lists(shared, roots))
        met = written(self.component_pairs(lists, self.component_boxes(rooted.join(lists.select("root").distinct(), "root"))))
        sizes = roots.groupBy("root").agg((F.count("*") + 1).alias("m"))
        count = lambda c: sizes.select(F.col("root").alias(c), F.col("m").alias(f"m_{c}"))
        sized = met.join(count("r"), "r", "left").join(count("s"), "s", "left").fillna(1, ["m_r", "m_s"])
        # two single texts that were compared already are done
        alone = (F.col("m_r") == 1) & (F.col("m_s") == 1)
        done = tried.select(F.col("a").alias("r"), F.col("b").alias("s"), F.lit(True).alias("done"))
        sized = sized.join(done, ["r", "s"], "left").where(~(alone & F.coalesce("done", F.lit(False))))
        larger = F.col("m_r") >= F.col("m_s")
        asked = sized.select(
            F.when(larger, F.col("r")).otherwise(F.col("s")).alias("tree"), F.when(larger, F.col("s")).otherwise(F.col("r")).alias("root")
        )
        queries = rooted.join(asked, "root").select("tree", "id", "n_shingles", "point", F.lit(True).alias("asks"))
        trees = asked.select(F.col("tree").alias("root")).distinct()
        members = rooted.join(trees, "root").select(F.col("root").alias("tree"), "id", "n_shingles", "point", F.lit(False).alias("asks"))
        dealt = self.dealt(members.unionByName(queries))

        def search(group: pa.Table) -> pa.Table:
            group = group.sort_by([("tree", "ascending"), ("id", "ascending")])
            trees, ids, sizes = (group.column(c).to_numpy() for c in ("tree", "id", "n_shingles"))
            asks = group.column("asks").to_numpy()
            points_here = unpacked_points(group.column("point").to_pylist())
            cuts = np.flatnonzero(trees[1:] != trees[:-1]) + 1
            pairs = meeting_pairs(ids, asks, sizes, points_here, np.append(0, cuts), np.append(cuts, len(ids)), percent)
            return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

        found = dealt.groupBy("small", "place", "qb", "mb").applyInArrow(search, "a bigint, b bigint")
        return found.where("a <> b").distinct().join(tried, ["a", "b"], "left_anti")

    @staticmethod
    def dealt(both: DataFrame) -> DataFrame:
        """Members and askers of trees with the place where they meet: small, place, qb, mb. Trees of one block of each
        share places of about 8 * BLOCK rows; of the others each pair of blocks has its own."""
        counts = both.groupBy("tree").agg(F.count_if("asks").alias("q"), F.count_if(~F.col("asks")).alias("m"))
        counts = written(counts)
        shared = counts.where((F.col("q") <= BLOCK) & (F.col("m") <= BLOCK)).agg(F.sum(F.col("q") + F.col("m"))).first()[0]
        buckets = max(LEAST_PLACES, (shared or 0) // (8 * BLOCK))
        block = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(c)
        blocks = counts.select("tree", block("q"), block("m"))
        own = F.pmod(F.xxhash64("id"), F.when(F.col("asks"), F.col("q")).otherwise(F.col("m"))).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("m")).otherwise(F.col("q")) - 1))
        dealt = both.join(blocks, "tree").withColumn("own", own).withColumn("other", others)
        small = (F.col("q") == 1) & (F.col("m") == 1)
        return dealt.select(
            F.when(small, F.pmod(F.xxhash64("tree"), F.lit(buckets))).otherwise(F.col("tree")).alias("place"),
            F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("qb"),
            F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("mb"),
            small.alias("small"), "tree", "asks", "id", "n_shingles", "point",
        )

    def run(self) -> tuple[DataFrame, DataFrame]:
        """All rows with n_shingles and component_id; and links that span every component."""
        measured = written(self.measured())
        points = measured.where("id is not null and n_shingles > 0")
        shared = written(self.shared())
        tried = written(self.first_pairs(shared))
        links = written(self.verified(self.bounded(tried, points)))
        roots = components(links.select("a", "b"))
        pairs = written(self.tree_pairs(shared, roots, points, tried))
        if pairs.head(1):
            links = written(links.unionByName(self.verified(pairs)))
            roots = components(links.select("a", "b"))
        result = measured.join(roots, F.col("id") == F.col("node"), "left")
        return result.select("id", "n_shingles", F.coalesce("root", "id").alias("component_id")), links


def ngram_join(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, component_id) of every row, and verified links (a, b, common, united) that span the components."""
    return NgramJoin(documents, key, text, words, percent).run()


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(table(spark, folder, "documents"))[0].withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[p : p + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.node = d.doc_id
"""
