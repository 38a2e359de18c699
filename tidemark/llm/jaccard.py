"""Groups of texts linked by the Jaccard similarity of their word n-grams.

Exact, by count vectors. A text's distinct shingles are hashed into groups; its counts
by group are a point. Two texts A and B that link differ in at most
d = (1 - t) / (1 + t) * (|A| + |B|) shingles, so the points' L1 distance is at most d.

* The coordinates are cut into more than d blocks, so two linked points agree on several
  whole blocks: each point is filed under its blocks' counts (of short texts, under the
  counts of two to four blocks together). This is the index's directory, the upper level
  of the tree; points that agree share a cell.
* Cells with the same smallest member make one leaf, large ones a leaf each. In a leaf, a
  pair can share no more shingles than its summed coordinate minima. Points of a large
  leaf are packed into an R-tree (sort-tile-recursive) whose boxes bound this sum for
  whole subtrees.
* Pairs that survive are verified on the words of their texts.

Copies form one class at once. Points travel once to each leaf, or to several tasks of a
leaf of many members: its members are dealt into parts, and first all parts meet one of
them, so that near copies join into components; then the parts that still hold different
components meet each other. Each search first emits a spanning forest of its surviving
pairs, not all of them. A surviving pair lies in one tree of its leaf's forest, so in one
component of all forests together: only those of three or more members that lie in
different components of links are looked at again, each member once and not in each of
its leaves.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, column_bytes, dropped, is_small, mix, shingles, slices, stored, texts, words

#: Coordinates of the R-tree's boxes, and least number of a point's own; larger sets have more, up to MOST_GROUPS.
COORDINATES, MOST_GROUPS = 64, 1 << 15
#: Filed entries of one bucket, about; buckets grow in number with the input.
BUCKET_ENTRIES = 1_000_000
#: Points of a leaf from which on an R-tree is built, and the fan-out of its nodes.
TREE_FROM, FAN_OUT = 256, 32
#: Members of a leaf's part, about, and rows of a task that searches leaves.
PART, TASK_ROWS = 1536, 20_000
#: Parts up to which a component of the forests is looked at as one; a larger one by its leaves.
PARTS = 8


_GROUPS = np.uint64(0xFFFFFFFF)


class Bound:
    """Similarity ``num`` / ``den`` in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def most_apart(self, total):
        """Shingles in which two linked sets of ``total`` shingles together differ at most."""
        return (self.den - self.num) * total // (self.den + self.num)

    def least_shared(self, total):
        """Shingles that two such sets share at least."""
        return -(-self.num * total // (self.den + self.num))

    def largest(self, n):
        """Largest set that a set of ``n`` can link with."""
        return self.den * n // self.num


def shingle_sets(column: pa.Array, k: int):
    """(row, text, sorted distinct shingle hashes) of each text, A-Z lower-cased; words ``[^\\x20\\x09-\\x0D]+``.

    A text of fewer than ``k`` words is one shingle; one without words has none.
    """
    data, at = column_bytes(column)
    for lo, hi in slices(at):
        value, _, _, bounds = words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], SPACED)
        grams, ends = shingles(value, k), bounds.tolist()
        for row in range(hi - lo):
            a, b = ends[row], ends[row + 1]
            text = data[at[lo + row] : at[lo + row + 1]].tobytes()
            if b - a >= k:
                own = np.sort(grams[a : b - k + 1])
                yield lo + row, text, own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield lo + row, text, shingles(np.concatenate([value[a:b], np.full(1, b - a, np.uint64)]), b - a + 1)
            else:
                yield lo + row, text, grams[:0]


def normal(text: bytes) -> bytes:
    """The words of a text (``bytes.split`` parts at the same six bytes), lower-cased, one space between them."""
    return b" ".join(text.lower().split())


def class_of(text: bytes) -> bytes:
    """Identity of a sequence of words: 12 bytes of a cryptographic hash."""
    return hashlib.blake2b(normal(text), digest_size=12).digest()


def shared(a: bytes, b: bytes, k: int) -> tuple[int, int, int]:
    """Distinct shingles of two normal texts, and those that they share, by the words themselves.

    Words are numbered, then runs of 2, 3, ... words by the numbers of their two parts:
    equal numbers are equal words.
    """
    x, y = a.split(), b.split()
    if min(len(x), len(y)) < k:  # one shingle, the whole text, which a text of k words or more has not
        n, m = (len(set(zip(*(z[i:] for i in range(k))))) if len(z) >= k else min(1, len(z)) for z in (x, y))
        return n, m, int(x == y and n == 1)
    numbers: dict[bytes, int] = {}
    word = np.array([numbers.setdefault(w, len(numbers)) for w in x + y], np.int64)
    run = word
    for i in range(1, k):
        run = np.unique(run[: len(word) - i] << 32 | word[i:], return_inverse=True)[1]
    n, m = np.unique(run[: len(x) - k + 1]), np.unique(run[len(x) :])
    return len(n), len(m), len(np.intersect1d(n, m, assume_unique=True))


def point(own: np.ndarray) -> bytes:
    """Counts of the set's shingles in groups, a byte each (255: that many or more), deflated.

    The number of groups is twice the power of two that the set's size reaches, so that
    few groups hold several shingles and hardly any differences cancel out (MOST_GROUPS
    at most, so that points of very long texts stay small).
    """
    groups = min(MOST_GROUPS, max(COORDINATES, 2 << (len(own).bit_length() - 1)))
    counts = np.bincount((own >> np.uint64(16) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    pack = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    return pack.compress(np.minimum(counts, 255).astype(np.uint8).tobytes()) + pack.flush()


def _bands(n: int) -> int:
    """Band of a set size: sizes from ceil(2^(b/2)) on."""
    b = max(0, int(2 * math.log2(n)) - 1)
    while _floor(b + 1) <= n:
        b += 1
    return b


def _floor(band: int) -> int:
    return math.isqrt((1 << band) - 1) + 1 if band else 1


def _plan(band: int, bound: Bound) -> tuple[int, int, int]:
    """Blocks of a band's scheme, how many of them are filed together, and how many may be empty before empty ones are filed.

    Short sets have few blocks: filed alone, empty ones and those of one common shingle
    would fill cells with sets of all kinds.
    """
    top = _floor(band + 1) - 1
    apart = bound.most_apart(top + bound.largest(top))
    if apart < 4:
        together = (1, 4, 3, 2)[apart]
        return apart + together, together, 0
    mean = (apart + 1) * math.exp(-4.0)
    spare = math.ceil(mean + 4 * math.sqrt(mean) + 2) if apart >= 8 else 3
    return apart + 1 + spare, 1, spare


def entries(own: np.ndarray, bound: Bound) -> np.ndarray:
    """Hashes of the (blocks, counts) under which a set is filed.

    The scheme of band b serves pairs whose smaller set is in b. A pair that differs in d
    shingles agrees on all but d blocks. Of d + c blocks it agrees on c at least: sets
    are filed under all choices of c blocks, where d is small. Else it agrees on
    spare + 1 of the first d + 1 + spare. With no more than ``spare`` empty blocks among
    them a set agrees with its partner on a block that isn't empty, and needn't be filed
    under empty ones (which texts of all kinds share); a set with more empty blocks is,
    and so is its partner.
    """
    n, out = len(own), []
    if not n:
        return np.zeros(0, np.uint64)
    band = _bands(n)
    for b in (band, band - 1):
        if b < 0:
            continue
        smaller = min(n, _floor(b + 1) - 1)  # the largest smaller partner, or itself
        if b < band and bound.largest(smaller) < n:
            continue
        apart = bound.most_apart(n + (bound.largest(n) if b == band else smaller))
        blocks, together, spare = _plan(b, bound)
        used = blocks if together > 1 else min(blocks, apart + 1 + spare)
        # Rising hashes fall into rising blocks: no sort.
        block = ((own >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        end = int(np.searchsorted(block, used))
        weight = mix((own[:end] & _GROUPS) + np.uint64(0x51ED270B))
        sums = np.zeros(used, np.uint64)
        if end:
            first = np.flatnonzero(np.concatenate([[True], block[1:end] != block[: end - 1]]))
            sums[block[first]] = np.add.reduceat(weight, first)
        if together > 1:
            cells = np.array([shingles(sums[list(c)], together)[0] for c in combinations(range(used), together)], np.uint64)
            file = np.arange(len(cells))
        else:
            filled = np.zeros(used, bool)
            filled[block[:end]] = True
            file = np.arange(used) if used - int(filled.sum()) > spare else np.flatnonzero(filled)
            cells = mix(sums[file])
        out.append(mix(cells ^ mix(file.astype(np.uint64) + np.uint64((b + 1) << 32))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class CountTree:
    """R-tree over count vectors, packed by sort-tile-recursive order."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes, self.fine = folded(points), sizes, points
        points = self.points
        spread = np.argsort(-points.astype(np.float64).var(axis=0), kind="stable")
        order = np.arange(len(points))
        parts, tiles = [order], max(1, round((len(points) / FAN_OUT) ** (1 / 3)))
        for axis in spread[:3]:
            parts = [piece for part in parts for piece in np.array_split(part[np.argsort(points[part, axis], kind="stable")], tiles) if len(piece)]
        self.leaves = [leaf for part in parts for leaf in np.array_split(part, max(1, -(-len(part) // FAN_OUT)))]
        high, small = np.array([points[x].max(axis=0) for x in self.leaves]), np.array([sizes[x].min() for x in self.leaves])
        self.levels = [(high, small)]
        while len(high) > FAN_OUT:
            cut = np.arange(0, len(high), FAN_OUT)
            high, small = np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(small, cut)
            self.levels.append((high, small))

    def search(self, i: int, bound: Bound, of: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
        """Positions over ``i``, in another component by ``of`` and on another side (-1 or none: any), whose summed minima with point ``i`` allow a link."""
        q, n = self.points[i], int(self.sizes[i])
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, small = self.levels[depth]
            nodes = nodes[np.minimum(high[nodes], q).sum(axis=1, dtype=np.int64) >= bound.least_shared(n + small[nodes])]
            if depth:
                nodes = (nodes[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        if not len(nodes):
            return nodes
        near = np.concatenate([self.leaves[x] for x in nodes.tolist()])
        near = near[(near > i) & (of[near] != of[i])]
        if side is not None and side[i] >= 0:
            near = near[side[near] != side[i]]
        near = near[allowed(self.points[near], self.sizes[near], q, n, bound)]
        return near[allowed(self.fine[near], self.sizes[near], self.fine[i], n, bound)]


def allowed(points: np.ndarray, sizes: np.ndarray, q: np.ndarray, n: int, bound: Bound) -> np.ndarray:
    """Which points can link with point ``q`` of size ``n``: by size, then by summed minima."""
    total = sizes + n
    out = np.minimum(sizes, n) >= bound.least_shared(total)
    at = np.flatnonzero(out)
    out[at] = np.minimum(points[at], q).sum(axis=1, dtype=np.int32 if points.dtype == np.uint8 else np.int64) >= bound.least_shared(total[at])
    return out


def same_space(column: list[bytes]) -> np.ndarray:
    """Points in the coarsest of their spaces: groups that differ in a high bit are added up."""
    raw = [np.frombuffer(zlib.decompress(x), np.uint8) for x in column]
    least = min(map(len, raw))
    if all(len(x) == least for x in raw) and max(int(x.max()) for x in raw) < 255:
        return np.array(raw)
    out = np.zeros((len(raw), least), np.int32)
    for i, x in enumerate(raw):
        # A full group bounds nothing.
        out[i] = np.where(x == 255, 1 << 24, x.astype(np.int32)).reshape(-1, least).sum(axis=0)
    return out.astype(np.uint8) if out.max() < 256 else out


def folded(points: np.ndarray) -> np.ndarray:
    """The points' coordinates added up to ``COORDINATES``: looser bounds, at less work."""
    out = points.reshape(len(points), -1, COORDINATES).sum(axis=1, dtype=np.int32 if points.dtype == np.uint8 else np.int64)  # full groups are large numbers
    return out.astype(np.uint8) if len(out) and out.max() < 256 else out


def ngram_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100, identity: bool = False) -> DataFrame:
    """``key``, ``n_shingles`` (distinct) and ``component_id`` of every row.

    Rows link when den * (shingles shared) >= num * (shingles of both); component_id is
    the smallest key reachable by links, the row's own included (nulls last). Rows
    without words (null and empty texts too) are linked with nothing. Repeated rows give
    repeated results; rows of one key with other texts are other rows. Whole texts; no cap
    on partners, candidates or leaves. An empty table gives no rows. Other columns are
    not read, whatever their names. Keys may be of any type that has an order. With
    ``identity`` also ``text_hash`` (MD5) and ``label``, the component's own name: keys
    may repeat or be null, so that the key alone tells neither a row nor a component.
    """
    bound = Bound(num, den)
    sets = stored(_sets(documents, key, text, k, identity), "sets")
    classes = stored(sets.where("n > 0").groupBy("cls").agg(F.min("key").alias("rep"), F.first("n").alias("n")), "classes")
    filed = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("c")).first()
    buckets = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((0.27 * filed["n"] + 4 * filed["c"]) / BUCKET_ENTRIES))
    leaves = stored(_leaves(documents, text, k, bound, buckets), "leaves")
    points = sets.where("point is not null").join(leaves.select("cls").distinct(), "cls", "left_semi")
    points = stored(points.groupBy("cls").agg(F.first("point").alias("point"), F.first("n").alias("n")), "points")

    def search(rows: DataFrame, whole: bool, found: DataFrame | None, first: bool) -> tuple[DataFrame, DataFrame | None]:
        """The pairs that survive (not ``whole``: of the forests), and the components after what is found."""
        rows = rows.withColumn("label", F.col("cls")) if found is None else _open(rows, found)
        dealt = stored(_dealt(rows, first), "dealt")  # is counted, then searched
        seen = stored(_pairs_of(dealt, points, bound, whole), "seen")
        pairs = stored(seen.distinct(), "pairs")
        # Members of a group meet in many leaves: one pair of each is verified first, then those that still lie in different components.
        once = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "once")
        found = joined(found, verified(once))
        ends = [found.select(F.col("cls").alias(x), F.col("label").alias(f"{x}_label")) for x in ("a", "b")]
        apart = F.coalesce("a_label", "a") != F.coalesce("b_label", "b")
        left = stored(pairs.join(once, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left").where(apart).select("a", "b"), "left")
        if not left.isEmpty():
            found = joined(found, verified(left))
        dropped(dealt, seen, once, left, rows)
        return pairs, found

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        held = _texts_of(documents, key, text, ends.join(classes, "cls").select("rep").distinct())
        links = stored(_verified(pairs, held, bound, k), "links")
        dropped(held)
        return links

    def joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
        """The components with more links."""
        if found is None:
            out = components(links)
        else:
            out = found if links.isEmpty() else merged(found, links)
        dropped(links, *([found] if found is not None and out is not found else []))
        return out

    seen, found = search(leaves, False, None, True)
    forests = [seen]
    # Leaves of several parts, of which only those with the first have met.
    several = stored(leaves.join(leaves.groupBy("home").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PART).select("home"), "home", "left_semi"), "several")
    if not several.isEmpty():
        again, found = search(several, False, found, False)
        forests.append(again)
    rest = _rest(forests[0] if len(forests) == 1 else forests[0].unionByName(forests[1]), leaves, found)
    if not rest.isEmpty():
        last, found = search(rest, True, found, False)
        dropped(last)
    dropped(points, leaves, several, rest, *forests)
    # A class's component is named by the smallest key in any of its classes.
    named = found.join(classes.select("cls", "rep"), "cls")
    smallest = named.groupBy("label").agg(F.min("rep").alias("least"))
    linked = stored(named.join(smallest, "label").select("cls", "least", "label"), "linked")
    dropped(found)
    final = classes.select("cls", "rep").join(linked, "cls", "left").select("cls", F.coalesce("least", "rep").alias("least"), F.coalesce("label", "cls").alias("label"))
    return sets.drop("point").join(final, "cls", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"), *(["text_hash", "label"] if identity else []))


def _sets(documents: DataFrame, key: str, text: str, k: int, identity: bool) -> DataFrame:
    """key, n, cls and point of every row (none without words; a batch has the point of a class once); with ``identity`` text_hash too."""
    more = ["text_hash"] if identity else []
    schema = T.StructType([T.StructField("key", documents.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("point", T.BinaryType()), *(T.StructField(x, T.StringType()) for x in more)])

    def run(batches):
        for batch in batches:
            n, cls, points, seen = [], [], [], set()
            for _, raw, own in shingle_sets(batch.column(1), k):
                n.append(len(own))
                cls.append(class_of(raw) if len(own) else None)
                points.append(point(own) if len(own) and cls[-1] not in seen else None)
                seen.add(cls[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(points, pa.binary()), *batch.columns[2:]], ["key", "n", "cls", "point", *more])

    return documents.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.md5(F.encode(text, "UTF-8")).alias(x) for x in more)).mapInArrow(run, schema)


_CLASS = np.dtype([("lo", "<u8"), ("hi", "<u4")])
_ENTRY = np.dtype([("cell", "<u4"), ("lo", "<u8"), ("hi", "<u4")])


def _member_hash(lo: np.ndarray) -> np.ndarray:
    """A cell is named by its members: the sum of their hashes, 64 bits."""
    return mix(lo ^ np.uint64(0x8EBC6AF09C88C6E3))


def _leaves(documents: DataFrame, text: str, k: int, bound: Bound, buckets: int) -> DataFrame:
    """home and cls of the members of all cells of two classes or more.

    A home is a leaf: cells of fewer than TREE_FROM members by their smallest one, so that
    the many cells of a group of similar texts bring a point there once; larger cells
    alone, by the sum of their members' hashes. Entries travel packed, one row for a batch
    and bucket; a class that has several rows in a batch is filed once for it.
    """

    def file(batches):
        for batch in batches:
            hashes, owners, seen = [], [], set()
            for _, raw, own in shingle_sets(batch.column(0), k):
                if len(own) and (cls := class_of(raw)) not in seen:
                    seen.add(cls)
                    hashes.append(entries(own, bound))
                    owners.append(cls)
            if not hashes or not (total := sum(map(len, hashes))):
                continue
            each, packed = np.concatenate(hashes), np.zeros(total, _ENTRY)
            packed["cell"] = each & np.uint64(0xFFFFFFFF)
            who = np.frombuffer(b"".join(owners), _CLASS)
            of = np.repeat(np.arange(len(owners)), [len(h) for h in hashes])
            packed["lo"], packed["hi"] = who["lo"][of], who["hi"][of]
            bucket = ((each >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            packed, cuts = packed[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            there = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([packed[cuts[b] : cuts[b + 1]].tobytes() for b in there.tolist()], pa.binary())], ["bucket", "entries"])

    def gather(table: pa.Table) -> pa.Table:
        every = np.frombuffer(b"".join(table["entries"].to_pylist()), _ENTRY)
        every = every[np.lexsort((every["hi"], every["lo"], every["cell"]))]
        every = every[np.concatenate([[True], every[1:] != every[:-1]])]
        begin = np.flatnonzero(np.concatenate([[True], every["cell"][1:] != every["cell"][:-1]]))
        size = np.diff(np.append(begin, len(every)))
        shared = np.repeat(size > 1, size)
        name = np.add.reduceat(_member_hash(every["lo"]), begin)
        home = np.repeat(np.where(size < TREE_FROM, every["lo"][begin], name), size)
        every, home = every[shared], home[shared].astype(np.int64)
        found = np.zeros(len(every), [("home", "<i8"), ("lo", "<u8"), ("hi", "<u4")])
        found["home"], found["lo"], found["hi"] = home, every["lo"], every["hi"]
        found = np.unique(found)
        return pa.table({"home": pa.array(np.ascontiguousarray(found["home"])), "cls": pa.array([a + b for a, b in zip(_split(found["lo"], 8), _split(found["hi"], 4))], pa.binary())})

    packed = documents.select(F.col(text).alias("text")).mapInArrow(file, "bucket long, entries binary")
    return packed.groupBy("bucket").applyInArrow(gather, "home long, cls binary").distinct()


def _split(column: np.ndarray, width: int) -> list[bytes]:
    raw = np.ascontiguousarray(column).tobytes()
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def _texts_of(documents: DataFrame, key: str, text: str, reps: DataFrame) -> DataFrame:
    """cls and normal text of the classes that the keys ``rep`` have.

    Only the rows with these keys are read into Python; a key of several texts brings
    classes that nobody asked for as well.
    """
    wanted = stored(reps, "wanted")
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(wanted) if is_small(wanted) else wanted, F.col("key").eqNullSafe(F.col("rep")), "left_semi")

    def run(batches):
        for batch in batches:
            found = {}
            for x in texts(batch.column(0)):
                if x := normal(x):
                    found[class_of(x)] = x
            found = list(found.items())
            for lo in range(0, len(found), 512):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found[lo : lo + 512]], pa.binary()) for i in (0, 1)], ["cls", "members"])

    out = stored(rows.select("text").mapInArrow(run, "cls binary, members binary").groupBy("cls").agg(F.first("members").alias("members")), "texts")
    dropped(wanted)
    return out


def _verified(near: DataFrame, held: DataFrame, bound: Bound, k: int) -> DataFrame:
    """The pairs (a, b) that link, by the words of their texts."""
    # The texts of a's partners come to a, in portions of some hundred, and stream past it.
    portions = near.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select("a", F.ceil(F.col("m") / 256).cast("int").alias("portions"))
    dealt = near.join(portions, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("portions")).cast("int").alias("portion"))
    mine = portions.select("a", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion")).join(held.withColumnRenamed("cls", "a"), "a").select("a", "portion", F.lit(None).cast("binary").alias("b"), "members")
    theirs = dealt.join(held.withColumnRenamed("cls", "b"), "b").select("a", "portion", "b", "members")
    together = mine.unionByName(theirs).repartition("a", "portion").sortWithinPartitions("a", "portion", F.asc_nulls_first("b"))

    def compare(batches):
        own = b""
        for batch in batches:
            links = []
            for x, y, members in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("members")):
                if y is None:
                    own = members.as_py()
                    continue
                n, m, both = shared(own, members.as_py(), k)
                if bound.den * both >= bound.num * (n + m - both):
                    links.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return together.mapInArrow(compare, "a binary, b binary")


def _open(leaves: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the leaves whose members are not all in one component, with their labels."""
    rows = leaves.join(found, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    open_ = rows.groupBy("home").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("home")
    return stored(rows.join(open_, "home"), "open")


def _rest(pairs: DataFrame, leaves: DataFrame, found: DataFrame) -> DataFrame:
    """home and cls of the members that the forests' ``pairs`` join, but the links that are found don't.

    Links are some of the pairs, so that only the pairs between two components of links
    are followed. A home is a component of pairs, each member in it once; in a component
    of more than ``PARTS`` parts it is what a leaf has of it. Of two members there is one
    pair, which has been verified.
    """
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(found, "cls", "left")
    ends = stored(ends.select("cls", F.coalesce("label", "cls").alias("label")), "ends")
    between = [ends.select(F.col("cls").alias(x), F.col("label").alias(f"{x}_label")) for x in ("a", "b")]
    between = stored(pairs.join(between[0], "a").join(between[1], "b").where("a_label <> b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct(), "between")
    tops = components(between)
    inside = stored(ends.join(tops.select(F.col("cls").alias("label"), F.col("label").alias("top")), "label").select("cls", "top"), "inside")
    sizes = inside.groupBy("top").agg(F.count(F.lit(1)).alias("m")).where("m > 2")
    held = stored(inside.join(sizes, "top").select("cls", "top", (F.col("m") > PARTS * PART).alias("large")), "held")
    out = held.where("not large").select(F.xxhash64("top").alias("home"), "cls")
    if not held.where("large").isEmpty():
        out = out.unionByName(leaves.join(held.where("large"), "cls").select(F.xxhash64("home", "top").alias("home"), "cls"))
    out = stored(out, "rest")
    dropped(ends, between, tops, inside, held)
    return out


def _dealt(rows: DataFrame, first: bool) -> DataFrame:
    """home, part and other, side, cls and label: members of a leaf by the tasks that search it.

    Leaves of up to PART members are one task. The members of others are dealt into parts.
    At ``first`` each part meets part 0 (side -1: all pairs are looked at). Later all pairs
    of parts meet (side 0 and 1: pairs of different sides; -1 for a part by itself); the
    members of a leaf's main component are parts of their own, which don't meet each other.
    """
    counts = rows.groupBy("home", "label").agg(F.count(F.lit(1)).alias("c"))
    homes = counts.groupBy("home").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top")).where(F.col("m") > PART)
    main = F.lit(0) if first else F.col("top.c")
    homes = homes.select("home", F.col("top.label").alias("main"), F.greatest(F.lit(1), F.ceil((F.col("m") - main) / PART)).cast("int").alias("parts"), F.ceil(main / PART).cast("int").alias("mains"))
    rows = rows.join(homes, "home", "left").withColumn("whose", F.col("mains").isNotNull() & (F.col("mains") > 0) & (F.col("label") == F.col("main")))
    deal = F.xxhash64("cls", "home")
    part = F.when(F.col("whose"), F.col("parts") + F.pmod(deal, F.greatest(F.lit(1), "mains"))).otherwise(F.pmod(deal, F.coalesce("parts", F.lit(1)))).cast("int")
    rows = rows.withColumn("part", part)
    if first:
        meets = F.when((F.col("parts") > 1) & (F.col("part") == 0), F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("parts") - 1))).otherwise(F.array("part"))
        return rows.select("home", F.lit(0).alias("part"), F.explode(meets).alias("other"), F.lit(-1).alias("side"), "cls", "label")
    every = F.when(F.col("whose"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.sequence(F.lit(0), F.coalesce(F.col("parts") + F.col("mains") - 1, F.lit(0))))
    rows = rows.withColumn("meets", F.explode(every))
    low, high = F.least("part", "meets"), F.greatest("part", "meets")
    side = F.when(low == high, F.lit(-1)).otherwise((F.col("part") == high).cast("int"))
    return rows.select("home", low.alias("part"), high.alias("other"), side.alias("side"), "cls", "label")


def _pairs_of(rows: DataFrame, points: DataFrame, bound: Bound, whole: bool) -> DataFrame:
    """Pairs (a, b) of leaves' members, with other labels, whose points allow a link.

    Not ``whole``: of each leaf a spanning forest of those pairs, nearest first: members
    of any such pair are in one tree, or in trees that links join.
    """
    # By number: leaves are few bytes but much work, so that small partitions must not be merged.
    number = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / TASK_ROWS))
    rows = rows.join(points, "cls").select("home", "part", "other", "side", "cls", "label", "n", "point").repartition(number, "home", "part", "other").sortWithinPartitions("home", "part", "other", "cls")

    def leaf(cls: list, labels: list, side: np.ndarray, sizes: np.ndarray, points: np.ndarray):
        tree = CountTree(points, sizes) if len(cls) >= TREE_FROM else None
        # Members of one component are passed over before their points are compared.
        numbers = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        of = np.array([numbers[x] for x in labels])
        apart, edges = len(numbers), []
        for i in range(len(cls) - 1):
            if apart == 1:
                break  # one component already: nothing to be found
            if tree:
                near = tree.search(i, bound, of, side)
            else:
                near = i + 1 + np.flatnonzero((of[i + 1 :] != of[i]) & ((side[i] < 0) | (side[i + 1 :] != side[i])))
                near = near[allowed(points[near], sizes[near], points[i], int(sizes[i]), bound)]
            if not whole and len(near) > 1:
                near = near[np.argsort(-np.minimum(points[near], points[i]).sum(axis=1, dtype=np.int64) / (sizes[near] + sizes[i]), kind="stable")]
            while len(near):
                edges.extend((i, j) for j in (near.tolist() if whole else near[:1].tolist()))
                if whole:
                    break
                of[of == of[near[0]]] = of[i]
                apart -= 1
                near = near[of[near] != of[i]]
        for i, j in edges:
            yield min(cls[i], cls[j]), max(cls[i], cls[j])

    def run(batches):
        task, held = None, []

        def pairs():
            side, cls, labels, n, p = zip(*held)
            return leaf(list(cls), list(labels), np.array(side, np.int64), np.array(n, np.int64), same_space(list(p)))

        out: set = set()
        for batch in batches:
            for *now, side, cls, label, n, p in zip(*(x.to_pylist() for x in batch.columns)):
                if now != task and held:
                    out.update(pairs())
                    held = []
                    if len(out) >= 50_000:
                        yield _seen(out)
                        out = set()
                task = now
                held.append((side, cls, label, n, p))
        if held:
            out.update(pairs())
        yield _seen(out)

    return rows.mapInArrow(run, "a binary, b binary")


def _seen(out: set) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """cls and label (the smallest class of its component) of all classes with a link.

    Alternating large and small stars (Kiveris et al., SoCC 2014): each round points
    the neighbours of a node to the smallest one; it ends when no edge changes. Edges
    stay distributed and are written to the shared folder after each round.
    """
    def held(edges: DataFrame) -> tuple[DataFrame, tuple]:
        edges = stored(edges.distinct(), "edges")
        return edges, tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges, sign = held(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while sign[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, (edges, new) = edges, held(small)
        dropped(old)
        if new == sign:
            break
        sign = new
    tops = edges.select(F.col("v").alias("cls"), F.col("v").alias("label")).distinct()
    out = stored(edges.select(F.col("u").alias("cls"), F.col("v").alias("label")).unionByName(tops), "components")
    dropped(edges)
    return out


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` once more links join its components: only their labels are looked at."""
    ends = [found.select(F.col("cls").alias(x), F.col("label").alias(f"{x}_label")) for x in ("a", "b")]
    between = stored(links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")), "between")
    moved = components(between)
    old = found.join(moved.select(F.col("cls").alias("label"), F.col("label").alias("top")), "label", "left").select("cls", F.coalesce("top", "label").alias("label"))
    out = stored(old.unionByName(moved.join(found, "cls", "left_anti")), "merged")
    dropped(between, moved)
    return out
