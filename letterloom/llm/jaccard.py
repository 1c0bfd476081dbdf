"""N-gram Jaccard join by parity sketches.

The shingles of a document are dealt to cells by hash, and each cell holds the XOR of its shingles'
64-bit hashes. Two sets differ in at most as many cells as their symmetric difference has shingles
(a cell of equal shingles has equal bits), so the number of different cells is a lower bound of it. A
similarity of s allows at most (1 - s) / (1 + s) * (a + b) differences between sets of a and b
shingles. With more cells than that some must be equal (pigeonhole): documents are joined on equal
cells of their size band, and every candidate pair is verified on the sets themselves.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.llm.common import WordHashes, mix, pieces, spaced_words, texts
from letterloom.llm.components import components
from letterloom.session import materialise

SHINGLE = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
#: Sketches are dealt anew, with other cells, for documents too many of whose cells are nearly empty.
LEVELS = 64
SKETCH_WORDS = 8
#: Buckets of more sets that hold several groups are left by the sets that can do without them.
LARGE_BUCKET = 12
#: Links inside a group are counted between blocks of sets with about so many shingles.
BLOCK_SHINGLES = 1 << 19
#: A band holds sizes up to twice the one below; it has a cell for so many of the largest size.
SHINGLES_A_CELL = 2.8

_EMPTY = np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes], hashes: WordHashes, width: int = SHINGLE) -> list[np.ndarray]:
    """Per text, the sorted different 64-bit hashes of its shingles of `width` words."""
    out = []
    for t in texts:
        h = hashes.of(spaced_words(t))
        if not len(h):
            out.append(_EMPTY)
            continue
        size = min(width, len(h))
        n = len(h) - size + 1
        value = np.full(n, size, np.uint64)
        for k in range(size):
            value = value * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out.append(np.unique(mix(value)))
    return out


def most_differences(size: int, top: int) -> int:
    """Largest symmetric difference of a set of `size` and a similar one of at most `top` shingles."""
    other = min(top, size * DENOMINATOR // NUMERATOR)
    return (size + other) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def cell_keys(shingles: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """Join keys of one set: cells in its own size band, and in the next if a similar set can be there.
    Also, for the even and the odd band, how many of its keys the set can do without.

    Only cells of two shingles or more give keys, as many documents that have a passage in common
    share cells of a single one. If the set allows `most` differences to a similar one, at most so
    many of its cells differ there; so with more keys than that one of them is the other's too, and
    that holds for any `most` + 1 of them. A set with too few gives all it has and deals its shingles
    anew to other cells. It meets every set that had enough; one that had not is dealt anew like it.
    After the last level such sets share one key. The last bit of a key is that of its band.
    """
    size = len(shingles)
    own = max(2, (size - 1).bit_length())  # bands up to 4, 8, 16, ... shingles
    out: list[np.ndarray] = [_EMPTY]
    spare: list[int | None] = [None, None]
    for band in (own, own + 1):
        top = 1 << band
        most = most_differences(size, top)
        # sets without differences are equal, and one class already
        if not most or (band > own and size * DENOMINATOR // NUMERATOR <= top // 2):
            continue
        cells = max(2, round(top / SHINGLES_A_CELL))
        for level in range(LEVELS + 1):
            salt = mix(np.array([band << 8 | (level + 1)], np.uint64))
            keys = salt
            if level < LEVELS:
                dealt = mix(shingles ^ salt)
                cell = (((dealt >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
                parity = np.zeros(cells, np.uint64)
                np.bitwise_xor.at(parity, cell, dealt)
                full = np.flatnonzero(np.bincount(cell, minlength=cells) >= 2)
                keys = mix(mix(parity[full] + salt) ^ full.astype(np.uint64))
                if not level:
                    spare[band & 1] = len(full) - most - 1
            out.append(keys & np.uint64(0xFFFFFFFFFFFFFFFE) | np.uint64(band & 1))
            if len(keys) > most:
                break
    return np.concatenate(out), spare


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A parity sketch of 64 * SKETCH_WORDS bits, one flipped for each shingle, to reject pairs early."""
    bits = np.bincount((shingles >> np.uint64(20)) % np.uint64(64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def identity(shingles: np.ndarray) -> int:
    """A 64-bit number of the whole set."""
    with np.errstate(over="ignore"):
        whole = shingles.sum(dtype=np.uint64) ^ np.uint64(len(shingles))
    return int(mix(np.array([whole], np.uint64)).view(np.int64)[0])


def _map(docs: DataFrame, schema: str, rows) -> DataFrame:
    """`docs` (id, text) through `rows(ids, sets)`, which gives Arrow columns."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for piece in pieces(batches, "text"):
            sets = shingle_sets(texts(piece, "text"), hashes)
            yield pa.RecordBatch.from_arrays(rows(piece.column("id"), sets), names=names)

    return docs.mapInArrow(run, schema)


PROFILE = "id long, n long, set long, sketch array<long>, keys array<long>, spare array<int>"


def _profile(ids: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
    sent: set[int] = set()
    rows: list[tuple] = []
    for i, s in zip(ids.to_pylist(), sets, strict=True):
        own = identity(s) if len(s) else None
        # equal sets of a piece give their keys once
        first = own is not None and i is not None and own not in sent
        if first:
            sent.add(own)
        keys, spare = cell_keys(s) if first else (None, None)
        rows.append((len(s), own, sketch(s) if len(s) else None, keys if keys is None else keys.view(np.int64), spare))
    n, own, bits, keys, spare = zip(*rows, strict=True)
    long, longs = pa.int64(), pa.list_(pa.int64())
    return [
        ids, pa.array(n, long), pa.array(own, long), pa.array(bits, longs), pa.array(keys, longs),
        pa.array(spare, pa.list_(pa.int32())),
    ]


def _sets(ids: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
    return [
        pa.array([identity(s) for s in sets], pa.int64()),
        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
    ]


def similar_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", counted: bool = True
) -> DataFrame:
    """Every document with the group it reaches over links: doc_id, n_shingles, class_id, n_links,
    component_id.

    Two documents link when their sets of different 5-word shingles (words between white space, A-Z
    lower-cased; a text of fewer words is one shingle) have a Jaccard similarity of 0.8 or more. Equal
    sets are one class (class_id, the smallest doc_id among them); n_links is the number of all other
    classes that a document's class links to (null unless `counted`, for callers that only need the
    groups). component_id is the smallest doc_id of the group.

    No group is held in one task: classes are linked to the smallest member of each bucket, and only
    members that this leaves in different groups are compared with each other. The links inside a group
    are counted between blocks of its classes. Texts without words,
    null ones too, are alone. A null doc_id gives a group of its own rows (null class) and links
    nothing. Rows that repeat a doc_id are one set each. Extra columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    profile = materialise(_map(rows, PROFILE, _profile), "profiles")
    classes = materialise(
        profile.filter(F.col("set").isNotNull() & F.col("id").isNotNull())
        .groupBy("set")
        .agg(
            F.min("id").alias("first"),
            F.first("n").alias("n"),
            F.first("sketch").alias("sketch"),
            F.first("spare", ignorenulls=True).alias("spare"),
        ),
        "classes",
    )
    keys = profile.filter(F.col("keys").isNotNull()).select("set", F.explode("keys").alias("key"))
    bucket = Window.partitionBy("key")
    members = materialise(
        keys.withColumn("least", F.min("set").over(bucket))
        .withColumn("most", F.max("set").over(bucket))
        .filter(F.col("least") < F.col("most"))
        .select("key", "set", "least")
        .distinct(),
        "members",
    )
    stars = materialise(
        members.filter(F.col("set") != F.col("least")).select(F.col("least").alias("a"), F.col("set").alias("b")).distinct(),
        "stars",
    )
    sets = _candidate_sets(rows, members, classes)
    links = materialise(_verified(_possible(stars, classes), sets), "links")
    groups = materialise(components(links), "groups")
    # what is left: members that are not similar to the smallest of their buckets
    for pairs_of in (_centres, _across):
        pairs = materialise(pairs_of(members, groups, classes).join(stars, ["a", "b"], "left_anti"), "pairs")
        late = materialise(_verified(pairs, sets), "late")
        if not late.isEmpty():
            links = materialise(links.unionByName(late), "links")
            groups = materialise(components(links), "groups")
        stars = stars.unionByName(pairs)
    if counted:
        n_links = _all_links(links, groups, classes, sets)
    else:
        n_links = groups.select(F.col("node").alias("set"), F.lit(None).cast("long").alias("n_links"))
    named = (
        classes.select("set", "first")
        .join(groups.select(F.col("node").alias("set"), "component"), "set", "left")
        .join(n_links, "set", "left")
        .withColumn("component", F.coalesce("component", F.col("set")))
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    named = named.join(smallest, "component").select(
        "set", F.col("first").alias("class_id"), (F.coalesce("n_links", F.lit(0).cast("long")) if counted else F.col("n_links")).alias("n_links"), "smallest"
    )
    # only sets with copies or links need the join; all others are their own group
    return (
        profile.select("id", "n", "set")
        .join(named, "set", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id")).alias("component_id"),
        )
    )


def _similar_enough(a: str, b: str) -> Column:
    """Sizes and bit sketches of n_a, sketch_a and n_b, sketch_b allow the similarity."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    apart = F.aggregate(
        F.zip_with(f"sketch_{a}", f"sketch_{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, bits: total + bits,
    )
    return (F.least(n_a, n_b) * DENOMINATOR >= F.greatest(n_a, n_b) * NUMERATOR) & (
        apart * (DENOMINATOR + NUMERATOR) <= (n_a + n_b) * (DENOMINATOR - NUMERATOR)
    )


def _side(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(
        F.col("set").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")
    )


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes whose sizes and bit sketches allow the similarity."""
    sides = pairs.join(_side(classes, "a"), "a").join(_side(classes, "b"), "b")
    return sides.filter(_similar_enough("a", "b")).select("a", "b")


def _mixed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, set, component, size of the bucket) of the buckets that hold several groups."""
    label = groups.select(F.col("node").alias("set"), "component")
    labelled = members.join(label, "set", "left").select(
        "key", "set", F.coalesce("component", F.col("set")).alias("component")
    )
    mixed = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
        .filter(F.col("low") < F.col("high"))
    )
    return materialise(labelled.join(mixed.select("key", "size"), "key"), "mixed")


def _centres(members: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's centre and its members outside the centre's group.

    Each bucket draws its centre by a hash, so a set meets as many members of a group as it shares
    buckets with it; what is similar to many of a large group is joined to it here, and need not be
    compared with all of it.
    """
    mixed = _mixed(members, groups)
    drawn = F.struct(F.xxhash64("key", "set").alias("h"), F.col("set").alias("set"), F.col("component").alias("component"))
    centre = mixed.groupBy("key").agg(F.min(drawn).alias("c"))
    pairs = (
        mixed.join(centre, "key")
        .filter(F.col("component") != F.col("c.component"))
        .select(F.least("set", "c.set").alias("a"), F.greatest("set", "c.set").alias("b"))
        .distinct()
    )
    return _possible(pairs, classes)


def _across(members: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a bucket but not a group, and could be similar.

    Most buckets hold one group by now. Of the others the large ones come from passages that many
    documents share. A set leaves those if its remaining keys are still enough to meet every similar
    set (see cell_keys); the sets that need them meet there among themselves.
    """
    across = _mixed(members, groups).withColumn("odd", F.col("key").bitwiseAND(F.lit(1).cast("long")).cast("int"))
    large = F.col("size") > LARGE_BUCKET
    leaving = (
        across.filter(large)
        .groupBy("set", "odd")
        .agg(F.count(F.lit(1)).alias("given_up"))
        .join(classes.select("set", "spare"), "set")
        .filter(F.col("given_up") <= F.element_at("spare", F.col("odd") + 1))
        .select("set", "odd")
    )
    left = across.filter(large).join(leaving, ["set", "odd"], "left_anti").select("key", "set", "component")
    sized = classes.select("set", "n", "sketch")
    rows = across.filter(~large).select("key", "set", "component").unionByName(left).join(sized, "set")
    a = rows.select("key", *(F.col(c).alias(f"{c}_a") for c in ("set", "component", "n", "sketch")))
    b = rows.select("key", *(F.col(c).alias(f"{c}_b") for c in ("set", "component", "n", "sketch")))
    return (
        a.join(b, "key")
        .filter((F.col("set_a") < F.col("set_b")) & (F.col("component_a") != F.col("component_b")))
        .filter(_similar_enough("a", "b"))
        .select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
        .distinct()
    )


def _candidate_sets(rows: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """(set, shingles) of one document of each class that shares a bucket with another class."""
    wanted = materialise(
        classes.join(members.select("set").distinct(), "set", "left_semi").select(F.col("first").alias("id")),
        "wanted",
    )
    found = rows.join(wanted, "id", "left_semi")
    return materialise(
        _map(found, "set long, shingles array<long>", _sets).groupBy("set").agg(F.first("shingles").alias("shingles")),
        "sets",
    )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough, exactly."""
    a = sets.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .withColumn("both", shared)
        .filter(DENOMINATOR * F.col("both") >= NUMERATOR * (F.size("x") + F.size("y") - F.col("both")))
        .select("a", "b")
    )


def _all_links(links: DataFrame, groups: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, n_links) of every set in a group: how many other sets it is similar to.

    Similar sets are in one group. In a group whose every pair is among `links`, each set links to
    all others. The sets of any other group are dealt to blocks by size band and hash, and each block
    is compared with itself and with those of its own and the next band, in a task's memory, so that
    pairs are never rows and a large group is spread over many tasks.
    """
    nodes = groups.select(F.col("node").alias("set"), "component")
    found = (
        links.join(nodes.withColumnRenamed("set", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("found"))
    )
    extent = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("members")).join(found, "component")
    every = F.col("members") * (F.col("members") - 1) / 2
    extent = materialise(extent.select("component", "members", (F.col("found") == every).alias("complete")), "extent")
    whole = nodes.join(extent.filter("complete"), "component").select("set", (F.col("members") - 1).alias("n_links"))
    # the bit length of the size: a similar set has at most one bit more
    banded = (
        nodes.join(extent.filter(~F.col("complete")).select("component"), "component")
        .join(classes.select("set", "n"), "set")
        .select("set", "component", F.length(F.bin("n")).alias("band"))
    )
    parts = banded.groupBy("component", "band").agg(
        F.ceil(F.count(F.lit(1)) * F.pow(F.lit(2.0), F.col("band")) / BLOCK_SHINGLES).alias("parts")
    )
    dealt = materialise(
        banded.join(parts, ["component", "band"]).select(
            "set", "component", "band", F.pmod(F.xxhash64("set"), F.col("parts")).alias("part")
        ),
        "dealt",
    )
    blocks = materialise(dealt.select("component", "band", "part").distinct(), "blocks")
    a = blocks.select("component", F.col("band").alias("band_a"), F.col("part").alias("part_a"))
    b = blocks.select("component", F.col("band").alias("band_b"), F.col("part").alias("part_b"))
    same = F.col("band_a") == F.col("band_b")
    pairs = a.join(b, "component").filter(
        (same & (F.col("part_a") <= F.col("part_b"))) | (F.col("band_a") + 1 == F.col("band_b"))
    )
    pair = ["component", "band_a", "part_a", "band_b", "part_b"]
    left = pairs.select(*pair, F.col("band_a").alias("band"), F.col("part_a").alias("part"), F.lit(0).alias("side"))
    right = pairs.filter(~same | (F.col("part_a") < F.col("part_b"))).select(
        *pair, F.col("band_b").alias("band"), F.col("part_b").alias("part"), F.lit(1).alias("side")
    )
    counts = (
        dealt.join(left.unionByName(right), ["component", "band", "part"])
        .join(sets, "set")
        .select(*pair, "side", "set", "shingles")
        .groupBy(*pair)
        .applyInArrow(_count_links, "set long, n long")
        .groupBy("set")
        .agg(F.sum("n").alias("n_links"))
    )
    return materialise(whole.unionByName(counts), "counts")


def _count_links(block: pa.Table) -> pa.Table:
    """(set, n): how many sets of side 1 each of side 0 is similar to, and the other way round; of one
    side alone, how many of the others."""
    own, side = block.column("set").to_numpy(), block.column("side").to_numpy()
    lists = block.column("shingles").combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy()
    ends = np.cumsum(sizes)
    bits = np.stack([sketch(flat[e - n : e].view(np.uint64)) for e, n in zip(ends, sizes, strict=True)]).view(np.uint64)
    names, place = np.unique(flat, return_inverse=True)
    rows = np.split(place, ends[:-1])
    firsts, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    counts = np.zeros(len(own), np.int64)
    has = np.zeros(len(names), np.int64)
    for k, i in enumerate(firsts):
        near = others if len(others) else firsts[k + 1 :]
        both = sizes[near] + sizes[i]
        apart = np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
        near = near[apart * (DENOMINATOR + NUMERATOR) <= both * (DENOMINATOR - NUMERATOR)]
        if not len(near):
            continue
        has[rows[i]] = 1
        starts = np.cumsum(sizes[near]) - sizes[near]
        shared = np.add.reduceat(has[np.concatenate([rows[j] for j in near])], starts)
        has[rows[i]] = 0
        hit = near[DENOMINATOR * shared >= NUMERATOR * (sizes[near] + sizes[i] - shared)]
        counts[i] += len(hit)
        counts[hit] += 1
    linked = counts > 0
    return pa.table({"set": pa.array(own[linked]), "n": pa.array(counts[linked])})
