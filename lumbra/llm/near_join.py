"""N-gram Jaccard join: grouped prefix join of word-shingle sets, exact.

1. Every text becomes its set of distinct word n-grams (64-bit hashes). Texts with the same set are one class from here on.
2. Grams are put in a global order, rare before frequent: all grams of all texts are counted in 2 ** ``BUCKETS_BITS`` buckets of their hash, and a gram's rank is
   its bucket's count on a logarithmic scale, then its hash. Any order is valid; grams that share a bucket only make the filter weaker.
3. The prefix of a set of n grams are its n - ceil(t n) + 1 first; two sets with similarity t share one gram of their prefixes. Classes
   with the same prefix and size are collapsed into one group, and the index of prefix grams holds groups only, of these only the grams that two
   groups of similar sizes share, and once for all grams that the same groups share. A group of several classes has one more gram, its own number. Grams in buckets that are frequent everywhere
   (``HEAVY``) are never gathered: their entries are rows from the start. Entries whose places in the prefixes leave too little to share are left out.
4. Groups that share a gram are candidates. Each group's home is the most central group it shares a gram with (the one whose grams reach most groups).
   A home's groups are expanded to their classes and dealt out to cells of bounded size, the home's own class in each. The classes of a cell are
   compared in memory; whole texts are shuffled once to come to their cells, and links are joined to components.
5. Grams whose classes are still in several components and did not all meet in one cell are compared again in pairs of blocks of bounded
   size: the blocks of the gram's largest component with all others, others with each other. Grams with the same groups count once.
   As components are asked for, pairs inside one component are not needed; no link between two is lost, and no pair is ever a row.

Defined results: null texts and texts without words have no grams and are linked with nothing; shorter texts than n words are one gram;
repeated rows are in one class; rows with a null identifier are components of their own, with a null component; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, dropped, numbered, own_job, raw, stored, without
from .words import gram_set, mixed, word_hashes

BUCKETS_BITS, SLICES = 22, 64
HEAVY = 20_000  # a gram in a bucket with so many texts, and four times the mean, is heavy
CELL_SETS, CELL_GRAMS = 256, 1_000_000
NEIGHBOURS = 16  # entries of a gram that are compared by place
RANGE_GRAMS = 1_000_000  # prefix grams that one matching task is meant to hold
STEP = 256


def _sets(batches, n: int, column: int):
    """(batch, gram sets of its texts, A-Z lower-cased), in steps."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            texts = [(t or "").encode("utf-8", "replace").lower() for t in part.column(column).to_pylist()]
            yield part, [gram_set(w, n) for w in word_hashes(texts)]


def _class(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def prefix_length(size: np.ndarray | int, num: int, den: int):
    """n - ceil(n num / den) + 1."""
    return size + (-(size * num) // den) + 1


class Order:
    """The global order: by the rank of a gram's bucket, then by hash."""

    def __init__(self, ranks: np.ndarray, heavy: int = 256):
        self.ranks, self.heavy = ranks, heavy  # buckets of rank ``heavy`` or more are frequent everywhere

    def of(self, grams: np.ndarray) -> np.ndarray:
        return self.ranks[(grams >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)]

    def prefix(self, grams: np.ndarray, length: int) -> np.ndarray:
        """The first ``length`` of the sorted ``grams``."""
        return grams[np.argsort(self.of(grams), kind="stable")[:length]]


def _rank(count: np.ndarray) -> np.ndarray:
    return np.minimum(255, 8 * np.log2(1 + count.astype(np.float64))).astype(np.uint8)


def gram_order(texts: DataFrame, n: int, heavy: int = HEAVY) -> Order:
    """Counts the grams of all texts by bucket. A task sums its texts in one array; arrays are summed slice by slice, and one byte a bucket reaches the driver."""
    width = (1 << BUCKETS_BITS) // SLICES

    def count(batches):
        total, held, size = np.zeros(1 << BUCKETS_BITS, np.uint16), [], 0

        def add():
            own, times = np.unique((np.concatenate(held) >> np.uint64(64 - BUCKETS_BITS)).astype(np.uint32), return_counts=True)
            total[own] = np.minimum(total[own].astype(np.int64) + times, 65535)

        for _, sets in _sets(batches, n, 0):
            held += sets
            size += sum(map(len, sets))
            if size > 500_000:
                add()
                held, size = [], 0
        if held:
            add()
            parts = total.reshape(SLICES, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([pa.compress(p.tobytes(), "zstd", asbytes=True) for p in parts], pa.binary())], names=["slice", "counts"])

    def sums(batches):
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(pa.decompress(blob, width * 2, "zstd", asbytes=True), np.uint16)
                got[k] = got[k] + part if k in got else part.astype(np.uint32)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([_rank(x).tobytes() for x in got.values()], pa.binary()), pa.array([int(x.sum(dtype=np.int64)) for x in got.values()], pa.int64())], names=["slice", "ranks", "grams"])

    ranks, grams = np.zeros(1 << BUCKETS_BITS, np.uint8), 0
    with own_job(texts.sparkSession):
        got = texts.mapInArrow(count, "slice int, counts binary").repartition("slice").mapInArrow(sums, "slice int, ranks binary, grams bigint").collect()  # SLICES rows
    for r in got:
        ranks[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["ranks"], np.uint8)
        grams += r["grams"]
    return Order(ranks, int(_rank(np.array([max(heavy, 4 * grams >> BUCKETS_BITS)]))[0]))


PROFILE = "id bigint, n int, class binary, grp bigint, prefix binary"


def profiles(rows: DataFrame, n: int, num: int, den: int, shared: Broadcast) -> DataFrame:
    """Per row (id, text): size of the set, its class, its group and its prefix. ``shared`` is the broadcast ``Order``."""

    def run(batches):
        own = shared.value
        for part, sets in _sets(batches, n, 1):
            prefix = [own.prefix(s, prefix_length(len(s), num, den)).tobytes() if len(s) else None for s in sets]
            size = [len(s) for s in sets]
            kind = [_class(s) if len(s) else None for s in sets]
            group = [int.from_bytes(blake2b(p + str(k).encode(), digest_size=8).digest(), "little", signed=True) if p else None for p, k in zip(prefix, size, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int32()), pa.array(kind, pa.binary()), pa.array(group, pa.int64()), pa.array(prefix, pa.binary())], names=["id", "n", "class", "grp", "prefix"])

    return rows.mapInArrow(run, PROFILE)


ENTRY = "gram bigint, grp bigint, n int, k bigint, times bigint"


def _entries(grams: np.ndarray, groups: np.ndarray, sizes: np.ndarray, k: np.ndarray, times: np.ndarray):
    for at in range(0, len(grams), 50_000):
        part = slice(at, at + 50_000)
        columns = (grams[part].view(np.int64), groups[part], sizes[part].astype(np.int32), k[part].astype(np.int64), times[part].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "grp", "n", "k", "times"])


def _partnered(grams: np.ndarray, sizes: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which entries, sorted by gram and size, can have a partner at their gram.

    Sizes must be similar. If the gram, at its places in two prefixes, is the first that two sets share, they share no more than what follows it there in either; if that is
    too little, the pair has an earlier gram in common or is none. Places are compared for up to ``NEIGHBOURS`` next entries; larger grams keep all of similar size.
    """
    kept = np.zeros(len(grams), bool)
    start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    times = np.diff(np.append(start, len(grams)))
    times = np.repeat(times, times)
    for d in range(1, NEIGHBOURS + 1):
        if d >= len(grams):
            break
        i = np.flatnonzero(grams[d:] == grams[:-d])
        i = i[sizes[i] * den >= sizes[i + d] * num]  # at i the smaller set
        if not len(i):
            break
        few = times[i] <= NEIGHBOURS + 1
        most = 1 + np.minimum(sizes[i] - place[i], sizes[i + d] - place[i + d])
        i = i[~few | (most * (num + den) >= num * (sizes[i] + sizes[i + d]))]
        kept[i] = kept[i + d] = True
    return kept


def shared_grams(prefixes: DataFrame, bits: int, num: int, den: int, shared: Broadcast) -> DataFrame:
    """From rows (grp, n, prefix): the index (gram, group, n, groups of the gram, times) of grams that groups of similar sizes share.

    Grams that the same groups share are one entry each, under a hash of these groups; ``times`` says how many they are.
    """
    ranges = 1 << bits
    blobs = {"grams": np.uint64, "owner": np.int32, "place": np.uint16, "groups": np.int64, "sizes": np.int32}

    def slices(batches):
        held, size = {}, 0

        def out():
            own = shared.value
            groups = np.fromiter((g for g, _ in held), np.int64, len(held))
            sizes = np.fromiter((s for _, s in held), np.int32, len(held))
            grams = [np.frombuffer(p, np.uint64) for p in held.values()]
            of = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
            place_in = np.concatenate([np.minimum(np.arange(len(x)), 65535) for x in grams]).astype(np.uint16)  # a later place than noted only weakens the filter
            grams = np.concatenate(grams)
            light = np.flatnonzero(own.of(grams) < own.heavy)
            by = light[np.argsort(grams[light])]
            grams, of, place_in = grams[by], of[by], place_in[by]
            cut = np.searchsorted(grams >> np.uint64(64 - bits), np.arange(ranges + 1, dtype=np.uint64))
            columns = [[] for _ in blobs]
            for a, b in zip(cut, cut[1:], strict=False):
                mine, owner = np.unique(of[a:b], return_inverse=True)
                for column, x in zip(columns, (grams[a:b], owner.astype(np.int32), place_in[a:b], groups[mine], sizes[mine]), strict=True):
                    column.append(x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["range", *blobs])

        for batch in batches:
            for g, k, p in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (g, k) not in held:
                    held[g, k] = p
                    size += len(p) >> 3
                    if size > 500_000:
                        yield out()
                        held, size = {}, 0
        if held:
            yield out()

    def match(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(blobs) + 1)]
            for r, *own in zip(*columns, strict=True):
                grams, owner, place, groups, sizes = (np.frombuffer(x, t) for x, t in zip(own, blobs.values(), strict=True))
                parts.setdefault(r, []).append((grams, groups[owner], sizes[owner], place))
        for held in parts.values():
            grams, groups, sizes, place = (np.concatenate(x) for x in zip(*held, strict=True))
            if not len(grams):
                continue
            order = np.lexsort((groups, grams))
            order = order[np.append(True, (grams[order][1:] != grams[order][:-1]) | (groups[order][1:] != groups[order][:-1]))]
            order = order[np.lexsort((sizes[order], grams[order]))]
            grams, groups, sizes, place = grams[order], groups[order], sizes[order], place[order]
            kept = _partnered(grams, sizes.astype(np.int64), place.astype(np.int64), num, den)
            grams, groups, sizes = grams[kept], groups[kept], sizes[kept]
            if len(grams):
                start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
                k = np.diff(np.append(start, len(grams)))
                name = mixed(np.add.reduceat(mixed(groups.view(np.uint64)), start) + k.astype(np.uint64))
                _, first, times = np.unique(name, return_index=True, return_counts=True)
                one = np.zeros(len(k), bool)
                one[first] = True
                many = np.zeros(len(k), np.int64)
                many[first] = times
                shown = np.repeat(one, k)
                yield from _entries(np.repeat(name, k)[shown], groups[shown], sizes[shown], np.repeat(k, k)[shown], np.repeat(many, k)[shown])

    def heavy(batches):
        own = shared.value
        for batch in batches:
            grams = [np.frombuffer(p, np.uint64) for p in batch.column(2).to_pylist()]
            of = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
            grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            many = own.of(grams) >= own.heavy
            grams, of = grams[many], of[many]
            yield from _entries(grams, np.asarray(batch.column(0))[of], np.asarray(batch.column(1))[of], *[np.ones(len(grams))] * 2)

    found = prefixes.mapInArrow(slices, "range int, " + ", ".join(f"{c} binary" for c in blobs)).repartitionById(ranges, F.col("range")).mapInArrow(match, ENTRY)
    found = found.groupBy("gram", "grp").agg(F.min("n").alias("n"), F.min("k").alias("k"), F.sum("times").alias("times"))
    if int(shared.value.ranks.max()) < shared.value.heavy:
        return found
    rows = prefixes.mapInArrow(heavy, ENTRY).dropDuplicates(["gram", "grp"]).drop("k")
    return found.unionByName(rows.join(rows.groupBy("gram").agg(F.count("grp").alias("k")).where("k > 1"), "gram"))


def _compare(names: list, sets: list[np.ndarray], part: list, done: list, first: np.ndarray, other: np.ndarray, num: int, den: int):
    """Links between classes of different parts that have not met before, of block ``first`` with block ``other``: each set of parts that they join as a star."""
    rows, cols = np.flatnonzero(first), np.flatnonzero(other)
    if not len(rows) or not len(cols) or len(set(part)) < 2:
        return
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams = np.concatenate(sets)
    by = np.argsort(grams, kind="stable")
    grams, owner = grams[by], owner[by]
    new = np.append(True, grams[1:] != grams[:-1])
    place = np.cumsum(new) - 1
    kept = np.bincount(place) > 1
    number = np.cumsum(kept) - 1
    mark = kept[place]
    owner, place = owner[mark], number[place[mark]]
    common = np.zeros((len(rows), len(cols)), np.float32)
    wide = 2048 if len(sets) > 16 else 1 << 14
    for at in range(0, int(kept.sum()), wide):
        lo, hi = np.searchsorted(place, [at, at + wide])
        dense = np.zeros((len(sets), min(wide, int(kept.sum()) - at)), np.float32)
        dense[owner[lo:hi], place[lo:hi] - at] = 1
        common += dense[rows] @ dense[cols].T
    union = sizes[rows][:, None] + sizes[cols][None, :] - common
    parent: dict = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for x, y in zip(*np.nonzero(den * common >= num * union), strict=True):
        x, y = rows[x], cols[y]
        if x != y and done[x] != done[y]:
            u, v = root(part[x]), root(part[y])
            if u != v:
                parent[u] = v
    centre: dict = {}
    for name, own in sorted(dict(zip(part, names, strict=True)).items()):  # one class for each part
        up = root(name)
        if up in centre:
            yield centre[up], own
        else:
            centre[up] = own


CELL = ["key", "i", "j"]


def cell_links(cells: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between the classes of each cell. ``cells``: key, i, j, block, class, id, part, done; ``rows``: id and text."""
    ids = stored(cells.select("id").distinct(), "near-wanted")
    texts = among(rows, "id", ids)
    dealt = texts.join(cells, "id").select(*CELL, "block", "class", "part", "done", "text").repartition(*CELL).sortWithinPartitions(*CELL)

    def links(held: list):
        seen, names, sets, part, done, block = set(), [], [], [], [], []
        for batch in held:
            for piece, got in _sets([batch], n, 7):
                columns = [piece.column(c).to_pylist() for c in (4, 5, 6, 3)]
                for s, kind, p, d, b in zip(got, *columns, strict=True):
                    if (kind, b) not in seen and _class(s) == kind:  # repeated identifiers bring other texts
                        seen.add((kind, b))
                        for column, x in zip((names, sets, part, done, block), (kind, s, p, d, b), strict=True):
                            column.append(x)
        i, j = held[0].column(1)[0].as_py(), held[0].column(2)[0].as_py()
        block = np.array(block)
        return list(_compare(names, sets, part, done, block == i, block == j, num, den))

    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(3)])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), batch.num_rows]
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                now = tuple(keys[a])
                if now != key and held:
                    out += links(held)
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])
        if held:
            out = links(held)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, tag: str) -> DataFrame:
    """(node, root) of every node of links (a, b): the least node that can be reached. Least neighbours are followed and then jumped over until nothing changes."""
    a, b = F.col("a"), F.col("b")
    ends = F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((a, b), (b, a), (a, a), (b, b))])).alias("e")
    edges = stored(links.select(ends).select("e.*").distinct(), f"{tag}-edges")  # each node is a neighbour of its own
    got = stored(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root")), f"{tag}-label")
    while True:
        label = got.select("node", "root")
        near = edges.join(label.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node"))
        near = near.agg(F.min("root").alias("less"), F.max(F.when(F.col("x") == F.col("y"), F.col("root"))).alias("was"))
        jump = label.select(F.col("node").alias("less"), F.col("root").alias("far"))
        new = F.least("less", "far")
        after = stored(near.join(jump, "less").select("node", new.alias("root"), (new != F.col("was")).alias("moved")), f"{tag}-label")
        dropped(got)
        got = after
        if got.where("moved").limit(1).count() == 0:
            dropped(edges)
            return got.select("node", "root")


def homes(entries: DataFrame) -> DataFrame:
    """(grp, home): the most central group that shares a gram with it, its own included."""
    weight = entries.groupBy("grp").agg(F.sum(F.col("k") * F.col("times")).alias("c"))
    hub = entries.join(weight, "grp").groupBy("gram").agg(F.max(F.struct("c", "grp")).alias("hub"))
    return entries.join(hub, "gram").groupBy("grp").agg(F.max("hub")["grp"].alias("home"))


def _parts(count, grams):
    return F.ceil(F.greatest(count / CELL_SETS, grams / CELL_GRAMS)).cast("int")


def home_cells(classes: DataFrame, home: DataFrame) -> DataFrame:
    """The first round's cells: classes dealt out within their home, with the home's least class as a guest in each cell that it isn't a member of.

    ``alone`` marks the only class of a home that is its own.
    """
    own = classes.join(home, "grp")
    size = own.groupBy("home").agg(F.count("class").alias("m"), _parts(F.count("class"), F.sum("n")).alias("subs"))
    lead = own.groupBy("grp").agg(F.min(F.struct("class", "least", "n")).alias("lead"), F.min("home").alias("its")).select(F.col("grp").alias("home"), "lead.*", "its")
    sub = F.pmod(F.xxhash64("class"), F.col("subs").cast("long")).cast("int")
    member = own.join(size, "home").select("home", sub.alias("sub"), "class", "least", "grp", "n", F.lit(False).alias("guest"), ((F.col("m") == 1) & (F.col("grp") == F.col("home"))).alias("alone"))
    guests = lead.join(size, "home").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).where((F.col("its") != F.col("home")) | (F.col("sub") != sub))
    return member.unionByName(guests.select("home", "sub", "class", "least", F.col("home").alias("grp"), "n", F.lit(True).alias("guest"), F.lit(False).alias("alone")))


def block_cells(now: DataFrame) -> DataFrame:
    """The second round's cells from (gram, class, n, least, part, done): blocks of each gram's largest part with those of all others, and of the others with each other."""
    sums = now.groupBy("gram", "part").agg(F.count("class").alias("m"), F.sum("n").alias("s"))
    sums = sums.groupBy("gram").agg(F.max(F.struct("m", "part", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    plan = sums.select("gram", F.col("top.part").alias("major"), _parts(F.col("top.m"), F.col("top.s")).alias("wide"), F.greatest(F.lit(1), _parts(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s"))).alias("rest"))
    own = now.join(plan, "gram").withColumn("large", F.col("part") == F.col("major"))
    hashed = F.xxhash64("class")
    own = own.withColumn("block", F.when(F.col("large"), F.col("rest") + F.pmod(hashed, F.col("wide").cast("long"))).otherwise(F.pmod(hashed, F.col("rest").cast("long"))).cast("int"))
    last = F.when(F.col("large"), F.col("rest")).otherwise(F.col("rest") + F.col("wide")) - 1
    dealt = own.withColumn("with", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return dealt.select(F.col("gram").alias("key"), F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "class", F.col("least").alias("id"), "part", "done")


def jaccard_components(documents: DataFrame, id_column: str = "doc_id", n: int = 5, num: int = 80, den: int = 100, heavy: int = HEAVY) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id that links with similarity >= num / den reach) and class_id (the same set)."""
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    order = documents.sparkSession.sparkContext.broadcast(gram_order(rows.select("text"), n, heavy))  # one byte a bucket
    prefix = stored(profiles(rows, n, num, den, order), "near-profiles")
    known = prefix.where(F.col("class").isNotNull() & F.col("id").isNotNull())
    size = known.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    bits = max(3, min(14, (size // 8 // RANGE_GRAMS).bit_length()))
    classes = stored(known.groupBy("class").agg(F.min("id").alias("least"), F.min("grp").alias("grp"), F.min("n").alias("n")), "near-classes")
    crowd = classes.groupBy("grp").agg(F.count("class").alias("k"), F.min("n").alias("n")).where("k > 1").select(F.col("grp").alias("gram"), "grp", "n", "k", F.lit(1).cast("long").alias("times"))
    entries = stored(shared_grams(known.select("grp", "n", "prefix"), bits, num, den, order).unionByName(crowd), "near-index")
    # First round: every class with a candidate partner in its home's cell.
    placed = stored(home_cells(classes.select("class", "least", "grp", "n"), homes(entries)), "near-homes")
    cells = placed.where(~F.col("alone")).select(F.col("home").alias("key"), F.col("sub").alias("i"), F.col("sub").alias("j"), F.col("sub").alias("block"), "class", F.col("least").alias("id"), F.col("class").alias("part"), F.col("class").alias("done"))
    links = stored(cell_links(cells, rows, n, num, den), "near-links")
    label = components(links, "near")
    # Second round: grams whose classes are in several components and did not all meet in one cell.
    member = placed.where(~F.col("guest")).join(label, F.col("class") == F.col("node"), "left")
    done = F.concat(F.hex("home"), F.lit(":"), F.col("sub")).cast("binary")
    member = stored(member.select("class", "least", "grp", "n", F.coalesce("root", "class").alias("part"), done.alias("done")), "near-members")
    of = member.groupBy("grp").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("done").alias("from"), F.max("done").alias("to"))
    spans = entries.join(of, "grp").groupBy("gram").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("from").alias("from"), F.max("to").alias("to"),
        F.count("grp").alias("k"), F.bit_xor(F.xxhash64("grp")).alias("x"), F.sum(F.hash("grp").cast("long")).alias("y"),
    )
    open_ = spans.where("lo != hi and `from` != `to`").groupBy("k", "x", "y").agg(F.min("gram").alias("gram"))
    now = stored(entries.select("gram", "grp").join(open_.select("gram"), "gram").join(member, "grp").select("gram", "class", "n", "least", "part", "done"), "near-open")
    if now.limit(1).count():
        again = stored(cell_links(stored(block_cells(now), "near-blocks"), rows, n, num, den), "near-links")
        part_of = member.select("class", "part")
        joins = again.join(part_of.select(F.col("class").alias("a"), F.col("part").alias("pa")), "a").join(part_of.select(F.col("class").alias("b"), F.col("part").alias("pb")), "b")
        joined = components(joins.select(F.col("pa").alias("a"), F.col("pb").alias("b")), "near")
        parts = joined.select(F.col("node").alias("part"), F.col("root").alias("whole"))
        label = member.join(parts, "part", "left").select(F.col("class").alias("node"), F.coalesce("whole", "part").alias("root"))
    reach = classes.join(label, classes["class"] == label["node"], "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    least = reach.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(reach.join(least, "root").select("class", "component_id", F.col("least").alias("class_id")), "near-named")
    return prefix.select("id", "n", "class").join(named, "class", "left").select(
        "id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id")).alias("component_id"),
        F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("class_id", "id")).alias("class_id"),
    )


def drop_near_duplicates(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100, files: bool = False) -> DataFrame:
    """The first row of each component, with the columns of ``documents``; ``files`` as in ``numbered``."""
    rows = numbered(documents, F.col("text").alias("text"), files=files)
    gone = jaccard_components(rows.select("_row", "text"), "_row", n, num, den).where("id != component_id").select(F.col("id").alias("_row"))
    return raw(without(rows, "_row", stored(gone, "near-gone")))
