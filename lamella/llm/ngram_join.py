"""N-gram Jaccard join over a prefix tree of globally ordered shingle sets.

Two sets that link share all but few elements: of a set of n, at most ``spare`` = n - ceil(percent n / 100)
are missing in the other. So with all elements in one order the sets meet in an element
among the first ``spare`` + 1 of each. The order is by rarity, then by hash.

1. Equal sets form a class. 2. Each class hands in its elements; one shuffle counts in how many classes
each occurs. An element of one class comes first in the order and joins nothing, so a class with more than
``spare`` of them has no partner and is out. Of the others only the necessary prefix is kept: the rarest
``spare`` + 1 less those. A large set hands in only elements whose hash lies below a share of the hash space
that depends on the size; ``spare`` stays as it is, and the share is such that it falls short of the
elements by eight standard deviations at least (a chance of the order of a collision of two 64-bit hashes).
A set whose partners may stand beyond the next size from which a smaller share counts hands in for that share as well.
Elements that are very frequent in a sample of the classes are not counted but ranked last, so no task holds all their rows;
which these are changes the order, not the result.
3. Classes that share a kept element are candidates; classes that candidates connect form a cluster. 4. Clusters are cut
into blocks of bounded size, each with the cluster's first class as a bridge. In a block the sets lie in a tree whose
levels are ranges of the hash; a probe walks it level by level, carries the differences so far, shares them
among all sets below a node, and leaves a subtree when these and the least difference that the
remaining lengths force exceed the bound, or when all below is joined to it already. 5. Where a
cluster of several blocks is not yet one component, the classes outside its largest component
probe all blocks, in groups of bounded size.

Only links that join components are kept, so a large group of near copies costs as many rows
as it has members.

Edge cases: null texts and texts without words have the empty set and link with nothing;
fewer words than a shingle make one shingle; rows of equal id are documents of their own;
component_id ignores null ids (null where all are); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm import windows as W
from lamella.llm.common import batch, chunks, components, discard, keyed, keyed_columns, stored

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Shares of the hash space that sets hand in, falling with their size; standard deviations that part them from too few.
SHARES, DEVIATIONS = (1.0, 0.75, 0.5, 0.375, 0.25), 8
#: One class of so many is in the sample that finds frequent elements; an element of so many sampled classes is frequent; at most so many are taken.
SAMPLED, FREQUENT, MOST_FREQUENT = 64, 16, 1 << 16
LEVELS = 32
BLOCK = 1000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted within each document, bounds)."""
    low = LOWER[data]
    starts, ends = W.word_bounds(low, offsets)
    values = W.word_values(low, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    many = np.diff(bounds)
    count = np.where(many >= size, many - size + 1, np.minimum(many, 1))
    doc = np.repeat(np.arange(len(many)), count)
    at = bounds[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    hashes = W.Prefix(values).stretch(at, np.minimum(at + size, bounds[doc + 1]))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(many) + 1))


def most_different(total: np.ndarray | int, percent: int):
    """Largest symmetric difference of two linked sets with ``total`` elements together:
    with i common of u, 100 i >= percent u, and i = (total - d) / 2, u = (total + d) / 2."""
    return (100 - percent) * total // (100 + percent)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(hashes))])
    return W.mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ np.diff(bounds).astype(np.uint64))


def shares(percent: int) -> list[tuple[int, float]]:
    """(size from which on a share of the hash space is enough, that share)."""
    out, spare = [(0, 1.0)], 1.25 * (100 - percent) / 100
    for share in SHARES[1:]:
        if share > spare:
            out.append((int(np.ceil(DEVIATIONS**2 * share * (1 - share) / (share - spare) ** 2)), share))
    return out


_FEATURES = pa.schema([("key_id", pa.int64()), ("key_h", pa.int64()), ("row_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("sample", pa.list_(pa.int64()))])
_ELEMENTS = pa.schema([("element", pa.int64()), ("sig", pa.int64()), ("entry", pa.int64())])


def _new(sig: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which classes this task meets for the first time."""
    out = np.zeros(len(sig), bool)
    for i, s in enumerate(sig.tolist()):
        if s not in seen:
            seen.add(s)
            out[i] = True
    return out


def _features(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for row, stop, data, offsets in chunks(b.column(3)):
                hashes, bounds = shingle_sets(data, offsets, size)
                sig = signatures(hashes, bounds)
                sampled = (sig % np.uint64(SAMPLED) == 0) & _new(np.where(sig % np.uint64(SAMPLED) == 0, sig, 0), seen)
                taken = np.where(sampled, np.diff(bounds), 0)
                some = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(taken)]).astype(np.int32), hashes.view(np.int64)[np.repeat(sampled, np.diff(bounds))])
                yield batch(_FEATURES, *(b.column(i).slice(row, stop - row) for i in range(3)), np.diff(bounds), sig.view(np.int64), some)

    return run


def _elements(size: int, percent: int, frequent: Broadcast) -> Callable:
    """(element, class, entry): entry holds the number of elements that must occur in other classes, times 8, and the place
    of the share; it is negative where the element is frequent. Every class comes once from a task."""
    sizes = shares(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        often = frequent.value
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                hashes, bounds = shingle_sets(data, offsets, size)
                sig, n = signatures(hashes, bounds), np.diff(bounds)
                use = (n > 0) & _new(sig, seen)
                spare = n - (percent * n + 99) // 100
                for place, (least, share) in enumerate(sizes):
                    beyond = sizes[place + 1][0] if place + 1 < len(sizes) else np.iinfo(np.int64).max
                    here = use & (n < beyond) & (n * 100 // percent >= least)
                    if not here.any():
                        continue
                    inside = np.repeat(here, n)
                    if share < 1:
                        inside &= hashes < np.uint64(int(share * 2.0**64))
                    count = np.concatenate([[0], np.cumsum(inside)])
                    given = count[bounds[1:]] - count[bounds[:-1]]
                    mine = hashes[inside]
                    entry = np.repeat(np.maximum(given - spare, 1) * 8 + place, given)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, mine), len(often) - 1)
                        entry = np.where(often[at] == mine, -entry, entry)
                    yield batch(_ELEMENTS, W.mix(mine ^ np.uint64(place)).view(np.int64), np.repeat(sig, given).view(np.int64), entry)

    return run


def _frequent(own: DataFrame) -> np.ndarray:
    """Hashes, in order, of the most frequent elements of the sampled classes: at most MOST_FREQUENT, 0.5 MB."""
    some = own.where(F.size("sample") > 0).groupBy("sig").agg(F.first("sample").alias("sample"))
    count = some.select(F.explode("sample").alias("element")).groupBy("element").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    top = count.orderBy(F.desc("n"), "element").limit(MOST_FREQUENT).select("element").toArrow()
    return np.sort(top["element"].to_numpy().astype(np.int64).view(np.uint64))


def _candidates(texts: DataFrame, own: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): each class beside the first of every kept element, so that classes which share one are connected."""
    frequent = own.sparkSession.sparkContext.broadcast(_frequent(own))
    rows = texts.mapInArrow(_elements(size, percent, frequent), "element long, sig long, entry long")
    # Rows of a frequent element are spread by class: their count is not needed.
    one = Window.partitionBy("element", F.when(F.col("entry") < 0, F.col("sig")).otherwise(0))
    counted = rows.select("*", F.count("*").over(one).alias("n"), F.min("sig").over(one).alias("first"), F.max("sig").over(one).alias("last"))
    shared = counted.where("entry < 0 or first <> last").select("sig", F.abs("entry").alias("entry"), F.when(F.col("entry") < 0, (1 << 62)).otherwise(F.col("n")).alias("n"), "element")
    # Every class lies in one partition, so nothing is gained from collecting before the shuffle.
    order = shared.repartition("sig", "entry").groupBy("sig", "entry").agg(F.sort_array(F.collect_set(F.struct("n", "element"))).alias("order"))
    need = F.shiftright("entry", 3).cast("int")
    kept = order.where(F.size("order") >= need).select("sig", F.explode(F.slice("order", F.lit(1), F.size("order") - need + 1)).alias("e"))
    kept = stored(kept.select("sig", "e.element", (F.col("e.n") == 1 << 62).alias("frequent")), "prefixes")
    frequent.unpersist()
    first = kept.groupBy("element", "frequent").agg(F.min("sig").alias("a"), F.max("sig").alias("z")).where("a < z").select("element", "frequent", "a")
    few = kept.where("not frequent").join(first.where("not frequent").select("element", "a"), "element")
    # The frequent elements are at most MOST_FREQUENT for each share.
    many = kept.where("frequent").join(F.broadcast(first.where("frequent").select("element", "a")), "element")
    return few.unionAll(many).where("sig <> a").select("a", F.col("sig").alias("b"))


class OrderedSet:
    __slots__ = ("sig", "values", "n", "cut", "path")

    def __init__(self, sig: int, values: np.ndarray):
        self.sig, self.values, self.n = sig, values, len(values)
        level = (values >> np.uint64(64 - LEVELS.bit_length() + 1)).astype(np.int64)
        self.cut = np.searchsorted(level, np.arange(LEVELS + 1))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(values ^ np.uint64(0x2545F4914F6CDD1D)))])
        self.path = prefix[self.cut[1:]] - prefix[self.cut[:-1]]

    def stretch(self, level: int) -> np.ndarray:
        return self.values[self.cut[level] : self.cut[level + 1]]


@dataclass
class Level:
    """The nodes of one level: ``first`` to ``last`` of the tree's sets lie below a node, its path holds ``size`` elements from
    ``start`` on in ``codes``, places in ``elements``. ``low``, ``high``: elements that the shortest and the longest set below still have to come."""

    first: np.ndarray
    last: np.ndarray
    parent: np.ndarray
    start: np.ndarray
    size: np.ndarray
    codes: np.ndarray
    elements: np.ndarray
    low: np.ndarray
    high: np.ndarray
    longest: np.ndarray


class Tree:
    """Sets by their paths. Sets below a node are neighbours in ``sets``; a level's nodes are walked together."""

    def __init__(self, sets: list[OrderedSet]):
        paths = np.stack([s.path for s in sets])
        order = np.lexsort(paths.T[::-1])
        paths, self.sets = paths[order], [sets[i] for i in order.tolist()]
        n, cuts = np.array([s.n for s in self.sets]), np.stack([s.cut for s in self.sets])
        new, node = np.arange(len(sets)) == 0, np.zeros(len(sets), np.int64)
        self.levels = []
        for level in range(LEVELS):
            new[1:] |= paths[1:, level] != paths[:-1, level]
            first, parent = np.flatnonzero(new), node[new]
            size = cuts[first, level + 1] - cuts[first, level]
            elements, codes = np.unique(np.concatenate([self.sets[i].stretch(level) for i in first.tolist()]), return_inverse=True)
            low, high, passed = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first), cuts[first, level + 1]
            self.levels.append(Level(first, np.append(first[1:], len(sets)), parent, np.cumsum(size) - size, size, codes, elements, low - passed, high - passed, high))
            node = np.cumsum(new) - 1

    def linked(self, probe: OrderedSet, wanted: np.ndarray, percent: int) -> np.ndarray:
        """Places of the ``wanted`` sets that link with ``probe``."""
        count = np.concatenate([[0], np.cumsum(wanted)])
        far = np.int64(1) << 40
        differ = np.zeros(1, np.int64)  # so far, of every node of the level before; ``far`` where the walk has left it
        for level, t in enumerate(self.levels):
            at = np.flatnonzero((differ[t.parent] < far) & (count[t.last] > count[t.first]))
            if not len(at):
                return at
            own = probe.stretch(level)
            place = np.minimum(np.searchsorted(t.elements, own), max(len(t.elements) - 1, 0))
            shared = np.zeros(len(t.elements), bool)
            if len(t.elements):
                shared[place[t.elements[place] == own]] = True
            size = t.size[at]
            stop = np.cumsum(size)
            codes = t.codes if len(at) == len(t.first) else t.codes[np.repeat(t.start[at] - stop + size, size) + np.arange(stop[-1])]
            total = np.concatenate([[0], np.cumsum(shared[codes])])
            d = differ[t.parent[at]] + size + len(own) - 2 * (total[stop] - total[stop - size])
            # What the remaining lengths must differ at least, for the set below that suits best.
            rest = probe.n - probe.cut[level + 1]
            least = d + np.maximum(0, np.maximum(t.low[at] - rest, rest - t.high[at]))
            near = least <= most_different(probe.n + t.longest[at], percent)
            differ = np.full(len(t.first), far)
            differ[at[near]] = d[near]
        return self.levels[-1].first[differ < far]  # sets of one path to the last level are equal, so each node has one


def join_block(sets: list[OrderedSet], percent: int, known: dict[int, int] | None = None, probes: set[int] | None = None, targets: set[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the components of these sets; ``known``: components that are given already.
    Without ``probes`` every set meets every other; with them, each probe meets the targets."""
    if len(sets) < 2:
        return []
    tree, links = Tree(sets), []
    sigs = [s.sig for s in tree.sets]
    label = np.arange(len(sigs)) if known is None else np.unique([known[x] for x in sigs], return_inverse=True)[1]
    wanted = np.array([targets is None or x in targets for x in sigs])
    for p in sorted(range(len(sigs)), key=lambda i: (tree.sets[i].n, sigs[i])):
        if probes is None:
            wanted[p] = False  # it meets all others now
        elif sigs[p] not in probes:
            continue
        other = wanted & (label != label[p])
        if other.any():
            for q in tree.linked(tree.sets[p], other, percent).tolist():
                if label[q] != label[p]:
                    links.append((sigs[p], sigs[q]))
                    label[label == label[q]] = label[p]
    return links


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _block(size: int, percent: int, probing: bool) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        seen: dict[int, np.ndarray] = {}
        known = dict(zip(table["sig"].to_pylist(), table["root"].to_pylist(), strict=True))
        for row, stop, data, offsets in chunks(table["text"]):
            hashes, bounds = shingle_sets(data, offsets, size)
            for i, s in enumerate(table["sig"].slice(row, stop - row).to_pylist()):
                seen[s] = hashes[bounds[i] : bounds[i + 1]]
        sets = [OrderedSet(s, v) for s, v in seen.items()]
        if probing:
            probe = table["probe"].to_numpy(zero_copy_only=False).astype(bool)
            sig = table["sig"].to_numpy()
            links = join_block(sets, percent, known, set(sig[probe].tolist()), set(sig[~probe].tolist()))
        else:
            links = join_block(sets, percent)
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], schema=_LINKS)

    return run


def _linked(docs: DataFrame, size: int, percent: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: key_id, key_h, row_id, n, sig; classes: sig, key, low; roots of the classes that link: node, root)."""
    rows = keyed(docs, id_col, text_col)
    own = stored(rows.mapInArrow(_features(size), "key_id long, key_h long, row_id long, n long, sig long, sample array<long>"), "sets")
    # The smallest id is that of the class's first row; null ids come last.
    first = F.min(F.struct(F.col("row_id").isNull().alias("unnamed"), "key_id", "key_h")).alias("at")
    classes = own.where("n > 0").groupBy("sig").agg(first, F.min("row_id").alias("low")).select("sig", F.struct("at.key_id", "at.key_h").alias("key"), "low")

    cluster = components(_candidates(rows.select("text"), own, size, percent))

    sizes = cluster.groupBy("root").agg(F.count("*").alias("members"))
    placed = cluster.join(sizes, "root").select(F.col("node").alias("sig"), F.col("root").alias("cluster"), F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.hash("sig"), F.col("blocks")))
    wanted = placed.join(classes.select("sig", "key.*"), "sig")
    texts = stored(rows.select("key_id", "key_h", "text").join(wanted, ["key_id", "key_h"]).select("sig", "cluster", "blocks", "block", "text").dropDuplicates(["sig"]), "texts")

    # The first class of a cluster goes to every block: a bridge between them.
    bridged = F.when((F.col("sig") == F.col("cluster")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    inside = texts.select("sig", "cluster", F.explode(bridged).alias("part"), "text", F.lit(0).cast("long").alias("root"))
    links = inside.groupBy("cluster", "part").applyInArrow(_block(size, percent, False), "a long, b long")

    spread = texts.where("blocks > 1")
    if spread.limit(1).count():
        links = stored(links, "links")
        roots = components(links)
        state = spread.join(roots, spread.sig == roots.node, "left").select("sig", "cluster", "blocks", "block", "text", F.coalesce("root", "sig").alias("root"))
        state = stored(state, "state")
        count = state.groupBy("cluster", "root").agg(F.count("*").alias("n"))
        main = count.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
        main = main.select("cluster", F.col("top.root").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("groups"))
        todo = state.join(main, "cluster")
        # Classes outside the largest component, in groups of bounded size, probe every block of their cluster.
        probes = todo.where("root <> main").select("sig", "cluster", F.pmod(F.xxhash64("sig"), F.col("groups")).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "text", "root", F.lit(True).alias("probe"))
        targets = todo.select("sig", "cluster", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("block").alias("part"), "text", "root", F.lit(False).alias("probe"))
        more = probes.unionAll(targets).groupBy("cluster", "group", "part").applyInArrow(_block(size, percent, True), "a long, b long")
        links = links.unionAll(more)
    roots = components(links)
    discard(texts)
    return own, classes, roots


def ngram_join(docs: DataFrame, size: int = 3, percent: int = 90, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document. Sets link when 100 * common >= percent * union."""
    own, classes, roots = _linked(docs, size, percent, block, id_col, text_col)
    named = classes.select("sig", "low").join(roots, F.col("sig") == F.col("node"), "left").select("sig", "low", F.coalesce("root", "sig").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    final = named.join(lowest, "root").select("sig", "component_id")
    empty = own.where("n = 0").select("row_id", "n", F.col("row_id").alias("component_id"))
    done = own.where("n > 0").join(final, "sig").select("row_id", "n", "component_id").unionAll(empty)
    return done.select(F.col("row_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, size: int = 3, percent: int = 90, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one of each component stays: that of the smallest id
    (then of the smallest hash of its text). Documents without words all stay."""
    own, classes, roots = _linked(docs, size, percent, block, id_col, text_col)
    named = classes.join(roots, F.col("sig") == F.col("node"), "left").select("key", F.col("low").isNull().alias("unnamed"), F.coalesce("root", "sig").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct("unnamed", "key")).alias("best")).select("best.key.*")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    both = docs.select(F.struct(*columns).alias("row"), F.struct(keyed_columns(id_col, text_col)).alias("own"))
    blank = ~F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # Of rows of one key only those of one text are copies.
    kept = both.where(~blank).select("row", "own.key_id", "own.key_h").join(first, ["key_id", "key_h"])
    kept = kept.withColumn("digest", F.md5(F.col(f"row.`{text_col}`").cast("string"))).dropDuplicates(["key_id", "key_h", "digest"])
    return kept.select("row").unionAll(both.where(blank).select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
