"""N-gram Jaccard join and its classes, as a blocked sparse product of the document by n-gram incidence.

A text's set holds its distinct word n-grams; with fewer words, the whole sequence is one n-gram; without words it is
empty and links with nothing.  Two texts link when ``den * |A & B| >= num * |A | B|`` for a threshold num / den.

Only the columns of the incidence that can decide are multiplied.  With n-grams ranked from rare to frequent, two
linked sets share k of the first ``|A| - ceil(t |A|) + k`` of each, so these alone are kept (the size-derived bound,
with k growing with the size), a text of which fewer are shared with anyone is done, and pairs whose sizes differ
beyond t are dropped unseen.  Ranks come from counts of all n-grams in a table of
fixed size; any table gives whole results, a fuller one fewer candidates.  Column blocks go to tasks by n-gram:

1. texts with equal sets form one class (so copies cost one row each);
2. the deciding columns are multiplied: where no class of a column has MOST larger ones within t of its size, all such
   pairs of the column count one, counts add up over columns, and pairs that share fewer than k are dropped before any
   set is looked up;
3. columns that are denser get leaders instead: cut by size so that classes within t of each other meet in a window, every
   class of a window of more than MOST meets the window's least class, its leader;
4. the product of two whole rows gives the overlap of pairs and of classes with their leaders, and linked ones form
   components.  Of a class's pairs one is compared at first, the others where they would join components.  What a class
   and its leader do not share is kept, if the leader has more than one class;
5. a leader's classes, where they still form several components, are multiplied in blocks of BLOCK rows: for two rows
   with the same leader, ``|A - B| + |B - A| = |a| + |b| - 2 |a & b|`` over their differences a and b from it, which
   are short.  Overlaps add up over column chunks, and pairs below the bound fall away inside the block.  Rows that
   are in the group's largest component already are multiplied with the others only.

Two linked classes share k columns.  If all of these are sparse, the pair counts k; else they share a leader and meet in
a block unless they are in one component before: every link between different components is found.  A block returns
what joins components, so no task emits all pairs of a group.  There is no cap on columns, groups or partners.  Where
links are to be counted, all pairs are compared and whole groups multiplied, main component and all, and a block
returns each row's number of partners.

Classes and n-grams go by 64-bit hashes.  Defined results: null texts are empty; a row with a null id gets the
component of the texts it links with, null if there is none; rows that repeat an id with other texts count as linked;
other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.iterate import components, cut
from loomgraph.llm.common import as_bytes, done_with, let_go, merged_table, pack_table, portions, release, saved, tokenized, words

#: Size of the table of n-gram counts, and of the bit table that preselects texts to be compared.
COUNT_BITS, FILTER_BITS, BLOCKS = 22, 24, 64
#: One more deciding n-gram has to be shared for each so many n-grams of a set.
GROW = 24
#: A column in which a class has so many larger ones within t of its size is dense.
MOST = 16
#: Rows of a column table that are worked on at once, or one column's.
ROWS = 1 << 17
#: Rows and columns of a block of the product.
BLOCK, CHUNK = 1024, 4096
#: Rows of one task's share of a class's comparisons.
SHARE = 512
MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


class Hasher:
    """Sets of 64-bit n-gram hashes."""

    def __init__(self, n: int):
        if not 1 <= n <= len(MUL):
            raise ValueError(f"n must be from 1 to {len(MUL)}")
        self.n = n

    def grams(self, raws: list[bytes]):
        """Each text's distinct n-gram hashes, ascending; words are hashed a few MB of texts at a time."""
        for first, last in portions(raws):
            release()
            types, ids, counts = tokenized(raws[first:last])
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, types), np.uint64, len(types))[ids]
            total = None
            for k in range(self.n):
                m = max(0, len(h) - self.n + 1)
                part = (h[k : k + m] ^ (h[k : k + m] >> np.uint64(29))) * MUL[k]
                total = part if total is None else (total ^ (total >> np.uint64(31))) * MUL[0] + part
            total ^= total >> np.uint64(32)
            ends = np.cumsum(counts).tolist()
            for raw, end, count in zip(raws[first:last], ends, counts.tolist(), strict=True):
                if count >= self.n:
                    own = np.sort(total[end - count : end - self.n + 1])
                    yield own[np.concatenate([[True], own[1:] != own[:-1]])]
                elif count:
                    yield np.array([xxhash.xxh3_64_intdigest(b" ".join(words(raw)), seed=1 + count)], np.uint64)
                else:
                    yield np.empty(0, np.uint64)


def _class(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _least_overlap(n: int, num: int, den: int) -> int:
    """Smallest |A & B| of a linked pair with |A| = n: |A | B| is at least n."""
    return -(-num * n // den)


def _shared(n: int) -> int:
    """How many deciding n-grams two linked sets share at least, the smaller of which has n."""
    return 1 + n // GROW


def count_table(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """For each slot of the fixed-size table, how many texts hold an n-gram of the slot, over all texts."""

    def run(batches):
        own, table = Hasher(n), np.zeros(1 << COUNT_BITS, np.uint32)
        for b in batches:
            for g in own.grams(b.column(0).to_pylist()):
                np.add.at(table, (g & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64), np.uint32(1))
        packed = pack_table(table, BLOCKS)
        if packed:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in packed], pa.int32()), pa.array([d for _, d in packed], pa.binary())], names=["block", "data"])

    return merged_table(docs.select(as_bytes(F.col(text_col)).alias("raw")).mapInArrow(run, "block int, data binary"), 1 << COUNT_BITS, BLOCKS)


def ranked(counts: np.ndarray) -> np.ndarray:
    """Ranks of the table's slots, made a block at a time; no more is needed than the order of magnitude of a count."""
    return np.concatenate([np.minimum(255, np.log2(c + np.float32(1)) * 8).astype(np.uint8) for c in counts.reshape(BLOCKS, -1)])


def incidence(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n (size of the set), cls (equal for equal sets; null for an empty one), head (the deciding n-grams)."""
    ranks = docs.sparkSession.sparkContext.broadcast(ranked(count_table(docs, n, text_col)))
    rows = docs.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("raw__"))
    schema = rows.select("id").schema.add("n", "long").add("cls", "long")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", head array<bigint>"

    def run(batches):
        own, rank = Hasher(n), ranks.value
        mask = np.uint64((1 << COUNT_BITS) - 1)
        for b in batches:
            sizes, sigs, heads = [], [], []
            for g in own.grams(b.column(1).to_pylist()):
                sizes.append(len(g))
                sigs.append(_class(g) if len(g) else None)
                order = np.lexsort((g, rank[(g & mask).astype(np.int64)]))
                heads.append(g[order[: len(g) - _least_overlap(len(g), num, den) + _shared(len(g))]].view(np.int64) if len(g) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads) if heads else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), lists], names=["id", "n", "cls", "head"])

    return rows.mapInArrow(run, types)


def _sets(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, grams) for ``wanted`` (rep, cls); a bit table of fixed size over rep spares the other texts' sets."""

    def bits(batches):
        table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            np.bitwise_or.at(table, (h >> np.uint64(3)).astype(np.int64), (1 << (h & np.uint64(7))).astype(np.uint8))
        packed = pack_table(table, BLOCKS)
        if packed:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in packed], pa.int32()), pa.array([d for _, d in packed], pa.binary())], names=["block", "data"])

    table = merged_table(wanted.select(F.xxhash64("rep").alias("h")).mapInArrow(bits, "block int, data binary"), 1 << (FILTER_BITS - 3), BLOCKS, "uint8", "or")
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.xxhash64(F.col(id_col)).alias("h"), as_bytes(F.col(text_col)).alias("raw"))

    def run(batches):
        own, bit = Hasher(n), shared.value
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            hit = np.flatnonzero(bit[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1)
            sets = [g for g in own.grams(b.column(1).take(pa.array(hit)).to_pylist()) if len(g)]
            yield pa.RecordBatch.from_arrays([pa.array([_class(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], names=["cls", "grams"])

    return rows.mapInArrow(run, "cls bigint, grams binary").join(wanted.select("cls"), "cls").dropDuplicates(["cls"])


def whole_columns(batches):
    """(gram, n, cls) arrays that hold whole columns; batches: these, sorted by gram."""
    held, size, limit = [], 0, ROWS
    for b in batches:
        held.append(tuple(b.column(c).to_numpy() for c in range(3)))
        size += len(held[-1][0])
        if size < limit:
            continue
        own = tuple(map(np.concatenate, zip(*held, strict=True)))
        last = int(np.searchsorted(own[0], own[0][-1]))
        if last:
            yield tuple(c[:last] for c in own)
        held, size = [tuple(c[last:] for c in own)], size - last
        limit = max(ROWS, 2 * size)
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def by_column(columns: DataFrame, f, schema: str) -> DataFrame:
    """f over arrays (gram, n, cls) of whole columns, sorted by gram and n."""
    parts = int(columns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for own in whole_columns(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in f(*own)], names=names)

    return columns.select("gram", "n", "cls").repartition(parts, "gram").sortWithinPartitions("gram", "n").mapInArrow(run, schema)


def met(gram: np.ndarray, n: np.ndarray, cls: np.ndarray, num: int, den: int) -> tuple:
    """The rows of columns that hold another class within t of their size."""
    near = (gram[1:] == gram[:-1]) & (den * n[:-1] >= num * n[1:])
    keep = np.concatenate([near, [False]]) | np.concatenate([[False], near])
    return gram[keep], n[keep], cls[keep]


def products(gram: np.ndarray, n: np.ndarray, cls: np.ndarray, num: int, den: int) -> tuple:
    """(x, y, need, lead): pairs within t of each other's size and how many columns they have to share; or leaders x."""
    column = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
    dense = np.zeros(int(column[-1]) + 1, bool)
    live, low, high = np.arange(len(gram)), [], []
    for d in range(1, MOST + 1):
        live = live[: np.searchsorted(live, len(gram) - d)]
        live = live[(gram[live + d] == gram[live]) & (den * n[live] >= num * n[live + d])]
        low.append(live)
        high.append(live + d)
    dense[column[live]] = True
    low, high = np.concatenate(low), np.concatenate(high)
    sparse = ~dense[column[low]]
    low, high = [low[sparse]], [high[sparse]]
    leaders, led = [], []
    for at, end in zip(np.searchsorted(column, np.flatnonzero(dense)).tolist(), np.searchsorted(column, np.flatnonzero(dense), "right").tolist(), strict=True):
        # Classes of a part are never within t of those of the next but one.
        cuts = [at]
        while (after := at + int(np.searchsorted(n[at:end], den * n[cuts[-1]] // num, "right"))) < end:
            cuts.append(after)
        cuts += [end, end]
        for first, second, last in zip(cuts, cuts[1:], cuts[2:]):
            if last - first > MOST:
                x = first + int(np.argmin(cls[first:last]))
                others = np.concatenate([np.arange(first, x), np.arange(x + 1, last)])
                leaders.append(np.full(len(others), x))
                led.append(others)
            else:
                i, j = np.triu_indices(last - first, 1)
                i, j = i + first, j + first
                pairs = (i < second) & (den * n[i] >= num * n[j])
                low.append(i[pairs])
                high.append(j[pairs])
    low, high = np.concatenate(low), np.concatenate(high)
    x = np.concatenate([np.minimum(cls[low], cls[high]), cls[np.concatenate(leaders)] if leaders else cls[:0]])
    y = np.concatenate([np.maximum(cls[low], cls[high]), cls[np.concatenate(led)] if led else cls[:0]])
    need = np.concatenate([1 + n[low] // GROW, np.zeros(len(x) - len(low), np.int64)])
    return x, y, need, np.arange(len(x)) >= len(low)


def candidates(columns: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, lead) with x < y: pairs that share enough sparse columns, and classes y with their leaders x."""
    made = by_column(columns, lambda *own: products(*own, num, den), "x bigint, y bigint, need bigint, lead boolean")
    counted = made.groupBy("x", "y").agg(F.sum(F.when(~F.col("lead"), 1).otherwise(0)).alias("k"), F.max("need").alias("need"), F.max("lead").alias("lead"))
    return counted.where("lead or k >= need").select("x", "y", "lead")


def stars(pairs: DataFrame, sets: DataFrame, num: int, den: int, lone: bool = False) -> DataFrame:
    """For each pair (x, y, lead): n of y, whether the whole sets are linked, and whether y is one of a leader's several.

    For these (with lone, for all that have a leader) their symmetric difference is added.  Each x's set meets its y's
    a share at a time, in a task that holds one set of x.
    """
    shares = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"), F.sum(F.col("lead").cast("int")).alias("led"))
    wide = F.col("lead") & (F.lit(lone) | (F.col("led") > 1))
    dealt = pairs.join(shares, "x").select("x", F.pmod(F.xxhash64("y"), F.col("shares")).cast("int").alias("salt"), "y", wide.alias("wide"))
    firsts = dealt.select("x", "salt").distinct().select("x", "salt", F.lit(0).alias("kind"), F.col("x").alias("cls"), F.lit(False).alias("wide"))
    seconds = dealt.select("x", "salt", F.lit(1).alias("kind"), F.col("y").alias("cls"), "wide")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A set goes to its place once for both roles.
    rows = firsts.union(seconds).join(sets, "cls").select("x", "salt", "kind", "cls", "wide", "grams").repartition(parts, "x", "salt").sortWithinPartitions("x", "salt", "kind")

    def run(batches):
        at, first = None, None
        for b in batches:
            out = []
            for x, is_y, y, wide, grams in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                if not is_y:
                    at, first = x, np.frombuffer(grams.as_py(), np.uint64)
                elif x == at:
                    other = np.frombuffer(grams.as_py(), np.uint64)
                    apart = np.setxor1d(first, other, assume_unique=True)
                    both = (len(first) + len(other) - len(apart)) // 2
                    out.append((x, y, len(other), den * both >= num * (both + len(apart)), wide, apart.tobytes() if wide else b""))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()), strict=True)], names=["x", "y", "n", "linked", "wide", "apart"])

    return rows.mapInArrow(run, "x bigint, y bigint, n bigint, linked boolean, wide boolean, apart binary")


def overlaps(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Length of each list of distinct 64-bit values, and how many each two lists share."""
    d = np.array([len(a) // 8 for a in lists], np.float64)
    grams = np.frombuffer(b"".join(lists), np.uint64)
    owner = np.repeat(np.arange(len(lists)), d.astype(np.int64))
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
    runs = np.diff(np.concatenate([first, [len(grams)]]))
    column = np.repeat(np.cumsum(runs > 1) - 1, runs)
    held = np.repeat(runs > 1, runs)
    column, owner = column[held], owner[held]
    shared = np.zeros((len(lists), len(lists)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, CHUNK):
        here = (column >= at) & (column < at + CHUNK)
        part = np.zeros((len(lists), min(CHUNK, int(column.max()) + 1 - at)), np.float32)
        part[owner[here], column[here] - at] = 1
        shared += part @ part.T
    return d, shared


def linked_pairs(sizes: list[int], aparts: list[bytes], num: int, den: int) -> np.ndarray:
    """Whether each two rows are linked, above the diagonal; aparts: differences from one leader."""
    n = np.array(sizes, np.float64)
    d, shared = overlaps(aparts)
    apart = d[:, None] + d[None, :] - 2 * shared
    both = (n[:, None] + n[None, :] - apart) / 2
    return np.triu(den * both >= num * (both + apart), 1)


def block_links(ids: list[int], comps: list[int], sizes: list[int], aparts: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Links between rows of different components that join them, one per join; aparts: differences from one leader."""
    x, y = np.nonzero(linked_pairs(sizes, aparts, num, den))
    parent = {c: c for c in comps}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = root(comps[i]), root(comps[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def late_links(stars_: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y) links that join components within leaders' groups, by the blocked product."""
    # The leader itself has met all of its group.  What is wide, the differences, moves with the last two steps only.
    member = stars_.select("x", "y").join(comp.withColumnRenamed("id", "y"), "y", "left").withColumn("component", F.coalesce("component", "y"))
    member = cut(member.select("x", "y", "component"))
    sizes = member.groupBy("x", "component").count()
    several = sizes.groupBy("x").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("all"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    several = several.select("x", "main", blocks(F.col("most")).alias("mains"), blocks(F.col("all") - F.col("most")).alias("others"))
    rows = member.join(several, "x").withColumn("is_main", F.col("component") == F.col("main"))
    # Blocks 0 .. others-1 hold what is outside the main component, the following ones the main component.
    own = F.when(F.col("is_main"), F.col("others") + F.pmod(F.xxhash64("y"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("y"), F.col("others"))).cast("int")
    mates = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    rows = rows.withColumn("own", own).withColumn("mates", mates).select("x", "y", "component", "own", "mates").join(stars_.select("x", "y", "n", "apart"), ["x", "y"]).withColumn("mate", F.explode("mates")).select("x", F.least("own", "mate").alias("i"), F.greatest("own", "mate").alias("j"), "y", "component", "n", "apart")
    parts = int(stars_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "x", "i", "j").sortWithinPartitions("x", "i", "j")

    def run(batches):
        key, held = None, []

        def done():
            found = block_links(*map(list, zip(*held, strict=True)), num, den) if held else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["x", "y"])

        for b in batches:
            for x, i, j, y, component, n, apart in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                if (x, i, j) != key:
                    if held:
                        yield done()
                    key = (x, i, j)
                held.append((y, component, n, apart))
        if held:
            yield done()

    return rows.mapInArrow(run, "x bigint, y bigint")


def between(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Edges (src, dst) as distinct edges between the components that their ends are in; what is in none is its own."""
    for end in ("src", "dst"):
        own = comp.select(F.col("id").alias(end), "component")
        edges = edges.join(own, end, "left").withColumn(end, F.coalesce("component", end)).select("src", "dst")
    return edges.where("src <> dst").distinct()


def link_counts(found: DataFrame, sized: DataFrame, copies: DataFrame, num: int, den: int) -> DataFrame:
    """(y, n_links): rows of other classes that each class links with, by the blocked product of all of a leader's group.

    Where two linked classes share several leaders, the least one's group counts the link; where they share none, it is
    among the pairs compared.
    """
    stars_ = found.where("wide")
    leaders = stars_.select("x").distinct().join(sized, F.col("x") == F.col("cls")).select("x", F.col("x").alias("y"), "n", F.lit(b"").alias("apart"))
    group = stars_.select("x", "y", "n", "apart").union(leaders)
    members = stars_.select("x", "y").union(stars_.select("x", F.col("x").alias("y")).distinct())
    # No more leaders a class than it has deciding n-grams.
    led = members.groupBy("y").agg(F.collect_list("x").alias("of"))
    of = led.join(copies, F.col("y") == F.col("cls")).select("y", "of", "copies")
    linked = found.where("linked and not wide").select("x", "y").join(led.select(F.col("y").alias("x"), F.col("of").alias("of_x")), "x", "left").join(led, "y", "left")
    linked = linked.where(~F.coalesce(F.arrays_overlap("of_x", "of"), F.lit(False))).select("x", "y")
    apart = linked.union(linked.select("y", "x")).toDF("y", "cls").join(copies, "cls").select("y", F.col("copies").alias("n_links"))
    blocks = members.groupBy("x").count().select("x", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(blocks, "x").join(of, "y").select("x", "y", "blocks", "copies", F.filter("of", lambda o: o < F.col("x")).alias("before"))
    rows = rows.join(group, ["x", "y"]).withColumn("own", F.pmod(F.xxhash64("y"), F.col("blocks")).cast("int")).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("x", F.least("own", "mate").alias("i"), F.greatest("own", "mate").alias("j"), "own", "y", "copies", "n", "apart", "before")
    parts = int(stars_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "x", "i", "j").sortWithinPartitions("x", "i", "j")

    def run(batches):
        key, held, ys, ns = None, [], [], []

        def done():
            own, y, copies_, sizes, aparts, before = zip(*held, strict=True)
            held.clear()
            if len(y) < 2:
                return
            pairs = linked_pairs(list(sizes), list(aparts), num, den)
            if key[1] != key[2]:  # each block with itself is a block of its own
                pairs &= np.array(own)[:, None] != np.array(own)[None, :]
            if pairs.any() and any(before):
                pairs &= overlaps([np.array(o, np.int64).tobytes() for o in before])[1] == 0
            weight = np.array(copies_, np.float64)
            total = (pairs @ weight + weight @ pairs).astype(np.int64)
            ys.extend(np.array(y, np.int64)[total > 0].tolist())
            ns.extend(total[total > 0].tolist())

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(ys, pa.int64()), pa.array(ns, pa.int64())], names=["y", "n_links"])
            ys.clear()
            ns.clear()
            return out

        for b in batches:
            for x, i, j, *row in zip(*(b.column(c).to_pylist() for c in range(9)), strict=True):
                if (x, i, j) != key:
                    if held:
                        done()
                    key = (x, i, j)
                held.append(row)
            yield batch()
        if held:
            done()
        yield batch()

    return rows.mapInArrow(run, "y bigint, n_links bigint").union(apart).groupBy("y").agg(F.sum("n_links").alias("n_links"))


def classes(docs: DataFrame, *, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) for every row: component_id is the least id reachable by links.

    With links, also n_links: how many other rows the row's text links with, copies of it included.
    """
    whole = saved(incidence(docs, n, num, den, id_col, text_col))
    base = cut(whole.drop("head"))
    held = base.where("cls is not null")
    reps = held.groupBy("cls").agg(F.min("id").alias("rep"))
    sized = held.groupBy("cls").agg(F.max("n").alias("n"))
    heads = whole.where("cls is not null").select("cls", "n", "head").dropDuplicates(["cls"])
    some = saved(by_column(heads.select("cls", "n", F.explode("head").alias("gram")), lambda *own: met(*own, num, den), "gram bigint, n bigint, cls bigint"))
    done_with(whole)
    # A linked text's partner has at least ceil(t n) n-grams, and shares as many deciding ones as that size asks for.
    least_partner = F.floor((F.col("n") * num + (den - 1)) / den)
    enough = some.groupBy("cls").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).where(F.col("k") >= 1 + F.floor(least_partner / GROW))
    pairs = saved(candidates(some.join(enough.select("cls"), "cls"), num, den))
    done_with(some)
    # Only texts that share enough deciding n-grams are ever compared.
    wanted = pairs.select(F.col("x").alias("cls")).union(pairs.select(F.col("y").alias("cls"))).distinct()
    sets = saved(_sets(docs, wanted.join(reps, "cls"), n, id_col, text_col))
    # One pair of each class, unless all links are asked for: in a group of near copies the others follow from it.
    least = pairs.where("not lead").groupBy("y").agg(F.min("x").alias("least"))
    first = pairs if links else pairs.join(least, "y", "left").where("lead or x = least").select("x", "y", "lead")
    let_go(docs.sparkSession)
    found = cut(stars(first, sets, num, den, links))
    let_go(docs.sparkSession)
    edges = lambda df: df.select(F.col("x").alias("src"), F.col("y").alias("dst"))
    first = edges(found.where("linked"))
    comp = components(first)
    let_go(docs.sparkSession)
    late = edges(late_links(found.where("wide"), comp, num, den))
    if not links:
        of = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
        rest = pairs.where("not lead").join(least, "y").where("x <> least").join(of("x"), "x", "left").join(of("y"), "y", "left")
        rest = rest.where(F.coalesce("x_in", "x") != F.coalesce("y_in", "y")).select("x", "y", "lead")
        late = late.union(edges(cut(stars(rest, sets, num, den)).where("linked")))
    done_with(pairs, sets)
    # Rows that repeat an id with another text.
    twice = held.where("id is not null").groupBy("id").agg(F.min("cls").alias("src"), F.max("cls").alias("most")).where("src <> most")
    same = held.join(twice.select("id", "src"), "id").select("src", F.col("cls").alias("dst")).where("src <> dst")
    # Components are known but for these few edges, which join whole ones: only they go through more rounds.
    joined = components(between(late.union(same), comp)).select(F.col("id").alias("component"), F.col("component").alias("joined"))
    whole = reps.join(comp.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    whole = whole.join(joined, "component", "left").select("cls", "rep", F.coalesce("joined", "component").alias("component"))
    named = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = whole.join(named, "component").select("cls", "component_id")
    out = base.select("id", F.col("n").alias("n_shingles"), "cls").join(by_class, "cls", "left")
    plain = ["id", "n_shingles", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")]
    if not links:
        return out.select(*plain)
    copies = held.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    others = link_counts(found, sized, copies, num, den).withColumnRenamed("y", "cls")
    n_links = copies.join(others, "cls", "left").select("cls", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return out.join(n_links, "cls", "left").select(*plain, F.coalesce("n_links", F.lit(0)).alias("n_links"))
