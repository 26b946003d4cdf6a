"""Near duplicates by bottom-k sketches.

One hash function h maps the shingles of a document to 64-bit values; the document's set is
kept as its values, its sketch is the k least of them.

1. Documents with the same set (size and 128-bit BLAKE2b digest of all its values in order) are one
   class with a key of its own; classes are what is linked, and ids are put to them last.  So rows of one id with
   different texts, and rows without an id, are each judged by their own text.
2. Inverted lists: every retained value points to the representatives that retain it.  Two sets
   with similarity s share a value of their union's bottom-k with probability s each, so their
   sketches have at least `least_overlap` values in common (k = 64, s = 0.8: 31, missed with a
   probability under 1e-8; a set of up to s*k values is its own sketch, and the bound is exact).
   With the values of each sketch in a common order, rarest first, two such sketches meet in
   the first k - least_overlap + 1 of each (prefix filtering, Chaudhuri et al. 2006): only these enter lists.
   A list is divided where its members' sizes leave a gap that no similar pair bridges.
3. Of each pair that meets, the union's sketch (k least of both) estimates the similarity;
   pairs under the bound of step 2 go.
4. The full sets of the rest are compared exactly.

A list of n members is not expanded into its n^2 pairs.  First every member meets the leaders
of its lists, one comparison each, and what is confirmed is joined into components: a group of copies costs its
members.  Then only members of different components can add anything.  Long lists that still have
several are put together by their leader, so that a group is one family however many lists it shares; members outside
the family's largest component meet all its members in blocks of bounded size that are row groups of their own.  A block
estimates its pairs first, on sketches of `WIDE` values: all values of the union up to the end of the shorter sketch
(between WIDE and twice as many) are a sketch of the union, of which the common ones are counted by a product of matrices.
Only members of a pair that this does not rule out have their full sets moved, into the same block, where they are compared
exactly, and only the links that join something leave it.  In short lists the pairs of
different components meet.  Both leave out no pair, and pairs within a component change nothing.

Null, empty and blank texts have an empty set and are linked with nothing.  A text with fewer
words than a shingle has its whole word sequence as one.  Every row is returned.  A null id sorts before all others: a component with
one has a null `component_id`.  Rows of one id and text are copies of one document, all kept or none;
`one_of_each` keeps one text of each component even where its least id (or none) stands at several.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import hinted, small_batches, staged
from .textscan import blocks, release, tidy, windows, words

K = 64
#: Rows of an id table that may be broadcast; beyond, the join is a shuffle.
BROADCAST_ROWS = 500_000
#: Leaders that a member meets, and lists that it must share with them.
LEADERS, LEAST_LISTS = 2, 3

#: Members times members outside the largest component from which a list is compared in blocks; members and values of a block.
LONG_LIST, BLOCK_MEMBERS, BLOCK_VALUES = 1_000, 256, 1 << 20
#: Values of the sketches that blocks estimate from, and the probability that a similar pair is missed at one length of the union's sketch.
WIDE, WIDE_LOSS = 512, 1e-11

_SIGNATURE = "struct<n_shingles: bigint, hi: bigint, lo: bigint, sketch: array<bigint>>"


def least_overlap(n: int, k: int, percent: int, loss: float = 1e-8) -> int:
    """Values that a sketch of n (at most k) values shares at least with that of any similar set."""
    if n * 100 <= percent * k:  # no similar set is larger than k: both are their own sketches
        return max(1, -(-percent * n // 100))
    s, tail, t = percent / 100, 0.0, 0
    while (tail := tail + math.comb(k, t) * s**t * (1 - s) ** (k - t)) < loss:
        t += 1
    return max(1, min(t, n))


def block_sets(block, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle values of each text of a block."""
    text, hashes = words(block, lower=True)
    n = len(block.offsets) - 1
    of, runs = windows(text, hashes, shingle)
    starts = np.searchsorted(of, np.arange(n + 1))
    begins = np.searchsorted(text, np.arange(n + 1))
    for i in range(n):
        if starts[i] < starts[i + 1]:
            yield np.unique(runs[starts[i] : starts[i + 1]])
            continue
        whole = hashes[begins[i] : begins[i + 1]]
        for size in range(len(whole), 0, -1):
            whole = windows(np.zeros(size, np.int64), whole, size)[1]
            break
        yield whole


def signatures(text: Column, shingle: int, k: int) -> Column:
    def signed(column: pa.Array) -> pa.Array:
        release()
        sizes, digests, least = [], [], []
        for block in blocks(column):
            for values in block_sets(block, shingle):
                sizes.append(len(values))
                digests.append(hashlib.blake2b(values, digest_size=16).digest())
                least.append(values[:k].copy())
        ends = np.cumsum([0, *map(len, least)])
        flat = np.concatenate(least) if least else np.zeros(0, np.uint64)
        sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((flat ^ np.uint64(1 << 63)).view(np.int64)))
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        longs = [pa.array(np.ascontiguousarray(halves[:, i])) for i in range(2)]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), *longs, sketch], names=["n_shingles", "hi", "lo", "sketch"])

    return F.arrow_udf(tidy(signed), _SIGNATURE)(text)


def full_sets(text: Column, shingle: int, least: int | None = None) -> Column:
    """The sorted values as bytes, or the least of them."""

    def packed(column: pa.Array) -> pa.Array:
        return pa.array([s[:least].tobytes() for block in blocks(column) for s in block_sets(block, shingle)], pa.binary())

    return F.arrow_udf(tidy(packed), "binary")(text)


def similar(left: Column, right: Column, percent: int) -> Column:
    """Whether two full sets are at least so similar, exactly."""

    def compared(a: pa.Array, b: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(a, b):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            found.append(bool(common) and 100 * common >= percent * (len(x) + len(y) - common))
        return pa.array(found, pa.bool_())

    return F.arrow_udf(tidy(compared), "boolean")(left, right)


def union_overlap(left: Column, right: Column, k: int) -> Column:
    """Of the k least values of two sketches' union (or all, if fewer): how many are in both, times k, by their number."""

    def estimated(a: pa.Array, b: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(a, b):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            least = np.union1d(x, y)[:k]
            both = np.intersect1d(x, y, assume_unique=True)
            common = int(np.searchsorted(both, least[-1], "right")) if len(least) else 0
            found.append(common * k // max(1, len(least)))
        return pa.array(found, pa.int32())

    return F.arrow_udf(tidy(estimated), "int")(left, right)


def _size_class(size: str, percent: int) -> tuple[Column, int]:
    """A class that ascends with the size, and by how many classes similar sets differ at most."""
    step = math.log(1.05)
    return F.floor(F.log(F.col(size).cast("double")) / step).cast("int"), int(math.log(100 / percent) / step) + 2


def _lists(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(list, id, size, weight) of the prefix of each sketch, for values that two sketches or more of like size retain.
    weight: how often the sketch's values are retained in all; what many others resemble weighs most of its group."""
    each = reps.select("id", F.col("n_shingles").alias("size"), F.size("sketch").alias("n"), F.explode("sketch").alias("value"))
    several = each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    met = each.join(several.hint("merge"), "value")
    own = Window.partitionBy("id")  # at most k rows
    placed = met.select("id", "value", "size", "n", F.count("*").over(own).alias("shared"), F.sum("df").over(own).alias("weight"), F.row_number().over(own.orderBy("df", "value")).alias("place"))
    bound = F.array(*[F.lit(n - least_overlap(n, k, percent) + 1 if n else 0) for n in range(k + 1)])
    alone = F.col("n") - F.col("shared")  # values that only this sketch has come first of all
    kept = placed.where(F.col("place") + alone <= F.element_at(bound, F.col("n") + 1))
    kind, apart = _size_class("size", percent)
    kept = staged(kept.select("id", "value", "size", "weight", kind.alias("kind")), "prefixes")
    kinds = kept.groupBy("value", "kind").agg(F.count("*").alias("c"))
    up = Window.partitionBy("value").orderBy("kind")  # a few hundred classes at most
    gap = F.coalesce(F.col("kind") - F.lag("kind").over(up) > apart, F.lit(True))
    runs = kinds.withColumn("run", F.sum(F.when(gap, F.col("kind"))).over(up))  # grows with every gap
    runs = runs.withColumn("members", F.sum("c").over(Window.partitionBy("value", "run"))).where("members > 1").select("value", "kind", "run")
    return kept.join(runs.hint("merge"), ["value", "kind"]).select(F.xxhash64("value", "run").alias("list"), "id", "size", "weight")


def _estimated(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose union's sketch does not rule them out, with the estimate."""
    of = reps.select("id", "sketch")
    left, right = of.toDF("a", "sketch_a").hint("merge"), of.toDF("b", "sketch_b").hint("merge")
    both = pairs.join(left, "a").join(right, "b").withColumn("estimate", union_overlap(F.col("sketch_a"), F.col("sketch_b"), k))
    return both.where(F.col("estimate") >= least_overlap(k, k, percent)).select("a", "b", "estimate")


def _sets(ids: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, least: int | None = None) -> DataFrame:
    """(id, values): the full sets of the given classes, or the least of their values, from the text that stands for each."""
    found = reps.join(ids.hint("merge"), "id", "left_semi").select("id", F.col("doc").alias("_doc"), F.col("hash").alias("_hash"))
    found = staged(found, "ids")
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash"))
    own = texts.join(hinted(found, found.count(), BROADCAST_ROWS), same)
    return staged(own.select("id", full_sets(F.col("body"), shingle, least).alias("values")), "sets").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; only classes in a pair have their sets moved."""
    pairs = staged(pairs, "pairs")
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), reps, texts, shingle)
    both = pairs.join(sets.toDF("a", "x").hint("merge"), "a").join(sets.toDF("b", "y").hint("merge"), "b")
    return staged(both.where(similar(F.col("x"), F.col("y"), percent)).select("a", "b"), "links")


def _sizes_fit(x: str, y: str, percent: int) -> Column:
    """Sets whose sizes differ more cannot be so similar."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of lists with the leaders that it meets in most lists.
    The leader of a list is the member with the largest weight: the text that the others were made from, where there is one.
    A member's choice is made among the leaders of its own lists, k at most; a leader's members are without limit."""
    leader = lists.groupBy("list").agg(F.max(F.struct("weight", "id", "size")).alias("first"))
    leader = leader.select("list", F.col("first.id").alias("lead"), F.col("first.size").alias("lead_size"))
    met = lists.join(leader.hint("merge"), "list").where((F.col("id") != F.col("lead")) & _sizes_fit("size", "lead_size", percent))
    pairs = met.groupBy(F.col("id").alias("member"), "lead").agg(F.count("*").alias("lists")).where(F.col("lists") >= LEAST_LISTS)
    place = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("lists"), "lead"))
    chosen = pairs.withColumn("place", place).where(F.col("place") <= LEADERS)
    return chosen.select(F.least("member", "lead").alias("a"), F.greatest("member", "lead").alias("b")).distinct()


def _mixed(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """lists that have members of several components, with each member's component, the list's largest one, its leader,
    and whether the list is long."""
    of = lists.join(comps.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    counted = of.groupBy("list", "component").agg(F.count("*").alias("c"), F.max(F.struct("weight", "id")).alias("first"))
    whole = counted.groupBy("list").agg(F.count("*").alias("kinds"), F.sum("c").alias("members"), F.max(F.struct("c", "component")).alias("main"), F.max("first").alias("first"))
    long = (F.col("members") - F.col("main.c")) * F.col("members") > LONG_LIST
    several = whole.where("kinds > 1").select("list", F.col("main.component").alias("main"), F.col("first.id").alias("lead"), long.alias("long"))
    return staged(of.join(several.hint("merge"), "list"), "lists")


def overlaps(first: list[np.ndarray], second: list[np.ndarray], step: int = 1 << 12) -> np.ndarray:
    """How many values each set of the first has in common with each of the second: the product of their incidence matrices,
    over the values that both sides have, `step` of them at a time."""
    common = np.intersect1d(np.unique(np.concatenate(first)), np.unique(np.concatenate(second)), assume_unique=True)
    out = np.zeros((len(first), len(second)), np.int64)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        held = common[at] == values if len(common) else np.zeros(len(values), bool)
        row, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[held], at[held]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    sides = [places(first), places(second)]
    for low in range(0, len(common), step):
        dense = []
        for (row, at), sets in zip(sides, (first, second)):
            part = slice(*np.searchsorted(at, [low, low + step]))
            matrix = np.zeros((len(sets), step), np.float32)
            matrix[row[part], at[part] - low] = 1
            dense.append(matrix)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


@functools.cache
def common_bounds(most: int, percent: int, loss: float = WIDE_LOSS) -> np.ndarray:
    """For each length n (0 to most) of a union's sketch: the values common to both sets that a similar pair has at least,
    but with probability `loss`; the lower end of a binomial distribution of n draws."""
    if percent >= 100:
        return np.arange(most + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])  # of factorials
    out = np.zeros(most + 1, np.int64)
    for n in range(1, most + 1):
        t = np.arange(n + 1)
        chance = np.exp(logs[n] - logs[t] - logs[n - t] + t * math.log(percent / 100) + (n - t) * math.log(1 - percent / 100))
        out[n] = max(1, np.searchsorted(np.cumsum(chance), loss))
    return out


def may_be_similar(first: list[np.ndarray], second: list[np.ndarray], percent: int, wide: int = WIDE) -> np.ndarray:
    """Which pairs of sketches (the `wide` least values of a set, or all) are not ruled out.

    Common values of two sketches lie up to the end of the one that ends first, and both sketches are whole up to there: so far they
    tell the union's values and the common ones.  Two whole sets are told exactly."""
    common = overlaps(first, second)
    none = np.uint64(2**64 - 1)
    ends = [np.array([x[-1] if len(x) == wide else none for x in side], np.uint64) for side in (first, second)]
    of_first = np.array([np.searchsorted(x, np.minimum(x[-1], ends[1]), "right") for x in first])
    of_second = np.array([np.searchsorted(y, np.minimum(y[-1], ends[0]), "right") for y in second]).T
    union = of_first + of_second - common
    bound = common_bounds(2 * wide, percent)
    whole = (ends[0] == none)[:, None] & (ends[1] == none)[None, :]
    return (common > 0) & np.where(whole, 100 * common >= percent * union, common >= bound[np.minimum(union, 2 * wide)])


def _possible_members(percent: int):
    """Of a block's sketches (rows as for `_joining_links`): the rows with a pair of different components that may be similar."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side, comps = table["side"].to_numpy(), table["component"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["values"]]
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        kept = np.zeros(len(sets), bool)
        if len(first) and len(second):
            near = may_be_similar([sets[i] for i in first], [sets[j] for j in second], percent)
            near &= comps[first][:, None] != comps[second][None, :]
            kept[first], kept[second] = near.any(axis=1), near.any(axis=0)
        return table.drop_columns(["values"]).filter(pa.array(kept))

    return run


def _joining_links(percent: int):
    """Of a block of sets (rows with side 0, id, component, values) and another (side 1): links between
    components, as few as join what can be joined."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids, comps = table["id"].to_pylist(), table["component"].to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["values"]]
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        if len(first) and len(second):
            common = overlaps([sets[i] for i in first], [sets[j] for j in second])
            sizes = np.array([len(x) for x in sets], np.int64)
            near = (common > 0) & (100 * common >= percent * (sizes[first][:, None] + sizes[second][None, :] - common))
            parent: dict = {}

            def root(c):
                while parent.setdefault(c, c) != c:
                    parent[c] = c = parent[parent[c]]
                return c

            for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                i, j = first[i], second[j]
                x, y = root(comps[i]), root(comps[j])
                if x != y:
                    parent[y] = x
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _family_blocks(mixed_lists: DataFrame) -> DataFrame:
    """(lead, i, j, side, id, component): of each family (the long lists of one leader) the members outside its largest component (side 0),
    and all its members (side 1), so that every one of the first meets every one of the second in one block."""
    members = staged(mixed_lists.where("long").select("lead", "id", "size", "component").distinct(), "families")
    by_component = members.groupBy("lead", "component").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    blocks_for = lambda c, s: F.ceil(F.greatest(c / BLOCK_MEMBERS, s / BLOCK_VALUES, F.lit(1))).cast("int")
    family = by_component.groupBy("lead").agg(F.max(F.struct("c", "component", "s")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    family = family.select("lead", F.col("main.component").alias("main"), blocks_for(F.col("c"), F.col("s")).alias("n_all"), blocks_for(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")).alias("n_other"))
    family = staged(family, "leads")
    placed = members.join(hinted(family, family.count(), BROADCAST_ROWS), "lead")
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = placed.where("component <> main").select("lead", "id", "component", F.lit(0).alias("side"), spread("n_other").alias("i"), each("n_all").alias("j"))
    whole = placed.select("lead", "id", "component", F.lit(1).alias("side"), each("n_other").alias("i"), spread("n_all").alias("j"))
    return staged(others.unionByName(whole).select("lead", "i", "j", "side", "id", "component"), "blocks")


def _possible(rows: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows of blocks that are in a pair which their sketches do not rule out."""
    sketches = _sets(rows.select("id").distinct(), reps, texts, shingle, WIDE)
    known = rows.join(sketches.hint("merge"), "id").select(*rows.columns, "values")
    return staged(known.groupBy("lead", "i", "j").applyInArrow(_possible_members(percent), rows.schema), "possible")


def _family_links(mixed_lists: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components that meet in a long list."""
    left = _possible(_family_blocks(mixed_lists), reps, texts, shingle, percent)
    sets = _sets(left.select("id").distinct(), reps, texts, shingle)
    rows = left.join(sets.hint("merge"), "id").select(*left.columns, "values")
    return staged(rows.groupBy("lead", "i", "j").applyInArrow(_joining_links(percent), "a bigint, b bigint"), "links")


def _residual(mixed_lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of members of short lists whose components differ.
    The largest component of a list is never paired with itself, so a group costs its members, not their square."""
    left = mixed_lists.where("component <> main").select("list", F.col("id").alias("x"), F.col("size").alias("sx"), F.col("component").alias("cx"), "main")
    right = mixed_lists.select("list", F.col("id").alias("y"), F.col("size").alias("sy"), F.col("component").alias("cy")).hint("merge")
    met = left.join(right, "list").where("cx <> cy and (cy = main or x < y)").where(_sizes_fit("sx", "sy", percent))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(texts: DataFrame, reps: DataFrame, shingle: int, percent: int, k: int) -> DataFrame:
    """(id, component) of every class (id, n_shingles, sketch, doc, hash) that is linked with another; doc and hash
    are those of the row of texts (doc, hash, body) that stands for it."""
    lists = staged(_lists(reps, k, percent), "lists")
    first = _estimated(_leader_pairs(lists, percent), reps, k, percent)
    done = _confirmed(first.select("a", "b"), reps, texts, shingle, percent)
    comps = staged(components(done), "components")
    mixed_lists = _mixed(lists, comps)
    short = mixed_lists.where("NOT long")
    if not mixed_lists.where("long").isEmpty():
        done = done.union(_family_links(mixed_lists, reps, texts, shingle, percent))
        comps = staged(components(done), "components")
        short = _mixed(short.select("list", "id", "size", "weight"), comps)
    new = _confirmed(_estimated(_residual(short, percent), reps, k, percent).select("a", "b"), reps, texts, shingle, percent)
    return comps if new.isEmpty() else staged(components(done.union(new)), "components")


def _judged(docs: DataFrame, id_column: str, text: str, shingle: int, percent: int, k: int) -> DataFrame:
    """(doc, hash, n_shingles, component, stays) of every row; hash is one of its text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("body"))
    signed = staged(texts.select("doc", "hash", signatures(F.col("body"), shingle, k).alias("s")).select("doc", "hash", "s.*"), "signatures")
    own = ["n_shingles", "hi", "lo"]
    first = F.struct(F.col("doc").isNotNull().alias("has"), "doc", "hash")  # rows without an id come first
    full = signed.where("n_shingles > 0")
    classes = full.groupBy(*own).agg(F.min(first).alias("first"), F.first("sketch").alias("sketch"))
    # written at once, so a class has one key for good
    reps = staged(classes.select(F.monotonically_increasing_id().alias("id"), *own, "sketch", F.col("first.doc").alias("doc"), F.col("first.hash").alias("hash")), "classes")
    comps = links(texts, reps, shingle, percent, k)
    linked = comps.join(reps.select("id", *own, "doc", "hash").hint("merge"), "id")
    least = linked.groupBy("component").agg(F.min(first).alias("first"))
    linked = linked.select(*own, "component").join(least.hint("merge"), "component")
    alone = reps.join(comps.select("id").hint("merge"), "id", "left_anti").select(*own, first.alias("first"))
    known = staged(linked.select(*own, "first").unionByName(alone), "known").withColumn("known", F.lit(True))
    found = signed.select("doc", "hash", *own).join(known.hint("merge"), own, "left")
    component = F.when(F.col("known"), F.col("first.doc")).otherwise(F.col("doc"))
    stays = F.col("known").isNull() | (component.eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("first.hash")))
    return found.select("doc", "hash", "n_shingles", component.alias("component"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """id, n_shingles, component_id (least id reachable) and kept of every document."""
    found = _judged(docs, id_column, text, shingle, percent, k)
    return found.select(F.col("doc").alias(id_column), "n_shingles", F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("doc")).alias("kept"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near duplicates of one text that stays in each component: that of its least id."""
    gone = _judged(docs, id_column, text, shingle, percent, K).where(~F.col("stays"))
    gone = staged(gone.select(F.col("doc").alias("_gone"), F.col("hash").alias("_text")).distinct(), "copies")
    same = docs[id_column].cast("bigint").eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[text]) == gone["_text"])
    return docs.join(hinted(gone, gone.count(), 1_000_000), same, "left_anti")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=2, percent=80)
