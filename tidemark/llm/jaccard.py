"""N-gram Jaccard join by signature trees.

Texts are sets of 5-word shingles; two link when 100 * intersection >= 75 * union. The join is
done in the steps below, each of them a Spark job over keyed rows. Every link comes out of a
signature tree: its nodes hold the OR of token bitmaps, a range of set sizes, and the component
and home of all their sets if there is only one; a dual traversal from the root prunes node pairs
whose sizes are too far apart, whose largest possible overlap is too small, or that are settled.

1. Profile: one pass over the texts gives each set's size, a 128-bit fingerprint and its KEYS
   smallest shingle hashes. Equal sets are one class, compared once however many copies it has.
2. Keys: linked classes have SHARED keys in common at least (all but 5 pairs in 10**12;
   `exact` takes all hashes as keys and misses none). In one order of all keys, by the number of classes that have
   them, two lists with SHARED common elements already meet in all but their last SHARED - 1. So
   the most frequent keys of a class, those of passages that many texts quote, are left out.
3. Homes: each class goes with its text to the most frequent of these keys, in parts of BLOCK
   classes. A part is one signature tree, searched whole; what survives is compared exactly, in
   the order of likeness, and classes already joined are not compared again.
4. Picks: keys that still hold several components from several homes have trees of their own, in
   parts of BLOCK again. Of each tree, each component keeps its few likeliest pairs. They join
   the parts of a large group of near copies, each of which a home has made one component. All
   of the group have most of its keys, so large keys that hold nearly the same classes are one
   key here and in 5: a class is sent to a group's trees once, not once for each shared key.
5. Rest: keys that still hold several components are searched completely. Classes of a key with
   more than BLOCK of them, as under a passage that very many texts quote, get finer keys in its
   place: of all their shingles, those that several components have, and a pair of size cells.
   The sizes of two cells tell how many shingles linked sets have in common, and all but one of
   as many, the most frequent, are left out. So a passage makes a candidate only where it is
   nearly all that a link takes, however many texts quote it. A finer key that is still large is
   cut into nodes by set size, and nodes that hold the key's largest component alone; pairs of
   nodes are pruned by a join and searched in tasks of their own.

Comparisons of 4 and 5 take place at the home of one of the two: its texts move there once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .components import components, merged
from .words import map_texts, mixed, pieces, shingles, small_batches, split

SHINGLE = 5
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Keys of a set. In the union of two linked sets in hash order each element is shared with a
#: probability of 3/4 at least; fewer than 14 of the first 48 are with 5 in 10**12.
KEYS, SHARED = 48, 14
#: Classes of a tree, and shingles of its sets together (32 MB); a larger set is alone.
BLOCK, MOST = 512, 1 << 22
#: Pairs that a component keeps in step 4, and a class of all its keys.
PICKS = 3
#: A large key becomes part of another where this percentage of its classes is at least.
WITHIN = 75
#: Rows of roles that are broadcast at most, about 20 MB; beyond that the join is shuffled.
SMALL = 500_000
LEAF, FAN = 16, 8
#: Size cells of step 5: each is 16/15 as large as the one before; linked sets are at most 5 apart.
CELL, APART = 16 / 15, 5


def _sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    doc, h = shingles(split(data, offsets), SHINGLE)
    ends = np.searchsorted(doc, np.arange(len(offsets)))
    return [np.unique(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _print(s: np.ndarray) -> bytes:
    """The 128-bit fingerprint of a set."""
    return np.array([mixed(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(s + np.uint64(1)), initial=np.uint64(0))]).tobytes()


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _profile(keys: int | None) -> Callable[[np.ndarray, np.ndarray], dict]:
    def make(data: np.ndarray, offsets: np.ndarray) -> dict:
        sets = _sets(data, offsets)
        return {
            "n_shingles": np.array([len(s) for s in sets], np.int64),
            "print": pa.array([_print(s) for s in sets], pa.binary()),
            "keys": pa.array([s[:keys].view(np.int64) for s in sets], pa.list_(pa.int64())),
        }

    return make


def bitmap(s: np.ndarray) -> bytes:
    """The token bitmap of a set: 3 to 6 bits for each token, 64 bits at least, a power of two."""
    bits = np.zeros(max(64, 1 << int(3 * len(s) - 1).bit_length()), bool)
    bits[s & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits).tobytes()


class SignatureTree:
    """Sets as (size, bitmap of one width, component, home), packed by size into nodes of OR bitmaps and ranges."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, component: np.ndarray, home: np.ndarray) -> None:
        self.order = order = np.lexsort((component, size))
        spare = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        levels = [(bits[order], size[order], size[order], spare[order], component[order], home[order])]
        while len(levels) == 1 or len(levels[-1][1]) > 1:
            bits, low, high, free, *alike = levels[-1]
            at = np.arange(0, len(low), LEAF if len(levels) == 1 else FAN)
            # A component or home that all sets of a node have, or -1.
            alike = [np.where((m := np.minimum.reduceat(x, at)) == np.maximum.reduceat(x, at), m, -1) for x in alike]
            levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(free, at), *alike))
        self.levels = levels

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node pairs that may hold a linked pair not yet settled, and their largest possible overlap."""
        bits, low, high, free, *alike = self.levels[level]
        # Sizes: the smaller is PERCENT of the larger at least.
        fits = (100 * high[a] >= PERCENT * low[b]) & (100 * high[b] >= PERCENT * low[a])
        for x in alike:
            fits &= (x[a] < 0) | (x[a] != x[b])
        keep, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        some = np.flatnonzero(fits)
        step = max(1, (1 << 20) // bits.shape[1])
        for at in range(0, len(some), step):
            part = some[at : at + step]
            x, y = a[part], b[part]
            # Shared tokens fall on shared bits; a set has at most its spare tokens beyond one a bit.
            shared = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(free[x], free[y])
            good = (100 + PERCENT) * shared >= PERCENT * (low[x] + low[y])
            keep.append(part[good])
            most.append(shared[good])
        return np.concatenate(keep), np.concatenate(most)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of the pairs that no bound rules out, by dual traversal from the root, and their likeness at most."""
        a = b = np.zeros(1, np.int64)
        most = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            step, n = (LEAF if level == 1 else FAN), len(self.levels[level - 1][1])
            child = np.arange(step)
            x = np.repeat(a * step, step * step) + np.tile(np.repeat(child, step), len(a))
            y = np.repeat(b * step, step * step) + np.tile(np.tile(child, step), len(b))
            real = (x < n) & (y < n) & ((x <= y) if level > 1 else (x < y))
            x, y = x[real], y[real]
            keep, most = self._possible(level - 1, x, y)
            a, b = x[keep], y[keep]
        size = self.levels[0][1]
        return self.order[a], self.order[b], most / np.maximum(size[a] + size[b], 1)


def survivors(size: np.ndarray, bitmaps: list[bytes], component: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, likeness) of the pairs of sets that their signature trees leave: one tree for each width of bitmap.

    Linked sets have bitmaps of one width, or one has twice that of the other and is folded.
    """
    width = np.array([len(b) for b in bitmaps])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        wide = np.flatnonzero((width == 2 * w) & (PERCENT * size <= 100 * size[own].max()))
        at = np.concatenate([own, wide])
        bits = np.frombuffer(b"".join(bitmaps[k] for k in own), np.uint64).reshape(len(own), -1)
        if len(wide):
            both = np.frombuffer(b"".join(bitmaps[k] for k in wide), np.uint64).reshape(len(wide), 2, -1)
            bits = np.concatenate([bits, both[:, 0] | both[:, 1]])
        i, j, like = SignatureTree(size[at], bits, component[at], home[at]).pairs()
        keep = (i < len(own)) | (j < len(own))
        found.append((at[i[keep]], at[j[keep]], like[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def earlier(keys: list[np.ndarray], key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of rows have a key in common that is less than key, where they are found as well."""
    size = np.array([len(k) for k in keys])
    values, row = np.concatenate(keys), np.repeat(np.arange(len(keys)), size)
    less = values < key[row]
    _, back, times = np.unique(values[less], return_inverse=True, return_counts=True)
    several = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[several] = np.arange(len(several))
    has = np.zeros((len(keys), -(-(len(several) + 1) // 64) * 64), bool)
    at = place[back]
    has[row[less][at >= 0], at[at >= 0]] = True
    bits = np.packbits(has, axis=1).view(np.uint64)
    step = max(1, (1 << 20) // bits.shape[1])
    return np.concatenate([np.zeros(0, bool), *[(bits[i[k : k + step]] & bits[j[k : k + step]]).any(axis=1) for k in range(0, len(i), step)]])


class _Joined:
    """Disjoint sets of any labels."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[max(x, y)] = min(x, y)


def settled(sets: list[np.ndarray], bitmaps: list[bytes]) -> np.ndarray:
    """The component, an index, of each set of a home: its tree's survivors compared exactly, the likeliest first."""
    n = len(sets)
    component = np.arange(n)
    if n < 2:
        return component
    i, j, like = survivors(np.array([len(s) for s in sets]), bitmaps, component, np.full(n, -1))
    order = np.lexsort((j, i, -like))
    i, j, joined = i[order], j[order], _Joined()
    while len(i):
        for x, y in zip(i[:2048].tolist(), j[:2048].tolist(), strict=True):
            p, q = joined.find(x), joined.find(y)
            if p != q and linked(sets[x], sets[y]):
                joined.join(p, q)
        component = np.array([joined.find(x) for x in range(n)])
        apart = component[i] != component[j]
        apart[:2048] = False
        i, j = i[apart], j[apart]
    return component


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(is it a new group?, a part of its rows) of rows sorted by keys; a group is never held here."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        at = [batch.column(k).to_numpy() for k in keys]
        turn = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
        for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(batch)], strict=True):
            key = tuple(x[a] for x in at)
            yield key != last, batch.slice(a, b - a)
            last = key


def _at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts sorted by home -> each class with the component its home's tree gives it, and its bitmap."""
    held: dict[int, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        classes, sets = list(held), list(held.values())
        bits = [bitmap(s) for s in sets]
        least = settled(sets, bits)
        of = np.array(classes, np.int64)[least]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(of), pa.array(bits, pa.binary())], names=["node", "component", "bitmap"])

    for new, part in _groups(batches, ["home", "salt"]):
        if new and held:
            yield flush()
        classes, prints = part.column("node").to_pylist(), part.column("print").to_pylist()
        for x, _, data, offsets in pieces(part.column("body"), lower=True):
            for k, s in enumerate(_sets(data, offsets), x):
                if _print(s) == prints[k]:  # not another text of the same id
                    held[classes[k]] = s
    if held:
        yield flush()


def _search(every: bool):
    """Rows sorted by task -> candidate pairs (a, b) of each task's tree; of b its home, where they will be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            node, comp, home, salt, size, side = (rows[c].to_numpy() for c in ("node", "component", "home", "salt", "n_shingles", "side"))
            _, place = np.unique(np.stack([home, salt]), axis=1, return_inverse=True)
            i, j, like = survivors(size, rows["bitmap"].to_pylist(), comp, place.reshape(-1))
            # Both sides in one tree: pairs of one side belong to another task.
            keep = ((side[i] != side[j]) | (side[i] == 0)) & (comp[i] != comp[j]) & (place[i] != place[j])
            i, j, like = i[keep], j[keep], like[keep]
            if every:
                # A pair is found under every key that it shares, and told under the least of them.
                once = ~earlier([np.array(k) for k in rows["keys"].to_pylist()], rows["key"].to_numpy(), i, j)
                i, j, like = i[once], j[once], like[once]
            else:
                order = np.lexsort((node[j], node[i], -like))
                i, j, like, left = i[order], j[order], like[order], {}
                kept = []
                for k, (x, y) in enumerate(zip(comp[i].tolist(), comp[j].tolist(), strict=True)):
                    if left.get(x, PICKS) or left.get(y, PICKS):
                        left[x], left[y] = max(0, left.get(x, PICKS) - 1), max(0, left.get(y, PICKS) - 1)
                        kept.append(k)
                i, j, like = i[kept], j[kept], like[kept]
            # A class with many partners goes to their homes, not they to its.
            degree = np.bincount(np.concatenate([i, j]), minlength=len(node))
            swap = (degree[i] < degree[j]) | ((degree[i] == degree[j]) & (node[i] < node[j]))
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            columns = [node[a], comp[a], node[b], comp[b], home[b], salt[b], like]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "a_in", "b", "b_in", "home", "salt", "likeness"])

        for new, part in _groups(batches, ["task"]):
            if new and held:
                yield flush()
            held.append(part)
        if held:
            yield flush()

    return run


_PAIRS = "a long, a_in long, b long, b_in long, home long, salt int, likeness double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts sorted by home, those that live there first -> linked pairs (a, b) of components."""
    own: dict[int, np.ndarray] = {}
    joined = _Joined()
    for new, part in _groups(batches, ["home", "salt"]):
        if new:
            own, joined = {}, _Joined()
        role, node, comp = (part.column(c).to_numpy() for c in ("role", "node", "component"))
        prints, partners = part.column("print").to_pylist(), part.column("partners").to_pylist()
        out = []
        for x, _, data, offsets in pieces(part.column("body"), lower=True):
            for k, s in enumerate(_sets(data, offsets), x):
                if _print(s) != prints[k]:
                    continue
                if role[k] == 0:
                    own[int(node[k])] = s
                    continue
                for p in partners[k]:
                    p, q, other = joined.find(int(comp[k])), joined.find(p["b_in"]), own.get(p["b"])
                    if p != q and other is not None and linked(s, other):
                        joined.join(p, q)
                        out.append((p, q))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], names=["a", "b"])


class _Work:
    """The tables of one join: texts (id, body) and homes (node, id, print, n_shingles, home, salt)."""

    def __init__(self, texts: DataFrame, homes: DataFrame) -> None:
        self.texts, self.homes = texts, homes

    def with_texts(self, roles: DataFrame) -> DataFrame:
        """roles with the body of each of their ids."""
        small_batches(self.texts, 500)
        return self.texts.join(F.broadcast(roles) if roles.count() <= SMALL else roles, "id")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked pairs (a, b) of components among candidate pairs."""
        a = pairs.groupBy("a", "a_in", "home", "salt").agg(F.collect_set(F.struct("b", "b_in")).alias("partners"))
        a = a.select(F.col("a").alias("node"), F.col("a_in").alias("component"), "home", "salt", F.lit(1).alias("role"), "partners")
        b = pairs.select(F.col("b").alias("node"), F.col("b_in").alias("component"), "home", "salt", F.lit(0).alias("role")).distinct()
        who = self.homes.select("node", "id", "print")
        roles = saved(a.unionByName(b, allowMissingColumns=True).join(who, "node"), "roles")
        return saved(self.with_texts(roles).repartition("home", "salt").sortWithinPartitions("home", "salt", "role", "node").mapInArrow(_compare, "a long, b long"), "links")


def _parts(n: str) -> F.Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _shared_keys(classes: DataFrame, exact: bool) -> DataFrame:
    """(node, n_shingles, keys): of each class the keys, as (times, key), under which it can meet a linked one; classes without are left out."""
    own = classes.select("node", F.explode("keys").alias("key"))
    times = saved(own.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "key-counts")
    shared = own.join(times, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("keys"))
    # All shingles of a small set, and of those it may link with, are keys.
    least = F.ceil(F.col("of.n_shingles") * PERCENT / 100)
    if not exact:
        least = F.when(F.col("of.n_shingles") * 100 <= PERCENT * KEYS, least).otherwise(F.lit(SHARED))
    # Of all keys the last least - 1 are left out; keys of one class alone are the rarest and come first.
    count = (F.size("s.keys") - least + 1).cast("int")
    joined = shared.alias("s").join(classes.alias("of"), "node")
    return joined.select("node", "of.id", "of.print", "of.n_shingles", F.slice("s.keys", F.lit(1), F.greatest(count, F.lit(0))).alias("keys")).where(F.size("keys") > 0)


def _with_homes(lists: DataFrame) -> DataFrame:
    """lists with home, the most frequent key, and salt, the part of it that holds the class."""
    best = lists.withColumn("home", F.try_element_at("keys", F.lit(-1))["key"])
    # Written first: a join of two plain tables is one whose hot keys are split at run time.
    size = saved(best.groupBy("home").agg(F.greatest(_count_parts(), F.ceil(F.sum("n_shingles") / MOST)).cast("int").alias("parts")), "home-sizes")
    return best.join(size, "home").select("node", "id", "print", "n_shingles", "keys", "home", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"))


def _count_parts() -> F.Column:
    return F.ceil(F.count("*") / BLOCK)


def _mixed_keys(homes: DataFrame, component: DataFrame) -> DataFrame:
    """(key, node, component, home, salt, n_shingles, n) of keys that hold several components from several homes; n: the key's classes."""
    entries = homes.join(component, "node").select(F.explode("keys.key").alias("key"), "node", "component", "home", "salt", "n_shingles")
    place = F.xxhash64("home", "salt")
    keys = entries.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(place).alias("u"), F.max(place).alias("v"), F.count("*").alias("n")).where("x <> y and u <> v").select("key", "n")
    keys = saved(keys, "key-counts")
    return saved(entries.join(keys, "key"), "mixed-keys")


def _families(held: DataFrame) -> DataFrame:
    """held with one key for the large keys that hold nearly the same classes, as all those of a group of near copies do.

    A large key goes into the one that is the most frequent of most of its classes, and takes all
    its classes there. So whoever met under a key still meets. Only one step is taken: a key that
    others go into may itself go elsewhere, and they do not follow it, so groups do not chain.
    """
    large = held.where(F.col("n") > BLOCK)
    if large.isEmpty():
        return held
    top = F.max(F.struct("n", "key")).over(Window.partitionBy("node"))["key"]
    votes = large.select("key", "n", top.alias("top")).groupBy("key", "n", "top").agg(F.count("*").alias("votes"))
    most = votes.groupBy("key", "n").agg(F.max(F.struct("votes", "top")).alias("x"))
    into = saved(most.select("key", F.when(100 * F.col("x.votes") >= WITHIN * F.col("n"), F.col("x.top")).otherwise(F.col("key")).alias("into")), "families")
    rows = large.drop("n").join(into, "key").withColumn("key", F.col("into")).drop("into").dropDuplicates(["key", "node"])
    rows = saved(rows, "family-keys")
    sizes = saved(rows.groupBy("key").agg(F.count("*").alias("n")), "key-counts")
    return held.where(F.col("n") <= BLOCK).unionByName(saved(rows.join(sizes, "key"), "family-keys"))


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of classes -> all shingle hashes of each."""
    for batch in batches:
        node, component, prints = batch.column("node"), batch.column("component"), batch.column("print").to_pylist()
        for x, _, data, offsets in pieces(batch.column("body"), lower=True):
            sets = {k: s for k, s in enumerate(_sets(data, offsets), x) if _print(s) == prints[k]}
            at = pa.array(list(sets), pa.int64())
            keys = pa.array([s.view(np.int64) for s in sets.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([node.take(at), component.take(at), keys], names=["node", "component", "keys"])


def _fine_keys(work: _Work, hot: DataFrame, component: DataFrame) -> DataFrame:
    """homes of the hot classes with finer keys: (shingle, cell, cell), under which two linked ones of different components and these size cells meet."""
    who = work.homes.join(hot, "node", "left_semi").join(component, "node")
    texts = work.with_texts(saved(who.select("id", "node", "print", "component"), "hot"))
    own = saved(texts.mapInArrow(_whole_sets, "node long, component long, keys array<bigint>"), "hot-sets").select("node", "component", F.explode("keys").alias("key"))
    # No link is sought inside a component, so only what several have counts.
    times = own.groupBy("key").agg(F.count("*").alias("times"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key", "times")
    shared = own.join(saved(times, "hot-counts"), "key").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("times", "key"))).alias("all"))
    size = F.col("n_shingles")
    cell = F.floor(F.log(size.cast("double")) / F.log(F.lit(CELL))).cast("int")
    lists = work.homes.drop("keys").join(shared, "node").withColumn("cell", cell).withColumn("other", F.explode(F.sequence(cell - APART, cell + APART)))
    # The least size in the other cell, and the overlap that a link to it takes.
    low = F.greatest(F.floor(F.pow(F.lit(CELL), "other") * (1 - 1e-9)), F.ceil(size * PERCENT / 100))
    least = F.ceil((size + low) * PERCENT / (100 + PERCENT) - 1e-9)
    count = (F.size("all") - least + 1).cast("int")
    fits = lists.where((low * PERCENT <= size * 100) & (count > 0))
    key = F.transform(F.slice("all", F.lit(1), count), lambda x: F.xxhash64(x["key"], F.least("cell", "other"), F.greatest("cell", "other")))
    return saved(fits.select("node", key.alias("keys")).groupBy("node").agg(F.flatten(F.collect_list("keys")).alias("keys")).select("node", F.transform("keys", lambda k: F.struct(k.alias("key"))).alias("keys")).join(work.homes.drop("keys"), "node"), "fine-keys")


def _tasks(held: DataFrame) -> DataFrame:
    """(task, side, node, ...): the trees that search all keys completely; a large key's nodes in pairs."""
    small = held.where(F.col("n") <= BLOCK).select("key", F.xxhash64("key").alias("task"), F.lit(0).alias("side"), "node", "component", "home", "salt", "n_shingles")
    large = held.where(F.col("n") > BLOCK)
    if large.isEmpty():
        return small
    of = large.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component"))["component"].alias("largest"))
    cell = ["key", "bucket", "main"]
    # Sizes in steps of 4 to 3: linked sets are in one bucket or in two that follow each other.
    dealt = large.join(of, "key").withColumn("bucket", F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(4 / 3))).cast("int")).withColumn("main", F.col("component") == F.col("largest"))
    parts = dealt.groupBy(cell).agg(_count_parts().cast("int").alias("parts"))
    dealt = saved(dealt.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("n", "largest", "parts"), "large-keys")
    nodes = dealt.groupBy("key", "bucket", "main", "part").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.min("component").alias("x"), F.max("component").alias("y"))
    nodes = nodes.withColumn("name", F.struct("bucket", "main", "part"))
    p, q = nodes.alias("p"), nodes.alias("q")
    fits = (100 * F.col("p.high") >= PERCENT * F.col("q.low")) & (100 * F.col("q.high") >= PERCENT * F.col("p.low"))
    alike = (F.col("p.x") == F.col("p.y")) & (F.col("q.x") == F.col("q.y")) & (F.col("p.x") == F.col("q.x"))
    pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.name") <= F.col("q.name")) & fits & ~alike)
    task = F.xxhash64("p.key", "p.name", "q.name").alias("task")
    one = pairs.select("p.key", "p.name", task, F.lit(0).alias("same"))
    # A node with itself is one tree; of two nodes the sides are told apart.
    other = pairs.where(F.col("p.name") != F.col("q.name"))
    sides = one.join(other.select(task.alias("task")), "task", "left_anti").withColumn("side", F.lit(0)).drop("same")
    sides = sides.unionByName(other.select("p.key", "p.name", task, F.lit(1).alias("side"))).unionByName(other.select("p.key", "q.name", task, F.lit(2).alias("side")))
    wide = dealt.withColumn("name", F.struct("bucket", "main", "part")).join(sides, ["key", "name"])
    return small.unionByName(wide.select(small.columns))


def _found(tasks: DataFrame, bitmaps: DataFrame, every: bool) -> DataFrame:
    """The pairs of all tasks (every), or the likeliest of each component."""
    if every:
        # Only the tasks' own lesser keys tell a pair earlier: no other key of a class goes along.
        of = tasks.groupBy("node").agg(F.collect_set("key").alias("keys")).join(bitmaps, "node")
        rows = tasks.join(of, "node").withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))
    else:
        rows = tasks.join(bitmaps, "node")
    found = rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(_search(every), _PAIRS)
    if every:
        return found.drop("likeness").distinct()
    best = found.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("likeness", "b", "b_in", "a_in", "home", "salt")), asc=False), 1, PICKS).alias("x"))
    return best.select("a", F.explode("x").alias("x")).select("a", "x.a_in", "x.b", "x.b_in", "x.home", "x.salt")


def _complete(work: _Work, held: DataFrame, component: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The candidate pairs of all keys, large ones by the finer keys of their classes."""
    found = _found(_tasks(held.where(F.col("n") <= BLOCK)), bitmaps, True)
    hot = held.where(F.col("n") > BLOCK).select("node").distinct()
    if hot.isEmpty():
        return found
    fine = _fine_keys(work, hot, component)
    again = _mixed_keys(fine, component)
    if again.isEmpty():
        return found
    return found.unionByName(_found(_tasks(_families(again)), bitmaps, True))


def _labelled(docs: DataFrame, id_col: str, text_col: str, exact: bool) -> tuple[DataFrame, DataFrame]:
    """(profile of every row: id, h, n_shingles, print; label of every class: print, part, component; parts are the components of texts, component the smallest id in one)."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("body"))
    made = map_texts(rows.withColumn("h", F.xxhash64("body")), "body", _profile(None if exact else KEYS), "n_shingles long, print binary, keys array<bigint>", lower=True)
    profile = saved(made.drop("body"), "profiles")
    some = profile.where("id is not null and n_shingles > 0")
    # Rows of one print have one set, so any row's size and keys will do.
    member = some.groupBy("print").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    classes = saved(member.select(F.monotonically_increasing_id().alias("node"), "id", "print", "n_shingles", "keys"), "classes")

    lists = saved(_shared_keys(classes, exact), "keys")
    homes = saved(_with_homes(lists), "homes")
    work = _Work(rows.where("id is not null"), homes)
    texts = work.with_texts(homes.select("id", "node", "print", "home", "salt"))
    settled_at_home = saved(texts.repartition("home", "salt").sortWithinPartitions("home", "salt", "node").mapInArrow(_at_home, "node long, component long, bitmap binary"), "trees")
    component = settled_at_home.select("node", "component")
    bitmaps = settled_at_home.select("node", "bitmap")

    for every in (False, True):
        held = _mixed_keys(homes, component)
        if held.isEmpty():
            break
        if every:
            pairs = _complete(work, held, component, bitmaps)
        else:
            parts = _families(held).withColumn("task", F.xxhash64("key", F.pmod(F.xxhash64("node"), _parts("n")))).withColumn("side", F.lit(0)).drop("n")
            pairs = _found(parts, bitmaps, every)
        links = work.links(saved(pairs, "pairs"))
        if not links.isEmpty():
            component = saved(merged(component, links), "components")

    label = classes.select("node", "print", F.col("id").alias("rep")).join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = label.groupBy("component").agg(F.min("rep").alias("least"))
    return profile.drop("keys"), saved(label.join(least, "component").select("print", F.col("component").alias("part"), F.col("least").alias("component")), "labels")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id.

    Null and empty texts, and texts without words, have no shingles and stand alone; texts of 1
    to 4 words are one shingle. Rows that share an id count as one document in component_id,
    whatever their texts. A null id stands alone with a null component_id. Empty table: no rows.

    exact: take all hashes of a set as keys, so that no pair can be missed, for about ten times
    the keys on texts of 500 words.
    """
    profile, label = _labelled(docs, id_col, text_col, exact)
    out = profile.join(label, "print", "left").withColumn("component", F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))))
    # An id that occurs with texts of several components joins them.
    several = out.groupBy("id").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("id")
    edges = saved(out.join(several, "id").select(F.col("id").alias("a"), F.col("component").alias("b")).distinct(), "shared-ids")
    if not edges.isEmpty():
        up = components(edges).select(F.col("node").alias("component"), F.col("component").alias("least"))
        out = out.join(up, "component", "left").withColumn("component", F.coalesce("least", "component"))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """docs with one row of each group of linked texts, that of the smallest id (of several texts of that id, the one with the smallest hash).

    Rows without shingles and rows with a null id all stay. Rows that share an id but not a
    similar text are different texts, and each stays with its own group. Empty table: no rows.
    """
    profile, label = _labelled(docs, id_col, text_col, exact)
    known = profile.where("id is not null and n_shingles > 0").join(label, "print")
    first = known.groupBy("part").agg(F.min(F.struct("id", "h")).alias("x")).select("x.id", "x.h")
    again = known.groupBy("id", "h").agg(F.count("*").alias("times"))
    stays = saved(first.join(again, ["id", "h"]).unionByName(profile.where("id is not null and n_shingles = 0").select("id", "h", F.lit(1).alias("times")).distinct()), "stays")
    at = docs.withColumn("__id", docs[id_col].cast("long")).withColumn("__h", F.xxhash64(docs[text_col]))
    match = (at["__id"] == stays["id"]) & (at["__h"] == stays["h"])
    once = at.join(stays.where("times = 1"), match, "left_semi").select(*[at[c] for c in docs.columns])
    # Repeated rows: only these are shuffled to keep one of them.
    more = at.join(stays.where("times > 1"), match, "left_semi").dropDuplicates(["__id", "__h"]).select(docs.columns)
    return once.unionByName(more).unionByName(docs.where(F.col(id_col).isNull()))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of documents; see join for nulls, ties and empty texts."""
    return join(table(spark, sf_dir, "documents"))
