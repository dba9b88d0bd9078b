"""SimHash near-duplicates: a grid join over segment bit counts, verified exactly.

Fingerprint: bytes A-Z of the whole text lower-cased, words split at ASCII white space, shingles of ``words`` words
joined by one blank, repeats included (fewer words: the whole sequence); a bit is 1 if more than half of the shingles'
XXH64 values (seed 42) have it. No word: fingerprint zero, an ordinary fingerprint.

Search: the fingerprint's 32 segments of two bits are mapped to their bit counts, a point with coordinates 0, 1, 2.
Its Manhattan distance to another point is at most the Hamming distance of the fingerprints, hence a lower bound. The
coordinates fall into three groups; points within four bits are within two steps of each other over some two of the
groups. For every two groups there is a grid of unit cells over their coordinates, and a point is put into its own
cell and into all neighbouring ones (a step along one coordinate): two points within two steps meet in a cell, so no
pair is lost. Pairs in a cell pass the Manhattan bound over all coordinates, then the exact Hamming distance. The
counts are kept in unary within one BIGINT, so that both distances are ``bit_count(xor)`` and all of this stays in
generated JVM code. A point has about 99 cells of 2 ** 32 (independent bits), at every size.

Copies: only different fingerprints are joined, one row each with its smallest id. A cell with more than ``HOT_CELL``
points is divided by the fingerprints' bits (any four of eight groups equal, which pairs within four bits have in
common), so that even points that are all equal are not held against each other; what is still too large then is cut
into blocks of that size, whose pairs are tasks of their own. Components come from distributed star contraction;
nothing but counts reaches the driver.

Near copies by similarity: at a Jaccard similarity of 0.8 two whole-text fingerprints differ in about ten bits, more
than a grid can search. ``near_copies`` therefore fingerprints ``SAMPLES`` min-wise samples of ``SAMPLE_SIZE``
shingles each (the majority bits of the sampled shingles' hashes) and searches for equal ones, which is min-wise
hashing in bands rather than the grid; two texts of similarity s agree in such a fingerprint with probability about
``s ** SAMPLE_SIZE``, so at 0.8 a pair is missed with a probability of 0.00003. The sets in cells of more than
``HOT_CELL`` are joined by the prefixes of their shingles instead, which misses none. Candidates are verified by the
exact Jaccard similarity of their shingle sets.

Defined results: a null text counts as empty; rows with a null id are fingerprinted, linked and returned, but never
name a component, unless the whole component has null ids, whose component is null; repeated rows give repeated
rows; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, connected_components, field, hex_of, table, utf8

MAX_BITS = 4
#: Min-wise samples per text and shingles in each.
SAMPLES, SAMPLE_SIZE = 20, 4
#: Keys up to which a side is broadcast after counting it; beyond that, joins shuffle.
BROADCAST_KEYS = 1_000_000
#: Points that a cell may hold before it is divided, and so the largest block of pairs that one key makes.
HOT_CELL = 2000
#: Sets of large cells whose shingles are counted, and frequent shingles put last by it. They order, they drop nothing.
ORDER_SAMPLE, ORDER_MOST = 20_000, 20_000
#: Fingerprints whose cells one task makes.
SPREAD = 20_000
_LOW = 0x5555555555555555


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """Unsigned XXH64 values of a text's word shingles, in order, repeats included."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[: len(parts) - words].tolist()]
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def majority(hashes: list[int]) -> int:
    """Signed 64-bit fingerprint of shingle values; zero for none."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        raw = np.array(hashes[lo : lo + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp BIGINT)`` of every row."""

    def fn(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [majority(shingle_hashes(b, words)) for b in utf8(batch.column(1))]]

    return arrow_map(docs.select(id_col, text_col), fn, T.StructType([field(docs, id_col), T.StructField("fp", T.LongType())]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary in its own two bits: 00, 01 or 11."""
    odd = F.shiftrightunsigned(fp, 1)
    low = fp.bitwiseOR(odd).bitwiseAND(F.lit(_LOW))
    both = fp.bitwiseAND(odd).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(F.shiftleft(both, 1))


def _grids(max_bits: int) -> tuple[int, int]:
    """``(groups, chosen)``: points within ``max_bits`` are within two steps over some ``chosen`` of the groups."""
    if max_bits <= 2:
        return 1, 1
    if max_bits <= 4:
        return 3, 2
    return -(-(max_bits + 1) // 3), 1


def _masks(bits: int, groups: int, chosen: int, each: int) -> list[int]:
    """The bits of every choice of ``chosen`` of the groups; fields of ``bits`` bits are dealt to the groups in turn."""
    field_bits = (1 << bits) - 1
    parts = [sum(field_bits << (bits * f) for f in range(each)[k::groups]) for k in range(groups)]
    return [sum(c) for c in combinations(parts, chosen)]


def _cells(classes: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, key)``: every cell that a fingerprint's point is put into."""
    groups, chosen = _grids(max_bits)
    rows = []
    for mask in _masks(2, groups, chosen, 32):
        # Segments outside the mask read 10, which no count is: grids over different groups have no key in common.
        mark = sum(2 << (2 * f) for f in range(32) if not mask >> (2 * f) & 1)
        rows += [(mask, mark, 0)] + [(mask, mark, 1 << k) for k in range(64) if mask >> k & 1]
    steps = F.array(*(F.struct(*(F.lit(_signed(x)).alias(n) for x, n in zip(r, ("mask", "mark", "step")))) for r in rows))
    cell = segment_counts(F.col("fp")).bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.step"))
    real = F.shiftrightunsigned("cell", 1).bitwiseAND(F.bitwise_not("cell")).bitwiseAND(F.lit(_LOW)) == 0
    return classes.select("fp", F.explode(steps).alias("s")).select("fp", cell.alias("cell"), "s.mark").where(real).select("fp", F.col("cell").bitwiseOR(F.col("mark")).alias("key"))


def _pairs(cells: DataFrame, on: list[str], max_bits: int) -> DataFrame:
    # Sizes are estimated without the explosion into cells; the hint keeps Spark from broadcasting them.
    a, b = cells.alias("a").hint("merge"), cells.alias("b")
    return a.join(b, _close(on, max_bits)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _close(on: list[str], max_bits: int) -> Column:
    near = F.col("a.fp") < F.col("b.fp")
    for c in on:
        near &= F.col(f"a.{c}") == F.col(f"b.{c}")
    bound = F.bit_count(segment_counts(F.col("a.fp")).bitwiseXOR(segment_counts(F.col("b.fp")))) <= max_bits
    return near & bound & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)


def in_blocks(rows: DataFrame, sizes: DataFrame, on: list[str], item: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join of large cells, cut into pairs of blocks of about ``most`` rows: columns ``on`` and ``block``.

    ``sizes`` has the cells' ``on`` and ``n``. The left side's rows go to the block pairs of their row, the right
    side's to those of their column, so that every pair of rows meets once and no key holds more than two blocks.
    """
    parts = F.ceil(F.col("n") / most).cast("int")
    placed = rows.join(sizes.withColumn("k", parts).drop("n"), on).withColumn("b", F.pmod(F.xxhash64(item), F.col("k")).cast("int"))
    every = F.sequence(F.lit(0), F.col("k") - 1)
    left = placed.withColumn("block", F.explode(F.transform(every, lambda x: F.col("b") * F.col("k") + x))).drop("k", "b")
    right = placed.withColumn("block", F.explode(F.transform(every, lambda x: x * F.col("k") + F.col("b")))).drop("k", "b")
    return left, right


def _hot(cells: DataFrame, on: list[str], most: int) -> DataFrame:
    return table(cells.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > most), "hot-cells")


def links(classes: DataFrame, n_classes: int, max_bits: int = MAX_BITS, hot: int = HOT_CELL) -> DataFrame:
    """Distinct pairs ``(u, v)``, u < v, of the different fingerprints ``classes(fp)`` within ``max_bits`` bits."""
    # Spread first: a fingerprint becomes a hundred cells.
    cells = _cells(classes.select("fp").repartition(max(1, -(-n_classes // SPREAD))), max_bits)
    big = _hot(cells, ["key"], hot) if n_classes > hot else None
    if big is None or big.isEmpty():
        return _pairs(cells, ["key"], max_bits).distinct()
    found = _pairs(cells.join(big, "key", "left_anti"), ["key"], max_bits)
    # Whatever their points, fingerprints within max_bits agree in four of max_bits + 4 groups of bits.
    masks = F.array(*(F.lit(_signed(m)) for m in _masks(1, max_bits + 4, 4, 64)))
    finer = cells.join(big.select("key"), "key", "left_semi").select("fp", "key", F.posexplode(masks).alias("choice", "mask"))
    finer = finer.select("fp", "key", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    on = ["key", "choice", "bits"]
    dense = _hot(finer, on, hot)
    if dense.isEmpty():
        return found.unionByName(_pairs(finer, on, max_bits)).distinct()
    found = found.unionByName(_pairs(finer.join(dense, on, "left_anti"), on, max_bits))
    left, right = in_blocks(finer, dense, on, "fp", hot)
    blocks = left.alias("a").hint("merge").join(right.alias("b"), _close([*on, "block"], max_bits)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    return found.unionByName(blocks).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id, n_links)`` for every row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included; n_links counts the *different*
    fingerprints within ``max_bits`` bits of the row's own.
    """
    prints = table(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = table(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    pairs = table(links(classes.select("fp"), classes.count(), max_bits), "links")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = connected_components(pairs).select(F.col("node").alias("fp"), "root").join(ends, "fp")
    known = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = table(known, "roots")
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(names, "root").select("fp", "component_id", "n_links")
    return prints.join(named, "fp").select(F.col(id_col), hex_of(F.col("fp")).alias("fingerprint"), "component_id", "n_links")


def _sample_prints(values: np.ndarray) -> list[int]:
    """One fingerprint per min-wise sample of a set of shingle values (uint64, not empty)."""
    rng = np.random.default_rng(5)
    odd = rng.integers(0, 1 << 63, SAMPLES * SAMPLE_SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(odd), np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(values), 4096):
        least = np.minimum(least, np.multiply.outer(odd, values[lo : lo + 4096]).min(axis=1))
    bits = np.unpackbits(least.view(np.uint8).reshape(SAMPLES, SAMPLE_SIZE, 8), axis=2, bitorder="little").sum(1)
    return np.packbits(2 * bits > SAMPLE_SIZE, axis=1, bitorder="little").view("<i8").reshape(-1).tolist()


def _set_key(values: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    key = xxh3_64_intdigest(values.tobytes())
    return key - (1 << 64) if key >> 63 else key


def sketches(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, version, shingles_key, samples)``: a hash of the text, one of its shingle set and the samples' fingerprints."""

    def fn(batch: pa.RecordBatch) -> list:
        keys, samples = [], []
        for text in utf8(batch.column(2)):
            values = np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))
            keys.append(_set_key(values))
            samples.append(_sample_prints(values) if len(values) else [])
        return [batch.column(0), batch.column(1), keys, samples]

    schema = T.StructType([field(docs, id_col), T.StructField("version", T.LongType()), T.StructField("shingles_key", T.LongType()), T.StructField("samples", T.ArrayType(T.LongType()))])
    return arrow_map(docs.select(id_col, _version(text_col).alias("version"), text_col), fn, schema)


def _version(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the keys are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _shingle_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``(node, shingles)`` of the ``wanted(node)`` shingle sets, each from one document that has it."""
    reps = rows.join(wanted, F.col("shingles_key") == F.col("node"), "left_semi").groupBy("shingles_key").agg(F.min(F.struct(id_col, "version")).alias("r"))
    reps = table(reps.select(F.col("shingles_key").alias("node"), F.col(f"r.{id_col}").alias("__q_id"), F.col("r.version").alias("__q_v")), "representatives")
    texts = docs.select(id_col, _version(text_col).alias("version"), text_col)
    texts = texts.join(_small(reps.select("__q_id", "__q_v").distinct()), F.col(id_col).eqNullSafe(F.col("__q_id")) & (F.col("version") == F.col("__q_v")), "left_semi")

    def fn(batch: pa.RecordBatch) -> list:
        sets = [np.unique(np.array(shingle_hashes(t, words), dtype=np.uint64)) for t in utf8(batch.column(0))]
        return [[_set_key(v) for v in sets], [v.view(np.int64) for v in sets]]

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return arrow_map(texts.select(text_col), fn, schema).groupBy("node").agg(F.first("shingles").alias("shingles"))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(u, v)`` whose shingle sets have at least that Jaccard similarity."""
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(a, "u").join(b, "v")
    n = F.size("a") + F.size("b")
    fits = F.least(F.size("a"), F.size("b")) >= similarity * F.greatest(F.size("a"), F.size("b"))
    common = F.size(F.array_intersect("a", "b"))
    return both.where(fits).where(common >= similarity * (n - common)).select("u", "v")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_CELL) -> DataFrame:
    """``(id, version, component)`` for every row: texts whose shingle sets are linked by at least ``similarity``.

    Equal sets are one node. Each node is first held against one other, the smallest node of most of its cells; then
    pairs of a cell that still lie in different components are held against each other. Links within a component
    would add nothing, so that a large group of copies costs one comparison a copy.
    """
    rows = table(sketches(docs, words, id_col, text_col), "sketches")
    nodes = rows.groupBy("shingles_key").agg(F.first("samples").alias("samples"))
    cells = nodes.select(F.col("shingles_key").alias("node"), F.posexplode("samples").alias("choice", "key"))
    shared = cells.groupBy("choice", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    member = table(cells.hint("merge").join(shared, ["choice", "key"]), "members")
    best = member.where("node != hub").groupBy("node", "hub").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    stars = table(best.select(F.col("hub").alias("u"), F.col("node").alias("v")), "stars")
    sets = table(_shingle_sets(docs, rows, member.select("node").distinct(), words, id_col, text_col), "shingle-sets")
    found = table(_similar(stars, sets, similarity), "copies")
    roots = table(connected_components(found), "roots")
    rest = table(_apart(member, roots, sets, similarity, hot).join(stars, ["u", "v"], "left_anti"), "apart")
    more = table(_similar(rest, sets, similarity), "copies")
    if not more.isEmpty():
        roots = table(connected_components(found.unionByName(more)), "roots")
    return rows.join(roots, F.col("shingles_key") == F.col("node"), "left").select(id_col, "version", F.coalesce("root", "shingles_key").alias("component"))


def _apart(member: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, hot: int) -> DataFrame:
    """Distinct pairs ``(u, v)``, u < v, of nodes in a cell of ``member`` whose components differ.

    Only cells that hold several components are read again. The nodes of those with more than ``hot`` nodes are joined
    by prefixes, whichever cells they share: pairs that can't be similar are left out, all others are there.
    """
    cell = ["choice", "key"]
    placed = member.join(roots, "node", "left").select(*cell, "n", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy(*cell).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select(*cell)
    placed = table(placed.join(mixed, cell, "left_semi"), "mixed")
    calm, large = placed.where(F.col("n") <= hot), placed.where(F.col("n") > hot)
    pairs = _between(calm, calm, cell)
    if not large.isEmpty():
        pairs = pairs.unionByName(_by_prefix(table(large.select("node", "root").distinct(), "large-cells"), sets, similarity, hot))
    return pairs.distinct()


def _between(a: DataFrame, b: DataFrame, on: list[str], also: Column | None = None) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of nodes that agree in ``on`` and whose components differ."""
    same = (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
    for c in on:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    return a.alias("a").hint("merge").join(b.alias("b"), same if also is None else same & also).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def _by_prefix(nodes: DataFrame, sets: DataFrame, similarity: float, hot: int) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of ``nodes(node, root)`` of different components: all that are similar, and few others.

    However all shingles are ordered, two similar sets have their first common shingle early in both: what is left of
    either set from there on has to hold all they have in common. So only such prefixes are joined, under that bound.
    Frequent shingles come last, by counts over a sample. The nodes of a shingle that more than ``hot`` prefixes hold
    are joined block by block.
    """
    rows = table(_prefixes(nodes.join(sets, "node"), *_frequent(nodes, sets, hot), similarity), "prefixes")
    rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    enough = rest >= similarity * (F.col("a.n") + F.col("b.n") - rest)
    dense = _hot(rows, ["shingle"], hot)
    if dense.isEmpty():
        return _between(rows, rows, ["shingle"], enough)
    calm = rows.join(dense, "shingle", "left_anti")
    left, right = in_blocks(rows, dense, ["shingle"], "node", hot)
    return _between(calm, calm, ["shingle"], enough).unionByName(_between(left, right, ["shingle", "block"], enough))


def _frequent(nodes: DataFrame, sets: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``ORDER_MOST`` frequent shingles of the ``nodes``' sets, ascending, and their ranks by frequency."""
    share = -(-nodes.count() // ORDER_SAMPLE)
    few = nodes.select("node").where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0)
    counts = sets.join(few, "node", "left_semi").select(F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") > max(1, hot // (4 * share))).orderBy(F.desc("n"), "x").limit(ORDER_MOST).collect()
    values = np.array([r.x for r in reversed(top)], dtype=np.int64)
    ranks = np.argsort(values)
    return values[ranks], ranks


def _prefix(values: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, in order, up to the last that may be the first common one of two similar sets."""
    rank = np.full(len(values), -1, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        rank = np.where(frequent[at] == values, ranks[at], -1)
    left = len(values) - np.arange(len(values))
    return values[np.lexsort((values, rank))][left >= similarity * len(values)]


def _prefixes(held: DataFrame, frequent: np.ndarray, ranks: np.ndarray, similarity: float) -> DataFrame:
    """``(node, root, n, pos, shingle)`` of ``held(node, root, shingles)``: sizes and prefixes of the sets."""

    def fn(batch: pa.RecordBatch) -> list:
        sets = [s.values.to_numpy() for s in batch.column(2)]
        return [batch.column(0), batch.column(1), [len(s) for s in sets], [_prefix(s, frequent, ranks, similarity) for s in sets]]

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return arrow_map(held.select("node", "root", "shingles"), fn, schema).select("node", "root", "n", F.posexplode("prefix").alias("pos", "shingle"))


def distinct_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies: the one with the smallest id (null ids last), all columns.

    The texts stay where they are: the rows to drop are broadcast while they are few enough, else joined by shuffle.
    """
    placed = table(near_copies(docs, words, similarity, id_col, text_col), "placed")
    rank = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), "version")
    least = placed.groupBy("component").agg(F.min(rank).alias("least"))
    kept = least.select(F.col("least.id").alias("__q_id"), F.col("least.version").alias("__q_v"))
    each = placed.groupBy(id_col, "version").agg(F.count("*").alias("n"))
    mine = F.col(id_col).eqNullSafe(F.col("__q_id")) & (F.col("version") == F.col("__q_v"))
    gone = table(each.join(kept, mine, "left_anti").select(F.col(id_col).alias("__q_id"), F.col("version").alias("__q_v")), "dropped")
    repeated = table(each.where("n > 1").join(kept, mine, "left_semi").select(F.col(id_col).alias("__q_id"), F.col("version").alias("__q_v")), "repeated")
    marked = docs.withColumn("__q_version", _version(text_col))
    here = F.col(id_col).eqNullSafe(F.col("__q_id")) & (F.col("__q_version") == F.col("__q_v"))
    left = marked.join(_small(gone), here, "left_anti")
    if not repeated.isEmpty():
        few = _small(repeated)
        once = left.join(few, here, "left_semi").dropDuplicates([id_col, "__q_version"])
        left = left.join(few, here, "left_anti").unionByName(once)
    return left.select(*docs.columns)
