"""Exact Jaccard join of word-shingle sets in metric space.

The Jaccard distance is a metric, with radius r = 1 - similarity. Unrelated documents are all at distance 1 from each
other and from any pivot, so a Voronoi diagram of the whole corpus has one cell; the diagrams start where distances fall
below 1, in regions of documents that share a shingle.

1. Equal sets collapse to one representative; representatives of one id are tied.
2. A pair within r shares a shingle among the first n - ceil(similarity * n) + 1 of both sets in any one order of all
   shingles. The order here puts shingles that are frequent in the corpus last. Every such shingle spans a region: the
   documents that hold it there. A region of two is one distance; all others are Voronoi diagrams.
3. Pivots lie further than 2r apart and stand for different components; every member has its exact distance to each, and
   so its links to them. It belongs to the cell of its nearest pivot, or to the outer cell if none is within 1 - 2r. By
   the triangle inequality a partner of a member of pivot p's cell lies within 2r of its own nearest distance and within
   1 - r of p: such boundary documents are replicated to the cell of p.
4. Cells that still hold several components recur with pivots of their own: large ones as regions dealt over tasks, those
   of up to `leaf` members inside one task, where a pivot, once measured, leaves all cells, until two members are left. A
   projection that never enlarges distances (sizes, then 1024 parity bits, more for larger sets) leaves out members without any plausible
   partner before whole sets are shipped. Large cells that a diagram does not split are compared block by block under
   triangle windows of that projection and verified at once: a group of near copies gives one link a merger, no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import OWN, dealt, slices, text_key, written
from eventlens.llm.components import LocalComponents, connected_components

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
SKETCH_BITS = 1024
#: Bits of the sketches that larger sets have besides, at most: 8 KB.
WIDEST = 1 << 16
#: Share of the hash space in which shingles are counted exactly, in 32nds; prefixes of most documents end before it.
ZONE = 9
#: A cell of more shingles is dealt over tasks, whatever the number of its members.
LEAF_SHINGLES = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _B
    x = (x ^ x >> np.uint64(27)) * _C
    return x ^ x >> np.uint64(31)


def shingle_sets(texts: pa.Array, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes, distinct and ascending per text; number for each text).

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than k words has its whole sequence as
    one shingle; null and blank texts have none.
    """
    import xxhash

    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    length = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    real = np.fromiter((w != "" for w in vocabulary), bool, len(vocabulary))
    code = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(length)), length)
    if len(code):
        keep = real[code]
        code, doc = code[keep], doc[keep]
    h = hashes[code] if len(code) else np.empty(0, np.uint64)
    n_words = np.bincount(doc, minlength=len(length)) if len(doc) else np.zeros(len(length), int)
    first = np.cumsum(n_words) - n_words
    out_doc, out = [], []
    if len(h) >= k:
        at = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :])
        value = h[at]
        for i in range(1, k):
            value = value * _A + h[at + i]
        out_doc.append(doc[at])
        out.append(mix(value))
    for n in range(1, k):
        few = np.flatnonzero(n_words == n)
        if len(few):
            value = np.full(len(few), n, np.uint64)
            for i in range(n):
                value = value * _C + h[first[few] + i]
            out_doc.append(few)
            out.append(mix(value))
    if not out:
        return np.empty(0, np.uint64), np.zeros(len(length), np.int64)
    s, d = np.concatenate(out), np.concatenate(out_doc)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])]
    s, d = s[new], d[new]
    return s, np.bincount(d, minlength=len(length))


def sketches(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """int64 [docs, 16]: parity of the number of shingles in each of 1024 buckets. Two sets differ in at least as many shingles as bits."""
    doc = np.repeat(np.arange(len(counts)), counts)
    bits = np.bincount(doc * SKETCH_BITS + (s >> np.uint64(7) & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=len(counts) * SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(counts), SKETCH_BITS), axis=1).view(np.int64)


def wide_sketch(s: np.ndarray) -> bytes:
    """Parities of a larger set in about two buckets a shingle, as packed bits; empty where SKETCH_BITS are enough."""
    if 2 * len(s) <= SKETCH_BITS:
        return b""
    width = min(WIDEST, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(7) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits in which two wide sketches differ; the wider one is folded to the other's width first. 0 where one is empty."""
    x, y = sorted((x, y), key=len)
    if not x:
        return 0
    folded = np.bitwise_xor.reduce(np.frombuffer(y, np.uint64).reshape(-1, len(x) // 8), axis=0)
    return int(np.bitwise_count(folded ^ np.frombuffer(x, np.uint64)).sum(dtype=np.int64))


def _count(k: int):
    """Shingles of the exact zone, with the number of documents in this task's slices; elsewhere only those that a slice repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s, _ = shingle_sets(b.column("text"), k)
            s, n = np.unique(s, return_counts=True)
            keep = (s >> np.uint64(59) < ZONE) | (n > 1)
            yield pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), pa.array(n[keep].astype(np.int32))], ["token", "n"])

    return run


def common_slots(rows: DataFrame, k: int, small: int, n_words: float, most_bits: int = 27) -> np.ndarray:
    """A bitmap (uint64 words) over the low hash bits that covers every shingle counted in more than `small` rows.

    It has about 32 slots a shingle, and 2^most_bits slots (16 MB) at most. A shingle whose slot is not set has at most
    `small` rows; one whose slot is set by another only takes the route of frequent ones.
    """
    counted = rows.select("text").mapInArrow(_count(k), "token long, n int")
    counted = dealt(counted, n_words * ZONE / 32, "token").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > small).select("token")
    counted = written(counted, "common")
    bits = min(most_bits, max(16, (32 * counted.count()).bit_length()))
    slot = F.col("token").bitwiseAND(F.lit((1 << bits) - 1))
    words = counted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(token & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def _sets(k: int, percent: int, bitmap: np.ndarray):
    mask = np.uint64(64 * len(bitmap) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s, counts = shingle_sets(b.column("text"), k)
            ends = np.cumsum(counts)
            keys = []
            for c in (_A, _C):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ c))])
                keys.append((sums[ends] - sums[ends - counts]).view(np.int64))
            common = (bitmap[(s & mask) >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)
            # by document, rare before common, then by hash: the sets are sorted by hash already
            doc = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((common, doc))
            rank = np.arange(len(s)) - np.repeat(ends - counts, counts)
            size = counts - -(-percent * counts // 100) + 1
            head = order[rank < np.repeat(size, counts)]
            dense = common[head] | (s[head] >> np.uint64(59) >= ZONE)
            n_head = np.bincount(doc[head], minlength=len(counts))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_head)]).astype(np.int32))
            prefix = pa.ListArray.from_arrays(offsets, pa.array(s[head].view(np.int64)))
            flags = pa.ListArray.from_arrays(offsets, pa.array(dense))
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * 16), pa.array(sketches(s, counts).ravel()))
            wide = pa.array([wide_sketch(s[j - n : j]) for j, n in zip(ends, counts, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tkey"), pa.array(counts), *map(pa.array, keys), sketch, wide, prefix, flags], ["doc", "tkey", "n", "k1", "k2", "sketch", "wide", "prefix", "dense"])

    return run


def _whole(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s, counts = shingle_sets(b.column("text"), k)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([s[j - n : j].tobytes() for j, n in zip(ends, counts, strict=True)], pa.binary())], ["rep", "whole"])

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Members that two ascending sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _sizes_fit(percent: int, a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs, a < b, each once, that sizes and sketches do not rule out."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    differing = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    fits = _sizes_fit(percent, F.col("na"), F.col("nb")) & ((100 + percent) * differing <= (100 - percent) * (F.col("na") + F.col("nb")))
    return pairs.where(fits).select("a", "b")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", small: int = 16, pivots: int = 8, leaf: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id, by_pivot for each row: documents link when 100 * shared >= percent * all shingles of both.

    by_pivot: a diagram found a link of this document's set by its distance to a pivot.

    Rows of one id are one node, whatever their texts. Rows without words or without an id link with nothing;
    component_id is their own id. Texts of any length are taken whole; an empty table gives no rows. small: shingles of
    more rows count as frequent; pivots: of a diagram; leaf: cells up to this size recur inside one task. They affect
    the order of work and by_pivot, never the components.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("tkey"), F.col(text_col).alias("text"))
    n_words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6  # about
    bitmap = common_slots(rows, k, small, n_words)
    sets = written(rows.mapInArrow(_sets(k, percent, bitmap), "doc long, tkey long, n long, k1 long, k2 long, sketch array<long>, wide binary, prefix array<long>, dense array<boolean>"), "sets")
    usable, key = sets.where("n > 0 and doc is not null"), ["n", "k1", "k2"]
    first = usable.groupBy(*key).agg(F.min(F.struct("doc", "tkey")).alias("f")).select(*key, "f.doc", "f.tkey")
    first = written(first.withColumn("rep", F.monotonically_increasing_id()), "first")
    nodes = written(usable.select("doc", *key).join(first.select(*key, "rep"), key).select("doc", "n", "rep"), "nodes")
    reps = usable.drop(*key[1:]).join(first.select("doc", "tkey", "rep"), ["doc", "tkey"]).dropDuplicates(["doc", "tkey"])
    reps = written(reps.select("rep", "n", "sketch", "wide", "prefix", "dense"), "reps")
    token = reps.select("rep", "n", F.explode(F.arrays_zip("prefix", "dense")).alias("t")).select(F.col("t.prefix").alias("token"), F.col("t.dense").alias("dense"), F.struct("n", "rep").alias("m"))

    # regions of shingles that are frequent or not counted: their sizes, and the member of lowest hash, which names them
    n_tokens = n_words * (105 - percent) / 100  # about
    dense = written(dealt(token.where("dense").select("token", "m"), n_tokens, "token"), "dense")
    order = F.struct(F.xxhash64("m.rep").alias("h"), F.col("m.rep").alias("rep"))
    sizes = written(dense.groupBy("token").agg(F.count("*").alias("size"), F.min(order)["rep"].alias("cell")).where("size > 1"), "sizes")
    dense = written(dense.join(sizes, "token"), "regions")

    # lists of shingles that are not frequent hold `small` members at most, by the counts of all shingles
    few = token.where("not dense").select("token", "m").unionByName(dense.where(F.col("size") <= small).select("token", "m"))
    lists = dealt(few, n_tokens, "token").groupBy("token").agg(F.sort_array(F.collect_list("m")).alias("ms")).where(F.size("ms") > 1)
    lists = written(lists.select("ms").distinct(), "lists")
    two = lists.where(F.size("ms") == 2).select(F.col("ms")[0].alias("x"), F.col("ms")[1].alias("y")).where(_sizes_fit(percent, F.col("x.n"), F.col("y.n")))
    near = written(_plausible(two.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), reps, percent), "near")

    # regions of one name make one region, so a group of copies has a few regions and not one per shingle
    named = F.array_min(F.transform("ms", lambda m: F.struct(F.xxhash64(m["rep"]).alias("h"), m["rep"].alias("rep"))))["rep"]
    listed = lists.where(F.size("ms") > 2).select(named.alias("cell"), F.explode("ms").alias("m"))
    region = listed.unionByName(dense.where(F.col("size") > small).select("cell", "m")).select("cell", "m.rep", "m.n").distinct()
    lower = F.when(F.xxhash64("a") < F.xxhash64("b"), F.col("a")).otherwise(F.col("b"))
    pair = near.select(lower.alias("cell"), F.explode(F.array("a", "b")).alias("rep")).join(reps.select("rep", "n"), "rep")
    region = written(region.unionByName(pair).distinct(), "region")
    region = written(_with_partners(region, reps, percent, leaf), "partners")
    wanted = region.select("rep").distinct()
    texts = rows.join(first.join(wanted, "rep", "left_semi").select("doc", "tkey", "rep"), ["doc", "tkey"]).dropDuplicates(["doc", "tkey"])
    whole = written(texts.select("rep", "text").mapInArrow(_whole(k), "rep long, whole binary"), "whole")
    spread = written(nodes.groupBy("doc").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b <> top").select("doc", "b"), "ids")
    links = [nodes.join(spread, "doc").select(F.col("rep").alias("a"), "b").distinct()]
    links, component, cells, blocks = _diagrams(region, whole, links, percent, pivots, leaf)
    by_pivot = links[1:]
    if cells is not None:
        links.append(_cell_links(_state(cells, component), whole, percent, pivots))
        by_pivot.append(links[-1])
    if blocks is not None:
        links.append(_block_links(_state(blocks, component), reps, whole, percent, leaf))
    if cells is not None or blocks is not None:
        component = connected_components(_union(links))
    ends = _union(by_pivot) if by_pivot else links[0].where("false")
    ends = written(ends.select(F.col("a").alias("rep")).union(ends.select("b")).distinct().withColumn("by_pivot", F.lit(True)), "ends")
    names = component.withColumnRenamed("id", "rep").join(first.select("rep", "doc"), "rep")
    least = written(names.groupBy("component").agg(F.min("doc").alias("component_id")), "least")
    known = written(component.join(least, "component").select(F.col("id").alias("rep"), "component_id"), "known")
    known = first.select("rep", "doc").join(known, "rep", "left").join(ends, "rep", "left")
    known = written(known.select("rep", F.coalesce("component_id", "doc").alias("component_id"), F.coalesce("by_pivot", F.lit(False)).alias("by_pivot")), "names")
    out = nodes.join(known, "rep").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "by_pivot")
    alone = sets.where("n = 0 or doc is null").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"), F.lit(False).alias("by_pivot"))
    return out.unionByName(alone)


def _with_partners(region: DataFrame, reps: DataFrame, percent: int, leaf: int) -> DataFrame:
    """The members of regions of up to `leaf` that sizes and sketches leave a partner there; larger regions as they are."""
    size = written(region.groupBy("cell").agg(F.count("*").alias("size")), "sizes-of")
    region = region.join(size, "cell")
    held = region.where(F.col("size") <= leaf).join(reps.select("rep", "sketch", "wide"), "rep").select("cell", "rep", "n", "sketch", "wide")

    def run(cell: pa.Table) -> pa.Table:
        n, sk, wide = cell["n"].to_numpy(), _sketch_rows(cell), cell["wide"].to_pylist()
        some = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            fits = np.flatnonzero(100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i])) + i + 1
            differ = np.bitwise_count(sk[fits] ^ sk[i]).sum(1, dtype=np.int64)
            fits = fits[(100 + percent) * differ <= (100 - percent) * (n[fits] + n[i])]
            if wide[i]:
                fits = fits[[(100 + percent) * differing_bits(wide[i], wide[j]) <= (100 - percent) * (n[j] + n[i]) for j in fits]]
            some[fits] = True
            some[i] |= len(fits) > 0
        return cell.select(["cell", "rep", "n"]).filter(pa.array(some))

    kept = held.groupBy("cell").applyInArrow(run, "cell long, rep long, n long")
    return kept.unionByName(region.where(F.col("size") > leaf).select("cell", "rep", "n"))


def _sketch_rows(table: pa.Table) -> np.ndarray:
    flat = table.combine_chunks()["sketch"].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().view(np.uint64).reshape(len(table), -1)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _state(cells: DataFrame, component: DataFrame) -> DataFrame:
    """Members of cells that hold several components: with their component and the cell's members, shingles and components."""
    now = written(cells.join(component.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "state")
    each = now.groupBy("cell", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    sides = each.groupBy("cell").agg(F.sum("m").alias("members"), F.sum("n").alias("shingles"), F.count("*").alias("components")).where("components > 1")
    return now.join(written(sides, "open"), "cell")


def _diagrams(cells: DataFrame, whole: DataFrame, links: list[DataFrame], percent: int, pivots: int, leaf: int) -> tuple[list[DataFrame], DataFrame, DataFrame | None, DataFrame | None]:
    """Split large cells until none is left: (links with those to pivots, components by them, cells for one task each, cells to be compared in blocks).

    A split counts if the cells that stay open have at most twice the members, and each has three quarters of the
    members or half of the components at most; so the recursion ends.
    """
    component, leaves, blocks = connected_components(_union(links)), [], []
    state = _state(cells, component)
    while True:
        is_leaf = (F.col("members") <= leaf) & (F.col("shingles") <= LEAF_SHINGLES)
        leaves.append(state.where(is_leaf).select("cell", "rep", "n"))
        big = written(state.where(~is_leaf), "big")
        if big.isEmpty():
            break
        split = _split(big, whole, percent, pivots)
        links.append(split.where("linked").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        component = connected_components(_union(links))
        inner = split.select(F.xxhash64("cell", "pivot").alias("cell"), F.col("cell").alias("parent"), "rep", "n")
        inner = written(_state(inner, component), "inner")
        per = inner.select("parent", "cell", "members", "components").distinct().groupBy("parent").agg(F.sum("members").alias("all"), F.max("members").alias("most"), F.max("components").alias("open"))
        was = big.select(F.col("cell").alias("parent"), F.col("members").alias("was"), F.col("components").alias("had")).distinct()
        per = written(per.join(was, "parent").select("parent", ((F.col("all") <= 2 * F.col("was")) & ((4 * F.col("most") <= 3 * F.col("was")) | (2 * F.col("open") <= F.col("had")))).alias("pays")), "pays")
        blocks.append(big.join(per.where("not pays"), big["cell"] == per["parent"], "left_semi").select("cell", "rep", "n"))
        state = inner.join(per.where("pays").select("parent"), "parent", "left_semi").drop("parent")
    return links, component, _union(leaves) if leaves else None, _union(blocks) if blocks else None


def _split(state: DataFrame, whole: DataFrame, percent: int, pivots: int) -> DataFrame:
    """cell, rep, n, pivot (-1: the outer cell), linked (rep and pivot link) for every cell that a member belongs or is replicated to; written.

    About 2 * pivots components of a cell, and its largest one, offer their member of lowest hash as pivots.
    """
    radius = 1 - percent / 100
    order = F.struct(F.xxhash64("rep").alias("h"), F.col("rep"))
    offers = state.groupBy("cell", "component").agg(F.count("*").alias("m"), F.min(order)["rep"].alias("rep"), F.first("members").alias("members"), F.first("shingles").alias("shingles"), F.first("components").alias("components"))
    offers = written(offers, "offers")
    largest = offers.groupBy("cell").agg(F.max(F.struct("m", "rep"))["rep"].alias("largest"))
    share = F.xxhash64(F.lit(11), "cell", "component").cast("double") / 2.0**64 + 0.5
    offers = offers.join(largest, "cell").where((F.col("rep") == F.col("largest")) | (share < 2.0 * pivots / F.col("components")))
    parts = F.ceil(F.greatest(F.col("members") / 1024, F.col("shingles") / 500_000)).cast("long")
    offers = offers.select("cell", "rep", F.xxhash64(F.lit(12), "rep").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).join(whole.select("rep", F.col("whole").alias("set")), "rep")
    members = state.select("cell", "rep", "n", F.pmod(F.xxhash64("rep", F.lit(5)), parts).alias("part")).join(whole, "rep")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = [np.frombuffer(w, np.uint64) for w in left["whole"].to_pylist()]
        offered = sorted(zip(right["h"].to_pylist(), right["rep"].to_pylist(), right["set"].to_pylist(), strict=True))
        chosen, at = [], []  # pivots further than 2 radii apart
        for _, rep, w in offered:
            w = np.frombuffer(w, np.uint64)
            if len(chosen) < pivots and all(_distance(w, p) > 2 * radius for p in at):
                chosen.append(rep)
                at.append(w)
        out = {c: [] for c in ("cell", "rep", "n", "pivot", "linked")}
        for cell, rep, n, x in zip(left["cell"].to_pylist(), left["rep"].to_pylist(), left["n"].to_pylist(), sets, strict=True):
            shared = np.array([_shared(x, p) for p in at])
            total = len(x) + np.array([len(p) for p in at]) - shared
            far = 1 - shared / total
            inside = (far <= far.min() + 2 * radius + 1e-9) & (far <= 1 - radius + 1e-9)
            rows = [(p, bool(100 * s >= percent * t)) for p, s, t, ok in zip(chosen, shared.tolist(), total.tolist(), inside, strict=True) if ok]
            if far.min() > 1 - 2 * radius - 1e-9:
                rows.append((-1, False))
            for p, linked in rows:
                for c, v in zip(out, (cell, rep, n, p, linked), strict=True):
                    out[c].append(v)
        return pa.table({c: pa.array(v, pa.bool_() if c == "linked" else pa.int64()) for c, v in out.items()})

    pairs = members.groupBy("cell", "part").cogroup(offers.groupBy("cell", "part"))
    return written(pairs.applyInArrow(run, "cell long, rep long, n long, pivot long, linked boolean"), "split")


def _distance(x: np.ndarray, y: np.ndarray) -> float:
    shared = _shared(x, y)
    return 1 - shared / (len(x) + len(y) - shared)


def _cell_links(state: DataFrame, whole: DataFrame, percent: int, pivots: int) -> DataFrame:
    """(a, b) links that tie different components of small cells, each cell solved by recurring diagrams in one task; written."""

    def run(cell: pa.Table) -> pa.Table:
        order = np.argsort(mix(cell["rep"].to_numpy().view(np.uint64)), kind="stable")
        rep, comp = cell["rep"].to_numpy()[order], cell["component"].to_numpy()[order]
        held = cell["whole"].to_pylist()
        found = recurring_diagrams([np.frombuffer(held[i], np.uint64) for i in order], comp, percent, pivots)
        return pa.table({c: pa.array([rep[f[i]] for f in found], pa.int64()) for i, c in enumerate("ab")})

    members = state.select("cell", "rep", "component").join(whole, "rep").select("cell", "rep", "component", "whole")
    return written(members.groupBy("cell").applyInArrow(run, "a long, b long"), "cell-links")


def recurring_diagrams(sets: list[np.ndarray], comp: np.ndarray, percent: int, pivots: int) -> list[tuple[int, int]]:
    """Links between ascending sets that tie all components whose members link, each by the distance of a member to a pivot.

    A cell's pivots are the first of its members, of different components, that lie further than 2 radii apart. Each has
    its distance to all sets, once, and leaves every cell; the others go to the cells of near pivots and to the outer
    cell. So there are at most as many diagrams as sets, however often members are replicated. A cell of one component
    is done.
    """
    radius = 1 - percent / 100
    names, roots = np.unique(comp, return_inverse=True)
    size = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(size)
    words, code = np.unique(np.concatenate(sets), return_inverse=True)
    tied, found, todo = LocalComponents(len(names)), [], [np.arange(len(sets))]
    left = np.ones(len(sets), bool)

    def distances(p: int) -> np.ndarray:
        held = np.zeros(len(words), np.int32)
        held[code[ends[p] - size[p] : ends[p]]] = 1
        shared = np.add.reduceat(held[code], ends - size).astype(np.int64)
        total = size + size[p] - shared
        for x in np.flatnonzero(100 * shared >= percent * total):
            if tied.root[roots[x]] != tied.root[roots[p]]:
                found.append((int(x), int(p)))
                tied.add(roots[x : x + 1], roots[p : p + 1])
        return 1 - shared / total

    while todo:
        cell = todo.pop()
        cell = cell[left[cell]]
        root = tied.root[roots[cell]]
        if len(cell) < 2 or (root == root[0]).all():
            continue
        chosen, far, seen = [], [], set()
        for i, c in zip(cell, root, strict=True):
            if c not in seen and all(x[i] > 2 * radius for x in far):
                chosen.append(i)
                far.append(distances(i))
                if len(chosen) >= min(pivots, 1 + len(cell) // 8):
                    break
            seen.add(c)
            if len(seen) > 2 * pivots:
                break
        left[chosen] = False
        rest = cell[left[cell]]
        if len(rest) > 1:
            away = np.stack([x[rest] for x in far], axis=1)
            nearest = away.min(1)
            inside = (away <= nearest[:, None] + 2 * radius + 1e-9) & (away <= 1 - radius + 1e-9)
            cells = [rest[inside[:, j]] for j in range(len(chosen))]
            todo += [c for c in (*cells, rest[nearest > 1 - 2 * radius - 1e-9]) if len(c) > 1]
    return found


def _block_links(state: DataFrame, reps: DataFrame, whole: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b) links that tie different components of a cell, written.

    A cell is dealt to blocks of about `block` members; each pair of blocks is one group of work. Bits in which two
    sketches differ are a metric that never exceeds the sets' difference, so within a pair of blocks only members whose
    distances to the first member lie in one triangle window are looked at. Pairs that sizes and sketches leave are
    verified on whole sets unless links found before have tied their components; one link a merger comes out.
    """
    parts = F.ceil(F.greatest(F.col("members") / block, F.col("shingles") / 500_000)).cast("int")
    m = state.select("cell", "rep", "component", parts.alias("parts"), F.pmod(F.xxhash64("rep", F.lit(5)), parts).cast("int").alias("own"))
    m = written(m.join(reps.select("rep", "n", "sketch"), "rep").join(whole, "rep"), "blocks")
    left = m.withColumn("b1", F.col("own")).withColumn("b2", F.explode(F.sequence("own", F.col("parts") - 1)))
    right = m.where("own > 0").select(*(F.col(c).alias(c) for c in m.columns)).withColumn("b2", F.col("own")).withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))

    def arrays(x: pa.Table) -> tuple[np.ndarray, ...]:
        return (*(x[c].to_numpy() for c in ("rep", "n", "component")), _sketch_rows(x), [np.frombuffer(w, np.uint64) for w in x["whole"].to_pylist()])

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        found = []
        if len(one):
            rep, n, comp, sk, sets = arrays(one)
            same = one["b1"][0] == one["b2"][0]
            rep2, n2, comp2, sk2, sets2 = (rep, n, comp, sk, sets) if same else arrays(two) if len(two) else (None,) * 5
            if rep2 is not None:
                found = _tie(rep, n, comp, sk, sets, rep2, n2, comp2, sk2, sets2, same, percent)
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate("ab")})

    work = left.groupBy("cell", "b1", "b2").cogroup(right.groupBy("cell", "b1", "b2"))
    return written(work.applyInArrow(run, "a long, b long"), "block-links")


def _tie(rep, n, comp, sk, sets, rep2, n2, comp2, sk2, sets2, same: bool, percent: int) -> list[tuple]:
    """Links between two blocks (or within one) that tie components not tied before."""
    names, roots = np.unique(np.concatenate([comp, comp2]), return_inverse=True)
    r, r2, tied = roots[: len(comp)], roots[len(comp) :], LocalComponents(len(names))
    to = np.bitwise_count(sk2 ^ sk[0]).sum(1, dtype=np.int64)  # distances to the first member
    own = np.bitwise_count(sk ^ sk[0]).sum(1, dtype=np.int64)
    order = np.argsort(to, kind="stable")
    to = to[order]
    # 100 (S - D) >= percent (S + D) for sizes that sum to S and D differing shingles
    reach = (100 - percent) * (n + n * 100 // percent + 1) // (100 + percent)
    lo, hi = np.searchsorted(to, own - reach, "left"), np.searchsorted(to, own + reach, "right")
    found = []
    for j in range(len(rep)):
        at = order[lo[j] : hi[j]]
        at = at[(tied.root[r2[at]] != tied.root[r[j]]) & (100 * np.minimum(n2[at], n[j]) >= percent * np.maximum(n2[at], n[j]))]
        if same:
            at = at[at > j]
        differ = np.bitwise_count(sk2[at] ^ sk[j]).sum(1, dtype=np.int64)
        for x in at[(100 + percent) * differ <= (100 - percent) * (n2[at] + n[j])]:
            if tied.root[r2[x]] != tied.root[r[j]]:
                shared = _shared(sets[j], sets2[x])
                if 100 * shared >= percent * (n[j] + n2[x] - shared):
                    found.append((rep[j], rep2[x]))
                    tied.add(r[j : j + 1], r2[x : x + 1])
    return found


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the smallest id of each component; rows without an id stay."""
    found = jaccard_components(docs, k, percent, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(f"{OWN}id")).distinct()
    return docs.join(found, F.col(id_col) == F.col(f"{OWN}id"), "left_anti")


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r(id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(c) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.id = w.doc_id GROUP BY 1, 2
"""
