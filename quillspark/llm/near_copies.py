"""Near copies by Jaccard similarity of word shingles: SimHash fingerprints over an anchor cover and MinHash bands propose candidates, exact shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keeps_names, stored
from .simhash import BITS, components, near_links, rows_of_least
from .word_hashes import mixed, run_hashes, word_blocks

#: Bands and rows of the MinHash signature. A pair of similarity 0.8 shares a band with probability 0.99996.
BANDS, ROWS = 25, 5
_ODD = np.random.default_rng(42).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_BLOCK = 1 << 16
#: What a block of a bucket holds at most, by expectation: members, and bytes of their sets.
BLOCK_MEMBERS, BLOCK_BYTES = 256, 1 << 24


def shingle_blocks(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes, bounds) of blocks of texts: text k of a block has the sorted distinct shingle hashes bounds[k] to bounds[k + 1]. A text of fewer words is one shingle, a text without words has none."""
    for at, h, bounds in word_blocks(column, lower=True):
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        first = np.flatnonzero(text[: max(0, len(h) - words + 1)] == text[words - 1 :])
        values = run_hashes(h, first, words)
        for size in range(1, words):
            short = bounds[:-1][np.diff(bounds) == size]
            if len(short):
                first, values = np.concatenate((first, short)), np.concatenate((values, run_hashes(h, short, size)))
                order = np.argsort(first, kind="stable")
                first, values = first[order], values[order]
        edges = np.searchsorted(first, bounds)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            values[a:b].sort()
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        new[edges[:-1][edges[:-1] < len(values)]] = True
        yield at, values[new], np.concatenate((np.zeros(1, np.int64), np.cumsum(new)))[edges]


def bands(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The band hashes of each set that isn't empty, a row a set."""
    filled = np.flatnonzero(np.diff(bounds) > 0)
    folded = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    least = np.full((BANDS * ROWS, len(filled)), np.iinfo(np.uint32).max, np.uint32)
    k = 0
    while k < len(filled):  # some sets at a time, so that arrays stay in the cache; a larger set is one by itself
        to = max(k + 1, int(np.searchsorted(bounds[filled + 1], bounds[filled[k]] + _BLOCK, "right")))
        begin = bounds[filled[k]]
        own, starts = folded[begin : bounds[filled[to - 1] + 1]], bounds[filled[k:to]] - begin
        for p, odd in enumerate(_ODD):
            x = own * odd
            x ^= x >> np.uint32(15)  # low bits of a product depend on low bits only
            x *= np.uint32(0x2C1B3C6D)
            least[p, k:to] = np.minimum.reduceat(x, starts)
        k = to
    rows = least.reshape(BANDS, ROWS, len(filled)).astype(np.uint64)
    out = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(filled), axis=1)
    for r in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, r] + np.uint64(1))
    return out.T.copy().view(np.int64)


def prints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of each set: a bit is set where over half of the members have it set; zero for none."""
    out = np.zeros(len(bounds) - 1, np.int64)
    k = 0
    while k < len(out):  # some sets at a time, so that bits stay few; of a larger set by itself they are summed in parts
        to = max(k + 1, int(np.searchsorted(bounds, bounds[k] + _BLOCK, "right")) - 1)
        ones = np.zeros((to - k, BITS), np.int64)
        of = np.repeat(np.arange(to - k), np.diff(bounds[k : to + 1]))
        own = values[bounds[k] : bounds[to]]
        for at in range(0, len(own), _BLOCK):
            here = of[at : at + _BLOCK]
            first = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
            bits = np.unpackbits(np.ascontiguousarray(own[at : at + _BLOCK]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[here[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        most = ones * 2 > np.diff(bounds[k : to + 1])[:, None]
        out[k:to] = np.packbits(most, axis=1, bitorder="little").view(np.int64)[:, 0]
        k = to
    return out


def shingle_rows(docs: DataFrame, words: int, sets: bool) -> DataFrame:
    """(id, h, node, size, fp) of docs (id, h, text), with the band hashes or, if asked for, the shingle sets themselves; node is a hash of the set, fp its fingerprint (zero with sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values, bounds in shingle_blocks(batch.column(2), words):
                sizes = np.diff(bounds)
                # sums of mixed members, so that a set's hash does not depend on an order
                totals = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values + np.uint64(7)), dtype=np.uint64)))
                nodes = mixed((totals[bounds[1:]] - totals[bounds[:-1]]) ^ sizes.astype(np.uint64)).view(np.int64)
                if sets:
                    last = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.ascontiguousarray(bounds * 8)), pa.py_buffer(values)])
                else:
                    flat = bands(values, bounds)
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), batch.column(1).slice(at, len(sizes)), pa.array(nodes), pa.array(sizes), pa.array(np.zeros(len(sizes), np.int64) if sets else prints(values, bounds)), last.cast(pa.binary()) if sets else last], names=["id", "h", "node", "size", "fp", "last"])

    rows = docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, h long, node long, size long, fp long, last {'binary' if sets else 'array<long>'}")
    return rows.withColumnRenamed("last", "own" if sets else "bands")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose exact Jaccard similarity is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda n: sets.select(F.col("node").alias(n), F.col("own").alias(f"{n}_own"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_own", "b_own").mapInArrow(run, "a long, b long")


def block_links(owns: list[np.ndarray], roots: np.ndarray, left: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (by place) between similar members of different roots, of which one is in the left block and the other isn't (or all are): enough to span them."""
    sizes = np.array([len(x) for x in owns])
    words, of = np.unique(np.concatenate(owns), return_inverse=True)
    who = np.repeat(np.arange(len(owns)), sizes)
    often = np.bincount(of, minlength=len(words))[of] > 1  # what one member alone holds is shared with none
    column = np.unique(of[often], return_inverse=True)[1]
    both = np.zeros((len(owns), len(owns)), np.float32)
    columns = int(column.max(initial=-1)) + 1
    for at in range(0, columns, 1 << 12):
        here = (column >= at) & (column < at + (1 << 12))
        grid = np.zeros((len(owns), min(1 << 12, columns - at)), np.float32)
        grid[who[often][here], column[here] - at] = 1
        both += grid @ grid.T
    near = (both >= similarity * (sizes[:, None] + sizes[None, :] - both)) & (roots[:, None] != roots[None, :])
    if not left.all():
        near &= left[:, None] != left[None, :]
    links, label = [], {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while label[r] != r:
            label[r] = r = label[label[r]]
        return r

    for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(near))), strict=True):
        x, y = find(int(roots[a])), find(int(roots[b]))
        if x != y:
            label[y] = x
            links.append((a, b))
    return links


def rest_links(member: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between components (roots) of members (band, node, size, root) that share a band and are similar.

    Each bucket is cut into blocks of bounded members and bytes, which are compared two by two in tasks of their own. The members
    of a bucket's largest component are compared with the others only.
    """
    of_root = member.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    total = of_root.groupBy("band").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "root", "s")).alias("most"))
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK_MEMBERS), F.ceil(s * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    # a bucket in which nearly all are apart has no such component: its largest has one or two members
    cuts = total.select("band", F.col("most.root").alias("bulk"), blocks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("loose"), blocks(F.col("most.n"), F.col("most.s")).alias("bulks"))
    placed = member.join(cuts, "band").withColumn("in_bulk", F.col("root") == F.col("bulk"))
    own_block = F.pmod(F.xxhash64("node"), F.when(F.col("in_bulk"), F.col("bulks")).otherwise(F.col("loose"))).cast("int")
    at = F.when(F.col("in_bulk"), F.col("loose") + own_block).otherwise(own_block)
    others = F.when(F.col("in_bulk"), F.sequence(F.lit(0), F.col("loose") - 1)).otherwise(F.sequence(F.lit(0), F.col("loose") + F.col("bulks") - 1))
    dealt = placed.withColumn("at", at).select("band", "node", "root", "at", F.explode(others).alias("other"))
    dealt = dealt.select("band", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "node", "root", "at").join(sets.select("node", "own"), "node")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        owns = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("own")]
        roots, left = group.column("root").to_numpy(), group.column("at").to_numpy() == key[1].as_py()
        links = block_links(owns, roots, left, similarity) if len(set(roots.tolist())) > 1 else []
        return pa.table({"a": pa.array([int(roots[a]) for a, _ in links], pa.int64()), "b": pa.array([int(roots[b]) for _, b in links], pa.int64())})

    return dealt.groupBy("band", "i", "j").applyInArrow(run, "a long, b long").distinct()


def labels(links: DataFrame) -> DataFrame:
    return components(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def print_pairs(nodes: DataFrame, similarity: float, distance: int = 2) -> DataFrame:
    """(a, b) of nodes (node, size, fp) whose fingerprints are within `distance` bits by op3's anchor cover: equal fingerprints with their head, heads along the links that span the others."""
    some = nodes.where("size > 0")
    heads = stored(some.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("head"), F.count("*").alias("n")))
    equal = some.join(heads.where("n > 1"), "fp").select("head", F.struct("node", "size").alias("other"))
    side = lambda n: heads.select(F.col("fp").alias(n), F.col("head").alias(f"{n}_head"))
    linked = near_links(heads.select("fp"), distance).join(side("a"), "a").join(side("b"), "b").select(F.col("a_head").alias("head"), F.col("b_head").alias("other"))
    near = F.least("head.size", "other.size") >= F.lit(similarity) * F.greatest("head.size", "other.size")
    return equal.unionByName(linked).where((F.col("head.node") != F.col("other.node")) & near).select(F.least("head.node", "other.node").alias("a"), F.greatest("head.node", "other.node").alias("b"))


def similar_components(nodes: DataFrame, sets_of, similarity: float) -> DataFrame:
    """(node, root) of the components of all pairs that share a band, or that fingerprints link, and are similar; nodes without links are absent.

    nodes: node, size, fp, bands; sets_of(nodes) gives (node, own). First what the fingerprints link is compared, and every member of a bucket is compared with the bucket's head,
    which makes one component of most groups of copies. Buckets that hold several components then are compared whole, in
    blocks, so no pair that could join two components is left out.
    """
    placed = nodes.select("node", "size", F.explode("bands").alias("band"))
    heads = placed.groupBy("band").agg(F.min(F.struct("node", "size")).alias("head"), F.count("*").alias("n")).where("n > 1")
    member = stored(placed.join(heads, "band"))
    # sizes that differ too much rule out similarity without a look at the sets
    near = F.least("size", "head.size") >= F.lit(similarity) * F.greatest("size", "head.size")
    pairs = stored(member.where((F.col("node") != F.col("head.node")) & near).select(F.col("head.node").alias("a"), F.col("node").alias("b")).union(print_pairs(nodes, similarity)).distinct())
    links = stored(similar(pairs, sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), similarity))
    found = cut(labels(links))
    rooted = member.where("n > 2").select("band", "node", "size").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    rest = stored(rooted.join(several, "band"))
    joined = labels(stored(rest_links(rest, sets_of(rest.select("node").distinct()), similarity)))
    # roots of roots: those of the second step, and roots that only the second step met
    upper = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    first = found.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return first.unionByName(joined.join(found.select("node"), "node", "left_anti"))


@keeps_names
def first_of_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: a row of the smallest id in it, null ids last.

    Texts are sets of hashed `words`-word shingles (A-Z lower-cased, ASCII white space). Two are near copies if their exact Jaccard
    similarity is at least `similarity`; groups are the components of such pairs. Candidates come from SimHash fingerprints
    within 2 bits, through the anchor cover of op3, and, as these reach few pairs of similarity 0.8, from MinHash bands, which find a pair of similarity 0.8 with probability 0.99996 and more similar ones more surely. Texts without words are copies of
    each other. Rows are told apart by id and text, so null and repeated ids stand for as many documents as they have texts.
    An empty table gives an empty table.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    rows = stored(shingle_rows(texts, words, sets=False).withColumn("id", F.col("id").cast(kind)))
    # copies have one set, so one row of each is enough
    least = stored(rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h")).alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The sets of some nodes, from the texts of their first documents."""
        wanted = stored(nodes.join(least.select("node", F.col("least.id").alias("i"), F.col("least.h").alias("k")), "node").select("i", "k"))
        chosen = texts.join(wanted, texts["id"].eqNullSafe(F.col("i")) & (texts["h"] == F.col("k")), "left_semi")
        return stored(shingle_rows(chosen, words, sets=True).dropDuplicates(["node"]).select("node", "own"))

    found = similar_components(least.select("node", "size", "fp", "bands"), sets_of, similarity)
    return rows_of_least(docs, cut(least.select("node", "least")), found, "node", id_col, text_col)
