"""SimHash near-duplicates through an anchor-point cover of the fingerprints."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_columns

BITS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 1 << 16


def simhash(text: bytes | None, words: int, seed: int = 42) -> int:
    """The fingerprint of one text: bit b is set where over half of the shingle hashes have it set."""
    parts = (text or b"").translate(_LOWER).split()  # bytes split at exactly the six ASCII white space characters
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()) if pa.types.is_large_string(batch.column(1).type) else batch.column(1).cast(pa.binary())
            prints = np.fromiter((simhash(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def anchor_masks(radius: int) -> list[list[int]]:
    """For each syndrome, the changes that lead from a word to the anchors within `radius`.

    Anchors are the words whose low 63 bits are in the perfect Hamming code of length 63 (bit i, counted from 1, has
    column i), any top bit: a covering code of radius 1 with 2**58 members. Changes of up to `radius` bits whose columns
    cancel the syndrome lead to an anchor.
    """
    from itertools import combinations

    found: list[list[int]] = [[] for _ in range(64)]
    for n in range(radius + 1):
        for bits in combinations(range(BITS), n):
            syndrome, mask = 0, 0
            for b in bits:
                syndrome ^= (b + 1) % 64  # the top bit has column 0
                mask |= 1 << b
            found[syndrome].append(signed(mask))
    return found


def anchors(fp: Column, distance: int) -> Column:
    """The anchors of a fingerprint: within covering radius (1) plus half the distance, rounded up.

    Two fingerprints within the distance have a midpoint within half of it of both; the midpoint has an anchor within 1,
    which is an anchor of both. So a replica on either side of that half reaches, and pairs meet at a shared anchor.
    """
    columns = [sum(1 << b for b in range(BITS) if ((b + 1) % 64) >> k & 1) for k in range(6)]
    syndrome = sum((F.bit_count(fp.bitwiseAND(F.lit(signed(m)).cast("long"))) % 2) * (1 << k) for k, m in enumerate(columns))
    masks = anchor_masks(1 + (distance + 1) // 2)
    table = F.from_json(F.lit(json.dumps(masks)), "array<array<bigint>>")  # one constant, folded when planned
    return F.transform(F.get(table, syndrome.cast("int")), lambda m: fp.bitwiseXOR(m))


def spanning_links(group: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the components of a group's fingerprints within the distance; at most one a fingerprint."""
    words, links = group.view(np.uint64), []
    waiting = np.arange(len(words))
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(words[waiting] ^ words[at]) <= distance
            for other in waiting[near]:
                links.append((int(group[at]), int(group[other])))
                front.append(other)
            waiting = waiting[~near]
    return links


def near_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span their components within the distance.

    Each distinct fingerprint is replicated to its anchors (33 for distance 2), and each anchor's group is compared. A
    group holds at most the fingerprints within the replication radius of one anchor (2,081 for distance 2), however many documents
    there are, and gives one link a fingerprint, never all pairs.
    """
    placed = prints.select("fp", F.explode(anchors(F.col("fp"), distance)).alias("anchor"))
    groups = placed.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [link for g in batch.column(0) for link in spanning_links(g.values.to_numpy(zero_copy_only=False).astype(np.int64), distance)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component; nodes without links are absent.

    Large-star and small-star rounds in turn: each hangs neighbours on the smallest one nearby, with minima taken by partial
    aggregation, until nothing changes. Rounds are checkpointed and grow with the logarithm of the longest path.
    """
    links = cut(links.where("a <> b"))

    def star(edges: DataFrame, keep: Column) -> DataFrame:
        """Hangs each node's neighbours that `keep` names, and the node, on the least of them all."""
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
        hung = edges.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("least").alias("b"))
        return hung.where("a <> b")

    state = None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        large = star(both, F.col("v") > F.col("u")).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("least"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b")).where("a <> b").union(least.select("u", "least"))
        links = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
        state = now


def grouped(docs: DataFrame, words: int, distance: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, __fp, __component) of every row. Equal fingerprints are one before any comparison, so copies cost nothing."""
    kind = dict(docs.dtypes)[id_col]
    prints = cut(fingerprints(docs, words, id_col, text_col).select(F.col("id").cast(kind).alias("id"), "fp"))
    firsts = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    found = components(near_links(firsts.select("fp"), distance))
    member = firsts.join(found, firsts["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first").alias("component"))
    labels = member.join(smallest, "root").select(F.col("fp").alias("__fp"), F.col("component").alias("__component"))
    return prints.join(labels, prints["fp"] == F.col("__fp")).select(F.col("id").alias("__id"), "__fp", "__component")


def label_documents(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SimHash fingerprints of whole texts and the components of those within `distance` bits.

    Returns a row per input row: id_col, fingerprint (16 hex digits), component_id (the smallest id reachable, itself
    included). Null, empty and wordless texts have fingerprint zero and link like others. Null ids take part and get
    their component's smallest id, null if it has none. Repeated rows link to each other. Other columns are ignored. An empty
    table gives an empty table.
    """
    rows = grouped(docs, words, distance, id_col, text_col)
    return rows.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))


def first_of_each_group(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: a row of the smallest id in it, null ids last.

    Rows are told apart by id and text, so null and repeated ids stand for as many documents as they have texts: each component
    keeps its own row, whatever other components share the id.
    """
    kind = dict(docs.dtypes)[id_col]
    keyed = docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")).alias("row"), F.col(text_col).alias("text"))
    prints = cut(fingerprints(keyed, words, "row", "text").select(F.col("id.i").cast(kind).alias("id"), F.col("id.h").alias("h"), "fp"))
    # an order without nulls first: (id is null, id, hash of the text)
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h")).alias("least"))
    found = components(near_links(least := cut(least), distance))
    return rows_of_least(docs, least, found, "fp", id_col, text_col)


def rows_of_least(docs: DataFrame, least: DataFrame, found: DataFrame, node: str, id_col: str, text_col: str) -> DataFrame:
    """The docs that are the least (n, id, h) of the nodes of a component; nodes missing from found are their own."""
    member = least.join(found.withColumnRenamed("node", node), node, "left").select("least", F.coalesce("root", node).alias("root"))
    keep = member.groupBy("root").agg(F.min("least").alias("l")).select(F.coalesce(F.col("l.id").cast("string"), F.lit("")).alias("__k"), F.col("l.n").alias("__n"), F.col("l.h").alias("__h"))
    # keys without nulls, so that the join and the last step share one partitioning and texts are shuffled once
    key = {"__k": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "__n": F.col(id_col).isNull(), "__h": F.xxhash64(text_col)}
    joined = with_columns(docs, [], **key).join(keep, [*key]).dropDuplicates([*key])
    return with_columns(joined, [*key])
