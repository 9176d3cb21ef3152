"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.llm.bitmaps import bitmap, cell_count, cells, probe
from uttermark.llm.common import attach, staged, text_of
from uttermark.llm.components import components

BITS = 64
SEED = 42  # fixed value of the contract


def fingerprint(raw: bytes, shingle: int = 4) -> int:
    """Of a UTF-8 text: a bit is 1 if it is set in over half the hashes of its shingles, repeats included."""
    words = raw.lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    count = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, count)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(low: int, high: int, flips: int) -> np.ndarray:
    """All words with ``flips`` of the bits low..high-1 set."""
    return np.array([sum(1 << b for b in some) for some in combinations(range(low, high), flips)], np.uint64)


def prefix_bits(distinct: int, per_group: int = 64) -> int:
    """Leading bits by which variants are dealt out, so that few fingerprints share a prefix at any scale."""
    return int(min(24, max(6, (max(distinct, 1) // per_group).bit_length())))


def prefix_variants(fps: DataFrame, bits: int, half: int) -> DataFrame:
    """(prefix, spent, fps): the leading bits of all variants of each fingerprint, with the flips they took.

    One row for each prefix and Arrow batch; ``fps`` holds the fingerprints as packed 64-bit words.
    """
    shift = BITS - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [masks(shift, BITS, n) for n in range(half + 1)]
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for spent, some in enumerate(flips):
                for at in range(0, len(some), 64):  # a bounded number of variants at once
                    part = some[at : at + 64]
                    heads = ((own[:, None] ^ part[None, :]) >> np.uint64(shift)).ravel()
                    order = np.argsort(heads, kind="stable")
                    heads, packed = heads[order], np.repeat(own, len(part))[order]
                    starts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]]) if len(heads) else np.zeros(0, np.int64)
                    ends = np.r_[starts[1:], len(heads)] if len(heads) else starts
                    blobs = pa.array([packed[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
                    columns = [pa.array(heads[starts].astype(np.int64)), pa.array(np.full(len(starts), spent, np.int32)), blobs]
                    yield pa.RecordBatch.from_arrays(columns, ["prefix", "spent", "fps"])

    return fps.select("fp").mapInArrow(run, "prefix long, spent int, fps binary")


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of n nodes under the links a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return label


def meet(parts: list[np.ndarray], bits: int, prefix: int, radius: int, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint of its class) among those with a variant of this prefix in common.

    ``parts[d]``: the fingerprints that reach the prefix with d flips; the flips left are spent on the other
    bits here.  Where more than ``most`` variants would be held, they are made in slices of their next bits.
    """
    half = len(parts) - 1
    nodes, where = np.unique(np.concatenate(parts), return_inverse=True)
    owners = np.split(where, np.cumsum([len(p) for p in parts])[:-1])
    shift = BITS - bits
    tails = [np.concatenate([masks(0, shift, n) for n in range(half - d + 1)]) for d in range(half + 1)]
    held = sum(len(p) * len(t) for p, t in zip(parts, tails))
    extra = min(max(0, (held // most).bit_length()), 12)
    low = np.uint64((1 << shift) - 1)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for piece in range(1 << extra):
        values, whose = [], []
        for own, index, tail in zip(parts, owners, tails):
            step = max(1, most // len(tail))
            for at in range(0, len(own), step):
                made = ((own[at : at + step, None] & low) ^ tail[None, :]).ravel()
                held_by = np.repeat(index[at : at + step], len(tail))
                if extra:
                    right = (made >> np.uint64(shift - extra)) == piece
                    made, held_by = made[right], held_by[right]
                values.append(made)
                whose.append(held_by)
        made, held_by = np.concatenate(values), np.concatenate(whose)
        del values, whose
        ordered = np.sort(made)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(again):
            continue
        flag = np.zeros(1 << 16, bool)
        flag[(again & np.uint64(0xFFFF)).astype(np.int64)] = True
        some = flag[(made & np.uint64(0xFFFF)).astype(np.int64)]
        made, held_by = made[some], held_by[some]
        order = np.lexsort((held_by, made))
        made, held_by = made[order], held_by[order]
        first = np.maximum.accumulate(np.where(np.r_[True, made[1:] != made[:-1]], np.arange(len(made)), 0))
        a, b = held_by[first], held_by
        pair = np.unique((a * len(nodes) + b)[a != b])
        a, b = pair // len(nodes), pair % len(nodes)
        near = np.bitwise_count(nodes[a] ^ nodes[b]) <= radius
        links.append((a[near], b[near]))
    if not links:
        return nodes[:0], nodes[:0]
    label = _least_labels(len(nodes), np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def near_links(fps: DataFrame, bits: int, radius: int = 4) -> DataFrame:
    """(u, v): enough links to connect all fingerprints with ``radius`` or fewer differing bits, and no others.

    Two such fingerprints have a variant in common that either reaches with half the flips.  Variants are
    shuffled by their leading bits; their other bits are flipped after the shuffle, so that 1 + k + k(k-1)/2
    short entries travel instead of 2,081.  Those that share a variant are linked in a chain to the smallest,
    and each link is verified by its differing bits.
    """
    half = radius // 2

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(half + 1)]
        for batch in batches:
            for spent, blob in zip(batch.column("spent").to_pylist(), batch.column("fps").to_pylist()):
                parts[spent].append(np.frombuffer(blob, np.uint64))
        joined = [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]
        u, v = meet(joined, bits, key[0].as_py(), radius)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return prefix_variants(fps, bits, half).groupBy("prefix").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Texts are compared with A-Z in lower case by their ``shingle``-word runs; fewer words are one run, none
    give the fingerprint zero, which links like any other; null texts are empty ones.  ``component_id`` is
    the smallest ``doc_id`` that links of ``radius`` or fewer bits (an even number) can reach, its own
    included.  Null ids get their class, whose id they do not lower; a class of null ids alone has a null
    one.  Equal fingerprints are one node, so that copies cost nothing beyond their count.  An empty table
    gives an empty result.
    """
    rows = staged(with_fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    links = staged(near_links(nodes, prefix_bits(nodes.count()), radius), "near-links")
    roots = staged(components(links), "near-classes")
    total = rows.count()
    members = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "first_id")
    least = members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("uses"))
    linked = attach(members.select("fp", "root"), least, "root", "uses", total).select("fp", "component_id")
    table = nodes.join(linked.withColumnRenamed("component_id", "other"), "fp", "left")
    table = staged(table.select("fp", F.coalesce("other", "first_id").alias("component_id"), "n"), "fingerprint-classes")
    done = attach(rows, table, "fp", "n", total)
    return done.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of their class, all columns kept.

    A filter of the dropped ids clears most rows, whose texts are not shuffled; the others meet the ids themselves.
    Rows with a null id stay, since no id says which of them to drop.  If one id bears several texts, a row
    goes with the id if it is dropped in any of its classes.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    lost = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_lost")).distinct()
    lost = staged(lost, "near-copies")
    n_cells = cell_count(lost.count())
    bits = staged(bitmap(lost.select(F.explode(F.array(*cells(F.col("_lost"), n_cells, 2))).alias("cell")), "cell"), "near-copy-cells")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    wide = docs.select(*[F.col(f"`{name}`").alias(own) for name, own in zip(docs.columns, names)], F.col(f"`{id_col}`").alias("_id"))
    wide = probe(wide, bits, F.col("_id"), n_cells, 2, "_maybe")
    again = wide.where("_maybe")
    again = again.join(lost, again["_id"] == lost["_lost"], "left_anti")
    rows = wide.where("not _maybe").select(*names).unionByName(again.select(*names))
    return rows.toDF(*docs.columns)
