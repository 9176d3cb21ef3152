"""Exact deduplication: two-pass Bloom filtering, then grouping of the possibly repeated rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.llm.bitmaps import bitmap, cell_count, cells, probe
from uttermark.llm.common import ascii_lower, attach, staged, text_of
from uttermark.operators.staging import new_path

PROBES = 2


class Repeats:
    """What the two passes found: the rows that may be repeated and the groups of equal texts.

    Equality is that of SHA-256 digests of the text, A-Z in lower case, null as empty.  The corpus is read
    once, for its digests.  Pass one counts the cells of digests and keeps those met twice as a filter; pass
    two lets rows through whose cells are not all in it.  Only the others are grouped.

    A filter has ``per_row`` cells for each row and at most ``most_cells``.  Where the rows need more, the
    hash space is cut into slices with a filter of their own, one after the other, so that no filter fills up
    at any size.  Digests are stored in the order of the hash within each task, without a shuffle: a slice
    reads its own pages of the files.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_row: int = 16, most_cells: int = 2**30):
        self.id_col, self.text_col, self.per_row, self.most_cells = id_col, text_col, per_row, most_cells
        digests = docs.select(F.col(id_col).alias("doc_id"), self.digest().alias("sha"))
        placed = digests.withColumn("place", F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long"))
        self.keys = staged(placed.sortWithinPartitions("place"), "digests")
        self.rows = self.keys.count()
        self.slices = max(1, -(-self.rows * per_row // most_cells))
        self.tested = self._tested()
        self.pairs = staged(self.suspects().groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n")), "suspects")
        groups = self.pairs.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("n"))
        self.groups = staged(groups, "equal-texts")

    def digest(self):
        return F.unhex(F.sha2(ascii_lower(text_of(self.text_col)), 256))

    def _tested(self) -> DataFrame:
        """(doc_id, sha, maybe) for all rows, each slice of the hash space by its own filter."""
        spark, path = self.keys.sparkSession, new_path(self.keys.sparkSession, "tested-digests")
        n_cells = cell_count(-(-self.rows // self.slices), self.per_row, self.most_cells)
        for i in range(self.slices):
            least, end = (2**32 * k // self.slices for k in (i, i + 1))
            part = self.keys.where((F.col("place") >= least) & (F.col("place") < end))
            again = _met_twice(part, F.col("sha"), n_cells)
            tested = probe(part, staged(bitmap(again, "cell"), "repeated-cells"), F.col("sha"), n_cells, PROBES, "maybe")
            tested.select("doc_id", "sha", "maybe").write.partitionBy("maybe").parquet(f"{path}/slice={i}")
        schema = self.keys.select("doc_id", "sha", F.lit(0).alias("slice"), F.lit(True).alias("maybe")).schema
        return spark.read.schema(schema).parquet(path).drop("slice") if self.rows else spark.createDataFrame([], schema).drop("slice")

    def suspects(self) -> DataFrame:
        return self.tested.where("maybe").select("doc_id", "sha")

    def decisions(self) -> DataFrame:
        """(doc_id, sha, keep_id, group_size): one row per row of the input."""
        alone = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")]
        straight = self.tested.where("not maybe").select("doc_id", "sha", *alone)
        # A false alarm of the filter is a group of one.
        sizes = self.groups.select("sha", "keep_id", F.col("n").alias("group_size"), "n")
        return straight.unionByName(attach(self.suspects(), sizes, "sha", "n", self.rows))

    def surplus(self) -> DataFrame:
        """(sha, doc_id, lost): the pairs of digest and id of which a row or more must go, and whether all must."""
        sizes = self.groups.where("n > 1").select("sha", "keep_id", "n")
        pairs = attach(self.pairs.withColumnRenamed("n", "same"), sizes, "sha", "n", self.rows)
        lost = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return pairs.select("sha", "doc_id", lost.alias("lost"), "same").where("lost or same > 1").drop("same")


def _met_twice(frame: DataFrame, key, n_cells: int) -> DataFrame:
    """The cells that two rows or more fall into."""
    met = frame.select(F.explode(F.array_distinct(F.array(*cells(key, n_cells, PROBES)))).alias("cell"))
    return met.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest ``doc_id`` stays.  Null texts count as empty and are a group of
    their own with the empty ones.  A null ``doc_id`` is smaller than any other; in a group of such rows
    alone ``keep_id`` is null and all are kept, since nothing tells them apart.  Rows that repeat both id and
    text are one document: each of them bears the same decision.  Other columns are not read.  An empty
    table gives an empty result.
    """
    found = Repeats(docs, **options)
    return found.decisions().select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    Whole rows are tested against a filter of the pairs of digest and id that must go.  Those it clears never
    shuffle, the rows that stay of repeated texts included; the others meet the list of these pairs by digest
    and id, so that the copies of one text spread over all tasks.  Rows that repeat both id and text come out once.
    """
    found = Repeats(docs, id_col, text_col, **options)
    fields = [F.col(f"`{name}`").alias(f"_c{i}") for i, name in enumerate(docs.columns)]
    surplus = staged(found.surplus(), "surplus-texts")
    n_cells = cell_count(surplus.count(), found.per_row, found.most_cells)
    one = F.explode(F.array(*cells(F.struct("sha", "doc_id"), n_cells, PROBES))).alias("cell")
    bits = staged(bitmap(surplus.select(one), "cell"), "surplus-cells")
    wide = docs.select(*fields, F.col(id_col).alias("_id"), found.digest().alias("sha"))
    wide = probe(wide, bits, F.struct("sha", F.col("_id").alias("doc_id")), n_cells, PROBES, "_maybe")
    lost = surplus.where("lost").select(F.col("sha").alias("_lost_sha"), F.col("doc_id").alias("_lost_id"))
    again = wide.where("_maybe")
    again = again.join(lost, (again["sha"] == lost["_lost_sha"]) & again["_id"].eqNullSafe(lost["_lost_id"]), "left_anti")
    rows = wide.where("not _maybe").unionByName(again.dropDuplicates(["sha", "_id"]))
    return rows.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(docs.columns)])
