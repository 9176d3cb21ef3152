"""Secret scans: a trigram inverted index names the candidates of each rule, its regex verifies them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.llm.bitmaps import bitmap, cell_count, cells, probe
from uttermark.llm.common import staged, text_of
from uttermark.llm.trigrams import trigram_query

PROBES = 2


@dataclass(frozen=True)
class Rule:
    """``pattern`` as Java and Python both read it; a match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(words: str) -> str:
    """Letters of a pattern without escapes in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# Fixed values of the contract: the base kinds.  A run of 16 or more of a class is found as such: runs are
# matched whole, so that no shorter one can hide a longer one.
BASE = (
    Rule(
        "assign",
        f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)
# Public formats of tokens and keys.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    Rule("login", "[a-z]{2,10}://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.-]{1,64}@"),
)


def _found(text: Column, rule: Rule, rank: int, run: Column) -> Column:
    """The matches of a rule as (start, rank, kind, end), in code points.

    The pieces between the matches and the matches themselves give all places as a running sum.
    """
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(
        F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(hits)), F.length).alias("gap"),
        F.transform(hits, F.length).alias("long"),
        F.transform(counted, F.length).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["long"]).alias("end"))
        return F.struct(
            (start + x["long"]).alias("at"),
            F.when(x["part"] >= rule.least, F.array_append(state["found"], one)).otherwise(state["found"]).alias("found"),
        )

    walk = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda state: state["found"])
    return F.when(run, walk).otherwise(none)


def _row_key(id_col: str, text_col: str) -> Column:
    """What a row is looked up by: its id and its text, so that an id that very many texts share makes no group."""
    return F.xxhash64(F.col(f"`{id_col}`"), text_of(f"`{text_col}`"))


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: list[str]) -> DataFrame:
    """(trigram, key): the inverted index over the trigrams that some rule asks for, one row per id, text and trigram.

    Repeated rows meet before they are shuffled.
    """
    low = docs.select(_row_key(id_col, text_col).alias("key"), F.lower(text_of(f"`{text_col}`")).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): rows whose postings satisfy the Boolean query of a rule.

    The queries are a table (kind, clause, alternative, trigram); postings are intersected by counting, all
    in one partitioning by document: alternatives with all their trigrams, clauses with an alternative,
    rules with all their clauses.
    """
    terms = [
        (rule.kind, c, a, t, len(needed), len(query))
        for rule in rules
        for query in [trigram_query(rule.pattern)]
        for c, clause in enumerate(query)
        for a, needed in enumerate(clause)
        for t in needed
    ]
    table = index.sparkSession.createDataFrame(terms, "kind string, clause int, alternative int, trigram string, needed int, clauses int")
    joined = index.join(F.broadcast(table), "trigram").repartition("key")
    met = joined.groupBy("key", "kind", "clause", "alternative", "needed", "clauses").agg(F.countDistinct("trigram").alias("n"))
    met = met.where("n = needed").groupBy("key", "kind", "clauses").agg(F.countDistinct("clause").alias("n"))
    return met.where("n = clauses").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _scanned(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(_c0, _c1, ..., found): every row with all its columns, under names of their own, and its matches."""
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    wanted = sorted({t for r in indexed for clause in trigram_query(r.pattern) for some in clause for t in some})
    index = staged(postings(docs, id_col, text_col, wanted), "postings")
    named = staged(candidates(index, indexed), "secret-candidates")
    n_cells = cell_count(named.count())
    bits = staged(bitmap(named.select(F.explode(F.array(*cells(F.col("key"), n_cells, PROBES))).alias("cell")), "cell"), "candidate-cells")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = text_of(names[docs.columns.index(text_col)])
    rows = docs.select(*[F.col(f"`{name}`").alias(own) for name, own in zip(docs.columns, names)], _row_key(id_col, text_col).alias("_key"))
    rows = probe(rows, bits, F.col("_key"), n_cells, PROBES, "_maybe")
    kinds = named.select(F.col("key").alias("_named"), "kinds")
    suspects = rows.where("_maybe")
    suspects = suspects.join(kinds, suspects["_key"] == kinds["_named"], "left")

    def verified(frame: DataFrame, asked) -> DataFrame:
        arrays = [
            _found(text, r, rank, asked(r) if r in indexed else text.rlike(r.pattern))
            for rank, r in enumerate(rules)
            if r not in indexed or asked(r) is not None
        ]
        some = [f"_f{i}" for i in range(len(arrays))]
        frame = frame.select(*names, *[a.alias(n) for a, n in zip(arrays, some)])
        return frame.select(*names, F.array_sort(F.flatten(F.array(*[F.col(n) for n in some]))).alias("found"))

    clear = verified(rows.where("not _maybe"), lambda rule: None)
    return clear.unionByName(verified(suspects, lambda rule: F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, found): the matches of every rule in every whole text, found: array of (start, rank, kind, end).

    Places are code points, ends exclusive, matches of one rule leftmost and without overlap; ``found`` is
    in the order of start, then of the rules.  Null texts are empty.  Rules without a mandatory trigram read
    every text; a rule with some reads those of its candidates alone.  A filter of bounded size, made of the
    candidates' ids and texts, splits the rows: those that it clears never shuffle, the others meet their candidate
    kinds by id and text.  An id that repeats, or is null, with other texts spreads like other ids; rows that
    repeat both have the same candidate kinds.  One row comes back per row of ``docs``; other columns are not
    read; an empty table gives an empty result.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _scanned(slim, "doc_id", "text", rules).select(F.col("_c0").alias(id_col), "found")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = MORE) -> DataFrame:
    """Counts, digest and spans per document: the base kinds, and those of ``rules`` beside them."""
    found = scan_secrets(docs, id_col, text_col, BASE + tuple(rules))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("found", lambda x: x["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(rule.kind) for rule in BASE]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` in the text; all rows and columns are kept, whatever they are called.

    Overlapping spans are masked as one.  Texts without a span, null ones included, stay as they are.
    """
    found = _scanned(docs, id_col, text_col, BASE + MORE)
    place = docs.columns.index(text_col)
    whole = F.col(f"_c{place}")

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(whole, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        fresh = x["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(state["masked"], gap, F.lit(mask))).otherwise(state["masked"]).alias("masked"),
        )

    masked = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("masked")),
        step,
        lambda state: F.concat(state["masked"], F.substring(whole, state["at"] + 1, F.length(whole))),
    )
    text = F.when(F.size("found") > 0, masked).otherwise(whole)
    return found.select(*[(text if i == place else F.col(f"_c{i}")).alias(name) for i, name in enumerate(docs.columns)])
