"""Line dedup by distinct-site spread: lines that many sites carry are boilerplate, and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, stored

#: Distinct sites from which on a line is boilerplate, and the size of the sketches (standard error 1.04 / sqrt(2^LG_K)).
SITES = 10
LG_K = 10


def trimmed(line: Column) -> Column:
    """A line without blanks, tabs and carriage returns at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def _line_key(line: Column) -> list[Column]:
    """128 bits of a trimmed line."""
    return [F.xxhash64(trimmed(line)).alias("__h1"), F.xxhash64(F.lit(1), trimmed(line)).alias("__h2")]


def _occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row for each line that isn't blank: key of the line, site, key of its row (id and content), position."""
    text = column(docs, text_col)
    rows = docs.select(column(docs, id_col).alias("__id"), column(docs, site_col).alias("__site"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(1), text).alias("__t2"), F.posexplode(F.split(text, "\n")).alias("__pos", "__line"))
    return rows.where(trimmed(F.col("__line")) != "").select("__id", "__site", "__t1", "__t2", "__pos", *_line_key(F.col("__line")))


def boilerplate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """Keys of the lines that at least ``sites`` distinct sites carry, with their first occurrence (least id, then position).

    One HyperLogLog sketch for each line hash, merged by aggregation from partial sketches of the tasks. Estimates that lie
    further from the threshold than three standard errors, and one site at least, decide at once; the lines nearer to it get
    an exact distinct count. A null site counts as none.
    """
    lines = _occurrences(docs, id_col, text_col, site_col)
    sketched = lines.groupBy("__h1", "__h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(lg_k))).alias("__estimate"),
        F.min(F.struct("__id", "__pos")).alias("__first"),
    )
    margin = max(1.0, 3 * 1.04 / 2 ** (lg_k / 2) * sites)
    sketched = stored(sketched.where(F.col("__estimate") >= sites - margin), "spread-lines")
    near = sketched.where(F.col("__estimate") <= sites + margin)
    exact = lines.join(near.select("__h1", "__h2"), ["__h1", "__h2"], "left_semi").groupBy("__h1", "__h2", "__site").agg(F.lit(1).alias("__one"))
    exact = exact.groupBy("__h1", "__h2").agg(F.count("__site").alias("__n")).where(F.col("__n") >= sites)
    sure = sketched.where(F.col("__estimate") > sites + margin)
    return sure.select("__h1", "__h2", "__first").unionByName(near.join(exact.select("__h1", "__h2"), ["__h1", "__h2"], "left_semi").select("__h1", "__h2", "__first"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """Every row of ``docs`` with boilerplate lines taken out of its text, ``n_lines`` and ``n_removed``.

    A line stays at its first occurrence (least id, then position), so that a text which many sites copy isn't lost; every
    other occurrence goes. Lines are compared without blanks, tabs and carriage returns at their ends; blank lines stay and
    never count. Null text:
    null text, 0 lines. Empty text: one line, which stays. Very long texts are split like any other. Repeated rows are
    treated alike (ties of the first occurrence all stay). Empty table: no rows. Columns of ``docs`` named like the results
    are replaced. The lines' own texts are never shuffled, only hashes; a line that all sites carry shrinks to one row for
    each task before it is counted. The boilerplate lines are stored before they meet all lines: a table as small as
    they mostly are is broadcast by its known size, and beyond that adaptive execution splits a line that is hot.
    """
    lines = _occurrences(docs, id_col, text_col, site_col)
    found = stored(boilerplate_lines(docs, id_col=id_col, text_col=text_col, site_col=site_col, sites=sites, lg_k=lg_k), "boilerplate")
    at = F.struct("__id", "__pos")
    drop = lines.drop("__site").join(found, ["__h1", "__h2"]).where(~at.eqNullSafe(F.col("__first")))
    drop = drop.groupBy("__id", "__t1", "__t2").agg(F.collect_set("__pos").alias("__drop")).withColumnsRenamed({"__id": "__rid", "__t1": "__r1", "__t2": "__r2"})
    kept = [column(docs, c) for c in docs.columns if c not in ("n_lines", "n_removed", text_col)]
    text = column(docs, text_col)
    keyed = docs.select(*kept, F.split(text, "\n").alias("__parts"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(1), text).alias("__t2"))
    out = keyed.join(drop, column(keyed, id_col).eqNullSafe(F.col("__rid")) & (F.col("__t1") == F.col("__r1")) & (F.col("__t2") == F.col("__r2")), "left")
    # the parts are a column of the join's left side, so a position is looked up in them in no time; hashed sets tell which positions stay
    n_lines, stay = F.coalesce(F.size("__parts"), F.lit(0)), F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__drop"))
    clean = F.when(F.col("__drop").isNull(), F.array_join("__parts", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__parts", i)), "\n"))
    counts = {"n_lines": F.when(F.col("__parts").isNull(), 0).otherwise(n_lines).cast("long"), "n_removed": F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long")}
    out = out.withColumns({text_col: clean, **counts})
    return out.select(*(column(out, c) for c in docs.columns if c not in counts), *counts)
