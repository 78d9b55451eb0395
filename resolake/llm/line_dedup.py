"""Boilerplate lines by site-relative frequency.

A line is boilerplate on a host when the share of the host's pages that contain
it exceeds a ratio. A page counts a line once, a line is compared without the
spaces around it, and blank lines are never dropped. By the bare ratio a host of
few pages loses lines that one page holds; `least_pages` keeps lines that fewer
pages of a host hold.

Contract for odd input
----------------------
Null text stays null with 0 lines. Null hosts count as the empty host. Each row
is a page, so repeated rows count as often as they occur; a null id is carried
along. Other columns pass through unchanged where the table is returned whole,
whatever they are called: the columns n_lines and n_dropped that are added get
underscores after their names where the table has such columns. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, quoted

#: Dropped (host, line) pairs up to this many go to every executor, at 8 bytes each and the hosts' names; more are joined by shuffle.
BROADCAST_LINES = 200_000
SALTS = 64


def boilerplate_lines(pages: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1, least_pages: int = 1) -> DataFrame:
    """(host, line_hash, pages, host_pages) of the lines on `least_pages` or more whose share of the host's pages exceeds ratio."""
    own = pages.select(F.coalesce(F.col(quoted(host_col)).cast("string"), F.lit("")).alias("host"), F.col(quoted(text_col)).alias("text"))
    totals = own.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    counts = own.select("host", F.explode(hashes).alias("line_hash")).groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("pages"))
    return counts.where(F.col("pages") >= least_pages).join(totals, "host").where(F.col("pages").cast("double") / F.col("host_pages") > ratio)


def drop_boilerplate_lines(pages: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1, out: str | None = None, least_pages: int = 1) -> DataFrame:
    """All columns of the pages, the text without its host's boilerplate lines, and n_lines and n_dropped.

    Only hashes are shuffled to count lines, with map-side sums, so a hot host
    or line costs no more than its distinct lines. A host has at most (lines a
    page) / ratio such lines; they are counted once and stored. Their sets are
    sent to all tasks where they are few in all, else joined by host and a salt
    that spreads a host's pages.
    """
    host, drops, salt, kept = (free_name(pages, c) for c in ("page_host", "host_drops", "page_salt", "kept_lines"))
    n_lines, n_dropped = free_name(pages, "n_lines"), free_name(pages, "n_dropped")
    with Scratch(pages.sparkSession) as scratch:
        sets = scratch.keep(boilerplate_lines(pages, text_col, host_col, ratio, least_pages).groupBy(F.col("host").alias(host)).agg(F.collect_set("line_hash").alias(drops)))
    found = sets.agg(F.coalesce(F.sum(F.size(drops)), F.lit(0)).alias("n")).first()["n"]
    text = F.col(quoted(text_col))
    keyed = pages.withColumn(host, F.coalesce(F.col(quoted(host_col)).cast("string"), F.lit("")))
    if found <= BROADCAST_LINES:
        joined = keyed.join(F.broadcast(sets), host, "left")
    else:
        salted = sets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(salted, [host, salt], "left").drop(salt)
    lines = F.split(text, "\n")
    stay = F.when(F.col(drops).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(drops, F.xxhash64(F.trim(x))) | (F.trim(x) == "")))
    length: Callable[[Column], Column] = lambda x: F.coalesce(F.greatest(F.size(x), F.lit(0)), F.lit(0)).cast("long")
    done = joined.withColumn(kept, stay).withColumn(n_lines, length(lines)).withColumn(n_dropped, F.col(n_lines) - length(F.col(kept)))
    done = done.withColumn(out or text_col, F.array_join(kept, "\n"))
    added = [c for c in [out] if c and c not in pages.columns]
    return done.select(*[F.col(quoted(c)) for c in [*pages.columns, *added, n_lines, n_dropped]])


def line_dedup_report(pages: DataFrame, **params) -> DataFrame:
    """Per page: doc_id, n_lines, n_dropped and the md5 of the text that stays."""
    kept = drop_boilerplate_lines(pages.select("doc_id", "text", "source"), **params)
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def line_dedup_sql(ratio: float = 0.1, least_pages: int = 1) -> str:
    return f"""
with d as (select doc_id, coalesce(source, '') as h, text, string_split(text, chr(10)) as ls from documents),
l as (select h, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ')))) as line from d),
c as (select h, line, count(*) as c from l where line <> '' group by 1, 2),
n as (select h, count(*) as n from d group by 1),
b as (select c.h, list(line) as drops from c join n on c.h = n.h where c >= {least_pages} and c::double / n > {ratio} group by 1),
k as (select doc_id, text, ls, list_filter(ls, lambda x: not list_contains(coalesce(drops, []::varchar[]), trim(x, ' '))) as kept from d left join b on d.h = b.h)
select doc_id, coalesce(len(ls), 0)::bigint as n_lines, (coalesce(len(ls), 0) - coalesce(len(kept), 0))::bigint as n_dropped,
  md5(array_to_string(kept, chr(10))) as text_md5 from k"""
