"""Line dedup: a suffix array over sequences of line ids, by distributed prefix doubling.

Lines that are not blank form one sequence for each document. A suffix's rank is the number of
suffixes that sort before it by their first 2**k lines, among suffixes that still share these
lines with another; ranks of twice that length come from sorting the pairs (rank here, rank
2**k lines on). Suffixes that stand alone leave the array, which is what ends the doubling. All
suffixes of one rank at a length are one longest-common-prefix interval. An interval of
``min_lines`` lines or more is a repeated run: its first copy, in the order of document id,
document hash and place, stays, and the lines of later copies are deleted; overlapping and
adjoining copies merge into maximal runs. Where ``min_words`` is given, an interval of one line is
a repeated run too if the line has that many words. The pipeline's stage deletes such lines from
``MIN_WORDS`` words on; the query does not, as its SQL knows runs of ``MIN_LINES`` lines alone.

Every step is a DataFrame operation. Equal pairs are counted with partial sums before they are
sorted, ranks are prefix sums over distinct pairs, and a hot line only makes one side of an
equi-join long, which adaptive execution splits.

Defined results: a null text has no lines and stays null. Blank lines are kept, and counted, but
are no part of a run. Lines differ if any character differs. Rows equal in id and text are one
document, so each repeat gets the same answer. A copy that overlaps the first copy in the same
document is deleted from where it leaves the first line of it. Further columns are kept;
``n_lines``, ``n_removed`` and ``shared_lines`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import prefix_sums
from ..session import cut
from .common import row_key, set_aside, staged, table

MIN_LINES = 2
MIN_WORDS = 50
KEY = ["_k1", "_k2"]


def line_rows(keyed: DataFrame) -> DataFrame:
    """(_k1, _k2, _id, pos, line, h1, h2, words): lines that aren't blank, numbered within their document."""
    lines = F.filter(F.transform(F.split("_text", "\n"), lambda s, i: F.struct(i.alias("line"), s.alias("s"))),
                     lambda x: x["s"].rlike(r"\S"))
    return keyed.select(*KEY, "_id", F.posexplode(lines).alias("pos", "x")).select(
        *KEY, "_id", "pos", F.col("x.line").alias("line"), F.xxhash64("x.s").alias("h1"),
        F.xxhash64(F.lit(1), "x.s").alias("h2"), F.size(F.regexp_extract_all("x.s", F.lit(r"(\S+)"))).alias("words"))


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` values occur more than once, with ``rank`` and whether they come ``later``."""
    who = F.struct("_id", *KEY, "pos")
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(who).alias("first")).where("n > 1")
    ranks = prefix_sums(groups, by, ["n"]).select(*by, F.col("before_n").alias("rank"), "first")
    return rows.join(ranks, by).select(*KEY, "_id", "pos", "rank", (who != F.col("first")).alias("later"))


def suffix_ranks(rows: DataFrame) -> list[DataFrame]:
    """Tables (_k1, _k2, _id, pos, rank, later) for prefixes of 1, 2, 4, ... lines, none empty."""
    out, here = [], cut(ranked(rows, ["h1", "h2"]))
    while not here.isEmpty():
        out.append(here)
        ahead = W.partitionBy(*KEY).orderBy("pos").rangeBetween(2 ** (len(out) - 1), 2 ** (len(out) - 1))
        pairs = here.withColumn("next", F.first("rank").over(ahead)).where("next IS NOT NULL")
        here = cut(ranked(pairs.select(*KEY, "_id", "pos", F.col("rank").alias("r"), "next"), ["r", "next"]))
    return out


def at_length(levels: list[DataFrame], length: int) -> DataFrame | None:
    """Ranks for prefixes of exactly ``length`` lines, from the level below it and its overlap."""
    k = length.bit_length() - 1
    if k >= len(levels):
        return None
    if length == 2 ** k:
        return levels[k]
    off = length - 2 ** k
    ahead = W.partitionBy(*KEY).orderBy("pos").rangeBetween(off, off)
    pairs = levels[k].withColumn("next", F.first("rank").over(ahead)).where("next IS NOT NULL")
    return ranked(pairs.select(*KEY, "_id", "pos", F.col("rank").alias("r"), "next"), ["r", "next"])


def later_lines(rows: DataFrame, level: DataFrame, min_words: int) -> DataFrame:
    """(_k1, _k2, pos, n): later copies of single lines of ``min_words`` words or more."""
    long = rows.where(F.col("words") >= min_words).select(*KEY, "pos").distinct()
    return level.where("later").join(long, [*KEY, "pos"], "left_semi").select(*KEY, "pos", F.lit(1).alias("n"))


def later_copies(rows: DataFrame, min_lines: int, min_words: int | None = None) -> DataFrame | None:
    """(_k1, _k2, gone, shared_lines): numbers of deleted lines, and the greatest power of two of lines
    that starts at one of them and is found elsewhere too."""
    levels = suffix_ranks(rows)
    least = at_length(levels, min_lines)
    found = [] if least is None else [least.where("later").select(*KEY, "pos", F.lit(min_lines).alias("n"))]
    if min_words is not None and levels:
        found.append(later_lines(rows, levels[0], min_words))
    if not found:
        return None
    spans = found[0] if len(found) == 1 else found[0].union(found[1])
    for k, level in enumerate(levels):
        if 2 ** k > min_lines:
            spans = spans.union(level.where("later").select(*KEY, "pos", F.lit(2 ** k).alias("n")))
    longest = spans.groupBy(*KEY, "pos").agg(F.max("n").alias("n"))
    past = W.partitionBy(*KEY).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    fresh = longest.withColumn("reached", F.coalesce(F.max(F.col("pos") + F.col("n")).over(past), F.lit(0))).withColumn(
        "from", F.greatest("pos", "reached")).withColumn("to", F.col("pos") + F.col("n")).where("to > from")
    places = fresh.select(*KEY, "n", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("pos"))
    # equal rows have equal lines, so a place of theirs names one line
    return places.join(rows.select(*KEY, "pos", "line"), [*KEY, "pos"]).groupBy(*KEY).agg(
        F.collect_set("line").alias("gone"), F.max("n").cast("long").alias("shared_lines"))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text",
                 min_words: int | None = None) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from the text, and what was deleted."""
    source, given_back = set_aside(docs.drop("n_lines", "n_removed", "shared_lines"), "gone", "_lines", *KEY)
    body = F.col(text).cast("string")
    keyed = source.select(*row_key(F.col(doc_id), body), F.col(doc_id).alias("_id"), body.alias("_text"))
    marks = later_copies(staged(line_rows(keyed), "lines"), min_lines, min_words)
    # inline makes the split text a column, so that the expressions below don't split it again
    split = source.select("*", *row_key(F.col(doc_id), body), F.inline(F.array(F.struct(F.split(body, "\n").alias("_lines")))))
    if marks is None:
        joined = split.withColumns({"gone": F.lit(None).cast("array<int>"), "shared_lines": F.lit(None).cast("long")})
    else:
        joined = split.join(marks, KEY, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    cleaned = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    return given_back(joined.withColumns({
        text: F.when(F.col("gone").isNull(), body).otherwise(cleaned),
        "n_lines": F.coalesce(F.size("_lines"), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        "shared_lines": F.coalesce("shared_lines", F.lit(0).cast("long"))}).drop("_lines", "gone", *KEY))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_lines", "n_removed", "shared_lines",
                                     F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, min_words=MIN_WORDS).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


OP1_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
flat AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS line FROM split),
full_lines AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS BIGINT) AS pos
  FROM flat WHERE regexp_replace(s, '\s', '', 'g') <> ''),
pairs AS (SELECT a.doc_id, a.pos, min(a.doc_id * 1000000 + a.pos) OVER (PARTITION BY a.s, b.s) AS head
  FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1),
later AS (SELECT doc_id, pos FROM pairs WHERE head <> doc_id * 1000000 + pos),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(2) r(k)),
powers(n, doc_id, pos, head) AS (
  SELECT CAST(2 AS BIGINT), doc_id, pos, head FROM pairs
  UNION ALL
  SELECT 2 * a.n, a.doc_id, a.pos, min(a.doc_id * 1000000 + a.pos) OVER (PARTITION BY a.n, a.head, b.head)
  FROM powers a JOIN powers b ON a.n = b.n AND a.doc_id = b.doc_id AND b.pos = a.pos + a.n),
shared AS (SELECT doc_id, max(n) AS n FROM powers WHERE head <> doc_id * 1000000 + pos GROUP BY doc_id),
kept AS (SELECT f.doc_id, string_agg(f.s, chr(10) ORDER BY f.line) AS kept FROM flat f
  LEFT JOIN full_lines l ON f.doc_id = l.doc_id AND f.line = l.line
  LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY f.doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
  coalesce(s.n, 0) AS shared_lines, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM split d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN removed r ON d.doc_id = r.doc_id
LEFT JOIN shared s ON d.doc_id = s.doc_id
"""
