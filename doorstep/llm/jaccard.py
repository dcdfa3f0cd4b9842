"""N-gram Jaccard join through a token-group matrix: all links of shingle sets, as components.

A set's tokens are 64-bit hashes of its distinct runs of ``SHINGLE`` words. Two sets can only link
if either shares its ``percent`` of tokens with others, and that is used twice.

* Sets without company. In one order of all tokens, linked sets share the first of their common
  tokens within a prefix of each: all but the ``percent`` of a set, and so many more as are then
  asked to be shared. Texts are read in batches; each sends the distinct tokens of its prefixes,
  packed by hash range, to where all batches' tokens of the range meet, and hears which of them
  another set holds. Sets with too few shared ones link with nothing and end here. A token that many
  sets hold is sent once for each batch.
* Groups. The rest is partitioned into groups of similar sets: sets that share one of ``DRAWS`` min
  hashes are compared with one central set of that bucket, and those linked form a group, the
  others one each. Sets whose prefixes share too few tokens with other groups are done.
* Matrix. Rows (token, group) are the union of the tokens of each group's members. A query set's
  overlap with a group's union bounds its overlap with every member. Of a pair the smaller set is the
  query. Sets of which fewer than ``percent`` tokens lie in unions of other groups are done. For the
  others, the rarest tokens, so many that a linked set must hold one of them among its own rarest,
  name the candidate groups. What the unions of a query's own group and a candidate share bounds the
  overlap of all queries of that group at once; for what remains, each query's full overlap is counted.
  Groups of two or more come first, with their central sets only: what joins them is in their group
  when the others are looked at.
* Opening. A group opens to a query if the bound allows a link: first its central set, then, where
  that joined nothing, every member of a fitting size that shares one of the rarest tokens. Each
  comparison is an exact intersection.

Every step but the groups' formation is a bound that holds for every link, so none is lost whatever
the groups are; sets of one group are not compared further, since that can't change a component.

Defined results: ASCII letters are folded to lower case. Null texts and texts without words have
empty sets and are linked with nothing; texts of fewer than ``SHINGLE`` words are one token. Equal
sets are one set, so repeated rows and copies are linked; null ids are kept, and the component is
the least id of its rows (null if it has none). Texts of any length are read whole, a long one as a
batch of its own. An empty table gives no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import session_settings
from .common import Words, by_size, components, mixed, small_batches, staged, table, text_of, windows

SHINGLE, PERCENT = 5, 80
DRAWS, CENTRES = 6, 3
BATCH = 4_000_000
#: Bytes of text for each hash range of tokens: a task holds one range at a time.
RANGE = 12_000_000
#: Row number of a token that several sets of its batch hold.
MANY = 65535
#: Sizes of sets within a bucket differ by so much.
WIDTH = 0.02
#: One in so many of a set's tokens is asked to be shared within the prefix.
ASKED = 5
#: A table is sent to all only if Spark sizes it below so many bytes. It counts a list as one value, so a table
#: of exploded tokens is many times its estimate, and what is sent passes through the driver.
SENT = 256 << 10


def prefix(n: np.ndarray | Column, percent: int) -> tuple:
    """(length, least): of two linked sets, either shares ``least`` tokens of its prefix with the other's prefix.

    A set of n tokens shares need = percent * n of them, so at most n - need others precede the first
    n / ASKED shared ones. The other set has need tokens at least, and asks for no fewer than need / ASKED."""
    up = lambda x, k: (x + k - 1) // k if isinstance(x, np.ndarray) else F.floor((x + (k - 1)) / k)
    need = up(percent * n, 100)
    return n - need + up(n, ASKED), up(need, ASKED)


def token_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each text, one after the other, and where each text's begin."""
    words = Words(column, lower=True)
    h, first = words.hashes, words.first
    runs = windows(h, shingle, seed=31)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            sets.append(np.unique(runs[a:b - shingle + 1]))
        elif b > a:
            sets.append(windows(h[a:b], b - a, seed=40 + b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _list(values: np.ndarray | pa.Array) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def packed_tokens(rows: DataFrame, ranges: int, percent: int, shingle: int) -> DataFrame:
    """A row for each batch of (doc_id, _text, _t1, _t2): its sets, and the tokens of their prefixes by hash range."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for number, batch in enumerate(by_size(BATCH)(batches)):
            tokens, first = token_sets(batch.column("_text"), shingle)
            n = np.diff(first)
            s1, s2 = _sums(mixed(tokens, 51), first), _sums(mixed(tokens, 52), first)
            lone = np.zeros(len(n), bool)
            lone[np.unique(np.stack([s1, s2]), axis=1, return_index=True)[1]] = True  # one of equal sets
            held = np.repeat(lone, n) & (np.arange(len(tokens)) - np.repeat(first[:-1], n) < np.repeat(prefix(n, percent)[0], n))
            row = np.repeat(np.arange(len(n)), n)[held]
            key = (tokens[held] & np.uint64(ranges - 1)) << np.uint64(32) | tokens[held] >> np.uint64(32)
            order = np.argsort(key)
            key, row = key[order], row[order]
            new = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, np.int64)
            often = np.diff(np.append(new, len(key)))
            known = np.bincount(row[np.repeat(often > 1, often)], minlength=len(n))  # shared within the batch
            name, asks = key[new], np.where(often > 1, MANY, row[new]).astype("<u2")
            at = np.searchsorted(name >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
            parts = [{"p": p, "t": name[a:b].astype("<u4").tobytes(), "r": asks[a:b].tobytes()}
                     for p, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | number]), _list(batch.column("doc_id")), _list(batch.column("_t1")), _list(batch.column("_t2")),
                 _list(n.astype(np.int64)), _list(s1), _list(s2), _list(known.astype(np.int64)),
                 pa.array([parts], pa.list_(pa.struct([("p", pa.int32()), ("t", pa.binary()), ("r", pa.binary())])))],
                ["batch", "ids", "t1", "t2", "n", "s1", "s2", "known", "parts"])
    return rows.select("doc_id", "_text", "_t1", "_t2").mapInArrow(run, f"""batch bigint, ids array<{kind}>, t1 array<bigint>,
        t2 array<bigint>, n array<bigint>, s1 array<bigint>, s2 array<bigint>, known array<bigint>,
        parts array<struct<p: int, t: binary, r: binary>>""")


def shared_counts(lists: DataFrame) -> DataFrame:
    """(batch, r, c): rows of a batch and how many of the tokens sent of one range another batch sent too."""
    def counted(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        batch = np.repeat(np.arange(len(held)), [len(t) for _, t, _ in held])
        token, row = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        order = np.argsort(token, kind="stable")
        same = token[order][1:] == token[order][:-1]
        shared = np.zeros(len(token), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        shared &= row != MANY
        rows, counts = np.unique(batch[shared] << 16 | row[shared], return_counts=True)
        ends = np.searchsorted(rows >> 16, np.arange(len(held) + 1))
        some = [(i, a, b) for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]
        return pa.RecordBatch.from_arrays(
            [pa.array([held[i][0] for i, _, _ in some], pa.int64()),
             pa.array([(rows[a:b] & 65535).astype("<u2").tobytes() for _, a, b in some], pa.binary()),
             pa.array([counts[a:b].astype("<u4").tobytes() for _, a, b in some], pa.binary())], ["batch", "r", "c"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for part in parts:
            for p, batch, t, r in zip(*(part.column(c) for c in ("p", "batch", "t", "r")), strict=True):
                if p.as_py() != now:
                    if held:
                        yield counted(held)
                    now, held = p.as_py(), []
                held.append((batch.as_py(), np.frombuffer(t.as_py(), "<u4"), np.frombuffer(r.as_py(), "<u2").astype(np.int64)))
        if held:
            yield counted(held)
    return lists.select("p", "batch", "t", "r").repartition("p").sortWithinPartitions("p").mapInArrow(
        run, "batch bigint, r binary, c binary")


def sets_and_company(packed: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """(doc_id, t1, t2, n, s1, s2, share): how much of its prefix a set shares, null if too little for a link."""
    fields = ["ids", "t1", "t2", "n", "s1", "s2", "known"]
    kind = packed.schema["ids"].dataType.elementType.simpleString()
    none = lambda like, names: [F.lit(None).cast(like.schema[c].dataType).alias(c) for c in names]
    both = packed.select("batch", *fields, *none(counts, "rc")).unionByName(
        counts.select("batch", *none(packed, fields), "r", "c"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shared = None, None

        def out() -> pa.RecordBatch:
            n = own["n"].to_numpy()
            length, least = prefix(n, percent)
            share = pa.array(shared / np.maximum(length, 1), mask=(n == 0) | (shared < least))
            return pa.RecordBatch.from_arrays([*(own[c] for c in fields[:-1]), share], ["doc_id", *fields[1:-1], "share"])
        for part in parts:
            for j in range(part.num_rows):
                if part.column("n")[j].is_valid:  # a batch's own row comes before the counts
                    if own is not None:
                        yield out()
                    own = {c: part.column(c)[j].values for c in fields}
                    shared = own["known"].to_numpy().copy()
                else:
                    rows = np.frombuffer(part.column("r")[j].as_py(), "<u2")
                    shared[rows] += np.frombuffer(part.column("c")[j].as_py(), "<u4")
        if own is not None:
            yield out()
    return both.repartition("batch").sortWithinPartitions("batch", F.col("n").isNull()).mapInArrow(
        run, f"doc_id {kind}, t1 bigint, t2 bigint, n bigint, s1 bigint, s2 bigint, share double")


def tokens_of(bodies: DataFrame, shingle: int) -> DataFrame:
    """(name, share, n, tokens, draws) of (name, share, _text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(BATCH)(batches):
            tokens, first = token_sets(batch.column("_text"), shingle)
            full = first[:-1]  # no set is empty here
            draws = np.stack([np.minimum.reduceat(mixed(tokens, 60 + k), full) for k in range(DRAWS)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), batch.column("share"), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens.view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, draws.size + 1, DRAWS, dtype=np.int32)), pa.array(draws.ravel().view(np.int64)))],
                ["name", "share", "n", "tokens", "draws"])
    return bodies.select("name", "share", "_text").mapInArrow(run, "name string, share double, n bigint, tokens array<bigint>, draws array<bigint>")


def name(s1: str = "s1", s2: str = "s2") -> Column:
    """128 bits that name a set by its tokens."""
    return F.concat(F.lpad(F.hex(s1), 16, "0"), F.lpad(F.hex(s2), 16, "0"))


def links_among(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that are linked, by exact intersection of their tokens."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(fits).withColumn("both", F.size(F.array_intersect("ta", "tb")))
    return met.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def grouped(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of sets to the central sets of a bucket, and (node, g, share) with each set's group.

    The set that shares most of its tokens is central: what edited copies have in common is the text
    they come from, while each has tokens of its own."""
    rows = sets.select("node", "share", F.posexplode("draws").alias("k", "draw"))
    # among equals, as many as CENTRES
    best = [F.max(F.struct("share", F.xxhash64("node", F.lit(i)).alias("h"), "node"))["node"] for i in range(CENTRES)]
    central = staged(rows.groupBy("k", "draw").agg(F.array_distinct(F.array(*best)).alias("c"), F.count("*").alias("size")).where(
        "size > 1").select("k", "draw", F.explode("c").alias("centre")), "centres")
    pairs = rows.join(central, ["k", "draw"]).where("node <> centre").select(*ordered("node", "centre")).distinct()
    links = staged(links_among(pairs, sets, percent), "bucket-links")
    groups = components(links)
    of = sets.select("node", "share").join(groups, F.col("node") == F.col("id"), "left").select(
        "node", F.coalesce("class", "node").alias("g"), "share")
    return links, staged(of, "groups")


def across(entries: DataFrame) -> DataFrame:
    """Entries (node, n, g, t) whose token several groups hold."""
    held = entries.groupBy("t").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a < b").select("t")
    return entries.join(held, "t")


def in_company(entries: DataFrame, least: Column) -> DataFrame:
    """(node, wide): nodes that have ``least`` entries, and how many they have."""
    return entries.groupBy("node").agg(F.count("*").alias("wide"), F.first("n").alias("n")).where(
        F.col("wide") >= least).select("node", "wide")


def bucket(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / float(np.log(1 + WIDTH)) + 1e-9).cast("int")


def rarest(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, n, g, t, b) of queries, and of the sets that they look for: the rarest tokens, of which a
    linked pair of different groups shares one in one bucket b.

    The smaller set of a pair is the query. Sets of sizes a <= b share at least percent * (a + b) /
    (100 + percent), so a query asks for a greater share of its tokens, and from what a larger set
    shares at all, ``wide``, follows up to which size its partners go: b are buckets of sizes."""
    often = entries.select("t", "g").distinct().groupBy("t").agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("df", "t"))
    part, full = F.ceil(percent * F.col("n") / 100), least_overlap(percent)
    # tokens of the own group alone come first in the order, so they take their share of the prefix
    ranked = staged(entries.join(often, "t").withColumn("rank", rank).where(F.col("rank") <= F.col("wide") - part + 1).withColumn(
        "most", F.floor((100 + percent) * F.col("wide") / percent) - F.col("n")), "rare-tokens")
    asking = ranked.where((F.col("most") >= F.col("n")) & (F.col("rank") <= F.col("wide") - full + 1)).select(
        "node", "n", "g", "t", bucket(F.col("n")).alias("b"))
    asked = ranked.where(F.col("most") >= part).select("node", "n", "g", "t", F.explode(F.sequence(
        bucket(part), bucket(F.least("most", "n")))).alias("b"))
    return asking, asked


def least_overlap(percent: int) -> Column:
    """Tokens that a query of n tokens shares with a linked set of its size or more."""
    return F.ceil(2 * percent * F.col("n") / (100 + percent))


def centres(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, centre, size): of each group the set that shares most of its tokens, and its number of sets."""
    wide = entries.select("node", (F.col("wide") / F.col("n")).alias("part")).distinct()
    return groups.join(wide, "node").groupBy("g").agg(F.max(F.struct("part", "share", "node")).alias("c"), F.count("*").alias("size")).select(
        "g", F.col("c.node").alias("centre"), "size")


def to_large_groups(entries: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets with central sets of groups of two or more, where the rarest tokens allow a link."""
    asking, asked = rarest(entries, percent)
    large = centres(entries, groups).where("size > 1").select(F.col("centre").alias("node"))
    out = [x.select("t", "b", "node", "g").join(y.join(large, "node").select("t", "b", F.col("node").alias("centre"), F.col("g").alias("h")), ["t", "b"]).where(
        "g <> h").select(*ordered("node", "centre")) for x, y in ((asking, asked), (asked, asking))]
    return out[0].union(out[1]).distinct()


def candidate_groups(entries: DataFrame, asking: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """(node, n, g, h, overlap): groups h whose union holds enough of a query's tokens for a link."""
    by_size = asked.select("t", "b", F.col("g").alias("h")).distinct()
    matrix = staged(entries.select("t", "g").distinct(), "matrix")
    met = staged(asking.join(by_size, ["t", "b"]).where("h <> g").select("node", "n", "g", "h").distinct(), "query-groups")
    pairs = staged(met.join(of_unions(matrix, met), ["g", "h"]).where(F.col("common") >= least_overlap(percent)).drop("common"), "query-groups-bounded")
    return entries.select("node", "t").join(pairs, "node").join(matrix.withColumnRenamed("g", "h"), ["t", "h"]).groupBy("node", "n", "g", "h").agg(
        F.count("*").alias("overlap")).where(F.col("overlap") >= least_overlap(percent))


def of_unions(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g, h, common): tokens that the unions of two groups share, counted once for all queries of g.

    The smaller union is looked up in the larger one."""
    size = matrix.groupBy("g").agg(F.count("*").alias("size"))
    both = pairs.select("g", "h").distinct().join(size.withColumnRenamed("size", "sg"), "g").join(
        size.withColumnsRenamed({"g": "h", "size": "sh"}), "h")
    turned = F.col("sh") < F.col("sg")
    asked = both.select("g", "h", F.when(turned, F.col("h")).otherwise(F.col("g")).alias("small"),
                        F.when(turned, F.col("g")).otherwise(F.col("h")).alias("large"))
    return asked.join(matrix.withColumnRenamed("g", "small"), "small").join(
        matrix.withColumnRenamed("g", "large"), ["large", "t"]).groupBy("g", "h").agg(F.count("*").alias("common"))


def regrouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, g, share) by the links so far."""
    return nodes.select("node", "share").join(components(links), F.col("node") == F.col("id"), "left").select(
        "node", F.coalesce("class", "node").alias("g"), "share")


def set_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, class) of the sets (node, share, n, tokens, draws) that are linked with another."""
    links, groups = grouped(sets, percent)
    of = groups.select("node", "g")
    length, least = prefix(F.col("n"), percent)
    enough = F.ceil(percent * F.col("n") / 100)
    first = sets.select("node", "n", F.explode(F.slice("tokens", F.lit(1), length.cast("int"))).alias("t"))
    met = staged(in_company(across(first.join(of, "node")), least), "met-others").select("node")
    whole = sets.join(met, "node").select("node", "n", F.explode("tokens").alias("t")).join(of, "node")
    shared = staged(across(whole), "shared-tokens")
    entries = staged(shared.join(in_company(shared, enough), "node"), "entries")
    # to large groups first: what joins them needs no comparison with their members
    links = staged(links.union(links_among(to_large_groups(entries, groups, percent), sets, percent)), "links-to-large-groups")
    groups = staged(regrouped(groups, links), "groups-again")
    shared = staged(across(entries.drop("g", "wide").join(groups.select("node", "g"), "node")), "still-shared")
    entries = staged(shared.join(in_company(shared, enough), "node"), "entries-again")
    asking, asked = rarest(entries, percent)
    found = staged(candidate_groups(entries, asking, asked, percent), "candidate-groups")
    tested = staged(found.join(centres(entries, groups).select(F.col("g").alias("h"), "centre"), "h").select(
        *ordered("node", "centre")).distinct(), "opened-first")
    links = staged(links.union(links_among(tested, sets, percent)), "links")
    now = staged(regrouped(entries.select("node").distinct().join(groups, "node"), links).select("node", F.col("g").alias("class")), "classes")
    x = asking.select("node", "t", "b").join(found, "node").join(now.withColumnRenamed("class", "x"), "node")
    y = asked.select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("g").alias("h"), "t", "b").join(
        now.select(F.col("node").alias("other"), F.col("class").alias("y")), "other")
    allowed = (F.col("x") != F.col("y")) & (F.col("n") <= F.col("m")) & (percent * (F.col("n") + F.col("m")) <= (100 + percent) * F.col("overlap"))
    rest = x.join(y, ["t", "b", "h"]).where(allowed).select(*ordered("node", "other")).distinct().join(tested, ["a", "b"], "left_anti")
    return components(staged(links.union(links_among(rest, sets, percent)), "all-links")).select(F.col("id").alias("node"), "class")


def joined(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    limit = min(SENT, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    with session_settings(spark, dict.fromkeys(
            ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), limit)):
        return _joined(docs, percent, shingle, doc_id, text)


def _joined(docs: DataFrame, percent: int, shingle: int, doc_id: str, text: str) -> DataFrame:
    body = text_of(docs, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_text")).withColumns(
        {"_t1": F.xxhash64("_text"), "_t2": F.xxhash64(F.lit(1), "_text")})
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = 1 << max(0, (size // RANGE).bit_length())
    packed = staged(packed_tokens(rows, ranges, percent, shingle), "token-batches")
    found = staged(sets_and_company(packed.drop("parts"), shared_counts(packed.select("batch", F.inline("parts"))), percent).withColumn(
        "name", name()), "sets")
    one = found.where("share IS NOT NULL").groupBy("name").agg(F.min(F.struct("t1", "t2")).alias("k"), F.max("share").alias("share")).select(
        "name", "share", F.col("k.t1").alias("_t1"), F.col("k.t2").alias("_t2"))
    bodies = rows.select("_text", "_t1", "_t2").join(one, ["_t1", "_t2"]).groupBy("name").agg(
        F.first("_text").alias("_text"), F.first("share").alias("share"))
    # numbers, once written, are short names
    sets = staged(tokens_of(bodies, shingle).withColumn("node", F.monotonically_increasing_id()), "token-sets")
    classes = set_classes(sets, percent).join(sets.select("node", "name"), "node").select("name", "class")
    # sets first, so that rows of one set or class meet as one row each
    least = found.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("low"))
    named = staged(least.join(classes, "name", "left"), "named")
    low = named.where("class IS NOT NULL").groupBy("class").agg(F.min("low").alias("component_id"))
    ids = named.join(low, "class", "left").select("name", F.when(F.col("class").isNull(), F.col("low")).otherwise(
        F.col("component_id")).alias("component_id"))
    return found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")).unionByName(
        found.where("n > 0").join(staged(ids, "component-ids").hint("merge"), "name").select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE worded AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded),
sets AS (SELECT min(r) AS node, s, len(s) AS n FROM (SELECT r, list_sort(s) AS s FROM shingled) GROUP BY s HAVING len(s) > 0),
tokens AS (SELECT node, n, unnest(s) AS t FROM sets),
linked AS (SELECT a.node AS a, b.node AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT node, node FROM sets UNION SELECT r.a, o.b FROM reach r JOIN linked o ON r.b = o.a),
row_sets AS (SELECT h.doc_id, len(h.s) AS n, s.node FROM shingled h LEFT JOIN sets s ON list_sort(h.s) = s.s),
least AS (SELECT node, min(doc_id) AS low FROM row_sets GROUP BY node),
named AS (SELECT r.a AS node, min(l.low) AS component_id FROM reach r JOIN least l ON r.b = l.node GROUP BY r.a)
SELECT row_sets.doc_id, CAST(row_sets.n AS BIGINT) AS n_shingles,
  CASE WHEN row_sets.n = 0 THEN row_sets.doc_id ELSE named.component_id END AS component_id
FROM row_sets LEFT JOIN named ON row_sets.node = named.node
"""
