"""Substring dedup: words covered by a window of words that starts anywhere else are removed.

Levels: a quarter of the width, half of it, the width, each about twice the one before (9, 18, 35
words). A window that a contract fixes ends the doubling: words that a longer run covers are
covered by its windows of the width.

* Quarter. Of the windows of nine words only anchors are looked at: in each full window the ones
  with the least hash. Equal full windows have equal anchors, so a full window can only be
  repeated if its anchor is, and about one word in fourteen is looked at.
* Half. Anchors that repeat are extended to twice their length, to the right for the full windows
  that reach that far, to the left for the others. An anchor goes on only on a side that repeats,
  and candidates end here if neither does.
* Width. Survivors are extended once more. Where all the words that full windows on the anchor can
  reach repeat as one context, every window in it does, and they are not listed singly. All others
  are, on the sides that repeat, with one occurrence of each repeated context of the same anchor to
  compare with.

Each level groups by hash with partial sums before the shuffle; no group is gathered and no
pair is formed. Hashes compared are 64 bits of an anchor with 64 bits of what surrounds it.

Defined results: null and empty texts have no words; texts shorter than the window lose nothing.
Repeated rows are rows of their own, so both lose what they share. Windows are judged on the
input. Null ids are kept. Texts of any length are read whole. Columns other than the id and the
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_size, mixed, powers, row_key, staged, table, text_of, windows

WIDTH = 35
BATCH = 4_000_000


def _sliding(best: np.ufunc, values: np.ndarray, width: int, fill: int) -> np.ndarray:
    """best over values[i : i + width] for every i, padded with ``fill``."""
    padded = np.concatenate([values, np.full(width, fill, np.uint64)])
    span = 1
    while span * 2 <= width:
        padded = best(padded[:-span], padded[span:])
        span *= 2
    if span < width:
        padded = best(padded[:len(padded) - (width - span)], padded[width - span:])
    return padded[:len(values)]


class Anchors:
    """Anchor places of a batch of documents, with the hashes of windows and contexts."""

    def __init__(self, words: Words, width: int):
        self.width, self.short = width, max(1, width // 4 + 1)
        # on narrow widths a little less, so that every full window holds one of the two sides
        self.half = min(2 * self.short, (width + self.short + 1) // 2)
        self.reach = width - self.short
        h = words.hashes
        n = len(h)
        row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        self.begin, self.stop = words.first[:-1][row], words.first[1:][row]
        at = np.arange(n)
        short = windows(h, self.short, seed=5)
        self.short_hash = np.concatenate([short, np.zeros(n - len(short), np.uint64)])
        self.full = at + width <= self.stop
        lowest = _sliding(np.minimum, self.short_hash, self.reach + 1, 2**64 - 1)
        self.lowest = np.where(self.full, lowest, np.uint64(0))
        back = _sliding(np.maximum, self.lowest[::-1], self.reach + 1, 0)[::-1]
        self.places = np.flatnonzero((back == self.short_hash) & (back > 0))
        self.hashes = h

    def halves(self, at: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of twice the anchor, to the right and to the left.

        No full window asks for a side on which the text ends before; the context stands in there."""
        twice = windows(self.hashes, self.half, seed=11)
        back = at - (self.half - self.short)
        right, left = at + self.half <= self.stop[at], back >= self.begin[at]
        out = np.stack([mixed(context, 13), mixed(context, 14)])
        out[0, right], out[1, left] = twice[at[right]], mixed(twice[back[left]], 12)
        return out[0], out[1]

    def side(self, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The side (``RIGHT`` or ``LEFT``) on which full windows from ``start`` hold twice the anchor."""
        return np.where(at + self.half <= start + self.width, RIGHT, LEFT)

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of the words that full windows anchored at these places can reach."""
        a = np.maximum(at - self.reach, self.begin[at])
        b = np.minimum(at + self.width, self.stop[at])
        base = 0xD1342543DE82EF95
        sums = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(mixed(self.hashes, 9) * powers(base, len(self.hashes)), out=sums[1:])
        down = powers(pow(base, -1, 2**64), len(self.hashes) + 1)
        shape = (at - a).astype(np.uint64) * np.uint64(65536) + (b - at).astype(np.uint64)
        return mixed((sums[b] - sums[a]) * down[a] + mixed(shape, 4), 6), a, b


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def anchors(docs: DataFrame, width: int) -> DataFrame:
    """(_k1, _k2, anchors: array of (p, h, c, r, l)) of documents with a full window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(BATCH)(batches):
            words = Words(batch.column("_text"))
            found = Anchors(words, width)
            at = found.places
            context, _, _ = found.contexts(at)
            right, left = found.halves(at, context)
            edges = np.searchsorted(at, words.first)
            p = at - np.repeat(words.first[:-1], np.diff(edges))
            spots = pa.StructArray.from_arrays(
                [pa.array(p.astype(np.int32)), _signed(found.short_hash[at]), _signed(context), _signed(right),
                 _signed(left)], ["p", "h", "c", "r", "l"])
            out = pa.RecordBatch.from_arrays(
                [batch.column("_k1"), batch.column("_k2"), _lists(spots, np.diff(edges))], ["_k1", "_k2", "anchors"])
            yield out.filter(pa.array(np.diff(edges) > 0))
    return docs.select("_k1", "_k2", "_text").mapInArrow(
        run, "_k1 bigint, _k2 bigint, anchors array<struct<p:int,h:bigint,c:bigint,r:bigint,l:bigint>>")


#: States of a repeated anchor: its context repeats; so, and it stands for its context among
#: single windows; the context is alone.
COVERED, STANDS, ALONE = 0, 1, 2
#: Sides on which twice the anchor repeats, as bits of a sum.
RIGHT, LEFT = 1, 2


def doubled(rows: DataFrame) -> DataFrame:
    """Repeated anchors (``rows``) that also repeat at twice the length, with their ``sides``."""
    right, left = (rows.groupBy(x).count().where("count > 1").select(x, F.lit(bit).alias(f"_{x}"))
                   for x, bit in (("r", RIGHT), ("l", LEFT)))
    sides = F.coalesce("_r", F.lit(0)) + F.coalesce("_l", F.lit(0))
    return rows.join(right, "r", "left").join(left, "l", "left").select(
        "_k1", "_k2", "p", "h", "c", sides.alias("sides")).where("sides > 0")


def anchor_states(found: DataFrame) -> DataFrame:
    """(_k1, _k2, spots: array of (p, s, sides)) of the anchors that occur more than once."""
    rows = found.select("_k1", "_k2", F.explode("anchors").alias("a")).select(
        "_k1", "_k2", "a.p", "a.h", "a.c", "a.r", "a.l")
    again = rows.groupBy("h").count().where("count > 1").select("h")
    rows = staged(doubled(staged(rows.join(again, "h"), "anchors")), "doubled-anchors")
    contexts = rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("_k1", "_k2", "p")).alias("who"))
    mixed_groups = contexts.groupBy("h").agg(F.max((F.col("n") == 1).cast("int")).alias("some_alone"))
    stands = ((F.col("some_alone") == 1) & (F.col("who._k1") == F.col("_k1")) & (F.col("who._k2") == F.col("_k2"))
              & (F.col("who.p") == F.col("p")))
    state = F.when(F.col("n") == 1, ALONE).when(stands, STANDS).otherwise(COVERED)
    return (rows.join(contexts.join(mixed_groups, "h"), ["h", "c"])
            .groupBy("_k1", "_k2").agg(F.collect_set(F.struct("p", state.alias("s"), "sides")).alias("spots")))


def single_windows(docs: DataFrame, states: DataFrame, width: int) -> DataFrame:
    """(_k1, _k2, starts): full windows that repeat, of the anchors whose context is alone."""
    asked = states.select("_k1", "_k2", F.filter("spots", lambda s: s["s"] != COVERED).alias("spots")).where(
        F.size("spots") > 0)
    texts = docs.select("_k1", "_k2", "_text").join(asked, ["_k1", "_k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(BATCH)(batches):
            words = Words(batch.column("_text"))
            found = Anchors(words, width)
            spots = batch.column("spots")
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(spots).to_numpy(zero_copy_only=False))
            flat = spots.flatten()
            p = flat.field("p").to_numpy() + words.first[:-1][row]
            weight = np.where(flat.field("s").to_numpy() == STANDS, 2, 1)
            sides = flat.field("sides").to_numpy()
            start = (p[:, None] - np.arange(found.reach + 1)[None, :]).ravel()
            p, weight, row, sides = (np.repeat(x, found.reach + 1) for x in (p, weight, row, sides))
            ok = (start >= found.begin[p]) & ((found.side(p, start) & sides) > 0)
            ok[ok] = found.full[start[ok]] & (found.lowest[start[ok]] == found.short_hash[p[ok]])
            start, weight, row = start[ok], weight[ok], row[ok]
            order = np.lexsort((-weight, start))
            start, weight, row = start[order], weight[order], row[order]
            first = np.diff(start, prepend=-1) != 0
            start, weight, row = start[first], weight[first], row[first]
            whole = windows(found.hashes, width, seed=7)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k1").take(pa.array(row)), batch.column("_k2").take(pa.array(row)),
                 pa.array((start - words.first[:-1][row]).astype(np.int32)), _signed(found.lowest[start]),
                 _signed(whole[start]), pa.array(weight.astype(np.int32))], ["_k1", "_k2", "start", "h", "w", "n"])
    import pyarrow.compute  # noqa: F401

    rows = staged(texts.mapInArrow(run, "_k1 bigint, _k2 bigint, start int, h bigint, w bigint, n int"), "windows")
    again = rows.groupBy("h", "w").agg(F.sum("n").alias("total")).where("total > 1").select("h", "w")
    return rows.join(again, ["h", "w"]).groupBy("_k1", "_k2").agg(F.collect_set("start").alias("starts"))


def deduplicated(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words of each document joined by one blank."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(docs, text).alias("_text"))
    keyed = rows.select("doc_id", "_text", *row_key("doc_id", "_text"))
    states = staged(anchor_states(staged(anchors(keyed, width), "all-anchors")), "anchor-states")
    starts = staged(single_windows(keyed, states, width), "repeated-windows")
    marks = states.join(starts, ["_k1", "_k2"], "full").select(
        "_k1", "_k2", F.transform(F.filter("spots", lambda s: s["s"] != ALONE), lambda s: s["p"]).alias("spots"), "starts")
    reach = width - max(1, width // 4 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(BATCH)(batches):
            words, removed, kept = [], [], []
            for text, spots, starts in zip(batch.column("_text"), batch.column("spots"), batch.column("starts"), strict=True):
                split = text.as_py().encode().split()
                n = len(split)
                gone = np.zeros(n + 1, np.int64)
                if (p := spots.values) is not None and len(p):
                    p = p.to_numpy()
                    np.add.at(gone, np.maximum(p - reach, 0), 1)
                    np.add.at(gone, np.minimum(p + width, n), -1)
                if (p := starts.values) is not None and len(p):
                    p = p.to_numpy()
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + width, -1)
                stay = np.cumsum(gone[:-1]) == 0
                left = int(stay.sum())
                words.append(n)
                removed.append(n - left)
                kept.append(b" ".join(split if left == n else compress(split, stay.tolist())).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(
                removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return keyed.join(marks, ["_k1", "_k2"], "left").select("doc_id", "_text", "spots", "starts").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH words AS (SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w
  FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM words, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i) WHERE len(w) >= 35),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM starts) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range(35) r(k)),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT f.doc_id, string_agg(word, ' ' ORDER BY f.i) AS kept, count(*) AS n
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.i = g.i WHERE g.i IS NULL GROUP BY f.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
