"""LM scoring: context-tree weighting over bytes, with an add-one unigram of words beside it.

The coded text is its words in lower case (ASCII), each followed by a blank, and an end byte. Every
byte is eight binary decisions, each in the context of the bits before it and of up to ``DEPTH``
bytes before that. Counts of bytes in their longest contexts, over all training documents, sum
up to the counts of every shorter context. Krichevsky-Trofimov block probabilities are mixed from
the longest contexts to none, half for a node's own and half for the product of its children;
the resulting weights give every byte its probability, and log2 of it, summed, the code length.

Texts are packed into batches, which are worked on ``CHUNK`` bytes at a time. Each batch names its
distinct words and its distinct byte strings of a context and what follows, gets for each the count
or the log probability, and adds them up. The larger a batch, the fewer copies of a string travel.
Strings travel as lists: those of a batch that share the last ``TOP`` bytes of context are one
compressed row, meet the lists of other batches in the task of that context, and go back with a log
probability each. Words travel the same way: those of a batch that share the first ``WORD_BITS``
bits of their hash are one row, and go back with their counts. A task folds lists as they come, so
it holds the distinct strings of one context and not their copies. Nothing is broadcast but 65,536 nodes of the top, and what is
exchanged grows with the texts.

Defined results: null texts count as empty; an empty text is one end token and one end byte. Rows
with a null id are held out by no remainder, so they are trained on. Repeated rows are rows of
their own. Without training documents counts are 0 and every bit has probability 1/2. Words are
told apart by 64-bit hashes. Further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_size, staged, table, text_of

DEPTH = 6
BATCH, CHUNK = 12_000_000, 3_000_000
END = 10
#: Context bytes that keep strings together in a task.
TOP = 2
#: Bytes of a string that its context of TOP bytes leaves open.
OPEN = DEPTH + 1 - TOP
#: Bits of a word's hash that keep words together in a task, and bytes that hold the others.
WORD_BITS = 10
OPEN_WORD = -(-(64 - WORD_BITS) // 8)
#: Strings of small contexts that a task works on at a time, and copies it holds before it folds them.
STRINGS, COPIES = 100_000, 2_000_000


def coded(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all coded texts of a batch, and where each starts and the last ends."""
    lengths = words.ends - words.starts + 1
    counts = np.diff(words.first)
    total = np.concatenate([[0], np.cumsum(lengths)])
    starts = total[words.first] + np.arange(len(words.first))
    out = np.full(int(starts[-1]), 32, np.uint8)
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts] += 1  # a row may start a word where the one before it ends
    inside[words.ends] -= 1
    used = np.cumsum(inside[:-1], dtype=np.int8) > 0
    word = np.repeat(np.arange(len(lengths)), lengths - 1)
    # byte n of the used ones moves on by the blanks and end bytes before it
    out[np.arange(int(used.sum())) + word + row[word]] = words.data[used]
    out[starts[1:] - 1] = END
    out[(out >= 65) & (out <= 90)] += 32
    return out, starts


def strings(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte the DEPTH bytes before it, the nearest first, and itself in one number.

    End bytes stand before a text."""
    out = body.astype(np.int64)
    for d in range(1, DEPTH + 1):
        out[d:] |= body[:-d].astype(np.int64) << (8 * (DEPTH + 1 - d))
    for place in range(DEPTH):  # what stands before a text is not the text before it
        at = starts[:-1][np.diff(starts) > place] + place
        before = 8 * (DEPTH - place)
        ends = sum(END << (8 * d) for d in range(1, DEPTH + 1 - place))
        out[at] = out[at] >> before << before | ends | out[at] & 255
    return out


def ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    code, known = pd.factorize(values)
    order = np.argsort(known)
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    return known[order], place[code]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of all parts in order, and for each part the places of its values among them."""
    known = np.concatenate([values for values, _ in parts])
    known.sort(kind="stable")  # merges what each part holds in order, without a hash table
    known = known[np.diff(known, prepend=known[:1] - 1) != 0]
    return known, [np.searchsorted(known, values).astype(np.int32)[code] for values, code in parts]


def planes(x: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of whole numbers, all first bytes first, compressed."""
    return zstandard.compress(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 3)


def numbers(planed: pa.Scalar, width: int) -> np.ndarray:
    got = np.frombuffer(zstandard.decompress(planed.as_buffer()), np.uint8).reshape(width, -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, :width] = got.T
    return out.view("<i8").ravel()


def float_planes(x: np.ndarray) -> bytes:
    return planes(x.astype("<f4").view("<i4"), 4)


def floats(planed: pa.Scalar) -> np.ndarray:
    return numbers(planed, 4).astype("<i4").view("<f4")


def lists(known: np.ndarray, counts: np.ndarray, shift: int = 8 * OPEN, width: int = OPEN) -> pa.Array:
    """Strings (or words) in order, cut where what stands above ``shift`` bits changes: that as ``b``, keys, counts."""
    top = known >> shift
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(known)]])
    spans = list(zip(cuts[:-1], cuts[1:])) if len(known) else []
    return pa.StructArray.from_arrays(
        [pa.array([int(top[i]) for i, _ in spans], pa.int32()),
         pa.array([planes(known[i:j], width) for i, j in spans], pa.binary()),
         pa.array([planes(counts[i:j], 4) for i, j in spans], pa.binary())], ["b", "k", "c"])


def batches(docs: DataFrame, size: int = BATCH, chunk: int = CHUNK) -> DataFrame:
    """One row for each batch: ids and marks, the coded texts, distinct words and strings with
    their counts in training documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(size)(parts):
            bodies, firsts, end = [], [np.zeros(1, np.int64)], 0
            found = [], []
            for part in by_size(chunk)(iter([batch])):
                words = Words(part.column("_text"), lower=True)
                body, starts = coded(words)
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)
                for held, values, first in zip(found, (words.hashes.view(np.int64), strings(body, starts)), (words.first, starts)):
                    known, code = ordered(values)
                    held.append((known, np.bincount(code, weights=np.repeat(train, np.diff(first)), minlength=len(known)).astype(np.int32)))
                bodies.append(body.tobytes())
                firsts.append(starts[1:] + end)
                end += len(body)
            (named, word_counts), (known, counts) = [_folded(*zip(*held)) for held in found]
            of_words = lists(named, word_counts, 64 - WORD_BITS, OPEN_WORD)
            of_strings = lists(known, counts)
            held = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (of_words, of_strings)]
            ends = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65]), pa.ListArray.from_arrays(ends, batch.column("doc_id")),
                 pa.ListArray.from_arrays(ends, batch.column("held_out")),
                 pa.array([np.concatenate(firsts).astype(np.int64).tobytes()], pa.binary()),
                 pa.array([zstandard.compress(b"".join(bodies), 3)], pa.binary()), *held],
                ["batch", "ids", "held", "starts", "body", "words", "strings"])
    return docs.select("doc_id", "held_out", "_text").mapInArrow(run, f"""batch bigint, ids array<{kind}>,
        held array<boolean>, starts binary, body binary, words array<struct<b:int,k:binary,c:binary>>,
        strings array<struct<b:int,k:binary,c:binary>>""")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series for x + 8, brought back to x > 0."""
    y = x + 8
    product = np.multiply.reduce([x + k for k in range(8)])
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) - np.log(product)


def block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Subtrees:
    """Nodes of depth ``top`` and more of some strings, every string eight decisions."""

    def __init__(self, h: np.ndarray, c: np.ndarray, top: int = TOP + 1):
        self.top, k = top, np.arange(8)
        sym = (h & 255)[:, None]
        self.at = ((256 | sym) >> (8 - k)).ravel()
        self.bit = ((sym >> (7 - k)) & 1).ravel()
        weight = np.repeat(c, 8).astype(np.float64)
        self.levels = {}
        below = None
        for depth in range(DEPTH, top - 1, -1):
            code, names = pd.factorize((h[:, None] >> (8 * (DEPTH + 1 - depth)) << 8 | self.at.reshape(-1, 8)).ravel())
            n1 = np.bincount(code, weights=weight * self.bit, minlength=len(names))
            n = np.bincount(code, weights=weight, minlength=len(names))
            kt = block(n - n1, n1)
            first = np.empty(len(names), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            if below is None:
                mix, own = kt, np.ones(len(names))
            else:
                mix = np.logaddexp(kt, np.bincount(code[below[0]], weights=below[1], minlength=len(names))) - np.log(2)
                own = np.exp(kt - np.log(2) - mix)
            below = first, mix
            self.levels[depth] = code.astype(np.int32), names, n - n1, n1, mix, own

    def probabilities(self) -> np.ndarray:
        """Of each decision, as the nodes of depth ``top`` see it."""
        p = np.full(len(self.bit), 0.5)
        for depth in range(DEPTH, self.top - 1, -1):
            code, _, n0, n1, _, own = self.levels[depth]
            one = ((n1 + 0.5) / (n0 + n1 + 1))[code]
            p = own[code] * np.where(self.bit == 1, one, 1 - one) + (1 - own[code]) * p
        return p


class Contexts:
    """Nodes of depth ``TOP`` of the strings of whole contexts, from the ``Subtrees`` of ``STRINGS`` strings at a time.

    ``TOP`` bytes of context stay together in a task; what is above is summed up from the tasks. A
    large context is cut where its next byte changes, so that only sums of a cut stay when the next begins."""

    def __init__(self, h: np.ndarray, c: np.ndarray, scored: bool):
        new = np.flatnonzero(np.diff(h >> (8 * (OPEN - 1)))) + 1
        cuts, nodes, self.p, self.names = [0], [], [], None
        for i, j in zip(np.append(0, new), np.append(new, len(h))):
            if j - cuts[-1] > STRINGS and i > cuts[-1]:
                cuts.append(i)
        cuts.append(len(h))
        for i, j in zip(cuts[:-1], cuts[1:]):
            tree = Subtrees(h[i:j], c[i:j])
            _, names, n0, n1, mix, _ = tree.levels[TOP + 1]
            nodes.append((names >> 16 << 8 | names & 255, n0, n1, mix))
            if scored:
                self.p.append(tree.probabilities())
        names, n0, n1, below = (np.concatenate(x) for x in zip(*nodes))
        self.names, place = ordered(names)
        self.n0, self.n1, below = (np.bincount(place, weights=x, minlength=len(self.names)) for x in (n0, n1, below))
        kt = block(self.n0, self.n1)
        self.mix = np.logaddexp(kt, below) - np.log(2)
        self.own = np.exp(kt - np.log(2) - self.mix)
        self.h, self.cuts = h, cuts

    def scores(self, tops: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 of the probability of each string's last byte, ``tops`` being the levels above."""
        out = []
        for i, j, p in zip(self.cuts[:-1], self.cuts[1:], self.p):
            sym = (self.h[i:j] & 255)[:, None]
            at, bit = ((256 | sym) >> (8 - np.arange(8))).ravel(), ((sym >> (7 - np.arange(8))) & 1).ravel()
            place = np.searchsorted(self.names, np.repeat(self.h[i:j] >> (8 * OPEN), 8) << 8 | at)
            names = np.repeat(self.h[i:j] >> (8 * DEPTH), 8) << 8 | at
            for one, own, where in [((self.n1 + 0.5) / (self.n0 + self.n1 + 1), self.own, place),
                                    *((one, own, names & (len(one) - 1)) for one, own in tops)]:
                p = own[where] * np.where(bit == 1, one[where], 1 - one[where]) + (1 - own[where]) * p
            out.append(np.log10(p).reshape(-1, 8).sum(axis=1))
        return np.concatenate(out)


def _folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of lists in order, and the sums of their counts: the lists are merged, without a hash table."""
    known, total = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    if not len(known):
        return known, total
    order = np.argsort(known, kind="stable")
    known, total = known[order], total[order]
    new = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))
    return known[new], np.add.reduceat(total, new)


def _rows(rows: Iterator[tuple], schema: pa.Schema, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``size`` bytes of the binary values in ``rows``."""
    held, bytes_ = [], 0
    for row in rows:
        held.append(row)
        bytes_ += 16 + sum(len(x) for x in row if isinstance(x, bytes))
        if bytes_ >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, bytes_ = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def list_counts(asked: DataFrame, width: int) -> DataFrame:
    """(b, k, c, n, v): a row for each ``b``, its distinct keys, their counts in all batches, the
    sum of the counts and how many are not 0."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(b: int, keys: list, counts: list) -> tuple:
            known, total = _folded(keys, counts)
            return b, planes(known, width), planes(total, 8), int(total.sum()), int((total > 0).sum())

        def whole() -> Iterator[tuple]:
            now, keys, counts, size = None, [], [], 0
            for part in parts:
                for b, k, c in zip(*[part.column(x) for x in "bkc"]):
                    if b.as_py() != now:
                        if keys:
                            yield row(now, keys, counts)
                        now, keys, counts, size = b.as_py(), [], [], 0
                    keys.append(numbers(k, width))
                    counts.append(numbers(c, 4))
                    size += len(keys[-1])
                    if size >= COPIES:
                        known, total = _folded(keys, counts)
                        keys, counts, size = [known], [total], 0
            if keys:
                yield row(now, keys, counts)
        return _rows(whole(), pa.schema([("b", pa.int32()), ("k", pa.binary()), ("c", pa.binary()), ("n", pa.int64()), ("v", pa.int64())]))
    return asked.select("b", "k", "c").repartition("b").sortWithinPartitions("b").mapInArrow(
        run, "b int, k binary, c binary, n bigint, v bigint")


def _gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Contexts, how many strings each has, the strings and their counts, many contexts at a time."""
    tops, keys, counts = [], [], []
    for part in parts:
        for b, k, c in zip(*[part.column(x) for x in "bkc"]):
            tops.append(b.as_py())
            keys.append(numbers(k, OPEN) | tops[-1] << (8 * OPEN))
            counts.append(numbers(c, 8))
            if sum(map(len, keys)) >= STRINGS:
                yield tops, list(map(len, keys)), np.concatenate(keys), np.concatenate(counts)
                tops, keys, counts = [], [], []
    if tops:
        yield tops, list(map(len, keys)), np.concatenate(keys), np.concatenate(counts)


def string_scores(totals: DataFrame) -> DataFrame:
    """(b, k, s): for each context its strings and log10 of the probability of their last bytes."""
    def roots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, h, c in _gathered(parts):
            tree = Contexts(h, c, False)
            upper = pd.DataFrame({"name": tree.names >> 16 << 8 | tree.names & 255, "n0": tree.n0, "n1": tree.n1, "mix": tree.mix})
            yield pa.RecordBatch.from_pandas(upper.groupby("name", as_index=False).sum(), preserve_index=False)
    nodes = totals.mapInArrow(roots, "name bigint, n0 double, n1 double, mix double")
    # a name is now a context of one byte and then the bits: 256 x 256 nodes at most
    upper = nodes.groupBy("name").agg(*[F.sum(x).alias(x) for x in ("n0", "n1", "mix")]).toPandas()
    table_ = np.zeros((3, 65536))
    table_[:, upper["name"].to_numpy(np.int64)] = upper[["n0", "n1", "mix"]].to_numpy().T
    tops = []
    for _ in range(TOP):
        kt = block(table_[0], table_[1])
        mix = np.logaddexp(kt, table_[2]) - np.log(2)
        tops.append(((table_[1] + 0.5) / (table_[0] + table_[1] + 1), np.exp(kt - np.log(2) - mix)))
        table_ = np.stack([x.reshape(-1, 256).sum(axis=0) for x in (table_[0], table_[1], mix)])

    def logs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[tuple]:
            for contexts, sizes, h, c in _gathered(parts):
                s = Contexts(h, c, True).scores(tops)
                first = np.concatenate([[0], np.cumsum(sizes)])
                for b, i, j in zip(contexts, first[:-1], first[1:]):
                    yield b, planes(h[i:j], OPEN), float_planes(s[i:j])
        return _rows(whole(), pa.schema([("b", pa.int32()), ("k", pa.binary()), ("s", pa.binary())]))
    return totals.mapInArrow(logs, "b int, k binary, s binary")


def answers(asked: DataFrame, known: DataFrame, width: int = OPEN, value: int = 4) -> DataFrame:
    """(batch, b, s): the values of ``value`` bytes that ``known`` (b, k, s) gives to the keys of
    each list, in the order of the list."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[tuple]:
            have = None
            for part in parts:
                for batch, b, k, s in zip(*[part.column(x) for x in ("batch", "b", "k", "s")]):
                    if s.is_valid:  # a row of what is known comes before those that ask
                        have = numbers(k, width), numbers(s, value)
                    else:
                        yield batch.as_py(), b.as_py(), planes(have[1][np.searchsorted(have[0], numbers(k, width))], value)
        return _rows(whole(), pa.schema([("batch", pa.int64()), ("b", pa.int32()), ("s", pa.binary())]))
    both = known.select(F.lit(None).cast("long").alias("batch"), "b", "k", "s").union(
        asked.select("batch", "b", "k", F.lit(None).cast("binary")))
    return both.repartition("b").sortWithinPartitions("b", F.col("s").isNull()).mapInArrow(run, "batch bigint, b int, s binary")


def scored(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text",
           size: int = BATCH, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of(docs, text).alias("_text"))
    packed = staged(batches(rows, size, chunk), "batches")
    words, asked = [packed.select("batch", F.inline(x)) for x in ("words", "strings")]
    word_counts = staged(list_counts(words, OPEN_WORD), "word-counts")
    totals = staged(list_counts(asked, OPEN), "string-counts")

    def by_batch(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("b", "s"))).alias(name))
    word_answers = by_batch(answers(words, word_counts.withColumnRenamed("c", "s"), OPEN_WORD, 8), "word_counts")
    by_string = by_batch(answers(asked, string_scores(totals)), "string_scores")
    whole = word_counts.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    ends = rows.where(~F.col("held_out")).count()
    n, v = (whole["n"] or 0) + ends, (whole["v"] or 0) + (1 if ends else 0)
    low = float(np.log10(n + v + 1))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        return total[first[1:]] - total[first[:-1]]

    def chunks(starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Texts of about ``chunk`` bytes, one at least."""
        at = 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + chunk, "right")) - 1)
            yield at, to
            at = to

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for j in range(batch.num_rows):
                starts = np.frombuffer(batch.column("starts")[j].as_py(), np.int64)
                body = np.frombuffer(zstandard.decompress(batch.column("body")[j].as_py()), np.uint8)
                firsts, inside, by_word, by_byte = [], [], [], []
                for at, to in chunks(starts):
                    mine, here = body[starts[at]:starts[to]], starts[at:to + 1] - starts[at]
                    sized = pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(here.tobytes()), pa.py_buffer(mine.tobytes()))
                    text = Words(sized, lower=True)  # the same words in the same order as when packed
                    firsts.append(text.first)
                    inside.append(here)
                    for held, values in ((by_word, text.hashes.view(np.int64)), (by_byte, strings(mine, here))):
                        known, code = ordered(values)
                        held.append((known, code.astype(np.int32)))
                names, word_codes = merged(by_word)
                _, byte_codes = merged(by_byte)
                lists_ = batch.column("word_counts")[j].values  # null where no text has a word
                counts = np.concatenate([numbers(x, 8) for x in lists_.field("s")]) if len(names) else np.zeros(0)
                logs = np.concatenate([floats(x) for x in batch.column("string_scores")[j].values.field("s")])
                got = [(np.diff(first) + 1, sums(counts[words] > 0, first), sums(np.log10(counts[words] + 1), first), sums(logs[bytes_], here))
                       for first, here, words, bytes_ in zip(firsts, inside, word_codes, byte_codes)]
                tokens, known, base, score = [np.concatenate(x) for x in zip(*got)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[j].values, batch.column("held")[j].values, pa.array(tokens),
                     pa.array((known + (ends > 0)).astype(np.int64)), pa.array(np.full(len(tokens), n)),
                     pa.array(base + np.log10(ends + 1) - tokens * low), pa.array(score), pa.array(np.diff(starts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])
    texts = packed.select("batch", "ids", "held", "starts", "body").join(
        word_answers, "batch", "left").join(by_string, "batch").drop("batch")
    return texts.mapInArrow(run, f"""doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint,
        train_tokens bigint, base_score double, score double, n_bytes bigint""")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return scored(docs, held).withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / F.col("n_bytes"))
