"""SentencePiece encoding and decoding: merge-type pieces found by backtracking.

Short chunks of known characters are merged by score, pair after pair. For others Aho-Corasick
gives the longest piece at each place; from it the encoder walks to shorter prefixes. A piece may
follow another only if merging the text of both gives the two back; a bitfield remembers places
from which no tiling of the rest was found. Where every neighbour is compatible the tiling is the
one that merging by score produces.

Null texts count as empty; an empty text has the begin and end ids only. Texts of any length
are encoded whole, chunk by chunk: no piece reaches over a change from other characters to the
blank mark, or holds a character that the vocabulary lacks, so chunks cut there are
independent. Rows stay as they come, repeats too; further columns are kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, set_aside, table, text_of

BLANK = "▁"
#: Chunks and pairs of pieces kept for reuse within a task, and the longest chunk that is kept or merged directly.
KEPT, PAIRS, KEPT_LENGTH = 200_000, 200_000, 24


class Pieces:
    """The vocabulary of one model file with its encoder and decoder."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        octets = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.octets = [octets[b] for b in range(256)]
        self.piece = {i: model.id_to_piece(i) for i in ids if not (i in special or model.is_byte(i))}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        self.length = [len(self.piece.get(i, "")) for i in ids]
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("a piece holds a character that is no piece itself")
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.id):
            raise ValueError("a piece reaches over the start of a word")
        self.letters = {p for p in self.id if len(p) == 1}
        # pieces that merging never makes from their own text are no candidates
        made = {p: i for p, i in self.id.items() if self.merged(p) == [i]}
        self.shorter = [next((made[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in made), -1)
                        if (p := self.piece.get(i)) else -1 for i in ids]
        self.find = ahocorasick.Automaton()
        for p, i in made.items():
            self.find.add_word(p, i)
        self.find.make_automaton()
        self.raw = [b"" if i in special else self.piece[i].replace(BLANK, " ").encode() if i in self.piece else b"" for i in ids]
        for b, i in octets.items():
            self.raw[i] = bytes([b])
        self.fits: dict[int, bool] = {}

    def merged(self, text: str) -> list[int]:
        """Plain merging of a short text, best score first, leftmost among equals."""
        score, none = self.score, float("-inf")
        parts = list(text)
        pairs = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            # only the pairs with the new part have changed
            if i:
                pairs[i - 1] = score.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score.get(parts[i] + parts[i + 1], none)
        return [self.id[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        known = self.fits[left << 32 | right] = self.merged(self.piece[left] + self.piece[right]) == [left, right]
        return known

    def chunk(self, text: str) -> list[int]:
        """Ids of a text without the marks at its ends."""
        if len(text) <= KEPT_LENGTH and self.letters.issuperset(text):
            return self.merged(text)  # quicker than the automaton, and the definition itself
        longest, length = [-1] * len(text), self.length
        for last, i in self.find.iter(text):
            longest[last - length[i] + 1] = i  # a later end is a longer piece
        if -1 not in longest:
            return self.tiled(longest, 0, len(text))
        out, at = [], 0
        while at < len(text):
            if longest[at] < 0:
                out += [self.octets[b] for b in text[at].encode()]
                at += 1
                continue
            stop = next((n for n in range(at, len(text)) if longest[n] < 0), len(text))
            out += self.tiled(longest, at, stop)
            at = stop
        return out

    def tiled(self, longest: list[int], start: int, stop: int) -> list[int]:
        length, shorter, fits = self.length, self.shorter, self.fits
        failed = 0  # bit n: no tiling of the rest was found from place start + n
        out: list[int] = []
        at, piece, left = start, longest[start], -1
        while True:
            while piece >= 0:
                to = at + length[piece]
                if to <= stop and not (failed and failed >> (to - start) & 1):
                    if left < 0:
                        break
                    fit = fits.get(left << 32 | piece)
                    if fit or fit is None and self.compatible(left, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                if to == stop:
                    return out
                at, left, piece = to, piece, longest[to]
            else:
                failed |= 1 << (at - start)
                piece = out.pop()
                at -= length[piece]
                left = out[-1] if out else -1
                # the same piece ends at the failed place, so the walk goes on to a shorter one

    def decode(self, ids: np.ndarray) -> bytes:
        text = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == b" " else text


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Kept(dict):
    """Packed ids by chunk; long chunks are encoded anew each time."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, chunk: str) -> bytes:
        ids = packed(self.pieces.chunk(chunk))
        if len(chunk) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[chunk] = ids
        return ids


_CHUNK = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.kept = Kept(self.pieces)
        self.ends = [packed([i]) for i in (self.pieces.begin, self.pieces.end)]

    def forget(self) -> None:
        """Frees what was kept: the worker may go on with tasks of other stages."""
        self.kept.clear()
        self.pieces.fits.clear()

    def encode(self, text: str) -> bytes:
        """Packed ids with begin and end."""
        marked = (BLANK + text).replace(" ", BLANK) if text else ""
        return self.ends[0] + b"".join(map(self.kept.__getitem__, _CHUNK.findall(marked))) + self.ends[1]

    def decode(self, ids: bytes) -> str:
        return self.pieces.decode(np.frombuffer(ids, "<u4")).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each model and Python worker; tasks of the worker reuse it."""
    return Encoder(path)


def encoded(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``ids`` (unsigned 32-bit little-endian), ``n_tokens`` and
    ``decoded``; columns of these names are replaced."""
    new = ("ids", "n_tokens", "decoded")
    docs, given_back = set_aside(docs.drop(*(c for c in new if c != text)), "_text")
    source = docs.withColumn("_text", text_of(docs, text))
    kept = [c for c in source.columns if c != "_text" and c not in new]
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept),
                        "ids binary, n_tokens bigint, decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(model)
        try:
            for batch in by_size(4_000_000)(batches):
                ids = [code.encode(t) for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(ids, pa.binary()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([code.decode(x) for x in ids], pa.string())], [*kept, *new])
        finally:
            code.forget()
    return given_back(source.mapInArrow(run, schema))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, model_path()).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
