"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous rounds.

Pieces over half a sequence open sequences; the gaps that they leave wait for shorter pieces. Pieces go by
classes of falling length, each from a half to the whole of the class before. In a round, the pieces of a class and
the gaps that can hold its least are sorted by range. Each range is swept from large to small: a piece takes its
successor, the smallest gap that holds it, and what is left of a gap is a gap again. Between ranges, pieces
that found no gap and gaps that no piece took match by rank, as closing brackets match opening ones; then the
gaps are updated, and the round is repeated until no piece moves. What is left of the class then opens
sequences. Where all that is left fits one range, its classes are one; a sweep is then best-fit decreasing itself.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordsync.llm._common import map_frames, materialise

CAPACITY = 2048
#: Pieces and gaps in a range of a sweep.
RANGE_ROWS = 250_000
#: Words whose ids a worker keeps, about 110 MB of them; then it starts anew. Characters that are encoded at once.
_CACHED_WORDS, _CHUNK = 500_000, 2_000_000
_MARKS = ("♻", "☯", "⚓", "♞", "☂", "|", "~")
# An ASCII letter and an ASCII mark behind it, but for the apostrophe: no token reaches over that place.
_BORDER = "([a-z])([!-&(-/:-@\\[-`{-~])"


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, one space-separated word at a time.

    Right for lower-casing tokenizers whose words reach neither over white space nor from letters to
    marks: A-Z are lower-cased and words are cut between an ASCII letter and a mark. Ids of words are kept.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        #: Texts with one of the tokenizer's own tokens, in any case, are left as they are.
        own = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = f"(?i){'|'.join(own)}" if own else ""
        #: A word of one id that stands between others where many are encoded at once.
        ids = {m: self._ids([m])[0] for m in _MARKS}
        self.mark = next(((m, i[0]) for m, i in ids.items() if len(i) == 1), None)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: all in one text, or one by one where some word has the mark's id as well."""
        if self.mark:
            mark, number = self.mark
            ids = np.array(self._ids([f" {mark} ".join([*words, ""])])[0], "<u4")
            ends = np.flatnonzero(ids == number)
            if len(ends) == len(words):
                data = ids.tobytes()
                starts = [0, *(4 * (ends[:-1] + 1)).tolist()]
                self.known.update((w, data[i:j]) for w, i, j in zip(words, starts, (4 * ends).tolist(), strict=True))
                return
        self.known.update((w, np.array(i, "<u4").tobytes()) for w, i in zip(words, self._ids(words), strict=True))

    def _add(self, words: list[str]) -> None:
        plain = [w for w in words if w.isascii()]
        for i in range(0, len(plain), 5_000):
            self._learn(plain[i : i + 5_000])
        odd = [w for w in words if not w.isascii()]
        # The tokenizer is slow over long texts with letters beyond ASCII.
        self.known.update((w, np.array(i, "<u4").tobytes()) for w, i in zip(odd, self._ids(odd), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words are cut, told apart and put together again by Arrow."""
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) < _CHUNK):
                size += len(texts[end])
                end += 1
            plain = pc.replace_substring(pa.array(texts[at:end], pa.large_string()), "\n", " ")
            # Small letters join with more marks than capitals do, so these are left to the tokenizer.
            lower = pc.if_else(pc.match_substring_regex(plain, "[A-Z]\\p{M}"), plain, pc.ascii_lower(plain))
            parted = pc.replace_substring_regex(lower, _BORDER, "\\1 \\2")
            if self.special:
                parted = pc.if_else(pc.match_substring_regex(plain, self.special), plain, parted)
            words = pc.split_pattern(parted, " ")
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(self.known) > _CACHED_WORDS:
                self.known = {"": b""}
            get = self.known.get
            if new := [w for w in distinct if get(w) is None]:
                self._add(new)
            ids = pa.array([get(w) for w in distinct], pa.large_binary()).take(coded.indices)
            start, data = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1), ids.buffers()[2]
            cuts = start[np.asarray(words.offsets) - words.offsets[0].as_py()].tolist()
            data = memoryview(data) if data is not None else b""
            out += [bytes(data[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            at = end
        return out


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document: its ids, then id 0, cut where longer than ``capacity``.

    A null text is empty and gives one piece of length 1.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, step = shared_encoder(tokenizer), 4 * capacity
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                rows = []
                part = pdf.iloc[at : at + 1024]
                for doc_id, ids in zip(part["doc_id"], encoder.encode([t or "" for t in part["text"]]), strict=True):
                    ids += b"\0\0\0\0"
                    rows += [(doc_id, i // step, i // 4, len(ids[i : i + step]) // 4, zlib.crc32(ids[i : i + step])) for i in range(0, len(ids), step)]
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_frames(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


#: What comes out of a sweep: a placed piece, a piece without a gap, a gap, a gap too small for its range.
_PLACED, _WAITING, _GAP, _SMALL = range(4)


def sweep(sizes: list[int], kinds: list[int], ids: list[int], opens: bool, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (what, id, sequence, size, rank) from gaps (kind 0, id their sequence) and pieces (kind 1) in falling order of size.

    Each piece takes the smallest gap that holds it; with ``opens``, one without a gap opens the sequence of its own
    id. Pieces without a gap and gaps are ranked from 0 in falling order.
    """
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, out, waiting = 0, [], 0
    for size, kind, i in zip(sizes, kinds, ids, strict=True):
        if kind == 0:
            gap, sequence = size, i
        elif holds := there >> size:
            gap = size + (holds & -holds).bit_length() - 1
            sequence = gaps[gap].pop()
            if not gaps[gap]:
                there ^= 1 << gap
            out.append((_PLACED, i, sequence, size, -1))
            gap -= size
        elif opens:
            out.append((_PLACED, i, i, size, -1))
            gap, sequence = capacity - size, i
        else:
            out.append((_WAITING, i, -1, size, waiting))
            waiting += 1
            continue
        if gap:
            gaps[gap].append(sequence)
            there |= 1 << gap
    least, rank = sizes[-1] if sizes else 0, 0
    for gap in range(capacity, 0, -1):
        for sequence in gaps[gap]:
            out.append((_GAP, -1, sequence, gap, rank) if gap >= least else (_SMALL, -1, sequence, gap, -1))
            rank += 1
    return out


def _swept(events: DataFrame, opens: bool, capacity: int, range_rows: int, n: int) -> DataFrame:
    """A sweep over each range of ``events`` (size, kind, id); part: the range's number, in falling order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"size": [], "kind": [], "id": []}, dtype=np.int64)])
        out = sweep(rows["size"].tolist(), rows["kind"].tolist(), rows["id"].tolist(), opens, capacity)
        yield pd.DataFrame(out, columns=["what", "id", "sequence", "size", "rank"]).assign(part=TaskContext.get().partitionId())

    order = [F.desc("size"), "kind", "id"]
    ranges = events.repartitionByRange(max(1, -(-n // range_rows)), *order).sortWithinPartitions(*order)
    return materialise(ranges.mapInPandas(run, "what int, id long, sequence long, size long, rank long, part int"))


def _bracketed(found: DataFrame) -> DataFrame | None:
    """Waiting pieces and the gaps of ranges before theirs that they take: (id, sequence, size, left)."""
    held = {r[0]: (r[1], r[2]) for r in found.groupBy("part").agg(F.count_if(F.col("what") == _WAITING), F.count_if(F.col("what") == _GAP)).collect()}
    at, depths = 0, []  # a row for each range
    for part in sorted(held):
        depths.append((part, at, at - held[part][0]))
        at += held[part][1] - held[part][0]
    if not any(held[p][0] and any(held[q][1] for q in held if q < p) for p in held):
        return None
    spark = found.sparkSession
    depth = F.broadcast(spark.createDataFrame(depths, "part int, first long, then long"))
    level = F.when(F.col("what") == _WAITING, F.col("first") - F.col("rank")).otherwise(F.col("then") + F.col("rank") + 1)
    rows = found.where(F.col("what").isin(_WAITING, _GAP)).join(depth, "part").withColumn("level", level)
    # A level has at most two rows of each range.
    along = Window.partitionBy("level").orderBy("part", "what")
    rows = rows.withColumn("before", F.lag(F.struct("what", "sequence", "size")).over(along))
    rows = rows.where((F.col("what") == _WAITING) & (F.col("before.what") == _GAP))
    return materialise(rows.select("id", F.col("before.sequence").alias("sequence"), "size", (F.col("before.size") - F.col("size")).alias("left")))


def assign(lengths: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(id, sequence)`` for each row of ``lengths`` (id, size): packed best-fit; a sequence has the id of the piece that opened it."""
    big = F.col("size") > capacity // 2
    done = [lengths.where(big).select("id", F.col("id").alias("sequence"))]
    gaps = lengths.where(big & (F.col("size") < capacity)).select(F.col("id").alias("sequence"), (capacity - F.col("size")).alias("size"))
    rest, top, small = lengths.where(~big), capacity // 2, []
    n_rest, n_gaps = (lengths.agg(F.count_if(~big), F.count_if(big & (F.col("size") < capacity))).first())
    while n_rest:
        low = top // 2 if n_rest + n_gaps > range_rows else 0
        inside = F.col("size") > low
        now, rest = rest.where(inside), rest.where(~inside)
        # Gaps that hold no piece of this class wait for a later one.
        small.append(gaps.where(~inside))
        gaps = gaps.where(inside)
        opens, n = False, n_rest + n_gaps
        while True:
            events = now.select("size", F.lit(1).cast("long").alias("kind"), "id").unionByName(gaps.select("size", F.lit(0).cast("long").alias("kind"), F.col("sequence").alias("id")))
            found = _swept(events, opens, capacity, range_rows, n)
            done.append(found.where(F.col("what") == _PLACED).select("id", "sequence"))
            now = found.where(F.col("what") == _WAITING).select("id", "size")
            gaps = found.where(F.col("what").isin(_GAP, _SMALL)).select("sequence", "size")
            if opens:
                break
            taken = _bracketed(found)
            if taken is None:
                opens = True
                continue
            done.append(taken.select("id", "sequence"))
            now = now.join(taken.select("id"), "id", "left_anti")
            gaps = gaps.join(taken.select("sequence"), "sequence", "left_anti").unionByName(taken.where("left > 0").select("sequence", F.col("left").alias("size")))
        gaps = functools.reduce(DataFrame.unionByName, [gaps, *small])
        small, top = [], low
        n_rest, n_gaps = rest.count() if low else 0, gaps.count() if low else 0
    return functools.reduce(DataFrame.unionByName, done)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The pieces of ``docs`` and their sequence_id and offset, packed best-fit in falling order of length.

    range_rows: pieces and gaps that one task sweeps. Repeated rows and null ids are packed like others; no rows
    give no rows. Other columns are not looked at.
    """
    cut = materialise(pieces(docs, tokenizer, capacity).withColumn("id", F.monotonically_increasing_id()))
    placed = assign(cut.select("id", F.col("length").alias("size")), capacity, range_rows)
    # At most ``capacity`` pieces to a sequence.
    before = Window.partitionBy("sequence").orderBy(F.desc("length"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(placed, "id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )
