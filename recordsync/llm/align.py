"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Tokens of A (byte-level) and of B (pieces with byte fallback) that cover a common byte of a text are linked. A posting says for one pair of ids in
which documents of a chunk it is linked, and how often: a bitmap of documents for each binary digit of the number of links
(a plane). Bitmaps are lists of 16-bit places, or 8,192 bytes where 4,096 places or more are set. The planes, OR-ed, and their bits
counted, give a pair's documents; the planes, weighted, its links. Joined with the counts of the whole corpus the same postings hand each
document its scores back. A chunk holds what one task has read, up to 65,536 documents or four million entries, so a pair that is everywhere is as many rows as
there are chunks, and no task gathers a pair.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordsync.llm._common import materialise

#: A single space between two characters that are no white space: both tokenizers part there, whatever stands around.
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Other white space beside a space, or a space at an end: such texts are cut by _GAP, all others at every space.
_ODD = "^ | $| [\\t-\\r\\x1c-\\x1f\\x{85}\\p{Z}]|[\\t-\\r\\x1c-\\x1f\\x{85}\\p{Z}] "
#: Characters of texts handled at once, characters encoded in one call, places of a chunk, entries of a chunk, places of a list.
_CHUNK, _CALL, _PLACES, _ENTRIES, _SPARSE = 4_000_000, 50_000, 65_536, 4_000_000, 4_096
_BITMAP = _PLACES // 8


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Tokens of units, that is of stretches of text between places where both tokenizers part, and how they are linked."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters, entries = byte_letters(), self.a.get_vocab()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters.get(c, 63) for c in entry)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Where a piece holds a space behind another letter, texts are left whole.
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)
        na, nb = len(self.a_bytes), len(self.b_bytes)
        self.numbers = pa.array([f"{i}{mark}".encode() for n, mark in ((na, ","), (na, "|"), (nb, ","), (nb, ";")) for i in range(n)], pa.large_binary())
        self.number_size = np.array([*map(len, self.numbers.to_pylist())], np.int64)

    def units(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Units of all texts, those of the texts without odd white space first; the order of the texts, and where each one's units end."""
        array = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(array, _ODD).to_numpy(zero_copy_only=False) if self.parts else np.ones(len(texts), bool)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        plain = pc.split_pattern(array.filter(pa.array(~odd)), " ")
        others = [_GAP.split(texts[i]) if self.parts else [texts[i]] for i in np.flatnonzero(odd)]
        flat = pa.concat_arrays([plain.flatten().cast(pa.large_string()), pa.array([u for o in others for u in o], pa.large_string())])
        return flat, order, np.cumsum(np.concatenate([pc.list_value_length(plain).to_numpy(zero_copy_only=False), [*map(len, others)]]).astype(np.int64))

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        return [e.ids for e in encode([f" {t}" for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of both are the bytes of the text."""
        want = b" " + text.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want

    def tokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B over all units, and the units' sizes in bytes; 0 for units that some tokenizer changes: they have no tokens."""
        size = np.array([len(u.encode()) + 1 for u in units], np.int64)
        cuts, at = [0], 0
        for i, u in enumerate(units):
            # White space at a unit's end would join with the space before its neighbour.
            if (odd := u[0].isspace() or u[-1].isspace()) and at:
                cuts.append(i)
            at += len(u) + 1
            if odd or at >= _CALL or i == len(units) - 1:
                cuts.append(i + 1)
                at = 0
        a_ids, b_ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        joined = [" ".join(units[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        for text, i, j, a, b in zip(joined, cuts[:-1], cuts[1:], *self._ids(joined), strict=True):
            if not self._same(text, a, b):
                ids = self._ids(units[i:j])
                keep = [self._same(u, x, y) for u, x, y in zip(units[i:j], *ids, strict=True)]
                a, b = ([t for k, x in zip(keep, side, strict=True) if k for t in x] for side in ids)
                size[i:j] *= np.array(keep)
            a_ids.append(np.array(a, np.int64))
            b_ids.append(np.array(b, np.int64))
        return np.concatenate(a_ids), np.concatenate(b_ids), size

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Counts and digests of each text, none of them empty; then entries: place of the text, pair (id of A * 2^32 + id of B), number of links."""
        flat, order, ends = self.units(texts)
        coded = flat.dictionary_encode()
        code, n_units = coded.indices.to_numpy(), len(coded.dictionary)
        a, b, size = self.tokens(coded.dictionary.to_pylist())
        a_end, b_end, end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(size)
        # A link is a stretch between neighbouring ends of either tokenizer, a group one between common ends.
        cut = np.union1d(a_end, b_end)
        ai, bi = np.searchsorted(a_end, cut), np.searchsorted(b_end, cut)
        pair = a[ai] << 32 | b[bi]
        common = cut[(a_end[ai] == cut) & (b_end[bi] == cut)]
        upto = {"n_a": a_end, "n_b": b_end, "n_groups": common, "n_links": cut}
        of_unit = {k: np.diff(np.searchsorted(x, end, "right"), prepend=0) for k, x in upto.items()}
        group = np.concatenate([np.searchsorted(common, a_end), np.searchsorted(common, b_end)])
        side = np.repeat([0, 1], [len(a), len(b)])
        last = np.concatenate([np.isin(a_end, common), np.isin(b_end, common)])
        na, nb = len(self.a_bytes), len(self.b_bytes)
        number = np.concatenate([a, b]) + 2 * na * side + np.where(side, nb, na) * last
        number = number[np.argsort(2 * group + side, kind="stable")]
        said = np.concatenate([[0], np.cumsum(self.number_size[number])])[np.concatenate([[0], np.cumsum(of_unit["n_a"] + of_unit["n_b"])])]
        data = self.numbers.take(pa.array(number)).buffers()[2] or pa.py_buffer(b"")
        groups = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_units, [None, pa.py_buffer(said), data]).take(coded.indices)
        start = np.concatenate([[0], ends])
        good = np.add.reduceat(size[code] == 0, start[:-1]) == 0
        cuts = np.frombuffer(groups.buffers()[1], np.int64, len(groups) + 1)[start]
        data = memoryview(groups.buffers()[2] or b"")
        digests = [hashlib.sha256(data[i : j - 1]).hexdigest() if ok else "" for i, j, ok in zip(cuts[:-1].tolist(), cuts[1:].tolist(), good, strict=True)]
        back = np.argsort(order)
        out = {k: (np.add.reduceat(n[code], start[:-1]) * good)[back] for k, n in of_unit.items() if k != "n_links"}
        out["groups_sha256"] = np.array(digests, object)[back]
        return out, *self._entries(order, np.diff(start), good, code, n_units, pair, of_unit["n_links"])

    @staticmethod
    def _entries(order: np.ndarray, sizes: np.ndarray, good: np.ndarray, code: np.ndarray, n_units: int, pair: np.ndarray, n_links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of each text by pair, from its units, each as often as it occurs."""
        keep = np.repeat(good, sizes)
        seen, times = np.unique((np.repeat(order, sizes) * n_units + code)[keep], return_counts=True)
        text, unit = np.divmod(seen, max(1, n_units))
        first, n = (np.cumsum(n_links) - n_links)[unit], n_links[unit]
        link = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        names, which = np.unique(pair, return_inverse=True)
        key = np.repeat(text, n) * max(1, len(names)) + which[link]
        by = np.argsort(key, kind="stable")
        key, weight = key[by], np.repeat(times, n)[by]
        fresh = np.flatnonzero(np.diff(key, prepend=-1))
        text, which = np.divmod(key[fresh], max(1, len(names)))
        return text, names[which], np.add.reduceat(weight, fresh) if len(fresh) else fresh


def postings(pair: np.ndarray, place: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The pairs of entries (each place once for a pair), in order, and their planes: the lowest binary digit first."""
    names, which = np.unique(pair, return_inverse=True)
    planes = max(1, int(links.max(initial=0)).bit_length())
    bit = [np.flatnonzero(links >> k & 1) for k in range(planes)]
    set_bits = np.sort(np.concatenate([(which[at] * planes + k) << 16 | place[at] for k, at in enumerate(bit)]).astype(np.int64))
    count = np.bincount(set_bits >> 16, minlength=len(names) * planes).reshape(-1, planes)
    height = planes - np.argmax(count[:, ::-1] > 0, axis=1)
    kept = (np.arange(planes) < height[:, None]).ravel()
    data, count = (set_bits & 0xFFFF).astype("<u2"), count.ravel()
    dense, ends = np.flatnonzero(count >= _SPARSE), np.cumsum(count)
    if len(dense):
        parts, at = [], 0
        for c in dense:
            low, high = ends[c] - count[c], ends[c]
            bits = np.zeros(_PLACES, np.uint8)
            bits[data[low:high]] = 1
            parts += [data[at:low], np.packbits(bits, bitorder="little").view("<u2")]
            at = high
        data = np.concatenate([*parts, data[at:]])
    size = np.where(count >= _SPARSE, _BITMAP, 2 * count)[kept]
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    values = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(data.tobytes())])
    return names, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(height)]).astype(np.int32)), values)


def set_bits(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, plane and place of every bit that is set."""
    height = pc.list_value_length(planes).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(planes)), height)
    plane = np.arange(len(row)) - np.repeat(np.cumsum(height) - height, height)
    values = planes.flatten()
    size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(values.to_pylist()), "<u2").astype(np.int64)
    of = np.repeat(np.arange(len(size)), size // 2)
    sparse = (size < _BITMAP)[of]
    of, place, at = [of[sparse]], [data[sparse]], np.cumsum(size) - size
    for c in np.flatnonzero(size == _BITMAP):
        bits = np.flatnonzero(np.unpackbits(data[at[c] // 2 : (at[c] + _BITMAP) // 2].astype("<u2").view(np.uint8), bitorder="little"))
        of.append(np.full(len(bits), c))
        place.append(bits)
    of = np.concatenate(of)
    return row[of], plane[of], np.concatenate(place)


@functools.lru_cache(maxsize=1)
def shared_aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for all tasks of a worker process."""
    return Aligner(a_path, b_path)


_COUNTS = ("n_a", "n_b", "n_groups")
_ROWS = pa.schema([
    ("chunk", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups_sha256", pa.string()),
    ("a", pa.int32()), ("b", pa.int32()), ("planes", pa.list_(pa.binary())),
])
_SCHEMA = "chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a int, b int, planes array<binary>"


class _Chunk:
    """Entries of the documents that a task has read since the last chunk."""

    def __init__(self, first: int):
        self.name, self.n, self.size, self.parts = first, 0, 0, []

    def add(self, doc_ids: pa.Array, texts: list[str | None], aligner: Aligner) -> pa.RecordBatch:
        """The documents' own rows; their entries are kept."""
        there = np.flatnonzero([bool(t) for t in texts])
        out = {c: np.zeros(len(texts), np.int64) for c in _COUNTS} | {"groups_sha256": np.full(len(texts), "", object)}
        if len(there):
            found, text, pair, links = aligner.align([texts[i] for i in there])
            for c, x in found.items():
                out[c][there] = x
            self.parts.append((pair, there[text] + self.n, links))
            self.size += len(pair)
        place = np.arange(self.n, self.n + len(texts), dtype=np.int32)
        self.n += len(texts)
        own = {"chunk": pa.array(np.full(len(texts), self.name)), "place": pa.array(place), "doc_id": doc_ids} | {c: pa.array(x) for c, x in out.items()}
        return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(texts), f.type)).cast(f.type) for f in _ROWS], schema=_ROWS)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        names, planes = postings(*map(np.concatenate, zip(*self.parts, strict=True)))
        own = {"chunk": pa.array(np.full(len(names), self.name)), "a": pa.array((names >> 32).astype(np.int32)), "b": pa.array((names & 0xFFFFFFFF).astype(np.int32)), "planes": planes}
        batch = pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(names), f.type)) for f in _ROWS], schema=_ROWS)
        for i in range(0, len(names), 20_000):
            yield batch.slice(i, 20_000)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (chunk, place, doc_id, n_a, n_b, n_groups, groups_sha256) and postings (chunk, a, b, planes), from one pass over ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, chunk = shared_aligner(a_path, b_path), None
        for batch in batches:
            texts, at = batch["text"].to_pylist(), 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end] or "") < _CHUNK):
                    size += len(texts[end] or "")
                    end += 1
                if chunk and (chunk.size >= _ENTRIES or chunk.n + end - at > _PLACES):
                    yield from chunk.rows()
                    chunk = None
                chunk = chunk or _Chunk(batch["no"][at].as_py())
                yield chunk.add(batch["doc_id"].slice(at, end - at), texts[at:end], aligner)
                at = end
        if chunk:
            yield from chunk.rows()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("no", F.monotonically_increasing_id())
    both = materialise(rows.mapInArrow(run, _SCHEMA))
    return both.where("a is null").drop("a", "b", "planes"), both.where("a is not null").select("chunk", "a", "b", "planes")


def pair_counts(found: DataFrame) -> DataFrame:
    """``(a, b, n_docs, n_links, is_best)`` of each pair of postings; is_best: no other pair of its id of A is in more documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, plane, place = set_bits(batch["planes"])
            # The planes OR-ed: each place of a posting once.
            n_docs = np.bincount(np.unique(row << 16 | place) >> 16, minlength=len(batch))
            n_links = np.zeros(len(batch), np.int64)
            np.add.at(n_links, row, np.int64(1) << plane)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(n_docs.astype(np.int64)), pa.array(n_links)], ["a", "b", "n_docs", "n_links"])

    counts = found.select("a", "b", "planes").mapInArrow(run, "a int, b int, n_docs long, n_links long").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    return counts.withColumn("is_best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def returned(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``(chunk, place, n_links, n_best, count_sum)`` of each document with links, from postings joined with the counts of their pairs."""

    def rows(chunk: int, sums: np.ndarray) -> pa.RecordBatch:
        place = np.flatnonzero(sums[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), chunk)), pa.array(place.astype(np.int32)), *(pa.array(s[place]) for s in sums)], ["chunk", "place", "n_links", "n_best", "count_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        for batch in batches:
            chunks = batch["chunk"].to_numpy()
            # Sorted by chunk: the sums of one at a time are held.
            edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if at != chunks[i]:
                    if sums is not None:
                        yield rows(at, sums)
                    at, sums = int(chunks[i]), np.zeros((3, _PLACES), np.int64)
                part = batch.slice(i, j - i)
                row, plane, place = set_bits(part["planes"])
                links = np.int64(1) << plane
                for total, each in zip(sums, (1, part["is_best"].cast(pa.int64()).to_numpy()[row], part["n_docs"].to_numpy()[row]), strict=True):
                    np.add.at(total, place, links * each)
        if sums is not None:
            yield rows(at, sums)

    joined = found.join(counts, ["a", "b"]).select("chunk", "planes", "n_docs", "is_best")
    return joined.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk long, place int, n_links long, n_best long, count_sum long")


def scores(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of each row of ``docs`` (doc_id, text).

    Null and empty texts, and those that a tokenizer changes, have no tokens: zeros, and '' for the digest. Texts are encoded whole, however long; special
    tokens in them are plain text. Repeated rows count as documents of their own; other columns are not looked at; no rows give no rows.
    """
    own, found = aligned(docs, a_path, b_path)
    sums = returned(found, pair_counts(found))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return own.join(sums, ["chunk", "place"], "left").select("doc_id", *_COUNTS, *zero, "groups_sha256")
