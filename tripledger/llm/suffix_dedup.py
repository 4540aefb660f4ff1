"""Repeated passages by deep-shallow sorting of sampled suffixes.

A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id. Sorting every suffix of
a corpus would shuffle fifty times its size, so suffixes are sampled by content: each 50-byte string belongs to
the smallest 20-byte hash inside it (its anchor), and neighbouring strings with one anchor form a
stretch. Only anchors met in several different stretches can repeat something partly; the suffixes
of their stretches are sorted: multikey quicksort on 8-byte symbols to a shallow depth, then blind tries, which look
only at the bytes where a group branches, for groups with a long common prefix. Strings that end in one leaf are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize
from tripledger.llm.arrow_rows import map_rows, slices

LENGTH = 50  # bytes of a repeated string
ANCHOR = 20  # bytes of an anchor
SHALLOW = 16  # bytes sorted by multikey quicksort before blind tries take over
SORTED_TOGETHER = 400_000  # suffixes
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


_LETTERS = _mix(_mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95)))
_GROWN = {"n": 0, "up": np.zeros(0, _U), "down": np.zeros(0, _U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _GROWN["n"] < n:
        size = max(n, 2 * _GROWN["n"], 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _GROWN[name] = np.multiply.accumulate(steps)
        _GROWN["n"] = size
    return _GROWN["up"][:n], _GROWN["down"][:n]


def stretches(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, first string start and string count of each stretch of one text, from left to right."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(_U), none.view(_U), none, none
    up, down = _powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, _U)
    np.cumsum(_LETTERS[np.frombuffer(raw, np.uint8)] * up[:-1], out=prefix[1:])
    low = _mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * down[: len(raw) - ANCHOR + 1])
    width, size = LENGTH - ANCHOR + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: size - width], low[width - size :])
    start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    count = np.diff(np.r_[start, n])
    content = _mix((prefix[start + count - 1 + LENGTH] - prefix[start]) * down[start]) + count.astype(_U)
    return low[start], content, start, count


def suffix_classes(strings: np.ndarray) -> np.ndarray:
    """A class number for each row of an array of equally long byte strings; equal rows, and only they, share one.

    Shallow: multikey quicksort, whose symbols are 8 bytes: each pass sorts within the groups that are still tied.
    Deep: all groups with a long common prefix grow their blind tries side by side; a level finds the first byte
    where a group branches, skips what lies before it, and splits the group by that byte only.
    """
    n, depth = strings.shape
    group, tied = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, min(SHALLOW, depth), 8):
        symbol = np.zeros((len(tied), 8), np.uint8)
        part = strings[tied, at : at + 8]
        symbol[:, : part.shape[1]] = part
        tied = _split(group, tied, symbol.view(">u8")[:, 0].astype(_U))
    while len(tied):
        own = group[tied]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sizes = np.diff(np.r_[first, len(own)])
        differs = strings[tied] != strings[np.repeat(tied[first], sizes)]
        branch = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
        branch = np.minimum.reduceat(branch, first)
        open_ = np.repeat(branch < depth, sizes)  # the others are one leaf each
        tied, branch = tied[open_], np.repeat(branch, sizes)[open_]
        if len(tied):
            tied = _split(group, tied, strings[tied, branch].astype(_U))
    return group


def _split(group: np.ndarray, tied: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Sorts the tied rows by symbol within their groups, numbers the new groups by their first row; returns the rows still tied."""
    if not len(tied):
        return tied
    order = np.lexsort((symbol, group[tied]))
    rows, symbol, own = tied[order], symbol[order], group[tied][order]
    new = np.r_[True, (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])]
    first = np.flatnonzero(new)
    sizes = np.diff(np.r_[first, len(rows)])
    group[rows] = np.repeat(rows[first], sizes)
    return rows[np.repeat(sizes > 1, sizes)]


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals."""
    out: list[tuple[int, int]] = []
    order = np.argsort(starts, kind="stable")
    for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _met(docs: DataFrame) -> DataFrame:
    """(place, anchor, content, doc_id, settled): the stretches of all documents.

    Within a slice, only the smallest document of equal stretches is left for the shuffle by anchor; those of
    the others are settled, and travel by another key, so that common passages don't pile up in one task.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchors, contents, owners = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            anchor, content, _, _ = stretches((text or "").encode("utf-8", "surrogatepass"))
            anchors.append(anchor)
            contents.append(content)
            owners.append(np.full(len(anchor), doc, np.int64))
        anchor, content, owner = np.concatenate(anchors), np.concatenate(contents), np.concatenate(owners)
        order = np.lexsort((owner, content, anchor))
        anchor, content, owner = anchor[order], content[order], owner[order]
        again = np.zeros(len(order), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
        first = np.flatnonzero(~again)
        low = np.repeat(owner[first], np.diff(np.r_[first, len(order)])) if len(order) else owner
        keep = ~again | (owner != np.r_[owner[:1], owner[:-1]])  # one row for each document
        anchor, content, owner, settled = anchor[keep], content[keep], owner[keep], (owner > low)[keep]
        place = np.where(settled, _mix(content + owner.astype(_U)), anchor)
        return pa.RecordBatch.from_arrays(
            [pa.array(place.view(np.int64)), pa.array(content.view(np.int64)), pa.array(owner), pa.array(settled)], ["place", "content", "doc_id", "settled"]
        )

    return map_rows(docs.select("doc_id", "text"), make, "place long, content long, doc_id long, settled boolean")


def _answers(met: DataFrame) -> DataFrame:
    """(doc_id, content, partly): stretches that a smaller document has whole (not partly), or that must be sorted."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def judge(columns: list[np.ndarray]) -> pa.RecordBatch:
            place, content, doc, settled = columns
            live = ~settled
            p, c, d = place[live], content[live], doc[live]
            new_place = np.r_[True, p[1:] != p[:-1]] if len(p) else np.zeros(0, bool)
            new = new_place | np.r_[True, c[1:] != c[:-1]] if len(p) else new_place
            first = np.flatnonzero(new)
            low = np.repeat(d[first], np.diff(np.r_[first, len(p)])) if len(p) else d
            starts = np.flatnonzero(new_place)
            kinds = np.add.reduceat(new.astype(np.int64), starts) if len(p) else starts
            several = np.repeat(kinds > 1, np.diff(np.r_[starts, len(p)])) if len(p) else new_place
            whole, part = d > low, new & several
            out = [np.r_[doc[settled], d[whole], d[part]], np.r_[content[settled], c[whole], c[part]]]
            partly = np.r_[np.zeros(settled.sum() + whole.sum(), bool), np.ones(part.sum(), bool)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*out, partly)], ["doc_id", "content", "partly"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))  # the last place may go on
            if cut:
                held.append([c[:cut] for c in columns])
                yield judge([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            held.append([c[cut:] for c in columns])
        if held:
            yield judge([np.concatenate(x) for x in zip(*held, strict=True)])

    dealt = met.repartition("place").sortWithinPartitions("place", "content", "doc_id")
    return dealt.mapInArrow(answer, "doc_id long, content long, partly boolean")


FOUND = "doc_id long, text_hash long, anchor long, start long, stop long, raw binary"


def _look_up(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Intervals that smaller documents have (no anchor, no bytes), and the stretches to be sorted with their bytes."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc, text, key, whole, part in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            anchor, content, start, count = stretches(raw)
            here = content.view(np.int64)
            gone = np.isin(here, whole or [])
            for a, b in _merge(start[gone], start[gone] + count[gone] + LENGTH - 1):
                rows.append((doc, key, None, a, b, None))
            for i in np.flatnonzero(np.isin(here, part or []) & ~gone).tolist():
                a, b = int(start[i]), int(start[i] + count[i] + LENGTH - 1)
                rows.append((doc, key, int(anchor[i].astype(np.int64)), a, b, raw[a:b]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "anchor", "start", "stop", "raw"])

    gathered = answers.groupBy("doc_id").agg(
        F.collect_list(F.when(~F.col("partly"), F.col("content"))).alias("whole"), F.collect_list(F.when(F.col("partly"), F.col("content"))).alias("part")
    )
    joined = docs.join(gathered, "doc_id").select("doc_id", "text", "text_hash", "whole", "part")
    return map_rows(joined, make, FOUND)


#: An anchor with more than one stretch in so many of all, and more than so many, is dealt string by string.
HOT_SHARE, HOT_LEAST = 1_000, 64
_WEIGHTS = _mix(_mix(np.arange(1, LENGTH + 1, dtype=_U) * _U(_BASE))) | _U(1)


def _strings(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All 50-byte strings of the stretches: (strings, stretch of each, place of each within its stretch)."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(raws)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(sizes) - sizes, counts) + within
    return sliding_window_view(np.frombuffer(b"".join(raws), np.uint8), LENGTH)[at], owner, within


def _runs(again: np.ndarray, docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, owner: np.ndarray, within: np.ndarray) -> list[tuple]:
    """(doc_id, text_hash, start, stop) of the runs of neighbouring strings among the given ones."""
    if not len(again):
        return []
    edge = np.flatnonzero(np.r_[True, (owner[again[1:]] != owner[again[:-1]]) | (np.diff(again) > 1)])
    last = np.r_[edge[1:], len(again)] - 1
    return [
        (int(docs[owner[a]]), int(keys[owner[a]]), int(starts[owner[a]] + within[a]), int(starts[owner[a]] + within[b] + LENGTH))
        for a, b in zip(again[edge].tolist(), again[last].tolist(), strict=True)
    ]


def _cool(found: DataFrame) -> DataFrame:
    """found with the stretches of hot anchors taken apart into their strings.

    A passage that very many documents share has, at its rims, an anchor with another stretch in each of them. Equal strings
    have equal hashes, so each string of such an anchor goes by its own hash instead of the anchor. Of the equal
    strings of a slice only those of the least document go on; the others are settled at once.
    """
    todo = found.filter("anchor is not null")
    total = todo.count()
    least = max(HOT_LEAST, total // HOT_SHARE)
    hot = F.broadcast(todo.groupBy("anchor").count().filter(F.col("count") > least).select("anchor"))  # HOT_SHARE rows at most

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5, 2_000_000):
            docs, keys, starts = (batch.column(i).to_numpy() for i in (0, 1, 3))
            strings, owner, within = _strings(batch.column(5).to_pylist())
            classes = suffix_classes(strings)
            low = np.full(len(classes), np.iinfo(np.int64).max)
            np.minimum.at(low, classes, docs[owner])
            later = low[classes] < docs[owner]
            rows = [(doc, key, None, a, b, None) for doc, key, a, b in _runs(np.flatnonzero(later), docs, keys, starts, owner, within)]
            live = np.flatnonzero(~later)
            part = _mix(strings[live].astype(_U) @ _WEIGHTS).view(np.int64)
            at = starts[owner[live]] + within[live]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "text_hash", "anchor", "start", "stop", "raw"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names)
            raw = pa.Array.from_buffers(
                pa.binary(), len(live), [None, pa.py_buffer(np.arange(0, LENGTH * (len(live) + 1), LENGTH, dtype=np.int32)), pa.py_buffer(strings[live].tobytes())]
            )
            yield pa.RecordBatch.from_arrays([pa.array(docs[owner[live]]), pa.array(keys[owner[live]]), pa.array(part), pa.array(at), pa.array(at + LENGTH), raw], names)

    apart = materialize(todo.join(hot, "anchor", "left_semi").select(found.columns).mapInArrow(split, FOUND))
    rest = todo.join(hot, "anchor", "left_anti").select(found.columns)
    return found.filter("anchor is null").unionByName(apart).unionByName(rest)


def _sorted_repeats(found: DataFrame) -> DataFrame:
    """Intervals covered by 50-byte strings that a smaller document also has, among the stretches of each anchor."""

    def settle(docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, raws: list[bytes]) -> list[tuple]:
        strings, owner, within = _strings(raws)
        classes = suffix_classes(strings)
        low = np.full(len(classes), np.iinfo(np.int64).max)
        np.minimum.at(low, classes, docs[owner])
        return _runs(np.flatnonzero(low[classes] < docs[owner]), docs, keys, starts, owner, within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            docs, keys, starts = (table[c].to_numpy() for c in ("doc_id", "text_hash", "start"))
            rows = settle(docs, keys, starts, table["raw"].to_pylist())
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "start", "stop"])

        for batch in slices(batches, 5, 4_000_000):
            held.append(batch)
            size += batch.column(5).nbytes
            if size > SORTED_TOGETHER * 3:
                table = pa.Table.from_batches(held)
                anchors = table["anchor"].to_numpy()
                cut = int(np.searchsorted(anchors, anchors[-1], side="left"))  # the last anchor may go on
                if cut:
                    yield flush(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = sum(b.column(5).nbytes for b in held)
        if held:
            yield flush(pa.Table.from_batches(held))

    todo = found.filter("anchor is not null")
    return todo.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, text_hash long, start long, stop long")


def repeats(docs: DataFrame) -> DataFrame:
    """Byte intervals to remove: (doc_id, text_hash, start, stop), possibly overlapping. See remove()."""
    docs = _hashed(docs)
    comparable = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", "text_hash")
    answers = materialize(_answers(_met(comparable)))
    found = materialize(_cool(materialize(_look_up(comparable, answers))))
    whole = found.filter("anchor is null").select("doc_id", "text_hash", "start", "stop")
    return materialize(whole.unionByName(_sorted_repeats(found)))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_hash", F.xxhash64("text"))


def remove(docs: DataFrame, with_columns: bool = False) -> DataFrame:
    """Each document without its repeated passages: (key, n_bytes, n_removed, n_spans, kept binary, kept_text).

    key is a struct of doc_id, or with with_columns of all columns of docs, so that none can clash; kept_text, given only then, is
    kept without the characters that lost some of their bytes. docs: doc_id, text. A byte goes if a 50-byte string over it starts in a document with a smaller
    doc_id too; rows with the same doc_id don't count as smaller, and a row without doc_id is left whole. Texts under 50
    bytes and null texts (empty) lose nothing. An empty table gives an empty one.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, spans, kept, letters = [], [], [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            runs = _merge(*np.array([(g["start"], g["stop"]) for g in gone], np.int64).T) if gone else []
            at, parts = 0, []
            for a, b in runs:
                parts.append(raw[at:a])
                at = b
            n.append(len(raw))
            removed.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            parts.append(raw[at:])
            kept.append(b"".join(parts))
            letters.append("".join(x.decode("utf-8", "ignore") for x in parts) if with_columns else None)  # bytes around a cut form no letter
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(kept, pa.binary())]
        columns.append(pa.array(letters, pa.string()))
        return pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])

    gone = repeats(docs.select("doc_id", "text")).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    rows = docs.select(F.struct(*docs.columns).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    if not with_columns:
        rows = rows.withColumn("key", F.struct("doc_id"))
    keyed = rows.join(gone, ["doc_id", "text_hash"], "left").select("key", "text", "gone")
    kind = keyed.schema["key"].dataType.simpleString()
    return map_rows(keyed, make, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select(F.col("key.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
