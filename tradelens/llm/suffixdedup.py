"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``width`` bytes that also starts in a document with a smaller doc_id is
removed.  The strings are found by sorting suffixes and reading adjacent common prefixes; suffixes
that can be equal over ``width`` bytes are brought together first, so that no task sorts the whole corpus:

1. Anchors.  The anchor of a window of ``width`` bytes is its smallest hash of ``GRAM`` bytes.  It depends on the
   window's bytes alone, so equal windows have equal anchors.  Neighbouring windows share anchors;
   about one position in 18 is one.
2. Anchors that occur in one document only are dropped: hashes and the blocks that hold them are
   counted by hash ranges, and every block is told which of its anchors repeat.
3. Segments.  For each repeated anchor, the block sends the bytes of the windows that it is the anchor of,
   equal segments once, with the smallest doc_id.  Segments meet by the range of their anchor's hash.
4. Suffix arrays.  Two-stage sorting of the segments: suffixes smaller than their successors are
   sorted directly (to ``DEPTH`` bytes, which is all that windows need), the others follow from bucket scans.
   Runs of adjacent valid suffixes with a common prefix of ``width`` bytes or more are equal windows; the
   smallest doc_id of each run goes back to the blocks.
5. Blocks mark the windows whose smallest doc_id is below the document's own, and cut them.

Blocks and hash ranges are sized by the input (``BLOCK_BYTES``), so a task's share does not grow with it.

Cases: null and empty texts and texts shorter than ``width`` lose nothing; documents with a null doc_id
lose nothing and count for no other; equal doc_ids are not smaller than each other; copies lose
everything but for the one with the smallest doc_id; texts are taken whole; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import arrow_schema, map_batches, texts_of

WIDTH = 50
GRAM = 16
#: Bytes to which suffixes are sorted; at least the width, in whole words of 8.
DEPTH = 56
BLOCK_BYTES = 4 << 20
#: Bytes of segments that are sorted at a time (the segments of one anchor stay together).
SORT_BYTES = 1 << 20
_NO_ID = np.iinfo(np.int64).min
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SEPARATOR = 0xFF  # in no UTF-8 text


# -- suffix sorting ---------------------------------------------------------------------------------

def _words(data: np.ndarray, at: np.ndarray, word: int) -> np.ndarray:
    """The 8 bytes from 8 * word behind each position, as big-endian numbers; ``data`` is padded."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    return np.ascontiguousarray(view[at + 8 * word]).view(">u8").ravel()


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the suffix behind it (the end is smallest)."""
    n = len(data)
    differs = np.ones(n, bool)
    differs[:-1] = data[:-1] != data[1:]
    place = np.where(differs, np.arange(n), n)
    decisive = np.minimum.accumulate(place[::-1])[::-1]  # the next position whose successor differs
    after = np.append(data, 0)[decisive + 1].astype(np.int16)
    after[decisive == n - 1] = -1
    return data[decisive] < after


def _sorted_directly(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions in the order of their first DEPTH bytes; each further word is read for ties only."""
    key = _words(padded, at, 0)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.append(False, key[1:] != key[:-1]))
    for word in range(1, DEPTH // 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = _words(padded, at[tied], word)
        order = np.lexsort((key, group[tied]))
        moved, key = at[tied][order], key[order]
        at[tied] = moved
        new = np.zeros(len(at), bool)
        new[1:] = group[1:] != group[:-1]
        split = np.append(False, key[1:] != key[:-1])
        new[tied[split]] = True
        group = np.cumsum(new)
    return at


def suffix_order(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes in order, exact to DEPTH bytes, by two-stage sorting.

    ``data`` are bytes, ``wanted`` flags positions.  Suffixes smaller than their successors are sorted
    directly; scanning the buckets of first bytes upwards, each suffix met induces its predecessor, if
    that is larger than its successor, to the next free place of its own bucket.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    direct = smaller_than_successor(data)
    # a larger suffix follows from its successor, so the successors up to the next direct one are needed too
    chain = np.where(direct, np.arange(n), n - 1)
    ends = np.minimum.accumulate(chain[::-1])[::-1]
    edge = wanted - np.bincount(ends[wanted] + 1, minlength=n + 1)[:n]
    needed = np.cumsum(edge) > 0
    padded = np.append(data, np.zeros(DEPTH + 8, np.uint8))
    start = _sorted_directly(padded, np.flatnonzero(needed & direct))
    induced = needed & ~direct

    def predecessors(found: np.ndarray) -> np.ndarray:
        before = found - 1
        before = before[before >= 0]
        return before[induced[before]]

    first = np.searchsorted(data[start], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if induced[n - 1]:  # the last suffix has the end as its successor, which is met first
        waiting[data[n - 1]].append(np.array([n - 1]))
    out = []

    def hand_out(before: np.ndarray) -> None:
        byte = data[before]
        order = np.argsort(byte, kind="stable")
        cuts = np.searchsorted(byte[order], np.arange(257))
        for b in np.unique(byte).tolist():
            waiting[b].append(before[order[cuts[b]:cuts[b + 1]]])

    for b in range(256):
        # larger suffixes come before the smaller ones of a bucket, and may induce others of the same bucket
        while waiting[b]:
            part = np.concatenate(waiting[b])
            waiting[b] = []
            out.append(part)
            hand_out(predecessors(part))
        part = start[first[b]:first[b + 1]]
        if len(part):
            out.append(part)
            hand_out(predecessors(part))
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours in suffix order, up to DEPTH bytes (the first has 0)."""
    padded = np.append(data, np.zeros(DEPTH + 8, np.uint8))
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for word in range(DEPTH // 8):
        if not len(live):
            break
        differ = _words(padded, order[live - 1], word).astype(np.uint64) ^ _words(padded, order[live], word).astype(np.uint64)
        same = np.full(len(live), 8)
        for byte in range(7, -1, -1):
            same[(differ >> np.uint64(8 * (7 - byte))) & np.uint64(0xFF) != 0] = byte
        out[live] += same
        live = live[same == 8]
    return out


# -- anchors and segments ---------------------------------------------------------------------------

def _grams(data: bytes) -> np.ndarray:
    """Hashes of all spans of GRAM bytes."""
    view = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (len(data) - 7, 8), (1, 1))
    eight = np.ascontiguousarray(view).view("<u8").ravel()
    grams = eight[:-8] * _MIX[0] ^ (eight[8:] * _MIX[1] >> np.uint64(7))
    return (grams ^ grams >> np.uint64(29)) * _MIX[2]


def anchors(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: the hash of each anchor, and the first and last window start that it is the anchor of."""
    n = len(data) - width + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    grams = _grams(data)
    # the place, modulo 2**16, under the hash: the smallest is found by minima over growing spans
    place = np.arange(len(grams), dtype=np.uint64)
    least = (grams >> np.uint64(16) << np.uint64(16)) | place & np.uint64(0xFFFF)
    span, reach = 1, width - GRAM + 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[:len(least) - (reach - span)], least[reach - span:])
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return least[first] >> np.uint64(16), first, np.append(first[1:], n) - 1


def _segment_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, from prefix sums of random byte values times powers."""
    values = _BYTES[np.frombuffer(data, np.uint8)]
    power, inverse = _powers(len(data))
    sums = np.append(np.uint64(0), np.cumsum(values * power))
    h = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _MIX[0]
    h = (h ^ h >> np.uint64(31)) * _MIX[1]
    return h ^ h >> np.uint64(29)


_BYTES = np.random.default_rng(411).integers(1, 2 ** 63, 256, np.uint64)
_ODD = 0x9E6C63D0876A9A47 | 1
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _TABLES[:] = []
        for b in (_ODD, pow(_ODD, -1, 1 << 64)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(pow(b, len(table), 1 << 64))])
            _TABLES.append(table)
    return _TABLES[0][:n], _TABLES[1][:n]


def _split(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Positions of each distinct key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, int)
    return [(int(keys[order[a]]), order[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(keys)))]


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The part of each anchor.  Anchors are minima, so their hashes crowd near 0 and are mixed again."""
    return (hashes * _MIX[0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


# -- the passes -------------------------------------------------------------------------------------

def _packed(rows: DataFrame) -> DataFrame:
    """``block, packed``: the documents of a batch that belong to a block, compressed."""
    def fn(batch: pa.RecordBatch) -> dict:
        blocks, packed = [], []
        ids = batch.column(0).fill_null(_NO_ID).to_numpy()
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        press = zstandard.ZstdCompressor(level=3)
        for block, at in _split(batch.column(2).to_numpy()):
            own = [texts[i] for i in at]
            head = np.array([len(own), *ids[at], *map(len, own)], np.int64).tobytes()
            blocks.append(block)
            packed.append(press.compress(head + b"".join(own)))
        return {"block": blocks, "packed": packed}
    return map_batches(rows, fn, "block int, packed binary")


def _unpacked(table: pa.Table):
    """``(doc_id, bytes)`` of packed rows; ``_NO_ID`` stands for null."""
    for packed in table.column("packed"):
        raw = zstandard.ZstdDecompressor().decompress(packed.as_py())
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        head = np.frombuffer(raw, np.int64, 2 * n, 8)
        at = 8 + 16 * n
        for doc_id, length in zip(head[:n].tolist(), head[n:].tolist()):
            yield doc_id, raw[at:at + length]
            at += length


def _anchor_rows(rows: DataFrame, ranges: int, width: int) -> DataFrame:
    """``part, low, high, blocks``: per batch and hash range the anchors (each once for a document, at most
    twice for a block: more tells nothing) and the blocks they are in."""
    def fn(batch: pa.RecordBatch) -> dict:
        found, own = [], []
        for doc_id, text, block in zip(*(c.to_pylist() for c in batch.columns)):
            h = np.unique(anchors(text.encode(), width)[0]) if doc_id is not None else np.zeros(0, np.uint64)
            found.append(h)
            own.append(np.full(len(h), block, np.uint32))
        h, block = np.concatenate(found), np.concatenate(own)
        order = np.lexsort((block, h))
        h, block = h[order], block[order]
        if len(h) > 2:
            third = np.append([False, False], (h[2:] == h[:-2]) & (block[2:] == block[:-2]))
            h, block = h[~third], block[~third]
        out: dict[str, list] = {"part": [], "low": [], "high": [], "blocks": []}
        for part, at in _split(_range_of(h, ranges).astype(np.int64)):
            out["part"].append(part)
            out["low"].append((h[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            out["high"].append((h[at] >> np.uint64(32)).astype(np.uint16).tobytes())
            out["blocks"].append(block[at].tobytes())
        return out
    return map_batches(rows, fn, "part int, low binary, high binary, blocks binary")


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _repeated(key: tuple, table: pa.Table) -> pa.Table:
    """``block, hashes`` of the anchors of a hash range that are in two documents or more."""
    h = _joined(table, "low", np.uint32).astype(np.uint64) | _joined(table, "high", np.uint16).astype(np.uint64) << np.uint64(32)
    block = _joined(table, "blocks", np.uint32)
    order = np.lexsort((block, h))
    h, block = h[order], block[order]
    same = h[1:] == h[:-1]
    again = np.append(same, False) | np.append(False, same)
    first = np.append(True, ~same | (block[1:] != block[:-1]))
    h, block = h[again & first], block[again & first]
    parts = _split(block.astype(np.int64))
    return pa.table({"block": [b for b, _ in parts], "hashes": [h[at].tobytes() for _, at in parts]},
                    schema=arrow_schema("block int, hashes binary"))


_MESSAGE = "part int, block int, packed binary"
_ANSWER = "block int, segment binary, first binary, last binary, least binary"


def _segments(ranges: int, width: int):
    """Of a block: the distinct segments around its repeated anchors, by the range of the anchor."""
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        schema = arrow_schema(_MESSAGE)
        if not told.num_rows or not docs.num_rows:
            return schema.empty_table()
        known = np.sort(_joined(told, "hashes", np.uint64))
        seen: dict[int, list] = {}  # segment hash -> [anchor, bytes, least doc_id, most doc_id]
        for doc_id, data in _unpacked(docs):
            if doc_id == _NO_ID:
                continue
            h, first, last = anchors(data, width)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            if not len(at):
                continue
            names = _segment_hashes(data, first[at], last[at] + width).tolist()
            for name, anchor, a, b in zip(names, h[at].tolist(), first[at].tolist(), last[at].tolist()):
                entry = seen.get(name)
                if entry is None:
                    seen[name] = [anchor, data[a:b + width], doc_id, doc_id]
                elif doc_id < entry[2]:
                    entry[2] = doc_id
                elif doc_id > entry[3]:
                    entry[3] = doc_id
        if not seen:
            return schema.empty_table()
        entries = list(seen.values())
        seen.clear()
        anchor = np.array([e[0] for e in entries], np.uint64)
        block = docs.column("block")[0].as_py()
        press = zstandard.ZstdCompressor(level=1)
        out: dict[str, list] = {f.name: [] for f in schema}
        for part, at in _split(_range_of(anchor, ranges).astype(np.int64)):
            own = sorted((entries[i] for i in at), key=lambda e: e[2])
            least = np.array([e[2] for e in own], np.int64)
            head = [np.array([len(own)], np.int64), np.array([len(e[1]) for e in own], np.int64), np.diff(least, prepend=np.int64(0)),
                    np.array([e[3] for e in own], np.int64) - least]
            out["part"].append(part)
            out["block"].append(block)
            out["packed"].append(press.compress(b"".join([*(h.tobytes() for h in head), *(e[1] for e in own)])))
        return pa.table(out, schema=schema)
    return run


def _message(packed: bytes, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a message: the bytes, and of each segment its length, name, anchor, least and most doc_id."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    lengths, steps, spread = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
    data, least = raw[8 + 24 * n:], np.cumsum(steps)
    ends = np.cumsum(lengths)
    grams = _grams(data) >> np.uint64(16)
    # the anchor of a segment is that of its first window
    anchor = np.concatenate([np.zeros(0, np.uint64), *(
        grams[(ends - lengths)[i:i + 4096, None] + np.arange(width - GRAM + 1)].min(axis=1) for i in range(0, n, 4096))])
    return data, lengths, _segment_hashes(data, ends - lengths, ends), anchor, least, least + spread


def equal_windows(raw: np.ndarray, start: np.ndarray, length: np.ndarray, least: np.ndarray,
                  width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the segments ``raw[start:start + length]``: its segment, its offset there, and the
    smallest ``least`` of all segments that hold an equal window."""
    size = length + 1  # with a separator
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(owner)) - begin[owner]
    data = np.where(offset < length[owner], raw[np.minimum(start[owner] + offset, len(raw) - 1)], np.uint8(_SEPARATOR)).astype(np.uint8)
    wanted = offset <= (length - width)[owner]
    order = suffix_order(data, wanted)
    new = common_prefixes(data, order) < width
    new[:1] = True
    runs = np.flatnonzero(new)
    value = np.zeros(len(data), np.int64)
    if len(order):
        lowest = np.minimum.reduceat(least[owner[order]], runs)
        value[order] = np.repeat(lowest, np.diff(np.append(runs, len(order))))
    return owner[wanted], offset[wanted], value[wanted]


def _sorted_range(width: int):
    """Of a hash range: suffix arrays of its segments, and the answers to the blocks."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        data, *columns = zip(*(_message(p.as_py(), width) for p in table.column("packed")))
        block = np.repeat(table.column("block").to_numpy(), [len(c) for c in columns[0]])
        lengths, names, anchor, least, most = (np.concatenate(c) for c in columns)
        raw = np.frombuffer(b"".join(data), np.uint8)
        del data, columns
        ends = np.cumsum(lengths)
        # equal segments of several blocks are one text with the smallest doc_id
        order = np.lexsort((names, anchor))
        new = np.append(True, (names[order][1:] != names[order][:-1]) | (anchor[order][1:] != anchor[order][:-1]))
        heads = np.flatnonzero(new)
        text = np.empty(len(names), np.int64)
        text[order] = np.cumsum(new) - 1
        lowest = np.minimum.reduceat(least[order], heads)
        pick = order[heads]
        group = anchor[pick]
        answers: list[tuple[np.ndarray, ...]] = []  # segment, first and last offset, smallest doc_id
        size = lengths[pick] + 1
        at = 0
        while at < len(pick):
            # as many whole anchors as fit the bound, at least one
            stop = int(np.searchsorted(np.cumsum(size[at:]), SORT_BYTES, side="right")) + at
            stop = min(max(stop, at + 1), len(pick))
            if stop < len(pick) and group[stop] == group[stop - 1]:
                back = int(np.searchsorted(group, group[stop], side="left"))
                stop = back if back > at else int(np.searchsorted(group, group[stop], side="right"))
            own = pick[at:stop]
            segment, offset, value = equal_windows(raw, ends[own] - lengths[own], lengths[own], lowest[at:stop], width)
            cuts = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (value[1:] != value[:-1])))
            close = np.append(cuts[1:], len(segment)) - 1
            answers.append((segment[cuts] + at, offset[cuts].astype(np.int32), offset[close].astype(np.int32), value[cuts]))
            at = stop
        owner, first, last, low = (np.concatenate(c) for c in zip(*answers))
        runs = np.searchsorted(owner, np.arange(len(pick) + 1))
        # every block gets the runs of its segments that hold a smaller doc_id than one of its documents
        n_runs = (runs[1:] - runs[:-1])[text]
        row = np.repeat(np.arange(len(names)), n_runs)
        run_at = np.arange(len(row)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + runs[:-1][text[row]]
        useful = low[run_at] < most[row]
        row, run_at = row[useful], run_at[useful]
        out: dict[str, list] = {k: [] for k in ("block", "segment", "first", "last", "least")}
        for b, at in _split(block[row].astype(np.int64)):
            out["block"].append(b)
            out["segment"].append(names[row[at]].tobytes())
            out["first"].append(first[run_at[at]].tobytes())
            out["last"].append(last[run_at[at]].tobytes())
            out["least"].append(low[run_at[at]].tobytes())
        return pa.table(out, schema=arrow_schema(_ANSWER))
    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"


def _cut(width: int, with_bytes: bool):
    """Of a block: every document without its repeated bytes."""
    def removed(doc_id: int, data: bytes, names, first, last, least) -> np.ndarray:
        cover = np.zeros(len(data) + 1, np.int32)
        if doc_id != _NO_ID and len(names) and len(data) >= width:
            h, a, b = anchors(data, width)
            own = _segment_hashes(data, a, b + width)
            low, high = np.searchsorted(names, own, side="left"), np.searchsorted(names, own, side="right")
            n = high - low
            seg = np.repeat(np.arange(len(own)), n)
            run = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n) + low[seg]
            hit = least[run] < doc_id
            seg, run = seg[hit], run[hit]
            np.add.at(cover, a[seg] + first[run], 1)
            np.add.at(cover, a[seg] + last[run] + width, -1)
        return np.cumsum(cover[:-1]) > 0

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        schema = arrow_schema(_RESULT + ", kept binary" * with_bytes)
        names, least = _joined(told, "segment", np.uint64), _joined(told, "least", np.int64)
        first, last = _joined(told, "first", np.int32), _joined(told, "last", np.int32)
        order = np.argsort(names, kind="stable")
        names, first, last, least = names[order], first[order], last[order], least[order]
        rows = []
        for doc_id, data in _unpacked(docs):
            gone = removed(doc_id, data, names, first, last, least)
            edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if a else data
            rows.append((None if doc_id == _NO_ID else doc_id, len(data), int(gone.sum()), len(a),
                         hashlib.sha256(kept).hexdigest(), ",".join(f"{x}:{y}" for x, y in zip(a, b)),
                         *([kept] if with_bytes else [])))
        return pa.table(dict(zip(schema.names, zip(*rows))), schema=schema) if rows else schema.empty_table()
    return run, _RESULT + ", kept binary" * with_bytes


def remove_repeats(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, with_bytes: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]``.

    ``spans`` lists the removed runs as ``start:end`` in bytes, end exclusive.
    """
    if not GRAM + 1 < width <= DEPTH - 1:
        raise ValueError(f"width must be between {GRAM + 2} and {DEPTH - 1}")
    texts = texts_of(docs, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    rows = texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    packed = _packed(rows)
    told = _anchor_rows(rows, n, width).groupBy("part").applyInArrow(_repeated, "block int, hashes binary")
    messages = packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_segments(n, width), _MESSAGE)
    answers = messages.groupBy("part").applyInArrow(_sorted_range(width), _ANSWER)
    cut, schema = _cut(width, with_bytes)
    again = _packed(rows.select("doc_id", "text", F.col("block").alias("own"))).withColumnRenamed("block", "at")
    return again.groupBy("at").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)


def op7(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs)
