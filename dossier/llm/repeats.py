"""Exact substring dedup on bytes by the common-prefix interval tree of enhanced suffix arrays.

A byte is removed when a ``LENGTH``-byte string that covers it also starts anywhere else.

1. Every such string has an anchor, the ``ANCHOR``-byte gram of least hash inside it. Consecutive strings with the same
   anchor form a segment. Chunks send the (anchor, segment) hashes of their segments to shards; a shard names the anchors
   that occur more than once and the chunk that shall send the bytes of each different segment.
2. A segment that occurs several times is repeated whole. The others are compared with all segments of their anchor, whose
   bytes the shards gather, one copy of each. Equal strings are aligned on their anchor, so a shard builds the suffix array
   of the suffixes that start at anchors: it sorts them, measures the common prefixes of neighbours, and a stack scan of
   these walks the common-prefix interval tree. The members of an interval are then put in the order of their bytes to the
   left: neighbours whose left extensions differ there bound a maximal repeat group, which holds all of its occurrences.
3. Chunks get the repeated ranges of their segments back, mark every occurrence and cut them out.

A hot anchor, one of over ``HOT`` different segments (a common line in many contexts), is not gathered: a chunk that holds
over ``LOCAL`` of them only says so, and all chunks deal the strings of its segments, one by one, over all shards by their own
128-bit hashes, which tell the repeated ones.

Defined results: a null text counts as empty; texts shorter than LENGTH have no repeated string; repeated rows repeat each
other and vanish whole where they are long enough; texts of any length are one piece; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from dossier.llm.chunks import by_chunk, by_shard, dealt, joined, lookup, parts, runs, spread, unpack
from dossier.llm.common import mix64, sliding_argmin, table

LENGTH, ANCHOR, HOT, LOCAL = 200, 40, 4096, 64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: What a shard says of a segment: its bytes are asked for; it occurs again itself; its anchor is hot.
OWNER, AGAIN, SPREAD = 2, 4, 8
SEGMENTS = "shard int, chunk int, anchors binary, segments binary, again binary"
SENT = "shard int, chunk int, anchors binary, segments binary, flags binary, lefts binary, sizes binary, bytes binary, wins binary, more binary, twice binary"
FOUND = "chunk int, anchors binary, segments binary, flags binary, counts binary, ranges binary, wins binary, more binary"


@lru_cache(4)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        power = np.full(n, base, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power, out=power))
    return out[0], out[1]


class Hashes:
    """Hashes of any slices of a byte array, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        n = len(data) + 1
        power, self.back = _powers(1 << max(n.bit_length(), 20), which)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


class Chunk:
    """The bytes of a chunk's documents in a row, and their segments: anchor and segment hash, first byte, end."""

    def __init__(self, pdf: pd.DataFrame, length: int, anchor: int) -> None:
        self.texts = [bytes(t) for t in pdf["text"]]
        self.ids = pdf["id"]
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        n = len(self.data) - length + 1
        self.anchor = self.segment = np.zeros(0, np.uint64)
        self.start = self.end = self.left = np.zeros(0, np.int64)
        if n <= 0:
            return
        hashes = Hashes(self.data)
        m = len(self.data) - anchor + 1
        h = mix64((hashes.sums[anchor:] - hashes.sums[:m]) * hashes.back[:m] + np.uint64(anchor))
        chosen = sliding_argmin(h, length - anchor + 1)
        inside = np.zeros(n, bool)  # strings that lie in one document
        for e, s in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            inside[max(e - s, 0) : max(e - length + 1, 0)] = s >= length
        at = np.flatnonzero(inside)
        if not len(at):
            return
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(chosen[at]) != 0)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
        # Strings at the seam of two documents are out, so a run never spans it.
        self.start, self.end = at[first], at[last] + length
        self.left = chosen[self.start] - self.start  # bytes in front of the anchor
        self.anchor, self.segment = h[chosen[self.start]], hashes.of(self.start, self.end)

    def strings(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, two hashes) of every string of `length` bytes in these segments."""
        n = self.end[which] - self.start[which] - length + 1
        at = np.repeat(self.start[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return (at, *(Hashes(self.data, k).of(at, at + length) for k in range(2)))


def _entries(key: tuple, shards: int, found: list) -> pd.DataFrame:
    """One row for each shard of a chunk's different (anchor, segment) entries; hot anchors of the chunk come without segments."""
    a, g = (joined([f[k] for f in found], np.uint64) for k in range(2))
    order, new = runs(a, g)
    first = np.flatnonzero(new)
    again = np.diff(np.append(first, len(order))) > 1
    a, g = a[order[first]], g[order[first]]
    values, kinds = np.unique(a, return_counts=True)
    hot = values[kinds > LOCAL]
    keep = ~np.isin(a, hot)
    a, g, again = np.concatenate([a[keep], hot]), np.concatenate([g[keep], np.zeros(len(hot), np.uint64)]), np.concatenate([again[keep], np.ones(len(hot), bool)])
    rows = [(s, key[0], a[i].tobytes(), g[i].tobytes(), again[i].tobytes()) for s, i in by_shard(a, shards)]
    return pd.DataFrame(rows, columns=["shard", "chunk", "anchors", "segments", "again"])


def send_segments(shards: int, length: int, anchor: int):
    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for part in parts(pdf):
            c = Chunk(part, length, anchor)
            found.append((c.anchor, c.segment))
        return _entries(key, shards, found)

    return send


def asked_segments(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the segments it must act on, with flags; a segment 0 stands for a hot anchor."""
    pdf = pdf.sort_values("chunk")
    sizes = np.fromiter(map(len, pdf["anchors"]), np.int64, len(pdf)) // 8
    a, g, again = joined(unpack(pdf["anchors"], np.uint64), np.uint64), joined(unpack(pdf["segments"], np.uint64), np.uint64), joined(unpack(pdf["again"], bool), bool)
    chunk = np.repeat(pdf["chunk"].to_numpy(np.int64), sizes)
    rows = []
    if len(a):
        order, new = runs(a, g)  # stable: chunks ascend among equal entries
        oa, og = a[order], g[order]
        new_a = np.append(True, oa[1:] != oa[:-1])
        occurs = 1 + again[order].astype(np.int64)
        group, pair = np.cumsum(new_a) - 1, np.cumsum(new) - 1
        total = np.bincount(group, occurs)[group]
        repeated = np.bincount(pair, occurs)[pair] > 1
        kinds, once = np.bincount(group, new)[group], np.bincount(group, new & ~repeated)[group]
        hot = (np.bincount(group, og == 0)[group] > 0) | (kinds > HOT)
        flags = np.where(repeated, AGAIN, 0).astype(np.uint8)
        flags[new & ~hot & (kinds > 1) & (once > 0)] |= OWNER  # the anchor has different segments, and one not repeated whole
        flags[hot] = SPREAD
        og = np.where(hot, np.uint64(0), og)
        use = np.flatnonzero(total > 1)
        for c, i in by_chunk(chunk[order[use]]):
            x, y, f = oa[use[i]], og[use[i]], flags[use[i]]
            o, n = runs(x, y)  # a hot anchor once
            rows.append((c, x[o[n]].tobytes(), y[o[n]].tobytes(), f[o[n]].tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "anchors", "segments", "flags"])


def _told(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, segment, flags), sorted."""
    a, g, f = joined(unpack(pdf["anchors"], np.uint64), np.uint64), joined(unpack(pdf["segments"], np.uint64), np.uint64), joined(unpack(pdf["flags"], np.uint8), np.uint8)
    order = np.lexsort((g, a))
    return a[order], g[order], f[order]


def _hot(c: Chunk, a: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Segments of the chunk whose anchor is hot."""
    return np.flatnonzero(np.isin(c.anchor, a[flags & SPREAD > 0]))


def send_bytes(shards: int, length: int, anchor: int):
    def send(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        a, g, flags = _told(told)
        text, left, strings = [b""] * len(a), np.zeros(len(a), np.int32), []
        have = flags & OWNER == 0
        for part in parts(docs) if len(a) else ():
            c = Chunk(part, length, anchor)
            at = lookup((a, g), (c.anchor, c.segment))
            for i in np.flatnonzero((at >= 0) & ~have[at]).tolist():
                if not have[at[i]]:
                    have[at[i]], text[at[i]], left[at[i]] = True, c.data[c.start[i] : c.end[i]].tobytes(), c.left[i]
            if len(hot := _hot(c, a, flags)):
                strings.append(c.strings(hot, length)[1:])
        rows: dict[int, list] = {}
        none = np.zeros(0, np.uint64).tobytes()
        use = np.flatnonzero(flags & SPREAD == 0)
        for s, i in by_shard(a[use], shards):
            i = use[i]
            own = [text[k] for k in i.tolist() if flags[k] & OWNER]
            mine = flags[i] & OWNER > 0
            rows[s] = [s, key[0], a[i].tobytes(), g[i].tobytes(), flags[i].tobytes(), left[i[mine]].tobytes(), np.fromiter(map(len, own), np.int32, len(own)).tobytes(), b"".join(own), none, none, b""]
        if strings:
            w, v = (joined([x[k] for x in strings], np.uint64) for k in range(2))
            order, new = runs(w, v)
            first = np.flatnonzero(new)
            twice = np.diff(np.append(first, len(order))) > 1
            w, v = w[order[first]], v[order[first]]
            for s, i in by_shard(w, shards):
                row = rows.setdefault(s, [s, key[0], none, none, b"", b"", b"", b"", none, none, b""])
                row[8:] = w[i].tobytes(), v[i].tobytes(), twice[i].tobytes()
        hot = np.flatnonzero(flags & SPREAD)
        if len(hot):  # the chunk hears of its hot anchors again, by way of one shard
            row = rows.setdefault(key[0] % shards, [key[0] % shards, key[0], none, none, b"", b"", b"", b"", none, none, b""])
            row[2], row[3], row[4] = row[2] + a[hot].tobytes(), row[3] + g[hot].tobytes(), row[4] + flags[hot].tobytes()
        return pd.DataFrame(list(rows.values()), columns=[x.split()[0] for x in SENT.split(", ")])

    return send


def common_prefixes(data: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the bytes from left and from right on, at most `most`, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 8, 8), (1, 1))
    out, live = np.zeros(len(left), np.int64), np.flatnonzero(most > 0)
    while len(live):
        differs = eight[left[live] + out[live]] != eight[right[live] + out[live]]
        run = np.where(differs.any(1), differs.argmax(1), 8)
        out[live] += run
        live = live[(run == 8) & (out[live] < most[live])]
    return np.minimum(out, most)


def sorted_bytes(texts: list[bytes], anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (anchor, text), and for each neighbour pair of that order whether it has one anchor and its common prefix."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    # An end mark that UTF-8 never holds: fixed-width byte strings drop zero bytes at their end.
    order = np.argsort(np.array([t + b"\xff" for t in texts], dtype=bytes), kind="stable")
    order = order[np.argsort(anchors[order], kind="stable")]
    same = anchors[order[1:]] == anchors[order[:-1]]
    most = np.where(same, np.minimum(sizes[order[1:]], sizes[order[:-1]]), 0)
    return order, same, common_prefixes(np.frombuffer(b"".join(texts), np.uint8), starts[order[:-1]], starts[order[1:]], most)


def intervals(same: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """(first, last, common prefix) of the nodes of the interval tree, by a stack scan of the common prefixes."""
    out, stack = [], []
    for at, (joined_, now) in enumerate(zip([*same.tolist(), False], [*lcp.tolist(), 0], strict=True)):
        now, first = now if joined_ else -1, at
        while stack and stack[-1][1] > now:
            first, size = stack.pop()
            out.append((first, at, size))
        if now >= 0 and (not stack or stack[-1][1] < now):
            stack.append((first, now))
    return np.array(out, np.int64).reshape(-1, 3)


def maximal_repeats(anchors: np.ndarray, segments: list[bytes], lefts: np.ndarray, length: int):
    """(segment, from, to) of the occurrences of maximal repeats of at least `length` bytes in segments of equal anchors."""
    none = np.zeros(0, np.int64)
    if len(segments) < 2:
        return none, none, none
    cuts = lefts.tolist()
    order, same, lcp = sorted_bytes([t[c:] for t, c in zip(segments, cuts, strict=True)], anchors)
    before = [t[:c][::-1] for t, c in zip(segments, cuts, strict=True)]
    place = np.empty(len(segments), np.int64)
    by_left, _, _ = sorted_bytes(before, anchors)
    place[by_left] = np.arange(len(by_left))
    nodes = intervals(same, lcp)
    sizes = nodes[:, 1] - nodes[:, 0] + 1
    node = np.repeat(np.arange(len(nodes)), sizes)
    member = order[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + nodes[node, 0]] if len(nodes) else none
    by = np.lexsort((place[member], node))  # members of each interval by the bytes in front of the anchor
    node, member = node[by], member[by]
    x, y, together = member[:-1], member[1:], node[1:] == node[:-1]
    ends = np.cumsum(lefts)
    data = np.frombuffer(b"".join(before), np.uint8)
    extent = common_prefixes(data, ends[x] - lefts[x], ends[y] - lefts[y], np.where(together, np.minimum(lefts[x], lefts[y]), 0))
    right = nodes[node, 2]
    found = together & (extent + right[1:] >= length)  # left extensions differ beyond: the repeat is maximal
    who = np.concatenate([x[found], y[found]])
    back, ahead = np.tile(extent[found], 2), np.tile(right[1:][found], 2)
    return who, lefts[who] - back, lefts[who] + ahead


def repeated_ranges(length: int):
    """For each chunk the segments that it named, with their repeated ranges, and its repeated strings of hot anchors."""

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        named = unpack(pdf["anchors"], np.uint64)
        a, flags = joined(named, np.uint64), joined(unpack(pdf["flags"], np.uint8), np.uint8)
        own = np.flatnonzero(flags & OWNER)
        lefts, sizes = (joined(unpack(pdf[c], np.int32), np.int32).astype(np.int64) for c in ("lefts", "sizes"))
        ends, data = np.cumsum(sizes), b"".join(pdf["bytes"])
        text = [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        ranges: dict[int, list[tuple[int, int]]] = {}
        for i, b, e in zip(*(x.tolist() for x in maximal_repeats(a[own], text, lefts, length)), strict=True):
            ranges.setdefault(int(own[i]), []).append((b, e))
        w, v, twice = joined(unpack(pdf["wins"], np.uint64), np.uint64), joined(unpack(pdf["more"], np.uint64), np.uint64), joined(unpack(pdf["twice"], bool), bool)
        order, new = runs(w, v)
        group = np.cumsum(new) - 1
        again = np.zeros(len(w), bool)
        if len(w):
            again[order] = (np.bincount(group, 1 + twice[order].astype(np.int64)) > 1)[group]
        rows, at, win = [], 0, 0
        for chunk, p, g, strings in zip(pdf["chunk"], named, pdf["segments"], pdf["wins"], strict=True):
            f = flags[at : at + len(p)]
            found = [b"" if x & (AGAIN | SPREAD) else _merged(ranges.get(i, [])) for i, x in enumerate(f.tolist(), at)]
            mine = win + np.flatnonzero(again[win : win + len(strings) // 8])
            rows.append((chunk, p.tobytes(), g, f.tobytes(), np.fromiter((len(x) // 8 for x in found), np.int32, len(found)).tobytes(), b"".join(found), w[mine].tobytes(), v[mine].tobytes()))
            at, win = at + len(p), win + len(strings) // 8
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])

    return find


def _merged(ranges: list[tuple[int, int]]) -> bytes:
    out: list[list[int]] = []
    for b, e in sorted(ranges):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return np.array(out, np.int32).tobytes()


def cut_out(length: int, anchor: int):
    def cut(key: tuple, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        a, g, flags = (joined(unpack(found[c], kind), kind) for c, kind in (("anchors", np.uint64), ("segments", np.uint64), ("flags", np.uint8)))
        counts, ranges = joined(unpack(found["counts"], np.int32), np.int32).astype(np.int64), joined(unpack(found["ranges"], np.int32), np.int32).reshape(-1, 2).astype(np.int64)
        ends = np.cumsum(counts)
        order = np.lexsort((g, a))
        w, v = joined(unpack(found["wins"], np.uint64), np.uint64), joined(unpack(found["more"], np.uint64), np.uint64)
        by = np.lexsort((v, w))
        rows, ids = [], []
        for part in parts(docs):
            c = Chunk(part, length, anchor)
            at = lookup((a[order], g[order]), (c.anchor, c.segment))
            hit = np.flatnonzero(at >= 0)
            k = order[at[hit]]
            whole = flags[k] & AGAIN > 0
            marks = [np.column_stack([c.start[hit[whole]], c.end[hit[whole]]])]
            for i, x in zip(hit[~whole].tolist(), k[~whole].tolist(), strict=True):
                if counts[x]:
                    marks.append(ranges[ends[x] - counts[x] : ends[x]] + c.start[i])
            if len(hot := _hot(c, a, flags)):
                first, one, two = c.strings(hot, length)
                first = first[lookup((w[by], v[by]), (one, two)) >= 0]
                marks.append(np.column_stack([first, first + length]))
            marks = np.concatenate(marks)
            gone = spread(marks, len(c.data)) if len(marks) else np.zeros(len(c.data), bool)
            for i, (e, n) in enumerate(zip(c.ends.tolist(), c.sizes.tolist(), strict=True)):
                x = gone[e - n : e]
                removed = int(x.sum())
                kept = c.texts[i] if not removed else c.data[e - n : e][~x].tobytes()
                spans = int(x[:1].sum() + (x[1:] & ~x[:-1]).sum()) if removed else 0
                rows.append((n, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            ids.append(c.ids)
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        out.insert(0, "id", pd.concat(ids).to_numpy() if ids else [])
        return out.astype({"id": "Int64"})

    return cut


def remove_repeated_bytes(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept): what stays of each document."""
    chunked, shards = dealt(docs, id_col, text_col, "binary")
    chunks = chunked.groupBy("chunk")
    named = chunks.applyInPandas(send_segments(shards, length, anchor), SEGMENTS)
    asked = named.groupBy("shard").applyInPandas(asked_segments, "chunk int, anchors binary, segments binary, flags binary")
    sent = chunks.cogroup(asked.groupBy("chunk")).applyInPandas(send_bytes(shards, length, anchor), SENT)
    found = sent.groupBy("shard").applyInPandas(repeated_ranges(length), FOUND)
    out = chunks.cogroup(found.groupBy("chunk")).applyInPandas(cut_out(length, anchor), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
