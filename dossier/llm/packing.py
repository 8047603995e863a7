"""Packing of tokenised documents into sequences of a fixed length: first-fit decreasing in randomised groups.

Every text becomes the ids of a public tokenizer and one end id. A document of over ``SIZE`` ids is cut into pieces; whole
pieces of ``SIZE`` ids are sequences by themselves, the last piece of each document is packed. Packed pieces are dealt into
groups of about ``GROUP`` by a hash of their row, and each group is packed alone: pieces in falling length, each into the
first bin with room, which a tournament tree over the bins' capacities finds in log steps. Gaps of ``LEAST`` ids or more that
are then left (say, where most documents have just over half a sequence) are filled with the pieces of the emptiest bins, cut
where the gap ends. So at most ``LEAST`` - 1 ids of a sequence are padding, but for one sequence a group.

No token of the tokenizers meant here spans a blank that follows another character, so a text is encoded chunk by chunk (blanks and the
characters up to the next blank), and the ids of chunks are remembered within a Python worker, up to about ``CHUNKS`` of them. Chunks are cut
on the bytes of many texts at once and numbered by Arrow's dictionary encoding, so only the different ones of a batch are looked up. New chunks are
encoded many at a time as one text, whose ids are dealt to them by the characters that each id stands for. Long texts are
encoded and cut ``BLOCK`` characters at a time, so beside the text itself memory stays bounded.

Defined results: null and empty texts have the end id alone; rows that repeat and rows without an id are documents of their
own, spread over all groups; extra columns are ignored; an empty table gives an empty result. A group is decided by the place of the
row in the written table of pieces, so a retried task finds the same groups. Ids, order and cuts depend on nothing else.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import materialize, table

SIZE, GROUP, LEAST, END_ID, SEED = 2048, 4096, 32, 1, 11
CHUNKS, BLOCK, JOINT = 500_000, 1 << 20, 200
#: Marks before which a chunk ends if a letter stands before them, as no token joins the two.
MARKS = ".,;:!?$%*()#&"
_BLANK, _LETTER, _MARK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*b" \n"]], _KIND[[*range(65, 91), *range(97, 123)]], _KIND[[*MARKS.encode()]] = _BLANK, _LETTER, _MARK
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
PLACED = PIECE + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    """Path of the byte-level vocabulary of 50,257 ids that is installed beside the tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of many texts, each followed by the end id."""

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.chars = starts_of_ids(self.tokenizer)
        self.known = {None: 1}  # chunk -> where its ids start, times 2**24, and their number; None is the end of a document
        self.flat = array("i", [end_id])
        self.uses = array("i", [0])  # at the start of a chunk's ids: how many batches used it

    def forget(self) -> None:
        """All chunks but those that several batches used, the most used ones first, half of `CHUNKS` at most; if there are more, counts are halved, so old use fades."""
        del self.known[None]
        names, place = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        uses = np.frombuffer(self.uses, np.int32)[place >> 24]
        often = np.flatnonzero(uses > 1)
        kept = np.sort(often[np.argsort(-uses[often], kind="stable")[: CHUNKS // 2]])
        place, count = place[kept], place[kept] & 0xFFFFFF
        start = 1 + count.cumsum() - count
        ids = gathered(np.frombuffer(self.flat, np.int32), place >> 24, count)
        self.flat = array("i", [self.end_id])
        self.flat.frombytes(ids.tobytes())
        self.uses = array("i", bytes(4 * len(self.flat)))
        np.frombuffer(self.uses, np.int32)[start] = uses[kept] // (1 + (len(kept) < len(often)))
        self.known = {None: 1} | dict(zip([names[i] for i in kept.tolist()], ((start << 24) | count).tolist(), strict=True))

    def learn(self, chunks: list[str]) -> None:
        joint = [c for c in chunks if c[0] in " \n" and c[-1].isalnum()]  # no token spans the blank between two of them
        if not self.together(joint):
            joint = []
        held = set(joint)
        self.alone([c for c in chunks if c not in held])

    def together(self, chunks: list[str]) -> bool:
        """Learns chunks that start with a blank and end with a letter or digit from joint texts; False (nothing learnt) if their ids do not tell where each ends."""
        texts = ["".join(chunks[i : i + JOINT]) for i in range(0, len(chunks), JOINT)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in found), np.int32)
        before = np.concatenate([[0], self.chars[ids].cumsum()])  # characters that start before each id
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        start = np.concatenate([[0], length.cumsum()])
        at = np.searchsorted(before, start, "right") - 1  # ids that only go on with a character stand before the next chunk's first
        if before[-1] != start[-1] or (before[at] != start).any():
            return False
        self.known.update(zip(chunks, (((len(self.flat) + at[:-1]) << 24) | np.diff(at)).tolist(), strict=True))
        self.flat.frombytes(ids.tobytes())
        return True

    def alone(self, chunks: list[str]) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        start = len(self.flat) + n.cumsum() - n
        self.flat.extend(chain.from_iterable(found))
        self.known.update(zip(chunks, ((start << 24) | n).tolist(), strict=True))

    def __call__(self, texts: list[str], ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        found, bounds = chunked(texts)
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()  # of text objects, several times faster than to_pylist
        if len(self.known) > CHUNKS:
            self.forget()
        place = np.fromiter(map(self.known.get, names, repeat(0)), np.int64, len(names))
        unknown = np.flatnonzero(place == 0)
        new = [names[i] for i in unknown.tolist()]
        self.learn(new)
        place[unknown] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.uses.frombytes(bytes(4 * (len(self.flat) - len(self.uses))))
        np.frombuffer(self.uses, np.int32)[place >> 24] += 1
        place = place[found.indices.to_numpy()]
        n = np.diff(bounds) + ends
        if ends:
            place = np.insert(place, bounds[1:], self.known[None])
        count = place & 0xFFFFFF
        ends_at = count.cumsum()
        flat = gathered(np.frombuffer(self.flat, np.int32), place >> 24, count)
        total = np.concatenate([[0], ends_at])[n.cumsum()] if len(n) else n
        return flat, np.diff(total, prepend=0)


def chunked(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of all texts in a row, as a dictionary array, and the number of chunks before each text and after the last."""
    column = pa.array(texts, pa.large_string())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64, len(texts) + 1)
    data = np.frombuffer(data or b"", np.uint8, edges[-1])
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))  # of the Latin letters beyond ASCII, but for two signs among them
    kind[lead + 1] = np.where((data[lead] == 0xC3) & ((data[lead + 1] & 0xDF) == 0x97), 0, _LETTER)
    starts = np.zeros(len(data) + 1, bool)
    starts[1:-1] = ((kind[1:] == _BLANK) & (kind[:-1] != _BLANK)) | ((kind[1:] == _MARK) & (kind[:-1] == _LETTER))
    starts[edges] = True  # and the end, which is no chunk's
    at = np.flatnonzero(starts)
    chunks = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
    return chunks.dictionary_encode(), np.searchsorted(at, edges)


def starts_of_ids(tokenizer) -> np.ndarray:
    """How many characters start in the bytes of each id of a byte-level vocabulary: its bytes but those that go on with a character."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte-level alphabet writes as themselves
    others = [b for b in range(256) if b not in plain]
    goes_on = {chr(b) for b in plain if 128 <= b < 192} | {chr(256 + k) for k, b in enumerate(others) if 128 <= b < 192}
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = sum(c not in goes_on for c in token)
    return out


@lru_cache(2)
def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker, which serves many tasks: what it has learnt stays."""
    return Encoder(path, end_id)


def gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of `count` values from `start` on, one after the other."""
    before = count.cumsum() - count
    return flat[np.repeat(start - before, count) + np.arange(int(count.sum()))]


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """A text in parts of about `size` characters, cut before a blank that follows another character."""
    at = 0
    while len(text) - at > size:
        cut = _EDGE.search(text, at + size - 1)
        if cut is None:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


_EDGE = re.compile(r"[^ \n][ \n]")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Pieces (doc_id, start, ids, doc_tokens) as an Arrow batch."""
    ids = [r[2] for r in rows]
    lengths = np.array([len(x) for x in ids], np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lengths.cumsum()]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    longs = [[r[0] for r in rows], [r[1] for r in rows], lengths, [_crc(x) for x in ids], [r[3] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in longs] + [lists], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, at most `size` ids each; every id lies in exactly one. `tokenizer`: path of a tokenizers file on every executor."""
    path = tokenizer or default_tokenizer()

    def cut(doc, ids: np.ndarray, first: int, total: int) -> list[tuple]:
        return [(doc, first + i, ids[i : i + size], total) for i in range(0, len(ids), size)]

    def long(encode: Encoder, doc, text: str) -> Iterator[pa.RecordBatch]:
        total = sum(len(encode([b], False)[0]) for b in blocks(text)) + 1
        start, rest = 0, np.zeros(0, np.int32)
        for b in blocks(text):
            rest = np.concatenate([rest, encode([b], False)[0]])
            whole = len(rest) // size * size
            if whole:
                yield _batch(cut(doc, rest[:whole], start, total))
            start, rest = start + whole, rest[whole:]
        yield _batch(cut(doc, np.append(rest, np.int32(end_id)), start, total))

    def short(encode: Encoder, docs: list, texts: list[str]) -> pa.RecordBatch:
        flat, n = encode(texts)
        at = n.cumsum()
        return _batch([p for doc, a, b in zip(docs, at - n, at, strict=True) for p in cut(doc, flat[a:b], 0, int(b - a))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        for batch in batches:
            held, texts, chars = [], [], 0
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                doc, text = doc.as_py(), value.as_py() or ""
                if len(text) > BLOCK:
                    yield from long(encode, doc, text)
                    continue
                held.append(doc)
                texts.append(text)
                chars += len(text)
                if chars >= BLOCK:
                    yield short(encode, held, texts)
                    held, texts, chars = [], [], 0
            if held:
                yield short(encode, held, texts)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECE)


def first_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of items, each item in the first bin that has room; items are taken in the given order.

    The leaves of the tree are the bins' capacities, every inner node holds the greater of its two, so the first bin with
    room is found by going left wherever the left side has it.
    """
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    room = [size] * (2 * leaves)
    bins: list[list[int]] = []
    for item, need in enumerate(lengths):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(item)
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins


def filled(bins: list[list[tuple[int, int, int]]], size: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) whose gaps of `least` or more are filled from the emptiest bins; an emptied bin goes."""
    bins = sorted(([*b] for b in bins), key=lambda b: -sum(x[2] for x in b))
    gaps = [size - sum(x[2] for x in b) for b in bins]
    to, last = 0, len(bins) - 1
    while to < last:
        if gaps[to] < least:
            to += 1
            continue
        item, start, length = bins[last].pop()
        take = min(gaps[to], length)
        bins[to].append((item, start, take))
        gaps[to] -= take
        if take < length:
            bins[last].append((item, start + take, length - take))
        if not bins[last]:
            last -= 1
    return bins[: last + 1]


def packed(found: DataFrame, size: int = SIZE, group: int = GROUP, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """Pieces with sequence_id and offset. Whole pieces have even sequence ids, packed ones odd ids that start with their group."""
    found = materialize(found.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    whole = found.where(F.col("length") == size).select("*", (F.col("__row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("__row")
    rest = found.where(F.col("length") < size)
    groups = max(1, -(-rest.count() // group))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        rows = rows.sort_by([("length", "descending"), ("__row", "ascending")])
        lengths = rows["length"].to_numpy()
        bins = filled([[(i, 0, int(lengths[i])) for i in b] for b in first_fit(lengths.tolist(), size)], size, least)
        item, begin, length = np.array([x for b in bins for x in b], np.int64).T
        fill = np.array([len(b) for b in bins])
        before = length.cumsum() - length
        ids = gathered(rows["ids"].combine_chunks().flatten().to_numpy(), (lengths.cumsum() - lengths)[item] + begin, length)
        crc = rows["ids_crc32"].to_numpy()[item]
        for i in np.flatnonzero(lengths[item] != length).tolist():
            crc[i] = _crc(ids[before[i] : before[i] + length[i]])
        sequence = (np.int64(key[0].as_py()) * (1 << 32) + np.repeat(np.arange(len(bins)), fill)) * 2 + 1
        lists = pa.ListArray.from_arrays(pa.array(np.append(before, before[-1] + length[-1]), pa.int32()), pa.array(ids, pa.int32()))
        start = rows["start"].to_numpy()[item] + begin
        columns = [rows["doc_id"].take(pa.array(item)), start, length, crc, rows["doc_tokens"].to_numpy()[item], lists, sequence, before - np.repeat(before[fill.cumsum() - fill], fill)]
        return pa.table(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"])

    dealt = rest.withColumn("__group", F.pmod(F.xxhash64("__row", F.lit(seed)), F.lit(groups)))
    placed = dealt.groupBy("__group").applyInArrow(pack, PLACED)
    return whole.unionByName(placed)


def sequences(placed: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """(sequence_id, input_ids, segments): the ids of each sequence with its padding, and per id the number of its piece (1, 2, ..; 0: padding).

    Padding goes up to `size`, but a sequence that ends at a power of two has none. A sequence gathers at most `size` ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = placed.groupBy("sequence_id").agg(parts.alias("p"))
    n = F.size("ids")
    missing = F.when(F.conv(n.cast("string"), 10, 2).rlike("^10*$"), 0).otherwise(size - n)
    rows = rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x.ids)).alias("ids"), F.flatten(F.transform("p", lambda x, i: F.array_repeat(i + 1, F.size(x.ids)))).alias("segments"))
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), missing)).alias("input_ids"), F.concat("segments", F.array_repeat(F.lit(0), missing)).alias("segments"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents"))).drop("ids")
