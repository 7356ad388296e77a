"""Packing of documents into sequences: first-fit decreasing in random groups, by a tournament tree of bin capacities.

1. Ids. Each whole text becomes ids of a given tokenizer and an end id. White space separates the tokenizer's words, so
   a task asks it for each distinct word once. Texts longer than a sequence are cut into full sequences and a rest. Pieces
   are written with their ids to the shared folder; what follows reads their lengths only.
2. Groups. Each piece goes to a group by a hash of its number in that table, so neither copies nor a hot source gather in
   one, and a group holds about PER_GROUP pieces, whatever the number of documents.
3. First fit. The pieces of a group, longest first, go to the first bin with room. The bins' rooms are the leaves of a
   tournament tree whose inner nodes hold the greatest room below, so that bin is found in as many steps as it has levels.
4. Filling up. Bins that still have a gap of LEAST_CUT ids or more are filled, fullest first, with ids of the emptiest
   ones, which are cut for it. What is left of the last bin becomes sequences of powers of two, which need no padding.

Cases: a null or empty text is the end id alone. Texts of any length are read whole. Repeated rows and rows with null ids
are packed each for itself. Other columns of the input are not read and are not returned. Empty tables give an empty
result. Which documents share a sequence depends on how the input is split; what holds for every packing does not: each id
lies in one piece, and offsets of a sequence have no gap.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import IdFilter, byte_view, discard, id_and_text, materialize, steps

CAPACITY, END_ID = 2048, 1
PER_GROUP = 4096
#: Gaps of less ids are left as padding, so that no document is cut into crumbs.
LEAST_CUT = 16
#: Words that a worker remembers, and bytes of the longest one; longer ones are encoded each time.
REMEMBERED, LONGEST_WORD = 1 << 20, 64
_GAPS = bytes.maketrans(b"\t\n\r", b"   ")
#: Bytes of text that are encoded at a time; each word that is new in them is told once.
STEP_BYTES = 1 << 21
_SIGNS = {b".", b",", b";", b":", b"!", b"?"}
#: Small letters that have no other form, and words of them.
SMALL_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_SMALL_WORD = re.compile(f"[{SMALL_LETTERS}]+")
_SMALL = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts as little-endian numbers, from a tokenizer whose words never cross white space and whose words of
    letters end at a sign (it also has to take capitals as small letters)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.code, self.kind = ("I", np.dtype("<u4")) if wide else ("H", np.dtype("<u2"))
        self.known: dict[bytes, bytes] = {b"": b""}
        # Words of small letters go straight to the tokenizer's model, if it leaves such letters as they are and together.
        cut = lambda x: [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(x))]
        told = {c: cut(c) for c in SMALL_LETTERS} if self.tokenizer.normalizer and self.tokenizer.pre_tokenizer else {}
        whole = bool(told) and all(len(x) == 1 for x in told.values()) and cut(SMALL_LETTERS) == ["".join(x[0] for x in told.values())]
        self.letters = str.maketrans({c: x[0] for c, x in told.items()}) if whole else None
        self.model = self.tokenizer.model

    def ask(self, words: list[bytes]) -> None:
        """Put what the tokenizer says of the words into known."""
        rest = []
        for w in words:
            t = w.decode("utf-8", "replace")
            if self.letters and _SMALL_WORD.fullmatch(t):
                self.known[w] = array(self.code, [x.id for x in self.model.tokenize(t.translate(self.letters))]).tobytes()
            else:
                rest.append((w, t))
        for (w, _), e in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)):
            self.known[w] = array(self.code, e.ids).tobytes()

    def learn(self, new: list[bytes]) -> list[bytes]:
        """Put the ids of new words into known; what was put there. A sign behind a letter is told apart, and so are
        capitals, so that fewer words go to the tokenizer; marks that join the letter before them keep a word as it is."""
        signs = [w[-1:] if w[-1:] in _SIGNS and w[-2:-1].isalpha() else b"" for w in new]
        stems = [w[:-1] if s else w for w, s in zip(new, signs)]
        stems = [w if b"<" in w or b"\xcc" in w else w.lower() for w in stems]
        known = self.known
        asked = list({*stems, *signs}.difference(known))
        self.ask(asked)
        for w, stem, sign in zip(new, stems, signs):
            if sign or w != stem:
                known[w] = known[stem] + known[sign]
        return asked + new

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.translate(_GAPS).split(b" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {b"": b""}
        put = self.learn(list(set().union(*split).difference(self.known)))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), self.kind) for ws in split]
        for w in put:
            if len(w) > LONGEST_WORD:
                self.known.pop(w, None)
        return out


#: Encoders of this worker, which several tasks use one after another.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cut_texts(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, text to pieces of at most capacity ids; piece numbers are unique in the table that is written."""
    coder, at = encoder(path), TaskContext.get().partitionId() << 40
    for batch in batches:
        data, off = byte_view(batch.column(1))
        for i, j in steps(off, STEP_BYTES):
            rows, start, length, total, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(coder.encode([data[off[k] : off[k + 1]].tobytes() for k in range(i, j)]), i):
                text = np.append(text, np.array(end_id, coder.kind))
                for s in range(0, len(text), capacity):
                    part = text[s : s + capacity]
                    rows.append(row)
                    start.append(s)
                    length.append(len(part))
                    total.append(len(text))
                    crc.append(_crc(part))
                    ids.append(part.tobytes())
            numbers = pa.array(np.arange(at, at + len(rows), dtype=np.int64))
            at += len(rows)
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([numbers, batch.column(0).take(pa.array(rows, pa.int64())), *longs, pa.array(ids, pa.binary())], names=["piece", *_SMALL, "ids"])


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, in the given order: the first bin with room for it. Empty bins stand behind the used ones."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room, out = [capacity] * (2 * leaves), []
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        out.append(at - leaves)
        while at > 1:
            at //= 2
            a, b = room[2 * at], room[2 * at + 1]
            most = a if a > b else b
            if room[at] == most:
                break
            room[at] = most
    return out


def fill_up(bins: list[list[tuple[int, int, int]]], capacity: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Bins of segments (item, first id, number of ids) with the same ids, and gaps of less than `least` but for
    lengths that are powers of two."""
    used = [sum(s[2] for s in b) for b in bins]
    done = [b for b, u in zip(bins, used) if capacity - u < least]
    wanting = [(u, b) for u, b in sorted(zip(used, bins), key=lambda x: -x[0]) if capacity - u >= least]
    low, high = 0, len(wanting) - 1
    while low < high:
        u, into = wanting[low]
        v, source = wanting[high]
        item, first, n = source.pop()
        take = min(n, capacity - u)
        into.append((item, first, take))
        if take < n:
            source.append((item, first + take, n - take))
        wanting[low], wanting[high] = (u + take, into), (v - take, source)
        if capacity - u - take < least:
            done.append(into)
            low += 1
        if not source:
            high -= 1
    if low == high and wanting[low][0]:
        left, rest = wanting[low]
        while left:
            size = 1 << left.bit_length() - 1
            left -= size
            bin_ = []
            while size:
                item, first, n = rest.pop()
                take = min(n, size)
                bin_.append((item, first, take))
                size -= take
                if take < n:
                    rest.append((item, first + take, n - take))
            done.append(bin_)
    return done


_PACKED = "piece long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut_from long"


def _pack_group(key: tuple[pa.Scalar, ...], rows: pa.Table, capacity: int, least: int) -> pa.Table:
    rows = rows.sort_by([("length", "descending"), ("piece", "ascending")])
    sizes = rows["length"].to_pylist()
    bins: list[list[tuple[int, int, int]]] = []
    for item, bin_ in enumerate(first_fit(sizes, capacity)):
        if bin_ == len(bins):
            bins.append([])
        bins[bin_].append((item, 0, sizes[item]))
    item, first, n, sequence, offset = [], [], [], [], []
    for number, bin_ in enumerate(fill_up(bins, capacity, least)):
        at = 0
        for i, s, take in bin_:
            item.append(i)
            first.append(s)
            n.append(take)
            sequence.append(number)
            offset.append(at)
            at += take
    out = rows.take(pa.array(item, pa.int64()))
    first, n = pa.array(first, pa.int64()), pa.array(n, pa.int64())
    cut = pc.not_equal(out["length"], n)
    ids = pa.array(np.array(sequence, np.int64) + (key[0].as_py() << 32))
    columns = [out["piece"], out["doc_id"], pc.add(out["start"], first), n, pc.if_else(cut, pa.scalar(None, pa.int64()), out["ids_crc32"]), out["doc_tokens"], ids, pa.array(offset, pa.int64()), first]
    return pa.table(columns, names=["piece", *_SMALL, "sequence_id", "offset", "cut_from"])


def _crc_of_cuts(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows cut_from, length, ids and others: the others with the crc of that part."""
    for batch in batches:
        first, n, ids = (batch.column(k) for k in range(3))
        crc = [_crc(np.frombuffer(x.as_buffer(), kind)[a : a + m]) for a, m, x in zip(first.to_pylist(), n.to_pylist(), ids)]
        names = batch.schema.names[3:]
        yield pa.RecordBatch.from_arrays([n, pa.array(crc, pa.int64()), *batch.columns[3:]], names=["length", "ids_crc32", *names])


class Packing:
    """One packing of a table of documents (columns doc_id and text)."""

    def __init__(self, docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, per_group: int = PER_GROUP, least_cut: int = LEAST_CUT):
        path = tokenizer or tokenizer_path()
        kind = Encoder(path).kind.str
        id_type = docs.schema["doc_id"].dataType.simpleString()
        schema = f"piece long, doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
        self.kind, self.capacity = kind, capacity
        self.pieces = materialize(id_and_text(docs).mapInArrow(lambda it: _cut_texts(it, path, capacity, end_id), schema))
        groups = -(-self.pieces.count() // per_group) or 1
        dealt = self.pieces.select("piece", *_SMALL, F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("group"))
        placed = dealt.groupBy("group").applyInArrow(lambda key, rows: _pack_group(key, rows, capacity, least_cut), _PACKED.replace("start long", f"doc_id {id_type}, start long", 1))
        placed = materialize(placed)
        cuts = placed.where("ids_crc32 IS NULL")
        ids = IdFilter(cuts, "piece").keep(self.pieces.select("piece", "ids"), "piece").withColumnRenamed("piece", "_piece")
        found = cuts.join(ids, F.col("piece") == F.col("_piece")).select("cut_from", "length", "ids", "doc_id", "start", "doc_tokens", "sequence_id", "offset", "piece")
        found = found.mapInArrow(lambda it: _crc_of_cuts(it, kind), f"length long, ids_crc32 long, doc_id {id_type}, start long, doc_tokens long, sequence_id long, offset long, piece long")
        columns = [*_SMALL, "sequence_id", "offset", "piece"]
        self.placed = placed.where("ids_crc32 IS NOT NULL").select(columns).unionByName(found.select(columns))

    def table(self) -> DataFrame:
        """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece."""
        return self.placed.drop("piece")

    def sequences(self, pad_id: int = 0) -> DataFrame:
        """sequence_id, n_ids, and ids (array of int) padded to the capacity unless n_ids is a power of two."""
        kind, capacity = self.kind, self.capacity
        first = self.pieces.select(F.col("piece").alias("_piece"), F.col("start").alias("_start"), "ids")
        parts = self.placed.join(first, F.col("piece") == F.col("_piece")).select("sequence_id", "offset", (F.col("start") - F.col("_start")).alias("low"), "length", "ids")

        def joined(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("offset")
            ids = np.concatenate([np.frombuffer(x.as_buffer(), kind)[a : a + m] for a, m, x in zip(rows["low"].to_pylist(), rows["length"].to_pylist(), rows["ids"])]).astype(np.int32)
            whole = ids if len(ids) & len(ids) - 1 == 0 else np.append(ids, np.full(capacity - len(ids), pad_id, np.int32))
            return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([whole], pa.list_(pa.int32()))], names=["sequence_id", "n_ids", "ids"])

        return parts.groupBy("sequence_id").applyInArrow(joined, "sequence_id long, n_ids long, ids array<int>")

    def discard(self) -> None:
        """Delete the ids; sequences() is no longer possible then."""
        discard(self.pieces)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, per_group: int = PER_GROUP, least_cut: int = LEAST_CUT) -> DataFrame:
    """The pieces of docs and their places, as in Packing.table. Cases as in the module's text."""
    return Packing(docs, tokenizer, capacity, end_id, per_group, least_cut).table()
