"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary and its scores come from a model file. A text is a space and the text itself, with spaces written as
U+2581; its encoding is the segmentation into pieces with the largest sum of scores (of equal sums, the one whose last
piece is longest, and so on backwards). Characters without a piece of their own, and U+2581 itself, become the bytes of
their UTF-8 form. Decoding joins the pieces and drops the leading space, so decoding an encoding gives the text back.

Texts beyond CHUNK code points are split into chunks that are handled apart:

1. A boundary state is how many code points a piece begun in the chunk before reaches into this one. Each chunk gives a
   transfer matrix: for each state before and after it, the best sum of the pieces that begin in it.
2. The matrices of a text are combined in max-plus algebra, which is associative, and the best states between the chunks
   are traced back. Only matrices travel for this, STATES * STATES numbers a chunk.
3. With both its states known, each chunk is traced back on its own.

Inside a chunk the same algebra is used where it is simplest: no piece has a space after another character, so at every
such place, and around byte characters, state 0 is the only one and the matrix is a number. The stretches between these
places are the units of work; equal ones are solved once a batch, all together, one code point a step.

Cases: null and empty texts have no tokens. Repeated rows are encoded row by row; for giant texts, rows are told apart
by their id and text. Ids may be null or repeat. Empty tables give empty results. Other columns of the input are not
read and are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import Rolling, id_and_text, materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32768
STEP_CHARS = 1_000_000
LONG = 48  # stretches beyond this are solved one by one
SPACE, MARK = ord(" "), 0x2581
NEVER = -np.inf


SLOTS = 1 << 18


def slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)


@dataclass
class Vocabulary:
    alphabet: np.ndarray  # code point -> small number, 0 for those without a piece
    edges: np.ndarray  # open addressing: node << 16 | number, -1 where empty
    targets: np.ndarray
    score: np.ndarray  # by node, NEVER where no piece ends
    piece: np.ndarray  # by node
    byte_ids: np.ndarray
    text: np.ndarray  # bytes of all pieces, end to end
    text_at: np.ndarray
    states: int
    children: list[dict[int, int]]

    def step(self, node: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The nodes that the numbers lead to, -1 where there is none."""
        key = node << 16 | number
        at = slot(key)
        found = self.edges[at]
        out = np.where(found == key, self.targets[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (SLOTS - 1)
            found = self.edges[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.targets[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids, pieces, text = np.full(256, -1), {}, []
    for i in range(size):
        p = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            text.append(bytes([int(p[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            text.append(b"")
        else:
            pieces[p] = i
            text.append(p.replace(chr(MARK), " ").encode())
    singles = {p for p in pieces if len(p) == 1}
    usable = {p: i for p, i in pieces.items() if all(c in singles for c in p) and chr(MARK) not in p.lstrip(chr(MARK))}
    alphabet = np.zeros(0x110000, np.int32)
    for k, c in enumerate(sorted(singles), 1):
        alphabet[SPACE if ord(c) == MARK else ord(c)] = k
    children: list[dict[int, int]] = [{}]
    score, piece = [NEVER], [-1]
    for p, i in sorted(usable.items()):
        node = 0
        for c in p:
            k = int(alphabet[SPACE if ord(c) == MARK else ord(c)])
            if k not in children[node]:
                children[node][k] = len(children)
                children.append({})
                score.append(NEVER)
                piece.append(-1)
            node = children[node][k]
        score[node], piece[node] = model.get_score(i), i
    links = [(n << 16 | k, t) for n, d in enumerate(children) for k, t in d.items()]
    if len(links) * 2 > SLOTS:
        raise ValueError("the vocabulary is too large for the table of its edges")
    edges, targets = np.full(SLOTS, -1, np.int64), np.full(SLOTS, -1, np.int64)
    for (key, target), at in zip(links, slot(np.array([x[0] for x in links], np.int64)).tolist()):
        while edges[at] >= 0:
            at = (at + 1) & (SLOTS - 1)
        edges[at], targets[at] = key, target
    at = np.concatenate([[0], np.cumsum([len(t) for t in text])])
    return Vocabulary(alphabet, edges, targets, np.array(score), np.array(piece), byte_ids, np.frombuffer(b"".join(text), np.uint8), at, max(map(len, usable)), children)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def cuts(v: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """Places (from 0) at which no piece can span: before a space after another character, and around byte characters."""
    number = v.alphabet[codes]
    space = codes == SPACE
    cut = np.zeros(len(codes), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | (number[1:] == 0) | (number[:-1] == 0)
    return np.flatnonzero(cut)


def solve_one(v: Vocabulary, codes: np.ndarray, begin_before: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one stretch without byte characters: for each end the best sum, the last piece's length and its id.

    begin_before: pieces begin only at places before this one.
    """
    number = v.alphabet[codes].tolist()
    n = len(number)
    best, back, last = [NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for s in range(n if begin_before is None else min(n, begin_before)):
        node, base = 0, best[s]
        if base == NEVER:
            continue
        for e in range(s, min(n, s + v.states)):
            node = v.children[node].get(number[e], -1)
            if node < 0:
                break
            x = base + v.score[node]
            if x > best[e + 1]:
                best[e + 1], back[e + 1], last[e + 1] = x, e + 1 - s, int(v.piece[node])
    return np.array(best), np.array(back), np.array(last)


def trace(back: np.ndarray, last: np.ndarray, end: int) -> list[int]:
    out = []
    while end > 0:
        out.append(int(last[end]))
        end -= int(back[end])
    return out[::-1]


def solve_all(v: Vocabulary, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches of at most LONG code points each: best sums, counts of tokens and the tokens end to end."""
    n, width = len(start), int(size.max(initial=0))
    order = np.argsort(-size, kind="stable")
    length = size[order]
    grid = np.zeros((width, n), np.int64)
    for t in range(width):
        k = int(np.searchsorted(-length, -t, side="left"))  # those longer than t
        grid[t, :k] = v.alphabet[flat[start[order[:k]] + t]]
    best = np.full((width + 1, n), NEVER)
    back, last = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
    best[0] = 0.0
    for s in range(width):
        lane = np.arange(int(np.searchsorted(-length, -s, side="left")))
        node = np.zeros(len(lane), np.int64)
        for e in range(s, min(width, s + v.states)):
            k = int(np.searchsorted(-length, -e, side="left"))
            inside = lane < k
            lane, node = lane[inside], node[inside]
            node = v.step(node, grid[e, lane])
            alive = node >= 0
            lane, node = lane[alive], node[alive]
            if not len(lane):
                break
            x = best[s, lane] + v.score[node]
            better = x > best[e + 1, lane]
            at = lane[better]
            best[e + 1, at], back[e + 1, at], last[e + 1, at] = x[better], e + 1 - s, v.piece[node[better]]
    lanes = np.arange(n)
    total = best[length, lanes]
    found, owner, at, lane = [], [], length.copy(), lanes
    while len(lane):
        lane = lane[at[lane] > 0]
        found.append(last[at[lane], lane])
        owner.append(lane)
        at[lane] -= back[at[lane], lane]
    ids, own = np.concatenate(found) if found else np.empty(0, np.int32), np.concatenate(owner) if owner else np.empty(0, np.int64)
    own = order[own]
    count = np.bincount(own, minlength=n)
    turned = np.argsort(own[::-1], kind="stable")
    out = np.empty(n)
    out[order] = total
    return out, count, ids[::-1][turned]


def encode_stretches(v: Vocabulary, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best sum and tokens of each stretch [start, start + size) of flat; byte characters are stretches of their own."""
    if not len(start):
        return np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
    h = Rolling(flat).span(start, start + size)
    _, pick, at = np.unique(h, return_index=True, return_inverse=True)
    u_start, u_size = start[pick], size[pick]
    raw = v.alphabet[flat[u_start]] == 0
    long = (u_size > LONG) & ~raw
    short = np.flatnonzero(~raw & ~long)
    total = np.zeros(len(pick))
    count = np.zeros(len(pick), np.int64)
    total[short], count[short], tokens = solve_all(v, flat, u_start[short], u_size[short])
    odd: dict[int, np.ndarray] = {}
    for k in np.flatnonzero(raw | long):
        if raw[k]:
            odd[k] = v.byte_ids[list(chr(int(flat[u_start[k]])).encode("utf-8", "surrogatepass"))]
        else:
            best, back, last = solve_one(v, flat[u_start[k] : u_start[k] + u_size[k]])
            total[k], odd[k] = best[-1], np.array(trace(back, last, int(u_size[k])))
        count[k] = len(odd[k])
    begin = np.zeros(len(pick), np.int64)
    begin[short] = np.cumsum(count[short]) - count[short]
    extra = list(odd)
    base = len(tokens)
    for k in extra:
        begin[k], base = base, base + len(odd[k])
    tokens = np.concatenate([tokens.astype(np.int64), *[odd[k] for k in extra]])
    n = count[at]
    index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at], n)
    return total[at], n, tokens[index]


def encode_batch(v: Vocabulary, texts: list[np.ndarray]) -> list[np.ndarray]:
    """Token ids of whole stretches of code points, each beginning and ending in state 0."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    where = np.unique(np.concatenate([cuts(v, flat), off[:-1][size > 0]])) if len(flat) else np.empty(0, np.int64)
    length = np.diff(np.append(where, len(flat)))
    _, n, tokens = encode_stretches(v, flat, where, length)
    ends = np.concatenate([[0], np.cumsum(n)])
    at = ends[np.searchsorted(where, off)]
    return [tokens[at[i] : at[i + 1]] for i in range(len(texts))]


def chunk_matrix(v: Vocabulary, codes: np.ndarray, core: int) -> np.ndarray:
    """Transfer matrix of the first `core` code points; the rest of codes is what pieces may reach into."""
    s = v.states
    m = np.full((s, s), NEVER)
    where = cuts(v, codes)
    inner = where[(where > 0) & (where < core)]
    after = where[where >= core]
    reach = int(after[0]) if len(after) else len(codes)

    def ends(begin: int) -> np.ndarray:
        """Best sums from begin to each state after the chunk, over a stretch without cuts."""
        out = np.full(s, NEVER)
        if v.alphabet[codes[begin]] == 0:
            out[0] = 0.0
            return out
        best, _, _ = solve_one(v, codes[begin:reach], core - begin)
        for k in range(min(s, reach - core + 1)):
            out[k] = best[core - begin + k]
        return out

    if not len(inner):
        for k in range(min(s, core + 1)):
            m[k] = ends(k) if k < core else np.where(np.arange(s) == 0, 0.0, NEVER)
        return m
    first, last = int(inner[0]), int(inner[-1])
    tail = ends(last)
    starts = np.append(inner[:-1], []).astype(np.int64)
    middle = encode_stretches(v, codes, starts, np.diff(inner))[0].sum() if len(starts) else 0.0
    heads = [k for k in range(min(s, first + 1))]
    for k in heads:
        if k == first or v.alphabet[codes[k]] == 0:
            pre = 0.0
        else:
            pre = solve_one(v, codes[k:first])[0][-1]
        m[k] = pre + middle + tail
    return m


def chunk_tokens(v: Vocabulary, codes: np.ndarray, core: int, state: int, leave: int) -> np.ndarray:
    """Tokens of the pieces that begin in the chunk, entered in one state and left in another."""
    if state >= core:
        return np.empty(0, np.int64)
    own = codes[state : core + leave]
    where = cuts(v, own)
    where = where[where < core - state]
    last = int(where[-1]) if len(where) else 0
    head = encode_batch(v, [own[:last]])[0] if last else np.empty(0, np.int64)
    if v.alphabet[own[last]] == 0:
        return np.concatenate([head, encode_batch(v, [own[last:]])[0]])
    _, back, ids = solve_one(v, own[last:], core - state - last)
    return np.concatenate([head, np.array(trace(back, ids, len(own) - last), np.int64)])


def combine(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """States before and after each chunk on the best path from state 0 to state 0."""
    s = len(matrices[0])
    v = np.where(np.arange(s) == 0, 0.0, NEVER)
    came = []
    for m in matrices:
        x = v[:, None] + m
        came.append(x.argmax(axis=0))
        v = x.max(axis=0)
    out, state = [], 0
    for c in reversed(came):
        out.append((int(c[state]), state))
        state = int(c[state])
    return out[::-1]


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, row (tells giant texts of one id apart; null for others), part and ids of each row; a giant text has a
    part for each chunk."""
    whole, parts = encode_apart(docs, model, chunk)
    return whole.unionByName(parts)


def encode_apart(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The rows of encode() of texts below chunk code points, and those of giant texts."""
    own = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    kind = own.schema["doc_id"].dataType.simpleString()
    small, giant = own.where(F.char_length("text") < chunk), own.where(F.char_length("text") >= chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < STEP_CHARS):
                    size += len(texts[j])
                    j += 1
                ids = encode_batch(v, [codes_of(" " + t) if t else np.empty(0, np.int64) for t in texts[i:j]])
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.nulls(j - i, pa.string()), pa.array(np.zeros(j - i, np.int32)), pa.ListArray.from_arrays(pa.array(off), flat)], names=["doc_id", "row", "part", "ids"])
                i = j

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                row, text = hashlib.sha256(text.encode()).hexdigest(), " " + text
                at = range(0, len(text), chunk)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * n, batch.column(0).type), pa.array([row] * n), pa.array(range(n), pa.int32()), pa.array([text[a : a + chunk + v.states - 1] for a in at]), pa.array([min(chunk, len(text) - a) for a in at], pa.int32())], names=["doc_id", "row", "part", "text", "core"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            m = [chunk_matrix(v, codes_of(t), c).tobytes() for t, c in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(m, pa.binary())], names=["row", "part", "matrix"])

    def states(t: pa.Table) -> pa.Table:
        part = t.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        order = order[np.append(True, np.diff(part[order]) != 0)] if len(order) else order
        size = vocabulary(model).states
        m = t.column("matrix").to_pylist()
        path = combine([np.frombuffer(m[i]).reshape(size, size) for i in order])
        return pa.table({"row": t.column("row").take(pa.array(order)).cast(pa.string()), "part": part[order].astype(np.int32), "enter": np.array([p[0] for p in path], np.int32), "leave": np.array([p[1] for p in path], np.int32)})

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            ids = [chunk_tokens(v, codes_of(t), c, a, b).tolist() for t, c, a, b in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "row", "part", "ids"])

    out = f"doc_id {kind}, row string, part int, ids array<int>"
    chunks = giant.mapInArrow(split, f"doc_id {kind}, row string, part int, text string, core int")
    path = materialize(chunks.mapInArrow(matrices, "row string, part int, matrix binary").groupBy("row").applyInArrow(states, "row string, part int, enter int, leave int"))
    parts = chunks.join(path, ["row", "part"]).select("doc_id", "row", "part", "text", "core", "enter", "leave").mapInArrow(tokens, out)
    return small.mapInArrow(whole, out), parts


def decode_bytes(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    n = v.text_at[ids + 1] - v.text_at[ids]
    index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(v.text_at[ids], n)
    return v.text[index]


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, row, part and text of each row of tokens; the parts of a text, joined in order, are the text."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            first = np.array(batch.column(2).to_pylist()) == 0
            # Chunks end between code points, so each part is valid UTF-8 by itself.
            text = [decode_bytes(v, np.array(x, np.int64))[int(f) :].tobytes() for x, f in zip(batch.column(3).to_pylist(), first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([t.decode() for t in text])], names=["doc_id", "row", "part", "text"])

    return tokens.select("doc_id", "row", "part", "ids").mapInArrow(run, f"doc_id {kind}, row string, part int, text string")


def digests(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256 of each text.

    The parts of a text must follow each other within a partition; together() sees to that.
    """
    kind = tokens.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        is_byte = np.zeros(len(v.text_at), bool)
        is_byte[v.byte_ids[v.byte_ids >= 0]] = True
        state: list | None = None  # id, row, last part, copies, counts and digests of the text being read

        def rows_of(s: list | None) -> list[tuple]:
            return [(s[0], s[4], s[5], s[6].hexdigest(), s[7].hexdigest())] * s[3] if s else []

        for batch in batches:
            rows = []
            lists = batch.column(3)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
            parts, names_of = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for k, doc in enumerate(batch.column(0).to_pylist()):
                if state and names_of[k] is not None and [doc, names_of[k], parts[k]] == state[:3]:
                    state[3] += parts[k] == 0  # a repeated row
                    continue
                ids = flat[off[k] : off[k + 1]]
                if parts[k] == 0:
                    rows += rows_of(state)
                    state = [doc, names_of[k], 0, 1, 0, 0, hashlib.sha256(), hashlib.sha256()]
                state[2] = parts[k]
                state[4] += len(ids)
                state[5] += int(is_byte[ids].sum())
                state[6].update(ids.astype("<i4").tobytes())
                state[7].update(decode_bytes(v, ids)[int(parts[k] == 0) :].tobytes())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [batch.column(0).type, *types])], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_of(state)), [batch.column(0).type, *types])], names=names)

    out = f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string"
    return tokens.select("doc_id", "row", "part", "ids").mapInArrow(run, out)


def together(tokens: DataFrame) -> DataFrame:
    """The parts of each text in order, within one partition; they are streamed, never gathered."""
    return tokens.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "part")


def round_trip(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256, decoded_sha256 of each row of docs."""
    whole, parts = encode_apart(docs, model, chunk)
    return digests(whole, model).unionByName(digests(together(parts), model))
