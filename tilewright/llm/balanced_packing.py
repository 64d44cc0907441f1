"""Packing of token sequences with balanced attention cost.

Every document is a run of ids with an end mark. Runs of a full sequence's length are sequences of their own; the rests
are packed: descending by length, each goes to the sequence of lowest estimated cost (linear in the tokens, quadratic in
the length of every piece, as attention stays inside a document) that has room for it. Where none has room for all of
it, the sequence of lowest cost that isn't full takes what it can hold, and what is left waits for its turn.

Rests are dealt into groups of bounded size, packed side by side. A group makes full sequences and one of the tokens that
remain; the pieces of the latter are dealt anew, until one group is left. Its remaining tokens fill sequences whose
lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

TOKENS = 2048
END = 1  # the id that ends a document
GROUP = 1000  # rests packed together
BATCH = 1 << 22  # bytes of ids returned at once

_state: dict = {}


@dataclass(frozen=True)
class Cost:
    """Estimated cost of a piece: linear * tokens + quadratic * tokens squared. By default attention costs as much as
    everything else at 4608 tokens, as in a transformer of width 768."""

    linear: float = 1.0
    quadratic: float = 1.0 / 4608

    def of(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


class ByteTokenizer:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, made by the faster encoder of tiktoken.

    Both split by the same pattern and merge the same pairs; tests compare them. Special tokens inside a text
    get their own ids, as the library gives them.
    """

    # fixed value: the pattern of a byte-level pre-tokenizer without settings of its own
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE file")
        # A byte is written as the printable character of its number, the others as those from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[x] for x in token): k for token, k in model["vocab"].items() if token not in special}
        self.special = tuple(special)
        self.width = 2 if max([*ranks.values(), *special.values(), END]) < 1 << 16 else 4
        self.encoding = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            ids = self.encoding.encode(text, allowed_special="all")
        else:
            ids = self.encoding.encode_ordinary(text)
        return np.array([*ids, END], dtype=f"<u{self.width}")


def _tokenizer(path: str) -> ByteTokenizer:
    if _state.get("path") != path:
        _state.update(path=path, tokenizer=ByteTokenizer(path))
    return _state["tokenizer"]


# A row is a sequence of one piece or more; one of one piece can be packed again.
PIECE = "struct<offset:int,length:int,id:{},start:bigint,doc_tokens:bigint>"
COLUMNS = "sequence_id bigint, length int, ids binary, pieces array<{}>"


def _schema(kind: str) -> str:
    return COLUMNS.format(PIECE.format(kind))


def _rows(sequence, ids: list[bytes], sizes: list[int], pieces: list[list], doc: pa.Array, width: int) -> pa.RecordBatch:
    """Sequences as Arrow rows. ``sizes``: pieces of each; ``pieces``: offset, length, start, doc_tokens of all of them, ``doc`` their ids."""
    offset, length, start, total = (pa.array(x, t) for x, t in zip(pieces, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True))
    borders = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
    listed = pa.ListArray.from_arrays(borders, pa.StructArray.from_arrays([offset, length, doc, start, total], names=["offset", "length", "id", "start", "doc_tokens"]))
    counts = pa.array([len(x) // width for x in ids], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(sequence, pa.int64()), counts, pa.array(ids, pa.binary()), listed], names=["sequence_id", "length", "ids", "pieces"])


def pieces(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids with its end mark, cut into full pieces and a rest; each is a row like a sequence of that one piece."""
    rows = docs.select(F.col(id_col).alias("id"), c.text_of(text_col).alias("text"))
    width = ByteTokenizer(tokenizer).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer).encode

        def ready() -> pa.RecordBatch:
            take = b.column("id").take(pa.array(source, pa.int64()))
            return _rows([0] * len(ids), ids, [1] * len(ids), [[0] * len(ids), *numbers], take, width)

        for b in batches:
            source, ids, numbers, size = [], [], [[], [], []], 0
            for k, text in enumerate(b.column("text")):
                found = encode(text.as_py())
                for at in range(0, len(found), tokens):
                    part = found[at : at + tokens].tobytes()
                    source.append(k)
                    ids.append(part)
                    size += len(part)
                    for column, v in zip(numbers, (len(part) // width, at, len(found)), strict=True):
                        column.append(v)
                    if size >= BATCH:
                        yield ready()
                        source, ids, numbers, size = [], [], [[], [], []], 0
            if ids:
                yield ready()

    out = rows.mapInArrow(run, _schema(rows.schema["id"].dataType.simpleString()))
    return out.withColumn("sequence_id", F.monotonically_increasing_id() * 16)


def assign(lengths: list[int], room: np.ndarray, cost: Cost) -> list[tuple[int, int, int, int]]:
    """Pieces (run, start in it, length, sequence) of runs of ``lengths``; the sequences have ``room`` for exactly all of them.

    Longest first; of equal lengths the earlier run, of equal costs the earlier sequence.
    """
    room, load, out = room.copy(), np.zeros(len(room)), []
    waiting = [(-n, k, 0) for k, n in enumerate(lengths)]
    heapq.heapify(waiting)
    while waiting:
        n, k, at = heapq.heappop(waiting)
        n = -n
        fits = room >= n
        whole = bool(fits.any())
        s = int(np.argmin(np.where(fits if whole else room > 0, load, np.inf)))
        take = n if whole else int(room[s])
        room[s] -= take
        load[s] += cost.of(take)
        out.append((k, at, take, s))
        if take < n:
            heapq.heappush(waiting, (take - n, k, at + take))
    return out


def _packed(rows: DataFrame, n: int, tokens: int, width: int, cost: Cost, step: int) -> tuple[DataFrame, bool]:
    """``rows`` (n of them, of one piece each) packed in groups; ``_open`` marks pieces for a next step. With one group nothing is left open."""
    groups = max(1, round(n / GROUP))
    last = groups == 1
    kind = rows.schema["pieces"].dataType.elementType["id"].dataType.simpleString()

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.combine_chunks().sort_by([("length", "descending"), ("sequence_id", "ascending")])
        piece = part["pieces"].combine_chunks().flatten()
        ids, starts, totals = part["ids"].to_pylist(), piece.field("start").to_numpy(), piece.field("doc_tokens").to_numpy()
        lengths = part["length"].to_pylist()
        full, left = divmod(sum(lengths), tokens)
        tails = [1 << k for k in range(left.bit_length()) if left >> k & 1][::-1] if last else [left] * (left > 0)
        room = np.array([tokens] * full + tails, dtype=np.int64)
        placed = sorted(assign(lengths, room, cost), key=lambda x: (x[3], x[0], x[1]))
        bins: list[list] = [[] for _ in room]
        for p in placed:
            bins[p[3]].append(p)
        if not last and left:  # the tokens that remain are dealt anew, piece by piece
            bins[full:] = [[p] for p in bins[full]]
        data, sizes, numbers, source = [], [], [[], [], [], []], []
        for content in bins:
            at, joined = 0, []
            for k, begin, length, _ in content:
                joined.append(ids[k][begin * width : (begin + length) * width])
                source.append(k)
                for column, v in zip(numbers, (at, length, starts[k] + begin, totals[k]), strict=True):
                    column.append(v)
                at += length
            data.append(b"".join(joined))
            sizes.append(len(content))
        number = (int(key[0].as_py()) << 24) + np.arange(len(bins))
        out = _rows(number * 16 + step, data, sizes, numbers, piece.field("id").take(pa.array(source, pa.int64())), width)
        still = np.arange(len(bins)) >= (len(bins) if last else full)
        return pa.Table.from_batches([out.append_column("_open", pa.array(still))])

    # The number of a row, not its content, decides on its group: repeated rows spread like others.
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(F.lit(step), "sequence_id"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, _schema(kind) + ", _open boolean"), last


def pack(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, cost: Cost = Cost(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence: sequence_id, length, ids, pieces.

    ``ids`` are little-endian numbers of 2 bytes, or of 4 if the tokenizer has more than 65,536 ids. ``pieces`` lie without gaps
    from offset 0: offset, length, id (of the document), start (ids of the document before the piece), doc_tokens (all
    its ids). Every id of every document is in exactly one piece. Sequences have ``tokens`` ids (a power of two), but
    for a few at the end whose lengths are smaller powers of two.

    A null text is empty, its only id is the end mark. Null ids and repeated rows are packed like others. A document
    longer than a sequence is cut into full sequences and a rest; a rest is cut where no sequence has room for it. An empty
    table gives no rows.
    """
    if tokens & (tokens - 1):
        raise ValueError("tokens must be a power of two")
    width = ByteTokenizer(tokenizer).width
    rows = c.save(pieces(docs, tokenizer, tokens, id_col, text_col), "runs")
    out, rows = rows.where(F.col("length") == tokens), rows.where(F.col("length") < tokens)
    for step in range(1, 16):
        n = rows.count()
        if not n:
            break
        packed, last = _packed(rows, n, tokens, width, cost, step)
        packed = c.save(packed, "balanced")
        out = out.unionByName(packed.where(~F.col("_open")).drop("_open"))
        rows = packed.where("_open").drop("_open")
        if last:
            break
    return out


def digests(sequences: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece of :func:`pack`: id, start, length, ids_crc32 (of the ids as 32-bit numbers), doc_tokens, sequence_id, offset."""
    kind = sequences.schema["pieces"].dataType.elementType["id"].dataType.simpleString()
    width = ByteTokenizer(tokenizer).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column("pieces")
            piece, parent = listed.flatten(), np.repeat(np.arange(b.num_rows), listed.value_lengths().to_numpy())
            offset, length = piece.field("offset").to_numpy(), piece.field("length").to_numpy()
            wide = [np.frombuffer(x.as_py(), dtype=f"<u{width}").astype("<u4") for x in b.column("ids")]
            sums = [zlib.crc32(wide[p][o : o + n].tobytes()) for p, o, n in zip(parent, offset, length, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.field("id"), piece.field("start"), pa.array(length.astype(np.int64)), pa.array(sums, pa.int64()), piece.field("doc_tokens"),
                 b.column("sequence_id").take(pa.array(parent)), pa.array(offset.astype(np.int64))],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return sequences.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
