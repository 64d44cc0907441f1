"""Packing of token sequences by vector best-fit.

Every document is a run of ids with an end mark; runs longer than a sequence are cut. Pieces have three demands:
tokens, one document, and attention cost (its length squared, as attention stays inside a document). A bin's
residual capacity must cover all three. Pieces are taken longest first, and of the open bins with room the one
is chosen that a weighted norm of what would be left (or a weighted dot product of demand and residual) prefers.

Pieces are dealt into groups of bounded size that are packed side by side. Bins that stay less full than
``full`` are opened again and dealt anew, in several rounds, so that the rests of all groups meet. Groups are made
by a hash, or, where an order is given, are windows of consecutive pieces of that order.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators import ordering

from . import _common as c

TOKENS = 4096
END = 1  # the id that ends a document
GROUP = 2500  # pieces packed together
ROUNDS = 3
CACHE = 250_000  # words whose ids a worker remembers, twice over
AT_ONCE = 1 << 20  # characters that are encoded together, and one more text
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"  # ASCII punctuation; not the apostrophe, nor < and > of special tokens

_state: dict = {}


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence and the weights of the three demands."""

    tokens: int = TOKENS
    documents: int = TOKENS
    attention: int = TOKENS * TOKENS
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # or "dot"


def _split(text: str) -> list[bytes]:
    """Words of a text; ASCII letters lower-cased, as the tokenizer does, unless special tokens may be in it."""
    raw = text.encode("utf-8", "surrogatepass")
    return (raw if b"<|" in raw else raw.lower()).split()


class Runs:
    """Ids of texts in ASCII and Latin letters by tiktoken, for word-level BPE files whose words end with a suffix.

    The file's pre-tokenizer makes runs of letters, single digits and runs of other marks; here a zero byte ends each run and
    stands for the suffix, which tiktoken merges first. It splits at them, and merges the same pairs by the same ranks.
    """

    SUFFIX = "</w>"
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    CONTRACTION = re.compile(rb"'(?:[stmd]|re|ve|ll)", re.IGNORECASE)
    SPACES = b" \t\n\x0b\x0c\r"
    LETTERS = bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
    MARKS = bytes(k for k in range(33, 127) if not chr(k).isalnum())
    KNOWN = SPACES + LETTERS + MARKS + b"0123456789"

    def __init__(self, spec: dict):
        """Raises ValueError if the file is of another kind."""
        import tiktoken

        model, before = spec["model"], spec["pre_tokenizer"]
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (before or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != self.SUFFIX or splits != [self.SPLIT, None] or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("no file of lower-cased words")
        vocab, merges = model["vocab"], [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        if [vocab["".join([a.removesuffix(self.SUFFIX), b])] for a, b in merges] != list(range(512, 512 + len(merges))):
            raise ValueError("ids don't follow the order of the merges")
        # A byte is written as the printable character of its number, the others as those from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for token, k in vocab.items():
            core = token.removesuffix(self.SUFFIX)
            ranks[bytes(byte[x] for x in core) + (b"" if core == token else b"\0")] = k
        if len(ranks) != 512 + len(merges) or any(ranks.get(bytes([b]) + b"\0", 512) >= 512 for b in range(256)):
            raise ValueError("not all bytes have an id")
        self.ends = np.zeros(len(ranks), dtype=bool)
        self.ends[[k for token, k in ranks.items() if len(token) > 1 and token.endswith(b"\0")]] = True
        self.encoding = tiktoken.Encoding("runs", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={})
        self.kind, self.lower = np.full(256, 3, dtype=np.uint8), np.arange(256, dtype=np.uint8)
        for k, members in enumerate((self.SPACES, self.LETTERS, b"0123456789")):
            self.kind[list(members)] = k
        for k in self.LETTERS:
            self.lower[k] = ord(chr(k).lower())
        self.lower[list(self.SPACES)] = 0

    def plain(self, text: str) -> bytes | None:
        """The text in Latin-1 if it can be encoded here."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if raw.translate(None, self.KNOWN) or b"<|" in raw or (b"'" in raw and self.CONTRACTION.search(raw)):
            return None
        return raw

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """Ids of :meth:`plain` texts as little-endian 32-bit numbers."""
        data = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
        kind = self.kind[data]
        follows = np.append(kind[1:], np.uint8(0))
        last = (kind != 0) & ((kind != follows) | (kind == 2))
        stream = np.insert(self.lower[data], np.flatnonzero(last & (follows != 0)) + 1, 0)
        ids = self.encoding.encode_to_numpy(stream.tobytes().decode("latin-1")).astype("<u4")
        ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        begins = np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]])
        runs = np.cumsum(np.add.reduceat(last, begins, dtype=np.int64))
        if runs[-1] != len(ends) - 1:
            raise RuntimeError("runs and ids don't match")
        cuts, out = [0, *(4 * ends[runs]).tolist()], ids.tobytes()
        return [out[a:z] for a, z in itertools.pairwise(cuts)]


def _encoded(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers; what :class:`Runs` can't encode goes word by word."""
    if _state.get("runs_of") != path:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        try:
            _state.update(runs_of=path, runs=Runs(spec))
        except ValueError:
            _state.update(runs_of=path, runs=None)
    runs = _state["runs"]
    raws = [runs.plain(t) if runs else None for t in texts]
    out: list[bytes] = [b""] * len(texts)
    some, size = [], 0
    for k, raw in enumerate([*raws, None]):
        if raw is not None:
            some.append(k)
            size += len(raw)
        if some and (size > AT_ONCE or k == len(texts)):
            for i, ids in zip(some, runs.encode([raws[i] for i in some]), strict=True):
                out[i] = ids
            some, size = [], 0
    for k, raw in enumerate(raws):
        if raw is None:
            words = _split(texts[k])
            out[k] = b"".join(map(_words(path, words).__getitem__, words))
    return out


def _words(path: str, words: list[bytes]) -> dict[bytes, bytes]:
    """Ids of (at least) these words as little-endian 32-bit numbers.

    Two generations of up to CACHE words are remembered; words in use move on to the younger one. Punctuation
    after a letter is a token of its own run, so a word and its closing marks are looked up apart.
    """
    if _state.get("path") != path:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _state.update(path=path, tokenizer=Tokenizer.from_file(path), young={}, old={})
    if len(_state["young"]) > CACHE:
        _state["old"], _state["young"] = _state["young"], {}
    young, old = _state["young"], _state["old"]
    new: set[bytes] = set()
    later: list[tuple[bytes, bytes, bytes]] = []
    for w in set(words).difference(young):
        if w in old:
            young[w] = old[w]
            continue
        core = w.rstrip(MARKS)
        if core and core != w and core[-1:].isalpha():
            later.append((w, core, w[len(core) :]))
            for part in later[-1][1:]:
                if part in old:
                    young[part] = old[part]
                elif part not in young:
                    new.add(part)
        else:
            new.add(w)
    if new:
        ask = list(new)
        for w, e in zip(ask, _state["tokenizer"].encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in ask], add_special_tokens=False), strict=True):
            young[w] = np.array(e.ids, dtype="<u4").tobytes()
    for w, core, marks in later:
        young[w] = young[core] + young[marks]
    return young


def _code(ids: bytes) -> bytes:
    """Ids for storage: their width, then the compressed numbers, of 16 bits where all fit."""
    wide = np.frombuffer(ids, dtype="<u4")
    narrow = not len(wide) or wide.max() < 1 << 16
    return (b"\x02" if narrow else b"\x04") + pa.compress(wide.astype("<u2").tobytes() if narrow else ids, codec="zstd", asbytes=True)


def _decode(coded: bytes, length: int) -> bytes:
    """The ``length`` ids of :func:`_code`, as little-endian 32-bit numbers."""
    raw = pa.decompress(coded[1:], decompressed_size=coded[0] * length, codec="zstd", asbytes=True)
    return raw if coded[0] == 4 else np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes()


def pieces(
    docs: DataFrame, tokenizer: str, tokens: int = TOKENS, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
    keep: dict[str, Column] | None = None, coded: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, if asked for the ids (little-endian 32-bit numbers), and
    the columns ``keep`` (name: column) of its document. With ``coded``, ids are kept as the smaller column ``coded``,
    which :func:`sequences` and :func:`decoded` understand.

    The tokenizer file must treat white space as a border that leaves no trace (its ids of a text are those of
    the words one after the other; case of ASCII letters must not matter to it either). Files of lower-cased words are encoded
    by :class:`Runs`; words of other files and texts are encoded once per worker. A null text is empty: its only id
    is the end mark. Null ids and repeated rows are passed on.
    """
    keep = keep or {}
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *[v.alias(k) for k, v in keep.items()])
    kind = rows.schema["id"].dataType.simpleString()
    carried = list(keep)
    kept_ids = "coded" if coded else "ids" if keep_ids else ""
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                take: list[int] = []
                rest: tuple[list, list, list, list, list] = ([], [], [], [], [])
                for i, ids in enumerate(_encoded(tokenizer, b.column("text").to_pylist())):
                    ids += end
                    for n, start in enumerate(range(0, len(ids), 4 * tokens)):
                        part = ids[start : start + 4 * tokens]
                        take.append(i)
                        for column, v in zip(rest, (n, start // 4, len(part) // 4, zlib.crc32(part), _code(part) if coded else part if keep_ids else None), strict=True):
                            column.append(v)
                arrays = [b.column("id").take(pa.array(take, pa.int64())), pa.array(rest[0], pa.int32()), *[pa.array(x, pa.int64()) for x in rest[1:4]]]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if kept_ids:
                    arrays.append(pa.array(rest[4], pa.binary()))
                    names.append(kept_ids)
                for k in carried:
                    arrays.append(b.column(k).take(pa.array(take, pa.int64())))
                    names.append(k)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    kept = "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, schema + (f", {kept_ids} binary" if kept_ids else "") + kept)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> np.ndarray:
    """Bin number of each piece. Equal lengths are taken in the order given; of equal bins the first is chosen."""
    limit = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.float64)
    weight = np.array(capacity.weights)
    out = np.empty(len(lengths), dtype=np.int64)
    left = np.empty((len(lengths), 3))
    used = 0
    shortest = lengths.min() if len(lengths) else 0
    open_bins = np.empty(0, dtype=np.int64)
    for at in np.argsort(-lengths, kind="stable"):
        n = float(lengths[at])
        demand = np.array([n, 1.0, n * n])
        room = left[open_bins]
        fits = (room >= demand).all(axis=1)
        if fits.any():
            if capacity.rule == "dot":
                score = -(room / limit * (demand / limit) * weight).sum(axis=1)
            else:
                score = (((room - demand) / limit) ** 2 * weight).sum(axis=1)
            which = open_bins[np.argmin(np.where(fits, score, np.inf))]
        else:
            which, left[used] = used, limit
            open_bins = np.append(open_bins, used)
            used += 1
        left[which] -= demand
        if left[which, 0] < shortest or left[which, 1] < 1:
            open_bins = open_bins[open_bins != which]
        out[at] = which
    return out


def _grouped(rows: DataFrame, capacity: Capacity, spread: int) -> DataFrame:
    """``rows`` with bin, offset and fill, packed in groups of about GROUP pieces (fewer where there are fewer).

    Rows with an ``_at`` are grouped by windows of it, a bin is named by its first ``_at`` and laid out in that order.
    """
    n = rows.count()
    groups = max(1, round(n / GROUP))
    ordered = "_at" in rows.columns
    if ordered:
        rows = ordering.global_position(rows, ["_at"], "_group").withColumn("_group", F.expr(f"(_group - 1) * {groups} div {max(1, n)}"))
    else:
        rows = rows.withColumn("_group", F.pmod(F.xxhash64(F.lit(spread), "id", "piece", "ids_crc32"), F.lit(groups)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "ids_crc32", "id", "piece"], ascending=False, kind="stable", na_position="last").reset_index(drop=True)
        which = best_fit(part["length"].to_numpy(), capacity)
        part["bin"] = which * np.int64(groups) + np.int64(key[0])
        if ordered:
            part["bin"] = part.groupby("bin")["_at"].transform("min")
            part = part.sort_values(["bin", "_at"], kind="stable")
        else:
            part = part.iloc[np.argsort(which, kind="stable")]
        lengths = part.groupby("bin")["length"]
        part["offset"] = lengths.cumsum() - part["length"]
        part["fill"] = lengths.transform("sum")
        return part.drop(columns="_group")

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_group"]
    return rows.groupBy("_group").applyInPandas(run, ", ".join([*fields, "bin long", "offset long", "fill long"]))


def pack(parts: DataFrame, capacity: Capacity = Capacity(), full: float = 0.995, rounds: int = ROUNDS, order: list[str] | None = None) -> DataFrame:
    """``parts`` (id, piece, start, length, ids_crc32) with sequence_id and offset, and with their other columns, such as ids.

    Other columns aren't moved while packing; they are joined to the placed pieces by a number given to each piece before.
    Sequences hold at most ``capacity``; offsets are gapless from 0. A piece that alone exceeds the document or
    attention limit can't be packed: it raises. Equal pieces may swap places. An empty table gives no rows.

    With ``order`` (columns that put the documents in order), pieces are packed with those near them: in windows of
    GROUP consecutive pieces, what is left of these in windows of GROUP consecutive left ones. ``sequence_id`` then
    is the place of a sequence's first piece among all pieces, and pieces keep their order inside a sequence.
    """
    least = int(full * capacity.tokens)
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    extra = [k for k in parts.columns if k not in columns and k not in (order or [])]
    everything = rows = c.save(parts.withColumn("_key", F.monotonically_increasing_id()), "pieces")
    columns = [*columns, "_key"]
    worst = rows.agg(F.max("length")).first()[0] or 0
    if worst > capacity.tokens or worst * worst > capacity.attention or capacity.documents < 1:
        raise ValueError(f"a piece of {worst} tokens exceeds the capacity of a sequence")
    if order:
        rows = ordering.global_position(rows.select(*columns, *order), [*order, "piece"], "_at").select(*columns, (F.col("_at") - 1).alias("_at"))
        rows = c.save(rows, "ordered")
        columns = [*columns, "_at"]
    # Whole sequences need no packing.
    rest = rows.where(F.col("length") < capacity.tokens)
    bins = []
    for k in range(1, rounds + 1):
        packed = c.save(_grouped(rest.select(*columns), capacity, k), "packed")
        final = packed if k == rounds else packed.where(F.col("fill") >= least)
        name = F.col("bin") if order else F.col("bin") * 8 + k
        bins.append(final.select("_key", *columns[:5], name.alias("sequence_id"), "offset"))
        rest = packed.where(F.col("fill") < least)
    done = functools.reduce(DataFrame.unionByName, bins)
    whole = [(F.col("_at") if order else F.col("_key") * 8).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    if order or not extra:
        done = done.unionByName(rows.where(F.col("length") == capacity.tokens).select("_key", *columns[:5], *whole))
    if extra:
        # Placed pieces are narrow: they are hashed, so that the wide side isn't sorted. Without an order, whole sequences stay where they are.
        wide = everything if order else everything.where(F.col("length") < capacity.tokens)
        done = wide.select("_key", *extra).join(done.hint("shuffle_hash"), "_key").select(*done.columns, *extra)
        if not order:
            done = done.unionByName(everything.where(F.col("length") == capacity.tokens).select(*done.columns[:6], *whole, *extra))
    return done.drop("_key")


def decoded(packed: DataFrame) -> DataFrame:
    """``packed`` with the column ids (little-endian 32-bit numbers) in the place of ``coded``."""
    names = ["ids" if k == "coded" else k for k in packed.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = [_decode(v, n) for v, n in zip(b.column("coded").to_pylist(), b.column("length").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()) if k == "ids" else b.column(k) for k in names], names=names)

    return packed.mapInArrow(run, ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, packed.schema.fields, strict=True)))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of ``packed`` (:func:`pack` of pieces with ids): sequence_id, length, ids, pieces.

    ``ids`` are all ids of the sequence, as little-endian 32-bit numbers (``numpy.frombuffer(ids, "<u4")``); ``pieces``
    are its pieces in order (offset, length, id, piece, start), whose borders bound attention and give positions.
    """
    if "coded" in packed.columns:
        return _joined(packed)
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "id", "piece", "start", "ids"))).alias("_p"))
    # Hexadecimal text, as joining binaries one by one would copy the front of a sequence for every piece.
    return rows.select(
        "sequence_id", F.expr("aggregate(_p, 0L, (a, x) -> a + x.length)").alias("length"),
        F.expr("unhex(array_join(transform(_p, x -> hex(x.ids)), ''))").alias("ids"),
        F.expr("transform(_p, x -> struct(x.offset, x.length, x.id, x.piece, x.start))").alias("pieces"),
    )


def _joined(packed: DataFrame) -> DataFrame:
    """:func:`sequences` of pieces whose ids are ``coded``: they travel so, and are decoded where the sequence is put together."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "id", "piece", "start", "coded"))).alias("_p"))
    kept = ["offset", "length", "id", "piece", "start"]
    listed = ", ".join(f"{k}: {packed.schema[k].dataType.simpleString()}" for k in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lists = b.column("_p")
                parts, counts = lists.flatten(), lists.value_lengths().to_numpy()
                lengths = parts.field("length").to_numpy()
                ids = list(map(_decode, parts.field("coded").to_pylist(), lengths.tolist()))
                ends = np.cumsum(counts).tolist()
                borders = [0, *ends]
                data = [b"".join(ids[a:z]) for a, z in itertools.pairwise(borders)]
                pieces = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.StructArray.from_arrays([parts.field(k) for k in kept], names=kept))
                sizes = pa.array([len(x) // 4 for x in data], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("sequence_id"), sizes, pa.array(data, pa.binary()), pieces], names=["sequence_id", "length", "ids", "pieces"])

    return rows.mapInArrow(run, f"sequence_id long, length long, ids binary, pieces array<struct<{listed}>>")


def write_sequences(packed: DataFrame, path: str) -> None:
    """Write :func:`sequences` of ``packed`` as Parquet, in the order of sequence_id across and inside the files."""
    sequences(packed).repartitionByRange("sequence_id").sortWithinPartitions("sequence_id").write.parquet(path)


def digests(whole: DataFrame) -> DataFrame:
    """One row per piece of :func:`sequences`, as :func:`pack` gives it: the checksum is that of the ids at its place."""
    piece = "struct(x.id, x.piece, x.start, x.length, crc32(substring(ids, int(4 * x.offset + 1), int(4 * x.length))) AS ids_crc32, sequence_id, x.offset)"
    return whole.select(F.expr(f"inline(transform(pieces, x -> {piece}))"))
