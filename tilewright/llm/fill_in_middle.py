"""Fill-in-the-middle transformation by repeated-capture matching.

A text is a run of units: white space with the word after it, or white space at the end. One ``fullmatch`` of
``(unit)*`` keeps every repetition of its group, so ``match.ends(1)`` holds where each unit ends: its length is the
number of units, and two of its entries are the cuts. A repetition costs the library some 200 bytes, therefore a text
is matched in windows of about WINDOW code points that end where a unit ends; nearly all texts are one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

# fixed values: a unit, and the marks in front of the three parts
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

WINDOW = 1 << 20  # code points matched at once
BATCH = 1 << 22  # code points returned at once
UNITS = regex.compile(f"({UNIT})*+")
BORDER = regex.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


def unit_ends(text: str, window: int = WINDOW) -> list[int]:
    """Where each unit of ``text`` ends, in code points."""
    if len(text) <= window:
        return UNITS.fullmatch(text).ends(1)
    out, at = [], 0
    while at < len(text):
        border = BORDER.search(text, at + window) if at + window < len(text) else None
        to = border.start() if border else len(text)
        out += UNITS.fullmatch(text, at, to).ends(1)
        at = to
    return out


def _arranged(text: str, ends: list[int], h: list[int], rate: int, spm: int) -> tuple[str, int | None, int | None, str]:
    """Form, code points of prefix and middle, and output of a text."""
    if not text or h[2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return "plain", None, None, text
    cuts = sorted(x % (len(ends) + 1) for x in h[:2])
    a, b = (ends[k - 1] if k else 0 for k in cuts)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n (units), form, prefix_chars, middle_chars, output.

    Of the texts, ``rate`` in a hundred are cut at two unit borders, ``spm`` in a hundred of these with the suffix in
    front; cuts and form follow a hash of (seed, id) alone. The others are ``plain``: output is the text, prefix and
    middle have no length. A text that contains one of the marks is always plain, so every output can be undone
    (:func:`restored`). A null text is empty, hence plain with 0 units; a null id is hashed like an empty one. Repeated
    rows are all returned and cut alike. Texts of any length are cut whole; cuts may be equal, parts empty. An empty
    table gives no rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashes = F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])
    rows = docs.select(F.col(id_col).alias("id"), c.text_of(text_col).alias("text"), hashes.alias("h"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, h = b.column("id"), b.column("text"), b.column("h")
            at, out, size = 0, [], 0
            for k in range(b.num_rows):
                text = texts[k].as_py()
                ends = unit_ends(text)
                out.append((len(ends), *_arranged(text, ends, h[k].as_py(), rate, spm)))
                size += len(text)
                if size >= BATCH or k + 1 == b.num_rows:
                    columns = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, k + 1 - at), *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    at, out, size = k + 1, [], 0

    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` made ``output`` of."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
