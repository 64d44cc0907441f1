"""Integer encodings used inside terrain tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._cols import col

# fixed values: bits of the child byte
CHILD_BITS = {"SW": 1, "SE": 2, "NW": 4, "NE": 8}
# fixed values: height h is stored as (h + 1000) * 5
HEIGHT_OFFSET = 1000.0
HEIGHT_SCALE = 5.0
# fixed value: largest quantized coordinate
QUANTIZED_MAX = 32767


def zigzag(n) -> Column:
    """Fold the sign into the lowest bit: 0, -1, 1, -2 become 0, 1, 2, 3."""
    v = col(n).cast("bigint")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(n) -> Column:
    v = col(n).cast("bigint")
    return F.shiftright(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("bigint")))


def encode_height(h) -> Column:
    return ((col(h) + HEIGHT_OFFSET) * HEIGHT_SCALE).cast("int")


def decode_height(v) -> Column:
    return col(v) / HEIGHT_SCALE - HEIGHT_OFFSET


def has_child(flags, quadrant: str) -> Column:
    return col(flags).bitwiseAND(F.lit(CHILD_BITS[quadrant]).cast("bigint")) != 0


def quantize(value, low, high, mode: str = "round") -> Column:
    """Position inside ``low..high`` as 0..32767; a flat range counts as one unit wide."""
    span = F.when(col(high) == col(low), 1.0).otherwise(col(high) - col(low))
    scaled = (col(value) - col(low)) / span * float(QUANTIZED_MAX)
    return (scaled if mode == "trunc" else F.floor(scaled + 0.5)).cast("bigint")


def oct_encode(nx, ny, nz) -> tuple[Column, Column]:
    """Two bytes (0..255) of a unit normal on the folded octahedron."""
    nx, ny, nz = col(nx), col(ny), col(nz)
    size = F.abs(nx) + F.abs(ny) + F.abs(nz)
    px, py = nx / size, ny / size

    def sign(v):
        return F.when(v < 0, -1.0).otherwise(1.0)

    fx = F.when(nz < 0, (F.lit(1.0) - F.abs(py)) * sign(px)).otherwise(px)
    fy = F.when(nz < 0, (F.lit(1.0) - F.abs(px)) * sign(py)).otherwise(py)

    def byte(v):
        inside = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
        return F.floor((inside * 0.5 + 0.5) * 255.0 + 0.5)

    return byte(fx), byte(fy)
