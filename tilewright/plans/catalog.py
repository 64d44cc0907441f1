"""All registered queries; importing the modules registers them."""

from __future__ import annotations

from .registry import ENTRIES  # noqa: F401
from . import grid_queries  # noqa: F401
from . import scalar_queries  # noqa: F401
from . import tileset_queries  # noqa: F401
from . import footprint_queries  # noqa: F401
from . import task_queries  # noqa: F401
from . import raster_queries  # noqa: F401
from . import mesh_queries  # noqa: F401
from . import codec_queries  # noqa: F401
from . import refine_queries  # noqa: F401
from . import stream_queries  # noqa: F401
