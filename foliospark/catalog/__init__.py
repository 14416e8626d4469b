"""All registered queries; importing the package fills the registry."""

from foliospark.catalog.registry import ORACLES, QUERIES  # noqa: F401
from foliospark.catalog import books, detections, events, images, lines, pages, pixels, toc  # noqa: F401,E402
