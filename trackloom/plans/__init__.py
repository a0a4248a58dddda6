"""Named queries; each module registers its own."""

from trackloom.plans import catalog, curves, files, intervals, layouts, models, reports, space, streams

__all__ = ["catalog", "curves", "files", "intervals", "layouts", "models", "reports", "space", "streams"]
