"""Finds duplicated and near-duplicated passages in code and text, on Spark."""

__version__ = "0.1.0"


def version() -> str:
    return __version__


def __getattr__(name: str):
    if name in ("Clone", "CloneGroup", "CloneType", "DetectionConfig", "DetectionMode", "detect_clones"):
        from dupscan import api

        return getattr(api, name)
    raise AttributeError(name)


__all__ = ["Clone", "CloneGroup", "CloneType", "DetectionConfig", "DetectionMode", "__version__", "detect_clones", "version"]
