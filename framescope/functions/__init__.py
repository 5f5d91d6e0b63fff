from framescope.functions import scalars, windows

__all__ = ["scalars", "windows"]
