"""Synthetic geometry with known answers.

Sheets are tubes around an axis or planes across z, brightness falls off in a
straight line from a sheet's middle, and everything lies off centre.
"""

from __future__ import annotations

import numpy as np

#: Voxels in z, y, x; the chunks divide none of them evenly but z.
SHAPE = (64, 250, 290)
CHUNK = (16, 60, 110)
#: y and x of the axis, the tubes' spacing, and the largest radius with data.
MIDDLE, GAP, EDGE = (120.0, 140.0), 18.0, 117.0


def tubes() -> np.ndarray:
    """Tubes each ``GAP`` voxels around the axis, nothing beyond ``EDGE``."""
    y, x = np.indices(SHAPE[1:])
    radius = np.sqrt((y - MIDDLE[0]) ** 2 + (x - MIDDLE[1]) ** 2)
    off = np.abs((radius + GAP / 2) % GAP - GAP / 2)
    bright = np.where(radius < EDGE, 35 + 170 * np.clip(1 - off / 4, 0, None), 0).astype(np.uint8)
    return np.tile(bright, (SHAPE[0], 1, 1))


def tube_mesh(spark, radii: list[float], first: int = 3, step: float = 5.0):
    """A winding at each radius, rows up the axis, columns once around."""
    rows = []
    for winding, radius in enumerate(radii, first):
        around = round(2 * np.pi * radius / step) + 1
        turn = 2 * np.pi / (around - 1)
        up = [4 + step * k for k in range(int((SHAPE[0] - 8) // step) + 1)]
        rows += [(winding, r, c, MIDDLE[1] + float(radius * np.cos(turn * c)), MIDDLE[0] + float(radius * np.sin(turn * c)), z, True) for r, z in enumerate(up) for c in range(around)]
    return spark.createDataFrame(rows, "winding int, r int, c int, x double, y double, z double, valid boolean")


def axis(spark):
    return spark.createDataFrame([(-5.0, *MIDDLE), (SHAPE[0] + 5.0, *MIDDLE)], "z double, y double, x double")


def layers(shape: tuple[int, int, int], gap: float, last: int | None = None) -> np.ndarray:
    """Planes across z each ``gap`` voxels, up to ``last``, above which the
    volume is evenly dim."""
    z = np.arange(shape[0])
    wave = 128 + 90 * np.cos(2 * np.pi * z / gap)
    if last is not None:
        wave[z > last] = 38
    return np.broadcast_to(wave.astype(np.uint8)[:, None, None], shape).copy()


def sheet(spark, z: float, winding: int = 1, rows: int = 22, columns: int = 26, step: float = 3.0, start: float = 15.0, tilt: float = 0.0, holes: tuple = ((0, 1),)):
    """A flat winding at height ``z``, which rises by ``tilt`` a row."""
    out = [(winding, r, c, start + step * c, start + step * r, z + tilt * r, (r, c) not in holes) for r in range(rows) for c in range(columns)]
    return spark.createDataFrame(out, "winding int, r int, c int, x double, y double, z double, valid boolean")
