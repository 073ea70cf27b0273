"""Small dense matrices on the driver: layer weights and results of a checked size."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

# The messages of invalid input.
SIZE_MISMATCH = "DenseMatrix dimension mismatch with data size."
RAGGED = "DenseMatrix constructor requires all rows to have equal length."
OUT_OF_BOUNDS = "DenseMatrix::at out of bounds"


class DenseMatrix:
    """A row-major matrix; `values` is its NumPy array of doubles."""

    def __init__(self, values: np.ndarray):
        self.values = np.asarray(values, float)
        if self.values.ndim != 2:
            raise ValueError(SIZE_MISMATCH)

    @classmethod
    def blank(cls) -> DenseMatrix:
        return cls(np.zeros((0, 0)))

    @classmethod
    def full(cls, rows: int, cols: int, value: float = 0.0) -> DenseMatrix:
        return cls(np.full((rows, cols), value))

    @classmethod
    def from_flat(cls, rows: int, cols: int, data: Sequence[float]) -> DenseMatrix:
        if len(data) != rows * cols:
            raise ValueError(SIZE_MISMATCH)
        return cls(np.array(data, float).reshape(rows, cols))

    @classmethod
    def from_rows(cls, grid: Iterable[Sequence[float]]) -> DenseMatrix:
        rows = [list(r) for r in grid]
        if len({len(r) for r in rows}) > 1:
            raise ValueError(RAGGED)
        return cls(np.array(rows, float).reshape(len(rows), len(rows[0]) if rows else 0))

    @property
    def rows(self) -> int:
        return self.values.shape[0]

    @property
    def cols(self) -> int:
        return self.values.shape[1]

    @property
    def empty(self) -> bool:
        return self.values.size == 0

    @property
    def data(self) -> list[float]:
        return self.values.ravel().tolist()

    def __getitem__(self, where: int | tuple[int, int]):
        got = self.values[where]
        return got.tolist() if got.ndim else float(got)

    def row(self, r: int) -> list[float]:
        return self.values[r].tolist()

    def at(self, r: int, c: int) -> float:
        if not (0 <= r < self.rows and 0 <= c < self.cols):
            raise IndexError(OUT_OF_BOUNDS)
        return float(self.values[r, c])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, DenseMatrix) and np.array_equal(self.values, other.values)

    __hash__ = None

    def __repr__(self) -> str:
        return f"DenseMatrix({self.rows}x{self.cols})"


def as_matrix(x) -> DenseMatrix:
    return x if isinstance(x, DenseMatrix) else DenseMatrix.from_rows(x)
