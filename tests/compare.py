"""Comparing frames."""

from __future__ import annotations


def same_rows(got, expected) -> None:
    """Frames hold the same rows, whatever their order."""
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)

    def plain(value):
        if value is None or value != value:
            return "null"
        return repr(round(float(value), 9) + 0.0) if isinstance(value, float) else str(value)

    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(expected)
