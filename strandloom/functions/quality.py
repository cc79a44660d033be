"""Read qualities, barcodes and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import _col, positions


def error_rate(phred) -> Column:
    return F.pow(F.lit(10.0), -_col(phred) / 10)


def scores(quality) -> Column:
    """Phred scores of a quality string."""
    return F.transform(F.filter(F.split(_col(quality), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def mean_quality(quality) -> Column:
    return F.try_divide(F.aggregate(scores(quality), F.lit(0), lambda a, x: a + x), F.length(_col(quality)))


def unqualified_share(quality, phred: int) -> Column:
    """Share of bases under the quality."""
    return F.coalesce(F.try_divide(F.size(F.filter(scores(quality), lambda x: x < phred)), F.length(_col(quality))), F.lit(0.0))


def mask_low_quality(sequence, quality, phred: int) -> Column:
    """Bases under the quality become N; an empty read stays empty."""
    bases, marks = (F.filter(F.split(_col(c), ""), lambda x: x != "") for c in (sequence, quality))
    return F.array_join(F.zip_with(bases, marks, lambda b, q: F.when(F.ascii(q) - 33 < phred, "N").otherwise(b)), "")


def cut_window_tail(sequence, quality, window: int, mean: int) -> Column:
    """Bases kept when a window slides from the 5' end and the read is cut where its mean is too low."""
    q = _col(quality)
    score = lambda i: F.aggregate(
        F.sequence(i, i + (window - 1)), F.lit(0), lambda a, j: a + F.ascii(F.substring(q, j, F.lit(1))) - 33
    )
    bad = F.filter(positions(F.length(q) - (window - 1)), lambda i: score(i) < mean * window)
    return F.coalesce(F.array_min(bad) - 1, F.length(_col(sequence)))


def barcode(read, spans: list[tuple[int, int]]) -> Column:
    """The segments [start, end) of a read, joined."""
    return F.concat(*(F.substring(_col(read), a + 1, b - a) for a, b in spans))


def barcode_of_files(files, spans: list[tuple[int, int, int]]) -> Column:
    """The segments (file, start, end) of a read's files, joined; ``files`` names the column of a file."""
    return F.concat(*(barcode(files(f), [(a, b)]) for f, a, b in spans))


def counts_per_million(count, total) -> Column:
    return F.try_divide(_col(count) * 1_000_000, _col(total))


def fraction(part, rest, empty: float | None = 0.0) -> Column:
    """part / (part + rest); ``empty`` where both are 0."""
    value = F.try_divide(_col(part).cast("double"), _col(part) + _col(rest))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def sensitivity(tp, fn) -> Column:
    return F.coalesce(F.try_divide(_col(tp).cast("double"), _col(tp) + _col(fn)), F.lit(1.0))


def specificity(tn, fp) -> Column:
    return F.coalesce(F.try_divide(_col(tn).cast("double"), _col(tn) + _col(fp)), F.lit(1.0))


def precision(tp, fp) -> Column:
    return F.coalesce(F.try_divide(_col(tp).cast("double"), _col(tp) + _col(fp)), F.lit(0.0))


def f1_score(tp, fp, fn) -> Column:
    return F.coalesce(F.try_divide(2.0 * _col(tp), 2 * _col(tp) + _col(fp) + _col(fn)), F.lit(0.0))
