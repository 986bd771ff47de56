"""Scalar pitch arithmetic. Everything here is a native Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Twelve-tone note names, C first.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]

OCTAVE = 1200.0


def _pow2(k: Column) -> Column:
    return F.pow(F.lit(2.0), k)


def sounding(hz: Column) -> Column:
    """True for a voiced pitch. Spark holds NaN to be greater than 0."""
    return (hz > 0) & ~F.isnan(hz)


def cents_above(hz: Column, tonic: Column) -> Column:
    """Cents from ``tonic`` up to ``hz``; null for a silent frame."""
    return F.lit(OCTAVE) * F.log2(hz / tonic)


def cents_or_zero(hz: Column, tonic: Column) -> Column:
    """Like :func:`cents_above`, but a silent frame counts as 0."""
    return F.when(sounding(hz), cents_above(hz, tonic)).otherwise(F.lit(0.0))


def octave_reduce(cents: Column) -> Column:
    """``cents`` modulo 1200 with the sign of the divisor.

    A tiny negative value rounds up to 1200.0 itself, which the closed right
    edge of the last bin then takes (``pmod`` would send it to bin 0).
    """
    r = cents % OCTAVE
    return r + F.when(cents < 0, F.when(r < 0, OCTAVE).otherwise(0.0)).otherwise(0.0)


def edge_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Index of the half-open bin ``[edge(i), edge(i+1))`` holding ``x``.

    The last bin is closed on the right. The arithmetic guess is moved by one
    where the edges themselves, in doubles, say so. Null outside ``[lo, hi]``.
    """
    step = (hi - lo) / bins
    guess = F.least(F.floor((x - lo) / step), F.lit(bins - 1))
    down = F.when(x < guess * step + lo, 1).otherwise(0)
    up = F.when((x >= (guess + 1) * step + lo) & (guess < bins - 1), 1).otherwise(0)
    return F.when((x >= lo) & (x <= hi), (guess - down + up).cast("int"))


def pitch_class_bin(cents: Column, bins: int = 120) -> Column:
    """Bin of the octave-reduced cents; the last bin is closed on the right."""
    width = OCTAVE / bins
    x = octave_reduce(cents)
    guess = F.floor(x / width).cast("int")
    return F.least(guess - (x < guess * width).cast("int"), F.lit(bins - 1))


def fold_into(hz: Column, lo: float = 60.0, hi: float = 120.0) -> Column:
    """Move a frequency by whole octaves into ``[lo, hi]`` (``hi == 2 * lo``)."""
    down = hz / _pow2(F.ceil(F.log2(hz / hi)))
    up = hz * _pow2(F.ceil(F.log2(lo / hz)))
    y = F.when(hz > hi, down).when(hz < lo, up).otherwise(hz)
    # log2 may be an ulp off next to a power of two: one octave at most.
    return F.when(y > hi, y / 2).when(y < lo, y * 2).otherwise(y)


def lift_towards(hz: Column, target: Column) -> Column:
    """Double ``hz`` while twice its value is still below ``target``."""
    y = hz * _pow2(F.greatest(F.lit(0), F.ceil(F.log2(target / hz)) - 1))
    return (
        F.when(y * 2 < target, y * 2)
        .when((y >= target) & (y > hz), y / 2)
        .otherwise(y)
    )


def fold_override(hz: Column, median_hz: Column) -> Column:
    """Move a given tonic by octaves into ``[0.75, 1.5)`` times the median."""
    top = median_hz * 1.5
    y = hz * _pow2(F.ceil(F.log2(top / hz)) - 1)
    return F.when(y >= top, y / 2).when(y * 2 < top, y * 2).otherwise(y)


def note_name(hz: Column) -> Column:
    """Nearest note with octave, and the cents offset when it is 3 or more."""
    midi = F.lit(69.0) + F.lit(12.0) * F.log2(hz / 440.0)
    nearest = F.bround(midi, 0).cast("int")
    offset = F.bround((midi - nearest) * 100, 0).cast("int")
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    name = F.element_at(names, F.pmod(nearest, F.lit(12)) + 1)
    octave = F.floor(nearest / 12).cast("int") - 1
    plain = F.format_string("%s%d", name, octave)
    tuned = F.format_string("%s%d (%+d¢)", name, octave, offset)
    named = F.when(F.abs(offset) >= 3, tuned).otherwise(plain)
    return F.when(sounding(hz), named).otherwise(F.lit(""))


def midi_to_hz(midi: Column) -> Column:
    return F.lit(440.0) * _pow2((midi - 69) / 12.0)


def chromatic_label(midi: Column) -> Column:
    """Label of a tonic choice, for example ``C2  ·  65.4 Hz``."""
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    return F.format_string(
        "%s%d  ·  %.1f Hz",
        F.element_at(names, F.pmod(midi, F.lit(12)).cast("int") + 1),
        F.floor(midi / 12).cast("int") - 1,
        midi_to_hz(midi),
    )


def cents_between(detected: Column, expected: Column) -> Column:
    """Signed difference in cents, positive when ``detected`` is sharp."""
    return F.lit(OCTAVE) * F.log2(detected / expected)


def nearest_pitch_class_diff(cents: Column) -> Column:
    """Wrap a cents difference into ``[-600, 600)``."""
    return octave_reduce(cents + 600.0) - 600.0


def error_band(cents: Column) -> Column:
    """``good`` up to 25 cents, ``ok`` up to 50, ``broken`` beyond."""
    size = F.abs(cents)
    return F.when(size <= 25, "good").when(size <= 50, "ok").when(size > 50, "broken")


def positive_or_null(x: Column) -> Column:
    return F.when(sounding(x), x)
