"""Windows, boxes and slice grids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-6


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, lit(high)), lit(low))


def unit(seed: int, key: Column, part: str) -> Column:
    """A number in 0..1 that hangs on seed, key and part alone: 48 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(part)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def window_starts(duration: Column, window: float, hop: float) -> Column:
    """Starts 0, hop, .. that leave a whole window within the duration, and a last one that ends with the recording
    unless one of them is as good as there. Starts are i * hop, so they don't drift. Empty if shorter than a window."""
    last = duration - window
    n = F.floor((last + EPS) / hop)
    grid = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0)).cast("int")), lambda i: i * F.lit(float(hop)))
    top = F.greatest(n, F.lit(0)) * F.lit(float(hop))
    near = F.abs(top - last) <= F.greatest(F.lit(EPS), EPS * F.greatest(F.abs(top), F.abs(last)))
    tail = F.when((last > 0) & ~near, F.array(last)).otherwise(F.array().cast("array<double>"))
    return F.when(last + EPS >= 0, F.concat(grid, tail)).otherwise(F.array().cast("array<double>"))


def start_bounds(left: Column, right: Column, window: Column, duration: Column) -> tuple[Column, Column]:
    """Least and largest start of a window that holds left..right and stays in the recording."""
    return F.greatest(F.lit(0.0), right - window), F.least(left, duration - window)


def window_start_for(left: Column, right: Column, window, duration: Column, shift) -> Column:
    """The start of a window centred on an annotation plus shift, moved as little as keeps the annotation inside and the
    window within the recording; null if that can't be."""
    window = lit(window)
    low, high = start_bounds(left, right, window, duration)
    start = clamp((left + right) / 2 + shift - window / 2, low, high)
    return F.when(low <= high, clamp(start, 0.0, duration - window))


def center_bounds(left: Column, right: Column, window, duration: Column) -> Column:
    """struct(low, high) of the possible window centres; null if there is none."""
    window = lit(window)
    low, high = start_bounds(left, right, window, duration)
    return F.when(low <= high, F.struct((low + window / 2).alias("low"), (high + window / 2).alias("high")))


def shift_offsets(left: Column, right: Column, bounds: Column, step: float, least: float, most: float | None, n: int, key: Column, seed: int = 0) -> Column:
    """n offsets of the window centre, drawn in turn from a pool to the left and one to the right.

    The pools are a grid of centres in ``step`` over ``bounds`` (both ends included), within ``most`` of the annotation's
    centre and at least ``least`` from it where that leaves any. A pick is a keyed hash, so it depends on nothing else.
    """
    center = (left + right) / 2
    low, high = bounds["low"], bounds["high"]
    if most is not None:
        low, high = F.greatest(low, center - most), F.least(high, center + most)
    count = F.floor((high - low) / step + EPS).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: low + i * F.lit(float(step)))
    grid = F.concat(F.filter(grid, lambda g: g < high - EPS), F.array(high))
    offsets = F.transform(grid, lambda g: g - center)

    def pool(sign: int) -> Column:
        side = F.filter(offsets, lambda o: o * sign > EPS)
        far = F.filter(side, lambda o: F.abs(o) >= least - EPS)
        return F.when(F.size(far) > 0, far).otherwise(side)

    def pick(own: Column, i: int) -> Column:
        return F.get(own, F.floor(unit(seed, key, f"shift{i}") * F.size(own)).cast("int"))

    negative, positive = pool(-1), pool(1)
    out = []
    for i in range(n):
        first, second = (negative, positive) if i % 2 == 0 else (positive, negative)
        out.append(F.when(F.size(first) > 0, pick(first, i)).when(F.size(second) > 0, pick(second, i)))
    picked = F.filter(F.array(*out), lambda o: o.isNotNull()) if out else F.array().cast("array<double>")
    return F.when(high - low > EPS, picked).otherwise(F.array().cast("array<double>"))


def to_box(left: Column, right: Column, bottom: Column, top: Column, start: Column, window, freq_max) -> Column:
    """A box in 0..1 with its origin at the top left, as window seconds run right and hertz run up."""
    window, freq_max = lit(window), lit(freq_max)
    low, high = F.least(bottom, top), F.greatest(bottom, top)
    width, height = F.greatest(right - left, F.lit(0.0)), high - low
    return F.struct(
        F.lit(0).alias("class_id"),
        clamp((left - start + width / 2) / window, 0.0, 1.0).alias("x_center"),
        clamp(1 - (low + height / 2) / freq_max, 0.0, 1.0).alias("y_center"),
        clamp(width / window, 0.0, 1.0).alias("width"),
        clamp(height / freq_max, 0.0, 1.0).alias("height"),
    )


def box_to_physical(box: Column, start: Column, window, freq_max) -> Column:
    """struct(start_time, end_time, duration, low_freq, high_freq) of a box, clipped to its window and to 0..freq_max."""
    window, freq_max = lit(window), lit(freq_max)
    center, half = start + box["x_center"] * window, box["width"] * window / 2
    begin, end = F.greatest(start, center - half), F.least(start + window, center + half)
    middle, reach = (1 - box["y_center"]) * freq_max, box["height"] * freq_max / 2
    return F.struct(
        begin.alias("start_time"),
        end.alias("end_time"),
        F.greatest(F.lit(0.0), end - begin).alias("duration"),
        F.greatest(F.lit(0.0), middle - reach).alias("low_freq"),
        F.least(freq_max, middle + reach).alias("high_freq"),
    )


def flip_box(boxes: Column) -> Column:
    """Boxes mirrored in time."""
    return F.transform(boxes, lambda b: b.withField("x_center", 1 - b["x_center"]))


def padded_window(start: Column, end: Column, pad: float, duration: Column | None = None) -> Column:
    """struct(start, length) with pad on both sides: within the recording if its duration is given, else at least 1 ms."""
    begin = F.greatest(start - pad, F.lit(0.0))
    if duration is None:
        return F.struct(begin.alias("start"), F.greatest(end + pad - begin, F.lit(1e-3)).alias("length"))
    return F.struct(begin.alias("start"), (F.least(end + pad, duration) - begin).alias("length"))


def local_box(start: Column, end: Column, low: Column, high: Column, window: Column, freq_max) -> Column:
    """A detection's box within its padded window."""
    freq_max = lit(freq_max)
    a, b = F.greatest(start - window["start"], F.lit(0.0)), F.least(end - window["start"], window["length"])
    f, g = clamp(low, 0.0, freq_max), clamp(high, 0.0, freq_max)
    bottom, top = F.least(f, g), F.greatest(f, g)
    return F.struct(
        F.lit(0).alias("class_id"),
        clamp((a + b) / 2 / window["length"], 0.0, 1.0).alias("x_center"),
        clamp(1 - (bottom + top) / 2 / freq_max, 0.0, 1.0).alias("y_center"),
        F.least(F.greatest(b - a, F.lit(EPS)) / window["length"], F.lit(1.0)).alias("width"),
        F.least(F.greatest(top - bottom, F.lit(EPS)) / freq_max, F.lit(1.0)).alias("height"),
    )


def slice_grid(start: Column, end: Column, pad: float, width: float) -> Column:
    """Starts of the slices that cover start - pad .. end + pad."""
    n = F.ceil((end - start + 2 * pad) / width - 1e-9).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: start - pad + i * F.lit(float(width)))).otherwise(F.array().cast("array<double>"))


def to_db(power: Column, add: bool = True) -> Column:
    return 10 * F.log10(power + 1e-12 if add else F.greatest(power, F.lit(1e-12)))


def rms(samples: Column) -> Column:
    """Root mean square of an array; null if empty."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples)))
