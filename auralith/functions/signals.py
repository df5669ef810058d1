"""Time-domain measures of a signal held as array<double>, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from auralith.functions.exprs import SILENCE_DBFS, dbfs, percentile, ratio

# fixed values: names of the pitch classes, key profiles by pitch class
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
WINDOW = 1024


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def rms(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sqrt(squares(a) / F.size(a))).otherwise(F.lit(0.0))


def peak(a: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(a, F.abs)), F.lit(0.0))


def mono(data: Column, channels: Column) -> Column:
    """The mean of each frame's channels."""
    frames = F.sequence(F.lit(1), F.greatest((F.size(data) / channels).cast("int"), F.lit(1)))
    return F.when(F.size(data) == 0, data).otherwise(F.transform(frames, lambda k: _sum(F.slice(data, (k - 1) * channels + 1, channels)) / channels))


def windows(a: Column, size: int = WINDOW) -> Column:
    """Consecutive windows; the last may be shorter. None for an empty signal."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(size))
    return F.when(F.size(a) == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(starts, lambda s: F.slice(a, s, F.lit(size))))


def rms_envelope(a: Column, size: int = WINDOW) -> Column:
    return F.transform(windows(a, size), rms)


def loudness(a: Column) -> dict[str, Column]:
    p, r = peak(a), rms(a)
    return {"peak": p, "peak_dbfs": dbfs(p), "rms": r, "rms_dbfs": dbfs(r), "crest_factor": F.when(r > 0, p / r).otherwise(F.lit(0.0)), "integrated_lufs": dbfs(r), "mean_abs": ratio(_sum(F.transform(a, F.abs)), F.size(a))}


def _share(a: Column, test) -> Column:
    return ratio(F.size(F.filter(a, test)).cast("double"), F.size(a))


def first_positive(sorted_values: Column) -> Column:
    return F.coalesce(F.get(F.filter(sorted_values, lambda x: x > 0), F.lit(0)), F.lit(0.0))


def _level(sorted_values: Column, p: float) -> Column:
    v = percentile(sorted_values, p)
    return F.when(v > 0, v).otherwise(first_positive(sorted_values))


def quality(a: Column, window: int = WINDOW) -> dict[str, Column]:
    levels = F.array_sort(rms_envelope(a, window))
    noise, signal = _level(levels, 0.1), _level(levels, 0.9)
    return {
        "clipping_ratio": _share(a, lambda x: F.abs(x) >= 0.999),
        "dc_offset": ratio(_sum(a), F.size(a)),
        "silence_ratio": _share(a, lambda x: F.abs(x) <= 0.001),
        "estimated_snr_db": F.when((noise > 0) & (signal > 0), 20 * F.log10(signal / noise)).otherwise(F.lit(0.0)),
    }


def zero_crossing_rate(a: Column) -> Column:
    """Sign changes by n - 1; zero counts as positive."""
    pairs = F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: (x >= 0) != (y >= 0))
    return F.when(F.size(a) < 2, F.lit(0.0)).otherwise(F.size(F.filter(pairs, lambda c: c)) / F.greatest(F.size(a) - 1, F.lit(1)))


def steps(a: Column) -> Column:
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, F.lit(2), n), lambda x, y: F.abs(y - x))


def temporal_centroid(levels: Column) -> Column:
    last = F.greatest(F.size(levels) - 1, F.lit(1))
    weighted = _sum(F.transform(levels, lambda v, k: F.when(v > 0, v * (k / last)).otherwise(F.lit(0.0))))
    return ratio(weighted, _sum(F.filter(levels, lambda v: v > 0)))


def dynamics(a: Column, rate: Column, window: int = WINDOW) -> dict[str, Column]:
    levels = rms_envelope(a, window)
    ordered = F.array_sort(levels)
    least = first_positive(ordered)
    low, high = F.when(least == 0, percentile(ordered, 0.05)).otherwise(least), percentile(ordered, 0.95)
    return {
        "dynamic_range_db": F.when((low > 0) & (high > 0), 20 * F.log10(high / low)).otherwise(F.lit(0.0)),
        "attack_sharpness": F.coalesce(F.array_max(steps(a)), F.lit(0.0)),
        "sustain_ratio": F.when(high > 0, percentile(ordered, 0.5) / high).otherwise(F.lit(0.0)),
        "transient_rate": ratio(F.size(F.filter(steps(a), lambda d: d >= 0.2)) * rate.cast("double"), F.size(a)),
        "temporal_centroid": temporal_centroid(levels),
        "window_count": F.size(levels).cast("double"),
    }


def correlation_at(a: Column, lag: Column) -> Column:
    """Normalized autocorrelation at a lag; zero where either part has no energy."""
    n = F.greatest(F.size(a) - lag, F.lit(0))
    x, y = F.slice(a, F.lit(1), n), F.slice(a, lag + 1, n)
    top = _sum(F.zip_with(x, y, lambda p, q: p * q))
    energy = squares(x) * squares(y)
    return F.when(energy > 0, top / F.sqrt(energy)).otherwise(F.lit(0.0))


def pitch(a: Column, rate: int, low_hz: float = 50, high_hz: float = 2000) -> Column:
    """struct(frequency_hz, midi_note, confidence, cents_from_note, note): the first local maximum of the normalized
    autocorrelation that reaches nine tenths of the best. For signals no longer than the analysis window."""
    least = max(1, int(rate / high_hz))
    most = F.least(F.lit(int(rate / low_hz)), F.size(a) - 1)
    scores = F.transform(F.sequence(F.lit(least), F.greatest(most, F.lit(least))), lambda lag: F.struct(correlation_at(a, lag).alias("s"), lag.alias("lag")))
    turned = lambda scores: F.array_max(F.transform(scores, lambda x: F.struct(x["s"].alias("s"), (-x["lag"]).alias("turn"))))
    found = lambda scores, best: _pitch_of(scores, best, rate, (best["s"] > 0) & (most >= least) & (F.size(a) >= 2))
    return with_value(scores, lambda scores: with_value(turned(scores), lambda best: found(scores, best)))


def _pitch_of(scores: Column, best: Column, rate: int, found: Column) -> Column:
    """pitch's struct from the scores by lag and the best of them; zeros unless found."""
    n = F.size(scores)

    def rises(x, k):
        before, after = F.get(scores, k - 1), F.get(scores, k + 1)
        return (k > 0) & (k < n - 1) & (x["s"] >= 0.9 * best["s"]) & (x["s"] >= before["s"]) & (x["s"] >= after["s"])

    first = F.get(F.filter(scores, rises), F.lit(0))
    zero = F.lit(0.0)

    def result(chosen):
        frequency = F.lit(float(rate)) / chosen["lag"]
        midi = 69 + 12 * F.log2(frequency / 440)
        near = F.round(midi)
        return F.struct(F.when(found, frequency).otherwise(zero).alias("frequency_hz"), F.when(found, midi).otherwise(zero).alias("midi_note"), F.when(found, chosen["s"]).otherwise(zero).alias("confidence"), F.when(found, (midi - near) * 100).otherwise(zero).alias("cents_from_note"), F.when(found, note_name(near.cast("int"))).otherwise(F.lit("")).alias("note"))

    return with_value(F.coalesce(first, F.struct(best["s"].alias("s"), (-best["turn"]).alias("lag"))), result)


def note_name(midi: Column) -> Column:
    """C4 is 60; empty below zero."""
    named = F.concat(F.element_at(F.array(*map(F.lit, NOTES)), F.pmod(midi, F.lit(12)).cast("int") + 1), (F.floor(midi / 12) - 1).cast("int").cast("string"))
    return F.when(midi < 0, F.lit("")).otherwise(named)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; zero where one of them does not vary."""
    n = F.size(a)
    top = n * _sum(F.zip_with(a, b, lambda x, y: x * y)) - _sum(a) * _sum(b)
    spread = (n * squares(a) - _sum(a) * _sum(a)) * (n * squares(b) - _sum(b) * _sum(b))
    return F.when(spread > 0, top / F.sqrt(spread)).otherwise(F.lit(0.0))


def key_of(chroma: Column) -> Column:
    """struct(score, root, mode): the best of 24 rotated profiles; lower roots first, major before minor."""
    tried = []
    for root in range(12):
        for turn, (mode, profile) in enumerate((("major", MAJOR), ("minor", MINOR))):
            rotated = F.array(*[F.lit(profile[(k - root) % 12]) for k in range(12)])
            tried.append(F.struct(F.round(pearson(chroma, rotated), 12).alias("score"), F.lit(-(2 * root + turn)).alias("turn"), F.lit(root).alias("root"), F.lit(mode).alias("mode")))
    return F.array_max(F.array(*tried))


def tonnetz(chroma: Column) -> Column:
    """Six coordinates: sine and cosine of fifths, minor and major thirds."""
    import math

    def along(turn, wave):
        return _sum(F.transform(chroma, lambda v, k: v * wave(k * turn)))

    return F.array(*[along(turn, wave) for turn in (7 * math.pi / 6, 3 * math.pi / 2, 2 * math.pi / 3) for wave in (F.sin, F.cos)])


def loop_class(confidence: Column) -> Column:
    return F.when(confidence >= 0.65, "loop").when(confidence < 0.35, "oneshot").otherwise("ambiguous")


def _points(*rules: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for test, points in rules:
        total = total + F.when(test, F.lit(points)).otherwise(F.lit(0.0))
    return total


def waveform_class(m: dict[str, Column]) -> tuple[Column, Column]:
    """(class, texture) from flatness, flux, zero_crossing_rate, attack_sharpness, sustain_ratio, transient_rate, confidence."""
    tonal = _points((m["confidence"] > 0.5, 0.5), (m["flatness"] < 0.25, 0.3), (m["sustain_ratio"] > 0.45, 0.2))
    percussive = _points((m["attack_sharpness"] > 0.5, 0.4), (m["sustain_ratio"] < 0.4, 0.3), (m["transient_rate"] > 20, 0.2), (m["flux"] > 0.08, 0.1), (m["confidence"] < 0.35, 0.1))
    noise = _points((m["flatness"] > 0.45, 0.5), (m["zero_crossing_rate"] > 0.1, 0.2), (m["confidence"] < 0.3, 0.2), (m["sustain_ratio"] < 0.5, 0.1))
    kind = F.when(noise > F.greatest(tonal, percussive), "noise").when(percussive > tonal, "percussive").otherwise("tonal")
    texture = F.when(kind == "noise", "noisy").when((kind == "percussive") | (m["attack_sharpness"] >= 0.5) | (m["transient_rate"] >= 20), "transient").when(m["flatness"] >= 0.4, "noisy").when(m["sustain_ratio"] >= 0.65, "sustained").otherwise("hybrid")
    return kind, texture


def valid(data: Column, channels: Column, rate: Column) -> Column:
    return (rate > 0) & (channels > 0) & (F.size(data) > 0) & (F.pmod(F.size(data), F.greatest(channels, F.lit(1))) == 0) & F.forall(data, lambda x: F.abs(x) <= 1)


def resample(a: Column, source: int, target: int, channels: int = 1) -> Column:
    """Linear interpolation to round(frames * target / source) frames, one at least; the right edge holds."""
    if target <= 0:
        raise ValueError("target rate must be positive")
    if target == source:
        return a
    n = (F.size(a) / channels).cast("int")
    count = F.greatest(F.round(n * F.lit(float(target)) / F.lit(float(source))).cast("int"), F.lit(1))

    def at(k):
        place = k * F.lit(float(source)) / F.lit(float(target))
        left = F.least(F.floor(place).cast("int"), n - 1)
        right = F.least(left + 1, n - 1)
        w = place - left
        return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.get(a, (left * channels + c).cast("int")) + (F.get(a, (right * channels + c).cast("int")) - F.get(a, (left * channels + c).cast("int"))) * w)

    return F.when(F.size(a) == 0, a).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), count - 1), at)))


def convert_channels(a: Column, source: int, target: int) -> Column:
    if source == target:
        return a
    if (source, target) == (2, 1):
        return mono(a, F.lit(2))
    if (source, target) == (1, 2):
        return F.flatten(F.transform(a, lambda x: F.array(x, x)))
    raise ValueError(f"cannot convert {source} to {target} channels")


def normalize(a: Column, mode: str = "peak", target_dbfs: float = 0.0, allow_clipping: bool = False) -> Column:
    """Gain to the target level of the peak or the RMS; silence fails, and so does clipping unless it is allowed."""
    if mode not in ("peak", "rms", "lufs"):
        raise ValueError(f"unsupported mode {mode!r}")
    now = dbfs(peak(a) if mode == "peak" else rms(a))
    gain = F.pow(F.lit(10.0), (F.lit(float(target_dbfs)) - now) / 20)
    scaled = F.transform(a, lambda x: F.greatest(F.least(x * gain, F.lit(1.0)), F.lit(-1.0)))
    failed = F.when(now <= SILENCE_DBFS, F.raise_error(F.lit("cannot normalize silent audio")).cast("array<double>"))
    if not allow_clipping:
        failed = failed.when(peak(a) * gain > 1 + 1e-12, F.raise_error(F.lit("requested gain would clip")).cast("array<double>"))
    return failed.otherwise(scaled)


def median_filter(a: Column, radius: int = 8) -> Column:
    """Median of the values up to `radius` away; the window is cut at the ends."""

    def at(_, k):
        low = F.greatest(k - radius, F.lit(0))
        part = F.array_sort(F.slice(a, low + 1, k + radius + 1 - low))
        return percentile(part, 0.5)

    return F.transform(a, at)


def local_maxima(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x, k: F.when((k > 0) & (k < F.size(a) - 1) & (x > F.get(a, k - 1)) & (x >= F.get(a, k + 1)), k)), lambda k: k.isNotNull())


def bitrate(size_bytes: Column, seconds: Column) -> Column:
    return F.when((size_bytes > 0) & (seconds > 0), F.floor(size_bytes * 8.0 / seconds)).otherwise(F.lit(0)).cast("long")


def channel_layout(channels: Column) -> Column:
    return F.when(channels == 1, "mono").when(channels == 2, "stereo").otherwise(F.concat(channels.cast("string"), F.lit("-channel")))
