"""Frequency-domain analyzers on numpy arrays; one call per file gives all metrics.

Spectra are taken of Hann-windowed frames, the last one padded with zeros. As the feature vector defines it, they
end at a quarter of the sample rate: of the W / 2 + 1 bins of a real transform, the first (W / 2 + 1) // 2 + 1.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from auralith.functions.signals import MAJOR, MINOR, NOTES, WINDOW

#: A bound on the bytes of one block of frames' spectra.
BLOCK_BYTES = 16 << 20


def round_half_up(x):
    """Halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def mono(data: np.ndarray, channels: int) -> np.ndarray:
    return data if channels <= 1 else data[: len(data) // channels * channels].reshape(-1, channels).mean(1)


def power_of_two(n: int) -> int:
    """The least power of two that is at least n."""
    return 1 << max(0, n - 1).bit_length()


@lru_cache(32)
def hann(n: int) -> np.ndarray:
    return np.ones(n) if n <= 1 else 0.5 * (1 - np.cos(2 * np.pi / (n - 1) * np.arange(n)))


def window_for(n: int, most: int) -> int:
    return most if n >= most else max(2, power_of_two(n))


def frames(x: np.ndarray, window: int) -> np.ndarray:
    """Half-overlapping frames up to the first that reaches the end."""
    hop = max(1, window // 2)
    count = 1 if len(x) <= window else 1 + math.ceil((len(x) - window) / hop)
    padded = np.zeros((count - 1) * hop + window)
    padded[: len(x)] = x
    return np.lib.stride_tricks.sliding_window_view(padded, window)[::hop]


def kept_bins(window: int) -> int:
    return (window // 2 + 1) // 2 + 1


def transform(parts: np.ndarray) -> np.ndarray:
    return np.fft.rfft(parts * hann(parts.shape[-1]))[..., : kept_bins(parts.shape[-1])]


def magnitudes(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of magnitudes, and the bins in cycles per sample."""
    window = window_for(len(x), most)
    parts = frames(x, window)
    step = max(1, BLOCK_BYTES // (16 * window))
    out = np.concatenate([np.abs(transform(parts[k : k + step])) for k in range(0, len(parts), step)])
    return out, np.arange(out.shape[1]) / window


def _quantile(sorted_rows: np.ndarray, p: float) -> np.ndarray:
    at = p * (sorted_rows.shape[-1] - 1)
    low, high = math.floor(at), math.ceil(at)
    return sorted_rows[..., low] * (1 - (at - low)) + sorted_rows[..., high] * (at - low)


def contrast(mags: np.ndarray, hz: np.ndarray, rate: int, bands: int = 7) -> np.ndarray:
    """Decibels between the 90th and 10th percentile of octave bands from 200 Hz, mean over the frames."""
    out, low, high = np.zeros(bands), 0.0, 200.0
    for k in range(bands):
        last = k == bands - 1
        if last or high >= rate / 2:
            high = rate / 2
        own = mags[:, (hz >= low) & ((hz <= high) if last else (hz < high))]
        if own.shape[1]:
            rows = np.sort(own, axis=1)
            out[k] = (20 * np.log10(_quantile(rows, 0.9) + 1e-12) - 20 * np.log10(_quantile(rows, 0.1) + 1e-12)).mean()
        low, high = high, high * 2
    return out


def spectral(x: np.ndarray, rate: int, spectrum=None) -> dict[str, float]:
    mags, cycles = spectrum or magnitudes(x, 2048)
    hz, mean = cycles * rate, mags.mean(0)
    total = mean.sum()
    centroid = float((hz * mean).sum() / total) if total else 0.0
    above = mean[mean > 0]
    rises = np.maximum(np.diff(mags, axis=0), 0).sum() / mags.shape[1]
    turns = np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)) / (len(x) - 1)
    out = {
        "spectral_centroid_hz": centroid,
        "spectral_rolloff_hz": float(hz[np.argmax(np.cumsum(mean) >= 0.85 * total)]) if total else 0.0,
        "spectral_flux": float(rises / max(1, len(mags) - 1)),
        "zero_crossing_rate": turns,
        "dominant_frequency_hz": float(hz[1 + mean[1:].argmax()]) if len(mean) > 1 and mean[1:].max() > 0 else 0.0,
        "spectral_flatness": float(np.exp(np.log(above).mean()) / above.mean()) if len(above) else 0.0,
        "spectral_bandwidth_hz": math.sqrt(float((mean * (hz - centroid) ** 2).sum() / total)) if total else 0.0,
    }
    return out | {f"spectral_contrast_{k}": float(v) for k, v in enumerate(contrast(mags, hz, rate))}


def _dbfs(v: float) -> float:
    return 20 * math.log10(v) if v > 0 else -120.0


def loudness(data: np.ndarray) -> dict[str, float]:
    """Over all channels' samples as they are interleaved."""
    if not len(data):
        return dict.fromkeys(("peak", "peak_dbfs", "rms", "rms_dbfs", "crest_factor", "integrated_lufs", "mean_abs"), 0.0)
    peak, rms = float(np.abs(data).max()), float(np.sqrt(np.mean(data * data)))
    return {"peak": peak, "peak_dbfs": _dbfs(peak), "rms": rms, "rms_dbfs": _dbfs(rms), "crest_factor": peak / rms if rms > 0 else 0.0, "integrated_lufs": _dbfs(rms), "mean_abs": float(np.abs(data).mean())}


def envelope(x: np.ndarray, window: int = WINDOW) -> np.ndarray:
    if not len(x):
        return np.zeros(0)
    starts = np.arange(0, len(x), window)
    return np.sqrt(np.add.reduceat(x * x, starts) / np.minimum(window, len(x) - starts))


def _first_positive(ordered: np.ndarray) -> float:
    own = ordered[ordered > 0]
    return float(own[0]) if len(own) else 0.0


def quality(x: np.ndarray) -> dict[str, float]:
    ordered = np.sort(envelope(x))
    noise, signal = (float(_quantile(ordered, p)) or _first_positive(ordered) for p in (0.1, 0.9))
    return {"clipping_ratio": float((np.abs(x) >= 0.999).mean()), "dc_offset": float(x.mean()), "silence_ratio": float((np.abs(x) <= 0.001).mean()), "estimated_snr_db": 20 * math.log10(signal / noise) if noise > 0 and signal > 0 else 0.0}


def shape(levels: np.ndarray, window_ms: float) -> dict[str, float]:
    """Attack, decay, release and sustain level from an envelope; the level is a positional middle, not a median."""
    none = {"attack_time_ms": 0.0, "decay_time_ms": 0.0, "release_time_ms": 0.0, "sustain_level_dbfs": 0.0}
    if not len(levels) or levels.max() <= 0:
        return none
    top = int(levels.argmax())
    own = levels / levels[top]
    onset = int(np.argmax(own >= 0.1))
    sounding = np.flatnonzero(own[top:] >= 0.05)
    end = top + int(sounding[-1]) if len(sounding) else top
    level = float(_quantile(own[top + (end - top) // 2 : end + 1], 0.5))
    if level <= 0:
        level = float(_quantile(own[top : end + 1], 0.25))
    held = np.flatnonzero(own[top : end + 1] <= level * 1.1)
    start = top + int(held[0]) if len(held) else top
    still = np.flatnonzero(own[start : end + 1] >= level * 0.9)
    release = start + int(still[-1]) if len(still) else end
    return {"attack_time_ms": max(0, top - onset) * window_ms, "decay_time_ms": max(0, start - top) * window_ms, "release_time_ms": max(0, end - release) * window_ms, "sustain_level_dbfs": _dbfs(level)}


def dynamics(x: np.ndarray, rate: int) -> dict[str, float]:
    levels = envelope(x)
    ordered, jumps = np.sort(levels), np.abs(np.diff(x))
    low, high = _first_positive(ordered) or float(_quantile(ordered, 0.05)), float(_quantile(ordered, 0.95))
    place = np.arange(len(levels)) / max(1, len(levels) - 1)
    return {
        "dynamic_range_db": 20 * math.log10(high / low) if low > 0 and high > 0 else 0.0,
        "attack_sharpness": float(jumps.max(initial=0.0)),
        "sustain_ratio": float(_quantile(ordered, 0.5)) / high if high > 0 else 0.0,
        "transient_rate": float(np.count_nonzero(jumps >= 0.2) * rate / len(x)),
        "temporal_centroid": float((place * levels).sum() / levels.sum()) if levels.sum() else 0.0,
        "window_count": float(len(levels)),
    } | shape(levels, 1000 * WINDOW / rate)


def correlations(x: np.ndarray, least: int, most: int) -> np.ndarray:
    """Normalized autocorrelation at the lags from least to most, products by one transform."""
    n = len(x)
    size = power_of_two(2 * n)
    products = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[:n]
    energy = np.concatenate(([0.0], np.cumsum(x * x)))
    lag = np.arange(least, most + 1)
    spread = energy[n - lag] * (energy[n] - energy[lag])
    return np.where(spread > 1e-300, products[lag] / np.sqrt(np.maximum(spread, 1e-300)), 0.0)


def strongest(x: np.ndarray, window: int = 4096, hop: int = 1024) -> np.ndarray:
    if len(x) <= window:
        return x
    energy = np.concatenate(([0.0], np.cumsum(x * x)))
    starts = np.arange(0, len(x) - window + 1, hop)
    best = starts[(energy[starts + window] - energy[starts]).argmax()]
    return x[best : best + window]


def note(midi: int) -> str:
    return f"{NOTES[midi % 12]}{midi // 12 - 1}" if midi >= 0 else ""


def pitch(x: np.ndarray, rate: int) -> tuple[dict[str, float], dict[str, str]]:
    own = strongest(x)
    least, most = max(1, int(rate / 2000)), min(int(rate / 50), len(own) - 1)
    none = {"frequency_hz": 0.0, "midi_note": 0.0, "confidence": 0.0, "cents_from_note": 0.0}
    if most < least:
        return none, {}
    scores = correlations(own, least, most)
    at = int(scores.argmax())
    if scores[at] <= 0:
        return none, {}
    inner = scores[1:-1]
    tops = np.flatnonzero((inner >= 0.9 * scores[at]) & (inner >= scores[:-2]) & (inner >= scores[2:]))
    if len(tops):
        at = 1 + int(tops[0])
    hz = rate / (least + at)
    midi = 69 + 12 * math.log2(hz / 440)
    near = int(round_half_up(midi))
    return {"frequency_hz": hz, "midi_note": midi, "confidence": float(scores[at]), "cents_from_note": (midi - near) * 100}, {"note_name": note(near)}


def key(x: np.ndarray, rate: int) -> tuple[dict[str, float], dict[str, str]]:
    mags, cycles = magnitudes(x, 4096)
    hz = cycles * rate
    heard = (hz >= 20) & (np.arange(len(hz)) > 0)
    chroma = np.zeros(12)
    if heard.any():
        classes = np.mod(round_half_up(69 + 12 * np.log2(hz[heard] / 440)).astype(int), 12)
        chroma = np.bincount(classes, (mags[:, heard] ** 2).sum(0), 12)
    if chroma.sum():
        chroma = chroma / chroma.sum()
    best = (-1.0, 0, "major")
    for root in range(12):
        for mode, profile in (("major", MAJOR), ("minor", MINOR)):
            a, b = chroma - chroma.mean(), np.roll(profile, root) - np.mean(profile)
            spread = math.sqrt((a * a).sum() * (b * b).sum())
            score = float((a * b).sum() / spread) if spread else 0.0
            if score > best[0]:
                best = score, root, mode
    turn = np.arange(12)
    centroid = [float((chroma * wave(angle * turn)).sum()) for angle in (7 * np.pi / 6, 3 * np.pi / 2, 2 * np.pi / 3) for wave in (np.sin, np.cos)]
    numbers = {"key_confidence": best[0], "key_root_index": float(best[1])} | {f"chroma_{k}": float(v) for k, v in enumerate(chroma)} | {f"tonnetz_{k}": v for k, v in enumerate(centroid)}
    return numbers, {"key": f"{NOTES[best[1]]} {best[2]}", "key_tonic": NOTES[best[1]], "key_mode": best[2]}


def onsets(x: np.ndarray) -> np.ndarray:
    """Rises of the magnitudes over the larger of a bin and its neighbours a frame before, per frame, the largest as 1."""
    mags, _ = magnitudes(x, 1024)
    side = np.pad(mags[:-1], ((0, 0), (1, 1)), constant_values=-np.inf)
    before = np.maximum(np.maximum(side[:, :-2], side[:, 1:-1]), side[:, 2:])
    rises = np.maximum(mags[1:] - before, 0).sum(1) / mags.shape[1]
    return rises / rises.max() if len(rises) and rises.max() > 0 else rises


def beat(x: np.ndarray, rate: int) -> dict[str, float]:
    none = dict.fromkeys(("tempo_bpm", "beat_period_seconds", "onset_strength", "beat_count_estimate"), 0.0)
    rises, hop = onsets(x), max(1, window_for(len(x), 1024) // 2)
    if len(rises) < 2:
        return none
    least = max(1, int(round_half_up(60 * rate / (hop * 200))))
    most = min(int(round_half_up(60 * rate / (hop * 60))), len(rises) - 1)
    scores = [float(rises[lag:] @ rises[:-lag]) for lag in range(least, most + 1)]
    if not scores or max(scores) <= 0:
        return none
    bpm = 60 * rate / (hop * (least + int(np.argmax(scores))))
    return {"tempo_bpm": bpm, "beat_period_seconds": 60 / bpm, "onset_strength": float(rises.mean()), "beat_count_estimate": len(x) / rate * bpm / 60}


def mel(hz):
    return 2595 * np.log10(1 + np.asarray(hz) / 700)


def from_mel(m):
    return 700 * (10 ** (np.asarray(m) / 2595) - 1)


@lru_cache(32)
def mel_filters(count: int, window: int, rate: int, low: float, high: float) -> np.ndarray:
    """(count, window / 2 + 1): triangles between points evenly spaced in mel, at least a bin wide on each side."""
    bins = window // 2 + 1
    edges = np.minimum(np.floor((window + 1) * from_mel(np.linspace(mel(low), mel(high), count + 2)) / rate).astype(int), bins - 1)
    out, k = np.zeros((count, bins)), np.arange(bins)
    for m in range(count):
        left, centre, right = edges[m], edges[m + 1], edges[m + 2]
        centre = max(centre, left + 1)
        right = max(right, centre + 1)
        up, down = (k >= left) & (k < centre), (k >= centre) & (k < right)
        out[m, up] = (k[up] - left) / (centre - left)
        out[m, down] = (right - k[down]) / (right - centre)
    return out


def mfcc(x: np.ndarray, rate: int, count: int = 13, filters: int = 26, spectrum=None) -> dict[str, float]:
    mags, _ = spectrum or magnitudes(x, 2048)
    bank = mel_filters(filters, window_for(len(x), 2048), rate, 0.0, rate / 2)[:, : mags.shape[1]]
    logs = np.log(np.maximum((mags**2) @ bank.T, 1e-12)).mean(0)
    basis = np.cos(np.pi / filters * np.outer(np.arange(count), np.arange(filters) + 0.5))
    return {f"mfcc_{k}": float(v) for k, v in enumerate(basis @ logs)}


def _medians(mags: np.ndarray, radius: int) -> np.ndarray:
    """Median over the frames up to `radius` away, the window cut at the ends."""
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(mags, ((radius, radius), (0, 0)), constant_values=np.nan), 2 * radius + 1, axis=0)
    whole = slice(radius, len(mags) - radius)
    out = np.empty_like(mags)
    if len(mags) > 2 * radius:
        out[whole] = np.median(wide[whole], axis=-1)
        ends = [*range(radius), *range(len(mags) - radius, len(mags))]
    else:
        ends = range(len(mags))
    for k in ends:
        out[k] = np.median(mags[max(0, k - radius) : k + radius + 1], axis=0)
    return out


def hpss(x: np.ndarray, spectrum=None) -> dict[str, float]:
    mags, _ = spectrum or magnitudes(x, 2048)
    steady, sudden = _medians(mags, 8), _medians(mags.T, 8).T
    both = steady + sudden
    share = np.divide(steady, both, out=np.zeros_like(both), where=both > 0)
    h, p = float(((mags * share) ** 2).sum()), float(((mags * np.where(both > 0, 1 - share, 0)) ** 2).sum())
    return {"harmonic_energy_ratio": h / (h + p) if h + p else 0.0, "percussive_energy_ratio": p / (h + p) if h + p else 0.0, "harmonic_percussive_ratio": h / p if p else 0.0}


def maxima(v: np.ndarray) -> np.ndarray:
    return 1 + np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] >= v[2:]))


def harmonics(x: np.ndarray, rate: int) -> dict[str, float]:
    window = window_for(len(x), 4096)
    part = np.zeros(window)
    part[: min(len(x), window)] = x[:window]
    mags = np.abs(transform(part))
    peaks = maxima(mags)
    peaks = peaks[np.lexsort((peaks, -mags[peaks]))][:12]
    hz, energy = peaks * rate / window, mags[peaks] ** 2
    low = hz[(energy >= 0.2 * energy.max(initial=0.0)) & (hz >= 50)]
    base = float(low.min()) if len(low) else float((1 + mags[1:].argmax()) * rate / window) if len(mags) > 1 and mags[1:].max() > 0 else 0.0
    if base <= 0 or not len(peaks):
        return {"harmonic_ratio": 0.0, "inharmonicity": 0.0}
    used = hz >= 0.5 * base
    expected = np.maximum(1, round_half_up(hz / base)) * base
    off = np.abs(hz - expected)
    near = used & (off <= max(rate / window, 0.015 * base))
    return {"harmonic_ratio": float(energy[near].sum() / energy.sum()) if energy.sum() else 0.0, "inharmonicity": float((energy * off / expected)[used].sum() / energy[used].sum()) if energy[used].sum() else 0.0}


def predictor(x: np.ndarray, order: int) -> np.ndarray | None:
    """Linear prediction coefficients by Levinson and Durbin's recursion; none for silence."""
    r = np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)])
    if r[0] == 0:
        return None
    a, error = np.zeros(0), r[0]
    for i in range(order):
        k = (r[i + 1] - a @ r[i:0:-1][: len(a)]) / error
        a = np.append(a - k * a[::-1], k)
        error *= 1 - k * k
        if error <= 0:
            break
    return a


def formants(x: np.ndarray, rate: int) -> dict[str, float]:
    out = {f"formant_{k}_hz": 0.0 for k in range(1, 5)}
    if len(x) < 256:
        return out
    own = x[:4096].copy()
    own[1:] -= 0.97 * x[:4096][:-1]
    own *= hann(len(own))
    a = predictor(own, min(12, len(own) - 1))
    if a is None:
        return out
    hz = np.arange(50.0, min(5000, rate / 2) + 1e-9, 10)
    response = 1 - np.exp(-2j * np.pi / rate * np.outer(hz, np.arange(1, len(a) + 1))) @ a
    for k, f in enumerate(hz[maxima(1 / np.maximum(1e-9, np.abs(response) ** 2))][:4]):
        out[f"formant_{k + 1}_hz"] = float(f)
    return out


def splices(x: np.ndarray, spectrum=None) -> dict[str, float]:
    mags, _ = spectrum or magnitudes(x, 2048)
    if len(mags) < 2:
        return {"splice_count": 0.0, "splice_max_strength": 0.0, "splice_mean_strength": 0.0}
    jump = np.sqrt((np.diff(mags, axis=0) ** 2).mean(1))
    high = jump[jump >= jump.mean() + 2 * jump.std()]
    return {"splice_count": float(len(high)), "splice_max_strength": float(jump.max()), "splice_mean_strength": float(high.mean()) if len(high) else 0.0}


def _unit(v: float) -> float:
    return min(1.0, max(0.0, v))


def loop(x: np.ndarray, rate: int, beat_seconds: float) -> dict[str, float]:
    window = 2048
    while window > 1 and 2 * window > len(x):
        window //= 2
    boundary = phase = 0.0
    if window >= 2:
        head, tail = transform(x[:window]), transform(x[len(x) - window :])
        a, b = np.abs(head), np.abs(tail)
        size = math.sqrt(float(a @ a)) * math.sqrt(float(b @ b))
        boundary = _unit(float(a @ b) / size) if size else 0.0
        if len(a) > 1 and a[1:].max() > 0:
            k = 1 + int(a[1:].argmax())
            if b[k] >= 0.05 * a[k]:
                apart = abs(np.angle(head[k]) - np.angle(tail[k])) % (2 * math.pi)
                phase = 1 - min(apart, 2 * math.pi - apart) / math.pi
    whole = math.sqrt(float(np.mean(x * x)))
    tail_part = x[len(x) - max(1, len(x) // 10) :]
    tail_ratio = _unit(math.sqrt(float(np.mean(tail_part * tail_part))) / whole) if whole else 0.0
    levels, periodic = envelope(x), 0.0
    if len(levels) >= 2:
        lags = {int(round_half_up(k / 20 * len(levels))) for k in range(1, 21)} | set(range(1, 21))
        if beat_seconds > 0:
            lags |= {int(round_half_up(bars * 4 * beat_seconds * rate / WINDOW)) for bars in (1, 2, 4, 8)}
        scores = correlations(levels, 1, len(levels) - 1)
        periodic = _unit(max([0.0, *(float(scores[k - 1]) for k in lags if 0 < k < len(levels))]))
    return {"loop_boundary_similarity": boundary, "loop_tail_rms_ratio": tail_ratio, "loop_periodicity_score": periodic, "loop_phase_alignment": phase, "loop_confidence": _unit(0.35 * boundary + 0.30 * tail_ratio + 0.25 * periodic + 0.10 * phase)}


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    if source == target or not len(x):
        return x
    n = max(1, int(round_half_up(len(x) * target / source)))
    return np.interp(np.arange(n) * (source / target), np.arange(len(x)), x)


def perceptual_hash(x: np.ndarray, rate: int) -> int:
    """64 bits: whether a band of the first 8192 samples at 8 kHz has at least the mean energy; zero for under 16 samples."""
    if len(x) < 16 or rate <= 0:
        return 0
    own = resample(x, rate, 8000)[:8192]
    part = np.zeros(max(256, power_of_two(len(own))))
    part[: len(own)] = own
    mags = np.abs(transform(part))
    width = max(1, (len(mags) - 1) // 64)
    energy = np.bincount(np.minimum(63, np.arange(len(mags) - 1) // width), mags[1:] ** 2, 64)
    if energy.sum() > 0:
        energy = energy / energy.sum()
    return sum(1 << k for k in np.flatnonzero(energy >= energy.mean()).tolist())


def hash_text(bits: int) -> str:
    return f"{bits:016x}"


def waveform(m: dict[str, float]) -> tuple[str, str]:
    tonal = 0.5 * (m["confidence"] > 0.5) + 0.3 * (m["spectral_flatness"] < 0.25) + 0.2 * (m["sustain_ratio"] > 0.45)
    percussive = 0.4 * (m["attack_sharpness"] > 0.5) + 0.3 * (m["sustain_ratio"] < 0.4) + 0.2 * (m["transient_rate"] > 20) + 0.1 * (m["spectral_flux"] > 0.08) + 0.1 * (m["confidence"] < 0.35)
    noise = 0.5 * (m["spectral_flatness"] > 0.45) + 0.2 * (m["zero_crossing_rate"] > 0.1) + 0.2 * (m["confidence"] < 0.3) + 0.1 * (m["sustain_ratio"] < 0.5)
    kind = "noise" if noise > max(tonal, percussive) else "percussive" if percussive > tonal else "tonal"
    if kind == "noise":
        return kind, "noisy"
    if kind == "percussive" or m["attack_sharpness"] >= 0.5 or m["transient_rate"] >= 20:
        return kind, "transient"
    return kind, "noisy" if m["spectral_flatness"] >= 0.4 else "sustained" if m["sustain_ratio"] >= 0.65 else "hybrid"


ANALYZERS = ("spectral", "loudness", "dynamics", "hpss", "quality", "harmonics", "formants", "splices", "beat", "pitch", "key", "mfcc", "loop")


def analyze(data: np.ndarray, channels: int, rate: int, which: tuple[str, ...] = ANALYZERS) -> tuple[dict[str, float], dict[str, str]]:
    """Metrics and attributes of one decoded file; transforms that several analyzers share are made once."""
    metrics: dict[str, float] = {}
    attributes: dict[str, str] = {}
    x = mono(data, channels)
    if "loudness" in which:
        metrics |= loudness(data)
    if len(x) < 2 or rate <= 0:
        return metrics, attributes
    shared = magnitudes(x, 2048) if {"spectral", "hpss", "splices", "mfcc"} & set(which) else None
    plain = {
        "spectral": lambda: spectral(x, rate, shared), "dynamics": lambda: dynamics(x, rate), "hpss": lambda: hpss(x, shared), "quality": lambda: quality(x),
        "harmonics": lambda: harmonics(x, rate), "formants": lambda: formants(x, rate), "splices": lambda: splices(x, shared), "beat": lambda: beat(x, rate), "mfcc": lambda: mfcc(x, rate, spectrum=shared),
    }
    for name in which:
        if name in plain:
            metrics |= plain[name]()
        elif name in ("pitch", "key"):
            numbers, texts = (pitch if name == "pitch" else key)(x, rate)
            metrics |= numbers
            attributes |= texts
    if "loop" in which:
        seconds = metrics.get("beat_period_seconds") if "beat" in which else beat(x, rate)["beat_period_seconds"]
        metrics |= loop(x, rate, seconds or 0.0)
        attributes["loop_class"] = "loop" if metrics["loop_confidence"] >= 0.65 else "oneshot" if metrics["loop_confidence"] < 0.35 else "ambiguous"
    return metrics, attributes
