"""Spectra and filters on numpy batches, for pandas and Arrow functions."""

from __future__ import annotations

import numpy as np

BAND = (4000.0, 12000.0)
FLOOR_PERCENTILE = 10
FLOOR_MARGIN = 1.12
SMOOTH_BINS = 5
FLOOR_BINS = 2
REACH_HZ = 1200.0
LEAST_POWER = 1e-12


def power_spectra(samples: np.ndarray, samplerate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one power spectrum a row) of rows of samples under a symmetric Hann window."""
    n = samples.shape[1]
    if n == 0:
        return np.zeros(0), np.zeros((len(samples), 0))
    return np.fft.rfftfreq(n, 1 / samplerate), np.abs(np.fft.rfft(samples * np.hanning(n), axis=1)) ** 2


def smoothed(power: np.ndarray, bins: int = SMOOTH_BINS) -> np.ndarray:
    """Moving average along rows with zeros beyond the edges."""
    k = min(bins, power.shape[1])
    if k <= 1:
        return power
    padded = np.pad(power, ((0, 0), (k - 1 - (k - 1) // 2, (k - 1) // 2)))
    return sum(padded[:, i : i + power.shape[1]] for i in range(k)) / k


def floor_crossings(freqs: np.ndarray, power: np.ndarray, peak: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """For every row the bin, walking from the peak by ``step``, at which FLOOR_BINS bins in a row are at or under the
    limit (the first of them); within REACH_HZ, else the lowest bin met; the peak itself at an edge. All rows walk at once."""
    rows, n = power.shape
    out, best = peak.copy(), peak + step
    alive = (best >= 0) & (best < n)
    best_power = np.where(alive, power[np.arange(rows), np.clip(best, 0, n - 1)], np.inf)
    out[alive] = best[alive]
    run, at = np.zeros(rows, int), peak + step
    while alive.any():
        here = np.clip(at, 0, n - 1)
        alive &= (at >= 0) & (at < n) & (np.abs(freqs[here] - freqs[peak]) <= REACH_HZ)
        now = power[np.arange(rows), here]
        lower = alive & (now < best_power)
        out[lower], best_power[lower] = here[lower], now[lower]
        run = np.where(alive & (now <= limit), run + 1, 0)
        done = alive & (run >= FLOOR_BINS)
        out[done] = np.clip(here - step * (FLOOR_BINS - 1), 0, n - 1)[done]
        alive &= ~done
        at = at + step
    return out


def slice_features(samples: np.ndarray, samplerate: float) -> dict[str, np.ndarray]:
    """Band spectrum, floor, dominant bin and floor crossings of rows of samples of one length."""
    freqs, power = power_spectra(samples, samplerate)
    inside = (freqs >= BAND[0]) & (freqs <= BAND[1])
    freqs, power = freqs[inside], power[:, inside]
    if not len(freqs):
        gap = np.full(len(samples), np.nan)
        return {"freqs": freqs, "power": power, "power_floor": gap, "dom_freq": gap, "left_freq": gap, "right_freq": gap, "dom_power": gap}
    floor = np.maximum(np.percentile(power, FLOOR_PERCENTILE, axis=1), LEAST_POWER)
    soft, peak = smoothed(power), power.argmax(1)
    left, right = (floor_crossings(freqs, soft, peak, floor * FLOOR_MARGIN, s) for s in (-1, 1))
    return {"freqs": freqs, "power": power, "power_floor": floor, "dom_freq": freqs[peak], "left_freq": freqs[left], "right_freq": freqs[right], "dom_power": power.max(1)}


def extract_slice(samples: np.ndarray, first: int, n: int) -> np.ndarray:
    """n samples from ``first`` on, zeros where there are none."""
    out = np.zeros(n, samples.dtype)
    a, b = max(first, 0), min(first + n, len(samples))
    if a < b:
        out[a - first : b - first] = samples[a:b]
    return out


def tukey(n: int, share: float = 0.25) -> np.ndarray:
    """The periodic tapered-cosine window."""
    x = np.arange(n) / n
    edge = np.minimum(x, 1 - x) * 2 / share
    return np.where(edge < 1, 0.5 * (1 - np.cos(np.pi * np.clip(edge, 0, 1))), 1.0)


def spectrogram(samples: np.ndarray, samplerate: float, size: int = 1024, overlap: int = 768) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, frame times, power bins x frames): means removed, tapered window, one-sided, scaled as a spectrum."""
    size = min(size, len(samples))
    hop = size - min(overlap, size - 1)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(float), size)[::hop]
    window = tukey(size)
    power = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * window, axis=1)) ** 2 / window.sum() ** 2
    power[:, 1 : (size + 1) // 2] *= 2
    return np.fft.rfftfreq(size, 1 / samplerate), (np.arange(len(frames)) * hop + size / 2) / samplerate, power.T


def butterworth(order: int, low: float, high: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2) of a Butterworth filter by the bilinear transform; the edges are shares
    of half the sampling rate, low 0 makes a low-pass, high 1 a high-pass."""
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))  # of the low-pass with edge 1
    down, up = (4 * np.tan(np.pi * x / 2) for x in (low, min(high, 1 - 1e-12)))
    if low <= 0:
        poles, zeros, gain = up * poles, np.zeros(0), up**order
    elif high >= 1:
        poles, zeros, gain = down / poles, np.zeros(order), 1.0
    else:
        half = poles * (up - down) / 2
        root = np.sqrt(half**2 - down * up)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), (up - down) ** order
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    digital = (4 + poles) / (4 - poles)
    ends = np.concatenate([np.ones(len(zeros)), -np.ones(len(poles) - len(zeros))])  # zeros at 1 where the analog ones are 0, else at -1
    above = digital[digital.imag > 1e-12]
    real = np.sort(digital[np.abs(digital.imag) <= 1e-12].real)
    pairs = [(p, p.conjugate()) for p in above[np.argsort(-np.abs(above))]] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    ups, downs = int((ends > 0).sum()), int((ends < 0).sum())
    out = []
    for pair in pairs:
        z = [1.0] * min(ups, 1) + [-1.0] * min(downs, 1) if ups and downs else [1.0] * min(ups, 2) or [-1.0] * min(downs, 2)
        ups, downs = ups - z.count(1.0), downs - z.count(-1.0)
        out.append([*np.real(np.poly(z)), *np.zeros(2 - len(z)), *np.real(np.poly(pair)), *np.zeros(2 - len(pair))])
    sections = np.array(out)
    sections[0, :3] *= gain
    return sections


def filtered(x: np.ndarray, section: np.ndarray, state: np.ndarray, block: int = 256) -> np.ndarray:
    """Rows of x through one second-order section from a state (rows x 2). Within a block all outputs are one product with
    the impulse response's matrix; only the state is handed from block to block."""
    b0, b1, b2, _, a1, a2 = section
    rows, n = x.shape
    step, take = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = np.empty((block + 1, 2, 2))
    powers[0] = np.eye(2)
    for i in range(block):
        powers[i + 1] = step @ powers[i]
    see = powers[:block, 0]  # what each output of a block sees of the state before it
    feed = powers[:block] @ take  # what an input does to the state, so many steps later
    response = np.concatenate([[b0], feed[: block - 1, 0]])
    at = np.arange(block)
    lower = np.where(at[:, None] >= at, response[np.abs(at[:, None] - at)], 0.0)
    padded = np.zeros((rows, -(-n // block) * block))
    padded[:, :n] = x
    parts = padded.reshape(rows, -1, block)
    out, gained = parts @ lower.T, parts @ feed[::-1]
    for i in range(parts.shape[1]):
        out[:, i] += state @ see.T
        state = state @ powers[block].T + gained[:, i]
    return out.reshape(rows, -1)[:, :n]


def steady(section: np.ndarray) -> tuple[np.ndarray, float]:
    """The state of a section that a constant input of 1 has settled in, and its output."""
    b0, b1, b2, _, a1, a2 = section
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array([gain - b0, b2 - a2 * gain]), gain


def zero_phase(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Rows of x filtered forwards and backwards. Both ends are extended by what lies there, turned about the end sample
    (three times the filter's length, or what there is), and each run starts as if its first sample had always been."""
    if x.shape[1] < 2:
        return x
    flat = min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum())
    edge = int(min(3 * (2 * len(sections) + 1 - flat), x.shape[1] - 1))
    out = np.concatenate([2 * x[:, :1] - x[:, edge:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]], axis=1)
    for _ in range(2):
        level = out[:, :1].copy()
        for s in sections:
            state, gain = steady(s)
            out = filtered(out, s, level * state)
            level = level * gain
        out = out[:, ::-1]
    return out[:, edge:-edge]


def bandpass(samples: np.ndarray, samplerate: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """Samples (or rows of them) band-passed without a shift: a Butterworth filter of ``order``, low-, high- or band-pass as
    the edges ask, run both ways; no change for the full range or a band of at most 1 Hz."""
    top = samplerate / 2
    low, high = max(low, 0.0), min(high, top)
    if high <= low + 1 or (low <= 0 and high >= top) or not samples.size:
        return samples
    rows = np.atleast_2d(samples).astype(float)
    return zero_phase(rows, butterworth(order, low / top, high / top)).reshape(samples.shape)


def db_clip_range(db: np.ndarray) -> tuple[float, float]:
    low, high = np.percentile(db, [5, 99])
    return float(low), float(high)


def mask(matrix: np.ndarray, rectangles: list[tuple[float, float, float, float]]) -> np.ndarray:
    """The matrix with relative rectangles (x, y, width, height in 0..1) filled with its median. A side of 1 is the whole
    side; another is rounded to one cell at least, and a rectangle with one that fills the matrix's is skipped."""
    out, median = matrix.copy(), np.median(matrix)
    for *corner, w, h in rectangles:
        spans = []
        for at, side, n in zip(corner, (w, h), matrix.shape[::-1]):
            size = n if side >= 1 else max(1, round(side * n))
            first = 0 if side >= 1 else min(int(at * n), n - size)
            spans.append((first, size, side < 1 and size >= n))
        (x, width, wide), (y, height, high) = spans
        if not (wide or high):
            out[y : y + height, x : x + width] = median
    return out
