"""Input transforms of the baseline networks: redundant spectra, wavelet coefficients, mel cepstra.

The last axis of an argument holds samples, all axes before it are a batch.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import dsp

# The published settings of the transforms.
REDUNDANCY, BINS = 6, 2048
WAVELET_LEVELS = 3
CEPSTRA, CEPSTRUM_HOP, CEPSTRUM_FFT = 40, 512, 2048
# The mel scale, linear to 1 kHz (15 mel), logarithmic above.
MEL_HZ, MEL_BREAK, MEL_STEP = 200.0 / 3.0, 1000.0, np.log(6.4) / 27.0


def redundant_spectrum(x: np.ndarray, fs: float) -> np.ndarray:
    """Log magnitudes of the zero-padded spectrum about their mean, the first bins (zeros where there are fewer)."""
    log = np.log10(np.abs(np.fft.rfft(x, REDUNDANCY * x.shape[-1])) + dsp.EPS)
    part = (log - log.mean(axis=-1, keepdims=True))[..., :BINS]
    out = np.zeros((*part.shape[:-1], BINS), np.float32)
    out[..., : part.shape[-1]] = part
    return out


def wavelet_coefficients(x: np.ndarray, fs: float) -> np.ndarray:
    return np.concatenate(dsp.wavedec(x, WAVELET_LEVELS), axis=-1).astype(np.float32)


@lru_cache(maxsize=8)
def mel_bank(filters: int, nfft: int, fs: float) -> np.ndarray:
    """Triangles between equally spaced mels, each with unit sum (filters x bins)."""
    knee = MEL_BREAK / MEL_HZ
    top = fs / 2 / MEL_HZ if fs / 2 < MEL_BREAK else knee + np.log(fs / 2 / MEL_BREAK) / MEL_STEP
    mel = np.linspace(0.0, top, filters + 2)
    hz = np.where(mel < knee, mel * MEL_HZ, MEL_BREAK * np.exp(MEL_STEP * (mel - knee)))
    f, left, mid, right = np.fft.rfftfreq(nfft, 1 / fs), hz[:-2, None], hz[1:-1, None], hz[2:, None]
    bank = np.maximum(0, np.minimum((f - left) / np.maximum(mid - left, 1e-9), (right - f) / np.maximum(right - mid, 1e-9)))
    return bank / np.where(bank.sum(axis=1, keepdims=True) > 0, bank.sum(axis=1, keepdims=True), 1)


@lru_cache(maxsize=8)
def cosines(n: int, keep: int) -> np.ndarray:
    """The first rows of the orthonormal cosine transform."""
    k = np.arange(keep)[:, None]
    rows = np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(2 / n)
    rows[0] /= np.sqrt(2)
    return rows


def mel_cepstrum(x: np.ndarray, fs: float) -> np.ndarray:
    """Cosine transform of log mel power, frame by frame, flattened."""
    _, z = dsp.stft(x, fs, CEPSTRUM_FFT, CEPSTRUM_HOP)
    power = np.abs(z) ** 2
    log = np.log(mel_bank(2 * CEPSTRA, 2 * (power.shape[-1] - 1), fs) @ power.swapaxes(-1, -2) + 1e-10)
    out = cosines(2 * CEPSTRA, CEPSTRA) @ log
    return out.astype(np.float32).reshape(*out.shape[:-2], -1)


def record_image(record: np.ndarray) -> np.ndarray:
    """Records scaled to whole numbers from 0 to 255; a flat one is 0."""
    lo, span = record.min(axis=-1, keepdims=True), np.ptp(record, axis=-1, keepdims=True)
    return np.where(span > 0, np.round((record - lo) / np.where(span > 0, span, 1) * 255), 0.0)


TRANSFORMS = {"rdft": redundant_spectrum, "dwt": wavelet_coefficients, "mfcc": mel_cepstrum}
