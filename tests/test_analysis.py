"""Made signals: their measures lie where they must."""

import numpy as np
import pytest

from auralith.functions import clap, dsp
from auralith.sources import audio

RATE = 44_100


def sine(hz, seconds=1.0, rate=RATE, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def impulses(bpm, seconds, rate=RATE):
    out = np.zeros(int(seconds * rate))
    out[:: int(rate * 60 / bpm)] = 1
    return out


def test_spectral():
    m = dsp.spectral(sine(440), RATE)
    assert m["dominant_frequency_hz"] == pytest.approx(440, abs=30)
    assert 0.015 < m["zero_crossing_rate"] < 0.025
    assert m["spectral_centroid_hz"] < RATE / 4


def test_pitch():
    numbers, texts = dsp.pitch(sine(440), RATE)
    assert numbers["frequency_hz"] == pytest.approx(440, abs=10)
    assert texts["note_name"] == "A4"
    assert dsp.pitch(np.zeros(5000), RATE)[0]["frequency_hz"] == 0


def test_beat():
    assert dsp.beat(impulses(120, 4), RATE)["tempo_bpm"] == pytest.approx(120, abs=5)


def test_key():
    numbers, texts = dsp.key(sine(261.63, 2) / 3 + sine(329.63, 2) / 3 + sine(392.0, 2) / 3, RATE)
    assert texts["key"] == "C major"
    assert numbers["chroma_0"] > numbers["chroma_1"] and numbers["chroma_4"] > numbers["chroma_3"] and numbers["chroma_7"] > numbers["chroma_6"]


def test_levels():
    x = np.tile([0.5, -0.5], 500)
    m = dsp.loudness(x)
    assert m["peak"] == pytest.approx(0.5) and m["rms"] == pytest.approx(0.5)
    assert dsp.loudness(np.zeros(10))["rms_dbfs"] == -120
    q = dsp.quality(np.concatenate([np.ones(2048), np.full(2048, 0.002), np.full(2048, 0.25)]))
    assert q["clipping_ratio"] > 0 and q["dc_offset"] > 0 and q["estimated_snr_db"] > 0


def test_dynamics():
    m = dsp.dynamics(np.repeat([0, 0.2, 0.5, 0.9, 0.5, 0.2, 0.05], 1024), RATE)
    assert m["dynamic_range_db"] > 0 and m["temporal_centroid"] > 0.45 and m["attack_time_ms"] > 0 and m["sustain_level_dbfs"] < 0


def test_formants_and_splices():
    stored = audio.decode(audio.encode(audio.Signal(RATE, 1, 16, (sine(500, level=1) + sine(1500, level=1) + sine(2500, level=1)) / 3), "wav"), "wav")
    m = dsp.formants(stored.data, RATE)  # the noise of 16 bits keeps the predictor well-posed
    assert 300 < m["formant_1_hz"] < 700 and 1000 < m["formant_2_hz"] < 2000
    joined = np.concatenate([sine(440, 0.5), sine(880, 0.5)])
    assert dsp.splices(joined)["splice_max_strength"] > dsp.splices(sine(440))["splice_max_strength"]


def test_hpss_and_harmonics():
    assert dsp.hpss(sine(440))["harmonic_energy_ratio"] > dsp.hpss(impulses(120, 1))["harmonic_energy_ratio"]
    assert dsp.harmonics(sine(440) + sine(880) / 4, RATE)["harmonic_ratio"] > 0.5


def test_hash():
    a, b = dsp.perceptual_hash(sine(440), RATE), dsp.perceptual_hash(sine(440, rate=22_050), 22_050)
    assert (a ^ b).bit_count() <= 8
    assert (dsp.perceptual_hash(sine(110), RATE) ^ dsp.perceptual_hash(sine(1760), RATE)).bit_count() >= 2
    assert dsp.hash_text(dsp.perceptual_hash(np.zeros(3), RATE)) == "0" * 16


def test_loop():
    whole = dsp.analyze(sine(440, 2), 1, RATE)
    assert whole[0]["loop_confidence"] >= 0.65 and whole[1]["loop_class"] == "loop"
    fading = dsp.analyze(np.concatenate([sine(440, 0.2), np.zeros(2 * RATE)]), 1, RATE)
    assert fading[0]["loop_confidence"] < 0.35
    assert dsp.analyze(np.zeros(RATE), 1, RATE)[0]["loop_tail_rms_ratio"] == 0


def test_waveforms():
    def kind(x):
        return dsp.waveform(dsp.analyze(x, 1, RATE)[0])

    assert kind(sine(440)) == ("tonal", "sustained")
    assert kind(impulses(240, 2)) == ("percussive", "transient")
    assert kind(np.random.default_rng(1).uniform(-0.05, 0.05, RATE))[0] in ("noise", "percussive")


def test_short_signals_do_not_fail():
    for n in (0, 1, 2, 3, 17, 255, 300):
        for x in (np.zeros(n), np.linspace(-1, 1, n) if n else np.zeros(0)):
            metrics, _ = dsp.analyze(x, 1, 8000)
            assert all(np.isfinite(v) for v in metrics.values()), (n, metrics)


def test_envelope_matches_loops():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, 5000)
    assert dsp.envelope(x) == pytest.approx([np.sqrt(np.mean(x[k : k + 1024] ** 2)) for k in range(0, 5000, 1024)])
    lags = [1, 5, 400]
    want = [x[: len(x) - k] @ x[k:] / np.sqrt((x[: len(x) - k] @ x[: len(x) - k]) * (x[k:] @ x[k:])) for k in lags]
    assert [dsp.correlations(x, 1, 400)[k - 1] for k in lags] == pytest.approx(want)


@pytest.mark.parametrize("depth", [8, 16, 24, 32])
@pytest.mark.parametrize("form", ["wav", "aiff"])
def test_codecs(depth, form):
    x = np.random.default_rng(2).uniform(-1, 1, 300)
    got = audio.decode(audio.encode(audio.Signal(22_050, 2, depth, x), form), form)
    assert (got.rate, got.channels, got.depth, got.frames) == (22_050, 2, depth, 150)
    assert np.abs(got.data - x).max() <= 2.5 / 2 ** (depth - 1)


def test_bad_files():
    for body in (b"", b"RIFF", b"RIFF\0\0\0\0WAVE", b"FORM1234AIFF"):
        for form in ("wav", "aiff", "aac"):
            with pytest.raises(audio.CodecError):
                audio.decode(body, form)
    with pytest.raises(audio.CodecError):
        audio.encode(audio.Signal(8000, 1, 16, np.array([2.0])), "wav")
    with pytest.raises(audio.CodecError):
        audio.encode(audio.Signal(8000, 1, 16, np.array([0.5])), "flac")


def test_embedded_fields():
    def frame(name, data):
        return name + len(data).to_bytes(4, "big") + b"\0\0" + data

    frames = frame(b"TIT2", b"\x03 Tone ") + frame(b"TRCK", b"\x003/12") + frame(b"COMM", b"\x00eng\x00Neon; Rain") + frame(b"TDRC", b"\x002021-05") + frame(b"APIC", b"x")
    body = b"ID3\x03\0\0" + len(frames).to_bytes(4, "big") + frames
    assert audio.embedded(body) == ({"title": "Tone", "track": "3", "track_total": "12", "comment": "Neon; Rain", "year": "2021"}, True)
    assert audio.embedded(b"RIFF") == ({}, False)


def test_front_end():
    mels = clap.log_mel(sine(440), 1, RATE)
    assert mels.shape == (64, 1501) and mels.dtype == np.float32
    assert mels.min() == 0 and mels.max() == pytest.approx(1)
    assert dsp.mel_filters(64, 1024, 48_000, 50.0, 14_000.0).shape == (64, 513)
    with pytest.raises(ValueError):
        clap.log_mel(np.zeros(0), 1, RATE)


def test_tokenizer():
    text = '{"model": {"type": "BPE", "vocab": {"a": 0, "m": 1, "am": 8, "b": 2, "i": 3, "bi": 9, "\\u0120": 7, "<|startoftext|>": 49406, "<|endoftext|>": 49407}, "merges": ["a m", "b i"]}}'
    ids, mask = clap.Tokenizer(text).encode("am bi")
    assert ids[:5] == [49406, 8, 7, 9, 49407] and len(ids) == 77 and sum(mask) == 5
    assert clap.cosine(np.zeros(2), np.ones(2)) == 0
