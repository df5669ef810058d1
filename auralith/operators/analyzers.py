"""Decoding and analysis of files: one Arrow pass gives metrics, attributes, hash and feature vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralith.functions import dsp
from auralith.schemas import VECTOR_NAMESPACE, VECTOR_ORDER, VECTOR_VERSION
from auralith.sources import audio

RESULT = "id long, metrics map<string,double>, attributes map<string,string>, hash string, error string"
MODES = ("FAILFAST", "PERMISSIVE")


def analyze_bytes(body: bytes, form: str, extension: str = "", which: tuple[str, ...] = dsp.ANALYZERS) -> tuple[dict, dict, str]:
    """Metrics, attributes and perceptual hash of one file."""
    signal = audio.decode(body, form)
    metrics, attributes = dsp.analyze(signal.data, signal.channels, signal.rate, which)
    fields, picture = audio.embedded(body)
    seconds = signal.seconds
    facts = {
        "sample_rate": float(signal.rate), "channels": float(signal.channels), "bit_depth": float(signal.depth), "frames": float(signal.frames), "duration_seconds": seconds,
        "bitrate": float(int(len(body) * 8 / seconds)) if seconds > 0 and body else 0.0, "size_bytes": float(len(body)), "embedded_fields": float(len(fields)),
    }
    layout = {1: "mono", 2: "stereo"}.get(signal.channels, f"{signal.channels}-channel")
    attributes |= {"format": form, "channel_layout": layout, "extension": extension} | {f"embedded.{k}": v for k, v in fields.items()}
    if picture:
        attributes["embedded.picture"] = "true"
    return facts | metrics, attributes, dsp.hash_text(dsp.perceptual_hash(dsp.mono(signal.data, signal.channels), signal.rate))


def analyze_files(files: DataFrame, mode: str = "FAILFAST", which: tuple[str, ...] = dsp.ANALYZERS) -> DataFrame:
    """RESULT from (id, content, format, extension): FAILFAST ends with the first file that cannot be decoded,
    PERMISSIVE gives its error instead of results. Rows are never shuffled; a file is decoded once."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: files may be large
                one = batch.slice(k, 1)
                metrics, attributes, digest, error = None, None, None, None
                try:
                    metrics, attributes, digest = analyze_bytes(one.column("content")[0].as_py() or b"", one.column("format")[0].as_py(), one.column("extension")[0].as_py() or "", which)
                except audio.CodecError as e:
                    if mode == "FAILFAST":
                        raise
                    error = str(e)
                arrays = [one.column("id"), pa.array([list(metrics.items()) if metrics else None], pa.map_(pa.string(), pa.float64())), pa.array([list(attributes.items()) if attributes else None], pa.map_(pa.string(), pa.string())), pa.array([digest], pa.string()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "metrics", "attributes", "hash", "error"])

    return files.select(F.col("id").cast("long"), F.col("content").cast("binary"), "format", "extension").mapInArrow(run, RESULT)


def analyze_signals(signals: DataFrame, rate: int, which: tuple[str, ...] = dsp.ANALYZERS) -> DataFrame:
    """(id, metrics, attributes, hash) from mono signals (id, data array<double>)."""

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column("data"):
                x = np.asarray(data.values.to_numpy(zero_copy_only=False), np.float64) if data.is_valid else np.zeros(0)
                metrics, attributes = dsp.analyze(x, 1, rate, which)
                out.append((list(metrics.items()), list(attributes.items()), dsp.hash_text(dsp.perceptual_hash(x, rate))))
            arrays = [batch.column("id"), pa.array([o[0] for o in out], pa.map_(pa.string(), pa.float64())), pa.array([o[1] for o in out], pa.map_(pa.string(), pa.string())), pa.array([o[2] for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "metrics", "attributes", "hash"])

    return signals.select(F.col("id").cast("long"), "data").mapInArrow(run, "id long, metrics map<string,double>, attributes map<string,string>, hash string")


def vector(metrics: Column, order: list[str] | None = None) -> Column:
    """The metrics in the vector's order, zero for those that are missing."""
    names = F.array(*map(F.lit, order or VECTOR_ORDER))
    return F.transform(names, lambda n: F.coalesce(F.try_element_at(metrics, n), F.lit(0.0)))


def feature_vectors(results: DataFrame) -> DataFrame:
    values = vector(F.col("metrics"))
    return results.where("metrics is not null").select(F.col("id").alias("sample_id"), F.lit(VECTOR_NAMESPACE).alias("namespace"), F.lit(VECTOR_VERSION).alias("version"), values.alias("values"), F.current_timestamp().alias("created_at"))


def convert_files(files: DataFrame, target: str, rate: int = 0, channels: int = 0, normalize: str = "", target_dbfs: float = 0.0, allow_clipping: bool = False) -> DataFrame:
    """(id, content) re-encoded: resampled, then channels, then level. Fails on silence or clipping unless that is allowed."""
    if target not in audio.ENCODERS:
        raise ValueError(f"unsupported target format {target!r}")

    def one(body: bytes, form: str) -> bytes:
        s = audio.decode(body, form)
        s.check()
        if rate and rate != s.rate:
            parts = s.data.reshape(-1, s.channels)
            s = audio.Signal(rate, s.channels, s.depth, np.stack([dsp.resample(parts[:, k], s.rate, rate) for k in range(s.channels)], 1).ravel())
        if channels and channels != s.channels:
            if (s.channels, channels) not in ((1, 2), (2, 1)):
                raise audio.CodecError(f"cannot convert {s.channels} to {channels} channels")
            s = audio.Signal(s.rate, channels, s.depth, np.repeat(s.data, 2) if channels == 2 else dsp.mono(s.data, 2))
        if normalize:
            level = dsp.loudness(s.data)
            now = level["peak_dbfs"] if normalize == "peak" else level["rms_dbfs"]
            if now <= -120:
                raise audio.CodecError("cannot normalize silent audio")
            gain = 10 ** ((target_dbfs - now) / 20)
            if level["peak"] * gain > 1 and not allow_clipping:
                raise audio.CodecError("requested gain would clip")
            s = audio.Signal(s.rate, s.channels, s.depth, np.clip(s.data * gain, -1, 1))
        return audio.encode(s, target)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([row.column("id"), pa.array([one(row.column("content")[0].as_py(), row.column("format")[0].as_py())], pa.binary())], ["id", "content"])

    return files.select(F.col("id").cast("long"), F.col("content").cast("binary"), "format").mapInArrow(run, "id long, content binary")
