"""Tables of the catalog, the analysis result, and the order of the feature vector."""

from __future__ import annotations

SAMPLES = "id long, source_root string, path string, relative_path string, file_name string, extension string, format string, size_bytes long, modified_at timestamp, scanned_at timestamp, created_at timestamp, updated_at timestamp"
TAGS = "id long, name string, normalized_name string, source string, confidence double, created_at timestamp"
SAMPLE_TAGS = "sample_id long, tag_id long, created_at timestamp"
FEATURE_VECTORS = "id long, sample_id long, namespace string, version string, dimensions int, values array<double>, created_at timestamp"
CLUSTERS = "id long, method string, label string, params map<string,double>, created_at timestamp"
CLUSTER_MEMBERS = "cluster_id long, sample_id long, score double, created_at timestamp"
PERCEPTUAL_HASHES = "sample_id long, algorithm string, hash string, hash_bits long, created_at timestamp"
TABLES = {
    "samples": SAMPLES,
    "tags": TAGS,
    "sample_tags": SAMPLE_TAGS,
    "feature_vectors": FEATURE_VECTORS,
    "clusters": CLUSTERS,
    "cluster_members": CLUSTER_MEMBERS,
    "perceptual_hashes": PERCEPTUAL_HASHES,
}
TAG = "struct<name: string, normalized_name: string, source: string, confidence: double>"
RESULT = f"sample_id long, metrics map<string,double>, attributes map<string,string>, tags array<{TAG}>"

VECTOR_NAMESPACE = "analysis"
# fixed values: the version and order of the feature vector
VECTOR_VERSION = "0.8.0"
VECTOR_ORDER = (
    ["sample_rate", "channels", "bit_depth", "bitrate", "duration_seconds"]
    + ["spectral_centroid_hz", "spectral_rolloff_hz", "spectral_flux", "zero_crossing_rate", "dominant_frequency_hz", "spectral_flatness", "spectral_bandwidth_hz"]
    + [f"spectral_contrast_{k}" for k in range(7)]
    + ["peak", "peak_dbfs", "rms", "rms_dbfs", "crest_factor", "integrated_lufs", "mean_abs"]
    + ["dynamic_range_db", "attack_sharpness", "sustain_ratio", "transient_rate", "temporal_centroid"]
    + ["harmonic_energy_ratio", "percussive_energy_ratio", "harmonic_percussive_ratio"]
    + ["attack_time_ms", "decay_time_ms", "release_time_ms", "sustain_level_dbfs"]
    + ["clipping_ratio", "dc_offset", "silence_ratio", "estimated_snr_db"]
    + ["harmonic_ratio", "inharmonicity"]
    + [f"formant_{k}_hz" for k in range(1, 5)]
    + ["splice_count", "splice_max_strength", "splice_mean_strength"]
    + ["tempo_bpm", "beat_period_seconds", "onset_strength", "beat_count_estimate"]
    + ["frequency_hz", "midi_note", "confidence", "cents_from_note"]
    + [f"chroma_{k}" for k in range(12)]
    + [f"tonnetz_{k}" for k in range(6)]
    + [f"mfcc_{k}" for k in range(13)]
    + ["loop_boundary_similarity", "loop_tail_rms_ratio", "loop_periodicity_score", "loop_phase_alignment", "loop_confidence"]
)
