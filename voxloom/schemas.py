"""Schemas of the library's tables."""

from __future__ import annotations

MANIFEST = (
    "segment_id string, record_id string, audio_path string, transcript_path string, transcript string, duration_s double, kind string, province string, "
    "speaker_age double, speaker_id string, topic string, year int, channel string, split string"
)
CHUNKS = (
    "chunk_id string, record_id string, start_s double, end_s double, speech_ratio double, wada_snr_db double, spectral_cluster_id int, era_bucket string, "
    "label string, label_share double, tags array<string>, scores array<double>, province string, topic string, n_speakers_hint int, flagged boolean"
)
NBEST = "chunk_id string, rank int, text string, avg_logprob double, no_speech_prob double"
HYPOTHESES = (
    "chunk_id string, record_id string, audio_path string, start_s double, end_s double, first_words array<string>, logprob double, second_words array<string>"
)
SEGMENTS = "record_id string, start_s double, end_s double, speaker string"
TURNS = "record_id string, line long, start_s double, end_s double, speaker string, text string, also array<string>"
METADATA = "record_id string, province string, age double, speaker_id string, topic string, year int, channel string"
SUBMISSIONS = "date string, timestamp string, track string, zip string, digest string, record_count int, record_ids array<string>, metadata map<string,string>"
SEGMENT_LABELS = "audio string, path string, text string"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def require(df, *columns: str):
    """df, or ValueError with the columns that it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
