"""Schemas of the library's tables. Times are DOUBLE seconds, frequencies DOUBLE hertz."""

# Column names and headers of the file formats.

ENTRIES = "metafile long, pos long, entry_name string"
RECORDINGS = "path string, samplerate int, channels int, frames long, duration double"
LOG = "tag string, source string, channel string, left string, right string, top string, bottom string, comment string, notes string"
SIGNATURES = ("FolderName", "MetafileName", "AnnotationFileName", "AnnotationName")
ANNOTATIONS = (
    "FolderName string, MetafileName string, AnnotationFileName string, AnnotationName string, AudioPath string, soundfile string, channel string, "
    "lefttimesec string, righttimesec string, topfreqhz string, bottomfreqhz string, comment string, notes string"
)
REQUIRED_ANNOTATIONS = ("soundfile", "channel", "lefttimesec", "righttimesec", "topfreqhz", "bottomfreqhz", "comment", "notes")
DETECTION_COLUMNS = ("audio_path", "window_index", "window_start", "window_end", "detection_index", "start_time", "end_time", "duration", "low_freq", "high_freq", "confidence")
DETECTIONS = (
    "audio_path string, window_index long, window_start double, window_end double, detection_index long, start_time double, end_time double, "
    "duration double, low_freq double, high_freq double, confidence double"
)


def require_columns(df, names) -> None:
    """Raises before any job runs if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_ratios(*ratios: float) -> None:
    if any(not 0 <= r <= 1 for r in ratios) or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"ratios must lie in 0..1 and sum to 1: {ratios}")
