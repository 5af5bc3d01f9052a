"""Structured Streaming: sources, parsing, windows, sinks and supervision."""

from ebbline.streaming.parse import dead_letters, parse_envelope, valid_events
from ebbline.streaming.sinks import Supervisor, start_sink, state_on_disk, upsert_sink
from ebbline.streaming.sources import file_envelopes, kafka_envelopes
from ebbline.streaming.windows import running_sessions, session_metrics, windowed_metrics

__all__ = ["Supervisor", "dead_letters", "file_envelopes", "kafka_envelopes", "parse_envelope", "running_sessions", "session_metrics", "start_sink", "state_on_disk", "upsert_sink", "valid_events", "windowed_metrics"]
