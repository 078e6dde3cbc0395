"""Structured Streaming maintenance of the count-based reports."""

from bizlens.streaming.incremental import (hour_of_day_counts, weekday_counts, start_report_stream,
                                           stream_checkpoint_location)

__all__ = ["hour_of_day_counts", "weekday_counts", "start_report_stream", "stream_checkpoint_location"]
