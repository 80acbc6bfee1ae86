"""DataFrame operators over detections, events, recordings, frames and byte evidence."""
