"""The reference has no streaming operator (no watermark, window or state);
nothing is built here on purpose."""
