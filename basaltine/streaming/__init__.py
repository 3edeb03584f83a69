"""Change streams with a progress watermark."""
