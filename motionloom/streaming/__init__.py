"""The batch column functions applied to a stream of points."""
