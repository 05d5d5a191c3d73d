"""Line, log, block and configuration sources, and sinks."""
