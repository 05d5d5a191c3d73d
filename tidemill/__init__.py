"""Line, tuple, block-file and membership analytics as plain DataFrame operators."""
