"""Motion analytics on Spark: tracks, calibration, kinematics, fits and scoring."""
