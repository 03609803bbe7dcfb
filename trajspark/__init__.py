"""Vehicle-trajectory analytics on Spark: kinematics, neighbours, trips, refinement, emissions and spatial maps."""
