"""PySpark-native engine for keyed observation data: timelines, pairs, tracks, trajectories, descriptors."""
