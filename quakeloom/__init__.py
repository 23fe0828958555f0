"""A PySpark engine for earthquake-catalogue and waveform-similarity analytics."""
