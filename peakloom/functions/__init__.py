"""Part of the peakloom engine."""
