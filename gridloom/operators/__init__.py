"""Operators on images: filters, morphology, measurements, labels, Fourier filters and resampling."""
