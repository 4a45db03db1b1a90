"""Training-data operators over the bank's texts: call transcripts, complaints and feature vectors.

Nothing else in the library imports this package.
"""
