"""Inputs: transcripts, recordings, manifests."""
