"""Streaming forms of the frame and trace operators."""
