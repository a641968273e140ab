"""Streaming counterparts of batched indexing; extensions of this engine."""
