"""Settings of the engine. Sizes are in whitespace tokens, distances are cosine distances."""

# Fixed values that results depend on.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 100
TOP_K = 10
DISTANCE_THRESHOLD = 0.5
CONTENT_LIMIT = 10_000
