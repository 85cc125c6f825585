"""Fixed values that define results."""

CHUNK_SIZE, CHUNK_OVERLAP = 512, 64
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
BM25_K1, BM25_B, IDF_SHIFT = 1.5, 0.75, 1.0
RRF_K = 60
TOP_K, MAX_TOP_K, MAX_QUERY_CHARS = 5, 50, 4096
HIGH_CONFIDENCE = 0.7
RECALL_CUTOFFS, NDCG_CUTOFF, MIN_EVAL_TOP_K = (1, 5, 10), 10, 10
MAX_FILE_BYTES = MAX_URL_BYTES = 10 * 1024 * 1024
EXTENSIONS = (".md", ".markdown", ".txt")
EMBED_DIMS, HASH_EMBED_DIMS, EMBED_BATCH = 768, 384, 32
CONTEXT_TOKENS, CHARS_PER_TOKEN = 4000, 4
SNIPPET_CHARS = 160
MIN_EVAL_DOCS, MIN_JUDGMENTS, MAX_TOKEN_OVERLAP = 8, 40, 0.7
MODES = ("bm25", "dense", "hybrid")
CATEGORIES = ("normal", "ambiguous", "no_answer", "adversarial")
SOURCE_CLASSES = ("text", "extracted", "snapshot")
