"""Fixed values that change results: labels, thresholds and letters of the book format."""

# Labels of blocks: book text, figures, captions.
TEXT_LABELS = ("text", "paragraph_title", "header", "doc_title")
FIGURE_LABELS = ("image", "chart", "seal")
CAPTION_LABELS = ("figure_title", "vision_footnote")

# Piece letters as printed (knight, bishop, rook, queen, king), by language of the book.
PIECES = {"fr": "CFTDR", "en": "NBRQK"}

# A move with its number, as footers print it.
NUMBERED = r"\b\d{1,3}\s*\.{1,3}\s*(?:[RDTFC][a-h1-8x]|[a-h][1-8]|0-0|O-O)"

# Pages and blocks.
MIN_TEXT_WORDS = 60
DPI = 200
HEAD_CHARS = 25
DEDUPE_LEAST, DEDUPE_WINDOWS = 12, ((0, 25), (30, 60), (60, 60), (90, 60))
LINE_TOLERANCE, ROW_BUCKET = 4, 8
SPARSE_AREA, SPARSE_RATIO, SPARSE_BLOCKS, REFILL_GAIN = 100_000, 0.3, 3, 2.0
MARGIN_SHARE, TREND_POINTS, TREND_LEAST = 0.15, 3, 0.6
ROW_SHARE, RECT_PAD, ALIGNED_SHARE = 0.6, 2, 0.6
MAX_IMAGES, MAX_IMAGE_PIXELS, FULL_PAGE_SHARE = 60, 40_000_000, 0.8
MAX_TEXT_OBJECTS = 20_000

# Positions.
SNAP_LIMIT, SNAP_MARGIN = 4, 2
SURE_RANKS, KING_GAIN = 2.0, 2.0
CONFIDENCE_FINER, CONFIDENCE_SECOND, VIVID_LEAST = 0.95, 0.99, 0.002
BOARD_SCORE, ASPECT = 2.5, (0.8, 1.25)
MAX_WRONG_SQUARES = 12
PAGE_REACH, NEAREST_BOXES, STRAY_REACH = 2, 120, 60
SQUARE_CLASSES = ".PNBRQKpnbrqk"

# Reader.
PARAGRAPH_CHARS = 150
RECT_WIDEN = 0.22
LANGUAGES = ("en", "fr", "es")
