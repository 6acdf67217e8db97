"""Word lists, patterns and thresholds the results depend on.

Everything here is a constant of the document rules. Patterns are Java regular
expressions; ``(?U)`` makes ``\\w``, ``\\s`` and ``\\b`` Unicode aware.
"""

# Block types a layout model emits.
TEXT_TYPES = ["Text", "TextInlineMath", "ListItem", "ListGroup", "Caption", "Code", "Equation", "ComplexRegion"]
BODY_TEXT_TYPES = ["Text", "TextInlineMath", "ListItem", "ListGroup"]
IMAGE_TYPES = ["Figure", "Picture", "Table"]
DROP_TYPES = ["PageHeader", "PageFooter", "Footnote", "Reference", "TableOfContents", "Handwriting", "Form"]
GROUP_TYPES = ["FigureGroup", "PictureGroup", "TableGroup"]

# Section names.
STOP_NAMES = r"(?:acknowledg(?:e)?ments?|references?|bibliography|works?\s+cited)"
SKIP_NAMES = (
    r"(?:ccs\s+concepts?|keywords?|key\s+words?|index\s+terms?|categories\s+and\s+subject\s+descriptors|"
    r"acm\s+reference\s+format|general\s+terms?)"
)
BODY_NAMES = (
    r"(?:abstract|introduction|background|related\s+work|prior\s+work|motivation|methods?|methodology|"
    r"materials\s+and\s+methods|experiments?|experimental\s+(?:setup|results?|evaluation|methodology)|"
    r"results?|evaluation|analysis|discussion|conclusion|conclusions?(?:\s+and\s+(?:future|proposed)\s+work)?|"
    r"future\s+work|summary|appendix|preliminaries|notation|problem\s+statement|overview|design|implementation|"
    r"architecture|system\s+(?:design|model|architecture)|approach|proposed\s+(?:method|approach|system)|"
    r"limitations|threats\s+to\s+validity)"
)
METADATA_NAMES = r"(?:keywords?|key\s*words?|supplement(?:al|ary)\s+materials?)"
CAPTION_NAMES = (
    r"(?:figure|figura|fig\.?|table|tabla|tab\.?|cuadro|image|imagen|img\.?|esquema|diagrama|schema|diagram|chart)"
)

# Noise patterns.
HARD_NOISE = (
    r"\bpermission\s+to\s+(?:make|copy|reproduce|distribute)\b|\b(?:acm|ieee)\s+(?:reference\s+format|copyright)\b|"
    r"\bisbn\s*[\d\-]+|\bdoi[\.:\s]+\S+|\bdoi\.org\b|\barxiv(?:\.org)?\b|\bpreprint\b|\bunder\s+review\b|"
    r"\bsubmitted\s+to\b|\bpublication\s+rights\b"
)
LICENSE_NOISE = (
    r"\bcreative\s+commons\b|\bcc\s+by(?:[- ]?(?:nc|sa|nd))*(?:\s+\d+(?:\.\d+)?)?\b|"
    r"\battribution(?:[- ](?:non[- ]?commercial|share[- ]?alike|no[- ]?derivatives))*"
    r"\s+\d+(?:\.\d+)?\s+international(?:\s+license)?\b|"
    r"\b(?:licen[sc]ed?|distributed|made\s+available)\s+under\s+(?:a\s+|the\s+)?"
    r"(?:creative\s+commons|cc\s+by|gnu|mit|bsd|apache|gpl)\b|"
    r"\bcreativecommons\.org\S*|©\s*\d{4}|\(c\)\s*\d{4}|\bcopyright\s+(?:©|\(c\))?\s*(?:held|notice|\d{4})"
)
SOFT_NOISE = (
    r"@|\buniversit(?:y|ies)\b|\binstitute\b|\bdepartment\b|\bcollege\b|\baffiliation\b|\bschool\s+of\b|"
    r"\blab(?:oratory|oratories)?\b|\b(?:e-?mail|correspondence|corresponding\s+author)\b|"
    r"\bproceedings\s+of\b|\bconference\s+on\b|\bin\s+proceedings\b|\bworkshop\s+on\b"
)
PROPER_NOUN = r"[A-ZÁÉÍÓÚÑÜ][\w'’\-]*"
NAME_STRIP_CHARS = "0123456789.,;:*†‡§¶∗·¹²³⁴⁵⁶⁷⁸⁹⁰()[]{}"
EMAIL = r"[^\s@,;()<>]+@[^\s@,;()<>]+\.[A-Za-z]{2,}"

# Continuation, list and label patterns.
SOFT_BREAKS = "-—¬"
PARAGRAPH_END_TRIM = " \t\n\r\"'”’»)]}"
SENTENCE_TERMINALS = ".!?…"
BULLET = r"[-*–—•◦‣·∙▪▫]|\(?[a-z]\)|\(?\d{1,3}[.)]|[ivxlcdm]{1,4}[.)]"
PANEL_LABEL = r"(?i:\(\s*(?:[a-z]|[ivxlcdm]{1,4})\s*[).．。）])|[a-z]\s*[).．。）]|[ivxlcdm]{1,4}\s*[).．。）]"
TABLE_NOTE = r"(?:notes?|notas?)\s*[.:—–]|\*|[a-z][.)](?=\s)"
ALGORITHM_HEADER = r"Algorithm\s+\d+\b"
ALGORITHM_LABEL_ONLY = r"Algorithm\s+\d+\s*[:.\-—]?\s*$"
FOOTNOTE_SYMBOLS = "*†‡§¶‖∥#⁂⁑⁎∗"
STRONG_FOOTNOTE_SYMBOLS = "†‡§¶‖∥"
SENTENCE_BOUNDARY = r"(?<=[.!?…])(?U:\s+)(?=[A-ZÁÉÍÓÚÑ¿¡\"\(])"
MERGED_SENTENCE_END = r"[.!?…)\"'»\]](?U:\s*)$"
MERGED_SENTENCE_START = r"^(?U:\s*)[A-ZÁÉÍÓÚÜÑ¿¡(\"'«\[]"

# Words that carry no meaning when an answer is matched to a sentence.
STOP_WORDS = [
    "de", "del", "la", "el", "los", "las", "en", "a", "y", "o", "u", "e", "un", "una", "unos", "unas", "que", "se", "con", "por",
    "para", "su", "sus", "al", "es", "son", "lo", "le", "les", "si", "como", "más", "pero", "este", "esta", "estos", "estas",
    "ese", "esa", "esos", "esas", "the", "an", "of", "in", "to", "and", "or", "for", "with", "is", "are", "at", "by", "on", "its",
    "be", "has", "was", "were", "it", "this", "that", "from", "as",
]

# Language codes.
LANGUAGE_NAMES = {"es": "Spanish", "en": "English", "zh-Hant": "Traditional Chinese (繁體中文)"}
DEFAULT_LANGUAGE, FALLBACK_LANGUAGE_NAME = "es", "English"

# Geometry thresholds, in points or fractions.
GEOM_TOL = 2.0
MAX_GAP_LINES = 1.5
FOOTNOTE_FONT_RATIO = 0.82
CALLOUT_MIN_W, CALLOUT_MIN_H, CALLOUT_MAX_AREA, CALLOUT_INSIDE = 60.0, 18.0, 0.7, 0.6
WHITEISH = 0.92
SEPARATOR_MIN_WIDTH, SEPARATOR_MAX_HEIGHT, SEPARATOR_BOTTOM, SEPARATOR_CLUSTER_GAP = 0.30, 3.0, 0.72, 90.0
WIDE_FRACTION, NARROW_FRACTION = 0.70, 0.55
PANEL_H_OVERLAP, PANEL_V_OVERLAP, PANEL_GAP_FRACTION, PANEL_GAP, PANEL_SLOP = 0.35, 0.40, 0.75, 48.0, 0.5
MATH_OVERLAP, MATH_GAP_FACTOR = 0.3, 2.5
ALGORITHM_GAP, ALGORITHM_TITLE_GAP, ALGORITHM_OVERLAP, ALGORITHM_TITLE_WORDS = 1.8, 3.0, 0.55, 14
TABLE_NOTE_GAP, TABLE_LOOKAHEAD, TABLE_TITLE_WORDS, TABLE_OVERLAP = 200.0, 4, 30, 0.15
ICON_W, ICON_H, ICON_AREA = 130, 70, 12000
SAME_OBJECT = 0.6

# Progress phases with a constant percentage and status.
PROGRESS = {
    "started": (5, "analyzing"), "device_started": (10, "analyzing"), "device_skipped": (0, "fallback"),
    "batch_oom": (0, "fallback"), "cuda_oom_abandon": (0, "fallback"), "batch_success": (95, "analyzing"),
    "chunk_tier_started": (20, "fallback"), "chunk_started": (25, "analyzing"), "chunk_oom": (0, "fallback"),
    "chunked_success": (95, "analyzing"), "device_exhausted": (0, "fallback"), "child_error": (0, "fallback"),
    "global_map_started": (97, "analyzing"), "done": (100, "done"), "failed": (0, "error"),
}
RETRYABLE_STATUSES = [429, 502, 503, 504]
MAX_ATTEMPTS = 3
JOB_TTL_SECONDS = 3600
HISTORY_LENGTH = 100
NATIVE_TEXT_MIN_CHARS = 50
