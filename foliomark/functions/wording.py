"""Fixed values that appear in results.

All of these are part of the output contract: changing one changes the documents.
"""

# --- file suffixes (lower case) -------------------------------------------------
PDF_SUFFIXES = [".pdf"]
SLIDE_SUFFIXES = [".pptx", ".ppt"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp", ".tiff", ".tif", ".bmp", ".gif"]

# --- engines --------------------------------------------------------------------
QUICK_ENGINE = "markitdown"
OCR_ENGINES = ["paddle", "surya", "tesseract"]
DEFAULT_OCR_ENGINE = "tesseract"
NO_ENGINE = "none"

# --- gates ----------------------------------------------------------------------
QUICK_MIN_CHARS = 200
QUICK_MIN_NEWLINES = 5
DETECTION_PAGES = 3
EMBEDDED_MIN_CHARS = 50
OCR_MIN_CONFIDENCE = 0.5
# the engine whose unsure lines are left out
SURE_LINES_ENGINES = ("paddle",)
ROW_BAND = 20

# --- languages ------------------------------------------------------------------
DEFAULT_LANGUAGES = ["es", "en"]
LANGUAGE_CODES = {
    "es": "spa",
    "en": "eng",
    "fr": "fra",
    "de": "deu",
    "it": "ita",
    "pt": "por",
    "ca": "cat",
    "nl": "nld",
}

# --- Markdown pieces; {n} is a 1-based page or slide number ------------------------
PAGE_HEADING = "\n## Página {n}\n"
SLIDE_HEADING = "\n## Diapositiva {n}\n"
TITLE_PARAGRAPH = "### {text}"
TITLE_WORDS = ["title", "título", "subtitle"]
NOTES_BLOCK = "\n> **Notas:** {text}\n"
IMAGE_SECTION = "\n## Imágenes extraídas\n\n{links}\n"
IMAGE_LINK = "![{label}](images/{name})"
FIGURE_LABEL = "Figura"
PAGE_LABEL = "Página {n}"

# --- warnings ---------------------------------------------------------------------
PAGE_PARTIAL_ERROR = "\n> ⚠️ Página {n}: error parcial al extraer bloques.\n"
PAGE_NOT_RASTERIZED = "\n> ⚠️ Página {n}: no pudo rasterizarse. Contenido omitido.\n"
PAGE_OCR_EMPTY = "\n> ⚠️ Página {n}: OCR no produjo resultado.\n"
PAGE_OCR_FAILED = "\n> ⚠️ Página {n}: no pudo procesarse (error OCR). Contenido omitido.\n"
SLIDE_FAILED = "\n> ⚠️ Diapositiva {n}: error al procesar.\n"
IMAGE_OCR_EMPTY = "\n> ⚠️ OCR no produjo resultado para {name}.\n"
IMAGE_OCR_FAILED = "\n> ⚠️ Error al aplicar OCR: {error}\n"

# --- report -----------------------------------------------------------------------
STATUS_OK = "ok"
STATUS_ERROR = "error: {message}"
UNSUPPORTED_TYPE = "Tipo de archivo no soportado: {suffix}"
UNSUPPORTED_ENGINE = "Motor OCR no soportado: {engine}. Opciones: {options}"
NO_OUTPUT = "—"

# --- stages in which a file may fail ---------------------------------------------
CONVERT, COUNT, WRITE, WORKER = "convert", "count", "write", "worker"

# --- text cleaning ----------------------------------------------------------------
BULLETS = "•·▪▸→"
STAR = "*"
# one by one, not as ranges: then a pattern looks each character up in a table
CONTROL_CHARS = "[" + "".join(rf"\x{code:02x}" for code in (*range(9), 11, 12, *range(14, 32), 127)) + "]"
NAME_FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'
NAME_TRIM = ". "
# every character that counts as white space when a text is stripped
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
