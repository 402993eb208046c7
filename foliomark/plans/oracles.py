"""The registered queries once more, as SQL over the given tables.

Written independently of the operators: common table expressions build the
canonical tables, small Python helpers only assemble SQL text.
"""

from __future__ import annotations

import re

DATE = "2024-01-01"


def _chars(codes: list[int]) -> str:
    return "(" + " || ".join(f"chr({code})" for code in codes) + ")"


WS = _chars(
    [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


#: Any character that is no white space.
INK = r"'[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'"


def inked(x: str) -> str:
    """Whether something is left once ``x`` is stripped; null for null."""
    return f"regexp_matches({x}, {INK})"


def control(x: str) -> str:
    return rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"


def headers(x: str) -> str:
    return rf"regexp_replace({x}, '(?m)^(#{{1,6}})\s*#+\s*', '\1 ', 'g')"


def lists(x: str) -> str:
    bullets = rf"regexp_replace({x}, '(?m)^\s*[•·▪▸→]\s+', '- ', 'g')"
    return rf"regexp_replace({bullets}, '(?m)^\s*\*\s+', '- ', 'g')"


def spaces(x: str) -> str:
    line = "CASE WHEN starts_with(l, '|') THEN l ELSE regexp_replace(l, '  +', ' ', 'g') END"
    return f"array_to_string(list_transform(string_split({x}, {NL}), lambda l: {line}), {NL})"


def breaks(x: str) -> str:
    return rf"regexp_replace({x}, '\n{{3,}}', {NL} || {NL}, 'g')"


def clean(x: str) -> str:
    return strip(breaks(spaces(lists(headers(control(x))))))


def file_of(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def suffix_of(file: str) -> str:
    return rf"regexp_extract({file}, '^.+(\.[^.]+)$', 1)"


def stem_of(file: str) -> str:
    return rf"regexp_replace({file}, '^(.+)\.[^.]+$', '\1')"


def kind_of(file: str) -> str:
    suffix = f"lower({suffix_of(file)})"
    return f"""CASE WHEN {suffix} = '.pdf' THEN 'pdf'
        WHEN {suffix} IN ('.pptx', '.ppt') THEN 'pptx'
        WHEN {suffix} IN ('.png', '.jpg', '.jpeg', '.webp', '.tiff', '.tif', '.bmp', '.gif')
        THEN 'image' END"""


def sanitized(name: str) -> str:
    return rf"""trim(regexp_replace({name}, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '. ')"""


def output_of(file: str) -> str:
    return f"'output/' || {sanitized(stem_of(file))} || '.md'"


def image_name(prefix: str, number: str) -> str:
    return f"{prefix} || '_image_' || printf('%03d', {number}) || '.png'"


def link(label: str, name: str) -> str:
    return f"'![' || {label} || '](images/' || {name} || ')'"


def padded(x: str) -> str:
    """A block with a line break on either side."""
    return f"{NL} || {x} || {NL}"


def sufficient(text: str) -> str:
    enough = f"length(s) > 200 AND length(s) - length(replace(s, {NL}, '')) > 5"
    return f"coalesce(list_transform([{strip(text)}], lambda s: {enough})[1], false)"


def joined(text: str, order: str, separator: str) -> str:
    return f"string_agg({text}, {separator} ORDER BY {order})"


def cells_line(cells: str) -> str:
    return f"'| ' || array_to_string(list_transform({cells}, lambda c: coalesce(c, '')), ' | ') || ' |'"


def table_md(rows: str, width: str) -> str:
    head = cells_line(f"list_resize({rows}[1], {width}, '')")
    rule = cells_line(f"list_resize([]::VARCHAR[], {width}, '---')")
    body = f"list_transform({rows}[2:], lambda r: {cells_line(f'list_resize(r, {width}, {chr(39) * 2})')})"
    return f"array_to_string(list_concat([{head}, {rule}], {body}), {NL})"


def front_matter(file: str, pages: str, engine: str, used: str) -> str:
    lines = [
        "'---'",
        f"'source: ' || {file}",
        f"'pages: ' || ({pages})",
        f"'generated_at: {DATE}'",
        f"'ocr_engine: ' || {engine}",
        f"'markitdown_used: ' || CASE WHEN {used} THEN 'true' ELSE 'false' END",
        "'languages: [es, en]'",
        "'---'",
    ]
    return f" || {NL} || ".join(lines)


ORDER = "page_no, section, k1, k2, k3, k4"
NO_KEYS = "0::DOUBLE AS k1, 0::DOUBLE AS k2, 0::BIGINT AS k3, 0::BIGINT AS k4"

# --- canonical tables ---------------------------------------------------------------

BAND = "round_even(y0 / 20.0, 0) * 20.0"

CTES = {
    "files": """SELECT doc_id, source || '/Doc ' || doc_id ||
        ['.pdf', '.PDF', '.pptx', '.ppt', '.png', '.JPEG', '.txt', ''][doc_id % 8 + 1] AS path
        FROM documents""",
    "named": f"""SELECT doc_id, {file_of("path")} AS file FROM files""",
    "dirty": f"""SELECT doc_id, chr(1) || '  ' || {NL} || '## ## Doc ' || doc_id || chr(127)
        || {NL} || {NL} || {NL} || {NL} || '  • ' || lang || {NL} || {NL} || ' * x   y' || {NL}
        || '| a   b |' || {NL} || '### ' || source || {NL} || '#' || {NL} || '##' || {NL}
        || text || ' ' || {NL} AS text FROM documents""",
    "doc_pages": f"""SELECT conv_id AS doc_id, turn::INT AS page_no,
        CASE WHEN turn % 5 = 0 THEN ' ' || {NL} END AS embedded_text,
        CASE WHEN turn % 5 = 2 AND role = 'user' THEN ' ' || {NL} || ' ' ELSE text END AS ocr_text,
        turn % 5 <> 4 AS rasterized,
        CASE WHEN turn % 5 = 3 AND role = 'assistant' THEN 'timeout' END AS ocr_error,
        turn % 5 = 1 AND role = 'user' AS block_error, role <> 'system' AS image_saved
        FROM conversations""",
    "blocks": f"""SELECT l_orderkey AS doc_id, floor((l_linenumber - 1) / 3)::INT AS page_no,
        l_linenumber::BIGINT * 1000000000000000000 + l_partkey * 1000000000 + l_suppkey AS block_no,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS block_type,
        l_quantity AS x0, l_extendedprice AS y0,
        CASE WHEN l_quantity = 1 THEN '  '
             WHEN l_linestatus = 'F' THEN '• Part ' || l_partkey || {NL}
             ELSE '  Part ' || l_partkey || '  as supplied by ' || l_suppkey END AS text
        FROM lineitem""",
    "kept_blocks": f"""SELECT * REPLACE ({strip("text")} AS text) FROM blocks
        WHERE block_type = 0 AND {inked("text")}""",
    "order_pages": """SELECT o_orderkey AS doc_id, page_no,
        CASE WHEN o_orderstatus = 'P' THEN ' - '
             ELSE 'Order ' || o_orderkey || ' of ' || o_orderpriority || ' ' END AS embedded_text,
        CASE WHEN o_orderstatus = 'P' THEN 'Scanned order ' || o_orderkey || ' of ' || o_orderpriority
             || ' with a total price of ' || floor(o_totalprice)::BIGINT END AS ocr_text,
        true AS rasterized, NULL::VARCHAR AS ocr_error,
        page_no = 2 AND o_orderkey % 10 = 0 AS block_error, o_orderstatus <> 'F' AS image_saved
        FROM orders, (SELECT unnest([0, 1, 2]) AS page_no)""",
    "table_rows": """SELECT floor(p_partkey / 40)::BIGINT AS doc_id, (p_partkey % 3)::INT AS page_no,
        (p_size % 10)::INT AS table_no,
        CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 1 ELSE 2 END AS extractor,
        p_partkey AS row_no,
        CASE WHEN p_size % 10 = 4 THEN []::VARCHAR[]
             WHEN p_partkey % 4 = 0 THEN [p_name]
             WHEN p_partkey % 4 = 1 THEN
                  [p_name, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN '' ELSE 'nan' END, 'x|y']
             ELSE [p_name, p_brand] END AS cells
        FROM part""",
    "found_tables": """SELECT doc_id, page_no, table_no, extractor, count(*) AS n_rows,
        max(len(cells))::INT AS width, list(cells ORDER BY row_no) AS rows
        FROM table_rows GROUP BY ALL HAVING max(len(cells)) > 0 AND count(*) >= extractor""",
    "page_tables": """SELECT * FROM found_tables
        QUALIFY extractor = min(extractor) OVER (PARTITION BY doc_id, page_no)""",
    "shapes": f"""SELECT o_custkey AS doc_id, (month(o_orderdate) - 1)::INT AS page_no,
        o_orderkey AS shape_no,
        CASE o_orderpriority WHEN '2-HIGH' THEN 'TABLE' WHEN '3-MEDIUM' THEN 'PICTURE'
             WHEN '5-LOW' THEN 'LINE' ELSE 'TEXT' END AS kind,
        CASE WHEN o_orderpriority <> '1-URGENT' THEN 'Content '
             WHEN o_orderstatus = 'F' THEN 'TÍTULO ' ELSE 'Subtitle ' END || o_orderkey AS name,
        CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice)::BIGINT END AS top,
        o_orderkey % 100 AS left_,
        [{{'level': 0, 'text': '  Order ' || o_orderkey || ' '}},
         {{'level': (o_orderkey % 4)::INT, 'text': 'item  ' || o_custkey}},
         {{'level': 1, 'text': '   '}}] AS paragraphs,
        [['Key', 'Total' || {NL} || 'price'],
         [o_orderkey::VARCHAR, '  ' || o_orderstatus || ' ', 'extra'],
         [NULL, o_orderpriority], [o_orderpriority]] AS rows,
        CASE WHEN o_orderkey % 3 = 0 THEN ' ' || {NL} ELSE 'OCR of  ' || o_orderkey END AS ocr_text,
        o_orderkey % 7 <> 0 AS decoded, o_orderstatus <> 'F' AS saved,
        CASE WHEN o_orderkey % 5 = 0 THEN 'timeout' END AS ocr_error,
        CASE WHEN o_orderkey % 11 = 0 THEN 'broken' END AS error
        FROM orders""",
    "frame_lines": f"""SELECT * EXCLUDE (lines, paragraphs, i), i - 1 AS pos,
        lines[i].level AS level, lines[i].text AS text FROM (
          SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (
            SELECT *, list_filter(list_transform(paragraphs, lambda p:
                {{'level': p.level, 'text': {strip("p.text")}}}), lambda p: p.text <> '') AS lines
            FROM shapes))""",
    "paragraph_lines": """SELECT *, CASE
        WHEN level = 0 AND (contains(lower(name), 'title') OR contains(lower(name), 'título'))
        THEN '### ' || text
        WHEN level > 0 THEN repeat('  ', level - 1) || '- ' || text ELSE text END AS md
        FROM frame_lines""",
    "notes": f"""SELECT conv_id AS doc_id, turn::INT AS page_no,
        CASE WHEN role = 'user' THEN ' ' || {NL} || text ELSE '  ' END AS text FROM conversations""",
    "shape_slides": """SELECT DISTINCT doc_id, page_no,
        CASE WHEN (doc_id + page_no) % 9 = 0 THEN 'broken' END AS error FROM shapes""",
    "slides": """SELECT *, CASE WHEN (doc_id + page_no) % 9 = 0 THEN 'broken' END AS error
        FROM (SELECT doc_id, page_no FROM shapes UNION SELECT doc_id, page_no FROM notes)""",
    "ocr_lines": """SELECT user_id AS doc_id, (event_id % 3)::INT AS page_no, event_id AS line_no,
        event_type AS text, value / 100 AS confidence FROM events""",
    "image_refs": """SELECT user_id AS doc_id, (event_id % 3)::INT AS page_no, event_id AS image_no,
        event_type <> 'error' AS decoded, value > 5 AS saved FROM events""",
    "images": """SELECT * FROM (SELECT *, row_number() OVER
        (PARTITION BY doc_id ORDER BY page_no, image_no) AS image_number
        FROM image_refs WHERE decoded) WHERE saved""",
    "image_pages": f"""SELECT doc_id, 0 AS page_no, NULL::VARCHAR AS embedded_text,
        CASE WHEN doc_id % 5 = 1 THEN '' ELSE
        coalesce({joined("CASE WHEN confidence > 0.5 THEN text END", "line_no", NL)}, '') END AS ocr_text,
        true AS rasterized,
        CASE WHEN doc_id % 5 = 2 THEN 'engine stopped at ' || doc_id END AS ocr_error,
        false AS block_error, doc_id % 5 <> 3 AS image_saved,
        'Photo? ' || doc_id || '.png' AS file
        FROM ocr_lines GROUP BY doc_id""",
    # --- files that the second tier could not open -------------------------------------
    "unreadable": f"""SELECT doc_id * 5 AS doc_id, kind, pages, engine, 'ok' AS status,
        {front_matter("file", "pages", "engine", "used")} || {NL} || {NL}
        || CASE WHEN used THEN {clean("text")} ELSE '' END || {NL} AS markdown
        FROM (SELECT *, CASE WHEN used THEN 'markitdown' ELSE 'tesseract' END AS engine,
                CASE WHEN kind = 'image' THEN 1 ELSE 0 END AS pages
              FROM (SELECT *, kind <> 'image' AND {sufficient("text")} AS used
                    FROM (SELECT doc_id, file, {kind_of("file")} AS kind FROM named)
                    JOIN documents USING (doc_id) WHERE kind IS NOT NULL))""",
    # --- the corpus: five kinds of files in one id space ------------------------------
    "c_files": """SELECT doc_id * 5 AS doc_id, path FROM files
        UNION ALL SELECT DISTINCT o_orderkey * 5 + 1, 'orders/Order: ' || o_orderkey || '.pdf' FROM orders
        UNION ALL SELECT DISTINCT conv_id * 5 + 2, 'scans/Scan ' || conv_id || '.PDF' FROM conversations
        UNION ALL SELECT DISTINCT o_custkey * 5 + 3, 'decks/Deck ' || o_custkey || '.pptx' FROM orders
        UNION ALL SELECT DISTINCT user_id * 5 + 4, 'photos/Photo? ' || user_id || '.png' FROM events""",
    "c_pages": """SELECT doc_id * 5 + 1 AS doc_id, page_no, embedded_text, ocr_text, rasterized,
          ocr_error, block_error, image_saved FROM order_pages
        UNION ALL SELECT doc_id * 5 + 2, page_no, embedded_text, ocr_text, rasterized,
          ocr_error, block_error, image_saved FROM doc_pages
        UNION ALL SELECT doc_id * 5 + 4, page_no, embedded_text, ocr_text, rasterized,
          ocr_error, block_error, image_saved FROM image_pages
        UNION ALL SELECT doc_id * 5, 0, CASE WHEN doc_id % 8 < 2 AND doc_id % 3 = 0 THEN text END,
          CASE WHEN doc_id % 8 > 1 OR doc_id % 3 > 0 THEN text END, true, NULL, false, doc_id % 2 = 0
          FROM documents WHERE doc_id % 8 IN (0, 1, 4, 5)""",
    "c_page_facts": f"""SELECT doc_id, count(*) AS pages, length({strip(
          "coalesce(string_agg(CASE WHEN page_no < 3 THEN embedded_text END, '' ORDER BY page_no), '')"
        )}) > 50 AS has_text FROM c_pages GROUP BY doc_id""",
    "c_slides": """SELECT doc_id * 5 + 3 AS doc_id, page_no, error FROM shape_slides
        UNION ALL SELECT doc_id * 5, 0, NULL FROM documents WHERE doc_id % 8 IN (2, 3)""",
    "c_slide_counts": "SELECT doc_id, count(*) AS slides FROM c_slides GROUP BY doc_id",
    "c_typed": f"""SELECT doc_id, file, {kind_of("file")} AS kind, {output_of("file")} AS output
        FROM (SELECT doc_id, {file_of("path")} AS file FROM c_files)""",
    "c_docs": f"""SELECT *, CASE WHEN kind IS NULL THEN 0 WHEN kind = 'image' THEN 1
          WHEN kind = 'pdf' THEN coalesce(pages_, 0) ELSE coalesce(slides, 0) END::INT AS pages,
        CASE WHEN route = 'quick' THEN 'markitdown' WHEN route IS NULL THEN 'none'
             ELSE 'tesseract' END AS engine,
        CASE WHEN kind IS NULL THEN
          'error: Tipo de archivo no soportado: ''' || lower({suffix_of("file")}) || ''''
          ELSE 'ok' END AS status
        FROM (SELECT t.*, p.pages AS pages_, slides,
          CASE WHEN kind <> 'image' AND coalesce({sufficient("q.text")}, false) THEN 'quick'
               WHEN kind = 'pdf' AND coalesce(has_text, false) THEN 'text_pdf'
               WHEN kind = 'pdf' THEN 'scanned_pdf' WHEN kind = 'pptx' THEN 'slides'
               WHEN kind = 'image' THEN 'image' END AS route
          FROM c_typed t LEFT JOIN (SELECT doc_id * 5 AS doc_id, text FROM documents) q USING (doc_id)
          LEFT JOIN c_page_facts p USING (doc_id) LEFT JOIN c_slide_counts USING (doc_id))""",
}

CTES["c_failing"] = """SELECT doc_id, file,
      CASE WHEN stage = 'worker' THEN 'tesseract' WHEN stage = 'convert' AND route <> 'quick' THEN 'none' ELSE engine END AS engine,
      CASE WHEN stage IN ('worker', 'count') OR stage = 'convert' AND route <> 'quick' THEN 0 ELSE pages END AS pages,
      CASE WHEN stage = 'worker' THEN failure WHEN kind IS NULL THEN status
           WHEN stage IN ('count', 'write') OR stage = 'convert' AND route <> 'quick' THEN failure ELSE 'ok' END AS status,
      CASE WHEN stage = 'worker' THEN failure WHEN kind IS NULL THEN status
           WHEN route <> 'quick' THEN 'error: Motor OCR no soportado: '
             || '"it''s". Opciones: [''paddle'', ''surya'', ''tesseract'']'
           WHEN stage IN ('count', 'write') THEN failure ELSE 'ok' END AS status_unknown_engine
    FROM (SELECT *, 'error: stopped at ' || doc_id AS failure,
            CASE WHEN doc_id % 7 = 3 THEN ['convert', 'write', 'count', 'worker', 'convert'][doc_id % 5 + 1] END AS stage
          FROM c_docs)"""

# --- block rows -----------------------------------------------------------------------


def _block(section: int, md: str, source: str, keys: str = NO_KEYS) -> str:
    return f"SELECT doc_id, page_no, {section} AS section, {keys}, {md} AS md FROM {source}"


def heading(template: str) -> str:
    return padded(f"'## {template} ' || (page_no + 1)")


def page_warning(text: str) -> str:
    before, after = text.split("{n}")
    return padded(f"'> ⚠️ {before}' || (page_no + 1) || '{after}'")


NOT_RASTERIZED = page_warning("Página {n}: no pudo rasterizarse. Contenido omitido.")
OCR_FAILED = page_warning("Página {n}: no pudo procesarse (error OCR). Contenido omitido.")
OCR_EMPTY = page_warning("Página {n}: OCR no produjo resultado.")
PARTIAL = page_warning("Página {n}: error parcial al extraer bloques.")
SLIDE_FAILED = page_warning("Diapositiva {n}: error al procesar.")

SCANNED_MD = f"""CASE WHEN NOT rasterized THEN {NOT_RASTERIZED}
    WHEN ocr_error IS NOT NULL THEN {OCR_FAILED}
    WHEN NOT {inked("coalesce(ocr_text, '')")} THEN {OCR_EMPTY} ELSE ocr_text END"""
IMAGE_MD = f"""CASE WHEN ocr_error IS NOT NULL
    THEN {padded("'> ⚠️ Error al aplicar OCR: ' || ocr_error")}
    WHEN NOT {inked("coalesce(ocr_text, '')")}
    THEN {padded("'> ⚠️ OCR no produjo resultado para ' || file || '.'")} ELSE ocr_text END"""
K3 = "0::DOUBLE AS k1, 0::DOUBLE AS k2, {} AS k3, 0::BIGINT AS k4"
SHAPE_KEYS = """coalesce(top, 0)::DOUBLE AS k1, coalesce(left_, 0)::DOUBLE AS k2,
    shape_no AS k3, pos::BIGINT AS k4"""
SLIDE_TABLE = f"""list_transform(rows, lambda r: list_transform(r, lambda c:
    replace({strip("c")}, {NL}, ' ')))"""


def but_failed(pages: str, failed: str) -> str:
    """What was read last on a page is missing if the page failed."""
    return f"ANTI JOIN (SELECT doc_id, page_no FROM {pages} WHERE {failed}) f USING (doc_id, page_no)"


def text_pdf_blocks(pages: str, blocks: str, tables: str, images: str) -> str:
    return " UNION ALL ".join(
        [
            _block(0, heading("Página"), pages),
            _block(
                1, "text", blocks, f"{BAND} AS k1, x0 AS k2, block_no AS k3, 0::BIGINT AS k4"
            ),
            _block(
                2, table_md("rows", "width"), f"{tables} {but_failed(pages, 'block_error')}", K3.format("table_no::BIGINT")
            ),
            _block(4, PARTIAL, f"{pages} WHERE block_error"),
            _block(5, padded(link("'Figura'", "image_name")), images, K3.format("image_no")),
        ]
    )


def scanned_blocks(pages: str, images: str) -> str:
    return " UNION ALL ".join(
        [
            _block(0, heading("Página"), pages),
            _block(1, SCANNED_MD, pages),
            _block(5, padded(link("'Página ' || (page_no + 1)", "image_name")), images),
        ]
    )


def shape_blocks(shapes: str, lines: str) -> str:
    """``shapes`` has image_name where an image was saved."""
    good = "error IS NULL AND kind = '{}'"
    picture = f"(SELECT *, 0 AS pos FROM {shapes} WHERE {good.format('PICTURE')} AND decoded)"
    ocr = f"""(SELECT * REPLACE (CASE WHEN image_name IS NULL THEN 0 ELSE 1 END AS pos)
        FROM {picture} WHERE ocr_error IS NULL AND {inked("ocr_text")})"""
    table = f"(SELECT *, 0 AS pos FROM {shapes} WHERE {good.format('TABLE')})"
    return " UNION ALL ".join(
        [
            _block(1, "md", f"{lines} WHERE {good.format('TEXT')}", SHAPE_KEYS),
            _block(1, table_md(SLIDE_TABLE, "len(rows[1])"), table, SHAPE_KEYS),
            _block(
                1,
                padded(link("'Figura'", "image_name")),
                f"{picture} WHERE image_name IS NOT NULL",
                SHAPE_KEYS,
            ),
            _block(1, "ocr_text", ocr, SHAPE_KEYS),
        ]
    )


def slide_blocks(slides: str, shapes: str, lines: str, notes: str) -> str:
    return " UNION ALL ".join(
        [
            _block(0, heading("Diapositiva"), slides),
            shape_blocks(shapes, lines),
            _block(
                3,
                padded(f"'> **Notas:** ' || {strip('text')}"),
                f"{notes} {but_failed(slides, 'error IS NOT NULL')} WHERE {inked('text')}",
            ),
            _block(4, SLIDE_FAILED, f"{slides} WHERE error IS NOT NULL"),
        ]
    )


def image_blocks(pages: str) -> str:
    name = image_name(sanitized(stem_of("file")), "1")
    return " UNION ALL ".join(
        [
            _block(1, IMAGE_MD, pages),
            _block(5, padded(link(stem_of("file"), name)), f"{pages} WHERE image_saved"),
        ]
    )


def of(table: str, route: str) -> str:
    """Rows of the documents that take a route."""
    return f"(SELECT * FROM {table} SEMI JOIN (SELECT doc_id FROM c_docs WHERE route = '{route}') r USING (doc_id))"


CTES |= {
    "scan_images": f"""SELECT doc_id, page_no, {image_name("'Scan'", "image_number")} AS image_name
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS image_number
              FROM doc_pages WHERE rasterized AND ocr_error IS NULL) WHERE image_saved""",
    "scan_blocks": scanned_blocks("doc_pages", "scan_images"),
    "deck_shapes": f"""SELECT *, CASE WHEN saved THEN {image_name("'Deck'", "shape_no")} END
        AS image_name FROM shapes""",
    # --- corpus blocks, by route ------------------------------------------------------
    "c_prefix": f"""SELECT doc_id, kind, route, file, {sanitized(stem_of("file"))} AS prefix FROM c_docs""",
    "c_blocks": f"""SELECT doc_id * 5 + 1 AS doc_id, page_no, block_no, x0, y0, text FROM kept_blocks
        UNION ALL SELECT doc_id * 5, 0, 0, 0, 0, {strip("text")} FROM documents
        WHERE doc_id % 8 < 2 AND doc_id % 3 = 0 AND {inked("text")}""",
    "c_tables": "SELECT * REPLACE (doc_id * 5 + 1 AS doc_id) FROM page_tables",
    "c_refs": """SELECT * REPLACE (doc_id * 5 AS doc_id) FROM image_refs
        UNION ALL SELECT * REPLACE (doc_id * 5 + 1 AS doc_id) FROM image_refs""",
    "c_images": f"""SELECT *, {image_name("prefix", "image_number")} AS image_name
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, image_no)
              AS image_number FROM c_refs WHERE decoded) JOIN c_prefix USING (doc_id) WHERE saved""",
    "c_scan_images": f"""SELECT doc_id, page_no, {image_name("prefix", "image_number")} AS image_name
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS image_number
              FROM c_pages WHERE rasterized AND ocr_error IS NULL)
        JOIN c_prefix USING (doc_id) WHERE image_saved""",
    "c_shapes": f"""SELECT s.*, CASE WHEN saved AND image_number IS NOT NULL THEN
          {image_name("prefix", "image_number")} END AS image_name
        FROM (SELECT * REPLACE (doc_id * 5 + 3 AS doc_id) FROM shapes) s
        JOIN c_prefix USING (doc_id)
        LEFT JOIN (SELECT doc_id * 5 + 3 AS doc_id, shape_no, row_number() OVER (PARTITION BY doc_id
              ORDER BY page_no, coalesce(top, 0), coalesce(left_, 0), shape_no) AS image_number
            FROM shapes WHERE kind = 'PICTURE' AND error IS NULL AND decoded) USING (doc_id, shape_no)""",
    "c_lines": "SELECT * REPLACE (doc_id * 5 + 3 AS doc_id) FROM paragraph_lines",
    "c_notes": """SELECT doc_id * 5 + 3 AS doc_id, page_no, text FROM notes
        UNION ALL SELECT doc_id * 5, 0, text FROM documents WHERE doc_id % 8 IN (2, 3)""",
    "c_photos": """SELECT p.*, file FROM c_pages p JOIN c_prefix USING (doc_id) WHERE route = 'image'""",
    # decks have no quick text here, so only PDFs get an image section
    "c_figures": f"""SELECT doc_id, string_agg({link("'Figura ' || figure", "image_name")}, {NL}
          ORDER BY figure) AS links
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY image_number) AS figure
              FROM c_images WHERE route = 'quick' AND kind = 'pdf') GROUP BY doc_id""",
    "c_quick": f"""SELECT doc_id, 'quick' AS route, clean_text AS body FROM (
        SELECT doc_id, {clean(f"text || CASE WHEN links IS NULL THEN '' ELSE {NL} || {NL} || {NL}"
          f" || '## Imágenes extraídas' || {NL} || {NL} || links || {NL} END")} AS clean_text
        FROM (SELECT doc_id * 5 AS doc_id, text FROM documents WHERE {sufficient("text")})
        LEFT JOIN c_figures USING (doc_id))""",
    "c_all_blocks": " UNION ALL ".join(
        f"SELECT '{name}' AS route, * FROM ({rows})"
        for name, rows in {
            "text_pdf": text_pdf_blocks(*(of(table, "text_pdf") for table in ("c_pages", "c_blocks", "c_tables", "c_images"))),
            "scanned_pdf": scanned_blocks(of("c_pages", "scanned_pdf"), of("c_scan_images", "scanned_pdf")),
            "slides": slide_blocks(*(of(table, "slides") for table in ("c_slides", "c_shapes", "c_lines", "c_notes"))),
            "image": image_blocks("c_photos"),
        }.items()
    ),
    "c_bodies": f"""SELECT doc_id, route, {clean("joined")} AS body FROM (
          SELECT doc_id, route, {joined("md", ORDER, f"{NL} || {NL}")} AS joined
          FROM c_all_blocks WHERE {inked("md")} GROUP BY doc_id, route)
        UNION ALL SELECT * FROM c_quick""",
    "c_documents": f"""SELECT doc_id, route, pages, engine, output,
        {front_matter("file", "pages", "engine", "route = 'quick'")} || {NL} || {NL}
        || coalesce(body, '') || {NL} AS markdown
        FROM (SELECT * REPLACE (replace(engine, 'tesseract', 'paddle') AS engine) FROM c_docs) LEFT JOIN c_bodies USING (doc_id, route) WHERE status = 'ok'""",
}

# --- the same of the given documents alone -------------------------------------------------

FIRST_SPACE = ("c_files", "c_pages", "c_slides", "c_blocks", "c_tables", "c_refs", "c_shapes", "c_lines", "c_notes")
CTES |= {
    re.sub("^c_", "d_", name): re.sub(r"\bc_", "d_", f"SELECT * FROM ({sql}) WHERE doc_id % 5 = 0" if name in FIRST_SPACE else sql)
    for name, sql in CTES.items()
    if name.startswith("c_")
}

# --- queries ----------------------------------------------------------------------------

BLOCK = f"doc_id, {ORDER}, md"
IMG = image_name(sanitized(stem_of("file")), "1")
LANGUAGES = """list_filter(list_transform(string_split(
    ' ' || upper(lang) || ' ,, ' || lang || ',JPN,' || source, ','), lambda x: trim(x)),
    lambda x: x <> '')"""
CODES = """CASE lower(x) WHEN 'es' THEN 'spa' WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra'
    WHEN 'de' THEN 'deu' WHEN 'it' THEN 'ita' WHEN 'pt' THEN 'por' WHEN 'ca' THEN 'cat'
    WHEN 'nl' THEN 'nld' ELSE x END"""
LISTED = "('.pdf', '.pptx', '.ppt', '.png', '.jpg', '.jpeg', '.webp', '.tiff', '.tif', '.bmp', '.gif')"
CORPUS_FILE = f"""SELECT file, {kind_of("file")} AS kind, strlen(text) AS length
    FROM named JOIN documents USING (doc_id)"""

SQL = {
    "scan_corpus": f"{CORPUS_FILE} WHERE {suffix_of('file')} IN {LISTED}",
    "scan_one": f"{CORPUS_FILE} WHERE doc_id = (SELECT arg_max(doc_id, path) FROM files)",
    "distinct_sorted_paths": """SELECT DISTINCT event_type || '/User ' || user_id || '.pdf' AS path
        FROM events ORDER BY string_split(path, '/')""",
    "write_documents": """SELECT string_split(output, '/')[-1] AS file, markdown FROM d_documents""",
    "run_report": """SELECT file, pages, engine, status,
        CASE WHEN status = 'ok' THEN output ELSE '—' END AS output FROM c_docs""",
    "file_type": f"""SELECT doc_id, {stem_of("file")} AS stem, {suffix_of("file")} AS suffix,
        {kind_of("file")} AS kind FROM named""",
    "sanitize_name": f"""SELECT page_id, {sanitized("(' .' || url || '. ')")} AS name FROM pages""",
    "output_path": f"SELECT doc_id, {output_of('file')} AS output FROM named",
    "image_name": f"""SELECT doc_id, {image_name(sanitized(stem_of("file")), "doc_id * 37")}
        AS image_name, 'image_' || printf('%03d', doc_id) || '.png' AS bare_name FROM named""",
    "image_ref_md": f"""SELECT doc_id, {link("'Figura'", IMG)} AS figure_md,
        {link("'Figura ' || (doc_id + 1)", IMG)} AS numbered_md,
        {link("'Página ' || (doc_id + 1)", IMG)} AS page_md,
        {link(stem_of("file"), IMG)} AS stem_md FROM named""",
    "quick_sufficient": f"SELECT doc_id, {sufficient('text')} AS sufficient FROM documents",
    "has_embedded_text": """SELECT doc_id, has_text FROM c_page_facts
        WHERE doc_id IN (SELECT doc_id FROM c_pages WHERE page_no < 3)""",
    "first_pages": "SELECT doc_id, page_no, embedded_text, ocr_text FROM doc_pages WHERE page_no < 3",
    "text_blocks": "SELECT doc_id, page_no, block_no, text FROM kept_blocks",
    "drop_blank_blocks": f"SELECT doc_id, block_no, text FROM blocks WHERE {inked('text')}",
    "ocr_confident_lines": """SELECT doc_id, page_no, line_no, text FROM ocr_lines
        WHERE confidence > 0.5""",
    "nonblank_paragraphs": """SELECT doc_id, shape_no, pos::INT AS pos, level, text
        FROM frame_lines""",
    "paragraph_md": "SELECT doc_id, shape_no, pos::INT AS pos, md FROM paragraph_lines",
    "shape_dispatch": f"""SELECT {BLOCK} FROM ({shape_blocks("deck_shapes", "paragraph_lines")})""",
    "tier_route": "SELECT doc_id, kind, route FROM c_docs",
    "engine_label": """SELECT doc_id,
        CASE WHEN engine = 'tesseract' THEN 'paddle' ELSE engine END AS engine FROM c_docs""",
    "tier_fallback": f"""SELECT doc_id, block_no, text FROM blocks WHERE doc_id NOT IN
        (SELECT doc_id FROM documents WHERE {sufficient("text")})""",
    "attach_counts": """SELECT doc_id, kind, CASE WHEN kind = 'image' THEN 1 ELSE
        coalesce(p.pages, 0) + coalesce(slides, 0) END::INT AS pages FROM c_typed
        LEFT JOIN c_page_facts p USING (doc_id) LEFT JOIN c_slide_counts USING (doc_id)""",
    "page_count": "SELECT doc_id, count(*) AS pages FROM c_pages GROUP BY doc_id",
    "slide_count": "SELECT doc_id, count(*) AS slides FROM slides GROUP BY doc_id",
    "attach_image_section": f"""SELECT doc_id, 0::BIGINT AS part_no,
        {NL} || '## Imágenes extraídas' || {NL} || {NL} || links || {NL} AS image_section
        FROM (SELECT doc_id FROM documents) LEFT JOIN (
          SELECT doc_id, string_agg({link("'Figura ' || figure", image_name("'User'", "image_number"))},
            {NL} ORDER BY figure) AS links
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY image_number) AS figure
                FROM images) GROUP BY doc_id) USING (doc_id)""",
    "page_sections": _block(
        0,
        heading("Página"),
        "(SELECT doc_id, page_no FROM doc_pages UNION SELECT doc_id, page_no FROM blocks)",
    ),
    "nonempty_tables": "SELECT * EXCLUDE (rows) FROM found_tables",
    "table_extractor_fallback": "SELECT * EXCLUDE (rows) FROM page_tables",
    "table_md_padded": f"""SELECT doc_id, shape_no,
        {table_md("rows", "list_max(list_transform(rows, lambda r: len(r)))")} AS md FROM shapes""",
    "table_md_header_width": f"""SELECT doc_id, shape_no, {table_md(SLIDE_TABLE, "len(rows[1])")} AS md
        FROM shapes""",
    "table_rows_to_md": f"""SELECT doc_id, page_no, table_no, extractor, 0::BIGINT AS part_no,
        {table_md("rows", "width")} AS md FROM page_tables""",
    "number_images": "SELECT doc_id, page_no, image_no, image_number FROM images",
    "number_figures": f"""SELECT doc_id, image_no, image_number,
        row_number() OVER (PARTITION BY doc_id ORDER BY image_number) AS figure,
        {image_name("'User'", "image_number")} AS image_name FROM images""",
    "slide_images": """SELECT doc_id, page_no, shape_no, image_number FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, shape_no) AS image_number
        FROM shapes WHERE kind = 'PICTURE' AND decoded) WHERE saved""",
    "reading_order": f"""SELECT doc_id, page_no, block_no, {BAND} AS row_band, row_number() OVER
        (PARTITION BY doc_id, page_no ORDER BY {BAND}, x0, block_no) AS reading_pos FROM blocks""",
    "shape_order": """SELECT doc_id, page_no, shape_no, row_number() OVER (PARTITION BY doc_id, page_no
        ORDER BY coalesce(top, 0), coalesce(left_, 0), shape_no) AS shape_pos FROM shapes""",
    "pdf_page_blocks": text_pdf_blocks(
        "order_pages",
        "kept_blocks",
        "page_tables",
        f"(SELECT *, {image_name(chr(39) + 'Doc' + chr(39), 'image_number')} AS image_name FROM images)",
    ),
    "scanned_page_blocks": f"SELECT {BLOCK} FROM scan_blocks",
    "slide_blocks": slide_blocks("slides", "deck_shapes", "paragraph_lines", "notes"),
    "image_doc_blocks": image_blocks("image_pages"),
    "page_warnings": " UNION ALL ".join(
        [
            _block(
                1,
                SCANNED_MD,
                f"""doc_pages WHERE NOT rasterized OR ocr_error IS NOT NULL
                    OR NOT {inked("ocr_text")}""",
            ),
            _block(4, PARTIAL, "doc_pages WHERE block_error"),
        ]
    ),
    "doc_warnings": " UNION ALL ".join(
        [
            _block(
                1, IMAGE_MD, f"image_pages WHERE ocr_error IS NOT NULL OR NOT {inked('ocr_text')}"
            ),
            _block(4, SLIDE_FAILED, "slides WHERE error IS NOT NULL"),
        ]
    ),
    "join_ocr_lines": f"""SELECT doc_id, page_no, 0::BIGINT AS part_no,
        coalesce({joined("CASE WHEN confidence > 0.5 THEN text END", "line_no", NL)}, '') AS text
        FROM ocr_lines GROUP BY doc_id, page_no""",
    "assemble_body": f"""SELECT doc_id, 0::BIGINT AS part_no,
        {joined("md", ORDER, f"{NL} || {NL}")} AS body
        FROM scan_blocks WHERE {inked("md")} GROUP BY doc_id""",
    "file_status": """SELECT doc_id, file, engine, pages, status, status_unknown_engine FROM c_failing""",
    "run_figures": """SELECT count(*) AS files, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed,
        sum(pages)::BIGINT AS pages, count(*) FILTER (engine = 'markitdown') AS quick FROM c_failing""",
    "unreadable_ok": """SELECT doc_id, kind, pages, engine, status, 0::BIGINT AS part_no, markdown
        FROM unreadable""",
    "output_collisions": """SELECT 'output/User ' || user_id || '.md' AS output,
        count(DISTINCT event_type) AS n_files FROM events
        GROUP BY user_id HAVING count(DISTINCT event_type) > 1""",
    "remove_control": f"SELECT doc_id, {control('text')} AS text FROM dirty",
    "normalize_headers": f"SELECT doc_id, {headers('text')} AS text FROM dirty",
    "normalize_lists": f"SELECT doc_id, {lists('text')} AS text FROM dirty",
    "collapse_spaces": f"SELECT doc_id, {spaces('text')} AS text FROM dirty",
    "limit_blank_lines": f"SELECT doc_id, {breaks('text')} AS text FROM dirty",
    "clean_markdown": f"SELECT doc_id, {clean('text')} AS text FROM dirty",
    "parse_languages": f"""SELECT doc_id, len({LANGUAGES})::INT AS n,
        array_to_string({LANGUAGES}, '|') AS languages, 'es|en' AS "default" FROM documents""",
    "ocr_language_codes": f"""SELECT doc_id, array_to_string(list_transform({LANGUAGES},
        lambda x: {CODES}), '+') AS codes FROM documents""",
    "front_matter": f"""SELECT doc_id, {front_matter("file", "doc_id % 10",
          "CASE WHEN used THEN 'markitdown' ELSE 'tesseract' END", "used")} AS header
        FROM (SELECT doc_id, file, {sufficient("text")} AS used
              FROM named JOIN documents USING (doc_id))""",
    "format_document": f"""SELECT doc_id, 0::BIGINT AS part_no,
        {front_matter("('Scan ' || doc_id || '.pdf')", "pages", "'tesseract'", "false")}
        || {NL} || {NL} || {clean("joined")} || {NL} AS markdown
        FROM (SELECT doc_id, {joined("md", ORDER, f"{NL} || {NL}")} AS joined FROM scan_blocks
              WHERE {inked("md")} AND section <> 5 GROUP BY doc_id)
        JOIN (SELECT doc_id, count(*) AS pages FROM doc_pages GROUP BY doc_id) USING (doc_id)""",
    "convert_corpus": """SELECT doc_id, route, pages, engine, output, 0::BIGINT AS part_no, markdown
        FROM c_documents""",
    "convert_stored": """SELECT doc_id, route, pages, engine, output, 0::BIGINT AS part_no, markdown
        FROM c_documents""",
}



def _used(sql: str) -> set[str]:
    """Names of the common tables that a query needs, also through others."""
    found = {name for name in CTES if re.search(rf"\b{name}\b", sql)}
    return found.union(*(_used(CTES[name]) for name in found if CTES[name] != sql))


def oracles() -> dict[str, str]:
    """Each query with just the tables it needs; those that several others read are made once."""
    whole = {}
    for name, sql in SQL.items():
        used = _used(sql)
        parts = ",\n".join(
            f"{t} AS {'MATERIALIZED ' if t[1:] in ('_docs', '_pages', '_images') else ''}({CTES[t]})" for t in CTES if t in used
        )
        whole[name] = f"WITH {parts}\n{sql}" if parts else sql
    return whole
