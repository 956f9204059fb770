"""Derived web-archive records: from each response a metadata and a plain-text conversion record.

Both refer to the response by its record id and keep its target, date, headers and digest. All work is DataFrame functions; a record
is built from its own response, so nothing is shuffled.
"""

from pyspark.sql import Column, DataFrame, functions as F

# Record fields and media types of the format, block elements of HTML, named entities.
VERSION = "WARC/1.1"
METADATA, CONVERSION = "metadata", "conversion"
FIELDS_TYPE, TEXT_TYPE = "application/warc-fields", "text/plain; charset=UTF-8"
BLOCKS = ("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li "
          "main nav ol p pre section table td th tr ul").split()
HIDDEN = ("script", "style", "title", "noscript", "template")
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·",
    "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«",
    "raquo": "»", "euro": "€", "pound": "£", "sect": "§", "deg": "°", "times": "×",
}
DATE = "1970-01-01T00:00:00Z"

SKIPPED = r"(?is)<!--.*?(?:-->|\z)" + "".join(rf"|<{tag}\b.*?(?:</{tag}[^>]*>|\z)" for tag in HIDDEN)
BLOCK_TAG = rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>"
ANY_TAG = r"<[!/?a-zA-Z][^>]*>"
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANGUAGE = r"""(?i)<html[^>]*?\blang[ ]*=[ ]*["']([A-Za-z0-9-]*)["']"""
LINK = r"""(?i)<a\b[^>]*?\bhref[ ]*=[ ]*["']([^"'>]*)["']"""


def unescape(pieces: Column) -> Column:
    """Text with its character references as characters, from the text's pieces between ampersands.

    Unknown names stay, code points that are no characters become U+FFFD. ``pieces`` should be a column that is
    computed already, as it is used several times.
    """
    names = F.create_map(*[F.lit(x) for item in ENTITIES.items() for x in item])

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
        point = F.when(name.startswith("#"), digits.cast("bigint"))
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        value = F.when(point.isNotNull(), F.when(valid, letter).otherwise(F.lit("�"))).otherwise(F.element_at(names, name))
        rest = F.substr(piece, F.length(name) + 2)
        return F.when((name != "") & value.isNotNull(), F.concat(value, rest)).otherwise(F.concat(F.lit("&"), piece))

    return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), ""))


def _collapsed(text: Column) -> Column:
    spaced = F.regexp_replace(text, "[ \\t\\r\\f\\x0B ]+", " ")
    return F.trim(F.regexp_replace(spaced, " ?\\n[ \\n]*", "\n"), F.lit(" \n"))


def visible(html: Column) -> Column:
    """Text with its references still encoded: comments and hidden elements dropped, block elements as line breaks."""
    seen = F.regexp_replace(html, SKIPPED, " ")
    return F.regexp_replace(F.regexp_replace(seen, BLOCK_TAG, "\n"), ANY_TAG, "")


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _uuid(*parts: Column) -> Column:
    """A record id that depends on the parts alone, so a repeated run names its records alike."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """CRLF-ended ``name: value`` lines; a null value gives no line."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields])


def responses_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Crawled pages as responses: page_id, record_id, target_uri, date, headers, payload. Pages carry no date or headers of their own."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    headers = F.array(F.lit("Content-Type: text/html; charset=UTF-8"), F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")))
    return pages.select(
        F.col(id_col).alias("page_id"), _uuid(F.lit("response"), key, F.coalesce(url_col, F.lit(""))).alias("record_id"),
        F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), payload.alias("payload"))


def derive(responses: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two rows per response: page_id, warc_type, record_id, refers_to, source_digest, block_digest, header, block.

    ``responses`` has record_id, target_uri, date, headers (array of lines) and payload beside its key. A null payload counts as
    empty and gives records with an empty text; a null target or date gives no header line. Repeated rows give equal
    records. Each header ends with an empty line; ``header || block || CRLF CRLF`` is the record as stored in a file.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    title = _collapsed(unescape(F.col("title_pieces")))
    links = F.array_join(F.transform(F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)),
                                     lambda x: F.concat(F.lit("outlink: "), F.replace(x, F.lit("&amp;"), F.lit("&")), F.lit("\r\n"))), "")
    kept = F.array_join(F.transform("headers", lambda x: F.concat(F.lit("source-header: "), x, F.lit("\r\n"))), "")
    told = F.concat(_lines(("title", F.replace(title, F.lit("\n"), F.lit(" "))), ("language", F.regexp_extract("payload", LANGUAGE, 1)), ("source-digest", F.col("source_digest"))),
                    F.coalesce(kept, F.lit("")), links)
    base = responses.select(F.col(id_col).alias("page_id"), "record_id", "target_uri", "date", "headers", payload.alias("payload"), _digest(payload).alias("source_digest"))
    base = base.select("*", F.split(visible(F.col("payload")), "&", -1).alias("text_pieces"), F.split(F.regexp_extract("payload", TITLE, 1), "&", -1).alias("title_pieces"))
    blocks = base.select("page_id", "record_id", "target_uri", "date", "source_digest", F.explode(F.array(
        F.struct(F.lit(METADATA).alias("warc_type"), F.lit(FIELDS_TYPE).alias("content_type"), told.alias("block")),
        F.struct(F.lit(CONVERSION).alias("warc_type"), F.lit(TEXT_TYPE).alias("content_type"), _collapsed(unescape(F.col("text_pieces"))).alias("block")),
    )).alias("r")).select("*", "r.*").drop("r")
    made = blocks.select("*", _uuid(F.col("warc_type"), F.col("record_id")).alias("new_id"), _digest(F.col("block")).alias("block_digest"))
    header = F.concat(F.lit(f"{VERSION}\r\n"), _lines(
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("new_id")), ("WARC-Refers-To", F.col("record_id")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Refers-To-Target-URI", F.col("target_uri")),
        ("WARC-Refers-To-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("content_type")),
        ("Content-Length", F.octet_length("block").cast("string"))), F.lit("\r\n"))
    return made.select("page_id", "warc_type", F.col("new_id").alias("record_id"), F.col("record_id").alias("refers_to"), "source_digest", "block_digest",
                       header.alias("header"), "block")


def write_records(records: DataFrame, path: str, codec: str = "gzip") -> None:
    """The records as files of a folder, each a sequence of whole records."""
    text = F.concat("header", "block")
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", codec).text(path)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _unescape_sql(x: str) -> str:
    names = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in ENTITIES.items()) + "}"
    name = f"regexp_extract(p, {_quoted(REFERENCE)}, 1)"
    point = f"CASE WHEN regexp_matches({name}, '^#[xX]') THEN CAST('0x' || substr({name}, 3) AS BIGINT) WHEN starts_with({name}, '#') THEN CAST(substr({name}, 2) AS BIGINT) END"
    letter = f"CASE WHEN ({point}) BETWEEN 1 AND 55295 OR ({point}) BETWEEN 57344 AND 1114111 THEN chr(CAST(({point}) AS INTEGER)) ELSE chr(65533) END"
    value = f"CASE WHEN starts_with({name}, '#') THEN {letter} ELSE ({names})[{name}] END"
    one = f"CASE WHEN {name} <> '' AND ({value}) IS NOT NULL THEN ({value}) || substr(p, length({name}) + 2) ELSE '&' || p END"
    return f"(string_split({x}, '&')[1] || array_to_string(list_transform(string_split({x}, '&')[2:], lambda p: {one}), ''))"


def _collapsed_sql(x: str) -> str:
    spaced = f"regexp_replace({x}, '[ \\t\\r\\f\\x0B ]+', ' ', 'g')"
    return f"trim(regexp_replace({spaced}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


def _uuid_sql(text: str) -> str:
    h = f"md5({text})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def oracle_sql() -> str:
    """DuckDB SQL for the records of table ``pages``."""
    crlf = "chr(13) || chr(10)"
    line = lambda name, value: f"coalesce('{name}: ' || {value} || {crlf}, '')"
    skipped = f"regexp_replace(payload, {_quoted(SKIPPED)}, ' ', 'g')"
    lines = f"regexp_replace({skipped}, {_quoted(BLOCK_TAG)}, chr(10), 'g')"
    text = f"regexp_replace({lines}, {_quoted(ANY_TAG)}, '', 'g')"
    title = f"regexp_extract(payload, {_quoted(TITLE)}, 1)"
    links = f"array_to_string(list_transform(regexp_extract_all(payload, {_quoted(LINK)}, 1), lambda x: 'outlink: ' || replace(x, '&amp;', '&') || {crlf}), '')"
    told = " || ".join([
        line("title", f"replace({_collapsed_sql(_unescape_sql('raw_title'))}, chr(10), ' ')"), line("language", f"regexp_extract(payload, {_quoted(LANGUAGE)}, 1)"),
        line("source-digest", "source_digest"), f"'source-header: Content-Type: text/html; charset=UTF-8' || {crlf}",
        f"'source-header: Content-Length: ' || strlen(payload) || {crlf}", links])
    header = f"'{VERSION}' || {crlf} || " + " || ".join([
        line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "url"),
        line("WARC-Date", f"'{DATE}'"), line("WARC-Refers-To-Target-URI", "url"), line("WARC-Refers-To-Date", f"'{DATE}'"),
        line("WARC-Block-Digest", "block_digest"), line("Content-Type", "content_type"), line("Content-Length", "CAST(strlen(block) AS VARCHAR)"), crlf])
    return f"""
WITH base AS (
  SELECT page_id, url, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS source_digest,
         {_uuid_sql("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')")} AS refers_to
  FROM pages
), parts AS (SELECT *, {text} AS raw_text, {title} AS raw_title FROM base),
made AS (
  SELECT page_id, url, refers_to, source_digest, '{METADATA}' AS warc_type, '{FIELDS_TYPE}' AS content_type, {told} AS block FROM parts
  UNION ALL
  SELECT page_id, url, refers_to, source_digest, '{CONVERSION}', '{TEXT_TYPE}', {_collapsed_sql(_unescape_sql('raw_text'))} FROM parts
), named AS (
  SELECT *, {_uuid_sql("warc_type || '|' || refers_to")} AS record_id, 'sha256:' || sha256(block) AS block_digest FROM made
)
SELECT page_id, warc_type, record_id, refers_to, source_digest, block_digest, {header} AS header, block FROM named"""
