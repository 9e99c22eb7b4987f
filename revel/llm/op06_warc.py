"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response record gives two records that name it in ``WARC-Refers-To`` and
each other in ``WARC-Concurrent-To``:

* ``metadata`` (``application/warc-fields``): the source's digests, status,
  every HTTP header, the page's title, language and outgoing links;
* ``conversion`` (``text/plain``): the text of the page.

Both keep the target URI and the date and carry digests of their own block.
Record ids are name-based (from the response's id), so a task that runs again
writes the same records.  Everything is a projection: no shuffle.

Defined results: null html is an empty payload; a response without target URI
or date gets records without these headers; a null key is an empty name, and
rows with equal key and URI get equal record ids; payloads are taken as UTF-8;
an empty table gives no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Named character references (fixed values).
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "trade": "™", "middot": "·",
            "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
            "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "times": "×", "deg": "°", "amp": "&"}
#: Patterns read alike by Java's and RE2's regular expressions.
UNSEEN = r"(?is)<head\b.*?</head[ \t\r\n]*>|<script\b.*?</script[ \t\r\n]*>|<style\b.*?</style[ \t\r\n]*>|<!--.*?-->"
BREAK = (r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|nav|header|footer|main|aside|blockquote|pre|form|body|html)"
         r"\b[^>]*>")
TAG = r"(?s)<[!/a-zA-Z][^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANGUAGE = r'(?is)<html[^>]*[ \t\r\n]lang="([^"]*)"'
LINK = r'(?is)<a[ \t\r\n][^>]*?href="([^"]*)"'


def _uuid(name: Column) -> Column:
    h = F.md5(name.cast("binary"))
    part = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)),
            F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame, date: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of fetched pages: ``key, record_id, target_uri, date,
    http_headers, payload, block_digest, payload_digest``."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                       F.octet_length(payload).cast("string"), F.lit(CRLF + CRLF))
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(key_col), _uuid(F.concat(F.lit("response|"), key, F.lit("|"), F.coalesce(F.col(url_col), F.lit("")))).alias("record_id"),
                        F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"))
    return rows.withColumns({"block_digest": _digest(F.concat("http_headers", "payload")), "payload_digest": _digest(F.col("payload"))})


def untagged(html: Column) -> Column:
    """A page without head, scripts, comments and tags; block tags end lines."""
    t = F.regexp_replace(html, UNSEEN, "")
    t = F.regexp_replace(t, BREAK, "\n")
    return F.regexp_replace(t, TAG, "")


def plain_text(untagged_col: str) -> Column:
    """The text of a page from a staged column of :func:`untagged`: references resolved, white space collapsed.
    The column is read more than once, which must be a field read, not a recomputation."""
    t = F.col(untagged_col)
    # numeric references: what follows each "&#"
    def char(code: Column) -> Column:
        ok = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("�"))

    def numeric(piece: Column, i: Column) -> Column:
        ten, hexa = F.regexp_extract(piece, r"^([0-9]{1,7});", 1), F.regexp_extract(piece, r"^[xX]([0-9a-fA-F]{1,6});", 1)
        after = F.regexp_replace(piece, r"^[^;]*;", "")
        return (F.when(i == 0, piece).when(ten != "", F.concat(char(ten.cast("long")), after))
                .when(hexa != "", F.concat(char(F.conv(hexa, 16, 10).cast("long")), after)).otherwise(F.concat(F.lit("&#"), piece)))

    # named references: what follows each "&"; none of the characters begins another reference, but that of ``amp`` is not read again
    chars = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def named(piece: Column, i: Column) -> Column:
        name = F.substring_index(piece, ";", 1)
        known = F.when(F.contains(piece, F.lit(";")), F.try_element_at(chars, name))
        return F.when(i == 0, piece).otherwise(F.coalesce(F.concat(known, F.substring(piece, F.length(name) + 2, F.length(piece))),
                                                          F.concat(F.lit("&"), piece)))

    resolved = F.when(F.contains(t, F.lit("&#")), F.array_join(F.transform(F.split(t, "&#", -1), numeric), "")).otherwise(t)
    t = F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(resolved, "&", -1), named), "")).otherwise(t)
    # a lone blank stays as it is
    t = F.regexp_replace(t, "[\\t\\r\\f][ \\t\\r\\f]*| [ \\t\\r\\f]+", " ")
    return F.btrim(F.regexp_replace(t, " ?\\n[ \\n]*", "\n"), F.lit(" \n"))


def derive(records: DataFrame, key_col: str = "page_id") -> DataFrame:
    """Two records for each response: ``key, warc_type, record_id, refers_to, concurrent_to,
    target_uri, date, content_type, content_length, block_digest, source_payload_digest, block``."""
    ids = {t: _uuid(F.concat(F.lit(f"{t}|"), F.col("record_id"))) for t in ("metadata", "conversion")}
    lines = F.filter(F.split("http_headers", CRLF), lambda x: x != "")
    status = F.regexp_extract(F.get(lines, F.lit(0)), r"^[^ ]+ ([0-9]+)", 1)
    links = F.expr(f"regexp_extract_all(payload, r'{LINK}', 1)")
    title = F.btrim(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), "[ \\t\\r\\n]+", " "))
    fields = F.concat(
        F.array(F.concat(F.lit("source-block-digest: "), F.col("block_digest")), F.concat(F.lit("source-payload-digest: "), F.col("payload_digest")),
                F.concat(F.lit("http-status: "), status)),
        F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("http-header: "), x)),
        F.array(F.concat(F.lit("title: "), title), F.concat(F.lit("language: "), F.regexp_extract("payload", LANGUAGE, 1))),
        F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, "[\\r\\n]+", " "))))
    kinds = {"metadata": ("conversion", "application/warc-fields", F.concat(F.array_join(fields, CRLF), F.lit(CRLF))),
             "conversion": ("metadata", "text/plain; charset=utf-8", plain_text("_untagged"))}
    both = F.array(*[F.struct(F.lit(t).alias("warc_type"), ids[t].alias("record_id"), ids[other].alias("concurrent_to"),
                              F.lit(content).alias("content_type"), block.alias("block")) for t, (other, content, block) in kinds.items()])
    staged = records.withColumn("_untagged", untagged(F.col("payload")))
    rows = staged.select(F.col(key_col), F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("payload_digest").alias("source_payload_digest"),
                         F.explode(both).alias("r"))
    return rows.select(key_col, "r.warc_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "date", "r.content_type",
                       F.octet_length("r.block").cast("long").alias("content_length"), _digest(F.col("r.block")).alias("block_digest"),
                       "source_payload_digest", "r.block")


def serialized(records: DataFrame) -> Column:
    """The WARC/1.1 text of a record of :func:`derive`; a null header is left out."""
    named = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"),
             ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"),
             ("Content-Length", "content_length")]
    head = [F.concat(F.lit(f"{n}: "), records[c].cast("string")) for n, c in named]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *head), F.lit(CRLF + CRLF), F.col("block"), F.lit(CRLF + CRLF))


def _sql_text(html: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = html
    for pattern, to in ((UNSEEN, "''"), (BREAK, "chr(10)"), (TAG, "''")):
        t = f"regexp_replace({t}, {q(pattern)}, {to}, 'g')"
    code = ("CASE WHEN c > 0 AND c < 1114112 AND NOT c BETWEEN 55296 AND 57343 THEN chr(CAST(c AS INTEGER)) ELSE chr(65533) END")
    piece = f"""CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^[0-9]{{1,7}};') THEN
      list_transform([CAST(regexp_extract(p, '^([0-9]+);', 1) AS BIGINT)], lambda c: {code})[1] || regexp_replace(p, '^[^;]*;', '')
      WHEN regexp_matches(p, '^[xX][0-9a-fA-F]{{1,6}};') THEN
      list_transform([CAST('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]+);', 1) AS BIGINT)], lambda c: {code})[1] || regexp_replace(p, '^[^;]*;', '')
      ELSE '&#' || p END"""
    t = f"array_to_string(list_transform(string_split({t}, '&#'), lambda p, i: {piece}), '')"
    for name, char in ENTITIES.items():
        t = f"replace({t}, '&{name};', {q(char)})"
    t = f"regexp_replace({t}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"trim(regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


def oracle_sql(date: str) -> str:
    crlf = "chr(13) || chr(10)"

    def uuid(name: str) -> str:
        h = f"md5({name})"
        return (f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-3' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3)"
                f" || '-' || substr({h}, 21, 12) || '>'")

    def header(name: str, value: str) -> str:
        return f"coalesce('{name}: ' || {value} || {crlf}, '')"

    names = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"),
             ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"),
             ("Content-Length", "content_length")]
    return f"""
WITH r AS (
  SELECT page_id, url, coalesce(html, '') AS payload, {uuid("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')")} AS refers_to,
         'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) || {crlf} || {crlf} AS head
  FROM pages),
k AS (
  SELECT *, {uuid("'metadata|' || refers_to")} AS meta_id, {uuid("'conversion|' || refers_to")} AS conv_id, 'sha256:' || sha256(payload) AS source_payload_digest,
         'sha256:' || sha256(head || payload) AS source_block_digest FROM r),
d AS (
  SELECT page_id, 'metadata' AS warc_type, meta_id AS record_id, refers_to, conv_id AS concurrent_to, url AS target_uri, source_payload_digest,
         'application/warc-fields' AS content_type,
         'source-block-digest: ' || source_block_digest || {crlf} || 'source-payload-digest: ' || source_payload_digest || {crlf} || 'http-status: 200' || {crlf}
         || 'http-header: Content-Type: text/html; charset=utf-8' || {crlf} || 'http-header: Content-Length: ' || strlen(payload) || {crlf}
         || 'title: ' || trim(regexp_replace(regexp_extract(payload, '{TITLE}', 1), '[ \\t\\r\\n]+', ' ', 'g')) || {crlf}
         || 'language: ' || regexp_extract(payload, '{LANGUAGE}', 1) || {crlf}
         || array_to_string(list_transform(regexp_extract_all(payload, '{LINK}', 1), lambda x: 'outlink: ' || regexp_replace(x, '[\\r\\n]+', ' ', 'g') || {crlf}), '') AS block
  FROM k UNION ALL
  SELECT page_id, 'conversion', conv_id, refers_to, meta_id, url, source_payload_digest, 'text/plain; charset=utf-8', {_sql_text("payload")} FROM k),
e AS (SELECT *, '{date}' AS date, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM d)
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, date, content_type, content_length, block_digest, source_payload_digest,
       'WARC/1.1' || {crlf} || {" || ".join(header(n, f"CAST({c} AS VARCHAR)") for n, c in names)} || {crlf} || block || {crlf} || {crlf} AS record
FROM e
"""
