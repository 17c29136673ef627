"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no entities, and what an entity looks like.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "shall", "can", "need", "dare", "ought", "used", "and", "but", "or", "nor", "for", "yet",
    "so", "if", "then", "than", "that", "this", "these", "those", "it", "its", "they", "them", "their", "we", "our", "you", "your",
    "i", "my", "he", "she", "his", "her", "which", "who", "whom", "where", "when", "how", "what", "why", "not", "no", "yes", "more",
    "less", "also", "both", "each", "few", "some", "such", "same", "other", "another", "there", "here", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "about", "with", "without", "through", "during", "before", "after", "above", "below",
    "between", "because", "while", "although", "however",
)
CAP_PHRASE = r"\b[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*){0,3}\b"
CAP_WORD = r"\b[A-Z][A-Za-z0-9]*\b"
QUOTED = r'"([^"]{2,50})"'

# Secrets, in the order they are replaced.
SECRETS: dict[str, str] = {
    "pem_private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    "auth_header": r"((?i:Authorization)\s*:\s*)(?!\[REDACTED:)\S[^\r\n]*",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "mk_agent": r"mk_agent_[A-Za-z0-9]{20,}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "openai_sk": r"sk-[A-Za-z0-9_-]{20,}",
    "openai_pk": r"pk-[A-Za-z0-9_-]{20,}",
    "openai_rk": r"rk-[A-Za-z0-9_-]{20,}",
}
# The kinds of work and their words; the first kind that matches counts.
KINDS: dict[str, str] = {
    "fix": "fix|bug|error|patch|hotfix|correct",
    "feature": "add|implement|feature|new|build|create",
    "refactor": "refactor|rename|restructure|cleanup|clean up|move",
    "docs": "doc|docs|documentation|document|readme|changelog|comment",
    "incident": "incident|outage|down|crash|panic|emergency",
    "chore": "chore|upgrade|dependency|dependencies|version|bump",
    "investigation": "investigat|explore|analyse|analyze|check|why|how",
}
# Names of file types by suffix.
TYPE_LABELS: dict[str, str] = {
    ".pdf": "PDF document",
    ".doc": "Word document",
    ".docx": "Word document",
    ".xls": "Excel spreadsheet",
    ".xlsx": "Excel spreadsheet",
    ".ppt": "PowerPoint deck",
    ".pptx": "PowerPoint deck",
    ".txt": "text file",
    ".md": "Markdown file",
    ".html": "HTML page",
    ".htm": "HTML page",
    ".csv": "CSV table",
    ".json": "JSON file",
    ".xml": "XML file",
    ".jpg": "image",
    ".jpeg": "image",
    ".png": "image",
    ".gif": "image",
    ".svg": "vector image",
    ".psd": "Photoshop image",
    ".eps": "vector image",
    ".xd": "Adobe XD design",
    ".vsdx": "Visio diagram",
    ".dwg": "CAD drawing",
    ".mp4": "video",
    ".mov": "video",
    ".zip": "archive",
    ".rar": "archive",
}
# Suffixes read as text, and those that need a converter.
TEXT_SUFFIXES = (".md", ".markdown", ".txt", ".text", ".rst", ".log")
CONVERTIBLE_SUFFIXES = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".csv", ".tsv", ".html", ".htm", ".xml", ".json", ".epub", ".rtf", ".odt", ".msg")
# Media types by suffix.
MIME: dict[str, str] = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".bmp": "image/bmp",
    ".svg": "image/svg+xml",
}


def entities(content: Column, most: int = 24, extra_stop: tuple[str, ...] = (), min_length: int = 2) -> Column:
    """Capitalised phrases, then their words, then quoted spans: lower case, in
    order, each once. Word borders are those of Unicode, capitals A to Z.

    ``content`` is evaluated for each pattern; a costly one should be a column of its own."""
    # a border costs far more to look for than a capital, so only capitals are tried
    found = F.concat(*[F.regexp_extract_all(content, F.lit("(?U)" + p), F.lit(g)) for p, g in (("(?=[A-Z])" + CAP_PHRASE, 0), ("(?=[A-Z])" + CAP_WORD, 0), (QUOTED, 1))])
    keys = F.transform(F.array_distinct(found), lambda x: strip(F.lower(x)))
    stop = F.array(*[F.lit(w) for w in (*STOP_WORDS, *extra_stop)])
    good = F.filter(keys, lambda x: (F.length(x) >= min_length) & ~F.array_contains(stop, x))
    return F.slice(F.array_distinct(good), 1, most)


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", " ")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def clean_markdown(text: Column) -> Column:
    """Line ends unified, comments dropped, line ends stripped, blank runs cut to one, ends stripped of line feeds."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"[^\S\n]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\n+|\n+\z", "")


def redact(text: Column) -> Column:
    """Every secret becomes ``[REDACTED:label]``; a header keeps its name. Redacting twice changes nothing."""
    for label, pattern in SECRETS.items():
        text = F.regexp_replace(text, pattern, ("$1" if label == "auth_header" else "") + f"[REDACTED:{label}]")
    return text


def secret_counts(text: Column) -> dict[str, Column]:
    return {label: F.regexp_count(text, F.lit(pattern)) for label, pattern in SECRETS.items()}


def kind(text: Column) -> Column:
    low, out = F.lower(text), F.lit("investigation")
    for name, words in reversed(KINDS.items()):
        out = F.when(low.rlike(rf"\b(?:{words})\b"), name).otherwise(out)
    return out


def snippet(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("…"))).otherwise(text)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def _by_suffix(s: Column, table: dict[str, str], other: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, s), other)


def type_label(s: Column) -> Column:
    s = F.lower(s)
    return _by_suffix(s, TYPE_LABELS, F.when(s == "", "file").otherwise(F.concat(F.upper(F.substring(s, 2, 100)), F.lit(" file"))))


def mime(s: Column) -> Column:
    return _by_suffix(F.lower(s), MIME, F.lit("application/octet-stream"))


def text_route(s: Column) -> Column:
    """How a file's text is got at, by suffix."""
    return F.when(s.isin(*TEXT_SUFFIXES), "text").when(s.isin(*CONVERTIBLE_SUFFIXES), "convert").otherwise("unknown")


def human_size(n: Column) -> Column:
    out = F.concat(F.format_string("%.1f", n / float(1024**4)), F.lit(" TB"))
    for i, unit in reversed(list(enumerate(("KB", "MB", "GB"), 1))):
        out = F.when(n < 1024 ** (i + 1), F.concat(F.format_string("%.1f", n / float(1024**i)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def chunks(text: Column, most: int) -> Column:
    """Paragraphs gathered up to ``most`` characters (10000 at most); longer ones are cut."""
    hard = max(1, min(most, 10_000))
    space = " \t\n\r\f\x0b"
    strip = lambda c: F.btrim(c, F.lit(space))
    paras = F.filter(F.transform(F.split(strip(text), "\n\n", -1), strip), lambda p: F.length(p) > 0)
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))
    flush = lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"])

    def step(a: Column, p: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / hard).cast("int")), lambda i: F.substring(p, i * hard + 1, F.lit(hard)))
        long = F.struct(F.concat(flush(a), cut).alias("out"), F.lit("").alias("buf"))
        full = F.struct(flush(a).alias("out"), p.alias("buf"))
        more = F.struct(a["out"].alias("out"), F.when(a["buf"] != "", F.concat(a["buf"], F.lit("\n\n"), p)).otherwise(p).alias("buf"))
        return F.when(F.length(p) > hard, long).when((a["buf"] != "") & (F.length(a["buf"]) + 2 + F.length(p) > hard), full).otherwise(more)

    return F.aggregate(paras, state, step, flush)


def to_utc(ts: Column) -> Column:
    """A time from text: numbers are epoch seconds (below 1e10) or milliseconds; else ISO forms, naive ones UTC. As ``…Z`` text, or null."""
    num = F.try_to_number(ts, F.lit("9999999999999999")).cast("double")
    num = F.when(ts.rlike(r"^[0-9]+(\.[0-9]+)?$"), ts.cast("double")).otherwise(num)
    at = F.when(num < 1e10, F.timestamp_seconds(num)).when(num.isNotNull(), F.timestamp_millis(num.cast("long")))
    at = F.coalesce(at, F.try_to_timestamp(ts), F.try_to_timestamp(ts, F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(ts, F.lit("yyyy-MM-dd")))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def base64url_text(text: Column) -> Column:
    """The text of url-safe base64 without padding, stripped of what a wrong
    length leaves at its end; null if it cannot be decoded."""
    whole = F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), "=")
    got = F.make_valid_utf8(F.try_to_binary(whole, F.lit("base64")).cast("string"))
    return F.nullif(F.regexp_replace(got, "[?\ufffd\\x00-\\x1f]+\\z", ""), F.lit(""))


def is_local_url(url: Column) -> Column:
    """Whether a url's host is this machine: localhost, 127.*, ::1."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[^:/?#]*:?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1), F.lit("")))
    return (host == "localhost") | host.startswith("127.") | host.isin("::1", "[::1]")


def extract_json(text: Column) -> Column:
    """The one JSON object in a model's reply, as JSON text; ``{}`` without one.
    Thoughts, code fences and prose around it are passed over."""
    t = strip(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))
    fence = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    t = F.when(t.rlike(r"(?s)```(?:json)?\s*(.*?)\s*```"), strip(fence)).otherwise(t)
    body = F.try_parse_json(F.regexp_extract(t, r"(?s)(\{.*\})", 1))
    return F.when(F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False)), F.to_json(body)).otherwise("{}")


# What marks a text's own facts (numbers, capitals, quoted spans).
DISTINCTIVE = r'\b\d[\d.,:/-]*\b|\b[A-Z]{2,}\b|"[^"]{2,40}"'


def distinctive_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(DISTINCTIVE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.btrim(x, F.lit('"')))))
