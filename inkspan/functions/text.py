"""Text scalars as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Unicode trimming removes.
WS = r"[\x09-\x0D\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_CHARS = "".join(chr(x) for x in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# Characters that end a word broken over two lines.
HYPHENS = r"[-\x{2010}\x{2011}\x{2012}\x{2013}\x{AD}]"
VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com")
AUDIO_ENDINGS = (".mp3", ".wav", ".m4a", ".flac")
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
# Words that do not count in a heading.
SMALL_WORDS = "and or of the a an to in on for with at by from vs via as is are into over under".split()
CURRENCIES = ("$", "€", "£", "¥", "₩", "₹")


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x: str | Column) -> Column:
    return F.btrim(c(x), F.lit(WS_CHARS))


def ascii_lower(x: str | Column) -> Column:
    """Lower-cases A to Z only; other letters keep their case."""
    return F.translate(c(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def comparable(x: str | Column) -> Column:
    return ascii_lower(trim_ws(x))


def cell_text(x: str | Column, most: int = 2000) -> Column:
    """Line breaks become spaces, then trim, then at most ``most`` characters."""
    return F.substring(trim_ws(F.translate(c(x), "\r\n", "  ")), 1, most)


def markdown_cell(x: str | Column) -> Column:
    return F.translate(F.replace(c(x), F.lit("|"), F.lit("\\|")), "\r\n", "  ")


def collapse(x: str | Column) -> Column:
    """Every run of white space is one space; ends trimmed."""
    return F.btrim(F.regexp_replace(c(x), f"{WS}+", " "))


def collapse_keep_lines(x: str | Column) -> Column:
    """As collapse, but line feeds stay."""
    inner = WS.replace(r"\x09-\x0D", r"\x09\x0B-\x0D")
    return trim_ws(F.regexp_replace(c(x), f"{inner}+", " "))


def atom_text(x: str | Column) -> Column:
    return collapse_keep_lines(F.replace(c(x), F.lit("\0"), F.lit("")))


def link_kind(url: str | Column) -> Column:
    u = ascii_lower(url)
    video = F.lit(False)
    for host in VIDEO_HOSTS:
        video = video | F.contains(u, F.lit(host))
    audio = F.lit(False)
    for ending in AUDIO_ENDINGS:
        audio = audio | F.endswith(u, F.lit(ending))
    web = F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://"))
    return F.when(video, "video").when(audio, "audio").when(web, "web").otherwise("unknown")


def extension(name: str | Column) -> Column:
    """ASCII-lower text after the last dot; empty without a dot."""
    return F.regexp_extract(ascii_lower(name), r"\.([^.]*)$", 1)


def image_type(name: str | Column) -> Column:
    ext = extension(name)
    out = None
    for e, mime in IMAGE_TYPES.items():
        out = F.when(ext == e, mime) if out is None else out.when(ext == e, mime)
    return out.otherwise("application/octet-stream")


def type_extension(mime: str | Column) -> Column:
    m = c(mime)
    return (
        F.when(m == "image/png", "png").when(m == "image/jpeg", "jpg").when(m == "image/webp", "webp")
        .when(m == "image/bmp", "bmp").when(m == "image/tiff", "tiff").when(m == "image/gif", "gif").otherwise("bin")
    )


def safe_file_name(name: str | Column) -> Column:
    kept = F.regexp_replace(c(name), r"[^A-Za-z0-9._ -]", "_")
    kept = F.regexp_replace(F.trim(kept), r"^\.+|\.+$", "")
    return F.when(kept == "", "file").otherwise(kept)


def base_name(path: str | Column) -> Column:
    return F.regexp_extract(c(path), r"([^/\\]*)$", 1)


def alphanumerics(x: str | Column) -> Column:
    return F.length(F.regexp_replace(c(x), r"[^\p{IsAlphabetic}\p{N}]", ""))


def text_quality(n: Column) -> Column:
    return F.when(n > 500, "text_rich").when(n >= 50, "text_sparse").otherwise("image_only")


def clean_pdf_text(x: str | Column) -> Column:
    """Joins words broken over lines, collapses white space, and takes years out of digit runs.

    Six digits that are a year and a month become Y-MM, eight that are a date Y-MM-DD, other runs of
    six to nine that start with a year are cut after it.
    """
    joined = F.regexp_replace(c(x), HYPHENS + r"[ \t]*\r?\n[ \t]*(?=\p{Ll})", "")
    flat = collapse(joined)
    year = r"(?<![0-9])(19[0-9]{2}|20[0-9]{2}|2100)"
    month, day = "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
    flat = F.regexp_replace(flat, f"{year}{month}(?![0-9])", "$1-$2")
    flat = F.regexp_replace(flat, f"{year}{month}{day}(?![0-9])", "$1-$2-$3")
    return F.trim(F.regexp_replace(flat, year + r"([0-9]{2,5})(?![0-9-])", "$1 $2"))


def column_name(index: str | Column) -> Column:
    """0 is A, 25 is Z, 26 is AA; up to three letters."""
    i = c(index).cast("int")
    letter = lambda v: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (v % 26 + 1).cast("int"), F.lit(1))
    two, three = F.floor(i / 26) - 1, F.floor((i - 26) / 676) - 1
    return F.concat(
        F.when(i >= 702, letter(three)).otherwise(""), F.when(i >= 26, letter(two)).otherwise(""), letter(i)
    )


def column_index(name: str | Column) -> Column:
    """A is 0; null for anything but letters."""
    letters = F.upper(c(name))
    fold = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))
    return F.when(F.rlike(letters, F.lit("^[A-Z]{1,4}$")), fold - 1)


def cell_reference(row: Column, column: Column) -> Column:
    return F.concat(column_name(column), (c(row) + 1).cast("string"))


def a1_cell(x: str | Column) -> Column:
    """B3 -> struct(r 2, c 1); null for anything else."""
    t = trim_ws(x)
    row = F.regexp_extract(t, "^[A-Za-z]+([0-9]+)$", 1).try_cast("bigint")
    col = column_index(F.regexp_extract(t, "^([A-Za-z]+)[0-9]+$", 1))
    return F.when((row > 0) & col.isNotNull(), F.struct((row - 1).alias("r"), col.cast("int").alias("c")))


def a1_range(x: str | Column) -> Column:
    """A2:B3 -> struct(r0 1, r1 3, c0 0, c1 2), ends exclusive, in whichever order the corners come; one cell is a range."""
    at = F.split(c(x), ":", 2)
    a, b = a1_cell(at[0]), a1_cell(F.coalesce(F.get(at, 1), at[0]))
    least, most = (lambda f: F.least(a[f], b[f])), (lambda f: F.greatest(a[f], b[f]) + 1)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(least("r").alias("r0"), most("r").alias("r1"), least("c").alias("c0"), most("c").alias("c1")))


def unit_of_format(code: str | Column) -> Column:
    """The unit that a number format shows: percent, a currency, a [$...] symbol or a quoted text."""
    x = c(code)
    out = F.when(F.contains(x, F.lit("%")), "%")
    for sign in CURRENCIES:
        out = out.when(F.contains(x, F.lit(sign)) & ~F.contains(x, F.lit("[$")), sign)
    bracket = F.regexp_extract(x, r"\[\$([^\]A-Za-z0-9-])", 1)
    quoted = F.regexp_extract(x, r'"([^"]+)"', 1)
    return out.when(bracket != "", bracket).when(quoted != "", quoted)


def number_text(x: str | Column) -> Column:
    """Integral values without a fraction, never an exponent."""
    v = c(x).cast("double")
    plain = v.cast("decimal(38,12)").cast("string")
    fraction = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e18)
    return F.when(F.isnan(v), "NaN").when(whole, v.cast("decimal(38,0)").cast("string")).otherwise(fraction)


def with_unit(value: Column, unit: Column) -> Column:
    n = number_text(value)
    return (
        F.when(unit == "%", F.concat(n, F.lit("%"))).when(unit.isin(*CURRENCIES), F.concat(unit, n))
        .when(unit.isNull() | (unit == ""), n).otherwise(F.concat_ws(" ", n, unit))
    )


LIST_BULLET = r"^\s*[•*–—-]\s+(\S.*)$"
LIST_NUMBER = r"^\s*[0-9]{1,8}[.)]\s*(\S.*)$"


def list_item(x: str | Column) -> Column:
    """The item's text, or null if the line is none."""
    bullet, number = F.regexp_extract(c(x), LIST_BULLET, 1), F.regexp_extract(c(x), LIST_NUMBER, 1)
    return F.when(bullet != "", bullet).when(number != "", number)


def is_ordered_item(x: str | Column) -> Column:
    return F.regexp_extract(c(x), LIST_NUMBER, 1) != ""


def table_columns(x: str | Column) -> Column:
    """Parts between tabs or runs of two spaces; null unless there are at least two."""
    parts = F.filter(F.split(F.trim(c(x)), r"\t| {2,}"), lambda p: F.trim(p) != "")
    return F.when(F.size(parts) >= 2, F.transform(parts, F.trim))


def looks_like_heading(x: str | Column) -> Column:
    """Short, no final full stop, at least two words that count, and capitals: seven of ten words in title case
    or all capitals, or 85 % of the letters.

    A word is what white space parts, without what is no ASCII letter or digit at its ends; small words and
    words without an ASCII letter do not count.
    """
    text = trim_ws(x)
    bare = F.transform(F.split(text, f"{WS}+"), lambda w: F.regexp_replace(w, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    letters = F.transform(F.filter(bare, lambda w: ~ascii_lower(w).isin(*SMALL_WORDS)), lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    count = F.filter(letters, lambda w: w != "")
    cased = F.filter(count, lambda w: F.rlike(w, F.lit("^([A-Z]+|[A-Z][a-z]*)$")))
    joined = F.array_join(count, "")
    capitals = F.length(F.regexp_replace(joined, "[^A-Z]", ""))
    mostly = (F.size(cased) * 100 >= F.size(count) * 70) | (capitals * 100 >= F.length(joined) * 85)
    short = (F.length(text) <= 180) & ~F.endswith(text, F.lit("."))
    return F.when(short, (F.size(count) >= 2) & mostly).otherwise(F.when(text.isNotNull(), False))


def heading_level(ratio: Column) -> Column:
    return F.when(ratio >= 2.0, 1).when(ratio >= 1.6, 2).when(ratio >= 1.3, 3).when(ratio >= 1.15, 4).otherwise(5)


def mermaid_label(x: str | Column, most: int | None = 240) -> Column:
    text = F.trim(F.replace(F.translate(F.replace(c(x), F.lit("\r"), F.lit("")), '"|', "'/"), F.lit("\n"), F.lit("<br/>")))
    return text if most is None else F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def html_fallback(x: str | Column) -> Column:
    """What is done with markup that does not parse: brackets become spaces, white space collapses."""
    return collapse(F.translate(c(x), "<>", "  "))


def is_html(x: str | Column) -> Column:
    t = c(x)
    has = lambda s: F.contains(t, F.lit(s))
    return has("<") & has(">") & (has("<p") | has("<div") | has("<h") | has("</"))


def image_magic(data: str | Column) -> Column:
    """A MIME type by the first bytes, null if none is known."""
    head = F.hex(F.substring(c(data), 1, 12))
    return (
        F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg")
        .when(F.startswith(head, F.lit("47494638")), "image/gif")
        .when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "image/webp")
        .when(F.startswith(head, F.lit("D7CDC69A")), "image/wmf")
    )


def image_id(data: str | Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c(data), 256))
