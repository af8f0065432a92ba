"""String functions: path names in URLs, log lines, dates in names, octal modes, icons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mangle(path: Column) -> Column:
    """FN-01: a path as one URL component; null is empty. Space is %20 and ! ' ( ) ~ stay."""
    out = F.url_encode(F.coalesce(path, F.lit("")))
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def unmangle(path: Column) -> Column:
    """FN-02: the path of a URL component; a plus stays, malformed escapes raise."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def try_unmangle(path: Column) -> Column:
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def capitalize(text: Column) -> Column:
    """FN-09: the first letter in upper case, the rest as it is; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def extension(name: Column) -> Column:
    """FN-16: what follows the last dot; the whole name without one."""
    return F.element_at(F.split(name, "[.]"), -1)


def progress_text(new: Column, total: Column) -> Column:
    """FN-24: files done of all."""
    return F.concat(new.cast("string"), F.lit(" / "), total.cast("string"), F.lit(" files"))


def log_lines(text: Column) -> Column:
    """FN-19, FLT-08: lines of a chunk of output; a log line glued behind a progress line stands alone; blanks go."""
    parts = F.transform(F.split(text, "[\n\r]"), lambda line: F.split(F.regexp_replace(line, "^(.+?)(log: )", "$1\n$2"), "\n"))
    return F.filter(F.flatten(parts), lambda line: line != "")


def log_line(timestamp: Column, level: Column, context: Column, message: Column) -> Column:
    """FN-26: application log line with the context padded to 25."""
    return F.format_string("%s [%-25s] %s: %s", timestamp, context, level, message)


def backup_log_line(timestamp: Column, level: Column, message: Column) -> Column:
    return F.format_string("%s %s: %s", timestamp, level, message)


def dated(name: Column) -> Column:
    """FN-21: whether a name holds a date and time anywhere."""
    return name.rlike(r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}")


def date_ms(name: Column) -> Column:
    """Milliseconds of the date and time in a name, in the session's zone; null if there is none."""
    found = F.regexp_extract(name, r"(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2})", 1)
    return F.unix_millis(F.try_to_timestamp(found, F.lit("yyyy-M-d H:m:s")))


def octal_mode(mode: Column) -> Column:
    """FN-08: permission bits in octal."""
    return F.conv(mode.bitwiseAND(4095), 10, 8)


def file_type(mode: Column) -> Column:
    """FN-07: kind of file by the type bits of its mode."""
    kinds = {0x6000: "BLOCK_DEVICE", 0x2000: "CHARACTER_DEVICE", 0x4000: "DIRECTORY", 0x1000: "FIFO", 0x8000: "REGULAR_FILE", 0xC000: "SOCKET", 0xA000: "SYMBOLIC_LINK"}
    out, bits = F, mode.bitwiseAND(0xF000)
    for value, kind in kinds.items():
        out = out.when(bits == value, kind)
    return out.otherwise("UNKNOWN")


#: Icon of each extension.
ICONS = {
    "mdi-language-html5": ("html", "xhtml", "htm"),
    "mdi-nodejs": ("js", "jsx", "ts", "tsx"),
    "mdi-json": ("json", "json5", "yaml"),
    "mdi-markdown": ("md",),
    "mdi-file-pdf": ("pdf",),
    "mdi-file-image": ("png", "jpg", "gif", "jpeg"),
    "mdi-file-excel": ("xls", "xlsx", "ods"),
    "mdi-file-word": ("doc", "docx", "odt"),
    "mdi-zip-box": ("zip",),
}


def icon(ext: Column) -> Column:
    """FN-15: icon of an extension, by exact case; null is empty."""
    out = F.when(ext.isNull(), "")
    for name, exts in ICONS.items():
        out = out.when(ext.isin(*exts), name)
    return out.otherwise("mdi-file-document-outline")


def path_prefixes(path: Column) -> Column:
    """FN-18: /a, /a/b, ... of a path, slashes normalised; the root is itself."""
    clean = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path, "/$", "")), "//+", "/")
    parts = F.slice(F.split(clean, "/"), 2, F.size(F.split(clean, "/")))
    return F.when(clean == "/", F.array(F.lit("/"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    )


def include_rules(includes: Column, excludes: Column) -> tuple[Column, Column]:
    """FN-18, SET-05: include and exclude rules of a copy: every prefix is included, each of its levels' other entries excluded."""
    found = F.flatten(F.transform(F.coalesce(includes, F.array()), path_prefixes))
    levels = F.transform(F.filter(found, lambda p: p != "/"), lambda p: F.concat(F.regexp_replace(p, "/[^/]*$", ""), F.lit("/*")))
    return F.array_distinct(found), F.array_distinct(F.concat(F.coalesce(excludes, F.array().cast("array<string>")), levels))
