"""Column expressions for names, paths and texts.  No Python runs per row."""

from pyspark.sql import Column, functions as F

from factgraph import schema as S


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def is_unresolved(target) -> Column:
    return F.startswith(_col(target), F.lit(S.UNRESOLVED_PREFIX))


def after_prefix(c, prefix: str) -> Column:
    return F.substr(_col(c), F.lit(len(prefix) + 1))


def after_first_colon(c) -> Column:
    """Text behind the first colon; the whole text when there is none."""
    return F.substr(_col(c), F.instr(_col(c), ":") + 1)


def lookup_name(target) -> Column:
    """Simple name an ``unresolved:`` target is looked up by.

    ``a.b.c`` is looked up as ``c``; an object creation ``a.T.<init>`` as ``T``.
    Null for any other target, which keeps it out of the join.
    """
    text = after_prefix(target, S.UNRESOLVED_PREFIX)
    last = F.substring_index(text, ".", -1)
    owner = F.when(F.contains(text, F.lit(".")), F.split_part(text, F.lit("."), F.lit(-2)))
    name = F.when(last == "<init>", F.coalesce(owner, text)).otherwise(last)
    return F.when(is_unresolved(target), name)


def path_parts(path) -> Column:
    return F.split(_col(path), "/")


def base_name(path) -> Column:
    return F.element_at(path_parts(path), -1)


def suffix(path) -> Column:
    """Lower-cased file suffix with its dot, or an empty string.

    A leading dot starts a hidden name, not a suffix.
    """
    return F.lower(F.regexp_extract(_col(path), r"[^/](\.[^./]+)$", 1))


def language_of(path) -> Column:
    s = suffix(path)
    expr = F.lit(None).cast("string")
    for ext, language in S.LANGUAGES.items():
        expr = F.when(s == ext, language).otherwise(expr)
    return expr


def _listed_or_hidden(part: Column, names) -> Column:
    return part.isin(*names) | F.startswith(part, F.lit("."))


def in_skipped_dir(path) -> Column:
    """True when a directory part of a relative path is left out of a scan."""
    parts = path_parts(path)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(dirs, lambda p: _listed_or_hidden(p, S.SCAN_SKIP_DIRS))


def has_skipped_part(path) -> Column:
    """The filter for change events: shorter list, but every part counts,
    the file name included."""
    return F.exists(path_parts(path), lambda p: _listed_or_hidden(p, S.CHANGE_SKIP_PARTS))


def text_of(content) -> Column:
    """Binary to text, with bad bytes replaced instead of raising."""
    return F.make_valid_utf8(_col(content).cast("string"))


def content_hash(content) -> Column:
    return F.sha2(_col(content).cast("binary"), 256)


def line_count(text) -> Column:
    """Newlines + 1, on text or binary."""
    text = _col(text).cast("string")
    # length difference: no regular expression, linear in the text
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def clean_block_doc(raw) -> Column:
    """Javadoc text without comment markers and blank lines; null if empty."""
    def strip_marker(line):
        line = F.btrim(line, F.lit(" \t\r\f\x0b"))
        return (
            F.when(F.startswith(line, F.lit("/**")), F.substr(line, F.lit(4)))
            .when(F.startswith(line, F.lit("*/")), F.lit(""))
            .when(F.startswith(line, F.lit("*")), F.substr(line, F.lit(2)))
            .otherwise(line)
        )

    lines = F.transform(F.split(_col(raw), "\n"), lambda x: F.btrim(strip_marker(x), F.lit(" \t\r\f\x0b")))
    kept = F.filter(lines, lambda x: x != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def strip_quotes(raw) -> Column:
    return F.btrim(_col(raw), F.lit("'\""))


def clean_signature(raw) -> Column:
    """Trimmed declaration head without a closing colon."""
    blanks = F.lit(" \t\r\n\f\x0b")
    head = F.btrim(_col(raw), blanks)
    return F.when(F.endswith(head, F.lit(":")),
                  F.btrim(F.substr(head, F.lit(1), F.length(head) - 1), blanks)).otherwise(head)


def shorten(text, n: int = 100) -> Column:
    text = _col(text)
    return F.when(F.length(text) > n, F.concat(F.substr(text, F.lit(1), F.lit(n)), F.lit("..."))).otherwise(text)


def first_import_name(text) -> Column:
    """``a.b as c`` gives ``a.b``."""
    return F.btrim(F.element_at(F.split(_col(text), " as "), 1))


def relative_to(path, root: str) -> Column:
    """Path below ``root``, or null when it lies outside."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(_col(path), F.lit(base)), after_prefix(path, base))
