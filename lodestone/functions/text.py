"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def knowledge_tokens(text: Column) -> Column:
    """A quarter of the ASCII characters, rounded up, and every other character; at least 1."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.greatest(F.lit(1), F.ceil((F.length(text) - other) / 4) + other).cast("long")


def code_tokens(text: Column) -> Column:
    """The sum over words, numbers and other characters of a quarter of their bytes, rounded up, at least 1 each."""
    chunks = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_])"), F.lit(1))
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + F.greatest(F.lit(1), F.ceil(F.octet_length(c) / 4)).cast("long"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def glob_regex(glob: str) -> str:
    """``**/`` any folders, ``**`` anything, ``*`` within a folder, ``?`` one character of a name."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r"\.^$+{}[]|()" else c)
            i += 1
    return f"^{out}$"


def path_allowed(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Some include glob matches and no exclude glob does."""
    hit = lambda globs: F.lit(False) if not globs else path.rlike("|".join(glob_regex(g) for g in globs))
    return hit(include) & ~hit(exclude)


def scopes_overlap(a: Column, b: Column) -> Column:
    """One path is the other or lies above it."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))


def eligible_source(path: Column, extension: str, segment: str, excluded: list[str]) -> Column:
    ok = F.endswith(path, F.lit(extension)) & F.contains(path, F.lit(f"/{segment}/"))
    for word in excluded:
        ok = ok & ~F.contains(path, F.lit(f"/{word}/"))
    return ok


def classify(text: Column, cues: list[tuple[str, list[str]]]) -> Column:
    """The first label, in order of precedence, one of whose cues the lower-cased text holds."""
    low, found = F.lower(text), None
    for label, words in cues:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w.lower()))
        found = F.when(hit, label) if found is None else found.when(hit, label)
    return found


def backticked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))


def decorators(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("@([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))


def calls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][A-Za-z0-9_$.]*)\s*\("), F.lit(1))


def identifier_signals(text: Column) -> Column:
    """Sorted distinct calls, their leaves, decorators and quoted names."""
    c = calls(text)
    leaves = F.transform(c, lambda x: F.substring_index(x, ".", -1))
    return F.array_sort(F.array_distinct(F.concat(c, leaves, decorators(text), backticked(text))))


def canonical_call(call: Column, roots: Column) -> Column:
    """Without spaces, ``?.`` as ``.``, and the first name replaced by map ``roots`` where it has it."""
    plain = F.replace(F.regexp_replace(call, r"\s+", ""), F.lit("?."), F.lit("."))
    root = F.substring_index(plain, ".", 1)
    return F.concat(F.coalesce(roots[root], root), F.substring(plain, F.length(root) + 1, F.length(plain)))


def native_id(text: Column, pattern: str = r"([A-Za-z]+-[0-9]+)") -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", F.replace(F.upper(found), F.lit("-"), F.lit("_")))


def source_family(path: Column, marker: str = "src") -> Column:
    """The path above its first ``marker`` segment, or its first segment where there is none."""
    parts = F.split(path, "/")
    at = F.array_position(parts, marker).cast("int")
    return F.when(at > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(1))), "/")).otherwise(parts[0])


# Fixed values of the fragment rules.
CLOSING = "\"'”’」』）)]}》〉"
SOFT = "，、,:：。！？；!?; \t\n"
MOST_CHARACTERS = 800
_SPACE = r"[\s\p{Z}\x1C-\x1F\x85]"


def sentence_pieces(text: Column) -> Column:
    """A lossless split: pieces end after a line feed, after a full-width terminator, or after ! ? ; where white space or the end follows.

    Closing marks after a terminator and all white space belong to the piece before them.
    """
    close = "[\"'”’」』）)\\]}》〉]*"
    piece = rf"(?s)(.*?(?:\n{_SPACE}*|[。！？；]{close}{_SPACE}*|[!?;]{close}(?:{_SPACE}+|\z))|.+\z)"
    return F.filter(F.regexp_extract_all(text, F.lit(piece), F.lit(1)), lambda x: x != "")


def bounded_pieces(pieces: Column, most: int = MOST_CHARACTERS) -> Column:
    """Pieces of at most ``most`` characters: a longer one is cut after the last soft character in the second half of its bound, else at the bound."""
    half = most // 2
    cut = rf"(?s)((?=.{{{most + 1}}})(?:.{{{half + 1},{most}}}(?<=[{SOFT}])|.{{{most}}})|.+)"
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > most, F.regexp_extract_all(p, F.lit(cut), F.lit(1))).otherwise(F.array(p))))


def labelled_line(label: str, values: Column, most: int = 8) -> Column:
    """``label: a, b`` of the first values; null where there are none."""
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(values, 1, most), ", ")))


def lines_of(*parts: Column) -> Column:
    """The parts that aren't null or empty, a line each."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")


def canonical_identity(prefix: str, fields: dict[str, Column]) -> Column:
    """``prefix:sha256:hex`` of the JSON object with sorted keys, nulls written out."""
    record = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.concat(F.lit(f"{prefix}:sha256:"), F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256))


def set_version(prefix: str, members: Column) -> Column:
    """An aggregate: the identity of a set of strings, whatever their order."""
    return F.concat(F.lit(f"{prefix}:sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_set(members)), "\n"), 256))


def utc_timestamp(text: Column) -> Column:
    """A timestamp from ISO text that ends in Z or +00:00; null for any other zone."""
    return F.when(text.rlike(r"(Z|\+00:00)$"), F.try_to_timestamp(text))


def escape_markdown(text: Column) -> Column:
    """The text with its markup characters as entities or behind a backslash."""
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return F.regexp_replace(text, r"([\\`*_\[\]#|])", r"\\$1")
