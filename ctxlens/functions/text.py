"""File references, fenced code blocks and file names inside message text.

The patterns run on Java's regex engine. Word and space classes are spelled out
(`_W`, `_S`) so that letters and blanks outside ASCII count as they do in
Python, and `(?d)` makes only a line feed end a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv

_W = r"\p{L}\p{N}_"
_S = r"\s\x0B\x1c-\x1f\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NS = f"[^{_S}]"
_SP = f"[{_S}]"

PATH_REFERENCE = (
    rf"(?md)(?:^|[{_S}`\"'\(])([.{_W}/\\-]+\.(?:"
    + "|".join(e.lstrip(".") for e in fv.CODE_EXTENSIONS)
    + rf"))(?:[{_S}`\"'\),:;]|$)"
)
ANY_EXTENSION = r"\.(?:" + "|".join(e.lstrip(".") for e in fv.CODE_EXTENSIONS) + ")"
HEADING_REFERENCE = rf"(?iu)#+{_SP}*(?:File|Module|Script):{_SP}*({_NS}+)"
CODE_BLOCK = (
    rf"(?s)(?:(?:#|//){_SP}*(?:File|file|MODULE|module):{_SP}*({_NS}+)\n|"
    rf"(?:/\*{_SP}*(?:File|file|MODULE|module):{_SP}*({_NS}+){_SP}*\*/\n|"
    rf"<!--{_SP}*file:{_SP}*({_NS}+){_SP}*-->\n))?"
    rf"```([{_W}]*)\n(.*?)```"
)
INLINE_ANNOTATION = (
    rf"(?md)^(?:#|//){_SP}*(?:File|file|MODULE|module):{_SP}*({_NS}+)"
)
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
ODD_BREAK = r"[\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def strip(value: Column) -> Column:
    """Trim every Unicode blank on both ends."""
    return F.btrim(value, F.lit(BLANKS))


def file_key(filename: Column) -> Column:
    """Name used to compare files: basename in lower case."""
    slashed = F.rtrim(F.replace(filename, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.lower(F.substring_index(slashed, "/", -1))


def extension(filename: Column) -> Column:
    return F.when(
        filename.contains("."),
        F.concat(F.lit("."), F.substring_index(filename, ".", -1)),
    ).otherwise(F.lit(""))


def language_of(filename: Column) -> Column:
    """Language by file extension, '' where the extension is not listed."""
    table = F.create_map(
        *[F.lit(x) for pair in fv.EXTENSION_LANGUAGE.items() for x in pair]
    )
    return F.coalesce(F.try_element_at(table, extension(filename)), F.lit(""))


def without_code_blocks(text: Column) -> Column:
    return F.when(
        text.contains("```"), F.regexp_replace(text, CODE_BLOCK, "")
    ).otherwise(text)


def path_references(text: Column) -> Column:
    """Paths in a text; texts without a dot and extension skip the costly search."""
    return F.when(
        F.regexp_like(text, F.lit(ANY_EXTENSION)),
        F.regexp_extract_all(text, F.lit(PATH_REFERENCE), F.lit(1)),
    ).otherwise(F.array().cast("array<string>"))


def heading_references(text: Column) -> Column:
    return F.when(
        text.contains("#"),
        F.regexp_extract_all(text, F.lit(HEADING_REFERENCE), F.lit(1)),
    ).otherwise(F.array().cast("array<string>"))


def referenced_files(text: Column) -> Column:
    """Distinct file keys named in prose; text inside code blocks is ignored."""
    prose = without_code_blocks(text)
    refs = F.concat(path_references(prose), heading_references(prose))
    return F.array_distinct(F.transform(refs, file_key))


def first_reference(text: Column) -> Column:
    return F.coalesce(
        blank_to_null(F.regexp_extract(text, PATH_REFERENCE, 1)),
        blank_to_null(F.regexp_extract(text, HEADING_REFERENCE, 1)),
    )


def code_blocks(text: Column) -> Column:
    """ARRAY<STRUCT<block_idx, filename, file_key, language, code>> of a text.

    Texts without a fence are not scanned. The whole text is matched once; the
    groups are then read from each matched block, which starts with its match.
    """
    whole = F.when(
        text.contains("```"),
        F.regexp_extract_all(text, F.lit(CODE_BLOCK), F.lit(0)),
    ).otherwise(F.array().cast("array<string>"))

    def group(block: Column, g: int) -> Column:
        return F.regexp_extract(block, CODE_BLOCK, g)

    raw = F.transform(
        whole,
        lambda b, i: F.struct(
            i.cast("int").alias("block_idx"),
            F.coalesce(*[blank_to_null(group(b, g)) for g in (1, 2, 3)]).alias(
                "annotated"
            ),
            group(b, 4).alias("fence"),
            group(b, 5).alias("code"),
        ),
    )
    named = F.transform(
        raw,
        lambda b: F.struct(
            b.block_idx.alias("block_idx"),
            F.coalesce(
                b.annotated,
                blank_to_null(F.regexp_extract(b.code, INLINE_ANNOTATION, 1)),
            ).alias("filename"),
            b.fence.alias("fence"),
            b.code.alias("code"),
        ),
    )
    return F.transform(
        named,
        lambda b: F.struct(
            b.block_idx.alias("block_idx"),
            b.filename.alias("filename"),
            file_key(b.filename).alias("file_key"),
            F.when(
                (b.fence == "") & b.filename.isNotNull(), language_of(b.filename)
            )
            .otherwise(b.fence)
            .alias("language"),
            b.code.alias("code"),
        ),
    )


def splice_blocks(text: Column, replacements: Column) -> Column:
    """Put new code into a text's blocks.

    `replacements` is MAP<INT block_idx, STRUCT<STRING code, INT old_chars>>; blocks
    without an entry stay as they are. The text is cut at its blocks and rebuilt by
    position, so equal code in another block or in prose is never touched.
    """
    blocks = F.regexp_extract_all(text, F.lit(CODE_BLOCK), F.lit(0))
    gaps = F.split(text, CODE_BLOCK, -1)

    def rebuilt(block: Column, idx: Column) -> Column:
        new = F.try_element_at(replacements, idx.cast("int"))
        head = F.length(block) - new.old_chars - 3
        return F.when(new.isNull(), block).otherwise(
            F.concat(F.substring(block, F.lit(1), head), new.code, F.lit("```"))
        )

    pieces = F.transform(
        F.arrays_zip(gaps.alias("gap"), blocks.alias("block")),
        lambda x, i: F.concat(
            x.gap, F.coalesce(rebuilt(x.block, i), F.lit(""))
        ),
    )
    return F.when(replacements.isNull(), text).otherwise(F.array_join(pieces, ""))


def file_summary(
    content: Column, max_chars: int | None = None, max_lines: int | None = None
) -> Column:
    """Lines of a file, blanks dropped, joined by one space; '' if none.

    The whole file, or its first `max_chars` characters (a line break counts as one)
    and `max_lines` lines. Line breaks other than a line feed are rare, so they are
    looked for once and replaced only where they occur.
    """
    head = content if max_chars is None else F.substring(content, 1, 2 * max_chars)
    unix = F.when(
        F.regexp_like(head, F.lit(ODD_BREAK)), F.regexp_replace(head, LINE_BREAK, "\n")
    ).otherwise(head)
    if max_chars is not None:
        unix = F.substring(unix, 1, max_chars)
    pieces = F.split(unix, "\n", -1 if max_lines is None else max_lines + 1)
    if max_lines is not None:
        pieces = F.slice(pieces, 1, max_lines)
    stripped = F.transform(pieces, strip)
    return F.array_join(F.filter(stripped, lambda x: x != ""), " ")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def embedding_text(path: Column, summary: Column) -> Column:
    return F.concat(
        F.lit("Filename: "), base_name(path), F.lit(". Content: "), summary
    )


def query_words(query: Column) -> Column:
    """Distinct lower-case words of a query; dots separate words."""
    spaced = F.replace(F.lower(query), F.lit("."), F.lit(" "))
    words = F.split(spaced, f"{_SP}+", -1)
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def file_from_tool_input(tool_input: Column) -> Column:
    """File path in a tool call's arguments (MAP<STRING, STRING>).

    Known keys first, in fixed order; otherwise the first value that holds a
    path-like token. Values are visited in the map's own key order.
    """
    by_key = [
        blank_to_null(F.try_element_at(tool_input, F.lit(k)))
        for k in fv.TOOL_PATH_KEYS
    ]
    found = F.filter(
        F.transform(F.map_values(tool_input), first_reference),
        lambda x: x.isNotNull(),
    )
    return F.coalesce(*by_key, F.get(found, F.lit(0)))
